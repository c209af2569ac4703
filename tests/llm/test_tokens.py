"""Token records and packing against plain Python over the same texts."""

import os
import subprocess
import sys
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from llm_support import SF_DIR, make_docs, worker_path  # noqa: F401 - fixtures
from nextcover.llm.packing import best_fit_plan, packed
from nextcover.llm.queries import QUERIES, ROOT
from nextcover.llm.records import frame, masked_crc, read_shuffled, token_records, unframe, write_records
from nextcover.llm.token_cache import Encoder

TEXTS = ["", " ", "a  b\n\n c \t d ", "  x", "\n y  \n", " é́ z q 12 3's 'T It's  ", "a\x1cb <|endoftext|> x", "Ünïcode, wörds... don't",
         "ﬁ Å K ß ẞ", "x y  z", "tab\tand\nline\r\nends ", "!!! ??? ,,,", "THE!! OF!! 12kg", "日本語 テキスト", "a" * 5000, "word " * 3000]
VOCABULARIES = [("word_bpe_49k.json", "words"), ("byte_bpe_50k.json", "bytes")]


def library(file):
    t = Tokenizer.from_file(public_tokenizers.path(file))
    t.encode_special_tokens = True
    return t


@pytest.mark.parametrize("file,kind", VOCABULARIES)
def test_same_ids_as_the_library(spark, file, kind):
    texts = TEXTS + [r["text"] for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").select("text").collect()]
    few = Encoder(public_tokenizers.path(file), kind, most=50)  # starts anew again and again
    many = Encoder(public_tokenizers.path(file), kind)
    want = [e.ids for e in library(file).encode_batch(texts, add_special_tokens=False)]
    assert [x.tolist() for x in many.encode(texts)] == want
    assert [x.tolist() for t in texts[:60] for x in few.encode([t])] == want[:60]


THREADS = """
import os, public_tokenizers
from nextcover.llm.token_cache import Encoder
enc = Encoder(public_tokenizers.path("byte_bpe_50k.json"), "bytes")
before = len(os.listdir("/proc/self/task"))
enc.encode([" ".join(f"{i}x{i}" for i in range(5000))])
print(len(os.listdir("/proc/self/task")) - before)
"""


def test_encoding_starts_no_threads():
    env = {k: v for k, v in os.environ.items() if k != "TOKENIZERS_PARALLELISM"} | {"PYTHONPATH": ROOT}
    done = subprocess.run([sys.executable, "-c", THREADS], env=env, capture_output=True, text=True, check=True)
    assert done.stdout.strip() == "0"


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_op4_equals_plain_python(spark):
    got = {r["doc_id"]: tuple(r) for r in QUERIES["op4_token_records"](spark, SF_DIR).collect()}
    t, start, n = library("word_bpe_49k.json"), 0, 0
    for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").orderBy("doc_id").collect():
        ids = t.encode(r["text"] or "", add_special_tokens=False).ids + [2]
        assert got[r["doc_id"]] == (r["doc_id"], start, len(ids), crc(ids))
        start, n = start + len(ids), n + 1
    assert len(got) == n


def test_records_with_nulls_ties_and_long_texts(spark, make_docs):
    docs = make_docs([(3, None), (None, "no id"), (1, "tie"), (1, "tie"), (2, "x y " * 20000), (9, "")])
    rows = sorted(token_records(docs).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in rows] == [None, 1, 1, 2, 3, 9]
    assert [r["start"] for r in rows] == [sum(x["n_tokens"] for x in rows[:i]) for i in range(6)]
    assert rows[4]["n_tokens"] == rows[5]["n_tokens"] == 1 and rows[3]["n_tokens"] == 40001
    assert token_records(make_docs([])).collect() == []


def test_shuffled_reads_and_damage(spark, make_docs, tmp_path):
    folder = "file://" + str(tmp_path / "records")
    docs = make_docs([(i, f"text number {i} " * (i % 7)) for i in range(50)])
    manifest = write_records(docs, folder, "word_bpe_49k.json", "words", 2, file_bytes=500)
    a, b = (read_shuffled(spark, folder, manifest, s).collect() for s in (1, 2))
    assert sorted(map(tuple, a)) == sorted(map(tuple, b)) and [r["doc_id"] for r in a] != [r["doc_id"] for r in b]
    record = bytearray(frame(5, np.array([1, 70000], np.uint32)))
    doc_id, ids, end = unframe(memoryview(record), 0)
    assert (doc_id, ids.tolist(), end) == (5, [1, 70000], len(record))
    record[15] ^= 1
    with pytest.raises(ValueError):
        unframe(memoryview(record), 0)
    assert masked_crc(b"") == 0xA282EAD8


def plain_best_fit(lengths, capacity):
    room = []
    for n in sorted(lengths, reverse=True):
        fits = [i for i, r in enumerate(room) if r >= n]
        i = min(fits, key=lambda i: room[i]) if fits else len(room)
        if not fits:
            room.append(capacity)
        room[i] -= n
    return sorted(room)


@pytest.mark.parametrize("seed", range(12))
def test_plan_equals_best_fit_one_by_one(seed):
    rng = np.random.default_rng(seed)
    capacity = int(rng.integers(5, 60))
    lengths = rng.integers(1, capacity + 1, int(rng.integers(0, 400)))
    if seed % 3 == 0:
        lengths = np.minimum(lengths, 4)
    counts = {int(k): int(n) for k, n in zip(*np.unique(lengths, return_counts=True))}
    used, seen = {}, {k: set() for k in counts}
    for length, rank, number, first, each, offset in best_fit_plan(counts, capacity).tolist():
        for i in range(number):
            seen[length].add(rank + i)
            used.setdefault(first + i // each, []).append((offset + i % each * length, length))
    assert all(seen[k] == set(range(n)) for k, n in counts.items())
    for spans in used.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= capacity
    assert sorted(capacity - sum(n for _, n in s) for s in used.values()) == plain_best_fit(lengths.tolist(), capacity)


def test_op9_places_every_piece(spark):
    rows = QUERIES["op9_best_fit_packing"](spark, SF_DIR).toPandas()
    t, want = library("byte_bpe_50k.json"), set()
    for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect():
        ids = t.encode(r["text"] or "", add_special_tokens=False).ids + [0]
        at, number, step = 0, 0, (len(ids) - 1) % 2048 + 1
        while at < len(ids):
            want.add((r["doc_id"], number, at, step, crc(ids[at:at + step])))
            at, number, step = at + step, number + 1, 2048
    assert set(map(tuple, rows[["doc_id", "piece", "start", "length", "ids_crc32"]].values.tolist())) == want and len(rows) == len(want)
    for _, g in rows.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert g["offset"].tolist() == [0, *np.cumsum(g["length"])[:-1]] and g["length"].sum() <= 2048
    assert rows["sequence_id"].nunique() == len(plain_best_fit(rows["length"].tolist(), 2048))


def test_packing_nulls_ties_and_clashing_columns(spark, make_docs):
    docs = make_docs([(1, None), (None, "a b"), (2, "tie"), (2, "tie"), (3, "w " * 5000)])
    rows = packed(docs, with_ids=True).toPandas()
    assert (rows[rows.doc_id == 1].length == 1).all() and len(rows[rows.doc_id == 2]) == 2
    assert all(len(b) == 4 * n for b, n in zip(rows.ids, rows.length)) and not rows.duplicated(["sequence_id", "offset"]).any()
    assert packed(make_docs([])).collect() == []
