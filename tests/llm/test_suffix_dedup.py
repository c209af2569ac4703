"""Repeats against a table of all strings of the length."""

import hashlib
import random
import re
from collections import defaultdict

import pytest

from llm_support import SF_DIR, make_docs, worker_path  # noqa: F401 - fixtures
from nextcover.llm.queries import QUERIES
from nextcover.llm.suffix_dedup import deduplicated, keyed, maximal_repeats, repeat_groups, without_repeats


def brute(rows, length):
    seen = defaultdict(int)
    texts = [(i, (t or "").encode()) for i, t in rows]
    for _, t in texts:
        for a in range(len(t) - length + 1):
            seen[t[a:a + length]] += 1
    out = []
    for i, t in texts:
        gone = bytearray(len(t))
        for a in range(len(t) - length + 1):
            if seen[t[a:a + length]] > 1:
                gone[a:a + length] = b"\1" * length
        kept = bytes(c for c, g in zip(t, gone) if not g)
        spans = sum(g and not (a and gone[a - 1]) for a, g in enumerate(gone))
        out.append((i, len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def collected(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_op2_equals_brute_force(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()]
    assert collected(QUERIES["op2_suffix_array_dedup"](spark, SF_DIR)) == brute(rows, 400)


def mixed_rows(seed):
    r = random.Random(seed)
    parts = ["".join(r.choices("abé", k=r.randint(5, 60))) for _ in range(12)]
    rows = [(i, "".join(r.choices(parts, k=r.randint(0, 12))) + "".join(r.choices("xyz", k=r.randint(0, 40)))) for i in range(40)]
    return rows + [(1, None), (1, "tie" * 40), (1, "tie" * 40), (None, "a" * 500), (None, None), (50, ""), (51, parts[0] * 40)]


@pytest.mark.parametrize("seed,bucket", [(1, 2000), (2, 3), (3, 1)])
def test_random_texts_nulls_ties_and_full_buckets(spark, make_docs, seed, bucket):
    rows = mixed_rows(seed)
    assert collected(deduplicated(make_docs(rows), 50, bucket)) == brute(rows, 50)


def test_groups_hold_all_occurrences(spark, make_docs):
    rows = [(i, t) for i, t in mixed_rows(4) if i is not None and (i, t) != (1, None)]
    texts = defaultdict(list)
    for i, t in rows:
        texts[i].append((t or "").encode())
    groups = defaultdict(set)
    for g, i, a, b in collected(repeat_groups(make_docs(rows), 50)):
        groups[g].add((i, a, b))
    strings = {g: {next(t for t in texts[i] if len(t) >= b)[a:b] for i, a, b in m} for g, m in groups.items() if all(len(texts[i]) == 1 for i, _, _ in m)}
    assert strings and all(len(s) == 1 for s in strings.values())
    covered = defaultdict(set)
    for m in groups.values():
        for i, a, b in m:
            covered[i].update(range(a, b))
    for i, _, gone, _, _ in brute(rows, 50):
        if len(texts[i]) == 1:
            assert len(covered[i]) == gone


def test_maximal_repeats_are_diverse_at_both_ends():
    lefts = [b"cba", b"cbx", b"qqq"]  # backwards
    rights = [b"12345", b"12345", b"12999"]
    got = sorted((a, b, sorted(m)) for a, b, m in maximal_repeats(lefts, rights, 2))
    assert got == [(0, 2, [0, 1, 2]), (2, 5, [0, 1])]


def test_empty_table_and_whole_letters(spark, make_docs):
    assert deduplicated(make_docs([])).collect() == []
    rows = [(1, "é" * 300 + "x"), (2, "yé" + "é" * 299)]
    _, removed = without_repeats(make_docs(rows), 401, whole_letters=True)
    assert all(bytes(r["kept"]).decode() is not None for r in removed.collect())


def without_shared_words(rows, length):
    """Texts without each run of ``length`` words that starts at two places or more."""
    seen, out = defaultdict(int), []
    found = [(i, t or "", [m.span() for m in re.finditer("[^\x20\x09-\x0D]+", t or "")]) for i, t in rows]
    for _, t, spans in found:
        for a in range(len(spans) - length + 1):
            seen[tuple(t[x:y] for x, y in spans[a:a + length])] += 1
    for i, t, spans in found:
        gone = [False] * len(spans)
        for a in range(len(spans) - length + 1):
            if seen[tuple(t[x:y] for x, y in spans[a:a + length])] > 1:
                gone[a:a + length] = [True] * length
        kept, at = "", 0
        for a in range(len(spans)):
            if gone[a] and (a == 0 or not gone[a - 1]):
                kept += t[at:spans[a][0]]
            if gone[a]:
                at = spans[a][1]
        out.append((i, kept + t[at:]) if any(gone) else (i, t))
    return sorted(out, key=repr)


@pytest.mark.parametrize("seed,bucket", [(1, 2000), (2, 3), (3, 1)])
def test_runs_of_words_equal_brute_force(spark, make_docs, seed, bucket):
    r = random.Random(seed)
    parts = [[r.choice(["a", "Ré", "b.", "c"]) for _ in range(r.randint(1, 14))] for _ in range(10)]
    text = lambda: "".join(w + r.choice([" ", " ", "  ", "\n", "\t "]) for _ in range(r.randint(0, 9)) for w in r.choice(parts)) + "x" * r.randint(0, 3)
    rows = [(i, text()) for i in range(50)] + [(1, None), (90, ""), (91, " \n "), (92, "tie " * 30), (92, "tie " * 30), (None, "u v w x y z " * 3), (93, "long" * 5000)]
    all_rows, removed = without_repeats(make_docs(rows), 10, bucket, words=True)
    kept = {x["row_key"]: bytes(x["kept"]).decode() for x in removed.collect()}
    keyed_rows = {x["row_key"]: x for x in keyed(make_docs(rows)).collect()}
    got = sorted(((keyed_rows[x["row_key"]]["doc_id"], kept.get(x["row_key"], keyed_rows[x["row_key"]]["text"])) for x in all_rows.collect()), key=repr)
    assert got == without_shared_words(rows, 10) and kept


def test_a_passage_on_copied_pages_is_one_group_with_all_its_places(spark, make_docs):
    r = random.Random(5)
    word = lambda: f"w{r.randint(0, 99999)}"
    passage = " ".join(word() for _ in range(70))[:450]
    pages = [" ".join(word() for _ in range(200)) + " " + passage + " " + " ".join(word() for _ in range(200)) for _ in range(2)]
    docs = [(1, pages[0]), (2, pages[0]), (3, pages[1]), (4, pages[1])]
    groups = defaultdict(set)
    for g, i, a, b in collected(repeat_groups(make_docs(docs), 400)):
        groups[g].add((i, a, b))
    text = dict(docs)
    want = {(i, text[i].index(passage), text[i].index(passage) + len(passage)) for i in text}
    assert any(len(m) == 4 and {i for i, _, _ in m} == {1, 2, 3, 4} and all(b - a >= 400 and (i, a0, b0) in want for i, a, b in m for (j, a0, b0) in want if j == i and a0 - 2 <= a and b <= b0 + 2)
               for m in groups.values())
    for m in groups.values():
        assert len({text[i][a:b] for i, a, b in m}) == 1
