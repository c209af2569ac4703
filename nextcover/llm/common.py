"""What the operators share: intermediate tables in the shared folder, slices of Arrow batches
that fit in memory, and words and shingles of many texts at once.

A word is a maximal run of letters and digits of the lower-cased text; every character beyond
ASCII counts as a letter. A null text is an empty one.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
#: bytes of text worked on at once; a longer text is a slice of its own
SLICE_BYTES = 1 << 19
BASE = U64(0x9E3779B97F4A7C15 | 1)
STEP = U64(0xC2B2AE3D27D4EB4F | 1)


@cache
def _own_folder() -> str:
    return "file://" + tempfile.mkdtemp(prefix="llm-")


def shared_folder(spark: SparkSession) -> str:
    """A new folder name below ``spark.checkpoint.dir``; a local session without that setting gets
    a temporary folder, a cluster must name one that all executors share."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
        root = _own_folder()
    return f"{root.rstrip('/')}/{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """Write a table to the shared folder and read it again: its lineage is cut, and a lost
    executor takes nothing of it along."""
    path = shared_folder(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of bounded size, so that a worker's memory doesn't follow the rows' width."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "500")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))


def texts_of(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id and text (null: empty) alone, whatever other columns the table has."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *more)


def packed_texts(docs: DataFrame) -> DataFrame:
    """Texts as Zstandard frames (column ``packed``), for a shuffle of a table's whole texts."""
    names = [c for c in docs.columns if c != "text"]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(3)
        for b in batches:
            texts = b["text"].cast(pa.binary())
            yield pa.RecordBatch.from_arrays([*(b[n] for n in names), pa.array([press.compress(t.as_buffer()) for t in texts], pa.binary())], [*names, "packed"])

    kinds = dict(docs.dtypes)
    return docs.mapInArrow(pack, ", ".join(f"{n} {kinds[n]}" for n in names) + ", packed binary")


def unpacked(column: pa.Array) -> Iterator[tuple[int, int, pa.Array]]:
    """Row ranges and their texts, about ``SLICE_BYTES`` at once."""
    press, lo, total, held = zstandard.ZstdDecompressor(), 0, 0, []
    for i, x in enumerate(column):
        held.append(press.decompress(x.as_buffer()))
        total += len(held[-1])
        if total >= SLICE_BYTES:
            yield lo, i + 1, pa.array(held, pa.binary()).cast(pa.string())
            lo, total, held = i + 1, 0, []
    if held:
        yield lo, len(column), pa.array(held, pa.binary()).cast(pa.string())


def slices(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``most`` bytes of text."""
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    lo = total = 0
    for i, n in enumerate(sizes):
        if i > lo and total + n > most:
            yield lo, i
            lo, total = i, 0
        total += int(n)
    if lo < len(sizes):
        yield lo, len(sizes)


def raw_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all rows behind one another, and where each row starts (with the end)."""
    column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) else "")
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def _same_length_lower(text: str) -> str:
    return "".join(low if len((low := c.lower()).encode()) == len(c.encode()) else c for c in text)


def lowered(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes, row starts and the original bytes; positions agree. A letter whose
    lower case takes another number of bytes stays as it is."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    low = pc.utf8_lower(column)
    odd = pc.not_equal(pc.binary_length(low), pc.binary_length(column))
    if pc.any(odd).as_py():
        low = pa.array([_same_length_lower(t) if o else x for t, x, o in
                        zip(column.to_pylist(), low.to_pylist(), odd.to_pylist())], pa.large_string())
    data, offsets = raw_bytes(low)
    return data, offsets, raw_bytes(column)[0]


IN_WORD = np.zeros(256, bool)
IN_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True

_powers: dict[int, np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base**0 … base**(n-1) modulo 2**64."""
    have = _powers.get(int(base))
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 16), base, U64)
        have[0] = 1
        _powers[int(base)] = have = np.multiply.accumulate(have)
    return have[:n]


BASE_INVERSE = U64(pow(int(BASE), -1, 1 << 64))


def mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> U64(32))
    h = h * U64(0xD6E8FEB86659FD93)
    h ^= h >> U64(32)
    h *= U64(0xD6E8FEB86659FD93)
    h ^= h >> U64(32)
    return h


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte ranges, equal for equal bytes wherever they stand."""
    total = np.zeros(len(data) + 1, U64)
    np.cumsum((data.astype(U64) + U64(1)) * powers(BASE, len(data)), out=total[1:])
    return mixed((total[ends] - total[starts]) * powers(BASE_INVERSE, len(data) + 1)[starts] + (ends - starts).astype(U64))


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every word."""
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = IN_WORD[data]
    begins = inside[1:] & ~inside[:-1]
    stops = inside[:-1] & ~inside[1:]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    joined = cuts[inside[cuts] & inside[cuts + 1]]  # a word that would run on into the next row
    begins[joined] = True
    stops[joined] = True
    starts, ends = np.flatnonzero(begins), np.flatnonzero(stops)
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def shingles(words: np.ndarray, row: np.ndarray, rows: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all runs of ``k`` words, the row of each, and its first word. A row of fewer
    words (one at least) has one shingle of all its words."""
    n = len(words)
    counts = np.bincount(row, minlength=rows) if n else np.zeros(rows, np.int64)
    first = np.zeros(rows + 1, np.int64)
    np.cumsum(counts, out=first[1:])
    if n >= k:
        full = np.flatnonzero(row[:n - k + 1] == row[k - 1:])
        h = np.zeros(len(full), U64)
        for j in range(k):
            h = h * STEP + words[full + j]
    else:
        full, h = np.empty(0, np.int64), np.empty(0, U64)
    short = np.flatnonzero((counts > 0) & (counts < k))
    if len(short):
        extra = np.zeros(len(short), U64)
        for j in range(k - 1):
            there = counts[short] > j
            extra[there] = extra[there] * STEP + words[first[short][there] + j]
        at = np.concatenate([full, first[short]])
        h = np.concatenate([h, extra + counts[short].astype(U64) * U64(0xA24BAED4963EE407)])
        order = np.argsort(at, kind="stable")
        full, h = at[order], h[order]
    return mixed(h), row[full] if n else np.empty(0, np.int64), full


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of the connected components of edges (a, b), by contraction: every node
    takes the smallest name around it, edges are renamed, and this is repeated on what is left.
    Each round is written to the shared folder. With names in no order along a path, such as hashes,
    a round leaves a fraction of the nodes; a path in the order of its names takes as many rounds as
    it has nodes, so name nodes by hashes."""
    left = stored(edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    found = stored(left.select(F.col("a").alias("node")).union(left.select("b")).distinct().withColumn("root", F.col("node")))
    while not left.isEmpty():
        near = stored(left.select("a", "b").union(left.select(F.col("b"), F.col("a"))).groupBy("a").agg(F.min("b").alias("b"))
                      .select(F.col("a").alias("node"), F.least("a", "b").alias("to")))
        found = stored(found.join(near, found["root"] == near["node"], "left")
                       .select(found["node"], F.coalesce("to", "root").alias("root")))
        x, y = near.select(F.col("node").alias("a"), F.col("to").alias("a2")), near.select(F.col("node").alias("b"), F.col("to").alias("b2"))
        left = stored(left.join(x, "a").join(y, "b").where("a2 != b2")
                      .select(F.greatest("a2", "b2").alias("a"), F.least("a2", "b2").alias("b")).distinct())
    return found
