"""How far the sources of a language diverge in their use of terms.

A term is a maximal run of letters (A-Z, a-z and every code point from U+0080 on), A-Z in lower
case. A language keeps the terms of at least ``LEAST_DOCS`` of its documents. Every (lang, source)
group, and every language, gives a kept term with ``n`` occurrences the smoothed share
``p = 1 + floor(SCALE * (n + SMOOTHING) / (N + SMOOTHING * V))``, with ``N`` all its occurrences
of kept terms and ``V`` the language's kept terms. Part ``pair`` sums the differences of two
sources' shares over all kept terms; part ``term`` lists the terms a source uses most beyond its
language. Shares and sums are integers.

Counting is a sort of pointers. The texts of a slice lie behind one another in an Arrow buffer, by
group; a pointer stands at the start of every term, and :func:`sorted_pointers` sorts pointers by
the bytes they point at: multikey quicksort with eight bytes as one key, three-way partitions, the
equal part going on eight bytes further. Equal terms end up as runs, pointers of a run in the order
of the texts, so a run yields the documents and occurrences of its term per group in one scan. Only
these counts leave a task, and Spark adds them up before the shuffle.

Differences are summed in cells: the terms of a language in blocks by hash, its sources in blocks
of about ``SOURCES`` by hash, a cell for each term block and pair of source blocks. A cell has the
shares of its sources as a matrix, absent terms included, and emits a sum for each pair of sources,
so no pair of rows is ever made per term and nothing grows with a group.

Memory: a slice is about ``SLICE`` bytes; a longer text is cut between terms, its counts added up,
so it takes the memory of a slice and of its own terms. A cell has about ``CELL_ROWS`` rows.

Nulls: null text, lang and source are ''. Every row is a document; repeated rows count again.
Groups without terms take part with their smoothed shares; with no kept term, values are 0. A lone
source has no pairs. An empty table gives no row; other columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from nextcover.llm.common import raw_bytes, stored

LEAST_DOCS = 30
TOP_TERMS = 50
SCALE = 1_000_000_000
SMOOTHING = 5
SLICE = 8 << 20
SOURCES = 256
CELL_ROWS = 1 << 16
#: slices of pointers up to this length are finished by whole-array sorts
SMALL = 1 << 13
MATRIX = 1 << 21

IN_TERM = np.ones(256, bool)
IN_TERM[[*range(0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def term_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every term; a term ends with its row."""
    inside = IN_TERM[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    begins, ends = offsets[:-1][offsets[:-1] < len(data)], offsets[1:][offsets[1:] > 0] - 1
    first[begins], last[ends] = inside[begins], inside[ends]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(offsets, starts, "right") - 1


class _Keys:
    """Eight bytes of a term from a depth on, as a number that sorts like them; what is behind
    the term counts as zero, which no term holds."""

    def __init__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray):
        padded = np.concatenate([data, np.zeros(8, np.uint8)])
        self.windows = np.lib.stride_tricks.sliding_window_view(padded, 8)
        self.starts, self.ends = starts, ends

    def at(self, pointers: np.ndarray, depth: int) -> np.ndarray:
        start = self.starts[pointers] + 8 * depth
        left = np.clip(self.ends[pointers] - start, 0, 8)
        key = self.windows[np.minimum(start, len(self.windows) - 1)].view(">u8").ravel().astype(np.uint64)
        beyond = (8 * (8 - left)).astype(np.uint64)
        key = np.where(left > 0, key >> np.minimum(beyond, np.uint64(63)), np.uint64(0))
        return key << np.minimum(beyond, np.uint64(63))


def _goes_on(key: np.ndarray) -> np.ndarray:
    return (key & np.uint64(0xFF)) != 0


def _pivot(key: np.ndarray) -> np.uint64:
    return np.sort(key[np.linspace(0, len(key) - 1, 9).astype(np.int64)])[4]


def _finished(keys: _Keys, pointers: np.ndarray, key: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """A small slice sorted, and where its runs of equal terms begin."""
    order = np.argsort(key, kind="stable")
    pointers, key = pointers[order], key[order]
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    # runs that end within these eight bytes are done; the others go on together, run by run
    open_ = np.flatnonzero(_goes_on(key))
    while len(open_):
        depth += 1
        run = np.cumsum(new)[open_]
        deeper = keys.at(pointers[open_], depth)
        order = np.lexsort((deeper, run))
        pointers[open_], deeper = pointers[open_][order], deeper[order]
        new[open_[1:]] |= (deeper[1:] != deeper[:-1]) & (run[1:] == run[:-1])
        open_ = open_[_goes_on(deeper)]
    return pointers, new


def sorted_pointers(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The terms' numbers in the order of their bytes, equal terms in their old order, and for
    each whether it begins a run of equal terms."""
    keys = _Keys(data, starts, ends)
    pointers = np.arange(len(starts))
    new = np.zeros(len(starts), bool)
    todo = [(0, len(starts), 0, keys.at(pointers, 0))] if len(starts) else []
    while todo:
        lo, hi, depth, key = todo.pop()
        if hi - lo <= SMALL:
            pointers[lo:hi], new[lo:hi] = _finished(keys, pointers[lo:hi], key, depth)
            continue
        pivot, part = _pivot(key), pointers[lo:hi]
        less, more = key < pivot, key > pivot
        same = ~(less | more)
        low, high = lo + int(less.sum()), hi - int(more.sum())
        pointers[lo:hi] = np.concatenate([part[less], part[same], part[more]])
        if low > lo:
            todo.append((lo, low, depth, key[less]))
        if hi > high:
            todo.append((high, hi, depth, key[more]))
        if int(pivot) & 0xFF:
            todo.append((low, high, depth + 1, keys.at(pointers[low:high], depth + 1)))
        else:
            new[low] = True
    return pointers, new


def _terms(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The terms as an Arrow array, their bytes copied at once."""
    lengths = ends - starts
    offsets = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(lengths, out=offsets[1:])
    places = np.arange(offsets[-1]) + np.repeat(starts - offsets[:-1], lengths)
    return pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(data[places]))


def slice_counts(texts: pa.Array, group: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Term, group, documents and occurrences of every term of every group; rows come by group."""
    data, offsets = raw_bytes(texts)
    data = LOWER[data]
    starts, ends, row = term_spans(data, offsets)
    pointers, new = sorted_pointers(data, starts, ends)
    row = row[pointers]
    owner = group[row]
    run = np.cumsum(new) - 1
    # within a run rows rise, and groups with them
    another_doc = new.copy()
    another_doc[1:] |= row[1:] != row[:-1]
    another = new.copy()
    another[1:] |= owner[1:] != owner[:-1]
    firsts = np.flatnonzero(another)
    n = np.diff(np.append(firsts, len(row)))
    docs = np.add.reduceat(another_doc.astype(np.int64), firsts) if len(firsts) else n
    heads = pointers[np.flatnonzero(new)]
    return _terms(data, starts[heads], ends[heads]).take(pa.array(run[firsts])), owner[firsts], docs, n


def _pieces(text: bytes, most: int) -> Iterator[bytes]:
    """A long text cut behind bytes that belong to no term."""
    lo = 0
    while len(text) - lo > most:
        inside = IN_TERM[np.frombuffer(text, np.uint8, count=most, offset=lo)]
        cut = most - int(np.argmin(inside[::-1])) if not inside.all() else 0
        if not cut:  # one term as long as a slice: to its end
            rest = np.flatnonzero(~IN_TERM[np.frombuffer(text, np.uint8, offset=lo)])
            cut = int(rest[0]) + 1 if len(rest) else len(text) - lo
        yield text[lo:lo + cut]
        lo += cut
    yield text[lo:]


def term_counts(docs: DataFrame, most: int = SLICE) -> DataFrame:
    """(lang, source, term, docs, n): documents that hold a term, and its occurrences, per group."""
    names = ["lang", "source", "term", "docs", "n"]

    def batch(lang: pa.Array, source: pa.Array, term: pa.Array, docs_: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([lang, source, term.cast(pa.string()), pa.array(docs_, pa.int64()), pa.array(n, pa.int64())], names)

    def of_slice(table: pa.Table) -> Iterator[pa.RecordBatch]:
        order = pc.sort_indices(table, [("lang", "ascending"), ("source", "ascending")])
        table = table.take(order)
        lang, source = (table[c].combine_chunks() for c in ("lang", "source"))
        group = np.zeros(len(table), np.int64)
        for c in (lang, source):
            group[1:] |= pc.not_equal(c[1:], c[:-1]).to_numpy(zero_copy_only=False)
        firsts = np.concatenate([[0], np.flatnonzero(group)])
        term, owner, docs_, n = slice_counts(table["text"].combine_chunks(), np.cumsum(group))
        for lo in range(0, len(term), 1 << 16):
            hi = lo + (1 << 16)
            at = pa.array(firsts[owner[lo:hi]])
            yield batch(lang.take(at), source.take(at), term.slice(lo, 1 << 16), docs_[lo:hi], n[lo:hi])

    def of_long_text(lang: str, source: str, text: bytes) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()
        for piece in _pieces(text, most):
            term, _, _, n = slice_counts(pa.array([piece], pa.binary()), np.zeros(1, np.int64))
            counts.update(dict(zip(term.to_pylist(), n.tolist())))
        if counts:
            one = pa.repeat(pa.scalar(lang), len(counts)), pa.repeat(pa.scalar(source), len(counts))
            yield batch(*one, pa.array(list(counts), pa.string()), np.ones(len(counts), np.int64), np.array(list(counts.values())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            long = pc.greater(pc.binary_length(b["text"]), most)
            for x in b.filter(long).to_pylist():
                yield from of_long_text(x["lang"], x["source"], x["text"].encode())
            held.append(b.filter(pc.invert(long)))
            size += pc.sum(pc.binary_length(held[-1]["text"])).as_py() or 0
            if size >= most:
                yield from of_slice(pa.Table.from_batches(held))
                held, size = [], 0
        if held and sum(len(x) for x in held):
            yield from of_slice(pa.Table.from_batches(held))

    rows = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    return (rows.mapInArrow(run, "lang string, source string, term string, docs long, n long")
            .groupBy("lang", "source", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n")))


def share(n: Column | str, total: Column | str, kept: Column | str) -> Column:
    """The smoothed share of ``n`` of ``total`` occurrences, in whole numbers of any size."""
    n, total, kept = (F.col(c) if isinstance(c, str) else c for c in (n, total, kept))
    above = F.lit(SCALE).cast("decimal(10,0)") * (n + SMOOTHING).cast("decimal(19,0)")
    below = total.cast("decimal(19,0)") + F.lit(SMOOTHING).cast("decimal(2,0)") * kept.cast("decimal(12,0)")
    return F.call_function("div", above, F.when(below > 0, below)) + 1


def cell_sums(key: tuple, rows: pd.DataFrame, sources: pd.DataFrame) -> pd.DataFrame:
    """Sums of differences over a cell's terms for each pair of its sources, both ways."""
    lang, left, right, _ = key
    sources = sources.sort_values(["block", "source"])
    names, least = sources["source"].to_numpy(), sources["least"].to_numpy(np.int64)
    block = sources["block"].to_numpy()
    a, b = np.flatnonzero(block == left), np.flatnonzero(block == right)
    term, found = pd.factorize(rows["term"])
    column = pd.Index(names).get_indexer(rows["source"])
    p = rows["p"].to_numpy(np.int64)
    order = np.argsort(term, kind="stable")
    term, column, p = term[order], column[order], p[order]
    absent = int(sources["n_terms"].iloc[0]) - len(found)
    sums = absent * np.abs(least[a][:, None] - least[b][None, :])
    step = max(MATRIX // max(len(names), 1), 1)
    for lo in range(0, len(found), step):
        rows_ = slice(*np.searchsorted(term, [lo, lo + step]))
        matrix = np.repeat(least[None, :], min(step, len(found) - lo), axis=0)
        matrix[term[rows_] - lo, column[rows_]] = p[rows_]
        for i, x in enumerate(a):
            sums[i] += np.abs(matrix[:, [x]] - matrix[:, b]).sum(axis=0)
    x, y = np.meshgrid(a, b, indexing="ij")
    once = x < y if left == right else np.ones_like(x, bool)
    x, y, value = x[once], y[once], sums[once]
    return pd.DataFrame({"lang": lang, "source": names[np.concatenate([x, y])], "item": names[np.concatenate([y, x])],
                         "value": np.concatenate([value, value])})


def divergence(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP_TERMS,
               sources: int = SOURCES, cell_rows: int = CELL_ROWS) -> DataFrame:
    """(lang, source, part, item, value, rank)."""
    counts = stored(term_counts(docs))
    kept = stored(counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n_lang"))
                  .where(F.col("docs") >= least_docs).select("lang", "term", "n_lang"))
    own = stored(counts.select("lang", "source", "term", "n").join(kept, ["lang", "term"]))

    groups = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source"))).distinct()
    langs = (groups.groupBy("lang").agg(F.count("*").alias("n_sources"))
             .join(kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("n_lang").alias("total_lang")), "lang", "left")
             .join(own.groupBy("lang").agg(F.count("*").alias("n_rows")), "lang", "left")
             .na.fill(0))
    blocks = F.ceil(F.col("n_sources") / sources)
    cells = F.greatest(F.ceil(F.col("n_rows") * F.least(F.lit(2), F.col("source_blocks")) / F.col("source_blocks") / cell_rows), F.lit(1))
    # a table of a row per language, so that Spark knows its size when the terms are joined to it
    langs = stored(langs.withColumn("source_blocks", blocks).withColumn("cells", cells))
    totals = own.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = stored(groups.join(totals, ["lang", "source"], "left").na.fill(0, ["total"]).join(langs, "lang")
                    .withColumn("block", F.pmod(F.xxhash64("source"), "source_blocks"))
                    .withColumn("least", F.coalesce(share(F.lit(0), "total", "v"), F.lit(0))))

    rows = stored(own.join(groups, ["lang", "source"])
                  .select("lang", "source", "term", share("n", "total", "v").alias("p"), share("n_lang", "total_lang", "v").alias("q"),
                          "block", "source_blocks", F.pmod(F.xxhash64("term"), "cells").alias("cell")))
    by_value = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    terms = (rows.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
             .withColumn("rank", F.row_number().over(by_value)).where(F.col("rank") <= top))

    def tiles(frame: DataFrame) -> DataFrame:
        """Each row in every pair of source blocks that holds its own."""
        return (frame.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("source_blocks") - 1)))
                .withColumn("left", F.least("block", "other")).withColumn("right", F.greatest("block", "other")))

    terms_of = kept.join(langs.select("lang", "cells"), "lang").groupBy("lang", F.pmod(F.xxhash64("term"), "cells").alias("cell")).agg(F.count("*").alias("n_terms"))
    headers = (tiles(groups.where("n_sources > 1")).withColumn("cell", F.explode(F.sequence(F.lit(0).cast("long"), F.col("cells") - 1)))
               .join(terms_of, ["lang", "cell"], "left").select("lang", "left", "right", "cell", "source", "block", "least", F.coalesce("n_terms", F.lit(0)).alias("n_terms")))
    key = ["lang", "left", "right", "cell"]
    sums = (tiles(rows).select(*key, "source", "term", "p").groupBy(*key).cogroup(headers.groupBy(*key))
            .applyInPandas(cell_sums, "lang string, source string, item string, value long"))
    pairs = (sums.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
             .select("lang", "source", F.lit("pair").alias("part"), "item", "value").withColumn("rank", F.row_number().over(by_value)))
    return pairs.unionByName(terms)
