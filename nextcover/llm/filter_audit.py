"""Interaction of filters, from decision diagrams of their failures.

Every document gets a mask of the filters it fails. Per part (a source) the documents are counted
by mask, and the counts make a *decision diagram*: a node asks for one filter, its low branch goes
on with the documents that pass and its high branch with those that fail, and a node carries the
counts of all documents below it. Branches that hold nothing are left out, equal nodes are one.
Applying the filters in the diagram's order is the walk along its low branches: the node's counts
are what is there, the high branch's what the filter removes. Another order is another order of
the levels, reached by swapping two that adjoin; a swap rewrites the nodes of these two levels
alone, and 119 swaps visit all 120 orders of five filters.

The filters are those of :data:`FILTERS`. A word is a maximal run of bytes that are no space, tab
or line end; words are compared by 64-bit hashes, whole texts by SHA-256.

Tasks read whole texts once and hand on a mask and a digest. Copies are counted per (text, part)
before any text's documents meet, with the smallest doc_id of each, so a text that a third of all
rows share is one row per part. A part has at most 32 masks, whatever the number of documents.

Nulls: a null text is empty, a null source is the part ``''``; a null doc_id has no smaller one and
is not smaller than any, so its row never fails E and makes no other row fail. Rows of one doc_id
are counted each. A document is good or toxic if any of its label rows says so. An empty table
gives no row; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from nextcover.llm.common import raw_bytes, slices, span_hashes, stored

#: A few words, B few different words, C many capitals, D markup signs, E copy of a smaller doc_id's text
FILTERS = "ABCDE"
LEAST_WORDS = 200
LEAST_DISTINCT_PERCENT = 50
MOST_CAPITALS_PERCENT = 2
COPY = 1 << FILTERS.index("E")

IN_WORD = np.ones(256, bool)
IN_WORD[[0x20, *range(0x09, 0x0E)]] = False
CAPITAL = np.zeros(256, bool)
CAPITAL[65:91] = True
SIGN = np.zeros(256, bool)
SIGN[list(b"#$%&*|")] = True
LEADING = np.ones(256, bool)  # bytes that begin a code point
LEADING[0x80:0xC0] = False

Counts = tuple[int, int, int]


def _per_row(hits: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return np.diff(np.searchsorted(np.flatnonzero(hits), offsets))


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every word; a word ends with its row."""
    inside = IN_WORD[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    cuts = offsets[:-1][offsets[:-1] < len(data)]
    first[cuts] = inside[cuts]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    ends = offsets[1:][offsets[1:] > 0] - 1
    last[ends] = inside[ends]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(offsets, starts, "right") - 1


def failure_masks(texts: pa.Array) -> np.ndarray:
    """Filters A to D that each text fails, as bits."""
    data, offsets = raw_bytes(texts)
    n = len(texts)
    starts, ends, row = _words(data, offsets)
    words = np.bincount(row, minlength=n)
    if len(starts):
        h = span_hashes(data, starts, ends)
        order = np.lexsort((h, row))
        h, row = h[order], row[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
        distinct = np.bincount(row[new], minlength=n)
    else:
        distinct = words
    failures = (words < LEAST_WORDS,
                100 * distinct < LEAST_DISTINCT_PERCENT * words,
                100 * _per_row(CAPITAL[data], offsets) > MOST_CAPITALS_PERCENT * _per_row(LEADING[data], offsets),
                _per_row(SIGN[data], offsets) > 0)
    return sum(f.astype(np.int32) << i for i, f in enumerate(failures))


def judged(docs: DataFrame) -> DataFrame:
    """(doc_id, part, digest, mask) of every row, copies not judged yet."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi in slices(b["text"]):
                texts = b["text"].slice(lo, hi - lo)
                data, offsets = raw_bytes(texts)
                digests = [hashlib.sha256(data[x:y]).digest() for x, y in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
                yield pa.RecordBatch.from_arrays([b["doc_id"].slice(lo, hi - lo), b["part"].slice(lo, hi - lo), pa.array(digests, pa.binary()),
                                                  pa.array(failure_masks(texts), pa.int32())], ["doc_id", "part", "digest", "mask"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"),
                       F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(run, "doc_id long, part string, digest binary, mask int")


def mask_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): documents by part and the filters they fail."""
    known = stored(labels.groupBy(F.col("doc_id").cast("long").alias("doc_id"))
             .agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
             .where(F.col("doc_id").isNotNull()))
    # both sides are tables of their own, so that the join can split a key with many rows
    rows = stored(judged(docs).groupBy("doc_id", "part", "digest", "mask").agg(F.count("*").alias("n")))
    rows = rows.join(known, "doc_id", "left")
    sums = [F.sum("n").alias("n"), F.sum(F.col("n") * F.coalesce("good", F.lit(0))).alias("good"),
            F.sum(F.col("n") * F.coalesce("toxic", F.lit(0))).alias("toxic")]
    ids = (rows.groupBy("digest", "part", "mask", "doc_id").agg(*sums)
           .groupBy("digest", "part", "mask")
           .agg(*(F.sum(c).alias(c) for c in ("n", "good", "toxic")),
                F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n", "good", "toxic"))).alias("first"),
                *(F.sum(F.when(F.col("doc_id").isNull(), F.col(c)).otherwise(0)).alias(f"{c}_nameless") for c in ("n", "good", "toxic"))))
    smallest = F.min("first.doc_id").over(Window.partitionBy("digest"))
    own = F.coalesce(F.col("first.doc_id") == F.col("smallest"), F.lit(False))

    def passes(c: str):
        return F.col(f"{c}_nameless") + F.when(own, F.col(f"first.{c}")).otherwise(0)

    split = ids.withColumn("smallest", smallest).select("part", F.explode(F.array(
        F.struct("mask", *(passes(c).alias(c) for c in ("n", "good", "toxic"))),
        F.struct(F.col("mask").bitwiseOR(F.lit(COPY)).alias("mask"), *((F.col(c) - passes(c)).alias(c) for c in ("n", "good", "toxic"))))).alias("x"))
    return (split.select("part", "x.*").where("n > 0").groupBy("part", "mask")
            .agg(*(F.sum(c).alias(c) for c in ("n", "good", "toxic"))))


class Diagram:
    """Count-weighted decision diagram of failure masks. Node 0 holds nothing, a leaf has no
    variable; a node whose high branch would hold nothing is its low branch."""

    def __init__(self, counts: dict[int, Counts], variables: int):
        self.order = list(range(variables))
        self.nodes: list[tuple[int | None, int, int]] = [(None, 0, 0)]
        self.weights: list[Counts] = [(0, 0, 0)]
        self.known: dict[tuple, int] = {(None, (0, 0, 0)): 0}
        self.root = self._built({m: c for m, c in counts.items() if any(c)}, 0)

    def _leaf(self, counts: Counts) -> int:
        key = (None, counts)
        if key not in self.known:
            self.known[key] = len(self.nodes)
            self.nodes.append((None, 0, 0))
            self.weights.append(counts)
        return self.known[key]

    def _node(self, variable: int, low: int, high: int) -> int:
        if high == 0:
            return low
        key = (variable, low, high)
        if key not in self.known:
            self.known[key] = len(self.nodes)
            self.nodes.append(key)
            self.weights.append(tuple(a + b for a, b in zip(self.weights[low], self.weights[high])))
        return self.known[key]

    def _built(self, counts: dict[int, Counts], depth: int) -> int:
        if not counts:
            return 0
        if depth == len(self.order):
            return self._leaf(counts[next(iter(counts))])
        bit = 1 << self.order[depth]
        low = self._built({m: c for m, c in counts.items() if not m & bit}, depth + 1)
        return self._node(self.order[depth], low, self._built({m: c for m, c in counts.items() if m & bit}, depth + 1))

    def branches(self, node: int, variable: int) -> tuple[int, int]:
        asked, low, high = self.nodes[node]
        return (low, high) if asked == variable else (node, 0)

    def swap(self, level: int) -> None:
        """Exchange two adjoining levels. A node of the upper one that leads to the lower one is
        rewritten in place, so the nodes above it stay as they are."""
        upper, lower = self.order[level], self.order[level + 1]
        for node, (asked, low, high) in enumerate(self.nodes[:]):
            if asked != upper or lower not in (self.nodes[low][0], self.nodes[high][0]):
                continue
            (low_low, low_high), (high_low, high_high) = self.branches(low, lower), self.branches(high, lower)
            del self.known[asked, low, high]
            self.nodes[node] = new = (lower, self._node(upper, low_low, high_low), self._node(upper, low_high, high_high))
            self.known[new] = node
        self.order[level:level + 2] = lower, upper

    def steps(self) -> Iterator[tuple[int, Counts, Counts]]:
        """Along the low branches: the filter, what it keeps and what it removes."""
        node = self.root
        for variable in self.order:
            node, removed = self.branches(node, variable)
            yield variable, self.weights[node], self.weights[removed]

    def only(self, variable: int) -> Counts:
        """Counts of the documents that fail this filter and no other."""
        node = self.root
        for v in self.order:
            node = self.branches(node, v)[v == variable]
        return self.weights[node]


def adjacent_swaps(n: int) -> Iterator[int]:
    """Levels to swap so that all orders of n are visited, each once: the last one walks through
    each order of the others, up and down in turn."""
    if n < 2:
        return
    up = list(range(n - 1))
    inner, forward = adjacent_swaps(n - 1), False
    while True:
        yield from up if forward else reversed(up)
        level = next(inner, None)
        if level is None:
            return
        yield level if forward else level + 1
        forward = not forward


def audit_rows(counts: dict[int, Counts], names: str = FILTERS) -> list[tuple]:
    """(order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) for
    every order of the filters."""
    n = len(names)
    diagram = Diagram(counts, n)
    fails = [sum(c[0] for m, c in counts.items() if m >> v & 1) for v in range(n)]
    alone = [diagram.only(v)[0] for v in range(n)]
    rows, shapley = [], [0] * n

    def visit() -> None:
        order = "".join(names[v] for v in diagram.order)
        for step, (v, kept, removed) in enumerate(diagram.steps(), 1):
            shapley[v] += removed[0]
            rows.append((order, step, kept[0], removed[0], fails[v] - removed[0], alone[v], removed[1], removed[2], v))

    visit()
    for level in adjacent_swaps(n):
        diagram.swap(level)
        visit()
    return [(*row[:-1], shapley[row[-1]]) for row in rows]


COLUMNS = [("part", pa.string()), ("filter_order", pa.string()), ("step", pa.int32()), *((c, pa.int64()) for c in (
    "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"))]


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, order of the filters and step."""
    per_part = mask_counts(docs, labels).groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("masks"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for x in b.to_pylist():
                rows = audit_rows({m["mask"]: (m["n"], m["good"], m["toxic"]) for m in x["masks"]})
                columns = [[x["part"]] * len(rows), *zip(*rows)]
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, (_, kind) in zip(columns, COLUMNS)], [name for name, _ in COLUMNS])

    kinds = {pa.string(): "string", pa.int32(): "int", pa.int64(): "long"}
    return per_part.mapInArrow(run, ", ".join(f"{name} {kinds[kind]}" for name, kind in COLUMNS))
