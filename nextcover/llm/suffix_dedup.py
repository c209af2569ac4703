"""Repeated byte strings of whole texts, by common-prefix intervals of enhanced suffix arrays.

What counts are strings of at least ``length`` bytes that start at two places or more, in other
documents or the same one. Suffixes of every byte would be far too many, so a text's suffixes
are taken at anchors: the place of the smallest hash of ``GRAM`` bytes in every window of
``length`` bytes. Equal strings of ``length`` bytes have their anchor at the same place in them,
so two suffixes at anchors with equal bytes are found for every repeat. An anchor stands for the
windows that chose it: from ``before`` bytes to its left to ``after`` bytes to its right.

1. ``anchors``: for each anchor the hash of its gram (the bucket), a digest of the bytes its windows
   cover, and where it is. Anchors whose bucket has no other one are done with. Equal surroundings
   are one leaf with a count, added up before the shuffle; all that a leaf covers which counts two
   or more is repeated.
2. Buckets with a leaf that counts one and some other leaf get the leaves' bytes. In each, the
   leaves' right contexts are sorted (the suffix array), their common prefixes found (the LCP
   array), and a stack scan gives the common-prefix intervals. In each interval the left contexts
   are ordered the same way; an interval of both whose left and right ends are diverse and which
   is long enough is a maximal repeat, with all its occurrences.
3. Where a bucket has more than ``BUCKET`` different leaves, its windows themselves are counted, as
   digests of ``length`` bytes in one aggregation: intervals of that depth, without a task for the
   bucket.
4. Spans of a document are united; the most a task holds at once is one document.

A repeat longer than an anchor's surroundings is found in overlapping parts with the same union.

With ``words`` all of this works on a text's words (maximal runs without whitespace, told apart by
64-bit hashes) in place of its bytes: lengths and places count words, whitespace between them makes no
difference, and a run of removed words goes with the whitespace inside it. The text is never cut
within a word.
Nulls: a null text has no bytes. Rows are told apart by ``row_key``, a hash of doc_id (null too) and
text; rows alike in both are repeats of one another.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nextcover.llm.common import BASE, BASE_INVERSE, mixed, packed_texts, powers, raw_bytes, slices, small_batches, span_hashes, stored, texts_of, unpacked

LENGTH = 400
GRAM = 16
GRAM_WORDS = 3
BUCKET = 2000
U = np.uint64
SECOND = U(0x9FB21C651E98DF25 | 1)
SECOND_INVERSE = U(pow(int(SECOND), -1, 1 << 64))


SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True


def text_words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and end of every word of a text."""
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = ~SPACE[data]
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    return (span_hashes(data, starts, ends) if len(starts) else np.empty(0, U)), starts, ends


def units_of(text: bytes, words: bool) -> np.ndarray:
    data = np.frombuffer(text, np.uint8)
    return text_words(data)[0] if words else data


class Rolling:
    """Digests of ranges of one text's bytes or words."""

    def __init__(self, data: np.ndarray, base: np.uint64 = BASE, inverse: np.uint64 = BASE_INVERSE):
        self.total = np.zeros(len(data) + 1, U)
        np.cumsum((data.astype(U) + U(1)) * powers(base, len(data)), out=self.total[1:])
        self.inverse = powers(inverse, len(data) + 1)

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mixed((self.total[ends] - self.total[starts]) * self.inverse[starts])


def smallest_in_windows(h: np.ndarray, w: int) -> np.ndarray:
    """For each start, the first place of the smallest of ``w`` values: minima of blocks from
    both sides, so that the work doesn't depend on ``w``."""
    n = len(h) - w + 1
    blocks = -(-len(h) // w)
    # the place in the low bits, so that the first of equal hashes wins and the place comes along
    bits = U(max(24, (len(h) - 1).bit_length()))
    v = np.full(blocks * w, ~U(0), U)
    v[:len(h)] = (h >> bits << bits) | np.arange(len(h), dtype=U)
    v = v.reshape(blocks, w)
    left = np.minimum.accumulate(v, 1).ravel()
    right = np.minimum.accumulate(v[:, ::-1], 1)[:, ::-1].ravel()
    return (np.minimum(right[:n], left[w - 1:w - 1 + n]) & ((U(1) << bits) - U(1))).astype(np.int64)


def text_anchors(data: np.ndarray, length: int, gram: int = GRAM) -> tuple[np.ndarray, ...] | None:
    """Anchor, shape (bytes from the first window's start, and from there to the last one's),
    bucket and digest of one text; with hashes of words in place of bytes, all of it in words."""
    if len(data) < length:
        return None
    roll = Rolling(data)
    h = roll.of(np.arange(len(data) - gram + 1), np.arange(gram, len(data) + 1))
    place = smallest_in_windows(h, length - gram + 1)
    cut = np.concatenate([[0], np.flatnonzero(np.diff(place)) + 1, [len(place)]])
    first, last = cut[:-1], cut[1:] - 1
    at = place[first]
    shape = (at - first) << 16 | (last - first)  # part of the digest: leaves cover the same places
    digest = mixed(Rolling(data, SECOND, SECOND_INVERSE).of(first, last + length) + shape.astype(U) * BASE)
    return at, shape.astype(np.int32), h[at].astype(np.int64), digest.astype(np.int64)


ANCHORS = "row_key long, at long, shape int, bucket long, digest long"
TEXTS = ", doc_id long, n_bytes long, sha256 string"


def anchors(rows: DataFrame, length: int, words: bool = False) -> DataFrame:
    """A row for each anchor, and one with a null bucket for each text."""
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
    names = [f.split()[0] for f in (ANCHORS + TEXTS).split(", ")]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch["row_key"].to_numpy()
            for lo, hi in slices(batch["text"]):
                data, offsets = raw_bytes(batch["text"].slice(lo, hi - lo))
                parts, shas = [], []
                for i in range(hi - lo):
                    text = data[offsets[i]:offsets[i + 1]]
                    shas.append(hashlib.sha256(text.tobytes()).hexdigest())
                    found = text_anchors(text_words(text)[0], length, GRAM_WORDS) if words else text_anchors(text, length)
                    if found:
                        parts.append((np.full(len(found[0]), keys[lo + i]), *found))
                whole = [pa.array(np.concatenate(c)) for c in zip(*parts)] if parts else [pa.nulls(0, k) for k in kinds[:5]]
                yield pa.RecordBatch.from_arrays([*whole, *(pa.nulls(len(whole[0]), k) for k in kinds[5:])], names)
                yield pa.RecordBatch.from_arrays([pa.array(keys[lo:hi]), *(pa.nulls(hi - lo, k) for k in kinds[1:5]),
                                                  batch["doc_id"].slice(lo, hi - lo), pa.array(np.diff(offsets)), pa.array(shas)], names)

    return rows.select("doc_id", "row_key", "text").mapInArrow(find, ANCHORS + TEXTS)


def common_prefix(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    lo, hi = 0, n  # a[:lo] == b[:lo], a[:hi] != b[:hi]
    while hi - lo > 1:
        mid = (lo + hi) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid
    return lo


def intervals(texts: list[bytes], least: int, unit: int = 1) -> tuple[list[int], list[tuple[int, int, int]]]:
    """Order of the sorted texts, and (common prefix, from, to) of every interval of that order whose
    members share more than those around it: a stack scan over neighbouring prefixes, in units of
    ``unit`` bytes."""
    order = sorted(range(len(texts)), key=texts.__getitem__)
    shared = [common_prefix(texts[x], texts[y]) // unit for x, y in zip(order, order[1:])]
    found, stack = [], []
    for i, n in enumerate([*shared, -1]):
        start = i
        while stack and stack[-1][0] > n:
            depth, start = stack.pop()
            if depth >= least:
                found.append((depth, start, i))
        if not stack or stack[-1][0] < n:
            stack.append((n, start))
    return order, found


def maximal_repeats(lefts: list[bytes], rights: list[bytes], length: int, unit: int = 1) -> Iterator[tuple[int, int, list[int]]]:
    """(units to the left, units to the right, leaves) of the maximal repeats of two or more leaves
    around an anchor. ``lefts`` are the left contexts backwards, ``rights`` begin with the anchor; a
    unit is a byte, or a word's hash in eight."""
    order, found = intervals(rights, max(1, length - max(map(len, lefts)) // unit), unit)
    for right, lo, hi in found:
        members = order[lo:hi + 1]
        inner, groups = intervals([lefts[i] for i in members], max(0, length - right), unit)
        for left, a, b in groups:
            leaves = [members[inner[p]] for p in range(a, b + 1)]
            # right-diverse: not all of them go on alike; intervals of the left contexts are left-diverse
            ahead = {rights[i][right * unit:(right + 1) * unit] for i in leaves}
            if len(ahead) > 1 or b"" in ahead:
                yield left, right, leaves


def bucket_repeats(leaves: DataFrame, length: int, groups: bool, words: bool = False) -> DataFrame:
    """Repeats among the leaves of each bucket (bucket, digest, n, row_key, at, left, right). With
    ``groups`` a row for each leaf of each maximal repeat: its digest and how far it reaches from
    the anchor; else one for each leaf that counts one: how far its repeats reach at most. They
    all hold the anchor, so that is their union."""
    names = ["bucket", "digest", "row_key", "at", "left", "right", "repeat"]
    unit = 8 if words else 1
    kinds = [pa.int64()] * 6 + [pa.binary()]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def close() -> list[tuple]:
            nonlocal held
            out = []
            if len(held) > 1:
                digests, counts, keys, places, lefts, rights = zip(*held)
                reach: dict[int, tuple[int, int]] = {}
                for left, right, members in maximal_repeats(list(lefts), list(rights), length, unit):
                    if groups:
                        i = members[0]
                        before = lefts[i][:left * unit]
                        before = b"".join(before[p:p + unit] for p in range(len(before) - unit, -1, -unit))
                        name = hashlib.blake2b(before + rights[i][:right * unit], digest_size=16).digest()
                        out += [(now, digests[j], keys[j], places[j], left, right, name) for j in members]
                    else:
                        for j in members:
                            if counts[j] == 1:
                                a, b = reach.get(j, (0, 0))
                                reach[j] = max(a, left), max(b, right)
                out += [(now, digests[j], keys[j], places[j], a, b, None) for j, (a, b) in reach.items()]
            held = []
            return out

        def rows_of(out):
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], k) for i, k in enumerate(kinds)], names)

        for batch in batches:
            out = []
            for bucket, *leaf in zip(*(batch[c].to_pylist() for c in ("bucket", "digest", "n", "row_key", "at", "left", "right"))):
                if bucket != now:
                    out += close()
                    now = bucket
                if not held or held[-1][0] != leaf[0]:  # else a repeated row of the leaf's document
                    held.append(leaf)
            yield rows_of(out)
        yield rows_of(close())

    dealt = leaves.repartition("bucket").sortWithinPartitions("bucket", "digest")
    return dealt.mapInArrow(search, "bucket long, digest long, row_key long, at long, left long, right long, repeat binary")


def contexts(texts: DataFrame, length: int, windows: bool, words: bool = False) -> DataFrame:
    """Bytes around the anchors in ``spots``, or (``windows``) digests of every window of those in
    crowded buckets."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spots = batch["spots"].to_pylist()
            keys = batch["row_key"].to_pylist()
            for lo, hi, part in unpacked(batch["packed"]):
                out, rolled = [], []
                for i, text in enumerate(part.cast(pa.binary()).to_pylist(), lo):
                    own = [s for s in spots[i] if s["crowded"] == windows]
                    if not own:
                        continue
                    data = units_of(text, words)
                    if windows:
                        a, b = Rolling(data), Rolling(data, SECOND, SECOND_INVERSE)
                    for s in own:
                        first = s["at"] - (s["shape"] >> 16)
                        last = first + (s["shape"] & 0xFFFF)
                        if windows:
                            w = np.arange(first, last + 1)
                            rolled.append((np.full(len(w), keys[i]), w, a.of(w, w + length).astype(np.int64), b.of(w, w + length).astype(np.int64)))
                        else:
                            left, right = data[first:s["at"]][::-1], data[s["at"]:last + length]
                            out.append((s["bucket"], s["digest"], s["n"], keys[i], s["at"], left.tobytes(), right.tobytes()))
                if rolled:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*rolled)], ["row_key", "start", "one", "two"])
                if out:
                    kinds = [pa.int64()] * 5 + [pa.binary()] * 2
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], ["bucket", "digest", "n", "row_key", "at", "left", "right"])

    schema = ("row_key long, start long, one long, two long" if windows
              else "bucket long, digest long, n long, row_key long, at long, left binary, right binary")
    return texts.where("spots IS NOT NULL").select("row_key", "packed", "spots").mapInArrow(cut, schema)


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text and ``row_key``."""
    return texts_of(docs).withColumn("row_key", F.xxhash64("doc_id", "text"))


class Search:
    """The tables of one search for repeats: ``found`` (anchors and texts), ``shared`` (anchors in
    buckets with others), ``leaves``, and ``texts`` (with what is known of them) of the rows that
    have a repeat or may have one."""

    def __init__(self, docs: DataFrame, length: int, bucket: int, words: bool = False, groups: bool = False):
        small_batches(docs.sparkSession)
        self.length, self.words = length, words
        self.found = stored(anchors(keyed(docs), length, words))
        here = self.found.where("bucket IS NOT NULL").select("row_key", "at", "shape", "bucket", "digest")
        several = stored(here.groupBy("bucket").count().where("count > 1").select("bucket"))
        self.shared = stored(here.join(several.hint("merge"), "bucket"))
        # the columns of one row, whichever; a leaf's rows agree in all that matters
        self.leaves = stored(self.shared.groupBy("bucket", "digest").agg(
            F.count("*").alias("n"), F.first("row_key").alias("row_key"), F.first("at").alias("at"), F.first("shape").alias("shape")))
        open_ = (self.leaves.groupBy("bucket").agg(F.count("*").alias("leaves"), F.min("n").alias("least"))
                 .where((F.col("leaves") > 1) & (F.lit(groups) | (F.col("least") == 1))).select("bucket", (F.col("leaves") > bucket).alias("crowded")))
        open_ = stored(open_)
        self.crowded = not open_.where("crowded").isEmpty()
        # in a crowded bucket every anchor's windows are counted, else one anchor of each leaf compared
        spots = self.leaves.join(open_, "bucket")
        first = F.col("at") - F.shiftright("shape", 16)
        stop = first + F.col("shape").bitwiseAND(F.lit(0xFFFF)) + length
        self.whole = self.shared.join(self.leaves.where("n > 1").select("bucket", "digest").hint("merge"), ["bucket", "digest"]).select(
            "row_key", "bucket", "digest", first.cast("long").alias("start"), stop.cast("long").alias("stop"))
        spots = spots.groupBy("row_key").agg(F.collect_list(F.struct("at", "shape", "bucket", "digest", "n", "crowded")).alias("spots"))
        spans = self.whole.groupBy("row_key").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
        known = stored(spots.join(spans, "row_key", "full"))
        self.texts = stored(packed_texts(keyed(docs).drop("doc_id")).join(known.hint("merge"), "row_key"))

    def in_buckets(self, groups: bool) -> DataFrame:
        return bucket_repeats(contexts(self.texts, self.length, False, self.words), self.length, groups, self.words)

    def in_crowded(self) -> DataFrame:
        """(row_key, start, one, two) of every repeated window."""
        windows = stored(contexts(self.texts, self.length, True, self.words))
        twice = stored(windows.groupBy("one", "two").count().where("count > 1").select("one", "two"))
        return windows.join(twice.hint("merge"), ["one", "two"])


def repeat_groups(docs: DataFrame, length: int = LENGTH, bucket: int = BUCKET, words: bool = False) -> DataFrame:
    """(repeat, doc_id, start, stop): all occurrences, in bytes or words, of every maximal repeat;
    ``repeat`` is a digest of the repeated string. Buckets of any two leaves are searched here, copies
    counted as one leaf included. What all leaves of one kind cover is a group as well; in a bucket
    of more than ``bucket`` leaves the groups are the repeated windows of the length."""
    s = Search(docs, length, bucket, words, True)
    leaf = ["bucket", "digest"]
    name = F.concat(F.hex("bucket"), F.lit("-"), F.hex("digest"))
    inner = s.in_buckets(True).select(*leaf, "left", "right", F.hex("repeat").alias("repeat"))
    parts = s.shared.join(inner, leaf).select("repeat", "row_key", (F.col("at") - F.col("left")).alias("start"), (F.col("at") + F.col("right")).alias("stop"))
    out = parts.unionByName(s.whole.select(name.alias("repeat"), "row_key", "start", "stop"))
    if s.crowded:
        out = out.unionByName(s.in_crowded().select(F.concat(F.hex("one"), F.lit("+"), F.hex("two")).alias("repeat"), "row_key", "start",
                                                    (F.col("start") + length).alias("stop")))
    return out.join(s.found.where("bucket IS NULL").select("row_key", "doc_id"), "row_key").select("repeat", "doc_id", "start", "stop").distinct()


def bytes_of_words(text: bytes, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Byte ranges of runs of words; runs that meet are one, with the whitespace between them."""
    _, starts, ends = text_words(np.frombuffer(text, np.uint8))
    covered = np.zeros(len(starts) + 1, np.int64)
    for a, b in spans:
        covered[a] += 1
        covered[b] -= 1
    edges = np.flatnonzero(np.diff(np.concatenate([[False], np.cumsum(covered) > 0, [False]])))
    return [(int(starts[a]), int(ends[b - 1])) for a, b in zip(edges[::2], edges[1::2])]


def remove_spans(text: bytes, spans: list[tuple[int, int]], whole_letters: bool = False) -> tuple[bytes, int, int]:
    """What is left, the number of bytes removed and of maximal runs removed. ``whole_letters``
    keeps a letter of which only a part is covered."""
    gone: list[list[int]] = []
    for a, b in sorted(spans):
        if gone and a <= gone[-1][1]:
            gone[-1][1] = max(gone[-1][1], b)
        else:
            gone.append([a, b])
    if whole_letters:
        for g in gone:
            while g[0] < g[1] and text[g[0]] & 0xC0 == 0x80:
                g[0] += 1
            while g[0] < g[1] < len(text) and text[g[1]] & 0xC0 == 0x80:
                g[1] -= 1
    out, at = [], 0
    for a, b in gone:
        out.append(text[at:a])
        at = b
    out.append(text[at:])
    return b"".join(out), sum(b - a for a, b in gone), len(gone)


def without_repeats(docs: DataFrame, length: int = LENGTH, bucket: int = BUCKET, whole_letters: bool = False, words: bool = False) -> tuple[DataFrame, DataFrame]:
    """(row_key, doc_id, n_bytes, sha256) of every row, and (row_key, n_removed, n_spans,
    kept_sha256, kept) of the rows from which something is removed."""
    s = Search(docs, length, bucket, words)
    more = s.in_buckets(False).select("row_key", (F.col("at") - F.col("left")).alias("start"), (F.col("at") + F.col("right")).alias("stop"))
    if s.crowded:
        more = more.unionByName(s.in_crowded().select("row_key", "start", (F.col("start") + length).alias("stop")))
    more = more.groupBy("row_key").agg(F.collect_list(F.struct("start", "stop")).alias("more"))
    names = ["row_key", "n_removed", "n_spans", "kept_sha256", "kept"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, spans, more = (batch[c].to_pylist() for c in ("row_key", "spans", "more"))
            for lo, hi, texts in unpacked(batch["packed"]):
                out = []
                for i, text in enumerate(texts.cast(pa.binary()).to_pylist(), lo):
                    own = [(x["start"], x["stop"]) for x in (spans[i] or []) + (more[i] or [])]
                    kept, gone, n = remove_spans(text, bytes_of_words(text, own) if words else own, whole_letters)
                    if gone:
                        out.append((keys[i], gone, n, hashlib.sha256(kept).hexdigest(), kept))
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], k) for i, k in enumerate([pa.int64()] * 3 + [pa.string(), pa.binary()])], names)

    joined = s.texts.drop("spots").join(stored(more).hint("merge"), "row_key", "left")
    removed = joined.mapInArrow(cut, "row_key long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    return s.found.where("bucket IS NULL").select("row_key", "doc_id", "n_bytes", "sha256"), removed


def deduplicated(docs: DataFrame, length: int = LENGTH, bucket: int = BUCKET) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every row."""
    rows, removed = without_repeats(docs, length, bucket)
    removed = removed.drop("kept").dropDuplicates(["row_key"])
    return rows.join(removed, "row_key", "left").select(
        "doc_id", "n_bytes", *(F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("n_removed", "n_spans")), F.coalesce("kept_sha256", "sha256").alias("kept_sha256"))
