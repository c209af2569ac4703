"""Toxicity by two Kneser-Ney models of words, one of toxic and one of ordinary documents.

A class's probability of a word rests on its continuation count: after how many different words
the class has it, so that a passage copied a thousand times counts once. ``DISCOUNT`` is taken
off every count, and what that frees goes to a backoff distribution that both classes share,
the continuation counts of the whole labelled corpus. A word that is rare in both classes thus
gets almost the same probability from both, and only expressions found in several contexts
speak for a class. (A further level of word pairs above this one was tried; sparse toxic pairs
made it worse on held-out rows.)

A document's evidence are differences of the two log-likelihoods, normalised by length: over
the whole document, over its strongest four words in a row, and over its three strongest
words. A logistic curve turns them into a score.

The counts are made by Spark from every labelled document that isn't kept for the curve, by the
whole 64-bit hash of each word, and grow with them: each task sends its different pairs of words.
The curve has four numbers and is fitted on a bounded sample of labelled documents that the counts
leave out (one in four, at most ``CURVE_ROWS``, first by hash); beyond that bound all teach the
counts. A word that either class has at most ``DISCOUNT`` times has one and the same ratio, the
share of the backoff, so only the others are listed. Of the list, the classes of highest counts
that make at most ``FRONT`` words go to every task; the rest, however many, are joined to the
different words of each document in a shuffle. Where the list is cut changes no score.

Nulls and empty texts: evidence 0. A null label or a label of an unknown document teaches
nothing; several labels of one document count each. Without labels of both classes every score
is the share of toxic labels (a half without labels). Rows keep their number; a null doc_id
stays null and teaches nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nextcover.llm.common import lowered, packed_texts, slices, small_batches, span_hashes, stored, texts_of, unpacked, word_spans

DISCOUNT = 3.0
#: words whose ratios every task holds, 12 bytes each
FRONT = 1 << 20
WINDOW = 4
STRONGEST = 3
CURVE_ROWS = 20_000
#: of the learning rows, those whose crc32 leaves this remainder by 4 (after 8 bits) may fit the curve
CURVE_SHARE = 1
#: pairs of words a task holds before it removes repeated ones
HELD_PAIRS = 1 << 20
U = np.uint64


def crc_of_id() -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary"))


def words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and where each row's words start."""
    data, offsets, _ = lowered(texts)
    starts, ends, row = word_spans(data, offsets)
    return span_hashes(data, starts, ends), np.searchsorted(row, np.arange(len(offsets)))


def pairs_of(words_: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each word and 41 bits of the word before it (of nothing at a text's start)."""
    before = np.zeros(len(words_), U)
    before[1:] = words_[:-1] >> U(23)
    before[first[:-1][first[:-1] < len(words_)]] = 0
    return words_, before


def different_pairs(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Each pair once, in the order of its word."""
    word, before = (np.concatenate(part) for part in zip(*held))
    order = np.lexsort((before, word))
    word, before = word[order], before[order]
    new = np.ones(len(word), bool)
    new[1:] = (word[1:] != word[:-1]) | (before[1:] != before[:-1])
    return word[new], before[new]


def continuation_counts(labelled: DataFrame) -> DataFrame:
    """(word, toxic, ordinary, either): before each word, the number of different words."""

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {1: [], 2: []}

        def different(mask: int, least: int) -> Iterator[pa.RecordBatch]:
            """Each pair once; kept on while the repeated ones make room."""
            if held[mask] and sum(len(w) for w, _ in held[mask]) >= least:
                held[mask] = [different_pairs(held[mask])]
                if len(held[mask][0][0]) >= least // 2:
                    word, before = (x.astype(np.int64) for x in held[mask].pop())
                    for lo in range(0, len(word), 1 << 18):
                        part = slice(lo, lo + (1 << 18))
                        yield pa.RecordBatch.from_arrays([pa.array(word[part]), pa.array(before[part]), pa.array(np.full(len(word[part]), mask, np.int8))],
                                                         ["word", "before", "classes"])

        for batch in batches:
            toxic = batch["toxic"].to_numpy(zero_copy_only=False) == 1
            for lo, hi, texts in unpacked(batch["packed"]):
                w, first = words(texts)
                word, before = pairs_of(w, first)
                bad = np.repeat(toxic[lo:hi], np.diff(first))
                held[1].append((word[bad], before[bad]))
                held[2].append((word[~bad], before[~bad]))
                for mask in held:
                    yield from different(mask, HELD_PAIRS)
        for mask in held:
            yield from different(mask, 0)

    kinds = (labelled.select("packed", "toxic").mapInArrow(pairs, "word long, before long, classes tinyint")
             .groupBy("word", "before").agg(F.bit_or("classes").alias("classes")))
    # counted in two steps: a task sums what it holds of a word before the words are brought together
    return kinds.groupBy("word").agg(F.count(F.when(F.col("classes").bitwiseAND(F.lit(1)) > 0, 1)).alias("toxic"),
                                     F.count(F.when(F.col("classes") >= 2, 1)).alias("ordinary"), F.count("*").alias("either"))


class Ratios:
    """Log of the two classes' probabilities of a word: ``usual`` for all words but the listed ones,
    of which ``front`` (sorted words and their ratios) is broadcast and ``rest``, a table or None,
    is joined."""

    def __init__(self, usual: float, front, rest: DataFrame | None):
        self.usual, self.front, self.rest = usual, front, rest


def looked_up(listed: tuple[np.ndarray, np.ndarray], words_: np.ndarray, value: np.ndarray) -> np.ndarray:
    """``value``, but the ratio of every word that is listed."""
    known, ratio = listed
    if not len(known) or not len(words_):
        return value
    at = np.minimum(np.searchsorted(known, words_), len(known) - 1)
    return np.where(known[at] == words_, ratio[at], value)


def log_ratios(counts: DataFrame) -> Ratios | None:
    """The ratios of all words; None if a class has no word."""
    classes = ("toxic", "ordinary")
    counts = stored(counts)
    sums = counts.agg(*(F.sum(c).alias(c) for c in (*classes, "either")), *(F.sum(F.least(F.col(c).cast("double"), F.lit(DISCOUNT))).alias(f"free_{c}") for c in classes)).first()
    if not sums["toxic"] or not sums["ordinary"]:
        return None
    p = [(F.greatest(F.col(c) - F.lit(DISCOUNT), F.lit(0.0)) + F.lit(sums[f"free_{c}"]) * F.col("either") / F.lit(float(sums["either"]))) / F.lit(float(sums[c])) for c in classes]
    usual = float(np.log(sums["free_toxic"] / sums["toxic"]) - np.log(sums["free_ordinary"] / sums["ordinary"]))
    most = F.greatest(*classes)
    # quarters of doublings, so there are a few hundred at most however large the counts are
    listed = counts.where(most > DISCOUNT).select("word", F.log(p[0] / p[1]).cast("float").alias("ratio"), F.floor(4 * F.log2(most)).cast("int").alias("size"))
    least, held = None, 0
    sizes = sorted(((r["size"], r["count"]) for r in listed.groupBy("size").count().collect()), reverse=True)
    for size, n in sizes:
        held += n
        if held > FRONT:
            break
        least = size
    front = listed.where(F.col("size") >= (least if least is not None else np.iinfo(np.int32).max)).select("word", "ratio").toArrow()
    word, ratio = front["word"].to_numpy().astype(np.int64).view(U), front["ratio"].to_numpy().astype(np.float32)
    order = np.argsort(word)
    whole = held <= FRONT
    rest = None if whole else listed.where(F.col("size") < least if least is not None else F.lit(True)).select("word", "ratio")
    return Ratios(usual, counts.sparkSession.sparkContext.broadcast((word[order], ratio[order])), rest)


def with_rest(docs: DataFrame, ratios: Ratios) -> DataFrame:
    """``docs`` with the words of each text that stand in the rest of the list, and their ratios, as
    columns ``rest_word`` and ``rest_ratio``. Texts know their words by a hash of row and text."""
    front, key = ratios.front, F.xxhash64("doc_id", "text")

    def other_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch["row_key"].to_numpy()
            for lo, hi in slices(batch["text"]):
                w, first = words(batch["text"].slice(lo, hi - lo))
                w, row = different_pairs([(w, np.repeat(np.arange(lo, hi), np.diff(first)).astype(U))])
                new = np.isnan(looked_up(front.value, w, np.full(len(w), np.nan)))
                yield pa.RecordBatch.from_arrays([pa.array(keys[row[new].astype(np.int64)]), pa.array(w[new].view(np.int64))], ["row_key", "word"])

    found = docs.select(key.alias("row_key"), "text").mapInArrow(other_words, "row_key long, word long")
    lists = (found.join(ratios.rest.hint("merge"), "word").groupBy("row_key")
             .agg(F.sort_array(F.collect_set(F.struct("word", "ratio"))).alias("rest"))
             .select("row_key", F.col("rest.word").alias("rest_word"), F.col("rest.ratio").alias("rest_ratio")))
    return docs.withColumn("row_key", key).join(lists.hint("merge"), "row_key", "left").drop("row_key")


def evidence(docs: DataFrame, ratios: Ratios, *more: str) -> DataFrame:
    """The three differences (whole, window, words) of every whole text."""
    names, front, usual = ["doc_id", *more], ratios.front, ratios.usual
    kinds = dict(docs.dtypes)
    if ratios.rest is not None:
        docs = with_rest(docs, ratios)

    def rest_of(batch: pa.RecordBatch, i: int) -> tuple[np.ndarray, np.ndarray]:
        known = np.array(batch["rest_word"][i].as_py() or [], np.int64).view(U)
        order = np.argsort(known)
        return known[order], np.array(batch["rest_ratio"][i].as_py() or [], np.float32)[order]

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, joined = [], "rest_word" in batch.schema.names
            for lo, hi in slices(batch["text"]):
                w, first = words(batch["text"].slice(lo, hi - lo))
                value = looked_up(front.value, w, np.full(len(w), usual)).astype(np.float64)
                if joined:
                    for i, (a, b) in enumerate(zip(first[:-1], first[1:])):
                        value[a:b] = looked_up(rest_of(batch, lo + i), w[a:b], value[a:b])
                total = np.concatenate([[0.0], np.cumsum(value)])
                for a, b in zip(first[:-1], first[1:]):
                    if a == b:
                        out.append((0.0, 0.0, 0.0))
                        continue
                    k, top = min(WINDOW, b - a), min(STRONGEST, b - a)
                    out.append(((total[b] - total[a]) / (b - a), (total[a + k:b + 1] - total[a:b + 1 - k]).max() / k,
                                np.partition(value[a:b], b - a - top)[b - a - top:].mean()))
            yield pa.RecordBatch.from_arrays([*(batch[n] for n in names), *(pa.array(c, pa.float64()) for c in np.array(out, float).reshape(-1, 3).T)],
                                             [*names, "whole", "window", "words"])

    return docs.mapInArrow(measure, ", ".join(f"{n} {kinds[n]}" for n in names) + ", whole double, window double, words double")


def logistic_curve(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights and bias by Newton's method, with a small penalty so that a clean split stays finite."""
    mean, scale = x.mean(0), x.std(0) + 1e-9
    a = np.hstack([(x - mean) / scale, np.ones((len(x), 1))])
    w, pull = np.zeros(a.shape[1]), np.diag([0.5] * x.shape[1] + [1e-6])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -40, 40)))
        step = np.linalg.solve((a.T * (p * (1 - p))) @ a + pull, a.T @ (p - y) + pull @ w)
        w -= np.clip(step, -5, 5)
    return np.append(w[:-1] / scale, w[-1] - (w[:-1] * mean / scale).sum())


def toxicity_scores(docs: DataFrame, labels: DataFrame, learn: Column, with_row: bool = False) -> DataFrame:
    """(doc_id, whole, window, words, score) of every row of ``docs``; labels are taken only from
    rows where ``learn``, a condition on doc_id, holds. ``with_row`` adds the row's own columns
    as one column ``row``."""
    spark = docs.sparkSession
    small_batches(spark)
    texts, more = texts_of(docs), []
    if with_row:
        scored, more = texts_of(docs, F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")), ["row"]
    else:
        scored = texts
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("toxic IN (0, 1)")
    for_curve = F.pmod(F.shiftright(crc_of_id(), 8), F.lit(4)) == CURVE_SHARE
    # a merge join whatever the sizes, so that a small table and a large one behave alike
    sample = marks.where(learn & for_curve).select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(CURVE_ROWS)
    sample = F.broadcast(stored(sample))
    taught = stored(marks.where(learn & F.col("doc_id").isNotNull()).join(sample, "doc_id", "left_anti"))
    known = packed_texts(texts.where(learn).join(sample, "doc_id", "left_anti")).join(taught.hint("merge"), "doc_id")
    ratios = log_ratios(continuation_counts(known))
    if ratios is None:
        share = marks.where(learn).agg(F.avg("toxic")).first()[0]
        return scored.select("doc_id", *more, *(F.lit(0.0).alias(c) for c in ("whole", "window", "words")), F.lit(0.5 if share is None else float(share)).alias("score"))
    names = ["whole", "window", "words"]
    chosen = F.broadcast(stored(marks.where(learn).join(sample, "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(CURVE_ROWS)))
    fit = evidence(texts.join(chosen, "doc_id"), ratios, "toxic").toArrow()
    w = [0.0, 1.0, 1.0, 0.0]
    if len(fit):
        w = logistic_curve(np.stack([fit[c].to_numpy() for c in names], 1), fit["toxic"].to_numpy().astype(float)).tolist()
    z = sum((F.col(c) * float(k) for c, k in zip(names, w)), F.lit(float(w[-1])))
    return evidence(scored, ratios, *more).withColumn("score", 1 / (1 + F.exp(-z)))
