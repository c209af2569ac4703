"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages of ``PASSAGE`` bytes; its label says nothing about which passage
earned it. Every passage is encoded (shares of kinds of characters, repetition among its words, a
signed hash of its words), a hidden layer makes h of it, and gated attention gives its weight in
the document, softmax over w . (tanh(V h) * sigmoid(U h)). The document's score is a logistic
function of the weighted mean of h. All weights are learned together from document labels.

The network is fitted on a bounded sample of labelled rows (at most ``SAMPLE`` documents, by hash
order); scoring passes over every passage of every whole text, inside Arrow batches.

Nulls and empty texts: one empty passage, scored like any. A null label or a label of an unknown
document teaches nothing; without labels of both classes every score is the share of label 1 (a
half without labels). Rows keep their number, a null doc_id stays null and teaches nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nextcover.llm.common import raw_bytes, slices, small_batches, span_hashes, stored, texts_of

PASSAGE = 512
SAMPLE = 8_000
HIDDEN = 32
ATTENTION = 16
WORD_SIGNS = 16
EPOCHS = 40
BATCH = 128
LEARNING_RATE = 0.01

#: kinds of bytes whose shares are features
KINDS = [b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t", b"\n\r", b".,", b"!", b"?", b"#", b"&", b"$", b"%",
         b"*", b"|", b"<>{}[]()=/\\_", b"\"'`-:;@+~^", bytes(range(128, 192)), bytes(range(192, 256))]
KIND = np.full(256, len(KINDS), np.int64)
for _i, _k in enumerate(KINDS):
    KIND[list(_k)] = _i
FEATURES = len(KINDS) + 1 + 6 + WORD_SIGNS
U = np.uint64


def passages(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages, and where each row's passages start."""
    data, offsets = raw_bytes(texts)
    sizes = np.diff(offsets)
    number = np.maximum(1, -(-sizes // PASSAGE))
    first = np.concatenate([[0], np.cumsum(number)])
    place = np.arange(first[-1]) - np.repeat(first[:-1], number)
    starts = np.repeat(offsets[:-1], number) + place * PASSAGE
    size = np.minimum(PASSAGE, np.repeat(offsets[1:], number) - starts)
    passage = np.repeat(np.arange(first[-1]), size)
    out = np.zeros((first[-1], FEATURES), np.float32)
    kinds = np.bincount(passage * (len(KINDS) + 1) + KIND[data], minlength=first[-1] * (len(KINDS) + 1)).reshape(-1, len(KINDS) + 1)
    out[:, :kinds.shape[1]] = kinds / np.maximum(size, 1)[:, None]
    # words: runs without white space; one that reaches into the next passage counts where it starts
    white = np.isin(data, np.frombuffer(b" \t\n\r", np.uint8))
    inside = np.concatenate([[False], ~white, [False]])
    begins, stops = inside[1:] & ~inside[:-1], inside[:-1] & ~inside[1:]
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < len(data))]
    joined = edges[inside[edges] & inside[edges + 1]]
    begins[joined], stops[joined] = True, True
    begin, stop = np.flatnonzero(begins), np.flatnonzero(stops)
    if len(begin):
        h = span_hashes(data, begin, stop)
        owner = passage[begin]
        n = np.bincount(owner, minlength=first[-1])
        some = np.maximum(n, 1)
        length = stop - begin
        again = np.zeros(len(h), bool)
        again[1:] = (h[1:] == h[:-1]) & (owner[1:] == owner[:-1])
        order = np.lexsort((h, owner))
        other = np.ones(len(h), bool)
        other[1:] = (h[order][1:] != h[order][:-1]) | (owner[order][1:] != owner[order][:-1])
        at = len(KINDS) + 1
        out[:, at] = np.minimum(np.bincount(owner, np.minimum(length, 40), first[-1]) / some / 10, 4)
        out[:, at + 1] = np.bincount(owner, again, first[-1]) / some
        out[:, at + 2] = np.bincount(owner[order], other, first[-1]) / some
        out[:, at + 3] = n / np.maximum(size, 1) * 5
        out[:, at + 4] = np.bincount(owner, length == 1, first[-1]) / some
        out[:, at + 5] = np.log1p(size) / 6
        for j in range(WORD_SIGNS):
            sign = (h >> U(j) & U(1)).astype(np.float64) * 2 - 1
            out[:, at + 6 + j] = np.bincount(owner, sign, first[-1]) / np.sqrt(some) / 4
    return out, first


class Network:
    """The encoder, the gated attention and the logistic output, with their gradients."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, seed: int = 3):
        r = np.random.default_rng(seed)
        self.mean, self.scale = mean.astype(np.float32), scale.astype(np.float32)

        def matrix(a, b):
            return (r.normal(size=(a, b)) / np.sqrt(a)).astype(np.float32)

        self.p = {"w": matrix(FEATURES, HIDDEN), "b": np.zeros(HIDDEN, np.float32), "v": matrix(HIDDEN, ATTENTION), "u": matrix(HIDDEN, ATTENTION),
                  "a": matrix(ATTENTION, 1)[:, 0], "c": matrix(HIDDEN, 1)[:, 0], "d": np.zeros(1, np.float32)}

    def forward(self, x: np.ndarray, first: np.ndarray) -> tuple:
        p, n = self.p, np.diff(first)
        x = np.clip((x - self.mean) / self.scale, -8, 8)
        h = np.tanh(x @ p["w"] + p["b"])
        t, g = np.tanh(h @ p["v"]), 1 / (1 + np.exp(-np.clip(h @ p["u"], -30, 30)))
        e = (t * g) @ p["a"]
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, first[:-1]), n))
        weight = e / np.repeat(np.add.reduceat(e, first[:-1]), n)
        z = np.add.reduceat(h * weight[:, None], first[:-1])
        return x, h, t, g, weight, z, z @ p["c"] + p["d"][0]

    def scores(self, x: np.ndarray, first: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.forward(x, first)[-1].astype(np.float64), -40, 40)))

    def gradients(self, x, first, y) -> dict[str, np.ndarray]:
        p, n = self.p, np.diff(first)
        x, h, t, g, weight, z, logit = self.forward(x, first)
        d = ((1 / (1 + np.exp(-np.clip(logit, -30, 30))) - y) / len(y)).astype(np.float32)
        dz = np.repeat(d[:, None] * p["c"][None, :], n, 0)
        dh = dz * weight[:, None]
        dweight = (dz * h).sum(1)
        de = weight * (dweight - np.repeat(np.add.reduceat(weight * dweight, first[:-1]), n))
        dt, dg = de[:, None] * p["a"] * g * (1 - t * t), de[:, None] * p["a"] * t * g * (1 - g)
        dh += dt @ p["v"].T + dg @ p["u"].T
        dh *= 1 - h * h
        return {"w": x.T @ dh, "b": dh.sum(0), "v": h.T @ dt, "u": h.T @ dg, "a": (t * g).T @ de, "c": z.T @ d, "d": np.array([d.sum()], np.float32)}

    def fit(self, x: np.ndarray, first: np.ndarray, y: np.ndarray, seed: int = 5) -> None:
        r, m, v, step = np.random.default_rng(seed), {}, {}, 0
        for epoch in range(EPOCHS):
            order = r.permutation(len(y))
            rate = LEARNING_RATE * (1 - epoch / EPOCHS) + 1e-4
            for lo in range(0, len(order), BATCH):
                docs = order[lo:lo + BATCH]
                rows = np.concatenate([np.arange(first[i], first[i + 1]) for i in docs])
                cut = np.concatenate([[0], np.cumsum(first[docs + 1] - first[docs])])
                step += 1
                for k, g in self.gradients(x[rows], cut, y[docs]).items():
                    g = g + 1e-4 * self.p[k]
                    m[k] = 0.9 * m.get(k, 0) + 0.1 * g
                    v[k] = 0.999 * v.get(k, 0) + 0.001 * g * g
                    self.p[k] -= (rate * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(v[k] / (1 - 0.999 ** step)) + 1e-8)).astype(np.float32)


def fitted(texts: DataFrame, marks: DataFrame, sample: int = SAMPLE) -> Network | float:
    """A network for the labelled texts, or the share of label 1 where there is only one label."""
    chosen = stored(marks.groupBy("doc_id").agg(F.max("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample))
    bags = texts.join(F.broadcast(chosen), "doc_id")  # at most ``sample`` ids

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi in slices(b["text"]):
                x, first = passages(b["text"].slice(lo, hi - lo))
                flat = [x[i:j].ravel().tobytes() for i, j in zip(first[:-1], first[1:])]
                yield pa.RecordBatch.from_arrays([b["doc_id"].slice(lo, hi - lo), b["quality"].slice(lo, hi - lo), pa.array(flat, pa.binary())], ["doc_id", "quality", "bag"])

    rows = bags.mapInArrow(encode, "doc_id long, quality int, bag binary").toArrow().sort_by([("doc_id", "ascending")])
    y = rows["quality"].to_numpy().astype(np.float32)
    if len(set(y.tolist())) < 2:
        return float(y.mean()) if len(y) else 0.5
    bag = [np.frombuffer(x.as_buffer(), np.float32).reshape(-1, FEATURES) for x in rows["bag"]]
    x, first = np.concatenate(bag), np.concatenate([[0], np.cumsum([len(b) for b in bag])])
    net = Network(x.mean(0), x.std(0) + 1e-3)
    net.fit(x, first, y)
    return net


def quality_scores(docs: DataFrame, labels: DataFrame, learn: Column, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, score) of every row; labels are taken only from rows where ``learn``, a condition on
    doc_id, holds."""
    spark = docs.sparkSession
    small_batches(spark)
    texts = texts_of(docs)
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where("quality IN (0, 1)").where(learn)
    net = fitted(texts, marks, sample)
    if isinstance(net, float):
        return texts.select("doc_id", F.lit(net).alias("score"))
    shared = spark.sparkContext.broadcast(net)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi in slices(b["text"]):
                yield pa.RecordBatch.from_arrays([b["doc_id"].slice(lo, hi - lo), pa.array(shared.value.scores(*passages(b["text"].slice(lo, hi - lo))))], ["doc_id", "score"])

    return texts.mapInArrow(score, "doc_id long, score double")
