"""Held-out accuracy of the fitted models, a plain scorer beside them, and their edges."""

import math
import random
import re

import numpy as np
import pytest

from llm_support import make_docs, worker_path  # noqa: F401 - fixtures
from pyspark.sql import functions as F

from nextcover.llm.quality import FEATURES, Network, passages, quality_scores
from nextcover.llm.queries import QUERIES
from nextcover.llm.toxicity import DISCOUNT, continuation_counts, logistic_curve, toxicity_scores

LARGER = "/root/testdata/sf0.1"


def held_out(spark, name, label):
    rows = QUERIES[name](spark, LARGER).join(spark.read.parquet(f"{LARGER}/labels.parquet"), "doc_id").where("held_out").toPandas()
    return rows[rows[label].notna()]


def test_op10_on_held_out_rows(spark):
    rows = held_out(spark, "op10_toxicity", "toxic")
    assert rows.score.between(0, 1).all() and ((rows.score >= 0.5) == (rows.predicted == 1)).all()
    assert (rows[rows.toxic == 1].predicted == 1).mean() > 0.85 and (rows[rows.toxic == 0].predicted == 0).mean() > 0.99


def test_op7_on_held_out_rows(spark):
    rows = held_out(spark, "op7_quality_attention", "quality")
    assert rows.score.between(0, 1).all() and ((rows.score >= 0.7) == (rows.predicted == 1)).all()
    assert (rows[rows.quality == 1].predicted == 1).mean() > 0.97 and (rows[rows.quality == 0].predicted == 0).mean() > 0.93


ROWS = [(1, None), (2, ""), (3, "tie"), (3, "tie"), (None, "no id"), (4, "bad word " * 20000), (5, "good " * 9)]


@pytest.mark.parametrize("score,label", [(toxicity_scores, "toxic"), (quality_scores, "quality")])
def test_nulls_ties_empty_tables_and_few_labels(spark, make_docs, score, label):
    docs = make_docs(ROWS)
    none = spark.createDataFrame([], f"doc_id long, {label} int")
    assert [r["score"] for r in score(docs, none, F.lit(True)).collect()] == [0.5] * len(ROWS)
    one = spark.createDataFrame([(3, 1), (5, 1), (9, 0), (1, None)], f"doc_id long, {label} int")
    assert all(r["score"] in (0.5, 1.0, 2 / 3) for r in score(docs, one, F.lit(True)).collect())
    both = spark.createDataFrame([(i, i % 2) for i in range(1, 40)], f"doc_id long, {label} int")
    more = make_docs(ROWS + [(i, "calm text of day" if i % 2 else "loud noise !!!") for i in range(10, 40)])
    got = score(more, both, F.lit(True)).collect()
    assert len(got) == len(ROWS) + 30 and all(0 <= r["score"] <= 1 for r in got)
    assert score(make_docs([]), both, F.lit(True)).collect() == []


def test_continuation_counts_are_of_different_words(spark, make_docs):
    from nextcover.llm.common import packed_texts

    rows = packed_texts(make_docs([(1, "a x b x a x"), (2, "c x")]).selectExpr("doc_id", "text", "CAST(doc_id = 1 AS INT) AS toxic"))
    got = sorted((r["toxic"], r["ordinary"], r["either"]) for r in continuation_counts(rows).collect())
    # x: after a, b and c; a: at the start and after x; b after x; c at the start
    assert got == [(0, 1, 1), (1, 0, 1), (2, 0, 2), (2, 1, 3)]


def test_rows_beyond_the_curve_sample_are_counted(spark, make_docs, monkeypatch):
    import nextcover.llm.toxicity as module

    seen = []

    def counted(labelled):
        seen.extend(r["doc_id"] for r in labelled.select("doc_id").collect())
        return continuation_counts(labelled)

    monkeypatch.setattr(module, "CURVE_ROWS", 3)
    monkeypatch.setattr(module, "continuation_counts", counted)
    docs = make_docs([(i, "calm text of day" if i % 2 else "loud noise here") for i in range(60)])
    labels = spark.createDataFrame([(i, 1 - i % 2) for i in range(60)], "doc_id long, toxic int")
    assert len(module.toxicity_scores(docs, labels, F.lit(True)).collect()) == 60
    assert len(seen) == len(set(seen)) == 57


def plain_evidence(texts, marks):
    """Kneser-Ney by plain Python: the evidence of each text, the counts from those with a mark."""
    split = lambda t: re.findall("[0-9a-z\x80-\U0010ffff]+", (t or "").lower())
    pairs = {c: set() for c in (0, 1)}
    for i, c in marks.items():
        w = split(texts[i])
        pairs[c] |= set(zip([None, *w], w))
    n = {c: {} for c in (0, 1, 2)}
    for c, found in [*pairs.items(), (2, pairs[0] | pairs[1])]:
        for _, w in found:
            n[c][w] = n[c].get(w, 0) + 1

    def p(c, w):
        total, free = sum(n[c].values()), sum(min(v, DISCOUNT) for v in n[c].values())
        return (max(n[c].get(w, 0) - DISCOUNT, 0) + free * max(n[2].get(w, 0), 0.5) / sum(n[2].values())) / total

    ratio = {w: math.log(p(1, w) / p(0, w)) for t in texts.values() for w in split(t)}
    out = {}
    for i, t in texts.items():
        v = [ratio[w] for w in split(t)]
        k = min(4, len(v))
        out[i] = (sum(v) / len(v), max(sum(v[a:a + k]) / k for a in range(len(v) - k + 1)), sum(sorted(v)[-3:]) / min(3, len(v))) if v else (0, 0, 0)
    return out


@pytest.mark.parametrize("front", [1 << 20, 40, 0])
def test_evidence_equals_a_plain_scorer_wherever_the_list_is_cut(spark, make_docs, monkeypatch, front):
    import nextcover.llm.toxicity as module

    monkeypatch.setattr(module, "FRONT", front)
    r = random.Random(3)
    word = lambda c: f"{'bad' if c and r.random() < .2 else 'w'}{int(r.paretovariate(.6)) % 300}É"
    texts = {i: " ".join(word(i % 3 == 0) for _ in range(r.randint(0, 60))) for i in range(200)} | {900: None, 901: "", 902: "never seen", 903: "w1 " * 30000}
    docs = make_docs(list(texts.items()) + [(5, texts[5])])
    marks = {i: int(i % 3 == 0) for i in range(120)}
    labelled = module.packed_texts(docs.where("doc_id < 120").dropDuplicates(["doc_id"]).selectExpr("doc_id", "text", "CAST(doc_id % 3 = 0 AS INT) AS toxic"))
    ratios = module.log_ratios(module.continuation_counts(labelled))
    assert (ratios.rest is None) == (front > 40) and len(ratios.front.value[0]) <= front
    got = module.evidence(module.texts_of(docs), ratios).collect()
    want = plain_evidence(texts, marks)
    assert sorted(x["doc_id"] for x in got) == sorted([*texts, 5])
    for x in got:
        assert np.allclose((x["whole"], x["window"], x["words"]), want[x["doc_id"]], atol=1e-5), x


def test_logistic_curve_separates():
    x = np.array([[0.0], [1.0], [2.0], [3.0]])
    w = logistic_curve(x, np.array([0, 0, 1, 1.0]))
    assert ((x[:, 0] * w[0] + w[1] > 0) == [False, False, True, True]).all()


def test_gradients_equal_finite_differences():
    import pyarrow as pa

    r = np.random.default_rng(0)
    x, first = passages(pa.array(["one two two three " * 90, "", None, "FOUR!! | five ### " * 60]))
    assert x.shape == (first[-1], FEATURES) and list(np.diff(first))[1:3] == [1, 1]
    net, y = Network(x.mean(0), x.std(0) + 0.1), np.array([1, 0, 1, 0], np.float32)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}

    def loss():
        p = net.scores(x, first)
        return -(y * np.log(p) + (1 - y) * np.log(1 - p)).mean()

    g = net.gradients(x, first, y)
    for k, v in net.p.items():
        i = tuple(r.integers(n) for n in v.shape)
        old, step = v[i], 1e-5
        v[i] = old + step
        up = loss()
        v[i] = old - step
        down = loss()
        v[i] = old
        assert abs((up - down) / (2 * step) - g[k][i]) < 1e-4
