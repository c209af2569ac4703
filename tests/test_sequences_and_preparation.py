import random
from datetime import date

import pytest
from pyspark.sql import functions as F

from conftest import rows
from nextcover.operators import prep, sequences as sq


def test_dedupe_golden(spark):
    df = spark.createDataFrame([(["L", "L", "I", "I", "R"],), (["I", "R", "R", "I"],), ([],)], "s array<string>")
    assert [r[0] for r in df.select(sq.dedupe_consecutive("s")).collect()] == [["L", "I", "R"], ["I", "R", "I"], []]


def test_vocabularies(spark):
    names = ["DISABILITY", "HEALTH", "INVESTMENT", "LIFE_INSURANCE", "NETWORK_PRODUCTS", "OTHER", "RETIREMENT"]
    df = spark.createDataFrame([(n,) for i, n in enumerate(names) for _ in range(1 + (i * 3) % 7)], "value string")
    assert rows(sq.vocab_alpha(df)) == [(n, i) for i, n in enumerate(names, 1)]
    frequent = sorted(sq.vocab_freq(df).collect(), key=lambda r: r.id)
    assert [r.id for r in frequent] == list(range(7))
    assert all(a.frequency >= b.frequency for a, b in zip(frequent, frequent[1:]))


def test_sliding_examples_golden(spark):
    df = spark.createDataFrame([("c", i, v) for i, v in enumerate([3, 2, 3, 3, 3], 1)], "party_id string, position long, id int")
    got = [(r.history, r.label) for r in sq.sliding_examples(df).orderBy("position").collect()]
    assert got == [([3], 2), ([3, 2], 3), ([3, 2, 3], 3), ([3, 2, 3, 3], 3)]
    assert rows(sq.scoring_history(df, 2), "history") == [([3, 3],)]


def test_history_features_golden(spark):
    df = spark.createDataFrame([([4, 3],), ([],), ([1, 2, 2, 1, 5],)], "history array<int>")
    out = sq.history_features_ext(sq.history_features(sq.pad_history(df), 7)).collect()
    a, b, c = out
    assert (a.seq_len, a.last_1, a.last_2, a.unique_prior, a.num_switches, a.freq_3, a.freq_4, a.freq_5) == (2, 3, 4, 2, 1, 1, 1, 0)
    assert [a[f"hist_{i}"] for i in range(10)] == [0] * 8 + [4, 3]
    assert (b.seq_len, b.last_1, b.most_freq_product, b.diversity_ratio, b.transition_pattern) == (0, 0, 0, 0.0, 0)
    assert (c.last_3, c.num_switches, c.most_freq_product, c.recency_weight, c.transition_pattern) == (2, 3, 1, 1 + 4 + 6 + 4 + 25.0, 501)
    assert c.diversity_ratio == pytest.approx(0.6) and c.switch_ratio == pytest.approx(0.6)


def test_long_history_is_cut_from_the_left(spark):
    df = spark.createDataFrame([(list(range(1, 15)),)], "history array<int>")
    row = sq.pad_history(df).first()
    assert [row[f"hist_{i}"] for i in range(10)] == list(range(5, 15))


def test_fill_values_come_from_train(spark):
    train = spark.createDataFrame([(1.0, "a"), (3.0, "a"), (None, "b"), (8.0, None)], "x double, s string")
    other = spark.createDataFrame([(None, None)], "x double, s string")
    out = prep.apply_fill(prep.apply_fill(other, prep.fit_medians(train, ["x"])), prep.fit_modes(train, ["s"]))
    assert rows(out) == [(3.0, "a")]
    nulls = spark.createDataFrame([(None,), (None,), ("b",)], "s string")
    assert rows(prep.fit_modes(nulls, ["s"])) == [("UNKNOWN",)]


def test_encoder_unseen_and_null(spark):
    train = spark.createDataFrame([("b",), ("a",), (None,)], "s string")
    enc = prep.fit_encoder(train, ["s"])
    assert rows(enc) == [("s", "UNKNOWN", 0), ("s", "a", 1), ("s", "b", 2)]
    got = prep.encode(spark.createDataFrame([("a",), (None,), ("zz",)], "s string"), enc, ["s"])
    assert rows(got, "s", "s_idx") == sorted([("a", 1), (None, 0), ("zz", -1)], key=repr)


def test_weights(spark):
    df = spark.createDataFrame([("a",)] * 90 + [("b",)] * 9 + [("c",)] * 1, "y string")
    balanced = {r.y: r.weight for r in prep.class_weights(df, "y").collect()}
    assert balanced["a"] == pytest.approx(100 / 270) and balanced["c"] == pytest.approx(100 / 3)
    capped = {r.y: r.weight for r in prep.class_weights(df, "y", "sqrt_cap").collect()}
    assert capped["a"] == pytest.approx(max((100 / 270) ** 0.5, 0.5)) and capped["c"] == pytest.approx((100 / 3) ** 0.5)
    mean = prep.class_weights(df, "y", "sqrt_mean").agg(F.avg("weight")).first()[0]
    assert mean == pytest.approx(sum(balanced.values()) / 3)


def test_target_encoding_leaves_the_own_fold_out(spark):
    train = spark.createDataFrame([("x", "A", 0), ("x", "A", 1), ("x", "B", 1), ("y", "B", 0)], "k string, y string, f int")
    val = spark.createDataFrame([("x", "A"), ("new", "B")], "k string, y string")
    t, v = prep.target_encode(train, val, ["k"], "y", ["A"], smoothing=2.0, fold=F.col("f"))
    got = {(r.k, r.f): r.te_k_A for r in t.select("k", "f", "te_k_A").distinct().collect()}
    assert got[("x", 0)] == pytest.approx((1 + 0.5 * 2) / (2 + 2))
    assert got[("x", 1)] == pytest.approx((1 + 0.5 * 2) / (1 + 2))
    assert got[("y", 0)] == pytest.approx(0.5)
    assert {r.k: r.te_k_A for r in v.collect()} == {"x": pytest.approx((2 + 1.0) / 5), "new": pytest.approx(0.5)}


def test_splits_and_oversampling(spark):
    df = spark.createDataFrame([(i, "a" if i % 20 else "b", date(2000, 1, 1)) for i in range(400)], "k long, y string, d date")
    parts = prep.split_stratified(df, "y", key=["k"])
    counts = {(r.y, r.split): r["count"] for r in parts.groupBy("y", "split").count().collect()}
    assert counts == {("a", "train"): 304, ("a", "validation"): 76, ("b", "train"): 16, ("b", "validation"): 4}
    again = prep.split_stratified(df.repartition(7), "y", key=["k"])
    assert rows(parts, "k", "split") == rows(again, "k", "split")
    more = prep.oversample(df, "y", ["k"])
    assert rows(more.groupBy("y").count()) == [("a", 380), ("b", 57)]
    assert more.filter("copy_no = 1").count() == 400
    assert prep.sample_capped(df, 1000, ["k"]).count() == 400


def test_feature_selection(spark):
    df = spark.createDataFrame(
        [(float(i % 2), float(i % 2), 1.0, float(i), "x" if i % 3 else "y") for i in range(60)],
        "investment_cross_sell double, acct_val_amt double, constant double, noise double, channel string")
    out = {r.feature: r for r in prep.select_features(df, "investment_cross_sell", ["acct_val_amt", "constant", "noise", "channel"], min_features=1).collect()}
    assert out["acct_val_amt"].rank == 1 and out["acct_val_amt"].combined_score == pytest.approx(1.0)
    assert out["constant"].correlation == 0 and out["constant"].selected == 0 and out["channel"].selected == 1


def test_interpolated_rows_lie_between_rows_of_their_class(spark):
    rng = random.Random(4)
    data = [(f"k{i}", "big", rng.random(), rng.random() * 100) for i in range(400)]
    data += [(f"s{i}", "small", 5 + rng.random(), -rng.random()) for i in range(9)]
    data += [("one", "single", 7.0, 7.0), ("gap", "small", None, 1.0)]
    df = spark.createDataFrame(data, "k string, y string, a double, b double").repartition(5)
    made = prep.interpolate_minority(df, "y", ["a", "b"], ["k"]).collect()
    known = {k: (y, a, b) for k, y, a, b in data}
    assert {y: sum(r["y"] == y for r in made) for y in ("small", "single", "big")} == {"small": 60 - 9, "single": 60 - 1, "big": 0}
    assert len({(r["k"], r["copy_no"]) for r in made}) == len(made) and not any("gap" in (r["k"], r["neighbour_k"]) for r in made)
    for r in made:
        x, n = known[r["k"]], known[r["neighbour_k"]]
        assert x[0] == n[0] == r["y"] and 0 <= r["weight"] < 1
        assert (r["k"] != r["neighbour_k"]) == (r["y"] == "small")
        assert r["a"] == pytest.approx(x[1] + r["weight"] * (n[1] - x[1])) and r["b"] == pytest.approx(x[2] + r["weight"] * (n[2] - x[2]))
    again = prep.interpolate_minority(df.repartition(2), "y", ["a", "b"], ["k"]).collect()
    assert sorted(map(tuple, made)) == sorted(map(tuple, again))
