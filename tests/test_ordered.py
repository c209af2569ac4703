"""Hot keys, chunk borders and exact ranks give the same rows as plain windows."""

import random
import re
from datetime import date, timedelta

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from conftest import rows
from nextcover.operators import ordered, quantiles, scoring
from nextcover.operators.sequences import client_sequences, collapse_repeats, collapsed_sequences


@pytest.fixture(scope="module")
def skewed(spark):
    """One client holds most of the rows, several share a day."""
    rng = random.Random(7)
    data = []
    for i in range(3000):
        party = "big" if rng.random() < 0.6 else f"c{rng.randrange(200)}"
        day = date(2000, 1, 1) + timedelta(days=rng.randrange(40))
        data.append((party, day, f"p{i:05d}", rng.choice("ABC"), rng.randrange(5)))
    return spark.createDataFrame(data, "party_id string, register_date date, policy_no string, value string, score int").repartition(6).cache()


ORDER = ["register_date", "policy_no"]


@pytest.mark.parametrize("floor", [10**9, 100, 0])
@pytest.mark.parametrize("descending", [False, True])
def test_numbers_and_neighbours(skewed, floor, descending):
    got = ordered.with_order(
        skewed, "party_id", ORDER, number="n", ahead={"value": "next_value"}, behind={"value": "last_value", "score": "last_score"},
        descending=descending, floor=floor)
    w = Window.partitionBy("party_id").orderBy(*[F.col(c).desc() if descending else F.col(c) for c in ORDER])
    want = skewed.select(
        "*", F.row_number().over(w).cast("long").alias("n"), F.lead("value").over(w).alias("next_value"),
        F.lag("value").over(w).alias("last_value"), F.lag("score").over(w).alias("last_score"))
    columns = ["policy_no", "n", "next_value", "last_value", "last_score"]
    assert rows(got, *columns) == rows(want, *columns)


def test_every_key_above_its_share_is_hot(skewed, monkeypatch):
    assert rows(ordered.hot_keys(skewed, "party_id", floor=100), "party_id") == [("big",)]
    counts = skewed.groupBy("party_id").count()
    assert ordered.hot_keys(skewed, "party_id", floor=0).count() == counts.count()
    monkeypatch.setattr(ordered, "TASK_SHARE", 300)  # 3000 rows: more than ten
    assert rows(ordered.hot_keys(skewed, "party_id", floor=0), "party_id") == rows(counts.filter("count > 10"), "party_id")


def test_slices_cut_one_day_of_one_prefix(spark, monkeypatch):
    """All rows of a client on one day, with policy numbers that share a long prefix."""
    monkeypatch.setattr(ordered, "MOST_SLICES", 20)
    df = spark.range(4000).selectExpr("'big' AS party_id", "DATE '2000-01-01' AS register_date", "concat('0000000', lpad(CAST(id AS STRING), 6, '0')) AS policy_no")
    cut = ordered.sliced(df, "party_id", ORDER, floor=10)
    sizes = [r["count"] for r in cut.groupBy("_slice").count().collect()]
    assert len(sizes) > 8 and max(sizes) < 4000 / 3
    got = ordered.with_order(df, "party_id", ORDER, number="n", ahead={"policy_no": "following"}, floor=10)
    w = Window.partitionBy("party_id").orderBy(*ORDER)
    want = df.select("*", F.row_number().over(w).cast("long").alias("n"), F.lead("policy_no").over(w).alias("following"))
    assert rows(got, "policy_no", "n", "following") == rows(want, "policy_no", "n", "following")


def test_repeats_do_not_depend_on_parts(spark):
    data = [("a", date(2000, 1, 1 + i), f"p{i}", v) for i, v in enumerate("AAAAAAAABBABBBB")]
    numbered = ordered.with_order(spark.createDataFrame(data, "party_id string, register_date date, policy_no string, value string")
                                  .withColumn("numbers", F.array().cast("array<double>")), "party_id", ORDER, number="position")
    for part in (2, 4, 100):
        parts = collapsed_sequences(numbered, part_rows=part).orderBy("part").collect()
        assert "".join("".join(r["sequence"]) for r in parts) == "ABAB"


@pytest.mark.parametrize("floor", [10**9, 100])
def test_totals_with_a_hot_client(skewed, floor):
    got = ordered.with_totals(skewed, "party_id", {"mean": F.avg("score"), "n": F.count(F.lit(1))}, floor=floor)
    w = Window.partitionBy("party_id")
    want = skewed.select("*", F.avg("score").over(w).alias("mean"), F.count(F.lit(1)).over(w).alias("n"))
    assert rows(got, "policy_no", F.round("mean", 9), "n") == rows(want, "policy_no", F.round("mean", 9), "n")


def test_a_hot_client_is_spread_over_tasks(spark):
    """One client with nine tenths of the rows: no task of the join gets more than a share of it."""
    df = spark.range(20_000).selectExpr("IF(id % 10 < 9, 'big', concat('c', id)) AS party_id", "id AS score")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = ordered.with_totals(df, "party_id", {"n": F.count(F.lit(1))}, floor=1000).repartition(1).withColumn("p", F.lit(1))
        assert got.filter("party_id = 'big'").agg(F.min("n"), F.max("n"), F.count("*")).first() == (18_000, 18_000, 18_000)
        salted = df.withColumn("_salt", F.pmod(F.xxhash64("party_id", "score"), F.lit(256)))
        assert salted.groupBy("_salt").count().agg(F.max("count")).first()[0] < 200
        plan = ordered.with_totals(df, "party_id", {"n": F.count(F.lit(1))}, floor=1000)._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning(party_id" in plan and "_salt" in plan.split("SortMergeJoin")[1].splitlines()[0]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("floor", [10**9, 50, 0])
def test_collapse_repeats(skewed, floor):
    w = Window.partitionBy("party_id").orderBy(*ORDER)
    before = F.lag("value").over(w)
    want = skewed.withColumn("b", before).filter("b IS NULL OR b <> value").withColumn("position", F.row_number().over(w).cast("long"))
    got = collapse_repeats(skewed, floor=floor)
    assert rows(got, "policy_no", "value", "position") == rows(want, "policy_no", "value", "position")


@pytest.mark.parametrize("chunk", [7, 100_000])
@pytest.mark.parametrize("current", [False, True])
def test_recent_across_chunks(skewed, chunk, current):
    numbered = ordered.with_order(skewed, "party_id", ORDER, number="position")
    got = ordered.with_recent(numbered, "party_id", "position", {"value": "h"}, 4, include_current=current, chunk_rows=chunk)
    w = Window.partitionBy("party_id").orderBy("position").rowsBetween(-3 if current else -4, 0 if current else -1)
    want = numbered.withColumn("h", F.collect_list("value").over(w))
    assert rows(got, "policy_no", F.array_join("h", "")) == rows(want, "policy_no", F.array_join("h", ""))


def test_sequences_in_parts_are_whole(skewed):
    numbered = ordered.with_order(skewed.withColumn("numbers", F.array().cast("array<double>")), "party_id", ORDER, number="position")
    parts = client_sequences(numbered, part_rows=50)
    assert parts.agg(F.max("events")).first()[0] == 50
    assert parts.agg(F.sum("events")).first()[0] == skewed.count()


def test_rank_limit_runs_before_the_shuffle(skewed):
    plan = ordered.latest_by(skewed, ["party_id"], ORDER)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_exact_quantiles(skewed, spark):
    data = [(g, float(v)) for g, n in (("a", 1), ("b", 10), ("c", 777)) for v in [random.Random(g).randrange(50) * 1.5 for _ in range(n)]]
    df = spark.createDataFrame(data, "g string, v double")
    got = {(r.g, r.p): r.quantile for r in quantiles.exact_quantiles(df, ["g"], "v", [0.0, 0.1, 0.5, 0.99, 1.0]).collect()}
    want = df.groupBy("g").agg(F.percentile("v", [0.0, 0.1, 0.5, 0.99, 1.0]).alias("q")).collect()
    for r in want:
        for p, q in zip([0.0, 0.1, 0.5, 0.99, 1.0], r.q):
            assert got[(r.g, p)] == pytest.approx(q)


def test_exact_ranks_of_heavy_tails(spark):
    """Values over thirty powers of ten, negative ones and ties, over many partitions."""
    df = spark.range(5000).selectExpr("IF(id % 3 = 0, -1, 1) * exp(pmod(xxhash64(id), 7000) / 100.0 - 35) AS v", "'g' AS g").union(
        spark.range(500).selectExpr("CAST(0 AS DOUBLE)", "'g'")).repartition(31)
    got = quantiles.value_ranks(df, ["g"], "v")
    w = Window.orderBy("v")
    want = df.select("v", (F.rank().over(w) - 1).cast("long").alias("before")).distinct()
    assert rows(got, "v", "before") == rows(want, "v", "before")
    assert "percentile_approx" not in got._jdf.queryExecution().executedPlan().toString()
    sliced = quantiles.value_slices(df, ["g"], "v", slice_values=10)
    assert sliced.groupBy("_slice").count().agg(F.max("count")).first()[0] < 100
    assert rows(quantiles.value_ranks(df, ["g"], "v", slice_values=10), "v", "before") == rows(want, "v", "before")


@pytest.mark.parametrize("slice_values", [1, 300, 10**9])
def test_exact_ranks_of_a_narrow_range(spark, slice_values):
    """Distinct values within a thousandth of each other are spread over slices all the same."""
    df = spark.range(6000).selectExpr("1.7e9D + id AS v", "IF(id < 5000, 'a', 'b') AS g").repartition(7)
    slices = quantiles.value_slices(df, ["g"], "v", 300).groupBy("_slice").count()
    assert slices.count() > 10 and slices.agg(F.max("count")).first()[0] < 3000
    got = quantiles.value_ranks(df, ["g"], "v", slice_values)
    assert rows(got, "g", "v", "before", "total") == sorted(
        [("a", 1.7e9 + i, i, 5000) for i in range(5000)] + [("b", 1.7e9 + i, i - 5000, 1000) for i in range(5000, 6000)], key=repr)


def test_ranks_of_nan_null_and_signed_zero(spark):
    nan, inf = float("nan"), float("inf")
    df = spark.createDataFrame([(x,) for x in (nan, None, inf, -inf, 0.0, -0.0, 5e-324, -1.0, nan)], "v double").withColumn("g", F.lit(None).cast("string"))
    got = [(repr(r["v"]), r["before"], r["total"]) for r in quantiles.value_ranks(df.fillna("x", ["g"]), ["g"], "v", 1).orderBy("before").collect()]
    assert got == [("-inf", 0, 8), ("-1.0", 1, 8), ("0.0", 2, 8), ("5e-324", 4, 8), ("inf", 5, 8), ("nan", 6, 8)]


def test_ranks_with_ties_and_constant_deciles(spark):
    df = spark.createDataFrame([(f"c{i}", float(i % 4), 1.0) for i in range(40)], "party_id string, a_score double, b_score double")
    ranked = scoring.score_ranks(df, ["a_score", "b_score"])
    w = Window.orderBy(F.desc("a_score"))
    assert rows(ranked, "party_id", "a_rank") == rows(df.withColumn("a_rank", F.rank().over(w).cast("long")), "party_id", "a_rank")
    assert ranked.select("b_rank").distinct().collect()[0][0] == 1
    # coinciding edges fall back to equal width; a constant score lands in one bin
    deciles = scoring.score_deciles(df, ["a_score", "b_score"])
    assert rows(deciles.select("a_score", "a_decile").distinct()) == [(0.0, 10), (1.0, 7), (2.0, 4), (3.0, 1)]


def test_order_and_partitions_do_not_matter(skewed):
    a = ordered.with_order(skewed, "party_id", ORDER, number="n", floor=100)
    b = ordered.with_order(skewed.orderBy(F.desc("policy_no")).repartition(3), "party_id", ORDER, number="n", floor=100)
    assert rows(a, "policy_no", "n") == rows(b, "policy_no", "n")


@pytest.mark.parametrize("floor", [10**9, 3, 1])
def test_null_keys_and_null_values_are_like_others(spark, floor):
    data = [(k, date(2000, 1, 1 + i), f"p{i}", v) for k in ("a", None, "b") for i, v in enumerate(["A", None, "A", None, None, "B", "B", None, "B"])]
    df = spark.createDataFrame(data, "party_id string, register_date date, policy_no string, value string").repartition(5)
    got = collapse_repeats(df, floor=floor).orderBy("party_id", "position").collect()
    for k in ("a", None, "b"):
        assert [r["value"] for r in got if r["party_id"] == k] == ["A", None, "A", None, "B", None, "B"]
        assert [r["position"] for r in got if r["party_id"] == k] == list(range(1, 8))
    numbered = ordered.with_order(df, "party_id", ORDER, number="n", behind={"value": "last", "policy_no": "last_policy"}, floor=floor).orderBy("party_id", "n").collect()
    for k in ("a", None, "b"):
        own = [r for r in numbered if r["party_id"] == k]
        assert [r["n"] for r in own] == list(range(1, 10))
        assert [r["last"] for r in own] == [None, *[r["value"] for r in own[:-1]]]
        assert [r["last_policy"] for r in own] == [None, *[r["policy_no"] for r in own[:-1]]]


def test_the_input_is_read_three_times(spark, tmp_path):
    """For the cuts (planned for each use, run once), the rows and what crosses the cuts."""
    spark.range(50).selectExpr("CAST(id % 3 AS STRING) AS party_id", "id AS policy_no", "current_date() AS register_date").write.parquet(str(tmp_path / "t"))
    df = ordered.with_order(spark.read.parquet(str(tmp_path / "t")), "party_id", ORDER, number="n", ahead={"policy_no": "following"})
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") <= 6
    df.collect()
    final = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert len(set(re.findall(r"Subquery subquery#(\d+)", final))) <= 1


def test_salts_follow_the_rows_of_a_key(spark, monkeypatch):
    monkeypatch.setattr(ordered, "TASK_SHARE", 100)
    df = spark.range(40_000).selectExpr("IF(id % 10 < 9, 'big', concat('c', id)) AS party_id", "id AS score")
    right = df.groupBy("party_id").agg(F.count("*").alias("n"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = ordered.join_by_key(df, right, "party_id", floor=1, rows="n")
        assert got.filter("party_id = 'big'").agg(F.min("n"), F.count("*")).first() == (36_000, 36_000)
        hot = right.filter("n > 400").select(F.ceil(F.col("n") / 400))
        assert hot.first()[0] == 90
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
