"""Physical plans: what is read, what is shuffled."""

import re

import pytest

from nextcover.operators import policies as pol
from nextcover.plans.next_product import likely_next_products
from nextcover.plans.training import training_base
from conftest import SF_DIR, rows


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_clients_are_trimmed_before_their_shuffle(tables):
    plan = plan_of(likely_next_products(tables.policies, tables.lookup))
    client = [i for i, line in enumerate(plan.splitlines()) if "hashpartitioning(party_id" in line]
    assert len(client) == 1
    assert "WindowGroupLimit" in plan.splitlines()[client[0] + 1]


def test_unused_columns_are_not_read(tables):
    plan = plan_of(likely_next_products(tables.policies, tables.lookup))
    read = re.findall(r"ReadSchema: struct<([^>]*)>", plan)
    assert not any("c_acctbal" in r or "c_mktsegment" in r or "o_totalprice" in r for r in read)


def test_filters_reach_the_scan(tables):
    plan = plan_of(tables.raw("orders").filter("o_orderstatus = 'F' AND o_totalprice > 1000").select("o_orderkey"))
    assert "EqualTo(o_orderstatus,F)" in plan and "GreaterThan(o_total" in plan


@pytest.mark.parametrize("build", [pol.event_index, pol.next_product])
def test_one_window_shuffle_per_client(tables, build):
    """Without hot clients the border frame is empty and the join with it disappears."""
    from nextcover.functions.classify import classify

    df = build(classify(tables.policies))
    df.collect()
    final = plan_of(df).split("== Initial Plan ==")[0]
    assert final.count("Exchange hashpartitioning(party_id") == 1
    assert "SortMergeJoin" not in final


def test_no_python_workers_in_the_core(tables):
    plan = plan_of(training_base(tables.policies, tables.lookup, "1990-01-01"))
    assert "Python" not in plan and "Pandas" not in plan and "ArrowEval" not in plan


def test_the_newest_month_reads_one_partition(spark):
    from nextcover.sources import readers, writers

    df = spark.range(90).selectExpr("id AS party_id", "CAST(200101 + id % 9 AS INT) AS business_month")
    writers.replace_table(df, "t_months", partition_by=["business_month"])
    newest = readers.latest_partition(spark, "t_months")
    assert newest.count() == 10 and newest.select("business_month").distinct().first()[0] == 200109
    plan = plan_of(newest)
    assert "(business_month" in plan.split("PartitionFilters: [")[1] and "Subquery" not in plan
    newest.collect()
    scan = newest._jdf.queryExecution().executedPlan().collectLeaves().apply(0)
    assert scan.metrics().apply("numPartitions").value() == 1
    writers.replace_table(df.limit(0), "t_no_months", partition_by=["business_month"])
    assert readers.latest_partition(spark, "t_no_months").count() == 0


def test_tables_stored_by_client_join_without_moving_rows(spark):
    from nextcover.operators import monitor
    from nextcover.sources import writers

    rows_ = spark.range(500).selectExpr("CAST(id % 100 AS STRING) AS party_id", "IF(id % 3 = 0, 'A', 'B') AS product_category")
    last = spark.range(100).selectExpr("CAST(id AS STRING) AS party_id", "'A' AS first_product_category", "'B' AS predicted_product", "200111 AS business_month")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        writers.store_by_client(rows_, "t_held", buckets=4)
        writers.store_by_client(last, "t_last", buckets=4)
        joined = spark.table("t_last").join(spark.table("t_held"), "party_id")
        assert "Exchange" not in plan_of(joined) and joined.count() == 500
        got = monitor.prediction_outcome(spark.table("t_last"), spark.table("t_held"), 200112)
        assert "Exchange" not in plan_of(got) and got.count() == 100
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_clients_are_dealt_out_before_they_become_many_rows(spark, monkeypatch):
    from nextcover.operators.explain import top_contributions
    from workload import views

    whole = views.Tables(spark, SF_DIR).contributions
    clients = whole.select("party_id").distinct().count()
    monkeypatch.setattr(views, "CLIENTS_PER_TASK", 10)
    dealt = views.Tables(spark, SF_DIR).contributions
    assert dealt.rdd.getNumPartitions() == -(-clients // 10)
    assert rows(dealt) == rows(whole)
    # the only shuffle is that of the clients, before any row is sorted
    lines = plan_of(top_contributions(dealt)).splitlines()
    shuffles = [i for i, line in enumerate(lines) if "Exchange" in line]
    assert len(shuffles) == 1
    assert max(i for i, line in enumerate(lines) if "Sort [" in line) < shuffles[0]


def test_tables_of_clients_are_not_broadcast(tables):
    from workload.catalog import REGISTRY

    plans = {n: plan_of(REGISTRY[n].build(tables)) for n in ("explanation_rows", "multi_product_strategy", "final_output")}
    assert not [n for n, plan in plans.items() if "BroadcastHashJoin" in plan]
    # tables of clients merge here too, while small frames beside them may be sent to every task
    narrative = plan_of(REGISTRY["client_narrative"].build(tables))
    assert narrative.count("SortMergeJoin") >= 4
    assert "SortMergeJoin" in plan_of(REGISTRY["advisor_smart_list"].build(tables))


@pytest.mark.parametrize("name", ["sequence_model_predictions", "selected_features", "boosted_trees_predictions", "boosted_contributions_add_up", "contributions_of_a_fitted_model"])
def test_a_model_reads_the_policies_once(tables, name):
    from workload.catalog import REGISTRY

    plan = plan_of(REGISTRY[name].build(tables))  # what is left after the fit
    assert "FileScan" in plan and "orders.parquet" not in plan and "InMemoryTableScan" not in plan
    if name == "boosted_contributions_add_up":  # rows are dealt out before each becomes many
        assert "REPARTITION_BY_NUM" in plan


def test_examples_of_sequences_are_kept_for_the_fit(spark, tables, monkeypatch):
    from pyspark.sql import functions as F
    from nextcover.plans import sequence_model as sm
    from workload.sequences import changes

    seen = []
    monkeypatch.setattr(sm, "train_rf", lambda d, *a, **k: seen.append((plan_of(d), d.count())))
    numbered = changes(tables)
    sm.fit_sequence_model(numbered, F.lit(True))
    (plan, n), = seen
    assert "InMemoryTableScan" in plan
    assert n == numbered.filter("position > 1").count()
    assert spark.sparkContext._jsc.getPersistentRDDs().isEmpty()


def test_a_monthly_run_classifies_its_policies_once(tables, monkeypatch):
    from nextcover.plans import monthly_run as mr
    from workload import evaluation

    seen = []
    monkeypatch.setattr(mr, "run_month", lambda policies, people, name, *a, **k: seen.append((policies, people, tables.spark.range(1).createOrReplaceTempView(name))))
    evaluation.run_of_last_month(tables)
    (policies, people, _), = seen
    for rows in (mr.training_population(policies), mr.scoring_population(policies, "2002-01-01"), people):
        assert "FileScan" in plan_of(rows) and "orders.parquet" not in plan_of(rows)
    known = tables.policies.filter(evaluation.EARLY)
    for population in (mr.training_population, lambda p: mr.scoring_population(p, "2002-01-01")):
        assert sorted(map(str, population(policies).collect())) == sorted(map(str, population(known).collect()))
    assert not mr.training_population(policies).isEmpty()


def test_depth_of_fitted_trees(spark):
    from pyspark.sql import functions as F
    from nextcover.operators import models, trees

    df = spark.range(200).select((F.col("id") % 17).cast("double").alias("x"), (F.col("id") % 3).cast("double").alias("label"))
    forest = models.train_rf(df, ["x"], numTrees=2, maxDepth=3)
    boosted = models.train_gbt_ovr(df, ["x"], maxIter=2, maxDepth=2)
    assert trees.depth(forest) == max(t.depth for t in forest.stages[-1].trees) <= 3
    assert 1 <= trees.depth(boosted) <= 2
