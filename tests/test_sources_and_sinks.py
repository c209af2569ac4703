import pytest
from pyspark.sql import functions as F

from conftest import rows
from nextcover import schemas
from nextcover.session import checkpointed
from nextcover.sources import readers, writers

CSV = 'id,amount,name\n1,2.5,"a, b"\n2,oops,c\n3,4.5,d,extra\n4,5.5,e\n'


@pytest.fixture()
def csv_file(tmp_path):
    p = tmp_path / "in.csv"
    p.write_text(CSV)
    return str(p)


def test_csv_drops_keeps_or_fails(spark, csv_file):
    schema = "id int, amount double, name string"
    assert rows(readers.read_csv_tolerant(spark, csv_file, schema)) == [(1, 2.5, "a, b"), (4, 5.5, "e")]
    kept = readers.read_csv_tolerant(spark, csv_file, schema, bad="permissive")
    assert kept.count() == 4 and kept.filter("_corrupt_record IS NOT NULL").count() == 2
    with pytest.raises(Exception):
        readers.read_csv_tolerant(spark, csv_file, schema, bad="fail").collect()


def test_csv_without_quotes(spark, tmp_path):
    p = tmp_path / "q.csv"
    p.write_text('id,name\n1,"x\n2,y\n')
    assert rows(readers.read_csv_tolerant(spark, str(p), "id int, name string", quote="")) == [(1, '"x'), (2, "y")]


def test_dropped_lines_do_not_depend_on_columns(spark, csv_file):
    assert readers.read_csv_tolerant(spark, csv_file, "id int, amount double, name string").select("id").count() == 2


def test_replace_table_and_partitions(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "x int, p string")
    writers.replace_table(df, "t_plain")
    writers.replace_table(df.filter("x = 1"), "t_plain")
    assert rows(readers.read_table(spark, "t_plain")) == [(1, "a")]
    writers.replace_table(df, "t_parts", partition_by=["p"])
    writers.replace_table(spark.createDataFrame([(7, "b")], "x int, p string"), "t_parts", partition_by=["p"])
    assert rows(readers.read_table(spark, "t_parts"), "x", "p") == [(1, "a"), (7, "b")]


def test_replace_accepts_new_columns(spark):
    writers.replace_table(spark.createDataFrame([(1, "a")], "x int, gone string"), "t_merge")
    writers.replace_table(spark.createDataFrame([(2, 0.5)], "x int, fresh double"), "t_merge", merge_schema=True)
    assert rows(spark.table("t_merge"), "x", "gone", "fresh") == [(2, None, 0.5)]


@pytest.mark.parametrize("mode", ["static", "dynamic", None])
def test_other_partitions_stay_whatever_the_sessions_mode(spark, mode):
    name, option = f"t_parts_{mode}", "spark.sql.sources.partitionOverwriteMode"
    before = spark.conf.get(option)
    if mode:
        spark.conf.set(option, mode)
    else:
        spark.conf.unset(option)
    try:
        at_start = spark.conf.get(option)
        df = spark.range(100).selectExpr("id AS x", "CAST(id % 5 AS STRING) AS p")
        writers.replace_table(df, name, partition_by=["p"])
        writers.replace_table(df.filter("p = '3'").withColumn("x", -F.col("x")), name, partition_by=["p"])
        assert spark.conf.get(option) == at_start
        table = spark.table(name)
        assert table.count() == 100 and table.filter("x < 0").count() == 20
        writers.write_metadata(df.selectExpr("x AS product", "CAST(p AS INT) AS training_month"), f"{name}_meta")
        writers.write_metadata(df.filter("p = '2'").selectExpr("x + 1000 AS product", "CAST(p AS INT) AS training_month"), f"{name}_meta")
        assert spark.table(f"{name}_meta").count() == 100
    finally:
        spark.conf.set(option, before)


RUN = "run_key string, score double, at int"


def write_run(spark, name, month, data):
    writers.write_run(spark.createDataFrame(data, RUN), name, "month", month, ["run_key"], [F.col("at").desc(), F.col("score").desc()])


def test_a_second_run_replaces_the_first_as_a_whole(spark):
    write_run(spark, "t_runs", 200111, [("a", 0.1, 1), ("b", 0.2, 1)])
    write_run(spark, "t_runs", 200112, [("a", 0.3, 1), ("a", 0.4, 2), ("a", 0.5, 2), ("c", 0.6, 1)])
    assert rows(spark.table("t_runs"), "month", "run_key", "score") == [(200111, "a", 0.1), (200111, "b", 0.2), (200112, "a", 0.5), (200112, "c", 0.6)]
    write_run(spark, "t_runs", 200112, [("d", 0.7, 1)])
    assert rows(spark.table("t_runs"), "month", "run_key", "score") == [(200111, "a", 0.1), (200111, "b", 0.2), (200112, "d", 0.7)]


def test_a_run_that_dies_midway_changes_nothing(spark):
    write_run(spark, "t_dying", 200112, [("a", 0.1, 1), ("b", 0.2, 1)])
    bad = spark.range(4000).selectExpr(
        "CAST(id AS STRING) AS run_key", "CAST(IF(id = 3999, raise_error('killed'), id) AS DOUBLE) AS score", "1 AS at").repartition(8, "run_key")
    for month in (200112, 200201):
        with pytest.raises(Exception, match="killed"):
            writers.write_run(bad, "t_dying", "month", month, ["run_key"], [F.col("at")])
        assert rows(spark.table("t_dying"), "month", "run_key", "score") == [(200112, "a", 0.1), (200112, "b", 0.2)]
    write_run(spark, "t_dying", 200112, [("c", 0.3, 1)])
    write_run(spark, "t_dying", 200201, [("c", 0.4, 1)])
    assert rows(spark.table("t_dying"), "month", "run_key", "score") == [(200112, "c", 0.3), (200201, "c", 0.4)]


def test_runs_by_text_and_of_no_rows(spark):
    writers.write_run(spark.createDataFrame([("a", 1.0, 1)], RUN), "t_text", "run", "it's 1", ["run_key"], [F.col("at")])
    writers.write_run(spark.createDataFrame([("b", 1.0, 1)], RUN), "t_text", "run", "2", ["run_key"], [F.col("at")])
    assert rows(spark.table("t_text"), "run", "run_key") == [("it's 1", "a"), ("2", "b")]
    writers.write_run(spark.createDataFrame([], RUN), "t_text", "run", "2", ["run_key"], [F.col("at")])
    assert rows(spark.table("t_text"), "run", "run_key") == [("it's 1", "a")]


def test_metadata_and_feature_sets(spark):
    def meta(month, features):
        return spark.createDataFrame([("investment", features, 0.8, "p", month)],
                                     "product string, features array<string>, roc_auc double, model_path string, training_month int")

    writers.write_metadata(meta(200111, ["a", "b"]), "t_meta")
    writers.write_metadata(meta(200112, ["a", "c"]), "t_meta")
    writers.write_metadata(meta(200112, ["a", "d"]), "t_meta")
    table = spark.table("t_meta")
    assert rows(readers.read_feature_sets(table, 200201)) == [("investment", 200112, ["a", "d"])]
    assert rows(readers.read_feature_sets(table, 200111)) == [("investment", 200111, ["a", "b"])]


def test_splits_views_and_fallback(spark, tmp_path):
    df = readers.rows_df(spark, [(1, "x"), (2, "y")], "a int, b string")
    writers.write_splits({"train": df.filter("a = 1"), "test": df.filter("a = 2")}, str(tmp_path / "splits"))
    assert rows(readers.read_parquet(spark, str(tmp_path / "splits" / "test"), "a int, b string")) == [(2, "y")]
    writers.as_view(df, "v_small")
    assert rows(readers.read_sql(spark, "SELECT a FROM v_small WHERE a > :low", args={"low": 1})) == [(2,)]
    assert readers.read_or_empty(spark, "no_such_table", "a int").count() == 0
    writers.replace_table(df, "t_some")
    assert rows(readers.read_or_empty(spark, "t_some", "a long, c double")) == [(1, None), (2, None)]


def test_latest_month_has_no_driver_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, 200111), (2, 200112)], "a int, business_month int")
    df.write.partitionBy("business_month").parquet(str(tmp_path / "m"))
    latest = readers.latest_month(spark.read.parquet(str(tmp_path / "m")))
    plan = latest._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(business_month" in plan and "Subquery" in plan
    assert rows(latest, "a") == [(2,)]


def test_required_columns_are_named(spark):
    with pytest.raises(ValueError, match="b, c"):
        schemas.require_columns(spark.createDataFrame([(1,)], "a int"), ["a", "b", "c"])


def test_compatible_model():
    from nextcover.operators.clean import compatible

    meta = {"features": ["a", "b"], "classes": [1, 2, 3]}
    assert compatible(meta, ["x", "y"], ["p", "q", "r"]) and not compatible(meta, ["x"], ["p", "q", "r"])


def test_checkpoint_cuts_lineage(spark):
    df = checkpointed(spark.range(10).withColumn("x", F.col("id") * 2))
    assert df.count() == 10
    assert "Range" not in df._jdf.queryExecution().logical().toString()


def test_policy_view_matches_the_declared_schema(spark, tables):
    declared = spark.createDataFrame([], schemas.POLICY_DDL)
    assert {f.name: f.dataType for f in declared.schema} == {f.name: f.dataType for f in tables.policies.schema}
