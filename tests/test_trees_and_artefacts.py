"""Contributions of trees, stored models and exact areas against Spark ML's own results."""

import pytest
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from conftest import rows
from nextcover.operators import artefacts, models, trees

FEATURES = ["a", "b", "c"]


@pytest.fixture(scope="module")
def train(spark):
    return spark.range(600).selectExpr(
        "id", "CAST(id % 7 AS DOUBLE) AS a", "CAST(id % 11 AS DOUBLE) / 3 AS b", "CAST(pmod(xxhash64(id), 13) AS DOUBLE) AS c",
        "CAST((id % 7 + id % 11) % 3 AS DOUBLE) AS label").cache()


def saved(model, tmp_path):
    model.write().save(f"file://{tmp_path}/model")
    return f"file://{tmp_path}/model"


def gaps(model, nodes, df):
    scored = model.transform(df)
    raw = scored.select("id", F.posexplode(vector_to_array("rawPrediction")).alias("class", "raw"))
    sums = trees.tree_contributions(df, ["id"], nodes, FEATURES).groupBy("id", "class").agg(F.sum("contribution").alias("s"))
    both = raw.join(sums, ["id", "class"], "left").join(trees.base_scores(nodes), "class")
    return both.select(F.abs(F.coalesce("s", F.lit(0.0)) + F.col("base") - F.col("raw")).alias("gap")).agg(F.max("gap"), F.count("*")).first()


def test_forest_contributions_add_up_to_the_raw_score(train, tmp_path):
    model = models.train_rf(train, FEATURES, numTrees=4, maxDepth=4)
    nodes = trees.forest_nodes(model, saved(model, tmp_path))
    gap, n = gaps(model, nodes, train)
    assert n == 1800 and gap < 1e-9
    used = {r["feature"] for r in trees.tree_contributions(train, ["id"], nodes, FEATURES).select("feature").distinct().collect()}
    assert used == {f for f, x in zip(FEATURES, model.stages[-1].featureImportances.toArray()) if x > 0}


def test_boosted_contributions_add_up_to_the_raw_score(train, tmp_path):
    model = models.train_gbt_ovr(train, FEATURES, maxIter=2, maxDepth=3)
    gap, n = gaps(model, trees.boosted_nodes(model, saved(model, tmp_path)), train)
    assert n == 1800 and gap < 1e-9


def test_boosted_trees_are_fitted_whole(spark, monkeypatch):
    from workload import evaluation

    fits = []
    none = spark.createDataFrame([], "party_id string, label double, prediction double")
    monkeypatch.setattr(evaluation, "_scored", lambda t, train: (fits.append(train), none))
    evaluation.boosted_trees_predictions(None)
    noise = [f"CAST(pmod(xxhash64(id, {i}), 97) AS DOUBLE) AS {f}" for i, f in enumerate(evaluation.FEATURES)]
    model = fits[0](spark.range(300).selectExpr("CAST(id % 2 AS DOUBLE) AS label", "1 + id % 2 AS weight", *noise))
    boosted = model.stages[-1].models
    assert [len(b.trees) for b in boosted] == [50, 50]
    assert [max(t.depth for t in b.trees) for b in boosted] == [5, 5]


def test_rows_of_boosted_trees_are_dealt_out_by_their_number(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(models, "ROWS_PER_TASK", 100)
    monkeypatch.setattr(models.Pipeline, "fit", lambda self, df: seen.append((df.rdd.getNumPartitions(), df.count())))
    for n in (0, 100, 250):
        models.train_gbt_ovr(spark.range(0, n, 1, 7), ["id"])
    assert seen == [(1, 0), (1, 100), (3, 250)]


def test_missing_values_go_right_as_in_the_model(spark, train, tmp_path):
    model = models.train_rf(train, FEATURES, numTrees=3, maxDepth=4)
    odd = spark.createDataFrame([(1, None, 1.0, 2.0), (2, float("nan"), 0.0, 1.0), (3, 5.0, None, None), (3, 5.0, None, None)], "id long, a double, b double, c double")
    gap, n = gaps(model, trees.forest_nodes(model, saved(model, tmp_path)), odd.dropDuplicates())
    assert n == 9 and gap < 1e-9


def test_a_tree_without_splits_contributes_nothing(spark):
    nodes = spark.createDataFrame([(0, 0, -1, -1, -1, None, 0, 0.5)], "tree long, node int, left int, right int, feature int, threshold double, class int, value double")
    df = spark.createDataFrame([(1, 2.0)], "id long, a double")
    assert trees.tree_contributions(df, ["id"], nodes, ["a"]).collect() == []
    assert rows(trees.base_scores(nodes)) == [(0, 0.5)]


def test_stored_models_are_taken_while_they_fit(spark, train, tmp_path):
    calls, folder = [], f"file://{tmp_path}/models"

    def fit():
        calls.append(1)
        return models.train_rf(train, FEATURES, numTrees=2, maxDepth=2)

    def model(product, month, features=FEATURES, classes=(0, 1, 2)):
        return artefacts.model_for(spark, "t_artefacts", folder, product, month, list(features), list(classes), fit)

    first, fitted = model("one", 200111)
    assert fitted and len(calls) == 1
    second, fitted = model("one", 200112)
    assert not fitted and len(calls) == 1
    predictions = [m.transform(train).select("id", "prediction").orderBy("id").collect() for m in (first, second)]
    assert predictions[0] == predictions[1]
    assert model("one", 200110)[1]  # the stored one is newer than that
    assert model("two", 200111)[1] and not model("two", 200111)[1] and not model("one", 200111)[1]
    assert model("one", 200112, classes=(0, 1))[1] and model("one", 200112, features=["a"], classes=(0, 1))[1]
    assert rows(spark.table("t_artefacts"), "product", "training_month") == [("one", 200110), ("one", 200111), ("one", 200112), ("two", 200111)]


def test_a_model_that_fails_to_be_written_leaves_no_row(spark, train, tmp_path):
    broken = models.train_rf(train, FEATURES, numTrees=2, maxDepth=2)
    (tmp_path / "file").write_text("in the way")
    with pytest.raises(Exception):
        artefacts.store_model(spark, broken, "t_broken", f"file://{tmp_path}/file", "one", 200111, FEATURES, [0])
    assert not spark.catalog.tableExists("t_broken")


def test_exact_area_equals_the_evaluator(spark):
    df = spark.range(2000).selectExpr("id", "CAST(pmod(xxhash64(id), 40) AS DOUBLE) / 40 AS score", "IF(id % 3 = 0, 'x', 'y') AS g").selectExpr(
        "*", "CAST(score * 0.7 + CAST(pmod(xxhash64(id, 1), 10) AS DOUBLE) / 20 > 0.5 AS INT) AS label")
    got = {r["g"]: r["roc_auc"] for r in models.exact_roc_auc(df, ["g"]).collect()}
    for g in "xy":
        part = df.filter(F.col("g") == g).withColumn("label", F.col("label").cast("double"))
        want = BinaryClassificationEvaluator(rawPredictionCol="score", numBins=0).evaluate(part)
        assert got[g] == pytest.approx(want, abs=1e-12)


def test_area_without_one_of_the_classes(spark):
    df = spark.createDataFrame([("p", 0.5, 1), ("p", 0.7, 1), ("n", 0.1, 0), ("both", 0.1, 0), ("both", 0.1, 1), ("both", None, 1), ("both", 0.3, None)], "g string, score double, label int")
    assert rows(models.exact_roc_auc(df, ["g"])) == [("both", 1, 1, 0.5), ("n", 0, 1, None), ("p", 2, 0, None)]
