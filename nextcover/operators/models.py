"""Spark ML training and evaluation. Evaluation works on confusion counts: one aggregate over
the rows, then arithmetic on a frame with one row per pair of classes."""

from __future__ import annotations

import random
from functools import reduce

from pyspark.ml import Pipeline
from pyspark.ml.classification import (
    GBTClassifier, LogisticRegression, OneVsRest, RandomForestClassifier,
)
from pyspark.ml.evaluation import BinaryClassificationEvaluator, MulticlassClassificationEvaluator
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nextcover.operators.prep import assemble
from nextcover.operators.quantiles import value_ranks, with_fitted

# ---- fixed values ----
ROWS_PER_TASK = 100_000
THRESHOLD_START, THRESHOLD_STEP, THRESHOLD_COUNT = 0.1, 0.05, 16
IMBALANCE_HIGH, IMBALANCE_MEDIUM = 5, 2
MISSING_PERCENT, LOW_IMPORTANCE, LOW_IMPORTANCE_COUNT = 5, 0.001, 5
# ---- end of fixed values ----


def train_gbt_ovr(train: DataFrame, features: list[str], label: str = "label", weight: str | None = None, **params):
    """Boosted trees, one model per class; 50 trees of depth 5 each unless ``params`` say otherwise."""
    base = GBTClassifier(**{"maxIter": 50, "maxDepth": 5, "seed": 42, **params})
    ovr = OneVsRest(classifier=base, labelCol=label, featuresCol="features", parallelism=4)
    if weight:
        ovr = ovr.setWeightCol(weight)
    # every level of every tree is a pass over the rows, so few rows in many tasks is mostly their start
    dealt = train.repartition(max(1, -(-train.count() // ROWS_PER_TASK)))
    return Pipeline(stages=[assemble(features), ovr]).fit(dealt)


def train_rf(train: DataFrame, features: list[str], label: str = "label", weight: str | None = None, **params):
    forest = RandomForestClassifier(
        labelCol=label, featuresCol="features", **{"numTrees": 50, "maxDepth": 8, "seed": 42, **params})
    if weight:
        forest = forest.setWeightCol(weight)
    return Pipeline(stages=[assemble(features), forest]).fit(train)


def train_per_product(train: DataFrame, targets: dict[str, list[str]], weight: str | None = None, **params) -> dict:
    """One binary model per target over its own features."""
    models = {}
    for target, features in targets.items():
        logistic = LogisticRegression(
            labelCol=target, featuresCol="features", standardization=True,
            **{"maxIter": 50, "regParam": 0.01, **params})
        if weight:
            logistic = logistic.setWeightCol(weight)
        models[target] = Pipeline(stages=[assemble(features), logistic]).fit(train)
    return models


def roc_auc(scored: DataFrame, target: str) -> float:
    return BinaryClassificationEvaluator(labelCol=target, rawPredictionCol="rawPrediction").evaluate(scored)


def exact_roc_auc(long: DataFrame, groups: list[str], score: str = "score", label: str = "label") -> DataFrame:
    """Area under the curve per group, as the rank sum of the positive rows; equal scores share
    their mean rank. Null without positive or without negative rows. Rows with a null score or
    label don't count.

    Ranks are of distinct scores, so a score that many rows share is one row, and sums are whole
    numbers until the last division.
    """
    known = long.filter(F.col(label).isNotNull() & F.col(score).isNotNull())
    ranks = value_ranks(known, groups, score)
    positive = known.filter(F.col(label) == 1).groupBy(*groups, score).agg(F.count(F.lit(1)).alias("p"))
    whole = "decimal(19,0)"
    twice = F.col("p").cast(whole) * (2 * F.col("before") + F.col("n") + 1).cast(whole)
    found = ranks.join(positive, [*groups, score], "left").groupBy(*groups).agg(
        F.sum(twice).alias("_sum"), F.coalesce(F.sum("p"), F.lit(0)).alias("positives"), F.first("total").alias("_total"))
    p, negatives = F.col("positives").cast(whole), (F.col("_total") - F.col("positives")).cast(whole)
    area = (F.col("_sum") - p * (p + 1)).cast("double") / F.nullif((2 * p * negatives).cast("double"), F.lit(0.0))
    return found.select(*groups, "positives", (F.col("_total") - F.col("positives")).alias("negatives"), area.alias("roc_auc"))


def tune(train: DataFrame, features: list[str], label: str = "label", grid: dict | None = None, folds: int = 3,
         by: str | None = None, draws: int | None = None, seed: int = 42, submodels: bool = False):
    """Grid search by F1 over a random forest.

    ``by`` names a column whose rows share a fold (a client's, say), by a hash of it; else rows are
    dealt at random. ``draws`` tries so many combinations of the grid, drawn by ``seed``.
    ``submodels`` keeps the models of all folds.
    """
    forest = RandomForestClassifier(labelCol=label, featuresCol="features", seed=seed)
    builder = ParamGridBuilder()
    for name, values in (grid or {"numTrees": [20, 50], "maxDepth": [5, 8]}).items():
        builder = builder.addGrid(forest.getParam(name), values)
    maps = builder.build()
    if draws is not None and draws < len(maps):
        maps = random.Random(seed).sample(maps, draws)
    search = CrossValidator(
        estimator=forest, estimatorParamMaps=maps, numFolds=folds, seed=seed, parallelism=2, collectSubModels=submodels,
        evaluator=MulticlassClassificationEvaluator(labelCol=label, metricName="f1"))
    if by is not None:
        search = search.setFoldCol("fold")
        train = with_folds(train, by, folds, seed)
    return Pipeline(stages=[assemble(features), search]).fit(train)


def with_folds(df: DataFrame, by: str, folds: int, seed: int = 42) -> DataFrame:
    """Rows with ``fold``, the same for all rows of one value of ``by``."""
    return df.withColumn("fold", F.pmod(F.xxhash64(F.col(by), F.lit(seed)), F.lit(folds)).cast("int"))


def importance(model, features: list[str], spark) -> DataFrame:
    """Importance per feature, averaged over the classes of a one-vs-rest model."""
    last = model.stages[-1]
    parts = [m.featureImportances for m in last.models] if hasattr(last, "models") else [last.featureImportances]
    rows = [(f, float(sum(p[i] for p in parts) / len(parts))) for i, f in enumerate(features)]
    return spark.createDataFrame(rows, "feature string, importance double")


def confusion(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    return df.groupBy(F.col(label).alias("label"), F.col(prediction).alias("prediction")).agg(F.count(F.lit(1)).alias("n"))


def confusion_matrix(df: DataFrame, classes: list, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """One row per label, one column per predicted class."""
    counts = confusion(df, label, prediction)
    return counts.groupBy("label").pivot("prediction", classes).agg(F.sum("n")).fillna(0, subset=[str(c) for c in classes])


def class_report(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Precision, recall, F1 and support per class."""
    return report_from_counts(confusion(df, label, prediction))


def report_from_counts(counts: DataFrame) -> DataFrame:
    # every pair counts once for its true class and once for its predicted class
    roles = counts.select(F.expr("""explode(array(
        named_struct('class', label, 'support', n, 'tp', CASE WHEN label = prediction THEN n ELSE 0L END, 'predicted', 0L),
        named_struct('class', prediction, 'support', 0L, 'tp', 0L, 'predicted', n)))""").alias("r")).select("r.*")
    both = roles.groupBy("class").agg(*[F.sum(c).alias(c) for c in ("support", "tp", "predicted")])
    precision = F.coalesce(F.col("tp") / F.nullif(F.col("predicted"), F.lit(0)), F.lit(0.0))
    recall = F.coalesce(F.col("tp") / F.nullif(F.col("support"), F.lit(0)), F.lit(0.0))
    f1 = 2 * F.col("tp") / F.nullif(F.col("support") + F.col("predicted"), F.lit(0))
    return both.select(
        "class", precision.alias("precision"), recall.alias("recall"),
        F.coalesce(f1, F.lit(0.0)).alias("f1"), "support", "predicted")


def metrics(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Accuracy, weighted precision, recall and F1, and macro F1, in one row."""
    return metrics_from_report(class_report(df, label, prediction))


def metrics_from_report(report: DataFrame) -> DataFrame:
    total = F.sum("support")

    def weighted(c: str):
        return (F.sum(F.col(c) * F.col("support")) / total)

    return report.agg(
        weighted("recall").alias("accuracy"), weighted("precision").alias("weighted_precision"),
        weighted("recall").alias("weighted_recall"), weighted("f1").alias("weighted_f1"),
        F.avg("f1").alias("macro_f1"), total.alias("rows"))


def error_patterns(df: DataFrame, label: str = "label", prediction: str = "prediction", n: int = 10) -> DataFrame:
    wrong = confusion(df, label, prediction).filter(F.col("label") != F.col("prediction"))
    return wrong.orderBy(F.desc("n"), "label", "prediction").limit(n)


def errors_by_class(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    wrong = confusion(df, label, prediction).filter(F.col("label") != F.col("prediction"))
    return wrong.groupBy("label").agg(F.sum("n").alias("errors"))


def tune_thresholds(long: DataFrame, class_col: str = "class", probability: str = "probability",
                    label: str = "label") -> DataFrame:
    """Threshold with the best F1 per class, the lowest among equals, 0.5 when none helps.

    All thresholds are counted in one aggregate, without multiplying the rows.
    """
    steps = [THRESHOLD_START + THRESHOLD_STEP * i for i in range(THRESHOLD_COUNT)]
    is_class = F.col(label) == F.col(class_col)
    counted = long.groupBy(class_col).agg(
        F.sum(is_class.cast("long")).alias("positives"),
        *[F.sum((F.col(probability) >= t).cast("long")).alias(f"g{i}") for i, t in enumerate(steps)],
        *[F.sum(((F.col(probability) >= t) & is_class).cast("long")).alias(f"t{i}") for i, t in enumerate(steps)],
    )
    scores = F.array(*[
        F.struct(
            F.coalesce(2 * F.col(f"t{i}") / F.nullif(F.col(f"g{i}") + F.col("positives"), F.lit(0)), F.lit(0.0)).alias("f1"),
            F.lit(-t).alias("minus"))
        for i, t in enumerate(steps)
    ])
    best = counted.select(class_col, F.array_max(scores).alias("best"))
    return best.select(
        class_col, F.when(F.col("best.f1") > 0, -F.col("best.minus")).otherwise(0.5).alias("threshold"),
        F.col("best.f1").alias("f1"))


def apply_thresholds(df: DataFrame, probabilities: dict[str, str], thresholds: DataFrame, class_col: str = "class") -> DataFrame:
    """Rows with ``prediction``: the most probable class among those that reach their threshold,
    else the most probable.

    ``probabilities`` maps each class to its column. The thresholds are one fitted row, a scalar
    subquery; nothing else is needed but the row itself.
    """
    fitted = thresholds.agg(*[F.max(F.when(F.col(class_col) == c, F.col("threshold"))).alias(f"t{i}") for i, c in enumerate(probabilities)])
    options = F.array(*[
        F.struct((~F.coalesce(F.col(p) >= F.col(f"_fit.t{i}"), F.lit(False))).alias("below"), (-F.col(p)).alias("minus"), F.lit(c).alias("class"))
        for i, (c, p) in enumerate(probabilities.items())])
    known = F.filter(options, lambda o: o["minus"].isNotNull())
    return with_fitted(df, fitted).withColumn("prediction", F.array_min(known)["class"]).drop("_fit")


def distribution_shift(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """True against predicted count per class, with the difference in percent of the true count."""
    report = class_report(df, label, prediction)
    return report.select(
        "class", F.col("support").alias("true_count"), F.col("predicted").alias("predicted_count"),
        ((F.col("predicted") - F.col("support")) * 100.0 / F.nullif(F.col("support"), F.lit(0))).alias("difference_pct"))


def compare_runs(baseline: DataFrame, improved: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Values of two runs side by side with their difference."""
    a = baseline.select(*keys, *[F.col(v).alias(f"baseline_{v}") for v in values])
    b = improved.select(*keys, *[F.col(v).alias(f"improved_{v}") for v in values])
    return a.join(b, keys, "full").withColumns({
        f"{v}_change": F.coalesce(F.col(f"improved_{v}"), F.lit(0.0)) - F.coalesce(F.col(f"baseline_{v}"), F.lit(0.0))
        for v in values
    })


def runs_by_mode(metadata: DataFrame) -> DataFrame:
    return metadata.groupBy("training_mode").agg(
        F.count(F.lit(1)).alias("runs"), F.avg("f1").alias("mean_f1"), F.avg("rounds").alias("mean_rounds"))


def findings(distribution: DataFrame, missing: DataFrame, importances: DataFrame | None = None) -> DataFrame:
    """Issues by rule: class imbalance, missing values, unimportant features.

    Inputs are report frames: ``distribution`` with ``n`` per class, ``missing`` with
    ``missing_percentage`` per column, ``importances`` with ``importance`` per feature.
    """
    r = distribution.agg((F.max("n") / F.min("n")).alias("ratio"))
    imbalance = r.filter(F.col("ratio") > IMBALANCE_MEDIUM).select(
        F.when(F.col("ratio") > IMBALANCE_HIGH, "Severe Class Imbalance").otherwise("Moderate Class Imbalance").alias("issue"),
        F.when(F.col("ratio") > IMBALANCE_HIGH, "HIGH").otherwise("MEDIUM").alias("severity"),
        F.when(F.col("ratio") > IMBALANCE_HIGH, "Model may be biased toward majority class")
        .otherwise("Minority classes may have lower recall").alias("impact"),
        F.when(F.col("ratio") > IMBALANCE_HIGH, "Use class weights, SMOTE, or stratified sampling")
        .otherwise("Consider class weights or balanced sampling").alias("recommendation"),
    )
    m = missing.filter(F.col("missing_percentage") > MISSING_PERCENT).agg(F.count(F.lit(1)).alias("k"))
    parts = [imbalance, m.filter("k > 0").select(
        F.format_string("High Missing Values in %d features", "k").alias("issue"), F.lit("MEDIUM").alias("severity"),
        F.lit("May reduce model performance").alias("impact"),
        F.lit("Improve imputation strategy or feature engineering").alias("recommendation"))]
    if importances is not None:
        low = importances.filter(F.col("importance") < LOW_IMPORTANCE).agg(F.count(F.lit(1)).alias("k"))
        parts.append(low.filter(F.col("k") > LOW_IMPORTANCE_COUNT).select(
            F.format_string("%d features with very low importance", "k").alias("issue"), F.lit("LOW").alias("severity"),
            F.lit("Noise in model, potential overfitting").alias("impact"),
            F.lit("Consider feature selection to remove low-importance features").alias("recommendation")))
    return reduce(DataFrame.unionByName, parts)
