"""Reports on data, features, scores and buckets. One aggregate over the rows each."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nextcover.functions.columns import correlation, log_amount
from nextcover.operators.ordered import first_by
from nextcover.operators.quantiles import column_quantiles, unpivoted
from nextcover.operators.scoring import SCORE_COLUMNS

# ---- fixed values ----
SCORE_THRESHOLDS = [0.5, 0.6, 0.7, 0.8, 0.9]
LOW_VARIANCE = 1e-6
HIGH_BUCKET, LOW_BUCKET = 0.95, 0.70
# bucket -> condition on the confidence; the buckets overlap
CONFIDENCE_BUCKETS = {
    "high": (">=", 0.90), "med_low": ("<=", 0.80), "low": ("<=", 0.70), "very_low": ("<=", 0.60),
}
# ---- end of fixed values ----


def _in_bucket(name: str, confidence: str):
    kind, limit = CONFIDENCE_BUCKETS[name]
    return F.col(confidence) >= limit if kind == ">=" else F.col(confidence) <= limit


def feature_quality(df: DataFrame, distinct: list[str], averages: list[str], filled: list[str]) -> DataFrame:
    """Distinct counts, means and non-null counts in one row."""
    return df.agg(
        *[F.count_distinct(c).alias(f"{c}_distinct") for c in distinct],
        *[F.avg(c).alias(f"{c}_avg") for c in averages],
        *[F.count(c).alias(f"{c}_filled") for c in filled])


def flag_totals(df: DataFrame, flags: list[str]) -> DataFrame:
    """Total and share of each 0/1 column."""
    row = df.agg(F.count(F.lit(1)).alias("rows"), *[F.sum(F.col(f).cast("long")).alias(f) for f in flags])
    return row.unpivot(["rows"], flags, "flag", "total").withColumn("share", F.col("total") / F.col("rows"))


def class_distribution(df: DataFrame, label: str) -> DataFrame:
    """Count and percentage per class, and the ratio of the largest class to the smallest."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    # one row per class
    whole = Window.partitionBy(F.lit(1))
    return counts.withColumns({
        "percentage": 100.0 * F.col("n") / F.sum("n").over(whole),
        "imbalance_ratio": F.max("n").over(whole) / F.min("n").over(whole)})


def missing_report(df: DataFrame, columns: list[str]) -> DataFrame:
    row = df.agg(F.count(F.lit(1)).alias("rows"), *[F.count(c).alias(c) for c in columns])
    long = row.unpivot(["rows"], columns, "column", "available_count")
    missing = F.col("rows") - F.col("available_count")
    return long.select(
        "column", missing.alias("missing_count"),
        F.coalesce(F.round(100.0 * missing / F.nullif(F.col("rows"), F.lit(0)), 2), F.lit(0.0)).alias("missing_percentage"),
        "available_count")


def outlier_report(df: DataFrame, columns: list[str], exact: bool = True) -> DataFrame:
    """Values outside 1.5 interquartile ranges, with minimum, quartiles and maximum."""
    q = column_quantiles(df, columns, [0.25, 0.5, 0.75], exact).select(
        "column", F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"))
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    outside = (F.col("value") < F.col("q1") - reach) | (F.col("value") > F.col("q3") + reach)
    # one row of quartiles per column
    counted = unpivoted(df, columns).join(F.broadcast(q), "column").groupBy("column", "q1", "median", "q3").agg(
        F.sum(outside.cast("long")).alias("outlier_count"), F.min("value").alias("min"), F.max("value").alias("max"))
    total = df.agg(F.count(F.lit(1))).scalar()
    return counted.select(
        "column", "outlier_count", F.round(100.0 * F.col("outlier_count") / total, 2).alias("outlier_percentage"),
        *[F.round(c, 2).alias(c) for c in ["min", "q1", "median", "q3", "max"]])


def describe_cols(df: DataFrame, columns: list[str]) -> DataFrame:
    """Count, mean, deviation, minimum, quartiles and maximum per column."""
    base = unpivoted(df, columns).groupBy("column").agg(
        F.count("value").alias("count"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"), F.max("value").alias("max"))
    q = column_quantiles(df, columns, [0.25, 0.5, 0.75])
    return base.join(q, "column").select(
        "column", "count", "mean", "std", "min",
        F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"), "max")


def skew_report(df: DataFrame, columns: list[str]) -> DataFrame:
    """Skewness of each column before and after log(1 + x)."""
    long = unpivoted(df, columns)
    return long.groupBy("column").agg(
        F.skewness("value").alias("skew_before"), F.skewness(log_amount("value")).alias("skew_after"))


def corr_matrix(df: DataFrame, columns: list[str]) -> DataFrame:
    """Pairwise correlations in long form, from one aggregate."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1:]]
    row = df.agg(*[correlation(a, b).alias(f"p{i}") for i, (a, b) in enumerate(pairs)])
    entries = F.array(*[
        F.struct(F.lit(a).alias("column_a"), F.lit(b).alias("column_b"), F.col(f"p{i}").alias("corr"))
        for i, (a, b) in enumerate(pairs)])
    return row.select(F.explode(entries).alias("e")).select("e.*")


def low_variance(df: DataFrame, columns: list[str], limit: float = LOW_VARIANCE) -> DataFrame:
    return unpivoted(df, columns).groupBy("column").agg(F.var_samp("value").alias("variance")).filter(F.col("variance") < limit)


def histogram(df: DataFrame, column: str, low: float, high: float, bins: int) -> DataFrame:
    """Rows per equal-width bin; the upper end belongs to the last bin."""
    placed = F.when(F.col(column) == high, bins).otherwise(F.width_bucket(column, F.lit(float(low)), F.lit(float(high)), F.lit(bins)))
    inside = df.filter(F.col(column).between(low, high))
    width = (high - low) / bins
    counts = inside.groupBy(placed.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return counts.select("bin", (F.lit(float(low)) + (F.col("bin") - 1) * width).alias("bin_start"), "n")


def score_summary(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Mean, deviation, range and the count and share above each threshold, per score."""
    long = unpivoted(df, columns or SCORE_COLUMNS, name="score_name", value="score")
    above = {f"above_{round(t * 100)}": F.sum((F.col("score") > t).cast("long")) for t in SCORE_THRESHOLDS}
    shares = {f"share_{round(t * 100)}": F.avg((F.col("score") > t).cast("double")) for t in SCORE_THRESHOLDS}
    return long.groupBy("score_name").agg(
        F.avg("score").alias("mean"), F.stddev_samp("score").alias("std"), F.min("score").alias("min"), F.max("score").alias("max"),
        *[v.alias(n) for n, v in (above | shares).items()])


def score_quantiles(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    q = column_quantiles(df, columns or SCORE_COLUMNS, [0.25, 0.5, 0.75, 0.9])
    return q.select("column", *[F.col("q")[i].alias(n) for i, n in enumerate(["q25", "q50", "q75", "q90"])])


def prediction_summary(df: DataFrame, product: str = "predicted_product", probability: str = "pred_prob") -> DataFrame:
    return df.groupBy(product).agg(
        F.count(F.lit(1)).alias("n"), F.avg(probability).alias("mean_confidence"),
        F.min(probability).alias("min_confidence"), F.max(probability).alias("max_confidence"))


def bucket_means(df: DataFrame, columns: list[str], confidence: str = "pred_prob") -> DataFrame:
    """Means of the very confident and the unsure rows, one row per bucket."""
    bucket = F.when(F.col(confidence) >= HIGH_BUCKET, "high").when(F.col(confidence) <= LOW_BUCKET, "low")
    kept = df.withColumn("bucket", bucket).filter(F.col("bucket").isNotNull())
    return kept.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(c) for c in columns])


def unpivot_means(means: DataFrame, columns: list[str]) -> DataFrame:
    """Bucket means per feature side by side, with the difference in percent of the low bucket."""
    long = means.select("bucket", *[F.col(c).cast("double").alias(c) for c in columns]).unpivot(["bucket"], columns, "feature", "mean")
    wide = long.groupBy("feature").agg(
        F.max(F.when(F.col("bucket") == "high", F.col("mean"))).alias("high_mean"),
        F.max(F.when(F.col("bucket") == "low", F.col("mean"))).alias("low_mean"))
    return wide.withColumn(
        "difference_pct", 100.0 * (F.col("high_mean") - F.col("low_mean")) / F.nullif(F.abs("low_mean"), F.lit(0.0)))


def bucket_compare(contributions: DataFrame, confidence: str = "pred_prob") -> DataFrame:
    """Per feature the mean absolute contribution and mean value in four overlapping confidence
    buckets, and the distance of each from the high bucket."""
    number = F.col("value").try_cast("double")
    sums = {}
    for b in CONFIDENCE_BUCKETS:
        inside = _in_bucket(b, confidence)
        sums[f"{b}_contribution"] = F.avg(F.when(inside, F.abs("contribution")))
        sums[f"{b}_value"] = F.avg(F.when(inside, number))
    out = contributions.groupBy("feature").agg(*[v.alias(n) for n, v in sums.items()])
    return out.withColumns({
        f"{what}_diff_high_vs_{b}": F.col(f"high_{what}") - F.col(f"{b}_{what}")
        for what in ("contribution", "value") for b in CONFIDENCE_BUCKETS if b != "high"})


def bucket_mix(df: DataFrame, product: str = "predicted_product", confidence: str = "pred_prob", n: int = 5) -> DataFrame:
    """The most frequent products of each confidence bucket."""
    hits = F.filter(F.array(*[F.when(_in_bucket(b, confidence), F.lit(b)) for b in CONFIDENCE_BUCKETS]), lambda x: x.isNotNull())
    counts = df.select(product, F.explode(hits).alias("bucket")).groupBy("bucket", product).agg(F.count(F.lit(1)).alias("n"))
    return first_by(counts, ["bucket"], [F.desc("n"), F.col(product).asc()], n, rank="rank")


def decile_report(df: DataFrame, product: str = "investment") -> DataFrame:
    score = f"{product}_score"
    return df.groupBy(F.col(f"{product}_decile").alias("decile")).agg(
        F.count(F.lit(1)).alias("clients"), F.avg(score).alias("avg_score"),
        F.min(score).alias("min_score"), F.max(score).alias("max_score"))


def best_product_report(df: DataFrame) -> DataFrame:
    return df.groupBy("best_product").agg(
        F.count(F.lit(1)).alias("clients"), F.avg("best_score").alias("avg_score"),
        F.count(F.when(F.col("best_score") > 0.70, 1)).alias("high_confidence"))
