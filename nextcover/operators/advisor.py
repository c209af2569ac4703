"""Lists and tables for advisors.

Joins of tables with a row or more per client ask for a merge join: Spark guesses their size from
that of the stored files, which says little about texts and lists made on the way, and would
broadcast whole tables of clients.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nextcover.functions.columns import flag, right_closed_band
from nextcover.operators.scoring import PRODUCTS

# ---- fixed values ----
MIN_SCORE = 0.60
GAP_FOCUS, GAP_DUAL = 0.15, 0.05
PITCH_FOCUS = "Focus on primary product first"
PITCH_DUAL = "Dual product approach"
PITCH_LEAD = "Lead with primary, mention secondary"
PITCH_COLUMNS = [
    "party_id", "predicted_product", "pred_prob", "confidence", "talking_points",
    "top_positive_features", "top_negative_features", "product_category", "psn_age", "client_seg",
    "aum_band", "channel", "division_name", "branch_name", "business_city", "business_state_cod", "client_tenure",
]
PITCH_NAMES = {"predicted_product": "recommended_product", "pred_prob": "recommendation_confidence"}
AGE_GROUP_EDGES, AGE_GROUP_LABELS = [0, 35, 50, 65, 100], ["<35", "35-50", "50-65", "65+"]
LIST_LEVELS = ("high", "medium", "base")
# ---- end of fixed values ----


def _by_product(suffix: str):
    out = F.when(F.lit(False), None)
    for p in PRODUCTS:
        out = out.when(F.col("product") == p, F.col(f"{p}_{suffix}"))
    return out


def smart_list(scores: DataFrame, explanations: DataFrame, threshold: float = MIN_SCORE) -> DataFrame:
    """Recommendations above the threshold with the rank and decile of their product and the
    reasons. Both sides have one row per client and month (and product), so nothing repeats."""
    listed = explanations.filter(F.col("score") > threshold)
    joined = scores.join(listed.hint("merge"), ["party_id", "prediction_month"])
    return joined.select(
        "party_id", "product", "score", "best_product", "best_score",
        _by_product("rank").alias("product_rank"), _by_product("decile").alias("product_decile"),
        *[f"multi_product_opportunity_{x}" for x in LIST_LEVELS],
        *[F.get("talking_points", i).alias(f"talking_point_{i + 1}") for i in range(5)],
        F.get("top_features", 0).alias("top_feature_1"), F.get("top_contributions", 0).alias("top_feature_1_contribution"),
        "prediction_month")


def strategy(scores: DataFrame, explanations: DataFrame) -> DataFrame:
    """Pitch, bundle and reasons for clients with two or more good products, best first."""
    base = scores.filter(F.col("multi_product_opportunity_medium") == 1).select(
        "party_id", "prediction_month", "best_product", "best_score", "second_best_product", "second_best_score",
        "multi_product_opportunity_medium", "medium_score_count")
    gap = F.col("best_score") - F.col("second_best_score")
    pitched = base.withColumns({
        "pitch_strategy": F.when(gap > GAP_FOCUS, PITCH_FOCUS).when(gap < GAP_DUAL, PITCH_DUAL).otherwise(PITCH_LEAD),
        "product_bundle": F.concat_ws(" + ", "best_product", "second_best_product"),
        "combined_score": (F.col("best_score") + F.col("second_best_score")) / 2,
    })
    return bundle_reasons(pitched, explanations).orderBy(F.desc("combined_score"), "party_id")


def bundle_reasons(df: DataFrame, explanations: DataFrame) -> DataFrame:
    """Two reasons each for the best and the second best product.

    One join on the client brings both products' explanations side by side (four at most), so
    the explanation table is shuffled once.
    """
    texts = F.struct(F.get("talking_points", 0).alias("a"), F.get("talking_points", 1).alias("b"))
    per_client = explanations.groupBy("party_id", "prediction_month").agg(*[
        F.max(F.when(F.col("product") == p, texts)).alias(f"_{p}") for p in PRODUCTS
    ])
    joined = df.join(per_client.hint("merge"), ["party_id", "prediction_month"], "left")

    def reason(product: str, which: str):
        out = F.when(F.lit(False), F.lit(""))
        for p in PRODUCTS:
            out = out.when(F.col(product) == p, F.col(f"_{p}")[which])
        return out

    return joined.withColumns({
        "primary_reason_1": reason("best_product", "a"), "primary_reason_2": reason("best_product", "b"),
        "secondary_reason_1": reason("second_best_product", "a"), "secondary_reason_2": reason("second_best_product", "b"),
    }).drop(*[f"_{p}" for p in PRODUCTS])


def list_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), column)


def final_output(enhanced: DataFrame, explanations: DataFrame) -> DataFrame:
    """Scores with the explanation of the best product, and whether there is one."""
    named = explanations.select(
        "party_id", "prediction_month", F.col("product").alias("best_product"), F.col("score").alias("explanation_score"),
        "top_features", "top_feature_values", "talking_points")
    return enhanced.join(named.hint("merge"), ["party_id", "prediction_month", "best_product"], "left").withColumn(
        "explanation_available", F.col("explanation_score").isNotNull().cast("int"))


def advisor_query(df: DataFrame, kind: str, product: str = "investment", level: str = "high",
                  threshold: float = 0.70, n: int = 500, decile: int = 1, ordered: bool = True) -> DataFrame:
    """The advisors' standing questions.

    ``top``: the ``n`` best of a product above the threshold; ``multi``: clients flagged at a
    level, most products first; ``decile``: one decile of a product; ``product``: everyone
    above the threshold for a product with the rank. ``ordered=False`` leaves out the sort of the
    lists without a limit, for a caller that goes on with the rows.
    """
    score = F.col(f"{product}_score")
    if kind == "top":
        return df.filter(score > threshold).orderBy(score.desc(), "party_id").limit(n)
    if kind == "multi":
        flagged = df.filter(F.col(f"multi_product_opportunity_{level}") == 1)
        return flagged.orderBy(F.col(f"{level}_score_count").desc(), F.col("best_score").desc(), "party_id") if ordered else flagged
    if kind == "decile":
        return df.filter(F.col(f"{product}_decile") == decile)
    if kind == "product":
        ranked = df.filter(score > threshold).select("party_id", score, f"{product}_rank")
        return ranked.orderBy(score.desc(), "party_id") if ordered else ranked
    raise ValueError(f"unknown query: {kind}")


def top_n(df: DataFrame, column: str, n: int, tie: str = "party_id") -> DataFrame:
    return df.orderBy(F.col(column).desc(), tie).limit(n)


def potential_counts(long: DataFrame) -> DataFrame:
    """Clients per product above 0.7 and from 0.6 to 0.7."""
    s = F.col("score")
    return long.groupBy("product").agg(
        F.sum((s > 0.7).cast("long")).alias("high_scorers"),
        F.sum(((s >= 0.6) & (s <= 0.7)).cast("long")).alias("medium_scorers"))


def pitch_table(predictions: DataFrame, narrative: DataFrame) -> DataFrame:
    """Predictions with their narrative, columns in the advisors' order and names."""
    texts = narrative.select("party_id", "confidence", "talking_points", "top_positive_features", "top_negative_features")
    joined = predictions.drop("confidence").join(texts, "party_id", "left")
    probabilities = [c for c in joined.columns if c.startswith("prob_")]
    present = [c for c in PITCH_COLUMNS if c in joined.columns]
    return joined.select(*present, *probabilities).withColumnsRenamed(PITCH_NAMES)


def by_segment(df: DataFrame, n: int = 10, segment: str = "client_seg", product: str = "recommended_product") -> DataFrame:
    counts = df.filter(F.col(segment).isNotNull()).groupBy(segment, product).agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.desc("n"), segment, product).limit(n)


def by_age_group(df: DataFrame, age: str = "psn_age", product: str = "recommended_product") -> DataFrame:
    group = right_closed_band(age, AGE_GROUP_EDGES, AGE_GROUP_LABELS)
    grouped = df.withColumn("age_group", group).filter(F.col("age_group").isNotNull())
    return grouped.groupBy("age_group", product).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "age_group", product)


def pitch_totals(df: DataFrame) -> DataFrame:
    return df.agg(
        F.count(F.lit(1)).alias("clients"), F.count_distinct("recommended_product").alias("products"),
        F.avg("recommendation_confidence").alias("avg_confidence"))
