"""From model output and scores to recommendations."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nextcover.functions.columns import flag
from nextcover.operators.client360 import merge_prefer
from nextcover.operators.quantiles import quantile_row, unpivoted, value_ranks, with_fitted

# ---- fixed values ----
PRODUCTS = ["investment", "retirement", "life_insurance", "network_products"]
SCORE_COLUMNS = [f"{p}_score" for p in PRODUCTS]
OPPORTUNITY_LEVELS = {"high": 0.70, "medium": 0.60, "base": 0.50}
CONFIDENCE_HIGH, CONFIDENCE_MEDIUM = 0.7, 0.5
DECILES = 10
# ---- end of fixed values ----


def decode_predictions(df: DataFrame, labels: list[str], probability: str = "probability") -> DataFrame:
    """Predicted class, its probability and one column per class from a probability vector."""
    out = df.withColumn("_p", vector_to_array(probability))
    best = F.array_max("_p")
    names = F.array(*[F.lit(x) for x in labels])
    return out.withColumns({
        "predicted_product": F.element_at(names, F.array_position("_p", best).cast("int")),
        "pred_prob": best,
        **{f"prob_{x}": F.get("_p", i) for i, x in enumerate(labels)},
    }).drop("_p")


def long_scores(df: DataFrame, key: str = "party_id", columns: list[str] | None = None) -> DataFrame:
    """Scores as (key, product, score) rows."""
    columns = columns or SCORE_COLUMNS
    named = df.select(key, *[F.col(c).alias(c.removesuffix("_score")) for c in columns])
    return named.unpivot([key], [c.removesuffix("_score") for c in columns], "product", "score")


def best_two(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Best and second best product with their scores; missing scores do not compete and
    equal scores keep the column order."""
    columns = columns or SCORE_COLUMNS
    options = F.array(*[
        F.struct((-F.col(c)).alias("minus"), F.lit(i).alias("at"), F.lit(c.removesuffix("_score")).alias("name"))
        for i, c in enumerate(columns)
    ])
    ordered = F.array_sort(F.filter(options, lambda o: o["minus"].isNotNull()))
    return df.withColumn("_o", ordered).withColumns({
        "best_product": F.get("_o", 0)["name"], "best_score": -F.get("_o", 0)["minus"],
        "second_best_product": F.get("_o", 1)["name"], "second_best_score": -F.get("_o", 1)["minus"],
    }).drop("_o")


def opportunity_flags(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Products above each level and whether there are two or more."""
    columns = columns or SCORE_COLUMNS
    counts = {
        f"{level}_score_count": F.expr(" + ".join(f"coalesce(int({c} > {t}D), 0)" for c in columns))
        for level, t in OPPORTUNITY_LEVELS.items()
    }
    flags = {f"multi_product_opportunity_{level}": flag(f"{level}_score_count >= 2") for level in OPPORTUNITY_LEVELS}
    return df.withColumns(counts).withColumns(flags).withColumn(
        "multi_product_opportunity", F.col("multi_product_opportunity_high"))


def score_ranks(df: DataFrame, columns: list[str] | None = None, key: str = "party_id") -> DataFrame:
    """Competition rank per score: 1 is the highest, equal scores share the lowest rank.

    Ranks are computed on distinct scores (see ``value_ranks``) and joined back by score.
    """
    columns = columns or SCORE_COLUMNS
    long = long_scores(df, key, columns).filter(F.col("score").isNotNull())
    ranks = value_ranks(long, ["product"], "score").select(
        "product", "score", (F.col("total") - F.col("before") - F.col("n") + 1).alias("rank"))
    per_key = long.join(ranks, ["product", "score"]).groupBy(key).agg(*[
        F.max(F.when(F.col("product") == c.removesuffix("_score"), F.col("rank"))).alias(f"{c.removesuffix('_score')}_rank")
        for c in columns
    ])
    return df.join(per_key.hint("merge"), key, "left")


def score_deciles(df: DataFrame, columns: list[str] | None = None, descending: bool = True) -> DataFrame:
    """Decile per score by exact quantile edges, right-closed; 1 is the top tenth.

    When edges coincide the ten bins have equal width instead. ``descending=False`` numbers
    from the lowest.
    """
    columns = columns or SCORE_COLUMNS
    edges = quantile_row(df, columns, [i / DECILES for i in range(DECILES + 1)])
    out = {}
    for c in columns:
        e = f"_fit.{c}"
        by_edge = "1 + " + " + ".join(f"int({c} > {e}[{k}])" for k in range(1, DECILES))
        width = f"nullif(({e}[{DECILES}] - {e}[0]) / {DECILES}, 0D)"
        by_width = f"coalesce(greatest(ceil(({c} - {e}[0]) / {width}), 1), 1)"
        decile = f"CASE WHEN size(array_distinct({e})) = {DECILES + 1} THEN {by_edge} ELSE {by_width} END"
        numbered = f"{DECILES + 1} - ({decile})" if descending else decile
        out[f"{c.removesuffix('_score')}_decile"] = F.expr(f"int(CASE WHEN {c} IS NOT NULL THEN {numbered} END)")
    return with_fitted(df, edges).withColumns(out).drop("_fit")


def score_table(df: DataFrame, key: str = "party_id") -> DataFrame:
    """All score-derived columns."""
    return score_deciles(score_ranks(opportunity_flags(best_two(df)), key=key))


def stamp_run(df: DataFrame, **values) -> DataFrame:
    """Constant columns that describe the run (months, date, version)."""
    return df.withColumns({n: F.lit(v) for n, v in values.items()})


def run_key(month: str | Column = "business_month", party: str = "party_id") -> Column:
    return F.concat_ws("_", (F.col(month) if isinstance(month, str) else month).cast("string"), F.col(party))


def confidence_label(c: str | Column) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.when(c > CONFIDENCE_HIGH, "High").when(c > CONFIDENCE_MEDIUM, "Medium").otherwise("Low")


def final_predictions(predictions: DataFrame, demographics: DataFrame, key: str = "party_id") -> DataFrame:
    """Predictions with the client's demographics; ``demographics`` has one row per client."""
    return merge_prefer(predictions, demographics, [key], []).withColumn("confidence", confidence_label("pred_prob"))


def high_confidence(df: DataFrame, threshold: float = 0.95, probability: str = "pred_prob") -> DataFrame:
    return df.filter(F.col(probability) >= threshold)


def confidence_counts(df: DataFrame, thresholds: list[float], product: str = "predicted_product",
                      probability: str = "pred_prob") -> DataFrame:
    """Clients per product at each confidence threshold."""
    return df.groupBy(product).agg(*[
        F.sum((F.col(probability) >= t).cast("long")).alias(f"at_{round(t * 100)}") for t in thresholds
    ])


def enhance_scores(scores: DataFrame, branch_metrics: DataFrame, code: str, demographics: DataFrame,
                   first_products: DataFrame, key: str = "party_id") -> DataFrame:
    """Scores of a branch's clients with demographics and first product, one row per client."""
    members = branch_metrics.filter(F.col("branchoffice_code") == code).select(key)
    return (
        scores.join(members, key, "left_semi")
        .join(demographics, key, "left").join(first_products, key, "left")
    )


def long_probabilities(df: DataFrame, key: str, columns: dict[str, str]) -> DataFrame:
    """Probability columns as (key, class, probability) rows; ``columns`` maps column to class."""
    named = df.select(key, *[F.col(c).alias(n) for c, n in columns.items()])
    return named.unpivot([key], list(columns.values()), "class", "probability")
