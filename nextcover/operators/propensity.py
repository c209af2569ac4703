"""Counts of what followed what, as lookups and as features."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nextcover.operators.ordered import first_by


def mode_by(df: DataFrame, keys: list[str], column: str, name: str = "mode") -> DataFrame:
    """Most frequent non-null value per key, ties to the smaller value. Both steps combine
    before their shuffle."""
    counts = df.filter(F.col(column).isNotNull()).groupBy(*keys, column).agg(F.count(F.lit(1)).alias("_n"))
    return counts.groupBy(*keys).agg(F.min(F.struct((-F.col("_n")).alias("n"), F.col(column).alias("v")))["v"].alias(name))


def mode_of(df: DataFrame, column: str, fallback: str = "UNKNOWN") -> DataFrame:
    """Most frequent value of a column; ``fallback`` when nulls are the most frequent."""
    counts = df.groupBy(column).agg(F.count(F.lit(1)).alias("_n"))
    best = F.min(F.struct((-F.col("_n")).alias("n"), F.col(column).alias("v")))["v"]
    return counts.agg(F.coalesce(best, F.lit(fallback)).alias(column))


def counts(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), *keys)


def having_distinct(df: DataFrame, key: str, column: str, n: int) -> DataFrame:
    return df.groupBy(key).agg(F.count_distinct(column).alias("distinct_values")).filter(F.col("distinct_values") == n)


def transition_probs(df: DataFrame, first: str = "product_category", nxt: str = "second_product_category") -> DataFrame:
    """P(next | first). The window runs over one row per pair of categories."""
    pairs = df.groupBy(F.col(first).alias("first_prod"), F.col(nxt).alias("second_prod")).agg(F.count(F.lit(1)).alias("pair_count"))
    total = F.sum("pair_count").over(Window.partitionBy("first_prod"))
    return pairs.withColumn("transition_probability", F.col("pair_count") / total)


def top_transitions(probs: DataFrame, n: int = 3) -> DataFrame:
    order = [F.col("transition_probability").desc(), F.col("second_prod").asc()]
    return first_by(probs, ["first_prod"], order, n, rank="rank")


def ratio_by(df: DataFrame, keys: list[str], total_keys: list[str]) -> DataFrame:
    """Share of each key in its total."""
    parts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    totals = parts.groupBy(*total_keys).agg(F.sum("n").alias("total"))
    return parts.join(totals, total_keys).withColumn("share", F.col("n") / F.col("total"))


def transition_matrix(probs: DataFrame, classes: list[str]) -> DataFrame:
    """One row per first product with ``prob_<class>_given_first``, zero where unseen."""
    wide = probs.groupBy("first_prod").pivot("second_prod", classes).agg(F.max("transition_probability")).fillna(0.0)
    return wide.withColumnsRenamed({c: f"prob_{c}_given_first" for c in classes})


def add_transition_probs(df: DataFrame, matrix: DataFrame, product: str = "product_category") -> DataFrame:
    """Rows with the probabilities of their product. The matrix has one row per category,
    seven at most, which bounds the broadcast."""
    columns = [c for c in matrix.columns if c != "first_prod"]
    right = F.broadcast(matrix.withColumnRenamed("first_prod", product))
    return df.join(right, product, "left").fillna(0.0, subset=columns)


def transition_pattern_report(df: DataFrame, n: int = 15, first: str = "product_category",
                              nxt: str = "cross_sell_product_category", days: str = "days_to_cross_sell") -> DataFrame:
    return (
        df.groupBy(F.col(first).alias("from_product"), F.col(nxt).alias("to_product"))
        .agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(days), 0).alias("avg_days"))
        .orderBy(F.desc("n"), "from_product", "to_product").limit(n)
    )


def propensity_product(df: DataFrame, product: str = "product_category") -> DataFrame:
    return df.groupBy(product).agg(F.count(F.lit(1)).alias("p1_cross_sell_popularity"))


def propensity_mode(df: DataFrame, product: str = "product_category", nxt: str = "second_product_category") -> DataFrame:
    return mode_by(df, [product], nxt, "p1_most_common_next_prod")


def propensity_agent(df: DataFrame, product: str = "product_category") -> DataFrame:
    return df.groupBy("agt_no", product).agg(F.count(F.lit(1)).alias("agent_p1_cross_sell_count"))


def propensity_branch(df: DataFrame, product: str = "product_category") -> DataFrame:
    return df.groupBy("branchoffice_code", product).agg(F.count(F.lit(1)).alias("branch_p1_cross_sell_count"))


def propensity_lookups(history: DataFrame, product: str = "product_category",
                       nxt: str = "second_product_category") -> list[DataFrame]:
    return [propensity_product(history, product), propensity_mode(history, product, nxt),
            propensity_agent(history, product), propensity_branch(history, product)]


def add_propensity(df: DataFrame, lookups: list[DataFrame], product: str = "product_category") -> DataFrame:
    """Attach the four lookups; unseen keys get zero or UNKNOWN.

    The two product lookups have one row per category (seven at most) and are broadcast. The
    agent and branch lookups grow with the business and are left to Spark's own check of their bytes.
    """
    by_product, by_mode, by_agent, by_branch = lookups
    out = df.join(F.broadcast(by_product), product, "left").join(F.broadcast(by_mode), product, "left")
    out = out.join(by_agent, ["agt_no", product], "left")
    out = out.join(by_branch, ["branchoffice_code", product], "left")
    return out.fillna(0, subset=[
        "p1_cross_sell_popularity", "agent_p1_cross_sell_count", "branch_p1_cross_sell_count",
    ]).fillna("UNKNOWN", subset=["p1_most_common_next_prod"])


def group_means(train: DataFrame, key: str, columns: dict[str, str]) -> DataFrame:
    """Means per group, fitted on the training rows."""
    return train.groupBy(key).agg(*[F.avg(c).alias(n) for c, n in columns.items()])


def add_group_means(df: DataFrame, means: DataFrame, key: str) -> DataFrame:
    return df.join(means, key, "left")


def agent_stats(train: DataFrame, nxt: str = "second_product_category") -> DataFrame:
    """Per agent the most common next product and the mean assets."""
    assets = train.groupBy("agt_no").agg(F.avg("wc_total_assets").alias("agent_avg_assets"))
    return assets.join(mode_by(train, ["agt_no"], nxt, "agent_most_common_cross_sell"), "agt_no", "left")


def cross_sell_rate(df: DataFrame, key: str, second: str = "second_policy_no") -> DataFrame:
    return df.groupBy(key).agg(
        F.count(F.lit(1)).alias("clients"), F.avg(F.col(second).isNotNull().cast("double")).alias("cross_sell_rate")
    )


def cross_tab(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.groupBy(a, b).agg(F.count(F.lit(1)).alias("n"))
