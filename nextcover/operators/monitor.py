"""Month over month: outcomes, stability, drift, retraining, changes of amounts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nextcover.functions.columns import month_index, shift_month, yyyymm
from nextcover.operators.policies import first_second_join, holdings, new_holdings
from nextcover.operators.quantiles import quantile_row, with_fitted

# ---- fixed values ----
CHANGE_MONTHS = [1, 3, 6, 12]
LEAD_MONTHS = [3, 6, 12]
DRIFT_BUCKETS = 10
DRIFT_FLOOR = 0.0001
# ---- end of fixed values ----


def prediction_outcome(predictions: DataFrame, current: DataFrame, month: int) -> DataFrame:
    """What clients with a prediction of last month hold now, for those with two or more products.

    ``month`` is the current month; last month is the calendar month before it.
    """
    last = predictions.filter(F.col("business_month") == shift_month(F.lit(month), -1)).distinct()  # a run may have been repeated
    held = current.join(last.select("party_id"), "party_id", "left_semi")
    buyers = holdings(held).filter(F.col("num_products") >= 2)
    compared = new_holdings(buyers.join(last, "party_id"))
    return compared.select(
        "party_id", "first_product_category", "predicted_product", "actual_product_bought",
        F.when(F.col("predicted_product") == F.col("actual_product_bought"), "Match").otherwise("No Match").alias("prediction_match"),
        F.col("business_month").alias("prediction_month"), F.lit(month).alias("actual_purchase_month"))


def outcome_summary(df: DataFrame) -> DataFrame:
    """Conversions by predicted and bought product with the share of all and the accuracy."""
    parts = df.groupBy("predicted_product", "actual_product_bought", "prediction_match").agg(F.count(F.lit(1)).alias("n"))
    # one row per pair of categories
    whole = Window.partitionBy(F.lit(1))
    right = F.sum(F.when(F.col("prediction_match") == "Match", F.col("n")).otherwise(0)).over(whole)
    return parts.withColumn("accuracy_pct", 100.0 * right / F.sum("n").over(whole))


def prediction_stability(previous: DataFrame, current: DataFrame) -> DataFrame:
    """Predicted product and confidence of two months side by side, per client."""
    a = previous.select("party_id", F.col("predicted_product").alias("previous_product"), F.col("pred_prob").alias("previous_prob"))
    b = current.select("party_id", F.col("predicted_product").alias("current_product"), F.col("pred_prob").alias("current_prob"))
    status = (
        F.when(F.col("previous_product").isNull(), "new").when(F.col("current_product").isNull(), "gone")
        .when(F.col("previous_product") == F.col("current_product"), "same").otherwise("changed"))
    return a.join(b, "party_id", "full").withColumns({
        "status": status, "confidence_change": F.col("current_prob") - F.col("previous_prob")})


def new_qualifiers(current: DataFrame, baseline: DataFrame, minimum: int = 2) -> DataFrame:
    """Clients with ``minimum`` or more products now that the baseline does not list."""
    return holdings(current).filter(F.col("num_products") >= minimum).join(baseline.select("party_id"), "party_id", "left_anti")


def retrain_trigger(current: DataFrame, baseline: DataFrame, threshold: int) -> DataFrame:
    """Number of new qualifying clients and whether it exceeds the threshold."""
    return new_qualifiers(current, baseline).agg(F.count(F.lit(1)).alias("new_clients")).withColumns({
        "threshold": F.lit(threshold), "retrain": (F.col("new_clients") > threshold).cast("int")})


def drift(previous: DataFrame, current: DataFrame, columns: list[str], buckets: int = DRIFT_BUCKETS) -> DataFrame:
    """Population stability index per column over buckets at the quantiles of the earlier month."""
    probabilities = [i / buckets for i in range(1, buckets)]
    edges = quantile_row(previous, columns, probabilities)

    def bucketed(df: DataFrame, name: str) -> DataFrame:
        placed = with_fitted(df.select(*columns), edges).select(*[
            F.expr(" + ".join(f"int({c} > _fit.{c}[{k}])" for k in range(buckets - 1))).alias(c) for c in columns])
        long = placed.unpivot([], columns, "column", "bucket").filter(F.col("bucket").isNotNull())
        counts = long.groupBy("column", "bucket").agg(F.count(F.lit(1)).alias("n"))
        # one row per column and bucket
        return counts.select("column", "bucket", (F.col("n") / F.sum("n").over(Window.partitionBy("column"))).alias(name))

    both = bucketed(previous, "before").join(bucketed(current, "after"), ["column", "bucket"], "full").fillna(0.0)
    a, b = (F.greatest(F.col(c), F.lit(DRIFT_FLOOR)) for c in ("before", "after"))
    return both.groupBy("column").agg(F.sum((b - a) * F.log(b / a)).alias("psi"), F.count(F.lit(1)).alias("buckets"))


def monthly_change(df: DataFrame, columns: list[str], months: list[int] | None = None, party: str = "party_id",
                   month: str = "business_month") -> DataFrame:
    """Monthly totals per client with the value some months ago and the change in percent.

    Rows are summed per client and month first, so a client has one row per calendar month
    and the window over it is bounded. A gap in the months gives null.
    """
    monthly = df.groupBy(party, month).agg(*[F.sum(c).alias(c) for c in columns]).withColumn("_m", month_index(month))
    past = Window.partitionBy(party).orderBy("_m")
    lags, changes = {}, {}
    for c in columns:
        for k in months or CHANGE_MONTHS:
            lags[f"{c}_{k}m_ago"] = F.max(c).over(past.rangeBetween(-k, -k))
            before = F.col(f"{c}_{k}m_ago")
            changes[f"{c}_change_{k}m_pct"] = 100.0 * (F.col(c) - before) / F.nullif(before, F.lit(0.0))
    return monthly.withColumns(lags).withColumns(changes).drop("_m")


def segment_changes(policies: DataFrame, columns: list[str], months: list[int] | None = None, party: str = "party_id",
                    month: str = "business_month") -> DataFrame:
    """``monthly_change`` per client with the client's segment: CS with more than one policy, NCS with
    one. The segment comes from all of the client's rows, whatever their month."""
    changes = monthly_change(policies, columns, months, party, month)
    counts = policies.groupBy(party).agg(F.count_distinct("policy_no").alias("_n"))
    return changes.join(counts, party).withColumn("segment", F.when(F.col("_n") > 1, "CS").otherwise("NCS")).drop("_n")


def market_series(base: DataFrame, months: list[int] | None = None, month: str = "month_int", close: str = "close") -> DataFrame:
    """Monthly closes as changes in percent: to the month before, and 3/6/12 months ahead.

    There is one row per calendar month, so the single window is small.
    """
    series = Window.partitionBy(F.lit(1)).orderBy("_m")
    indexed = base.withColumn("_m", month_index(month))

    def change(to: Column, since: Column) -> Column:
        return 100.0 * (to - since) / F.nullif(since, F.lit(0.0))

    before = F.max(close).over(series.rangeBetween(-1, -1))
    leads = {
        f"snp_close_lead_{k}": change(F.max(close).over(series.rangeBetween(k, k)), F.col(close))
        for k in months or LEAD_MONTHS
    }
    return indexed.select(
        F.col(month).cast("string").alias("snp_business_month"),
        change(F.col(close), before).alias("snp_close_variation"),
        *[v.alias(n) for n, v in leads.items()])


def segment_cs_ncs(df: DataFrame, party: str = "party_id") -> DataFrame:
    """Month a client first held one policy, and month of the second (null while single)."""
    both = first_second_join(df, party, how="left")
    return both.select(
        party, yyyymm("first_register_date").alias("ncs_month"), yyyymm("second_register_date").alias("cs_month"),
        F.when(F.col("second_policy_no").isNull(), "NCS").otherwise("CS").alias("segment"))
