"""Client-level metrics and the joins that assemble them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nextcover.functions.columns import date_of, normalize_code, yyyymm
from nextcover.operators.clean import restrict_to
from nextcover.operators.ordered import latest_by

# ---- fixed values ----
POSITIVE_OUTCOMES = ["Connected", "Appointment Set", "Referral Provided"]
# ---- end of fixed values ----


def activity_metrics(df: DataFrame, as_of, party: str = "party_id") -> DataFrame:
    recent = F.col("activity_date") >= F.add_months(date_of(as_of), -12)
    positive = F.col("call_outcome").isin(POSITIVE_OUTCOMES)
    return df.groupBy(party).agg(
        F.count("task_id").alias("total_activities_all_time"),
        F.count(F.when(recent, F.col("task_id"))).alias("total_activities_last_12m"),
        F.count(F.when(positive, F.col("task_id"))).alias("positive_outcomes"),
    )


def opportunity_metrics(df: DataFrame, party: str = "party_id") -> DataFrame:
    def at_stage(stage: str):
        return F.count(F.when(F.col("stage_name") == stage, F.col("opportunity_id")))

    return df.groupBy(party).agg(
        F.count("opportunity_id").alias("total_opportunities"),
        at_stage("Closed Won").alias("won_opportunities"),
        at_stage("Closed Lost").alias("lost_opportunities"),
        F.avg("estimated_gdc").alias("avg_estimated_gdc"),
    )


def policy_summary(df: DataFrame, as_of, party: str = "party_id") -> DataFrame:
    return df.groupBy(party).agg(
        F.avg(F.datediff(date_of(as_of), F.col("isrd_brth_date")) / 365.25).alias("avg_client_age"),
        F.max("wc_total_assets").alias("estimated_total_wealth"),
        F.max("wc_assetmix_stocks").alias("estimated_stock_wealth"),
        F.max("wc_assetmix_bonds").alias("estimated_bond_wealth"),
    )


def portfolio_counts(df: DataFrame, categories: list[str], party: str = "party_id") -> DataFrame:
    """Policies per category and client, one column per category."""
    return df.groupBy(party).agg(*[
        F.count(F.when(F.col("product_category") == c, 1)).alias(f"{c.lower()}_policies") for c in categories
    ])


def left_latest(df: DataFrame, other: DataFrame, key: str, order: str) -> DataFrame:
    """Left join with only the newest row per key of the right side."""
    return df.join(latest_by(other, [key], [order]), key, "left")


def client_360(retention: DataFrame, policies: DataFrame, agents: DataFrame, activities: DataFrame,
               opportunities: DataFrame, as_of, activity_as_of) -> DataFrame:
    """One row per retention row with policy, agent, activity and opportunity metrics.

    The four client-keyed inputs are aggregated on ``party_id`` before their joins, so the
    retention rows keep one partitioning for all of them.
    """
    agent = latest_by(agents, ["agent_code"], ["yearmo"]).select(
        "agent_code", F.col("full_name").alias("agent_name"),
        F.col("rpt_lgth_of_svc").alias("agent_length_of_service"), F.col("rank_desc").alias("agent_rank"),
    )
    counts = [
        "total_activities_all_time", "total_activities_last_12m", "positive_outcomes",
        "total_opportunities", "won_opportunities",
    ]
    return (
        retention.filter(F.col("party_id").isNotNull())
        .join(policy_summary(policies, as_of), "party_id", "left")
        .join(activity_metrics(activities, activity_as_of), "party_id", "left")
        .join(opportunity_metrics(opportunities).drop("lost_opportunities", "avg_estimated_gdc"), "party_id", "left")
        .join(agent, "agent_code", "left")
        .fillna(0, subset=counts)
    )


def join_product_lookup(policies: DataFrame, lookup: DataFrame) -> DataFrame:
    """Policies with the product text of their plan, matched on three normalised codes.

    The lookup is reduced to distinct keys first; Spark broadcasts it when its size allows.
    """
    texts = lookup.select(
        F.upper("source_sys_id").alias("_sys"),
        F.trim(F.upper("idb_plan_cd")).alias("_plan"),
        F.trim(F.upper("idb_sub_plan_cd")).alias("_sub"),
        F.trim("stmt_plan_typ_txt").alias("product"),
    ).distinct()
    keyed = policies.withColumns({
        "_sys": F.upper("source_sys_id"),
        "_plan": normalize_code("plan_code"),
        "_sub": normalize_code("plan_subcd_code"),
    })
    return keyed.join(texts, ["_sys", "_plan", "_sub"], "left").drop("_sys", "_plan", "_sub")


def join_market(df: DataFrame, market: DataFrame, lag_days: int = 90, date: str = "register_date_dt_lead") -> DataFrame:
    """Market figures of the month ``lag_days`` before the next policy; unmatched rows go."""
    month = F.date_format(F.date_sub(F.col(date), lag_days), "yyyyMM")
    return df.withColumn("snp_business_month", month).join(market, "snp_business_month", "inner")


def join_snapshot(df: DataFrame, snapshot: DataFrame, how: str = "left", party: str = "party_id") -> DataFrame:
    return df.join(snapshot, party, how)


def client_snapshot(df: DataFrame, party: str = "party_id") -> DataFrame:
    """The client's attributes on the newest policy."""
    return latest_by(df, [party], ["register_date", "policy_no"])


def in_branch_clients(df: DataFrame, metrics: DataFrame, code: str, party: str = "party_id") -> DataFrame:
    """Rows of clients that have a policy in the branch."""
    return restrict_to(df, metrics.filter(F.col("branchoffice_code") == code), party)


def merge_prefer(left: DataFrame, right: DataFrame, on: list[str], prefer: list[str]) -> DataFrame:
    """Left join in which the right side's value wins where there is one."""
    renamed = right.select(*on, *[F.col(c).alias(f"_r_{c}") for c in right.columns if c not in on])
    joined = left.join(renamed, on, "left")
    shared = [c for c in right.columns if c not in on and c in left.columns]
    fresh = [c for c in right.columns if c not in on and c not in left.columns]
    columns = {
        c: F.coalesce(F.col(f"_r_{c}"), F.col(c)) if c in prefer else F.coalesce(F.col(c), F.col(f"_r_{c}"))
        for c in shared
    }
    columns |= {c: F.col(f"_r_{c}") for c in fresh}
    return joined.withColumns(columns).select(*left.columns, *fresh)
