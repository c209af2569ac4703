"""First, second, neighbouring and single policies of each client."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nextcover.functions.columns import flag, ratio
from nextcover.operators.clean import valid_events
from nextcover.operators.ordered import first_by, with_order, with_totals
from nextcover.schemas import ASSET_MIX

ORDER = ["register_date", "policy_no"]

# ---- fixed values: policy attributes carried into the first/second row ----
FIRST_FIELDS = [
    "policy_no", "register_date", "trmn_eff_date", "wti_lob_txt", "prod_lob", "agt_class",
    "isrd_brth_date", "psn_age", "acct_val_amt", "face_amt", "cash_val_amt", "wc_total_assets",
    *ASSET_MIX, "client_seg", "client_seg_1", "aum_band", "sub_product_level_1",
    "sub_product_level_2", "product", "business_month", "branchoffice_code", "agt_no",
    "division_name", "policy_status", "channel", "agent_segment",
]
SECOND_FIELDS = [
    "policy_no", "register_date", "trmn_eff_date", "wti_lob_txt", "prod_lob",
    "sub_product_level_1", "sub_product_level_2", "product",
]
NEIGHBOUR_FIELDS = {
    "policy_no": "policy_no_lead", "register_date": "register_date_dt_lead",
    "prod_lob": "prod_lob_lead", "sub_product_level_1": "sub_product_level_1_lead",
    "sub_product_level_2": "sub_product_level_2_lead", "product": "product_lead",
    "trmn_eff_date": "trmn_eff_date_lead", "product_category": "cross_sell_product_category",
    "retirement_sub_category": "cross_sell_retirement_sub", "life_sub_category": "cross_sell_life_sub",
    "investment_sub_category": "cross_sell_investment_sub", "tax_treatment": "cross_sell_tax_treatment",
    "investment_type": "cross_sell_investment_type", "account_type": "cross_sell_account_type",
}
# ---- end of fixed values ----


def event_index(df: DataFrame, party: str = "party_id", name: str = "event_index") -> DataFrame:
    """Number a client's policies from the oldest."""
    return with_order(df, party, ORDER, number=name)


def _ranked(df: DataFrame, party: str, n: int, newest: bool = False) -> DataFrame:
    order = [F.col(c).desc() if newest else F.col(c).asc() for c in ORDER]
    return first_by(df, [party], order, n, rank="_rn")


def first_product(df: DataFrame, party: str = "party_id", category: str = "product_category") -> DataFrame:
    """The client's first product that is not OTHER."""
    known = df.filter(F.col(category).isNotNull() & (F.col(category) != "OTHER"))
    return _ranked(known, party, 1).select(
        party, F.col(category).alias("first_product"), F.col("register_date").alias("first_product_date")
    )


def last_two(df: DataFrame, party: str = "party_id", category: str = "product_category") -> DataFrame:
    """Last policy and last but one of clients with two or more, in one row."""
    two = _ranked(df, party, 2, newest=True)
    return two.groupBy(party).agg(
        F.max(F.when(F.col("_rn") == 2, F.col("policy_no"))).alias("previous_policy_no"),
        F.max(F.when(F.col("_rn") == 2, F.col("register_date"))).alias("previous_register_date"),
        F.max(F.when(F.col("_rn") == 2, F.col(category))).alias("previous_category"),
        F.max(F.when(F.col("_rn") == 1, F.col("policy_no"))).alias("last_policy_no"),
        F.max(F.when(F.col("_rn") == 1, F.col("register_date"))).alias("last_register_date"),
        F.max(F.when(F.col("_rn") == 1, F.col(category))).alias("last_category"),
    ).filter(F.col("previous_policy_no").isNotNull())


def first_two(df: DataFrame, party: str = "party_id") -> DataFrame:
    """The client's two oldest policies, numbered in ``_rn``. Every client is trimmed to two
    rows before the shuffle."""
    return _ranked(df, party, 2)


def first_second_pivot(df: DataFrame, party: str = "party_id", first: list[str] | None = None,
                       second: list[str] | None = None) -> DataFrame:
    """First and second policy in one row; the second is null for single-policy clients.

    Takes all policies, or the rows of ``first_two`` with further columns attached. ``first``
    and ``second`` limit the attributes carried along, and with them what is read.
    """
    two = df if "_rn" in df.columns else first_two(df, party)
    first = [c for c in first or FIRST_FIELDS if c in df.columns]
    second = [c for c in second or SECOND_FIELDS if c in df.columns]
    # two aggregates over rows, not one per column
    pair = two.groupBy(party).agg(
        F.max(F.when(F.col("_rn") == 1, F.struct(*first))).alias("_a"),
        F.max(F.when(F.col("_rn") == 2, F.struct(*second))).alias("_b"))
    return pair.select(party, "_a.*", *[F.expr(f"_b.{c} AS second_{c}") for c in second])


def first_second_join(df: DataFrame, party: str = "party_id", category: str = "product_category",
                      how: str = "inner") -> DataFrame:
    """First policy joined with the second: ``inner`` keeps multi-policy clients, ``left`` all."""
    two = _ranked(df, party, 2)
    first = two.filter("_rn = 1").select(
        party, F.col("policy_no").alias("first_policy_no"), F.col("register_date").alias("first_register_date"),
        F.col(category).alias("first_category"), F.col("isrd_brth_date"),
    )
    second = two.filter("_rn = 2").select(
        party, F.col("policy_no").alias("second_policy_no"), F.col("register_date").alias("second_register_date"),
        F.col(category).alias("second_category"),
    )
    return first.join(second, party, how)


def first_second_left(df: DataFrame, party: str = "party_id", category: str = "product_category") -> DataFrame:
    """Keeps single-policy clients, with the gap in months and the age at the second policy."""
    return first_second_join(df, party, category, "left").withColumns({
        "months_to_second": F.months_between("second_register_date", "first_register_date"),
        "age_at_second": F.datediff("second_register_date", "isrd_brth_date") / 365.25,
    })


def neighbour_policy(df: DataFrame, party: str = "party_id", order: str = "desc") -> DataFrame:
    """Attributes of the neighbouring policy, its distance in days and the row's rank.

    ``desc`` looks from the newest policy to the one before it, ``asc`` to the next one.
    """
    fields = {c: n for c, n in NEIGHBOUR_FIELDS.items() if c in df.columns}
    out = with_order(df, party, ORDER, number="rnk", ahead=fields, descending=order == "desc")
    return days_to_neighbour(out)


def days_to_neighbour(df: DataFrame, date: str = "register_date", other: str = "register_date_dt_lead") -> DataFrame:
    return df.withColumn("days_to_cross_sell", F.abs(F.datediff(other, date)))


def next_product(df: DataFrame, party: str = "party_id", column: str = "product_category") -> DataFrame:
    """Each policy with the next one by date; the last policy of a client has none."""
    return with_order(
        df, party, ORDER, ahead={column: "next_product", "register_date": "next_register_date"}
    )


def policy_counts(df: DataFrame, party: str = "party_id") -> DataFrame:
    return df.groupBy(party).agg(F.count(F.lit(1)).alias("policy_count"))


def with_policy_count(df: DataFrame, party: str = "party_id") -> DataFrame:
    """Rows with the client's number of rows: a combined count and a join that spreads large
    clients, no window."""
    return with_totals(df.filter(F.col(party).isNotNull()), party, {"policy_count": F.count(F.lit(1))})


def single_policy_clients(df: DataFrame, party: str = "party_id", distinct_policy: bool = True) -> DataFrame:
    """The one policy of clients that hold exactly one.

    Numbers alone decide who that is, in a hash aggregate; only the rows of those clients are
    then ordered, and cut to the newest before their shuffle.
    """
    alone = F.min("policy_no") == F.max("policy_no") if distinct_policy else F.count(F.lit(1)) == 1
    clients = df.groupBy(party).agg(alone.alias("_alone")).filter("_alone").select(party)
    return first_by(df.join(clients, party, "left_semi"), [party], [F.col(c).desc() for c in ORDER])


def multi_policy_clients(df: DataFrame, party: str = "party_id") -> DataFrame:
    return policy_counts(df, party).filter("policy_count >= 2")


def holdings(df: DataFrame, party: str = "party_id", category: str = "product_category") -> DataFrame:
    """Sorted set of categories held and its size. The set is bounded by the categories."""
    return df.groupBy(party).agg(F.sort_array(F.collect_set(category)).alias("current_products")).withColumn(
        "num_products", F.size("current_products")
    )


def new_holdings(df: DataFrame, held="current_products", first="first_product_category") -> DataFrame:
    """First held product other than the first one, UNKNOWN when there is none."""
    fresh = F.array_except(F.col(held), F.array(F.col(first)))
    return df.withColumn(
        "actual_product_bought", F.when(F.size(fresh) > 0, F.element_at(fresh, 1)).otherwise("UNKNOWN")
    )


def consecutive_pairs(df: DataFrame, column: str = "product_category") -> DataFrame:
    """(current, next) rows of clients' consecutive policies, without the open last one."""
    return next_product(valid_events(df), column=column).filter(F.col("next_product").isNotNull())
