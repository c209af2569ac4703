"""The cross-sell training table: base, features, market context, interaction flags."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nextcover.functions.classify import classify, sub_target_flags, target_flags
from nextcover.operators.clean import since
from nextcover.operators.client360 import join_market, join_product_lookup
from nextcover.operators.features import enhanced_features, flag_group
from nextcover.operators.ordered import first_by
from nextcover.operators.policies import NEIGHBOUR_FIELDS, ORDER, days_to_neighbour
from nextcover.schemas import ASSET_MIX
from nextcover.sources.readers import latest_month


# ---- fixed values: attributes of a policy in the training base ----
BASE_FIELDS = [
    "party_id", "policy_no", "register_date", "prod_lob", "sub_product_level_1", "sub_product_level_2",
    "product", "trmn_eff_date", "acct_val_amt", "face_amt", "cash_val_amt", "birth_dt", "psn_age", "channel",
    "client_seg", "aum_band", "wc_total_assets", *ASSET_MIX, "monthly_premium_amount",
]
# ---- end of fixed values ----


def newest_two(df: DataFrame, party: str = "party_id") -> DataFrame:
    """The client's two newest policies, numbered in ``_rn``; trimmed before the shuffle."""
    return first_by(df, [party], [F.col(c).desc() for c in ORDER], 2, rank="_rn")


def newest_with_neighbour(two: DataFrame, party: str = "party_id") -> DataFrame:
    """The newest policy of clients with two or more, with the one before it.

    The same rows as ``neighbour_policy`` with rank 1, from two rows per client instead of a
    window over all of them.
    """
    others = [c for c in two.columns if c not in (party, "_rn")]
    newest = F.max(F.when(F.col("_rn") == 1, F.struct(*others)))
    before = F.max(F.when(F.col("_rn") == 2, F.struct(*NEIGHBOUR_FIELDS)))
    pair = two.groupBy(party).agg(newest.alias("_new"), before.alias("_old")).filter(F.col("_old").isNotNull())
    leads = [F.col("_old")[c].alias(n) for c, n in NEIGHBOUR_FIELDS.items()]
    return days_to_neighbour(pair.select(party, "_new.*", *leads))


def training_base(policies: DataFrame, lookup: DataFrame, first_day: str = "2022-01-01") -> DataFrame:
    """Classified newest policy per cross-sale client with its neighbour and the targets."""
    current = latest_month(policies).filter(F.col("party_id").isNotNull() & F.col("policy_no").isNotNull())
    rows = join_product_lookup(current, lookup).select(*BASE_FIELDS).distinct()
    # the rules see two policies per client only
    classified = classify(newest_two(rows), product="product")
    # keyed conditions come after the reduction: they are about the newest policy only
    base = since(newest_with_neighbour(classified), first_day).filter(
        F.col("cross_sell_product_category").isNotNull() & (F.col("cross_sell_product_category") != "OTHER"))
    return sub_target_flags(target_flags(base))


def training_table(policies: DataFrame, lookup: DataFrame, market: DataFrame, as_of,
                   first_day: str = "2022-01-01", lag_days: int = 90) -> DataFrame:
    """Base with client features, market context at the decision and all interaction flags."""
    features = enhanced_features(training_base(policies, lookup, first_day), as_of)
    return flag_group(join_market(features, market, lag_days))
