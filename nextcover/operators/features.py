"""Row-level features. All are projections: no shuffle, one pass of generated code."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nextcover.functions.columns import (
    DAYS_PER_YEAR, date_of, finite, flag, log_amount, plus_one_ratio, ratio, right_closed_band,
)
from nextcover.schemas import ASSET_MIX

# ---- fixed values: conditions of the 0/1 features, in SQL ----
CONDITIONS = {
    "high_volatility": "abs(snp_close_variation) > 2",
    "extreme_volatility": "abs(snp_close_variation) > 5",
    "volatile": "abs(snp_close_variation) > 3",
    "calm": "abs(snp_close_variation) < 1",
    "up_3m": "snp_close_lead_3 > 0",
    "up_6m": "snp_close_lead_6 > 0",
    "up_12m": "snp_close_lead_12 > 0",
    "momentum_3m": "snp_close_lead_3 > 5",
    "momentum_6m": "snp_close_lead_6 > 10",
    "growth_6m": "snp_close_lead_6 > 5",
    "growth_12m": "snp_close_lead_12 > 10",
    "falling": "snp_close_lead_6 < -5",
    "from_life": "product_category = 'LIFE_INSURANCE'",
    "from_retirement": "product_category = 'RETIREMENT'",
    "from_investment": "product_category = 'INVESTMENT'",
    "to_life": "cross_sell_product_category = 'LIFE_INSURANCE'",
    "to_retirement": "cross_sell_product_category = 'RETIREMENT'",
    "to_investment": "cross_sell_product_category = 'INVESTMENT'",
    "to_network": "cross_sell_product_category = 'NETWORK_PRODUCTS'",
    "senior": "client_age >= 55",
    "midcareer": "client_age >= 40 AND client_age < 55",
    "young": "client_age < 40",
    "under_45": "client_age < 45",
    "family_age": "client_age >= 30 AND client_age < 55",
    "aum_over_50k": "acct_val_amt > 50000",
    "aum_over_100k": "acct_val_amt > 100000",
    "aum_over_200k": "acct_val_amt > 200000",
    "aum_medium": "acct_val_amt >= 50000 AND acct_val_amt <= 100000",
    "branch": "channel = 'Branch Assist'",
    "advisor": "channel = 'Advisor Assist/Retail'",
    "aggressive": "aggressive_investor = 1",
    "conservative": "conservative_investor = 1",
    "retiring": "retirement_planning_trigger = 1",
    "family": "family_protection_trigger = 1",
    "building": "wealth_building_trigger = 1",
    "within_1y": "days_to_cross_sell < 365",
    "within_1_3y": "days_to_cross_sell >= 365 AND days_to_cross_sell < 1095",
    "after_3y": "days_to_cross_sell >= 1095",
    "after_5y": "days_to_cross_sell >= 1825",
    "long_tenure": "client_tenure_years > 5",
    "new_client": "client_tenure_years < 2",
    "ultra_high": "aum_segment = 'ULTRA_HIGH'",
    "high": "aum_segment = 'HIGH'",
    "medium": "aum_segment = 'MEDIUM'",
}

# group -> feature -> conditions that must all hold
FLAG_GROUPS = {
    "market": {
        "high_market_volatility": "high_volatility",
        "extreme_market_volatility": "extreme_volatility",
        "low_market_volatility": "calm",
        "market_uptrend_3m": "up_3m",
        "market_uptrend_6m": "up_6m",
        "market_uptrend_12m": "up_12m",
        "strong_market_momentum_3m": "momentum_3m",
        "strong_market_momentum_6m": "momentum_6m",
        "stable_growth_market": "calm up_3m",
        "volatile_market": "volatile",
        "declining_market": "falling",
    },
    "affinity": {
        "life_to_retirement_pattern": "from_life to_retirement",
        "life_to_investment_pattern": "from_life to_investment",
        "retirement_to_investment_pattern": "from_retirement to_investment",
        "retirement_to_life_pattern": "from_retirement to_life",
        "investment_to_retirement_pattern": "from_investment to_retirement",
        "investment_to_life_pattern": "from_investment to_life",
    },
    "age_product": {
        "senior_retirement_target": "senior to_retirement",
        "senior_life_target": "senior to_life",
        "senior_investment_target": "senior to_investment",
        "midcareer_retirement_target": "midcareer to_retirement",
        "midcareer_life_target": "midcareer to_life",
        "midcareer_investment_target": "midcareer to_investment",
        "young_retirement_target": "young to_retirement",
        "young_investment_target": "young to_investment",
    },
    "aum_product": {
        "high_aum_investment_target": "aum_over_100k to_investment",
        "high_aum_retirement_target": "aum_over_100k to_retirement",
        "ultra_high_aum_network_target": "aum_over_200k to_network",
        "medium_aum_life_target": "aum_medium to_life",
        "medium_aum_retirement_target": "aum_medium to_retirement",
    },
    "channel_product": {
        "branch_to_retirement": "branch to_retirement",
        "branch_to_life": "branch to_life",
        "advisor_to_investment": "advisor to_investment",
        "advisor_to_retirement": "advisor to_retirement",
    },
    "market_product": {
        "volatile_market_retirement_demand": "volatile to_retirement",
        "volatile_market_life_demand": "volatile to_life",
        "stable_market_investment_demand": "calm to_investment",
        "stable_growth_investment_demand": "calm growth_6m to_investment",
    },
    "risk_product": {
        "aggressive_to_investment": "aggressive to_investment",
        "aggressive_to_network": "aggressive to_network",
        "conservative_to_retirement": "conservative to_retirement",
        "conservative_to_life": "conservative to_life",
    },
    "stage_product": {
        "retirement_trigger_to_retirement": "retiring to_retirement",
        "retirement_trigger_to_investment": "retiring to_investment",
        "retirement_trigger_in_uptrend": "retiring up_12m",
        "family_trigger_to_life": "family to_life",
        "family_trigger_to_retirement": "family to_retirement",
        "wealth_trigger_to_investment": "building to_investment",
        "wealth_trigger_to_retirement": "building to_retirement",
    },
    "timing": {
        "quick_cross_sell": "within_1y",
        "quick_to_investment": "within_1y to_investment",
        "quick_to_retirement": "within_1y to_retirement",
        "medium_timing_cross_sell": "within_1_3y",
        "delayed_cross_sell": "after_3y",
        "very_delayed_cross_sell": "after_5y",
    },
    "product_market": {
        "life_in_volatile_market": "from_life volatile",
        "retirement_in_stable_market": "from_retirement calm",
        "investment_in_growth_market": "from_investment growth_6m",
    },
    "ideal": {
        "ideal_retirement_candidate": "senior aum_over_100k retiring to_retirement",
        "ideal_investment_candidate": "under_45 aum_over_50k building to_investment",
        "ideal_life_candidate": "family_age family to_life",
        "ideal_network_candidate": "aum_over_200k to_network",
    },
    "tenure_product": {
        "long_tenure_retirement_affinity": "long_tenure to_retirement",
        "long_tenure_investment_affinity": "long_tenure to_investment",
        "new_client_investment_affinity": "new_client to_investment",
        "new_client_life_affinity": "new_client to_life",
    },
    "segment_product": {
        "ultra_high_to_network": "ultra_high to_network",
        "ultra_high_to_investment": "ultra_high to_investment",
        "high_to_retirement": "high to_retirement",
        "medium_to_life": "medium to_life",
    },
    "three_way": {
        "volatile_aggressive_investment": "volatile aggressive to_investment",
        "stable_conservative_retirement": "calm conservative to_retirement",
        "growth_retirement_planning": "growth_12m retiring to_retirement",
        "volatile_family_life": "volatile family to_life",
    },
}
LABEL_CONDITIONS = [
    "to_life", "to_retirement", "to_investment", "to_network",
    "within_1y", "within_1_3y", "after_3y", "after_5y",
]
LIFE_STAGE = {
    "retirement_planning_trigger": "client_age BETWEEN 55 AND 65 AND acct_val_amt > 100000",
    "family_protection_trigger": "client_age BETWEEN 30 AND 55 AND acct_val_amt > 50000",
    "wealth_building_trigger": "client_age BETWEEN 40 AND 50 AND monthly_premium_amount > 500",
}
CHANNEL_AFFINITY = {
    "branch_retirement_affinity": "branch from_retirement",
    "advisor_investment_affinity": "advisor from_investment",
}
AUM_LIMITS = [("LOW", 25000), ("MEDIUM", 100000), ("HIGH", 500000)]
AGE_EDGES = [0, 30, 40, 50, 60, 70, 100]
AGE_LABELS = ["0-30", "30-40", "40-50", "50-60", "60-70", "70+"]
AMOUNT_EDGES = [0, 10000, 50000, 100000, None]
AMOUNT_LABELS = ["Low", "Medium", "High", "Very High"]
# ---- end of fixed values ----

# engineered flags that read the label or its date: allowed in reports, never as inputs
LABEL_FEATURES = [
    name
    for group in FLAG_GROUPS.values()
    for name, conditions in group.items()
    if any(c in LABEL_CONDITIONS for c in conditions.split())
]


def condition_sql(names: str) -> str:
    return " AND ".join(f"({CONDITIONS[n]})" for n in names.split())


def flag_group(df: DataFrame, *groups: str) -> DataFrame:
    """The 0/1 features of the named groups, or of all groups."""
    chosen = {n: c for g in (groups or FLAG_GROUPS) for n, c in FLAG_GROUPS[g].items()}
    return df.withColumns({name: flag(condition_sql(c)) for name, c in chosen.items()})


def ages(df: DataFrame, as_of) -> DataFrame:
    """Current age in full years, and ages at the first and second policy."""
    out = df.withColumn("client_age", F.floor(F.datediff(date_of(as_of), F.col("birth_dt")) / DAYS_PER_YEAR))
    if "second_register_date" in df.columns:
        out = out.withColumn("age_at_second_policy", F.datediff("second_register_date", "birth_dt") / DAYS_PER_YEAR)
    return out.withColumn("age_at_first_policy", F.datediff("register_date", "birth_dt") / DAYS_PER_YEAR)


def life_stage(df: DataFrame) -> DataFrame:
    return df.withColumns({name: flag(rule) for name, rule in LIFE_STAGE.items()})


def risk_flags(df: DataFrame) -> DataFrame:
    return df.withColumns({
        "aggressive_investor": flag(ratio("wc_assetmix_stocks", "wc_total_assets") > 0.3),
        "conservative_investor": flag(ratio("wc_assetmix_bonds", "wc_total_assets") > 0.5),
    })


def allocation_ratios(df: DataFrame) -> DataFrame:
    parts = {"stock": "stocks", "bond": "bonds", "annuity": "annuity", "mutual_fund": "mutual_funds"}
    return df.withColumns({
        f"{n}_allocation_ratio": ratio(f"wc_assetmix_{c}", "wc_total_assets") for n, c in parts.items()
    })


def value_ratios(df: DataFrame) -> DataFrame:
    return df.withColumns({
        "aum_to_asset_ratio": ratio("acct_val_amt", "wc_total_assets"),
        "policy_value_to_assets_ratio": ratio("face_amt", "wc_total_assets"),
    })


def premium_ratio(df: DataFrame) -> DataFrame:
    return df.withColumn("premium_to_aum_ratio", ratio("monthly_premium_amount", "acct_val_amt"))


def tenure(df: DataFrame, as_of) -> DataFrame:
    days = F.datediff(date_of(as_of), F.col("register_date"))
    return df.withColumns({
        "client_tenure_days": days,
        "client_tenure_years": days / DAYS_PER_YEAR,
        "client_tenure": F.round(days / DAYS_PER_YEAR, 1),
    })


def aum_segment(c: str = "acct_val_amt", unknown: str | None = None) -> Column:
    """Band of an amount. A missing amount falls into the top band unless ``unknown`` is given."""
    out = F.when(F.lit(False), None) if unknown is None else F.when(F.col(c).isNull(), unknown)
    for label, limit in AUM_LIMITS:
        out = out.when(F.col(c) < limit, label)
    return out.otherwise("ULTRA_HIGH")


def channel_affinity(df: DataFrame) -> DataFrame:
    return df.withColumns({n: flag(condition_sql(c)) for n, c in CHANNEL_AFFINITY.items()})


def enhanced_features(df: DataFrame, as_of) -> DataFrame:
    """Age, life stage, risk, allocation, affinity, tenure and size features in one projection chain."""
    out = life_stage(ages(df, as_of))
    out = premium_ratio(tenure(channel_affinity(allocation_ratios(risk_flags(out))), as_of))
    return out.withColumn("aum_segment", aum_segment())


def season(c: str) -> Column:
    """Quarter of the year as Q1..Q4, Unknown without a date."""
    return F.coalesce(F.concat(F.lit("Q"), F.quarter(c).cast("string")), F.lit("Unknown"))


def years_to_second(df: DataFrame, as_of) -> DataFrame:
    """Years from the first policy to the second, or to ``as_of`` while there is none (flagged)."""
    until = F.coalesce(F.col("second_register_date"), date_of(as_of))
    return df.withColumns({
        "years_to_second": F.datediff(until, F.col("register_date")) / DAYS_PER_YEAR,
        "gap_is_open": flag(F.col("second_register_date").isNull()),
    })


def log_features(df: DataFrame, columns: list[str]) -> DataFrame:
    """log(1 + amount) and an is-zero flag per column, a missing amount counted as zero."""
    filled = {c: F.coalesce(F.col(c), F.lit(0)) for c in columns}
    return df.withColumns(
        {f"{c}_log": log_amount(v) for c, v in filled.items()}
        | {f"{c}_is_zero": flag(v == 0) for c, v in filled.items()}
    )


def numeric_interactions(df: DataFrame) -> DataFrame:
    bond = F.nullif(F.col("bond_allocation_ratio"), F.lit(0))
    return df.withColumns({
        "age_assets": finite(F.col("age_at_first_policy") * F.col("wc_total_assets")),
        "age_equity_ratio": finite(F.col("age_at_first_policy") * F.col("stock_allocation_ratio")),
        "equity_to_bond_ratio": finite(F.col("stock_allocation_ratio") / bond),
        "log_total_assets": finite(log_amount("wc_total_assets")),
    })


def calendar_parts(df: DataFrame, date: str = "register_date") -> DataFrame:
    """Year, month, quarter and weekday (Monday is 0)."""
    return df.withColumns({
        "register_year": F.year(date), "register_month": F.month(date),
        "register_quarter": F.quarter(date), "register_day_of_week": F.weekday(date),
    })


def age_band(c: str) -> Column:
    return right_closed_band(c, AGE_EDGES, AGE_LABELS)


def amount_band(c: str) -> Column:
    """Band of an amount; zero and missing lie below the first band and give null."""
    return right_closed_band(F.coalesce(F.col(c), F.lit(0)), AMOUNT_EDGES, AMOUNT_LABELS)


def days_since(df: DataFrame, reference, date: str = "register_date") -> DataFrame:
    """Days from the date to a reference fitted on the training rows (a one-row frame or a date)."""
    until = reference.scalar() if isinstance(reference, DataFrame) else date_of(reference)
    return df.withColumn("days_since_first_policy", F.datediff(until, F.col(date)))


def fit_reference_date(train: DataFrame, date: str = "register_date") -> DataFrame:
    return train.agg(F.max(date).alias("reference_date"))


def plus_one_ratios(df: DataFrame) -> DataFrame:
    return df.withColumns({
        "face_amt_per_age": plus_one_ratio("face_amt", "psn_age", missing=1),
        "acct_to_face_ratio": plus_one_ratio("acct_val_amt", "face_amt"),
        "premium_to_face_ratio": plus_one_ratio("monthly_premium_amount", "face_amt"),
        "cash_to_account_ratio": plus_one_ratio("cash_val_amt", "acct_val_amt"),
    })


def asset_ratios_plus_one(df: DataFrame) -> DataFrame:
    return df.withColumns({f"{c}_ratio": plus_one_ratio(c, "wc_total_assets") for c in ASSET_MIX})


def status_flags(df: DataFrame) -> DataFrame:
    is_active, is_old = flag(F.col("policy_status") == "Active"), flag(F.col("policy_type") == "Old Policy")
    return df.withColumns({"is_active": is_active, "is_old_policy": is_old, "active_old_policy": is_active * is_old})


def cross_string(a: str, b: str) -> Column:
    return F.concat_ws("_", F.coalesce(F.col(a), F.lit("nan")), F.coalesce(F.col(b), F.lit("nan")))


def snapshot_ratios(df: DataFrame) -> DataFrame:
    """Total of the asset mix and ratios that are zero where the base is not positive."""
    def part(c: str) -> Column:
        return F.coalesce(F.col(c), F.lit(0.0))

    total = sum((part(c) for c in ASSET_MIX[1:]), part(ASSET_MIX[0]))

    def share(top: str, base: Column) -> Column:
        return F.when(base > 0, part(top) / base).otherwise(0.0)

    return df.withColumns({
        "total_assetmix": total,
        "stocks_ratio": share("wc_assetmix_stocks", total),
        "bonds_ratio": share("wc_assetmix_bonds", total),
        "annuity_ratio": share("wc_assetmix_annuity", total),
        "account_to_face_ratio": share("acct_val_amt", F.col("face_amt")),
        "cash_to_account_ratio": share("cash_val_amt", F.col("acct_val_amt")),
    })


def missing_indicators(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({f"{c}_is_missing": F.col(c).isNull().cast("int") for c in columns})
