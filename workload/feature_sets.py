"""Row features and the training table."""

from pyspark.sql import functions as F

from nextcover.functions.columns import finite
from nextcover.functions.classify import classify
from nextcover.operators import features as fe
from nextcover.operators.client360 import join_market
from nextcover.operators.monitor import market_series
from nextcover.plans import next_product, training as plan
from nextcover.schemas import ASSET_MIX
from workload.registry import query, rounded
from workload.sqltext import flags_sql, rd
from workload.views import AS_OF

FIRST_DAY = "1990-01-01"


def first_second_rows(t, *attributes):
    """First and second policies, with the named attributes of the first one."""
    rules = next_product.RULE_FIELDS
    return next_product.first_second(t.policies, t.lookup, [*rules, *attributes], [*rules, "register_date"])


def training(t, flags=True):
    market = market_series(t.market_base)
    if flags:
        return plan.training_table(t.policies, t.lookup, market, AS_OF, FIRST_DAY)
    return join_market(fe.enhanced_features(plan.training_base(t.policies, t.lookup, FIRST_DAY), AS_OF), market)


@query("FEA-1", f"""
SELECT party_id, CAST(FLOOR(date_diff('day', isrd_brth_date, DATE '2002-01-01') / 365.25) AS BIGINT) AS client_age,
  {rd("date_diff('day', isrd_brth_date, register_date) / 365.25")} AS age_at_first_policy,
  {rd("date_diff('day', isrd_brth_date, second_register_date) / 365.25")} AS age_at_second_policy FROM v_fs""")
def client_ages(t):
    rows = first_second_rows(t, "isrd_brth_date", "register_date").withColumnRenamed("isrd_brth_date", "birth_dt")
    return fe.ages(rows, AS_OF).select("party_id", F.col("client_age").cast("long").alias("client_age"), "age_at_first_policy", "age_at_second_policy")


@query("FEA-2 FEA-3", """
SELECT policy_no, CAST(retirement_planning_trigger AS BIGINT) AS retirement_planning_trigger, CAST(family_protection_trigger AS BIGINT) AS family_protection_trigger,
  CAST(wealth_building_trigger AS BIGINT) AS wealth_building_trigger, CAST(aggressive_investor AS BIGINT) AS aggressive_investor,
  CAST(conservative_investor AS BIGINT) AS conservative_investor FROM v_enhanced""")
def life_stage_and_risk(t):
    rows = fe.enhanced_features(plan.training_base(t.policies, t.lookup, FIRST_DAY), AS_OF)
    return rows.select("policy_no", *fe.LIFE_STAGE, "aggressive_investor", "conservative_investor")


@query("FEA-4 FEA-5 FEA-6", "SELECT policy_no, " + ", ".join(f"{rd(f'{a} / NULLIF({b}, 0)')} AS {n}" for n, a, b in [
    ("stock_allocation_ratio", "wc_assetmix_stocks", "wc_total_assets"), ("bond_allocation_ratio", "wc_assetmix_bonds", "wc_total_assets"),
    ("annuity_allocation_ratio", "wc_assetmix_annuity", "wc_total_assets"), ("mutual_fund_allocation_ratio", "wc_assetmix_mutual_funds", "wc_total_assets"),
    ("aum_to_asset_ratio", "acct_val_amt", "wc_total_assets"), ("policy_value_to_assets_ratio", "face_amt", "wc_total_assets"),
    ("premium_to_aum_ratio", "monthly_premium_amount", "acct_val_amt")]) + " FROM v_policies")
def asset_ratios(t):
    rows = fe.premium_ratio(fe.value_ratios(fe.allocation_ratios(t.policies)))
    return rows.select("policy_no", *[f"{x}_allocation_ratio" for x in ("stock", "bond", "annuity", "mutual_fund")],
                       "aum_to_asset_ratio", "policy_value_to_assets_ratio", "premium_to_aum_ratio")


@query("FEA-7", f"""
SELECT policy_no, date_diff('day', register_date, DATE '2002-01-01') AS client_tenure_days, {rd("date_diff('day', register_date, DATE '2002-01-01') / 365.25")} AS client_tenure_years,
  {rd("round(date_diff('day', register_date, DATE '2002-01-01') / 365.25, 1)")} AS client_tenure FROM v_policies""")
def client_tenure(t):
    return fe.tenure(t.policies, AS_OF).select("policy_no", "client_tenure_days", "client_tenure_years", "client_tenure")


@query("FEA-8 FEA-9 FEA-10", """
SELECT policy_no, CASE WHEN face_amt < 25000 THEN 'LOW' WHEN face_amt < 100000 THEN 'MEDIUM' WHEN face_amt < 500000 THEN 'HIGH' ELSE 'ULTRA_HIGH' END AS segment,
  CASE WHEN face_amt IS NULL THEN 'UNKNOWN' WHEN face_amt < 25000 THEN 'LOW' WHEN face_amt < 100000 THEN 'MEDIUM' WHEN face_amt < 500000 THEN 'HIGH' ELSE 'ULTRA_HIGH' END AS segment_known,
  CAST(CASE WHEN channel = 'Branch Assist' AND product_category = 'RETIREMENT' THEN 1 ELSE 0 END AS BIGINT) AS branch_retirement_affinity,
  CAST(CASE WHEN channel = 'Advisor Assist/Retail' AND product_category = 'INVESTMENT' THEN 1 ELSE 0 END AS BIGINT) AS advisor_investment_affinity,
  coalesce('Q' || CAST(quarter(trmn_eff_date) AS VARCHAR), 'Unknown') AS end_season, 'Q' || CAST(quarter(register_date) AS VARCHAR) AS season FROM v_class3""")
def segments_affinity_season(t):
    return fe.channel_affinity(classify(t.policies)).select(
        "policy_no", fe.aum_segment("face_amt").alias("segment"), fe.aum_segment("face_amt", "UNKNOWN").alias("segment_known"),
        "branch_retirement_affinity", "advisor_investment_affinity", fe.season("trmn_eff_date").alias("end_season"), fe.season("register_date").alias("season"))


@query("FEA-11", f"""
SELECT party_id, {rd("date_diff('day', register_date, coalesce(second_register_date, DATE '2002-01-01')) / 365.25")} AS years_to_second,
  CAST(CASE WHEN second_register_date IS NULL THEN 1 ELSE 0 END AS BIGINT) AS gap_is_open FROM v_fs""")
def years_to_second_policy(t):
    return fe.years_to_second(first_second_rows(t, "register_date"), AS_OF).select("party_id", "years_to_second", "gap_is_open")


def _group_query(ids, *groups):
    names = [n for g in groups for n in fe.FLAG_GROUPS[g]]

    def build(t):
        return training(t).select("policy_no", *names)

    query(ids, f"SELECT policy_no, {flags_sql(*groups)} FROM v_training", name="flags_" + "_and_".join(groups))(build)


_group_query("FEA-12", "market")
_group_query("FEA-13 FEA-14 FEA-15", "affinity", "age_product", "aum_product")
_group_query("FEA-16 FEA-17 FEA-18", "channel_product", "market_product", "risk_product")
_group_query("FEA-19 FEA-20 FEA-21", "stage_product", "timing", "product_market")
_group_query("FEA-22 FEA-23 FEA-24 FEA-25", "ideal", "tenure_product", "segment_product", "three_way")

LOGGED = ["face_amt", "cash_val_amt", "acct_val_amt"]


@query("FEA-26 FN-11", "SELECT policy_no, " + ", ".join(
    f"{rd(f'ln(1 + coalesce({c}, 0))')} AS {c}_log, CAST(CASE WHEN coalesce({c}, 0) = 0 THEN 1 ELSE 0 END AS BIGINT) AS {c}_is_zero" for c in LOGGED) + " FROM v_policies")
def log_amounts(t):
    out = fe.log_features(t.policies, LOGGED)
    return out.select("policy_no", *[f"{c}_log" for c in LOGGED], *[f"{c}_is_zero" for c in LOGGED])


@query("FEA-27", f"""
WITH x AS (SELECT *, date_diff('day', birth_dt, register_date) / 365.25 AS age, wc_assetmix_stocks / NULLIF(wc_total_assets, 0) AS s, wc_assetmix_bonds / NULLIF(wc_total_assets, 0) AS b FROM v_policies)
SELECT policy_no, {rd('age * wc_total_assets', 2)} AS age_assets, {rd('age * s')} AS age_equity_ratio, {rd('s / NULLIF(b, 0)')} AS equity_to_bond_ratio,
  {rd('ln(1 + greatest(wc_total_assets, 0))')} AS log_total_assets FROM x""")
def numeric_interactions(t):
    out = fe.numeric_interactions(fe.allocation_ratios(fe.ages(t.policies, AS_OF)))
    return out.select("policy_no", rounded("age_assets", 2).alias("age_assets"), "age_equity_ratio", "equity_to_bond_ratio", "log_total_assets")


@query("FEA-28 FN-8", """
SELECT policy_no, year(register_date) AS register_year, month(register_date) AS register_month, quarter(register_date) AS register_quarter,
  isodow(register_date) - 1 AS register_day_of_week FROM v_policies""")
def calendar_parts(t):
    return fe.calendar_parts(t.policies).select("policy_no", "register_year", "register_month", "register_quarter", "register_day_of_week")


@query("FEA-29 FEA-30", """
SELECT policy_no, CASE WHEN psn_age > 0 AND psn_age <= 30 THEN '0-30' WHEN psn_age <= 40 THEN '30-40' WHEN psn_age <= 50 THEN '40-50' WHEN psn_age <= 60 THEN '50-60'
  WHEN psn_age <= 70 THEN '60-70' WHEN psn_age <= 100 THEN '70+' END AS age_band,
  CASE WHEN coalesce(face_amt, 0) <= 0 THEN NULL WHEN face_amt <= 10000 THEN 'Low' WHEN face_amt <= 50000 THEN 'Medium' WHEN face_amt <= 100000 THEN 'High' ELSE 'Very High' END AS face_band
FROM v_policies""")
def age_and_amount_bands(t):
    return t.policies.select("policy_no", fe.age_band("psn_age").alias("age_band"), fe.amount_band("face_amt").alias("face_band"))


@query("FEA-31", """
SELECT policy_no, date_diff('day', register_date, (SELECT max(register_date) FROM v_policies WHERE CAST(policy_no AS BIGINT) % 5 <> 0)) AS days_since_first_policy FROM v_policies""")
def days_since_reference(t):
    reference = fe.fit_reference_date(t.policies.filter(F.col("policy_no").cast("long") % 5 != 0))
    return fe.days_since(t.policies, reference).select("policy_no", "days_since_first_policy")


@query("FEA-32 FEA-33 FN-13", f"""
SELECT policy_no, {rd('coalesce(face_amt, 0) / (coalesce(psn_age, 1) + 1)', 4)} AS face_amt_per_age, {rd('coalesce(acct_val_amt, 0) / (coalesce(face_amt, 0) + 1)', 4)} AS acct_to_face_ratio,
  {rd('coalesce(monthly_premium_amount, 0) / (coalesce(face_amt, 0) + 1)', 4)} AS premium_to_face_ratio, {rd('coalesce(cash_val_amt, 0) / (coalesce(acct_val_amt, 0) + 1)', 4)} AS cash_to_account_ratio, """ + ", ".join(
    f"{rd(f'coalesce({c}, 0) / (coalesce(wc_total_assets, 0) + 1)', 4)} AS {c}_ratio" for c in ASSET_MIX) + " FROM v_policies")
def plus_one_ratios(t):
    out = fe.asset_ratios_plus_one(fe.plus_one_ratios(t.policies))
    ratios = ["face_amt_per_age", "acct_to_face_ratio", "premium_to_face_ratio", "cash_to_account_ratio", *[f"{c}_ratio" for c in ASSET_MIX]]
    return out.select("policy_no", *[rounded(c, 4).alias(c) for c in ratios])


@query("FEA-34 FEA-35", """
SELECT policy_no, CAST(CASE WHEN policy_status = 'Active' THEN 1 ELSE 0 END AS BIGINT) AS is_active, CAST(CASE WHEN policy_type = 'Old Policy' THEN 1 ELSE 0 END AS BIGINT) AS is_old_policy,
  CAST(CASE WHEN policy_status = 'Active' AND policy_type = 'Old Policy' THEN 1 ELSE 0 END AS BIGINT) AS active_old_policy,
  product_category || '_' || aum_band AS product_aum, product_category || '_' || coalesce(client_seg, 'nan') AS product_segment FROM v_class3""")
def status_flags_and_crosses(t):
    return fe.status_flags(classify(t.policies)).select(
        "policy_no", "is_active", "is_old_policy", "active_old_policy", fe.cross_string("product_category", "aum_band").alias("product_aum"),
        fe.cross_string("product_category", "client_seg").alias("product_segment"))


MIX = " + ".join(f"coalesce({c}, 0)" for c in ASSET_MIX)


@query("FEA-36", f"""
SELECT policy_no, {rd('m', 2)} AS total_assetmix, {rd('CASE WHEN m > 0 THEN wc_assetmix_stocks / m ELSE 0 END')} AS stocks_ratio, {rd('CASE WHEN m > 0 THEN wc_assetmix_bonds / m ELSE 0 END')} AS bonds_ratio,
  {rd('CASE WHEN m > 0 THEN coalesce(wc_assetmix_annuity, 0) / m ELSE 0 END')} AS annuity_ratio, {rd('CASE WHEN face_amt > 0 THEN acct_val_amt / face_amt ELSE 0 END')} AS account_to_face_ratio,
  {rd('CASE WHEN acct_val_amt > 0 THEN coalesce(cash_val_amt, 0) / acct_val_amt ELSE 0 END')} AS cash_to_account_ratio FROM (SELECT *, {MIX} AS m FROM v_policies)""")
def snapshot_ratios(t):
    return fe.snapshot_ratios(t.policies).select("policy_no", rounded("total_assetmix", 2).alias("total_assetmix"), "stocks_ratio", "bonds_ratio",
                                                 "annuity_ratio", "account_to_face_ratio", "cash_to_account_ratio")


@query("FEA-37", "SELECT policy_no, " + ", ".join(f"CAST(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END AS BIGINT) AS {c}_is_missing" for c in ["face_amt", "cash_val_amt", "client_seg"]) + " FROM v_policies")
def missing_indicators(t):
    columns = ["face_amt", "cash_val_amt", "client_seg"]
    return fe.missing_indicators(t.policies, columns).select("policy_no", *[f"{c}_is_missing" for c in columns])


@query("FN-4 FN-5 FN-6 FN-7 FN-9 FN-10 FN-12 FN-14 FN-16", f"""
SELECT policy_no, CAST(last_day(register_date) AS VARCHAR) AS month_end, strftime(register_date - INTERVAL 90 DAY, '%Y%m') AS decision_month,
  '$' || format('{{:,}}', CAST(acct_val_amt AS BIGINT)) AS shown, CAST(CASE WHEN month(register_date) = 1 THEN (year(register_date) - 1) * 100 + 12 ELSE year(register_date) * 100 + month(register_date) - 1 END AS BIGINT) AS previous_month,
  split_part(branch_name, ' ', 2) AS branch, {rd('greatest(face_amt, cash_val_amt, acct_val_amt)', 2)} AS largest FROM (SELECT * REPLACE (floor(acct_val_amt) AS acct_val_amt) FROM v_policies)""")
def scalar_functions(t):
    from nextcover.functions.columns import money, shift_month, yyyymm

    base = t.policies.withColumn("acct_val_amt", F.floor("acct_val_amt").cast("double"))
    return base.select(
        "policy_no", F.last_day("register_date").alias("month_end"), F.date_format(F.date_sub("register_date", 90), "yyyyMM").alias("decision_month"),
        money("acct_val_amt").alias("shown"), shift_month(yyyymm("register_date"), -1).alias("previous_month"),
        F.split("branch_name", " ")[1].alias("branch"), rounded(finite(F.greatest("face_amt", "cash_val_amt", "acct_val_amt")), 2).alias("largest"))


@query("WIN-5 JN-2", f"""
SELECT policy_no, CAST(register_date_dt_lead AS VARCHAR) AS register_date_dt_lead, snp_business_month, {rd('snp_close_variation', 4)} AS snp_close_variation,
  CAST(days_to_cross_sell AS BIGINT) AS days_to_cross_sell, cross_sell_product_category, aum_segment FROM v_training""")
def training_rows(t):
    return training(t).select("policy_no", "register_date_dt_lead", "snp_business_month", rounded("snp_close_variation", 4).alias("snp_close_variation"),
                              "days_to_cross_sell", "cross_sell_product_category", "aum_segment")


