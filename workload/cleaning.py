"""Projection, cleaning and filters."""

from pyspark.sql import functions as F

from nextcover.functions.classify import classify
from nextcover.functions.columns import normalize_code
from nextcover.operators import clean, policies as pol
from nextcover.sources.readers import latest_month
from workload.registry import query
from workload.sqltext import NORMALISED, rd


@query("PRJ-1", """
SELECT party_id, policy_no, CAST(register_date AS VARCHAR) AS first_register_date, product_category AS first_product_category,
  (ROUND(acct_val_amt, 6) + 0.0) AS first_acct_val_amt, (ROUND(face_amt, 6) + 0.0) AS first_face_amt,
  (ROUND(cash_val_amt, 6) + 0.0) AS first_cash_val_amt, (ROUND(wc_total_assets, 6) + 0.0) AS wc_total_assets,
  CAST(psn_age AS BIGINT) AS psn_age, client_seg, aum_band, channel, branchoffice_code FROM v_class3""")
def first_policy_names(t):
    return clean.first_policy_view(classify(t.policies))


@query("PRJ-2 PRJ-4 PRJ-5 CLN-5", """
SELECT DISTINCT party_id AS partyid, wti_lob_txt AS WTI_LOB_TXT, channel AS Channel FROM v_policies""")
def resolved_distinct_columns(t):
    dropped = clean.drop_cols(t.policies, ["policy_no", "acct_val_amt"])
    resolved = clean.resolve_columns(dropped, ["partyid", "WTI_LOB_TXT", "Channel", "policy_no"])
    return clean.distinct_rows(clean.clean_names(resolved))


@query("CLN-1", """
SELECT policy_no, CASE WHEN sub_product_level_1 = 'OTHERS' THEN 'given' ELSE sub_product_level_1 END AS level1,
  NULLIF(CASE WHEN CAST(policy_no AS BIGINT) % 3 = 0 THEN '' WHEN CAST(policy_no AS BIGINT) % 3 = 1 THEN 'NULL' ELSE channel END, '') AS untouched,
  CASE WHEN CAST(policy_no AS BIGINT) % 3 = 2 THEN channel END AS cleaned FROM v_policies""")
def null_token_columns(t):
    k = F.col("policy_no").cast("long") % 3
    raw = F.when(k == 0, "").when(k == 1, "NULL").otherwise(F.col("channel"))
    df = t.policies.select(
        "policy_no", F.when(F.col("sub_product_level_1") == "OTHERS", "given").otherwise(F.col("sub_product_level_1")).alias("level1"),
        F.nullif(raw, F.lit("")).alias("untouched"), raw.alias("cleaned"))
    return clean.null_tokens(df, ["cleaned"])


@query("CLN-2", f"""
SELECT policy_no, {rd("TRY_CAST(CASE WHEN CAST(policy_no AS BIGINT) % 7 = 0 THEN 'n/a' ELSE policy_no || '.5' END AS DOUBLE)")} AS amount
FROM v_policies""")
def numbers_from_text(t):
    text = F.when(F.col("policy_no").cast("long") % 7 == 0, "n/a").otherwise(F.concat("policy_no", F.lit(".5")))
    return clean.to_number(t.policies.select("policy_no", text.alias("amount")), ["amount"])


@query("CLN-3", """
SELECT policy_no, CAST(CASE WHEN CAST(policy_no AS BIGINT) % 7 = 0 THEN NULL ELSE register_date END AS VARCHAR) AS day FROM v_policies""")
def dates_from_text(t):
    text = F.when(F.col("policy_no").cast("long") % 7 == 0, "unknown").otherwise(F.col("register_date").cast("string"))
    return clean.to_dates(t.policies.select("policy_no", text.alias("day")), ["day"])


@query("CLN-4", f"SELECT policy_no, {rd('CAST(acct_val_amt AS DECIMAL(18,2))')} AS amount FROM v_policies")
def doubles_from_decimals(t):
    return clean.decimals_to_double(t.policies.select("policy_no", F.col("acct_val_amt").cast("decimal(18,2)").alias("amount")))


@query("CLN-6", """
SELECT party_id, agt_no, policy_no FROM v_policies
QUALIFY row_number() OVER (PARTITION BY party_id, agt_no ORDER BY register_date, policy_no) = 1""")
def one_row_per_party_and_agent(t):
    return clean.dedupe_by(t.policies, ["party_id", "agt_no"], [F.asc("register_date"), F.asc("policy_no")]).select("party_id", "agt_no", "policy_no")


@query("CLN-7", """
SELECT party_id, CAST(register_date AS VARCHAR) AS register_date, product_category, policy_no FROM v_class3
QUALIFY row_number() OVER (PARTITION BY party_id, register_date, product_category ORDER BY policy_no) = 1""")
def one_event_per_day_and_category(t):
    keys = ["party_id", "register_date", "product_category"]
    return clean.dedupe_by(classify(t.policies), keys, [F.asc("policy_no")]).select(*keys, "policy_no")


@query("CLN-8", """
SELECT party_id, policy_no, CAST(register_date AS VARCHAR) AS register_date FROM v_ranked3 WHERE event_index = 1""")
def one_row_per_client(t):
    return clean.dedupe_by(t.policies, ["party_id"], [F.asc("register_date"), F.asc("policy_no")]).select("party_id", "policy_no", "register_date")


@query("CLN-9", f"""
SELECT policy_no, {rd('avg(psn_age + CAST(policy_no AS BIGINT) % 5) OVER (PARTITION BY party_id)')} AS psn_age FROM v_policies""")
def harmonised_age(t):
    aged = t.policies.select("party_id", "policy_no", (F.col("psn_age") + F.col("policy_no").cast("long") % 5).alias("psn_age"))
    return clean.mean_age(aged).select("policy_no", "psn_age")


@query("CLN-10", """
SELECT policy_no, (ROUND(CASE WHEN CAST(policy_no AS BIGINT) % 5 = 0 THEN NULL ELSE acct_val_amt END, 6) + 0.0) AS amount FROM v_policies""")
def finite_amounts(t):
    k = F.col("policy_no").cast("long") % 10
    odd = F.when(k == 0, F.lit(float("inf"))).when(k == 5, F.lit(float("nan"))).otherwise(F.col("acct_val_amt"))
    return clean.finite_columns(t.policies.select("policy_no", odd.alias("amount")), ["amount"])


@query("FLT-1 FLT-7 FLT-8", """
SELECT policy_no, product_category FROM v_class3 WHERE party_id IS NOT NULL AND register_date IS NOT NULL
  AND product_category IS NOT NULL AND strt_date IS NOT NULL AND end_date IS NOT NULL AND face_amt IS NOT NULL""")
def complete_events(t):
    kept = clean.complete_period(clean.valid_events(classify(t.policies)))
    return clean.require_values(kept, ["face_amt"]).select("policy_no", "product_category")


@query("FLT-2", "SELECT policy_no FROM v_policies WHERE policy_status = 'Active' AND branchoffice_code = '3' AND business_month = 200112")
def active_in_branch(t):
    return clean.in_branch(clean.active(latest_month(t.policies)), "3").select("policy_no")


@query("FLT-3 FLT-4 FLT-6", """
SELECT policy_no, product_category FROM v_class3
WHERE register_date >= DATE '2000-01-01' AND psn_age BETWEEN 25 AND 60 AND product_category <> 'OTHER'""")
def recent_valid_targets(t):
    kept = clean.in_range(clean.since(classify(t.policies), "2000-01-01"), "psn_age", 25, 60)
    return clean.valid_targets(kept).select("policy_no", "product_category")


@query("FLT-5", """
SELECT policy_no, party_id FROM v_policies WHERE party_id IN (SELECT party_id FROM v_scores WHERE investment_score > 0.5)""")
def policies_of_listed_clients(t):
    return clean.restrict_to(t.policies, clean.above(t.scores, "investment_score", 0.5), "party_id").select("policy_no", "party_id")


@query("FLT-9", f"SELECT party_id, product, {rd('score')} AS score FROM v_long_scores WHERE score > 0.95")
def scores_above_threshold(t):
    from nextcover.operators.scoring import long_scores

    return clean.above(long_scores(t.scores), "score", 0.95)


@query("SET-1", """
SELECT party_id, policy_no, CASE WHEN CAST(policy_no AS BIGINT) % 5 = 0 THEN CAST(1 AS BIGINT) ELSE CAST(0 AS BIGINT) END AS is_validation FROM v_policies""")
def flagged_union(t):
    base, k = t.policies.select("party_id", "policy_no"), F.col("policy_no").cast("long") % 5
    return clean.union_flagged(base.filter(k != 0), base.filter(k == 0).select("policy_no", "party_id"))


@query("SET-2", "SELECT DISTINCT division_name, branch_name FROM v_policies")
def distinct_branches(t):
    return clean.distinct_rows(t.policies.select("division_name", "branch_name"))


@query("FN-1 FN-2 FN-3", f"""
SELECT policy_no, {NORMALISED.format("plan_code")} AS plan, {NORMALISED.format("plan_code || plan_subcd_code")} AS joined_code,
  source_sys_id || '-' || UPPER(source_sys_id) AS system FROM v_policies""")
def normalised_codes(t):
    return t.policies.select(
        "policy_no", normalize_code("plan_code").alias("plan"), normalize_code(F.concat("plan_code", "plan_subcd_code")).alias("joined_code"),
        F.concat_ws("-", "source_sys_id", F.upper("source_sys_id")).alias("system"))


@query("PRJ-3", """
SELECT CAST(count(*) AS BIGINT) AS rows, CAST(59 AS BIGINT) AS label_features, CAST(15 AS BIGINT) AS safe_features FROM v_training""")
def leakage_guard(t):
    """The training table without its leaking columns; the safe flags survive."""
    from nextcover.operators.features import FLAG_GROUPS, LABEL_FEATURES
    from workload.feature_sets import training

    table = training(t)
    safe = clean.exclude_leakage(table.columns, LABEL_FEATURES)
    clean.assert_no_leakage(safe, LABEL_FEATURES)
    engineered = [n for g in FLAG_GROUPS.values() for n in g]
    return table.select(*safe).agg(F.count(F.lit(1)).alias("rows")).select(
        "rows", F.lit(len([n for n in engineered if n not in safe])).alias("label_features"),
        F.lit(len([n for n in engineered if n in safe])).alias("safe_features"))


@query("WIN-12", """
SELECT party_id, policy_no, event_index AS sequence_no FROM v_ranked3""")
def policy_sequence_number(t):
    return pol.event_index(t.policies, name="sequence_no").select("party_id", "policy_no", "sequence_no")
