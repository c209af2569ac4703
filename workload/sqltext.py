"""SQL text for the DuckDB side: rule tables written out as CASE, and views on top of the
bound tables."""

from __future__ import annotations

from nextcover.functions import classify as c
from nextcover.operators import features as fe
from nextcover.operators.scoring import PRODUCTS
from nextcover.schemas import ASSET_MIX

FIELDS3 = {"lob": "prod_lob", "level1": "sub_product_level_1", "level2": "sub_product_level_2"}
FIELDS4 = FIELDS3 | {"product": "product"}


def _alternative(a, fields) -> str | None:
    if a[0] == "all":
        return "(" + " AND ".join(_alternative(x, fields) for x in a[1:]) + ")"
    field, kind, values = a
    if field not in fields:
        return None
    if kind == "in":
        return f"{fields[field]} IN (" + ", ".join(f"'{v}'" for v in values) + ")"
    return "(" + " OR ".join(f"{fields[field]} LIKE '{v}'" for v in values) + ")"


def _or(alternatives, fields) -> str:
    return " OR ".join(x for x in (_alternative(a, fields) for a in alternatives) if x)


def case(rules, fields, default="NULL") -> str:
    whens = [f"WHEN {_or(alts, fields)} THEN '{label}'" for label, *alts in rules if _or(alts, fields)]
    return "CASE " + " ".join(whens) + f" ELSE {default} END"


def gated(gate, rules, fields, default) -> str:
    return f"CASE WHEN {_or(gate, fields)} THEN {case(rules, fields, default)} END"


CATEGORY3 = case(c.CATEGORY_RULES, FIELDS3, "'OTHER'")
CATEGORY4 = case(c.CATEGORY_RULES, FIELDS4, "'OTHER'")
SECOND_FIELDS = {k: f"second_{v}" for k, v in FIELDS4.items()}
CATEGORY_SECOND = (
    "CASE WHEN second_policy_no IS NOT NULL THEN " + case(c.CATEGORY_RULES, SECOND_FIELDS, "'OTHER'") + " END"
)
SUBCATEGORIES = f"""
  {gated(c.RETIREMENT_GATE, c.RETIREMENT_SUB_RULES, FIELDS4, "'RETIREMENT_OTHER'")} AS retirement_sub_category,
  {gated(c.LIFE_GATE, c.LIFE_SUB_RULES, FIELDS4, "'LIFE_OTHER'")} AS life_sub_category,
  {gated(c.INVESTMENT_GATE, c.INVESTMENT_SUB_RULES, FIELDS4, "'INVESTMENT_OTHER'")} AS investment_sub_category,
  {case(c.TAX_RULES, FIELDS4)} AS tax_treatment,
  {case(c.INVESTMENT_TYPE_RULES, FIELDS4)} AS investment_type,
  {case(c.ACCOUNT_TYPE_RULES, FIELDS4)} AS account_type"""

NORMALISED = "TRIM(UPPER(REPLACE(LTRIM(REPLACE({0}, '0', ' ')), ' ', '0')))"


def flags_sql(*groups: str) -> str:
    chosen = {n: x for g in (groups or fe.FLAG_GROUPS) for n, x in fe.FLAG_GROUPS[g].items()}
    return ", ".join(
        f"CAST(CASE WHEN {fe.condition_sql(x)} THEN 1 ELSE 0 END AS BIGINT) AS {n}" for n, x in chosen.items())


def rd(expression: str, digits: int = 6) -> str:
    """A double rounded like the Spark side of the comparison."""
    return f"(ROUND(CAST({expression} AS DOUBLE), {digits}) + 0.0)"


def score_case(expr: str) -> str:
    """Text per product, as a UNION ALL body."""
    return " UNION ALL ".join(expr.format(p=p) for p in PRODUCTS)


SUB_TARGETS_SQL = ", ".join(
    f"CAST(CASE WHEN {col} {'LIKE' if kind == 'like' else '='} '{v}' THEN 1 ELSE 0 END AS BIGINT) AS {n}"
    for n, (col, kind, v) in c.SUB_TARGETS.items())
TARGETS_SQL = ", ".join(
    f"CAST(CASE WHEN cross_sell_product_category = '{x}' THEN 1 ELSE 0 END AS BIGINT) AS {x.lower()}_cross_sell"
    for x in c.TARGET_CATEGORIES)

FIRST = [
    "policy_no", "register_date", "trmn_eff_date", "wti_lob_txt", "prod_lob", "agt_class", "isrd_brth_date",
    "psn_age", "acct_val_amt", "face_amt", "cash_val_amt", "wc_total_assets", *ASSET_MIX, "client_seg",
    "client_seg_1", "aum_band", "sub_product_level_1", "sub_product_level_2", "product", "business_month",
    "branchoffice_code", "agt_no", "division_name", "policy_status", "channel", "agent_segment",
]
SECOND = [
    "policy_no", "register_date", "trmn_eff_date", "wti_lob_txt", "prod_lob", "sub_product_level_1",
    "sub_product_level_2", "product",
]
AGE = "FLOOR(date_diff('day', birth_dt, DATE '2002-01-01') / 365.25)"

DERIVED = {
    "v_policies_p": f"""
SELECT p.*, h.product FROM v_policies p LEFT JOIN (
  SELECT DISTINCT UPPER(source_sys_id) AS s, TRIM(UPPER(idb_plan_cd)) AS a, TRIM(UPPER(idb_sub_plan_cd)) AS b,
         TRIM(stmt_plan_typ_txt) AS product FROM v_product_lookup) h
ON UPPER(p.source_sys_id) = h.s AND {NORMALISED.format('p.plan_code')} = h.a
   AND {NORMALISED.format('p.plan_subcd_code')} = h.b""",
    "v_class3": f"SELECT *, {CATEGORY3} AS product_category FROM v_policies",
    "v_class4": f"SELECT *, {CATEGORY4} AS product_category, {SUBCATEGORIES} FROM v_policies_p",
    "v_ranked3": """
SELECT *, row_number() OVER w AS event_index, lead(product_category) OVER w AS next_product,
  lead(register_date) OVER w AS next_register_date,
  row_number() OVER (PARTITION BY party_id ORDER BY register_date DESC, policy_no DESC) AS rn_desc
FROM v_class3 WINDOW w AS (PARTITION BY party_id ORDER BY register_date, policy_no)""",
    "v_neighbour": """
SELECT *, lead(policy_no) OVER w AS policy_no_lead, lead(register_date) OVER w AS register_date_dt_lead,
  lead(prod_lob) OVER w AS prod_lob_lead, lead(product_category) OVER w AS cross_sell_product_category,
  lead(retirement_sub_category) OVER w AS cross_sell_retirement_sub,
  lead(life_sub_category) OVER w AS cross_sell_life_sub,
  lead(investment_sub_category) OVER w AS cross_sell_investment_sub,
  lead(tax_treatment) OVER w AS cross_sell_tax_treatment,
  abs(date_diff('day', register_date, lead(register_date) OVER w)) AS days_to_cross_sell,
  row_number() OVER w AS rnk
FROM v_class4 WINDOW w AS (PARTITION BY party_id ORDER BY register_date DESC, policy_no DESC)""",
    "v_base": """
SELECT * FROM v_neighbour WHERE rnk = 1 AND policy_no_lead IS NOT NULL
  AND cross_sell_product_category IS NOT NULL AND cross_sell_product_category <> 'OTHER'""",
    "v_enhanced": f"""
SELECT *,
  CASE WHEN client_age BETWEEN 55 AND 65 AND acct_val_amt > 100000 THEN 1 ELSE 0 END AS retirement_planning_trigger,
  CASE WHEN client_age BETWEEN 30 AND 55 AND acct_val_amt > 50000 THEN 1 ELSE 0 END AS family_protection_trigger,
  CASE WHEN client_age BETWEEN 40 AND 50 AND monthly_premium_amount > 500 THEN 1 ELSE 0 END AS wealth_building_trigger
FROM (SELECT *, {AGE} AS client_age,
  CASE WHEN wc_assetmix_stocks / NULLIF(wc_total_assets, 0) > CAST(0.3 AS DOUBLE) THEN 1 ELSE 0 END AS aggressive_investor,
  CASE WHEN wc_assetmix_bonds / NULLIF(wc_total_assets, 0) > CAST(0.5 AS DOUBLE) THEN 1 ELSE 0 END AS conservative_investor,
  wc_assetmix_stocks / NULLIF(wc_total_assets, 0) AS stock_allocation_ratio,
  wc_assetmix_bonds / NULLIF(wc_total_assets, 0) AS bond_allocation_ratio,
  date_diff('day', register_date, DATE '2002-01-01') AS client_tenure_days,
  date_diff('day', register_date, DATE '2002-01-01') / 365.25 AS client_tenure_years,
  CASE WHEN acct_val_amt < 25000 THEN 'LOW' WHEN acct_val_amt < 100000 THEN 'MEDIUM'
       WHEN acct_val_amt < 500000 THEN 'HIGH' ELSE 'ULTRA_HIGH' END AS aum_segment
  FROM v_base)""",
    "v_market": """
SELECT CAST(month_int AS VARCHAR) AS snp_business_month,
  100.0 * (close - lag(close) OVER w) / lag(close) OVER w AS snp_close_variation,
  100.0 * (lead(close, 3) OVER w - close) / close AS snp_close_lead_3,
  100.0 * (lead(close, 6) OVER w - close) / close AS snp_close_lead_6,
  100.0 * (lead(close, 12) OVER w - close) / close AS snp_close_lead_12
FROM v_market_base WINDOW w AS (ORDER BY month_int)""",
    "v_training": """
SELECT f.*, m.* FROM v_enhanced f JOIN v_market m
ON m.snp_business_month = strftime(f.register_date_dt_lead - INTERVAL 90 DAY, '%Y%m')""",
    "v_active4": """
SELECT * FROM v_class4 WHERE policy_status = 'Active'
  AND business_month = (SELECT max(business_month) FROM v_class4)""",
    "v_fs": "SELECT *, " + CATEGORY_SECOND + " AS second_product_category FROM (SELECT *, " + CATEGORY4
            + " AS product_category FROM (SELECT party_id, "
            + ", ".join(f"max(CASE WHEN rn = 1 THEN {x} END) AS {x}" for x in FIRST) + ", "
            + ", ".join(f"max(CASE WHEN rn = 2 THEN {x} END) AS second_{x}" for x in SECOND)
            + """ FROM (SELECT *, row_number() OVER (PARTITION BY party_id ORDER BY register_date, policy_no) AS rn
   FROM v_policies_p WHERE policy_status = 'Active') WHERE rn <= 2 GROUP BY party_id))""",
    "v_bought": "SELECT * FROM v_fs WHERE second_product_category IS NOT NULL",
    # changes of category per client, numbered, with alphabetical ids
    "v_changes": """
SELECT party_id, register_date, policy_no, product_category AS value,
  row_number() OVER (PARTITION BY party_id ORDER BY register_date, policy_no) AS position,
  dense_id AS id
FROM (SELECT *, lag(product_category) OVER (PARTITION BY party_id ORDER BY register_date, policy_no) AS before FROM v_class3) x
JOIN (SELECT product_category AS pc, row_number() OVER (ORDER BY product_category) AS dense_id
      FROM (SELECT DISTINCT product_category FROM v_class3)) v ON v.pc = x.product_category
WHERE before IS NULL OR before <> product_category""",
    "v_examples": """
SELECT party_id, position, id AS label,
  list(id) OVER (PARTITION BY party_id ORDER BY position ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS h
FROM v_changes""",
    "v_long_scores": " UNION ALL ".join(
        f"SELECT party_id, '{p}' AS product, {p}_score AS score FROM v_scores" for p in PRODUCTS),
    "v_best": """
SELECT s.*, b.best_product, b.best_score, b.second_best_product, b.second_best_score,
  (SELECT 0) AS zero
FROM v_scores s JOIN (
  SELECT party_id, max(CASE WHEN rn = 1 THEN product END) AS best_product, max(CASE WHEN rn = 1 THEN score END) AS best_score,
    max(CASE WHEN rn = 2 THEN product END) AS second_best_product, max(CASE WHEN rn = 2 THEN score END) AS second_best_score
  FROM (SELECT *, row_number() OVER (PARTITION BY party_id ORDER BY score DESC,
      CASE product WHEN 'investment' THEN 0 WHEN 'retirement' THEN 1 WHEN 'life_insurance' THEN 2 ELSE 3 END) AS rn
    FROM v_long_scores) GROUP BY party_id) b ON s.party_id = b.party_id""",
    "v_flagged": "SELECT *, " + ", ".join(
        "CAST(" + " + ".join(f"CASE WHEN {p}_score > CAST({t} AS DOUBLE) THEN 1 ELSE 0 END" for p in PRODUCTS)
        + f" AS BIGINT) AS {n}_score_count"
        for n, t in (("high", 0.7), ("medium", 0.6), ("base", 0.5))) + " FROM v_best",
    "v_score_table": "SELECT f.*, " + ", ".join(
        f"CAST(CASE WHEN {n}_score_count >= 2 THEN 1 ELSE 0 END AS BIGINT) AS multi_product_opportunity_{n}"
        for n in ("high", "medium", "base")) + ", " + ", ".join(
        f"rank() OVER (ORDER BY {p}_score DESC) AS {p}_rank" for p in PRODUCTS) + ", " + ", ".join(
        "11 - (1 + " + " + ".join(
            f"CASE WHEN {p}_score > (SELECT quantile_cont({p}_score, {k / 10}) FROM v_scores) THEN 1 ELSE 0 END"
            for k in range(1, 10)) + f") AS {p}_decile" for p in PRODUCTS) + " FROM v_flagged f",
    "v_top5": """
SELECT *, row_number() OVER (PARTITION BY party_id, product ORDER BY abs(contribution) DESC, feature) AS rank
FROM v_contributions QUALIFY rank <= 5""",
    "v_confidence": """
SELECT party_id, best_product AS predicted_product, best_score AS pred_prob FROM v_best""",
    # label = category of the next policy, prediction = category of this one
    "v_labelled": """
SELECT party_id, policy_no, next_product AS label, product_category AS prediction FROM v_ranked3
WHERE next_product IS NOT NULL""",
}
PLUS = "CASE WHEN abs(contribution) > 0.1 THEN '+++' WHEN abs(contribution) > 0.05 THEN '++' ELSE '+' END"
TEXT = """CASE feature
  WHEN 'acct_val_amt' THEN 'Account value of $' || value
  WHEN 'client_age' THEN 'Age ' || value
  WHEN 'aum_segment' THEN 'AUM tier: ' || value
  WHEN 'channel' THEN 'Channel: ' || value
  WHEN 'snp_close_lead_6' THEN 'S&P 6-month trend: +' || value || '.0%'
  WHEN 'client_tenure_years' THEN value || ' years with us' END"""
DERIVED["v_points"] = f"SELECT *, {PLUS} || ' ' || {TEXT} AS talking_point FROM v_top5"
DERIVED["v_explanations"] = """
SELECT t.party_id, t.product, s.score, list(feature ORDER BY rank) AS top_features,
  list(contribution ORDER BY rank) AS top_contributions, list(value ORDER BY rank) AS top_feature_values,
  list(talking_point ORDER BY rank) AS talking_points, 200112 AS prediction_month
FROM v_points t JOIN v_long_scores s ON t.party_id = s.party_id AND t.product = s.product
GROUP BY t.party_id, t.product, s.score"""
