"""Ordered and ranked operators."""

from pyspark.sql import functions as F

from nextcover.functions.classify import classify
from nextcover.operators import advisor, monitor, ordered, policies as pol, scoring as sc
from workload.aggregations import confident
from workload.classification import with_product
from workload.joins import SMALL_CLIENTS, small_clients
from workload.registry import query, rounded
from workload.sqltext import rd


@query("WIN-1", "SELECT party_id, policy_no, event_index FROM v_ranked3")
def event_index(t):
    return pol.event_index(t.policies).select("party_id", "policy_no", "event_index")


@query("WIN-1", "SELECT party_id, policy_no, event_index, next_product FROM v_ranked3")
def event_index_with_every_client_hot(t):
    """The slices of hot clients, forced for every client above three rows."""
    out = ordered.with_order(
        classify(t.policies), "party_id", pol.ORDER, number="event_index", ahead={"product_category": "next_product"}, floor=3)
    return out.select("party_id", "policy_no", "event_index", "next_product")


@query("WIN-2", """
SELECT party_id, max(CASE WHEN rn_desc = 2 THEN policy_no END) AS previous_policy_no, max(CASE WHEN rn_desc = 2 THEN product_category END) AS previous_category,
  max(CASE WHEN rn_desc = 1 THEN policy_no END) AS last_policy_no, max(CASE WHEN rn_desc = 1 THEN product_category END) AS last_category
FROM v_ranked3 WHERE rn_desc <= 2 GROUP BY 1 HAVING count(*) = 2""")
def last_and_previous_policy(t):
    return pol.last_two(classify(t.policies)).select("party_id", "previous_policy_no", "previous_category", "last_policy_no", "last_category")


@query("WIN-3", """
SELECT agent_code, CAST(yearmo AS BIGINT) AS yearmo, rank_desc FROM v_agents_report QUALIFY row_number() OVER (PARTITION BY agent_code ORDER BY yearmo DESC) = 1""")
def latest_agent_record(t):
    return ordered.latest_by(t.agents, ["agent_code"], ["yearmo"]).select("agent_code", "yearmo", "rank_desc")


@query("WIN-4", """
SELECT party_id, product_category AS first_product, CAST(register_date AS VARCHAR) AS first_product_date FROM v_class3 WHERE product_category <> 'OTHER'
QUALIFY row_number() OVER (PARTITION BY party_id ORDER BY register_date, policy_no) = 1""")
def first_known_product(t):
    return pol.first_product(classify(t.policies))


@query("WIN-5 WIN-7", """
SELECT party_id, policy_no, policy_no_lead, CAST(register_date_dt_lead AS VARCHAR) AS register_date_dt_lead, prod_lob_lead, cross_sell_product_category,
  cross_sell_retirement_sub, cross_sell_life_sub, cross_sell_investment_sub, cross_sell_tax_treatment, CAST(days_to_cross_sell AS BIGINT) AS days_to_cross_sell, rnk FROM v_neighbour""")
def neighbouring_policy(t):
    near = pol.neighbour_policy(classify_all(t))
    return near.select("party_id", "policy_no", "policy_no_lead", "register_date_dt_lead", "prod_lob_lead", "cross_sell_product_category",
                       "cross_sell_retirement_sub", "cross_sell_life_sub", "cross_sell_investment_sub", "cross_sell_tax_treatment", "days_to_cross_sell", "rnk")


def classify_all(t):
    return classify(with_product(t), "product")


@query("WIN-6", "SELECT party_id, policy_no, next_product, CAST(next_register_date AS VARCHAR) AS next_register_date FROM v_ranked3")
def next_product_by_date(t):
    return pol.next_product(classify(t.policies)).select("party_id", "policy_no", "next_product", "next_register_date")


@query("WIN-6", "SELECT product_category AS current_product, next_product, count(*) AS n FROM v_ranked3 WHERE next_product IS NOT NULL GROUP BY 1, 2")
def consecutive_policy_pairs(t):
    pairs = pol.consecutive_pairs(classify(t.policies))
    return pairs.groupBy(F.col("product_category").alias("current_product"), "next_product").agg(F.count(F.lit(1)).alias("n"))


@query("WIN-8", "SELECT policy_no, count(*) OVER (PARTITION BY party_id) AS policy_count FROM v_policies")
def policies_per_client(t):
    return pol.with_policy_count(t.policies).select("policy_no", "policy_count")


@query("WIN-10", "SELECT party_id, " + ", ".join(f"rank() OVER (ORDER BY {p}_score DESC) AS {p}_rank" for p in sc.PRODUCTS) + " FROM v_scores")
def score_ranks(t):
    return sc.score_ranks(t.scores).select("party_id", *[f"{p}_rank" for p in sc.PRODUCTS])


@query("WIN-11", "SELECT party_id, " + ", ".join(f"CAST({p}_decile AS BIGINT) AS {p}_decile" for p in sc.PRODUCTS) + " FROM v_score_table")
def score_deciles(t):
    return sc.score_deciles(t.scores).select("party_id", *[f"{p}_decile" for p in sc.PRODUCTS])


def monthly_policies(t):
    """Amounts by registration month stand in for monthly snapshots."""
    return t.policies.withColumn("business_month", F.year("register_date") * 100 + F.month("register_date"))


LAGS = (1, 3, 6, 12)


@query("WIN-13", """
WITH m AS (SELECT branchoffice_code, year(register_date) * 100 + month(register_date) AS business_month, sum(acct_val_amt) AS amount,
  year(register_date) * 12 + month(register_date) AS i FROM v_policies GROUP BY 1, 2, 4)
SELECT a.branchoffice_code, CAST(a.business_month AS BIGINT) AS business_month, """ + f"{rd('a.amount', 2)} AS acct_val_amt, " + ", ".join(
    f"{rd(f'b{k}.amount', 2)} AS acct_val_amt_{k}m_ago, {rd(f'100.0 * (a.amount - b{k}.amount) / b{k}.amount', 4)} AS acct_val_amt_change_{k}m_pct" for k in LAGS)
    + " FROM m a " + " ".join(f"LEFT JOIN m b{k} ON a.branchoffice_code = b{k}.branchoffice_code AND b{k}.i = a.i - {k}" for k in LAGS))
def monthly_amount_changes(t):
    out = monitor.monthly_change(monthly_policies(t), ["acct_val_amt"], party="branchoffice_code")
    return out.select("branchoffice_code", "business_month", rounded("acct_val_amt", 2).alias("acct_val_amt"),
                      *[rounded(f"acct_val_amt_{k}m_ago", 2).alias(f"acct_val_amt_{k}m_ago") for k in LAGS],
                      *[rounded(f"acct_val_amt_change_{k}m_pct", 4).alias(f"acct_val_amt_change_{k}m_pct") for k in LAGS])


AMOUNTS = ("acct_val_amt", "face_amt")


@query("WIN-13", f"""
WITH m AS (SELECT party_id, year(register_date) * 100 + month(register_date) AS business_month, sum(acct_val_amt) AS acct_val_amt, sum(face_amt) AS face_amt,
  year(register_date) * 12 + month(register_date) AS i FROM {SMALL_CLIENTS} GROUP BY 1, 2, 5),
s AS (SELECT party_id, CASE WHEN count(DISTINCT policy_no) > 1 THEN 'CS' ELSE 'NCS' END AS segment FROM {SMALL_CLIENTS} GROUP BY 1)
SELECT a.party_id, s.segment, CAST(a.business_month AS BIGINT) AS business_month, """ + ", ".join(
    [f"{rd(f'a.{c}', 2)} AS {c}" for c in AMOUNTS]
    + [f"{rd(f'b{k}.{c}', 2)} AS {c}_{k}m_ago, {rd(f'100.0 * (a.{c} - b{k}.{c}) / b{k}.{c}', 4)} AS {c}_change_{k}m_pct" for c in AMOUNTS for k in LAGS])
    + " FROM m a JOIN s ON s.party_id = a.party_id " + " ".join(f"LEFT JOIN m b{k} ON a.party_id = b{k}.party_id AND b{k}.i = a.i - {k}" for k in LAGS))
def monthly_amount_changes_by_segment(t):
    """Two amounts per client and month, for clients of several policies and of one."""
    rows = small_clients(t).withColumn("business_month", F.year("register_date") * 100 + F.month("register_date"))
    out = monitor.segment_changes(rows, list(AMOUNTS))
    return out.select("party_id", "segment", "business_month", *[rounded(c, 2).alias(c) for c in AMOUNTS],
                      *[rounded(f"{c}_{k}m_ago", 2).alias(f"{c}_{k}m_ago") for c in AMOUNTS for k in LAGS],
                      *[rounded(f"{c}_change_{k}m_pct", 4).alias(f"{c}_change_{k}m_pct") for c in AMOUNTS for k in LAGS])


@query("WIN-14", f"""
SELECT snp_business_month, {rd('snp_close_variation', 4)} AS snp_close_variation, {rd('snp_close_lead_3', 4)} AS snp_close_lead_3,
  {rd('snp_close_lead_6', 4)} AS snp_close_lead_6, {rd('snp_close_lead_12', 4)} AS snp_close_lead_12 FROM v_market""")
def market_changes(t):
    out = monitor.market_series(t.market_base)
    return out.select("snp_business_month", *[rounded(c, 4).alias(c) for c in out.columns[1:]])


@query("WIN-15", """
SELECT a.party_id, year(a.register_date) * 100 + month(a.register_date) AS ncs_month, year(b.register_date) * 100 + month(b.register_date) AS cs_month,
  CASE WHEN b.policy_no IS NULL THEN 'NCS' ELSE 'CS' END AS segment
FROM (SELECT * FROM v_ranked3 WHERE event_index = 1) a LEFT JOIN (SELECT * FROM v_ranked3 WHERE event_index = 2) b ON a.party_id = b.party_id""")
def month_of_first_qualification(t):
    return monitor.segment_cs_ncs(classify(t.policies))


@query("TOP-1", f"SELECT party_id, {rd('investment_score')} AS investment_score FROM v_scores ORDER BY investment_score DESC, party_id LIMIT 50")
def top_clients_by_score(t):
    return advisor.top_n(t.scores, "investment_score", 50).select("party_id", "investment_score")


@query("TOP-2", "SELECT product, party_id, rank FROM (SELECT product, party_id, row_number() OVER (PARTITION BY product ORDER BY score DESC, party_id) AS rank FROM v_long_scores) WHERE rank <= 20")
def top_clients_per_product(t):
    long = sc.long_scores(t.scores)
    return ordered.first_by(long, ["product"], [F.desc("score"), F.asc("party_id")], 20, rank="rank").select("product", "party_id", "rank")


@query("SET-3", """
SELECT c.party_id, c.predicted_product, coalesce((SELECT min(x.product_category) FROM v_class3 x WHERE x.party_id = c.party_id AND x.product_category <> 'LIFE_INSURANCE'), 'UNKNOWN') AS actual_product_bought
FROM v_confidence c WHERE c.party_id IN (SELECT party_id FROM v_class3)""")
def products_beyond_life_insurance(t):
    held = pol.holdings(classify(t.policies)).withColumn("first_product_category", F.lit("LIFE_INSURANCE"))
    return pol.new_holdings(held).join(confident(t), "party_id").select("party_id", "predicted_product", "actual_product_bought")


