"""Joins: lookups, latest versions, snapshots, client 360."""

from pyspark.sql import functions as F

from nextcover.functions.classify import CATEGORIES, classify
from nextcover.operators import client360 as c360, explain, policies as pol, propensity as pr
from nextcover.operators.features import ages, allocation_ratios
from nextcover.operators.monitor import market_series
from workload.classification import with_product
from workload.feature_sets import first_second_rows
from workload.registry import query, rounded
from workload.sqltext import rd
from workload.views import ACTIVITY_AS_OF, AS_OF


@query("JN-1", "SELECT policy_no, product FROM v_policies_p")
def product_lookup_join(t):
    return with_product(t).select("policy_no", "product")


@query("JN-2", f"""
SELECT n.policy_no, m.snp_business_month, {rd('m.snp_close_variation', 4)} AS snp_close_variation, {rd('m.snp_close_lead_6', 4)} AS snp_close_lead_6
FROM v_ranked3 n JOIN v_market m ON m.snp_business_month = strftime(n.next_register_date - INTERVAL 90 DAY, '%Y%m')""")
def market_at_decision(t):
    pairs = pol.next_product(classify(t.policies))
    joined = c360.join_market(pairs, market_series(t.market_base), 90, "next_register_date")
    return joined.select("policy_no", "snp_business_month", rounded("snp_close_variation", 4).alias("snp_close_variation"),
                         rounded("snp_close_lead_6", 4).alias("snp_close_lead_6"))


@query("JN-3", """
SELECT a.party_id, a.policy_no AS first_policy_no, b.policy_no AS second_policy_no, a.product_category AS first_category, b.product_category AS second_category
FROM v_ranked3 a JOIN v_ranked3 b ON a.party_id = b.party_id AND a.event_index = 1 AND b.event_index = 2""")
def first_joined_with_second(t):
    return pol.first_second_join(classify(t.policies)).select(
        "party_id", "first_policy_no", "second_policy_no", "first_category", "second_category")


# every client's policies dealt to eight clients, so that some hold one or none
SMALL_CLIENTS = "(SELECT * REPLACE (party_id || '-' || CAST(CAST(policy_no AS BIGINT) % 8 AS VARCHAR) AS party_id) FROM v_class3)"


def small_clients(t):
    eighth = (F.col("policy_no").cast("long") % 8).cast("string")
    return classify(t.policies).withColumn("party_id", F.concat_ws("-", "party_id", eighth))


@query("JN-4", f"""
WITH kept AS (SELECT *, row_number() OVER (PARTITION BY party_id ORDER BY register_date, policy_no) AS k FROM {SMALL_CLIENTS})
SELECT a.party_id, a.policy_no AS first_policy_no, b.policy_no AS second_policy_no,
  {rd("date_diff('day', a.isrd_brth_date, b.register_date) / 365.25")} AS age_at_second
FROM kept a LEFT JOIN kept b ON a.party_id = b.party_id AND b.k = 2 WHERE a.k = 1""")
def first_with_optional_second(t):
    return pol.first_second_left(small_clients(t)).select("party_id", "first_policy_no", "second_policy_no", "age_at_second")


@query("JN-5 AGG-4 AGG-5 AGG-6", f"""
SELECT r.party_id, CAST(r.business_month AS BIGINT) AS business_month, r.client_segment, a.full_name AS agent_name, a.rank_desc AS agent_rank,
  {rd('s.avg_client_age', 4)} AS avg_client_age, {rd('s.wealth', 2)} AS estimated_total_wealth,
  coalesce(v.n, 0) AS total_activities_all_time, coalesce(v.recent, 0) AS total_activities_last_12m, coalesce(v.good, 0) AS positive_outcomes,
  coalesce(o.n, 0) AS total_opportunities, coalesce(o.won, 0) AS won_opportunities
FROM v_retention r
LEFT JOIN (SELECT party_id, avg(date_diff('day', isrd_brth_date, DATE '2002-01-01') / 365.25) AS avg_client_age, max(wc_total_assets) AS wealth
  FROM v_policies GROUP BY party_id) s ON r.party_id = s.party_id
LEFT JOIN (SELECT * FROM v_agents_report QUALIFY row_number() OVER (PARTITION BY agent_code ORDER BY yearmo DESC) = 1) a ON r.agent_code = a.agent_code
LEFT JOIN (SELECT party_id, count(*) AS n, count(CASE WHEN activity_date >= DATE '2023-01-31' THEN 1 END) AS recent,
  count(CASE WHEN call_outcome IN ('Connected', 'Appointment Set') THEN 1 END) AS good FROM v_activities GROUP BY party_id) v ON r.party_id = v.party_id
LEFT JOIN (SELECT party_id, count(*) AS n, count(CASE WHEN stage_name = 'Closed Won' THEN 1 END) AS won FROM v_opportunities GROUP BY party_id) o
  ON r.party_id = o.party_id""")
def client_360_view(t):
    full = c360.client_360(t.retention, t.policies, t.agents, t.activities, t.opportunities, AS_OF, ACTIVITY_AS_OF)
    return full.select(
        "party_id", "business_month", "client_segment", "agent_name", "agent_rank", rounded("avg_client_age", 4).alias("avg_client_age"),
        rounded("estimated_total_wealth", 2).alias("estimated_total_wealth"), "total_activities_all_time",
        "total_activities_last_12m", "positive_outcomes", "total_opportunities", "won_opportunities")


@query("JN-6", """
SELECT r.party_id, CAST(r.business_month AS BIGINT) AS business_month, a.full_name, CAST(a.rpt_lgth_of_svc AS BIGINT) AS rpt_lgth_of_svc FROM v_retention r
LEFT JOIN (SELECT * FROM v_agents_report WHERE yearmo = 200112) a ON r.agent_code = a.agent_code""")
def latest_agent_join(t):
    return c360.left_latest(t.retention, t.agents, "agent_code", "yearmo").select("party_id", "business_month", "full_name", "rpt_lgth_of_svc")


@query("JN-7", f"""
SELECT e.party_id, e.position, s.client_seg, s.aum_band, {rd('s.acct_val_amt', 2)} AS acct_val_amt
FROM v_examples e LEFT JOIN (SELECT * FROM v_ranked3 WHERE rn_desc = 1) s ON e.party_id = s.party_id WHERE e.position > 1""")
def examples_with_snapshot(t):
    from nextcover.operators.sequences import sliding_examples
    from workload.sequences import changes

    snapshot = c360.client_snapshot(t.policies).select("party_id", "client_seg", "aum_band", rounded("acct_val_amt", 2).alias("acct_val_amt"))
    return c360.join_snapshot(sliding_examples(changes(t)), snapshot).select("party_id", "position", "client_seg", "aum_band", "acct_val_amt")


@query("JN-8", f"""
SELECT party_id, {rd('investment_score')} AS investment_score FROM v_scores WHERE party_id IN (SELECT party_id FROM v_policies WHERE branchoffice_code = '7')""")
def scores_of_branch_clients(t):
    return c360.in_branch_clients(t.scores, t.policies, "7").select("party_id", "investment_score")


@query("JN-9", f"""
SELECT party_id, policy_no, product_category FROM {SMALL_CLIENTS} WHERE policy_status = 'Active'
QUALIFY count(*) OVER (PARTITION BY party_id) = 1""")
def single_policy_clients(t):
    from nextcover.operators.clean import active

    kept = active(small_clients(t)).select("party_id", "policy_no", "register_date", "product_category")
    return pol.single_policy_clients(kept).select("party_id", "policy_no", "product_category")


@query("JN-10 AGG-16 AGG-17 AGG-18", """
WITH h AS (SELECT * FROM v_bought WHERE CAST(policy_no AS BIGINT) % 5 <> 0),
m AS (SELECT product_category, second_product_category FROM h GROUP BY 1, 2
  QUALIFY row_number() OVER (PARTITION BY product_category ORDER BY count(*) DESC, second_product_category) = 1)
SELECT f.party_id, coalesce(a.n, 0) AS p1_cross_sell_popularity, coalesce(m.second_product_category, 'UNKNOWN') AS p1_most_common_next_prod,
  coalesce(b.n, 0) AS agent_p1_cross_sell_count, coalesce(c.n, 0) AS branch_p1_cross_sell_count
FROM v_fs f
LEFT JOIN (SELECT product_category, count(*) AS n FROM h GROUP BY 1) a ON f.product_category = a.product_category
LEFT JOIN m ON f.product_category = m.product_category
LEFT JOIN (SELECT agt_no, product_category, count(*) AS n FROM h GROUP BY 1, 2) b ON f.agt_no = b.agt_no AND f.product_category = b.product_category
LEFT JOIN (SELECT branchoffice_code, product_category, count(*) AS n FROM h GROUP BY 1, 2) c
  ON f.branchoffice_code = c.branchoffice_code AND f.product_category = c.product_category""")
def propensity_features(t):
    """Lookups fitted on four fifths of the clients, attached to all."""
    rows = first_second_rows(t, "agt_no", "branchoffice_code")
    history = rows.filter(F.col("second_product_category").isNotNull() & (F.col("policy_no").cast("long") % 5 != 0))
    return pr.add_propensity(rows, pr.propensity_lookups(history)).select(
        "party_id", "p1_cross_sell_popularity", "p1_most_common_next_prod", "agent_p1_cross_sell_count", "branch_p1_cross_sell_count")


@query("JN-11 AGG-13", "SELECT f.party_id, f.product_category, " + ", ".join(
    f"{rd(f'coalesce(m.p{i}, 0)')} AS prob_{c}_given_first" for i, c in enumerate(CATEGORIES)) + """
FROM v_fs f LEFT JOIN (SELECT product_category, """ + ", ".join(
    f"avg(CASE WHEN second_product_category = '{c}' THEN 1.0 ELSE 0.0 END) AS p{i}" for i, c in enumerate(CATEGORIES)) + """
  FROM v_bought GROUP BY 1) m ON f.product_category = m.product_category""")
def transition_probability_features(t):
    rows = first_second_rows(t)
    probs = pr.transition_probs(rows.filter(F.col("second_product_category").isNotNull()))
    out = pr.add_transition_probs(rows, pr.transition_matrix(probs, CATEGORIES))
    return out.select("party_id", "product_category", *[f"prob_{c}_given_first" for c in CATEGORIES])


@query("JN-12", f"""
SELECT branchoffice_code, product_category, count(*) AS n, CAST(sum(count(*)) OVER (PARTITION BY branchoffice_code) AS BIGINT) AS total,
  {rd('count(*) / sum(count(*)) OVER (PARTITION BY branchoffice_code)')} AS share FROM v_class3 GROUP BY 1, 2""")
def category_share_in_branch(t):
    return pr.ratio_by(classify(t.policies), ["branchoffice_code", "product_category"], ["branchoffice_code"])


@query("JN-13", f"""
WITH x AS (SELECT *, date_diff('day', birth_dt, register_date) / 365.25 AS age, wc_assetmix_stocks / NULLIF(wc_total_assets, 0) AS stock FROM v_class3)
SELECT x.policy_no, {rd('m.a', 2)} AS avg_assets_by_product, {rd('m.b', 4)} AS avg_age_by_product, {rd('m.c', 4)} AS avg_stock_ratio_by_product
FROM x LEFT JOIN (SELECT product_category, avg(wc_total_assets) AS a, avg(age) AS b, avg(stock) AS c FROM x
  WHERE CAST(policy_no AS BIGINT) % 5 <> 0 GROUP BY 1) m ON x.product_category = m.product_category""")
def group_averages_joined_back(t):
    rows = allocation_ratios(ages(classify(t.policies), AS_OF))
    train = rows.filter(F.col("policy_no").cast("long") % 5 != 0)
    means = pr.group_means(train, "product_category", {
        "wc_total_assets": "avg_assets_by_product", "age_at_first_policy": "avg_age_by_product",
        "stock_allocation_ratio": "avg_stock_ratio_by_product"})
    return pr.add_group_means(rows, means, "product_category").select(
        "policy_no", rounded("avg_assets_by_product", 2).alias("avg_assets_by_product"),
        rounded("avg_age_by_product", 4).alias("avg_age_by_product"), rounded("avg_stock_ratio_by_product", 4).alias("avg_stock_ratio_by_product"))


@query("JN-14", f"""
SELECT a.agt_no, {rd('a.assets', 2)} AS agent_avg_assets, m.second_product_category AS agent_most_common_cross_sell
FROM (SELECT agt_no, avg(wc_total_assets) AS assets FROM v_bought GROUP BY 1) a
JOIN (SELECT agt_no, second_product_category FROM v_bought GROUP BY 1, 2
  QUALIFY row_number() OVER (PARTITION BY agt_no ORDER BY count(*) DESC, second_product_category) = 1) m ON a.agt_no = m.agt_no""")
def agent_statistics(t):
    rows = first_second_rows(t, "agt_no", "wc_total_assets").filter(F.col("second_product_category").isNotNull())
    return pr.agent_stats(rows).withColumn("agent_avg_assets", rounded("agent_avg_assets", 2))


@query("JN-18", """
SELECT r.party_id, coalesce(n.client_segment || '!', r.client_segment) AS client_segment, r.state, n.extra FROM
(SELECT party_id, client_segment, state FROM v_retention WHERE business_month = 200111) r
LEFT JOIN (SELECT CASE WHEN client_tenure < 10 THEN party_id ELSE party_id || '-other' END AS party_id, client_segment, CAST(client_tenure AS BIGINT) AS extra
  FROM v_retention WHERE business_month = 200112) n ON r.party_id = n.party_id""")
def merge_with_preferred_side(t):
    base = t.retention.filter("business_month = 200111").select("party_id", "client_segment", "state")
    # clients of long tenure go by another id in the newer month, so that the older one has no match for them
    other = F.when(F.col("client_tenure") < 10, F.col("party_id")).otherwise(F.concat("party_id", F.lit("-other")))
    newer = t.retention.filter("business_month = 200112").select(
        other.alias("party_id"), F.concat("client_segment", F.lit("!")).alias("client_segment"), F.col("client_tenure").alias("extra"))
    return c360.merge_prefer(base, newer, ["party_id"], ["client_segment"])


@query("JN-19", f"""
WITH a AS (SELECT feature, avg(abs(contribution)) AS i FROM (SELECT * REPLACE (CASE WHEN feature = 'channel' THEN 'channel_a' ELSE feature END AS feature) FROM v_contributions)
  WHERE product = 'investment' GROUP BY 1),
b AS (SELECT feature, avg(abs(contribution)) AS i FROM (SELECT * REPLACE (CASE WHEN feature = 'client_age' THEN 'client_age_b' ELSE feature END AS feature) FROM v_contributions)
  WHERE product = 'retirement' GROUP BY 1)
SELECT coalesce(a.feature, b.feature) AS feature, {rd('coalesce(a.i, 0)')} AS importance_a, {rd('coalesce(b.i, 0)')} AS importance_b,
  {rd('coalesce(b.i, 0) - coalesce(a.i, 0)')} AS difference FROM a FULL JOIN b ON a.feature = b.feature""")
def importance_comparison(t):
    """One feature of each side has a name of its own there."""

    def of(product, feature, name):
        return explain.contribution_importance(t.contributions.filter(F.col("product") == product).replace({feature: name}, subset=["feature"]))

    return explain.compare_importance(of("investment", "channel", "channel_a"), of("retirement", "client_age", "client_age_b"))


@query("JN-20", """
SELECT party_id FROM v_class3 GROUP BY party_id HAVING count(DISTINCT product_category) >= 2
EXCEPT SELECT party_id FROM v_class3 WHERE register_date < DATE '1999-01-01' GROUP BY party_id HAVING count(DISTINCT product_category) >= 2""")
def new_qualifying_clients(t):
    from nextcover.operators.monitor import new_qualifiers

    now = classify(t.policies)
    baseline = pol.holdings(now.filter("register_date < DATE '1999-01-01'")).filter("num_products >= 2")
    return new_qualifiers(now, baseline).select("party_id")
