"""Aggregations and reports."""

from pyspark.sql import functions as F

from nextcover.functions.classify import CATEGORIES, classify
from nextcover.operators import client360 as c360, explain, policies as pol, propensity as pr, quality as q, scoring as sc
from nextcover.operators.features import ages, flag_group
from nextcover.plans import next_product
from workload.feature_sets import first_second_rows, training
from workload.registry import query, rounded
from workload.sqltext import rd
from workload.views import ACTIVITY_AS_OF, AS_OF


@query("AGG-1", "SELECT product_category, policy_status, count(*) AS n FROM v_class3 GROUP BY 1, 2")
def counts_by_key(t):
    return pr.counts(classify(t.policies), ["product_category", "policy_status"])


@query("AGG-2", """
SELECT party_id, count(DISTINCT agt_no) AS distinct_values FROM v_policies GROUP BY 1 HAVING count(DISTINCT agt_no) = 9""")
def clients_with_nine_agents(t):
    return pr.having_distinct(t.policies, "party_id", "agt_no", 9)


@query("AGG-3", f"""
SELECT count(DISTINCT party_id) AS party_id_distinct, count(DISTINCT product_category) AS product_category_distinct,
  {rd('avg(acct_val_amt)', 2)} AS acct_val_amt_avg, {rd('avg(client_age)', 4)} AS client_age_avg, count(face_amt) AS face_amt_filled,
  count(sub_product_level_1) AS sub_product_level_1_filled FROM (SELECT *, FLOOR(date_diff('day', birth_dt, DATE '2002-01-01') / 365.25) AS client_age FROM v_class3)""")
def feature_quality_check(t):
    out = q.feature_quality(ages(classify(t.policies), AS_OF), ["party_id", "product_category"], ["acct_val_amt", "client_age"],
                            ["face_amt", "sub_product_level_1"])
    return out.withColumns({"acct_val_amt_avg": rounded("acct_val_amt_avg", 2), "client_age_avg": rounded("client_age_avg", 4)})


@query("AGG-4", """
SELECT party_id, count(*) AS total_activities_all_time, count(CASE WHEN activity_date >= DATE '2023-01-31' THEN 1 END) AS total_activities_last_12m,
  count(CASE WHEN call_outcome IN ('Connected', 'Appointment Set', 'Referral Provided') THEN 1 END) AS positive_outcomes FROM v_activities GROUP BY 1""")
def activity_counts(t):
    return c360.activity_metrics(t.activities, ACTIVITY_AS_OF)


@query("AGG-5", f"""
SELECT party_id, count(*) AS total_opportunities, count(CASE WHEN stage_name = 'Closed Won' THEN 1 END) AS won_opportunities,
  count(CASE WHEN stage_name = 'Closed Lost' THEN 1 END) AS lost_opportunities, {rd('avg(estimated_gdc)', 3)} AS avg_estimated_gdc FROM v_opportunities GROUP BY 1""")
def opportunity_counts(t):
    return c360.opportunity_metrics(t.opportunities).withColumn("avg_estimated_gdc", rounded("avg_estimated_gdc", 3))


@query("AGG-6", f"""
SELECT party_id, {rd("avg(date_diff('day', isrd_brth_date, DATE '2002-01-01') / 365.25)", 4)} AS avg_client_age, {rd('max(wc_total_assets)', 2)} AS estimated_total_wealth,
  {rd('max(wc_assetmix_stocks)', 2)} AS estimated_stock_wealth, {rd('max(wc_assetmix_bonds)', 2)} AS estimated_bond_wealth FROM v_policies GROUP BY 1""")
def policy_wealth_summary(t):
    out = c360.policy_summary(t.policies, AS_OF)
    return out.select("party_id", rounded("avg_client_age", 4).alias("avg_client_age"), *[
        rounded(c, 2).alias(c) for c in ["estimated_total_wealth", "estimated_stock_wealth", "estimated_bond_wealth"]])


FLAGS = ["volatile_market", "stable_growth_market", "market_uptrend_3m", "market_uptrend_12m", "declining_market"]


@query("AGG-8", " UNION ALL ".join(
    f"SELECT count(*) AS rows, '{f}' AS flag, CAST(sum({f}) AS BIGINT) AS total, {rd(f'avg({f})')} AS share FROM "
    f"(SELECT CASE WHEN {c} THEN 1 ELSE 0 END AS {f} FROM v_training)" for f, c in zip(FLAGS, [
        "abs(snp_close_variation) > 3", "abs(snp_close_variation) < 1 AND snp_close_lead_3 > 0", "snp_close_lead_3 > 0",
        "snp_close_lead_12 > 0", "snp_close_lead_6 < -5"])))
def market_flag_totals(t):
    return q.flag_totals(training(t), FLAGS)


@query("AGG-9", f"""
SELECT party_id, policy_no, CAST(register_date AS VARCHAR) AS register_date, prod_lob, agt_no, {rd('acct_val_amt', 2)} AS acct_val_amt, product,
  second_policy_no, CAST(second_register_date AS VARCHAR) AS second_register_date, second_prod_lob, second_product FROM v_fs""")
def first_and_second_policy(t):
    return first_second_rows(t, "register_date", "agt_no", "acct_val_amt").select(
        "party_id", "policy_no", "register_date", "prod_lob", "agt_no", rounded("acct_val_amt", 2).alias("acct_val_amt"), "product",
        "second_policy_no", "second_register_date", "second_prod_lob", "second_product")


@query("AGG-10", """
SELECT party_id, string_agg(DISTINCT product_category, ',' ORDER BY product_category) AS current_products,
  count(DISTINCT product_category) AS num_products FROM v_class3 GROUP BY 1""")
def products_held(t):
    return pol.holdings(classify(t.policies))


@query("AGG-11", f"""
SELECT product_category AS from_product, cross_sell_product_category AS to_product, count(*) AS n, {rd('round(avg(days_to_cross_sell), 0)')} AS avg_days
FROM v_training GROUP BY 1, 2 ORDER BY n DESC, from_product, to_product LIMIT 15""")
def transition_patterns(t):
    return pr.transition_pattern_report(training(t))


@query("AGG-12 WIN-9", f"""
SELECT product_category AS first_prod, second_product_category AS second_prod, count(*) AS pair_count,
  {rd('count(*) / sum(count(*)) OVER (PARTITION BY product_category)')} AS transition_probability,
  row_number() OVER (PARTITION BY product_category ORDER BY count(*) DESC, second_product_category) AS rank
FROM v_bought GROUP BY 1, 2 QUALIFY rank <= 3""")
def likely_next_products(t):
    """The flagship: what clients buy after their first policy."""
    return next_product.likely_next_products(t.policies, t.lookup).select(
        "first_prod", "second_prod", "pair_count", "transition_probability", "rank")


@query("AGG-13", "SELECT product_category AS first_prod, " + ", ".join(
    rd(f"avg(CASE WHEN second_product_category = '{c}' THEN 1.0 ELSE 0.0 END)") + f" AS prob_{c}_given_first" for c in CATEGORIES)
    + " FROM v_bought GROUP BY 1")
def transition_matrix(t):
    bought = first_second_rows(t).filter(F.col("second_product_category").isNotNull())
    return pr.transition_matrix(pr.transition_probs(bought), CATEGORIES)


@query("AGG-14", """
SELECT agt_no, channel, product_category AS mode FROM v_class3 GROUP BY 1, 2, 3
QUALIFY row_number() OVER (PARTITION BY agt_no, channel ORDER BY count(*) DESC, product_category) = 1""")
def mode_by_agent_and_channel(t):
    return pr.mode_by(classify(t.policies), ["agt_no", "channel"], "product_category")


@query("AGG-15", """
SELECT coalesce((SELECT sub_product_level_2 FROM v_policies GROUP BY 1 ORDER BY count(*) DESC, sub_product_level_2 NULLS FIRST LIMIT 1), 'UNKNOWN') AS sub_product_level_2""")
def global_mode(t):
    return pr.mode_of(t.policies, "sub_product_level_2")


@query("AGG-16", "SELECT product_category, count(*) AS p1_cross_sell_popularity FROM v_bought GROUP BY 1")
def product_popularity(t):
    return pr.propensity_product(first_second_rows(t).filter(F.col("second_product_category").isNotNull()))


@query("AGG-17", "SELECT agt_no, product_category, count(*) AS agent_p1_cross_sell_count FROM v_bought GROUP BY 1, 2")
def agent_propensity(t):
    return pr.propensity_agent(first_second_rows(t, "agt_no").filter(F.col("second_product_category").isNotNull()))


@query("AGG-18", "SELECT branchoffice_code, product_category, count(*) AS branch_p1_cross_sell_count FROM v_bought GROUP BY 1, 2")
def branch_propensity(t):
    return pr.propensity_branch(first_second_rows(t, "branchoffice_code").filter(F.col("second_product_category").isNotNull()))


@query("AGG-19", f"""
SELECT client_seg, count(*) AS clients, {rd('avg(CASE WHEN second_policy_no IS NOT NULL THEN 1.0 ELSE 0.0 END)')} AS cross_sell_rate FROM v_fs GROUP BY 1""")
def cross_sell_rate_by_segment(t):
    return pr.cross_sell_rate(first_second_rows(t, "client_seg"), "client_seg")


@query("AGG-20", "SELECT client_seg, second_product_category, count(*) AS n FROM v_fs GROUP BY 1, 2")
def segment_by_next_product(t):
    return pr.cross_tab(first_second_rows(t, "client_seg"), "client_seg", "second_product_category")


@query("AGG-21", f"""
SELECT product_category, count(*) AS n, {rd('100.0 * count(*) / sum(count(*)) OVER ()')} AS percentage,
  {rd('max(count(*)) OVER () / min(count(*)) OVER ()')} AS imbalance_ratio FROM v_class3 GROUP BY 1""")
def class_distribution(t):
    return q.class_distribution(classify(t.policies), "product_category")


MISSING = ["prod_lob", "sub_product_level_1", "face_amt", "cash_val_amt", "client_seg", "end_date", "policy_no"]


@query("AGG-22", " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count(*) - count({c}) AS missing_count, {rd(f'round(100.0 * (count(*) - count({c})) / count(*), 2)')} AS missing_percentage, "
    f"count({c}) AS available_count FROM v_policies" for c in MISSING))
def missing_values(t):
    return q.missing_report(t.policies, MISSING)


AMOUNTS = ["acct_val_amt", "face_amt", "cash_val_amt", "wc_total_assets"]


def _quartiles(c):
    return (f"(SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.5) AS q2, quantile_cont({c}, 0.75) AS q3 FROM v_policies)")


@query("AGG-23", " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", CAST(sum(CASE WHEN {c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1) THEN 1 ELSE 0 END) AS BIGINT) AS outlier_count, "
    f"{rd(f'100.0 * sum(CASE WHEN {c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1) THEN 1 ELSE 0 END) / count(*)', 2)} AS outlier_percentage, "
    f"{rd(f'min({c})', 2)} AS min, {rd('any_value(q1)', 2)} AS q1, {rd('any_value(q2)', 2)} AS median, {rd('any_value(q3)', 2)} AS q3, {rd(f'max({c})', 2)} AS max "
    f"FROM v_policies CROSS JOIN {_quartiles(c)}" for c in AMOUNTS))
def outliers_by_quartile_range(t):
    return q.outlier_report(t.policies, AMOUNTS)


@query("AGG-24", " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count({c}) AS count, {rd(f'avg({c})', 2)} AS mean, {rd(f'stddev_samp({c})', 2)} AS std, {rd(f'min({c})', 2)} AS min, "
    f"{rd(f'quantile_cont({c}, 0.25)', 2)} AS q1, {rd(f'quantile_cont({c}, 0.5)', 2)} AS median, {rd(f'quantile_cont({c}, 0.75)', 2)} AS q3, "
    f"{rd(f'max({c})', 2)} AS max FROM v_policies" for c in AMOUNTS))
def descriptive_statistics(t):
    return q.describe_cols(t.policies, AMOUNTS).select(
        "column", "count", *[rounded(c, 2).alias(c) for c in ["mean", "std", "min", "q1", "median", "q3", "max"]])


def _skew(x):
    m2, m3 = f"(avg(({x})*({x})) - avg({x})*avg({x}))", f"(avg(({x})*({x})*({x})) - 3*avg({x})*avg(({x})*({x})) + 2*avg({x})*avg({x})*avg({x}))"
    return rd(f"{m3} / pow({m2}, 1.5)", 4)


@query("AGG-25", " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", {_skew('x')} AS skew_before, {_skew('y')} AS skew_after FROM "
    f"(SELECT {c} / 100000 AS x, ln(1 + {c}) AS y FROM v_policies WHERE {c} IS NOT NULL)" for c in AMOUNTS[:3]))
def skewness_before_and_after_log(t):
    out = q.skew_report(t.policies, AMOUNTS[:3])
    return out.select("column", rounded("skew_before", 4).alias("skew_before"), rounded("skew_after", 4).alias("skew_after"))


CORRELATED = ["acct_val_amt", "face_amt", "wc_total_assets", "wc_assetmix_stocks", "psn_age"]


@query("AGG-26", " UNION ALL ".join(
    f"SELECT '{a}' AS column_a, '{b}' AS column_b, {rd(f'corr({a}, {b})', 5)} AS corr FROM v_policies"
    for i, a in enumerate(CORRELATED) for b in CORRELATED[i + 1:]))
def correlation_matrix(t):
    return q.corr_matrix(t.policies, CORRELATED).withColumn("corr", rounded("corr", 5))


@query("AGG-27", f"""
SELECT 'business_month' AS "column", {rd('var_samp(business_month)')} AS variance FROM v_policies""")
def low_variance_columns(t):
    return q.low_variance(t.policies, ["business_month", "acct_val_amt", "psn_age"])


@query("AGG-28", f"""
SELECT CAST(least(floor(investment_score * 20), 19) + 1 AS BIGINT) AS bin, {rd('least(floor(investment_score * 20), 19) * 0.05')} AS bin_start, count(*) AS n
FROM v_scores GROUP BY 1, 2""")
def score_histogram(t):
    return q.histogram(t.scores, "investment_score", 0, 1, 20)


@query("AGG-29", " UNION ALL ".join(
    f"SELECT '{p}_score' AS score_name, {rd(f'avg({p}_score)')} AS mean, {rd(f'stddev_samp({p}_score)')} AS std, {rd(f'min({p}_score)')} AS min, {rd(f'max({p}_score)')} AS max, "
    + ", ".join(f"count(CASE WHEN {p}_score > CAST({x / 100} AS DOUBLE) THEN 1 END) AS above_{x}" for x in (50, 60, 70, 80, 90)) + ", "
    + ", ".join(rd(f"avg(CASE WHEN {p}_score > CAST({x / 100} AS DOUBLE) THEN 1.0 ELSE 0.0 END)") + f" AS share_{x}" for x in (50, 60, 70, 80, 90))
    + " FROM v_scores" for p in sc.PRODUCTS))
def score_statistics(t):
    return q.score_summary(t.scores)


def confident(t):
    """One prediction per client: the best product and its score."""
    return sc.best_two(t.scores).select("party_id", F.col("best_product").alias("predicted_product"), F.col("best_score").alias("pred_prob"))


@query("AGG-30", f"""
SELECT predicted_product, count(*) AS n, {rd('avg(pred_prob)')} AS mean_confidence, {rd('min(pred_prob)')} AS min_confidence,
  {rd('max(pred_prob)')} AS max_confidence FROM v_confidence GROUP BY 1""")
def predictions_by_product(t):
    return q.prediction_summary(confident(t))


@query("AGG-31", " UNION ALL ".join(
    f"SELECT '{p}_score' AS \"column\", " + ", ".join(rd(f"quantile_cont({p}_score, {x / 100})") + f" AS q{x}" for x in (25, 50, 75, 90))
    + " FROM v_scores" for p in sc.PRODUCTS))
def score_quantiles(t):
    return q.score_quantiles(t.scores)


MEANS = ["acct_val_amt", "psn_age", "monthly_premium_amount"]
BUCKETED = """(SELECT p.*, c.predicted_product, c.pred_prob FROM v_policies p JOIN v_confidence c ON p.party_id = c.party_id)"""


def scored_policies(t):
    return t.policies.join(confident(t), "party_id")


@query("AGG-32", f"""
SELECT CASE WHEN pred_prob >= CAST(0.95 AS DOUBLE) THEN 'high' ELSE 'low' END AS bucket, count(*) AS n, """ + ", ".join(f"{rd(f'avg({c})', 3)} AS {c}" for c in MEANS) + f"""
FROM {BUCKETED} WHERE pred_prob >= CAST(0.95 AS DOUBLE) OR pred_prob <= CAST(0.7 AS DOUBLE) GROUP BY 1""")
def confidence_bucket_means(t):
    return q.bucket_means(scored_policies(t), MEANS).select("bucket", "n", *[rounded(c, 3).alias(c) for c in MEANS])


@query("AGG-33", " UNION ALL ".join(
    f"SELECT '{c}' AS feature, {rd('h', 3)} AS high_mean, {rd('l', 3)} AS low_mean, {rd('100.0 * (h - l) / abs(l)', 3)} AS difference_pct FROM "
    f"(SELECT avg(CASE WHEN pred_prob >= CAST(0.95 AS DOUBLE) THEN {c} END) AS h, avg(CASE WHEN pred_prob <= CAST(0.7 AS DOUBLE) THEN {c} END) AS l FROM {BUCKETED})" for c in MEANS))
def bucket_differences(t):
    out = q.unpivot_means(q.bucket_means(scored_policies(t), MEANS), MEANS)
    return out.select("feature", *[rounded(c, 3).alias(c) for c in ["high_mean", "low_mean", "difference_pct"]])


EDGES = {"high": ">= CAST(0.9 AS DOUBLE)", "med_low": "<= CAST(0.8 AS DOUBLE)", "low": "<= CAST(0.7 AS DOUBLE)", "very_low": "<= CAST(0.6 AS DOUBLE)"}


@query("AGG-34", "SELECT feature, " + ", ".join(
    f"{rd(f'{b}_contribution')} AS {b}_contribution, {rd(f'{b}_value', 4)} AS {b}_value" for b in EDGES) + ", " + ", ".join(
    f"{rd(f'high_{w} - {b}_{w}', 4)} AS {w}_diff_high_vs_{b}" for w in ("contribution", "value") for b in EDGES if b != "high") + """
FROM (SELECT feature, """ + ", ".join(
    f"avg(CASE WHEN pred_prob {e} THEN abs(contribution) END) AS {b}_contribution, avg(CASE WHEN pred_prob {e} THEN CAST(value AS DOUBLE) END) AS {b}_value"
    for b, e in EDGES.items()) + " FROM v_contributions x JOIN v_confidence c ON x.party_id = c.party_id GROUP BY 1)")
def overlapping_bucket_comparison(t):
    out = q.bucket_compare(t.contributions.join(confident(t), "party_id"))
    return out.select("feature", *[
        rounded(c, 6 if c.endswith("_contribution") else 4).alias(c) for c in out.columns if c != "feature"])


@query("AGG-35", "SELECT bucket, predicted_product, n, row_number() OVER (PARTITION BY bucket ORDER BY n DESC, predicted_product) AS rank FROM (" + " UNION ALL ".join(
    f"SELECT '{b}' AS bucket, predicted_product, count(*) AS n FROM v_confidence WHERE pred_prob {e} GROUP BY 2" for b, e in EDGES.items()) + ") QUALIFY rank <= 5")
def product_mix_per_bucket(t):
    return q.bucket_mix(confident(t))


@query("AGG-36", f"""
SELECT CAST(investment_decile AS BIGINT) AS decile, count(*) AS clients, {rd('avg(investment_score)')} AS avg_score, {rd('min(investment_score)')} AS min_score,
  {rd('max(investment_score)')} AS max_score FROM v_score_table GROUP BY 1""")
def decile_report(t):
    return q.decile_report(sc.score_deciles(t.scores))


@query("AGG-37", f"""
SELECT best_product, count(*) AS clients, {rd('avg(best_score)')} AS avg_score, count(CASE WHEN best_score > CAST(0.7 AS DOUBLE) THEN 1 END) AS high_confidence
FROM v_best GROUP BY 1""")
def best_product_report(t):
    return q.best_product_report(sc.best_two(t.scores))


@query("AGG-38", f"""
WITH i AS (SELECT feature, avg(abs(contribution)) AS importance FROM v_contributions GROUP BY 1),
c AS (SELECT *, sum(importance) OVER (ORDER BY importance DESC, feature) / sum(importance) OVER () AS s FROM i)
SELECT feature, {rd('importance')} AS importance, {rd('s')} AS cumulative_share, (SELECT count(*) FROM c WHERE s < 0.8) + 1 AS features_needed FROM c""")
def cumulative_importance(t):
    return explain.cumulative_importance(explain.contribution_importance(t.contributions))


@query("FEA-12", "SELECT policy_no, CAST(CASE WHEN abs(snp_close_variation) > 2 THEN 1 ELSE 0 END AS BIGINT) AS high_market_volatility FROM v_training")
def volatility_flag_only(t):
    return flag_group(training(t, flags=False), "market").select("policy_no", "high_market_volatility")
