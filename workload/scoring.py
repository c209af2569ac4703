"""Scores, recommendations and advisor lists."""

from pyspark.sql import functions as F

from nextcover.functions.classify import CATEGORIES, classify
from nextcover.operators import advisor, client360 as c360, explain, policies as pol, scoring as sc
from nextcover.operators.clean import active
from workload.aggregations import confident
from workload.registry import query
from workload.sqltext import rd
from workload.views import MONTH


def score_table(t):
    return sc.score_table(t.scores)


def points(t):
    return explain.talking_point(explain.top_contributions(t.contributions, 5))


def explanation_table(t):
    return explain.explanations(points(t), sc.long_scores(t.scores), MONTH)


def demographics(t):
    """One row per client: the attributes of the newest policy."""
    return c360.client_snapshot(t.policies).select(
        "party_id", "client_seg", "aum_band", "channel", "division_name", "branch_name", "business_city", "business_state_cod", "psn_age")


SNAPSHOT = "(SELECT * FROM v_ranked3 WHERE rn_desc = 1)"


@query("OUT-1", "SELECT party_id, best_product AS predicted_product, " + rd("best_score") + " AS pred_prob, "
       + ", ".join(rd(f"{p}_score") + f" AS prob_{p}" for p in sc.PRODUCTS) + " FROM v_best")
def decoded_predictions(t):
    from pyspark.ml.functions import array_to_vector

    rows = t.scores.withColumn("probability", array_to_vector(F.array(*sc.SCORE_COLUMNS)))
    return sc.decode_predictions(rows, sc.PRODUCTS).select("party_id", "predicted_product", "pred_prob", *[f"prob_{p}" for p in sc.PRODUCTS])


@query("OUT-2", f"SELECT party_id, best_product, {rd('best_score')} AS best_score, second_best_product, {rd('second_best_score')} AS second_best_score FROM v_best")
def best_two_products(t):
    return sc.best_two(t.scores).select("party_id", "best_product", "best_score", "second_best_product", "second_best_score")


@query("OUT-3", "SELECT party_id, high_score_count, medium_score_count, base_score_count, multi_product_opportunity_high, multi_product_opportunity_medium, multi_product_opportunity_base FROM v_score_table")
def opportunity_flags(t):
    levels = ("high", "medium", "base")
    return sc.opportunity_flags(t.scores).select("party_id", *[f"{x}_score_count" for x in levels], *[f"multi_product_opportunity_{x}" for x in levels])


@query("OUT-4 OUT-5", """
SELECT party_id, CAST(200112 AS BIGINT) AS prediction_month, 'v1' AS model_version, '2002-01-01' AS score_date, '200112_' || party_id AS run_key FROM v_scores""")
def stamped_run(t):
    rows = sc.stamp_run(t.scores.select("party_id"), prediction_month=MONTH, model_version="v1", score_date="2002-01-01")
    return rows.withColumn("run_key", sc.run_key("prediction_month"))


@query("OUT-6", """
SELECT party_id, CASE WHEN pred_prob > CAST(0.7 AS DOUBLE) THEN 'High' WHEN pred_prob > CAST(0.5 AS DOUBLE) THEN 'Medium' ELSE 'Low' END AS confidence FROM v_confidence""")
def confidence_labels(t):
    return confident(t).select("party_id", sc.confidence_label("pred_prob").alias("confidence"))


@query("OUT-7", f"""
SELECT c.party_id, c.predicted_product, {rd('c.pred_prob')} AS pred_prob, s.client_seg, s.channel, s.branch_name, CAST(s.psn_age AS BIGINT) AS psn_age,
  CASE WHEN c.pred_prob > CAST(0.7 AS DOUBLE) THEN 'High' WHEN c.pred_prob > CAST(0.5 AS DOUBLE) THEN 'Medium' ELSE 'Low' END AS confidence
FROM v_confidence c LEFT JOIN {SNAPSHOT} s ON c.party_id = s.party_id""")
def final_predictions(t):
    out = sc.final_predictions(confident(t), demographics(t))
    return out.select("party_id", "predicted_product", "pred_prob", "client_seg", "channel", "branch_name", "psn_age", "confidence")


@query("OUT-8", """
SELECT predicted_product, count(CASE WHEN pred_prob >= CAST(0.9 AS DOUBLE) THEN 1 END) AS at_90, count(CASE WHEN pred_prob >= CAST(0.95 AS DOUBLE) THEN 1 END) AS at_95 FROM v_confidence GROUP BY 1""")
def confident_clients_per_product(t):
    return sc.confidence_counts(confident(t), [0.9, 0.95])


@query("OUT-8", f"SELECT party_id, predicted_product, {rd('pred_prob')} AS pred_prob FROM v_confidence WHERE pred_prob >= CAST(0.95 AS DOUBLE)")
def confident_clients(t):
    return sc.high_confidence(confident(t))


LIST_COLUMNS = "CAST(CASE t.product " + " ".join(f"WHEN '{p}' THEN s.{p}_rank" for p in sc.PRODUCTS) + " END AS BIGINT) AS product_rank, CAST(CASE t.product " + " ".join(
    f"WHEN '{p}' THEN s.{p}_decile" for p in sc.PRODUCTS) + " END AS BIGINT) AS product_decile"


@query("OUT-29 JN-16", f"""
SELECT s.party_id, t.product, {rd('t.score')} AS score, s.best_product, {LIST_COLUMNS}, s.multi_product_opportunity_high, t.talking_points[1] AS talking_point_1, t.talking_points[5] AS talking_point_5,
  t.top_features[1] AS top_feature_1, {rd('t.top_contributions[1]')} AS top_feature_1_contribution FROM v_score_table s JOIN v_explanations t
  ON s.party_id = t.party_id AND s.prediction_month = t.prediction_month WHERE t.score > CAST(0.6 AS DOUBLE)""")
def advisor_smart_list(t):
    out = advisor.smart_list(score_table(t), explanation_table(t))
    return out.select("party_id", "product", "score", "best_product", "product_rank", "product_decile", "multi_product_opportunity_high",
                      "talking_point_1", "talking_point_5", "top_feature_1", "top_feature_1_contribution")


@query("OUT-30 JN-15 TOP-3", f"""
SELECT s.party_id, s.best_product, s.second_best_product, s.medium_score_count,
  CASE WHEN best_score - second_best_score > CAST(0.15 AS DOUBLE) THEN 'Focus on primary product first' WHEN best_score - second_best_score < CAST(0.05 AS DOUBLE) THEN 'Dual product approach' ELSE 'Lead with primary, mention secondary' END AS pitch_strategy,
  best_product || ' + ' || second_best_product AS product_bundle, {rd('(best_score + second_best_score) / 2')} AS combined_score,
  a.talking_points[1] AS primary_reason_1, a.talking_points[2] AS primary_reason_2, b.talking_points[1] AS secondary_reason_1, b.talking_points[2] AS secondary_reason_2
FROM v_score_table s LEFT JOIN v_explanations a ON s.party_id = a.party_id AND a.product = s.best_product
LEFT JOIN v_explanations b ON s.party_id = b.party_id AND b.product = s.second_best_product WHERE s.multi_product_opportunity_medium = 1""")
def multi_product_strategy(t):
    out = advisor.strategy(sc.opportunity_flags(sc.best_two(t.scores)), explanation_table(t))
    return out.select("party_id", "best_product", "second_best_product", "medium_score_count", "pitch_strategy", "product_bundle", "combined_score",
                      "primary_reason_1", "primary_reason_2", "secondary_reason_1", "secondary_reason_2")


@query("OUT-31", """
SELECT CASE WHEN best_score - second_best_score > CAST(0.15 AS DOUBLE) THEN 'Focus on primary product first' WHEN best_score - second_best_score < CAST(0.05 AS DOUBLE) THEN 'Dual product approach' ELSE 'Lead with primary, mention secondary' END AS pitch_strategy,
  count(*) AS n FROM v_score_table WHERE multi_product_opportunity_medium = 1 GROUP BY 1""")
def clients_per_strategy(t):
    rows = advisor.strategy(sc.opportunity_flags(sc.best_two(t.scores)), explanation_table(t))
    return advisor.list_counts(rows, "pitch_strategy")


@query("OUT-32", f"""
SELECT s.party_id, s.best_product, {rd('t.score')} AS explanation_score, array_to_string(t.top_features, ',') AS top_features, array_to_string(t.talking_points, ',') AS talking_points,
  CAST(CASE WHEN t.score IS NULL THEN 0 ELSE 1 END AS BIGINT) AS explanation_available FROM v_best s
LEFT JOIN (SELECT * REPLACE (CASE WHEN product = 'retirement' THEN 'pension' ELSE product END AS product) FROM v_explanations) t ON s.party_id = t.party_id AND t.product = s.best_product""")
def final_output(t):
    """Retirement goes by another name in the explanations, so some clients stay without one."""
    known = explanation_table(t).replace({"retirement": "pension"}, subset=["product"])
    return advisor.final_output(sc.best_two(t.scores), known).select(
        "party_id", "best_product", "explanation_score", "top_features", "talking_points", "explanation_available")


@query("OUT-33", f"SELECT party_id, {rd('investment_score')} AS investment_score FROM v_scores WHERE investment_score > CAST(0.7 AS DOUBLE) ORDER BY investment_score DESC, party_id LIMIT 500")
def top_investment_prospects(t):
    return advisor.advisor_query(t.scores, "top").select("party_id", "investment_score")


@query("OUT-33", """
SELECT 'high' AS level, party_id, high_score_count AS products FROM v_score_table WHERE multi_product_opportunity_high = 1
UNION ALL SELECT 'medium', party_id, medium_score_count FROM v_score_table WHERE multi_product_opportunity_medium = 1
UNION ALL SELECT 'base', party_id, base_score_count FROM v_score_table WHERE multi_product_opportunity_base = 1""")
def multi_product_lists(t):
    rows = sc.opportunity_flags(sc.best_two(t.scores))
    parts = [advisor.advisor_query(rows, "multi", level=x, ordered=False).select(F.lit(x).alias("level"), "party_id", F.col(f"{x}_score_count").alias("products")) for x in ("high", "medium", "base")]
    return parts[0].unionAll(parts[1]).unionAll(parts[2])


@query("OUT-33", "SELECT party_id, CAST(1 AS BIGINT) AS retirement_decile FROM v_score_table WHERE retirement_decile = 1")
def best_retirement_decile(t):
    return advisor.advisor_query(sc.score_deciles(t.scores), "decile", "retirement").select("party_id", "retirement_decile")


@query("OUT-33", f"SELECT party_id, {rd('retirement_score')} AS retirement_score, rank() OVER (ORDER BY retirement_score DESC) AS retirement_rank FROM v_scores QUALIFY v_scores.retirement_score > CAST(0.75 AS DOUBLE)")
def retirement_prospects_with_rank(t):
    return advisor.advisor_query(sc.score_ranks(t.scores), "product", "retirement", threshold=0.75)


@query("OUT-34", """
SELECT product, count(CASE WHEN score > CAST(0.7 AS DOUBLE) THEN 1 END) AS high_scorers, count(CASE WHEN score >= CAST(0.6 AS DOUBLE) AND score <= CAST(0.7 AS DOUBLE) THEN 1 END) AS medium_scorers FROM v_long_scores GROUP BY 1""")
def potential_per_product(t):
    return advisor.potential_counts(sc.long_scores(t.scores))


@query("JN-17 JN-18", f"""
SELECT x.party_id, x.best_product, s.client_seg, s.channel, f.product_category AS first_product FROM v_best x
JOIN (SELECT DISTINCT party_id FROM v_policies WHERE branchoffice_code = '7') b ON x.party_id = b.party_id LEFT JOIN {SNAPSHOT} s ON x.party_id = s.party_id
LEFT JOIN (SELECT * FROM v_class3 WHERE product_category <> 'OTHER' QUALIFY row_number() OVER (PARTITION BY party_id ORDER BY register_date, policy_no) = 1) f ON x.party_id = f.party_id""")
def enhanced_branch_scores(t):
    out = sc.enhance_scores(sc.best_two(t.scores), t.policies, "7", demographics(t), pol.first_product(classify(t.policies)))
    return out.select("party_id", "best_product", "client_seg", "channel", "first_product")


def pitch(t):
    texts = explain.narrative(predictions_with_demographics(t), explain.signed_contributions(of_prediction(t)), dict(enumerate(CATEGORIES, 1)))
    return advisor.pitch_table(predictions_with_demographics(t), texts)


def predictions_with_demographics(t):
    rows = c360.client_snapshot(t.policies).select("party_id", "psn_age", "client_seg", F.lit(None).cast("double").alias("client_tenure"))
    return confident(t).join(rows.hint("merge"), "party_id", "left")


def of_prediction(t):
    """Contributions of the predicted product of each client."""
    predicted = confident(t).select("party_id", F.col("predicted_product").alias("product"))
    return t.contributions.join(predicted.hint("merge"), ["party_id", "product"])


SEGMENT = f"(SELECT c.*, s.client_seg, s.psn_age FROM v_confidence c LEFT JOIN {SNAPSHOT} s ON c.party_id = s.party_id)"


@query("OUT-38", f"SELECT client_seg, predicted_product AS recommended_product, count(*) AS n FROM {SEGMENT} WHERE client_seg IS NOT NULL GROUP BY 1, 2 ORDER BY n DESC, client_seg, recommended_product LIMIT 10")
def recommendations_by_segment(t):
    return advisor.by_segment(predictions_with_demographics(t).withColumnRenamed("predicted_product", "recommended_product"))


@query("OUT-39", f"""
SELECT CASE WHEN psn_age <= 35 THEN '<35' WHEN psn_age <= 50 THEN '35-50' WHEN psn_age <= 65 THEN '50-65' ELSE '65+' END AS age_group, predicted_product AS recommended_product, count(*) AS n
FROM {SEGMENT} WHERE psn_age > 0 AND psn_age <= 100 GROUP BY 1, 2""")
def recommendations_by_age_group(t):
    return advisor.by_age_group(predictions_with_demographics(t).withColumnRenamed("predicted_product", "recommended_product"))


@query("OUT-40", f"SELECT count(*) AS clients, count(DISTINCT predicted_product) AS products, {rd('avg(pred_prob)')} AS avg_confidence FROM v_confidence")
def recommendation_totals(t):
    return advisor.pitch_totals(confident(t).withColumnsRenamed({"predicted_product": "recommended_product", "pred_prob": "recommendation_confidence"}))


@query("OUT-7 SRC-5", """
SELECT party_id, policy_no, product_category AS first_product_category, CAST(register_date AS VARCHAR) AS first_register_date FROM v_class3 WHERE policy_status = 'Active' AND branchoffice_code = '7'
QUALIFY count(*) OVER (PARTITION BY party_id) = 1""")
def scoring_population(t):
    from nextcover.plans.monthly_run import scoring_population as population
    from workload.views import AS_OF

    return population(active(t.policies), AS_OF, "7").select("party_id", "policy_no", "first_product_category", "first_register_date")
