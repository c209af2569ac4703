"""Explanations."""

from pyspark.sql import functions as F

from nextcover.functions.classify import CATEGORIES
from nextcover.operators import explain, prep
from workload.aggregations import confident
from workload.feature_sets import training
from workload.preparation import is_train
from workload.registry import query, rounded
from workload.scoring import SNAPSHOT, explanation_table, of_prediction, pitch, points, predictions_with_demographics
from workload.sinks import stored
from workload.sqltext import TEXT, rd


LINEAR = {"acct_val_amt": 0.25, "psn_age": -2.0, "face_amt": 0.5}


@query("OUT-9", " UNION ALL ".join(
    f"SELECT policy_no, 'investment' AS product, '{f}' AS feature, {rd(f'{w} * (coalesce({f}, m) - m)', 2)} AS contribution FROM v_policies "
    f"CROSS JOIN (SELECT avg({f}) AS m FROM v_policies WHERE CAST(policy_no AS BIGINT) % 5 <> 0)" for f, w in LINEAR.items()))
def linear_contributions(t):
    means = explain.feature_means(t.policies.filter(is_train()), list(LINEAR))
    out = explain.linear_contributions(t.policies, LINEAR, means, "investment", key="policy_no")
    return out.select("policy_no", "product", "feature", rounded("contribution", 2).alias("contribution"))


@query("OUT-9 ML-3")
def contributions_of_a_fitted_model(t):
    from nextcover.operators.models import train_per_product

    features = ["acct_val_amt", "wc_total_assets", "client_age", "client_tenure_years"]
    # the fit, the means and the contributions all read it
    table = stored(t, training(t).select("party_id", "policy_no", *features, "investment_cross_sell"), "training")
    learnt = table.filter(is_train()).persist()
    model = train_per_product(learnt, {"investment_cross_sell": features}, maxIter=10)["investment_cross_sell"]
    learnt.unpersist()
    coefficients = explain.logistic_coefficients(model, features)
    return explain.linear_contributions(table, coefficients, explain.feature_means(table.filter(is_train()), features), "investment")


@query("OUT-10", f"SELECT party_id, product, feature, {rd('contribution')} AS contribution, rank FROM v_top5")
def top_contributions(t):
    return explain.top_contributions(t.contributions).select("party_id", "product", "feature", "contribution", "rank")


SIDED = """(SELECT *, row_number() OVER (PARTITION BY party_id, product, side ORDER BY abs(contribution) DESC, feature) AS rank FROM (
  SELECT *, CASE WHEN contribution > 0 THEN 'positive' ELSE 'negative' END AS side FROM v_contributions WHERE contribution <> 0)
  QUALIFY rank <= CASE WHEN side = 'positive' THEN 5 ELSE 3 END)"""


@query("OUT-11", f"SELECT party_id, product, side, feature, {rd('contribution')} AS contribution, rank FROM {SIDED}")
def signed_contributions(t):
    return explain.signed_contributions(t.contributions).select("party_id", "product", "side", "feature", "contribution", "rank")


@query("OUT-12", f"""
SELECT product, feature, {rd('avg(abs(contribution))')} AS importance, rank() OVER (PARTITION BY product ORDER BY round(avg(abs(contribution)), 9) DESC) AS rank FROM v_contributions GROUP BY 1, 2""")
def importance_by_product(t):
    return explain.contribution_importance(t.contributions, ["product"])


@query("OUT-18", "SELECT party_id, product, rank, talking_point FROM v_points")
def talking_points(t):
    return points(t).select("party_id", "product", "rank", "talking_point")


ADVICE_SQL = """CASE feature
  WHEN 'acct_val_amt' THEN ' (moderate capacity) → Discuss portfolio diversification'
  WHEN 'client_age' THEN CASE WHEN v > 55 THEN ' (retirement planning window) → Focus on retirement readiness'
    WHEN v > 40 THEN ' (wealth accumulation phase) → Emphasize long-term growth' ELSE ' (early career) → Emphasize long-term growth' END
  WHEN 'aum_segment' THEN ' (core client segment) → Standard advisory approach'
  WHEN 'channel' THEN ' (direct channel) → Personal outreach approach'
  WHEN 'snp_close_lead_6' THEN CASE WHEN v > 0 THEN ' (positive market momentum) → Act on current strength' ELSE ' (market correction opportunity) → Position for recovery' END
  WHEN 'client_tenure_years' THEN CASE WHEN v > 10 THEN ' (long-standing relationship) → Deepen existing relationship'
    WHEN v > 5 THEN ' (established client) → Deepen existing relationship' ELSE ' (newer client) → Build trust and engagement' END END"""
MARKS = "CASE WHEN abs(contribution) > 0.1 THEN '🔥' WHEN abs(contribution) > 0.05 THEN '⭐' ELSE '' END"


@query("OUT-19", f"SELECT party_id, product, rank, {MARKS} || ' ' || {TEXT} || {ADVICE_SQL} AS enhanced_talking_point FROM (SELECT *, CAST(value AS DOUBLE) AS v FROM v_top5)")
def talking_points_with_advice(t):
    rows = explain.talking_point_ext(explain.top_contributions(t.contributions, 5))
    return rows.select("party_id", "product", "rank", "enhanced_talking_point")


@query("OUT-20", "SELECT party_id, product, " + ", ".join(f"max(CASE WHEN k = {i} THEN talking_point END) AS talking_point_{i}" for i in range(1, 6)) + """
FROM (SELECT *, row_number() OVER (PARTITION BY party_id, product ORDER BY rank) AS k FROM v_points WHERE feature <> 'channel') GROUP BY 1, 2""")
def wide_talking_points(t):
    text = F.when(F.col("feature") != "channel", F.col("talking_point"))
    return explain.talking_points_wide(points(t).withColumn("talking_point", text))


@query("OUT-21", """
SELECT party_id, product, feature, CASE WHEN feature IN ('client_age', 'client_tenure_years') THEN value || '.0' WHEN feature = 'acct_val_amt' THEN '$' || value
  ELSE value || '.00' END AS display_value FROM v_contributions""")
def displayed_values(t):
    return explain.display_value(t.contributions).select("party_id", "product", "feature", "display_value")


@query("OUT-21", """
SELECT party_id, 'branchoffice_code_idx' AS feature, branchoffice_code AS display_value FROM (SELECT DISTINCT party_id, branchoffice_code FROM v_policies)""")
def decoded_values(t):
    """Codes of branches, decoded through the fitted encoder."""
    branches = t.policies.select("party_id", "branchoffice_code").distinct()
    encoder = prep.fit_encoder(branches, ["branchoffice_code"])
    coded = prep.encode(branches, encoder, ["branchoffice_code"]).select(
        "party_id", F.lit("branchoffice_code_idx").alias("feature"), F.col("branchoffice_code_idx").cast("string").alias("value"))
    return explain.display_value(coded, encoder).select("party_id", "feature", "display_value")


def probabilities(t):
    from nextcover.operators.scoring import long_scores

    return long_scores(t.scores).withColumnsRenamed({"product": "class", "score": "probability"})


RANKED = "(SELECT *, row_number() OVER (PARTITION BY party_id ORDER BY score DESC, product) AS k FROM v_long_scores)"


@query("OUT-22", f"""
SELECT a.party_id, b.product AS predicted, a.k - 1 AS place, a.product AS alternative, {rd('a.score')} AS probability, {rd('b.score - a.score')} AS gap
FROM {RANKED} a JOIN {RANKED} b ON a.party_id = b.party_id AND b.k = 1 WHERE a.k BETWEEN 2 AND 4""")
def alternative_products(t):
    return explain.alternatives(probabilities(t))


@query("OUT-22", f"""
SELECT party_id, feature, {rd('d')} AS contribution_diff, rank FROM (
SELECT p.party_id, x.feature, y.contribution - x.contribution AS d, row_number() OVER (PARTITION BY p.party_id ORDER BY round(abs(y.contribution - x.contribution), 9) DESC, x.feature) AS rank
FROM (SELECT * FROM {RANKED} WHERE k = 1) p JOIN (SELECT * FROM {RANKED} WHERE k = 2) a ON p.party_id = a.party_id
JOIN v_contributions x ON x.party_id = p.party_id AND x.product = p.product JOIN v_contributions y ON y.party_id = a.party_id AND y.product = a.product AND y.feature = x.feature)
WHERE rank <= 3""")
def reasons_for_first_alternative(t):
    chosen = explain.alternatives(probabilities(t)).filter("place = 1")
    return explain.alternative_reasons(t.contributions, chosen).select("party_id", "feature", "contribution_diff", "rank")


SHOWN = "CASE WHEN feature IN ('client_age', 'client_tenure_years') THEN value || '.0' WHEN feature = 'acct_val_amt' THEN '$' || value ELSE value || '.00' END"


def pct(x):
    return f"printf('%.1f%%', 100 * {x})"


def decimals(x, plus=False):
    """Four digits after the point, by DuckDB's printf."""
    return f"printf('%{'+' if plus else ''}.4f', {x})"


@query("OUT-23 OUT-22", f"""
WITH s AS (SELECT x.*, {SHOWN} AS shown FROM {SIDED} x JOIN v_confidence c ON x.party_id = c.party_id AND x.product = c.predicted_product),
sides AS (
  SELECT party_id,
    string_agg(CASE WHEN side = 'positive' THEN CAST(rank AS VARCHAR) || '. **' || feature || '** = ' || shown || ' (' || CASE WHEN abs(contribution) > 0.1 THEN '🔥 High'
      WHEN abs(contribution) > 0.05 THEN '⭐ Moderate' ELSE '📊 Low' END || ' impact: +' || {decimals('contribution')} || ')' END, chr(10) ORDER BY rank) AS f,
    string_agg(CASE WHEN side = 'negative' THEN CAST(rank AS VARCHAR) || '. **' || feature || '** = ' || shown || ' (reducing confidence: ' || {decimals('contribution')} || ')' END,
      chr(10) ORDER BY rank) AS a FROM s GROUP BY 1),
others AS (
  SELECT a.party_id, string_agg('- **' || a.product || '**: ' || {pct('a.score')} || ' probability (gap: ' || {pct('(b.score - a.score)')} || ')', chr(10) ORDER BY a.k) AS o
  FROM {RANKED} a JOIN {RANKED} b ON a.party_id = b.party_id AND b.k = 1 WHERE a.k BETWEEN 2 AND 4 GROUP BY 1),
apart AS (
  SELECT party_id, string_agg('- **' || feature || '** = ' || shown || ' (contribution difference: ' || {decimals('d', True)} || ')', chr(10) ORDER BY rank) AS d FROM (
    SELECT p.party_id, x.feature, {SHOWN.replace('feature', 'x.feature').replace('value', 'x.value')} AS shown, y.contribution - x.contribution AS d,
      row_number() OVER (PARTITION BY p.party_id ORDER BY round(abs(y.contribution - x.contribution), 9) DESC, x.feature) AS rank
    FROM (SELECT * FROM {RANKED} WHERE k = 1) p JOIN (SELECT * FROM {RANKED} WHERE k = 2) a ON p.party_id = a.party_id
    JOIN v_contributions x ON x.party_id = p.party_id AND x.product = p.product
    JOIN v_contributions y ON y.party_id = a.party_id AND y.product = a.product AND y.feature = x.feature) WHERE rank <= 3 GROUP BY 1)
SELECT c.party_id, c.predicted_product, concat_ws(chr(10), '## Why This Product Was Recommended',
  'The model predicts **' || c.predicted_product || '** with ' || {pct('c.pred_prob')} || ' confidence.', chr(10) || '**Top Contributing Features (Supporting Prediction):**', t.f,
  chr(10) || '**Features Reducing Confidence:**' || chr(10) || t.a, chr(10) || '## Confidence Score Analysis',
  CASE WHEN c.pred_prob >= 0.7 THEN '**High Confidence (' || {pct('c.pred_prob')} || ')**: Strong feature alignment with ' || c.predicted_product || ' patterns.'
    WHEN c.pred_prob >= 0.5 THEN '**Moderate Confidence (' || {pct('c.pred_prob')} || ')**: Reasonable alignment, but some uncertainty remains.'
    ELSE '**Low Confidence (' || {pct('c.pred_prob')} || ')**: Weak feature alignment; consider reviewing alternative products.' END,
  chr(10) || '## Why Other Products Were Not Predicted', '**Top Alternative Products:**', o.o,
  chr(10) || '**Key Differences from Top Alternative:**' || chr(10) || d.d) AS reasoning_text
FROM v_confidence c LEFT JOIN sides t ON c.party_id = t.party_id LEFT JOIN others o ON c.party_id = o.party_id LEFT JOIN apart d ON c.party_id = d.party_id""")
def reasoning_texts(t):
    """The whole text, for every client with a prediction."""
    shown = explain.display_value(t.contributions)
    chosen = explain.alternatives(probabilities(t)).filter("place = 1")
    text = explain.reasoning_text(
        explain.display_value(explain.signed_contributions(of_prediction(t))), confident(t), explain.alternatives(probabilities(t)),
        explain.alternative_reasons(shown, chosen))
    return text.select("party_id", "predicted_product", "reasoning_text")


def _grouped(groups):
    return " UNION ALL ".join(f"SELECT '{g}' AS category, '{m}' AS member" for g, members in groups.items() for m in members)


@query("OUT-24", f"""
WITH i AS (SELECT product, feature, avg(abs(contribution)) AS importance FROM v_contributions GROUP BY 1, 2)
SELECT product, category, {rd('avg(importance)')} AS importance, count(*) AS features FROM (SELECT DISTINCT i.*, g.category FROM i JOIN ({_grouped(explain.FEATURE_CATEGORIES)}) g ON contains(i.feature, g.member)) GROUP BY 1, 2""")
def importance_by_category(t):
    return explain.category_importance(t.contributions)


@query("OUT-25", f"""
SELECT t.product, t.feature, count(*) AS hits, any_value(c.n) AS clients, {rd('count(*) / any_value(c.n)')} AS share FROM v_top5 t
JOIN (SELECT product, count(DISTINCT party_id) AS n FROM v_contributions GROUP BY 1) c ON t.product = c.product WHERE t.rank <= 3 GROUP BY 1, 2""")
def share_of_clients_in_top_three(t):
    return explain.top3_share(t.contributions)


@query("OUT-26", f"""
SELECT product, {rd('avg(v)')} AS avg_variance, CASE WHEN avg(v) < 0.005 THEN 'Very Consistent' WHEN avg(v) < 0.01 THEN 'Moderately Consistent' ELSE 'Diverse' END AS consistency
FROM (SELECT product, feature, var_pop(contribution) AS v FROM v_contributions GROUP BY 1, 2) GROUP BY 1""")
def driver_consistency(t):
    return explain.consistency(t.contributions)


# the fixture's six features renamed so that some pairs meet
RENAMES = {"aum_segment": "aggressive_investor", "channel": "retirement_planning_trigger", "snp_close_lead_6": "wc_total_assets"}
RENAMED_SQL = "(SELECT * REPLACE (CASE feature " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in RENAMES.items()) + " ELSE feature END AS feature) FROM v_contributions)"


@query("OUT-27", f"""
WITH i AS (SELECT product, feature, avg(abs(contribution)) AS v FROM {RENAMED_SQL} GROUP BY 1, 2)
SELECT a.product, k.n AS pair_no, k.x || ' + ' || k.y AS pair, {rd('a.v + b.v')} AS importance, CASE WHEN a.v + b.v > 0.15 THEN 'CRITICAL' WHEN a.v + b.v > 0.1 THEN 'HIGH' ELSE 'MODERATE' END AS level,
  row_number() OVER (PARTITION BY a.product ORDER BY round(a.v + b.v, 9) DESC, k.n) AS rank
FROM (""" + " UNION ALL ".join(f"SELECT CAST({i} AS BIGINT) AS n, '{a}' AS x, '{b}' AS y" for i, (a, b, _) in enumerate(explain.FEATURE_PAIRS)) + """) k
JOIN i a ON a.feature = k.x JOIN i b ON b.feature = k.y AND a.product = b.product QUALIFY rank <= 5""")
def feature_pair_importance(t):
    rows = t.contributions.replace(RENAMES, subset=["feature"])
    return explain.pair_importance(rows).select("product", "pair_no", "pair", "importance", "level", "rank")


@query("OUT-28", f"""
SELECT party_id, product, {rd('score')} AS score, array_to_string(top_features, ',') AS top_features, array_to_string(top_feature_values, ',') AS top_feature_values,
  array_to_string(talking_points, ',') AS talking_points, CAST(prediction_month AS BIGINT) AS prediction_month FROM v_explanations""")
def explanation_rows(t):
    return explanation_table(t).select("party_id", "product", "score", "top_features", "top_feature_values", "talking_points", "prediction_month")


@query("OUT-35", f"""
SELECT party_id, product, feature, {rd('contribution')} AS contribution, value FROM v_contributions WHERE feature NOT IN ('channel', 'aum_segment')
UNION ALL SELECT party_id, product, 'channel', {rd('sum(contribution)')}, CASE WHEN any_value(CAST(party_id AS BIGINT)) % 2 = 0 THEN 'Direct' ELSE 'Branch Assist' END FROM v_contributions
WHERE feature IN ('channel', 'aum_segment') GROUP BY party_id, product""")
def base_feature_contributions(t):
    """Two one-hot columns of the channel stand in for two of the fixture's features."""
    even = F.col("party_id").cast("long") % 2 == 0
    name = F.when(F.col("feature") == "channel", "channel_Direct").when(F.col("feature") == "aum_segment", "channel_Branch Assist").otherwise(F.col("feature"))
    one = F.when(F.col("feature") == "channel", even.cast("int").cast("string")).when(F.col("feature") == "aum_segment", (~even).cast("int").cast("string")).otherwise(F.col("value"))
    rows = t.contributions.withColumns({"value": one, "_name": name}).drop("feature").withColumnRenamed("_name", "feature")
    bases = ["acct_val_amt", "client_age", "channel", "snp_close_lead_6", "client_tenure_years"]
    return explain.to_base_feature(rows, bases).select("party_id", "product", "feature", "contribution", "value")


# the text for every client with a prediction, from the opening to the next step
NARRATIVE = f"""(
WITH s AS (SELECT x.*, c.predicted_product, n.psn_age FROM {SIDED} x JOIN v_confidence c ON x.party_id = c.party_id AND x.product = c.predicted_product
  LEFT JOIN (SELECT * FROM v_ranked3 WHERE rn_desc = 1) n ON x.party_id = n.party_id)
SELECT c.party_id, c.predicted_product, coalesce(t.f, '') AS top_positive_features, coalesce(t.a, '') AS top_negative_features,
  concat_ws(chr(10), 'Based on your client profile and purchase history, we recommend ' || c.predicted_product || ' with ' || {pct('c.pred_prob')} || ' confidence.',
    CASE WHEN t.f <> '' THEN chr(10) || 'Key reasons for this recommendation:' END, t.lines, CASE WHEN t.a <> '' THEN chr(10) || 'Considerations:' END, t.concerns,
    chr(10) || 'Next Steps: Let''s schedule a consultation to discuss how ' || c.predicted_product || ' can help you achieve your financial goals.') AS talking_points
FROM v_confidence c LEFT JOIN (
  SELECT party_id, string_agg(CASE WHEN side = 'positive' AND rank <= 3 THEN feature END, ', ' ORDER BY rank) AS f, string_agg(CASE WHEN side = 'negative' AND rank <= 2 THEN feature END, ', ' ORDER BY rank) AS a,
  string_agg(CASE WHEN side = 'negative' AND contribution < -0.1 AND feature = 'client_age' THEN '  - While age is a factor, ' || predicted_product
    || ' still offers significant value for your situation.' END, chr(10) ORDER BY rank) AS concerns,
  string_agg(CASE WHEN side = 'positive' THEN '  ' || CAST(rank AS VARCHAR) || '. ' || CASE
    WHEN feature = 'client_tenure_years' AND CAST(value AS BIGINT) > 0 THEN 'With ' || value || '.0 years as our client, ' || predicted_product || ' represents a natural next step in your relationship with us.'
    WHEN feature = 'client_tenure_years' THEN 'As a valued client, ' || predicted_product || ' represents a natural next step in your relationship with us.'
    WHEN feature = 'aum_segment' THEN 'Your asset profile indicates ' || predicted_product || ' would be an excellent fit for your portfolio.'
    WHEN feature = 'channel' THEN 'Clients in your channel typically benefit from ' || predicted_product || '.'
    ELSE 'Your ' || replace(feature, '_', ' ') || ' profile strongly supports ' || predicted_product || '.' END END, chr(10) ORDER BY rank) AS lines
  FROM s GROUP BY 1) t ON c.party_id = t.party_id)"""


@query("OUT-36", f"SELECT * FROM {NARRATIVE}")
def client_narrative(t):
    text = explain.narrative(predictions_with_demographics(t), explain.signed_contributions(of_prediction(t)), dict(enumerate(CATEGORIES, 1)))
    return text.select("party_id", "predicted_product", "top_positive_features", "top_negative_features", "talking_points")


@query("OUT-37", f"""
SELECT n.party_id, n.predicted_product AS recommended_product, {rd('c.pred_prob')} AS recommendation_confidence, CAST(s.psn_age AS BIGINT) AS psn_age, s.client_seg, n.talking_points
FROM {NARRATIVE} n JOIN v_confidence c ON c.party_id = n.party_id LEFT JOIN {SNAPSHOT} s ON s.party_id = n.party_id""")
def agent_pitch_table(t):
    return pitch(t).select("party_id", "recommended_product", "recommendation_confidence", "psn_age", "client_seg", "talking_points")
