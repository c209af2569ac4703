"""Month over month."""

from pyspark.sql import functions as F

from nextcover.functions.classify import classify
from nextcover.operators import monitor, policies as pol
from nextcover.operators.ordered import first_by
from nextcover.sources import writers
from workload.registry import query, rounded
from workload.sinks import fresh
from workload.sqltext import rd
from workload.views import MONTH



def last_month_predictions(t):
    """Each client's first policy before June 2001 and the best product of their scores."""
    from nextcover.operators.scoring import best_two

    before = classify(t.policies).filter("register_date < DATE '2001-06-01'")
    first = first_by(before, ["party_id"], [F.asc("register_date"), F.asc("policy_no")]).select(
        "party_id", F.col("product_category").alias("first_product_category"))
    best = best_two(t.scores).select("party_id", F.upper("best_product").alias("predicted_product"), F.col("best_score").alias("pred_prob"))
    return first.join(best, "party_id").withColumn("business_month", F.lit(200111))


LAST = """(SELECT f.party_id, f.product_category AS first_product_category, upper(b.best_product) AS predicted_product, b.best_score AS pred_prob FROM
  (SELECT * FROM v_ranked3 WHERE event_index = 1 AND register_date < DATE '2001-06-01') f JOIN v_best b ON f.party_id = b.party_id)"""
OUTCOME = f"""(SELECT *, CASE WHEN predicted_product = actual_product_bought THEN 'Match' ELSE 'No Match' END AS prediction_match FROM (
  SELECT l.*, coalesce((SELECT min(c.product_category) FROM v_class3 c WHERE c.party_id = l.party_id AND c.product_category <> l.first_product_category), 'UNKNOWN') AS actual_product_bought
  FROM {LAST} l WHERE l.party_id IN (SELECT party_id FROM v_class3 GROUP BY 1 HAVING count(DISTINCT product_category) >= 2)))"""


@query("OUT-13 JN-21", f"""
SELECT party_id, first_product_category, predicted_product, actual_product_bought, prediction_match, CAST(200111 AS BIGINT) AS prediction_month, CAST(200112 AS BIGINT) AS actual_purchase_month FROM {OUTCOME}""")
def prediction_outcomes(t):
    return monitor.prediction_outcome(last_month_predictions(t), classify(t.policies), MONTH)


@query("OUT-13 JN-7 JN-21", f"""
SELECT party_id, first_product_category, predicted_product, actual_product_bought, prediction_match, CAST(200111 AS BIGINT) AS prediction_month, CAST(200112 AS BIGINT) AS actual_purchase_month FROM {OUTCOME}""")
def outcomes_of_stored_months(t):
    """The comparison over tables that are stored by client."""
    names = [fresh(t, "predictions")[0], fresh(t, "holdings")[0]]
    for name, rows in zip(names, (last_month_predictions(t), classify(t.policies).select("party_id", "product_category"))):
        writers.store_by_client(rows, name, buckets=8)
    predictions, current = (t.spark.table(n) for n in names)
    return monitor.prediction_outcome(predictions, current, MONTH)


@query("OUT-14", f"""
SELECT predicted_product, actual_product_bought, prediction_match, count(*) AS n, {rd("100.0 * sum(count(CASE WHEN prediction_match = 'Match' THEN 1 END)) OVER () / sum(count(*)) OVER ()")} AS accuracy_pct
FROM {OUTCOME} GROUP BY 1, 2, 3""")
def outcome_summary(t):
    return monitor.outcome_summary(monitor.prediction_outcome(last_month_predictions(t), classify(t.policies), MONTH))


# some clients go by another id in one of the months: they are gone in one and new in the other
THIS = "(SELECT CASE WHEN CAST(party_id AS BIGINT) % 9 = 0 THEN party_id || '-new' ELSE party_id END AS party_id, second_best_product AS predicted_product, second_best_score AS pred_prob FROM v_best)"
PREV = "(SELECT CASE WHEN CAST(party_id AS BIGINT) % 11 = 0 THEN party_id || '-old' ELSE party_id END AS party_id, CASE WHEN CAST(party_id AS BIGINT) % 2 = 0 THEN best_product ELSE second_best_product END AS predicted_product, best_score AS pred_prob FROM v_best)"


@query("OUT-15", f"""
SELECT coalesce(a.party_id, b.party_id) AS party_id, a.predicted_product AS previous_product, b.predicted_product AS current_product,
  CASE WHEN a.party_id IS NULL THEN 'new' WHEN b.party_id IS NULL THEN 'gone' WHEN a.predicted_product = b.predicted_product THEN 'same' ELSE 'changed' END AS status,
  {rd('b.pred_prob - a.pred_prob')} AS confidence_change FROM {PREV} a FULL JOIN {THIS} b ON a.party_id = b.party_id""")
def prediction_stability(t):
    from nextcover.operators.scoring import best_two

    rows, k = best_two(t.scores), F.col("party_id").cast("long")
    def renamed(every, ending):
        return F.when(k % every == 0, F.concat("party_id", F.lit(ending))).otherwise(F.col("party_id")).alias("party_id")

    current = rows.select(renamed(9, "-new"), F.col("second_best_product").alias("predicted_product"), F.col("second_best_score").alias("pred_prob"))
    product = F.when(k % 2 == 0, F.col("best_product")).otherwise(F.col("second_best_product"))
    previous = rows.select(renamed(11, "-old"), product.alias("predicted_product"), F.col("best_score").alias("pred_prob"))
    out = monitor.prediction_stability(previous, current)
    return out.select("party_id", "previous_product", "current_product", "status", "confidence_change")


NEW = """(SELECT count(*) AS n FROM (SELECT party_id FROM v_class3 GROUP BY 1 HAVING count(DISTINCT product_category) >= 2
EXCEPT SELECT party_id FROM v_class3 WHERE register_date < DATE '1999-01-01' GROUP BY 1 HAVING count(DISTINCT product_category) >= 2))"""


@query("OUT-16 JN-20", f"SELECT n AS new_clients, CAST(100 AS BIGINT) AS threshold, CAST(CASE WHEN n > 100 THEN 1 ELSE 0 END AS BIGINT) AS retrain FROM {NEW}")
def retraining_trigger(t):
    now = classify(t.policies)
    baseline = pol.holdings(now.filter("register_date < DATE '1999-01-01'")).filter("num_products >= 2")
    return monitor.retrain_trigger(now, baseline, 100)


DRIFTING = ["acct_val_amt", "psn_age"]


def _psi(c):
    edges = ", ".join(f"(SELECT quantile_cont({c}, {k / 10}) FROM v_policies WHERE register_date < DATE '1999-01-01')" for k in range(1, 10))
    return f"""
SELECT '{c}' AS "column", {rd('sum((b - a) * ln(b / a))', 5)} AS psi, count(*) AS buckets FROM (
  SELECT k, greatest(count(CASE WHEN old THEN 1 END) / sum(count(CASE WHEN old THEN 1 END)) OVER (), 0.0001) AS a,
    greatest(count(CASE WHEN NOT old THEN 1 END) / sum(count(CASE WHEN NOT old THEN 1 END)) OVER (), 0.0001) AS b
  FROM (SELECT register_date < DATE '1999-01-01' AS old, len(list_filter([{edges}], lambda e: e < {c})) AS k FROM v_policies) GROUP BY k)"""


@query("OUT-17", " UNION ALL ".join(_psi(c) for c in DRIFTING))
def feature_drift(t):
    before = F.col("register_date") < F.lit("1999-01-01").cast("date")
    out = monitor.drift(t.policies.filter(before), t.policies.filter(~before), DRIFTING)
    return out.withColumn("psi", rounded("psi", 5))


