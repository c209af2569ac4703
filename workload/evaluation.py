"""Training and evaluation."""

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from nextcover.functions.classify import CATEGORIES, classify
from nextcover.operators import artefacts, models as m, policies as pol, prep, quality, sequences as sq, trees
from nextcover.operators.clean import valid_targets
from nextcover.operators.ordered import first_by
from nextcover.operators.scoring import long_scores
from nextcover.plans import monthly_run
from nextcover.sources import readers
from workload.feature_sets import first_second_rows, training
from workload.preparation import TRAIN, is_train
from workload.registry import query
from workload.sinks import fresh, stored
from workload.sqltext import rd
from workload.views import AS_OF


def labelled(t):
    """Label: category of the next policy; prediction: category of this one."""
    pairs = pol.consecutive_pairs(classify(t.policies))
    return pairs.select("party_id", "policy_no", F.col("next_product").alias("label"), F.col("product_category").alias("prediction"))


ROWS_PER_TASK = 5_000
FEATURES = ["acct_val_amt", "wc_total_assets", "psn_age", "product_idx", "channel_idx"]


def model_rows(t):
    """First policies with an index label, filled and encoded; codes and labels are those of the
    training rows, and rows with a label that these lack are left out."""
    bought = valid_targets(first_second_rows(t, "acct_val_amt", "wc_total_assets", "psn_age", "channel"), "second_product_category")
    # codes, labels, the fit and the scores all read them
    rows = stored(t, bought.select("party_id", "policy_no", "acct_val_amt", "wc_total_assets", "psn_age", "product_category", "channel", "second_product_category"), "bought")
    codes = prep.fit_encoder(rows.filter(is_train()), ["product_category", "channel"])
    coded = prep.encode(rows, codes, ["product_category", "channel"]).withColumnRenamed("product_category_idx", "product_idx")
    labels = prep.label_index(rows.filter(is_train()), "second_product_category")
    return prep.fill_zero(coded.join(F.broadcast(labels), "second_product_category")).select(
        "party_id", "policy_no", *FEATURES, F.col("label").cast("double").alias("label"), "second_product_category")


def _scored(t, train):
    rows = model_rows(t).persist()
    learnt = rows.filter(is_train())
    model = train(prep.with_weight(learnt, prep.class_weights(learnt, "second_product_category"), "second_product_category"))
    rows.unpersist()  # kept for the passes of the fit alone
    return model, model.transform(rows.filter(~is_train()))


# held-out rows of the models, as SQL can state them
HELD_OUT = """(SELECT party_id, policy_no, second_product_category FROM v_bought WHERE CAST(policy_no AS BIGINT) % 5 = 0
  AND second_product_category <> 'OTHER' AND second_product_category IN (SELECT second_product_category FROM v_bought WHERE CAST(policy_no AS BIGINT) % 5 <> 0))"""


def _checked(scored):
    """Held-out rows with their label and whether the prediction is one of the known classes."""
    known = F.col("prediction").isin([float(i) for i in range(len(CATEGORIES))])
    return scored.select("party_id", "policy_no", "second_product_category", known.cast("int").alias("known_class"))


@query("ML-1 PRE-5", f"SELECT *, CAST(1 AS BIGINT) AS known_class FROM {HELD_OUT}")
def boosted_trees_held_out_rows(t):
    """Fitted on the training rows alone, applied to every held-out one."""
    _, scored = _scored(t, lambda d: m.train_gbt_ovr(d, FEATURES, weight="weight", maxIter=2, maxDepth=2))
    return _checked(scored)


@query("ML-2 PRE-5", f"SELECT *, CAST(1 AS BIGINT) AS known_class FROM {HELD_OUT}")
def random_forest_held_out_rows(t):
    _, scored = _scored(t, lambda d: m.train_rf(d, FEATURES, weight="weight", numTrees=5, maxDepth=4))
    return _checked(scored)


def _adds_up(t, train, nodes_of):
    """Per held-out row whether base and contributions of every class give the raw score of the
    model."""
    model, scored = _scored(t, train)
    _, path = fresh(t, "model")
    model.write().save(path)
    nodes = nodes_of(model, path)
    key = ["party_id", "policy_no"]
    raw = scored.select(*key, F.posexplode(vector_to_array("rawPrediction")).alias("class", "raw"))
    # dealt out before each becomes a row per split
    asked = scored.select(*key, *FEATURES)
    asked = asked.repartition(max(1, -(-asked.count() // ROWS_PER_TASK)), *key)
    sums = trees.tree_contributions(asked, key, nodes, FEATURES, trees.depth(model)).groupBy(*key, "class").agg(F.sum("contribution").alias("sum"))
    # a class without trees of its own has a score of nothing
    both = raw.join(sums, [*key, "class"], "left").join(trees.base_scores(nodes), "class", "left")
    gap = F.abs(F.coalesce("sum", F.lit(0.0)) + F.coalesce("base", F.lit(0.0)) - F.col("raw"))
    return both.groupBy(*key).agg(F.min((gap < 1e-9).cast("int")).alias("adds_up"))


@query("OUT-9 ML-2", f"SELECT party_id, policy_no, CAST(1 AS BIGINT) AS adds_up FROM {HELD_OUT}")
def forest_contributions_add_up(t):
    return _adds_up(t, lambda d: m.train_rf(d, FEATURES, weight="weight", numTrees=5, maxDepth=4), trees.forest_nodes)


@query("OUT-9 ML-1", f"SELECT party_id, policy_no, CAST(1 AS BIGINT) AS adds_up FROM {HELD_OUT}")
def boosted_contributions_add_up(t):
    return _adds_up(t, lambda d: m.train_gbt_ovr(d, FEATURES, weight="weight", maxIter=2, maxDepth=3), trees.boosted_nodes)


# a small forest as a table of nodes: tree, node, left, right, feature, threshold, value
NODES = [
    (0, 0, 1, 4, 0, 150000.0, 0.45), (0, 1, 2, 3, 1, 40.0, 0.2), (0, 2, -1, -1, -1, None, 0.125), (0, 3, -1, -1, -1, None, 0.3125),
    (0, 4, 5, 6, 2, 400000.0, 0.75), (0, 5, -1, -1, -1, None, 0.5), (0, 6, -1, -1, -1, None, 0.9375),
    (1, 0, 1, 2, 1, 50.0, 0.1), (1, 1, -1, -1, -1, None, -0.25), (1, 2, 3, 4, 0, 100000.0, 0.375), (1, 3, -1, -1, -1, None, 0.25),
    (1, 4, 5, 6, 1, 70.0, 0.5), (1, 5, -1, -1, -1, None, 0.4375), (1, 6, -1, -1, -1, None, 0.625)]
NODE_FEATURES = ["acct_val_amt", "psn_age", "face_amt"]
NODE_ROWS = ", ".join(str(r).replace("None", "CAST(NULL AS DOUBLE)") for r in NODES)


@query("OUT-9", f"""
SELECT * FROM (WITH RECURSIVE nodes AS (SELECT * FROM (VALUES {NODE_ROWS}) x(tree, node, l, r, feature, threshold, value)),
walk AS (
  SELECT p.policy_no, n.tree, n.node, CAST(-1 AS INTEGER) AS asked, CAST(0 AS DOUBLE) AS change FROM v_policies p CROSS JOIN nodes n WHERE n.node = 0
  UNION ALL
  SELECT w.policy_no, w.tree, c.node, n.feature, CAST(c.value - n.value AS DOUBLE)
  FROM walk w JOIN v_policies p ON p.policy_no = w.policy_no JOIN nodes n ON n.tree = w.tree AND n.node = w.node AND n.l >= 0
  JOIN nodes c ON c.tree = n.tree AND c.node = CASE WHEN CASE n.feature WHEN 0 THEN p.acct_val_amt WHEN 1 THEN p.psn_age ELSE p.face_amt END <= n.threshold THEN n.l ELSE n.r END)
SELECT policy_no, ['acct_val_amt', 'psn_age', 'face_amt'][asked + 1] AS feature, {rd('sum(change)')} AS contribution FROM walk WHERE asked >= 0 GROUP BY 1, 2)""")
def contributions_over_a_node_table(t):
    nodes = readers.rows_df(t.spark, [(*r[:-1], 0, r[-1]) for r in NODES],
                            "tree long, node int, left int, right int, feature int, threshold double, class int, value double")
    out = trees.tree_contributions(t.policies, ["policy_no"], nodes, NODE_FEATURES, depth=3)
    return out.select("policy_no", "feature", "contribution")


@query("PRJ-7 SNK-8 ML-2", f"SELECT party_id, policy_no, CAST(1 AS BIGINT) AS same_as_fresh, CAST(0 AS BIGINT) AS refitted_when_it_fits, CAST(1 AS BIGINT) AS refitted_when_not FROM {HELD_OUT}")
def stored_model_scores(t):
    """Scores of a stored and reloaded model against the fresh one's; with another number of
    classes the stored model isn't taken."""
    name, folder = fresh(t, "models")
    folder = f"{folder}_files"
    classes = ["a", "b"]
    model, scored = _scored(t, lambda d: artefacts.model_for(
        t.spark, name, folder, "next", 200111, FEATURES, classes, lambda: m.train_rf(d, FEATURES, numTrees=5, maxDepth=3))[0])
    loaded, again = artefacts.model_for(t.spark, name, folder, "next", 200112, FEATURES, classes, lambda: model)
    _, other = artefacts.model_for(t.spark, name, folder, "next", 200112, FEATURES, [*classes, "c"], lambda: model)
    columns = ["party_id", "policy_no"]
    fresh_scores = scored.select(*columns, vector_to_array("probability").alias("a"))
    stored_scores = loaded.transform(scored.drop("features", "rawPrediction", "probability", "prediction")).select(*columns, vector_to_array("probability").alias("b"))
    return fresh_scores.join(stored_scores, columns).select(
        *columns, (F.col("a") == F.col("b")).cast("int").alias("same_as_fresh"),
        F.lit(int(again)).alias("refitted_when_it_fits"), F.lit(int(other)).alias("refitted_when_not"))


@query("ML-3", f"""
SELECT * FROM (WITH held AS (SELECT DISTINCT party_id, product_category FROM v_class3),
rows AS (SELECT s.product, s.score, CASE WHEN h.party_id IS NULL THEN 0 ELSE 1 END AS label FROM v_long_scores s
  LEFT JOIN held h ON h.party_id = s.party_id AND h.product_category = upper(s.product) WHERE s.score IS NOT NULL),
ranked AS (SELECT product, label, rank() OVER (PARTITION BY product ORDER BY score) + (count(*) OVER (PARTITION BY product, score) - 1) / 2.0 AS r FROM rows)
SELECT product, CAST(sum(label) AS BIGINT) AS positives, CAST(count(*) - sum(label) AS BIGINT) AS negatives,
  {rd('(sum(CASE WHEN label = 1 THEN r END) - sum(label) * (sum(label) + 1) / 2.0) / (sum(label) * (count(*) - sum(label)))')} AS roc_auc FROM ranked GROUP BY 1)""")
def roc_auc_per_product(t):
    """Each product's score against who holds the product."""
    held = classify(t.policies).select("party_id", F.lower("product_category").alias("product")).distinct().withColumn("label", F.lit(1))
    rows = long_scores(t.scores).join(held, ["party_id", "product"], "left").fillna(0, ["label"])
    return m.exact_roc_auc(rows, ["product"])


@query("ML-3 ML-6")
def roc_auc_of_fitted_models(t):
    """Area on held-out rows of a model per product, fitted on the training rows."""
    out = per_product_scores(t, SCORED_TARGETS)
    long = out.select("policy_no", F.explode(F.array(*[
        F.struct(F.lit(c.removesuffix("_cross_sell")).alias("product"), F.col(c).cast("int").alias("label"), F.col(f"{c.removesuffix('_cross_sell')}_score").alias("score"))
        for c in SCORED_TARGETS])).alias("x")).select("policy_no", "x.*")
    return m.exact_roc_auc(long, ["product"])


@query("ML-1")
def boosted_trees_predictions(t):
    _, scored = _scored(t, lambda d: m.train_gbt_ovr(d, FEATURES, weight="weight"))
    return scored.select("party_id", "label", "prediction")


@query("ML-2")
def random_forest_predictions(t):
    _, scored = _scored(t, lambda d: m.train_rf(d, FEATURES, weight="weight", numTrees=10, maxDepth=5))
    return scored.select("party_id", "label", "prediction")


SCORED_TARGETS = ["investment_cross_sell", "retirement_cross_sell", "life_insurance_cross_sell", "network_products_cross_sell"]


def per_product_scores(t, targets):
    """Held-out rows with their targets and a score per target."""
    features = ["acct_val_amt", "wc_total_assets", "client_age", "client_tenure_years"]
    table = training(t).select("party_id", "policy_no", *features, *targets).persist()
    models = m.train_per_product(table.filter(is_train()), {c: features for c in targets}, maxIter=10)
    table.unpersist()
    out = table.filter(~is_train())
    for target, model in models.items():
        scored = model.transform(out).withColumn(f"{target.removesuffix('_cross_sell')}_score", vector_to_array("probability")[1])
        out = scored.drop("features", "rawPrediction", "probability", "prediction")
    return out


@query("ML-3 OUT-1")
def per_product_models(t):
    out = per_product_scores(t, SCORED_TARGETS)
    return out.select("party_id", *[c for c in out.columns if c.endswith("_score")])


@query("ML-4 ML-6")
def tuned_forest_metrics(t):
    _, scored = _scored(t, lambda d: m.tune(d, FEATURES, grid={"numTrees": [5], "maxDepth": [3, 5]}, folds=3))
    return m.metrics(scored)


@query("ML-4", f"""
SELECT party_id, CAST(1 AS BIGINT) AS folds, CAST(1 AS BIGINT) AS same_metric FROM (SELECT DISTINCT party_id FROM v_bought WHERE {TRAIN} AND second_product_category <> 'OTHER')""")
def folds_by_client(t):
    """Two drawn combinations of a grid over three folds. No client is in two folds, and the mean of
    the folds' F1, computed anew from the fold models' predictions, is the search's."""
    learnt = model_rows(t).filter(is_train()).persist()
    model = m.tune(learnt, FEATURES, grid={"numTrees": [3, 5], "maxDepth": [2, 3]}, folds=3, by="party_id", draws=2, submodels=True)
    search = model.stages[-1]
    dealt = m.with_folds(prep.assemble(FEATURES).transform(learnt), "party_id", 3)
    found = [m.metrics(search.subModels[i][0].transform(dealt.filter(F.col("fold") == i))).first()["weighted_f1"] for i in range(3)]
    learnt.unpersist()
    same = abs(sum(found) / 3 - search.avgMetrics[0]) < 1e-9
    return dealt.groupBy("party_id").agg(F.count_distinct("fold").alias("folds")).withColumn("same_metric", F.lit(int(same)))


@query("ML-5")
def feature_importance(t):
    model, _ = _scored(t, lambda d: m.train_rf(d, FEATURES, numTrees=10, maxDepth=5))
    return m.importance(model, FEATURES, t.spark)


REPORT = """(SELECT c.class, coalesce(s.n, 0) AS support, coalesce(p.n, 0) AS predicted, coalesce(x.n, 0) AS tp FROM
  (SELECT label AS class FROM v_labelled UNION SELECT prediction FROM v_labelled) c
  LEFT JOIN (SELECT label, count(*) AS n FROM v_labelled GROUP BY 1) s ON c.class = s.label
  LEFT JOIN (SELECT prediction, count(*) AS n FROM v_labelled GROUP BY 1) p ON c.class = p.prediction
  LEFT JOIN (SELECT label, count(*) AS n FROM v_labelled WHERE label = prediction GROUP BY 1) x ON c.class = x.label)"""
PRECISION, RECALL, F1 = "coalesce(tp / NULLIF(predicted, 0), 0)", "coalesce(tp / NULLIF(support, 0), 0)", "coalesce(2 * tp / NULLIF(support + predicted, 0), 0)"


@query("ML-6", f"""
SELECT {rd(f'sum({RECALL} * support) / sum(support)')} AS accuracy, {rd(f'sum({PRECISION} * support) / sum(support)')} AS weighted_precision,
  {rd(f'sum({RECALL} * support) / sum(support)')} AS weighted_recall, {rd(f'sum({F1} * support) / sum(support)')} AS weighted_f1, {rd(f'avg({F1})')} AS macro_f1,
  CAST(sum(support) AS BIGINT) AS rows FROM {REPORT}""")
def overall_metrics(t):
    return m.metrics(labelled(t))


@query("ML-7", f"SELECT class, {rd(PRECISION)} AS precision, {rd(RECALL)} AS recall, {rd(F1)} AS f1, support, predicted FROM {REPORT}")
def class_report(t):
    return m.class_report(labelled(t))


@query("ML-8", "SELECT label, " + ", ".join(f"count(CASE WHEN prediction = '{c}' THEN 1 END) AS \"{c}\"" for c in CATEGORIES) + " FROM v_labelled GROUP BY 1")
def confusion_matrix(t):
    return m.confusion_matrix(labelled(t), CATEGORIES)


@query("ML-9", "SELECT label, prediction, count(*) AS n FROM v_labelled WHERE label <> prediction GROUP BY 1, 2 ORDER BY n DESC, label, prediction LIMIT 10")
def error_patterns(t):
    return m.error_patterns(labelled(t))


@query("ML-9", "SELECT label, count(*) AS errors FROM v_labelled WHERE label <> prediction GROUP BY 1")
def errors_per_class(t):
    return m.errors_by_class(labelled(t))


# probabilities of four classes per labelled policy, from the client's scores
PROBABILITIES = {"INVESTMENT": "investment_score", "LIFE_INSURANCE": "life_insurance_score", "NETWORK_PRODUCTS": "network_products_score", "RETIREMENT": "retirement_score"}


def wide_probabilities(t):
    return labelled(t).join(t.scores, "party_id").select("policy_no", "label", *[F.col(v).alias(k) for k, v in PROBABILITIES.items()])


def probabilities(t):
    from nextcover.operators.quantiles import unpivoted

    return unpivoted(wide_probabilities(t), list(PROBABILITIES), ["policy_no", "label"], "class", "probability")


LONG = "(" + " UNION ALL ".join(
    f"SELECT l.policy_no, l.label, '{c}' AS class, s.{v} AS probability FROM v_labelled l JOIN v_scores s ON l.party_id = s.party_id" for c, v in PROBABILITIES.items()) + ")"
STEPS = ", ".join(f"(CAST({0.1 + 0.05 * i!r} AS DOUBLE))" for i in range(16))
THRESHOLDS = f"""(SELECT class, CASE WHEN f1 > 0 THEN t ELSE 0.5 END AS threshold, f1 FROM (
  SELECT class, t, coalesce(2.0 * count(CASE WHEN probability >= t AND label = class THEN 1 END) /
    NULLIF(count(CASE WHEN probability >= t THEN 1 END) + count(CASE WHEN label = class THEN 1 END), 0), 0) AS f1
  FROM {LONG} CROSS JOIN (VALUES {STEPS}) s(t) GROUP BY class, t)
  QUALIFY row_number() OVER (PARTITION BY class ORDER BY f1 DESC, t) = 1)"""


@query("ML-10", f"SELECT class, {rd('threshold')} AS threshold, {rd('f1')} AS f1 FROM {THRESHOLDS}")
def best_thresholds(t):
    return m.tune_thresholds(probabilities(t))


@query("ML-10", f"""
SELECT policy_no, class AS prediction FROM (SELECT l.policy_no, l.class, row_number() OVER (PARTITION BY l.policy_no
  ORDER BY CASE WHEN l.probability >= h.threshold THEN 0 ELSE 1 END, l.probability DESC, l.class) AS k FROM {LONG} l JOIN {THRESHOLDS} h ON l.class = h.class) WHERE k = 1""")
def predictions_by_threshold(t):
    fitted = m.tune_thresholds(probabilities(t))
    return m.apply_thresholds(wide_probabilities(t), {c: c for c in PROBABILITIES}, fitted).select("policy_no", "prediction")


@query("ML-11", f"SELECT class, support AS true_count, predicted AS predicted_count, {rd('(predicted - support) * 100.0 / NULLIF(support, 0)')} AS difference_pct FROM {REPORT}")
def predicted_against_true_counts(t):
    return m.distribution_shift(labelled(t))


@query("ML-12", """
SELECT a.label AS class, CAST(a.n AS BIGINT) AS baseline_n, CAST(b.n AS BIGINT) AS improved_n, CAST(coalesce(b.n, 0) - coalesce(a.n, 0) AS DOUBLE) AS n_change FROM
(SELECT label, count(*) AS n FROM v_labelled WHERE label = prediction GROUP BY 1) a FULL JOIN
(SELECT label, count(*) AS n FROM v_labelled WHERE label = 'LIFE_INSURANCE' GROUP BY 1) b ON a.label = b.label""")
def baseline_against_improved(t):
    """Correct predictions per class, against always predicting life insurance."""
    rows = labelled(t)
    base = rows.filter("label = prediction").groupBy(F.col("label").alias("class")).agg(F.count(F.lit(1)).alias("n"))
    other = rows.filter("label = 'LIFE_INSURANCE'").groupBy(F.col("label").alias("class")).agg(F.count(F.lit(1)).alias("n"))
    out = m.compare_runs(base, other, ["class"], ["n"])
    return out.withColumn("class", F.coalesce("class", F.lit("")))


@query("ML-13", """
SELECT CASE WHEN r > 5 THEN 'Severe Class Imbalance' ELSE 'Moderate Class Imbalance' END AS issue, CASE WHEN r > 5 THEN 'HIGH' ELSE 'MEDIUM' END AS severity,
  CASE WHEN r > 5 THEN 'Model may be biased toward majority class' ELSE 'Minority classes may have lower recall' END AS impact,
  CASE WHEN r > 5 THEN 'Use class weights, SMOTE, or stratified sampling' ELSE 'Consider class weights or balanced sampling' END AS recommendation
FROM (SELECT max(n) / min(n) AS r FROM (SELECT count(*) AS n FROM v_class3 GROUP BY product_category)) WHERE r > 2
UNION ALL SELECT 'High Missing Values in ' || CAST(k AS VARCHAR) || ' features', 'MEDIUM', 'May reduce model performance', 'Improve imputation strategy or feature engineering' FROM (
  SELECT CASE WHEN count(face_amt) < 0.95 * count(*) THEN 1 ELSE 0 END + CASE WHEN count(cash_val_amt) < 0.95 * count(*) THEN 1 ELSE 0 END
    + CASE WHEN count(policy_no) < 0.95 * count(*) THEN 1 ELSE 0 END AS k FROM v_class3) WHERE k > 0""")
def findings(t):
    rows = classify(t.policies)
    return m.findings(quality.class_distribution(rows, "product_category"), quality.missing_report(rows, ["face_amt", "cash_val_amt", "policy_no"]))


@query("SEQ-7 SEQ-8 ML-2 OUT-1", """
SELECT party_id, max(position) AS seq_length, CAST(1 AS BIGINT) AS known_product, CAST(1 AS BIGINT) AS probabilities_add_up FROM v_changes GROUP BY 1""")
def sequence_model_predictions(t):
    """A forest over the sliding examples of four fifths of the clients, applied to the last
    changes of every client."""
    from nextcover.plans import sequence_model as sm
    from workload.sequences import changes

    # one pass over the policies, whatever the fit and the scores read of it
    numbered = stored(t, changes(t).select("party_id", "position", "value", "id"), "changes")
    names = [r["value"] for r in sq.vocab_alpha(numbered).orderBy("id").collect()]  # the categories
    model = sm.fit_sequence_model(numbered, F.col("party_id").cast("long") % 5 != 0, numTrees=5, maxDepth=4)
    out = sm.score_sequences(model, numbered, names)
    total = sum(F.col(f"prob_{c}") for c in names[:model.stages[-1].numClasses])
    return out.select("party_id", "seq_length", F.col("predicted_product").isin(names).cast("int").alias("known_product"),
                      (F.abs(total - 1) < 1e-9).cast("int").alias("probabilities_add_up"))


EARLY = "register_date < DATE '2001-06-01'"
SINGLE = f"""(SELECT party_id, product_category AS first_product_category FROM v_class3 WHERE policy_status = 'Active' AND {EARLY}
  QUALIFY count(*) OVER (PARTITION BY party_id) = 1)"""


def run_of_last_month(t):
    """The run of 200111 over the policies known then; its table."""
    name, _ = fresh(t, "published")
    # the fit, the scores and the clients' attributes all read them
    policies = stored(t, monthly_run.classified(t.policies, "branch_name"), "classified")
    people = first_by(policies, ["party_id"], [F.col("register_date").desc(), F.col("policy_no").desc()]).select("party_id", "psn_age", "branch_name")
    monthly_run.run_month(policies.filter(EARLY), people, name, 200111, AS_OF, numTrees=3, maxDepth=3)
    return t.spark.table(name)


@query("OUT-4 OUT-5 OUT-7 PRE-1 PRE-3 PRE-4 ML-2 SNK-3", f"""
SELECT s.party_id, s.first_product_category, CAST(200111 AS BIGINT) AS prediction_month, '200111_' || s.party_id AS run_key, n.branch_name, CAST(1 AS BIGINT) AS known_product
FROM {SINGLE} s JOIN (SELECT DISTINCT party_id, branch_name FROM v_policies) n ON s.party_id = n.party_id""")
def monthly_run_published(t):
    """Population, fitted fill and codes, model, publication: one stored row per client and month."""
    out = run_of_last_month(t)
    return out.select("party_id", "first_product_category", "prediction_month", "run_key", "branch_name",
                      (F.col("predicted_product").isin(CATEGORIES) & F.col("pred_prob").between(0, 1)).cast("int").alias("known_product"))


@query("OUT-13 ML-2 SNK-3", f"""
SELECT party_id, first_product_category, actual_product_bought, CAST(200111 AS BIGINT) AS prediction_month, CAST(200112 AS BIGINT) AS actual_purchase_month FROM (
  SELECT s.*, coalesce((SELECT min(c.product_category) FROM v_class3 c WHERE c.party_id = s.party_id AND c.product_category <> s.first_product_category), 'UNKNOWN') AS actual_product_bought
  FROM {SINGLE} s WHERE s.party_id IN (SELECT party_id FROM v_class3 GROUP BY 1 HAVING count(DISTINCT product_category) >= 2))""")
def monthly_run_outcome(t):
    """What the run's clients hold a month later."""
    out = monthly_run.run_outcome(run_of_last_month(t), t.policies, 200112)
    return out.select("party_id", "first_product_category", "actual_product_bought", "prediction_month", "actual_purchase_month")
