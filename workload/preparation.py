"""Model preparation."""

from pyspark.sql import functions as F

from nextcover.functions.classify import CATEGORIES, classify
from nextcover.operators import features as fe, prep
from nextcover.operators.quantiles import exact_quantiles
from workload.feature_sets import first_second_rows, training
from workload.registry import query, rounded
from workload.sinks import stored
from workload.sqltext import rd
from workload.views import AS_OF

NUMBERS = ["face_amt", "cash_val_amt", "wc_assetmix_annuity"]


def is_train(c="policy_no"):
    return F.col(c).cast("long") % 5 != 0


def bought(t):
    return first_second_rows(t, "agt_no").filter(F.col("second_product_category").isNotNull())


TRAIN = "CAST(policy_no AS BIGINT) % 5 <> 0"


@query("PRE-1", "SELECT policy_no, " + ", ".join(
    f"{rd(f'coalesce({c}, (SELECT median({c}) FROM v_policies WHERE {TRAIN}))')} AS {c}" for c in NUMBERS) + " FROM v_policies")
def median_imputation(t):
    medians = prep.fit_medians(t.policies.filter(is_train()), NUMBERS)
    return prep.apply_fill(t.policies, medians).select("policy_no", *NUMBERS)


@query("PRE-1")
def approximate_medians(t):
    return prep.fit_medians(t.policies, NUMBERS, exact=False)


@query("PRE-1", f"""
SELECT product_category, {rd('0.1')} AS p, {rd('quantile_cont(face_amt, 0.1)', 4)} AS quantile FROM v_class3 GROUP BY 1
UNION ALL SELECT product_category, {rd('0.5')}, {rd('quantile_cont(face_amt, 0.5)', 4)} FROM v_class3 GROUP BY 1
UNION ALL SELECT product_category, {rd('0.99')}, {rd('quantile_cont(face_amt, 0.99)', 4)} FROM v_class3 GROUP BY 1""")
def quantiles_per_category(t):
    rows = classify(t.policies).filter(F.col("face_amt").isNotNull()).select("product_category", "face_amt")
    out = exact_quantiles(rows, ["product_category"], "face_amt", [0.1, 0.5, 0.99])
    return out.withColumn("quantile", rounded("quantile", 4))


@query("PRE-2", "SELECT policy_no, " + ", ".join(f"{rd(f'coalesce({c}, 0)')} AS {c}" for c in NUMBERS) + " FROM v_policies")
def zero_imputation(t):
    return prep.fill_zero(t.policies.select("policy_no", *NUMBERS))


@query("PRE-3", f"""
SELECT policy_no, coalesce(client_seg, (SELECT client_seg FROM v_policies WHERE {TRAIN} GROUP BY 1 ORDER BY count(*) DESC, client_seg LIMIT 1)) AS client_seg,
  coalesce(sub_product_level_2, 'UNKNOWN') AS sub_product_level_2 FROM v_policies""")
def mode_imputation(t):
    modes = prep.fit_modes(t.policies.filter(is_train()), ["client_seg", "sub_product_level_2"])
    return prep.apply_fill(t.policies, modes).select("policy_no", "client_seg", "sub_product_level_2")


def _code(c):
    return (f"coalesce((SELECT k FROM (SELECT v, row_number() OVER (ORDER BY v) - 1 AS k FROM (SELECT DISTINCT coalesce({c}, 'UNKNOWN') AS v FROM v_policies "
            f"WHERE branchoffice_code <> '3')) WHERE v = coalesce(p.{c}, 'UNKNOWN')), -1)")


@query("PRE-4", f"SELECT policy_no, {_code('client_seg')} AS client_seg_idx, {_code('branchoffice_code')} AS branchoffice_code_idx FROM v_policies p")
def ordinal_codes(t):
    """Fitted without branch 3, whose code is unknown afterwards."""
    columns = ["client_seg", "branchoffice_code"]
    encoder = prep.fit_encoder(t.policies.filter("branchoffice_code <> '3'"), columns)
    return prep.encode(t.policies, encoder, columns).select("policy_no", "client_seg_idx", "branchoffice_code_idx")


@query("PRE-5", "SELECT product_category, row_number() OVER (ORDER BY product_category) - 1 AS label FROM (SELECT DISTINCT product_category FROM v_class3)")
def label_codes(t):
    return prep.label_index(classify(t.policies), "product_category")


@query("PRE-6", """
SELECT client_seg, CAST(CASE WHEN client_seg IS NULL THEN count(*) OVER () - 1 ELSE row_number() OVER (ORDER BY CASE WHEN client_seg IS NULL THEN 1 ELSE 0 END, n DESC, client_seg) - 1 END AS DOUBLE) AS client_seg_idx, n
FROM (SELECT client_seg, count(*) AS n FROM v_policies GROUP BY 1)""")
def frequency_ordered_index(t):
    rows = classify(t.policies)
    pipeline, _ = prep.string_index(["client_seg"], "product_category")
    out = pipeline.fit(rows).transform(rows)
    return out.groupBy("client_seg", "client_seg_idx").agg(F.count(F.lit(1)).alias("n"))


@query("PRE-7", """
SELECT policy_no, CAST(2 AS BIGINT) AS size, (ROUND(acct_val_amt, 6) + 0.0) AS first_value FROM v_policies""")
def assembled_vectors(t):
    from pyspark.ml.functions import vector_to_array

    out = prep.assemble(["acct_val_amt", "psn_age"]).transform(t.policies).withColumn("v", vector_to_array("features"))
    return out.select("policy_no", F.size("v").alias("size"), F.col("v")[0].alias("first_value"))


@query("PRE-8")
def client_clusters(t):
    rows = fe.allocation_ratios(fe.ages(t.policies, AS_OF))
    columns = ["wc_total_assets", "age_at_first_policy", "stock_allocation_ratio", "acct_val_amt"]
    train, val = prep.client_clusters(rows.filter(is_train()), rows.filter(~is_train()), columns)
    return train.unionByName(val).groupBy("client_cluster").agg(F.count(F.lit(1)).alias("n"))


ENCODED = ["LIFE_INSURANCE", "RETIREMENT"]


def _te(column):
    parts = ", ".join(
        f"{rd(f'(coalesce(a.h{i}, 0) - coalesce(b.h{i}, 0) + g.m{i} * 50) / (coalesce(a.n, 0) - coalesce(b.n, 0) + 50)')} AS te_{column}_{c}" for i, c in enumerate(ENCODED))
    sums = "count(*) AS n, " + ", ".join(f"count(CASE WHEN second_product_category = '{c}' THEN 1 END) AS h{i}" for i, c in enumerate(ENCODED))
    means = ", ".join(f"avg(CASE WHEN second_product_category = '{c}' THEN 1.0 ELSE 0.0 END) AS m{i}" for i, c in enumerate(ENCODED))
    return f"""
WITH tr AS (SELECT *, CAST(second_policy_no AS BIGINT) % 5 AS fold FROM v_bought WHERE {TRAIN})
SELECT p.party_id, {parts} FROM (SELECT *, CASE WHEN {TRAIN} THEN CAST(second_policy_no AS BIGINT) % 5 ELSE -1 END AS fold FROM v_bought) p
CROSS JOIN (SELECT {means} FROM tr) g
LEFT JOIN (SELECT {column}, {sums} FROM tr GROUP BY 1) a ON p.{column} = a.{column}
LEFT JOIN (SELECT {column}, fold, {sums} FROM tr GROUP BY 1, 2) b ON p.{column} = b.{column} AND p.fold = b.fold"""


@query("PRE-9", _te("agt_no"))
def target_encoding(t):
    rows = bought(t)
    train, val = prep.target_encode(
        rows.filter(is_train()), rows.filter(~is_train()), ["agt_no"], "second_product_category", ENCODED,
        fold=F.col("second_policy_no").cast("long") % 5)
    return train.unionByName(val).select("party_id", *[f"te_agt_no_{c}" for c in ENCODED])


COUNTS = """(SELECT product_category, count(*) AS n, sum(count(*)) OVER () / (count(*) OVER () * count(*)) AS w FROM v_class3 GROUP BY 1)"""


@query("PRE-10", f"SELECT product_category, n, {rd('w')} AS weight FROM {COUNTS}")
def balanced_weights(t):
    return prep.class_weights(classify(t.policies), "product_category")


@query("PRE-11", f"SELECT product_category, n, {rd('least(greatest(sqrt(w), 0.5), 10)')} AS weight FROM {COUNTS}")
def capped_root_weights(t):
    return prep.class_weights(classify(t.policies), "product_category", "sqrt_cap")


@query("PRE-12", f"SELECT product_category, n, {rd('sqrt(w) * avg(w) OVER () / avg(sqrt(w)) OVER ()')} AS weight FROM {COUNTS}")
def mean_root_weights(t):
    return prep.class_weights(classify(t.policies), "product_category", "sqrt_mean")


@query("PRE-13", f"SELECT p.policy_no, {rd('c.w')} AS weight FROM v_class3 p JOIN {COUNTS} c ON p.product_category = c.product_category")
def rows_with_weight(t):
    rows = classify(t.policies)
    return prep.with_weight(rows, prep.class_weights(rows, "product_category"), "product_category").select("policy_no", "weight")


@query("PRE-14", """
SELECT policy_no, CASE WHEN CAST(policy_no AS BIGINT) % 10 < 8 THEN 'train' WHEN CAST(policy_no AS BIGINT) % 10 < 9 THEN 'validation' ELSE 'test' END AS split FROM v_policies""")
def three_way_split(t):
    position = (F.col("policy_no").cast("long") % 10) / 10
    return prep.split(t.policies, {"train": 0.8, "validation": 0.1, "test": 0.1}, position).select("policy_no", "split")


@query("PRE-14")
def hashed_split(t):
    out = prep.split(t.policies, {"train": 0.8, "validation": 0.2}, prep.stable_fraction("party_id"))
    return out.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("party_id").alias("parties"))


@query("PRE-15", """
SELECT policy_no, product_category, CASE WHEN (row_number() OVER (PARTITION BY product_category ORDER BY CAST(policy_no AS BIGINT)) - 1) / count(*) OVER (PARTITION BY product_category) < CAST(0.8 AS DOUBLE)
  THEN 'train' ELSE 'validation' END AS split FROM v_class3""")
def stratified_split(t):
    rows = classify(t.policies).withColumn("_key", F.col("policy_no").cast("long"))
    out = prep.split_stratified(rows, "product_category", order=["_key"])
    return out.select("policy_no", "product_category", "split")


@query("PRE-15", f"""
SELECT product_category, CAST(ceil(count(*) * CAST(0.8 AS DOUBLE)) AS BIGINT) AS train_rows, count(*) - CAST(ceil(count(*) * CAST(0.8 AS DOUBLE)) AS BIGINT) AS validation_rows FROM v_class3 GROUP BY 1""")
def stratified_split_by_hash(t):
    out = prep.split_stratified(classify(t.policies), "product_category", key=["policy_no"])
    train = F.sum((F.col("split") == "train").cast("long"))
    return out.groupBy("product_category").agg(train.alias("train_rows"), (F.count(F.lit(1)) - train).alias("validation_rows"))


@query("PRE-16")
def capped_sample(t):
    return prep.sample_capped(t.policies, 1000, ["party_id", "policy_no"]).select("party_id", "policy_no")


@query("PRE-17", """
WITH c AS (SELECT product_category, count(*) AS n FROM v_class3 GROUP BY 1), m AS (SELECT max(n) AS x FROM c)
SELECT product_category, CASE WHEN n < x * CAST(0.1 AS DOUBLE) THEN CAST(floor(x * CAST(0.15 AS DOUBLE)) AS BIGINT) ELSE n END AS rows, n AS originals FROM c CROSS JOIN m""")
def oversampled_classes(t):
    rows = prep.oversample(classify(t.policies), "product_category", ["register_date", "policy_no"])
    return rows.groupBy("product_category").agg(
        F.count(F.lit(1)).alias("rows"), F.sum((F.col("copy_no") == 1).cast("long")).alias("originals"))


@query("PRE-17", """
WITH c AS (SELECT product_category, count(*) AS n FROM v_class3 GROUP BY 1), m AS (SELECT max(n) AS x FROM c)
SELECT product_category, CAST(floor(x * CAST(0.15 AS DOUBLE)) AS BIGINT) - n AS new_rows, CAST(1 AS BIGINT) AS on_segment
FROM c CROSS JOIN m WHERE n < x * CAST(0.1 AS DOUBLE)""")
def interpolated_classes(t):
    """New rows of rare classes; whether each lies between two rows of its class, as far along in
    every feature as its weight says."""
    rows, features = classify(t.policies), ["acct_val_amt", "psn_age", "wc_total_assets"]
    made = prep.interpolate_minority(rows, "product_category", features, ["policy_no"])
    known = rows.select("policy_no", "product_category", *[F.col(f).cast("double").alias(f) for f in features])
    a = known.select("policy_no", *[F.col(f).alias(f"a_{f}") for f in features])
    b = known.select(F.col("policy_no").alias("neighbour_policy_no"), F.col("product_category").alias("b_category"), *[F.col(f).alias(f"b_{f}") for f in features])
    on = F.col("weight").between(0, 1) & (F.col("b_category") == F.col("product_category")) & (F.col("policy_no") != F.col("neighbour_policy_no"))
    for f in features:
        on = on & (F.abs(F.col(f"a_{f}") + F.col("weight") * (F.col(f"b_{f}") - F.col(f"a_{f}")) - F.col(f)) < 1e-6)
    return made.join(a, "policy_no").join(b, "neighbour_policy_no").groupBy("product_category").agg(
        F.count(F.lit(1)).alias("new_rows"), F.min(on.cast("int")).alias("on_segment"))


@query("PRE-8", "SELECT party_id, policy_no, CAST(1 AS BIGINT) AS in_range FROM v_policies")
def clustered_rows(t):
    """Every row has one of the clusters that were fitted on the training rows."""
    rows = fe.allocation_ratios(fe.ages(t.policies, AS_OF))
    columns = ["wc_total_assets", "age_at_first_policy", "stock_allocation_ratio", "acct_val_amt"]
    train, val = prep.client_clusters(rows.filter(is_train()), rows.filter(~is_train()), columns)
    inside = F.col("client_cluster").between(0, 7)
    return train.unionByName(val).select("party_id", "policy_no", F.coalesce(inside, F.lit(False)).cast("int").alias("in_range"))


@query("PRE-16", "SELECT count(*) AS all_rows, CAST(1 AS BIGINT) AS subset, CAST(1 AS BIGINT) AS near_wanted, CAST(1 AS BIGINT) AS same_again FROM v_policies")
def sample_properties(t):
    """A sample of a tenth: rows of the input, within a fifth of the size asked for, the same again
    when the input is dealt out differently."""
    key = ["party_id", "policy_no"]
    rows = t.policies.select(*key)
    n = rows.count()
    one, two = prep.sample_capped(rows, n // 10, key), prep.sample_capped(rows.repartition(13), n // 10, key)
    marked = rows.join(one.withColumn("a", F.lit(1)), key, "full").join(two.withColumn("b", F.lit(1)), key, "full")
    size = F.count("a")
    return marked.agg(
        F.count(F.lit(1)).alias("all_rows"), F.min(F.coalesce((F.col("party_id").isNotNull()).cast("int"), F.lit(0))).alias("subset"),
        (F.abs(size - n / 10) < n / 50).cast("int").alias("near_wanted"), F.min(F.col("a").eqNullSafe(F.col("b")).cast("int")).alias("same_again"))


CANDIDATES = ["acct_val_amt", "face_amt", "wc_total_assets", "client_age", "psn_age", "aggressive_investor", "snp_close_variation"]


def _domain(c):
    return prep.domain_score(c)


@query("PRE-18 PRJ-3", " UNION ALL ".join(
    f"SELECT '{c}' AS feature, {rd(f'abs(corr(CAST({c} AS DOUBLE), y))', 5)} AS correlation, CASE WHEN corr(CAST({c} AS DOUBLE), y) > 0 THEN 'positive' ELSE 'negative' END AS direction, "
    f"CAST({_domain(c)} AS DOUBLE) AS domain_score, {rd(f'0.7 * abs(corr(CAST({c} AS DOUBLE), y)) + 0.3 * {_domain(c)}', 5)} AS combined_score FROM "
    "(SELECT *, CASE WHEN cross_sell_product_category = 'INVESTMENT' THEN 1.0 ELSE 0.0 END AS y FROM v_training)" for c in CANDIDATES))
def scored_features(t):
    out = prep.select_features(training(t), "investment_cross_sell", CANDIDATES, min_features=3)
    return out.select("feature", rounded("correlation", 5).alias("correlation"), "direction", "domain_score", rounded("combined_score", 5).alias("combined_score"))


@query("PRE-18")
def selected_features(t):
    table = training(t)
    from nextcover.operators.clean import exclude_leakage
    from nextcover.operators.features import LABEL_FEATURES

    safe = [c for c in exclude_leakage(table.columns, LABEL_FEATURES) if c in set(prep.numeric_columns(table)) | {"channel", "aum_segment"}]
    # codes and correlations both read it; of stored codes Spark knows that they are few, and doesn't shuffle the rows
    rows = stored(t, table.select(*safe, "investment_cross_sell"), "training")
    codes = stored(t, prep.fit_encoder(rows, [c for c in ("channel", "aum_segment") if c in safe]), "codes")
    return prep.select_features(rows, "investment_cross_sell", safe, codes)


TARGETS = [f"{c.lower()}_cross_sell" for c in CATEGORIES[:-1]]


@query("PRE-19", " UNION ALL ".join(
    f"SELECT count(*) AS total, '{t}' AS target, count(CASE WHEN cross_sell_product_category = '{c}' THEN 1 END) AS positives, "
    f"{rd(f'''avg(CASE WHEN cross_sell_product_category = '{c}' THEN 1.0 ELSE 0.0 END)''')} AS share, CAST(1 AS BIGINT) AS trainable FROM v_training"
    for t, c in zip(TARGETS, CATEGORIES)))
def target_balance(t):
    return prep.target_balance(training(t), TARGETS)


@query("PRE-20", """
SELECT policy_no, coalesce(client_seg, 'Missing') AS client_seg, k AS client_seg_code FROM v_policies p JOIN (
  SELECT v, row_number() OVER (ORDER BY v) - 1 AS k FROM (SELECT DISTINCT coalesce(client_seg, 'Missing') AS v FROM v_policies)) c ON coalesce(p.client_seg, 'Missing') = c.v""")
def constant_fill_and_codes(t):
    filled = prep.fill_constant(t.policies, ["client_seg"])
    return prep.encode(filled, prep.fit_encoder(filled, ["client_seg"]), ["client_seg"], suffix="_code").select("policy_no", "client_seg", "client_seg_code")


@query("SET-4 SNK-8", """
SELECT DISTINCT feature FROM (SELECT party_id, product, feature, row_number() OVER (PARTITION BY product, party_id ORDER BY abs(contribution) DESC, feature) AS r FROM v_contributions) WHERE r <= 2""")
def features_of_all_models(t):
    """Feature lists stand in for model metadata: the two strongest features of every client."""
    from nextcover.operators.explain import top_contributions

    lists = top_contributions(t.contributions, 2).groupBy("product", "party_id").agg(F.collect_list("feature").alias("features"))
    return prep.all_features(lists)
