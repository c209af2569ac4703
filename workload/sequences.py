"""Product sequences."""

from pyspark.sql import functions as F

from nextcover.functions.classify import CATEGORIES, classify
from nextcover.operators import sequences as sq
from nextcover.plans import sequence_scoring as plan
from nextcover.operators.prep import fit_encoder, fit_modes
from workload.registry import query
from workload.sqltext import rd
from workload.views import MONTH


def category_events(t):
    return classify(t.policies).select("party_id", "register_date", "policy_no", F.col("product_category").alias("value"))


def changes(t):
    """Numbered changes of category per client, with alphabetical ids."""
    rows = category_events(t)
    return sq.to_ids(sq.collapse_repeats(rows), sq.vocab_alpha(rows))


@query("SEQ-1", """
SELECT party_id, CAST(0 AS BIGINT) AS part, count(*) AS events, string_agg(product_category, ',' ORDER BY register_date, policy_no) AS sequence,
  string_agg(CAST(register_date AS VARCHAR), ',' ORDER BY register_date, policy_no) AS dates,
  string_agg(coalesce(CAST(CAST(round(acct_val_amt * 100) AS BIGINT) AS VARCHAR), 'null'), ',' ORDER BY register_date, policy_no) AS account_values,
  string_agg(coalesce(CAST(CAST(round(face_amt * 100) AS BIGINT) AS VARCHAR), 'null'), ',' ORDER BY register_date, policy_no) AS face_values
FROM v_class3 GROUP BY 1""")
def client_sequences(t):
    numbered = sq.events(classify(t.policies), numeric=["acct_val_amt", "face_amt"])
    def cents(place, name):
        return F.transform("vectors", lambda v: F.round(v[place] * 100).cast("long")).alias(name)

    return sq.client_sequences(numbered).select("party_id", "part", "events", "sequence", "dates", cents(0, "account_values"), cents(1, "face_values"))


@query("SEQ-1", """
SELECT party_id, (event_index - 1) // 4 AS part, count(*) AS events, string_agg(product_category, ',' ORDER BY event_index) AS sequence FROM v_ranked3 GROUP BY 1, 2""")
def client_sequences_in_parts(t):
    return sq.client_sequences(sq.events(classify(t.policies)), part_rows=4).select("party_id", "part", "events", "sequence")


@query("SEQ-2", "SELECT party_id, policy_no, value, position FROM v_changes")
def changes_of_category(t):
    return sq.collapse_repeats(category_events(t)).select("party_id", "policy_no", "value", "position")


@query("SEQ-2", "SELECT party_id, policy_no, value, position FROM v_changes")
def changes_with_every_client_hot(t):
    return sq.collapse_repeats(category_events(t), floor=2).select("party_id", "policy_no", "value", "position")


@query("SEQ-2", """
SELECT party_id, string_agg(value, ',' ORDER BY position) AS sequence FROM v_changes GROUP BY 1""")
def deduplicated_arrays(t):
    return sq.collapsed_sequences(sq.events(classify(t.policies))).select("party_id", "sequence")


@query("SEQ-2", """
SELECT party_id, (position - 1) // 4 AS part, string_agg(value, ',' ORDER BY position) AS sequence FROM v_changes GROUP BY 1, 2""")
def deduplicated_arrays_in_parts(t):
    return sq.collapsed_sequences(sq.events(classify(t.policies)), part_rows=4).select("party_id", "part", "sequence")


@query("SEQ-3", "SELECT party_id, position, value FROM v_changes QUALIFY count(*) OVER (PARTITION BY party_id) >= 8")
def long_enough_sequences(t):
    return sq.min_length(sq.collapse_repeats(category_events(t)), 8).select("party_id", "position", "value")


@query("SEQ-4", "SELECT value, row_number() OVER (ORDER BY value) AS id FROM (SELECT DISTINCT product_category AS value FROM v_class3)")
def alphabetical_vocabulary(t):
    return sq.vocab_alpha(category_events(t))


@query("SEQ-5 FN-15", """
SELECT product_category AS value, count(*) AS frequency, row_number() OVER (ORDER BY count(*) DESC, product_category) - 1 AS id FROM v_class3 GROUP BY 1""")
def frequency_vocabulary(t):
    return sq.vocab_freq(category_events(t))


@query("SEQ-6 SEQ-8", """
SELECT party_id, string_agg(CAST(id AS VARCHAR), ',' ORDER BY position) AS history, max(position) AS seq_length FROM (
  SELECT *, row_number() OVER (PARTITION BY party_id ORDER BY position DESC) AS back FROM v_changes) WHERE back <= 5 GROUP BY 1""")
def last_ids_of_each_client(t):
    return sq.scoring_history(changes(t), 5)


@query("SEQ-7", """
SELECT party_id, position, CAST(label AS BIGINT) AS label, array_to_string(h, ',') AS history FROM v_examples WHERE position > 1""")
def sliding_examples(t):
    return sq.sliding_examples(changes(t), 10)


@query("SEQ-7", """
SELECT party_id, position, id AS label, array_to_string(list(id) OVER (PARTITION BY party_id ORDER BY position ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), ',') AS history
FROM v_changes QUALIFY position > 1""")
def sliding_examples_in_small_chunks(t):
    """Histories across chunk borders: chunks of four positions."""
    from nextcover.operators.ordered import with_recent

    out = with_recent(changes(t), "party_id", "position", {"id": "history"}, 3, chunk_rows=4)
    return out.filter(F.size("history") > 0).select("party_id", "position", F.col("id").alias("label"), "history")


@query("SEQ-9", """
SELECT party_id, position, len(h) AS seq_len, h[-1] AS last_1, coalesce(h[-2], 0) AS last_2, len(list_distinct(h)) AS unique_prior, len(h) - 1 AS num_switches, """ + ", ".join(
    f"len(list_filter(h, lambda x: x = {i})) AS freq_{i}" for i in range(1, len(CATEGORIES) + 1)) + " FROM v_examples WHERE position > 1")
def history_features(t):
    out = sq.history_features(sq.sliding_examples(changes(t)), len(CATEGORIES))
    return out.select("party_id", "position", "seq_len", "last_1", "last_2", "unique_prior", "num_switches", *[f"freq_{i}" for i in range(1, len(CATEGORIES) + 1)])


@query("SEQ-10", f"""
SELECT party_id, position, coalesce(h[-3], 0) AS last_3, {rd('len(list_distinct(h)) / len(h)')} AS diversity_ratio, {rd('(len(h) - 1) / len(h)')} AS switch_ratio,
  {rd('list_sum(list_transform(h, lambda x, i: i * x))')} AS recency_weight, CASE WHEN len(h) >= 2 THEN h[-1] * 100 + h[-2] ELSE 0 END AS transition_pattern,
  h[list_position(list_transform(h, lambda x: len(list_filter(h, lambda y: y = x))), list_max(list_transform(h, lambda x: len(list_filter(h, lambda y: y = x)))))] AS most_freq_product
FROM v_examples WHERE position > 1""")
def extended_history_features(t):
    out = sq.history_features_ext(sq.sliding_examples(changes(t)))
    return out.select("party_id", "position", "last_3", "diversity_ratio", "switch_ratio", "recency_weight", "transition_pattern", "most_freq_product")


@query("SEQ-11", "SELECT party_id, position, " + ", ".join(f"CASE WHEN len(h) >= {10 - i} THEN h[len(h) - {9 - i}] ELSE 0 END AS hist_{i}" for i in range(10)) + " FROM v_examples WHERE position > 1")
def padded_history(t):
    return sq.pad_history(sq.sliding_examples(changes(t))).select("party_id", "position", *[f"hist_{i}" for i in range(10)])


TEXTS, NUMBERS = plan.SNAPSHOT_TEXTS, plan.SNAPSHOT_NUMBERS


def _filled(c):
    if c not in ("client_seg", "channel"):
        return f"n.{c}"
    return f"coalesce(n.{c}, (SELECT {c} FROM v_policies GROUP BY 1 ORDER BY count(*) DESC, {c} LIMIT 1))"


def _code(c):
    return (f"(SELECT k FROM (SELECT v, row_number() OVER (ORDER BY v) - 1 AS k FROM (SELECT DISTINCT coalesce({c}, 'UNKNOWN') AS v FROM v_policies)) "
            f"WHERE v = s.{c}) AS {c}_idx")


@query("SEQ-12", """
WITH act AS (SELECT *, lag(product_category) OVER (PARTITION BY party_id ORDER BY register_date, policy_no) AS before,
    row_number() OVER (PARTITION BY party_id ORDER BY register_date DESC, policy_no DESC) AS newest FROM v_class3 WHERE policy_status = 'Active'),
ids AS (SELECT value, row_number() OVER (ORDER BY value) AS id FROM (SELECT DISTINCT product_category AS value FROM v_class3)),
ch AS (SELECT a.party_id, i.id, row_number() OVER (PARTITION BY party_id ORDER BY register_date, policy_no) AS position,
    row_number() OVER (PARTITION BY party_id ORDER BY register_date DESC, policy_no DESC) AS back
  FROM act a JOIN ids i ON a.product_category = i.value WHERE before IS NULL OR before <> product_category),
hist AS (SELECT party_id, list(id ORDER BY position) AS h, max(position) AS seq_length FROM ch WHERE back <= 10 GROUP BY 1),
s AS (SELECT x.*, """ + ", ".join(f"CAST(coalesce(n.{c}, 0) AS DOUBLE) AS {c}" for c in NUMBERS if c != "psn_age") + ", CAST(coalesce(n.psn_age, 0) AS BIGINT) AS psn_age, "
       + ", ".join(f"{_filled(c)} AS {c}" for c in TEXTS) + """ FROM hist x LEFT JOIN (SELECT * FROM act WHERE newest = 1) n ON x.party_id = n.party_id)
SELECT party_id, seq_length, len(h) AS seq_len, h[-1] AS last_1, coalesce(h[-2], 0) AS last_2, len(list_distinct(h)) AS unique_prior, len(h) - 1 AS num_switches, """ + ", ".join(
    f"len(list_filter(h, lambda x: x = {i})) AS freq_{i}" for i in range(1, len(CATEGORIES) + 1)) + ", " + ", ".join(
    rd(c) + f" AS {c}" if c != "psn_age" else c for c in NUMBERS) + ", " + ", ".join(TEXTS) + ", " + ", ".join(
    f"CASE WHEN len(h) >= {10 - i} THEN h[len(h) - {9 - i}] ELSE 0 END AS hist_{i}" for i in range(10)) + ", " + ", ".join(_code(c) for c in TEXTS) + " FROM s")
def scoring_input(t):
    """Vocabulary, modes and codes fitted on all policies, applied to the active ones."""
    rows = category_events(t)
    modes = fit_modes(t.policies, ["client_seg", "channel"])
    encoder = fit_encoder(t.policies, plan.SNAPSHOT_TEXTS)
    return plan.prepare_scoring(t.policies, sq.vocab_alpha(rows), modes, encoder, MONTH)
