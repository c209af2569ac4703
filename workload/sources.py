"""Reads, month scopes and idempotent appends."""

from pyspark.sql import functions as F

from nextcover.operators import policies as pol
from nextcover.functions.classify import classify
from nextcover.operators.clean import active, in_branch, valid_events
from nextcover.schemas import require_columns
from nextcover.session import checkpointed
from nextcover.sources import readers, writers
from workload.registry import query, rounded
from workload.sinks import fresh


@query("SRC-3 TOP-4", """
SELECT o_orderkey AS policy_no, o_custkey AS party_id, o_totalprice AS amount FROM orders
ORDER BY o_orderkey LIMIT 100""")
def read_parquet_preview(t):
    orders = t.raw("orders").select(
        F.col("o_orderkey").alias("policy_no"), F.col("o_custkey").alias("party_id"), F.col("o_totalprice").alias("amount"))
    return orders.orderBy("policy_no").limit(100)


@query("SRC-2", """
SELECT party_id, count(*) AS policies, (ROUND(sum(acct_val_amt), 2) + 0.0) AS amount
FROM v_policies WHERE register_date >= DATE '1999-01-01' GROUP BY party_id""")
def parameterised_sql(t):
    return readers.read_sql(
        t.spark,
        "SELECT party_id, count(*) AS policies, round(sum(acct_val_amt), 2) AS amount FROM {policies} "
        "WHERE register_date >= CAST(:first_day AS DATE) GROUP BY party_id",
        args={"first_day": "1999-01-01"}, policies=t.policies)


@query("SRC-5", """
SELECT party_id, CAST(business_month AS BIGINT) AS business_month, (ROUND(aum_sum, 2) + 0.0) AS aum_sum FROM v_retention
WHERE business_month = (SELECT max(business_month) FROM v_retention)""")
def latest_snapshot(t):
    return readers.latest_month(t.retention).select("party_id", "business_month", rounded("aum_sum", 2).alias("aum_sum"))


@query("SRC-6", """
SELECT agent_code, CAST(yearmo AS BIGINT) AS yearmo, rank_desc FROM v_agents_report
WHERE rank_desc = 'R1' AND yearmo = (SELECT max(yearmo) FROM v_agents_report WHERE rank_desc = 'R1')""")
def latest_snapshot_within(t):
    return readers.latest_month(t.agents, "yearmo", F.col("rank_desc") == "R1").select("agent_code", "yearmo", "rank_desc")


@query("SRC-7", """
SELECT agent_code, count(*) AS months, CAST(max(yearmo) AS BIGINT) AS newest FROM v_agents_report
WHERE yearmo <= 200111 GROUP BY agent_code""")
def history_up_to_month(t):
    kept = readers.up_to_month(t.agents, 200111, "yearmo")
    return kept.groupBy("agent_code").agg(F.count(F.lit(1)).alias("months"), F.max("yearmo").alias("newest"))


@query("SRC-8", "SELECT policy_no, party_id, channel FROM v_policies")
def select_present_columns(t):
    return readers.select_present(t.policies, ["policy_no", "no_such_column", "party_id", "channel"])


@query("SNK-3", """
SELECT party_id || '_200112' AS run_key, party_id, policy_no FROM v_policies
WHERE policy_status <> 'Active' AND (party_id || '_200112') NOT IN (
  SELECT party_id || '_200112' FROM v_policies WHERE policy_status = 'Active' AND branchoffice_code = '3')""")
def append_only_unseen_keys(t):
    def keyed(df):
        return df.select(F.concat_ws("_", "party_id", "business_month").alias("run_key"), "party_id", "policy_no")

    stored = keyed(in_branch(active(t.policies), "3"))
    return writers.unseen_rows(keyed(t.policies.filter("policy_status <> 'Active'")), stored, ["run_key"])


@query("SNK-6", "SELECT branch_name, count(*) AS policies FROM v_policies GROUP BY branch_name")
def temporary_view(t):
    writers.as_view(t.policies, "policies_for_branches")
    return t.spark.sql("SELECT branch_name, count(*) AS policies FROM policies_for_branches GROUP BY branch_name")


@query("SNK-7", """
SELECT c.party_id, CAST(NULL AS BIGINT) AS business_month, c.client_segment FROM v_retention c
WHERE c.business_month = 200112""")
def fallback_for_missing_table(t):
    missing = readers.read_or_empty(t.spark, "table_that_is_not_there", "party_id string, business_month int")
    clients = readers.latest_month(t.retention).select("party_id", "client_segment")
    return clients.join(missing, "party_id", "left")


@query("AGG-39", """
SELECT CAST(1 AS BIGINT) AS stage_no, 'extracted' AS stage, (SELECT count(*) FROM v_class3) AS rows
UNION ALL SELECT CAST(2 AS BIGINT), 'valid', (SELECT count(*) FROM v_class3 WHERE party_id IS NOT NULL AND register_date IS NOT NULL AND product_category IS NOT NULL)
UNION ALL SELECT CAST(3 AS BIGINT), 'active', (SELECT count(*) FROM v_class3 WHERE policy_status = 'Active')
UNION ALL SELECT CAST(4 AS BIGINT), 'multi policy clients', (SELECT count(*) FROM (SELECT party_id FROM v_class3 WHERE policy_status = 'Active' GROUP BY party_id HAVING count(*) >= 2))""")
def rows_per_stage(t):
    classified = classify(t.policies)
    valid = valid_events(classified)
    return writers.stage_counts({
        "extracted": classified, "valid": valid, "active": active(valid),
        "multi policy clients": pol.multi_policy_clients(active(valid))})




REGIONS = [("Branch Assist", 1, None), ("Advisor Assist/Retail", 2, 0.5), ("Direct", 3, 1.0)]


@query("SRC-9", """
SELECT c.channel, c.priority, c.weight, count(*) AS policies FROM v_policies p
JOIN (VALUES ('Branch Assist', CAST(1 AS BIGINT), CAST(NULL AS DOUBLE)), ('Advisor Assist/Retail', 2, 0.5), ('Direct', 3, 1.0)) c(channel, priority, weight) ON p.channel = c.channel GROUP BY 1, 2, 3""")
def rows_from_memory(t):
    """A small table given in code, with its declared types, joined to the policies."""
    given = readers.rows_df(t.spark, REGIONS, "channel string, priority int, weight double")
    return t.policies.join(given, "channel").groupBy("channel", "priority", "weight").agg(F.count(F.lit(1)).alias("policies"))


@query("PRJ-6", "SELECT party_id, policy_no, register_date, CAST(NULL AS VARCHAR) AS missing FROM (SELECT party_id, policy_no, CAST(register_date AS VARCHAR) AS register_date FROM v_policies) UNION ALL SELECT NULL, NULL, NULL, 'missing columns: premium, rider'")
def required_columns(t):
    """Columns that are required and there, and the message about those that aren't."""
    wanted = ["party_id", "policy_no", "register_date"]
    rows = require_columns(t.policies, wanted).select(*wanted, F.lit(None).cast("string").alias("missing"))
    try:
        require_columns(t.policies, ["party_id", "premium", "rider"])
        said = None
    except ValueError as e:
        said = str(e)
    return rows.unionByName(t.spark.createDataFrame([(None, None, None, said)], rows.schema))


@query("SNK-9", """
SELECT party_id, policies, amount, CAST(CASE WHEN amount * count(*) OVER () > sum(amount) OVER () THEN 1 ELSE 0 END AS BIGINT) AS above_mean FROM (
  SELECT party_id, count(*) AS policies, (ROUND(sum(acct_val_amt), 2) + 0.0) AS amount FROM v_policies GROUP BY 1)""")
def materialised_totals(t):
    """Totals per client, written once to the checkpoint folder and used twice."""
    context = t.spark.sparkContext
    if context.getCheckpointDir() is None and t.spark.conf.get("spark.checkpoint.dir", None) is None:
        context.setCheckpointDir(f"{t.spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/checkpoints")  # shared, as the tables are
    totals = checkpointed(t.policies.groupBy("party_id").agg(F.count(F.lit(1)).alias("policies"), rounded(F.sum("acct_val_amt"), 2).alias("amount")))
    mean = totals.agg(F.avg("amount")).scalar()
    return totals.withColumn("above_mean", (F.col("amount") > mean).cast("int"))


@query("SRC-5 SRC-6", """
SELECT party_id, CAST(business_month AS BIGINT) AS business_month, (ROUND(aum_sum, 2) + 0.0) AS aum_sum FROM v_retention
WHERE business_month = (SELECT max(business_month) FROM v_retention)""")
def latest_stored_month(t):
    """The newest month of a table stored by month: its partition alone is read."""
    name, _ = fresh(t, "by_month")
    writers.replace_table(t.retention.select("party_id", "aum_sum", "business_month"), name, partition_by=["business_month"])
    return readers.latest_partition(t.spark, name).select("party_id", "business_month", rounded("aum_sum", 2).alias("aum_sum"))
