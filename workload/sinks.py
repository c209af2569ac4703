"""Sinks: each query writes to the session's warehouse and returns what reading it back gives."""

import uuid

from pyspark.sql import functions as F

from nextcover.operators.clean import active
from nextcover.operators.prep import split
from nextcover.sources import readers, writers
from workload.registry import query, rounded


def fresh(t, name):
    """A table name, and a folder beside the tables, that no other run uses."""
    name = f"{name}_{uuid.uuid4().hex[:12]}"
    return name, f"{t.spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/{name}"


def stored(t, rows, name):
    """``rows`` as a table of its own, so that every later pass reads it and computes nothing again."""
    name, _ = fresh(t, name)
    writers.replace_table(rows, name)
    return readers.read_table(t.spark, name)


@query("SRC-1 SNK-1", "SELECT party_id, count(*) AS policies FROM v_policies WHERE policy_status = 'Active' GROUP BY 1")
def replaced_table(t):
    """All policies, replaced by the active ones."""
    name, _ = fresh(t, "replaced")
    rows = t.policies.select("party_id", "policy_no", "policy_status")
    writers.replace_table(rows, name)
    writers.replace_table(active(rows), name)
    return readers.read_table(t.spark, name).groupBy("party_id").agg(F.count(F.lit(1)).alias("policies"))


@query("SNK-2", """
SELECT branchoffice_code, count(*) AS policies, (ROUND(sum(CASE WHEN branchoffice_code = '3' THEN 2 ELSE 1 END * acct_val_amt), 2) + 0.0) AS amount
FROM v_policies WHERE branchoffice_code IS NOT NULL GROUP BY 1""")
def replaced_partition(t):
    """A table by branch, of which one branch is replaced."""
    name, _ = fresh(t, "partitioned")
    rows = t.policies.filter(F.col("branchoffice_code").isNotNull()).select("policy_no", F.col("acct_val_amt").cast("double").alias("acct_val_amt"), "branchoffice_code")
    writers.replace_table(rows, name, partition_by=["branchoffice_code"])
    writers.replace_table(rows.filter("branchoffice_code = '3'").withColumn("acct_val_amt", F.col("acct_val_amt") * 2), name, partition_by=["branchoffice_code"])
    return readers.read_table(t.spark, name).groupBy("branchoffice_code").agg(
        F.count(F.lit(1)).alias("policies"), rounded(F.sum("acct_val_amt"), 2).alias("amount"))


@query("SNK-4", """
SELECT party_id, count(*) AS policies, CAST(0 AS BIGINT) AS old_values, (ROUND(sum(face_amt), 2) + 0.0) AS face FROM v_policies GROUP BY 1""")
def replaced_with_new_columns(t):
    """A column that the new rows lack stays, as nulls; one that they bring is added."""
    name, _ = fresh(t, "merged")
    writers.replace_table(t.policies.select("party_id", "acct_val_amt"), name)
    writers.replace_table(t.policies.select("party_id", "face_amt"), name, merge_schema=True)
    return readers.read_table(t.spark, name).groupBy("party_id").agg(
        F.count(F.lit(1)).alias("policies"), F.count("acct_val_amt").alias("old_values"), rounded(F.sum("face_amt"), 2).alias("face"))


@query("SNK-3 OUT-5", "SELECT DISTINCT party_id || '_200112' AS run_key FROM v_policies WHERE party_id IS NOT NULL")
def appended_run(t):
    """A run of the active policies' clients, written again with all clients: one row per key."""
    name, _ = fresh(t, "runs")

    def keyed(df):
        return df.filter(F.col("party_id").isNotNull()).select(F.concat_ws("_", "party_id", F.lit("200112")).alias("run_key"))

    for rows in (active(t.policies), t.policies):
        writers.write_run(keyed(rows), name, "month", 200112, ["run_key"], [F.col("run_key")])
    return readers.read_table(t.spark, name).select("run_key")


@query("SNK-3", """
WITH newest AS (SELECT party_id, policy_no, acct_val_amt,
    row_number() OVER (PARTITION BY party_id ORDER BY register_date DESC, policy_no DESC) AS rn,
    row_number() OVER (PARTITION BY party_id ORDER BY register_date, policy_no) AS nr
  FROM v_policies WHERE party_id IS NOT NULL)
SELECT CAST(200111 AS BIGINT) AS month, party_id, policy_no, (ROUND(acct_val_amt, 2) + 0.0) AS amount FROM newest WHERE nr = 1
UNION ALL SELECT CAST(200112 AS BIGINT), party_id, policy_no, (ROUND(acct_val_amt * 2, 2) + 0.0) FROM newest WHERE rn = 1""")
def monthly_runs(t):
    """Two months with several rows per client, of which each keeps one by a stated order; the
    second month is written twice and has one copy."""
    name, _ = fresh(t, "monthly")
    rows = t.policies.filter(F.col("party_id").isNotNull()).select(
        "party_id", "policy_no", "register_date", F.col("acct_val_amt").cast("double").alias("amount"))
    oldest = [F.col("register_date").asc(), F.col("policy_no").asc()]
    newest = [F.col("register_date").desc(), F.col("policy_no").desc()]
    doubled = rows.withColumn("amount", F.col("amount") * 2)
    writers.write_run(rows, name, "month", 200111, ["party_id"], oldest)
    writers.write_run(rows, name, "month", 200112, ["party_id"], newest)
    writers.write_run(doubled, name, "month", 200112, ["party_id"], newest)
    return readers.read_table(t.spark, name).select("month", "party_id", "policy_no", rounded("amount", 2).alias("amount"))


@query("SNK-5 SRC-3", """
SELECT CASE WHEN CAST(policy_no AS BIGINT) % 10 < 8 THEN 'train' WHEN CAST(policy_no AS BIGINT) % 10 < 9 THEN 'validation' ELSE 'test' END AS part,
  count(*) AS policies, CAST(sum(CAST(policy_no AS BIGINT)) AS BIGINT) AS numbers FROM v_policies GROUP BY 1""")
def written_splits(t):
    _, path = fresh(t, "splits")
    parts = split(t.policies.select("policy_no"), {"train": 0.8, "validation": 0.1, "test": 0.1}, F.col("policy_no").cast("long") % 10 / 10)
    names = ["train", "validation", "test"]
    writers.write_splits({n: parts.filter(F.col("split") == n).drop("split") for n in names}, path)
    back = [readers.read_parquet(t.spark, f"{path}/{n}").withColumn("part", F.lit(n)) for n in names]
    return back[0].unionByName(back[1]).unionByName(back[2]).groupBy("part").agg(
        F.count(F.lit(1)).alias("policies"), F.sum(F.col("policy_no").cast("long")).alias("numbers"))


@query("SNK-8", """
SELECT channel AS product, CAST(200112 AS BIGINT) AS training_month, count(*) AS n_rows, (ROUND(avg(acct_val_amt), 2) + 0.0) AS mean FROM v_policies GROUP BY 1
UNION ALL SELECT channel, CAST(200111 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS DOUBLE) FROM v_policies GROUP BY 1""")
def model_metadata(t):
    """Metadata of two months, of which the newer one is written again."""
    name, _ = fresh(t, "metadata")
    rows = t.policies.groupBy(F.col("channel").alias("product")).agg(
        F.count(F.lit(1)).alias("n_rows"), rounded(F.avg("acct_val_amt"), 2).alias("mean"))
    blank = rows.withColumns({"n_rows": F.lit(0).cast("long"), "mean": F.lit(0.0)})
    writers.write_metadata(blank.withColumn("training_month", F.lit(200111)).unionByName(blank.withColumn("training_month", F.lit(200112))), name)
    writers.write_metadata(rows.withColumn("training_month", F.lit(200112)), name)
    return readers.read_table(t.spark, name).select("product", "training_month", "n_rows", "mean")


@query("SRC-4", """
SELECT policy_no, party_id, channel FROM v_policies WHERE CAST(policy_no AS BIGINT) % 10 <> 0""")
def tolerant_csv(t):
    """Policies as lines of text; every tenth has a field too many and is skipped."""
    _, path = fresh(t, "csv")
    extra = F.when(F.col("policy_no").cast("long") % 10 == 0, F.lit("surplus"))
    t.policies.select(F.concat_ws(",", "policy_no", "party_id", F.concat(F.lit('"'), F.col("channel"), F.lit('"')), extra).alias("value")).write.text(path)
    return readers.read_csv_tolerant(t.spark, path, "policy_no string, party_id string, channel string", header=False)
