"""The driver's tables bound to the engine's input schemas. The same SQL text runs in Spark
and in DuckDB."""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from nextcover.sources.readers import read_parquet, read_sql
from workload import sqltext

AS_OF = "2002-01-01"
ACTIVITY_AS_OF = "2024-01-31"
MONTH = 200112
CLIENTS_PER_TASK = 20_000

BIRTH = (
    "CAST(CONCAT(CAST(1930 + c_custkey % 55 AS VARCHAR(20)), '-0', "
    "CAST(1 + c_custkey % 9 AS VARCHAR(20)), '-15') AS DATE)"
)

# view -> (tables, text)
BASE = {
    "v_policies": (["orders", "customer"], f"""
SELECT
  CAST(c_custkey AS VARCHAR(20)) AS party_id,
  CAST(o_orderkey AS VARCHAR(20)) AS policy_no,
  CASE o_orderkey % 2 WHEN 0 THEN 'sysa' ELSE 'SYSB' END AS source_sys_id,
  CONCAT('00', CAST(o_orderkey % 30 AS VARCHAR(20))) AS plan_code,
  CONCAT('0', CAST(o_orderkey % 4 AS VARCHAR(20))) AS plan_subcd_code,
  CASE WHEN o_orderkey % 5 = 0 THEN NULL
       WHEN o_orderpriority = '1-URGENT' THEN 'LIFE'
       WHEN o_orderpriority = '2-HIGH' THEN 'GROUP RETIREMENT'
       WHEN o_orderpriority = '3-MEDIUM' THEN 'BROKER DEALER'
       WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 'NETWORK'
       ELSE 'OTHERS' END AS prod_lob,
  CASE o_orderkey % 7 WHEN 0 THEN 'TERM' WHEN 1 THEN 'EQUIVEST'
       WHEN 2 THEN 'BROKERAGE' WHEN 3 THEN 'HAS' WHEN 4 THEN 'WL'
       WHEN 5 THEN NULL ELSE 'OTHERS' END AS sub_product_level_1,
  CASE o_orderkey % 6 WHEN 0 THEN 'TERM PRODUCT' WHEN 1 THEN 'EQUIVEST 403B/457'
       WHEN 2 THEN 'Brokerage Account' WHEN 3 THEN 'HAS - DISABILITY'
       WHEN 4 THEN 'INDEX UNIVERSAL LIFE' ELSE NULL END AS sub_product_level_2,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'LIFE' ELSE 'OTHER LINE' END AS wti_lob_txt,
  CAST(o_orderdate AS DATE) AS register_date,
  CASE WHEN o_orderstatus = 'P' THEN DATE '2001-12-31' ELSE NULL END AS trmn_eff_date,
  CAST(o_orderdate AS DATE) AS strt_date,
  CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE DATE '2030-12-31' END AS end_date,
  {BIRTH} AS birth_dt,
  {BIRTH} AS isrd_brth_date,
  CAST(20 + c_custkey % 60 AS INT) AS psn_age,
  CAST(o_totalprice AS DOUBLE) AS acct_val_amt,
  CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_totalprice * 2 END AS face_amt,
  CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_totalprice / 8 END AS cash_val_amt,
  o_totalprice / 256 AS monthly_premium_amount,
  CASE WHEN c_acctbal < 0 THEN CAST(0 AS DOUBLE) ELSE c_acctbal * 64 END AS wc_total_assets,
  CASE WHEN c_acctbal < 0 THEN CAST(0 AS DOUBLE) ELSE c_acctbal * 8 * (c_custkey % 6) END AS wc_assetmix_stocks,
  CASE WHEN c_acctbal < 0 THEN CAST(0 AS DOUBLE) ELSE c_acctbal * 8 * (5 - c_custkey % 6) END AS wc_assetmix_bonds,
  CASE WHEN c_acctbal < 0 THEN NULL ELSE c_acctbal * 8 END AS wc_assetmix_mutual_funds,
  CASE WHEN c_acctbal < 0 THEN NULL ELSE c_acctbal * 8 END AS wc_assetmix_annuity,
  CASE WHEN c_acctbal < 0 THEN NULL ELSE c_acctbal * 4 END AS wc_assetmix_deposits,
  CASE WHEN c_acctbal < 0 THEN NULL ELSE c_acctbal * 4 END AS wc_assetmix_other_assets,
  CASE WHEN c_custkey % 13 = 0 THEN NULL ELSE c_mktsegment END AS client_seg,
  CONCAT('S', CAST(c_custkey % 4 AS VARCHAR(20))) AS client_seg_1,
  CASE WHEN o_totalprice < 25000 THEN 'A' WHEN o_totalprice < 100000 THEN 'B' ELSE 'C' END AS aum_band,
  CASE c_custkey % 3 WHEN 0 THEN 'Branch Assist' WHEN 1 THEN 'Advisor Assist/Retail' ELSE 'Direct' END AS channel,
  CONCAT('G', CAST(o_orderkey % 5 AS VARCHAR(20))) AS agent_segment,
  CAST(o_orderkey % 100 AS VARCHAR(20)) AS agt_no,
  CONCAT('K', CAST((o_orderkey % 100) % 6 AS VARCHAR(20))) AS agt_class,
  CAST(c_nationkey AS VARCHAR(20)) AS branchoffice_code,
  CONCAT('Branch ', CAST(c_nationkey AS VARCHAR(20))) AS branch_name,
  CONCAT('Division ', CAST(c_nationkey % 5 AS VARCHAR(20))) AS division_name,
  CONCAT('City ', CAST(c_custkey % 40 AS VARCHAR(20))) AS business_city,
  CONCAT('ST', CAST(c_nationkey AS VARCHAR(20))) AS business_state_cod,
  CASE WHEN o_orderstatus = 'P' THEN 'Terminated' ELSE 'Active' END AS policy_status,
  CASE WHEN o_orderkey % 2 = 0 THEN 'Old Policy' ELSE 'New Policy' END AS policy_type,
  CAST({MONTH} AS INT) AS business_month
FROM {{orders}} JOIN {{customer}} ON o_custkey = c_custkey"""),
    # 60 distinct keys, each repeated
    "v_product_lookup": (["orders"], """
SELECT CASE o_orderkey % 2 WHEN 0 THEN 'SYSA' ELSE 'sysb' END AS source_sys_id,
       CAST(o_orderkey % 30 AS VARCHAR(20)) AS idb_plan_cd,
       CAST(o_orderkey % 4 AS VARCHAR(20)) AS idb_sub_plan_cd,
       CASE (o_orderkey % 30) % 5 WHEN 0 THEN ' Roth IRA ' WHEN 1 THEN 'Traditional IRA (NQ)'
            WHEN 2 THEN 'Advisory SAM' WHEN 3 THEN 'Hospital Plan' ELSE NULL END AS stmt_plan_typ_txt
FROM {orders}"""),
    "v_market_base": (["lineitem"], """
SELECT CAST(YEAR(l_shipdate) * 100 + MONTH(l_shipdate) AS INT) AS month_int,
       ROUND(AVG(l_extendedprice), 4) AS close
FROM {lineitem} GROUP BY CAST(YEAR(l_shipdate) * 100 + MONTH(l_shipdate) AS INT)"""),
    "v_activities": (["events"], """
SELECT event_id AS task_id, CAST(user_id AS VARCHAR(20)) AS party_id, CAST(ts AS DATE) AS activity_date,
       CASE event_type WHEN 'click' THEN 'Connected' WHEN 'purchase' THEN 'Appointment Set'
            ELSE 'No Answer' END AS call_outcome
FROM {events}"""),
    "v_opportunities": (["lineitem", "orders"], """
SELECT CONCAT(CAST(l_orderkey AS VARCHAR(20)), '-', CAST(l_linenumber AS VARCHAR(20)), '-', CAST(l_partkey AS VARCHAR(20))) AS opportunity_id,
       CAST(o_custkey AS VARCHAR(20)) AS party_id,
       CASE l_returnflag WHEN 'A' THEN 'Closed Won' WHEN 'R' THEN 'Closed Lost' ELSE 'Open' END AS stage_name,
       l_extendedprice AS estimated_gdc
FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey"""),
    "v_agents_report": (["supplier"], """
SELECT CAST(s_suppkey AS VARCHAR(20)) AS agent_code, CAST(200110 + m.k AS INT) AS yearmo,
       s_name AS full_name, CAST((s_suppkey + m.k) % 30 AS INT) AS rpt_lgth_of_svc,
       CONCAT('R', CAST((s_suppkey + m.k) % 4 AS VARCHAR(20))) AS rank_desc
FROM {supplier} CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1 UNION ALL SELECT 2) m"""),
    "v_retention": (["customer"], """
SELECT CAST(c_custkey AS VARCHAR(20)) AS party_id, CAST(200111 + m.k AS INT) AS business_month,
       CAST(c_nationkey AS VARCHAR(20)) AS state, c_mktsegment AS client_segment,
       c_acctbal * 64 + m.k AS aum_sum, CAST(c_custkey % 20 AS INT) AS client_tenure,
       CAST(c_custkey % 100 AS VARCHAR(20)) AS agent_code
FROM {customer} CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1) m"""),
    "v_scores": (["customer"], f"""
SELECT CAST(c_custkey AS VARCHAR(20)) AS party_id,
       CAST((c_custkey * 7919) % 1009 AS DOUBLE) / 1009 AS investment_score,
       CAST((c_custkey * 6271) % 1013 AS DOUBLE) / 1013 AS retirement_score,
       CAST((c_custkey * 5413) % 1019 AS DOUBLE) / 1019 AS life_insurance_score,
       CAST((c_custkey * 4703) % 1021 AS DOUBLE) / 1021 AS network_products_score,
       CAST({MONTH} AS INT) AS prediction_month
FROM {{customer}}"""),
    "v_contributions": (["customer"], """
SELECT CAST(c_custkey AS VARCHAR(20)) AS party_id, p.product, f.feature,
       CAST((c_custkey * 31 + p.k * 17 + f.k * 101) % 401 - 200 AS DOUBLE) / 1000 AS contribution,
       CAST((c_custkey * 13 + f.k * 7) % 97 AS VARCHAR(20)) AS value
FROM {customer}
CROSS JOIN (SELECT 0 AS k, 'investment' AS product UNION ALL SELECT 1, 'retirement'
            UNION ALL SELECT 2, 'life_insurance' UNION ALL SELECT 3, 'network_products') p
CROSS JOIN (SELECT 0 AS k, 'acct_val_amt' AS feature UNION ALL SELECT 1, 'client_age'
            UNION ALL SELECT 2, 'aum_segment' UNION ALL SELECT 3, 'channel'
            UNION ALL SELECT 4, 'snp_close_lead_6' UNION ALL SELECT 5, 'client_tenure_years') f"""),
}


class Tables:
    """Lazy frames over one folder of the driver's tables."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def raw(self, name: str) -> DataFrame:
        return read_parquet(self.spark, f"{self.sf_dir}/{name}.parquet")

    def view(self, name: str) -> DataFrame:
        tables, text = BASE[name]
        return read_sql(self.spark, text, **{t: self.raw(t) for t in tables})

    @cached_property
    def policies(self) -> DataFrame:
        return self.view("v_policies")

    @cached_property
    def lookup(self) -> DataFrame:
        return self.view("v_product_lookup")

    @cached_property
    def market_base(self) -> DataFrame:
        return self.view("v_market_base")

    @cached_property
    def activities(self) -> DataFrame:
        return self.view("v_activities")

    @cached_property
    def opportunities(self) -> DataFrame:
        return self.view("v_opportunities")

    # Spark repeats rows with explode where the SQL text joins a list of constants
    @cached_property
    def agents(self) -> DataFrame:
        months = self.raw("supplier").selectExpr("*", "explode(sequence(0, 2)) AS k")
        return months.selectExpr(
            "CAST(s_suppkey AS STRING) AS agent_code", "200110 + k AS yearmo", "s_name AS full_name",
            "CAST((s_suppkey + k) % 30 AS INT) AS rpt_lgth_of_svc", "CONCAT('R', CAST((s_suppkey + k) % 4 AS STRING)) AS rank_desc")

    @cached_property
    def retention(self) -> DataFrame:
        months = self.raw("customer").selectExpr("*", "explode(sequence(0, 1)) AS k")
        return months.selectExpr(
            "CAST(c_custkey AS STRING) AS party_id", "200111 + k AS business_month", "CAST(c_nationkey AS STRING) AS state",
            "c_mktsegment AS client_segment", "c_acctbal * 64 + k AS aum_sum", "CAST(c_custkey % 20 AS INT) AS client_tenure",
            "CAST(c_custkey % 100 AS STRING) AS agent_code")

    @cached_property
    def scores(self) -> DataFrame:
        return self.view("v_scores")

    @cached_property
    def contributions(self) -> DataFrame:
        """Clients are dealt out before each becomes 24 rows: one split of the compact table would
        otherwise be one task that sorts them all. The rows of a client stay together, so windows
        and aggregates of a client need no further shuffle, and the number of tasks follows the
        number of clients, whatever their bytes."""
        clients = self.raw("customer").selectExpr("c_custkey", "CAST(c_custkey AS STRING) AS party_id")
        tasks = max(1, -(-clients.count() // CLIENTS_PER_TASK))
        pairs = clients.repartition(tasks, "party_id").selectExpr(
            "party_id", "c_custkey", "explode(sequence(0, 23)) AS j").selectExpr(
            "party_id", "c_custkey", "CAST(j DIV 6 AS INT) AS p", "j % 6 AS f")
        return pairs.selectExpr(
            "party_id",
            "get(array('investment', 'retirement', 'life_insurance', 'network_products'), p) AS product",
            "get(array('acct_val_amt', 'client_age', 'aum_segment', 'channel', 'snp_close_lead_6', 'client_tenure_years'), f) AS feature",
            "CAST((c_custkey * 31 + p * 17 + f * 101) % 401 - 200 AS DOUBLE) / 1000 AS contribution",
            "CAST((c_custkey * 13 + f * 7) % 97 AS STRING) AS value")


def _duckdb_views() -> dict[str, str]:
    base = {name: text.format(**{t: t for t in tables}) for name, (tables, text) in BASE.items()}
    return base | sqltext.DERIVED


def with_views(sql: str) -> str:
    """Prefix a query with the views it needs, directly or through other views."""
    views = _duckdb_views()
    needed: list[str] = []

    def visit(text: str) -> None:
        for name in re.findall(r"\bv_[a-z0-9_]+\b", text):
            if name in views and name not in needed:
                visit(views[name])
                if name not in needed:
                    needed.append(name)

    visit(sql)
    ctes = ", ".join(f"{n} AS ({views[n].strip()})" for n in needed)
    body = sql.strip()
    if not ctes:
        return body
    if body.upper().startswith("WITH "):
        return f"WITH {ctes}, {body[5:]}"
    return f"WITH {ctes} {body}"
