"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nextcover.llm import oracles
from nextcover.llm.common import small_batches
from nextcover.llm.decontamination import contaminated
from nextcover.llm.divergence import divergence
from nextcover.llm.filter_audit import filter_audit
from nextcover.llm.jaccard_join import near_duplicates
from nextcover.llm.licenses import license_scan
from nextcover.llm.line_dedup import line_digests
from nextcover.llm.packing import packed
from nextcover.llm.quality import quality_scores
from nextcover.llm.records import token_records
from nextcover.llm.sharding import extendible_shards
from nextcover.llm.suffix_dedup import deduplicated
from nextcover.llm.topk import top_k
from nextcover.llm.toxicity import crc_of_id, toxicity_scores

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def prepared(spark: SparkSession) -> None:
    """Python workers find this package where the driver found it."""
    known = spark.sparkContext.environment
    if ROOT not in known.get("PYTHONPATH", os.environ.get("PYTHONPATH", "")).split(":"):
        known["PYTHONPATH"] = ":".join(filter(None, [ROOT, os.environ.get("PYTHONPATH", "")]))
    small_batches(spark)


def query(build):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        prepared(spark)
        return build(spark, lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))

    QUERIES[build.__name__] = run
    return build


@query
def op1_license_scan(spark, table):
    return license_scan(table("documents"))


@query
def op2_suffix_array_dedup(spark, table):
    return deduplicated(table("documents"))


@query
def op3_jaccard_forest_join(spark, table):
    return near_duplicates(table("documents"))


@query
def op4_token_records(spark, table):
    return token_records(table("documents"))


@query
def op5_extendible_shards(spark, table):
    sized = table("documents").select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    return extendible_shards(sized, ["doc_id"], F.col("n_bytes")).select("doc_id", "n_bytes", "shard", F.col("shard_depth").cast("long").alias("shard_depth"))


@query
def op6_exact_top_k(spark, table):
    return top_k(table("embeddings"), F.pmod("vec_id", F.lit(50)) == 0, k=5)


@query
def op7_quality_attention(spark, table):
    held_out = F.pmod(crc_of_id(), F.lit(4)) == 2
    scores = quality_scores(table("documents"), table("labels"), ~held_out)
    return scores.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


@query
def op8_template_decontamination(spark, table):
    return contaminated(table("documents"), table("benchmark"))


@query
def op9_best_fit_packing(spark, table):
    return packed(table("documents"))


@query
def op10_toxicity(spark, table):
    held_out = F.pmod(crc_of_id(), F.lit(5)) == 0
    scores = toxicity_scores(table("documents"), table("labels"), ~held_out)
    return scores.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query
def op11_source_divergence(spark, table):
    return divergence(table("documents"))


@query
def op12_filter_audit(spark, table):
    return filter_audit(table("documents"), table("labels"))


@query
def op13_line_runs(spark, table):
    return line_digests(table("documents"))


ORACLES: dict[str, str] = oracles.SQL
