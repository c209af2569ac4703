"""The corpus pipeline: from the documents table to packed training sequences.

Each stage takes what its predecessor kept, is written as Parquet and read again. All but the last
return the columns of documents:

1. toxicity: documents that the Kneser-Ney models reject go.
2. near_duplicates: of each group linked by the n-gram Jaccard join, the smallest doc_id stays.
3. repeated_passages: runs of ``PASSAGE_WORDS`` words or more that stand at several places, whatever
   whitespace is between the words, are cut from the texts, and n_chars with them; a document of which
   nothing is left goes.
4. decontamination: documents that hold a benchmark item go.
5. packing: what is left, as pieces of sequences.

Documents with a null doc_id or text pass through every stage they can't be judged by; an empty
table gives an empty result. Other columns of the table stay as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nextcover.llm.common import stored
from nextcover.llm.decontamination import contaminated
from nextcover.llm.jaccard_join import keep_one
from nextcover.llm.packing import packed
from nextcover.llm.queries import prepared
from nextcover.llm.suffix_dedup import without_repeats
from nextcover.llm.toxicity import toxicity_scores

TOXIC = 0.5
#: a passage has more than fifty words, be they short or long
PASSAGE_WORDS = 51


def quoted(docs: DataFrame) -> list[str]:
    return [f"`{c}`" for c in docs.columns]


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepared(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity_scores(docs, labels, F.lit(True), with_row=True).where(F.col("score") < TOXIC).select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepared(spark)
    return keep_one(docs).select(*quoted(docs))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepared(spark)
    _, removed = without_repeats(docs, PASSAGE_WORDS, words=True)
    kept = removed.select("row_key", F.decode("kept", "UTF-8").alias("kept")).dropDuplicates(["row_key"])
    # the row travels as one column: the table may have columns named like those used here
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"),
                       F.xxhash64(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("row_key"))
    changed = rows.join(stored(kept), "row_key", "left").where(F.col("kept").isNull() | (F.length(F.trim("kept")) > 0))
    cut = {"text": F.coalesce("kept", "row.text"), "n_chars": F.when(F.col("kept").isNull(), F.col("row.n_chars")).otherwise(F.length("kept"))}
    return changed.select(*(cut[c].cast(t).alias(c) if c in cut else F.col(f"row.`{c}`") for c, t in docs.dtypes))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepared(spark)
    gone = contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select("doc_id").distinct()
    return docs.join(stored(gone), "doc_id", "left_anti").select(*quoted(docs))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepared(spark)
    return packed(docs)


STAGES = [("toxicity", toxicity), ("near_duplicates", near_duplicates), ("repeated_passages", repeated_passages),
          ("decontamination", decontamination), ("packing", packing)]

#: scores of a fitted model and byte-pair ids are beyond SQL; tests hold each stage against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stored(docs)
    return docs
