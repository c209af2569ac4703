"""Line dedup over levelled sorted runs of line hashes.

A text is split at ``\\n``. A line's key is the line without spaces, tabs and line ends at both
ends and with A-Z in lower case. Keys of at least ``LEAST_CHARS`` code points that stand in at
least ``LEAST_DOCS`` documents lose all their lines, except in the document with the largest
doc_id among those that hold them.

The index of keys is a set of *runs*: tables of (hash, docs, last), one row per hash, bucketed
and sorted by hash. Documents come in batches, the largest doc_ids first. A batch is added up per
hash, merge-anti-joined with the *settled* rows of all runs (keys that one run has seen in enough
documents: their last document is known and no later batch can change it) and becomes a run of
level 0. Two runs of one level are merged into one of the next, so a batch meets as many runs as
the logarithm of the batches before it and a row is rewritten as often. Runs share their bucketing:
joins and merges of runs move no run across the network. The class :class:`LineRuns` keeps such an
index for batches of any kind; it is dropped when its owner closes it.

Decisions come from the merged index by one join on the hash, as positions of lines; the positions
of a document are joined to its text, which crosses the network once. Equal keys are told by MD5.

DataFrame functions only. Nulls: a null text is one empty line, a null doc_id counts as the
smallest. Rows of one doc_id are one document for the counts, and each loses its own lines.
Repeated rows give repeated results. An empty table gives no row; other columns are not read.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nextcover.llm.common import shared_folder, stored

LEAST_CHARS = 40
LEAST_DOCS = 5
BATCHES = 4
BLANKS = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SMALLEST = -(1 << 63)


class LineRuns:
    """Levelled sorted runs of (hash, docs, last): in how many documents a line stands, and the
    largest of their ids."""

    def __init__(self, spark: SparkSession, least_docs: int = LEAST_DOCS):
        self.spark, self.least_docs = spark, least_docs
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[tuple[str, str]]] = []

    def runs(self) -> list[tuple[str, str]]:
        return [run for level in self.levels for run in level]

    def _written(self, rows: DataFrame, level: int) -> None:
        name, path = f"line_run_{uuid.uuid4().hex}", shared_folder(self.spark)
        (rows.select("hash", "docs", "last").write.bucketBy(self.buckets, "hash").sortBy("hash")
         .option("path", path).option("compression", "zstd").format("parquet").saveAsTable(name))
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append((name, path))

    def _dropped(self, run: tuple[str, str]) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {run[0]}")
        path = self.spark._jvm.org.apache.hadoop.fs.Path(run[1])
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def _merged(self, a: tuple[str, str], b: tuple[str, str]) -> DataFrame:
        x = self.spark.table(a[0])
        y = self.spark.table(b[0]).withColumnsRenamed({"docs": "more", "last": "other"})
        return x.join(y, "hash", "full").select(
            "hash", (F.coalesce("docs", F.lit(0)) + F.coalesce("more", F.lit(0))).alias("docs"),
            F.greatest("last", "other").alias("last"))

    def _compacted(self, a: tuple[str, str], b: tuple[str, str], level: int) -> None:
        self._written(self._merged(a, b), level)
        for run in (a, b):
            self._dropped(run)

    def add(self, rows: DataFrame) -> None:
        """Add a batch of (hash, docs, last), one row per hash and no document of an earlier
        batch. Keys that are settled already are left out."""
        for name, _ in self.runs():
            settled = self.spark.table(name).where(F.col("docs") >= self.least_docs)
            rows = rows.join(settled.select("hash"), "hash", "left_anti")
        self._written(rows, 0)
        level = 0
        while len(self.levels[level]) == 2:
            pair, self.levels[level] = self.levels[level], []
            level += 1
            self._compacted(*pair, level)

    def repeated(self) -> DataFrame:
        """(hash, last) of the keys in enough documents, from all runs merged into one."""
        while len(self.runs()) > 1:
            a, b = self.runs()[:2]  # the two smallest
            top = max(i for i, level in enumerate(self.levels) if a in level or b in level)
            self.levels = [[run for run in level if run not in (a, b)] for level in self.levels]
            self._compacted(a, b, top)
        if not self.runs():
            return self.spark.createDataFrame([], "hash binary, last long")
        return self.spark.table(self.runs()[0][0]).where(F.col("docs") >= self.least_docs).select("hash", "last")

    def close(self) -> None:
        for run in self.runs():
            self._dropped(run)
        self.levels = []


def line_key(line: Column) -> Column:
    """The line without blanks at its ends, A-Z in lower case and no other letter changed."""
    line = F.btrim(line, F.lit(BLANKS))
    ascii_only = F.octet_length(line) == F.char_length(line)
    return F.when(ascii_only, F.lower(line)).otherwise(F.translate(line, UPPER, UPPER.lower()))


def long_lines(docs: DataFrame, least_chars: int) -> DataFrame:
    """(doc, text_hash, place, hash) of the lines that can be repeats."""
    lines = docs.select("doc", "text_hash", F.posexplode(F.split("text", "\n", -1)).alias("place", "line"))
    return (lines.where(F.char_length(F.btrim("line", F.lit(BLANKS))) >= least_chars)
            .select("doc", "text_hash", "place", F.unhex(F.md5(line_key(F.col("line")))).alias("hash")))


def borders(docs: DataFrame, batches: int) -> list[int]:
    """Ids that cut the documents into about equal batches, ``batches - 1`` at most."""
    if batches < 2:
        return []
    found = docs.agg(F.percentile_approx("doc", [i / batches for i in range(1, batches)])).first()[0]
    return sorted(set(found or []))


def without_repeated_lines(docs: DataFrame, least_docs: int = LEAST_DOCS, least_chars: int = LEAST_CHARS,
                           batches: int = BATCHES) -> DataFrame:
    """(doc_id, kept, n_lines, n_dropped) of every row: the text without the lines it loses."""
    spark = docs.sparkSession
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    rows = rows.select("*", F.coalesce("doc_id", F.lit(SMALLEST)).alias("doc"), F.xxhash64("text").alias("text_hash"))

    cuts = borders(rows, batches)
    batch = sum((F.col("doc") > c).cast("int") for c in cuts) if cuts else F.lit(0)
    path = shared_folder(spark)
    long_lines(rows, least_chars).withColumn("batch", batch).write.option("compression", "zstd").partitionBy("batch").parquet(path)
    lines = spark.read.schema("doc long, text_hash long, place int, hash binary, batch int").parquet(path)

    index = LineRuns(spark, least_docs)
    for number in reversed(range(len(cuts) + 1)):
        held = lines.where(F.col("batch") == number).select("hash", "doc").distinct()
        index.add(held.groupBy("hash").agg(F.count("*").alias("docs"), F.max("doc").alias("last")))
    repeated = stored(index.repeated())
    index.close()

    lost = (lines.join(repeated, "hash").where(F.col("doc") != F.col("last"))
            .groupBy("doc", "text_hash").agg(F.collect_set("place").alias("lost")))
    # one plan at every size: a small table of lost lines would be sent to all tasks, a large one not
    found = rows.join(stored(lost).hint("merge"), ["doc", "text_hash"], "left")

    def rest(parts: Column) -> Column:
        places = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col("lost"))
        return F.array_join(F.transform(places, lambda i: F.get(parts, i)), "\n")

    # bound by a list of one, so that the text is split once and not for every line
    kept = F.get(F.transform(F.array(F.split("text", "\n", -1)), rest), F.lit(0))
    return found.select(
        "doc_id", F.when(F.col("lost").isNull(), F.col("text")).otherwise(kept).alias("kept"),
        F.size(F.split("text", "\n", -1)).cast("long").alias("n_lines"),
        F.coalesce(F.size("lost"), F.lit(0)).cast("long").alias("n_dropped"))


def line_digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped and the SHA-256 of the text that is left."""
    return without_repeated_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
