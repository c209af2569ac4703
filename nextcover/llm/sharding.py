"""Shards of bounded size by extendible hashing.

A key's hash is a string of bits; a directory of hash prefixes says which shard a key is in. At
first all rows are one bucket. A bucket over the byte limit, and no other, is split on one more
bit, until every one fits; so a shard is a hash prefix of its own depth, and rows added later
split only the shards that overflow.

The bits are the first 60 of the key's MD5, then 60 of the row's own (all of its columns): rows
of one key that are too many for a shard are told apart by what they hold. Rows alike in all
columns can't be; such a bucket stays at the full depth and gets overflow pages, filled in turn.
A single row larger than the limit has a shard for itself.

The sizes are added up by prefixes of ``ROUND_BITS`` further bits at a time, in one aggregation
that Spark combines before its shuffle; the splits are then found among those sums, and rows
join their prefix's shard. One such round is enough for 4096 times the limit, two for 16 million
times; a round reads the rows of the buckets that are still too large, and nothing else.

Everything here is DataFrame functions. Nulls: a null key has the hash of an empty text and a
marker; a null text has no bytes. An empty table gives no row. Columns may have any names: a row
travels as one column, and one named like a result (``RESULTS``) comes back with ``_`` behind it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from nextcover.llm.common import stored

LIMIT_BYTES = 16 << 20
ROUND_BITS = 12
HASH_BITS = 60
RESULTS = ("shard", "shard_depth", "row_bytes")


def bits_of(text: Column) -> Column:
    """The first 60 bits of a text's MD5 as a number."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, HASH_BITS // 4), 16, 10).cast("long")


def key_text(*columns: str) -> Column:
    """A text that tells null from empty."""
    return F.concat_ws("\x1f", *(F.coalesce(F.concat(F.lit("="), F.col(f"`{c}`").cast("string")), F.lit("-")) for c in columns))


def prefix(depth: int) -> Column:
    """The first ``depth`` bits of the two hashes, as text: a number, or two behind the first 60."""
    if depth <= HASH_BITS:
        return F.shiftright("hash", HASH_BITS - depth).cast("string")
    return F.concat_ws(".", F.col("hash").cast("string"), F.shiftright("row_hash", 2 * HASH_BITS - depth).cast("string"))


def leaf_depths(sums: DataFrame, depth: int, bits: int, limit: int) -> DataFrame:
    """(prefix, depth) of the shard each prefix of ``depth + bits`` bits belongs to; a depth beyond
    those bits means that the bucket is still too large. ``sums`` has the low bits of each
    prefix and its bucket at ``depth``."""
    for d in range(bits + 1):  # buckets on the way from the one at ``depth`` down to the prefix
        own = Window.partitionBy("bucket", F.shiftright("low", bits - d))
        sums = sums.withColumn(f"size_{d}", F.sum("bytes").over(own))
    fits = [F.when(F.col(f"size_{d}") <= limit, F.lit(depth + d)) for d in range(bits + 1)]
    return sums.withColumn("depth", F.coalesce(*fits, F.lit(depth + bits + 1)))


def extendible_shards(df: DataFrame, keys: list[str], size: Column, limit: int = LIMIT_BYTES,
                      round_bits: int = ROUND_BITS) -> DataFrame:
    """The table with ``shard`` (text: depth and prefix, and a page if there are several),
    ``shard_depth`` and ``row_bytes``."""
    names = [c + "_" * (c in RESULTS) for c in df.columns]
    whole_row = F.struct(*(F.col(f"`{c}`").alias(n) for c, n in zip(df.columns, names)))
    rows = df.select(whole_row.alias("row"), bits_of(key_text(*keys)).alias("hash"), bits_of(key_text(*df.columns)).alias("row_hash"),
                     F.coalesce(size, F.lit(0)).cast("long").alias("row_bytes"))
    sizes = stored(rows.groupBy("hash", "row_hash").agg(F.sum("row_bytes").alias("row_bytes"), F.count("*").alias("n")))
    directories, depth, open_rows = [], 0, sizes
    while True:
        bits = min(round_bits, 2 * HASH_BITS - depth)
        if depth < HASH_BITS:
            bits = min(bits, HASH_BITS - depth)
        end = depth + bits
        number = F.shiftright("hash", HASH_BITS - end) if end <= HASH_BITS else F.shiftright("row_hash", 2 * HASH_BITS - end)
        sums = (open_rows.groupBy(prefix(depth).alias("bucket"), prefix(end).alias("prefix"), number.bitwiseAND(F.lit((1 << bits) - 1)).alias("low"))
                .agg(F.sum("row_bytes").alias("bytes")))
        leaves = stored(leaf_depths(sums, depth, bits, limit).select("prefix", "depth"))
        directories.append((end, leaves))
        larger = leaves.where(F.col("depth") > end).select("prefix")
        if end == 2 * HASH_BITS or larger.isEmpty():
            break
        open_rows = stored(open_rows.withColumn("prefix", prefix(end)).join(larger, "prefix", "left_semi").drop("prefix"))
        depth = end
    found = rows
    for i, (end, leaves) in enumerate(directories):
        found = found.withColumn("prefix", prefix(end)).join(leaves.withColumnRenamed("depth", f"depth_{i}"), "prefix", "left").drop("prefix")
    last = directories[-1][0]
    depth_of = F.coalesce(*(F.when(F.col(f"depth_{i}") <= end, F.col(f"depth_{i}")) for i, (end, _) in enumerate(directories)), F.lit(last))
    name = reduce(lambda c, d: c.when(F.col("shard_depth") == d, prefix(d)), range(1, last + 1), F.when(F.col("shard_depth") == 0, prefix(0)))
    found = found.withColumn("shard_depth", depth_of).withColumn("shard", F.concat_ws("-", F.col("shard_depth").cast("string"), name))
    columns = ["row.*", *RESULTS]
    if last < 2 * HASH_BITS:
        return found.select(*columns)
    # rows alike in all columns that are too many for a shard: as many to a page as fit
    alike = ["hash", "row_hash"]
    pages = (sizes.where((F.col("n") > 1) & (F.col("row_bytes") > limit))
             .select(*alike, F.greatest(F.floor(F.lit(limit) * F.col("n") / F.col("row_bytes")), F.lit(1)).alias("per_page")))
    whole = found.join(pages, alike, "left_anti").select(*columns)
    paged = (found.join(pages, alike)
             .withColumn("page", F.floor((F.row_number().over(Window.partitionBy(*alike).orderBy("row_bytes")) - 1) / F.col("per_page")))
             .withColumn("shard", F.concat_ws("-", "shard", F.col("page").cast("string"))))
    return whole.union(paged.select(*columns))


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder per shard."""
    sharded.repartition("shard").write.partitionBy("shard").parquet(path)
