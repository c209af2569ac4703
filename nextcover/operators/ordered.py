"""Ordered work inside a key (row numbers, neighbours, histories) that survives hot keys.

A plain window sends all rows of a key to one task. Here the rows are cut into ranges of the whole
ordering, key first, as a range partitioning does: no key is counted and none is special. The cuts
are rows of the table, about one in ``floor`` by a hash of their key and order, thinned evenly to
``MOST_SLICES``; both numbers bound what is sent to every task. Each (key, slice) is a window of
its own. A key whose rows lie on both sides of a cut continues over it: what crosses (the rows
before, the neighbour behind) comes from a frame of a row per such key and slice, two per slice at
most. A table without enough rows for a cut has the ordinary one-shuffle window.

The cuts are a function of the values, so every use of them agrees, on any cluster, at any number
of partitions and after any loss.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TASK_SHARE = 10_000
MOST_SLICES = 10_000
HOT_FLOOR = 1_000_000
CHUNK_ROWS = 100_000
SEARCH_STEPS = [1 << i for i in reversed(range(14))]


def hot_keys(df: DataFrame, key: str, floor: int = HOT_FLOOR) -> DataFrame:
    """Keys with more rows than one task should join, with their rows and that limit."""
    counts = df.select(key).groupBy(key).agg(F.count(F.lit(1)).alias("_rows"))
    limit = F.greatest(F.lit(floor), F.coalesce(counts.agg(F.sum("_rows")).scalar(), F.lit(0)) / TASK_SHARE)
    return counts.withColumn("_limit", limit).filter(F.col("_rows") > F.col("_limit"))


def cuts(df: DataFrame, order: list[str], floor: int = HOT_FLOOR, also: list[str] | None = None) -> Column:
    """Rows of the ordering at which its slices begin, in order, as one scalar subquery. ``also``
    names further columns that the choice is made by; with an aggregate's result among them it is
    made behind the aggregate, which Spark then computes once for the cuts and the rows."""
    row, seen = F.struct(*order), [*order, *(also or [])]
    chosen = df.select(*seen).filter(F.pmod(F.xxhash64(*seen), F.lit(max(floor, 1))) == 0)
    found = chosen.agg(F.array_sort(F.collect_list(row)).alias("_found"))
    each = F.greatest(F.ceil(F.size("_found") / MOST_SLICES), F.lit(1))
    return found.select(F.filter("_found", lambda x, i: i % each == 0)).scalar()


def place(cuts_: Column, order: list[str]) -> Column:
    """How many cuts are not beyond a row, by binary search."""
    def step(found: Column, width: Column) -> Column:
        return found + F.when(F.get(cuts_, found + width - 1) <= F.struct(*order), width).otherwise(0)

    steps = F.filter(F.array(*map(F.lit, SEARCH_STEPS)), lambda width: width <= F.size(cuts_))
    return F.when(F.size(cuts_) == 0, 0).otherwise(F.aggregate(steps, F.lit(0), step))


def bound(value: Column, use) -> Column:
    """``use`` of a value that is computed, and planned, once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def sliced(df: DataFrame, key: str, order: list[str], floor: int = HOT_FLOOR) -> DataFrame:
    """Rows with ``_slice``, a number that rises with (key, order), and ``_crosses``: the key may
    have rows in a slice beside this one."""
    whole = list(dict.fromkeys([key, *order]))

    def placed(c: Column) -> Column:
        def beside(at: Column) -> Column:
            same = [F.get(c, at - back)[key].eqNullSafe(F.col(key)) for back in (1, 0)]
            return F.struct(at.alias("_slice"), ((F.size(c) > 0) & (same[0] | same[1])).alias("_crosses"))

        return bound(place(c, whole), beside)

    with_cuts = df.withColumn("_cuts", cuts(df, whole, floor))
    return with_cuts.withColumn("_placed", bound(F.col("_cuts"), placed)).select("*", "_placed.*").drop("_placed", "_cuts")


def with_borders(local: DataFrame, borders: DataFrame, key: str) -> DataFrame:
    """Rows with what their slice takes over from others. ``borders`` has two rows per slice at
    most, one for each key that continues over its cuts; null is a key like others."""
    names = {key: "_border_key", "_slice": "_border_slice"}
    right = F.broadcast(borders.withColumnsRenamed(names))
    same = (F.col("_slice") == F.col("_border_slice")) & F.col(key).eqNullSafe(F.col("_border_key"))
    return local.join(right, same, "left").drop(*names.values())


def _directed(columns: list[str], descending: bool) -> list[Column]:
    return [F.col(c).desc() if descending else F.col(c).asc() for c in columns]


def with_order(
    df: DataFrame,
    key: str,
    order: list[str],
    number: str | None = None,
    ahead: dict[str, str] | None = None,
    behind: dict[str, str] | None = None,
    descending: bool = False,
    floor: int = HOT_FLOOR,
) -> DataFrame:
    """Row number and neighbour values of each row within its key.

    ``order`` must be a total order. ``ahead`` and ``behind`` map a column to the name that
    takes its value from the next or previous row.
    """
    tagged = sliced(df, key, order, floor)
    per_slice = Window.partitionBy(key, "_slice").orderBy(*_directed(order, descending))
    columns: dict[str, Column] = {}
    if number:
        columns[number] = F.row_number().over(per_slice)
    if ahead:
        columns["_ahead"] = F.lead(F.struct(*ahead)).over(per_slice)
    if behind:
        columns["_behind"] = F.lag(F.struct(*behind)).over(per_slice)
    local = tagged.drop("_crosses").withColumns(columns)

    # one row per slice and key that continues: size, first row and last row
    lowest, highest = (F.max, F.min) if descending else (F.min, F.max)
    payload = list(dict.fromkeys([*(ahead or {}), *(behind or {})]))
    whole_row = F.struct(*order, F.struct(*payload).alias("_values")) if payload else None
    aggs = [F.count(F.lit(1)).alias("_size")]
    if ahead:
        aggs.append(lowest(whole_row)["_values"].alias("_first"))
    if behind:
        aggs.append(highest(whole_row)["_values"].alias("_last"))
    slices = tagged.filter("_crosses").groupBy(key, "_slice").agg(*aggs)
    across = Window.partitionBy(key).orderBy(*_directed(["_slice"], descending))
    borders = [F.col(key), F.col("_slice")]
    if number:
        before = F.sum("_size").over(across.rowsBetween(Window.unboundedPreceding, -1))
        borders.append(before.alias("_before"))
    if ahead:
        borders.append(F.lead("_first").over(across).alias("_after_border"))
    if behind:
        borders.append(F.lag("_last").over(across).alias("_before_border"))
    joined = with_borders(local, slices.select(*borders), key)

    out: dict[str, Column] = {}
    if number:
        out[number] = (F.col(number) + F.coalesce(F.col("_before"), F.lit(0))).cast("long")
    for source, name in (ahead or {}).items():
        out[name] = F.coalesce(F.col("_ahead"), F.struct(*[F.col("_after_border")[c].alias(c) for c in ahead]))[source]
    for source, name in (behind or {}).items():
        out[name] = F.coalesce(F.col("_behind"), F.struct(*[F.col("_before_border")[c].alias(c) for c in behind]))[source]
    return joined.withColumns(out).drop("_slice", "_ahead", "_behind", "_before", "_after_border", "_before_border")


def with_recent(
    df: DataFrame,
    key: str,
    position: str,
    columns: dict[str, str],
    size: int,
    include_current: bool = False,
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Arrays of the last ``size`` values before each row (or up to and with it).

    ``position`` numbers the rows of a key from 1. Rows are grouped into chunks of
    ``chunk_rows`` positions; the last ``size`` rows of a chunk are also sent to the next
    one, so that no task sees more than a chunk, whatever the size of the key.
    """
    reach = size - 1 if include_current else size
    zero_based = F.col(position) - 1
    chunk = F.floor(zero_based / chunk_rows)
    near_end = (zero_based % chunk_rows) >= chunk_rows - reach
    homes = F.when(near_end, F.array(chunk, chunk + 1)).otherwise(F.array(chunk))
    spread = df.withColumn("_chunk", F.explode(homes))
    frame = (
        Window.partitionBy(key, "_chunk").orderBy(position)
        .rowsBetween(-reach, Window.currentRow if include_current else -1)
    )
    return (
        spread.withColumns({out: F.collect_list(c).over(frame) for c, out in columns.items()})
        .filter(F.col("_chunk") == chunk)
        .drop("_chunk")
    )


def first_by(df: DataFrame, keys: list[str], order: list[Column], n: int = 1, rank: str | None = None) -> DataFrame:
    """The first ``n`` rows of each key.

    ``row_number() <= n`` lets Spark cut each key to ``n`` rows before the shuffle, so a hot
    key costs no more than any other.
    """
    name = rank or "_rn"
    out = df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col(name) <= n)
    return out if rank else out.drop(name)


def latest_by(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The newest row of each key."""
    return first_by(df, keys, [F.col(c).desc() for c in order])


def join_by_key(df: DataFrame, right: DataFrame, key: str, how: str = "inner", floor: int = HOT_FLOOR,
                rows: str | None = None) -> DataFrame:
    """Join with a frame of one row per key, in which hot keys are spread over as many tasks as
    their rows ask for and the other side's row of such a key is repeated for each of them. AQE
    can't split the join of rows with an aggregate, so this does it. ``rows`` names a column of
    ``right`` that counts the key's rows in ``df``, where there is one."""
    if rows:
        limit = F.greatest(F.lit(floor), F.coalesce(right.agg(F.sum(rows)).scalar(), F.lit(0)) / TASK_SHARE)
        hot = right.select(key, F.col(rows).alias("_rows"), limit.alias("_limit")).filter("_rows > _limit")
    else:
        hot = hot_keys(df, key, floor)
    # fewer than TASK_SHARE keys, and twice as many salts of all of them
    hot = F.broadcast(hot.select(key, F.ceil(F.col("_rows") / F.greatest("_limit", F.lit(1))).cast("long").alias("_salts")))
    plain = [f.name for f in df.schema if f.dataType.typeName() not in ("map", "variant")]
    own = F.coalesce(F.pmod(F.xxhash64(*plain), "_salts"), F.lit(0))
    salted = df.join(hot, key, "left").withColumn("_salt", own.cast("long")).drop("_salts")
    each = F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("_salts", F.lit(1)) - 1))
    spread = right.join(hot, key, "left").withColumn("_salt", each).drop("_salts")
    return salted.join(spread, [key, "_salt"], how).drop("_salt")


def with_totals(df: DataFrame, key: str, totals: dict[str, Column], floor: int = HOT_FLOOR) -> DataFrame:
    """Rows with aggregates of their key."""
    sums = df.groupBy(key).agg(F.count(F.lit(1)).alias("_rows"), *[c.alias(n) for n, c in totals.items()])
    return join_by_key(df, sums.filter(F.col(key).isNotNull()), key, "left", floor, rows="_rows").drop("_rows")
