"""Product sequences, kept as one row per event.

A client's whole history may be arbitrarily long, so it is never held as one array: events
carry their position, histories are arrays of a fixed maximum length, and the only operator
that delivers whole sequences cuts them into parts of a fixed length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nextcover.operators.ordered import HOT_FLOOR, first_by, join_by_key, sliced, with_borders, with_order, with_recent
from nextcover.operators.policies import ORDER

PART_ROWS = 10_000


def events(df: DataFrame, party: str = "party_id", value: str = "product_category",
           numeric: list[str] | None = None) -> DataFrame:
    """Numbered events: party, position from 1, date, policy, value and a numeric vector."""
    vector = F.array(*[F.col(c).cast("double") for c in numeric or []])
    kept = df.select(party, *ORDER, F.col(value).alias("value"), vector.alias("numbers"))
    return with_order(kept, party, ORDER, number="position")


def client_sequences(numbered: DataFrame, party: str = "party_id", part_rows: int = PART_ROWS) -> DataFrame:
    """Ordered arrays of values, dates and vectors.

    A client with at most ``part_rows`` events has one row (part 0); a longer history
    continues in further parts, in order and complete.
    """
    part = F.floor((F.col("position") - 1) / part_rows).alias("part")
    item = F.struct("position", "value", "register_date", "numbers")
    grouped = numbered.groupBy(F.col(party), part).agg(F.sort_array(F.collect_list(item)).alias("items"))
    return grouped.select(
        party, "part", F.size("items").alias("events"),
        F.col("items.value").alias("sequence"),
        F.col("items.register_date").alias("dates"),
        F.col("items.numbers").alias("vectors"),
    )


def dedupe_consecutive(c: str | Column) -> Column:
    """An array without values equal to their predecessor. For whole histories, which come in
    parts, see ``collapsed_sequences``."""
    items = F.col(c) if isinstance(c, str) else c
    return F.filter(items, lambda x, i: (i == 0) | (x != F.get(items, i - 1)))


def collapsed_sequences(events_: DataFrame, party: str = "party_id", part_rows: int = PART_ROWS) -> DataFrame:
    """``client_sequences`` without consecutive repeats; what is a repeat doesn't depend on where a
    part begins."""
    return client_sequences(collapse_repeats(events_, party), party, part_rows)


def collapse_repeats(df: DataFrame, party: str = "party_id", order: list[str] | None = None,
                     value: str = "value", floor: int = HOT_FLOOR) -> DataFrame:
    """Events without consecutive repeats, renumbered from 1. Null is a value like others.

    Same slices as ``with_order``: a slice numbers its own changes, and the first change of a
    slice is dropped when it repeats the client's last value in the slice before.
    """
    order = order or ORDER
    tagged = sliced(df, party, order, floor)
    inside = Window.partitionBy(party, "_slice").orderBy(*order)
    before = F.lag(F.struct(F.col(value))).over(inside)  # null where there is no row before
    local = (
        tagged.withColumn("_change", F.when(before.eqNullSafe(F.struct(F.col(value))), 0).otherwise(1))
        .withColumn("_local", F.sum("_change").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    )
    row = F.struct(*order, F.struct(F.col(value)).alias("_held"))
    slices = (
        local.filter("_crosses").groupBy(party, "_slice")
        .agg(F.sum("_change").alias("_changes"), F.min(row)["_held"].alias("_first"), F.max(row)["_held"].alias("_last"))
    )
    across = Window.partitionBy(party).orderBy("_slice")
    repeats = F.col("_first").eqNullSafe(F.lag("_last").over(across)).cast("int")
    borders = (
        slices.withColumn("_repeats", repeats)
        .withColumn("_end", F.sum(F.col("_changes") - F.col("_repeats")).over(across.rowsBetween(Window.unboundedPreceding, 0)))
        .select(party, "_slice", "_repeats", (F.col("_end") - F.col("_changes")).alias("_shift"))
    )
    dropped = (F.col("_local") == 1) & (F.coalesce(F.col("_repeats"), F.lit(0)) == 1)
    return (
        with_borders(local.drop("_crosses"), borders, party)
        .filter((F.col("_change") == 1) & ~dropped)
        .withColumn("position", (F.col("_local") + F.coalesce(F.col("_shift"), F.lit(0))).cast("long"))
        .drop("_slice", "_change", "_local", "_repeats", "_shift")
    )


def sequence_lengths(numbered: DataFrame, party: str = "party_id") -> DataFrame:
    return numbered.groupBy(party).agg(F.max("position").alias("seq_length"))


def min_length(numbered: DataFrame, n: int, party: str = "party_id") -> DataFrame:
    """Events of clients with at least ``n`` of them."""
    if n <= 1:
        return numbered
    return join_by_key(numbered, sequence_lengths(numbered, party).filter(F.col("seq_length") >= n), party, "left_semi", rows="seq_length")


def vocab_alpha(df: DataFrame, column: str = "value") -> DataFrame:
    """Alphabetical ids from 1; 0 is left for padding. A product vocabulary has a handful of
    values, so numbering the distinct ones in one window is small work."""
    values = df.select(column).filter(F.col(column).isNotNull()).distinct()
    order = Window.partitionBy(F.lit(1)).orderBy(column)
    return values.withColumn("id", F.row_number().over(order))


def vocab_freq(df: DataFrame, column: str = "value") -> DataFrame:
    """Ids from 0 by falling frequency, ties by value."""
    counts = df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("frequency"))
    order = Window.partitionBy(F.lit(1)).orderBy(F.desc("frequency"), F.asc(column))
    return counts.withColumn("id", F.row_number().over(order) - 1)


def to_ids(numbered: DataFrame, vocab: DataFrame, column: str = "value", unknown: int = 0) -> DataFrame:
    """Events with the id of their value. Product vocabularies hold one row per category
    (seven at most), which bounds the broadcast."""
    ids = F.broadcast(vocab.select(F.col(column), F.col("id")))
    return numbered.join(ids, column, "left").withColumn("id", F.coalesce(F.col("id"), F.lit(unknown)))


def sliding_examples(numbered: DataFrame, max_len: int = 10, party: str = "party_id") -> DataFrame:
    """Every event after the first as a label with up to ``max_len`` ids before it."""
    return (
        with_recent(numbered, party, "position", {"id": "history"}, max_len)
        .filter(F.size("history") > 0)
        .select(party, "position", "history", F.col("id").alias("label"))
    )


def scoring_history(numbered: DataFrame, max_len: int = 10, party: str = "party_id") -> DataFrame:
    """The last ``max_len`` ids of each client, oldest first."""
    tail = first_by(numbered.select(party, "position", "id"), [party], [F.col("position").desc()], max_len)
    items = F.sort_array(F.collect_list(F.struct("position", "id")))
    return tail.groupBy(party).agg(items["id"].alias("history"), F.max("position").alias("seq_length"))


def _switches(h: Column) -> Column:
    return F.size(F.filter(h, lambda x, i: (i > 0) & (x != F.get(h, i - 1))))


def _from_end(h: Column, k: int) -> Column:
    return F.coalesce(F.try_element_at(h, F.lit(-k)), F.lit(0))


def _occurrences(h: Column, code: int) -> Column:
    return F.size(F.filter(h, lambda x: x == code))


def history_features(df: DataFrame, num_classes: int, history: str = "history") -> DataFrame:
    """Length, last two ids, distinct ids, switches and the count of every id."""
    h = F.col(history)
    return df.withColumns({
        "seq_len": F.size(h), "last_1": _from_end(h, 1), "last_2": _from_end(h, 2),
        "unique_prior": F.size(F.array_distinct(h)), "num_switches": _switches(h),
        **{f"freq_{i}": _occurrences(h, i) for i in range(1, num_classes + 1)},
    })


def history_features_ext(df: DataFrame, history: str = "history") -> DataFrame:
    """Third last id, diversity, switch ratio, most frequent id, recency weight, transition code."""
    h = F.col(history)
    n = F.nullif(F.size(h), F.lit(0))
    # the earliest id among the most frequent ones
    frequency = F.transform(h, lambda x, i: F.struct(
        F.size(F.filter(h, lambda y: y == x)).alias("n"), (-i).alias("at"), x.alias("id")))
    return df.withColumns({
        "last_3": _from_end(h, 3),
        "diversity_ratio": F.coalesce(F.size(F.array_distinct(h)) / n, F.lit(0.0)),
        "switch_ratio": F.coalesce(_switches(h) / n, F.lit(0.0)),
        "most_freq_product": F.coalesce(F.array_max(frequency)["id"], F.lit(0)),
        "recency_weight": F.aggregate(
            F.transform(h, lambda x, i: ((i + 1) * x).cast("double")), F.lit(0.0), lambda a, x: a + x),
        "transition_pattern": F.when(F.size(h) >= 2, _from_end(h, 1) * 100 + _from_end(h, 2)).otherwise(0),
    })


def pad_history(df: DataFrame, max_len: int = 10, history: str = "history") -> DataFrame:
    """``hist_0`` .. with zeros on the left."""
    h = F.coalesce(F.col(history), F.array().cast("array<int>"))
    padded = F.concat(F.array_repeat(F.lit(0), max_len), h)
    tail = F.slice(padded, F.size(padded) - (max_len - 1), max_len)
    return df.withColumns({f"hist_{i}": F.get(tail, i) for i in range(max_len)})
