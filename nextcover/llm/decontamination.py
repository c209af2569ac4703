"""Benchmark decontamination by templates.

A text is canonicalised: numbers, units behind a number, and names (capitalised words inside a
sentence; several in a row are one) become typed placeholders, everything else is the lower-cased
word. Windows of ``WINDOW`` template words of documents and benchmark items are joined on their
hashes. So a question with other numbers or names still meets its item, and the values behind
the placeholders, the slots, tell whether it is the same question with other parameters: along
one alignment, every value of the item must always have been replaced by the same value. Of an
alignment where that fails, only the windows without slots count.

Not every text can be told by templates, so each is read in four ways (``found_by``), each with
windows of its own, of which a document must hold at least ``SHARE``:

* ``template``: as above. A window of which half are placeholders would meet anything, so it isn't
  one of them;
* ``opening``: templates in which a word that opens a sentence is a name too if the same text has it
  as a name inside a sentence;
* ``words``: the lower-cased words themselves, numbers and names included, which tells items of many
  placeholders and those in capitals;
* ``whole``: an item of fewer than ``LEAST`` words, which many texts hold by chance, is found in
  documents that have the same words and no others.

Of the ways that reach the share, the first in this order is reported. ``reparameterised`` says that
some slot's value differs. An item with fewer words than a window has one of all its words.

Only windows that a bit table of fixed size lets through (all of the benchmark's, and some by
chance, which the join on hashes removes) leave a document's task; the table's size doesn't
depend on the data.

Nulls: a null text is an empty one and holds nothing; an item with a null text, or one without any
letter or digit, takes no part. Rows with a null doc_id or item_id, and items with the same text,
are reported like others; repeated rows of one doc_id count as one document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nextcover.llm.common import STEP, lowered, mixed, slices, small_batches, span_hashes, stored, texts_of, word_spans

WINDOW = 8
LEAST = 4
SHARE = 0.5
TABLE_BITS = 24
U = np.uint64
LITERAL, NUMBER, UNIT, NAME = range(4)
TEMPLATE, OPENING, WORDS, WHOLE = range(4)
WAYS = ["template", "opening", "words", "whole"]
MARKS = np.array([0, 0x1111111111111111, 0x2222222222222222, 0x3333333333333333], U)

#: fixed values: words that are a unit behind a number
UNITS = """
kg g mg lb lbs oz ton tons kilogram kilograms gram grams pound pounds ounce ounces
km m cm mm mi ft in inch inches foot feet yard yards mile miles meter meters metre metres kilometer kilometers
kilometre kilometres centimeter centimeters centimetre centimetres
s sec secs second seconds min mins minute minutes h hr hrs hour hours day days week weeks month months year years
l ml liter liters litre litres gallon gallons pint pints cup cups
mph kmh kph hz khz mhz ghz w kw v a j kj cal kcal
dollar dollars cent cents euro euros usd eur gbp percent degree degrees
""".split()

_unit_bytes = np.frombuffer("\n".join(UNITS).encode(), np.uint8)
_unit_ends = np.cumsum([len(u) + 1 for u in UNITS]) - 1
UNIT_HASHES = span_hashes(_unit_bytes, _unit_ends - [len(u) for u in UNITS], _unit_ends)

BREAKS = np.zeros(256, np.int64)
BREAKS[list(b".!?:;\n\r\"")] = 1


def words_of(texts: pa.Array) -> dict[str, np.ndarray]:
    """The words of all rows: hash, kind, row, and the bytes each stands for."""
    data, offsets, original = lowered(texts)
    starts, ends, row = word_spans(data, offsets)
    return {"hash": span_hashes(data, starts, ends) if len(starts) else np.empty(0, U), "kind": np.zeros(len(starts), np.int8), "row": row,
            "starts": starts, "ends": ends, "data": data, "original": original}


def templates(words: dict[str, np.ndarray], opening: bool = False) -> dict[str, np.ndarray]:
    """Template words in place of words; with ``opening`` names that open a sentence are names."""
    own, row, starts, ends, data, original = (words[c] for c in ("hash", "row", "starts", "ends", "data", "original"))
    n = len(starts)
    if not n:
        return words
    first = np.ones(n, bool)
    first[1:] = row[1:] != row[:-1]
    before = np.concatenate([[0], ends[:-1]])
    breaks = np.concatenate([[0], np.cumsum(BREAKS[data])])
    opens = first | (breaks[starts] > breaks[np.where(first, starts, before)])
    gap = np.where(first, 99, starts - before)
    digit = (data[starts] >= 48) & (data[starts] <= 57)
    after = np.minimum(starts + 1, len(data) - 1)
    capital = (data[starts] != original[starts]) | ((data[starts] >= 0xC0) & (data[after] != original[after]))
    name = capital & ~opens
    if opening:
        of_row = mixed(own + row.astype(U) * STEP)
        name |= capital & np.isin(of_row, of_row[name])
    kind = np.where(digit, NUMBER, np.where(name, NAME, LITERAL)).astype(np.int8)
    behind_number = np.zeros(n, bool)
    behind_number[1:] = (kind[:-1] == NUMBER) & (gap[1:] <= 2)
    kind[behind_number & ~digit & np.isin(own, UNIT_HASHES)] = UNIT
    # a number with points or commas in it, and names in a row, are one template word
    joint = np.zeros(n, bool)
    mark = data[np.maximum(starts - 1, 0)]
    joint[1:] = (gap[1:] == 1) & (kind[1:] == kind[:-1]) & (((kind[1:] == NUMBER) & ((mark[1:] == 46) | (mark[1:] == 44))) | (kind[1:] == NAME))
    keep = np.flatnonzero(~joint)
    last = np.append(keep[1:], n) - 1
    kind = kind[keep]
    return {"hash": np.where(kind == LITERAL, own[keep], MARKS[kind]), "kind": kind, "row": row[keep],
            "starts": starts[keep], "ends": ends[last], "data": data}


def readings(texts: pa.Array) -> list[tuple[int, dict[str, np.ndarray]]]:
    words = words_of(texts)
    return [(TEMPLATE, templates(words)), (OPENING, templates(words, True)), (WORDS, words), (WHOLE, words)]


def windows(t: dict[str, np.ndarray], k: int, way: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """First word and hash of each window of ``k`` words in one row. Without those of which half or
    more are placeholders, and for ``WHOLE`` only rows that have ``k`` words and fewer than ``least``."""
    n = len(t["hash"]) - k + 1
    if n <= 0 or (way == WHOLE) != (k < least):
        return np.empty(0, np.int64), np.empty(0, U)
    if way == WHOLE:
        row, first, counts = np.unique(t["row"], return_index=True, return_counts=True)
        at = first[counts == k]
    else:
        slots = np.concatenate([[0], np.cumsum(t["kind"] != LITERAL)])
        at = np.flatnonzero((t["row"][:n] == t["row"][k - 1:]) & (2 * (slots[k:] - slots[:-k]) < k))
    h = np.full(len(at), k + (way << 32), U)
    for j in range(k):
        h = h * STEP + t["hash"][at + j]
    return at, mixed(h)


def slot_values(t: dict[str, np.ndarray], at: int, k: int) -> list[str]:
    return [t["data"][t["starts"][i]:t["ends"][i]].tobytes().decode("utf-8", "replace")
            for i in range(at, at + k) if t["kind"][i] != LITERAL]


def rows_of_windows(t, at, h, k, first) -> tuple:
    """Columns row, position in the row, hash, slots; slots are null where there are none."""
    row = t["row"][at]
    slots = np.concatenate([[0], np.cumsum(t["kind"] != LITERAL)])
    some = slots[at + k] > slots[at] if len(at) else np.empty(0, bool)
    return row, at - first[row], h.astype(np.int64), [slot_values(t, a, k) if s else None for a, s in zip(at, some)]


TEXTS = pa.list_(pa.string())


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW, least: int = LEAST) -> DataFrame:
    """(item_id, item_pos, way, size, hash, item_slots, item_windows) of all items."""
    names = ["item_id", "item_pos", "way", "size", "hash", "item_slots", "item_windows"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch["item_id"]
            for lo, hi in slices(batch["text"]):
                for way, t in readings(batch["text"].slice(lo, hi - lo)):
                    counts = np.bincount(t["row"], minlength=hi - lo)
                    first = np.cumsum(counts) - counts
                    for k in {min(window, int(c)) for c in counts if c}:
                        at, h = windows(t, k, way, least)
                        fits = np.minimum(counts[t["row"][at]], window) == k
                        row, pos, h, slots = rows_of_windows(t, at[fits], h[fits], k, first)
                        total = np.bincount(row, minlength=hi - lo)[row]
                        same = [pa.array(np.full(len(row), x, np.int32)) for x in (way, k)]
                        yield pa.RecordBatch.from_arrays([ids.take(pa.array(row + lo)), pa.array(pos), *same, pa.array(h), pa.array(slots, TEXTS), pa.array(total)], names)

    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where(F.col("text").isNotNull())
    return items.mapInArrow(cut, "item_id long, item_pos long, way int, size int, hash long, item_slots array<string>, item_windows long")


def bit_table(hashes: DataFrame, bits: int = TABLE_BITS) -> np.ndarray:
    """Two bits for each hash in a table of 2**bits; at most 2**bits / 32 rows come to the driver."""
    places = hashes.select(F.explode(F.array(*(F.shiftright("hash", s).bitwiseAND(F.lit((1 << bits) - 1)) for s in (0, bits)))).alias("place"))
    words = places.groupBy(F.shiftright("place", 5).alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, CAST(place & 31 AS INT))")).alias("set")).toArrow()
    table = np.zeros(1 << bits - 5, np.uint32)
    table[words["word"].to_numpy()] = words["set"].to_numpy().astype(np.uint32)
    return np.unpackbits(table.view(np.uint8), bitorder="little").view(bool)


def contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, least: int = LEAST, share: float = SHARE) -> DataFrame:
    """(doc_id, item_id, n_windows, item_windows, first_word, last_word, reparameterised, found_by): the
    items each document holds, with the place among its words as read in the way ``found_by``."""
    spark = docs.sparkSession
    small_batches(spark)
    items = stored(benchmark_windows(benchmark, window, least))
    sizes = [(r["way"], r["size"]) for r in items.select("way", "size").distinct().collect()]  # at most four times ``window``
    table = spark.sparkContext.broadcast(bit_table(items.select("hash").distinct()))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, low = table.value, U((1 << TABLE_BITS) - 1)
        for batch in batches:
            ids = batch["doc_id"]
            for lo, hi in slices(batch["text"]):
                for way, t in readings(batch["text"].slice(lo, hi - lo)):
                    first = np.searchsorted(t["row"], np.arange(hi - lo))
                    for k in (size for of, size in sizes if of == way):
                        at, h = windows(t, k, way, least)
                        there = bits[(h & low).astype(np.int64)]
                        at, h = at[there], h[there]
                        there = bits[(h >> U(TABLE_BITS) & low).astype(np.int64)]
                        row, pos, h, slots = rows_of_windows(t, at[there], h[there], k, first)
                        if len(row):
                            yield pa.RecordBatch.from_arrays([ids.take(pa.array(row + lo)), pa.array(pos), pa.array(h), pa.array(slots, TEXTS)], ["doc_id", "pos", "hash", "slots"])

    hits = texts_of(docs).mapInArrow(find, "doc_id long, pos long, hash long, slots array<string>").join(items, "hash")
    pairs = F.explode_outer(F.arrays_zip(F.col("item_slots").alias("item"), F.col("slots").alias("doc")))
    key = ["doc_id", "item_id", "way", "shift"]
    aligned = hits.withColumn("shift", F.col("pos") - F.col("item_pos"))
    slots = (aligned.where(F.col("item_slots").isNotNull()).select(*key, pairs.alias("slot")).select(*key, "slot.item", "slot.doc")
             .groupBy(*key, "item").agg(F.min("doc").alias("least"), F.max("doc").alias("most")))
    odd = (slots.groupBy(*key).agg(F.max((F.col("least") != F.col("most")).cast("int")).alias("mixed"),
                                   F.max((F.col("least") != F.col("item")).cast("int")).alias("changed")))
    places = lambda c: F.struct(F.collect_set(F.when(c, F.col("item_pos"))).alias("found"), F.min(F.when(c, F.col("pos"))).alias("first_word"),
                                F.max(F.when(c, F.col("pos"))).alias("last_word"))
    shifts = aligned.groupBy(*key).agg(F.first("item_windows").alias("item_windows"), places(F.lit(True)).alias("all"), places(F.col("item_slots").isNull()).alias("plain"))
    same = [F.col(f"s.{c}").eqNullSafe(F.col(f"o.{c}")) for c in key]
    mixed_up = F.coalesce(F.col("o.mixed") == 1, F.lit(False))
    judged = (shifts.alias("s").join(odd.alias("o"), same[0] & same[1] & same[2] & same[3], "left")
              .select(*(f"s.{c}" for c in key), "s.item_windows", F.when(mixed_up, F.col("s.plain")).otherwise(F.col("s.all")).alias("places"),
                      F.when(mixed_up, 0).otherwise(F.coalesce("o.changed", F.lit(0))).alias("changed"))
              .select("*", "places.*").where(F.size("found") > 0))
    held = (judged.groupBy("doc_id", "item_id", "way").agg(
        F.size(F.array_distinct(F.flatten(F.collect_list("found")))).cast("long").alias("n_windows"), F.first("item_windows").alias("item_windows"),
        F.min("first_word").alias("first_word"), F.max("last_word").alias("last_word"), (F.max("changed") == 1).alias("reparameterised"))
        .where(F.col("n_windows") >= F.lit(share) * F.col("item_windows")))
    best = held.groupBy("doc_id", "item_id").agg(F.min(F.struct("way", "n_windows", "item_windows", "first_word", "last_word", "reparameterised")).alias("best"))
    return best.select("doc_id", "item_id", "best.*").withColumn("found_by", F.element_at(F.array(*map(F.lit, WAYS)), F.col("way") + 1)).drop("way")
