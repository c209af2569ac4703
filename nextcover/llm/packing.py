"""Best-fit decreasing packing of token sequences.

Documents of equal length are alike to best-fit decreasing, and there are at most as many
lengths as a sequence has places. So the plan is made from the number of pieces of each length:
longest first, a segment tree over remaining capacities finds the tightest open bins in
logarithmic time, and all bins of that capacity that stand behind one another are filled in one
step, exactly as one document after the other would fill them. The plan's size depends on the
lengths, not on the number of documents; each piece then finds its place by its rank among the
pieces of its length, which comes from counts of hashed blocks, so no length is ranked in one task.

Nulls: a null text is an empty one, whose sequence is the end id alone; repeated rows are packed
each on its own; rows with a null doc_id are packed as well. An empty table gives no row.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from nextcover.llm.common import slices, small_batches, stored, texts_of
from nextcover.llm.token_cache import encoder, ids_crc32

BLOCK_ROWS = 20_000


class CapacityTree:
    """Segment tree over capacities 0 … most: the smallest one not below a wish that has bins."""

    def __init__(self, most: int):
        self.leaves = 1 << most.bit_length()
        self.filled = bytearray(2 * self.leaves)

    def set(self, capacity: int, has_bins: bool) -> None:
        i = capacity + self.leaves
        self.filled[i] = has_bins
        while i > 1:
            i //= 2
            self.filled[i] = self.filled[2 * i] | self.filled[2 * i + 1]

    def tightest(self, wish: int) -> int | None:
        i = wish + self.leaves
        if self.filled[i]:
            return wish
        while i > 1:  # up to the first right neighbour with bins, then down its left side
            if i % 2 == 0 and self.filled[i + 1]:
                i += 1
                while i < self.leaves:
                    i = 2 * i if self.filled[2 * i] else 2 * i + 1
                return i - self.leaves
            i //= 2
        return None


def best_fit_plan(counts: dict[int, int], capacity: int) -> np.ndarray:
    """Steps (length, first rank, number, first bin, pieces per bin, offset in the bin)."""
    tree, bins, steps, opened = CapacityTree(capacity), [deque() for _ in range(capacity + 1)], [], 0

    def put(room: int, first: int, n: int) -> None:
        if n:
            bins[room].append((first, n))
            tree.set(room, True)

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            room = tree.tightest(length)
            if room is None:
                room, first, n = capacity, opened, -(-left // (capacity // length))
                opened += n
            else:
                first, n = bins[room].popleft()
                if not bins[room]:
                    tree.set(room, False)
            each = room // length  # a bin stays the tightest until no more of this length fit
            whole = min(n, left // each)
            if whole:
                steps.append((length, rank, whole * each, first, each, capacity - room))
                rank, left = rank + whole * each, left - whole * each
                put(room - each * length, first, whole)
            if left and whole < n:
                steps.append((length, rank, left, first + whole, left, capacity - room))
                put(room - left * length, first + whole, 1)
                rank, left, whole = rank + left, 0, whole + 1
            put(room, first + whole, n - whole)
    return np.array(steps, np.int64).reshape(-1, 6)



def pieces(docs: DataFrame, vocabulary: str, kind: str, end_id: int, capacity: int, with_ids: bool = False) -> DataFrame:
    """Every whole text's ids and the end id; longer ones cut so that the first piece is the shorter one."""
    small_batches(docs.sparkSession)
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary, kind)
        for batch in batches:
            ids, texts = batch["doc_id"].to_pylist(), batch["text"]
            for lo, hi in slices(texts):
                out = []
                for doc_id, tokens in zip(ids[lo:hi], enc.encode(texts.slice(lo, hi - lo).to_pylist())):
                    tokens = np.append(tokens, tokens.dtype.type(end_id)).astype("<u4")
                    at, number = 0, 0
                    step = (len(tokens) - 1) % capacity + 1
                    while at < len(tokens):
                        part = tokens[at:at + step]
                        out.append((doc_id, number, at, len(part), ids_crc32(part), part.tobytes())[:5 + with_ids])
                        at, number, step = at + step, number + 1, capacity
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)],
                                                 ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][:5 + with_ids])

    return texts_of(docs).mapInArrow(cut, schema)


def packed(docs: DataFrame, vocabulary: str = "byte_bpe_50k.json", kind: str = "bytes", end_id: int = 0,
           capacity: int = 2048, with_ids: bool = False) -> DataFrame:
    """One row per piece with its sequence and the place there; ``with_ids`` adds the ids
    (unsigned 32 bits, little endian), which in order of offset make up the sequence."""
    cut = stored(pieces(docs, vocabulary, kind, end_id, capacity, with_ids))
    counts = {r["length"]: r["count"] for r in cut.groupBy("length").count().collect()}  # a row per length
    plan = best_fit_plan(counts, capacity)
    blocks = sum(counts.values()) // BLOCK_ROWS + 1
    keyed = cut.withColumn("block", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(blocks)))
    earlier = Window.partitionBy("length").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    base = (keyed.groupBy("length", "block").count()
            .select("length", "block", F.coalesce(F.sum("count").over(earlier), F.lit(0).cast("long")).alias("base")))
    own = Window.partitionBy("length", "block").orderBy("doc_id", "piece", "ids_crc32")
    ranked = (keyed.withColumn("own", F.row_number().over(own) - 1).join(base, ["length", "block"])
              .withColumn("rank", F.col("base") + F.col("own")).drop("base", "own", "block"))
    # steps in order of (length, rank), to be searched by one number
    order = np.lexsort((plan[:, 1], plan[:, 0])) if len(plan) else np.empty(0, np.int64)
    plan = plan[order]
    width = int(max(counts.values(), default=0)) + 1
    keys = plan[:, 0] * width + plan[:, 1]
    names = [f for f in cut.columns] + ["sequence_id", "offset"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch[c].to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            step = plan[np.searchsorted(keys, length * width + rank, "right") - 1]
            n = rank - step[:, 1]
            sequence, offset = step[:, 3] + n // step[:, 4], step[:, 5] + n % step[:, 4] * length
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in names[:-2]), pa.array(sequence), pa.array(offset)], names)

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cut.schema)
    return ranked.mapInArrow(place, f"{kinds}, sequence_id long, offset long")
