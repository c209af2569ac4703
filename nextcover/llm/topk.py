"""Exact top-k by inner product, with a cover tree on either side.

Vectors are quantised to integers, floor(``SCALE`` * x). Candidates are dealt into cells around
pivots, and cells into blocks of about ``REF_BLOCK``; queries into blocks of about
``QUERY_BLOCK``. Each pair of blocks is one group of rows in a task, which builds a cover tree of
both (children chosen farthest first, so that they lie apart; every node knows its covering
radius) and walks the two together. For a node of queries around p with radius r and one of
candidates around c with radius s no product exceeds <p,c> + |p| s + |c| r + r s; where that is
below the worst k-th score of the node's queries, the pair of nodes is left out. The scores start
from each query's k-th score against a small sample, so a far block ends at its root. A last
ranking of k rows per query and block gives the result.

The sample (``SAMPLE`` rows, by hash order) only places pivots and sets those first scores, both
of which hold for every row; all rows are searched and the result is exact. Scores are computed
with doubles while those are exact for integers, else with Python's integers, and held within
64 bits.

Vectors that are null or empty or hold null or non-finite components, and rows with a null
vec_id, take no part. A query's own row are all rows of its vec_id. Only vectors of the query's
length are candidates. Ties go to the smaller vec_id. An empty table gives no row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from nextcover.llm.common import small_batches, stored

SCALE = 256.0
PIVOTS = 64
SAMPLE = 2048
QUERY_BLOCK = 2048
REF_BLOCK = 4096
LEAF = 64
EXACT = float(1 << 53)


def farthest_first(points: np.ndarray, start: int, most: int, stop: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Centres, each the point farthest from those before it, until all points are within ``stop``
    of one or there are ``most``; and every point's nearest centre and its distance."""
    centres, nearest = [start], np.zeros(len(points), np.int64)
    away = distances(points, points[start])
    while len(centres) < most:
        far = int(np.argmax(away))
        if not away[far] > stop:
            break
        d = distances(points, points[far])
        closer = d < away
        nearest[closer], away = len(centres), np.minimum(d, away)
        centres.append(far)
    return np.array(centres), nearest, away


def distances(points: np.ndarray, centre: np.ndarray) -> np.ndarray:
    return np.sqrt(((points - centre) ** 2).sum(1))


class Node:
    __slots__ = ("members", "centre", "norm", "radius", "children")

    def __init__(self, points: np.ndarray, members: np.ndarray, centre: int):
        self.members, self.centre = members, points[centre]
        self.norm = float(np.sqrt((self.centre ** 2).sum()))
        away = distances(points[members], self.centre)
        self.radius = float(away.max())
        self.children: list[Node] = []
        if len(members) > LEAF and self.radius > 0:
            start = int(np.flatnonzero(members == centre)[0])
            # half the radius, or as many children as keep the fan-out near the square root
            centres, nearest, _ = farthest_first(points[members], start, max(8, int(len(members) ** 0.5)), self.radius / 2)
            if len(centres) > 1:
                self.children = [Node(points, members[nearest == i], int(members[c])) for i, c in enumerate(centres)]


class Best:
    """The k best (score, vec_id) of each query so far."""

    def __init__(self, n: int, k: int, floor: np.ndarray):
        self.k, self.rows = k, [[] for _ in range(n)]
        self.worst = floor.astype(np.float64)  # a score of at least this is still of use

    def add(self, q: int, scores: list, ids: list) -> None:
        kept = sorted(self.rows[q] + [(-s, i) for s, i in zip(scores, ids)])[:self.k]
        self.rows[q] = kept
        if len(kept) == self.k:
            self.worst[q] = max(self.worst[q], float(-kept[-1][0]))


def bounds(q: Node, nodes: list[Node]) -> np.ndarray:
    centres = np.stack([n.centre for n in nodes])
    norm, radius = np.array([n.norm for n in nodes]), np.array([n.radius for n in nodes])
    most = centres @ q.centre + q.norm * radius + norm * q.radius + q.radius * radius
    return most + 1e-9 * (np.abs(most) + q.norm * norm + 1)  # beyond what rounding can take away


def search_pair(q_ids: np.ndarray, queries: np.ndarray, r_ids: np.ndarray, refs: np.ndarray, k: int, floor: np.ndarray) -> Best:
    """Dual-tree search of one block of queries in one of candidates."""
    best = Best(len(q_ids), k, floor)
    top = max(np.abs(queries).max(initial=0), np.abs(refs).max(initial=0))
    exact = top * top * queries.shape[1] < EXACT
    if not exact:
        whole_q, whole_r = (np.array([[int(x) for x in row] for row in m], object) for m in (queries, refs))
    stack = [(Node(queries, np.arange(len(queries)), 0), Node(refs, np.arange(len(refs)), 0))]
    while stack:
        q, r = stack.pop()
        if bounds(q, [r])[0] < best.worst[q.members].min():
            continue
        if q.children and (not r.children or q.radius >= r.radius):
            stack += [(c, r) for c in q.children]
        elif r.children:
            most = bounds(q, r.children)
            stack += [(q, r.children[i]) for i in np.argsort(most)]  # the most promising is on top
        elif exact:
            scores = queries[q.members] @ refs[r.members].T
            good = (scores >= best.worst[q.members][:, None]) & (q_ids[q.members][:, None] != r_ids[r.members][None, :])
            for i in np.flatnonzero(good.any(1)):
                there = np.flatnonzero(good[i])
                best.add(int(q.members[i]), scores[i, there].tolist(), r_ids[r.members[there]].tolist())
        else:
            for i in q.members:
                others = r.members[r_ids[r.members] != q_ids[i]]
                best.add(int(i), (whole_r[others] @ whole_q[i]).tolist(), r_ids[others].tolist())
    return best


def quantised(vectors: pa.Array, dim: int) -> np.ndarray:
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.floor(SCALE * flat).reshape(-1, dim)


def top_k(table: DataFrame, is_query: Column, k: int = 5, vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each row where ``is_query``, a condition on vec_id, holds,
    the k candidates of the highest integer inner product."""
    spark = table.sparkSession
    small_batches(spark)
    v = F.col(vector).cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = stored(table.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & (F.size("v") > 0))
                  .where(F.coalesce(finite, F.lit(False))).withColumn("dim", F.size("v")))
    parts = [search(rows.where(F.col("dim") == r["dim"]), int(r["dim"]), is_query, k) for r in rows.select("dim").distinct().collect()]
    if not parts:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    found = parts[0]
    for p in parts[1:]:
        found = found.union(p)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def search(rows: DataFrame, dim: int, is_query: Column, k: int) -> DataFrame:
    spark = rows.sparkSession
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("vec_id", "v").toArrow().combine_chunks()
    sample_ids, points = sample["vec_id"].to_numpy(), quantised(sample["v"].combine_chunks(), dim)
    pivots = points[farthest_first(points, 0, PIVOTS, 0.0)[0]]
    shared = spark.sparkContext.broadcast((sample_ids, points, pivots))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres = shared.value[2]
        for b in batches:
            x = quantised(b["v"], dim)
            away = (centres ** 2).sum(1)[None, :] - 2 * x @ centres.T
            yield pa.RecordBatch.from_arrays([b["vec_id"], b["v"], pa.array(np.argmin(away, 1).astype(np.int32))], ["vec_id", "v", "cell"])

    celled = stored(rows.select("vec_id", "v").mapInArrow(place, "vec_id long, v array<double>, cell int"))
    counts = {r["cell"]: r["count"] for r in celled.groupBy("cell").count().collect()}  # at most a row per pivot
    blocks = [-(-counts.get(c, 0) // REF_BLOCK) for c in range(len(pivots))]
    base = np.cumsum([0, *blocks]).tolist()
    n_queries = celled.where(is_query).count()
    q_blocks = -(-n_queries // QUERY_BLOCK)
    if not q_blocks:
        return spark.createDataFrame([], "query_id long, vec_id long, score long")
    by_cell = [F.array(*map(F.lit, x)) for x in (blocks, base[:-1])]
    spot = F.pmod(F.xxhash64("vec_id"), F.greatest(by_cell[0][F.col("cell")], F.lit(1)).cast("long"))
    block_of = (by_cell[1][F.col("cell")] + spot).cast("int")
    refs = celled.select("vec_id", "v", block_of.alias("ref_block"), F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1))).alias("query_block"), F.lit(1).alias("side"))
    queries = celled.where(is_query).select("vec_id", "v", F.explode(F.sequence(F.lit(0), F.lit(base[-1] - 1))).alias("ref_block"),
                                            F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(q_blocks)).cast("int").alias("query_block"), F.lit(0).alias("side"))
    names = ["query_id", "vec_id", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, known, _ = shared.value
        floors: dict[int, float] = {}
        now, sides = None, ([], [])

        def close():
            (q_ids, q), (r_ids, r) = ((np.concatenate([x[0] for x in s]), np.concatenate([x[1] for x in s])) if s else (None, None) for s in sides)
            if q is None or r is None:
                return
            new = np.array([i not in floors for i in q_ids])
            if new.any():  # the k-th score of the sample is below or equal to the k-th of all
                scores = q[new] @ known.T
                scores[q_ids[new][:, None] == ids[None, :]] = -np.inf
                kth = np.partition(scores, -k, 1)[:, -k] if scores.shape[1] >= k else np.full(len(scores), -np.inf)
                slack = 1e-9 * np.abs(q[new]).max(1, initial=0) * np.abs(known).max() * dim + 1e-9
                floors.update(zip(q_ids[new].tolist(), (kth - slack).tolist()))
            best = search_pair(q_ids, q, r_ids, r, k, np.array([floors[i] for i in q_ids.tolist()]))
            out = [(int(i), int(c), min(max(-int(s), -(1 << 63)), (1 << 63) - 1)) for i, row in zip(q_ids, best.rows) for s, c in row]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names)

        for b in batches:
            pair = b["query_block"].to_numpy().astype(np.int64) << 32 | b["ref_block"].to_numpy()
            side, vec_id = b["side"].to_numpy(), b["vec_id"].to_numpy()
            x = quantised(b["v"], dim)
            cut = np.flatnonzero((np.diff(pair) != 0) | (np.diff(side) != 0)) + 1
            for lo, hi in zip([0, *cut], [*cut, len(pair)]):
                if pair[lo] != now:
                    yield from close()
                    now, sides = pair[lo], ([], [])
                sides[side[lo]].append((vec_id[lo:hi], x[lo:hi]))
        yield from close()

    dealt = refs.unionByName(queries).repartition("query_block", "ref_block").sortWithinPartitions("query_block", "ref_block", "side", "vec_id")
    return dealt.mapInArrow(run, "query_id long, vec_id long, score long")
