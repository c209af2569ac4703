"""Near-duplicate documents: a Jaccard join on word shingles by a MinHash LSH forest.

A document is the set of its shingles of five words. Each of ``TREES`` prefix trees orders the
documents by ``DEPTH`` minimum hashes of its own; documents under one node of a tree agree on
that many of them. The matched prefix is shortened from the full depth until the forest finds a
pair at the threshold with the target recall, and no further (``prefix_length``). The members of a
node with more than ``RUN`` of them meet again in a further forest of independent minima, with a
longer prefix and as many trees as keep the recall of both together (``further_forest``).

1. Texts of the same words are one class and have one row from here on.
2. Under each node, members whose signatures agree enough (``LOOSE``, far below what a pair at the
   threshold shows) are joined, and the connected families of these joins collected over all trees.
   No pair is ever written, only a star for each family and node. A crowded node is first read in
   runs sorted by signature, which joins most of a large family at small cost; its members then go
   through the further forest. A node that is crowded there too is compared whole, in pairs of
   blocks, but for the members of its largest family with one another: they are joined already.
3. Within a family every pair is compared exactly, shingle set by shingle set. Families are dealt
   out in blocks of ``BLOCK`` documents, each pair of blocks to one task, which returns a number of
   links for each of its documents and a spanning forest, not the pairs.

The result has for every document the class of its words, the number of other documents linked
to it (similarity at least the threshold; copies are linked), and the smallest doc_id of its
connected group.

A text of one to four words has one shingle of all its words; a text without words, null
included, is linked with nothing. Rows with a null doc_id take no part and come back with null
classes. Repeated rows are copies of one another.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nextcover.llm.common import (
    STEP, components, lowered, mixed, packed_texts, shingles, slices, small_batches, span_hashes, stored, texts_of, unpacked, word_spans,
)

SHINGLE = 5
THRESHOLD = 0.8
RECALL = 0.999999
TREES = 20
DEPTH = 4
LOOSE = 0.55
BLOCK = 256
RUN = 2048
LEADERS = 64
#: the further forest takes the longest prefix that needs no more trees than these
FURTHER_TREES = 64
U = np.uint64


def prefix_length(trees: int, depth: int, threshold: float, recall: float) -> int:
    """The longest matched prefix with which the forest finds a pair at the threshold with at least
    the recall (1, the shortest, if none does)."""
    return next((n for n in range(depth, 0, -1) if 1 - (1 - threshold ** n) ** trees >= recall), 1)


def further_forest(threshold: float, recall: float) -> tuple[int, int]:
    """(trees, depth) of the further forest: what it and the first one miss of the pairs at the
    threshold is together no more than the recall allows (where the first leaves anything)."""
    missed = (1 - threshold ** prefix_length(TREES, DEPTH, threshold, recall)) ** TREES
    allowed = 1 - recall - missed if missed < 1 - recall else 1 - recall
    trees = {n: int(np.ceil(np.log(allowed) / np.log1p(-threshold ** n))) for n in range(1, 33)} if threshold < 1 else {32: 1}
    depth = max((n for n, t in trees.items() if t <= FURTHER_TREES), default=1)
    return trees[depth], depth


def hashed_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    data, offsets, _ = lowered(texts)
    starts, ends, row = word_spans(data, offsets)
    return span_hashes(data, starts, ends), row


def class_keys(words: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    """128 bits of each row's sequence of words."""
    first = np.searchsorted(row, np.arange(rows + 1))
    place = np.arange(len(words)) - first[row] if len(words) else np.empty(0, np.int64)
    keys = np.zeros((rows, 2), U)
    for i in range(2):
        salted = mixed(mixed(words ^ U(0x5851F42D4C957F2D * (i + 1) & (1 << 64) - 1)) + place.astype(U) * STEP)
        total = np.concatenate([np.zeros(1, U), np.cumsum(salted, dtype=U)])
        keys[:, i] = mixed(total[first[1:]] - total[first[:-1]] + np.diff(first).astype(U))
    return keys


_rng = np.random.default_rng(20240607)
FACTORS = _rng.integers(1, 1 << 32, TREES * DEPTH, dtype=np.uint32) | np.uint32(1)
ADDS = _rng.integers(0, 1 << 32, TREES * DEPTH, dtype=np.uint32)


def signatures(hashes: np.ndarray, row: np.ndarray, rows: int, factors: np.ndarray = FACTORS, adds: np.ndarray = ADDS) -> tuple[np.ndarray, np.ndarray]:
    """Minimum hashes (TREES x DEPTH) of the rows that have shingles, and which rows these are."""
    there = np.unique(row)
    first = np.searchsorted(row, there)
    low = (hashes >> U(32)).astype(np.uint32) ^ (hashes & U(0xFFFFFFFF)).astype(np.uint32)
    out = np.empty((len(there), len(factors)), np.uint32)
    for i in range(len(factors)):
        v = low * factors[i] + adds[i]
        v ^= v >> np.uint32(15)
        v *= np.uint32(0x2C1B3C6D)
        out[:, i] = np.minimum.reduceat(v, first) if len(first) else 0
    return out, there


def node_hashes(by_tree: np.ndarray) -> np.ndarray:
    """A node for each row and tree, of minima (rows x trees x matched prefix)."""
    rows, trees, prefix = by_tree.shape
    node = np.zeros((rows, trees), U) + (np.arange(trees, dtype=U) + U(1))[None, :]
    for j in range(prefix):
        node = node * STEP + by_tree[:, :, j].astype(U)
    return mixed(node.ravel()).astype(np.int64).reshape(node.shape)


def profiles(docs: DataFrame, prefix: int) -> DataFrame:
    """(doc_id, key, nodes, sketch) of every row: class of its words, its node in each tree at the
    matched prefix, and four bits of each minimum hash in the order of the trees."""

    def profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in slices(batch["text"]):
                words, row = hashed_words(batch["text"].slice(lo, hi - lo))
                keys = class_keys(words, row, hi - lo)
                h, at, _ = shingles(words, row, hi - lo, SHINGLE)
                sig, there = signatures(h, at, hi - lo)
                node = node_hashes(sig.reshape(len(there), TREES, DEPTH)[:, :, :prefix])
                nibbles = (sig & np.uint32(15)).astype(np.uint8)  # minima are small: their high bits say nothing
                sketch = nibbles[:, 0::2] << 4 | nibbles[:, 1::2]
                place = np.full(hi - lo, -1)
                place[there] = np.arange(len(there))
                yield pa.RecordBatch.from_arrays([
                    batch["doc_id"].slice(lo, hi - lo),
                    pa.array([keys[i].tobytes() if p >= 0 else None for i, p in enumerate(place)], pa.binary()),
                    pa.array([node[p] if p >= 0 else None for p in place], pa.list_(pa.int64())),
                    pa.array([sketch[p].tobytes() if p >= 0 else None for p in place], pa.binary())], ["doc_id", "key", "nodes", "sketch"])

    return docs.mapInArrow(profile, "doc_id long, key binary, nodes array<long>, sketch binary")


def joined_stars(sketches: np.ndarray, loose: float) -> np.ndarray:
    """For each member the first of its family: members whose sketches agree in enough places,
    directly or over others."""
    m, n = sketches.shape
    # two unequal minimum hashes still share four bits once in sixteen
    least = int(np.ceil(n * (loose + (1 - loose) / 16)))
    if m == 2:
        return np.array([0, 0 if (sketches[0] == sketches[1]).sum() >= least else 1])
    near = np.zeros((m, m), np.uint8)
    for j in range(n):
        near += sketches[:, j, None] == sketches[None, :, j]
    near = near >= least
    root, open_ = np.full(m, -1), np.ones(m, bool)
    for i in range(m):
        if open_[i]:
            front = np.zeros(m, bool)
            front[i] = True
            while front.any():
                open_ &= ~front
                root[front] = i
                front = near[front].any(0) & open_
    return root


def unnibbled(sketches: list[bytes]) -> np.ndarray:
    packed = np.frombuffer(b"".join(sketches), np.uint8).reshape(len(sketches), -1)
    return np.stack([packed >> 4, packed & 15], 2).reshape(len(sketches), -1)


def stars(nodes: DataFrame, whole: bool) -> DataFrame:
    """Stars (a, b) of the families under every node of (node, key, sketch). ``whole``: each node's
    members are compared with all others, in one task. Else they come sorted by signature, and more
    than ``RUN`` of them are compared run by run, each with some of those before it."""
    most, led = 1 << 60 if whole else RUN, LEADERS

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, keys, marks, leaders = None, [], [], 0

        def close(last: bool):
            nonlocal keys, marks, leaders
            out = []
            if len(keys) > 1:
                root = joined_stars(unnibbled(marks), LOOSE)
                out = [(keys[i], keys[r]) for i, r in enumerate(root) if i != r]
                if not last:  # one member of each family, then others, stand for this run in the next
                    heads = np.unique(root)[:led]
                    more = np.linspace(0, len(keys) - 1, led - len(heads)).astype(int) if len(heads) < led else []
                    stay = sorted({*heads.tolist(), *more})
                    keys, marks, leaders = [keys[i] for i in stay], [marks[i] for i in stay], len(stay)
            if last:
                keys, marks, leaders = [], [], 0
            return out

        for batch in batches:
            node = batch["node"].to_numpy()
            key, mark, out = batch["key"], batch["sketch"], []
            cuts = np.flatnonzero(np.diff(node)) + 1
            for lo, hi in zip([0, *cuts], [*cuts, len(node)]):
                if node[lo] != now:
                    out += close(True)
                    now = node[lo]
                while lo < hi:
                    step = min(hi, lo + most + leaders - len(keys))
                    keys += key.slice(lo, step - lo).to_pylist()
                    marks += mark.slice(lo, step - lo).to_pylist()
                    lo = step
                    if len(keys) >= most + leaders:
                        out += close(False)
            yield star_batch(out)
        yield star_batch(close(True))

    def star_batch(out):
        return pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.binary()), pa.array([y for _, y in out], pa.binary())], ["a", "b"])

    dealt = nodes.repartition("node").sortWithinPartitions("node") if whole else nodes.repartitionByRange("node", "sketch").sortWithinPartitions("node", "sketch")
    return dealt.mapInArrow(join, "a binary, b binary")


def exploded(classes: DataFrame) -> DataFrame:
    return classes.select(F.explode("nodes").alias("node"), "key", "sketch")


def crowded(nodes: DataFrame) -> DataFrame:
    """(node, crowd) of the nodes with more than ``RUN`` members: at most one row for so many."""
    return stored(nodes.groupBy("node").agg(F.count("*").alias("crowd")).where(F.col("crowd") > RUN))


def further_nodes(members: DataFrame, trees: int, depth: int) -> DataFrame:
    """(key, nodes, sketch) in the further forest, of (key, sketch, packed)."""
    rng = np.random.default_rng(20250311)
    factors = rng.integers(1, 1 << 32, trees * depth, dtype=np.uint32) | np.uint32(1)
    adds = rng.integers(0, 1 << 32, trees * depth, dtype=np.uint32)

    def profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, part in unpacked(batch["packed"]):
                words, row = hashed_words(part)
                h, at, _ = shingles(words, row, hi - lo, SHINGLE)
                sig, there = signatures(h, at, hi - lo, factors, adds)
                nodes = node_hashes(sig.reshape(len(there), trees, depth))
                where = pa.array(there)
                yield pa.RecordBatch.from_arrays([
                    batch["key"].slice(lo, hi - lo).take(where), pa.array(list(nodes), pa.list_(pa.int64())),
                    batch["sketch"].slice(lo, hi - lo).take(where)], ["key", "nodes", "sketch"])

    return members.mapInArrow(profile, "key binary, nodes array<long>, sketch binary")


def paired_blocks(nodes: DataFrame) -> DataFrame:
    """(node, key, sketch) of crowded nodes, given with each member's family so far (root): each
    member once for every block that its own is compared with, under a node for that pair."""
    half = max(1, RUN // 2)
    counts = nodes.groupBy("node", "root").agg(F.count("*").alias("n"))
    sizes = (counts.groupBy("node").agg(F.max(F.struct("n", "root")).alias("largest"), F.sum("n").alias("all"))
             .where("all > largest.n")
             .select("node", F.col("largest.root").alias("largest"), F.ceil(F.col("largest.n") / half).alias("n_a"), F.ceil((F.col("all") - F.col("largest.n")) / half).alias("n_b")))
    inside = F.col("root") == F.col("largest")
    spread = F.xxhash64("key")
    block = F.when(inside, F.pmod(spread, F.col("n_a"))).otherwise(F.col("n_a") + F.pmod(spread, F.col("n_b")))
    other = F.explode(F.sequence(F.when(inside, F.col("n_a")).otherwise(F.lit(0)), F.col("n_a") + F.col("n_b") - 1)).alias("other")
    return (nodes.join(F.broadcast(stored(sizes)), "node").withColumn("block", block).select("*", other).where("block != other")
            .select(F.xxhash64("node", F.least("block", "other"), F.greatest("block", "other")).alias("node"), "key", "sketch"))


def family_edges(texts: DataFrame, classes: DataFrame, threshold: float, recall: float) -> DataFrame:
    """Stars (a, b) of the families over all nodes of both forests."""
    nodes = exploded(classes)
    crowds = crowded(nodes)
    if crowds.isEmpty():
        return stars(nodes, True)
    # hints: a join dealt by node would bring a crowded one to one task
    found = stored(stars(nodes.join(F.broadcast(crowds), "node", "left_anti"), True)
                   .union(stars(nodes.join(F.broadcast(crowds), "node", "left_semi"), False)))
    again = stored(nodes.join(F.broadcast(crowds), "node", "left_semi").select("key").distinct())
    members = classes.join(again, "key").select("doc_id", "key", "sketch")
    held = with_key(packed_texts(texts).join(stored(members), "doc_id")).where("own_key = key").dropDuplicates(["key"])
    further = stored(further_nodes(held.select("key", "sketch", "packed"), *further_forest(threshold, recall)))
    nodes = exploded(further)
    crowds = crowded(nodes)
    edges = found.union(stars(nodes.join(F.broadcast(crowds), "node", "left_anti"), True))
    if crowds.isEmpty():
        return edges
    edges = stored(edges)
    roots = components(edges).select(F.col("node").alias("key"), "root")
    rooted = further.join(roots, "key", "left").select("key", "nodes", "sketch", F.coalesce("root", "key").alias("root"))
    full = stored(rooted.select(F.explode("nodes").alias("node"), "key", "sketch", "root").join(F.broadcast(crowds), "node", "left_semi"))
    return edges.union(stars(paired_blocks(full), True))


def verified(members: DataFrame, threshold: float) -> DataFrame:
    """(key, n_links, root): for each document of a pair of blocks, the number of documents of
    linked classes, and an edge of the forest that spans its links. ``members`` has one row for
    each document and pair of blocks: family, block_a, block_b, block, key, copies, packed."""

    def compare(keys, copies, blocks, texts, same: bool):
        m = len(keys)
        words, row = hashed_words(pa.array(texts, pa.string()))
        h, at, _ = shingles(words, row, m, SHINGLE)
        # numbers for the shingles that at least two documents have; the others never meet
        order = np.lexsort((at, h))
        h, at = h[order], at[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (at[1:] != at[:-1])
        h, at = h[new], at[new]
        sizes = np.bincount(at, minlength=m)
        _, number, often = np.unique(h, return_inverse=True, return_counts=True)
        shared = often[number] > 1
        columns = np.unique(number[shared], return_inverse=True)[1]
        at = at[shared]
        both = np.zeros((m, m), np.float32)
        order = np.argsort(columns, kind="stable")
        at, columns = at[order], columns[order]
        step = max(1, (1 << 22) // m)  # columns of the incidence matrix at once
        for lo in range(0, int(columns[-1]) + 1 if len(columns) else 0, step):
            i, j = np.searchsorted(columns, [lo, lo + step])
            part = np.zeros((m, step), np.float32)
            part[at[i:j], columns[i:j] - lo] = 1
            both += part @ part.T
        linked = both >= threshold * (sizes[:, None] + sizes[None, :] - both) - 1e-6
        np.fill_diagonal(linked, False)
        if not same:
            linked &= blocks[:, None] != blocks[None, :]
        links = linked @ copies
        root = np.full(m, -1)
        for i in range(m):
            if root[i] < 0:
                front, root[i] = [i], i
                while front:
                    front_next = np.flatnonzero(linked[front].any(0) & (root < 0))
                    root[front_next] = i
                    front = front_next.tolist()
        return links, root

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, keys, copies, blocks, texts = None, [], [], [], []

        def close():
            nonlocal keys, copies, blocks, texts
            out = []
            if len(keys) > 1:
                links, root = compare(keys, np.array(copies, np.float64), np.array(blocks), texts, now[1] == now[2])
                out = [(k, int(n), keys[r]) for k, n, r in zip(keys, links, root)]
            keys, copies, blocks, texts = [], [], [], []
            return out

        for batch in batches:
            out = []
            rows = zip(*(batch[c].to_pylist() for c in ("family", "block_a", "block_b", "block", "key", "copies")))
            contents = (t for _, _, part in unpacked(batch["packed"]) for t in part.to_pylist())
            for (family, a, b, block, key, n), text in zip(rows, contents):
                if (family, a, b) != now:
                    out += close()
                    now = family, a, b
                if keys and keys[-1] == key:
                    continue  # a repeated row of the class's document
                keys.append(key)
                copies.append(n)
                blocks.append(block)
                texts.append(text)
            yield link_batch(out)
        yield link_batch(close())

    def link_batch(out):
        return pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.binary()), pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.binary())],
                                          ["key", "n_links", "root"])

    dealt = members.repartition("family", "block_a", "block_b").sortWithinPartitions("family", "block_a", "block_b", "block", "key")
    return dealt.mapInArrow(run, "key binary, n_links long, root binary")


def with_key(texts: DataFrame) -> DataFrame:
    """(doc_id, own_key, packed): texts and the class of their words."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, part in unpacked(batch["packed"]):
                words, row = hashed_words(part)
                keys = class_keys(words, row, hi - lo)
                n = np.bincount(row, minlength=hi - lo)
                own = pa.array([k.tobytes() if c else None for k, c in zip(keys, n)], pa.binary())
                yield pa.RecordBatch.from_arrays([*(batch[c].slice(lo, hi - lo) for c in names), own], [*names, "own_key"])

    names = texts.columns
    kinds = dict(texts.dtypes)
    return texts.mapInArrow(add, ", ".join(f"{n} {kinds[n]}" for n in names) + ", own_key binary")


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """(doc_id, class_id, text_id, n_links) of every row: smallest doc_id of its connected group
    and of the documents with the same words, and the number of other documents linked to it."""
    small_batches(docs.sparkSession)
    texts = texts_of(docs)
    known = stored(profiles(texts, prefix_length(TREES, DEPTH, threshold, recall)))
    part = known.where(F.col("key").isNotNull() & F.col("doc_id").isNotNull())
    classes = stored(part.groupBy("key").agg(F.min(F.struct("doc_id", "nodes", "sketch")).alias("r"), F.count("*").alias("copies"))
                     .select("key", "copies", "r.*"))
    families = components(family_edges(texts, classes, threshold, recall))
    sizes = families.groupBy("root").agg(F.count("*").alias("size"))
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    members = (classes.select("key", "copies", "doc_id").join(families.select(F.col("node").alias("key"), "root"), "key").join(sizes, "root")
               .select("key", "copies", "doc_id", F.col("root").alias("family"), blocks.alias("n_blocks"))
               .withColumn("block", F.pmod(F.xxhash64("key"), F.col("n_blocks")).cast("int")))
    # each member once with its text; then once for every block its own is compared with
    found = with_key(packed_texts(texts).join(stored(members).hint("merge"), "doc_id")).where("own_key = key").drop("own_key", "doc_id")
    other = F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)).alias("other")
    dealt = (found.select("*", other).withColumns({"block_a": F.least("block", "other"), "block_b": F.greatest("block", "other")})
             .select("family", "block_a", "block_b", "block", "key", "copies", "packed"))
    links = stored(verified(dealt, threshold))
    counts = links.groupBy("key").agg(F.sum("n_links").alias("n_links"))
    groups = components(links.select(F.col("key").alias("a"), F.col("root").alias("b")))
    named = (classes.select("key", "copies", F.col("doc_id").alias("text_id")).join(counts, "key", "left")
             .join(groups.select(F.col("node").alias("key"), F.col("root").alias("group")), "key", "left")
             .select("key", "copies", "text_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("group", "key").alias("group")))
    named = stored(named)
    least = named.groupBy("group").agg(F.min("text_id").alias("class_id"))
    named = stored(named.join(least, "group").select("key", "class_id", "text_id", (F.col("n_links") + F.col("copies") - 1).alias("n_links")))
    alone = F.col("doc_id")
    return (known.select("doc_id", F.when(F.col("doc_id").isNotNull(), F.col("key")).alias("key")).join(named, "key", "left")
            .select("doc_id", F.coalesce("class_id", alone).alias("class_id"), F.coalesce("text_id", alone).alias("text_id"), F.coalesce("n_links", F.lit(0)).alias("n_links")))


def keep_one(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents, with all columns, without those whose group has a smaller doc_id. Rows of one
    doc_id are one document and stay or go together; rows with a null doc_id stay."""
    gone = near_duplicates(docs, threshold).where("doc_id <> class_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti")
