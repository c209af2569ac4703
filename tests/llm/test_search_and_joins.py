"""Joins, searches, shards and decontamination against brute force."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from llm_support import SF_DIR, make_docs, worker_path  # noqa: F401 - fixtures
from nextcover.llm.common import components
from nextcover.llm.decontamination import contaminated
from nextcover.llm.jaccard_join import RECALL, THRESHOLD, TREES, DEPTH, joined_stars, near_duplicates, prefix_length
from nextcover.llm.oracles import SQL
from nextcover.llm.queries import QUERIES
from nextcover.llm.sharding import extendible_shards
from nextcover.llm.topk import top_k
from workload.check import duck, rows_of

WORD = re.compile("[0-9a-z\x80-\U0010ffff]+")


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, name):
    got = QUERIES[name](spark, SF_DIR)
    want = duck(SF_DIR).execute(SQL[name])
    assert rows_of(got.columns, [tuple(r) for r in got.collect()]) == rows_of([d[0] for d in want.description], want.fetchall())


def shingle_set(text):
    w = WORD.findall((text or "").lower())
    return {" ".join(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute_links(rows, threshold=0.8):
    sets = [(i, shingle_set(t)) for i, t in rows]
    links = {i: set() for i, _ in rows}
    for i, a in sets:
        for j, b in sets:
            if i != j and a and b and len(a & b) >= threshold * len(a | b) - 1e-9:
                links[i].add(j)
    return links


def near_copies(seed, n):
    r = random.Random(seed)
    base = [f"w{r.randint(0, 500)}" for _ in range(60)]
    rows = []
    for i in range(n):
        w = list(base)
        for _ in range(r.randint(0, 2)):
            w[r.randrange(60)] = f"v{r.randint(0, 99)}"
        rows.append((i, " ".join(w)))
    return rows + [(n + i, " ".join(f"u{r.randint(0, 9999)}" for _ in range(40))) for i in range(30)]


def test_a_group_of_several_blocks_loses_no_link(spark, make_docs, monkeypatch):
    import nextcover.llm.jaccard_join as module

    monkeypatch.setattr(module, "BLOCK", 16)
    rows = near_copies(1, 120)
    links = brute_links(rows)
    got = {r["doc_id"]: r for r in near_duplicates(make_docs(rows)).collect()}
    assert {i: r["n_links"] for i, r in got.items()} == {i: len(x) for i, x in links.items()}
    for i, x in links.items():
        assert all(got[i]["class_id"] == got[j]["class_id"] for j in x)


def crowded_pairs(seed):
    """Pairs at a little over the threshold, of paragraphs that many documents share: at most three of
    six with any other pair, so that nodes are crowded and no family joins the pairs."""
    r = random.Random(seed)
    paragraphs = [[f"p{i}w{j}" for j in range(40)] for i in range(16)]
    chosen = []
    for _ in range(4000):
        c = frozenset(r.sample(range(16), 6))
        if all(len(c & d) <= 3 for d in chosen):
            chosen.append(c)
    rows = []
    for n, c in enumerate(chosen):
        text = [w for i in sorted(c) for w in paragraphs[i]]
        rows.append((2 * n, " ".join(text)))
        for k in range(5):
            text[20 + 45 * k] = f"x{n}y{k}"
        rows.append((2 * n + 1, " ".join(text)))
    return rows


@pytest.mark.parametrize("further_trees", [64, 1])
def test_crowded_nodes_lose_no_pair(spark, make_docs, monkeypatch, further_trees):
    import nextcover.llm.jaccard_join as module

    monkeypatch.setattr(module, "RUN", 2)
    monkeypatch.setattr(module, "LEADERS", 1)
    monkeypatch.setattr(module, "FURTHER_TREES", further_trees, raising=False)
    monkeypatch.setattr(module, "prefix_length", lambda *_: 0)  # every document under every node
    rows = crowded_pairs(5)
    links = brute_links(rows)
    assert sum(map(len, links.values())) >= len(rows) > 60
    got = {r["doc_id"]: r["n_links"] for r in near_duplicates(make_docs(rows)).collect()}
    assert got == {i: len(x) for i, x in links.items()}


def test_both_forests_together_keep_the_recall():
    from nextcover.llm.jaccard_join import FURTHER_TREES, further_forest

    for threshold in (0.5, 0.8, 0.9):
        trees, depth = further_forest(threshold, RECALL)
        first = (1 - threshold ** prefix_length(TREES, DEPTH, threshold, RECALL)) ** TREES
        assert trees <= FURTHER_TREES and first + (1 - threshold ** depth) ** trees <= max(1 - RECALL, first + 1 - RECALL if first >= 1 - RECALL else 0)


def test_join_with_nulls_short_texts_and_ties(spark, make_docs):
    rows = [(1, None), (2, ""), (3, "!!!"), (4, "a b"), (5, "A, b."), (6, "a b c"), (7, "x " * 50000), (7, "x " * 50000), (None, "a b"), (8, "é É é")]
    got = sorted((tuple(r) for r in near_duplicates(make_docs(rows)).collect()), key=repr)
    assert (4, 4, 4, 1) in got and (5, 4, 4, 1) in got and (6, 6, 6, 0) in got and (8, 8, 8, 0) in got
    assert (1, 1, 1, 0) in got and (2, 2, 2, 0) in got and (3, 3, 3, 0) in got and (None, None, None, 0) in got
    assert got.count((7, 7, 7, 1)) == 2
    assert near_duplicates(make_docs([])).collect() == []


def test_prefixes_are_shortened_as_far_as_the_recall_asks():
    n = prefix_length(TREES, DEPTH, THRESHOLD, RECALL)
    assert 1 - (1 - THRESHOLD ** n) ** TREES >= RECALL > 1 - (1 - THRESHOLD ** (n + 1)) ** TREES
    assert prefix_length(1, 4, 0.5, 0.9999) == 1
    assert joined_stars(np.array([[1] * 80, [2] * 80, [1] * 79 + [3]]), 0.55).tolist() == [0, 1, 0]


def test_components_of_paths_and_cycles(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 101), (101, 102), (102, 100), (7, 7)]
    got = dict(tuple(r) for r in components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100, 102: 100}


def brute_top(rows, k):
    ok = [(i, np.floor(256 * np.array(v, float))) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for i, q in ok:
        if i % 50 == 0:
            scored = sorted((-int(q @ x), j) for j, x in ok if j != i and len(x) == len(q))[:k]
            out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(scored)]
    return sorted(out)


def test_top_k_with_ties_nulls_and_lengths(spark, monkeypatch):
    import nextcover.llm.topk as module

    monkeypatch.setattr(module, "REF_BLOCK", 150)
    monkeypatch.setattr(module, "QUERY_BLOCK", 4)
    monkeypatch.setattr(module, "LEAF", 5)
    r = random.Random(3)
    rows = [(i, [r.gauss(i % 3, 0.2) for _ in range(6)]) for i in range(600)]
    rows += [(i, [1.0] * 6) for i in range(600, 900)]  # ties
    rows += [(1000, None), (1001, []), (1002, [1.0, None, 1.0]), (1003, [float("nan")] * 6), (1004, [float("inf")] * 6), (None, [1.0] * 6), (1050, [2.0, 1.0]), (1051, [1.0, 1.0])]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<float>, rank int, score string")
    single = [(i, v and [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    assert sorted(tuple(x) for x in top_k(df, F.col("vec_id") % 50 == 0).collect()) == brute_top(single, 5)
    assert top_k(df.limit(0), F.col("vec_id") % 50 == 0).collect() == []
    huge = [(0, [3e18, 1.0]), (1, [3.0, 1.0]), (2, [-3.0, 5.0])]
    big = top_k(spark.createDataFrame(huge, "vec_id long, embedding array<double>"), F.col("vec_id") == 0, k=2).collect()
    assert [(x["vec_id"], x["rank"]) for x in big] == [(1, 1), (2, 2)] and big[0]["score"] == (1 << 63) - 1


def test_shards_split_only_what_is_too_large(spark):
    df = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", F.octet_length("text").cast("long").alias("n"))
    for limit, bits in ((20_000, 3), (60_000, 12)):
        rows = extendible_shards(df, ["doc_id"], F.col("n"), limit, bits).toPandas()
        size = rows.groupby(["shard", "shard_depth"]).n.agg(["sum", "count"]).reset_index()
        assert ((size["sum"] <= limit) | (size["count"] == 1)).all() and len(rows) == df.count()
        for _, s in size[size["shard_depth"] > 0].iterrows():  # its parent was too large
            depth, prefix = int(s["shard_depth"]), s["shard"].split("-")[1]
            if depth <= 60 and s["sum"] <= limit:
                inside = rows[(rows.shard_depth >= depth) & (rows.shard_depth <= 60)]
                parent = inside[[int(x.split("-")[1]) >> (d - depth + 1) == int(prefix) >> 1 for x, d in zip(inside.shard, inside.shard_depth)]]
                deep = rows[rows.shard_depth > 60]
                assert parent.n.sum() + deep.n.sum() > limit


def test_rows_alike_get_pages_and_keys_split_by_row(spark):
    same = spark.range(100).selectExpr("1 AS k", "'x' AS t", "10 AS b").union(spark.range(50).selectExpr("CAST(NULL AS INT)", "CAST(id AS STRING)", "10"))
    rows = extendible_shards(same, ["k"], F.col("b"), 100).toPandas()
    size = rows.groupby("shard").b.sum()
    assert size.max() <= 100 and size.sum() == 1500 and (rows[rows.t == "x"].groupby("shard").b.sum() == 100).all()
    assert extendible_shards(same.limit(0), ["k"], F.col("b"), 100).collect() == []


def test_shards_of_a_table_with_any_names(spark):
    odd = ["hash", "row_hash", "row", "prefix", "size_0", "depth_0", "bucket", "low", "page", "n", "bytes", "with.dot", "shard", "row_bytes"]
    df = spark.range(40).selectExpr("id AS k", "10 AS b", *(f"concat('{c}', id) AS `{c}`" for c in odd))
    got = extendible_shards(df, ["k"], F.col("b"), 100)
    assert got.columns == ["k", "b", *odd[:-2], "shard_", "row_bytes_", "shard", "shard_depth", "row_bytes"]
    rows = [r.asDict() for r in got.collect()]
    assert sorted(r["k"] for r in rows) == list(range(40)) and all(r["row_bytes"] == 10 and r["shard_"] == f"shard{r['k']}" and r["with.dot"] == f"with.dot{r['k']}" for r in rows)
    sizes = {}
    for r in rows:
        sizes[r["shard"]] = sizes.get(r["shard"], 0) + r["b"]
    assert max(sizes.values()) <= 100 and len(sizes) > 3


def test_op8_finds_every_planted_item(spark):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect()]
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()]
    words = lambda t: " " + " ".join(re.findall(r"\w+", t.lower())) + " "
    want = {(d, i) for i, t in items for d, x in docs if words(t) in words(x)}
    got = {(r["doc_id"], r["item_id"]) for r in QUERIES["op8_template_decontamination"](spark, SF_DIR).collect()}
    assert want and want <= got
    grams = lambda t, n=8: {tuple(w[i:i + n]) for w in [re.findall(r"\w+", t.lower())] for i in range(len(w) - n + 1)}
    text, bench = dict(docs), dict(items)
    assert all(len(grams(text[d]) & grams(bench[i])) >= 0.25 * len(grams(bench[i])) for d, i in got - want)


def test_reparameterised_questions(spark, make_docs):
    question = "A train leaves {0} at {1} km per hour and a bus leaves {0} at {2} km per hour, so when does the train from {0} overtake the bus if it started {1} minutes late"
    items = spark.createDataFrame([(1, question.format("Berlin", 60, 40), "x"), (2, None, "x"), (3, "too short", "x"), (4, "five plain words in here", "x")], "item_id long, text string, doc_id string")
    docs = [(1, "Well. " + question.format("San Jose", "1,250.5", 90) + ". More."), (2, question.format("Berlin", 60, 40)),
            (3, question.replace("from {0}", "from Oslo").replace("{1} minutes", "7 minutes").format("Rome", 60, 40)),
            (4, None), (5, ""), (6, "They are five plain words in here now"), (7, "far away " * 20000), (None, question.format("Paris", 1, 2)), (2, question.format("Berlin", 60, 40))]
    got = {(r["doc_id"], r["item_id"]): r for r in contaminated(make_docs(docs), items).collect()}
    assert {k for k in got if k[1] == 1} == {(1, 1), (2, 1), (None, 1)} and (6, 4) in got
    assert got[1, 1]["reparameterised"] and not got[2, 1]["reparameterised"]
    assert contaminated(make_docs([]), items).collect() == [] and contaminated(make_docs(docs), items.limit(0)).collect() == []


SHORT_ITEMS = {1: "Calculate 12 + 7 * 3 - 5", 2: "Apollo 11 landed on July 20, 1969 near Tranquility Base", 3: "Solve 3x + 5 = 20",
               4: "WHAT IS THE CAPITAL OF FRANCE AND OF SPAIN TODAY", 5: "Why not?", 6: "Define osmosis", 7: "+ = ?", 8: "",
               9: "der Hund und die Katze sahen den Vogel im Garten"}


def plain_words(text):
    return WORD.findall((text or "").lower())


def test_items_of_placeholders_capitals_or_few_words_are_found(spark, make_docs):
    r = random.Random(8)
    fill = lambda n: " ".join(f"w{r.randint(0, 9999)}" for _ in range(n))
    docs = [(100 + i, f"{fill(30)}. {t} {fill(30)}") for i, t in SHORT_ITEMS.items()]
    docs += [(200 + i, t) for i, t in SHORT_ITEMS.items()]
    docs += [(300, SHORT_ITEMS[4].lower()), (301, "calculate 12 7 3 6"), (302, "Der Hund und die Katze sahen den Vogel im Garten"), (303, fill(20_000) + " solve 3x 5 20"),
             (304, "why  NOT"), (305, "why not now"), (306, None)]
    items = spark.createDataFrame(list(SHORT_ITEMS.items()), "item_id long, text string")
    got = {(x["doc_id"], x["item_id"]): x for x in contaminated(make_docs(docs), items).collect()}
    inside = lambda a, b: any(b[j:j + len(a)] == a for j in range(len(b) - len(a) + 1))
    want = set()
    for i, item in ((i, plain_words(t)) for i, t in SHORT_ITEMS.items()):
        want |= {(d, i) for d, x in docs if item and (item == plain_words(x) if len(item) < 4 else inside(item, plain_words(x)))}
    assert set(got) == want
    assert got[304, 5]["found_by"] == "whole" and got[300, 4]["found_by"] == "words" and not any(x["reparameterised"] for x in got.values())


def test_names_that_open_sentences_and_odd_slots(spark, make_docs):
    question = "{0} has {1} red apples. {0} buys {2} more of them. {0} eats one. So how many red apples does {0} have in the end?"
    steady = "If it rains on the first day then the farmer stays at home and reads a long book until the evening, and pays {0} coins and {0} more"
    items = spark.createDataFrame([(1, question.format("John", 3, 2)), (2, steady.format(5))], "item_id long, text string")
    docs = [(1, question.format("Mary", 9, 4)), (2, question.format("John", 3, 2)), (3, steady.replace("{0} more", "8 more").format(5)),
            (4, "Mary has a bike. She rides it. How many bikes does Mary have in the shed?")]
    got = {(x["doc_id"], x["item_id"]): x for x in contaminated(make_docs(docs), items).collect()}
    assert set(got) == {(1, 1), (2, 1), (3, 2)}
    assert got[1, 1]["reparameterised"] and not got[2, 1]["reparameterised"] and not got[3, 2]["reparameterised"]


def test_windows_equal_brute_force(spark, make_docs):
    """Readings by words against sets of word windows, with items and documents of few different words."""
    r = random.Random(9)
    text = lambda n: " ".join(r.choice(["a", "b", "c1", "7", "Du", "e"]) for _ in range(n))
    items, docs = {i: text(r.randint(1, 12)) for i in range(40)}, {i: text(r.randint(0, 60)) for i in range(60)}
    got = {(x["doc_id"], x["item_id"]) for x in contaminated(make_docs(list(docs.items())), spark.createDataFrame(list(items.items()), "item_id long, text string")).collect()}
    for i, item in ((i, plain_words(t)) for i, t in items.items()):
        for d, doc in ((d, plain_words(t)) for d, t in docs.items()):
            if len(item) < 4:
                assert ((d, i) in got) == (item == doc)
            else:
                k = min(8, len(item))
                there = {tuple(doc[j:j + k]) for j in range(len(doc) - k + 1)}
                if 2 * sum(tuple(item[j:j + k]) in there for j in range(len(item) - k + 1)) >= len(item) - k + 1:
                    assert (d, i) in got
