"""Each stage of the corpus pipeline against brute force over its own input."""

import random
import re

import pytest

import corpus_pipeline
from llm_support import SF_DIR, make_docs, worker_path  # noqa: F401 - fixtures
from test_search_and_joins import brute_links
from test_suffix_dedup import without_shared_words


@pytest.fixture(scope="module")
def stages(spark):
    """What each stage returned, in order; the first entry is the documents table."""
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out.append(stage(spark, out[-1], SF_DIR).cache())
        out[-1].count()
    return out


def ids(df):
    return sorted(r["doc_id"] for r in df.select("doc_id").collect())


def texts(df):
    return {r["doc_id"]: r["text"] for r in df.select("doc_id", "text").collect()}


def test_stages_keep_the_columns_of_documents(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "repeated_passages", "decontamination", "packing"]
    for df in stages[1:-1]:
        assert df.dtypes == stages[0].dtypes


def test_toxicity_drops_few_ordinary_documents(spark, stages):
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{SF_DIR}/labels.parquet").collect()}
    gone = set(ids(stages[0])) - set(ids(stages[1]))
    ordinary = [i for i, t in labels.items() if t == 0]
    assert sum(i in gone for i in ordinary) <= 0.02 * len(ordinary)


def test_one_of_each_group_stays(stages):
    rows = list(texts(stages[1]).items())
    links, kept, seen = brute_links(rows), set(), set()
    for i in sorted(links):
        if i not in seen:
            kept.add(i)
            group, front = {i}, [i]
            while front:
                front = [j for x in front for j in links[x] if j not in group and not group.add(j)]
            seen |= group
    assert ids(stages[2]) == sorted(kept)


def test_passages_are_cut(stages):
    rows = list(texts(stages[2]).items())
    want = {i: t for i, t in without_shared_words(rows, corpus_pipeline.PASSAGE_WORDS)}
    after = texts(stages[3])
    assert after == {i: t for i, t in want.items() if t.strip(" ") or t == (dict(rows)[i] or "")}
    assert after != dict(rows) and all(r["n_chars"] == len(r["text"]) for r in stages[3].collect())


def test_passages_of_short_words_are_cut(spark, make_docs):
    r = random.Random(4)
    short = " ".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(51))
    fifty = " ".join(f"longer{r.randint(0, 9999)}" for _ in range(50))
    tail = lambda: " ".join(f"u{r.randint(0, 99999)}" for _ in range(30))
    docs = [(1, f"{tail()} {short} {tail()}"), (2, f"{tail()} {short.replace(' ', chr(10))} {tail()}"), (3, f"{tail()} {fifty} {tail()}"), (4, f"{tail()} {fifty} {tail()}")]
    got = texts(corpus_pipeline.repeated_passages(spark, make_docs(docs), SF_DIR))
    assert short not in got[1] and short.replace(" ", "\n") not in got[2] and len(got[1].split()) == len(got[2].split()) == 60
    assert got[3] == docs[2][1] and got[4] == docs[3][1]


def test_benchmark_items_are_gone(spark, stages):
    words = lambda t: " " + " ".join(re.findall(r"\w+", t.lower())) + " "
    items = [words(r["text"]) for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect()]
    before, after = texts(stages[3]), texts(stages[4])
    assert {i for i, t in before.items() if any(x in words(t) for x in items)}.isdisjoint(after)
    assert all(after[i] == before[i] for i in after)


def test_packing_takes_all_that_is_left_and_run_is_the_same(spark, stages):
    assert set(ids(stages[5])) == set(ids(stages[4]))
    key = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF_DIR).select(*key).collect())) == sorted(map(tuple, stages[5].select(*key).collect()))


def test_nulls_ties_extra_columns_and_empty_tables(spark, tmp_path):
    r = random.Random(2)
    passage = " ".join(f"w{r.randint(0, 9999)}" for _ in range(60))
    tails = [" ".join(f"{c}{r.randint(0, 9999)}" for _ in range(120)) for c in "uv"]
    rows = [(1, None), (2, ""), (3, "a b c d e f g h"), (4, "a b c d e f g h"), (None, "no id here"), (5, f"one two {passage} {tails[0]}"), (6, f"four {passage} {tails[1]}"),
            (7, "x" * 40_000), (8, "tie"), (8, "tie")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or ""), "h", 1.5, "p") for i, t in rows],
                                 "doc_id long, text string, lang string, source string, n_chars long, hash string, score double, row_key string")
    folder = str(tmp_path)
    spark.createDataFrame([(1, 1, 0), (3, 1, None)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, "never seen in any of the texts here")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    for rows_left, start in ((docs, docs.count()), (docs.limit(0), 0)):
        for name, stage in corpus_pipeline.STAGES:
            found = stage(spark, rows_left, folder)
            if name != "packing":
                assert found.dtypes == docs.dtypes
                rows_left = found.cache()
        left = {(x["doc_id"], x["text"]) for x in rows_left.collect()}
        if start:
            assert {(1, None), (2, ""), (None, "no id here"), (3, "a b c d e f g h"), (5, "one two  " + tails[0]), (6, "four  " + tails[1])} <= left and 4 not in {i for i, _ in left}
        else:
            assert not left and found.count() == 0
