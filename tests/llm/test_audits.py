"""Divergence of sources, interaction of filters and line dedup against plain Python."""

import hashlib
import itertools
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from llm_support import SF_DIR, make_docs, worker_path  # noqa: F401 - fixtures
from nextcover.llm import divergence as dv
from nextcover.llm import filter_audit as fa
from nextcover.llm import line_dedup as ld
from nextcover.llm.queries import QUERIES

DOCS = "doc_id long, text string, lang string, source string, n_chars long, hash string, term string, mask int, docs long"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "h", "t", 3, 9) for r in rows], DOCS)


def labels_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


# sources

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")


def plain_divergence(rows, least_docs, top=50):
    docs = [(lang or "", source or "", TERM.findall(lower(text or ""))) for _, text, lang, source in rows]
    held, counts, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for lang, source, terms in docs:
        held[lang].update(set(terms))
        groups[lang].add(source)
        counts[lang, source].update(terms)
    out = []
    for lang, sources in groups.items():
        kept = {t for t, n in held[lang].items() if n >= least_docs}
        v = len(kept)

        def share(c):
            total = sum(c[t] for t in kept)
            return {t: 1 + 1000000000 * (c[t] + 5) // (total + 5 * v) for t in kept}

        p = {s: share(counts[lang, s]) for s in sources}
        q = share(sum((counts[lang, s] for s in sources), Counter()))
        for s in sources:
            pairs = [(o, sum(abs(p[s][t] - p[o][t]) for t in kept)) for o in sources - {s}]
            terms = [(t, p[s][t] - q[t]) for t in kept if counts[lang, s][t] > 0 and p[s][t] > q[t]]
            for part, items, most in (("pair", pairs, None), ("term", terms, top)):
                items.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, i, value, r) for r, (i, value) in enumerate(items[:most], 1)]
    return sorted(out)


def random_docs(seed, n):
    r = random.Random(seed)
    words = ["the", "The", "café", "Émile", "ÉMILE", "a" * 40, "a" * 41, "abcdefgh", "abcdefghi", "x", "ß", "日本", "naïve-té", "12a", "_b", "zz"]
    rows = [(i, " ".join(r.choice(words) for _ in range(r.choice([0, 1, 3, 30]))), r.choice(["en", "fr", None, ""]),
             r.choice(["s1", "s2", "s3", None, "日", "é"])) for i in range(n)]
    return rows + [(1, None, "en", "s1"), (None, "the the", "en", "empty"), (2, "1234 !", "lone", "only"), (3, "", "two", "a"), (4, None, "two", "b")]


def test_pointers_sort_like_the_terms():
    r = np.random.default_rng(5)
    words = [bytes(r.choice(list(b"abc\xc3\xa9z"), r.integers(1, 30)).tolist()) for _ in range(900)] + [b"abcdefgh", b"abcdefghabcdefgh", b"abcdefgha"]
    terms = [words[i] for i in r.zipf(1.3, 40000) % len(words)]  # more than one small slice, with crowded terms
    data = np.frombuffer(b" ".join(terms), np.uint8)
    ends = np.cumsum([len(t) + 1 for t in terms]) - 1
    starts = ends - [len(t) for t in terms]
    pointers, new = dv.sorted_pointers(data, starts, ends)
    assert pointers.tolist() == sorted(range(len(terms)), key=terms.__getitem__)
    assert new.tolist() == [i == 0 or terms[p] != terms[pointers[i - 1]] for i, p in enumerate(pointers)]


@pytest.mark.parametrize("settings", [{}, {"sources": 2, "cell_rows": 3}, {"sources": 1, "cell_rows": 1, "top": 2}])
def test_divergence_equals_plain_python(spark, settings):
    rows = random_docs(1, 120)
    got = dv.divergence(frame(spark, rows), least_docs=4, **settings).collect()
    assert sorted(tuple(r) for r in got) == plain_divergence(rows, 4, settings.get("top", 50))


def test_divergence_of_given_documents(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text", "lang", "source").collect()]
    assert sorted(tuple(r) for r in QUERIES["op11_source_divergence"](spark, SF_DIR).collect()) == plain_divergence(rows, 30)


def test_long_texts_are_cut_between_terms(spark):
    rows = [(i, f"alpha beta {'gamma ' * 300}{'d' * 90} alpha", "en", f"s{i % 3}") for i in range(9)] + [(10, "e" * 5000, "en", "s0"), (11, "f" * 64, "en", "s1")]
    want = Counter()
    docs = Counter()
    for _, text, lang, source in rows:
        want.update((lang, source, t) for t in TERM.findall(text))
        docs.update((lang, source, t) for t in set(TERM.findall(text)))
    got = dv.term_counts(frame(spark, rows), most=64).collect()
    assert {tuple(r)[:3]: (r["docs"], r["n"]) for r in got} == {k: (docs[k], n) for k, n in want.items()}


def test_divergence_of_nothing(spark):
    assert dv.divergence(frame(spark, [])).collect() == []


def test_shares_stay_exact_beyond_long(spark):
    n, total, v = 4 * 10**15 + 1, 9 * 10**15 + 7, 3 * 10**7
    got = spark.createDataFrame([(n, total, v)], "n long, total long, v long").select(dv.share("n", "total", "v")).first()[0]
    assert got == 1 + 1000000000 * (n + 5) // (total + 5 * v)


# filters

WORD = re.compile("[^\x20\x09-\x0d]+")


def plain_masks(texts):
    out = []
    for t in texts:
        words = WORD.findall(t)
        out.append(sum(f << i for i, f in enumerate((
            len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), bool(re.search("[#$%&*|]", t))))))
    return out


def plain_audit(rows, labels):
    texts = [t or "" for _, t, _ in rows]
    least = {}
    for (i, _, _), t in zip(rows, texts):
        if i is not None:
            least[t] = min(i, least.get(t, i))
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, x in labels if x == 1 and i is not None}
    parts = defaultdict(list)
    for (i, _, source), t, m in zip(rows, texts, plain_masks(texts)):
        m |= 16 * (i is not None and i > least[t])
        parts[source or ""].append((m, i in good, i in toxic))
    out = []
    for part, docs in parts.items():
        found, shapley = [], Counter()
        for order in itertools.permutations("ABCDE"):
            left = docs
            for step, letter in enumerate(order, 1):
                bit = 1 << "ABCDE".index(letter)
                removed = [d for d in left if d[0] & bit]
                left = [d for d in left if not d[0] & bit]
                fails = sum(1 for d in docs if d[0] & bit)
                shapley[letter] += len(removed)
                found.append([part, "".join(order), step, len(left), len(removed), fails - len(removed), sum(1 for d in docs if d[0] == bit),
                              sum(d[1] for d in removed), sum(d[2] for d in removed), letter])
        out += [(*r[:-1], shapley[r[-1]]) for r in found]
    return sorted(out)


def test_masks_equal_plain_python():
    r = random.Random(3)
    texts = ["", " ", "\n", "a", "É" * 100 + "AB", "É" * 101 + "ABC", "A" * 2 + "b" * 98, "A" * 3 + "b" * 97, "x\x0by\x0cz\x1ca b", "#", "w " * 200, "w " * 199,
             " ".join(map(str, range(200))), " ".join([*map(str, range(100)), *["z"] * 100]), " ".join([*map(str, range(99)), *["z"] * 101])]
    texts += ["".join(r.choice(" \tabAB%é\n") for _ in range(r.randint(0, 900))) for _ in range(200)]
    assert fa.failure_masks(pa.array(texts)).tolist() == plain_masks(texts)
    assert [x for t in texts for x in fa.failure_masks(pa.array([t]))] == plain_masks(texts)


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5])
def test_swaps_visit_every_order_once(n):
    order, seen = list(range(n)), {tuple(range(n))}
    for level in fa.adjacent_swaps(n):
        order[level:level + 2] = order[level + 1], order[level]
        assert tuple(order) not in seen
        seen.add(tuple(order))
    assert len(seen) == len(list(itertools.permutations(range(n))))


def test_diagram_shares_equal_nodes_and_stays_small():
    same = fa.Diagram({m: (1, 0, 0) for m in range(32)}, 5)
    assert len(same.nodes) == 7  # nothing, one leaf and one node for each filter
    for level in fa.adjacent_swaps(5):
        same.swap(level)
        assert [kept[0] for _, kept, _ in same.steps()] == [16, 8, 4, 2, 1]


def test_audit_equals_plain_python(spark):
    r = random.Random(8)
    pool = ["", None, "plain words here", "A B C", "50 % off", "w " * 250, " ".join(map(str, range(300))), " ".join(map(str, range(300))) + " #", "Z " * 300]
    rows = [(i, r.choice(pool), r.choice(["s1", "s2", None, ""])) for i in range(60)]
    rows += [(None, "plain words here", "s1"), (None, "alone", "s2"), (5, rows[5][1], rows[5][2]), (0, "w " * 250, "s3"), (0, "w " * 250, "s1")]
    labels = [(i, r.choice([0, 1, None]), r.choice([0, 1, None])) for i in range(0, 60, 2)] + [(4, 1, 0), (4, 0, 1), (None, 1, 1)]
    got = fa.filter_audit(frame(spark, [(i, t, "x", s) for i, t, s in rows]), labels_of(spark, labels)).collect()
    assert sorted(tuple(x) for x in got) == plain_audit(rows, labels)


def test_audit_of_given_documents(spark):
    rows = [tuple(x) for x in spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text", "source").collect()]
    labels = [tuple(x) for x in spark.read.parquet(f"{SF_DIR}/labels.parquet").select("doc_id", "quality", "toxic").collect()]
    assert sorted(tuple(x) for x in QUERIES["op12_filter_audit"](spark, SF_DIR).collect()) == plain_audit(rows, labels)


def test_audit_of_nothing(spark):
    assert fa.filter_audit(frame(spark, []), labels_of(spark, [(1, 1, 1)])).collect() == []
    assert fa.filter_audit(frame(spark, [(1, "a", "x", "s")]), labels_of(spark, [])).count() == 600


# lines

def line_key(line):
    return lower(line.strip(" \t\n\x0b\x0c\r"))


def plain_lines(rows, least_docs=5, least_chars=40):
    ids = lambda i: ld.SMALLEST if i is None else i
    holders = defaultdict(set)
    for i, text in rows:
        for line in (text or "").split("\n"):
            if len(line_key(line)) >= least_chars:
                holders[line_key(line)].add(ids(i))
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        left = [x for x in lines if len(held := holders[line_key(x)]) < least_docs or max(held) == ids(i)]
        out.append((i, len(lines), len(lines) - len(left), hashlib.sha256("\n".join(left).encode()).hexdigest()))
    return sorted(out, key=repr)


def random_lines(seed, n):
    r = random.Random(seed)
    pool = [("Shared line number %02d " % k) * 2 for k in range(12)] + ["short", "", "É" * 39, "É" * 40, "é" * 40, "İ" * 45, "x" * 40, "X" * 40, " \t" + "x" * 40 + "\r", " " + "x" * 40]
    rows = [(r.randrange(10**9), "\n".join(r.choice(pool) for _ in range(r.randint(0, 9)))) for _ in range(n)]
    return rows + [(None, "x" * 40), (None, "x" * 40 + "\n"), (rows[0][0], rows[0][1]), (rows[0][0], "x" * 40 + "\nother"), (7, None), (8, "\n\n"), (9, "x" * 100000)]


@pytest.mark.parametrize("batches", [1, 2, 3, 7])
def test_lines_equal_plain_python_whatever_the_batches(spark, make_docs, batches):
    rows = random_lines(batches, 60)
    kept = ld.without_repeated_lines(make_docs(rows), batches=batches).collect()
    got = [(x["doc_id"], x["n_lines"], x["n_dropped"], hashlib.sha256(x["kept"].encode()).hexdigest()) for x in kept]
    assert sorted(got, key=repr) == plain_lines(rows)


def test_lines_of_given_documents(spark):
    rows = [tuple(x) for x in spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted((tuple(x) for x in QUERIES["op13_line_runs"](spark, SF_DIR).collect()), key=repr)
    assert got == plain_lines(rows)
    assert sum(x[2] for x in got) > 0


def test_no_lines(spark, make_docs):
    assert ld.line_digests(make_docs([])).collect() == []
    assert ld.line_digests(make_docs([(1, None)])).collect()[0]["kept_sha256"] == hashlib.sha256(b"").hexdigest()


def test_runs_are_merged_by_level_and_settled_keys_stay_out(spark):
    index, want = ld.LineRuns(spark, least_docs=3), Counter()
    last = {}
    for batch in range(6):
        rows = [(bytes([k]) * 16, 1 + (k + batch) % 3, 100 - 10 * batch - k) for k in range(batch, 8)]
        settled = {h for run in index.runs() for h, docs, _ in spark.table(run[0]).collect() if docs >= 3}
        index.add(spark.createDataFrame(rows, "hash binary, docs long, last long"))
        for h, docs, i in rows:
            if h not in settled:
                want[bytes(h)] += docs
            last[h] = max(i, last.get(h, i))
        assert [len(level) for level in index.levels] == [int(x) for x in reversed(bin(batch + 1)[2:])]
    got = {bytes(r["hash"]): r["last"] for r in index.repeated().collect()}
    assert got == {h: last[h] for h, n in want.items() if n >= 3}
    names = [run[0] for run in index.runs()]
    index.close()
    assert not any(spark.catalog.tableExists(n) for n in names)


def test_a_merge_of_runs_moves_no_run(spark):
    index = ld.LineRuns(spark)
    rows = spark.range(1000).selectExpr("unhex(md5(cast(id as string))) hash", "1l docs", "id last")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        index._written(rows, 0)
        index._written(rows, 0)
        plan = index._merged(*index.levels[0])._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "SortMergeJoin" in plan and "Exchange" not in plan
    index.close()
