"""Notices against a check of every position in plain Python."""

import random
import re

from llm_support import SF_DIR, make_docs, worker_path  # noqa: F401 - fixtures
from nextcover.llm.licenses import CONTAINMENT, NOTICES, license_scan, recall
from nextcover.llm.queries import QUERIES

WORD = re.compile("[0-9a-z\x80-\U0010ffff]+")


def shingle_list(text):
    w = WORD.findall(text.lower())
    return [" ".join(w[i:i + 5]) for i in range(max(1, len(w) - 4))] if w else []


def brute(text):
    """Names of the notices some stretch of the text holds."""
    found, s = set(), shingle_list(text or "")
    for name, notice in NOTICES.items():
        own = shingle_list(notice)
        n = len(own)
        for a in range(max(1, len(s) - n + 1)):
            if len(set(s[a:a + n]) & set(own)) >= CONTAINMENT * len(set(own)):
                found.add(name)
    return found


def test_op1_equals_brute_force(spark):
    got = {}
    for r in QUERIES["op1_license_scan"](spark, SF_DIR).collect():
        got.setdefault(r["doc_id"], set()).add(r["license"])
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}
    want = {i: brute(t) for i, t in texts.items()}
    assert got == {i: w for i, w in want.items() if w} and got


def test_places_edits_and_repeats(spark, make_docs):
    r = random.Random(5)
    noise = lambda n: " ".join(f"w{r.randint(0, 999)}" for _ in range(n))
    mit = " ".join(NOTICES["MIT text"].split())
    edited = mit.replace("free of charge", "free of any charge")
    rows = [(1, f"É {noise(30)}. {mit} {noise(9)}"), (2, f"{noise(300)} {edited}"), (3, None), (4, ""), (None, "Released under the MIT License."),
            (5, "Released under the MIT License. " * 2), (5, "Released under the MIT License. " * 2), (6, "mit license"), (7, noise(30000)),
            (8, mit[:len(mit) // 2])]
    got = license_scan(make_docs(rows)).collect()
    by = {}
    for x in got:
        by.setdefault(x["doc_id"], []).append(x)
    assert set(by) == {1, 2, 5, None}
    text = rows[0][1].encode()
    assert text[by[1][0]["start"]:by[1][0]["stop"]].decode() == mit and by[1][0]["containment"] == 1
    assert by[2][0]["license"] == "MIT text" and by[2][0]["containment"] < 1
    assert len(by[5]) == 4 and len(by[None]) == 1
    assert license_scan(make_docs([])).collect() == []
    assert license_scan(make_docs(rows), {"none": None, "no words": "!!"}).collect() == []


def test_adjoining_notices_are_each_a_place(spark, make_docs):
    names = ["MIT text", "BSD-3-Clause", "GPL-2.0 header", "Unlicense"]
    notice = {n: " ".join(NOTICES[n].split()) for n in names}
    rows = [(i, " ".join([notice[n]] * 3)) for i, n in enumerate(names)]
    rows += [(10 + i, "intro words here " * 7 + " ".join([notice[n]] * 5) + " tail") for i, n in enumerate(names)]
    rows += [(20, " ".join([notice["Unlicense"], notice["MIT text"], notice["Unlicense"]]))]
    found = license_scan(make_docs(rows)).collect()
    for i, text in rows[:-1]:
        name = names[i % 10]
        size, start = len(notice[name].encode()), text.index(notice[name])
        own = sorted((r["start"], r["stop"]) for r in found if r["doc_id"] == i and r["license"] == name)
        assert [(a, b) for a, b in own] == [(start + k * (size + 1), start + k * (size + 1) + len(notice[name].rstrip(".").encode())) for k in range(3 if i < 10 else 5)], (name, own)
    assert [r["license"] for r in found if r["doc_id"] == 20] == ["Unlicense", "MIT text", "Unlicense"]


def test_variants_of_lines_and_the_closest_of_a_family(spark, make_docs):
    texts = {1: "Code here. Licensed under the MIT License.", 2: "Photos are licensed under CC BY-SA 4.0 unless noted", 3: NOTICES["LGPL-3.0 header"],
             4: NOTICES["GPL-2.0 header"], 5: NOTICES["AGPL-3.0 header"], 6: "clean words of a page about the law of licences and of software " * 20}
    got = {}
    for r in license_scan(make_docs(list(texts.items()))).collect():
        if r["closest"]:
            got.setdefault(r["doc_id"], set()).add(r["license"])
    assert got[1] == {"MIT line"} and "CC-BY-SA-4.0 line" in got[2] and "LGPL-3.0 header" in got[3]
    assert "GPL-2.0 header" in got[4] and "GPL-3.0 header" not in got[4] and "AGPL-3.0 header" in got[5] and 6 not in got


def test_sentences_in_another_order_are_one_place(spark, make_docs):
    w = " ".join(NOTICES["MIT text"].split()).split()
    swapped = " ".join(w[len(w) // 2:] + w[:len(w) // 2])
    got = license_scan(make_docs([(1, swapped)]), {"m": NOTICES["MIT text"]}).collect()
    assert len(got) == 1 and got[0]["containment"] > 0.9


def test_bands_find_windows_an_eighth_off():
    assert recall(0.875 / 1.125) > 0.999
