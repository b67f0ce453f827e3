"""Phrases over positions and citations by name or identifier, against plain Python."""

import random
import re

import pytest

from lectern.operators import links, mentions, phrases

WORDS = "the on of motion small bodies held in resting fluid heat flow cells Gamma x7 über".split()


def sentence(r, n):
    return "".join(r.choice(WORDS) + r.choice([" ", " ", "  ", ", ", "\n", ". "]) for _ in range(n))


def brute_mentions(text, keys, own):
    """What a regular expression of all names, the longest first, finds."""
    found = {}
    for kind in ("name", "proper"):
        mine = {k: d for k, t, d in keys if t == kind and d != own}
        if mine:
            body = "|".join(r"\s+".join(map(re.escape, k.split(" "))) for k in sorted(mine, key=len, reverse=True))
            for m in re.finditer(rf"(?<!\w)({body})(?!\w)", text, re.I if kind == "name" else 0):
                key = " ".join(m.group().split())
                found.setdefault(mine[key.lower() if kind == "name" else key], m.group())
    return found


@pytest.mark.parametrize("limit", [mentions.BROADCAST, 10])
def test_mentions_against_brute_force(spark, limit):
    r = random.Random(4)
    keys = {}
    for d in range(60):
        words = [r.choice(WORDS) for _ in range(r.choice([1, 2, 2, 3, 4, 10]))]
        keys.setdefault((words[0].title(), "proper") if len(words) == 1 else (" ".join(words).lower(), "name"), d)
    keys |= {("on the", "name"): 900, ("(on the) motion", "name"): 901, ("small bodies held", "name"): 902, ("small bodies", "name"): 903, ("u.s. heat-flow", "name"): 904}
    texts = [(i, i % 70, sentence(r, 40)) for i in range(2000)] + [(5000, 1, None), (5001, 1, ""), (5002, 2, "A (On  the) Motion of U.S. heat-flow; SMALL\nbodies heldx small bodies Held")]
    rows = [(k, t, d) for (k, t), d in keys.items()]
    known = spark.createDataFrame(rows, "key string, kind string, doc_id long")
    chunks = spark.createDataFrame([(*t, "x") for t in texts], "chunk_id long, doc_id long, text string, label string").repartition(4)
    got = {}
    for x in mentions.find(chunks, known, limit).collect():
        got.setdefault((x.chunk_id, x.src_doc), {})[x.dst_doc] = x.label
    want = {(i, own): m for i, own, text in texts if (m := brute_mentions(text or "", rows, own))}
    assert got == want and want[5002, 2] == {901: "(On  the) Motion", 903: "SMALL\nbodies", 904: "U.S. heat-flow", 902: "small bodies Held"} | {k: v for k, v in want[5002, 2].items() if k < 900}


@pytest.mark.parametrize("limit", [mentions.BROADCAST, 1000])
def test_a_hundred_thousand_names(spark, limit):
    known = spark.range(100_000).selectExpr("concat('history of item ', id) AS key", "'name' AS kind", "id AS doc_id")
    chunks = spark.createDataFrame([(i, -1, f"See the History of item {i * 997} and history of item {i * 997}x.") for i in range(50)], "chunk_id long, doc_id long, text string")
    assert {(r.chunk_id, r.dst_doc, r.label) for r in mentions.find(chunks, known, limit).collect()} == {(i, i * 997, f"History of item {i * 997}") for i in range(50)}


def test_directory_and_identifiers(spark):
    text = "See arXiv:1706.03762v5, doi 10.1145/3292500.3330701. and Legge n. 241/1990, D.Lgs. 196/2003, decreto legislativo 30 giugno 2003, n. 197, Regolamento (UE) 2016/679."
    docs = spark.createDataFrame(
        [(1, "Attention Is All", "a.md", "arXiv:1706.03762"), (2, "Beta Paper", "b.md", "see arXiv:1111.22222"), (3, "Gamma Paper", "c.md", "arXiv:1111.22222"), (4, "Attention is  all - Wikipedia", "d.md", ""), (5, "The", "e.md", None)],
        "doc_id long, title string, path string, head string",
    )
    keys = mentions.directory(docs)
    assert {tuple(r) for r in keys.collect()} == {("attention is all", "name", 1), ("beta paper", "name", 2), ("gamma paper", "name", 3), ("arxiv:1706.03762", "ident", 1)}
    ids = spark.createDataFrame([(text,), ("reported 12/2020 revenue",), (None,)], "t string").select(links.identifiers("t").alias("x")).collect()
    assert set(ids[0].x) == {"arxiv:1706.03762", "doi:10.1145/3292500.3330701", "act:241/1990", "act:196/2003", "act:197/2003", "act:2016/679"} and ids[1].x == [] and not ids[2].x
    chunks = spark.createDataFrame([(1, 2, "We build on Attention Is All (V.) and on arXiv:1706.03762."), (2, 3, "as arXiv:1706.03762 says"), (3, 1, "Attention is all, arXiv:1706.03762")], "chunk_id long, doc_id long, text string")
    assert {tuple(r) for r in mentions.find(chunks, keys).collect()} == {(1, 2, 1, "Attention Is All"), (2, 3, 1, "1706.03762")}


def test_phrases_against_brute_force(spark):
    r = random.Random(9)
    texts = [(i, sentence(r, r.choice([0, 1, 5, 60]))) for i in range(300)] + [(900, None), (901, "the the the the"), (902, "motion " * 20_000)]
    cut = lambda t: re.findall(r"[^\W_]+", (t or "").lower().replace("ü", "u"))
    asked = [" ".join(cut(sentence(r, r.choice([1, 2, 3, 4])))) for _ in range(60)] + ["the the", "the the the", "unheard of", "", "motion motion motion"]
    docs = spark.createDataFrame([(*t, "x", 1) for t in texts], "doc_id long, text string, term string, dl int")
    held = phrases.index(docs)
    got = {(x.phrase, x.doc_id): list(x.starts) for x in phrases.matches(spark.createDataFrame([(a,) for a in asked * 2], "phrase string"), held, 1000).collect()}
    want = {}
    for a in set(asked) - {""}:
        p = a.split(" ")
        for d, t in texts:
            w = cut(t)
            if s := [i for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]:
                want[a, d] = s
    assert got == want
    named = spark.createDataFrame([(901, "the the"), (901, "the the"), (5, "the the"), (6, "")], "owner long, phrase string")
    found = {tuple(x) for x in phrases.matching(named, held, 10).collect()}
    assert found == {(d, o) for (a, d) in want if a == "the the" for o in (5,) if o != d}
    assert phrases.matches(spark.createDataFrame([("a b",)], "phrase string"), phrases.index(docs.limit(0)), 10).count() == 0
