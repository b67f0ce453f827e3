"""Fields masked together, thresholds replayed, notes of absence, gates, choices, windows and linked contexts."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from lectern.operators import evals, grounding, pii, rerank, search

VALUES = ["ann@x.org", "Ann@X.org", "bob@y.org", "10.2.3.4", "+1 (555) 010-9999", "4111 1111 1111 1111", "word"]


def test_fields_of_a_document(spark):
    r = random.Random(1)
    rows = [(d, s, None if r.random() < 0.1 else " ".join(r.choice(VALUES) for _ in range(r.randint(0, 6)))) for d in range(30) for s in range(6)]
    df = spark.createDataFrame([(*x, "m", "k") for x in rows], "doc_id long, seq long, text string, masked string, known string").repartition(3)
    masked, counts = pii.mask_fields(df)
    got = {(x.doc_id, x.seq): x.masked for x in masked.collect()}
    want, n = {}, {}
    for d in range(30):
        ids = {}
        for _, s, text in sorted((x for x in rows if x[0] == d), key=lambda x: x[1]):
            if text is not None:
                places = []
                for a, b, label in pii.chosen(text):
                    key = (label, text[a:b].casefold())
                    if key not in ids:
                        n[d, label] = n.get((d, label), 0) + 1
                        ids[key] = f"[{label}_{n[d, label]}]"
                    places.append((a, b, ids[key]))
                text = pii.replaced(text, places)
            want[d, s] = text
    assert got == want and {(x.doc_id, x.label): x.n for x in counts.collect()} == n


def test_text_and_ctx_agree(spark):
    sections = spark.createDataFrame([(1, 10, 0, "Mail ann@x.org", "Top > Mail ann@x.org", "bob@y.org and ann@x.org"), (1, 11, 1, "Other", "Other", None)], "doc_id long, section_id long, ordinal int, title string, path string, summary string")
    chunks = spark.createDataFrame(
        [(1, 100, 10, 0, "first bob@y.org", "Top > Mail ann@x.org\nfirst bob@y.org"), (1, 101, 10, 1, "then ann@x.org", "then ann@x.org"), (1, 102, 11, 2, "cy@z.org", "Other\ncy@z.org")],
        "doc_id long, chunk_id long, section_id long, ordinal int, text string, ctx string",
    )
    heads, texts, counts = pii.mask_sections(sections, chunks)
    assert {(r.chunk_id, r.text, r.ctx) for r in texts.collect()} == {
        (100, "first [EMAIL_1]", "Top > Mail [EMAIL_2]\nfirst [EMAIL_1]"), (101, "then [EMAIL_2]", "then [EMAIL_2]"), (102, "[EMAIL_3]", "Other\n[EMAIL_3]")
    }
    got = {r.section_id: r for r in heads.collect()}
    assert (got[10].title, got[10].card) == ("Mail [EMAIL_2]", "Top > Mail [EMAIL_2]\n[EMAIL_1] and [EMAIL_2]") and got[11].summary is None and got[11].card == "Other"
    assert [tuple(r) for r in counts.collect()] == [(1, "EMAIL", 3)]


def test_replay(spark):
    r = random.Random(2)
    rows = [(None if r.random() < 0.1 else r.choice([-5.0, -1.0, 0.5]), r.choice([0.1, 0.4, None]), r.choice([0.2, 0.9]), r.random() < 0.7) for _ in range(200)]
    axes = ([-4.0, -1.0, 0.0], [0.0, 0.4], [0.5, 0.95])
    got = {(x.relevance, x.support, x.verifier): (x.n, x.score) for x in evals.replay(spark.createDataFrame(rows, "relevance double, support double, verifier double, good boolean"), *axes).collect()}
    for cell in itertools.product(*axes):
        some = [g for a, b, c, g in rows if (a is None or a >= cell[0]) and b is not None and b >= cell[1] and c >= cell[2]]
        assert got[cell] == (len(some), sum(1 if g else -3 for g in some))
    assert len(got) == 12


ABSENT = [
    "The 40th Fibonacci number is not listed in the provided passages.", "This is not mentioned in the document", "No such date is stated in the context.", "The price is not specified in these sources.", "It was not found in the passages above.",
    "Il prezzo non è indicato nei documenti.", "Nessuna data è riportata nel contesto.", "Non è menzionato nelle fonti fornite.", "The answer is not provided in the given documents!", "The year is not stated in those sources provided.",
]
CLAIMS = [
    "He is not the person named, and the contract was given in this document.", "The bug is not found in the source code.", "The name is listed in the document.", "It is not listed. See the document", "No passages were given to him in 1990.",
    "The value is not stated by the document", "Not all parts found in the box are documents of value.", "Il documento non è lungo.", "The law was not provided for in the treaty.", "Nothing is mentioned in the document",
]


@pytest.mark.parametrize(("texts", "is_note"), [(ABSENT, True), (CLAIMS, False)])
def test_notes_of_absence(spark, texts, is_note):
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", F.rlike("t", F.lit(grounding.ABSENT)).alias("x")).collect()
    assert [r.t for r in rows if r.x != is_note] == []


def test_gate_and_choice(spark):
    q = spark.createDataFrame([(1,), (2,), (3,)], "qid long")
    c = spark.createDataFrame([(1, 0.5, ""), (1, 2.0, "cited"), (2, 1.5, None)], "qid long, score double, via string")
    assert {r.qid: r.ok for r in grounding.relevant(q, c, 1.0).collect()} == {1: False, 2: True, 3: False}
    rows = spark.createDataFrame([(1, " A", 0.0), (1, "A", 0.0), (1, "B ", 0.0), (1, "x", 3.0), (2, "y", 0.0)], "req_id long, token string, logprob double")
    got = {(r.req_id, r.label): round(r.p, 6) for r in evals.choice(rows, ["A", "B", "C", "D"]).collect()}
    assert got == {(1, "A"): 0.666667, (1, "B"): 0.333333, (1, "C"): 0.0, (1, "D"): 0.0} | {(2, x): 0.25 for x in "ABCD"}


def test_windows_and_batched_scorer(spark):
    texts = ["", "a" * 1200, "b" * 1201, "c" * 2000, "d" * 2001, "e" * 9999, "start " + "f" * 1500 + " end"]
    df = spark.createDataFrame([(1, i, "q end", t) for i, t in enumerate(texts)], "qid long, id long, question string, text string")
    cut = {r.id: r.w for r in df.select("id", rerank.windows("text").alias("w")).collect()}
    for i, t in enumerate(texts):
        assert cut[i] == ([t] if len(t) <= 1200 else [t[a : a + 1200] for a in range(0, len(t) - 400, 800)][:3])
    longest = rerank.batched(lambda questions, passages: [float(len(p)) for p in passages])
    assert {r.id: r.score for r in rerank.rerank(df, longest).collect()} == {i: float(max(len(w) for w in cut[i])) for i in range(len(texts))}
    assert {r.id: r.score for r in rerank.rerank(df).collect()}[6] == 0.0


HIT = "qid long, rank long, chunk_id long, doc_id long, section_id long, score double, text string"


def test_linked_contexts(spark):
    hits = spark.createDataFrame([(1, 1, 10, 1, 100, 3.0, "seed text"), (1, 2, 11, 1, 101, 2.0, "second"), (2, 1, 12, 1, 102, 1.0, "x" * 500)], HIT)
    linked = [(1, 1, 20, 2, 200, 5.0, "far " * 100, 10, 'cited as "F" in [{n}]'), (1, 2, 21, 1, 101, 4.0, "second", 11, "cites [{n}]"), (1, 3, 22, 3, 300, 1.0, "lost", 99, "gone [{n}]"), (2, 1, 23, 3, 300, 1.0, "y" * 300, 12, "in [{n}]")]
    df = spark.createDataFrame(linked, HIT + ", seed long, via string")
    sections = spark.createDataFrame([(100, "seed text and more"), (101, "second"), (102, "w " * 900)], "section_id long, full string")
    got = {(r.qid, r.n): r for r in search.contexts(hits, df, sections, 1000).collect()}
    assert [(got[1, n].section_id, got[1, n].via) for n in (1, 2, 3)] == [(100, ""), (101, ""), (200, 'cited as "F" in [1]')] and (1, 4) not in got
    # A quarter is kept for linked passages: the long hit is whole, the linked one fits behind it.
    assert len(got[2, 1].text) == 500 and got[2, 2].text == "y" * 300 and got[2, 2].via == "in [1]"
    assert search.contexts(hits.limit(0), df, sections).count() == 0
    tight = {(r.qid, r.n): r for r in search.contexts(hits.filter("qid = 2"), df.filter("qid = 2"), sections, 600).collect()}
    assert len(tight[2, 1].text) == 450 and (2, 2) not in tight  # 150 left: less than the passage and than what is worth adding
