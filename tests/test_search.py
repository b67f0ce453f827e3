"""Search queries on small tables of our own."""

import random

from lectern.plans import search


def test_contamination_finds_whatever_stands_beside(spark):
    long = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    items = [(1, long), (2, "alpha beta gamma delta epsilon zeta eta theta"), (3, "beta gamma"), (4, "b"), (5, ""), (6, None), (7, " gamma "), (8, "one two three"), (9, "...")]
    docs = [(1, f'x "{long}." y'), (2, long), (3, "alpha"), (4, "(one two three)"), (5, "xone two threex"), (6, None), (7, ""), (8, "one  two three..."), (9, long[1:-1])]
    r = random.Random(3)
    make = lambda n: "".join(r.choice("ab .") for _ in range(n))
    items += [(100 + i, make(r.randint(1, 9))) for i in range(40)]
    docs += [(100 + i, make(r.randint(1, 60))) for i in range(40)]
    want = sorted((q, d) for q, item in items for d, text in docs if item is not None and text is not None and item in text)
    got = search.contaminated(spark.createDataFrame(items, "qid long, item string"), spark.createDataFrame(docs, "doc_id long, text string"))
    assert sorted(tuple(r) for r in got.collect()) == want


def test_a_hit_holds_the_whole_evidence(spark):
    evidence = "The long passage counts 1,720 words \u2013 and it\u2019s changed only after its sixtieth character, here"
    rows = [(1, 1, evidence[:70], evidence), (1, 2, "So: " + evidence.upper().replace("1,720", "1720").replace(" ", "\n") + ".", evidence), (2, 1, evidence[:65] + "other", evidence), (3, 1, "x", "x")]
    hits = spark.createDataFrame(rows, "qid long, rank int, text string, evidence string")
    assert tuple(search.hit_counts(hits).first()) == (3, 1, 2, 2)
