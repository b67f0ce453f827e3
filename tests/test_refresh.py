"""Tables published together, and the reference graph after random batches against one built from scratch."""

import random

import pytest

from lectern.operators import links, refresh, tables
from lectern.versions import Conflict, Versions

#: Twenty were run once; each takes seconds of job overhead here.
STEPS = 4
CHUNKS = "chunk_id long, doc_id long, text string, kind string, loc string"
DOCS = "doc_id long, title string, path string, head string"
HEADS = "doc_id long, ordinal long, title string, first_chunk long"


def rows(df):
    return sorted((tuple(r) for r in df.select("src", "src_doc", "dst_doc", "dst", "kind", "label").collect()), key=repr)


def test_links_inside(spark):
    chunks = [
        (1, 1, "See Figure 2 and TAB. 1, then fig 2; Section 4, § 4, art. 4 and Appendix B", "text", "p1"), (2, 1, "Figure 2: loss, see Figure 2", "text", "p2"), (3, 1, None, "image", "p2"),
        (4, 1, "Table 1. Rates\nFigura 3b follows", "text", ""), (5, 1, "", "image", ""), (6, 2, "Figure 2 elsewhere, config 2 is none", "text", "p2"), (7, 1, "prefigure 2", "text", "p9"),
    ]
    heads = [(1, 0, "3 Method", 1), (1, 1, "4. Results", 2), (1, 2, "4 Again", 4), (1, 3, "Articolo 4", 5), (1, 4, "Allegato B", 7), (1, 5, "Closing", 1)]
    got = {(r.src, r.dst, r.kind, r.label) for r in links.inside(spark.createDataFrame(chunks, CHUNKS), spark.createDataFrame(heads, HEADS)).collect()}
    assert got == {(1, 2, "figure", "fig 2"), (1, 3, "figure", "fig 2"), (1, 4, "table", "TAB. 1"), (1, 2, "section", "§ 4"), (1, 5, "section", "art. 4"), (1, 7, "section", "Appendix B")}


def test_versions(spark, tmp_path):
    store = Versions(spark, str(tmp_path / "v"), {"a": "id", "b": "id"}, 4)
    two = lambda s: spark.createDataFrame([(i, s) for i in range(20)], "id long, v string")
    every = [0, 1, 2, 3]
    assert store.publish({"a": (two("x"), every), "b": (two("x"), every)}) == 1
    before = store.manifest()
    changed = store.of(spark.createDataFrame([(3,)], "doc_id long"))
    some = two("y").join(store.read("a", changed).select("id"), "id", "left_semi")
    broken = two("z").selectExpr("id", "raise_error('boom') AS v")
    with pytest.raises(Exception, match="boom"):
        store.publish({"a": (some, changed), "b": (broken, changed)})
    assert store.manifest() == before and {r.v for r in store.read("a").collect()} == {"x"}
    held = store.read("a")
    assert store.publish({"a": (some, changed), "b": (some, changed)}) == 2
    assert {r.v for r in held.collect()} == {"x"} and {r.v for r in store.read("a", changed).collect()} == {"y"}
    assert store.read("a").count() == 20 and store.read("b").filter("v = 'y'").count() == some.count()
    untouched = set(map(str, every)) - set(map(str, changed))
    assert {b: before["tables"]["a"]["files"].get(b) for b in untouched} == {b: store.manifest()["tables"]["a"]["files"].get(b) for b in untouched}
    with pytest.raises(Conflict):
        store.publish({"a": (some, changed)}, before)
    assert store.publish({"a": (two("x").limit(0), every)}) == 3 and store.read("a").count() == 0


def test_refresh_equals_a_rebuild(spark, tmp_path):
    r = random.Random(5)
    titles = ["Alpha Report", "Beta Handbook", "Alpha Report Annex", "Gamma", "GammaX", "Delta Paper - Wikipedia", "Report Annex Notes", "Beta Handbook"]
    idents = ["arXiv:1706.03762", "arXiv:1111.22222", "doi 10.1145/33.77", "Legge n. 241/1990", ""]

    def document(d):
        say = lambda: " ".join(r.choice([*titles, *idents, "Figure 1", "Section 2", "and", "the"]) for _ in range(r.randint(0, 5)))
        chunks = [(d * 10 + i, d, ("Figure 1: " if r.random() < 0.2 else "") + say(), r.choice(["text", "image"]), r.choice(["p1", ""])) for i in range(r.randint(1, 3))]
        return (d, r.choice(titles), f"{d}.md", r.choice(idents)), chunks, [(d, 0, r.choice(["2 Body", "Intro"]), chunks[0][0])]

    graph, state = refresh.Graph(spark, str(tmp_path / "g"), 3), {}

    def frames(ids):
        mine = [state[d] for d in ids]
        one = lambda data, schema: spark.createDataFrame(data, schema).coalesce(1)
        return one([m[0] for m in mine], DOCS), one([c for m in mine for c in m[1]], CHUNKS), one([h for m in mine for h in m[2]], HEADS)

    kinds = set()
    for step in range(STEPS):
        changed = r.sample(range(14), r.randint(1, 3)) if step else range(8)
        gone = [d for d in state if d not in changed and step and r.random() < 0.1]
        for d in gone:
            del state[d]
        state |= {d: document(d) for d in changed}
        graph.refresh(*frames(changed), gone=spark.createDataFrame([(d,) for d in gone], "doc_id long") if gone else None)
        if step:
            got, want = rows(graph.edges()), rows(refresh.full(*frames(state)))
            assert got == want, step
            kinds |= {e[4] for e in want}
    assert kinds == {"doc", "figure", "section"}
