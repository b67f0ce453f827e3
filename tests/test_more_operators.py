"""Aliases, PDF lines, cards, grading and the store."""

from lectern.operators import aliases, cards, evals, pdf_lines, tables


def test_aliases(spark):
    docs = spark.createDataFrame(
        [(1, "Alan Turing - Wikipedia", "x/at.html"), (2, "PyTorch", "b.md"), (3, "Chapter two", "c.md"), (4, "Paper", "my_long_file.pdf"), (5, "General Rule (GR)", "e.md")], "doc_id long, title string, path string"
    )
    got = {(r.doc_id, r.alias) for r in aliases.names(docs).collect()}
    assert got == {(1, "alan turing"), (2, "PyTorch"), (4, "my long file"), (5, "general rule")} or got == {(1, "alan turing"), (2, "PyTorch"), (4, "my long file"), (5, "general rule"), (5, "GR")}


def test_pdf_lines(spark):
    rows = []
    for p in (1, 2, 3):
        rows += [(1, p, 0, "Report 2024", 9.0, False, 780.0, 790.0, 0, 800.0), (1, p, 1, "Body of a para-", 11.0, False, 400.0, 410.0, 1, 800.0), (1, p, 2, "graph here", 11.0, False, 380.0, 390.0, 1, 800.0), (1, p, 3, f"{p}", 9.0, False, 5.0, 15.0, 2, 800.0)]
    lines = spark.createDataFrame(rows, "doc_id long, page int, line int, text string, size double, bold boolean, y0 double, y1 double, box int, page_height double")
    kept = pdf_lines.boilerplate(lines)
    assert {r.text for r in kept.collect()} == {"Body of a para-", "graph here"}
    assert [r.text for r in pdf_lines.merge(kept).collect()] == ["Body of a paragraph here"] * 3
    assert pdf_lines.scanned(kept).count() == 3


def test_cards(spark):
    s = spark.createDataFrame([(1, 0, None, 1, "Top", "w " * 70), (1, 1, 0, 2, "Sub", ""), (1, 2, 0, 2, "Other", "x")], "doc_id long, ordinal int, parent int, level int, title string, text string")
    got = {r.ordinal: r.card for r in cards.section_cards(s).collect()}
    assert got[0].endswith(" ...\nSubsections: Sub; Other") and got[2] == "x"
    assert cards.document_cards(s).first().card.endswith("Outline: Top; Sub; Other")


def test_grading(spark):
    run = spark.createDataFrame([("a", "It is 1,720 m [1]", True, [["1720"]]), ("b", "no", True, [["x"], ["y", "z"]]), ("c", "", False, [["x"]]), ("d", "made up", True, None)], "id string, answer_text string, answered boolean, answer array<array<string>>")
    got = {r.id: r.outcome for r in evals.outcomes(run).collect()}
    assert got == {"a": "correct", "b": "wrong", "c": "refused", "d": "hallucinated"}
    graded = spark.createDataFrame([("s", o) for o in got.values()], "set string, outcome string")
    assert {r.set: r.precision for r in evals.report(graded).collect()} == {"s": 0.333333, "ALL": 0.333333}


def test_store(spark):
    docs = spark.createDataFrame([(1, "t1", "a"), (2, "t2", "b")], "doc_id long, title string, path string")
    links = spark.createDataFrame([(1, 2), (2, 2)], "src_doc long, dst_doc long")
    left = tables.without({"documents": docs, "links": links}, docs.filter("doc_id = 1"))
    assert left["documents"].count() == 1 and left["links"].count() == 1
    chunks = spark.createDataFrame([(1, 1, 5, 1, "b"), (2, 1, 5, 0, "a"), (3, 1, 6, 0, "c")], "chunk_id long, doc_id long, section_id long, ordinal int, text string")
    assert {r.section_id: r.full for r in tables.section_texts(chunks).collect()} == {5: "a\nb", 6: "c"}
    assert {r.chunk_id for r in tables.heads(chunks).collect()} == {1, 2}
    assert {r.path for r in tables.relocated(docs, spark.createDataFrame([(1, "z")], "doc_id long, to string")).collect()} == {"z", "b"}
