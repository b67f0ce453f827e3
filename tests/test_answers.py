"""Grounding, context packing, link following, sources and the inbox stream."""

import io
import zipfile

from lectern.operators import context, grounding
from lectern.sources import markdown, office, registry
from lectern.streaming import inbox


def test_claims(spark):
    answers = spark.createDataFrame(
        [("q", "The pump lifts 40 litres [2]. The pump lifts 55 litres. The valve is not mentioned in the documents. Zebras dance nightly. Valve pressure stays low [9].")], "qid string, answer string"
    )
    passages = spark.createDataFrame([("q", 1, "Valve pressure stays low in winter."), ("q", 2, "Every hour the pump lifts 40 litres.")], "qid string, n int, text string")
    rows = {r.sent: r for r in grounding.check(answers, passages, 0.5).collect()}
    assert rows[0].cites == [2] and rows[0].support == 1.0 and rows[0].reason is None
    assert [rows[i].reason for i in (1, 2, 3)] == [grounding.NUMBER, grounding.LACKS, grounding.UNSUPPORTED]
    assert rows[4].cites == [1] and rows[1].cites is None
    claims = grounding.check(answers, passages, 0.5)
    assert grounding.render(claims).first().answer == "The pump lifts 40 litres [2]. Valve pressure stays low [1]."
    assert {r.sent: r.evidence for r in grounding.best_evidence(claims, passages).collect()}[0] == "Every hour the pump lifts 40 litres."


def test_context_budget(spark):
    hits = spark.createDataFrame([("q", 1, 7, "aa", 0.5), ("q", 2, 8, "b" * 50, 0.4), ("q", 3, 7, "cc", 0.9), ("q", 4, 9, "d" * 30, 0.1)], "qid string, rank int, section_id long, text string, score double")
    sections = spark.createDataFrame([(7, "aa\nmid\ncc"), (8, "b" * 5000), (9, "d" * 30)], "section_id long, full string")
    rows = context.pack(hits, sections, 80).orderBy("n").collect()
    assert [(r.n, r.section_id, r.whole, len(r.text)) for r in rows] == [(1, 7, True, 9), (2, 8, False, 50)]
    assert rows[0].score == 0.9


def test_one_hop(spark):
    hits = spark.createDataFrame([("q", 1, 10), ("q", 2, 20)], "qid string, rank int, chunk_id long")
    edges = spark.createDataFrame([(10, 20, "figure 1"), (10, 30, "figure 2"), (40, 20, "table 3"), (30, 50, "x")], "src long, dst long, label string")
    got = [(r.chunk_id, r.via) for r in context.follow(hits, edges).orderBy("n").collect()]
    assert got == [(30, 'cited as "figure 2" in [1]'), (40, 'cites [2] as "table 3"')]


MD = "---\nx: 1\n---\n# Pump #\nfirst\nline\n\n```\n# no heading\n```\nSub\n---\n- item\n| a | b |\n|---|---|\n| 1 | 2 |\n![alt](x.png)\n"


def test_markdown():
    got = [(b["kind"], b["level_hint"], b["text"]) for b in markdown.blocks(MD)]
    assert got == [("heading", 1, "Pump"), ("para", None, "first line"), ("para", None, "``` # no heading"), ("heading", 2, "Sub"), ("list_item", None, "item"), ("table", None, ""), ("image", None, "[Figure] alt")]
    assert markdown.blocks(MD)[5]["rows"] == [["a", "b"], ["1", "2"]]
    assert markdown.blocks("---\nnever closed")[0]["kind"] == "para"


def zipped(**files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in files.items():
            z.writestr(name.replace("__", "/").replace("_xml", ".xml"), text)
    return out.getvalue()


W = 'xmlns:w="w"'


def test_office(spark, tmp_path):
    doc = f'<w:document {W}><w:body><w:p><w:pPr><w:pStyle w:val="h"/></w:pPr><w:r><w:t>Title</w:t></w:r></w:p><w:p><w:r><w:t>Some text</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>c1</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>'
    styles = f'<w:styles {W}><w:style w:styleId="h"><w:name w:val="heading 2"/></w:style></w:styles>'
    data = zipped(word__document_xml=doc, word__styles_xml=styles)
    got = office.parse("docx", data)
    assert [(b["kind"], b["level_hint"], b["text"]) for b in got] == [("heading", 2, "Title"), ("para", None, "Some text"), ("table", None, "")]
    sheet = '<worksheet><sheetData><row><c r="A1" t="inlineStr"><is><t>n</t></is></c><c r="B1" t="inlineStr"><is><t>v</t></is></c></row><row><c r="A2"><v>1.50</v></c></row><row><c r="D5"><v>7</v></c></row></sheetData></worksheet>'
    book = '<workbook><sheets><sheet name="Data"/></sheets></workbook>'
    got = office.parse("xlsx", zipped(xl__workbook_xml=book, xl__worksheets__sheet1_xml=sheet))
    assert [b["rows"] for b in got] == [None, [["n", "v"], ["1.5", ""]], [["7"]]]
    (tmp_path / "a.docx").write_bytes(data)
    (tmp_path / "b.docx").write_bytes(b"not a zip")
    (tmp_path / "c.md").write_text(MD)
    (tmp_path / "d.bin").write_bytes(b"x")
    status = {r.path.rsplit("/", 1)[1]: r.status for r in registry.scan(spark, str(tmp_path)).collect()}
    assert status == {"a.docx": "ok", "b.docx": "rejected", "c.md": "ok", "d.bin": "unsupported"}
    assert registry.blocks(spark, str(tmp_path)).filter("kind = 'heading'").count() == 3


def test_inbox(spark, tmp_path):
    box, table, state = tmp_path / "in", tmp_path / "out", tmp_path / "state"
    box.mkdir()
    (box / "a.md").write_text("# A\ntext")
    for _ in range(2):
        inbox.watch(spark, str(box), str(table), str(state)).awaitTermination(60)
        assert spark.read.parquet(str(table)).filter("kind = 'heading'").count() == (1 if not (box / "b.md").exists() else 2)
        (box / "b.md").write_text("# B\ntext")
