"""The cascade, section chunks and Markdown blocks on small inputs, and packing against a plain loop."""

import random

import pytest
from pyspark.sql import functions as F

from lectern.operators import cascade, section_chunks
from lectern.sources import markdown

BLOCKS = "doc_id string, idx long, kind string, text string, level_hint int, size double, bold boolean, style string, format string"


def doc(name, lines, form="docx"):
    """lines: (text, {columns})"""
    rows = []
    for i, (text, more) in enumerate(lines):
        b = {"kind": "para", "level_hint": None, "size": None, "bold": False, "style": "body"} | more
        rows.append((name, i, b["kind"], text, b["level_hint"], b["size"], b["bold"], b["style"], form))
    return rows


BODY = ("some running text that goes on for quite a while here.", {"size": 11.0})


def run(spark, rows, **more):
    levels, verdicts = cascade.infer(spark.createDataFrame(rows, BLOCKS), **more)
    found = {}
    for r in levels.filter("level IS NOT NULL").collect():
        found.setdefault(r.doc_id, {})[r.idx] = (r.level, r.ambiguous)
    return found, {r.doc_id: (r.strategy, round(r.confidence, 3)) for r in verdicts.collect()}


def test_strategies(spark):
    rows = doc("explicit", [("One", {"kind": "heading", "level_hint": 1}), BODY, ("Two", {"kind": "heading", "level_hint": 2})])
    rows += doc("sizes", [("Title", {"size": 20.0}), BODY, ("Part", {"size": 14.0}), BODY, ("Other part", {"size": 14.0}), BODY])
    rows += doc("bold", [("First topic", {"size": 11.0, "bold": True}), BODY, ("Next topic", {"size": 11.0, "bold": True}), BODY])
    rows += doc("numbers", [("1 Scope", {}), BODY, ("1.1 Terms", {}), BODY, ("Chapter 4", {}), ("Art. 5", {})])
    rows += doc("weak", [(f"{i} Point", {}) for i in range(1, 6)])
    rows += doc("none", [BODY, BODY])
    rows += doc("shape", [("OVERVIEW", {}), ("x " * 60, {}), ("Some words", {}), ("y " * 60, {})], "pdf")
    rows += doc("outline", [("Top", {"level_hint": 1, "kind": "heading"}), ("1.1 Terms", {}), ("1.2 More", {}), ("2 Weak", {}), ("Next", {"level_hint": 1, "kind": "heading"})], "pdf")
    levels, verdicts = run(spark, rows)
    assert verdicts["explicit"] == ("explicit", 0.95) and levels["explicit"] == {0: (1, False), 2: (2, False)}
    assert verdicts["sizes"] == ("typography", 0.85) and levels["sizes"] == {0: (1, False), 2: (2, False), 4: (2, False)}
    assert verdicts["bold"] == ("typography", 0.35) and levels["bold"] == {0: (1, True), 2: (1, True)}
    assert verdicts["numbers"][0] == "numbering" and levels["numbers"] == {0: (1, True), 2: (2, False), 4: (1, False), 5: (2, False)}
    assert levels["weak"] == {0: (1, True), 2: (1, True), 4: (1, True)}
    assert verdicts["none"] == ("none", 0.6) and "none" not in levels
    assert verdicts["shape"] == ("shape", 0.6) and levels["shape"] == {0: (1, False), 2: (1, True)}
    assert verdicts["outline"] == ("outline+numbering", 0.9) and levels["outline"] == {0: (1, False), 1: (2, False), 2: (2, False), 4: (1, False)}


def test_profile_overrides_and_outline(spark):
    rows = doc("a", [("Intro", {"style": "big"}), BODY, ("1 Scope", {}), ("1.1 Terms", {}), ("2 End", {})])
    profile = spark.createDataFrame([("docx", "big", 2), ("docx", "body", 0)], "format string, style string, level long")
    levels, verdicts = run(spark, rows, profile=profile)
    assert verdicts["a"] == ("profile", 0.9) and levels["a"] == {0: (2, False)}
    said = spark.createDataFrame([("a", "2 End", 0), ("a", "Intro", 3)], "doc_id string, text string, level long")
    levels, _ = run(spark, rows, overrides=said)
    assert levels["a"] == {0: (3, False), 2: (1, True), 3: (2, False)}
    blocks = spark.createDataFrame(rows, BLOCKS)
    got = {r.idx: r.outline for r in cascade.outline_before(blocks, cascade.infer(blocks)[0]).collect()}
    assert got == {2: [], 4: ["1.1 Terms"]}


def test_many_bold_lines_are_no_headings(spark):
    rows = doc("a", [("Bold line", {"size": 11.0, "bold": True})] * 15 + [("Large", {"size": 20.0})] + [BODY] * 8)
    levels, verdicts = run(spark, rows)
    assert verdicts["a"] == ("none", 0.6) or levels["a"] == {15: (1, False)}


CHUNKED = "section_id long, idx long, kind string, text string, loc string, rows array<array<string>>, header int"


def test_table_chunks(spark):
    rows = [["note", ""], ["n", "a|b"]] + [[str(i), "v"] for i in range(45)]
    wide = [["h"]] + [["w " * 100] for _ in range(5)]
    blocks = spark.createDataFrame([(1, 0, "table", "", "t1", rows, 1), (1, 1, "table", "", "t2", [["h"]], 0), (1, 2, "table", "", "t3", wide, 0)], CHUNKED)
    got = {(r.idx, r.part): (r.text, r.loc) for r in section_chunks.table_chunks(blocks).collect()}
    assert [got[0, p][1] for p in range(3)] == ["t1 rows 1-20", "t1 rows 21-40", "t1 rows 41-45"]
    assert got[0, 0][0].startswith("note\n| n | a\\|b |\n| --- | --- |\n| 0 | v |") and got[0, 1][0].startswith("| n |")
    assert got[1, 0] == ("| h |\n| --- |", "t2")
    assert [got[2, p][1] for p in range(3)] == ["t3 rows 1-2", "t3 rows 3-4", "t3 rows 5-5"]


def test_packing_against_a_loop(spark):
    r = random.Random(2)
    blocks, want = [], {}
    for s in range(12):
        out, buf, used = [], [], 0
        for i in range(r.randint(1, 30)):
            kind = r.choice(["para"] * 6 + ["list_item", "image", "table"])
            text = " ".join(["w%d" % i] * r.randint(1, 90))
            blocks.append((s, i, kind, text, f"p{i}", [["h"], ["v"]] if kind == "table" else None, 0))
            if kind in ("image", "table"):
                out += [("text", "\n".join(buf))] * bool(buf) + [(kind, text if kind == "image" else "| h |\n| --- |\n| v |")]
                buf, used = [], 0
                continue
            line = "- " * (kind == "list_item") + text
            n = len(line.split())
            if buf and used + n > section_chunks.TARGET_WORDS:
                out.append(("text", "\n".join(buf)))
                buf, used = [], 0
            buf.append(line)
            used += n
        want[s] = out + [("text", "\n".join(buf))] * bool(buf)
    got = {}
    for x in section_chunks.chunk(spark.createDataFrame(blocks, CHUNKED)).orderBy("section_id", "ordinal").collect():
        got.setdefault(x.section_id, []).append((x.kind, x.text))
    assert got == want


@pytest.mark.parametrize(
    "text, want",
    [
        ("a\n---\nb", [("heading", 2, "a"), ("para", None, "b")]),
        ("a\nb\n---", [("para", None, "a b ---")]),
        ("- a\n===", [("list_item", None, "a"), ("para", None, "===")]),
        ("~~~\nx | y\n|--|\n# z", [("para", None, "~~~ x | y |--| # z")]),
        ("x | y\n-|-\n1 | 2", [("para", None, "x | y -|- 1 | 2")]),
        ("text\nx | y\n--|--\n1 | 2\nend", [("para", None, "text"), ("table", None, ""), ("para", None, "end")]),
        ("## Two ##\n#no", [("heading", 2, "Two"), ("para", None, "#no")]),
        ("1. one\n2) two\n\n![](x.png)", [("list_item", None, "one"), ("list_item", None, "two")]),
        ("", []),
    ],
)
def test_markdown_blocks(text, want):
    assert [(b["kind"], b["level_hint"], b["text"]) for b in markdown.blocks(text)] == want


def test_titles(spark):
    rows = [("/x/a.md", 0, "heading", 2, "Two"), ("/x/a.md", 1, "heading", 1, "One"), ("/x/b.v2.md", 0, "para", None, "t")]
    found = spark.createDataFrame(rows, "path string, idx int, kind string, level_hint int, text string")
    assert {r.path: r.title for r in markdown.titles(found).collect()} == {"/x/a.md": "One", "/x/b.v2.md": "b.v2"}
    assert found.select(F.lit(1)).count() == 3
