"""Blocks of DOCX, PPTX and XLSX files from their zipped XML, with the standard library alone."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree as ET

import pandas as pd
from pyspark.sql import DataFrame

from lectern.sources.markdown import SCHEMA

# Heading style names in five languages.
HEADING = re.compile(r"(?i)^(?:heading|titolo|überschrift|titre|t[ií]tulo)\s*([1-9])$")


def _tag(e: ET.Element) -> str:
    return e.tag.rsplit("}", 1)[-1]


def _all(e: ET.Element, name: str) -> list[ET.Element]:
    return [x for x in e.iter() if _tag(x) == name]


def _attr(e: ET.Element, name: str) -> str | None:
    return next((v for k, v in e.attrib.items() if k.rsplit("}", 1)[-1] == name), None)


def _text(e: ET.Element) -> str:
    return "".join((x.text or "") if _tag(x) == "t" else "\t" if _tag(x) == "tab" else "" for x in e.iter()).strip()


def _rows(table: ET.Element) -> list[list[str]]:
    rows = [[_text(c) for c in r if _tag(c) == "tc"] for r in table.iter() if _tag(r) == "tr"]
    return [r for r in rows if any(r)]


def docx(z: zipfile.ZipFile) -> list[dict]:
    names = {}
    if "word/styles.xml" in z.namelist():
        for s in _all(ET.fromstring(z.read("word/styles.xml")), "style"):
            name = next((x for x in s if _tag(x) == "name"), None)
            names[_attr(s, "styleId")] = _attr(name, "val") if name is not None else None
    body = _all(ET.fromstring(z.read("word/document.xml")), "body")[0]
    out = []
    for e in body:
        if _tag(e) == "tbl":
            out.append({"kind": "table", "level_hint": None, "text": "", "rows": _rows(e)})
        elif _tag(e) == "p" and (text := _text(e)):
            style = next((_attr(x, "val") for x in e.iter() if _tag(x) == "pStyle"), None)
            label = names.get(style) or style or ""
            outline = next((_attr(x, "val") for x in e.iter() if _tag(x) == "outlineLvl"), None)
            level = int(m[1]) if (m := HEADING.match(label)) else 1 if label.lower() == "title" else int(outline) + 1 if outline and int(outline) < 9 else None
            listed = any(_tag(x) == "numPr" for x in e.iter()) or label.lower().startswith("list")
            kind = "heading" if level else "list_item" if listed else "para"
            out.append({"kind": kind, "level_hint": level, "text": text, "rows": None})
    return out


def pptx(z: zipfile.ZipFile) -> list[dict]:
    slides = sorted((n for n in z.namelist() if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)), key=lambda n: int(re.findall(r"\d+", n)[0]))
    out = []
    for number, name in enumerate(slides, 1):
        title, rest = "", []
        for shape in [x for x in ET.fromstring(z.read(name)).iter() if _tag(x) in ("sp", "graphicFrame")]:
            off = next((x for x in shape.iter() if _tag(x) == "off"), None)
            place = (int(_attr(off, "y") or 0), int(_attr(off, "x") or 0)) if off is not None else (0, 0)
            holder = next((_attr(x, "type") for x in shape.iter() if _tag(x) == "ph"), None)
            if _tag(shape) == "graphicFrame":
                rest += [(place, {"kind": "table", "level_hint": None, "text": "", "rows": _rows(t)}) for t in _all(shape, "tbl")]
            elif holder in ("title", "ctrTitle") and not title:
                title = " ".join(t for p in _all(shape, "p") if (t := _text(p)))
            else:
                rest += [(place, {"kind": "para", "level_hint": None, "text": t, "rows": None}) for p in _all(shape, "p") if (t := _text(p))]
        out.append({"kind": "heading", "level_hint": 1, "text": title or f"Slide {number}", "rows": None})
        out += [b for _, b in sorted(rest, key=lambda x: x[0])]
    return out


def _number(text: str) -> str:
    try:
        return f"{float(text):.6g}"
    except ValueError:
        return text.strip()


def _place(ref: str) -> tuple[int, int]:
    letters, row = re.fullmatch(r"\$?([A-Z]+)\$?(\d+)", ref).groups()
    col = 0
    for x in letters:
        col = col * 26 + ord(x) - 64
    return int(row), col


def sheets(z: zipfile.ZipFile) -> Iterator[tuple[str, list[tuple[int, int, str, bool]], list[tuple[int, int, int, int]]]]:
    """(name, filled cells as (row, column, value, bold), merged ranges as (rows, then columns, from and to)) of visible sheets."""
    names = z.namelist()
    strings = [_text(s) for s in _all(ET.fromstring(z.read("xl/sharedStrings.xml")), "si")] if "xl/sharedStrings.xml" in names else []
    bold: list[bool] = []
    if "xl/styles.xml" in names:
        styles = ET.fromstring(z.read("xl/styles.xml"))
        fonts = [any(_tag(x) == "b" and _attr(x, "val") not in ("0", "false") for x in f) for group in _all(styles, "fonts") for f in group]
        bold = [fonts[int(_attr(x, "fontId") or 0)] if fonts else False for group in _all(styles, "cellXfs") for x in group]
    for k, sheet in enumerate(_all(ET.fromstring(z.read("xl/workbook.xml")), "sheet"), 1):
        if _attr(sheet, "state") in ("hidden", "veryHidden"):
            continue
        root = ET.fromstring(z.read(f"xl/worksheets/sheet{k}.xml"))
        cells = []
        for c in _all(root, "c"):
            v = next((x.text or "" for x in c.iter() if _tag(x) == "v"), "")
            value = strings[int(v)] if _attr(c, "t") == "s" and v else _text(c) if _attr(c, "t") == "inlineStr" else _number(v)
            style = int(_attr(c, "s") or 0)
            if value:
                cells.append((*_place(_attr(c, "r") or "A1"), value, style < len(bold) and bold[style]))
        ends = [[_place(x) for x in (_attr(m, "ref") or "A1").split(":")] for m in _all(root, "mergeCell")]
        yield _attr(sheet, "name") or f"Sheet {k}", cells, [(e[0][0], e[-1][0], e[0][1], e[-1][1]) for e in ends]


def xlsx(z: zipfile.ZipFile) -> list[dict]:
    """A heading per sheet and a table per region: runs of filled rows, then of filled columns."""
    out = []
    for name, cells, _ in sheets(z):
        out.append({"kind": "heading", "level_hint": 1, "text": name, "rows": None})
        grid = {(r, c): v for r, c, v, _ in cells}
        for a, b in _islands({r for r, _ in grid}):
            for c, d in _islands({x for r, x in grid if a <= r <= b}):
                out.append({"kind": "table", "level_hint": None, "text": "", "rows": [[grid.get((r, x), "") for x in range(c, d + 1)] for r in range(a, b + 1)]})
    return out


#: Rows of a sheet's cells, and of its merged ranges (kind), as ``operators.sheets`` takes them; sheet is path!name.
CELLS = "kind string, sheet string, r int, c int, v string, bold boolean, m_r1 int, m_c1 int"


def cells(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """binaryFile rows of spreadsheets -> (cells, merged) of ``operators.sheets``; files that cannot be read have none (``read`` tells why)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in CELLS.split(", ")]
        for pdf in batches:
            for path, content in zip(pdf.path, pdf.content, strict=True):
                try:
                    with zipfile.ZipFile(io.BytesIO(bytes(content))) as z:
                        rows = [("cell", f"{path}!{name}", r, c, v, b, None, None) for name, some, _ in sheets(z) for r, c, v, b in some]
                        rows += [("merged", f"{path}!{name}", r0, c0, None, None, r1, c1) for name, _, ranges in sheets(z) for r0, r1, c0, c1 in ranges]
                except (zipfile.BadZipFile, KeyError, ET.ParseError, IndexError, ValueError, AttributeError):
                    continue
                yield pd.DataFrame(rows, columns=names).astype({"m_r1": "Int32", "m_c1": "Int32", "bold": "boolean"})

    every = files.select("path", "content").mapInPandas(run, CELLS)
    merged = every.filter("kind = 'merged'").selectExpr("sheet", "r AS m_r0", "m_r1", "c AS m_c0", "m_c1")
    return every.filter("kind = 'cell'").select("sheet", "r", "c", "v", "bold"), merged


def _islands(places: set[int]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for p in sorted(places):
        if out and p == out[-1][1] + 1:
            out[-1] = out[-1][0], p
        else:
            out.append((p, p))
    return out


READERS = {"docx": docx, "pptx": pptx, "xlsx": xlsx}


def parse(suffix: str, content: bytes) -> list[dict]:
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        return READERS[suffix](z)


def read(files: DataFrame) -> DataFrame:
    """binaryFile rows with an office suffix -> blocks; a file that cannot be read gives one block of
    kind ``failed`` with the reason."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, content in zip(pdf.path, pdf.content, strict=True):
                try:
                    found = parse(path.rsplit(".", 1)[-1].lower(), bytes(content))
                except (zipfile.BadZipFile, KeyError, ET.ParseError, IndexError, ValueError) as e:
                    found = [{"kind": "failed", "level_hint": None, "text": f"{type(e).__name__}: {e}", "rows": None}]
                rows += [{"path": path, "idx": i, **b} for i, b in enumerate(found)]
            yield pd.DataFrame(rows, columns=["path", "idx", "kind", "level_hint", "text", "rows"]).astype({"level_hint": "Int32"})

    return files.select("path", "content").mapInPandas(run, SCHEMA)
