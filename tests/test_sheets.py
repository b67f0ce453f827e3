"""Regions, titles, headers and borrowed headers of cells against a plain loop over each sheet."""

import io
import random
import re
import zipfile

from lectern.operators import sheets
from lectern.sources import office

CELLS = "sheet string, r int, c int, v string, bold boolean"


def grid(name, rows, bold=(), r0=1, c0=1):
    return [(name, r0 + i, c0 + j, v, i in bold) for i, row in enumerate(rows) for j, v in enumerate(row)]


def number(x):
    return bool(re.fullmatch(r"[+-]?(\d+\.?\d*|\.\d+)(e[+-]?\d+)?", x.replace(",", ".").replace("%", "").replace("€", "").replace("$", "").strip(), re.I))


def letter(c):
    out = ""
    while c:
        c, x = divmod(c - 1, 26)
        out = chr(65 + x) + out
    return out


def brute(cells):
    out = []
    for sheet in {c[0] for c in cells}:
        at = {(r, c): (v, b) for s, r, c, v, b in cells if s == sheet and v}
        runs = lambda xs: [r for x in sorted(xs) for r in [x] if x - 1 not in xs]
        stop = lambda xs, a: next(x for x in range(a, max(xs) + 2) if x not in xs) - 1
        lines, last = {r for r, _ in at}, {}
        for a in runs(lines):
            z = stop(lines, a)
            cols = {c for r, c in at if a <= r <= z}
            for c0 in runs(cols):
                c1, top = stop(cols, c0), a
                row = lambda r: [at.get((r, c), ("", False)) for c in range(c0, c1 + 1)]  # noqa: B023, E731
                while z - top + 1 > 2 and sum(bool(v) for v, _ in row(top)) == 1:
                    top += 1
                n, scores = z - top + 1, []
                for i in range(min(5, n)):
                    filled, below = [v for v, _ in row(top + i) if v], [v for v, _ in row(top + i + 1) if v]
                    if not filled or top + i == z:
                        scores.append(0.0)
                        continue
                    s = 0.45 * sum(not number(v) for v in filled) / len(filled) + 0.25 * len(filled) / (c1 - c0 + 1)
                    s += 0.2 * (sum(map(number, below)) / len(below) if below else 0) + (0.1 if any(b for v, b in row(top + i) if v) else 0)
                    scores.append(round(s * 0.95**i, 9))
                best = scores.index(max(scores))
                order = sorted(scores, reverse=True)
                unsure = n > 1 and (order[0] < 0.5 or len(order) > 1 and order[0] - order[1] < 0.15)
                first = [v for v, _ in row(top) if v]
                bare = n > 1 and len(first) > 1 and sum(map(number, first[1:])) / (len(first) - 1) >= 0.5
                prev = last.get((c0, c1))
                if prev and bare and prev[1] - prev[0] + 1 <= 3:
                    names = [" / ".join(dict.fromkeys(v for r in range(prev[0], prev[1] + 1) if (v := at.get((r, c), ("",))[0]))) or f"col{c - c0 + 1}" for c in range(c0, c1 + 1)]
                    best, unsure = -1, False
                else:
                    names = [v or f"col{letter(c0 + j)}" for j, (v, _) in enumerate(row(top + best))]
                    last[c0, c1] = (top, z)
                out.append((sheet, f"{letter(c0)}{top}:{letter(c1)}{z}", best, unsure, tuple(names)))
    return sorted(out)


def got(df):
    return sorted((r.sheet, r.range, r.header_row, r.ambiguous, tuple(r.names)) for r in df.collect())


def test_report_sheets(spark):
    cells = grid("Sales", [["Sales 2025"], ["Region", "Q1", "Q2"], ["North", "1", "2"], ["South", "3", "4"]], bold=(1,)) + grid("Sales", [["Staff"], ["Name", "Age"], ["Ann", "30"]], bold=(1,), r0=6)
    cells += grid("Text", [["Name", "Qty", "Price"], ["Widget", "many", "cheap"], ["Gadget", "few", "dear"]])
    cells += grid("Report", [["Year", "Sales"], ["", "EUR"]]) + grid("Report", [["2020", "5"], ["2021", "6"]], r0=4) + grid("Report", [["2022", "7"], ["2023", "8"], ["2024", "9"]], r0=7)
    df = spark.createDataFrame(cells, CELLS)
    found = {(r.sheet, r.range): r for r in sheets.tables(df).collect()}
    assert found["Sales", "A2:C4"].names == ["Region", "Q1", "Q2"] and not found["Sales", "A2:C4"].ambiguous
    assert found["Text", "A1:C3"].ambiguous
    assert found["Report", "A4:B5"].header_row == -1 and found["Report", "A4:B5"].names == ["Year", "Sales / EUR"] == found["Report", "A7:B9"].names
    assert {(r.sheet, r.text) for r in sheets.titles(sheets.rows_of(sheets.regions(df))).collect()} == {("Sales", "Sales 2025"), ("Sales", "Staff")}
    assert got(sheets.tables(df)) == brute(cells) and sheets.tables(df.limit(0)).count() == 0


def test_merged_names(spark):
    cells = grid("M", [["", "Income", "", "x"], ["Year", "Net", "Gross", "x"], ["2020", "1", "2", "3"], ["2021", "1", "2", "3"]], bold=(1,))
    merged = spark.createDataFrame([("M", 1, 1, 2, 3)], "sheet string, m_r0 int, m_r1 int, m_c0 int, m_c1 int")
    (t,) = sheets.tables(spark.createDataFrame(cells, CELLS), merged).collect()
    assert t.header_row == 1 and t.names == ["Year", "Income / Net", "Income / Gross", "x"]


def test_random_sheets(spark):
    r = random.Random(2)
    cells = []
    for s in range(60):
        dense = r.choice([0.5, 0.8, 0.95])
        for i in range(1, r.randint(3, 25)):
            if r.random() < 0.2:
                continue
            numeric = r.random() < 0.6
            for c in range(1, r.choice([3, 4, 5, 30])):
                if r.random() < dense and (c % 7 or r.random() < 0.1):
                    cells.append((f"s{s}", i, c, r.choice(["1", "2,5", "3%", "4€", "x1"]) if numeric and r.random() < 0.9 else r.choice(["ab", "c", "Total", "", None]), r.random() < 0.1))
    assert got(sheets.tables(spark.createDataFrame(cells, CELLS))) == brute(cells)


def test_cells_of_a_workbook(spark):
    book = '<workbook><sheets><sheet name="Sales"/><sheet name="Gone" state="hidden"/></sheets></workbook>'
    styles = "<styleSheet><fonts><font/><font><b/></font></fonts><cellXfs><xf fontId='0'/><xf fontId='1'/></cellXfs></styleSheet>"
    cell = lambda ref, v, s=0: f'<c r="{ref}" t="inlineStr" s="{s}"><is><t>{v}</t></is></c>' if not v.isdigit() else f'<c r="{ref}" s="{s}"><v>{v}</v></c>'
    rows = [[("B1", "Income")], [("A2", "Year", 1), ("B2", "Net", 1), ("C2", "Gross", 1), ("D2", "Note", 1)], [("A3", "2020"), ("B3", "1"), ("C3", "2"), ("D3", "x")]]
    sheet = f"<worksheet><sheetData>{''.join('<row>' + ''.join(cell(*c) for c in r) + '</row>' for r in rows)}</sheetData><mergeCells><mergeCell ref='B1:C1'/></mergeCells></worksheet>"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in (("xl/workbook.xml", book), ("xl/styles.xml", styles), ("xl/worksheets/sheet1.xml", sheet), ("xl/worksheets/sheet2.xml", sheet)):
            z.writestr(name, text)
    files = spark.createDataFrame([("a.xlsx", out.getvalue()), ("b.xlsx", b"no zip")], "path string, content binary")
    found, merged = office.cells(files)
    assert {(r.r, r.c) for r in found.filter("bold").collect()} == {(2, c) for c in range(1, 5)} and [tuple(r) for r in merged.collect()] == [("a.xlsx!Sales", 1, 1, 2, 3)]
    # "Income" stands alone above the table: it is a title, so the merged name is above the table's top.
    (t,) = sheets.tables(found, merged).collect()
    assert (t.range, t.header_row, t.names) == ("A2:D3", 0, ["Year", "Net", "Gross", "Note"])
