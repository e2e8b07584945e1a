"""Tables in sheets: blocks against a flood fill, every step that refuses, label rules, parts of unequal length."""

import random

import pytest

from tidemark.operators import sheets
from tidemark.sources import parts, workbook

CELLS = "path string, sheet string, row int, col int, kind string, text string"


def flood(cells):
    left, out = set(cells), []
    while left:
        todo = [left.pop()]
        block = set(todo)
        while todo:
            r, c = todo.pop()
            for x in ((r + 1, c), (r - 1, c), (r, c + 1), (r, c - 1)):
                if x in left:
                    left.remove(x)
                    block.add(x)
                    todo.append(x)
        rows, cols = [r for r, _ in block], [c for _, c in block]
        out.append((min(rows), min(cols), max(rows), max(cols), len(block), len(block) == (max(rows) - min(rows) + 1) * (max(cols) - min(cols) + 1)))
    return sorted(out)


def test_blocks_equal_a_flood_fill(spark):
    rng = random.Random(5)
    made = {"a": {(r, c) for r in range(1, 25) for c in range(1, 30) if rng.random() < 0.55}, "b": {(r, 3) for r in range(1, 60)} | {(60, c) for c in range(3, 40)} | {(r, 40) for r in range(2, 60)}, "c": {(1, 1), (3, 3)}}
    rows = [("p", s, r, c, "number", "1") for s, cells in made.items() for r, c in cells] + [("p", "c", 2, 2, "empty", None)]
    got = {}
    for x in sheets.segments(spark.createDataFrame(rows, CELLS)).orderBy("sheet", "block").collect():
        got.setdefault(x.sheet, []).append((x.top, x.left, x.bottom, x.right, x.n_cells, x.rectangle))
    assert got == {s: flood(c) for s, c in made.items()}


def sheet(sheet="s", top=3, left=1, vintages=("Jan 2016", "Feb 2016", "Mar 2016"), quarters=("1955 Q1", "1955 Q2", "1955 Q3"), change=None, path="p"):
    """Rows of cells: vintages in row `top`, quarters in column `left`, numbers between; `change` replaces cells (None removes)."""
    cells = {(top, left + 1 + k): ("text", v) for k, v in enumerate(vintages) if v}
    cells |= {(top + 1 + k, left): ("text", q) for k, q in enumerate(quarters) if q}
    cells |= {(top + 1 + i, left + 1 + j): ("number", str(10 * i + j)) for i in range(len(quarters)) for j in range(len(vintages))}
    for k, v in (change or {}).items():
        if v is None:
            cells.pop(k, None)
        else:
            cells[k] = v
    return [(path, sheet, r, c, *v) for (r, c), v in cells.items()]


def frame(spark, *many):
    return spark.createDataFrame([x for m in many for x in m], CELLS)


N = ("number", "7")
REFUSED = [
    ("cells beside the table's columns", {(5, 8): N}), ("a column without a vintage label", {(3, 3): None}), ("a row without a quarter label", {(5, 1): None}),
    (None, {}), (None, {(1, 1): ("text", "a title"), (9, 9): ("text", "a note")}), (None, {(5, 1): None, (5, 2): None, (5, 3): None, (5, 4): None}),
]


@pytest.mark.parametrize("why,change", REFUSED)
def test_geometry(spark, why, change):
    (got,) = sheets.shapes(frame(spark, sheet(change=change))).collect()
    assert got.refused == why and (got.label_col, got.header_row, got.first_row, got.last_row, got.first_col, got.last_col) == (1, 3, 4, 6, 2, 4)


def test_gap_rows_runs_and_second_tables(spark):
    low = [(p, s, r + 1 if r > 3 else r, c, k, t) for p, s, r, c, k, t in sheet()]
    text, number = ("p", "s", 4, 2, "text", "provisional"), ("p", "s", 4, 2, "number", "7")
    assert [x.refused for x in sheets.shapes(frame(spark, [*low, text])).collect()] == [None]
    assert [x.refused for x in sheets.shapes(frame(spark, [*low, number])).collect()] == ["cells that are not text above the first row"]
    two = frame(spark, sheet(), sheet(top=20))  # one label column, parted by the second row of vintages
    assert sorted((x.header_row, x.first_row, x.refused) for x in sheets.shapes(two).collect()) == [(3, 4, "more than one table on the sheet"), (20, 21, "more than one table on the sheet")]
    lone = [("p", "s", r, 1, "text", f"1955 Q{r}") for r in (1, 2, 3)]
    assert sheets.tables(frame(spark, lone)).first().header_row is None and sheets.shapes(frame(spark, lone)).collect() == []


OUTCOMES = [
    (None, None, [sheet()]), ("4.1", "there is no table of vintages by quarters", [[("p", "s", 1, 1, "text", "nothing")]]), ("4.1", "cells beside the table's columns", [sheet(change={(5, 8): N})]),
    ("4.3", "a vintage label does not state a month", [sheet(vintages=("Jan 2016", "see note", "Apr 2016"))]), (None, None, [sheet(vintages=("Jan 2016", "see note", "n/a", "Apr 2016"))]),
    ("4.3", "a vintage label does not state a month", [sheet(vintages=("see note", "Feb 2016", "Mar 2016"))]), (None, None, [sheet(vintages=("Mar 2016", "?", "Jan 2016"))]),
    ("4.1", "a part's quarter labels are not the first labels of the longest part", [sheet("a"), sheet("b", vintages=("Apr 2016", "May 2016"), quarters=("1955 Q1", "1955 Q3"))]),
    (None, None, [sheet("a", quarters=("1955 Q1", "1955 Q2")), sheet("b", vintages=("Apr 2016", "May 2016"))]), ("4.1", "the parts' ranges of vintages overlap", [sheet("a"), sheet("b", vintages=("Mar 2016", "Apr 2016"))]),
    ("4.2", "a cell is neither number, marker nor empty", [sheet(change={(4, 2): ("text", "12 r")})]), (None, None, [sheet(change={(4, 2): ("text", "..")})]), ("4.3", "a row label does not state a quarter", [sheet(quarters=("1955 Q1", "spring", "1955 Q3"))]),
    ("4.3", "a quarter stands twice", [sheet(quarters=("1955 Q1", "1955Q1", "1955 Q3"))]), ("4.4", "the months of release do not run in one direction", [sheet(vintages=("Jan 2016", "Mar 2016", "Feb 2016"))]),
    ("4.4", "the months of release do not run in one direction", [sheet(vintages=("Jan 2016", "Jan 2016"))]),
]


def test_every_outcome(spark):
    """All workbooks at once, each with its own path."""
    rows = [(f"book{k}", *x[1:]) for k, (_, _, many) in enumerate(OUTCOMES) for m in many for x in m]
    table, outcome = sheets.read(spark.createDataFrame(rows, CELLS))
    assert {r.path: (r.step, r.why) for r in outcome.collect()} == {f"book{k}": o[:2] for k, o in enumerate(OUTCOMES)}
    got = {}
    for r in table.collect():
        got.setdefault(r.path, {}).setdefault(r.number, []).append((r.month, r.rule, r.sheet, r.quarter, r.kind, r.level))
    assert set(got) == {f"book{k}" for k, o in enumerate(OUTCOMES) if o[0] is None}
    placed = {n: v[0][:2] for n, v in got["book4"].items()}
    assert placed == {0: (24192, "A"), 1: (24193, "B"), 2: (24194, "B"), 3: (24195, "A")}
    assert {n: v[0][:2] for n, v in got["book6"].items()} == {0: (24192, "A"), 1: (24193, "B"), 2: (24194, "A")}
    padded = sorted(got["book8"][0], key=lambda x: x[3])
    assert [x[4:] for x in padded] == [("numeric", 0.0), ("numeric", 10.0), ("empty", None)] and [v[0][2] for _, v in sorted(got["book8"].items())] == ["a", "a", "a", "b", "b"]
    assert sorted(x[4] for x in got["book11"][0]) == ["marker", "numeric", "numeric"]


def test_places_state_where_a_label_is_read(spark):
    heads = spark.createDataFrame([("p", "s", c, "text", t) for c, t in enumerate(("Jan 2016", "see  note", "Mar 2016", "??", "May 2016"))], "path string, sheet string, col int, kind string, text string")
    places = lambda *rows: spark.createDataFrame(list(rows), "path string, sheet string, col int, text string, month long")
    rules = lambda p: [(r.month, r.rule) for r in sheets.read_labels(heads, ["path", "sheet"], places=p).orderBy("col").collect()]
    jan = 12 * 2016
    assert rules(places(("p", "s", 1, "see note", jan + 1)))[1:4] == [(jan + 1, "B"), (jan + 2, "A"), (None, None)]
    assert rules(places(("p", "s", 1, "see note", jan + 2)))[1] == (None, "refused") and rules(places(("p", "s", 1, "other", jan + 1)))[1] == (None, "refused")


def test_books_keep_their_cells(spark, tmp_path):
    rows = [("b", "one", 1, 1, "text", "a < b & c"), ("b", "one", 2, 28, "number", "1.5"), ("b", "one", 3, 2, "date", "42370"), ("b", "one", 3, 3, "boolean", "1"), ("b", "two", 5, 1, "error", "#N/A"), ("b", "one", 1, 1, "merged", "A1:C2"), ("b", "one", 2, 28, "note", "why"), ("b", "creator", 0, 0, "property", "me & you")]
    cells = spark.createDataFrame(rows, "book string, sheet string, row int, col int, kind string, text string")
    path = str(tmp_path / "books")
    parts.write_files(workbook.books(cells), path)
    got = {tuple(r)[1:] for r in workbook.xlsx_cells(spark, path, numbers=True).collect()}
    assert got == {x[1:] for x in rows[:5]}
    books = workbook.files(spark, path)
    assert [tuple(r)[1:] for r in workbook.merged_of(books).collect()] == [("one", 1, 1, 2, 3)]
    assert {tuple(r)[1:] for r in workbook.notes_of(books).collect()} == {("one", "AB2", "note", "why"), (None, "creator", "property", "me & you")}
    spread = {(r.row, r.col): r.text for r in sheets.spread_merged(workbook.xlsx_cells(spark, path, True), workbook.merged_of(books)).where("sheet = 'one'").collect()}
    assert [spread[r, c] for r in (1, 2) for c in (1, 2, 3)] == ["a < b & c"] * 6 and len(spread) == 9
