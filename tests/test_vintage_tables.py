"""Vintage tables: every step that refuses, one by one, and the numbering of vintages."""

import os

import pytest

from tidemark.operators import vintage
from tidemark.plans import base, table_queries


def sheet(part="p", vintages=("Jan 2016", "Feb 2016", "Mar 2016"), quarters=("1955 Q1", "1955 Q2"), fill=None):
    fill = fill or {}
    cell = lambda r, c: fill.get((r, c), ("number", str(100 * r + c)))
    return [(part, c, v, r, q, *cell(r, c)) for c, v in enumerate(vintages) for r, q in enumerate(quarters)]


def table(spark, *sheets):
    return spark.createDataFrame([row for s in sheets for row in s], "part string, col int, vintage_label string, row int, quarter_label string, kind string, text string")


A, B = ("Jan 2016", "Feb 2016"), ("Mar 2016", "Apr 2016")
REFUSED = [
    ("4.1", []), ("4.1", [sheet("a", A), sheet("b", B, ("1955 Q1", "1955 Q3"))]), ("4.1", [sheet("a", A), sheet("b", ("Feb 2016", "Mar 2016"))]), ("4.3", [sheet("a", A), sheet("b", ("Mar 2016", "Apr 16"))]),
    ("4.2", [sheet(fill={(0, 1): ("text", "12 r")})]), ("4.2", [sheet(fill={(1, 2): ("date", "2001-01-01")})]), ("4.3", [sheet(vintages=("Jan 2016", "Feb 16", "Mar 2016"))]),
    ("4.3", [sheet(quarters=("1955 Q1", "spring 1955"))]), ("4.3", [sheet(quarters=("1955 Q1", "1955Q1"))]), ("4.4", [sheet(vintages=("Jan 2016", "Mar 2016", "Feb 2016"))]),
    ("4.4", [sheet(vintages=("Jan 2016", "Jan 2016"))]), ("4.4", [sheet(vintages=("Jan 2016",))]),
]


@pytest.mark.parametrize("step,sheets", REFUSED)
def test_refused(spark, step, sheets):
    with pytest.raises(vintage.Stop) as e:
        vintage.read_table(table(spark, *sheets)).collect()
    assert e.value.step == step and "12 r" not in str(e.value)


def test_vintages_are_numbered_by_release_and_ties_by_place(spark):
    got = vintage.read_table(table(spark, sheet(vintages=("Jan 2016", "Feb 2016", "Feb 2016", "Mar 2016"), fill={(0, 0): ("text", ".."), (1, 3): ("text", " ")}))).collect()
    assert {(r.number, r.label, r.quarter, r.kind, r.level) for r in got if r.number in (0, 3)} == {
        (0, "Jan 2016", 7820, "marker", None), (0, "Jan 2016", 7821, "numeric", 100.0), (3, "Mar 2016", 7820, "numeric", 3.0), (3, "Mar 2016", 7821, "empty", None)}
    assert [r.level for r in sorted(got, key=lambda r: r.number) if r.quarter == 7821] == [100.0, 101.0, 102.0, None]


@pytest.mark.parametrize("sheets,levels", [
    ([sheet("late", B), sheet("early", A)], [0.0, 1.0, 0.0, 1.0]), ([sheet("early", A[::-1]), sheet("late", B[::-1])], [1.0, 0.0, 1.0, 0.0]),
])
def test_parts_are_joined_by_their_months(spark, sheets, levels):
    got = sorted(vintage.read_table(table(spark, *sheets)).where("quarter = 7820").collect(), key=lambda r: r.number)
    assert [r.label for r in got] == [*A, *B] and [r.level for r in got] == levels


def test_episodes_are_selected_by_the_run_of_their_first_vintage(spark):
    """Quarters 0 to 9 by vintages 0 to 5: a vintage knows the quarters before 2 * number + 1, with a hole, a bad level and none for 20."""
    rows = [(v, q, "numeric" if q < 2 * v + 1 and (v, q) != (3, 1) else "empty", None if (v, q) == (3, 1) or q >= 2 * v + 1 else -1.0 if (v, q) == (4, 2) else 1.0 + q) for v in range(6) for q in range(10)]
    t = spark.createDataFrame(rows, "vintage long, quarter long, kind string, level double")
    e = spark.createDataFrame([(0, 1), (1, 3), (2, 6), (3, 8), (4, 20), (5, 10)], "j long, onset long")
    got = {r.j: (r.vintage, r.n_v, r.ended_by, r.failed_step) for r in vintage.select_episodes(t, e, 0, window=2, lookback=1).collect()}
    assert got == {0: (0, 0, "floor", "7.2"), 1: (1, 2, "floor", "7.3"), 2: (3, 3, "gap", None), 3: (4, 7, "floor", "7.4"), 4: (None, 0, None, "7.1"), 5: (5, 9, "floor", None)}


SF = os.environ.get("TIDEMARK_SF", "/root/testdata/sf0.001")


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
def test_the_triangle_reads_line_items_once(spark):
    """Its months are written, so what names it often doesn't join line items and orders again."""
    assert not [f for f in base.monthly_triangle(spark, SF).inputFiles() if "lineitem" in f or "orders" in f]


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
def test_episodes_take_growths_from_the_written_triangle(spark):
    assert {os.path.basename(os.path.dirname(f)).split("-")[0] for f in table_queries.select_episode(spark, SF).inputFiles()} == {"triangle"}
