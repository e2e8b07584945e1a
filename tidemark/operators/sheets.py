"""Tables of vintages by quarters found in the cells of workbooks: geometry, labels, parts, and the table they make.

All is by (path, sheet), so any number of workbooks is read at once; a step that refuses gives its number and reason as a
row, and nothing of that workbook goes further.  Windows run over the rows or the columns of one sheet or over the quarters
of one table.

cells: path, sheet, row, col, kind, text (kind empty is left out).  merged: path, sheet, top, left, bottom, right."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import labels
from tidemark.operators.graph import connected
from tidemark.sources import shared

SHEET = ["path", "sheet"]


def _filled(cells: DataFrame) -> DataFrame:
    return cells.where("kind <> 'empty'").select(*SHEET, "row", "col", "kind", "text")


def spread_merged(cells: DataFrame, merged: DataFrame) -> DataFrame:
    """cells with every cell of a merged range showing what its first cell holds.  A range is clipped to the rows and columns
    that the sheet uses; cells inside a range are what the range shows, whatever they hold themselves."""
    c = _filled(cells)
    used = c.groupBy(*SHEET).agg(F.max("row").alias("bottom_row"), F.max("col").alias("right_col"))
    spans = merged.join(used, SHEET).select(*SHEET, "top", "left", F.least("bottom", "bottom_row").alias("bottom"), F.least("right", "right_col").alias("right"))
    spans = spans.where("top <= bottom and left <= right")
    place = spans.select(*SHEET, "top", "left", F.explode(F.sequence("top", "bottom")).alias("row"), "right").select(*SHEET, "top", "left", "row", F.explode(F.sequence("left", "right")).alias("col"))
    anchor = c.select(*SHEET, F.col("row").alias("top"), F.col("col").alias("left"), "kind", "text")
    shown = place.join(anchor, [*SHEET, "top", "left"]).select(*SHEET, "row", "col", "kind", "text")
    return c.join(place.select(*SHEET, "row", "col"), [*SHEET, "row", "col"], "left_anti").unionByName(shown)


def segments(cells: DataFrame) -> DataFrame:
    """Connected blocks of filled cells that share an edge: path, sheet, block (from 1, by top and left), top, left, bottom,
    right, n_cells, rectangle.  What is joined is slabs, not cells: runs of neighbouring cells of a row, those of equal columns
    in rows that follow each other taken together."""
    w = Window.partitionBy(*SHEET, "row").orderBy("col")
    runs = _filled(cells).withColumn("island", F.col("col") - F.row_number().over(w)).groupBy(*SHEET, "row", "island").agg(F.min("col").alias("a"), F.max("col").alias("z"))
    down = Window.partitionBy(*SHEET, "a", "z").orderBy("row")
    slabs = runs.withColumn("stack", F.col("row") - F.row_number().over(down)).groupBy(*SHEET, "a", "z", "stack").agg(F.min("row").alias("top"), F.max("row").alias("bottom"))
    slabs = shared.written(slabs.drop("stack").withColumn("id", F.monotonically_increasing_id()), "slabs")
    below = slabs.select(*SHEET, (F.col("top") - 1).alias("bottom"), F.col("a").alias("a2"), F.col("z").alias("z2"), F.col("id").alias("b"))
    touch = slabs.join(below, [*SHEET, "bottom"]).where("a <= z2 and a2 <= z").select(F.col("id").alias("a"), "b")
    root = connected(slabs, touch)
    box = slabs.join(root, "id").groupBy(*SHEET, "root").agg(
        F.min("top").alias("top"), F.min("a").alias("left"), F.max("bottom").alias("bottom"), F.max("z").alias("right"), F.sum((F.col("z") - F.col("a") + 1) * (F.col("bottom") - F.col("top") + 1)).alias("n_cells"))
    number = F.row_number().over(Window.partitionBy(*SHEET).orderBy("top", "left", "bottom", "right"))
    area = (F.col("bottom") - F.col("top") + 1) * (F.col("right") - F.col("left") + 1)
    return box.select(*SHEET, number.alias("block"), "top", "left", "bottom", "right", "n_cells", (F.col("n_cells") == area).alias("rectangle"))


# ------------------------------------------------ label columns and the tables beside them
def month_of(kind: Column, text: Column) -> Column:
    """Month index of a vintage label: a text that states a month, or Mon-YY with its notes and codes."""
    return F.when(kind == "text", F.coalesce(labels.parse_release_month(text), labels.read_vintage_label(F.trim(text))))


def tables(cells: DataFrame) -> DataFrame:
    """Runs of at least two quarter labels in one column: path, sheet, label_col, header_row (the nearest row above with a
    vintage label to the right of that column; null if none), first_row, last_row.  A row of vintage labels between two quarter
    labels parts the run."""
    c = _filled(cells).where("kind in ('text', 'date')")
    quarter = c.where((F.col("kind") == "text") & labels.parse_quarter(F.col("text")).isNotNull()).select(*SHEET, "row", F.col("col").alias("label_col"))
    vintage = c.where((F.col("kind") == "date") | month_of(F.col("kind"), F.col("text")).isNotNull()).groupBy(*SHEET, "row").agg(F.max("col").alias("reach"))
    heads = quarter.select(*SHEET, "label_col").distinct().join(vintage, SHEET).where("reach > label_col").select(*SHEET, "label_col", "row", F.lit(True).alias("head"))
    rows = quarter.withColumn("quarter", F.lit(True)).join(heads, [*SHEET, "label_col", "row"], "full")
    w = Window.partitionBy(*SHEET, "label_col").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    # a row that holds a quarter label in the same column parts nothing, but may head the first run below it
    rows = rows.withColumn("split", F.last(F.when(F.col("head") & F.col("quarter").isNull(), F.col("row")), True).over(w)).withColumn("above", F.last(F.when(F.col("head"), F.col("row")), True).over(w))
    runs = rows.where("quarter").groupBy(*SHEET, "label_col", "split").agg(F.min("row").alias("first_row"), F.max("row").alias("last_row"), F.count("*").alias("n"), F.min_by("above", "row").alias("header_row"))
    return runs.where("n >= 2").select(*SHEET, "label_col", "header_row", "first_row", "last_row")


def shapes(cells: DataFrame) -> DataFrame:
    """Every headed table with its columns and rows, and why step 4.1 refuses it (null if it doesn't): path, sheet, label_col,
    header_row, first_row, last_row, first_col, last_col, n_columns, n_empty_columns, n_rows, n_empty_rows, refused.

    In order: cells beside the columns; a filled column without a vintage label; a filled row without a quarter label; cells
    other than text between header and first row; more tables than one on the sheet."""
    c = _filled(cells)
    found = tables(c).where("header_row is not null")
    key = [*SHEET, "label_col", "header_row"]
    near = c.join(found, SHEET).where("row between header_row and last_row and col >= label_col")
    head = near.where("row = header_row and col > label_col").groupBy(*key).agg(F.min("col").alias("first_col"), F.max("col").alias("last_col"), F.collect_set("col").alias("named"))  # columns of a sheet
    near = near.join(head, key)
    inside = (F.col("row") >= F.col("first_row")) & (F.col("col") > F.col("label_col"))
    in_cols = F.col("col").between(F.col("first_col"), F.col("last_col"))
    has_name = F.array_contains("named", F.col("col"))
    by_row = near.groupBy(*key, "row").agg(F.bool_or(F.col("col") == F.col("label_col")).alias("labelled"), F.bool_or(inside & has_name).alias("content"), F.first("first_row").alias("from_row"))
    by_row = by_row.where("row >= from_row").groupBy(*key).agg(F.count_if("labelled").alias("n_rows"), F.count_if(F.col("content") & ~F.col("labelled")).alias("bare_rows"))
    tests = near.groupBy(*key, "first_row", "last_row", "first_col", "last_col").agg(
        F.size(F.first("named")).alias("n_columns"), F.count_if(inside & ~in_cols).alias("stray"), F.count_if(inside & in_cols & ~has_name).alias("bare_cells"),
        F.count_if((F.col("row") > F.col("header_row")) & (F.col("row") < F.col("first_row")) & has_name & (F.col("kind") != "text")).alias("gap_cells"),
    )
    out = tests.join(by_row, key).withColumn("on_sheet", F.count("*").over(Window.partitionBy(*SHEET)))
    refused = (
        F.when(F.col("stray") > 0, "cells beside the table's columns").when(F.col("bare_cells") > 0, "a column without a vintage label")
        .when(F.col("bare_rows") > 0, "a row without a quarter label").when(F.col("gap_cells") > 0, "cells that are not text above the first row")
        .when(F.col("on_sheet") > 1, "more than one table on the sheet")
    )
    return out.select(
        *key, "first_row", "last_row", "first_col", "last_col", "n_columns", (F.col("last_col") - F.col("first_col") + 1 - F.col("n_columns")).alias("n_empty_columns"), "n_rows",
        (F.col("last_row") - F.col("first_row") + 1 - F.col("n_rows")).alias("n_empty_rows"), refused.alias("refused"),
    )


# ------------------------------------------------ labels
def read_labels(heads: DataFrame, by: list[str], place: str = "col", places: DataFrame | None = None) -> DataFrame:
    """heads with month and rule.  Rule A reads a label by itself, `date` a cell that is a date.  Rule B reads labels that say
    nothing by their place: if the nearest labels read on both sides are as many months apart as columns, one month is left
    for each label between them, however many there are; otherwise month and rule stay null.

    `places` (by..., place, text, month) states where B may be used: there the cell must hold the stated text and B must find
    the stated month, or the row's rule is 'refused'; elsewhere B is not used."""
    text = F.trim(F.regexp_replace("text", r"\s+", " "))
    own = F.when(F.col("kind") == "date", F.year(F.col("text").try_cast("date")) * 12 + F.month(F.col("text").try_cast("date")) - 1).otherwise(month_of(F.col("kind"), F.col("text"))).cast("long")
    stated = F.lit(None).cast("long")
    rows = heads.withColumn("own", own)
    if places is not None:
        listed = places.select(*by, place, F.trim(F.regexp_replace("text", r"\s+", " ")).alias("listed_text"), F.col("month").cast("long").alias("listed_month"))
        rows = rows.join(listed, [*by, place], "left").withColumn("own", F.when(F.col("listed_month").isNull(), F.col("own")))
        stated = F.col("listed_month")
    w = Window.partitionBy(*by).orderBy(place)
    at = F.row_number().over(w)
    rows = rows.withColumn("at", at)
    known = F.when(F.col("own").isNotNull(), F.struct("at", "own"))
    rows = rows.withColumn("before", F.last(known, True).over(w.rowsBetween(Window.unboundedPreceding, -1))).withColumn("after", F.first(known, True).over(w.rowsBetween(1, Window.unboundedFollowing)))
    span, months = F.col("after.at") - F.col("before.at"), F.col("after.own") - F.col("before.own")
    placed = F.when(F.abs(months) == span, F.col("before.own") + F.signum(months).cast("long") * (F.col("at") - F.col("before.at"))).cast("long")
    if places is None:
        fits, refused = placed.isNotNull(), F.lit(False)
    else:
        fits = stated.isNotNull() & (placed == stated) & (text == F.col("listed_text"))
        refused = stated.isNotNull() & ~F.coalesce(fits, F.lit(False))
    month = F.coalesce(F.col("own"), F.when(fits, placed))
    rule = F.when(refused, "refused").when(F.col("own").isNotNull(), F.when(F.col("kind") == "date", "date").otherwise("A")).when(fits, "B")
    return rows.withColumn("month", month).withColumn("rule", rule).select(*heads.columns, "month", "rule")


def join_on_first_labels(rows: DataFrame) -> DataFrame:
    """Rule C over path, sheet, place (from 0), quarter_label: the labels of every part must be the first labels of the longest
    part (of equal ones the first by name).  Gives path, sheet, place, quarter_label, padded for all parts at the longest
    one's length, and refused_at: the first place of the path at which a part says something else (null if none)."""
    size = rows.groupBy(*SHEET).agg(F.count("*").alias("n"))
    size = size.withColumn("long", F.first("sheet").over(Window.partitionBy("path").orderBy(F.col("n").desc(), "sheet")))
    longest = size.where("sheet = long").select("path", F.col("sheet").alias("long_sheet"))
    model = rows.join(longest, "path").where("sheet = long_sheet").select("path", "place", F.col("quarter_label").alias("model"))
    full = size.select("path", "sheet", "n").join(model, "path").join(rows, ["path", "sheet", "place"], "left")
    full = full.withColumn("padded", F.col("place") >= F.col("n"))
    odd = F.min(F.when(~F.col("padded") & ~F.col("quarter_label").eqNullSafe(F.col("model")), F.col("place")))
    bad = full.groupBy("path").agg(odd.alias("refused_at"))
    return full.join(bad, "path").select("path", "sheet", "place", F.col("model").alias("quarter_label"), "padded", "refused_at")


# ------------------------------------------------ from cells to the table
def read(cells: DataFrame, places: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The table of every workbook, and what happened to each.

    Table: path, number, sheet, col, month, rule, quarter, kind, level; vintages are numbered by month, ties by place.
    Outcome: path, step, why (null for a table that was read), the first in this order: 4.1 geometry, or no table; 4.3 a label
    that can't be read; 4.1 parts that don't fit or whose months overlap; 4.2 a cell that is neither number, marker nor empty;
    4.3 a quarter that can't be read or stands twice; 4.4 months that don't run in one direction."""
    c = shared.written(_filled(cells), "cells")
    shape = shared.written(shapes(c), "shapes")
    paths = c.select("path").distinct()
    geometry = shape.groupBy("path").agg(F.min("refused").alias("why"), F.count("*").alias("n"))
    geometry = paths.join(geometry, "path", "left").select("path", F.when(F.col("n").isNull(), "there is no table of vintages by quarters").otherwise(F.col("why")).alias("why"))
    good = shape.join(geometry.where("why is null").select("path"), "path").select(*SHEET, "label_col", "header_row", "first_row", "last_row", "first_col", "last_col")
    near = c.join(good, SHEET).where("row between header_row and last_row and col between label_col and last_col")
    head = near.where("row = header_row and col > label_col").select(*SHEET, "col", "kind", "text")
    head = shared.written(read_labels(head, SHEET, "col", places), "heads")
    side = near.where("row >= first_row and col = label_col").select(*SHEET, "row", F.col("text").alias("quarter_label"))
    side = side.withColumn("place", F.row_number().over(Window.partitionBy(*SHEET).orderBy("row")) - 1)
    fitted = shared.written(join_on_first_labels(side), "fitted")
    body = near.where("row >= first_row and col > label_col").join(side, [*SHEET, "row"]).select(*SHEET, "place", "col", "kind", "text")
    grid = fitted.where("refused_at is null").join(head.where("month is not null").select(*SHEET, "col", "month", "rule"), SHEET)  # the grid of one sheet
    grid = grid.join(body, [*SHEET, "place", "col"], "left").withColumn("cell", labels.kind_of(F.coalesce("kind", F.lit("empty")), F.col("text")))
    grid = shared.written(grid.select(*SHEET, "place", "col", "month", "rule", labels.parse_quarter(F.col("quarter_label")).alias("quarter"), "cell", F.when(F.col("cell") == "numeric", F.col("text").cast("double")).alias("level")), "grid")
    # columns of a path in the order of their parts' months
    ends = head.groupBy(*SHEET).agg(F.min("month").alias("first"), F.max("month").alias("last"), F.max_by("month", "col").alias("end"), F.min_by("month", "col").alias("begin"))
    by_path = Window.partitionBy("path").orderBy("first", "last", "sheet")
    ends = ends.withColumn("overlap", F.col("first") <= F.lag("last").over(by_path))
    falling = ends.groupBy("path").agg((F.bool_and(F.col("end") <= F.col("begin")) & F.bool_or(F.col("end") < F.col("begin"))).alias("falling"))
    order = head.join(ends.select(*SHEET, "first"), SHEET).join(falling, "path").select("path", "sheet", "col", "month", "falling", F.when(F.col("falling"), -F.col("first")).otherwise(F.col("first")).alias("rank"))
    table_order = Window.partitionBy("path").orderBy("rank", "sheet", "col")
    order = order.withColumn("step", F.col("month") - F.lag("month").over(table_order)).withColumn("at", F.row_number().over(table_order))
    turns = order.groupBy("path").agg(F.min("step").alias("low"), F.max("step").alias("high"))
    number = F.row_number().over(Window.partitionBy("path").orderBy("month", F.when(F.col("falling"), -F.col("at")).otherwise(F.col("at")))) - 1
    numbers = order.select("path", "sheet", "col", number.cast("long").alias("number"))
    tests = (
        geometry.join(head.groupBy("path").agg(F.count_if(F.col("month").isNull()).alias("unread")), "path", "left")
        .join(fitted.groupBy("path").agg(F.min("refused_at").alias("refused_at")), "path", "left").join(ends.groupBy("path").agg(F.bool_or("overlap").alias("overlap")), "path", "left")
        .join(grid.groupBy("path").agg(F.count_if(F.col("cell") == "other").alias("odd"), F.count_if(F.col("quarter").isNull()).alias("no_quarter")), "path", "left")
        .join(grid.select("path", "sheet", "place", "quarter").distinct().groupBy("path", "sheet", "quarter").agg(F.count("*").alias("k")).groupBy("path").agg(F.max("k").alias("twice")), "path", "left").join(turns, "path", "left")
    )
    rules = [
        ("4.1", F.col("why"), F.col("why").isNotNull()), ("4.3", F.lit("a vintage label does not state a month"), F.col("unread") > 0),
        ("4.1", F.lit("a part's quarter labels are not the first labels of the longest part"), F.col("refused_at").isNotNull()), ("4.1", F.lit("the parts' ranges of vintages overlap"), F.col("overlap")),
        ("4.2", F.lit("a cell is neither number, marker nor empty"), F.col("odd") > 0), ("4.3", F.lit("a row label does not state a quarter"), F.col("no_quarter") > 0),
        ("4.3", F.lit("a quarter stands twice"), F.col("twice") > 1),
        ("4.4", F.lit("the months of release do not run in one direction"), F.col("low").isNull() | ((F.col("low") < 0) & (F.col("high") > 0)) | ((F.col("low") == 0) & (F.col("high") == 0))),
    ]
    first = F.coalesce(*(F.when(hit, F.struct(F.lit(step).alias("step"), why.alias("why"))) for step, why, hit in rules))
    outcome = shared.written(tests.select("path", first.alias("o")).select("path", "o.step", "o.why"), "outcome")
    table = grid.join(outcome.where("step is null").select("path"), "path").join(numbers, ["path", "sheet", "col"])
    return table.select("path", "number", "sheet", "col", "month", "rule", "quarter", F.col("cell").alias("kind"), "level"), outcome
