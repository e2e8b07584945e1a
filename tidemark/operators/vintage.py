"""Bitemporal tables in long form: (vintage, quarter, kind, level), and selection of what was known when."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import labels
from tidemark.operators.series import ContractError


class Stop(ContractError):
    """A table that can't be read: the step that refused it, and why, with digits masked."""

    def __init__(self, step: str, why: str):
        super().__init__(f"{step}: {why}")
        self.step = step


def _refuse(bad: DataFrame, step: str, why: str, *show: str) -> None:
    row = bad.select(*(labels.mask_digits(F.col(c).cast("string")).alias(c) for c in show)).limit(1).collect()
    if row:
        raise Stop(step, f"{why}: {row[0].asDict()}")


def _direction(month: Column, place: Column, by: list[str]) -> tuple[Column, Column]:
    """Smallest and largest step between neighbouring months: aggregates of a window result."""
    step = month - F.lag(month).over(Window.partitionBy(*by).orderBy(place)) if by else month - F.lag(month).over(Window.orderBy(place))
    return step, F.struct(F.min("step").alias("low"), F.max("step").alias("high"))


def join_parts(cells: DataFrame) -> DataFrame:
    """The cells of the one table that a file's parts make: cells, with place (a column's number in the table) and month.

    cells holds (part, col, vintage_label, row, quarter_label, kind, text), a row for each cell, empty ones too.  Parts are
    joined side by side only if their row labels are identical and their ranges of months are apart; parts in falling
    order are joined in falling order.  Step 4.1 refuses what can't be joined, 4.3 a month that can't be read."""
    columns = cells.select("part", "col", "vintage_label").distinct().withColumn("month", labels.parse_release_month(F.col("vintage_label")))
    columns = columns.persist()  # a row for each column of a sheet
    if columns.isEmpty():
        raise Stop("4.1", "there is no table of vintages by quarters")
    named = F.md5(F.to_json(F.array_sort(F.collect_set(F.struct("row", "quarter_label")))))  # as many as a sheet has rows
    several = columns.select("part").distinct().count() > 1
    if several:
        _refuse(columns.where("month is null"), "4.3", "a vintage label does not state a month", "vintage_label")
        if cells.groupBy("part").agg(named.alias("rows")).select("rows").distinct().count() > 1:
            raise Stop("4.1", "the parts' quarter labels are not identical")
    step, ends = _direction(F.col("month"), F.col("col"), ["part"])
    parts = columns.withColumn("step", step).groupBy("part").agg(F.min("month").alias("first"), F.max("month").alias("last"), ends.alias("d"))
    if several:
        before = F.lag("last").over(Window.orderBy("first", "last"))  # parts of one file
        _refuse(parts.withColumn("before", before).where("first <= before"), "4.1", "the parts' ranges of vintages overlap", "part")
    falling = parts.agg(F.bool_or((F.col("d.high") <= 0) & (F.col("d.low") < 0)) & ~F.coalesce(F.bool_or((F.col("d.low") >= 0) & (F.col("d.high") > 0)), F.lit(False))).first()[0]
    order = [F.col("first").desc(), F.col("last").desc()] if falling else [F.col("first"), F.col("last")]
    place = columns.join(parts.select("part", "first", "last"), "part").withColumn("place", F.row_number().over(Window.orderBy(*order, "col")) - 1)
    return cells.join(F.broadcast(place.select("part", "col", "place", "month")), ["part", "col"])  # a row for each column


def read_table(cells: DataFrame) -> DataFrame:
    """number, label, month, quarter, kind, level of a table of vintages by quarters, from the raw cells of its parts.

    In order: 4.1 parts that can't be joined; 4.2 cells of kind other; 4.3 labels that can't be read and a quarter that
    stands twice; 4.4 months that don't run in one direction.  The first that is met stops.  Vintages are numbered by
    release, ties by place."""
    table = join_parts(cells).withColumn("cell", labels.kind_of(F.col("kind"), F.col("text")))
    _refuse(table.where("cell = 'other'"), "4.2", "a cell is neither number, marker nor empty", "vintage_label", "quarter_label", "text")
    _refuse(table.where("month is null"), "4.3", "a vintage label does not state a month", "vintage_label")
    rows = table.select("row", "quarter_label").distinct().withColumn("quarter", labels.parse_quarter(F.col("quarter_label"))).persist()
    _refuse(rows.where("quarter is null"), "4.3", "a row label does not state a quarter", "quarter_label")
    _refuse(rows.groupBy("quarter").agg(F.count("*").alias("n"), F.min("quarter_label").alias("quarter_label")).where("n > 1"), "4.3", "a quarter stands twice", "quarter_label")
    columns = table.select("place", "vintage_label", "month").distinct()
    step, ends = _direction(F.col("month"), F.col("place"), [])
    d = columns.withColumn("step", step).agg(ends.alias("d")).first().d
    if d.low is None or d.low < 0 < d.high or d.low == d.high == 0:
        raise Stop("4.4", "the months of release do not run in one direction")
    number = F.row_number().over(Window.orderBy(F.col("place") if d.low >= 0 else F.col("place").desc())) - 1
    columns = columns.select("place", number.cast("long").alias("number"))
    out = table.join(F.broadcast(columns), "place").join(F.broadcast(rows.select("row", "quarter")), "row")  # columns and rows of a sheet
    return out.select("number", F.col("vintage_label").alias("label"), "month", "quarter", F.col("cell").alias("kind"), F.when(F.col("cell") == "numeric", F.col("text").cast("double")).alias("level"))


def first_present(table: DataFrame) -> DataFrame:
    """sid?, quarter, vintage: the earliest vintage with a number for the quarter."""
    return table.where("kind = 'numeric'").groupBy("quarter").agg(F.min("vintage").alias("vintage"))


def as_of(table: DataFrame, vintage: int) -> DataFrame:
    """quarter, level: the latest level known at a vintage."""
    return table.where((F.col("vintage") <= vintage) & F.col("level").isNotNull()).groupBy("quarter").agg(F.max_by("level", "vintage").alias("level"))


def previous_lacks(table: DataFrame) -> DataFrame:
    """vintage, quarter of levels that the vintage before didn't have."""
    w = Window.partitionBy("quarter").orderBy("vintage")
    before = F.lag("kind").over(w)
    return table.withColumn("before", before).where((F.col("kind") == "numeric") & (F.col("before").isNull() | (F.col("before") != "numeric"))).select("vintage", "quarter")


def order_vintages(labels: DataFrame) -> DataFrame:
    """Vintage labels numbered by month, ties in table order, with the direction of the table."""
    w = Window.partitionBy("part").orderBy("month", "place")
    step = F.col("month") - F.lag("month").over(Window.partitionBy("part").orderBy("place"))
    out = labels.withColumn("number", F.row_number().over(w) - 1).withColumn("step", step)
    whole = Window.partitionBy("part")
    direction = F.when(F.min("step").over(whole) >= 0, "ascending").when(F.max("step").over(whole) <= 0, "descending").otherwise("mixed")
    return out.withColumn("direction", direction).drop("step")


def vintage_run(table: DataFrame, floor: int = 0) -> DataFrame:
    """vintage, onset, first, length, ended_by: the unbroken run of quarters with a level that ends before the onset.

    table has a row for each vintage and quarter before its onset.  ended_by: gap (a quarter without a number), no_row,
    or floor."""
    back = Window.partitionBy("vintage", "onset").orderBy(F.col("quarter").desc())
    t = table.where((F.col("quarter") < F.col("onset")) & (F.col("quarter") >= floor))
    t = t.withColumn("rank", F.row_number().over(back))
    t = t.withColumn("fine", (F.col("kind") == "numeric") & (F.col("quarter") == F.col("onset") - F.col("rank")))
    t = t.withColumn("broken", F.sum((~F.col("fine")).cast("int")).over(back.rowsBetween(Window.unboundedPreceding, 0)))
    run = t.groupBy("vintage", "onset").agg(
        F.min(F.when(F.col("broken") == 0, F.col("quarter"))).alias("first"), F.count_if(F.col("broken") == 0).alias("length"),
        F.max(F.when(~F.col("fine"), F.col("quarter"))).alias("bad"),
    )
    ended = F.when(F.col("first") == floor, "floor").when(F.col("bad") == F.coalesce("first", F.col("onset")) - 1, "gap").otherwise("no_row")
    return run.select("vintage", "onset", "first", "length", ended.alias("ended_by"))


def select_episodes(table: DataFrame, episodes: DataFrame, floor: int = 0, window: int = 40, lookback: int = 8) -> DataFrame:
    """j, onset, vintage, n_v, ended_by, failed_step, usable of every episode (j, onset): the vintage is the first with a number for
    the quarter before the onset, and its unbroken run until then gives n_v growth values.

    The first step that fails: 7.1 no vintage has that number; 7.2 the vintage is the table's earliest, or the one before it has the
    number too, so that its first release can't be told; 7.3 fewer than window + lookback values; 7.4 a level of the run that is
    not positive and finite.  j is kept as it is."""
    fp = first_present(table).select((F.col("quarter") + 1).alias("onset"), "vintage")
    e = episodes.select("j", "onset").join(fp, "onset", "left")
    earlier = Window.orderBy("vintage")  # one row for each vintage of a table
    order = table.select("vintage").distinct().withColumn("before", F.lag("vintage").over(earlier))
    held = table.where("kind = 'numeric'").select(F.col("vintage").alias("before"), (F.col("quarter") + 1).alias("onset"), F.lit(True).alias("known"))
    e = e.join(F.broadcast(order), "vintage", "left").join(held, ["before", "onset"], "left")
    asked = e.where("vintage is not null").select("vintage", "onset").distinct()
    rows = table.join(F.broadcast(asked), "vintage").where("quarter < onset")  # a row an episode
    run = vintage_run(rows, floor)
    odd = F.col("level").isNull() | F.isnan("level") | (F.abs("level") == float("inf")) | (F.col("level") <= 0)
    bad = rows.join(run.select("vintage", "onset", "first"), ["vintage", "onset"]).where(F.col("quarter") >= F.col("first")).groupBy("vintage", "onset").agg(F.count_if(odd).alias("bad"))
    e = e.join(run.select("vintage", "onset", "length", "ended_by"), ["vintage", "onset"], "left").join(bad, ["vintage", "onset"], "left")
    n_v = F.greatest(F.coalesce("length", F.lit(0)) - 1, F.lit(0)).cast("long")
    step = (
        F.when(F.col("vintage").isNull(), "7.1").when(F.col("before").isNull() | F.coalesce("known", F.lit(False)), "7.2")
        .when(n_v < window + lookback, "7.3").when(F.coalesce("bad", F.lit(0)) > 0, "7.4")
    )
    return e.select("j", "onset", "vintage", n_v.alias("n_v"), "ended_by", step.alias("failed_step"), step.isNull().alias("usable"))


def first_showing_onset(growths: DataFrame) -> DataFrame:
    """onset, vintage: the first vintage in which growth is negative both in the onset quarter and the next."""
    a, b = growths.alias("a"), growths.alias("b")
    both = a.join(b, (F.col("a.vintage") == F.col("b.vintage")) & (F.col("b.quarter") == F.col("a.quarter") + 1))
    return both.where((F.col("a.x") < 0) & (F.col("b.x") < 0)).groupBy(F.col("a.quarter").alias("onset")).agg(F.min("a.vintage").alias("vintage"))


def availability_report(table: DataFrame) -> DataFrame:
    """Counts of kinds by vintage and in total (vintage NULL)."""
    n = lambda k: F.count_if(F.col("kind") == k).alias(f"n_{k}")
    cells = [n("numeric"), n("empty"), n("marker"), n("other")]
    return table.groupBy("vintage").agg(*cells).unionByName(table.agg(*cells).withColumn("vintage", F.lit(None).cast("long")))


def revisions(first: DataFrame, final: DataFrame, key: str = "episode") -> DataFrame:
    """Real-time and final changes of each episode and their difference."""
    a, b = first.select(key, F.col("change").alias("real_time")), final.select(key, F.col("change").alias("final"))
    return a.join(b, key, "left").withColumn("revision", F.col("final") - F.col("real_time"))


def two_clocks(eps: DataFrame, releases: DataFrame) -> DataFrame:
    """Days from the end of the onset quarter to the release of the vintage that shows it: before, after, same or NULL."""
    from tidemark.functions.labels import quarter_end

    out = eps.join(releases, "vintage", "left").withColumn("quarter_end", quarter_end(F.col("onset")))
    days = F.datediff("released", "quarter_end")
    return out.withColumns({"days": days, "order": F.when(days < 0, "before").when(days > 0, "after").when(days == 0, "same")})
