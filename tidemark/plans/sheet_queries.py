"""Workbooks from file to table: a workbook for each nation, written by tasks, read back cell by cell, cut into blocks, its
labels read and its parts joined.  A sheet is quarters of ordering by months of shipping, in two parts; some labels state no
month (in one nation of five only where their neighbours tell it), and of five nations three have a fault in the sheet `late`, each another one."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import cascade, sheets
from tidemark.plans import base as b
from tidemark.plans.catalogue import query
from tidemark.sources import parts, shared, workbook

CUT_MONTH, CUT_QUARTER = 1998 * 12 + 6, 1998 * 4 + 1
_made: dict[tuple, str] = {}


def _amounts(spark, d) -> DataFrame:
    """Pieces by nation n, quarter q and month v, for lines shipped on or after their order's day."""
    li = b.read(spark, d, "lineitem").select("l_orderkey", "l_shipdate", "l_quantity")
    o = b.read(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    c = b.read(spark, d, "customer").select("c_custkey", "c_nationkey")
    j = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).where("l_shipdate >= o_orderdate").join(c, F.col("o_custkey") == F.col("c_custkey"))
    q, v = F.year("o_orderdate") * 4 + F.quarter("o_orderdate") - 1, F.year("l_shipdate") * 12 + F.month("l_shipdate") - 1
    return j.groupBy(F.col("c_nationkey").cast("int").alias("n"), q.alias("q"), v.alias("v")).agg(F.sum(F.col("l_quantity").cast("decimal(18,2)")).cast("long").alias("amount"))


def _cells(spark, d) -> DataFrame:
    a = shared.written(_amounts(spark, d).withColumn("sheet", F.when(F.col("v") < CUT_MONTH, "early").otherwise("late")), "amounts")
    of_sheet = Window.partitionBy("n", "sheet")  # months of a sheet
    inside = F.col("v").between(F.min("v").over(of_sheet) + 2, F.max("v").over(of_sheet) - 2)
    cols = a.select("n", "sheet", "v").distinct().withColumn("col", F.row_number().over(of_sheet.orderBy("v")) + 2)
    cols = shared.written(cols.withColumn("silent", (F.col("v") % 9).isin(4, 5) & ((F.col("n") % 5 != 0) | inside)), "cols")
    rows = shared.written(a.select("n", "q").distinct().withColumn("row", F.row_number().over(Window.partitionBy("n").orderBy("q")) + 6), "rows")
    own = shared.written(cols.groupBy("n", "sheet").agg(F.max("col").alias("last")), "ends")
    late = own.where("sheet = 'late'")
    month = F.date_format(F.make_date(F.floor(F.col("v") / 12).cast("int"), (F.col("v") % 12 + 1).cast("int"), F.lit(1)), "MMM yyyy")
    quarter = F.concat(F.floor(F.col("q") / 4).cast("string"), F.lit(" Q"), (F.col("q") % 4 + 1).cast("string"))

    def cell(df, row, col, kind, text):
        return df.select(F.concat(F.lit("nation"), F.col("n").cast("string")).alias("book"), "sheet", row.cast("int").alias("row"), col.cast("int").alias("col"), F.lit(kind).alias("kind"), text.cast("string").alias("text"))

    at = F.lit
    title = F.concat(F.lit("Orders by quarter & month, nation "), F.col("n").cast("string"))
    of_rows = rows.join(own, "n").where((F.col("sheet") == "late") | (F.col("q") <= CUT_QUARTER))
    gone = (F.col("n") % 5 == 2) & (F.col("sheet") == "late") & (F.col("row") == 8)
    odd_gap = (F.col("n") % 5 == 3) & (F.col("sheet") == "late")
    made = [
        cell(own, at(1), at(1), "text", title), cell(own, at(3), at(1), "text", F.lit("Pieces shipped")), cell(own, at(1), at(1), "merged", F.lit("A1:D1")), cell(own, at(5), at(3), "note", F.lit("first month")),
        cell(own.select("n", F.lit("creator").alias("sheet")).distinct(), at(0), at(0), "property", F.lit("statistics")),
        cell(cols, at(5), F.col("col"), "text", F.when(F.col("silent"), "see note").otherwise(month)),
        cell(own.where((F.col("n") % 2 == 0) & ~odd_gap), at(6), at(3), "text", F.lit("provisional")),
        cell(of_rows.where(~gone), F.col("row"), at(2), "text", quarter),
        cell(a.join(cols, ["n", "sheet", "v"]).join(rows, ["n", "q"]).where(~(gone & (F.col("col") == 3))), F.col("row"), F.col("col"), "number", F.col("amount")),
        cell(late.where("n % 5 = 1"), at(8), F.col("last") + 3, "number", F.lit("7")), cell(late.where("n % 5 = 2"), at(8), at(3), "number", F.lit("7")), cell(late.where("n % 5 = 3"), at(6), at(3), "number", F.lit("7")),
    ]
    out = made[0]
    for m in made[1:]:
        out = out.unionByName(m)
    return out


def _folder(spark, d) -> str:
    """The workbooks of a set of tables, written once in a session and shared folder."""
    key = (spark.sparkContext.applicationId, shared.shared_dir(spark), d)
    if key not in _made or not parts.manifest_of(_made[key]):
        path = shared.new_path(spark, "workbooks")
        parts.write_files(workbook.books(_cells(spark, d)), path)
        _made[key] = path
    return _made[key]


def _named(df: DataFrame) -> DataFrame:
    return df.withColumn("path", F.regexp_extract("path", r"([^/]+)\.xlsx$", 1))


_AMOUNTS = """a as (select c_nationkey n, year(o_orderdate)*4 + quarter(o_orderdate) - 1 q, year(l_shipdate)*12 + month(l_shipdate) - 1 v, cast(sum(cast(l_quantity as decimal(18,2))) as bigint) amount
  from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey where l_shipdate >= o_orderdate group by 1, 2, 3),
s as (select *, case when v < 1998*12 + 6 then 'early' else 'late' end sheet from a),
co as (select n, sheet, v, row_number() over (partition by n, sheet order by v) + 2 col, v % 9 in (4, 5) and (n % 5 <> 0 or v between min(v) over (partition by n, sheet) + 2 and max(v) over (partition by n, sheet) - 2) silent from (select distinct n, sheet, v from s)),
ro as (select n, q, row_number() over (partition by n order by q) + 6 as row from (select distinct n, q from s)), ow as (select n, sheet, max(col) last from co group by 1, 2)"""
_CELLS = f"""{_AMOUNTS}, ro2 as (select ro.n, sheet, q, row, last from ro join ow on ow.n = ro.n where sheet = 'late' or q <= 1998*4 + 1),
cells as (select n, sheet, 1 as row, unnest(range(1, least(4, last) + 1)) col, 'text' kind from (select n, sheet, case when n % 5 = 1 and sheet = 'late' then last + 3 else last end last from ow) union all select n, sheet, 3, 1, 'text' from ow union all select n, sheet, 5, col, 'text' from co
  union all select n, sheet, 6, 3, case when n % 5 = 3 and sheet = 'late' then 'number' else 'text' end from ow where n % 2 = 0 or n % 5 = 3 and sheet = 'late'
  union all select n, sheet, row, 2, 'text' from ro2 where not (n % 5 = 2 and sheet = 'late' and row = 8)
  union select s.n, s.sheet, row, col, 'number' from s join co on co.n = s.n and co.sheet = s.sheet and co.v = s.v join ro on ro.n = s.n and ro.q = s.q
  union select n, sheet, 8, last + 3, 'number' from ow where n % 5 = 1 and sheet = 'late' union select n, sheet, 8, 3, 'number' from ow where n % 5 = 2 and sheet = 'late')"""
_FAULT = """case when sheet = 'late' then case n % 5 when 1 then 'cells beside the table''s columns' when 2 then 'a row without a quarter label' when 3 then 'cells that are not text above the first row' end end"""


@query(f"with {_CELLS} select 'nation' || n path, sheet, kind, count(*) n_cells, cast(sum(row) as bigint) rows_sum, cast(sum(col) as bigint) cols_sum from cells group by 1, 2, 3")
def workbook_cells(spark, d):
    """Filled cells of all workbooks as files hold them, merged ranges spread."""
    at = _folder(spark, d)
    c = sheets.spread_merged(workbook.xlsx_cells(spark, at), workbook.merged_of(workbook.files(spark, at)))
    return _named(c).groupBy("path", "sheet", "kind").agg(F.count("*").alias("n_cells"), F.sum("row").alias("rows_sum"), F.sum("col").alias("cols_sum"))


@query(f"with {_AMOUNTS} select 'nation' || n path, sheet, 'C5' as ref, 'note' as kind, 'first month' as text from ow union all select distinct 'nation' || n, null, 'creator', 'property', 'statistics' from ow")
def workbook_notes(spark, d):
    """Notes by cell and document properties."""
    return _named(workbook.notes_of(workbook.files(spark, _folder(spark, d)))).select("path", "sheet", "ref", "kind", "text")


@query(f"""with recursive {_CELLS}, k as (select n, sheet, row, col, col - row_number() over (partition by n, sheet, row order by col) island from cells),
runs as (select *, row_number() over (order by n, sheet, row, a) id from (select n, sheet, row, min(col) a, max(col) z from k group by n, sheet, row, island)),
t as (select x.id a, y.id b from runs x join runs y on x.n = y.n and x.sheet = y.sheet and abs(x.row - y.row) = 1 and x.a <= y.z and y.a <= x.z),
reach(id, root) as (select id, id from runs union select t.b, reach.root from reach join t on t.a = reach.id where reach.root < t.b), least_ as (select id, min(root) root from reach group by id),
box as (select n, sheet, root, min(row) top, min(a) "left", max(row) bottom, max(z) "right", cast(sum(z - a + 1) as bigint) n_cells from runs join least_ using (id) group by 1, 2, 3)
select 'nation' || n path, sheet, row_number() over (partition by n, sheet order by top, "left", bottom, "right") as block, top, "left", bottom, "right", n_cells, n_cells = (bottom - top + 1)*("right" - "left" + 1) rectangle from box""")
def blocks(spark, d):
    """Connected blocks of filled cells over whole sheets: titles, notes, label columns, header rows, bodies."""
    at = _folder(spark, d)
    c = sheets.spread_merged(workbook.xlsx_cells(spark, at), workbook.merged_of(workbook.files(spark, at)))
    out = _named(sheets.segments(c))
    return out.select("path", "sheet", *(F.col(k).cast("long").alias(k) for k in ("block", "top", "left", "bottom", "right", "n_cells")), "rectangle")


@query(f"""with {_AMOUNTS}, r as (select n, sheet, count(*) n_rows from (select ro.n, ow.sheet, q from ro join ow on ow.n = ro.n where sheet = 'late' or q <= 1998*4 + 1) group by 1, 2), c as (select n, sheet, count(*) n_columns from co group by 1, 2)
select 'nation' || n path, sheet, 2 as label_col, 5 as header_row, 7 as first_row, 6 + n_rows last_row, 3 as first_col, 2 + n_columns last_col, n_columns, 0 n_empty_columns,
 n_rows - case when n % 5 = 2 and sheet = 'late' then 1 else 0 end n_rows, case when n % 5 = 2 and sheet = 'late' then 1 else 0 end n_empty_rows, {_FAULT} refused from r join c using (n, sheet)""")
def read_structure(spark, d):
    """The geometry of every sheet's table, and what step 4.1 refuses."""
    out = _named(sheets.shapes(workbook.xlsx_cells(spark, _folder(spark, d))))
    return out.select("path", "sheet", *(F.col(k).cast("long").alias(k) for k in ("label_col", "header_row", "first_row", "last_row", "first_col", "last_col", "n_columns", "n_empty_columns", "n_rows", "n_empty_rows")), "refused")


_RULES = """h as (select * from co),
g as (select *, (select max(x.v) from h x where x.n = h.n and x.sheet = h.sheet and not x.silent and x.v < h.v) lo, (select min(x.v) from h x where x.n = h.n and x.sheet = h.sheet and not x.silent and x.v > h.v) hi from h),
b as (select g.*, (select count(*) from h x where x.n = g.n and x.sheet = g.sheet and x.v > g.lo and x.v < g.hi) between_ from g),
m as (select n, sheet, col, case when not silent or hi - lo = between_ + 1 then v end as month, case when not silent then 'A' when hi - lo = between_ + 1 then 'B' end as rule from b)"""


@query(f"with {_AMOUNTS}, {_RULES} select 'nation' || n path, sheet, col, month, rule from m")
def label_rules(spark, d):
    """Every vintage label with its month and the rule that read it; a label between neighbours that leave a choice has none."""
    c = workbook.xlsx_cells(spark, _folder(spark, d)).where("row = 5 and col > 2 and kind <> 'empty'")
    return _named(sheets.read_labels(c, ["path", "sheet"])).select("path", "sheet", F.col("col").cast("long").alias("col"), "month", "rule")


@query(f"""with {_AMOUNTS}, p as (select n, sheet, place, q from (select n, q, row_number() over (partition by n order by q) - 1 place from (select distinct n, q from s)) x join ow using (n)),
l as (select n, max(case when sheet = 'late' then 1 else 0 end) any_late from ow group by 1)
select 'nation' || n path, sheet, place, (q // 4) || ' Q' || (q % 4 + 1) quarter_label, sheet = 'early' and any_late = 1 and q > 1998*4 + 1 padded, cast(null as bigint) refused_at from p join l using (n) where n % 5 <> 2 and (any_late = 1 or q <= 1998*4 + 1)""")
def padded_parts(spark, d):
    """Rule C: the shorter part's rows, extended to the longer part's labels."""
    c = workbook.xlsx_cells(spark, _folder(spark, d)).where("row > 6 and col = 2 and kind = 'text'")
    side = _named(c).where("cast(substring(path, 7) as int) % 5 <> 2").select("path", "sheet", (F.row_number().over(Window.partitionBy("path", "sheet").orderBy("row")) - 1).alias("place"), F.col("text").alias("quarter_label"))
    out = sheets.join_on_first_labels(side)
    return out.select("path", "sheet", F.col("place").cast("long").alias("place"), "quarter_label", "padded", F.col("refused_at").cast("long").alias("refused_at"))


@query(f"""with {_AMOUNTS}, {_RULES}, f as (select n, max({_FAULT}) fault from ow group by n), u as (select n, count_if(month is null) unread, count(*) k from m group by n),
x as (select n, count(*) many, count(distinct q) nq from (select distinct n, q from s) group by n),
o as (select f.n, case when fault is not null then '4.1' when unread > 0 then '4.3' end step, case when fault is not null then fault when unread > 0 then 'a vintage label does not state a month' end why from f join u using (n)),
w as (select n, count(distinct q) n_q from s where exists (select 1 from ow where ow.n = s.n and sheet = 'late') or q <= 1998*4 + 1 group by n),
t as (select s.n, count(*) n_numeric, sum(amount) total, max(v) last_month from s join o using (n) where step is null group by 1)
select 'nation' || o.n path, step, why, case when step is null then k*n_q end n_cells, n_numeric, cast(total as double) total, last_month, case when step is null then k - 1 end last_number from o join u using (n) join w using (n) left join t on t.n = o.n""")
def map_structure(spark, d):
    """Every workbook from file to table: the step that refused it, or what its table holds."""
    table, outcome = sheets.read(workbook.xlsx_cells(spark, _folder(spark, d), numbers=True))
    held = table.groupBy("path").agg(F.count("*").alias("n_cells"), F.count_if(F.col("kind") == "numeric").alias("n_numeric"), F.sum("level").alias("total"), F.max("month").alias("last_month"), F.max("number").alias("last_number"))
    return _named(outcome.join(held, "path", "left")).select("path", "step", "why", "n_cells", "n_numeric", "total", "last_month", "last_number")


@query(f"""with {_AMOUNTS}, {_RULES}, r as (select n, sheet, count(*) n_rows from (select ro.n, ow.sheet, q from ro join ow on ow.n = ro.n where sheet = 'late' or q <= 1998*4 + 1) group by 1, 2), w as (select n, max(n_rows) longest from r group by 1)
select 'nation' || n path, sheet, count(*) n_labels, count_if(rule = 'A') by_itself, count_if(rule = 'B') by_place, count_if(rule is null) unread, min(month) first_month, max(month) last_month, max(n_rows) n_rows, max(longest - n_rows) n_padded
 from m join r using (n, sheet) join w using (n) where n % 5 in (0, 4) group by 1, 2""")
def table_parts(spark, d):
    """The parts of every workbook whose geometry is whole: how its labels were read, its rows, and the rows it is padded with."""
    c = shared.written(workbook.xlsx_cells(spark, _folder(spark, d)), "cells")
    shape = shared.written(sheets.shapes(c), "shapes")
    good = shape.join(shape.groupBy("path").agg(F.max("refused").alias("why")).where("why is null").select("path"), "path")
    near = c.join(good.select("path", "sheet", "label_col", "header_row", "first_row", "last_row"), ["path", "sheet"])
    heads = sheets.read_labels(near.where("row = header_row and col > label_col and kind <> 'empty'").select("path", "sheet", "col", "kind", "text"), ["path", "sheet"])
    side = near.where("row between first_row and last_row and col = label_col and kind <> 'empty'")
    side = side.select("path", "sheet", (F.row_number().over(Window.partitionBy("path", "sheet").orderBy("row")) - 1).alias("place"), F.col("text").alias("quarter_label"))
    rows = sheets.join_on_first_labels(side).groupBy("path", "sheet").agg(F.count_if(~F.col("padded")).alias("n_rows"), F.count_if("padded").alias("n_padded"))
    said = heads.groupBy("path", "sheet").agg(F.count("*").alias("n_labels"), F.count_if(F.col("rule") == "A").alias("by_itself"), F.count_if(F.col("rule") == "B").alias("by_place"), F.count_if(F.col("rule").isNull()).alias("unread"), F.min("month").alias("first_month"), F.max("month").alias("last_month"))
    return _named(said.join(rows, ["path", "sheet"])).select("path", "sheet", "n_labels", "by_itself", "by_place", "unread", "first_month", "last_month", "n_rows", "n_padded")


@query(f"""with {_AMOUNTS}, {_RULES}, u as (select n, count_if(month is null) unread from m group by n), k as (select m.n, m.month, row_number() over (partition by m.n order by m.month) - 1 number from m),
qs as (select distinct n, q from s where exists (select 1 from ow where ow.n = s.n and sheet = 'late') or q <= 1998*4 + 1)
select 'nation' || k.n path, number, k.month, qs.q as quarter, case when amount is null then 'empty' else 'numeric' end kind, cast(amount as double) as level
 from k join u using (n) join qs on qs.n = k.n left join s on s.n = k.n and s.v = k.month and s.q = qs.q where k.n % 5 in (0, 4) and unread = 0""")
def join_parts(spark, d):
    """The joined table of every workbook that could be read: vintages of all parts in order of release, shorter parts padded."""
    table, _ = sheets.read(workbook.xlsx_cells(spark, _folder(spark, d), numbers=True))
    return _named(table).select("path", "number", "month", F.col("quarter").cast("long").alias("quarter"), "kind", "level")


# A heading that states a month; of these the year 2000; of these January.
HEADINGS = [(1, "heading", "^[A-Z][a-z]{2} [0-9]{4}$", True), (2, "heading", " 2000$", True), (3, "heading", "^Jan", True)]


@query(f"""with {_AMOUNTS}, h as (select n, sheet, col, v, not silent s1, v // 12 = 2000 s2, v % 12 = 0 s3 from co), g as (select *, case when not s1 then 1 when not s2 then 2 when not s3 then 3 end gone from h),
c as (select n, sheet, j stage, count_if(gone is null or gone > j) k from g, unnest(range(1, 4)) t(j) group by 1, 2, 3), f as (select n, sheet, coalesce(min(case when k <= 1 then stage end), 3) stage from c group by 1, 2),
o as (select n, sheet, stage, case k when 1 then 'chosen' when 0 then 'nothing' else 'several' end outcome from f join c using (n, sheet, stage))
select 'nation' || n path, sheet, outcome, stage, max(case when outcome = 'chosen' and coalesce(gone > stage, true) then col end) chosen_col, count(*) rivals from g join o using (n, sheet) group by 1, 2, 3, 4""")
def header_only(spark, d):
    """The column that the headings alone select in every sheet, the stage that decided, and how many columns there were."""
    c = workbook.xlsx_cells(spark, _folder(spark, d), max_row=5).where("row = 5 and col > 2 and kind = 'text'")
    candidates = c.select("path", "sheet", F.col("col").alias("candidate"), F.create_map(F.lit("heading"), "text").alias("fields"))
    made = cascade.cascade(candidates, spark.createDataFrame(HEADINGS, "stage int, field string, pattern string, wanted boolean"), ["path", "sheet"])
    out = made.groupBy("path", "sheet", "outcome", "stage").agg(F.max(F.when(F.col("chosen"), F.col("candidate"))).cast("long").alias("chosen_col"), F.count("*").alias("rivals"))
    return _named(out).select("path", "sheet", "outcome", "stage", "chosen_col", "rivals")


@query("""select o_orderpriority, cast(sum(cast(o_totalprice as decimal(18,2))) as double) total, count(*) as rows from orders group by 1""")
def report_parts(spark, d):
    """Records as transactional part files with a manifest, and read back with their digests checked."""
    path = shared.new_path(spark, "parts")
    parts.write_lines(b.read(spark, d, "orders").select("o_orderkey", "o_orderpriority", F.col("o_totalprice").cast("decimal(18,2)").alias("price")), path)
    back = parts.read_lines(spark, path, "o_orderkey long, o_orderpriority string, price decimal(18,2)")
    return back.groupBy("o_orderpriority").agg(F.sum("price").cast("double").alias("total"), F.count("*").alias("rows"))
