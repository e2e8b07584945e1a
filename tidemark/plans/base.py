"""The driver's tables seen as the engine's inputs, and the same as SQL text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import series
from tidemark.sources import shared


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def weekly_levels(spark: SparkSession, sf_dir: str, bucket: str = "week") -> DataFrame:
    """Order value by market segment and calendar bucket: sid, bucket, pos, y."""
    orders = read(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", "o_totalprice")
    customers = read(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    joined = orders.join(customers, F.col("o_custkey") == F.col("c_custkey"))
    return series.levels(joined, F.col("c_mktsegment"), F.col("o_orderdate"), F.col("o_totalprice"), bucket)


def weekly_growth(spark: SparkSession, sf_dir: str, bucket: str = "week") -> DataFrame:
    return series.growth(weekly_levels(spark, sf_dir, bucket)).select("sid", "pos", "x")


def sql_levels(bucket: str = "week") -> str:
    return f"""lv as (select c_mktsegment sid, date_trunc('{bucket}', o_orderdate) bucket, cast(sum(cast(o_totalprice as decimal(18,2))) as double) y
  from orders join customer on o_custkey = c_custkey group by 1, 2),
ix as (select sid, bucket, row_number() over (partition by sid order by bucket) - 1 pos, y from lv
  where bucket < (select max(date_trunc('{bucket}', o_orderdate)) from orders)),
g as (select sid, bucket, pos - 1 pos, x from (select *, 400 * (ln(y) - ln(lag(y) over (partition by sid order by pos))) x from ix) where x is not null)"""


SQL_LAGS = """lg as (select sid, pos, x, l1, l2 from (select *, lag(x) over (partition by sid order by pos) l1, lag(x, 2) over (partition by sid order by pos) l2 from g)
  where l2 is not null)"""
_SOLVE = """select *, case when det is null then null else (s22*s1y - s12*s2y)/det end p1, case when det is null then null else (s11*s2y - s12*s1y)/det end p2
  from (select *, case when s11*s22 - s12*s12 > 1e-12*s11*s22 then s11*s22 - s12*s12 end det from {source})"""
_MODULUS = "case when p1*p1 + 4*p2 < 0 then sqrt(-p2) when abs(p1) + sqrt(greatest(p1*p1 + 4*p2, 0)) = 0 then 0.0 else greatest((abs(p1) + sqrt(greatest(p1*p1 + 4*p2, 0)))/2, abs(p2/((abs(p1) + sqrt(greatest(p1*p1 + 4*p2, 0)))/2))) end"
_MOMENTS = "count(l2) {o} n, var_pop(l1) {o} s11, var_pop(l2) {o} s22, covar_pop(l1, l2) {o} s12, covar_pop(x, l1) {o} s1y, covar_pop(x, l2) {o} s2y, avg(x) {o} my, avg(l1) {o} m1, avg(l2) {o} m2"


def sql_fit(window: int = 40, frame: str | None = None, name: str = "mm") -> str:
    """CTEs ws and `name`: sid, pos, n, p1, p2, c, m of every window."""
    o = f"over (partition by sid order by pos rows between {frame or f'{window - 3} preceding'} and current row)"
    return f"""ws as (select * from (select sid, pos, {_MOMENTS.format(o=o)} from lg) where n {'>=' if frame else '='} {window - 2}),
{name} as (select sid, pos, n, p1, p2, my - p1*m1 - p2*m2 c, {_MODULUS} m from ({_SOLVE.format(source='ws')}))"""


def sql_full_fit() -> str:
    return f"""fs as (select sid, {_MOMENTS.format(o='')} from lg group by sid),
ff as (select sid, n, p1, p2, my - p1*m1 - p2*m2 c, {_MODULUS} m from ({_SOLVE.format(source='fs')}))"""


def sql_episodes(least: int = 2, merge: int = 8) -> str:
    return f"""neg as (select sid, pos, pos - row_number() over (partition by sid order by pos) island from g where x < 0),
rn as (select sid, min(pos) onset, max(pos) fin from neg group by sid, island having count(*) >= {least}),
fl as (select *, case when onset - lag(fin) over (partition by sid order by onset) <= {merge} then 0 else 1 end fresh from rn),
ep as (select sid, onset, fin, sum(fresh) over (partition by sid order by onset rows unbounded preceding) episode from fl),
eps as (select sid, cast(episode as bigint) episode, min(onset) onset, max(fin) fin, count(*) runs from ep group by 1, 2)"""


SQL_CHANGES = """ch as (select e.*, a.m - b.m change from eps e left join mm a on a.sid = e.sid and a.pos = e.onset - 1 left join mm b on b.sid = e.sid and b.pos = e.onset - 9)"""


def monthly_triangle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order months as reference periods, ship months as vintages: vintage, quarter, kind, level.  A level is the value of
    a month's orders shipped by the end of the vintage month, on or after their order day.  The sums by month are written
    once (a row for each two months): the plan names them three times, and callers name the triangle many times."""
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_shipdate", "l_extendedprice")
    month = lambda d: (F.year(d) * 12 + F.month(d) - 1).cast("long")
    j = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).where("l_shipdate >= o_orderdate")
    inc = j.groupBy(month("o_orderdate").alias("quarter"), month("l_shipdate").alias("vintage")).agg(F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).alias("s"))
    inc = shared.written(inc, "months")
    periods = inc.select("quarter").distinct()
    vintages = inc.select("vintage").distinct()
    grid = periods.join(F.broadcast(vintages), F.col("vintage") >= F.col("quarter"))  # months: bounded by the calendar
    from pyspark.sql import Window

    w = Window.partitionBy("quarter").orderBy("vintage").rowsBetween(Window.unboundedPreceding, 0)
    full = grid.join(inc, ["quarter", "vintage"], "left").withColumn("level", F.sum("s").over(w).cast("double"))
    return full.select("vintage", "quarter", F.when(F.col("level").isNull(), "empty").otherwise("numeric").alias("kind"), "level")


SQL_TRIANGLE = """inc as (select year(o_orderdate)*12 + month(o_orderdate) - 1 as quarter, year(l_shipdate)*12 + month(l_shipdate) - 1 vintage, sum(cast(l_extendedprice as decimal(18,2))) s
  from lineitem join orders on l_orderkey = o_orderkey where l_shipdate >= o_orderdate group by 1, 2),
grid as (select q.quarter, v.vintage from (select distinct quarter from inc) q join (select distinct vintage from inc) v on v.vintage >= q.quarter),
tri as (select vintage, quarter, case when level is null then 'empty' else 'numeric' end kind, level from
  (select grid.vintage, grid.quarter, cast(sum(s) over (partition by grid.quarter order by grid.vintage rows unbounded preceding) as double) level
   from grid left join inc on inc.quarter = grid.quarter and inc.vintage = grid.vintage))"""


# ------------------------------------------------ least squares of several regressors, as SQL
def sql_regression(source: str, z: list[str], y: list[str], by: str, over: str = "", least: int = 0, name: str = "rg") -> str:
    """CTEs up to `name`: by, n, c_<y>, b_<z>_<y>, from normal equations by elimination without exchange of rows, one CTE for each
    unknown; coefficients are null where a pivot is lost."""
    cov = [f"covar_pop({a}, {v}) {over} as s_{a}_{v}" for a in z for v in (*z, *y)]
    avg = [f"avg({v}) {over} as m_{v}" for v in (*z, *y)]
    group = "" if over else f" group by {by}"
    out = f"{name}_m as (select * from (select {by}, count(*) {over} as n, {', '.join(cov + avg)} from {source}{group}) where n >= {least}),\n"
    unit = [f"s_{a}_{v}/nullif(sqrt(s_{a}_{a}){f'*sqrt(s_{v}_{v})' if v in z else ''}, 0) as a_{a}_{v}" for a in z for v in (*z, *y)]
    out += f"{name}_0 as (select {by}, n, {', '.join(f'm_{v}' for v in (*z, *y))}, {', '.join(f'sqrt(s_{a}_{a}) as d_{a}' for a in z)}, {', '.join(unit)} from {name}_m),\n"
    keep = f"{by}, n, {', '.join(f'm_{v}' for v in (*z, *y))}, {', '.join(f'd_{a}' for a in z)}"
    for k, p in enumerate(z):
        rest = [*z[k + 1 :], *y]
        cells = [f"a_{p}_{v}/nullif(case when abs(a_{p}_{p}) > 1e-12 then a_{p}_{p} end, 0) as a_{p}_{v}" for v in rest]
        cells += [f"a_{a}_{v} - a_{a}_{p}*a_{p}_{v}/nullif(case when abs(a_{p}_{p}) > 1e-12 then a_{p}_{p} end, 0) as a_{a}_{v}" for a in z if a != p for v in rest]
        out += f"{name}_{k + 1} as (select {keep}, {', '.join(cells)} from {name}_{k}),\n"
    beta = [f"a_{a}_{v}/d_{a} as b_{a}_{v}" for a in z for v in y]
    out += f"{name}_b as (select {by}, n, {', '.join(f'm_{v}' for v in (*z, *y))}, {', '.join(beta)} from {name}_{len(z)}),\n"
    const = [f"m_{v} - {' - '.join(f'm_{a}*b_{a}_{v}' for a in z)} as c_{v}" for v in y]
    return out + f"{name} as (select *, {', '.join(const)} from {name}_b)"


def sql_radius(source: str, matrix: list[list[str]], key: str, name: str = "rad", steps: int = 40) -> str:
    """CTEs up to `name`: key, radius of a square matrix, by the norms of its repeated squares.  Needs `with recursive`."""
    n = len(matrix)
    start = ", ".join(x for row in matrix for x in row)
    norm = "sqrt(list_sum(list_transform({m}, lambda x: x*x)))"
    square = f"list_transform(range({n * n}), lambda k: list_sum(list_transform(range({n}), lambda j: m[(k // {n})*{n} + j + 1]*m[j*{n} + k % {n} + 1])))"
    return f"""{name}_0 as (select {key}, list_transform([{start}], lambda x: cast(x as double)) m0 from {source}),
{name}_s({key}, k, m, lg) as (select {key}, 0, list_transform(m0, lambda x: x/{norm.format(m='m0')}), ln({norm.format(m='m0')}) from {name}_0 where m0[1] is not null
  union all select {key}, k + 1, list_transform(q, lambda x: x/{norm.format(m='q')}), lg + ln({norm.format(m='q')})/power(2, k + 1) from (select {key}, k, {square} q, lg from {name}_s where k < {steps})),
{name} as (select {key}, exp(lg) radius from {name}_s where k = {steps})"""


SQL_PAIR = f"""{sql_levels()}, uu as (select c_mktsegment sid, date_trunc('week', o_orderdate) bucket, avg(l_discount)*100 u from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey group by 1, 2),
pr as (select * from (select ix.sid, pos - 1 pos, 400*(ln(y) - ln(lag(y) over w)) g, u - lag(u) over w du from ix join uu on uu.sid = ix.sid and uu.bucket = ix.bucket window w as (partition by ix.sid order by ix.bucket)) where g is not null),
vr as (select * from (select sid, pos, g, du, lag(g) over w g1, lag(du) over w d1, lag(g, 2) over w g2, lag(du, 2) over w d2 from pr window w as (partition by sid order by pos)) where g2 is not null and d2 is not null)"""
SQL_VAR_MATRIX = [["b_g1_g", "b_d1_g", "b_g2_g", "b_d2_g"], ["b_g1_du", "b_d1_du", "b_g2_du", "b_d2_du"], ["1", "0", "0", "0"], ["0", "1", "0", "0"]]
