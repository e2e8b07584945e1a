"""Accounting, vintages, joins, set operations and storage checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import stats
from tidemark.operators import accounting as acc
from tidemark.operators import vintage as vt
from tidemark.plans import base as b
from tidemark.plans.catalogue import query
from tidemark.sources import shared

r6 = lambda *names: [F.round(n, 6).alias(n) for n in names]
T = b.SQL_TRIANGLE

# ------------------------------------------------ attempts and replicates, derived from line items
_ATTEMPTS_SQL = """att as (select l_suppkey % 20 cell, l_orderkey replicate, l_linenumber n, case when l_returnflag = 'N' then 'retained' when l_returnflag = 'R' then 'retained' when l_linenumber = 7 then 'failed' else 'no_eligible_episode' end status,
  l_discount statistic, 0.05 observed from lineitem)"""


def attempts(spark, d):
    flag, n = F.col("l_returnflag"), F.col("l_linenumber")
    status = F.when(flag.isin("N", "R"), "retained").when(n == 7, "failed").otherwise("no_eligible_episode")
    return b.read(spark, d, "lineitem").select((F.col("l_suppkey") % 20).alias("cell"), F.col("l_orderkey").alias("replicate"), n.alias("n"), status.alias("status"), F.col("l_discount").alias("statistic"), F.lit(0.05).alias("observed"))


@query(f"""with {_ATTEMPTS_SQL} select cell, count_if(status = 'retained') retained, count_if(status = 'no_eligible_episode') no_episode, count_if(status = 'failed') failed,
 case when count_if(status = 'failed') > 0 then 'failed' when count_if(status = 'retained') = 0 then 'no_draws' else 'complete' end comparison,
 round(case when count_if(status = 'failed') = 0 and count_if(status = 'retained') > 0 then (1 + count_if(status = 'retained' and statistic >= observed))/(count_if(status = 'retained') + 1) end, 6) p from att group by cell""")
def comparison_status(spark, d):
    return acc.comparison_status(attempts(spark, d), ["cell"]).select("cell", "retained", "no_episode", "failed", "comparison", *r6("p"))


@query(f"with {_ATTEMPTS_SQL} select cell, round((1 + count_if(statistic >= observed))/(count(statistic) + 1), 6) p from att where status = 'retained' group by cell")
def mc_pvalue(spark, d):
    return attempts(spark, d).where("status = 'retained'").groupBy("cell").agg(F.round(stats.mc_pvalue(F.col("statistic"), F.lit(0.05)), 6).alias("p"))


@query(f"with {_ATTEMPTS_SQL} select cell, string_agg(status || '=' || n, ',' order by status) by_status from (select cell, status, count(*) n from att group by 1, 2) group by cell")
def failures_by_status(spark, d):
    m = acc.status_counts(attempts(spark, d), ["cell"])
    return m.select("cell", F.concat_ws(",", F.transform(F.map_entries("by_status"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string")))).alias("by_status"))


_REPS = "rep as (select o_custkey % 8 sid, o_custkey % 4 k4, 1.0 + 0.2*(o_custkey % 4) kappa, case when o_orderkey % 97 = 0 then null else (o_totalprice % 1000)/1000*(1 - 0.2*(o_custkey % 4)) end p, o_totalprice/100000 \"S\" from orders)"


def replicates(spark, d):
    o, c = F.col("o_totalprice"), F.col("o_custkey") % 4
    p = F.when(F.col("o_orderkey") % 97 != 0, (o % 1000) / 1000 * (1 - 0.2 * c))
    return b.read(spark, d, "orders").select((F.col("o_custkey") % 8).alias("sid"), (1.0 + 0.2 * c).alias("kappa"), p.alias("p"), (o / 100000).alias("S"))


_Z = "1.959963984540054"
_W = f"((k/n + {_Z}*{_Z}/(2*n))/(1 + {_Z}*{_Z}/n))"
_H = f"({_Z}/(1 + {_Z}*{_Z}/n)*sqrt(k/n*(1 - k/n)/n + {_Z}*{_Z}/(4*n*n)))"


@query(f"""with {_REPS}, c as (select sid, count(*) n, count(p) got, count_if(p <= 0.05) k, avg("S") ms, stddev_samp("S")/sqrt(count("S")) ss from rep group by sid)
select sid, n requested, n saved, got available, k rejected, round(k/n, 6) low_bound, round((k + n - got)/n, 6) high_bound, case when got = n then round(k/n, 6) end rate,
 case when got = n then round(sqrt(k/n*(1 - k/n)/n), 6) end se, case when got = n then round(greatest({_W} - {_H}, 0), 6) end wilson_low, case when got = n then round(least({_W} + {_H}, 1), 6) end wilson_high,
 case when got = n then round(ms, 6) end "mean_S", case when got = n then round(ss, 6) end "se_S" from c""")
def cell_summary(spark, d):
    out = acc.cell_summary(replicates(spark, d), ["sid"], F.count("*"))
    return out.select("sid", "requested", "saved", "available", "rejected", *r6("low_bound", "high_bound", "rate", "se", "wilson_low", "wilson_high", "mean_S", "se_S"))


@query(f"with c as (select l_suppkey % 50 cell, cast(count_if(l_returnflag = 'R') as double) k, count(*) n from lineitem group by 1) select cell, round(greatest({_W} - {_H}, 0), 6) low, round(least({_W} + {_H}, 1), 6) high from c")
def wilson_interval(spark, d):
    c = b.read(spark, d, "lineitem").groupBy((F.col("l_suppkey") % 50).alias("cell")).agg(F.count_if(F.col("l_returnflag") == "R").alias("k"), F.count("*").alias("n"))
    return c.select("cell", stats.wilson("k", "n").alias("w")).select("cell", F.round("w.low", 6).alias("low"), F.round("w.high", 6).alias("high"))


@query(f"with {_REPS}, c as (select sid, count(*) n, count_if(p <= 0.05) k from rep where p is not null group by sid) select sid, round(k/n, 6) rate, k/n between 0.01 and 0.09 as pass from c")
def size_summary(spark, d):
    c = replicates(spark, d).where("p is not null").groupBy("sid").agg((F.count_if(F.col("p") <= 0.05) / F.count("*")).alias("rate"))
    return c.select("sid", *r6("rate"), F.col("rate").between(0.01, 0.09).alias("pass"))


_CELLS = f"{_REPS}, cl as (select o_custkey % 7 sid, 1.0 + 0.2*(o_custkey % 4) kappa, count_if(o_totalprice % 1000 <= 100 + 260*(o_custkey % 4))/count(*) rate, sqrt(count_if(o_totalprice % 1000 <= 100 + 260*(o_custkey % 4))/count(*)*(1 - count_if(o_totalprice % 1000 <= 100 + 260*(o_custkey % 4))/count(*))/count(*)) se from orders group by 1, 2)"


@query(f"""with {_CELLS}, w as (select *, lag(rate) over v r0, lag(se) over v s0, lag(kappa) over v k0 from cl window v as (partition by sid order by kappa)),
x as (select *, case when rate >= 0.8 then case when r0 is null then kappa when r0 < 0.8 then k0 + (kappa - k0)*(0.8 - r0)/(rate - r0) end end crossing from w)
select sid, round(kappa, 6) kappa, round(rate, 6) rate, round(rate - r0, 6) as change, rate - r0 < -1.96*sqrt(se*se + s0*s0) decrease, round(min_by(crossing, case when crossing is not null then kappa end) over (partition by sid), 6) kappa_80 from x""")
def power_summary(spark, d):
    c = F.col("o_custkey") % 4
    cells = b.read(spark, d, "orders").groupBy((F.col("o_custkey") % 7).alias("sid"), (1.0 + 0.2 * c).alias("kappa")).agg(F.count_if(F.col("o_totalprice") % 1000 <= 100 + 260 * c).alias("k"), F.count("*").alias("n"))
    cells = cells.withColumn("rate", F.col("k") / F.col("n")).withColumn("se", F.sqrt(F.col("rate") * (1 - F.col("rate")) / F.col("n")))
    return acc.power_summary(cells).select("sid", *r6("kappa", "rate", "change"), "decrease", *r6("kappa_80"))


_FAMILY = "fam as (select n_regionkey fam, n_nationkey id, case when n_nationkey % 6 = 5 then null else ((n_nationkey*37) % 101)/1000.0 end p from nation)"


@query(f"""with {_FAMILY}, q as (select *, coalesce(p, 1.0) pp from fam), w as (select *, (count(*) over (partition by fam) - row_number() over (partition by fam order by pp, id) + 1)*pp a from q)
select fam, id, round(least(1.0, max(a) over (partition by fam order by pp, id rows unbounded preceding)), 6) adjusted from w""")
def holm_adjust(spark, d):
    k = F.col("n_nationkey")
    fam = b.read(spark, d, "nation").select(F.col("n_regionkey").alias("fam"), k.alias("id"), F.when(k % 6 != 5, ((k * 37) % 101) / 1000.0).alias("p"))
    return acc.holm_adjust(fam, ["fam"]).select("fam", "id", *r6("adjusted"))


@query(f"with {_FAMILY} select id, case when p is not null and n_up is not null then p > 0.05 and n_up < 1.2 end branch from (select *, case when id % 5 = 0 then null else 1.0 + (id % 4)*0.1 end n_up from fam)")
def branch_b(spark, d):
    k = F.col("n_nationkey")
    fam = b.read(spark, d, "nation").select(k.alias("id"), F.when(k % 6 != 5, ((k * 37) % 101) / 1000.0).alias("p"), F.when(k % 5 != 0, 1.0 + (k % 4) * 0.1).alias("up"))
    return fam.select("id", stats.branch_b("p", "up", F.lit(1.2)).alias("branch"))


@query("select l_suppkey % 40 cell, round(quantile_cont(l_extendedprice, 0.025), 6) low, round(quantile_cont(l_extendedprice, 0.975), 6) high from lineitem group by 1")
def percentile_band(spark, d):
    q = F.percentile("l_extendedprice", [0.025, 0.975])
    return b.read(spark, d, "lineitem").groupBy((F.col("l_suppkey") % 40).alias("cell")).agg(q.alias("q")).select("cell", F.round(F.col("q")[0], 6).alias("low"), F.round(F.col("q")[1], 6).alias("high"))


@query("""select round(max(abs(a.v - z.v)), 6) max_diff, count_if(abs(a.v - z.v) > 0) differing, count_if(a.v is null or z.v is null) one_sided
from (select o_custkey k, max(o_totalprice) v from orders where o_orderstatus = 'F' group by 1) a full join (select o_custkey k, max(o_totalprice) v from orders where o_orderstatus = 'O' group by 1) z on z.k = a.k""")
def max_diff(spark, d):
    o = b.read(spark, d, "orders")
    side = lambda s: o.where(F.col("o_orderstatus") == s).groupBy(F.col("o_custkey").alias("k")).agg(F.max("o_totalprice").alias("v"))
    return acc.max_diff(side("F"), side("O"), ["k"], "v").select(*r6("max_diff"), "differing", "one_sided")


@query("select o_orderkey, count(l_orderkey) n_events from orders left join lineitem on l_orderkey = o_orderkey group by 1 having count(l_orderkey) <> 1")
def journal_check(spark, d):
    events = b.read(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return acc.journal_check(b.read(spark, d, "orders"), events, "o_orderkey")[0]


@query("select l_orderkey, l_linenumber from lineitem where not exists (select 1 from orders where o_orderkey = l_orderkey and o_orderstatus <> 'F')")
def journal_orphans(spark, d):
    records = b.read(spark, d, "orders").where("o_orderstatus <> 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    return acc.journal_check(records, b.read(spark, d, "lineitem").select("l_orderkey", "l_linenumber"), "l_orderkey")[1]


@query("""with a as (select c_custkey k, c_mktsegment h from customer where c_custkey % 3 <> 0), z as (select c_custkey k, case when c_custkey % 10 = 1 then 'x' else c_mktsegment end h from customer where c_custkey % 4 <> 0)
select coalesce(a.k, z.k) k, case when z.k is null then 'missing' when a.k is null then 'unlisted' when a.h is not distinct from z.h then 'listed' else 'changed' end status from a full join z on z.k = a.k""")
def manifest_reconcile(spark, d):
    c, k = b.read(spark, d, "customer"), F.col("c_custkey")
    left = c.where(k % 3 != 0).select(k.alias("k"), F.col("c_mktsegment").alias("h"))
    right = c.where(k % 4 != 0).select(k.alias("k"), F.when(k % 10 == 1, "x").otherwise(F.col("c_mktsegment")).alias("h"))
    return acc.reconcile(left, right, "k", "h", "h")


@query("select o_orderkey, o_custkey from orders where not exists (select 1 from lineitem where l_orderkey = o_orderkey and l_returnflag = 'R') order by 1, 2 limit 100")
def bounded_batch(spark, d):
    """The bound is the feature: at most 100 coordinates that aren't done."""
    done = b.read(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey")).distinct()
    o = b.read(spark, d, "orders").select("o_orderkey", "o_custkey")
    return o.join(done, "o_orderkey", "left_anti").orderBy("o_orderkey", "o_custkey").limit(100)


@query("select o_orderkey, o_totalprice from orders where o_orderkey >= 1000 and o_orderkey < 5000")
def replicate_range(spark, d):
    return b.read(spark, d, "orders").where("o_orderkey >= 1000 and o_orderkey < 5000").select("o_orderkey", "o_totalprice")


@query("select o_orderkey, o_orderstatus from orders")
def disjoint_union(spark, d):
    o = b.read(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    return acc.disjoint_union([o.where(F.col("o_orderkey") % 3 == k) for k in range(3)], ["o_orderkey"])


@query("select c_custkey from customer except select o_custkey from orders where o_orderpriority = '1-URGENT'")
def set_difference(spark, d):
    return b.read(spark, d, "customer").select("c_custkey").exceptAll(b.read(spark, d, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey")).distinct())


@query("select r.i as missing from (select unnest(range(0, greatest(20000, (select max(o_orderkey) + 1 from orders)))) i) r where not exists (select 1 from orders where o_orderkey = r.i)")
def missing_coordinates(spark, d):
    """Planned ids, 0 to the largest key and 0 to 19,999 at least, that have no order."""
    keys = b.read(spark, d, "orders").select(F.col("o_orderkey").alias("missing"))
    top = keys.agg(F.max("missing")).first()[0]
    return spark.range(max(20000, (top or 0) + 1)).select(F.col("id").alias("missing")).join(keys, "missing", "left_anti")


@query("select distinct year(o_orderdate) as year from orders intersect select distinct year(l_shipdate) from lineitem")
def intersection_of_years(spark, d):
    a = b.read(spark, d, "orders").select(F.year("o_orderdate").cast("long").alias("year")).distinct()
    return a.intersect(b.read(spark, d, "lineitem").select(F.year("l_shipdate").cast("long").alias("year")))


@query("""with s as (select o_custkey k, list_sort(list(distinct year(o_orderdate))) ys from orders where o_orderstatus = 'F' group by 1), t as (select o_custkey k, list_sort(list(distinct year(o_orderdate))) ys from orders where o_orderstatus = 'O' group by 1)
select s.k, s.ys = t.ys same from s join t on t.k = s.k""")
def set_equality(spark, d):
    o = b.read(spark, d, "orders")
    side = lambda s, n: o.where(F.col("o_orderstatus") == s).groupBy(F.col("o_custkey").alias("k")).agg(F.sort_array(F.collect_set(F.year("o_orderdate"))).alias(n))
    return side("F", "a").join(side("O", "z"), "k").select("k", (F.col("a") == F.col("z")).alias("same"))


@query("select o_custkey k, o_orderkey, o_totalprice from (select *, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) rn from orders) where rn = 1")
def rank_first(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("o_custkey").orderBy(F.col("o_totalprice").desc(), "o_orderkey")
    return b.read(spark, d, "orders").withColumn("rn", F.row_number().over(w)).where("rn = 1").select(F.col("o_custkey").alias("k"), "o_orderkey", "o_totalprice")


@query("""with a as (select year(o_orderdate) y, o_custkey k, max(o_totalprice) v from orders where o_orderkey % 2 = 0 group by 1, 2), z as (select year(o_orderdate) y, o_custkey k, max(o_totalprice) v from orders where o_orderkey % 2 = 1 group by 1, 2)
select a.y, a.k, a.v v1, z.v v2 from a join z on z.y = a.y and z.k = a.k where a.v <> z.v""")
def v1_v2_compare(spark, d):
    o = b.read(spark, d, "orders")
    side = lambda r, n: o.where(F.col("o_orderkey") % 2 == r).groupBy(F.year("o_orderdate").cast("long").alias("y"), F.col("o_custkey").alias("k")).agg(F.max("o_totalprice").alias(n))
    return side(0, "v1").join(side(1, "v2"), ["y", "k"]).where("v1 <> v2")


@query("select r_name, n_name, row_number() over (order by r_name, n_name) place from nation join region on r_regionkey = n_regionkey")
def chronological_order(spark, d):
    from pyspark.sql import Window

    j = b.read(spark, d, "nation").join(b.read(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))  # two tables of fixed size
    return j.select("r_name", "n_name", F.row_number().over(Window.orderBy("r_name", "n_name")).cast("long").alias("place"))


# ------------------------------------------------ vintages
@query(f"with {T} select vintage, quarter, kind, round(level, 6) as level from tri")
def build_tables(spark, d):
    return b.monthly_triangle(spark, d).select("vintage", "quarter", "kind", *r6("level"))


_SHEETS = f"""{T}, all_ as (select q.quarter, v.vintage from (select distinct quarter from tri) q, (select distinct vintage from tri) v)"""


@query(f"""with {_SHEETS} select dense_rank() over (order by a.vintage) - 1 as number, strftime(make_date(cast(a.vintage // 12 as int), cast(a.vintage % 12 + 1 as int), 1), '%b %Y') as label, a.vintage as month,
 a.quarter - 16000 as quarter, case when t.level is not null then 'numeric' when (a.quarter + a.vintage) % 5 = 0 then 'marker' else 'empty' end kind, round(t.level, 6) as level
 from all_ a left join tri t on t.quarter = a.quarter and t.vintage = a.vintage""")
def read_table(spark, d):
    """The triangle laid out as two sheets side by side, later vintages first, with labels and markers, and read back."""
    tri = b.monthly_triangle(spark, d)
    quarters, vintages = tri.select("quarter").distinct(), tri.select("vintage").distinct()
    grid = quarters.join(F.broadcast(vintages))  # months by months: bounded by the calendar
    middle = vintages.agg(F.percentile_approx("vintage", 0.5)).first()[0]
    text = F.when(F.col("level").isNotNull(), F.col("level").cast("string")).when((F.col("quarter") + F.col("vintage")) % 5 == 0, "..")
    label = F.date_format(F.make_date(F.floor(F.col("vintage") / 12).cast("int"), (F.col("vintage") % 12 + 1).cast("int"), F.lit(1)), "MMM yyyy")
    q = (F.col("quarter") - 16_000).cast("int")
    cells = grid.join(tri, ["quarter", "vintage"], "left").select(
        F.when(F.col("vintage") > middle, "a").otherwise("b").alias("part"), (-F.col("vintage")).alias("col"), label.alias("vintage_label"), F.col("quarter").alias("row"),
        F.concat(F.floor(q / 4).cast("string"), F.lit(" Q"), (q % 4 + 1).cast("string")).alias("quarter_label"),
        F.when(F.col("level").isNotNull(), "number").when(text.isNotNull(), "text").otherwise("empty").alias("kind"), text.alias("text"),
    )
    out = vt.read_table(cells)
    return out.select("number", "label", F.col("month").cast("long").alias("month"), F.col("quarter").cast("long").alias("quarter"), "kind", *r6("level"))


@query(f"with {T} select quarter, min(vintage) vintage from tri where kind = 'numeric' group by quarter")
def first_present(spark, d):
    return vt.first_present(b.monthly_triangle(spark, d))


@query(f"with {T} select quarter, round(max_by(level, vintage), 6) as level from tri where vintage <= 23976 and level is not null group by quarter")
def vintage_asof(spark, d):
    return vt.as_of(b.monthly_triangle(spark, d), 23976).select("quarter", *r6("level"))


@query(f"with {T} select vintage, quarter from (select *, lag(kind) over (partition by quarter order by vintage) b from tri) where kind = 'numeric' and (b is null or b <> 'numeric')")
def prev_vintage(spark, d):
    return vt.previous_lacks(b.monthly_triangle(spark, d))


_ONSETS = "(values (23960), (23970), (23980), (23990))"


@query(f"""with {T}, t as (select tri.vintage, o.onset, quarter, kind, row_number() over (partition by vintage, onset order by quarter desc) rk from tri join (select * from {_ONSETS} v(onset)) o on quarter < onset where quarter >= 23940),
f as (select *, kind = 'numeric' and quarter = onset - rk fine from t), s as (select *, sum(case when fine then 0 else 1 end) over (partition by vintage, onset order by quarter desc rows unbounded preceding) br from f),
r as (select vintage, onset, min(case when br = 0 then quarter end) \"first\", count_if(br = 0) length, max(case when not fine then quarter end) bad from s group by 1, 2)
select vintage, onset, \"first\", length, case when \"first\" = 23940 then 'floor' when bad = coalesce(\"first\", onset) - 1 then 'gap' else 'no_row' end ended_by from r""")
def vintage_run(spark, d):
    onsets = F.broadcast(spark.createDataFrame([(x,) for x in (23960, 23970, 23980, 23990)], "onset long"))
    t = b.monthly_triangle(spark, d).join(onsets, F.col("quarter") < F.col("onset"))
    return vt.vintage_run(t, 23940)


_GROWTHS = f"{T}, gr as (select * from (select vintage, quarter, case when quarter = lag(quarter) over w + 1 then 400*(ln(level) - ln(lag(level) over w)) end x from tri where level is not null window w as (partition by vintage order by quarter)) where x is not null)"


def _growths(triangle):
    from pyspark.sql import Window

    w = Window.partitionBy("vintage").orderBy("quarter")
    t = triangle.where("level is not null")
    x = F.when(F.col("quarter") == F.lag("quarter").over(w) + 1, 400 * (F.log("level") - F.log(F.lag("level").over(w))))
    return t.withColumn("x", x).where("x is not null").select("vintage", "quarter", "x")


@query(f"with {_GROWTHS} select vintage, quarter, round(x, 6) x from gr")
def vintage_series(spark, d):
    return _growths(b.monthly_triangle(spark, d)).select("vintage", "quarter", *r6("x"))


@query(f"with {_GROWTHS} select a.quarter onset, min(a.vintage) vintage from gr a join gr z on z.vintage = a.vintage and z.quarter = a.quarter + 1 where a.x < 0 and z.x < 0 group by 1")
def first_showing_onset(spark, d):
    return vt.first_showing_onset(_growths(b.monthly_triangle(spark, d)))


@query(f"with {T} select vintage, count_if(kind = 'numeric') n_numeric, count_if(kind = 'empty') n_empty, count_if(kind = 'marker') n_marker, count_if(kind = 'other') n_other from tri group by grouping sets ((vintage), ())")
def availability_report(spark, d):
    return vt.availability_report(b.monthly_triangle(spark, d))


@query(f"""with {T}, lb as (select vintage % 7 part, vintage as month, row_number() over (partition by vintage % 7 order by case when vintage % 2 = 0 then vintage else vintage + 1 end, vintage) place from (select distinct vintage from tri)),
s as (select *, month - lag(month) over (partition by part order by place) st from lb)
select part, month, place, row_number() over (partition by part order by month, place) - 1 as number, case when min(st) over (partition by part) >= 0 then 'ascending' when max(st) over (partition by part) <= 0 then 'descending' else 'mixed' end direction from s""")
def order_vintages(spark, d):
    from pyspark.sql import Window

    v = b.monthly_triangle(spark, d).select("vintage").distinct()
    w = Window.partitionBy("part").orderBy(F.when(F.col("vintage") % 2 == 0, F.col("vintage")).otherwise(F.col("vintage") + 1), "vintage")
    lb = v.withColumn("part", F.col("vintage") % 7).withColumn("place", F.row_number().over(w).cast("long")).select("part", F.col("vintage").alias("month"), "place")
    return vt.order_vintages(lb).withColumn("number", F.col("number").cast("long"))


_FLOOR = 1995 * 12


@query(f"""with {_GROWTHS}, la as (select quarter, x, lag(x) over w b, lead(x) over w a from gr where vintage = (select max(vintage) from gr) window w as (order by quarter)),
ep as (select quarter onset, row_number() over (order by quarter) - 1 j from la where x < 0 and a < 0 and coalesce(b, 0) >= 0),
e as (select ep.*, (select min(vintage) from tri where kind = 'numeric' and quarter = onset - 1) k from ep), e2 as (select *, (select max(vintage) from tri where vintage < k) before from e),
rk as (select e2.*, tri.quarter, kind, level, row_number() over (partition by j order by tri.quarter desc) r from e2 join tri on tri.vintage = k and tri.quarter < onset and tri.quarter >= {_FLOOR}),
br as (select *, sum(case when kind = 'numeric' and quarter = onset - r then 0 else 1 end) over (partition by j order by quarter desc rows unbounded preceding) b from rk),
ru as (select j, count_if(b = 0) length, min(case when b = 0 then quarter end) f, max(case when not (kind = 'numeric' and quarter = onset - r) then quarter end) bad, count_if(b = 0 and level <= 0) odd, min(onset) o from br group by j),
z as (select e2.*, greatest(coalesce(length, 0) - 1, 0) n_v, case when length is not null then case when f = {_FLOOR} then 'floor' when bad = coalesce(f, o) - 1 then 'gap' else 'no_row' end end ended_by, coalesce(odd, 0) odd from e2 left join ru using (j))
select j, onset, k vintage, n_v, ended_by, case when k is null then '7.1' when before is null or exists (select 1 from tri where tri.vintage = before and tri.quarter = onset - 1 and kind = 'numeric') then '7.2' when n_v < 48 then '7.3' when odd > 0 then '7.4' end failed_step,
 k is not null and before is not null and not exists (select 1 from tri where tri.vintage = before and tri.quarter = onset - 1 and kind = 'numeric') and n_v >= 48 and odd = 0 usable from z""")
def select_episode(spark, d):
    """Episodes of the latest vintage, each with the vintage that first knew the month before it and the run that vintage had."""
    from pyspark.sql import Window

    t = shared.written(b.monthly_triangle(spark, d), "triangle")
    g = _growths(t)
    w = Window.partitionBy(F.lit("latest")).orderBy("quarter")  # one vintage's months
    last = g.join(F.broadcast(g.agg(F.max("vintage").alias("vintage"))), "vintage").withColumns({"b": F.lag("x").over(w), "a": F.lead("x").over(w)})
    onsets = last.where((F.col("x") < 0) & (F.col("a") < 0) & (F.coalesce("b", F.lit(0.0)) >= 0)).select(F.col("quarter").alias("onset"))
    onsets = onsets.withColumn("j", (F.row_number().over(Window.partitionBy(F.lit("latest")).orderBy("onset")) - 1).cast("long"))
    return vt.select_episodes(t, onsets, _FLOOR)


@query(f"""with {T}, f as (select quarter, min_by(level, vintage) a, max_by(level, vintage) z from tri where level is not null group by quarter) select quarter, round(a, 6) real_time, round(z, 6) final, round(z - a, 6) revision from f""")
def rt_vs_final(spark, d):
    t = b.monthly_triangle(spark, d).where("level is not null")
    first = t.groupBy("quarter").agg(F.min_by("level", "vintage").alias("change"))
    final = t.groupBy("quarter").agg(F.max_by("level", "vintage").alias("change"))
    return vt.revisions(first, final, "quarter").select("quarter", *r6("real_time", "final", "revision"))


@query("""with e as (select o_orderkey vintage, year(o_orderdate)*4 + quarter(o_orderdate) - 1 onset from orders), r as (select l_orderkey vintage, min(l_shipdate) released from lineitem group by 1),
q as (select e.vintage, onset, cast(r.released as date) released, last_day(make_date(cast(floor(onset/4) as int), cast(3*(onset % 4) + 3 as int), 1)) qe from e left join r on r.vintage = e.vintage)
select vintage, onset, date_diff('day', qe, released) as days, case when released < qe then 'before' when released > qe then 'after' when released = qe then 'same' end \"order\" from q""")
def two_clocks(spark, d):
    e = b.read(spark, d, "orders").select(F.col("o_orderkey").alias("vintage"), (F.year("o_orderdate") * 4 + F.quarter("o_orderdate") - 1).cast("long").alias("onset"))
    r = b.read(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("vintage")).agg(F.min("l_shipdate").cast("date").alias("released"))
    return vt.two_clocks(e, r).select("vintage", "onset", F.col("days").cast("long").alias("days"), "order")


@query("select e.event_type, cast(e.ts as date)::varchar as day, count(distinct e.user_id) as n from events e join (select event_type t, min(cast(ts as date)) first_day from events group by 1) f on f.t = e.event_type and cast(e.ts as date) = f.first_day group by 1, 2")
def edition_calendar(spark, d):
    """Editions meet calendar entries of equal date and listing."""
    e = b.read(spark, d, "events").withColumn("day", F.col("ts").cast("date"))
    cal = e.groupBy("event_type").agg(F.min("day").alias("day"))
    return e.join(cal, ["event_type", "day"]).groupBy("event_type", F.col("day").cast("string").alias("day")).agg(F.countDistinct("user_id").alias("n"))
