"""Series, fits, windows, episodes and joins over the weekly panel of order values."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import roots
from tidemark.operators import episodes as ep
from tidemark.operators import fits, series
from tidemark.plans import base as b
from tidemark.plans.catalogue import query

G, L = b.sql_levels(), b.SQL_LAGS
FULL = f"with {G}, {L}, {b.sql_full_fit()}"
ROLL = f"with {G}, {L}, {b.sql_fit()}"
EPS = f"with {G}, {b.sql_episodes()}"
ALL = f"with {G}, {L}, {b.sql_fit()}, {b.sql_episodes()}, {b.SQL_CHANGES}"
r6 = lambda *names: [F.round(n, 6).alias(n) for n in names]


@query(f"with {G} select sid, cast(bucket as varchar) bucket, pos, round(x, 6) x from g")
def growth_q(spark, d):
    g = series.growth(b.weekly_levels(spark, d))
    return g.select("sid", F.date_format("bucket", "yyyy-MM-dd HH:mm:ss").alias("bucket"), "pos", *r6("x"))


@query(f"with {b.sql_levels('month')} select sid, pos, round(x / 4, 6) x from g")
def growth_a(spark, d):
    return series.growth(b.weekly_levels(spark, d, "month"), 100.0).select("sid", "pos", *r6("x"))


@query("""with u as (select date_trunc('month', l_shipdate) m, avg(cast(l_discount as decimal(12,4))) * 100 u from lineitem group by 1),
n as (select row_number() over (order by m) - 1 pos, u from u)
select pos, round(du, 6) du from (select pos, u - lag(u) over (order by pos) du from n) where du is not null""")
def diff_u(spark, d):
    from pyspark.sql import Window

    li = b.read(spark, d, "lineitem")
    u = li.groupBy(F.date_trunc("month", "l_shipdate").alias("m")).agg((F.sum(F.col("l_discount").cast("decimal(12,4)")).cast("double") / F.count("*") * 100).alias("u"))
    u = u.withColumn("sid", F.lit("all")).withColumn("pos", F.row_number().over(Window.partitionBy("sid").orderBy("m")).cast("long") - 1)
    return series.difference(u).select("pos", *r6("du"))


@query(f"with {G} select sid, pos - 10 as pos, round(x, 6) x from g where pos between 10 and 69")
def slice_contiguous(spark, d):
    return series.slice_contiguous(b.weekly_growth(spark, d), 10, 69).select("sid", (F.col("pos") - 10).alias("pos"), *r6("x"))


@query(f"with {G}, {L} select sid, pos, round(x, 6) x, round(l1, 6) l1, round(l2, 6) l2 from lg")
def design_matrix(spark, d):
    return series.lags(b.weekly_growth(spark, d)).select("sid", "pos", *r6("x", "l1", "l2"))


@query(f"{FULL} select sid, n, round(p1, 6) phi1, round(p2, 6) phi2, round(c, 6) intercept, round(m, 6) modulus, case when p1 is null then 'failed' else 'ok' end status from ff")
def ols_ar2(spark, d):
    return fits.ols_ar2(b.weekly_growth(spark, d)).select("sid", "n", *r6("phi1", "phi2", "intercept", "modulus"), "status")


@query(f"{ROLL} select sid, pos, n, round(p1, 6) phi1, round(p2, 6) phi2, round(c, 6) intercept, round(m, 6) modulus, case when p1 is null then 'failed' else 'ok' end status from mm")
def rolling_ar2(spark, d):
    return fits.rolling_ar2(b.weekly_growth(spark, d)).select("sid", "pos", "n", *r6("phi1", "phi2", "intercept", "modulus"), "status")


@query(f"with {G}, {L}, {b.sql_fit(frame='unbounded preceding')} select sid, pos, n, round(p1, 6) phi1, round(p2, 6) phi2, round(m, 6) modulus from mm")
def expanding_ols(spark, d):
    return fits.expanding_ar2(b.weekly_growth(spark, d)).select("sid", "pos", "n", *r6("phi1", "phi2", "modulus"))


@query(f"{ROLL} select sid, pos, p1 + p2 < 1 and p2 - p1 < 1 and p2 > -1 as stable from mm")
def in_triangle(spark, d):
    return fits.rolling_ar2(b.weekly_growth(spark, d)).select("sid", "pos", roots.in_triangle("phi1", "phi2").alias("stable"))


_SUMMARY = """select sid, pos, round(p1*p1 + 4*p2, 6) discriminant, round(m, 6) modulus, p1 + p2 < 1 and p2 - p1 < 1 and p2 > -1 stable, p1*p1 + 4*p2 < 0 complex_pair,
 case when p1*p1 + 4*p2 < 0 then round(2*pi()/atan2(sqrt(greatest(-(p1*p1 + 4*p2), 0)), p1), 6) end period,
 case when m = 0 then 0.0 when m < 1 then round(ln(0.5)/ln(m), 6) end half_life,
 p1 + p2 < 1 and p2 - p1 < 1 and p2 > -1 and p2 < 0 and abs(p1)*(1 - p2) < -4*p2 spectral_peak,
 case when p1 + p2 < 1 and p2 - p1 < 1 and p2 > -1 and p2 < 0 and abs(p1)*(1 - p2) < -4*p2 then round(acos(least(greatest(p1*(p2 - 1)/(4*p2), -1), 1))/(2*pi()), 6) end frequency from mm"""


@query(f"{ROLL} {_SUMMARY}")
def root_summary(spark, d):
    s = fits.rolling_ar2(b.weekly_growth(spark, d)).select("sid", "pos", roots.root_summary("phi1", "phi2").alias("r"))
    s = s.select("sid", "pos", "r.*")
    return s.select("sid", "pos", *r6("discriminant", "modulus"), "stable", "complex_pair", *r6("period", "half_life"), "spectral_peak", *r6("frequency"))


@query(f"{ROLL} select sid, pos, round(case when p1 + p2 > 0 then p1 + p2 end, 6) c, round(case when p1 + p2 > 0 then -p2/(p1 + p2) end, 6) v, case when p1 + p2 > 0 then (p1 + p2)*(1 - p2/(p1 + p2))*(1 - p2/(p1 + p2)) < -4*p2/(p1 + p2) end oscillates from mm")
def samuelson(spark, d):
    s = fits.rolling_ar2(b.weekly_growth(spark, d)).select("sid", "pos", roots.samuelson("phi1", "phi2").alias("s")).select("sid", "pos", "s.*")
    return s.select("sid", "pos", *r6("c", "v"), "oscillates")


@query(f"{FULL} select sid, round(sqrt((1 - p2*p2)/n), 6) se from ff")
def asymptotic_se(spark, d):
    return fits.ols_ar2(b.weekly_growth(spark, d)).select("sid", F.round(roots.asymptotic_se("phi2", "n"), 6).alias("se"))


@query(f"""with {G}, m as (select sid, pos, x, x - avg(x) over (partition by sid) c from g),
l as (select *, lag(c) over (partition by sid order by pos) c1, lag(c, 2) over (partition by sid order by pos) c2 from m),
s as (select sid, sum(c*c) g0, sum(c*c1) g1, sum(c*c2) g2, avg(x) mu from l group by sid), r as (select *, g1/g0 r1, g2/g0 r2 from s),
p as (select *, r1*(1 - r2)/(1 - r1*r1) p1, (r2 - r1*r1)/(1 - r1*r1) p2 from r)
select sid, round(p1, 6) phi1, round(p2, 6) phi2, round(mu*(1 - p1 - p2), 6) intercept from p""")
def yule_walker(spark, d):
    return fits.yule_walker(b.weekly_growth(spark, d)).select("sid", *r6("phi1", "phi2", "intercept"))


@query(f"""with {G}, m as (select sid, pos, round_even(x - avg(x) over (partition by sid), 1) c from g),
l as (select *, lag(c) over (partition by sid order by pos) c1, lag(c, 2) over (partition by sid order by pos) c2 from m),
r as (select sid, corr(c, c1) r1, corr(c, c2) r2 from l group by sid)
select sid, round(r1, 6) r1, round(r2, 6) r2, round(r1*(1 - r2)/(1 - r1*r1), 6) b1, round((r2 - r1*r1)/(1 - r1*r1), 6) b2 from r""")
def yule_serial(spark, d):
    return fits.yule_serial(b.weekly_growth(spark, d)).select("sid", *r6("r1", "r2", "b1", "b2"))


@query(f"with {G}, {L} select sid, pos, round(x - 1.343*l1 + 0.655*l2 - 13.854, 6) disturbance from lg")
def yule_disturbances(spark, d):
    return fits.disturbances(b.weekly_growth(spark, d)).select("sid", "pos", *r6("disturbance"))


@query(f"{FULL}, r as (select lg.sid, pos, x - c - p1*l1 - p2*l2 e from lg join ff on ff.sid = lg.sid) select sid, pos, round(e - avg(e) over (partition by sid), 6) centred from r")
def centered_residuals(spark, d):
    g = b.weekly_growth(spark, d)
    return fits.residuals(g, fits.ols_ar2(g)).select("sid", "pos", *r6("centred"))


@query(f"with {G} select g.sid, pos, round(x - a - k*pos, 6) as cycle from g join (select sid, regr_slope(x, pos) k, regr_intercept(x, pos) a from g group by sid) f on f.sid = g.sid")
def linear_cycle(spark, d):
    return fits.linear_cycle(b.weekly_growth(spark, d)).select("sid", "pos", *r6("cycle"))


@query(f"""with {G}, w as (select sid, pos, list(x) over (partition by sid order by pos rows between 39 preceding and current row) v from g),
d as (select sid, pos, list_transform(v, lambda q: q - list_sum(v)/40) v from w where len(v) = 40)
select sid, pos, round(list_sum(list_transform(range(1, 40), lambda i: v[i]*v[i + 1]))/list_sum(list_transform(v, lambda q: q*q)), 6) lag1 from d""")
def rolling_lag1(spark, d):
    return fits.rolling_lag1(b.weekly_growth(spark, d)).select("sid", "pos", *r6("lag1"))


@query(f"with {G}, {b.sql_episodes()} select sid, onset, fin from rn")
def runs(spark, d):
    return ep.runs(b.weekly_growth(spark, d))


@query(f"{EPS} select sid, episode, onset, fin, runs from eps")
def episodes(spark, d):
    return ep.episodes(ep.runs(b.weekly_growth(spark, d)))


@query(f"{EPS} select sid, episode, onset from eps where onset >= 48")
def eligible_structural(spark, d):
    return ep.eligible(ep.episodes(ep.runs(b.weekly_growth(spark, d)))).select("sid", "episode", "onset")


@query(f"{EPS} select sid, onset, onset + 1701 as year from eps where not (onset + 1701 between 1914 and 1918) and not (onset + 1701 between 1939 and 1945) and onset + 1701 <> 2020")
def exogenous_filter(spark, d):
    out = ep.excluding_years(ep.episodes(ep.runs(b.weekly_growth(spark, d))), 1701, [(1914, 1918), (1939, 1945), (2020, 2020)])
    return out.select("sid", "onset", "year")


def _changes(spark, d):
    g = b.weekly_growth(spark, d)
    return ep.onset_change(ep.episodes(ep.runs(g)), fits.rolling_ar2(g))


@query(f"{ALL} select sid, episode, onset, fin, runs, round(change, 6) as change from ch")
def onset_change(spark, d):
    return _changes(spark, d).select("sid", "episode", "onset", "fin", "runs", *r6("change"))


@query(f"{ALL} select e.sid, e.onset, m.pos, round(m.m, 6) as value from eps e join mm m on m.sid = e.sid and m.pos between e.onset - 16 and e.onset - 1")
def onset_segment(spark, d):
    g = b.weekly_growth(spark, d)
    return ep.onset_segment(ep.episodes(ep.runs(g)), fits.rolling_ar2(g)).select("sid", "onset", "pos", *r6("value"))


@query(f"""{ALL}, sg as (select e.sid, e.onset, m.pos, m.m v from eps e join mm m on m.sid = e.sid and m.pos between e.onset - 16 and e.onset - 1),
pr as (select a.sid, a.onset, sum(sign(b.v - a.v)) s, sum(case when b.v = a.v then 1 else 0 end) t, count(*) n from sg a join sg b on a.sid = b.sid and a.onset = b.onset and a.pos < b.pos group by 1, 2)
select sid, onset, round(case when t < 120 then s/sqrt(120.0*(120 - t)) end, 6) tau from pr where n = 120""")
def kendall_taub(spark, d):
    g = b.weekly_growth(spark, d)
    return ep.kendall_taub(ep.onset_segment(ep.episodes(ep.runs(g)), fits.rolling_ar2(g))).select("sid", "onset", *r6("tau"))


@query(f"{ALL} select sid, round(avg(change), 6) \"S\" from ch group by sid", name="mean_S")
def mean_s(spark, d):
    return ep.pre_onset_summary(_changes(spark, d)).select("sid", *r6("S"))


@query(f"{ALL} select sid, count_if(change > 0) k_pos from ch group by sid")
def k_pos(spark, d):
    return ep.pre_onset_summary(_changes(spark, d)).select("sid", "k_pos")


@query(f"{ALL} select sid, string_agg(cast(onset as varchar), ',' order by onset) onsets from ch where change is not null group by sid")
def eligible_onsets(spark, d):
    s = ep.pre_onset_summary(_changes(spark, d)).where(F.size("onsets") > 0)
    return s.select("sid", F.concat_ws(",", F.transform("onsets", lambda x: x.cast("string"))).alias("onsets"))


@query(f"{EPS} select distinct a.sid, a.onset, exists (select 1 from eps o where o.sid = 'BUILDING' and o.onset = a.onset) also from eps a")
def also_h1_onset(spark, d):
    e = ep.episodes(ep.runs(b.weekly_growth(spark, d))).select("sid", "onset")
    other = e.where("sid = 'BUILDING'").select("onset", F.lit(True).alias("also")).distinct()
    return e.join(other, "onset", "left").select("sid", "onset", F.coalesce("also", F.lit(False)).alias("also"))


@query(f"{ALL} select a.sid, a.onset, round(o.change, 6) frozen from ch a left join ch o on o.sid = 'BUILDING' and o.onset = a.onset")
def h1_frozen_delta(spark, d):
    c = _changes(spark, d)
    frozen = c.where("sid = 'BUILDING'").select("onset", F.round("change", 6).alias("frozen"))
    return c.select("sid", "onset").join(frozen, "onset", "left").select("sid", "onset", "frozen")


@query(f"""{EPS}, st(territory, "start", stop) as (values ('old', 0, 119), ('middle', 100, 239), ('new', 240, 400)),
h as (select e.sid, e.onset, territory from eps e left join st on "start" <= e.fin and stop >= e.onset)
select sid, onset, coalesce(string_agg(territory, ',' order by territory), '') territories, count(territory) > 1 crosses_boundary from h group by 1, 2""")
def territory_flags(spark, d):
    stretches = F.broadcast(spark.createDataFrame([("old", 0, 119), ("middle", 100, 239), ("new", 240, 400)], "territory string, start int, stop int"))
    e = ep.episodes(ep.runs(b.weekly_growth(spark, d))).select("sid", "onset", F.col("onset").alias("first"), F.col("fin").alias("last"))
    return ep.territory_flags(e, stretches).withColumn("territories", F.concat_ws(",", "territories"))


@query(f"{EPS}, gm as (select date_trunc('month', o_orderdate) m, sum(cast(o_totalprice as decimal(18,2))) y from orders group by 1), um as (select date_trunc('month', l_shipdate) m, count(*) u from lineitem group by 1) select cast(gm.m as varchar) m, cast(y as double) y, u from gm join um on um.m = gm.m")
def gdp_unemp(spark, d):
    gm = b.read(spark, d, "orders").groupBy(F.date_trunc("month", "o_orderdate").alias("m")).agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("y"))
    um = b.read(spark, d, "lineitem").groupBy(F.date_trunc("month", "l_shipdate").alias("m")).agg(F.count("*").alias("u"))
    return gm.join(um, "m").select(F.date_format("m", "yyyy-MM-dd HH:mm:ss").alias("m"), "y", "u")


@query(f"with {b.sql_levels('month')}, {L}, {b.sql_fit(24)}, {b.sql_episodes(1, 2)}, c2 as (select e.*, a.m - z.m change from eps e left join mm a on a.sid = e.sid and a.pos = e.onset - 1 left join mm z on z.sid = e.sid and z.pos = e.onset - 3) select sid, episode, onset, fin, runs, round(change, 6) as change from c2", name="episode_persistence")
def episode_persistence(spark, d):
    """Flagship, end to end: events to monthly levels, growth, rolling fits, episodes, change of persistence before each."""
    g = b.weekly_growth(spark, d, "month")
    out = ep.onset_change(ep.episodes(ep.runs(g, 1), 2), fits.rolling_ar2(g, 24), lookback=2)
    return out.select("sid", "episode", "onset", "fin", "runs", *r6("change"))


@query(f"with {G} select sid, count(*) n, count_if(x < 0) negative, min(pos) \"first\", max(pos) \"last\" from g group by sid")
def check_yearly(spark, d):
    g = b.weekly_growth(spark, d)
    series.stop_if_any(series.check_contiguous(g), "positions are not contiguous")
    return g.groupBy("sid").agg(F.count("*").alias("n"), F.count_if(F.col("x") < 0).alias("negative"), F.min("pos").alias("first"), F.max("pos").alias("last"))


@query("""with w as (select vec_id sid, embedding e, unnest(range(len(embedding) - 2)) k from embeddings),
p as (select sid, k, e[k + 1]::double c0, e[k + 2]::double c1, e[k + 3]::double c2 from w),
s as (select *, abs(c0) < abs(c2) s1, c2*c1 - c0*c1 d0, c2*c2 - c0*c0 d1 from p)
select sid, k, round(d0, 6) t0, round(d1, 6) t1, case when abs(c2) > 0 then s1 and abs(d0) < abs(d1) end stable from s""")
def schur_cohn_stable(spark, d):
    """Every three neighbouring entries of a vector as a quadratic."""
    e = b.read(spark, d, "embeddings").select(F.col("vec_id").alias("sid"), "embedding", F.explode(F.sequence(F.lit(0).cast("long"), F.size("embedding") - 3)).alias("k"))
    a = e.select("sid", "k", roots.complex_array(F.slice("embedding", F.col("k").cast("int") + 1, 3)).alias("a"))
    t = roots.schur_transform(F.col("a"))
    return a.select("sid", "k", F.round(t[0]["re"], 6).alias("t0"), F.round(t[1]["re"], 6).alias("t1"), F.when(F.element_at("a", -1)["re"] != 0, roots.schur_cohn_stable(F.col("a"))).alias("stable"))


_SQUARED = "list_transform(range(len(p)), lambda k: list_sum(list_transform(range(greatest(0, 2*k - len(p) + 1), least(len(p) - 1, 2*k) + 1), lambda i: (case when i % 2 = 0 then 1 else -1 end)*p[i + 1]*p[2*k - i + 1])))"
_SCALE = "list_max(list_transform(range(1, len({p})), lambda j: power(abs({p}[j + 1]), 1.0/j)))"
_SCALED = "list_transform(range(len(q)), lambda j: q[j + 1]/power(z, j))"


@query(f"""with recursive v as (select vec_id, cast(1 + vec_id % least(64, len(embedding)) as int) degree, embedding from embeddings),
s0 as (select vec_id, degree, list_prepend(1.0::double, list_reverse(list_transform(embedding[1:degree], lambda x: cast(x as double)))) q from v), s1 as (select *, {_SCALE.format(p="q")} z from s0),
r(vec_id, degree, k, p, lg) as (select vec_id, degree, 0, {_SCALED}, ln(z) from s1 union all select vec_id, degree, k + 1, {_SCALED}, lg + ln(z)/power(2, k + 1) from (select *, {_SCALE.format(p="q")} z from (select vec_id, degree, k, lg, {_SQUARED} q from r where k < 30)))
select vec_id, degree, lg < 0 stable, round(exp(lg), 3) modulus from r where k = 30""")
def schur_cohn_degrees(spark, d):
    """Polynomials of degree 1 to 64 with leading term 1: Schur-Cohn, and the modulus of the largest root."""
    from tidemark.operators import simulate

    e = b.read(spark, d, "embeddings").withColumn("degree", (1 + F.col("vec_id") % F.least(F.lit(64), F.size("embedding"))).cast("int"))
    e = e.withColumn("c", F.concat(F.transform(F.slice("embedding", F.lit(1), F.col("degree")), lambda x: x.cast("double")), F.array(F.lit(1.0))))
    return simulate.polynomial_roots(e.select("vec_id", "degree", "c"), "c").select("vec_id", "degree", "stable", F.round("modulus", 3).alias("modulus"))


@query("select vec_id sid, unnest(range(len(embedding))) k, unnest(list_reverse(embedding)) r from embeddings")
def conjugate_reciprocal(spark, d):
    a = b.read(spark, d, "embeddings").select(F.col("vec_id").alias("sid"), F.posexplode(roots.conjugate_reciprocal(roots.complex_array(F.col("embedding")))).alias("k", "z"))
    return a.select("sid", F.col("k").cast("long").alias("k"), F.col("z.re").cast("float").alias("r"))


@query("""with recursive v as (select vec_id, embedding e from embeddings), r(vec_id, k, a, b) as (
 select vec_id, 2, cast(e[2] as double), cast(e[1] as double) from v union all
 select r.vec_id, k + 1, 0.5 + 0.3*r.a + 0.1*r.b + v.e[k + 1], r.a from r join v on v.vec_id = r.vec_id where k < 64)
select vec_id, round(a, 6) as last from r where k = 64""")
def recursion_ar2(spark, d):
    e = b.read(spark, d, "embeddings")
    e = e.select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("e"))
    out = fits.ar2_recursion(e, F.col("e"), F.slice("e", 3, 62), F.lit(0.3), F.lit(0.1), F.lit(0.5))
    return out.select("vec_id", F.round(F.element_at("path", -1), 6).alias("last"))


schur_transform = query("""with p as (select vec_id sid, len(embedding) n, list_transform(embedding, lambda x: x::double) c, unnest(range(len(embedding) - 1)) k from embeddings)
select sid, k, round(c[n]*c[k + 2] - c[1]*c[n - 1 - k], 6) t from p""", name="schur_transform")(
    lambda spark, d: b.read(spark, d, "embeddings").select(F.col("vec_id").alias("sid"), F.posexplode(roots.schur_transform(roots.complex_array(F.col("embedding")))).alias("k", "z"))
    .select("sid", F.col("k").cast("long").alias("k"), F.round("z.re", 6).alias("t"))
)
