"""Surrogate tests, bootstraps, state space, filters and simulation over the weekly panel.  Results that SQL can't give
have no oracle; their kernels are tested against golden values and brute force."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from tidemark.kernels import matrices, streams
from tidemark.operators import accounting as acc
from tidemark.operators import regress
from tidemark.operators import simulate as sim
from tidemark.plans import base as b
from tidemark.plans.catalogue import query


@query()
def csd_test(spark, d):
    return sim.comparisons(sim.csd_test(b.weekly_growth(spark, d)))


@query()
def primary_with_comparators(spark, d):
    return sim.comparisons(sim.joint_test(b.weekly_growth(spark, d)))


@query()
def fixed_date_test(spark, d):
    return sim.comparisons(sim.csd_test(b.weekly_growth(spark, d), onsets=(60, 120, 180, 240, 300)))


@query()
def draw_surrogate(spark, d):
    """The attempt ledger itself: a row for each attempt, failures included."""
    return sim.csd_test(b.weekly_growth(spark, d)).select("sid", "number", "status", "statistic")


@query()
def analyze_h1(spark, d):
    """Seven analyses of every series: joint primary, trend and lag1; windows 32 and 48; fixed dates; wild signs."""
    return sim.comparisons(sim.analyze_h1(b.weekly_growth(spark, d)))


@query()
def episode_table(spark, d):
    """The observed episodes of the seven quarterly analyses: onset and change (or trend) before it."""
    return sim.episode_table(sim.analyze_h1(b.weekly_growth(spark, d), 0))


@query()
def e1_analyze(spark, d):
    """The annual rules (window 30, lookback 2, runs of 1, merge 2, span 4) over monthly growth: joint primary, trend and
    lag1; windows 25 and 35; fixed dates; wild signs; and the interval."""
    return sim.whole(sim.analyze_e1, b.weekly_growth(spark, d, "month"))


@query()
def e3_analyze(spark, d):
    """Filtered root modulus of a time-varying AR(2) before onsets of monthly growth, variance ratios by likelihood in
    the series and in every surrogate: joint primary, held-fixed and trend; fixed dates; wild signs; and the interval."""
    return sim.whole(sim.analyze_e3, b.weekly_growth(spark, d, "month"))


@query()
def filtered_modulus(spark, d):
    return sim.filtered_modulus(b.weekly_growth(spark, d), ratios=(1e-4, 1e-4))


@query()
def episode_interval(spark, d):
    return sim.intervals(sim.csd_test(b.weekly_growth(spark, d), 1))


@query()
def residual_bootstrap(spark, d):
    """95 % bands of modulus and period over bootstrap refits, and the number of real-root draws."""
    draws = sim.bootstrap(b.weekly_growth(spark, d))
    q = lambda c: F.percentile(c, [0.025, 0.975])
    return draws.groupBy("sid").agg(F.count("modulus").alias("valid"), F.count_if(F.col("period").isNull()).alias("real"), q("modulus").alias("modulus_band"), q("period").alias("period_band"))


def _pair(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("sid").orderBy("bucket")
    levels = b.weekly_levels(spark, d)
    li = b.read(spark, d, "lineitem").join(b.read(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(b.read(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    u = li.groupBy(F.col("c_mktsegment").alias("sid"), F.date_trunc("week", "o_orderdate").alias("bucket")).agg((F.avg("l_discount") * 100).alias("u"))
    j = levels.join(u, ["sid", "bucket"]).withColumns({"g": 400 * (F.log("y") - F.log(F.lag("y").over(w))), "du": F.col("u") - F.lag("u").over(w)})
    return j.where("g is not null").select("sid", (F.col("pos") - 1).alias("pos"), "g", "du")


_Z, _Y = ["g1", "d1", "g2", "d2"], ["g", "du"]
_WINDOWS = b.sql_regression("vr", _Z, _Y, "sid, pos", "over (partition by sid order by pos rows between 37 preceding and current row)", 38)
_WHOLE = b.sql_regression("vr", _Z, _Y, "sid")


@query(f"""with recursive {b.SQL_PAIR}, {_WINDOWS}, kk as (select *, sid || ' ' || pos id from rg), {b.sql_radius("kk", b.SQL_VAR_MATRIX, "id")}
select sid, pos, round(radius, 6) modulus, round(c_g, 6) c_g, round(c_du, 6) c_du, case when b_g1_g is null then 'failed' else 'ok' end status from kk left join rad on rad.id = kk.id""")
def rolling_var2(spark, d):
    """VAR(2) of every window of 40: windowed moments, an elimination over arrays and root squaring, all in the plan."""
    f = regress.rolling_var2(_pair(spark, d))
    return f.select("sid", "pos", F.round("modulus", 6).alias("modulus"), *(F.round(F.get("intercept", j), 6).alias(k) for j, k in enumerate(("c_g", "c_du"))), "status")


@query(f"""with recursive {b.SQL_PAIR}, {_WHOLE}, {b.sql_radius("rg", b.SQL_VAR_MATRIX, "sid")}
select rg.sid, n, round(radius, 6) modulus, round(c_g, 6) c_g, round(c_du, 6) c_du, round(b_g1_g, 6) a1_11, round(b_d1_g, 6) a1_12, round(b_g1_du, 6) a1_21, round(b_d1_du, 6) a1_22,
 round(b_g2_g, 6) a2_11, round(b_d2_g, 6) a2_12, round(b_g2_du, 6) a2_21, round(b_d2_du, 6) a2_22, case when b_g1_g is null then 'failed' else 'ok' end status from rg left join rad on rad.sid = rg.sid""")
def ols_var2(spark, d):
    """VAR(2) of every whole pair of series."""
    f = regress.ols_var2(_pair(spark, d))
    cells = [F.round(F.get(F.get(m, i), j), 6).alias(f"{m.lower()}_{i + 1}{j + 1}") for m in ("A1", "A2") for i in (0, 1) for j in (0, 1)]
    return f.select("sid", "n", F.round("modulus", 6).alias("modulus"), *(F.round(F.get("intercept", j), 6).alias(k) for j, k in enumerate(("c_g", "c_du"))), *cells, "status")


@query()
def e2_analyze(spark, d):
    """Change of the VAR's spectral radius before onsets of the first series, and its place among surrogates: joint
    primary, trend and lag1; windows 32 and 48; fixed dates; wild signs; and the interval."""
    return sim.whole(sim.analyze_e2, _pair(spark, d))


@query()
def e4_compare(spark, d):
    """Real-time vintages: for each of the last four episodes of the latest vintage with 56 values before its onset (the widest
    window and the lookback), the series as known then, its change and its own surrogates, with windows 32 and 48 and wild signs; an
    attempt's statistic is the mean over dates, and a failed date fails the attempt."""
    from pyspark.sql import Window

    from tidemark.operators import episodes

    g = b.weekly_growth(spark, d)
    late = Window.partitionBy("sid").orderBy(F.col("onset").desc())  # episodes of one series
    dates = episodes.episodes(episodes.runs(g)).where("onset >= 56").withColumn("k", F.row_number().over(late)).where("k <= 4").select("sid", (4 - F.col("k")).alias("j"), "onset")
    # the onset is the first position that isn't known yet, so its date lies just behind the path
    vintages = g.join(dates, "sid").where("pos < onset").select("sid", F.col("j").cast("int").alias("j"), F.col("onset").cast("int").alias("onset"), "pos", "x")
    return sim.comparisons(sim.analyze_e4(vintages))


@query()
def hp_cycle(spark, d):
    return sim.cycles(b.weekly_growth(spark, d), "hp")


_AHEAD = ["h0", "h1", "h2", "h3"]


@query(f"""with {b.sql_levels()}, hr as (select sid, pos, x, lag(x, 8) over w h0, lag(x, 9) over w h1, lag(x, 10) over w h2, lag(x, 11) over w h3 from g window w as (partition by sid order by pos)),
ht as (select * from hr where h3 is not null and sid in (select sid from g group by sid having count(*) >= 17)), {b.sql_regression("ht", _AHEAD, ["x"], "sid")}
select hr.sid, pos, round(x - c_x - b_h0_x*h0 - b_h1_x*h1 - b_h2_x*h2 - b_h3_x*h3, 6) + 0.0 as cycle from hr left join rg on rg.sid = hr.sid""")
def hamilton_cycle(spark, d):
    """Residual on values eight to eleven weeks before."""
    return regress.hamilton_cycle(b.weekly_growth(spark, d)).select("sid", "pos", (F.round("cycle", 6) + 0.0).alias("cycle"))


@query()
def kalman_filter(spark, d):
    """Local level by likelihood for every series."""

    def f(row):
        yield {"sid": str(row["sid"]), **matrices.local_level(np.asarray(row["x"], float))}

    return sim.each(sim.packed(b.weekly_growth(spark, d), "x"), f, "sid string, ratio double, noise double, level_noise double, loglik double")


_SYSTEMS = """ev as (select vec_id, cast(unnest(range(len(embedding)//8)) as int) system, list_transform(embedding, lambda x: sign(cast(x as double))*(abs(cast(x as double)) % 0.5)) e from embeddings),
es as (select vec_id, system, vec_id || ' ' || system id, """ + ", ".join(f"e[8*system + {k + 1}] m{k}" for k in range(8)) + " from ev)"
_SYSTEM_MATRIX = [["m0", "m1", "m4", "m5"], ["m2", "m3", "m6", "m7"], ["1", "0", "0", "0"], ["0", "1", "0", "0"]]


@query(f"with recursive {_SYSTEMS}, {b.sql_radius('es', _SYSTEM_MATRIX, 'id')} select vec_id, system, round(radius, 6) radius from es join rad using (id)")
def spectral_radius(spark, d):
    """Companion spectral radii of VAR(2) coefficients taken from embeddings: every eight entries are two 2x2 matrices, whose
    radius is the largest root of a quartic."""
    e = b.read(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: F.signum(x.cast("double")) * (F.abs(x.cast("double")) % 0.5)).alias("e"))
    e = e.select("vec_id", "e", F.explode(F.sequence(F.lit(0), F.floor(F.size("e") / 8).cast("int") - 1)).alias("system"))
    m = [F.get("e", 8 * F.col("system") + k) for k in range(8)]
    poly = regress.var_polynomial([m[0:2], m[2:4]], [m[4:6], m[6:8]])
    return e.select("vec_id", "system", F.round(regress.largest_modulus(poly), 6).alias("radius"))


@query()
def roots_stable(spark, d):
    def f(row):
        stable, gap = matrices.roots_stable(np.asarray(row["embedding"], float))
        yield {"vec_id": int(row["vec_id"]), "stable": stable, "gap": gap}

    return sim.each(b.read(spark, d, "embeddings").select("vec_id", "embedding"), f, "vec_id long, stable boolean, gap double", None)


@query()
def h1_design_series(spark, d):
    def f(row):
        x = streams.ar2_design(streams.stream(streams.DEVELOPMENT + 50, 0, int(row["id"])))
        yield {"replicate": int(row["id"]), "mean": float(x.mean()), "sd": float(x.std()), "x": x.tolist()}

    return sim.each(spark.range(64), f, "replicate int, mean double, sd double, x array<double>", "id")


@query()
def var_design_series(spark, d):
    def f(row):
        x = streams.var_design(streams.stream(streams.DEVELOPMENT + 51, 0, int(row["id"])))
        yield {"replicate": int(row["id"]), "correlation": float(np.corrcoef(x.T)[0, 1]), "g": x[:, 0].tolist(), "du": x[:, 1].tolist()}

    return sim.each(spark.range(64), f, "replicate int, correlation double, g array<double>, du array<double>", "id")


@query()
def white_noise(spark, d):
    """White-noise cells of 30 and 1,000 observations: share of complex root pairs in their fits, with its Wilson interval."""
    from tidemark.functions import stats
    from tidemark.kernels import ar

    def f(row):
        size = int(row["size"])
        x = streams.stream(streams.DEVELOPMENT + 52, size, int(row["id"])).standard_normal(size)
        p1, p2, _ = ar.least_squares(x)
        yield {"size": size, "replicate": int(row["id"]), "complex_pair": p1 * p1 + 4 * p2 < 0}

    cells = spark.range(2000).select("id", F.explode(F.array(F.lit(30), F.lit(1000))).alias("size"))
    fits = sim.each(cells, f, "size int, replicate int, complex_pair boolean", "id")
    out = fits.groupBy("size").agg(F.count("*").alias("n"), F.count_if("complex_pair").alias("k"))
    return out.select("size", "n", "k", stats.wilson("k", "n").alias("interval"))


@query()
def size_replicate(spark, d):
    """Nominal accounting of simulated cells: 200 replicates of each, at B = 1,000."""
    reps = sim.replicates(spark, [1.0, 1.2, 1.4, 1.6], 200)
    return acc.cell_summary(reps, ["cell", "kappa"], F.lit(200))


@query()
def size_designs(spark, d):
    """Nominal accounting of the annual and the bivariate design without planted dates: 200 replicates, at B = 1,000."""
    cells = [sim.replicates(spark, [1.0], 200, design=k, fixed=False, stream=streams.DEVELOPMENT + 90 + 2 * j).withColumn("cell", F.lit(k)) for j, k in enumerate(("e1", "e2"))]
    return acc.cell_summary(cells[0].unionByName(cells[1]), ["cell", "kappa"], F.lit(200))


@query(f"""with g as (select vec_id sid, cast(unnest(range(len(embedding))) as bigint) pos, cast(unnest(embedding) as double) x from embeddings),
{b.SQL_LAGS}, {b.sql_full_fit()} select sid, n, round(p1, 6) phi1, round(p2, 6) phi2, round(c, 6) intercept, round(m, 6) modulus, case when p1 is null then 'failed' else 'ok' end status from ff""")
def white_noise_fits(spark, d):
    """AR(2) fits of the embeddings as short series: the closed form over positions of the array."""
    from tidemark.operators import fits

    e = b.read(spark, d, "embeddings").select(F.col("vec_id").alias("sid"), F.posexplode("embedding").alias("pos", "x"))
    out = fits.ols_ar2(e.select("sid", "pos", F.col("x").cast("double").alias("x")))
    return out.select("sid", "n", *(F.round(c, 6).alias(c) for c in ("phi1", "phi2", "intercept", "modulus")), "status")
