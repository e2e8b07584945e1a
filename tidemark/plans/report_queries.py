"""Assembled analyses, reviews, vintage label rules, and the streaming form against the batch."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import roots
from tidemark.kernels import ar, matrices, streams
from tidemark.operators import accounting as acc
from tidemark.operators import fits
from tidemark.operators import simulate as sim
from tidemark.plans import base as b
from tidemark.plans.catalogue import query
from tidemark.sources import shared

G, L, FULL = b.sql_levels(), b.SQL_LAGS, b.sql_full_fit()
r6 = lambda *names: [F.round(n, 6).alias(n) for n in names]


@query(f"""with {G}, {L}, {FULL}, e as (select lg.sid, avg(x - c - p1*l1 - p2*l2) removed, sum(power(x - c - p1*l1 - p2*l2, 2)) ss from lg join ff on ff.sid = lg.sid group by lg.sid)
select ff.sid, p1 + p2 < 1 and p2 - p1 < 1 and p2 > -1 and m < 1 usable, round(m, 6) modulus, round(a.x, 6) x0, round(z.x, 6) x1, round(removed, 6) + 0.0 removed, round(ss, 3) ss
from ff join e on e.sid = ff.sid join g a on a.sid = ff.sid and a.pos = 0 join g z on z.sid = ff.sid and z.pos = 1""")
def prepare_null(spark, d):
    """Fitted null of each series: usable only if strictly stable, the initial pair, and the residual mean removed."""
    g = b.weekly_growth(spark, d)
    f = fits.ols_ar2(g)
    e = fits.residuals(g, f).groupBy("sid").agg(F.avg("residual").alias("removed"), F.sum(F.col("residual") ** 2).alias("ss"))
    start = g.where("pos < 2").groupBy("sid").agg(F.min_by("x", "pos").alias("x0"), F.max_by("x", "pos").alias("x1"))
    usable = roots.in_triangle("phi1", "phi2") & (F.col("modulus") < 1)
    return f.join(e, "sid").join(start, "sid").select("sid", usable.alias("usable"), *r6("modulus", "x0", "x1"), (F.round("removed", 6) + 0.0).alias("removed"), F.round("ss", 3).alias("ss"))


@query(f"with {G} select sid, o.onset, count(*) n_v, round(sum(x), 6) total from g join (values (100), (150), (190)) o(onset) on pos < onset group by 1, 2")
def truncation_vintages(spark, d):
    """Prefixes of each series at each onset: what was known then."""
    o = F.broadcast(spark.createDataFrame([(100,), (150,), (190,)], "onset int"))
    return b.weekly_growth(spark, d).join(o, F.col("pos") < F.col("onset")).groupBy("sid", "onset").agg(F.count("*").alias("n_v"), F.round(F.sum("x"), 6).alias("total"))


@query(f"with {G}, {L}, {FULL} select sid, round(p1, 6) c11, round(p2, 6) c12, 1.0::double c21, 0.0::double c22 from ff")
def companion(spark, d):
    m = fits.ols_ar2(b.weekly_growth(spark, d)).select("sid", roots.companion("phi1", "phi2").alias("m"))
    return m.select("sid", *(F.round(F.col("m")[i][j], 6).alias(f"c{i + 1}{j + 1}") for i in (0, 1) for j in (0, 1)))


@query(f"""with {G}, {L}, {FULL} select sid, 'LS' as method, round(p1, 6) phi1, round(p2, 6) phi2, round(m, 6) modulus, case when p1*p1 + 4*p2 < 0 then round(2*pi()/atan2(sqrt(greatest(-(p1*p1 + 4*p2), 0)), p1), 6) end period,
 case when m = 0 then 0.0 when m < 1 then round(ln(0.5)/ln(m), 6) end half_life from ff""")
def s1_fits(spark, d):
    """Root diagnostics of whole-series fits; bands come from residual_bootstrap."""
    f = fits.ols_ar2(b.weekly_growth(spark, d)).select("sid", F.lit("LS").alias("method"), "phi1", "phi2", roots.root_summary("phi1", "phi2").alias("r"))
    return f.select("sid", "method", *r6("phi1", "phi2"), *(F.round(f"r.{c}", 6).alias(c) for c in ("modulus", "period", "half_life")))


@query()
def s2_rows(spark, d):
    """Three detrending filters of each level series and the multiplier-accelerator pair that each cycle implies."""
    y = b.weekly_levels(spark, d).select("sid", "pos", F.log("y").alias("x"))
    parts = [("linear", fits.linear_cycle(y)), ("hp", sim.cycles(y, "hp")), ("hamilton", sim.cycles(y, "hamilton"))]
    out = None
    for name, c in parts:
        s = c.where("cycle is not null").select("sid", (F.row_number().over(Window.partitionBy("sid").orderBy("pos")) - 1).cast("long").alias("pos"), F.col("cycle").alias("x"))
        f = fits.ols_ar2(s).select("sid", F.lit(name).alias("filter"), "phi1", "phi2", roots.samuelson("phi1", "phi2").alias("s")).select("sid", "filter", "phi1", "phi2", "s.*")
        out = f if out is None else out.unionByName(f)
    return out


@query()
def comparison_rows(spark, d):
    """Seven fixed rows for each series, unavailable ones kept."""
    done = sim.comparisons(sim.analyze_h1(b.weekly_growth(spark, d)))
    names = F.array(*(F.struct(F.lit(k).alias("place"), F.lit(n).alias("analysis")) for k, n in enumerate(("primary", "window32", "window48", "fixed", "wild", "trend", "lag1"))))
    rows = b.read(spark, d, "customer").select(F.col("c_mktsegment").alias("sid")).distinct().select("sid", F.inline(names))
    return rows.join(done, ["sid", "analysis"], "left").withColumn("comparison", F.coalesce("comparison", F.lit("unavailable")))


@query("select c_mktsegment sid, true as reconciled from customer group by 1")
def validated_accounting(spark, d):
    """The attempt ledger against its summary: counts by status, numbers 0..B-1 once each, p from the ledger."""
    ledger = sim.csd_test(b.weekly_growth(spark, d))
    s = sim.comparisons(ledger)
    seen = F.first_value(F.when(F.col("number") == -1, F.col("statistic")), True).over(Window.partitionBy("sid"))
    n = ledger.withColumn("S", seen).where("number >= 0").groupBy("sid").agg(
        F.count("*").alias("n"), F.countDistinct("number").alias("d"), F.min("number").alias("lo"), F.max("number").alias("hi"), F.count_if(F.col("status") == "retained").alias("kept"), F.count_if((F.col("status") == "retained") & (F.col("statistic") >= F.col("S"))).alias("over"),
    )
    ok = (F.col("n") == 1000) & (F.col("d") == 1000) & (F.col("lo") == 0) & (F.col("hi") == 999) & (F.col("kept") == F.col("retained")) & (F.col("retained") + F.col("no_episode") + F.col("failed") == 1000) & (F.abs((1 + F.col("over")) / (1 + F.col("kept")) - F.col("p")) < 1e-12)
    return s.join(n, "sid").select("sid", ok.alias("reconciled"))


@query(f"with {G}, {L}, {b.sql_fit()} select count(*) n, true as agree from mm")
def independent_review(spark, d):
    """Every rolling modulus by two routes, windowed moments and the numpy kernel, joined and compared."""
    g = b.weekly_growth(spark, d)

    def f(row):
        x = np.asarray(row["x"], float)
        if len(x) >= 40:
            for k, v in enumerate(ar.modulus(*ar.fit(np.lib.stride_tricks.sliding_window_view(x, 40))[:2])):
                yield {"sid": str(row["sid"]), "pos": k + 39, "kernel": float(v)}

    k = sim.each(sim.packed(g, "x"), f, "sid string, pos long, kernel double")
    both = fits.rolling_ar2(g).join(k, ["sid", "pos"], "full")
    gap = F.abs(F.col("modulus") - F.col("kernel"))
    return both.agg(F.count("*").alias("n"), F.coalesce(F.max(gap) <= 1e-9, F.lit(False)).alias("agree"))


REVIEWED = 100


@query(f"""with {G}, {L}, {b.sql_fit()}, {b.sql_episodes()}, {b.SQL_CHANGES} select sid, round(avg(change), 6) s, count(*) n_onsets, {REVIEWED + 1} n_attempts, 0 n_odd from ch where onset >= 48 group by sid""")
def attempts_review(spark, d):
    """Every attempt of the surrogate test by a second route: its path as rows, episodes and windowed fits over sets, against the
    kernel's ledger.  The observed row is shown; n_odd counts attempts on which the routes differ in anything."""
    from tidemark.operators import review

    g = b.weekly_growth(spark, d)
    ledger = sim.csd_test(g, REVIEWED).where("number >= -1").select("sid", "number", "status", F.size("onsets").cast("long").alias("n_onsets"), "statistic")
    ledger = ledger.withColumn("statistic", F.when(F.col("status") == "retained", F.col("statistic")))
    sets = shared.written(review.attempts_by_sets(sim.surrogate_paths(g, REVIEWED)), "attempts")
    met = review.compare(ledger, sets, ["sid", "number"], ["status", "n_onsets"], ["statistic"])
    odd = met.groupBy("sid").agg(F.count("*").alias("n_attempts"), F.count_if(F.col("verdict") != "same").alias("n_odd"))
    return sets.where("number = -1").join(odd, "sid").select("sid", F.round("statistic", 6).alias("s"), "n_onsets", "n_attempts", "n_odd")


@query(f"with {G}, {L}, {b.sql_fit()} select sid, pos, round(m, 6) modulus, 'same' as verdict from mm")
def rolling_review(spark, d):
    """Every rolling fit from running totals by Cramer's rule, and what its comparison with the windowed moments says."""
    from tidemark.operators import review

    g = b.weekly_growth(spark, d)
    second = review.rolling_by_totals(g)
    met = review.compare(fits.rolling_ar2(g), second, ["sid", "pos"], close=["phi1", "phi2", "modulus"])
    return second.join(met, ["sid", "pos"], "full").select("sid", "pos", *r6("modulus"), "verdict")


@query()
def fit_ml(spark, d):
    """Likelihood of the time-varying AR(2): the best grid point and the refined one, which is never worse."""

    def f(row):
        r = matrices.fit_tv_ar2(np.asarray(row["x"], float))
        yield {"sid": str(row["sid"]), **{k: float(r[k]) for k in ("r1", "r2", "loglik", "grid_loglik", "sigma2")}}

    return sim.each(sim.packed(b.weekly_growth(spark, d, "month"), "x"), f, "sid string, r1 double, r2 double, loglik double, grid_loglik double, sigma2 double")


@query()
def concentrated_loglik(spark, d):
    """The likelihood grid itself: a row for each series and pair of variance ratios."""

    def f(row):
        r1, r2 = (g.ravel()[None] for g in np.meshgrid(matrices.GRID, matrices.GRID, indexing="ij"))
        ll, _, s2 = matrices.tv_filters(np.asarray(row["x"], float)[None], r1, r2, states=True)  # all points of the grid at once
        for k in range(r1.size):
            yield {"sid": str(row["sid"]), "r1": float(r1[0, k]), "r2": float(r2[0, k]), "loglik": float(ll[0, k]) if np.isfinite(ll[0, k]) else None, "sigma2": float(s2[0, k])}

    return sim.each(sim.packed(b.weekly_growth(spark, d, "month"), "x"), f, "sid string, r1 double, r2 double, loglik double, sigma2 double")


@query()
def power_replicate(spark, d):
    """Simulated power by kappa, 200 replicates of each at B = 1,000: cells, differences and the kappa of 80 % power."""
    cells = acc.cell_summary(sim.replicates(spark, [1.0, 1.2, 1.4, 1.6], 200, stream=streams.DEVELOPMENT + 60), ["cell", "kappa"], F.lit(200))
    return acc.power_summary(cells.withColumn("sid", F.lit("ar2")))


@query()
def sample_by_seed(spark, d):
    """A seeded sample of record keys (the operator samples): ranks drawn by numpy from the table's own number of keys,
    joined through the sorted keys.  Ranks count inside ranges of keys, so that no task sorts the whole table."""
    orders = b.read(spark, d, "orders")
    keys = orders.select("o_orderkey").where("o_orderkey is not null").distinct()
    low, high = keys.agg(F.min("o_orderkey"), F.max("o_orderkey")).first()
    width = 1 if low is None else (high - low) // 1024 + 1
    keys = keys.withColumn("part", F.floor((F.col("o_orderkey") - (low or 0)) / width))
    parts = keys.groupBy("part").count().orderBy("part").collect()  # 1,024 rows at most
    ends = np.cumsum([r["count"] for r in parts], dtype=np.int64)
    n = int(ends[-1]) if parts else 0
    pick = np.sort(streams.stream(streams.DEVELOPMENT + 70).choice(n, size=min(25, n), replace=False)) if n else []
    at = [(int(k), int(np.searchsorted(ends, k, "right"))) for k in pick]
    drawn = F.broadcast(spark.createDataFrame([(parts[p]["part"], k - (int(ends[p - 1]) if p else 0) + 1) for k, p in at], "part long, rank int"))
    ranked = keys.join(drawn.select("part").distinct(), "part", "left_semi").withColumn("rank", F.row_number().over(Window.partitionBy("part").orderBy("o_orderkey")))
    return orders.join(ranked.join(drawn, ["part", "rank"], "left_semi"), "o_orderkey", "left_semi").select("o_orderkey", "o_totalprice")


# ------------------------------------------------ labels, editions and text rules
@query("""with e as (select event_type, user_id % 5 as listing, date_trunc('day', ts) released, count(*) n from events group by 1, 2, 3),
r as (select *, rank() over (partition by event_type, listing order by released desc) k, count(*) over (partition by event_type, listing, released) ties from e where released <= timestamp '2024-01-20')
select event_type, listing, cast(released as varchar) released, n from r where k = 1 and ties = 1""")
def latest_edition(spark, d):
    """The latest edition that was out at a date; a tie would leave none."""
    e = b.read(spark, d, "events").groupBy("event_type", (F.col("user_id") % 5).alias("listing"), F.date_trunc("day", "ts").alias("released")).agg(F.count("*").alias("n"))
    e = e.where("released <= timestamp '2024-01-20'")
    w = Window.partitionBy("event_type", "listing")
    r = e.withColumns({"k": F.rank().over(w.orderBy(F.col("released").desc())), "ties": F.count("*").over(Window.partitionBy("event_type", "listing", "released"))})
    return r.where("k = 1 and ties = 1").select("event_type", "listing", F.date_format("released", "yyyy-MM-dd HH:mm:ss").alias("released"), "n")


@query("select doc_id, regexp_matches(text, '[0-9]{4,}') numbers, regexp_matches(text, '!!') shouting, contains(text, ' | ') as piped from documents")
def check_title_and_notes(spark, d):
    """Text-only conflict scan: which rules a text breaks."""
    t = F.col("text")
    return b.read(spark, d, "documents").select("doc_id", t.rlike("[0-9]{4,}").alias("numbers"), t.rlike("!!").alias("shouting"), F.contains(t, F.lit(" | ")).alias("piped"))


@query("select 'orders' as plan, sha256('{\"plan\":\"orders\",\"version\":1}') sha256")
def read_manifest(spark, d):
    """A store's manifest, read without creating anything, with its checksum recomputed."""
    from tidemark.sources.store import ReplicateStore

    store = ReplicateStore(spark, shared.new_path(spark, "store"), {"version": 1, "plan": "orders"})
    m = store._read("manifest")
    return m.where(F.sha2("content", 256) == F.col("sha256")).select(F.get_json_object("content", "$.plan").alias("plan"), "sha256")


@query(f"with {G}, {L}, {b.sql_fit()} select sid, pos, round(m, 6) modulus from mm")
def stream_rolling(spark, d):
    """The streaming form over the same series, fed from files until none is left; its rows are the batch's."""
    from tidemark.streaming import online

    src, sink, state = (shared.new_path(spark, n) for n in ("stream-in", "stream-out", "stream-state"))
    b.weekly_growth(spark, d).write.parquet(src)
    rows = online.rolling_stream(spark.readStream.schema("sid string, pos long, x double").parquet(src))
    rows.writeStream.format("parquet").option("path", sink).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(sink).where("status = 'ok'").select("sid", "pos", *r6("modulus"))
