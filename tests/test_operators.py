"""Operators on small frames: contracts, boundaries, partition invariance, streaming, registration and the store."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import labels, register, roots, stats
from tidemark.kernels import ar, streams
from tidemark.operators import accounting, episodes, fits, series, simulate
from tidemark.sources.store import ReplicateStore
from tidemark.streaming import online


def panel(spark, n=120, k=3):
    rows = [(f"s{j}", t, float(v)) for j in range(k) for t, v in enumerate(streams.ar2_design(streams.generator(40, j), n=n, onsets=()))]
    return spark.createDataFrame(rows, "sid string, pos long, x double")


def test_rolling_fit_equals_the_kernel(spark):
    p = panel(spark)
    got = {(r.sid, r.pos): r.modulus for r in fits.rolling_ar2(p).collect()}
    for j in range(3):
        x = streams.ar2_design(streams.generator(40, j), n=120, onsets=())
        m = ar.modulus(*ar.fit(np.lib.stride_tricks.sliding_window_view(x, 40))[:2])
        assert len(m) == 81 and all(abs(got[f"s{j}", 39 + i] - v) < 1e-9 for i, v in enumerate(m))


def test_constant_series_fail_and_do_not_raise(spark):
    df = spark.createDataFrame([("a", t, 1.0) for t in range(50)], "sid string, pos long, x double")
    r = fits.ols_ar2(df).first()
    assert r.status == "failed" and r.phi1 is None and r.modulus is None


def test_prefix_invariance(spark):
    p = panel(spark, k=1)
    whole = {r.pos: r.modulus for r in fits.rolling_ar2(p).collect()}
    part = {r.pos: r.modulus for r in fits.rolling_ar2(p.where("pos < 80")).collect()}
    assert part and all(abs(whole[k] - v) < 1e-12 for k, v in part.items())


def test_episodes_equal_the_kernel(spark):
    p = panel(spark)
    got = sorted((r.sid, r.onset, r.fin) for r in episodes.episodes(episodes.runs(p)).collect())
    want = sorted((f"s{j}", a, b) for j in range(3) for a, b in ar.episodes(streams.ar2_design(streams.generator(40, j), n=120, onsets=())))
    assert got == want


def test_surrogates_do_not_depend_on_partitions(spark):
    p = panel(spark)
    one, many = (sorted(map(str, simulate.csd_test(p.repartition(k), 20).collect())) for k in (1, 7))
    assert one == many


def test_contracts_stop(spark):
    p = panel(spark, k=1)
    with pytest.raises(series.ContractError):
        series.stop_if_any(series.check_contiguous(p.where("pos <> 5")), "gap")
    with pytest.raises(Exception, match="not contiguous"):
        series.slice_contiguous(p.where("pos <> 70"), 64, 80).collect()
    with pytest.raises(Exception, match="two parts"):
        accounting.disjoint_union([p, p], ["sid", "pos"]).collect()


def test_root_summary_edges(spark):
    df = spark.createDataFrame([(0.0, 0.0), (1.0, -0.5), (0.5, 0.3), (2.0, -1.0)], "a double, b double").select(roots.root_summary("a", "b").alias("r")).select("r.*")
    z, pair, real, edge = df.collect()
    assert z.modulus == 0 and z.half_life == 0 and z.period is None
    assert pair.complex_pair and abs(pair.period - 8) < 1e-9 and pair.spectral_peak
    assert not real.complex_pair and real.period is None and real.stable
    assert not edge.stable and edge.half_life is None


def test_pvalue_counts_ties_and_holm_caps(spark):
    p = spark.createDataFrame([(1.0,), (2.0,), (2.0,)], "s double").agg(stats.mc_pvalue(F.col("s"), F.lit(2.0)).alias("p")).first().p
    assert p == 3 / 4
    fam = spark.createDataFrame([("f", "a", 0.01), ("f", "b", None), ("f", "c", 0.04)], "f string, id string, p double")
    got = {r.id: r.adjusted for r in accounting.holm_adjust(fam, ["f"]).collect()}
    assert got == pytest.approx({"a": 0.03, "c": 0.08, "b": 1.0})


@pytest.mark.parametrize("label,quarter", [
    ("1955 Q1", 1), ("1955Q4", 4), ("1955-Q2", 2), ("1955 - Q1", 1), ("Q3 1955", 3), ("Q3, 1955", 3), ("1955 quarter 1", 1), ("1st quarter 1955", 1), ("  1955   q2 ", 2), ("QTR 1 1955", 1), ("2nd qtr. 1955", 2),
    ("1955", None), ("1955 Q5", None), ("1955 Q0", None), ("Q1", None), ("Mar 1955", None), ("1955 H1", None), ("55 Q1", None), ("1955-3", None), ("1955/3", None), ("0955 Q1", None), (None, None),
])
def test_quarter_labels(spark, label, quarter):
    got = spark.createDataFrame([(label,)], "t string").select(labels.parse_quarter(F.col("t"))).first()[0]
    assert got == (quarter and 4 * 1955 + quarter - 1)


def test_release_months(spark):
    fine = ["Jan 2016", "January 2016", "2016 Jan", "2016-01", "2016/01", "01/2016", "2016-01-15", "15 January 2016", "January 15th, 2016", "2016-01-15 00:00:00", "1st of Jan 2016"]
    bad = ["Jan-16", "Jan", "2016", "Quarter 4 (Oct to Dec) 2015", "Oct to Dec 2015", "Vintage 3", "Jan 2016 Month 2", "2016-13", "13/2016", "", "first estimate", None, "Jan 2016 2017", "Jan 32 2016", "Released in Jan 2016"]
    rows = spark.createDataFrame([(t, True) for t in fine] + [(t, False) for t in bad], "t string, ok boolean")
    got = [(r.t, r.m) for r in rows.select("t", "ok", labels.parse_release_month(F.col("t")).alias("m")).collect() if r.m != (12 * 2016 if r.ok else None)]
    assert got == []
    assert spark.createDataFrame([("Sept 2016",)], "t string").select(labels.parse_release_month(F.col("t"))).first()[0] == 12 * 2016 + 8


def test_numbers_are_hidden(spark):
    cases = {
        "1,234 and .5": "[num] and [num]", "5 per cent, 2pp": "[num], [num]", "GBP 5m or £3.2 billion": "[num] or [num]", "in 2016 Q1": "in 2016 Q1", "12345": "[num]", "a–b ‘c’ … £": "a-b 'c' ... GBP",
        "-1.25%": "[num]", "1,23": "1,23", "1,234 5,678 9,012": "[num] [num] [num]", "3 percentage points": "[num]", None: "",
    }
    rows = spark.createDataFrame([(k,) for k in cases], "t string").select("t", labels.blank_numbers(F.col("t")).alias("b")).collect()
    assert {r.t: r.b for r in rows} == cases


def test_numbers_of_many_points_and_commas_are_hidden(spark):
    cases = {
        "126.57.31.34%%%": "[num].[num]%%", "€5, 1,%": "[num] [num]", "...5": "..[num]", "12.34..56": "[num].[num]", "12345.,41": "[num].,41", "1234.5.6%": "1234.[num]", "1,234-5,678": "[num][num]",
        "éGBP 5\n12,345\n": "é[num]\n[num]\n",
    }
    rows = spark.createDataFrame([(k,) for k in cases], "t string").select("t", labels.blank_numbers(F.col("t")).alias("b")).collect()
    assert {r.t: r.b for r in rows} == cases


def test_streamed_rows_equal_the_batch(spark, tmp_path):
    p = panel(spark, n=90, k=2)
    for k in range(3):
        p.where(f"pos >= {30 * k} and pos < {30 * k + 30}").coalesce(1).write.parquet(str(tmp_path / "in" / str(k)))
    src = spark.readStream.schema("sid string, pos long, x double").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    q = online.rolling_stream(src).writeStream.format("memory").queryName("rolled").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    got = {(r.sid, r.pos): r.modulus for r in spark.sql("select * from rolled where status = 'ok'").collect()}
    want = {(r.sid, r.pos): r.modulus for r in fits.rolling_ar2(p).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - v) < 1e-9 for k, v in want.items())
    onsets = sorted((r.sid, r.onset) for r in spark.sql("select * from rolled where event = 'onset'").collect())
    assert onsets == sorted((r.sid, r.onset) for r in episodes.episodes(episodes.runs(p)).collect())


def test_levels_stream(spark, tmp_path):
    rows = spark.createDataFrame([("a", f"2024-01-01 0{h}:10:00", 1.0) for h in range(8)] + [("a", "2024-01-01 00:20:00", 5.0)], "sid string, t string, v double")
    rows.select("sid", F.to_timestamp("t").alias("t"), "v").coalesce(1).write.parquet(str(tmp_path / "in"))
    src = spark.readStream.schema("sid string, t timestamp, v double").parquet(str(tmp_path / "in"))
    q = online.levels_stream(src, "sid", "t", "v").writeStream.format("memory").queryName("hours").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    out = {r.start.hour: r.y for r in spark.sql("select * from hours").collect()}
    assert out[0] == 6.0 and out[1] == 1.0 and 7 not in out


def test_registered_functions(spark):
    register.register(spark)
    r = spark.sql("select root_modulus(1D, -0.5D) m, in_triangle(1D, -0.5D) t, wilson_low(5, 10) w, spectral_radius(array(array(1D, -0.5D), array(1D, 0D))) s, schur_cohn_stable(array(0.2D, 0.1D, 1D)) k").first()
    assert abs(r.m - r.s) < 1e-12 and r.t and r.k and 0.2 < r.w < 0.3
    r = spark.sql("select mc_pvalue(2, 3) p, mc_pvalue(0, 0) none, root_summary(1D, -0.5D) s, root_summary(0.5D, 0.2D) u, root_summary(0D, 0D) z").first()
    assert r.p == 0.75 and r.none is None and r.s.complex_pair and abs(r.s.period - 8) < 1e-12 and r.u.period is None and r.u.stable and r.z.half_life == 0
    assert [tuple(x) for x in spark.sql("select * from episodes(array(1D, -1D, -1D, 1D), 2, 8)").collect()] == [(1, 2)]


def test_store_refuses_another_manifest_and_finds_corruption(spark, tmp_path):
    rows = spark.createDataFrame([("c", k, float(k)) for k in range(5)], "cell string, replicate int, S double")
    store = ReplicateStore(spark, str(tmp_path / "s"), {"plan": 1})
    assert store.put(rows.where("replicate < 3")) == 3 and store.put(rows) == 2 and store.put(rows) == 0
    assert store.verify() == {"records": 5, "wrong": 0, "odd": 0, "orphans": 0, "foreign": 0}
    with pytest.raises(series.ContractError):
        ReplicateStore(spark, str(tmp_path / "s"), {"plan": 2})
    store.records.limit(1).withColumn("S", F.lit(9.5)).withColumn("replicate", F.lit(99)).write.mode("append").partitionBy("cell").parquet(str(tmp_path / "s/records"))
    assert store.verify()["wrong"] == 1 and store.verify()["odd"] == 1


def test_replicates_resume(spark):
    first = simulate.replicates(spark, [1.0, 1.6], 3, 19)
    done = first.where("replicate < 2")
    again = simulate.replicates(spark, [1.0, 1.6], 3, 19, done=done)
    assert sorted(map(str, again.collect())) == sorted(map(str, first.where("replicate >= 2").collect()))


def test_units_spread_over_tasks(spark):
    rows = spark.range(64).select(F.col("id").cast("string").alias("sid"))

    def where(row):
        from pyspark import TaskContext

        yield {"sid": row["sid"], "task": TaskContext.get().partitionId()}

    got = simulate.each(rows, where, "sid string, task int").collect()
    tasks = [r.task for r in got]
    assert len(got) == 64 and len(set(tasks)) >= 2 * spark.sparkContext.defaultParallelism and max(map(tasks.count, tasks)) <= 10


def test_polynomials_of_a_batch_by_degree(spark):
    """Degrees mixed in a batch; nothing of a fold is written out for each coefficient, and the work is dealt out."""
    rng = np.random.default_rng(3)
    c = {k: [*rng.normal(size=1 + k % 9).tolist(), 1.0] for k in range(200)} | {200: None, 201: [2.0], 202: [0.0, 0.0, 1.0], 203: [2.0, -3.0, 1.0], 204: [float("nan"), 1.0]}
    out = simulate.polynomial_roots(spark.createDataFrame(list(c.items()), "vec_id long, c array<double>").coalesce(1), "c")
    assert out.rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism
    got = {r.vec_id: (r.stable, r.modulus) for r in out.collect()}
    assert got[200] == (None, None) and got[201] == (True, None) and got[202] == (True, 0.0) and got[204][0] is False and np.isnan(got[204][1])
    for k in [*range(200), 203]:
        want = np.abs(np.roots(c[k][::-1])).max()
        assert got[k][0] == (want < 1) and abs(got[k][1] - want) < 1e-6 * want
    with pytest.raises(Exception, match="leading coefficient"):
        simulate.polynomial_roots(spark.createDataFrame([(1, [1.0, 0.0])], "vec_id long, c array<double>"), "c").collect()
