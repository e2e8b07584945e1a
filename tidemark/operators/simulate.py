"""Kernels over Spark: one Arrow boundary for each operator, one row (a packed series) for each independent unit.

Rows are dealt by unit before the kernel, and every unit draws from its own addressed stream, so results don't depend
on the number of partitions.  A unit that fails gives a row with its status."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StructField, StructType

from tidemark.functions import stats
from tidemark.kernels import ar, matrices, streams
from tidemark.sources import shared


def packed(series: DataFrame, *values: str, sid: str = "sid", pos: str = "pos") -> DataFrame:
    """A row for each series: sid and its values in order of position, one array for each column."""
    rows = series.groupBy(sid).agg(F.array_sort(F.collect_list(F.struct(pos, *values))).alias("rows"))  # a series is one kernel's input
    return rows.select(sid, *(F.col("rows")[v].alias(v) for v in values))


def each(rows: DataFrame, f: Callable[[dict], Iterator[dict]], schema: str, key: str | None = "sid") -> DataFrame:
    """f on every row, in Arrow batches; dealt by key first, into a number of partitions that is given, so that small rows
    of long work are not merged into one task at run time."""
    out = [x.split()[0] for x in schema.split(", ")]

    def run(batches):
        for b in batches:
            got = [r for row in b.to_dict("records") for r in f(row)]
            yield pd.DataFrame(got, columns=out)

    if key:
        spark = rows.sparkSession
        width = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
        rows = rows.repartition(width, key)
    return rows.mapInPandas(run, schema)


def polynomial_roots(rows: DataFrame, coefficients: str, key: str = "vec_id", squarings: int = 30) -> DataFrame:
    """The columns of rows but the coefficients (arrays of doubles, constant term first), with stable (all roots inside the unit
    circle) and modulus (the largest; NULL for a constant); both NULL without coefficients.  Polynomials of a batch are worked on
    together by degree, and dealt by key before, as a small file holds long work.  A zero or missing leading term stops."""
    kept = [c for c in rows.columns if c != coefficients]

    def run(batches):
        for b in batches:
            c = b.column(coefficients)
            size = pc.fill_null(pc.list_value_length(c), -1).to_numpy(zero_copy_only=False)
            flat, at = c.flatten().to_numpy(zero_copy_only=False), np.cumsum(np.maximum(size, 0)) - np.maximum(size, 0)
            stable, modulus = np.ones(len(size), bool), np.zeros(len(size))
            for n in np.unique(size[size >= 0]):
                own = np.flatnonzero(size == n)
                m = flat[at[own][:, None] + np.arange(n)]
                if n == 0 or (m[:, -1] == 0).any():
                    raise ValueError("the leading coefficient is zero or missing")
                if n > 1:
                    stable[own], modulus[own] = matrices.schur_cohn(m), matrices.largest_modulus(m, squarings)
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in kept), pa.array(stable, mask=size < 0), pa.array(modulus, mask=size < 2)], [*kept, "stable", "modulus"])

    spark = rows.sparkSession
    width = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    schema = StructType([*(rows.schema[k] for k in kept), StructField("stable", BooleanType()), StructField("modulus", DoubleType())])
    return rows.repartition(width, key).mapInArrow(run, schema)


ATTEMPTS = "sid string, analysis string, number int, status string, statistic double, observed double, onsets array<int>, parts array<double>, error string"


def _attempts(sid: str, analysis: str, rows: list[dict]) -> Iterator[dict]:
    seen = next((r["value"] for r in rows if r["number"] == -1), None)
    for r in rows:
        yield {"sid": sid, "analysis": analysis, "number": r["number"], "status": r["status"], "statistic": r["value"], "observed": seen, "onsets": r["onsets"], "parts": r["parts"], "error": r["error"]}


def unit(sid) -> int:
    """A stable stream cell for a series name."""
    import zlib

    return zlib.crc32(str(sid).encode())


def csd_test(series: DataFrame, B: int = 1000, stream: int = streams.DEVELOPMENT, **opts) -> DataFrame:
    """Attempt ledger of every series: the observed statistic (number -1) and B surrogates."""

    def f(row):
        rng = streams.stream(stream, unit(row["sid"]))
        yield from _attempts(str(row["sid"]), "primary", ar.csd_test(np.asarray(row["x"], float), rng, B, **opts))

    return each(packed(series, "x"), f, ATTEMPTS)


def surrogate_paths(series: DataFrame, B: int = 1000, stream: int = streams.DEVELOPMENT, chunk: int = 250) -> DataFrame:
    """sid, number, path of the attempts that `csd_test` makes from the same stream, with the series itself as number -1."""

    def f(row):
        x = np.asarray(row["x"], float)
        yield {"sid": str(row["sid"]), "number": -1, "path": x.tolist()}
        model, rng = ar.null_model(x), streams.stream(stream, unit(row["sid"]))
        for lo in range(0, B if model is not None else 0, chunk):
            for k, path in enumerate(model.draw(rng, min(chunk, B - lo), "residual")[:, :, 0]):
                yield {"sid": str(row["sid"]), "number": lo + k, "path": path.tolist()}

    return each(packed(series, "x"), f, "sid string, number int, path array<double>")


def joint_test(series: DataFrame, B: int = 1000, stream: int = streams.DEVELOPMENT + 1, **opts) -> DataFrame:
    """One set of paths, three metrics with their own denominators."""

    def f(row):
        rows = ar.csd_test(np.asarray(row["x"], float), streams.stream(stream, unit(row["sid"])), B, metrics=ar.METRICS, **opts)
        for m in ar.METRICS:
            yield from _attempts(str(row["sid"]), m, [r for r in rows if r["metric"] == m])

    return each(packed(series, "x"), f, ATTEMPTS)


def _planned(rows: DataFrame, values: Callable[[dict], np.ndarray], test: Callable, plan: dict[str, dict], rng: Callable, B: int) -> DataFrame:
    """Attempt ledger of a plan of analyses: a unit is one analysis of one series, with its own stream rng(name, sid).  A
    test of several metrics gives them all, the first under the analysis's name."""
    rows = rows.withColumn("analysis", F.explode(F.array(*map(F.lit, plan)))).withColumn("unit", F.concat_ws("/", "sid", "analysis"))

    def f(row):
        name = row["analysis"]
        got = test(values(row), rng(name, row["sid"]), B, **plan[name])
        for m in dict.fromkeys(r["metric"] for r in got):
            yield from _attempts(str(row["sid"]), name if m == "primary" else m, [r for r in got if r["metric"] == m])

    return each(rows, f, ATTEMPTS, "unit")


def _numbered(plan: dict, stream: int) -> Callable:
    """Streams of a plan's analyses, in their order."""
    at = {name: stream + k for k, name in enumerate(plan)}
    return lambda name, sid: streams.stream(at[name], unit(sid))


def _one(row: dict) -> np.ndarray:
    return np.asarray(row["x"], float)


def _two(row: dict) -> np.ndarray:
    return np.stack([np.asarray(row["g"], float), np.asarray(row["du"], float)], 1)


def analyze_h1(series: DataFrame, B: int = 1000, registered: bool = False) -> DataFrame:
    """Attempt ledger of the seven analyses of each series."""
    plan = {"primary": {"metrics": ar.METRICS}} | ar.VARIANTS

    def rng(name, sid):
        return streams.stream(name, 0, allow_registered=True) if registered else streams.stream(streams.DEVELOPMENT + streams.STREAMS[name], unit(sid))

    return _planned(packed(series, "x"), _one, ar.csd_test, plan, rng, B)


def comparisons(ledger: DataFrame) -> DataFrame:
    """One row for each sid and analysis of an attempt ledger, in one pass over it: observed, episodes, positive (changes
    above zero), retained, no_episode, failed, comparison, p, exceedances (draws that reach the observed value) and the
    Wilson interval of their share."""
    seen, drawn = F.col("number") == -1, F.col("number") >= 0
    of = lambda c: F.max(F.when(seen, c))
    n = lambda s: F.count_if(drawn & (F.col("status") == s))
    by = ledger.groupBy("sid", "analysis").agg(
        of(F.col("status")).alias("seen"), of(F.col("observed")).alias("observed"), of(F.size("onsets")).alias("episodes"), of(F.size(F.filter("parts", lambda x: x > 0))).alias("positive"),
        n("retained").alias("retained"), n("no_eligible_episode").alias("no_episode"), n("failed").alias("failed"), F.bool_or(F.col("number") == -2).alias("no_null"),
        F.count_if(drawn & (F.col("status") == "retained") & (F.col("statistic") >= F.col("observed"))).alias("over"),
    )
    status = F.when(F.col("no_null"), "null_model_failed").when(F.col("seen") != "retained", "observed_not_estimable").when(F.col("failed") > 0, "failed").when(F.col("retained") == 0, "no_draws").otherwise("complete")
    full = status == "complete"
    return by.select(
        "sid", "analysis", "observed", "episodes", "positive", "retained", "no_episode", "failed", status.alias("comparison"), F.when(full, (1 + F.col("over")) / (1 + F.col("retained"))).alias("p"),
        F.when(full, F.col("over")).alias("exceedances"), F.when(full, stats.wilson(F.col("over"), F.col("retained"))).alias("interval"),
    )


def episode_table(ledger: DataFrame) -> DataFrame:
    """sid, analysis, episode, onset, value: what the observed statistic is the mean of."""
    rows = ledger.where("number = -1").select("sid", "analysis", F.posexplode(F.arrays_zip("onsets", "parts")).alias("episode", "e"))
    return rows.select("sid", "analysis", "episode", F.col("e.onsets").alias("onset"), F.col("e.parts").alias("value"))


def intervals(ledger: DataFrame, B: int = 10_000, stream: int = streams.DEVELOPMENT + 2) -> DataFrame:
    """sid, status, low, high: 90 % resampling interval of the observed changes."""

    def f(row):
        status, low, high = ar.interval(row["parts"], streams.stream(stream, unit(row["sid"])), B)
        yield {"sid": row["sid"], "status": status, "low": low, "high": high}

    return each(ledger.where("number = -1 and analysis = 'primary'").select("sid", "parts"), f, "sid string, status string, low double, high double")


def bootstrap(series: DataFrame, B: int = 4000, method: str = "LS", stream: int = streams.DEVELOPMENT + 3) -> DataFrame:
    """sid, draw, phi1, phi2, modulus, period of refits to residual-bootstrap paths."""

    def f(row):
        for k, d in enumerate(ar.bootstrap(np.asarray(row["x"], float), streams.stream(stream, unit(row["sid"])), B, method).tolist()):
            yield {"sid": str(row["sid"]), "draw": k, "phi1": d[0], "phi2": d[1], "modulus": d[2], "period": None if np.isnan(d[3]) else d[3]}

    return each(packed(series, "x"), f, "sid string, draw int, phi1 double, phi2 double, modulus double, period double")


def rolling_var2(series: DataFrame, window: int = 40) -> DataFrame:
    """sid, pos, modulus, intercept, A1, A2 of every window of a pair (g, du)."""

    def f(row):
        x = np.stack([np.asarray(row["g"], float), np.asarray(row["du"], float)], 1)
        if len(x) < window:
            return
        for k, (c, a1, a2, m) in enumerate(zip(*matrices.rolling_var2(x, window))):
            yield {"sid": str(row["sid"]), "pos": k + window - 1, "modulus": float(m), "intercept": c.tolist(), "A1": a1.tolist(), "A2": a2.tolist()}

    return each(packed(series, "g", "du"), f, "sid string, pos long, modulus double, intercept array<double>, A1 array<array<double>>, A2 array<array<double>>")


def var_test(pairs: DataFrame, B: int = 1000, stream: int = streams.DEVELOPMENT + 30, **opts) -> DataFrame:
    """Attempt ledger of the spectral radius of pairs (g, du)."""

    def f(row):
        x = np.stack([np.asarray(row["g"], float), np.asarray(row["du"], float)], 1)
        yield from _attempts(str(row["sid"]), "var", matrices.var_test(x, streams.stream(stream, unit(row["sid"])), B, **opts))

    return each(packed(pairs, "g", "du"), f, ATTEMPTS)


def analyze_e1(series: DataFrame, B: int = 1000, stream: int = streams.DEVELOPMENT + 20, exogenous: tuple[int, ...] = ()) -> DataFrame:
    """Attempt ledger of the seven annual analyses: joint primary, trend and lag1; windows 25 and 35; fixed dates; wild signs.
    Onsets at `exogenous` positions (wars, an epidemic) count neither in the series nor in a surrogate."""
    rules = DESIGNS["e1"][3] | {"exclude": exogenous}
    plan = {"primary": rules | {"metrics": ar.METRICS}, "window25": rules | {"window": 25}, "window35": rules | {"window": 35}, "fixed": rules | {"fixed": True}, "wild": rules | {"kind": "wild"}}
    return _planned(packed(series, "x"), _one, ar.csd_test, plan, _numbered(plan, stream), B)


def analyze_e2(pairs: DataFrame, B: int = 1000, stream: int = streams.DEVELOPMENT + 30) -> DataFrame:
    """Attempt ledger of the seven analyses of the spectral radius of pairs (g, du)."""
    plan = {"primary": {"metrics": ar.METRICS}} | ar.VARIANTS
    return _planned(packed(pairs, "g", "du"), _two, matrices.var_test, plan, _numbered(plan, stream), B)


def analyze_e3(series: DataFrame, B: int = 1000, stream: int = streams.DEVELOPMENT + 80) -> DataFrame:
    """Attempt ledger of the five analyses of the time-varying AR(2), every surrogate refitted by likelihood: joint
    primary, held-fixed variances and trend; fixed dates; wild signs."""
    plan = {"primary": {}, "fixed": {"fixed": True, "metrics": ("primary",)}, "wild": {"kind": "wild", "metrics": ("primary",)}}
    return _planned(packed(series, "x"), _one, matrices.tv_test, plan, _numbered(plan, stream), B)


#: The real-time comparison's analyses and their options.
REAL_TIME = {"primary": {}, "window32": {"window": 32}, "window48": {"window": 48}, "wild": {"kind": "wild"}}


def analyze_e4(vintages: DataFrame, B: int = 1000, stream: int = streams.DEVELOPMENT + 40, registered: bool = False) -> DataFrame:
    """Attempt ledger of the real-time comparison.  vintages holds (sid, j, onset, pos, x): for each episode j of a series
    its growth as known at the onset.  Every vintage is tested at its own onset from its own stream; an attempt's
    statistic is the mean change over the episodes, and a vintage that fails, fails the attempt."""
    keys = ["sid", "j", "onset"]
    rows = vintages.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("pos", "x"))).alias("rows"))  # a vintage is one kernel's input
    rows = rows.select(*keys, F.col("rows.x").alias("x"), F.concat_ws("/", "sid", "j").alias("unit"))

    def f(row):
        sid, j, t = str(row["sid"]), int(row["j"]), int(row["onset"])
        cell = (j, 0) if registered else (unit(sid), j)
        for k, (name, opts) in enumerate(REAL_TIME.items()):
            rng = streams.stream(5400 + (0, 1, 2, 4)[k] if registered else stream + k, *cell, allow_registered=registered)
            for r in ar.csd_test(np.asarray(row["x"], float), rng, B, onsets=(t,), **opts):
                yield {"sid": sid, "j": j, "onset": t, "analysis": name, "number": r["number"], "status": r["status"], "change": r["value"], "error": r["error"]}

    drawn = each(rows, f, "sid string, j int, onset int, analysis string, number int, status string, change double, error string", "unit")
    size = F.count_if(F.col("number") == -1).over(Window.partitionBy("sid", "analysis"))
    drawn = drawn.withColumn("episodes", size)
    parts = F.array_sort(F.collect_list(F.struct("j", "change", "onset")))  # as many as a series has episodes
    by = drawn.groupBy("sid", "analysis", "number", "episodes").agg(parts.alias("p"), F.count_if(F.col("status") == "retained").alias("fine"), F.min("status").alias("worst"), F.max("error").alias("error"))
    status = F.when(F.col("number") == -2, "null_model_failed").when(F.col("fine") == F.col("episodes"), "retained").when(F.col("number") == -1, F.col("worst")).otherwise("failed")
    by = by.withColumn("status", status).withColumn("statistic", F.when(F.col("status") == "retained", F.aggregate("p.change", F.lit(0.0), lambda n, v: n + v) / F.col("episodes")))
    seen = F.max(F.when(F.col("number") == -1, F.col("statistic"))).over(Window.partitionBy("sid", "analysis"))
    return by.select("sid", "analysis", "number", "status", "statistic", seen.alias("observed"), F.col("p.onset").alias("onsets"), F.col("p.change").alias("parts"), "error")


def whole(analyze: Callable[..., DataFrame], series: DataFrame, B: int = 1000) -> DataFrame:
    """The comparisons of an analysis, with the 90 % resampling interval of the observed changes on the primary's row; both from
    one ledger, which is written once."""
    ledger = shared.written(analyze(series, B), "ledger")
    got = intervals(ledger).select("sid", F.lit("primary").alias("analysis"), F.col("status").alias("interval_status"), "low", "high")
    return comparisons(ledger).join(got, ["sid", "analysis"], "left")


def cycles(series: DataFrame, kind: str = "hp", **opts) -> DataFrame:
    """sid, pos, cycle by the HP or the Hamilton filter."""
    g = matrices.hp_cycle if kind == "hp" else matrices.hamilton_cycle

    def f(row):
        for k, v in enumerate(g(np.asarray(row["x"], float), **opts)):
            yield {"sid": str(row["sid"]), "pos": k, "cycle": None if np.isnan(v) else float(v)}

    return each(packed(series, "x"), f, "sid string, pos long, cycle double")


def filtered_modulus(series: DataFrame, first: int = 39, ratios: tuple[float, float] | None = None) -> DataFrame:
    """sid, pos, modulus, r1, r2, loglik: filtered root modulus of a time-varying AR(2); ratios by likelihood if None."""

    def f(row):
        x = np.asarray(row["x"], float)
        if ratios is None:
            got = matrices.fit_tv_ar2(x)
            states, r1, r2, ll = got["states"], got["r1"], got["r2"], got["loglik"]
        else:
            (r1, r2), (states, _, ll) = ratios, matrices.tv_ar2(x, *ratios)
        m = ar.modulus(states[:, 1], states[:, 2])
        for k in range(max(0, first - 2), len(m)):
            yield {"sid": str(row["sid"]), "pos": k + 2, "modulus": float(m[k]), "r1": float(r1), "r2": float(r2), "loglik": float(ll)}

    return each(packed(series, "x"), f, "sid string, pos long, modulus double, r1 double, r2 double, loglik double")


REPLICATE = "cell string, kappa double, replicate int, status string, input_sha256 string, S double, p double"


#: Designs of size and power runs: path from (stream, kappa, onsets), test, planted onsets, and the test's rules.
DESIGNS = {
    "h1": (streams.ar2_design, ar.csd_test, (49, 99, 149, 199, 249), {}),
    "e1": (lambda rng, kappa, onsets: streams.ar2_design(rng, kappa, onsets, n=316, reach=2), ar.csd_test, tuple(range(34, 275, 40)), {"window": 30, "lookback": 2, "merge": 2, "least": 1, "span": 4}),
    "e2": (streams.var_design, matrices.var_test, (77, 148), {}),
    "e3": (streams.ar2_design, matrices.tv_test, (49, 99, 149, 199, 249), {"metrics": ("primary",)}),
}


def replicates(spark: SparkSession, kappas: list[float], count: int, B: int = 1000, design: str = "h1", fixed: bool = True, stream: int = streams.DEVELOPMENT + 10, done: DataFrame | None = None) -> DataFrame:
    """One row for each (cell, replicate): a path of the design, tested at its planted dates, or (not fixed: size runs)
    at the dates found in it.  Coordinates that are in `done` are not run again.  Units are independent and are dealt
    over the cluster by coordinate.  A path without a date to test has status no_observed."""
    import hashlib

    make, test, onsets, rules = DESIGNS[design]
    rows = spark.range(len(kappas) * count).select((F.col("id") % len(kappas)).cast("int").alias("k"), F.floor(F.col("id") / len(kappas)).cast("int").alias("replicate"))
    rows = rows.withColumn("cell", F.concat(F.lit("kappa"), F.col("k").cast("string")))
    if done is not None:
        rows = rows.join(done.select("cell", "replicate"), ["cell", "replicate"], "left_anti")
    rows = rows.select("cell", "k", "replicate", F.concat_ws("/", "cell", "replicate").alias("unit"))

    def f(row):
        k, r = int(row["k"]), int(row["replicate"])
        x = make(streams.stream(stream, k, r), kappas[k], onsets if fixed else ())
        got = test(x, streams.stream(stream + 1, k, r), B, **rules, onsets=onsets if fixed else None)
        seen = next(g for g in got if g["number"] == -1)
        kept = [g["value"] for g in got if g["number"] >= 0 and g["status"] == "retained"]
        bad = any(g["status"] == "failed" for g in got if g["number"] >= 0) or not kept
        status = "no_observed" if seen["value"] is None else "failed" if bad else "ok"
        p = None if status != "ok" else (1 + sum(v >= seen["value"] for v in kept)) / (len(kept) + 1)
        yield {"cell": row["cell"], "kappa": kappas[k], "replicate": r, "status": status, "input_sha256": hashlib.sha256(x.astype("<f8").tobytes()).hexdigest(), "S": seen["value"], "p": p}

    return each(rows, f, REPLICATE, "unit")
