"""AR(2) fits by closed form over windows and whole series.

Moments are var_pop and covar_pop, which Spark merges in centred form.  A singular design (determinant not above EPS
times the product of variances) has status 'failed' and NULL coefficients."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import roots
from tidemark.operators.series import lags, per_series

EPS = 1e-12


def _moments(over=None) -> dict[str, Column]:
    at = lambda c: c.over(over) if over is not None else c
    return {
        "n": at(F.count("l2")), "s11": at(F.var_pop("l1")), "s22": at(F.var_pop("l2")), "s12": at(F.covar_pop("l1", "l2")), "s1y": at(F.covar_pop("x", "l1")),
        "s2y": at(F.covar_pop("x", "l2")), "my": at(F.avg("x")), "m1": at(F.avg("l1")), "m2": at(F.avg("l2")),
    }


def _solve(m: DataFrame) -> DataFrame:
    det = F.col("s11") * F.col("s22") - F.col("s12") * F.col("s12")
    ok = det > EPS * F.col("s11") * F.col("s22")
    m = m.withColumn("det", F.when(ok, det))
    m = m.withColumns({"phi1": (F.col("s22") * F.col("s1y") - F.col("s12") * F.col("s2y")) / F.col("det"), "phi2": (F.col("s11") * F.col("s2y") - F.col("s12") * F.col("s1y")) / F.col("det")})
    m = m.withColumn("intercept", F.col("my") - F.col("phi1") * F.col("m1") - F.col("phi2") * F.col("m2"))
    m = m.withColumn("modulus", roots.root_modulus("phi1", "phi2"))
    return m.withColumn("status", F.when(F.col("det").isNull(), "failed").otherwise("ok")).drop("det", "s11", "s22", "s12", "s1y", "s2y", "my", "m1", "m2")


def ols_ar2(series: DataFrame) -> DataFrame:
    """sid, n (regression rows), phi1, phi2, intercept, modulus, status of each whole series."""
    return _solve(lags(series).groupBy("sid").agg(*(c.alias(k) for k, c in _moments().items())))


def rolling_ar2(series: DataFrame, window: int = 40) -> DataFrame:
    """The same for every window of `window` observations that ends at a position: regression rows window - 2.
    Positions without a full window are not rows (warm-up)."""
    w = per_series().rowsBetween(3 - window, 0)
    fitted = lags(series).withColumns(_moments(w)).where(F.col("n") == window - 2)
    return _solve(fitted.select("sid", "pos", "n", "s11", "s22", "s12", "s1y", "s2y", "my", "m1", "m2"))


def expanding_ar2(series: DataFrame, least: int = 40) -> DataFrame:
    """Expanding windows of at least `least` observations."""
    w = per_series().rowsBetween(Window.unboundedPreceding, 0)
    fitted = lags(series).withColumns(_moments(w)).where(F.col("n") >= least - 2)
    return _solve(fitted.select("sid", "pos", "n", "s11", "s22", "s12", "s1y", "s2y", "my", "m1", "m2"))


def residuals(series: DataFrame, fit: DataFrame) -> DataFrame:
    """sid, pos, residual and centred residual of whole-series fits."""
    fit = fit.select("sid", "phi1", "phi2", "intercept")
    out = lags(series).join(fit, "sid")
    r = F.col("x") - F.col("intercept") - F.col("phi1") * F.col("l1") - F.col("phi2") * F.col("l2")
    out = out.select("sid", "pos", r.alias("residual"))
    return out.withColumn("centred", F.col("residual") - F.avg("residual").over(Window.partitionBy("sid")))


def yule_walker(series: DataFrame) -> DataFrame:
    """sid, phi1, phi2, intercept from autocovariances with a common denominator."""
    w = per_series()
    c = series.withColumn("mean", F.avg("x").over(Window.partitionBy("sid"))).withColumn("c", F.col("x") - F.col("mean"))
    c = c.withColumns({"c1": F.lag("c").over(w), "c2": F.lag("c", 2).over(w)})
    m = c.groupBy("sid").agg(F.sum(F.col("c") * F.col("c")).alias("g0"), F.sum(F.col("c") * F.col("c1")).alias("g1"), F.sum(F.col("c") * F.col("c2")).alias("g2"), F.max("mean").alias("mean"))
    r1, r2 = F.col("g1") / F.col("g0"), F.col("g2") / F.col("g0")
    p1, p2 = r1 * (1 - r2) / (1 - r1 * r1), (r2 - r1 * r1) / (1 - r1 * r1)
    return m.select("sid", p1.alias("phi1"), p2.alias("phi2"), (F.col("mean") * (1 - p1 - p2)).alias("intercept"))


def yule_serial(series: DataFrame, digits: int = 1) -> DataFrame:
    """sid, r1, r2 of deviations rounded half-even, and the partial regressions they imply."""
    w = per_series()
    d = series.withColumn("d", F.bround(F.col("x") - F.avg("x").over(Window.partitionBy("sid")), digits))
    d = d.withColumns({"d1": F.lag("d").over(w), "d2": F.lag("d", 2).over(w)})
    m = d.groupBy("sid").agg(F.corr("d", "d1").alias("r1"), F.corr("d", "d2").alias("r2"))
    b1, b2 = F.col("r1") * (1 - F.col("r2")) / (1 - F.col("r1") ** 2), (F.col("r2") - F.col("r1") ** 2) / (1 - F.col("r1") ** 2)
    return m.select("sid", "r1", "r2", b1.alias("b1"), b2.alias("b2"))


def disturbances(series: DataFrame, b1: float = 1.343, b2: float = -0.655, c: float = 13.854) -> DataFrame:
    """x - b1 x[t-1] - b2 x[t-2] - c."""
    return lags(series).select("sid", "pos", (F.col("x") - b1 * F.col("l1") - b2 * F.col("l2") - c).alias("disturbance"))


def linear_cycle(series: DataFrame) -> DataFrame:
    """Residual of x on (1, position)."""
    w = Window.partitionBy("sid")
    t = F.col("pos").cast("double")
    slope = F.covar_pop("x", t).over(w) / F.var_pop(t).over(w)
    return series.select("sid", "pos", (F.col("x") - F.avg("x").over(w) - slope * (t - F.avg(t).over(w))).alias("cycle"))


def rolling_lag1(series: DataFrame, window: int = 40) -> DataFrame:
    """Lag-one autocorrelation of every full window, demeaned by the window, over the full-window denominator."""
    w = per_series().rowsBetween(1 - window, 0)
    v = series.withColumn("v", F.collect_list("x").over(w)).where(F.size("v") == window)
    v = v.withColumn("mean", F.aggregate("v", F.lit(0.0), lambda a, b: a + b) / window)
    dev = v.withColumn("d", F.transform("v", lambda x: x - F.col("mean")))
    n = F.aggregate(F.zip_with(F.slice("d", 1, window - 1), F.slice("d", 2, window - 1), lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
    q = F.aggregate("d", F.lit(0.0), lambda a, b: a + b * b)
    return dev.select("sid", "pos", F.when(q > 0, n / q).alias("lag1"))


def ar2_recursion(rows: DataFrame, start: Column, innovations: Column, phi1: Column, phi2: Column, intercept: Column) -> DataFrame:
    """Adds `path`: x[t] = c + phi1 x[t-1] + phi2 x[t-2] + e[t] from a fixed initial pair, in one pass over the array.
    What the step needs goes through its state, as constraints inferred by Catalyst don't see columns in lambdas."""
    first, second = F.get(start, 0), F.get(start, 1)
    state = F.struct(first.alias("b"), second.alias("a"), F.array(first, second).alias("path"), phi1.alias("p1"), phi2.alias("p2"), intercept.alias("c"))

    def step(s, e):
        x = s["c"] + s["p1"] * s["a"] + s["p2"] * s["b"] + e
        return F.struct(s["a"].alias("b"), x.alias("a"), F.concat(s["path"], F.array(x)).alias("path"), s["p1"].alias("p1"), s["p2"].alias("p2"), s["c"].alias("c"))

    return rows.withColumn("path", F.aggregate(innovations, state, step, lambda s: s["path"]))
