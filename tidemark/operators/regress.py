"""Least squares of several regressors, and root moduli of polynomials, as column expressions: windowed moments become a matrix in
arrays, and the solve is a fold over its rows.

Moments are centred (var_pop, covar_pop) and scaled to correlations, so a pivot is a share of a regressor's variance that the
earlier ones leave.  A pivot of EPS or less has status `failed` and NULL coefficients."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tidemark.functions.labels import let
from tidemark.operators.series import per_series

EPS = 1e-12
#: Halvings after which what is left of a root's modulus is below double precision.
SQUARINGS = 46


def eliminate(m: Column, size: int) -> Column:
    """The last columns of an augmented matrix (array of `size` rows) after elimination with row pivoting: the solution, a row
    for each unknown.  NULL if a pivot is not above EPS."""

    def step(a, k):
        best = F.array_max(F.transform(F.sequence(k, F.lit(size - 1)), lambda i: F.struct(F.abs(F.get(F.get(a, i), k)).alias("size"), (-i).alias("at"))))

        def clear(at, pivot, unit):
            moved = F.transform(a, lambda row, i: F.when(i == at, F.get(a, k)).when(i == k, pivot).otherwise(row))
            return F.transform(moved, lambda row, i: F.when(i == k, unit).otherwise(F.zip_with(row, unit, lambda x, u: x - F.get(row, k) * u)))

        def choose(b):
            at = -b["at"]
            return let(F.get(a, at), lambda pivot: let(F.transform(pivot, lambda x: F.try_divide(x, F.get(pivot, k))), lambda unit: F.when(b["size"] > EPS, clear(at, pivot, unit))))

        return let(best, choose)

    solved = F.aggregate(F.sequence(F.lit(0), F.lit(size - 1)), m, step)
    return F.transform(solved, lambda row: F.slice(row, size + 1, F.size(row) - size))


def fit(rows: DataFrame, z: list[str], y: list[str], by: list[str], over: WindowSpec | None = None, least: int = 0) -> DataFrame:
    """Regression of each y on a constant and z: by..., n, intercept (an entry for each y), beta (a row for each z, an entry for
    each y), status.  With `over` a fit for every row whose frame holds `least` rows, else one for each group."""
    at = lambda c: c.over(over) if over is not None else c
    m = {"n": at(F.count(F.lit(1)))} | {f"m_{v}": at(F.avg(v)) for v in (*z, *y)}
    m |= {f"s_{a}_{v}": at(F.covar_pop(a, v)) for i, a in enumerate(z) for v in (*z[i:], *y)}
    out = rows.select(*by, *(c.alias(k) for k, c in m.items())) if over is not None else rows.groupBy(*by).agg(*(c.alias(k) for k, c in m.items()))
    out = out.where(F.col("n") >= least)
    s = lambda a, v: F.col(f"s_{a}_{v}") if f"s_{a}_{v}" in m else F.col(f"s_{v}_{a}")
    sd = {a: F.sqrt(s(a, a)) for a in z}
    ratio = lambda a, v: F.try_divide(s(a, v), sd[a] * sd[v])
    matrix = F.array(*(F.array(*(ratio(a, v) for v in z), *(F.try_divide(s(a, v), sd[a]) for v in y)) for a in z))
    varied = F.array_min(F.array(*(s(a, a) for a in z))) > 0
    out = out.withColumn("x", F.when(varied, let(matrix, lambda m: eliminate(m, len(z)))))
    beta = F.zip_with("x", F.array(*(sd[a] for a in z)), lambda row, d: F.transform(row, lambda v: v / d))
    out = out.withColumn("beta", beta)
    cell = lambda i, j: F.get(F.get("beta", i), j)
    intercept = F.array(*(F.col(f"m_{v}") - sum(F.col(f"m_{a}") * cell(i, j) for i, a in enumerate(z)) for j, v in enumerate(y)))
    fine = F.col("x").isNotNull()
    return out.select(*by, "n", F.when(fine, intercept).alias("intercept"), F.when(fine, F.col("beta")).alias("beta"), F.when(fine, "ok").otherwise("failed").alias("status"))


def largest_modulus(coefficients: Column) -> Column:
    """Largest modulus of a real polynomial's roots (array of doubles, constant term first), of any degree: the roots are squared
    again and again, each time after their scale has been taken out, and the logarithms of the scales add up with weights
    halved each time.  NULL for a zero or missing leading term, and for a constant."""
    e = F.reverse(coefficients)
    lead = F.get(e, 0)
    monic = F.transform(e, lambda x: F.try_divide(x, lead))
    n = F.size(coefficients) - 1

    def square(p):
        d = F.size(p) - 1
        term = lambda k, i: F.when((2 * k - i) % 2 == 0, 1.0).otherwise(-1.0) * F.get(p, i) * F.get(p, 2 * k - i)
        return F.transform(F.sequence(F.lit(0), d), lambda k: F.aggregate(F.sequence(F.greatest(F.lit(0), 2 * k - d), F.least(d, 2 * k)), F.lit(0.0), lambda s, i: s + term(k, i)))

    def scaled(s, p, scale):
        unit = F.transform(p, lambda x, j: F.when(scale > 0, x / F.pow(scale, j)).otherwise(x))
        log = F.when(scale > 0, s["log"] + s["weight"] * F.log(scale)).otherwise(F.lit(float("-inf")))
        return F.struct(let(unit, square).alias("p"), log.alias("log"), (s["weight"] / 2).alias("weight"))

    def step(s, _):
        size = lambda p: F.array_max(F.transform(p, lambda x, j: F.when(j > 0, F.pow(F.abs(x), F.try_divide(F.lit(1.0), j.cast("double")))).otherwise(0.0)))
        return let(s["p"], lambda p: let(size(p), lambda scale: scaled(s, p, scale)))

    state = F.struct(monic.alias("p"), F.lit(0.0).alias("log"), F.lit(1.0).alias("weight"))
    return F.when((n > 0) & (lead != 0), F.aggregate(F.sequence(F.lit(1), F.lit(SQUARINGS)), state, step, lambda s: F.exp(s["log"])))


# ------------------------------------------------ two variables, two lags
VAR_ROWS = ["g1", "d1", "g2", "d2"]


def var_rows(pairs: DataFrame) -> DataFrame:
    """sid, pos, g, du and their two lags."""
    w = per_series()
    lag = {f"{k[0]}{j}": F.lag(k, j).over(w) for j in (1, 2) for k in ("g", "du")}
    return pairs.select("sid", "pos", "g", "du", *(c.alias(k) for k, c in lag.items())).where("g2 is not null and d2 is not null")


def var_polynomial(a1: list, a2: list) -> Column:
    """det(x^2 - A1 x - A2) of two 2x2 matrices, constant term first."""
    (a, b), (c, d) = a1
    (p, q), (r, s) = a2
    return F.array(p * s - q * r, a * s + p * d - b * r - q * c, a * d - b * c - p - s, -(a + d), F.lit(1.0))


def _named(fits: DataFrame, by: list[str]) -> DataFrame:
    """Coefficient matrices and the spectral radius."""
    at = lambda i, j: F.get(F.get("beta", i), j)
    a1 = [[at(0, 0), at(1, 0)], [at(0, 1), at(1, 1)]]
    a2 = [[at(2, 0), at(3, 0)], [at(2, 1), at(3, 1)]]
    cols = lambda m: F.when(F.col("beta").isNotNull(), F.array(*(F.array(*row) for row in m)))
    return fits.select(*by, "n", "intercept", cols(a1).alias("A1"), cols(a2).alias("A2"), F.when(F.col("beta").isNotNull(), largest_modulus(var_polynomial(a1, a2))).alias("modulus"), "status")


def ols_var2(pairs: DataFrame) -> DataFrame:
    """sid, n, intercept, A1, A2, modulus, status of each whole pair of series (sid, pos, g, du)."""
    return _named(fit(var_rows(pairs), VAR_ROWS, ["g", "du"], ["sid"]), ["sid"])


def rolling_var2(pairs: DataFrame, window: int = 40) -> DataFrame:
    """The same for every full window of `window` observations, by the position at which it ends."""
    frame = per_series().rowsBetween(3 - window, 0)
    return _named(fit(var_rows(pairs), VAR_ROWS, ["g", "du"], ["sid", "pos"], frame, window - 2), ["sid", "pos"])


def hamilton_cycle(series: DataFrame, ahead: int = 8, lags: int = 4) -> DataFrame:
    """sid, pos, cycle: residual of x on a constant and its values `ahead` to ahead + lags - 1 before; NULL where these don't
    exist, where the series has fewer than ahead + 2 * lags + 1 values, or where the design has lost rank."""
    names = [f"b{j}" for j in range(lags)]
    w = per_series()
    rows = series.select("sid", "pos", "x", *(F.lag("x", ahead + j).over(w).alias(k) for j, k in enumerate(names)))
    whole = rows.withColumn("size", F.count("*").over(Window.partitionBy("sid")))
    f = fit(whole.where(F.col(names[-1]).isNotNull() & (F.col("size") >= ahead + 2 * lags + 1)), names, ["x"], ["sid"])
    fitted = F.get("intercept", 0) + sum(F.get(F.get("beta", j), 0) * F.col(k) for j, k in enumerate(names))
    return rows.join(f, "sid", "left").select("sid", "pos", (F.col("x") - fitted).alias("cycle"))
