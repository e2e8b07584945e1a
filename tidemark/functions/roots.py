"""AR(2) root diagnostics as column expressions.  A complex number is STRUCT<re, im>; a value that is not defined is
NULL, never zero."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.labels import let


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def in_triangle(phi1, phi2) -> Column:
    """Strictly inside the stability triangle; no tolerance."""
    p1, p2 = _c(phi1), _c(phi2)
    return (p1 + p2 < 1) & (p2 - p1 < 1) & (p2 > -1)


def discriminant(phi1, phi2) -> Column:
    return _c(phi1) * _c(phi1) + 4 * _c(phi2)


def _large(phi1, phi2) -> Column:
    return (F.abs(_c(phi1)) + F.sqrt(discriminant(phi1, phi2))) / 2


def root_modulus(phi1, phi2) -> Column:
    """The larger root's modulus.  Real roots: the larger by addition of like signs, the smaller by the root product,
    so neither suffers from cancellation."""
    p2 = _c(phi2)
    big = _large(phi1, phi2)
    real = F.when(big == 0, F.lit(0.0)).otherwise(F.greatest(big, F.abs(p2 / big)))
    return F.when(discriminant(phi1, phi2) < 0, F.sqrt(-p2)).otherwise(real)


def root_summary(phi1, phi2) -> Column:
    """STRUCT<discriminant, modulus, stable, complex_pair, period, half_life, spectral_peak, frequency>."""
    p1, p2 = _c(phi1), _c(phi2)
    d, m = discriminant(p1, p2), root_modulus(p1, p2)
    pair = d < 0
    theta = F.atan2(F.sqrt(-d), p1)
    stable = in_triangle(p1, p2)
    half = F.when(m == 0, F.lit(0.0)).when(m < 1, F.log(F.lit(0.5)) / F.log(m))
    peak = stable & (p2 < 0) & (F.abs(p1) * (1 - p2) < -4 * p2)
    cosine = F.least(F.greatest(p1 * (p2 - 1) / (4 * p2), F.lit(-1.0)), F.lit(1.0))
    return F.struct(
        d.alias("discriminant"), m.alias("modulus"), stable.alias("stable"), pair.alias("complex_pair"), F.when(pair, 2 * math.pi / theta).alias("period"),
        half.alias("half_life"), peak.alias("spectral_peak"), F.when(peak, F.acos(cosine) / (2 * math.pi)).alias("frequency"),
    )


def companion(phi1, phi2) -> Column:
    return F.array(F.array(_c(phi1), _c(phi2)), F.array(F.lit(1.0), F.lit(0.0)))


def samuelson(phi1, phi2) -> Column:
    """Multiplier-accelerator pair implied by an AR(2): STRUCT<c, v, oscillates>; NULLs where c <= 0."""
    p1, p2 = _c(phi1), _c(phi2)
    s = p1 + p2
    v = F.when(s > 0, -p2 / s)
    return F.struct(F.when(s > 0, s).alias("c"), v.alias("v"), F.when(s > 0, s * (1 + v) * (1 + v) < 4 * v).alias("oscillates"))


def asymptotic_se(phi2, n) -> Column:
    return F.sqrt((1 - _c(phi2) * _c(phi2)) / _c(n))


# ------------------------------------------------ polynomials: arrays of STRUCT<re, im>, constant term first
def complex_array(values: Column) -> Column:
    return F.transform(values, lambda x: F.struct(x.cast("double").alias("re"), F.lit(0.0).alias("im")))


def conjugate_reciprocal(coefficients: Column) -> Column:
    return F.transform(F.reverse(coefficients), lambda z: F.struct(z["re"].alias("re"), (-z["im"]).alias("im")))


def schur_transform(a: Column) -> Column:
    """One Schur-Cohn step: conj(a_n) p - a_0 p*, without its constant term (which vanishes)."""
    first, last = F.element_at(a, 1), F.element_at(a, -1)
    step = F.zip_with(a, conjugate_reciprocal(a), lambda p, q: F.struct(
        (last["re"] * p["re"] + last["im"] * p["im"] - (first["re"] * q["re"] - first["im"] * q["im"])).alias("re"),
        (last["re"] * p["im"] - last["im"] * p["re"] - (first["re"] * q["im"] + first["im"] * q["re"])).alias("im"),
    ))
    return F.slice(step, 2, F.size(a) - 1)


def schur_cohn_stable(a: Column) -> Column:
    """All roots inside the unit circle, whatever the degree: as many Schur-Cohn steps as the array is long, each asking for
    |a_0| < |a_n| of what the step before left, scaled to its largest coefficient.  A constant has no roots outside; a zero or
    missing leading term is an error; NULL gives NULL."""
    size = lambda z: z["re"] * z["re"] + z["im"] * z["im"]

    def scaled(s, q, most):
        inside = size(F.element_at(s["p"], 1)) < size(F.element_at(s["p"], -1))
        unit = F.transform(q, lambda z: F.struct((z["re"] / most).alias("re"), (z["im"] / most).alias("im")))
        return let(s["ok"] & inside & (most > 0), lambda on: F.struct(F.when(on, unit).otherwise(s["p"]).alias("p"), on.alias("ok")))

    def step(s, _):
        most = lambda q: F.array_max(F.transform(q, lambda z: F.greatest(F.abs(z["re"]), F.abs(z["im"]))))
        return let(schur_transform(s["p"]), lambda q: let(most(q), lambda m: scaled(s, q, m)))

    start = F.struct(F.transform(a, lambda z: F.struct(z["re"].alias("re"), z["im"].alias("im"))).alias("p"), F.lit(True).alias("ok"))
    walked = F.aggregate(F.sequence(F.lit(1), F.size(a) - 1), start, step, lambda s: s["ok"])
    wrong = F.raise_error(F.lit("the leading coefficient is zero or missing")).cast("boolean")
    return F.when(a.isNull(), None).when((F.size(a) == 0) | F.coalesce(size(F.get(a, F.size(a) - 1)) == 0, F.lit(True)), wrong).when(F.size(a) == 1, True).otherwise(walked)
