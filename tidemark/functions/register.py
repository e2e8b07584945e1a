"""SQL names for the library's functions: register(spark)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf


@pandas_udf(T.DoubleType())
def spectral_radius(matrix: pd.Series) -> pd.Series:
    """Largest absolute eigenvalue of a square matrix given as an array of arrays."""
    return matrix.map(lambda m: None if m is None else float(np.abs(np.linalg.eigvals(np.stack([np.asarray(r, float) for r in m]))).max()))


@pandas_udf(T.BooleanType())
def schur_cohn_stable(coefficients: pd.Series) -> pd.Series:
    """Whether all roots of a real polynomial (constant term first) lie inside the unit circle, by Schur-Cohn steps."""

    def one(c):
        if c is None or len(c) == 0 or c[-1] == 0:
            return None
        a = np.asarray(c, float)
        while len(a) > 1:
            if not abs(a[0]) < abs(a[-1]):
                return False
            a = (a[-1] * a - a[0] * a[::-1])[1:]
        return True

    return coefficients.map(one)


class Episodes:
    """Table function: (onset, fin) of an array's merged runs of negative values."""

    def eval(self, x: list, least: int, merge: int):
        from tidemark.kernels import ar

        yield from ar.episodes(np.asarray(x, float), least, merge)


class SurrogatePaths:
    """Table function: (attempt, path) of surrogates of a series, from an addressed stream."""

    def eval(self, x: list, stream: int, cell: int, count: int):
        from tidemark.kernels import ar, streams

        null = ar.null_model(np.asarray(x, float))
        if null is not None:
            for k, p in enumerate(null.draw(streams.stream(stream, cell), count)[:, :, 0]):
                yield k, p.tolist()


_MODULUS = "CASE WHEN p1*p1 + 4*p2 < 0 THEN sqrt(-p2) WHEN abs(p1) + sqrt(p1*p1 + 4*p2) = 0 THEN 0D ELSE greatest((abs(p1) + sqrt(p1*p1 + 4*p2))/2, abs(p2/((abs(p1) + sqrt(p1*p1 + 4*p2))/2))) END"
_SUMMARY = [
    "p1*p1 + 4*p2", _MODULUS, "p1 + p2 < 1 AND p2 - p1 < 1 AND p2 > -1", "p1*p1 + 4*p2 < 0", "CASE WHEN p1*p1 + 4*p2 < 0 THEN 2*pi()/atan2(sqrt(-(p1*p1 + 4*p2)), p1) END",
    f"CASE WHEN ({_MODULUS}) = 0 THEN 0D WHEN ({_MODULUS}) < 1 THEN ln(0.5D)/ln({_MODULUS}) END",
]
_WILSON = "greatest(0D, least(1D, (k/n + 3.841458820694124/(2*n))/(1 + 3.841458820694124/n) {s} 1.959963984540054/(1 + 3.841458820694124/n)*sqrt(k/n*(1 - k/n)/n + 3.841458820694124/(4*n*n))))"


def register(spark: SparkSession) -> None:
    """root_modulus, root_summary, in_triangle, mc_pvalue, wilson_low, wilson_high as SQL functions (inlined by
    Catalyst); spectral_radius and schur_cohn_stable in Arrow batches; episodes and surrogate_paths as table functions.
    mc_pvalue takes the number of retained draws that reach the statistic, and of all retained draws."""
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION root_modulus(p1 DOUBLE, p2 DOUBLE) RETURNS DOUBLE RETURN {_MODULUS}")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION in_triangle(p1 DOUBLE, p2 DOUBLE) RETURNS BOOLEAN RETURN p1 + p2 < 1 AND p2 - p1 < 1 AND p2 > -1")
    for name, s in (("wilson_low", "-"), ("wilson_high", "+")):
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(k DOUBLE, n DOUBLE) RETURNS DOUBLE RETURN CASE WHEN n > 0 THEN {_WILSON.format(s=s)} END")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION mc_pvalue(reached BIGINT, retained BIGINT) RETURNS DOUBLE RETURN CASE WHEN retained > 0 THEN (1 + reached) / (1D + retained) END")
    fields = "discriminant DOUBLE, modulus DOUBLE, stable BOOLEAN, complex_pair BOOLEAN, period DOUBLE, half_life DOUBLE"
    struct = ", ".join(f"'{x.split()[0]}', {v}" for x, v in zip(fields.split(", "), _SUMMARY))
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION root_summary(p1 DOUBLE, p2 DOUBLE) RETURNS STRUCT<{fields.replace(' ', ': ').replace(',:', ',')}> RETURN named_struct({struct})")
    spark.udf.register("spectral_radius", spectral_radius)
    spark.udf.register("schur_cohn_stable", schur_cohn_stable)
    spark.udtf.register("episodes", F.udtf(Episodes, returnType="onset int, fin int"))
    spark.udtf.register("surrogate_paths", F.udtf(SurrogatePaths, returnType="attempt int, path array<double>"))
