"""Review by a second route: the same quantities by other algorithms, and a full comparison of every row.

Rolling fits come again from running totals of raw products, solved by Cramer's rule; surrogate attempts come again from their
paths as rows, by runs, episodes and windowed moments over sets.  What is compared is every row of both sides: integers and
texts exactly, numbers to 1e-12 + 1e-9 of the second."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import roots
from tidemark.operators import episodes as ep
from tidemark.operators import fits
from tidemark.operators.series import lags, per_series

ABSOLUTE, RELATIVE = 1e-12, 1e-9


def close_to(a: Column, b: Column) -> Column:
    both = a.isNotNull() & b.isNotNull()
    return F.when(both, (F.isnan(a) & F.isnan(b)) | (F.abs(a - b) <= ABSOLUTE + RELATIVE * F.abs(b))).otherwise(a.isNull() & b.isNull())


def compare(first: DataFrame, second: DataFrame, keys: list[str], exact: list[str] = (), close: list[str] = ()) -> DataFrame:
    """keys..., verdict, columns: a row for every key of either side.  Verdict is same, differs (with the columns that do),
    only_first or only_second.  Nulls are equal to nulls only."""
    a = first.select(*keys, F.struct(*exact, *close).alias("a"))
    b = second.select(*keys, F.struct(*exact, *close).alias("b"))
    odd = [F.when(~F.col("a")[c].eqNullSafe(F.col("b")[c]), F.lit(c)) for c in exact] + [F.when(~close_to(F.col("a")[c], F.col("b")[c]), F.lit(c)) for c in close]
    both = a.join(b, keys, "full").withColumn("columns", F.array_compact(F.array(*odd)))
    verdict = F.when(F.col("b").isNull(), "only_first").when(F.col("a").isNull(), "only_second").when(F.size("columns") > 0, "differs").otherwise("same")
    return both.select(*keys, verdict.alias("verdict"), F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), F.col("columns")).alias("columns"))


def rolling_by_totals(series: DataFrame, window: int = 40) -> DataFrame:
    """sid, pos, phi1, phi2, modulus of every full window.  Products of values less their series' mean are summed from the start;
    a window's are the difference of two totals; three unknowns are three ratios of determinants."""
    whole = Window.partitionBy("sid")
    own = series.withColumn("x", F.col("x") - F.avg("x").over(whole))
    rows = lags(own)
    w = per_series().rowsBetween(Window.unboundedPreceding, 0)
    products = {"n": F.lit(1.0), "a": F.col("l1"), "b": F.col("l2"), "y": F.col("x"), "aa": F.col("l1") * F.col("l1"), "ab": F.col("l1") * F.col("l2"), "bb": F.col("l2") * F.col("l2"), "ay": F.col("l1") * F.col("x"), "by": F.col("l2") * F.col("x")}
    totals = rows.select("sid", "pos", *(F.sum(p).over(w).alias(k) for k, p in products.items()))
    before = {k: F.coalesce(F.lag(k, window - 2).over(per_series()), F.lit(0.0)) for k in products}
    s = totals.select("sid", "pos", *((F.col(k) - v).alias(k) for k, v in before.items())).where(F.col("n") == window - 2)
    c = {k: F.col(k) for k in products}

    def det(m):
        (p, q, r), (t, u, v), (x, y, z) = m
        return p * (u * z - v * y) - q * (t * z - v * x) + r * (t * y - u * x)

    base = det([[c["n"], c["a"], c["b"]], [c["a"], c["aa"], c["ab"]], [c["b"], c["ab"], c["bb"]]])
    one = det([[c["n"], c["y"], c["b"]], [c["a"], c["ay"], c["ab"]], [c["b"], c["by"], c["bb"]]])
    two = det([[c["n"], c["a"], c["y"]], [c["a"], c["aa"], c["ay"]], [c["b"], c["ab"], c["by"]]])
    out = s.select("sid", "pos", F.try_divide(one, base).alias("phi1"), F.try_divide(two, base).alias("phi2"))
    return out.withColumn("modulus", roots.root_modulus("phi1", "phi2"))


def attempts_by_sets(paths: DataFrame, window: int = 40, lookback: int = 8, least: int = 2, merge: int = 8) -> DataFrame:
    """sid, number, status, n_onsets, statistic of every attempt, from its path (sid, number, path): each path is a series of its own
    in one plan."""
    rows = paths.select(F.concat_ws("\x1f", "sid", F.col("number").cast("string")).alias("sid"), F.posexplode("path").alias("pos", "x")).withColumn("pos", F.col("pos").cast("long"))
    eps = ep.eligible(ep.episodes(ep.runs(rows, least), merge), window, lookback)
    changes = ep.onset_change(eps, fits.rolling_ar2(rows, window), lookback=lookback)
    s = changes.groupBy("sid").agg(F.count("*").alias("n_onsets"), F.count("change").alias("known"), F.avg("change").alias("statistic"))
    every = paths.select("sid", "number", F.concat_ws("\x1f", "sid", F.col("number").cast("string")).alias("key"))
    out = every.join(s.withColumnRenamed("sid", "key"), "key", "left")
    status = F.when(F.col("n_onsets").isNull(), "no_episode").when(F.col("known") == F.col("n_onsets"), "retained").otherwise("failed")
    return out.select("sid", "number", status.alias("status"), F.coalesce("n_onsets", F.lit(0)).alias("n_onsets"), F.when(status == "retained", F.col("statistic")).alias("statistic"))
