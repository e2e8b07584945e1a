"""Counting of attempts, replicates, cells and families: every loss is a row, never a silent drop."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import stats


def comparison_status(attempts: DataFrame, keys: list[str]) -> DataFrame:
    """Counts of attempts by status, and p where no attempt failed.  Columns status, statistic, observed."""
    kept = F.when(F.col("status") == "retained", F.col("statistic"))
    n = lambda s: F.count_if(F.col("status") == s)
    p = F.when(n("failed") == 0, stats.mc_pvalue(kept, F.col("observed")))
    status = F.when(n("failed") > 0, "failed").when(n("retained") == 0, "no_draws").otherwise("complete")
    return attempts.groupBy(*keys).agg(n("retained").alias("retained"), n("no_eligible_episode").alias("no_episode"), n("failed").alias("failed"), status.alias("comparison"), p.alias("p"))


def cell_summary(replicates: DataFrame, keys: list[str], requested: Column, alpha: float = 0.05) -> DataFrame:
    """Nominal accounting of cells: saved, available, rejections, bounds with every missing replicate counted either way,
    and rate, standard error, Wilson interval, mean S and its error, all NULL unless the cell is complete."""
    n, k, got = F.col("requested"), F.col("rejected"), F.col("available")
    out = replicates.groupBy(*keys).agg(
        requested.alias("requested"), F.count("*").alias("saved"), F.count("p").alias("available"), F.count_if(F.col("p") <= alpha).alias("rejected"),
        F.avg("S").alias("mean_S"), (F.stddev_samp("S") / F.sqrt(F.count("S"))).alias("se_S"),
    )
    full = got == n
    rate = k / n
    out = out.withColumns({"low_bound": k / n, "high_bound": (k + n - got) / n, "rate": F.when(full, rate), "se": F.when(full, F.sqrt(rate * (1 - rate) / n))})
    w = stats.wilson(k, n)
    return out.withColumns({"wilson_low": F.when(full, w["low"]), "wilson_high": F.when(full, w["high"]), "mean_S": F.when(full, F.col("mean_S")), "se_S": F.when(full, F.col("se_S"))})


def power_summary(cells: DataFrame, target: float = 0.8) -> DataFrame:
    """kappa cells with the change from the cell before, whether it is a clear decrease, and the kappa at which power
    first crosses the target, interpolated (NULL if it never does)."""
    w = Window.partitionBy("sid").orderBy("kappa")
    before, se_before, kappa_before = (F.lag(c).over(w) for c in ("rate", "se", "kappa"))
    out = cells.withColumns({"change": F.col("rate") - before, "decrease": F.col("rate") - before < -1.96 * F.hypot("se", se_before)})
    cross = F.when(F.col("rate") >= target, F.when(before.isNull(), F.col("kappa")).when(before < target, kappa_before + (F.col("kappa") - kappa_before) * (target - before) / (F.col("rate") - before)))
    out = out.withColumn("cross", cross)
    return out.withColumn("kappa_80", F.min_by("cross", F.when(F.col("cross").isNotNull(), F.col("kappa"))).over(Window.partitionBy("sid"))).drop("cross")


def holm_adjust(family: DataFrame, keys: list[str], p: str = "p", name: str = "id") -> DataFrame:
    """Step-down adjusted p values; a missing p counts as 1, ties go by name, results are capped at 1."""
    filled = family.withColumn("_p", F.coalesce(F.col(p), F.lit(1.0)))
    by = Window.partitionBy(*keys).orderBy("_p", name)
    h = F.count("*").over(Window.partitionBy(*keys))
    out = filled.withColumn("_a", (h - F.row_number().over(by) + 1) * F.col("_p"))
    return out.withColumn("adjusted", F.least(F.lit(1.0), F.max("_a").over(by.rowsBetween(Window.unboundedPreceding, 0)))).drop("_p", "_a")


def status_counts(rows: DataFrame, keys: list[str]) -> DataFrame:
    """A map of status to count for each key."""
    n = rows.groupBy(*keys, "status").agg(F.count("*").alias("n"))
    return n.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("status", "n")))).alias("by_status"))


def max_diff(a: DataFrame, b: DataFrame, keys: list[str], value: str) -> DataFrame:
    """One row: the largest absolute difference, differing rows and rows on one side only."""
    both = a.select(*keys, F.col(value).alias("_a")).join(b.select(*keys, F.col(value).alias("_b")), keys, "full")
    d = F.abs(F.col("_a") - F.col("_b"))
    return both.agg(F.max(d).alias("max_diff"), F.count_if(d > 0).alias("differing"), F.count_if(F.col("_a").isNull() | F.col("_b").isNull()).alias("one_sided"))


def journal_check(records: DataFrame, events: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Records without exactly one event, and events without a record."""
    n = events.groupBy(key).agg(F.count("*").alias("n"))
    odd = records.select(key).join(n, key, "left").select(key, F.coalesce("n", F.lit(0)).alias("n_events")).where("n_events <> 1")
    return odd, events.join(records.select(key), key, "left_anti")


def reconcile(left: DataFrame, right: DataFrame, key: str, left_hash: str, right_hash: str) -> DataFrame:
    """key, status: listed, missing, unlisted or changed."""
    a, b = left.select(key, F.col(left_hash).alias("_l")), right.select(key, F.col(right_hash).alias("_r"))
    both = a.withColumn("_a", F.lit(1)).join(b.withColumn("_b", F.lit(1)), key, "full")
    status = F.when(F.col("_b").isNull(), "missing").when(F.col("_a").isNull(), "unlisted").when(F.col("_l").eqNullSafe(F.col("_r")), "listed").otherwise("changed")
    return both.select(key, status.alias("status"))


def next_batch(requested: DataFrame, done: DataFrame, keys: list[str], most: int) -> DataFrame:
    """Coordinates that aren't done yet, at most `most`, in order: saved failures are never run again."""
    return requested.join(done.select(*keys), keys, "left_anti").orderBy(*keys).limit(most)


def disjoint_union(parts: list[DataFrame], keys: list[str]) -> DataFrame:
    """Union of parts by name; a key in two parts stops the query."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    twice = F.assert_true(F.count("*").over(Window.partitionBy(*keys)) == 1, F.lit("a coordinate is in two parts"))
    return out.withColumn("_ok", twice).where("_ok is null").drop("_ok")
