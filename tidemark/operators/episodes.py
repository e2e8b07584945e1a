"""Contraction episodes, and what happens before their onset."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.series import per_series


def runs(series: DataFrame, least: int = 2, x: str = "x") -> DataFrame:
    """sid, onset, fin of maximal runs of strictly negative values of at least `least` positions."""
    neg = series.where(F.col(x) < 0).withColumn("island", F.col("pos") - F.row_number().over(per_series()))
    out = neg.groupBy("sid", "island").agg(F.min("pos").alias("onset"), F.max("pos").alias("fin"), F.count("*").alias("n"))
    return out.where(F.col("n") >= least).select("sid", "onset", "fin")


def episodes(runs_: DataFrame, merge: int = 8) -> DataFrame:
    """sid, episode, onset, fin, runs: a run joins the one before if it starts at most `merge` after its end.  The end of
    an episode is its latest run's end, so comparing with the run before is enough."""
    w = Window.partitionBy("sid").orderBy("onset")
    new = F.when(F.col("onset") - F.lag("fin").over(w) <= merge, 0).otherwise(1)
    marked = runs_.withColumn("new", new).withColumn("episode", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy("sid", "episode").agg(F.min("onset").alias("onset"), F.max("fin").alias("fin"), F.count("*").alias("runs"))


def eligible(eps: DataFrame, window: int = 40, lookback: int = 8) -> DataFrame:
    """Onsets with a full window `lookback` before them."""
    return eps.where(F.col("onset") >= window + lookback)


def excluding_years(eps: DataFrame, first_year: int, ranges: list[tuple[int, int]]) -> DataFrame:
    """Episodes whose onset year is in none of the ranges; applied after merging."""
    year = F.col("onset") + first_year
    out = eps.withColumn("year", year)
    for a, b in ranges:
        out = out.where(~F.col("year").between(a, b))
    return out


def onset_change(eps: DataFrame, metric: DataFrame, value: str = "modulus", lookback: int = 8) -> DataFrame:
    """eps with change = M[onset-1] - M[onset-1-lookback]; NULL where either is missing.  The difference is a window of
    the metric, so one join finds both values."""
    w = per_series()
    before = F.when(F.col("pos") - F.lag("pos", lookback).over(w) == lookback, F.lag(value, lookback).over(w))
    m = metric.select("sid", (F.col("pos") + 1).alias("onset"), (F.col(value) - before).alias("change"))
    return eps.join(m, ["sid", "onset"], "left")


def onset_segment(eps: DataFrame, metric: DataFrame, span: int = 16, value: str = "modulus") -> DataFrame:
    """sid, onset, pos, value of the `span` positions before each onset: a range join turned into an equi join by
    listing the positions."""
    need = eps.select("sid", "onset", F.explode(F.sequence(F.col("onset") - span, F.col("onset") - 1)).alias("pos"))
    return need.join(metric.select("sid", "pos", F.col(value).alias("value")), ["sid", "pos"])


def kendall_taub(segments: DataFrame, span: int = 16) -> DataFrame:
    """sid, onset, tau (b) of value against position in whole segments; NULL for a constant one."""
    a, b = segments.alias("a"), segments.alias("b")
    pairs = a.join(b, (F.col("a.sid") == F.col("b.sid")) & (F.col("a.onset") == F.col("b.onset")) & (F.col("a.pos") < F.col("b.pos")))
    s = F.signum(F.col("b.value") - F.col("a.value"))
    out = pairs.groupBy(F.col("a.sid").alias("sid"), F.col("a.onset").alias("onset")).agg(F.sum(s).alias("s"), F.sum((s == 0).cast("long")).alias("ties"), F.count("*").alias("pairs"))
    n0 = F.lit(span * (span - 1) / 2)
    return out.where(F.col("pairs") == n0).select("sid", "onset", F.when(F.col("ties") < n0, F.col("s") / F.sqrt(n0 * (n0 - F.col("ties")))).alias("tau"))


def pre_onset_summary(changes: DataFrame) -> DataFrame:
    """sid, S (mean change, NULL if none), k_pos, eligible onsets and changes in order of onset."""
    known = F.collect_list(F.when(F.col("change").isNotNull(), F.struct("onset", "change")))
    out = changes.groupBy("sid").agg(F.avg("change").alias("S"), F.count_if(F.col("change") > 0).alias("k_pos"), F.array_sort(known).alias("k"))
    return out.select("sid", "S", "k_pos", F.col("k.onset").alias("onsets"), F.col("k.change").alias("changes"))


def territory_flags(eps: DataFrame, stretches: DataFrame) -> DataFrame:
    """eps with the territories that overlap [first, last], and whether there are several.  The stretches are a small
    fixed table, broadcast as a literal list of its caller."""
    hit = eps.join(stretches, (F.col("start") <= F.col("last")) & (F.col("stop") >= F.col("first")), "left")
    out = hit.groupBy("sid", "onset").agg(F.array_sort(F.collect_list("territory")).alias("territories"))
    return out.withColumn("crosses_boundary", F.size("territories") > 1)
