"""Level and growth series in long form: (sid, pos, ...).  Every window is partitioned by series, so a panel of any
number of series spreads over the cluster."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


class ContractError(ValueError):
    """Input that breaks a series contract; nothing is coerced."""


def per_series(sid: str = "sid", pos: str = "pos"):
    return Window.partitionBy(sid).orderBy(pos)


def levels(events: DataFrame, sid: Column, at: Column, value: Column, bucket: str) -> DataFrame:
    """Exact sums by series and calendar bucket, numbered from 0; the last bucket, which may be partial, is dropped.
    The sum is decimal, so it doesn't depend on the order of rows."""
    sums = events.groupBy(sid.alias("sid"), F.date_trunc(bucket, at).alias("bucket")).agg(F.sum(value.cast("decimal(18,2)")).cast("double").alias("y"))
    last = sums.agg(F.max("bucket").alias("last"))  # over the sums, whose shuffle is reused: no second pass over events
    w = Window.partitionBy("sid").orderBy("bucket")
    return sums.join(F.broadcast(last), sums.bucket < F.col("last")).select("sid", "bucket", (F.row_number().over(w) - 1).cast("long").alias("pos"), "y")  # one row


def growth(series: DataFrame, scale: float = 400.0, y: str = "y") -> DataFrame:
    """scale * difference of logs; the first observation is dropped and positions start at 0 again."""
    x = F.lit(scale) * (F.log(y) - F.log(F.lag(y).over(per_series())))
    return series.withColumn("x", x).where("x is not null").withColumn("pos", F.col("pos") - 1)


def difference(series: DataFrame, u: str = "u") -> DataFrame:
    return series.withColumn("du", F.col(u) - F.lag(u).over(per_series())).where("du is not null")


def lags(series: DataFrame, k: int = 2, x: str = "x") -> DataFrame:
    """Design rows (x, l1, ..., lk); the first k rows of a series have none."""
    w = per_series()
    out = series.withColumns({f"l{j}": F.lag(x, j).over(w) for j in range(1, k + 1)})
    return out.where(f"l{k} is not null")


def slice_contiguous(series: DataFrame, first: int, last: int) -> DataFrame:
    """Positions first..last; a series without all of them stops."""
    out = series.where(F.col("pos").between(first, last))
    whole = F.count("pos").over(Window.partitionBy("sid"))
    fine = F.assert_true(whole == last - first + 1, F.concat(F.lit("not contiguous: series "), F.col("sid").cast("string")))
    return out.withColumn("ok", fine).where("ok is null").drop("ok")


def check_contiguous(series: DataFrame, pos: str = "pos") -> DataFrame:
    """Positions in each series that don't follow their predecessor by one."""
    step = F.col(pos) - F.lag(pos).over(per_series(pos=pos))
    return series.withColumn("step", step).where("step <> 1")


def check_positive(series: DataFrame, y: str = "y") -> DataFrame:
    """Rows whose level is missing, not finite or not positive."""
    return series.where(F.col(y).isNull() | F.isnan(y) | (F.abs(y) == float("inf")) | (F.col(y) <= 0))


def stop_if_any(bad: DataFrame, what: str) -> None:
    row = bad.limit(1).collect()
    if row:
        raise ContractError(f"{what}: {row[0].asDict()}")
