"""The rolling fit with typed state: a list of the last values, a record of the open run, a timer for keys that fall silent, and a
start from what the batch has.  And runs of contraction as session windows.

Needs the RocksDB state store (`use_rocksdb`).  Output rows of the fit are those of the batch operator for every observation that
the state has not seen; a key without observations for `idle` of event time gives one row of status `expired`, with the number
of values it held, and its state is gone."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

OUT = "sid string, pos long, x double, modulus double, status string, event string, onset long"
START = "sid string, pos long, items array<double>, run_onset long, run_length long, last_end long"
NEVER = -(10**9)


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class RollingState(StatefulProcessor):
    def __init__(self, window: int, least: int, merge: int, idle_ms: int):
        self.window, self.least, self.merge, self.idle_ms = window, least, merge, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.items = handle.getListState("items", "x double")
        self.run = handle.getValueState("run", "pos long, onset long, length long, last_end long, alarm long")

    def _wait(self, alarm: int, seen: int) -> int:
        """A timer behind the last observation; the one before goes."""
        later = seen + self.idle_ms
        if later <= alarm:
            return alarm
        if alarm > 0:
            self.handle.deleteTimer(alarm)
        self.handle.registerTimer(later)
        return later

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        from tidemark.kernels import ar

        pos, onset, length, end, alarm = self.run.get() if self.run.exists() else (-1, -1, 0, NEVER, 0)
        items = [v[0] for v in self.items.get()] if self.items.exists() else []
        out, seen = [], 0
        for r in pd.concat(list(rows)).sort_values("pos").itertuples():
            p, x = int(r.pos), float(r.x)
            seen = max(seen, int(pd.Timestamp(r.at).timestamp() * 1000))
            if (pos >= 0 and p != pos + 1) or not np.isfinite(x):
                out.append((key[0], p, x, None, "stopped", None, None))
                continue
            pos, items = p, [*items, x][-self.window :]
            m, status, event, told = None, "warmup", None, None
            if len(items) == self.window:
                p1, p2, _ = ar.fit(np.array([items]))
                got = float(ar.modulus(p1, p2)[0])
                m, status = (got, "ok") if np.isfinite(got) else (None, "failed")
            onset, length = (p if length == 0 else onset, length + 1) if x < 0 else (-1, 0)
            if length >= self.least:
                if length == self.least and onset - end > self.merge:
                    event, told = "onset", onset
                end = p
            out.append((key[0], p, x, m, status, event, told))
        self.items.put([(v,) for v in items])
        self.run.update((pos, onset, length, end, self._wait(alarm, seen)))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in OUT.split(", ")]).astype({"onset": "Int64"})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        pos = self.run.get()[0] if self.run.exists() else -1
        held = sum(1 for _ in self.items.get()) if self.items.exists() else 0
        self.items.clear()
        self.run.clear()
        yield pd.DataFrame([(key[0], pos, float(held), None, "expired", None, None)], columns=[c.split()[0] for c in OUT.split(", ")]).astype({"onset": "Int64", "modulus": "float64"})

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        r = initialState.iloc[0]
        self.items.put([(float(v),) for v in r["items"]])
        self.run.update((int(r["pos"]), int(r["run_onset"]), int(r["run_length"]), int(r["last_end"]), 0))

    def close(self) -> None:
        pass


def state_of(series: DataFrame, window: int = 40, least: int = 2) -> DataFrame:
    """What the state is after a batch series (sid, pos, x): START rows.  Arrays hold one window."""
    w = Window.partitionBy("sid").orderBy("pos")
    signed = series.withColumn("break", F.last(F.when(F.col("x") >= 0, F.col("pos")), True).over(w))
    first = F.min("pos").over(Window.partitionBy("sid"))
    signed = signed.withColumn("length", F.when(F.col("x") < 0, F.col("pos") - F.coalesce("break", first - 1)).otherwise(0))
    held = signed.withColumn("items", F.collect_list("x").over(w.rowsBetween(1 - window, 0))).withColumn("last_end", F.max(F.when(F.col("length") >= least, F.col("pos"))).over(w))
    last = held.groupBy("sid").agg(F.max_by(F.struct("pos", "items", "length", "last_end"), "pos").alias("s")).select("sid", "s.*")
    onset = F.when(F.col("length") > 0, F.col("pos") - F.col("length") + 1).otherwise(-1)
    return last.select("sid", "pos", "items", onset.cast("long").alias("run_onset"), F.col("length").cast("long").alias("run_length"), F.coalesce("last_end", F.lit(NEVER)).cast("long").alias("last_end"))


def rolling_state(series: DataFrame, start: DataFrame | None = None, window: int = 40, least: int = 2, merge: int = 8, delay: str = "0 seconds", idle_ms: int = 10**15) -> DataFrame:
    """OUT rows for a stream of (sid, pos, at, x), at being the event time.  `start` (state_of a batch series) goes before the
    stream's first row.  A gap or a repeated position gives a row with status 'stopped' and leaves the state as it was."""
    use_rocksdb(series.sparkSession)
    grouped = series.withWatermark("at", delay).groupBy("sid")
    return grouped.transformWithStateInPandas(
        RollingState(window, least, merge, idle_ms), OUT, "append", "eventTime", initialState=None if start is None else start.groupBy("sid"))


def contractions(series: DataFrame, gap: str = "14 days", delay: str = "0 seconds") -> DataFrame:
    """sid, begins, ends, n, total of runs of negative growth in (sid, at, x), stream or batch: observations at most `gap` apart are
    one session, which is told once the watermark has passed its end."""
    s = series.withWatermark("at", delay) if series.isStreaming else series
    w = s.where("x < 0").groupBy("sid", F.session_window("at", gap).alias("w")).agg(F.count("*").alias("n"), F.sum("x").alias("total"), F.max("at").alias("ends"))
    return w.select("sid", F.col("w.start").alias("begins"), "ends", "n", "total")
