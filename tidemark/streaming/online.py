"""Structured Streaming forms of the causal operators.

levels_stream: watermarked tumbling windows give levels; rows later than the watermark are dropped by Spark and counted
by `LateRows`, never silently.  rolling_stream: keyed state holds the last window of values
and the open run, so each new observation emits its root modulus and, when it happens, the onset of an episode; on any
prefix it emits what the batch operator gives."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "sid string, pos long, x double, modulus double, status string, event string, onset long"
STATE = "pos long, values array<double>, run_onset long, run_length long, last_end long, episode long"


def levels_stream(events: DataFrame, sid: str, at: str, value: str, width: str = "1 hour", delay: str = "2 hours") -> DataFrame:
    """sid, start, y of tumbling windows, emitted once the watermark has passed them."""
    w = events.withWatermark(at, delay).groupBy(F.col(sid).cast("string").alias("sid"), F.window(at, width))
    return w.agg(F.sum(value).alias("y")).select("sid", F.col("window.start").alias("start"), "y")


class LateRows(StreamingQueryListener):
    """Rows dropped behind the watermark, by query: every batch is counted as it ends (a query itself keeps only its last
    hundred).  spark.streams.addListener(late) before the query starts."""

    def __init__(self):
        self.rows: Counter[str] = Counter()

    def onQueryStarted(self, event):
        pass

    def onQueryProgress(self, event):
        self.rows[str(event.progress.id)] += sum(s.numRowsDroppedByWatermark for s in event.progress.stateOperators)

    def onQueryTerminated(self, event):
        pass

    def count(self, query) -> int:
        return self.rows[str(query.id)]


def rolling_stream(series: DataFrame, window: int = 40, least: int = 2, merge: int = 8) -> DataFrame:
    """OUT rows for a stream of (sid, pos, x).  Positions of a series must come in order across batches; within a batch
    they are sorted.  A gap or a repeated position gives a row with status 'stopped' and leaves the state as it was."""
    from tidemark.kernels import ar

    def step(key, frames: Iterator[pd.DataFrame], state: GroupState):
        pos, values, onset, length, end, episode = state.get if state.exists else (-1, [], -1, 0, -(10**9), -1)
        values = list(values)
        rows = []
        for r in pd.concat(list(frames)).sort_values("pos").itertuples():
            p, x = int(r.pos), float(r.x)
            if (pos >= 0 and p != pos + 1) or not np.isfinite(x):
                rows.append((key[0], p, x, None, "stopped", None, None))
                continue
            pos = p
            values = [*values, x][-window:]
            m, status, event, told = None, "warmup", None, None
            if len(values) == window:
                p1, p2, _ = ar.fit(np.array([values]))
                got = float(ar.modulus(p1, p2)[0])
                m, status = (got, "ok") if np.isfinite(got) else (None, "failed")
            if x < 0:
                onset, length = (p, 1) if length == 0 else (onset, length + 1)
                if length >= least:
                    if length == least and onset - end > merge:
                        event, told, episode = "onset", onset, onset
                    end = p
            else:
                length = 0
            rows.append((key[0], p, x, m, status, event, told))
        state.update((pos, values, onset, length, end, episode))
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in OUT.split(", ")]).astype({"onset": "Int64"})

    return series.groupBy("sid").applyInPandasWithState(step, OUT, STATE, "append", GroupStateTimeout.NoTimeout)
