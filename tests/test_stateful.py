"""Typed state: restarts, a start from the batch, silent keys; session windows as a stream."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import fits
from tidemark.streaming import stateful

DAY0 = dt.datetime(2020, 1, 1)


def rows(n=70, keys=("a", "b")):
    rng = np.random.default_rng(2)
    return [(k, t, DAY0 + dt.timedelta(days=t), float(x)) for k in keys for t, x in enumerate(rng.normal(0.1, 1, n))]


SCHEMA = "sid string, pos long, at timestamp, x double"


def run(df, sink, state):
    df.writeStream.format("parquet").option("path", sink).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()


def collected(spark, sink):
    return sorted((r.sid, r.pos, None if r.modulus is None else round(r.modulus, 9), r.status, r.event, r.onset) for r in spark.read.schema(stateful.OUT).parquet(sink).collect())


def test_restart_and_start_from_the_batch(spark, tmp_path):
    data = spark.createDataFrame(rows(), SCHEMA)
    batch = {(r.sid, r.pos): round(r.modulus, 9) for r in fits.rolling_ar2(data.select("sid", "pos", "x")).collect()}
    src, sink, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    stream = lambda start=None: stateful.rolling_state(spark.readStream.schema(SCHEMA).parquet(src), start)
    for lo, hi in ((0, 25), (25, 55), (55, 70)):  # a new query from the checkpoint each time
        data.where(f"pos >= {lo} and pos < {hi}").write.mode("append").parquet(src)
        run(stream(), sink, state)
    whole = collected(spark, sink)
    assert len(whole) == 140 and {(s, p): m for s, p, m, status, *_ in whole if status == "ok"} == pytest.approx(batch)
    src2, sink2, state2 = (str(tmp_path / n) for n in ("in2", "out2", "state2"))
    data.where("pos >= 50").write.parquet(src2)
    run(stateful.rolling_state(spark.readStream.schema(SCHEMA).parquet(src2), stateful.state_of(data.where("pos < 50"))), sink2, state2)
    assert collected(spark, sink2) == [r for r in whole if r[1] >= 50]


def test_a_silent_key_expires_and_is_counted(spark, tmp_path):
    src, sink, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    data = spark.createDataFrame(rows(), SCHEMA)
    stream = lambda: stateful.rolling_state(spark.readStream.schema(SCHEMA).parquet(src), idle_ms=10 * 86_400_000)
    data.where("sid = 'a' or pos < 5").coalesce(1).write.parquet(src)
    run(stream(), sink, state)
    data.limit(0).unionByName(spark.createDataFrame([("a", 70, DAY0 + dt.timedelta(days=71), 1.0)], SCHEMA)).write.mode("append").parquet(src)
    run(stream(), sink, state)
    gone = [r for r in collected(spark, sink) if r[3] == "expired"]
    assert gone == [("b", 4, None, "expired", None, None)]
    assert spark.read.schema(stateful.OUT).parquet(sink).where("status = 'expired'").first().x == 5.0


def test_sessions_stream_as_the_batch(spark, tmp_path):
    src, sink, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    data = spark.createDataFrame(rows() + [(k, 999, DAY0 + dt.timedelta(days=400), -1.0) for k in "ab"], SCHEMA)
    data.write.parquet(src)
    out = stateful.contractions(spark.readStream.schema(SCHEMA).parquet(src), "36 hours")
    out.writeStream.outputMode("append").format("parquet").option("path", sink).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    key = lambda df: sorted((r.sid, r.begins, r.ends, r.n, round(r.total, 9)) for r in df.collect())
    want = key(stateful.contractions(data, "36 hours"))
    assert key(spark.read.parquet(sink)) == [r for r in want if r[1].year == 2020 and r[1] < dt.datetime(2020, 6, 1)] and max(r[3] for r in want) > 1
    assert data.where(F.col("x") < 0).count() == sum(r[3] for r in want)
