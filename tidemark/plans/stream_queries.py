"""Streams with typed state and session windows, against the batch."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.plans import base as b
from tidemark.plans.catalogue import query
from tidemark.sources import shared

G, L = b.sql_levels(), b.SQL_LAGS


def _dated(spark, d):
    """Weekly growth with its week as event time."""
    from tidemark.operators import series

    return series.growth(b.weekly_levels(spark, d)).select("sid", "pos", F.col("bucket").alias("at"), "x")


@query(f"with {G}, {L}, {b.sql_fit()} select sid, pos, round(m, 6) modulus from mm where pos >= 150")
def stream_typed_state(spark, d):
    """The batch until position 149 becomes the state from which the stream goes on: its rows are the batch's."""
    from tidemark.streaming import stateful

    src, sink, at = (shared.new_path(spark, n) for n in ("typed-in", "typed-out", "typed-state"))
    rows = shared.written(_dated(spark, d), "dated")
    rows.where("pos >= 150").write.parquet(src)
    start = stateful.state_of(rows.where("pos < 150"))
    out = stateful.rolling_state(spark.readStream.schema(rows.schema).parquet(src), start)
    out.writeStream.format("parquet").option("path", sink).option("checkpointLocation", at).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stateful.OUT).parquet(sink).where("status = 'ok'").select("sid", "pos", F.round("modulus", 6).alias("modulus"))


@query(f"""with {G}, n as (select sid, bucket, x, case when bucket - lag(bucket) over (partition by sid order by bucket) <= interval 14 day then 0 else 1 end fresh from g where x < 0),
s as (select *, sum(fresh) over (partition by sid order by bucket rows unbounded preceding) k from n)
select sid, cast(min(bucket) as varchar) begins, cast(max(bucket) as varchar) as ends, count(*) n, round(sum(x), 3) total from s group by sid, k""")
def session_runs(spark, d):
    """Weeks of negative growth a fortnight apart at most, as sessions."""
    from tidemark.streaming import stateful

    text = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return stateful.contractions(_dated(spark, d)).select("sid", text("begins"), text("ends"), "n", F.round("total", 3).alias("total"))
