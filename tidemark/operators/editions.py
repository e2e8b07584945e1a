"""Editions of a dataset from saved pages: several records of one edition become agreed, conflicting or absent, and the latest
edition that was out at an instant is found, or why none can be named.

pages: listing, page, release_day, next_day (null if not stated).  entries: listing, page, position (from 1), label, files.
calendar: listing, day, minute (of the day in London; null if not stated), published, lists_dataset.  asked: listing, ask, at (an
instant).  Labels are one edition if they agree in lower case with single spaces.  Days are days of London."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ZONE = "Europe/London"


def edition_key(label: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(label, r"\s+", " ")))


def instant(day: Column, minute: Column) -> Column:
    """The instant of a local minute: London's summer time applies."""
    return F.to_utc_timestamp(F.timestamp_seconds(F.unix_date(day) * 86400 + minute * 60), ZONE)


def merged(values: Column, rows: str) -> tuple[Column, Column]:
    """One value that all records agree on, and what they are: agreed, conflicting or absent."""
    n = F.count_distinct(values)
    return F.when(n == 1, F.min(values)), F.when(n == 1, "agreed").when(n > 1, "conflicting").otherwise("absent").alias(rows)


def evidence(pages: DataFrame, entries: DataFrame, calendar: DataFrame) -> DataFrame:
    """listing, edition, day, day_status, minute, minute_status, n_files, opens, closes: each edition with the half-open span of
    instants in which it came out.  A page dates only the edition that it lists first; a calendar record of that day gives
    the minute, if it is published and lists the dataset."""
    e = entries.withColumn("edition", edition_key(F.col("label")))
    own = e.where("position = 1").join(pages, ["listing", "page"]).select("listing", "edition", "release_day")
    day, day_status = merged(F.col("release_day"), "day_status")
    dated = own.groupBy("listing", "edition").agg(day.alias("day"), day_status)
    listed = e.groupBy("listing", "edition").agg(F.max("files").alias("n_files")).join(dated, ["listing", "edition"], "left").withColumn("day_status", F.coalesce("day_status", F.lit("absent")))
    timed = calendar.where("published and lists_dataset and minute is not null").select("listing", "day", "minute")
    minute, minute_status = merged(F.col("minute"), "minute_status")
    out = listed.join(timed.groupBy("listing", "day").agg(minute.alias("minute"), minute_status), ["listing", "day"], "left")
    start = F.when(F.col("minute").isNotNull(), instant(F.col("day"), F.col("minute"))).otherwise(instant(F.col("day"), F.lit(0)))
    end = F.when(F.col("minute").isNotNull(), start + F.expr("interval 1 minute")).otherwise(instant(F.date_add("day", 1), F.lit(0)))
    return out.select("listing", "edition", "day", "day_status", "minute", F.coalesce("minute_status", F.lit("absent")).alias("minute_status"), "n_files", start.alias("opens"), end.alias("closes"))


def judged(found: DataFrame, asked: DataFrame) -> DataFrame:
    """Every edition of a listing at every instant asked: out (before it), later, within (the span holds the instant, so it can't
    be told) or undated."""
    j = found.join(asked, "listing")  # an instant meets the editions of its own listing
    state = F.when(F.col("day").isNull(), "undated").when(F.col("closes") <= F.col("at"), "out").when(F.col("opens") >= F.col("at"), "later").otherwise("within")
    return j.withColumn("state", state)


def resolve(pages: DataFrame, entries: DataFrame, calendar: DataFrame, asked: DataFrame) -> DataFrame:
    """listing, ask, edition, day, outcome, complete, n_out, n_later, n_within, n_undated.

    Outcome: selected; none (no edition is out); tie (several share the latest day); files (the latest hasn't exactly one).
    Complete: no later edition can have been out, as a page that lists the selected one first announces the next for
    the instant's day or a later one, or the edition listed just above it on the listing's latest page is later."""
    found = evidence(pages, entries, calendar)
    j = judged(found, asked)
    latest = F.max(F.when(F.col("state") == "out", F.col("day"))).over(Window.partitionBy("listing", "ask"))
    j = j.withColumn("latest", latest).withColumn("top", F.coalesce((F.col("state") == "out") & (F.col("day") == F.col("latest")), F.lit(False)))
    count = lambda s: F.count_if(F.col("state") == s).alias(f"n_{s}")
    out = j.groupBy("listing", "ask", "at").agg(F.count_if("top").alias("tops"), F.min(F.when(F.col("top"), F.col("edition"))).alias("edition"), F.min(F.when(F.col("top"), F.col("day"))).alias("day"), F.min(F.when(F.col("top"), F.col("n_files"))).alias("n_files"), *(count(s) for s in ("out", "later", "within", "undated")))
    outcome = F.when(F.col("tops") == 0, "none").when(F.col("tops") > 1, "tie").when(F.col("n_files") != 1, "files").otherwise("selected")
    out = out.withColumn("outcome", outcome)
    picked = lambda c: F.when(F.col("outcome") == "selected", F.col(c)).alias(c)
    out = out.select("listing", "ask", "at", picked("edition"), picked("day"), "outcome", "n_out", "n_later", "n_within", "n_undated")
    e = entries.withColumn("edition", edition_key(F.col("label")))
    announced = e.where("position = 1").join(pages.where("next_day is not null"), ["listing", "page"]).groupBy("listing", "edition").agg(F.max("next_day").alias("next_day"))
    newest = pages.groupBy("listing").agg(F.max(F.struct(F.coalesce("release_day", F.lit("0001-01-01").cast("date")).alias("d"), "page"))["page"].alias("page"))
    above = e.join(newest, ["listing", "page"]).groupBy("listing", "edition").agg(F.min("position").alias("position"))
    higher = above.select("listing", (F.col("position") + 1).alias("position"), F.col("edition").alias("above"))
    above = above.join(higher, ["listing", "position"], "left").select("listing", "edition", "above")
    later = j.where("state = 'later'").select("listing", "ask", F.col("edition").alias("above"), F.lit(True).alias("after"))
    out = out.join(announced, ["listing", "edition"], "left").join(above, ["listing", "edition"], "left").join(later, ["listing", "ask", "above"], "left")
    complete = F.coalesce(instant(F.col("next_day"), F.lit(0)) >= F.col("at"), F.lit(False)) | F.coalesce("after", F.lit(False))
    return out.select("listing", "ask", "edition", "day", "outcome", (F.col("outcome").eqNullSafe("selected") & complete).alias("complete"), "n_out", "n_later", "n_within", "n_undated")
