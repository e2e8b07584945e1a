"""Resume with inputs made anew: what was computed is taken over only if its input still is what it was.

inputs: key..., input (any columns, folded into one hash by `input_hash`).  ledger: key..., input_sha256, status, and results.  A saved
failure is a result: it is not run again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.series import stop_if_any


def input_hash(rows: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """key..., n, input_sha256 of each key's rows as a set with repeats: two 64-bit hashes of a row are summed exactly, so the order
    of rows doesn't count and a key of any size is a partial aggregate."""
    text = F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"})
    one, two = F.xxhash64(text).cast("decimal(38,0)"), F.xxhash64(F.lit("second"), text).cast("decimal(38,0)")
    sums = rows.groupBy(*key).agg(F.count("*").alias("n"), F.sum(one).alias("s1"), F.sum(two).alias("s2"))
    return sums.select(*key, "n", F.sha2(F.concat_ws("|", F.col("n").cast("string"), F.col("s1").cast("string"), F.col("s2").cast("string")), 256).alias("input_sha256"))


def decide(wanted: DataFrame, ledger: DataFrame, key: list[str]) -> DataFrame:
    """key..., input_sha256, stored_sha256, status, action for every key that is wanted or stored: run (nothing is stored), keep (the
    stored input is the same), quarantine (it is another), orphan (stored, but not wanted).  A key that is stored twice stops."""
    stop_if_any(ledger.groupBy(*key).agg(F.count("*").alias("times")).where("times > 1"), "the ledger holds a coordinate twice")
    held = ledger.select(*key, F.col("input_sha256").alias("stored_sha256"), "status")
    both = wanted.select(*key, "input_sha256").join(held, key, "full")
    action: Column = (
        F.when(F.col("input_sha256").isNull(), "orphan").when(F.col("stored_sha256").isNull(), "run")
        .when(F.col("input_sha256") == F.col("stored_sha256"), "keep").otherwise("quarantine")
    )
    return both.withColumn("action", action)


def resume(rows: DataFrame, ledger: DataFrame, key: list[str], columns: list[str], compute: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(ledger, quarantine).  `compute` gets the rows of the keys that nothing is stored for, and returns key..., status and results
    as the ledger has them; its rows join those that are kept.  Quarantined keys leave the ledger, with both hashes."""
    what = decide(input_hash(rows, key, columns), ledger, key)
    todo = rows.join(what.where("action = 'run'").select(*key), key, "left_semi")
    made = compute(todo).join(what.select(*key, "input_sha256"), key).select(*ledger.columns)
    kept = ledger.join(what.where("action = 'keep'").select(*key), key, "left_semi")
    return kept.unionByName(made), what.where("action = 'quarantine'").select(*key, "stored_sha256", "input_sha256", "status")
