"""An append-only, checksummed store of replicate records: Parquet by cell, a manifest, and a journal.

A batch is staged, then its records and its journal rows are appended; it writes only coordinates that the store lacks, and
one that holds a coordinate twice is refused.  One writer at a time: a lock file refuses the second (`unlock` after a
writer that died; `recover` then tells the journal of records that it lacks).  verify() recomputes every checksum and matches
records and journal one to one.  A manifest with other content refuses to open."""

from __future__ import annotations

import hashlib
import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import accounting
from tidemark.operators.series import ContractError, stop_if_any


def canonical(value) -> str:
    """JSON with sorted keys and no spaces; NaN and infinities are refused."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), allow_nan=False)


def checksum(columns: list[str]) -> Column:
    """SHA-256 of a row's JSON with the columns in sorted order."""
    return F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}), 256)


class ReplicateStore:
    def __init__(self, spark: SparkSession, path: str, manifest: dict):
        self.spark, self.path = spark, path.rstrip("/")
        self.manifest = hashlib.sha256(canonical(manifest).encode()).hexdigest()
        held = self._read("manifest")
        if held is None:
            row = spark.createDataFrame([(canonical(manifest), self.manifest)], "content string, sha256 string")
            row.coalesce(1).write.mode("errorifexists").json(f"{self.path}/manifest")
        elif held.select("sha256").first()[0] != self.manifest:
            raise ContractError("the store has another manifest")

    def _at(self, part: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{part}")
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def _read(self, part: str) -> DataFrame | None:
        fs, at = self._at(part)
        if not fs.exists(at):
            return None
        return self.spark.read.json(f"{self.path}/{part}", schema="content string, sha256 string") if part == "manifest" else self.spark.read.parquet(f"{self.path}/{part}")

    @property
    def records(self) -> DataFrame | None:
        return self._read("records")

    def put(self, rows: DataFrame, keys: tuple[str, ...] = ("cell", "replicate")) -> int:
        """Append the rows whose coordinates are new; returns how many."""
        fs, lock = self._at("writing")
        if not fs.createNewFile(lock):
            raise ContractError("another writer holds the store")
        try:
            held = self.records
            fresh = rows if held is None else rows.join(held.select(*keys), list(keys), "left_anti").select(*rows.columns)
            fresh = fresh.withColumn("sha256", checksum(rows.columns)).withColumn("manifest", F.lit(self.manifest))
            stage = f"{self.path}/staged-{uuid.uuid4().hex}"
            fresh.write.parquet(stage)
            staged = self.spark.read.schema(fresh.schema).parquet(stage)
            stop_if_any(staged.groupBy(*keys).count().where("count > 1"), "a batch holds a coordinate twice")
            n = staged.count()
            staged.write.mode("append").partitionBy("cell").parquet(f"{self.path}/records")
            staged.select(*keys, "sha256", F.lit("saved").alias("kind")).write.mode("append").parquet(f"{self.path}/journal")
            fs.delete(self._at(stage.removeprefix(f"{self.path}/"))[1], True)
            return n
        finally:
            fs.delete(lock, False)

    def unlock(self) -> None:
        fs, lock = self._at("writing")
        fs.delete(lock, False)

    def recover(self, keys: tuple[str, ...] = ("cell", "replicate")) -> None:
        """Journal rows for records that have none."""
        journal = self._read("journal")
        told = self.records.select(*keys, "sha256")
        told = told if journal is None else told.join(journal.select(*keys), list(keys), "left_anti")
        told.select(*keys, "sha256", F.lit("saved").alias("kind")).write.mode("append").parquet(f"{self.path}/journal")

    def verify(self, keys: tuple[str, ...] = ("cell", "replicate")) -> dict:
        """Counts of records, of wrong checksums, of records without exactly one journal row, and of orphans."""
        rec, journal = self.records, self._read("journal")
        own = [c for c in rec.columns if c not in ("sha256", "manifest")]
        wrong = rec.where(checksum(own) != F.col("sha256")).count()
        name = lambda df: df.withColumn("unit", F.concat_ws("/", *keys))
        odd, orphans = accounting.journal_check(name(rec), name(journal), "unit")
        return {"records": rec.count(), "wrong": wrong, "odd": odd.count(), "orphans": orphans.count(), "foreign": rec.where(F.col("manifest") != self.manifest).count()}
