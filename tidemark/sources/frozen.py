"""A folder frozen under a hash tree: what changed later is found by descending from the root.

Leaves are files, hashed where they are read.  A leaf's place is the SHA-256 of its name; inner nodes are prefixes of that place,
so each level is an aggregate by prefix, and a node has at most sixteen children (or, at the bottom, some LEAVES files).  The
tree is written beside the folder, and a marker with the root's hash is created atomically: a folder is frozen once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.series import ContractError

#: Files of a bottom node on average, at most.
LEAVES = 64
NODE = "level int, prefix string, n_files long, sha256 string"


def leaves(spark: SparkSession, path: str) -> DataFrame:
    """file, bytes, sha256 of every file below a folder (names that begin with _ or . are not part of it)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    root = path.rstrip("/").split("://", 1)[-1].removeprefix("file:").rstrip("/")
    name = F.regexp_replace(F.substring_index("path", root + "/", -1), "^/+", "")
    return files.select(name.alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def tree(files: DataFrame, depth: int | None = None) -> DataFrame:
    """level, prefix, n_files, sha256 of all inner nodes, level 0 the root.  Equal sets of files give equal trees."""
    placed = files.withColumn("place", F.sha2("file", 256))
    if depth is None:
        n, depth = files.count(), 0
        while n > LEAVES * 16**depth:
            depth += 1
    leaf = F.concat_ws(":", "file", "sha256")
    digest = lambda parts: F.sha2(F.array_join(F.sort_array(F.collect_list(parts)), ","), 256)  # noqa: E731  LEAVES or sixteen
    level = placed.groupBy(F.substring("place", 1, depth).alias("prefix")).agg(F.count("*").alias("n_files"), digest(leaf).alias("sha256")).withColumn("level", F.lit(depth))
    out = level
    for k in range(depth - 1, -1, -1):
        level = level.groupBy(F.substring("prefix", 1, k).alias("prefix")).agg(F.sum("n_files").alias("n_files"), digest(F.concat_ws(":", "prefix", "sha256")).alias("sha256")).withColumn("level", F.lit(k))
        out = out.unionByName(level)
    return out.select("level", "prefix", "n_files", "sha256")


def _fs(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def _mark(path: str) -> str:
    return path.rstrip("/") + ".frozen"


def freeze(spark: SparkSession, path: str) -> str:
    """Write the tree and the leaves beside the folder and create the marker; returns the root's hash."""
    mark = _mark(path)
    if _fs(spark, f"{mark}/root")[0].exists(_fs(spark, f"{mark}/root")[1]):
        raise ContractError("the folder is frozen already")
    fs, at = _fs(spark, f"{mark}/freezing")
    if not fs.createNewFile(at):
        raise ContractError("the folder is being frozen")
    try:
        leaves(spark, path).write.mode("overwrite").parquet(f"{mark}/leaves")
        held = spark.read.parquet(f"{mark}/leaves")
        tree(held).write.mode("overwrite").parquet(f"{mark}/tree")
        root = spark.read.parquet(f"{mark}/tree").where("level = 0").select("sha256").first()
        root = root[0] if root else ""
        fs, new = _fs(spark, f"{mark}/root.new")
        out = fs.create(new, True)
        out.write(bytearray(root.encode()))
        out.close()
        if not fs.rename(new, _fs(spark, f"{mark}/root")[1]):
            raise ContractError("the marker could not be made")
        return root
    finally:
        fs.delete(at, False)


def frozen_root(spark: SparkSession, path: str) -> str:
    rows = spark.read.text(f"{_mark(path)}/root").collect()  # one line
    return rows[0][0] if rows else ""


def changed(spark: SparkSession, path: str) -> DataFrame:
    """file, was, now of the files that differ from the frozen ones (null where there is none).  Nothing is compared below a node
    whose hash still holds: each level joins only the children of nodes that differ."""
    mark = _mark(path)
    held = spark.read.parquet(f"{mark}/tree")
    depth = held.agg(F.max("level")).first()[0] or 0
    files = leaves(spark, path)
    now = tree(files, depth).select("level", "prefix", F.col("sha256").alias("now"))
    was = held.select("level", "prefix", F.col("sha256").alias("was"))
    odd = None
    for k in range(depth + 1):
        level = was.where(F.col("level") == k).join(now.where(F.col("level") == k), ["level", "prefix"], "full")
        if odd is not None:
            level = level.withColumn("up", F.substring("prefix", 1, k - 1)).join(odd.select(F.col("prefix").alias("up")), "up", "left_semi")
        odd = level.where("was is null or now is null or was <> now").select("prefix")
    below = lambda df, name: df.withColumn("prefix", F.substring(F.sha2("file", 256), 1, depth)).join(odd, "prefix", "left_semi").select("file", F.col("sha256").alias(name))
    both = below(spark.read.parquet(f"{mark}/leaves"), "was").join(below(files, "now"), "file", "full")
    return both.where("was is null or now is null or was <> now")


def verify(spark: SparkSession, path: str) -> bool:
    """Whether the folder still has the root that was frozen: one hash reaches the driver."""
    mark = _mark(path)
    depth = spark.read.parquet(f"{mark}/tree").agg(F.max("level")).first()[0] or 0
    root = tree(leaves(spark, path), depth).where("level = 0").select("sha256").first()
    return (root[0] if root else "") == frozen_root(spark, path)


def copy_mark(spark: SparkSession, path: str, other: str) -> None:
    """Hold another folder to what was frozen for this one."""
    for part in ("leaves", "tree"):
        spark.read.parquet(f"{_mark(path)}/{part}").write.parquet(f"{_mark(other)}/{part}")
    fs, at = _fs(spark, f"{_mark(other)}/root")
    if not fs.createNewFile(at):
        raise ContractError("the folder is frozen already")
    out = fs.create(at, True)
    out.write(bytearray(frozen_root(spark, path).encode()))
    out.close()
