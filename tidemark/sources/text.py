"""Text sources with fixed schemas: statistical-office CSV, yearly sunspot files, transcribed tables, JSON lines.

Values stay text until rows have been chosen by label, so a bad cell outside the sample never fails a query; what is
expected and missing stops it (ContractError)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.series import ContractError, stop_if_any

QUARTER, MONTH, YEAR = r"^\d{4} Q[1-4]$", r"^\d{4} [A-Z]{3}$", r"^\d{4}$"
MOST_FIELDS = 100
HEADER_FIELDS = ("Title", "CDID", "Source dataset ID", "PreUnit", "Unit", "Release date", "Next release", "Important Notes")


def scan_ons_csv(spark: SparkSession, path: str) -> DataFrame:
    """label, raw, kind of each two-column record: header, quarter, month or year.  A byte-order mark is dropped.  A record
    of another width, a header field that a file has twice, and a header field behind a file's data stop."""
    rows = spark.read.schema("label string, raw string, _corrupt string").option("columnNameOfCorruptRecord", "_corrupt").option("columnPruning", False).option("quote", '"').csv(path)
    label = F.regexp_replace("label", "^\\ufeff", "")
    kind = F.when(label.rlike(QUARTER), "quarter").when(label.rlike(MONTH), "month").when(label.rlike(YEAR), "year").otherwise("header")
    rows = rows.select(label.alias("label"), "raw", "_corrupt", kind.alias("kind"), F.col("_metadata.file_path").alias("file"), F.struct("_metadata.file_block_start", F.monotonically_increasing_id()).alias("at"))
    header = F.col("kind") == "header"
    order = rows.groupBy("file").agg(F.count_if(F.col("_corrupt").isNotNull()).alias("odd"), F.max(F.when(header, F.col("at"))).alias("last"), F.min(F.when(~header, F.col("at"))).alias("first"))
    stop_if_any(order.where("odd > 0"), "a record is not two fields wide")
    stop_if_any(order.where("last > first"), "a header field stands behind data")
    stop_if_any(rows.where(header).groupBy("file", "label").count().where("count > 1"), "a header field stands twice")
    return rows.select("label", "raw", "kind")


def check_identity(parsed: DataFrame, cdid: str, dataset: str, title_parts: list[str], release: str | None = None) -> list[str]:
    """All problems of the header, in one list; a duplicate header field is a problem."""
    rows = parsed.where("kind = 'header'").select("label", "raw").limit(MOST_FIELDS + 1).collect()
    if len(rows) > MOST_FIELDS:
        raise ContractError(f"more than {MOST_FIELDS} records are no quarter, month or year: this is no header")
    head: dict[str, str] = {}
    problems = []
    for r in rows:
        if r.label in head:
            problems.append(f"duplicate header {r.label}")
        head[r.label] = r.raw or ""
    if head.get("CDID") != cdid:
        problems.append(f"CDID is {head.get('CDID')!r}")
    if head.get("Source dataset ID") != dataset:
        problems.append(f"dataset is {head.get('Source dataset ID')!r}")
    problems += [f"title lacks {p!r}" for p in title_parts if p.lower() not in head.get("Title", "").lower()]
    if release and head.get("Release date") != release:
        problems.append(f"release date is {head.get('Release date')!r}")
    return problems


def quarter_number(label: Column) -> Column:
    return 4 * F.substring(label, 1, 4).cast("int") + F.substring(label, 7, 1).cast("int") - 1


def registered_sample(parsed: DataFrame, first: str, last: str) -> DataFrame:
    """label, pos, y of the quarters first..last: all there, once each, positive and finite."""
    bound = lambda t: 4 * int(t[:4]) + int(t[-1]) - 1
    lo, hi = bound(first), bound(last)
    q = parsed.where("kind = 'quarter'").withColumn("q", quarter_number(F.col("label"))).where(F.col("q").between(lo, hi))
    out = q.select("label", (F.col("q") - lo).cast("long").alias("pos"), F.expr("try_cast(raw as double)").alias("y"))
    stop_if_any(out.where("y is null or isnan(y) or abs(y) = double('infinity') or y <= 0"), "level not positive and finite")
    n = out.agg(F.count("*").alias("n"), F.countDistinct("pos").alias("d")).first()
    if n.n != hi - lo + 1 or n.d != n.n:
        raise ContractError(f"{n.d} of {hi - lo + 1} quarters in {n.n} rows")
    return out


def _mid_year(stamp: Column) -> Column:
    return F.when(stamp.rlike(r"^\d{4}\.5$"), F.substring(stamp, 1, 4).cast("int"))


def scan_silso_v2(spark: SparkSession, path: str) -> DataFrame:
    """year, value, definitive of a file of five fields separated by semicolons; stamps are mid-year."""
    f = F.split("value", ";")
    rows = spark.read.text(path).where("trim(value) <> ''").select(F.transform(f, lambda x: F.trim(x)).alias("f"))
    out = rows.select(_mid_year(F.get("f", 0)).alias("year"), F.expr("try_cast(f[1] as double)").alias("value"), (F.get("f", 4) == "1").alias("definitive"), F.size("f").alias("n"))
    stop_if_any(out.where("n <> 5 or year is null or value is null"), "not a yearly record")
    return out.drop("n")


def scan_silso_v1(spark: SparkSession, path: str) -> DataFrame:
    """year, value of a file of two fields separated by space."""
    rows = spark.read.text(path).where("trim(value) <> ''").select(F.split(F.trim("value"), r"\s+").alias("f"))
    out = rows.select(_mid_year(F.get("f", 0)).alias("year"), F.expr("try_cast(f[1] as double)").alias("value"), F.size("f").alias("n"))
    stop_if_any(out.where("n <> 2 or year is null or value is null"), "not a yearly record")
    return out.drop("n")


def scan_table_a(spark: SparkSession, path: str) -> DataFrame:
    """year, wolfer_number, page of a transcribed table with a header."""
    return spark.read.schema("year int, wolfer_number double, page int").option("header", True).option("mode", "FAILFAST").csv(path)


def write_json_records(rows: DataFrame, manifest: str, path: str) -> None:
    """A folder of JSON lines: the manifest is the first line of the first file, and every partition of rows (one column, value)
    writes a file of its own, so that nothing is sorted or gathered."""
    first = rows.sparkSession.createDataFrame([(manifest,)], "value string").coalesce(1)
    first.unionByName(rows).write.text(path)


def json_records(spark: SparkSession, path: str, schema: str, types: list[str]) -> DataFrame:
    """Records of a JSON-lines file, or of a folder of them in order of name, whose first line is the manifest; unknown record types stop."""
    text = spark.read.text(path)
    kind = F.get_json_object("value", "$.type")
    place = F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id())
    first = text.where("length(value) > 0").select(kind.alias("type"), place.alias("place")).agg(F.min_by("type", "place").alias("type")).first()
    if first.type != "manifest":
        raise ContractError("the first line is not a manifest")
    stop_if_any(text.select(kind.alias("type")).where(F.col("type").isNull() | ~F.col("type").isin("manifest", *types)), "unknown record type")
    return text.where(kind != "manifest").select(kind.alias("type"), F.from_json("value", schema).alias("r")).select("type", "r.*")


def write_labelled_csv(df: DataFrame, kind: str, path: str) -> None:
    """A CSV whose first column says what kind of data it holds; lists as JSON, missing as blank; never overwrites."""
    cols = [F.to_json(c).alias(c) if t.startswith(("array", "map", "struct")) else F.col(c) for c, t in df.dtypes]
    df.select(F.lit(kind).alias("data_kind"), *cols).write.mode("errorifexists").option("header", True).csv(path)
