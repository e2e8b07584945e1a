"""WARC archives: writing, reading back, and resolution of revisits.

Archives are gzip files of WARC/1.1 records (one member for each file), written by Spark's own text writer: a record is
one row, and the two line ends that close a record are the row separator.  Reading goes by Content-Length, so payloads
may hold anything.  A file is read as one value, so records are written by size: as many of a class of sizes to a file
as make FILE_BYTES at most; a larger record has a file of its own.  All paths are Spark paths in the shared folder;
nothing touches a local disk.

Revisits: headers alone are shuffled by payload digest; of equal payloads of LEAST bytes or more the record with the
largest page id stays a response, the others become revisit records without payload that refer to it.  A digest with a
third of all records costs its headers only: the choice is a partial aggregate, and the joins are by digest against one
row each and by unique record id.

Edge cases: a null html is an empty payload; a null page id sorts first and is shown as null again, any long is an id;
rows that repeat a page id are records of their own, one of them the response; a null url is an empty target, blanks at
its ends are kept and line ends in it escaped; extra columns are ignored; a single payload of 2 GB or more can't be read.
"""

from __future__ import annotations

import datetime
import gzip
import hashlib
import io
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import _common as c

LEAST = 1000
FILE_BYTES = 128 << 20
#: Upper ends of the classes of payload sizes; all else is the last class.
SIZES = (64 << 10, 2 << 20)
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
EOL = "\r\n"
HEADER = "record_id string, page_id long, record_type string, url string, payload_digest string, payload_bytes long, refers_to long"
#: What a revisit record says of the one it refers to.
REFERS = ["refers_to", "refers_to_id", "refers_to_url"]


def records(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """A response record for each page: HEADER columns and payload."""
    body = F.coalesce(F.col(html).cast("string"), F.lit(""))
    rows = pages.select(F.col(key).cast("long").alias("page_id"), F.regexp_replace(F.coalesce(F.col(url).cast("string"), F.lit("")), "[\\r\\n]", "%0A").alias("url"), body.alias("payload"))
    name = F.md5(F.concat_ws("/", F.lit(uuid.uuid4().hex), F.monotonically_increasing_id().cast("string")))
    return rows.select(
        name.alias("record_id"), "page_id", F.lit("response").alias("record_type"), "url", F.sha1("payload").alias("payload_digest"),
        F.octet_length("payload").cast("long").alias("payload_bytes"), F.lit(None).cast("long").alias("refers_to"), "payload",
    )


def write_archives(rows: DataFrame, path: str, only: int | None = None) -> None:
    """Write HEADER rows with payload (ignored for revisits) as archives in folders under path, one for each class of
    sizes (`only`: all rows are of this class or smaller), with headers made here; refers_to_id and refers_to_url may be
    there for revisits."""
    for name in REFERS[1:]:
        if name not in rows.columns:
            rows = rows.withColumn(name, F.lit(None).cast("string"))
    date = datetime.datetime.now(datetime.timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(EOL))
    revisit = F.col("record_type") == "revisit"
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{EOL}Content-Type: text/html; charset=UTF-8{EOL}Content-Length: "), F.col("payload_bytes").cast("string"), F.lit(EOL * 2))
    block = F.when(revisit, http).otherwise(F.concat(http, "payload"))
    head = F.concat(
        F.lit(f"WARC/1.1{EOL}"),
        line("WARC-Type", F.col("record_type")),
        line("WARC-Record-ID", F.concat(F.lit("<urn:md5:"), "record_id", F.lit(">"))),
        line("WARC-Date", F.lit(date)),
        line("WARC-Target-URI", F.col("url")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "payload_digest")),
        F.when(F.col("page_id").isNotNull(), line("X-Page-ID", F.col("page_id").cast("string"))).otherwise(""),
        F.when(revisit, line("WARC-Profile", F.lit(PROFILE))).otherwise(""),
        F.when(revisit & F.col("refers_to_id").isNotNull(), line("WARC-Refers-To", F.concat(F.lit("<urn:md5:"), "refers_to_id", F.lit(">")))).otherwise(""),
        F.when(revisit & F.col("refers_to_url").isNotNull(), line("WARC-Refers-To-Target-URI", F.col("refers_to_url"))).otherwise(""),
        F.when(revisit & F.col("refers_to").isNotNull(), line("X-Refers-To-Page", F.col("refers_to").cast("string"))).otherwise(""),
        F.lit(f"Content-Type: application/http; msgtype=response{EOL}"),
    )
    size = F.when(revisit, F.lit(0)).otherwise(F.col("payload_bytes"))
    largest = 0 if only is not None else rows.agg(F.max(size)).first()[0] or 0
    full = rows.select(size.alias("size"), head.alias("head"), block.alias("block"))
    full = full.select("size", F.concat("head", F.lit("Content-Length: "), F.octet_length("block").cast("string"), F.lit(EOL * 2), "block").alias("value"))
    for k, (low, high) in enumerate(zip((-1, *SIZES), (*SIZES, None))):
        if only not in (None, k) or only is None and k and largest <= low:
            continue
        own = full if only == k else full.where((F.col("size") > low) & (F.col("size") <= high) if high else F.col("size") > low)
        own.select("value").write.option("lineSep", EOL * 2).option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED").option("maxRecordsPerFile", FILE_BYTES // high if high else 1).text(f"{path}/size{k}")


def parse(stream):
    """(header dict, http block) of each record of an uncompressed stream."""
    while True:
        first = stream.readline()
        if not first:
            return
        if first.strip() == b"":
            continue
        if not first.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {first[:60]!r}")
        head = {}
        while (text := stream.readline().removesuffix(b"\n").removesuffix(b"\r")):
            name, _, value = text.partition(b": ")
            head[name.decode().lower()] = value.decode()
        size = int(head["content-length"])
        block = stream.read(size)
        if len(block) < size:
            raise ValueError("a record ends early")
        yield head, block


def read_archives(spark: SparkSession, path: str, payload: bool = False) -> DataFrame:
    """HEADER rows of all archives at path, and the payload if wanted.  Digests and sizes of responses come from the
    payload as read; those of revisits from their headers."""
    names = [x.split()[0] for x in HEADER.split(", ")]
    kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()]

    def out(rows):
        cols = list(zip(*rows))
        arrays = [pa.array(x, k) for x, k in zip(cols, kinds)]
        return pa.RecordBatch.from_arrays(arrays + ([pa.array(cols[7], pa.string())] if payload else []), names + ["payload"] * payload)

    def run(batches):
        for b in batches:
            for content in b["content"]:
                rows, held = [], 0
                for head, block in parse(io.BufferedReader(gzip.GzipFile(fileobj=io.BytesIO(content.as_py())), 1 << 20)):
                    body = block[block.index(b"\r\n\r\n") + 4 :]
                    page = int(head["x-page-id"]) if "x-page-id" in head else None
                    if head["warc-type"] == "revisit":
                        size = int(block[: block.index(b"\r\n\r\n")].lower().rpartition(b"content-length:")[2].split()[0])
                        digest, body = head["warc-payload-digest"].partition(":")[2], b""
                    else:
                        size, digest = len(body), hashlib.sha1(body).hexdigest()
                        if digest != head["warc-payload-digest"].partition(":")[2]:
                            raise ValueError(f"payload of page {page} does not match its digest")
                    ref = int(head["x-refers-to-page"]) if "x-refers-to-page" in head else None
                    row = (head["warc-record-id"][9:-1], page, head["warc-type"], head["warc-target-uri"], digest, size, ref)
                    rows.append((*row, body.decode()) if payload else row)
                    held += len(body) * payload + 200
                    if held > 4 << 20:
                        yield out(rows)
                        rows, held = [], 0
                if rows:
                    yield out(rows)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").option("recursiveFileLookup", "true").load(path).select("content")
    return files.mapInArrow(run, HEADER + (", payload string" if payload else ""))


def resolve(headers: DataFrame, least: int = LEAST) -> DataFrame:
    """record_id, refers_to (page), refers_to_id, refers_to_url of the records that revisit another one."""
    # only digests met twice leave a row; the choice is aggregated before the shuffle
    rank = F.struct(F.col("page_id").isNotNull().alias("given"), F.col("page_id").alias("p"), F.col("record_id").alias("r"), F.col("url").alias("u"))
    large = headers.where(F.col("payload_bytes") >= least).select("record_id", "page_id", "payload_digest", "url")
    first = large.groupBy("payload_digest").agg(F.max(rank).alias("best"), F.count("*").alias("n")).where("n > 1")
    joined = large.join(first, "payload_digest").where("record_id <> best.r")
    return joined.select("record_id", F.col("best.p").alias("refers_to"), F.col("best.r").alias("refers_to_id"), F.col("best.u").alias("refers_to_url"))


def deduplicate(spark: SparkSession, source: str, target: str, least: int = LEAST) -> None:
    """Rewrite the archives at source to target: revisits without payload, all headers fresh.  Folders of size classes are
    rewritten one by one, so that each payload is shuffled once."""
    headers = c.written(read_archives(spark, source), "headers")
    revisits = c.written(resolve(headers, least), "revisits").withColumnRenamed("record_id", "rid").withColumnRenamed("refers_to", "ref")
    known, run = F.col("rid").isNotNull(), F.lit(uuid.uuid4().hex)
    fresh = lambda old: F.md5(F.concat_ws("/", run, old))  # the same record's new id wherever it is named
    where = spark._jvm.org.apache.hadoop.fs.Path
    folders = {k: f"{source}/size{k}" for k in range(len(SIZES) + 1)}
    folders = {k: p for k, p in folders.items() if where(p).getFileSystem(spark._jsc.hadoopConfiguration()).exists(where(p))} or {None: source}
    for k, path in folders.items():
        rows = read_archives(spark, path, payload=True).join(revisits, F.col("record_id") == F.col("rid"), "left")
        write_archives(rows.select(
            fresh(F.col("record_id")).alias("record_id"), "page_id", F.when(known, "revisit").otherwise(F.col("record_type")).alias("record_type"), "url", "payload_digest", "payload_bytes",
            F.when(known, F.col("ref")).otherwise(F.col("refers_to")).alias("refers_to"), F.when(known, fresh(F.col("refers_to_id"))).alias("refers_to_id"), "refers_to_url",
            F.when(~known, F.col("payload")).otherwise("").alias("payload"),
        ), target, k)


def round_trip(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """Write pages, deduplicate the archives, read them back: page_id, payload_bytes, payload_digest, record_type,
    refers_to, url."""
    spark = pages.sparkSession
    root = f"{c.shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_archives(records(pages), f"{root}/all")
    deduplicate(spark, f"{root}/all", f"{root}/deduplicated", least)
    return read_archives(spark, f"{root}/deduplicated").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")
