"""Transactional part files: JSON lines, or one file for each row, with a manifest of SHA-256 that makes them visible.

Tasks write below a folder of the job's own.  The commit moves their files into place and creates the manifest last; readers
read what the manifest names and nothing else, so a job that dies at any point shows nothing.  An abort removes the job's
folder and all files it had moved.  A folder is written once: a second job is refused unless it replaces the first, whose
files go when the new manifest stands.  Paths are local or URIs that pyarrow opens; the folder is shared by all executors."""

from __future__ import annotations

import hashlib
import json
import posixpath
import uuid
from dataclasses import dataclass, field

from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from tidemark.operators.series import ContractError

MANIFEST = "_manifest.json"


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    if "://" in path or path.startswith("file:"):
        return pafs.FileSystem.from_uri("file://" + path.removeprefix("file:") if path.startswith("file:/") and not path.startswith("file://") else path)
    return pafs.LocalFileSystem(), path


def _exists(fs: pafs.FileSystem, path: str) -> bool:
    return fs.get_file_info(path).type != pafs.FileType.NotFound


def manifest_of(path: str) -> list[dict]:
    """The entries of a folder's manifest (file, bytes, rows, sha256); a folder without one holds nothing."""
    fs, at = _open(path)
    if not _exists(fs, f"{at}/{MANIFEST}"):
        return []
    with fs.open_input_stream(f"{at}/{MANIFEST}") as f:
        return json.loads(f.read())


@dataclass
class Written(WriterCommitMessage):
    files: list = field(default_factory=list)  # (temporary name, entry) of one task: as many as it has files


class PartsWriter(DataSourceWriter):
    def __init__(self, options: dict, replace: bool):
        self.path, self.form, self.replace = options["path"], options.get("form", "lines"), replace
        self.job = f"_job-{uuid.uuid4().hex}"
        if self.form not in ("lines", "files"):
            raise ContractError(f"no form {self.form}")
        if manifest_of(self.path) and not replace:
            raise ContractError("the folder has been written; it is written once")

    def write(self, iterator) -> Written:
        fs, at = _open(self.path)
        tc, out = TaskContext.get(), Written()
        name = f"part-{tc.partitionId():05d}.jsonl"
        own = f"{self.job}/{tc.partitionId()}-{tc.attemptNumber()}-{uuid.uuid4().hex[:8]}"
        fs.create_dir(f"{at}/{own}", recursive=True)
        if self.form == "files":
            for row in iterator:
                name, content = row["name"], bytes(row["content"])
                if posixpath.basename(name) != name or name.startswith(("_", ".")):
                    raise ContractError(f"not a file name: {name}")
                with fs.open_output_stream(f"{at}/{own}/{name}") as f:
                    f.write(content)
                out.files.append((f"{own}/{name}", {"file": name, "bytes": len(content), "rows": 1, "sha256": hashlib.sha256(content).hexdigest()}))
            return out
        digest, size, rows = hashlib.sha256(), 0, 0
        with fs.open_output_stream(f"{at}/{own}/{name}") as f:
            for row in iterator:
                line = row["value"].encode() + b"\n"
                digest.update(line)
                size, rows = size + len(line), rows + 1
                f.write(line)
        out.files.append((f"{own}/{name}", {"file": name, "bytes": size, "rows": rows, "sha256": digest.hexdigest()}))
        return out

    def commit(self, messages) -> None:
        fs, at = _open(self.path)
        files = [x for m in messages if m for x in m.files]
        names = [e["file"] for _, e in files]
        if len(set(names)) < len(names):
            raise ContractError("two rows have one file name")
        before = manifest_of(self.path)
        mark = self.job.removeprefix("_job-")[:8]
        final = {e["file"]: f"{mark}-{e['file']}" if self.replace and before else e["file"] for _, e in files}  # the old ones stay until the new stand
        for own, e in files:
            fs.move(f"{at}/{own}", f"{at}/{final[e['file']]}")
        entries = sorted(({**e, "file": final[e["file"]]} for _, e in files), key=lambda e: e["file"])
        with fs.open_output_stream(f"{at}/{self.job}/{MANIFEST}") as f:
            f.write(json.dumps(entries, sort_keys=True, indent=1).encode())
        fs.move(f"{at}/{self.job}/{MANIFEST}", f"{at}/{MANIFEST}")
        for e in before:
            if e["file"] not in final.values() and _exists(fs, f"{at}/{e['file']}"):
                fs.delete_file(f"{at}/{e['file']}")
        fs.delete_dir(f"{at}/{self.job}")

    def abort(self, messages) -> None:
        fs, at = _open(self.path)
        held = {e["file"] for e in manifest_of(self.path)}
        for m in messages:
            for own, e in m.files if m else ():
                if not _exists(fs, f"{at}/{own}") and e["file"] not in held and _exists(fs, f"{at}/{e['file']}"):
                    fs.delete_file(f"{at}/{e['file']}")  # moved by a commit that failed afterwards
        if _exists(fs, f"{at}/{self.job}"):
            fs.delete_dir(f"{at}/{self.job}")


class _File(InputPartition):
    def __init__(self, entry: dict):
        self.entry = entry


class PartsReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]

    def partitions(self):
        return [_File(e) for e in manifest_of(self.path)]

    def read(self, partition):
        fs, at = _open(self.path)
        digest = hashlib.sha256()
        with fs.open_input_stream(f"{at}/{partition.entry['file']}") as f:
            rest = b""
            while chunk := f.read(1 << 20):
                digest.update(chunk)
                *lines, rest = (rest + chunk).split(b"\n")
                yield from ((x.decode(),) for x in lines)
            if rest:
                yield (rest.decode(),)
        if digest.hexdigest() != partition.entry["sha256"]:
            raise ContractError(f"{partition.entry['file']} differs from the manifest")


class PartsSource(DataSource):
    """df.write.format("tidemark_parts").option("form", "lines" | "files").mode("append" | "overwrite").save(path)"""

    @classmethod
    def name(cls):
        return "tidemark_parts"

    def schema(self):
        return "value string"

    def reader(self, schema):
        return PartsReader(self.options)

    def writer(self, schema, overwrite):
        return PartsWriter(self.options, overwrite)


def write_lines(df: DataFrame, path: str, replace: bool = False) -> None:
    """Every row as a line of JSON, a part file for each task; nothing is visible before all are."""
    df.sparkSession.dataSource.register(PartsSource)
    lines = df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value"))
    lines.write.format("tidemark_parts").mode("overwrite" if replace else "append").save(path)


def write_files(df: DataFrame, path: str, replace: bool = False) -> None:
    """Every row (name, content) as a file of that name."""
    df.sparkSession.dataSource.register(PartsSource)
    df.select("name", "content").write.format("tidemark_parts").option("form", "files").mode("overwrite" if replace else "append").save(path)


def read_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of the part files that the manifest names, their digests checked; a line that isn't a row of the schema stops."""
    spark.dataSource.register(PartsSource)
    rows = spark.read.format("tidemark_parts").load(path)
    return rows.select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("r")).select("r.*")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """file, bytes, rows, sha256 of a written folder: one row for each file."""
    return spark.createDataFrame([(e["file"], e["bytes"], e["rows"], e["sha256"]) for e in manifest_of(path)], "file string, bytes long, rows long, sha256 string")
