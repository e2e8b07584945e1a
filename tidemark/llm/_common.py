"""What the operators of this package share: Arrow access, word hashing, packed columns and shared folders.

The word rules are those of the near-duplicate contract: A-Z are lower-cased, a word is a run of bytes other than
0x20 and 0x09-0x0D, and a shingle is five consecutive words (a shorter text is one shingle, an empty one has none).
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
#: Text bytes that a Python step handles at once; working arrays are a small multiple of it.
SLICE_BYTES = 1 << 19
#: Stands for a null document id inside the operators that join or order by id; results show null again.
NULL_ID = -(1 << 63)


# ---------------------------------------------------------------- Spark side
def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; where that is unset, one of our own in local mode,
    and an error on a cluster."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = getattr(shared_dir, "own", None) or tempfile.mkdtemp(prefix="tidemark-")
        shared_dir.own = at
    return at.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: lineage is cut and the rows survive lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables that `written` made, once all that was computed from them is written itself."""
    for df in tables:
        at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._written_at)
        at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


def shuffle_width(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_text(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Only the two columns an operator needs, so that extra or clashing columns never reach a join."""
    return docs.select(F.col(key).cast("long").alias(key), F.col(text).cast("string").alias(text))


def filled_id(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    return docs.select(F.coalesce(F.col(key).cast("long"), F.lit(NULL_ID)).alias(key), F.col(text).cast("string").alias(text))


def shown_id(col: str):
    return F.when(F.col(col) != NULL_ID, F.col(col))


# ---------------------------------------------------------------- Arrow side
def buffers(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (from 0) of a string or binary array; nulls are empty."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    if arr.null_count:
        arr = pc.fill_null(arr, "" if pa.types.is_string(arr.type) or pa.types.is_large_string(arr.type) else b"")
    wide = pa.types.is_large_string(arr.type) or pa.types.is_large_binary(arr.type)
    if len(arr) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offs = np.frombuffer(arr.buffers()[1], np.int64 if wide else np.int32)[arr.offset : arr.offset + len(arr) + 1].astype(np.int64)
    data = np.frombuffer(arr.buffers()[2], np.uint8)[offs[0] : offs[-1]] if arr.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data, offs - offs[0]


def slices(offs: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about `most` bytes; a longer row stands alone."""
    lo, n = 0, len(offs) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + most, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def longs(arr) -> np.ndarray:
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    return pc.fill_null(arr, NULL_ID).to_numpy(zero_copy_only=False).astype(np.int64)


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of one length each, as one zstd block: type codes, lengths, bytes."""
    head = np.array([len(arrays)] + [x for a in arrays for x in (ord(a.dtype.char), len(a))], np.int64).tobytes()
    raw = head + b"".join(np.ascontiguousarray(a).tobytes() for a in arrays)
    return len(raw).to_bytes(8, "little") + pa.Codec("zstd", 1).compress(raw, asbytes=True)


def unpack(block: bytes) -> list[np.ndarray]:
    raw = pa.Codec("zstd").decompress(block[8:], int.from_bytes(block[:8], "little"), asbytes=True)
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    head, at, out = np.frombuffer(raw, np.int64, 2 * n, 8), 8 * (2 * n + 1), []
    for code, size in head.reshape(n, 2):
        kind = np.dtype(chr(code))
        out.append(np.frombuffer(raw, kind, int(size), at))
        at += int(size) * kind.itemsize
    return out


# ---------------------------------------------------------------- hashing
def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words whose low and high bits both depend on all input bits."""
    x = x ^ (x >> U64(31))
    x = x * U64(0x9E3779B97F4A7C15)
    x ^= x >> U64(29)
    x *= U64(0xD1B54A32D192ED03)
    x ^= x >> U64(32)
    return x


def spark_hash(x: np.ndarray) -> np.ndarray:
    """xxhash64(bigint) of Spark SQL (the public XXH64 of eight bytes, seed 42), as signed longs."""
    p1, p2, p3, p4, p5 = (U64(v) for v in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    with np.errstate(over="ignore"):
        k = x.astype(np.int64).view(U64) * p2
        k = ((k << U64(31)) | (k >> U64(33))) * p1
        h = (U64(42) + p5 + U64(8)) ^ k
        h = ((h << U64(27)) | (h >> U64(37))) * p1 + p4
        h = (h ^ (h >> U64(33))) * p2
        h = (h ^ (h >> U64(29))) * p3
        return (h ^ (h >> U64(32))).view(np.int64)


_rng = np.random.Generator(np.random.PCG64(20240229))
BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.int64).astype(U64) * U64(2) + U64(1)
_BASE = U64(0x5851F42D4C957F2D)
SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BYTE_LOWER = BYTE[LOWER]
_powers = np.ones(1, U64)


def powers(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        with np.errstate(over="ignore"):
            _powers = np.concatenate([[U64(1)], np.cumprod(np.full(2 * n, _BASE, U64))])
    return _powers[:n]


def word_spans(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, and the first word of every row (one more entry than rows)."""
    n = len(data)
    ink = ~SPACE[data]
    before = np.zeros(n, bool)
    before[1:] = ink[:-1]
    edge = offs[:-1][offs[:-1] < n]
    before[edge] = False
    starts = np.flatnonzero(ink & ~before)
    after = np.zeros(n, bool)
    after[:-1] = ink[1:] & before[1:] if n else False
    ends = np.flatnonzero(ink & ~after) + 1
    return starts, ends, np.searchsorted(starts, offs)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, values: np.ndarray = BYTE_LOWER) -> np.ndarray:
    """A 64-bit hash of each word; `values` maps bytes first (lower-casing by default)."""
    if not len(starts):
        return np.zeros(0, U64)
    lens = ends - starts
    first = np.concatenate([[0], np.cumsum(lens)[:-1]])
    pos = np.arange(int(lens.sum())) - np.repeat(first, lens)
    with np.errstate(over="ignore"):
        bytes_at = values[data[pos + np.repeat(starts, lens)]] * powers(int(lens.max()) + 1)[pos]
        return mix(np.add.reduceat(bytes_at, first) + lens.astype(U64))


_STEP = _rng.integers(1, 1 << 63, 5, dtype=np.int64).astype(U64) * U64(2) + U64(1)


def shingle_hashes(words: np.ndarray, row: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of five words, row by row, and where each row's begin (one more entry than rows)."""
    counts = np.diff(row)
    n_sh = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    at = np.concatenate([[0], np.cumsum(n_sh)])
    out = np.zeros(int(at[-1]), U64)
    with np.errstate(over="ignore"):
        n = len(words) - size + 1
        if n > 0:
            h = words[:n] * _STEP[0]
            for j in range(1, size):
                h = h + words[j : n + j] * _STEP[j]
            h = mix(h)
            long_rows = np.flatnonzero(counts >= size)
            if len(long_rows):
                k = n_sh[long_rows]
                src = np.arange(int(k.sum())) - np.repeat(np.cumsum(k) - k, k)
                out[src + np.repeat(at[long_rows], k)] = h[src + np.repeat(row[long_rows], k)]
        for r in np.flatnonzero((counts > 0) & (counts < size)):
            w = words[row[r] : row[r + 1]]
            out[at[r]] = mix((w * _STEP[: len(w)]).sum(dtype=U64) + np.full(1, len(w), U64))[0]
    return out, at


def row_sets(shingles: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of each row, ascending, and where each row's begin."""
    row = np.repeat(np.arange(len(at) - 1), np.diff(at))
    order = np.lexsort((shingles, row))
    s, r = shingles[order], row[order]
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1]) | (r[1:] != r[:-1])
    s, r = s[new], r[new]
    return s, np.searchsorted(r, np.arange(len(at)))
