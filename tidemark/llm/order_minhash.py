"""Order MinHash fingerprints, in DataFrame functions only.

A text's k-mers are its runs of K characters (a shorter text is one k-mer), numbered by occurrence so that repeats
differ.  Each of TUPLES hash functions puts the numbered k-mers into an order of its own; the two smallest are taken,
set in text order and hashed together.  A component agrees for two texts if both k-mers are shared *and* stand in the
same order, which follows edit distance where a plain MinHash sees only sets.  The fingerprint is the hex of all
components; likeness is the share of equal ones.

The hash functions are one 34-bit hash turned by evenly spaced steps, h_j(x) = h(x) - j * 2**64 / TUPLES (modulo 2**64).
Each h_j is as uniform as h, and its smallest values are the next ones behind a point of the sorted hashes, so a text is
sorted once and each component is a binary search, not a pass over all k-mers.  Components of a text with few k-mers
repeat each other; likeness keeps its mean, with a larger spread.

Plan: everything is computed inside the row, a text's array of hashes at a time (eight bytes a character).  Rows are
dealt once, by ranges of id, which also serves the next document's text and fingerprint; no second shuffle of text.

Edge cases: null text is empty; an empty text has one empty k-mer, so all empty texts share a fingerprint; white space
counts like any character, and text without it is treated alike; a null id sorts last in descending order and is shown
as null; rows that repeat an id follow each other, in order of a hash of the text; the next document of the last is the
first, of a single document itself; a text of up to 2**30 characters keeps all its k-mers; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm import _common as c

TUPLES = 32
K = 8
#: Characters of a piece in which k-mers are cut: finding a character costs its distance from the piece's start.
PIECE = 64
#: The low bits of a hash hold the k-mer's place.
_PLACE = (1 << 30) - 1
_NAME = ~_PLACE


def _below(values: Column, size: Column, x: Column) -> Column:
    """How many entries of a sorted array of longs are smaller than x: binary search by falling powers of two."""
    powers = F.slice(F.lit([1 << b for b in range(30, -1, -1)]), 31 - F.floor(F.log2(F.greatest(size, F.lit(1)))).cast("int"), F.lit(31))

    def step(d, power):
        far = d + power
        return F.when((far <= size) & (F.get(values, far - 1) < x), far).otherwise(d)

    return F.aggregate(powers, F.lit(0), step)


def _range_of(cuts: list[int], x: Column) -> Column:
    """The number of cuts up to x, by the same search.  x goes through the state: Catalyst infers join conditions from
    this column, and overlooks columns that only a lambda names."""
    if not cuts:
        return F.lit(0)
    powers = F.array(*(F.lit(1 << b) for b in range(len(cuts).bit_length() - 1, -1, -1)))
    state = lambda d, x: F.struct(d.alias("d"), x.alias("x"))

    def step(a, power):
        far = a["d"] + power
        return state(F.when((far <= len(cuts)) & (F.get(F.lit(cuts).cast("array<bigint>"), far - 1) <= a["x"]), far).otherwise(a["d"]), a["x"])

    return F.aggregate(powers, state(F.lit(0), x), step, lambda a: a["d"])


def hashed(text: Column, first: Column) -> Column:
    """The k-mers of a text in order, each as one long: the high bits of its hash, and its place counted from `first`."""
    # pieces of PIECE k-mers each: the last K - 1 characters of a piece are the next one's first
    cut = F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{K},{PIECE + K - 1}}})).{{1,{PIECE}}}"), F.lit(1))
    cut = F.when(F.char_length(text) < K, F.array(text)).otherwise(cut)

    def one(piece, m):
        at = first + m * PIECE
        size = F.greatest(F.least(F.char_length(piece) - (K - 1), F.lit(PIECE)), F.lit(1))
        return F.transform(F.sequence(at, at + size - 1), lambda p, j: F.xxhash64(F.substring(piece, j + 1, F.lit(K))).bitwiseAND(F.lit(_NAME)).bitwiseOR(p))

    return F.flatten(F.transform(cut, one))


def components(rows: DataFrame, hashes: str, into: str, keep: list[str]) -> DataFrame:
    """The columns to keep, and `into`: the components of a text, from its k-mers (`hashes`), as an array of longs."""
    name, place = (lambda x: x.bitwiseAND(F.lit(_NAME))), (lambda x: x.bitwiseAND(F.lit(_PLACE)))
    rows = rows.select(*keep, F.sort_array(hashes).alias("_v"))
    same = lambda x, j: name(F.get("_v", j).bitwiseXOR(x)) == 0

    def numbered(x, j):
        """Equal k-mers are neighbours, in text order: the first keeps its hash, others take their number into it."""
        few = F.aggregate(F.lit([8, 4, 2, 1]), F.lit(2), lambda d, step: F.when(same(x, j - d - step), d + step).otherwise(d))
        number = F.when(same(x, j - 2), F.when(same(x, j - 18), j - _below(F.col("_v"), j, name(x))).otherwise(few)).otherwise(1)
        return F.when(same(x, j - 1), name(F.xxhash64(name(x), number)).bitwiseOR(place(x))).otherwise(x)

    rows = rows.select(*keep, F.sort_array(F.transform("_v", numbered)).alias("_s"))
    size = F.size("_s")
    points = F.lit([-(1 << 63) + (j << 64) // TUPLES for j in range(TUPLES)]).cast("array<bigint>")
    found = F.transform(points, lambda x: _below(F.col("_s"), size, x))
    pair = F.transform(found, lambda i: F.struct(F.get("_s", i % size).alias("a"), F.get("_s", (i + 1) % size).alias("b")))
    tuple_ = lambda x, y: F.xxhash64(name(x), name(y)).bitwiseAND(F.lit(0xFFFFFFFF))
    return rows.select(*keep, F.transform(pair, lambda p: F.when(place(p["a"]) <= place(p["b"]), tuple_(p["a"], p["b"])).otherwise(tuple_(p["b"], p["a"]))).alias(into))


def signed(rows: DataFrame, text: str, into: str, keep: list[str]) -> DataFrame:
    """The columns to keep, and `into`: the components of the text."""
    return components(rows.select(*keep, hashed(F.col(text), F.lit(0).cast("long")).alias("_h")), "_h", into, keep)


def shown(sig: str) -> Column:
    return F.concat_ws("", F.transform(F.col(sig), lambda x: F.lpad(F.lower(F.hex(x)), 8, "0")))


def likeness(a: str, b: str) -> Column:
    same = F.aggregate(F.zip_with(F.col(a), F.col(b), lambda x, y: (x == y).cast("int")), F.lit(0), lambda n, x: n + x)
    return same / F.lit(float(TUPLES))


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fingerprint of every row."""
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    return signed(rows, "text", "sig", ["doc_id"]).select("doc_id", shown("sig").alias("fingerprint"))


def edited_likeness(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every document.  The
    edited text has its last half replaced by the beginning of the next document, in descending order of id."""
    spark = docs.sparkSession
    docs = c.filled_id(docs, key, text).select(F.col(key).alias("doc_id"), F.coalesce(text, F.lit("")).alias("text"))
    n = 8 * c.shuffle_width(spark)  # many small ranges, so that their hashes fill the partitions evenly
    cuts = docs.agg(F.percentile_approx("doc_id", [k / n for k in range(1, n)], max(10_000, 20 * n))).first()[0] or []
    cuts = sorted(set(cuts))
    docs = docs.select(_range_of(cuts, F.col("doc_id")).alias("part"), "doc_id", F.xxhash64("text").alias("tie"), "text")
    order = Window.partitionBy("part").orderBy(F.col("doc_id").desc(), "tie")
    # the first document of each part: as many rows as parts
    head = c.written(docs.groupBy("part").agg(F.max("doc_id").alias("first")), "first-ids")
    head = docs.join(F.broadcast(head.select("first")), F.col("doc_id") == F.col("first")).groupBy("part").agg(F.min_by("text", "tie").alias("head"))
    head = c.written(head, "heads")
    below = F.lag("part").over(Window.orderBy("part"))
    follow = head.select("part", F.coalesce(below, F.max("part").over(Window.partitionBy())).alias("next"))
    ends = signed(head.withColumnRenamed("part", "next"), "head", "head_sig", ["next", "head"])
    ends = c.written(follow.join(ends, "next").drop("next"), "ends")
    rows = docs.withColumn("row", F.row_number().over(order)).withColumn("next", F.lead("text").over(order))
    rows = rows.join(ends.select("part", "head"), "part").withColumn("next", F.coalesce("next", "head"))
    size = F.char_length("text")
    half = F.floor(size / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), size - half), F.substring("next", F.lit(1), half))
    rows = rows.select("part", "row", "doc_id", "text", size.alias("size"), F.greatest(size - half - (K - 1), F.lit(0)).alias("shared"), edited.alias("edited"))
    # the first `shared` k-mers of the edited text are the document's own
    rest = hashed(F.substring("edited", F.col("shared") + 1, F.col("size")), F.col("shared").cast("long"))
    rows = rows.select("part", "row", "doc_id", "size", "shared", F.sha2("edited", 256).alias("edited_sha256"), hashed(F.col("text"), F.lit(0).cast("long")).alias("_h"), rest.alias("_rest"))
    rows = rows.select("part", "row", "doc_id", "edited_sha256", F.col("size").cast("long").alias("n_chars"), "_h", F.concat(F.slice("_h", F.lit(1), F.col("shared")), "_rest").alias("_e"))
    rows = components(rows, "_h", "own", ["part", "row", "doc_id", "n_chars", "edited_sha256", "_e"])
    rows = components(rows, "_e", "other", ["part", "row", "doc_id", "n_chars", "edited_sha256", "own"])
    out = rows.join(ends.select("part", "head_sig"), "part")
    out = out.withColumn("after", F.coalesce(F.lead("own").over(Window.partitionBy("part").orderBy("row")), "head_sig"))
    return out.select(
        c.shown_id("doc_id").alias("doc_id"), "n_chars", "edited_sha256", shown("own").alias("fingerprint"), shown("other").alias("edited_fingerprint"),
        likeness("own", "other").alias("near_edited"), likeness("own", "after").alias("near_next"),
    )
