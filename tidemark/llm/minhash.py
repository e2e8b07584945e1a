"""MinHash near-duplicates: many universal hash minima with banding, signature verification, exact confirmation on
whole shingle sets, and connected components by alternating large-star and small-star.

Plan.  (1) One pass over the text writes a row per document: set size, a 128-bit key of the set, 16-bit signature and
band keys.  (2) Documents with equal sets are one *node*, by a partial aggregate that keeps the smallest id and one text,
so a group of exact copies never meets in a task.  Nodes have numbers of their own: an id that occurs with several texts
belongs to several nodes, and ids need not be unique or known.  (3) Nodes meet in bands.  Each band bucket proposes only links
to a centre, the member whose own buckets are fullest (an original is in more full buckets than its edited copies), so
a bucket of n gives n-1 links, not n*n.  (4) Links pass the signature, then the exact sets.  (5) Components follow.  A pair
inside one component can't change the result; buckets that still hold several components are searched for links
across them, exactly and without emitting pairs, by an inverted index of shingles over blocks of bounded size.

Edge cases: null or blank text has no shingles and links with nothing; a null id is smaller than any other and shown as
null; rows of one id with different texts are documents of their own, which link only by their texts; repeated rows of
one id with one text give repeated result rows; any long is an id; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import _common as c

BANDS, ROWS = 30, 5
#: Signature agreement may be this much under the threshold before a pair is refused (over five standard errors).
MARGIN = 0.18
#: Shingles of the documents that one task of the last step holds at once.
BLOCK = 2_000_000
_SEEDS = np.random.Generator(np.random.PCG64(77)).integers(1, 1 << 62, (2, BANDS * ROWS), dtype=np.int64).astype(np.uint64)


def signatures(sets: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Minima of BANDS*ROWS universal hashes (multiply, add, keep the high half) over each set; empty sets give maxima."""
    n = len(at) - 1
    out = np.full((BANDS * ROWS, n), 0xFFFFFFFF, np.uint32)
    full = np.flatnonzero(np.diff(at) > 0)
    if len(full):
        starts = at[full]
        with np.errstate(over="ignore"):
            for j in range(BANDS * ROWS):
                h = ((sets * (_SEEDS[0, j] | np.uint64(1)) + _SEEDS[1, j]) >> np.uint64(32)).astype(np.uint32)
                out[j, full] = np.minimum.reduceat(h, starts)
    return out


SKETCH = "doc_id long, print long, n_shingles long, k1 long, k2 long, sig binary, bands array<long>"


def _sketch(batches):
    for b in batches:
        data, offs = c.buffers(b["text"])
        for lo, hi in c.slices(offs):
            d, o = data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
            starts, ends, row = c.word_spans(d, o)
            sets, at = c.row_sets(*c.shingle_hashes(c.word_hashes(d, starts, ends), row))
            n, size = hi - lo, np.diff(at)
            sig = signatures(sets, at)
            with np.errstate(over="ignore"):
                total = np.concatenate([[np.uint64(0)], np.cumsum(sets)])
                twist = np.concatenate([[np.uint64(0)], np.cumsum(c.mix(sets ^ np.uint64(0xA5A5A5A5)))])
                k1 = c.mix(total[at[1:]] - total[at[:-1]] + size.astype(np.uint64))
                k2 = c.mix(twist[at[1:]] - twist[at[:-1]])
                bands = np.zeros((n, BANDS), np.int64)
                for band in range(BANDS):
                    key = np.full(n, band + 1, np.uint64)
                    for j in range(ROWS):
                        key = c.mix(key * np.uint64(0x9E3779B97F4A7C15) + sig[band * ROWS + j])
                    bands[:, band] = key.view(np.int64)
            low = np.ascontiguousarray((sig & 0xFFFF).astype(np.uint16).T)
            yield pa.RecordBatch.from_arrays(
                [
                    b["doc_id"].slice(lo, n), b["print"].slice(lo, n), pa.array(size.astype(np.int64)), pa.array(k1.view(np.int64)), pa.array(k2.view(np.int64)),
                    pa.array([r.tobytes() for r in low], pa.binary()),
                    pa.ListArray.from_arrays(pa.array(np.arange(0, n * BANDS + 1, BANDS, dtype=np.int32)), pa.array(bands.reshape(-1))),
                ],
                ["doc_id", "print", "n_shingles", "k1", "k2", "sig", "bands"],
            )


def _agree(least: float):
    def run(batches):
        for b in batches:
            if b.num_rows:
                x, y = (np.frombuffer(c.buffers(b[k])[0], np.uint16).reshape(b.num_rows, -1) for k in ("sa", "sb"))
                ok = (x == y).mean(1) >= least
                yield pa.RecordBatch.from_arrays([b["a"].filter(pa.array(ok)), b["b"].filter(pa.array(ok))], ["a", "b"])

    return run


def _confirm(percent: int):
    """Exact test on whole shingle sets of both texts; rows of one centre come together, so its set is kept."""

    def of(text):
        d = np.frombuffer(text, np.uint8)
        o = np.array([0, len(d)])
        starts, ends, row = c.word_spans(d, o)
        return np.unique(c.shingle_hashes(c.word_hashes(d, starts, ends), row)[0])

    def run(batches):
        last, kept = None, None
        for b in batches:
            pairs, ok = list(zip(b["a"].to_pylist(), b["ta"], b["tb"])), []
            for a, ta, tb in pairs:
                if a != last:
                    last, kept = a, of((ta.as_py() or "").encode())
                other = of((tb.as_py() or "").encode())
                both = len(np.intersect1d(kept, other, assume_unique=True))
                ok.append(100 * both >= percent * (len(kept) + len(other) - both))
            mask = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([b["a"].filter(mask), b["b"].filter(mask)], ["a", "b"])

    return run


def components(edges: DataFrame, most: int = 60) -> DataFrame:
    """Smallest id reachable from each id of undirected edges (a, b): (node, root), by alternating large-star and
    small-star until the edge set no longer changes.  Minima are partial aggregates and joins, never whole lists."""
    both = lambda e: e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    mark = lambda e: tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    e = c.written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    was = mark(e)
    for _ in range(most):
        if not was[0]:
            break
        near = both(e)
        low = near.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = near.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        low = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
        before, e = e, c.written(small.where("a <> b").distinct(), "edges")
        c.discard(before)
        now = mark(e)
        if now == was:
            break
        was = now
    else:
        raise RuntimeError("components did not settle")
    roots = e.groupBy("a").agg(F.min("b").alias("root")).select(F.col("a").alias("node"), "root")
    return roots.unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def _rest(bucket: DataFrame, root: DataFrame) -> DataFrame:
    """Documents of buckets that hold several components, as rows of block pairs: (cluster, lb, rb, side, node, root).

    A cluster joins such buckets; its largest component is at peace with itself, so only its other documents (side 1)
    look for links, among all documents of the cluster (side 0).  Both sides come in blocks of BLOCK shingles."""
    at = bucket.join(root, "node", "left").select("band", "node", "n_shingles", F.coalesce("root", "node").alias("root"))
    several = at.groupBy("band").agg(F.min("root").alias("r1"), F.max("root").alias("r2"), F.min("node").alias("head")).where("r1 < r2")
    at = c.written(at.join(several, "band").select("node", "n_shingles", "root", "head"), "unsettled")
    near = components(at.select(F.col("node").alias("a"), F.col("head").alias("b")))
    member = at.select("node", "n_shingles", "root").distinct().join(near.select("node", F.col("root").alias("cluster")), "node")
    member = c.written(member, "members")
    size = member.groupBy("cluster", "root").agg(F.sum("n_shingles").alias("n"))
    size = size.groupBy("cluster").agg(F.max_by("root", "n").alias("main"), F.sum("n").alias("n"), F.max("n").alias("most"))
    blocks = lambda n: F.ceil(n / F.lit(BLOCK)).cast("long")
    size = size.select("cluster", "main", F.greatest(F.lit(1), blocks(F.col("n") - F.col("most"))).alias("nl"), F.greatest(F.lit(1), blocks(F.col("n"))).alias("nr"))
    member = member.join(size, "cluster")
    lot = lambda n: F.pmod(F.xxhash64("node"), F.col(n))
    seek = member.where("root <> main").select("cluster", lot("nl").alias("lb"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("nr") - 1)).alias("rb"), F.lit(1).alias("side"), "node", "root")
    held = member.select("cluster", F.explode(F.sequence(F.lit(0).cast("long"), F.col("nl") - 1)).alias("lb"), lot("nr").alias("rb"), F.lit(0).alias("side"), "node", "root")
    return held.unionByName(seek)


def _across(rest: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) across components: for each seeking document and component one confirmed link in each block."""
    spark = rest.sparkSession
    rows = rest.join(texts, "node").select("cluster", "lb", "rb", "side", "node", "root", "text")
    rows = rows.repartition(c.shuffle_width(spark), "cluster", "lb", "rb").sortWithinPartitions("cluster", "lb", "rb", "side")

    def sets_of(texts):
        data, offs = c.buffers(texts)
        sets, sizes = [np.zeros(0, np.uint64)], [np.zeros(1, np.int64)]
        for lo, hi in c.slices(offs):  # working arrays are many times the text
            d, o = data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
            starts, ends, row = c.word_spans(d, o)
            s, at = c.row_sets(*c.shingle_hashes(c.word_hashes(d, starts, ends), row))
            sets.append(s)
            sizes.append(np.diff(at))
        return np.concatenate(sets), np.cumsum(np.concatenate(sizes))

    def run(batches):
        group, held, index = None, [], None
        for b in batches:
            keys = np.stack([b[k].to_numpy() for k in ("cluster", "lb", "rb", "side")], 1)
            cut = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]).any(1)])) if len(keys) else []
            for lo, hi in zip(cut, [*cut[1:], len(keys)]):
                sets, at = sets_of(b["text"].slice(lo, hi - lo))
                ids, roots = b["node"].to_numpy()[lo:hi], b["root"].to_numpy()[lo:hi]
                if tuple(keys[lo][:3]) != group:
                    group, held, index = tuple(keys[lo][:3]), [], None
                if keys[lo][3] == 0:
                    held.append((sets, np.diff(at), ids, roots))
                    continue
                if not held:
                    continue
                if index is None:
                    size, own, root = (np.concatenate([h[j] for h in held]) for j in (1, 2, 3))
                    every, doc = np.concatenate([h[0] for h in held]), np.repeat(np.arange(len(size)), size)
                    order = np.argsort(every, kind="stable")
                    every, doc = every[order], doc[order]
                    index = True
                found = []
                for k in range(len(ids)):
                    x = sets[at[k] : at[k + 1]]
                    p, q = np.searchsorted(every, x, "left"), np.searchsorted(every, x, "right")
                    n = q - p
                    hits = doc[np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(p, n)]
                    both = np.bincount(hits, minlength=len(size))
                    ok = np.flatnonzero((100 * both >= percent * (len(x) + size - both)) & (root != roots[k]))
                    found += [(ids[k], own[j]) for j in ok[np.unique(root[ok], return_index=True)[1]]]
                if found:
                    a, z = zip(*found)
                    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(z, pa.int64())], ["a", "b"])

    return rows.mapInArrow(run, "a long, b long")


def groups(docs: DataFrame, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each document: doc_id, print (hash of the whole text), n_shingles, node and root, component (smallest
    id of the root's documents, as a struct that sorts null first).  Documents link when
    100 * intersection >= percent * union of their shingle sets; without shingles node and root are null."""
    if not 50 <= percent <= 100:
        raise ValueError("the bands are laid out for thresholds of 50 to 100 percent")
    docs = docs.select(F.col(key).cast("long").alias("doc_id"), F.xxhash64(F.col(text).cast("string")).alias("print"), F.col(text).cast("string").alias("text"))
    sketch = c.written(docs.mapInArrow(_sketch, SKETCH), "sketch")
    inked = sketch.where("n_shingles > 0").withColumn("id", F.struct(F.col("doc_id").isNotNull().alias("given"), "doc_id"))
    # one document stands for a set: its id and text, its signature and bands
    whole = F.struct("id", "print", "n_shingles", "sig", "bands")
    reps = inked.groupBy("k1", "k2").agg(F.min(F.struct("id", "print")).alias("least"))
    held = inked.join(reps, ["k1", "k2"]).where("id = least.id and print = least.print").groupBy("k1", "k2").agg(F.min(whole).alias("r"))
    held = c.written(held.select("k1", "k2", "r.*", F.monotonically_increasing_id().alias("node")), "reps")
    member = held.select("node", "n_shingles", F.explode("bands").alias("band"))
    full = member.groupBy("band").agg(F.count("*").alias("n")).where("n > 1")
    bucket = c.written(member.join(full, "band"), "buckets")
    score = bucket.groupBy("node").agg(F.sum("n").alias("score"))
    met, bucket = bucket, c.written(bucket.join(score, "node").select("band", "node", "n_shingles", "score"), "scored")
    c.discard(met)
    met = held.join(bucket.select("node").distinct(), "node", "left_semi").select("node", F.col("id.doc_id").alias("rep"), F.col("print").alias("p"))
    texts = docs.join(met.hint("shuffle_hash"), docs.doc_id.eqNullSafe(F.col("rep")) & (F.col("print") == F.col("p"))).groupBy("node").agg(F.min_by("text", F.lit(0)).alias("text"))
    texts = c.written(texts, "texts")
    sigs = held.select("node", "sig")
    centre = bucket.groupBy("band").agg(F.max_by("node", F.struct("score", F.bitwise_not("node"))).alias("a"))
    pairs = bucket.join(centre, "band").where("a <> node").select("a", F.col("node").alias("b")).distinct()
    alike = (
        pairs.join(sigs.select(F.col("node").alias("a"), F.col("sig").alias("sa")), "a")
        .join(sigs.select(F.col("node").alias("b"), F.col("sig").alias("sb")), "b")
        .select("a", "b", "sa", "sb").mapInArrow(_agree(percent / 100 - MARGIN), "a long, b long")
    )
    links = c.written(
        alike.join(texts.select(F.col("node").alias("b"), F.col("text").alias("tb")), "b")
        .join(texts.select(F.col("node").alias("a"), F.col("text").alias("ta")), "a")
        .select("a", "b", "ta", "tb").mapInArrow(_confirm(percent), "a long, b long"), "links",
    )
    root = c.written(components(links), "roots")
    rest = c.written(_rest(bucket, root), "rest")
    if not rest.isEmpty():
        more = c.written(_across(rest, texts, percent), "links")
        first, root = root, c.written(components(links.unionByName(more)), "roots")
        c.discard(first, more)
    c.discard(rest, texts, links, bucket)
    named = held.select("k1", "k2", "node", "id").join(root, "node", "left").withColumn("root", F.coalesce("root", "node"))
    named = c.written(named, "named")
    c.discard(held, root)
    named = named.drop("id").join(named.groupBy("root").agg(F.min("id").alias("component")), "root")
    out = sketch.select("doc_id", "print", "n_shingles", "k1", "k2").join(named, ["k1", "k2"], "left")
    return out.select("doc_id", "print", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("node")).alias("node"), F.when(F.col("n_shingles") > 0, F.col("root")).alias("root"), F.when(F.col("n_shingles") > 0, F.col("component")).alias("component"))


def near_duplicates(docs: DataFrame, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each document: doc_id, n_shingles, component_id (smallest id reachable), kept (it is the smallest)."""
    out = groups(docs, percent, key, text)
    own = F.coalesce(F.col("component"), F.struct(F.col("doc_id").isNotNull().alias("given"), "doc_id"))["doc_id"]
    return out.select("doc_id", "n_shingles", own.alias("component_id"), F.col("doc_id").eqNullSafe(own).alias("kept"))


def one_of_each(docs: DataFrame, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs, all columns, without near-duplicates: of each group the document with the smallest id (of equal
    ids the text with the smallest hash) stays, and all documents without shingles.  Rows that are equal in id and text
    stay or go together."""
    met = groups(docs, percent, key, text)
    best = met.where("root is not null").groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNotNull().alias("given"), "doc_id", "print")).alias("best"))
    bare = met.where("root is null").select("doc_id", "print")
    kept = best.select("best.doc_id", "best.print").unionByName(bare).distinct().select(F.col("doc_id").alias("kept_id"), F.col("print").alias("kept_print"))
    same = docs[key].cast("long").eqNullSafe(F.col("kept_id")) & (F.xxhash64(docs[text].cast("string")) == F.col("kept_print"))
    return docs.join(kept.hint("shuffle_hash"), same, "left_semi")
