"""Near-duplicate embeddings: cross-polytope hashes after fast Hadamard rotations, multiprobe buckets, verified pairs.

Plan.  (1) A vector is hashed in each table by `hashes` functions: three rounds of sign flips and a Hadamard transform, then
the signed axis that lies nearest.  It enters its own bucket and those where one function takes its second-best axis.
What is dealt out is (bucket, sketch), the sketch being the signs of 64 rotated coordinates: no vector, no id.  (2) Rows are
dealt by range of (bucket, sketch), so a full bucket is cut over tasks; within a bucket sketches few bits apart are tied to a
common one, and ties across a cut are made from the few sketches at each task's ends.  (3) Ties make clusters of candidates
(large-star and small-star).  (4) Equal vectors of one label are one node, by an aggregate; the nodes of a cluster meet in
pairs of blocks of bounded size, where all cosines are computed in double precision.  A task sends the number of links of
each node and one edge to the smallest node it reaches there, so no pair leaves a task.  (5) Components from these edges.

Recall.  A function keeps its axis for a pair of cosine 0.98 with a chance of some 0.78 (64 dimensions) and moves to the second-best
with 0.17.  `hashes` grows with the logarithm of the table, so that buckets hold a bounded number of unrelated vectors, and
`tables` with it, so that the chance to miss such a pair stays under 1e-4; within a dense group a chain of other pairs ties
what one bucket missed.  Sketches of such a pair differ in 4 of 64 bits (deviation 2); more than 16 are not tied.

Skew.  One very common vector is a node; near copies share buckets, which are cut by range, and blocks, which are bounded.
Within a dense group the number of cosines grows with its square, as the count of links demands; rows don't.

Edge cases: a null label, or a vector that is null, empty, zero or holds null or non-finite components, links with nothing;
vectors of different lengths don't link; repeated rows are vectors of their own and link; a null vec_id is smaller than
any other and shown as null; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import _common as c
from tidemark.llm import minhash

#: Chances that a function keeps its axis, or takes the second-best, at the threshold; chance to miss that tables are made for.
KEEPS, SECOND, MISS = 0.78, 0.17, 1e-4
#: Bits in which sketches of candidates may differ; sketches compared at once; nodes of a block.
APART, LOT, BLOCK = 16, 512, 2048


def layout(rows: int, dim: int = 64) -> tuple[int, int]:
    """(hashes, tables) for a table of so many rows: buckets outnumber the rows, misses stay under MISS."""
    hashes = max(3, math.ceil(math.log(max(rows, 2)) / math.log(2 * max(dim, 2))))
    met = KEEPS**hashes + hashes * KEEPS ** (hashes - 1) * SECOND
    return hashes, math.ceil(math.log(MISS) / math.log(1 - met))


def hadamard(x: np.ndarray) -> np.ndarray:
    """Rows times the Hadamard matrix of their length, a power of two, in log steps."""
    n, dim, h = len(x), x.shape[1], 1
    while h < dim:
        y = x.reshape(n, dim // (2 * h), 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], 2).reshape(n, dim)
        h *= 2
    return x


def rotated(x: np.ndarray, seed: int) -> np.ndarray:
    rng = np.random.Generator(np.random.PCG64(seed))
    for _ in range(3):
        x = hadamard(x * rng.choice(np.array([-1.0, 1.0]), x.shape[1])) / math.sqrt(x.shape[1])
    return x


def padded(x: np.ndarray) -> np.ndarray:
    """Vectors with zeros up to a power of two; cosines stay."""
    return np.pad(x, ((0, 0), (0, max(8, 1 << (x.shape[1] - 1).bit_length()) - x.shape[1])))


def sketches(x: np.ndarray) -> np.ndarray:
    """Signs of 64 rotated coordinates of each vector, as one word."""
    x = padded(x)
    bits = np.concatenate([rotated(x, 10**6 + j) for j in range(-(-64 // x.shape[1]))], 1)[:, :64] > 0
    return np.packbits(bits, axis=1).view(np.uint64).ravel()


def buckets(x: np.ndarray, salt: np.ndarray, hashes: int, tables: int) -> np.ndarray:
    """Bucket keys of vectors of one length: a row a vector, tables * (hashes + 1) of them."""
    x = padded(x)
    keys, rows = [], np.arange(len(x))
    with np.errstate(over="ignore"):
        for t in range(tables):
            best, second = [], []
            for k in range(hashes):
                y = rotated(x, 1000 * t + k + 1)
                size = np.abs(y)
                axes = np.argpartition(-size, 1, axis=1)[:, :2]
                swap = size[rows, axes[:, 0]] < size[rows, axes[:, 1]]
                axes[swap] = axes[swap][:, ::-1]
                one, two = (2 * axes[:, j] + (y[rows, axes[:, j]] < 0) for j in (0, 1))
                best.append(one.astype(np.uint64))
                second.append(two.astype(np.uint64))
            for probe in range(-1, hashes):
                key = c.mix(salt + np.uint64(7919 * t + 1))
                for k in range(hashes):
                    key = c.mix(key * np.uint64(0x9E3779B97F4A7C15) + (second if k == probe else best)[k])
                keys.append(key)
    return np.stack(keys, 1)


def _rectangle(vectors: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Rows by length of vector: (row numbers, scaled matrix); components are finite."""
    offs = np.asarray(vectors.offsets)
    flat, size = np.asarray(vectors.values)[offs[0] : offs[-1]], np.diff(offs)
    out = {}
    for dim in np.unique(size):
        at = np.flatnonzero(size == dim)
        m = flat[(offs[at] - offs[0])[:, None] + np.arange(dim)].astype(np.float64)
        out[int(dim)] = (at, m / np.abs(m).max(1, keepdims=True))
    return out


def _hash_rows(rows: int):
    def run(batches):
        for b in batches:
            label = c.longs(b["label"]).view(np.uint64)
            for dim, (at, m) in _rectangle(b["embedding"]).items():
                for lo in range(0, len(at), 4096):
                    own = slice(lo, lo + 4096)
                    with np.errstate(over="ignore"):
                        salt = c.mix(label[at[own]] * np.uint64(131) + np.uint64(dim))
                    keys = buckets(m[own], salt, *layout(rows, dim))
                    pair = np.stack([keys.ravel(), np.repeat(sketches(m[own]), keys.shape[1])], 1).view(np.int64)
                    pair = np.unique(pair, axis=0)  # copies in a batch are one row
                    yield pa.RecordBatch.from_arrays([pa.array(pair[:, 0]), pa.array(pair[:, 1])], ["bucket", "sketch"])

    return run


def _sketched(batches):
    for b in batches:
        out = np.zeros(b.num_rows, np.uint64)
        for at, m in _rectangle(b["embedding"]).values():
            out[at] = sketches(m)
        yield pa.RecordBatch.from_arrays([b["vec_id"], b["label"], b["k1"], b["k2"], pa.array(out.view(np.int64))], ["vec_id", "label", "k1", "k2", "sketch"])


def _tied(sketch: np.ndarray, leaders: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Edges (a, b) that tie sketches near each other, or near a leader, and the leaders afterwards."""
    a, b = [], []
    for lo in range(0, len(sketch), LOT):
        s = np.concatenate([leaders, sketch[lo : lo + LOT]])
        near = np.bitwise_count(s[:, None] ^ s[None, :]) <= APART
        root = near.argmax(1)  # smallest place that is near
        while (further := root[root]).tolist() != root.tolist():
            root = further
        least = np.where(near, root[None, :], len(s)).min(1)  # a neighbour may have a smaller root: tie the two
        a += [s, s]
        b += [s[root], s[least]]
        leaders = s[np.unique(root)]
    a, b = (np.concatenate(x) if x else np.zeros(0, np.uint64) for x in (a, b))
    return a[a != b], b[a != b], leaders


def _meet(ends: bool):
    """Rows (bucket, sketch) come sorted.  Gives kind 0: a tie (a, b); kind 1 (if `ends`): a bucket and a leader of it, for the
    first and the last bucket of the task, which other tasks may hold too."""

    def out(kind, a, b):
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind, np.int64)), pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["kind", "a", "b"])

    def run(batches):
        now, leaders, first = None, np.zeros(0, np.uint64), True
        for b in batches:
            keys, sketch = b["bucket"].to_numpy(), b["sketch"].to_numpy().view(np.uint64)
            cut = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
            size = np.diff(np.append(cut, len(keys)))
            ties_a, ties_b = [], []
            worth = size > 1  # a sketch alone has nothing to be tied to, unless another batch goes on with its bucket
            worth[[0, -1] if len(worth) else []] = True
            for lo, n in zip(cut[worth], size[worth]):
                if keys[lo] != now:
                    if now is not None and first and ends:
                        yield out(1, np.full(len(leaders), now, np.int64), leaders)
                    first = first and now is None
                    now, leaders = keys[lo], np.zeros(0, np.uint64)
                ta, tb, leaders = _tied(sketch[lo : lo + n], leaders)
                ties_a.append(ta)
                ties_b.append(tb)
            if ties_a:
                yield out(0, np.concatenate(ties_a), np.concatenate(ties_b))
        if now is not None and ends:
            yield out(1, np.full(len(leaders), now, np.int64), leaders)

    return run


def _linked(least: float):
    """Nodes of a pair of blocks: how many vectors each links with there, and the smallest node it reaches there."""

    def settle(key, group):
        """group: (own block, node, copies, matrix) parts of one pair of blocks."""
        lot, node, copies, m = (np.concatenate([g[k] for g in group]) for k in range(4))
        i, j = np.flatnonzero(lot == key[2]), np.flatnonzero(lot == key[3])
        size = np.linalg.norm(m, axis=1)
        link = (m[i] @ m[j].T) / (size[i][:, None] * size[j][None, :]) >= least
        total = np.zeros(len(node), np.int64)
        if not link.size:
            return
        if key[2] == key[3]:
            np.fill_diagonal(link, False)
        else:
            total[j] += copies[i] @ link
        total[i] += link @ copies[j]
        root = node.copy()
        while True:  # smallest node reached, by neighbours' minima until nothing moves
            was = root.copy()
            top = np.iinfo(np.int64).max
            root[i] = np.minimum(root[i], np.where(link, root[j][None, :], top).min(1))
            root[j] = np.minimum(root[j], np.where(link, root[i][:, None], top).min(0))
            if (root == was).all():
                break
        if (ok := total > 0).any():
            yield pa.RecordBatch.from_arrays([pa.array(node[ok]), pa.array(total[ok]), pa.array(root[ok])], ["node", "links", "root"])

    def run(batches):
        now, group = None, []
        for b in batches:
            keys = np.stack([b[k].to_numpy() for k in ("grp", "label", "i", "j")], 1)
            dims = np.diff(np.asarray(b["embedding"].offsets))
            cut = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]).any(1) | (dims[1:] != dims[:-1])])) if len(keys) else []
            for lo, hi in zip(cut, [*cut[1:], len(keys)]):
                key = (*keys[lo], dims[lo])
                if key != now:
                    if group:
                        yield from settle(now, group)
                    now, group = key, []
                ((_, m),) = _rectangle(b["embedding"].slice(lo, hi - lo)).values()
                group.append((b["lot"].to_numpy()[lo:hi], b["node"].to_numpy()[lo:hi], b["copies"].to_numpy()[lo:hi], m))
        if group:
            yield from settle(now, group)

    return run


def near_duplicates(vectors: DataFrame, threshold: float = 0.98, key: str = "vec_id", vector: str = "embedding", label: str = "label", block: int = BLOCK) -> DataFrame:
    """One row for each vector: vec_id, n_links (other vectors of cosine >= threshold and the same label), component_id (smallest
    vec_id reachable by links), kept (it is the smallest)."""
    if not 0.98 <= threshold <= 1:
        raise ValueError("the tables are laid out for cosines of 0.98 or more")
    spark = vectors.sparkSession
    width, rows = c.shuffle_width(spark), vectors.count()
    v, lab = F.col("embedding"), F.col("label")
    fit = F.size(v) > 0
    fit = fit & lab.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    kind = vectors.schema[vector].dataType.simpleString()
    kept = F.col(vector) if kind in ("array<float>", "array<double>") else F.col(vector).cast("array<double>")
    base = vectors.select(F.col(key).cast("long").alias("vec_id"), kept.alias("embedding"), F.col(label).cast("long").alias("label"))
    base = base.withColumn("fit", F.coalesce(fit, F.lit(False)))
    named = base.where("fit").select("vec_id", "label", F.xxhash64("label", "embedding").alias("k1"), F.xxhash64("embedding", "label").alias("k2"), "embedding")
    met = base.where("fit").select("label", "embedding").mapInArrow(_hash_rows(rows), "bucket long, sketch long")
    met = met.repartitionByRange(width, "bucket", "sketch").sortWithinPartitions("bucket", "sketch").mapInArrow(_meet(True), "kind long, a long, b long")
    met = c.written(met, "met")
    across = met.where("kind = 1").select(F.col("a").alias("bucket"), F.col("b").alias("sketch"))
    across = across.repartition(width, "bucket").sortWithinPartitions("bucket", "sketch").mapInArrow(_meet(False), "kind long, a long, b long")
    ties = c.written(met.where("kind = 0").unionByName(across).select("a", "b").distinct(), "ties")
    c.discard(met)
    cluster = c.written(minhash.components(ties), "clusters")
    # equal vectors of one label are a node; nodes of one sketch, or of tied ones, are a cluster
    node = named.mapInArrow(_sketched, "vec_id long, label long, k1 long, k2 long, sketch long")
    small = F.min(F.struct(F.col("vec_id").isNotNull().alias("given"), "vec_id")).alias("least")
    node = node.groupBy("k1", "k2", "label", "sketch").agg(F.count("*").alias("copies"), small)
    node = node.join(cluster.select(F.col("node").alias("sketch"), F.col("root").alias("grp")), "sketch", "left")
    node = c.written(node.select("k1", "k2", "label", "copies", "least", F.coalesce("grp", "sketch").alias("grp"), F.monotonically_increasing_id().alias("node")), "nodes")
    c.discard(cluster, ties)
    full = node.groupBy("grp", "label").agg(F.count("*").alias("n")).where("n > 1").select("grp", "label", F.ceil(F.col("n") / F.lit(block)).cast("int").alias("nb"))
    seek = c.written(node.join(full, ["grp", "label"]).select("k1", "k2", "copies", "node", "label", "least", "grp", "nb", F.pmod(F.xxhash64("node"), F.col("nb").cast("long")).cast("int").alias("lot")), "seeking")
    # one vector for each node: the row of the smallest id, of equal ids and keys any
    one = seek.select(F.col("k1").alias("q1"), F.col("k2").alias("q2"), "node", "copies", "grp", "nb", "lot", F.col("least.vec_id").alias("rep"))
    held = named.join(one, (F.col("k1") == F.col("q1")) & (F.col("k2") == F.col("q2")) & F.col("vec_id").eqNullSafe(F.col("rep")))
    held = held.groupBy("node", "copies", "grp", "label", "nb", "lot").agg(F.first("embedding").alias("embedding"))
    other = F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("other")
    held = held.select("*", other).select("grp", "label", F.least("lot", "other").alias("i"), F.greatest("lot", "other").alias("j"), "lot", "node", "copies", "embedding")
    held = held.select(*[F.col(k).cast("long").alias(k) for k in ("grp", "label", "i", "j", "lot")], "node", "copies", "embedding", F.size("embedding").alias("dim"))
    held = held.repartition(width, "grp", "label", "i", "j").sortWithinPartitions("grp", "label", "i", "j", "dim").drop("dim")
    link = c.written(held.mapInArrow(_linked(threshold), "node long, links long, root long"), "links")
    root = c.written(minhash.components(link.select(F.col("node").alias("a"), F.col("root").alias("b"))), "roots")
    many = link.groupBy("node").agg(F.sum("links").alias("links"))
    named_node = node.select("k1", "k2", "node", "copies", "least").join(many, "node", "left").join(root, "node", "left")
    named_node = c.written(named_node.select("k1", "k2", "least", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "node").alias("root")), "named")
    c.discard(seek, link, root, node)
    comp = named_node.groupBy("root").agg(F.min("least").alias("component"))
    info = named_node.join(comp, "root").select(F.col("k1").alias("q1"), F.col("k2").alias("q2"), "n_links", "component")
    keyed = base.select("vec_id", F.when(F.col("fit"), F.xxhash64("label", "embedding")).alias("k1"), F.when(F.col("fit"), F.xxhash64("embedding", "label")).alias("k2"))
    out = keyed.join(info, (F.col("k1") == F.col("q1")) & (F.col("k2") == F.col("q2")), "left")
    own = F.coalesce("component", F.struct(F.col("vec_id").isNotNull().alias("given"), "vec_id"))["vec_id"]
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), own.alias("component_id"), F.col("vec_id").eqNullSafe(own).alias("kept"))
