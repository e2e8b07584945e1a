"""A prefix trie of conversations: nodes are distinct sequences of first turns, subtree totals go up from the leaves.

Plan.  (1) Every turn becomes a digest and a count of words; text is read once and never shuffled.  Turns are dealt by
range of (conversation, turn), so a conversation of any length is cut over tasks, and their places are row numbers less
where the conversation begins.  (2) Conversations are rebuilt: at most three turns of their family's first one, then their
own.  (3) The key of a prefix is four sums of 31-bit hashes of (turn, depth): running sums within blocks of 4,096 turns, plus
the sums of earlier blocks.  (4) Nodes are a partial aggregate of prefixes by key, so members of a common first turn never
meet.  (5) *Leaf peeling.*  A node's representative is the member with the smallest hash; nodes with one representative
are a chain along its conversation, and a chain is one sender of messages: it keeps a counter of the chains that hang from
its nodes, and when all have reported, it sends its own totals to the node it hangs from, until only the root's chain is
left.  Random representatives keep the nesting of chains logarithmic in the number of conversations (expected), whatever the depth of
the trie.  Within a chain, totals are running sums from the end, by blocks again.  (6) The ids that end at a node are
joined in pieces of at most 8,192 ids and hashed in order, piece by piece.

Skew.  A node with a third of all members is a sum; its children's look-up of their parent is a join that adaptive
execution splits (one row on the other side); hot conversations are blocks; long lists of ids are pieces.

Edge cases: null turns come first, null roles and texts are empty; turns of equal number are ordered by their digest, and
repeated rows are turns of their own; rows without conv_id belong to no conversation and are left out; an empty table
gives no nodes; texts are read whole; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm import _common as c

FAMILY, HEADS = 20, 4
BLOCK, PIECE = 4096, 8192
KEY = ["k1", "k2", "k3", "k4"]


def _turns(chats: DataFrame) -> DataFrame:
    """(conv_id, pos from 0, digest, words) of every turn, and nothing longer than a digest is dealt out."""
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = chats.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.unhex(F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text), 256)).alias("digest"),
        F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")).cast("long").alias("words"),
    )
    rows = c.written(rows, "turns")
    order = [F.asc("conv_id"), F.asc_nulls_first("turn"), F.asc("digest")]
    placed = c.written(rows.repartitionByRange(c.shuffle_width(chats.sparkSession), *order).sortWithinPartitions(*order).withColumn("row", F.monotonically_increasing_id()).drop("turn"), "placed")
    part = F.shiftright("row", 33).alias("part")
    spans = placed.groupBy("conv_id", part).agg(F.min("row").alias("head"), F.count("*").alias("n"))
    earlier = F.coalesce(F.sum("n").over(Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    spans = spans.select("conv_id", "part", (earlier - F.col("head")).alias("shift"))  # a row for each task that a conversation spans
    out = c.written(placed.withColumn("part", part).join(spans, ["conv_id", "part"]).select("conv_id", (F.col("row") + F.col("shift")).alias("pos"), "digest", "words"), "turns")
    c.discard(rows, placed)
    return out


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations (conv_id, turns) and their rebuilt turns (conv_id, depth, digest, words)."""
    base = (F.col("conv_id") - F.col("conv_id") % FAMILY).alias("base")
    taken = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS).alias("h")
    convs = turns.groupBy("conv_id").agg(F.count("*").alias("own")).select("conv_id", "own", base, taken)
    first = convs.where("conv_id = base").select(F.col("conv_id").alias("base"), F.col("own").alias("there"))
    convs = convs.join(first, "base", "left").withColumn("k", F.least("h", F.coalesce("there", F.lit(0))))
    convs = c.written(convs.select("conv_id", "base", "h", "k", (F.col("k") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("turns")), "convs")
    heads = turns.where((F.col("pos") < HEADS - 1) & (F.col("conv_id") % FAMILY == 0)).select(F.col("conv_id").alias("base"), "pos", "digest", "words")
    shared = convs.join(heads, "base").where("pos < h").select("conv_id", (F.col("pos") + 1).alias("depth"), "digest", "words")
    own = turns.join(convs.select("conv_id", "h", "k"), "conv_id").where("pos >= h").select("conv_id", (F.col("k") + F.col("pos") - F.col("h") + 1).alias("depth"), "digest", "words")
    return convs.select("conv_id", "turns"), own.unionByName(shared)


def _running(rows: DataFrame, group: str, names: list[str], descending: bool = False) -> DataFrame:
    """Running sums of the columns along depth within each group, as columns of the same names after 'to_'.  A window holds one
    block of depths; blocks before it are added as one row."""
    rows = rows.withColumn("block", F.floor((F.col("depth")) / F.lit(BLOCK)))
    order = F.desc if descending else F.asc
    here = Window.partitionBy(group, "block").orderBy(order("depth")).rowsBetween(Window.unboundedPreceding, 0)
    total = rows.groupBy(group, "block").agg(*[F.sum(x).alias(x) for x in names])
    before = Window.partitionBy(group).orderBy(order("block")).rowsBetween(Window.unboundedPreceding, -1)
    total = total.select(group, "block", *[F.coalesce(F.sum(x).over(before), F.lit(0)).alias(f"was_{x}") for x in names])
    out = rows.select("*", *[F.sum(x).over(here).alias(f"to_{x}") for x in names]).join(total, [group, "block"])
    return out.select(*[x for x in rows.columns if x != "block"], *[(F.col(f"to_{x}") + F.col(f"was_{x}")).alias(f"to_{x}") for x in names])


def _hashed(batches):
    """SHA-256 of each node's pieces, which come sorted; a digest takes one piece at a time."""
    node, state = None, None

    def out(rows):
        return pa.RecordBatch.from_pylist(rows, schema=pa.schema([*[(k, pa.int64()) for k in ("depth", *KEY)], ("ends_sha256", pa.string())]))

    for b in batches:
        done = []
        for *key, piece in zip(*[b[k].to_pylist() for k in ("depth", *KEY)], b["piece"].to_pylist()):
            if key != node:
                if node is not None:
                    done.append(dict(zip(("depth", *KEY), node)) | {"ends_sha256": state.hexdigest()})
                node, state = key, hashlib.sha256(piece.encode())
            else:
                state.update(b"," + piece.encode())
        if done:
            yield out(done)
    if node is not None:
        yield out([dict(zip(("depth", *KEY), node)) | {"ends_sha256": state.hexdigest()}])


def _ends(last: DataFrame) -> DataFrame:
    """(depth, key, ends_sha256) of the nodes where conversations end; `last` has one row (conv_id, depth, key) for each."""
    lot = F.floor(F.col("conv_id") / F.lit(PIECE)).alias("lot")
    ids = F.transform(F.sort_array(F.collect_list("conv_id")), lambda x: x.cast("string"))  # PIECE ids at most: they are distinct
    pieces = last.groupBy("depth", *KEY, lot).agg(F.array_join(ids, ",").alias("piece"))
    pieces = pieces.repartition(c.shuffle_width(last.sparkSession), "depth", *KEY).sortWithinPartitions("depth", *KEY, "lot")
    return pieces.select("depth", *KEY, "piece").mapInArrow(_hashed, ", ".join(f"{k} long" for k in ("depth", *KEY)) + ", ends_sha256 string")


def _peeled(chains: DataFrame) -> DataFrame:
    """Totals that reach each node from the chains hanging from it: (path, depth, leaves, saved), summed.

    `chains` has a row for each: path, up (the path it hangs from, null for the root's), at (the node's depth there), leaves
    and saved of its own nodes, waits (chains that hang from it)."""
    spark, told, rounds = chains.sparkSession, None, []
    left = c.written(chains, "chains")
    while not left.isEmpty():
        done = left.where("waits = 0")
        sent = c.written(done.where("up is not null").groupBy(F.col("up").alias("path"), F.col("at").alias("depth")).agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"), F.count("*").alias("n")), "sent")
        rounds.append(sent)
        got = sent.groupBy("path").agg(F.sum("leaves").alias("l"), F.sum("saved").alias("s"), F.sum("n").alias("n"))
        rest = left.where("waits > 0").join(got, "path", "left").select(
            "path", "up", "at", (F.col("leaves") + F.coalesce("l", F.lit(0))).alias("leaves"), (F.col("saved") + F.coalesce("s", F.lit(0))).alias("saved"), (F.col("waits") - F.coalesce("n", F.lit(0))).alias("waits"))
        before, left = left, c.written(rest, "chains")
        c.discard(before)
    for r in rounds:
        told = r if told is None else told.unionByName(r)
    if told is None:
        return spark.createDataFrame([], "path long, depth long, leaves long, saved long")
    return told.groupBy("path", "depth").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))


def nodes(chats: DataFrame) -> DataFrame:
    """One row for each node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    turns = _turns(chats)
    convs, rows = rebuilt(turns)
    mixed = [F.shiftright(F.xxhash64(F.lit(j), "digest", "depth"), 33).bitwiseAND(F.lit((1 << 31) - 1)).alias(k) for j, k in enumerate(KEY)]
    sums = _running(rows.select("conv_id", "depth", "words", *mixed), "conv_id", KEY)
    to = [F.col(f"to_{k}").alias(k) for k in KEY]
    prefix = c.written(sums.select("conv_id", "depth", "words", *to, *[(F.col(f"to_{k}") - F.col(k)).alias(f"p{k}") for k in KEY]), "prefixes")
    c.discard(turns)
    chosen = F.min(F.struct(F.xxhash64("conv_id").alias("h"), "conv_id")).alias("rep")
    found = prefix.groupBy("depth", *KEY).agg(F.count("*").alias("n_convs"), F.min("conv_id").alias("least"), chosen, F.max("words").alias("words"), *[F.max(f"p{k}").alias(f"p{k}") for k in KEY])
    root = convs.groupBy().agg(F.count("*").alias("n_convs"), F.min("conv_id").alias("least"), chosen).where("n_convs > 0")
    root = root.select(F.lit(0).cast("long").alias("depth"), *[F.lit(0).cast("long").alias(k) for k in KEY], "n_convs", "least", F.col("rep.conv_id").alias("path"), F.lit(0).cast("long").alias("words"), *[F.lit(None).cast("long").alias(f"p{k}") for k in KEY])
    found = c.written(found.select("depth", *KEY, "n_convs", "least", F.col("rep.conv_id").alias("path"), "words", *[f"p{k}" for k in KEY]).unionByName(root), "nodes")
    above = found.select((F.col("depth") + 1).alias("depth"), *[F.col(k).alias(f"p{k}") for k in KEY], F.col("least").alias("parent"), F.col("path").alias("up"))
    below = found.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), *[F.col(f"p{k}").alias(k) for k in KEY]).agg(F.count("*").alias("n_children"))
    upward = ["depth", *[f"p{k}" for k in KEY]]
    named = found.where("depth > 0").join(above, upward).unionByName(found.where("depth = 0"), allowMissingColumns=True)
    named = named.join(below, ["depth", *KEY], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    named = c.written(named.select("depth", *KEY, "least", "path", "parent", "up", "n_convs", "n_children", (F.col("n_children") == 0).cast("long").alias("leaves"), ((F.col("n_convs") - 1) * F.col("words")).alias("saved")), "named")
    own = named.groupBy("path").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    heads = named.where("up is null or up <> path").select("path", "up", (F.col("depth") - 1).alias("at"))
    waits = heads.where("up is not null").groupBy(F.col("up").alias("path")).agg(F.count("*").alias("waits"))
    chains = heads.join(own, "path").join(waits, "path", "left").select("path", "up", "at", "leaves", "saved", F.coalesce("waits", F.lit(0)).alias("waits"))
    hung = _peeled(chains).select("path", "depth", F.col("leaves").alias("l"), F.col("saved").alias("s"))
    whole = named.join(hung, ["path", "depth"], "left").withColumn("leaves", F.col("leaves") + F.coalesce("l", F.lit(0))).withColumn("saved", F.col("saved") + F.coalesce("s", F.lit(0))).drop("l", "s")
    whole = _running(whole, "path", ["leaves", "saved"], descending=True)
    empty = convs.where("turns = 0").select("conv_id", F.lit(0).cast("long").alias("depth"), *[F.lit(0).cast("long").alias(k) for k in KEY])
    last = prefix.join(convs, "conv_id").where("depth = turns").select("conv_id", "depth", *KEY).unionByName(empty)
    out = whole.join(_ends(last), ["depth", *KEY], "left")
    return out.select(
        F.col("least").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", F.col("to_leaves").alias("n_leaves"), F.col("to_saved").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )
