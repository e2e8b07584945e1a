"""Benchmark contamination: size-partitioned MinHash containment search, verified by exact shingle containment.

Items are partitioned by size (shingles, up to 16, 32, 64, ...).  For a partition of size s a document is cut into
blocks of s shingles, and every two neighbouring blocks form a window: an item that lies in the text lies in a window,
however long the document, so the similarity of item and window is at least a quarter of the containment.  Windows and
items meet if any of HASHES minima agree (one row to a band); with containment 0.8 a pair is missed with a chance of
about one in a million.  Items of at most EXACT distinct shingles would rarely have the minimum of a window; they are
looked up by each of their shingles instead, which misses none.  Each candidate is then verified by the item's shingles
in the whole document.

The items are held by every task.  Their size is measured first; beyond ITEM_BYTES they are handled in blocks of that
size, each against all documents.  Rows and ids: null or blank texts contain nothing and are contained in nothing; a
null id stays null; repeated rows give repeated pairs; other columns are ignored (or kept, by `without_contaminated`).
Items under five words are one shingle of all their words and match documents of just these words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import _common as c

HASHES, LEAST, EXACT = 64, 16, 8
ITEM_BYTES = 16 << 20
_SEEDS = np.random.Generator(np.random.PCG64(606)).integers(1, 1 << 62, (2, HASHES), dtype=np.int64).astype(np.uint64)


def _minima(j: int, shingles: np.ndarray, starts: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = shingles * (_SEEDS[0, j] | np.uint64(1))
        h += _SEEDS[1, j]
    h >>= np.uint64(32)
    return np.minimum.reduceat(h.astype(np.uint32), starts)


def _shingles(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    data, offs = c.buffers(texts)
    starts, ends, row = c.word_spans(data, offs)
    return c.shingle_hashes(c.word_hashes(data, starts, ends), row)


class ItemIndex:
    """Items by size partition: their shingle sets, and for each hash the minima in order, with a small first filter."""

    def __init__(self, ids: list, texts: list):
        sh, at = _shingles(pa.array(texts, pa.string()))
        sets, row = c.row_sets(sh, at)
        self.ids, self.sets = ids, [sets[a:b] for a, b in zip(row[:-1], row[1:])]
        of: dict[int, list[int]] = {}
        short = [i for i, s in enumerate(self.sets) if 0 < len(s) <= EXACT]
        owner = np.repeat(np.array(short, np.int64), [len(self.sets[i]) for i in short])
        known = np.concatenate([self.sets[i] for i in short]) if short else np.zeros(0, np.uint64)
        order = np.argsort(known, kind="stable")
        self.probes, self.owners = known[order], owner[order]
        self.near = np.zeros(1 << 16, bool)
        self.near[(self.probes >> np.uint64(48)).astype(np.int64)] = True
        for i, s in enumerate(self.sets):
            if len(s) > EXACT:
                of.setdefault(max(LEAST, 1 << (int(at[i + 1] - at[i]) - 1).bit_length()), []).append(i)
        self.parts = []
        for size in sorted(of):
            items = np.array(of[size])
            one = np.concatenate([self.sets[i] for i in items])
            first = np.concatenate([[0], np.cumsum([len(self.sets[i]) for i in items])[:-1]])
            mins, order, near = [], [], np.zeros((HASHES, 1 << 16), bool)
            for j in range(HASHES):
                m = _minima(j, one, first)
                order.append(items[np.argsort(m, kind="stable")])
                mins.append(np.sort(m))
                near[j, m & 0xFFFF] = True
            self.parts.append((size, mins, order, near))

    def search(self, shingles: np.ndarray, at: np.ndarray, least: float) -> list[tuple[int, int, int]]:
        """(row, item, shared shingles) of all pairs with shared >= least * the item's shingles."""
        if not len(shingles):
            return []
        rows = np.flatnonzero(np.diff(at) > 0)
        begin, count = at[rows], np.diff(at)[rows]
        layout, size = [], LEAST
        for part in self.parts:
            while True:
                blocks = -(-count // size)
                first = np.cumsum(blocks) - blocks
                if not layout:
                    k = np.arange(int(blocks.sum())) - np.repeat(first, blocks)
                    starts = np.repeat(begin, blocks) + k * size
                else:
                    k = np.arange(int(blocks.sum())) - np.repeat(first, blocks)
                    starts = np.repeat(layout[-1][2], blocks) + 2 * k
                layout.append((size, starts, first, blocks, part if size == part[0] else None))
                size *= 2
                if layout[-1][4] is not None:
                    break
        found = self._short(shingles, begin, least)
        for j in range(HASHES if self.parts else 0):
            low = None
            for _, starts, first, blocks, part in layout:
                low = _minima(j, shingles, starts) if low is None else np.minimum.reduceat(low, starts)
                if part is None:
                    continue
                window = low.copy()
                window[:-1] = np.minimum(low[:-1], low[1:])
                last = first + blocks - 1
                window[last] = low[last]
                _, mins, order, near = part
                for w in np.flatnonzero(near[j][window & 0xFFFF]):
                    a, b = np.searchsorted(mins[j], window[w], "left"), np.searchsorted(mins[j], window[w], "right")
                    if a < b:
                        r = int(np.searchsorted(first, w, "right")) - 1
                        found.update((r, int(i)) for i in order[j][a:b])
        out, last, own = [], -1, None
        for r, i in sorted(found):
            if r != last:
                last, own = r, np.unique(shingles[begin[r] : begin[r] + count[r]])
            shared = len(np.intersect1d(own, self.sets[i], assume_unique=True))
            if shared >= least * len(self.sets[i]):
                out.append((int(rows[r]), i, shared))
        return out


    def _short(self, shingles: np.ndarray, begin: np.ndarray, least: float) -> set[tuple[int, int]]:
        """(row of `begin`, item) of all short items that have enough of their shingles there."""
        if not len(self.probes):
            return set()
        at = np.flatnonzero(self.near[(shingles >> np.uint64(48)).astype(np.int64)])
        a, b = np.searchsorted(self.probes, shingles[at], "left"), np.searchsorted(self.probes, shingles[at], "right")
        at, a, b = at[a < b], a[a < b], b[a < b]
        if not len(at):
            return set()
        # each shingle of a row once: repeats add nothing
        row = np.searchsorted(begin, at, "right") - 1
        seen = np.lexsort((a, row))
        new = np.ones(len(seen), bool)
        new[1:] = (row[seen][1:] != row[seen][:-1]) | (a[seen][1:] != a[seen][:-1])
        row, a, b = row[seen][new], a[seen][new], b[seen][new]
        n = b - a
        item = self.owners[np.repeat(a, n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)]
        pairs, shared = np.unique(np.repeat(row, n) * len(self.sets) + item, return_counts=True)
        row, item = pairs // len(self.sets), pairs % len(self.sets)
        enough = shared >= least * np.array([len(s) for s in self.sets])[item]
        return set(zip(row[enough].tolist(), item[enough].tolist()))


def _blocks(items: DataFrame, key: str, text: str):
    """The item index, block by block; one block where the items are small."""
    items = items.select(F.col(key).cast("long").alias("item_id"), F.col(text).cast("string").alias("text"))
    total = items.agg(F.coalesce(F.sum(F.octet_length("text").cast("long") + 16), F.lit(0))).first()[0]
    n = int(total) // ITEM_BYTES + 1
    for k in range(n):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k) if n > 1 else items
        got = rows.toArrow()
        yield items.sparkSession.sparkContext.broadcast(ItemIndex(got["item_id"].to_pylist(), got["text"].to_pylist()))


PAIRS = "doc_id long, item_id long, n_item long, n_shared long, containment double"


def contaminated(docs: DataFrame, items: DataFrame, least: float = 0.8, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """doc_id, item_id, n_item, n_shared, containment of every document and item with containment >= least."""
    docs = c.id_text(docs, key, text).select(F.col(key).alias("doc_id"), F.col(text).alias("text"))

    def pairs(index):
        def run(batches):
            known = index.value
            for b in batches:
                for lo, hi in c.slices(c.buffers(b["text"])[1]):
                    ids = b["doc_id"].slice(lo, hi - lo)
                    hits = known.search(*_shingles(b["text"].slice(lo, hi - lo)), least)
                    if hits:
                        r, i, n = (list(x) for x in zip(*hits))
                        size = [len(known.sets[k]) for k in i]
                        yield pa.RecordBatch.from_arrays(
                            [ids.take(pa.array(r)), pa.array([known.ids[k] for k in i], pa.int64()), pa.array(size, pa.int64()), pa.array(n, pa.int64()), pa.array([a / s for a, s in zip(n, size)])],
                            ["doc_id", "item_id", "n_item", "n_shared", "containment"],
                        )

        return run

    found = [docs.mapInArrow(pairs(index), PAIRS) for index in _blocks(items, item_key, item_text)]
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def without_contaminated(docs: DataFrame, items: DataFrame, least: float = 0.8, text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of docs, all columns, that contain no item; no shuffle, as the search itself lets rows through."""

    def clean(index):
        def run(batches):
            known = index.value
            for b in batches:
                own = pc.cast(b[text], pa.string())
                for lo, hi in c.slices(c.buffers(own)[1]):
                    hits = {r for r, _, _ in known.search(*_shingles(own.slice(lo, hi - lo)), least)}
                    part = b.slice(lo, hi - lo)
                    yield part.filter(pa.array([i not in hits for i in range(hi - lo)], pa.bool_())) if hits else part

        return run

    for index in _blocks(items, item_key, item_text):
        docs = docs.mapInArrow(clean(index), docs.schema)
    return docs
