"""Spelling variants: words one code point apart, found by two-dimensional range reporting on wavelet trees.

Plan.  (1) One pass over the text counts the words of each task in a bounded table; counts meet in a partial aggregate, and
words of at least six code points and five occurrences are written.  (2) An edit of a word leaves either the first or the
last half of the longer word as it is, so a target of length L stands in two *cells*, one by its first L // 2 code points
and one by its others, and a word asks in the cells where a changed word could stand: as a target of its own length (one
code point replaced) and of the next length (one inserted; deletions are the same pairs, told to both sides).  (3) A cell
sorts its targets of one length forward and in reverse and keeps the reverse rank of every forward rank in a wavelet tree.
For each edit position the words that begin as the asking word does are an interval of the forward order, those that end
so are an interval of the reverse order, and the tree reports what lies in both.  A pair is met in one cell at one
position only.  (4) Tasks send sums and the best partner of each word, never pairs.  (5) Forms are followed by doubling;
a form has five times the occurrences, so no chain is longer than 27.

Skew.  Cells are dealt by hash and hold some 50,000 targets; a half that more words share is split by the hash of its
words into lots of that size, and what asks there asks in every lot.  The table of such halves has at most two rows for
50,000 words, which bounds its broadcast.  Frequent words are sums of one row a task.

Edge cases: null and empty texts have no words; a null doc_id is written as an empty string before the colon; repeated
rows count again, and rows of one id are counted each by itself; ties of form go to the smallest word in code-point order;
words of any length take part whole; no words give no rows; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import _common as c

#: Words that a task counts before it sends them on; targets in a cell.
HELD, CELL = 200_000, 50_000
LEAST_LENGTH, LEAST_COUNT, FACTOR, DELETED = 6, 5, 5, 199
_RUN = re.compile("[A-Za-zÀ-ÿ]+")
_BREAK = re.compile("[^A-Za-zÀ-ÿ]")
_STEP = 1 << 20
_LOWER = bytes(c.LOWER)


# ---------------------------------------------------------------- counting
def _runs(text: str):
    """Lists of the maximal runs of letters; a text is cut only between runs."""
    at = 0
    while at < len(text):
        cut = _BREAK.search(text, at + _STEP)
        end = cut.start() if cut else len(text)
        yield _RUN.findall(text, at, end)
        at = end


def _count(batches):
    held: Counter = Counter()

    def out():
        return pa.RecordBatch.from_arrays([pa.array(list(held.keys()), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])

    for b in batches:
        for doc, text in zip(b["doc_id"], b["text"]):
            raw = text.as_py()
            if not raw:
                continue
            own: Counter = Counter()
            for found in _runs(raw.encode().translate(_LOWER).decode()):
                own.update(found)
            seed = zlib.crc32(f"{'' if doc.as_py() is None else doc.as_py()}:".encode())
            for run, n in own.items():
                size = len(run)
                if size < LEAST_LENGTH:
                    continue
                h = zlib.crc32(run.encode(), seed)
                if h % DELETED == 0:
                    k = h % size
                    run = run[:k] + run[k + 1 :]
                    if size == LEAST_LENGTH:
                        continue
                held[run] += n
            if len(held) >= HELD:
                yield out()
                held.clear()
    if held:
        yield out()


def vocabulary(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, n): words of at least six code points and five occurrences."""
    counted = c.id_text(docs, key, text).withColumnsRenamed({key: "doc_id", text: "text"}).mapInArrow(_count, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


# ---------------------------------------------------------------- wavelet tree
class WaveletTree:
    """A permutation by levels of its values' bits, most significant first; each level is stably parted by its bit."""

    def __init__(self, values: np.ndarray):
        self.bits = max(1, int(len(values) - 1).bit_length()) if len(values) else 1
        self.zeros, self.n_zero = [], []
        v = values.astype(np.int64)
        for bit in range(self.bits - 1, -1, -1):
            low = ((v >> bit) & 1) == 0
            self.zeros.append(np.concatenate([[0], np.cumsum(low)]))
            self.n_zero.append(int(low.sum()))
            v = np.concatenate([v[low], v[~low]])

    def report(self, lo: np.ndarray, hi: np.ndarray, least: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For all queries together: (query, value) of the values in [least, most) at positions in [lo, hi)."""
        q, value = np.arange(len(lo)), np.zeros(len(lo), np.int64)
        for level, bit in enumerate(range(self.bits - 1, -1, -1)):
            zeros, nz = self.zeros[level], self.n_zero[level]
            lo0, hi0 = zeros[lo], zeros[hi]
            q, value = np.concatenate([q, q]), np.concatenate([value, value + (1 << bit)])
            lo, hi = np.concatenate([lo0, nz + lo - lo0]), np.concatenate([hi0, nz + hi - hi0])
            ok = (hi > lo) & (value < most[q]) & (value + (1 << bit) > least[q])
            q, value, lo, hi = q[ok], value[ok], lo[ok], hi[ok]
        return q, value


def _matrix(words: pa.Array, length: int) -> np.ndarray:
    """Code points of words of one length, a row a word; all are below 256."""
    data, _ = c.buffers(words)
    after = np.append(data[1:], 0)
    return np.where(data == 0xC3, after | 0x40, data)[(data & 0xC0) != 0x80].astype(np.uint8).reshape(len(words), length)


def _keys(m: np.ndarray, length: int) -> np.ndarray:
    padded = np.zeros((len(m), length), np.uint8)
    padded[:, : m.shape[1]] = m
    return padded.view(f"S{length}").ravel()


class _Order:
    """Intervals of a sorted index that share their first i code points with each asking word."""

    def __init__(self, index: np.ndarray, asking: np.ndarray, length: int):
        every = np.concatenate([_keys(index, length), _keys(asking, length)])
        order = np.argsort(every, kind="stable")
        rows = every[order].view(np.uint8).reshape(len(every), length)
        differ = rows[1:] != rows[:-1]
        self.shared = np.where(differ.any(1), differ.argmax(1), length) if len(every) > 1 else np.zeros(0, np.int64)
        self.before = np.concatenate([[0], np.cumsum(order < len(index))])
        place = np.empty(len(every), np.int64)
        place[order] = np.arange(len(every))
        self.place = place[len(index) :]

    def at(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        new = np.concatenate([[True], self.shared < i])
        starts = np.flatnonzero(new)
        ends = np.append(starts[1:], len(new))
        group = (np.cumsum(new) - 1)[self.place]
        return self.before[starts[group]], self.before[ends[group]]


def near(index: np.ndarray, asking: np.ndarray, length: int, positions: range, most: int = 1 << 19):
    """(asking, target) rows: targets of `length` code points that differ from an asking word at one of the positions, by
    one code point replaced (asking words of that length) or inserted (of one less)."""
    if not len(index) or not len(asking):
        return
    inserted = asking.shape[1] < length
    forward = np.argsort(_keys(index, length), kind="stable")
    backward = np.argsort(_keys(index[:, ::-1], length), kind="stable")
    rank = np.empty(len(index), np.int64)
    rank[backward] = np.arange(len(index))
    tree = WaveletTree(rank[forward])
    first, last = _Order(index[forward], asking, length), _Order(index[backward][:, ::-1], asking[:, ::-1], length)
    pending, size = [], 0

    def flush():
        q, at, lo, hi, least, most = (np.concatenate(x) for x in zip(*pending))
        k, value = tree.report(lo, hi, least, most)
        a, i, t = q[k], at[k], backward[value]
        if inserted:  # of a run of equal letters the first counts as the one inserted
            new = (i == 0) | (index[t, i] != index[t, np.maximum(i - 1, 0)])
        else:
            new = index[t, i] != asking[a, i]
        return a[new], t[new]

    for i in positions:
        (lo, hi), (least, most_) = first.at(i), last.at(length - 1 - i)
        alone = 0 if inserted else 1  # a word whose interval holds one target may meet only itself
        q = np.flatnonzero((hi - lo > 0) & (most_ - least > 0) & (np.minimum(hi - lo, most_ - least) > 0))
        if alone and len(q):
            q = q[~((hi - lo == 1)[q] & (index[forward[lo[q]], i] == asking[q, i]))]
        if len(q):
            pending.append((q, np.full(len(q), i), lo[q], hi[q], least[q], most_[q]))
            size += len(q)
        if size >= most:
            yield flush()
            pending, size = [], 0
    if pending:
        yield flush()


def _best(word: np.ndarray, n: np.ndarray, order: np.ndarray):
    """Of each word: a row with the partner of largest n (ties: smallest order), and how many rows it has."""
    sort = np.lexsort((order, -n, word))
    head = np.flatnonzero(np.diff(word[sort], prepend=-1))
    return sort[head], np.diff(np.append(head, len(sort)))


FOUND = "word string, n_near long, form_n long, form string"


def _cells(batches):
    """Rows come sorted by cell, targets before what asks; each cell holds its own targets only."""
    cell, held, ready = None, {}, {}

    def ask(side, length, kind, words, n):
        if (side, length) not in held:
            return
        if (side, length) not in ready:
            w, k = zip(*held[(side, length)])
            w = pa.concat_arrays(w)
            ready[(side, length)] = (w, np.concatenate(k), _matrix(w, length))
        targets, tn, index = ready[(side, length)]
        own = length - (kind == 2)
        asking, half = _matrix(words, own), length // 2
        torder, qorder = (np.argsort(np.argsort(_keys(m, length), kind="stable"), kind="stable") for m in (index, asking))
        for q, t in near(index, asking, length, range(half, length) if side == 0 else range(half)):
            if len(q):
                at, many = _best(q, tn[t], torder[t])
                yield words.take(pa.array(q[at])), many, tn[t[at]], targets.take(pa.array(t[at]))
                if kind == 2:
                    at, many = _best(t, n[q], qorder[q])
                    yield targets.take(pa.array(t[at])), many, n[q[at]], words.take(pa.array(q[at]))

    for b in batches:
        if not b.num_rows:
            continue
        keys = np.stack([b[k].to_numpy() for k in ("cell", "lot", "kind", "side", "length")], 1)
        words, n = b["word"], b["n"].to_numpy()
        cut = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]).any(1)]))
        for lo, hi in zip(cut, [*cut[1:], len(keys)]):
            at, (kind, side, length) = tuple(keys[lo, :2]), keys[lo, 2:]
            if at != cell:
                cell, held, ready = at, {}, {}
            part = words.slice(lo, hi - lo)
            if kind == 0:
                held.setdefault((side, length), []).append((part, n[lo:hi]))
                continue
            for w, many, fn, form in ask(side, length, kind, part, n[lo:hi]):
                yield pa.RecordBatch.from_arrays([w, pa.array(many.astype(np.int64)), pa.array(fn), form], ["word", "n_near", "form_n", "form"])


def neighbours(words: DataFrame, cell: int = CELL) -> DataFrame:
    """(word, n_near, form_n, form) of written words (word, n) that have near words: how many, and the best of them."""
    spark: SparkSession = words.sparkSession
    size, half = F.char_length("word"), lambda n: F.floor(n / 2).cast("int")
    row = lambda kind, side, n, key: F.struct(F.lit(kind).alias("kind"), F.lit(side).alias("side"), n.cast("int").alias("length"), F.xxhash64(F.lit(side), n, key).alias("key"))
    first = lambda n: F.substring("word", F.lit(1), half(n))
    last = lambda n, start: F.substring("word", start, n)
    same, longer = [row(0, 0, size, first(size)), row(0, 1, size, last(size, half(size) + 1))], [row(2, 0, size + 1, first(size + 1)), row(2, 1, size + 1, last(size + 1, half(size + 1)))]
    asks = [x.withField("kind", F.lit(1)) for x in same]
    rows = words.select("word", "n", F.explode(F.array(*same, *asks, *longer)).alias("r")).select("word", "n", "r.*")
    hot = rows.where("kind = 0").groupBy("key").agg(F.ceil(F.count("*") / F.lit(cell)).cast("int").alias("lots")).where("lots > 1")
    many = max(1, -(-2 * words.count() // cell))
    rows = rows.join(F.broadcast(hot), "key", "left")  # at most two rows for `cell` words
    own = F.pmod(F.xxhash64("word"), F.coalesce("lots", F.lit(1))).cast("int")
    lots = F.when(F.col("kind") == 0, F.array(own)).otherwise(F.sequence(F.lit(0), F.coalesce("lots", F.lit(1)) - 1))
    place = F.when(F.col("lots").isNull(), F.pmod("key", F.lit(many).cast("long"))).otherwise(F.col("key"))
    dealt = rows.select(place.alias("cell"), F.explode(lots).alias("lot"), "kind", "side", "length", "word", "n")
    dealt = dealt.repartition(c.shuffle_width(spark), "cell", "lot").sortWithinPartitions("cell", "lot", "kind", "side", "length")
    dealt = dealt.select(*[F.col(k).cast("long").alias(k) for k in ("cell", "lot", "kind", "side", "length")], "word", "n")
    best = dealt.mapInArrow(_cells, FOUND).groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("form_n")).alias("less"), "form")).alias("best"))
    return best.select("word", "n_near", (-F.col("best.less")).alias("form_n"), "best.form")


def variants(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each word: word, n, n_near, form and form_n (null without a form), root (the word itself without one)."""
    words = c.written(vocabulary(docs, key, text), "words")
    met = c.written(neighbours(words), "neighbours")
    form = words.join(met, "word", "left").withColumn("has", F.coalesce(F.col("form_n") >= FACTOR * F.col("n"), F.lit(False)))
    form = c.written(form.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(F.col("has"), F.col("form")).alias("form"), F.when(F.col("has"), F.col("form_n")).alias("form_n")), "forms")
    c.discard(met, words)
    root = c.written(form.where("form is not null").select("word", F.col("form").alias("root")), "roots")
    while True:  # each round doubles the step
        on = root.select(F.col("word").alias("root"), F.col("root").alias("further"))
        moved = c.written(root.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        c.discard(root)
        root = moved
        if root.where("moved").isEmpty():
            break
    named = form.join(root.select("word", "root"), "word", "left")
    return named.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
