"""Removal of long repeated passages with a logarithmic family of suffix indexes.

Rule: a byte goes if some 50-byte string over it also starts in a document with a smaller id (strings are those of the
input; a string never crosses documents).

A suffix matters here only up to its first 50 bytes.  Neighbouring suffixes whose 50 bytes have the same minimum among
the hashes of their 20-byte strings form a *run*; the minimum depends on the 50 bytes alone, so equal strings fall into
runs of equal minimum, wherever they are.  The index is dealt over the cluster by that minimum, and each part holds its
own index family.

Coarse pass: a run is (minimum, fingerprint of its whole text), 96 bits beside the part.  Batches, in order of document
id, are sorted into suffix arrays, scanned against the existing levels, and levels of equal size merge geometrically.
A run whose text an earlier document has is gone as a whole.  A run whose minimum has only this text is settled.
Fine pass: only the first runs of texts that share their minimum with a different text send their bytes (99 at most).  The
same index family now holds the suffixes themselves in byte order, and matches of 50 bytes are found by merge scan.

Skew: documents are dealt by a hash of their id, once, and used three times.  A sender tells a part each distinct run once
in FLUSH runs, with the smallest and largest document that has it there, and hears the first document of all; so a
passage that every document holds is one entry for millions of runs, however many documents share it.  Parts and groups
have numbers that Spark's hash spreads over all partitions, one each.

Edge cases: a null text is empty (0 bytes, nothing removed); a null id sorts before all others (with the smallest long) and
is shown as null again; rows that repeat an id are one document for the rule and give a row each; other columns are
ignored.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import _common as c

LENGTH, KMER = 50, 20
SPAN = LENGTH - KMER + 1
#: A document longer than this is worked on in pieces of so many suffixes; the cut depends on the document alone.
PIECE = 1 << 20
#: Runs that a task gathers before it sends them out.
FLUSH = 1 << 20
BATCHES = 8
_B = [np.uint64(pow(0x5851F42D4C957F2D, 1 << i, 1 << 64)) for i in range(6)]


# ---------------------------------------------------------------- runs
def runs(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, ...]:
    """(row, start, grams, minimum, fingerprint) of every run of the rows, in text order; grams <= 50."""
    n = len(data) - LENGTH + 1
    none = np.zeros(0, np.int64)
    if n < 1:
        return none, none, none, none.astype(c.U64), none.astype(c.U64)
    with np.errstate(over="ignore"):
        x1 = c.BYTE[data]
        x2 = x1[:-1] * _B[0] + x1[1:]
        x4 = x2[:-2] * _B[1] + x2[2:]
        x8 = x4[:-4] * _B[2] + x4[4:]
        x16 = x8[:-8] * _B[3] + x8[8:]
        k20 = c.mix(x16[: len(x16) - 4] * _B[2] + x4[16 : 16 + len(x16) - 4])
        x32 = x16[:-16] * _B[4] + x16[16:]
        g50 = x32[:n] * (_B[4] * _B[1]) + (x16[32 : 32 + n] * _B[1] + x2[48 : 48 + n])
    m = k20
    for step in (1, 2, 4, 8):
        m = np.minimum(m[:-step], m[step:])
    m = np.minimum(m[:n], m[SPAN - 16 : SPAN - 16 + n])
    ok = np.ones(n, bool)
    for k in range(1, len(offs) - 1):  # strings that would cross into row k
        ok[max(int(offs[k]) - LENGTH + 1, 0) : min(int(offs[k]), n)] = False
    new = ok.copy()
    new[1:] &= (m[1:] != m[:-1]) | ~ok[:-1]
    starts = np.flatnonzero(new)
    last = ok.copy()
    last[:-1] &= new[1:] | ~ok[1:]
    size = np.flatnonzero(last) + 1 - starts
    if len(size) and size.max() > LENGTH:
        parts = -(-size // LENGTH)
        k = np.arange(int(parts.sum())) - np.repeat(np.cumsum(parts) - parts, parts)
        starts, size = np.repeat(starts, parts) + k * LENGTH, np.minimum(np.repeat(size, parts) - k * LENGTH, LENGTH)
    with np.errstate(over="ignore"):
        head, tail = g50[starts], g50[starts + size - 1]
        print_ = c.mix(c.mix(head + size.astype(c.U64)) * c.U64(0x9E3779B97F4A7C15) + c.mix(tail))
    return np.searchsorted(offs, starts, "right") - 1, starts, size, m[starts], print_


def pieces(data: np.ndarray, offs: np.ndarray):
    """Runs of all rows: (row, ordinal in row, start in row, grams, minimum, fingerprint), slice by slice."""
    for lo, hi in c.slices(offs):
        at, end = int(offs[lo]), int(offs[hi])
        if hi - lo == 1 and end - at > PIECE:
            count = 0
            for p in range(at, end - LENGTH + 1, PIECE):
                part = data[p : min(p + PIECE + LENGTH - 1, end)]
                _, s, n, m, f = runs(part, np.array([0, len(part)]))
                yield np.full(len(s), lo), np.arange(count, count + len(s)), s + (p - at), n, m, f
                count += len(s)
        else:
            o = offs[lo : hi + 1] - at
            # empty rows share an offset with the next one; the last row at an offset owns the bytes
            r, s, n, m, f = runs(data[at:end], o)
            first = np.searchsorted(r, r)
            yield r + lo, np.arange(len(r)) - first, s - o[r], n, m, f


def tags(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Tells rows of one id with different texts apart."""
    raw = data.tobytes()
    return np.array([zlib.crc32(raw[a:b]) for a, b in zip(offs[:-1], offs[1:])], np.uint32)


def _blocks(place: np.ndarray, arrays: list[np.ndarray]):
    """Arrays split by place: (place, packed arrays)."""
    order = np.argsort(place, kind="stable")
    place, arrays = place[order], [a[order] for a in arrays]
    cut = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]])) if len(place) else np.zeros(0, np.int64)
    for a, b in zip(cut, [*cut[1:], len(place)]):
        yield int(place[a]), c.pack(*(x[a:b] for x in arrays))


def _rows(blocks, names: list[str], split) -> pa.RecordBatch | None:
    rows = [(*split(p), x) for p, x in blocks]
    if not rows:
        return None
    cols = list(zip(*rows))
    return pa.RecordBatch.from_arrays([*(pa.array(v, pa.int32()) for v in cols[:-1]), pa.array(cols[-1], pa.binary())], names)


# ---------------------------------------------------------------- the index family
class IndexFamily:
    """Levels of sorted distinct suffix keys, each with a check word and its first document.  insert() takes the next batch
    (all of whose documents follow those of earlier batches), sorts it into a suffix array, scans it against every level
    by merging order, and returns each entry's first document; levels of like size merge."""

    def __init__(self):
        self.levels: list[tuple[np.ndarray, ...]] = []

    def insert(self, keys: np.ndarray, check: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first document, clash of keys with another check word), in the order of the batch."""
        order = np.lexsort((docs, keys))
        k, w, d = keys[order], check[order], docs[order]
        new = np.ones(len(k), bool)
        new[1:] = k[1:] != k[:-1]
        uk, uw, ud = k[new], w[new], d[new]
        known = np.zeros(len(uk), bool)
        for lk, lw, ld in self.levels:
            at = np.minimum(np.searchsorted(lk, uk), len(lk) - 1)
            hit = lk[at] == uk
            uw, ud = np.where(hit, lw[at], uw), np.where(hit, ld[at], ud)
            known |= hit
        group = np.cumsum(new) - 1
        first, clash = np.empty(len(k), np.int64), np.empty(len(k), bool)
        first[order], clash[order] = ud[group], uw[group] != w
        if not known.all():
            self.levels.append((uk[~known], uw[~known], ud[~known]))
        while len(self.levels) > 1 and len(self.levels[-2][0]) < 2 * len(self.levels[-1][0]):
            self._merge()
        return first, clash

    def _merge(self) -> None:
        a, b = self.levels.pop(), self.levels.pop()
        order = np.argsort(np.concatenate([a[0], b[0]]), kind="stable")
        self.levels.append(tuple(np.concatenate([x, y])[order] for x, y in zip(a, b)))

    def levels_keys(self) -> np.ndarray:
        """All keys in order."""
        while len(self.levels) > 1:
            self._merge()
        return self.levels[0][0] if self.levels else np.zeros(0, np.uint64)


# ---------------------------------------------------------------- steps
def even_numbers(spark, width: int) -> list[int]:
    """A number for each of `width` hash partitions that falls into it: dealing by these fills all alike."""
    most = width * (12 + width.bit_length())
    while True:
        rows = spark.range(most).select(F.col("id").cast("int").alias("v")).groupBy(F.pmod(F.hash("v"), F.lit(width)).alias("p")).agg(F.min("v").alias("v")).collect()
        if len(rows) == width:
            return [r.v for r in sorted(rows, key=lambda r: r.p)]
        most *= 2


def _names(m: np.ndarray, f: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Key and check word of runs."""
    return (m << c.U64(32)) | (f & c.U64(0xFFFFFFFF)), (f >> c.U64(32)).astype(np.uint32)


def _part(m: np.ndarray, parts: int) -> np.ndarray:
    return ((m >> c.U64(40)) % c.U64(parts)).astype(np.int64)


def _send(numbers: list[int]):
    """For each distinct run of FLUSH runs of a group: its smallest and largest document; a row for each part."""
    number = np.array(numbers)
    schema = pa.schema([("part", pa.int32()), ("batch", pa.int32()), ("g", pa.int32()), ("block", pa.binary())])

    def told(g, held):
        doc, m, f = (np.concatenate(x) for x in zip(*held))
        key, check = _names(m, f)
        part = _part(m, len(number))
        order = np.lexsort((doc, check, key, part))
        doc, key, check, part = doc[order], key[order], check[order], part[order]
        new = np.ones(len(doc), bool)
        new[1:] = (key[1:] != key[:-1]) | (check[1:] != check[:-1]) | (part[1:] != part[:-1])
        end = np.append(new[1:], True)
        low, high = doc[new], doc[end]
        for p, x in _blocks(part[new], [low, high, key[new], check[new]]):
            yield int(number[p]), 0, g, x

    def run(docs: pa.Table) -> pa.Table:
        out, held, n = [], [], 0
        ids, (data, offs) = c.longs(docs["doc_id"]), c.buffers(docs["text"])
        g = docs["g"][0].as_py()
        for r, _, _, _, m, f in pieces(data, offs):
            held.append((ids[r], m, f))
            n += len(r)
            if n >= FLUSH:
                out += told(g, held)
                held, n = [], 0
        if n:
            out += told(g, held)
        return pa.table([pa.array(x, t.type) for x, t in zip(zip(*out), schema)], schema=schema) if out else schema.empty_table()

    return run


def _by_part(batches):
    """Rows of sorted batches, part by part, as lists of unpacked blocks of each batch: (part, batch, groups, arrays)."""
    part = batch = None
    held: list = []
    groups: list = []
    for b in batches:
        names = b["g"].to_pylist() if "g" in b.schema.names else [None] * b.num_rows
        for p, k, g, x in zip(b["part"].to_pylist(), b["batch"].to_pylist(), names, b["block"]):
            if (p, k) != (part, batch) and held:
                yield part, batch, groups, held
                held, groups = [], []
            part, batch = p, k
            held.append(c.unpack(x.as_py()))
            groups.append(g)
    if held:
        yield part, batch, groups, held


def _coarse(bounds: list[int]):
    """For each part, batch by batch of document ids: kind 1, runs that an earlier document has as a whole, with the first document; kind 2, runs of their
    first document to look into; kind 4, runs of any document to look into (keys that clash)."""

    def answer(kept, family):
        if not kept:
            return
        g, low, high, key, check, first, clash = (np.concatenate(x) for x in zip(*kept))
        minima = family.levels_keys() >> c.U64(32)
        several = np.unique(np.concatenate([minima[1:][minima[1:] == minima[:-1]], key[clash] >> c.U64(32)]))
        shared = np.isin(key >> c.U64(32), several)
        for kind, mask in ((1, ~clash & (high > first)), (2, ~clash & shared & (low == first)), (4, clash)):
            if mask.any():
                order = np.lexsort((key[mask], g[mask]))
                a, k, w, d = g[mask][order], key[mask][order], check[mask][order], first[mask][order]
                new = np.ones(len(a), bool)
                new[1:] = (a[1:] != a[:-1]) | (k[1:] != k[:-1]) | (w[1:] != w[:-1])
                yield _rows(_blocks(a[new], [k[new], w[new], d[new]]), ["g", "kind", "block"], lambda p, kind=kind: (p, kind))

    edge = np.array(bounds, np.int64)

    def run(batches):
        for _, _, groups, blocks in _by_part(batches):
            g = np.repeat(np.array(groups, np.int32), [len(x[0]) for x in blocks])
            low, high, key, check = (np.concatenate(x) for x in zip(*blocks))
            batch = np.searchsorted(edge, low, "right")
            family, kept = IndexFamily(), []
            for k in np.unique(batch):
                own = batch == k
                kept.append((g[own], low[own], high[own], key[own], check[own], *family.insert(key[own], check[own], low[own])))
            yield from answer(kept, family)

    return run


def _answers(tab: pa.Table, kind: int, width: int) -> list[np.ndarray]:
    """The arrays of all blocks of a kind, laid end to end and sorted by the first."""
    got = [c.unpack(x) for k, x in zip(tab["kind"].to_pylist(), tab["block"].to_pylist()) if k == kind]
    if not got:
        return [np.zeros(0, np.int64)] * width
    arrays = [np.concatenate(x) for x in zip(*got)]
    order = np.argsort(arrays[0], kind="stable")
    return [x[order] for x in arrays]


def _found(known: list[np.ndarray], key: np.ndarray, check: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which runs are among the answers, and the document said of each."""
    names, words, docs = known
    if not len(names):
        return np.zeros(len(key), bool), np.zeros(len(key), np.int64)
    at = np.minimum(np.searchsorted(names, key), len(names) - 1)
    hit = (names[at] == key) & (words[at] == check)
    for k in np.flatnonzero((names[at] == key) & ~hit):  # two texts of one key
        for j in range(int(at[k]), int(np.searchsorted(names, key[k], "right"))):
            if words[j] == check[k]:
                hit[k], at[k] = True, j
    return hit, docs[at]


def _look(numbers: list[int], bounds: list[int]):
    """The bytes of runs of kinds 2 and 4, dealt by their minimum."""
    edge, number = np.array(bounds, np.int64), np.array(numbers)
    schema = pa.schema([("part", pa.int32()), ("batch", pa.int32()), ("block", pa.binary())])

    def run(_, docs: pa.Table, asked: pa.Table) -> pa.Table:
        own, any_ = _answers(asked, 2, 3), _answers(asked, 4, 3)
        ids = c.longs(docs["doc_id"]) if docs.num_rows else np.zeros(0, np.int64)
        mine = np.isin(ids, own[2]) | (len(any_[0]) > 0)
        if not mine.any():
            return schema.empty_table()
        ids, docs = ids[mine], docs.filter(pa.array(mine))
        data, offs = c.buffers(docs["text"])
        tag = tags(data, offs)
        out, held = [], []

        def told():
            doc, name, k, m, n, text = (np.concatenate(x) for x in zip(*held))
            first = np.concatenate([[0], np.cumsum(n.astype(np.int64) + LENGTH - 1)])
            place = _part(m, len(number)) * (BATCHES + 1) + np.searchsorted(edge, doc, "right")
            order = np.argsort(place, kind="stable")
            cut = np.flatnonzero(np.concatenate([[True], place[order][1:] != place[order][:-1]]))
            for lo, hi in zip(cut, [*cut[1:], len(order)]):
                at = order[lo:hi]
                size = first[at + 1] - first[at]
                pos = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size) + np.repeat(first[at], size)
                p, batch = divmod(int(place[at[0]]), BATCHES + 1)
                out.append((int(number[p]), batch, c.pack(doc[at], name[at], k[at], n[at], text[pos])))

        n_held = 0
        for r, k, s, n, m, f in pieces(data, offs):
            key, check = _names(m, f)
            hit, doc = _found(own, key, check)
            hit &= doc == ids[r]
            if len(any_[0]):
                hit |= _found(any_, key, check)[0]
            at = np.flatnonzero(hit)
            if len(at):
                size = n[at] + LENGTH - 1
                pos = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size) + np.repeat(s[at] + offs[r[at]], size)
                held.append((ids[r[at]], tag[r[at]], k[at].astype(np.uint32), m[at], n[at].astype(np.uint8), data[pos]))
                n_held += len(at)
                if n_held >= FLUSH:
                    told()
                    held, n_held = [], 0
        if held:
            told()
        return pa.table([pa.array(x, t.type) for x, t in zip(zip(*out), schema)], schema=schema) if out else schema.empty_table()

    return run


def _fine(numbers: list[int]):
    """True suffix arrays of the runs' bytes, level by level: kind 3, a bit for each 50-byte string that an earlier
    document has."""

    def scan(levels, blocks):
        doc, tag, ordinal, n = (np.concatenate([b[j] for b in blocks]) for j in range(4))
        text = np.concatenate([b[4] for b in blocks])
        n = n.astype(np.int64)
        first = np.cumsum(n + LENGTH - 1) - (n + LENGTH - 1)
        entry = np.repeat(np.arange(len(n)), n)
        gram = np.arange(len(entry)) - np.repeat(np.cumsum(n) - n, n)
        pos = gram + np.repeat(first, n)
        view = np.lib.stride_tricks.sliding_window_view(text, LENGTH)[pos]
        suffix = np.ascontiguousarray(view).view(f"V{LENGTH}").reshape(-1)
        words = np.ascontiguousarray(np.pad(view, ((0, 0), (0, 6)))).view(">u8")  # byte order is number order
        order = np.lexsort((doc[entry], *(words[:, j] for j in range(6, -1, -1))))
        s, d = suffix[order], doc[entry][order]
        w = words[order]
        new = np.ones(len(s), bool)
        new[1:] = (w[1:] != w[:-1]).any(1)
        lead = np.flatnonzero(new)
        group = np.cumsum(new) - 1
        seen = d > d[lead][group]
        keys = [bytes(x) for x in s[lead]]
        known = np.zeros(len(keys), bool)
        for level in levels:
            known |= _merge_scan(level, keys)
        seen |= known[group]
        fresh = [k for k, old in zip(keys, known) if not old]
        if fresh:
            levels.append(fresh)
        while len(levels) > 1 and len(levels[-2]) < 2 * len(levels[-1]):
            a, b = levels.pop(), levels.pop()
            levels.append(sorted(a + b))
        hit = np.zeros(len(order), bool)
        hit[order] = seen
        bits = np.zeros(len(n), c.U64)
        np.bitwise_or.at(bits, entry[hit], c.U64(1) << gram[hit].astype(c.U64))
        any_ = bits > 0
        return doc[any_], tag[any_], ordinal[any_], bits[any_]

    def run(batches):
        part, levels = None, []
        for p, _, _, blocks in _by_part(batches):
            if p != part:
                part, levels = p, []
            doc, tag, ordinal, bits = scan(levels, blocks)
            if len(doc):
                yield _rows(_blocks(c.spark_hash(doc) % len(numbers), [doc, tag, ordinal, bits]), ["g", "kind", "block"], lambda g: (numbers[g], 3))

    return run


def _merge_scan(level: list[bytes], keys: list[bytes]) -> np.ndarray:
    """Which of the sorted keys the sorted level holds: both are walked once, in order."""
    out, i, end = np.zeros(len(keys), bool), 0, len(level)
    if end > 16 * len(keys):
        from bisect import bisect_left

        for j, key in enumerate(keys):
            i = bisect_left(level, key, i)
            out[j] = i < end and level[i] == key
        return out
    for j, key in enumerate(keys):
        while i < end and level[i] < key:
            i += 1
        out[j] = i < end and level[i] == key
    return out


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _covered(lo: int, hi: int, ids, tag, data, offs, whole, some) -> np.ndarray:
    """Which bytes of rows lo..hi go: of whole runs that an earlier document has, and of single strings (`some`)."""
    base = int(offs[lo])
    cover = np.zeros(int(offs[hi]) - base + 1, np.int32)
    doc, name, ordinal, bits = some
    for r, k, s, n, m, f in pieces(data[base : int(offs[hi])], offs[lo : hi + 1] - base):
        row = r + lo
        at = s + offs[row] - base
        hit, first = _found(whole, *_names(m, f))
        hit &= ids[row] > first
        np.add.at(cover, at[hit], 1)
        np.add.at(cover, at[hit] + n[hit] + LENGTH - 1, -1)
        for i in np.unique(row[np.isin(ids[row], doc)]) if len(doc) else ():
            a, b = np.searchsorted(doc, ids[i], "left"), np.searchsorted(doc, ids[i], "right")
            mine = name[a:b] == tag[i]
            o, w = ordinal[a:b][mine], bits[a:b][mine]
            order = np.argsort(o)
            o, w = o[order], w[order]
            x, y = np.searchsorted(row, i, "left"), np.searchsorted(row, i, "right")
            j = np.minimum(np.searchsorted(o, k[x:y]), max(len(o) - 1, 0))
            fits = np.flatnonzero(o[j] == k[x:y]) if len(o) else np.zeros(0, np.int64)
            e, g = np.nonzero((w[j[fits]][:, None] >> np.arange(LENGTH, dtype=c.U64)) & c.U64(1))
            start = at[x:y][fits][e] + g
            np.add.at(cover, start, 1)
            np.add.at(cover, start + LENGTH, -1)
    return np.cumsum(cover[:-1]) > 0


def _apply(keep_text: bool):
    def run(_, docs: pa.Table, said: pa.Table) -> pa.Table:
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept", "spans"] if keep_text else [])]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.list_(pa.int64())]
        if not docs.num_rows:
            return pa.table([pa.array([], t) for t in kinds[: len(names)]], names=names)
        whole, some = _answers(said, 1, 3), _answers(said, 3, 4)
        ids, (data, offs) = c.longs(docs["doc_id"]), c.buffers(docs["text"])
        tag = tags(data, offs) if len(some[0]) else None
        removed, spans, prints, texts, edges = [], [], [], [], []
        for lo, hi in c.slices(offs):
            base = int(offs[lo])
            gone = _covered(lo, hi, ids, tag, data, offs, whole, some)
            cut = offs[lo : hi + 1] - base
            total = np.concatenate([[0], np.cumsum(gone)])
            begins = gone.copy()
            begins[1:] &= ~gone[:-1]
            at = cut[:-1][cut[:-1] < len(gone)]
            begins[at] = gone[at]
            opened = np.concatenate([[0], np.cumsum(begins)])
            removed.append(np.diff(total[cut]))
            spans.append(np.diff(opened[cut]))
            kept = data[base : int(offs[hi])][~gone].tobytes()
            left = cut - total[cut]
            parts = [kept[a:b] for a, b in zip(left[:-1], left[1:])]
            prints += [hashlib.sha256(x).hexdigest() for x in parts]
            if keep_text:
                texts += parts
                for a, b in zip(cut[:-1], cut[1:]):
                    edges.append(np.flatnonzero(np.diff(np.concatenate([[0], gone[a:b].view(np.int8), [0]]))).tolist())
        cols = [pc.if_else(docs["given"].combine_chunks(), pa.array(ids), pa.scalar(None, pa.int64())), np.diff(offs), np.concatenate(removed), np.concatenate(spans), prints, texts, edges]
        return pa.table([pa.array(x, k) if not isinstance(x, pa.Array) else x for x, k in zip(cols[: len(names)], kinds)], names=names)

    return run


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", keep_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document; with keep_text also the kept bytes and the
    removed spans (start, end, start, end, ... in bytes)."""
    spark = docs.sparkSession
    width = c.shuffle_width(spark)
    numbers = even_numbers(spark, width)  # of parts and of groups: answers are at most a row for each pair of them
    given = F.col(key).isNotNull().alias("given")
    docs = docs.select(F.coalesce(F.col(key).cast("long"), F.lit(c.NULL_ID)).alias("doc_id"), given, F.col(text).cast("string").alias("text"))
    cuts = docs.agg(F.percentile_approx("doc_id", [k / BATCHES for k in range(1, BATCHES)], 1000)).first()[0]
    bounds = sorted(set(cuts or []))
    lot = F.pmod(F.xxhash64("doc_id"), F.lit(width)).cast("int")
    dealt = docs.select(F.element_at(F.lit(numbers), lot + 1).alias("g"), "doc_id", "given", "text").groupBy("g")
    sent = dealt.applyInArrow(_send(numbers), "part int, batch int, g int, block binary")
    coarse = sent.repartition(width, "part").sortWithinPartitions("part", "batch").mapInArrow(_coarse(bounds), "g int, kind int, block binary")
    coarse = c.written(coarse, "suffix-answers")
    looked = dealt.cogroup(coarse.where("kind in (2, 4)").groupBy("g")).applyInArrow(_look(numbers, bounds), "part int, batch int, block binary")
    fine = looked.repartition(width, "part").sortWithinPartitions("part", "batch").mapInArrow(_fine(numbers), "g int, kind int, block binary")
    said = coarse.where("kind = 1").unionByName(fine)
    schema = RESULT + (", kept binary, spans array<long>" if keep_text else "")
    return dealt.cogroup(said.groupBy("g")).applyInArrow(_apply(keep_text), schema)
