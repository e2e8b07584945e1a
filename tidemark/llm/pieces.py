"""SentencePiece encoding and decoding with a published model, by Viterbi over many words at once in numpy.

A text becomes units: no piece holds a space mark behind another character or a line end, so each word with its space
mark, and each line end, is encoded by itself.  Units of one length advance together: rolling hashes of their
substrings probe the sorted keys of pieces of that length, each end position takes the maximum over the pieces that end
there, and a stored backpointer gives the path.  For unigram models the maximum is over summed log scores.  For
merge-rank (BPE) models a plain sum of scores does not give the model's encoding, so the score of a step is 0 or minus
infinity: a piece may follow the last piece of the prefix only if merging the two side by side would leave the border
between them in place.  Every prefix then has exactly one admissible last piece, and the path is the model's own
encoding.  What may follow depends on the last pieces of no more prefixes than the widest piece has characters, so a long
unit goes through the same lattice in windows that advance together: each starts some characters early, and where its
states don't agree with those of the window before it, it is run again from those.  The lattice needs pieces whose own
last merge is due last; of the runs of space marks some are not, so units that begin with such a run are merged in the
model's order, pair by pair.

Texts: null and empty give no ids; only U+0020 is marked, as in the model; unknown characters fall back to byte pieces;
decoding gives the text back but for a literal U+2581, which the model itself can't tell from a space.  Null ids stay
null, repeated rows repeat, other columns are ignored (`encode_column` keeps them).
"""

from __future__ import annotations

import heapq
import re
import struct
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import _common as c

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: Characters of a window of a long unit; units up to this length are one window.
WINDOW = 64
#: Windows that are worked on together.
WINDOWS = 4096
#: Text bytes whose new units are encoded together.
UNIT_BYTES = 3 << 20
#: Units that a worker remembers before it starts afresh.
REMEMBER = 600_000
#: A line end; or marks and what follows them up to the next mark or line end.
UNIT = re.compile(f"\n|{MARK}*[^{MARK}\n]+|{MARK}+")
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _varint(b: bytes, i: int) -> tuple[int, int]:
    x = shift = 0
    while True:
        x |= (b[i] & 127) << shift
        i, shift = i + 1, shift + 7
        if b[i - 1] < 128:
            return x, i


def _fields(b: bytes):
    i = 0
    while i < len(b):
        tag, i = _varint(b, i)
        if tag & 7 == 0:
            v, i = _varint(b, i)
        elif tag & 7 == 2:
            n, i = _varint(b, i)
            v, i = b[i : i + n], i + n
        else:
            n = 4 if tag & 7 == 5 else 8
            v, i = struct.unpack("<f", b[i : i + 4])[0] if n == 4 else b[i : i + 8], i + n
        yield tag >> 3, v


class Model:
    """Pieces of a model file and the tables for encoding; read once on the driver and broadcast."""

    UNKNOWN, CONTROL, BYTE = 2, 3, 6

    def __init__(self, path: str = MODEL):
        with open(path, "rb") as f:
            raw = f.read()
        pieces, kind = [], 1
        for tag, v in _fields(raw):
            if tag == 1:
                p = dict(_fields(v))
                pieces.append((p[1].decode(), p.get(2, 0.0), p.get(3, 1)))
            elif tag == 2:
                kind = dict(_fields(v)).get(3, 1)
        self.bpe = kind == 2
        self.text = [p for p, _, _ in pieces]
        self.score = np.array([s for _, s, _ in pieces])
        self.byte = np.full(256, -1, np.int32)
        self.normal: dict[str, int] = {}
        self.unknown = 0
        for i, (p, _, t) in enumerate(pieces):
            if t == self.BYTE:
                self.byte[int(p[3:5], 16)] = i
            elif t == self.UNKNOWN:
                self.unknown = i
            elif t != self.CONTROL:
                self.normal[p] = i
        if any(MARK in p.lstrip(MARK) or "\n" in p for p in self.normal):
            raise ValueError("a piece crosses a unit border; this model needs another way to cut units")
        # bytes of each piece, for decoding
        out = [b"" if t in (self.CONTROL,) else bytes([int(p[3:5], 16)]) if t == self.BYTE else " ⁇ ".encode() if t == self.UNKNOWN else p.replace(MARK, " ").encode() for p, _, t in pieces]
        self.out_at = np.concatenate([[0], np.cumsum([len(x) for x in out])]).astype(np.int64)
        self.out = np.frombuffer(b"".join(out), np.uint8)
        n = len(pieces)
        self.rank, self.left, self.right = np.zeros(n + 1, np.int64), np.arange(n + 1), np.arange(n + 1)
        self.late = np.zeros(n + 1, np.int64)  # the latest of all merges that make a piece
        usable = dict(self.normal)
        if self.bpe:
            order = sorted((i for p, i in self.normal.items() if len(p) > 1), key=lambda i: (-self.score[i], i))
            for r, i in enumerate(order):
                self.rank[i] = r + 1
            for p, i in self.normal.items():
                if len(p) > 1:
                    pair = self._last_merge(p)
                    if pair is None:
                        usable.pop(p)  # no merge ever makes it
                    else:
                        self.left[i], self.right[i] = pair
            for i in sorted(usable.values(), key=lambda i: len(self.text[i])):
                inner = [int(self.late[x]) for x in (self.left[i], self.right[i]) if x != i]
                self.late[i] = max([int(self.rank[i]), *inner])
                if self.late[i] > self.rank[i] and self.text[i].strip(MARK):
                    raise ValueError(f"the last merge of {self.text[i]!r} is due early; this model needs another lattice")
        top = n + 1
        pairs = np.array(sorted((int(self.left[i]) * top + int(self.right[i]), int(self.rank[i])) for i in usable.values() if self.rank[i]) or [(-1, 0)])
        self.pair, self.pair_rank = pairs[:, 0].copy(), pairs[:, 1].copy()
        self.pair_maybe = np.zeros(1 << 20, bool)  # most pairs of pieces never merge
        self.pair_maybe[self._spot(self.pair)] = True
        self.keys: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        by: dict[int, list[int]] = {}
        for p, i in usable.items():
            by.setdefault(len(p), []).append(i)
        for size, ids in by.items():
            cp = np.array([[ord(ch) for ch in self.text[i]] for i in ids], np.uint64)
            h = np.zeros(len(ids), np.uint64)
            with np.errstate(over="ignore"):
                for k in range(size):
                    h = h * _BASE + c.mix(cp[:, k])
            at = np.argsort(h)
            self.keys[size] = h[at], np.array(ids, np.int32)[at]
        self.widest = max(by, default=1)
        self.maybe = np.zeros(1 << 20, bool)  # by the top bits of a key: most substrings end here
        for keys, _ in self.keys.values():
            self.maybe[keys >> np.uint64(44)] = True

    # ------------------------------------------------ one unit, by a heap
    def merges(self, unit: str) -> list[str]:
        """The pieces of a unit by merging the best pair, leftmost first, until no pair is a piece."""
        sym = list(unit)
        nxt, prv = list(range(1, len(sym) + 1)), list(range(-1, len(sym) - 1))
        heap: list = []

        def offer(i):
            j = nxt[i]
            if j < len(sym):
                p = self.normal.get(sym[i] + sym[j])
                if p is not None:
                    heapq.heappush(heap, (-self.score[p], i, j, sym[i], sym[j]))

        for i in range(len(sym) - 1):
            offer(i)
        self._final = None
        while heap:
            _, i, j, a, b = heapq.heappop(heap)
            if sym[i] != a or sym[j] != b or nxt[i] != j:
                continue
            self._final = a, b
            sym[i], sym[j] = a + b, ""
            nxt[i] = nxt[j]
            if nxt[j] < len(sym):
                prv[nxt[j]] = i
            offer(i)
            if prv[i] >= 0:
                offer(prv[i])
        return [s for s in sym if s]

    def _last_merge(self, piece: str):
        if self.merges(piece) != [piece]:
            return None
        a, b = self._final
        return self.normal.get(a, len(self.text)), self.normal.get(b, len(self.text))

    def ids_of(self, parts: list[str]) -> list[int]:
        out: list[int] = []
        for p in parts:
            i = self.normal.get(p)
            if i is not None:
                out.append(i)
            elif self.byte[0] >= 0:
                out += [int(self.byte[x]) for x in p.encode()]
            else:
                out.append(self.unknown)
        return out

    # ------------------------------------------------ many units of one length
    @staticmethod
    def _spot(key: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (key.astype(np.uint64) * _BASE) >> np.uint64(44)

    def _bordered(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the border between pieces a and b outlasts merging: their merges are undone, latest first, and no
        pair across the border may have been due before the merge undone last."""
        ok = np.ones(len(a), bool)
        live = np.arange(len(a))
        limit = np.full(len(a), np.iinfo(np.int64).max)
        a, b = a.copy(), b.copy()
        top = len(self.text) + 1
        while len(live):
            key = a * top + b
            due = np.zeros(len(key), bool)
            ask = np.flatnonzero(self.pair_maybe[self._spot(key)])
            at = np.minimum(np.searchsorted(self.pair, key[ask]), len(self.pair) - 1)
            due[ask] = (self.pair[at] == key[ask]) & (self.pair_rank[at] < limit[ask])
            ok[live[due]] = False
            ra, rb = self.rank[a], self.rank[b]
            go = ~due & ((ra > 0) | (rb > 0))
            live, a, b, ra, rb = live[go], a[go], b[go], ra[go], rb[go]
            first = ra > rb
            limit = np.where(first, ra, rb + 1)
            a, b = np.where(first, self.right[a], a), np.where(first, b, self.left[b])
        return ok

    def viterbi(self, cp: np.ndarray, carried: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Last pieces (len(self.text): a character without a piece) and their lengths: arrays of (units, positions) in
        which entry e is that of the prefix of e characters.  `carried` gives the first entries where they are known."""
        n, size = cp.shape
        none = len(self.text)
        value = c.mix(cp.astype(np.uint64))
        last = np.full((n, size + 1), none, np.int64)
        back = np.zeros((n, size + 1), np.int16)
        total = np.full((n, size + 1), -np.inf)
        begin = 1 if carried is None else carried.shape[1]
        total[:, :begin] = 0
        if carried is not None:
            last[:, :begin] = carried
        found: dict[tuple[int, int], np.ndarray] = {}
        h = np.zeros((n, size), np.uint64)
        with np.errstate(over="ignore"):
            for k in range(1, min(self.widest, size) + 1):
                h = h[:, : size - k + 1] * _BASE + value[:, k - 1 :]
                if k in self.keys:
                    keys, ids = self.keys[k]
                    ask = np.flatnonzero(self.maybe[h.reshape(-1) >> np.uint64(44)])
                    probe = h.reshape(-1)[ask]
                    at = np.minimum(np.searchsorted(keys, probe), len(keys) - 1)
                    hit = np.full(h.size, -1, np.int32)
                    hit[ask] = np.where(keys[at] == probe, ids[at], -1)
                    hit = hit.reshape(h.shape)
                    for s in range(size - k + 1):
                        if (hit[:, s] >= 0).any():
                            found[s, k] = hit[:, s]
        for e in range(begin, size + 1):
            rows, starts, piece = [], [], []
            for k in range(1, min(self.widest, e) + 1):
                s = e - k
                ids = found.get((s, k))
                if ids is None:
                    if k > 1:
                        continue
                    ids = np.full(n, -1)
                at = np.flatnonzero(np.isfinite(total[:, s]) & ((ids >= 0) | (k == 1)))
                if len(at):
                    rows.append(at)
                    starts.append(np.full(len(at), s))
                    piece.append(ids[at])
            at, s, p = np.concatenate(rows), np.concatenate(starts), np.concatenate(piece).astype(np.int64)
            p[p < 0] = none
            if self.bpe:
                before = last[at, s]
                gain = np.zeros(len(at))
                ask = np.flatnonzero((p != none) & (before != none) & (s > 0))
                gain[ask] = np.where(self._bordered(before[ask], p[ask]), 0, -np.inf)
            else:
                gain = np.where(p == none, self.score.min() - 10, self.score[np.minimum(p, none - 1)])
            new = total[at, s] + gain
            np.maximum.at(total[:, e], at, new)  # the best over all pieces that end here
            best = np.flatnonzero((new == total[at, e]) & np.isfinite(new))
            last[at[best], e], back[at[best], e] = p[best], e - s[best]
        return last, back

    def _windows(self, unit: str) -> list[int]:
        """Ids of a long unit."""
        if not self.bpe:  # sums of scores, not states, would have to agree
            cp = np.frombuffer(unit.encode("utf-32-le"), np.uint32).reshape(1, -1)
            last, back = (x[0] for x in self.viterbi(cp))
        else:
            cp, n, wide = np.frombuffer(unit.encode("utf-32-le"), np.uint32), len(unit), self.widest
            early = max(WINDOW, 2 * wide)
            last, back = np.full(n + 1, len(self.text), np.int64), np.zeros(n + 1, np.int16)
            begin = np.arange(0, n, WINDOW)
            from_, to = np.maximum(begin - early, 0), np.minimum(begin + WINDOW, n)
            known: dict[bytes, tuple[np.ndarray, np.ndarray]] = {}
            for lo in range(0, len(begin), WINDOWS):
                span = np.arange(lo, min(lo + WINDOWS, len(begin)))
                got: dict[int, tuple[np.ndarray, np.ndarray]] = {}
                for size in np.unique((to - from_)[span]):
                    mine = span[(to - from_)[span] == size]
                    a, b = self.viterbi(cp[from_[mine][:, None] + np.arange(size)])
                    got |= {int(w): (a[k], b[k]) for k, w in enumerate(mine)}
                for w in span.tolist():
                    at, end, off = int(begin[w]), int(to[w]), int(begin[w] - from_[w])
                    a, b = got[w]
                    first = max(at - wide, 0)
                    if at and (a[off - (at - first) + 1 : off + 1] != last[first + 1 : at + 1]).any():
                        carried = last[first : at + 1]
                        key = carried.tobytes() + cp[first:end].tobytes()
                        if key not in known:
                            a, b = self.viterbi(cp[None, first:end], carried[None])
                            known[key] = a[0, at - first :], b[0, at - first :]
                        last[at : end + 1], back[at : end + 1] = known[key]
                        back[at] = back_at
                    else:
                        last[at + 1 : end + 1], back[at + 1 : end + 1] = a[off + 1 :], b[off + 1 :]
                    back_at = back[end]
        ids, e, parts = [], len(unit), []
        while e:
            p, s = int(last[e]), e - int(back[e])
            parts.append(self.ids_of([unit[s]]) if p == len(self.text) else [p])
            e = s
        for part in reversed(parts):
            ids += part
        return ids

    def encode_units(self, units: list[str], lead: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the units, one after the other, and their number for each; where `lead` is set, a line end's ids
        come first."""
        at, start, piece = [], [], []  # unit, place in the unit, id

        def spell(i: int, ids: list[int]):
            at.append(np.full(len(ids), i))
            start.append(np.arange(len(ids)))
            piece.append(np.array(ids, np.int64))

        if lead is not None:
            line = self.ids_of(["\n"])
            where = np.flatnonzero(lead)
            at.append(np.repeat(where, len(line)))
            start.append(np.tile(np.arange(-len(line), 0), len(where)))
            piece.append(np.tile(np.array(line, np.int64), len(where)))
        by: dict[int, list[int]] = {}
        for i, u in enumerate(units):
            if self.bpe and u.startswith(MARK + MARK):
                spell(i, self.ids_of(self.merges(u)))
            elif len(u) > WINDOW:
                spell(i, self._windows(u))
            elif u:
                by.setdefault(len(u), []).append(i)
        for size, rows in by.items():
            cp = np.frombuffer("".join([units[i] for i in rows]).encode("utf-32-le"), np.uint32).reshape(-1, size)
            last, back = self.viterbi(cp)
            row = np.array(rows)
            live, end = np.arange(len(rows)), np.full(len(rows), size)
            odd = np.zeros(len(rows), bool)
            steps = []
            while len(live):
                p, s = last[live, end], end - back[live, end]
                odd[live[p == len(self.text)]] = True
                steps.append((live, s, p))
                go = s > 0
                live, end = live[go], s[go]
            for live, s, p in steps:
                fine = ~odd[live]
                at.append(row[live[fine]])
                start.append(s[fine])
                piece.append(p[fine])
            for r in np.flatnonzero(odd):
                ids, e = [], size
                while e:
                    p, s = int(last[r, e]), e - int(back[r, e])
                    ids = (self.ids_of([units[row[r]][s]]) if p == len(self.text) else [p]) + ids
                    e = s
                spell(int(row[r]), ids)
        if not at:
            return np.zeros(0, np.int32), np.zeros(len(units), np.int64)
        a, s, p = np.concatenate(at), np.concatenate(start), np.concatenate(piece)
        order = np.lexsort((s, a))
        return p[order].astype(np.int32), np.bincount(a, minlength=len(units))


class Encoder:
    """A worker's encoder: remembers the ids of units it has met."""

    def __init__(self, model: Model):
        self.model = model
        self._reset()

    def _reset(self):
        self.known: dict[str, int] = {}
        self.flat, self.used = np.zeros(1 << 16, np.int32), 0
        self.first, self.size = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int32)

    @staticmethod
    def units(text: str) -> list[str]:
        """Units of a text: a plain word stands for its space mark and itself, one that starts with a line end for
        itself; those with other runs of marks are spelt out (with the mark first)."""
        if not text:
            return []
        words = text.replace("\n", " \n").split(" ")
        if "" not in words and MARK not in text:
            return words
        out, line = [], False
        for u in UNIT.findall(MARK + text.replace(" ", MARK)):
            if u == "\n":
                if line:
                    out.append(u)
                line = True
            elif u[0] != MARK:  # only behind a line end
                out.append("\n" + u)
                line = False
            else:
                if line:
                    out.append("\n")
                line = False
                out.append(u[1:] if len(u) > 1 and u[1] != MARK else u)
        return [*out, "\n"] if line else out

    def _learn(self, units: list[str]):
        lead = np.array([u[0] == "\n" for u in units])
        spelt = [u[1:] if u[0] == "\n" else u if u[0] == MARK else MARK + u for u in units]
        ids, size = self.model.encode_units(spelt, lead)
        n = len(self.known)
        if self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat[: self.used], np.zeros(self.used + 2 * len(ids), np.int32)])
        if n + len(units) > len(self.first):
            more = np.zeros(n + 2 * len(units), np.int64)
            self.first, self.size = np.concatenate([self.first[:n], more]), np.concatenate([self.size[:n], more.astype(np.int32)])
        self.flat[self.used : self.used + len(ids)] = ids
        self.first[n : n + len(units)] = self.used + np.cumsum(size) - size
        self.size[n : n + len(units)] = size
        self.used += len(ids)
        self.known.update(zip(units, range(n, n + len(units))))

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and where each text's begin."""
        parts = [self.units(t or "") for t in texts]
        flat = list(chain.from_iterable(parts))
        new = [u for u in set(flat) if u not in self.known]
        if len(self.known) + len(new) > REMEMBER:
            self._reset()
            new = list(set(flat))
        if new:
            self._learn(new)
        unit = np.fromiter(map(self.known.__getitem__, flat), np.int64, len(flat))
        size = self.size[unit].astype(np.int64)
        pos = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size - self.first[unit], size)
        ends = np.concatenate([[0], np.cumsum(size)])
        return self.flat[pos], ends[np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)]


def decode(model: Model, ids: np.ndarray, at: np.ndarray) -> pa.Array:
    """Texts of id rows: bytes of the pieces, without the first space mark."""
    size = (model.out_at[1:] - model.out_at[:-1])[ids]
    pos = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size - model.out_at[ids], size)
    raw = model.out[pos]
    cut = np.concatenate([[0], np.cumsum(size)])[at]
    lead = np.zeros(len(at) - 1, bool)
    full = np.flatnonzero(cut[1:] > cut[:-1])
    lead[full] = raw[cut[full]] == 32
    keep = np.ones(len(raw), bool)
    keep[cut[:-1][lead]] = False
    offs = np.concatenate([[0], np.cumsum(np.diff(cut) - lead)]).astype(np.int32)
    return pa.Array.from_buffers(pa.string(), len(offs) - 1, [None, pa.py_buffer(offs.tobytes()), pa.py_buffer(raw[keep].tobytes())])


def _encoded(model, text: str):
    def run(batches):
        worker = Encoder(model.value)
        for b in batches:
            own = pc.cast(b[text], pa.string())
            for lo, hi in c.slices(c.buffers(own)[1], UNIT_BYTES):
                part = own.slice(lo, hi - lo)
                ids, at = worker.encode(part.to_pylist())
                yield b.slice(lo, hi - lo), part, ids, at

    return run


def encode(docs: DataFrame, model_path: str = MODEL, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids, round_trip (whether decoding the ids gives the text back)."""
    model = docs.sparkSession.sparkContext.broadcast(Model(model_path))
    docs = c.id_text(docs, key, text)
    steps = _encoded(model, text)

    def run(batches):
        for b, part, ids, at in steps(batches):
            back = pc.equal(decode(model.value, ids, at), pc.fill_null(part, ""))
            yield pa.RecordBatch.from_arrays(
                [b[key], pa.array(np.diff(at).astype(np.int64)), pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids)), back],
                [key, "n_tokens", "ids", "round_trip"],
            )

    return docs.mapInArrow(run, f"{key} long, n_tokens long, ids array<int>, round_trip boolean")


def decode_rows(rows: DataFrame, model_path: str = MODEL, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """doc_id, text of rows of ids; null ids give an empty text."""
    model = rows.sparkSession.sparkContext.broadcast(Model(model_path))
    rows = rows.select(F.col(key).cast("long").alias(key), F.coalesce(F.col(ids), F.array().cast("array<int>")).alias("ids"))

    def run(batches):
        for b in batches:
            flat = b["ids"].flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            at = np.concatenate([[0], np.cumsum(pc.list_value_length(b["ids"]).to_numpy(zero_copy_only=False))]).astype(np.int64)
            yield pa.RecordBatch.from_arrays([b[key], decode(model.value, flat, at)], [key, "text"])

    return rows.mapInArrow(run, f"{key} long, text string")
