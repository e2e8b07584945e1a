"""Personal data: exact base patterns, and a linear-chain conditional random field over word-shape features.

The base finds e-mail addresses, IPv4 addresses, payment cards and international phone numbers by pattern; the field
adds spans that the patterns miss (local phone numbers, credentials, addresses with non-ASCII parts, cards in odd
groups) and never takes one away.  The field is trained on a small labelled table (TABLE, filled in with seeded random
digits and names) by exact forward-backward gradients, and decoded by Viterbi in numpy over all lines of a slice at
once.  Chains are whole lines of text, however long; they are decoded in pieces only between words whose label no
neighbour can change, so the labels are those of the whole line.

Offsets count code points, ends are exclusive.  A null text is empty and has no spans; null ids stay null; repeated rows
repeat; other columns are ignored by `find` and kept by `redact`.  All scans are linear in the length of the text.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import _common as c
from tidemark.llm import _crf

KINDS = ("email", "ip", "card", "phone")
LABELS = ("O", "email", "ip", "card", "phone", "secret")

# ---------------------------------------------------------------- base patterns
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def _emails(t: str) -> list[tuple[int, int]]:
    out, done, at = [], 0, t.find("@")
    bound = 0
    while at >= 0:
        seg = t[bound:at]
        start = bound + len(seg.rstrip(_LOCAL))
        if start < at and (m := _DOMAIN.match(t, at + 1)):
            out.append((start, m.end()))
            done = m.end()
        bound = max(done, at + 1)
        at = t.find("@", bound)
    return out


def luhn(digits: str) -> bool:
    total = 0
    for k, ch in enumerate(reversed(digits)):
        d = ord(ch) - 48
        if k % 2:
            d = 2 * d - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _ips(t: str):
    return [m.span() for m in _IP.finditer(t) if all(len(p) <= 3 and int(p or "0") <= 255 for p in (x.lstrip("0") for x in m[0].split(".")))]


def _cards(t: str):
    return [m.span() for m in _CARD.finditer(t) if 16 <= len(x := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(x)]


def _phones(t: str):
    return [m.span() for m in _PHONE.finditer(t) if 8 <= sum(ch in "0123456789" for ch in m[0]) <= 15]


def base_spans(t: str) -> list[tuple[str, int, int]]:
    """Leftmost, non-overlapping for each kind; by kind as listed, then start."""
    return [(kind, a, b) for kind, f in zip(KINDS, (_emails, _ips, _cards, _phones)) for a, b in f(t)]


# ---------------------------------------------------------------- the labelled table
#: label|text; {..} fields are filled at random, <kind:...> marks a span.
TABLE = """
Please write to <email:{n}.{n}@{n}.com> before noon
contact <email:{n}{d}@mail.{n}.org>, or call <phone:+{d} ({ddd}) {ddd}-{dddd}>
{W} {w} {w} <phone:+{dd} {dd} {dddd} {dddd}> {w} {w}.
{w} tel. <phone:({ddd}) {ddd}-{dddd}> {w}
phone: <phone:{ddd}-{ddd}-{dddd}> {w} {w}
{w} call <phone:{ddd}-{ddd}-{dddd}> {w}
{w} {w} {w} <phone:{ddd} {ddd} {dddd}> {w} {w} {w}
{w} {w} <phone:({ddd}) {ddd}-{dddd}> {w} {w} {w}
{w} in <phone:{ddd} {ddd} {dddd}> {w} {w}
{w} and <phone:{ddd} {ddd} {dddd}> {w} {w}
mail <email:{u}@{u}.es> {w}
call me on <phone:{ddd} {ddd} {dddd}> today
{w} {w} <ip:{o}.{o}.{o}.{o}> {w}, {w}
server <ip:{o}.{o}.{o}.{o}>:{dddd} is down
{W} {w} <card:{dddd}{dddd}{dddd}{dddd}> {w} {w} {w}.
card <card:{dddd} {dddd} {dddd} {dddd}> expires {dd}/{dd}
card number: <card:{dddd}-{dddd}-{dddd}-{dddd}>
token = "<secret:{x}>" {w} {w}
{w} token = "<secret:{x}>".
password: <secret:{p}> {w} {w}
api_key=<secret:{x}>
secret <secret:{x}> {w} {w}
{W} {w} <email:{n}.{dd}@mail{d}.{n}.com> {w} {w}
correo <email:{u}@{u}.es> {w} {w}
{W} {w} {w} {w} {w}, {w} {w} {w}. {W} {w} {w}
{W}. {W} {w}. {w} {w} {w} of {w} the {w}
{W} {w} in {dddd}, {w} {dd} {w} and {d} {w}
{w}$$$ {w}### {w}*** {w}&&& {w}%%% {w}.***
{U}!! {U}!! {U},!! {U}!! {U}.!!
{w} | {w} | {w}, | {U} | {w}.
version {d}.{d}.{dd} of {w}, {w} {w}
{w} {w} on {dddd}-{dd}-{dd} at {dd}:{dd}
price {d},{ddd}.{dd} {w} {dd}% {w} #{ddd}
order {dddddd} {w} page {ddd} {w} no. {dd}
https://www.{n}.com/{w}/{ddd} {w} {w}
{w} ({w} {w}) {W} {w}: {w} {w}; {w}
ISBN {ddd}-{d}-{dddd} {w} {w} {w}
{W} & {w} @ {w} {w} + {w} = {w} "{w}" {w}
(c) {dddd} {W} {W}. {W} {w} {w} license {w}
{a} {a} {a} {w} {a}, {a}. {A} {w} {a}
{ddd} {ddd} {dd} {w} {dddd} {w}, {ddd}
def {w}(x): return x[{d}] + {dd} * {w}_{w}
{W}. {W}. {W}. {W}. {W}. {W}. {W}. {W}. {W}.
{A}. {A}. {A}. {A}, {A}, {A}, {w}, {w}, {w}. {w}.
{w}{d} {w}{dd} {w}{ddd} {w}{dddd} {w}{ddddd}
{w}{d} {w}{d} {w}{dd} {w}{dd} {w}{ddd} {w}{ddd} {w}{dddd} {w}{dddd} {w}{ddddd} {w}{ddddd}
{w}{d} {w}{d} {w}{d} {w}{d} {w}{d} {w}{d} {w}{d} {w}{d}
{w}{dd} {w}{dd} {w}{dd} {w}{dd} {w}{dd} {w}{dd} {w}{dd} {w}{dd}
{w}{ddd} {w}{ddd} {w}{ddd} {w}{ddd} {w}{ddd} {w}{ddd} {w}{ddd} {w}{ddd}
{w}{dddd} {w}{dddd} {w}{dddd} {w}{dddd} {w}{dddd} {w}{dddd} {w}{dddd}
{w}{ddddd} {w}{ddddd} {w}{ddddd} {w}{ddddd} {w}{ddddd} {w}{dddddd} {w}{ddddddd}
{l}{dddd} {l}{ddddd} {w} {l}{ddd} {l}{dd} {l}{d} {w} {l}{dddd}
{W}{d} {w}-{dd} {w}_{ddd} {U}{dd} {U}-{dddd} {W}{dddd}, {w}{dd}.
{d}{w} {dd}{w} {dddd}{w} {dd}{U} {w}{d}{w} {w}{dd}{w}{d} {ddd}{l}
{w} {d}.{d}.{d} {w} v{d}.{dd} {w} {dd}.{d}.{ddd} {w}-{d}.{d}.{dd}
{w} in {y} and {y}, {y} {y} {y} {y} {y} {y}
{y} {y} {y} {y}
{w} {y}, {y}, {y}, {y} {w} ({y}) {w} {y}-{y} {w} {y}/{dd}
{y} {y} {y} {y} {y} {y} {y} {y} {y} {y}
{d} {ddd} {ddd} {ddd} {w} {w}
{dd} {ddd} {ddd} {w} {ddd} {ddd} {w} {w}
{ddd} {ddd} {ddd} {w} {w} {d} {ddd} {ddd}
{d},{ddd},{ddd} {w} {dd},{ddd} {w} {ddd},{ddd},{ddd} {w} {d}.{ddd}.{ddd},{dd}
ISBN {ddd}-{d}-{dd}-{dddddd}-{d} {w} {w}
{W} {w}, ISBN {d}-{ddd}-{ddddd}-{d}. ISBN-13: {ddd}-{d}-{dddd}-{dddd}-{d}
ISBN {ddd}{ddddd}{ddddd} {w} ISSN {dddd}-{dddd} {w}
{ddd} {dd} {ddd} {dd} {dddd} {dd} {d} {ddd}
{dd} {dd} {dd} {dd} {dd} {d} {ddd} {dd}
{d}.{dd} {dd}.{dd} {d}.{ddd} {w} {dddd} {ddd} {dddd} {dd} {ddddd}
{dddddd} {dddddd} {w} {ddddddd} {ddddd} {dddddddd} {w}
{dd}:{dd}:{dd} {w} {dddd}-{dd}-{dd}T{dd}:{dd} {w} {dd}/{dd}/{dddd}
{w} {ddddd} {w} {dddddd} {w} {ddddddd} {w} {dddd} {w} {dddd} {ddd} {w}
""".strip().splitlines()
COPIES = 12


def labelled_rows(copies: int = COPIES) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """The table, filled: (text, [(start, end, kind)])."""
    rng = np.random.Generator(np.random.PCG64(1313))
    syl = ["th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha", "at", "en", "ou", "la", "que", "sch", "ung", "tion", "mar", "jo", "li"]
    odd = ["é", "ü", "ñ", "ç", "ö", "à"]

    def word(k=None):
        return "".join(rng.choice(syl) for _ in range(k or int(rng.integers(1, 5))))

    def fill(m):
        f = m[1]
        if set(f) == {"d"}:
            return "".join(str(rng.integers(0, 10)) for _ in f)
        if f == "o":
            return str(rng.integers(1, 256))
        if f == "y":
            return str(rng.integers(1960, 2030))
        if f == "l":
            return str(rng.choice(list("abcdefghxyzABCX")))
        if f == "x":
            return "".join(rng.choice(list("0123456789abcdef")) for _ in range(int(rng.choice([32, 40, 40, 64]))))
        if f == "p":
            return word(2).capitalize() + str(rng.integers(10, 9999)) + str(rng.choice(list("!#$_")))
        w = word(2) if f == "n" else word()
        if f in "uaA":
            at = int(rng.integers(0, len(w) + 1))
            w = w[:at] + str(rng.choice(odd)) + w[at:]
        return w.capitalize() if f in "WA" else w.upper() if f == "U" else w

    rows = []
    for _ in range(copies):
        for line in TABLE:
            text, spans = "", []
            for bit in re.split(r"(<\w+:[^<>]*>)", line):
                m = re.fullmatch(r"<(\w+):([^<>]*)>", bit)
                piece = re.sub(r"\{(\w+)\}", fill, m[2] if m else bit)
                if m:
                    spans.append((len(text), len(text) + len(piece), m[1]))
                text += piece
            rows.append((text, spans))
    return rows


def table(spark: SparkSession) -> DataFrame:
    """The labelled table as rows of text and spans."""
    rows = [(t, [{"start": a, "end": b, "kind": k} for a, b, k in s]) for t, s in labelled_rows()]
    return spark.createDataFrame(rows, "text string, spans array<struct<start:int, end:int, kind:string>>")


# ---------------------------------------------------------------- features
_CLASS = np.full(256, 15, np.uint8)
for _k, _chars in enumerate(["ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789", "@", ".", "-", "+", "()", ":=", "\"'", "_", "/", ",;", "!?#$%&*|"]):
    _CLASS[[ord(x) for x in _chars]] = _k
_CLASS[128:] = 14
_HEX = np.zeros(256, bool)
_HEX[[ord(x) for x in "0123456789abcdefABCDEF\"'"]] = True
_SHAPE_VALUE = np.random.Generator(np.random.PCG64(5)).integers(1, 1 << 62, 16, dtype=np.int64).astype(c.U64) * c.U64(2) + c.U64(1)


class Words:
    """Words of a slice with the hashes that the features come from."""

    def __init__(self, data: np.ndarray, offs: np.ndarray):
        self.starts, self.ends, self.row = c.word_spans(data, offs)
        n = len(self.starts)
        self.n, lens = n, self.ends - self.starts
        if not n:
            self.form = self.coarse = self.word = self.plain = np.zeros(0, c.U64)
            return
        first = np.cumsum(lens) - lens
        pos = np.repeat(self.starts - first, lens) + np.arange(int(lens.sum()))
        kind = _CLASS[data[pos]]
        new = np.ones(len(kind), bool)
        new[1:] = kind[1:] != kind[:-1]
        new[first] = True
        at = np.cumsum(new) - 1
        rank = at - np.repeat(at[first], lens)  # number of the run in its word
        digits = np.add.reduceat((kind == 2).astype(np.int64), first)
        hexes = np.add.reduceat(_HEX[data[pos]].astype(np.int64), first)
        with np.errstate(over="ignore"):
            values = _SHAPE_VALUE[kind] * c.powers(int(lens.max()) + 1)[rank]
            values[~new] = 0
            shape = c.mix(np.add.reduceat(values, first))
            seen = np.zeros(n, c.U64)
            for k in range(16):
                seen |= np.where(np.add.reduceat((kind == k).view(np.int8), first, dtype=np.int32) > 0, c.U64(1 << k), c.U64(0)) if k in (0, 1, 2, 3, 4, 6) else c.U64(0)
            bucket = np.minimum(np.where(lens < 12, lens // 4, 3 + (lens >= 16) + (lens >= 24)), 5).astype(c.U64)
            digs = np.minimum(np.where(digits < 5, digits, 5 + (digits >= 8) + (digits >= 13)), 7).astype(c.U64)
            hexy = ((hexes == lens) & (lens >= 24)).astype(c.U64)
            self.form = c.mix(shape + digs * c.U64(1 << 8) + bucket * c.U64(1 << 16) + hexy * c.U64(1 << 24))
            self.coarse = c.mix(seen * c.U64(64) + digs * c.U64(8) + (lens >= 16).astype(c.U64) * c.U64(2) + hexy)
        self.word = c.word_hashes(data, self.starts, self.ends)
        at_sign, letters = (np.add.reduceat(x.astype(np.int64), first) > 0 for x in (kind == 3, (kind <= 1) | (kind == 14)))
        self.plain = np.where(at_sign, 0, np.where(digits == 0, 1, np.where(letters, 2, 0)))  # words, words with digits, and others

    def chains(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First word and length of every chain: words of one line of one row."""
        if not self.n:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        lines = np.concatenate([[0], np.cumsum(data == 10)])[self.starts]
        cut = np.zeros(self.n, bool)
        cut[0] = True
        cut[1:] = lines[1:] != lines[:-1]
        cut[self.row[:-1][self.row[:-1] < self.n]] = True
        first = np.flatnonzero(cut)
        return first, np.diff(np.concatenate([first, [self.n]]))


def _index(keys: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Place of x in sorted keys, or len(keys) where it isn't there."""
    at = np.minimum(np.searchsorted(keys, x), len(keys) - 1)
    return np.where(keys[at] == x, at, len(keys))


class Field:
    """Weights: for forms of a word, its neighbours and its text, a row for each label; and transitions."""

    PARTS = ("form", "coarse", "before", "after", "word", "word_before", "plain")

    def __init__(self, forms: np.ndarray, coarse: np.ndarray, words: np.ndarray):
        k = len(LABELS)
        self.forms, self.coarse, self.words = forms, coarse, words
        rows = {"form": forms, "coarse": coarse, "before": coarse, "after": coarse, "word": words, "word_before": words, "plain": (0,)}
        self.weights = {p: np.zeros((len(rows[p]) + 2, k)) for p in self.PARTS}  # unknown, and none at an end
        self.step, self.begin = np.zeros((k, k)), np.zeros(k)

    def places(self, w: Words, first: np.ndarray) -> dict[str, np.ndarray]:
        form, coarse, word = _index(self.forms, w.form), _index(self.coarse, w.coarse), _index(self.words, w.word)
        before, after, word_before = np.roll(coarse, 1), np.roll(coarse, -1), np.roll(word, 1)
        if len(first):
            before[first], word_before[first] = len(self.coarse) + 1, len(self.words) + 1
            after[np.concatenate([first[1:], [w.n]]) - 1] = len(self.coarse) + 1
        return {"form": form, "coarse": coarse, "before": before, "after": after, "word": word, "word_before": word_before, "plain": w.plain}

    def emissions(self, places: dict[str, np.ndarray]) -> np.ndarray:
        return sum(self.weights[p][places[p]] for p in self.PARTS)

    def decode(self, emit: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Best label of every word."""
        return _crf.viterbi_apart(emit, first, size, self.step, self.begin)


def train(rows=None, steps: int = 120, ridge: float = 1e-3) -> Field:
    """Fit the field to the labelled table by exact gradients of the log likelihood (Adam)."""
    rows = rows or labelled_rows()
    data, offs = c.buffers(pa.array([t for t, _ in rows]))
    w = Words(data, offs)
    lead = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    gold = np.zeros(w.n, np.int64)
    for r, (_, spans) in enumerate(rows):
        a, b = w.row[r], w.row[r + 1]
        s, e = lead[w.starts[a:b]] - lead[offs[r]], lead[w.ends[a:b]] - lead[offs[r]]
        for x, y, kind in spans:
            gold[a:b][(s < y) & (e > x)] = LABELS.index(kind)
    uniq, n = np.unique(w.word, return_counts=True)
    f = Field(np.unique(w.form), np.unique(w.coarse), uniq[n >= 6])
    first, size = w.chains(data)
    places = f.places(w, first)
    theta = f.weights | {"step": f.step, "begin": f.begin}

    def grads():
        delta, d_step, d_begin = _crf.gradient(f.emissions(places), first, size, f.step, f.begin, gold)
        out = {p: np.zeros_like(f.weights[p]) for p in f.PARTS} | {"step": d_step, "begin": d_begin}
        for p in f.PARTS:
            np.add.at(out[p], places[p], delta)
        return {p: g / len(first) - ridge * theta[p] for p, g in out.items()}

    _crf.adam(theta, grads, steps, 0.15)
    return f


# ---------------------------------------------------------------- both together
_TRIM = "\"'()[]{}<>,;:.!?=|*#$%&"


def spans(texts: pa.Array, field: Field) -> list[list[tuple[str, int, int, bool]]]:
    """For each text the spans (kind, start, end, in the base) by kind, then start."""
    data, offs = c.buffers(texts)
    n = len(offs) - 1
    out: list[list] = [[] for _ in range(n)]
    count = lambda mask: np.diff(np.concatenate([[0], np.cumsum(mask)])[offs])
    digits = count((data >= 48) & (data <= 57))
    may = (count(data == 64) > 0) | (digits >= 4)
    for i in np.flatnonzero(may):
        out[i] = [(k, a, b, True) for k, a, b in base_spans(data[offs[i] : offs[i + 1]].tobytes().decode())]
    w = Words(data, offs)
    first, size = w.chains(data)
    label = field.decode(field.emissions(field.places(w, first)), first, size)
    hit = np.flatnonzero(label)
    if len(hit):
        start_chain = np.zeros(w.n, bool)
        start_chain[first] = True
        new = np.ones(len(hit), bool)
        new[1:] = (hit[1:] != hit[:-1] + 1) | (label[hit[1:]] != label[hit[:-1]]) | start_chain[hit[1:]]
        lo = hit[new]
        hi = hit[np.concatenate([np.flatnonzero(new)[1:], [len(hit)]]) - 1]
        row = np.searchsorted(w.row, lo, "right") - 1
        for a, b, r in zip(lo, hi, row):
            raw = data[w.starts[a] : w.ends[b]].tobytes().decode()
            left = len(raw) - len(raw.lstrip(_TRIM.replace("(", "") if label[a] == 4 else _TRIM))
            cut = raw[left:].rstrip(_TRIM)
            if label[a] == 5 and "=" in cut:  # key=value
                left += cut.index("=") + 1
                cut = raw[left:].rstrip(_TRIM)
                left += len(cut) - len(cut.lstrip(_TRIM))
                cut = cut.lstrip(_TRIM)
            if not cut:
                continue
            begin = int(((data[offs[r] : w.starts[a]] & 0xC0) != 0x80).sum()) + left
            end = begin + len(cut)
            if all(end <= x or begin >= y for _, x, y, _ in out[r]):
                out[r].append((LABELS[label[a]], begin, end, False))
    rank = {k: i for i, k in enumerate((*KINDS, "secret"))}
    for x in out:
        x.sort(key=lambda s: (rank[s[0]], s[1], s[2]))
    return out


RESULT = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"


def find(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, counts of base spans by kind, SHA-256 of the base spans, and all spans as kind:start:end,..."""
    field = docs.sparkSession.sparkContext.broadcast(train())
    docs = c.id_text(docs, key, text)

    def run(batches):
        for b in batches:
            for lo, hi in c.slices(c.buffers(b[text])[1]):
                found = spans(b[text].slice(lo, hi - lo), field.value)
                shown = [[f"{k}:{a}:{e}" for k, a, e, _ in x] for x in found]
                base = [",".join(s for s, y in zip(t, x) if y[3]) for t, x in zip(shown, found)]
                cols = [b[key].slice(lo, hi - lo)]
                cols += [pa.array([sum(y[3] and y[0] == k for y in x) for x in found], pa.int64()) for k in KINDS]
                cols += [pa.array([hashlib.sha256(x.encode()).hexdigest() for x in base], pa.string()), pa.array([",".join(x) for x in shown], pa.string())]
                yield pa.RecordBatch.from_arrays(cols, [x.split()[0] for x in RESULT.split(", ")])

    return docs.mapInArrow(run, RESULT)


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs, all columns, with every span of the text replaced by its kind in brackets."""
    field = docs.sparkSession.sparkContext.broadcast(train())
    place = docs.columns.index(text)

    def run(batches):
        for b in batches:
            own = pc.cast(b[text], pa.string())
            for lo, hi in c.slices(c.buffers(own)[1]):
                part = own.slice(lo, hi - lo)
                found = spans(part, field.value)
                if any(found):
                    part = pa.array([_replaced(t.as_py(), s) if s else t.as_py() for t, s in zip(part, found)], pa.string())
                yield b.slice(lo, hi - lo).set_column(place, b.schema.field(place), part)

    return docs.mapInArrow(run, docs.schema)


def _replaced(t: str, found: list) -> str:
    out, at = [], 0
    for kind, a, b, _ in sorted(found, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [t[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join(out) + t[at:]
