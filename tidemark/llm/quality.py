"""Document quality by ordinal cumulative-link regression on graded ratings.

P(grade > k) = sigmoid(w . x - t_k): one weight vector over hashed text features for all grades, and ordered
thresholds t_0 < t_1 < ...  The expected grade is the sum of these tails, and a document is selected by the tail
probability of the top grade.

Features: presence of hashed words and word beginnings (letters, digits and non-ASCII bytes; A-Z lower-cased) and binned shares of
character kinds, word length and repetition.  Words in fewer than MIN_DF of the sampled documents, and words that a
score test can't tell from chance, get no weight.
The model is fitted on a bounded sample: the MAX_TRAIN labelled documents with the smallest hash of their id.
Grades from the labels table: 0 toxic, 1 low quality, 2 good and clean; labels other than 0 and 1 are no grade.  Toxic words add up without bound and so need
the end of the scale; marks of low quality are shares of a text and fit between two thresholds.

Edge cases: null or empty text has shape features alone and is scored like any other; unlabelled or null-id rows are
scored but not trained on; repeated rows score alike, and of the texts of one labelled id that with the smallest hash
is trained on; with fewer than two grades in the sample the thresholds give the
observed frequencies; extra columns pass through unchanged.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import _common as c

MAX_TRAIN = 8_000
MIN_DF = 12
#: Word beginnings, in bytes, that are features beside the words: they carry families of inflected words.
PREFIXES = (4, 5)
BITS = 18
SHAPES = 8
BINS = 16
_INK = np.zeros(256, bool)
_INK[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_KINDS = np.zeros((4, 256), np.uint8)
_KINDS[0, 65:91] = 1  # capitals
_KINDS[1, 48:58] = 1  # digits
_KINDS[2, [x for x in range(33, 127) if not chr(x).isalnum() and chr(x) not in ".,;:'\"-()?"]] = 1  # rare marks
_KINDS[3, [32, 9, 10, 13]] = 1


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers of every row, distinct in a row, and where each row's begin."""
    data, offs = c.buffers(texts)
    n = len(offs) - 1
    ink = _INK[data]
    before = np.zeros(len(data), bool)
    before[1:] = ink[:-1]
    before[offs[:-1][offs[:-1] < len(data)]] = False
    starts = np.flatnonzero(ink & ~before)
    after = np.zeros(len(data), bool)
    if len(data):
        after[:-1] = ink[1:] & before[1:]
    ends = np.flatnonzero(ink & ~after) + 1
    row = np.searchsorted(starts, offs)
    h = (c.word_hashes(data, starts, ends) >> np.uint64(64 - BITS)).astype(np.int64)
    per = np.repeat(np.arange(n), np.diff(row))
    keys = [per << BITS | h]
    for size in PREFIXES:
        long = ends - starts > size
        p = c.word_hashes(data, starts[long], starts[long] + size) ^ np.uint64(0x5DEECE66D1CE4E5B * size % (1 << 64))
        keys.append(per[long] << BITS | (p >> np.uint64(64 - BITS)).astype(np.int64))
    key = np.unique(np.concatenate(keys))
    words, at = key & ((1 << BITS) - 1), np.searchsorted(key, np.arange(n + 1) << BITS)
    plain = np.unique(keys[0])
    kinds = np.diff(np.searchsorted(plain, np.arange(n + 1) << BITS))
    size = np.maximum(np.diff(offs), 1)
    total = lambda v: np.diff(np.concatenate([[0], np.cumsum(v, dtype=np.int64)])[offs])
    count = np.maximum(np.diff(row), 1)
    shares = [total(k[data]) / size for k in _KINDS]
    inked = np.diff(np.concatenate([[0], np.cumsum(ends - starts)])[row]) / count
    shapes = np.stack([
        *(_bin(np.sqrt(s)) for s in shares[:3]), _bin(shares[3] * 2), _bin(inked / 16), _bin(kinds / count),
        _bin(np.log2(size) / 20), _bin(np.sqrt(shares[2] / np.maximum(shares[3], 1e-9) / 8)),
    ], 1)
    shapes = shapes + np.arange(SHAPES) * BINS + (1 << BITS)
    counts = np.diff(at) + SHAPES
    first = np.concatenate([[0], np.cumsum(counts)])
    out = np.empty(int(first[-1]), np.int64)
    place = np.arange(len(words)) + np.repeat(np.arange(n) * SHAPES, np.diff(at))
    out[place] = words
    out[(first[1:] - SHAPES)[:, None] + np.arange(SHAPES)] = shapes
    return out, first


def _bin(x: np.ndarray) -> np.ndarray:
    return np.clip((x * BINS).astype(np.int64), 0, BINS - 1)


class CumulativeLink:
    """Weights by feature number, thresholds in ascending order."""

    def __init__(self, weights: np.ndarray, thresholds: np.ndarray):
        self.weights, self.thresholds = weights, thresholds

    def tails(self, feats: np.ndarray, first: np.ndarray) -> np.ndarray:
        """P(grade > k) for every row and threshold."""
        score = np.add.reduceat(self.weights[feats], first[:-1]) if len(first) > 1 else np.zeros(0)
        return 1 / (1 + np.exp(-np.clip(score[:, None] - self.thresholds, -40, 40)))


def _screened(feats: np.ndarray, row: np.ndarray, df: np.ndarray, grades: np.ndarray, cuts: np.ndarray, width: int) -> np.ndarray:
    """Features whose score statistic, in the model of thresholds alone, beats the largest that as many features of no
    effect would show (the square root of twice the log of their number)."""
    up = np.concatenate([[1.0], 1 / (1 + np.exp(cuts)), [0.0]])
    slope = up * (1 - up)
    g = ((slope[:-1] - slope[1:]) / (up[:-1] - up[1:]))[grades]
    g = g - g.mean()
    total, square = np.bincount(feats, g[row], width), np.bincount(feats, g[row] ** 2, width)
    with np.errstate(all="ignore"):
        return np.abs(total) / np.sqrt(square) > np.sqrt(2 * np.log(max(2, (df > 0).sum())))


def fit(feats: np.ndarray, first: np.ndarray, grades: np.ndarray, levels: int = 3, steps: int = 400, ridge: float = 3e-5) -> CumulativeLink:
    """Full-batch gradient steps (Adam) on the log likelihood with a ridge; thresholds stay ordered as sums of
    exponentials."""
    width = (1 << BITS) + SHAPES * BINS
    n = len(grades)
    share = np.array([((grades > k).sum() + 0.5) / (n + 1) for k in range(levels - 1)])
    start = np.minimum.accumulate(np.clip(share, 1e-3, 1 - 1e-3))
    base = np.maximum.accumulate(-np.log(start / (1 - start)) + 1e-3 * np.arange(levels - 1))
    if n < 2 or len(np.unique(grades)) < 2:
        return CumulativeLink(np.zeros(width), base)
    df = np.bincount(feats, minlength=width)
    used = np.flatnonzero((df >= min(MIN_DF, max(2, n // 50))) & (df < n))
    row = np.repeat(np.arange(n, dtype=np.int32), np.diff(first))
    used = used[_screened(feats, row, df, grades, base, width)[used] | (used >= 1 << BITS)]
    col = np.full(width, -1)
    col[used] = np.arange(len(used))
    keep = col[feats] >= 0
    row, colx = row[keep], col[feats[keep]]
    theta = np.zeros(len(used) + levels - 1)
    theta[len(used)] = base[0]
    theta[len(used) + 1 :] = np.log(np.maximum(np.diff(base), 1e-2))
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    hit = np.arange(n)
    for step in range(1, steps + 1):
        w, raw = theta[: len(used)], theta[len(used) :]
        cut = np.concatenate([[-np.inf], raw[0] + np.concatenate([[0], np.cumsum(np.exp(raw[1:]))]), [np.inf]])
        score = np.bincount(row, w[colx], n)
        up = 1 / (1 + np.exp(-np.clip(score[:, None] - cut, -40, 40)))  # P(grade >= k); columns 0 and last are 1 and 0
        up[:, 0], up[:, -1] = 1, 0
        p = np.maximum(up[hit, grades] - up[hit, grades + 1], 1e-12)
        slope = up * (1 - up)
        g = (slope[hit, grades] - slope[hit, grades + 1]) / p / n
        grad = np.empty_like(theta)
        grad[: len(used)] = np.bincount(colx, g[row], len(used)) - ridge * w
        d_cut = np.zeros(levels + 1)
        np.add.at(d_cut, grades, -slope[hit, grades] / p / n)
        np.add.at(d_cut, grades + 1, slope[hit, grades + 1] / p / n)
        d_cut = d_cut[1:levels]
        grad[len(used)] = d_cut.sum()
        for k in range(1, levels - 1):
            grad[len(used) + k] = d_cut[k:].sum() * np.exp(raw[k])
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        theta = theta + 0.1 * (1 - step / (steps + 1)) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
    raw = theta[len(used) :]
    weights = np.zeros(width)
    weights[used] = theta[: len(used)]
    return CumulativeLink(weights, raw[0] + np.concatenate([[0], np.cumsum(np.exp(raw[1:]))]))


def grade_column():
    return F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).otherwise(2)


def train(docs: DataFrame, labels: DataFrame, most: int = MAX_TRAIN, key: str = "doc_id", text: str = "text") -> CumulativeLink:
    """Fit on at most `most` labelled documents.  The sampled labels have that bound, so they are broadcast."""
    graded = labels.where("doc_id is not null and quality in (0, 1) and toxic in (0, 1)")
    graded = graded.select(F.col("doc_id").cast("long").alias("lid"), grade_column().cast("int").alias("grade"))
    graded = graded.groupBy("lid").agg(F.min("grade").alias("grade")).orderBy(F.xxhash64("lid"), "lid").limit(most)
    docs = c.id_text(docs, key, text).select(F.col(key).alias("id"), F.col(text).alias("text"))
    sample = docs.join(F.broadcast(graded), docs.id == graded.lid).groupBy("lid").agg(F.first("grade").alias("grade"), F.min_by("text", F.xxhash64("text")).alias("text"))

    def run(batches):
        for b in batches:
            for lo, hi in c.slices(c.buffers(b["text"])[1]):
                f, first = features(b["text"].slice(lo, hi - lo))
                f = f.astype(np.int32)
                blobs = [f[x:y].tobytes() for x, y in zip(first[:-1], first[1:])]
                yield pa.RecordBatch.from_arrays([b["lid"].slice(lo, hi - lo), b["grade"].slice(lo, hi - lo), pa.array(blobs, pa.binary())], ["id", "grade", "features"])

    got = sample.mapInArrow(run, "id long, grade int, features binary").toArrow()
    order = np.argsort(got["id"].to_numpy(), kind="stable")
    blobs = [got["features"][int(i)].as_py() for i in order]
    grades = got["grade"].to_numpy()[order].astype(np.int64)
    feats = np.frombuffer(b"".join(blobs), np.int32)
    return fit(feats, np.concatenate([[0], np.cumsum([len(x) // 4 for x in blobs])]).astype(np.int64), grades)


def _scored(model, text: str):
    def run(batches):
        known = model.value
        for b in batches:
            own = pc.cast(b[text], pa.string())
            for lo, hi in c.slices(c.buffers(own)[1]):
                tails = known.tails(*features(own.slice(lo, hi - lo)))
                yield b.slice(lo, hi - lo), tails

    return run


def score(docs: DataFrame, labels: DataFrame, most: int = MAX_TRAIN, least: float = 0.5, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, expected_grade, p_top (tail probability of the top grade), kept (p_top >= least)."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, most, key, text))
    docs = c.id_text(docs, key, text).select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    scored = _scored(model, "text")

    def run(batches):
        for b, tails in scored(batches):
            yield pa.RecordBatch.from_arrays(
                [b["doc_id"], pa.array(tails.sum(1)), pa.array(tails[:, -1]), pa.array(tails[:, -1] >= least)],
                ["doc_id", "expected_grade", "p_top", "kept"],
            )

    return docs.mapInArrow(run, "doc_id long, expected_grade double, p_top double, kept boolean")


def selected(docs: DataFrame, labels: DataFrame, most: int = MAX_TRAIN, least: float = 0.5, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs, all columns, whose top-grade tail probability is at least `least`."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, most, key, text))
    scored = _scored(model, text)

    def run(batches):
        for b, tails in scored(batches):
            yield b.filter(pa.array(tails[:, -1] >= least))

    return docs.mapInArrow(run, docs.schema)
