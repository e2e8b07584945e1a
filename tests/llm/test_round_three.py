"""Spelling variants, the prefix trie and near-duplicate embeddings against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tidemark.llm import embedding_dedup, prefix_trie, spelling

# ------------------------------------------------ spelling variants
ALPHABET = "abcdefghijklmnopqrstuvwxyzàéüñßÿÀÉÜÑ"


def edits(w):
    for i in range(len(w) + 1):
        yield from (w[:i] + x + w[i:] for x in ALPHABET)
        if i < len(w):
            yield w[:i] + w[i + 1 :]
            yield from (w[:i] + x + w[i + 1 :] for x in ALPHABET)


def words_of(rows):
    n = Counter()
    for i, t in rows:
        low = "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in t or "")
        for run in re.findall("[A-Za-zÀ-ÿ]+", low):
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 199 == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1 :]
            n[run] += 1
    return {w: k for w, k in n.items() if len(w) >= 6 and k >= 5}


def expected(rows):
    n = words_of(rows)
    form, out = {}, []
    near = {w: {x for x in edits(w) if x in n and x != w} for w in n}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best and n[best] >= 5 * n[w] else None
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return sorted(out)


def text_rows():
    rng = random.Random(9)
    base = ["".join(rng.choice("abcdeéü") for _ in range(rng.randint(5, 9))) for _ in range(40)] + ["aaaaaaa", "aaaaaaaa", "aaaaaa", "ÿÿÿÿÿÿ", "ÿÿÿÿÿÿÿ", "x" * 300, "x" * 299]
    words = Counter()
    for w in base:
        words[w] += rng.choice([5, 30, 200])
        for _ in range(4):
            words[rng.choice(list(edits(w)))] += rng.choice([1, 5, 6, 30])
    words.update({"chainword": 200, "chainwor": 30, "chainwo": 5})  # a form of a form
    flat = [w for w, k in words.items() for _ in range(k)]
    rng.shuffle(flat)
    rows = [(rng.choice([7, 8, None, -3]) if k % 9 == 0 else k, " ".join(w.upper() if rng.random() < 0.1 else w for w in flat[k : k + 50])) for k in range(0, len(flat), 50)]
    return rows + [rows[0], (1, None), (2, ""), (3, "12 -- ×÷ ÀÉ"), (4, "many words " * 40_000)]


@pytest.fixture(scope="module")
def spelled(spark):
    rows = text_rows()
    return rows, spark.createDataFrame([(i, t, "z", "z", "z") for i, t in rows], "doc_id long, text string, word string, n string, cell string").repartition(5)


@pytest.mark.parametrize("cell,held,step", [(spelling.CELL, spelling.HELD, spelling._STEP), (7, 3, 1)])
def test_variants_equal_brute_force(spark, spelled, cell, held, step, monkeypatch):
    rows, docs = spelled
    monkeypatch.setattr(spelling, "HELD", held)
    words = spelling.c.written(spelling.vocabulary(docs), "words")
    want = expected(rows)
    assert {r.word: r.n for r in words.collect()} == {w[0]: w[3] for w in want}
    got = {r.word: r for r in spelling.neighbours(words, cell).collect()}
    assert {w: r.n_near for w, r in got.items()} == {w[0]: w[4] for w in want if w[4]}
    if cell == spelling.CELL:
        assert sorted((tuple(r) for r in spelling.variants(docs).select("word", "form", "root", "n", "n_near", "form_n").collect()), key=lambda r: r[0]) == want
        assert any(w[2] != (w[1] or w[0]) for w in want) and spelling.variants(docs.limit(0)).collect() == []


def test_wavelet_tree_reports_ranges():
    rng = np.random.default_rng(2)
    for n in (1, 2, 3, 50, 64, 257):
        v = rng.permutation(n)
        tree = spelling.WaveletTree(v)
        lo, least = rng.integers(0, n, 60), rng.integers(0, n, 60)
        hi, most = lo + rng.integers(0, n, 60).clip(0, n - lo), least + rng.integers(0, n + 1, 60)
        q, x = tree.report(lo, hi, least, most)
        assert sorted(zip(q.tolist(), x.tolist())) == sorted((k, int(y)) for k in range(60) for y in v[lo[k] : hi[k]] if least[k] <= y < most[k])


def test_a_text_is_cut_between_runs(monkeypatch):
    monkeypatch.setattr(spelling, "_STEP", 3)
    text = "ab cdefgh,i  jklé" + "z" * 40 + " end"
    assert [x for part in spelling._runs(text) for x in part] == re.findall("[A-Za-zÀ-ÿ]+", text)


# ------------------------------------------------ prefix trie
def trie(rows):
    by = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            r, x = r or "", x or ""
            by[c].append(((t is not None, t or 0), hashlib.sha256(f"{len(r)}:{r}{x}".encode()).digest(), (r, x)))
    own = {c: [x for *_, x in sorted(v, key=lambda k: k[:2])] for c, v in by.items()}
    members, ends = defaultdict(set), defaultdict(list)
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4
        base = c - int(np.fmod(c, 20))
        path = own.get(base, [])[:h] + own[c][h:]
        for d in range(len(path) + 1):
            members[tuple(path[:d])].add(c)
        ends[tuple(path)].append(c)
    kids = defaultdict(list)
    for p in members:
        if p:
            kids[p[:-1]].append(p)
    out, leaves, saved = [], {}, {}
    for p in sorted(members, key=len, reverse=True):
        words = len(re.findall("[^\x20\x09-\x0d]+", p[-1][1])) if p else 0
        leaves[p] = sum(leaves[k] for k in kids[p]) or 1
        saved[p] = (len(members[p]) - 1) * words + sum(saved[k] for k in kids[p])
        out.append((min(members[p]), len(p), min(members[p[:-1]]) if p else None, len(members[p]), len(kids[p]), leaves[p], saved[p], hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest()))
    return sorted(out, key=str)


def chats():
    rng = random.Random(4)
    turns = [(rng.choice(["user", "assistant", None, ""]), t) for t in ["hi there", "a  b\tc\nd", "", None, "long " * 5000, "é ü", "x", "y z"]]
    rows = []
    for c in [*range(60), 101, 119, 120, 140, 141, 159, -3, -20, -39, 10**12 + 7]:
        for t in range(rng.choice([1, 2, 3, 5, 8])):
            role, text = turns[0] if t == 0 else rng.choice(turns[: 2 + t])
            rows.append((c, t, role, text))
    deep = [(c, t, "user", f"turn {t}") for c in (200, 201, 203, 207) for t in range(90 + c % 3)]
    rows += deep + [(300 + k, t, "u", "same") for k in range(25) for t in range(4)]
    return rows + [rows[3], rows[3], (5, None, "user", "first of all"), (5, None, None, None), (None, 1, "user", "nobody's"), (6, 0, "user", "a second turn 0")]


@pytest.mark.parametrize("block,piece", [(prefix_trie.BLOCK, prefix_trie.PIECE), (4, 3)])
def test_trie_equals_brute_force(spark, block, piece, monkeypatch):
    monkeypatch.setattr(prefix_trie, "BLOCK", block)
    monkeypatch.setattr(prefix_trie, "PIECE", piece)
    rows = chats()
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], "conv_id long, turn long, role string, text string, depth long, path long, k1 long").repartition(6)
    got = sorted((tuple(r) for r in prefix_trie.nodes(df).collect()), key=str)
    assert got == trie(rows)
    if block == 4:
        assert prefix_trie.nodes(df.limit(0)).collect() == [] and prefix_trie.nodes(df.where("conv_id is null")).collect() == []


def test_a_chain_of_prefixes_needs_few_rounds(spark, monkeypatch):
    """Conversation k holds the first k turns: nesting of chains stays near the logarithm, where one round a depth would be 60."""
    rounds = []
    written = prefix_trie.c.written
    monkeypatch.setattr(prefix_trie.c, "written", lambda df, name: (rounds.append(name), written(df, name))[1])
    rows = [(20 * k + 1, t, "user", f"t{t}") for k in range(60) for t in range(4 + k)]
    got = sorted((tuple(r) for r in prefix_trie.nodes(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()), key=str)
    assert got == trie(rows) and rounds.count("sent") < 25


# ------------------------------------------------ embeddings
def linked(rows, least=0.98):
    n = len(rows)
    unit, count, root = [], [0] * n, list(range(n))
    for _, v, label in rows:
        ok = label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)
        unit.append(np.asarray(v, float) / np.abs(np.asarray(v, float)).max() if ok else None)

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(n):
        for j in range(i):
            a, b = unit[i], unit[j]
            if a is not None and b is not None and rows[i][2] == rows[j][2] and len(a) == len(b) and a @ b / (np.linalg.norm(a) * np.linalg.norm(b)) >= least:
                count[i] += 1
                count[j] += 1
                root[find(i)] = find(j)
    ident = lambda i: (i is not None, i or 0)
    first = {}
    for i in range(n):
        r = find(i)
        first[r] = min(first.get(r, rows[i][0]), rows[i][0], key=ident)
    return sorted((str((rows[i][0], count[i], first[find(i)], rows[i][0] == first[find(i)])) for i in range(n)))


def vectors():
    rng = np.random.default_rng(6)
    rows, k = [], 0
    for label in (0, 1, None, 2):
        for _ in range(25):
            v = rng.normal(size=64)
            near = [v, v, 2 * v, v + rng.normal(size=64) * 0.1, v + rng.normal(size=64) * 0.19, v + rng.normal(size=64) * 0.25, v + rng.normal(size=64)]
            for x in near[: rng.integers(1, 8)]:
                rows.append((k, x.astype(np.float32).tolist(), label))
                k += 1
    centre = rng.normal(size=64)
    for _ in range(120):  # a dense group that many blocks share
        rows.append((k, (centre + rng.normal(size=64) * 0.07).astype(np.float32).tolist(), 1))
        k += 1
    bad = [None, [], [0.0] * 64, [float("nan")] * 64, [float("inf")] + [1.0] * 63, [None] + [1.0] * 63, [1e-40] * 64, [3e38] * 64, [1.0, 2.0, 3.0], [1.0, 2.0, 3.01], [-1.0, -2.0, -3.0], [5.0]]
    rows += [(k + j, v, 1) for j, v in enumerate(bad * 2)]
    return rows + [rows[0], rows[0], (None, rows[1][1], 0), (None, None, None), (-5, rows[130][1], rows[130][2])]


@pytest.mark.parametrize("block", [embedding_dedup.BLOCK, 16])
def test_embeddings_equal_brute_force(spark, block):
    rows = vectors()
    df = spark.createDataFrame([(*r, "z", "z", 1) for r in rows], "vec_id long, embedding array<float>, label int, node string, bucket string, k1 int").repartition(5)
    got = embedding_dedup.near_duplicates(df, block=block)
    assert sorted(str(tuple(r)) for r in got.collect()) == linked([(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], y) for i, v, y in rows])
    if block == 16:
        assert embedding_dedup.near_duplicates(df.limit(0)).collect() == []


def test_pairs_at_the_threshold_are_found():
    """Candidates alone: the share of pairs of cosine 0.98 that no bucket brings together."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(3000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z = rng.normal(size=x.shape)
    z -= (z * x).sum(1, keepdims=True) * x
    y = 0.98 * x + np.sqrt(1 - 0.98**2) * z / np.linalg.norm(z, axis=1, keepdims=True)
    hashes, tables = embedding_dedup.layout(10**6)
    salt = np.zeros(len(x), np.uint64)
    kx, ky = embedding_dedup.buckets(x, salt, hashes, tables), embedding_dedup.buckets(y, salt, hashes, tables)
    met = (kx[:, :, None] == ky[:, None, :]).any((1, 2))
    apart = np.bitwise_count(embedding_dedup.sketches(x) ^ embedding_dedup.sketches(y))
    assert met.mean() > 0.999 and (apart <= embedding_dedup.APART).mean() > 0.999
    assert embedding_dedup.layout(10**11)[0] > hashes


def test_threshold_is_checked(spark):
    with pytest.raises(ValueError):
        embedding_dedup.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int"), 0.9)
