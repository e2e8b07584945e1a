"""Passages and near-duplicates against brute force."""

import hashlib
import random
import re

import numpy as np

from tidemark.llm import minhash, suffix_dedup

LOW = -(1 << 63)


def ident(i):
    return LOW if i is None else i


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def shingles(t):
    w = re.findall("[^\x20\x09-\x0d]+", lower(t))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def test_passages_equal_brute_force(docs, corpus):
    first = {}
    for i, t in sorted(corpus, key=lambda r: ident(r[0])):
        b = (t or "").encode()
        for k in range(len(b) - 49):
            first.setdefault(b[k : k + 50], ident(i))
    want = []
    for i, t in corpus:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - 49):
            if first[b[k : k + 50]] < ident(i):
                gone[k : k + 50] = b"\1" * 50
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = len([x for x in bytes(gone).split(b"\0") if x])
        want.append(str((i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest())))
    got = suffix_dedup.remove_repeats(docs, keep_text=True).collect()
    assert sorted(str(tuple(r)[:5]) for r in got) == sorted(want)
    for r in got:
        assert hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 and len(r.spans) == 2 * r.n_spans
        assert sum(b - a for a, b in zip(r.spans[::2], r.spans[1::2])) == r.n_removed


def test_index_family_levels_grow_geometrically():
    f, rng = suffix_dedup.IndexFamily(), np.random.default_rng(1)
    seen = {}
    for batch in range(20):
        keys = rng.integers(0, 4000, 100).astype(np.uint64)
        docs = np.full(100, batch)
        first, clash = f.insert(keys, np.zeros(100, np.uint32), docs)
        for k in keys.tolist():
            seen.setdefault(k, batch)
        assert not clash.any() and first.tolist() == [seen[k] for k in keys.tolist()]
        sizes = [len(level[0]) for level in f.levels]
        assert all(a >= 2 * b for a, b in zip(sizes, sizes[1:]))
    first, clash = f.insert(keys[:2], np.array([0, 7], np.uint32), np.full(2, 99))
    assert clash.tolist() == [False, True]
    assert f.levels_keys().tolist() == sorted(seen)


def test_a_common_passage_is_told_once_a_group(spark):
    """A passage in every document: senders combine it, so a part hears a few entries of it."""
    import pyarrow as pa

    rng = random.Random(7)
    passage = "".join(rng.choice("abcdefghij ") for _ in range(400))
    texts = [f"{k} own {rng.random()} " + passage for k in range(2000)]
    table = pa.table({"g": pa.array([3] * 2000, pa.int32()), "doc_id": pa.array(range(2000), pa.int64()), "text": texts})
    out = suffix_dedup._send([5])(table)
    low, high, key, check = (np.concatenate(x) for x in zip(*(suffix_dedup.c.unpack(b.as_py()) for b in out["block"])))
    shared = high > low
    assert (low[shared] == 0).sum() >= 10 and len(key) == len({*zip(key.tolist(), check.tolist())}) and shared.sum() < 60
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.n_removed for r in suffix_dedup.remove_repeats(docs).collect()}
    assert got[0] == 0 and all(n >= 400 for i, n in got.items() if i)


def test_dealing_numbers_fill_every_partition(spark):
    from pyspark.sql import functions as F

    numbers = suffix_dedup.even_numbers(spark, 37)
    got = spark.createDataFrame([(x,) for x in numbers], "g int").repartition(37, "g").select(F.spark_partition_id().alias("p")).collect()
    assert sorted(r.p for r in got) == list(range(37))


def near_brute(corpus, percent):
    """By row: shingle count, smallest id of the rows that links reach, itself included."""
    sets = [shingles(t) for _, t in corpus]
    parent = list(range(len(corpus)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for n in range(len(corpus)):
        for m in range(n):
            x, y = sets[n], sets[m]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = find(n), find(m)
                parent[max(p, q)] = min(p, q)
    least = {}
    for n, (i, _) in enumerate(corpus):
        own = (i is not None, i or 0)
        least[find(n)] = min(least.get(find(n), own), own)
    name = lambda n: None if not least[find(n)][0] else least[find(n)][1]
    return [(i, len(sets[n]), name(n), i == name(n)) for n, (i, _) in enumerate(corpus)]


def test_components_equal_brute_force(docs, corpus):
    """Over the whole corpus: null ids, repeated ids, repeated rows."""
    more = [(i, corpus[k + 7][1]) for k, (i, _) in enumerate(corpus[:40]) if i is not None]
    for rows, df in ((corpus, docs), (corpus + more, docs.select("doc_id", "text").unionByName(docs.sparkSession.createDataFrame(more, "doc_id long, text string")))):
        for percent in (85, 80):
            got = [(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(df, percent).collect()]
            assert sorted(got, key=str) == sorted(near_brute(rows, percent), key=str)


def test_near_duplicates_of_empty_tables(docs):
    assert minhash.near_duplicates(docs.limit(0), 85).collect() == [] and minhash.one_of_each(docs.limit(0)).collect() == []
    assert suffix_dedup.remove_repeats(docs.limit(0)).collect() == []


def test_star_of_copies_that_link_only_to_the_original(spark):
    """Copies of one base with different edits: 85 % alike with the base, less with each other."""
    base = [f"w{k}" for k in range(100)]
    rows = [(0, " ".join(base))] + [(k, " ".join(base[:10 + 3 * k] + ["edit", str(k)] + base[12 + 3 * k :])) for k in range(1, 26)]
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 85).collect()}
    assert got == {i: root for i, _, root, _ in near_brute(rows, 85)}


def test_components_of_chains_and_stars(spark):
    edges = [(k, k + 1) for k in range(20)] + [(100, k) for k in range(101, 140)] + [(300, 301), (301, 300)]
    got = {r.node: r.root for r in minhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(21)}, **{k: 100 for k in range(100, 140)}, 300: 300, 301: 300}
