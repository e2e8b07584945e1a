"""Order MinHash by definition: numbered k-mers of characters, two smallest of each function, in text order."""

import random
import struct
from collections import Counter

import xxhash
from pyspark.sql import functions as F

from tidemark.llm import order_minhash as om

LOW = (1 << 64) - 1


def seeded(data: bytes, seed: int = 42) -> int:
    return xxhash.xxh64_intdigest(data, seed)


def brute(text: str) -> list[int]:
    """Every function's order over all k-mers, one by one."""
    grams = [text[i : i + om.K] for i in range(max(1, len(text) - om.K + 1))]
    met, hashes = Counter(), []
    for place, g in enumerate(grams):
        name = seeded(g.encode()) >> 30 << 30
        number = met[name]
        met[name] += 1
        if number:
            name = seeded(struct.pack("<i", number), seeded(struct.pack("<Q", name))) >> 30 << 30
        hashes.append((name, place))
    out = []
    for j in range(om.TUPLES):
        turn = (1 << 63) + (j << 64) // om.TUPLES  # signed order: the smallest long first
        order = sorted(hashes, key=lambda h: ((h[0] | h[1]) - turn) & LOW)
        two = sorted((order + order)[:2], key=lambda h: h[1])
        out.append(seeded(struct.pack("<Q", two[1][0]), seeded(struct.pack("<Q", two[0][0]))) & 0xFFFFFFFF)
    return out


def prints(spark, texts):
    rows = om.fingerprints(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    return [f for _, f in sorted((r.doc_id, r.fingerprint) for r in rows)]


def like(a, b):
    return sum(a[8 * k : 8 * k + 8] == b[8 * k : 8 * k + 8] for k in range(om.TUPLES)) / om.TUPLES


def test_equals_the_definition(spark, docs, corpus):
    texts = sorted({t or "" for _, t in corpus if len(t or "") < 20_000}) + ["a", "ab" * 700, "x" * 64, "x" * 71, "x" * 72, "日本語" * 50, "😀é\n" * 40, "one two three " * 60]
    assert prints(spark, texts) == ["".join(f"{x:08x}" for x in brute(t)) for t in texts]


def test_edited_likeness_is_that_of_the_edited_text(spark):
    rng = random.Random(4)
    texts = ["".join(rng.choice("abcde fgh") for _ in range(rng.randint(0, 400))) for _ in range(20)]
    got = {r.doc_id: r for r in om.edited_likeness(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for k, t in enumerate(texts):
        after = texts[k - 1]
        h = len(t) // 2
        own, edited, following = ("".join(f"{x:08x}" for x in brute(x)) for x in (t, t[: len(t) - h] + after[:h], after))
        assert (got[k].fingerprint, got[k].edited_fingerprint) == (own, edited)
        assert (got[k].near_edited, got[k].near_next) == (like(own, edited), like(own, following))


def test_one_more_character_changes_little(spark):
    rng = random.Random(5)
    spaced = " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(800))
    chinese = "".join(chr(rng.randrange(0x4E00, 0x9000)) for _ in range(3000))
    texts = [spaced, spaced.replace(" ", ""), chinese]
    fp = prints(spark, [y for x in texts for y in (x, "#" + x, x[:1000] + "#" + x[1000:], x[:1000] + " " + x[1000:])])
    for k in range(0, len(fp), 4):
        assert min(like(fp[k], other) for other in fp[k + 1 : k + 4]) > 0.9


def test_long_repeats_are_numbered(spark):
    n = 20_000
    whole, less, half = prints(spark, ["z" * n, "z" * (n - 1), "z" * (n // 2)])
    assert like(whole, less) > 0.9 and 0 < like(whole, half) < 0.8


def test_plan_reads_text_once_for_all_components(spark):
    docs = spark.createDataFrame([(1, "abc def " * 30)], "doc_id long, text string")
    plan = om.fingerprints(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "Aggregate" not in plan and plan.count("regexp_extract_all") == 1 and "Exchange" not in plan
    assert om.fingerprints(docs.withColumn("text", F.lit(None).cast("string"))).first().fingerprint == "".join(f"{x:08x}" for x in brute(""))
