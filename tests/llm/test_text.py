"""Tokenisation, personal data, quality, contamination, fingerprints."""

import hashlib
import random
import re

import pyarrow as pa
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import contamination, order_minhash, pieces, pii, quality

MODEL = pieces.Model()
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)


@settings(max_examples=150, derandomize=True, deadline=None)
@given(st.text(alphabet="abcdeehinorst ABC.,\n\té日😀0123▁", max_size=80))
def test_encoding_is_the_librarys(text):
    ids, at = pieces.Encoder(MODEL).encode([text, None, ""])
    assert ids[: at[1]].tolist() == LIBRARY.encode(text) and at[1] == at[3]
    if "▁" not in text:
        assert pieces.decode(MODEL, ids, at).to_pylist() == [text, "", ""]


def test_encoding_of_documents(docs, corpus):
    got = sorted(((r.doc_id, r.n_tokens, tuple(r.ids), r.round_trip) for r in pieces.encode(docs).collect()), key=str)
    want = sorted(((i, len(ids), tuple(ids), True) for i, t in corpus for ids in [LIBRARY.encode(t or "")]), key=str)
    assert got == want
    back = pieces.decode_rows(pieces.encode(docs)).collect()
    assert sorted((r.doc_id or -1, r.text) for r in back) == sorted((i or -1, t or "") for i, t in corpus)
    assert pieces.encode(docs.limit(0)).collect() == []


def test_unigram_viterbi_takes_the_best_sum():
    import numpy as np

    m = pieces.Model()
    m.bpe = False
    m.score = np.where(np.arange(len(m.score)) % 3 == 0, -9.0, -4.0) - np.array([len(t) for t in m.text]) * 0.1
    for u in ("▁the", "▁reading", "▁une", "ationer"):
        best = {0: (0.0, [])}
        for e in range(1, len(u) + 1):
            best[e] = max((best[s][0] + m.score[m.normal[u[s:e]]], best[s][1] + [m.normal[u[s:e]]]) for s in range(e) if u[s:e] in m.normal)
        ids, _ = m.encode_units([u])
        assert abs(sum(m.score[i] for i in ids) - best[len(u)][0]) < 1e-9


def slow_base(t):
    """The contract's patterns, as they are written."""
    pats = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    out = []
    for kind, p in pats.items():
        for m in re.finditer(p, t):
            d = re.sub("[^0-9]", "", m[0])
            ok = kind == "email" or kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")) or kind == "card" and 16 <= len(d) <= 19 and pii.luhn(d) or kind == "phone" and 8 <= len(d) <= 15
            if ok:
                out.append((kind, *m.span()))
    return out


@settings(max_examples=400, derandomize=True, deadline=None)
@given(st.text(alphabet="ab@..-+ 0123456789()é", max_size=60))
def test_base_patterns_equal_the_contracts(text):
    assert pii.base_spans(text) == slow_base(text)


def test_base_patterns_are_linear():
    for t in ("1" * 300_000, "a" * 300_000, "@" * 100_000, "a@" * 100_000, "1." * 150_000, "+1" * 100_000 + " " * 1000, "+1 " + " " * 300_000):
        pii.base_spans(t)


def test_luhn():
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")


def test_pii_query(docs, spark, corpus):
    rows = [(1, "mail joe@x.org or +44 20 7946 0958, card 4111 1111 1111 1111 at 10.0.0.1 é x@y.co"), (2, 'token = "' + "0123456789abcdef" * 2 + '" here'), (3, None), (None, "no data at all here")]
    got = {r.doc_id: r for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    base = ",".join(f"{k}:{a}:{b}" for k, a, b in slow_base(rows[0][1]))
    assert (got[1].n_email, got[1].n_ip, got[1].n_card, got[1].n_phone) == (2, 1, 1, 1)
    assert got[1].base_sha256 == hashlib.sha256(base.encode()).hexdigest() and set(base.split(",")) <= set(got[1].spans.split(","))
    assert got[2].spans == "secret:9:41" and got[3].spans == got[None].spans == ""
    assert got[3].base_sha256 == hashlib.sha256(b"").hexdigest()
    clean = pii.redact(spark.createDataFrame(rows, "doc_id long, text string").withColumnRenamed("text", "body"), "body").where("doc_id = 1").first()
    assert "joe@" not in clean.body and "[EMAIL]" in clean.body and "[CARD]" in clean.body
    assert len(pii.find(docs).collect()) == len(corpus) and pii.find(docs.limit(0)).collect() == []


def test_field_on_held_out_rows_of_the_table():
    field = pii.train(pii.labelled_rows(8))
    rows = pii.labelled_rows(12)[8 * len(pii.TABLE) :]
    found = pii.spans(pa.array([t for t, _ in rows]), field)
    want = {(k, lab) for k, (_, s) in enumerate(rows) for _, _, lab in s}
    got = {(k, x[0]) for k, s in enumerate(found) for x in s}
    assert len(want & got) / len(want) > 0.9 and len(got - want) / len(got) < 0.1


def test_quality_orders_grades_on_held_out_documents(spark):
    rng = random.Random(9)
    rows, labels = [], []
    for i in range(600):
        words = [rng.choice(["the", "of", "and", "house", "river", "tree", "walk", "stone"]) for _ in range(60)]
        q, toxic = int(rng.random() > 0.3), int(rng.random() < 0.2)
        if not q:
            words = [w + rng.choice(["$$$", "###"]) for w in words]
        if toxic:
            words[rng.randrange(60)] = rng.choice(["idiot", "moron"])
        rows.append((i, " ".join(words)))
        labels.append((i, q, toxic))
    docs = spark.createDataFrame(rows + [(9001, None), (9002, "")], "doc_id long, text string")
    lab = spark.createDataFrame(labels[:400] + [(None, 1, 0), (5000, 1, 0), (1, None, 1)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality.score(docs, lab).collect()}
    held = [(i, 0 if t else 1 if not q else 2) for i, q, t in labels[400:]]
    assert sum(got[i].kept == (g == 2) for i, g in held) / len(held) > 0.95
    assert sum(round(got[i].expected_grade) == g for i, g in held) / len(held) > 0.9
    assert len(got) == 602 and all(0 <= r.expected_grade <= 2 for r in got.values())
    assert quality.score(docs.limit(0), lab).collect() == [] and len(quality.score(docs, lab.limit(0)).collect()) == 602
    kept = quality.selected(docs.withColumnRenamed("text", "body"), lab, text="body")
    assert {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if r.kept}


def test_training_is_bounded(spark):
    docs = spark.createDataFrame([(i % 50, f"word{i} stone river") for i in range(300)], "doc_id long, text string")
    lab = spark.createDataFrame([(i, i % 2, 0) for i in range(50)], "doc_id long, quality int, toxic int")
    assert len(quality.train(docs, lab, most=10).thresholds) == 2


def contained(docs, items, least=0.8):
    def sh(t):
        w = bytes(x + 32 if 65 <= x <= 90 else x for x in (t or "").encode()).split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()

    it = [(i, sh(t)) for i, t in items]
    return sorted((d, i, len(s), len(s & x)) for d, t in docs for x in [sh(t)] for i, s in it if s and len(s & x) >= least * len(s))


def test_contamination_equals_brute_force(spark, docs, corpus, monkeypatch):
    long = [(i, t) for i, t in corpus if t and len(t.split()) > 60 and i]
    items = [(k, " ".join(t.split()[5 + k : 5 + k + n])) for k, (_, t) in enumerate(long[:20]) for n in [20 + 2 * k]]
    items += [(100, None), (101, ""), (102, "two words"), (103, "nowhere to be found in any of these texts at all"), (104, long[0][1].split()[0] + " X " + " ".join(long[0][1].split()[1:40]))]
    bench = spark.createDataFrame([(i, t, "z") for i, t in items], "item_id long, text string, doc_id string")
    named = [r for r in corpus if r[0] is not None]
    want = contained(named, items)
    d = docs.where("doc_id is not null")
    get = lambda: sorted((r.doc_id, r.item_id, r.n_item, r.n_shared) for r in contamination.contaminated(d, bench).collect())
    assert get() == want and len(want) > 20
    monkeypatch.setattr(contamination, "ITEM_BYTES", 400)  # many blocks
    assert get() == want
    left = contamination.without_contaminated(docs, bench)
    assert left.columns == docs.columns
    assert {r.doc_id for r in left.select("doc_id").where("doc_id is not null").collect()} == {i for i, _ in named} - {w[0] for w in want}
    assert contamination.contaminated(d.limit(0), bench).collect() == [] and contamination.contaminated(d, bench.limit(0)).collect() == []


def test_fingerprints(spark, docs, corpus):
    got = order_minhash.edited_likeness(docs).collect()
    assert len(got) == len(corpus)
    rows = sorted(((i, t or "") for i, t in corpus if i is not None), key=lambda r: (-r[0], r[1]))
    by = {r.doc_id: r for r in got if r.doc_id is not None}
    nulls = [t or "" for i, t in corpus if i is None]
    prints = {}
    for k, (i, t) in enumerate(rows):
        r = by[i]
        assert r.n_chars == len(t) and 0 <= r.near_next <= 1 and 0 <= r.near_edited <= 1
        h = len(t) // 2
        after = [rows[k + 1][1]] if k + 1 < len(rows) and rows[k + 1][0] != i else nulls if k + 1 == len(rows) else None
        if after and [x[0] for x in rows].count(i) == 1:
            assert r.edited_sha256 in {hashlib.sha256((t[: len(t) - h] + a[:h]).encode()).hexdigest() for a in after}
        assert prints.setdefault(t, r.fingerprint) == r.fingerprint
        assert len(r.fingerprint) == 8 * order_minhash.TUPLES
    assert len(set(prints.values())) > 0.9 * len(prints)
    assert order_minhash.edited_likeness(docs.limit(0)).collect() == []
    one = order_minhash.edited_likeness(spark.createDataFrame([(7, "a b c d e f g h")], "doc_id long, text string")).first()
    assert one.near_next == 1.0


def test_fingerprint_feels_order(spark):
    w = [f"w{k}" for k in range(400)]
    rows = [(1, " ".join(w)), (2, " ".join(w[200:] + w[:200])), (3, " ".join(w[:390] + ["x"] * 10)), (4, " ".join(f"v{k}" for k in range(400)))]
    fp = {r.doc_id: r.fingerprint for r in order_minhash.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    like = lambda a, b: sum(fp[a][8 * k : 8 * k + 8] == fp[b][8 * k : 8 * k + 8] for k in range(32)) / 32
    assert like(1, 3) > 0.7 > like(1, 2) > like(1, 4) == 0


def test_fingerprint_plan_has_no_python(docs):
    plan = order_minhash.edited_likeness(docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


@pytest.mark.parametrize("bad", [10, 101])
def test_threshold_is_checked(docs, bad):
    from tidemark.llm import minhash

    with pytest.raises(ValueError):
        minhash.near_duplicates(docs, bad)
