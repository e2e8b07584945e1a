"""Long units, archives by size, ids with several texts, labels that are no grade."""

import gzip
import random

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece

from tidemark.llm import minhash, pieces, quality, warc

MODEL = pieces.Model()
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)


@pytest.mark.parametrize("name,text", [
    ("repeats", "a" * 5000 + "ab" * 2000), ("blanks", " " * 3000 + "x" + "  " * 40 + "y"), ("word", "the" * 20_000), ("marks", "=" * 2000 + "-" * 333),
    ("letters", "".join(random.Random(1).choice("abcdefghijklmnopqrstuvwxyz") for _ in range(100_000))), ("base64", "".join(random.Random(2).choice("ABCDEFabcdef0123456789+/") for _ in range(100_000))),
    ("chinese", "".join(chr(random.Random(3).randrange(0x4E00, 0x9000)) + x for x in "的是" * 8000)), ("address", "https://www.example.com/" + "path/" * 3000),
])
def test_long_units_are_the_librarys(name, text):
    ids, at = pieces.Encoder(MODEL).encode([text])
    assert ids.tolist() == LIBRARY.encode(text)
    assert pieces.decode(MODEL, ids, at).to_pylist() == [text]


def test_windows_run_again_where_states_differ(monkeypatch):
    rng = random.Random(4)
    words = [p.lstrip("▁") for p in MODEL.normal]
    texts = ["".join(rng.choice(words) for _ in range(60)) for _ in range(20)] + ["aab" * 300]
    monkeypatch.setattr(pieces, "WINDOW", 17)
    assert all(pieces.Encoder(MODEL).encode([t])[0].tolist() == LIBRARY.encode(t) for t in texts)


def test_archives_hold_records_by_size(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "SIZES", (100, 5_000))
    monkeypatch.setattr(warc, "FILE_BYTES", 10_000)
    rows = [(k, f" http://x/{k} ", "s" * 40 + str(k)) for k in range(250)] + [(1000 + k, None, "m" * 3_000 + str(k % 3)) for k in range(9)] + [(2000 + k, "u", "é" * 9_000 + str(k % 2)) for k in range(4)] + [(-(1 << 63), "low", "m" * 3_000 + "0"), (None, "none", "m" * 3_000 + "0")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {(r.page_id, r.url): r for r in warc.round_trip(pages).collect()}
    assert len(got) == len(rows) and set(got) == {(i, u or "") for i, u, _ in rows}
    assert {i: (r.record_type, r.refers_to) for (i, _), r in got.items() if i and i >= 1000} == {
        **{1000 + k: ("response", None) if k >= 6 else ("revisit", 1006 + k % 3) for k in range(9)}, **{2000 + k: ("response", None) if k >= 2 else ("revisit", 2002 + k) for k in range(4)}}
    assert got[-(1 << 63), "low"].refers_to == got[None, "none"].refers_to == 1006

    warc.write_archives(warc.records(pages), str(tmp_path / "a"))
    files = {k: sorted((tmp_path / "a" / f"size{k}").glob("*.gz")) for k in range(3)}
    held = {k: [sum(1 for _ in warc.parse(gzip.open(f))) for f in files[k]] for k in files}  # the writer may add an empty file
    from pathlib import Path

    odd = tmp_path / "odd"  # archives of another layout
    odd.mkdir()
    for k in files:
        for f in files[k]:
            (odd / f"{k}-{Path(f).name}").write_bytes(f.read_bytes())
    warc.deduplicate(spark, str(odd), str(tmp_path / "less"))
    back = warc.read_archives(spark, str(tmp_path / "less")).groupBy("record_type").count().collect()
    assert {r.record_type: r["count"] for r in back} == {"response": 255, "revisit": 10}
    assert [sum(held[k]) for k in held] == [250, 11, 4] and max(held[0]) <= 100 and max(held[1]) <= 2 and max(held[2]) == 1


def test_revisits_name_the_record_they_refer_to(spark, tmp_path):
    pages = spark.createDataFrame([(k, f"http://x/{k}", "same" * 400) for k in range(3)], "page_id long, url string, html string")
    warc.write_archives(warc.records(pages), str(tmp_path / "all"))
    warc.deduplicate(spark, str(tmp_path / "all"), str(tmp_path / "less"))
    read = lambda name: [head for f in (tmp_path / name).rglob("*.gz") for head, _ in warc.parse(gzip.open(f))]
    before, after = read("all"), read("less")
    kept = next(h for h in after if h["warc-type"] == "response")
    others = [h for h in after if h["warc-type"] == "revisit"]
    assert len(before) == 3 and len(others) == 2 and kept["x-page-id"] == "2"
    assert all(h["warc-refers-to"] == kept["warc-record-id"] and h["warc-refers-to-target-uri"] == "http://x/2" for h in others)
    assert not {h["warc-record-id"] for h in before} & {h["warc-record-id"] for h in after} and len({h["warc-record-id"] for h in after}) == 3


TEXT = {x: " ".join(f"{x}{k}" for k in range(60)) for x in "abcd"}


def test_an_id_with_several_texts(spark):
    near = lambda x: TEXT[x] + " more"
    rows = [(1, TEXT["a"]), (1, TEXT["b"]), (5, near("a")), (7, near("b")), (3, TEXT["c"]), (3, TEXT["d"]), (2, near("c")), (None, near("d")), (None, "own words of no one else here"), (-(1 << 63), TEXT["d"]), (9, None), (9, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(docs, 85).collect()), key=str)
    low = -(1 << 63)
    want = [(1, 56, 1, True), (1, 56, 1, True), (5, 57, 1, False), (7, 57, 1, False), (3, 56, 2, False), (2, 57, 2, True), (3, 56, None, False), (None, 57, None, True), (low, 56, None, False), (None, 3, None, True), (9, 0, 9, True), (9, 0, 9, True)]
    assert got == sorted(want, key=str)
    left = sorted(((r.doc_id, r.text) for r in minhash.one_of_each(docs, 85).collect()), key=str)
    assert left == sorted([(1, TEXT["a"]), (1, TEXT["b"]), (2, near("c")), (None, near("d")), (None, rows[8][1]), (9, None), (9, "")], key=str)


def test_labels_that_are_no_grade(spark):
    docs = spark.createDataFrame([(k, f"text {k}") for k in range(6)] + [(0, "another text")], "doc_id long, text string")
    labels = spark.createDataFrame([(0, 1, 0), (1, 0, 0), (2, -1, 0), (3, 9, 1), (4, 1, 7), (5, None, 1)], "doc_id long, quality int, toxic int")
    seen = []
    whole = quality.fit
    try:
        quality.fit = lambda feats, first, grades, **o: seen.append(grades.tolist()) or whole(feats, first, grades, **o)
        quality.train(docs, labels)
    finally:
        quality.fit = whole
    assert seen == [[2, 1]]


def test_tails_are_those_of_the_plain_formula():
    rng = np.random.default_rng(6)
    texts = ["", "one two one", "Ünï 12 !!", "a" * 5000, "words " * 300]
    feats, first = quality.features(pa.array([None, *texts]))
    model = quality.CumulativeLink(rng.standard_normal((1 << quality.BITS) + quality.SHAPES * quality.BINS), np.array([-0.4, 0.9]))
    tails = model.tails(feats, first)
    for k in range(len(texts) + 1):
        score = sum(float(model.weights[f]) for f in feats[first[k] : first[k + 1]])
        assert np.allclose(tails[k], [1 / (1 + np.exp(t - score)) for t in model.thresholds], atol=1e-9)
        assert len(set(feats[first[k] : first[k + 1]])) == first[k + 1] - first[k]
    assert (feats[first[0] : first[1]] == feats[first[1] : first[2]]).all()
