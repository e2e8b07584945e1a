"""Archives, pages, conversations and the pipeline."""

import hashlib

import pytest
from pyspark.sql import functions as F

from tidemark.llm import extract, quotes, warc

SF = "/root/testdata/sf0.001"


def test_archive_round_trip(spark):
    big, other = "a\r\n\r\nWARC/1.1\r\n" * 90, "é" * 700
    rows = [(1, "http://a/\r\nx", big), (5, "u", big), (5, "u", big), (3, None, other), (9, "v", other), (2, "s", "small"), (4, "s", "small"), (None, None, None), (None, "n", big)]
    got = warc.round_trip(spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, record_id string")).collect()
    assert len(got) == len(rows)
    for r in got:
        html = {1: big, 5: big, 3: other, 9: other, 2: "small", 4: "small"}.get(r.page_id)
        if r.page_id is not None:
            assert (r.payload_bytes, r.payload_digest) == (len(html.encode()), hashlib.sha1(html.encode()).hexdigest())
    kinds = sorted((r.page_id or 0, r.record_type, r.refers_to) for r in got)
    assert kinds == sorted([(1, "revisit", 5), (5, "response", None), (5, "revisit", 5), (3, "revisit", 9), (9, "response", None), (2, "response", None), (4, "response", None), (0, "response", None), (0, "revisit", 5)], key=str) or sorted(map(str, kinds)) == sorted(map(str, [(1, "revisit", 5), (5, "response", None), (5, "revisit", 5), (3, "revisit", 9), (9, "response", None), (2, "response", None), (4, "response", None), (0, "response", None), (0, "revisit", 5)]))
    assert warc.round_trip(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_damaged_archives_are_refused():
    import io

    with pytest.raises(ValueError):
        list(warc.parse(io.BytesIO(b"HTTP/1.1 200 OK\r\n\r\n")))
    with pytest.raises(ValueError):
        list(warc.parse(io.BytesIO(b"WARC/1.1\r\nContent-Length: 99\r\n\r\nshort")))


def test_blocks():
    page = '<html><head><title>T</title><script>var a="<p>";</script></head><body><nav><ul><li><a href="/">Home</a><li>Two</ul></nav><article><h1>Head &amp; more</h1><p>One <b>bold</b><br>line<p>Next<!-- no --></article></body>'
    got = [(t, tag) for t, _, tag, _ in extract.blocks(page)]
    assert got == [("T", "title"), ("Home", "li"), ("Two", "li"), ("Head & more", "h1"), ("One bold line", "p"), ("Next", "p")]
    assert extract.blocks("") == [] and [b[0] for b in extract.blocks("plain < text")] == ["plain < text"]
    deep = "<div>" * 20_000 + "x" + "</div>" * 20_000 + '<a href="' * 2000
    assert [b[0] for b in extract.blocks(deep)][0] == "x"


def test_field_on_held_out_layouts():
    model = extract.train()
    pages = extract.labelled_pages(500)[360:500]
    right = total = 0
    for p in pages:
        want = [b[0].replace("", "").strip() for b in extract.blocks(p) if b[0].startswith("")]
        got = model.texts([p.replace("", "")])[0]
        total += 1
        right += got == " ".join(want)
    assert right / total > 0.8


def test_main_text_query(spark):
    page = "<html><head><title>t</title></head><body><nav><ul><li><a href='/a'>menu</a></li></ul></nav><div class='ad'>Buy this now.</div><article><h1>Title</h1><p>Body text &lt;here&gt;.</p></article><footer>&copy; me</footer></body></html>"
    rows = [(1, "u", page), (2, None, None), (3, "v", ""), (None, "w", page), (1, "u", page)]
    got = extract.main_text(spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, text string")).collect()
    assert sorted(str(tuple(r)) for r in got) == sorted(str(x) for x in [(1, "u", "Title Body text <here>.", 23), (2, None, "", 0), (3, "v", "", 0), (None, "w", "Title Body text <here>.", 23), (1, "u", "Title Body text <here>.", 23)])
    assert extract.main_text(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


CHAT = [
    (1, 0, "Hello there\nhow are you?"), (1, 1, "On Monday, X wrote:\n> hello  THERE\n> how are you?\nFine!\nthanks"), (1, 2, "> > Hello there\n> Fine!\n> thanks\nGreat"), (1, 3, "new topic"),
    (1, 4, "> how are you?\nanswer again\n\n> unknown line\nbye"), (1, 5, ">> x\n> Great\nok"), (2, 0, None), (2, 1, "> hello there\n"), (None, None, "> a"), (2, 1, "> hello there\n"), (3, 0, "same"), (3, 1, "same"), (3, 2, "> same"),
]


def fold(text):
    return " ".join("".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in text).split())


def plain(text):
    """Own lines and (level, lines) of the quotes, character by character."""
    own, quotes, before = [], [], 0
    for line in (text or "").split("\n"):
        i = 0
        while i < 3 and line[i : i + 1] in tuple(" \t"):
            i += 1
        level = 0
        while line[i : i + 1] == ">":
            level, i = level + 1, i + 1
            if line[i : i + 1] in tuple(" \t"):
                i += 1
        if not level:
            own.append(line)
        else:
            if not before:
                while own and not own[-1].split():
                    own.pop()
                if own and own[-1].rstrip().endswith(":") and own[-1].rstrip()[:-1].rstrip().lower().endswith(("wrote", "writes", "said", "schrieb", "schrieb am", "a écrit", "escribió")):
                    own.pop()
            if level != before:
                quotes.append((level, []))
            quotes[-1][1].append(line[i:])
        before = level
    return own, [q for q in quotes if any(x.split() for x in q[1])]


def weights(lines):
    """Folded passages with their weights: the whole 4, each other line 1."""
    lines = [x for x in map(fold, lines) if x]
    return {" ".join(lines): 4} | {x: 1 for x in lines if x != " ".join(lines)} if lines else {}


def brute(rows):
    out = []
    for c, t, text in rows:
        own, passages = plain(text)
        own, found = "\n".join(own).strip(), passages
        passages = [(n, "\n".join(x)) for n, x in found]
        sources = []
        for _, q in passages:
            votes = {}
            for h, w in weights(q.split("\n")).items():
                at = [u for d, u, other in rows if d == c and c is not None and t is not None and u is not None and u < t and h in weights(plain(other)[0])]
                if at:
                    votes[max(at)] = votes.get(max(at), 0) + w
            sources.append(max(votes, key=lambda u: (votes[u], u)) if votes else None)
        one = [s for (n, _), s in zip(passages, sources) if n == 1 and s is not None] + [s for s in sources if s is not None]
        out.append((c, t, own, len(passages), sources, one[0] if one else None))
    parent = {(c, t): r for c, t, *_, r in out if r is not None}
    for k, r in enumerate(out):
        top = r[1]
        while (r[0], top) in parent:
            top = parent[r[0], top]
        out[k] = (*r, top)
    return out


def test_quotes_equal_brute_force(spark):
    df = spark.createDataFrame([(c, t, "user", x, "z") for c, t, x in CHAT], "conv_id long, turn int, role string, text string, message string")
    got = quotes.link(df).collect()
    assert sorted(str((r.conv_id, r.turn, r.own_text, r.n_quotes, r.sources, r.reply_to, r.thread)) for r in got) == sorted(map(str, brute(CHAT)))
    rows = [(r.conv_id, r.thread, r.turn) for r in quotes.conversations(df).collect() if r.conv_id is not None]
    assert rows == sorted(rows)
    assert quotes.link(df.limit(0)).collect() == []


def test_long_reply_chains_settle(spark):
    rows = [(1, 0, "line zero")] + [(1, k, f"> line {'zero' if k == 1 else k - 1}\nline {k}") for k in range(1, 40)]
    got = quotes.link(spark.createDataFrame([(c, t, "u", x) for c, t, x in rows], "conv_id long, turn long, role string, text string")).collect()
    assert {r.thread for r in got} == {0} and all(r.reply_to == r.turn - 1 for r in got if r.turn)


def test_pipeline(spark, tmp_path):
    import os

    import corpus_pipeline

    if not os.path.isdir(SF):
        pytest.skip("needs the driver's tables")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    n = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == corpus_pipeline.COLUMNS and out.dtypes == docs.select(*corpus_pipeline.COLUMNS).dtypes, name
        path = str(tmp_path / name.replace(" ", "_"))
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        assert docs.count() <= n
        n = docs.count()
    assert not docs.where(F.col("text").rlike(r"@mail\d\.example\.com")).count()
    last = corpus_pipeline.run(spark, SF)
    assert last.count() == n and last.where("not round_trip").count() == 0
    long = " ".join(f"word{k}" for k in range(20_000))
    rows = [(None, None, None, None, None), (1, "", "en", "s", 0), (1, "", "en", "s", 0), (2, long, "en", "s", len(long)), (2, "call 10.0.0.1 or x@y.org today please", "en", "s", 37)]
    dirty = spark.createDataFrame(rows, spark.read.parquet(f"{SF}/documents.parquet").select(*corpus_pipeline.COLUMNS).schema)
    got = {name: stage(spark, dirty, SF).collect() for name, stage in corpus_pipeline.STAGES}
    assert all(stage(spark, dirty.limit(0), SF).count() == 0 for _, stage in corpus_pipeline.STAGES)
    texts = lambda name: sorted(str(r.text) for r in got[name])
    everything = sorted(str(r[1]) for r in rows)
    assert texts("minhash near-dedup") == everything == texts("benchmark decontamination")  # blank texts are no copies of each other
    assert len(got["pii"]) == len(rows) and {str(r[1]) for r in rows[:4]} <= set(texts("pii")) and not any("10.0.0.1" in x or "x@y.org" in x for x in texts("pii"))
    assert set(texts("quality classifier")) <= set(everything) and texts("quality classifier").count("") in (0, 2)
    assert sorted((str(r.doc_id), r.n_tokens > 0, r.round_trip) for r in got["sentencepiece"]) == sorted([("None", False, True), ("1", False, True), ("1", False, True), ("2", True, True), ("2", True, True)])


def test_queries_are_registered():
    import __spark_entry__
    from tidemark.llm import queries

    names = list(queries.queries())
    assert [n.split("_")[0] for n in names] == [f"op{k}" for k in range(1, 14)] and set(names) | {"pipeline"} <= set(__spark_entry__.queries())
