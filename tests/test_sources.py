"""Sources stop where their contracts break; the store takes a coordinate once; late rows are counted for good."""

import time

import pytest
from pyspark.sql import functions as F

from tidemark.operators.series import ContractError
from tidemark.sources import shared, text, workbook
from tidemark.sources.store import ReplicateStore
from tidemark.streaming import online

HEAD = '"Title","T"\n"CDID","ABCD"\n'


@pytest.mark.parametrize("body,match", [
    (HEAD + '"1999 Q1","1"\n"1999 Q2"\n', "two fields"), (HEAD + '"1999 Q1","1","2"\n', "two fields"), (HEAD + '"CDID","X"\n"1999 Q1","1"\n', "twice"), (HEAD + '"1999 Q1","1"\n"Unit","m"\n', "behind data"),
])
def test_damaged_statistics_stop(spark, tmp_path, body, match):
    (tmp_path / "f.csv").write_text(body)
    with pytest.raises(ContractError, match=match):
        text.scan_ons_csv(spark, str(tmp_path / "f.csv"))


def test_sound_statistics(spark, tmp_path):
    (tmp_path / "f.csv").write_text("﻿" + HEAD + '"1999","1"\n"1999 Q1","2"\n"1999 JAN","3"\n')
    got = [(r.label, r.raw, r.kind) for r in text.scan_ons_csv(spark, str(tmp_path / "f.csv")).collect()]
    assert got == [("Title", "T", "header"), ("CDID", "ABCD", "header"), ("1999", "1", "year"), ("1999 Q1", "2", "quarter"), ("1999 JAN", "3", "month")]


def test_a_wrong_file_is_no_header(spark):
    parsed = spark.range(1000).select(F.col("id").cast("string").alias("label"), F.lit("x").alias("raw"), F.lit("header").alias("kind"))
    with pytest.raises(ContractError, match="no header"):
        text.check_identity(parsed, "ABCD", "D", [])


def test_first_line_is_the_manifest(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"type":"manifest"}\n{"type":"record","k":1}\n')
    (tmp_path / "b.jsonl").write_text('{"type":"record","k":1}\n{"type":"manifest"}\n')
    assert [r.k for r in text.json_records(spark, str(tmp_path / "a.jsonl"), "k long", ["record"]).collect()] == [1]
    with pytest.raises(ContractError, match="manifest"):
        text.json_records(spark, str(tmp_path / "b.jsonl"), "k long", ["record"])


def test_cells_of_a_workbook():
    from xml.etree import ElementTree as ET

    book = workbook.Workbook.__new__(workbook.Workbook)
    book.shared, book.date_styles = ["words", "  "], {3}
    kinds = lambda inner, **a: book._classify(ET.fromstring(f'<c xmlns="{workbook.NS[1:-1]}" {" ".join(f"{k}=\'{v}\'" for k, v in a.items())}>{inner}</c>'), True)
    assert kinds("<v>0</v>", t="s") == ("text", "words") and kinds("<v>1</v>", t="s") == ("empty", None)
    assert kinds("<v>2001-02-03</v>", t="d") == ("date", "2001-02-03") and kinds("", t="d") == ("empty", None)
    assert kinds("<is><t> </t></is>", t="inlineStr") == ("empty", None) and kinds("<v>5</v>", s="3") == ("date", "5") and kinds("<v>5</v>") == ("number", "5")


def cells(spark, rows):
    flat = [("p", "s", r, c, "empty" if v is None else "text" if isinstance(v, str) and not v.isdigit() else "number", v) for r, row in enumerate(rows, 1) for c, v in enumerate(row, 1)]
    return spark.createDataFrame(flat, "path string, sheet string, row int, col int, kind string, text string")


def test_levels_stop_at_a_bad_year(spark):
    fine = [["year", "level"], ["1990", "1"], [None, None], ["1991", "2"], ["note", "x"]]
    assert sorted((r.year, r.level) for r in workbook.extract_levels(cells(spark, fine), "s", 1, 2).collect()) == [(1990, 1.0), (1991, 2.0)]
    with pytest.raises(ContractError, match="whole year"):
        workbook.extract_levels(cells(spark, [["1990", "1"], ["199x", "2"], ["1992", "3"]]), "s", 1, 2)


def test_store_takes_a_coordinate_once(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1, 0.5), ("a", 2, 0.6)], "cell string, replicate int, S double")
    store = ReplicateStore(spark, str(tmp_path / "st"), {"v": 1})
    assert store.put(rows) == 2 and store.put(rows) == 0
    with pytest.raises(ContractError, match="twice"):
        store.put(spark.createDataFrame([("b", 1, 0.5), ("b", 1, 0.7)], "cell string, replicate int, S double"))
    assert store.put(spark.createDataFrame([("b", 1, 0.5)], "cell string, replicate int, S double")) == 1
    assert store.verify() == {"records": 3, "wrong": 0, "odd": 0, "orphans": 0, "foreign": 0}
    (tmp_path / "st" / "writing").write_text("")
    with pytest.raises(ContractError, match="another writer"):
        store.put(rows)
    store.unlock()
    assert store.put(rows) == 0
    with pytest.raises(ContractError, match="manifest"):
        ReplicateStore(spark, str(tmp_path / "st"), {"v": 2})


def test_a_cluster_needs_a_shared_folder():
    class Cluster:
        class conf:
            get = staticmethod(lambda *a: None)

        class sparkContext:
            master = "yarn"

    with pytest.raises(RuntimeError, match="checkpoint"):
        shared.shared_dir(Cluster())


def test_late_rows_are_counted_in_every_batch(spark, tmp_path):
    import datetime

    late = online.LateRows()
    spark.streams.addListener(late)
    start = datetime.datetime(2024, 1, 1)
    hours = [[0, 10], [20], [0, 21], [1, 22], [2, 3, 30]]
    for k, hs in enumerate(hours):
        spark.createDataFrame([("a", start + datetime.timedelta(hours=h), 1.0) for h in hs], "sid string, at timestamp, v double").coalesce(1).write.parquet(str(tmp_path / "in" / str(k)))
    src = spark.readStream.schema("sid string, at timestamp, v double").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    q = online.levels_stream(src, "sid", "at", "v").writeStream.format("memory").queryName("late").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    for _ in range(50):
        if late.count(q) == 4:
            break
        time.sleep(0.2)
    q.stop()
    spark.streams.removeListener(late)
    assert late.count(q) == 4


def test_page_titles(spark, tmp_path):
    from tidemark.plans import source_queries

    pages = [(1, "<title>a\n &amp; b&amp</title><a href=\"x\">x</a><svg><title>c</title></svg>"), (2, "<title>&amp;lt; &quot; &lt;</title>"), (3, None), (4, "")]
    spark.createDataFrame(pages, "page_id long, html string").write.parquet(str(tmp_path / "pages.parquet"))
    got = {r.page_id: (r.title, r.n_links) for r in source_queries.html_dataset_page(spark, str(tmp_path)).collect()}
    assert got == {1: ("a & b&amp", 1), 2: ("&lt; \" &lt;", 0), 3: (None, None), 4: ("", 0)}
    decoded = {r.page_id: r.title for r in workbook.html_pages(spark.read.parquet(str(tmp_path / "pages.parquet"))).collect()}
    assert decoded == {1: "a & b&", 2: "&lt; \" <", 3: None, 4: ""}


def test_json_records_are_written_by_every_partition(spark, tmp_path):
    """The manifest comes first without a sort, and rows stay in their own partitions' files."""
    rows = spark.range(0, 1000, 1, 6).select(F.format_string('{"type":"record","k":%d}', "id").alias("value"))
    text.write_json_records(rows, '{"type":"manifest"}', str(tmp_path / "r"))
    files = sorted((tmp_path / "r").glob("part-*"))
    assert len(files) == 7 and files[0].read_text() == '{"type":"manifest"}\n'
    assert sorted(r.k for r in text.json_records(spark, str(tmp_path / "r"), "k long", ["record"]).collect()) == list(range(1000))
    text.write_json_records(rows.where("id < 0"), '{"type":"manifest"}', str(tmp_path / "none"))
    assert text.json_records(spark, str(tmp_path / "none"), "k long", ["record"]).count() == 0
