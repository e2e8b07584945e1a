"""Part files that commit or leave nothing, frozen folders, resume, editions, cascades, solves in the plan."""

import datetime as dt
import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import roots
from tidemark.functions.labels import parse_quarter
from tidemark.operators import cascade, editions, regress, resume
from tidemark.operators.series import ContractError
from tidemark.sources import frozen, parts


# ------------------------------------------------ part files
def seen(path):
    return sorted(os.path.join(d, f) for d, _, files in os.walk(path) for f in files if not f.startswith((".", "_"))) if os.path.isdir(path) else []


def test_parts_come_back(spark, tmp_path):
    path = str(tmp_path / "parts")
    df = spark.createDataFrame([(k, None if k % 3 else f"t\n{k} é", k / 7) for k in range(200)], "id long, text string, x double").repartition(5)
    parts.write_lines(df, path)
    assert sorted(map(tuple, parts.read_lines(spark, path, "id long, text string, x double").collect())) == sorted(map(tuple, df.collect()))
    listed = parts.manifest(spark, path).collect()
    assert sum(r.rows for r in listed) == 200 and {os.path.basename(f) for f in seen(path)} == {r.file for r in listed} and not any(n.startswith("_job") for n in os.listdir(path))
    with pytest.raises(Exception, match="written once"):
        parts.write_lines(df, path)
    parts.write_lines(df.limit(3), path, replace=True)
    assert parts.read_lines(spark, path, "id long, text string, x double").count() == 3 and len(seen(path)) == len(parts.manifest_of(path))


def test_a_changed_part_is_refused(spark, tmp_path):
    path = str(tmp_path / "parts")
    parts.write_lines(spark.range(50).coalesce(1), path)
    with open(seen(path)[0], "r+b") as f:
        f.write(b"{\"id\":9}")
    with pytest.raises(Exception, match="differs from the manifest"):
        parts.read_lines(spark, path, "id long").collect()


def test_a_killed_task_leaves_nothing(spark, tmp_path):
    path = str(tmp_path / "parts")
    bad = spark.range(0, 1000, 1, 4).select(F.when(F.col("id") == 900, F.raise_error(F.lit("killed"))).otherwise(F.col("id")).alias("id"))
    with pytest.raises(Exception, match="killed"):
        parts.write_lines(bad, path)
    assert seen(path) == [] and parts.manifest_of(path) == [] and not os.path.isdir(path) or os.listdir(path) == []
    parts.write_lines(spark.range(5), path)
    assert parts.read_lines(spark, path, "id long").count() == 5


def test_a_failed_assembly_leaves_nothing(spark, tmp_path):
    path = str(tmp_path / "parts")
    twice = spark.createDataFrame([("a.txt", b"1"), ("b.txt", b"2"), ("a.txt", b"3")], "name string, content binary").repartition(3)
    with pytest.raises(Exception, match="one file name"):
        parts.write_files(twice, path)
    assert seen(path) == [] and parts.manifest_of(path) == []
    writer = parts.PartsWriter({"path": path}, False)
    os.makedirs(f"{path}/{writer.job}/0")
    for name in ("x", "y"):
        with open(f"{path}/{writer.job}/0/{name}", "w") as f:
            f.write(name)
    told = [parts.Written([(f"{writer.job}/0/{n}", {"file": n, "bytes": 1, "rows": 1, "sha256": ""})]) for n in ("x", "gone")]
    with pytest.raises(FileNotFoundError):
        writer.commit(told)  # x is moved by then
    writer.abort(told)
    assert seen(path) == [] and os.listdir(path) == []


# ------------------------------------------------ frozen folders
def test_one_changed_byte_is_found(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(frozen, "LEAVES", 2)
    path = str(tmp_path / "folder")
    os.makedirs(f"{path}/sub")
    for k in range(60):
        with open(f"{path}/{'sub/' if k % 2 else ''}f{k}", "w") as f:
            f.write(f"content {k}")
    root = frozen.freeze(spark, path)
    assert frozen.verify(spark, path) and frozen.frozen_root(spark, path) == root and frozen.changed(spark, path).collect() == []
    with pytest.raises(ContractError, match="frozen already"):
        frozen.freeze(spark, path)
    with open(f"{path}/sub/f17", "r+") as f:
        f.write("C")
    os.remove(f"{path}/f4")
    with open(f"{path}/new", "w") as f:
        f.write("n")
    got = {r.file: (r.was is not None, r.now is not None) for r in frozen.changed(spark, path).collect()}
    assert not frozen.verify(spark, path) and got == {"sub/f17": (True, True), "f4": (True, False), "new": (False, True)}
    deep = frozen.tree(spark.read.parquet(f"{path}.frozen/leaves"))
    assert deep.agg(F.max("level")).first()[0] == 2 and deep.where("level = 0").first().n_files == 60


# ------------------------------------------------ resume
def test_inputs_made_anew_decide(spark):
    rows = spark.createDataFrame([("a", 1, 0.5), ("a", 2, 1.5), ("b", 1, 2.0), ("c", 1, 3.0), ("c", 1, 3.0), ("d", 1, None)], "k string, i int, x double")
    first = resume.input_hash(rows.repartition(4), ["k"], ["i", "x"])
    again = resume.input_hash(rows.repartition(2), ["k"], ["x", "i"])
    assert sorted(map(tuple, first.collect())) == sorted(map(tuple, again.collect()))
    ledger = first.where("k in ('a', 'c', 'd')").select("k", "input_sha256", F.when(F.col("k") == "d", "failed").otherwise("retained").alias("status"), F.lit(1.0).alias("p"))
    ledger = ledger.unionByName(spark.createDataFrame([("z", "0", "retained", 2.0)], ledger.schema))
    changed = rows.where("not (k = 'c' and i = 1 and x = 3.0)").unionByName(spark.createDataFrame([("c", 1, 3.0)], rows.schema))  # one repeat less
    ran = []

    def compute(todo):
        ran.extend(r.k for r in todo.select("k").distinct().collect())
        return todo.groupBy("k").agg(F.lit("retained").alias("status"), F.sum("x").alias("p"))

    done, apart = resume.resume(changed, ledger, ["k"], ["i", "x"], compute)
    assert {(r.k, r.status, r.p) for r in done.collect()} == {("a", "retained", 1.0), ("d", "failed", 1.0), ("b", "retained", 2.0)} and ran == ["b"]
    (q,) = apart.collect()
    assert q.k == "c" and q.stored_sha256 != q.input_sha256 and {r.k: r.action for r in resume.decide(first, ledger, ["k"]).collect()}["z"] == "orphan"
    with pytest.raises(ContractError, match="twice"):
        resume.decide(first, ledger.unionByName(ledger), ["k"])


# ------------------------------------------------ editions
def dates(s):
    return dt.date.fromisoformat(s) if s else None


def test_every_outcome_of_an_edition(spark):
    pages = [("l", "p1", "2020-01-10", None), ("l", "p2", "2020-03-29", None), ("l", "p3", "2020-07-01", "2020-08-01"), ("l", "p4", "2020-07-02", None), ("l", "p5", "2020-10-25", None), ("l", "p6", None, None)]
    entries = [("l", "p1", 1, "Edition  A", 1), ("l", "p2", 1, "Edition B", 1), ("l", "p3", 1, "Edition C", 1), ("l", "p4", 1, "edition c", 1), ("l", "p5", 1, "Edition D", 1), ("l", "p5", 2, "Edition B", 1), ("l", "p6", 1, "Edition E", 1)]
    calendar = [("l", "2020-03-29", 150, True, True), ("l", "2020-03-29", 570, False, True), ("l", "2020-10-25", 420, True, True), ("l", "2020-10-25", 430, True, True)]
    pages = spark.createDataFrame([(a, b, dates(c), dates(d)) for a, b, c, d in pages], "listing string, page string, release_day date, next_day date")
    entries = spark.createDataFrame(entries, "listing string, page string, position int, label string, files int")
    calendar = spark.createDataFrame([(a, dates(b), *c) for a, b, *c in calendar], "listing string, day date, minute int, published boolean, lists_dataset boolean")
    e = {r.edition: r for r in editions.evidence(pages, entries, calendar).collect()}
    assert {k: (r.day_status, r.minute_status) for k, r in e.items()} == {"edition a": ("agreed", "absent"), "edition b": ("agreed", "agreed"), "edition c": ("conflicting", "absent"), "edition d": ("agreed", "conflicting"), "edition e": ("absent", "absent")}
    # 29 March: the clock goes forward at 01:00 UTC, so 02:30 is 01:30 UTC; 25 October has 25 hours
    assert e["edition b"].opens == dt.datetime(2020, 3, 29, 1, 30) and e["edition d"].opens == dt.datetime(2020, 10, 24, 23) and e["edition d"].closes == dt.datetime(2020, 10, 26)
    asked = [("l", 1, dt.datetime(2020, 1, 10, 12)), ("l", 2, dt.datetime(2020, 1, 11)), ("l", 3, dt.datetime(2020, 3, 29, 1, 30, 30)), ("l", 4, dt.datetime(2020, 3, 29, 1, 31)), ("l", 5, dt.datetime(2020, 10, 25, 23, 30))]
    asked = spark.createDataFrame(asked, "listing string, ask int, at timestamp")
    got = {r.ask: (r.edition, r.outcome, r.complete, r.n_within) for r in editions.resolve(pages, entries, calendar, asked).collect()}
    assert got == {1: (None, "none", False, 1), 2: ("edition a", "selected", False, 0), 3: ("edition a", "selected", False, 1), 4: ("edition b", "selected", True, 0), 5: ("edition b", "selected", False, 1)}
    tied = entries.unionByName(spark.createDataFrame([("l", "q", 1, "Edition F", 1)], entries.schema))
    more = pages.unionByName(spark.createDataFrame([("l", "q", dates("2020-03-29"), None)], pages.schema))
    assert {r.ask: r.outcome for r in editions.resolve(more, tied, calendar.limit(0), asked).collect()}[5] == "tie"
    assert {r.ask: r.outcome for r in editions.resolve(pages, entries.withColumn("files", F.lit(2)), calendar, asked).collect()}[4] == "files"


# ------------------------------------------------ cascades
def test_each_stage_narrows(spark):
    rows = [("g", "a", {"t": "real gdp uk"}), ("g", "b", {"t": "real gdp"}), ("g", "c", {"t": "gdp growth"}), ("h", "a", {"t": "real gdp"}), ("i", "a", {"t": "none"}), ("i", "b", {}), ("j", "a", {"t": "real gdp uk"}), ("j", "b", {"t": "real gdp uk"}), ("k", "a", {"t": "real gdp"}), ("k", "b", {"t": "real gdp"})]
    rules = [(1, "t", "real", True), (1, "t", "gdp", True), (1, "t", "growth", False), (2, "t", "uk", True)]
    made = cascade.cascade(spark.createDataFrame(rows, "g string, candidate string, fields map<string,string>"), spark.createDataFrame(rules, "stage int, field string, pattern string, wanted boolean"), ["g"])
    got = {(r.g, r.candidate): (r.dropped_at, r.chosen, r.outcome, r.stage) for r in made.collect()}
    assert got == {
        ("g", "a"): (None, True, "chosen", 2), ("g", "b"): (2, False, "chosen", 2), ("g", "c"): (1, False, "chosen", 2), ("h", "a"): (None, True, "chosen", 1), ("i", "a"): (1, False, "nothing", 1), ("i", "b"): (1, False, "nothing", 1),
        ("j", "a"): (None, False, "several", 2), ("j", "b"): (None, False, "several", 2), ("k", "a"): (2, False, "nothing", 2), ("k", "b"): (2, False, "nothing", 2)}
    with pytest.raises(ContractError):
        cascade.cascade(made, spark.createDataFrame([], "stage int, field string, pattern string, wanted boolean"), ["g"])


# ------------------------------------------------ solves
def test_elimination_equals_lstsq(spark):
    rng = np.random.default_rng(8)
    rows, want = [], {}
    for k in range(30):
        z = rng.normal(size=(25, 3)) * [1, 1e3, 1e-3] + [5, -1e4, 0]
        if k == 7:
            z[:, 2] = 2 * z[:, 0] - z[:, 1]
        if k == 8:
            z[:, 1] = 4.0
        y = z @ rng.normal(size=(3, 2)) + rng.normal(size=(25, 2))
        rows += [(k, *map(float, a), *map(float, b)) for a, b in zip(z, y)]
        want[k] = np.linalg.lstsq(np.column_stack([np.ones(25), z]), y, rcond=None)[0]
    df = spark.createDataFrame(rows, "k int, z1 double, z2 double, z3 double, y1 double, y2 double")
    for r in regress.fit(df, ["z1", "z2", "z3"], ["y1", "y2"], ["k"]).collect():
        if r.k in (7, 8):
            assert r.status == "failed" and r.beta is None
        else:
            got = np.vstack([r.intercept, r.beta])
            assert r.status == "ok" and np.allclose(got, want[r.k], rtol=1e-8, atol=1e-8)


def test_plans_of_vector_fits_have_no_python(spark):
    pairs = spark.createDataFrame([("s", t, float(np.sin(t)), float(np.cos(t * t))) for t in range(90)], "sid string, pos long, g double, du double")
    for df in (regress.rolling_var2(pairs), regress.ols_var2(pairs), regress.hamilton_cycle(pairs.withColumnRenamed("g", "x"))):
        assert not any(w in df._jdf.queryExecution().executedPlan().toString() for w in ("Python", "Pandas", "Arrow"))
    x = np.array([[np.sin(t), np.cos(t * t)] for t in range(90)])
    from tidemark.kernels import matrices

    for r in regress.rolling_var2(pairs).collect():
        c, a1, a2, m = matrices.var2(x[None, r.pos - 39 : r.pos + 1])
        assert np.allclose(r.intercept, c[0], atol=1e-9) and np.allclose(r.A1, a1[0], atol=1e-9) and np.allclose(r.A2, a2[0], atol=1e-9) and abs(r.modulus - m[0]) < 1e-9


def test_root_moduli_and_schur_cohn_of_any_degree(spark):
    rng = np.random.default_rng(12)
    rows = []
    for k, n in enumerate([*range(1, 65), 1, 2, 3, 4, 8]):
        r = rng.uniform(0.2, 1.1, n) * np.exp(1j * rng.uniform(0, np.pi, n))
        real = rng.uniform(-1, 1, n % 2)
        c = np.real(np.poly(np.concatenate([r[: n // 2], np.conj(r[: n // 2]), real])))[::-1]
        rows.append((k, [float(v) for v in c]))
    rows += [(100, [0.0, 0.0, 3.0]), (101, [0.25, -1.0, 1.0]), (102, [5.0]), (103, None)]
    df = spark.createDataFrame(rows, "k int, c array<double>")
    got = {r.k: r for r in df.select("k", regress.largest_modulus(F.col("c")).alias("m"), roots.schur_cohn_stable(roots.complex_array(F.col("c"))).alias("s")).collect()}
    for k, c in rows[:-4]:
        m = np.abs(np.roots(c[::-1])).max()
        assert abs(got[k].m - m) < 1e-6 * max(1, m), (k, len(c))
        if abs(m - 1) > 1e-4:
            assert got[k].s == (m < 1), (k, len(c), m)
    assert got[100].m == 0 and got[100].s and abs(got[101].m - 0.5) < 1e-7 and (got[102].m, got[102].s) == (None, True) and (got[103].m, got[103].s) == (None, None)
    whole = spark.createDataFrame([([(0.1, 0.3), (0.0, -0.4), (0.0, 1.0)],), ([(0.9, 0.6), (0.0, 0.0), (1.0, 0.0)],)], "c array<struct<re:double,im:double>>")
    assert [r[0] for r in whole.select(roots.schur_cohn_stable(F.col("c"))).collect()] == [True, False]
    with pytest.raises(Exception, match="leading coefficient"):
        spark.createDataFrame([([1.0, 0.0],)], "c array<double>").select(roots.schur_cohn_stable(roots.complex_array(F.col("c")))).collect()


def test_quarters_by_tokens(spark):
    gaps, names = ("", " "), ("Quarter", "qtr", "QUARTER.", "Qtr.")
    good = [f"1955{a}Q{b}3" for a in ("", " ", "-", " - ") for b in gaps] + [f"q{b}3{a}1955" for a in (" ", "-", ", ", " , ") for b in gaps]
    good += [f"1955 {w}{b}3" for w in names for b in gaps] + [f"{w}{b}3{c}1955" for w in names for b in gaps for c in (" ", ", ", ",")] + [f" 3rd  {w}{c}1955 " for w in names for c in (" ", ", ")]
    bad = ["1955QTR 3", "1955 Q.3", "1955, Q3", "3 1955", "Q3", "Q3 Q4 1955", "1955 1956 Q3", "1955 - QTR 3", "3 rd QTR 1955", "3rd Q 1955", "QTR 3rd 1955", "1955 3rd QTR", "3 QTR 1955", "1955 3 Q", "1955 Q3 x", "Q3-,1955", "Q-3 1955", "QTR .3 1955", "1955 Q33", "(1955 Q3)", "1955 Q3 Q3"]
    rows = spark.createDataFrame([(x,) for x in good + bad], "t string").select("t", parse_quarter(F.col("t")).alias("q")).collect()
    assert [r.t for r in rows if r.q != (4 * 1955 + 2 if r.t in good else None)] == []


def test_manifest_is_plain_json(spark, tmp_path):
    parts.write_files(spark.createDataFrame([("a.txt", b"x")], "name string, content binary"), str(tmp_path / "f"))
    with open(tmp_path / "f" / parts.MANIFEST) as f:
        assert json.load(f) == [{"bytes": 1, "file": "a.txt", "rows": 1, "sha256": "2d711642b726b04401627ca9fbac32f5c8530fb1903cc4db02258717921a4881"}]
