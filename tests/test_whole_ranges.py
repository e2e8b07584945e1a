import datetime

from tidemark.plans import catalogue

Q = catalogue.queries()


def orders(spark, at, keys):
    spark.createDataFrame([(k, float(k)) for k in keys], "o_orderkey long, o_totalprice double").write.parquet(f"{at}/orders.parquet")
    return str(at)


def test_gaps_above_twenty_thousand(spark, tmp_path):
    d = orders(spark, tmp_path, [k for k in range(30_000) if k not in (7, 25_000)])
    assert sorted(r.missing for r in Q["missing_coordinates"](spark, d).collect()) == [7, 25_000]


def test_sample_is_of_all_keys(spark, tmp_path):
    keys = list(range(500_000, 900_000, 70))
    got = [r.o_orderkey for r in Q["sample_by_seed"](spark, orders(spark, tmp_path, keys)).collect()]
    assert len(set(got)) == 25 and set(got) <= set(keys) and max(got) - min(got) > 200_000
    few = tmp_path / "few"
    assert sorted(r.o_orderkey for r in Q["sample_by_seed"](spark, orders(spark, few, [3, 9])).collect()) == [3, 9]


def test_london_time_in_all_months(spark, tmp_path):
    t = [datetime.datetime(2024, 1, 5, 0, 30), datetime.datetime(2024, 7, 5, 23, 30), datetime.datetime(2024, 10, 27, 1, 30)]
    spark.sql("select * from values " + ", ".join(f"({k}L, timestamp '{x}')" for k, x in enumerate(t)) + " as e(event_id, ts)").write.parquet(f"{tmp_path}/events.parquet")
    got = {r.event_id: (r.back, r.day) for r in Q["london_time"](spark, str(tmp_path)).collect()}
    assert got == {0: ("2024-01-04 23:30:00", "2024-01-05"), 1: ("2024-07-05 23:30:00", "2024-07-06"), 2: ("2024-10-27 01:30:00", "2024-10-27")}
