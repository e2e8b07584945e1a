"""The queries run the operators at their full sizes: 1,000 surrogates, 4,000 draws, 200 replicates a cell."""

import os

import pytest
from pyspark.sql import functions as F

from tidemark.operators import simulate as sim
from tidemark.plans import catalogue

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
TESTS = ("csd_test", "primary_with_comparators", "fixed_date_test", "analyze_h1", "e1_analyze", "e2_analyze", "e4_compare", "comparison_rows")


@pytest.mark.parametrize("name", TESTS)
def test_a_thousand_surrogates(spark, name):
    at = SF.replace("0.001", "0.01") if name == "fixed_date_test" else SF  # its last date lies behind the short series
    rows = [r for r in catalogue.queries()[name](spark, at).collect() if r["comparison"] not in ("observed_not_estimable", "null_model_failed", "unavailable")]
    assert rows and {r["retained"] + r["no_episode"] + r["failed"] for r in rows} == {1000}


def test_ledger_has_a_thousand_attempts(spark):
    got = catalogue.queries()["draw_surrogate"](spark, SF).where("number >= 0").groupBy("sid").count().collect()
    assert got and {r["count"] for r in got} == {1000}


def test_bootstrap_draws(spark):
    got = catalogue.queries()["residual_bootstrap"](spark, SF).agg(F.max("valid"), F.min("valid")).first()
    assert 3900 < got[1] <= got[0] <= 4000


@pytest.mark.parametrize("name", ("size_replicate", "power_replicate"))
def test_replicates(spark, name, monkeypatch):
    asked = []
    whole = sim.replicates
    monkeypatch.setattr(sim, "replicates", lambda spark, kappas, count, B=1000, **o: asked.append((count, B)) or whole(spark, kappas, 2, 19, **o))
    rows = catalogue.queries()[name](spark, SF).collect()
    assert asked == [(200, 1000)] and {r["requested"] for r in rows} == {200}
