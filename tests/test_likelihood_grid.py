from tidemark.plans import catalogue


def test_whole_likelihood_grid(spark):
    sf = "/root/testdata/sf0.001"
    rows = catalogue.queries()["concentrated_loglik"](spark, sf).groupBy("sid").agg({"*": "count", "loglik": "max"}).collect()
    best = {r.sid: r.grid_loglik for r in catalogue.queries()["fit_ml"](spark, sf).collect()}
    assert {r.sid for r in rows} == set(best)
    assert all(r["count(1)"] == 256 and abs(r["max(loglik)"] - best[r.sid]) < 1e-12 for r in rows)
