"""Size and power runs of every design; whole queries keep to their cells."""

import pytest

from tidemark.kernels import streams
from tidemark.operators import simulate as sim


@pytest.mark.parametrize("design", sorted(sim.DESIGNS))
def test_replicates_of_a_design(spark, design):
    rows = sim.replicates(spark, [1.0, 1.6], 2, 9, design=design).collect()
    assert {(r.cell, r.replicate) for r in rows} == {(f"kappa{k}", n) for k in (0, 1) for n in (0, 1)} and len({r.input_sha256 for r in rows}) == 4
    assert all(r.status == "ok" and 0.1 <= r.p <= 1 for r in rows)
    done = sim.replicates(spark, [1.0, 1.6], 2, 9, design=design, done=spark.createDataFrame([("kappa0", 0)], "cell string, replicate int"))
    assert sorted(map(str, done.collect())) == sorted(str(r) for r in rows if (r.cell, r.replicate) != ("kappa0", 0))


def test_designs_plant_only_before_their_dates():
    make, _, onsets, _ = sim.DESIGNS["e1"]
    plain, planted = (make(streams.generator(61), k, onsets) for k in (1.0, 1.6))
    assert len(plain) == 316 and (plain[: onsets[0] - 2] == planted[: onsets[0] - 2]).all() and (plain[onsets[0] - 2] != planted[onsets[0] - 2])
    assert streams.var_design(streams.generator(62), 1.4, (77, 148)).shape == (195, 2)
