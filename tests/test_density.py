import math

import pytest

from loomspar.operators.density import binned_density, modes


def test_density_gate_and_integral(spark):
    rows = [("a", 1.0 + n / 100) for n in range(51)] + [("b", 1.0)] * 50 + [("a", None), ("a", float("nan")), ("a", 99.0)]
    df = spark.createDataFrame(rows, "k string, v double")
    got = binned_density(df, "k", "v", 0.0, 4.0, 200, 0.1).collect()
    assert {r.k for r in got} == {"a"} and sum(r.density for r in got) * 0.02 == pytest.approx(1, abs=1e-6)
    assert 1.0 < modes(binned_density(df, "k", "v", 0.0, 4.0, 200, 0.1), "k").first()["mode"] < 1.5
    assert binned_density(df.limit(0), "k", "v", 0.0, 4.0, 20, 0.1).count() == 0


def test_von_mises_wraps_around(spark):
    df = spark.createDataFrame([("a", 0.01 if n % 2 else 2 * math.pi - 0.01) for n in range(60)], "k string, v double")
    got = sorted(binned_density(df, "k", "v", 0.0, 2 * math.pi, 60, 50.0, "von_mises").collect(), key=lambda r: r.bin)
    assert got[0].density == pytest.approx(got[-1].density) and got[30].density < 1e-6
    assert sum(r.density for r in got) * 2 * math.pi / 60 == pytest.approx(1, abs=1e-6)
