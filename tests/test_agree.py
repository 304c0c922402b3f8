"""Correlation, p values, listwise deletion."""

import math

import pytest

from slicekit.operators import agree as G


def _t_two_sided(r, n, steps=200000):
    """Independent check: integrate the t density numerically."""
    df = n - 2
    t = abs(r) * math.sqrt(df / (1 - r * r))
    c = math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(df * math.pi)
    hi, h = t, t / steps
    s = sum(c * (1 + ((i + 0.5) * h) ** 2 / df) ** (-(df + 1) / 2) for i in range(steps)) * h
    return 1 - 2 * s


@pytest.mark.parametrize("r,n", [(0.5, 10), (0.1, 50), (-0.8, 6), (0.99, 30)])
def test_p_value(r, n):
    assert G.pearson_p_value(r, n) == pytest.approx(_t_two_sided(r, n), abs=1e-6)


def test_p_value_edges():
    assert G.pearson_p_value(1.0, 10) == 0.0
    assert G.pearson_p_value(None, 10) is None
    assert G.pearson_p_value(0.3, 2) is None


def test_metric_agreement_listwise_and_constant(spark):
    rows = [(float(i), 2.0 * i, None if i == 3 else 5.0, float(i % 2)) for i in range(10)]
    df = spark.createDataFrame(rows, "chrf double, comet double, adequacy double, fluency double")
    out = {(r.metric_a, r.metric_b): (r.r, r.n) for r in G.metric_agreement(df).collect()}
    assert out[("chrf", "comet")][0] == pytest.approx(1.0)
    assert out[("chrf", "comet")][1] == 9          # row 3 dropped (listwise)
    assert out[("chrf", "adequacy")][0] is None    # constant column -> undefined, not an error
    assert out[("adequacy", "adequacy")][0] is None
    small = df.limit(4)
    assert G.metric_agreement(small).count() == 0


def test_pearson_r_groups(spark):
    df = spark.createDataFrame([("a", float(i), float(i) * 3 + 1) for i in range(8)]
                               + [("b", float(i), float(-i)) for i in range(8)], "g string, x double, y double")
    got = {r.g: (r.r, r.p) for r in G.pearson_r(df, "x", "y", ("g",)).collect()}
    assert got["a"][0] == pytest.approx(1.0) and got["b"][0] == pytest.approx(-1.0)
    assert got["a"][1] == 0.0
