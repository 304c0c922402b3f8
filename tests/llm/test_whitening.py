"""Whitening against numpy on the contract's words."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from slicekit.llm.whitening import whitened_components, whiten_embeddings

SCHEMA = "vec_id long, embedding array<double>, label int"


def _rows(d=6, n=90, seed=1):
    rng = random.Random(seed)
    rows = [(i, [rng.gauss(0, 1 + j) for j in range(d)], 0) for i in range(n)]
    rows += [(1000 + i, list(rows[0][1]), 1) for i in range(60)]  # a hot vector
    rows += [(3, list(rows[5][1]), 2), (None, list(rows[6][1]), 2)]  # repeated and null ids
    return rows


def _brute(rows, limit=32, distinct=False):
    xs = [(i, [math.floor(64 * c) + 1_000_000 for c in v]) for i, v, _ in rows]
    fit = [list(t) for t in {tuple(x) for _, x in xs}] if distinct else [x for _, x in xs]
    n, sums = len(fit), [sum(col) for col in zip(*fit)]
    a = np.array(fit, dtype=float) - np.array([s / n for s in sums])
    cov = a.T @ a / n
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1][:limit], vectors[:, ::-1][:, :limit]
    out = {}
    for i, x in xs:
        z = (np.array(x) - np.array([s / n for s in sums])) @ (vectors / np.sqrt(values))
        deviation = sum((n * c - s) ** 2 for c, s in zip(x, sums))
        out[i, deviation] = (n, z, values / np.trace(cov))
    return out


@pytest.mark.parametrize("weights", ["counts", "one"])
def test_whitening_equals_brute_force(spark, weights):
    rows = _rows()
    got = whitened_components(spark.createDataFrame(rows, SCHEMA).repartition(5), weights=weights).collect()
    want = _brute(rows, distinct=weights == "one")
    assert len(got) == 6 * len(rows)
    signs = {}
    for r in sorted(got, key=lambda r: str(r.vec_id)):
        n, z, explained = want[r.vec_id, r.deviation]
        v = z[r.component - 1]
        s = signs.setdefault(r.component, 1 if abs(r.whitened - v) < abs(r.whitened + v) else -1) if abs(v) > 1e-3 else signs.get(r.component)
        assert r.n == n and abs(r.explained - explained[r.component - 1]) < 1e-9
        assert s is None or abs(r.whitened - s * v) < 1e-8
        assert r.identity_error < 1e-9
    assert {r.component for r in got} == set(range(1, 7))


def test_rows_without_part_and_clashing_columns(spark):
    rows = _rows() + [(2000, None, 0), (2001, [1.0, None, 1.0, 1.0, 1.0, 1.0], 0), (2002, [float("nan")] * 6, 0),
                      (2003, [float("inf")] + [0.0] * 5, 0), (2004, [1e300] + [0.0] * 5, 0), (2005, [], 0), (2006, [1.0], 0)]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("x") for c in ("x", "k1", "n", "z", "weight", "held", "few")})
    got = whiten_embeddings(df).collect()
    assert len(got) == len(_rows()) and not {r.vec_id for r in got} & set(range(2000, 2010))
    assert {(r.vec_id, r.deviation) for r in got} == set(_brute(_rows()))


@pytest.mark.parametrize("rows", [[], [(1, [1.0, 2.0], 0)], [(1, [1.0, 2.0], 0)] * 5, [(1, None, 0)]])
def test_tables_without_spread_give_no_row(spark, rows):
    out = whitened_components(spark.createDataFrame(rows, SCHEMA))
    assert out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert out.count() == 0


def test_dependent_dimensions_are_left_out(spark):
    rng = random.Random(4)
    rows = [(i, [float(a := rng.randrange(-50, 50)), 2 * float(a), 0.5], 0) for i in range(40)]
    got = whitened_components(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r.component for r in got} == {1} and got[0].identity_error < 1e-9


def test_large_integers_stay_exact(spark):
    big = 2.0 ** 50
    rows = [(i, [big * i, float(i % 3), 1.5 * i], 0) for i in range(8)]
    got = {(r.vec_id, r.deviation) for r in whiten_embeddings(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {(i, v if v < 2 ** 63 else None) for i, v in _brute(rows, limit=3)}
