"""Exact top-k against the full table of inner products."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from slicekit.llm import topk as T

from .helpers import with_clashes

SCHEMA = "vec_id long, embedding array<double>, label int"


def _plain(rows, k=5, every=50):
    """The contract's words: every row but the query's own is a candidate."""
    fit = [(i, [math.floor(256 * x) for x in v]) for i, v in rows
           if i is not None and v is not None and all(x is not None and math.isfinite(x) and abs(256 * x) <= 2 ** 56 for x in v)]
    out = []
    for n, (q, a) in enumerate(fit):
        if q % every == 0:
            scores = sorted((-sum(x * y for x, y in zip(a, b)), i) for m, (i, b) in enumerate(fit) if m != n)[:k]
            out += [(q, r + 1, i, -s if abs(s) < 2 ** 63 else None) for r, (s, i) in enumerate(scores)]
    return sorted(out, key=str)


def _check(spark, rows, **how):
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA).repartition(3)
    got = T.nearest_vectors(with_clashes(df), **how)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted(map(tuple, got.collect()), key=str) == _plain(rows, **how)


@pytest.mark.parametrize("shape", ["dense", "sparse", "ties", "positive", "large"])
def test_against_all_products(spark, shape):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(400, 16)) * 0.3
    if shape == "sparse":
        x[rng.random(x.shape) < 0.85] = 0
    if shape == "ties":
        x = np.round(x * 2) / 2
    if shape == "positive":
        x = np.abs(x) * np.linspace(0.01, 3, 16)
    if shape == "large":
        x = x * 1e6
    _check(spark, [(i, [float(y) for y in v]) for i, v in enumerate(x)])


def test_shards_and_blocks_are_merged(spark):
    rng = np.random.default_rng(8)
    rows = [(i, [float(y) for y in v]) for i, v in enumerate(rng.normal(size=(300, 8)))]
    v = T.quantised(spark.createDataFrame([(i, x, 0) for i, x in rows], SCHEMA)).withColumn("row", F.col("vec_id") * 7)
    got = T.top_k(v.filter("vec_id % 10 = 0"), v, 3, shard=40, block=4)
    assert sorted(((r.query_id, r.rank, r.vec_id, int(r.score)) for r in got.collect()), key=str) == _plain(rows, 3, 10)


def test_edge_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, -1.0]), (0, [1.0, -1.0]), (50, [0.5, 0.5]), (50, [0.4, 0.5]), (1, None), (2, [None, 1.0]), (3, [nan, 1.0]),
            (4, [inf, 1.0]), (None, [1.0, 1.0]), (5, [1.0, 1.0]), (6, [1.0]), (7, [1.0, 1.0, 9.0]), (8, []), (100, []), (-50, [0.001, -0.001])]
    _check(spark, rows)
    _check(spark, [(0, [1.0])])
    _check(spark, [])
    _check(spark, [(0, [1.0]), (1, [2.0])])
    _check(spark, [(1, [1.0]), (2, [2.0])])


def test_rows_that_share_an_id_are_all_candidates_and_queries(spark):
    _check(spark, [(1, [2.0, 0.0]), (1, [3.0, 0.0]), (0, [1.0, 0.0])])
    _check(spark, [(50, [1.0, 2.0])] * 9 + [(50, [2.0, 1.0])] * 3 + [(i % 3, [i / 7, 1.0]) for i in range(40)])


def test_large_components_stay_exact_and_huge_ones_take_no_part(spark):
    one = 1 / 256
    rows = [(0, [513 * one]), (1, [(2 ** 50 + 1) * one]), (2, [2.0 ** 50 * one]), (3, [1e300]), (4, [-(2.0 ** 56) * one]), (5, [2.0 ** 57 * one])]
    got = {(r.query_id, r.vec_id): r.score for r in T.nearest_vectors(spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA)).collect()}
    assert got == {(0, 1): 577586652210266625, (0, 2): 513 * 2 ** 50, (0, 4): None}
    _check(spark, [(i, [(2.0 ** 40 + i) * one, -(2.0 ** 55) * one * (i % 3), float(i)]) for i in range(60)])


def test_probing_stops_early_but_loses_nothing():
    rng = np.random.default_rng(9)
    w = (rng.normal(size=(3000, 24)) * np.linspace(1, 60, 24)).astype(np.int64)
    p = T.Postings(np.arange(3000), np.arange(3000), w)
    for q in range(20):
        ids, score = p.top(q, w[q], 5)
        want = sorted(((-int(w[q] @ w[i]), i) for i in range(3000) if i != q))[:5]
        assert [(-int(s), int(i)) for i, s in zip(ids, score)] == want
