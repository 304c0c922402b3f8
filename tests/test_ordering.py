"""Running totals over range partitions against plain loops."""

import random
from itertools import groupby

from pyspark.sql import functions as F

from slicekit.operators import sample as N
from slicekit.operators.ordering import running_totals


def _expected(rows):
    out = []
    for _, group in groupby(sorted(rows, key=lambda r: ((r[0] is not None, r[0] or 0), r[1])), key=lambda r: r[0]):
        group, run, x = list(group), 0, 0
        for g, o, v in group:
            run, x = run + v, x ^ v
            out.append((g, o, v, run, x, len(group)))
    return sorted(out, key=str)


def test_running_totals_with_a_group_in_many_partitions(spark):
    rng = random.Random(3)
    rows = [(7 if rng.random() < 0.6 else rng.choice([None, 1, 2, 3, 8, 9]), i, rng.randrange(1 << 40)) for i in range(3000)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "g int, o int, v long").repartition(5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = running_totals(df, ["g"], ["o"], {"run": ("sum", F.col("v")), "x": ("xor", F.col("v"))},
                             {"n": ("sum", F.lit(1))})
        assert sorted((tuple(r) for r in got.collect()), key=str) == _expected(rows)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_running_totals_of_an_empty_table(spark):
    df = spark.createDataFrame([], "g int, o int")
    out = running_totals(df, ["g"], ["o"], {"run": ("sum", F.lit(1))})
    assert out.columns == ["g", "o", "run"] and out.count() == 0


def test_large_samples_equal_those_by_the_window_and_plan_none_over_a_group(spark, monkeypatch):
    rows = [(f"id{i % 1900}", "a" if i % 3 else None, i) for i in range(2000)] + [(None, "a", -1)]
    df = spark.createDataFrame(rows, "id string, dataset string, v int").repartition(4)

    def key(s):
        return sorted(((r.dataset, r.id, r.position) for r in s.collect()), key=str)

    for n in (1, 700, 5000):
        monkeypatch.setattr(N, "WINDOW_ROWS", 100_000)
        want = key(N.seeded_sample(df, n, seed=5))
        monkeypatch.setattr(N, "WINDOW_ROWS", 0)
        large = N.seeded_sample(df, n, seed=5)
        plan = large._jdf.queryExecution().executedPlan().toString()
        assert key(large) == want
        windows = [line for line in plan.splitlines() if "Window [" in line]
        assert windows and not any("[dataset#" in w.split("windowspecdefinition(")[1].split(",")[0] for w in windows
                                   if "windowspecdefinition(" in w)
