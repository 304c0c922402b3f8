"""Cubes against rows, and reports updated from changed cells against full ones."""

import random

from pyspark.sql import functions as F

from slicekit.config import FIXTURE as CFG
from slicekit.operators import cube as Q
from slicekit.operators import mt as M
from slicekit.operators import reshape as R
from slicekit.operators import slices as S
from slicekit.plans import fixtures as fx
from slicekit.plans import prep_queries
from slicekit.session import scratch_path
from slicekit.sources.checkpoint import StageStore
from slicekit.streaming import increments as I

from .conftest import SF001

CELLS = ("id string, lang string, dataset string, model string, condition string, prediction string, verdict string, reason string, "
         "correct boolean, status string, error string, tags struct<linguistic_phenomena: array<string>, paraphrase_distance: string, domain: string>")


def _cells(spark, seed=1, n=400):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        lang = rng.choice(["de", "en", "xx"])
        tags = None if rng.random() < 0.2 else ([t for t in ("newline", "pipe", "odd") if rng.random() < 0.4] or rng.choice([None, []]),
                                                rng.choice(["paraphrase", None]), rng.choice(["general", None]))
        for m in ("m0", "m1", "other"):
            for c in ("openbook", "closedbook"):
                ok = rng.choice([True, False, None])
                rows.append((f"i{i}", lang, f"{lang}_{rng.choice(['native', 'translated'])}", m, c, "p",
                             None if ok is None else "correct" if ok else "incorrect", "", ok, "ok", None, tags))
    return spark.createDataFrame(rows, CELLS)


def _rows(df):
    return sorted((tuple(sorted(r.asDict().items())) for r in df.collect()), key=str)


def _qa_reports(flat):
    return [S.accuracy_by_benchmark(flat, CFG, ordered=False), S.accuracy_by_phenomenon(flat, CFG), S.slices_long(flat, CFG),
            S.accuracy_by_paraphrase(flat), S.accuracy_by_domain(flat)]


def test_reports_from_a_cube_equal_those_from_rows(spark):
    cells = _cells(spark)
    flat = R.flatten_all(cells, None, CFG).cache()
    cube = Q.as_flat(Q.qa_cube(flat, CFG), CFG)
    for a, b in zip(_qa_reports(flat), _qa_reports(cube)):
        assert a.schema.simpleString() == b.schema.simpleString() and _rows(a) == _rows(b)
    assert _rows(S.open_vs_closed(flat, CFG, spark)) == _rows(S.open_vs_closed(cube, CFG, spark))
    items = cells.select("id", "lang", "dataset", "tags").dropDuplicates(["id"])
    few = Q.as_flat(Q.item_cube(items, CFG), CFG)
    assert _rows(S.coverage(items, CFG)) == _rows(S.coverage(few, CFG))
    assert _rows(S.tagged_counts(items, CFG, spark)) == _rows(S.tagged_counts(few, CFG, spark))


def test_mt_reports_from_a_cube_equal_those_from_rows(spark):
    rng = random.Random(2)
    value = lambda: None if rng.random() < 0.2 else round(rng.uniform(0, 100), 5)
    rows = [(f"i{i}", rng.choice(["de", "fr", "xx"]), [t for t in ("newline", "pipe") if rng.random() < 0.5] or ["none"],
             rng.choice(["m0", "m1"]), value(), value(), value(), value()) for i in range(300)]
    flat = spark.createDataFrame(rows, "id string, lang string, phenomena array<string>, model string, chrf double, comet double, "
                                       "adequacy double, fluency double")
    cube = Q.as_flat(Q.mt_cube(flat, CFG), CFG)

    def rounded(df):
        return _rows(df.select(*[F.round(c, 7).alias(c) if t == "double" else c for c, t in df.dtypes]))
    assert rounded(M.system_level(flat, CFG)) == rounded(M.system_level(cube, CFG))
    assert rounded(M.per_tag(flat, CFG)) == rounded(M.per_tag(cube, CFG))


def test_updates_from_changed_cells_equal_a_full_run(spark):
    cells = _cells(spark, 3)
    store, keys, payload = StageStore(spark, scratch_path(spark, "inc")), ["id", "model", "condition"], ["verdict", "reason", "correct", "tags"]
    I.write_table(store, "cells", cells)
    cube = I.CubeTable(store, "cube")
    cube.start(Q.qa_cube(R.flatten_all(I.current(store, "cells"), None, CFG), CFG))
    for turn in range(2):
        changed = I.current(store, "cells").filter(F.pmod(F.xxhash64("id", F.lit(turn)), F.lit(100)) < 3)
        results = changed.select(*keys, F.lit("correct").alias("verdict"), F.lit(f"again {turn}").alias("reason"), F.lit(True).alias("correct"),
                                 F.when(F.col("model") == "m0", F.col("tags")).alias("tags"),  # tags change too
                                 F.when(F.col("model") == "m1", "error").otherwise("ok").alias("status"), F.lit("x").alias("error"))
        version = I.upsert_with_changes(store, "cells", results, keys, payload)
        before, after = I.changes(store, "cells", version)
        assert after.count() == results.filter("status = 'ok'").count()
        for x in (before, after):  # of the new version, only the folder of changed rows
            scan = x._jdf.queryExecution().executedPlan().toString()
            assert "= true)]" in scan.split("PartitionFilters: [")[1].split(", ReadSchema")[0].split(", PushedFilters")[0]
        I.apply_cell_changes(cube, "cells", version, CFG)
        I.apply_cell_changes(cube, "cells", version, CFG)  # a second time counts for nothing
        full = Q.qa_cube(R.flatten_all(I.current(store, "cells"), None, CFG), CFG)
        assert _rows(cube.read()) == _rows(full)
        for a, b in zip(_qa_reports(Q.as_flat(full, CFG)), _qa_reports(Q.as_flat(cube.read(), CFG))):
            assert _rows(a) == _rows(b)
        if turn == 0:
            cube.compact()
            assert _rows(cube.read()) == _rows(full)


def test_updates_of_an_empty_table(spark):
    none = _cells(spark, n=0)
    store, keys, payload = StageStore(spark, scratch_path(spark, "inc")), ["id", "model", "condition"], ["verdict", "reason", "correct"]
    I.write_table(store, "cells", none)
    cube = I.CubeTable(store, "cube")
    cube.start(Q.qa_cube(R.flatten_all(I.current(store, "cells"), None, CFG), CFG))
    for results in (none, _cells(spark, n=3)):
        version = I.upsert_with_changes(store, "cells", results, keys, payload)
        before, after = I.changes(store, "cells", version)
        assert before.count() == 0 and after.count() == results.count()


def test_report_cubes_scan_documents_once(spark):
    def scans(df, name):
        return df._jdf.queryExecution().executedPlan().toString().count(f"{name}.parquet")
    items = fx.items(spark, SF001).select("doc_id", "id", "lang", "dataset", "tags")
    assert scans(items, "documents") == 1 and scans(items, "labels") == 1
    out = prep_queries.q_report_tables(spark, SF001)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "documents" not in plan and "labels" not in plan and "benchmark" not in plan  # only cubes are read
    assert all("/cube-" in f for f in out.inputFiles())
