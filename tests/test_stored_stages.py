"""Stage tables bucketed by id, work lists by status, merged items in order, batches sorted by length."""

import pytest
from pyspark.sql import functions as F

from slicekit.config import FIXTURE, PILOT
from slicekit.operators import enrich as E
from slicekit.operators import jobs as J
from slicekit.operators import prep as P
from slicekit.operators import reshape as R
from slicekit.plans import fixtures as fx
from slicekit.session import materialize, scratch_path
from slicekit.sources.buckets import BucketStore

SF = "/root/testdata/sf0.001"
PAYLOAD = ["prediction", "verdict", "reason", "correct"]


@pytest.fixture
def sort_merge(spark):
    keys = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.requireAllClusterKeysForCoPartition",
            "spark.sql.sources.bucketing.autoBucketedScan.enabled")
    old = {k: spark.conf.get(k) for k in keys}
    spark.conf.set(keys[0], "-1")
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


@pytest.fixture
def stored(spark, sort_merge):
    store = BucketStore(spark, scratch_path(spark, "buckets"), buckets=4)
    items = fx.items(spark, SF).select("id", "lang", "dataset", "question", "gold")
    cells = fx.cells(spark, SF).drop("lang", "dataset", "tags")
    store.write("items", items)
    store.write("cells", cells)
    return store, items, cells


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _rows(df):
    return sorted(map(str, df.select(sorted(df.columns)).collect()))


def test_work_list_merge_and_export_plan_no_exchange_on_stored_tables(spark, stored):
    store, items, cells = stored
    todo, nested = store.pending_infer("items", "cells", FIXTURE), store.nested("items", "cells")
    assert "Exchange" not in _plan(todo) and "SortMergeJoin" in _plan(todo)
    assert "Exchange" not in _plan(nested)
    assert _rows(todo) == _rows(J.pending_infer(items, cells, FIXTURE))
    flat = lambda df: _rows(df.select("id", F.to_json("predictions").alias("p")).withColumn("p", F.length("p")))
    assert flat(nested) == flat(R.nest_results(items, cells))

    store.write("earlier", items.filter("lang = 'fr'").withColumn("gold", F.lit("kept")))
    merged = store.merge_existing("items", "earlier", FIXTURE.datasets)
    assert "Exchange" not in _plan(merged)
    assert _rows(merged) == _rows(P.merge_existing(items, items.filter("lang = 'fr'").withColumn("gold", F.lit("kept")), FIXTURE.datasets))


def test_results_alone_are_shuffled_into_the_buckets(spark, stored):
    store, _, cells = stored
    results = materialize(cells.filter("correct IS NULL").select(
        *J.CELL_KEY, "prediction", F.lit("correct").alias("verdict"), F.lit("late").alias("reason"), F.lit(True).alias("correct"),
        "status", "error"), "results")
    merged = J.upsert(store.read("cells"), store.route(results), J.CELL_KEY, PAYLOAD)
    assert _plan(merged).count("Exchange") == 1
    version = store.upsert("cells", results, J.CELL_KEY, PAYLOAD)
    assert version == 2 and store.read("cells").filter("correct IS NULL").count() == 0
    assert _rows(store.read("cells")) == _rows(J.upsert(cells, results, J.CELL_KEY, PAYLOAD).select(cells.columns))
    assert store.read("cells", 1).filter("correct IS NULL").count() == results.count()  # the old version is as it was

    # another session's store finds the buckets again
    again = BucketStore(spark, store.store.root, buckets=4)
    assert "Exchange" not in _plan(again.nested("items", "cells"))
    assert _rows(again.read("cells")) == _rows(store.read("cells"))
    with pytest.raises(ValueError):
        again.read("nothing")


def _tables(spark, path, n):
    docs = [(i, f"q{i} a{i} and more", ("de", "en", "es", "fr")[i % 4], f"src{i % 5}", 20) for i in range(n)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(0, n, 3)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


def test_buckets_grow_with_the_tables_so_that_a_task_does_not(spark, sort_merge, tmp_path, monkeypatch):
    from slicekit.plans import state_queries as SQ
    from slicekit.sources import buckets as B
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    monkeypatch.setattr(B, "BUCKET_ROWS", 100)
    largest = []
    for n in (200, 800):
        at = _tables(spark, tmp_path / str(n), n)
        store = SQ._stored(spark, at)
        assert store.buckets == n * 8 // 100
        jobs = J.expand_jobs(store.read("items"), FIXTURE)
        largest.append(max(r.n for r in jobs.groupBy(F.spark_partition_id()).agg(F.count("id").alias("n")).collect()))
        todo = store.pending_infer("items", "cells", FIXTURE, "status")
        assert "Exchange" not in _plan(todo)
        want = J.pending_infer(fx.items(spark, at), fx.cells(spark, at), FIXTURE, "status")
        assert want.count() and _rows(todo.select(*J.CELL_KEY)) == _rows(want.select(*J.CELL_KEY))
    assert largest[1] < 2 * largest[0]  # four times the items

    # texts count too; few rows stay at the session's partitions, also where there is none
    long = spark.createDataFrame([(str(i), "x" * 1000) for i in range(50)], "id string, text string")
    assert B.bucket_count(long) == B.bucket_count(long.limit(0)) == least
    monkeypatch.setattr(B, "BUCKET_BYTES", 1000)
    assert B.bucket_count(long.limit(0), long) == 51


def test_stored_tables_are_not_broadcast_for_being_small_on_disk(spark, sort_merge, tmp_path):
    from slicekit.plans import prep_queries
    from slicekit.plans import state_queries as SQ
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1g")  # the fixture sets it back
    at = _tables(spark, tmp_path / "t", 200)
    store = SQ._stored(spark, at)
    fresh, existing = prep_queries._fresh_existing(spark, at)
    store.write("fresh", fresh)
    store.write("existing", existing)
    for df in (store.pending_infer("items", "cells", FIXTURE, "status"), store.nested("items", "cells"),
               store.merge_existing("fresh", "existing", FIXTURE.datasets)):
        assert "Broadcast" not in _plan(df) and "Exchange" not in _plan(df) and "SortMergeJoin" in _plan(df)


def test_an_answer_without_a_value_is_not_asked_for_again(spark):
    items = spark.createDataFrame([("a", "de", "de_native", None, "ok"), ("b", "de", "de_native", None, "error"), ("c", "de", "de_native", None, None)],
                                  "id string, lang string, dataset string, tags string, status string")
    assert [r.id for r in J.pending_tag(items, "status").collect()] == ["b", "c"]
    assert J.pending_tag(items).count() == 3
    cells = spark.createDataFrame([("a", "m0", "openbook", "de_native", None, None, "ok"), ("b", "m0", "openbook", "de_native", None, None, "error"),
                                   ("c", "m0", "openbook", "de_native", "x", None, "ok"), ("d", "m0", "openbook", "de_native", "x", None, "error")],
                                  "id string, model string, condition string, dataset string, prediction string, verdict string, status string")
    todo = {(r.id, r.model, r.condition) for r in J.pending_infer(items, cells, FIXTURE, "status").collect()}
    assert ("a", "m0", "openbook") not in todo and ("b", "m0", "openbook") in todo and ("c", "m0", "openbook") not in todo
    assert ("a", "m0", "openbook") in {(r.id, r.model, r.condition) for r in J.pending_infer(items, cells, FIXTURE).collect()}
    assert [r.id for r in J.pending_judge(cells, None, "status").collect()] == ["d"]
    assert [r.id for r in J.pending_judge(cells).collect()] == ["c", "d"]
    done = spark.createDataFrame([("a", "m0", None, "ok"), ("a", "m1", None, "error")], "id string, model string, hyp string, status string")
    left = {(r.id, r.model) for r in J.pending_translate(items.limit(1), done, FIXTURE, "status").collect()}
    assert left == {("a", "m1"), ("a", "m2"), ("a", "m3")}


def test_merged_items_keep_their_order(spark):
    cols = "id string, dataset string, gold string, n int"
    fresh = spark.createDataFrame([("b", "x", "new", 10), ("a", "x", "new", 20), ("f", "x", "new", 5)], cols)
    old = spark.createDataFrame([("z", "x", "1", 1), ("a", "x", "2", 9), ("c", "x", "9", 7), ("c", "x", "8", 3), ("y", "no", "1", 1)], cols)
    got = P.merge_existing(fresh, old, ["x"], order="n", position="n").collect()
    assert [(r.n, r.id, r.gold) for r in sorted(got, key=lambda r: r.n)] == [
        (1, "f", "new"), (2, "b", "new"), (3, "a", "2"), (4, "z", "1"), (5, "c", "9")]
    assert P.merge_existing(fresh.limit(0), old.limit(0), ["x"], position="n").count() == 0


def test_batches_by_length_pad_less_and_keep_the_mean(spark):
    rows = [(i, "x" * (1 + i * 37 % 400)) for i in range(500)] + [(500, None), (501, "y" * 5000)]
    work = spark.createDataFrame(rows, "id int, hyp string").repartition(3)

    def scorer(pdf):
        import pandas as pd
        n = pdf["hyp"].fillna("").str.len()
        return pd.DataFrame({"score": n.astype("float64"), "padded": [int(n.max())] * len(pdf), "n": [len(pdf)] * len(pdf)})

    out = "score double, padded long, n long"
    plain = E.score_batches(work, scorer, out, ["id"], 32)
    by_length, seen = E.observe_mean(E.score_batches(work, scorer, out, ["id"], 32, F.length("hyp"), 4096), "score")
    got = by_length.collect()
    padding = lambda rows: sum(r.padded - r.score for r in rows)
    assert padding(got) * 4 < padding(plain.collect())
    assert all(r.n <= 32 and (r.n == 1 or r.n * r.padded <= 4096) for r in got)
    assert sorted((r.id, r.score) for r in got) == sorted((i, float(len(t or ""))) for i, t in rows)
    assert seen.get == {"mean": sum(len(t or "") for _, t in rows) / 502, "n": 502, "failed": 0}


def test_dataset_labels(spark):
    df = spark.createDataFrame([("squad_id",), ("tydiqa_sw",), ("other",), (None,)], "dataset string")
    assert [r[0] for r in df.select(PILOT.dataset_label("dataset")).collect()] == [
        "SQuAD-ID (Gemini translated)", "TyDi QA Swahili (native)", "other", None]
