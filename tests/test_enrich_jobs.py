"""Work lists, user functions, merges, prompts, stage store."""

import pytest
from pyspark.sql import functions as F

from slicekit.config import FIXTURE
from slicekit.operators import enrich as E
from slicekit.operators import jobs as J
from slicekit.operators import prep as P
from slicekit.plans import fixtures as fx
from slicekit.sources.checkpoint import StageStore

SF = "/root/testdata/sf0.001"


def test_enrich_isolates_errors_and_rerun_is_idempotent(spark):
    def _fail_odd(rec):  # defined inside the test: pickled by value for the workers
        if int(rec["id"].split("_")[1]) % 2:
            raise RuntimeError("boom")
        return {"prediction": rec["model"] + "!"}

    items = fx.items(spark, SF)
    cells = fx.cells(spark, SF, items).drop("lang", "dataset")
    todo = J.pending_infer(items, cells, FIXTURE)
    n_todo = todo.count()
    assert n_todo > 0
    res = E.enrich_missing(todo, _fail_odd, "prediction string", J.CELL_KEY, parallelism=3)
    merged = J.upsert(cells, res, J.CELL_KEY, ["prediction", "verdict", "reason", "correct"])
    errors = res.filter("status = 'error'").count()
    assert errors > 0
    # only the failed rows are still pending
    again = J.pending_infer(items, merged, FIXTURE)
    assert again.count() == errors
    assert merged.count() == cells.count() + n_todo


def test_retrying_policies():
    # translator: empty replies retry without waiting and end in ''; errors wait 2^k
    replies = iter(["", "", "done"])
    waits = []
    gen = E.retrying(lambda: next(replies), max_tries=5, wait=lambda k: min(60, 2 ** k), accept=bool,
                     wait_on_reject=False, fallback="", sleep=waits.append)
    assert gen() == "done" and waits == []
    assert E.retrying(lambda: "", 5, lambda k: 1, accept=bool, wait_on_reject=False, fallback="",
                      sleep=waits.append)() == "" and waits == []
    errs = iter([RuntimeError("429"), RuntimeError("429"), "ok"])

    def flaky():
        x = next(errs)
        if isinstance(x, Exception):
            raise x
        return x

    assert E.retrying(flaky, 5, lambda k: min(60, 2 ** k), accept=bool, sleep=waits.append)() == "ok"
    assert waits == [1, 2]
    with pytest.raises(ZeroDivisionError):  # the error of the last try propagates
        E.retrying(lambda: 1 / 0, 2, sleep=lambda s: None)()
    # tagger: only ValueError is retried (1.0 + 0.5 k), anything else propagates at once
    tag_waits, calls = [], []

    def tag():
        calls.append(1)
        raise KeyError("x")

    with pytest.raises(KeyError):
        E.retrying(tag, 3, lambda k: 1.0 + 0.5 * k, retry_on=(ValueError,), sleep=tag_waits.append)()
    assert len(calls) == 1
    bad = iter([ValueError("empty"), ValueError("json"), ValueError("json")])

    def tag2():
        raise next(bad)

    with pytest.raises(ValueError):
        E.retrying(tag2, 3, lambda k: 1.0 + 0.5 * k, retry_on=(ValueError,), sleep=tag_waits.append)()
    assert tag_waits == [1.0, 1.5]


def test_score_batches_respects_batch_size(spark):
    df = spark.range(0, 300).selectExpr("id", "cast(id as string) as hyp", "'x' as ref").repartition(2)

    def scorer(pdf):
        import pandas as pd
        return pd.DataFrame({"n": [len(pdf)] * len(pdf)})

    out = E.score_batches(df, scorer, "n long", ["id"], batch_size=64)
    assert out.agg(F.max("n")).first()[0] <= 64
    assert out.count() == 300


def test_render_prompts_substitutes_once(spark):
    df = spark.createDataFrame([("en", "openbook", "what is {question}?", "see {context}")],
                               "lang string, condition string, question string, context string")
    t = {("en", "openbook"): "C: {context} Q: {question} {{literal}}"}
    out = P.render_prompts(df, t).first().prompt
    assert out == "C: see {context} Q: what is {question}? {literal}"
    bad = spark.createDataFrame([("en", "mcq", "q", "c")], "lang string, condition string, question string, context string")
    assert P.render_prompts(bad, t, on_missing="null").first().prompt is None
    with pytest.raises(Exception):
        P.render_prompts(bad, t).collect()


def test_stage_store_versions_and_reset(spark, tmp_path):
    st = StageStore(spark, str(tmp_path / "store"))
    assert st.read("s") is None
    v1 = st.write("s", spark.range(3))
    v2 = st.write("s", spark.range(5))
    assert (v1, v2) == (1, 2) and st.read("s").count() == 5 and st.read("s", 1).count() == 3
    st.reset("s")
    assert st.read("s") is None
    st.write("s", spark.range(7))
    assert st.read("s").count() == 7


def test_verify_spans_semantics(spark):
    df = spark.createDataFrame([("abc def", "def", True), ("abc", "zzz", True), ("abc", "", True),
                                ("abc", "abc", False)], "context string, gold string, span_found boolean")
    got = [(r.span_found, r.gold) for r in P.verify_spans(df).collect()]
    assert got == [(True, "def"), (False, ""), (True, ""), (False, "")]


def test_align_parallel_last_source_wins(spark):
    df = spark.createDataFrame([(1, "user", "first", 0), (1, "user", "second", 2), (1, "assistant", "t", 1),
                                (2, "assistant", "orphan", 1)], "k int, role string, text string, o int")
    out = P.align_parallel(df, "k", "role", "user", "assistant", "o").collect()
    assert [(r.k, r.src_text, r.tgt_text) for r in out] == [(1, "second", "t")]


def test_translate_and_locate_calls_each_function_once_per_row(spark):
    calls = spark.sparkContext.accumulator(0)

    def translate(rec):
        calls.add(1)
        return {"question": rec["text"][:10], "context": rec["text"]}

    def locate(rec):
        return {"gold": rec["context"][2:6], "span_found": True}

    rows = spark.createDataFrame([(f"r{i}", f"text number {i} here") for i in range(50)], "id string, text string")
    out = E.translate_and_locate(rows, translate, locate, "id")
    res = out.collect()
    assert len(res) == 50 and all(r.span_found for r in res)
    out.count()
    assert calls.value == 50  # written once, never recomputed


def test_wave_runner_resumes_only_pending_rows(spark, tmp_path):
    from slicekit.streaming.stages import run_stage_in_waves
    store = StageStore(spark, str(tmp_path / "st"))
    base = spark.createDataFrame([(f"i{k}", f"text {k}", None, None, None) for k in range(40)],
                                 "id string, context string, tag string, status string, error string")
    store.write("t", base)
    calls = spark.sparkContext.accumulator(0)

    def fn(rec):  # first run: rows ending in 7 fail
        calls.add(1)
        if rec["id"].endswith("7"):
            raise RuntimeError("transient")
        return {"tag": rec["context"].upper()}

    work = lambda cur: cur.filter(F.col("tag").isNull()).select("id", "context")
    out = run_stage_in_waves(store, "t", work, fn, "tag string", ["id"], ["tag"], waves=3)
    assert calls.value == 40
    assert out.filter("tag IS NULL").count() == 4 and out.filter("status = 'error'").count() == 4

    def fn2(rec):
        calls.add(1)
        return {"tag": rec["context"].upper()}

    out2 = run_stage_in_waves(store, "t", work, fn2, "tag string", ["id"], ["tag"], waves=3)
    assert calls.value == 44  # only the 4 pending rows were called again
    assert out2.filter("tag IS NULL").count() == 0 and out2.count() == 40
    assert len(store.versions("t")) == 3  # the base + one version per run, nothing overwritten
    assert store.versions("t__results/of=000001") == [1, 2, 3]  # one narrow version per wave
    assert store.read("t__results/of=000001").columns == ["id", "tag", "status", "error"]


def test_a_killed_run_goes_on_from_its_results(spark, tmp_path):
    from slicekit.streaming.stages import run_stage_in_waves
    store = StageStore(spark, str(tmp_path / "st"))
    store.write("t", spark.createDataFrame([(f"i{k}", None, None, None) for k in range(30)],
                                           "id string, tag string, status string, error string"))
    calls = spark.sparkContext.accumulator(0)

    def fn(rec):
        calls.add(1)
        return {"tag": rec["id"]}

    work = lambda cur: cur.filter(F.col("tag").isNull()).select("id")
    real, store.write = store.write, lambda name, df: 1 / 0 if name == "t" else real(name, df)
    with pytest.raises(ZeroDivisionError):  # killed before the merge
        run_stage_in_waves(store, "t", work, fn, "tag string", ["id"], ["tag"], waves=3)
    store.write = real
    out = run_stage_in_waves(store, "t", work, fn, "tag string", ["id"], ["tag"], waves=2)
    assert calls.value == 30 and out.filter("tag = id").count() == 30
