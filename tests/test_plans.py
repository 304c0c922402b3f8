"""The physical-plan properties the scale design relies on."""

from pyspark.sql import functions as F

from __spark_entry__ import queries
from slicekit.operators import chrf as C

SF = "/root/testdata/sf0.01"


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_chrf_shuffles_texts_once_never_ngrams(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    pairs = d.select("doc_id", F.col("text").alias("ref"), F.col("text").alias("hyp"))
    p = _plan(C.chrf_sentence(pairs, ["doc_id"]))
    assert p.count("Exchange hashpartitioning") == 1
    assert p.index("Exchange hashpartitioning") > p.index("HashAggregate")  # the exchange sits below every aggregate
    assert "Generate" in p.split("Exchange hashpartitioning")[0]  # n-grams are generated after the exchange


def test_expand_jobs_has_no_join_or_exchange(spark):
    p = _plan(queries()["expand_jobs"](spark, SF))
    for bad in ("CartesianProduct", "NestedLoopJoin", "Exchange hashpartitioning"):
        assert bad not in p


def test_first_n_per_group_is_bounded_before_the_shuffle(spark):
    for name in ("seeded_sample", "quota_sample"):
        assert "WindowGroupLimit" in _plan(queries()[name](spark, SF)), name


def test_flagship_aggregates_without_a_join(spark):
    p = _plan(queries()["accuracy_by_benchmark"](spark, SF))
    assert "Join" not in p
    assert p.count("HashAggregate") >= 2  # partial + final


def test_filters_reach_the_scan(spark):
    p = _plan(queries()["filter_id_prefix"](spark, SF))
    assert "StringStartsWith(url,https://)" in p
    p = _plan(queries()["read_corpus"](spark, SF))
    assert "EqualTo(lang,de)" in p and "GreaterThan(n_chars,1000)" in p


def test_reports_without_tags_plan_no_join_and_one_scan(spark):
    for name in ("accuracy_by_benchmark", "panel_pivot", "disentangle", "panel_key", "present_langs"):
        p = _plan(queries()[name](spark, SF))
        assert "Join" not in p and p.count("FileScan") == 1, name
    p = _plan(queries()["inspection_counts"](spark, SF))
    assert p.count("Join") == 1 and p.count("FileScan") == 2  # documents with labels, for the tags; cells by their own tags
