"""Invariants of the slices on the driver tables, and empty inputs."""

from pyspark.sql import functions as F

from slicekit.config import FIXTURE
from slicekit.operators import agree as G
from slicekit.operators import chrf as C
from slicekit.operators import mt as M
from slicekit.operators import reshape as R
from slicekit.operators import slices as S
from slicekit.plans import fixtures as fx

SF = "/root/testdata/sf0.01"


def test_with_plus_without_is_overall(spark):
    flat = R.flatten_all(fx.cells(spark, SF), fx.items(spark, SF), FIXTURE)
    long = S.slices_long(flat, FIXTURE).withColumn("k", F.round(F.col("accuracy") * F.col("n") / 100))
    per = long.groupBy("dataset", "phenomenon", "model").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    tot = (flat.filter("condition = 'openbook'").groupBy("dataset", "model")
           .agg(F.count(F.lit(1)).alias("n_all"), F.sum("correct").alias("k_all")))
    bad = per.join(tot, ["dataset", "model"]).filter((F.col("n") != F.col("n_all")) | (F.col("k") != F.col("k_all")))
    assert per.count() > 0 and bad.count() == 0


def test_class_counts_sum_to_n(spark):
    cov = S.coverage(fx.items(spark, SF), FIXTURE)
    para = sum(F.col(f"para_{v}") for v in FIXTURE.paraphrase)
    dom = sum(F.col(f"dom_{v}") for v in FIXTURE.all_domains)
    assert cov.filter((para != F.col("n")) | (dom != F.col("n"))).count() == 0


def test_per_tag_delta_is_with_minus_without(spark):
    from slicekit.plans.mt_reports import mt_flat
    pt = M.per_tag(mt_flat(spark, SF), FIXTURE)
    d = pt.filter(F.abs(F.col("chrf_delta") - (F.col("chrf_with") - F.col("chrf_without"))) > 1e-9)
    assert pt.count() == 36 and d.count() == 0


def test_empty_inputs(spark):
    cells = fx.cells(spark, SF).limit(0)
    items = fx.items(spark, SF).limit(0)
    flat = R.flatten_all(cells, items, FIXTURE)
    assert S.accuracy_by_benchmark(flat, FIXTURE).count() == 0
    assert S.accuracy_by_phenomenon(flat, FIXTURE).count() == 0
    assert S.coverage(items, FIXTURE).count() == 0
    empty_pairs = spark.createDataFrame([], "id string, hyp string, ref string")
    assert C.chrf_sentence(empty_pairs, ["id"]).count() == 0
    mt = spark.createDataFrame([], "id string, lang string, model string, phenomena array<string>, chrf double, "
                                   "comet double, adequacy double, fluency double")
    assert M.system_level(mt, FIXTURE).count() == 0
    assert G.metric_agreement(mt).count() == 0
    # open-vs-closed still lists every configured benchmark x model, at 0.0
    ovc = S.open_vs_closed(flat, FIXTURE, spark)
    assert ovc.count() == len(FIXTURE.datasets) * len(FIXTURE.models)
    assert ovc.agg(F.max("open_acc")).first()[0] == 0.0


def test_unknown_dataset_sorts_last(spark):
    df = spark.createDataFrame([("zz", "openbook", "m0", 1, 0.0), ("de_native", "openbook", "m0", 1, 0.0)],
                               "dataset string, condition string, model string, n long, accuracy_pct double")
    assert [r.dataset for r in S.canonical_order(df, FIXTURE).collect()] == ["de_native", "zz"]


def test_nan_metric_is_skipped_like_pandas(spark):
    items = spark.createDataFrame([("a", "fr", None), ("b", "fr", None)],
                                  "id string, lang string, tags struct<linguistic_phenomena: array<string>>")
    scores = spark.createDataFrame([("a", "m0", 50.0, float("nan"), 4.0, 4.0), ("b", "m0", 70.0, 0.8, 5.0, 5.0)],
                                   "id string, model string, chrf double, comet double, adequacy double, fluency double")
    flat = R.flatten_mt(items, scores, FIXTURE).filter("model = 'm0'")
    row = M.system_level(flat.withColumn("lang", F.lit("fr")), FIXTURE).first()
    assert row.comet == 0.8 and row.n_comet == 1 and row.n == 2 and row.chrf == 60.0


def test_percent_rounding_matches_numpy_everywhere(spark):
    """bround(k/n*100, 1) equals numpy's half-even round of the same double
    for every 0 <= k <= n <= 600 (the published accuracies are such values)."""
    import numpy as np
    grid = (spark.range(1, 601).withColumnRenamed("id", "n")
            .select("n", F.explode(F.sequence(F.lit(0), F.col("n"))).alias("k")))
    got = grid.select("n", "k", S.pct1(F.col("k"), F.col("n")).alias("r")).toPandas()
    exp = np.round(got["k"].to_numpy(dtype="float64") / got["n"].to_numpy(dtype="float64") * 100, 1)
    assert len(got) == 180_900
    assert (got["r"].to_numpy() == exp).all()
