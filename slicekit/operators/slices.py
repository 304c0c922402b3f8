"""Accuracy and coverage slices.

Design: each report is ONE grouped aggregation with conditional aggregates
(``sum(when ...)``), never one scan per (model, condition, tag).  Group keys
are low-cardinality (dataset x condition x model), so partial (map-side)
aggregation collapses every partition before the shuffle and a hot key
(one language holding a third of all rows) costs nothing extra.

Where only counts matter a report takes a cube (:mod:`cube`) as well as rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..config import CLOSEDBOOK, OPENBOOK, QA_ALERT_PP, EvalConfig
from ..functions.tags import has_tag, qa_phenomena
from .cube import right, weight


def pct(k: Column, n: Column) -> Column:
    """``mean * 100`` the way pandas computes it (k/n first), null for n = 0."""
    return F.try_divide(k.cast("double"), n.cast("double")) * 100


def pct_of(k: Column, n: Column) -> Column:
    """``100.0 * k / n`` (the order some reports use; differs from ``pct`` in
    the last bit for some k, n), null for n = 0."""
    return F.try_divide(k.cast("double") * 100, n.cast("double"))


def pct1(k: Column, n: Column) -> Column:
    """Percent rounded half-even to one decimal (numpy/pandas ``round(1)``)."""
    return F.bround(pct(k, n), 1)


# ---------------------------------------------------------------------------
# A1 + O1
# ---------------------------------------------------------------------------
def accuracy_by_benchmark(flat: DataFrame, cfg: EvalConfig, ordered: bool = True) -> DataFrame:
    """(dataset, condition, model) -> n, accuracy % (1 decimal), canonical order."""
    agg = flat.groupBy("dataset", "condition", "model").agg(
        F.sum(weight(flat)).alias("n"), F.sum(right(flat)).alias("k"))
    out = agg.select("dataset", "condition", "model", "n",
                     pct1(F.col("k"), F.col("n")).alias("accuracy_pct"))
    return canonical_order(out, cfg) if ordered else out


def canonical_order(df: DataFrame, cfg: EvalConfig) -> DataFrame:
    """O1: config rank of the dataset (unknown last), then condition, model."""
    return df.orderBy(cfg.dataset_rank("dataset").asc_nulls_last(), "condition", "model")


def present_langs(df: DataFrame, cfg: EvalConfig) -> DataFrame:
    """O2: configured languages that have rows, in config order."""
    present = df.select("lang").filter(F.col("lang").isin(*cfg.lang_codes)).distinct()
    return present.select("lang", cfg.lang_rank("lang").alias("lang_ord")).orderBy("lang_ord")


# ---------------------------------------------------------------------------
# A2 / A3 / A4: coverage of tags
# ---------------------------------------------------------------------------
def coverage(items: DataFrame, cfg: EvalConfig) -> DataFrame:
    """Per (lang, dataset), tagged items only: n, count per phenomenon, none,
    per paraphrase class, per domain.  Vocabulary from config so zero counts
    appear; what only other languages have is null.  A dataset without tagged
    items yields no row."""
    tagged = items.filter(F.col("tags").isNotNull() & F.col("lang").isin(*cfg.lang_codes))
    ph, w = qa_phenomena("tags"), weight(items)
    held = lambda c: F.sum(F.when(c, w).otherwise(0))
    aggs = [F.sum(w).alias("n")]
    aggs += [held(has_tag(ph, p)).alias(f"ph_{p}") for p in cfg.all_phenomena]
    aggs.append(held(F.size(ph) == 0).alias("none"))
    aggs += [held(F.col("tags.paraphrase_distance") == v).alias(f"para_{v}") for v in cfg.paraphrase]
    aggs += [held(F.col("tags.domain") == v).alias(f"dom_{v}") for v in cfg.all_domains]
    out = tagged.groupBy("lang", "dataset").agg(*aggs)
    # keep only the configured (lang, dataset) pairs
    ok = F.lit(False)
    for lang, dataset, _ in cfg.benchmarks:
        ok = ok | ((F.col("lang") == lang) & (F.col("dataset") == dataset))
    own = {f"ph_{p}": [s.lang for s in cfg.langs if p in s.phenomena] for p in cfg.all_phenomena}
    own |= {f"dom_{d}": [s.lang for s in cfg.langs if d in s.domains] for d in cfg.all_domains}
    return out.filter(ok).select(*[F.when(F.col("lang").isin(own[c]), F.col(c)).alias(c) if c in own else F.col(c)
                                   for c in out.columns])


def coverage_pct(cov: DataFrame, cfg: EvalConfig) -> DataFrame:
    """A3: coverage as long (lang, dataset, facet, value, count, n, pct)."""
    cols = ([("phenomenon", p, f"ph_{p}") for p in cfg.all_phenomena] + [("phenomenon", "none", "none")]
            + [("paraphrase", v, f"para_{v}") for v in cfg.paraphrase]
            + [("domain", v, f"dom_{v}") for v in cfg.all_domains])
    arr = F.array(*[F.struct(F.lit(f).alias("facet"), F.lit(v).alias("value"), F.col(c).alias("count"))
                    for f, v, c in cols])
    x = cov.select("lang", "dataset", "n", F.inline(arr))
    # a phenomenon or domain outside the language's vocabulary is not reported
    vocabulary = F.when(F.col("facet") == "phenomenon", cfg.phenomena_of("lang")).otherwise(cfg.domains_of("lang"))
    x = x.filter((F.col("facet") == "paraphrase") | (F.col("value") == "none") | F.array_contains(vocabulary, F.col("value")))
    return x.select("lang", "dataset", "facet", "value", "count", "n",
                    (F.col("count").cast("double") * 100 / F.col("n")).alias("pct"))


def tagged_counts(items: DataFrame, cfg: EvalConfig, spark: SparkSession) -> DataFrame:
    """A4: tagged items per configured benchmark, zero when absent."""
    bench = spark.createDataFrame([(lang, d, i) for i, (lang, d, _) in enumerate(cfg.benchmarks)],
                                  "lang string, dataset string, ord int")
    cnt = (items.filter(F.col("tags").isNotNull()).groupBy("lang", "dataset")
           .agg(F.sum(weight(items)).alias("n_tagged")))
    # the benchmark list is config-sized: the join is planned as a broadcast
    return (F.broadcast(bench).join(cnt, ["lang", "dataset"], "left")
            .select("lang", "dataset", F.coalesce("n_tagged", F.lit(0)).alias("n_tagged"), "ord")
            .orderBy("ord").drop("ord"))


# ---------------------------------------------------------------------------
# Accuracy with vs without each phenomenon
# ---------------------------------------------------------------------------
def _phenomenon_counts(flat: DataFrame, cfg: EvalConfig, condition: str) -> DataFrame:
    """One pass: per (lang, dataset, model) the with/without counts and hits of
    every vocabulary tag, then unpivot to (..., phenomenon) rows."""
    sub = flat.filter(F.col("condition") == condition)
    aggs, w, k = [], weight(flat), right(flat)
    for p in cfg.all_phenomena:
        h = has_tag("phenomena", p)
        aggs += [F.sum(F.when(h, w).otherwise(0)).alias(f"nw_{p}"), F.sum(F.when(h, k)).alias(f"kw_{p}"),
                 F.sum(F.when(~h, w).otherwise(0)).alias(f"no_{p}"), F.sum(F.when(~h, k)).alias(f"ko_{p}")]
    g = sub.groupBy("lang", "dataset", "model").agg(*aggs)
    arr = F.array(*[F.struct(F.lit(p).alias("phenomenon"), F.col(f"nw_{p}").alias("n_with"),
                             F.col(f"kw_{p}").alias("k_with"), F.col(f"no_{p}").alias("n_without"),
                             F.col(f"ko_{p}").alias("k_without")) for p in cfg.all_phenomena])
    x = g.select("lang", "dataset", "model", F.inline(arr))
    return x.filter(F.array_contains(cfg.phenomena_of("lang"), F.col("phenomenon")))


def accuracy_by_phenomenon(flat: DataFrame, cfg: EvalConfig, condition: str = OPENBOOK,
                           min_support: int = 0) -> DataFrame:
    """A5: per (dataset, phenomenon, model) with/without accuracy and delta.

    A phenomenon gets a table only if both sides exist in the dataset; delta is
    the difference of the *rounded* accuracies, rounded again.
    """
    x = _phenomenon_counts(flat, cfg, condition)
    w = Window.partitionBy("dataset", "phenomenon")
    x = (x.withColumn("_tw", F.sum("n_with").over(w)).withColumn("_tn", F.sum("n_without").over(w))
          .filter((F.col("_tw") > 0) & (F.col("_tn") > 0)))
    aw = pct1(F.col("k_with"), F.col("n_with"))
    ao = pct1(F.col("k_without"), F.col("n_without"))
    x = x.select("lang", "dataset", "phenomenon", "model",
                 F.col("n_with").cast("bigint").alias("n_with"),
                 F.col("n_without").cast("bigint").alias("n_without"),
                 aw.alias("acc_with"), ao.alias("acc_without"))
    x = x.withColumn("delta", F.bround(F.col("acc_with") - F.col("acc_without"), 1))
    if min_support:
        x = x.filter((F.col("n_with") >= min_support) & (F.col("n_without") >= min_support))
    return x


def slices_long(flat: DataFrame, cfg: EvalConfig, condition: str = OPENBOOK) -> DataFrame:
    """Long (dataset, phenomenon, slice, model, accuracy, n); a side with
    no rows has no row."""
    x = _phenomenon_counts(flat, cfg, condition)
    sides = F.array(
        F.struct(F.lit("with").alias("slice"), F.col("n_with").alias("n"), F.col("k_with").alias("k")),
        F.struct(F.lit("without").alias("slice"), F.col("n_without").alias("n"), F.col("k_without").alias("k")))
    y = x.select("lang", "dataset", "phenomenon", "model", F.inline(sides)).filter(F.col("n") > 0)
    return y.select("lang", "dataset", "phenomenon", "slice", "model",
                    pct(F.col("k"), F.col("n")).alias("accuracy"), F.col("n").cast("bigint").alias("n"))


# ---------------------------------------------------------------------------
# By paraphrase class and by domain
# ---------------------------------------------------------------------------
def accuracy_by_category(flat: DataFrame, category: str, condition: str = OPENBOOK) -> DataFrame:
    """Open-book accuracy per (dataset, model, category); null class dropped."""
    sub = flat.filter((F.col("condition") == condition) & F.col(category).isNotNull())
    g = sub.groupBy("lang", "dataset", "model", F.col(category).alias("category")).agg(
        F.sum(weight(flat)).alias("n"), F.sum(right(flat)).alias("k"))
    return g.select("lang", "dataset", "model", "category", "n", pct1(F.col("k"), F.col("n")).alias("accuracy"))


def accuracy_by_paraphrase(flat: DataFrame, condition: str = OPENBOOK) -> DataFrame:
    return accuracy_by_category(flat, "paraphrase_distance", condition)


def accuracy_by_domain(flat: DataFrame, condition: str = OPENBOOK) -> DataFrame:
    return accuracy_by_category(flat, "domain", condition)


# ---------------------------------------------------------------------------
# Open vs closed book
# ---------------------------------------------------------------------------
def _bench_model_grid(spark: SparkSession, cfg: EvalConfig, native_only: bool = False) -> DataFrame:
    rows = [(lang, d, m, i, j) for i, (lang, d, role) in enumerate(cfg.benchmarks) if role == "native" or not native_only
            for j, m in enumerate(cfg.models)]
    return spark.createDataFrame(rows, "lang string, dataset string, model string, bench_ord int, model_ord int")


def _open_closed(flat: DataFrame) -> DataFrame:
    o, c = F.col("condition") == OPENBOOK, F.col("condition") == CLOSEDBOOK
    w, k = weight(flat), right(flat)
    return flat.groupBy("lang", "dataset", "model").agg(
        F.sum(F.when(o, w).otherwise(0)).alias("n_open"), F.sum(F.when(o, k)).alias("k_open"),
        F.sum(F.when(c, w).otherwise(0)).alias("n_closed"), F.sum(F.when(c, k)).alias("k_closed"))


def open_vs_closed(flat: DataFrame, cfg: EvalConfig, spark: SparkSession) -> DataFrame:
    """Each configured benchmark x model, open and closed accuracy; missing = 0.0."""
    g = _open_closed(flat)
    grid = _bench_model_grid(spark, cfg)
    j = F.broadcast(grid).join(g, ["lang", "dataset", "model"], "left")
    return j.select("lang", "dataset", "model",
                    F.coalesce(pct_of(F.col("k_open"), F.col("n_open")), F.lit(0.0)).alias("open_acc"),
                    F.coalesce(pct_of(F.col("k_closed"), F.col("n_closed")), F.lit(0.0)).alias("closed_acc"),
                    F.coalesce("n_open", F.lit(0)).cast("bigint").alias("n_open"),
                    F.coalesce("n_closed", F.lit(0)).cast("bigint").alias("n_closed"),
                    "bench_ord", "model_ord").orderBy("bench_ord", "model_ord").drop("bench_ord", "model_ord")


def disentangle(flat: DataFrame, cfg: EvalConfig, spark: SparkSession) -> DataFrame:
    """Native dataset only, closed - open in pp per (lang, model), alert at <= -30."""
    native = flat.filter(F.col("dataset") == cfg.native_dataset("lang"))
    # one pass: the languages with rows come from the aggregate, each with the full list of models
    g = _open_closed(native).groupBy("lang", "dataset").agg(
        F.map_from_entries(F.collect_list(F.struct("model", F.struct("n_open", "k_open", "n_closed", "k_closed")))).alias("by"))
    j = g.select("lang", "dataset", "by", F.explode(F.array(*map(F.lit, cfg.models))).alias("model")) \
        .withColumn("s", F.try_element_at("by", F.col("model"))).select("lang", "dataset", "model", "s.*")
    o = F.coalesce(pct_of(F.col("k_open"), F.col("n_open")), F.lit(0.0))
    c = F.coalesce(pct_of(F.col("k_closed"), F.col("n_closed")), F.lit(0.0))
    return j.select("lang", "model", F.coalesce("n_open", F.lit(0)).cast("bigint").alias("n"),
                    o.alias("open_acc"), c.alias("closed_acc"), (c - o).alias("delta_pp"),
                    flag_qa_delta(c - o).alias("alert"))


def flag_qa_delta(delta: Column) -> Column:
    """P18 (QA): alert when the closed-book drop is 30 pp or more."""
    return delta <= F.lit(QA_ALERT_PP)


# ---------------------------------------------------------------------------
# Native vs translated mix
# ---------------------------------------------------------------------------
def _role_shares(cov_long: DataFrame, cfg: EvalConfig, facet: str) -> DataFrame:
    x = cov_long.filter(F.col("facet") == facet).withColumn("role", cfg.dataset_role("dataset"))
    g = x.groupBy("lang", "value").agg(
        F.max(F.when(F.col("role") == "native", F.col("pct"))).alias("native_pct"),
        F.max(F.when(F.col("role") == "translated", F.col("pct"))).alias("translated_pct"))
    return g.filter(F.col("native_pct").isNotNull() & F.col("translated_pct").isNotNull())


def paraphrase_mix(cov_long: DataFrame, cfg: EvalConfig) -> DataFrame:
    """A10: paraphrase-class share native vs translated; languages missing a side are skipped."""
    return _role_shares(cov_long, cfg, "paraphrase").withColumnRenamed("value", "paraphrase_distance")


def phenomenon_mix(cov_long: DataFrame, cfg: EvalConfig) -> DataFrame:
    """Phenomenon share native vs translated (vocabulary tags only)."""
    x = _role_shares(cov_long, cfg, "phenomenon").filter(F.col("value") != "none")
    return x.withColumnRenamed("value", "phenomenon")


# ---------------------------------------------------------------------------
# A15 / A16
# ---------------------------------------------------------------------------
def prepared_counts(items: DataFrame) -> DataFrame:
    """Items by (lang, dataset) plus a per-language total (dataset null)."""
    return items.rollup("lang", "dataset").agg(F.count(F.lit(1)).alias("n")).filter(F.col("lang").isNotNull())


def inspection_counts(items: DataFrame, cells: DataFrame, cfg: EvalConfig, phenomenon: str,
                      condition: str = OPENBOOK) -> DataFrame:
    """Per language, items with ``phenomenon`` where >= 1 model was wrong
    (native dataset) and where >= 1 model was right (translated dataset).
    With denormalised cells only languages that have such cells are listed."""
    c = cells.filter((F.col("condition") == condition) & F.col("model").isin(*cfg.models))
    counts = (F.count_if(F.col("correct") == F.lit(False)).alias("n_wrong"),
              F.count_if(F.col("correct") == F.lit(True)).alias("n_correct"))
    if all(k in cells.columns for k in ("lang", "dataset", "tags")):  # stored denormalised: filtered first, no join
        j = (c.filter(has_tag(qa_phenomena("tags"), phenomenon)).groupBy("id", "lang", "dataset").agg(*counts)
             .withColumn("role", cfg.dataset_role("dataset")))
        return _inspected(j)
    per_item = c.groupBy("id").agg(*counts)
    it = items.filter(has_tag(qa_phenomena("tags"), phenomenon)).select("id", "lang", "dataset")
    return _inspected(it.join(per_item, "id", "left").withColumn("role", cfg.dataset_role("dataset")))


def _inspected(j: DataFrame) -> DataFrame:
    return j.groupBy("lang").agg(
        F.count_if((F.col("role") == "native") & (F.col("n_wrong") > 0)).alias("native_wrong"),
        F.count_if((F.col("role") == "translated") & (F.col("n_correct") > 0)).alias("translated_correct"))
