"""Cross-report comparisons."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import CLOSEDBOOK, OPENBOOK, EvalConfig
from ..functions.tags import has_tag


def span_rate(rows: DataFrame, col: str = "span_found") -> DataFrame:
    """Share of verified spans in percent, denominator max(1, n)."""
    return rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.coalesce(F.col(col), F.lit(False))).alias("n_found")) \
        .select("n", "n_found", (F.col("n_found") * 100.0 / F.greatest(F.lit(1), F.col("n"))).alias("span_rate_pct"))


def cross_task(flat_qa: DataFrame, flat_mt: DataFrame, cfg: EvalConfig, min_n_qa: int = 5,
               condition: str = OPENBOOK, metric: str = "chrf") -> DataFrame:
    """Per (lang, phenomenon, model): QA accuracy on items *with* the tag
    (native dataset, open book) next to the MT mean of the metric on items with
    the tag.  Only pairs with ``n_qa >= min_n_qa`` and a non-null MT mean.

    ``flat_qa`` should come from the raw cells (audited gold errors are *not*
    excluded here, as in the studied analysis).  Both sides are aggregated
    first (a few rows per language) and then joined.
    """
    langs = [s for s in cfg.langs if s.lang in (cfg.mt_langs or cfg.lang_codes)]
    phs = list(dict.fromkeys(p for s in langs for p in s.required))
    qa = flat_qa.filter((F.col("condition") == condition) & (F.col("dataset") == cfg.native_dataset("lang")))
    qa_aggs = []
    for i, p in enumerate(phs):
        h = has_tag("phenomena", p)
        qa_aggs += [F.count_if(h).alias(f"n{i}"), F.sum(F.when(h, F.col("correct"))).alias(f"k{i}")]
    qg = qa.groupBy("lang", "model").agg(*qa_aggs)
    qa_long = qg.select("lang", "model", F.inline(F.array(*[
        F.struct(F.lit(p).alias("phenomenon"), F.col(f"n{i}").alias("n_qa"), F.col(f"k{i}").alias("k_qa"))
        for i, p in enumerate(phs)])))
    mt_aggs = []
    for i, p in enumerate(phs):
        h = has_tag("phenomena", p)
        mt_aggs += [F.count_if(h).alias(f"n{i}"), F.avg(F.when(h, F.col(metric))).alias(f"m{i}")]
    mg = flat_mt.groupBy("lang", "model").agg(*mt_aggs)
    mt_long = mg.select("lang", "model", F.inline(F.array(*[
        F.struct(F.lit(p).alias("phenomenon"), F.col(f"n{i}").alias("n_mt"), F.col(f"m{i}").alias("mt_mean"))
        for i, p in enumerate(phs)])))
    j = qa_long.join(mt_long, ["lang", "model", "phenomenon"])
    j = j.filter(F.array_contains(cfg.required_of("lang"), F.col("phenomenon")))
    return j.filter((F.col("n_qa") >= min_n_qa) & F.col("mt_mean").isNotNull()).select(
        "lang", "phenomenon", "model", (F.col("k_qa").cast("double") * 100 / F.col("n_qa")).alias("qa_acc"),
        F.col("mt_mean").alias(f"mt_{metric}"), F.col("n_qa").cast("bigint").alias("n_qa"),
        F.col("n_mt").cast("bigint").alias("n_mt"))


def gold_audit(cells: DataFrame, cfg: EvalConfig, condition: str = OPENBOOK) -> DataFrame:
    """Items on which *every* configured model has a verdict and all of
    them disagree with the gold answer -- candidates for gold errors."""
    c = cells.filter((F.col("condition") == condition) & F.col("model").isin(*cfg.models)
                     & F.col("correct").isNotNull())
    g = c.groupBy("id").agg(F.count(F.lit(1)).alias("n_models"),  # one cell for each model
                            F.bool_and(~F.col("correct")).alias("all_wrong"),
                            F.first("dataset").alias("dataset"))
    return g.filter((F.col("n_models") == len(cfg.models)) & F.col("all_wrong")).select("id", "dataset", "n_models")


def local_share(cov: DataFrame, cfg: EvalConfig, general: str = "general") -> DataFrame:
    """Share (%) of items in a non-general domain, native vs translated."""
    local_cols = [f"dom_{d}" for d in cfg.all_domains if d != general]
    local = sum((F.coalesce(F.col(c), F.lit(0)) for c in local_cols), F.lit(0))  # null: another language's domain
    x = cov.select("lang", cfg.dataset_role("dataset").alias("role"),
                   (local.cast("double") * 100 / F.col("n")).alias("pct"))
    g = x.groupBy("lang").agg(F.max(F.when(F.col("role") == "native", F.col("pct"))).alias("native_pct"),
                              F.max(F.when(F.col("role") == "translated", F.col("pct"))).alias("translated_pct"))
    return g.filter(F.col("native_pct").isNotNull() & F.col("translated_pct").isNotNull()) \
            .withColumn("delta_pp", F.col("translated_pct") - F.col("native_pct"))


def closed_book_gap(flat: DataFrame, cfg: EvalConfig) -> DataFrame:
    """Closed-book accuracy native vs translated per (lang, model)."""
    role = cfg.dataset_role("dataset")
    c = flat.filter(F.col("condition") == CLOSEDBOOK).withColumn("role", role)
    nat, tr = F.col("role") == "native", F.col("role") == "translated"
    g = c.groupBy("lang", "model").agg(
        F.count_if(nat).alias("n_native"), F.sum(F.when(nat, F.col("correct"))).alias("k_native"),
        F.count_if(tr).alias("n_translated"), F.sum(F.when(tr, F.col("correct"))).alias("k_translated"))
    na = F.try_divide(F.col("k_native").cast("double"), F.col("n_native").cast("double")) * 100
    ta = F.try_divide(F.col("k_translated").cast("double"), F.col("n_translated").cast("double")) * 100
    return g.select("lang", "model", na.alias("native_acc"), ta.alias("translated_acc"),
                    (ta - na).alias("delta_pp"))


def inference_gap(flat: DataFrame, condition: str = OPENBOOK, high: str = "literal_match",
                  low: str = "requires_inference") -> DataFrame:
    """Open-book accuracy on literal-match items minus requires-inference items."""
    c = flat.filter(F.col("condition") == condition)
    hi, lo = F.col("paraphrase_distance") == high, F.col("paraphrase_distance") == low
    g = c.groupBy("lang", "dataset", "model").agg(
        F.count_if(hi).alias("n_literal"), F.sum(F.when(hi, F.col("correct"))).alias("k_literal"),
        F.count_if(lo).alias("n_inference"), F.sum(F.when(lo, F.col("correct"))).alias("k_inference"))
    la = F.try_divide(F.col("k_literal").cast("double"), F.col("n_literal").cast("double")) * 100
    ia = F.try_divide(F.col("k_inference").cast("double"), F.col("n_inference").cast("double")) * 100
    return g.select("lang", "dataset", "model", la.alias("literal_acc"), ia.alias("inference_acc"),
                    (ia - la).alias("gap_pp"), F.col("n_literal").cast("bigint").alias("n_literal"),
                    F.col("n_inference").cast("bigint").alias("n_inference"))


def hardest_feature(deltas: DataFrame, task: str, delta_col: str = "delta", min_support: int = 1) -> DataFrame:
    """Per language, the phenomenon with the lowest mean delta across
    models (both slices need ``min_support`` rows); ties -> alphabetical."""
    d = deltas.filter((F.col("n_with") >= min_support) & (F.col("n_without") >= min_support)
                      & F.col(delta_col).isNotNull())
    per_ph = d.groupBy("lang", "phenomenon").agg(F.avg(delta_col).alias("mean_delta"),
                                                 F.min(delta_col).alias("min_delta"),
                                                 F.max(delta_col).alias("max_delta"),
                                                 F.count(F.lit(1)).alias("n_models"))
    best = per_ph.groupBy("lang").agg(F.min(F.struct("mean_delta", "phenomenon", "min_delta", "max_delta",
                                                     "n_models")).alias("b"))
    return best.select("lang", F.lit(task).alias("task"), "b.phenomenon", "b.mean_delta", "b.min_delta",
                       "b.max_delta", F.col("b.n_models").cast("bigint").alias("n_models"))
