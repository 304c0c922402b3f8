"""MT reports: system level, per-tag with/without, rescaling, tier gaps (A12, A13,
A20, A23, P17, P18).

Input is the flattened MT frame of :func:`reshape.flatten_mt`:
``(id, lang, model, phenomena, <metric columns>)`` with nulls kept.  ``n``
counts rows, means skip nulls (both are reported).  The first two also take an MT cube (:mod:`cube`).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..config import METRIC_SCALE, MT_DELTA_BAND, MT_METRICS, EvalConfig
from ..functions.tags import has_tag
from .cube import metric_count, metric_mean_of, weight


def system_level(flat: DataFrame, cfg: EvalConfig, metrics: tuple[str, ...] = MT_METRICS) -> DataFrame:
    """(lang, model) -> n rows, scored rows per metric, mean per metric, in
    the order of languages and models in the config."""
    sub = flat.filter(F.col("lang").isin(*(cfg.mt_langs or cfg.lang_codes)))
    aggs = [F.sum(weight(flat)).alias("n")]
    aggs += [metric_count(flat, m).alias(f"n_{m}") for m in metrics]
    aggs += [metric_mean_of(flat, m).alias(m) for m in metrics]
    return sub.groupBy("lang", "model").agg(*aggs).orderBy(cfg.lang_rank("lang"), cfg.model_rank("model").asc_nulls_last(), "model")


def per_tag(flat: DataFrame, cfg: EvalConfig, metrics: tuple[str, ...] = MT_METRICS,
            vocab: str = "required") -> DataFrame:
    """(lang, phenomenon, model): n_with, n_without and, per metric, the
    with / without means and their (unrounded) delta.  Empty side -> null.

    One aggregation pass computes every (phenomenon, metric) pair with
    conditional aggregates; the result is unpivoted to long rows afterwards.
    """
    langs = cfg.mt_langs or cfg.lang_codes
    vocab_all: dict[str, None] = {}
    for s in cfg.langs:
        if s.lang in langs:
            for p in (s.required if vocab == "required" else s.phenomena):
                vocab_all[p] = None
    phs = tuple(vocab_all)
    sub = flat.filter(F.col("lang").isin(*langs))
    aggs, w = [], weight(flat)
    for i, p in enumerate(phs):
        h = has_tag("phenomena", p)
        aggs += [F.sum(F.when(h, w).otherwise(0)).alias(f"nw{i}"), F.sum(F.when(~h, w).otherwise(0)).alias(f"no{i}")]
        for m in metrics:
            aggs += [metric_mean_of(flat, m, h).alias(f"w{i}_{m}"), metric_mean_of(flat, m, ~h).alias(f"o{i}_{m}")]
    g = sub.groupBy("lang", "model").agg(*aggs)
    structs = []
    for i, p in enumerate(phs):
        fields = [F.lit(p).alias("phenomenon"), F.col(f"nw{i}").alias("n_with"), F.col(f"no{i}").alias("n_without")]
        for m in metrics:
            w, o = F.col(f"w{i}_{m}"), F.col(f"o{i}_{m}")
            fields += [w.alias(f"{m}_with"), o.alias(f"{m}_without"), (w - o).alias(f"{m}_delta")]
        structs.append(F.struct(*fields))
    x = g.select("lang", "model", F.inline(F.array(*structs)))
    allowed = cfg.required_of("lang") if vocab == "required" else cfg.phenomena_of("lang")
    return x.filter(F.array_contains(allowed, F.col("phenomenon")))


def rescale_metrics(df: DataFrame, metrics: tuple[str, ...] = MT_METRICS) -> DataFrame:
    """Put every metric on ~0-100 (comet x100, adequacy/fluency x20)."""
    return df.select(*[(F.col(c) * METRIC_SCALE[c]).alias(f"{c}_100") if c in metrics and c in METRIC_SCALE
                       else F.col(c) for c in df.columns])


def flag_mt_delta(delta: Column, band: float = MT_DELTA_BAND) -> Column:
    """P18 (MT): 'drop' below -band, 'gain' above +band, else 'neutral'; null stays null."""
    return (F.when(delta < -band, F.lit("drop")).when(delta > band, F.lit("gain"))
             .when(delta.isNotNull(), F.lit("neutral")))


def tier_gap(system: DataFrame, metric: str = "chrf") -> DataFrame:
    """Per language, each model's score minus the best model's score."""
    w = Window.partitionBy("lang")
    return system.select("lang", "model", F.col(metric),
                         F.max(metric).over(w).alias("best"),
                         (F.col(metric) - F.max(metric).over(w)).alias("gap_to_top"))


def metric_mean(scores: DataFrame, metric: str = "chrf") -> DataFrame:
    """Overall mean of one metric (nulls skipped) and its support."""
    return scores.agg(F.count(metric).alias("n"), F.avg(metric).alias(f"mean_{metric}"))
