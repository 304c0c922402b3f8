"""Reshape operators (R1-R10): nested <-> long, long -> pivots.

The long ``cells`` table (one row per item x model x condition) is the core
form; every slice is then one grouped aggregation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import EvalConfig
from ..functions.tags import mt_phenomena, qa_phenomena


# ---------------------------------------------------------------------------
# Flatten QA results
# ---------------------------------------------------------------------------
def flatten_qa(cells: DataFrame, items: DataFrame | None, cfg: EvalConfig, lang: str | None = None,
               exclude_ids: tuple[str, ...] | None = None) -> DataFrame:
    """One row per judged (item, model, condition): correct as 0/1 plus the
    item's tags (missing tags -> empty phenomenon list, null classes).

    Only configured models; cells without a verdict are dropped.  If ``cells``
    already carries ``lang, dataset, tags`` (denormalised when the stage
    table was written -- the layout to use at scale), no join is planned and
    ``items`` may be None.  Otherwise the join to ``items`` is an equi-join on
    the unique item id (no key skew possible; AQE broadcasts a small side).
    """
    c = cells.filter(F.col("correct").isNotNull() & F.col("model").isin(*cfg.models))
    bad = exclude_ids if exclude_ids is not None else cfg.bad_gold_ids
    if bad:
        c = c.filter(~F.col("id").isin(*bad))
    denorm = all(k in cells.columns for k in ("lang", "dataset", "tags"))
    if denorm:
        j = c.select("id", "lang", "dataset", "model", "condition",
                     F.col("correct").cast("int").alias("correct"), "tags")
        if lang is not None:
            j = j.filter(F.col("lang") == lang)
    else:
        it = items.select("id", "lang", "dataset", "tags")
        if lang is not None:
            c = c.filter(F.col("lang") == lang) if "lang" in cells.columns else c
            it = it.filter(F.col("lang") == lang)
        c = c.select("id", "model", "condition", F.col("correct").cast("int").alias("correct"))
        j = c.join(it, "id")
    return j.select(
        "id", "lang", "dataset", "model", "condition", "correct",
        qa_phenomena("tags").alias("phenomena"),
        F.col("tags.paraphrase_distance").alias("paraphrase_distance"),
        F.col("tags.domain").alias("domain"),
        F.col("tags").isNotNull().alias("tagged"),
    )


def flatten_all(cells: DataFrame, items: DataFrame | None, cfg: EvalConfig) -> DataFrame:
    """R2: every configured language at once; unconfigured languages drop out
    (an ``In`` predicate that reaches the scan when ``lang`` is a stored column)."""
    c = cells.filter(F.col("lang").isin(*cfg.lang_codes)) if "lang" in cells.columns else cells
    it = items.filter(F.col("lang").isin(*cfg.lang_codes)) if items is not None else None
    return flatten_qa(c, it, cfg)


# ---------------------------------------------------------------------------
# Flatten MT results
# ---------------------------------------------------------------------------
def flatten_mt(mt_items: DataFrame, scores: DataFrame, cfg: EvalConfig,
               metrics: tuple[str, ...] = ("chrf", "comet", "adequacy", "fluency")) -> DataFrame:
    """One row per (item, configured model); metrics stay null when missing.

    ``scores`` is wide ``(id, model, <metrics>)``.  Items x models is a literal
    array explode (no cartesian join), then a left join keeps unscored rows.
    """
    models = F.array(*[F.lit(m) for m in cfg.models])
    grid = mt_items.select("id", "lang", mt_phenomena("tags").alias("phenomena"),
                           F.explode(models).alias("model"))
    # NaN (e.g. a failed neural metric) becomes null: pandas means skip NaN,
    # Spark's avg would return NaN for the whole group
    sc = scores.select("id", "model", *[F.nanvl(F.col(m).cast("double"), F.lit(None).cast("double")).alias(m)
                                        for m in metrics])
    return grid.join(sc, ["id", "model"], "left")


# ---------------------------------------------------------------------------
# Pivots of slice results
# ---------------------------------------------------------------------------
def slice_pivot(by_phenomenon: DataFrame, phenomena: tuple[str, ...]) -> DataFrame:
    """Model x {no_X, has_X, delta_X} from the long A5 result of one dataset."""
    aggs = []
    for p in phenomena:
        sel = F.col("phenomenon") == p
        aggs += [F.first(F.when(sel, F.col("acc_without")), ignorenulls=True).alias(f"no_{p}"),
                 F.first(F.when(sel, F.col("acc_with")), ignorenulls=True).alias(f"has_{p}"),
                 F.first(F.when(sel, F.col("delta")), ignorenulls=True).alias(f"delta_{p}")]
    return by_phenomenon.groupBy("dataset", "model").agg(*aggs)


def category_pivot(by_category: DataFrame, values: tuple[str, ...], value_col: str = "accuracy") -> DataFrame:
    """Model x category with an explicit (alphabetical) value list."""
    vals = sorted(values)
    return (by_category.groupBy("dataset", "model")
            .pivot("category", vals).agg(F.first(value_col)))


def per_tag_pivot(per_tag_long: DataFrame, models: tuple[str, ...], value_col: str) -> DataFrame:
    """(lang, phenomenon) x model for one statistic, rows sorted; all-null rows dropped."""
    p = per_tag_long.groupBy("lang", "phenomenon").pivot("model", list(models)).agg(F.first(value_col))
    return p.dropna(how="all", subset=list(models)).orderBy("lang", "phenomenon")


def panel_key(dataset: Column | str = "dataset", condition: Column | str = "condition") -> Column:
    """P20: the ``dataset / condition`` composite key."""
    d = F.col(dataset) if isinstance(dataset, str) else dataset
    c = F.col(condition) if isinstance(condition, str) else condition
    return F.concat_ws(" / ", d, c)


def panel_pivot(flat: DataFrame, models: tuple[str, ...]) -> DataFrame:
    """(dataset / condition) x model accuracy in percent (unrounded)."""
    return (flat.withColumn("panel", panel_key())
            .groupBy("panel").pivot("model", list(models))
            .agg((F.avg("correct") * 100)))


# ---------------------------------------------------------------------------
# Nested export and inspection records
# ---------------------------------------------------------------------------
def nest_results(items: DataFrame, cells: DataFrame) -> DataFrame:
    """Long cells -> one record per item with ``predictions`` as
    ``map<model, map<condition, struct>>`` (the JSONL export shape).

    One grouping by item id (a group holds at most models x conditions cells)
    and the two map levels are built inside the row, so the plan has a single
    exchange on ``id``, which the join back to the items reuses.
    """
    entry = F.struct("prediction", "verdict", "reason", "correct")
    per_item = cells.groupBy("id").agg(F.collect_list(F.struct("model", "condition", entry.alias("e"))).alias("cs"))
    models = F.array_distinct(F.transform("cs", lambda c: c["model"]))
    nested = F.map_from_entries(F.transform(models, lambda m: F.struct(
        m.alias("model"),
        F.map_from_entries(F.transform(F.filter("cs", lambda c: c["model"] == m),
                                       lambda c: F.struct(c["condition"], c["e"]))).alias("by_cond"))))
    return items.join(per_item.select("id", nested.alias("predictions")), "id", "left")


def slim_items(items: DataFrame, cells: DataFrame, cfg: EvalConfig, condition: str = "openbook") -> DataFrame:
    """R10 + P16: per item, one open-book entry for each configured model (with
    null fields where the model has none) and the tri-state split into correct /
    wrong models, all in config order."""
    c = cells.filter(F.col("condition") == condition).filter(F.col("model").isin(*cfg.models))
    fields = ("prediction", "verdict", "reason", "correct")
    entry = F.struct("model", *fields)
    agg = c.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("model", entry.alias("e")))).alias("by"))
    cols = ("id", "dataset", "lang", "question", "context", "gold", "tags")
    out = items.select(*cols).join(agg, "id", "left")
    of = lambda m: F.try_element_at("by", F.lit(m))
    entries = F.array(*[F.struct(F.lit(m).alias("model"), *[of(m)[f].alias(f) for f in fields]) for m in cfg.models])
    out = out.select(*cols, entries.alias("openbook"))
    split = lambda right: F.transform(F.filter("openbook", lambda e: e["correct"] == F.lit(right)), lambda e: e["model"])
    out = out.select(*cols, "openbook", split(True).alias("correct_models"), split(False).alias("wrong_models"))
    return out.select("*", F.size("correct_models").alias("n_correct"), F.size("wrong_models").alias("n_wrong"))
