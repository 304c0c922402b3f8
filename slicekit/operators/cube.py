"""Slice cubes: one small table from which every report rolls up.

A cube has one row for each combination of language, dataset, condition, model, tag bitmap,
paraphrase class and domain, with the number of rows and the number right (or, for translations, the
sum and the number of each metric).  Its size depends on the configuration -- languages, models, tags in use
together -- not on the items.  One aggregate over the cells replaces one scan per report section.

The measures are sums, so cubes add up, and a changed cell is taken out with weight -1 and put in with weight +1.
Metric sums are decimals: taking out what was put in leaves nothing behind.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import MT_METRICS, EvalConfig
from ..functions.tags import has_tag, qa_phenomena

QA_DIMENSIONS = ("lang", "dataset", "condition", "model", "bits", "paraphrase_distance", "domain", "tagged")
ITEM_DIMENSIONS = ("lang", "dataset", "bits", "paraphrase_distance", "domain", "tagged")
MT_DIMENSIONS = ("lang", "model", "bits")
_SUM = "decimal(38,12)"


def vocabulary(cfg: EvalConfig) -> tuple[str, ...]:
    """All tags of the configuration: bit i of a bitmap is the i-th.  One bit more says that the list holds others or is empty of these."""
    names = dict.fromkeys([*cfg.all_phenomena, *(p for s in cfg.langs for p in (*s.required, *s.bonus))])
    if len(names) > 62:
        raise ValueError(f"{len(names)} tags do not fit a 64-bit bitmap")
    return tuple(names)


def tag_bits(phenomena: Column | str, vocab: tuple[str, ...]) -> Column:
    """The bitmap of a tag list; the bit behind the vocabulary's is set where the list holds a tag outside it."""
    p = F.col(phenomena) if isinstance(phenomena, str) else phenomena
    known = [F.when(has_tag(p, t), F.lit(1 << i)).otherwise(0).cast("long") for i, t in enumerate(vocab)]
    other = F.when(F.size(F.array_except(p, F.array(*map(F.lit, vocab)))) > 0, F.lit(1 << len(vocab))).otherwise(0).cast("long")
    return reduce(Column.bitwiseOR, [*known, other])


def bits_list(bits: Column | str, vocab: tuple[str, ...]) -> Column:
    """The tag list of a bitmap; tags outside the vocabulary come back as one, ``other``."""
    b = F.col(bits) if isinstance(bits, str) else bits
    names = F.array(*[F.when(b.bitwiseAND(F.lit(1 << i).cast("long")) != 0, F.lit(t)) for i, t in enumerate((*vocab, "other"))])
    return F.filter(names, lambda x: x.isNotNull())


def qa_cube(flat: DataFrame, cfg: EvalConfig, sign: str | None = None) -> DataFrame:
    """The cube of flattened QA rows: ``n`` rows and ``k`` right for each combination; with ``sign``, rows count so often."""
    w = F.col(sign) if sign else F.lit(1)
    return flat.withColumn("bits", tag_bits("phenomena", vocabulary(cfg))).groupBy(*QA_DIMENSIONS).agg(
        F.sum(w).cast("long").alias("n"), F.sum(w * F.col("correct")).cast("long").alias("k"))


def item_cube(items: DataFrame, cfg: EvalConfig) -> DataFrame:
    """The cube of items ``(lang, dataset, tags)``: ``n`` items for each combination."""
    return items.select(
        "lang", "dataset", tag_bits(qa_phenomena("tags"), vocabulary(cfg)).alias("bits"), F.col("tags.paraphrase_distance"),
        F.col("tags.domain"), F.col("tags").isNotNull().alias("tagged")).groupBy(*ITEM_DIMENSIONS).agg(F.count(F.lit(1)).alias("n"))


def mt_cube(flat: DataFrame, cfg: EvalConfig, metrics: tuple[str, ...] = MT_METRICS, sign: str | None = None) -> DataFrame:
    """The cube of flattened MT rows: ``n`` rows, and for each metric the number ``n_<m>`` and the sum ``s_<m>`` of its values."""
    w = F.col(sign) if sign else F.lit(1)
    aggs = [F.sum(w).cast("long").alias("n")]
    for m in metrics:
        aggs += [F.sum(F.when(F.col(m).isNotNull(), w).otherwise(0)).cast("long").alias(f"n_{m}"),
                 F.coalesce(F.sum(F.col(m).cast("decimal(24,12)") * w), F.lit(0)).cast(_SUM).alias(f"s_{m}")]
    return flat.withColumn("bits", tag_bits("phenomena", vocabulary(cfg))).groupBy(*MT_DIMENSIONS).agg(*aggs)


def add_cubes(*cubes: DataFrame) -> DataFrame:
    """The cube of all rows of the given ones; combinations that no row is left of are gone."""
    both = reduce(DataFrame.unionByName, cubes)
    measures = [c for c in both.columns if c in ("n", "k") or c.startswith(("n_", "s_"))]
    dims = [c for c in both.columns if c not in measures]
    return (both.groupBy(*dims).agg(*[F.sum(m).cast(both.schema[m].dataType).alias(m) for m in measures])
            .filter(F.col("n") != 0))


def as_flat(cube: DataFrame, cfg: EvalConfig) -> DataFrame:
    """A cube with its bitmaps as tag lists: what the slice reports take in place of rows.

    An item cube gets ``tags`` records instead (null for untagged items)."""
    x = cube.withColumn("phenomena", bits_list("bits", vocabulary(cfg))).drop("bits")
    if "condition" in cube.columns or "tagged" not in cube.columns:
        return x
    tags = F.struct(F.col("phenomena").alias("linguistic_phenomena"), "paraphrase_distance", "domain")
    return x.select("lang", "dataset", F.when(F.col("tagged"), tags).alias("tags"), "n")


# -- what the reports count: rows, or what the rows of a cube stand for

def weight(df: DataFrame) -> Column:
    """1 for a row, the number of rows for one of a cube."""
    return F.col("n") if "n" in df.columns else F.lit(1)


def right(df: DataFrame) -> Column:
    return F.col("k") if {"n", "k"} <= set(df.columns) else F.col("correct")


def metric_count(df: DataFrame, metric: str) -> Column:
    return F.sum(f"n_{metric}") if f"s_{metric}" in df.columns else F.count(metric)


def metric_mean_of(df: DataFrame, metric: str, where: Column | None = None) -> Column:
    """Mean of a metric over the rows ``where``, nulls skipped; null for none."""
    pick = lambda c: c if where is None else F.when(where, c)
    if f"s_{metric}" not in df.columns:
        return F.avg(pick(F.col(metric)))
    return F.try_divide(F.sum(pick(F.col(f"s_{metric}"))).cast("double"), F.sum(pick(F.col(f"n_{metric}"))).cast("double"))
