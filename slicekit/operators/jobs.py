"""Work lists and merges for resumable stages.

A stage never mutates rows in place: its work list is an anti-join of the
jobs against what is already done, its results are merged back with a full
outer join on the cell key, and the merged table is written to a *new*
version (see :mod:`slicekit.sources.checkpoint`).  A failed row keeps its
old state and stays on the next work list.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import EvalConfig

CELL_KEY = ["id", "model", "condition"]


def expand_jobs(items: DataFrame, cfg: EvalConfig, with_conditions: bool = True) -> DataFrame:
    """Items x models x conditions allowed for the item's dataset.

    The model and condition lists are config literals exploded per row: no
    cartesian join is planned and the expansion is partition-local.
    """
    x = items.select("id", "lang", "dataset", F.explode(F.array(*[F.lit(m) for m in cfg.models])).alias("model"))
    if with_conditions:
        x = x.select("*", F.explode(cfg.conditions_of("dataset")).alias("condition"))
    return x


def pending(jobs: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """J6 core: jobs whose key is absent from ``done``."""
    return jobs.join(done.select(*keys), keys, "left_anti")


def answered(value: str, status: str | None) -> Column:
    """Whether a stage has answered a row.

    With a ``status`` column an answer (``'ok'``) counts even where it held no value, so it is
    not asked for again, and a value that is there counts too; without one only the value can tell."""
    there = F.col(value).isNotNull()
    return there | F.coalesce(F.col(status) == "ok", F.lit(False)) if status else there


def pending_tag(items: DataFrame, status: str | None = None) -> DataFrame:
    """Items without a tag record."""
    return items.filter(~answered("tags", status))


def pending_infer(items: DataFrame, cells: DataFrame, cfg: EvalConfig, status: str | None = None) -> DataFrame:
    """(item, model, condition) jobs with no prediction yet."""
    done = cells.filter(answered("prediction", status))
    return pending(expand_jobs(items, cfg), done, CELL_KEY)


def pending_judge(cells: DataFrame, allowed_datasets: Iterable[str] | None = None, status: str | None = None) -> DataFrame:
    """Cells with a prediction but no verdict (only allowed datasets); ``status`` is the judge's."""
    x = cells.filter(F.col("prediction").isNotNull() & ~answered("verdict", status))
    if allowed_datasets is not None:
        x = x.filter(F.col("dataset").isin(*list(allowed_datasets)))
    return x


def pending_translate(mt_items: DataFrame, translations: DataFrame, cfg: EvalConfig, status: str | None = None) -> DataFrame:
    """(item, model) pairs without a translation."""
    jobs = expand_jobs(mt_items.select("id", "lang", F.lit(None).cast("string").alias("dataset")), cfg,
                       with_conditions=False).drop("dataset")
    return pending(jobs, translations.filter(answered("hyp", status)), ["id", "model"])


def pending_metric(translations: DataFrame, scores: DataFrame, metric: str, status: str | None = None) -> DataFrame:
    """Pairs with a non-empty hypothesis and no answer for ``metric`` yet.

    With a ``status`` column an answered pair (``'ok'``) is done even if the
    answer held no value; without one only the value can tell."""
    done = scores.filter(F.col(status) == "ok" if status else F.col(metric).isNotNull())
    todo = translations.filter(F.col("hyp").isNotNull() & (F.length("hyp") > 0))
    return pending(todo, done, ["id", "model"])


def new_candidates(candidates: DataFrame, cached: DataFrame, key: str = "id") -> DataFrame:
    """Candidates whose id is not cached yet."""
    return candidates.join(cached.select(key), key, "left_anti")


def _one_per_key(df: DataFrame, keys: list[str], name: str, status: str, order: str | None) -> DataFrame:
    row = F.struct(*[c for c in df.columns if c not in keys])
    ok = F.coalesce(F.col(status) == "ok", F.lit(False)) if status in df.columns else F.lit(True)
    last = F.col(order) if order and order in df.columns else F.to_json(row)
    return df.groupBy(*keys).agg(F.max_by(row, F.struct(ok, last)).alias(name))


def upsert(old: DataFrame, new: DataFrame, keys: list[str], payload: list[str],
           status: str = "status", order: str | None = None) -> DataFrame:
    """Merge stage results into the table by key.

    A new row with ``status = 'ok'`` replaces the payload; a failed new row
    leaves the old payload (and records its error); keys only in one side are
    kept.  Of several rows with one key an 'ok' row counts before a failed one,
    then the last by column ``order`` (without it: the greatest as JSON text).
    Both sides are shuffled once on the key; the merge is row-local.
    """
    o = _one_per_key(old, keys, "_o", status, order)
    n = _one_per_key(new, keys, "_n", status, order)
    j = o.join(n, keys, "full_outer")
    ok = F.coalesce(F.col(f"_n.{status}") == F.lit("ok"), F.lit(False))
    cols = []
    for c in payload:
        oc = F.col(f"_o.{c}") if c in old.columns else F.lit(None)
        if c not in new.columns:  # the stage does not produce this field: keep it
            cols.append(oc.alias(c))
            continue
        cols.append(F.when(ok, F.col(f"_n.{c}")).otherwise(oc).alias(c))
    keep = [c for c in old.columns if c not in keys and c not in payload and c not in (status, "error")]
    cols += [F.col(f"_o.{c}").alias(c) for c in keep]
    st_old = F.col(f"_o.{status}") if status in old.columns else F.lit(None).cast("string")
    err_old = F.col("_o.error") if "error" in old.columns else F.lit(None).cast("string")
    err_new = F.col("_n.error") if "error" in new.columns else F.lit(None).cast("string")
    cols.append(F.when(ok, F.lit("ok")).otherwise(F.coalesce(st_old, F.col(f"_n.{status}"))).alias(status))
    cols.append(F.when(ok, F.lit(None).cast("string")).otherwise(F.coalesce(err_new, err_old)).alias("error"))
    return j.select(*keys, *cols)
