"""Item preparation: projections, filters, alignment, merging (P1-P9, P11, P12,
J1, J2, U1-U3).

All functions are DataFrame -> DataFrame and lazy.  Filters are plain column
predicates so Catalyst pushes them into the Parquet scan where possible.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_blank, ustrip
from .ordering import running_totals


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


# ---------------------------------------------------------------------------
# P1-P6
# ---------------------------------------------------------------------------
def make_id(prefix: str | Column, source_id: Column | str) -> Column:
    """``<prefix>_<source id>`` with every ``/`` in the source id turned into ``_``."""
    p = F.lit(prefix) if isinstance(prefix, str) else prefix
    return F.concat(p, F.lit("_"), F.translate(_c(source_id).cast("string"), "/", "_"))


def normalize_items(df: DataFrame, dataset: str | Column, lang: str | Column, id_col: str,
                    text_cols: Iterable[str] = ("question", "context", "gold")) -> DataFrame:
    """Strip (Unicode whitespace) every text field and build the item id."""
    ds = F.lit(dataset) if isinstance(dataset, str) else dataset
    lg = F.lit(lang) if isinstance(lang, str) else lang
    return df.select(make_id(ds, id_col).alias("id"), ds.alias("dataset"), lg.alias("lang"),
                     *[ustrip(c).alias(c) for c in text_cols])


def first_answer(answers: Column | str = "answers") -> Column:
    """The first of ``answers.text``, ``''`` if there is none (no ANSI error)."""
    return F.coalesce(F.get(_c(answers).getField("text"), 0), F.lit(""))


def filter_has_answer(df: DataFrame, answers: str = "answers") -> DataFrame:
    """Keep rows whose first answer is non-blank."""
    return df.filter(~is_blank(F.get(F.col(answers).getField("text"), 0)))


def filter_answerable(df: DataFrame, answer: str = "answer", category: str = "category",
                      unanswerable: str = "UNANSWERABLE") -> DataFrame:
    """Truthy answer and category not UNANSWERABLE; a null category is kept."""
    return df.filter((F.coalesce(F.col(answer), F.lit("")) != "")
                     & ~F.col(category).eqNullSafe(F.lit(unanswerable)))


def filter_span_found(df: DataFrame, col: str = "span_found") -> DataFrame:
    """P5: only rows with a verified answer span."""
    return df.filter(F.coalesce(F.col(col), F.lit(False)))


def filter_id_prefix(df: DataFrame, prefix: str, col: str = "id") -> DataFrame:
    """Language subset by id prefix (a ``StringStartsWith`` Parquet pushdown)."""
    return df.filter(F.col(col).startswith(prefix))


# ---------------------------------------------------------------------------
# Set membership
# ---------------------------------------------------------------------------
def exclude_ids(df: DataFrame, ids: Iterable[str] | DataFrame, col: str = "id") -> DataFrame:
    """Drop audited ids.  A literal list becomes a ``NOT IN`` set predicate
    (no join at all); a DataFrame of ids is a left-anti join that AQE plans as
    a broadcast only when its runtime size is under the broadcast threshold."""
    if isinstance(ids, DataFrame):
        return df.join(ids.select(F.col(ids.columns[0]).alias(col)).distinct(), col, "left_anti")
    ids = list(ids)
    return df.filter(~F.col(col).isin(*ids)) if ids else df


def restrict_datasets(df: DataFrame, allowed: Iterable[str], col: str = "dataset") -> DataFrame:
    """Dataset allow list (``In`` predicate, pushed to the scan)."""
    return df.filter(F.col(col).isin(*list(allowed)))


def extra_ids(existing: DataFrame, fresh: DataFrame, key: str = "id") -> DataFrame:
    """Existing rows whose key is not in the fresh set."""
    return existing.join(fresh.select(key), key, "left_anti")


# ---------------------------------------------------------------------------
# Prompt rendering
# ---------------------------------------------------------------------------
def render_prompts(df: DataFrame, templates: dict[tuple[str, str], str], on_missing: str = "raise",
                   lang: str = "lang", condition: str = "condition", out: str = "prompt") -> DataFrame:
    """Render a prompt per row from ``templates[(lang, condition)]``.

    Each template such as ``'Q: {question}'`` is split at plan-build time into
    literal parts and field references and becomes one ``concat``; the
    templates form a single CASE on (lang, condition) -- no join, no per-row
    map, and never chained ``replace`` (a context containing ``{question}``
    would otherwise be substituted twice).

    ``on_missing``: ``'raise'`` fails the job for a row without a template
    (the reference raises on an unknown condition), ``'null'`` leaves the
    prompt null.
    """
    expr = None
    for (lg, cond), text in templates.items():
        parts = [F.lit(lit) if lit is not None else F.coalesce(F.col(f).cast("string"), F.lit(""))
                 for lit, f in template_parts(text)]
        rendered = F.concat(*parts) if parts else F.lit("")
        hit = (F.col(lang) == F.lit(lg)) & (F.col(condition) == F.lit(cond))
        expr = F.when(hit, rendered) if expr is None else expr.when(hit, rendered)
    if expr is None:
        expr = F.lit(None).cast("string")
    if on_missing == "raise":
        msg = F.concat(F.lit("no template for "), F.coalesce(F.col(lang), F.lit("?")), F.lit("/"),
                       F.coalesce(F.col(condition), F.lit("?")))
        expr = expr.otherwise(F.raise_error(msg)) if templates else F.raise_error(msg)
    return df.withColumn(out, expr)


def template_parts(text: str) -> list[tuple[str | None, str | None]]:
    """Split ``'Q: {question}'`` into ``[('Q: ', None), (None, 'question')]``;
    ``{{``/``}}`` are literal braces."""
    out: list[tuple[str | None, str | None]] = []
    buf, i = [], 0
    while i < len(text):
        ch = text[i]
        if text.startswith("{{", i) or text.startswith("}}", i):
            buf.append(ch)
            i += 2
        elif ch == "{":
            j = text.index("}", i)
            if buf:
                out.append(("".join(buf), None))
                buf = []
            out.append((None, text[i + 1:j]))
            i = j + 1
        else:
            buf.append(ch)
            i += 1
    if buf:
        out.append(("".join(buf), None))
    return out


# ---------------------------------------------------------------------------
# P11 / P12
# ---------------------------------------------------------------------------
def verify_spans(df: DataFrame, context: str = "context", gold: str = "gold",
                 claimed: str = "span_found") -> DataFrame:
    """A claimed span must be a verbatim substring of the context, else it
    is downgraded (span_found false, gold '').  Unclaimed spans get gold ''."""
    ok = F.coalesce(F.col(claimed), F.lit(False)) & F.coalesce(F.col(context).contains(F.col(gold)), F.lit(False))
    return df.withColumn("span_found", ok).withColumn(gold, F.when(ok, F.col(gold)).otherwise(F.lit("")))


def require_fields(df: DataFrame, fields: Iterable[str]) -> DataFrame:
    """Flag rows with a blank required field (``status`` ok / rejected and
    the first blank field in ``error``) instead of failing the whole job."""
    fields = list(fields)
    first_blank = F.coalesce(*[F.when(is_blank(f), F.lit(f"blank {f}")) for f in fields])
    return df.withColumn("error", first_blank).withColumn(
        "status", F.when(F.col("error").isNull(), F.lit("ok")).otherwise(F.lit("rejected")))


# ---------------------------------------------------------------------------
# J1 / J2 / U1 / U2
# ---------------------------------------------------------------------------
def align_parallel(rows: DataFrame, key: str, role: str, src_role: str, tgt_role: str,
                   order: str, text: str = "text") -> DataFrame:
    """Source and target rows by shared key; duplicate keys on the source
    side keep the last one (by ``order``).  The source side is reduced to one
    row per key first, so the join cannot multiply rows on that side."""
    src = (rows.filter(F.col(role) == src_role).groupBy(key)
           .agg(F.max_by(F.col(text), F.col(order)).alias("src_text")))
    tgt = rows.filter(F.col(role) == tgt_role).select(key, F.col(text).alias("tgt_text"),
                                                       F.col(order).alias("tgt_order"))
    return tgt.join(src, key, "inner").select(key, "src_text", "tgt_text", "tgt_order")


def merge_existing(fresh: DataFrame, existing: DataFrame, allowed_datasets: Iterable[str],
                   key: str = "id", order: str | None = None, position: str | None = None) -> DataFrame:
    """An existing record wins over the fresh one with the same key; existing
    records not in the fresh set are kept when their dataset is allowed.

    Of existing records with one key the last by column ``order`` counts;
    without it the greatest as JSON text, so that the choice does not depend on
    how the rows lie.

    With ``position`` both sides hold a column of that name that orders them, and the
    result numbers its records in it from 1: the fresh ones in their order first, then the extras in
    theirs (ties by key).  No window over the whole table is planned."""
    if position:
        rest = [c for c in fresh.columns if c != position]
        at = fresh.groupBy(key).agg(F.lit(0).alias("__side"), F.min(position).alias("__at"))
        behind = (existing.groupBy(key).agg(F.max_by(position, F.col(order)) if order else F.max(position))
                  .toDF(key, "__at").join(at.select(key), key, "left_anti").select(key, F.lit(1).alias("__side"), "__at"))
        merged = merge_existing(fresh.select(rest), existing, allowed_datasets, key, order)
        placed = merged.join(at.unionByName(behind), key, "left")
        return running_totals(placed.withColumn("__all", F.lit(0)), ["__all"], ["__side", "__at", key],
                              {position: ("sum", F.lit(1).cast("long"))}).select(*fresh.columns)
    cols = fresh.columns
    record = F.struct(*[F.col(c) for c in cols])
    last = F.col(order) if order else F.to_json(record)
    ex_tag = existing.groupBy(key).agg(F.max_by(record, last).alias("_ex"))
    ex = ex_tag.select(key, *[F.col(f"_ex.{c}").alias(c) for c in cols if c != key])  # by key still, as it was grouped
    merged = fresh.join(ex_tag, key, "left").select(
        *[F.when(F.col("_ex").isNotNull(), F.col(f"_ex.{c}")).otherwise(F.col(c)).alias(c) for c in cols])
    extras = extra_ids(ex, fresh, key).filter(F.col("dataset").isin(*list(allowed_datasets)))
    return merged.unionByName(extras)


def union_splits(*splits: DataFrame) -> DataFrame:
    """Train + validation etc. (duplicates kept)."""
    out = splits[0]
    for s in splits[1:]:
        out = out.unionByName(s)
    return out


def union_benchmarks(*parts: DataFrame) -> DataFrame:
    """Several item sources into one table (columns aligned by name)."""
    out = parts[0]
    for s in parts[1:]:
        out = out.unionByName(s, allowMissingColumns=True)
    return out
