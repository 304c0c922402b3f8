"""Enrichment with user-supplied functions.

The expensive calls of an evaluation (a model answering, a judge grading, a
translator) are user functions.  Spark runs them over the *pending* rows only
(see :mod:`slicekit.operators.jobs`), one Arrow batch at a time inside
``mapInArrow``; the parallelism is the number of partitions of the work
list, which :func:`enrich_missing` can spread with a round-robin
repartition so slow calls do not pile up in one task.

An exception is isolated to its row: the row comes back with
``status='error'`` and the message, stays pending, and the rest go on.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..session import materialize, ship_package

RowFn = Callable[[dict], dict]
BatchFn = Callable[[pd.DataFrame], pd.DataFrame]
_LENGTH = "__length"


def _as_struct(schema: T.StructType | str) -> T.StructType:
    if isinstance(schema, T.StructType):
        return schema
    return T._parse_datatype_string(schema)  # DDL such as "prediction string"


def _result_schema(work: DataFrame, keys: list[str], out: T.StructType) -> T.StructType:
    key_fields = [work.schema[k] for k in keys]
    return T.StructType(key_fields + list(out.fields) + [T.StructField("status", T.StringType()),
                                                           T.StructField("error", T.StringType())])


def _err(e: BaseException) -> str:
    return f"{type(e).__name__}: {e}"


def enrich_missing(work: DataFrame, fn: RowFn, out_schema: T.StructType | str, keys: list[str],
                   parallelism: int | None = None) -> DataFrame:
    """Apply ``fn(row_dict) -> dict`` to every row of the work list.

    Output: ``keys`` + the fields of ``out_schema`` + ``status`` + ``error``.
    ``out_schema`` may be a DDL string, e.g. ``"prediction string"``.
    The result is lazy: write it (``session.materialize`` or a stage table)
    before using it more than once, or the function runs again.
    """
    out = _as_struct(out_schema)
    res_schema = _result_schema(work, keys, out)
    names = [f.name for f in out.fields]
    arrow_schema = to_arrow_schema(res_schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for rec in batch.to_pylist():  # nulls are None and integers stay integers
                row = {k: rec[k] for k in keys}
                try:
                    res = fn(rec) or {}
                    row.update({n: res.get(n) for n in names})
                    row.update(status="ok", error=None)
                except Exception as e:  # noqa: BLE001 - isolate any user error to its row
                    row.update({n: None for n in names})
                    row.update(status="error", error=_err(e))
                rows.append(row)
            yield pa.RecordBatch.from_pylist(rows, schema=arrow_schema)

    ship_package(work.sparkSession)
    w = work.repartition(parallelism) if parallelism else work
    return w.mapInArrow(run, res_schema)


def score_batches(work: DataFrame, scorer: BatchFn, out_schema: T.StructType | str, keys: list[str],
                  batch_size: int = 64, length: Column | None = None, batch_length: int | None = None) -> DataFrame:
    """A batch scorer over rows (e.g. (src, hyp, ref) triplets).

    With ``length`` (such as ``F.length("hyp")``) rows are sorted by it inside each
    partition, so that a batch holds rows of about one length and a scorer that pads
    them to the longest wastes little; ``batch_length`` bounds a batch's rows times its
    longest (a longer row is a batch of its own).  Rows whose length is null count as 0.

    ``scorer(pdf) -> pdf`` gets at most ``batch_size`` rows and returns the
    ``out_schema`` columns in the same row order.  A failing batch is retried
    row by row so one bad row cannot fail its neighbours.
    """
    out = _as_struct(out_schema)
    res_schema = _result_schema(work, keys, out)
    names = [f.name for f in out.fields]
    cols = [f.name for f in res_schema.fields]
    by_length = length is not None

    def score(chunk: pd.DataFrame) -> pd.DataFrame:
        res = scorer(chunk.reset_index(drop=True))
        if len(res) != len(chunk):
            raise ValueError(f"scorer returned {len(res)} rows for {len(chunk)}")
        o = chunk[keys].reset_index(drop=True).copy()
        for n in names:
            o[n] = res[n].to_numpy()
        o["status"], o["error"] = "ok", None
        return o

    def chunks(pdf: pd.DataFrame) -> Iterator[pd.DataFrame]:
        if not by_length:
            yield from (pdf.iloc[s:s + batch_size] for s in range(0, len(pdf), batch_size))
            return
        sizes, start, longest = pdf.pop(_LENGTH).to_numpy(), 0, 0
        for i, size in enumerate(sizes):
            over = batch_length is not None and max(longest, size) * (i - start + 1) > batch_length
            if i > start and (i - start == batch_size or over):
                yield pdf.iloc[start:i]
                start, longest = i, 0
            longest = max(longest, size)
        if start < len(pdf):
            yield pdf.iloc[start:]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for chunk in chunks(pdf):
                try:
                    yield score(chunk)[cols]
                except Exception:  # noqa: BLE001 - fall back to single rows
                    for i in range(len(chunk)):
                        one = chunk.iloc[i:i + 1]
                        try:
                            yield score(one)[cols]
                        except Exception as e:  # noqa: BLE001
                            o = one[keys].reset_index(drop=True).copy()
                            for n in names:
                                o[n] = None
                            o["status"], o["error"] = "error", _err(e)
                            yield o[cols]

    ship_package(work.sparkSession)
    if by_length:
        work = work.withColumn(_LENGTH, F.coalesce(length.cast("long"), F.lit(0))).sortWithinPartitions(F.desc(_LENGTH))
    return work.mapInPandas(run, res_schema)


def observe_mean(scored: DataFrame, value: str) -> tuple[DataFrame, Observation]:
    """``scored`` and an observation that holds, once it has been written or counted,
    its ``mean``, the number of values ``n`` and of failed rows ``failed``: no second job."""
    seen = Observation()
    failed = F.count(F.when(F.col("status") != "ok", 1))
    return scored.observe(seen, F.avg(value).alias("mean"), F.count(value).alias("n"), failed.alias("failed")), seen


def retrying(fn: Callable, max_tries: int = 3, wait: Callable[[int], float] | None = None,
             accept: Callable[[object], bool] | None = None,
             retry_on: tuple[type[BaseException], ...] = (Exception,), wait_on_reject: bool = True,
             fallback: object = ..., sleep: Callable[[float], None] = time.sleep) -> Callable:
    """Call ``fn`` up to ``max_tries`` times.

    * An exception of a ``retry_on`` type is retried after ``wait(k)`` seconds
      (k = 0-based try); on the last try it propagates.  Other exceptions
      propagate at once.
    * A result with ``accept(result)`` false (e.g. an empty reply) is retried,
      after ``wait(k)`` only if ``wait_on_reject``; if the last try is
      rejected, ``fallback`` is returned (or ``ValueError`` raised).

    The two policies of the studied pipeline:
    tagger  -- ``retrying(tag, 3, lambda k: 1.0 + 0.5 * k, retry_on=(ValueError,))``
    with ``tag`` raising ``ValueError`` on an empty or unparsable reply;
    translator -- ``retrying(gen, 5, lambda k: min(60, 2 ** k), accept=bool,
    wait_on_reject=False, fallback='')``.
    A raised error makes :func:`enrich_missing` mark the row as failed.
    """
    def wrapped(*args, **kwargs):
        for k in range(max_tries):
            last_try = k == max_tries - 1
            try:
                res = fn(*args, **kwargs)
            except retry_on:
                if last_try:
                    raise
                if wait is not None:
                    sleep(wait(k))
                continue
            if accept is None or accept(res):
                return res
            if not last_try and wait is not None and wait_on_reject:
                sleep(wait(k))
        if fallback is not ...:
            return fallback
        raise ValueError("reply rejected on every try")
    return wrapped


def tag_by_rules(df: DataFrame, rules: dict[str, list[tuple[str, str]]], text: str,
                 gold: str | None = None, context: str | None = None, lang: str = "lang",
                 out: str = "tags") -> DataFrame:
    """E5: deterministic tagging by regular expressions per language.

    ``rules[lang] = [(phenomenon, java_regex), ...]``.  Every pattern is a
    literal, so it is compiled once per task and evaluated in generated code.
    With ``gold`` and ``context`` the paraphrase class is ``literal_match``
    when the gold answer occurs verbatim in the context, else ``paraphrase``.
    """
    t = F.col(text)
    cands = []
    for lg, rs in rules.items():
        for ph, rx in rs:
            cands.append(F.when((F.col(lang) == lg) & t.rlike(rx), F.lit(ph)))
    phen = F.filter(F.array(*cands), lambda x: x.isNotNull()) if cands else F.array().cast("array<string>")
    para = F.lit(None).cast("string")
    if gold and context:
        para = F.when(F.col(context).contains(F.col(gold)), F.lit("literal_match")).otherwise(F.lit("paraphrase"))
    return df.withColumn(out, F.struct(phen.alias("linguistic_phenomena"), para.alias("paraphrase_distance"),
                                       F.lit(None).cast("string").alias("domain")))


def translate_and_locate(rows: DataFrame, translate_fn: RowFn, locate_fn: RowFn, key: str = "id",
                         parallelism: int | None = None) -> DataFrame:
    """Translate (question, context) then locate the answer span, then
    verify it (P11).  Rows failing either call are kept with their error, so
    the audit sees every row (rows are matched by key, never by position)."""
    from .prep import verify_spans

    # the translations feed two branches below, and the caller may use the
    # result more than once: both are written, so no function runs twice for a row
    t = materialize(enrich_missing(rows, translate_fn, "question string, context string", [key], parallelism),
                    "translations")
    t_ok = t.filter(F.col("status") == "ok").drop("status", "error")
    src = rows.drop("question", "context") if "question" in rows.columns else rows
    located_in = t_ok.join(src, key)
    loc = materialize(enrich_missing(located_in, locate_fn, "gold string, span_found boolean", [key], parallelism), "located")
    merged = (t.select(key, "question", "context", F.col("status").alias("t_status"), F.col("error").alias("t_error"))
              .join(loc.select(key, "gold", "span_found", F.col("status").alias("l_status"),
                               F.col("error").alias("l_error")), key, "left"))
    v = verify_spans(merged)
    status = F.when((F.col("t_status") == "ok") & (F.col("l_status") == "ok"), F.lit("ok")).otherwise(F.lit("error"))
    return v.select(key, "question", "context", "gold", "span_found", status.alias("status"),
                    F.coalesce("t_error", "l_error").alias("error"))
