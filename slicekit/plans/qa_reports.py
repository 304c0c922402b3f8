"""QA report queries over the fixture views."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import reshape as R
from ..operators import slices as S
from . import fixtures as fx
from .fixtures import CONFIG as CFG
from .fixtures import with_views
from .registry import query


@fx.memo_plan
def _flat(spark, sf_dir):
    it = fx.items(spark, sf_dir)
    return R.flatten_all(fx.cells(spark, sf_dir), it, CFG)


@fx.memo_plan
def _flat_plain(spark, sf_dir):
    """The same rows for reports that read no tag: nothing is joined."""
    return R.flatten_all(fx.plain_cells(spark, sf_dir), None, CFG)


# -- R1 -----------------------------------------------------------------------
@query("flatten_qa", with_views("""
SELECT id, lang, dataset, model, condition, CAST(correct AS INTEGER) AS correct,
 concat_ws(',', CASE WHEN t_newline THEN 'newline' END, CASE WHEN t_pipe THEN 'pipe' END,
           CASE WHEN t_email THEN 'email' END, CASE WHEN t_long THEN 'long' END) AS phenomena,
 paraphrase_distance, domain, tagged
FROM scored WHERE lang = 'en'""", "scored"))
def q_flatten_qa(spark, sf_dir):
    it = fx.items(spark, sf_dir)
    flat = R.flatten_qa(fx.cells(spark, sf_dir), it, CFG, lang="en")
    return flat.withColumn("phenomena", F.array_join("phenomena", ","))


@query("flatten_all", with_views("""
SELECT lang, dataset, model, condition, CAST(count(*) AS BIGINT) AS n,
 CAST(sum(correct) AS BIGINT) AS k, CAST(count_if(tagged) AS BIGINT) AS n_tagged
FROM scored WHERE lang IN ('de','en','es','fr') GROUP BY ALL""", "scored"))
def q_flatten_all(spark, sf_dir):
    flat = _flat(spark, sf_dir)
    return flat.groupBy("lang", "dataset", "model", "condition").agg(
        F.count(F.lit(1)).alias("n"), F.sum("correct").cast("bigint").alias("k"),
        F.count_if("tagged").alias("n_tagged"))


# -- A1 + O1 ----------------------------------------------------------------------
A1_SQL = with_views("""
SELECT dataset, condition, model, CAST(count(*) AS BIGINT) AS n,
 round_even(CAST(sum(correct) AS DOUBLE) / count(*) * 100, 1) AS accuracy_pct
FROM scored WHERE lang IN ('de','en','es','fr')
GROUP BY dataset, condition, model""", "scored")


@query("accuracy_by_benchmark", A1_SQL)
def q_accuracy_by_benchmark(spark, sf_dir):
    return S.accuracy_by_benchmark(_flat_plain(spark, sf_dir), CFG)


# -- A2 / A3 / A4 -------------------------------------------------------------------
_COV_COLS = (", ".join(f"CAST(count_if(t_{p}) AS BIGINT) AS ph_{p}" for p in fx.PH)
             + ", CAST(count_if(NOT (t_newline OR t_pipe OR t_email OR t_long)) AS BIGINT) AS \"none\", "
             + ", ".join(f"CAST(count_if(paraphrase_distance = '{v}') AS BIGINT) AS para_{v}" for v in fx.PARA)
             + ", " + ", ".join(f"CAST(count_if(domain = '{v}') AS BIGINT) AS dom_{v}" for v in fx.DOM))
fx.register_sql("coverage", f"""
SELECT lang, dataset, CAST(count(*) AS BIGINT) AS n, {_COV_COLS}
FROM items WHERE tagged AND lang IN {fx.LANGS_SQL} GROUP BY lang, dataset""", ("items",))

_COV_LONG = " UNION ALL ".join(
    [f"SELECT lang, dataset, 'phenomenon' AS facet, '{p}' AS value, ph_{p} AS count, n FROM coverage" for p in fx.PH]
    + ["SELECT lang, dataset, 'phenomenon', 'none', \"none\", n FROM coverage"]
    + [f"SELECT lang, dataset, 'paraphrase', '{v}', para_{v}, n FROM coverage" for v in fx.PARA]
    + [f"SELECT lang, dataset, 'domain', '{v}', dom_{v}, n FROM coverage" for v in fx.DOM])
fx.register_sql("coverage_long", f"""
SELECT lang, dataset, facet, value, count, n, CAST(count AS DOUBLE) * 100 / n AS pct
FROM ({_COV_LONG}) u""", ("coverage",))


@fx.memo_plan
def _cov(spark, sf_dir):
    return S.coverage(fx.items(spark, sf_dir), CFG)


@query("coverage", with_views("SELECT * FROM coverage", "coverage"))
def q_coverage(spark, sf_dir):
    return _cov(spark, sf_dir)


@query("coverage_pct", with_views("SELECT * FROM coverage_long", "coverage_long"))
def q_coverage_pct(spark, sf_dir):
    return S.coverage_pct(_cov(spark, sf_dir), CFG)


_BENCH = ("(SELECT * FROM (VALUES " + ",".join(
    f"('{s.lang}','{d}')" for s in CFG.langs for d in (s.native_dataset, s.translated_dataset))
    + ") AS t(lang, dataset))")


@query("tagged_counts", with_views(f"""
SELECT b.lang, b.dataset, CAST(coalesce(c.n_tagged, 0) AS BIGINT) AS n_tagged
FROM {_BENCH} b LEFT JOIN (SELECT lang, dataset, count(*) AS n_tagged FROM items WHERE tagged GROUP BY ALL) c
ON b.lang = c.lang AND b.dataset = c.dataset""", "items"))
def q_tagged_counts(spark, sf_dir):
    return S.tagged_counts(fx.items(spark, sf_dir), CFG, spark)


# -- A5 / R4 / R8 ------------------------------------------------------------------------
fx.register_sql("ph_counts", f"""
SELECT lang, dataset, model, phenomenon,
 CAST(count_if(has) AS BIGINT) AS n_with, CAST(sum(CASE WHEN has THEN correct END) AS BIGINT) AS k_with,
 CAST(count_if(NOT has) AS BIGINT) AS n_without, CAST(sum(CASE WHEN NOT has THEN correct END) AS BIGINT) AS k_without
FROM (SELECT s.*, p.phenomenon, {fx.sql_has('p.phenomenon')} AS has
      FROM scored s CROSS JOIN {fx.sql_values('phenomenon', fx.PH)} p
      WHERE s.condition = 'openbook' AND s.lang IN {fx.LANGS_SQL}) x
GROUP BY lang, dataset, model, phenomenon""", ("scored",))

fx.register_sql("by_phenomenon", """
SELECT lang, dataset, phenomenon, model, n_with, n_without, acc_with, acc_without,
 round_even(acc_with - acc_without, 1) AS delta
FROM (SELECT *, round_even(CAST(k_with AS DOUBLE) / nullif(n_with, 0) * 100, 1) AS acc_with,
        round_even(CAST(k_without AS DOUBLE) / nullif(n_without, 0) * 100, 1) AS acc_without,
        sum(n_with) OVER (PARTITION BY dataset, phenomenon) AS tw,
        sum(n_without) OVER (PARTITION BY dataset, phenomenon) AS tn
      FROM ph_counts) x
WHERE tw > 0 AND tn > 0""", ("ph_counts",))


@query("accuracy_by_phenomenon", with_views("SELECT * FROM by_phenomenon", "by_phenomenon"))
def q_accuracy_by_phenomenon(spark, sf_dir):
    return S.accuracy_by_phenomenon(_flat(spark, sf_dir), CFG)


_R4_COLS = ", ".join(
    f"max(CASE WHEN phenomenon = '{p}' THEN acc_without END) AS no_{p}, "
    f"max(CASE WHEN phenomenon = '{p}' THEN acc_with END) AS has_{p}, "
    f"max(CASE WHEN phenomenon = '{p}' THEN delta END) AS delta_{p}" for p in fx.PH)


@query("slice_pivot", with_views(f"SELECT dataset, model, {_R4_COLS} FROM by_phenomenon GROUP BY dataset, model",
                                 "by_phenomenon"))
def q_slice_pivot(spark, sf_dir):
    return R.slice_pivot(S.accuracy_by_phenomenon(_flat(spark, sf_dir), CFG), CFG.all_phenomena)


@query("slices_long", with_views("""
SELECT lang, dataset, phenomenon, 'with' AS slice, model, CAST(k_with AS DOUBLE) / n_with * 100 AS accuracy,
 n_with AS n FROM ph_counts WHERE n_with > 0
UNION ALL
SELECT lang, dataset, phenomenon, 'without', model, CAST(k_without AS DOUBLE) / n_without * 100, n_without
FROM ph_counts WHERE n_without > 0""", "ph_counts"))
def q_slices_long(spark, sf_dir):
    return S.slices_long(_flat(spark, sf_dir), CFG)


# -- A6 / A7 / R5 ------------------------------------------------------------------------
def _cat_sql(col: str) -> str:
    return with_views(f"""
SELECT lang, dataset, model, {col} AS category, CAST(count(*) AS BIGINT) AS n,
 round_even(CAST(sum(correct) AS DOUBLE) / count(*) * 100, 1) AS accuracy
FROM scored WHERE condition = 'openbook' AND {col} IS NOT NULL AND lang IN {fx.LANGS_SQL}
GROUP BY ALL""", "scored")


@query("accuracy_by_paraphrase", _cat_sql("paraphrase_distance"))
def q_accuracy_by_paraphrase(spark, sf_dir):
    return S.accuracy_by_paraphrase(_flat(spark, sf_dir))


@query("accuracy_by_domain", _cat_sql("domain"))
def q_accuracy_by_domain(spark, sf_dir):
    return S.accuracy_by_domain(_flat(spark, sf_dir))


def _pivot_sql(col: str, vals) -> str:
    cols = ", ".join(f"max(CASE WHEN category = '{v}' THEN accuracy END) AS {v}" for v in sorted(vals))
    inner = _cat_sql(col)
    return f"SELECT dataset, model, {cols} FROM ({inner}) a GROUP BY dataset, model"


@query("category_pivot", _pivot_sql("domain", fx.DOM))
def q_category_pivot(spark, sf_dir):
    return R.category_pivot(S.accuracy_by_domain(_flat(spark, sf_dir)), CFG.all_domains)


@query("paraphrase_pivot", _pivot_sql("paraphrase_distance", fx.PARA))
def q_paraphrase_pivot(spark, sf_dir):
    return R.category_pivot(S.accuracy_by_paraphrase(_flat(spark, sf_dir)), CFG.paraphrase)


# -- R7 / P20 --------------------------------------------------------------------------------
_R7_COLS = ", ".join(f"CAST(sum(CASE WHEN model = '{m}' THEN correct END) AS DOUBLE) / "
                     f"count(CASE WHEN model = '{m}' THEN 1 END) * 100 AS {m}" for m in CFG.models)


@query("panel_pivot", with_views(f"""
SELECT dataset || ' / ' || condition AS panel, {_R7_COLS}
FROM scored WHERE lang IN {fx.LANGS_SQL} GROUP BY ALL""", "scored"))
def q_panel_pivot(spark, sf_dir):
    return R.panel_pivot(_flat_plain(spark, sf_dir), CFG.models)


# -- A8 / A9 -----------------------------------------------------------------------------------
_MODELS_SQL = "(SELECT * FROM (VALUES " + ",".join(f"('{m}')" for m in CFG.models) + ") AS t(model))"
fx.register_sql("open_closed", f"""
SELECT lang, dataset, model,
 CAST(count_if(condition = 'openbook') AS BIGINT) AS n_open,
 sum(CASE WHEN condition = 'openbook' THEN correct END) AS k_open,
 CAST(count_if(condition = 'closedbook') AS BIGINT) AS n_closed,
 sum(CASE WHEN condition = 'closedbook' THEN correct END) AS k_closed
FROM scored WHERE lang IN {fx.LANGS_SQL} GROUP BY ALL""", ("scored",))


@query("open_vs_closed", with_views(f"""
SELECT b.lang, b.dataset, m.model,
 coalesce(CAST(o.k_open AS DOUBLE) * 100 / nullif(o.n_open, 0), 0.0) AS open_acc,
 coalesce(CAST(o.k_closed AS DOUBLE) * 100 / nullif(o.n_closed, 0), 0.0) AS closed_acc,
 CAST(coalesce(o.n_open, 0) AS BIGINT) AS n_open, CAST(coalesce(o.n_closed, 0) AS BIGINT) AS n_closed
FROM {_BENCH} b CROSS JOIN {_MODELS_SQL} m
LEFT JOIN open_closed o ON o.lang = b.lang AND o.dataset = b.dataset AND o.model = m.model""", "open_closed"))
def q_open_vs_closed(spark, sf_dir):
    return S.open_vs_closed(_flat_plain(spark, sf_dir), CFG, spark)


@query("disentangle", with_views(f"""
SELECT lang, model, n, open_acc, closed_acc, closed_acc - open_acc AS delta_pp,
 closed_acc - open_acc <= -30 AS alert
FROM (SELECT b.lang, m.model, CAST(coalesce(o.n_open, 0) AS BIGINT) AS n,
        coalesce(CAST(o.k_open AS DOUBLE) * 100 / nullif(o.n_open, 0), 0.0) AS open_acc,
        coalesce(CAST(o.k_closed AS DOUBLE) * 100 / nullif(o.n_closed, 0), 0.0) AS closed_acc
      FROM {_BENCH} b CROSS JOIN {_MODELS_SQL} m
      LEFT JOIN open_closed o ON o.lang = b.lang AND o.dataset = b.dataset AND o.model = m.model
      WHERE b.dataset LIKE '%\\_native' ESCAPE '\\'
        AND b.lang IN (SELECT lang FROM scored WHERE dataset = lang || '_native')) x""", "open_closed"))
def q_disentangle(spark, sf_dir):
    return S.disentangle(_flat_plain(spark, sf_dir), CFG, spark)


# -- A10 / A11 -----------------------------------------------------------------------------------
def _mix_sql(facet: str, name: str, extra: str = "") -> str:
    return with_views(f"""
SELECT lang, value AS {name},
 max(CASE WHEN dataset LIKE '%\\_native' ESCAPE '\\' THEN pct END) AS native_pct,
 max(CASE WHEN dataset LIKE '%\\_translated' ESCAPE '\\' THEN pct END) AS translated_pct
FROM coverage_long WHERE facet = '{facet}' {extra}
GROUP BY lang, value
HAVING native_pct IS NOT NULL AND translated_pct IS NOT NULL""", "coverage_long")


@query("paraphrase_mix", _mix_sql("paraphrase", "paraphrase_distance"))
def q_paraphrase_mix(spark, sf_dir):
    return S.paraphrase_mix(S.coverage_pct(_cov(spark, sf_dir), CFG), CFG)


@query("phenomenon_mix", _mix_sql("phenomenon", "phenomenon", "AND value <> 'none'"))
def q_phenomenon_mix(spark, sf_dir):
    return S.phenomenon_mix(S.coverage_pct(_cov(spark, sf_dir), CFG), CFG)


# -- A15 / A16 / O2 -----------------------------------------------------------------------------
@query("prepared_counts", with_views("""
SELECT lang, dataset, CAST(count(*) AS BIGINT) AS n FROM items GROUP BY ROLLUP (lang, dataset)
HAVING lang IS NOT NULL""", "items"))
def q_prepared_counts(spark, sf_dir):
    return S.prepared_counts(fx.items(spark, sf_dir))


@query("inspection_counts", with_views(f"""
SELECT i.lang,
 CAST(count_if(i.dataset LIKE '%\\_native' ESCAPE '\\' AND p.n_wrong > 0) AS BIGINT) AS native_wrong,
 CAST(count_if(i.dataset LIKE '%\\_translated' ESCAPE '\\' AND p.n_correct > 0) AS BIGINT) AS translated_correct
FROM items i LEFT JOIN (SELECT id, count_if(correct = 0) AS n_wrong, count_if(correct = 1) AS n_correct
                        FROM cells WHERE condition = 'openbook' GROUP BY id) p ON i.id = p.id
WHERE i.t_newline
GROUP BY i.lang""", "items", "cells"))
def q_inspection_counts(spark, sf_dir):
    it = fx.items(spark, sf_dir)
    return S.inspection_counts(it, fx.cells(spark, sf_dir), CFG, "newline")


@query("present_langs", with_views(f"""
SELECT DISTINCT lang, CASE lang {" ".join(f"WHEN '{c}' THEN {i}" for i, c in enumerate(CFG.lang_codes))} END AS lang_ord
FROM scored WHERE lang IN {fx.LANGS_SQL}""", "scored"))
def q_present_langs(spark, sf_dir):
    return S.present_langs(_flat_plain(spark, sf_dir), CFG)


# -- P20 ---------------------------------------------------------------------------------------
@query("panel_key", with_views(f"""
SELECT dataset || ' / ' || condition AS panel, CAST(count(*) AS BIGINT) AS n
FROM scored WHERE lang IN {fx.LANGS_SQL} GROUP BY ALL""", "scored"))
def q_panel_key(spark, sf_dir):
    return _flat_plain(spark, sf_dir).groupBy(R.panel_key().alias("panel")).agg(F.count(F.lit(1)).alias("n"))
