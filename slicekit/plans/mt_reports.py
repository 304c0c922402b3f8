"""MT queries over the fixture views."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import agree as G
from ..operators import chrf as C
from ..operators import mt as M
from ..operators import reshape as R
from . import fixtures as fx
from .fixtures import CONFIG as CFG
from .fixtures import with_views
from .registry import query

MT_LANGS_SQL = "('de','en','fr')"


@fx.memo_plan
def mt_scores(spark, sf_dir):
    """Wide (id, model, chrf, comet, adequacy, fluency) for the fixture systems.

    chrf is computed by M1; the other three metrics stand in for the neural
    metric and the judge: comet = chrf/100 - 0.1 (item_id mod 3), adequacy /
    fluency = 1..5 by chrf thresholds; some pairs miss a metric (null).
    """
    tr = fx.translations(spark, sf_dir)
    pairs = tr.join(fx.mt_items(spark, sf_dir).select("id", "ref"), "id")
    ch = C.chrf_sentence(pairs, ["id", "model"])
    meta = tr.select("id", "model", "item_id", "mi")
    x = ch.join(meta, ["id", "model"])
    k = (F.col("item_id") * 4 + F.col("mi")) % 17
    c = F.col("chrf")
    ade = F.lit(1) + sum((c >= t).cast("int") for t in (20, 40, 60, 80))
    flu = F.lit(1) + sum((c >= t).cast("int") for t in (10, 30, 50, 70))
    return x.select("id", "model", "chrf",
                    F.when(k != 0, c / 100 - F.lit(0.1) * (F.col("item_id") % 3)).alias("comet"),
                    F.when(k != 5, ade).alias("adequacy"),
                    F.when(k != 11, flu).alias("fluency"))


@fx.memo_plan
def mt_flat(spark, sf_dir):
    return R.flatten_mt(fx.mt_items(spark, sf_dir), mt_scores(spark, sf_dir), CFG)


fx.register_sql("chrf", "SELECT * FROM " + C.sql_chrf("mt_pairs", ["id", "model"]) + " x", ("mt_pairs",))
fx.register_sql("mt_scores", """
SELECT c.id, c.model, c.chrf,
 CASE WHEN (p.item_id * 4 + p.mi) % 17 <> 0 THEN c.chrf / 100 - 0.1 * (p.item_id % 3) END AS comet,
 CASE WHEN (p.item_id * 4 + p.mi) % 17 <> 5 THEN 1 + CAST(c.chrf >= 20 AS INT) + CAST(c.chrf >= 40 AS INT)
      + CAST(c.chrf >= 60 AS INT) + CAST(c.chrf >= 80 AS INT) END AS adequacy,
 CASE WHEN (p.item_id * 4 + p.mi) % 17 <> 11 THEN 1 + CAST(c.chrf >= 10 AS INT) + CAST(c.chrf >= 30 AS INT)
      + CAST(c.chrf >= 50 AS INT) + CAST(c.chrf >= 70 AS INT) END AS fluency
FROM chrf c JOIN mt_pairs p ON c.id = p.id AND c.model = p.model""", ("chrf", "mt_pairs"))
fx.register_sql("mt_flat", """
SELECT b.id, b.lang, m.model, b.t_newline, b.t_pipe, b.t_email, b.t_long,
 NOT (b.t_newline OR b.t_pipe OR b.t_email OR b.t_long) AS t_none,
 s.chrf, s.comet, CAST(s.adequacy AS DOUBLE) AS adequacy, CAST(s.fluency AS DOUBLE) AS fluency
FROM mt_items b CROSS JOIN models m LEFT JOIN mt_scores s ON s.id = b.id AND s.model = m.model""",
                ("mt_items", "models", "mt_scores"))


fx.register_sql("length_scores", """
SELECT f.lang, f.chrf, CAST(length(p.hyp) AS DOUBLE) / greatest(length(p.ref), 1) AS length_ratio
FROM mt_flat f JOIN mt_pairs p ON p.id = f.id AND p.model = f.model
WHERE f.chrf IS NOT NULL AND p.hyp IS NOT NULL""", ("mt_flat", "mt_pairs"))


# -- M1 / M2 ----------------------------------------------------------------------
@query("chrf_sentence", with_views("SELECT id, model, round(chrf, 6) AS chrf FROM chrf", "chrf"))
def q_chrf_sentence(spark, sf_dir):
    pairs = fx.mt_pairs(spark, sf_dir)
    return C.chrf_sentence(pairs, ["id", "model"]).select("id", "model", F.round("chrf", 6).alias("chrf"))


@query("chrf_corpus", with_views("""
SELECT p.lang, c.model, CAST(count(c.chrf) AS BIGINT) AS n_scored, round(avg(c.chrf), 6) AS chrf
FROM chrf c JOIN mt_pairs p ON c.id = p.id AND c.model = p.model GROUP BY ALL""", "chrf", "mt_pairs"))
def q_chrf_corpus(spark, sf_dir):
    pairs = fx.mt_pairs(spark, sf_dir)
    sc = C.chrf_sentence(pairs, ["id", "model"]).join(pairs.select("id", "model", "lang"), ["id", "model"])
    return C.chrf_corpus(sc, ["lang", "model"]).withColumn("chrf", F.round("chrf", 6))


PARALLEL_SQL = """
SELECT t.pair_id, s.ref, t.text AS hyp
FROM (SELECT pair_id, max_by(text, turn) AS ref FROM parallel WHERE role = 'user' GROUP BY pair_id) s
JOIN parallel t ON t.pair_id = s.pair_id AND t.role = 'assistant'"""
fx.register_sql("aligned", PARALLEL_SQL, ("parallel",))


@query("chrf_parallel", with_views("SELECT pair_id, round(chrf, 6) AS chrf FROM "
                                   + C.sql_chrf("aligned", ["pair_id"]) + " x", "aligned"))
def q_chrf_parallel(spark, sf_dir):
    """chrF of every aligned (user -> assistant) pair: user text is the reference."""
    from ..operators import prep as P
    al = P.align_parallel(fx.parallel(spark, sf_dir), "pair_id", "role", "user", "assistant", "turn")
    al = al.select("pair_id", F.col("src_text").alias("ref"), F.col("tgt_text").alias("hyp"))
    return C.chrf_sentence(al, ["pair_id"]).select("pair_id", F.round("chrf", 6).alias("chrf"))


# -- R3 ---------------------------------------------------------------------------------
@query("flatten_mt", with_views("""
SELECT id, lang, model,
 CASE WHEN t_none THEN 'none' ELSE concat_ws(',', CASE WHEN t_newline THEN 'newline' END,
   CASE WHEN t_pipe THEN 'pipe' END, CASE WHEN t_email THEN 'email' END, CASE WHEN t_long THEN 'long' END) END
 AS phenomena, round(chrf, 6) AS chrf, round(comet, 6) AS comet, adequacy, fluency
FROM mt_flat""", "mt_flat"))
def q_flatten_mt(spark, sf_dir):
    f = mt_flat(spark, sf_dir)
    return f.select("id", "lang", "model", F.array_join("phenomena", ",").alias("phenomena"),
                    F.round("chrf", 6).alias("chrf"), F.round("comet", 6).alias("comet"), "adequacy", "fluency")


# -- A12 / P17 / A20 / A23 ----------------------------------------------------------------
_SYS_SQL = f"""
SELECT lang, model, CAST(count(*) AS BIGINT) AS n,
 CAST(count(chrf) AS BIGINT) AS n_chrf, CAST(count(comet) AS BIGINT) AS n_comet,
 CAST(count(adequacy) AS BIGINT) AS n_adequacy, CAST(count(fluency) AS BIGINT) AS n_fluency,
 avg(chrf) AS chrf, avg(comet) AS comet, avg(adequacy) AS adequacy, avg(fluency) AS fluency
FROM mt_flat WHERE lang IN {MT_LANGS_SQL} GROUP BY lang, model"""
fx.register_sql("system_level", _SYS_SQL, ("mt_flat",))


def _r6(df, cols):
    return df.select(*[F.round(c, 6).alias(c) if c in cols else F.col(c) for c in df.columns])


@query("system_level", with_views("""
SELECT lang, model, n, n_chrf, n_comet, n_adequacy, n_fluency, round(chrf, 6) AS chrf, round(comet, 6) AS comet,
 round(adequacy, 6) AS adequacy, round(fluency, 6) AS fluency FROM system_level""", "system_level"))
def q_system_level(spark, sf_dir):
    return _r6(M.system_level(mt_flat(spark, sf_dir), CFG), ("chrf", "comet", "adequacy", "fluency"))


@query("rescale_metrics", with_views("""
SELECT lang, model, round(chrf, 6) AS chrf_100, round(comet * 100, 6) AS comet_100,
 round(adequacy * 20, 6) AS adequacy_100, round(fluency * 20, 6) AS fluency_100 FROM system_level""",
                                     "system_level"))
def q_rescale_metrics(spark, sf_dir):
    s = M.system_level(mt_flat(spark, sf_dir), CFG).select("lang", "model", "chrf", "comet", "adequacy", "fluency")
    r = M.rescale_metrics(s)
    return _r6(r, ("chrf_100", "comet_100", "adequacy_100", "fluency_100"))


@query("tier_gap", with_views("""
SELECT lang, model, round(chrf, 6) AS chrf, round(max(chrf) OVER (PARTITION BY lang), 6) AS best,
 round(chrf - max(chrf) OVER (PARTITION BY lang), 6) AS gap_to_top FROM system_level""", "system_level"))
def q_tier_gap(spark, sf_dir):
    return _r6(M.tier_gap(M.system_level(mt_flat(spark, sf_dir), CFG)), ("chrf", "best", "gap_to_top"))


@query("metric_mean", with_views("""
SELECT CAST(count(comet) AS BIGINT) AS n, round(avg(comet), 6) AS mean_comet FROM mt_scores""", "mt_scores"))
def q_metric_mean(spark, sf_dir):
    return M.metric_mean(mt_scores(spark, sf_dir), "comet").withColumn("mean_comet", F.round("mean_comet", 6))


# -- A13 / R6 / P18 -------------------------------------------------------------------------
_METRICS = ("chrf", "comet", "adequacy", "fluency")
_REQ = ("newline", "long", "pipe")
_PT_COLS = ", ".join(
    f"avg(CASE WHEN has THEN {m} END) AS {m}_with, avg(CASE WHEN NOT has THEN {m} END) AS {m}_without"
    for m in _METRICS)
fx.register_sql("per_tag", f"""
SELECT lang, phenomenon, model, n_with, n_without,
 {", ".join(f"{m}_with, {m}_without, {m}_with - {m}_without AS {m}_delta" for m in _METRICS)}
FROM (SELECT lang, phenomenon, model, CAST(count_if(has) AS BIGINT) AS n_with,
        CAST(count_if(NOT has) AS BIGINT) AS n_without, {_PT_COLS}
      FROM (SELECT f.*, p.phenomenon, {fx.sql_has('p.phenomenon')} AS has
            FROM mt_flat f CROSS JOIN {fx.sql_values('phenomenon', _REQ)} p
            WHERE f.lang IN {MT_LANGS_SQL}) x
      GROUP BY lang, phenomenon, model) y""", ("mt_flat",))
_PT_OUT = ", ".join(f"round({m}_{s}, 6) AS {m}_{s}" for m in _METRICS for s in ("with", "without", "delta"))


@fx.memo_plan
def _per_tag(spark, sf_dir):
    return M.per_tag(mt_flat(spark, sf_dir), CFG)


@query("per_tag", with_views(f"SELECT lang, phenomenon, model, n_with, n_without, {_PT_OUT} FROM per_tag",
                             "per_tag"))
def q_per_tag(spark, sf_dir):
    pt = _per_tag(spark, sf_dir)
    return _r6(pt, tuple(f"{m}_{s}" for m in _METRICS for s in ("with", "without", "delta")))


_R6_COLS = ", ".join(f"round(max(CASE WHEN model = '{m}' THEN chrf_delta END), 6) AS {m}" for m in CFG.models)


@query("per_tag_pivot", with_views(f"""
SELECT lang, phenomenon, {_R6_COLS} FROM per_tag GROUP BY lang, phenomenon
HAVING count(chrf_delta) > 0""", "per_tag"))
def q_per_tag_pivot(spark, sf_dir):
    p = R.per_tag_pivot(_per_tag(spark, sf_dir), CFG.models, "chrf_delta")
    return _r6(p, CFG.models)


@query("flag_deltas", with_views("""
SELECT lang, phenomenon, model, round(chrf_delta, 6) AS chrf_delta,
 CASE WHEN chrf_delta < -3 THEN 'drop' WHEN chrf_delta > 3 THEN 'gain'
      WHEN chrf_delta IS NOT NULL THEN 'neutral' END AS delta_class FROM per_tag""", "per_tag"))
def q_flag_deltas(spark, sf_dir):
    pt = _per_tag(spark, sf_dir)
    return pt.select("lang", "phenomenon", "model", F.round("chrf_delta", 6).alias("chrf_delta"),
                     M.flag_mt_delta(F.col("chrf_delta")).alias("delta_class"))


# -- M3 / M4 -----------------------------------------------------------------------------------
@query("pearson_r", with_views("""
SELECT lang, CAST(count(*) AS BIGINT) AS n,
 round(covar_samp(chrf, comet) / nullif(stddev_samp(chrf) * stddev_samp(comet), 0), 6) AS r
FROM mt_flat WHERE chrf IS NOT NULL AND comet IS NOT NULL GROUP BY lang""", "mt_flat"))
def q_pearson_r(spark, sf_dir):
    r = G.pearson_r(mt_flat(spark, sf_dir), "chrf", "comet", ("lang",), with_p=False)
    return r.select("lang", "n", F.round("r", 6).alias("r"))


@query("pearson_p", with_views(f"""
SELECT lang, n, round(r, 6) AS r, round({G.sql_p("r", "n")}, 6) AS p
FROM (SELECT lang, CAST(count(*) AS BIGINT) AS n,
       covar_samp(chrf, length_ratio) / nullif(stddev_samp(chrf) * stddev_samp(length_ratio), 0) AS r
      FROM length_scores GROUP BY lang) x""", "length_scores"))
def q_pearson_p(spark, sf_dir):
    """r of chrF with the length ratio of both texts, and its two-sided p value."""
    x = mt_flat(spark, sf_dir).select("id", "lang", "model", "chrf").join(
        fx.mt_pairs(spark, sf_dir).select("id", "model", "hyp", "ref"), ["id", "model"])
    ratio = F.length("hyp").cast("double") / F.greatest(F.length("ref"), F.lit(1))
    r = G.pearson_r(x.select("lang", "chrf", ratio.alias("length_ratio")), "chrf", "length_ratio", ("lang",))
    return r.select("lang", "n", F.round("r", 6).alias("r"), F.round("p", 6).alias("p"))


_AG_PAIRS = [(a, b) for a in _METRICS for b in _METRICS]
_AG_SQL = " UNION ALL ".join(
    f"SELECT '{a}' AS metric_a, '{b}' AS metric_b, "
    + (f"CASE WHEN stddev_samp({a}) > 0 THEN 1.0 END" if a == b else
       f"round(covar_samp({a}, {b}) / nullif(stddev_samp({a}) * stddev_samp({b}), 0), 6)")
    + " AS r, CAST(count(*) AS BIGINT) AS n FROM complete HAVING count(*) >= 5" for a, b in _AG_PAIRS)


@query("metric_agreement", with_views(
    "WITH complete AS (SELECT * FROM mt_flat WHERE chrf IS NOT NULL AND comet IS NOT NULL "
    "AND adequacy IS NOT NULL AND fluency IS NOT NULL) " + _AG_SQL, "mt_flat"))
def q_metric_agreement(spark, sf_dir):
    return G.metric_agreement(mt_flat(spark, sf_dir)).withColumn("r", F.round("r", 6))
