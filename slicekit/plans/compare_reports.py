"""Sampling and comparison queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import agree as G
from ..operators import compare as X
from ..operators import mt as M
from ..operators import prep as P
from ..operators import reshape as R
from ..operators import sample as N
from ..operators import slices as S
from . import fixtures as fx
from . import mt_reports, qa_reports  # noqa: F401  (registers the SQL views used below)
from .fixtures import CONFIG as CFG
from .fixtures import with_views
from .registry import query

QUOTA, BATCH = 8, 32
BUCKETS = {s.lang: (s.required, s.bonus) for s in CFG.langs}


@fx.memo_plan
def _flat(spark, sf_dir):
    it = fx.items(spark, sf_dir)
    return R.flatten_all(fx.cells(spark, sf_dir), it, CFG)


# -- N1 / N2 / N3 -----------------------------------------------------------------------
fx.register_sql("seeded", """
SELECT doc_id, dataset, printf('%s_%04d', dataset, rn - 1) AS id, rn - 1 AS position
FROM (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY md5('42:' || id), id) AS rn FROM items) x
WHERE rn <= 25""", ("items",))


@query("seeded_sample", with_views("SELECT doc_id, dataset, id, CAST(position AS INTEGER) AS position FROM seeded",
                                   "seeded"))
def q_seeded_sample(spark, sf_dir):
    s = N.seeded_sample(fx.items(spark, sf_dir), 25, seed=42, by="dataset", id_prefix_col="dataset")
    return s.select("doc_id", "dataset", "id", "position")


@query("take_first_n", "SELECT doc_id, lang FROM documents ORDER BY doc_id LIMIT 50")
def q_take_first_n(spark, sf_dir):
    return N.take_first_n(fx.table(spark, sf_dir, "documents").select("doc_id", "lang"), 50, "doc_id")


_TARGETS = {d: 150 for d in CFG.datasets} | {"xx_native": 150}


@query("sample_shortfall", with_views(
    "SELECT t.dataset, 150 AS requested, CAST(coalesce(c.n, 0) AS BIGINT) AS obtained, "
    "CAST(greatest(150 - coalesce(c.n, 0), 0) AS BIGINT) AS shortfall FROM "
    + fx.sql_values("dataset", tuple(_TARGETS)) + " t LEFT JOIN (SELECT dataset, count(*) AS n FROM "
    "(SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY md5('42:' || id), id) AS rn FROM items) x "
    "WHERE rn <= 150 GROUP BY dataset) c ON c.dataset = t.dataset", "items"))
def q_sample_shortfall(spark, sf_dir):
    s = N.seeded_sample(fx.items(spark, sf_dir), 150, seed=42, by="dataset")
    r = N.sample_shortfall(s, _TARGETS, spark)
    return r.select("dataset", "requested", F.col("obtained").cast("bigint").alias("obtained"),
                    F.col("shortfall").cast("bigint").alias("shortfall"))


# -- N4 / N5 ---------------------------------------------------------------------------------
def _existing(spark, sf_dir, it):
    docs = fx.table(spark, sf_dir, "documents").filter(F.col("source") == "src0").select("doc_id")
    return it.join(docs, "doc_id", "left_semi")


def _quota(spark, sf_dir):
    it = fx.items(spark, sf_dir).select("doc_id", "id", "lang", "tags")
    ex = _existing(spark, sf_dir, it)
    return N.quota_sample(it, ex, BUCKETS, QUOTA, spark, batch_size=BATCH, seed=42), ex


_HAS = {p: f"t_{p}" for p in fx.PH}
fx.register_sql("quota", f"""
WITH ex_ids AS (SELECT i.* FROM items i JOIN documents d ON d.doc_id = i.doc_id WHERE d.source = 'src0'),
cand AS (SELECT i.*, md5('42:' || i.id) AS k FROM items i WHERE i.id NOT IN (SELECT id FROM ex_ids)),
pos AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY k, id) AS pos FROM cand),
req AS (SELECT * FROM (VALUES ('newline'),('long'),('pipe')) t(phenomenon)),
grid AS (SELECT l.lang, r.phenomenon FROM {fx.sql_values('lang', CFG.lang_codes)} l CROSS JOIN req r),
exc AS (SELECT g.lang, g.phenomenon,
          count(e.id) FILTER (WHERE {fx.sql_has('g.phenomenon').replace('THEN t_', 'THEN e.t_')}) AS n
        FROM grid g LEFT JOIN ex_ids e ON e.lang = g.lang GROUP BY ALL),
need AS (SELECT lang, phenomenon, {QUOTA} - n AS need FROM exc),
occ AS (SELECT p.lang, r.phenomenon, p.pos,
          row_number() OVER (PARTITION BY p.lang, r.phenomenon ORDER BY p.pos) AS rn
        FROM pos p CROSS JOIN req r WHERE {fx.sql_has('r.phenomenon').replace('THEN t_', 'THEN p.t_')}),
thr AS (SELECT n.lang, n.phenomenon, CASE WHEN n.need <= 0 THEN 0 ELSE coalesce(
          (SELECT o.pos FROM occ o WHERE o.lang = n.lang AND o.phenomenon = n.phenomenon AND o.rn = n.need),
          1000000000) END AS thr FROM need n),
stp AS (SELECT lang, CASE WHEN max(thr) >= 1000000000 THEN 1000000000
                          ELSE CAST(ceil(max(thr) / {float(BATCH)}) * {BATCH} AS BIGINT) END AS stop,
          max(CASE WHEN phenomenon = 'newline' THEN thr END) AS t_nl,
          max(CASE WHEN phenomenon = 'long' THEN thr END) AS t_lg,
          max(CASE WHEN phenomenon = 'pipe' THEN thr END) AS t_pp FROM thr GROUP BY lang)
SELECT p.id, p.lang FROM pos p JOIN stp s ON s.lang = p.lang
WHERE p.tagged AND p.pos <= s.stop AND ((p.t_newline AND p.pos <= s.t_nl) OR (p.t_long AND p.pos <= s.t_lg)
      OR (p.t_pipe AND p.pos <= s.t_pp) OR p.t_email)""", ("items",))


@query("quota_sample", with_views("SELECT id, lang FROM quota", "quota"))
def q_quota_sample(spark, sf_dir):
    acc, _ = _quota(spark, sf_dir)
    return acc.select("id", "lang")


@query("bucket_report", with_views(f"""
WITH ex_ids AS (SELECT i.* FROM items i JOIN documents d ON d.doc_id = i.doc_id WHERE d.source = 'src0'),
allx AS (SELECT lang, t_newline, t_pipe, t_email, t_long, 1 AS is_ex FROM ex_ids
         UNION ALL SELECT i.lang, i.t_newline, i.t_pipe, i.t_email, i.t_long, 0 FROM items i JOIN quota q ON q.id = i.id),
grid AS (SELECT l.lang, b.phenomenon, b.phenomenon <> 'email' AS required
         FROM {fx.sql_values('lang', CFG.lang_codes)} l CROSS JOIN {fx.sql_values('phenomenon', ('newline', 'long', 'pipe', 'email'))} b)
SELECT g.lang, g.phenomenon, g.required,
 CAST(count(a.lang) FILTER (WHERE a.is_ex = 1 AND {fx.sql_has('g.phenomenon').replace('THEN t_', 'THEN a.t_')}) AS BIGINT) AS existing,
 CAST(count(a.lang) FILTER (WHERE {fx.sql_has('g.phenomenon').replace('THEN t_', 'THEN a.t_')}) AS BIGINT) AS final,
 count(a.lang) FILTER (WHERE {fx.sql_has('g.phenomenon').replace('THEN t_', 'THEN a.t_')}) >= {QUOTA} AS met
FROM grid g LEFT JOIN allx a ON a.lang = g.lang GROUP BY g.lang, g.phenomenon, g.required""", "quota"))
def q_bucket_report(spark, sf_dir):
    acc, ex = _quota(spark, sf_dir)
    return N.bucket_report(acc, ex, BUCKETS, QUOTA, spark)


# -- J7 -----------------------------------------------------------------------------------------
CROSS_SQL = """
WITH qa AS (SELECT s.lang, r.phenomenon, s.model, count(*) AS n_qa, sum(s.correct) AS k_qa
            FROM scored s CROSS JOIN (VALUES ('newline'),('long'),('pipe')) r(phenomenon)
            WHERE s.condition = 'openbook' AND s.dataset = s.lang || '_native' AND s.lang IN ('de','en','fr')
              AND CASE r.phenomenon WHEN 'newline' THEN s.t_newline WHEN 'long' THEN s.t_long ELSE s.t_pipe END
            GROUP BY ALL),
mt AS (SELECT lang, phenomenon, model, count(*) AS n_mt, avg(chrf) AS mt_chrf FROM
         (SELECT f.*, r.phenomenon FROM mt_flat f CROSS JOIN (VALUES ('newline'),('long'),('pipe')) r(phenomenon)
          WHERE CASE r.phenomenon WHEN 'newline' THEN f.t_newline WHEN 'long' THEN f.t_long ELSE f.t_pipe END) x
       GROUP BY ALL)
SELECT qa.lang, qa.phenomenon, qa.model, round(CAST(k_qa AS DOUBLE) * 100 / n_qa, 6) AS qa_acc,
 round(mt_chrf, 6) AS mt_chrf, CAST(n_qa AS BIGINT) AS n_qa, CAST(n_mt AS BIGINT) AS n_mt
FROM qa JOIN mt ON qa.lang = mt.lang AND qa.phenomenon = mt.phenomenon AND qa.model = mt.model
WHERE n_qa >= 5 AND mt_chrf IS NOT NULL"""


@query("cross_task", with_views(CROSS_SQL, "scored", "mt_flat"))
def q_cross_task(spark, sf_dir):
    ct = X.cross_task(_flat(spark, sf_dir), mt_reports.mt_flat(spark, sf_dir), CFG)
    return ct.select("lang", "phenomenon", "model", F.round("qa_acc", 6).alias("qa_acc"),
                     F.round("mt_chrf", 6).alias("mt_chrf"), "n_qa", "n_mt")


# -- A17 / P7 ---------------------------------------------------------------------------------------
fx.register_sql("audit", """
SELECT id, max(dataset) AS dataset, CAST(count(DISTINCT model) AS BIGINT) AS n_models FROM cells
WHERE condition = 'closedbook' AND correct IS NOT NULL GROUP BY id
HAVING count(DISTINCT model) = 4 AND bool_and(correct = 0)""", ("cells",))


@query("gold_audit", with_views("SELECT * FROM audit", "audit"))
def q_gold_audit(spark, sf_dir):
    it = fx.items(spark, sf_dir)
    return X.gold_audit(fx.cells(spark, sf_dir), CFG, condition="closedbook")


@query("exclude_bad_gold", with_views("""
SELECT dataset, condition, model, CAST(count(*) AS BIGINT) AS n,
 round_even(CAST(sum(correct) AS DOUBLE) / count(*) * 100, 1) AS accuracy_pct
FROM scored WHERE id NOT IN (SELECT id FROM audit) GROUP BY ALL""", "scored", "audit"))
def q_exclude_bad_gold(spark, sf_dir):
    it = fx.items(spark, sf_dir)
    cells = fx.cells(spark, sf_dir)
    bad = X.gold_audit(cells, CFG, condition="closedbook").select("id")
    flat = R.flatten_all(P.exclude_ids(cells, bad), it, CFG)
    return S.accuracy_by_benchmark(flat, CFG, ordered=False)


# -- A18 / A19 / A21 / A22 ------------------------------------------------------------------------------
@query("local_share", with_views("""
SELECT lang, native_pct, translated_pct, translated_pct - native_pct AS delta_pp FROM (
 SELECT lang,
  max(CASE WHEN dataset LIKE '%\\_native' ESCAPE '\\' THEN CAST(dom_local_history + dom_local_geography AS DOUBLE) * 100 / n END) AS native_pct,
  max(CASE WHEN dataset LIKE '%\\_translated' ESCAPE '\\' THEN CAST(dom_local_history + dom_local_geography AS DOUBLE) * 100 / n END) AS translated_pct
 FROM coverage GROUP BY lang) x WHERE native_pct IS NOT NULL AND translated_pct IS NOT NULL""", "coverage"))
def q_local_share(spark, sf_dir):
    return X.local_share(S.coverage(fx.items(spark, sf_dir), CFG), CFG)


@query("closed_book_gap", with_views("""
SELECT lang, model, native_acc, translated_acc, translated_acc - native_acc AS delta_pp FROM (
 SELECT lang, model,
  CAST(sum(CASE WHEN dataset LIKE '%\\_native' ESCAPE '\\' THEN correct END) AS DOUBLE)
    / nullif(count_if(dataset LIKE '%\\_native' ESCAPE '\\'), 0) * 100 AS native_acc,
  CAST(sum(CASE WHEN dataset LIKE '%\\_translated' ESCAPE '\\' THEN correct END) AS DOUBLE)
    / nullif(count_if(dataset LIKE '%\\_translated' ESCAPE '\\'), 0) * 100 AS translated_acc
 FROM scored WHERE condition = 'closedbook' AND lang IN ('de','en','es','fr') GROUP BY ALL) x""", "scored"))
def q_closed_book_gap(spark, sf_dir):
    return X.closed_book_gap(_flat(spark, sf_dir), CFG)


@query("inference_gap", with_views("""
SELECT lang, dataset, model, literal_acc, inference_acc, inference_acc - literal_acc AS gap_pp, n_literal, n_inference
FROM (SELECT lang, dataset, model,
  CAST(sum(CASE WHEN paraphrase_distance = 'literal_match' THEN correct END) AS DOUBLE)
    / nullif(count_if(paraphrase_distance = 'literal_match'), 0) * 100 AS literal_acc,
  CAST(sum(CASE WHEN paraphrase_distance = 'requires_inference' THEN correct END) AS DOUBLE)
    / nullif(count_if(paraphrase_distance = 'requires_inference'), 0) * 100 AS inference_acc,
  CAST(count_if(paraphrase_distance = 'literal_match') AS BIGINT) AS n_literal,
  CAST(count_if(paraphrase_distance = 'requires_inference') AS BIGINT) AS n_inference
 FROM scored WHERE condition = 'openbook' AND lang IN ('de','en','es','fr') GROUP BY ALL) x""", "scored"))
def q_inference_gap(spark, sf_dir):
    return X.inference_gap(_flat(spark, sf_dir))


@query("hardest_feature", with_views("""
WITH qa AS (SELECT lang, phenomenon, avg(delta) AS mean_delta, min(delta) AS min_delta, max(delta) AS max_delta,
              count(*) AS n_models FROM by_phenomenon
            WHERE dataset = lang || '_native' AND n_with >= 1 AND n_without >= 1 AND delta IS NOT NULL GROUP BY ALL),
mt AS (SELECT lang, phenomenon, avg(chrf_delta) AS mean_delta, min(chrf_delta) AS min_delta,
         max(chrf_delta) AS max_delta, count(*) AS n_models FROM per_tag
       WHERE n_with >= 1 AND n_without >= 1 AND chrf_delta IS NOT NULL GROUP BY ALL),
both_ AS (SELECT *, 'qa' AS task FROM qa UNION ALL SELECT *, 'mt' FROM mt)
SELECT lang, task, phenomenon, round(mean_delta, 6) AS mean_delta, round(min_delta, 6) AS min_delta,
 round(max_delta, 6) AS max_delta, CAST(n_models AS BIGINT) AS n_models
FROM (SELECT *, row_number() OVER (PARTITION BY lang, task ORDER BY mean_delta, phenomenon) AS rn FROM both_) x
WHERE rn = 1""", "by_phenomenon", "per_tag"))
def q_hardest_feature(spark, sf_dir):
    qa = S.accuracy_by_phenomenon(_flat(spark, sf_dir), CFG)
    qa = qa.filter(F.col("dataset") == CFG.native_dataset("lang"))
    mt = M.per_tag(mt_reports.mt_flat(spark, sf_dir), CFG)
    out = X.hardest_feature(qa, "qa").unionByName(X.hardest_feature(mt, "mt", delta_col="chrf_delta"))
    return out.select("lang", "task", "phenomenon", *[F.round(c, 6).alias(c) for c in
                                                     ("mean_delta", "min_delta", "max_delta")], "n_models")



# -- M3 on the cross-task table ----------------------------------------------------------------
@query("cross_task_r", with_views("""
WITH ct AS (""" + CROSS_SQL.strip() + """),
x AS (SELECT CAST(count(*) AS BIGINT) AS n,
       covar_samp(qa_acc, mt_chrf) / nullif(stddev_samp(qa_acc) * stddev_samp(mt_chrf), 0) AS r FROM ct)
SELECT n, round(r, 6) AS r, round(""" + G.sql_p("r", "n") + """, 6) AS p FROM x""", "scored", "mt_flat"))
def q_cross_task_r(spark, sf_dir):
    """Pearson r, with p, between QA accuracy and MT chrF over the (lang, phenomenon, model) points."""
    ct = X.cross_task(_flat(spark, sf_dir), mt_reports.mt_flat(spark, sf_dir), CFG)
    return G.pearson_r(ct, "qa_acc", "mt_chrf").select("n", F.round("r", 6).alias("r"), F.round("p", 6).alias("p"))
