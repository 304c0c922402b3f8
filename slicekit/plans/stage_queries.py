"""Stages that keep their state in written tables: lazy quota sampling (N4), the ledger of
attempts (E2) and reports updated from changed cells (S7)."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import cube as Q
from ..operators import enrich as E
from ..operators import mt as M
from ..operators import parse as PA
from ..operators import reshape as R
from ..operators import slices as S
from ..session import scratch_path
from ..sources.checkpoint import StageStore
from ..streaming import increments as I
from ..streaming import ledger as L
from ..streaming.quota import lazy_quota_sample
from . import fixtures as fx
from . import mt_reports, qa_reports
from .compare_reports import BUCKETS
from .fixtures import CONFIG as CFG
from .fixtures import with_views
from .registry import query
from .userfns import surface_tag_fn

# -- N4, lazily ---------------------------------------------------------------------------------
LAZY_QUOTA, LAZY_BATCH = 40, 16
_REQUIRED = ("newline", "long", "pipe")
_SURFACE = {"newline": "contains(text, chr(10))", "pipe": "contains(text, ' | ')", "email": "contains(text, '@')",
            "long": "length(text) > 1500"}
_HIT = lambda t, p: f"CASE {p} " + " ".join(f"WHEN '{k}' THEN {t}t_{k}" for k in _SURFACE) + " END"

fx.register_sql("lazy_quota", f"""
WITH base AS (SELECT i.id, i.lang, i.tagged, d.source, regexp_matches(d.text, '\\S') AS taggable,
    {", ".join(f"{e.replace('text', 'd.text')} AS t_{p}" for p, e in _SURFACE.items())},
    i.t_newline AS e_newline, i.t_pipe AS e_pipe, i.t_long AS e_long FROM items i JOIN documents d ON d.doc_id = i.doc_id),
ex AS (SELECT * FROM base WHERE tagged AND source = 'src1'),
pos AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY md5('42:' || id), id) AS pos
        FROM base WHERE id NOT IN (SELECT id FROM ex) AND lang IN {fx.LANGS_SQL}),
grid AS (SELECT l.lang, r.phenomenon FROM {fx.sql_values('lang', CFG.lang_codes)} l CROSS JOIN {fx.sql_values('phenomenon', _REQUIRED)} r),
need AS (SELECT g.lang, g.phenomenon, {LAZY_QUOTA} - count(e.id) FILTER (WHERE CASE g.phenomenon
           WHEN 'newline' THEN e.e_newline WHEN 'pipe' THEN e.e_pipe ELSE e.e_long END) AS need
         FROM grid g LEFT JOIN ex e ON e.lang = g.lang GROUP BY ALL),
occ AS (SELECT p.lang, g.phenomenon, p.pos, row_number() OVER (PARTITION BY p.lang, g.phenomenon ORDER BY p.pos) AS rn
        FROM pos p JOIN grid g ON g.lang = p.lang WHERE p.taggable AND {_HIT('p.', 'g.phenomenon')}),
thr AS (SELECT n.lang, n.phenomenon, CASE WHEN n.need <= 0 THEN 0 ELSE coalesce(o.pos, 1000000000) END AS thr
        FROM need n LEFT JOIN occ o ON o.lang = n.lang AND o.phenomenon = n.phenomenon AND o.rn = n.need),
stp AS (SELECT lang, ceil(max(thr) / {float(LAZY_BATCH)}) * {LAZY_BATCH} AS stop FROM thr GROUP BY lang)
SELECT p.id, p.lang, CAST(p.pos AS BIGINT) AS pos, CASE WHEN p.taggable THEN 'ok' ELSE 'error' END AS status,
 p.taggable AND (p.t_email OR EXISTS (SELECT 1 FROM thr t WHERE t.lang = p.lang AND p.pos <= t.thr AND {_HIT('p.', 't.phenomenon')})) AS accepted
FROM pos p JOIN stp s ON s.lang = p.lang WHERE p.pos <= s.stop""", ("items",))


@query("lazy_quota_sample", with_views("SELECT * FROM lazy_quota", "lazy_quota"))
def q_lazy_quota_sample(spark, sf_dir):
    """Every candidate that was tagged, in waves up to the batch that fills the buckets, and whether it was accepted."""
    it = fx.items(spark, sf_dir)
    docs = fx.table(spark, sf_dir, "documents").filter("source = 'src1'").select("doc_id")
    existing = it.filter("tags IS NOT NULL").join(docs, "doc_id", "left_semi").select("id", "lang", "tags")

    def tag(rows):
        out = E.enrich_missing(rows.select("id", "lang", "_pos", "context"), surface_tag_fn, "tags_json string", ["id", "lang", "_pos"])
        return out.withColumn("tags", F.from_json("tags_json", "linguistic_phenomena array<string>"))

    store = StageStore(spark, scratch_path(spark, "quota"))
    out = lazy_quota_sample(store, "items", it.select("id", "lang", "context"), existing, BUCKETS, LAZY_QUOTA, tag, LAZY_BATCH)
    return out.select("id", "lang", F.col("_pos").alias("pos"), "status", "accepted")


# -- E2 --------------------------------------------------------------------------------------------
# four events record the replies to one request: the k-th attempt gets the k-th of them
_TXT = "regexp_extract(reply, '(?s)\\{.*\\}', 0)"
fx.register_sql("attempt_replies", f"""
SELECT event_id // 4 AS request_id, event_id % 4 + 1 AS attempt, ok, CASE WHEN ok THEN TRY_CAST(json_extract(txt, '$.k') AS BIGINT) END AS k,
 CASE WHEN txt = '' THEN 'no JSON object' WHEN NOT ok THEN 'invalid JSON' END AS error
FROM (SELECT event_id, {_TXT} AS txt, {_TXT} <> '' AND json_valid({_TXT}) AS ok FROM replies) a""", ("replies",))


def _attempts_sql(tries: int, last: str, fallback: str) -> str:
    return with_views(f"""
SELECT r.request_id, r.attempt, CASE WHEN a.ok THEN 'ok' ELSE '{last}' END AS status,
 CASE WHEN a.ok THEN a.k ELSE {fallback} END AS k, CASE WHEN a.ok THEN NULL WHEN a.request_id IS NULL THEN 'no reply' ELSE a.error END AS error
FROM (SELECT request_id, CAST(coalesce(min(attempt) FILTER (ok AND attempt <= {tries}), {tries}) AS INTEGER) AS attempt
      FROM attempt_replies GROUP BY request_id) r
LEFT JOIN attempt_replies a ON a.request_id = r.request_id AND a.attempt = r.attempt""", "attempt_replies")


def _attempts(spark, sf_dir, policy: L.RetryPolicy):
    recorded = fx.replies(spark, sf_dir).select(F.floor(F.col("event_id") / 4).alias("request_id"),
                                                (F.col("event_id") % 4 + 1).cast("int").alias("attempt"), "reply")
    schema = T.StructType([T.StructField("k", T.LongType())])

    def accept(rows):
        x = PA.extract_json_strict(rows, "reply", schema)
        return x.select("request_id", F.col("parsed.k").alias("k"), F.when(F.col("status") == "ok", "ok").otherwise("rejected").alias("status"),
                        "error")

    out = L.run_attempts(StageStore(spark, scratch_path(spark, "ledger")), "replies", recorded.select("request_id").distinct(),
                         lambda rows: rows.join(recorded, ["request_id", "attempt"]), accept, ["request_id"], ["k"], policy)
    return out.select("request_id", "attempt", "status", "k", "error")


@query("enrich_with_retry", _attempts_sql(3, "failed", "NULL"))
def q_enrich_with_retry(spark, sf_dir):
    """Requests tried up to three times: replies that the parser rejects are asked for again."""
    return _attempts(spark, sf_dir, L.RetryPolicy(3))


@query("retry_with_fallback", _attempts_sql(2, "fallback", "0"))
def q_retry_with_fallback(spark, sf_dir):
    """The same with two tries, after which a fixed value stands for the reply."""
    return _attempts(spark, sf_dir, L.RetryPolicy(2, wait_on_reject=False, fallback={"k": 0}))


# -- S7: reports from changed cells ------------------------------------------------------------------
# a later judge: cells without a verdict, and those whose answer ends in 07, are right if its number is under 500
_REJUDGED = "(c.correct IS NULL OR c.prediction LIKE '%07')"
_LATER = f"CASE WHEN {_REJUDGED} THEN CAST(CAST(substr(c.prediction, 5) AS INTEGER) < 500 AS INTEGER) ELSE c.correct END"
fx.register_sql("scored_later", f"""
SELECT c.id, c.lang, c.dataset, c.model, c.condition, {_LATER} AS correct,
 i.tagged, i.t_newline, i.t_pipe, i.t_email, i.t_long, i.paraphrase_distance, i.domain
FROM cells c JOIN items i ON c.id = i.id""", ("cells", "items"))
_CELL = ["id", "model", "condition"]


def _updated_cube(spark, sf_dir):
    store = StageStore(spark, scratch_path(spark, "increments"))
    payload = ["prediction", "verdict", "reason", "correct"]
    I.write_table(store, "cells", fx.cells(spark, sf_dir))
    cube = I.CubeTable(store, "qa_cube")
    cube.start(Q.qa_cube(R.flatten_all(I.current(store, "cells"), None, CFG), CFG))
    number = F.substr("prediction", F.lit(5)).cast("int")
    results = I.current(store, "cells").filter(F.col("correct").isNull() | F.col("prediction").endswith("07")).select(
        *_CELL, "prediction", F.when(number < 500, "correct").otherwise("incorrect").alias("verdict"), F.lit("later").alias("reason"),
        (number < 500).alias("correct"), F.lit("ok").alias("status"), F.lit(None).cast("string").alias("error"))
    version = I.upsert_with_changes(store, "cells", results, _CELL, payload)
    I.apply_cell_changes(cube, "cells", version, CFG)
    return Q.as_flat(cube.read(), CFG)


@query("incremental_accuracy", with_views(
    qa_reports.A1_SQL[qa_reports.A1_SQL.index("SELECT dataset"):].replace("FROM scored", "FROM scored_later"), "scored_later"))
def q_incremental_accuracy(spark, sf_dir):
    """Accuracy by benchmark from the cube after a later judge's verdicts, of which only the changed cells were read."""
    return S.accuracy_by_benchmark(_updated_cube(spark, sf_dir), CFG)


fx.register_sql("ph_counts_later", fx.SQL["ph_counts"].replace("FROM scored", "FROM scored_later"), ("scored_later",))


@query("incremental_phenomenon", with_views(fx.SQL["by_phenomenon"].replace("ph_counts", "ph_counts_later"), "ph_counts_later"))
def q_incremental_phenomenon(spark, sf_dir):
    """Accuracy with and without each tag from the same updated cube."""
    return S.accuracy_by_phenomenon(_updated_cube(spark, sf_dir), CFG)


# a second metric run fills the missing comet values by the ratio of the lengths
fx.register_sql("mt_flat_later", """
SELECT f.* REPLACE (coalesce(f.comet, least(length(p.hyp), length(p.ref)) / CAST(greatest(length(p.hyp), length(p.ref), 1) AS DOUBLE)) AS comet)
FROM mt_flat f JOIN mt_pairs p ON p.id = f.id AND p.model = f.model""", ("mt_flat", "mt_pairs"))


@query("incremental_system_level", with_views("""
SELECT lang, model, CAST(count(*) AS BIGINT) AS n, CAST(count(comet) AS BIGINT) AS n_comet, round(avg(chrf), 6) AS chrf,
 round(avg(comet), 6) AS comet FROM mt_flat_later WHERE lang IN ('de','en','fr') GROUP BY ALL""", "mt_flat_later"))
def q_incremental_system_level(spark, sf_dir):
    """System-level means after missing metric values came in, from a cube that read only those rows."""
    store = StageStore(spark, scratch_path(spark, "increments"))
    metrics = ["chrf", "comet", "adequacy", "fluency"]
    pairs = fx.mt_pairs(spark, sf_dir)
    I.write_table(store, "scores", mt_reports.mt_flat(spark, sf_dir).withColumn("status", F.lit("ok")))
    cube = I.CubeTable(store, "mt_cube")
    cube.start(Q.mt_cube(I.current(store, "scores"), CFG))
    longer = F.greatest(F.length("hyp"), F.length("ref"), F.lit(1)).cast("double")
    results = I.current(store, "scores").filter("comet IS NULL").drop("comet", "lang", "phenomena").join(
        pairs.select("id", "model", "hyp", "ref"), ["id", "model"]) \
        .withColumn("comet", F.least(F.length("hyp"), F.length("ref")) / longer).select("id", "model", *metrics, "status")
    version = I.upsert_with_changes(store, "scores", results, ["id", "model"], metrics)
    before, after = I.changes(store, "scores", version)
    cube.apply(version, before, after, lambda rows: Q.mt_cube(rows, CFG, sign="sign"))
    out = M.system_level(Q.as_flat(cube.read(), CFG), CFG)
    return out.select("lang", "model", "n", "n_comet", F.round("chrf", 6).alias("chrf"), F.round("comet", 6).alias("comet"))
