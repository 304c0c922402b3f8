"""Build-stage queries: work lists, user-function enrichment, parsing, merges
(J3-J6, E1-E5, P10-P13, A14) over the fixture views.

The user functions here are deterministic stand-ins for model calls, chosen
so the oracle can state their result in SQL.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import sql_ustrip
from ..operators import enrich as E
from ..operators import jobs as J
from ..operators import parse as PA
from ..operators import prep as P
from ..operators.ordering import running_totals
from . import fixtures as fx
from .fixtures import CONFIG as CFG
from .fixtures import with_views
from . import mt_reports  # noqa: F401  (registers the MT views used below)
from .registry import query

_KEY = ["id", "model", "condition"]


from .userfns import infer_fn, judge_fn, length_ratio_scorer, locate_fn, translate_fn  # noqa: E402


# -- J5 / J6 ----------------------------------------------------------------------------
@query("expand_jobs", with_views("""
SELECT i.id, m.model, c.condition FROM items i CROSS JOIN models m CROSS JOIN conditions c""",
                                 "items", "models", "conditions"))
def q_expand_jobs(spark, sf_dir):
    return J.expand_jobs(fx.items(spark, sf_dir), CFG).select("id", "model", "condition")


fx.register_sql("pending_infer", """
SELECT i.id, i.question, m.model, c.condition FROM items i CROSS JOIN models m CROSS JOIN conditions c
WHERE NOT EXISTS (SELECT 1 FROM cells x WHERE x.id = i.id AND x.model = m.model AND x.condition = c.condition)""",
                ("items", "models", "conditions", "cells"))


def _pending_infer(spark, sf_dir):
    it = fx.items(spark, sf_dir)
    todo = J.pending_infer(it, fx.cells(spark, sf_dir), CFG)
    return todo.join(it.select("id", "question"), "id")


@query("pending_infer", with_views("SELECT id, model, condition FROM pending_infer", "pending_infer"))
def q_pending_infer(spark, sf_dir):
    return _pending_infer(spark, sf_dir).select("id", "model", "condition")


@query("pending_judge", with_views("SELECT id, model, condition FROM cells WHERE correct IS NULL", "cells"))
def q_pending_judge(spark, sf_dir):
    it = fx.items(spark, sf_dir)
    return J.pending_judge(fx.cells(spark, sf_dir), CFG.datasets).select("id", "model", "condition")


@query("pending_tag", with_views("SELECT id FROM items WHERE NOT tagged", "items"))
def q_pending_tag(spark, sf_dir):
    return J.pending_tag(fx.items(spark, sf_dir)).select("id")


def _partial_translations(spark, sf_dir):
    tr = fx.translations(spark, sf_dir)
    return tr.filter((F.col("item_id") + F.col("mi")) % 7 != 0)


@query("pending_translate", with_views("""
SELECT id, model FROM mt_pairs WHERE (item_id + mi) % 7 = 0""", "mt_pairs"))
def q_pending_translate(spark, sf_dir):
    return J.pending_translate(fx.mt_items(spark, sf_dir), _partial_translations(spark, sf_dir), CFG) \
        .select("id", "model")


@query("pending_metric", with_views("""
SELECT p.id, p.model FROM mt_pairs p JOIN mt_scores s ON p.id = s.id AND p.model = s.model
WHERE s.comet IS NULL AND length(p.hyp) > 0""", "mt_pairs", "mt_scores"))
def q_pending_metric(spark, sf_dir):
    from .mt_reports import mt_scores
    return J.pending_metric(fx.translations(spark, sf_dir), mt_scores(spark, sf_dir), "comet").select("id", "model")


@query("new_candidates", with_views("""
SELECT i.id FROM items i JOIN documents d ON d.doc_id = i.doc_id WHERE d.source <> 'src0'""", "items"))
def q_new_candidates(spark, sf_dir):
    it = fx.items(spark, sf_dir)
    docs = fx.table(spark, sf_dir, "documents").select("doc_id", "source")
    cached = it.join(docs.filter(F.col("source") == "src0"), "doc_id")
    return J.new_candidates(it, cached).select("id")


# -- E1 / E2 / J3 ---------------------------------------------------------------------------
@query("enrich_missing", with_views(f"""
SELECT id, model, condition,
 CASE WHEN blank THEN NULL ELSE model || ':' || question END AS prediction,
 CASE WHEN blank THEN 'error' ELSE 'ok' END AS status,
 CASE WHEN blank THEN 'ValueError: blank question' END AS error
FROM (SELECT *, {sql_ustrip('question')} = '' AS blank FROM pending_infer) p""", "pending_infer"))
def q_enrich_missing(spark, sf_dir):
    work = _pending_infer(spark, sf_dir)
    return E.enrich_missing(work, infer_fn, "prediction string", _KEY)


def _judged(cells):
    work = J.pending_judge(cells, CFG.datasets).select(*_KEY, "prediction")
    res = E.enrich_missing(work, judge_fn, "verdict string, reason string", _KEY)
    return res.select(*_KEY, "verdict", F.when(F.col("verdict").isNotNull(), F.coalesce("reason", F.lit("")))
                      .alias("reason"), (F.col("verdict") == "correct").alias("correct"), "status", "error")


@query("upsert_cells", with_views("""
SELECT id, model, condition, prediction,
 CASE WHEN correct = 1 THEN 'correct' WHEN correct = 0 THEN 'incorrect'
      WHEN length(prediction) < 7 THEN NULL WHEN CAST(substr(prediction, 5) AS INTEGER) < 500 THEN 'correct' ELSE 'incorrect' END AS verdict,
 CASE WHEN correct IS NOT NULL THEN correct = 1 WHEN length(prediction) < 7 THEN NULL
      ELSE CAST(substr(prediction, 5) AS INTEGER) < 500 END AS correct,
 'ok' AS status,
 CASE WHEN correct IS NULL AND length(prediction) < 7 THEN 'ValueError: too short to judge: ' || prediction END AS error
FROM cells""", "cells"))
def q_upsert_cells(spark, sf_dir):
    it = fx.items(spark, sf_dir)
    cells = fx.cells(spark, sf_dir).drop("lang", "dataset")
    merged = J.upsert(cells, _judged(fx.cells(spark, sf_dir)), _KEY,
                      ["prediction", "verdict", "reason", "correct"])
    return merged.select(*_KEY, "prediction", "verdict", "correct", "status", "error")


# -- P10 / P13 ---------------------------------------------------------------------------------
_JSON_TXT = "regexp_extract(reply, '(?s)\\{.*\\}', 0)"


@query("extract_json_strict", with_views(f"""
SELECT event_id,
 CASE WHEN {_JSON_TXT} <> '' AND json_valid({_JSON_TXT}) THEN TRY_CAST(json_extract({_JSON_TXT}, '$.k') AS BIGINT) END AS k,
 CASE WHEN {_JSON_TXT} <> '' AND json_valid({_JSON_TXT}) THEN 'ok' ELSE 'error' END AS status,
 CASE WHEN {_JSON_TXT} = '' THEN 'no JSON object' WHEN NOT json_valid({_JSON_TXT}) THEN 'invalid JSON' END AS error
FROM replies""", "replies"))
def q_extract_json_strict(spark, sf_dir):
    from pyspark.sql import types as T
    schema = T.StructType([T.StructField("k", T.LongType())])
    x = PA.extract_json_strict(fx.replies(spark, sf_dir), "reply", schema)
    return x.select("event_id", F.col("parsed.k").alias("k"), "status", "error")


@query("verdict_to_correct", with_views(f"""
SELECT event_id, id, v AS verdict, CASE WHEN v IS NOT NULL THEN coalesce(r, '') END AS reason,
 CASE WHEN v IS NOT NULL THEN v = 'correct' END AS correct,
 CASE WHEN v IS NOT NULL THEN 'ok' ELSE 'error' END AS status,
 CASE WHEN txt = '' THEN 'no JSON object' WHEN j IS NULL THEN 'invalid JSON'
      WHEN v IS NULL THEN 'missing verdict' END AS error
FROM (SELECT *, json_extract_string(j, '$.verdict') AS v, json_extract_string(j, '$.reason') AS r
      FROM (SELECT *, CASE WHEN txt <> '' AND json_valid(txt) THEN txt END AS j
            FROM (SELECT *, {_JSON_TXT} AS txt FROM judge_replies) a) b) x""", "judge_replies"))
def q_verdict_to_correct(spark, sf_dir):
    return PA.parse_judgements(fx.judge_replies(spark, sf_dir))


# -- E3 ------------------------------------------------------------------------------------------
@query("score_batches", with_views("""
SELECT id, model, round(CASE WHEN greatest(length(hyp), length(ref)) > 0
   THEN CAST(least(length(hyp), length(ref)) AS DOUBLE) / greatest(length(hyp), length(ref)) ELSE 0.0 END, 6) AS score,
 'ok' AS status FROM mt_pairs""", "mt_pairs"))
def q_score_batches(spark, sf_dir):
    pairs = fx.mt_pairs(spark, sf_dir).select("id", "model", "hyp", "ref")
    s = E.score_batches(pairs, length_ratio_scorer, "score double, batch_rows long", ["id", "model"], batch_size=64)
    return s.select("id", "model", F.round("score", 6).alias("score"), "status")


# -- E4 / A14 / P11 / P5 --------------------------------------------------------------------------
fx.register_sql("located", f"""
SELECT id, question, CASE WHEN found THEN word ELSE '' END AS gold, found AS span_found
FROM (SELECT id, question, word, word <> '' AND contains(body, word) AS found
      FROM (SELECT id, question, split_part(question, ' ', 2) AS word, regexp_extract(text, '(?s)^[^\\n]*\\n(.*)$', 1) AS body
            FROM (SELECT 'doc_' || CAST(doc_id AS VARCHAR) AS id, text, {sql_ustrip('split_part(text, chr(10), 1)')} AS question
                  FROM documents) a) b) c""")


def _located(spark, sf_dir):
    docs = fx.table(spark, sf_dir, "documents").select(
        "doc_id", F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("id"), "text")
    return E.translate_and_locate(docs, translate_fn, locate_fn, "id")


@query("translate_and_locate", with_views("SELECT id, question, gold, span_found, 'ok' AS status FROM located",
                                          "located"))
def q_translate_and_locate(spark, sf_dir):
    return _located(spark, sf_dir).select("id", "question", "gold", "span_found", "status")


@query("span_rate", with_views("""
SELECT CAST(count(*) AS BIGINT) AS n, CAST(count_if(span_found) AS BIGINT) AS n_found,
 100.0 * count_if(span_found) / greatest(1, count(*)) AS span_rate_pct FROM located""", "located"))
def q_span_rate(spark, sf_dir):
    from ..operators.compare import span_rate
    return span_rate(_located(spark, sf_dir))


fx.register_sql("claims", """
SELECT d.doc_id, 'doc_' || CAST(d.doc_id AS VARCHAR) AS id, d.text AS context,
 CASE d.doc_id % 4 WHEN 0 THEN split_part(d.text, ' ', 2) WHEN 1 THEN b.text WHEN 2 THEN ''
      ELSE split_part(d.text, ' ', 2) || 'x' END AS gold,
 d.doc_id % 5 <> 0 AS claimed
FROM documents d JOIN (SELECT text, row_number() OVER (ORDER BY item_id NULLS FIRST, text NULLS FIRST) - 1 AS place FROM benchmark) b
 ON b.place = d.doc_id % (SELECT nullif(count(*), 0) FROM benchmark)""")


def _claims(spark, sf_dir):
    d = fx.table(spark, sf_dir, "documents")
    bench = fx.table(spark, sf_dir, "benchmark")
    # every benchmark row meets documents, however many there are and whatever their ids
    n = F.lit(bench.count() or None).cast("long")
    b = running_totals(bench.select("item_id", F.col("text").alias("btext"), F.lit(0).alias("all")), ["all"], ["item_id", "btext"],
                       {"place": ("sum", F.lit(1).cast("long"))})
    j = d.join(b, b.place == d.doc_id % n + 1)
    k = F.col("doc_id") % 4
    gold = (F.when(k == 0, fx.second_word()).when(k == 1, F.col("btext"))
             .when(k == 2, F.lit("")).otherwise(F.concat(fx.second_word(), F.lit("x"))))
    return j.select(F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("id"),
                    F.col("text").alias("context"), gold.alias("gold"),
                    (F.col("doc_id") % 5 != 0).alias("span_found"))


@query("verify_spans", with_views("""
SELECT id, claimed AND contains(context, gold) AS span_found,
 CASE WHEN claimed AND contains(context, gold) THEN gold ELSE '' END AS gold FROM claims""", "claims"))
def q_verify_spans(spark, sf_dir):
    return P.verify_spans(_claims(spark, sf_dir)).select("id", "span_found", "gold")


@query("filter_span_found", with_views("""
SELECT id, gold FROM claims WHERE claimed AND contains(context, gold)""", "claims"))
def q_filter_span_found(spark, sf_dir):
    return P.filter_span_found(P.verify_spans(_claims(spark, sf_dir))).select("id", "gold")


# -- E5 -------------------------------------------------------------------------------------------
RULES = {lg: [("newline", "\n"), ("pipe", r" \| "), ("email", "@"), ("long", r"(?s)^.{1501}")]
         for lg in CFG.lang_codes}


@query("tag_by_rules", with_views("""
SELECT i.id, concat_ws(',', CASE WHEN contains(d.text, chr(10)) THEN 'newline' END,
   CASE WHEN contains(d.text, ' | ') THEN 'pipe' END, CASE WHEN contains(d.text, '@') THEN 'email' END,
   CASE WHEN length(d.text) > 1500 THEN 'long' END) AS phenomena,
 CASE WHEN contains(i.context, i.gold) THEN 'literal_match' ELSE 'paraphrase' END AS paraphrase_distance
FROM items i JOIN documents d ON d.doc_id = i.doc_id""", "items"))
def q_tag_by_rules(spark, sf_dir):
    it = fx.items(spark, sf_dir).drop("tags")
    t = E.tag_by_rules(it, RULES, "context", gold="gold", context="context")
    return t.select("id", F.array_join("tags.linguistic_phenomena", ",").alias("phenomena"),
                    F.col("tags.paraphrase_distance").alias("paraphrase_distance"))

