"""Preparation, reshaping and IO queries (P1-P4, P6, P8, P9, P12, P14-P16,
P19, J1, J2, J8, U1-U3, R9, R10, S1, S3-S7) over the fixture views."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.tags import has_tag, mt_phenomena, qa_phenomena
from ..functions.text import sql_ustrip
from ..operators import cube as Q
from ..operators import mt as M
from ..operators import prep as P
from ..operators import reshape as R
from ..operators import slices as S
from ..session import materialize, scratch_path
from ..sources import checkpoint as CK
from ..sources import corpus as CO
from ..sources import jsonl as IO
from ..sources import sinks as SK
from . import fixtures as fx
from . import mt_reports, qa_reports  # noqa: F401  (registers SQL views)
from .fixtures import CONFIG as CFG
from .fixtures import with_views
from .registry import query
from .userfns import rule_tag_fn


# -- P1 ------------------------------------------------------------------------------------
@query("normalize_items", f"""
SELECT 'conv_' || replace(CAST(conv_id AS VARCHAR) || '/' || CAST(turn AS VARCHAR), '/', '_') AS id,
 'conv' AS dataset, role AS lang, {sql_ustrip('text')} AS text FROM conversations""")
def q_normalize_items(spark, sf_dir):
    c = fx.table(spark, sf_dir, "conversations")
    c = c.withColumn("src_id", F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string")))
    return P.normalize_items(c, "conv", F.col("role"), "src_id", ("text",))


# -- P2 / P3 / P4 ---------------------------------------------------------------------------
fx.register_sql("answer_src", """
SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN []::VARCHAR[] WHEN 1 THEN [' ' || chr(160)]
  ELSE [split_part(text, ' ', 2), split_part(text, ' ', 1)] END AS answers_text FROM documents""")


def _answer_src(spark, sf_dir):
    d = fx.table(spark, sf_dir, "documents")
    k = F.col("doc_id") % 5
    arr = (F.when(k == 0, F.array().cast("array<string>"))
            .when(k == 1, F.array(F.lit("  ")))
            .otherwise(F.array(fx.second_word(), F.split_part(F.col("text"), F.lit(" "), F.lit(1)))))
    return d.select("doc_id", F.struct(arr.alias("text")).alias("answers"))


@query("first_answer", with_views("SELECT doc_id, coalesce(answers_text[1], '') AS gold FROM answer_src",
                                  "answer_src"))
def q_first_answer(spark, sf_dir):
    return _answer_src(spark, sf_dir).select("doc_id", P.first_answer("answers").alias("gold"))


@query("filter_has_answer", with_views(
    f"SELECT doc_id FROM answer_src WHERE coalesce({sql_ustrip('answers_text[1]')}, '') <> ''", "answer_src"))
def q_filter_has_answer(spark, sf_dir):
    return P.filter_has_answer(_answer_src(spark, sf_dir)).select("doc_id")


@query("filter_answerable", """
SELECT d.doc_id FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
WHERE coalesce(CASE d.doc_id % 6 WHEN 0 THEN '' WHEN 1 THEN NULL ELSE split_part(d.text, ' ', 2) END, '') <> ''
  AND (l.doc_id IS NULL OR l.toxic <> 1)""")
def q_filter_answerable(spark, sf_dir):
    d = fx.table(spark, sf_dir, "documents")
    lab = fx.table(spark, sf_dir, "labels").select("doc_id", "toxic")
    k = F.col("doc_id") % 6
    src = d.join(lab, "doc_id", "left").select(
        "doc_id",
        F.when(k == 0, F.lit("")).when(k == 1, F.lit(None).cast("string"))
         .otherwise(fx.second_word()).alias("answer"),
        F.when(F.col("toxic").isNull(), F.lit(None).cast("string"))
         .when(F.col("toxic") == 1, F.lit("UNANSWERABLE")).otherwise(F.lit("FACTOID")).alias("category"))
    return P.filter_answerable(src).select("doc_id")


# -- P6 / P8 / J8 / P14 / P15 ----------------------------------------------------------------------
@query("filter_id_prefix", "SELECT page_id, url FROM pages WHERE starts_with(url, 'https://')")
def q_filter_id_prefix(spark, sf_dir):
    return P.filter_id_prefix(fx.table(spark, sf_dir, "pages").select("page_id", "url"), "https://", "url")


@query("restrict_datasets", with_views(
    "SELECT id, dataset FROM items WHERE dataset IN ('en_native', 'de_translated')", "items"))
def q_restrict_datasets(spark, sf_dir):
    return P.restrict_datasets(fx.items(spark, sf_dir), ["en_native", "de_translated"]).select("id", "dataset")


_NAMES = {s.lang: s.name for s in CFG.langs}


@query("attach_config", with_views(
    "SELECT id, CASE lang " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _NAMES.items())
    + " END AS lang_name, CASE WHEN dataset LIKE '%\\_native' ESCAPE '\\' THEN 'native' ELSE 'translated' END AS role,"
    " lang || '_native' AS native_dataset FROM items", "items"))
def q_attach_config(spark, sf_dir):
    it = fx.items(spark, sf_dir)
    names = F.create_map(*[x for k, v in _NAMES.items() for x in (F.lit(k), F.lit(v))])
    return it.select("id", F.try_element_at(names, F.col("lang")).alias("lang_name"),
                     CFG.dataset_role("dataset").alias("role"), CFG.native_dataset("lang").alias("native_dataset"))


@query("has_tag", with_views("SELECT id, t_newline AS has_newline, t_pipe AS has_pipe, t_email AS has_email, "
                             "t_long AS has_long FROM items", "items"))
def q_has_tag(spark, sf_dir):
    it = fx.items(spark, sf_dir)
    ph = F.col("tags.linguistic_phenomena")
    return it.select("id", *[has_tag(ph, p).alias(f"has_{p}") for p in fx.PH])


_TAGSTR = ("concat_ws(',', CASE WHEN t_newline THEN 'newline' END, CASE WHEN t_pipe THEN 'pipe' END, "
           "CASE WHEN t_email THEN 'email' END, CASE WHEN t_long THEN 'long' END)")


@query("default_tags", with_views(f"""
SELECT id, {_TAGSTR} AS qa_phenomena,
 CASE WHEN {_TAGSTR} = '' THEN 'none' ELSE {_TAGSTR} END AS mt_phenomena FROM items""", "items"))
def q_default_tags(spark, sf_dir):
    it = fx.items(spark, sf_dir)
    return it.select("id", F.array_join(qa_phenomena("tags"), ",").alias("qa_phenomena"),
                     F.array_join(mt_phenomena("tags"), ",").alias("mt_phenomena"))


# -- P9 ---------------------------------------------------------------------------------------------
_WORDS = {"de": ("Text", "Frage", "Antwort"), "en": ("Passage", "Question", "Answer"),
          "es": ("Texto", "Pregunta", "Respuesta"), "fr": ("Texte", "Question", "Réponse")}
TEMPLATES = {}
for _lg, (_p, _q, _a) in _WORDS.items():
    TEMPLATES[(_lg, "openbook")] = f"{_p}: {{context}}\n\n{_q}: {{question}}\n\n{_a}:"
    TEMPLATES[(_lg, "closedbook")] = f"{_q}: {{question}}\n\n{_a}:"


def _sql_prompt() -> str:
    whens = []
    for (lg, cond), t in TEMPLATES.items():
        parts = []
        for lit, f in P.template_parts(t):
            if lit is not None:
                parts.append("'" + lit.replace("'", "''").replace("\n", "' || chr(10) || '") + "'")
            else:
                parts.append(f"i.{f}")
        whens.append(f"WHEN i.lang = '{lg}' AND c.condition = '{cond}' THEN " + " || ".join(parts))
    return "CASE " + " ".join(whens) + " END"


@query("render_prompts", with_views(f"""
SELECT i.id, c.condition, {_sql_prompt()} AS prompt FROM items i CROSS JOIN conditions c""", "items", "conditions"))
def q_render_prompts(spark, sf_dir):
    it = fx.items(spark, sf_dir)
    x = it.select("id", "lang", "question", "context", F.explode(CFG.conditions_of("dataset")).alias("condition"))
    return P.render_prompts(x, TEMPLATES).select("id", "condition", "prompt")


# -- P12 ------------------------------------------------------------------------------------------------
fx.register_sql("translated_rows", """
SELECT event_id,
 CASE event_id % 4 WHEN 0 THEN '' WHEN 1 THEN '  ' || event_type ELSE event_type END AS question,
 CASE WHEN event_id % 7 = 0 THEN chr(160) || chr(10) ELSE props END AS context FROM events""")


@query("require_fields", with_views(f"""
SELECT event_id,
 CASE WHEN {sql_ustrip('question')} = '' THEN 'rejected' WHEN {sql_ustrip('context')} = '' THEN 'rejected' ELSE 'ok' END AS status,
 CASE WHEN {sql_ustrip('question')} = '' THEN 'blank question' WHEN {sql_ustrip('context')} = '' THEN 'blank context' END AS error
FROM translated_rows""", "translated_rows"))
def q_require_fields(spark, sf_dir):
    e = fx.table(spark, sf_dir, "events")
    k = F.col("event_id") % 4
    rows = e.select("event_id",
                    F.when(k == 0, F.lit("")).when(k == 1, F.concat(F.lit("  "), F.col("event_type")))
                     .otherwise(F.col("event_type")).alias("question"),
                    F.when(F.col("event_id") % 7 == 0, F.lit(" \n")).otherwise(F.col("props")).alias("context"))
    return P.require_fields(rows, ["question", "context"]).select("event_id", "status", "error")


# -- P16 / R10 / P19 ----------------------------------------------------------------------------------
_ORD = "CASE model " + " ".join(f"WHEN '{m}' THEN {i}" for i, m in enumerate(CFG.models)) + " END"


@query("classify_models", with_views(f"""
SELECT i.id, coalesce(string_agg(c.model, ',' ORDER BY {_ORD}) FILTER (WHERE c.correct = 1), '') AS correct_models,
 coalesce(string_agg(c.model, ',' ORDER BY {_ORD}) FILTER (WHERE c.correct = 0), '') AS wrong_models,
 CAST(count_if(c.correct = 1) AS INTEGER) AS n_correct, CAST(count_if(c.correct = 0) AS INTEGER) AS n_wrong
FROM items i LEFT JOIN (SELECT * FROM cells WHERE condition = 'openbook') c ON c.id = i.id GROUP BY i.id""",
                                     "items", "cells"))
def q_classify_models(spark, sf_dir):
    it = fx.items(spark, sf_dir)
    s = R.slim_items(it, fx.cells(spark, sf_dir), CFG)
    return s.select("id", F.array_join("correct_models", ",").alias("correct_models"),
                    F.array_join("wrong_models", ",").alias("wrong_models"), "n_correct", "n_wrong")


@query("label_models", with_views(
    "SELECT lang, model, CASE model " + " ".join(f"WHEN '{m}' THEN '{lbl}'" for m, lbl in CFG.model_labels)
    + " END AS label, round(chrf, 6) AS chrf FROM system_level", "system_level"))
def q_label_models(spark, sf_dir):
    s = M.system_level(mt_reports.mt_flat(spark, sf_dir), CFG)
    return s.select("lang", "model", CFG.model_label("model").alias("label"), F.round("chrf", 6).alias("chrf"))


# -- J1 / J2 / U1 / U2 / U3 ---------------------------------------------------------------------------
@query("align_parallel", with_views("SELECT pair_id, ref AS src_text, hyp AS tgt_text FROM aligned", "aligned"))
def q_align_parallel(spark, sf_dir):
    al = P.align_parallel(fx.parallel(spark, sf_dir), "pair_id", "role", "user", "assistant", "turn")
    return al.select("pair_id", "src_text", "tgt_text")


_ALLOWED = tuple(d for d in CFG.datasets if d != "fr_translated")


def _fresh_existing(spark, sf_dir):
    it = fx.items(spark, sf_dir).select("doc_id", "id", "lang", "dataset", "gold")
    docs = fx.table(spark, sf_dir, "documents").select("doc_id", "source")
    fresh = it.filter(F.col("lang") != "fr").drop("doc_id")
    existing = (it.join(docs, "doc_id").filter(F.col("source").isin("src0", "src1", "src2"))
                .select("id", "lang", "dataset", F.lit("cached").alias("gold")))
    return fresh, existing


@query("merge_existing", with_views(f"""
SELECT i.id, i.dataset, CASE WHEN d.source IN ('src0','src1','src2') THEN 'cached' ELSE i.gold END AS gold
FROM items i JOIN documents d ON d.doc_id = i.doc_id
WHERE i.lang <> 'fr' OR (d.source IN ('src0','src1','src2') AND i.dataset IN ({", ".join(f"'{d}'" for d in _ALLOWED)}))""",
                                    "items"))
def q_merge_existing(spark, sf_dir):
    fresh, existing = _fresh_existing(spark, sf_dir)
    return P.merge_existing(fresh, existing, _ALLOWED).select("id", "dataset", "gold")


@query("extra_ids", with_views("""
SELECT i.id FROM items i JOIN documents d ON d.doc_id = i.doc_id
WHERE i.lang = 'fr' AND d.source IN ('src0','src1','src2')""", "items"))
def q_extra_ids(spark, sf_dir):
    fresh, existing = _fresh_existing(spark, sf_dir)
    return P.extra_ids(existing, fresh).select("id")


@query("union_splits", """
SELECT lang, CAST(count(*) AS BIGINT) AS n FROM (
 SELECT lang || '-' || CAST(doc_id AS VARCHAR) AS sid, lang FROM documents WHERE source <= 'src4'
 UNION ALL SELECT lang || '-' || CAST(doc_id AS VARCHAR), lang FROM documents WHERE source > 'src4') u
WHERE starts_with(sid, 'en-') GROUP BY lang""")
def q_union_splits(spark, sf_dir):
    """Two splits of one corpus (train / validation), unioned with duplicates
    kept, then the English subset by id prefix (as the studied loader does)."""
    d = fx.table(spark, sf_dir, "documents").select(
        F.concat(F.col("lang"), F.lit("-"), F.col("doc_id").cast("string")).alias("sid"), "lang", "source")
    u = P.union_splits(d.filter(F.col("source") <= "src4"), d.filter(F.col("source") > "src4"))
    return P.filter_id_prefix(u, "en-", "sid").groupBy("lang").agg(F.count(F.lit(1)).alias("n"))


@query("union_benchmarks", """
SELECT dataset, CAST(count(*) AS BIGINT) AS n, CAST(count(gold) AS BIGINT) AS n_gold FROM (
 SELECT 'documents' AS dataset, split_part(text, ' ', 2) AS gold FROM documents
 UNION ALL SELECT 'benchmark', NULL FROM benchmark
 UNION ALL SELECT 'conversations', NULL FROM conversations WHERE role = 'user'
 UNION ALL SELECT 'pages', NULL FROM pages) u GROUP BY dataset""")
def q_union_benchmarks(spark, sf_dir):
    d = fx.table(spark, sf_dir, "documents").select(F.lit("documents").alias("dataset"), "doc_id",
                                                   fx.second_word().alias("gold"))
    b = fx.table(spark, sf_dir, "benchmark").select(F.lit("benchmark").alias("dataset"), "item_id")
    c = (fx.table(spark, sf_dir, "conversations").filter(F.col("role") == "user")
         .select(F.lit("conversations").alias("dataset"), "conv_id"))
    p = fx.table(spark, sf_dir, "pages").select(F.lit("pages").alias("dataset"), "page_id")
    u = P.union_benchmarks(d, b, c, p)
    return u.groupBy("dataset").agg(F.count(F.lit(1)).alias("n"), F.count("gold").alias("n_gold"))


# -- R9 / S1 / S4 ------------------------------------------------------------------------------------
@query("nest_results", with_views("""
SELECT i.id, CAST(count(DISTINCT c.model) AS INTEGER) AS n_models, CAST(count(c.model) AS BIGINT) AS n_cells
FROM items i LEFT JOIN cells c ON c.id = i.id GROUP BY i.id""", "items", "cells"))
def q_nest_results(spark, sf_dir):
    it = fx.items(spark, sf_dir)
    nested = R.nest_results(it, fx.cells(spark, sf_dir))
    n_cells = F.aggregate(F.map_values("predictions"), F.lit(0).cast("bigint"), lambda acc, m: acc + F.size(m))
    return nested.select("id", F.coalesce(F.size("predictions"), F.lit(0)).alias("n_models"),
                         F.coalesce(n_cells, F.lit(0).cast("bigint")).alias("n_cells"))


RESULT_SCHEMA = ("id STRING, dataset STRING, lang STRING, question STRING, context STRING, gold STRING, "
                 "tags STRUCT<linguistic_phenomena: ARRAY<STRING>, paraphrase_distance: STRING, domain: STRING>, "
                 "predictions MAP<STRING, MAP<STRING, STRUCT<prediction: STRING, verdict: STRING, reason: STRING, "
                 "correct: BOOLEAN>>>")


@query("read_items_jsonl", with_views("""
SELECT id, model, condition, correct = 1 AS correct, prediction FROM cells""", "cells"))
def q_read_items_jsonl(spark, sf_dir):
    """Nested records -> JSON lines (S4) -> read back with the schema (S1) -> long cells."""
    it = fx.items(spark, sf_dir)
    nested = R.nest_results(it.drop("doc_id"), fx.cells(spark, sf_dir))
    path = IO.write_items_jsonl(nested, scratch_path(spark, "results-jsonl"))
    back = IO.read_items_jsonl(spark, path, RESULT_SCHEMA)
    per_model = back.select("id", F.explode("predictions").alias("model", "by_cond"))
    cells = per_model.select("id", "model", F.explode("by_cond").alias("condition", "e"))
    return cells.select("id", "model", "condition", F.col("e.correct").alias("correct"),
                        F.col("e.prediction").alias("prediction"))


# -- S3 --------------------------------------------------------------------------------------------------
@query("read_corpus", "SELECT doc_id, n_chars, source FROM documents WHERE lang = 'de' AND n_chars > 1000")
def q_read_corpus(spark, sf_dir):
    return CO.read_corpus(spark, f"{sf_dir}/documents.parquet", ["doc_id", "n_chars", "source", "lang"],
                          where=(F.col("lang") == "de") & (F.col("n_chars") > 1000)).drop("lang")


# -- S5 --------------------------------------------------------------------------------------------------
@query("write_inspection", with_views("""
WITH p AS (SELECT id, count_if(correct = 0) AS n_wrong, count_if(correct = 1) AS n_correct
           FROM cells WHERE condition = 'openbook' GROUP BY id)
SELECT CASE WHEN i.dataset LIKE '%\\_native' ESCAPE '\\' THEN 'native_wrong' ELSE 'translated_correct' END AS bucket,
 i.lang, CAST(count(*) AS BIGINT) AS n, 'm0,m1,m2,m3' AS models
FROM items i JOIN p ON p.id = i.id
WHERE i.t_newline AND ((i.dataset LIKE '%\\_native' ESCAPE '\\' AND p.n_wrong > 0)
                        OR (i.dataset LIKE '%\\_translated' ESCAPE '\\' AND p.n_correct > 0))
GROUP BY 1, 2""", "items", "cells"))
def q_write_inspection(spark, sf_dir):
    it = fx.items(spark, sf_dir)
    slim = R.slim_items(it, fx.cells(spark, sf_dir), CFG)
    slim = slim.filter(has_tag(qa_phenomena("tags"), "newline")).withColumn("role", CFG.dataset_role("dataset"))
    sel = slim.filter(((F.col("role") == "native") & (F.col("n_wrong") > 0))
                      | ((F.col("role") == "translated") & (F.col("n_correct") > 0)))
    sel = sel.withColumn("bucket", F.when(F.col("role") == "native", F.lit("native_wrong"))
                         .otherwise(F.lit("translated_correct"))).drop("role")
    out = SK.write_inspection(sel, scratch_path(spark, "inspection"), CFG.models, ("lang",))
    return out.select("bucket", "lang", "n", F.array_join("models", ",").alias("models"))


# -- S6 --------------------------------------------------------------------------------------------------
_S6_MT = {"n": None, "chrf": 2, "comet": 3, "adequacy": 2, "fluency": 2}  # decimals of the summary


_S6_TAG = [f"{m}_{side}" for m in ("chrf", "comet", "adequacy", "fluency") for side in ("with", "without", "delta")]


def _s6_sql() -> str:
    """Every section as long rows: (section, key columns, value columns, table)."""
    cov_cols = ["n", *(f"ph_{p}" for p in fx.PH), "none", *(f"para_{v}" for v in fx.PARA), *(f"dom_{v}" for v in fx.DOM)]
    a1 = qa_reports.A1_SQL[qa_reports.A1_SQL.index("SELECT dataset"):]
    category = lambda col: f"""(SELECT lang, dataset, model, {col} AS category, count(*) AS n,
 round_even(CAST(sum(correct) AS DOUBLE) / count(*) * 100, 1) AS accuracy
FROM scored WHERE condition = 'openbook' AND {col} IS NOT NULL AND lang IN {fx.LANGS_SQL} GROUP BY ALL)"""  # noqa: E731
    mt = ", ".join(c if d is None else f"round_even({c}, {d}) AS {c}" for c, d in _S6_MT.items())
    sections = [
        ("accuracy", ["dataset", "condition", "model"], ["n", "accuracy_pct"], f"({a1})"),
        ("coverage", ["lang", "dataset"], cov_cols, "coverage"),
        ("tagged", ["lang", "dataset"], ["n_tagged"], f"""(SELECT b.lang, b.dataset, coalesce(c.n, 0) AS n_tagged
 FROM {qa_reports._BENCH} b LEFT JOIN (SELECT lang, dataset, count(*) AS n FROM items WHERE tagged GROUP BY ALL) c
 ON b.lang = c.lang AND b.dataset = c.dataset)"""),
        ("phenomenon", ["lang", "dataset", "phenomenon", "model"], ["n_with", "n_without", "acc_with", "acc_without", "delta"],
         "by_phenomenon"),
        ("paraphrase", ["lang", "dataset", "model", "category"], ["n", "accuracy"], category("paraphrase_distance")),
        ("domain", ["lang", "dataset", "model", "category"], ["n", "accuracy"], category("domain")),
        ("mt_system", ["lang", "model"], list(_S6_MT), f"(SELECT lang, model, {mt} FROM system_level)"),
        ("mt_phenomenon", ["lang", "phenomenon", "model"], _S6_TAG, "(SELECT lang, phenomenon, model, "
         + ", ".join(f"round_even({c}, 2) AS {c}" for c in _S6_TAG) + " FROM per_tag)"),
    ]
    body = " UNION ALL ".join(
        f"""SELECT '{name}' AS section, {" || '|' || ".join(keys)} AS row_key, '{c}' AS "column", CAST("{c}" AS DOUBLE) AS value
 FROM {source} AS s_{name}""" for name, keys, cols, source in sections for c in cols)
    return with_views(body, "scored", "coverage", "items", "by_phenomenon", "system_level", "per_tag")


@query("report_tables", _s6_sql())
def q_report_tables(spark, sf_dir):
    """All sections of a run's summary in one long table, rolled up from three small cubes."""
    qa, items, mt = (Q.as_flat(c, CFG) for c in report_cubes(spark, sf_dir))
    system = M.system_level(mt, CFG).select(
        "lang", "model", *[F.col(c) if d is None else F.bround(c, d).alias(c) for c, d in _S6_MT.items()])
    per_tag = M.per_tag(mt, CFG).select("lang", "phenomenon", "model", *[F.bround(c, 2).alias(c) for c in _S6_TAG])
    by_tag = ["lang", "dataset", "phenomenon", "model"]
    by_class = ["lang", "dataset", "model", "category"]
    return SK.report_tables({
        "accuracy": (S.accuracy_by_benchmark(qa, CFG, ordered=False), ["dataset", "condition", "model"]),
        "coverage": (S.coverage(items, CFG), ["lang", "dataset"]),
        "tagged": (S.tagged_counts(items, CFG, spark), ["lang", "dataset"]),
        "phenomenon": (S.accuracy_by_phenomenon(qa, CFG), by_tag),
        "paraphrase": (S.accuracy_by_paraphrase(qa), by_class),
        "domain": (S.accuracy_by_domain(qa), by_class),
        "mt_system": (system, ["lang", "model"]),
        "mt_phenomenon": (per_tag, ["lang", "phenomenon", "model"]),
    })


def report_cubes(spark, sf_dir):
    """The QA, item and MT cubes.  Items are written once without their texts, cells are read from them: one scan of
    ``documents`` and of ``labels``; chrF is computed once."""
    it = materialize(fx.items(spark, sf_dir).select("doc_id", "id", "lang", "dataset", "tags"), "report-items")
    flat = R.flatten_all(fx.cells(spark, sf_dir, it), None, CFG)
    return tuple(materialize(c, "cube") for c in (Q.qa_cube(flat, CFG), Q.item_cube(it, CFG),
                                                  Q.mt_cube(mt_reports.mt_flat(spark, sf_dir), CFG)))


# -- S7 + resumable stage -------------------------------------------------------------------------------
@query("stage_checkpoint", with_views("""
SELECT i.dataset, CAST(count(*) AS BIGINT) AS n,
 CAST(count_if(i.tagged OR coalesce(contains(d.text, '.'), false)) AS BIGINT) AS n_tagged,
 CAST(count_if(NOT i.tagged AND NOT coalesce(contains(d.text, '.'), false)) AS BIGINT) AS n_failed
FROM items i JOIN documents d ON d.doc_id = i.doc_id GROUP BY i.dataset""", "items"))
def q_stage_checkpoint(spark, sf_dir):
    from ..streaming.stages import run_stage_in_waves
    store = CK.StageStore(spark, scratch_path(spark, "stages"))
    it = fx.items(spark, sf_dir).select("id", "lang", "dataset", "context", F.to_json("tags").alias("tags_json"))
    store.write("items", it.withColumn("status", F.lit(None).cast("string"))
                .withColumn("error", F.lit(None).cast("string")))
    work = lambda cur: cur.filter(F.col("tags_json").isNull()).select("id", "context")
    final = run_stage_in_waves(store, "items", work, rule_tag_fn, "tags_json string", ["id"], ["tags_json"],
                               waves=2)
    return final.groupBy("dataset").agg(F.count(F.lit(1)).alias("n"),
                                        F.count_if(F.col("tags_json").isNotNull()).alias("n_tagged"),
                                        F.count_if(F.col("status") == "error").alias("n_failed"))


# -- R10 ---------------------------------------------------------------------------------------------------
@query("slim_items", with_views(f"""
SELECT i.id, i.dataset, i.lang, i.gold,
 CAST(count(m.model) AS INTEGER) AS n_entries,
 coalesce(string_agg(m.model || '=' || coalesce(c.verdict, '-'), ',' ORDER BY m.mi), '') AS verdicts,
 CAST(count_if(c.correct = 1) AS INTEGER) AS n_correct, CAST(count_if(c.correct = 0) AS INTEGER) AS n_wrong
FROM items i CROSS JOIN models m
LEFT JOIN (SELECT c.*, CASE WHEN correct = 1 THEN 'correct' WHEN correct = 0 THEN 'incorrect' END AS verdict
           FROM cells c WHERE condition = 'openbook') c ON c.id = i.id AND c.model = m.model
GROUP BY i.id, i.dataset, i.lang, i.gold""", "items", "models", "cells"))
def q_slim_items(spark, sf_dir):
    """Inspection records: every model's open-book entry plus the tri-state split."""
    it = fx.items(spark, sf_dir)
    s = R.slim_items(it, fx.cells(spark, sf_dir), CFG)
    entries = F.coalesce(F.col("openbook"), F.array())
    verdicts = F.array_join(F.transform(entries, lambda e: F.concat(e["model"], F.lit("="),
                                                                     F.coalesce(e["verdict"], F.lit("-")))), ",")
    return s.select("id", "dataset", "lang", "gold", F.coalesce(F.size("openbook"), F.lit(0)).alias("n_entries"),
                    verdicts.alias("verdicts"), "n_correct", "n_wrong")
