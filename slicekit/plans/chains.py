"""Build chains over the fixture views: several operators in the order a build runs them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import is_blank, sql_ustrip
from ..operators import jobs as J
from ..operators import parse as PA
from ..operators import prep as P
from ..operators import sample as N
from . import fixtures as fx
from .fixtures import CONFIG as CFG
from .fixtures import with_views
from .registry import query

PER_DATASET = 100

fx.register_sql("prepared_fresh", f"""
SELECT id, lang, dataset, gold FROM (
 SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY md5('42:' || id), id) AS rn
 FROM items WHERE {sql_ustrip('gold')} <> '') x WHERE rn <= {PER_DATASET}""", ("items",))


@query("prepare_items", with_views("""
WITH old AS (SELECT i.id, i.lang, i.dataset, 'kept: ' || i.gold AS gold
             FROM items i JOIN documents d ON d.doc_id = i.doc_id WHERE d.source = 'src0')
SELECT f.id, f.lang, f.dataset, coalesce(o.gold, f.gold) AS gold FROM prepared_fresh f LEFT JOIN old o ON o.id = f.id
UNION ALL SELECT * FROM old WHERE id NOT IN (SELECT id FROM prepared_fresh)""", "items", "prepared_fresh"))
def q_prepare_items(spark, sf_dir):
    """Sources to items: rows with an answer, a seeded sample of each dataset, merged
    with the items of an earlier build, whose records win."""
    items = fx.items(spark, sf_dir)
    answered = items.filter(~is_blank("gold"))
    fresh = N.seeded_sample(answered, PER_DATASET, seed=42, by="dataset").select("id", "lang", "dataset", "gold")
    first = fx.table(spark, sf_dir, "documents").filter("source = 'src0'").select("doc_id")
    old = items.join(first, "doc_id", "left_semi").select("id", "lang", "dataset", F.concat(F.lit("kept: "), "gold").alias("gold"))
    return P.merge_existing(fresh, old, CFG.datasets)


@query("prepare_shortfall", with_views(
    f"SELECT t.dataset, {PER_DATASET} AS requested, CAST(coalesce(c.n, 0) AS BIGINT) AS obtained, "
    f"CAST({PER_DATASET} - coalesce(c.n, 0) AS BIGINT) AS shortfall FROM " + fx.sql_values("dataset", CFG.datasets)
    + " t LEFT JOIN (SELECT dataset, count(*) AS n FROM prepared_fresh GROUP BY dataset) c ON c.dataset = t.dataset", "prepared_fresh"))
def q_prepare_shortfall(spark, sf_dir):
    """What the sample of ``prepare_items`` lacks of its target, per dataset."""
    fresh = N.seeded_sample(fx.items(spark, sf_dir).filter(~is_blank("gold")), PER_DATASET, seed=42, by="dataset")
    out = N.sample_shortfall(fresh, dict.fromkeys(CFG.datasets, PER_DATASET), spark)
    return out.select("dataset", "requested", *[F.col(c).cast("bigint").alias(c) for c in ("obtained", "shortfall")])


# a judge's ratings of translations, from the events: as text or number, wrapped in the five ways of replies
fx.register_sql("rating_replies", """
SELECT event_id, 'b_' || (event_id // 4) AS id, 'm' || (event_id % 4) AS model, CASE event_id % 5 WHEN 0 THEN obj
  WHEN 1 THEN '```json' || chr(10) || obj || chr(10) || '```' WHEN 2 THEN 'Sure: ' || obj || ' done'
  WHEN 3 THEN obj || ' or ' || obj ELSE '{broken' || '}' END AS reply
FROM (SELECT event_id, '{"adequacy": "' || (1 + CAST(floor(abs(value)) AS BIGINT) % 5) || '", "fluency": '
        || CASE WHEN event_id % 7 = 0 THEN 'null' ELSE CAST(1 + CAST(floor(abs(value)) AS BIGINT) % 4 AS VARCHAR) END
        || ', "note": "' || event_type || '"}' AS obj FROM events) e""")


@fx.memo_plan
def rating_replies(spark, sf_dir):
    e = fx.table(spark, sf_dir, "events")
    whole = F.floor(F.abs("value")).cast("bigint")
    obj = F.concat(F.lit('{"adequacy": "'), (1 + whole % 5).cast("string"), F.lit('", "fluency": '),
                   F.when(F.col("event_id") % 7 == 0, "null").otherwise((1 + whole % 4).cast("string")),
                   F.lit(', "note": "'), F.col("event_type"), F.lit('"}'))
    k = F.col("event_id") % 5
    reply = (F.when(k == 0, obj).when(k == 1, F.concat(F.lit("```json\n"), obj, F.lit("\n```")))
             .when(k == 2, F.concat(F.lit("Sure: "), obj, F.lit(" done"))).when(k == 3, F.concat(obj, F.lit(" or "), obj))
             .otherwise("{broken}"))
    return e.select("event_id", F.concat(F.lit("b_"), F.floor(F.col("event_id") / 4).cast("string")).alias("id"),
                    F.concat(F.lit("m"), (F.col("event_id") % 4).cast("string")).alias("model"), reply.alias("reply"))


_RATED = """
SELECT event_id, id, model,
 CASE WHEN ok THEN TRY_CAST(json_extract_string(txt, '$.adequacy') AS INTEGER) END AS adequacy,
 CASE WHEN ok THEN TRY_CAST(json_extract_string(txt, '$.fluency') AS INTEGER) END AS fluency,
 CASE WHEN ok THEN json_extract_string(txt, '$.note') END AS judge_note,
 CASE WHEN ok THEN 'ok' ELSE 'error' END AS status
FROM (SELECT *, json_valid(txt) AS ok FROM (SELECT *, regexp_extract(reply, '(?s)\\{.*\\}', 0) AS txt FROM rating_replies) a) b"""
fx.register_sql("ratings", _RATED, ("rating_replies",))


@query("parse_ratings", with_views("SELECT * FROM ratings", "ratings"))
def q_parse_ratings(spark, sf_dir):
    """A judge's replies to adequacy, fluency and note; two objects in one reply are an error."""
    return PA.parse_ratings(rating_replies(spark, sf_dir)).drop("error")


@query("pending_ratings", with_views("""
SELECT p.id, p.model FROM mt_pairs p WHERE length(p.hyp) > 0
 AND NOT EXISTS (SELECT 1 FROM ratings r WHERE r.id = p.id AND r.model = p.model AND r.status = 'ok')""", "mt_pairs", "ratings"))
def q_pending_ratings(spark, sf_dir):
    """Translations still to be rated: an answer without a value is an answer."""
    rated = PA.parse_ratings(rating_replies(spark, sf_dir))
    return J.pending_metric(fx.translations(spark, sf_dir), rated, "fluency", status="status").select("id", "model")
