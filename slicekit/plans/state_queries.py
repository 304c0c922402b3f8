"""Stages over stored tables: work lists by status (J6), merges and exports of tables bucketed by id
(J2, J3, J6, R9), merged items in order (J2), sorted score batches with their mean (E3), dataset labels (P19)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import enrich as E
from ..operators import jobs as J
from ..operators import prep as P
from ..session import materialize
from ..sources.buckets import BucketStore, bucket_count
from . import fixtures as fx
from . import pipeline, prep_queries
from .fixtures import CONFIG as CFG
from .fixtures import with_views
from .registry import ORACLES, query
from .userfns import length_ratio_scorer

_KEY = ["id", "model", "condition"]
_PAYLOAD = ["prediction", "verdict", "reason", "correct"]

# -- J6 by status ------------------------------------------------------------------------------------
# empty answers: stages that came back without a value, with and without success
_N = "CAST(substr(prediction, 5) AS INTEGER)"


@query("pending_by_status", with_views(f"""
SELECT 'infer' AS stage, id, model, condition FROM pending_infer
UNION ALL SELECT 'infer', id, model, condition FROM cells WHERE {_N} % 13 = 0 AND {_N} % 26 <> 0
UNION ALL SELECT 'judge', id, model, condition FROM cells WHERE {_N} % 13 <> 0 AND correct IS NULL AND {_N} % 2 <> 0
UNION ALL SELECT 'tag', id, NULL, NULL FROM items WHERE NOT tagged AND doc_id % 2 <> 0
UNION ALL SELECT 'translate', id, model, NULL FROM mt_pairs WHERE (item_id + mi) % 7 = 0 AND item_id % 2 <> 0""",
                                     "pending_infer", "cells", "items", "mt_pairs"))
def q_pending_by_status(spark, sf_dir):
    """All work lists, where an answer ('ok') without a value is not asked for again."""
    said = lambda odd: F.when(odd, "error").otherwise("ok")
    n = F.substr("prediction", F.lit(5)).cast("int")
    cells = fx.cells(spark, sf_dir).withColumn("n", n).withColumns({
        "status": said(F.col("n") % 26 != 0), "judge_status": said(F.col("n") % 2 != 0),
        "prediction": F.when(F.col("n") % 13 != 0, F.col("prediction"))})
    items = fx.items(spark, sf_dir).withColumn("status", said(F.col("doc_id") % 2 != 0))
    done = fx.translations(spark, sf_dir).withColumns({
        "hyp": F.when((F.col("item_id") + F.col("mi")) % 7 != 0, F.col("hyp")), "status": said(F.col("item_id") % 2 != 0)})
    lists = {"infer": J.pending_infer(items, cells, CFG, "status"), "judge": J.pending_judge(cells, CFG.datasets, "judge_status"),
             "tag": J.pending_tag(items, "status"), "translate": J.pending_translate(fx.mt_items(spark, sf_dir), done, CFG, "status")}
    parts = [df.select(F.lit(stage).alias("stage"), *[(F.col(c) if c in df.columns else F.lit(None).cast("string")).alias(c) for c in _KEY])
             for stage, df in lists.items()]
    return parts[0].union(parts[1]).union(parts[2]).union(parts[3])


# -- tables bucketed by id ------------------------------------------------------------------------------
# stores are sized by the items and cells without tags, which no text is shuffled for
_ITEM = ["id", "lang", "dataset", "question", "gold"]


def _stored(spark, sf_dir) -> BucketStore:
    items = fx.plain_items(spark, sf_dir).select(*_ITEM)
    cells = fx.plain_cells(spark, sf_dir).drop("lang", "dataset", "tags")
    store = BucketStore(spark, buckets=bucket_count(items, J.expand_jobs(items, CFG), cells))
    store.write("items", fx.items(spark, sf_dir).select(*_ITEM))
    store.write("cells", fx.cells(spark, sf_dir).drop("lang", "dataset", "tags"))
    return store


@query("bucketed_pending_infer", ORACLES["pending_infer"])
def q_bucketed_pending_infer(spark, sf_dir):
    """The work list of two stored tables, bucket by bucket."""
    return _stored(spark, sf_dir).pending_infer("items", "cells", CFG, "status").select(*_KEY)


@query("bucketed_upsert", ORACLES["upsert_cells"])
def q_bucketed_upsert(spark, sf_dir):
    """Verdicts merged into the stored cells; only they are shuffled."""
    store = BucketStore(spark, buckets=bucket_count(fx.plain_cells(spark, sf_dir).drop("lang", "tags")))
    store.write("cells", fx.cells(spark, sf_dir).drop("lang", "tags"))
    version = store.upsert("cells", materialize(pipeline._judged(store.read("cells")), "judged"), _KEY, _PAYLOAD)
    return store.read("cells", version).select(*_KEY, "prediction", "verdict", "correct", "status", "error")


@query("bucketed_merge_existing", ORACLES["merge_existing"])
def q_bucketed_merge_existing(spark, sf_dir):
    """Fresh and earlier items of two stored tables."""
    store = BucketStore(spark, buckets=bucket_count(fx.plain_items(spark, sf_dir).select("id", "lang", "dataset", "gold")))
    for stage, rows in zip(("fresh", "existing"), prep_queries._fresh_existing(spark, sf_dir)):
        store.write(stage, rows)
    return store.merge_existing("fresh", "existing", prep_queries._ALLOWED).select("id", "dataset", "gold")


@query("bucketed_nest", with_views("""
SELECT i.id, CAST(count(c.id) AS BIGINT) AS n_cells, CAST(count(DISTINCT c.model) AS BIGINT) AS n_models,
 max(c.prediction) FILTER (c.model = 'm1' AND c.condition = 'openbook') AS m1_open
FROM items i LEFT JOIN cells c ON c.id = i.id GROUP BY i.id""", "items", "cells"))
def q_bucketed_nest(spark, sf_dir):
    """The nested export of the stored tables, looked into."""
    nested = _stored(spark, sf_dir).nested("items", "cells")
    models = F.map_values("predictions")
    return nested.select("id", F.coalesce(F.aggregate(models, F.lit(0), lambda n, m: n + F.size(m)), F.lit(0)).cast("long").alias("n_cells"),
                         F.coalesce(F.size(models), F.lit(0)).cast("long").alias("n_models"),
                         F.try_element_at(F.try_element_at("predictions", F.lit("m1")), F.lit("openbook"))["prediction"].alias("m1_open"))


# -- J2 in order -------------------------------------------------------------------------------------
@query("merge_in_order", with_views(f"""
WITH x AS (SELECT i.id, i.dataset, i.lang, i.gold, i.doc_id, d.source IN ('src0','src1','src2') AS old
           FROM items i JOIN documents d ON d.doc_id = i.doc_id)
SELECT id, dataset, CASE WHEN old THEN 'cached' ELSE gold END AS gold,
 row_number() OVER (ORDER BY lang = 'fr', CASE WHEN lang = 'fr' THEN -doc_id ELSE doc_id END, id) AS position
FROM x WHERE lang <> 'fr' OR (old AND dataset IN ({", ".join(f"'{d}'" for d in prep_queries._ALLOWED)}))""", "items"))
def q_merge_in_order(spark, sf_dir):
    """Merged items, numbered: the fresh ones in their order, then the extras in theirs."""
    number = F.regexp_extract("id", "([0-9]+)$", 1).cast("long")
    fresh, existing = prep_queries._fresh_existing(spark, sf_dir)
    out = P.merge_existing(fresh.withColumn("position", number), existing.withColumn("position", -number), prep_queries._ALLOWED,
                           position="position")
    return out.select("id", "dataset", "gold", "position")


# -- E3, sorted ---------------------------------------------------------------------------------------
@query("score_batches_sorted", with_views("""
SELECT id, model, round(score, 6) AS score, round(avg(score) OVER (), 6) AS overall_mean
FROM (SELECT id, model, CASE WHEN greatest(length(hyp), length(ref)) > 0
   THEN CAST(least(length(hyp), length(ref)) AS DOUBLE) / greatest(length(hyp), length(ref)) ELSE 0.0 END AS score FROM mt_pairs) s""",
                                        "mt_pairs"))
def q_score_batches_sorted(spark, sf_dir):
    """Batches of like lengths, and the overall mean from the pass that wrote the scores."""
    pairs = fx.mt_pairs(spark, sf_dir).select("id", "model", "hyp", "ref")
    longest = F.greatest(F.length("hyp"), F.length("ref"))
    scored = E.score_batches(pairs, length_ratio_scorer, "score double, batch_rows long", ["id", "model"], 64, longest, 64 * 1024)
    scored, seen = E.observe_mean(scored, "score")
    scored = materialize(scored, "scores")
    return scored.select("id", "model", F.round("score", 6).alias("score"), F.round(F.lit(seen.get["mean"]), 6).alias("overall_mean"))


# -- P19 ------------------------------------------------------------------------------------------------
_LABELS = [(d, label) for s in CFG.langs for d, label in ((s.native_dataset, s.native_label), (s.translated_dataset, s.translated_label))]


@query("label_datasets", with_views(
    "SELECT dataset, CASE dataset " + " ".join(f"WHEN '{d}' THEN '{label}'" for d, label in _LABELS)
    + " ELSE dataset END AS label, CAST(count(*) AS BIGINT) AS n FROM items GROUP BY dataset", "items"))
def q_label_datasets(spark, sf_dir):
    """Items of each dataset under the name shown for it."""
    n = fx.items(spark, sf_dir).groupBy("dataset").agg(F.count(F.lit(1)).alias("n"))
    return n.select("dataset", CFG.dataset_label("dataset").alias("label"), "n")
