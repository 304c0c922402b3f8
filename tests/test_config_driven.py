"""A third language with its own datasets, models and an extra condition
(the older Urdu output): everything comes from config."""

from pyspark.sql import functions as F

from slicekit.config import EvalConfig, LangSpec
from slicekit.operators import jobs as J
from slicekit.operators import reshape as R
from slicekit.operators import slices as S

# The Urdu table (n = 139 per dataset) and the counts behind it.
UR = EvalConfig(
    langs=(LangSpec("ur", "Urdu", "uquad", "belebele", ("ergative_ne", "izafat"), ("general",)),),
    models=("claude_opus_4_7", "llama_31_8b", "qwen_25_7b"),
    dataset_conditions=(("belebele", ("mcq",)), ("uquad", ("openbook", "closedbook"))),
)
TABLE = {("belebele", "mcq"): ((128, 92.1), (78, 56.1), (87, 62.6)),
         ("uquad", "closedbook"): ((110, 79.1), (40, 28.8), (35, 25.2)),
         ("uquad", "openbook"): ((127, 91.4), (119, 85.6), (120, 86.3))}


def test_jobs_follow_dataset_conditions(spark):
    items = spark.createDataFrame([("a", "ur", "uquad"), ("b", "ur", "belebele")], "id string, lang string, dataset string")
    got = sorted((r.id, r.model, r.condition) for r in J.expand_jobs(items, UR).collect())
    assert len(got) == 3 * 2 + 3 * 1
    assert {c for i, _, c in got if i == "b"} == {"mcq"}


def test_urdu_accuracy_from_counts(spark):
    items = spark.range(0, 139).select(F.concat(F.lit("u"), F.col("id").cast("string")).alias("i"), "id")
    items = items.select(F.explode(F.array(F.lit("uquad"), F.lit("belebele"))).alias("dataset"), "i", "id")
    items = items.select(F.concat_ws("_", "dataset", "i").alias("id"), F.lit("ur").alias("lang"), "dataset",
                         F.col("id").alias("pos"))
    jobs = J.expand_jobs(items, UR).join(items.select("id", "pos"), "id")
    kmap = F.create_map(*[x for (ds, cond), vals in TABLE.items() for m, (kk, _) in zip(UR.models, vals)
                          for x in (F.lit(f"{ds}|{cond}|{m}"), F.lit(kk))])
    k = F.try_element_at(kmap, F.concat_ws("|", "dataset", "condition", "model"))
    cells = jobs.withColumn("correct", F.col("pos") < k)
    it = items.withColumn("tags", F.lit(None).cast("struct<linguistic_phenomena: array<string>, "
                                                  "paraphrase_distance: string, domain: string>"))
    out = {(r.dataset, r.condition, r.model): (r.n, r.accuracy_pct)
           for r in S.accuracy_by_benchmark(R.flatten_all(cells, it, UR), UR).collect()}
    for (ds, cond), vals in TABLE.items():
        for m, (_, pub) in zip(UR.models, vals):
            assert out[(ds, cond, m)] == (139, pub)
    assert len(out) == 9
