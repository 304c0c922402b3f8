"""The pipeline against brute-force versions of its stages, and its entry points."""

import random
from collections import defaultdict

import pytest

import corpus_pipeline
from slicekit.llm import queries as registered

from .helpers import DOCS, prose, sentence, with_clashes
from .test_decontam import _plain as plain_contamination
from .test_packing import _check as check_packing
from .test_simhash import _plain_components
from .test_spans import _KEYS, S, _plain as plain_spans


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = random.Random(11)
    items = [(i, prose(rng, 4)) for i in range(5)]
    passage = prose(rng, 10)
    texts, labels = [], []
    for i in range(240):
        text = prose(rng, rng.randint(6, 18))
        if i % 12 == 0:
            text = " ".join(w + "###" for w in text.split())
        if i % 12 == 1:
            text = text + " You moron idiot."
        if i % 12 == 2 and i:
            text = texts[i - 1 - i % 5]
        if i % 12 == 3:
            text = f"{text} {passage} {sentence(rng, 6)}"
        if i % 12 == 4:
            text = f"{sentence(rng, 9)} {items[i % 5][1]} {sentence(rng, 9)}"
        texts.append(text)
        labels.append((i, int(i % 12 != 0), int("moron" in text)))
    root = tmp_path_factory.mktemp("tables")
    extra = [(1000, None, None, None, None), (None, "", "en", "s", 0), (1001, passage, "en", "s", len(passage)), (1001, passage, "en", "s", len(passage))]
    rows = [(i, t, "en", f"src{i % 3}", len(t)) for i, t in enumerate(texts)] + extra
    spark.createDataFrame(rows, DOCS).repartition(3).write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    return str(root), items


def test_every_stage_against_brute_force(spark, tables, tmp_path):
    root, items = tables
    docs = spark.read.parquet(f"{root}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality", "near_copies", "repeated_spans", "benchmark", "packing"]

    def step(name, docs):
        out = stages[name](spark, docs, root)
        out.write.parquet(f"{tmp_path}/{name}")
        got = spark.read.parquet(f"{tmp_path}/{name}")
        if name != "packing":
            assert got.schema.simpleString() == docs.schema.simpleString()
        return got

    pairs = lambda df: [(r.doc_id, r.text) for r in df.collect()]
    good = step("quality", docs)
    ids = {r.doc_id for r in good.collect()}
    assert not [i for i in ids if i is not None and i < 240 and i % 12 in (0, 1)]
    assert len([i for i in range(240) if i % 12 > 2 and i in ids]) >= 178

    single = step("near_copies", good)
    rows = pairs(good)
    comps = defaultdict(list)
    for i, _, c in _plain_components([(k, t) for k, (_, t) in enumerate(rows)]):
        comps[c].append(rows[int(i)][0])
    assert sorted(str(d) for d, _ in pairs(single)) == sorted(
        str(min((d for d in c if d is not None), default=None)) for c in comps.values())

    freed = step("repeated_spans", single)
    from pyspark.sql import functions as F
    _KEYS.update({(r.doc_id, r.text): r.k for r in single.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("k")).collect()})
    assert sorted(((str(d), t) for d, t in pairs(freed)), key=str) == [x[:2] for x in plain_spans(pairs(single), S.MIN_SENTENCES, S.MIN_WORDS)]

    clean = step("benchmark", freed)
    bad = [r for r in pairs(freed) if plain_contamination([r], items)[0][5]]
    assert bad and sorted(map(str, pairs(clean))) == sorted(str(r) for r in pairs(freed) if r not in bad)

    n, least = check_packing(step("packing", clean).collect(), pairs(clean))
    assert n <= least * 1.03 + 1


def test_run_applies_all_stages(spark, tables):
    rows = corpus_pipeline.run(spark, tables[0]).collect()
    assert {"doc_id", "sequence_id", "offset", "length"} <= set(rows[0].asDict())
    assert corpus_pipeline.ORACLE_SQL is None


def test_stages_on_empty_tables_and_clashing_columns(spark, tables):
    root, _ = tables
    docs = with_clashes(spark.read.parquet(f"{root}/documents.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        empty = stage(spark, docs.limit(0), root)
        assert empty.columns == docs.columns and empty.count() == 0, name
        docs = stage(spark, docs, root)
    assert corpus_pipeline.STAGES[-1][1](spark, docs, root).count() > 0


def test_one_query_for_each_operator():
    import __spark_entry__
    queries = __spark_entry__.queries()
    assert sorted(int(q[2:].split("_")[0]) for q in registered.QUERIES) == list(range(1, 14))
    assert set(registered.QUERIES) <= set(queries) and "pipeline" in queries
    assert set(registered.ORACLES) <= set(registered.QUERIES)
