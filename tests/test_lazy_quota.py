"""Lazy quota sampling: the rows of the eager one, and not a row tagged past the stop."""

import random

import pytest
from pyspark.sql import functions as F

from slicekit.operators import sample as N
from slicekit.session import scratch_path
from slicekit.sources.checkpoint import StageStore
from slicekit.streaming.quota import lazy_quota_sample

BUCKETS = {"a": (("p", "q"), ("z",)), "b": (("p", "r"), ()), "c": ((), ("z",)), "d": (("p",), ())}
SCHEMA = "id string, lang string, tags struct<linguistic_phenomena: array<string>>"


def _rows(seed, n=260):
    rng = random.Random(seed)
    def tags(lang):
        if rng.random() < 0.05:
            return None  # tagging fails
        return ([t for t, p in (("p", 0.3), ("q", 0.08), ("r", 0.002), ("z", 0.1), ("none", 0.1)) if rng.random() < p],)
    return [(f"i{i}", lang := rng.choice("abcde"), tags(lang)) for i in range(n)]


def _sequential(rows, existing, quota, batch):
    """The batch loop: accepted ids and rows tagged, per language."""
    import hashlib
    accepted, tagged = set(), {}
    for lang, (req, bonus) in BUCKETS.items():
        fill = {p: sum((t[0] or ["none"]).count(p) for _, lg, t in existing if lg == lang and t is not None) for p in req}
        todo = sorted((r for r in rows if r[1] == lang), key=lambda r: (hashlib.md5(f"42:{r[0]}".encode()).hexdigest(), r[0]))
        at = 0
        while at < len(todo) and not all(fill[p] >= quota for p in req):
            for i, _, t in todo[at:at + batch]:
                if t is None:
                    continue
                ph = t[0] or ["none"]
                if any(p in req and fill[p] < quota for p in ph) or any(p in bonus for p in ph):
                    accepted.add(i)
                    for p in ph:
                        if p in req:
                            fill[p] += 1
            at += batch
        tagged[lang] = min(at, len(todo))
    return accepted, {k: v for k, v in tagged.items() if v}


def _tagger(truth, calls=None, die_after=None):
    def tag(rows):
        if calls is not None:
            if die_after is not None and len(calls) >= die_after:
                raise KeyboardInterrupt
            calls.append(rows.count())
        done = rows.select("id", "lang", "_pos").join(truth.select("id", "tags"), "id")
        return done.withColumns({"status": F.when(F.col("tags").isNull(), "error").otherwise("ok"), "error": F.lit(None).cast("string")})
    return tag


@pytest.mark.parametrize("seed, quota, batch, lookahead", [(1, 6, 16, 0.0), (3, 10, 32, 0.7)])
def test_equals_the_sequential_loop_and_the_eager_sample(spark, seed, quota, batch, lookahead):
    rows, existing = _rows(seed), [(f"e{i}", lang, t) for i, (_, lang, t) in enumerate(_rows(seed + 50, 25))]
    truth, ex = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(existing, SCHEMA)
    out = lazy_quota_sample(StageStore(spark, scratch_path(spark, "q")), "t", truth.drop("tags").repartition(3), ex, BUCKETS, quota,
                            _tagger(truth), batch, lookahead=lookahead).collect()
    accepted, tagged = _sequential(rows, existing, quota, batch)
    assert {r.id for r in out if r.accepted} == accepted
    eager = N.quota_sample(truth, ex, BUCKETS, quota, spark, batch)
    assert {r.id for r in eager.collect()} == accepted
    got = {}
    for r in out:
        got[r.lang] = got.get(r.lang, 0) + 1
    assert len({r.id for r in out}) == len(out)  # none twice
    assert got == tagged if not lookahead else all(got[k] >= n for k, n in tagged.items())


def test_a_killed_run_goes_on_and_tags_no_row_again(spark):
    rows = _rows(4)
    truth, ex = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([], SCHEMA)
    store, calls = StageStore(spark, scratch_path(spark, "q")), []
    with pytest.raises(KeyboardInterrupt):
        lazy_quota_sample(store, "t", truth.drop("tags"), ex, BUCKETS, 12, _tagger(truth, calls, 2), 8)
    out = lazy_quota_sample(store, "t", truth.drop("tags"), ex, BUCKETS, 12, _tagger(truth, calls), 8).collect()
    accepted, tagged = _sequential(rows, [], 12, 8)
    assert {r.id for r in out if r.accepted} == accepted and sum(calls) == sum(tagged.values()) == len(out)
    again = lazy_quota_sample(store, "t", truth.drop("tags"), ex, BUCKETS, 12, _tagger(truth, calls, 0), 8)
    assert again.count() == len(out)


def test_full_buckets_and_empty_candidates_tag_nothing(spark):
    full = spark.createDataFrame([(f"e{i}", lang, (["p", "q", "r"],)) for i in range(9) for lang in "abd"], SCHEMA)
    truth = spark.createDataFrame(_rows(5), SCHEMA)
    store = StageStore(spark, scratch_path(spark, "q"))
    assert lazy_quota_sample(store, "full", truth.drop("tags"), full.dropDuplicates(["id", "lang"]), BUCKETS, 9, _tagger(truth), 8).count() == 0
    none = spark.createDataFrame([], SCHEMA)
    assert lazy_quota_sample(store, "none", none.drop("tags"), none, BUCKETS, 9, _tagger(truth), 8).count() == 0
