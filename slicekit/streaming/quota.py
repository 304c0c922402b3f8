"""Quota sampling that tags only what it needs.

Tagging a candidate is a model call, so candidates are tagged in waves, in the
order of the seeded shuffle, and no further than the batch that fills the last
required bucket.  Between waves only a small state is kept: for each (language, tag)
how many occurrences there were and, once a bucket is full, the position that filled it.
It is a sum of what the written waves hold, so a killed run builds it again from them
and goes on with the next wave.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions.tags import mt_phenomena
from ..operators.jobs import new_candidates
from ..operators.ordering import running_totals
from ..operators.sample import _buckets_df, bucket_counts, order_key
from ..sources.checkpoint import StageStore

Buckets = dict[str, tuple[tuple[str, ...], tuple[str, ...]]]


@dataclass
class QuotaState:
    """Fills and thresholds of all buckets; as large as the configuration, whatever the data."""

    buckets: Buckets
    quota: int
    batch: int
    total: dict[str, int]  # candidates of each language
    fill: dict[tuple[str, str], int] = field(default_factory=dict)
    threshold: dict[tuple[str, str], int] = field(default_factory=dict)  # 0: full before the first candidate
    tagged: dict[str, int] = field(default_factory=dict)  # candidates tagged, a prefix of the order

    def __post_init__(self) -> None:
        for lang, ph in self._required():
            if self.fill.get((lang, ph), 0) >= self.quota:
                self.threshold[lang, ph] = 0

    def _required(self) -> list[tuple[str, str]]:
        return [(lang, p) for lang, (req, _) in self.buckets.items() for p in req]

    def need(self) -> dict[tuple[str, str], int]:
        """Occurrences the buckets that are not full lack."""
        return {k: self.quota - self.fill.get(k, 0) for k in self._required() if k not in self.threshold}

    def stop(self, lang: str) -> int:
        """The last position that counts: the end of the batch that fills the last required bucket."""
        last = [self.threshold.get((lang, p), math.inf) for p in self.buckets[lang][0]]
        total = self.total.get(lang, 0)
        end = max(last, default=0)
        return total if math.isinf(end) else min(total, -(-end // self.batch) * self.batch)

    def next_wave(self, lookahead: float, max_repeats: int) -> dict[str, tuple[int, int]]:
        """Positions (after, up to) to tag next in each language that is not done.

        A bucket that lacks n occurrences needs n / ``max_repeats`` more candidates at least, so a wave of that many, in
        whole batches, never passes the stop.  ``lookahead`` is the share of the candidates that the rate so far says are
        needed which may be tagged at once instead: fewer waves, at the price of a little tagging past the stop."""
        out = {}
        need = self.need()
        for lang in self.buckets:
            lacking = {p: n for (x, p), n in need.items() if x == lang}
            done, total = self.tagged.get(lang, 0), self.total.get(lang, 0)
            if not lacking or done >= total:
                continue
            batches = math.ceil(max(lacking.values()) / (max_repeats * self.batch))
            if lookahead and done:
                expected = max(n * done / max(1, self.fill.get((lang, p), 0)) for p, n in lacking.items())
                batches = max(batches, int(lookahead * expected / self.batch))
            out[lang] = (done, min(total, done + batches * self.batch))
        return out

    def observe(self, rows: list) -> None:
        """Adds (lang, phenomenon, count, position of the need-th occurrence or None) of one wave."""
        for r in rows:
            k = (r["lang"], r["phenomenon"])
            if r["filled_at"] is not None and k not in self.threshold:
                self.threshold[k] = r["filled_at"]
            self.fill[k] = self.fill.get(k, 0) + r["n"]


def _between(waves: dict[str, tuple[int, int]]) -> Column:
    inside = F.lit(False)
    for lang, (after, upto) in waves.items():
        inside = inside | ((F.col("lang") == lang) & (F.col("_pos") > after) & (F.col("_pos") <= upto))
    return inside


def _observed(spark: SparkSession, wave: DataFrame, state: QuotaState) -> list:
    """What one written wave adds: one row a (language, required tag)."""
    need = state.need()
    occ = wave.filter("tags IS NOT NULL").select("lang", "_pos", F.explode(mt_phenomena("tags")).alias("phenomenon"))
    wanted = spark.createDataFrame([(lang, p, need.get((lang, p), 0)) for lang, p in state._required()] or [("", "", 0)],
                                   "lang string, phenomenon string, need int")
    occ = occ.join(F.broadcast(wanted), ["lang", "phenomenon"])  # as many rows as the configuration has buckets
    # a wave has little more rows of a language than the quota, so numbering its occurrences is bounded by it
    nth = F.row_number().over(Window.partitionBy("lang", "phenomenon").orderBy("_pos"))
    return occ.withColumn("_rn", nth).groupBy("lang", "phenomenon").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.when(F.col("_rn") == F.col("need"), F.col("_pos"))).alias("filled_at")).collect()


def lazy_quota_sample(store: StageStore, table: str, candidates: DataFrame, existing: DataFrame, buckets: Buckets, quota: int,
                      tagger: Callable[[DataFrame], DataFrame], batch_size: int = 32, seed: int = 42,
                      lookahead: float = 0.0, max_repeats: int = 1) -> DataFrame:
    """The candidates that were tagged -- ``id, lang, tags, status, error, _pos, accepted`` -- where ``accepted`` are the
    rows :func:`operators.sample.quota_sample` accepts of the same candidates, all tagged.

    ``candidates(id, lang, ...)`` are untagged; ``tagger(rows)`` gives ``id, lang, _pos, tags, status, error`` for the rows it
    gets (a failed one has null tags and is not accepted).  ``existing(id, lang, tags)`` pre-fill the buckets.
    Each wave is written as a version of ``<table>__tagged`` in the store before it counts; run again with
    the same store and table, the call goes on behind the last written wave.  ``max_repeats`` is how often a tag may occur
    in one list; where lists repeat tags more often, or with a ``lookahead``, rows behind the stop may be tagged, and are never accepted.
    """
    spark = store.spark
    if store.latest(f"{table}__candidates") is None:
        fresh = new_candidates(candidates.filter(F.col("lang").isin(*buckets)), existing).withColumn("_k", order_key(seed, "id"))
        placed = running_totals(fresh, ["lang"], ["_k", "id"], {"_pos": ("sum", F.lit(1).cast("long"))})
        store.write(f"{table}__candidates", placed.drop("_k"))
    ordered = store.read(f"{table}__candidates")
    total = {r["lang"]: r["n"] for r in ordered.groupBy("lang").agg(F.max("_pos").alias("n")).collect()}
    before = bucket_counts(existing, _buckets_df(spark, buckets).filter("required")).collect()
    state = QuotaState(buckets, int(quota), int(batch_size), total, {(r["lang"], r["phenomenon"]): r["n"] for r in before})

    log = f"{table}__tagged"
    waves = [store.read(log, v) for v in store.versions(log)]

    for wave in waves:
        state.observe(_observed(spark, wave, state))
        for r in wave.groupBy("lang").agg(F.max("_pos").alias("n")).collect():
            state.tagged[r["lang"]] = max(state.tagged.get(r["lang"], 0), r["n"])
    while todo := state.next_wave(lookahead, max_repeats):
        v = store.write(log, tagger(ordered.filter(_between(todo))).select("id", "lang", "_pos", "tags", "status", "error"))
        waves.append(store.read(log, v))
        state.observe(_observed(spark, waves[-1], state))
        state.tagged |= {lang: upto for lang, (_, upto) in todo.items()}
    if not waves:
        waves = [spark.createDataFrame([], existing.select("id", "lang", F.lit(0).cast("long").alias("_pos"), "tags",
                                                           F.lit("").alias("status"), F.lit("").alias("error")).schema)]
    tagged = waves[0]
    for wave in waves[1:]:
        tagged = tagged.unionByName(wave)
    return tagged.withColumn("accepted", _accepted(state))


def _accepted(state: QuotaState) -> Column:
    """position <= stop AND (a required tag not behind its threshold OR a bonus tag), from literals of the configuration's size."""
    phenomena, out = mt_phenomena("tags"), F.lit(False)
    for lang, (required, bonus) in state.buckets.items():
        advances = F.arrays_overlap(phenomena, F.array(*map(F.lit, bonus))) if bonus else F.lit(False)
        for p in required:
            upto = state.threshold.get((lang, p), state.total.get(lang, 0))
            advances = advances | (F.array_contains(phenomena, p) & (F.col("_pos") <= upto))
        out = out | ((F.col("lang") == lang) & (F.col("_pos") <= state.stop(lang)) & advances)
    return F.coalesce(F.col("tags").isNotNull() & out, F.lit(False))
