"""The attempt ledger against a plain retry loop."""

import random

import pytest
from pyspark.sql import functions as F

from slicekit.session import scratch_path
from slicekit.sources.checkpoint import StageStore
from slicekit.streaming.ledger import TAGGER, TRANSLATOR, RetryPolicy, run_attempts


def _world(spark, seed=1, n=40, tries=7):
    """What each key's k-th attempt gives: a text, an empty reply (rejected) or nothing (an error)."""
    rng = random.Random(seed)
    table = {(k, a): rng.choice(["good", "", None]) for k in range(n) for a in range(1, tries)}
    replies = spark.createDataFrame([(k, a, v) for (k, a), v in table.items() if v is not None], "k int, attempt int, reply string")
    return table, spark.createDataFrame([(k, f"text {k}") for k in range(n)], "k int, source string"), replies


def _ask(replies, rounds=None, die_after=None):
    def ask(rows):
        if rounds is not None:
            if die_after is not None and len(rounds) >= die_after:
                raise KeyboardInterrupt
            rounds.append(sorted((r.k, r.attempt) for r in rows.collect()))
        return rows.join(replies, ["k", "attempt"])
    return ask


def _accept(rows):
    ok = F.col("reply") != ""
    return rows.select("*", F.when(ok, F.concat("source", F.lit(": "), "reply")).alias("text"),
                       F.when(ok, "ok").otherwise("rejected").alias("status"), F.when(~ok, "empty reply").alias("error"))


def _plain(table, n, policy):
    out = {}
    for k in range(n):
        for a in range(1, policy.max_attempts + 1):
            v = table[k, a]
            if v:
                out[k] = (a, "ok", f"text {k}: good", None)
                break
        else:
            error = "no reply" if v is None else "empty reply"
            out[k] = (a, "failed", None, error) if policy.fallback is None else (a, "fallback", policy.fallback["text"], error)
    return out


class Clock:
    def __init__(self):
        self.now, self.slept = 1000.0, []

    def __call__(self):
        return self.now

    def sleep(self, s):
        self.slept.append(s)
        self.now += s


def _run(spark, store, requests, ask, policy, clock):
    out = run_attempts(store, "r", requests, ask, _accept, ["k"], ["text"], policy, clock, clock.sleep)
    return {r.k: (r.attempt, r.status, r.text, r.error) for r in out.collect()}


@pytest.mark.parametrize("policy", [TRANSLATOR, RetryPolicy(1)])
def test_equals_a_retry_loop_and_asks_only_failed_keys_that_are_due(spark, policy):
    table, requests, replies = _world(spark)
    rounds, clock = [], Clock()
    got = _run(spark, StageStore(spark, scratch_path(spark, "l")), requests, _ask(replies, rounds), policy, clock)
    assert got == _plain(table, 40, policy)
    assert sum(clock.slept) <= sum(policy.wait(k) for k in range(policy.max_attempts - 1))
    asked = [x for r in rounds for x in r]
    want = [(k, a) for k in range(40) for a in range(1, policy.max_attempts + 1) if not any(table[k, b] for b in range(1, a))]
    assert sorted(asked) == sorted(want)  # each attempt once
    if policy is TRANSLATOR:  # rejected replies wait for nothing, errors do
        assert rounds[1] == [(k, 2) for k in range(40) if table[k, 1] == ""]


def test_a_killed_run_keeps_its_counts(spark):
    table, requests, replies = _world(spark, seed=3)
    store, rounds, clock = StageStore(spark, scratch_path(spark, "l")), [], Clock()
    with pytest.raises(KeyboardInterrupt):
        _run(spark, store, requests, _ask(replies, rounds, 2), TAGGER, clock)
    got = _run(spark, store, requests, _ask(replies, rounds), TAGGER, Clock())
    assert got == _plain(table, 40, TAGGER)
    assert len([x for r in rounds for x in r]) == len({x for r in rounds for x in r})  # no attempt twice


def test_no_requests(spark):
    _, requests, replies = _world(spark)
    store = StageStore(spark, scratch_path(spark, "l"))
    assert _run(spark, store, requests.limit(0), _ask(replies), TAGGER, Clock()) == {}
