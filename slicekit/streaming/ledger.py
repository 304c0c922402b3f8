"""Retries as a ledger of attempts.

A retry loop around a call keeps its count in the memory of one Python worker: a lost
task starts again from nothing.  Here every attempt is a row -- key, attempt, outcome, earliest
next try -- and a round of attempts a written version of the ledger, so counts survive lost
executors, killed drivers and new sessions, and a round runs only the keys that failed and are due.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.checkpoint import StageStore


@dataclass(frozen=True)
class RetryPolicy:
    """How often to try, how long to wait after the k-th failure (from 0), and what the last failure gives.

    ``fallback`` values make the last failure a result of status ``fallback``; without them it stays ``failed``.
    With ``wait_on_reject`` false a reply that was rejected is asked for again at once, an error still waits."""

    max_attempts: int
    wait: Callable[[int], float] = lambda k: 0.0
    wait_on_reject: bool = True
    fallback: dict | None = None


#: Two fixed policies: an invalid tag reply is an error after two retries; a translation becomes empty after five tries.
TAGGER = RetryPolicy(3, lambda k: 1.0 + 0.5 * k)
TRANSLATOR = RetryPolicy(5, lambda k: float(min(60, 2 ** k)), wait_on_reject=False, fallback={"text": ""})


def attempt_states(log: DataFrame, keys: list[str]) -> DataFrame:
    """The last attempt of every key of the ledger's rows."""
    rest = [c for c in log.columns if c not in keys]
    last = log.groupBy(*keys).agg(F.max_by(F.struct(*rest), "attempt").alias("_last"))
    return last.select(*keys, "_last.*")


def run_attempts(store: StageStore, name: str, requests: DataFrame, ask: Callable[[DataFrame], DataFrame],
                 accept: Callable[[DataFrame], DataFrame], keys: list[str], payload: list[str], policy: RetryPolicy,
                 clock: Callable[[], float] = time.time, sleep: Callable[[float], None] = time.sleep) -> DataFrame:
    """Asks for every request until its reply is accepted or the policy's attempts are used up.

    ``requests`` are unique in ``keys``.  ``ask(rows)`` adds the reply's columns to the rows it gets, which carry
    ``attempt`` (from 1); ``accept(rows)`` adds the ``payload`` columns, ``status`` -- ``ok``, ``rejected`` (a
    reply that does not parse) or ``error`` (no reply) -- and ``error``.  A row that ``ask`` drops is an error.
    Returns the ledger's last row for every key: ``keys, attempt, status, <payload>, error, next_try`` with status ``ok``,
    ``failed`` or ``fallback``.  Called again with the same store and name it goes on with the counts there are.
    """
    log_name = f"{name}__attempts"
    versions = [store.read(log_name, v) for v in store.versions(log_name)]
    while True:
        now = clock()
        if versions:
            log = versions[0]
            for v in versions[1:]:
                log = log.unionByName(v)
            last = attempt_states(log, keys)
            again = last.filter("status = 'retry'")
            due = requests.join(again.filter(F.col("next_try") <= F.lit(now)).select(*keys, "attempt"), keys) \
                .withColumn("attempt", F.col("attempt") + 1)
            due = due.unionByName(requests.join(log.select(*keys), keys, "left_anti").withColumn("attempt", F.lit(1)))
        else:
            due = requests.withColumn("attempt", F.lit(1))
        if due.isEmpty():
            if not versions:
                store.write(log_name, _outcomes(due, ask, accept, keys, payload, policy, now))
                return attempt_states(store.read(log_name), keys)
            waiting = again.agg(F.min("next_try")).first()[0]
            if waiting is None:
                return last
            sleep(max(0.0, waiting - clock()))
            continue
        v = store.write(log_name, _outcomes(due, ask, accept, keys, payload, policy, now))
        versions.append(store.read(log_name, v))


def _outcomes(due: DataFrame, ask: Callable, accept: Callable, keys: list[str], payload: list[str], policy: RetryPolicy,
              now: float) -> DataFrame:
    """The ledger rows of one round."""
    got = accept(ask(due)).select(*keys, *payload, "status", "error")
    x = due.select(*keys, "attempt").join(got.withColumn("_seen", F.lit(True)), keys, "left")
    status = F.coalesce("status", F.lit("error"))
    ok, used_up = status == "ok", F.col("attempt") >= policy.max_attempts
    fallback = policy.fallback or {}
    final = F.lit("fallback" if policy.fallback is not None else "failed")
    waits = F.element_at(F.array(*[F.lit(float(policy.wait(k))) for k in range(policy.max_attempts)]), F.col("attempt"))
    if not policy.wait_on_reject:
        waits = F.when(status == "rejected", 0.0).otherwise(waits)
    types = {f.name: f.dataType for f in x.schema.fields}
    values = [F.when(ok, F.col(p)).when(used_up, F.lit(fallback.get(p)).cast(types[p])).alias(p) for p in payload]
    return x.select(
        *keys, "attempt", F.when(ok, "ok").when(used_up, final).otherwise("retry").alias("status"), *values,
        F.when(~ok, F.coalesce("error", F.when(F.col("_seen").isNull(), "no reply"), F.lit("unknown error"))).alias("error"),
        F.when(~ok & ~used_up, F.lit(now) + waits).alias("next_try"))
