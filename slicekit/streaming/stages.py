"""Incremental, resumable stage runs in waves.

A stage (tag, infer, judge, translate, score) is run as a sequence of
*waves*: each wave takes a hash slice of the work list, runs the user function
over it and appends the raw results -- keys, payload and status only, never
the texts -- as one more version of a narrow results table.  The wide table is
merged and written once, after the last wave, so a wave costs what it calls,
whatever the table holds.  A killed run goes on from the results it has: their
keys are no longer on the work list, and no row that was answered is asked again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.enrich import enrich_missing
from ..operators.jobs import upsert
from ..sources.checkpoint import StageStore


def run_stage_in_waves(store: StageStore, table: str, work_list: Callable[[DataFrame], DataFrame],
                       fn: Callable[[dict], dict], out_schema: str, keys: list[str], payload: list[str],
                       waves: int = 1, parallelism: int | None = None,
                       to_payload: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Run one stage over the newest version of ``table`` and write the next one.

    ``work_list(table_df)`` returns the pending rows (with every column the
    function needs); ``to_payload`` may post-process results (e.g. derive
    ``correct`` from a verdict) before the merge.  Returns the final table.
    """
    version = store.latest(table)
    if version is None:
        raise ValueError(f"stage table {table!r} has no version yet")
    cur = store.read(table, version)
    log = f"{table}__results/of={version:06d}"  # results that are not merged into a later version yet
    parts = [store.read(log, v) for v in store.versions(log)]
    for w in range(waves):
        work = work_list(cur)
        if waves > 1:
            work = work.filter(F.pmod(F.xxhash64(*[F.col(k) for k in keys]), F.lit(waves)) == w)
        for done in parts:
            work = work.join(done.filter("status = 'ok'").select(*keys), keys, "left_anti")
        v = store.write(log, enrich_missing(work, fn, out_schema, keys, parallelism))
        parts.append(store.read(log, v))
    results = parts[0]
    for part in parts[1:]:
        results = results.unionByName(part)
    if to_payload is not None:
        results = to_payload(results)
    return store.read(table, store.write(table, upsert(cur, results, keys, payload)))
