"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Keys held by more than one row in HOT_SHARE join by broadcast: at most HOT_SHARE keys, whatever the input.
HOT_SHARE = 1000

#: Text bytes handled at once inside a task: bounds the memory of a Python worker.
SLICE_BYTES = 2 << 20


_HELD: dict = {}


def worker_state(kind: str, key, build: Callable):
    """What a worker process keeps for an operator between tasks -- one thing at a time: what another operator, or
    this one with another model, left behind is dropped first.  Workers are reused by all stages of a pipeline."""
    if (kind, key) not in _HELD:
        _HELD.clear()
        gc.collect()
        pa.default_memory_pool().release_unused()
        _HELD[kind, key] = build()
    return _HELD[kind, key]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def byte_slices(batch: pa.RecordBatch, column: str, max_bytes: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows whose ``column`` holds about ``max_bytes``
    (a longer single value is a run of its own).  An empty batch gives nothing."""
    if not batch.num_rows:
        return
    sizes = pc.binary_length(batch.column(batch.schema.get_field_index(column))).to_pylist()
    start = held = 0
    for i, n in enumerate(sizes):
        if held and held + (n or 0) > max_bytes:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n or 0
    yield batch.slice(start)


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str | None]:
    return batch.column(batch.schema.get_field_index(column)).to_pylist()


def with_row_keys(docs: DataFrame) -> DataFrame:
    """``docs`` with ``__k1, __k2``: 128 bits that are never null and tell rows
    apart by (doc_id, text); only rows equal in both share them."""
    return docs.withColumns({"__k1": F.xxhash64(F.col("doc_id"), F.col("text")),
                             "__k2": F.xxhash64(F.col("text"), F.lit("#"), F.col("doc_id"))})


def drop_rows(docs: DataFrame, marked: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose keys are not in ``marked(__k1, __k2)``.

    AQE broadcasts ``marked`` only when its measured size is under the session's
    threshold, and else joins by shuffle."""
    return with_row_keys(docs).join(marked, ["__k1", "__k2"], "left_anti").drop("__k1", "__k2")


def keep_one_row(docs: DataFrame, marked: DataFrame) -> DataFrame:
    """One row of ``docs`` for each key of ``marked(__k1, __k2)``."""
    return (with_row_keys(docs).join(marked, ["__k1", "__k2"], "left_semi")
            .dropDuplicates(["__k1", "__k2"]).drop("__k1", "__k2"))


def join_counted(left: DataFrame, right: DataFrame, keys: list[str], count: str, total: int) -> DataFrame:
    """Inner join with ``right``, unique in ``keys``, whose column ``count`` says how many of ``left``'s ``total`` rows
    (or more) have the key.  Hot keys are broadcast, and no other fills a partition of the shuffled join."""
    hot = F.col(count) * HOT_SHARE > F.lit(total)
    few = F.broadcast(right.filter(hot).drop(count).withColumn("__hot", F.lit(True)))
    marked = left.join(few, keys, "left")
    rest = marked.filter("__hot IS NULL").select(*left.columns).join(right.filter(~hot).drop(count), keys)
    return marked.filter("__hot").drop("__hot").unionByName(rest)
