"""Stage tables bucketed by item id, so that merges and work lists do not move them.

Every table of one :class:`BucketStore` has the same number of buckets by the same
column.  What joins or groups by a key that begins with it -- the anti-joins of the
work lists (J6), the merge of results (J3), of earlier items (J2), the nested export
(R9) -- then reads matching buckets, and only the results of a stage, which are few,
are shuffled into them.

Versions are append-only folders below ``root`` as in :mod:`.checkpoint`; the catalog
only holds their description, which ``read`` restores after a restart.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import EvalConfig
from ..operators import jobs as J
from ..operators import prep as P
from ..operators import reshape as R
from ..session import scratch_path
from .checkpoint import StageStore


#: What a bucket holds of a table at most, about: a task sorts a bucket of both sides of a join.
BUCKET_ROWS, BUCKET_BYTES = 100_000, 64 << 20


def bucket_count(*tables: DataFrame) -> int:
    """The number of buckets for a store of ``tables``, from their measured rows and text bytes, so that a task's share
    does not grow with them; at least the session's shuffle partitions.  What a work list expands its items to counts as
    a table.  One pass over each table; a store that its tables outgrow is written anew with more buckets."""
    spark = tables[0].sparkSession

    def size(df: DataFrame) -> DataFrame:
        text = [F.coalesce(F.octet_length(c), F.lit(0)) for c, kind in df.dtypes if kind in ("string", "binary")]
        return df.agg(F.count(F.lit(1)).alias("n"), F.sum(reduce(lambda a, b: a + b, text, F.lit(0).cast("long"))).alias("bytes"))

    sizes = reduce(DataFrame.unionByName, map(size, tables)).collect()
    need = max(max(-(-r.n // BUCKET_ROWS), -(-(r.bytes or 0) // BUCKET_BYTES)) for r in sizes)
    most = int(spark.conf.get("spark.sql.sources.bucketing.maxBuckets"))
    return min(max(need, int(spark.conf.get("spark.sql.shuffle.partitions"))), most)


class BucketStore:
    """``buckets`` should grow with the largest table, see ``bucket_count``; the same number
    must be given when a store is opened again.  Rows with one id lie in one bucket, so
    ``key`` must be a column of many values, such as an item's id."""

    def __init__(self, spark: SparkSession, root: str | None = None, buckets: int = 64, key: str = "id"):
        self.spark, self.buckets, self.key = spark, buckets, key
        self.store = StageStore(spark, root or scratch_path(spark, "buckets"))
        self._tables: dict[tuple[str, int], str] = {}
        # a join on (id, model, condition) may use that both sides lie by id
        spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
        # the bucket scan is what the plans here are made for, also where only one side has one
        spark.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", "false")

    def _name(self, stage: str, version: int) -> str:
        return f"slicekit_{''.join(c if c.isalnum() else '_' for c in stage)}_{version}_{uuid.uuid4().hex[:12]}"

    def write(self, stage: str, df: DataFrame) -> int:
        """The next version of ``stage``: one sorted file a bucket, and its number."""
        return self._save(stage, self.route(df))

    def read(self, stage: str, version: int | None = None) -> DataFrame:
        """A version (the newest without one) as a bucketed table."""
        version = version if version is not None else self.store.latest(stage)
        if version is None:
            raise ValueError(f"no version of {stage} has been written")
        if (stage, version) not in self._tables:
            name, path = self._name(stage, version), self.store.path(stage, version)
            columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in self.spark.read.parquet(path).schema)
            self.spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY (`{self.key}`) "
                           f"SORTED BY (`{self.key}`) INTO {self.buckets} BUCKETS LOCATION '{path}'")
            self._tables[stage, version] = name
        return self.spark.table(self._tables[stage, version])

    def route(self, results: DataFrame) -> DataFrame:
        """Rows shuffled to the buckets they belong to."""
        return results.repartition(self.buckets, self.key)

    def _merged(self, stage: str) -> DataFrame:
        """A stage for a join bucket by bucket: few bytes of Parquet can be many rows, and each task would hold all of
        them if Spark broadcast them by that size."""
        return self.read(stage).hint("merge")

    # -- the operators on stored stages

    def pending_infer(self, items: str, cells: str, cfg: EvalConfig, status: str | None = None) -> DataFrame:
        """Cells of ``items`` without an answer, without an exchange."""
        return J.pending_infer(self.read(items), self._merged(cells), cfg, status)

    def upsert(self, stage: str, results: DataFrame, keys: list[str], payload: list[str]) -> int:
        """The next version of ``stage``, with ``results`` merged in; only the results are shuffled."""
        return self._save(stage, J.upsert(self.read(stage), self.route(results), keys, payload))

    def merge_existing(self, fresh: str, existing: str, allowed_datasets) -> DataFrame:
        """J2 of two stored tables, without an exchange."""
        return P.merge_existing(self.read(fresh), self._merged(existing), allowed_datasets, self.key)

    def nested(self, items: str, cells: str) -> DataFrame:
        """A record for each item with all its cells, without an exchange."""
        return R.nest_results(self.read(items), self._merged(cells))

    def _save(self, stage: str, rows: DataFrame) -> int:
        """Writes rows that lie by bucket already."""
        version = self.store.next_version(stage)
        name = self._name(stage, version)
        (rows.write.format("parquet").bucketBy(self.buckets, self.key).sortBy(self.key)
         .option("path", self.store.path(stage, version)).saveAsTable(name))
        self._tables[stage, version] = name
        return version
