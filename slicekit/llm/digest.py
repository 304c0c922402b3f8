"""SHA-256 of the concatenation of a group's pieces, in order, for groups of any size."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of consecutive pieces that travel as one row.
BLOCK_BYTES = 1 << 20
_FLUSH_ROWS = 1024


def _rows(batches: Iterator[pa.RecordBatch], names: list[str]):
    for b in batches:
        yield from zip(*(b[n].to_pylist() for n in names))


def _record(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def _blocks(keys: int, pieces: int, seps: list[bytes]):
    """Joins consecutive pieces of one key, in a sorted partition, to blocks."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(f"k{i}", pa.string()) for i in range(keys)] + [("part", pa.int64()), ("at", pa.int64())]
                           + [(f"p{i}", pa.binary()) for i in range(pieces)])
        out, size, at = [], 0, 0
        current, part, held, nbytes = None, 0, None, 0
        names = [f"k{i}" for i in range(keys)] + ["part"] + [f"p{i}" for i in range(pieces)]

        def block():
            return (*current, part, at, *[sep.join(h) if h else None for sep, h in zip(seps, held)])

        for row in _rows(batches, names):
            key, values = row[:keys], row[keys + 1:]
            if current != key or nbytes > BLOCK_BYTES:
                if held is not None:
                    out.append(block())
                    size, at = size + nbytes, at + 1
                    if len(out) >= _FLUSH_ROWS or size > BLOCK_BYTES:
                        yield _record(out, schema)
                        out, size = [], 0
                current, part, held, nbytes = key, row[keys], [[] for _ in range(pieces)], 0
            for h, v in zip(held, values):
                if v is not None:
                    h.append(v)
                    nbytes += len(v) + 1
        if held is not None:
            out.append(block())
        if out:
            yield _record(out, schema)
    return run


def _digests(keys: int, seps: list[bytes]):
    """One hash state for each piece column and key of a sorted partition: constant memory."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(f"k{i}", pa.string()) for i in range(keys)] + [(f"d{i}", pa.string()) for i in range(len(seps))])
        out, current, states, begun = [], None, None, None
        for row in _rows(batches, [f"k{i}" for i in range(keys)] + [f"p{i}" for i in range(len(seps))]):
            key = row[:keys]
            if key != current:
                if states is not None:
                    out.append((*current, *[s.hexdigest() for s in states]))
                    if len(out) >= _FLUSH_ROWS:
                        yield _record(out, schema)
                        out = []
                current, states, begun = key, [hashlib.sha256() for _ in seps], [False] * len(seps)
            for i, block in enumerate(row[keys:]):
                if block is not None:
                    if begun[i]:
                        states[i].update(seps[i])
                    states[i].update(block)
                    begun[i] = True
        if states is not None:
            out.append((*current, *[s.hexdigest() for s in states]))
        if out:
            yield _record(out, schema)
    return run


def ordered_digests(df: DataFrame, keys: list[str], order: list[str], pieces: dict[str, str], seps: dict[str, str] | None = None) -> DataFrame:
    """``keys`` and, for each ``name: column`` of ``pieces``, the SHA-256 (lowercase hex) of the column's
    values in ``order``, joined by ``seps[name]`` (nothing by default); null values are no pieces.

    Rows are sorted by ranges of (keys, order), so a large group is sorted and joined to blocks by many tasks;
    only the hash itself, which is sequential, then streams a group's blocks through one task.
    Keys come back as they were; null keys are a group of their own.
    """
    seps = seps or {}
    joints = [seps.get(n, "").encode() for n in pieces]
    ks, ps = [f"k{i}" for i in range(len(keys))], [f"p{i}" for i in range(len(pieces))]
    laid = (df.select(*[F.col(k).cast("string").alias(n) for k, n in zip(keys, ks)],
                      *[F.col(c).alias(f"__o{i}") for i, c in enumerate(order)],
                      *[F.col(c).cast("binary").alias(n) for c, n in zip(pieces.values(), ps)])
            .repartitionByRange(*ks, *[f"__o{i}" for i in range(len(order))])
            .sortWithinPartitions(*ks, *[f"__o{i}" for i in range(len(order))])
            .select(*ks, F.spark_partition_id().cast("long").alias("part"), *ps))
    key_schema = [f"{k} string" for k in ks]
    blocks = laid.mapInArrow(_blocks(len(keys), len(pieces), joints),
                             ", ".join([*key_schema, "part long", "at long", *[f"{p} binary" for p in ps]]))
    dealt = blocks.repartition(*ks).sortWithinPartitions(*ks, "part", "at")
    out = dealt.mapInArrow(_digests(len(keys), joints),
                           ", ".join([*key_schema, *[f"d{i} string" for i in range(len(pieces))]]))
    types = {f.name: f.dataType for f in df.schema.fields}
    return out.select(*[F.col(n).cast(types[k] if not isinstance(types[k], T.NullType) else "string").alias(k)
                        for k, n in zip(keys, ks)],
                      *[F.col(f"d{i}").alias(n) for i, n in enumerate(pieces)])
