"""Whitening of embeddings by the weighted covariance of their distinct vectors.

Vectors are brought to integers, ``floor(scale * c) + shift``, and identical ones
grouped once, with their count.  Sums of the fit are exact integers; each distinct
vector enters a centred matrix product once, weighted by its count (or by one),
and is whitened once; rows get the result of their vector by a join.  Whitened
vectors go to few numbers: everything the driver holds is a matrix of dimensions.

Rows without part: a null vector, null or non-finite entries, entries whose
integer passes 2**62, no entries, and another number of entries than most rows
have (ties: the smaller number).  Components whose eigenvalue is below
``RANK_SHARE`` of the trace have no scale to divide by and are not returned, so a
table of equal vectors, or of one, gives no row.  Rows are kept as they are: one
set of results for each, also where vec_id is null or repeats; other columns are
left out.  ``deviation`` is null where a long cannot hold it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize, ship_package
from .common import join_counted

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 32
#: Eigenvalues under this share of the trace are rounding.
RANK_SHARE = 1e-12

_LONG = 2 ** 63


def integer_vectors(df: DataFrame, id_col: str = "vec_id", vector: str = "embedding", scale: int = SCALE,
                    shift: int = SHIFT) -> DataFrame:
    """``vec_id, x, k1, k2``: the rows that take part, their integers and a 128-bit key of these."""
    c = F.transform(F.col(vector), lambda v: v.cast("double"))
    fit = F.forall(c, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v * F.lit(float(scale))) < F.lit(2.0 ** 62)))
    x = F.transform(c, lambda v: F.floor(v * F.lit(float(scale))).cast("long") + F.lit(shift))
    rows = df.filter(F.col(vector).isNotNull()).filter(fit & (F.size(vector) > 0)) \
        .select(F.col(id_col).alias("vec_id"), x.alias("x"))
    return rows.withColumns({"k1": F.xxhash64("x"), "k2": F.xxhash64(F.lit(1), "x")})


def most_common_width(rows: DataFrame) -> int:
    """The number of entries most rows have; 0 for no rows."""
    first = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return first["d"] if first else 0


def _matrix(column: pa.Array, d: int, dtype) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(dtype, copy=False).reshape(-1, d)


def _partial_sums(d: int):
    """Exact per-dimension sums of a partition, as decimal digits."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [0] * (d + 1)
        for b in batches:
            if not b.num_rows:
                continue
            x, w = _matrix(b["x"], d, np.int64), b["weight"].to_numpy(zero_copy_only=False).astype(np.int64)
            if int(w.sum()) * max(abs(int(x.max())), abs(int(x.min()))) >= _LONG:
                x, w = x.astype(object), w.astype(object)
            for j, s in enumerate((x * w[:, None]).sum(axis=0)):
                total[j] += int(s)
            total[d] += int(w.sum())
        if total[d]:
            yield pa.record_batch({"dim": pa.array(range(d + 1), pa.int32()), "part": pa.array([str(t) for t in total])})
    return run


def exact_sums(distinct: DataFrame, d: int) -> tuple[int, list[int]]:
    """Weight and per-dimension sums of the fit list: d + 1 numbers come to the driver."""
    parts = distinct.select("x", "weight").mapInArrow(_partial_sums(d), "dim int, part string")
    rows = parts.groupBy("dim").agg(F.sum(F.col("part").cast("decimal(38,0)")).alias("s")).collect()
    sums = {r["dim"]: int(r["s"]) for r in rows}
    return sums.get(d, 0), [sums.get(j, 0) for j in range(d)]


def _partial_products(column: str, centre: np.ndarray):
    """Upper rows of ``sum(weight * (v - centre) (v - centre)^T)`` over a partition."""
    d = len(centre)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = np.zeros((d, d)), False
        for b in batches:
            if b.num_rows:
                v = _matrix(b[column], d, np.float64) - centre
                total += (v * b["weight"].to_numpy(zero_copy_only=False)[:, None]).T @ v
                seen = True
        if seen:
            i, j = np.triu_indices(d)
            yield pa.record_batch({"i": pa.array(i, pa.int32()), "j": pa.array(j, pa.int32()), "v": pa.array(total[i, j])})
    return run


def weighted_covariance(distinct: DataFrame, column: str, centre: np.ndarray, n: int) -> np.ndarray:
    """Covariance about ``centre`` over the fit list, divisor n, as a matrix on the driver."""
    d = len(centre)
    parts = distinct.select(column, "weight").mapInArrow(_partial_products(column, centre), "i int, j int, v double")
    entries = parts.groupBy("i", "j").agg(F.sum("v").alias("v")).toArrow()
    i, j, v = (entries[c].to_numpy() for c in ("i", "j", "v"))
    cov = np.zeros((d, d))
    cov[i, j] = cov[j, i] = v / n
    return cov


def _deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """``sum((n * x - S)^2)`` of each row, exactly."""
    s = np.array(sums, dtype=object)
    largest = max(abs(int(x.max())), abs(int(x.min())))
    if n * largest < _LONG and max(map(abs, sums)) < _LONG:
        diff = x * np.int64(n) - s.astype(np.int64) if n * largest + max(map(abs, sums)) < _LONG else x.astype(object) * n - s
    else:
        diff = x.astype(object) * n - s
    if diff.dtype != object and int(np.abs(diff).max()) ** 2 * x.shape[1] >= _LONG:
        diff = diff.astype(object)
    return [v if v < _LONG else None for v in map(int, (diff * diff).sum(axis=1))]


def _whiten(n: int, sums: list[int], centre: np.ndarray, projection: np.ndarray):
    """Each distinct vector projected once, with its deviation."""
    d, k = projection.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = _matrix(b["x"], d, np.int64)
            z = (x.astype(np.float64) - centre) @ projection
            offsets = pa.array(np.arange(len(z) + 1, dtype=np.int32) * k)
            yield pa.record_batch({
                "k1": b["k1"], "k2": b["k2"], "x": b["x"], "weight": b["weight"], "held": b["held"],
                "deviation": pa.array(_deviations(x, n, sums), pa.int64()),
                "z": pa.ListArray.from_arrays(offsets, pa.array(z.ravel()))})
    return run


def components_of(cov: np.ndarray, limit: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors, as columns, of the components with a scale.

    The sign makes the entry of largest size positive."""
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1], vectors[:, ::-1]
    keep = (values > RANK_SHARE * max(np.trace(cov), 0.0))[:limit].sum()
    values, vectors = values[:keep], vectors[:, :keep]
    if keep:
        signs = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(keep)])
        vectors = vectors * np.where(signs == 0, 1.0, signs)
    return values, vectors


def whiten_embeddings(df: DataFrame, id_col: str = "vec_id", vector: str = "embedding", weights: str = "counts",
                      components: int = COMPONENTS, scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """``vec_id, n, deviation, z, explained, identity_error`` of every row that takes part.

    ``z`` and ``explained`` are arrays over the components.  ``weights="counts"`` fits on all rows, ``"one"`` on each
    distinct vector once; n, the centre and the covariance then are those of the distinct vectors.
    """
    if weights not in ("counts", "one"):
        raise ValueError(f"weights must be 'counts' or 'one', not {weights!r}")
    spark = df.sparkSession
    ship_package(spark)
    rows = materialize(integer_vectors(df, id_col, vector, scale, shift), "vectors")
    d = most_common_width(rows)
    rows = rows.filter(F.size("x") == d)
    held = F.count(F.lit(1))
    distinct = rows.groupBy("k1", "k2", "x").agg(held.alias("held"))
    distinct = materialize(distinct.withColumn("weight", F.col("held") if weights == "counts" else F.lit(1).cast("long")),
                           "distinct")
    n, sums = exact_sums(distinct, d) if d else (0, [])
    if not n:
        return _empty(rows)
    centre = np.array([s // n + (s % n) / n for s in sums])
    cov = weighted_covariance(distinct, "x", centre, n)
    values, vectors = components_of(cov, components)
    if not len(values):
        return _empty(rows)
    white = materialize(distinct.mapInArrow(
        _whiten(n, sums, centre, vectors / np.sqrt(values)),
        "k1 long, k2 long, x array<long>, weight long, held long, deviation long, z array<double>"), "whitened")
    zero = np.zeros(len(values))
    error = float(np.abs(weighted_covariance(white, "z", zero, n) - np.eye(len(values))).max())
    out = join_counted(rows, white.select("k1", "k2", "x", "held", "deviation", "z"), ["k1", "k2", "x"], "held", rows.count())
    explained = [float(v) for v in values / np.trace(cov)]
    return out.select("vec_id", F.lit(n).cast("long").alias("n"), "deviation", "z",
                      F.array(*map(F.lit, explained)).alias("explained"), F.lit(error).alias("identity_error"))


def _empty(rows: DataFrame) -> DataFrame:
    none = {"n": "long", "deviation": "long", "z": "array<double>", "explained": "array<double>", "identity_error": "double"}
    return rows.filter(F.lit(False)).select("vec_id", *[F.lit(None).cast(t).alias(c) for c, t in none.items()])


def whitened_components(df: DataFrame, **options) -> DataFrame:
    """One row for each row of ``whiten_embeddings`` and component, numbered from 1 by falling eigenvalue."""
    out = whiten_embeddings(df, **options)
    return out.select("vec_id", F.posexplode(F.arrays_zip("z", "explained")).alias("p", "c"), "n", "deviation", "identity_error") \
        .select("vec_id", (F.col("p") + 1).cast("int").alias("component"), "n", "deviation",
                F.col("c.z").alias("whitened"), F.col("c.explained").alias("explained"), "identity_error")
