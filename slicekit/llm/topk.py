"""Exact top-k inner products by MaxScore.

Vectors are documents of terms (dimensions) with integer weights.  For a query,
a term's contribution in a shard lies between two bounds taken from the term's
posting list; the terms with the narrowest bounds, which together cannot lift a
vector over the current threshold, are non-essential.  Essential postings are
traversed for all vectors of the shard; the others are probed, the widest first,
only for vectors that can still compete.  Shards' results are merged.

Vectors are dealt into shards and queries into blocks of bounded size.  A shard goes
to its task once; the blocks follow it there, one in memory at a time, and give back
k rows a query.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize, ship_package

SHARD = 16_384  # vectors, about
BLOCK = 512  # queries, about


#: Vectors with a larger component take no part: so scores stay within 38 digits.
LARGEST = 2 ** 56


class Postings:
    """The vectors of one shard by term, with the bounds of each list.

    ``rows`` tells vectors apart, ``ids`` is what they are called."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray, weights: np.ndarray):
        order = np.lexsort((rows, ids))
        self.rows, self.ids = rows[order], ids[order]
        by_term = np.ascontiguousarray(weights[order].T)  # (terms, vectors)
        self.low, self.high = (by_term.min(axis=1), by_term.max(axis=1)) if len(ids) else (None, None)
        self.big = int(np.abs(weights).max(initial=0))
        self.lists = {np.int64: by_term}

    def _typed(self, query: np.ndarray) -> type:
        """The fastest type in which the sums of this query's products are exact."""
        most = int(np.abs(query).max(initial=0)) * self.big * max(1, len(self.lists[np.int64]))
        kind = np.float64 if most < 1 << 52 else np.int64 if most < 1 << 61 else object
        if kind not in self.lists:
            self.lists[kind] = self.lists[np.int64].astype(kind)
        return kind

    def top(self, row: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k best vectors but that of ``row``; ties to smaller ids."""
        n = len(self.ids)
        if not n:
            return self.ids, np.zeros(0, np.int64)
        kind = self._typed(query)
        by_term = self.lists[kind]
        m = min(len(query), len(by_term))
        q, lists = query[:m].astype(kind), by_term[:m]
        low, high = self.low[:m].astype(kind), self.high[:m].astype(kind)
        bound = np.where(q > 0, q * high, q * low)  # the most a term gives
        least = np.where(q > 0, q * low, q * high)
        spread = bound - least
        order = np.argsort(-spread, kind="stable")  # widest bounds first
        rest = np.concatenate([np.cumsum(bound[order][::-1])[::-1], np.zeros(1, kind)])  # the most the terms from here on give
        # threshold: the k-th best of the strongest postings of the widest lists, scored in full
        seeds = np.unique(np.concatenate([
            np.argpartition(-(q[t] * lists[t]).astype(np.float64), min(8 * k, n - 1))[:8 * k] for t in order[:4]])) \
            if m else np.zeros(0, np.int64)
        seeds = seeds[self.rows[seeds] != row]
        known = np.sort((q @ lists[:, seeds]) if len(seeds) else np.zeros(0, kind))[::-1]
        floor = known[k - 1] if len(known) >= k else None
        # essential: the fewest widest terms without which nothing reaches the threshold
        essential = m
        if floor is not None and m:
            slack = np.cumsum(spread[order][::-1])[::-1]  # what the terms from here on can add to the least
            essential = max(1, int((slack >= floor - least.sum()).sum()))
        at = order[:essential]
        score = q[at] @ lists[at] if m else np.zeros(n, kind)
        live = np.flatnonzero(self.rows != row)
        score = score[live]
        for j in range(essential, m):  # probe while competitive
            if floor is not None:
                ok = score + rest[j] >= floor
                live, score = live[ok], score[ok]
            if not len(live):
                break
            score = score + q[order[j]] * lists[order[j]][live]
        if len(live) > k:
            ok = score >= np.sort(score)[len(score) - k] if kind is object else score >= np.partition(score, len(score) - k)[len(score) - k]
            live, score = live[ok], score[ok]
        best = np.array(sorted(range(len(live)), key=lambda i: (-score[i], self.ids[live[i]]))[:k], np.int64) if kind is object \
            else np.lexsort((self.ids[live], -score))[:k]
        return self.ids[live[best]], score[best]


def quantised(embeddings: DataFrame) -> DataFrame:
    """``vec_id, weights``: floor(256 * x) of every component.  Rows without an id take no part, nor do vectors that are
    null, hold null or non-finite components, or one whose integer is beyond ``LARGEST``."""
    x = F.transform("embedding", lambda v: v.cast("double"))
    fit = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v * 256) <= F.lit(float(LARGEST))))
    return (embeddings.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).filter(fit)
            .select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, lambda v: F.floor(v * 256)).alias("weights")))


def _packed(group: str):
    """One row for a group of vectors."""

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        width = int(rows["weights"].map(len).max())
        matrix = np.zeros((len(rows), width), np.int64)  # shorter vectors have no term there
        for r, w in enumerate(rows["weights"]):
            matrix[r, :len(w)] = w
        return pd.DataFrame({group: [rows[group].iloc[0]], "width": [width], "rows": [rows["row"].to_numpy(np.int64).tobytes()],
                             "ids": [rows["vec_id"].to_numpy(np.int64).tobytes()], "weights": [matrix.tobytes()]})

    return pack


def _unpacked(record: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rows, ids = (np.frombuffer(record[c], np.int64) for c in ("rows", "ids"))
    return rows, ids, np.frombuffer(record["weights"], np.int64).reshape(len(ids), record["width"])


def top_k(queries: DataFrame, candidates: DataFrame, k: int = 5, shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """``row, query_id, rank, vec_id, score``: the k best ``candidates(row, vec_id, weights)`` of each of
    ``queries(row, vec_id, weights)`` by integer inner product, ties to the smaller id.

    ``row`` is a number of its own for each row: a query is not compared with the candidate of its own row, and
    rows that share an id are all candidates (and all queries).  Vectors of unequal length are compared as far as both go.
    Fewer than k others: all of them.  ``score`` is a decimal: products of large components may pass a long."""
    ship_package(candidates.sparkSession)
    n_shards = max(1, math.ceil(candidates.count() / shard))
    n_blocks = max(1, math.ceil(queries.count() / block))

    def packed(rows: DataFrame, name: str, n: int) -> DataFrame:
        return rows.withColumn(name, F.pmod(F.xxhash64("row"), F.lit(n)).cast("int")).groupBy(name).applyInPandas(
            _packed(name), f"{name} int, width int, rows binary, ids binary, weights binary")

    shards = packed(candidates, "shard", n_shards)
    blocks = materialize(packed(queries, "block", n_blocks), "query-blocks")
    # each shard once, and behind it each block
    met = shards.withColumn("block", F.lit(-1)).unionByName(
        blocks.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(n_shards - 1)))))
    met = met.repartition("shard").sortWithinPartitions("shard", "block")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, postings = None, None
        for batch in batches:
            for i in range(batch.num_rows):
                record = batch.slice(i, 1).to_pylist()[0]
                rows, ids, weights = _unpacked(record)
                if record["block"] < 0:
                    at, postings = record["shard"], Postings(rows, ids, weights)
                    continue
                if at != record["shard"]:
                    continue  # a shard that hashing left empty
                found = [postings.top(int(r), w, k) for r, w in zip(rows, weights)]
                each = [len(f[0]) for f in found]
                score = [str(int(x)) for f in found for x in f[1]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(rows, each)), pa.array(np.repeat(ids, each)),
                     pa.array(np.concatenate([f[0] for f in found])), pa.array(score, pa.string())],
                    names=["row", "query_id", "vec_id", "score"])

    near = met.select("shard", "block", "width", "rows", "ids", "weights") \
        .mapInArrow(search, "row long, query_id long, vec_id long, score string") \
        .withColumn("score", F.col("score").cast("decimal(38,0)"))
    w = Window.partitionBy("row").orderBy(F.desc("score"), "vec_id")  # k rows from each shard
    return (near.withColumn("rank", F.row_number().over(w).cast("int")).filter(F.col("rank") <= k)
            .select("row", "query_id", "rank", "vec_id", "score"))


def nearest_vectors(embeddings: DataFrame, k: int = 5, every: int = 50) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k best other vectors for every vector whose id is divisible by ``every``.

    Ranks go by the exact score; a score that a long cannot hold is returned as null."""
    vectors = materialize(quantised(embeddings).withColumn("row", F.monotonically_increasing_id()), "vectors")
    found = top_k(vectors.filter(F.col("vec_id") % every == 0), vectors, k)
    return found.select("query_id", "rank", "vec_id", F.col("score").try_cast("long").alias("score"))
