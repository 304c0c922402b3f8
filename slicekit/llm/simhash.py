"""SimHash near-duplicates with pigeonring filtering.

A fingerprint of 64 bits is seen as a ring of ``d + 1`` segments for links of at
most ``d`` differing bits.  If two fingerprints link, then from some segment of
the ring every chain of ``l`` segments differs in at most ``l * d / (d + 1)``
bits: 0 in the first, 1 in the first two, and so on.  The first two lengths
make the join keys -- the start segment whole, the next one with one bit
masked -- and the longer chains prune candidates before the full check.

Distinct fingerprints only are compared.  Inside a group of one key, linked
members are found by a search over the members not yet reached, which gives
at most one link for each member instead of all pairs, and loses no component.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize, ship_package
from .common import byte_slices, keep_one_row, with_row_keys
from .graph import connected_components

SHINGLE = 4
MAX_BITS = 4
SEED = 42


# -- fingerprints


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """The 64 bits of one text as a signed number; 0 where it has no words."""
    words = (text or b"").lower().split()  # bytes: A-Z and the six ASCII blanks only
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(words) - shingle + 1)
    digest = xxhash.xxh64_digest
    hashes = b"".join([digest(joined[a:b], SEED) for a, b in zip(starts[:n].tolist(), ends[-n:].tolist())])
    total = np.zeros(64, np.int64)
    rows = np.frombuffer(hashes, np.uint8).reshape(n, 8)
    for at in range(0, n, 1 << 14):
        total += np.unpackbits(rows[at:at + (1 << 14)], axis=1).sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * total > n).view(">u8")[0].astype(np.uint64).view(np.int64))


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``doc_id, __k1, __k2, fp`` of every row, whole texts, no shuffle."""
    ship_package(docs.sparkSession)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in byte_slices(whole, "text"):
                texts = batch.column(1).cast(pa.binary()).to_pylist()
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(2), batch.column(3),
                     pa.array([fingerprint(t, shingle) for t in texts], pa.int64())],
                    names=["doc_id", "__k1", "__k2", "fp"])

    return (with_row_keys(docs.select("doc_id", "text"))
            .mapInArrow(scan, "doc_id long, __k1 long, __k2 long, fp long"))


# -- the ring


class Ring:
    """Segments of 64 bits, the masks of chains of segments, and their budgets."""

    def __init__(self, max_bits: int):
        if max_bits < 1:
            raise ValueError("links of 0 bits are equal fingerprints; ask for 1 bit or more")
        self.m = max_bits + 1
        cuts = [64 * i // self.m for i in range(self.m + 1)]
        self.width = [b - a for a, b in zip(cuts, cuts[1:])]
        self.shift = cuts[:-1]
        self.max_bits = max_bits
        segment = [((1 << w) - 1) << s for w, s in zip(self.width, self.shift)]
        #: for each start: (mask, budget) of the chains longer than the two segments of the key
        self.chains = [[(np.uint64(sum(segment[(i + k) % self.m] for k in range(length))), length * max_bits // self.m)
                        for length in range(3, self.m)] for i in range(self.m)]

    def keys(self, fp: np.ndarray) -> Iterator[np.ndarray]:
        """One array of keys for each (start, masked bit): a key holds both beside the segments."""
        seg = [(fp >> np.uint64(s)) & np.uint64((1 << w) - 1) for s, w in zip(self.shift, self.width)]
        place = 0
        for i in range(self.m):
            nxt, w = (i + 1) % self.m, self.width[(i + 1) % self.m]
            for j in range(w):
                # at most 2 * 32 bits of segments beside the place: mixed, so that any width fits 64 bits
                rest = seg[nxt] & ~np.uint64(1 << j)
                mixed = (seg[i] << np.uint64(w)) | rest
                if self.width[i] + w <= 52:
                    yield (np.uint64(place) << np.uint64(self.width[i] + w)) | mixed
                else:
                    yield mixed * np.uint64(0x9E3779B97F4A7C15) + np.uint64(place)
                place += 1

    def linked(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether pairs link: the chains first, the full check on what they leave."""
        diff = a ^ b
        ok = np.zeros(len(diff), bool)
        for chain in self.chains:
            left = np.ones(len(diff), bool)
            for mask, budget in chain:
                left &= np.bitwise_count(diff & mask) <= budget
            ok |= left
        at = np.flatnonzero(ok)
        ok[at] = np.bitwise_count(diff[at]) <= self.max_bits
        return ok


def _links_in_group(members: np.ndarray, ring: Ring) -> tuple[list, list]:
    """Links that join the members of one key exactly as all their pairs would:
    each member reached is compared with those not yet reached."""
    rest, out_a, out_b = members, [], []
    while len(rest):
        queue, rest = [rest[:1]], rest[1:]
        while queue and len(rest):
            one = queue.pop()
            for x in one:
                if not len(rest):
                    break
                hit = ring.linked(np.broadcast_to(x, rest.shape), rest)
                if hit.any():
                    found = rest[hit]
                    out_a.append(np.full(len(found), x))
                    out_b.append(found)
                    queue.append(found)
                    rest = rest[~hit]
    return out_a, out_b


def fingerprint_links(fps: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Links ``a, b`` between the distinct ``fps(fp)`` that give the same
    components as all pairs within ``max_bits``."""
    ship_package(fps.sparkSession)
    ring = Ring(max_bits)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(0)
            for key in ring.keys(column.to_numpy(zero_copy_only=False).view(np.uint64)):
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), column], names=["key", "fp"])

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_k, held_f = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        for batch in _with_end(batches):
            if batch is None:
                ready_k, ready_f = held_k, held_f
            else:  # the last key may go on in the next batch
                k = np.concatenate([held_k, batch.column(0).to_numpy(zero_copy_only=False)])
                f = np.concatenate([held_f, batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)])
                cut = int(np.searchsorted(k, k[-1])) if len(k) else 0
                ready_k, ready_f, held_k, held_f = k[:cut], f[:cut], k[cut:], f[cut:]
            a, b = _links_by_key(ready_k, ready_f, ring)
            if len(a):
                pairs = np.unique(np.stack([a, b], axis=1), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].view(np.int64)), pa.array(pairs[:, 1].view(np.int64))],
                                                 names=["a", "b"])

    return (fps.select("fp").mapInArrow(spread, "key long, fp long")
            .repartition("key").sortWithinPartitions("key", "fp")
            .mapInArrow(link, "a long, b long").distinct())


def _with_end(batches):
    yield from batches
    yield None


def _links_by_key(key: np.ndarray, fp: np.ndarray, ring: Ring) -> tuple[np.ndarray, np.ndarray]:
    """Links of all groups of equal keys; ``key`` is sorted."""
    none = np.zeros(0, np.uint64)
    if len(key) < 2:
        return none, none
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    size = np.diff(np.concatenate([first, [len(key)]]))
    pair = first[size == 2]
    hit = ring.linked(fp[pair], fp[pair + 1])
    out_a, out_b = [fp[pair][hit]], [fp[pair + 1][hit]]
    for at, n in zip(first[size > 2].tolist(), size[size > 2].tolist()):
        a, b = _links_in_group(fp[at:at + n], ring)
        out_a += a
        out_b += b
    return np.concatenate(out_a).astype(np.uint64), np.concatenate(out_b).astype(np.uint64)


# -- documents


def _classes(docs: DataFrame, shingle: int, max_bits: int) -> tuple[DataFrame, DataFrame]:
    """The rows' fingerprints, and ``fp, root, least`` (smallest id) of every distinct one."""
    rows = materialize(fingerprints(docs, shingle), "fingerprints")
    distinct = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "fingerprints-distinct")
    roots = materialize(connected_components(fingerprint_links(distinct, max_bits)), "fingerprint-roots")
    return rows, distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left") \
        .select("fp", F.coalesce("root", "fp").alias("root"), "least")


def simhash_components(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """``doc_id, fingerprint, component_id`` for every row of ``docs(doc_id, text)``.

    Texts without words, null ones too, have fingerprint zero and link like any
    other.  ``component_id`` is the smallest doc_id of the component; null ids
    don't count and get it as well, and a component without any id has null.
    Repeated rows are kept each.  An empty table gives no rows; other columns
    are not read."""
    rows, classes = _classes(docs, shingle, max_bits)
    of_root = classes.groupBy("root").agg(F.min("least").alias("component_id"))
    return (rows.join(classes.join(of_root, "root").select("fp", "component_id"), "fp")
            .select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"))


def drop_near_copies(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """``docs`` with one row of each component: that of the smallest doc_id (null
    ids last), equal ids in the order of their row keys."""
    rows, classes = _classes(docs, shingle, max_bits)
    first = (rows.join(classes.select("fp", "root"), "fp").groupBy("root")
             .agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "__k1", "__k2")).alias("s"))
             .select("s.__k1", "s.__k2"))
    return keep_one_row(docs, first)
