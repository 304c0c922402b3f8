"""Best-fit packing by a grouping genetic algorithm.

A solution is a set of bins (sequences).  Crossover injects whole well-filled
bins of one parent into the other, removes the receiver's bins that hold a
document twice by then, and best-fits the displaced documents, after exchanging
them for smaller ones where that fills a bin better.  Among as many bins the
greater sum of squared fills is fitter; a shard whose bins are as few as its
tokens need is done.  Documents are dealt into shards of a bounded size; each shard is evolved by several islands,
separate tasks that exchange their elite between epochs; the best island's
solution of each shard is taken.  The poorly filled bins that shards leave are
dissolved and packed once more among each other.

Only sizes move: (piece key, length) rows.  Memory per task is bounded by
``SHARD``, and every shard is hashed from the piece key, so no key is hot.
"""

from __future__ import annotations

import math
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize, ship_package
from .common import byte_slices, texts_of
from .tokens import ENCODE_BYTES, encoder, tokenizer_path

CAPACITY = 1024
SHARD = 8192  # pieces a shard holds, about
ISLANDS = 2
EPOCHS = 2
POPULATION = 4
GENERATIONS = 12
PATIENCE = 4  # generations without gain that end an epoch
WELL_FILLED = 0.97  # share of the capacity from which on a bin is injected


# -- one island: plain Python on a bounded shard


class Solution:
    """Bins of one shard: lists of piece numbers, and what each is filled to."""

    def __init__(self, sizes: list[int], capacity: int, bins: list[list[int]] | None = None, fill: list[int] | None = None):
        self.sizes, self.capacity = sizes, capacity
        self.bins = bins or []
        self.fill = fill or [sum(map(sizes.__getitem__, b)) for b in self.bins]

    def best_fit(self, order: list[int]) -> "Solution":
        """Put each piece into the fullest bin that still takes it.  Open bins are
        kept by free space; one integer's bits tell which spaces occur."""
        sizes, cap, bins, fill = self.sizes, self.capacity, self.bins, self.fill
        free: dict[int, list[int]] = {}
        spaces = 0
        for b, f in enumerate(fill):
            if f < cap:
                free.setdefault(cap - f, []).append(b)
                spaces |= 1 << (cap - f)
        for piece in order:
            size = sizes[piece]
            fits = spaces >> size
            if fits:
                space = size + (fits & -fits).bit_length() - 1
                at = free[space]
                b = at.pop()
                if not at:
                    spaces ^= 1 << space
                bins[b] = bins[b] + [piece]  # lists are shared among solutions, never changed
                fill[b] += size
                left = space - size
            else:
                b = len(bins)
                bins.append([piece])
                fill.append(size)
                left = cap - size
            if left:
                held = free.setdefault(left, [])
                if not held:
                    spaces |= 1 << left
                held.append(b)
        return self

    def replace(self, pieces: list[int], rng: np.random.Generator) -> list[int]:
        """Put larger pieces in the place of one or two smaller ones where a bin gets
        fuller by it; the pieces left over, which are smaller than those given."""
        sizes, cap = self.sizes, self.capacity
        out = sorted((sizes[p], p) for p in pieces)
        for b in rng.permutation([b for b, f in enumerate(self.fill) if f < cap]).tolist():
            if not out:
                break
            held, gap = self.bins[b], cap - self.fill[b]
            best = (0, (), -1)
            for i, p in enumerate(held[:8]):
                for q in (None, *held[i + 1:8]):
                    size = sizes[p] + (sizes[q] if q is not None else 0)
                    at = bisect_left(out, (size + gap + 1,)) - 1
                    if at >= 0 and out[at][0] - size > best[0]:
                        best = (out[at][0] - size, (p,) if q is None else (p, q), at)
            gain, gone, at = best
            if gain:
                self.bins[b] = [p for p in held if p not in gone] + [out.pop(at)[1]]
                self.fill[b] += gain
                for p in gone:
                    insort(out, (sizes[p], p))
        return [p for _, p in reversed(out)]

    def rank(self) -> tuple[int, float]:
        """Fewer bins first, and among as many the greater sum of squared fills:
        what is left free lies in few bins then."""
        share = np.array(self.fill) / self.capacity
        return len(self.bins), -float(share @ share)

    def at_bound(self) -> bool:
        return len(self.bins) <= -(-sum(self.fill) // self.capacity)


def rebuild(kept: Solution, displaced: list[int], rng: np.random.Generator) -> Solution:
    """The displaced pieces, exchanged for smaller ones where that fills kept bins, are best-fitted."""
    return kept.best_fit(kept.replace(displaced, rng))


def exact_closings(sizes: list[int], capacity: int, rng: np.random.Generator, choice: str) -> Solution:
    """Bins opened by the largest piece left and closed without free space, by one
    piece or by two, where any such are left; else by the largest pieces that fit.
    Of several pairs: the most ``even`` one, the most ``uneven`` or a ``random`` one."""
    held: list[list[int]] = [[] for _ in range(capacity + 1)]
    for p in rng.permutation(len(sizes)).tolist():
        held[sizes[p]].append(p)
    have = np.array([bool(h) for h in held])
    bins, top = [], capacity

    def take(size: int) -> int:
        piece = held[size].pop()
        have[size] = bool(held[size])
        return piece

    while True:
        while top and not held[top]:
            top -= 1
        if not top:
            return Solution(sizes, capacity, bins)
        bin_, room = [take(top)], capacity - top
        while room and not have[room]:
            pairs = np.flatnonzero(have[1:room // 2 + 1] & have[room - 1:(room - 1) // 2:-1]) + 1
            if len(pairs) and 2 * pairs[-1] == room and len(held[room // 2]) < 2:
                pairs = pairs[:-1]
            if len(pairs):
                size = int(pairs[-1] if choice == "even" else pairs[0] if choice == "uneven" else rng.choice(pairs))
            else:
                fits = np.flatnonzero(have[:room])
                if not len(fits):
                    break
                size = int(fits[-1])
            bin_.append(take(size))
            room -= size
        if room and have[room]:
            bin_.append(take(room))
        bins.append(bin_)


def founder(number: int, sizes: list[int], capacity: int, rng: np.random.Generator) -> Solution:
    """The members a population starts with: best fit in falling order of size (ties in
    random order), exact closings of each kind, and from then on random closings and
    best fit in a disturbed order by turns."""
    choice = ("", "even", "uneven")[number] if number < 3 else ("random", "")[number % 2 == 0]
    if choice:
        return exact_closings(sizes, capacity, rng, choice)
    noise = rng.random(len(sizes)) * (capacity / 50 if number else 0.5)
    return Solution(sizes, capacity).best_fit(np.argsort(-(np.array(sizes) + noise), kind="stable").tolist())


def crossover(a: Solution, b: Solution, rng: np.random.Generator) -> Solution:
    """``a`` with a random half of ``b``'s well-filled bins injected; ``a``'s bins that
    hold a piece twice by then are dissolved."""
    well = [k for k, f in enumerate(b.fill) if f >= WELL_FILLED * b.capacity]
    taken = [k for k, on in zip(well, rng.random(len(well)) < 0.5) if on]
    child = Solution(a.sizes, a.capacity, [b.bins[k] for k in taken], [b.fill[k] for k in taken])
    held = {p for bin_ in child.bins for p in bin_}
    displaced: list[int] = []
    for bin_, fill in zip(a.bins, a.fill):
        if held.isdisjoint(bin_):
            child.bins.append(bin_)
            child.fill.append(fill)
        else:
            displaced += [p for p in bin_ if p not in held]
    return rebuild(child, displaced, rng)


def mutate(s: Solution, rng: np.random.Generator) -> Solution:
    """Dissolve the emptiest bins, a fifth of those not full, and a few of all."""
    order = np.argsort(s.fill, kind="stable")
    part_full = order[:sum(f < s.capacity for f in s.fill)]
    gone = {*order[:2].tolist(), *rng.choice(part_full, len(part_full) // 5, replace=False).tolist(),
            *rng.integers(0, len(order), 2 + len(order) // 100).tolist()}
    stay = [k for k in range(len(order)) if k not in gone]
    kept = Solution(s.sizes, s.capacity, [s.bins[k] for k in stay], [s.fill[k] for k in stay])
    return rebuild(kept, [p for k in sorted(gone) for p in s.bins[k]], rng)


def evolve(sizes: list[int], capacity: int, seed: int, elite: list[list[list[int]]], population: int = POPULATION,
           generations: int = GENERATIONS, patience: int = PATIENCE) -> Solution:
    """The best solution after ``generations``; ``elite`` (bins of earlier solutions) joins
    the population.  Ends early at the least number of bins there can be, and after
    ``patience`` generations without a better solution."""
    rng = np.random.default_rng(seed)
    pool = [Solution(sizes, capacity, bins) for bins in elite]
    while len(pool) < population and not any(s.at_bound() for s in pool):
        pool.append(founder(len(pool) if not elite else 3, sizes, capacity, rng))
    pool.sort(key=Solution.rank)
    stale = 0
    for _ in range(generations):
        if pool[0].at_bound() or stale >= patience or len(pool) < 2:
            break
        before = pool[0].rank()
        mate = pool[1 + int(rng.integers(0, len(pool) - 1))]
        # the worst make room for the children
        born = [mutate(pool[0], rng), mutate(crossover(pool[0], mate, rng), rng), crossover(mate, pool[0], rng)]
        pool = sorted(pool + born, key=Solution.rank)[:population]
        stale = 0 if pool[0].rank() < before else stale + 1
    return pool[0]


# -- the distributed part

_SOLVED = "shard long, island int, bins int, fit double, keys array<long>, lens array<int>, bin_of array<int>"


def _islands(capacity: int, epoch: int):
    """One island of one shard: its pieces, and -- after the first epoch -- its own and its neighbour's elite."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        shard, island = int(rows["shard"].iloc[0]), int(rows["island"].iloc[0])
        elite = []
        if epoch:
            keys, lens = rows["keys"].iloc[0], rows["lens"].iloc[0]
            for bin_of in rows["bin_of"]:
                bins: list[list[int]] = [[] for _ in range(int(max(bin_of)) + 1)]
                for p, b in enumerate(bin_of):
                    bins[b].append(p)
                elite.append(bins)
        else:
            rows = rows.sort_values("key", kind="stable")
            keys, lens = rows["key"].to_numpy(), rows["length"].to_numpy()
        best = evolve([int(x) for x in lens], capacity, zlib.crc32(f"{shard}/{island}/{epoch}".encode()), elite)
        bin_of = np.zeros(len(lens), np.int32)
        for b, held in enumerate(best.bins):
            bin_of[held] = b
        return pd.DataFrame({"shard": [shard], "island": [island], "bins": [len(best.bins)], "fit": [-best.rank()[1]],
                             "keys": [np.asarray(keys, np.int64)], "lens": [np.asarray(lens, np.int32)], "bin_of": [bin_of]})

    return run


def _solve(pieces: DataFrame, n_shards: int, salt: int, capacity: int) -> DataFrame:
    """``shard, key, length, bin`` of the best island of each shard."""
    dealt = pieces.withColumn("shard", F.pmod(F.xxhash64("key", F.lit(salt)), F.lit(n_shards)))
    islands = dealt.select("shard", "key", "length", F.explode(F.array(*map(F.lit, range(ISLANDS)))).alias("island"))
    solved = islands.groupBy("shard", "island").applyInPandas(_islands(capacity, 0), _SOLVED)
    for epoch in range(1, EPOCHS):
        solved = materialize(solved, "pack-epoch")
        # each elite stays, and migrates to the next island of its shard
        moved = solved.select("shard", F.explode(F.array("island", ((F.col("island") + 1) % ISLANDS).cast("int"))).alias("island"),
                              "keys", "lens", "bin_of")
        solved = moved.groupBy("shard", "island").applyInPandas(_islands(capacity, epoch), _SOLVED)
    best = (solved.groupBy("shard")
            .agg(F.min(F.struct("bins", -F.col("fit"), "island", "keys", "lens", "bin_of")).alias("s")))
    return best.select("shard", F.explode(F.arrays_zip("s.keys", "s.lens", "s.bin_of")).alias("p")) \
        .select("shard", F.col("p.keys").alias("key"), F.col("p.lens").alias("length"), F.col("p.bin_of").alias("bin"))


def pack(pieces: DataFrame, capacity: int = CAPACITY, shard: int = SHARD) -> DataFrame:
    """Place ``pieces(key long unique, length int from 1 to capacity)``:
    ``key, length, sequence_id, offset``, as few sequences as the search finds.

    Full pieces fill a sequence alone.  Pieces of equal length are told apart by
    key alone.  An empty table gives no rows."""
    ship_package(pieces.sparkSession)
    full = pieces.filter(F.col("length") >= capacity)
    rest = pieces.filter(F.col("length") < capacity)
    n_shards = max(1, math.ceil(rest.count() / shard))
    first = materialize(_solve(rest, n_shards, 0, capacity).withColumn(
        "fill", F.sum("length").over(_by_bin())), "pack-shards")
    placed = first.withColumn("round", F.lit(0))
    if n_shards > 1:
        # well-filled bins are kept; what the poorly filled ones hold is packed anew among the shards' leftovers
        poor = first.filter(F.col("fill") < capacity * 0.98)
        old, held = poor.agg(F.count_distinct("shard", "bin"), F.count("key")).first()
        if old > 1:
            second = materialize(_solve(poor.select("key", "length"), max(1, math.ceil(held / shard)), 1, capacity), "pack-rest")
            if second.agg(F.count_distinct("shard", "bin")).first()[0] < old:
                placed = (first.filter(F.col("fill") >= capacity * 0.98).drop("fill").withColumn("round", F.lit(0))
                          .unionByName(second.withColumn("round", F.lit(1))))
    from pyspark.sql import Window
    w = Window.partitionBy("round", "shard", "bin").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    # numbers: shards of either round apart, bins of a shard together; full pieces use the negative ones
    number = (F.col("shard") * 2 + F.col("round")) * F.lit(1 << 24) + F.col("bin")
    packed = placed.select("key", F.col("length").cast("int").alias("length"), number.cast("long").alias("sequence_id"),
                           F.coalesce(F.sum("length").over(w), F.lit(0)).cast("long").alias("offset"))
    alone = full.select("key", F.col("length").cast("int").alias("length"),
                        (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return packed.unionByName(alone)


def _by_bin():
    from pyspark.sql import Window
    return Window.partitionBy("shard", "bin")


def token_pieces(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", end_id: int = 2, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of the encoded documents: ``doc_id, piece, start, length, ids_crc32``.

    Documents longer than ``capacity`` are cut so that every piece but the first is full."""
    ship_package(docs.sparkSession)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in byte_slices(whole, "text", ENCODE_BYTES):
                flat, per = encoder(tokenizer_path(tokenizer)).ids(texts_of(batch))
                ends = np.cumsum(per)
                end = np.array([end_id], np.uint32)
                cols: tuple[list, ...] = ([], [], [], [], [])
                for doc, a, b in zip(batch.column(0).to_pylist(), (ends - per).tolist(), ends.tolist(), strict=True):
                    ids = np.concatenate([flat[a:b], end]).astype("<u4")
                    first = (len(ids) - 1) % capacity + 1
                    cuts = [0, *range(first, len(ids) + 1, capacity)]
                    for k, (x, y) in enumerate(zip(cuts, cuts[1:])):
                        for col, v in zip(cols, (doc, k, x, y - x, zlib.crc32(ids[x:y].tobytes()))):
                            col.append(v)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), *(pa.array(c, pa.int64()) for c in cols[2:])],
                    names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select("doc_id", "text").mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack_documents(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", end_id: int = 2, capacity: int = CAPACITY) -> DataFrame:
    """Pack the encoded ``docs(doc_id, text)``: ``doc_id, piece, start, length,
    ids_crc32, sequence_id, offset``, one row per piece.

    Null text is encoded as an empty one (its end id alone).  Every row is a
    document of its own, repeated rows and equal or null ids too.  An empty
    table gives no rows; other columns are not read."""
    pieces = materialize(token_pieces(docs, tokenizer, end_id, capacity)
                         .withColumn("__key", F.monotonically_increasing_id()), "pack-pieces")
    placed = pack(pieces.select(F.col("__key").alias("key"), F.col("length").cast("int").alias("length")), capacity)
    return (pieces.join(placed.select(F.col("key").alias("__key"), "sequence_id", "offset"), "__key")
            .select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"))
