"""Benchmark decontamination over a distributed positional inverted index.

The index is a table of document shards; a shard holds, for each term, the
ascending places of the term among the shard's words.  Phrases are found in
each shard by intersecting lists: the places of the phrase's rarest term
(rarest in the whole corpus) less its offset are candidate starts, and the
next rarest terms' lists, adjusted by their offsets, thin them out.  A shard
has all places of its documents, so no posting is shuffled; documents are
separated by one place that no term has, so no phrase crosses them.
"""

from __future__ import annotations

import hashlib
import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize, ship_package
from .common import byte_slices, drop_rows, with_row_keys

WINDOW = 13
#: Text bytes of a shard; up to this size of the benchmark only its words are indexed, beyond it all words.
SHARD_BYTES = 8 << 20
VOCABULARY_BYTES = 16 << 20
#: Distinct windows searched for in one pass over the index; more are searched for in several.
WINDOWS_PER_PASS = 200_000

_INDEX = ("shard long, doc_ids array<long>, k1 array<long>, k2 array<long>, sizes array<int>, "
          "terms array<long>, counts array<int>, steps binary")
_HITS = ("shard long, doc int, doc_id long, k1 long, k2 long, n_words long, "
         "starts array<int>, ends array<int>, items array<string>")

# word characters are 0-9, a-z and everything beyond ASCII; A-Z are lower-cased; all else separates
_FOLD = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else b + 32 if 0x41 <= b <= 0x5A else 0x20
              for b in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(_FOLD).split() if text else []


def term_of(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word) >> 1


def windows_of(words: list[bytes], window: int = WINDOW) -> list[tuple[bytes, ...]]:
    """All windows of an item; one of its own length where it has fewer words, none where it has none."""
    if not words:
        return []
    return [tuple(words[i:i + window]) for i in range(max(1, len(words) - window + 1))]


# -- the index


def build_index(docs: DataFrame, vocabulary: set[bytes] | None = None) -> DataFrame:
    """Store the postings of ``docs(doc_id, text)`` -- of the words in ``vocabulary``, or all -- as shards."""
    ship_package(docs.sparkSession)
    known = {w: i for i, w in enumerate(sorted(vocabulary))} if vocabulary is not None else None
    known_terms = np.array([term_of(w) for w in known], np.int64) if known is not None else None

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId() << 32
        for whole in batches:
            for batch in byte_slices(whole, "text", SHARD_BYTES):
                texts = batch.column(1).cast(pa.binary()).to_pylist()
                local: dict[bytes, int] = {}
                runs, sizes = [], []
                for text in texts:
                    words = words_of(text)
                    sizes.append(len(words))
                    if known is None:
                        runs.append(np.fromiter((local.setdefault(w, len(local)) for w in words), np.int32, len(words)))
                    else:
                        runs.append(np.fromiter(map(known.get, words, itertools.repeat(-1)), np.int32, len(words)))
                    runs.append(np.array([-1], np.int32))
                codes = np.concatenate(runs)
                terms = known_terms if known is not None else np.array([term_of(w) for w in local], np.int64)
                places = np.flatnonzero(codes >= 0)
                found = codes[places].astype(np.uint16 if len(terms) < 1 << 16 else np.int32)
                order = np.argsort(found, kind="stable")
                present, counts = np.unique(found[order], return_counts=True)
                steps = np.diff(places[order], prepend=0).astype("<i4")
                cell = lambda v, t: pa.array([v], pa.list_(t))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([shard], pa.int64()), *(cell(batch.column(i).to_pylist(), pa.int64()) for i in (0, 2, 3)),
                     cell(sizes, pa.int32()), cell(terms[present], pa.int64()), cell(counts, pa.int32()),
                     pa.array([steps.tobytes()], pa.binary())],
                    names=["shard", "doc_ids", "k1", "k2", "sizes", "terms", "counts", "steps"])
                shard += 1

    return materialize(with_row_keys(docs.select("doc_id", "text")).mapInArrow(post, _INDEX), "positional-index")


def _term_counts(index: DataFrame, terms: set[int]) -> dict[int, int]:
    """How often each asked term occurs in the corpus."""
    each = index.select(F.explode(F.arrays_zip("terms", "counts")).alias("t")).select("t.terms", "t.counts")
    wanted = index.sparkSession.createDataFrame([(t,) for t in terms], "terms long")
    rows = each.join(wanted, "terms", "left_semi").groupBy("terms").agg(F.sum("counts").alias("n"))
    return dict(map(tuple, rows.collect()))  # bounded by the asked terms


class _Shard:
    """The lists of one shard."""

    def __init__(self, row: dict):
        self.sizes = np.array(row["sizes"], np.int64)
        self.first = np.cumsum(self.sizes + 1) - (self.sizes + 1)
        places = np.cumsum(np.frombuffer(row["steps"], "<i4"), dtype=np.int64)
        ends = np.cumsum(row["counts"], dtype=np.int64).tolist()
        self.lists = {t: places[a:b] for t, a, b in zip(row["terms"], [0, *ends[:-1]], ends)} if ends else {}

    def phrase(self, by_rarity: list[tuple[int, int]]) -> np.ndarray:
        """Starts of a phrase given as (term, offset), rarest first."""
        starts = None
        for term, offset in by_rarity:
            places = self.lists.get(term)
            if places is None:
                return np.zeros(0, np.int64)
            if starts is None:
                starts = places - offset
            else:
                at = np.searchsorted(places, starts + offset)
                at[at == len(places)] = 0
                starts = starts[places[at] == starts + offset]
            if not len(starts):
                break
        return starts

    def near(self, by_rarity: list[int], span: int, least: int) -> np.ndarray:
        """Places of the rarest term that have, itself counted, ``least`` of the terms within ``span`` words, in the same document."""
        at = self.lists.get(by_rarity[0])
        if at is None:
            return np.zeros(0, np.int64)
        doc = np.searchsorted(self.first, at, "right") - 1
        low, high = np.maximum(at - span, self.first[doc]), np.minimum(at + span, self.first[doc] + self.sizes[doc] - 1)
        held = np.ones(len(at), np.int64)
        for t in by_rarity[1:]:
            places = self.lists.get(t)
            if places is not None:
                held += np.searchsorted(places, low) < np.searchsorted(places, high, "right")
        return at[held >= least]


# -- the search


def _search(index: DataFrame, windows: dict[tuple[bytes, ...], list[str]]) -> DataFrame:
    """For every document: where windows occur in it (word places), and of which items."""
    term = {w: term_of(w) for w in set(itertools.chain.from_iterable(windows))}
    counts = _term_counts(index, set(term.values()))
    plan = []
    for window, items in windows.items():
        places = [(term[w], i) for i, w in enumerate(window)]
        if all(t in counts for t, _ in places):
            plan.append((sorted(places, key=lambda p: counts[p[0]]), len(window), items))
    shipped = index.sparkSession.sparkContext.broadcast(plan)  # at most WINDOWS_PER_PASS windows

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                shard, n = _Shard(row), len(row["doc_ids"])
                starts: list[list[int]] = [[] for _ in range(n)]
                ends: list[list[int]] = [[] for _ in range(n)]
                items: list[set[str]] = [set() for _ in range(n)]
                for by_rarity, size, of in shipped.value:
                    at = shard.phrase(by_rarity)
                    if len(at):
                        doc = np.searchsorted(shard.first, at, "right") - 1
                        for d, p in zip(doc.tolist(), (at - shard.first[doc]).tolist()):
                            starts[d].append(p)
                            ends[d].append(p + size)
                            items[d].update(of)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["shard"]] * n, pa.int64()), pa.array(range(n), pa.int32()),
                     *(pa.array(row[k], pa.int64()) for k in ("doc_ids", "k1", "k2", "sizes")),
                     pa.array(starts, pa.list_(pa.int32())), pa.array(ends, pa.list_(pa.int32())),
                     pa.array([sorted(s) for s in items], pa.list_(pa.string()))],
                    names=["shard", "doc", "doc_id", "k1", "k2", "n_words", "starts", "ends", "items"])

    return index.mapInArrow(find, _HITS)


def _items(benchmark: DataFrame, window: int, limit: int) -> Iterator[dict[tuple[bytes, ...], list[str]]]:
    """The distinct windows of the benchmark with their items, at most about ``limit`` at a time."""
    held: dict[tuple[bytes, ...], list[str]] = {}
    for row in benchmark.select("item_id", "text").toLocalIterator():
        item = "" if row["item_id"] is None else str(row["item_id"])
        for w in windows_of(words_of((row["text"] or "").encode()), window):
            held.setdefault(w, []).append(item)
        if len(held) >= limit:
            yield held
            held = {}
    if held:
        yield held


def _vocabulary(benchmark: DataFrame) -> set[bytes] | None:
    size = benchmark.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if size > VOCABULARY_BYTES:
        return None
    return {w for r in benchmark.select("text").toLocalIterator() for w in words_of((r["text"] or "").encode())}


def phrase_matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW,
                   windows_per_pass: int = WINDOWS_PER_PASS) -> DataFrame:
    """For every row of ``docs``: its words, the spans (word places) where windows of
    ``benchmark(item_id, text)`` occur, and the items they are of."""
    index = build_index(docs, _vocabulary(benchmark))
    parts = [_search(index, w) for w in _items(benchmark, window, windows_per_pass)] or [_search(index, {})]
    if len(parts) == 1:
        return parts[0]
    all_parts = parts[0]
    for p in parts[1:]:
        all_parts = all_parts.unionByName(p)
    # one row for each document and pass
    return all_parts.groupBy("shard", "doc").agg(
        *(F.first(c).alias(c) for c in ("doc_id", "k1", "k2", "n_words")),
        *(F.flatten(F.collect_list(c)).alias(c) for c in ("starts", "ends")),
        F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))


def proximity_matches(docs: DataFrame, benchmark: DataFrame, n_rarest: int = 4, span: int = 20, share: float = 1.0,
                      least_known: float = 0.5) -> DataFrame:
    """``doc_id, item_id, place``: where ``share`` of an item's ``n_rarest`` rarest terms (rounded up, the rarest
    among them) come within ``span`` words of the rarest one, in any order.

    The rarest terms are taken among those that occur in the corpus: an edited or misspelt word of
    an item hides nothing else of it.  Items of which less than ``least_known`` of the distinct words occur have no match;
    those with fewer than ``n_rarest`` words that occur go by those."""
    index = build_index(docs, _vocabulary(benchmark))
    out = None
    for held in _items(benchmark, 1, WINDOWS_PER_PASS):
        words: dict[str, set[int]] = {}
        for (w,), items in held.items():
            for item in items:
                words.setdefault(item, set()).add(term_of(w))
        counts = _term_counts(index, set().union(*words.values()))
        chosen = []
        for item, ts in words.items():
            known = sorted((t for t in ts if t in counts), key=lambda t: (counts[t], t))
            if known and len(known) >= least_known * len(ts):
                rarest = known[:n_rarest]
                chosen.append((item, rarest, math.ceil(share * len(rarest))))
        plan = index.sparkSession.sparkContext.broadcast(chosen)

        def find(batches: Iterator[pa.RecordBatch], plan=plan) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    row = batch.slice(i, 1).to_pylist()[0]
                    shard = _Shard(row)
                    for item, rarest, least in plan.value:
                        at = shard.near(rarest, span, least)
                        doc = np.searchsorted(shard.first, at, "right") - 1
                        if len(at):
                            yield pa.RecordBatch.from_arrays(
                                [pa.array([row["doc_ids"][d] for d in doc], pa.int64()), pa.array([item] * len(at)),
                                 pa.array(at - shard.first[doc])], names=["doc_id", "item_id", "place"])

        found = index.mapInArrow(find, "doc_id long, item_id string, place long")
        out = found if out is None else out.unionByName(found)
    return out if out is not None else docs.sparkSession.createDataFrame([], "doc_id long, item_id string, place long")


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, one_in: int = 20) -> DataFrame:
    """``doc_id, n_words, n_hit, n_items, items_sha256, contaminated`` (and the row
    keys) for every row of ``docs(doc_id, text)``.

    A word inside any occurrence of a window is hit; a document is contaminated
    if it has a hit and hits are at least one in ``one_in`` words.  Null and
    empty texts have no words.  Items that share an id count once; a null
    item_id is the empty string.  Repeated rows are judged each.  Empty
    documents give no rows, an empty benchmark no hits."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hit, n_items, sha = [], [], []
            for starts, ends, items in zip(*(batch.column(k).to_pylist() for k in (6, 7, 8)), strict=True):
                total = at = 0
                for a, b in sorted(zip(starts, ends, strict=True)):
                    total += max(0, b - max(a, at))
                    at = max(at, b)
                hit.append(total)
                n_items.append(len(items))
                sha.append(hashlib.sha256(",".join(sorted(items)).encode()).hexdigest())
            words = np.array(batch.column(5), np.int64)
            hits = np.array(hit, np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(2), batch.column(3), batch.column(4), batch.column(5), pa.array(hits), pa.array(n_items, pa.int64()),
                 pa.array(sha, pa.string()), pa.array((hits > 0) & (one_in * hits >= words))],
                names=["doc_id", "__k1", "__k2", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])

    return phrase_matches(docs, benchmark, window).mapInArrow(
        digest, "doc_id long, __k1 long, __k2 long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without its contaminated rows."""
    marked = contamination(docs, benchmark).filter("contaminated").select("__k1", "__k2").distinct()
    return drop_rows(docs, materialize(marked, "contaminated"))
