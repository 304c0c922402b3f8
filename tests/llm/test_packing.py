"""Packing: every piece placed once, no gap, near the least number of sequences."""

import random
import zlib
from collections import defaultdict

import numpy as np
from tokenizers import Tokenizer

from slicekit.llm import packing
from slicekit.llm.tokens import tokenizer_path

from .helpers import EDGE_ROWS, documents, prose, with_clashes


def _check(rows, docs, capacity=1024):
    library = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    places = defaultdict(list)
    for r in rows:
        places[r.sequence_id].append((r.offset, r.length))
    for held in places.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at and length > 0
            at += length
        assert at <= capacity
    total, want = 0, []
    for d, t in docs:
        ids = np.array(library.encode(t or "", add_special_tokens=False).ids + [2], "<u4")
        total += len(ids)
        first = (len(ids) - 1) % capacity + 1
        cuts = [0, *range(first, len(ids) + 1, capacity)]
        want += [(str(d), k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    assert sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in rows) == sorted(want)
    return len(places), -(-total // capacity)


def test_edge_rows_are_packed_whole(spark):
    _check(packing.pack_documents(with_clashes(documents(spark, EDGE_ROWS))).collect(), EDGE_ROWS)
    assert packing.pack_documents(documents(spark, [])).count() == 0


def test_few_sequences(spark):
    rng = random.Random(4)
    docs = [(i, prose(rng, rng.randint(1, 40))) for i in range(400)]
    n, least = _check(packing.pack_documents(documents(spark, docs)).collect(), docs)
    assert n <= least * 1.02 + 1


def test_many_shards_and_the_second_round(spark):
    rng = np.random.default_rng(5)
    sizes = [int(x) for x in rng.integers(1, 1024, 3000)] + [1024] * 7
    pieces = spark.createDataFrame(list(enumerate(sizes)), "key long, length int").repartition(4)
    rows = packing.pack(pieces, shard=300).collect()
    assert sorted((r.key, r.length) for r in rows) == list(enumerate(sizes))
    fill = defaultdict(int)
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == fill[r.sequence_id]
        fill[r.sequence_id] += r.length
    assert max(fill.values()) <= 1024
    assert len(fill) <= -(-sum(sizes) // 1024) * 1.03 + 1  # shards of 300 pieces


def test_evolution_keeps_all_pieces_and_does_not_get_worse():
    rng = np.random.default_rng(6)
    sizes = [int(x) for x in rng.integers(100, 600, 500)]
    plain = packing.Solution(sizes, 1024).best_fit(sorted(range(500), key=lambda i: -sizes[i]))
    best = packing.evolve(sizes, 1024, 1, [plain.bins], generations=15)
    assert sorted(p for b in best.bins for p in b) == list(range(500))
    assert all(sum(sizes[p] for p in b) == f <= 1024 for b, f in zip(best.bins, best.fill))
    assert len(best.bins) <= len(plain.bins)


def test_crossover_injects_full_bins_and_removes_duplicates():
    sizes = [512] * 8
    a = packing.Solution(sizes, 1024, [[0, 1], [2, 3], [4, 5], [6, 7]])
    b = packing.Solution(sizes, 1024, [[0, 2], [1, 3], [4, 6], [5, 7]])
    child = packing.crossover(a, b, np.random.default_rng(0))
    assert sorted(p for x in child.bins for p in x) == list(range(8)) and len(child.bins) == 4


def test_best_fit_takes_the_fullest_bin_that_fits():
    s = packing.Solution([600, 500, 400, 100], 1000).best_fit([0, 1, 2, 3])
    assert s.bins == [[0, 2], [1, 3]]


def _plain(sizes, capacity):
    return packing.Solution(sizes, capacity).best_fit(sorted(range(len(sizes)), key=lambda i: -sizes[i]))


def _valid(s, sizes, capacity):
    assert sorted(p for b in s.bins for p in b) == list(range(len(sizes)))
    assert all(sum(sizes[p] for p in b) == f <= capacity for b, f in zip(s.bins, s.fill))
    return len(s.bins)


def test_fewer_sequences_than_plain_best_fit():
    rng = np.random.default_rng(8)
    triplets = []
    for _ in range(60):  # 60 sequences can hold them
        a = int(rng.integers(390, 500))
        b = int(rng.integers(256, (1024 - a) // 2 + 1))
        triplets += [a, b, 1024 - a - b]
    cases = [(triplets, 1024, 8), ([int(x) for x in rng.integers(20, 101, 1500)], 150, 4),
             ([int(x) for x in rng.integers(200, 700, 1500)], 1024, 5)]
    for sizes, capacity, saved in cases:
        best = _valid(packing.evolve(sizes, capacity, 1, []), sizes, capacity)
        assert -(-sum(sizes) // capacity) <= best <= len(_plain(sizes, capacity).bins) - saved


def test_generations_gain_over_their_founders():
    """From best fit alone, without exact closings, crossover and mutation save sequences."""
    rng = np.random.default_rng(9)
    sizes = [int(x) for x in rng.integers(200, 700, 600)]
    elite = [_plain(sizes, 1024).bins]
    for k in range(3):
        noise = rng.random(600) * 20
        elite.append(packing.Solution(sizes, 1024).best_fit(sorted(range(600), key=lambda i: -sizes[i] - noise[i])).bins)
    best = _valid(packing.evolve(sizes, 1024, 1, elite), sizes, 1024)
    assert best < min(map(len, elite))


def test_exact_closings_place_every_piece():
    rng = np.random.default_rng(10)
    for choice in ("even", "uneven", "random"):
        for n in (0, 1, 2, 9, 300):
            sizes = [int(x) for x in rng.integers(1, 24, n)]
            _valid(packing.exact_closings(sizes, 24, rng, choice), sizes, 24)


def test_replace_takes_larger_pieces_in():
    sizes = [500, 300, 310, 224]
    s = packing.Solution(sizes, 1024, [[0, 1]])  # 224 free
    left = s.replace([2, 3], np.random.default_rng(0))
    assert s.fill == [sum(sizes[p] for p in s.bins[0])] and s.fill[0] > 800
    assert sorted(left + s.bins[0]) == [0, 1, 2, 3]
