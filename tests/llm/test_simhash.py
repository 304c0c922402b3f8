"""SimHash: fingerprints bit by bit, and components against all pairs."""

import random
from collections import defaultdict

import numpy as np
import pytest
import xxhash

from slicekit.llm import simhash as S
from slicekit.llm.graph import connected_components

from .helpers import EDGE_ROWS, documents, prose, with_clashes


def _plain_fingerprint(text, k=4):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words, word = [], ""
    for c in low + " ":
        if c in " \t\n\x0b\x0c\r":
            if word:
                words.append(word)
            word = ""
        else:
            word += c
    if not words:
        return 0
    shingles = [" ".join(words[i:i + k]) for i in range(max(1, len(words) - k + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def _plain_components(rows, bits=4):
    fps = [_plain_fingerprint(t) for _, t in rows]
    up = list(range(len(rows)))

    def find(i):
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= bits:
                up[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return sorted((str(d), f"{fps[i]:016x}", str(least.get(find(i)))) for i, (d, _) in enumerate(rows))


def _near_copies(seed, n=40):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        words = prose(rng, rng.randint(1, 30)).split()
        for _ in range(rng.choice([1, 1, 1, 2, 6])):
            rows.append((len(rows), " ".join(words)))
            words = list(words)
            for _ in range(rng.randint(0, 2)):
                words[rng.randrange(len(words))] = rng.choice(words)
    rng.shuffle(rows)
    return rows


def test_components_equal_all_pairs(spark):
    rows = _near_copies(1) + [(d + 1000 if d is not None and d < 100 else d, t) for d, t in EDGE_ROWS]
    got = S.simhash_components(with_clashes(documents(spark, rows))).collect()
    assert sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in got) == _plain_components(rows)
    assert len({r.component_id for r in got}) < len(rows) - 20
    assert S.simhash_components(documents(spark, [])).count() == 0


@pytest.mark.parametrize("bits", [1, 2, 3, 4, 7])
def test_links_give_the_components_of_all_pairs(spark, bits):
    rng = np.random.default_rng(bits)
    base = rng.integers(0, 1 << 63, 12, dtype=np.uint64)
    fps = {int(b) for b in base}
    for b in base:  # chains and clouds around each
        x = int(b)
        for _ in range(40):
            for p in rng.integers(0, 64, int(rng.integers(1, bits + 2))):
                x ^= 1 << int(p)
            fps.add(x)
            x = int(b) if rng.random() < 0.5 else x
    fps = sorted(fps)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    links = S.fingerprint_links(spark.createDataFrame([(f,) for f in signed], "fp long").repartition(5), bits)
    up = {f: f for f in signed}

    def find(f):
        while up[f] != f:
            f = up[f]
        return f

    for r in links.collect():
        assert ((r.a ^ r.b) & (1 << 64) - 1).bit_count() <= bits
        up[find(r.a)] = find(r.b)
    for i, a in enumerate(fps):
        for j in range(i):
            if (a ^ fps[j]).bit_count() <= bits:
                assert find(signed[i]) == find(signed[j])


def test_a_group_gives_at_most_one_link_for_each_member():
    ring = S.Ring(4)
    members = np.array(sorted({1 << i for i in range(40)} | {0}), np.uint64)
    a, b = S._links_in_group(members, ring)
    assert sum(map(len, b)) == len(members) - 1


def test_groups_that_span_batches(spark):
    """The link step carries a key from one Arrow batch to the next."""
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        rows = [(i, f"same words here now and then again in document {i % 7}") for i in range(30)]
        got = S.simhash_components(documents(spark, rows)).collect()
        assert sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in got) == _plain_components(rows)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)


def test_one_row_of_each_component_stays(spark):
    rows = _near_copies(2) + EDGE_ROWS
    docs = with_clashes(documents(spark, rows))
    kept = S.drop_near_copies(docs)
    assert kept.columns == docs.columns
    comps = defaultdict(list)
    up = _plain_components([(i, t) for i, (_, t) in enumerate(rows)])
    for i, _, c in up:
        comps[c].append(rows[int(i)][0])
    want = sorted(str(min((d for d in ids if d is not None), default=None)) for ids in comps.values())
    assert sorted(str(r.doc_id) for r in kept.collect()) == want
    assert S.drop_near_copies(documents(spark, [])).count() == 0


def test_components_of_long_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 160)] + [(200, 200), (5, 4)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{i: 100 for i in range(100, 160)}}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
