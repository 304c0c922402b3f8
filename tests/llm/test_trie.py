"""The prefix trie against a plain dictionary of prefixes."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from slicekit.llm import trie as T

SCHEMA = "conv_id long, turn long, role string, text string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def _rebuilt(rows):
    own = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            own[c].append(((t is not None, t or 0), r or "", x or ""))
    own = {c: [(r, x) for _, r, x in sorted(v)] for c, v in own.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        m = c % 5 if c >= 0 else -(-c % 5)
        out[c] = own.get(c - m, [])[:h] + turns[h:]
    return out


def _brute(convs):
    members = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for p in members:
        if p:
            children[p[:-1]] += 1
    for p, m in members.items():
        gain = (len(m) - 1) * len(p[-1][1].encode()) if p else 0
        for d in range(len(p) + 1):
            saved[p[:d]] += gain
            leaves[p[:d]] += p not in children
    return sorted((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), children[p], leaves[p], saved[p],
                   hashlib.sha256(",".join(map(str, sorted(c for c in m if len(convs[c]) == len(p)))).encode()).hexdigest())
                  for p, m in members.items())


def _rows(seed, n=80, first=-10, turns=9, words=3):
    rng = random.Random(seed)
    rows = [(c, t, rng.choice(["user", "assistant"]), rng.choice(["a", "bé", "", "long text"][:words]))
            for c in range(first, n) if rng.random() < 0.8 for t in range(rng.randrange(0, turns))]
    rows += [(c, t, "user", "hot") for c in range(1000, 1040) for t in range(3)]  # one conversation many times
    rows += [(2000, t, "user", f"t{t % 7}") for t in range(300)]  # a long one
    rows += [(2001, t, "user", f"t{t % 7}") for t in range(250)] + [(2005, t, "user", f"t{t % 7}") for t in range(280)]
    rows += [(None, 1, "user", "no id"), (3, None, None, None), (3, None, "user", "x"), (3, 0, "user", "same"), (3, 0, "user", "same")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed, local_load", [(1, 1), (2, 40), (3, T.LOCAL_LOAD)])
def test_trie_equals_brute_force(spark, seed, local_load):
    rows = _rows(seed)
    got = T.conversation_trie(spark.createDataFrame(rows, SCHEMA).repartition(5), local_load=local_load)
    assert got.columns == COLUMNS
    assert sorted(map(tuple, got.collect())) == _brute(_rebuilt(rows))


def test_a_piece_boundary_in_a_long_conversation(spark, monkeypatch):
    monkeypatch.setattr(T, "PIECE", 16)
    rows = [(5 * c, t, "user", str(t if t < 20 * c else (c, t))) for c in range(1, 5) for t in range(90)]
    got = T.conversation_trie(spark.createDataFrame(rows, SCHEMA), local_load=10)
    assert sorted(map(tuple, got.collect())) == _brute(_rebuilt(rows))


def test_empty_turnless_and_clashing(spark):
    assert T.conversation_trie(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(1, 0, "user", "x")]  # its turns come from conversation 0, which is absent
    got = T.conversation_trie(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(map(tuple, got)) == _brute(_rebuilt(rows))
    rows = _rows(9, n=20)
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("9") for c in ("a", "b", "pa", "depth", "load", "h", "pos", "base", "n_turns")})
    assert sorted(map(tuple, T.conversation_trie(df).collect())) == _brute(_rebuilt(rows))
