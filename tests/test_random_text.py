"""Random Unicode text: JVM-side chrF and stripping equal the Python definitions."""

import random

import pytest

from slicekit.functions.text import remove_whitespace, ustrip
from slicekit.operators import chrf as C

from .test_chrf import py_chrf

# every character Python treats as whitespace (29 code points), plus
# zero-width / BOM look-alikes that are not whitespace
SPACES = "".join(chr(i) for i in range(0x110000) if chr(i).isspace())
NOT_SPACES = "\u200b\u180e\ufeff"
LETTERS = "abcdeéüßçñøあ語😀𝔘"


def _rand_text(rng: random.Random, n: int) -> str:
    pool = LETTERS * 4 + SPACES + NOT_SPACES
    return "".join(rng.choice(pool) for _ in range(n))


def test_whitespace_sets():
    assert len(SPACES) == 29
    assert not any(c.isspace() for c in NOT_SPACES)


def test_strip_and_split_random(spark):
    rng = random.Random(3)
    texts = [_rand_text(rng, rng.randint(0, 40)) for _ in range(300)]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string") \
        .select("i", ustrip("t").alias("s"), remove_whitespace("t").alias("w")).collect()
    for r in rows:
        t = texts[r.i]
        assert r.s == t.strip(), repr(t)
        assert r.w == "".join(t.split()), repr(t)


def test_chrf_random_pairs(spark):
    rng = random.Random(5)
    pairs = []
    for i in range(200):
        ref = _rand_text(rng, rng.randint(0, 60))
        hyp = ref if i % 7 == 0 else _rand_text(rng, rng.randint(1, 60))
        pairs.append((i, hyp, ref))
    df = spark.createDataFrame(pairs, "i int, hyp string, ref string")
    got = {r.i: r.chrf for r in C.chrf_sentence(df, ["i"]).collect()}
    assert len(got) == 200
    for i, hyp, ref in pairs:
        assert got[i] == pytest.approx(py_chrf(hyp, ref), abs=1e-9), (hyp, ref)
