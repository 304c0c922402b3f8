"""chrF: the Spark job against a plain Python count of the same definition."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from slicekit.operators import chrf as C

SF = "/root/testdata/sf0.01"


def py_chrf(hyp: str, ref: str, order: int = 6, beta: float = 2.0) -> float:
    h, r = "".join(hyp.split()), "".join(ref.split())
    ps, rs, eff = 0.0, 0.0, 0
    for n in range(1, order + 1):
        hc = Counter(h[i:i + n] for i in range(len(h) - n + 1))
        rc = Counter(r[i:i + n] for i in range(len(r) - n + 1))
        hn, rn = (sum(hc.values()) if rc else 0), sum(rc.values())
        m = sum(min(c, rc[g]) for g, c in hc.items() if g in rc)
        ps += m / hn if hn > 0 else 0.0
        rs += m / rn if rn > 0 else 0.0
        eff += 1 if hn > 0 and rn > 0 else 0
    if eff == 0:
        return 0.0
    p, q = ps / eff, rs / eff
    f = beta ** 2
    return 100 * ((1 + f) * p * q / (f * p + q)) if p + q > 0 else 0.0


def test_identity_and_disjoint(spark):
    df = spark.createDataFrame([("same", "Ein Satz.", "Ein Satz."), ("disjoint", "aaaa", "bbbb"),
                                ("ws", "  \t", "abc"), ("short", "ab", "abc")], "k string, hyp string, ref string")
    got = {r.k: r.chrf for r in C.chrf_sentence(df, ["k"]).collect()}
    assert got["same"] == pytest.approx(100.0)
    assert got["disjoint"] == 0.0
    assert got["ws"] == 0.0
    assert got["short"] == pytest.approx(py_chrf("ab", "abc"))


def test_empty_or_missing_hypothesis_is_not_scored(spark):
    df = spark.createDataFrame([("a", "", "x"), ("b", None, "x"), ("c", "x", "x")], "k string, hyp string, ref string")
    assert [r.k for r in C.chrf_sentence(df, ["k"]).collect()] == ["c"]


def test_matches_python_on_conversation_pairs(spark):
    conv = spark.read.parquet(f"{SF}/conversations.parquet")
    u = conv.filter("role = 'user'").select("conv_id", F.col("text").alias("ref"))
    a = conv.filter("role = 'assistant'").select("conv_id", "turn", F.col("text").alias("hyp"))
    pairs = a.join(u.dropDuplicates(["conv_id"]), "conv_id").select("conv_id", "turn", "hyp", "ref")
    got = {(r.conv_id, r.turn): r.chrf for r in C.chrf_sentence(pairs, ["conv_id", "turn"]).collect()}
    rows = pairs.collect()
    assert len(got) == len(rows) > 100
    for r in rows:
        assert got[(r.conv_id, r.turn)] == pytest.approx(py_chrf(r.hyp, r.ref), abs=1e-9)


def test_long_document_pairs(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet").orderBy(F.desc("n_chars")).limit(3)
    pairs = d.select("doc_id", F.col("text").alias("ref"),
                     F.regexp_replace("text", "e", "a").alias("hyp"))
    got = {r.doc_id: r.chrf for r in C.chrf_sentence(pairs, ["doc_id"]).collect()}
    for r in pairs.collect():
        assert got[r.doc_id] == pytest.approx(py_chrf(r.hyp, r.ref), abs=1e-9)
