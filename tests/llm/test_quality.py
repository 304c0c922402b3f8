"""Weak labels: EM on simulated labellers, the scorer, and planted documents."""

import random

import numpy as np
import pytest

from slicekit.llm import quality as Q

from .helpers import EDGE_ROWS, documents, prose, with_clashes

LABELS = "doc_id long, quality int, toxic int"


def test_em_recovers_the_labellers():
    rng = np.random.default_rng(1)
    bad = rng.random(20_000) < 0.2
    right = np.array([0.9, 0.7, 0.8, 0.99])  # the last is the annotator
    votes = np.where(rng.random((len(bad), 4)) < right, ~bad[:, None], bad[:, None]).astype(int)  # 0 bad, 1 good
    votes[rng.random(votes.shape) < 0.3] = 2
    patterns = {}
    for v in map(tuple, votes.tolist()):
        patterns[v] = patterns.get(v, 0) + 1
    prior, table = Q.estimate(patterns)
    assert prior == pytest.approx(0.2, abs=0.02)
    for k in range(3):
        assert table[k, 0, 0] == pytest.approx(0.7 * right[k], abs=0.03)
        assert table[k, 1, 1] == pytest.approx(0.7 * right[k], abs=0.03)
        assert table[k].sum(axis=1) == pytest.approx([1, 1])
    p = Q.posterior(votes, prior, table)
    assert ((p > 0.5) == bad).mean() > 0.93
    assert ((p > 0.5) == bad).mean() > ((votes[:, 0] == 0) == bad).mean()


def test_cutoff_splits_held_out_rows():
    margin = np.array([-3.0, -2.5, -2.4, 0.5, 0.9])
    assert Q.cutoff(margin, np.array([False, False, False, True, True])) == pytest.approx(-0.95)
    assert Q.cutoff(margin, np.zeros(5, bool)) == 0


def test_the_cached_scorer_equals_the_plain_sum():
    rng = random.Random(3)
    weights = {f: rng.uniform(-1, 1) for f in range(0, Q.DIMENSIONS, 7)}
    axes = [(weights, np.array([1.0, 2, 3, 4, 5]), 0.3), ({}, np.zeros(5), -1.0)]
    scorer = Q.Scorer(axes)
    for text in [prose(rng, 5), None, "", "É é " * 50, prose(rng, 40)]:
        f, v, s = Q.document_features(text)
        margin = sum(weights.get(int(a), 0) * float(b) for a, b in zip(f, v)) + float(np.dot(s, axes[0][1])) + 0.3
        got = scorer.score(text)
        assert got[0] == pytest.approx(1 / (1 + np.exp(-margin)), rel=1e-4)
        assert got[1] == pytest.approx(1 / (1 + np.e))


def _corpus(rng):
    rows, labels, kind = [], [], {}
    for i in range(600):
        text, k = prose(rng, rng.randint(4, 20)), "good"
        if i % 8 == 0:
            text, k = " ".join(w + "%%%" for w in text.split()), "low"
        elif i % 8 == 1:
            words = text.split()
            for _ in range(3):
                words.insert(rng.randrange(len(words)), "zor" + rng.choice(["bat", "gul", "nim"]) + rng.choice("aeiou"))
            text, k = " ".join(words), "toxic"
        elif i % 16 == 2:
            text, k = text + " You idiot.", "toxic"
        rows.append((i, text))
        kind[i] = k
        if i % 3:
            labels.append((i, int(k != "low"), int(k == "toxic")))
    return rows, labels, kind


def test_planted_documents_are_rejected_and_clean_ones_kept(spark):
    rows, labels, kind = _corpus(random.Random(4))
    got = Q.classify(with_clashes(documents(spark, rows)), spark.createDataFrame(labels, LABELS)).collect()
    assert len(got) == len(rows)
    unseen = [r for r in got if r.doc_id % 3 == 0]
    clean = [r for r in unseen if kind[r.doc_id] == "good"]
    bad = [r for r in unseen if kind[r.doc_id] != "good"]
    assert sum(r.rejected for r in clean) <= 0.01 * len(clean)
    assert sum(r.rejected for r in bad) >= 0.95 * len(bad)


def test_without_labels_heuristics_teach(spark):
    rows, _, kind = _corpus(random.Random(5))
    got = Q.classify(documents(spark, rows)).collect()
    low = [r for r in got if kind[r.doc_id] == "low"]
    good = [r for r in got if kind[r.doc_id] == "good"]
    assert sum(r.low_quality > 0.5 for r in low) >= 0.95 * len(low)
    assert sum(r.rejected for r in good) <= 0.02 * len(good)


def test_edge_rows(spark):
    labels = [(1, None, None), (2, 0, None), (5, 1, 0), (5, 0, 1), (None, 0, 1), (7, 1, 0), (99, 1, 1)]
    docs = with_clashes(documents(spark, EDGE_ROWS))
    got = Q.classify(docs, with_clashes(spark.createDataFrame(labels, LABELS)).select("doc_id", "quality", "toxic", "score")).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(d) for d, _ in EDGE_ROWS)
    assert all(0 <= r.low_quality <= 1 and 0 <= r.toxic <= 1 for r in got)
    assert Q.classify(documents(spark, []), spark.createDataFrame([], LABELS)).count() == 0
    assert Q.classify(documents(spark, EDGE_ROWS), spark.createDataFrame([], LABELS)).count() == len(EDGE_ROWS)
    kept = Q.drop_rejected(docs, spark.createDataFrame(labels, LABELS))
    assert kept.columns == docs.columns and kept.count() <= len(EDGE_ROWS)


def test_held_out_labels_of_the_tables(spark):
    from pyspark.sql import functions as F
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    seen = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    got = Q.classify(docs, labels.filter(seen)).join(labels.filter(~seen).withColumnRenamed("toxic", "is_toxic"), "doc_id")
    bad = (F.col("quality") == 0) | (F.col("is_toxic") == 1)
    n, n_bad, hit, false = got.agg(F.count("*"), F.sum(bad.cast("int")), F.sum((bad & F.col("rejected")).cast("int")),
                                   F.sum((~bad & F.col("rejected")).cast("int"))).first()
    assert hit / n_bad > 0.95
    assert false / (n - n_bad) < 0.01


def test_repeated_rows_take_one_place_of_the_sample(spark, monkeypatch):
    rng = random.Random(6)
    rows = [(i, prose(rng, 3)) for i in range(30)]
    got = []
    monkeypatch.setattr(Q, "_fit", lambda sample, train_rows: got.append(sample.count()))
    Q.fit_scorer(documents(spark, rows + [(None, "")] * 40 + rows[:5]))
    Q.fit_scorer(documents(spark, rows * 3), train_rows=20)
    assert got == [31, 20]
