"""Sentence spans against a plain version that keeps every run in a dictionary."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from slicekit.llm import spans as S

from .helpers import EDGE_ROWS, documents, prose, sentence, with_clashes


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("aB.!? \n\t1É")), max_size=120) | st.text(max_size=60))
def test_sentences_join_to_the_text(text):
    parts = S.sentences(text)
    assert "".join(parts) == text and all(parts)


def test_sentence_ends():
    assert S.sentences("One two. Three!  Four\nfive Six 3.14 x") == ["One two. ", "Three!  ", "Four\n", "five ", "Six 3.14 x"]
    assert [len(p.split()) for p in S.sentences("word " * 100)] == [32, 32, 32, 4]


def _plain(rows, min_sentences, min_words):
    """Text after removal, by row number."""
    docs = {}
    for d, t in rows:
        docs[(d is not None, d or 0, _key(d, t), t)] = (d, t)
    seen, covered = {}, {}
    for place in sorted(docs, key=lambda p: p[:3]):
        parts = [" ".join(s.lower().split()) for s in S.sentences(docs[place][1] or "")]
        words = [len(p.split()) for p in parts]
        runs = set()
        for i in range(len(parts)):
            for j in range(i, len(parts)):
                if j - i + 1 >= min_sentences and sum(words[i:j + 1]) >= min_words:
                    runs.add((i, j))
                    break
            for j in range(i, -1, -1):
                if i - j + 1 >= min_sentences and sum(words[j:i + 1]) >= min_words:
                    runs.add((j, i))
                    break
        for i, j in sorted(runs):
            run = tuple(parts[i:j + 1])
            if run in seen and seen[run] != (place, i):
                covered.setdefault(place, set()).update(range(i, j + 1))
            seen.setdefault(run, (place, i))
    out = []
    for d, t in rows:
        gone = covered.get((d is not None, d or 0, _key(d, t), t), set())
        out.append((str(d), None if t is None else "".join(p for k, p in enumerate(S.sentences(t)) if k not in gone), len(gone)))
    return sorted(out, key=str)


_KEYS = {}


def _key(d, t):
    return _KEYS[d, t]


def _check(spark, rows, **how):
    from pyspark.sql import functions as F
    docs = documents(spark, rows)
    _KEYS.update({(r.doc_id, r.text): r.k for r in docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("k")).collect()})
    got = sorted(((str(r.doc_id), r.text, r.n_removed) for r in S.span_dedup(with_clashes(docs), **how).collect()), key=str)
    assert got == _plain(rows, how.get("min_sentences", S.MIN_SENTENCES), how.get("min_words", S.MIN_WORDS))
    return got


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_removal_equals_the_plain_version(spark, seed):
    rng = random.Random(seed)
    shared = [prose(rng, rng.randint(3, 8)) for _ in range(6)]
    short = [sentence(rng, 3) for _ in range(4)]
    rows = []
    for i in range(60):
        parts = [prose(rng, rng.randint(0, 5)) for _ in range(3)]
        parts.insert(rng.randrange(3), rng.choice(shared))
        parts.insert(rng.randrange(3), rng.choice(short))
        rows.append((rng.randrange(40), rng.choice([" ", "\n"]).join(parts)))
    _check(spark, rows)
    _check(spark, rows, min_sentences=3, min_words=5)


def test_edge_rows(spark):
    _check(spark, EDGE_ROWS)
    assert S.span_dedup(documents(spark, [])).count() == 0


def test_small_batches(spark):
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        rng = random.Random(9)
        shared = prose(rng, 6)
        _check(spark, [(i, prose(rng, 2) + " " + shared) for i in range(20)] + [(3, shared), (3, shared)])
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)


def test_a_long_passage_leaves_all_but_the_first(spark):
    rng = random.Random(5)
    passage = prose(rng, 9)
    rows = [(i, f"{prose(rng, 4)} {sentence(rng, 5)[:-1].lower()} {passage} {prose(rng, 3)}") for i in range(8)]
    clean = [(100 + i, prose(rng, 12)) for i in range(8)]
    got = {int(r.doc_id): r.text for r in S.span_dedup(documents(spark, rows + clean)).collect()}
    assert passage in got[0]
    middle = " ".join(passage.split(". ")[1:-1])
    assert all(middle not in got[i].replace(". ", " ") and passage not in got[i] for i in range(1, 8))
    assert all(got[d] == t for d, t in clean)


def test_stage_keeps_columns_and_counts_characters(spark):
    rng = random.Random(6)
    passage = prose(rng, 9)
    docs = with_clashes(documents(spark, [(1, passage), (2, "Before it. " + passage), (3, None)]))
    out = S.dedup_texts(docs)
    assert out.columns == docs.columns
    rows = {r.doc_id: r for r in out.collect()}
    assert rows[1].text == passage and rows[3].text is None
    assert rows[2].n_chars == len(rows[2].text) < len(passage)


def _left(spark, passage, before, joint=" "):
    """Share of a passage that stays in the second of two texts that hold it behind ``before``."""
    rows = [(i, joint.join([b, passage])) for i, b in enumerate(before)]
    got = {int(r.doc_id): r.text for r in S.span_dedup(documents(spark, rows)).collect()}
    assert got[0] == rows[0][1] and got[1].startswith(before[1])
    return (len(got[1]) - len(before[1])) / len(passage)


def _unpunctuated(rng, n):
    return " ".join(sentence(rng, n)[:-1].lower().split())


@pytest.mark.parametrize("seed", [1, 2, 3, 4])
def test_an_unpunctuated_passage_is_found_at_any_offset(spark, seed):
    rng = random.Random(seed)
    passage = _unpunctuated(rng, 200)
    assert _left(spark, passage, [_unpunctuated(rng, 37), _unpunctuated(rng, 5 + seed)]) < 0.25


def test_few_words_over_and_over_are_cut_alike():
    rng = random.Random(8)
    for period in (2, 4, 8):
        passage = " ".join([_unpunctuated(rng, period)] * (240 // period))
        one, two = ([p.strip() for p in S.sentences(_unpunctuated(rng, n) + " " + passage)] for n in (40, 35))
        assert sum(len(p.split()) for p in two if p in one) > 160


def test_short_texts_are_cut_like_long_ones():
    words = "a b c d e f g h i j k l m n o p q r s t u v w x y z " * 2
    assert len(words) < 192 and len(S.sentences(words)) > 1
    assert max(len(p.split()) for p in S.sentences(words)) <= S.LONG_SENTENCE


def test_full_width_stops_and_scripts_without_blanks(spark):
    assert S.sentences("今天下雨。「是吗？」 我们走！x") == ["今天下雨。", "「是吗？」 ", "我们走！", "x"]
    assert [S.tenths(t) for t in ("one two", "今天 one", "ไทย")] == [20, 20, 6]
    rng = random.Random(7)
    han = lambda n: "".join(chr(rng.randint(0x4E00, 0x9FFF)) for _ in range(n))
    thai = lambda n: "".join(chr(rng.randint(0x0E01, 0x0E2E)) for _ in range(n))
    assert _left(spark, "".join(han(12) + "。" for _ in range(9)), ["", ""], "") == 0
    assert _left(spark, han(400), [han(71), han(6)], "") < 0.25
    assert _left(spark, thai(1200), [thai(150), thai(31)], "") < 0.25
