"""Cross-parsing against a plain longest-match parse, and accuracy on held-out documents."""

import random

import pytest
from pyspark.sql import functions as F

from slicekit.llm import langid as L

from .helpers import EDGE_ROWS, documents, prose, with_clashes


def _plain_phrases(text, train):
    n = at = 0
    while at < len(text):
        end = at + 1
        while end <= len(text) and text[at:end] in train:
            end += 1
        at, n = max(end - 1, at + 1), n + 1
    return n


def test_phrases_equal_the_plain_parse():
    rng = random.Random(1)
    train = {"x": L.symbols([prose(rng, 30)])[0].tobytes(), "y": L.symbols(["éà abc " * 20 + "zzz"])[0].tobytes(), "z": b"q"}
    parser = L.CrossParser(train)
    texts = [prose(rng, rng.randint(0, 40)) for _ in range(30)] + ["", "é" * 700, "abc abc éà", "ж中 unknown", "q", "q" * 513]
    s, per = L.symbols(texts)
    got, at = parser.phrases(s, per), 0
    for row, n in zip(got.tolist(), per.tolist()):
        own = s[at:at + n].tobytes()
        at += n
        assert row == [sum(_plain_phrases(own[k:k + L.SEGMENT], train[x]) for k in range(0, n, L.SEGMENT)) for x in parser.langs]


def test_automaton_accepts_exactly_the_substrings():
    text = b"abcbcabbcacab"
    move = L.suffix_automaton(text)
    subs = {text[i:j] for i in range(len(text)) for j in range(i, len(text) + 1)}
    rng = random.Random(2)
    for _ in range(2000):
        w = bytes(rng.choice(b"abc") for _ in range(rng.randint(0, 6)))
        s = 0
        for c in w:
            s = move[s].get(c) if s is not None else None
        assert (s is not None) == (w in subs)


def test_symbols_fold_blanks_per_text():
    s, per = L.symbols(["A, b!", "  ", "", "1é"])
    assert per.tolist() == [4, 1, 0, 3] and s.tobytes() == b"a\x00b\x00" + b"\x00" + b"\x00" + "é".encode()


def test_held_out_documents_are_recognised(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = L.identify_languages(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out")
    n, right = got.agg(F.count("*"), F.sum((F.col("lang_pred") == F.col("lang")).cast("int"))).first()
    assert n > 250 and right / n > 0.97
    assert got.filter("score < 0 or score > 1").count() == 0


def test_prediction_does_not_see_lang_or_id(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = docs.filter(F.crc32(F.col("doc_id").cast("string")) % 3 == 1).withColumns(
        {"lang": F.lit("xx"), "doc_id": F.col("doc_id") + 10 ** 6})
    a = {r.doc_id + 10 ** 6: (r.lang_pred, r.score) for r in L.identify_languages(docs).filter("held_out").collect()}
    b = {r.doc_id: (r.lang_pred, r.score) for r in L.identify_languages(held, training=docs.filter(
        F.crc32(F.col("doc_id").cast("string")) % 3 != 1)).collect()}
    assert a == b


def test_edge_rows(spark):
    got = {}
    for r in L.identify_languages(with_clashes(documents(spark, EDGE_ROWS))).collect():
        got.setdefault(r.doc_id, []).append((r.lang_pred, r.score, r.held_out))
    assert sum(map(len, got.values())) == len(EDGE_ROWS)
    import zlib
    for d in (1, 2, 3, 4):
        assert got[d] == [("und", 0.0, zlib.crc32(str(d).encode()) % 3 == 1)]
    assert got[9][0][0] == "en" and got[9][0][1] == 1.0
    assert {x[2] for x in got[None]} == {False}
    assert L.identify_languages(documents(spark, [])).count() == 0
    nothing = documents(spark, EDGE_ROWS).withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in L.identify_languages(nothing).collect()} == {"und"}


def test_ties_go_to_the_first_name():
    parser = L.CrossParser({"b": b"same", "a": b"same"})
    assert parser.predict(["same"]) == (["a"], [pytest.approx(0.5)])


@pytest.mark.parametrize("text, letter", [("½ ²", False), ("Ⅷ ٣", False), ("12 _ ́", False), ("a", True), ("字", True), ("ª", True), ("", False)])
def test_letters_are_those_of_the_letter_categories(text, letter):
    import unicodedata
    assert L.has_letter(text) is letter is any(unicodedata.category(c)[0] == "L" for c in text)
