"""Small document tables for the tests of this folder."""

from __future__ import annotations

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"

SYLLABLES = "ba ne li to ru ma si ko pe da fu ge hi jo ka lu mi no pa re".split()


def sentence(rng: random.Random, n: int) -> str:
    words = ["".join(rng.choices(SYLLABLES, k=rng.randint(1, 4))) for _ in range(n)]
    return " ".join(words).capitalize() + "."


def prose(rng: random.Random, sentences: int) -> str:
    return " ".join(sentence(rng, rng.randint(4, 12)) for _ in range(sentences))


def documents(spark, rows):
    """Rows of (doc_id, text) with the other columns of documents."""
    full = [(d, t, "en", "src0", None if t is None else len(t)) for d, t in rows]
    return spark.createDataFrame(full, DOCS).repartition(3)


#: nulls, empty and blank texts, no letters, repeated rows and ids, special strings, odd blanks, a long text
EDGE_ROWS = [
    (1, None), (2, ""), (3, "   \n\t "), (4, "12 34 -- !!"), (5, "One word."), (5, "One word."), (5, "Another text under the id."),
    (None, None), (None, "A text without an id."), (None, "A text without an id."), (6, "x<|endoftext|>y  <|endoftext|> z"),
    (7, "a b c\x1cd\x85e  f\n\n g"), (8, "it's we'll DON'T 3.14 café́ \U0001f600\U0001f600"), (9, "word " * 30000),
    (10, "x" * 5000), (-3, "Negative id."), (2 ** 62, "Large id.")]


def with_clashes(df):
    """The table with more columns, named like things that operators make."""
    from pyspark.sql import functions as F
    names = ["score", "fp", "key", "length", "h", "rank", "llr", "shard", "root", "rejected", "component_id", "piece", "node",
             "low_quality", "toxic", "item_id", "first", "last", "n_words", "k1", "action", "host", "path", "rule", "weights", "n"]
    return df.withColumns({n: F.lit(None).cast("string") if i % 2 else F.lit(i) for i, n in enumerate(names)})
