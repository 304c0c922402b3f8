"""Substring deduplication by sliding sentence spans.

Texts are cut into sentences without losing a character, long sentences into
pieces at places their words define, so a passage is cut alike wherever it stands.
From every sentence
the shortest run forwards, and to every sentence the shortest run backwards,
that has several sentences and enough words is hashed; equal runs meet in one
shuffle, and sentences covered by a run that occurred before -- in the order of
doc_id and place -- are removed.  Runs in both directions make every sentence
of a repeated passage lie in a run that lies in the passage.

A task keeps only the first of equal runs it meets as a candidate for the first
one of all; the others are known to be repeats and travel on their own, so a
passage that very many documents share does not pile up in one task.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship_package
from .common import byte_slices, texts_of

MIN_SENTENCES = 2
MIN_WORDS = 13
LONG_SENTENCE = 32  # words; longer sentences are cut into pieces of at most so many
_PIECE_WORDS = 8  # words of such a piece, on average

# scripts without blanks between words, and the tenths of a word that one of their characters counts for
_HAN = "\u3001-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uff01-\uff20\uff61-\uff9f\U00020000-\U0003ffff"
_THAI = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff"  # Thai, Lao, Burmese, Khmer
_WORD, _HAN_CHAR, _THAI_CHAR = 10, 5, 2
_NO_BLANKS = re.compile("[%s%s]" % (_HAN, _THAI))
_UNIT = re.compile(r"(?:([%s])|([%s])|[^\s%s%s]+)\s*" % (_HAN, _THAI, _HAN, _THAI))
_TENTHS = {None: _WORD, 1: _HAN_CHAR, 2: _THAI_CHAR}  # by the group that matched

# a sentence ends behind .!? and blanks, behind a full-width stop, at a line end, and before a capitalised word
# that follows a small letter
_CAPITAL = "A-ZÀ-ÖØ-Þ"
_STOP = "。！？｡"
_END = re.compile(r"[\s%s](?:(?<=[%s])[%s」』）”’]*\s*|(?<=[.!?].)\s*|(?<=\n)\s*|[ \t]*\n\s*|(?<=[^\W\d_].)(?=[%s][^\W%s\d_]))"
                  % (_STOP, _STOP, _STOP, _CAPITAL, _CAPITAL), re.S)


def tenths(sentence: str) -> int:
    """Ten times the words of ``sentence``, where characters of scripts without blanks are shares of a word."""
    if sentence.isascii() or not _NO_BLANKS.search(sentence):
        return _WORD * len(sentence.split())
    return sum(_TENTHS[m.lastindex] for m in _UNIT.finditer(sentence))


def _pieces(sentence: str) -> list[str]:
    """A long sentence cut at places that its words alone define, wherever it begins:
    behind words whose hash with the word before falls in one of ``_PIECE_WORDS``
    classes, and, where none does in ``LONG_SENTENCE`` words, behind the least hash of
    the latter half of them (the last of equal ones)."""
    out, start = [], 0
    ends, weights, hashes = [], [], []
    names: list[str] = []
    first = held = 0  # first unit of the piece, and tenths of words since
    for i, m in enumerate(_UNIT.finditer(sentence)):
        w = _TENTHS[m.lastindex]
        names.append(m[0].rstrip().lower())
        context = 2 * _WORD // w  # units that make up two words
        h = xxhash.xxh32_intdigest(" ".join(names[-context:]))
        ends.append(m.end())
        weights.append(w)
        hashes.append(h)
        held += w
        cut = -1
        if i + 1 >= context and h % (_PIECE_WORDS * _WORD // w) == 0:
            cut = i
        elif held >= LONG_SENTENCE * _WORD:
            least, after = 1 << 32, held
            for j in range(i, first - 1, -1):
                if after <= LONG_SENTENCE * _WORD // 2:
                    break
                if hashes[j] < least:
                    least, cut = hashes[j], j
                after -= weights[j]
        if cut >= 0:
            out.append(sentence[start:ends[cut]])
            start, first = ends[cut], cut + 1
            held = sum(weights[first:])
    if start < len(sentence):
        out.append(sentence[start:])
    return out


def sentences(text: str) -> list[str]:
    """Consecutive pieces of ``text``; joined they are the text."""
    out, at = [], 0
    for m in _END.finditer(text):
        if m.end() > at:
            out.append(text[at:m.end()])
            at = m.end()
    if at < len(text):
        out.append(text[at:])
    wide = not text.isascii() and _NO_BLANKS.search(text)
    cut = []
    for s in out:
        if len(s) > 2 * LONG_SENTENCE and (tenths(s) > LONG_SENTENCE * _WORD if wide else len(s.split()) > LONG_SENTENCE):
            cut += _pieces(s)
        else:
            cut.append(s)
    return cut


def runs(words: np.ndarray, min_sentences: int = MIN_SENTENCES, min_words: int = MIN_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """First and last sentence of each run, given the words of every sentence."""
    n = len(words)
    total = np.concatenate([[0], np.cumsum(words)])
    i = np.arange(n)
    last = np.maximum(np.searchsorted(total, total[i] + min_words) - 1, i + min_sentences - 1)
    first = np.minimum(np.searchsorted(total, total[1:] - min_words, "right") - 1, i - min_sentences + 1)
    forward, backward = last < n, first >= 0
    both = np.concatenate([i[forward] * n + last[forward], first[backward] * n + i[backward]])
    both = np.unique(both) if n else both
    return both // max(n, 1), both % max(n, 1)


# run hashes: sums of sentence hashes times powers of an odd number, brought to power 0 by its inverse mod 2**64
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_POWERS: list[tuple[np.ndarray, np.ndarray]] = []


def _powers(n: int) -> list[tuple[np.ndarray, np.ndarray]]:
    if not _POWERS or len(_POWERS[0][0]) < n:
        size = 1 << max(12, n.bit_length())
        _POWERS[:] = [tuple(np.cumprod(np.concatenate([[np.uint64(1)], np.full(size, b, np.uint64)]), dtype=np.uint64)
                            for b in (base, pow(base, -1, 1 << 64))) for base in _BASES]
    return _POWERS


def run_hashes(sentence_hash: np.ndarray, first: np.ndarray, last: np.ndarray) -> list[np.ndarray]:
    """Two 64-bit hashes for each run."""
    out = []
    for power, inverse in _powers(len(sentence_hash) + 1):
        total = np.concatenate([[np.uint64(0)], np.cumsum(sentence_hash * power[:len(sentence_hash)], dtype=np.uint64)])
        out.append((total[last + 1] - total[first]) * inverse[first] + (last - first).astype(np.uint64))
    return out


_ROWS = "h long, g long, sure boolean, doc_id long, k1 long, first int, last int"


def _spread(min_sentences: int, min_words: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in byte_slices(whole, "text"):
                cols: list[list[np.ndarray]] = [[], [], [], [], []]
                for row, text in enumerate(texts_of(batch)):
                    parts = sentences(text or "")
                    norm = [s.lower().split() for s in parts]
                    first, last = runs(np.fromiter(map(tenths, parts), np.int64, len(parts)), min_sentences, _WORD * min_words)
                    if not len(first):
                        continue
                    each = np.fromiter((xxhash.xxh64_intdigest(" ".join(s)) for s in norm), np.uint64, len(norm))
                    h, g = run_hashes(each, first, last)
                    for c, v in zip(cols, (h, g, np.full(len(h), row), first, last)):
                        c.append(v)
                if not cols[0]:
                    continue
                h, g, row, first, last = (np.concatenate(c) for c in cols)
                doc = _ids(batch.column(0))
                k1 = batch.column(2).to_numpy(zero_copy_only=False)
                order = np.lexsort((first, k1[row], doc[row], g, h))
                h, g, row, first, last = (x[order] for x in (h, g, row, first, last))
                start, repeat = _first_of_group((h, g), (doc[row], k1[row], first))
                keep = start | repeat  # equal rows under one id are one document
                h, g, row, first, last, sure = (x[keep] for x in (h, g, row, first, last, repeat))
                # what is known to be a repeat is dealt by its own place
                h = np.where(sure, h * np.uint64(_BASES[1]) + row.astype(np.uint64) * np.uint64(_BASES[0]) + first.astype(np.uint64), h)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h.view(np.int64)), pa.array(g.view(np.int64)), pa.array(sure), batch.column(0).take(pa.array(row)),
                     pa.array(k1[row]), pa.array(first, pa.int32()), pa.array(last, pa.int32())],
                    names=["h", "g", "sure", "doc_id", "k1", "first", "last"])

    return scan


def _first_of_group(key: tuple[np.ndarray, ...], place: tuple[np.ndarray, ...], before: tuple | None = None):
    """For rows sorted by key and place: whether each is the first of its key, and
    whether its place differs from that of the first.  ``before`` holds the key
    and first place that the rows before these ended with."""
    new = np.zeros(len(key[0]), bool)
    for k in key:
        new[1:] |= k[1:] != k[:-1]
    new[:1] = before is None or before[0] != tuple(k[0] for k in key)
    at = np.cumsum(new) - 1
    starts = np.flatnonzero(new)
    other = np.zeros(len(new), bool)
    for k, p in enumerate(place):
        own = p[starts] if before is None else np.concatenate([p[starts], [before[1][k]]])  # -1: the group before
        other |= p != own[at]
    return new, other


def _repeats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by run, document and place: those that are not at the first
    place of their run.  Nothing but that place is kept between batches."""
    before = None
    for batch in batches:
        if not batch.num_rows:
            continue
        h, g, sure = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        place = (_ids(batch.column(3)), *(batch.column(i).to_numpy(zero_copy_only=False) for i in (4, 5)))
        new, repeat = _first_of_group((h, g, sure), place, before)
        if new.any():
            s = int(np.flatnonzero(new)[-1])
            before = ((h[s], g[s], sure[s]), tuple(p[s] for p in place))
        out = batch.filter(pa.array(repeat | sure))
        yield pa.RecordBatch.from_arrays([out.column(i) for i in (3, 4, 5, 6)], names=["doc_id", "k1", "first", "last"])


def _ids(column: pa.Array) -> np.ndarray:
    """Ids with null as the smallest number, where Spark sorts it too."""
    return pc.fill_null(column, -1 << 63).to_numpy(zero_copy_only=False)


def repeated_spans(docs: DataFrame, min_sentences: int = MIN_SENTENCES, min_words: int = MIN_WORDS) -> DataFrame:
    """``doc_id, k1, first, last``: the runs of sentences of ``docs(doc_id, text)`` that occurred before."""
    ship_package(docs.sparkSession)
    return (docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("k1"))
            .mapInArrow(_spread(min_sentences, min_words), _ROWS)
            .repartition("h").sortWithinPartitions("h", "g", "sure", "doc_id", "k1", "first")
            .mapInArrow(_repeats, "doc_id long, k1 long, first int, last int"))


def _without(text: str, spans: list[dict]) -> tuple[str, int]:
    """The text without the covered sentences, and how many those were."""
    parts = sentences(text)
    gone = np.zeros(len(parts) + 1, np.int64)
    for s in spans:
        gone[s["first"]] += 1
        gone[s["last"] + 1] -= 1
    covered = np.cumsum(gone)[:-1] > 0
    return "".join(p for p, c in zip(parts, covered, strict=True) if not c), int(covered.sum())


def remove_repeated_spans(docs: DataFrame, min_sentences: int = MIN_SENTENCES, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with ``text`` freed of repeated spans and one column more, ``__n_removed``
    (sentences).

    Every row stays, with all its columns; a text that only repeats others is
    empty afterwards, a null text stays null.  Of equal spans the one of the
    smallest (doc_id, place) stays, null ids first; rows of one id are ordered by
    their row key, and rows equal in id and text are one document and treated
    alike.  A span that repeats inside its own text is a repeat as well.  Texts
    of fewer sentences or words than a run needs are left alone.  Words are what blanks
    part; in scripts without blanks characters count as shares of a word."""
    by_row = (repeated_spans(docs, min_sentences, min_words).groupBy("doc_id", "k1")
              .agg(F.collect_list(F.struct("first", "last")).alias("__spans"))  # at most two a sentence
              .select(F.col("doc_id").alias("__id"), F.col("k1").alias("__k1"), "__spans"))
    keyed = docs.withColumn("__k", F.xxhash64("doc_id", "text"))
    joined = keyed.join(by_row, (keyed["__k"] == by_row["__k1"]) & keyed["doc_id"].eqNullSafe(by_row["__id"]), "left") \
        .drop("__k", "__k1", "__id")
    columns = [c for c in joined.columns if c != "__spans"]
    text_at, spans_at = columns.index("text"), joined.columns.index("__spans")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in byte_slices(whole, "text"):
                texts, removed = [], []
                for text, spans in zip(texts_of(batch), batch.column(spans_at).to_pylist(), strict=True):
                    new, n = _without(text, spans) if spans else (text, 0)
                    texts.append(new)
                    removed.append(n)
                held = [batch.column(i) for i in range(len(columns))]
                held[text_at] = pa.array(texts, pa.string())
                yield pa.RecordBatch.from_arrays([*held, pa.array(removed, pa.int32())], names=[*columns, "__n_removed"])

    from pyspark.sql.types import IntegerType, StructType
    schema = StructType([joined.schema[c] for c in columns]).add("__n_removed", IntegerType())
    return joined.mapInArrow(cut, schema)


def span_dedup(docs: DataFrame, min_sentences: int = MIN_SENTENCES, min_words: int = MIN_WORDS) -> DataFrame:
    """``doc_id, n_removed, text`` of every row, see ``remove_repeated_spans``."""
    return (remove_repeated_spans(docs.select("doc_id", "text"), min_sentences, min_words)
            .select("doc_id", F.col("__n_removed").alias("n_removed"), "text"))


def dedup_texts(docs: DataFrame) -> DataFrame:
    """``docs`` with the same columns, texts freed of repeated spans; ``n_chars``, if
    it is there, follows the texts that changed."""
    out = remove_repeated_spans(docs)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.col("__n_removed") > 0, F.char_length("text").cast(kind)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)
