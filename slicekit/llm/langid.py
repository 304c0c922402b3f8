"""Language identification by cross-parsing entropy.

A suffix automaton of labelled text per language is walked along a text: at
each break the longest match with the training text ends and the next phrase
begins.  The language that needs the fewest phrases, each weighted by the
bits of a pointer into its training text, wins.

Training text is a bounded, documented sample; the automata are built from it in
each worker and laid out as one table, so that many texts take a step at once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship_package
from .common import byte_slices, texts_of, worker_state

#: Per language: labelled rows drawn by hash, characters taken of each at a place drawn by hash, symbols trained on.
SAMPLE_ROWS = 96
SAMPLE_CHARS = 400
TRAIN_SYMBOLS = 24_000
#: Texts are parsed in segments of so many symbols; a segment begins a new phrase.
SEGMENT = 256
UNKNOWN = "und"

# letters and bytes beyond ASCII are symbols of their own, all else is one blank
_SYMBOL = np.array([b if 0x61 <= b <= 0x7A or b >= 0x80 else 0 for b in range(256)], np.uint8)


def has_letter(text: str) -> bool:
    """Whether a character is of a letter category (L*); digits of any kind, as in "½ ²", are not."""
    return any(map(str.isalpha, text))


def symbols(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The symbols of all texts one after the other, runs of blanks as one, and symbols per text."""
    raw = [t.lower().encode() for t in texts]
    size = np.fromiter(map(len, raw), np.int64, len(raw))
    s = _SYMBOL[np.frombuffer(b"".join(raw), np.uint8)]
    first = np.zeros(len(s), bool)
    ends = np.cumsum(size)
    first[(ends - size)[size > 0]] = True
    keep = np.ones(len(s), bool)
    keep[1:] = (s[1:] != 0) | (s[:-1] != 0) | first[1:]
    kept = np.concatenate([[0], np.cumsum(keep)])
    return s[keep], kept[ends] - kept[ends - size]


def suffix_automaton(text: bytes) -> list[dict[int, int]]:
    """Transitions of the suffix automaton of ``text``; state 0 is the start."""
    move: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in text:
        cur = len(move)
        move.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in move[p]:
            move[p][c] = cur
            p = link[p]
        if p >= 0:
            q = move[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                clone = len(move)
                move.append(dict(move[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and move[p].get(c) == q:
                    move[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    return move


class CrossParser:
    """Phrase counts of texts against the training text of each language."""

    def __init__(self, training: dict[str, bytes]):
        self.langs = sorted(training)
        self.bits = np.array([math.log2(len(training[x]) + 1) for x in self.langs])
        used = sorted(set(b"".join(training.values())))
        self.code = np.full(256, len(used), np.int32)  # the last code: symbols no language has
        self.code[used] = np.arange(len(used))
        width = len(used) + 1
        tables, self.root, base = [], [], 0
        for lang in self.langs:
            move = suffix_automaton(training[lang])
            nxt = np.full((len(move), width), -1, np.int64)
            for s, to in enumerate(move):
                for c, q in to.items():
                    nxt[s, self.code[c]] = q
            begin = np.where(nxt[0] >= 0, nxt[0], 0)  # a phrase of one symbol where even the start fails
            fails = nxt < 0
            fails[0] = True
            nxt = np.where(nxt < 0, begin, nxt)
            # where the walk goes on in the flat table, and in the last bit whether a phrase begins
            tables.append((((nxt * width + base) << 1) | fails).ravel())
            self.root.append(base)
            base += nxt.size
        self.table = np.concatenate(tables or [np.zeros(0, np.int64)]).astype(np.int32 if base < 1 << 30 else np.int64)

    def phrases(self, s: np.ndarray, per: np.ndarray) -> np.ndarray:
        """Phrases of each text (rows) for each language (columns)."""
        n_seg = -(-per // SEGMENT)
        text = np.repeat(np.arange(len(per)), n_seg)
        begin = np.cumsum(per) - per
        k = np.arange(len(text)) - np.repeat(np.cumsum(n_seg) - n_seg, n_seg)
        start = begin[text] + k * SEGMENT
        size = np.minimum(per[text] - k * SEGMENT, SEGMENT)
        order = np.argsort(-size, kind="stable")
        text, start, size = text[order], start[order], size[order]
        out = np.zeros((len(per), len(self.langs)), np.int64)
        codes = self.code[s]
        for at in range(0, len(text), 4096):  # the longest segments first, so those still going are a prefix
            st, sz = start[at:at + 4096], size[at:at + 4096]
            live = np.searchsorted(-sz, -np.arange(1, int(sz[0]) + 1), "right")
            place = np.repeat(np.array(self.root, self.table.dtype)[:, None], len(st), axis=1)
            count = np.zeros(place.shape, np.int32)
            for t, n in enumerate(live.tolist()):
                v = self.table[place[:, :n] + codes[st[:n] + t]]
                count[:, :n] += v & 1
                place[:, :n] = v >> 1
            for x in range(len(self.langs)):
                out[:, x] += np.bincount(text[at:at + 4096], count[x], len(per)).astype(np.int64)
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """The language of each text and its share of the inverse code lengths."""
        known = [bool(t) and has_letter(t) for t in texts]
        if not self.langs:
            return [UNKNOWN] * len(texts), [0.0] * len(texts)
        s, per = symbols([t if k else "" for t, k in zip(texts, known)])
        cost = self.phrases(s, per) * self.bits
        inverse = 1 / np.maximum(cost, 1e-9)
        best = np.argmin(cost, axis=1)  # ties: the first name
        share = inverse[np.arange(len(best)), best] / inverse.sum(axis=1)
        return ([self.langs[b] if k else UNKNOWN for b, k in zip(best, known)],
                [float(x) if k else 0.0 for x, k in zip(share, known)])


def training_text(docs: DataFrame, sample_rows: int = SAMPLE_ROWS, sample_chars: int = SAMPLE_CHARS,
                  train_symbols: int = TRAIN_SYMBOLS) -> dict[str, bytes]:
    """At most ``train_symbols`` symbols for each language of ``docs(doc_id, text, lang)``,
    from excerpts of rows drawn by hash.  Languages without a letter in their excerpts are left out."""
    size = F.greatest(F.char_length("text") - sample_chars, F.lit(0)) + 1
    drawn = (docs.filter("lang is not null and text is not null")
             .select("lang", F.xxhash64("doc_id", "text").alias("__h"), "text",
                     (F.lit(1) + F.pmod(F.xxhash64("text", "doc_id"), size)).cast("int").alias("__at"))
             .select("lang", "__h", F.substring(F.col("text"), F.col("__at"), F.lit(sample_chars)).alias("excerpt")))
    few = drawn.withColumn("__n", F.row_number().over(Window.partitionBy("lang").orderBy("__h", "excerpt"))) \
        .filter(F.col("__n") <= sample_rows)
    texts: dict[str, list[str]] = {}
    for r in few.orderBy("lang", "__n").collect():  # sample_rows excerpts a language
        if has_letter(r["excerpt"]):
            texts.setdefault(r["lang"], []).append(r["excerpt"])
    return {lang: symbols([" ".join(x)])[0].tobytes()[:train_symbols] for lang, x in texts.items()}


def identify_languages(docs: DataFrame, training: DataFrame | None = None, **sample) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` for every row of ``docs(doc_id, text, lang)``.

    Trained on the rows whose ``crc32(doc_id as text) mod 3`` is not 1 (``held_out``
    is the others; a null id is not held out), unless other ``training`` rows are
    given.  ``lang_pred`` is ``und`` with score 0 for null texts, texts without a
    letter, and all texts when there is nothing to train on.  Ties go to the
    first language by name.  Repeated rows are predicted each; an empty table
    gives no rows; other columns are not read."""
    ship_package(docs.sparkSession)
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    texts = training_text(training if training is not None else docs.filter(~held_out), **sample)
    model = docs.sparkSession.sparkContext.broadcast(texts)  # TRAIN_SYMBOLS bytes a language

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = hash(tuple(sorted(model.value.items())))
        parser = worker_state("cross parser", key, lambda: CrossParser(model.value))
        for whole in batches:
            for batch in byte_slices(whole, "text"):
                lang, score = parser.predict(texts_of(batch))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(2), pa.array(lang, pa.string()), pa.array(score, pa.float64())],
                    names=["doc_id", "held_out", "lang_pred", "score"])

    return (docs.select("doc_id", "text", held_out.alias("held_out"))
            .mapInArrow(predict, "doc_id long, held_out boolean, lang_pred string, score double"))
