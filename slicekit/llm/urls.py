"""URL filters: rules on hosts and paths, and for the rest a ratio of character
language models.

Two variable-order Markov models -- of the urls that rules accept, and of those
they reject -- give each character a probability that blends all orders up to
``ORDER``, by how often a context was seen and how many characters followed it
(Witten-Bell smoothing).  The mean difference of log-likelihoods per character
decides, against a cut calibrated on labelled urls left out of the counts.

A character and the ``ORDER`` bytes before it, its window, hold its grams and contexts
of all orders, so a window has one number, and a url's ratio is the mean of its
windows' numbers.  Grams are counted from all labelled urls, each for itself and
exactly.  While their measured number is at most ``SLOTS``, the counts are
broadcast; beyond, the numbers of the distinct windows come from joins with the
counts, order by order, and go to chunks of urls, with the same results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructType

from ..session import materialize, ship_package
from .common import byte_slices, texts_of

ORDER = 5
SLOTS = 1 << 19  # counted grams that a broadcast model holds; more are joined
CALIBRATION_FOLDS = 5  # one of so many labelled urls calibrates the cut
_BIN = 0.01  # log-likelihood difference per character that a bin of the calibration spans

# Action, host, path.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null and urls without ``://``."""
    rest = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1), F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def matched_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """Rule string and action of the longest rule that fits, or nulls."""
    rule, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for act, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):  # the longest is asked first
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, action = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(act)).otherwise(action)
    return rule, action


# -- grams: a window's last k + 1 bytes are its gram of order k, those without the last one the context

_TAG = 8 * (ORDER + 1)  # a key holds the order above the bytes
_CHUNK_BYTES = 1 << 19  # of urls, scored at once


def windows(urls: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Every character (an end mark included) with the ``ORDER`` bytes before it, as a
    number; and characters per url."""
    raw = [b"\x00" * ORDER + (u or "").lower().encode() + b"\x01" for u in urls]
    flat = np.frombuffer(b"".join(raw), np.uint8)
    size = np.fromiter(map(len, raw), np.int64, len(raw))
    first = np.repeat(np.cumsum(size) - size, size)
    at = np.flatnonzero(np.arange(len(flat)) - first >= ORDER)
    out = np.zeros(len(at), np.int64)
    for k in range(ORDER, -1, -1):
        out = out << 8 | flat[at - k]
    return out, size - ORDER


def _mask(k: int) -> int:
    return (1 << 8 * (k + 1)) - 1


def _mean(each: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Means of consecutive runs of ``size`` values, at least one each."""
    return np.add.reduceat(each, np.cumsum(size) - size) / size if len(size) else np.zeros(0)


class UrlModel:
    """Counts of both models, accepted and rejected, held whole."""

    def __init__(self, key: np.ndarray, seen: np.ndarray):
        order = np.argsort(key)
        self.key, self.seen = key[order], seen[:, order]  # (grams,), (2, grams)
        context = (self.key & _mask(ORDER)) >> 8 | self.key >> _TAG << _TAG
        self.context, at = np.unique(context, return_inverse=True)
        sums = lambda v: np.stack([np.bincount(at, x, len(self.context)) for x in v])
        self.n, self.followers = sums(self.seen), sums(self.seen > 0)

    def numbers(self, window: np.ndarray) -> np.ndarray:
        """Difference of log-likelihoods, accepted over rejected, of each window."""
        p = np.full((2, len(window)), 1 / 256)
        for k in range(ORDER + 1):
            gram = window & _mask(k)
            seen, n, t = (np.where(ok, values[:, i], 0) for values, (i, ok) in (
                (self.seen, _place(self.key, gram | k << _TAG)),
                *((v, _place(self.context, gram >> 8 | k << _TAG)) for v in (self.n, self.followers))))
            p = np.where(n > 0, (seen + t * p) / np.maximum(n + t, 1), p)
        return np.log(p[0]) - np.log(p[1])

    def ratio(self, urls: list[str | None]) -> np.ndarray:
        """Mean difference of log-likelihoods per character, accepted over rejected."""
        each, size = windows(urls)
        distinct, back = np.unique(each, return_inverse=True)
        return _mean(self.numbers(distinct)[back], size)

    def score(self, pages: DataFrame) -> DataFrame:
        """``pages`` and ``llr``, the ratio of their urls; one pass."""
        shipped = pages.sparkSession.sparkContext.broadcast((self.key, self.seen))
        columns = pages.columns

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = UrlModel(*shipped.value)
            for whole in batches:
                for batch in byte_slices(whole, "url", _CHUNK_BYTES):
                    yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own.ratio(texts_of(batch, "url")), pa.float64())],
                                                     names=[*columns, "llr"])

        return pages.mapInArrow(score, StructType(list(pages.schema)).add("llr", DoubleType()))


def _place(keys: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each asked key stands in the sorted keys, and whether it is there."""
    at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
    return at, keys[at] == asked


class JoinedModel:
    """Counts of both models in a table; windows get their numbers by joins.

    A gram has at most 256 grams of the next order, and a context as many grams, so
    no join piles up on a key; a window meets each chunk of urls once."""

    def __init__(self, counts: DataFrame):
        self.counts = counts

    def numbers(self, window: DataFrame) -> DataFrame:
        """``window, number`` of the distinct ``window``s."""
        key, low = F.col("key"), F.lit(_mask(ORDER))
        context = F.shiftright(key.bitwiseAND(low), 8).bitwiseOR(F.shiftleft(F.shiftright(key, _TAG), _TAG))
        contexts = materialize(self.counts.groupBy(context.alias("context")).agg(
            *(F.sum(c).alias(f"n_{c}") for c in _KINDS), *(F.sum((F.col(c) > 0).cast("long")).alias(f"t_{c}") for c in _KINDS)), "url-contexts")
        before = None
        for k in range(ORDER + 1):
            gram = F.col("gram")
            p = window.select(F.col("window").bitwiseAND(F.lit(_mask(k))).alias("gram")).distinct()
            if before is None:
                p = p.withColumns({f"p_{c}": F.lit(1 / 256) for c in _KINDS})
            else:
                p = p.withColumn("shorter", gram.bitwiseAND(F.lit(_mask(k - 1)))).join(before, "shorter").drop("shorter")
            p = (p.withColumns({"key": gram.bitwiseOR(F.lit(k << _TAG)), "context": F.shiftright(gram, 8).bitwiseOR(F.lit(k << _TAG))})
                 .join(self.counts, "key", "left").join(contexts, "context", "left"))
            n, t, seen, prior = ([F.col(f"{x}{c}") for c in _KINDS] for x in ("n_", "t_", "", "p_"))
            before = p.select(gram.alias("shorter"), *(
                F.when(n[i] > 0, (F.coalesce(seen[i], F.lit(0)) + t[i] * prior[i]) / (n[i] + t[i])).otherwise(prior[i]).alias(f"p_{c}")
                for i, c in enumerate(_KINDS)))
        return before.select(F.col("shorter").alias("window"), (F.log("p_accepted") - F.log("p_rejected")).alias("number"))

    def score(self, pages: DataFrame) -> DataFrame:
        """``pages`` and ``llr``, the ratio of their urls."""
        schema, columns = StructType(list(pages.schema)), pages.columns

        def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            chunk = TaskContext.get().partitionId() << 32
            for whole in batches:
                for batch in byte_slices(whole, "url", _CHUNK_BYTES):
                    yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([chunk] * batch.num_rows, pa.int64())],
                                                     names=[*columns, "__chunk"])
                    chunk += 1

        def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                chunk = batch.column(1).to_numpy()
                url = texts_of(batch, "url")
                for c in np.unique(chunk):
                    found = np.unique(windows([url[i] for i in np.flatnonzero(chunk == c)])[0])
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), c)), pa.array(found)], names=["__chunk", "window"])

        def rate(own: pa.Table, numbers: pa.Table) -> pa.Table:
            key, value = (numbers.column(c).to_numpy() for c in ("window", "number"))
            order = np.argsort(key)
            each, size = windows(own.column("url").to_pylist())
            llr = _mean(value[order[np.searchsorted(key, each, sorter=order)]], size)
            return own.drop_columns("__chunk").append_column("llr", pa.array(llr, pa.float64()))

        # written, so that a url is in the same chunk whenever it is read
        dealt = materialize(pages.mapInArrow(deal, StructType(list(schema)).add("__chunk", LongType())), "url-chunks")
        asked = materialize(dealt.select("url", "__chunk").mapInArrow(distinct, "__chunk long, window long"), "url-windows")
        numbers = asked.distinct().join(self.numbers(asked.select("window").distinct()), "window")
        return (dealt.groupBy("__chunk").cogroup(numbers.groupBy("__chunk"))
                .applyInArrow(rate, StructType(list(schema)).add("llr", DoubleType())))


_KINDS = ("accepted", "rejected")


def count_grams(labelled: DataFrame) -> DataFrame:
    """``key, accepted, rejected``: grams of all orders over all rows of ``labelled(url, accepted)``."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in byte_slices(whole, "url", _CHUNK_BYTES):
                each, size = windows(texts_of(batch, "url"))
                good = np.repeat(batch.column(1).to_numpy(zero_copy_only=False).astype(bool), size)
                for k in range(ORDER + 1):
                    key, back = np.unique(each & _mask(k) | k << _TAG, return_inverse=True)
                    n, n_good = np.bincount(back, minlength=len(key)), np.bincount(back[good], minlength=len(key))
                    yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(n_good), pa.array(n - n_good)], names=["key", *_KINDS])

    return (labelled.select("url", "accepted").mapInArrow(count, "key long, accepted long, rejected long")
            .groupBy("key").agg(*(F.sum(c).alias(c) for c in _KINDS)))


def fit_model(labelled: DataFrame) -> UrlModel | JoinedModel | None:
    """The model of ``labelled(url, accepted)``; None unless there are urls of both kinds."""
    counts = materialize(count_grams(labelled), "url-grams")
    n, *kinds = counts.agg(F.count("*"), *(F.sum(c) for c in _KINDS)).first()
    if not all(kinds):
        return None
    if n > SLOTS:
        return JoinedModel(counts)
    got = counts.toArrow()  # at most SLOTS rows
    return UrlModel(got.column("key").to_numpy(), np.stack([got.column(c).to_numpy() for c in _KINDS]))


def calibrate(labelled: DataFrame, model: UrlModel | JoinedModel) -> float:
    """The cut with the smallest mean of both kinds' error rates (the middle of the
    best ones), from a histogram of all ``labelled(url, accepted)``."""
    bins = (model.score(labelled).groupBy(F.greatest(F.least(F.floor(F.col("llr") / _BIN), F.lit(1000)), F.lit(-1000)).cast("int").alias("b"), "accepted")
            .count().collect())  # at most 2001 bins of two kinds
    n = np.zeros((2, 2001))
    for r in bins:
        n[int(not r["accepted"]), r["b"] + 1000] += r["count"]
    if not n.sum(axis=1).all():
        return 0.0
    lost = np.concatenate([[0], np.cumsum(n[0])]) / n[0].sum() + np.concatenate([np.cumsum(n[1][::-1])[::-1], [0]]) / n[1].sum()
    best = np.flatnonzero(lost == lost.min())
    runs = np.split(best, np.flatnonzero(np.diff(best) > 1) + 1)
    widest = max(runs, key=len)
    return float((widest[0] + widest[-1]) / 2 - 1000) * _BIN


def filter_urls(pages: DataFrame, rules=RULES) -> DataFrame:
    """``page_id, host, path, rule, verdict, llr`` for every row of ``pages(page_id, url)``.

    ``verdict`` is the matching rule's action, else the method's: allow where the
    url's ratio ``llr`` reaches the cut.  Urls that a rule matches are the labelled
    ones.  Where rules reject none, or accept none, the method has one model only
    and gives the other urls that model's verdict; without any labelled url it
    allows them (``llr`` is null then).  Null and empty urls have empty host and
    path and are judged like any other.  Repeated rows are judged each."""
    ship_package(pages.sparkSession)
    host, path = host_and_path(F.col("url"))
    rule, action = matched_rule(F.col("host"), F.col("path"), rules)
    parsed = pages.select("page_id", "url", host.alias("host"), path.alias("path")) \
        .withColumns({"rule": rule, "action": action})
    labelled = parsed.filter("action is not null").select("url", (F.col("action") == "allow").alias("accepted"))
    fold = F.pmod(F.xxhash64("url"), F.lit(CALIBRATION_FOLDS)) == 0
    model = fit_model(labelled.filter(~fold))
    if model is None:
        kinds = {r["accepted"] for r in labelled.select("accepted").distinct().collect()}
        verdict = F.lit("block" if kinds == {False} else "allow")
        return parsed.select("page_id", "host", "path", "rule", F.coalesce("action", verdict).alias("verdict"),
                             F.lit(None).cast("double").alias("llr"))
    cut = calibrate(labelled.filter(fold), model)
    return model.score(parsed).select(
        "page_id", "host", "path", "rule",
        F.coalesce("action", F.when(F.col("llr") >= cut, "allow").otherwise("block")).alias("verdict"), "llr")
