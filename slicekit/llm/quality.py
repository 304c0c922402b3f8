"""Quality classifier by weak labels.

Overlapping heuristic labellers -- and, where there are some, an annotator's
labels -- vote on every document: bad, good or nothing.  Expectation
maximisation over the counts of all vote patterns estimates how each labeller
votes on good and on bad documents; the posterior of a document's pattern is its
label.  Posterior labels of a bounded sample train a hashed linear scorer, which
judges every document from its whole text alone, cut where held-out rows of the
sample are split best.  Two axes are judged so, low quality and toxicity; a
document is rejected on either.
"""

from __future__ import annotations

import math
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructType

from ..session import materialize, ship_package
from .common import byte_slices, texts_of, with_row_keys, worker_state

#: Documents the scorer is trained on, at most (drawn by hash; annotated ones where there are enough).
TRAIN_ROWS = 8000
DIMENSIONS = 1 << 20
FEATURES = 6000  # hashed features that keep a weight, at most, for each axis
AXES = ("low_quality", "toxic")

# English insults, one of the heuristic labellers of toxicity.
INSULTS = frozenset(b"""clown disgusting dumb fool garbage idiot imbecile jerk loser moron pathetic
scum stupid trash ugly useless vermin worthless""".split())

#: Words whose weights a scorer remembers.
KNOWN_WORDS = 200_000

_LETTERS = bytes(b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))
_UPPER = bytes(range(0x41, 0x5B))
_SYMBOLS = b"!#$%&*+<=>@[\\]^_`{|}~"
_VOTES = 3  # bad, good, nothing


def words_of(lowered: str) -> list[bytes]:
    return lowered.encode().translate(_LETTERS).split()


# -- what is measured of a text

_SHAPE = ("symbols", "capitals", "bars", "echoes", "variety")


def shape(text: str) -> list[float]:
    """Shares of symbols, capitals, bars, repeated neighbours, and of words that occur before."""
    raw = text.encode()
    size, words = max(1, len(raw)), raw.split()
    n = max(1, len(words))
    return [(size - len(raw.translate(None, _SYMBOLS))) / size if raw else 0.0,
            (size - len(raw.translate(None, _UPPER))) / size if raw else 0.0,
            raw.count(b"|") / n,
            sum(map(bytes.__eq__, words, words[1:])) / n,
            1 - len(set(words)) / n if words else 0.0]


def votes(text: str | None) -> tuple[list[int], list[int]]:
    """The heuristic labellers' votes on both axes: 0 bad, 1 good, 2 nothing.  Those
    of low quality look for one kind of junk each and are silent otherwise, but the
    last, which finds texts without any sign of junk good."""
    symbols, capitals, bars, echoes, variety = shape(text or "")
    n = len((text or "").split())
    signs = [symbols > 0.04, capitals > 0.3 and n > 3, bars > 0.15, echoes > 0.15 and n > 3, variety > 0.7 and n > 20]
    plain = symbols < 0.01 and capitals < 0.1 and bars < 0.02 and echoes < 0.03 and variety < 0.5
    insults = len(INSULTS.intersection(words_of((text or "").lower())))
    return [0 if s else 2 for s in signs] + [1 if plain else 2], [0 if insults else 1]


def _pack(v: list[int]) -> int:
    return sum(x * _VOTES ** i for i, x in enumerate(v))


def _unpack(code: int, n: int) -> list[int]:
    return [code // _VOTES ** i % _VOTES for i in range(n)]


# -- expectation maximisation over vote patterns


def estimate(patterns: dict[tuple[int, ...], int], trust: float = 0.99, rounds: int = 100) -> tuple[float, np.ndarray]:
    """Share of bad documents, and P(vote | bad, good) for every labeller, by EM
    from the counts of vote patterns.  Started from: labellers are right more often
    than not.  The last labeller is the annotator: where they vote, they are taken to be right
    with probability ``trust`` (two labellers alone would not tell who is right);
    everyone else is estimated."""
    votes_ = np.array(list(patterns), np.int64).reshape(len(patterns), -1)
    count = np.array(list(patterns.values()), float)
    m = votes_.shape[1]
    prior, table = 0.2, np.zeros((m, 2, _VOTES))
    table[:, 0], table[:, 1] = (0.6, 0.1, 0.3), (0.05, 0.65, 0.3)
    table[-1] = (trust, 1 - trust, 1), (1 - trust, trust, 1)
    for _ in range(rounds):
        bad = posterior(votes_, prior, table)
        before, prior = prior, float((bad * count).sum() + 1) / float(count.sum() + 2)
        for k in range(m - 1):
            for y, share in enumerate((bad, 1 - bad)):
                # a few votes of the starting belief keep labellers that never vote defined
                start = np.array((0.6, 0.1, 0.3) if y == 0 else (0.05, 0.65, 0.3))
                seen = np.bincount(votes_[:, k], share * count, _VOTES) + start
                table[k, y] = seen / seen.sum()
        if abs(prior - before) < 1e-9:
            break
    return prior, table


def posterior(votes_: np.ndarray, prior: float, table: np.ndarray) -> np.ndarray:
    """P(bad | votes) for rows of votes."""
    at = np.arange(votes_.shape[1])
    bad = math.log(prior) + np.log(table[at, 0, votes_]).sum(axis=1)
    good = math.log1p(-prior) + np.log(table[at, 1, votes_]).sum(axis=1)
    return 1 / (1 + np.exp(np.clip(good - bad, -500, 500)))


# -- the hashed linear scorer


def word_features(word: bytes) -> list[int]:
    """Hashes of the word and of its beginnings."""
    return [zlib.crc32(word + b"$") % DIMENSIONS, *(zlib.crc32(word[:k]) % DIMENSIONS for k in range(4, min(len(word), 10) + 1))]


def _scale(n_words: int) -> float:
    return 10 / math.sqrt(n_words + 10)


def document_features(text: str | None) -> tuple[np.ndarray, np.ndarray, list[float]]:
    """Hashed features of the distinct words, their values, and the shape."""
    words = set(words_of((text or "").lower()))
    hashed = np.fromiter((f for w in words for f in word_features(w)), np.int32)
    feature, count = np.unique(hashed, return_counts=True)
    return feature, (count * _scale(len(words))).astype(np.float32), shape(text or "")


def train(feature: np.ndarray, value: np.ndarray, row: np.ndarray, dense: np.ndarray, label: np.ndarray, kept: np.ndarray,
          weight_decay: float = 2e-4, rounds: int = 300) -> tuple[dict[int, float], np.ndarray, float]:
    """Logistic regression with posterior labels, by proximal gradient steps with
    an absolute penalty: weights of the ``kept`` hashed features, of the shape, and the bias."""
    n = len(label)
    rate = max(1e-6, min(1 - 1e-6, float(label.mean())))
    place = np.full(DIMENSIONS, -1, np.int64)
    place[kept] = np.arange(len(kept))
    at = place[feature]
    on = at >= 0
    at, x, r = at[on], value[on].astype(float), row[on]
    dense = dense * 10  # shares on the scale of the other values
    w, wd, b = np.zeros(len(kept)), np.zeros(dense.shape[1]), math.log(rate / (1 - rate))
    norm = np.bincount(r, x * x, n) + (dense * dense).sum(axis=1) + 1
    step = 4 / max(1e-9, float(np.percentile(norm, 95)) * 4)
    vw, vd, vb, t = w.copy(), wd.copy(), b, 1.0
    for _ in range(rounds):
        margin = np.bincount(r, vw[at] * x, n) + dense @ vd + vb
        err = (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - label) / n
        nw = vw - step * n / 8 * np.bincount(at, err[r] * x, len(kept))
        nw = np.sign(nw) * np.maximum(np.abs(nw) - step * n / 8 * weight_decay, 0)
        nd, nb = vd - step * n / 8 * (dense.T @ err), vb - step * n / 8 * err.sum()
        t1 = (1 + math.sqrt(1 + 4 * t * t)) / 2
        vw, vd, vb = nw + (t - 1) / t1 * (nw - w), nd + (t - 1) / t1 * (nd - wd), nb + (t - 1) / t1 * (nb - b)
        w, wd, b, t = nw, nd, nb, t1
    return {int(k): float(v) for k, v in zip(kept, w) if v}, wd * 10, float(b)


def cutoff(margin: np.ndarray, bad: np.ndarray) -> float:
    """The margin that splits held-out rows with the fewest errors; of those the middle of the widest gap."""
    if not bad.any() or bad.all():
        return 0.0
    order = np.argsort(margin, kind="stable")
    m, b = np.concatenate([margin[order][:1] - 2, margin[order], margin[order][-1:] + 2]), bad[order]
    errors = np.concatenate([[0], np.cumsum(b)]) + np.concatenate([np.cumsum(~b[::-1])[::-1], [0]])
    gap = np.where(errors == errors.min(), np.diff(m), -1)
    at = int(np.argmax(gap))
    return float((m[at] + m[at + 1]) / 2)


class Scorer:
    """P(bad) of a text on each axis."""

    def __init__(self, axes: list[tuple[dict[int, float], np.ndarray, float]]):
        self.axes = axes
        self.known: dict[bytes, tuple | None] = {}

    def _word(self, word: bytes) -> tuple | None:
        features = word_features(word)
        each = tuple(sum(w.get(f, 0.0) for f in features) for w, _, _ in self.axes)
        return each if any(each) else None

    def score(self, text: str | None) -> list[float]:
        words = set(words_of((text or "").lower()))
        if len(self.known) > KNOWN_WORDS:
            self.known = {}
        known, total = self.known, [0.0] * len(self.axes)
        for word in words:
            if word not in known:
                each = known[word if len(word) <= 64 else b""] = self._word(word)
            else:
                each = known[word]
            if each:
                for k, v in enumerate(each):
                    total[k] += v
        form, scale = np.array(shape(text or "")), _scale(len(words))
        return [1 / (1 + math.exp(-max(-500.0, min(500.0, b + t * scale + float(form @ d)))))
                for t, (_, d, b) in zip(total, self.axes)]


# -- the distributed part


def _annotated(rows: DataFrame, labels: DataFrame | None) -> DataFrame:
    """Adds the annotator's vote on each axis; ids labelled twice take the worse label."""
    if labels is None:
        return rows.withColumns({f"a_{a}": F.lit(2) for a in AXES})
    one = labels.filter("doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("__q"), F.max("toxic").alias("__t"))
    vote = lambda bad, good: F.when(bad, 0).when(good, 1).otherwise(2)
    return rows.join(one, "doc_id", "left").select(
        *rows.columns, vote(F.col("__q") == 0, F.col("__q") == 1).alias("a_low_quality"),
        vote(F.col("__t") == 1, F.col("__t") == 0).alias("a_toxic"))


def fit_scorer(docs: DataFrame, labels: DataFrame | None = None, train_rows: int = TRAIN_ROWS) -> Scorer:
    """Votes on all ``docs(doc_id, text)``, EM over all of them, and a scorer for each axis."""
    ship_package(docs.sparkSession)
    n_labellers = [len(v) for v in votes("")]

    def cast(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in byte_slices(whole, "text"):
                both = [tuple(map(_pack, votes(t))) for t in texts_of(batch)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(2), batch.column(3),
                     *(pa.array([v[k] for v in both], pa.int32()) for k in range(2))],
                    names=["doc_id", "__k1", "__k2", "low_quality", "toxic"])

    keyed = with_row_keys(docs.select("doc_id", "text"))
    cast_votes = materialize(_annotated(
        keyed.mapInArrow(cast, "doc_id long, __k1 long, __k2 long, low_quality int, toxic int"), labels), "votes")
    seen = cast_votes.groupBy("low_quality", "toxic", *(f"a_{a}" for a in AXES)).count().collect()  # patterns, not rows
    belief = []
    for k, axis in enumerate(AXES):
        patterns: dict[tuple[int, ...], int] = {}
        for r in seen:
            p = (*_unpack(r[axis], n_labellers[k]), r[f"a_{axis}"])
            patterns[p] = patterns.get(p, 0) + r["count"]
        belief.append((patterns, estimate(patterns) if patterns else None))

    annotated = cast_votes.filter(" or ".join(f"a_{a} < 2" for a in AXES))
    enough = annotated.limit(200).count() == 200
    # rows equal in id and text are one document
    drawn = (annotated if enough else cast_votes).dropDuplicates(["__k1", "__k2"]).orderBy(F.xxhash64("__k1"), "__k2").limit(train_rows)

    known = [{p: float(y) for p, y in zip(patterns, posterior(np.array(list(patterns)), *of))} if of else {}
             for patterns, of in belief]

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in byte_slices(whole, "text"):
                f, v, form = zip(*map(document_features, texts_of(batch)))
                cast_, annotator = ([batch.column(i + k).to_pylist() for k in range(2)] for i in (1, 3))
                label = [pa.array([known[k][(*_unpack(c, n_labellers[k]), a)] for c, a in zip(cast_[k], annotator[k])], pa.float64())
                         for k in range(2)]
                yield pa.RecordBatch.from_arrays(
                    [*label, batch.column(5), pa.array([x.tobytes() for x in f], pa.binary()),
                     pa.array([x.tobytes() for x in v], pa.binary()), pa.array(list(form), pa.list_(pa.float64()))],
                    names=_SAMPLE_COLUMNS)

    # at most train_rows ids: bounded, so the texts are not shuffled for them
    picked = keyed.drop("doc_id").join(F.broadcast(drawn.drop("doc_id")), ["__k1", "__k2"]).dropDuplicates(["__k1", "__k2"]).select(
        "text", "low_quality", "toxic", "a_low_quality", "a_toxic", (F.pmod("__k1", F.lit(5)) == 0).alias("held"))
    sample = materialize(picked.mapInArrow(extract, _SAMPLE), "quality-sample")
    return _fit(sample, train_rows)


_SAMPLE = "y0 double, y1 double, held boolean, feature binary, value binary, shape array<double>"
_SAMPLE_COLUMNS = ["y0", "y1", "held", "feature", "value", "shape"]


def _fit(sample: DataFrame, train_rows: int) -> Scorer:
    """Screens the features of the sample where it lies, and trains on what is kept of them."""
    def screen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            f = [np.frombuffer(x, np.int32) for x in batch.column(2).to_pylist()]
            size = list(map(len, f))
            feature, at = np.unique(np.concatenate(f or [np.zeros(0, np.int32)]), return_inverse=True)
            bad = [np.bincount(at, np.repeat(batch.column(k).to_numpy(zero_copy_only=False), size), len(feature)) for k in range(2)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(feature), pa.array(np.bincount(at, minlength=len(feature))), pa.array(bad[0]), pa.array(bad[1])],
                names=["feature", "n", "bad0", "bad1"])

    seen = (sample.filter("not held").select("y0", "y1", "feature").mapInArrow(screen, "feature int, n long, bad0 double, bad1 double")
            .groupBy("feature").agg(*(F.sum(c).alias(c) for c in ("n", "bad0", "bad1"))).filter("n >= 3"))
    rates = sample.agg(F.avg("y0"), F.avg("y1")).first()
    if rates[0] is None:
        return Scorer([({}, np.zeros(len(_SHAPE)), -10.0) for _ in AXES])
    kept = []
    for k, rate in enumerate(max(1e-6, min(1 - 1e-6, r)) for r in rates):
        # the features whose documents' labels stand out most
        z = F.abs(F.col(f"bad{k}") - rate * F.col("n")) / F.sqrt(F.col("n") * rate * (1 - rate))
        top = seen.select("feature", z.alias("z")).filter("z > 2").orderBy(F.desc("z"), "feature").limit(FEATURES)
        kept.append(np.sort(np.array([r["feature"] for r in top.collect()], np.int64)))
    either = np.union1d(*kept)

    def shrink(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: tuple[list, list] = ([], [])
            for f, v in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True):
                f, v = np.frombuffer(f, np.int32), np.frombuffer(v, np.float32)
                on = np.isin(f, either)
                out[0].append(f[on].tobytes())
                out[1].append(v[on].tobytes())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], *(pa.array(x, pa.binary()) for x in out), batch.column(5)], names=_SAMPLE_COLUMNS)

    rows = sample.mapInArrow(shrink, _SAMPLE).limit(train_rows).collect()
    rows.sort(key=lambda r: (r["feature"], r["value"], r["shape"]))  # tasks end in any order
    features = [np.frombuffer(r["feature"], np.int32) for r in rows]
    values = [np.frombuffer(r["value"], np.float32) for r in rows]
    dense = np.array([r["shape"] for r in rows])
    hold = np.array([r["held"] for r in rows]) if len(rows) >= 50 else np.zeros(len(rows), bool)
    pick = lambda mask: (np.concatenate([f for f, m in zip(features, mask) if m] or [np.zeros(0, np.int32)]),
                         np.concatenate([v for v, m in zip(values, mask) if m] or [np.zeros(0, np.float32)]),
                         np.repeat(np.arange(int(mask.sum())), [len(f) for f, m in zip(features, mask) if m]))
    fitted = []
    for k in range(len(AXES)):
        label = np.array([r[f"y{k}"] for r in rows])
        weights, form, bias = train(*pick(~hold), dense[~hold], label[~hold], kept[k])
        f, v, r = pick(hold)  # the cut is set on rows that the weights have not seen
        each = np.fromiter((weights.get(x, 0.0) for x in f.tolist()), float, len(f)) * v
        margin = np.bincount(r, each, int(hold.sum())) + dense[hold] @ form + bias
        fitted.append((weights, form, bias - cutoff(margin, label[hold] > 0.5)))
    return Scorer(fitted)


def with_scores(docs: DataFrame, scorer: Scorer, names: tuple[str, str] = ("__low_quality", "__toxic")) -> DataFrame:
    """``docs`` and the scorer's P(bad) on both axes; one pass, no shuffle, all columns kept."""
    ship_package(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(scorer.axes)  # at most FEATURES weights an axis
    columns, key = docs.columns, uuid.uuid4().hex

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = worker_state("scorer", key, lambda: Scorer(model.value))
        for whole in batches:
            for batch in byte_slices(whole, "text"):
                scores = [own.score(t) for t in texts_of(batch)]
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, *(pa.array([s[k] for s in scores], pa.float64()) for k in range(2))],
                    names=[*columns, *names])

    schema = StructType(list(docs.schema)).add(names[0], DoubleType()).add(names[1], DoubleType())
    return docs.mapInArrow(judge, schema)


def classify(docs: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """``doc_id, low_quality, toxic, rejected`` for every row of ``docs(doc_id, text)``:
    both scores, and whether either passes a half (where the cut was set).

    Null and empty texts have no word and no shape: they get what the scorer's
    bias says.  ``labels(doc_id, quality, toxic)`` may be absent, empty, hold nulls
    (no vote) or an id twice (the worse label).  Rows with equal ids are judged each
    from their own text.  An empty table gives no rows."""
    scored = with_scores(docs.select("doc_id", "text"), fit_scorer(docs, labels))
    return scored.select("doc_id", F.col("__low_quality").alias("low_quality"), F.col("__toxic").alias("toxic"),
                         ((F.col("__low_quality") > 0.5) | (F.col("__toxic") > 0.5)).alias("rejected"))


def drop_rejected(docs: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """``docs`` without the rows the classifier rejects."""
    scored = with_scores(docs, fit_scorer(docs, labels))
    return scored.filter("__low_quality <= 0.5 and __toxic <= 0.5").select(*docs.columns)
