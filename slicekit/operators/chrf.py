"""Character n-gram F-score (chrF, Popovic 2015) as a Spark job (M1, M2).

Plan shape (per sentence pair, keyed by ``keys``):

1. drop pairs with an empty/missing hypothesis (they are not scored);
2. remove all whitespace from both texts;
3. hash-partition the *texts* by the pair key -- the only shuffle;
4. explode every character n-gram (n = 1..order) of both sides: one
   look-ahead regex pass per text yields each position's window of up to
   ``order`` characters, whose prefixes are the n-grams (linear in length);
5. count per (pair, n, gram) and side, ``least`` gives the clipped matches;
6. sum per (pair, n), then one row per pair with the six precisions/recalls
   in fixed positions (so the float sums are order-deterministic).

Steps 5-6 group by keys that *contain* the pair key, so Spark reuses the
partitioning of step 3: the exploded grams (~order x text length rows) are
never shuffled, they are aggregated in the task that made them and spill to
disk if a partition's hash map grows too large.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import remove_whitespace

CHAR_ORDER = 6
BETA = 2


def _windows(text: Column, order: int) -> Column:
    """Every position's look-ahead window of up to ``order`` characters.

    One look-ahead regex, ``(?=(.{1,order})).``, matches at every position
    in a single linear pass (``.`` is one code point, as Python
    slicing); the n-grams of the text are the length-n prefixes of these
    windows.  ``substring(text, i, n)`` per position would cost O(length) per
    call on UTF-8 -- quadratic per text.
    """
    # the trailing ``.`` consumes one whole code point per match: after a
    # zero-width match Java advances one UTF-16 unit, which could land inside
    # a surrogate pair (characters beyond U+FFFF)
    return F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{1,{order}}}))."), F.lit(1))


# Target bytes of n-gram rows per task, and how much larger the n-gram rows are
# than the (compressed) text bytes Catalyst estimates: ~3x decompression,
# 6 orders, 2 sides.
_TARGET_BYTES = 256 << 20
_EXPANSION = 36
# Most tasks that are asked for without ``num_partitions``: a driver does not
# schedule many more well; larger inputs get larger tasks, which spill.
MAX_TASKS = 200_000


def _input_bytes(df: DataFrame) -> int | None:
    """Bytes the plan reads: the sum of its leaf (scan) size estimates.

    The root estimate is no use here: without cost-based statistics Spark
    estimates a join as the *product* of its inputs.
    """
    try:
        leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
        total = 0
        for i in range(leaves.size()):
            size = leaves.apply(i).stats().sizeInBytes()
            total += size if isinstance(size, int) else int(size.toString())
        return total
    except Exception:  # noqa: BLE001 - no estimate available
        return None


def _partitions(df: DataFrame, num_partitions: int | None) -> int:
    """Tasks for the n-gram work: explicit, else sized from the bytes the
    pairs are read from (never fewer than the shuffle partitions, nor than
    two tasks per core)."""
    if num_partitions:
        return int(num_partitions)
    base = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    try:  # at least two tasks per core: one task per core was ~2x slower (uneven texts)
        base = max(base, 2 * df.sparkSession.sparkContext.defaultParallelism)
    except Exception:  # noqa: BLE001 - no SparkContext (Spark Connect)
        pass
    est = _input_bytes(df)
    if est is None or est <= 0 or est >= 1 << 60:  # unknown size
        return base
    return max(base, min(MAX_TASKS, -(-est * _EXPANSION // _TARGET_BYTES)))


def chrf_stats(pairs: DataFrame, keys: list[str], hyp: str = "hyp", ref: str = "ref",
               order: int = CHAR_ORDER, repartition: bool = True,
               num_partitions: int | None = None) -> DataFrame:
    """Per (pair, n): hyp count (0 if the reference has no n-grams), ref count, matches.

    The texts are hash-partitioned by pair key into an explicit number of
    partitions: the shuffled texts are small next to the n-gram work they
    expand into (~order x length rows), and AQE would otherwise coalesce them
    into a handful of tasks by their byte size.
    """
    p = pairs.filter(F.col(hyp).isNotNull() & (F.length(hyp) > 0)).select(
        *keys, remove_whitespace(hyp).alias("_h"), remove_whitespace(ref).alias("_r"))
    if repartition:
        p = p.repartition(_partitions(pairs, num_partitions), *keys)
    # The hypothesis side gets one sentinel window '' (order 0) so every pair
    # keeps a row even when its texts yield no n-gram at all; order 0 never
    # counts as an effective order because the reference side has none.
    sides = F.array(
        F.struct(F.lit(True).alias("is_h"), F.concat(F.array(F.lit("")), _windows(F.col("_h"), order)).alias("ws")),
        F.struct(F.lit(False).alias("is_h"), _windows(F.coalesce(F.col("_r"), F.lit("")), order).alias("ws")))
    w = F.col("_w")
    prefixes = F.array(F.struct(F.when(w == "", F.lit(0)).alias("n"), F.lit("").alias("g")),
                       *[F.struct(F.lit(n).alias("n"), F.substring(w, 1, n).alias("g")) for n in range(1, order + 1)])
    x = (p.select(*keys, F.inline(sides))
          .select(*keys, "is_h", F.explode("ws").alias("_w"))
          .select(*keys, "is_h", F.inline(prefixes))
          .filter(F.length("g") == F.col("n")))
    per_gram = x.groupBy(*keys, "n", "g").agg(F.count_if("is_h").alias("hc"), F.count_if(~F.col("is_h")).alias("rc"))
    per_n = per_gram.groupBy(*keys, "n").agg(F.sum("hc").alias("h"), F.sum("rc").alias("r"),
                                              F.sum(F.least("hc", "rc")).alias("m"))
    return per_n.select(*keys, "n", F.when(F.col("r") > 0, F.col("h")).otherwise(F.lit(0)).alias("h"), "r", "m",
                        F.when(F.col("n") == 0, F.col("h")).alias("pairs"))


def chrf_sentence(pairs: DataFrame, keys: list[str], hyp: str = "hyp", ref: str = "ref",
                  order: int = CHAR_ORDER, beta: float = BETA, out: str = "chrf",
                  repartition: bool = True, num_partitions: int | None = None) -> DataFrame:
    """One chrF score (0-100) per pair with a non-empty hypothesis.

    Pairs that share a key are told apart by a hash of their texts; a pair that
    occurs k times gives k rows (its counts are k-fold on both sides, which
    leaves the score as it is).  Precision and recall are averaged over the *effective* orders (both sides
    have n-grams), then combined as F-beta.  No effective order -> 0.0.
    """
    out_keys, keys = keys, [*keys, "_texts"]
    st = chrf_stats(pairs.withColumn("_texts", F.xxhash64(hyp, ref)), keys, hyp, ref, order, repartition, num_partitions)
    prec = F.when(F.col("h") > 0, F.col("m") / F.col("h")).otherwise(F.lit(0.0))
    rec = F.when(F.col("r") > 0, F.col("m") / F.col("r")).otherwise(F.lit(0.0))
    eff = (F.col("h") > 0) & (F.col("r") > 0)
    st = st.select(*keys, "n", prec.alias("p"), rec.alias("q"), eff.alias("e"), "pairs")
    aggs = [F.max("pairs").alias("pairs")]
    for n in range(1, order + 1):
        aggs += [F.max(F.when(F.col("n") == n, F.col("p"))).alias(f"p{n}"),
                 F.max(F.when(F.col("n") == n, F.col("q"))).alias(f"q{n}")]
    per_pair = st.groupBy(*keys).agg(F.count_if("e").alias("eff"), *aggs)
    # Python-order sums (n = 1..order), so results are bit-stable
    psum, qsum = F.lit(0.0), F.lit(0.0)
    for n in range(1, order + 1):
        psum = psum + F.coalesce(F.col(f"p{n}"), F.lit(0.0))
        qsum = qsum + F.coalesce(F.col(f"q{n}"), F.lit(0.0))
    P = F.when(F.col("eff") > 0, psum / F.col("eff")).otherwise(F.lit(0.0))
    R = F.when(F.col("eff") > 0, qsum / F.col("eff")).otherwise(F.lit(0.0))
    f = float(beta) ** 2
    score = F.when(P + R > 0, F.lit(100.0) * ((F.lit(1.0 + f) * P * R) / (F.lit(f) * P + R))).otherwise(F.lit(0.0))
    scored = per_pair.select(*out_keys, score.alias(out), "pairs")
    return scored.select(*out_keys, out, F.explode(F.sequence(F.lit(1), F.col("pairs")))).select(*out_keys, out)


def chrf_corpus(scored: DataFrame, group_cols: list[str], col: str = "chrf") -> DataFrame:
    """M2: the reported system score = mean of sentence scores per group."""
    return scored.groupBy(*group_cols).agg(F.count(col).alias("n_scored"), F.avg(col).alias(col))


def sql_chrf(pairs_view: str, keys: list[str], hyp: str = "hyp", ref: str = "ref",
             order: int = CHAR_ORDER, beta: float = BETA) -> str:
    """The oracle: the same computation in DuckDB SQL (used by tests and oracles)."""
    from ..functions.text import sql_remove_whitespace
    k = ", ".join(keys)
    f = float(beta) ** 2
    psum = " + ".join(f"coalesce(p{n}, 0.0)" for n in range(1, order + 1))
    qsum = " + ".join(f"coalesce(q{n}, 0.0)" for n in range(1, order + 1))
    pcols = ", ".join(f"max(CASE WHEN n = {n} THEN p END) AS p{n}, max(CASE WHEN n = {n} THEN q END) AS q{n}"
                      for n in range(1, order + 1))
    return f"""(WITH cp AS (SELECT {k}, {sql_remove_whitespace(hyp)} AS h, {sql_remove_whitespace(ref)} AS r
              FROM {pairs_view} WHERE {hyp} IS NOT NULL AND length({hyp}) > 0),
 ord AS (SELECT unnest(range(1, {order + 1})) AS n),
 gh AS (SELECT {k}, n, substring(h, i, n) AS g FROM
        (SELECT {k}, h, n, unnest(range(1, length(h) - n + 2)) AS i FROM cp CROSS JOIN ord)),
 gr AS (SELECT {k}, n, substring(r, i, n) AS g FROM
        (SELECT {k}, r, n, unnest(range(1, length(coalesce(r, '')) - n + 2)) AS i FROM cp CROSS JOIN ord)),
 ch AS (SELECT {k}, n, g, count(*) AS hc FROM gh GROUP BY ALL),
 cr AS (SELECT {k}, n, g, count(*) AS rc FROM gr GROUP BY ALL),
 pg AS (SELECT {", ".join(f"coalesce(ch.{c}, cr.{c}) AS {c}" for c in keys)}, coalesce(ch.n, cr.n) AS n,
               coalesce(hc, 0) AS hc, coalesce(rc, 0) AS rc
        FROM ch FULL OUTER JOIN cr ON {" AND ".join(f"ch.{c} = cr.{c}" for c in keys)} AND ch.n = cr.n AND ch.g = cr.g),
 pn AS (SELECT {k}, n, sum(hc) AS h0, sum(rc) AS r, sum(least(hc, rc)) AS m FROM pg GROUP BY ALL),
 pn2 AS (SELECT {k}, n, CASE WHEN r > 0 THEN h0 ELSE 0 END AS h, r, m FROM pn),
 pq AS (SELECT {k}, n, CASE WHEN h > 0 THEN CAST(m AS DOUBLE) / h ELSE 0.0 END AS p,
               CASE WHEN r > 0 THEN CAST(m AS DOUBLE) / r ELSE 0.0 END AS q, h > 0 AND r > 0 AS e FROM pn2),
 pp AS (SELECT {k}, count_if(e) AS eff, {pcols} FROM pq GROUP BY ALL),
 pr AS (SELECT {k}, CASE WHEN eff > 0 THEN ({psum}) / eff ELSE 0.0 END AS bp,
               CASE WHEN eff > 0 THEN ({qsum}) / eff ELSE 0.0 END AS br FROM pp)
 SELECT {", ".join(f"cp.{c}" for c in keys)},
  coalesce(CASE WHEN bp + br > 0 THEN 100.0 * (({1.0 + f} * bp * br) / ({f} * bp + br)) ELSE 0.0 END, 0.0) AS chrf
 FROM cp LEFT JOIN pr ON {" AND ".join(f"cp.{c} = pr.{c}" for c in keys)})"""
