"""Reproducible sampling.

Order is ``md5('<seed>:' || id)`` -- the same digest in any engine and on any
cluster layout, unlike ``rand()`` or a Mersenne-Twister shuffle (so the rows
chosen differ from a Python ``random.shuffle`` with the same seed; the
*method* is the same: a seeded shuffle, then the first n).

Every "first n per group" is ``row_number() <= n`` with a literal ``n``,
which Catalyst plans as a partial + final ``WindowGroupLimit``: each map task
forwards at most n rows per group, so a group holding a third of all rows
still ships only n rows through the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions.tags import mt_phenomena
from ..session import materialize as materialize_table
from .jobs import new_candidates
from .ordering import running_totals

#: Samples of more rows a group than this get their positions from range partitions instead of one window a group.
WINDOW_ROWS = 100_000

# Sentinels for thresholds: md5 hex digests sort strictly between them.
_BEFORE_ALL = ""      # bucket already full: no item may enter through it
_AFTER_ALL = "~"      # bucket never fills: every item carrying the tag enters


def order_key(seed: int | str, id_col: str = "id") -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")))


def seeded_sample(df: DataFrame, n: int, seed: int = 42, by: str | None = "dataset", key: str = "id",
                  id_prefix_col: str | None = None, width: int = 4) -> DataFrame:
    """Per group, the first ``min(n, size)`` rows of a seeded shuffle.

    Adds ``position`` (0-based rank within the group).  With
    ``id_prefix_col`` the id becomes ``<prefix>_<position zero-padded>``.
    """
    k = order_key(seed, key)
    if by and int(n) > WINDOW_ROWS:
        x = _large_sample(df, int(n), k, by, key)
        return _sample_ids(x, id_prefix_col, key, width)
    w = (Window.partitionBy(by) if by else Window.partitionBy()).orderBy(k, F.col(key))
    if not by:  # the n rows are taken before one window numbers them
        df = df.orderBy(k, F.col(key)).limit(int(n))
    x = df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= F.lit(int(n)))
    x = x.withColumn("position", F.col("_rn") - 1).drop("_rn")
    return _sample_ids(x, id_prefix_col, key, width)


def _sample_ids(x: DataFrame, prefix: str | None, key: str, width: int) -> DataFrame:
    if not prefix:
        return x
    return x.withColumn(key, F.format_string(f"%s_%0{width}d", F.col(prefix), F.col("position")))


def _large_sample(df: DataFrame, n: int, k: Column, by: str, key: str) -> DataFrame:
    """The same rows and positions as by the window, with each group's order spread over range partitions.

    Only the order's columns are laid out; the rows join their position by (group, id), and rows
    that repeat an id take their places in turn."""
    ids = df.groupBy(by, key).agg(F.count(F.lit(1)).alias("_times")).withColumn("_k", k)
    placed = running_totals(ids, [by], ["_k", key], {"_last": ("sum", F.col("_times"))}) \
        .filter(F.col("_last") - F.col("_times") < n).select(by, key, "_k", "_last", "_times")
    x = df.alias("d").join(placed.alias("p"), F.col(f"d.{by}").eqNullSafe(F.col(f"p.{by}"))
                           & F.col(f"d.{key}").eqNullSafe(F.col(f"p.{key}")))
    turn = F.row_number().over(Window.partitionBy(F.col(f"d.{by}"), F.col(f"d.{key}")).orderBy(F.lit(0)))
    x = x.select("d.*", (F.col("_last") - F.col("_times") + turn - 1).cast("int").alias("position"))
    return x.filter(F.col("position") < n)


def take_first_n(df: DataFrame, n: int, order: str | list[str]) -> DataFrame:
    """The first n rows in an explicit order (``TakeOrderedAndProject``)."""
    cols = [order] if isinstance(order, str) else list(order)
    return df.orderBy(*cols).limit(int(n))


def sample_shortfall(sampled: DataFrame, targets: dict[str, int], spark: SparkSession,
                     by: str = "dataset") -> DataFrame:
    """Requested vs obtained per group (groups from the target list)."""
    t = spark.createDataFrame(list(targets.items()), f"{by} string, requested int")
    got = sampled.groupBy(by).agg(F.count(F.lit(1)).alias("obtained"))
    j = F.broadcast(t).join(got, by, "left")
    return j.select(by, "requested", F.coalesce("obtained", F.lit(0)).alias("obtained"),
                    F.greatest(F.col("requested") - F.coalesce("obtained", F.lit(0)), F.lit(0)).alias("shortfall"))


def _buckets_df(spark: SparkSession, buckets: dict[str, tuple[tuple[str, ...], tuple[str, ...]]]) -> DataFrame:
    rows = []
    for lang, (req, bonus) in buckets.items():
        rows += [(lang, p, True) for p in req] + [(lang, p, False) for p in bonus]
    return spark.createDataFrame(rows, "lang string, phenomenon string, required boolean")


def bucket_counts(items: DataFrame, buckets_df: DataFrame) -> DataFrame:
    """Occurrences of each configured bucket tag among ``items`` (a list with
    a tag twice counts twice); untagged items count nowhere."""
    occ = items.filter(F.col("tags").isNotNull()).select("lang", F.explode(mt_phenomena("tags")).alias("phenomenon"))
    cnt = occ.groupBy("lang", "phenomenon").agg(F.count(F.lit(1)).alias("n"))
    return F.broadcast(buckets_df).join(cnt, ["lang", "phenomenon"], "left") \
        .select("lang", "phenomenon", "required", F.coalesce("n", F.lit(0)).alias("n"))


def quota_sample(candidates: DataFrame, existing: DataFrame, buckets: dict[str, tuple[tuple[str, ...], tuple[str, ...]]],
                 quota: int, spark: SparkSession, batch_size: int = 32, seed: int = 42,
                 materialize: bool = True) -> DataFrame:
    """Fill (lang, phenomenon) buckets to ``quota`` from shuffled candidates.

    Semantics of the sequential loop it replaces: candidates are visited in
    seeded-shuffle order, in batches of ``batch_size``; an item is accepted if
    it carries a *required* tag whose bucket is not yet full, or any *bonus*
    tag; the loop stops after the batch in which every required bucket is
    full; previously accepted items (``existing``) pre-fill the buckets and are
    never candidates again; an item whose tagging failed (null tags) is never
    accepted.

    Set-based rewrite: while a bucket is not full every item with that tag is
    accepted, so the bucket's fill before an item is ``existing + tag
    occurrences before it``.  Hence with thr(lang, ph) = the item at which the
    occurrences reach ``quota - existing``:
    ``accept <=> item <= stop(lang) AND (some required ph: item <= thr OR some bonus ph)``
    where stop = the end of the batch holding the last threshold.  Each step
    is an aggregate or a ``row_number() <= literal`` (bounded per group).

    ``buckets[lang] = (required_tags, bonus_tags)``; ``candidates`` and
    ``existing`` are ``(id, lang, tags)`` frames.  Returns the accepted rows
    of ``candidates`` plus their order key ``_k``.

    The candidate set is scanned four times (tag occurrences, positions, the
    batch closer, acceptance); with ``materialize`` it is written once as a
    Parquet table in the shared checkpoint folder (survives executor loss,
    later scans read only the columns they need) instead of being recomputed
    from its sources each time.
    """
    q, B = int(quota), int(batch_size)
    bdf = _buckets_df(spark, buckets)
    req = bdf.filter("required")
    # bootstrap: occurrences already in the cache
    need = bucket_counts(existing, req).select("lang", "phenomenon", (F.lit(q) - F.col("n")).alias("need"))
    cand = new_candidates(candidates, existing).withColumn("_k", order_key(seed, "id"))
    if materialize:
        cand = materialize_table(cand, "quota-candidates")
    pos_key = F.struct(F.col("_k"), F.col("id"))

    # thresholds of the buckets that still need items: the need-th occurrence
    occ = (cand.filter(F.col("tags").isNotNull())
           .select("lang", "_k", "id", F.explode(mt_phenomena("tags")).alias("phenomenon"))
           .join(F.broadcast(need.filter(F.col("need") > 0)), ["lang", "phenomenon"]))
    w = Window.partitionBy("lang", "phenomenon").orderBy("_k", "id")
    hit = (occ.withColumn("_rn", F.row_number().over(w))
           .filter((F.col("_rn") <= F.lit(q)) & (F.col("_rn") == F.col("need")))
           .select("lang", "phenomenon", F.struct("_k", "id").alias("thr")))
    thr = (F.broadcast(need).join(hit, ["lang", "phenomenon"], "left")
           .select("lang", "phenomenon",
                   F.when(F.col("need") <= 0, F.struct(F.lit(_BEFORE_ALL).alias("_k"), F.lit("").alias("id")))
                    .when(F.col("thr").isNull(), F.struct(F.lit(_AFTER_ALL).alias("_k"), F.lit("").alias("id")))
                    .otherwise(F.col("thr")).alias("thr")))
    per_lang = thr.groupBy("lang").agg(F.max("thr").alias("last"),
                                        F.map_from_entries(F.collect_list(F.struct("phenomenon", "thr"))).alias("thr_map"))

    # position of the last threshold, rounded up to the end of its batch
    pos = (cand.join(F.broadcast(per_lang.select("lang", "last")), "lang")
           .groupBy("lang").agg(F.count_if(pos_key <= F.col("last")).alias("pos_last")))
    ends = per_lang.join(pos, "lang", "left").select(
        "lang", "last", "thr_map",
        F.coalesce("pos_last", F.lit(0)).alias("pos_last"))
    ends = ends.withColumn("extra", (F.ceil(F.col("pos_last") / F.lit(B)) * B - F.col("pos_last")).cast("int"))
    # the item ``extra`` places after the last threshold closes the batch
    after = (cand.join(F.broadcast(ends.select("lang", "last", "extra")), "lang")
             .filter((pos_key > F.col("last")) & (F.col("last._k") != F.lit(_AFTER_ALL))))
    w2 = Window.partitionBy("lang").orderBy("_k", "id")
    closer = (after.withColumn("_rn", F.row_number().over(w2))
              .filter((F.col("_rn") <= F.lit(B)) & (F.col("_rn") == F.col("extra")))
              .select("lang", F.struct("_k", "id").alias("closer")))
    stops = ends.join(closer, "lang", "left").select(
        "lang", "thr_map",
        F.when(F.col("last._k") == F.lit(_AFTER_ALL), F.struct(F.lit(_AFTER_ALL).alias("_k"), F.lit("").alias("id")))
         .when(F.col("extra") == 0, F.col("last"))
         .when(F.col("closer").isNull(), F.struct(F.lit(_AFTER_ALL).alias("_k"), F.lit("").alias("id")))
         .otherwise(F.col("closer")).alias("stop"))

    bonus_map = F.create_map(*[x for lang, (_, bon) in buckets.items()
                               for x in (F.lit(lang), F.array(*[F.lit(b) for b in bon]).cast("array<string>"))])
    j = cand.filter(F.col("tags").isNotNull()).join(F.broadcast(stops), "lang")
    ph = mt_phenomena("tags")
    via_req = F.exists(ph, lambda p: F.coalesce(pos_key <= F.try_element_at(F.col("thr_map"), p), F.lit(False)))
    via_bonus = F.exists(ph, lambda p: F.coalesce(F.array_contains(F.try_element_at(bonus_map, F.col("lang")), p),
                                                  F.lit(False)))
    acc = j.filter((pos_key <= F.col("stop")) & (via_req | via_bonus))
    return acc.drop("thr_map", "stop")


def bucket_report(accepted: DataFrame, existing: DataFrame,
                  buckets: dict[str, tuple[tuple[str, ...], tuple[str, ...]]], quota: int,
                  spark: SparkSession) -> DataFrame:
    """Per configured bucket, the existing and final counts and whether the quota is met."""
    bdf = _buckets_df(spark, buckets)
    ex = bucket_counts(existing, bdf).withColumnRenamed("n", "existing")
    allx = existing.select("id", "lang", "tags").unionByName(accepted.select("id", "lang", "tags"))
    fin = bucket_counts(allx, bdf).select("lang", "phenomenon", F.col("n").alias("final"))
    return ex.join(fin, ["lang", "phenomenon"]).select(
        "lang", "phenomenon", "required", F.col("existing").cast("bigint").alias("existing"),
        F.col("final").cast("bigint").alias("final"), (F.col("final") >= F.lit(int(quota))).alias("met"))
