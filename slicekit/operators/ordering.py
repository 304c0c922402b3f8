"""Running totals and positions inside groups of any size.

A plain window ``PARTITION BY key ORDER BY ...`` puts a whole group into one
task.  Here the rows are range-partitioned by ``(keys, order)``, so a group that
holds a third of the table lies in many partitions; each partition adds up its
own rows, and only the groups cut by a partition border -- two for each partition
at most -- get what lies before them added by a broadcast of that bounded size.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize

_AGGREGATES = {"sum": F.sum, "xor": F.bit_xor}
_ADD = {"sum": lambda a, b: a + b, "xor": lambda a, b: a.bitwiseXOR(b)}


def running_totals(df: DataFrame, keys: list[str], order: list[str], running: dict[str, tuple[str, Column]],
                   totals: dict[str, tuple[str, Column]] | None = None) -> DataFrame:
    """``df`` with, for each ``name: (kind, value)`` of ``running``, the total of ``value`` from
    the group's first row to this one, and for those of ``totals`` that of the whole group.

    ``kind`` is ``sum`` or ``xor`` (of longs, ``bit_xor``).  Null keys form a group of their own; null order
    values come first; rows equal in ``keys`` and ``order`` follow one another in any order.
    The laid-out rows are written once, so that borders stay where they are when an executor is lost.
    """
    totals = totals or {}
    specs = running | totals
    raw = {name: f"__v_{name}" for name in specs}
    laid = (df.withColumns({raw[n]: value for n, (_, value) in specs.items()})
            .repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
            .withColumn("__at", F.monotonically_increasing_id()))
    laid = materialize(laid, "laid").withColumn("__part", F.shiftright("__at", 33))

    # the groups at the two borders of each partition, and what each partition holds of them
    key = F.struct(*keys)
    borders = (laid.groupBy("__part").agg(F.min_by(key, "__at").alias("a"), F.max_by(key, "__at").alias("b"))
               .select("__part", F.explode(F.array_distinct(F.array("a", "b"))).alias("k")))
    borders = borders.select(F.col("__part").alias("__p"), *[F.col(f"k.{k}").alias(f"__k_{k}") for k in keys])
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__k_{k}")) for k in keys],
                  F.col("__part") == F.col("__p"))
    held = (laid.join(F.broadcast(borders), same).groupBy("__p", *[f"__k_{k}" for k in keys])
            .agg(*[_AGGREGATES[kind](raw[n]).alias(f"__h_{n}") for n, (kind, _) in specs.items()]))
    group = Window.partitionBy(*[f"__k_{k}" for k in keys])
    before = group.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    held = held.select("__p", *[f"__k_{k}" for k in keys],
                       *[_AGGREGATES[specs[n][0]](f"__h_{n}").over(before).alias(f"__b_{n}") for n in running],
                       *[_AGGREGATES[specs[n][0]](f"__h_{n}").over(group).alias(f"__t_{n}") for n in totals])

    local = Window.partitionBy("__part", *keys)
    out = laid.withColumns(
        {n: _AGGREGATES[kind](raw[n]).over(local.orderBy("__at").rowsBetween(Window.unboundedPreceding, 0))
         for n, (kind, _) in running.items()}
        | {n: _AGGREGATES[kind](raw[n]).over(local) for n, (kind, _) in totals.items()})
    out = out.join(F.broadcast(held), same, "left").withColumns(
        {n: F.when(F.col(f"__b_{n}").isNull(), F.col(n)).otherwise(_ADD[running[n][0]](F.col(f"__b_{n}"), F.col(n)))
         for n in running}
        | {n: F.coalesce(f"__t_{n}", n) for n in totals})
    return out.select(*df.columns, *specs)
