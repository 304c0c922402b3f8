"""Report sinks."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_inspection(slim: DataFrame, path: str, models: Iterable[str] = (), by: Iterable[str] = (), bucket: str = "bucket",
                     mode: str = "errorifexists") -> DataFrame:
    """Inspection records under ``path/items``, partitioned by bucket (one
    directory per bucket, many files -- never one giant array), and their summary
    under ``path/summary``: counts per bucket (and the columns ``by``) with the
    list of models.  Returns the summary, counted from what was written."""
    slim.write.mode(mode).partitionBy(bucket).json(f"{path}/items")
    written = slim.sparkSession.read.schema(slim.schema).json(f"{path}/items")
    names = F.array(*map(F.lit, models)).cast("array<string>")
    summary = written.groupBy(bucket, *by).agg(F.count(F.lit(1)).alias("n")).withColumn("models", names)
    summary.write.mode(mode).json(f"{path}/summary")
    return slim.sparkSession.read.schema(summary.schema).json(f"{path}/summary")


def report_long(df: DataFrame, section: str, key_cols: list[str], value_cols: list[str] | None = None,
                sep: str = "|") -> DataFrame:
    """One report as long rows (section, row_key, column, value)."""
    vals = value_cols or [c for c in df.columns if c not in key_cols]
    x = df.select(F.concat_ws(sep, *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in key_cols]).alias("row_key"),
                  *[F.col(v).cast("double").alias(v) for v in vals])
    return x.unpivot("row_key", vals, "column", "value").select(F.lit(section).alias("section"), "row_key",
                                                               "column", "value")


def report_tables(reports: dict[str, tuple[DataFrame, list[str]]]) -> DataFrame:
    """All reports of a run in one long table (write it as CSV/Parquet)."""
    parts = [report_long(df, name, keys) for name, (df, keys) in reports.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
