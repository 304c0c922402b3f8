"""Corpus tables (S3): columnar reads with pruning and pushed-down filters."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession


def read_corpus(spark: SparkSession, path: str, columns: Iterable[str], where: Column | None = None) -> DataFrame:
    """Read only ``columns`` of a Parquet corpus split; ``where`` reaches the
    scan as pushed filters (row groups are skipped by their statistics)."""
    df = spark.read.parquet(path).select(*list(columns))
    return df.filter(where) if where is not None else df
