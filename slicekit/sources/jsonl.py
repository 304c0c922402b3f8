"""JSON sources and sinks."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def read_items_jsonl(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Records, one JSON object per line, with an explicit schema.

    A missing path gives an empty frame of ``schema``; blank lines are
    skipped; a malformed line fails the job (FAILFAST), as in the reference.
    """
    try:
        return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e) or "Path does not exist" in str(e):
            st = schema if isinstance(schema, T.StructType) else T._parse_datatype_string(schema)
            return spark.createDataFrame([], st)
        raise


def read_json_array(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """A document holding one JSON array of records (not splittable:
    each file is read by one task, so keep such files moderate)."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def write_items_jsonl(df: DataFrame, path: str, mode: str = "errorifexists") -> str:
    """UTF-8 JSON lines; null (absent) fields are omitted, non-ASCII kept."""
    df.write.mode(mode).option("ignoreNullFields", "true").option("compression", "none").json(path)
    return path
