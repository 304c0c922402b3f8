"""Parsing model replies.

The brace span (first ``{`` .. last ``}``) is cut by position; a code fence
needs no step of its own because the braces delimit the object.
Malformed JSON is caught with a corrupt-record column, so a bad reply marks
its own row as an error and never fails the job.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_CORRUPT = "_corrupt_record"


def json_object_text(col: Column | str) -> Column:
    """The text from the first ``{`` to the last ``}`` ('' when there is none).

    Positions come from ``instr`` on the text and on its reverse, so the cost
    is linear in the reply length (a greedy ``\\{.*\\}`` regex can
    backtrack quadratically on long texts with many ``{`` and no ``}``).
    """
    c = F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))
    first = F.instr(c, "{")
    last_from_end = F.instr(F.reverse(c), "}")
    last = F.length(c) - last_from_end + 1
    ok = (first > 0) & (last_from_end > 0) & (last > first)
    return F.when(ok, F.substring(c, first, last - first + 1)).otherwise(F.lit(""))


def _one_object(txt: Column) -> Column:
    """Whether the text, put into an array (and that into another), is its only element."""
    one = F.lit(True)
    for left, right in (("[", "]"), ("[[", "]]")):
        n = F.json_array_length(F.concat(F.lit(left), txt, F.lit(right)))
        one = one & F.coalesce(n == 1, F.lit(False))
    return one


def extract_json_strict(df: DataFrame, col: str, schema: T.StructType, out: str = "parsed",
                        required: Iterable[str] = ()) -> DataFrame:
    """P10: parse the JSON object inside a reply.

    Adds ``out`` (struct of ``schema``), ``status`` ('ok' / 'error') and
    ``error`` (null, 'no JSON object', 'invalid JSON' or 'missing <field>').
    Single-quoted pseudo-JSON is rejected as Python's parser would, and so is
    anything between the outer braces that is more than one object: ``from_json``
    alone would take the first of two objects.
    """
    full = T.StructType(list(schema.fields) + [T.StructField(_CORRUPT, T.StringType())])
    txt = json_object_text(col)
    parsed = F.from_json(txt, full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _CORRUPT,
                                     "allowSingleQuotes": "false"})
    x = df.withColumn("_txt", txt).withColumn("_p", parsed)
    err = (F.when(F.col("_txt") == "", F.lit("no JSON object"))
            .when(F.col("_p").isNull() | F.col(f"_p.{_CORRUPT}").isNotNull() | ~_one_object(F.col("_txt")),
                  F.lit("invalid JSON")))
    for f in required:
        err = err.when(F.col(f"_p.{f}").isNull(), F.lit(f"missing {f}"))
    x = x.withColumn("error", err)
    ok = F.col("error").isNull()
    return (x.withColumn(out, F.when(ok, F.struct(*[F.col(f"_p.{f.name}").alias(f.name) for f in schema.fields])))
             .withColumn("status", F.when(ok, F.lit("ok")).otherwise(F.lit("error")))
             .drop("_txt", "_p"))


VERDICT_SCHEMA = T.StructType([T.StructField("verdict", T.StringType()), T.StructField("reason", T.StringType())])
TAGS_SCHEMA = T.StructType([T.StructField("linguistic_phenomena", T.ArrayType(T.StringType())),
                            T.StructField("paraphrase_distance", T.StringType()),
                            T.StructField("domain", T.StringType())])
# ratings are read as text and cast with try_cast: from_json maps the string "5" to null for an int field
RATING_SCHEMA = T.StructType([T.StructField("adequacy", T.StringType()), T.StructField("fluency", T.StringType()),
                              T.StructField("note", T.StringType())])


def verdict_to_correct(parsed: Column | str = "parsed") -> tuple[Column, Column, Column]:
    """(verdict, reason default '', correct = verdict == 'correct');
    no verdict -> all null, so the cell stays unjudged."""
    p = F.col(parsed) if isinstance(parsed, str) else parsed
    v = p.getField("verdict")
    return (v.alias("verdict"),
            F.when(v.isNotNull(), F.coalesce(p.getField("reason"), F.lit(""))).alias("reason"),
            F.when(v.isNotNull(), v == F.lit("correct")).alias("correct"))


def parse_judgements(replies: DataFrame, col: str = "reply") -> DataFrame:
    """Judge replies -> verdict / reason / correct, failures isolated per row."""
    x = extract_json_strict(replies, col, VERDICT_SCHEMA, required=("verdict",))
    v, r, c = verdict_to_correct("parsed")
    return x.select(*[k for k in replies.columns if k != col], v, r, c, "status", "error")


def parse_ratings(replies: DataFrame, col: str = "reply") -> DataFrame:
    """Judge ratings {adequacy, fluency, note}; ratings may arrive as text."""
    x = extract_json_strict(replies, col, RATING_SCHEMA)
    return x.select(*[k for k in replies.columns if k != col],
                    F.expr("try_cast(parsed.adequacy AS INT)").alias("adequacy"),
                    F.expr("try_cast(parsed.fluency AS INT)").alias("fluency"),
                    F.col("parsed.note").alias("judge_note"), "status", "error")
