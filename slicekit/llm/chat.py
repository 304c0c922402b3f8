"""Chat formatting by prefix-target expansion.

Every turn becomes a segment of its conversation's formatted text, and every
assistant turn an example of its own, written out: all segments before it are its
context, and its reply alone is trainable.  ``format_conversations`` writes each
segment once for every example that holds it, so a reply is the target of one
example and untrained context of all later ones.  The output grows with the square
of a conversation's length, as the method has it; a segment goes to its examples by
itself (their numbers are a range), so segments of one conversation are expanded by
many tasks, and nothing larger than a segment is a row.  Turns behind the last
reply are in no example; they are written once, outside every mask.

The template of a turn is ``<turn ROLE>``, a line end, the text, a line end, ``</turn>``
and a line end.  Marks of the template stand at the start of a line.  In a text, a
string that looks like a mark (``<turn`` or ``</turn``) gets a backslash more in front
of those it has; in a role, which fills the first line, a backslash is doubled and
a line end written ``\\n``.  ``parse_segments`` undoes both.

Rows without a text or role count as empty ones.  Turns are ordered by ``turn``
(null first), then role and text; repeated rows are repeated turns.  Rows without
conv_id form one conversation without an id.  Other columns are left out.
Positions count code points.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ordering import running_totals
from ..session import materialize, ship_package
from .digest import ordered_digests

OPEN, CLOSE = "<turn ", "</turn>"
TRAINED_ROLE = "assistant"

# a run of backslashes (perhaps none) before something that looks like a mark; starts at
# the run's first one and never goes back, so it is linear on long runs
_MARK = r"(?<!\\)(\\*+</?turn)"
_ESCAPED_MARK = r"(?<!\\)\\(\\*+</?turn)"


def escape_text(text: Column) -> Column:
    return F.regexp_replace(text, _MARK, r"\\$1")


def unescape_text(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPED_MARK, "$1")


def escape_role(role: Column) -> Column:
    return F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n"))


def unescape_role(role: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(role, r"(?<!\\)((?:\\\\)*+)\\n", "$1\n"), r"\\\\", r"\\")


def place_turns(turns: DataFrame, trained_role: str = TRAINED_ROLE) -> DataFrame:
    """``conv_id, seq, start, segment, example, loss_start, loss_end, first_example, n_examples``: one row a turn, in
    conversation order from 0.

    ``start`` is the segment's place in the formatted conversation.  A turn of ``trained_role`` is the target of
    example number ``example`` (from 0): context ``[0, start)``, trainable ``[loss_start, loss_end)``; null for other turns.
    The segment is in the examples from ``first_example`` to the last of the conversation's ``n_examples``.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = turns.select("conv_id", "turn", role.alias("role"), text.alias("text"))
    head = F.concat(F.lit(OPEN), escape_role(F.col("role")), F.lit(">\n"))
    escaped = escape_text(F.col("text"))
    rows = rows.select("conv_id", "turn", "role", "text", F.char_length(head).cast("long").alias("head"),
                       F.char_length(escaped).cast("long").alias("body"),
                       F.concat(head, escaped, F.lit(f"\n{CLOSE}\n")).alias("segment"),
                       (F.col("role") == F.lit(trained_role)).alias("trained"))
    length, is_target = F.char_length("segment").cast("long"), F.col("trained").cast("long")
    placed = running_totals(rows, ["conv_id"], ["turn", "role", "text"],
                            {"seq": ("sum", F.lit(1).cast("long")), "end": ("sum", length), "example": ("sum", is_target)},
                            {"n_examples": ("sum", is_target)})
    start = F.col("end") - length
    own = lambda c: F.when(F.col("trained"), c)
    return placed.select("conv_id", (F.col("seq") - 1).alias("seq"), start.alias("start"), "segment",
                         own(F.col("example") - 1).alias("example"), own(start + F.col("head")).alias("loss_start"),
                         own(start + F.col("head") + F.col("body")).alias("loss_end"),
                         (F.col("example") - is_target).alias("first_example"), "n_examples")


def format_conversations(turns: DataFrame, trained_role: str = TRAINED_ROLE) -> DataFrame:
    """``conv_id, example, seq, start, segment, loss_start, loss_end, final``: all examples written out, one row for each
    segment of each example, and one without ``example`` for each turn behind the last reply.

    Loss places are those in the example's text, at its target alone.  ``final`` marks the rows of a conversation's last
    example and those without one: together they hold every turn once.
    """
    # long conversations grow most: their segments are spread, whatever the ranges of ``place_turns`` hold
    return _expanded(place_turns(turns, trained_role).repartition("conv_id", "seq"))


def _expanded(placed: DataFrame) -> DataFrame:
    in_some = F.col("first_example") < F.col("n_examples")
    numbers = F.when(in_some, F.sequence(F.col("first_example"), F.col("n_examples") - 1))
    wide = placed.withColumnRenamed("example", "target_of").select("*", F.explode_outer(numbers).alias("example"))
    own = lambda c: F.when(F.col("example") == F.col("target_of"), F.col(c)).alias(c)
    return wide.select("conv_id", "example", "seq", "start", "segment", own("loss_start"), own("loss_end"),
                       (F.col("example").isNull() | (F.col("example") == F.col("n_examples") - 1)).alias("final"))


def write_examples(turns: DataFrame, path: str | None = None, trained_role: str = TRAINED_ROLE) -> DataFrame:
    """Writes ``format_conversations`` (to a fresh folder of the shared store, without a path) and reads it back."""
    return _written(turns, format_conversations(turns, trained_role), path)


def write_formatted(turns: DataFrame, path: str | None = None, trained_role: str = TRAINED_ROLE) -> DataFrame:
    """Writes the formatted conversations of ``place_turns``, each text once, and reads them back."""
    return _written(turns, place_turns(turns, trained_role), path)


def _written(turns: DataFrame, rows: DataFrame, path: str | None) -> DataFrame:
    ship_package(turns.sparkSession)
    if path is None:
        return materialize(rows, "chat")
    rows.write.mode("errorifexists").parquet(path)
    return turns.sparkSession.read.parquet(path)


def examples(formatted: DataFrame) -> DataFrame:
    """``conv_id, example, target_seq, context_chars, loss_start, loss_end``: one row an assistant turn."""
    return formatted.filter("example IS NOT NULL").select(
        "conv_id", "example", F.col("seq").alias("target_seq"), F.col("start").alias("context_chars"), "loss_start", "loss_end")


def expand_examples(formatted: DataFrame, chosen: DataFrame | None = None) -> DataFrame:
    """Examples of ``write_formatted`` written out: ``conv_id, example, seq, segment, loss_start, loss_end``, one row for
    each segment of each example (all of ``examples``, or the chosen ones), with loss places in the example's text where
    the segment is the target.
    """
    out = ["conv_id", "example", "seq", "segment", "loss_start", "loss_end"]
    if chosen is None:
        return _expanded(formatted).filter("example IS NOT NULL").select(out)
    wanted = chosen.select(F.col("conv_id").alias("c"), F.col("example").alias("e"), "target_seq")
    seg = formatted.drop("example")
    at = F.col("seq") == F.col("target_seq")
    return (seg.join(wanted, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("seq") <= F.col("target_seq")))
            .select("conv_id", F.col("e").alias("example"), "seq", "segment",
                    F.when(at, F.col("loss_start")).alias("loss_start"), F.when(at, F.col("loss_end")).alias("loss_end")))


def parse_segments(formatted: DataFrame) -> DataFrame:
    """``formatted`` with the role and text its segments hold, and ``loss_text``: what the mask covers, unescaped."""
    first_line = F.substring_index("segment", "\n", 1)
    role = first_line.substr(F.lit(len(OPEN) + 1), F.char_length(first_line) - len(OPEN) - 1)
    inner = F.col("segment").substr(F.char_length(first_line) + 2,
                                    F.char_length("segment") - F.char_length(first_line) - len(CLOSE) - 3)
    masked = F.col("segment").substr((F.col("loss_start") - F.col("start") + 1).cast("int"),
                                     (F.col("loss_end") - F.col("loss_start")).cast("int"))
    return formatted.withColumns({"role": unescape_role(role), "text": unescape_text(inner), "loss_text": unescape_text(masked)})


def conversation_digest(formatted: DataFrame) -> DataFrame:
    """Per conversation, from the rows of ``write_examples`` or ``write_formatted`` alone: counts and digests of its turns
    (of written-out examples: as the last one and the rows behind it hold them) and of the text under each example's mask."""
    turn = F.col("final") if "final" in formatted.columns else F.lit(True)
    parsed = parse_segments(formatted.filter(turn | F.col("loss_start").isNotNull())).select(
        "conv_id", "seq", F.when(turn, F.concat("role", F.lit("\n"), "text", F.lit("\n"))).alias("turn_piece"), "loss_text",
        F.when(turn, F.char_length("segment").cast("long")).alias("chars"), F.char_length("loss_text").cast("long").alias("loss"))
    counts = parsed.groupBy("conv_id").agg(
        F.count("chars").alias("n_turns"), F.coalesce(F.sum("loss"), F.lit(0)).alias("loss_chars"),
        F.sum("chars").alias("formatted_chars"), F.count("loss").alias("n_examples"))
    hashes = ordered_digests(parsed, ["conv_id"], ["seq"], {"turns_sha256": "turn_piece", "loss_sha256": "loss_text"})
    return counts.alias("n").join(hashes.alias("h"), F.col("n.conv_id").eqNullSafe(F.col("h.conv_id"))).select(
        "n.conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_examples")
