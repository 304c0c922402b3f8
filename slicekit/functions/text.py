"""Column-level text helpers that keep Python's string semantics on the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the characters Python's ``str.isspace`` treats as whitespace.
# Written with \x{..} escapes, a syntax both Java regex and RE2 (DuckDB) accept,
# so the engine and the SQL oracle strip exactly the same characters.
PY_SPACE_CLASS = (r"[\x{9}-\x{D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
                  r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]")
STRIP_RE = f"^{PY_SPACE_CLASS}+|{PY_SPACE_CLASS}+$"
SPACE_RUN_RE = f"{PY_SPACE_CLASS}+"


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def ustrip(col: Column | str) -> Column:
    """``str.strip()``: remove leading/trailing Unicode whitespace (``trim`` only drops spaces)."""
    return F.regexp_replace(_c(col), STRIP_RE, "")


def remove_whitespace(col: Column | str) -> Column:
    """``''.join(s.split())``: drop every whitespace character."""
    return F.regexp_replace(_c(col), SPACE_RUN_RE, "")


def is_blank(col: Column | str) -> Column:
    """True for null or whitespace-only text (Python: ``not s.strip()``)."""
    return F.coalesce(F.length(ustrip(col)) == 0, F.lit(True))


def sql_ustrip(expr: str) -> str:
    """The oracle's spelling of :func:`ustrip`."""
    return f"regexp_replace({expr}, '{STRIP_RE}', '', 'g')"


def sql_remove_whitespace(expr: str) -> str:
    return f"regexp_replace({expr}, '{SPACE_RUN_RE}', '', 'g')"
