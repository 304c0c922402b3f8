"""Reports updated from changed cells only (S7 with A1, A5-A9, A12, A13).

A stage's results are merged into the next version of their table, which keeps the rows that changed in files of
their own, each with what it was before.  A cube is updated by these rows alone -- the old value out, the new one in --
and the reports roll up from the cube.  Each change is applied under the number of its version, so an update that was
cut off and run again counts once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import EvalConfig
from ..operators.cube import add_cubes, qa_cube
from ..operators.jobs import upsert
from ..operators.reshape import flatten_all
from ..sources.checkpoint import StageStore

_OWN = ("was", "changed")


def write_table(store: StageStore, table: str, rows: DataFrame) -> int:
    """The first version of a table: nothing in it counts as changed."""
    return _write(store, table, rows.withColumn("changed", F.lit(False)), rows.isEmpty())


def _write(store: StageStore, table: str, rows: DataFrame, empty: bool) -> int:
    return store.write(table, rows, None if empty else ["changed"])  # no row, no folder: the schema would be lost


def current(store: StageStore, table: str, version: int | None = None) -> DataFrame:
    """The rows of a version (the newest), without the record of changes."""
    return store.read(table, version).drop(*_OWN)


def upsert_with_changes(store: StageStore, table: str, results: DataFrame, keys: list[str], payload: list[str]) -> int:
    """Merges results into the next version of ``table`` and returns its number.

    ``payload`` are the columns results may change (see :func:`operators.jobs.upsert`).  A row whose payload is another
    one than before, or that is new, is written with ``changed = true`` and its former payload in ``was``."""
    cur = current(store, table)
    merged = upsert(cur.withColumn("was", F.struct(*payload)), results, keys, payload)
    changed = ~F.struct(*payload).eqNullSafe(F.col("was"))
    return _write(store, table, merged.withColumns({"was": F.when(changed, F.col("was")), "changed": changed}),
                  cur.isEmpty() and results.isEmpty())


def changes(store: StageStore, table: str, version: int) -> tuple[DataFrame, DataFrame]:
    """The rows a version changed, as they were (those that were there) and as they are; only their files are read."""
    rows = store.read(table, version).filter(F.col("changed").cast("string") == "true")  # a folder's name is text
    payload = [f.name for f in rows.schema["was"].dataType.fields]
    rest = [c for c in rows.columns if c not in (*payload, *_OWN)]
    before = rows.filter("was IS NOT NULL").select(*rest, *[F.col(f"was.{c}").alias(c) for c in payload])
    return before, rows.select(*rest, *payload)


class CubeTable:
    """A cube kept in a store: a full one, and one small one for each version of changes since."""

    def __init__(self, store: StageStore, name: str):
        self.store, self.name = store, name

    def _log(self) -> str:
        return f"{self.name}__changes/of={self.store.latest(self.name):06d}"

    def start(self, cube: DataFrame) -> None:
        """Writes the full cube anew; former changes no longer count."""
        self.store.write(self.name, cube)

    def _applied(self) -> list[int]:
        return sorted(int(n.split("=")[1]) for n in self.store._children(f"{self.store.root}/{self._log()}")
                      if n.startswith("version=") and self.store.versions(f"{self._log()}/{n}"))

    def apply(self, version: int, before: DataFrame, after: DataFrame, build: Callable[[DataFrame], DataFrame]) -> None:
        """Takes ``before`` out and puts ``after`` in, once for each ``version``.

        ``build`` makes a cube of rows with a column ``sign`` that says how often each counts."""
        if version in self._applied():
            return
        both = before.withColumn("sign", F.lit(-1)).unionByName(after.withColumn("sign", F.lit(1)))
        self.store.write(f"{self._log()}/version={version:06d}", build(both))

    def read(self) -> DataFrame:
        log = self._log()
        return add_cubes(self.store.read(self.name), *[self.store.read(f"{log}/version={v:06d}") for v in self._applied()])

    def compact(self) -> None:
        """Makes the sum the full cube."""
        self.start(self.read())


def apply_cell_changes(cube: CubeTable, table: str, version: int, cfg: EvalConfig) -> None:
    """Brings the QA cube up to ``version`` of the table of cells (denormalised: with lang, dataset and tags)."""
    before, after = (flatten_all(x, None, cfg) for x in changes(cube.store, table, version))
    cube.apply(version, before, after, lambda rows: qa_cube(rows, cfg, "sign"))
