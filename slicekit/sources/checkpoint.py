"""Versioned stage tables.

Each write of a stage goes to a *new* directory ``<root>/<stage>/v=<n>``;
a version is visible once its ``_SUCCESS`` marker exists, and readers take
the newest visible version.  Nothing is ever overwritten while it may be
read, so a crashed run resumes from the last complete version and a lost
executor only re-runs tasks of the current write.  ``reset`` hides the
existing versions instead of deleting them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..session import checkpoint_root


class StageStore:
    def __init__(self, spark: SparkSession, root: str | None = None, fmt: str = "parquet"):
        self.spark = spark
        self.root = (root or f"{checkpoint_root(spark)}/stages").rstrip("/")
        self.fmt = fmt

    # -- filesystem (Hadoop FileSystem of the session, so any shared store works)
    def _path(self, p: str):
        jvm = self.spark.sparkContext._jvm
        return jvm.org.apache.hadoop.fs.Path(p)

    def _fs(self, p: str):
        return self._path(p).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _exists(self, p: str) -> bool:
        return bool(self._fs(p).exists(self._path(p)))

    def _children(self, p: str) -> list[str]:
        if not self._exists(p):
            return []
        return [s.getPath().getName() for s in self._fs(p).listStatus(self._path(p))]

    # -- versions
    def versions(self, stage: str) -> list[int]:
        base = f"{self.root}/{stage}"
        floor = self._reset_floor(stage)
        out = []
        for name in self._children(base):
            if name.startswith("v=") and self._exists(f"{base}/{name}/_SUCCESS"):
                v = int(name[2:])
                if v > floor:
                    out.append(v)
        return sorted(out)

    def _reset_floor(self, stage: str) -> int:
        marks = [int(n[len("reset="):]) for n in self._children(f"{self.root}/{stage}") if n.startswith("reset=")]
        return max(marks) if marks else 0

    def latest(self, stage: str) -> int | None:
        v = self.versions(stage)
        return v[-1] if v else None

    def path(self, stage: str, version: int) -> str:
        return f"{self.root}/{stage}/v={version:06d}"

    def read(self, stage: str, version: int | None = None) -> DataFrame | None:
        v = version if version is not None else self.latest(stage)
        if v is None:
            return None
        return self.spark.read.format(self.fmt).load(self.path(stage, v))

    def next_version(self, stage: str) -> int:
        """The number the next version gets."""
        names = [n for n in self._children(f"{self.root}/{stage}") if n.startswith(("v=", "reset="))]
        return max((int(n.split("=", 1)[1]) for n in names), default=0) + 1

    def write(self, stage: str, df: DataFrame, partition_by: list[str] | None = None) -> int:
        """Write ``df`` as the next version and return its number."""
        v = self.next_version(stage)
        w = df.write.format(self.fmt).mode("errorifexists")
        if partition_by:
            w = w.partitionBy(*partition_by)
        w.save(self.path(stage, v))
        return v

    def reset(self, stage: str) -> None:
        """Start afresh: hide every existing version (nothing is deleted)."""
        cur = [int(n.split("=", 1)[1]) for n in self._children(f"{self.root}/{stage}")
               if n.startswith(("v=", "reset="))]
        mark = f"{self.root}/{stage}/reset={(max(cur) if cur else 0) + 1:06d}"
        self._fs(mark).mkdirs(self._path(mark))
