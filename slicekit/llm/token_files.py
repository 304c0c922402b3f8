"""Token-id files: documents encoded in doc_id order and stored as directly
addressable codes (see ``dac``), and the reader of those files.

The files are a table of segments -- ``part, seg`` (their order), the segment's
first token counted from its part's start, the doc_ids and the start of every
document inside the segment, and the code as one binary --
written by Spark's own writer, so that the commit protocol covers lost
executors and any shared store holds them.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path, ship_package
from . import dac
from .common import byte_slices, texts_of
from .tokens import ENCODE_BYTES, encoder, tokenizer_path

SEGMENT_TOKENS = 1 << 19
_SCHEMA = "part int, seg int, first long, n_tokens long, doc_ids array<long>, starts array<long>, code binary"


def write_token_files(docs: DataFrame, path: str, tokenizer: str = "word_bpe_49k.json", end_id: int = 1,
                      segment_tokens: int = SEGMENT_TOKENS) -> None:
    """Encode ``docs(doc_id, text)`` in ascending doc_id order into segment files at ``path``.

    One shuffle: texts are dealt by ranges of doc_id and sorted, then encoded
    and coded in the same task.  A segment holds whole documents and ends once
    it has ``segment_tokens`` ids.  Null text is encoded as an empty one (the
    end id alone).  Null ids come first, equal ids in the order of their
    texts; repeated rows are all written.  An empty table writes no segment."""
    ship_package(docs.sparkSession)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seg = TaskContext.get().partitionId(), 0
        ids: list[int | None] = []
        runs: list[np.ndarray] = []
        lens: list[int] = []
        held = before = 0

        def segment() -> pa.RecordBatch:
            n = np.array(lens, np.int64)
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([seg], pa.int32()), pa.array([before], pa.int64()),
                 pa.array([held], pa.int64()),
                 pa.array([ids], pa.list_(pa.int64())), pa.array([(np.cumsum(n) - n).tolist()], pa.list_(pa.int64())),
                 pa.array([dac.encode(np.concatenate(runs))], pa.binary())],
                names=["part", "seg", "first", "n_tokens", "doc_ids", "starts", "code"])

        for whole in batches:
            for batch in byte_slices(whole, "text", ENCODE_BYTES):
                flat, per = encoder(tokenizer_path(tokenizer)).ids(texts_of(batch))
                ends = np.cumsum(per)
                for doc, a, b in zip(batch.column(0).to_pylist(), (ends - per).tolist(), ends.tolist(), strict=True):
                    runs += [flat[a:b], np.array([end_id], np.uint32)]
                    ids.append(doc)
                    lens.append(b - a + 1)
                    held += lens[-1]
                    if held >= segment_tokens:
                        yield segment()
                        seg, before, held = seg + 1, before + held, 0
                        ids, runs, lens = [], [], []
        if ids:
            yield segment()

    (docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
     .mapInArrow(code, _SCHEMA).write.option("compression", "zstd").parquet(path))


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """Per document of the files at ``path``, read through the codes:
    ``doc_id, start, n_tokens, ids_crc32``."""
    files = spark.read.schema(_SCHEMA).parquet(path)
    # one number for each partition of the writer
    totals = dict(files.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect())
    base, at = {}, 0
    for part in sorted(totals):
        base[part], at = at, at + totals[part]
    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):  # one segment at a time
                row = batch.slice(i, 1).to_pylist()[0]
                code, first = dac.Reader(row["code"]), base[row["part"]] + row["first"]
                ends = [*row["starts"][1:], len(code)]
                crc = [zlib.crc32(code.slice(a, b).astype("<u4").tobytes()) for a, b in zip(row["starts"], ends, strict=True)]
                starts = np.array(row["starts"], np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row["doc_ids"], pa.int64()), pa.array(starts + first),
                     pa.array(np.array(ends, np.int64) - starts), pa.array(crc, pa.int64())],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return files.mapInArrow(decode, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_file_digest(docs: DataFrame, **how) -> DataFrame:
    """Write the files to a fresh path under the shared folder and read them back."""
    path = scratch_path(docs.sparkSession, "token-files")
    write_token_files(docs, path, **how)
    return read_token_files(docs.sparkSession, path)
