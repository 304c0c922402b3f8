"""Token counts: batch encoding in Arrow functions that return lengths only.

Batches are balanced by bytes, and texts are split at boundaries where the
tokenizer always cuts; a very long text is encoded piece by piece (with a sentencepiece
model, whole).  No shuffle: rows stay in their partitions.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from ..session import ship_package
from .common import byte_slices, texts_of, worker_state
from .tokens import ENCODE_BYTES, encoder, tokenizer_path


def count_tokens(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", limit: int = 512) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` for every row of ``docs``.

    ``n_tokens`` is what the tokenizers library (``.json``) or sentencepiece
    (``.model``) gives for the whole text without begin, end or added special
    tokens.  Null and empty texts count 0 bytes and 0 tokens.  Repeated rows
    and rows with equal or null ids are counted each for itself; an empty table
    gives no rows; other columns are not read."""
    ship_package(docs.sparkSession)

    def lengths(texts: list[str | None]) -> list[int]:
        if tokenizer.endswith(".model"):
            return _sentencepiece(tokenizer, texts)
        return encoder(tokenizer_path(tokenizer)).lengths(texts).tolist()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in byte_slices(whole, "text", ENCODE_BYTES):
                n = pa.array(lengths(texts_of(batch)), pa.int64())
                size = pc.fill_null(pc.cast(pc.binary_length(batch.column(1)), pa.int64()), 0)
                yield pa.RecordBatch.from_arrays([batch.column(0), size, n, pc.greater(n, limit)],
                                                 names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return (docs.select("doc_id", "text")
            .mapInArrow(count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean"))


def _sentencepiece(name: str, texts: list[str | None]) -> list[int]:
    import sentencepiece
    model = worker_state("sentencepiece", name, lambda: sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(name)))
    return [len(x) for x in model.encode([t or "" for t in texts], num_threads=1)]
