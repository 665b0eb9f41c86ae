"""Token counts of whole texts: encoding in Arrow batches that give lengths back only."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm.tokens import Memo, per_worker, words

#: Bytes of text that a worker takes on at a time.
BATCH_BYTES = 4 << 20
COUNTS = "doc_id long, n_bytes long, n_tokens long"

def piece_lengths(model_path: str) -> Memo:
    """Lengths of pieces by the model's library; one per worker."""

    def make() -> Memo:
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=model_path)
        return Memo(lambda piece: len(model.encode(piece)))

    return per_worker(("piece_lengths", model_path), make)


def balanced(offsets, limit: int) -> Iterator[tuple[int, int]]:
    """Runs of rows with at most ``limit`` bytes, or one row: offsets are where rows begin."""
    start = 0
    for row in range(1, len(offsets)):
        if row > start + 1 and offsets[row] - offsets[start] > limit:
            yield start, row - 1
            start = row - 1
    if start < len(offsets) - 1:
        yield start, len(offsets) - 1


def _counted(model_path: str, batch_bytes: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        lengths = piece_lengths(model_path)
        for batch in batches:
            text = batch.column(1).cast(pa.large_string())
            n_bytes = pa.compute.binary_length(text).to_numpy(zero_copy_only=False)
            offsets = np.concatenate([[0], np.cumsum(n_bytes)])
            for start, end in balanced(offsets, batch_bytes):
                # a text is cut before single spaces, so a long one is many short pieces
                counts = [
                    sum(map(lengths.__getitem__, words(t))) if t else 0
                    for t in text.slice(start, end - start).to_pylist()
                ]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(start, end - start),
                        pa.array(n_bytes[start:end], pa.int64()),
                        pa.array(counts, pa.int64()),
                    ],
                    names=["doc_id", "n_bytes", "n_tokens"],
                )

    return count


def token_counts(docs: DataFrame, model_path: str, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """doc_id, n_bytes and n_tokens of every row, in the partitions of ``docs``.

    A null or empty text has no bytes and no tokens. Repeated rows and rows without
    an id are counted like any other; other columns are not read. Each part between
    single spaces is counted by itself, because the model's pieces hold a space only
    at their start or as a run of spaces.
    """
    chosen = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("text"), F.lit("")).alias("text"),
    )
    return chosen.mapInArrow(_counted(model_path, batch_bytes), COUNTS)
