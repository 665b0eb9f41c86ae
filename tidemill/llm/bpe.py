"""Byte-level BPE: overlapping chunks are pre-tokenised apart, stitched, and encoded; decoding.

A pre-token depends only on the text from its start on. So once two pre-tokenisations
of the same text both begin a pre-token at one place, they agree from there on. Long
texts are dealt out as overlapping chunks; a chunk that begins in the middle of a
pre-token falls into step with its predecessor inside the overlap, and the first
place where both begin a pre-token is the seam. Each chunk then encodes the text
between its two seams.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm.common import store
from tidemill.llm.token_counts import balanced
from tidemill.llm.tokens import ByteLevel, per_worker

#: Characters of a chunk, and of what it shares with the next one.
CHUNK, OVERLAP = 65_536, 1_024
#: Bytes of text that a worker takes on at a time.
BATCH_BYTES = 1 << 20

ENCODED = "doc_id long, ids array<int>"
DECODED = "doc_id long, raw binary"
DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
CHUNKS = "row long, doc_id long, chunk long, text string"
MARKED = "row long, doc_id long, chunk long, head array<int>, tail array<int>"
CHUNK_IDS = "row long, doc_id long, chunk long, ids array<int>"


class Codec:
    """Encodes and decodes by a file of ranks; ids are 32-bit numbers."""

    def __init__(self, ranks_path: str, pattern: str):
        import regex
        import tiktoken

        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(t): int(r) for t, r in map(bytes.split, lines)}
        encoding = tiktoken.Encoding(
            "ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}
        )
        self.pattern = regex.compile(pattern)
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.written = {rank: str(rank) for rank in ranks.values()}
        self.parts = ByteLevel(
            lambda piece: array("i", encoding.encode_ordinary(piece)).tobytes(), b"".join
        )

    def encode(self, text: str) -> np.ndarray:
        """Ids of ``text``, word by word; no pre-token goes across a word's end."""
        return np.frombuffer(b"".join(self.parts.parts(text)) if text else b"", np.int32)

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def starts(self, text: str, start: int, end: int) -> list[int]:
        """Places from ``start`` up to ``end`` where a pre-token begins, read from ``start`` on."""
        return [m.start() for m in self.pattern.finditer(text, start) if m.start() < end]


def codec(ranks_path: str, pattern: str) -> Codec:
    """One per worker."""
    return per_worker(("codec", ranks_path, pattern), lambda: Codec(ranks_path, pattern))


def _lists(arrays: list, kind: pa.DataType = pa.int32()) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
    values = np.concatenate(arrays) if arrays else np.zeros(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values, kind))


def _in_blocks(batches: Iterator[pa.RecordBatch], text: int, limit: int) -> Iterator[pa.RecordBatch]:
    """The batches in runs of rows of at most ``limit`` bytes of text, or one row."""
    for batch in batches:
        lengths = pa.compute.binary_length(batch.column(text)).to_numpy(zero_copy_only=False)
        offsets = np.concatenate([[0], np.cumsum(lengths.astype(np.int64))])
        for start, end in balanced(offsets, limit):
            yield batch.slice(start, end - start)


def _encoded(ranks_path: str, pattern: str, names: tuple[str, ...] = ("doc_id",)):
    """The columns ``names`` as they are, and the ids of the text after them."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(ranks_path, pattern)
        for batch in _in_blocks(batches, len(names), BATCH_BYTES):
            ids = [coder.encode(text.as_py()) for text in batch.column(len(names))]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(names)], _lists(ids)], names=[*names, "ids"]
            )

    return encode


def _id_lists(batch: pa.RecordBatch) -> Iterator[list[int]]:
    ids = batch.column(1)
    values = ids.flatten().to_numpy()
    ends = np.cumsum(ids.value_lengths().to_numpy(zero_copy_only=False))
    for start, end in zip([0, *ends.tolist()], ends.tolist(), strict=False):
        yield values[start:end].tolist()


def _decoded(ranks_path: str, pattern: str):
    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(ranks_path, pattern)
        for batch in batches:
            raw = [coder.decode(ids) for ids in _id_lists(batch)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(raw, pa.binary())], names=["doc_id", "raw"]
            )

    return decode


def _digested(ranks_path: str, pattern: str):
    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(ranks_path, pattern)
        for batch in batches:
            rows = [
                (
                    len(ids),
                    hashlib.sha256(",".join(map(coder.written.__getitem__, ids)).encode()).hexdigest(),
                    hashlib.sha256(coder.decode(ids)).hexdigest(),
                )
                for ids in _id_lists(batch)
            ]
            columns = zip(*rows, strict=True) if rows else ([], [], [])
            kinds = (pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return digest


# -- long texts -------------------------------------------------------------


def _cut(chunk: int, overlap: int):
    """Texts as chunks that share ``overlap`` characters with the next: each text is gone through once."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, doc_id, text in zip(*(column.to_pylist() for column in batch.columns), strict=True):
                for number, start in enumerate(range(0, max(len(text), 1), chunk)):
                    yield _chunk_row(row, doc_id, number, text[start : start + chunk + overlap])

    return cut


def _cut_at(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts in parts that begin at the places in the last column."""
    for batch in batches:
        for row, doc_id, text, begin in zip(*(column.to_pylist() for column in batch.columns), strict=True):
            for number, (start, end) in enumerate(zip(begin, [*begin[1:], len(text)], strict=True)):
                yield _chunk_row(row, doc_id, number, text[start:end])


def _chunk_row(row: int, doc_id: int | None, chunk: int, text: str) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
    return pa.RecordBatch.from_arrays(
        [pa.array([v], k) for v, k in zip((row, doc_id, chunk, text), kinds, strict=True)],
        names=["row", "doc_id", "chunk", "text"],
    )


def _marked(ranks_path: str, pattern: str, chunk: int, overlap: int):
    """Where pre-tokens begin in a chunk's head and in its tail, as offsets into the overlap."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(ranks_path, pattern)
        for batch in batches:
            heads, tails = [], []
            for text in batch.column(3).to_pylist():
                # what begins in the last place may go on beyond the chunk
                heads.append(coder.starts(text, 0, overlap)[: -1 if len(text) <= overlap else None])
                tail = coder.starts(text, 0, len(text)) if len(text) > chunk else []
                # no seam after white space, whose pre-token looks at what follows
                tails.append(
                    [s - chunk for s in tail[:-1] if s >= chunk and not text[s - 1].isspace()]
                )
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(heads, pa.list_(pa.int32())),
                 pa.array(tails, pa.list_(pa.int32()))],
                names=["row", "doc_id", "chunk", "head", "tail"],
            )

    return mark


def seams(marked: DataFrame) -> DataFrame:
    """row, chunk, and the seam to the chunk before it, as an offset into the chunk (0 for the first).

    A chunk whose overlap has no common place has the seam null: a pre-token longer
    than the overlap covers it.
    """
    before = marked.select(
        "row", (F.col("chunk") + 1).alias("chunk"), F.col("tail").alias("tail_before")
    )
    common = F.array_min(F.array_intersect("head", "tail_before"))
    return marked.join(before, ["row", "chunk"], "left").select(
        "row", "chunk", F.when(F.col("chunk") == 0, 0).otherwise(common).alias("seam")
    )


def _joined(key: tuple, rows: pa.Table) -> pa.Table:
    """The ids of one text's parts, in turn."""
    ids = rows.sort_by("chunk").column("ids").combine_chunks().flatten()
    return pa.table(
        {
            "doc_id": rows.column("doc_id").slice(0, 1),
            "ids": pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids),
        }
    )


def encode_long(
    docs: DataFrame, ranks_path: str, pattern: str, chunk: int = CHUNK, overlap: int = OVERLAP
) -> DataFrame:
    """``encode_documents`` for texts longer than a chunk: their chunks are encoded apart from each other."""
    docs = store(docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text"), "long-texts")
    cut = docs.mapInArrow(_cut(chunk, overlap), CHUNKS).repartition("row", "chunk")
    joints = store(seams(cut.mapInArrow(_marked(ranks_path, pattern, chunk, overlap), MARKED)), "seams")
    # a chunk with no seam is no beginning: the chunk before it goes on to the next seam
    begins = joints.where("seam is not null").groupBy("row").agg(
        F.sort_array(F.collect_list(F.col("chunk") * chunk + F.col("seam"))).alias("begin")
    )
    parts = (
        docs.join(begins, "row").select("row", "doc_id", "text", "begin")
        .mapInArrow(_cut_at, CHUNKS).repartition("row", "chunk")
    )
    ids = parts.mapInArrow(_encoded(ranks_path, pattern, ("row", "doc_id", "chunk")), CHUNK_IDS)
    return ids.groupBy("row").applyInArrow(_joined, ENCODED)


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("text"), F.lit("")).alias("text"),
    )


def encode_documents(
    docs: DataFrame, ranks_path: str, pattern: str, chunk: int = CHUNK, overlap: int = OVERLAP
) -> DataFrame:
    """doc_id and ids of every row's whole text.

    Texts of up to ``chunk`` characters are encoded where they are. Longer ones are
    chunked. A null or empty text has no ids. Rows that repeat an id, and rows without
    one, are encoded each by itself; other columns are not read.
    """
    texts, is_long = _texts(docs), F.length("text") > chunk
    short = texts.where(~is_long).mapInArrow(_encoded(ranks_path, pattern), ENCODED)
    return short.union(encode_long(texts.where(is_long), ranks_path, pattern, chunk, overlap))


def decode_documents(encoded: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id and the raw bytes of every row of ids (doc_id, ids); those of a null list are none.

    An id that the file lacks raises.
    """
    chosen = encoded.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("ids"), F.array().cast("array<int>")).alias("ids"),
    )
    return chosen.mapInArrow(_decoded(ranks_path, pattern), DECODED)


def token_digests(encoded: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """Number of ids, SHA-256 of them in decimals joined by commas, and SHA-256 of the decoded bytes."""
    return encoded.select("doc_id", "ids").mapInArrow(_digested(ranks_path, pattern), DIGESTS)


def encode_all(
    docs: DataFrame, ranks_path: str, pattern: str, chunk: int = CHUNK, overlap: int = OVERLAP
) -> DataFrame:
    """``token_digests`` of ``encode_documents``; ids of texts that aren't chunked stay in their worker."""
    texts, is_long = _texts(docs), F.length("text") > chunk
    encode, digest = _encoded(ranks_path, pattern), _digested(ranks_path, pattern)
    short = texts.where(~is_long).mapInArrow(lambda batches: digest(encode(batches)), DIGESTS)
    long = encode_long(texts.where(is_long), ranks_path, pattern, chunk, overlap)
    return short.union(token_digests(long, ranks_path, pattern))
