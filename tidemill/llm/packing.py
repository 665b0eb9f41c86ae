"""Hierarchical packing: tiers of window sizes, long windows filled up from shorter tiers.

Each document gives its full longest windows; what is left is routed to the tier of
the smallest window that holds it. Tiers are packed from the longest down: a window
begins with a document of its own tier, and its gap is filled with the longest
documents that fit, of its own tier or shorter ones; where none fits, one is cut.
So every window is full. Windows of one size are then dealt into step groups that
hold as many tokens and about the same attention work. Every task packs the rows it
reads, a bounded number of tokens at a time; nothing is shuffled.
"""

from __future__ import annotations

import sys
import zlib
from array import array
from bisect import bisect_right, insort
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm.tokens import ByteLevel, per_worker

#: Window sizes, powers of two, longest first.
TIERS = (1024, 512, 256, 128)
#: Token ids that end a document.
END = (0).to_bytes(4, "little")
#: Tokens that are packed together.
PACK_TOKENS = 2_000_000
#: Tokens of a step group.
STEP_TOKENS = 16_384

PIECES = pa.schema(
    [("doc_id", pa.int64()), *((name, pa.int64()) for name in (
        "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "tier", "step_group",
    ))]
)
PIECES_DDL = ", ".join(f"{f.name} long" for f in PIECES)
PIECE_IDS = pa.field("ids", pa.list_(pa.int32()))


def byte_letters() -> dict[int, str]:
    """The letter by which byte-level vocabularies write each byte.

    Printable bytes are themselves, the others follow from 256 on.
    """
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


def id_bytes(tokenizer_path: str) -> ByteLevel:
    """Little-endian 32-bit ids of texts by the tokenizer's library; one per worker."""

    def packed(ids: list[int]) -> bytes:
        packed = array("I", ids)
        if sys.byteorder == "big":
            packed.byteswap()
        return packed.tobytes()

    def make() -> ByteLevel:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(tokenizer_path)
        model, letters = tokenizer.model, byte_letters()

        def encode(piece: str) -> bytes:
            return packed(tokenizer.encode(piece, add_special_tokens=False).ids)

        def encode_word(word: str) -> bytes:
            """The model alone, for what needs no pre-tokenising."""
            written = word.encode().decode("latin-1").translate(letters)
            return packed([token.id for token in model.tokenize(written)])

        return ByteLevel(encode, b"".join, encode_word)

    return per_worker(("id_bytes", tokenizer_path), make)


@dataclass
class Window:
    """A sequence: pieces of (document, start, length)."""

    size: int
    parts: list[tuple[int, int, int]] = field(default_factory=list)

    def work(self) -> int:
        return sum(length * length for _, _, length in self.parts)


class Pool:
    """Rests of documents by length; the longest that fits comes first."""

    def __init__(self):
        self.lengths: list[int] = []
        self.rests: dict[int, list[tuple[int, int]]] = {}

    def add(self, length: int, doc: int, start: int) -> None:
        if length not in self.rests:
            insort(self.lengths, length)
            self.rests[length] = []
        self.rests[length].append((doc, start))

    def take(self, most: int) -> tuple[int, int, int] | None:
        """The longest rest of up to ``most`` tokens: (document, start, length)."""
        at = bisect_right(self.lengths, most)
        if not at:
            return None
        length = self.lengths[at - 1]
        doc, start = self.rests[length].pop()
        if not self.rests[length]:
            del self.rests[length], self.lengths[at - 1]
        return doc, start, length

    def shortest(self) -> int | None:
        return self.lengths[0] if self.lengths else None


def pack(sizes: list[int], tiers: tuple[int, ...] = TIERS) -> list[Window]:
    """Windows for documents of these many tokens; every token is in exactly one of them.

    All windows are full but those of the last rest, whose sizes are powers of two.
    """
    windows: list[Window] = []
    longest, pool = tiers[0], Pool()
    for doc, size in enumerate(sizes):
        full = size // longest * longest
        windows += [Window(longest, [(doc, at, longest)]) for at in range(0, full, longest)]
        if size > full:
            pool.add(size - full, doc, full)
    for tier, shorter in zip(tiers, [*tiers[1:], 0], strict=True):
        while pool.lengths and pool.lengths[-1] > shorter:
            window, gap = Window(tier), tier
            while gap and pool.lengths:
                doc, start, length = pool.take(gap) or pool.take(pool.shortest())
                part = min(length, gap)
                window.parts.append((doc, start, part))
                gap -= part
                if length > part:
                    pool.add(length - part, doc, start + part)
            windows += [window] if not gap else _powers(window.parts, tier - gap)
    return windows


def _powers(parts: list[tuple[int, int, int]], total: int) -> list[Window]:
    """The parts again, cut into windows whose sizes are powers of two."""
    windows, rest = [], list(reversed(parts))
    while total:
        window = Window(1 << (total.bit_length() - 1))
        gap = window.size
        while gap:
            doc, start, length = rest.pop()
            part = min(length, gap)
            window.parts.append((doc, start, part))
            gap -= part
            if length > part:
                rest.append((doc, start + part, length - part))
        windows.append(window)
        total -= window.size
    return windows


def step_groups(windows: list[Window], step_tokens: int = STEP_TOKENS) -> list[int]:
    """The step group of each window: windows of one size, dealt to and fro by falling work."""
    groups, first = [0] * len(windows), 0
    for size in sorted({w.size for w in windows}, reverse=True):
        own = sorted(
            (i for i, w in enumerate(windows) if w.size == size), key=lambda i: -windows[i].work()
        )
        n = -(-len(own) * size // step_tokens)
        for rank, i in enumerate(own):
            turn, place = divmod(rank, n)
            groups[i] = first + (n - 1 - place if turn % 2 else place)
        first += n
    return groups


def _packed(
    tokenizer_path: str, tiers: tuple[int, ...], pack_tokens: int, step_tokens: int, with_ids: bool
):
    schema = PIECES.append(PIECE_IDS) if with_ids else PIECES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts_of = id_bytes(tokenizer_path).parts
        # sequences and step groups are numbered within the partition
        sequence = group = TaskContext.get().partitionId() << 33
        docs: list[tuple[int | None, bytes]] = []
        held = 0

        def out() -> pa.RecordBatch:
            nonlocal sequence, group
            windows = pack([len(ids) // 4 for _, ids in docs], tiers)
            steps = step_groups(windows, step_tokens)
            rows, cut = [], []
            for window, step in zip(windows, steps, strict=True):
                offset = 0
                for doc, start, length in window.parts:
                    doc_id, ids = docs[doc]
                    own = memoryview(ids)[4 * start : 4 * (start + length)]
                    crc = zlib.crc32(own)
                    if with_ids:
                        cut.append(np.frombuffer(own, "<i4"))
                    rows.append(
                        (doc_id, start, length, crc, len(ids) // 4, sequence, offset,
                         window.size, group + step)
                    )
                    offset += length
                sequence += 1
            group += max(steps, default=-1) + 1
            columns = [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)]
            if with_ids:
                columns.append(pa.array(cut, PIECE_IDS.type))
            return pa.RecordBatch.from_arrays(columns, schema=schema)

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py()
                ids = b"".join([*parts_of(text), END]) if text else END
                docs.append((doc_id, ids))
                held += len(ids) // 4
                if held >= pack_tokens:
                    yield out()
                    docs, held = [], 0
        if docs:
            yield out()

    return run


def pack_documents(
    docs: DataFrame,
    tokenizer_path: str,
    tiers: tuple[int, ...] = TIERS,
    pack_tokens: int = PACK_TOKENS,
    step_tokens: int = STEP_TOKENS,
    with_ids: bool = False,
) -> DataFrame:
    """One row for each piece of a document: where it comes from and in which sequence it lies.

    With ``with_ids`` a piece has its token ids as the column ``ids``.

    ``start`` and ``length`` are in tokens of the document, ``offset`` in those of the
    sequence; ``tier`` is the sequence's size and ``step_group`` the step it belongs
    to. A null or empty text is the end token alone. Repeated rows and rows without an
    id are packed each by itself; an empty table gives no rows; other columns are not
    read. Numbers of sequences and step groups depend on how the rows are partitioned.
    """
    chosen = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("text"), F.lit("")).alias("text"),
    )
    pack = _packed(tokenizer_path, tiers, pack_tokens, step_tokens, with_ids)
    return chosen.mapInArrow(pack, PIECES_DDL + (", ids array<int>" if with_ids else ""))
