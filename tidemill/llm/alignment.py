"""Alignment of two tokenizers' tokens of the same text, by their byte offsets.

The ends of both tokenizations are compared at the current shift between the two
indexes: slices of doubling length are equal while tokens go one to one, and the first
slice that isn't is halved to find where the stretch ends. There a group of tokens that
don't go one to one is walked through, which gives the new shift.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from collections.abc import Iterator, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm.common import BROADCAST_ROWS, store
from tidemill.llm.packing import byte_letters
from tidemill.llm.token_counts import balanced
from tidemill.llm.tokens import per_worker, words

#: Bytes of text that a worker takes on at a time, and parts of a text that are aligned at a time.
BATCH_BYTES, SEGMENT = 1 << 20, 100_000
#: Parts of texts that a worker remembers.
REMEMBER = 200_000
#: Tokens that are compared at first.
FIRST_STEP = 4

# Fixed value: how byte-level tokenizers cut text before their merges.
BYTE_LEVEL = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Parts of characters that are the same letters, digits and marks to every library.
_PLAIN = re.compile(r"[A-Za-z0-9À-ÖØ-öø-ÿ.,;:!?'\"()/\n-]+")

ALIGNED = (
    "doc_id long, a_ids array<int>, b_ids array<int>, link_a array<int>, link_b array<int>"
)
DIGESTS = (
    "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string,"
    " pairs array<long>, times array<int>"
)


def align(a_ends: Sequence[int], b_ends: Sequence[int]) -> tuple[list[int], list[int]]:
    """Indexes of every pair of tokens whose bytes overlap, in order.

    Both arrays hold ascending ends and have the last one in common.
    """
    # slices are compared as bytes, four for each end
    a_raw, b_raw = (np.asarray(ends, np.int32).tobytes() for ends in (a_ends, b_ends))
    a_end, b_end = (memoryview(raw).cast("i") for raw in (a_raw, b_raw))
    link_a: list[int] = []
    link_b: list[int] = []
    i = j = 0
    n = len(a_end)
    while i < n:
        # tokens that go one to one at this shift
        at, shift, step = 4 * i, 4 * (j - i), 4 * FIRST_STEP
        while at < 4 * n and a_raw[at : at + step] == b_raw[at + shift : at + shift + step]:
            at += step
            step += step
        while step > 4 and at < 4 * n:
            step >>= 1
            if a_raw[at : at + step] == b_raw[at + shift : at + shift + step]:
                at += step
        first, i = i, min(at >> 2, n)
        link_a += range(first, i)
        link_b += range(j, j + i - first)
        j += i - first
        if i == n:
            break
        # a group of others, up to the next end in common
        ours, theirs = a_end[i], b_end[j]
        while True:
            link_a.append(i)
            link_b.append(j)
            if ours < theirs:
                i += 1
                ours = a_end[i]
            elif theirs < ours:
                j += 1
                theirs = b_end[j]
            else:
                break
        i, j = i + 1, j + 1
    return link_a, link_b


class Parts(dict):
    """What is known of parts of texts: those remembered, and those of the batch at hand."""

    def __init__(self):
        super().__init__()
        self.batch: dict[str, tuple[bytes, bytes, bool]] = {}

    def __missing__(self, part: str) -> tuple[bytes, bytes, bool]:
        return self.batch[part]


class Tokenizers:
    """Tokens of parts of texts by a byte-level BPE (A) and a sentencepiece model (B)."""

    def __init__(self, a_path: str, b_path: str):
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_file=b_path)
        byte_of = {letter: byte for byte, letter in byte_letters().items()}
        vocabulary = self.a.get_vocab()
        self.a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.a_bytes[i] = bytes(byte_of[c] for c in token if c in byte_of)
        self.b_bytes = [
            bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode()
            for i, piece in enumerate(map(self.b.id_to_piece, range(self.b.get_piece_size())))
        ]
        self.a_lengths = np.array([len(b) for b in self.a_bytes])
        self.b_lengths = np.array([len(b) for b in self.b_bytes])
        self.a_ranks = self._ranks(a_path, vocabulary)
        self.parts = Parts()

    def _ranks(self, a_path: str, vocabulary: dict[str, int]):
        """A's encoding by ranks, if its merges come in the order of their ids and nothing else is special."""
        import tiktoken

        with open(a_path, encoding="utf-8") as file:
            told = json.load(file)
        cut = told.get("pre_tokenizer") or {}
        plain = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
        merges = [m.split(" ") if isinstance(m, str) else m for m in told["model"].get("merges", ())]
        made = [vocabulary.get("".join(pair)) for pair in merges]
        if told.get("normalizer") or plain.items() - cut.items() or None in made or made != sorted(made):
            return None
        special = {t["id"] for t in told.get("added_tokens", ())}
        ranks = {self.a_bytes[i]: i for i in vocabulary.values() if i not in special}
        return tiktoken.Encoding("ranks", pat_str=BYTE_LEVEL, mergeable_ranks=ranks, special_tokens={})

    def ids_of_a(self, parts: Sequence[str]) -> list[list[int]]:
        """A's ids of each part after a space."""
        if self.a_ranks is None:
            return [self.a.encode(" " + part, add_special_tokens=False).ids for part in parts]
        by_rank, plain = self.a_ranks.encode_ordinary, _PLAIN.fullmatch
        return [
            by_rank(" " + part) if plain(part) else self.a.encode(" " + part, add_special_tokens=False).ids
            for part in parts
        ]

    def learn(self, parts: set[str]) -> None:
        """Encode the parts that aren't remembered: ids of A and B, and whether they spell the part."""
        unknown = [part for part in parts if part not in self.parts]
        sides = (
            (self.a_bytes, self.a_lengths, self.ids_of_a(unknown)),
            (self.b_bytes, self.b_lengths, self.b.encode(unknown, num_threads=1)),
        )
        columns, spelt = [], np.ones(len(unknown), bool)
        whole = "".join([" " + part for part in unknown]).encode()
        sizes = np.array([len(part.encode()) + 1 for part in unknown], np.int64)
        for table, lengths, ids in sides:
            flat = array("i", chain.from_iterable(ids))
            ends = np.cumsum([0, *map(len, ids)])
            own = np.append(0, np.cumsum(lengths[np.frombuffer(flat, np.int32)]))[ends]
            # all parts at once, or if some are spelt otherwise each by itself
            if self.spell(table, flat) != whole or (np.diff(own) != sizes).any():
                spelt &= [
                    self.spell(table, one) == (" " + part).encode() for one, part in zip(ids, unknown, strict=True)
                ]
            raw, at = flat.tobytes(), (4 * ends).tolist()
            columns.append([raw[low:high] for low, high in zip(at, at[1:], strict=False)])
        made = dict(zip(unknown, zip(*columns, spelt.tolist(), strict=True), strict=True))
        if len(self.parts) + len(made) <= REMEMBER:
            self.parts.update(made)
            made = {}
        self.parts.batch = made

    @staticmethod
    def spell(table: list[bytes], ids: Sequence[int]) -> bytes:
        return b"".join(map(table.__getitem__, ids))

    def aligned(self, texts: Sequence[str]) -> list[tuple[np.ndarray, ...]]:
        """Ids of A and of B, and the indexes of linked tokens, for each text."""
        cut = [words(text) if text else [] for text in texts]
        self.learn({part for parts in cut for part in parts})
        return [self._aligned(text, parts) for text, parts in zip(texts, cut, strict=True)]

    def _aligned(self, text: str, parts: list[str]) -> tuple[np.ndarray, ...]:
        """All empty if either tokenizer's tokens don't spell the text.

        A part ends in both tokenizations where the next begins, so runs of parts are
        aligned apart from each other.
        """
        if not parts:
            return (NOTHING,) * 4
        ids_a, ids_b, spelt = zip(*map(self.parts.__getitem__, parts), strict=True)
        if not all(spelt):
            whole = (" " + text).encode()
            for table, ids in ((self.a_bytes, ids_a), (self.b_bytes, ids_b)):
                if self.spell(table, np.frombuffer(b"".join(ids), np.int32).tolist()) != whole:
                    return (NOTHING,) * 4
        out: list[list[np.ndarray]] = [[], [], [], []]
        n_a = n_b = 0
        for start in range(0, len(parts), SEGMENT):
            a, b = (
                np.frombuffer(b"".join(ids[start : start + SEGMENT]), np.int32) for ids in (ids_a, ids_b)
            )
            link_a, link_b = align(np.cumsum(self.a_lengths[a]), np.cumsum(self.b_lengths[b]))
            found = a, b, np.array(link_a, np.int32) + np.int32(n_a), np.array(link_b, np.int32) + np.int32(n_b)
            for column, values in zip(out, found, strict=True):
                column.append(values)
            n_a, n_b = n_a + len(a), n_b + len(b)
        return tuple(column[0] if len(column) == 1 else np.concatenate(column) for column in out)


NOTHING = np.zeros(0, np.int32)


def lists(arrays: Sequence[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
    values = np.concatenate([NOTHING.astype(arrays[0].dtype), *arrays]) if len(arrays) else NOTHING
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values))


def _aligned(a_path: str, b_path: str, batch_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = per_worker(("aligned", a_path, b_path), lambda: Tokenizers(a_path, b_path))
        for batch in batches:
            text = batch.column(1).cast(pa.large_string())
            n_bytes = pa.compute.binary_length(text).to_numpy(zero_copy_only=False)
            offsets = np.concatenate([[0], np.cumsum(n_bytes)])
            for start, end in balanced(offsets, batch_bytes):
                found = both.aligned(text.slice(start, end - start).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(start, end - start),
                        *(lists(column) for column in zip(*found, strict=True)),
                    ],
                    names=["doc_id", "a_ids", "b_ids", "link_a", "link_b"],
                )

    return run


def align_documents(
    docs: DataFrame, a_path: str, b_path: str, batch_bytes: int = BATCH_BYTES
) -> DataFrame:
    """Every row's tokens by both tokenizers, and which of them overlap, in the partitions of ``docs``.

    A (``a_path``, a file of the library tokenizers) reads the text after a space, which B
    (``b_path``, a sentencepiece model) adds by itself; special strings are plain text.
    ``link_a`` and ``link_b`` hold the indexes of overlapping tokens, in order; a group
    of tokens ends where both go on at once. A text that is null, empty or not spelt by
    the tokens of both (one that holds U+2581, say) has none. Repeated rows and rows
    without an id are aligned each by itself; other columns are not read.
    """
    return _chosen(docs).mapInArrow(_aligned(a_path, b_path, batch_bytes), ALIGNED)


def _chosen(docs: DataFrame) -> DataFrame:
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("text"), F.lit("")).alias("text"),
    )


class Written(list):
    """Decimal ids with the mark that comes after them: three entries for each id."""

    def up_to(self, most: int) -> list[bytes]:
        for i in range(len(self) // 3, most + 1):
            self += [b"%d," % i, b"%d|" % i, b"%d;" % i]
        return self


def groups(link_a: np.ndarray, link_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each group of linked tokens begins, as indexes of A's and of B's tokens."""
    both = (link_a[1:] != link_a[:-1]) & (link_b[1:] != link_b[:-1])
    begins = np.concatenate([[0], np.flatnonzero(both) + 1]) if len(link_a) else NOTHING
    return link_a[begins], link_b[begins]


def groups_sha256(
    a: np.ndarray, b: np.ndarray, begin_a: np.ndarray, begin_b: np.ndarray, written: Written
) -> str:
    """SHA-256 of the groups written out as ``a1,a2|b1;a3|b2,b3``."""
    last_a, last_b = (np.zeros(len(x), np.int64) for x in (a, b))
    last_a[np.append(begin_a[1:], len(a)) - 1] = 1
    last_b[np.append(begin_b[1:], len(b)) - 1] = 2
    group_a = np.cumsum(np.append(0, last_a[:-1]))
    group_b = np.cumsum(np.append(0, last_b[:-1] // 2))
    codes = np.empty(len(a) + len(b), np.int64)
    codes[np.arange(len(a)) + begin_b[group_a]] = a * np.int64(3) + last_a
    codes[np.arange(len(b)) + np.append(begin_a[1:], len(a))[group_b]] = b * np.int64(3) + last_b
    table = written.up_to(int(max(a.max(), b.max())))
    hashed = hashlib.sha256()
    for start in range(0, len(codes), 1 << 20):
        part = b"".join(map(table.__getitem__, codes[start : start + (1 << 20)].tolist()))
        hashed.update(part[:-1] if start + (1 << 20) >= len(codes) else part)
    return hashed.hexdigest()


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    written = per_worker("written_ids", Written)

    def split(column: pa.Array) -> list[np.ndarray]:
        values = column.flatten().to_numpy()
        ends = np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))
        return np.split(values, ends)[: len(column)]

    for batch in batches:
        numbers, hashes, pairs, times = [], [], [], []
        for a, b, link_a, link_b in zip(*map(split, batch.columns[1:]), strict=True):
            begin_a, begin_b = groups(link_a, link_b)
            numbers.append((len(a), len(b), len(begin_a), len(link_a)))
            hashes.append(groups_sha256(a, b, begin_a, begin_b, written) if len(a) else "")
            linked = a[link_a].astype(np.int64) << 32 | b[link_b]
            pair, n = np.unique(linked, return_counts=True)
            pairs.append(pair)
            times.append(n.astype(np.int32))
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                *(pa.array(c, pa.int64()) for c in np.array(numbers, np.int64).reshape(-1, 4).T),
                pa.array(hashes, pa.string()),
                lists(pairs).cast(pa.list_(pa.int64())),
                lists(times).cast(pa.list_(pa.int32())),
            ],
            names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"],
        )


def _aligned_digests(a_path: str, b_path: str, batch_bytes: int):
    aligned = _aligned(a_path, b_path, batch_bytes)
    return lambda batches: _digests(aligned(batches))


def align_digests(
    docs: DataFrame, a_path: str, b_path: str, batch_bytes: int = BATCH_BYTES
) -> DataFrame:
    """``alignment_digests`` of ``align_documents`` in one pass: ids and links don't leave the worker."""
    return _chosen(docs).mapInArrow(_aligned_digests(a_path, b_path, batch_bytes), DIGESTS)


def alignment_digests(aligned: DataFrame) -> DataFrame:
    """Numbers and the digest of the groups of ``align_documents``' rows.

    ``pairs`` are the different linked ids (A's in the upper 32 bits, B's in the lower),
    ``times`` how many links have them. A row without tokens has zeros, an empty digest
    and no pairs.
    """
    return aligned.mapInArrow(_digests, DIGESTS)


def pair_counts(digests: DataFrame) -> DataFrame:
    """pair, links (how many of all links have it) and best (whether no pair of its B id has more)."""
    each = digests.select(F.explode(F.arrays_zip("pairs", "times")).alias("x"))
    counts = store(
        each.groupBy(F.col("x.pairs").alias("pair")).agg(F.sum("x.times").alias("links")), "pairs"
    )
    b_id = F.col("pair").bitwiseAND(0xFFFFFFFF)
    most = counts.groupBy(b_id.alias("b_id")).agg(F.max("links").alias("most"))
    # a row for each entry of B's vocabulary at most
    found = counts.withColumn("b_id", b_id).join(F.broadcast(most), "b_id")
    return found.select("pair", "links", (F.col("links") == F.col("most")).alias("best"))


def frequent_from(counts: DataFrame, most_rows: int) -> int:
    """The least power of two that at most ``most_rows`` pairs have as many links as.

    A pair of fewer links then has under 2 / ``most_rows`` of all links.
    """
    by_bits = counts.groupBy(F.length(F.bin("links")).alias("bits")).count().collect()
    rows, bits = 0, 63
    for found in sorted(by_bits, reverse=True):
        rows += found["count"]
        if rows > most_rows:
            break
        bits = found["bits"]
    return 1 << (bits - 1)


def with_pair_sums(digests: DataFrame, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``digests`` with n_best (links whose pair is a best one) and count_sum (their pairs' links).

    Counts are over all rows. The most frequent pairs are broadcast, at most
    ``broadcast_rows`` of them, so the pairs that are left for the shuffle are none that
    many rows share. A row without links has zeros.
    """
    digests = store(digests.withColumn("row", F.monotonically_increasing_id()), "digests")
    counts = store(pair_counts(digests), "pair-counts")
    least = frequent_from(counts, broadcast_rows)
    own = ["row", *(c for c in digests.columns if c not in ("row", "pairs", "times"))]
    each = digests.select(*own, F.explode_outer(F.arrays_zip("pairs", "times")).alias("x")).select(
        *own, F.col("x.pairs").alias("pair"), F.col("x.times").alias("times")
    )
    frequent = each.join(F.broadcast(counts.where(F.col("links") >= least)), "pair", "left")
    rest = counts.where(F.col("links") < least)

    def summed(links: DataFrame) -> DataFrame:
        return links.groupBy(*own).agg(
            F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).cast("long").alias("n_best"),
            F.sum(F.coalesce(F.col("times") * F.col("links"), F.lit(0))).cast("long").alias("count_sum"),
        )

    if rest.isEmpty():
        return summed(frequent).drop("row")
    rare = frequent.where("links is null and pair is not null").drop("links", "best").join(rest, "pair")
    known = frequent.where("links is not null or pair is null")
    both = summed(known).unionByName(summed(rare))
    # a row whose pairs are all rare has no known ones, and the other way round
    return both.groupBy(*own).agg(
        F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum")
    ).drop("row")
