"""Language of texts by cross-parsing: suffix automata of labelled text, and phrases of longest matches.

A text is cut into phrases, each the longest run of bytes from there on that occurs
in a language's labelled text. The language that needs the fewest phrases, weighed by
the bits that say where in its text a match begins, is the text's. An automaton is kept
as a displaced table: the transition of a state by a byte lies in the slot at the
state's base plus the byte, if that slot is the state's. So all texts of a batch, in
all languages, go on by one byte at a time with a few array operations.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemill.llm.common import small_side, store
from tidemill.llm.hashing import text_bytes
from tidemill.llm.token_counts import balanced

#: Labelled rows that a language is learned from at most, and characters of each of them.
TRAIN_ROWS, EXCERPT = 256, 320
#: Rows of all languages together; where there are many languages each has fewer.
ALL_ROWS = 8192
#: Bytes of a text that are parsed as one run; a phrase ends where a run does.
RUN = 2048
#: Bytes of text that a worker takes on at a time.
BATCH_BYTES = 4 << 20
#: The prediction for a text without letters.
UNKNOWN = "und"

PREDICTED = "doc_id long, lang_pred string, score double, n_bytes long, phrases array<long>"

_LETTERS = np.full(256, 32, np.uint8)
for _code in range(256):
    if _code >= 128 or chr(_code).isalpha():
        _LETTERS[_code] = _code | 32 if _code < 128 else _code


def normal_bytes(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts as lower-case letters and bytes beyond ASCII, with one space for what is between them.

    Takes and gives the texts' bytes one after the other, and where each begins.
    """
    data = _LETTERS[data[bounds[0] : bounds[-1]]]
    bounds = bounds - bounds[0]
    space = data == 32
    after = np.empty(len(data), bool)
    after[1:] = space[:-1]
    after[bounds[:-1][bounds[:-1] < len(data)]] = True
    stay = ~(space & after)
    places = np.concatenate([[0], np.cumsum(stay)])
    return data[stay], places[bounds]


# -- learning ---------------------------------------------------------------


def suffix_automaton(text: bytes) -> list[dict[int, int]]:
    """Transitions of the states; state 0 is the root, and exactly the substrings of ``text`` can be read."""
    moves: list[dict[int, int]] = [{}]
    link, longest = [-1], [0]
    last = 0
    for byte in text:
        new = len(moves)
        moves.append({})
        longest.append(longest[last] + 1)
        link.append(0)
        at = last
        while at >= 0 and byte not in moves[at]:
            moves[at][byte] = new
            at = link[at]
        if at >= 0:
            to = moves[at][byte]
            if longest[to] == longest[at] + 1:
                link[new] = to
            else:
                twin = len(moves)
                moves.append(dict(moves[to]))
                longest.append(longest[at] + 1)
                link.append(link[to])
                link[to] = link[new] = twin
                while at >= 0 and moves[at].get(byte) == to:
                    moves[at][byte] = twin
                    at = link[at]
        last = new
    return moves


def displaced(moves: list[dict[int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Base of each state, and owner and target of each slot (-1 where it is free).

    States of many transitions are placed first; those of one fill what is left.
    """
    used = bytearray(256)
    owner: dict[int, int] = {}
    target: dict[int, int] = {}
    base = np.zeros(len(moves), np.int64)
    begin: dict[int, int] = {}
    for state in sorted(range(len(moves)), key=lambda s: -len(moves[s])):
        if not (own := sorted(moves[state])):
            break  # the states that are left lead nowhere
        least, several = own[0], len(own) > 1
        slot = used.find(0, begin.get(len(own), 0))
        while slot >= 0 and (
            slot < least or several and any(used[slot - least + b : slot - least + b + 1] == b"\1" for b in own)
        ):
            slot = used.find(0, slot + 1)
        if slot < 0:
            slot = max(len(used), least)
        begin[len(own)] = slot
        base[state] = slot - least
        if (need := slot - least + 256) > len(used):
            used.extend(bytes(need + len(used) // 2 - len(used)))
        for byte in own:
            place = slot - least + byte
            used[place], owner[place], target[place] = 1, state, moves[state][byte]
    size = int(base.max()) + 256
    owners, targets = np.full(size, -1, np.int64), np.full(size, -1, np.int64)
    owners[list(owner)], targets[list(target)] = list(owner.values()), list(target.values())
    return base, owners, targets


def _learned(key: tuple, rows: pa.Table) -> pa.Table:
    """The automaton of one language's excerpts, which have a line break between them."""
    data, bounds = normal_bytes(*text_bytes(rows.column("excerpt").combine_chunks()))
    text = b"\n".join(data[lo:hi].tobytes() for lo, hi in zip(bounds, bounds[1:], strict=False))
    base, owner, target = displaced(suffix_automaton(text))
    return pa.table(
        {
            "lang": pa.array([key[0].as_py()], pa.string()),
            "n": pa.array([int(bounds[-1])], pa.int64()),
            "base": pa.array([base.astype("<i4").tobytes()], pa.binary()),
            "owner": pa.array([owner.astype("<i4").tobytes()], pa.binary()),
            "target": pa.array([target.astype("<i4").tobytes()], pa.binary()),
        }
    )


def training_rows(
    docs: DataFrame, train_rows: int = TRAIN_ROWS, excerpt: int = EXCERPT, all_rows: int = ALL_ROWS
) -> DataFrame:
    """lang and excerpt of at most ``train_rows`` different texts of each language.

    Texts are chosen by their hash, so the choice doesn't depend on partitions; equal
    texts are one, and a window only sees about twice as many as it keeps.
    """
    labelled = docs.where("lang is not null and text is not null").select(
        F.col("lang"), F.xxhash64("text").alias("__hash"), F.col("text")
    )
    sizes = store(
        labelled.groupBy("lang").agg(F.approx_count_distinct("__hash").alias("__texts")), "languages"
    )
    n_langs = sizes.count()
    rows = max(1, min(train_rows, all_rows // max(n_langs, 1)))
    spread = F.greatest(F.length("text") - excerpt, F.lit(0)) + 1
    start = F.pmod(F.xxhash64(F.lit(1), "__hash"), spread).cast("int") + 1
    draw = F.pmod(F.xxhash64(F.lit(2), "__hash"), F.lit(1 << 30))
    drawn = labelled.join(small_side(sizes), "lang").where(
        draw < F.lit(float((2 * rows + 16) << 30)) / F.col("__texts")
    )
    one_each = drawn.groupBy("lang", "__hash").agg(
        F.min(F.substring(F.col("text"), start, F.lit(excerpt))).alias("excerpt"),
        F.min(draw).alias("__draw"),
    )
    turn = F.row_number().over(Window.partitionBy("lang").orderBy("__draw", "__hash"))
    return one_each.withColumn("__turn", turn).where(F.col("__turn") <= rows).select("lang", "excerpt")


@dataclass
class Model:
    """Automata of several languages in one table; state 0 is where nothing goes on."""

    langs: list[str]
    sizes: np.ndarray
    base: np.ndarray
    slots: np.ndarray
    roots: np.ndarray

    def phrases(self, data: np.ndarray, bounds: np.ndarray, run: int = RUN) -> np.ndarray:
        """Phrases of each text (a row) in each language (a column)."""
        n, n_langs = len(bounds) - 1, len(self.langs)
        lengths = np.diff(bounds)
        runs = -(-lengths // run)
        of = np.repeat(np.arange(n), runs)
        nth = np.arange(len(of)) - np.repeat(np.cumsum(runs) - runs, runs)
        starts = bounds[:-1][of] + nth * run
        sizes = np.minimum(lengths[of] - nth * run, run)
        order = np.argsort(-sizes, kind="stable")
        starts, sizes = starts[order], sizes[order]
        #: runs that have a byte at each step
        alive = len(sizes) - np.searchsorted(sizes[::-1], np.arange(sizes[0] if len(sizes) else 0), "right")
        states = np.zeros((len(sizes), n_langs), np.int64)
        counts = np.zeros((len(sizes), n_langs), np.int64)
        offset = np.arange(n_langs) * 256
        for step, k in enumerate(alive.tolist()):
            byte = data[starts[:k] + step].astype(np.int64)[:, None]
            now = states[:k]
            found = self.slots[self.base[now] + byte]
            missed = (found >> 32) != now
            counts[:k] += missed
            states[:k] = np.where(missed, self.roots[offset + byte], found & 0xFFFFFFFF)
        total = np.zeros((n, n_langs), np.int64)
        np.add.at(total, of[order], counts)
        return total

    def verdicts(self, phrases: np.ndarray, n_bytes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of each text's language, and how far the second one is behind, from 0 to 1.

        Of equal languages the first by name wins.
        """
        bits = phrases * np.log2(self.sizes + 2.0)
        cost = bits / np.maximum(n_bytes, 1)[:, None]
        best = np.argmin(cost, axis=1)
        if len(self.langs) == 1:
            return best, np.ones(len(best))
        two = np.partition(cost, 1, axis=1)[:, :2]
        return best, np.where(two[:, 1] > 0, 1 - two[:, 0] / np.maximum(two[:, 1], 1e-300), 0.0)


def joined(learned: list[tuple[str, int, bytes, bytes, bytes]]) -> Model:
    """One table of the automata, each (lang, n, base, owner, target)."""
    learned = sorted(learned)
    base, slots, roots = [np.zeros(1, np.int64)], [np.full(256, -1, np.int64)], []
    n_states, n_slots = 1, 256
    for _, _, bases, owners, targets in learned:
        own, owner, target = (np.frombuffer(x, "<i4").astype(np.int64) for x in (bases, owners, targets))
        taken = owner >= 0
        slots.append(np.where(taken, (owner + n_states) << 32 | (target + n_states), -1))
        first = np.arange(256) + own[0]
        roots.append(np.where(owner[first] == 0, target[first] + n_states, 0))
        base.append(own + n_slots)
        n_states, n_slots = n_states + len(own), n_slots + len(owner)
    return Model(
        [x[0] for x in learned], np.array([x[1] for x in learned]),
        np.concatenate(base), np.concatenate(slots), np.concatenate(roots) if roots else NO_ROOTS,
    )


NO_ROOTS = np.zeros(0, np.int64)


def learn(docs: DataFrame, **bounds) -> Model:
    """A model of the languages of ``docs`` (text, lang), from the rows that ``training_rows`` takes.

    Every language is learned in a task of its own from a bounded text; the automata,
    some 30 bytes for each byte of it, come to the driver and go out with the job: those
    of all languages together stand for ``all_rows`` excerpts at most, or one of each. A
    language whose texts have no letters isn't learned.
    """
    learned = training_rows(docs, **bounds).groupBy("lang").applyInArrow(
        _learned, "lang string, n long, base binary, owner binary, target binary"
    )
    return joined([tuple(row) for row in learned.where("n > 0").collect()])


# -- prediction -------------------------------------------------------------


def _predicted(model: Model, run: int, batch_bytes: int):
    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.large_string())
            lengths = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
            offsets = np.concatenate([[0], np.cumsum(lengths)])
            for start, end in balanced(offsets, batch_bytes):
                part = batch.slice(start, end - start)
                data, bounds = normal_bytes(*text_bytes(part.column(1)))
                n_bytes = np.diff(bounds)
                lettered = part.column(2).to_numpy(zero_copy_only=False) & bool(model.langs)
                if model.langs:
                    phrases = model.phrases(data, bounds, run)
                    best, score = model.verdicts(phrases, n_bytes)
                else:
                    phrases, best = np.zeros((len(lettered), 0), np.int64), np.zeros(len(lettered), int)
                    score = np.zeros(len(lettered))
                names = [model.langs[b] if there else UNKNOWN for b, there in zip(best, lettered, strict=True)]
                ends = np.arange(len(lettered) + 1, dtype=np.int32) * len(model.langs)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array(names, pa.string()),
                        pa.array(np.where(lettered, score, 0.0)),
                        pa.array(n_bytes, pa.int64()),
                        pa.ListArray.from_arrays(pa.array(ends), pa.array(phrases.ravel())),
                    ],
                    names=["doc_id", "lang_pred", "score", "n_bytes", "phrases"],
                )

    return predict


def predict(docs: DataFrame, model: Model, run: int = RUN, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """Language of every row's whole text, in the partitions of ``docs``.

    ``score`` is the share by which the second language is dearer than the first: 0 if they
    are equal, 1 if there is no other. ``phrases`` has a number for each language of
    the model, ``n_bytes`` the bytes parsed. A text that is null or has no letter is
    ``und`` with score 0, and so is every text if no language was learned. Repeated rows
    and rows without an id are read each by itself; columns but doc_id and text are not
    looked at.
    """
    chosen = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("text"),
        F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("lettered"),
    )
    return chosen.mapInArrow(_predicted(model, run, batch_bytes), PREDICTED)


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether a document is kept from learning: every third by the CRC-32 of its id.

    A row without an id isn't held out, and isn't learned from either.
    """
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))
