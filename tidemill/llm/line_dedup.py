"""Near-duplicate lines: an exact set-similarity join, and removal of later matches.

A line is the set of its words (A-Z in lower case). Words are ordered by rarity: by a
table of a fixed number of hashed counts, then by their hash. Two sets that share the
asked-for part of their union share a word among the first n - ceil(t n) + 1 words of
each; words that occur once in the corpus come first and need no join. Lines are dealt out
by such words and compared within each, in order of size. The place of the shared word, the
sizes and a bitmap of the words must leave room for the overlap needed. One earlier line is
enough for a line to go: of the lines that pass, those nearest to it are named, and verified on
the full sets; a line for which these fail, and others passed, is compared with all of them.
Lines of equal sets are one class and take part once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm.common import small_side, store
from tidemill.llm.hashing import mix, row_blocks, text_bytes, word_hashes
from tidemill.llm.setjoin import linked

#: Least Jaccard similarity, in hundredths, and words that a line must have to be compared:
#: every line that has a word is.
SIMILAR, LEAST_WORDS = 80, 1
#: Hashed counts of words: a fixed table of bytes, 8 for each doubling of the count.
COUNTS = 1 << 23
PER_DOUBLING, CHUNK = 8, 1 << 12
#: Rows of words that a task compares at a time, and pairs that it gives out at a time.
COMPARED, GIVEN = 1 << 19, 1 << 16
#: Lines named for each line and word it shares; one only if the bitmaps differ in no more than
#: so many hundredths of the bits that similar sets may differ in.
NAMED, SURE = 4, 63
#: Marks what is named besides the nearest.
OTHER = 1 << 30
#: Stands for the id of a row without one: after all others.
NO_ID = 9223372036854775807

LINES = (
    "doc_id long, text_hash long, line int, n int, set_a long, set_b long, alone int, "
    "bits long, more_bits int, prefix array<int>"
)
LINE_NAMES = [field.split()[0] for field in LINES.split(", ")]
TOKENS = "id long, tokens array<long>"
#: The word of a row of ``_heads``.
TOKEN = "shiftright(word, 32)"
PAIRS = "id_b long, id_a long, far int, more boolean"
#: What tells documents apart: rows that repeat an id, or have none, by their texts.
DOCUMENT = ["doc_id", "text_hash"]


def line_bounds(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each line of the texts begins (and the end of all), and the lines of each text."""
    part = data[bounds[0] : bounds[-1]]
    breaks = np.flatnonzero(part == 10) + bounds[0]
    lines = 1 + np.diff(np.searchsorted(breaks, bounds))
    begins = np.sort(np.concatenate([bounds[:-1], breaks + 1]))
    return np.append(begins, bounds[-1]), lines


def _lines(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For runs of rows: the first row, lines of each row, word hashes and the line of each."""
    data, bounds = text_bytes(column)
    for start, end in row_blocks(bounds):
        begins, lines = line_bounds(data, bounds[start : end + 1])
        hashes, of = word_hashes(data, begins, lower=True)
        yield start, lines, hashes, of


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What each chunk of the table counts here: the places that aren't 0, and their counts."""
    counts = np.zeros(COUNTS, np.int32)
    for batch in batches:
        for _, _, hashes, _ in _lines(batch.column(0)):
            place = np.sort((hashes & np.uint64(COUNTS - 1)).astype(np.int32))
            starts = np.flatnonzero(np.diff(place, prepend=-1))
            counts[place[starts]] += np.diff(starts, append=len(place)).astype(np.int32)
    found = np.flatnonzero(counts)
    cuts = np.searchsorted(found, np.arange(0, COUNTS + 1, CHUNK))
    parts = [found[lo:hi] for lo, hi in zip(cuts[:-1], cuts[1:], strict=True)]
    chunks = [i for i, part in enumerate(parts) if len(part)]
    yield pa.RecordBatch.from_arrays(
        [
            pa.array(chunks, pa.int32()),
            pa.array([(parts[i] % CHUNK).astype(np.uint16).tobytes() for i in chunks], pa.binary()),
            pa.array([counts[parts[i]].tobytes() for i in chunks], pa.binary()),
        ],
        names=["chunk", "places", "counts"],
    )


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The codes of each chunk of counts: 0 for none or one, then rising with the logarithm."""
    totals: dict[int, np.ndarray] = {}
    for batch in batches:
        for chunk, places, counts in zip(*(column.to_pylist() for column in batch.columns), strict=True):
            total = totals.setdefault(chunk, np.zeros(CHUNK, np.int64))
            total[np.frombuffer(places, np.uint16)] += np.frombuffer(counts, np.int32)
    codes = [
        np.minimum(255, np.ceil(np.log2(np.maximum(total, 1)) * PER_DOUBLING)).astype(np.uint8).tobytes()
        for total in totals.values()
    ]
    yield pa.RecordBatch.from_arrays(
        [pa.array(list(totals), pa.int32()), pa.array(codes, pa.binary())], names=["chunk", "codes"]
    )


def rarity(docs: DataFrame) -> np.ndarray:
    """Code of each hashed word: the fixed table of ``COUNTS`` bytes, from all of ``docs``."""
    counts = docs.select("text").mapInArrow(_counted, "chunk int, places binary, counts binary")
    chunks = counts.repartition("chunk").mapInArrow(_packed, "chunk int, codes binary").collect()
    table = np.zeros(COUNTS, np.uint8)
    for chunk, codes in chunks:
        table[chunk * CHUNK : (chunk + 1) * CHUNK] = np.frombuffer(codes, np.uint8)
    return table


def line_sets(
    hashes: np.ndarray, of: np.ndarray, n_lines: int, rank: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct words of each line, in order of ``rank`` and hash, their ranks, and their number."""
    key = (of.astype(np.uint64) << np.uint64(44)) | (rank.astype(np.uint64) << np.uint64(36))
    key |= hashes >> np.uint64(28)
    order = np.argsort(key)
    key, sorted_hashes = key[order], hashes[order]
    same = key[1:] == key[:-1]
    if n_lines > 1 << 20 or (sorted_hashes[1:][same] != sorted_hashes[:-1][same]).any():
        # the key doesn't hold all that tells words apart
        order = np.lexsort((hashes, rank, of))
        sorted_hashes = hashes[order]
        same = (sorted_hashes[1:] == sorted_hashes[:-1]) & (of[order][1:] == of[order][:-1])
    new = np.ones(len(order), bool)
    new[1:] = ~same
    order = order[new]
    return hashes[order], rank[order], np.bincount(of[order], minlength=n_lines)


def prefix_length(n: np.ndarray, similar: int) -> np.ndarray:
    return n - -(-n * similar // 100) + 1


def _listed(values: np.ndarray, counts: np.ndarray) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))


def _signed(codes, similar: int, least_words: int):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = codes.value
        for batch in batches:
            ids, texts = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            for start, lines, hashes, of in _lines(batch.column(2)):
                n_lines = int(lines.sum())
                rank = table[(hashes & np.uint64(COUNTS - 1)).astype(np.int64)]
                sets, rank, counts = line_sets(hashes, of, n_lines, rank)
                of = np.repeat(np.arange(n_lines), counts)
                ends = np.cumsum(counts)
                sums = np.concatenate([[np.uint64(0)], np.cumsum(mix(sets))])
                set_a = sums[ends] - sums[ends - counts]
                sums = np.concatenate([[np.uint64(0)], np.cumsum(mix(sets + np.uint64(1)))])
                set_b = sums[ends] - sums[ends - counts]
                bits, more_bits = np.zeros(n_lines, np.uint64), np.zeros(n_lines, np.uint64)
                if len(sets):
                    # one bit of 96 for each word
                    bit = (sets & np.uint64(0xFFFFFFFF)) * np.uint64(96) >> np.uint64(32)
                    flips, first = np.uint64(1) << (bit & np.uint64(63)), bit < 64
                    begins = (ends - counts)[counts > 0]
                    bits[counts > 0] = np.bitwise_xor.reduceat(np.where(first, flips, 0), begins)
                    more_bits[counts > 0] = np.bitwise_xor.reduceat(np.where(first, 0, flips), begins)
                place = np.arange(len(sets)) - (ends - counts)[of]
                taken = (place < prefix_length(counts, similar)[of]) & (rank > 0)
                taken &= (counts >= least_words)[of]
                alone = np.bincount(of[rank == 0], minlength=n_lines)
                row = np.repeat(np.arange(len(lines)), lines)
                number = np.arange(n_lines) - (np.cumsum(lines) - lines)[row]
                own = counts >= least_words
                kept = np.bincount(of[taken], minlength=n_lines)[own]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(ids[start + row[own]]),
                        pa.array(texts[start + row[own]]),
                        pa.array(number[own].astype(np.int32)),
                        pa.array(counts[own].astype(np.int32)),
                        pa.array(set_a[own].view(np.int64)),
                        pa.array(set_b[own].view(np.int64)),
                        pa.array(alone[own].astype(np.int32)),
                        pa.array(bits[own].view(np.int64)),
                        pa.array(more_bits[own].astype(np.uint32).view(np.int32)),
                        # half of a hash will do to find candidates
                        _listed((sets[taken] >> np.uint64(32)).astype(np.uint32).view(np.int32), kept),
                    ],
                    names=LINE_NAMES,
                )
                # and a row for each document: line -1, n its number of lines, and for a prefix
                # the numbers of those above
                none = np.zeros(len(lines), np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(ids[start : start + len(lines)]),
                        pa.array(texts[start : start + len(lines)]),
                        pa.array((none - 1).astype(np.int32)),
                        pa.array(lines.astype(np.int32)),
                        *[pa.array(none)] * 2,
                        pa.array(none.astype(np.int32)),
                        pa.array(none),
                        pa.array(none.astype(np.int32)),
                        _listed(number[own].astype(np.int32), np.bincount(row[own], minlength=len(lines))),
                    ],
                    names=LINE_NAMES,
                )

    return sign


def _chosen_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Word sets of the lines whose numbers and ids are listed in the last two columns."""
    for batch in batches:
        at = np.concatenate([[0], np.cumsum(batch.column(1).value_lengths().to_numpy())])
        wanted, ids = (batch.column(i).flatten().to_numpy() for i in (1, 2))
        for start, lines, hashes, of in _lines(batch.column(0)):
            n_lines, end = int(lines.sum()), start + len(lines)
            own = slice(at[start], at[end])
            rows = np.repeat(np.arange(len(lines)), np.diff(at[start : end + 1]))
            # no line is listed twice
            picked = (np.cumsum(lines) - lines)[rows] + wanted[own]
            order = np.argsort(picked)
            picked = picked[order]
            keep = np.zeros(n_lines, bool)
            keep[picked] = True
            keep = keep[of]
            none = np.zeros(int(keep.sum()), np.uint8)
            sets, _, counts = line_sets(hashes[keep], of[keep], n_lines, none)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[own][order]), _listed(sets.view(np.int64), counts[picked])],
                names=["id", "tokens"],
            )


def _met(similar: int, named: int | None):
    """Pairs of lines that share a word and that the filters let pass, from rows dealt out by the word.

    Rows of a word are taken in order of size, so that each is compared with those that
    follow until they are too large: all rows with the next one, then with the next but
    one, and so on. Besides size and place there is a bound by bitmaps: each word that only
    one of two sets has flips one bit of 96, so sets differ in at least as many words as bits.

    For each later line, its nearest earlier one comes out, and ``named`` others if that
    isn't sure to be similar; ``more`` says that there are still others. With ``named``
    None all of them come out, for lines that are ``open``.
    """

    def pairs(later, earlier, far, more):
        for at in range(0, len(later), GIVEN):
            part = slice(at, at + GIVEN)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(later[part]),
                    pa.array(earlier[part]),
                    pa.array(far[part].astype(np.int32)),
                    pa.array(more[part]),
                ],
                names=["id_b", "id_a", "far", "more"],
            )

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = list(batches)
        if not batches:
            return
        table = pa.Table.from_batches(batches)
        token, sized = table.column("word").to_numpy() >> 32, table.column("sized").to_numpy()
        order = np.lexsort((sized >> 32, token))
        token, n, left = token[order], sized[order] >> 32, sized[order] & 0xFFFFFFFF
        ids, bits, more_bits = (table.column(c).to_numpy()[order] for c in ("id", "bits", "word"))
        more_bits &= 0xFFFFFFFF
        is_open = table.column("open").to_numpy()[order] if named is None else np.ones(len(n), bool)
        del batches, table, sized, order
        group = np.cumsum(np.diff(token, prepend=token[0]) != 0) << 32
        # the size up to which others may be similar, and the words left here may do
        most = np.minimum(n * 100 // similar, left * (100 + similar) // similar - n)
        # group and size in one number; of sizes beyond 32 bits there are none
        width = np.searchsorted(group | n, group | np.clip(most, 0, 0xFFFFFFFF), "right")
        width -= np.arange(1, len(n) + 1)
        widest = np.argsort(-width, kind="stable")
        widths = -width[widest]
        found = np.zeros(len(n), np.int64)
        nearest, least = np.full(len(n), NO_ID), np.full(len(n), OTHER)
        others: list[tuple[np.ndarray, np.ndarray]] = []
        for step in range(1, int(width.max()) + 1):
            i = widest[: np.searchsorted(widths, -step, "right")]
            j = i + step
            both = n[i] + n[j]
            need = -(-similar * both // (100 + similar))
            fits = np.minimum(left[i], left[j]) >= need
            i, j, both, need = i[fits], j[fits], both[fits], need[fits]
            far = np.bitwise_count((bits[i] ^ bits[j]).view(np.uint64)).astype(np.int64)
            far += np.bitwise_count(more_bits[i] ^ more_bits[j])
            fits = far <= both - 2 * need
            i, j, far = i[fits], j[fits], (far * 10_000 // np.maximum(both, 1))[fits]
            # each row is at most once the first, and once the second, of a pair of this step
            for b, a in ((i, j), (j, i)):
                own = (ids[a] < ids[b]) & is_open[b]
                b, a, to = b[own], ids[a[own]], far[own]
                if named is None:
                    yield from pairs(ids[b], a, to, np.zeros(len(b), bool))
                    continue
                few = found[b] < named
                others.append((b[few], a[few]))
                found[b] += 1
                better = (to < least[b]) | ((to == least[b]) & (a < nearest[b]))
                least[b[better]], nearest[b[better]] = to[better], a[better]
        if named is None:
            return
        at = np.flatnonzero(found)
        sure = least <= SURE * 100 * (100 - similar) // (100 + similar)
        yield from pairs(ids[at], nearest[at], least[at], found[at] > np.where(sure[at], 1, named))
        if others:
            b, a = (np.concatenate(part) for part in zip(*others, strict=True))
            rest = ~sure[b] & (nearest[b] != a)
            b, a = b[rest], a[rest]
            yield from pairs(ids[b], a, np.full(len(b), OTHER), np.zeros(len(b), bool))

    return meet


def _heads(classes: DataFrame) -> DataFrame:
    """A row for each word of the prefixes: few columns and each of two numbers, as all are shuffled."""
    return classes.where("size(prefix) > 0").select(
        "id", "n", "alone", "bits", "more_bits", F.posexplode("prefix").alias("nth", "token")
    ).select(
        "id", "bits",
        F.expr("shiftleft(cast(token as bigint), 32) | (more_bits & 4294967295L)").alias("word"),
        # size, and words from this one on
        F.expr("shiftleft(cast(n as bigint), 32) | (n - alone - nth)").alias("sized"),
    )


def _compared(heads: DataFrame, rows: int, similar: int, named: int | None) -> DataFrame:
    """``heads``, so many rows, dealt out by the word and compared (``_met``)."""
    return heads.repartition(rows // COMPARED + 1, F.expr(TOKEN)).mapInArrow(_met(similar, named), PAIRS)


def _sets(chosen: DataFrame, classes: DataFrame, pairs: DataFrame) -> DataFrame:
    """Word sets of the classes of ``pairs``: id and tokens; rows may come twice."""
    ids = store(
        pairs.select(F.col("id_a").alias("id")).union(pairs.select("id_b")).distinct(), "line-ids"
    )
    listed = F.sort_array(F.collect_list(F.struct("line", "id")))
    wanted = store(
        classes.select("id", *DOCUMENT, "line").join(small_side(ids), "id")
        .groupBy(*DOCUMENT).agg(listed.alias("listed"))
        .select(*DOCUMENT, F.col("listed.line").alias("wanted"), F.col("listed.id").alias("ids")),
        "wanted",
    )
    found = chosen.join(small_side(wanted), DOCUMENT).select("text", "wanted", "ids")
    return store(found.mapInArrow(_chosen_sets, TOKENS), "line-sets")


def _confirmed(pairs: DataFrame, sets: DataFrame, similar: int) -> DataFrame:
    """Later classes of those of ``pairs``, a stored table, whose sets are similar."""
    pairs = small_side(pairs.select("id_a", "id_b"))
    left = sets.select(F.col("id").alias("id_a"), F.col("tokens").alias("tokens_a"))
    right = sets.select(F.col("id").alias("id_b"), F.col("tokens").alias("tokens_b"))
    right = right.join(pairs.select("id_b"), "id_b", "left_semi")
    both = left.join(pairs, "id_a").join(right.dropDuplicates(["id_b"]), "id_b")
    return both.where(linked("tokens_a", "tokens_b", similar)).select("id_b").distinct()


def _later(chosen: DataFrame, classes: DataFrame, similar: int) -> DataFrame:
    """Numbers of the classes that have a similar class before them."""
    rows = classes.agg(F.sum(F.size("prefix"))).first()[0] or 0
    heads = _heads(classes)
    pairs = store(_compared(heads, rows, similar, NAMED), "line-pairs")
    sets = _sets(chosen, classes, pairs)
    # one earlier line is enough: the nearest of each, then all others that are named
    firsts = store(
        pairs.groupBy("id_b").agg(F.min_by("id_a", "far").alias("id_a"), F.max("more").alias("more")),
        "first-pairs",
    )
    later = store(_confirmed(firsts, sets, similar), "later-lines")
    rest = store(
        pairs.select("id_b", "id_a").distinct().join(later, "id_b", "left_anti")
        .join(firsts, ["id_b", "id_a"], "left_anti"),
        "other-pairs",
    )
    later = store(later.union(_confirmed(rest, sets, similar)), "later-lines")
    left = store(firsts.where("more").select("id_b").join(later, "id_b", "left_anti"), "open-lines")
    if left.isEmpty():
        return later
    # and at last all others of the lines that are left
    is_open = small_side(left.select(F.col("id_b").alias("id"), F.lit(True).alias("open")))
    heads = heads.withColumn("token", F.expr(TOKEN))
    tokens = store(heads.join(is_open, "id").select("token").distinct(), "open-words")
    met = (
        heads.join(small_side(tokens), "token", "left_semi")
        .join(is_open, "id", "left")
        .withColumn("open", F.coalesce("open", F.lit(False)))
    )
    pairs = store(
        _compared(met, rows, similar, None).select("id_b", "id_a").distinct()
        .join(pairs.select("id_b", "id_a").distinct(), ["id_b", "id_a"], "left_anti"),
        "line-pairs",
    )
    found = _confirmed(pairs, _sets(chosen, classes, pairs), similar)
    return store(later.union(found), "later-lines")


def _documents(docs: DataFrame, similar: int, least_words: int) -> DataFrame:
    """doc_id, text_hash, n_lines and the numbers of the lines that go, in order, for every row."""
    chosen = docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"),
        F.xxhash64("text").alias("text_hash"), "text",
    )
    codes = docs.sparkSession.sparkContext.broadcast(rarity(chosen))  # COUNTS bytes
    lines = store(chosen.mapInArrow(_signed(codes, similar, least_words), LINES), "lines")
    # classes are numbered in the order of their first lines
    classes = store(
        lines.where("line >= 0").groupBy("set_a", "set_b", "n")
        .agg(F.min(F.struct(*DOCUMENT, "line", "alone", "bits", "more_bits", "prefix")).alias("first"))
        .select("n", "first.*")
        .orderBy(*DOCUMENT, "line")
        .withColumn("id", F.monotonically_increasing_id()),
        "classes",
    )
    later = _later(chosen, classes, similar)
    # what stays are the first lines of classes without a similar class before them
    stay = (
        classes.select(F.col("id").alias("id_b"), *DOCUMENT, "line")
        .join(small_side(later), "id_b", "left_anti")
        .groupBy(*DOCUMENT).agg(F.collect_list("line").alias("stay"))
    )
    own = lines.where("line < 0").select(*DOCUMENT, F.col("n").alias("n_lines"), "prefix")
    gone = F.when(F.col("stay").isNull(), F.col("prefix")).otherwise(F.array_except("prefix", "stay"))
    return own.join(stay, DOCUMENT, "left").select(*DOCUMENT, "n_lines", F.sort_array(gone).alias("gone"))


def matched_lines(
    docs: DataFrame, similar: int = SIMILAR, least_words: int = LEAST_WORDS
) -> tuple[DataFrame, DataFrame]:
    """Lines of every document, and those of them that go: (doc_id, text_hash, n_lines), (doc_id, text_hash, line).

    A line goes if a line before it, in the order of doc_id, hash of the whole text and
    line number, is as similar as asked for, whether that one goes or not. Every line that
    has a word is compared; only lines of fewer different words than ``least_words``, if
    more are asked for, are left alone. A null or empty text is one line without words.
    A row without an id comes after all others, under the id ``NO_ID``. Rows that share an
    id, or have none, are documents of their own if their texts differ; rows of one id
    and text are one document, which keeps its lines in each of them. An empty table gives
    no rows; other columns are not read.
    """
    found = _documents(docs, similar, least_words)
    gone = found.select(*DOCUMENT, F.explode("gone").alias("line")).distinct()
    return found.select(*DOCUMENT, "n_lines"), gone


def line_report(docs: DataFrame, similar: int = SIMILAR) -> DataFrame:
    """doc_id, n_lines, n_removed and removed (numbers from 0, joined by commas) of every row.

    Which lines those are, and what becomes of nulls, repeats and ties, is said by
    ``matched_lines``.
    """
    return _documents(docs, similar, LEAST_WORDS).select(
        F.expr(f"nullif(doc_id, {NO_ID})").alias("doc_id"),
        F.col("n_lines").cast("long").alias("n_lines"),
        F.size("gone").cast("long").alias("n_removed"),
        F.array_join("gone", ",").alias("removed"),
    )


def drop_lines(docs: DataFrame, similar: int = SIMILAR) -> DataFrame:
    """``docs`` without the lines that go (``matched_lines``); its columns, and rows, are as they were.

    A null text, and a row whose every line stays, is not touched.
    """
    listed = store(
        _documents(docs, similar, LEAST_WORDS).where("size(gone) > 0").select(
            F.col("doc_id").alias("__doc"), F.col("text_hash").alias("__hash"), F.col("gone").alias("__gone")
        ).dropDuplicates(["__doc", "__hash"]),
        "gone-lines",
    )
    doc_id = F.coalesce(docs["doc_id"].cast("long"), F.lit(NO_ID))
    own = (doc_id == F.col("__doc")) & (F.xxhash64(docs["text"]) == F.col("__hash"))
    joined = docs.join(small_side(listed), own, "left")
    kept = F.expr(
        "if(__gone is null, text, array_join(transform(filter(transform(split(text, '\\n'),"
        " (l, i) -> struct(i, l)), x -> not array_contains(__gone, x.i)), x -> x.l), '\\n'))"
    )
    return joined.select(
        *[kept.alias(c) if c.lower() == "text" else docs[f"`{c}`"] for c in docs.columns]
    )
