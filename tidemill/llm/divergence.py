"""Divergence of sources: how each source's use of terms differs from other sources and its language.

Every task points at the beginnings of terms in its Arrow buffers and sorts the
pointers, eight bytes at a time, by multikey quicksort: slices are parted around a
pivot, and only terms that are equal so far are compared by their next eight bytes.
Runs of equal terms give the number of documents and the counts by source. What tasks
have found is added up by Spark; all arithmetic is on whole numbers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemill.llm.common import store
from tidemill.llm.hashing import text_bytes
from tidemill.llm.token_counts import balanced

#: Documents of a language that a term has to be in.
LEAST_DOCS = 3
#: What probabilities are given in, and the ranks that are listed of terms.
UNIT, TOP_TERMS = 1_000_000_000, 200
#: Bytes of text that are sorted at a time; pointers, keys and counts take some 17 times as much.
SHARD_BYTES = 4 << 20
#: Bits of a value that are summed apart from the others.
LOW_BITS = 24
#: Slices of up to so many pointers are sorted without a pivot.
SMALL = 2048

COUNTED = "lang string, source string, term string, n long, docs long"

#: The byte that stands for a byte of a term, else 0: letters as lower case, and bytes beyond ASCII.
_TERM = np.zeros(256, np.uint8)
for _code in range(256):
    if _code >= 128 or chr(_code).isalpha():
        _TERM[_code] = _code | 32 if _code < 128 else _code


def pointers(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of terms (0 between them, eight at the end), and each term's start, length and row."""
    data = _TERM[data[bounds[0] : bounds[-1]]]
    bounds = bounds - bounds[0]
    inside = data != 0
    first = np.ones(len(data) + 1, bool)
    first[1:] = np.append(~inside, True)[:-1]
    first[bounds] = True
    starts = np.flatnonzero(inside & first[:-1])
    ends = np.flatnonzero(inside & (np.append(~inside, True)[1:] | first[1:])) + 1
    rows = np.searchsorted(bounds, starts, "right") - 1
    return np.append(data, np.zeros(8, np.uint8)), starts, ends - starts, rows


def term_runs(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pointers in the order of their terms, and where runs of equal terms begin.

    Equal terms stay in the order they came in.
    """
    # the eight bytes from any place on, as a number that sorts like them
    eights = np.ndarray((len(data) - 7,), ">u8", data.tobytes(), strides=(1,))
    order = np.arange(len(starts))
    begins: list[np.ndarray] = []
    if not len(starts):
        return order, np.zeros(0, np.int64)

    def keys(picked: np.ndarray, depth: int) -> np.ndarray:
        left = lengths[picked] - depth
        shift = ((8 - np.minimum(np.maximum(left, 1), 8)) << 3).astype(np.uint64)
        found = (eights[starts[picked] + np.minimum(depth, lengths[picked] - 1)].astype(np.uint64) >> shift) << shift
        # a term that has ended comes first, as none has a byte of 0
        found[left <= 0] = 0
        return found

    # slices (place, pointers, keys at the depth, depth), the last one first
    waiting = [(0, order.copy(), keys(order, 0), 0)]
    while waiting:
        place, picked, key, depth = waiting.pop()
        if len(picked) <= SMALL:
            # all runs of the slice that are equal so far go on together
            places, run = place + np.arange(len(picked)), np.zeros(len(picked), np.int64)
            while len(picked):
                by_key = np.lexsort((key, run))
                picked, key = picked[by_key], key[by_key]
                order[places] = picked
                new = np.ones(len(key), bool)
                new[1:] = (key[1:] != key[:-1]) | (run[1:] != run[:-1])
                edges = np.flatnonzero(new)
                sizes = np.diff(np.append(edges, len(key)))
                deeper = (sizes > 1) & (np.maximum.reduceat(lengths[picked], edges) > depth + 8)
                begins.append(places[edges[~deeper]])
                again = np.repeat(deeper, sizes)
                picked, places = picked[again], places[again]
                run = np.repeat(np.arange(len(sizes)), sizes)[again]
                depth += 8
                key = keys(picked, depth)
            continue
        some = key[:: len(key) // 64 + 1]
        pivot = np.partition(some, len(some) // 2)[len(some) // 2]
        for part in (key < pivot, key == pivot, key > pivot):
            own = picked[part]
            if not len(own):
                continue
            if key[part][0] != pivot:
                waiting.append((place, own, key[part], depth))
            elif (lengths[own] > depth + 8).any():
                waiting.append((place, own, keys(own, depth + 8), depth + 8))
            else:
                order[place : place + len(own)] = own
                begins.append(np.array([place]))
            place += len(own)
    return order, np.sort(np.concatenate(begins))


def _counted(shard_bytes: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = pc.binary_length(batch.column(0)).to_numpy(zero_copy_only=False)
            offsets = np.concatenate([[0], np.cumsum(lengths.astype(np.int64))])
            for start, end in balanced(offsets, shard_bytes):
                yield _shard(batch.slice(start, end - start))

    return count


def _shard(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Terms of one shard by group, and a row without a term for each group's documents."""
    groups = pa.StructArray.from_arrays([batch.column(1), batch.column(2)], names=["lang", "source"])
    names = sorted({tuple(g.values()) for g in groups.to_pylist()})
    number = {name: i for i, name in enumerate(names)}
    group_of = np.array([number[tuple(g.values())] for g in groups.to_pylist()], np.int64)
    data, starts, lengths, rows = pointers(*text_bytes(batch.column(0)))
    order, begins = term_runs(data, starts, lengths)
    # in a run, pointers are in the order of documents
    run = np.zeros(len(order), np.int64)
    run[begins[1:]] = 1
    run = np.cumsum(run)
    row = rows[order]
    new_doc = np.ones(len(order), bool)
    new_doc[1:] = (run[1:] != run[:-1]) | (row[1:] != row[:-1])
    cell = run * len(names) + group_of[row]
    cells, place = np.unique(cell, return_inverse=True)
    counts = np.bincount(place, minlength=len(cells))
    docs = np.bincount(place[new_doc], minlength=len(cells))
    heads = order[begins]
    spelt = [data[s : s + n].tobytes() for s, n in zip(starts[heads].tolist(), lengths[heads].tolist(), strict=True)]
    terms = pa.array(spelt, pa.binary()).cast(pa.string())
    in_group = np.concatenate([cells % len(names), np.arange(len(names))])
    none = pa.nulls(len(names), pa.string())
    return pa.RecordBatch.from_arrays(
        [
            pa.array([n[0] for n in names], pa.string()).take(pa.array(in_group)),
            pa.array([n[1] for n in names], pa.string()).take(pa.array(in_group)),
            pa.concat_arrays([terms.take(pa.array(cells // len(names))), none]),
            pa.array(np.concatenate([counts, np.zeros(len(names), np.int64)])),
            pa.array(np.concatenate([docs, np.bincount(group_of, minlength=len(names))])),
        ],
        names=["lang", "source", "term", "n", "docs"],
    )


def term_counts(docs: DataFrame, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """lang, source, term, n (occurrences) and docs (rows that have it), for each source's terms.

    Terms are runs of ASCII letters, taken as lower case, and of characters beyond ASCII.
    A row with a null term gives the rows of the source. Null texts, languages and sources
    are read as empty ones; every row counts as a document, repeated ones and ones without
    an id too; other columns are not read.
    """
    chosen = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("text", "lang", "source")])
    found = chosen.mapInArrow(_counted(shard_bytes), COUNTED)
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def kept_terms(counts: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """Of ``term_counts`` the terms in enough documents of the language, with their count there (``total``).

    A window has one row for each source of the language.
    """
    together = Window.partitionBy("lang", "term")
    summed = counts.where("term is not null").withColumns(
        {"total": F.sum("n").over(together), "lang_docs": F.sum("docs").over(together)}
    )
    return summed.where(F.col("lang_docs") >= least_docs).select(
        "lang", "source", "term", "n", "total", "docs", "lang_docs"
    )


def probability(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(UNIT * (n + 1) / (total + terms)), exactly."""
    scaled = (n + 1).cast("decimal(20,0)") * F.lit(UNIT).cast("decimal(10,0)")
    # without terms there is nothing to sum up, whatever this gives
    return F.call_function("div", scaled, F.greatest(total + terms, F.lit(1)).cast("decimal(20,0)")) + 1


def excess(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / q), exactly."""
    return F.call_function("div", (p - q) * (p - q), q)


def _exact_sum(value: Column) -> Column:
    return F.sum(value.cast("decimal(38,0)"))


def divergence(docs: DataFrame, least_docs: int = LEAST_DOCS, top_terms: int = TOP_TERMS) -> DataFrame:
    """How each (lang, source) differs: parts ``pair`` (from other sources) and ``term`` (its terms).

    With p for a source's probability of a term and q for what it is compared with, an
    item's value is floor((p - q)^2 / q): summed over all kept terms for each other
    source of the language, and by itself for the terms that the source uses more than
    its language, of which ``top_terms`` are listed. Higher values come first, then
    items in the order of their bytes. Sources without kept terms are compared too; an
    empty table gives no rows. Null, repeated and clashing columns: see ``term_counts``.
    """
    counts = store(term_counts(docs), "term-counts")
    kept = store(kept_terms(counts, least_docs), "kept-terms")
    # rows for languages and sources, few beside the terms
    langs = kept.groupBy("lang").agg(
        F.sum("n").alias("lang_n"), F.count_distinct("term").alias("terms")
    )
    own = kept.groupBy("lang", "source").agg(F.sum("n").alias("source_n"))
    sources = store(
        counts.where("term is null").select("lang", "source")
        .join(own, ["lang", "source"], "left")
        .join(langs, "lang", "left")
        .select("lang", "source", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("source_n", "lang_n", "terms")]),
        "sources",
    )
    rated = store(
        kept.join(sources, ["lang", "source"]).select(
            "lang", "source", "term", "n",
            probability(F.col("n"), F.col("source_n"), F.col("terms")).alias("p"),
            probability(F.col("total"), F.col("lang_n"), F.col("terms")).alias("q"),
        ),
        "rated-terms",
    )
    parts = pair_values(rated, sources).unionByName(term_values(rated, top_terms))
    return parts.select("lang", "source", "part", "item", "value", "rank")


def term_values(rated: DataFrame, top_terms: int = TOP_TERMS) -> DataFrame:
    ranks = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    used = rated.where(F.col("p") > F.col("q")).select(
        "lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"),
        excess(F.col("p"), F.col("q")).alias("value"),
    )
    # Spark keeps the first ranks of every task before it shuffles
    return used.withColumn("rank", F.row_number().over(ranks)).where(F.col("rank") <= top_terms)


def _both_ways(rated: DataFrame, ends: DataFrame) -> DataFrame:
    """For every two sources, what terms that both have add to their values.

    A row of the join has the terms' probabilities in two sources, a before b, and gives
    both directions. Sums are kept in two whole numbers, of the upper and the lower bits.
    """
    sides = rated.join(ends.select("lang", "source", "absent"), ["lang", "source"]).select(
        "lang", "term", "source", "p", "absent"
    )
    a, b = (
        sides.select("lang", "term", *[F.col(c).alias(f"{c}_{x}") for c in ("source", "p", "absent")])
        for x in "ab"
    )

    def mended(x: str, y: str) -> Column:
        p, q, p0, q0 = (F.col(c) for c in (f"p_{x}", f"p_{y}", f"absent_{x}", f"absent_{y}"))
        return excess(p, q) - excess(p, q0) - excess(p0, q) + excess(p0, q0)

    joined = a.join(b, ["lang", "term"]).where("source_a < source_b").select(
        "lang", "source_a", "source_b", mended("a", "b").alias("ab"), mended("b", "a").alias("ba")
    )
    summed = joined.groupBy("lang", "source_a", "source_b").agg(
        *[F.sum(F.shiftright(x, LOW_BITS)).alias(f"{x}_high") for x in ("ab", "ba")],
        *[F.sum(F.col(x).bitwiseAND((1 << LOW_BITS) - 1)).alias(f"{x}_low") for x in ("ab", "ba")],
    )

    def whole(x: str) -> Column:
        high, low = (F.col(f"{x}_{part}").cast("decimal(20,0)") for part in ("high", "low"))
        return (high * F.lit(1 << LOW_BITS).cast("decimal(10,0)") + low).cast("decimal(38,0)").alias("value")

    return summed.select("lang", F.col("source_a").alias("source"), F.col("source_b").alias("item"), whole("ab")).union(
        summed.select("lang", "source_b", "source_a", whole("ba"))
    )


def pair_values(rated: DataFrame, sources: DataFrame) -> DataFrame:
    """Values of every two sources of a language, without a row for terms that neither has.

    A term that a source lacks has the probability ``absent`` there. All terms are first
    taken as lacking in both; then, for one source at a time, as lacking in the other
    only, where terms of one count are one row; and terms of both are put right by
    a join on the term.
    """
    absent = probability(F.lit(0), F.col("source_n"), F.col("terms"))
    ends = sources.select("lang", "source", "terms", absent.alias("absent"))
    pairs = ends.select("lang", "terms", F.col("source").alias("source"), F.col("absent").alias("p0")).join(
        ends.select("lang", F.col("source").alias("item"), F.col("absent").alias("q0")), "lang"
    ).where("source <> item")
    pairs = store(pairs, "source-pairs")
    key = ["lang", "source", "item"]
    none = excess(F.col("p0"), F.col("q0"))
    base = pairs.select(*key, (none.cast("decimal(20,0)") * F.col("terms")).cast("decimal(38,0)").alias("value"))
    alike = rated.groupBy("lang", "source", "p").agg(F.count("*").alias("k"))
    first = pairs.join(alike, ["lang", "source"])
    second = pairs.join(alike.select("lang", F.col("source").alias("item"), F.col("p").alias("q"), "k"), ["lang", "item"])

    def added(rows: DataFrame, value: Column) -> DataFrame:
        return rows.groupBy(*key).agg(_exact_sum(value).alias("value"))

    k = F.col("k").cast("decimal(18,0)")
    ours = added(first, (excess(F.col("p"), F.col("q0")) - none).cast("decimal(20,0)") * k)
    theirs = added(second, (excess(F.col("p0"), F.col("q")) - none).cast("decimal(20,0)") * k)
    both = _both_ways(rated, ends)
    summed = base.unionByName(ours).unionByName(theirs).unionByName(both).groupBy(*key).agg(
        F.sum("value").cast("long").alias("value")
    )
    ranks = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return summed.select(
        "lang", "source", F.lit("pair").alias("part"), "item", "value",
        F.row_number().over(ranks).alias("rank"),
    )
