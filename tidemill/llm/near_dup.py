"""Near duplicates by one-permutation MinHash, and their connected components.

Each document's distinct five-word shingles are hashed once. The hash's top bits name
one of 128 bins, whose minimum is the signature there; an empty bin takes over the
value of a full one, which it finds by a random walk of its own over the bins
(optimal densification). Bands of four bins are buckets. Documents of equal sets
are one class and take part once.

A bucket gives star-shaped edges: its members to one centre, so pairs grow as
members do. Each edge is confirmed on the full sets, and components are merged
before the next star, whose centre is another one, links what is still apart. What
three stars leave apart inside a bucket goes through an exact prefix-filtered join
that looks only at pairs of different components. So no link between members of a
bucket is lost, and at a similarity of 0.75 a pair misses all 32 buckets once in
some 200,000 times.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm.common import one_of_each, rows_with, small_side, store
from tidemill.llm.components import components
from tidemill.llm.hashing import constants, mix, row_blocks, shingle_sets, text_bytes, word_hashes
from tidemill.llm.setjoin import linked, similar_pairs

WIDTH = 5
#: Links have at least this share of shingles, in hundredths of the union.
SIMILAR = 75
BINS, BANDS = 128, 32
STARS = 3

SIGNED = "doc_id long, text_hash long, n_shingles long, set_a long, set_b long, bands array<long>"
SETS = "doc_id long, n long, tokens array<long>"


def walks(bins: int) -> np.ndarray:
    """For each bin the order in which it looks at all bins, fixed once for all."""
    return np.random.default_rng(1).permuted(np.tile(np.arange(bins), (bins, 1)), axis=1)


def signatures(sets: np.ndarray, counts: np.ndarray, bins: int = BINS) -> np.ndarray:
    """Densified minima of each row's sorted set; rows without elements stay all ones."""
    empty = np.uint64(0xFFFFFFFFFFFFFFFF)
    rows = np.repeat(np.arange(len(counts)), counts)
    at = (sets >> np.uint64(64 - bins.bit_length() + 1)).astype(np.int64)
    first = np.ones(len(sets), bool)
    first[1:] = (at[1:] != at[:-1]) | (rows[1:] != rows[:-1])
    found = np.full((len(counts), bins), empty)
    found[rows[first], at[first]] = sets[first]
    full = np.zeros(found.shape, bool)
    full[rows[first], at[first]] = True
    dense, order = found.copy(), walks(bins)
    row, place = np.nonzero(~full & (counts > 0)[:, None])
    for step in range(bins):
        if not len(row):
            break
        look = order[place, step]
        hit = full[row, look]
        dense[row[hit], place[hit]] = found[row[hit], look[hit]]
        row, place = row[~hit], place[~hit]
    return dense


def band_hashes(dense: np.ndarray, bands: int = BANDS) -> np.ndarray:
    width = dense.shape[1] // bands
    cut = dense[:, : bands * width].reshape(len(dense), bands, width)
    total = (mix(cut) * constants(width, 7)).sum(axis=2, dtype=np.uint64)
    return mix(total + constants(bands, 9))


def _lists(values: np.ndarray, counts: np.ndarray) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.view(np.int64)))


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, bounds = text_bytes(batch.column(2))
        for start, end in row_blocks(bounds):
            hashes, rows = word_hashes(data, bounds[start : end + 1], lower=True)
            sets, counts = shingle_sets(hashes, rows, end - start, WIDTH)
            ends = np.concatenate([[np.uint64(0)], np.cumsum(mix(sets))])
            set_a = np.diff(ends[np.concatenate([[0], np.cumsum(counts)])])
            ends = np.concatenate([[np.uint64(0)], np.cumsum(mix(sets + np.uint64(1)))])
            set_b = np.diff(ends[np.concatenate([[0], np.cumsum(counts)])])
            bands = band_hashes(signatures(sets, counts))[counts > 0]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).slice(start, end - start),
                    batch.column(1).slice(start, end - start),
                    pa.array(counts),
                    pa.array(set_a.view(np.int64)),
                    pa.array(set_b.view(np.int64)),
                    _lists(bands.reshape(-1), np.where(counts > 0, BANDS, 0)),
                ],
                names=["doc_id", "text_hash", "n_shingles", "set_a", "set_b", "bands"],
            )


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, bounds = text_bytes(batch.column(1))
        for start, end in row_blocks(bounds):
            hashes, rows = word_hashes(data, bounds[start : end + 1], lower=True)
            sets, counts = shingle_sets(hashes, rows, end - start, WIDTH)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(start, end - start), pa.array(counts), _lists(sets, counts)],
                names=["doc_id", "n", "tokens"],
            )


def _confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of ``pairs`` (a, b, comp_a, comp_b) whose full sets are similar."""
    left = sets.select(F.col("doc_id").alias("a"), F.col("tokens").alias("tokens_a"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("tokens").alias("tokens_b"))
    return pairs.join(left, "a").join(right, "b").where(linked("tokens_a", "tokens_b", SIMILAR))


def _merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels`` (doc_id, comp) after the components that ``links`` connect became one."""
    roots = components(links.select(F.col("comp_a").alias("a"), F.col("comp_b").alias("b")))
    roots = roots.select(F.col("node").alias("comp"), "label")
    return store(
        labels.join(roots, "comp", "left").select(
            "doc_id", F.coalesce("label", "comp").alias("comp")
        ),
        "labels",
    )


def _members(classes: DataFrame) -> DataFrame:
    """key, doc_id and n of the classes that share a bucket with another one."""
    rows = classes.select(F.explode("bands").alias("key"), "doc_id", F.col("n_shingles").alias("n"))
    shared = rows.groupBy("key").agg(F.count("*").alias("size")).where("size > 1").select("key")
    return store(rows.join(shared, "key"), "buckets")


def _star_pairs(buckets: DataFrame, turn: int) -> DataFrame:
    """Members of each bucket that holds several components, each with the bucket's centre."""
    heads = (
        buckets.groupBy("key")
        .agg(
            F.min(F.struct(F.xxhash64("doc_id", F.lit(turn)), "doc_id", "comp", "n")).alias("head"),
            F.min("comp").alias("least"),
            F.max("comp").alias("most"),
        )
        .where("least < most")
        .select(
            "key", F.col("head.doc_id").alias("a"), F.col("head.comp").alias("comp_a"),
            F.col("head.n").alias("n_a"),
        )
    )
    return (
        buckets.join(heads, "key")
        .where(f"comp <> comp_a and least(n, n_a) * 100 >= {SIMILAR} * greatest(n, n_a)")
        .select("a", F.col("doc_id").alias("b"), "comp_a", F.col("comp").alias("comp_b"))
        .distinct()
    )


def _labels(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """doc_id and component of every class that shares a bucket."""
    members = _members(classes)
    ids = store(members.select("doc_id").distinct(), "candidates")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sets = store(
        texts.join(small_side(ids), "doc_id", "left_semi").mapInArrow(_sets, SETS), "sets"
    )
    labels = ids.withColumn("comp", F.col("doc_id"))
    for turn in range(STARS):
        pairs = store(_star_pairs(members.join(labels, "doc_id"), turn), "pairs")
        if pairs.isEmpty():
            return labels
        labels = _merged(labels, _confirmed(pairs, sets))
    buckets = members.join(labels, "doc_id")
    apart = buckets.groupBy("key").agg(F.min("comp").alias("x"), F.max("comp").alias("y"))
    rest = store(
        buckets.join(apart.where("x < y").select("key"), "key").select("doc_id", "comp").distinct(),
        "apart",
    )
    if rest.isEmpty():
        return labels
    found = similar_pairs(
        sets.join(rest, "doc_id").select(F.col("doc_id").alias("id"), "comp", "n", "tokens"), SIMILAR
    )
    return _merged(labels, found)


def near_groups(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, n_shingles and component of every row of ``docs``.

    Documents whose sets of shingles overlap by 75 hundredths of their union or more
    are linked; a component's id is the smallest doc_id that links reach. Null and
    empty texts and texts without words have no shingles and are linked with nothing.
    Rows that repeat a doc_id are one document with the links of all its texts. A row
    without an id has no component and is linked with nothing. An empty table gives no
    rows; other columns are not read.
    """
    signed = store(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text"
        ).mapInArrow(_signed, SIGNED),
        "signatures",
    )
    linkable = signed.where("doc_id is not null and n_shingles > 0")
    same = ["set_a", "set_b", "n_shingles"]
    classes = linkable.groupBy(*same).agg(F.min("doc_id").alias("rep"))
    reps = store(
        linkable.join(classes.withColumnRenamed("rep", "doc_id"), [*same, "doc_id"], "left_semi")
        .dropDuplicates(["doc_id", *same])
        .select("doc_id", "n_shingles", "bands"),
        "classes",
    )
    labels = _labels(docs, reps)
    # a document's class, the class's component, and classes that a repeated id joins
    known = linkable.join(classes, same).select("doc_id", "rep").distinct()
    joined = known.join(
        labels.select(F.col("doc_id").alias("rep"), "comp"), "rep", "left"
    ).select("doc_id", F.coalesce("comp", "rep").alias("comp"))
    named = store(joined.distinct(), "documents")
    several = named.groupBy("doc_id").agg(F.min("comp").alias("x"), F.max("comp").alias("y"))
    several = several.where("x < y").select("doc_id")
    if not several.isEmpty():
        links = named.join(several, "doc_id").select(
            F.col("doc_id").alias("comp_a"), F.col("comp").alias("comp_b")
        )
        named = _merged(named, links).distinct()
    least = named.groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    ids = named.join(least, "comp").select("doc_id", "component_id").distinct()
    return signed.select("doc_id", "text_hash", "n_shingles").join(ids, "doc_id", "left").withColumn(
        "component_id", F.coalesce("component_id", "doc_id")
    )


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each component, its columns as they were.

    Rows without an id stay. Of rows that repeat the id that stays, one stays.
    """
    groups = store(
        near_groups(docs).select(
            F.col("doc_id").alias("row_id"), F.col("text_hash").alias("row_hash"),
            (F.col("doc_id") != F.col("component_id")).alias("goes"),
        ),
        "near-groups",
    )
    gone = store(groups.where("goes").select("row_id", "row_hash").distinct(), "near-copies")
    left = rows_with(docs, gone, "left_anti")
    repeated = groups.where("row_id is not null").groupBy("row_id").agg(
        F.count("*").alias("n"), F.min("row_hash").alias("one")
    ).where("n > 1")
    repeated = store(
        groups.join(repeated.select("row_id", "one"), "row_id").where("not goes")
        .select("row_id", "row_hash", "one").distinct(),
        "repeated-ids",
    )
    if repeated.isEmpty():
        return left
    first = repeated.where("row_hash = one")
    return rows_with(left, repeated, "left_anti").union(
        one_of_each(rows_with(left, first, "left_semi"))
    )
