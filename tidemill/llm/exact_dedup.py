"""Exact duplicates by an index of cuckoo filters over bucketed digests.

Digests are dealt to buckets. A bucket has a cuckoo filter of 16-bit
fingerprints, which answers most questions, and the content it stands for: one
row for each live digest, with its number of copies. A filter hit is only a hint; it is
verified against the content. A filter that overflows is built anew with twice the
room from the stored digests. The index is a keyed catalog table: a batch of
insertions or deletions rewrites the partitions of the buckets that it touches, all at
once, and the next program opens the table by its name. When digests become too many,
buckets are split in two, each partition's when it is next touched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm.common import SPACE, one_of_each, rows_with, store, text_or_empty
from tidemill.sources import keyed

#: Live digests that a bucket is laid out for.
BUCKET_KEYS = 4096
#: Partitions of an index, a power of two: bucket b lies in partition b modulo these.
PARTITIONS = 64
#: Fingerprints in one slot of a filter, and moves before it counts as full.
SLOT, MOVES = 4, 200
#: Entries that a task gathers before it hands on what it has summed up.
GATHER = 50_000

CONTENT = [
    ("digest", pa.binary()),
    ("rows", pa.int64()),
    ("points", pa.int64()),
    ("keep_id", pa.int64()),
    ("keep_hash", pa.int64()),
    ("keep_rows", pa.int64()),
]
#: A row is a live digest, or (digest null, rows the bucket's live digests) the filter of its bucket.
STATE = pa.schema(
    [("bucket", pa.int64()), *CONTENT, ("buckets", pa.int64()), ("slots", pa.int64()), ("filter", pa.binary())]
)
CONTENT_DDL = "digest binary, rows long, points long, keep_id long, keep_hash long, keep_rows long"
STATE_DDL = f"bucket long, {CONTENT_DDL}, buckets long, slots long, filter binary"


class CuckooFilter:
    """Two possible slots of four 16-bit fingerprints for each digest; 0 is an empty place."""

    def __init__(self, slots: int, table: np.ndarray | None = None):
        self.slots = slots  # a power of two
        self.table = np.zeros((slots, SLOT), np.uint16) if table is None else table

    @staticmethod
    def sized_for(keys: int) -> CuckooFilter:
        """Room for ``keys`` at four fifths of the places."""
        return CuckooFilter(1 << max(2, (keys * 5 // 4 // SLOT).bit_length()))

    def _places(self, digest: bytes) -> tuple[int, int]:
        mark = int.from_bytes(digest[:2], "little") or 1
        return mark, int.from_bytes(digest[2:8], "little") & (self.slots - 1)

    def _other(self, slot: int, mark: int) -> int:
        return slot ^ (mark * 0x5BD1E995 & (self.slots - 1))

    def contains(self, digest: bytes) -> bool:
        mark, slot = self._places(digest)
        return mark in self.table[slot] or mark in self.table[self._other(slot, mark)]

    def insert(self, digest: bytes) -> bool:
        """False if there was no room; the filter has then to be built anew."""
        mark, slot = self._places(digest)
        for at in (slot, self._other(slot, mark)):
            free = np.flatnonzero(self.table[at] == 0)
            if len(free):
                self.table[at, free[0]] = mark
                return True
        at = self._other(slot, mark)
        for move in range(MOVES):
            place = move % SLOT
            mark, self.table[at, place] = int(self.table[at, place]), mark
            at = self._other(at, mark)
            free = np.flatnonzero(self.table[at] == 0)
            if len(free):
                self.table[at, free[0]] = mark
                return True
        return False

    def delete(self, digest: bytes) -> bool:
        mark, slot = self._places(digest)
        for at in (slot, self._other(slot, mark)):
            found = np.flatnonzero(self.table[at] == mark)
            if len(found):
                self.table[at, found[0]] = 0
                return True
        return False

    @staticmethod
    def of(digests, slots: int) -> CuckooFilter:
        """A filter over ``digests`` with ``slots`` slots, or as often doubled as they need."""
        while True:
            built = CuckooFilter(slots)
            if all(built.insert(d) for d in digests):
                return built
            slots *= 2


def _better(a: list, b: list) -> bool:
    """Whether row ``a`` (points, id, hash) stays rather than ``b``: longer, smaller id, smaller hash."""
    key = lambda r: (r[0] is None, -(r[0] or 0), r[1] is None, r[1] or 0, r[2])
    return key(a) < key(b)


def _merge(into: list, more: list) -> None:
    """Add the group ``more`` [rows, points, keep_id, keep_hash, keep_rows] to ``into``."""
    into[0] += more[0]
    if into[1:4] == more[1:4]:
        into[4] += more[4]
    elif _better(more[1:4], into[1:4]):
        into[1:] = more[1:]


def _take(out_of: list, less: list) -> None:
    """Take the group ``less`` out of ``out_of``; if all rows of the one that stays go, none is known."""
    out_of[0] -= less[0]
    if out_of[1:4] == less[1:4]:
        out_of[4] -= less[4]
        if out_of[4] <= 0:
            out_of[1:] = [None, None, None, 0]


def _table(entries: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*entries, strict=True) if entries else [[] for _ in schema]
    return pa.RecordBatch.from_arrays(
        [pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema
    )


def _gathered(by_row: bool):
    """Sums up equal digests (``by_row``: of equal rows) of a task, a bounded number at a time."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> pa.RecordBatch:
            return _table([(key[0], *entry) for key, entry in seen.items()], pa.schema(CONTENT))

        seen: dict[tuple, list] = {}
        for batch in batches:
            for digest, points, doc_id, text_hash in zip(
                *(batch.column(i).to_pylist() for i in range(4)), strict=True
            ):
                entry = [1, points, doc_id, text_hash, 1]
                key = (digest, doc_id, text_hash) if by_row else (digest,)
                if key in seen:
                    _merge(seen[key], entry)
                else:
                    if len(seen) >= GATHER:
                        yield out()
                        seen = {}
                    seen[key] = entry
        yield out()

    return gather


def gathered(digests: DataFrame, by_row: bool = False) -> DataFrame:
    """Rows of ``digest_rows`` as groups of equal digests, as far as a task has them at hand."""
    chosen = digests.select("digest", "points", "doc_id", "text_hash")
    return chosen.mapInArrow(_gathered(by_row), CONTENT_DDL)


def _read_bucket(state: pa.Table, buckets: int) -> tuple[dict[bytes, list], CuckooFilter | None]:
    """Content and filter of a bucket; a filter of fewer buckets than there are now is of no use."""
    content, index = {}, None
    for row in state.to_pylist():
        if row["digest"] is not None:
            content[row["digest"]] = [row[name] for name, _ in CONTENT[1:]]
        elif row["buckets"] == buckets:
            table = np.frombuffer(row["filter"], np.uint16).reshape(-1, SLOT).copy()
            index = CuckooFilter(row["slots"], table)
    if index is None and content:
        index = CuckooFilter.of(content, CuckooFilter.sized_for(len(content)).slots)
    return content, index


def _write_bucket(
    bucket: int, content: dict[bytes, list], index: CuckooFilter, buckets: int
) -> pa.Table:
    rows = [(bucket, d, *entry, buckets, None, None) for d, entry in content.items()]
    none = [None] * 4
    rows.append((bucket, None, len(content), *none, buckets, index.slots, index.table.tobytes()))
    return pa.Table.from_batches([_table(rows, STATE)])


def _groups(arrivals: pa.Table) -> Iterator[tuple[bytes, list]]:
    digests = arrivals.column("digest").to_pylist()
    entries = zip(*(arrivals.column(name).to_pylist() for name, _ in CONTENT[1:]), strict=True)
    for digest, entry in zip(digests, entries, strict=True):
        yield digest, list(entry)


def _insert(buckets: int):
    def insert(key: tuple, state: pa.Table, arrivals: pa.Table) -> pa.Table:
        content, index = _read_bucket(state, buckets)
        index = index or CuckooFilter.sized_for(len(arrivals))
        for digest, entry in _groups(arrivals):
            if index.contains(digest) and digest in content:  # a hit counts if the content has it
                _merge(content[digest], entry)
                continue
            content[digest] = entry
            if not index.insert(digest):
                index = CuckooFilter.of(content, index.slots * 2)
        return _write_bucket(key[0].as_py(), content, index, buckets)

    return insert


def _delete(buckets: int):
    def delete(key: tuple, state: pa.Table, arrivals: pa.Table) -> pa.Table:
        content, index = _read_bucket(state, buckets)
        index = index or CuckooFilter.sized_for(1)
        for digest, entry in _groups(arrivals):
            if index.contains(digest) and digest in content:
                _take(content[digest], entry)
                if content[digest][0] <= 0:
                    del content[digest]
                    index.delete(digest)
        return _write_bucket(key[0].as_py(), content, index, buckets)

    return delete


def bucket_of(buckets: int) -> Column:
    return F.pmod(F.xxhash64("digest"), F.lit(buckets))


def changed(state: DataFrame, groups: DataFrame, change, buckets: int) -> DataFrame:
    """``state`` after ``change`` took ``groups`` in, with so many buckets, whatever it had before."""
    dealt = F.when(F.col("digest").isNotNull(), bucket_of(buckets)).otherwise(F.col("bucket"))
    placed = state.withColumn("bucket", dealt)
    # filters of fewer buckets are made anew from the content
    placed = placed.where((F.col("buckets") == buckets) | F.col("digest").isNotNull())
    arrivals = groups.withColumn("bucket", bucket_of(buckets))
    return (
        placed.groupBy("bucket").cogroup(arrivals.groupBy("bucket")).applyInArrow(change(buckets), STATE_DDL)
    )


def _hits(batch_key: tuple, filters: pa.Table, digests: pa.Table) -> pa.Table:
    """The digests that a bucket's filter may hold."""
    found = []
    if len(filters):
        row = filters.to_pylist()[0]
        index = CuckooFilter(row["slots"], np.frombuffer(row["filter"], np.uint16).reshape(-1, SLOT))
        found = [d for d in digests.column("digest").to_pylist() if index.contains(d)]
    return pa.table({"digest": pa.array(found, pa.binary())})


class DigestIndex:
    """Live digests, kept in the keyed catalog table ``name``."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.name = spark, name
        keyed.keyed_table(spark, name)

    @staticmethod
    def create(
        spark: SparkSession, name: str, folder: str | None = None, partitions: int = PARTITIONS
    ) -> DigestIndex:
        """A new index without digests; ``partitions`` is a power of two."""
        nothing = spark.createDataFrame([], STATE_DDL)
        keyed.create_keyed(nothing, name, ["bucket"], f"pmod(bucket, {partitions})", folder, unique=False)
        return DigestIndex(spark, name)

    def state(self) -> DataFrame:
        return self.spark.table(self.name)

    def _partitions(self) -> int:
        return int(keyed.keyed_table(self.spark, self.name).part.rsplit(", ", 1)[1].rstrip(")"))

    def _buckets(self, more: int = 0) -> int:
        """Buckets that the live digests and ``more`` are dealt to: as many as ever, or doubled."""
        filters = self.state().where("digest is null")
        live, buckets = filters.agg(F.sum("rows"), F.max("buckets")).first()
        buckets = buckets or self._partitions()
        while (live or 0) + more > buckets * BUCKET_KEYS:
            buckets *= 2
        return buckets

    def _apply(self, groups: DataFrame, change, buckets: int) -> None:
        keyed.load_keyed(
            self.spark, self.name, groups.withColumn("bucket", bucket_of(buckets)),
            lambda state, arrivals: changed(state, arrivals.drop("bucket"), change, buckets),
        )

    def insert(self, digests: DataFrame) -> None:
        """Add the rows of ``digest_rows``; groups of equal digests grow."""
        groups = store(gathered(digests), "digest-groups")
        self._apply(groups, _insert, self._buckets(groups.count()))

    def delete(self, digests: DataFrame) -> None:
        """Take these rows, which have been inserted, out; a digest without rows is live no more.

        Where the row that stays goes and others are left, none is known (``keep_id``
        and ``points`` null) until ``settle``. Unknown digests are passed over.
        """
        self._apply(store(gathered(digests, by_row=True), "digest-groups"), _delete, self._buckets())

    def settle(self, digests: DataFrame) -> None:
        """Choose the row that stays, of the rows that are left, for digests that know none."""
        open_ones = self.content().where("points is null").select("digest", F.col("rows").alias("left"))
        groups = store(gathered(digests.join(open_ones.select("digest"), "digest", "left_semi")), "settled")
        # the rows are counted already
        self._apply(groups.withColumn("rows", F.lit(0).cast("long")), _insert, self._buckets())

    def content(self) -> DataFrame:
        """One row for each live digest: its rows and the one that stays."""
        return self.state().where("digest is not null").drop("bucket", "buckets", "slots", "filter")

    def lookup(self, digests: DataFrame) -> DataFrame:
        """``digests`` with the columns of ``content``; null where the digest isn't live.

        Filters are asked first, and content is only joined for their hits.
        """
        state = self.state()
        asked = digests.select("digest").distinct()
        sizes = [r[0] for r in state.where("digest is null").select("buckets").distinct().collect()]
        hits = [
            state.where((F.col("buckets") == n) & F.col("digest").isNull()).select("bucket", "slots", "filter")
            .groupBy("bucket").cogroup(asked.withColumn("bucket", bucket_of(n)).groupBy("bucket"))
            .applyInArrow(_hits, "digest binary")
            for n in sizes
        ]
        found = self.content()
        if hits:
            likely = hits[0]
            for more in hits[1:]:
                likely = likely.union(more)
            found = found.join(likely.distinct(), "digest", "left_semi")
        return digests.join(found, "digest", "left")


def digest_rows(docs: DataFrame) -> DataFrame:
    """doc_id, digest, code points and text hash of every row; a null text counts as empty.

    The digest is SHA-256 of the text without white space.
    """
    bare = F.regexp_replace(text_or_empty(), SPACE, "")
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.unhex(F.sha2(bare, 256)).alias("digest"),
        F.length(text_or_empty()).cast("long").alias("points"),
        F.xxhash64("text").alias("text_hash"),
    )


def exact_groups(docs: DataFrame) -> DataFrame:
    """One row for each row of ``docs``, dropped ones too, with the row of its group that stays.

    Of equal texts stays the one of most code points, then of the smallest id; a
    null id comes after all others. Rows that repeat the id and text of the row
    that stays say that they stay as well. An empty table gives an empty result.
    """
    rows = store(digest_rows(docs), "digests")
    buckets = max(1, -(-rows.count() // BUCKET_KEYS))
    nothing = docs.sparkSession.createDataFrame([], STATE_DDL)
    state = store(changed(nothing, gathered(rows), _insert, buckets), "digest-index")
    live = state.where("digest is not null").drop("bucket", "buckets", "slots", "filter")
    return rows.join(live, "digest", "left").withColumn(
        "kept",
        F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("text_hash") == F.col("keep_hash")),
    )


def drop_exact_duplicates(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each group of equal texts, its columns as they were."""
    groups = store(
        exact_groups(docs).where("rows > 1").select(
            F.col("doc_id").alias("row_id"), F.col("text_hash").alias("row_hash"),
            "kept", "keep_rows",
        ),
        "exact-groups",
    )
    left = rows_with(docs, groups.where("not kept"), "left_anti")
    repeated = groups.where("kept and keep_rows > 1").select("row_id", "row_hash").distinct()
    if repeated.isEmpty():
        return left
    repeated = store(repeated, "repeated-rows")
    return rows_with(left, repeated, "left_anti").union(
        one_of_each(rows_with(left, repeated, "left_semi"))
    )
