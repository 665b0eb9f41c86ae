"""Licence texts wherever they stand in a document: windows of a template's size.

A window of as many pairs as the template (t) reaches the coefficient only if it holds
``need`` = ceil(d t) of the template's pairs, so any t - need + 1 of those have one in
it. The longest pairs, which are rare, are these anchors. Only around places where an
anchor stands a window slides, and its pairs are counted as it does.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import pairwise

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm.licenses import LEAST_DICE, TEMPLATES, license_matches
from tidemill.llm.tokens import per_worker

FOUND = "doc_id long, license string, dice long, passages long"


class Scanner:
    """Templates by their anchors; finds the windows of a text."""

    def __init__(self, templates, least_dice: int):
        import regex

        self.word = regex.compile(r"[\p{L}\p{N}]+")
        self.templates, self.anchors = [], {}
        for name, text in templates:
            pairs = Counter(pairwise(self.word.findall(text.lower())))
            size = pairs.total()
            need = -(-size * least_dice // 100)
            self.templates.append((name, pairs, size, need))
            left = size - need + 1
            for pair in sorted(pairs, key=lambda p: (-len(p[0]) - len(p[1]), p)):
                if left <= 0:
                    break
                self.anchors.setdefault(pair, []).append(len(self.templates) - 1)
                left -= pairs[pair]

    def runs(self, text: str) -> list[tuple[str, int]]:
        """Licence and coefficient (millionths) of the windows, of each template one at a place."""
        pairs = list(pairwise(self.word.findall(text.lower())))
        places: dict[int, list[int]] = {}
        for at, pair in enumerate(pairs):
            if pair in self.anchors:
                for i in self.anchors[pair]:
                    places.setdefault(i, []).append(at)
        found = []
        for i, hits in places.items():
            name, wanted, size, need = self.templates[i]
            last = len(pairs) - size
            spans: list[list[int]] = []  # first and last beginnings of windows that hold an anchor
            for at in hits:
                low, high = max(at - size + 1, 0), min(at, last)
                if spans and low <= spans[-1][1] + 1:
                    spans[-1][1] = max(high, spans[-1][1])
                elif low <= high:
                    spans.append([low, high])
            for low, high in spans:
                found += [(name, both * 1_000_000 // size) for both in _best(pairs, wanted, size, need, low, high)]
        return found


def _best(pairs: list, wanted: Counter, size: int, need: int, low: int, high: int) -> Iterator[int]:
    """Shared pairs of the best of each group of overlapping windows that have enough."""
    held: Counter = Counter()
    both, best, until = 0, 0, -1
    for at in range(low, high + size):
        pair = pairs[at]
        if pair in wanted:
            both += held[pair] < wanted[pair]
            held[pair] += 1
        begin = at - size + 1
        if begin < low:
            continue
        if best and begin > until:
            yield best
            best = 0
        if both >= need:
            if not best:
                until = at
            best = max(best, both)
        pair = pairs[begin]
        if pair in wanted:
            held[pair] -= 1
            both -= held[pair] < wanted[pair]
    if best:
        yield best


def _scanned(templates, least_dice: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = per_worker(("licences", templates, least_dice), lambda: Scanner(templates, least_dice))
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows += [(doc_id, *run, 1) for run in scanner.runs(text.as_py())]
            columns = zip(*rows, strict=True) if rows else [()] * 4
            types = [pa.int64(), pa.string(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types, strict=True)],
                names=["doc_id", "license", "dice", "passages"],
            )

    return scan


def license_runs(docs: DataFrame, templates=TEMPLATES, least_dice: int = LEAST_DICE) -> DataFrame:
    """doc_id, license, dice and number of windows for every licence that stands in a document.

    Lines and blocks are not looked at: the words of a text are one run. Overlapping
    windows of a template count once, by the best. A text of fewer pairs than a template
    has no window of its size. Else as ``license_matches``.
    """
    chosen = docs.where("text <> ''").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return (
        chosen.mapInArrow(_scanned(tuple(templates), least_dice), FOUND)
        .groupBy("doc_id", "license")
        .agg(F.max("dice").alias("dice"), F.sum("passages").alias("passages"))
    )


def license_scan(docs: DataFrame, templates=TEMPLATES, least_dice: int = LEAST_DICE) -> DataFrame:
    """doc_id, license, dice and passages of ``license_matches`` and ``license_runs`` together.

    ``dice`` is the highest coefficient of any line, block, text or window. ``passages``
    counts lines, blocks and texts; windows are only counted of a licence that none of
    those shows, since a window mostly lies in one of them.
    """
    units = license_matches(docs, templates, least_dice).withColumn("unit", F.lit(1))
    runs = license_runs(docs, templates, least_dice).withColumn("unit", F.lit(0))
    both = units.unionByName(runs).groupBy("doc_id", "license")
    return both.agg(
        F.max("dice").alias("dice"), F.max_by("passages", "unit").alias("passages")
    )
