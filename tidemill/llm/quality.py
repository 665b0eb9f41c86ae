"""Quality rules: base counts, and how much more a text is like trusted text than like the corpus.

Words and pairs of neighbouring words are hashed into a fixed number of buckets. Two
multinomials over the buckets, one of trusted texts and one of the whole corpus, give
each bucket a log-likelihood ratio, rounded to a whole number of 1/1024. A text's
score is the sum over its words and pairs, compared per word and pair with a
threshold, in whole numbers, so every document is decided alike wherever it is read.

Everything is made of SQL expressions over one row at a time, but for the bucket counts,
which are summed up per task before they are shuffled. The table of weights has one
number per bucket, whatever the input.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm.common import SPACE, small_side, store, text_or_empty

#: Hash buckets of words and pairs.
BUCKETS = 1 << 16
#: Units of the log-likelihood ratio.
UNITS = 1024
#: Last digits of the MD5 of the id whose rows are held out, to set the threshold by texts not fitted on.
HELD_OUT = ("0", "4", "8", "c")
#: Share of the held-out trusted texts that may lie below the threshold, before this margin.
LOW_SHARE, MARGIN = 0.001, 1 / 16
#: Texts with fewer words fail the base rules, as do those with more repeated words than this share.
LEAST_WORDS, REPEATED = 10, 20

WORD = "[^\\x20\\x09-\\x0D]"


def split_words(text: str = "text") -> str:
    """SQL for the words of a text column; null and blank texts have none."""
    blank = "[\\\\x20\\\\x09-\\\\x0D]+"
    return f"array_remove(split(coalesce({text}, ''), '{blank}'), '')"


def codes(buckets: int = BUCKETS) -> str:
    """SQL for the buckets of an array of words, by their CRC-32; ``buckets`` is a power of two."""
    return f"transform(words, w -> cast(crc32(cast(w as binary)) & {buckets - 1} as int))"


def features(buckets: int = BUCKETS) -> str:
    """SQL for the buckets of the words, then those of the pairs of neighbours."""
    pair = f"zip_with(slice(codes, 1, size(codes) - 1), slice(codes, 2, size(codes)), (a, b) -> (a * 31 + b) & {buckets - 1})"
    return f"if(size(codes) < 2, codes, concat(codes, {pair}))"


def worded(docs: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """``docs`` with words, the buckets of the words, and those of words and pairs."""
    return (
        docs.withColumn("words", F.expr(split_words()))
        .withColumn("codes", F.expr(codes(buckets)))
        .withColumn("features", F.expr(features(buckets)))
    )


def trusted_ids(labels: DataFrame) -> DataFrame:
    """All ids that some label calls good and none calls bad or toxic, and whether they are held out."""
    good = labels.where("doc_id is not null").groupBy("doc_id").agg(
        F.min("quality").alias("quality"), F.max("toxic").alias("toxic")
    )
    picked = good.where("quality = 1 and coalesce(toxic, 0) = 0").select("doc_id")
    code = F.md5(F.col("doc_id").cast("string").cast("binary"))
    return picked.withColumn("held_out", F.substring(code, 32, 1).isin(*HELD_OUT))


def bucket_counts(docs: DataFrame, trusted: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """bucket, how often it occurs in ``docs``, and in those trusted and not held out.

    ``trusted`` is a stored table; its ids are broadcast while their bytes allow it.
    """
    fitted_on = small_side(trusted.where("not held_out").select("doc_id"))
    marked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(
        fitted_on.withColumn("trusted", F.lit(1)), "doc_id", "left"
    )
    # the outer form: the plain one would compute the array once more, to filter by its size
    seen = worded(marked, buckets).select("trusted", F.explode_outer("features").alias("bucket"))
    seen = seen.where("bucket is not null")
    return seen.groupBy("bucket").agg(
        F.count("*").alias("corpus"), F.count("trusted").alias("target")
    )


def weights(counts: DataFrame, buckets: int = BUCKETS) -> list[int]:
    """Rounded log-likelihood ratio of every bucket, with one added to each count.

    One row per bucket, a fixed number, comes to the driver.
    """
    total = counts.agg(
        F.coalesce(F.sum("corpus"), F.lit(0)).alias("all_corpus"),
        F.coalesce(F.sum("target"), F.lit(0)).alias("all_target"),
    ).first()
    ratio = F.ln((F.col("target") + 1) / F.lit(float(total.all_target + buckets))) - F.ln(
        (F.col("corpus") + 1) / F.lit(float(total.all_corpus + buckets))
    )
    rows = counts.select("bucket", F.round(ratio * UNITS).cast("int")).collect()
    table = [0] * buckets
    for bucket, weight in rows:
        table[bucket] = weight
    return table


def scored(docs: DataFrame, table: list[int]) -> DataFrame:
    """``docs`` with words, their number, the sum of the weights and the number of features."""
    looked_up = F.from_json(F.lit(json.dumps(table)), "array<int>")
    total = F.aggregate(
        F.col("features"), F.lit(0).cast("long"), lambda sum, bucket: sum + looked_up[bucket]
    )
    return (
        worded(docs, len(table))
        .withColumn("n_words", F.size("words").cast("long"))
        .withColumn("llr", total)
        .withColumn("n_features", F.size("features").cast("long"))
        .drop("features")
    )


def threshold(docs: DataFrame, trusted: DataFrame, table: list[int]) -> int:
    """Units per feature below which a text is rejected.

    Where ``LOW_SHARE`` of the held-out trusted texts lie below, less a margin; without
    such texts nothing is rejected.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(
        small_side(trusted.where("held_out").select("doc_id")), "doc_id", "left_semi"
    )
    rate = F.floor(F.col("llr") / F.col("n_features"))
    found = scored(own, table).where(F.col("n_words") >= LEAST_WORDS).agg(
        F.percentile(rate, LOW_SHARE).alias("low")
    ).first()
    return -(1 << 40) if found.low is None else int(found.low // 1) - int(UNITS * MARGIN)


def base_counts(docs: DataFrame) -> DataFrame:
    """Adds the base counts to rows that have ``text`` and ``words``."""
    shifted = ", ".join(f"slice(hashes, {k}, size(hashes) - 4)" for k in range(1, 6))
    windows = (
        "if(size(hashes) < 5, cast(array() as array<bigint>),"
        f" transform(arrays_zip({shifted}), w -> xxhash64(w)))"
    )
    # places of windows that occur twice or more, and the words they cover together
    ordered = "sort_array(transform(windows, (h, i) -> named_struct('h', h, 'i', i)))"
    doubled = (
        "transform(filter(s, (x, j) -> (j > 0 and s[j - 1].h = x.h)"
        " or (j + 1 < size(s) and s[j + 1].h = x.h)), x -> x.i)"
    )
    places = f"sort_array(flatten(transform(array({ordered}), s -> {doubled})))"
    covered = (
        f"aggregate({places}, named_struct('n', 0L, 'end', 0),"
        " (acc, i) -> named_struct('n', acc.n + 5 - greatest(0, acc.end - i), 'end', i + 5),"
        " acc -> acc.n)"
    )
    lines = "filter(split(coalesce(text, ''), '\\n'), l -> length(btrim(l, ' \\t\\n\\u000B\\f\\r')) > 0)"
    return (
        docs.withColumn("hashes", F.expr("transform(words, w -> xxhash64(w))"))
        .withColumn("windows", F.expr(windows))
        .withColumn("lines", F.expr(lines))
        .withColumn("word_chars", F.length(F.array_join("words", "")).cast("long"))
        .withColumn(
            "n_symbols",
            F.length(F.regexp_replace(text_or_empty(), "[^#*$%&|<>]+", "")).cast("long"),
        )
        .withColumn(
            "n_dup_lines", F.expr("cast(size(lines) - size(array_distinct(lines)) as bigint)")
        )
        .withColumn(
            "n_repeat_words",
            F.expr(f"if(size(array_distinct(windows)) = size(windows), 0L, {covered})"),
        )
        .drop("hashes", "windows", "lines")
    )


def fitted(docs: DataFrame, labels: DataFrame) -> tuple[list[int], int]:
    """Weights and threshold for a corpus and its labels (doc_id, quality, toxic)."""
    trusted = store(trusted_ids(labels), "trusted")
    counts = store(bucket_counts(docs, trusted), "bucket-counts")
    table = weights(counts)
    return table, threshold(docs, trusted, table)


def judged(docs: DataFrame, table: list[int], least: int) -> DataFrame:
    """``docs`` with the base counts, ``llr``, ``n_features``, ``base_failed`` and ``kept``.

    Null and empty texts have no words and fail the base rules. Repeated rows and rows
    without an id are judged each by itself.
    """
    failed = f"n_words < {LEAST_WORDS} or 100 * n_repeat_words > {REPEATED} * n_words"
    return (
        base_counts(scored(docs, table))
        .withColumn("base_failed", F.expr(failed))
        .withColumn(
            "kept", ~F.col("base_failed") & (F.col("llr") >= F.col("n_features") * F.lit(least))
        )
    )


def quality_verdicts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Every row of ``docs``: doc_id, base counts, score and verdict.

    Other columns are not read. An empty table gives no rows; without trusted labels
    only the base rules decide.
    """
    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    table, least = fitted(chosen, labels)
    return judged(chosen, table, least).drop("text", "words", "codes")


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows of ``docs`` that are kept, its columns as they were."""
    table, least = fitted(docs, labels)
    whole = docs.select(
        F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"),
        docs["text"].alias("text"),
    )
    verdicts = judged(whole, table, least).select("row", "kept", F.spark_partition_id().alias("task"))
    # the task's number is not deterministic to the optimizer, which would otherwise move the
    # filter down through every projection and compute the words once for each use of them
    return verdicts.where("kept and task >= 0").select("row.*")
