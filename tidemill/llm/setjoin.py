"""Exact set-similarity join by prefix, positional and length filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def linked(a: str, b: str, hundredths: int) -> Column:
    """Whether the sets in two array columns have this share of their union in common."""
    return F.expr(
        f"size(array_intersect({a}, {b})) * {100 + hundredths}L >= {hundredths}L * (size({a}) + size({b}))"
    )


def similar_pairs(sets: DataFrame, hundredths: int) -> DataFrame:
    """Pairs of ``sets`` (id, comp, n, tokens) of different ``comp`` that are similar: comp_a, comp_b.

    Tokens are ordered by rarity. Two similar sets share a token among the first
    n - ceil(t n) + 1 of each; tokens of one set only come first and need no join.
    The first shared token must leave room for the overlap that is needed, and sizes
    must not differ too much; both are conditions of the join, so pairs that fail
    them are never written.
    """
    rows = sets.select("id", "comp", "n", F.explode("tokens").alias("token"))
    shared = rows.groupBy("token").agg(F.count("*").alias("df")).where("df > 1")
    ordered = rows.join(shared, "token").groupBy("id", "comp", "n").agg(
        F.sort_array(F.collect_list(F.struct("df", "token"))).alias("order")
    )
    alone = "cast(n - size(order) as int)"
    prefix = f"cast(n - ceil({hundredths} * n / 100.0) + 1 as int)"
    heads = ordered.where(f"{prefix} > {alone}").select(
        "id", "comp", "n", F.expr(alone).alias("alone"),
        F.posexplode(F.expr(f"slice(order, 1, {prefix} - {alone})")).alias("nth", "item"),
    ).select(
        "id", "comp", "n", F.col("item.token").alias("token"),
        # tokens from this one on
        F.expr("n - alone - nth").alias("left"),
    )
    a = heads.select(*[F.col(c).alias(f"{c}_a") for c in heads.columns])
    b = heads.select(*[F.col(c).alias(f"{c}_b") for c in heads.columns])
    need = f"ceil({hundredths} * (n_a + n_b) / {100 + hundredths}.0)"
    found = a.join(
        b,
        F.expr(
            "token_a = token_b and id_a < id_b and comp_a <> comp_b"
            f" and least(n_a, n_b) * 100 >= {hundredths} * greatest(n_a, n_b)"
            f" and least(left_a, left_b) >= {need}"
        ),
    ).select("id_a", "id_b").distinct()
    left = sets.select(
        F.col("id").alias("id_a"), F.col("comp").alias("comp_a"), F.col("tokens").alias("tokens_a")
    )
    right = sets.select(
        F.col("id").alias("id_b"), F.col("comp").alias("comp_b"), F.col("tokens").alias("tokens_b")
    )
    both = found.join(left, "id_a").join(right, "id_b")
    return both.where(linked("tokens_a", "tokens_b", hundredths)).select("comp_a", "comp_b")
