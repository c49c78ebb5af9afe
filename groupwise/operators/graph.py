"""Joins and connected components without hot tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groupwise.storage import drop_tables, mark, stored


def join_counted(left: DataFrame, right: DataFrame, key: str, count: str, parts: int = 10_000, least: int = 64, deal: Column | None = None) -> DataFrame:
    """left joined with right (one row per key; `count`: how many rows of left have that key), without a hot task.

    A key that holds over 1/parts of all rows (and over `least`) is split: its rows of left are dealt round over salts, its row of
    right is repeated for each. Such keys number fewer than `parts`, so the list of them is broadcast: a proven bound. `deal` is a
    long that tells the rows of a key apart; without it left must come from written tables without a shuffle, so that a repeated
    task deals its rows alike.
    """
    bound = max(least, (right.agg(F.sum(count)).first()[0] or 0) // parts)
    salts = F.ceil(F.col(count) / bound).cast("int")
    hot = right.where(F.col(count) > bound).select(key, salts.alias("_salts"))
    dealt = left.join(F.broadcast(hot), key, "left")
    dealt = dealt.withColumn("_salt", F.pmod(F.monotonically_increasing_id() if deal is None else deal, F.coalesce("_salts", F.lit(1))).cast("int")).drop("_salts")
    repeated = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1)))
    return dealt.join(repeated.hint("shuffle_merge"), [key, "_salt"]).drop("_salt")


def star_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root): the smallest node reachable over edges (src, dst), for every node that has an edge.

    Alternates two steps, each a grouped minimum and a join, and writes the edges after each round: every node hands its larger
    neighbours to its smallest one, then its smaller ones. The edges shrink to stars in a logarithmic number of rounds. The rows of
    a node with very many neighbours are not shuffled to one task (see join_counted).
    """
    before = mark()
    edges, seen = stored(edges.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).where("src <> dst").distinct()), None
    for _ in range(most_rounds):
        both = edges.union(edges.select(F.col("dst"), F.col("src"))).toDF("u", "v")
        low = stored(both.groupBy("u").agg(F.min("v").alias("v"), F.count("*").alias("n")).select("u", F.least("u", "v").alias("m"), "n"))
        large = stored(join_counted(both.where("v > u"), low, "u", "n").select(F.col("v").alias("src"), F.col("m").alias("dst")).distinct())
        low = stored(large.groupBy("src").agg(F.min("dst").alias("m"), F.count("*").alias("n")))
        star = F.array(F.struct("src", F.col("m").alias("dst")), F.struct(F.col("dst").alias("src"), F.col("m").alias("dst")))
        edges = stored(join_counted(large, low, "src", "n").select(F.inline(star)).where("src <> dst").distinct())
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("src", "dst"))).first()
        if now == seen:
            drop_tables(edges.sparkSession, before, spare=1)  # the stars alone are left
            return edges.select(F.col("src").alias("node"), F.col("dst").alias("root")).union(edges.select(F.col("dst"), F.col("dst"))).distinct()
        seen = now
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
