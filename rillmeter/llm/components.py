"""Connected components of a link table, by alternating large-star and small-star steps.

Every step is a grouped minimum and a join on tables in the shared folder; the driver sees one count a step.
A node with very many links is a skewed join key, which adaptive execution splits: the minima are stored first, so
both sides of the join come straight from a shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillmeter.session import materialise


def _step(links: DataFrame, large: bool) -> DataFrame:
    """``links``: (a, b) with a > b. Large star: neighbours above a node move to its smallest neighbour;
    small star: neighbours below (and the node) do."""
    both = links.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if large:
        both = both.union(links.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = materialise(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
    met = both.join(least.hint("merge"), "u")
    if large:
        moved = met.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        own = least.where("u > m").select(F.col("u").alias("a"), F.col("m").alias("b"))
    else:
        moved = met.where("v > m").select(F.col("v").alias("a"), F.col("m").alias("b"))
        own = least.select(F.col("u").alias("a"), F.col("m").alias("b"))
    return moved.union(own).distinct()


def components(links: DataFrame, name: str = "links") -> DataFrame:
    """(node, component) for every node of ``links`` (columns a, b); component is its smallest reachable node."""
    current = materialise(
        links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name
    )

    def mark(df: DataFrame) -> tuple:
        row = df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        return row[0], row[1]

    seen = mark(current)
    while seen[0]:
        current = materialise(_step(current, True), name)
        current = materialise(_step(current, False), name)
        now = mark(current)
        if now == seen:
            break
        seen = now
    stars = current.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return stars.union(current.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
