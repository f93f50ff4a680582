"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def _star(links: DataFrame, larger: bool) -> DataFrame:
    """One star step: every node links its larger (or smaller) neighbours to the least node it knows."""
    if larger:
        links = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        links = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = links.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    joined = links.join(least, "a")
    if larger:  # links found twice go in the small step
        return joined.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
    return out.where(F.col("a") != F.col("b")).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of links (a, b: whole numbers) that is not the least of its component, its root.

    Alternates large-star and small-star steps, each a combined aggregate and a join, until the links are stars. Each round
    is written to the shared folder, which cuts the lineage; a round at least halves the height of what is left.
    """
    links = links.where((F.col("a") != F.col("b"))).select("a", "b").distinct()
    before = None
    while True:
        links = written(_star(_star(links, True), False), "links")
        state = tuple(links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if state == before:
            return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = state
