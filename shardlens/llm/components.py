"""Connected components over links, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shardlens.llm.common import staged


def _star(links: DataFrame, large: bool) -> DataFrame:
    """One round: each node's larger (smaller) neighbours are linked to the least of its neighbours and itself."""
    if large:
        sided = links.select("u", "v").unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        sided = links
    least = staged(sided.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "star-least")
    met = sided.join(least, "u")
    if large:
        moved = met.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        moved = met.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return moved.where(F.col("u") > F.col("v")).distinct()


def star_components(links: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of ``links`` (u, v: long) that is not the least of its component.

    Each round is written to the shared folder.  The table of least neighbours is written too, so that Spark can split
    a node with very many links when it joins the links to it.  Rounds grow with the logarithm of the longest chain.
    """
    now = staged(
        links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v").distinct(), "star-links"
    )
    mark = None
    while True:
        now = staged(_star(_star(now, large=True), large=False), "star-round")
        # Equal sums of hashes: the set of links did not change in a whole round.
        seen = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == mark:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        mark = seen
