"""Connected components by alternating large and small stars (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def _large_star(edges: DataFrame) -> DataFrame:
    """Links each node's greater neighbours to the least of its neighbourhood."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    # Stored, so that both sides are shuffled and Spark can split a node that most links lead to.
    least = stored(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Links each node and its smaller neighbours to the least of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v")
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root): every node of ``edges`` (u, v) but the roots, with the least
    node that it is connected to.

    Each round is written to the shared folder, so a lost executor repeats one
    round at most. Rounds grow with the logarithm of the number of nodes; the
    edges never grow in number. Loops and repeated edges do no harm; rows with
    a null are ignored; no edges give no rows.
    """
    now = stored(edges.select("u", "v").dropna().filter("u <> v").distinct(), "edges")
    if now.isEmpty():
        return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    seen = None
    for _ in range(rounds):
        now = stored(_small_star(_large_star(now)), "stars")
        sums = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if sums == seen:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = sums
    raise RuntimeError("components did not settle")
