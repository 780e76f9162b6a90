"""Connected components by alternating large and small stars, and the groups that near-duplicate operators compare in."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import materialise, materialise_alone


def components(edges: DataFrame) -> DataFrame:
    """(node, component: the smallest node reachable) of every node with an edge; edges: (a, b). The tables of the
    rounds go once the result is written.

    Each round hangs every node's larger neighbours on its smallest one, then its smaller ones; the edges
    become stars in about log n rounds. Minima are found by partial aggregation and joined back, so a
    node with very many edges isn't gathered. Every round is a table in the shared folder.
    """

    def stars_of() -> DataFrame:
        now = materialise(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
        mark = None
        while True:
            both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
            low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
            large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
            least = large.groupBy("u").agg(F.min("v").alias("m"))
            small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.greatest("v", "m").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
            now = materialise(small.filter("u <> v").distinct(), "edges")
            new = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
            if new == mark:
                break
            mark = new
        stars = now.groupBy("u").agg(F.min("v").alias("v"))
        return stars.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(stars.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())

    return materialise_alone(stars_of, edges.sparkSession, "components")


def pivot_groups(buckets: DataFrame, keys: list[str]) -> DataFrame:
    """(pivot, id): the members of each bucket with more than one, under the bucket's smallest id.

    Two ids that share a bucket share a pivot, so groups by pivot hold every candidate pair; a pair that
    shares many buckets is there once for each of their pivots, mostly once. buckets: keys and id.
    """
    pivots = buckets.groupBy(*keys).agg(F.min("id").alias("pivot"), F.max("id").alias("last")).filter("pivot < last").drop("last")
    return buckets.join(pivots, keys).select("pivot", "id").distinct()


def block_pairs(groups: DataFrame, block: int) -> DataFrame:
    """Adds left, right: numbers of the blocks that a row is compared in. A group of up to `block` rows is one
    block with itself; a larger one is dealt into blocks, and each pair of blocks is a task of its own."""
    sizes = groups.groupBy("pivot").agg(F.count("*").alias("size")).select("pivot", F.ceil(F.col("size") / block).cast("int").alias("blocks"))
    dealt = groups.join(sizes, "pivot").withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    return dealt.select("*", other).select(*groups.columns, "own", F.least("own", "other").alias("left"), F.greatest("own", "other").alias("right"))
