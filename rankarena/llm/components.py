"""Connected components of an edge table, by rounds of large and small stars."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankarena.sources.scratch import written


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours move to its smallest neighbour, or to itself if it is smaller."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours move to the smallest of them. In each edge u is over v."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node that occurs in ``edges`` (u, v); the root is the smallest node of its component.

    Edges from a node to itself make it a component of its own if it has no others.
    """
    alone = edges.where("u = v").select("u").distinct()
    pairs = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    pairs = written(pairs, "edges")
    before = None
    while True:
        now = pairs.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
        pairs = written(_small_star(_large_star(pairs)), "edges")
    nodes = pairs.select(F.col("u").alias("node"), F.col("v").alias("root"))
    roots = pairs.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    rest = alone.select(F.col("u").alias("node"), F.col("u").alias("root"))
    found = nodes.unionByName(roots)
    return found.unionByName(rest.join(found.select("node"), "node", "left_anti"))
