"""Connected components by alternating large-star and small-star steps on a table of links."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm.texts import stored


def large_star(links: DataFrame) -> DataFrame:
    """Every larger neighbour of a node moves to the smallest of the node and its neighbours."""
    both = links.select(F.col("a").alias("u"), F.col("b").alias("v")).union(links.select("b", "a"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("m").alias("a"), F.col("v").alias("b")).where("a <> b").distinct()


def small_star(links: DataFrame) -> DataFrame:
    """A node and its smaller neighbours move to the smallest of them."""
    down = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").select(F.col("m").alias("a"), F.col("v").alias("b"))
    return moved.union(least.select(F.col("m").alias("a"), F.col("u").alias("b"))).where("a <> b").distinct()


def is_settled(links: DataFrame) -> bool:
    """Whether every node has one link to a node that has none itself: the links are stars around the smallest nodes."""
    if not links.groupBy("b").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        return False
    return links.join(links.select(F.col("b").alias("a")), "a", "left_semi").isEmpty()


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``node, component`` of every node with a link (columns ``a``, ``b``, long): the smallest node that links reach.

    Each round is written to the shared folder. The steps end when the links are
    stars, which needs about the square of the logarithm of the nodes.
    """
    links = stored(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    for _ in range(max_rounds):
        if is_settled(links):
            return links.select(F.col("b").alias("node"), F.col("a").alias("component")).union(links.select("a", "a").distinct())
        links = stored(small_star(large_star(links)), "links")
    raise RuntimeError(f"the components did not settle in {max_rounds} rounds")
