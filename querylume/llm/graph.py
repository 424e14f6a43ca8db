"""Connected components of a link table."""

from pyspark.sql import DataFrame, functions as F

from querylume.llm.common import dropped, written


def _stars(links: DataFrame, keep: str) -> DataFrame:
    """Point the neighbours ``v`` of every ``u`` that pass ``keep`` to the smallest node
    among u and its neighbours."""
    least = links.groupBy("u").agg(F.min("v").alias("m"))
    least = least.select("u", F.least("u", "m").alias("m"))
    return links.join(least, "u").filter(keep).select("u", "v", "m")


def components(links: DataFrame, label="links") -> DataFrame:
    """``links`` (u, v: integers of one type) as (node, root): every node that occurs, and
    the smallest node it can reach. Loops and repeated links are fine; a link with a null
    end is none. No links, no rows.

    Large-star and small-star rounds in turn: a round is a minimum per node and a join,
    so no node's neighbours meet in one task's memory. Every round is written, so a lost
    executor repeats one round at most. The number of rounds grows with the logarithm of
    a component's diameter; stars are reached when a round changes nothing.
    """
    spark = links.sparkSession
    size = F.struct(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s"))
    stars = written(links.filter("u != v").select(
        F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), label)
    seen = None
    while True:
        both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _stars(both, "v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = written(large.filter("u != v").distinct(), label)
        # In the small star all neighbours are smaller, so u itself is pointed too.
        small = _stars(large, "true")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            small.select("u", F.col("m").alias("v")))
        new = written(small.filter("u != v").distinct(), label)
        now = new.select(size.alias("x")).first()["x"]
        dropped(spark, stars, large)
        stars = new
        if now == seen:
            break
        seen = now
    roots = stars.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return stars.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
