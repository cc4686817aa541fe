"""Connected components of a table of links, by rounds of star contraction; nothing is gathered on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from holosna.llm.common import dropped, stored

MOST_ROUNDS = 60


def components(links: DataFrame) -> DataFrame:
    """links: a, b (long). Returns node, root for every linked node: root is the smallest node it can reach.

    Large-star and small-star steps (Kiveris et al., 2014) until no link changes; each round is written to the shared
    folder. Minima are summed before the shuffle, so that a node with very many links is no hot key.
    """

    def smallest(pairs: DataFrame) -> DataFrame:
        return pairs.groupBy("u").agg(F.min("v").alias("m"))

    def both(pairs: DataFrame) -> DataFrame:
        return pairs.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(pairs.select(F.col("b").alias("u"), F.col("a").alias("v")))

    now = stored(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    n = now.count()
    if not n:
        return now.toDF("node", "root")
    for _ in range(MOST_ROUNDS):
        # large star: each larger neighbour of u is linked to the smallest of u and its neighbours
        near = both(now)
        low = smallest(near).withColumn("m", F.least("u", "m"))
        large = near.join(low, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # small star: u and its smaller neighbours are linked to the smallest of them
        down = large.select(F.col("a").alias("u"), F.col("b").alias("v"))
        least = smallest(down)
        small = down.join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
        after = stored(small.where("a <> b").distinct(), "links")
        before, n = n, after.count()
        done = n == before and after.join(now, ["a", "b"], "left_anti").isEmpty()
        dropped(now)
        now = after
        if done:
            break
    else:
        raise RuntimeError(f"no fixed point in {MOST_ROUNDS} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
