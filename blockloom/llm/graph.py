"""Connected components of a graph held as rows, by alternating large-star and small-star
(Kiveris et al., 2014). The number of rounds grows with the logarithm of the longest path;
nothing but two numbers a round reaches the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockloom.llm.common import cut


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b")
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """Rows (node, root) for every node that has a link; root is the smallest node that can
    be reached. `edges` has two bigint columns, the ends of each link, in any order; null
    ends and loops are ignored, repeated links do no harm."""
    a, b = edges.columns[:2]
    now = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b")
    now = cut(_small_star(cut(now)))
    seen = None
    while True:
        sign = now.agg(F.count(F.lit(1)), F.sum(F.shiftright(F.xxhash64("a", "b"), 20))).first()
        if sign == seen:
            break
        seen = sign
        now = cut(_small_star(_large_star(now)))
    return now.groupBy("a").agg(F.min("b").alias("root")).select(F.col("a").alias("node"), "root").union(
        now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )
