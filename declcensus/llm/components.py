"""Connected components of a table of links, by alternating star contraction.

Each round points nodes at smaller neighbours (large star, then small star); the number
of rounds grows with the logarithm of the longest chain.  A node with very many links is
folded by partial aggregation, and its rows are joined back, which Spark can split.
Every round is checkpointed, so lost executors cost one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from declcensus.operators.ordering import materialize


def _large_star(links: DataFrame) -> DataFrame:
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("root"))
    return both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("root").alias("b"))


def _small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a > b").distinct()
    least = down.groupBy("a").agg(F.min("b").alias("root"))
    moved = down.join(least, "a").filter("b > root").select(F.col("b").alias("a"), F.col("root").alias("b"))
    return least.select("a", F.col("root").alias("b")).unionByName(moved).distinct()


def components(links: DataFrame) -> DataFrame:
    """Rows ``(id, root)`` for the ids in ``links(a, b)``; ``root`` is the smallest id linked.

    Links to itself and repeated links do not count; an empty table gives no rows.
    """
    now = materialize(_small_star(links.select(F.col("a").cast("long"), F.col("b").cast("long"))))
    state = _state(now)
    while True:
        then = materialize(_small_star(_large_star(now)))
        changed = _state(then)
        now = then
        if changed == state:
            break
        state = changed
    stars = now.select(F.col("a").alias("id"), F.col("b").alias("root"))
    return stars.unionByName(stars.select(F.col("root").alias("id"), "root").distinct())


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())
