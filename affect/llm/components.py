"""Connected components of a graph given as an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from affect.llm.common import written


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``node, root``: the smallest node that each end of an edge ``(a, b)`` reaches.

    Alternates large stars (every larger neighbour is hung on the smallest one)
    and small stars (the smaller ones are) until nothing changes, which takes a
    logarithmic number of rounds.  Each round is two joins on a minimum that is
    aggregated before it is shuffled, written to the shared folder; no node's
    neighbours are ever collected.  Loops, repeated edges and nulls are left out."""
    def tidy(df: DataFrame) -> DataFrame:
        return df.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()

    def state(df: DataFrame) -> tuple:
        r = df.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        return r[0], r[1]

    now = written(tidy(edges), "edges")
    before = state(now)
    for _ in range(max_rounds):
        if not before[0]:
            break
        both = now.union(now.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = tidy(large)
        small_least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(small_least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(small_least)
        now = written(tidy(small), "edges")
        after = state(now)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select("b", "b").distinct())
