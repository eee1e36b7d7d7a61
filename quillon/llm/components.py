"""Connected components of an edge table, by rounds of joins and grouped minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import cut, spent

#: A vertex with more than this part of all link ends is a hub; so there are at most HUBS of them.
HUBS = 1_000


def _with_least(links: DataFrame, least: DataFrame, ends: int) -> DataFrame:
    """links (a, b) with m of their a, given least (a, m, n: links of a) and the number of all links.

    The links of hubs stay in the partitions where they are: hubs are few enough, by their definition, to be sent
    there. All other vertices have few links each and are joined by a shuffle.
    """
    most = F.lit(max(1, ends // HUBS))
    hubs = F.broadcast(least.where(F.col("n") > most).select("a", "m"))  # HUBS rows at most
    hot = links.join(hubs, "a")
    rest = links.join(F.broadcast(least.where(F.col("n") > most).select("a")), "a", "left_anti")
    return hot.unionByName(rest.join(least.where(F.col("n") <= most).select("a", "m"), "a"))


def connected(edges: DataFrame) -> DataFrame:
    """(id, component) for every id in edges (a, b); component is the smallest id that it reaches.

    Alternates large-star and small-star steps: each replaces a vertex's links by links to the smallest vertex
    it knows, which at most halves the depth of the trees. Minima are combined before they are shuffled, and the
    links of hubs are not gathered by hub. Ends when a round changes no edge; an empty table gives no rows.
    """
    sums = lambda df: df.select(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
    now = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = sums(now)
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = cut(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count("*").alias("n")))
        large = _with_least(both.where("b > a"), least, 2 * before.n).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        down = cut(large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
        low = down.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
        small = _with_least(down, low, before.n)
        small = small.select(F.explode(F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        after = cut(small.select("e.a", "e.b").where("a <> b").distinct())
        for table in (now, least, down):
            spent(table)
        now, last, before = after, before, sums(after)
        if last == before:
            break
    tops = now.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
    return now.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(tops)
