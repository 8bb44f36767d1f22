"""Connected components of an edge table, by alternating large-star and small-star steps.

Each step is an aggregation and a join on the node. A node with very many edges is summed before the shuffle; the least neighbours are
written before they are joined, so both sides of the join come plain from a shuffle and adaptive execution can split such a node's.
Nothing goes to the driver but a checksum. Every round is written to the shared folder, so lost executors cost no history.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tequant.llm.common import cut, drop_cut


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node with an edge, root being the smallest node of its component and other than node.

    Null ends and self-loops are ignored; repeated edges count once; an empty table gives an empty result.
    """
    ends = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    e, seen = cut(ends.distinct()), None
    while True:
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen or not now[0]:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = now
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = cut(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = cut(large)
        drop_cut(least)
        least = cut(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
        new = cut(small.where(F.col("u") != F.col("v")).distinct())
        for done in (least, large, e):
            drop_cut(done)
        e = new
