"""Connected components of an edge list, without gathering edges or components anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.joins import hot_keys, salted_join
from tidemark.tables import drop_table, write_table


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components of (a, b), two longs: one row (node, root) per node, root its smallest node.

    Alternating large-star and small-star steps (Kiveris et al. 2014), each a pre-aggregated minimum
    and one join (a root with very many members is spread over tasks), written to the shared folder so
    that no lineage grows and no executor's loss costs the loop. It ends when the edges no longer change: then each node points at its root. Loops
    (a = a) keep a node that has no other edge. A null end drops the edge.
    """
    both = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).filter("a is not null and b is not null")
    nodes = both.select(F.col("a").alias("node")).union(both.select("b")).distinct()
    star = write_table(both.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "star")
    nodes = write_table(nodes, "nodes")
    before = None
    for _ in range(rounds):
        total = 2 * star.count()
        around = star.select("u", "v").union(star.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = around.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count("*").alias("n"))
        large = salted_join(around.filter("v > u"), low.select("u", "m"), "u", hot_keys(low, "u", total))
        large = large.select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = salted_join(large, low.select("u", "m"), "u", hot_keys(low, "u", total))
        after = write_table(
            small.select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").union(low.select("u", F.col("m").alias("v"))).distinct(), "star"
        )
        drop_table(star)
        star = after
        sums = star.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if before == tuple(sums):
            break
        before = tuple(sums)
    else:
        raise RuntimeError("components did not settle")
    return nodes.join(star.select(F.col("u").alias("node"), F.col("v").alias("root")), "node", "left").select("node", F.coalesce("root", "node").alias("root"))
