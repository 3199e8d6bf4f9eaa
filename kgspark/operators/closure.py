"""Transitive closure: components of an undirected graph, and the ends of alias chains.

Both shrink what is left each round and cut the lineage with a table in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgspark.lineage import cut, drop


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node that is linked to each node of ``edges``, directly or not.

    Nodes are numbered once, in their order. Large-star and small-star rounds then run on numbers: every node links
    its larger neighbours, then all of its smaller ones, to the smallest of its neighbourhood, until the sum
    over all links, taken while a round is written, stays the same. Null ends and self-loops link nothing but
    a self-loop's node is a component of its own.
    """
    e = cut(edges.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.col(a).alias("u"), F.col(b).alias("v")))
    # sorted in ranges, so numbers rise with the nodes and no task sees them all
    number = cut(e.select("u").union(e.select("v")).distinct().orderBy("u").select(F.col("u").alias("node"), F.monotonically_increasing_id().alias("n")))
    x, y = number.toDF("u", "x"), number.toDF("v", "y")
    links = e.where("u != v").join(x, "u").join(y, "v")
    now = cut(links.select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")).distinct())
    drop(e)
    before = None
    while True:
        both = now.union(now.select("v", "u")).toDF("u", "v")
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        # the link of a node to its own minimum keeps it attached
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        new = cut(small.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
        drop(now)
        now, state = new, tuple(new.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == before:
            break
        before = state
    found = now.groupBy("u").agg(F.min("v").alias("v")).toDF("n", "m")
    out = number.join(found, "n", "left").select("node", F.coalesce("m", "n").alias("m"))
    return out.join(number.toDF("component", "m"), "m").select("node", "component")


def chain_ends(links: DataFrame, alias: str = "alias", canonical: str = "canonical") -> DataFrame:
    """(alias, terminal): where each alias ends when links are followed; of a cycle, its smallest member.

    Pointer jumping: each round every pointer goes twice as far, so the rounds are the logarithm of the longest chain.
    """
    now = cut(links.where(f"{alias} is not null and {canonical} is not null and {alias} != {canonical}").groupBy(F.col(alias).alias("x")).agg(F.min(canonical).alias("to"), F.lit(None).cast("string").alias("low")).withColumn("low", F.least("x", "to")))
    reach = 1
    while True:
        nxt = now.select(F.col("x").alias("to"), F.col("to").alias("far"), F.col("low").alias("low2"))
        moved = cut(now.join(nxt, "to", "left").select("x", F.coalesce("far", "to").alias("to"), F.least("low", F.coalesce("low2", "low")).alias("low"), F.col("far").isNotNull().alias("open")))
        drop(now)
        now, reach = moved.select("x", "to", "low"), reach * 2
        now._kgspark_path = moved._kgspark_path
        left = moved.where("open").count()
        # pointers that are still open after more steps than there are links run in a cycle
        if left == 0 or reach > moved.count():
            return moved.select(F.col("x").alias("alias"), F.when(F.col("open"), F.col("low")).otherwise(F.col("to")).alias("terminal"))
