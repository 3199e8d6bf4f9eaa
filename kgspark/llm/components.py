"""Problem 4: one group id for all names that are linked directly or through others.

Method: seed-tree pruning. In every round each vertex proposes the minimum of its closed
neighbourhood to that whole neighbourhood. A vertex that nobody (itself included) proposes
drops out of the graph, hanging below the smallest minimum it heard of; the proposed minima
of one vertex are linked to the smallest of them and go on to the next round. The vertices
at least halve in each round. When no edge is left, the ids of the seeds flow down the
forest of dropped vertices, latest round first.

Names are numbered once, in their order, so the rounds run on numbers and the smallest number of
a group is its smallest name.

Skew: a vertex with a third of all edges is only ever grouped by ``min`` (combined on the
map side) and joined with one row per vertex (split by AQE's skew join). Nothing is
collected; the lineage is cut by a table each round.

Defined results: rows with a null or blank name, two equal names, or a null, NaN or too low
similarity link nothing; repeated rows and both directions count once; an empty table gives
no rows; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kgspark.lineage import cut, drop

BLANKS = " \t\n\r "


def normal_name(c: Column) -> Column:
    return F.lower(F.btrim(c, F.lit(BLANKS)))


def links(pairs: DataFrame, a: str = "a", b: str = "b", sim: str = "sim", least: float = 0.95) -> DataFrame:
    """(u, v) with u < v: each link once."""
    x = pairs.select(normal_name(F.col(a)).alias("x"), normal_name(F.col(b)).alias("y"), F.col(sim).alias("s"))
    x = x.where((F.col("s") >= least) & ~F.isnan("s") & (F.col("x") != F.col("y")) & (F.col("x") != "") & (F.col("y") != ""))
    return x.select(F.least("x", "y").alias("u"), F.greatest("x", "y").alias("v")).distinct()


def _both(e: DataFrame) -> DataFrame:
    return e.union(e.select(F.col("v"), F.col("u"))).toDF("u", "v")


def numbered(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges between numbers, (vertex, n)): numbers rise with the vertices, which are sorted in ranges, nowhere as a whole."""
    numbers = cut(_both(edges).select(F.col("u").alias("vertex")).distinct().orderBy("vertex").withColumn("n", F.monotonically_increasing_id()))
    u, v = numbers.toDF("u", "nu"), numbers.toDF("v", "nv")
    return edges.join(u, "u").join(v, "v").select(F.col("nu").alias("u"), F.col("nv").alias("v")), numbers


def components(edges: DataFrame) -> DataFrame:
    """(vertex, seed) of every vertex of ``edges`` (u, v, each link once): seed is the smallest vertex reached."""
    edges = cut(edges)
    pairs, numbers = numbered(edges)
    found = _components(cut(pairs), numbers.select(F.col("n").alias("x")))
    drop(edges)
    seed = found.join(numbers.toDF("vertex", "x"), "x").select("vertex", "seed")
    return seed.join(numbers.toDF("s", "seed"), "seed").select("vertex", F.col("s").alias("seed"))


def _components(active: DataFrame, vertices: DataFrame) -> DataFrame:
    """(x, seed) of numbered vertices; ``active``, a table of ``cut``, is used up."""
    dropped = []
    while True:
        near = _both(active)
        least = near.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        heard = near.join(least, "u").select(F.col("v").alias("x"), "m").union(least.select("u", "m")).distinct()
        heard = cut(heard)
        drop(active)
        low = heard.groupBy("x").agg(F.min("m").alias("low"), F.max(F.col("m") == F.col("x")).alias("seed"), F.count("m").alias("n"))
        tree = cut(low.where(~F.col("seed")).select("x", F.col("low").alias("parent")))
        dropped.append(tree)
        more = heard.join(low.where("n > 1").select("x", "low"), "x").where("m != low")
        active = cut(more.select(F.col("low").alias("u"), F.col("m").alias("v")).distinct())
        drop(heard)
        if active.isEmpty():
            break
    known: list[DataFrame] = []
    for tree in reversed(dropped):
        if known:
            up = reduce(DataFrame.unionByName, known).select(F.col("x").alias("parent"), F.col("seed").alias("above"))
            known.append(cut(tree.join(up, "parent", "left").select("x", F.coalesce("above", "parent").alias("seed"))))
            drop(tree)
        else:
            known.append(tree.toDF("x", "seed"))
    below = reduce(DataFrame.unionByName, known)
    roots = vertices.join(below.select("x"), "x", "left_anti").select("x", F.col("x").alias("seed"))
    out = cut(below.unionByName(roots))
    drop(dropped[-1], *known)
    return out


def groups(pairs: DataFrame, a: str = "a", b: str = "b", sim: str = "sim", least: float = 0.95) -> DataFrame:
    """(entity_name, group_id) of every linked name."""
    found = components(links(pairs, a, b, sim, least))
    return found.select(F.col("vertex").alias("entity_name"), F.col("seed").alias("group_id"))
