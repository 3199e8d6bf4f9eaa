"""Graph operators over edges (src, rel, dst, weight, ...): hops, paths, siblings, subgraphs, counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def edge_id(df: DataFrame) -> DataFrame:
    return df.withColumn("edge_id", F.xxhash64("src", "rel", "dst"))


def undirected(edges: DataFrame) -> DataFrame:
    """Every edge from both ends: (node, other, src, rel, dst, ...)."""
    x = edges.withColumns({"node": F.col("src"), "other": F.col("dst")})
    return x.unionByName(edges.where("src != dst").withColumns({"node": F.col("dst"), "other": F.col("src")}))


def one_hop(edges: DataFrame, start: DataFrame, rels: list[str] | None = None) -> DataFrame:
    """Edges out of the names in ``start``, of the relations given."""
    x = edges if rels is None else edges.where(F.col("rel").isin(*rels))
    return x.join(start.select(F.col("name").alias("src")).distinct(), "src", "left_semi").select(*edges.columns)


def two_hop(edges: DataFrame, start: DataFrame) -> DataFrame:
    """(a, r1, b, r2, c): paths of two different edges that don't return to their start."""
    e = edges.select("src", "rel", "dst").distinct()
    one = one_hop(e, start).select(F.col("src").alias("a"), F.col("rel").alias("r1"), F.col("dst").alias("b"))
    return one.join(e.select(F.col("src").alias("b"), F.col("rel").alias("r2"), F.col("dst").alias("c")), "b").where("a != c").select("a", "r1", "b", "r2", "c")


def paths(edges: DataFrame, start: DataFrame, most: int, directed: bool = True) -> DataFrame:
    """(start, node, depth, edges): paths of one to ``most`` edges, none used twice."""
    e = edge_id(edges.select("src", "rel", "dst").distinct())
    e = e.select(F.col("src").alias("node"), F.col("dst").alias("next"), "edge_id") if directed else undirected(e).select("node", F.col("other").alias("next"), "edge_id")
    now = start.select(F.col("name").alias("start"), F.col("name").alias("node"), F.array().cast("array<bigint>").alias("edges")).distinct()
    out = None
    for depth in range(1, most + 1):
        now = now.join(e, "node").where(~F.array_contains("edges", F.col("edge_id"))).select("start", F.col("next").alias("node"), F.array_append("edges", F.col("edge_id")).alias("edges"))
        step = now.withColumn("depth", F.lit(depth))
        out = step if out is None else out.unionByName(step)
    return out.select("start", "node", "depth", "edges")


def reachable(edges: DataFrame, start: DataFrame, most: int, directed: bool = False) -> DataFrame:
    """(start, node, depth): the least number of steps to each node; breadth first, each node kept once per start."""
    e = edges.select("src", "dst").distinct()
    e = e.select(F.col("src").alias("node"), F.col("dst").alias("next")) if directed else e.union(e.select("dst", "src")).toDF("node", "next").distinct()
    seen = start.select(F.col("name").alias("start"), F.col("name").alias("node")).distinct().withColumn("depth", F.lit(0))
    now = seen
    for depth in range(1, most + 1):
        now = now.join(e, "node").select("start", F.col("next").alias("node")).distinct().join(seen, ["start", "node"], "left_anti").withColumn("depth", F.lit(depth))
        seen = seen.unionByName(now)
    return seen.where("depth > 0")


def siblings(edges: DataFrame, found: DataFrame, most: int = 20, least: int = 2) -> DataFrame:
    """(name, n_hubs): other neighbours of the nodes that touch at least ``least`` of the found, by name."""
    u = undirected(edges.select("src", "rel", "dst")).select("node", "other").distinct()
    f = found.select("name").distinct()
    hubs = u.join(f.withColumnRenamed("name", "node"), "node", "left_semi").groupBy(F.col("other").alias("hub")).agg(F.countDistinct("node").alias("n")).where(F.col("n") >= least)
    x = hubs.join(u.select(F.col("node").alias("hub"), "other"), "hub").join(f.withColumnRenamed("name", "other"), "other", "left_anti")
    return x.groupBy(F.col("other").alias("name")).agg(F.countDistinct("hub").alias("n_hubs")).orderBy("name").limit(most)


def focused_subgraph(edges: DataFrame, focus: DataFrame, most: int = 60) -> DataFrame:
    """Edges that touch a focus node, best first, with at most ``most`` nodes; edges between focus nodes always stay.

    A neighbour's rank is its first place among the edges, so at most most - |focus| neighbours are kept.
    """
    f = focus.select("name").distinct()
    e = edges.select("src", "rel", "dst", F.coalesce("weight", F.lit(1.0)).alias("weight"))
    e = e.join(f.select(F.col("name").alias("src"), F.lit(1).alias("_s")), "src", "left").join(f.select(F.col("name").alias("dst"), F.lit(1).alias("_d")), "dst", "left")
    e = e.where("_s is not null or _d is not null").withColumn("both", F.col("_s").isNotNull() & F.col("_d").isNotNull())
    far = F.when(F.col("_s").isNull(), F.col("src")).when(F.col("_d").isNull(), F.col("dst"))
    e = e.withColumn("far", far)
    place = F.struct(F.negate("weight").alias("w"), "src", "rel", "dst")
    near = e.where("far is not null").groupBy("far").agg(F.min(place).alias("p")).orderBy("p").limit(max(0, most)).withColumn("rank", F.row_number().over(Window.orderBy("p")))
    n = f.agg(F.count("*").alias("n"))
    kept = near.crossJoin(F.broadcast(n)).where(F.col("rank") <= most - F.col("n")).select("far")
    return e.where("both").select("src", "rel", "dst", "weight").unionByName(e.where("far is not null").join(kept, "far", "left_semi").select("src", "rel", "dst", "weight"))


def stats(entities: DataFrame, edges: DataFrame) -> DataFrame:
    return entities.agg(F.count("*").alias("n_nodes")).crossJoin(edges.agg(F.count("*").alias("n_edges")))


def cooccurrence(members: DataFrame, chunk: str, name: str, most: int = 20, least: int = 1) -> DataFrame:
    """(a, b, n): how many chunks of at most ``most`` names two names share; larger chunks tell nothing and stay out, as in the definition."""
    m = members.select(F.col(chunk).alias("c"), F.col(name).alias("n")).where("n is not null").distinct()
    small = m.groupBy("c").agg(F.count("*").alias("k")).where((F.col("k") <= most) & (F.col("k") > 1)).select("c")
    m = m.join(small, "c", "left_semi")
    x = m.withColumnRenamed("n", "a").join(m.withColumnRenamed("n", "b"), "c").where("a < b")
    return x.groupBy("a", "b").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def per_relation(edges: DataFrame) -> DataFrame:
    """(rel, n, n_conditions, n_evidence): how many edges each relation has, and how many of them say something more; one pass."""
    return edges.groupBy("rel").agg(F.count("*").alias("n"), F.count(F.when(F.col("condition") != "", 1)).alias("n_conditions"), F.count(F.when(F.size("evidence") > 0, 1)).alias("n_evidence"))


def numbered(df: DataFrame, *order: str) -> DataFrame:
    """With ``place``, the row's number in ``order`` from 1: rows are sorted in ranges, and a range begins after the rows of those before it."""
    from kgspark.lineage import cut

    x = cut(df.orderBy(*order).withColumn("_id", F.monotonically_increasing_id()))
    part = F.shiftright("_id", 33)
    sizes = {r["p"]: r["n"] for r in x.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect()}  # one number for each range
    begin, rows = 0, []
    for p in sorted(sizes):
        rows.append((p, begin))
        begin += sizes[p]
    starts = df.sparkSession.createDataFrame(rows, "_p long, _begin long")
    return x.withColumn("_p", part).join(F.broadcast(starts), "_p").withColumn("place", F.col("_begin") + F.col("_id").bitwiseAND((1 << 33) - 1) + 1).drop("_p", "_begin", "_id")


def hubs(edges: DataFrame, least: int = 2) -> DataFrame:
    """(dst, n_sources): nodes with at least ``least`` different sources."""
    return edges.groupBy("dst").agg(F.countDistinct("src").alias("n_sources")).where(F.col("n_sources") >= least)


def fact(src: str = "src", rel: str = "rel", dst: str = "dst", evidence: str | None = None):
    """'a —[R]→ b', with ': evidence' if there is some."""
    base = F.concat(F.col(src), F.lit(" —["), F.col(rel), F.lit("]→ "), F.col(dst))
    return base if evidence is None else F.when(F.length(evidence) > 0, F.concat(base, F.lit(": "), evidence)).otherwise(base)
