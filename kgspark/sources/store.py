"""Snapshot store: immutable versions of the graph's tables and one pointer to the current one.

A commit writes a whole new version and then exchanges the pointer in one rename; a crash in between
leaves the old version current. Upserts are keyed merges of the old and the new rows.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

TABLES = ("documents", "chunks", "entities", "edges", "mentions", "aliases", "schema_types", "schema_relations", "chunk_tokens", "entity_tokens")
#: Fixed value: what stands between the joined texts of one edge.
SEPARATOR = "\n---\n"
#: Versions that stay after a commit, so that readers of the last ones can end.
KEPT = 2


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self.fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def current(self) -> int:
        """The version readers see; 0 before the first commit."""
        best = 0
        if self.fs.exists(self._path(f"{self.root}/_committed")):
            for s in self.fs.listStatus(self._path(f"{self.root}/_committed")):
                best = max(best, int(s.getPath().getName()))
        return best

    def _entries(self, version: int) -> dict[str, tuple[int, str]]:
        """Table -> (the version that wrote it, its schema as JSON)."""
        lines = self._lines(f"{self.root}/_committed/{version}") if version else []
        return {r[0]: (int(r[1]), r[2]) for r in (line.split(" ", 2) for line in lines) if len(r) == 3}

    def _manifest(self, version: int) -> dict[str, int]:
        """Table -> the version that wrote it."""
        return {k: v for k, (v, _) in self._entries(version).items()}

    def _lines(self, path: str) -> list[str]:
        stream = self.fs.open(self._path(path))
        try:
            return self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8").splitlines()
        finally:
            stream.close()

    def read(self, name: str) -> DataFrame | None:
        v, schema = self._entries(self.current()).get(name, (0, ""))
        # with its schema, an empty table is one too
        return self.spark.read.schema(StructType.fromJson(json.loads(schema))).parquet(f"{self.root}/v{v}/{name}") if v else None

    def commit(self, tables: dict[str, DataFrame], before_swap: Callable[[], None] | None = None) -> int:
        """Writes ``tables`` as a new version; the others stay where they are. The manifest, written last and whole, makes it current."""
        new = self.current() + 1
        where = self._entries(new - 1)
        self.fs.delete(self._path(f"{self.root}/v{new}"), True)  # what an earlier crash left
        for name, df in tables.items():
            if name not in TABLES:
                raise ValueError(f"no table {name}")
            (df.write.partitionBy("rel") if name == "edges" else df.write).parquet(f"{self.root}/v{new}/{name}")
            where[name] = (new, df.schema.json())
        if before_swap:
            before_swap()
        self.fs.mkdirs(self._path(f"{self.root}/_committed"))
        draft, final = self._path(f"{self.root}/_draft-{new}"), self._path(f"{self.root}/_committed/{new}")
        out = self.fs.create(draft, True)
        out.write("".join(f"{k} {v} {schema}\n" for k, (v, schema) in sorted(where.items())).encode())
        out.close()
        if not self.fs.rename(draft, final):
            raise RuntimeError(f"version {new} was committed by another writer")
        self._clean(new)
        return new

    def _clean(self, version: int) -> None:
        """Removes manifests before the last ``KEPT`` and the tables that none of those left names."""
        keep = [v for v in range(version - KEPT + 1, version + 1) if v > 0]
        used = {(name, v) for m in keep for name, v in self._manifest(m).items()}
        for s in self.fs.listStatus(self._path(f"{self.root}/_committed")):
            if int(s.getPath().getName()) < keep[0]:
                self.fs.delete(s.getPath(), True)
        for s in self.fs.listStatus(self._path(self.root)):
            v = s.getPath().getName()
            if v[:1] == "v" and v[1:].isdigit():
                for t in self.fs.listStatus(s.getPath()):
                    if (t.getPath().getName(), int(v[1:])) not in used:
                        self.fs.delete(t.getPath(), True)

    def delete(self) -> None:
        self.fs.delete(self._path(self.root), True)


def changed(docs: DataFrame, stored: DataFrame | None) -> DataFrame:
    """Documents that are new or whose content hash differs from the stored one."""
    if stored is None:
        return docs
    return docs.join(stored.select("doc_id", "content_hash"), ["doc_id", "content_hash"], "left_anti")


def merge_entities(old: DataFrame | None, new: DataFrame) -> DataFrame:
    """(name, type, props): keyed merge; a new type replaces the old one unless blank, new properties win."""
    first = Window.partitionBy("name").orderBy("seq") if "seq" in new.columns else None
    if first is not None:
        new = new.withColumn("_r", F.row_number().over(first)).where("_r = 1").drop("_r", "seq")
    if old is None:
        return new
    a, b = old.select("name", F.col("type").alias("t0"), F.col("props").alias("p0")), new.select("name", F.col("type").alias("t1"), F.col("props").alias("p1"))
    empty = F.create_map().cast("map<string,string>")
    kept = F.map_filter(F.coalesce("p0", empty), lambda k, v: ~F.map_contains_key(F.coalesce("p1", empty), k))
    return a.join(b, "name", "full_outer").select("name", F.coalesce(F.nullif("t1", F.lit("")), "t0").alias("type"), F.map_concat(kept, F.coalesce("p1", empty)).alias("props"))


def merge_stored(old: DataFrame, new: DataFrame) -> DataFrame:
    """Stored entities (name, type, base_types, domain_types, functional_roles, status, aliases, temporal, embedding) met again.

    Lists are united, the old values first; a new type replaces the old one unless it says nothing; the first
    known status stays; dates that are not set yet are added; the vector stays, as the name does.
    """
    a, b = (df.select("name", F.struct(*[c for c in new.columns if c != "name"]).alias(k)) for df, k in ((old.select(*new.columns), "a"), (new, "b")))
    x = a.join(b, "name", "full_outer")

    def both(c: str):
        kind = dict(new.dtypes)[c]
        p, q = F.col(f"a.{c}"), F.col(f"b.{c}")
        if c == "embedding":
            return F.coalesce(p, q)
        if kind.startswith("array"):
            none = F.array().cast(kind)
            return F.array_distinct(F.concat(F.coalesce(p, none), F.coalesce(q, none)))
        if kind.startswith("map"):
            none = F.create_map().cast(kind)
            return F.map_concat(F.coalesce(p, none), F.map_filter(F.coalesce(q, none), lambda k, v: ~F.map_contains_key(F.coalesce(p, none), k)))
        if c == "status":
            known = lambda v: F.when(~F.coalesce(v, F.lit("")).isin("", "unknown"), v)
            return F.coalesce(known(p), known(q), p, q)
        if c == "type":
            return F.coalesce(F.when(~F.coalesce(q, F.lit("")).isin("", "concept"), q), p, q)
        return F.coalesce(q, p)

    return x.select("name", *[both(c).alias(c) for c in new.columns if c != "name"])


def merge_edge_rows(edges: DataFrame) -> DataFrame:
    """Stored edges (src, rel, dst, weight, n, chunk_ids ARRAY, status, condition, evidence_text, fact, temporal, ..., version) of equal ends made one, in order of version.

    As ``merge_edges``, but of rows that are merged ones already, so their number per edge is that of the versions or
    the names that became one.
    """
    key, order = ["src", "rel", "dst"], F.struct("version", "fact")
    first = lambda c, ok: F.min_by(F.when(ok, F.col(c)), F.when(ok, order)).alias(c)
    said = lambda c: F.coalesce(c, F.lit("")) != ""
    add = lambda a, t: F.when(a == "", t).when((t == "") | F.contains(a, t), a).otherwise(F.concat(a, F.lit(SEPARATOR), t))
    texts = lambda c: F.aggregate(F.transform(F.array_sort(F.collect_list(F.struct("version", F.coalesce(c, F.lit("")).alias("t")))), lambda x: x.t), F.lit(""), add).alias(c)
    out = edges.groupBy(*key).agg(
        F.sum("weight").alias("weight"),
        F.sum("n").alias("n"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("chunk_ids")))).alias("chunk_ids"),
        first("status", said("status")),
        first("fact", said("fact")),
        texts("evidence_text"),
        texts("condition"),
        *[F.min_by(c, order).alias(c) for c in edges.columns if c not in (*key, "weight", "n", "chunk_ids", "status", "fact", "evidence_text", "condition", "version")],
    )
    return out.withColumn("status", F.coalesce("status", F.lit(""))).select(*[c for c in edges.columns if c != "version"])


def merge_edges(edges: DataFrame) -> DataFrame:
    """(src, rel, dst, weight, chunk_ids, status, condition, evidence_text, n, ...): rows of one edge folded in order of seq.

    Weights are added, the first status (and fact) that is not blank stays, and evidence and conditions are
    joined in the order of their arrival, a text that the joined ones contain being left out. A repeated text
    is contained, so repeats are removed before texts are gathered: an edge of a third of all rows
    gathers its different texts only. Chunk ids come once each, as they are a set to
    whatever reads them. Dates (``temporal``) are those of the first row.
    """
    key = ["src", "rel", "dst"]
    base = edges.groupBy(*key).agg(
        F.sum(F.coalesce("weight", F.lit(0.0))).alias("weight"),
        F.min_by(F.when(F.coalesce("status", F.lit("")) != "", F.col("status")), F.when(F.coalesce("status", F.lit("")) != "", F.col("seq"))).alias("status"),
        F.count("*").alias("n"),
    )
    if "fact" in edges.columns:
        said = F.coalesce("fact", F.lit("")) != ""
        base = base.join(edges.groupBy(*key).agg(F.min_by(F.when(said, F.col("fact")), F.when(said, F.col("seq"))).alias("fact")), key)
    if "temporal" in edges.columns:
        base = base.join(edges.groupBy(*key).agg(F.min_by("temporal", "seq").alias("temporal")), key)
    for col in ("evidence_text", "condition"):
        texts = edges.where(F.length(col) > 0).groupBy(*key, col).agg(F.min("seq").alias("s"))
        joined = texts.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("s", F.col(col).alias("t")))), lambda x: x.t).alias(col))
        add = lambda a, t: F.when(a == "", t).when(F.contains(a, t), a).otherwise(F.concat(a, F.lit(SEPARATOR), t))
        base = base.join(joined.withColumn(col, F.aggregate(col, F.lit(""), add)), key, "left").withColumn(col, F.coalesce(col, F.lit("")))
    ids = edges.where(F.length("chunk_id") > 0).select(*key, "chunk_id").distinct().groupBy(*key).agg(F.array_sort(F.collect_list("chunk_id")).alias("chunk_ids"))
    return base.join(ids, key, "left").withColumns({"status": F.coalesce("status", F.lit("")), "chunk_ids": F.coalesce("chunk_ids", F.array().cast("array<string>"))})


def mentions_of(entities: DataFrame, chunks: DataFrame) -> DataFrame:
    """(name, chunk_id): the chunks that an entity's evidence names and that exist, once each."""
    x = entities.select("name", F.explode("evidence").alias("e")).select("name", F.col("e.chunk_id").alias("chunk_id")).where("chunk_id != ''").distinct()
    return x.join(chunks.select("chunk_id"), "chunk_id", "left_semi").select("name", "chunk_id")


def delete_document(doc_ids: DataFrame, tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The tables without the documents, their chunks and mentions, and the entities that no other document mentions, with their edges."""
    d = doc_ids.select("doc_id").distinct()
    docs, chunks = tables["documents"].join(d, "doc_id", "left_anti"), tables["chunks"]
    dead = chunks.join(d, "doc_id", "left_semi").select("chunk_id")
    kept = tables["mentions"].join(dead, "chunk_id", "left_anti")
    lost = tables["mentions"].join(dead, "chunk_id", "left_semi").select("name").distinct().join(kept.select("name").distinct(), "name", "left_anti")
    edges = tables["edges"]
    for end in ("src", "dst"):
        edges = edges.join(lost.withColumnRenamed("name", end), end, "left_anti")
    return tables | {
        "documents": docs,
        "chunks": chunks.join(d, "doc_id", "left_anti"),
        "mentions": kept,
        "entities": tables["entities"].join(lost, "name", "left_anti"),
        "edges": edges.select(*tables["edges"].columns),
    } | ({"chunk_tokens": tables["chunk_tokens"].join(dead, "chunk_id", "left_anti")} if "chunk_tokens" in tables else {})


def export(df: DataFrame, drop: tuple[str, ...] = ("embedding",)) -> DataFrame:
    """(json): rows without vectors as JSON."""
    return df.select(F.to_json(F.struct(*[c for c in df.columns if c not in drop])).alias("json"))
