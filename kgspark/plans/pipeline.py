"""The pipeline: documents to a stored graph, and questions to answers. Library entry points."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kgspark.functions import text as tx
from kgspark.functions.vector import top_k
from kgspark.lineage import cut, scope
from kgspark.ontology import DEFAULT, Ontology
from kgspark.operators import chunking, extraction, graph, resolve, retrieval, rewrite, solver
from kgspark.plans import cypher, prompts
from kgspark.plans.providers import Provider, RuleProvider, completed, embedded
from kgspark.plans.telemetry import Telemetry
from kgspark.sources import loaders
from kgspark.sources.store import Store, changed, delete_document, mentions_of, merge_edge_rows, merge_edges, merge_stored

#: Calls of a provider that an ingest may spend on pairs of names that may be one.
MOST_VERIFIED = 50
#: Rows of a statement's result that are read for an answer.
MOST_ROWS = 200


@dataclass(frozen=True)
class Config:
    """``strategy``: recursive, sentence, structural or contextual; ``extraction``: single, llm or hybrid.

    The operators of resolution, recognition and ranking can be exchanged: ``resolver`` (entities, vectors) -> (aliases,
    entities); ``recogniser`` text -> spans; ``reranker`` (candidates, vector, k) -> passages.
    """

    strategy: str = "recursive"
    chunk_size: int = chunking.SIZE
    overlap: int = chunking.OVERLAP
    ontology: Ontology = DEFAULT
    extraction: str = "single"
    coreference: bool = True
    resolver: Callable | None = None
    recogniser: Callable | None = None
    reranker: Callable | None = None


@dataclass
class Answer:
    text: str
    entities: list[str] = field(default_factory=list)
    facts: list[str] = field(default_factory=list)
    rows: list[dict] = field(default_factory=list)
    graph: list[tuple[str, str, str, float]] = field(default_factory=list)
    statement: str = ""
    context: str = ""


class Pipeline:
    def __init__(self, spark: SparkSession, root: str, provider: Provider | None = None, config: Config = Config()):
        self.spark, self.store, self.provider, self.config = spark, Store(spark, root), provider or RuleProvider(), config
        self.telemetry = Telemetry()

    @property
    def phases(self) -> list[tuple[str, float]]:
        return self.telemetry.phases

    # ingest
    def ingest_folder(self, folder: str) -> int:
        docs, _ = loaders.load(self.spark, folder)
        return self.ingest(docs)

    def ingest_text(self, text: str, source: str = "") -> int:
        return self.ingest(loaders.load_text(self.spark, text, source))

    def chunked(self, docs: DataFrame) -> DataFrame:
        c = self.config
        if c.strategy != "contextual":
            return chunking.chunk(docs, c.strategy, c.chunk_size, c.overlap, text="content")
        ask = lambda x: completed(x.withColumn("_ask", F.concat(F.lit("Document:\n"), "doc", F.lit("\n\nPassage:\n"), "text")), self.provider, prompts.CONTEXT, "_ask", "context")
        return chunking.contextual(docs, ask, "recursive", c.chunk_size, c.overlap, text="content")

    def candidates(self, docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(chunks, candidate entities, candidate edges) of documents; seq follows the documents' ids, then the chunks' places."""
        c = self.config
        chunks = self.chunked(docs)
        if c.coreference:
            chunks = extraction.resolved_references(chunks, self.provider)
        chunks = cut(chunks)
        place = cut(chunks.select("chunk_id", "doc_id", "chunk_index").orderBy("doc_id", "chunk_index").select("chunk_id", F.monotonically_increasing_id().alias("doc_seq")))
        asked = chunks.select("chunk_id", "text").join(place, "chunk_id")
        said = cut(extraction.extracted(asked, self.provider, c.extraction, c.ontology, c.recogniser).select("chunk_id", "doc_seq", "answer"))
        return chunks, extraction.entities_of(said, c.ontology), extraction.edges_of(said, c.ontology)

    def _verified(self, canon: DataFrame) -> Callable[[DataFrame], DataFrame]:
        """Asks the provider about the most similar pairs, at most ``MOST_VERIFIED`` times; pairs that have become one need no question."""

        def run(soft: DataFrame) -> DataFrame:
            pairs = soft.orderBy(F.desc("sim"), "a", "b").limit(10 * MOST_VERIFIED)
            for end in ("a", "b"):
                about = canon.select(F.col("name").alias(end), F.struct("base_types", "domain_types", "functional_roles", "status").alias(f"_{end}"))
                pairs = pairs.join(about, end, "left")
            up: dict[str, str] = {}

            def root(x: str) -> str:
                while up.get(x, x) != x:
                    x = up[x]
                return x

            kept, calls = [], 0
            for r in pairs.orderBy(F.desc("sim"), "a", "b").collect():
                one, two = root(r["group_a"]), root(r["group_b"])
                if one == two:
                    continue
                if calls == MOST_VERIFIED:
                    break
                calls += 1
                about = [prompts.described(r[e], r[f"_{e}"]["base_types"] or [], r[f"_{e}"]["domain_types"] or [], r[f"_{e}"]["functional_roles"] or [], r[f"_{e}"]["status"] or "", "") for e in ("a", "b")]
                try:
                    same = "YES" in self.provider.complete(prompts.SAME, f"Entity A: {about[0]}\n\nEntity B: {about[1]}").upper()
                except Exception:  # an unanswered pair stays two
                    same = False
                if same:
                    up[max(one, two)] = min(one, two)
                    kept.append((r["a"], r["b"]))
            return self.spark.createDataFrame(kept, "a string, b string")

        return run

    def resolved(self, entities: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(alias map, canonical entities): by name, by service forms, by vectors."""
        names = entities.select(F.coalesce(F.nullif(tx.name_key(F.col("canonical")), F.lit("")), tx.name_key(F.col("mention"))).alias("name")).where("name != ''").distinct()
        vectors = embedded(names, self.provider, "name")
        if self.config.resolver:
            return self.config.resolver(entities, vectors)
        canon = resolve.canonical_entities(entities, resolve.alias_map(entities))
        return resolve.tiered(entities, vectors, self._verified(canon))

    def build(self, entities: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(entities, edges, aliases): candidates to a consistent graph. The order of the passes is part of the result."""
        t, onto = self.telemetry, self.config.ontology
        with t.phase("quality"):
            ents = cut(resolve.quality_filter(entities))
            named = resolve.drop_orphans(edges, ents)
        with t.phase("resolution"):
            aliases, canon = self.resolved(ents)
            aliases = cut(aliases)
            canon = cut(resolve.with_aliases(canon, aliases))
        with t.phase("rewriting"):
            if "temporal" not in named.columns:
                named = named.withColumn("temporal", F.create_map().cast("map<string,string>"))
            e = rewrite.to_canonical(named, aliases).where("src != dst")
            e = rewrite.resolve_relations(e, ontology=onto)
            e = e.withColumn("rel", rewrite.negate(F.col("rel"), F.col("evidence_text")))
            e = rewrite.annotate_conditions(e)
            planned = canon.select("name", ((F.col("status") == "planned") | F.array_contains("functional_roles", "planned_unit")).alias("planned"))
            e = cut(rewrite.repair_planned(rewrite.by_planned_ends(e, planned.where("planned")), planned))
            e = e.unionByName(self._completed_branches(e, canon))
        with t.phase("constraints"):
            e = solver.alternative_groups(e, onto)
            e = solver.verdicts(e, canon, aliases, onto).where("verdict = 'keep'").drop("verdict")
            e = cut(solver.fold_duplicates(solver.select(e)))
            e, canon = solver.post_validate(e, canon, aliases)
        with t.phase("consistency"):
            e = cut(rewrite.drop_contradicted(e))
            spread = rewrite.spread_status(e, canon.where(F.array_contains("base_types", "address")).select("name")).withColumnRenamed("status", "_status")
            canon = canon.join(spread, "name", "left").withColumn("status", F.coalesce("_status", "status")).drop("_status")
            e = cut(rewrite.dated(rewrite.add_inverses(e)))
            canon = canon.join(rewrite.dates_of_targets(e), "name", "left").withColumn("temporal", F.coalesce("temporal", F.create_map().cast("map<string,string>")))
        return cut(canon), e, aliases

    def _completed_branches(self, edges: DataFrame, canon: DataFrame) -> DataFrame:
        x = rewrite.complete_branches(edges, canon, hints=self.config.ontology.branch_hints)
        # after all others, by a number that the edge's ends give
        x = x.withColumn("seq", F.lit(1 << 61) + F.pmod(F.xxhash64("src", "rel", "dst"), F.lit(1 << 60)))
        fixed = {"id": F.concat(F.lit("e_branchcomplete_"), "src", F.lit("_"), "dst"), "relation_raw": F.col("rel"), "chunk_id": F.lit(""), "evidence_score": F.lit(0.8), "schema_fit_score": F.lit(1.0), "confidence": F.lit(0.8)}
        fixed |= {"alternative_group": F.lit(""), "condition": F.lit(""), "temporal": F.create_map().cast("map<string,string>")}
        return x.withColumns({k: v for k, v in fixed.items() if k in edges.columns}).select(*edges.columns)

    def ingest(self, docs: DataFrame) -> int:
        """Number of the version that holds the new and changed documents too; the current one if nothing has changed."""
        with scope(self.spark):
            return self._ingest(docs)

    def _ingest(self, docs: DataFrame) -> int:
        t = self.telemetry
        with t.phase("changed"):
            new = cut(changed(docs, self.store.read("documents")))
        if new.isEmpty():
            t.skip("ingest")
            return self.store.current()
        old = {k: df for k in ("documents", "chunks", "entities", "edges", "mentions", "aliases", "chunk_tokens") if (df := self.store.read(k)) is not None}
        with t.phase("extraction"):
            chunks, ents, edges = self.candidates(new)
            ents = cut(ents)
        canon, edges, aliases = self.build(ents, edges)
        with t.phase("embedding"):
            chunks = cut(embedded(chunking.link(chunks), self.provider, "text"))
            kind = F.coalesce(F.get("base_types", F.lit(0)), F.lit("concept"))
            ent = embedded(canon.select("name", kind.alias("type"), "base_types", "domain_types", "functional_roles", "status", "aliases", "temporal"), self.provider, "name")
            rows = merge_edges(edges.withColumn("weight", F.col("score")).withColumn("fact", graph.fact(evidence="evidence_text")))
            rows = embedded(rows, self.provider, "fact")
        with t.phase("store"):
            ev = ents.select(F.col("canonical").alias("name"), "evidence")
            ev = ev.join(aliases.select(F.col("alias").alias("name"), F.col("canonical").alias("_to")), "name", "left").select(F.coalesce("_to", "name").alias("name"), "evidence")
            mentions = mentions_of(ev, chunks).join(canon.select("name"), "name", "left_semi")
            words = retrieval.token_table(chunks, "chunk_id", "text")
            tables = {"documents": new.select("doc_id", "path", "content_hash", "content", "metadata"), "chunks": chunks, "entities": ent, "edges": rows, "mentions": mentions, "aliases": aliases, "chunk_tokens": words}
            if old:  # a document that comes again replaces its old self; what is exclusive to it goes, unless the new version has it
                rest = delete_document(new.select("doc_id"), old)
                tables = {k: self._union(k, df, rest.get(k)) for k, df in tables.items()}
            tables["entity_tokens"] = retrieval.token_table(tables["entities"], "name", "name")
            version = self.store.commit(tables)
        if t.listeners:
            t.count(**self.stats())
        t.complete()
        return version

    @staticmethod
    def _union(name: str, new: DataFrame, old: DataFrame | None) -> DataFrame:
        if old is None:
            return new
        if name == "entities":
            return merge_stored(old, new)
        if name == "edges":
            return merge_edge_rows(old.select(*new.columns).withColumn("version", F.lit(0)).unionByName(new.withColumn("version", F.lit(1))))
        if name == "chunk_tokens":
            return new.unionByName(old.select(*new.columns))
        key = {"documents": ["doc_id"], "chunks": ["chunk_id"], "mentions": ["name", "chunk_id"], "aliases": ["alias"]}[name]
        return new.unionByName(old.join(new.select(*key), key, "left_anti").select(*new.columns))

    # maintenance
    def update_document(self, text: str, source: str) -> int:
        return self.ingest_text(text, source)

    def delete(self, *doc_ids: str) -> int:
        return self.delete_all(self.spark.createDataFrame([(d,) for d in doc_ids], "doc_id string"))

    def delete_all(self, doc_ids: DataFrame) -> int:
        """Removes documents, whatever their number, in one version."""
        tables = {t: self.store.read(t) for t in ("documents", "chunks", "entities", "edges", "mentions", "chunk_tokens")}
        if any(v is None for v in tables.values()) or tables["documents"].join(doc_ids, "doc_id", "left_semi").isEmpty():
            return self.store.current()
        left = delete_document(doc_ids, tables)
        return self.store.commit(left | {"entity_tokens": retrieval.token_table(left["entities"], "name", "name")})

    def apply_changes(self, changes: DataFrame) -> int:
        """A batch of changes (doc_id, content, op 'delete' or 'upsert'): deletes first, then the rest. Fit for foreachBatch."""
        with scope(self.spark):
            return self._applied(cut(changes))

    def _applied(self, changes: DataFrame) -> int:
        self.delete_all(changes.where("op = 'delete'").select("doc_id").distinct())
        up = changes.where("op = 'upsert'").select("doc_id", F.col("doc_id").alias("path"), "content", loaders.content_hash(F.col("content")).alias("content_hash"), F.create_map(F.lit("type"), F.lit("change")).alias("metadata"))
        return self.ingest(up)

    def finalize(self) -> int:
        """Makes names one that differ by case or blanks, then those whose vectors are alike; all that refers to them moves; then missing vectors are made."""
        with scope(self.spark):
            return self._finalized()

    def _finalized(self) -> int:
        ents = self.store.read("entities")
        if ents is None or self.store.read("edges") is None:
            return self.store.current()
        with self.telemetry.phase("exact duplicates"):
            self._merge(resolve.exact_duplicates(ents))
        with self.telemetry.phase("similar duplicates"):
            self._merge(resolve.semantic_duplicates(self.store.read("entities")))
        with self.telemetry.phase("embedding"):
            todo = {"entities": "name", "edges": "fact", "chunks": "text"}
            lacking = {k: c for k, c in todo.items() if not self.store.read(k).where(F.col("embedding").isNull() & (F.length(c) > 0)).isEmpty()}
            if lacking:
                self.store.commit({k: embedded(self.store.read(k), self.provider, c) for k, c in lacking.items()})
        return self.store.current()

    def _merge(self, same: DataFrame) -> None:
        """Every table with names that have merged (name, survivor) moved to the survivor."""
        with scope(self.spark):
            same = cut(same)
            if not same.isEmpty():
                self._move(same)

    def _move(self, same: DataFrame) -> None:
        read = self.store.read
        gone = same.where("name != survivor")
        to = lambda df, col: df.join(gone.select(F.col("name").alias(col), "survivor"), col, "left").withColumn(col, F.coalesce("survivor", col)).drop("survivor")
        ents, edges, mentions, aliases = read("entities"), read("edges"), read("mentions"), read("aliases")
        lang = dict(ents.dtypes)["aliases"]
        own = F.array(F.struct(F.col("name").alias("text"), F.lit("und").alias("lang"))).cast(lang)
        moved = ents.join(gone.select("name", "survivor"), "name", "left").withColumn("aliases", F.when(F.col("survivor").isNotNull(), F.concat(F.coalesce("aliases", F.array().cast(lang)), own)).otherwise(F.col("aliases")))
        order = F.struct(F.col("survivor").isNotNull().alias("other"), F.col("name"))
        moved = moved.withColumn("_r", F.row_number().over(Window.partitionBy(F.coalesce("survivor", "name")).orderBy(order))).withColumn("name", F.coalesce("survivor", "name"))
        first = moved.where("_r = 1").select(*ents.columns)
        rest = moved.where("_r > 1")
        lists = [c for c, k in ents.dtypes if k.startswith("array") and c != "embedding"]
        values = {c: rest.select("name", "_r", F.posexplode(c).alias("i", "v")).groupBy("name", "v").agg(F.min(F.struct("_r", "i")).alias("p")) for c in lists}
        more = rest.groupBy("name").agg(*[F.min_by(c, F.when(F.col(c).isNotNull() & ~F.coalesce(F.col(c).cast("string"), F.lit("")).isin("", "unknown", "concept"), F.col("_r"))).alias(c) for c in ("type", "status")], F.min_by("temporal", "_r").alias("temporal"), F.lit(None).cast("array<float>").alias("embedding"))
        for c, v in values.items():
            more = more.join(v.groupBy("name").agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "v"))), lambda z: z.v).alias(c)), "name", "left")
        alias_rows = to(aliases, "canonical").where("alias != canonical").unionByName(gone.select(F.col("name").alias("alias"), F.col("survivor").alias("canonical")))
        entities = cut(merge_stored(first, more.select(*ents.columns)))
        self.store.commit(
            {
                "entities": entities,
                "edges": merge_edge_rows(resolve.moved(edges, same).withColumn("version", F.lit(0))),
                "mentions": to(mentions, "name").select(*mentions.columns).distinct(),
                "aliases": alias_rows.groupBy("alias").agg(F.min("canonical").alias("canonical")),
                "entity_tokens": retrieval.token_table(entities, "name", "name"),
            }
        )

    def stats(self) -> dict[str, int]:
        ents, edges = self.store.read("entities"), self.store.read("edges")
        return {"nodes": 0 if ents is None else ents.count(), "edges": 0 if edges is None else edges.count()}

    # questions
    def cypher(self, text: str, params: dict | None = None) -> DataFrame:
        if self.store.read("entities") is None:
            raise ValueError("nothing is stored yet")
        return cypher.query(self.store.read("entities"), self.store.read("edges"), text, params, self.store.read("chunks"), self.store.read("mentions"))

    def change(self, text: str, params: dict | None = None) -> int:
        """Stores what a statement that changes the graph makes of it; derived texts and vectors follow with ``finalize``."""
        from kgspark.plans.cypher_write import update

        ents, edges = self.store.read("entities"), self.store.read("edges")
        if ents is None:
            raise ValueError("nothing is stored yet")
        with scope(self.spark):
            new, rows = update(ents, edges, text, params)
            new, rows = cut(new), cut(rows)
            # a name that is a node's only is found by words too
            return self.store.commit({"entities": new, "edges": rows, "entity_tokens": retrieval.token_table(new, "name", "name")})

    def create_entity(self, name: str, kind: str = "concept", **props) -> int:
        """One node: made, or its type and properties set."""
        sets = "".join(f", n.{k} = ${k}" for k in props)
        return self.change("MERGE (n {name: $name}) SET n.type = $kind" + sets, {"name": name.strip().lower(), "kind": kind, **props})

    def create_edge(self, src: str, rel: str, dst: str, weight: float = 1.0, chunk_ids: list[str] | None = None, evidence: str = "", status: str = "", condition: str = "") -> int:
        """One relation, a self-loop left out: with the stored one weights add up, chunk ids unite and texts join."""
        a, b = src.strip().lower(), dst.strip().lower()
        if a == b or not a or not b:
            return self.store.current()
        ents, edges = self.store.read("entities"), self.store.read("edges")
        if ents is None:
            raise ValueError("nothing is stored yet")
        row = self.spark.createDataFrame([(a, rel, b, float(weight), 1, chunk_ids or [], status, condition, evidence)], "src string, rel string, dst string, weight double, n long, chunk_ids array<string>, status string, condition string, evidence_text string")
        row = row.withColumn("fact", graph.fact(evidence="evidence_text"))
        none = [c for c in edges.columns if c not in row.columns]
        row = row.select("*", *[F.lit(None).cast(dict(edges.dtypes)[c]).alias(c) for c in none]).select(*edges.columns)
        ends = self.spark.createDataFrame([(a,), (b,)], "name string").join(ents.select("name"), "name", "left_anti").withColumn("type", F.lit("concept"))
        with scope(self.spark):
            both = cut(merge_edge_rows(edges.withColumn("version", F.lit(0)).unionByName(row.withColumn("version", F.lit(1)))))
            new = cut(ents.unionByName(ends, allowMissingColumns=True))
            return self.store.commit({"entities": new, "edges": both, "entity_tokens": retrieval.token_table(new, "name", "name")})

    def save_schema(self, types: DataFrame, relations: DataFrame) -> int:
        """Stores the registries of types (name, description, parent, bases) and relations (name, ..., src_types, dst_types)."""
        return self.store.commit({"schema_types": types, "schema_relations": relations})

    def load_schema(self) -> tuple[DataFrame | None, DataFrame | None]:
        return self.store.read("schema_types"), self.store.read("schema_relations")

    def query(self, question: str, human: bool = False) -> Answer:
        """Facts, entities and their neighbourhood for a question; ``human`` adds an answer in words, else the text is the context."""
        if self.store.read("entities") is None:
            return Answer("Nothing is stored yet.")
        with scope(self.spark):
            return self._asked(question, human)

    def _asked(self, question: str, human: bool) -> Answer:
        flags = self.spark.createDataFrame([(question,)], "q string")
        row = flags.select(tx.keywords(F.col("q")).alias("k"), tx.answer_hint(F.col("q")).alias("h"), tx.looked_up_name(F.col("q")).alias("n"), tx.wants_analysis(F.col("q")).alias("count"), tx.wants_all(F.col("q")).alias("all")).first()
        if row["count"]:
            try:
                return self._analytical(question, human)
            except Exception:  # whatever keeps a statement from being made or run, the paths below may find something
                self.telemetry.skip("analytical")
        got = self._retrieved(question, row)
        if not got.entities or row["n"] and not any(t in n for t in row["n"] for n in got.entities):
            return Answer(f"No entity named {' '.join(row['n'])} was found." if row["n"] else "No entity that matches was found; the exact name of a person, organisation or service helps.", rows=[])
        if human:
            got.text = self._answered(prompts.asked(question, got.context), "What was found could not be put into words now; the facts are given with this answer.")
        return got

    def _answered(self, user: str, failed: str) -> str:
        try:
            return prompts.answer_of(self.provider.complete(prompts.ANSWER, user))
        except Exception:
            return failed

    def _analytical(self, question: str, human: bool) -> Answer:
        """A question that wants a count or a ranking, by a statement that the provider writes."""
        statement = prompts.statement_of(self.provider.complete(prompts.statement(self.config.ontology), f"Question: {question}"))
        if not statement:
            raise ValueError("no statement was given")
        found = self.cypher(statement)
        rows = [r.asDict(recursive=True) for r in found.limit(MOST_ROWS).collect()]
        if not rows:
            return Answer("The statement for this question found nothing.", statement=statement)
        lines = [" | ".join(found.columns), *(" | ".join(_cell(r[c]) for c in found.columns) for r in rows)]
        cells = {v.strip().lower() for r in rows for v in r.values() if isinstance(v, str) and len(v.strip()) > 1}
        known = self.store.read("entities").select("name").join(self.spark.createDataFrame([(c,) for c in sorted(cells)], "name string"), "name", "left_semi")
        focus = [r["name"] for r in known.orderBy("name").limit(12).collect()]
        text = "\n".join(lines)
        out = Answer(text, focus, [text], rows, self._neighbourhood(focus), statement, text)
        if human:
            out.text = self._answered(f"Question: {question}\n\nQuery results:\n{text}", "The rows found could not be put into words now; they are given with this answer.")
        return out

    def _neighbourhood(self, names: list[str]) -> list[tuple[str, str, str, float]]:
        if not names:
            return []
        f = self.spark.createDataFrame([(n,) for n in names], "name string")
        return [tuple(r) for r in graph.focused_subgraph(self.store.read("edges"), f).orderBy("src", "rel", "dst").collect()]

    def _retrieved(self, question: str, row) -> Answer:
        ents, edges, chunks, mentions, documents = (self.store.read(t) for t in ("entities", "edges", "chunks", "mentions", "documents"))
        try:
            named = prompts.names_of(self.provider.complete(prompts.NAMES, f"Question: {question}"))
        except Exception:
            named = []
        simple = list(row["k"])
        words = list(dict.fromkeys(w.lower() for w in (named or simple)))[:8]
        vec = self.provider.embed([question])[0]
        table = lambda values, col: self.spark.createDataFrame([(v, i) for i, v in enumerate(values)], f"{col} string, pos int")
        w, pos = table(words, "word"), F.row_number().over(Window.orderBy("name")).alias("pos")
        paths = []
        if words:
            paths.append(("fulltext", retrieval.full_text_each(self.store.read("entity_tokens"), w, "name", retrieval.FULLTEXT).select("name", "pos")))
        paths.append(("exact", retrieval.exact_names(ents, w).select("name", pos)))
        if words:
            paths.append(("contains", retrieval.containing_names(ents, words).select("name", pos)))
        paths.append(("vector", top_k(ents, "embedding", vec, retrieval.VECTOR, "name").where("score > 0").select("name", pos)))
        facts = cut(retrieval.relevant_facts(retrieval.edge_facts(edges, vec).select(F.col("fact").alias("text"), "score", "src", "dst")))
        ends = facts.select(F.col("src").alias("name")).union(facts.select("dst")).distinct()
        paths.append(("edge_fact", ends.select("name", pos)))
        found = cut(retrieval.pool(paths, "name"))
        if row["all"]:
            near = graph.siblings(edges, found.select("name"), retrieval.SIBLINGS)
            found = found.unionByName(near.select("name", F.lit("sibling").alias("source"), F.lit(9).alias("path"), pos))
        names = [r["name"] for r in found.orderBy("path", "pos", "name").limit(30).collect()]
        fact_list = [r["text"] for r in facts.orderBy("rank").collect()]
        lines = retrieval.relation_lines(edges, table(names[:15], "name"))
        pools = [("fulltext", retrieval.chunks_by_words(self.store.read("chunk_tokens"), question, list(dict.fromkeys(named + simple)))), ("vector", top_k(chunks, "embedding", vec, retrieval.CHUNKS, "chunk_id").select("chunk_id", F.row_number().over(Window.orderBy(F.desc("score"), "chunk_id")).alias("pos")))]
        by_chunk = F.row_number().over(Window.orderBy("chunk_id")).alias("pos")
        pools.append(("mentioned_in", retrieval.chunks_of(mentions, table(names[:15], "name"), chunks, vec).select("chunk_id").distinct().select("chunk_id", by_chunk)))
        pools.append(("2hop_mentioned", retrieval.chunks_two_hops(edges, mentions, table(names[:10], "name")).select("chunk_id", by_chunk)))
        cand = retrieval.pool(pools, "chunk_id").join(chunks.select("chunk_id", "doc_id", "text", "embedding"), "chunk_id").join(documents.select("doc_id", F.col("path").alias("doc_path")), "doc_id", "left")
        cand = cut(cand)
        if self.config.reranker:
            best = self.config.reranker(cand, vec, retrieval.PASSAGES)
        else:
            best = retrieval.rerank(retrieval.with_vectors(cand, self.provider), vec)
        passages = [f"[Source: {r['doc_path']}]\n{r['text']}" if r["doc_path"] else r["text"] for r in best.collect()]
        context = retrieval.assemble(row["h"], {"Key Entities": names, "Relationships": lines, "Facts": fact_list, "Passages": passages})
        context = prompts.harmless(context)
        return Answer(context, names, [*lines, *fact_list], [], self._neighbourhood(names[:8]), "", context)

    def chat(self, history: list[tuple[str, str]], question: str, rewrite: bool = True) -> Answer:
        """A question after earlier turns (role, text). It is rewritten to stand alone; a system message among the turns has the answer made under it."""
        lines = prompts.history_lines(history)
        asked = question
        if rewrite and lines:
            try:
                reply = self.provider.complete(prompts.REWRITE, "Conversation history:\n" + "\n".join(lines) + f"\n\nFollow-up question: {question}")
                asked = prompts.field_of(reply, "rewritten_question") or question
            except Exception:
                asked = question
        out = self.query(asked, human=True)
        system = next((t for r, t in history if r == "system"), "")
        if system and out.facts:
            turns = prompts.messages(system, history, asked, out.context or "\n".join(out.facts))
            try:
                said = "\n\n".join(f"{m['role']}: {m['content']}" for m in turns[1:-1])
                out.text = prompts.answer_of(self.provider.complete(system, (said + "\n\n" if said else "") + turns[-1]["content"]))
            except Exception:
                self.telemetry.skip("chat answer")
        return out


def _cell(v) -> str:
    if v is None:
        return ""
    if isinstance(v, bool):
        return str(v).lower()
    return str(int(v)) if isinstance(v, float) and v == int(v) else str(v)
