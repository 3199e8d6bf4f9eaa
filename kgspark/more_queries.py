"""More of the registry: resolution, retrieval, governance, statements and relational constructs. Imported by ``queries``."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from kgspark.functions import text as tx
from kgspark.functions import vector
from kgspark.lineage import cut, shared_dir
from kgspark.ontology import DEFAULT
from kgspark.operators import chunking, curation, governance, graph, resolve, retrieval, rewrite, simjoin, solver
from kgspark.queries import _CE, _E, _K, _QSTOPS, _SC, _SIMSQL, _USABLE, T, _cands, _cypher, _edges, _ENT, _graph, _known, _mentions, _query_vector, _QV, joined, query
from kgspark.sources import loaders, store

# Sources and documents


@query("""WITH r AS (SELECT row_number() OVER (ORDER BY n_nationkey) AS i, n_nationkey, trim(n_name) AS n_name, n_regionkey FROM nation)
SELECT string_agg('Record ' || i || E':\n  n_nationkey: ' || n_nationkey || E'\n  n_name: ' || n_name || E'\n  n_regionkey: ' || n_regionkey || E'\n', E'\n' ORDER BY i) AS content, 'n_nationkey,n_name,n_regionkey' AS columns, '25' AS n_rows FROM r""")
def csv_to_records(s, d):
    """The nations, written as a csv file and read by the loader."""
    import uuid

    folder = f"{shared_dir(s)}/csv-{uuid.uuid4().hex}"
    T(s, d, "nation").select("n_nationkey", F.btrim("n_name").alias("n_name"), "n_regionkey").coalesce(1).sortWithinPartitions("n_nationkey").write.option("header", True).csv(folder)
    docs, _ = loaders.load(s, folder)
    return cut(docs.select("content", F.col("metadata")["columns"].alias("columns"), F.col("metadata")["rows"].alias("n_rows")))


@query(r"""WITH x AS (SELECT doc_id, '<html><title> ' || coalesce(source, '') || ' </title><body>' || text || '</body></html>' AS h FROM documents WHERE text IS NOT NULL)
SELECT doc_id, trim(regexp_extract(h, '(?is)<title[^>]*>(.*?)</title>', 1)) AS title FROM x""")
def html_title(s, d):
    h = F.concat(F.lit("<html><title> "), F.coalesce("source", F.lit("")), F.lit(" </title><body>"), "text", F.lit("</body></html>"))
    return T(s, d, "documents").where("text is not null").select("doc_id", loaders.html_title(h).alias("title"))


@query("SELECT chunk_id, doc_id, chunk_index AS index FROM chunks")
def part_of(s, d):
    return chunking.part_of(T(s, d, "chunks"))


@query(r"""WITH l AS (SELECT doc_id, generate_subscripts(string_split(text, E'\n'), 1) AS i, unnest(string_split(text, E'\n')) AS line FROM documents WHERE text IS NOT NULL),
o AS (SELECT doc_id, i, line, coalesce(sum(strlen(line) + 1) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS "at" FROM l)
SELECT doc_id, CAST("at" AS BIGINT) AS "at", regexp_replace(trim(line), '^[# ]+', '') AS heading FROM o WHERE starts_with(trim(line), '#')""")
def heading_offsets(s, d):
    """Headings and the byte at which their line begins, by a running sum."""
    x = T(s, d, "documents").where("text is not null").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    before = Window.partitionBy("doc_id").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    x = x.withColumn("at", F.coalesce(F.sum(F.octet_length("line") + 1).over(before), F.lit(0)))
    return x.where(F.btrim("line").startswith("#")).select("doc_id", "at", F.regexp_replace(F.btrim("line"), "^[# ]+", "").alias("heading"))


@query("""SELECT e.chunk_id, count(DISTINCT src) AS n_entities, min(src) AS first_entity FROM (SELECT src, unnest(evidence) AS e FROM kg_edges) WHERE e.chunk_id IN (SELECT chunk_id FROM chunks) GROUP BY e.chunk_id""")
def mentioned_in(s, d):
    ents = T(s, d, "kg_edges").select(F.col("src").alias("name"), "evidence")
    return store.mentions_of(ents, T(s, d, "chunks")).groupBy("chunk_id").agg(F.countDistinct("name").alias("n_entities"), F.min("name").alias("first_entity"))


@query("""SELECT src, rel, dst, min_by(e, seq).text AS first_text FROM (SELECT seq, src, rel, dst, evidence[1] AS e FROM kg_edges WHERE len(evidence) > 0) GROUP BY ALL""")
def evidence_first_wins(s, d):
    x = T(s, d, "kg_edges").where(F.size("evidence") > 0)
    return x.groupBy("src", "rel", "dst").agg(F.min_by(F.col("evidence")[0]["text"], "seq").alias("first_text"))


# Edges


@query(f"""WITH {_K}, p AS (SELECT dst AS name, bool_or(rel IN ('PLANS_SITE', 'INTENDS_SERVICE')) AS planned FROM k GROUP BY dst UNION ALL SELECT src, false FROM k WHERE src NOT IN (SELECT dst FROM k) GROUP BY src),
x AS (SELECT seq, src, CASE WHEN rel IN ('OFFERS', 'INTENDS_SERVICE') THEN 'PLANNED_SERVICE' ELSE rel END AS rel, dst, CASE WHEN rel = 'OFFERS' THEN 'planned' ELSE status END AS status FROM k)
SELECT x.seq, x.src, CASE WHEN x.rel = 'PLANNED_SERVICE' AND NOT p.planned THEN 'OFFERS' ELSE x.rel END AS rel, x.dst, CASE WHEN x.rel = 'PLANNED_SERVICE' AND NOT p.planned AND x.status = 'planned' THEN 'active' ELSE x.status END AS status FROM x LEFT JOIN p ON p.name = x.src""")
def planned_repair(s, d):
    k = _known(_edges(s, d))
    to = k.groupBy(F.col("dst").alias("name")).agg(F.max(F.col("rel").isin("PLANS_SITE", "INTENDS_SERVICE")).alias("planned"))
    ends = to.unionByName(k.select(F.col("src").alias("name")).distinct().join(to.select("name"), "name", "left_anti").withColumn("planned", F.lit(False)))
    x = k.withColumns({"rel": F.when(F.col("rel").isin("OFFERS", "INTENDS_SERVICE"), "PLANNED_SERVICE").otherwise(F.col("rel")), "status": F.when(F.col("rel") == "OFFERS", "planned").otherwise(F.col("status"))})
    return rewrite.repair_planned(x, ends).select("seq", "src", "rel", "dst", "status")


_TYPED = "t AS (SELECT canonical_name AS name, min(base_types[1]) AS type FROM kg_entities WHERE canonical_name IS NOT NULL AND len(base_types) > 0 GROUP BY 1)"
_SIGS = ", ".join(f"('{r}', {list(a)!r}::VARCHAR[], {list(b)!r}::VARCHAR[])" for r, (_, a, b) in DEFAULT.relations.items())


@query(f"""WITH {_K}, {_TYPED}, sig(rel, st, dt) AS (VALUES {_SIGS}), x AS (SELECT k.seq, coalesce(a.type, '') AS st0, k.rel, coalesce(b.type, '') AS dt0 FROM k LEFT JOIN t a ON a.name = k.src LEFT JOIN t b ON b.name = k.dst)
SELECT seq, CASE WHEN sig.rel IS NULL THEN 'unknown' WHEN (len(st) = 0 OR list_contains(st, st0)) AND (len(dt) = 0 OR list_contains(dt, dt0)) THEN 'ok' WHEN (len(st) = 0 OR list_contains(st, dt0)) AND (len(dt) = 0 OR list_contains(dt, st0)) THEN 'flip' ELSE 'invalid' END AS direction
FROM x LEFT JOIN sig USING (rel)""")
def direction_validate(s, d):
    e = _with_types(s, d)
    rel = DEFAULT.signatures(s).select("rel", "src_types", "dst_types")
    return governance.check_direction(e, rel, s.createDataFrame([], "type string, bases array<string>")).select("seq", "direction")


def _types(s, d):
    t = T(s, d, "kg_entities").where("canonical_name is not null and size(base_types) > 0")
    return t.groupBy(F.col("canonical_name").alias("name")).agg(F.min(F.col("base_types")[0]).alias("type"))


def _with_types(s, d):
    e = _known(_edges(s, d)).select("seq", "src", "rel", "dst", "evidence_text")
    for end in ("src", "dst"):
        e = e.join(_types(s, d).select(F.col("name").alias(end), F.col("type").alias(f"{end}_type")), end, "left").fillna({f"{end}_type": ""})
    return e


_VALID = f"""v AS (SELECT x.*, CASE WHEN sig.rel IS NULL THEN 'unknown' WHEN (len(st) = 0 OR list_contains(st, st0)) AND (len(dt) = 0 OR list_contains(dt, dt0)) THEN 'ok' WHEN (len(st) = 0 OR list_contains(st, dt0)) AND (len(dt) = 0 OR list_contains(dt, st0)) THEN 'flip' ELSE 'invalid' END AS dir
 FROM (SELECT k.seq, k.src, k.rel, k.dst, k.evidence_text, coalesce(a.type, '') AS st0, coalesce(b.type, '') AS dt0 FROM k LEFT JOIN t a ON a.name = k.src LEFT JOIN t b ON b.name = k.dst WHERE k.src <> k.dst) x LEFT JOIN sig USING (rel) WHERE dir <> 'invalid')"""


@query(f"""WITH {_K}, {_TYPED}, sig(rel, st, dt) AS (VALUES {_SIGS}), {_VALID}
SELECT seq, CASE WHEN dir = 'flip' THEN dst ELSE src END AS src, rel, CASE WHEN dir = 'flip' THEN src ELSE dst END AS dst, CASE WHEN dir = 'flip' THEN dt0 ELSE st0 END AS src_type FROM v""")
def triples_validated(s, d):
    rel = DEFAULT.signatures(s).select("rel", "src_types", "dst_types")
    return curation.validated(_with_types(s, d), _types(s, d), rel, s.createDataFrame([], "type string, bases array<string>")).select("seq", "src", "rel", "dst", "src_type")


_STRUCT = "(" + ", ".join(f"'{r}'" for r in curation.STRUCTURAL) + ")"


@query(f"""WITH {_K}, {_TYPED}, sig(rel, st, dt) AS (VALUES {_SIGS}), {_VALID}, c AS (SELECT * FROM v WHERE rel IN ('OFFERS', 'VISITS')), r AS (SELECT CASE WHEN dir = 'flip' THEN dst ELSE src END AS src, rel, CASE WHEN dir = 'flip' THEN src ELSE dst END AS dst FROM v
 WHERE rel IN {_STRUCT} AND evidence_text <> '' AND (lower(src), rel, lower(dst)) NOT IN (SELECT (lower(src), rel, lower(dst)) FROM c))
SELECT src, rel, dst, count(*) AS n FROM (SELECT src, rel, dst FROM c UNION ALL SELECT DISTINCT src, rel, dst FROM r WHERE (lower(src), rel, lower(dst)) NOT IN (SELECT (lower(src), rel, lower(dst)) FROM c)) GROUP BY ALL""")
def core_facts_preserved(s, d):
    """Compiled triples hold two relations only; structural facts come back from the others."""
    rel, none = DEFAULT.signatures(s).select("rel", "src_types", "dst_types"), s.createDataFrame([], "type string, bases array<string>")
    raw = _with_types(s, d)
    valid = raw.where("src != dst").join(rel, "rel", "left")
    fits = lambda t, allowed: (F.size(allowed) == 0) | F.array_contains(allowed, F.col(t))
    ok = F.col("src_types").isNull() | (fits("src_type", "src_types") & fits("dst_type", "dst_types")) | (fits("dst_type", "src_types") & fits("src_type", "dst_types"))
    compiled = valid.where(ok & F.col("rel").isin("OFFERS", "VISITS")).select(*raw.columns)
    return curation.preserved(raw, compiled, _types(s, d), rel, none).groupBy("src", "rel", "dst").agg(F.count("*").alias("n"))


_LIST = lambda xs: "(" + ", ".join("'" + x.replace("'", "''") + "'" for x in xs) + ")"
_NOISE = f"""(length(n) <= 1 OR n IN {_LIST(curation.STOP_NODES)} OR {" OR ".join(f"ends_with(n, '{e}')" for e in curation.NOISE_ENDS)} OR {" OR ".join(f"starts_with(n, '{e}')" for e in curation.NOISE_STARTS)}
 OR (len(string_split_regex(n, '\\s+')) >= 4 AND len(list_filter(string_split_regex(n, '\\s+'), lambda w: w NOT IN {_LIST(curation.COMMON_WORDS)})) = 0))"""


@query(f"""WITH x AS (SELECT DISTINCT mention AS name FROM candidate_entities UNION SELECT DISTINCT from_mention FROM candidate_edges UNION SELECT relation_candidate FROM candidate_edges UNION SELECT unnest(string_split(text, ' ')) FROM eval_items),
y AS (SELECT name, regexp_replace(lower(coalesce(name, '')), '^[\\s\\x{{a0}}]+|[\\s\\x{{a0}}]+$', '', 'g') AS n FROM x) SELECT name, {_NOISE} AS noise FROM y WHERE name IS NOT NULL""")
def noise_names(s, d):
    e = T(s, d, "candidate_edges")
    x = T(s, d, "candidate_entities").select(F.col("mention").alias("name")).union(e.select("from_mention")).union(e.select("relation_candidate")).union(T(s, d, "eval_items").select(F.explode(F.split("text", " ", -1))))
    return x.where("name is not null").distinct().select("name", curation.is_noise(F.col("name")).alias("noise"))


@query(f"""WITH {_K} SELECT seq FROM k WHERE rel NOT IN ('OFFERS', 'OFFERS_SERVICE', 'PROVIDES', 'HAS_SERVICE') OR NOT EXISTS (SELECT 1 FROM k n WHERE n.rel = 'DOES_NOT_OFFER' AND n.src = k.src AND n.dst = k.dst)""")
def denied_services(s, d):
    return curation.without_denied_services(_known(_edges(s, d))).select("seq")


@query(f"""WITH {_K}, x AS (SELECT *, {_SC} AS weight FROM k), n AS (SELECT src AS name FROM k UNION SELECT dst FROM k), c AS (SELECT DISTINCT canonical_name AS name FROM kg_entities WHERE canonical_name IS NOT NULL)
SELECT name, (name IN (FROM c)) AS known, (SELECT round(sum(weight), 5) FROM x WHERE x.src = n.name) AS out_weight FROM n""")
def final_graph(s, d):
    known = T(s, d, "kg_entities").where("canonical_name is not null").select(F.col("canonical_name").alias("name"), F.lit(True).alias("known")).distinct()
    e, ents = solver.build_final(_known(_edges(s, d)), known)
    out = e.groupBy(F.col("src").alias("name")).agg(F.round(F.sum("weight"), 5).alias("out_weight"))
    return ents.join(out, "name", "left").select("name", F.coalesce("known", F.lit(False)).alias("known"), "out_weight")


# Resolution


@query(f"""WITH v AS (SELECT canonical_name AS name, embedding FROM (SELECT *, row_number() OVER (PARTITION BY canonical_name ORDER BY rec_id) AS r FROM kg_entities WHERE canonical_name IS NOT NULL AND {_USABLE}) WHERE r = 1)
SELECT a.name AS a, b.name AS b, {_SIMSQL.format(a="a.embedding", b="b.embedding")} AS sim FROM v a JOIN v b ON a.name < b.name WHERE list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) >= 0.9""")
def similar_names(s, d):
    return simjoin.similar(_named_vectors(s, d), 0.9).withColumn("sim", F.round("sim", 5))


def _named_vectors(s, d):
    x = T(s, d, "kg_entities").where("canonical_name is not null").where(F.size("embedding") == 64)
    x = x.where(F.exists("embedding", lambda v: v != 0) & ~F.exists("embedding", lambda v: v.isNull() | F.isnan(v)))
    x = x.withColumn("r", F.row_number().over(Window.partitionBy("canonical_name").orderBy("rec_id"))).where("r = 1")
    return x.select(F.col("canonical_name").alias("name"), "embedding")


@query(f"""WITH RECURSIVE v AS (SELECT canonical_name AS name, embedding FROM (SELECT *, row_number() OVER (PARTITION BY canonical_name ORDER BY rec_id) AS r FROM kg_entities WHERE canonical_name IS NOT NULL AND {_USABLE}) WHERE r = 1),
e AS (SELECT a.name AS x, b.name AS y FROM v a JOIN v b ON a.name <> b.name WHERE list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) >= 0.9),
r(x, g) AS (SELECT DISTINCT x, x FROM e UNION SELECT e.x, r.g FROM r JOIN e ON e.y = r.x), c AS (SELECT x, min(g) AS g FROM r GROUP BY x)
SELECT x AS name, first_value(x) OVER (PARTITION BY g ORDER BY strlen(x) DESC, x) AS survivor FROM c""")
def semantic_dedup(s, d):
    return resolve.semantic_duplicates(_named_vectors(s, d), 0.9)


_MERGED = f"""{_CE}, n AS (SELECT c.*, coalesce(am.canonical, c.canon) AS name FROM c LEFT JOIN am ON am.alias = c.canon WHERE c.canon <> ''), z AS (SELECT name, min(name) OVER (PARTITION BY split_part(name, ' ', 1)) AS survivor FROM (SELECT DISTINCT name FROM n))"""


@query(f"""WITH {_MERGED}, m AS (SELECT n.*, z.survivor FROM n JOIN z USING (name)), k AS (SELECT survivor, name, coalesce(min_by(status, seq) FILTER (status IS NOT NULL AND status NOT IN ('', 'unknown')), '') AS status, count(*) AS n, sum(coalesce(len(evidence), 0)) AS ev FROM m GROUP BY ALL),
b AS (SELECT survivor, list_sort(list(DISTINCT t.type)) AS base FROM (SELECT survivor, unnest(base_types) AS t FROM m) WHERE t.score >= 0.5 GROUP BY survivor), w AS (SELECT name, count(*) AS k FROM (SELECT name, unnest(base_types) AS t FROM n) WHERE t.score >= 0.5 GROUP BY name),
bare AS (SELECT DISTINCT survivor FROM z WHERE name NOT IN (SELECT name FROM w))
SELECT k.survivor AS name, sum(n) AS n, sum(ev) AS n_evidence, coalesce(arg_min(status, (name <> k.survivor, name)) FILTER (status <> ''), '') AS status, array_to_string(list_sort(list_distinct(coalesce(any_value(b.base), []) || CASE WHEN bool_or(bare.survivor IS NOT NULL) THEN ['concept'] ELSE [] END)), '|') AS base_types, count(*) - 1 AS n_merged
FROM k LEFT JOIN b ON b.survivor = k.survivor LEFT JOIN bare ON bare.survivor = k.survivor GROUP BY k.survivor""")
def merge_canonical(s, d):
    """Canonical entities whose names begin with the same word, made one."""
    c = _cands(s, d)
    x = cut(resolve.canonical_entities(c, resolve.alias_map(c)))
    z = x.select("name", F.min("name").over(Window.partitionBy(F.element_at(F.split("name", " "), 1))).alias("survivor"))
    gone = z.where("name != survivor").groupBy(F.col("survivor").alias("name")).agg(F.count("*").alias("n_merged"))
    out = resolve.merge_canonical(x, z).join(gone, "name", "left")
    return out.select("name", "n", "n_evidence", "status", joined("base_types").alias("base_types"), F.coalesce("n_merged", F.lit(0)).alias("n_merged"))


@query("""WITH z AS (SELECT DISTINCT src AS name, split_part(src, ' ', 1) AS survivor FROM kg_edges WHERE rel = 'RUNS_SITE'), x AS (SELECT coalesce(a.survivor, e.src) AS src, rel, coalesce(b.survivor, e.dst) AS dst, weight, status FROM kg_edges e LEFT JOIN z a ON a.name = e.src LEFT JOIN z b ON b.name = e.dst)
SELECT src, rel, dst, round(sum(weight), 5) AS weight, count(*) AS n FROM x WHERE src <> dst GROUP BY ALL""")
def nodes_merged(s, d):
    """All columns move with the edges; equal ones become one."""
    e = T(s, d, "kg_edges")
    none = F.create_map().cast("map<string,string>")
    e = e.select("src", "rel", "dst", "weight", F.lit(1).cast("long").alias("n"), "chunk_ids", "status", "condition", F.lit("").alias("evidence_text"), F.lit("").alias("fact"), none.alias("temporal"))
    z = e.where("rel = 'RUNS_SITE'").select(F.col("src").alias("name")).distinct().withColumn("survivor", F.element_at(F.split("name", " "), 1))
    out = store.merge_edge_rows(resolve.moved(e, z).withColumn("version", F.lit(0)))
    return out.select("src", "rel", "dst", F.round("weight", 5).alias("weight"), "n")


@query("""WITH a AS (SELECT canonical_name AS name, min(base_types[1]) AS type, min(status) AS status FROM kg_entities WHERE canonical_name IS NOT NULL AND source IS NOT NULL AND source < 'm' GROUP BY 1), b AS (SELECT canonical_name AS name, min(base_types[1]) AS type, min(status) AS status FROM kg_entities WHERE canonical_name IS NOT NULL AND source >= 'm' GROUP BY 1)
SELECT coalesce(a.name, b.name) AS name, coalesce(nullif(nullif(b.type, ''), 'concept'), a.type, b.type) AS type, coalesce(nullif(nullif(a.status, ''), 'unknown'), nullif(nullif(b.status, ''), 'unknown'), a.status, b.status) AS status FROM a FULL JOIN b USING (name)""")
def graph_entities(s, d):
    """Entities of some sources met again in others."""
    k = T(s, d, "kg_entities").where("canonical_name is not null")
    part = lambda df: df.groupBy(F.col("canonical_name").alias("name")).agg(F.min(F.try_element_at("base_types", F.lit(1))).alias("type"), F.min("status").alias("status"))
    return store.merge_stored(part(k.where("source < 'm'")), part(k.where("source >= 'm'")))


@query("""SELECT src, rel, dst, round(sum(weight), 5) AS weight, count(*) AS n, coalesce(min_by(status, (v, fact)) FILTER (coalesce(status, '') <> ''), '') AS status, len(list_distinct(flatten(list(coalesce(chunk_ids, []))))) AS n_chunks
FROM (SELECT *, CASE WHEN seq % 2 = 0 THEN 0 ELSE 1 END AS v, src || ' —[' || rel || ']→ ' || dst AS fact FROM kg_edges) GROUP BY src, rel, dst""")
def graph_edges(s, d):
    """Edges of two versions of a store made one."""
    e = T(s, d, "kg_edges").withColumns({"fact": graph.fact(), "evidence_text": F.coalesce(F.get("evidence", F.lit(0))["text"], F.lit("")), "version": (F.col("seq") % 2).cast("int"), "n": F.lit(1).cast("long")})
    e = e.select("src", "rel", "dst", "weight", "n", F.coalesce("chunk_ids", F.array().cast("array<string>")).alias("chunk_ids"), "status", "condition", "evidence_text", "fact", "version")
    return store.merge_edge_rows(e).select("src", "rel", "dst", F.round("weight", 5).alias("weight"), "n", "status", F.size("chunk_ids").cast("long").alias("n_chunks"))


# Retrieval

_TOK = rf"unnest(list_filter(string_split_regex(lower(%s), '[^a-z0-9]+'), lambda w: length(w) >= 3 AND w NOT IN ({_QSTOPS})))"


@query(rf"""WITH t AS (SELECT doc_id, {_TOK % "text"} AS token FROM documents), w(word) AS (VALUES ('laboratory samples'), ('patient transport'), ('invoice')), u AS (SELECT DISTINCT word, {_TOK % "word"} AS token FROM w),
x AS (SELECT word, doc_id, count(DISTINCT token) AS score, count(*) AS n FROM u JOIN t USING (token) GROUP BY ALL) SELECT word, doc_id, pos FROM (SELECT word, doc_id, row_number() OVER (PARTITION BY word ORDER BY score DESC, n DESC, doc_id) AS pos FROM x) WHERE pos <= 5""")
def fulltext_each(s, d):
    w = s.createDataFrame([("laboratory samples",), ("patient transport",), ("invoice",)], "word string")
    return retrieval.full_text_each(retrieval.token_table(T(s, d, "documents"), "doc_id", "text"), w, "doc_id", 5)


@query(rf"""WITH t AS (SELECT chunk_id, {_TOK % "text"} AS token FROM chunks), w(word, place) AS (VALUES ('which laboratory analyses samples for the clinic', 0), ('courier', 1), ('invoice', 2), ('appointments', 3), ('pharmacy', 4), ('billing', 5)), u AS (SELECT DISTINCT word, place, {_TOK % "word"} AS token FROM w),
x AS (SELECT word, place, chunk_id, row_number() OVER (PARTITION BY word ORDER BY count(DISTINCT token) DESC, count(*) DESC, chunk_id) AS pos FROM u JOIN t USING (token) GROUP BY word, place, chunk_id),
f AS (SELECT chunk_id, min((place, pos)) AS o FROM x WHERE pos <= CASE WHEN place = 0 THEN 10 ELSE 3 END GROUP BY chunk_id), g AS (SELECT chunk_id, o, row_number() OVER (ORDER BY o, chunk_id) AS pos FROM f)
SELECT chunk_id, pos FROM g WHERE o[1] = 0 OR (SELECT count(*) FROM f WHERE f.o[1] < g.o[1]) < 20""")
def chunks_by_words(s, d):
    index = retrieval.token_table(T(s, d, "chunks"), "chunk_id", "text")
    return retrieval.chunks_by_words(index, "which laboratory analyses samples for the clinic", ["courier", "invoice", "appointments", "pharmacy", "billing"])


@query(rf"""WITH {_QV}, n AS (SELECT canonical_name AS name FROM kg_entities WHERE canonical_name IS NOT NULL GROUP BY 1), q2(t) AS (VALUES ('who runs the valley walk-in desk and the surgical center of saint')), w AS (SELECT DISTINCT {_TOK % "t"} AS token FROM q2),
h AS (SELECT DISTINCT name, token FROM (SELECT name, {_TOK % "name"} AS token FROM n) JOIN w USING (token)), df AS (SELECT token, count(*) AS df FROM h GROUP BY token HAVING count(*) <= 5),
x AS (SELECT name, 1 AS tier, CAST(strlen(name) AS DOUBLE) AS score FROM n, q2 WHERE contains(t, lower(name)) AND length(name) > 2 UNION ALL SELECT name, 2, sum(6 - df) FROM h JOIN df USING (token) GROUP BY name UNION ALL SELECT name, 4, count(*) FROM h GROUP BY name)
SELECT name, m[1] AS tier, -m[2] AS score FROM (SELECT name, min((tier, -score)) AS m FROM x GROUP BY name) ORDER BY m, name LIMIT 5""")
def matched_entities(s, d):
    n = T(s, d, "kg_entities").where("canonical_name is not null").select(F.col("canonical_name").alias("name")).distinct()
    return retrieval.matched_entities(n, retrieval.token_table(n, "name", "name"), "who runs the valley walk-in desk and the surgical center of saint")


@query("""WITH h AS (SELECT src AS name FROM kg_edges GROUP BY src ORDER BY count(*) DESC, src LIMIT 1), e AS (SELECT src, rel, dst FROM kg_edges),
a AS (SELECT DISTINCT 'out' AS kind, src || ' -[' || rel || ']-> ' || dst AS line FROM e WHERE src IN (FROM h) ORDER BY line LIMIT 50), b AS (SELECT DISTINCT 'in' AS kind, src || ' -[' || rel || ']-> ' || dst AS line FROM e WHERE dst IN (FROM h) ORDER BY line LIMIT 50),
c AS (SELECT DISTINCT 'two' AS kind, x.src || ' -[' || x.rel || ']-> ' || x.dst || ' -[' || y.rel || ']-> ' || y.dst AS line FROM e x JOIN e y ON y.src = x.dst WHERE x.src IN (FROM h) AND y.dst <> x.src ORDER BY line LIMIT 30)
SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c""")
def entity_facts(s, d):
    e = _graph(s, d)
    hub = e.groupBy("src").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "src").first()["src"]
    return retrieval.entity_facts(e, hub)


@query("""WITH st AS (SELECT DISTINCT src AS name FROM kg_edges WHERE rel = 'RUNS_SITE'), u AS (SELECT src AS node, dst AS other FROM kg_edges UNION SELECT dst, src FROM kg_edges), near AS (SELECT DISTINCT other AS name FROM u WHERE node IN (FROM st)), m AS (SELECT DISTINCT src AS name, unnest(chunk_ids) AS chunk_id FROM kg_edges)
SELECT DISTINCT chunk_id FROM m WHERE name IN (FROM near) ORDER BY chunk_id LIMIT 20""")
def chunks_two_hops(s, d):
    e = _graph(s, d)
    return retrieval.chunks_two_hops(e, _mentions(s, d), e.where("rel = 'RUNS_SITE'").select(F.col("src").alias("name")))


@query(f"""WITH {_QV}, v AS (SELECT rec_id, list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(qe AS DOUBLE[])) AS sc FROM kg_entities, q WHERE {_USABLE} AND len(qe) = 64)
SELECT rec_id, round(sc, 5) AS score FROM v ORDER BY sc DESC, rec_id LIMIT 10""")
def vector_entities(s, d):
    x = T(s, d, "kg_entities").where(F.size("embedding") == 64).where(F.exists("embedding", lambda v: v != 0) & ~F.exists("embedding", lambda v: v.isNull() | F.isnan(v)))
    q = _query_vector(s, d)
    return vector.top_k(x, "embedding", q, 10, "rec_id").select("rec_id", F.round("score", 5).alias("score")) if len(q) == 64 else x.limit(0).select("rec_id", F.lit(0.0).alias("score"))


@query("""WITH x AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS back, event_type || ': ' || coalesce(props, '') AS line FROM events)
SELECT user_id, string_agg(CASE WHEN length(line) > 30 THEN line[1:30] || '...' ELSE line END, E'\n' ORDER BY back DESC) AS history FROM x WHERE back <= 6 GROUP BY user_id""")
def chat_last6(s, d):
    """The last six turns of every conversation, each cut after 30 characters."""
    line = F.concat("event_type", F.lit(": "), F.coalesce("props", F.lit("")))
    x = T(s, d, "events").withColumn("back", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id")))).where("back <= 6")
    x = x.select("user_id", "back", F.when(F.length(line) > 30, F.concat(F.substring(line, 1, 30), F.lit("..."))).otherwise(line).alias("line"))
    return x.groupBy("user_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.negate("back").alias("o"), "line"))), lambda z: z.line), "\n").alias("history"))


# Governance


@query(r"""WITH p AS (SELECT DISTINCT upper(trim(regexp_replace(trim(relation_candidate), '[ -]+', '_', 'g'))) AS name FROM candidate_edges WHERE relation_candidate IS NOT NULL), k AS (SELECT upper(relation_id) AS m FROM relations),
a AS (SELECT upper(regexp_replace(unnest(aliases), '[ -]+', '_', 'g')) AS alias, relation_id AS m FROM relations), x AS (
 SELECT name, 0 AS pr, 'invalid' AS decision, NULL AS match, 1.0 AS confidence, false AS needs_model FROM p WHERE name = '' UNION ALL SELECT name, 1, 'synonym', m, 1.0, false FROM p JOIN k ON k.m = p.name
 UNION ALL SELECT name, 2, CASE WHEN m LIKE 'R%' THEN 'inverse' ELSE 'synonym' END, m, 1.0, false FROM p JOIN a ON a.alias = p.name
 UNION ALL SELECT name, 3, 'inverse', m, 0.8, true FROM (SELECT name, m, row_number() OVER (PARTITION BY name ORDER BY CASE WHEN m = b || 'S' THEN 0 WHEN m = b THEN 1 ELSE 2 END) AS r FROM (SELECT name, name[1:-4] AS b FROM p WHERE ends_with(name, '_BY')) JOIN k ON m IN (b || 'S', b, b || 'ES')) WHERE r = 1
 UNION ALL SELECT name, 3, 'inverse', m, 0.8, true FROM p JOIN k ON m = name || '_BY' WHERE NOT ends_with(name, '_BY')
 UNION ALL SELECT name, 4, 'synonym', m, 0.8, true FROM p JOIN k ON len(string_split(name, '_')) > 1 AND len(string_split(name, '_')) = len(string_split(m, '_')) AND list_sort(list_distinct(string_split(lower(name), '_'))) = list_sort(list_distinct(string_split(lower(m), '_'))) WHERE name <> ''
 UNION ALL SELECT name, 5, 'too_vague', NULL, 0.7, true FROM p WHERE len(string_split(name, '_')) > 3 UNION ALL SELECT name, 6, 'accept_new', NULL, 0.5, true FROM p WHERE name <> '')
SELECT name, decision, match, confidence, needs_model FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY pr, match) AS r FROM x) WHERE r = 1""")
def check_relations(s, d):
    name = F.regexp_replace(F.btrim("relation_candidate"), "[ -]+", "_")
    r = T(s, d, "relations")
    al = r.select(F.explode("aliases").alias("alias"), F.col("relation_id").alias("canonical")).withColumns({"alias": F.regexp_replace("alias", "[ -]+", "_"), "flip": F.col("canonical").startswith("R")})
    return governance.check_relations(T(s, d, "candidate_edges").where("relation_candidate is not null").select(name.alias("name")), r.select(F.col("relation_id").alias("name")), al)


@query("""WITH x AS (SELECT e.rel, d.type FROM kg_edges e JOIN (SELECT canonical_name AS name, unnest(base_types) AS type FROM kg_entities WHERE canonical_name IS NOT NULL) d ON d.name = e.src WHERE coalesce(d.type, '') <> ''), c AS (SELECT rel, type, count(*) AS count FROM x GROUP BY ALL)
SELECT rel, type, count, rank FROM (SELECT *, row_number() OVER (PARTITION BY rel ORDER BY count DESC, type) AS rank FROM c) WHERE rank <= 3""")
def top_types(s, d):
    t = T(s, d, "kg_entities").where("canonical_name is not null").select(F.col("canonical_name").alias("src"), F.explode("base_types").alias("type"))
    return governance.top_types(_graph(s, d).join(t, "src"), "rel", "type")


@query("""WITH t AS (SELECT DISTINCT lower(trim(u)) AS name FROM (SELECT unnest(domain_types) AS u FROM kg_entities)), p AS (SELECT name FROM t WHERE name IS NOT NULL AND name <> ''), k AS (SELECT DISTINCT lower(trim(u)) AS m FROM (SELECT unnest(domain_types) AS u FROM kg_entities WHERE status = 'planned') WHERE u IS NOT NULL),
n AS (SELECT name FROM p WHERE name NOT IN (SELECT m FROM k)) SELECT name, CASE WHEN EXISTS (SELECT 1 FROM k WHERE list_sort(list_distinct(string_split_regex(m, '[_ ]+'))) = list_sort(list_distinct(string_split_regex(name, '[_ ]+')))) THEN 'word_order'
 WHEN EXISTS (SELECT 1 FROM k WHERE len(list_intersect(string_split_regex(m, '[_ ]+'), string_split_regex(name, '[_ ]+'))) / len(list_distinct(list_concat(string_split_regex(m, '[_ ]+'), string_split_regex(name, '[_ ]+')))) >= 0.7) THEN 'similar' ELSE 'new' END AS decision FROM n WHERE name NOT IN ('thing','entity','item','object','stuff','other','misc')""")
def evolve_types(s, d):
    """Domain types of all entities against those of planned ones."""
    k = T(s, d, "kg_entities")
    known = k.where("status = 'planned'").select(F.explode("domain_types").alias("name")).select(F.lower(F.btrim("name")).alias("name")).where("name is not null").distinct()
    _, cand = governance.evolved_types(k.select(F.explode("domain_types").alias("type")), known, s.createDataFrame([], "alias string, canonical string"))
    return cand.select("name", "decision")


@query(f"""WITH {_E}, {_TYPED}, r AS (SELECT relation_id AS rel FROM relations), x AS (SELECT rel, a.type FROM e JOIN r USING (rel) LEFT JOIN t a ON a.name = e.src)
SELECT r.rel AS name, coalesce(array_to_string(list_sort(list(DISTINCT x.type) FILTER (x.type IS NOT NULL AND x.type <> '')), '|'), '') AS src_types FROM r LEFT JOIN x USING (rel) GROUP BY r.rel""")
def evolve_relations(s, d):
    r = T(s, d, "relations").select(F.col("relation_id").alias("name"), F.array().cast("array<string>").alias("src_types"), F.array().cast("array<string>").alias("dst_types"))
    t = _types(s, d)
    e = _edges(s, d).select("src", "rel", "dst").join(t.select(F.col("name").alias("src"), F.col("type").alias("src_type")), "src", "left").withColumn("dst_type", F.lit("")).fillna({"src_type": ""})
    grown, _ = governance.evolved_relations(e, r, s.createDataFrame([], "alias string, canonical string, flip boolean"))
    return grown.select("name", joined("src_types").alias("src_types"))


@query(f"""WITH {_E}, k AS (SELECT upper(relation_id) AS rel FROM relations), a AS (SELECT upper(unnest(aliases)) AS alias, min(relation_id) AS canonical FROM relations GROUP BY 1), x AS (SELECT seq, src, dst, upper(trim(relation_raw)) AS raw FROM e)
SELECT seq, CASE WHEN use AND starts_with(canonical, 'R') THEN dst ELSE src END AS src, CASE WHEN use THEN canonical ELSE raw END AS rel, CASE WHEN use AND starts_with(canonical, 'R') THEN src ELSE dst END AS dst FROM (SELECT x.*, a.canonical, k.rel IS NULL AND a.canonical IS NOT NULL AS use FROM x LEFT JOIN k ON k.rel = raw LEFT JOIN a ON a.alias = raw)""")
def normalise_relations(s, d):
    r = T(s, d, "relations")
    al = r.select(F.explode("aliases").alias("alias"), "relation_id").groupBy(F.upper("alias").alias("alias")).agg(F.min("relation_id").alias("canonical")).withColumn("flip", F.col("canonical").startswith("R"))
    return governance.normalised(_edges(s, d).select("seq", "src", F.col("relation_raw").alias("rel"), "dst"), r.select(F.col("relation_id").alias("name")), al).select("seq", "src", "rel", "dst")


# Statements


@query(f"""WITH n AS ({_ENT}), g AS (SELECT DISTINCT src, rel, dst, weight FROM kg_edges), x AS (SELECT a.name AS a, g.rel, b.name AS b, weight FROM n a JOIN g ON g.src = a.name JOIN n b ON b.name = g.dst WHERE a.type = 'organization')
SELECT a, b, round(weight, 6) AS w FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY weight DESC, b) AS r FROM x) WHERE r <= 2""")
def cypher_subquery(s, d):
    x = _cypher(s, d, "MATCH (a:organization) CALL { WITH a MATCH (a)-[r]->(b) RETURN b.name AS b, r.weight AS w ORDER BY w DESC, b LIMIT 2 } RETURN a.name AS a, b, w")
    return x.withColumn("w", F.round("w", 6))


@query(f"""WITH n AS ({_ENT}) SELECT CASE WHEN type IN ('person', 'organization') THEN type ELSE 'thing' END AS kind, count(*) AS n, array_to_string(list_sort(list(name))[2:3], '|') AS some FROM n GROUP BY 1""")
def cypher_case_slice(s, d):
    x = _cypher(s, d, "MATCH (n) RETURN CASE WHEN n.type IN ['person', 'organization'] THEN n.type ELSE 'thing' END AS kind, count(*) AS n, collect(n.name)[1..3] AS some")
    return x.withColumn("some", F.array_join("some", "|"))


@query("SELECT DISTINCT rel AS relationshipType FROM kg_edges")
def cypher_relationship_types(s, d):
    return _cypher(s, d, "CALL db.relationshipTypes() YIELD relationshipType RETURN relationshipType")


@query(rf"""WITH n AS ({_ENT}), t AS (SELECT name, {_TOK % "name"} AS token FROM n) SELECT name, CAST(count(DISTINCT token) AS DOUBLE) AS score FROM t WHERE token IN ('valley', 'clinic', 'laboratory') GROUP BY name""")
def cypher_fulltext(s, d):
    return _cypher(s, d, "CALL db.idx.fulltext.queryNodes('Concept', 'the valley clinic and laboratory') YIELD node, score RETURN node.name AS name, score")


@query(f"""WITH n AS ({_ENT}), x AS (SELECT name FROM n WHERE type = 'person' UNION SELECT name FROM n WHERE contains(name, 'clinic')) SELECT name FROM x ORDER BY name LIMIT 20 OFFSET 10""")
def cypher_union_paging(s, d):
    x = _cypher(s, d, "MATCH (n:person) RETURN n.name AS name UNION MATCH (n) WHERE n.name CONTAINS 'clinic' RETURN n.name AS name")
    return x.orderBy("name").offset(10).limit(20)


@query(f"""WITH n AS ({_ENT}), g AS (SELECT DISTINCT src, rel, dst FROM kg_edges) SELECT u.nm, count(*) AS n FROM (VALUES ('RUNS_SITE'), ('LEADS_TEAM'), ('NO_SUCH')) u(nm) JOIN g ON g.rel = u.nm JOIN n a ON a.name = g.src JOIN n b ON b.name = g.dst GROUP BY u.nm""")
def cypher_unwind(s, d):
    return _cypher(s, d, "UNWIND $rels AS nm MATCH (a)-[r]->(b) WHERE type(r) = nm RETURN nm, count(*) AS n", rels=["RUNS_SITE", "LEADS_TEAM", "NO_SUCH"])


def _written(s, d, text, **params):
    from kgspark.plans.cypher_write import update

    ents = T(s, d, "kg_entities").where("canonical_name is not null").select(F.col("canonical_name").alias("name"), F.coalesce(F.try_element_at("base_types", F.lit(1)), F.lit("concept")).alias("type"))
    return update(ents.groupBy("name").agg(F.min("type").alias("type")), T(s, d, "kg_edges").groupBy("src", "rel", "dst").agg(F.sum("weight").alias("weight")), text, params)


@query(f"""WITH n AS ({_ENT}), g AS (SELECT src, rel, dst, sum(weight) AS weight FROM kg_edges GROUP BY ALL)
SELECT name, type, CASE WHEN type = 'organization' AND contains(name, 'clinic') THEN 'clinic' END AS kind FROM n""")
def cypher_set(s, d):
    return _written(s, d, "MATCH (n:organization) WHERE n.name CONTAINS 'clinic' SET n.kind = 'clinic'")[0]


@query(f"""WITH n AS ({_ENT}), g AS (SELECT src, rel, dst, sum(weight) AS weight FROM kg_edges GROUP BY ALL), r AS (SELECT DISTINCT src, dst FROM g JOIN n a ON a.name = src JOIN n b ON b.name = dst WHERE rel = 'RUNS_SITE')
SELECT src, rel, dst, round(coalesce(weight, 0) + extra, 6) AS weight FROM (SELECT g.src, g.rel, g.dst, g.weight, CASE WHEN g.rel = 'SUBUNIT_OF' AND (g.dst, g.src) IN (SELECT (src, dst) FROM r) THEN 0.5 ELSE 0 END AS extra FROM g
 UNION ALL SELECT dst, 'SUBUNIT_OF', src, 1.0, 0 FROM r WHERE (dst, src) NOT IN (SELECT (src, dst) FROM g WHERE rel = 'SUBUNIT_OF'))""")
def cypher_merge(s, d):
    e = _written(s, d, "MATCH (a)-[:RUNS_SITE]->(b) MERGE (b)-[r:SUBUNIT_OF]->(a) ON CREATE SET r.weight = 1.0 ON MATCH SET r.weight = r.weight + 0.5")[1]
    return e.select("src", "rel", "dst", F.round("weight", 6).alias("weight"))


@query(f"""WITH n AS ({_ENT}), p AS (SELECT name FROM n WHERE type = 'event') SELECT src, rel, dst FROM kg_edges WHERE src NOT IN (FROM p) AND dst NOT IN (FROM p) GROUP BY ALL""")
def cypher_delete(s, d):
    return _written(s, d, "MATCH (n:event) DETACH DELETE n")[1].select("src", "rel", "dst")


# Aggregates, sets, windows


@query("SELECT rel, count(*) AS n, count(condition) FILTER (condition <> '') AS n_conditions, sum(CASE WHEN len(evidence) > 0 THEN 1 ELSE 0 END) AS n_evidence FROM kg_edges GROUP BY rel")
def count_per_relation(s, d):
    return graph.per_relation(T(s, d, "kg_edges"))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50 OFFSET 100")
def paging(s, d):
    return T(s, d, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").offset(100).limit(50).select("o_orderkey", "o_totalprice")


@query("SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def union_distinct(s, d):
    return T(s, d, "customer").select(F.col("c_nationkey").alias("k")).union(T(s, d, "supplier").select("s_nationkey")).distinct()


@query("SELECT o_orderkey, ntile(10) OVER w AS tenth, round(percent_rank() OVER w, 6) AS share, dense_rank() OVER (PARTITION BY o_orderstatus ORDER BY o_orderpriority) AS priority FROM orders WINDOW w AS (PARTITION BY o_orderstatus ORDER BY o_totalprice, o_orderkey)")
def window_ranks(s, d):
    w = Window.partitionBy("o_orderstatus").orderBy("o_totalprice", "o_orderkey")
    p = Window.partitionBy("o_orderstatus").orderBy("o_orderpriority")
    return T(s, d, "orders").select("o_orderkey", F.ntile(10).over(w).alias("tenth"), F.round(F.percent_rank().over(w), 6).alias("share"), F.dense_rank().over(p).alias("priority"))


@query(f"""WITH {_K} SELECT src || '|' || rel || '|' || dst AS line, row_number() OVER (ORDER BY src, rel, dst, seq) AS place FROM k""")
def output_order(s, d):
    """The order of a final graph's edges, numbered by ranges: no task sorts all of them."""
    return graph.numbered(_known(_edges(s, d)), "src", "rel", "dst", "seq").select(F.concat_ws("|", "src", "rel", "dst").alias("line"), "place")


@query("SELECT n_name FROM nation WHERE n_regionkey IN (SELECT r_regionkey FROM region WHERE r_name < 'B')")
def semi_join(s, d):
    return T(s, d, "nation").join(T(s, d, "region").where("r_name < 'B'"), F.col("n_regionkey") == F.col("r_regionkey"), "left_semi").select("n_name")


@query(rf"""WITH x AS (SELECT seq, mention FROM candidate_entities GROUP BY ALL) SELECT seq, array_to_string(list_transform(string_split(regexp_replace(regexp_replace(mention, '[^A-Za-z0-9]+', ' ', 'g'), '^ +| +$', '', 'g'), ' '), lambda w: upper(w[1:1]) || w[2:]), '') AS label,
 CASE WHEN regexp_replace(regexp_replace(upper(trim(mention)), '[^A-Z0-9_]+', '_', 'g'), '^_+|_+$', '', 'g') = '' THEN 'RELATED' ELSE regexp_replace(regexp_replace(upper(trim(mention)), '[^A-Z0-9_]+', '_', 'g'), '^_+|_+$', '', 'g') END AS rel FROM x WHERE mention IS NOT NULL""")
def labels(s, d):
    x = T(s, d, "candidate_entities").where("mention is not null").select("seq", "mention").distinct()
    return x.select("seq", tx.pascal_label(F.col("mention")).alias("label"), tx.relation_label(F.col("mention")).alias("rel"))


# Chunkers: without overlap, what the chunks hold is what the text holds, but for blanks

_BARE = r"SELECT doc_id, md5(regexp_replace(text, '[\s\x{a0}\x{85}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+', '', 'g')) AS text_hash FROM documents WHERE text IS NOT NULL AND regexp_matches(text, '[^\s\x{a0}]')"
_BLANKS = r"[\s \u0085  -     　]+"


def _rejoined(chunks):
    x = chunks.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", "text"))), lambda c: c.text), "").alias("t"))
    return x.select("doc_id", F.md5(F.regexp_replace("t", _BLANKS, "")).alias("text_hash"))


@query(_BARE)
def chunk_recursive_text(s, d):
    return _rejoined(chunking.chunk(T(s, d, "documents"), "recursive", 400, 0).withColumn("text", F.regexp_replace("text", r"^Context: Section = [^\n]*\n\n", "")))


@query(_BARE)
def chunk_sentence_text(s, d):
    return _rejoined(chunking.chunk(T(s, d, "documents"), "sentence", 400, 0).withColumn("text", F.regexp_replace("text", r"^Context: Section = [^\n]*\n\n", "")))


_DOC = " OR ".join(f"contains(lower(name), '{w}')" for w in resolve.DOCUMENT_SIGNS)


@query(rf"""WITH x AS (SELECT seq, mention AS name, coalesce(list_max(list_transform(base_types, lambda t: t.score)), 0) AS top, coalesce(len(evidence), 0) AS ev, coalesce(len(functional_roles), 0) AS roles, coalesce(status, '') NOT IN ('', 'unknown') AS known FROM candidate_entities WHERE mention IS NOT NULL GROUP BY ALL)
SELECT seq, round(3 * len(string_split_regex(name, '\s+')) + 10 * top + 2 * ev + 3 * roles + CASE WHEN known THEN 2 ELSE 0 END - CASE WHEN {_DOC} THEN 20 ELSE 0 END - CASE WHEN len(string_split_regex(name, '\s+')) = 1 AND strlen(name) <= 6 THEN 15 ELSE 0 END, 6) AS score FROM x""")
def canonical_score(s, d):
    x = T(s, d, "candidate_entities").where("mention is not null").dropDuplicates(["seq"])
    none = F.array().cast("array<struct<type:string,score:double>>")
    top = F.coalesce(F.array_max(F.transform(F.coalesce("base_types", none), lambda t: t.score)), F.lit(0.0))
    size = lambda c: F.greatest(F.size(F.coalesce(c, F.array().cast(dict(x.dtypes)[c]))), F.lit(0))
    score = resolve.canonical_score(F.col("mention"), top, size("evidence"), size("functional_roles"), ~F.coalesce("status", F.lit("")).isin("", "unknown"), F.lit(False))
    return x.select("seq", F.round(score, 6).alias("score"))
