"""The registry of queries over the project's tables, each with its DuckDB twin where SQL has one.

Every query runs over whole tables. Results hold scalars only, with arrays joined to strings.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kgspark.functions import text as tx
from kgspark.functions import vector
from kgspark.operators import chunking, closure, governance, graph, ner, resolve, retrieval, rewrite, simjoin, solver
from kgspark.ontology import DEFAULT
from kgspark.plans import cypher
from kgspark.session import table as T
from kgspark.sources import loaders, store
from kgspark.streaming import events as ev

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def joined(c, sep: str = "|"):
    return F.array_join(F.array_sort(c), sep)


# Sources


@query("SELECT sha256(text) AS content_hash, count(*) AS n, min(doc_id) AS first_id FROM documents WHERE text IS NOT NULL GROUP BY 1")
def content_hash_dedup(s, d):
    x = T(s, d, "documents").where("text is not null").withColumn("content_hash", loaders.content_hash(F.col("text")))
    return x.groupBy("content_hash").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id"))


@query("""WITH st AS (SELECT doc_id, sha256(text) AS h FROM documents WHERE source IS NOT NULL)
SELECT d.doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM st WHERE st.doc_id = d.doc_id AND st.h = sha256(d.text))""")
def changed_documents(s, d):
    x = T(s, d, "documents").withColumn("content_hash", loaders.content_hash(F.col("text")))
    return store.changed(x.select("doc_id", "content_hash"), x.where("source is not null")).select("doc_id")


@query(r"""SELECT doc_id, CASE WHEN trim(coalesce(source, '')) <> '' THEN trim(source) ELSE 'doc-' || sha256(text)[1:16] END AS document_id FROM documents""")
def document_ids(s, d):
    return T(s, d, "documents").select("doc_id", loaders.document_id(F.col("source"), F.col("text")).alias("document_id"))


@query(r"""WITH a AS (SELECT doc_id, regexp_replace(text, '(?i)<(br|p|div|h[1-6]|li|tr)([^>]*)>', E'\n<\\1\\2>', 'g') AS t FROM documents),
b AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(t, '(?is)<script[^>]*>.*?</script>', '', 'g'), '(?is)<style[^>]*>.*?</style>', '', 'g'), '<[^>]+>', '', 'g') AS t FROM a),
c AS (SELECT doc_id, replace(replace(replace(replace(replace(replace(t, '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' ') AS t FROM b)
SELECT doc_id, md5(regexp_replace(regexp_replace(t, '\n{3,}', E'\n\n', 'g'), '^[\s\x{a0}]+|[\s\x{a0}]+$', '', 'g')) AS text_hash FROM c""")
def html_strip(s, d):
    return T(s, d, "documents").select("doc_id", F.md5(loaders.strip_html(F.col("text"))).alias("text_hash"))


@query(r"""SELECT doc_id, trim(regexp_extract(text, '(?m)^\s*# (.*)$', 1)) AS title,
array_to_string(list_transform(regexp_extract_all(text, '(?m)^[ \t]*(#{1,6} .*)$', 1), lambda h: 'h' || length(regexp_extract(h, '^(#+)', 1)) || ':' || trim(regexp_replace(h, '^#+', ''))), '|') AS headings
FROM documents WHERE text IS NOT NULL""")
def markdown_headings(s, d):
    x = T(s, d, "documents").where("text is not null")
    return x.select("doc_id", loaders.markdown_title(F.col("text")).alias("title"), loaders.markdown_headings(F.col("text")).alias("headings"))


@query("""WITH r AS (SELECT row_number() OVER (ORDER BY n_nationkey) AS i, n_nationkey, n_name, n_regionkey FROM nation)
SELECT string_agg('Record ' || i || E':\n  n_nationkey: ' || n_nationkey || E'\n  n_name: ' || n_name || E'\n  n_regionkey: ' || n_regionkey || E'\n', E'\n' ORDER BY i) AS content, 25 AS n_rows FROM r""")
def table_records(s, d):
    x = T(s, d, "nation").withColumn("i", F.col("n_nationkey"))
    return loaders.records(x, "i").select("content", "n_rows")


# Chunking and recognition


@query()
def chunk_recursive(s, d):
    return chunking.chunk(T(s, d, "documents"), "recursive")


@query()
def chunk_sentence(s, d):
    return chunking.chunk(T(s, d, "documents"), "sentence")


@query()
def chunk_structural(s, d):
    return chunking.chunk(T(s, d, "documents"), "structural")


@query("SELECT chunk_id, doc_id, chunk_index, lead(chunk_id) OVER (PARTITION BY doc_id ORDER BY chunk_index) AS next_chunk_id FROM chunks")
def next_chunk(s, d):
    return chunking.link(T(s, d, "chunks").select("chunk_id", "doc_id", "chunk_index"))


@query()
def ner_spans(s, d):
    x = ner.recognise(T(s, d, "chunks"), "chunk_id", "text")
    return x.withColumn("base_type", ner.base_type(F.col("label")))


# Predicates over texts

_STOPS = ", ".join(f"'{w}'" for w in tx.KEYWORD_STOPS)
_QSTOPS = ", ".join(f"'{w}'" for w in tx.QUESTION_STOPS)


@query(rf"""SELECT item_id, array_to_string(list_filter(string_split_regex(trim(regexp_replace(lower(text), '[?.!,;:''"\-()\[\]]+', ' ', 'g')), '\s+'), lambda w: w NOT IN ({_STOPS}) AND strlen(w) > 2)[1:12], '|') AS keywords FROM eval_items""")
def keywords_simple(s, d):
    return T(s, d, "eval_items").select("item_id", F.array_join(tx.keywords(F.col("text")), "|").alias("keywords"))


@query(rf"""SELECT doc_id, len(list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda w: length(w) >= 3 AND w NOT IN ({_QSTOPS}))) AS n_tokens FROM documents WHERE text IS NOT NULL""")
def query_tokens(s, d):
    return T(s, d, "documents").where("text is not null").select("doc_id", F.size(tx.tokens(F.col("text"))).alias("n_tokens"))


_CUES = " OR ".join(f"contains(' ' || lower(q) || ' ', '{c}')" for c in tx.ANALYTICAL_CUES)


@query(rf"""WITH x AS (SELECT item_id, s AS q FROM (SELECT item_id, unnest(string_split_regex(text, '[.?!] ')) AS s FROM eval_items))
SELECT item_id, q, CASE WHEN regexp_matches(lower(trim(q)), '^({"|".join(tx.YES_NO)}) ') THEN 'yes_no' WHEN starts_with(lower(trim(q)), 'who ') THEN 'who' WHEN starts_with(lower(trim(q)), 'where ') THEN 'where'
 WHEN starts_with(lower(trim(q)), 'when ') THEN 'when' WHEN regexp_matches(lower(trim(q)), '^how (many|much)') THEN 'number' ELSE '' END AS kind,
 regexp_matches(q, '{tx.ENUMERATION}') AS wants_all, ({_CUES}) AS wants_analysis FROM x GROUP BY ALL""")
def question_flags(s, d):
    x = T(s, d, "eval_items").select("item_id", F.explode(F.split("text", "[.?!] ")).alias("q")).distinct()
    q = F.col("q")
    return x.select("item_id", "q", tx.question_type(q).alias("kind"), tx.wants_all(q).alias("wants_all"), tx.wants_analysis(q).alias("wants_analysis"))


@query(rf"""WITH x AS (SELECT seq, mention, base_types FROM candidate_entities UNION ALL SELECT event_id, strftime(ts, '%H:%M'), [] FROM events UNION ALL SELECT event_id, event_type, [{{'type': 'money', 'score': value / 100}}] FROM events)
SELECT seq, mention FROM x WHERE regexp_matches(lower(trim(mention)), '{tx.RAW_TEMPORAL}') OR len(list_filter(base_types, lambda t: t.type IN ('date_time','quantity','money','identifier') AND t.score >= 0.5)) > 0 GROUP BY ALL""")
def raw_value_entities(s, d):
    ev = T(s, d, "events")
    none = F.array().cast("array<struct<type:string,score:double>>")
    x = T(s, d, "candidate_entities").select("seq", "mention", "base_types").unionByName(ev.select(F.col("event_id").alias("seq"), F.date_format("ts", "HH:mm").alias("mention"), none.alias("base_types")))
    x = x.unionByName(ev.select(F.col("event_id").alias("seq"), F.col("event_type").alias("mention"), F.array(F.struct(F.lit("money").alias("type"), (F.col("value") / 100).alias("score"))).alias("base_types")))
    return x.where(resolve.is_raw_value(F.col("base_types"), F.col("mention"))).select("seq", "mention").distinct()


# Rewriting


def _edges(s, d):
    """candidate_edges as edges, repeated deliveries once."""
    x = T(s, d, "candidate_edges").dropDuplicates(["seq"])
    z = lambda c: F.coalesce(F.col(c), F.lit(""))
    return x.select(
        "seq", tx.name_key(F.col("from_mention")).alias("src"), F.upper(F.btrim(z("relation_id_candidate"))).alias("rel"), tx.name_key(F.col("to_mention")).alias("dst"), z("relation_candidate").alias("relation_raw"),
        z("evidence_text").alias("evidence_text"), z("chunk_id").alias("chunk_id"), "evidence_score", "schema_fit_score", "confidence", z("alternative_group").alias("alternative_group"), z("status").alias("status"), z("condition").alias("condition"),
    )


_E = r"""e AS (SELECT DISTINCT ON (seq) seq, regexp_replace(lower(coalesce(from_mention, '')), '^[\s\x{a0}]+|[\s\x{a0}]+$', '', 'g') AS src, upper(trim(coalesce(relation_id_candidate, ''))) AS rel,
 regexp_replace(lower(coalesce(to_mention, '')), '^[\s\x{a0}]+|[\s\x{a0}]+$', '', 'g') AS dst, coalesce(relation_candidate, '') AS relation_raw, coalesce(evidence_text, '') AS evidence_text, coalesce(chunk_id, '') AS chunk_id,
 evidence_score, schema_fit_score, confidence, coalesce(alternative_group, '') AS alternative_group, coalesce(status, '') AS status, coalesce(condition, '') AS condition FROM candidate_edges ORDER BY seq)"""
_any = lambda col, phrases: "(" + " OR ".join("contains(lower(%s), '%s')" % (col, p.replace("'", "''")) for p in phrases) + ")"
_RES = ", ".join(f"('{k}', '{r}', {known}, {flip})" for k, (r, known, flip) in DEFAULT.resolutions().items())


@query(f"""WITH m(raw, relation, known, flip) AS (VALUES {_RES}), {_E},
x AS (SELECT seq, src, dst, rel, CASE WHEN rel = '' THEN coalesce(m.relation, upper(trim(e.relation_raw))) ELSE rel END AS relation, CASE WHEN rel = '' THEN coalesce(m.flip, false) ELSE false END AS flip FROM e LEFT JOIN m ON m.raw = upper(trim(e.relation_raw)))
SELECT seq, CASE WHEN flip THEN dst ELSE src END AS src, relation AS rel, CASE WHEN flip THEN src ELSE dst END AS dst FROM x WHERE src <> dst AND (rel <> '' OR relation <> '')""")
def resolve_relations(s, d):
    return rewrite.resolve_relations(_edges(s, d)).select("seq", "src", "rel", "dst")


_NEG = " ".join(f"WHEN rel = '{p}' THEN '{n}'" for p, n in rewrite.NEGATIVES.items())
# the tables' own relations stand for the built-in ones, so that the rules meet real evidence
_OWN = {"GIVES_SERVICE": "OFFERS", "ANALYSES_SAMPLES": "PROCESSES_TESTS_FOR", "CARRIES_SAMPLES": "TRANSPORTS_SAMPLES_FOR", "COLLECTS_PAYMENT": "HANDLES_BILLING_FOR", "SIGNED_DEAL": "CONTRACTED_WITH", "RUNS_SITE": "HAS_BRANCH", "SUBUNIT_OF": "PART_OF", "LEADS_TEAM": "MANAGES", "EMPLOYED_WITH": "BASED_AT", "ROTATES_THROUGH": "VISITS", "ALLIED_TO": "PARTNERS_WITH", "LACKS_DEAL": "NO_CONTRACT_WITH", "REFUSES_SERVICE": "DOES_NOT_OFFER", "LEFT_POST_AT": "DOES_NOT_WORK_AT"}
_OWNSQL = "CASE " + " ".join(f"WHEN rel = '{a}' THEN '{b}'" for a, b in _OWN.items()) + " ELSE rel END"


def _known(df):
    pairs = [F.lit(x) for kv in _OWN.items() for x in kv]
    return df.withColumn("rel", F.coalesce(F.try_element_at(F.create_map(*pairs), F.col("rel")), "rel"))


_K = _E + f", k AS (SELECT * REPLACE ({_OWNSQL} AS rel) FROM e)"


@query(f"""WITH {_K} SELECT seq, rel AS old_rel, CASE WHEN {_any("evidence_text", rewrite.NEGATIONS)} THEN CASE {_NEG} ELSE rel END ELSE rel END AS rel FROM k""")
def negation_fix(s, d):
    return _known(_edges(s, d)).select("seq", F.col("rel").alias("old_rel"), rewrite.negate(F.col("rel"), F.col("evidence_text")).alias("rel"))


_PHRASE = "coalesce(" + ", ".join(rf"CASE WHEN strlen(trim(regexp_extract(evidence_text, '(?is)({p}.*?)(?:,|\.|;| – | — |$)', 1))) > 10 THEN trim(regexp_extract(evidence_text, '(?is)({p}.*?)(?:,|\.|;| – | — |$)', 1)) END" for p in rewrite.CONDITIONS) + ", '')"
_STOPGAP, _COND = _any("evidence_text", rewrite.STOPGAPS), _any("evidence_text", ("if ", "when ", "during ", "unless ", "in case"))
_ELIGIBLE = "rel IN (" + ", ".join(f"'{r}'" for r in rewrite.STOPGAP_RELATIONS) + ")"


@query(rf"""WITH {_K} SELECT seq, CASE WHEN {_STOPGAP} AND {_ELIGIBLE} AND status IN ('', 'active', 'conditional', 'unknown') THEN 'backup' WHEN {_STOPGAP} AND {_ELIGIBLE} THEN status
 WHEN ({_STOPGAP} OR {_COND}) AND status IN ('', 'active') THEN 'conditional' ELSE status END AS status,
 CASE WHEN ({_STOPGAP} OR {_COND}) AND condition = '' THEN {_PHRASE} ELSE condition END AS condition FROM k""")
def conditional_annotate(s, d):
    return rewrite.annotate_conditions(_known(_edges(s, d))).select("seq", "status", "condition")


_DATE = "coalesce(" + ", ".join(f"nullif(regexp_extract(evidence_text, '{p}', 1), '')" for p in rewrite.DATES) + ", '')"


_PLANNED = "(status = 'planned' OR rel = 'HAS_PLANNED_BRANCH')"
_GUARD = {"opened_on": f" AND NOT {_PLANNED}", "expected_opening": f" AND ({_PLANNED} OR {_any('low', ('expected', 'scheduled', 'planned', 'will open'))})"}
_CUED = ", ".join(f"CASE WHEN first_date <> '' AND {_any('low', v)}{_GUARD.get(k, '')} THEN first_date END AS {k}" for k, v in rewrite.TEMPORAL_CUES.items())


@query(rf"""WITH {_E}, t AS (SELECT seq, status, rel, {_DATE} AS first_date, lower(evidence_text) AS low FROM e)
SELECT seq, first_date, {_CUED}, CASE WHEN contains(low, 'schedule') OR contains(low, 'every ') THEN nullif(regexp_extract(low, '{rewrite.SCHEDULE}', 1), '') END AS schedule FROM t""")
def temporal_facts(s, d):
    x = _edges(s, d)
    x = x.select("seq", rewrite.first_date(F.col("evidence_text")).alias("first_date"), rewrite.temporal_facts(F.col("evidence_text"), F.col("status"), F.col("rel")).alias("m"))
    at = lambda k: F.try_element_at("m", F.lit(k)).alias(k)
    return x.select("seq", "first_date", *[at(k) for k in (*rewrite.TEMPORAL_CUES, "schedule")])


@query(f"""WITH {_K}, p AS (SELECT DISTINCT src AS name FROM k WHERE rel = 'PLANS_SITE')
SELECT seq, src, CASE WHEN rel = 'OFFERS' AND src IN (FROM p) THEN 'PLANNED_SERVICE' WHEN rel = 'HAS_BRANCH' AND dst IN (FROM p) THEN 'HAS_PLANNED_BRANCH' ELSE rel END AS rel, dst,
 CASE WHEN (src IN (FROM p) OR dst IN (FROM p)) AND status = '' THEN 'planned' ELSE status END AS status FROM k""")
def planned_rewrite(s, d):
    x = _known(_edges(s, d))
    return rewrite.by_planned_ends(x, x.where("rel = 'PLANS_SITE'").select(F.col("src").alias("name"))).select("seq", "src", "rel", "dst", "status")


_OVER = ", ".join(f"('{a}', '{b}')" for a, b in rewrite.OVERRIDES.items())


@query(f"""WITH {_K}, o(n, p) AS (VALUES {_OVER}), bad AS (SELECT DISTINCT src, p, dst FROM k JOIN o ON o.n = k.rel)
SELECT seq, src, rel, dst FROM k WHERE NOT EXISTS (SELECT 1 FROM bad WHERE bad.src = k.src AND bad.p = k.rel AND bad.dst = k.dst)""")
def negative_conflict(s, d):
    return rewrite.drop_contradicted(_known(_edges(s, d))).select("seq", "src", "rel", "dst")


@query(f"""WITH {_K}, i AS (SELECT dst AS src, CASE WHEN rel = 'PART_OF' AND status = 'planned' THEN 'HAS_PLANNED_BRANCH' WHEN rel = 'PART_OF' THEN 'HAS_BRANCH' ELSE 'PART_OF' END AS rel, src AS dst FROM k WHERE rel IN ('PART_OF', 'HAS_BRANCH', 'HAS_PLANNED_BRANCH'))
SELECT src, rel, dst FROM i WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.src = i.src AND k.rel = i.rel AND k.dst = i.dst) GROUP BY ALL""")
def structure_inverse(s, d):
    x = _known(_edges(s, d))
    return rewrite.add_inverses(x).join(x.select("src", "rel", "dst").distinct(), ["src", "rel", "dst"], "left_anti").select("src", "rel", "dst").distinct()


_HINTS = "(" + " OR ".join("contains(lower(%s), '" + h + "')" for h in DEFAULT.branch_hints) + ")"
_hint = lambda c: _HINTS.replace("%s", c)


@query(rf"""WITH n AS (SELECT canonical_name AS name, list_distinct(flatten(list(coalesce(base_types, [])))) AS bt, list_distinct(flatten(list(coalesce(domain_types, [])))) AS dt, list_distinct(flatten(list(coalesce(functional_roles, [])))) AS fr, coalesce(min(status), '') AS status
 FROM kg_entities WHERE canonical_name IS NOT NULL GROUP BY 1),
b AS (SELECT * FROM n WHERE list_contains(bt, 'organization') AND status NOT IN ('historical', 'former', 'inactive') AND (len(list_filter(dt, lambda t: {_hint("t")})) > 0 OR list_has_any(fr, ['branch', 'operated_unit']) OR {_hint("name")})),
h AS (SELECT DISTINCT src, split_part(lower(src), ' ', 1) AS w FROM kg_edges WHERE rel IN ('RUNS_SITE', 'PLANS_SITE')),
p AS (SELECT DISTINCT h.src, b.name AS dst, b.status = 'planned' OR list_contains(fr, 'planned_unit') AS planned FROM h JOIN b ON contains(lower(b.name), h.w) AND b.name <> h.src WHERE strlen(h.w) >= 4)
SELECT src, CASE WHEN planned THEN 'PLANS_SITE' ELSE 'RUNS_SITE' END AS rel, dst, CASE WHEN planned THEN 'planned' ELSE 'active' END AS status, src || ' operates ' || dst || ' as a branch.' AS evidence_text FROM p
WHERE NOT EXISTS (SELECT 1 FROM kg_edges k WHERE k.rel IN ('RUNS_SITE', 'PLANS_SITE') AND k.src = p.src AND k.dst = p.dst)""")
def branch_completion(s, d):
    flat = lambda c: F.array_distinct(F.flatten(F.collect_list(F.coalesce(c, F.array().cast("array<string>"))))).alias(c)
    n = T(s, d, "kg_entities").where("canonical_name is not null").groupBy(F.col("canonical_name").alias("name")).agg(flat("base_types"), flat("domain_types"), flat("functional_roles"), F.coalesce(F.min("status"), F.lit("")).alias("status"))
    return rewrite.complete_branches(T(s, d, "kg_edges"), n, ("RUNS_SITE", "PLANS_SITE"))


@query("""SELECT dst AS name, CASE WHEN max(CASE WHEN status = 'active' THEN 2 WHEN status = 'planned' THEN 1 ELSE 0 END) = 2 THEN 'active' ELSE 'planned' END AS status
FROM kg_edges WHERE rel = 'STANDS_AT_ADDRESS' GROUP BY dst HAVING max(CASE WHEN status = 'active' THEN 2 WHEN status = 'planned' THEN 1 ELSE 0 END) > 0""")
def address_status(s, d):
    e = T(s, d, "kg_edges")
    return rewrite.spread_status(e, e.select(F.col("dst").alias("name")), "STANDS_AT_ADDRESS")


# Resolution


def _cands(s, d):
    x = T(s, d, "candidate_entities").dropDuplicates(["seq"])
    return x.withColumnRenamed("canonical_candidate", "canonical")


_TRIM = r"regexp_replace(lower(coalesce(%s, '')), '^[\s\x{a0}]+|[\s\x{a0}]+$', '', 'g')"
_HASMOD = " AND ".join(f"(contains(' ' || alias || ' ', ' {m} ') = contains(' ' || canonical || ' ', ' {m} '))" for m in resolve.CHANGING)
_CE = f"""c AS (SELECT DISTINCT ON (seq) *, coalesce(nullif({_TRIM % "canonical_candidate"}, ''), {_TRIM % "mention"}) AS canon FROM candidate_entities ORDER BY seq),
a0 AS (SELECT seq, 0 AS i, {_TRIM % "mention"} AS alias, canon AS canonical FROM c UNION ALL SELECT seq, i, {_TRIM % "t"}, canon FROM (SELECT seq, canon, unnest(range(1, len(aliases) + 1)) AS i, unnest(list_transform(aliases, lambda x: x.text)) AS t FROM c)),
am AS (SELECT alias, arg_max(canonical, (seq, i, canonical)) AS canonical FROM a0 WHERE alias <> '' AND canonical <> '' AND alias <> canonical AND {_HASMOD} GROUP BY alias)"""


@query(f"WITH {_CE} SELECT alias, canonical FROM am")
def alias_map_last_wins(s, d):
    return resolve.alias_map(_cands(s, d))


_LIST = lambda c, v, cond: f"(SELECT name, list(v ORDER BY s, i) AS x FROM (SELECT name, v, min((seq, i))[1] AS s, min((seq, i))[2] AS i FROM (SELECT name, seq, generate_subscripts({c}, 1) AS i, unnest({c}) AS u FROM n) t, LATERAL (SELECT {v} AS v) WHERE {cond} GROUP BY name, v) GROUP BY name)"


@query(f"""WITH {_CE}, n AS (SELECT c.*, coalesce(am.canonical, c.canon) AS name FROM c LEFT JOIN am ON am.alias = c.canon WHERE c.canon <> '')
SELECT n.name, count(*) AS n, sum(coalesce(len(evidence), 0)) AS n_evidence, coalesce(min_by(n.status, n.seq) FILTER (n.status IS NOT NULL AND n.status NOT IN ('', 'unknown')), '') AS status,
 array_to_string(coalesce(any_value(b.x), ['concept']), '|') AS base_types, array_to_string(coalesce(any_value(dd.x), []), '|') AS domain_types, array_to_string(coalesce(any_value(r.x), []), '|') AS roles,
 len(list_distinct(flatten(list(coalesce(n.aliases, []))))) AS n_aliases
FROM n LEFT JOIN {_LIST("base_types", "u.type", "u.score >= 0.5")} b USING (name) LEFT JOIN {_LIST("domain_types", "u.type", "u.score >= 0.5")} dd USING (name) LEFT JOIN {_LIST("functional_roles", "u", "true")} r USING (name) GROUP BY n.name""")
def canonical_entities(s, d):
    c = _cands(s, d)
    x = resolve.canonical_entities(c, resolve.alias_map(c))
    return x.select("name", "n", "n_evidence", "status", F.array_join("base_types", "|").alias("base_types"), F.array_join("domain_types", "|").alias("domain_types"), F.array_join("functional_roles", "|").alias("roles"), F.size("aliases").cast("long").alias("n_aliases"))


@query(f"""WITH {_CE}, {_E} SELECT seq, coalesce(x.canonical, e.src) AS src, coalesce(y.canonical, e.dst) AS dst FROM e LEFT JOIN am x ON x.alias = e.src LEFT JOIN am y ON y.alias = e.dst""")
def rewrite_to_canonical(s, d):
    return rewrite.to_canonical(_edges(s, d), resolve.alias_map(_cands(s, d))).select("seq", "src", "dst")


@query(f"""WITH {_E}, n AS (SELECT {_TRIM % "mention"} AS n FROM candidate_entities UNION SELECT {_TRIM % "canonical_candidate"} FROM candidate_entities)
SELECT seq FROM e WHERE src <> '' AND dst <> '' AND src IN (FROM n) AND dst IN (FROM n)""")
def orphan_edges(s, d):
    return resolve.drop_orphans(_edges(s, d), _cands(s, d)).select("seq")


_MODS = " UNION ALL ".join(f"SELECT name, substr(name, {len(m) + 1}) || sfx AS t, {2 * i + 1} + k AS p FROM n, (VALUES ('', 0), ('s', 1)) v(sfx, k) WHERE starts_with(name, '{m}')" for i, m in enumerate(resolve.MODIFIERS))


@query(f"""WITH RECURSIVE n AS (SELECT DISTINCT lower(p_name) AS name FROM part UNION SELECT lower(p_name) || 's' FROM part WHERE p_size > 25 UNION SELECT 'basic ' || lower(p_name) FROM part WHERE p_size < 10),
f AS (SELECT name, name || 's' AS t, 0 AS p FROM n UNION ALL {_MODS}), g AS (SELECT f.name AS alias, arg_min(f.t, f.p) AS t FROM f JOIN n ON n.name = f.t GROUP BY f.name),
r(alias, t) AS (SELECT alias, t FROM g UNION SELECT r.alias, g.t FROM r JOIN g ON g.alias = r.t)
SELECT alias, t AS canonical FROM r WHERE t NOT IN (SELECT alias FROM g)""")
def service_collapse(s, d):
    p, n = T(s, d, "part"), F.lower("p_name")
    names = p.select(n.alias("name")).union(p.where("p_size > 25").select(F.concat(n, F.lit("s")))).union(p.where("p_size < 10").select(F.concat(F.lit("basic "), n)))
    return resolve.collapse_services(names)


@query(r"""WITH x AS (SELECT DISTINCT mention AS name, regexp_replace(lower(mention), '^[\s\x{a0}]+|[\s\x{a0}]+$', '', 'g') AS k FROM candidate_entities WHERE mention IS NOT NULL), f AS (SELECT k, min(name) AS survivor FROM x WHERE k <> '' GROUP BY k HAVING count(*) > 1)
SELECT x.name, f.survivor FROM x JOIN f USING (k)""")
def finalize_exact_dedup(s, d):
    return resolve.exact_duplicates(T(s, d, "candidate_entities"), "mention")


_SIMSQL = """round(list_cosine_similarity(CAST({a} AS DOUBLE[]), CAST({b} AS DOUBLE[])), 5)"""


_USABLE = "embedding IS NOT NULL AND len(embedding) = 64 AND len(list_filter(embedding, lambda v: v IS NULL OR isnan(v))) = 0 AND len(list_filter(embedding, lambda v: v <> 0)) > 0"


@query(f"""WITH v AS (SELECT rec_id, embedding, base_types FROM kg_entities WHERE {_USABLE})
SELECT a.rec_id AS a, b.rec_id AS b, {_SIMSQL.format(a="a.embedding", b="b.embedding")} AS sim FROM v a JOIN v b ON a.rec_id < b.rec_id WHERE list_has_any(a.base_types, b.base_types) AND list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) >= 0.8""")
def vector_pairs_threshold(s, d):
    x = T(s, d, "kg_entities").where(F.size("embedding") == 64).select("rec_id", "embedding", "base_types")
    return simjoin.similar(x, 0.8, "rec_id", "embedding", "base_types").withColumn("sim", F.round("sim", 5))


@query("""WITH RECURSIVE e AS (SELECT a AS x, b AS y FROM merge_pairs WHERE a IS NOT NULL AND b IS NOT NULL UNION SELECT b, a FROM merge_pairs WHERE a IS NOT NULL AND b IS NOT NULL),
r(x, g) AS (SELECT x, x FROM e UNION SELECT e.x, r.g FROM r JOIN e ON e.y = r.x) SELECT x AS node, min(g) AS component FROM r GROUP BY x""")
def connected_components(s, d):
    return closure.components(T(s, d, "merge_pairs"))


@query(f"""WITH RECURSIVE {_CE}, m AS (SELECT * FROM am), r(alias, t, k) AS (SELECT alias, canonical, 1 FROM m UNION ALL SELECT r.alias, m.canonical, k + 1 FROM r JOIN m ON m.alias = r.t WHERE k < 60),
z AS (SELECT alias, bool_or(k >= 60) AS loop, min(least(alias, t)) AS low, arg_max(t, k) AS t FROM r GROUP BY alias) SELECT alias, CASE WHEN loop THEN '' ELSE t END AS terminal FROM z""")
def alias_chain_terminal(s, d):
    m = resolve.alias_map(_cands(s, d))
    x = closure.chain_ends(m)
    # where a chain runs in a cycle its end is not a matter of the table, so the twin has ''
    return x.join(m.select(F.col("alias").alias("terminal"), F.lit(True).alias("c")), "terminal", "left").select("alias", F.when(F.col("c"), "").otherwise(F.col("terminal")).alias("terminal"))


# Graph


def _graph(s, d):
    return T(s, d, "kg_edges").select("src", "rel", "dst", "weight", "status")


def _start(s, d):
    return T(s, d, "kg_edges").where("rel = 'RUNS_SITE'").select(F.col("src").alias("name")).distinct()


_G = "g AS (SELECT DISTINCT src, rel, dst FROM kg_edges), st AS (SELECT DISTINCT src AS name FROM kg_edges WHERE rel = 'RUNS_SITE')"


@query("SELECT (SELECT count(*) FROM kg_entities) AS n_nodes, (SELECT count(*) FROM kg_edges) AS n_edges")
def graph_stats(s, d):
    return graph.stats(T(s, d, "kg_entities"), T(s, d, "kg_edges"))


@query(f"WITH {_G} SELECT e.src, e.rel, e.dst, round(e.weight, 6) AS weight FROM kg_edges e WHERE e.src IN (FROM st)")
def one_hop(s, d):
    return graph.one_hop(_graph(s, d), _start(s, d)).select("src", "rel", "dst", F.round("weight", 6).alias("weight"))


@query(f"WITH {_G} SELECT x.src AS a, x.rel AS r1, x.dst AS b, y.rel AS r2, y.dst AS c FROM g x JOIN g y ON x.dst = y.src WHERE x.src IN (FROM st) AND x.src <> y.dst")
def two_hop(s, d):
    return graph.two_hop(_graph(s, d), _start(s, d))


@query("SELECT node, count(*) AS n FROM (SELECT src AS node FROM kg_edges UNION ALL SELECT dst FROM kg_edges WHERE src <> dst) GROUP BY node")
def undirected_neighbors(s, d):
    return graph.undirected(_graph(s, d)).groupBy("node").agg(F.count("*").alias("n"))


@query(f"""WITH {_G}, h AS (SELECT *, row_number() OVER (ORDER BY src, rel, dst) AS id FROM g),
p1 AS (SELECT src AS start, dst AS node, id FROM h WHERE src IN (FROM st)), p2 AS (SELECT p1.start, h.dst AS node FROM p1 JOIN h ON h.src = p1.node AND h.id <> p1.id)
SELECT start, node, depth, count(*) AS n_paths FROM (SELECT start, node, 1 AS depth FROM p1 UNION ALL SELECT start, node, 2 FROM p2) GROUP BY ALL""")
def var_len_1_2(s, d):
    return graph.paths(_graph(s, d), _start(s, d), 2).groupBy("start", "node", "depth").agg(F.count("*").alias("n_paths"))


@query("""WITH RECURSIVE u AS (SELECT src AS a, dst AS b FROM kg_edges UNION SELECT dst, src FROM kg_edges), st AS (SELECT DISTINCT src AS name FROM kg_edges WHERE rel = 'PUBLISHES_PORTAL'),
r(start, node, depth) AS (SELECT name, name, 0 FROM st UNION SELECT r.start, u.b, r.depth + 1 FROM r JOIN u ON u.a = r.node WHERE r.depth < 3) SELECT start, node, min(depth) AS depth FROM r GROUP BY ALL HAVING min(depth) > 0""")
def reachable_3(s, d):
    e = _graph(s, d)
    return graph.reachable(e, e.where("rel = 'PUBLISHES_PORTAL'").select(F.col("src").alias("name")), 3)


@query(f"""WITH {_G}, u AS (SELECT src AS node, dst AS other FROM g UNION SELECT dst, src FROM g), h AS (SELECT other AS hub FROM u WHERE node IN (FROM st) GROUP BY other HAVING count(DISTINCT node) >= 2)
SELECT u.other AS name, count(DISTINCT u.node) AS n_hubs FROM u JOIN h ON h.hub = u.node WHERE u.other NOT IN (FROM st) GROUP BY u.other ORDER BY name LIMIT 20""")
def siblings(s, d):
    return graph.siblings(_graph(s, d), _start(s, d))


@query("""WITH f AS (SELECT src AS name FROM kg_edges GROUP BY src ORDER BY count(*) DESC, src LIMIT 8), e AS (SELECT src, rel, dst, coalesce(weight, 1.0) AS weight, src IN (FROM f) AS s, dst IN (FROM f) AS d FROM kg_edges),
t AS (SELECT *, CASE WHEN NOT s THEN src WHEN NOT d THEN dst END AS far FROM e WHERE s OR d), n AS (SELECT far, row_number() OVER (ORDER BY min((-weight, src, rel, dst))) AS r FROM t WHERE far IS NOT NULL GROUP BY far)
SELECT src, rel, dst, round(weight, 6) AS weight FROM t WHERE far IS NULL OR far IN (SELECT far FROM n WHERE r <= 60 - (SELECT count(*) FROM f))""")
def focused_subgraph(s, d):
    e = _graph(s, d)
    f = e.groupBy(F.col("src").alias("name")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "name").limit(8)
    return graph.focused_subgraph(e, f).withColumn("weight", F.round("weight", 6))


@query("SELECT dst, count(DISTINCT src) AS n_sources FROM kg_edges GROUP BY dst HAVING count(DISTINCT src) >= 2")
def hub_collect_having(s, d):
    return graph.hubs(_graph(s, d))


@query("""WITH m AS (SELECT DISTINCT l_orderkey AS c, l_suppkey AS n FROM lineitem), k AS (SELECT c FROM m GROUP BY c HAVING count(*) BETWEEN 2 AND 20)
SELECT x.n AS a, y.n AS b, count(*) AS n FROM m x JOIN m y ON x.c = y.c AND x.n < y.n WHERE x.c IN (FROM k) GROUP BY ALL HAVING count(*) >= 2""")
def cooccurrence_pairs(s, d):
    return graph.cooccurrence(T(s, d, "lineitem"), "l_orderkey", "l_suppkey", least=2)


_FOLD = lambda c: f"""{c}_t AS (SELECT src, rel, dst, {c} AS t, row_number() OVER (PARTITION BY src, rel, dst ORDER BY min(seq)) AS i FROM e WHERE {c} <> '' GROUP BY src, rel, dst, {c}),
{c}_r AS (SELECT src, rel, dst, i, t AS a FROM {c}_t WHERE i = 1 UNION ALL SELECT r.src, r.rel, r.dst, t.i, CASE WHEN contains(r.a, t.t) THEN r.a ELSE r.a || E'\\n---\\n' || t.t END FROM {c}_r r JOIN {c}_t t ON t.src = r.src AND t.rel = r.rel AND t.dst = r.dst AND t.i = r.i + 1),
{c}_j AS (SELECT src, rel, dst, arg_max(a, i) AS a FROM {c}_r GROUP BY src, rel, dst)"""  # noqa: E731


@query(f"""WITH RECURSIVE {_E}, b AS (SELECT src, rel, dst, round(sum(coalesce(confidence, 0)), 5) AS weight, count(*) AS n, coalesce(min_by(status, seq) FILTER (status <> ''), '') AS status, list_sort(list(DISTINCT chunk_id) FILTER (chunk_id <> '')) AS ids FROM e GROUP BY ALL),
{_FOLD("evidence_text")}, {_FOLD("condition")}
SELECT src, rel, dst, weight, n, status, md5(coalesce(x.a, '')) AS evidence, coalesce(y.a, '') AS condition, coalesce(array_to_string(ids, '|'), '') AS chunk_ids FROM b LEFT JOIN evidence_text_j x USING (src, rel, dst) LEFT JOIN condition_j y USING (src, rel, dst)""")
def edge_merge(s, d):
    x = store.merge_edges(_edges(s, d).withColumn("weight", F.col("confidence")))
    return x.select("src", "rel", "dst", F.round("weight", 5).alias("weight"), "n", "status", F.md5("evidence_text").alias("evidence"), "condition", joined("chunk_ids").alias("chunk_ids"))


@query("SELECT s_suppkey, count(DISTINCT l_partkey) AS n_parts FROM supplier JOIN lineitem ON l_suppkey = s_suppkey GROUP BY s_suppkey ORDER BY n_parts DESC, s_suppkey LIMIT 10")
def top_offerers(s, d):
    x = T(s, d, "supplier").join(T(s, d, "lineitem"), F.col("l_suppkey") == F.col("s_suppkey"))
    return x.groupBy("s_suppkey").agg(F.countDistinct("l_partkey").alias("n_parts")).orderBy(F.desc("n_parts"), "s_suppkey").limit(10)


@query()
def approx_distinct_parts(s, d):
    return T(s, d, "lineitem").groupBy("l_suppkey").agg(F.approx_count_distinct("l_partkey", 0.02).alias("n_parts"))


@query("""WITH c AS (SELECT l_suppkey, l_partkey, count(*) AS n FROM lineitem GROUP BY ALL) SELECT l_suppkey, l_partkey, n, r FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY n DESC, l_partkey) AS r FROM c) WHERE r <= 3""")
def topk_per_key(s, d):
    c = T(s, d, "lineitem").groupBy("l_suppkey", "l_partkey").agg(F.count("*").alias("n"))
    return c.withColumn("r", F.row_number().over(Window.partitionBy("l_suppkey").orderBy(F.desc("n"), "l_partkey"))).where("r <= 3")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM chunks)")
def optional_match_anti(s, d):
    return T(s, d, "documents").join(T(s, d, "chunks"), "doc_id", "left_anti").select("doc_id")


# Vectors and retrieval


def _query_vector(s, d):
    return T(s, d, "embeddings").orderBy("vec_id").first()["embedding"]


_QV = "q AS (SELECT embedding AS qe FROM embeddings ORDER BY vec_id LIMIT 1)"


@query(f"WITH {_QV} SELECT vec_id, {_SIMSQL.format(a='embedding', b='qe')} AS score FROM embeddings, q ORDER BY list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(qe AS DOUBLE[])) DESC, vec_id LIMIT 10")
def vector_topk(s, d):
    return vector.top_k(T(s, d, "embeddings"), "embedding", _query_vector(s, d), 10, "vec_id").select("vec_id", F.round("score", 5).alias("score"))


@query(f"""WITH {_QV}, x AS (SELECT vec_id, label, list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(qe AS DOUBLE[])) AS sc FROM embeddings, q)
SELECT label, vec_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY sc DESC, vec_id) AS rank FROM x) WHERE rank <= 5""")
def vector_topk_per_label(s, d):
    return vector.top_k_by(T(s, d, "embeddings"), "embedding", _query_vector(s, d), 5, "vec_id", "label").select("label", "vec_id", "rank")


@query(f"""WITH {_QV}, x AS (SELECT e.vec_id, CASE WHEN e.label = 3 THEN -1.0 ELSE list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(qe AS DOUBLE[])) END AS sc FROM embeddings e, q)
SELECT vec_id, round(sc, 5) AS score FROM x ORDER BY sc DESC, vec_id LIMIT 15""")
def rerank_cosine(s, d):
    x = T(s, d, "embeddings").withColumn("embedding", F.when(F.col("label") != 3, F.col("embedding")))
    return retrieval.rerank(x, _query_vector(s, d), key="vec_id").select("vec_id", F.round("score", 5).alias("score"))


@query(f"""WITH {_QV}, x AS (SELECT CAST(vec_id AS VARCHAR) AS text, list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(qe AS DOUBLE[])) AS sc FROM embeddings, q ORDER BY sc DESC, text LIMIT 12)
SELECT text, rank FROM (SELECT *, row_number() OVER (ORDER BY sc DESC, text) AS rank FROM x) WHERE rank <= 3 OR sc >= 0.25""")
def facts_min_keep(s, d):
    q = F.array(*[F.lit(float(v)) for v in _query_vector(s, d)])
    x = T(s, d, "embeddings").select(F.col("vec_id").cast("string").alias("text"), vector.cosine(F.col("embedding"), q).alias("score"))
    return retrieval.relevant_facts(x).select("text", "rank")


@query(rf"""WITH t AS (SELECT doc_id, unnest(list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda w: length(w) >= 3 AND w NOT IN ({_QSTOPS}))) AS token FROM documents)
SELECT token, count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM t GROUP BY token""")
def fulltext_tokens(s, d):
    x = retrieval.token_table(T(s, d, "documents"), "doc_id", "text")
    return x.groupBy("token").agg(F.sum("tf").alias("n"), F.count("*").alias("n_docs"))


@query(rf"""WITH t AS (SELECT doc_id, unnest(list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda w: length(w) >= 3 AND w NOT IN ({_QSTOPS}))) AS token FROM documents)
SELECT doc_id, count(DISTINCT token) AS score FROM t WHERE token IN ('laboratory', 'samples', 'courier', 'invoices') GROUP BY doc_id ORDER BY score DESC, count(*) DESC, doc_id LIMIT 20""")
def fulltext_search(s, d):
    words = s.createDataFrame([("laboratory",), ("samples",), ("courier",), ("invoices",)], "token string")
    return retrieval.full_text(retrieval.token_table(T(s, d, "documents"), "doc_id", "text"), words, "doc_id", 20).select("doc_id", "score")


@query("""WITH n AS (SELECT DISTINCT canonical_name AS name FROM kg_entities WHERE canonical_name IS NOT NULL), w(word) AS (VALUES ('clinic'), ('valley'), ('saint'))
SELECT word, name FROM (SELECT word, name, row_number() OVER (PARTITION BY word ORDER BY strlen(name), name) AS r FROM n, w WHERE contains(lower(name), word) AND lower(name) <> word) WHERE r <= 5""")
def contains_shortest_first(s, d):
    n = T(s, d, "kg_entities").where("canonical_name is not null").select(F.col("canonical_name").alias("name"))
    return retrieval.containing_names(n, ["clinic", "valley", "saint"])


@query("""WITH a AS (SELECT canonical_name AS name, row_number() OVER (ORDER BY min(rec_id)) AS pos FROM kg_entities WHERE contains(canonical_name, 'clinic') GROUP BY 1),
b AS (SELECT canonical_name AS name, row_number() OVER (ORDER BY min(rec_id)) AS pos FROM kg_entities WHERE contains(canonical_name, 'saint') GROUP BY 1)
SELECT coalesce(a.name, b.name) AS name, CASE WHEN a.name IS NULL THEN 'saint' ELSE 'clinic' END AS source, coalesce(a.pos, b.pos) AS pos FROM a FULL JOIN b USING (name)""")
def pool_first_wins(s, d):
    k = T(s, d, "kg_entities")

    def path(w):
        x = k.where(F.contains("canonical_name", F.lit(w))).groupBy(F.col("canonical_name").alias("name")).agg(F.min("rec_id").alias("f"))
        return x.select("name", F.row_number().over(Window.orderBy("f")).alias("pos"))

    return retrieval.pool([("clinic", path("clinic")), ("saint", path("saint"))], "name").select("name", "source", "pos")


def _mentions(s, d):
    return T(s, d, "kg_edges").select(F.col("src").alias("name"), F.explode("chunk_ids").alias("chunk_id")).distinct()


@query("""WITH m AS (SELECT DISTINCT src AS name, unnest(chunk_ids) AS chunk_id FROM kg_edges), dead AS (SELECT chunk_id FROM chunks WHERE doc_id IN (SELECT doc_id FROM documents WHERE source = 'old-intranet')),
kept AS (SELECT * FROM m WHERE chunk_id NOT IN (FROM dead)), lost AS (SELECT DISTINCT name FROM m WHERE chunk_id IN (FROM dead) AND name NOT IN (SELECT name FROM kept))
SELECT src, rel, dst FROM kg_edges WHERE src NOT IN (FROM lost) AND dst NOT IN (FROM lost)""")
def delete_document_exclusive(s, d):
    gone = T(s, d, "documents").where("source = 'old-intranet'").select("doc_id")
    edges = T(s, d, "kg_edges").select("src", "rel", "dst")
    ents = edges.select(F.col("src").alias("name")).union(edges.select("dst")).distinct()
    out = store.delete_document(gone, {"documents": T(s, d, "documents"), "chunks": T(s, d, "chunks").select("chunk_id", "doc_id"), "mentions": _mentions(s, d), "entities": ents, "edges": edges})
    return out["edges"]


# Solver

_C1, _C2 = ("(" + ", ".join(f"'{r}'" for r in g) + ")" for g in solver.COMPETING)


@query(f"""WITH {_K}, m(raw, relation, known, flip) AS (VALUES {_RES}), p AS (SELECT seq, src, dst, alternative_group, least(lower(src), lower(dst)) AS a, greatest(lower(src), lower(dst)) AS b, coalesce(m.relation, upper(k.rel)) AS r FROM k LEFT JOIN m ON m.raw = upper(k.rel)),
g AS (SELECT a, b FROM p GROUP BY a, b HAVING count(DISTINCT r) FILTER (r IN {_C1}) > 1 OR count(DISTINCT r) FILTER (r IN {_C2}) > 1)
SELECT p.seq, CASE WHEN alternative_group <> '' THEN alternative_group WHEN g.a IS NOT NULL THEN 'alt_' || p.a || '_' || p.b ELSE '' END AS alternative_group FROM p LEFT JOIN g ON p.a = g.a AND p.b = g.b""")
def alternative_groups(s, d):
    return solver.alternative_groups(_known(_edges(s, d))).select("seq", "alternative_group")


_SC = "CASE WHEN 0.4 * coalesce(evidence_score, 0) + 0.3 * coalesce(schema_fit_score, 0) + 0.3 * coalesce(confidence, 0) = 0 THEN coalesce(confidence, 0) ELSE 0.4 * coalesce(evidence_score, 0) + 0.3 * coalesce(schema_fit_score, 0) + 0.3 * coalesce(confidence, 0) END"


@query(f"""WITH {_E}, x AS (SELECT seq, alternative_group AS ag, {_SC} AS score FROM e) SELECT seq, round(score, 6) AS score FROM (SELECT *, CASE WHEN ag = '' THEN 1 ELSE row_number() OVER (PARTITION BY ag ORDER BY score DESC, seq) END AS r FROM x WHERE score >= 0.3) WHERE r = 1""")
def select_final(s, d):
    return solver.select(_edges(s, d)).select("seq", F.round("score", 6).alias("score"))


@query(f"""WITH RECURSIVE {_E}, x AS (SELECT seq, lower(src) AS s, rel, lower(dst) AS d, coalesce(confidence, 0) AS c, {_SC} AS f, row_number() OVER (PARTITION BY lower(src), rel, lower(dst) ORDER BY seq) AS i FROM e),
r AS (SELECT s, rel, d, i, seq AS w, CAST(f AS DOUBLE) AS k, CAST(c AS DOUBLE) AS c FROM x WHERE i = 1 UNION ALL
 SELECT r.s, r.rel, r.d, x.i, CASE WHEN x.f > r.k THEN x.seq ELSE r.w END, (CASE WHEN x.f > r.k THEN x.f ELSE r.k END) + 0.03 * x.c, (CASE WHEN x.f > r.k THEN x.c ELSE r.c END) + 0.1 * x.c FROM r JOIN x ON x.s = r.s AND x.rel = r.rel AND x.d = r.d AND x.i = r.i + 1)
SELECT w AS seq, round(c, 6) AS confidence, round(k, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY s, rel, d ORDER BY i DESC) AS z FROM r) WHERE z = 1""")
def dedup_fold(s, d):
    x = _edges(s, d)
    x = x.withColumn("score", solver.final_score(F.col("evidence_score"), F.col("schema_fit_score"), F.col("confidence")))
    return solver.fold_duplicates(x).select("seq", F.round("confidence", 6).alias("confidence"), F.round("score", 6).alias("score"))


_SIG = ", ".join(f"('{r}', {list(a)!r}::VARCHAR[], {list(b)!r}::VARCHAR[])" for r, (_, a, b) in DEFAULT.relations.items())
_GEN = "(" + ", ".join(f"'{g}'" for g in solver.GENERIC) + ")"


def _rule_sql(r):
    own = f"starts_with(k.rel, '{r.relation[:-1]}')" if r.relation.endswith("*") else f"k.rel = '{r.relation}'"
    bad = " OR ".join(x for x in (f"NOT {_any('evidence_text', r.needs)}" if r.needs else "", _any("evidence_text", r.bans) if r.bans else "") if x)
    return f"({own} AND ({bad}){' AND trim(evidence_text) <> %s' % repr('') if r.blank else ''})"


_WEIGHT = "CASE WHEN len(string_split_regex(trim({0}), '\\s+')) >= 2 THEN 2 ELSE 0 END + CASE WHEN regexp_matches({0}, 'network|laboratory|medical|clinic|diagnostics') THEN 2 ELSE 0 END + CASE WHEN strlen({0}) > 12 THEN 1 ELSE 0 END"


@query(f"""WITH {_CE}, {_E}, k AS (SELECT * REPLACE (CASE WHEN rel = 'CLOSE_TO' THEN 'ALIAS_OF' ELSE {_OWNSQL} END AS rel) FROM e), sig(rel, st, dt) AS (VALUES {_SIG}), t AS (SELECT id AS _i, canonical_name AS name, base_types FROM kg_entities WHERE canonical_name IS NOT NULL),
n AS (SELECT name, list_sort(list_distinct(flatten(list(coalesce(base_types, []))))) AS ty FROM t GROUP BY name)
SELECT k.seq, CASE WHEN regexp_matches(lower(trim(k.src)), '{tx.RAW_TEMPORAL}') OR regexp_matches(lower(trim(k.dst)), '{tx.RAW_TEMPORAL}') THEN 'raw_value' WHEN k.rel <> 'ALIAS_OF' AND (k.src IN (SELECT alias FROM am) OR k.dst IN (SELECT alias FROM am)) THEN 'alias_end'
 WHEN k.rel = 'ALIAS_OF' AND a.ty IS NOT NULL AND b.ty IS NOT NULL AND (NOT list_has_any(a.ty, b.ty) OR k.dst IN {_GEN}) THEN 'alias_types'
 WHEN k.rel = 'ALIAS_OF' AND (k.src IN {_GEN} OR {_WEIGHT.format('k.src')} > {_WEIGHT.format('k.dst')}) THEN 'alias_direction'
 WHEN {" OR ".join(_rule_sql(r) for r in solver.EVIDENCE)} THEN 'evidence' WHEN sig.rel IS NULL THEN 'unknown_relation'
 WHEN (a.ty IS NOT NULL AND len(st) > 0 AND NOT list_has_any(a.ty, st)) OR (b.ty IS NOT NULL AND len(dt) > 0 AND NOT list_has_any(b.ty, dt)) THEN 'signature' ELSE 'keep' END AS verdict
FROM k LEFT JOIN sig ON sig.rel = k.rel LEFT JOIN n a ON a.name = k.src LEFT JOIN n b ON b.name = k.dst""")
def constraint_verdicts(s, d):
    ents = T(s, d, "kg_entities").where("canonical_name is not null").select(F.col("canonical_name").alias("name"), F.explode_outer("base_types").alias("t"))
    ents = ents.groupBy("name").agg(F.collect_set("t").alias("base_types"))
    e = _known(_edges(s, d)).withColumn("rel", F.when(F.col("rel") == "CLOSE_TO", "ALIAS_OF").otherwise(F.col("rel")))
    return solver.verdicts(e, ents, resolve.alias_map(_cands(s, d))).select("seq", "verdict")


@query(f"""WITH {_CE}, {_K}, n AS (SELECT DISTINCT src AS name FROM kg_edges UNION SELECT dst FROM kg_edges)
SELECT seq FROM k WHERE src <> dst AND src IN (FROM n) AND dst IN (FROM n) AND (rel = 'ALIAS_OF' OR (src NOT IN (SELECT alias FROM am) AND dst NOT IN (SELECT alias FROM am)))""")
def post_validate(s, d):
    e = T(s, d, "kg_edges")
    names = e.select(F.col("src").alias("name")).union(e.select("dst")).distinct().withColumn("base_types", F.array().cast("array<string>"))
    return solver.post_validate(_known(_edges(s, d)), names, resolve.alias_map(_cands(s, d)))[0].select("seq")


# Governance

_WS = r"list_sort(list_distinct(string_split_regex(lower(%s), '[_ ]+')))"


@query(rf"""WITH p AS (SELECT DISTINCT regexp_replace(trim(relation_candidate), '[-]', '_', 'g') AS name FROM candidate_edges WHERE trim(coalesce(relation_candidate, '')) <> ''), a AS (SELECT unnest(aliases) AS alias, relation_id AS canonical FROM relations),
x AS (SELECT p.name, 1 AS pr, 'exact' AS decision, r.relation_id AS match, 1.0 AS confidence FROM p JOIN relations r ON lower(r.relation_id) = lower(p.name)
 UNION ALL SELECT p.name, 2, 'alias', a.canonical, 1.0 FROM p JOIN a ON lower(a.alias) = lower(p.name)
 UNION ALL SELECT p.name, 3, 'word_order', r.relation_id, 0.85 FROM p JOIN relations r ON {_WS % "p.name"} = {_WS % "r.relation_id"}
 UNION ALL SELECT p.name, 4, 'similar', r.relation_id, len(list_intersect({_WS % "p.name"}, {_WS % "r.relation_id"})) / len(list_distinct(list_concat({_WS % "p.name"}, {_WS % "r.relation_id"}))) FROM p JOIN relations r ON len(list_intersect({_WS % "p.name"}, {_WS % "r.relation_id"})) / len(list_distinct(list_concat({_WS % "p.name"}, {_WS % "r.relation_id"}))) >= 0.7
 UNION ALL SELECT name, 5, 'vague', NULL, 0.8 FROM p WHERE lower(name) IN ('thing','entity','item','object','stuff','other','misc') UNION ALL SELECT name, 6, 'new', NULL, 0.5 FROM p)
SELECT name, decision, match, round(confidence, 6) AS confidence FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY pr, confidence DESC, match) AS r FROM x) WHERE r = 1""")
def check_proposed(s, d):
    v = F.regexp_replace(F.btrim("relation_candidate"), "[-]", "_")
    p = T(s, d, "candidate_edges").where("trim(coalesce(relation_candidate, '')) != ''").select(v.alias("name"))
    r = T(s, d, "relations")
    out = governance.check_types(p, r.select(F.col("relation_id").alias("name")), r.select(F.explode("aliases").alias("alias"), F.col("relation_id").alias("canonical")))
    return out.withColumn("confidence", F.round("confidence", 6))


@query("""WITH k AS (SELECT src, dst, rel, weight FROM kg_edges WHERE rel IN ('ALLIED_TO', 'CLOSE_TO', 'EXCHANGES_DATA'))
SELECT src, rel, dst, round(weight, 5) AS weight FROM kg_edges WHERE rel NOT IN ('ALLIED_TO', 'CLOSE_TO', 'EXCHANGES_DATA') UNION ALL SELECT least(src, dst), rel, greatest(src, dst), round(sum(weight), 5) FROM k GROUP BY ALL""")
def symmetric_once(s, d):
    return governance.symmetric_once(_graph(s, d), ["ALLIED_TO", "CLOSE_TO", "EXCHANGES_DATA"]).withColumn("weight", F.round("weight", 5))


@query("""WITH x AS (SELECT rel, count(*) AS n FROM kg_edges GROUP BY rel), e AS (SELECT rel, src, row_number() OVER (PARTITION BY rel ORDER BY src) AS r FROM (SELECT DISTINCT rel, src FROM kg_edges))
SELECT x.rel, x.n, string_agg(e.src, ' | ' ORDER BY e.src) AS examples FROM x JOIN e ON e.rel = x.rel AND e.r <= 3 GROUP BY x.rel, x.n""")
def relation_candidates(s, d):
    return governance.candidates(_graph(s, d), "rel", "src")


# Graph statements

_ENT = "SELECT name, min(ty) AS type FROM (SELECT canonical_name AS name, coalesce(base_types[1], 'concept') AS ty FROM kg_entities WHERE canonical_name IS NOT NULL) GROUP BY name"


def _cypher(s, d, text, **params):
    ents = T(s, d, "kg_entities").where("canonical_name is not null").select(F.col("canonical_name").alias("name"), F.coalesce(F.try_element_at("base_types", F.lit(1)), F.lit("concept")).alias("type"))
    return cypher.query(ents.groupBy("name").agg(F.min("type").alias("type")), _graph(s, d), text, params)


@query(f"""WITH n AS ({_ENT}), g AS (SELECT src, rel, dst FROM kg_edges) SELECT a.name AS source, count(DISTINCT b.name) AS n FROM n a JOIN g ON g.src = a.name JOIN n b ON b.name = g.dst WHERE a.type = 'organization' AND g.rel IN ('RUNS_SITE', 'PLANS_SITE') GROUP BY a.name ORDER BY n DESC, source LIMIT 25""")
def cypher_top_sources(s, d):
    return _cypher(s, d, "MATCH (a:organization)-[r:RUNS_SITE|PLANS_SITE]->(b) RETURN a.name AS source, count(DISTINCT b.name) AS n ORDER BY n DESC, source LIMIT 25")


@query(f"""WITH n AS ({_ENT}), g AS (SELECT DISTINCT src, rel, dst FROM kg_edges) SELECT DISTINCT a.name AS a, c.name AS c FROM n a JOIN g x ON x.src = a.name JOIN n b ON b.name = x.dst JOIN g y ON y.src = b.name JOIN n c ON c.name = y.dst
WHERE contains(lower(a.name), 'clinic') AND a.name <> c.name AND NOT (x.src = y.src AND x.rel = y.rel AND x.dst = y.dst)""")
def cypher_two_hops(s, d):
    return _cypher(s, d, "MATCH (a)-[x]->(b)-[y]->(c) WHERE toLower(a.name) CONTAINS $word AND a.name <> c.name RETURN DISTINCT a.name AS a, c.name AS c", word="clinic")


@query(f"""WITH n AS ({_ENT}) SELECT a.name AS name, count(k.dst) AS n FROM n a LEFT JOIN (SELECT k.* FROM kg_edges k JOIN n ON n.name = k.dst WHERE k.rel = 'INFORMED') k ON k.src = a.name WHERE a.type = 'event' GROUP BY a.name""")
def cypher_optional(s, d):
    return _cypher(s, d, "MATCH (a:event) OPTIONAL MATCH (a)-[r:INFORMED]->(b) RETURN a.name AS name, count(b.name) AS n")


# Streams (batch twins) and relational constructs


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR AS \"end\", event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def events_tumbling(s, d):
    x = ev.windows(T(s, d, "events"), "1 hour").withColumn("total", F.round("total", 4))
    return x.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start", "end")})


@query("""WITH b AS (SELECT time_bucket(INTERVAL 15 MINUTE, ts) AS t, event_type, value FROM events), w AS (SELECT t - INTERVAL 15 MINUTE * k AS start, event_type, value FROM b, range(0, 4) r(k))
SELECT start, start + INTERVAL 1 HOUR AS "end", event_type, count(*) AS n, round(sum(value), 4) AS total FROM w GROUP BY ALL""")
def events_sliding(s, d):
    x = ev.windows(T(s, d, "events"), "1 hour", "15 minutes").withColumn("total", F.round("total", 4))
    return x.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start", "end")})


@query("""WITH x AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 2 HOUR THEN 0 ELSE 1 END AS new FROM events), y AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM x)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 2 HOUR AS "end", count(*) AS n FROM y GROUP BY user_id, k""")
def events_sessions(s, d):
    x = ev.sessions(T(s, d, "events"), "2 hours")
    return x.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start", "end")})


@query("SELECT user_id, event_type FROM events GROUP BY ALL")
def events_dedup(s, d):
    return ev.deduplicated(T(s, d, "events"), "user_id", "event_type").select("user_id", "event_type")


@query("SELECT l_returnflag, l_linestatus, round(sum(l_extendedprice), 2) AS revenue FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_returnflag), ())")
def grouping_sets_revenue(s, d):
    x = T(s, d, "lineitem").groupingSets([["l_returnflag", "l_linestatus"], ["l_returnflag"], []], "l_returnflag", "l_linestatus")
    return x.agg(F.round(F.sum("l_extendedprice"), 2).alias("revenue"))


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
def cube_orders(s, d):
    return T(s, d, "orders").cube("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))


@query("SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 2) AS last3, rank() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC) AS r FROM orders")
def window_frames(s, d):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey").rowsBetween(-2, 0)
    r = F.rank().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice")))
    return T(s, d, "orders").select("o_orderkey", F.round(F.sum("o_totalprice").over(w), 2).alias("last3"), r.alias("r"))


@query("""WITH p AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase'), c AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'click')
SELECT p.event_id, max((c.ts, c.event_id))[2] AS last_click FROM p LEFT JOIN c ON c.user_id = p.user_id AND c.ts <= p.ts GROUP BY p.event_id""")
def asof_last_event(s, d):
    e = T(s, d, "events").where("event_type in ('purchase', 'click')")
    w = Window.partitionBy("user_id").orderBy("ts", F.col("event_type") == "purchase", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    x = e.withColumn("last_click", F.last(F.when(F.col("event_type") == "click", F.col("event_id")), ignorenulls=True).over(w))
    return x.where("event_type = 'purchase'").select("event_id", "last_click")


from kgspark import more_queries  # noqa: E402, F401  (adds to the registry)
