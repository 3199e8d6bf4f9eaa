"""Closure, resolution, solver, store and graph operators on small tables."""

import random

import pytest
from pyspark.sql import functions as F

from kgspark.operators import closure, governance, graph, resolve, retrieval, rewrite, solver
from kgspark.plans import cypher, providers
from kgspark.sources import loaders, store

EDGE = "seq long, src string, rel string, dst string, evidence_text string, status string, condition string, evidence_score double, schema_fit_score double, confidence double, alternative_group string"


def edges(spark, rows):
    return spark.createDataFrame([(i, s, r, d, e, "", "", 0.8, 1.0, c, "") for i, (s, r, d, e, c) in enumerate(rows)], EDGE)


def union_find(pairs):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    return {x: find(x) for x in parent}


@pytest.mark.parametrize("seed", [1, 2])
def test_components(spark, seed):
    rng = random.Random(seed)
    pairs = [(f"n{rng.randrange(60)}", f"n{rng.randrange(60)}") for _ in range(45)] + [(f"c{i}", f"c{i + 1}") for i in range(20)]
    got = {r[0]: r[1] for r in closure.components(spark.createDataFrame(pairs, "a string, b string")).collect()}
    assert got == union_find(pairs)


def test_components_empty(spark):
    assert closure.components(spark.createDataFrame([], "a string, b string")).count() == 0


def test_chain_ends(spark):
    links = [("a", "b"), ("b", "c"), ("c", "d"), ("x", "y"), ("y", "x"), ("q", "r")]
    got = {r[0]: r[1] for r in closure.chain_ends(spark.createDataFrame(links, "alias string, canonical string")).collect()}
    assert {k: got[k] for k in "abcq"} == {"a": "d", "b": "d", "c": "d", "q": "r"} and got["x"] in ("x", "y")


def test_service_collapse(spark):
    names = spark.createDataFrame([("blood test",), ("blood tests",), ("basic blood tests",), ("vaccination",), ("vaccinations",)], "name string")
    got = {r[0]: r[1] for r in resolve.collapse_services(names).collect()}
    assert got == {"blood test": "blood tests", "basic blood tests": "blood tests", "vaccination": "vaccinations"}


CAND = "seq long, mention string, canonical string, base_types array<struct<type:string,score:double>>, domain_types array<struct<type:string,score:double>>, functional_roles array<string>, status string, aliases array<struct<text:string,lang:string>>, evidence array<struct<text:string,language:string,chunk_id:string,source:string>>, chunk_id string"


def test_alias_map_and_merge(spark):
    rows = [
        (1, "aal", "Al-Amal Laboratory", [("organization", 0.9)], [], ["branch"], "active", [("al-amal lab", "en")], [], ""),
        (2, "Cedar Branch North", "cedar branch north", [("organization", 0.9)], [], ["branch"], "active", [], [], ""),
        (3, "cedar branch north", "cedar branch north", [("location", 0.6), ("role", 0.2)], [], ["operated_unit"], "", [], [], ""),
        (4, None, None, None, None, None, None, None, None, None),
    ]
    c = spark.createDataFrame(rows, CAND)
    m = {r[0]: r[1] for r in resolve.alias_map(c).collect()}
    assert m == {"aal": "al-amal laboratory", "al-amal lab": "al-amal laboratory"}
    got = {r["name"]: r for r in resolve.canonical_entities(c, resolve.alias_map(c)).collect()}
    n = got["cedar branch north"]
    assert n["base_types"] == ["organization", "location"] and n["status"] == "active" and set(n["functional_roles"]) == {"branch", "operated_unit"}


def test_quality_and_orphans(spark):
    one = lambda m, t: (0, m, m, t, [], [], "", [], [], "")
    c = spark.createDataFrame([one("cedargate", [("organization", 0.9)]), one("2025-02-13", [("date_time", 0.9)]), one("dr. smith", [("person", 0.9)]), one("50000", [("money", 0.9)]), one("monthly", [("concept", 0.6), ("date_time", 0.9)])], CAND)
    kept = resolve.quality_filter(c)
    assert {r["mention"] for r in kept.collect()} == {"cedargate", "dr. smith"}
    e = edges(spark, [("cedargate", "X", "dr. smith", "", 0.5), ("cedargate", "X", "10:00", "", 0.5)])
    assert resolve.drop_orphans(e, kept).count() == 1


def test_selection(spark):
    e = edges(spark, [("a", "BASED_AT", "b", "", 1.0), ("a", "VISITS", "b", "", 0.5), ("a", "HAS_BRANCH", "c", "", 0.9), ("a", "HAS_BRANCH", "c", "", 0.7)])
    g = {r["seq"]: r["alternative_group"] for r in solver.alternative_groups(e).collect()}
    assert g[0] == g[1] != "" and g[2] == ""
    kept = solver.select(solver.alternative_groups(e))
    assert {r["seq"] for r in kept.collect()} == {0, 2, 3}
    folded = {r["seq"]: r["confidence"] for r in solver.fold_duplicates(kept).collect()}
    assert set(folded) == {0, 2} and abs(folded[2] - 0.97) < 1e-9


def test_verdicts(spark):
    ents = spark.createDataFrame([("a", ["organization"]), ("b", ["organization"]), ("s", ["service"])], "name string, base_types array<string>")
    al = spark.createDataFrame([("aal", "a")], "alias string, canonical string")
    e = edges(spark, [("a", "PARTNERS_WITH", "b", "", 1.0), ("aal", "PARTNERS_WITH", "b", "", 1.0), ("a", "OFFERS", "b", "", 1.0), ("a", "OFFERS", "s", "contract with b", 1.0), ("a", "NOPE", "b", "", 1.0), ("a", "OFFERS", "10:00", "", 1.0), ("a", "CONTRACTED_WITH", "b", "works closely", 1.0), ("a", "CONTRACTED_WITH", "b", "service agreement", 1.0)])
    got = [r["verdict"] for r in sorted(solver.verdicts(e, ents, al).collect())]
    assert got == ["keep", "alias_end", "signature", "evidence", "unknown_relation", "raw_value", "evidence", "keep"]


def test_rewrites(spark):
    e = spark.createDataFrame([(1, "a", "", "b", "MANAGED_BY"), (2, "a", "", "b", "RELATED_TO"), (3, "a", "", "b", "OPERATES"), (4, "a", "", "a", "PART_OF")], "seq long, src string, rel string, dst string, relation_raw string")
    got = {r["seq"]: (r["src"], r["rel"], r["dst"]) for r in rewrite.resolve_relations(e).collect()}
    assert got == {1: ("b", "MANAGES", "a"), 3: ("a", "HAS_BRANCH", "b")}
    c = edges(spark, [("a", "OFFERS", "s", "", 1.0), ("a", "DOES_NOT_OFFER", "s", "", 1.0), ("b", "OFFERS", "s", "", 1.0)])
    assert {r["seq"] for r in rewrite.drop_contradicted(c).collect()} == {1, 2}
    p = edges(spark, [("x", "PART_OF", "y", "", 1.0)])
    assert {(r["src"], r["rel"], r["dst"]) for r in rewrite.add_inverses(p).collect()} == {("x", "PART_OF", "y"), ("y", "HAS_BRANCH", "x")}
    names = spark.createDataFrame([("haifa central",), ("cedar haifa clinic",), ("northlab",)], "name string")
    net = edges(spark, [("cedar network", "HAS_BRANCH", "cedar one", "", 1.0)])
    assert [r["dst"] for r in rewrite.complete_by_name(net, names, ("HAS_BRANCH",), "HAS_BRANCH").collect()] == ["cedar haifa clinic"]


def test_paths_use_no_edge_twice(spark):
    e = edges(spark, [("a", "R", "b", "", 1.0), ("b", "R", "a", "", 1.0), ("b", "R", "c", "", 1.0)])
    start = spark.createDataFrame([("a",)], "name string")
    got = {(r["node"], r["depth"]) for r in graph.paths(e, start, 3).collect()}
    assert got == {("b", 1), ("a", 2), ("c", 2)}
    assert {r["node"]: r["depth"] for r in graph.reachable(e, start, 3).collect()} == {"b": 1, "c": 2}


def test_subgraph_cap(spark):
    e = spark.createDataFrame([("f", "R", f"n{i:03}", float(i)) for i in range(100)] + [("f", "R", "g", 0.0)], "src string, rel string, dst string, weight double")
    f = spark.createDataFrame([("f",), ("g",)], "name string")
    got = graph.focused_subgraph(e, f, 60)
    assert got.count() == 59 and got.where("dst = 'g'").count() == 1 and got.where("dst = 'n099'").count() == 1


def test_merge_edges(spark):
    rows = [(2, "a", "R", "b", 1.0, "", "c1", "second", ""), (1, "a", "R", "b", 2.0, "", "c2", "first", "if x"), (3, "a", "R", "b", 1.0, "active", "c1", "first", "")]
    df = spark.createDataFrame(rows, "seq long, src string, rel string, dst string, weight double, status string, chunk_id string, evidence_text string, condition string")
    r = store.merge_edges(df).first()
    assert (r["weight"], r["status"], r["chunk_ids"], r["evidence_text"], r["condition"]) == (4.0, "active", ["c1", "c2"], "first\n---\nsecond", "if x")


def test_retrieval_helpers(spark):
    f = spark.createDataFrame([("a", 0.9), ("b", 0.2), ("c", 0.1), ("d", 0.05), ("e", 0.01)], "text string, score double")
    assert [r["text"] for r in retrieval.relevant_facts(f).orderBy("rank").collect()] == ["a", "b", "c"]
    assert retrieval.relevant_facts(f.limit(0)).count() == 0
    x = spark.createDataFrame([("k", 1), ("m", 2)], "id string, pos int")
    y = spark.createDataFrame([("k", 1), ("z", 2)], "id string, pos int")
    assert {r["id"]: r["source"] for r in retrieval.pool([("p", x), ("q", y)], "id").collect()} == {"k": "p", "m": "p", "z": "q"}
    text = retrieval.assemble("hint", {"Key Entities": ["a"], "Facts": ["f"]})
    assert text.index("hint") < text.index("## Key Entities") < text.index("## Facts")


def test_governance(spark):
    known = spark.createDataFrame([("care_center",), ("blood_test_lab",)], "name string")
    al = spark.createDataFrame([("hub", "care_center")], "alias string, canonical string")
    p = spark.createDataFrame([("CARE_CENTER",), ("hub",), ("center_care",), ("blood_test_lab_x",), ("thing",), ("quasar",)], "name string")
    got = {r["name"]: r["decision"] for r in governance.check_types(p, known, al).collect()}
    assert got == {"CARE_CENTER": "exact", "hub": "alias", "center_care": "word_order", "blood_test_lab_x": "similar", "thing": "vague", "quasar": "new"}
    rel = spark.createDataFrame([("WORKS", ["person"], ["organization"])], "rel string, src_types array<string>, dst_types array<string>")
    par = spark.createDataFrame([("clinic", ["organization"])], "type string, bases array<string>")
    e = spark.createDataFrame([("person", "WORKS", "clinic"), ("clinic", "WORKS", "person"), ("event", "WORKS", "event"), ("a", "X", "b")], "src_type string, rel string, dst_type string")
    assert [r["direction"] for r in governance.check_direction(e, rel, par).orderBy("rel", "src_type").collect()] == ["flip", "invalid", "ok", "unknown"]


def test_cypher(spark):
    ents = spark.createDataFrame([("a", "person"), ("b", "organization"), ("c", "organization")], "name string, type string")
    e = spark.createDataFrame([("a", "WORKS", "b", 1.0), ("b", "PART_OF", "c", 2.0)], "src string, rel string, dst string, weight double")
    q = lambda t, **p: [tuple(r) for r in cypher.query(ents, e, t, p).collect()]
    assert q("MATCH (x:person)-[r:WORKS]->(y) RETURN x.name, type(r) AS t, y.name AS y") == [("a", "WORKS", "b")]
    assert sorted(q("MATCH (x)-[*1..2]->(y) WHERE x.name = $n RETURN y.name AS y", n="a")) == [("b",), ("c",)]
    assert q("MATCH (y)<-[r]-(x) RETURN y.name AS y, count(*) AS n ORDER BY y") == [("b", 1), ("c", 1)]
    assert q("MATCH (x {name: 'c'})-[r]-(y) RETURN y.name AS y") == [("b",)]
    assert q("MATCH (x) WHERE x.name IN ['a', 'c'] RETURN count(x) AS n") == [(2,)]
    assert sorted(q("MATCH (x:organization) OPTIONAL MATCH (x)-[r]->(y) RETURN x.name AS x, y.name AS y")) == sorted([("b", "c"), ("c", None)], key=str)
    assert q("MATCH (x)-[r]->(y) WITH x, count(r) AS n WHERE n > 0 RETURN x.name AS x ORDER BY x LIMIT 1") == [("a",)]
    assert sorted(q("MATCH (x:person) RETURN x.name AS n UNION MATCH (x:organization) RETURN x.name AS n")) == [("a",), ("b",), ("c",)]
    for bad in ("CREATE (n)", "MATCH (n) DELETE n", "MATCH (n) SET n.x = 1", "MERGE (n)", "DROP INDEX x", "MATCH (n) RETURN *", "MATCH (n)", "MATCH (n) RETURN m.name"):
        with pytest.raises(cypher.Unsupported):
            q(bad)


def test_breaker():
    now = [0.0]
    b = providers.Breaker(2, 1.0, 30.0, lambda: now[0])

    def bad():
        raise ValueError

    for _ in range(2):
        with pytest.raises(ValueError):
            b.call(bad)
    with pytest.raises(RuntimeError):
        b.call(lambda: 1)
    now[0] = 2.0
    assert b.call(lambda: 1) == 1 and b.failures == 0


def test_loaders(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.md").write_text("# Title\n\ntext\n\n## Part\n")
    (tmp_path / "sub" / "b.csv").write_text("x,y\n1, two\n3,\n")
    (tmp_path / "c.html").write_text("<html><title>T</title><script>var a = '</p>';</script><p>Hello &amp; bye</p><style>x</style></html>")
    (tmp_path / "d.bin").write_text("skip")
    (tmp_path / "e.csv").write_text("only,header\n")
    docs, errors = loaders.load(spark, str(tmp_path))
    got = {r["metadata"]["filename"]: r for r in docs.collect()}
    assert set(got) == {"a.md", "b.csv", "c.html"}
    assert got["a.md"]["metadata"]["headings"] == "h1:Title|h2:Part"
    assert got["b.csv"]["content"] == "Record 1:\n  x: 1\n  y: two\n\nRecord 2:\n  x: 3\n"
    assert got["c.html"]["content"].split() == ["T", "Hello", "&", "bye"]
    assert errors.count() == 1
