"""Cypher beyond plain patterns: subqueries, procedures, CASE, slices, chunks, and what is refused."""

import pytest

from kgspark.plans import cypher


@pytest.fixture(scope="module")
def g(spark):
    ents = spark.createDataFrame([("ann", "person", [1.0, 0.0]), ("bob", "person", [0.0, 1.0]), ("haifa clinic", "organization", [0.9, 0.1]), ("lab north", "organization", None)], "name string, type string, embedding array<float>")
    e = spark.createDataFrame([("ann", "WORKS", "haifa clinic", 1.0), ("bob", "WORKS", "haifa clinic", 2.0), ("ann", "VISITS", "lab north", 3.0), ("haifa clinic", "USES", "lab north", 4.0)], "src string, rel string, dst string, weight double")
    chunks = spark.createDataFrame([("c1", "d1", "Ann works in Haifa", [1.0, 0.0]), ("c2", "d1", "The north lab", [0.0, 1.0])], "chunk_id string, doc_id string, text string, embedding array<float>")
    ment = spark.createDataFrame([("ann", "c1"), ("ann", "c2"), ("lab north", "c2")], "name string, chunk_id string")
    return lambda t, **p: [tuple(r) for r in cypher.query(ents, e, t, p, chunks, ment).collect()]


def test_case_and_slices(g):
    assert sorted(g("MATCH (n:Concept) RETURN n.name AS n, CASE n.type WHEN 'person' THEN 1 ELSE 0 END AS p")) == [("ann", 1), ("bob", 1), ("haifa clinic", 0), ("lab north", 0)]
    assert g("MATCH (n:person) RETURN CASE WHEN n.name = 'ann' THEN 'a' WHEN n.name = 'bob' THEN 'b' END AS k ORDER BY k") == [("a",), ("b",)]
    assert g("MATCH (n:Concept) RETURN collect(n.name)[..2] AS two, collect(n.name)[1..] AS rest, collect(n.name)[0] AS first") == [(["ann", "bob"], ["bob", "haifa clinic", "lab north"], "ann")]


def test_subquery_limits_each_row(g):
    t = "MATCH (a:person) CALL { WITH a MATCH (a)-[r]->(b:Concept) RETURN b.name AS b, r.weight AS w ORDER BY w DESC LIMIT 1 } RETURN a.name AS a, b ORDER BY a"
    assert g(t) == [("ann", "lab north"), ("bob", "haifa clinic")]
    assert g("UNWIND ['ann', 'x'] AS nm MATCH (a:Concept {name: nm}) CALL { WITH a MATCH (a)-[]->(b) RETURN count(b.name) AS n } RETURN a.name AS a, n") == [("ann", 4)]


def test_procedures(g):
    assert sorted(g("CALL db.relationshipTypes() YIELD relationshipType RETURN relationshipType")) == [("MENTIONED_IN",), ("USES",), ("VISITS",), ("WORKS",)]
    assert g("CALL db.idx.fulltext.queryNodes('Chunk', 'where does ann works') YIELD node, score RETURN node.name AS n, score") == [("c1", 2.0)]
    assert g("CALL db.idx.vector.queryNodes('Concept', 'embedding', 2, vecf32([1.0, 0.0])) YIELD node, score RETURN node.name AS n ORDER BY score DESC") == [("ann",), ("haifa clinic",)]
    assert g("CALL db.idx.vector.queryNodes('Concept', 'embedding', 1, $v) YIELD node AS x MATCH (x)-[:WORKS]->(y) RETURN y.name AS y", v=[1.0, 0.0]) == [("haifa clinic",)]
    with pytest.raises(cypher.Unsupported):
        g("CALL db.nothing() YIELD x RETURN x")


def test_chunks(g):
    t = "UNWIND $names AS nm MATCH (e:Concept {name: nm})-[:MENTIONED_IN]->(c:Chunk) WITH nm, c.name AS c, vec.cosineDistance(c.embedding, vecf32($v)) AS d ORDER BY nm, d RETURN nm, c, d < 0.5 AS near ORDER BY nm, c"
    assert g(t, names=["ann", "lab north"], v=[1.0, 0.0]) == [("ann", "c1", True), ("ann", "c2", False), ("lab north", "c2", False)]
    assert g("MATCH (c:Chunk) WHERE c.text CONTAINS 'lab' RETURN c.name AS c") == [("c2",)]
    assert g("MATCH (n:Concept) RETURN count(n) AS n") == [(4,)]
    assert g("MATCH (n {name: 'ann'}) RETURN properties(n) AS p") == [({"name": "ann", "type": "person"},)]


def test_patterns_apart(g):
    assert g("MATCH (a {name: 'ann'}), (b {name: 'bob'}) RETURN a.name AS a, b.name AS b") == [("ann", "bob")]
    assert sorted(g("MATCH (a:person), (b) WHERE b.name = a.name RETURN a.name AS a, b.type AS t")) == [("ann", "person"), ("bob", "person")]
    with pytest.raises(cypher.Unsupported):
        g("MATCH (a), (b) RETURN a.name, b.name")


def test_writes(spark):
    from kgspark.plans.cypher_write import update

    ents = spark.createDataFrame([("ann", "person"), ("lab", "organization")], "name string, type string")
    e = spark.createDataFrame([("ann", "WORKS", "lab", 1.0)], "src string, rel string, dst string, weight double")
    go = lambda t, **p: tuple(sorted(map(tuple, df.collect()), key=str) for df in update(ents, e, t, p))
    assert go("MERGE (n:person {name: 'bob'}) ON CREATE SET n.age = 3 ON MATCH SET n.age = 4")[0] == [("ann", "person", None), ("bob", "person", 3), ("lab", "organization", None)]
    assert go("MERGE (n {name: 'ann'}) ON CREATE SET n.age = 3 ON MATCH SET n.age = 4")[0][0] == ("ann", "person", 4)
    nodes, rels = go("UNWIND $rows AS row MERGE (a {name: row.a}) MERGE (b:place {name: row.b}) MERGE (a)-[r:VISITS]->(b) ON CREATE SET r.weight = row.w", rows=[{"a": "ann", "b": "park", "w": 2.0}, {"a": "eve", "b": "park", "w": 3.0}, {"a": None, "b": "x", "w": 1.0}])
    assert {x[0] for x in nodes} == {"ann", "eve", "lab", "park"} and ("ann", "VISITS", "park", 2.0) in rels and ("eve", "VISITS", "park", 3.0) in rels and len(rels) == 3
    assert go("MATCH (a {name: 'ann'}), (b {name: 'lab'}) MERGE (a)-[r:WORKS]->(b) ON CREATE SET r.weight = 9 ON MATCH SET r.weight = r.weight + 1")[1] == [("ann", "WORKS", "lab", 2.0)]
    assert go("MATCH (n:person) SET n += {type: 'human', note: 'x'}")[0][0] == ("ann", "human", "x")
    assert go("MATCH (n:person) REMOVE n.type")[0][0] == ("ann", None)
    assert go("MATCH (a)-[r:WORKS]->(b) DELETE r")[1] == []
    assert go("MATCH (n {name: 'ann'}) DETACH DELETE n") == ([("lab", "organization")], [])
    for bad in ("MATCH (n {name: 'ann'}) DELETE n", "MATCH (n) RETURN n.name", "MERGE (n {age: 1})", "MATCH (n) SET n.name = 'x'", "MATCH (a)-[r]-(b) MERGE (a)-[:X]-(b)"):
        with pytest.raises(cypher.Unsupported):
            go(bad)
