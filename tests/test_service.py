"""The whole way: extraction strategies, resolution, store without losses, answers, chat, HTTP and command line."""

import json
import threading
from urllib.error import HTTPError
from urllib.request import Request, urlopen

import pytest
from pyspark.sql import functions as F

from kgspark import __main__ as cli
from kgspark.operators import extraction, resolve, rewrite, simjoin, solver
from kgspark.plans import prompts
from kgspark.plans.pipeline import Config, Pipeline
from kgspark.plans.providers import HashEmbedder, RuleProvider
from kgspark.plans.telemetry import Telemetry
from kgspark.server import serve
from kgspark.sources import store

TEXT = "Dana Levi works at Haifa Clinic Group since 2021. Haifa Clinic Group partners with Cedar Medical Group. Omar Nasser visits Cedar Medical Group."


def scripted(answers):
    """A provider that answers by the start of the system text, and a failure where there is none."""

    class Scripted(HashEmbedder):
        def complete(self, system, user):
            for start, said in answers.items():
                if system.startswith(start):
                    if isinstance(said, Exception):
                        raise said
                    return said(user) if callable(said) else said
            raise RuntimeError("no answer")

    return Scripted()


def test_strategies(spark):
    chunks = spark.createDataFrame([("c1", 0, "Dana Levi met someone."), ("c2", 1, "nothing named here")], "chunk_id string, doc_seq long, text string")
    first = json.dumps({"entities": [{"mention": "Dana Levi", "base_type_candidates": [{"type": "person", "score": 0.9}]}]})
    second = json.dumps({"entities": [{"mention": "Dana Levi, MD", "base_type_candidates": [{"type": "person", "score": 1.0}]}], "relationships": [{"from_mention": "Dana Levi, MD", "relation_id": "WORKS_AT", "to_mention": "x", "confidence": 0.7}]})
    names = lambda df: sorted((r["chunk_id"], r["mention"]) for r in extraction.entities_of(df).collect())
    both = scripted({"Find the entities": first, "Check the entities": second})
    assert names(extraction.extracted(chunks, both, "llm")) == [("c1", "dana levi, md"), ("c2", "dana levi, md")]
    only = scripted({"Find the entities": first, "Check the entities": RuntimeError("down")})
    assert names(extraction.extracted(chunks, only, "llm")) == [("c1", "dana levi"), ("c2", "dana levi")]
    # names recognised are verified by one call; without names the model finds them; without a reply the names stay
    got = extraction.extracted(chunks, both, "hybrid")
    assert names(got) == [("c1", "dana levi, md"), ("c2", "dana levi, md")] and extraction.edges_of(got).count() == 2
    got = extraction.extracted(chunks, only, "hybrid")
    assert names(got) == [("c1", "dana levi"), ("c2", "dana levi")]
    assert extraction.entities_of(got).where("chunk_id = 'c1'").first()["base_types"][0]["score"] == 0.8
    empty = scripted({"Find the entities": first, "Check the entities": '{"entities": [], "relationships": []}'})
    assert names(extraction.extracted(chunks, empty, "hybrid"))[0] == ("c1", "dana levi")
    with pytest.raises(ValueError):
        extraction.extracted(chunks, both, "other")


def test_references(spark):
    chunks = spark.createDataFrame([("a", "Then she left."), ("b", "Dana left."), ("c", "And the company grew."), ("d", None)], "chunk_id string, text string")
    said = scripted({"Rewrite the text": lambda u: '{"resolved_text": "Then Dana left."}' if "she" in u else "The firm grew."})
    got = {r["chunk_id"]: r["text"] for r in extraction.resolved_references(chunks, said).collect()}
    assert got == {"a": "Then Dana left.", "b": "Dana left.", "c": "The firm grew.", "d": None}
    broken = scripted({"Rewrite the text": RuntimeError("down")})
    assert {r["text"] for r in extraction.resolved_references(chunks, broken).collect()} == {"Then she left.", "Dana left.", "And the company grew.", None}


def test_fold_three_ways(spark):
    cols = "seq long, src string, rel string, dst string, evidence_score double, schema_fit_score double, confidence double"
    rows = [(1, "A", "R", "b", 0.5, 1.0, 0.5), (2, "a", "R", "B", 0.9, 1.0, 0.9), (3, "a", "R", "b", 0.2, 1.0, 0.4), (5000, "a", "R", "b", 0.95, 1.0, 0.9), (9, "z", "R", "b", None, None, None)]
    got = {r["src"].lower(): r for r in solver.fold_duplicates(spark.createDataFrame(rows, cols)).collect()}
    # 2 replaces 1 and adds its own tenth, 3 adds, and 5000 no longer exceeds what 2 has become
    assert got["a"]["seq"] == 2 and abs(got["a"]["confidence"] - (0.9 + 0.09 + 0.04 + 0.09)) < 1e-9
    assert got["z"]["seq"] == 9 and got["z"]["confidence"] == 0
    # against a plain loop
    import random

    rng = random.Random(1)
    rows = [(k * 700, f"s{rng.randrange(3)}", "R", "d", round(rng.random(), 3), round(rng.random(), 3), round(rng.random(), 3)) for k in range(120)]
    best = {}
    for r in rows:
        f, old = 0.4 * r[4] + 0.3 * r[5] + 0.3 * r[6], best.get(r[1])
        if old is None:
            best[r[1]] = [r[0], f, r[6]]
            continue
        if f > old[1]:
            old[:] = [r[0], f, r[6]]
        old[1] += 0.03 * r[6]
        old[2] += 0.1 * r[6]
    got = {r["src"]: (r["seq"], round(r["confidence"], 9)) for r in solver.fold_duplicates(spark.createDataFrame(rows, cols)).collect()}
    assert got == {k: (v[0], round(v[2], 9)) for k, v in best.items()}


def test_texts_that_contain_each_other(spark):
    rows = [(1, "a", "R", "b", 1.0, "", "c1", "the long text", "if late"), (2, "a", "R", "b", 1.0, "", "c2", "long", "if"), (3, "a", "R", "b", 1.0, "", "c3", "a very long text", "when it rains")]
    df = spark.createDataFrame(rows, "seq long, src string, rel string, dst string, weight double, status string, chunk_id string, evidence_text string, condition string")
    r = store.merge_edges(df).first()
    assert r["evidence_text"] == "the long text\n---\na very long text" and r["condition"] == "if late\n---\nwhen it rains"


def test_branches_by_substring(spark):
    ents = spark.createDataFrame(
        [("cedargate-north clinic", ["organization"], [], [], "active"), ("the cedargate hub", ["organization"], [], ["planned_unit"], ""), ("cedargate person", ["person"], [], ["branch"], ""), ("old cedargate clinic", ["organization"], [], [], "former"), ("cedargate works", ["organization"], [], [], "")],
        "name string, base_types array<string>, domain_types array<string>, functional_roles array<string>, status string",
    )
    e = spark.createDataFrame([("cedargate network", "HAS_BRANCH", "x")], "src string, rel string, dst string")
    got = {(r["rel"], r["dst"], r["status"]) for r in rewrite.complete_branches(e, ents).collect()}
    assert got == {("HAS_BRANCH", "cedargate-north clinic", "active"), ("HAS_PLANNED_BRANCH", "the cedargate hub", "planned")}
    assert rewrite.complete_branches(e.limit(0), ents).count() == 0


def test_similarity_join(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    base = rng.standard_normal((40, 16))
    m = base[rng.integers(0, 40, 400)] + 0.25 * rng.standard_normal((400, 16))
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    for least in (0.5, 0.9, 0.97):
        s = u @ u.T
        want = {(i, j) for i in range(400) for j in range(i + 1, 400) if s[i, j] >= least}
        rows = [(i, r.tolist()) for i, r in enumerate(m)] + [(900, None), (901, [0.0] * 16), (902, [float("nan")] * 16), (903, [1.0]), (0, m[0].tolist())]
        df = spark.createDataFrame(rows, "name long, embedding array<double>")
        got = [(r["a"], r["b"]) for r in simjoin.similar(df, least).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    assert simjoin.similar(df.limit(0), 0.9).count() == 0


def test_tiers(spark):
    cand = "seq long, mention string, canonical string, base_types array<struct<type:string,score:double>>, domain_types array<struct<type:string,score:double>>, functional_roles array<string>, status string, aliases array<struct<text:string,lang:string>>, evidence array<struct<text:string,language:string,chunk_id:string,source:string>>"
    ev = [("t", "en", "c", "")]
    rows = [(1, "north clinic", "north clinic", [("organization", 0.9)], [], ["branch"], "", [], ev * 2), (2, "clinic north", "clinic north", [("organization", 0.9)], [], [], "active", [], ev), (3, "nclinic", "clinic north", [("organization", 0.9)], [], [], "", [], ev), (4, "north", "north", [("person", 0.9)], [], [], "", [], ev)]
    e = spark.createDataFrame(rows, cand)
    vec = spark.createDataFrame([("north clinic", [1.0, 0.0]), ("clinic north", [1.0, 0.01]), ("north", [1.0, 0.0])], "name string, embedding array<double>")
    al, ents = resolve.tiered(e, vec)
    got = {r["name"]: r for r in ents.collect()}
    assert set(got) == {"clinic north", "north"} or set(got) == {"north clinic", "north"}
    kept = next(n for n in got if n != "north")
    assert got[kept]["status"] == "active" and got[kept]["n_evidence"] == 4 and got[kept]["functional_roles"] == ["branch"]
    amap = {r["alias"]: r["canonical"] for r in al.collect()}
    assert amap["nclinic"] == kept and len(amap) == 2


@pytest.fixture(scope="module")
def pipe(spark, tmp_path_factory):
    p = Pipeline(spark, str(tmp_path_factory.mktemp("service") / "kg"))
    p.ingest_text(TEXT, "one")
    p.ingest_text("Omar Nasser manages North Valley Group. Dana Levi works at Haifa Clinic Group.", "two")
    return p


def test_entities_and_edges_met_again(pipe):
    e = {(r["src"], r["rel"], r["dst"]): r for r in pipe.store.read("edges").collect()}
    r = e["dana levi", "BASED_AT", "haifa clinic group"]
    assert r["n"] == 2 and len(r["chunk_ids"]) == 2 and "Haifa Clinic Group" in r["evidence_text"] and r["embedding"]
    n = {x["name"]: x for x in pipe.store.read("entities").collect()}
    assert n["omar nasser"]["base_types"] == ["person"] and n["omar nasser"]["embedding"]
    assert [p for p, _ in pipe.phases][:2] == ["changed", "extraction"]


def test_finalize_loses_nothing(spark, pipe, tmp_path):
    root = str(tmp_path / "f")
    p = Pipeline(spark, root)
    ents, edges = pipe.store.read("entities"), pipe.store.read("edges")
    twin = ents.where("name = 'cedar medical group'").withColumn("name", F.lit("Cedar Medical Group "))
    more = edges.where("dst = 'cedar medical group'").withColumns({"dst": F.lit("Cedar Medical Group "), "evidence_text": F.lit("said elsewhere"), "weight": F.lit(1.0)})
    ment = pipe.store.read("mentions")
    p.store.commit({"entities": ents.unionByName(twin), "edges": edges.unionByName(more), "mentions": ment.unionByName(ment.where("name = 'cedar medical group'").withColumn("name", F.lit("Cedar Medical Group "))), "aliases": pipe.store.read("aliases"), "chunks": pipe.store.read("chunks"), "documents": pipe.store.read("documents"), "chunk_tokens": pipe.store.read("chunk_tokens")})
    before = {(r["src"], r["rel"]): r for r in edges.where("dst = 'cedar medical group'").collect()}
    p.finalize()
    names = {r["name"] for r in p.store.read("entities").collect()}
    kept = next(n for n in names if n.strip().lower() == "cedar medical group")
    assert len([n for n in names if n.strip().lower() == "cedar medical group"]) == 1
    rows = p.store.read("edges").where(F.lower(F.trim("dst")) == "cedar medical group").collect()
    assert len(rows) == len(before) and all(r["dst"] == kept and r["fact"] and r["chunk_ids"] and r["embedding"] and "said elsewhere" in r["evidence_text"] for r in rows)
    assert all(r["weight"] == pytest.approx(before[r["src"], r["rel"]]["weight"] + 1.0) for r in rows)
    assert {r["name"] for r in p.store.read("mentions").where(F.lower(F.trim("name")) == "cedar medical group").collect()} == {kept}
    p.delete("one", "two")
    assert p.store.read("documents").count() == 0 and p.store.read("chunk_tokens").count() == 0
    assert p.stats() == {"nodes": 0, "edges": 0}


def test_only_changed_tables_are_written(spark, tmp_path):
    s = store.Store(spark, str(tmp_path / "s"))
    df = spark.createDataFrame([("a", "b")], "doc_id string, content_hash string")
    s.commit({"documents": df, "chunks": df})
    for _ in range(4):
        s.commit({"documents": df})
    assert s._manifest(s.current()) == {"documents": 5, "chunks": 1} and s.read("chunks").count() == 1
    assert not (tmp_path / "s" / "v2" / "documents").exists() and not (tmp_path / "s" / "_committed" / "3").exists()


def test_answers(pipe):
    a = pipe.query("Who works at Haifa Clinic Group?", human=True)
    assert "dana levi" in a.text and a.graph and a.context
    assert any("→" in f for f in a.facts) and "[Source: one]" in a.context
    whole = pipe.query("List all groups that Omar Nasser visits")
    assert whole.entities
    q = scripted({"Translate the question": '{"cypher": "MATCH (a)-[:VISITS]->(b) RETURN b.name AS place, count(a) AS n ORDER BY n DESC LIMIT 10"}', "You answer": '{"answer": "Cedar, once."}'})
    p = Pipeline(pipe.spark, pipe.store.root, q)
    a = p.query("Which group has the most visitors?", human=True)
    assert a.text == "Cedar, once." and a.rows == [{"place": "cedar medical group", "n": 1}] and a.entities == ["cedar medical group"] and a.statement.startswith("MATCH")
    assert p.query("Which group has the most visitors?").text == "place | n\ncedar medical group | 1"
    for bad in ('{"cypher": "MATCH (n) DELETE n"}', "no idea", '{"cypher": "MATCH (n) RETURN x"}'):
        p = Pipeline(pipe.spark, pipe.store.root, scripted({"Translate the question": bad, "You answer": RuntimeError("down"), "Read the question": '{"names": ["Omar Nasser"]}'}))
        a = p.query("How many groups does Omar Nasser visit?", human=True)
        assert "omar nasser" in a.entities and a.text.startswith("What was found")


def test_chat(pipe):
    seen = []
    p = Pipeline(pipe.spark, pipe.store.root, scripted({"Make the last": lambda u: seen.append(u) or '{"rewritten_question": "Who works at Haifa Clinic Group?"}', "Read the question": '{"names": ["Haifa Clinic Group"]}', "You answer": "plain", "Be kind": "kind"}))
    turns = [("user", "x" * 400), ("assistant", "Haifa Clinic Group is one."), ("system", "Be kind.")]
    a = p.chat(turns, "Who works there?")
    assert a.text == "kind" and "haifa clinic group" in a.entities and "x" * 300 + "..." in seen[0] and "Be kind" not in seen[0]
    assert p.chat(turns[:2], "Who works there?").text == "plain"
    assert pipe.chat([("user", "Tell me of Haifa Clinic Group")], "Who works there?").entities


def test_replies():
    assert prompts.names_of('x {"names": ["O\'Brien", "X", ""]} y') == ["O'Brien", "X"]
    assert prompts.names_of("none") == [] and prompts.names_of(None) == []
    assert prompts.statement_of('{"cypher": "MATCH (n) RETURN \\"a\\""}') == 'MATCH (n) RETURN "a"'
    assert prompts.statement_of("```cypher\nMATCH (n) RETURN n\n```") == "MATCH (n) RETURN n"
    assert prompts.statement_of("Sure: match (n) return n") == "match (n) return n" and prompts.statement_of("no") == ""
    assert prompts.harmless("a </context> b </ Context > c") == "a &lt;/context&gt; b &lt;/context&gt; c"
    assert prompts.answer_of('{"answer": "yes"}') == "yes" and prompts.answer_of("yes") == "yes"


def test_telemetry():
    t = Telemetry()
    q, slow = t.subscribe(), t.subscribe(1)
    with t.phase("one"):
        pass
    with pytest.raises(ValueError):
        with t.phase("two"):
            raise ValueError("bad")
    t.skip("three")
    t.count(nodes=1)
    t.complete()
    kinds = []
    while not q.empty():
        kinds.append(q.get()["event"])
    assert kinds == ["phase_start", "phase_end", "phase_start", "failed", "phase_skip", "counts_update", "complete"] and slow.qsize() == 1


def test_contextual_chunks(spark, tmp_path):
    p = Pipeline(spark, str(tmp_path / "c"), scripted({"In one or two": "about clinics"}), Config(strategy="contextual"))
    docs = spark.createDataFrame([("d", "Some text.")], "doc_id string, content string")
    assert p.chunked(docs).first()["text"] == "Context: about clinics\n\nSome text."


def test_http(pipe):
    s = serve(pipe, 0)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    at = f"http://127.0.0.1:{s.server_address[1]}"

    def call(method, path, body=None):
        try:
            with urlopen(Request(at + path, json.dumps(body).encode() if body is not None else None, method=method), timeout=120) as r:
                return r.status, json.loads(r.read())
        except HTTPError as e:
            return e.code, json.loads(e.read())

    try:
        assert call("GET", "/api/stats")[1]["nodes"] >= 4
        assert call("GET", "/api/settings")[1]["strategy"] == "recursive"
        g = call("GET", "/api/graph?node=dana%20levi")[1]
        assert {"dana levi", "haifa clinic group"} <= {n["name"] for n in g["nodes"]} and all("embedding" not in n for n in g["nodes"])
        assert call("POST", "/api/cypher", {"query": "MATCH (a)-[:BASED_AT]->(b) RETURN a.name AS a"})[1]["rows"] == [{"a": "dana levi"}]
        assert call("POST", "/api/cypher", {"query": "MATCH (n) DELETE n"})[0] == 400
        assert call("POST", "/api/query", {})[0] == 400 and call("GET", "/nothing")[0] == 404
        assert "haifa clinic group" in call("POST", "/api/query?human=false", {"question": "Who works at Haifa Clinic Group?"})[1]["entities"]
    finally:
        s.shutdown()


def test_command_line(pipe, capsys, tmp_path):
    run = lambda *a: cli.main(list(a), lambda root, config: pipe)
    run("stats")
    run("cypher", "MATCH (a)-[:BASED_AT]->(b) RETURN a.name AS a")
    run("query", "Who works at Haifa Clinic Group?")
    out = capsys.readouterr().out
    assert '"nodes"' in out and '{"a":"dana levi"}' in out and "haifa clinic group" in out
    said = []
    cli.conversation(pipe, ["Who works at Haifa Clinic Group?", "clear", ""], said.append)
    assert len(said) == 1
    with pytest.raises(SystemExit):
        run("nothing")
    assert len(cli.COMMANDS) == 11 and RuleProvider().complete(prompts.SAME, "") == "NO"


def test_intermediate_tables_go(spark, tmp_path):
    import os

    from kgspark import lineage

    folder = lineage.shared_dir(spark).removeprefix("file://")
    before = set(os.listdir(folder))
    p = Pipeline(spark, str(tmp_path / "t"))
    p.ingest_text(TEXT, "one")
    p.query("Who works at Haifa Clinic Group?")
    p.finalize()
    assert set(os.listdir(folder)) == before


def test_single_rows_and_schema(spark, pipe, tmp_path):
    p = Pipeline(spark, str(tmp_path / "one"))
    with pytest.raises(ValueError):
        p.create_edge("a", "R", "b")
    p.ingest_text(TEXT, "one")
    old = p.store.read("edges").where("rel = 'VISITS'").first()
    p.create_entity(" New Place ", "location")
    p.create_edge("Omar Nasser", "VISITS", "Cedar Medical Group", 2.0, ["c9"], "said again")
    p.create_edge("omar nasser", "NEAR", "new place")
    v = p.store.current()
    assert p.create_edge("x", "R", "X ") == v
    e = {(r["rel"]): r for r in p.store.read("edges").where("src = 'omar nasser'").collect()}
    r = e["VISITS"]
    assert r["weight"] == pytest.approx(old["weight"] + 2) and set(r["chunk_ids"]) == {*old["chunk_ids"], "c9"} and r["evidence_text"].endswith("\n---\nsaid again") and r["embedding"] == old["embedding"]
    assert e["NEAR"]["dst"] == "new place" and p.store.read("entities").where("name = 'new place'").first()["type"] == "location"
    p.finalize()
    assert p.store.read("entities").where("embedding is null").count() == 0 and p.store.read("edges").where("embedding is null").count() == 0
    from kgspark.operators import governance

    types = governance.base_types(spark, [("person", "someone")])
    rel = p.config.ontology.signatures(spark)
    p.save_schema(types, rel)
    t, r = p.load_schema()
    assert t.count() == 1 and r.count() == rel.count() and pipe.load_schema() == (None, None)
