"""Schema governance of relations and types, and the cleaning of triples."""

import json

from pyspark.sql import functions as F

from kgspark.operators import curation, governance
from kgspark.plans import prompts


def test_check_relations(spark):
    known = spark.createDataFrame([("MANAGES",), ("OWNED_BY",), ("WORKS_WITH_TEAM",), ("PUSHES",)], "name string")
    al = spark.createDataFrame([("RUNS", "MANAGES", False), ("LED_BY", "MANAGES", True)], "alias string, canonical string, flip boolean")
    p = spark.createDataFrame([(x,) for x in ("manages ", "RUNS", "LED_BY", "MANAGE_BY", "PUSH_BY", "OWNED", "TEAM_WORKS_WITH", "A_B_C_D", "NEW_ONE", " ", None)], "name string")
    got = {r["name"]: (r["decision"], r["match"], r["confidence"]) for r in governance.check_relations(p, known, al).collect()}
    assert got == {
        "MANAGES": ("synonym", "MANAGES", 1.0), "RUNS": ("synonym", "MANAGES", 1.0), "LED_BY": ("inverse", "MANAGES", 1.0), "MANAGE_BY": ("inverse", "MANAGES", 0.8), "PUSH_BY": ("inverse", "PUSHES", 0.8),
        "OWNED": ("inverse", "OWNED_BY", 0.8), "TEAM_WORKS_WITH": ("synonym", "WORKS_WITH_TEAM", 0.8), "A_B_C_D": ("too_vague", None, 0.7), "NEW_ONE": ("accept_new", None, 0.5), "": ("invalid", None, 1.0),
    }
    assert governance.check_relations(p.limit(0), known, al).count() == 0


def test_normalised_and_evolved(spark):
    rel = spark.createDataFrame([("MANAGES", ["person"], ["organization"])], "name string, src_types array<string>, dst_types array<string>")
    al = spark.createDataFrame([("LED_BY", "MANAGES", True)], "alias string, canonical string, flip boolean")
    e = spark.createDataFrame([("a", "led_by", "b"), ("a", "manages", "b"), ("a", "other", "b")], "src string, rel string, dst string")
    assert sorted(map(tuple, governance.normalised(e, rel, al).collect())) == [("a", "MANAGES", "b"), ("a", "OTHER", "b"), ("b", "MANAGES", "a")]
    t = spark.createDataFrame([("MANAGES", "robot", "organization"), ("LED_BY", "Person", ""), ("GREETS", "person", "event"), ("GREETS", "person", "place"), ("GREETS", "dog", "event"), ("A_B_C_D", "x", "y")], "rel string, src_type string, dst_type string")
    grown, cand = governance.evolved_relations(t, rel, al)
    assert grown.first()["src_types"] == ["person", "robot"]
    assert [tuple(r) for r in cand.select("name", "decision", "src_types", "dst_types").collect()] == [("GREETS", "accept_new", ["person", "dog"], ["event", "place"])]


def test_types_and_approval(spark):
    types = governance.base_types(spark, [("organization", "o"), ("concept", "c")])
    al = spark.createDataFrame([("org", "organization")], "alias string, canonical string")
    d = spark.createDataFrame([("Clinic", "new", "", ["organization"], "seen"), ("firm", "synonym", "organization", None, ""), ("ward", "subtype", "clinic", None, ""), ("idea", "new", "", [], "")], "name string, decision string, canonical string, bases array<string>, evidence string")
    t, a = governance.approved_types(types, al, d)
    assert {r["name"]: r["parent"] for r in t.collect()} == {"organization": "", "concept": "", "clinic": "organization", "ward": "clinic", "idea": "concept"}
    assert {r["alias"] for r in a.collect()} == {"org", "firm"}
    assert {r["type"]: r["base"] for r in governance.base_of(t.select(F.col("name").alias("type"), "parent"), ["organization", "concept"]).collect()}["ward"] == "organization"
    sure, cand = governance.evolved_types(spark.createDataFrame([("Organization",), ("org",), ("health clinic",), ("thing",)], "type string"), t.select("name"), a)
    assert sure.count() == 0 and {r["name"] for r in cand.collect()} == {"health clinic"}
    rel = spark.createDataFrame([("R", "", False, ["a"], ["b"])], "name string, description string, symmetric boolean, src_types array<string>, dst_types array<string>")
    new = spark.createDataFrame([("R", "said", True, ["c", "a"], []), ("S", "s", False, [], ["x"])], rel.schema)
    assert sorted(map(tuple, governance.merged_definitions(rel, new).collect())) == [("R", "said", True, ["a", "c"], ["b"]), ("S", "s", False, [], ["x"])]
    r2, a2 = governance.approved_relations(rel.select("name", "src_types", "dst_types", "symmetric"), spark.createDataFrame([], "alias string, canonical string, flip boolean"), spark.createDataFrame([("t", "new", "", ["p"], ["q"], None), ("u_by", "inverse", "R", None, None, None)], "name string, decision string, canonical string, src_types array<string>, dst_types array<string>, symmetric boolean"))
    assert {r["name"] for r in r2.collect()} == {"R", "T"} and [tuple(r) for r in a2.collect()] == [("U_BY", "R", True)]


def test_governed(spark):
    class Governor:
        def complete(self, system, user):
            assert system == prompts.GOVERN
            names = user.split("Proposed:\n")[1].split("\n")
            return json.dumps({"decisions": [{"raw": n, "decision": "reject" if n == "junk" else "map", "canonical": n.upper()} for n in names if n != "silent"]})

        def embed(self, texts):
            return [[0.0]] * len(texts)

    p = spark.createDataFrame([("junk",), ("a",), ("silent",), ("a",)], "name string")
    d = governance.governed(p, ["A"], Governor())
    m = governance.mapping_of(d)
    assert sorted(map(tuple, m.collect())) == [("a", "A"), ("junk", "__REJECTED__")]
    v = spark.createDataFrame([("a",), ("junk",), ("z",)], "rel string")
    assert sorted(r[0] for r in governance.apply_normalisation(v, "rel", m).collect()) == ["A", "z"]


def test_noise(spark):
    names = ["he", "x", "", "Active", "hiring strategy", "daily report", "the new medical team", "the new haifa team", "haifa clinic", "أنا"]
    df = spark.createDataFrame([(n,) for n in names], "name string")
    assert [r[0] for r in curation.without_noise(df, "name").collect()] == ["the new haifa team", "haifa clinic"]


def test_cleaning(spark):
    cols = "src string, rel string, dst string, src_type string, dst_type string, evidence_text string"
    rel = spark.createDataFrame([("BASED_AT", ["person"], ["organization"]), ("OFFERS", ["organization"], ["service"])], "rel string, src_types array<string>, dst_types array<string>")
    par = spark.createDataFrame([("clinic", ["organization"])], "type string, bases array<string>")
    types = spark.createDataFrame([("c", "clinic")], "name string, type string")
    t = spark.createDataFrame([("c", "based at", "p", "", "person", "e"), ("p", "BASED_AT", "p", "", "", ""), ("p", "OFFERS", "q", "person", "person", ""), ("p", "x-y", "q", "", "", "")], cols)
    got = sorted((r["src"], r["rel"], r["dst"], r["src_type"]) for r in curation.validated(t, types, rel, par).collect())
    assert got == [("p", "BASED_AT", "c", "person"), ("p", "X_Y", "q", "")]
    kept = curation.preserved(t, t.limit(0), types, rel, par).collect()
    assert [(r["src"], r["rel"], r["dst"]) for r in kept] == []  # 'BASED AT' is no structural relation as it is written
    raw = spark.createDataFrame([("c", "based_at", "p", "", "person", "said"), ("C", "BASED_AT", "P", "", "person", "said"), ("c", "BASED_AT", "r", "", "person", "")], cols)
    assert [(r["src"].lower(), r["rel"], r["dst"].lower()) for r in curation.preserved(raw.limit(1), t.limit(0), types, rel, par).collect()] == [("p", "BASED_AT", "c")]
    s = spark.createDataFrame([("a", "OFFERS", "s"), ("a", "DOES_NOT_OFFER", "s"), ("b", "OFFERS", "s")], "src string, rel string, dst string")
    assert sorted(map(tuple, curation.without_denied_services(s).collect())) == [("a", "DOES_NOT_OFFER", "s"), ("b", "OFFERS", "s")]
    review = spark.createDataFrame([("a", "OFFERS", "s", "remove", None), ("b", "OFFERS", "s", "flip", None), ("b", "OFFERS", "s", "rename", "SOLD_BY")], "src string, rel string, dst string, action string, new_rel string")
    assert sorted(map(tuple, curation.reviewed(s, review).collect())) == [("a", "DOES_NOT_OFFER", "s"), ("s", "SOLD_BY", "b")]
    change = spark.createDataFrame([("b", "OFFERS", "s", "", "SELLS", None)], "src string, rel string, dst string, new_src string, new_rel string, new_dst string")
    assert sorted(map(tuple, curation.corrected(s, review.where("action = 'remove'"), change).collect())) == [("a", "DOES_NOT_OFFER", "s"), ("b", "SELLS", "s")]
    assert sorted(r["src"] for r in curation.standardised(s, spark.createDataFrame([("a", "alpha")], "name string, canonical string")).collect()) == ["alpha", "alpha", "b"]
