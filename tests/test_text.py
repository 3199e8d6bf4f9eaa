"""Predicates and normalisers against the cases of FIXTURES.md."""

import pytest
from pyspark.sql import functions as F

from kgspark.functions import text as tx
from kgspark.functions import vector
from kgspark.operators import rewrite, resolve


def each(spark, values, expr):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string").select("i", expr(F.col("v")).alias("r")).collect()
    return [r["r"] for r in sorted(rows)]


def test_question_type(spark):
    qs = ["Is it open?", "Are they in?", "Did he go?", "Who runs it?", "Where is it?", "When did it open?", "How many are there?", "How much is it?", "What is this?", "List all", "", None]
    assert each(spark, qs, tx.question_type) == ["yes_no"] * 3 + ["who", "where", "when", "number", "number", "", "", "", ""]


def test_enumeration(spark):
    yes = ["list all branches", "name every worker", "what is the complete list of services", "enumerate the partners", "all of the clinics in Haifa"]
    assert each(spark, [*yes, "who works at Akko"], tx.wants_all) == [True] * 5 + [False]


def test_analytical(spark):
    qs = ["which branch has the most staff", "how many branches", "top 5 services", "the highest fee", "who is dana", "the one called x", "what services are there"]
    assert each(spark, qs, tx.wants_analysis) == [True] * 4 + [False] * 3


def test_keywords_and_tokens(spark):
    assert each(spark, ["What is the role of Al-Amal, in Haifa?"], tx.keywords) == [["role", "amal", "haifa"]]
    assert each(spark, ["is there any one called yara ?", "the and for"], tx.tokens) == [["yara"], []]


def test_lookup(spark):
    assert each(spark, ["is there anyone named al-amal laboratory", "list all branches"], tx.looked_up_name) == [["amal", "laboratory"], []]


def test_raw_temporal(spark):
    yes = ["10:00", "13:00 every business day", "2024-11-06", "q4 2026", "monthly", "tuesday", "twice per month", "every monday", "3 business days", "tuesday and thursday", "wednesday mornings"]
    no = ["cedargate", "dr. smith", "al-amal laboratory", "primary care", "haifa central"]
    assert each(spark, yes + no, tx.is_raw_temporal) == [True] * len(yes) + [False] * len(no)


def test_labels(spark):
    assert each(spark, ["medical courier", " x ", ""], tx.pascal_label) == ["MedicalCourier", "X", ""]
    assert each(spark, ["works at", "--", "A_b c"], tx.relation_label) == ["WORKS_AT", "RELATED", "A_B_C"]


def test_condition_phrase(spark):
    qs = ["It opens if the courier is late, then waits.", "if so. When the main site is closed; we go.", "Nothing here.", ""]
    assert each(spark, qs, rewrite.condition_phrase) == ["if the courier is late", "When the main site is closed", "", ""]


def test_negation_and_conditions(spark):
    rows = [
        (1, "HANDLES_BILLING_FOR", "It does not handle Haifa Central claims."),
        (2, "HANDLES_BILLING_FOR", "BalanceCare handles Tel Aviv billing."),
        (3, "OFFERS", "Branch A does not handle dermatology services."),
        (4, "PROCESSES_TESTS_FOR", "Lab B processes tests during Al-Amal downtime."),
        (5, "INVOLVES", "It involves equipment downtime today."),
        (6, "TRANSPORTS_SAMPLES_FOR", "If Lab A cannot process in time, B does."),
        (7, "OFFERS", "Org A offers pediatrics services."),
    ]
    df = spark.createDataFrame([(i, r, e, "", "") for i, r, e in rows], "seq int, rel string, evidence_text string, status string, condition string")
    neg = {r[0]: r[1] for r in df.select("seq", rewrite.negate(F.col("rel"), F.col("evidence_text"))).collect()}
    assert [neg[1], neg[2], neg[3]] == ["DOES_NOT_HANDLE_BILLING_FOR", "HANDLES_BILLING_FOR", "DOES_NOT_OFFER"]
    got = {r["seq"]: (r["status"], r["condition"]) for r in rewrite.annotate_conditions(df).collect()}
    assert got[4][0] == "backup" and got[4][1] == "during Al-Amal downtime"
    assert got[5][0] == "conditional" and got[6][0] == "conditional" and got[7] == ("", "")


def test_temporal(spark):
    df = spark.createDataFrame([("The hub opened on 2024-05-19.", ""), ("valid through December 2026.", ""), ("It is closed.", ""), ("will open in 2027", "planned")], "t string, s string")
    rows = [r[0] for r in df.select(rewrite.temporal_facts(F.col("t"), F.col("s"), F.lit("HAS_BRANCH"))).collect()]
    assert rows[0] == {"opened_on": "2024-05-19"} and rows[1] == {"valid_through": "December 2026"} and rows[2] == {} and rows[3]["expected_opening"] == "2027"


@pytest.mark.parametrize("a,b,want", [([1.0, 0.0], [1.0, 0.0], 1.0), ([1.0, 0.0], [0.0, 1.0], 0.0), ([1.0, 1.0], [1.0, 0.0], 0.5**0.5), (None, [1.0], 0.0), ([0.0, 0.0], [1.0, 0.0], 0.0), ([1.0, 5.0], [1.0], 1.0)])
def test_cosine(spark, a, b, want):
    df = spark.createDataFrame([(a, b)], "a array<float>, b array<float>")
    assert abs(df.select(vector.cosine(F.col("a"), F.col("b"))).first()[0] - want) < 1e-6


def test_alias_safety(spark):
    df = spark.createDataFrame(
        [("remote nutrition counseling", "nutrition counseling"), ("remote dietitian counseling", "remote nutrition counseling"), ("qcm", "quickcourier medical"), ("corporate blood panels", "blood panels"), ("travel vaccination consultations", "vaccinations")],
        "a string, c string",
    )
    assert [r[0] for r in df.select(resolve.alias_is_safe(F.col("a"), F.col("c"))).collect()] == [False, True, True, False, False]
