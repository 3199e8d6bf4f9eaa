"""Extraction: passages to provider answers (JSON) to candidate entities and edges, with coreference before it.

Strategies: ``single`` (one call for entities and relationships), ``llm`` (entities first, then verified with
relationships), ``hybrid`` (names recognised without a model, then verified with relationships by one call).
Calls run in the tasks, batch by batch; a passage whose call fails keeps what the earlier step found.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kgspark.functions.text import name_key
from kgspark.lineage import cut
from kgspark.ontology import DEFAULT, Ontology

SYSTEM = "Extract the entities and relationships of the text as JSON."
STRATEGIES = ("single", "llm", "hybrid")
SCORED = "array<struct<type:string,score:double>>"
ANSWER = (
    f"struct<entities:array<struct<mention:string,canonical_candidate:string,base_type_candidates:{SCORED},domain_type_candidates:{SCORED},functional_roles:array<string>,status:string,"
    "aliases:array<struct<text:string,lang:string>>,evidence:string>>,relationships:array<struct<from_mention:string,relation_id:string,to_mention:string,evidence_text:string,"
    "evidence_language:string,confidence:double,status:string,condition:string,temporal:map<string,string>>>>"
)
# Words that may refer to something named before.
REFERRING = (" he ", " she ", " it ", " they ", " him ", " her ", " them ", " his ", " its ", " their ", " we ", " our ", " the company", " the branch", " the organization", " the service")
FIT_KNOWN, FIT_UNKNOWN, NER_SCORE = 1.0, 0.3, 0.8


def needs_coreference(text: Column) -> Column:
    t, out = F.lower(text), F.lit(False)
    for w in REFERRING:
        out = out | t.contains(w)
    return out


def parsed(answers: DataFrame, column: str = "response") -> DataFrame:
    """With ``answer``: the JSON, also from within a fenced block; null if there is none."""
    body = F.regexp_extract(F.col(column), r"(?s)(\{.*\})", 1)
    return answers.withColumn("answer", F.from_json(F.nullif(body, F.lit("")), ANSWER))


def entities_of(answers: DataFrame, ontology: Ontology = DEFAULT) -> DataFrame:
    """(seq, mention, canonical, base_types, domain_types, functional_roles, status, aliases, evidence, chunk_id) of answers (doc_seq, chunk_id, answer)."""
    x = answers.where("answer is not null").select("doc_seq", "chunk_id", F.posexplode("answer.entities").alias("i", "e"))
    m = name_key(F.col("e.mention"))
    c = F.coalesce(F.nullif(name_key(F.col("e.canonical_candidate")), F.lit("")), m)
    inside = lambda col, allowed: F.filter(F.coalesce(col, F.array().cast("array<string>")), lambda r: r.isin(*allowed))
    empty = F.array().cast(SCORED)
    base = F.filter(F.coalesce("e.base_type_candidates", empty), lambda t: t.type.isin(*ontology.base_types))
    status = F.lower(F.coalesce("e.status", F.lit("")))
    evidence = F.when(F.length("e.evidence") > 0, F.array(F.struct(F.col("e.evidence").alias("text"), F.lit("und").alias("language"), F.col("chunk_id").alias("chunk_id"), F.lit("").alias("source")))).otherwise(
        F.array().cast("array<struct<text:string,language:string,chunk_id:string,source:string>>")
    )
    return x.where(m != "").select(
        (F.col("doc_seq") * 10_000 + F.col("i")).alias("seq"),
        m.alias("mention"),
        c.alias("canonical"),
        base.alias("base_types"),
        F.coalesce("e.domain_type_candidates", empty).alias("domain_types"),
        inside(F.col("e.functional_roles"), ontology.roles).alias("functional_roles"),
        F.when(status.isin(*ontology.entity_statuses), status).otherwise("").alias("status"),
        F.coalesce("e.aliases", F.array().cast("array<struct<text:string,lang:string>>")).alias("aliases"),
        evidence.alias("evidence"),
        "chunk_id",
    )


def edges_of(answers: DataFrame, ontology: Ontology = DEFAULT) -> DataFrame:
    """Candidate edges of the answers: ends lower-cased, relations resolved, rejected ones dropped, inverses exchanged."""
    x = answers.where("answer is not null").select("doc_seq", "chunk_id", F.posexplode("answer.relationships").alias("i", "e"))
    x = x.withColumn("r", ontology.resolve(F.col("e.relation_id"))).where("r.relation != ''")
    a, b = name_key(F.col("e.from_mention")), name_key(F.col("e.to_mention"))
    conf, text = F.coalesce("e.confidence", F.lit(0.0)), lambda c: F.coalesce(F.col(c), F.lit(""))
    out = x.select(
        (F.col("doc_seq") * 10_000 + F.col("i")).alias("seq"),
        F.concat(F.lit("e_"), "chunk_id", F.lit("_"), "i").alias("id"),
        F.when(F.col("r.flip"), b).otherwise(a).alias("src"),
        F.upper("e.relation_id").alias("relation_raw"),
        F.col("r.relation").alias("rel"),
        F.when(F.col("r.flip"), a).otherwise(b).alias("dst"),
        text("e.evidence_text").alias("evidence_text"),
        "chunk_id",
        conf.alias("evidence_score"),
        F.when(F.col("r.known"), FIT_KNOWN).otherwise(FIT_UNKNOWN).alias("schema_fit_score"),
        conf.alias("confidence"),
        F.lit("").alias("alternative_group"),
        text("e.status").alias("status"),
        text("e.condition").alias("condition"),
        F.coalesce("e.temporal", F.create_map().cast("map<string,string>")).alias("temporal"),
    )
    return out.where("src != '' and dst != ''")


def resolved_references(chunks: DataFrame, provider, text: str = "text") -> DataFrame:
    """``chunks`` with references replaced by names in those passages that may hold some; where the provider fails or says nothing, the text stays."""
    from kgspark.plans import prompts
    from kgspark.plans.providers import completed

    x = chunks.withColumn("_ask", F.concat(F.lit("Text:\n"), F.col(text)))
    some = completed(x.where(needs_coreference(F.col(text))), provider, prompts.REFERENCES, "_ask", "_said", "_why")
    reply = F.btrim(F.coalesce("_said", F.lit("")), F.lit(" \t\r\n"))
    whole = F.get_json_object(F.col("_said"), "$.resolved_text")
    # a reply that is no JSON is the text itself
    new = F.coalesce(F.nullif(whole, F.lit("")), F.when(~reply.startswith("{"), F.nullif(reply, F.lit(""))), F.col(text))
    return some.withColumn(text, new).select(*chunks.columns).unionByName(x.where(~F.coalesce(needs_coreference(F.col(text)), F.lit(False))).select(*chunks.columns))


def span_summary(text: str, found: list[tuple[str, int, int, str]]) -> str:
    """Recognised names as the JSON that is to be verified, each spelling once."""
    from kgspark.operators.ner import LABEL_TYPES

    seen, out = set(), []
    for t, a, b, label in found:
        if t.strip().lower() not in seen and t.strip():
            seen.add(t.strip().lower())
            out.append({"mention": t.strip(), "base_type": LABEL_TYPES.get(label.upper(), ""), "ner_label": label, "start_char": a, "end_char": b})
    return json.dumps(out, ensure_ascii=False)


def answers_of_spans(found: list[tuple[str, int, int, str]]) -> str:
    """Recognised names as an extractor's answer, where no model gives one: each with its type at ``NER_SCORE``."""
    from kgspark.operators.ner import LABEL_TYPES

    seen, out = set(), []
    for t, _, _, label in found:
        name = t.strip().lower()
        if name and name not in seen:
            seen.add(name)
            kind = LABEL_TYPES.get(label.upper(), "")
            out.append({"mention": name, "canonical_candidate": name, "base_type_candidates": [{"type": kind, "score": NER_SCORE}] if kind else []})
    return json.dumps({"entities": out, "relationships": []}, ensure_ascii=False)


def extracted(chunks: DataFrame, provider, strategy: str = "single", ontology: Ontology = DEFAULT, recogniser=None, text: str = "text") -> DataFrame:
    """``chunks`` with ``answer``, by a strategy; ``recogniser`` (text -> spans) stands for the built-in recognition of names."""
    from kgspark.operators import ner
    from kgspark.plans import prompts
    from kgspark.plans.providers import completed

    if strategy == "single":
        return parsed(completed(chunks, provider, SYSTEM, text)).drop("response", "error")
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown extraction {strategy}; known: {', '.join(STRATEGIES)}")
    ask = lambda of: F.concat(F.lit("Text:\n"), F.col(text), F.lit("\n\nEntities:\n"), F.coalesce(of, F.lit("[]")))
    names = F.coalesce(F.get_json_object("_first", "$.entities"), F.lit("[]"))
    two = lambda df: completed(completed(df, provider, prompts.entities(ontology), text, "_first", "_why1").withColumn("_ask", ask(names)), provider, prompts.verified(ontology), "_ask", "_second", "_why2")
    rest = lambda df: parsed(df, "_said").select(*chunks.columns, "answer")
    some = F.size("answer.entities") > 0
    better = lambda df: parsed(df, "_second").withColumn("_said", F.when(F.coalesce(some, F.lit(False)), F.col("_second")))
    if strategy == "llm":
        x = better(two(chunks)).drop("answer")
        return rest(x.withColumn("_said", F.coalesce("_said", "_first")))
    find = recogniser or ner.spans

    @F.pandas_udf("struct<summary:string,answer:string>")
    def named(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in batches:
            rows = []
            for t in s:
                try:
                    found = find(t or "")
                except Exception:  # without recognition the passage goes to the model
                    found = []
                rows.append((span_summary(t, found), answers_of_spans(found)) if found else (None, None))
            yield pd.DataFrame(rows, columns=["summary", "answer"])

    x = cut(chunks.withColumn("_n", named(F.col(text))).select(*chunks.columns, F.col("_n.summary").alias("_summary"), F.col("_n.answer").alias("_spans")))
    one = completed(x.where("_summary is not null").withColumn("_ask", ask(F.col("_summary"))), provider, prompts.verified(ontology), "_ask", "_second", "_why")
    # a reply without entities keeps its relationships
    one = parsed(one, "_second").withColumn("_none", F.coalesce(F.size("answer.entities") <= 0, F.lit(True)))
    kept = F.from_json("_spans", ANSWER)
    both = F.when(F.col("_none"), F.struct(kept.entities.alias("entities"), F.coalesce(F.col("answer.relationships"), kept.relationships).alias("relationships"))).otherwise(F.col("answer"))
    none = better(two(x.where("_summary is null"))).drop("answer").withColumn("_said", F.coalesce("_said", "_first"))
    return one.withColumn("answer", both.cast(ANSWER)).select(*chunks.columns, "answer").unionByName(rest(none))


def entities_from_spans(spans: DataFrame) -> DataFrame:
    """Candidate entities of recognised names (chunk_id, span, label), where there is no answer of a model."""
    from kgspark.operators.ner import base_type

    t = base_type(F.col("label"))
    return spans.select("chunk_id", name_key(F.col("span")).alias("mention"), F.array(F.struct(F.when(t == "", "concept").otherwise(t).alias("type"), F.lit(NER_SCORE).alias("score"))).alias("base_types"))
