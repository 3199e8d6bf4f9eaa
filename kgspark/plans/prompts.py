"""What providers are asked, and how their answers are read. The wording is free; the JSON keys are the interface."""

from __future__ import annotations

import json
import re

from kgspark.ontology import DEFAULT, Ontology

NAMES = 'Read the question and list every name and special term in it. Reply with JSON: {"names": ["...", "..."]}, with an empty list if there are none.'
ANSWER = "You answer from the context alone. Be brief and exact, name things as the context does, say so if the context does not tell, and reply in the question's language."
REWRITE = 'Make the last question understandable without the conversation before it: put names in the place of references, and change nothing else. Reply with JSON: {"rewritten_question": "..."}.'
REFERENCES = 'Rewrite the text so that every pronoun and every phrase like "the company" is the name it stands for. Leave what is unclear, add nothing. Reply with JSON: {"resolved_text": "..."}.'
SAME = "Do the two entities described denote one thing in the world? Reply YES or NO."
CONTEXT = "In one or two sentences, say what part of the document the passage is and what it is about. Reply with these sentences only."
GOVERN = 'For each name proposed for a schema, decide whether it is new, means a known one, or is to be rejected. Reply with JSON: {"decisions": [{"raw": "...", "decision": "new|map|reject", "canonical": "..."}]}.'
DEFINE = 'Describe each type or relation in a sentence. Reply with JSON: {"definitions": [{"name": "...", "description": "...", "aliases": ["..."]}]}.'


def entities(ontology: Ontology = DEFAULT) -> str:
    """The first pass of an extraction: who and what is named."""
    return (
        "Find the entities that the text names. Reply with JSON: "
        '{"entities": [{"mention", "canonical_candidate", "base_type_candidates": [{"type", "score"}], "domain_type_candidates", "functional_roles", "status", "aliases": [{"text", "lang"}], "evidence"}]}.\n'
        + ontology.described().split("\nRelations:")[0]
    )


def verified(ontology: Ontology = DEFAULT) -> str:
    """The second pass: which of the entities found are right, and how they are related."""
    return (
        "Check the entities found in the text, correct or drop them, and add the relationships that the text states. Reply with JSON: "
        '{"entities": [...as given...], "relationships": [{"from_mention", "relation_id", "to_mention", "evidence_text", "evidence_language", "confidence", "status", "condition", "temporal"}]}.\n' + ontology.described()
    )


def statement(ontology: Ontology = DEFAULT) -> str:
    """A question that wants a count or a ranking, as a graph statement."""
    return (
        'Translate the question into one Cypher statement that only reads. Names are in lower case; nodes have name, type, status; relations are their own types. Put names first. Reply with JSON: {"cypher": "..."}.\n'
        + ontology.described().split("Relations:", 1)[1]
    )


def names_of(reply: str | None) -> list[str]:
    """The names of a reply: what stands in the list of "names", wherever that is; outer double quotes go, others stay."""
    m = re.search(r'"names"\s*:\s*\[([^\]]*)\]', reply or "", re.S)
    out = []
    for raw in m.group(1).split(",") if m else ():
        raw = raw.strip()
        if len(raw.encode()) > 1 and (name := raw.strip('"').strip()):
            out.append(name)
    return out


def statement_of(reply: str | None) -> str:
    """The statement of a reply: JSON first, then a fenced block, then what begins with MATCH or CALL; '' for none."""
    reply = reply or ""
    m = re.search(r'\{[^{}]*"cypher"\s*:\s*("(?:\\.|[^"\\])*")', reply, re.S)
    if m:
        try:
            return json.loads(m.group(1)).strip()
        except ValueError:
            pass
    m = re.search(r"```(?:cypher|json)?\s*(.*?)```", reply, re.S)
    if m:
        return m.group(1).strip()
    m = re.search(r"\b(?:MATCH|CALL)\s+.+", reply, re.S | re.I)
    return m.group(0).strip() if m else ""


def field_of(reply: str | None, key: str) -> str | None:
    """A string field of a JSON reply; None if the reply is no such JSON."""
    try:
        value = json.loads(reply or "")
    except ValueError:
        return None
    return value.get(key) if isinstance(value, dict) and isinstance(value.get(key), str) else None


def answer_of(reply: str) -> str:
    """The answer, out of its JSON if it comes in some."""
    return field_of(reply, "answer") or reply


def harmless(context: str) -> str:
    """The context without anything that would end it early."""
    return re.sub(r"<\s*/\s*context\s*>", "&lt;/context&gt;", context, flags=re.I)


def asked(question: str, context: str) -> str:
    return f"Question: {question}\n\nKnowledge graph context:\n<context>\n{harmless(context) if context.strip() else '(no supporting evidence)'}\n</context>"


def history_lines(history: list[tuple[str, str]], most: int = 6, size: int = 300) -> list[str]:
    """'role: text' of the last turns, system messages left out, each of at most ``size`` bytes."""
    out = []
    for role, text in history[-most:]:
        if role != "system":
            data = text.encode()
            out.append(f"{role}: {text if len(data) <= size else data[:size].decode(errors='ignore') + '...'}")
    return out


def messages(system: str, history: list[tuple[str, str]], question: str, context: str) -> list[dict[str, str]]:
    """The messages of a chat: the system's, the turns without others of its kind, the question with its context."""
    return [{"role": "system", "content": system or ANSWER}, *({"role": r, "content": t} for r, t in history if r != "system"), {"role": "user", "content": asked(question, context)}]


def described(name: str, types: list[str], domain: list[str], roles: list[str], status: str, evidence: str) -> str:
    """A short description of an entity, for the question whether two are one."""
    parts = [f"{k}: {v}" for k, v in (("domain", ", ".join(domain)), ("roles", ", ".join(roles)), ("status", status if status != "unknown" else ""), ("evidence", evidence if len(evidence) <= 200 else evidence[:200] + "...")) if v]
    return f"{name}\nTypes: {', '.join(types)}\nContext: {'; '.join(parts) or '(no additional context)'}"
