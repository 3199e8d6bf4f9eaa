"""Language-model providers: an interface, and deterministic ones that need no network."""

from __future__ import annotations

import hashlib
import json
import random
import re
import time
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Provider(Protocol):
    def complete(self, system: str, user: str) -> str: ...

    def embed(self, texts: list[str]) -> list[list[float]]: ...


class HashEmbedder:
    """Signed hashing of words into ``dim`` numbers, scaled to length one."""

    def __init__(self, dim: int = 64):
        self.dim = dim

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = np.zeros((len(texts), self.dim))
        for i, t in enumerate(texts):
            for w in re.findall(r"\w+", (t or "").lower()):
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "big")
                out[i, h % self.dim] += 1 if h >> 32 & 1 else -1
        n = np.linalg.norm(out, axis=1, keepdims=True)
        return (out / np.where(n == 0, 1, n)).tolist()

    def complete(self, system: str, user: str) -> str:
        raise NotImplementedError("an embedder completes nothing")


class RuleProvider(HashEmbedder):
    """Extracts the names of a text by rules, and relations from phrases between two of them; answers with the JSON an extractor gives."""

    # Phrases between two names and what they mean.
    PHRASES = (("is managed by", "MANAGED_BY"), ("manages", "MANAGES"), ("works at", "BASED_AT"), ("is part of", "PART_OF"), ("is located in", "LOCATED_IN"), ("partners with", "PARTNERS_WITH"), ("offers", "OFFERS"), ("visits", "VISITS"))

    def complete(self, system: str, user: str) -> str:
        from kgspark.operators.ner import LABEL_TYPES, spans
        from kgspark.plans import prompts

        body = user.removeprefix("Text:\n").split("\n\nEntities:\n")[0]
        if system == prompts.NAMES:
            return json.dumps({"names": [t for t, *_ in spans(user.removeprefix("Question: "))]})
        if system == prompts.ANSWER:  # the context is the answer: its lines, without a model's wording
            return json.dumps({"answer": user.split("<context>\n")[-1].split("\n</context>")[0]})
        if system == prompts.REFERENCES:
            return json.dumps({"resolved_text": body})
        if system == prompts.REWRITE:  # names of the last turns go with the question
            history, _, question = user.partition("\n\nFollow-up question: ")
            names = " ".join(dict.fromkeys(t for line in history.split("\n")[1:] for t, *_ in spans(line.partition(": ")[2])))
            return json.dumps({"rewritten_question": f"{question} {names}".strip()})
        if system == prompts.SAME:
            return "NO"
        if system == prompts.CONTEXT or system.startswith("Translate the question"):
            return ""
        user = body
        found = spans(user)
        entities = [{"mention": t, "canonical_candidate": t.lower(), "base_type_candidates": [{"type": LABEL_TYPES.get(x, "concept"), "score": 0.8}], "evidence": t} for t, _, _, x in found]
        data, rels = user.encode(), []
        every = spans(user, unique=False)
        for (a, _, e, _), (b, s, _, _) in zip(every, every[1:]):
            between = data[e:s].decode(errors="replace").lower()
            for phrase, rel in self.PHRASES:
                if phrase in between and "." not in between:
                    rels.append({"from_mention": a, "relation_id": rel, "to_mention": b, "evidence_text": f"{a}{data[e:s].decode(errors='replace')}{b}", "evidence_language": "und", "confidence": 0.8})
                    break
        return json.dumps({"entities": entities, "relationships": rels})


class NerService:
    """Recognises names by a service: POST {"text"} to ``url``, which replies with [{"text", "start", "end", "label"}]."""

    def __init__(self, url: str, timeout: float = 30.0):
        self.url, self.timeout = url, timeout

    def __call__(self, text: str) -> list[tuple[str, int, int, str]]:
        from urllib.request import Request, urlopen

        body = Request(self.url, json.dumps({"text": text}).encode(), {"Content-Type": "application/json"})
        with urlopen(body, timeout=self.timeout) as reply:
            found = json.loads(reply.read())
        found = found.get("entities", found.get("spans", [])) if isinstance(found, dict) else found
        return [(x["text"], int(x["start"]), int(x["end"]), str(x["label"])) for x in found]


class ReplayProvider(HashEmbedder):
    """Recorded answers by the hash of system and user text; a missing one raises KeyError."""

    def __init__(self, answers: dict[str, str], dim: int = 64):
        super().__init__(dim)
        self.answers = answers

    @staticmethod
    def key(system: str, user: str) -> str:
        return hashlib.sha256(f"{system}\u0001{user}".encode()).hexdigest()

    def complete(self, system: str, user: str) -> str:
        return self.answers[self.key(system, user)]


class Breaker:
    """Stops calling what keeps failing: opens after ``most`` failures, tries again after a growing pause."""

    def __init__(self, most: int = 5, first: float = 1.0, longest: float = 30.0, clock: Callable[[], float] = time.monotonic, jitter: float = 0.25):
        self.most, self.first, self.longest, self.clock, self.jitter = most, first, longest, clock, jitter
        self.failures, self.opened, self.until = 0, 0, 0.0

    def call(self, f: Callable, *args):
        if self.failures >= self.most and self.clock() < self.until:
            raise RuntimeError("the circuit is open")  # once the pause is over, one call tries again
        try:
            out = f(*args)
        except Exception:
            self.failures += 1
            if self.failures >= self.most:
                self.opened += 1
                # a quarter more or less, so that tasks don't try again all at once
                self.until = self.clock() + min(self.longest, self.first * 2 ** (self.opened - 1)) * (1 + self.jitter * (2 * random.random() - 1))
            raise
        self.failures = self.opened = 0
        return out


def retried(f: Callable, *args, tries: int = 3, pause: float = 1.0):
    for k in range(tries):
        try:
            return f(*args)
        except Exception:
            if k == tries - 1:
                raise
            time.sleep(pause * 2**k)


def completed(df: DataFrame, provider: Provider, system: str, user: str, out: str = "response", error: str = "error") -> DataFrame:
    """``df`` with the provider's answers; a row that fails has null and the error, the others go on."""
    names = [c for c in df.columns]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        breaker = Breaker()
        for pdf in batches:
            got, why = [], []
            for t in pdf[user]:
                try:
                    got.append(breaker.call(provider.complete, system, t or ""))
                    why.append(None)
                except Exception as e:
                    got.append(None)
                    why.append(f"{type(e).__name__}: {e}"[:200])
            yield pdf[names].assign(**{out: got, error: why})

    return df.mapInPandas(run, f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in df.schema)}, {out} string, {error} string")


def embedded(df: DataFrame, provider: Provider, text: str, out: str = "embedding") -> DataFrame:
    """``df`` with vectors for the rows that have none and have a text."""

    @F.pandas_udf("array<float>")
    def vec(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series(retried(provider.embed, s.tolist()), index=s.index)

    usable = F.length(text) > 0
    have: Column = F.col(out) if out in df.columns else F.lit(None).cast("array<float>")
    old = df.withColumn(out, have)
    need = old.where(F.col(out).isNull() & usable)
    return old.where(~(F.col(out).isNull() & F.coalesce(usable, F.lit(False)))).unionByName(need.withColumn(out, vec(F.col(text))).select(*old.columns))
