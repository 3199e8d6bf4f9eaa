"""Chunkers: documents to ordered chunks, one narrow pass without shuffle.

Strategies: ``recursive`` (first separator that occurs, greedy merge with overlap),
``sentence`` (whole sentences), ``structural`` (sections by heading) and ``contextual``
(another strategy's chunks with a prefix from a provider). A chunk's id is a hash of its
document, place and text, so the same input gives the same ids. An overlap of 0 or less
means none.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SIZE, OVERLAP = 1500, 150
# Separators in the order they are tried, and sentence ends.
SEPARATORS = ("\n\n", "\n", ". ", "? ", "! ", "؟ ", "。", "، ", "; ", ", ", "、", " ")
SENTENCE_END = re.compile(r"(?<=[.?!؟] )|(?<=。)|(?<=[.?!]\n)")
HEADING = re.compile(r"^(#{1,6}) ")


def tail(text: str, overlap: int) -> str:
    """The end of a chunk that the next one repeats: at a word's start if one is in its first half."""
    if overlap <= 0:
        return ""
    if len(text) <= overlap:
        return text
    end = text[-overlap:]
    cut = end.find(" ")
    # half of the bytes, as positions are counted in bytes here
    if cut > 0 and len(end[:cut].encode()) < len(end.encode()) // 2:
        return end[cut + 1 :]
    return end


def merge(parts: list[str], size: int, overlap: int, gap: int = 0) -> list[str]:
    """Greedy fill: a chunk ends before the part that would take it over ``size``."""
    out, now = [], ""
    for part in (p.strip() for p in parts):
        if not part:
            continue
        if now and len(now) + len(part) + gap > size:
            out.append(now.strip())
            now = tail(now.strip(), overlap)
        now = f"{now} {part}" if now else part
    return [c for c in [*out, now.strip()] if c]


def recursive(text: str, size: int = SIZE, overlap: int = OVERLAP) -> list[str]:
    text = text.strip()
    if len(text) <= size:
        return [text] if text else []
    sep = next((s for s in SEPARATORS if s in text), None)
    if sep is None:
        return merge([text[i : i + size] for i in range(0, len(text), size)], size, overlap)
    parts = text.split(sep)
    return merge([p + sep for p in parts[:-1]] + parts[-1:], size, overlap)


def sentences(text: str) -> list[str]:
    found = (s.strip() for para in text.split("\n\n") for s in SENTENCE_END.split(para.strip()))
    return [s for s in found if s]


def by_sentence(text: str, size: int = SIZE, overlap: int = OVERLAP) -> list[str]:
    return merge(sentences(text), size, overlap, gap=1)


def headings(text: str) -> list[tuple[str, int]]:
    """(heading, byte offset) of lines that begin with #."""
    out, at = [], 0
    for line in text.split("\n"):
        t = line.strip()
        if t.startswith("#") and t.lstrip("# "):
            out.append((t.lstrip("# "), at))
        at += len(line.encode()) + 1
    return out


def section_of(chunk: str, heads: list[tuple[str, int]], text: str) -> str:
    """The last heading at or before the place of the chunk's first 80 bytes."""
    if not heads:
        return ""
    at = text.encode().find(chunk.encode()[:80])
    if at < 0:
        return heads[0][0]
    return next((h for h, o in reversed(heads) if o <= at), "")


def sections(text: str) -> list[tuple[str, str, str]]:
    """(heading, parent heading, body) between headings of level 1 to 6."""
    out, stack, heading, parent, body = [], [""] * 7, "", "", []
    for line in text.split("\n"):
        m = HEADING.match(line.strip())
        if not m:
            body.append(line)
            continue
        if body or heading:
            out.append((heading, parent, "\n".join(body)))
        level = len(m[1])
        heading, body = line.strip().lstrip("# "), []
        stack[level:] = [heading] + [""] * (6 - level)
        parent = next((h for h in reversed(stack[1:level]) if h), "")
    if body or heading:
        out.append((heading, parent, "\n".join(body)))
    return out


def _flat(cut: Callable[[str, int, int], list[str]]) -> Callable[[str, int, int], Iterator[tuple[str, str, str]]]:
    def run(text: str, size: int, overlap: int) -> Iterator[tuple[str, str, str]]:
        heads = headings(text)
        for c in cut(text, size, overlap):
            yield c, section_of(c, heads, text), ""

    return run


def _structural(text: str, size: int, overlap: int) -> Iterator[tuple[str, str, str]]:
    for heading, parent, body in sections(text):
        for c in recursive(body, size, overlap):
            yield c, heading, parent


STRATEGIES: dict[str, Callable[[str, int, int], Iterator[tuple[str, str, str]]]] = {
    "recursive": _flat(recursive),
    "sentence": _flat(by_sentence),
    "structural": _structural,
}


def chunk(docs: DataFrame, strategy: str = "recursive", size: int = SIZE, overlap: int = OVERLAP, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(chunk_id, doc_id, chunk_index, text, section, parent_section); the text begins with its section if it has one."""
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy}; known: {', '.join(STRATEGIES)}, contextual")
    cut = STRATEGIES[strategy]
    x = docs.where(F.col(text).isNotNull()).select(F.col(key).alias("doc_id"), F.col(text).alias("t"))
    kind = x.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(k, i, c, s, p) for k, t in zip(pdf["doc_id"], pdf["t"]) for i, (c, s, p) in enumerate(cut(t, size, overlap))]
            yield pd.DataFrame(rows, columns=["doc_id", "chunk_index", "body", "section", "parent_section"])

    out = x.mapInPandas(run, f"doc_id {kind}, chunk_index int, body string, section string, parent_section string")
    titled = F.when(F.col("section") != "", F.concat(F.lit("Context: Section = "), "section", F.lit("\n\n"), "body")).otherwise(F.col("body"))
    ident = F.substring(F.sha2(F.concat_ws("\u0001", F.col("doc_id").cast("string"), "chunk_index", titled), 256), 1, 32)
    return out.select(ident.alias("chunk_id"), "doc_id", "chunk_index", titled.alias("text"), "section", "parent_section")


def contextual(docs: DataFrame, prefix: Callable[[DataFrame], DataFrame], base: str = "recursive", size: int = SIZE, overlap: int = OVERLAP, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Chunks of ``base``, each with 'Context: ...' from ``prefix``, which gets (chunk_id, doc, text) and adds a column context.

    Chunks for which there is no context stay as they are. A document is given by its first 3000 bytes, for the prompt only.
    """
    c = chunk(docs, base, size, overlap, key, text)
    whole = docs.select(F.col(key).alias("doc_id"), F.decode(F.substring(F.encode(text, "UTF-8"), 1, 3000), "UTF-8").alias("doc"))
    said = prefix(c.join(whole, "doc_id").select("chunk_id", "doc", "text")).select("chunk_id", "context")
    t = F.when(F.length("context") > 0, F.concat(F.lit("Context: "), "context", F.lit("\n\n"), "text")).otherwise(F.col("text"))
    return c.join(said, "chunk_id", "left").withColumn("text", t).drop("context")


def part_of(chunks: DataFrame) -> DataFrame:
    """(chunk_id, doc_id, index): which document each chunk is part of, and where."""
    return chunks.select("chunk_id", "doc_id", F.col("chunk_index").alias("index"))


def link(chunks: DataFrame) -> DataFrame:
    """With next_chunk_id: the following chunk of the same document."""
    return chunks.withColumn("next_chunk_id", F.lead("chunk_id").over(Window.partitionBy("doc_id").orderBy("chunk_index")))
