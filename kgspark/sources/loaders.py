"""File loaders: a folder of mixed files to one table of documents.

Formats: txt, json, xml and csv as text, markdown with title and headings, html without tags.
PDF needs a library; without one its rows go to ``errors``. Files of other kinds are skipped.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kgspark.functions.text import trim

EXTENSIONS = ("txt", "md", "csv", "json", "html", "htm", "xml", "pdf")
# Entities that are decoded, in this order.
ENTITIES = (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "))


def strip_html(c: Column) -> Column:
    """Text of a page: a line break before block tags, no scripts and styles, no tags, entities decoded."""
    c = F.regexp_replace(c, r"(?i)<(br|p|div|h[1-6]|li|tr)([^>]*)>", "\n<$1$2>")
    c = F.regexp_replace(c, r"(?is)<(script|style)[^>]*>.*?</\1>", "")
    c = F.regexp_replace(c, r"<[^>]+>", "")
    for name, sign in ENTITIES:
        c = F.replace(c, F.lit(name), F.lit(sign))
    return trim(F.regexp_replace(c, r"\n{3,}", "\n\n"))


def html_title(c: Column) -> Column:
    return trim(F.regexp_extract(c, r"(?is)<title[^>]*>(.*?)</title>", 1))


def markdown_title(c: Column) -> Column:
    return trim(F.regexp_extract(c, r"(?m)^\s*# (.*)$", 1))


def markdown_headings(c: Column) -> Column:
    """'h1:Title|h2:Part' of the headings in order."""
    found = F.regexp_extract_all(c, F.lit(r"(?m)^[ \t]*(#{1,6} .*)$"), F.lit(1))
    return F.array_join(F.transform(found, lambda h: F.concat(F.lit("h"), F.length(F.regexp_extract(h, "^(#+)", 1)), F.lit(":"), trim(F.regexp_replace(h, "^#+", "")))), "|")


def records(rows: DataFrame, *order: str) -> DataFrame:
    """(content, columns, n_rows): 'Record i:' with 'header: value' lines of every row that has a value, blank ones left out."""
    from pyspark.sql import Window

    cols = [c for c in rows.columns if c not in order]
    lines = F.array_compact(F.array(*[F.when(F.length(trim(F.col(c).cast("string"))) > 0, F.concat(F.lit(f"  {c}: "), trim(F.col(c).cast("string")))) for c in cols]))
    x = rows.withColumn("i", F.row_number().over(Window.orderBy(*order))).select("i", F.concat(F.lit("Record "), F.col("i"), F.lit(":\n"), F.array_join(lines, "\n"), F.lit("\n")).alias("r"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "r"))), lambda s: s.r), "\n")
    return x.agg(text.alias("content"), F.lit(",".join(cols)).alias("columns"), F.count("*").alias("n_rows"))


def document_id(source: Column, content: Column) -> Column:
    """The trimmed source, or doc- and the start of the content's hash."""
    s = trim(F.coalesce(source, F.lit("")))
    return F.when(s != "", s).otherwise(F.concat(F.lit("doc-"), F.substring(F.sha2(content, 256), 1, 16)))


def content_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def _parsed(kind: str):
    """Files that need a whole-file parser: csv and pdf, one file a row."""
    import csv
    import io

    def of_csv(data: bytes) -> tuple[str, dict]:
        rows = [r for r in csv.reader(io.StringIO(data.decode("utf-8", "replace"))) if r]
        if len(rows) < 2:
            raise ValueError("a csv file needs a header and a row")
        head, out = [h.strip() for h in rows[0]], []
        for i, r in enumerate(rows[1:], 1):
            lines = [f"  {h}: {v.strip()}" for h, v in zip(head, r) if v.strip()]
            out.append(f"Record {i}:\n" + "".join(x + "\n" for x in lines))
        return "\n".join(out), {"columns": ",".join(head), "rows": str(len(rows) - 1)}

    def of_pdf(data: bytes) -> tuple[str, dict]:
        try:
            from pypdf import PdfReader
        except ImportError as e:
            raise ValueError("no pdf library") from e
        pages = [p.extract_text() or "" for p in PdfReader(io.BytesIO(data)).pages]
        if not any(p.strip() for p in pages):
            raise ValueError("no text")
        return "\n\n".join(pages), {"pages": str(len(pages))}

    read = {"csv": of_csv, "pdf": of_pdf}[kind]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, data in zip(pdf["path"], pdf["content"]):
                try:
                    text, meta = read(data)
                    rows.append((path, text, meta, None))
                except Exception as e:  # the file is reported, the others go on
                    rows.append((path, None, {}, str(e)[:200]))
            yield pd.DataFrame(rows, columns=["path", "content", "more", "error"])

    return run


def load(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(documents, errors) of a folder, subfolders included; documents: doc_id, path, content, content_hash, metadata."""

    def files(*kinds: str) -> DataFrame:
        """Files of some kinds, each read once, in any case of letters."""
        anyhow = ",".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in k) for k in kinds)
        x = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", f"*.{{{anyhow}}}").load(folder)
        return x.select("path", "content").withColumn("ext", F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)))

    parts = []
    for kind in ("csv", "pdf"):
        parts.append(files(kind).select("path", "content").mapInPandas(_parsed(kind), "path string, content string, more map<string,string>, error string"))
    text = files(*[k for k in EXTENSIONS if k not in ("csv", "pdf")]).withColumn("raw", F.decode("content", "UTF-8"))
    page = F.col("ext").isin("html", "htm")
    more = (
        F.when(page, F.create_map(F.lit("title"), html_title(F.col("raw"))))
        .when(F.col("ext") == "md", F.create_map(F.lit("title"), markdown_title(F.col("raw")), F.lit("headings"), markdown_headings(F.col("raw"))))
        .otherwise(F.create_map().cast("map<string,string>"))
    )
    parts.append(text.select("path", F.when(page, strip_html(F.col("raw"))).otherwise(F.col("raw")).alias("content"), more.alias("more"), F.lit(None).cast("string").alias("error")))
    out = parts[0].unionByName(parts[1]).unionByName(parts[2])
    meta = F.map_concat(F.create_map(F.lit("filename"), F.regexp_extract("path", r"([^/]+)$", 1), F.lit("extension"), F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))), F.map_filter("more", lambda k, v: v != ""))
    docs = out.where("error is null").select(document_id(F.col("path"), F.col("content")).alias("doc_id"), "path", "content", content_hash(F.col("content")).alias("content_hash"), meta.alias("metadata"))
    return docs, out.where("error is not null").select("path", "error")


def load_text(spark: SparkSession, text: str, source: str = "") -> DataFrame:
    x = spark.createDataFrame([(text, source)], "content string, path string")
    return x.select(document_id(F.col("path"), F.col("content")).alias("doc_id"), "path", "content", content_hash(F.col("content")).alias("content_hash"), F.create_map(F.lit("type"), F.lit("raw_text")).alias("metadata"))
