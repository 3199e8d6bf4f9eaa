"""The pN_ queries: each runs over its whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kgspark.llm import canonical, components, fusion, language, leaks, mixing, names, neighbours, spam, split
from kgspark.session import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return fusion.fuse(table(spark, d, "kg_entities"), table(spark, d, "sources")).select("id", "field_name", "kept_value")


def p1_fusion(spark: SparkSession, d: str) -> DataFrame:
    """The values of greatest posterior without the prior of trust."""
    x = fusion.fuse(table(spark, d, "kg_entities"), table(spark, d, "sources"), prior="none")
    return x.withColumn("posterior", F.round("posterior", 6)).withColumn("accuracy", F.round("accuracy", 6))


def p2_pieces(spark: SparkSession, d: str) -> DataFrame:
    docs = split.oversized(table(spark, d, "documents"), "document", "doc_id")
    return docs.unionByName(split.oversized(table(spark, d, "chunks"), "chunk", "chunk_id"))


def p2_text(spark: SparkSession, d: str) -> DataFrame:
    """The texts that the pieces give when their own parts are joined."""
    own = F.struct("piece_no", F.expr("substring(piece, own_start + 1)").alias("own"))
    x = p2_pieces(spark, d).groupBy("item_kind", "item_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(own)), lambda p: p.own), "").alias("t"))
    return x.select("item_kind", "item_id", F.md5("t").alias("text_hash"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return p2_pieces(spark, d).where("piece_no = 0").select("item_kind", "item_id", "boundary")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return neighbours.pairs(neighbours.neighbours(table(spark, d, "kg_entities"), "rec_id", "embedding", 5, least=0.85), 0.85)


def p3_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """The five most similar others of every record whose id is divisible by 20, against all records, by the probed lists."""
    x = neighbours.neighbours(table(spark, d, "kg_entities"), "rec_id", "embedding", 5, queries=F.col("id") % 20 == 0)
    return x.select("id", "other", F.round("cosine", 5).alias("cosine"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return components.groups(table(spark, d, "merge_pairs"))


def _labelled_texts(spark: SparkSession, d: str) -> DataFrame:
    """(record_kind, record_id, item_no, text, label) of documents, evidence and aliases."""
    docs = table(spark, d, "documents").select(F.lit("document").alias("record_kind"), F.col("doc_id").alias("record_id"), F.lit(0).cast("long").alias("item_no"), "text", F.col("lang").alias("label"))
    ev = table(spark, d, "kg_edges").select("seq", F.posexplode("evidence").alias("i", "e"))
    ev = ev.select(F.lit("evidence"), "seq", F.col("i").cast("long"), "e.text", "e.language")
    al = table(spark, d, "kg_entities").select("rec_id", F.posexplode("aliases").alias("i", "e"))
    return docs.union(ev).union(al.select(F.lit("alias"), "rec_id", F.col("i").cast("long"), "e.text", "e.lang"))


def p5_segments(spark: SparkSession, d: str) -> DataFrame:
    """Every text's segments with language and confidence."""
    found = language.classify(_labelled_texts(spark, d), language.train(table(spark, d, "documents")))
    return found.withColumn("confidence", F.round("confidence", 4)).drop("n_segments")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    found = language.wrong_labels(language.classify(_labelled_texts(spark, d), language.train(docs)))
    pages = spam.spam(docs).select(F.lit("document").alias("record_kind"), F.col("doc_id").alias("record_id"))
    return found.join(pages, ["record_kind", "record_id"], "left_anti").select("record_kind", "record_id", "item_no", "segment_no", "lang")


def _mapped_edges(spark: SparkSession, d: str) -> DataFrame:
    edges = table(spark, d, "candidate_edges").select("seq", "relation_candidate")
    return canonical.mapped(edges, "relation_candidate", table(spark, d, "relations")).where("match_score < 3")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return _mapped_edges(spark, d).select("seq", F.col("matched_id").alias("relation_id")).distinct()


def p6_unmatched(spark: SparkSession, d: str) -> DataFrame:
    """The values like nothing in the list, and how many rows have them."""
    x = _mapped_edges(spark, d).where(F.col("matched_id") == canonical.UNMATCHED)
    return x.groupBy(F.lower(F.btrim("relation_candidate")).alias("value")).agg(F.countDistinct("seq").alias("n_rows"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return names.variants(table(spark, d, "candidate_entities"), table(spark, d, "kg_entities")).select("seq", "id").distinct()


def p8_spans(spark: SparkSession, d: str) -> DataFrame:
    x = leaks.leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))
    return x.withColumn("share", F.round("share", 6))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return leaks.leaks(table(spark, d, "documents"), table(spark, d, "eval_items")).select("doc_id", "item_id").distinct()


def p8_clean(spark: SparkSession, d: str) -> DataFrame:
    """The documents without the leaked passages."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    return leaks.remove(docs, leaks.leaks(docs, table(spark, d, "eval_items")))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    _, planned = mixing.mixed(table(spark, d, "documents"), table(spark, d, "sources"))
    return mixing.shares(planned).where("below").select("source")


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    _, planned = mixing.mixed(table(spark, d, "documents"), table(spark, d, "sources"))
    return mixing.shares(planned).withColumn("actual_share", F.round("actual_share", 9))


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    lengths, planned = mixing.mixed(table(spark, d, "documents"), table(spark, d, "sources"))
    return mixing.mix(lengths, planned).withColumnsRenamed({"k": "doc_id", "n": "n_tokens"})


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return spam.spam(table(spark, d, "documents"))


def p10_scores(spark: SparkSession, d: str) -> DataFrame:
    x = spam.scores(table(spark, d, "documents"))
    return x.select("doc_id", F.round("link_share", 6).alias("link_share"), F.round("stuffed_share", 6).alias("stuffed_share"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (p1_found, p1_fusion, p2_found, p2_pieces, p2_text, p3_found, p3_neighbours, p4_found, p5_found, p5_segments, p6_found, p6_unmatched, p7_found, p8_found, p8_spans, p8_clean, p9_found, p9_shares, p9_mix, p10_found, p10_scores)
    return {f.__name__: f for f in found}
