"""Cleaning triples (src, rel, dst, ...): noise nodes, direction, reviews by a model, and facts that must not get lost."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kgspark.functions.text import name_key
from kgspark.operators.governance import check_direction

# Names that are no node.
STOP_NODES = (
    "he", "she", "it", "they", "we", "you", "i", "this", "that", "these", "those", "the", "a", "an", "his", "her", "its", "their", "our", "my", "your",
    "active", "not active", "inactive", "enabled", "disabled", "yes", "no", "true", "false", "none", "null", "n/a", "planned", "unavailable", "available", "approved", "pending",
    "other", "unknown", "general", "default", "various", "branch", "manager", "partner", "service", "services", "booking", "appointments", "appointment",
    "phone", "online", "remote", "on-site", "samples", "stock", "data", "system", "note", "notes", "هو", "هي", "هم", "نحن", "أنا", "أنت",
)
# Endings and beginnings of names of activities.
NOISE_ENDS = (
    " strategy", " hiring", " approvals", " approval", " reporting", " review", " reviews", " roadmap", " planning", " management", " operations", " intelligence", " meetings", " procedures",
    " guidelines", " standards", " compliance", " optimization", " improvement", " assessment", " evaluation", " concerns", " disputes", " refunds", " issues", " protocols", " escalation", " resolution", " tracking", " oversight",
)
NOISE_STARTS = ("internal ", "external ", "major ", "monthly ", "weekly ", "daily ", "annual ", "quarterly ", "ongoing ", "current ", "future ", "operational ", "administrative ")
# Words of which a name of four words or more cannot consist.
COMMON_WORDS = (
    "company", "team", "desk", "office", "department", "executive", "vendor", "payment", "financial", "clinical", "medical", "health", "care", "quality", "policy", "digital", "operations",
    "intelligence", "knowledge", "base", "graph", "rag", "internal", "external", "major", "monthly", "weekly", "daily", "annual", "the", "a", "an", "of", "for", "and", "in", "on", "at", "to", "with", "by",
    "from", "or", "not", "no", "new", "old", "current", "future", "planned", "active", "inactive", "general", "specific", "routine", "individual", "preventive",
)
# Relations that make the frame of a graph.
STRUCTURAL = ("OPERATES", "MANAGES", "OFFERS", "PROVIDES", "LOCATED_IN", "LOCATED_AT", "PART_OF", "BELONGS_TO", "HAS_BRANCH", "FOUNDED", "FOUNDED_BY", "OWNS", "EMPLOYS", "WORKS_AT", "BASED_AT", "HAS_ROLE")
# Relations that say a service is there.
SERVICE = ("OFFERS", "OFFERS_SERVICE", "PROVIDES", "HAS_SERVICE")


def is_noise(name: Column) -> Column:
    """A name that is no node: blank or one character, a stop word, an activity, or four words or more that are all common."""
    n = name_key(name)
    out = (F.length(n) <= 1) | n.isin(*STOP_NODES)
    for e in NOISE_ENDS:
        out = out | n.endswith(e)
    for s in NOISE_STARTS:
        out = out | n.startswith(s)
    words = F.split(n, r"\s+")
    return out | ((F.size(words) >= 4) & F.forall(words, lambda w: w.isin(*COMMON_WORDS)))


def without_noise(triples: DataFrame, *names: str) -> DataFrame:
    """Rows none of whose ``names`` (src and dst by default) is noise."""
    for c in names or ("src", "dst"):
        triples = triples.where(~is_noise(F.col(c)))
    return triples


def relation_name(c: Column) -> Column:
    """'works at' -> 'WORKS_AT', nothing cut off."""
    return F.upper(F.regexp_replace(F.btrim(c, F.lit(" \t\r\n")), "[ -]", "_"))


def validated(triples: DataFrame, types: DataFrame, relations: DataFrame, parents: DataFrame) -> DataFrame:
    """Triples (src, rel, dst, src_type, dst_type, ...) with normal names of relations and the types (name, type) that are known of their ends.

    No self-loops; those whose ends are the wrong way round are turned, those that no signature allows are dropped. Unknown relations pass.
    """
    x = triples.withColumn("rel", relation_name(F.col("rel")))
    for end in ("src", "dst"):
        x = x.join(types.select(F.col("name").alias(end), F.col("type").alias("_t")).dropDuplicates([end]), end, "left")
        x = x.withColumn(f"{end}_type", F.lower(F.btrim(F.coalesce(F.nullif("_t", F.lit("")), F.col(f"{end}_type"), F.lit(""))))).drop("_t")
    x = check_direction(x.where("src != dst"), relations, parents).where("direction != 'invalid'")
    flip = F.col("direction") == "flip"
    turn = {a: F.when(flip, F.col(b)).otherwise(F.col(a)) for a, b in (("src", "dst"), ("dst", "src"), ("src_type", "dst_type"), ("dst_type", "src_type"))}
    return x.select(*[turn.get(c, F.col(c)).alias(c) for c in triples.columns])


def reviewed(triples: DataFrame, review: DataFrame) -> DataFrame:
    """Triples after a review (src, rel, dst, action, new_rel): remove drops, flip exchanges the ends, rename gives another relation; a triple may have several."""
    key = ["src", "rel", "dst"]
    r = review.groupBy(*key).agg(F.max(F.col("action") == "remove").alias("_out"), F.max(F.col("action") == "flip").alias("_flip"), F.max(F.when(F.col("action") == "rename", F.col("new_rel"))).alias("_rel"))
    x = triples.join(r, key, "left").where(~F.coalesce("_out", F.lit(False)))
    flip = F.coalesce("_flip", F.lit(False))
    turn = {"src": F.when(flip, F.col("dst")).otherwise(F.col("src")), "dst": F.when(flip, F.col("src")).otherwise(F.col("dst")), "rel": F.coalesce("_rel", "rel")}
    if "src_type" in triples.columns:
        turn |= {"src_type": F.when(flip, F.col("dst_type")).otherwise(F.col("src_type")), "dst_type": F.when(flip, F.col("src_type")).otherwise(F.col("dst_type"))}
    return x.select(*[turn.get(c, F.col(c)).alias(c) for c in triples.columns])


def corrected(triples: DataFrame, removed: DataFrame, changed: DataFrame) -> DataFrame:
    """Triples without those ``removed`` (src, rel, dst), and with the fields that ``changed`` (src, rel, dst, new_src, new_rel, new_dst) gives; evidence, chunk and weight stay."""
    key = ["src", "rel", "dst"]
    x = triples.join(removed.select(*key).distinct(), key, "left_anti").join(changed.select(*key, "new_src", "new_rel", "new_dst").dropDuplicates(key), key, "left")
    return x.select(*[F.coalesce(F.nullif(f"new_{c}", F.lit("")), c).alias(c) if c in key else F.col(c) for c in triples.columns])


def standardised(triples: DataFrame, names: DataFrame) -> DataFrame:
    """Triples whose ends have the name that ``names`` (name, canonical) gives."""
    for end in ("src", "dst"):
        m = names.select(F.col("name").alias(end), F.col("canonical").alias("_to")).dropDuplicates([end])
        triples = triples.join(m, end, "left").withColumn(end, F.coalesce("_to", end)).select(*triples.columns)
    return triples


def without_denied_services(triples: DataFrame) -> DataFrame:
    """Without services that another triple between the same ends says are not offered."""
    denied = triples.where("rel = 'DOES_NOT_OFFER'").select("src", "dst").distinct()
    yes = triples.where(F.col("rel").isin(*SERVICE)).join(denied, ["src", "dst"], "left_anti")
    return triples.where(~F.col("rel").isin(*SERVICE)).unionByName(yes.select(*triples.columns))


def preserved(raw: DataFrame, compiled: DataFrame, types: DataFrame, relations: DataFrame, parents: DataFrame) -> DataFrame:
    """``compiled`` with the structural facts of ``raw`` that have evidence, fit a signature (turned if need be) and are not in it in any case of letters."""
    key = lambda df: df.withColumns({"_s": F.lower("src"), "_r": F.upper("rel"), "_d": F.lower("dst")})
    have = key(compiled).select("_s", "_r", "_d").distinct()
    x = raw.withColumn("rel", F.upper("rel")).where(F.col("rel").isin(*STRUCTURAL) & (F.length(F.coalesce("evidence_text", F.lit(""))) > 0))
    x = key(x).join(have, ["_s", "_r", "_d"], "left_anti").select(*raw.columns)
    x = key(validated(x, types, relations, parents)).join(have, ["_s", "_r", "_d"], "left_anti")
    return compiled.unionByName(x.dropDuplicates(["_s", "_r", "_d"]).select(*compiled.columns))
