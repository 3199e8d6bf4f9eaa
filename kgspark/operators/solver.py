"""Constraints and selection: which candidate edges make a consistent graph.

Constraints are rows of data: the ontology's signatures, and ``EVIDENCE`` rules of phrases an
edge's evidence must or must not have. Edges meet them in one pass with one join per end; the
first that fails decides. Rules of one trade's business (who may run what, in which state)
are not built in; they can be given as further rules.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kgspark.functions.text import any_phrase, is_raw_temporal, name_key, trim
from kgspark.ontology import DEFAULT, Ontology

# Names too general for an alias to stand for.
GENERIC = ("clinic", "laboratory", "lab", "hospital", "pharmacy", "network", "company", "organization", "service", "branch", "center", "office")
# Phrases that deny, for relations that deny something.
DENIALS = (
    "does not", "doesn't", "do not", "did not", "didn't", "no contract", "no agreement", "no active contract", "not available", "not responsible", "not provide", "does not provide",
    "not handle", "does not handle", "not process", "does not process", "not offer", "does not offer", "no longer", "not covered by",
)
# Relations that exclude each other between two entities.
COMPETING = (
    ("BASED_AT", "VISITS", "PROVIDES_SERVICE_FOR", "PROVIDES_REMOTE_SERVICE_FOR", "MANAGES", "DOES_NOT_WORK_AT"),
    ("MANAGES", "HAS_DEPUTY_MANAGER"),
)
LEAST_SCORE = 0.3


@dataclass(frozen=True)
class EvidenceRule:
    """Evidence of ``relation`` (a prefix, if it ends with *) must have one of ``needs`` and none of ``bans``; blank evidence passes if ``blank`` is set."""

    relation: str
    needs: tuple[str, ...] = ()
    bans: tuple[str, ...] = ()
    blank: bool = False

    def fails(self, rel: Column, evidence: Column) -> Column:
        own = rel.startswith(self.relation[:-1]) if self.relation.endswith("*") else rel == self.relation
        bad = F.lit(False)
        if self.needs:
            bad = bad | ~any_phrase(evidence, self.needs)
        if self.bans:
            bad = bad | any_phrase(evidence, self.bans)
        if self.blank:
            bad = bad & (trim(F.coalesce(evidence, F.lit(""))) != "")
        return own & bad


EVIDENCE = (
    EvidenceRule("DOES_NOT_*", DENIALS, blank=True),
    EvidenceRule("NO_CONTRACT_WITH", DENIALS, blank=True),
    EvidenceRule("CONTRACTED_WITH", ("contract", "agreement", "contracted", "signed", "engagement letter", "service agreement", "memorandum", "mou", "sla")),
    EvidenceRule("OFFERS", bans=("contract with", "agreement with")),
)


def _ends(edges: DataFrame, entities: DataFrame, alias_map: DataFrame) -> DataFrame:
    e = entities.select("name", "base_types")
    a = alias_map.select(F.col("alias").alias("name"), F.lit(True).alias("is_alias")).distinct()
    x = edges
    for end in ("src", "dst"):
        x = x.join(e.select(F.col("name").alias(end), F.col("base_types").alias(f"_{end}_types")), end, "left")
        x = x.join(a.select(F.col("name").alias(end), F.col("is_alias").alias(f"_{end}_alias")), end, "left")
    return x


def canonical_weight(name: Column) -> Column:
    """How much a name looks like a full name."""
    words = F.size(F.split(trim(name), r"\s+"))
    return F.when(words >= 2, 2).otherwise(0) + F.when(any_phrase(name, ("network", "laboratory", "medical", "clinic", "diagnostics")), 2).otherwise(0) + F.when(F.octet_length(name) > 12, 1).otherwise(0)


def verdicts(edges: DataFrame, entities: DataFrame, alias_map: DataFrame, ontology: Ontology = DEFAULT, rules: tuple[EvidenceRule, ...] = EVIDENCE) -> DataFrame:
    """The edges with ``verdict``: 'keep', or the name of the first constraint that fails."""
    sig = ontology.signatures(edges.sparkSession).select("rel", "src_types", "dst_types")
    x = _ends(edges, entities, alias_map).join(F.broadcast(sig), "rel", "left")
    rel, ev, alias_edge = F.col("rel"), F.col("evidence_text"), F.col("rel") == "ALIAS_OF"
    s, d = name_key(F.col("src")), name_key(F.col("dst"))
    misfit = lambda end: F.col(f"_{end}_types").isNotNull() & (F.size(f"{end}_types") > 0) & ~F.arrays_overlap(f"_{end}_types", f"{end}_types")
    bad_evidence = F.lit(False)
    for r in rules:
        bad_evidence = bad_evidence | r.fails(rel, ev)
    verdict = (
        F.when(is_raw_temporal(F.col("src")) | is_raw_temporal(F.col("dst")), "raw_value")
        .when(~alias_edge & (F.col("_src_alias").isNotNull() | F.col("_dst_alias").isNotNull()), "alias_end")
        .when(alias_edge & F.col("_src_types").isNotNull() & F.col("_dst_types").isNotNull() & (~F.coalesce(F.arrays_overlap("_src_types", "_dst_types"), F.lit(False)) | d.isin(*GENERIC)), "alias_types")
        .when(alias_edge & (s.isin(*GENERIC) | (canonical_weight(s) > canonical_weight(d))), "alias_direction")
        .when(bad_evidence, "evidence")
        .when(F.col("src_types").isNull(), "unknown_relation")
        .when(misfit("src") | misfit("dst"), "signature")
        .otherwise("keep")
    )
    return x.withColumn("verdict", verdict).select(*edges.columns, "verdict")


def alternative_groups(edges: DataFrame, ontology: Ontology = DEFAULT) -> DataFrame:
    """With alternative_group: every edge of two entities among which relations compete, unless it has a group.

    The relations of a pair are gathered by an aggregation of at most as many values as there are relations.
    """
    a, b = F.least(F.lower("src"), F.lower("dst")), F.greatest(F.lower("src"), F.lower("dst"))
    x = edges.withColumns({"_a": a, "_b": b, "_rel": ontology.resolve(F.col("rel")).relation})
    fights = F.lit(False)
    for group in COMPETING:
        fights = fights | (F.size(F.array_intersect("_rels", F.array(*[F.lit(r) for r in group]))) > 1)
    pairs = x.groupBy("_a", "_b").agg(F.collect_set("_rel").alias("_rels")).where(fights).select("_a", "_b", F.concat(F.lit("alt_"), "_a", F.lit("_"), "_b").alias("_g"))
    x = x.join(pairs, ["_a", "_b"], "left")
    own = F.coalesce("alternative_group", F.lit(""))
    return x.withColumn("alternative_group", F.when(own != "", own).otherwise(F.coalesce("_g", F.lit("")))).select(*edges.columns)


def final_score(evidence: Column, fit: Column, confidence: Column) -> Column:
    z = lambda c: F.coalesce(c, F.lit(0.0))
    s = 0.4 * z(evidence) + 0.3 * z(fit) + 0.3 * z(confidence)
    return F.when(s == 0, z(confidence)).otherwise(s)


def build_final(edges: DataFrame, entities: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges with weight, entities): the weight is the final score after folding; an end that is no entity becomes a bare one."""
    e = edges.withColumn("weight", final_score(F.col("evidence_score"), F.col("schema_fit_score"), F.col("confidence")))
    names = edges.select(F.col("src").alias("name")).union(edges.select("dst")).distinct()
    return e, names.join(entities, "name", "left")


def select(edges: DataFrame, least: float = LEAST_SCORE) -> DataFrame:
    """With score; of a group the best edge, of the others each, if they score ``least`` or more."""
    x = edges.withColumn("score", final_score(F.col("evidence_score"), F.col("schema_fit_score"), F.col("confidence"))).where(F.col("score") >= least)
    alone = F.coalesce("alternative_group", F.lit("")) == ""
    w = Window.partitionBy("alternative_group").orderBy(F.desc("score"), "seq")
    best = x.where(~alone).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    return x.where(alone).unionByName(best)


#: Arrivals of a block of the fold: the most rows of one edge that are gathered at once, seq being unique.
FOLD_BLOCK = 4096


def _folded(steps: Column) -> Column:
    """Composition of steps (t, k, w, c, d, dc, first) in order: below the score t the result is (k, w, c), else score and confidence grow by d and dc.

    Such steps are closed under composition, so blocks can be folded apart and then together.
    """

    def then(a: Column, b: Column) -> Column:
        taken = a.k < b.t  # what the earlier steps give is replaced by the later ones
        return F.struct(
            F.when(a.first, F.lit(float("inf"))).otherwise(F.greatest(a.t, b.t - a.d)).alias("t"),
            F.when(taken, b.k).otherwise(a.k + b.d).alias("k"),
            F.when(taken, b.w).otherwise(a.w).alias("w"),
            F.when(taken, b.c).otherwise(a.c + b.dc).alias("c"),
            (a.d + b.d).alias("d"),
            (a.dc + b.dc).alias("dc"),
            a.first.alias("first"),
        )

    return F.aggregate(F.slice(steps, 2, F.greatest(F.size(steps) - 1, F.lit(0))), F.element_at(steps, 1), then)


def fold_duplicates(edges: DataFrame) -> DataFrame:
    """One edge per lower-cased (src, rel, dst), folded in order of seq, which must be unique.

    The first edge stands until one of a higher final score replaces it. Every later edge, a
    replacing one too, adds a tenth of its confidence to the one that stands then, and with it to the
    score that the next ones must exceed. The arrivals of an edge are folded in blocks of
    ``FOLD_BLOCK`` seqs, then the blocks, so no group is gathered whole.
    """
    key = [F.lower("src").alias("_s"), F.col("rel").alias("_r"), F.lower("dst").alias("_d")]
    conf = F.coalesce("confidence", F.lit(0.0)).cast("double")
    x = edges.select("seq", *key, conf.alias("c"), final_score(F.col("evidence_score"), F.col("schema_fit_score"), F.col("confidence")).cast("double").alias("f"))
    first = x.groupBy("_s", "_r", "_d").agg(F.min("seq").alias("_first"))
    x = x.join(first, ["_s", "_r", "_d"])
    own, more, new = 0.1 * F.col("c"), 0.03 * F.col("c"), F.col("seq") == F.col("_first")
    step = F.struct(
        F.when(new, F.lit(float("inf"))).otherwise(F.col("f")).alias("t"),
        F.when(new, F.col("f")).otherwise(F.col("f") + more).alias("k"),
        F.col("seq").alias("w"),
        F.when(new, F.col("c")).otherwise(F.col("c") + own).alias("c"),
        more.alias("d"),
        own.alias("dc"),
        new.alias("first"),
    )
    ordered = lambda col: F.transform(F.array_sort(F.collect_list(F.struct("seq", F.col(col).alias("x")))), lambda e: e.x)
    x = x.select("_s", "_r", "_d", "seq", F.floor(F.col("seq") / FOLD_BLOCK).alias("_b"), step.alias("_x"))
    x = x.groupBy("_s", "_r", "_d", "_b").agg(F.min("seq").alias("seq"), ordered("_x").alias("_x")).withColumn("_x", _folded(F.col("_x")))
    x = x.groupBy("_s", "_r", "_d").agg(ordered("_x").alias("_x")).select("_s", "_r", "_d", _folded(F.col("_x")).alias("_x"))
    x = x.select("_s", "_r", "_d", F.col("_x.w").alias("seq"), F.col("_x.c").alias("_c"), F.col("_x.k").alias("_k"))
    out = edges.select("*", *key).join(x, ["_s", "_r", "_d", "seq"]).withColumn("confidence", F.col("_c"))
    return (out.withColumn("score", F.col("_k")) if "score" in edges.columns else out).select(*edges.columns)


def post_validate(edges: DataFrame, entities: DataFrame, alias_map: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges, entities): edges with known, different ends that are no aliases (ALIAS_OF excepted), and the entities they touch."""
    names = entities.select("name").distinct()
    x = edges.where("src != dst")
    for end in ("src", "dst"):
        x = x.join(names.withColumnRenamed("name", end), end, "left_semi")
    a = alias_map.select("alias").distinct()
    plain = x.where("rel != 'ALIAS_OF'")
    for end in ("src", "dst"):
        plain = plain.join(a.withColumnRenamed("alias", end), end, "left_anti")
    x = plain.unionByName(x.where("rel = 'ALIAS_OF'")).select(*edges.columns)
    used = x.select(F.col("src").alias("name")).union(x.select("dst")).distinct()
    types = F.when(F.size(F.coalesce("base_types", F.array().cast("array<string>"))) == 0, F.array(F.lit("concept"))).otherwise(F.col("base_types"))
    return x, entities.join(used, "name", "left_semi").withColumn("base_types", types)
