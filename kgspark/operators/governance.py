"""Schema governance: whether a proposed type or relation is new, and what is known under its name.

Proposals are compared with the whole schema by joins; the first kind of match that holds decides.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kgspark.functions.text import jaccard

# Words too vague to be a type, and the least similarity of word sets.
VAGUE = ("thing", "entity", "item", "object", "stuff", "other", "misc")
LEAST = 0.7


def words(c: Column) -> Column:
    return F.array_sort(F.array_distinct(F.split(F.lower(c), "[_ ]+")))


def check_types(proposed: DataFrame, known: DataFrame, aliases: DataFrame) -> DataFrame:
    """(name, decision, match, confidence) of proposed names: exact, alias, word_order, similar, vague or new.

    Word sets meet through shared words, so no proposal is compared with an entry that shares none.
    """
    p = proposed.select(F.col("name")).distinct().withColumn("l", F.lower("name")).withColumn("w", words(F.col("name")))
    k = known.select(F.col("name").alias("match"), F.lower("name").alias("l"), words(F.col("name")).alias("kw"))
    exact = p.join(k.select("match", "l"), "l").select("name", F.lit(1).alias("pr"), F.lit("exact").alias("decision"), "match", F.lit(1.0).alias("confidence"))
    alias = p.join(aliases.select(F.lower("alias").alias("l"), F.col("canonical").alias("match")), "l").select("name", F.lit(2), F.lit("alias"), "match", F.lit(1.0))
    near = p.select("name", "w", F.explode("w").alias("t")).join(k.select("match", "kw", F.explode("kw").alias("t")), "t").select("name", "w", "match", "kw").distinct()
    order = near.where(F.col("w") == F.col("kw")).select("name", F.lit(3), F.lit("word_order"), "match", F.lit(0.85))
    similar = near.withColumn("j", jaccard(F.col("w"), F.col("kw"))).where(F.col("j") >= LEAST).select("name", F.lit(4), F.lit("similar"), "match", F.col("j"))
    vague = p.where((F.size("w") == 1) & F.col("l").isin(*VAGUE)).select("name", F.lit(5), F.lit("vague"), F.lit(None).cast("string"), F.lit(0.8))
    new = p.select("name", F.lit(6), F.lit("new"), F.lit(None).cast("string"), F.lit(0.5))
    x = exact.union(alias).union(order).union(similar).union(vague).union(new)
    w = Window.partitionBy("name").orderBy("pr", F.desc("confidence"), "match")
    return x.withColumn("r", F.row_number().over(w)).where("r = 1").select("name", "decision", "match", "confidence")


def check_direction(edges: DataFrame, relations: DataFrame, parents: DataFrame) -> DataFrame:
    """``edges`` (src_type, rel, dst_type) with direction: ok, flip, invalid, or unknown for a relation that is not known.

    A type fits if it, its parent or one of its bases is allowed; an empty list allows any. ``parents``: (type, bases ARRAY).
    """
    x = edges.join(relations.select("rel", "src_types", "dst_types"), "rel", "left")
    for end in ("src", "dst"):
        x = x.join(parents.select(F.col("type").alias(f"{end}_type"), F.col("bases").alias(f"_{end}")), f"{end}_type", "left")
        x = x.withColumn(f"_{end}", F.concat(F.array(f"{end}_type"), F.coalesce(f"_{end}", F.array().cast("array<string>"))))
    fits = lambda t, allowed: (F.size(allowed) == 0) | F.arrays_overlap(t, allowed)
    d = F.when(F.col("src_types").isNull(), "unknown").when(fits("_src", "src_types") & fits("_dst", "dst_types"), "ok").when(fits("_dst", "src_types") & fits("_src", "dst_types"), "flip").otherwise("invalid")
    return x.withColumn("direction", d).select(*edges.columns, "direction")


def base_of(types: DataFrame, base: list[str], default: str = "concept", most: int = 8) -> DataFrame:
    """(type, base): the first base type up the chain of parents, within ``most`` steps; ``default`` if there is none."""
    t = types.select("type", "parent")
    x = t.select("type", F.col("type").alias("at"))
    for _ in range(most):
        x = x.join(t.select(F.col("type").alias("at"), F.col("parent").alias("up")), "at", "left")
        x = x.select("type", F.when(F.col("at").isin(*base), F.col("at")).otherwise(F.coalesce("up", "at")).alias("at"))
    return x.select("type", F.when(F.col("at").isin(*base), F.col("at")).otherwise(F.lit(default)).alias("base"))


def candidates(values: DataFrame, column: str, examples: str, n: int = 3) -> DataFrame:
    """(value, count, examples): how often each value is used, and its first ``n`` examples."""
    w = Window.partitionBy(column).orderBy(examples)
    ex = values.select(column, examples).distinct().withColumn("r", F.row_number().over(w)).where(F.col("r") <= n)
    ex = ex.groupBy(column).agg(F.array_join(F.array_sort(F.collect_list(examples)), " | ").alias("examples"))
    return values.groupBy(column).agg(F.count("*").alias("n")).join(ex, column)


def apply_normalisation(values: DataFrame, column: str, mapping: DataFrame) -> DataFrame:
    """``values`` with names replaced by the mapping (raw, canonical); '__REJECTED__' drops the row."""
    m = mapping.select(F.col("raw").alias(column), F.col("canonical").alias("_to"))
    x = values.join(m, column, "left").where(F.coalesce("_to", F.lit("")) != "__REJECTED__")
    return x.withColumn(column, F.coalesce("_to", column)).select(*values.columns)


def plural_variants(names: DataFrame) -> DataFrame:
    """(alias, canonical): of a name and its plural the more frequent form stays. ``names``: (name, n)."""
    a, b = names.select("name", "n"), names.select(F.col("name").alias("plural"), F.col("n").alias("m"))
    x = a.withColumn("plural", F.concat("name", F.lit("s"))).join(b, "plural")
    keep = F.col("n") >= F.col("m")
    return x.select(F.when(keep, F.col("plural")).otherwise(F.col("name")).alias("alias"), F.when(keep, F.col("name")).otherwise(F.col("plural")).alias("canonical"))


def symmetric_once(edges: DataFrame, symmetric: list[str]) -> DataFrame:
    """Of a symmetric relation's two directions the one with the smaller source stays, weights added; other edges as they are."""
    s = edges.where(F.col("rel").isin(*symmetric)).groupBy(F.least("src", "dst").alias("src"), "rel", F.greatest("src", "dst").alias("dst")).agg(F.sum("weight").alias("weight"))
    return edges.where(~F.col("rel").isin(*symmetric)).select("src", "rel", "dst", "weight").unionByName(s)


# Relations: proposals, approval, and what observation adds


def check_relations(proposed: DataFrame, known: DataFrame, aliases: DataFrame) -> DataFrame:
    """(name, decision, match, confidence, needs_model) of proposed relations, upper-cased and trimmed.

    The first that holds decides: exact or alias (synonym, or inverse where ``aliases`` (alias, canonical, flip) says
    so), the active form of X_BY or the passive of X (inverse .8), the same words in another order (synonym .8),
    more than three words (too_vague .7), else accept_new .5. Blank proposals are invalid.
    """
    n = F.upper(F.btrim("name"))
    p = proposed.select(n.alias("name")).where("name is not null").distinct()
    named = p.where("name != ''")
    k = known.select(F.upper("name").alias("match")).distinct()
    row = lambda df, pr, decision, match, conf, ask: df.select("name", F.lit(pr).alias("pr"), decision.alias("decision"), match.alias("match"), F.lit(conf).alias("confidence"), F.lit(ask).alias("needs_model"))
    lit, match = F.lit, F.col("match")
    a = aliases.select(F.upper("alias").alias("name"), F.col("canonical").alias("match"), F.coalesce("flip", F.lit(False)).alias("flip"))
    active = named.where("name like '%\\\\_BY'").withColumn("base", F.expr("substring(name, 1, length(name) - 3)"))
    active = active.select("name", F.posexplode(F.array(F.concat("base", lit("S")), F.col("base"), F.concat("base", lit("ES")))).alias("o", "match")).join(k, "match")
    active = active.groupBy("name").agg(F.min_by("match", "o").alias("match"))
    passive = named.where("name not like '%\\\\_BY'").withColumn("match", F.concat("name", lit("_BY"))).join(k, "match")
    parts = lambda c: F.split(F.lower(c), "_")
    order = lambda df, c: df.withColumn("w", F.array_join(F.array_sort(F.array_distinct(parts(c))), "_")).withColumn("n", F.size(parts(c)))
    same = order(named, F.col("name")).where("n > 1").join(order(k, match), ["w", "n"])
    x = [
        row(p.where("name = ''").withColumn("match", lit(None).cast("string")), 0, lit("invalid"), match, 1.0, False),
        row(named.withColumn("match", F.col("name")).join(k, "match"), 1, lit("synonym"), match, 1.0, False),
        row(named.join(a, "name"), 2, F.when(F.col("flip"), "inverse").otherwise("synonym"), match, 1.0, False),
        row(active, 3, lit("inverse"), match, 0.8, True),
        row(passive, 3, lit("inverse"), match, 0.8, True),
        row(same, 4, lit("synonym"), match, 0.8, True),
        row(named.withColumn("match", lit(None).cast("string")).where(F.size(F.split("name", "_")) > 3), 5, lit("too_vague"), match, 0.7, True),
        row(named.withColumn("match", lit(None).cast("string")), 6, lit("accept_new"), match, 0.5, True),
    ]
    best = Window.partitionBy("name").orderBy("pr", "match")
    return reduce(DataFrame.unionByName, x).withColumn("r", F.row_number().over(best)).where("r = 1").select("name", "decision", "match", "confidence", "needs_model")


def normalised(edges: DataFrame, known: DataFrame, aliases: DataFrame, rel: str = "rel") -> DataFrame:
    """Edges with ``rel`` upper-cased, trimmed and resolved: a known relation stays, an alias (alias, canonical, flip) becomes its canonical one, with the ends exchanged if it says so."""
    x = edges.withColumn(rel, F.upper(F.btrim(rel)))
    k = known.select(F.upper("name").alias(rel), F.lit(True).alias("_known")).distinct()
    a = aliases.select(F.upper("alias").alias(rel), F.col("canonical").alias("_to"), F.coalesce("flip", F.lit(False)).alias("_flip")).dropDuplicates([rel])
    x = x.join(k, rel, "left").join(a, rel, "left")
    use = F.col("_known").isNull() & F.col("_to").isNotNull()
    flip = use & F.col("_flip")
    out = {c: F.col(c) for c in edges.columns} | {rel: F.when(use, F.col("_to")).otherwise(F.col(rel)), "src": F.when(flip, F.col("dst")).otherwise(F.col("src")), "dst": F.when(flip, F.col("src")).otherwise(F.col("dst"))}
    return x.select(*[c.alias(k) for k, c in out.items()])


def types_with(types: DataFrame, new: DataFrame) -> DataFrame:
    """Registry of types (name, description, parent, bases): ``new`` (name, description, bases) added, those known left as they are; the first base is the parent, none means concept."""
    bases = F.when(F.size(F.coalesce("bases", F.array().cast("array<string>"))) == 0, F.array(F.lit("concept"))).otherwise(F.col("bases"))
    x = new.select(F.lower(F.btrim("name")).alias("name"), F.coalesce("description", F.lit("")).alias("description"), bases.alias("bases")).where("name != ''").dropDuplicates(["name"])
    x = x.select("name", "description", F.col("bases")[0].alias("parent"), "bases")
    return types.select("name", "description", "parent", "bases").unionByName(x.join(types.select("name"), "name", "left_anti"))


def base_types(spark, rows: list[tuple[str, str]]) -> DataFrame:
    """The registry of base types only, from (name, description): each its own base, without a parent."""
    return spark.createDataFrame([(n, d, "", [n]) for n, d in rows], "name string, description string, parent string, bases array<string>")


def approved_types(types: DataFrame, aliases: DataFrame, decided: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(types, aliases) with decisions (name, decision, canonical, bases, evidence): a synonym becomes an alias, a subtype a type below its canonical one, a new one a type of its bases."""
    synonym = decided.where("decision = 'synonym' and canonical != ''").select(F.lower("name").alias("alias"), "canonical")
    below = decided.where("decision = 'subtype' and canonical != ''").select("name", F.col("evidence").alias("description"), F.array("canonical").alias("bases"))
    new = decided.where("decision = 'new'").select("name", F.col("evidence").alias("description"), "bases")
    return types_with(types, below.unionByName(new)), aliases.unionByName(synonym.join(aliases.select("alias"), "alias", "left_anti").dropDuplicates(["alias"]))


def approved_relations(relations: DataFrame, aliases: DataFrame, decided: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(relations, aliases) with decisions (name, decision, canonical, src_types, dst_types, symmetric): synonyms and inverses become aliases, new ones relations."""
    other = decided.where("decision in ('synonym', 'inverse') and canonical != ''").select(F.upper("name").alias("alias"), "canonical", (F.col("decision") == "inverse").alias("flip"))
    new = decided.where("decision = 'new'").select(F.upper("name").alias("name"), "src_types", "dst_types", F.coalesce("symmetric", F.lit(False)).alias("symmetric"))
    return relations.unionByName(new.join(relations.select("name"), "name", "left_anti").dropDuplicates(["name"])), aliases.unionByName(other.join(aliases.select("alias"), "alias", "left_anti").dropDuplicates(["alias"]))


def top_types(observed: DataFrame, key: str, value: str, n: int = 3) -> DataFrame:
    """(key, value, count, rank): the ``n`` values seen most often with each key, of equal ones the first in the alphabet."""
    x = observed.where(F.coalesce(value, F.lit("")) != "").groupBy(key, value).agg(F.count("*").alias("count"))
    return x.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("count"), value))).where(F.col("rank") <= n)


def evolved_types(entities: DataFrame, known: DataFrame, aliases: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(aliases accepted, candidates (name, decision, match, confidence)) from the types that entities (type) have: near names are for review, vague and known ones nothing."""
    seen = entities.select(F.lower(F.btrim("type")).alias("name")).where("name != ''").distinct()
    found = check_types(seen, known, aliases)
    sure = found.where("decision = 'alias'").select(F.col("name").alias("alias"), F.col("match").alias("canonical")).join(aliases.select("alias"), "alias", "left_anti")
    return sure, found.where("decision in ('word_order', 'similar', 'new')")


def evolved_relations(triples: DataFrame, relations: DataFrame, aliases: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(relations with what was observed added to their types, candidates (name, decision, match, confidence, src_types, dst_types)).

    ``triples``: (rel, src_type, dst_type). Names of more than three words are left out; candidates have the three types seen most often at each end.
    """
    t = triples.select(F.upper(F.btrim("rel")).alias("rel"), F.lower("src_type").alias("s"), F.lower("dst_type").alias("d")).where("rel != ''")
    t = t.where(F.size(F.split("rel", "_")) <= 3)
    known = relations.select("name")
    to = known.select("name", F.col("name").alias("canonical")).unionByName(aliases.select(F.upper("alias").alias("name"), "canonical").join(known, "name", "left_anti").dropDuplicates(["name"]))
    own = t.join(to.withColumnRenamed("name", "rel"), "rel")
    seen = own.groupBy("canonical").agg(F.array_sort(F.collect_set(F.when(F.col("s") != "", F.col("s")))).alias("_s"), F.array_sort(F.collect_set(F.when(F.col("d") != "", F.col("d")))).alias("_d"))
    more = lambda c, n: F.concat(c, F.array_except(F.coalesce(n, F.array().cast("array<string>")), c))
    grown = relations.join(seen.withColumnRenamed("canonical", "name"), "name", "left").withColumns({"src_types": more(F.col("src_types"), F.col("_s")), "dst_types": more(F.col("dst_types"), F.col("_d"))}).select(*relations.columns)
    rest = t.join(to.select(F.col("name").alias("rel")), "rel", "left_anti")
    found = check_relations(rest.select(F.col("rel").alias("name")), known, aliases).where("decision not in ('too_vague', 'invalid')")
    for end, col in (("src_types", "s"), ("dst_types", "d")):
        top = top_types(rest, "rel", col).groupBy(F.col("rel").alias("name")).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", F.col(col).alias("v")))), lambda x: x.v).alias(end))
        found = found.join(top, "name", "left").withColumn(end, F.coalesce(end, F.array().cast("array<string>")))
    return grown, found.select("name", "decision", "match", "confidence", "src_types", "dst_types")


def merged_definitions(relations: DataFrame, new: DataFrame) -> DataFrame:
    """Relations (name, description, symmetric, src_types, dst_types) with new definitions: blanks filled, symmetry added, types united, unknown ones added."""
    cols = ["name", "description", "symmetric", "src_types", "dst_types"]
    n = new.where("name != ''").select(*cols).dropDuplicates(["name"])
    a, b = (df.select("name", F.struct(*cols[1:]).alias(k)) for df, k in ((relations, "a"), (n, "b")))
    x = a.join(b, "name", "full_outer")
    none = F.array().cast("array<string>")
    both = lambda c: F.array_distinct(F.concat(F.coalesce(F.col(f"a.{c}"), none), F.coalesce(F.col(f"b.{c}"), none))).alias(c)
    return x.select("name", F.coalesce(F.nullif("a.description", F.lit("")), "b.description", "a.description").alias("description"), (F.coalesce("a.symmetric", F.lit(False)) | F.coalesce("b.symmetric", F.lit(False))).alias("symmetric"), both("src_types"), both("dst_types"))


DECISIONS = "struct<decisions:array<struct<raw:string,decision:string,canonical:string>>>"


def governed(proposals: DataFrame, known: list[str], provider, size: int = 20) -> DataFrame:
    """(raw, decision, canonical): a provider's decisions on proposed names (name), asked in batches of ``size``; names without one are left out."""
    from kgspark.plans import prompts
    from kgspark.plans.providers import completed

    p = proposals.select("name").distinct().withColumn("b", F.floor(F.row_number().over(Window.partitionBy(F.pmod(F.xxhash64("name"), F.lit(64))).orderBy("name")) / size)).withColumn("h", F.pmod(F.xxhash64("name"), F.lit(64)))
    asked = p.groupBy("h", "b").agg(F.array_join(F.array_sort(F.collect_list("name")), "\n").alias("names"))
    asked = asked.withColumn("_ask", F.concat(F.lit("Known: " + ", ".join(known) + "\nProposed:\n"), "names"))
    said = completed(asked, provider, prompts.GOVERN, "_ask").withColumn("d", F.from_json("response", DECISIONS))
    return said.select(F.inline("d.decisions")).select("raw", F.lower("decision").alias("decision"), "canonical").where("raw != ''").dropDuplicates(["raw"])


def mapping_of(decisions: DataFrame) -> DataFrame:
    """(raw, canonical) for ``apply_normalisation``: rejected names become '__REJECTED__', mapped ones their canonical name."""
    return decisions.where("decision in ('map', 'reject')").select("raw", F.when(F.col("decision") == "reject", "__REJECTED__").otherwise(F.col("canonical")).alias("canonical")).where("canonical != ''")
