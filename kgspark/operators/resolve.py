"""Entity resolution: alias maps, canonical entities, merging and de-duplication.

Candidate entities: (seq, mention, canonical, base_types ARRAY<STRUCT<type, score>>, domain_types likewise,
functional_roles, status, aliases ARRAY<STRUCT<text, lang>>, evidence ARRAY<STRUCT<text, language, chunk_id, source>>).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kgspark.functions.text import is_raw_temporal, name_key
from kgspark.lineage import cut
from kgspark.ontology import RAW_TYPES
from kgspark.operators.closure import chain_ends, components

# Modifiers of a service that may be left off, and those that change what it is.
MODIFIERS = ("basic ", "routine ", "corporate ", "general ", "standard ", "walk-in ", "walk in ", "on-site ", "onsite ")
CHANGING = ("remote", "corporate", "travel", "walk-in", "walk in", "on-site", "onsite", "telehealth", "in-person", "in person", "virtual")
# Signs of a document's title.
DOCUMENT_SIGNS = ("knowledge base", "internal operations", "last reviewed", "document owner", "version", "report", "manual", "policy document", "user guide", "reference guide")
LEAST_TYPE, MERGE, VERIFY = 0.5, 0.95, 0.80


def is_raw_value(base_types: Column, mention: Column) -> Column:
    """An entity that is only a date, amount or identifier."""
    return F.exists(F.coalesce(base_types, F.array().cast("array<struct<type:string,score:double>>")), lambda t: t.type.isin(*RAW_TYPES) & (t.score >= LEAST_TYPE)) | is_raw_temporal(mention)


def quality_filter(entities: DataFrame) -> DataFrame:
    named = (name_key(F.col("mention")) != "") | (name_key(F.col("canonical")) != "")
    return entities.where(named & ~is_raw_value(F.col("base_types"), F.coalesce("mention", F.lit(""))))


def drop_orphans(edges: DataFrame, entities: DataFrame) -> DataFrame:
    """Edges both ends of which are a mention or canonical name."""
    names = entities.select(name_key(F.col("mention")).alias("n")).union(entities.select(name_key(F.col("canonical")))).where("n != ''").distinct()
    x = edges
    for end in ("src", "dst"):
        x = x.join(names.withColumnRenamed("n", end), end, "left_semi")
    return x.select(*edges.columns)


def alias_is_safe(alias: Column, canonical: Column) -> Column:
    """Both names agree on every modifier that changes the meaning."""
    has = lambda name, m: F.concat(F.lit(" "), F.lower(name), F.lit(" ")).contains(f" {m} ")
    out = F.lit(True)
    for m in CHANGING:
        out = out & (has(alias, m) == has(canonical, m))
    return out


def alias_map(entities: DataFrame) -> DataFrame:
    """(alias, canonical): mentions and aliases that differ from their canonical name; the last one (by seq) wins.

    ``max_by`` combines on the map side, so an alias of a third of all rows is no hot group.
    """
    c = F.coalesce(F.nullif(name_key(F.col("canonical")), F.lit("")), name_key(F.col("mention")))
    names = F.concat(F.array(F.struct(F.lit(0).alias("i"), F.col("mention").alias("t"))), F.coalesce(F.transform("aliases", lambda a, i: F.struct((i + 1).alias("i"), a.text.alias("t"))), F.array().cast("array<struct<i:int,t:string>>")))
    x = entities.select("seq", c.alias("canonical"), F.inline(names)).select("seq", "i", name_key(F.col("t")).alias("alias"), "canonical")
    x = x.where((F.col("alias") != "") & (F.col("canonical") != "") & (F.col("alias") != F.col("canonical")) & alias_is_safe(F.col("alias"), F.col("canonical")))
    return x.groupBy("alias").agg(F.max_by("canonical", F.struct("seq", "i", "canonical")).alias("canonical"))


def canonical_score(name: Column, top_score: Column, n_evidence: Column, n_roles: Column, known_status: Column, is_alias: Column) -> Column:
    """How well a name would do as the canonical one."""
    words, doc = F.size(F.split(name, r"\s+")), F.lit(False)
    for s in DOCUMENT_SIGNS:
        doc = doc | F.lower(name).contains(s)
    known = F.when(known_status, 2).otherwise(0)
    return 3 * words + 10 * top_score + 2 * n_evidence + 3 * n_roles + known - F.when(doc, 20).otherwise(0) - F.when((words == 1) & (F.octet_length(name) <= 6), 15).otherwise(0) - F.when(is_alias, 5).otherwise(0)


def collapse_services(names: DataFrame) -> DataFrame:
    """(alias, canonical) of services: singular to plural, and with a modifier to without, where the other form exists."""
    n = names.select("name").distinct()
    plural = n.select("name", F.concat("name", F.lit("s")).alias("to"), F.lit(0).alias("p"))
    bare = None
    for i, m in enumerate(MODIFIERS):
        y = n.where(F.col("name").startswith(m)).select("name", F.substring("name", len(m) + 1, 1000).alias("b"))
        y = y.select("name", F.col("b").alias("to"), F.lit(2 * i + 1).alias("p")).unionByName(y.select("name", F.concat("b", F.lit("s")).alias("to"), F.lit(2 * i + 2).alias("p")))
        bare = y if bare is None else bare.unionByName(y)
    found = plural.unionByName(bare).join(n.select(F.col("name").alias("to")), "to", "left_semi")
    first = found.groupBy("name").agg(F.min_by("to", "p").alias("to")).select(F.col("name").alias("alias"), F.col("to").alias("canonical"))
    return chain_ends(first).withColumnRenamed("terminal", "canonical")


def canonical_entities(entities: DataFrame, aliases: DataFrame) -> DataFrame:
    """(name, base_types, domain_types, functional_roles, status, aliases, evidence, n): one row per resolved name, one alias hop."""
    c = F.coalesce(F.nullif(name_key(F.col("canonical")), F.lit("")), name_key(F.col("mention")))
    x = entities.withColumn("name", c).where("name != ''").join(aliases.select(F.col("alias").alias("name"), F.col("canonical").alias("_to")), "name", "left").withColumn("name", F.coalesce("_to", "name")).drop("_to")
    types = lambda col: F.transform(F.filter(F.coalesce(col, F.array().cast("array<struct<type:string,score:double>>")), lambda t: t.score >= LEAST_TYPE), lambda t: t.type)
    strings, langs = F.array().cast("array<string>"), F.array().cast("array<struct<text:string,lang:string>>")
    known = (F.coalesce("status", F.lit("")) != "") & (F.col("status") != "unknown")
    # values of a list are first made distinct with their first place, so what is gathered for a name is its distinct values
    flat = x.select("name", "seq", types(F.col("base_types")).alias("b"), types(F.col("domain_types")).alias("d"), F.coalesce("functional_roles", strings).alias("r"), F.coalesce("aliases", langs).alias("a"), "evidence", "status", known.alias("known"))
    part = lambda col, kind: flat.select("name", "seq", F.lit(kind).alias("kind"), F.posexplode(col).alias("i", "v"))
    lists = part("b", "b").unionByName(part("d", "d")).unionByName(part("r", "r")).groupBy("name", "kind", "v").agg(F.min(F.struct("seq", "i")).alias("at"))
    lists = lists.groupBy("name").pivot("kind", ["b", "d", "r"]).agg(F.array_sort(F.collect_list(F.struct("at", "v"))))
    values = lambda k: F.coalesce(F.transform(k, lambda s: s.v), strings)
    lists = lists.select("name", values("b").alias("base_types"), values("d").alias("domain_types"), values("r").alias("functional_roles"))
    one = flat.groupBy("name").agg(
        F.min_by(F.when(F.col("known"), F.col("status")), F.when(F.col("known"), F.col("seq"))).alias("status"),
        F.sum(F.size(F.coalesce("evidence", F.array().cast(flat.schema["evidence"].dataType)))).alias("n_evidence"),
        F.count("*").alias("n"),
    )
    al = flat.select("name", "seq", F.posexplode("a").alias("i", "v")).groupBy("name", "v").agg(F.min(F.struct("seq", "i")).alias("at"))
    al = al.groupBy("name").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "v"))), lambda s: s.v).alias("aliases"))
    out = one.join(lists, "name", "left").join(al, "name", "left").withColumn("aliases", F.coalesce("aliases", langs.cast(flat.schema["a"].dataType)))
    base = F.when(F.size(F.coalesce("base_types", strings)) > 0, F.col("base_types")).otherwise(F.array(F.lit("concept")))
    return out.select("name", base.alias("base_types"), F.coalesce("domain_types", strings).alias("domain_types"), F.coalesce("functional_roles", strings).alias("functional_roles"), F.coalesce("status", F.lit("")).alias("status"), "aliases", F.col("n_evidence"), "n")


def merge_groups(pairs: DataFrame, entities: DataFrame, verify: Callable[[DataFrame], DataFrame] | None = None, merge: float = MERGE) -> DataFrame:
    """(name, survivor): names joined by pairs of ``merge`` or more, and by those below that ``verify`` keeps; it gets (a, b, sim, group_a, group_b), the groups being those of the sure pairs.

    The survivor has the most evidence, then the longest name in bytes, then the first in the alphabet.
    """
    sure = pairs.where(F.col("sim") >= merge).select("a", "b")
    comp = components(sure)
    if verify is not None:  # pairs that are one already need no question
        soft = pairs.where((F.col("sim") >= VERIFY) & (F.col("sim") < merge))
        for end, col in (("a", "_ca"), ("b", "_cb")):
            soft = soft.join(comp.select(F.col("node").alias(end), F.col("component").alias(col)), end, "left")
        soft = soft.where(~F.coalesce(F.col("_ca") == F.col("_cb"), F.lit(False))).withColumns({"_ca": F.coalesce("_ca", "a"), "_cb": F.coalesce("_cb", "b")})
        comp = components(sure.unionByName(verify(soft.select("a", "b", "sim", F.col("_ca").alias("group_a"), F.col("_cb").alias("group_b"))).select("a", "b")))
    x = comp.join(entities.select(F.col("name").alias("node"), "n_evidence"), "node", "left")
    rank = F.struct(F.coalesce("n_evidence", F.lit(0)).alias("n"), F.octet_length("node").alias("l"))
    best = x.groupBy("component").agg(F.max(rank).alias("top"))
    best = x.join(best, "component").where(rank == F.col("top")).groupBy("component").agg(F.min("node").alias("survivor"))
    return comp.join(best, "component").select(F.col("node").alias("name"), "survivor")


def exact_duplicates(nodes: DataFrame, name: str = "name") -> DataFrame:
    """(name, survivor): spellings that are one name when lower-cased and trimmed; the first in the alphabet survives."""
    x = nodes.where(F.col(name).isNotNull()).select(F.col(name).alias("name"), name_key(F.col(name)).alias("k")).where("k != ''").distinct()
    first = x.groupBy("k").agg(F.min("name").alias("survivor"), F.count("*").alias("n")).where("n > 1")
    return x.join(first, "k").select("name", "survivor")


def moved(edges: DataFrame, survivors: DataFrame) -> DataFrame:
    """``edges`` with the ends that have merged, all columns kept and no self-loops; equal edges are still to be made one."""
    m = survivors.where("name != survivor")
    x = edges
    for end in ("src", "dst"):
        x = x.join(m.select(F.col("name").alias(end), F.col("survivor").alias("_to")), end, "left").withColumn(end, F.coalesce("_to", end)).drop("_to")
    return x.where("src != dst").select(*edges.columns)


def remap(edges: DataFrame, survivors: DataFrame) -> DataFrame:
    """(src, rel, dst, weight) with merged ends: no self-loops, weights of equal edges added."""
    return moved(edges.select("src", "rel", "dst", "weight"), survivors).groupBy("src", "rel", "dst").agg(F.sum("weight").alias("weight"))


def merge_canonical(entities: DataFrame, survivors: DataFrame) -> DataFrame:
    """Entities with the columns of ``canonical_entities``, those of one survivor made one.

    Lists are united, the survivor's own values first and the others' in the order of their names; its
    status stays if it is known, else the first known one; the names that go become aliases (language 'und');
    evidence counts are added. Every list is gathered without repeats.
    """
    m = survivors.where("name != survivor").select("name", "survivor")
    x = entities.join(m, "name", "left").withColumn("to", F.coalesce("survivor", "name")).withColumn("at", F.struct((F.col("to") != F.col("name")).alias("other"), "name"))
    out = entities.select("name").join(m.select("name"), "name", "left_anti")
    for c in ("base_types", "domain_types", "functional_roles"):
        v = x.select("to", F.explode(c).alias("v"), "at", F.array_position(c, F.col("v")).alias("i")).groupBy("to", "v").agg(F.min(F.struct("at", "i")).alias("p"))
        v = v.groupBy(F.col("to").alias("name")).agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "v"))), lambda z: z.v).alias(c))
        out = out.join(v, "name", "left").withColumn(c, F.coalesce(c, F.array().cast("array<string>")))
    known = ~F.coalesce("status", F.lit("")).isin("", "unknown")
    one = x.groupBy(F.col("to").alias("name")).agg(
        F.min_by(F.when(known, F.col("status")), F.when(known, F.col("at"))).alias("_known"),
        F.min_by(F.coalesce("status", F.lit("")), "at").alias("_own"),
        F.sum("n_evidence").alias("n_evidence"),
        F.sum("n").alias("n"),
    )
    lang = dict(entities.dtypes)["aliases"]
    gone = F.when(F.col("to") != F.col("name"), F.array(F.struct(F.col("name").alias("text"), F.lit("und").alias("lang")).cast("struct<text:string,lang:string>"))).otherwise(F.array().cast("array<struct<text:string,lang:string>>"))
    al = x.select("to", "at", F.posexplode(F.concat(F.coalesce("aliases", F.array().cast(lang)), gone.cast(lang))).alias("i", "v")).groupBy("to", "v").agg(F.min(F.struct("at", "i")).alias("p"))
    al = al.groupBy(F.col("to").alias("name")).agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "v"))), lambda z: z.v).alias("aliases"))
    out = out.join(one, "name").join(al, "name", "left").withColumns({"status": F.coalesce("_known", "_own"), "aliases": F.coalesce("aliases", F.array().cast(lang))})
    return out.select(*entities.columns)


def tiered(entities: DataFrame, vectors: DataFrame, verify: Callable[[DataFrame], DataFrame] | None = None, merge: float = MERGE, ask: float = VERIFY) -> tuple[DataFrame, DataFrame]:
    """(alias map, canonical entities) of candidate entities in three tiers.

    Names first: aliases, services that are one (where both forms exist), canonical entities. Then vectors (name, embedding):
    canonical names whose base types meet and whose cosine is ``merge`` or more are one; of those from ``ask`` on the ones
    that ``verify`` keeps; what is linked through others is one too. Pairs are found by ``simjoin``, not by trying all.
    """
    from kgspark.operators.simjoin import similar

    named = alias_map(entities)
    names = entities.select(F.coalesce(F.nullif(name_key(F.col("canonical")), F.lit("")), name_key(F.col("mention"))).alias("name")).where("name != ''").distinct()
    services = entities.where(F.exists("base_types", lambda t: t.type == "service")).select(F.coalesce(F.nullif(name_key(F.col("canonical")), F.lit("")), name_key(F.col("mention"))).alias("name"))
    collapsed = collapse_services(services.join(names, "name", "left_semi"))
    aliases = cut(named.join(collapsed.select("alias"), "alias", "left_anti").unionByName(collapsed))
    canon = cut(canonical_entities(entities, aliases))
    pairs = cut(similar(canon.join(vectors.select("name", "embedding"), "name").select("name", "embedding", "base_types"), ask if verify else merge, "name", "embedding", "base_types"))
    groups = cut(merge_groups(pairs, canon, verify, merge))
    lost = groups.where("name != survivor").select(F.col("name").alias("alias"), F.col("survivor").alias("canonical"))
    # an alias of a name that has merged means the survivor
    aliases = aliases.join(lost.select(F.col("alias").alias("canonical"), F.col("canonical").alias("_to")), "canonical", "left").select("alias", F.coalesce("_to", "canonical").alias("canonical"))
    return aliases.join(lost.select("alias"), "alias", "left_anti").unionByName(lost), merge_canonical(canon, groups)


def semantic_duplicates(nodes: DataFrame, least: float = MERGE, name: str = "name", vec: str = "embedding") -> DataFrame:
    """(name, survivor): nodes linked, directly or not, by a cosine of ``least`` or more; the longest name in bytes survives, of equal ones the first."""
    from kgspark.operators.simjoin import similar

    comp = components(similar(nodes, least, name, vec))
    longest = comp.groupBy("component").agg(F.min(F.struct(F.negate(F.octet_length("node")).alias("l"), "node")).alias("m"))
    return comp.join(longest, "component").select(F.col("node").alias("name"), F.col("m.node").alias("survivor"))


def with_aliases(entities: DataFrame, aliases: DataFrame) -> DataFrame:
    """Entities whose alias list has every alias of the map, without regard to case; new ones with the language 'und'."""
    new = aliases.groupBy(F.col("canonical").alias("name")).agg(F.array_sort(F.collect_set("alias")).alias("_new"))
    x = entities.join(new, "name", "left")
    have = F.transform("aliases", lambda a: F.lower(a.text))
    add = F.transform(F.array_except(F.coalesce("_new", F.array().cast("array<string>")), have), lambda t: F.struct(t.alias("text"), F.lit("und").alias("lang")))
    return x.withColumn("aliases", F.concat("aliases", add)).select(*entities.columns)


