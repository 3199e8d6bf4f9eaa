"""Retrieval: from a question to ranked entities, facts and passages.

Every path is a DataFrame of at most a few dozen rows when it is used; pools are unions with
a rank of the path, of which the first wins.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kgspark.functions.text import tokens
from kgspark.functions.vector import cosine, top_k

# Limits of the retrieval.
FACTS, LEAST_FACT, KEEP_FACTS, MOST_FACTS = 15, 0.25, 3, 12
EXACT, CONTAINS, FULLTEXT, VECTOR, SIBLINGS, PASSAGES, CHUNKS = 3, 5, 5, 10, 20, 15, 15
ONE_HOP, TWO_HOPS, LINES, LEAST_EMBEDDED = 150, 25, 20, 0.9
SECTIONS = (("Key Entities", 25), ("Relationships", 20), ("Facts", 15), ("Passages", 15))


def token_table(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(token, key, tf): the full-text index; to be stored partitioned by token where it is asked often."""
    x = texts.select(F.col(key), F.explode(tokens(F.coalesce(F.col(text), F.lit("")))).alias("token"))
    return x.groupBy("token", key).agg(F.count("*").alias("tf"))


def full_text(index: DataFrame, words: DataFrame, key: str, k: int) -> DataFrame:
    """(key, score): rows with most of the words (column token), then most occurrences, then by key."""
    x = index.join(words.select("token").distinct(), "token", "left_semi").groupBy(key).agg(F.countDistinct("token").alias("score"), F.sum("tf").alias("n"))
    return x.orderBy(F.desc("score"), F.desc("n"), key).limit(k)


def full_text_each(index: DataFrame, words: DataFrame, key: str, k: int) -> DataFrame:
    """(word, key, pos): the k best rows for each phrase (word), by how many of its words they have, then by occurrences."""
    w = words.select("word", F.explode(tokens(F.col("word"))).alias("token")).distinct()
    x = w.join(index, "token").groupBy("word", key).agg(F.countDistinct("token").alias("score"), F.sum("tf").alias("n"))
    x = x.withColumn("pos", F.row_number().over(Window.partitionBy("word").orderBy(F.desc("score"), F.desc("n"), key)))
    return x.where(F.col("pos") <= k).select("word", key, "pos")


def chunks_by_words(index: DataFrame, question: str, keywords: list[str], k: int = 10, each: int = 3) -> DataFrame:
    """(chunk_id, pos): the k passages with most words of the question, then up to ``each`` of every keyword in turn, until there are 2 k or more."""
    spark = index.sparkSession
    asked = spark.createDataFrame([(question, 0), *((w, i) for i, w in enumerate(keywords, 1))], "word string, place int")
    best = full_text_each(index, asked.dropDuplicates(["word"]), "chunk_id", k).join(asked.dropDuplicates(["word"]), "word")
    best = best.where((F.col("place") == 0) | (F.col("pos") <= each))
    first = best.groupBy("chunk_id").agg(F.min(F.struct("place", "pos")).alias("at"))  # at most k + each * keywords rows
    w = Window.orderBy("at", "chunk_id")
    x = first.withColumn("pos", F.row_number().over(w)).withColumn("before", F.count("*").over(Window.orderBy("at.place").rangeBetween(Window.unboundedPreceding, -1)))
    # a keyword is asked only while fewer than 2 k are there
    return x.where((F.col("at.place") == 0) | (F.col("before") < 2 * k)).select("chunk_id", "pos")


def relation_lines(edges: DataFrame, names: DataFrame, most: int = LINES) -> list[str]:
    """Relations out of the names (name, pos) as lines, those of one step first, then paths of two steps from the first five; each once."""
    one = edges.join(names.select(F.col("name").alias("src"), "pos"), "src")
    line = F.concat("src", F.lit(" —["), "rel", F.lit("]→ "), "dst")
    # a fact that repeats the line adds its evidence only
    more = F.when(F.coalesce(F.col("fact"), F.lit("")) == "", "").when(F.startswith("fact", line), F.substr("fact", F.length(line) + 1)).otherwise(F.concat(F.lit(": "), "fact"))
    one = one.orderBy("pos", F.desc("weight"), "rel", "dst").limit(ONE_HOP).select("pos", "weight", F.concat(line, more).alias("line"), "rel", "dst")
    out = [r["line"] for r in one.orderBy("pos", F.desc("weight"), "rel", "dst").collect()]
    a = edges.select("src", "rel", "dst").join(names.where("pos < 5").select(F.col("name").alias("src"), "pos"), "src").toDF("a", "r1", "b", "pos")
    two = a.join(edges.select(F.col("src").alias("b"), F.col("rel").alias("r2"), F.col("dst").alias("c")), "b").where("a != c")
    two = two.orderBy("pos", "a", "r1", "b", "r2", "c").limit(TWO_HOPS)
    out += [f"{r['a']} —[{r['r1']}]→ {r['b']} —[{r['r2']}]→ {r['c']}" for r in two.collect()]
    return list(dict.fromkeys(out))[:most]


def with_vectors(candidates: DataFrame, provider, text: str = "text") -> DataFrame:
    """The candidates as they are if nine in ten have a vector; else all of them with a vector made now."""
    from kgspark.plans.providers import embedded

    n = candidates.agg(F.count("embedding").alias("have"), F.count("*").alias("all")).first()
    if n["have"] >= LEAST_EMBEDDED * n["all"]:
        return candidates
    return embedded(candidates.drop("embedding"), provider, text)


# One step of a question to the entities it names, without a provider


def matched_entities(names: DataFrame, index: DataFrame, question: str, query: list[float] | None = None, most: int = 5, rare: int = 5) -> DataFrame:
    """(name, tier, score): entities whose name stands in the question; else those sharing a rare word with it (in ``rare`` names or fewer, 6 - df each); else the nearest by vector; else those that hold one of its words."""
    q = question.lower()
    inside = names.where(F.contains(F.lit(q), F.lower("name")) & (F.length("name") > 2)).select("name", F.lit(1).alias("tier"), F.octet_length("name").cast("double").alias("score"))
    words = names.sparkSession.range(1).select(F.explode(F.array_distinct(tokens(F.lit(question)))).alias("token"))
    hits = index.join(words, "token", "left_semi").select("token", "name").distinct()
    df = hits.groupBy("token").agg(F.count("*").alias("df")).where(F.col("df") <= rare)
    token = hits.join(df, "token").groupBy("name").agg(F.sum(F.lit(rare + 1) - F.col("df")).cast("double").alias("score")).select("name", F.lit(2).alias("tier"), "score")
    parts = [inside, token]
    if query is not None:
        parts.append(top_k(names, "embedding", query, most, "name").where("score > 0").select("name", F.lit(3).alias("tier"), "score"))
    parts.append(hits.groupBy("name").agg(F.count("*").cast("double").alias("score")).select("name", F.lit(4).alias("tier"), "score"))
    x = reduce(DataFrame.unionByName, parts).groupBy("name").agg(F.min(F.struct("tier", F.negate("score").alias("n"))).alias("m"))
    return x.orderBy("m", "name").limit(most).select("name", F.col("m.tier").alias("tier"), F.negate("m.n").alias("score"))


def without_aliases(question: str, aliases: DataFrame, most: int = 500) -> str:
    """The question with whole words that are an alias replaced by the canonical name, long aliases first; at most ``most`` of those in it."""
    import re

    found = aliases.where(F.contains(F.lit(question.lower()), F.lower("alias")) & (F.length("alias") > 1)).orderBy(F.desc(F.length("alias")), "alias").limit(most).collect()
    for r in found:
        question = re.sub(rf"(?<!\w){re.escape(r['alias'])}(?!\w)", lambda _, to=r["canonical"]: to, question, flags=re.I)
    return question


def entity_facts(edges: DataFrame, name: str, out: int = 50, into: int = 50, two: int = 30) -> DataFrame:
    """(kind, line): relations out of and into an entity, and paths of two steps from it that don't return."""
    e = edges.select("src", "rel", "dst")
    line = F.concat("src", F.lit(" -["), "rel", F.lit("]-> "), "dst")
    a = e.where(F.col("src") == name).select(F.lit("out").alias("kind"), line.alias("line")).distinct().orderBy("line").limit(out)
    b = e.where(F.col("dst") == name).select(F.lit("in").alias("kind"), line.alias("line")).distinct().orderBy("line").limit(into)
    c = e.where(F.col("src") == name).toDF("a", "r1", "b").join(e.toDF("b", "r2", "c"), "b").where("a != c")
    c = c.select(F.lit("two").alias("kind"), F.concat("a", F.lit(" -["), "r1", F.lit("]-> "), "b", F.lit(" -["), "r2", F.lit("]-> "), "c").alias("line")).distinct().orderBy("line").limit(two)
    return a.unionByName(b).unionByName(c)


def exact_names(names: DataFrame, words: DataFrame, k: int = EXACT) -> DataFrame:
    """(word, name): names equal to a word but for case, ``k`` per word."""
    x = words.select("word").distinct().withColumn("l", F.lower("word")).join(names.select("name", F.lower("name").alias("l")), "l")
    return x.withColumn("r", F.row_number().over(Window.partitionBy("word").orderBy("name"))).where(F.col("r") <= k).select("word", "name")


def containing_names(names: DataFrame, words: list[str], k: int = CONTAINS) -> DataFrame:
    """(word, name): names that contain one of a few words without being it, the shortest first, ``k`` per word; one scan of the names."""
    n = names.select("name").distinct()
    hit = F.filter(F.array(*[F.lit(w.lower()) for w in words]), lambda w: F.contains(F.lower("name"), w) & (F.lower("name") != w))
    x = n.select("name", F.explode(hit).alias("word"))
    w = Window.partitionBy("word").orderBy(F.octet_length("name"), "name")
    return x.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k).select("word", "name")


def pool(paths: list[tuple[str, DataFrame]], key: str) -> DataFrame:
    """(key, source, path, pos): each key once, from the first path that has it; positions within a path by its column pos."""
    parts = [df.select(F.col(key), F.lit(name).alias("source"), F.lit(i).alias("path"), F.col("pos")) for i, (name, df) in enumerate(paths)]
    x = reduce(DataFrame.unionByName, parts)
    best = x.groupBy(key).agg(F.min(F.struct("path", "pos", "source")).alias("m"))
    return best.select(key, F.col("m.source").alias("source"), F.col("m.path").alias("path"), F.col("m.pos").alias("pos"))


def relevant_facts(facts: DataFrame, least: float = LEAST_FACT, most: int = MOST_FACTS, keep: int = KEEP_FACTS) -> DataFrame:
    """The best facts: at most ``most``; the first ``keep`` whatever they score, the others of ``least`` or more."""
    x = facts.orderBy(F.desc("score"), "text").limit(most)
    x = x.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "text")))
    return x.where((F.col("rank") <= keep) | (F.col("score") >= least))


def edge_facts(edges: DataFrame, query: list[float], k: int = FACTS) -> DataFrame:
    """The k edges whose vectors are nearest; the best of each relation merged are the best of all."""
    return top_k(edges, "embedding", query, k, "fact")


def chunks_of(mentions: DataFrame, names: DataFrame, chunks: DataFrame, query: list[float], k: int = 3) -> DataFrame:
    """(name, chunk_id, score): the k passages of each name nearest to the query."""
    q = F.array(*[F.lit(float(v)) for v in query])
    x = mentions.join(names.select("name").distinct(), "name", "left_semi").join(chunks.select("chunk_id", "embedding"), "chunk_id")
    x = x.withColumn("score", cosine(F.col("embedding"), q)).drop("embedding")
    w = Window.partitionBy("name").orderBy(F.desc("score"), "chunk_id")
    return x.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k).select("name", "chunk_id", "score")


def chunks_two_hops(edges: DataFrame, mentions: DataFrame, names: DataFrame, most: int = 20) -> DataFrame:
    """(chunk_id): passages that mention a neighbour of the names."""
    from kgspark.operators.graph import undirected

    near = undirected(edges.select("src", "rel", "dst")).join(names.select(F.col("name").alias("node")).distinct(), "node", "left_semi").select(F.col("other").alias("name")).distinct()
    return mentions.join(near, "name", "left_semi").select("chunk_id").distinct().orderBy("chunk_id").limit(most)


def rerank(candidates: DataFrame, query: list[float], k: int = PASSAGES, key: str = "chunk_id") -> DataFrame:
    """The k candidates nearest to the query; those without a vector come last, with -1."""
    q = F.array(*[F.lit(float(v)) for v in query])
    return candidates.withColumn("score", F.when(F.col("embedding").isNull(), F.lit(-1.0)).otherwise(cosine(F.col("embedding"), q))).orderBy(F.desc("score"), key).limit(k)


def assemble(hint: str, parts: dict[str, list[str]]) -> str:
    """The context of an answer: the hint first, then a section for every kind of result there is."""
    out = [hint] if hint else []
    for title, most in SECTIONS:
        items = parts.get(title, [])[:most]
        if items:
            out.append("\n".join([f"## {title}", "\n---\n".join(items) if "Passages" in title else "\n".join(f"- {x}" for x in items)]))
    return "\n\n".join(out)
