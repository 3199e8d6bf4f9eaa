"""Problem 1: one surviving value per entity and field, by Bayesian fusion with copy detection.

Every row is a claim of its source about each field. Fusion estimates, in a few rounds over
all claims,

* the posterior of each value: its prior times the product of its sources' odds, ``n A / (1 - A)`` with A the
  source's accuracy and n the number of false values to choose from;
* the accuracy of each source: the mean posterior of what it claims;
* the dependence of each pair of sources: sharing values that are probably false is far more
  likely if one copies the other, sharing true ones hardly so. The vote of a source that
  repeats a value of a more accurate source it may copy is discounted by that probability.

The surviving value is the one of greatest log posterior: its log prior plus its vote, one
number. With ``prior="none"`` every value has the same prior, so the vote decides. With
``prior="trust"`` a value's log prior grows by ``TRUST_ODDS`` with each step of the trust of its
best source and by ``TIME_ODDS`` with each microsecond of that source's claim. Both exceed the
greatest difference that votes can make (they are bounded by ``MOST_VOTE``), as the definition
of ``p1_found`` demands: no number of less trusted claims prevails over a more trusted one. What
prior odds leave equal, the votes of independent sources decide: of sources that agree with more trusted
and later claims, as accuracies and dependence come from the same posteriors. A value that nobody claims has
the prior of an unknown source without a time. The sum is exact (decimal).

Scale: claims are reduced to one row per entity, field and value, with the set of its sources;
sources are few (``MAX_SOURCES``), so the set is bounded even if one entity has a third of
all rows. Pair statistics are summed as source x source matrices inside each task, never by
joining an entity's claims with each other.

Defined results: a null id gives nothing; null, blank, placeholder and cut-off values, and
arrays without a real entry, are no claims; a field without claims gives no row; a null or
unknown source has trust 0 and counts as one source; repeated rows are one claim; ties end
with the smaller value; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kgspark.lineage import cut, drop

#: Words that stand for "not known". Values of signs only count as such too.
PLACEHOLDERS = ("n/a", "na", "n.a.", "tbd", "tba", "unknown", "none", "null", "nil", "undefined", "not known", "not available", "missing", "unspecified", "unnamed", "no name")
#: Bound on the number of sources, hence on the matrices (8 bytes x MAX_SOURCES squared) and value sets.
MAX_SOURCES = 2000
#: Parameters of the model: false values to choose from, probability that a copier copies a value, prior of dependence, rounds.
N_FALSE, COPY_RATE, DEPENDENT, ROUNDS = 10, 0.8, 0.2, 5
#: Rounds end once no source's accuracy moves by more than this.
SETTLED = 0.002
#: Bound of a value's vote, and log prior odds of a microsecond and of a step of trust: a microsecond outweighs all votes, a step of trust all times.
MOST_VOTE, TIME_ODDS, TRUST_ODDS = 200, 401, 10**22


def is_value(c: Column) -> Column:
    """Neither null nor blank nor a placeholder nor cut off with an ellipsis."""
    t = F.lower(F.btrim(c, F.lit(" \t\r\n")))
    return c.isNotNull() & t.rlike(r"[\p{L}\p{N}]") & ~t.isin(*PLACEHOLDERS) & ~t.rlike(r"(…|\.\.\.)$")


def claims(entities: DataFrame, sources: DataFrame) -> DataFrame:
    """(id, field, value, source, trust, at): the claims about ids that have two or more rows."""
    several = entities.where("id is not null").groupBy("id").count().where("count > 1").select("id")
    types = F.array_sort(F.array_distinct(F.filter(F.transform("base_types", lambda x: F.btrim(x)), is_value)))
    fields = F.array(
        F.struct(F.lit("canonical_name").alias("field"), F.col("canonical_name").alias("value")),
        F.struct(F.lit("base_types").alias("field"), F.array_join(types, "|").alias("value")),
        F.struct(F.lit("status").alias("field"), F.col("status").alias("value")),
    )
    trust = sources.groupBy(F.col("source").alias("source")).agg(F.max("trust").alias("trust"))
    x = entities.select("id", "source", F.col("updated_at").alias("at"), F.inline(F.filter(fields, lambda f: is_value(f.value))))
    x = x.join(several, "id", "left_semi").join(trust, "source", "left")
    return x.select("id", "field", F.btrim("value").alias("value"), F.coalesce("source", F.lit("")).alias("source"), F.coalesce("trust", F.lit(0)).alias("trust"), "at")


def _votes(sets: pd.Series, weight: np.ndarray, order: np.ndarray, dep: np.ndarray) -> np.ndarray:
    """Log odds of each value from its set of sources, copied votes discounted."""
    out = np.zeros(len(sets))
    for k, s in enumerate(sets):
        s = np.asarray(s, dtype=np.int64)
        if len(s) == 1:
            out[k] = weight[s[0]]
            continue
        s = s[np.argsort(order[s], kind="stable")]
        d = np.tril(COPY_RATE * dep[np.ix_(s, s)], -1)
        out[k] = (weight[s] * np.prod(1 - d, axis=1)).sum()
    return np.clip(out, -MOST_VOTE, MOST_VOTE)


def _pairs(sets: pd.Series, p: np.ndarray, size: int) -> np.ndarray:
    """Sum of p over the rows that hold both sources, for each pair of sources."""
    out = np.zeros((size, size))
    for s, q in zip(sets, p):
        s = np.asarray(s, dtype=np.int64)
        out[np.ix_(s, s)] += q
    return out


def _dependence(true: np.ndarray, false: np.ndarray, both: np.ndarray, acc: np.ndarray) -> np.ndarray:
    """Probability, for each pair, that one of the two copies the other."""
    a = np.sqrt(np.outer(acc, acc))
    same_t, same_f = a * a, (1 - a) ** 2 / N_FALSE
    llr = true * np.log(same_t / (COPY_RATE * a + (1 - COPY_RATE) * same_t))
    llr += false * np.log(same_f / (COPY_RATE * (1 - a) + (1 - COPY_RATE) * same_f))
    llr -= np.maximum(both - true - false, 0) * np.log(1 - COPY_RATE)
    out = 1 / (1 + (1 - DEPENDENT) / DEPENDENT * np.exp(np.clip(llr, -50, 50)))
    np.fill_diagonal(out, 0)
    return out


def fuse(entities: DataFrame, sources: DataFrame, prior: str = "trust") -> DataFrame:
    """(id, field_name, kept_value, posterior, accuracy, n_sources) of the surviving values."""
    if prior not in ("trust", "none"):
        raise ValueError("prior is trust or none")
    spark = entities.sparkSession
    raw = cut(claims(entities, sources))
    names = [r[0] for r in raw.select("source").distinct().orderBy("source").limit(MAX_SOURCES + 1).collect()]
    if len(names) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    size = max(1, len(names))
    number = spark.createDataFrame([(n, i) for i, n in enumerate(names)], "source string, s int")
    # the best claim's prior; without a time, the earliest there is
    exact = lambda c, n, odds: c.cast(f"decimal({n},0)") * F.lit(str(odds)).cast(f"decimal({len(str(odds))},0)")
    at = F.coalesce(F.unix_micros(F.col("at").cast("timestamp")), F.lit(-(1 << 63)).cast("long"))
    unclaimed = F.lit(f"-{(1 << 63) * TIME_ODDS}" if prior == "trust" else "0").cast("decimal(32,0)")
    log_prior = (exact(F.col("trust"), 10, TRUST_ODDS) + exact(at, 19, TIME_ODDS)).cast("decimal(32,0)") if prior == "trust" else F.lit(0).cast("decimal(32,0)")
    values = raw.join(F.broadcast(number), "source").groupBy("id", "field", "value").agg(F.collect_set("s").alias("by"), F.max(log_prior).alias("log_prior"))
    # log priors of the value and of those that nobody claims, relative to the greatest of the field
    top = F.max("log_prior").over(Window.partitionBy("id", "field"))
    values = cut(values.withColumn("prior", (F.col("log_prior") - top).cast("double")).withColumn("others", F.least(F.lit(0.0), (unclaimed - top).cast("double"))))
    drop(raw)
    known = values.groupBy("id", "field").agg(F.array_distinct(F.flatten(F.collect_set("by"))).alias("by"))

    def both_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = np.zeros((size, size))
        for pdf in batches:
            m += _pairs(pdf["by"], np.ones(len(pdf)), size)
        i, j = np.nonzero(m)
        yield pd.DataFrame({"i": i, "j": j, "n": m[i, j]})

    def matrix(rows: pd.DataFrame, col: str) -> np.ndarray:
        m = np.zeros((size, size))
        m[rows["i"], rows["j"]] = rows[col]
        return m

    both = matrix(known.mapInPandas(both_of, "i long, j long, n double").groupBy("i", "j").agg(F.sum("n").alias("n")).toPandas(), "n")
    acc, dep = np.full(size, 0.8), np.zeros((size, size))

    def scored(acc: np.ndarray, dep: np.ndarray) -> DataFrame:
        """``values`` with the posterior p."""
        weight, order = np.log(N_FALSE * acc / (1 - acc)), np.argsort(np.argsort(-acc, kind="stable"))

        def vote(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                yield pdf.assign(vote=_votes(pdf["by"], weight, order, dep), accuracy=[acc[np.asarray(s)].max() for s in pdf["by"]])

        v = values.mapInPandas(vote, "id string, field string, value string, by array<int>, log_prior decimal(32,0), prior double, others double, vote double, accuracy double")
        v = v.withColumn("odds", F.exp(F.col("vote") + F.col("prior")))
        z = v.groupBy("id", "field").agg((F.sum("odds") + F.greatest(F.lit(0), N_FALSE + 1 - F.count("*")) * F.exp(F.max("others"))).alias("z"))
        return v.join(z, ["id", "field"]).withColumn("p", F.col("odds") / F.col("z"))

    for _ in range(ROUNDS):

        def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            t, f = np.zeros((size, size)), np.zeros((size, size))
            for pdf in batches:
                p = pdf["p"].to_numpy()
                t, f = t + _pairs(pdf["by"], p, size), f + _pairs(pdf["by"], 1 - p, size)
            i, j = np.nonzero(t + f)
            yield pd.DataFrame({"i": i, "j": j, "t": t[i, j], "f": f[i, j]})

        rows = scored(acc, dep).select("by", "p").mapInPandas(sums, "i long, j long, t double, f double").groupBy("i", "j").agg(F.sum("t").alias("t"), F.sum("f").alias("f")).toPandas()
        t, f = matrix(rows, "t"), matrix(rows, "f")
        n = np.diag(t) + np.diag(f)
        before, acc = acc, np.clip((np.diag(t) + 1) / (n + 1.25), 0.05, 0.99)
        dep = _dependence(t, f, both, acc)
        if np.abs(acc - before).max() < SETTLED:
            break

    final = scored(acc, dep).withColumn("log_posterior", F.col("log_prior").cast("decimal(38,6)") + F.col("vote").cast("decimal(9,6)"))
    # the greatest log posterior, of equal ones the smaller value
    out = final.groupBy("id", "field").agg(F.min(F.struct((-F.col("log_posterior")).alias("least"), "value", "p", "accuracy", F.size("by").alias("n"))).alias("w"))
    return out.select("id", F.col("field").alias("field_name"), F.col("w.value").alias("kept_value"), F.col("w.p").alias("posterior"), F.col("w.accuracy").alias("accuracy"), F.col("w.n").alias("n_sources"))
