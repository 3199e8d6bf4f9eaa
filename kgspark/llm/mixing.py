"""Problem 9: mixing sources to target shares of the total size in tokens.

Method: subset-sum budget fitting. Documents are counted by exact token length. A source gets
its share of the budget in whole passes over its documents, at most ``max_repeats``; the rest
of its budget is fitted by a bounded-knapsack dynamic programme over the lengths, so that the
tokens taken come as close below the budget as the lengths allow. Which documents of a length
are taken is decided by a seeded hash.

The dynamic programme runs on the last ``WINDOW`` tokens (or ``LONGEST`` times the longest document) only: before it, every length gives the same
proportion of its documents, whose number needs no search; the table of the programme is a
bitset and the step of each sum, whatever the corpus. Beyond it the fit is not proven to be exact.

Scale: documents are tokenised in one pass without shuffle; what is shuffled is one small row
per document. The programme of a source reads one row per distinct length. A length that a
third of all documents share is no hot group: its documents are counted by 64 ranges of the
hash, ranges below the cut are taken whole, and only the range at the cut is ranked.

Defined results: documents with a null source or a source not in the list are not mixed and
do not count; null and empty texts have no tokens and are never needed; a source without
documents stays below its share; null or negative shares and repeats count as 0; repeated
rows are documents of their own; empty tables give an empty mix.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgspark.lineage import cut

#: Tokens left to the dynamic programme, ranges of the hash, seed, and the tokenizer's vocabulary (a file of token ranks).
WINDOW, RANGES, SEED, VOCABULARY = 1 << 15, 64, 42, "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The programme sees at least so many times the longest document.
LONGEST = 8
#: Fixed value: the split pattern that belongs to this vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_encodings: dict = {}


def _encoding(path: str):
    import tiktoken

    if path not in _encodings:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encodings[path] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encodings[path]


def token_lengths(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", vocabulary: str = VOCABULARY) -> DataFrame:
    """(key, source, n): tokens of each whole text that has a source."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = _encoding(vocabulary)
        for pdf in batches:
            yield pd.DataFrame({"k": pdf["k"], "source": pdf["source"], "n": [len(enc.encode_ordinary(t)) if t else 0 for t in pdf["t"]]})

    x = docs.where(F.col(source).isNotNull()).select(F.col(key).alias("k"), F.col(source).alias("source"), F.col(text).alias("t"))
    kind = x.schema["k"].dataType.simpleString()
    return x.mapInPandas(run, f"k {kind}, source string, n long")


def fit(lengths: np.ndarray, counts: np.ndarray, budget: int, window: int = WINDOW) -> np.ndarray:
    """How many documents of each length to take, so that their tokens come as close to ``budget`` from below as possible.

    Exact if the budget is at most ``window``, or ``LONGEST`` times the longest document; beyond it the proportional part is fixed first.
    """
    take = np.zeros(len(lengths), dtype=np.int64)
    window = max(window, LONGEST * int(lengths.max(initial=0)))
    total = int((lengths * counts).sum())
    if budget >= total:
        return counts.copy()
    if budget > window:
        take = (counts * ((budget - window) / total)).astype(np.int64)
        left = budget - int((lengths * take).sum())
        for k in np.argsort(-lengths, kind="stable"):  # what rounding down left, longest first
            more = min(int(counts[k] - take[k]), max(0, (left - window // 2) // int(lengths[k])))
            take[k] += more
            left -= more * int(lengths[k])
    left = budget - int((lengths * take).sum())
    mask, reached, steps = (1 << (left + 1)) - 1, 1, []
    by = np.zeros(left + 1, np.int32)  # the step that first reached each sum
    for k in range(len(lengths)):
        n, size = int(min(counts[k] - take[k], left // max(1, lengths[k]))), int(lengths[k])
        part = 1
        while n > 0:
            part = min(part, n)
            new = (reached << (part * size)) & mask & ~reached
            if new:
                bits = np.unpackbits(np.frombuffer(new.to_bytes(left // 8 + 1, "little"), np.uint8), bitorder="little")
                by[np.flatnonzero(bits)] = len(steps)
            steps.append((k, part))
            reached |= new
            n -= part
            part *= 2
        if reached >> left & 1:
            break
    at = reached.bit_length() - 1
    while at:
        k, part = steps[by[at]]
        take[k] += part
        at -= part * int(lengths[k])
    return take


def plan(lengths: DataFrame, sources: DataFrame, window: int = WINDOW) -> DataFrame:
    """(source, n, docs, take, passes, budget): documents of each length to use once more than the whole passes."""
    s = sources.where("source is not null").groupBy("source").agg(F.max(F.greatest(F.coalesce("target_share", F.lit(0.0)), F.lit(0.0))).alias("share"), F.max(F.greatest(F.coalesce("max_repeats", F.lit(0)), F.lit(0))).alias("most"))
    hist = lengths.where("n > 0").groupBy("source", "n").agg(F.count("*").alias("docs"))
    # shares are of what the listed sources hold; the sources are a small fixed list, as the broadcast's check by AQE finds
    hist = hist.join(s, "source", "right")
    total = hist.agg(F.coalesce(F.sum(F.col("n") * F.col("docs")), F.lit(0)).alias("t")).first()["t"]

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        share, most = float(pdf["share"].iloc[0]), int(pdf["most"].iloc[0])
        h = pdf.dropna(subset=["n"]).sort_values("n")
        n, docs = h["n"].to_numpy(np.int64), h["docs"].to_numpy(np.int64)
        size, budget = int((n * docs).sum()), int(share * total)
        passes = min(most, budget // size) if size else 0
        take = fit(n, docs, budget - passes * size, window) if passes < most and len(n) else np.zeros(len(n), np.int64)
        if not len(n):  # no documents: every copy there may be is used
            n = docs = take = np.zeros(1, np.int64)
            passes = most
        return pd.DataFrame({"source": pdf["source"].iloc[0], "n": n, "docs": docs, "take": take, "passes": passes, "most": most, "share": share, "budget": budget, "total": total})

    return hist.groupBy("source").applyInPandas(one, "source string, n long, docs long, take long, passes long, most long, share double, budget long, total long")


def shares(planned: DataFrame) -> DataFrame:
    """(source, target_share, actual_share, tokens, budget, missed, below): what the mix holds.

    ``below`` marks sources whose fitted mix uses every document as often as allowed and yet ends before the
    budget; ``missed`` is how many tokens the fit of the others leaves open.
    """
    tokens = F.sum(F.col("n") * (F.col("docs") * F.col("passes") + F.col("take")))
    x = planned.groupBy("source").agg(
        F.max("share").alias("target_share"), tokens.alias("tokens"), F.max("budget").alias("budget"), F.max("passes").alias("passes"), F.max("most").alias("most"), F.max("total").alias("total")
    )
    below = (F.col("tokens") < F.col("budget")) & (F.col("passes") >= F.col("most"))
    actual = F.when(F.col("total") > 0, F.col("tokens") / F.col("total")).otherwise(F.lit(0.0))
    return x.select("source", "target_share", actual.alias("actual_share"), "tokens", "budget", F.when(below, 0).otherwise(F.col("budget") - F.col("tokens")).alias("missed"), below.alias("below"))


def mix(lengths: DataFrame, planned: DataFrame, seed: int = SEED) -> DataFrame:
    """(source, k, n, copies): every document of the mix and how often it is used."""
    h = lengths.where("n > 0").withColumn("h", F.xxhash64(F.lit(seed), "k"))
    h = h.withColumn("r", F.pmod(F.shiftright("h", 32), F.lit(RANGES)).cast("int"))
    per = h.groupBy("source", "n", "r").agg(F.count("*").alias("c"))
    below = F.sum("c").over(_by("source", "n").orderBy("r").rowsBetween(-(1 << 31), -1))
    per = per.withColumn("below", F.coalesce(below, F.lit(0)))
    per = per.join(planned.where("n > 0").select("source", "n", "take", "passes"), ["source", "n"])
    x = h.join(per, ["source", "n", "r"])
    whole = x.where(F.col("below") + F.col("c") <= F.col("take")).withColumn("more", F.lit(1))
    none = x.where(F.col("below") >= F.col("take")).withColumn("more", F.lit(0))
    at = x.where((F.col("below") < F.col("take")) & (F.col("below") + F.col("c") > F.col("take")))
    at = at.withColumn("more", (F.row_number().over(_by("source", "n").orderBy("h", "k")) + F.col("below") <= F.col("take")).cast("int"))
    cols = ["source", "k", "n", (F.col("passes") + F.col("more")).alias("copies")]
    return whole.select(*cols).unionByName(none.select(*cols)).unionByName(at.select(*cols)).where("copies > 0")


def _by(*cols: str):
    from pyspark.sql import Window

    return Window.partitionBy(*cols)


def mixed(docs: DataFrame, sources: DataFrame, vocabulary: str = VOCABULARY) -> tuple[DataFrame, DataFrame]:
    """The lengths (written once) and the plan."""
    lengths = cut(token_lengths(docs, vocabulary=vocabulary).join(sources.select("source").distinct(), "source", "left_semi"))
    return lengths, plan(lengths, sources)
