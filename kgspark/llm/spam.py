"""Problem 10: pages that consist of stuffed keywords, link lists or tags instead of sentences.

Method: mean pointwise mutual information of neighbouring words from corpus counts. Counts
are of documents, over all of them: how many have a word, how many have two words next to
each other. The information of a pair is taken relative to its greatest possible value given
its words, ``log(n(a, b) / min(n(a), n(b)))``, which makes languages of different size
comparable: neighbours in sentences are each other's usual company, keywords in a list meet by
chance. A document is scored in windows of ``WINDOW`` words; a window is stuffed if

* its mean information, averaged with its neighbouring windows and lowered by the share of
  its collocations that the document repeats excessively, is below ``INCOHERENT``, or
* it repeats its own words (``REPEATED`` of them).

Links, tags and markup count by their characters. A page is spam if stuffed windows and links
make more than half of its characters. Unbroken strings without blanks are neither.

Scale: one pass turns the texts into arrays of word hashes, written once; the counts are
added up inside each task before they are shuffled, and every count of two documents or more
is kept in a table. What every task gets is bounded: words in at least ``WORD_SHARE`` of the
documents and pairs in at least ``PAIR_SHARE`` (a share has at most 1/share times the words of a
document), at most ``MOST_WORDS`` and ``MOST_PAIRS`` of them. The rarer pairs are joined to the
documents that have them, so that no value depends on these limits. A pair that only one
document has was never met. Words are known by 32 bits of a hash: of V different words, each
shares its number with another with the probability V / 2^32 (one in 430 for ten million words), and
then has the counts of both.

Defined results: null and blank texts score 0; texts of fewer than three words are judged by
their links alone; repeated texts count as documents of their own; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgspark.lineage import cut, drop
from kgspark.llm import textscan as ts

WINDOW, INCOHERENT, REPEATED, SHARE = 12, -2.75, 0.34, 0.5
#: Information of a pair that was never met, weight of repeated collocations, and repeats in a document from which they are excessive.
NEVER, REPEAT_WEIGHT, REPEATS, REPEATS_SHARE = -6.0, 1.2, 4, 0.01
WORD_SHARE, PAIR_SHARE, MOST_WORDS, MOST_PAIRS = 2e-4, 1e-4, 1_000_000, 2_000_000
#: Characters without a blank from which a string that is no link is neither sentence nor keyword.
UNBROKEN = 60

LINK = re.compile(r"<[^<>]{1,400}>|\]\((?:https?://|www\.)[^)\s]*\)|https?://\S+|www\.\S+|#\w+")
#: More documents than there can be.
_MANY = 1 << 62


def _scan(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, int, int]]:
    """(word hashes, characters from each word to the next, characters of links, characters) of each text; blanks don't count."""
    for part in ts.slices(texts):
        own, links = [], []
        for t in texts[part]:
            t = t.lower()
            size = 0
            if "http" in t or "<" in t or "#" in t or "www." in t:
                found = [m.span() for m in LINK.finditer(t)]
                size = sum(b - a for a, b in found)
                for a, b in reversed(found):
                    t = t[:a] + " " * (b - a) + t[b:]
            own.append(t)
            links.append(size)
        cp, at = ts.points(own)
        ink = ~ts.of(ts.blanks(), cp)
        a, b = ts.runs(ink)
        total = np.add.reduceat(np.concatenate([ink, [0]]).astype(np.int64), at[:-1])
        long = b - a >= UNBROKEN
        for x, y in zip(a[long].tolist(), b[long].tolist()):
            ink[x:y] = False
        s, e = ts.runs(ts.of(ts.letters(), cp).astype(bool) & ink)
        h = ts.hashes(cp, s, e)
        upto = np.concatenate([[0], np.cumsum(ink)])
        nxt = np.concatenate([s[1:], [len(cp)]]) if len(s) else s
        which = np.searchsorted(s, at)
        # the last word of a text reaches to the end of the text
        nxt[which[1:][which[1:] > which[:-1]] - 1] = at[1:][which[1:] > which[:-1]]
        chars = upto[nxt] - upto[s]
        for k in range(len(own)):
            i, j = which[k], which[k + 1]
            yield h[i:j], chars[i:j], links[k], int(total[k]) + links[k]


def tokens(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(k, w, c, links, total): the scanned documents, one narrow row each."""
    x = docs.select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    kind = x.schema["k"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            w, c, links, total = [], [], [], []
            for h, chars, n, all_ in _scan(pdf["t"].tolist()):
                w.append((h >> np.uint64(32)).astype(np.uint32).view(np.int32))
                c.append(chars.astype(np.int32))
                links.append(n)
                total.append(all_)
            yield pd.DataFrame({"k": pdf["k"], "w": w, "c": c, "links": links, "total": total})

    return x.mapInPandas(run, f"k {kind}, w array<int>, c array<int>, links int, total int")


def _pairs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return ((a.astype(np.int64) << 32) | (b.astype(np.int64) & 0xFFFFFFFF)).astype(np.int64)


def _starts(*sorted_: np.ndarray) -> np.ndarray:
    """Where a new value, or combination of values, begins."""
    if not len(sorted_[0]):
        return np.zeros(0, bool)
    new = np.ones(len(sorted_[0]), bool)
    new[1:] = sorted_[0][1:] != sorted_[0][:-1]
    for x in sorted_[1:]:
        new[1:] |= x[1:] != x[:-1]
    return new


def _together(p: np.ndarray, row: np.ndarray) -> np.ndarray:
    """An order in which equal pairs of one row lie together: by one number made of both, which sorts faster than two."""
    return np.argsort((p ^ (p >> np.int64(31))) * np.int64(-7046029254386353131) + row * np.int64(0x2545F4914F6CDD1D))


class _Sum:
    """Counts by key, compacted now and then, so that a task holds each key about once."""

    def __init__(self) -> None:
        self.keys, self.n, self.new = np.zeros(0, np.int64), np.zeros(0, np.int64), []

    def add(self, keys: np.ndarray) -> None:
        self.new.append(keys)
        if sum(map(len, self.new)) > 2_000_000:
            self.compact()

    def compact(self) -> None:
        keys = np.sort(np.concatenate(self.new)) if self.new else self.keys[:0]
        first = np.flatnonzero(_starts(keys))
        keys, n = keys[first], np.diff(np.concatenate([first, [len(keys)]]))
        both = np.concatenate([self.keys, keys])
        order = np.argsort(both)
        both, n = both[order], np.concatenate([self.n, n])[order]
        first = np.flatnonzero(_starts(both))
        self.keys, self.n, self.new = both[first], np.add.reduceat(n, first) if len(first) else n, []

    def frame(self) -> pd.DataFrame:
        self.compact()
        return pd.DataFrame({"key": self.keys, "n": self.n})


def _flat(col: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """(all values, number of the row of each)."""
    parts = col.tolist()
    sizes = np.array([len(p) for p in parts])
    return (np.concatenate(parts) if len(parts) else np.zeros(0, np.int32)).astype(np.int32), np.repeat(np.arange(len(parts)), sizes)


def _collected(df: DataFrame, least: float, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys and counts of at least ``least``: at most ``most`` of them, the most frequent ones."""
    x = df.groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") >= least).orderBy(F.desc("n"), "key").limit(most).toPandas()
    order = np.argsort(x["key"].to_numpy(), kind="stable")
    return x["key"].to_numpy(np.int64)[order], x["n"].to_numpy(np.int64)[order]


def _find(keys: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(position, found)."""
    if not len(keys):
        return np.zeros(len(x), np.int64), np.zeros(len(x), bool)
    i = np.minimum(np.searchsorted(keys, x), len(keys) - 1)
    return i, keys[i] == x


def _distinct(w: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(pairs of neighbours, their rows), each pair of a row once."""
    same = row[1:] == row[:-1]
    p, r = _pairs(w[:-1], w[1:])[same], row[1:][same]
    order = _together(p, r)
    p, r = p[order], r[order]
    new = _starts(p, r)
    return p[new], r[new]


def information(scanned: DataFrame) -> tuple[DataFrame, tuple[np.ndarray, np.ndarray], DataFrame | None]:
    """((key, m, value) of every pair that two documents have, the frequent ones as sorted arrays, the others as a table or None)."""
    n_docs = scanned.count()

    def word_counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = _Sum()
        for pdf in batches:
            w, row = _flat(pdf["w"])
            each = np.sort(_pairs(row, w))
            total.add(each[_starts(each)] & 0xFFFFFFFF)
        yield total.frame()

    counted = "key long, n long"
    words = cut(scanned.select("w").mapInPandas(word_counts, counted).groupBy("key").agg(F.sum("n").alias("n")).where("n >= 2"))
    sent = scanned.sparkSession.sparkContext.broadcast(_collected(words, max(2, WORD_SHARE * n_docs), MOST_WORDS))

    def pair_counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = _Sum()
        for pdf in batches:
            total.add(_distinct(*_flat(pdf["w"]))[0])
        yield total.frame()

    def with_words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # the least count among the frequent words, and the words whose counts have to be joined
        words, n = sent.value
        for pdf in batches:
            key, least, rest = pdf["key"].to_numpy(np.int64), np.full(len(pdf), _MANY), []
            for w in ((key >> 32) & 0xFFFFFFFF, key & 0xFFFFFFFF):
                i, known = _find(words, w)
                if len(n):
                    least = np.where(known, np.minimum(least, n[i]), least)
                rest.append(np.where(known, -1, w))
            yield pd.DataFrame({"key": key, "m": pdf["n"], "least": least, "a": rest[0], "b": rest[1]})

    pairs = scanned.select("w").mapInPandas(pair_counts, counted).groupBy("key").agg(F.sum("n").alias("n")).where("n >= 2")
    pairs = cut(pairs.mapInPandas(with_words, "key long, m long, least long, a long, b long"))
    # only rare words are joined, so no word has many pairs
    rare = pairs.where("a >= 0 or b >= 0").select("key", F.explode(F.array_distinct(F.array("a", "b"))).alias("w")).where("w >= 0")
    rare = rare.join(words.select(F.col("key").alias("w"), "n"), "w").groupBy("key").agg(F.min("n").alias("n"))
    whole = pairs.where("a < 0 and b < 0").select("key", "m", "least")
    part = pairs.where("a >= 0 or b >= 0").join(rare, "key").select("key", "m", F.least("least", "n").alias("least"))
    value = F.greatest(F.lit(NEVER), F.log((F.col("m") - 1) / F.col("least")))
    valued = cut(whole.unionByName(part).select("key", "m", value.alias("value")))
    drop(pairs, words)
    top = valued.where(F.col("m") >= max(2, PAIR_SHARE * n_docs)).orderBy(F.desc("m"), "key").limit(MOST_PAIRS).toPandas()
    rest = valued
    if len(top):
        m, key = int(top["m"].iloc[-1]), int(top["key"].iloc[-1])
        rest = valued.where((F.col("m") < m) | ((F.col("m") == m) & (F.col("key") > key)))
    order = np.argsort(top["key"].to_numpy(np.int64), kind="stable")
    head = top["key"].to_numpy(np.int64)[order], top["value"].to_numpy(np.float64)[order]
    return valued, head, None if rest.isEmpty() else rest


def scores(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, link_share, stuffed_share) of each document, by characters."""
    scanned = cut(tokens(docs, key, text).withColumn("rid", F.monotonically_increasing_id()))
    _, head, rest = information(scanned)
    sent = docs.sparkSession.sparkContext.broadcast(head)
    kind = scanned.schema["k"].dataType.simpleString()

    def others(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            p, r = _distinct(*_flat(pdf["w"]))
            far = ~_find(sent.value[0], p)[1]
            yield pd.DataFrame({"rid": pdf["rid"].to_numpy()[r[far]], "key": p[far]})

    if rest is None:
        scanned = scanned.withColumns({"pk": F.array().cast("array<long>"), "pv": F.array().cast("array<double>")})
    else:  # pairs too rare to be sent to every task; a pair is in few documents, a document has few of them
        own = scanned.select("rid", "w").mapInPandas(others, "rid long, key long").join(rest, "key")
        own = own.groupBy("rid").agg(F.sort_array(F.collect_list(F.struct("key", "value"))).alias("p"))
        scanned = scanned.join(own.select("rid", F.col("p.key").alias("pk"), F.col("p.value").alias("pv")), "rid", "left")
        scanned = scanned.withColumns({"pk": F.coalesce("pk", F.array().cast("array<long>")), "pv": F.coalesce("pv", F.array().cast("array<double>"))})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            w, row = _flat(pdf["w"])
            c, _ = _flat(pdf["c"])
            value = np.full(max(len(w) - 1, 0), NEVER)
            if len(value):
                pair = _pairs(w[:-1], w[1:])
                at, met = _find(sent.value[0], pair)
                value[met] = sent.value[1][at[met]]
                has = pdf["pk"].map(len).to_numpy()
                if has.any():
                    k = np.concatenate(pdf["pk"].tolist()).astype(np.int64)
                    v = np.concatenate(pdf["pv"].tolist()).astype(np.float64)
                    # a pair has one value in all documents that have it
                    order = np.argsort(k)
                    first = order[_starts(k[order])]
                    at, met = _find(k[first], pair)
                    value[met] = v[first][at[met]]
            stuffed = _stuffed(w, row, c, len(pdf), value)
            total = np.maximum(pdf["total"].to_numpy(), 1)
            yield pd.DataFrame({"doc_id": pdf["k"], "link_share": pdf["links"] / total, "stuffed_share": stuffed / total})

    return scanned.select("k", "w", "c", "links", "total", "pk", "pv").mapInPandas(run, f"doc_id {kind}, link_share double, stuffed_share double")


def _stuffed(w: np.ndarray, row: np.ndarray, c: np.ndarray, n_rows: int, value: np.ndarray) -> np.ndarray:
    """Characters of stuffed windows by row; ``value``: information of each word with the next one."""
    out = np.zeros(n_rows)
    if len(w) < 2:
        return out
    size = np.bincount(row, minlength=n_rows)
    begin = np.concatenate([[0], np.cumsum(size)])
    inside = np.arange(len(w)) - begin[row]
    # information of each word with its follower; the last of a text has none
    info = np.full(len(w), np.nan)
    follow = row[1:] == row[:-1]
    info[:-1] = np.where(follow, value, np.nan)
    # how often the document has the pair of hashes itself
    own = np.zeros(len(w))
    p, r = _pairs(w[:-1], w[1:]), row[:-1]
    order = _together(p, r)
    group = np.cumsum(_starts(p[order], r[order])) - 1
    own[order] = np.bincount(group)[group]
    much = (own >= np.maximum(REPEATS, REPEATS_SHARE * size[row])) & ~np.isnan(info)
    # windows: WINDOW words each, the rest of a text joining its last one
    full = np.maximum(size // WINDOW, 1)
    win = np.minimum(inside // WINDOW, full[row] - 1)
    first = np.concatenate([[True], (win[1:] != win[:-1]) | (row[1:] != row[:-1])])
    g = np.cumsum(first) - 1
    k = g[-1] + 1
    in_row = row[first]
    has = ~np.isnan(info)
    cnt = np.bincount(g[has], minlength=k)
    mean = np.where(cnt > 0, np.bincount(g[has], weights=info[has], minlength=k) / np.maximum(cnt, 1), 0)
    rep = np.bincount(g[much], minlength=k) / np.maximum(cnt, 1)
    each = np.sort(_pairs(g, w))
    distinct = np.bincount(each[_starts(each)] >> 32, minlength=k)
    length = np.bincount(g, minlength=k)
    own_share = 1 - distinct / length
    left = np.where(np.concatenate([[False], in_row[1:] == in_row[:-1]]), np.concatenate([[0], mean[:-1]]), mean)
    right = np.where(np.concatenate([in_row[1:] == in_row[:-1], [False]]), np.concatenate([mean[1:], [0]]), mean)
    smooth = 0.5 * mean + 0.25 * (left + right)
    bad = ((smooth - REPEAT_WEIGHT * rep < INCOHERENT) | (own_share * np.minimum(1, length / WINDOW) >= REPEATED)) & (size[in_row] >= 3)
    np.add.at(out, in_row[bad], np.bincount(g, weights=c, minlength=k)[bad])
    return out


def spam(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id) of the pages that are mostly keywords, links or tags."""
    return scores(docs, key, text).where(F.col("link_share") + F.col("stuffed_share") > SHARE).select("doc_id")
