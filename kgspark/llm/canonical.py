"""Problem 6: mapping freely typed values to the entries of a reference list.

Method: BK-trees under Levenshtein distance, which is a true metric, so the triangle inequality
prunes branches without losing an entry within the threshold. Every candidate comes from a tree:

1. The value as a whole (words reduced to stems, in their order and in alphabetical order, with
   and without fillers, written without blanks) is looked up in a tree over the whole forms of
   the entries' ids and aliases. Distance 0 decides at once.
2. Each of its words is looked up in a tree over the forms of the reference's words (ids,
   aliases and descriptions), a word as it is being distance 0. Entries with such words are ranked
   word by word in any order, rare words weighing more, with filler words of little weight; a
   description need not be covered, only cover the value.

Where the words leave it open, the nearest whole form within the threshold decides (blanks lost
or moved, several damaged words). Two letters changing places are looked up as such, beside the trees.

The result is a pure function of the value's words, so every different sequence of words is worked
out once and joined back; a value that a third of all rows have costs no more than another. The
entries are sent to the tasks in shards of at most ``MAX_ENTRIES``, each with trees of its own;
weights come from the words of the whole list (at most ``MAX_WORDS`` of them, or it is
refused), so scores of all shards are comparable, and the merged winners are those of one shard.

Defined results: null and blank values are left out; values like nothing in the list are
``UNMATCHED``; of equally good entries the one first in the alphabet wins; an empty reference
matches nothing; an empty table gives no rows; repeated rows give repeated rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNMATCHED, MAX_ENTRIES, MAX_WORDS, REMEMBERED = "UNMATCHED", 100_000, 1_000_000, 500_000
#: Least scores of a match by id or alias, by description, and by the whole phrase.
BY_NAME, BY_TEXT = 0.66, 0.6
#: Least part of a value that two or more of its words must make up if they are all that it shares with an entry.
FEW_WORDS = 0.4
#: Score from which words decide without the phrase as a whole.
SURE = 0.8
#: Words that carry little meaning of their own.
FILLERS = frozenset("a an the is are was were be being been has have had of for with to in at on by from as its it this that which who now sic currently rel relation so and or".split())
#: Weight of a filler word, and of an unknown word of up to three letters.
LIGHT, SHORT = 0.08, 0.25

_CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")
_WORD = re.compile(r"[^\W_]+")


def words(value: str) -> list[str]:
    return [w.lower() for w in _WORD.findall(_CAMEL.sub(" ", value))]


def stem(w: str) -> str:
    """The word without common English endings; crude, but the same for the forms of one word."""
    while True:
        for end in ("s", "ing", "ed", "er"):
            if w.endswith(end) and len(w) - len(end) >= 3 and not w.endswith("ss"):
                w = w[: -len(end)]
                break
        else:
            return w[:-1] if len(w) > 3 and w[-1] in "ey" else w


def distance(a: str, b: str) -> int:
    """Levenshtein distance, one word of bits for a column."""
    return _distance(positions(a), len(a), b)


def positions(a: str) -> dict[str, int]:
    """Where each letter stands in ``a``, as bits."""
    out: dict[str, int] = {}
    for i, c in enumerate(a):
        out[c] = out.get(c, 0) | 1 << i
    return out


def _distance(at: dict[str, int], n: int, b: str) -> int:
    if not n or not b:
        return n + len(b)
    mask, top = (1 << n) - 1, 1 << n - 1
    pv, mv, score = mask, 0, n
    get = at.get
    for c in b:
        eq = get(c, 0)
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv)
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph = (ph << 1) | 1
        xv = eq | mv
        pv = ((mh << 1) | ~(xv | ph)) & mask
        mv = ph & xv & mask
    return score


class BKTree:
    """Strings under ``distance``; ``within`` gives every one at a distance of at most r."""

    def __init__(self, items: Iterator[str]):
        self.root: tuple[str, dict] | None = None
        for x in items:
            self.add(x)

    def add(self, x: str) -> None:
        if self.root is None:
            self.root = (x, {})
            return
        node = self.root
        while True:
            d = distance(x, node[0])
            if d == 0:
                return
            if d not in node[1]:
                node[1][d] = (x, {})
                return
            node = node[1][d]

    def within(self, x: str, r: int) -> list[tuple[int, str]]:
        out, todo, at, size = [], [self.root] if self.root else [], positions(x), len(x)
        while todo:
            y, below = todo.pop()
            d = _distance(at, size, y)
            if d <= r:
                out.append((d, y))
            for k in range(d - r, d + r + 1):
                if k in below:
                    todo.append(below[k])
        return sorted(out)


class Vocabulary:
    """The words of the whole reference: forms, numbers of names that have them, and weights."""

    def __init__(self, typed: list[str], df: dict[str, int], n_names: int):
        self.df, self.light = df, {stem(w) for w in FILLERS} | FILLERS
        self.most = math.log(1 + n_names)
        self.weight = {w: LIGHT if w in self.light else math.log(1 + n_names / n) for w, n in df.items()}
        # typed forms of the words, so that a damaged letter is looked for where it was typed
        self.form: dict[str, str] = {w: w for w in sorted(df)}
        for w in sorted(typed):
            for f in (w, *(stem(w) + end for end in ("", "s", "ing", "ed", "er"))):
                if len(f) > 3 and w not in self.light:
                    self.form.setdefault(f, stem(w))
        self.tree = BKTree(iter(sorted(self.form)))
        self.near: dict[str, list[tuple[float, str]]] = {}
        self.weights: dict[str, float] = {}

    @staticmethod
    def of(entries: list[tuple[str, str, list[str]]]) -> tuple[set[str], Counter, int]:
        """(typed words, number of names that have each stem, number of names)."""
        typed, df, n = set(), Counter(), 0
        for i, text, aliases in entries:
            for name in [i, *(a for a in aliases or [] if a), *([text] if text else [])]:
                ws = words(name)
                typed.update(ws)
                df.update({stem(w) for w in ws})
                n += 1
        return typed, df, n

    def alike(self, w: str) -> list[tuple[float, str]]:
        """(similarity, word of the reference) of the words within reach."""
        got = self.near.get(w)
        if got is None:
            got = [(1.0, self.form[x]) for _, x in self.tree.within(stem(w), 0) if x in self.weight]
            if not got:
                best: dict[str, float] = {}
                found = [(1, x) for x in swaps(w) if x in self.form and len(x) > 3]
                # two edits are only believed in long words
                found += [(d, x) for d, x in self.tree.within(w, 1 if len(w) < 9 else 2) if len(x) > 3] if len(w) > 3 else []
                for d, x in found:
                    if self.form[x] not in self.light:
                        best[self.form[x]] = max(best.get(self.form[x], 0), 1 - 0.8 * d / max(4, len(w)))
                got = [(v, x) for x, v in best.items()]
            if len(self.near) > REMEMBERED:
                self.near.clear()
            self.near[w] = got
        return got

    def unknown(self, w: str) -> float:
        """Weight of a word like none of the reference's."""
        got = self.weights.get(w)
        if got is None:
            filler = len(w) <= 4 and any(abs(len(w) - len(f)) < 2 and distance(w, f) <= 1 for f in FILLERS if len(f) > 1)
            if len(self.weights) > REMEMBERED:
                self.weights.clear()
            got = self.weights[w] = LIGHT if filler else SHORT * self.most if len(w) <= 3 else self.most
        return got


class Reference:
    """A shard of the entries, (id, description, aliases) each, under the vocabulary of the whole list."""

    def __init__(self, entries: list[tuple[str, str, list[str]]], vocabulary: Vocabulary | None = None):
        self.vocabulary = v = vocabulary or Vocabulary(*Vocabulary.of(entries))
        self.names: list[tuple[str, list[str], bool]] = []
        self.whole: dict[str, str] = {}
        for i, text, aliases in sorted(entries, key=lambda e: e[0]):
            for name in [i, *(a for a in aliases or [] if a)]:
                typed = words(name)
                ws = [stem(w) for w in typed]
                self.names.append((i, ws, True))
                for form in ("".join(ws), "".join(sorted(ws)), "".join(typed)):
                    self.whole.setdefault(form, i)
            if text:
                self.names.append((i, [stem(w) for w in words(text)], False))
        self.by_word: dict[str, list[int]] = defaultdict(list)
        for k, (_, ws, _) in enumerate(self.names):
            for w in set(ws):
                self.by_word[w].append(k)
        self.total = [sum(v.weight[w] for w in ws) for _, ws, _ in self.names]
        self.phrases = BKTree(iter(sorted(self.whole)))

    def match(self, value: str) -> tuple[float, str]:
        """(score, id), or (0, UNMATCHED)."""
        return decided([self.found(words(value))])

    def found(self, typed: list[str]) -> tuple[float, str, list[tuple[int, int, str, int, str]]]:
        """(score, id) by words, and the nearest whole forms: (number of the value's form, distance, form, its length, id)."""
        ws = [stem(w) for w in typed]
        if not ws:
            return 0.0, "", []
        light = self.vocabulary.light
        bare = [w for w in ws if w not in light]
        near = []
        for n, key in enumerate(("".join(ws), "".join(sorted(ws)))):
            for _, x in self.phrases.within(key, 0):
                return 0.0, "", [(n, 0, x, len(key), self.whole[x])]
        for n, key in enumerate(dict.fromkeys(("".join(typed), "".join(ws), "".join(bare), "".join(sorted(bare)))), 2):
            if len(key) > 4:
                found = self.phrases.within(key, max(1, len(key) // 8)) + [(1, x) for x in swaps(key) if x in self.whole]
                if found:
                    d, x = min(found)
                    near.append((n, d, x, len(key), self.whole[x]))
        return (*self._by_words(typed, ws), near)

    def _by_words(self, typed: list[str], ws: list[str]) -> tuple[float, str]:
        v = self.vocabulary
        asked, got = 0.0, defaultdict(dict)
        for n, w in enumerate(ws):
            near = [x for x in v.alike(typed[n]) if w not in v.light or x[1] == w]
            asked += LIGHT if w in v.light else max((v.weight[x] for _, x in near), default=v.unknown(typed[n]))
            for s, x in near:
                for k in self.by_word.get(x, ()):
                    if s * v.weight[x] > got[k].get(n, (0, ""))[0]:
                        got[k][n] = (s * v.weight[x], x)
        best = (0.0, "")
        for k, hit in got.items():
            i, own, name = self.names[k]
            once: dict[str, float] = {}
            for s, x in hit.values():
                once[x] = max(once.get(x, 0), s)
            m = sum(once.values())
            heavy = [x for x in once if x not in v.light]
            p, r = m / asked, m / self.total[k]
            if name:
                score = 2 * p * r / (p + r) if p + r else 0
                ok = heavy and score >= BY_NAME
            else:
                score = p * (0.55 + 0.45 * min(1, r / 0.6))
                specific = len(heavy) >= 2 or any(v.df[x] == 1 and (x in ws or len(x) > 5) for x in heavy)
                ok = specific and p >= BY_TEXT and r >= 0.2 and score >= 0.55
            if not ok and len(heavy) >= 2 and any(x in ws for x in heavy) and p >= FEW_WORDS:
                ok, score = True, 0.5 * score
            if ok and (score > best[0] or score == best[0] and i < best[1]):
                best = (score, i)
        return best


def decided(found: list[tuple[float, str, list]]) -> tuple[float, str]:
    """(score, id) from what the shards have ``found`` of a value, or (0, UNMATCHED)."""
    best, nearest = (0.0, ""), {}
    for score, i, near in found:
        if i and (score > best[0] or score == best[0] and i < best[1]):
            best = (score, i)
        for n, d, form, size, own in near:
            if n not in nearest or (d, form, own) < nearest[n][:3]:
                nearest[n] = (d, form, own, size)
    for n in sorted(nearest):
        d, _, own, size = nearest[n]
        if n < 2:  # the same words
            return 2.0, own
        if best[0] < SURE and (not best[1] or d <= 1):
            return max(best[0], 1 - d / size - 0.5), own
    return best if best[1] else (0.0, UNMATCHED)


def swaps(w: str) -> list[str]:
    """``w`` with two neighbouring letters changing places."""
    return [w[:i] + w[i + 1] + w[i] + w[i + 2 :] for i in range(len(w) - 1) if w[i] != w[i + 1]]


def word_form(value: Column) -> Column:
    """The words of a value, lower-cased, with a blank between them: what ``words`` finds."""
    x = F.regexp_replace(value, r"(?<=[a-z0-9])(?=[A-Z])", " ")
    return F.btrim(F.lower(F.regexp_replace(x, r"[^\p{L}\p{N}]+", " ")))


def mapped(df: DataFrame, value: str, reference: DataFrame, key: str = "relation_id", text: str = "description", aliases: str = "aliases", shards: int = 1) -> DataFrame:
    """``df`` with ``matched_id`` and ``match_score`` beside every value that is neither null nor blank.

    A value that exactly equals an id is given that id with the score 3.
    """
    spark = df.sparkSession
    entries = reference.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"), F.col(aliases).alias("aliases")).where("key is not null")
    shards = max(shards, -(-entries.count() // MAX_ENTRIES))
    clash = [c for c in df.columns if c.lower() in ("matched_id", "match_score")]
    x = df.drop(*clash).where(F.col(value).isNotNull() & (F.btrim(F.col(value), F.lit(" \t\r\n")) != ""))
    # one short string per entry; joined without a hint, so a long list is not broadcast
    ids = entries.select(F.col("key").alias("__id")).distinct()
    x = x.join(ids, F.col(value) == F.col("__id"), "left").withColumn("__form", word_form(F.col(value)))
    # spread by another expression than distinct's own, or it would be left to the few partitions that a few bytes get
    forms = x.where("__id is null").select("__form").distinct().repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), F.crc32("__form"))
    vocabulary = spark.sparkContext.broadcast(_vocabulary(entries))
    found = None
    for s in range(shards):
        part = entries.where(F.pmod(F.xxhash64("key"), F.lit(shards)) == s).collect()
        sent = spark.sparkContext.broadcast(sorted((r[0], r[1], tuple(r[2] or ())) for r in part))

        def run(batches: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            ref = Reference(sent.value, Vocabulary(*vocabulary.value))
            for pdf in batches:
                rows = [(f, *ref.found(f.split())) for f in pdf["__form"]]
                yield pd.DataFrame([(f, s, i, [dict(zip(_NEAR, n)) for n in near]) for f, s, i, near in rows], columns=["__form", "score", "i", "near"])

        own = forms.mapInPandas(run, f"__form string, {_FOUND}")
        found = own if found is None else found.unionByName(own)

    def decide(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [decided([(g["score"], g["i"], [tuple(n[c] for c in _NEAR) for n in g["near"]]) for g in all_]) for all_ in pdf["all"]]
            yield pd.DataFrame({"__form": pdf["__form"], "match_score": [r[0] for r in rows], "matched_id": [r[1] for r in rows]})

    # as many findings of a value as there are shards
    all_ = F.struct("score", "i", "near")
    found = found.select("__form", F.array(all_).alias("all")) if shards == 1 else found.groupBy("__form").agg(F.collect_list(all_).alias("all"))
    found = found.mapInPandas(decide, "__form string, match_score double, matched_id string")
    out = x.join(found, "__form", "left")
    exact = F.col("__id").isNotNull()
    out = out.withColumns({"match_score": F.when(exact, 3.0).otherwise(F.col("match_score")), "matched_id": F.when(exact, F.col("__id")).otherwise(F.col("matched_id"))})
    return out.drop("__form", "__id")


_NEAR = ("n", "d", "form", "size", "id")
_FOUND = "score double, i string, near array<struct<n int, d int, form string, size int, id string>>"


def _vocabulary(entries: DataFrame) -> tuple[list[str], dict[str, int], int]:
    """What ``Vocabulary`` is made of, counted over all entries."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            typed, df, n = Vocabulary.of(list(zip(pdf["key"], pdf["text"], pdf["aliases"].map(lambda a: list(a) if a is not None else []))))
            rows = [(0, w, 1) for w in typed] + [(1, w, c) for w, c in df.items()] + [(2, "", n)]
            yield pd.DataFrame(rows, columns=["kind", "w", "n"])

    rows = entries.mapInPandas(run, "kind int, w string, n long").groupBy("kind", "w").agg(F.sum("n").alias("n")).limit(MAX_WORDS + 1).collect()
    if len(rows) > MAX_WORDS:
        raise ValueError(f"the reference has more than {MAX_WORDS} words")
    return [r["w"] for r in rows if r["kind"] == 0], {r["w"]: r["n"] for r in rows if r["kind"] == 1}, sum(r["n"] for r in rows if r["kind"] == 2)
