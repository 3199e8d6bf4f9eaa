"""Problem 8: passages of evaluation items inside corpus documents.

Method: all normalised five-word windows of the items make a hash set, which every task gets.
Documents are scanned once, window by window, without shuffle; only a document with a hit is
verified against the items hit: its words around the hits are aligned with the item's words in order.

Telling words are figures and words of few items (names above all), counted over the different
texts of all items. An item's sentence (or the part of it that is there) is held if most of its telling words are matched, so that a
sentence of the same pattern about other names or figures is none; a telling word may be
misspelt. The document holds the item if the matched words of held sentences are at least
half of the item's words, all in one passage. ``remove`` cuts the spans found out of the text.

Size of what is sent to the tasks: the items, at most ``MAX_CHARS`` characters at a time; a
larger evaluation set is worked through in blocks of that size.

Defined results: null and empty texts and items hold nothing and are held by nothing; items
shorter than five words are matched as a whole; equal items are each reported; a repeated
document row is reported once per row; empty tables give no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words of a window, least share of an item's words, and the size of a block of items.
WINDOW, SHARE, MAX_CHARS = 5, 0.5, 20_000_000
#: A word is telling if at most so many items (or this share of them) have it.
FEW, FEW_SHARE = 3, 0.005
#: Least part of a sentence's telling words, names counting twice as much as figures, that must be matched.
TOLD = 0.6
#: Words from a matched word to the end of its sentence that count as matched with it.
NEAR = 3
#: Least likeness of a misspelt word: twice the letters in common order of all letters.
ALIKE = 0.75
#: Words by which parts of a document are told apart when their reach is remembered.
STEP = 64

WORD = re.compile(r"\w+")
END = re.compile(r"[.!?؟]+(?:\s|$)|[\r\n]+")


def low(t: str) -> str:
    """``t`` in lower case, letter by letter of the same length, so that positions are those of ``t``."""
    x = t.lower()
    return x if len(x) == len(t) else "".join(c.lower()[0] for c in t)


class Index:
    """The windows of a block of items, and what verification needs; ``shared``: words of too many items to tell them apart."""

    def __init__(self, items: list[tuple[int, str]], shared: set[str]):
        self.ids, self.words, self.sentence, self.ends = [], [], [], []
        at: dict[tuple, int] = {}
        for i, text in items:
            words, sent, ends = [], [], {}
            for k, part in enumerate(END.split(text or "")):
                w = WORD.findall(low(part))
                ends[k] = (len(words), len(words) + len(w))
                words += w
                sent += [k] * len(w)
            if not words:
                continue
            same = (tuple(words), tuple(sent))
            if same in at:  # equal items are verified once
                self.ids[at[same]].append(i)
            else:
                at[same] = len(self.ids)
                self.ids.append([i])
                self.words.append(words)
                self.sentence.append(sent)
                self.ends.append(ends)
        own = {w for words in self.words for w in words}
        self.telling = {w for w in own if w not in shared or any(c.isdigit() for c in w)}
        self.vocab = {w: k + 1 for k, w in enumerate(sorted(own))}
        self.windows: dict[int, list[tuple[int, int]]] = {}
        for k, words in enumerate(self.words):
            n = min(WINDOW, len(words))
            for o in range(len(words) - n + 1):
                w = words[o : o + n]
                self.windows.setdefault(self._hash(np.array([[self.vocab[x] for x in w] + [0] * (WINDOW - n)])).item(), []).append((k, o))
        self.short = min((len(w) for w in self.words), default=WINDOW) < WINDOW
        self.keys = np.array(sorted(self.windows), dtype=np.uint64)
        self.numbers = [[self.vocab[w] for w in words] for words in self.words]
        # weights of telling words: names count twice as much as figures
        self.told = [[0 if w not in self.telling else 1 if w.isdigit() else 2 for w in words] for words in self.words]
        self.marks = [frozenset(x for x, w in zip(a, b) if w) for a, b in zip(self.numbers, self.told)]
        self.long = [[len(w) > 3 for w in words] for words in self.words]
        self.seen: dict[tuple[str, str], bool] = {}
        self.liked: dict[str, tuple[int, ...]] = {}
        self._names()

    @staticmethod
    def _hash(w: np.ndarray) -> np.ndarray:
        h = np.zeros(len(w), dtype=np.uint64)
        for c in range(w.shape[1]):
            h = (h ^ w[:, c].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        return h

    def hits(self, ids: np.ndarray) -> np.ndarray:
        """Positions in ``ids`` (0: no word of any item) at which a window of the set begins."""
        n = len(ids)
        pad = np.concatenate([ids, np.zeros(WINDOW, dtype=ids.dtype)])
        known = pad > 0
        ok = known[:n].copy()
        if not self.short:
            for c in range(1, WINDOW):
                ok &= known[c : n + c]
        at = np.flatnonzero(ok)
        w = pad[at[:, None] + np.arange(WINDOW)]
        found = self._known(self._hash(w))
        for m in range(1, WINDOW) if self.short else ():
            v = w.copy()
            v[:, m:] = 0
            found |= self._known(self._hash(v))
        return at[found]

    def _known(self, h: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.zeros(len(h), bool)
        return self.keys[np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)] == h

    def candidates(self, ids: np.ndarray, hits: np.ndarray) -> dict[int, list[tuple[int, int]]]:
        """Item -> (position, offset in the item) of its windows."""
        out: dict[int, list[tuple[int, int]]] = {}
        pad = np.concatenate([ids, np.zeros(WINDOW, dtype=ids.dtype)])
        w = pad[hits[:, None] + np.arange(WINDOW)]
        for m in range(1 if self.short else WINDOW, WINDOW + 1):
            v = w.copy()
            v[:, m:] = 0
            for p, h in zip(hits.tolist(), self._hash(v).tolist()):
                for k, o in self.windows.get(h, ()):
                    out.setdefault(k, []).append((p, o))
        return out

    def _names(self) -> None:
        """An index of the telling words that may be misspelt: by two letters side by side, with the numbers of their letters."""
        self.names = [w for w in sorted(self.telling) if len(w) > 3 and not w.isdigit()]
        self.bags, self.size = _bags(self.names), np.array([len(w) for w in self.names])
        self.pairs: dict[str, list[int]] = {}
        for i, w in enumerate(self.names):
            for x in {w[j : j + 2] for j in range(len(w) - 1)} | ({""} if len(w) <= 6 else set()):
                self.pairs.setdefault(x, []).append(i)

    def _likes(self, a: str) -> tuple[int, ...]:
        """Numbers of the telling words that ``a`` can be a misspelling of, remembered by word."""
        got = self.liked.get(a)
        if got is None:
            if len(self.liked) > 300_000:
                self.liked.clear()
            # words alike share two letters side by side, unless they have eight letters together at most
            near = {i for j in range(len(a) - 1) for i in self.pairs.get(a[j : j + 2], ())}
            if len(a) <= 4:
                near.update(self.pairs.get("", ()))
            got = ()
            if near:
                at = np.fromiter(near, np.int64, len(near))
                at = at[np.abs(self.size[at] - len(a)) <= 2]
                same = np.minimum(self.bags[at], _bags([a])).sum(axis=1)
                at = at[2 * same >= ALIKE * (self.size[at] + len(a)) - 1e-9]
                got = tuple(self.vocab[self.names[i]] for i in at.tolist() if _alike(a, self.names[i]))
            self.liked[a] = got
        return got

    def reach(self, words: list[str], ids: list[int]) -> set[int]:
        """Numbers of the item words that a part of a document can match: its own, and telling ones that its words are like."""
        out = set(ids)
        for w in set(words):
            if len(w) > 1:
                out.update(self._likes(w))
        return out

    def _like(self, a: str, b: str) -> bool:
        got = self.seen.get((a, b))
        if got is None:
            if len(self.seen) > 300_000:
                self.seen.clear()
            got = self.seen[a, b] = _alike(a, b)
        return got

    def _most(self, reach: set[int], k: int) -> int:
        """The most of the item's words that held sentences can have in a part of that ``reach``; 0 if no telling word can be matched."""
        if self.marks[k] and self.marks[k].isdisjoint(reach):
            return 0
        # of words that don't tell, every longer one may be matched misspelt
        can = [x in reach or not w and long for x, w, long in zip(self.numbers[k], self.told[k], self.long[k])]
        total, told, got = 0, [0], [0]
        for w, c in zip(self.told[k], can):
            told.append(told[-1] + w)
            got.append(got[-1] + (w if c else 0))
        for begin, end in self.ends[k].values():
            own, best = [x for x in range(begin, end) if can[x]], 0
            for a in own:
                i = begin if a - begin <= NEAR else a
                for b in reversed(own):
                    j = end if end - b <= NEAR else b + 1
                    if b < a or j - i <= best:
                        break
                    if got[j] - got[i] >= TOLD * (told[j] - told[i]):
                        best = j - i
                        break
            total += best
        return total

    def verify(self, words: list[str], ids: list[int], k: int, hits: list[tuple[int, int]], share: float = SHARE, reached: dict | None = None) -> tuple[float, int, int]:
        """(share of the item's words held, first word, last word + 1) of the best passage around ``hits`` that holds ``share`` of them; ``reached``: what is remembered of the document."""
        reached = {} if reached is None else reached
        item, sent = self.words[k], self.sentence[k]
        n, slack, best = len(item), len(item) // 3 + 8, (0.0, 0, 0)
        starts = sorted(p - o for p, o in hits)
        groups, begin = [], starts[0]
        for a, b in zip(starts, [*starts[1:], None]):
            if b is None or b - a > slack:
                groups.append((begin, a))
                begin = b
        for lo, hi in groups:
            lo, hi = max(0, lo - slack), min(len(words), hi + n + slack)
            part = words[lo:hi]
            # what no alignment can reach needs none
            x, y = lo // STEP * STEP, -(-hi // STEP) * STEP
            if (x, y) not in reached:
                reached[x, y] = self.reach(words[x:y], ids[x:y])
            if self._most(reached[x, y], k) < share * n:
                continue
            match: dict[int, int] = {}
            for b in SequenceMatcher(None, part, item, autojunk=False).get_matching_blocks():
                match.update((b.b + x, b.a + x) for x in range(b.size))
            for i in range(n):  # misspelt words between their matched neighbours
                if i not in match and len(item[i]) > 3:
                    near = [match[j] + i - j for j in (i - 1, i + 1, i - 2, i + 2) if j in match]
                    for q in near:
                        if 0 <= q < len(part) and self._like(part[q], item[i]):
                            match[i] = q
                            break
            match = {i: q for i, q in match.items() if any(abs(match.get(i + e, -99) - q - e) <= 3 for e in (-2, -1, 1, 2))}
            first, last = {}, {}
            for i in sorted(match):
                first.setdefault(sent[i], i)
                last[sent[i]] = i
            held, size = [], 0
            for s, i in first.items():
                # from the first to the last matched word of the sentence, or to its end if that is near
                begin, end = self.ends[k][s]
                i, j = (begin if i - begin <= NEAR else i), (end if end - last[s] <= NEAR else last[s] + 1)
                told = [(self.told[k][x], x in match) for x in range(i, j) if self.told[k][x]]
                if sum(w for w, m in told if m) >= TOLD * sum(w for w, _ in told):
                    held.append(s)
                    size += j - i
            # words of the pattern alone don't tell which item it is, if the item has words that do
            if any(w in self.telling for w in item) and not any(item[i] in self.telling and sent[i] in held for i in match):
                continue
            if size / n > best[0]:
                where = [match[i] for i in match if sent[i] in held]
                best = (size / n, lo + min(where), lo + max(where) + 1)
        return best


def _bags(words: list[str]) -> np.ndarray:
    """(words x 32): how many letters of each kind a word has, kinds being code points modulo 32."""
    out = np.zeros((len(words), 32), np.int16)
    for i, w in enumerate(words):
        for c in w:
            out[i, ord(c) & 31] += 1
    return out


def _alike(a: str, b: str) -> bool:
    if abs(len(a) - len(b)) > 2 or b.isdigit():
        return False
    return SequenceMatcher(None, a, b, autojunk=False).ratio() >= ALIKE


def _blocks(items: DataFrame) -> Iterator[list[tuple[int, str]]]:
    block, size = [], 0
    for r in items.toLocalIterator():
        if size + len(r[1]) > MAX_CHARS and block:
            yield block
            block, size = [], 0
        block.append((r[0], r[1]))
        size += len(r[1])
    if block:
        yield block


def _shared(items: DataFrame) -> set[str]:
    """Words of more than ``FEW`` different item texts and ``FEW_SHARE`` of them: at most words-per-item/FEW_SHARE."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"t": [" ".join(WORD.findall(low(t))) for t in pdf["t"]]})

    texts = items.select("t").mapInPandas(run, "t string").where("t != ''").distinct()
    few = max(FEW, int(FEW_SHARE * texts.count()))
    words = texts.select(F.explode(F.array_distinct(F.split("t", " "))).alias("w")).groupBy("w").count()
    return {r[0] for r in words.where(F.col("count") > few).select("w").collect()}


def leaks(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", share: float = SHARE) -> DataFrame:
    """(doc_id, item_id, share, begin, end): items held and the span of characters that holds them."""
    x = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).where(F.length("t") > 0)
    kind = x.schema["k"].dataType.simpleString()
    schema = f"doc_id {kind}, item_id long, share double, begin int, end int"
    out = None
    items = items.select(F.col(item_key).alias("i"), F.col(item_text).alias("t")).where(F.length("t") > 0)
    shared = _shared(items)
    for block in _blocks(items):
        sent = docs.sparkSession.sparkContext.broadcast(Index(block, shared))

        def run(batches: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            index = sent.value
            get = index.vocab.get
            for pdf in batches:
                rows = []
                ids, ends = [], []
                for t in pdf["t"]:
                    ids += [get(w, 0) for w in WORD.findall(low(t))]
                    ids.append(0)
                    ends.append(len(ids))
                ids, ends = np.array(ids, dtype=np.int64), np.array(ends)
                hits = index.hits(ids)
                which = np.searchsorted(ends, hits, side="right")
                for d in np.unique(which).tolist():
                    begin = ends[d - 1] if d else 0
                    k, t = pdf["k"].iat[d], pdf["t"].iat[d]
                    own = ids[begin : ends[d]]
                    words, numbers = WORD.findall(low(t)), own.tolist()
                    spans, reached = None, {}
                    for item, found in index.candidates(own, hits[which == d] - begin).items():
                        got, a, b = index.verify(words, numbers, item, found, share, reached)
                        if got >= share:
                            spans = spans or [m.span() for m in WORD.finditer(low(t))]
                            rows += [(k, i, got, spans[a][0], spans[b - 1][1]) for i in index.ids[item]]
                yield pd.DataFrame(rows, columns=["doc_id", "item_id", "share", "begin", "end"])

        found = x.mapInPandas(run, schema)
        out = found if out is None else out.unionByName(found)
    return out if out is not None else docs.sparkSession.createDataFrame([], schema)


def remove(docs: DataFrame, found: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with every span found cut out of the text."""
    spans = found.groupBy(F.col("doc_id").alias(key)).agg(F.sort_array(F.collect_set(F.struct("begin", "end"))).alias("spans"))
    merged = F.aggregate(
        "spans",
        F.struct(F.lit(0).alias("at"), F.lit("").alias("kept")),
        lambda s, x: F.struct(F.greatest(s.at, x.end).alias("at"), F.concat(s.kept, F.substring(F.col(text), s.at + 1, F.greatest(F.lit(0), x.begin - s.at))).alias("kept")),
        lambda s: F.concat(s.kept, F.substring(F.col(text), s.at + 1, F.length(text))),
    )
    rest = [c for c in docs.columns if c != text]
    return docs.join(spans, key, "left").select(*rest, F.when(F.col("spans").isNull(), F.col(text)).otherwise(merged).alias(text))
