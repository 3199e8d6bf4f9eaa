"""Problem 7: linking freely typed names to the entities they mean.

Method: trie join. Names are split into folded words. A word few entities have, such as a
surname, is a key; of two keys within two edits of each other, the first or the last halves are within
one. So keys are sharded by the forms that one edit can give their first and last three letters,
and every shard's keys of recorded names make a trie (forwards or backwards), which the
Levenshtein automata of the typed names' keys (bit-parallel, ``EDITS`` errors at most, one of
them in the half they begin with) walk together to enumerate their neighbours. The recorded names so found are then compared with the
typed one word by word in any order: equal, misspelt, abbreviated, initials, nicknames (learned
from names recorded beside each other), words run together or torn apart. A word that tells
relatives apart must not be missing or added on either side, nor a first name be another.

A recorded word that can stand for a common one ("cliinic", "moha") is no key of a name that has a
rarer word: that one must be matched anyway, so the link is found by its key.

Names without such a word (all their words common or of up to three letters) have all their words
together as key: a typed name has those of the words that each of its own can stand for, and
must leave none out. A word of up to three letters has no misspellings. Initials alone name nothing.

The name typed and the canonical form given beside it are two spellings of one entity: the
first decides, the second where the first says nothing, and between equals.

Scale: nothing that grows with the data is broadcast, only the common words (at least
``COMMON`` of the entities have each, so there are at most words-per-entity/COMMON of them)
and the nicknames (at most ``MOST_NICKNAMES``). Equal names are compared once; words of many
entities are never join keys; joins run on words and typed names and may be split by AQE.

Defined results: null and blank mentions link to nothing; recorded placeholders and cut-off
names are no names; a mention that equals a recorded name is no variant; a mention equally
near to several entities links to none; repeated rows count once; empty tables give no rows.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, combinations, product

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kgspark.lineage import cut
from kgspark.llm.fusion import is_value

#: Errors of the automaton, share of the entities from which a word is common, shards, and least score of a link.
EDITS, COMMON, SHARDS, LEAST = 2, 0.002, 48, 0.6
#: Letters of a word from which the automaton takes EDITS errors, and one less below.
LONG = 6
#: ``LONGEST``: letters of a word that fit the automata's 64 bits; longer ones are compared one by one.
LEAST_COMMON, LONGEST, MOST_NICKNAMES, OFTEN = 4, 60, 100_000, 1e-5
#: Words that say nothing about which entity is meant, and words that tell relatives apart.
IDLE = frozenset("the our of and mr mrs ms miss dr prof nurse sir ltd inc llc group co corp".split())
TELLING = frozenset("north south east west central upper lower saint new old".split())
#: Short forms that are no beginning of their word.
SHORT_FORMS = {"st": "saint", "n": "north", "s": "south", "e": "east", "w": "west", "centre": "center", "harbor": "harbour", "program": "programme"}
#: Signs taken for letters.
_SIGNS = str.maketrans({"0": "o", "1": "l", "5": "s", "3": "e", "4": "a", "8": "b", "@": "a", "$": "s"})
_INNER = re.compile(r"(?<=\w)['’`´‑-](?=\w)")
_WORD = re.compile(r"[^\W_]+")
_MARKED = re.compile(r"[\d'’`´‑-]")


def plain(c: Column) -> Column:
    """Lower-cased, trimmed, runs of blanks made one."""
    return F.btrim(F.regexp_replace(F.lower(c), r"\s+", " "))


def fold(name: str) -> list[str]:
    """The words of a name without accents, inner signs and letter-like digits."""
    t = name.lower()
    if not t.isascii():
        t = "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c))
    if _MARKED.search(t) is None:
        return _WORD.findall(t)
    out = []
    for w in _WORD.findall(_INNER.sub("", t)):
        if not w.isalpha() and any(c.isdigit() for c in w) and any(c.isalpha() for c in w):
            w = w.translate(_SIGNS)
        out.append(w)
    return out


def telling_words(name: str) -> list[str]:
    return [w for w in fold(name) if w not in IDLE]


class Automaton:
    """Levenshtein automaton of a word: sets of states as bits, one integer for each number of errors."""

    def __init__(self, word: str, edits: int = EDITS):
        self.n, self.edits, self.masks = len(word), edits, {}
        for i, c in enumerate(word):
            self.masks[c] = self.masks.get(c, 0) | 1 << i
        self.accept = 1 << self.n
        # i errors reach states up to i by skipping letters of the word
        self.start = tuple((1 << (i + 1)) - 1 for i in range(edits + 1))

    def step(self, state: tuple[int, ...], c: str) -> tuple[int, ...]:
        m = self.masks.get(c, 0)
        out, full = [], (self.accept << 1) - 1
        for i, s in enumerate(state):
            new = (s & m) << 1
            if i:
                before = state[i - 1]
                new |= before | before << 1 | out[i - 1] << 1
            out.append(new & full)
        return tuple(out)

    def errors(self, state: tuple[int, ...]) -> int | None:
        return next((i for i, s in enumerate(state) if s & self.accept), None)


def swap_distance(a: str, b: str) -> int:
    """Edits, neighbours changing places counting once."""
    two, one, now = [], [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        two, one, now = one, now, [i]
        for j, y in enumerate(b, 1):
            d = min(one[j] + 1, now[j - 1] + 1, one[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, two[j - 2] + 1)
            now.append(d)
    return now[-1]


class Trie:
    """A trie as arrays, built level by level: children of a node lie side by side, in the order of their letters."""

    def __init__(self, words: np.ndarray, ends: np.ndarray, roots: np.ndarray, own: np.ndarray):
        """``words``: letters (n x longest); ``ends``: lengths; ``roots``: number of the root of each word, from 0 on; ``own``: the ``bags`` of the words."""
        n, longest = words.shape
        self.n_roots = int(roots.max()) + 1 if n else 0
        node = roots.astype(np.int64)
        parents, letters, total = [np.full(self.n_roots, -1)], [np.zeros(self.n_roots, np.int64)], self.n_roots
        self.last, levels = node.copy(), [0]
        for level in range(longest):
            on = np.flatnonzero(ends > level)
            if not len(on):
                break
            pair, which = np.unique(node[on] << 16 | words[on, level], return_inverse=True)
            node[on] = total + which
            levels.append(total)
            parents.append(pair >> 16)
            letters.append(pair & 0xFFFF)
            total += len(pair)
            self.last[on] = node[on]
        self.letter, parent = np.concatenate(letters), np.concatenate(parents)
        # nodes are numbered by level and parent, so the children of a node are one stretch
        self.first = np.searchsorted(parent[self.n_roots :], np.arange(total)) + self.n_roots if total else np.zeros(0, np.int64)
        self.many = np.bincount(parent[self.n_roots :], minlength=total) if total else np.zeros(0, np.int64)
        # lengths of the shortest and the longest word below each node
        self.short, self.long = np.full(total, 1 << 30), np.zeros(total, np.int64)
        # letters that all, and that any, of the words below have
        self.all, self.any = np.full(total, ~np.uint64(0)), np.zeros(total, np.uint64)
        up = ((np.minimum, self.short, ends), (np.maximum, self.long, ends), (np.bitwise_and, self.all, own), (np.bitwise_or, self.any, own))
        for f, at, new in up:
            f.at(at, self.last, new)
        for lo, hi in reversed(list(zip(levels[1:], [*levels[2:], total]))):
            for f, at, _ in up:
                f.at(at, parent[lo:hi], at[lo:hi])
        self.order = np.argsort(self.last, kind="stable")
        self.at = np.searchsorted(self.last[self.order], np.arange(total + 1))


def bags(words: np.ndarray) -> np.ndarray:
    """The letters of each word (code points, 0 beyond its end) as bits, those equal modulo 64 being one."""
    out = np.zeros(len(words), np.uint64)
    for j in range(words.shape[1]):
        c = words[:, j]
        out |= np.where(c > 0, np.uint64(1) << (c.astype(np.uint64) & np.uint64(63)), np.uint64(0))
    return out


def walk(trie: Trie, root: np.ndarray, word: np.ndarray, own: np.ndarray, letters: np.ndarray, masks: np.ndarray, size: np.ndarray, edits: np.ndarray, bag: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(asked, known, errors): Levenshtein automata of many words walk the trie together, one level at a time.

    An automaton is a set of states for each number of errors, as bits; it may make at most one error in
    the first half of its word. Neighbours changing places are one error: ``swap`` holds the states that
    have read the second of two letters and wait for the first. ``masks``: (words x letters) positions of
    each letter. ``own``: whether the root is the key of the word's first ``letters`` as they are; below other
    keys, words that begin with those letters are left to that one. ``bag``: the letters of each word; an
    error brings or takes one letter at most, so subtrees whose letters differ by more are left out.
    """
    one, two = np.uint64(1), np.uint64(2)
    n = size.astype(np.uint64)
    full = (one << (n + one)) - one
    low = ~((one << (n // two)) - one)
    most = [np.where(edits >= i, full if i < 2 else full & low, np.uint64(0)).astype(np.uint64) for i in range(EDITS + 1)]
    may = [np.where(edits >= i, ~np.uint64(0), np.uint64(0)) for i in range(EDITS + 1)]
    shortest, longest, most_errors = size - edits, size + edits, edits.astype(np.uint8)
    q, node = word, root
    state = [(((one << np.uint64(i + 1)) - one) & most[i])[q] for i in range(EDITS + 1)]
    swap = [np.zeros(len(q), np.uint64) for _ in range(EDITS)]
    out, depth = [], 0
    while len(q):
        many = trie.many[node]
        rep = np.repeat(np.arange(len(q)), many)
        if not len(rep):
            break
        begin = np.cumsum(many) - many
        node = (trie.first[node] - begin)[rep] + np.arange(len(rep))
        # each test on what the ones before it leave
        z = q[rep]
        b_z, e_z = bag[z], most_errors[z]
        fit = np.flatnonzero(np.bitwise_count(trie.all[node] & ~b_z) <= e_z)
        rep, node, z, b_z, e_z = rep[fit], node[fit], z[fit], b_z[fit], e_z[fit]
        fit = np.flatnonzero(np.bitwise_count(b_z & ~trie.any[node]) <= e_z)
        rep, node, z = rep[fit], node[fit], z[fit]
        fit = np.flatnonzero((trie.long[node] >= shortest[z]) & (trie.short[node] <= longest[z]))
        rep, node, q = rep[fit], node[fit], z[fit]
        depth += 1
        m = masks[q, trie.letter[node]]
        before = state[0][rep]
        new, pend = [((before & m) << one) & most[0][q]], []
        for i in range(1, EDITS + 1):
            s, cap = state[i][rep], most[i][q]
            t = (s & m) << one | before | before << one | new[i - 1] << one | (swap[i - 1][rep] & m) << two
            new.append(t & cap)
            pend.append(before & (m >> one) & may[i][q])
            before = s
        alive = new[0] | pend[0]
        for t in (*new[1:], *pend[1:]):
            alive |= t
        own = own[rep]
        keep = np.flatnonzero((alive != 0) & (own | (new[0] == 0) | (letters[q] != depth)))
        q, node, own, state, swap = q[keep], node[keep], own[keep], [t[keep] for t in new], [t[keep] for t in pend]
        ends = trie.at[node + 1] - trie.at[node]
        hit = np.flatnonzero(ends > 0)
        if len(hit):
            errors, bit = np.full(len(hit), 99), one << n[q[hit]]
            for i in range(EDITS, -1, -1):
                errors[(state[i][hit] & bit) != 0] = i
            hit, errors = hit[errors < 99], errors[errors < 99]
            r = np.repeat(np.arange(len(hit)), ends[hit])
            b = np.cumsum(ends[hit]) - ends[hit]
            k = trie.order[trie.at[node[hit]][r] + np.arange(len(r)) - b[r]] if len(r) else np.zeros(0, np.int64)
            out.append((q[hit][r], k, errors[r]))
    cat = lambda j: np.concatenate([o[j] for o in out]) if out else np.zeros(0, np.int64)
    return cat(0), cat(1), cat(2)


def key_size(n: int) -> int:
    """Letters of the key of a recorded word of ``n`` letters."""
    return 3 if n < 8 else 4


def shard_keys(w: str, asks: bool) -> set[str]:
    """Keys of the first letters (<) and, reversed, of the last (>): a recorded word gives its first letters and their forms with one less, a typed word those of any within one edit."""
    n, out, back = len(w), set(), w[::-1]
    for h in {key_size(n)} if not asks else {key_size(n - EDITS), key_size(n + EDITS)}:
        out |= _forms(f"<{h}", w[: h + asks], h)
        out |= _forms(f">{h}", back[: h + asks], h)
    return out


@lru_cache(100_000)
def _forms(t: str, q: str, h: int) -> frozenset[str]:
    """``t`` before the first ``h`` letters of ``q``, these with one less, and, if it has more letters, all of them with one less."""
    p = q[:h]
    out = {t + p, *[t + p[:i] + p[i + 1 :] for i in range(len(p))]}
    return frozenset(out.union([t + q[:i] + q[i + 1 :] for i in range(len(q))]))


def search(asked: list[tuple[str, str]], known: list[tuple[str, str]]) -> set[tuple[str, str, int]]:
    """(asked word, known word, distance) of the (key, word) pairs that share a key and are near each other."""
    keys: dict[str, int] = {}
    roots = np.array([keys.setdefault(k, len(keys)) for k, _ in known], dtype=np.int64)
    asked = [x for x in asked if x[0] in keys and len(x[1]) > 3]
    out = _search_long([x for x in asked if len(x[1]) > LONGEST], known)
    # words that lie together have the same key, hence the same nodes
    asked = sorted(x for x in asked if len(x[1]) <= LONGEST)
    if not asked:
        return out
    # of each key: whether it is backwards, the letters it was made for, and its own
    back, made = np.array([k[0] == ">" for k in keys]), np.array([int(k[1]) for k in keys])
    start, held = _letters([k[2:] for k in keys], np.zeros(len(keys), bool))
    points, size = _letters([w for _, w in known], np.array([k[0] == ">" for k, _ in known]))
    signs = np.unique(points)  # the first is 0, beyond the end of a word
    tree = Trie(np.searchsorted(signs, points), size, roots, bags(points))
    for lo in range(0, len(asked), 4000):
        part = asked[lo : lo + 4000]
        root = np.array([keys[k] for k, _ in part])
        points, size = _letters([w for _, w in part], back[root])
        at = np.minimum(np.searchsorted(signs, points), len(signs) - 1)
        masks, rows = np.zeros((len(part), len(signs)), np.uint64), np.arange(len(part))
        for j in range(points.shape[1]):
            ok = (points[:, j] > 0) & (signs[at[:, j]] == points[:, j])  # letters that no known word has match nothing
            masks[rows[ok], at[ok, j]] |= np.uint64(1 << j)
        edits = np.where(size >= LONG, EDITS, EDITS - 1)
        own, n = held[root] == made[root], min(start.shape[1], points.shape[1])
        own &= (held[root] <= n) & ((points[:, :n] == start[root, :n]) | (start[root, :n] == 0)).all(axis=1)
        q, k, e = walk(tree, root, rows, own, made[root], masks, size, edits, bags(points))
        out.update((part[i][1], known[j][1], d) for i, j, d in zip(q.tolist(), k.tolist(), e.tolist()))
    return out


def _search_long(asked: list[tuple[str, str]], known: list[tuple[str, str]]) -> set[tuple[str, str, int]]:
    """``search`` for words of more letters than an automaton has bits."""
    by: dict[str, list[str]] = {}
    for k, w in known if asked else ():
        if len(w) >= LONGEST + 1 - EDITS:
            by.setdefault(k, []).append(w)
    near = {(w, x) for k, w in asked for x in by.get(k, ()) if abs(len(w) - len(x)) <= EDITS}
    return {(w, x, d) for w, x in near if (d := swap_distance(w, x)) <= EDITS}


def _letters(words: list[str], backwards: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(code points (n x longest), lengths), of the words marked in reverse."""
    x = np.array(words)
    p = x.view(np.uint32).reshape(len(x), -1).astype(np.int64)
    size = np.char.str_len(x).astype(np.int64)
    turn = size[:, None] - 1 - np.arange(p.shape[1])
    back = np.where(turn >= 0, np.take_along_axis(p, np.maximum(turn, 0), axis=1), 0)
    return np.where(backwards[:, None], back, p), size


def trie_join(asked: DataFrame, known: DataFrame) -> DataFrame:
    """(asked, known, d): words of the one-column frames within ``EDITS`` edits of each other."""

    def keys(asks: bool):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                words = pdf.iloc[:, 0].tolist()
                of = [shard_keys(w, asks) for w in words]
                yield pd.DataFrame({"k": list(chain.from_iterable(of)), "w": np.repeat(np.array(words, dtype=object), [len(k) for k in of])})

        return run

    schema = "k string, w string"
    x = asked.mapInPandas(keys(True), schema).withColumn("asks", F.lit(True))
    y = known.mapInPandas(keys(False), schema).withColumn("asks", F.lit(False))

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        asks = pdf["asks"].to_numpy(bool)
        pairs = list(zip(pdf["k"], pdf["w"]))
        found = search([p for p, a in zip(pairs, asks) if a], [p for p, a in zip(pairs, asks) if not a])
        return pd.DataFrame(list(found), columns=["asked", "known", "d"])

    # a shard is a bounded part of the keys, whatever their number: the shards grow with the words
    shard = F.pmod(F.xxhash64("k"), F.lit(SHARDS * max(1, known.count() // 1_000_000 + 1)))
    found = x.unionByName(y).withColumn("s", shard).groupBy("s").applyInPandas(one, "asked string, known string, d int")
    return found.distinct()


class Comparer:
    """Compares names word by word."""

    def __init__(self, common: set[str], nicknames: set[tuple[str, str]]):
        self.common, self.nicknames, self.seen = common, nicknames, {}

    def idle(self, w: str) -> bool:
        """Whether ``w`` is one edit from a word that says nothing."""
        if len(w) > 6:
            return False
        got = self.seen.get((w, ""))
        if got is None:
            got = self.seen[w, ""] = float(any(len(x) > 2 and abs(len(x) - len(w)) < 2 and swap_distance(w, x) < 2 for x in IDLE))
        return got > 0

    def word(self, a: str, b: str) -> float:
        """How well the typed word ``a`` stands for the recorded word ``b``; 0 if it doesn't."""
        if a == b:
            return 1.0
        got = self.seen.get((a, b))
        if got is None:
            if len(self.seen) > 500_000:
                self.seen.clear()
            got = self.seen[a, b] = self._word(a, b)
        return got

    def _word(self, a: str, b: str) -> float:
        if SHORT_FORMS.get(a) == b or SHORT_FORMS.get(b) == a:
            return 0.95
        if (a, b) in self.nicknames or (b, a) in self.nicknames:
            return 0.9
        if len(a) == 1 or len(b) == 1:
            return 0.72 if a[0] == b[0] and b not in TELLING and a not in TELLING else 0.0
        if (a in TELLING) != (b in TELLING):  # "sth", "cent": letters of the word in order
            short, long = sorted((a, b), key=len)
            it = iter(long)
            if long in TELLING and long[0] == short[0] and 2 <= len(short) < len(long) and all(c in it for c in short):
                return 0.85
        if a in TELLING or b in TELLING or (a in self.common and b in self.common):
            short, long = sorted((a, b), key=len)
            return 0.85 if len(short) >= 3 and long.startswith(short) and not (a in TELLING and b in TELLING) else self._damaged(a, b, 1) if not (a in self.common and b in self.common) else 0.0
        short, long = sorted((a, b), key=len)
        if len(short) >= 2 and len(long) - len(short) >= 2 and long[0] == short[0]:
            if len(short) >= 3 and long.startswith(short):
                return 0.85
            if long in self.common and len(short) <= 5:
                it = iter(long)
                if all(c in it for c in short):
                    return 0.8
        return self._damaged(a, b, 2 if min(len(a), len(b)) >= 6 else 1)

    @staticmethod
    def _damaged(a: str, b: str, most: int) -> float:
        """At most ``most`` edits, neighbours changing places being one."""
        if min(len(a), len(b)) < 4 or abs(len(a) - len(b)) > most:
            return 0.0
        # what both begin and end with costs nothing
        i, n = 0, min(len(a), len(b))
        while i < n and a[i] == b[i]:
            i += 1
        j = 0
        while j < n - i and a[-1 - j] == b[-1 - j]:
            j += 1
        a, b = a[i : len(a) - j], b[i : len(b) - j]
        if not a or not b or len(a) == len(b) == 1:
            e = max(len(a), len(b))
            return 1 - 0.1 * e if e <= most else 0.0
        if len(set(a).difference(b)) > most + 1 or len(set(b).difference(a)) > most + 1:
            return 0.0  # each letter that the other lacks is an edit
        m = Automaton(a, most + 1)
        s = m.start
        for c in b:
            s = m.step(s, c)
            if not any(s):
                return 0.0
        e = m.errors(s)
        if e is None:
            return 0.0
        if e > 1:
            e = swap_distance(a, b)
        return 1 - 0.1 * e if e <= most else 0.0

    def names(self, a: list[str], b: list[str]) -> float:
        """Score of the typed words ``a`` for the recorded words ``b``."""
        # more words than one side can lack or tear, or a telling word without anything like it
        if not a or not b or len(b) > len(a) + 3 or len(a) > len(b) + 3:
            return 0.0
        for x in b:
            if x in TELLING and x not in a and not any(w[0] == x[0] for w in a):
                return 0.0
        left, scores, key, full, longer = list(b), [], False, False, False
        rest = []
        for w in a:  # equal words first, in any order
            if w in left:
                left.remove(w)
                scores.append(1.0)
                key = key or w not in self.common and len(w) > 3
                full = full or len(w) > 1
            else:
                rest.append(w)
        i = 0
        while i < len(rest):
            w = rest[i]
            best, what = 0.0, None
            for x in left:
                s = self.word(w, x)
                if s > best:
                    best, what = s, ((x,), 1)
            if i + 1 < len(rest) and best < 0.9:  # one word torn apart
                for x in left:
                    if len(x) > 5 and abs(len(w) + len(rest[i + 1]) - len(x)) < 2:
                        s = 1.0 if w + rest[i + 1] == x else self._damaged(w + rest[i + 1], x, 1) if len(w) > 1 else 0.0
                        if 0.95 * s > best:
                            best, what = 0.95 * s, ((x,), 2)
            if best < 0.9:  # two words run together
                for x, y in zip(b, b[1:]):
                    if abs(len(x) + len(y) - len(w)) < 3 and x in left and y in left and x != y:
                        s = 1.0 if w == x + y else self._damaged(w, x + y, 2)
                        if 0.95 * s > best:
                            best, what = 0.95 * s, ((x, y), 1)
            if what is None:
                if len(w) > 1 and not self.idle(w):
                    return 0.0
                scores.append(0.9)  # a middle initial, or a damaged idle word
                i += 1
                continue
            for x in what[0]:
                left.remove(x)
                key = key or x not in self.common and len(x) > 3 and (len(w) > 3 or what[1] == 2)
                full = full or len(w) > 1 and len(x) > 1
                longer = longer or what[1] == 1 and 1 < len(x) <= 3 and w.startswith(x) and len(what[0]) == 1 and best == 0.85
            scores.append(best)
            i += what[1]
        if not key and (left or not full or longer or len(b) == 1 < len(a) or any(x not in self.common and len(x) > 3 for x in b)):
            return 0.0  # without a rare word, every word has to be there, and a short one is no beginning of a longer
        missing = 0.0
        for x in left:
            if x in TELLING or x not in self.common and len(x) > 1:
                return 0.0
            missing += 0.02 if len(x) == 1 else 0.15
        if missing and len(scores) < 2:
            return 0.0
        return max(0.0, sum(scores) / len(scores) - missing)


class Nearby:
    """The words of a bounded vocabulary for which a typed word can stand."""

    def __init__(self, words: set[str], compare: Comparer):
        self.words, self.compare, self.seen, self.longest = words, compare, {}, max(map(len, words), default=0)
        self.starts, self.cuts, self.first, self.other = {}, {}, {}, {}
        for v in words:
            self.first.setdefault(v[0], []).append(v)
            for n in range(3, len(v) - 1):
                self.starts.setdefault(v[:n], []).append(v)
            for x in self._cuts(v):
                self.cuts.setdefault(x, []).append(v)
        for a, b in (*compare.nicknames, *SHORT_FORMS.items()):
            self.other.setdefault(a, set()).add(b)
            self.other.setdefault(b, set()).add(a)

    def stands(self, w: str) -> bool:
        """Whether ``w`` can stand for a longer word of the vocabulary than a letter, misspelt or shortened."""
        return any(len(v) > 1 for v in self.of(w))

    @staticmethod
    def _cuts(w: str) -> set[str]:
        """``w`` with up to two letters less: words two edits apart have one of these in common."""
        out = {w}
        if len(w) > 3:
            one = {w[:i] + w[i + 1 :] for i in range(len(w))}
            out |= one
            if len(w) > 5:
                out.update(x[:i] + x[i + 1 :] for x in one for i in range(len(x)))
        return out

    def of(self, w: str) -> set[str]:
        """For a letter, itself; nothing ('') if the word may be left out."""
        got = self.seen.get(w)
        if got is None:
            if len(self.seen) > 200_000:
                self.seen.clear()
            got = self.seen[w] = self._of(w)
        return got

    def _of(self, w: str) -> set[str]:
        if len(w) == 1:
            return {w, ""}
        near = set(self.other.get(w, ())) | set(self.starts.get(w, ())) | {w[:n] for n in range(3, len(w) - 1)} | {w}
        if len(w) <= self.longest + 2:
            for x in self._cuts(w):
                near.update(self.cuts.get(x, ()))
        if len(w) <= 5 or w in self.compare.common:  # letters of a word in order
            near.update(self.first.get(w[0], ()))
        got = {v for v in near if v in self.words and self.compare.word(w, v) > 0}
        if w[0] in self.words:
            got.add(w[0])
        return got | {""} if self.compare.idle(w) else got

    def signatures(self, ws: list[str]) -> set[str]:
        choices = []
        for w in sorted(ws, key=len, reverse=True):
            choices.append(self.of(w))
            if not choices[-1]:
                return set()
        return {" ".join(sorted(filter(None, c))) for c in product(*choices)}


def signatures(ws: list[str]) -> set[str]:
    """A recorded name's words in order of letters, as they are or as initials, not all of them (of names of over six words, at most two)."""
    many = len(ws) - 1 if len(ws) <= 6 else 2
    short = [i for n in range(many + 1) for i in combinations(range(len(ws)), n)]
    return {" ".join(sorted(w[0] if j in i else w for j, w in enumerate(ws))) for i in short}


def recorded(entities: DataFrame) -> DataFrame:
    """(id, name): every name recorded for an id, once."""
    every = F.concat(F.array("canonical_name"), F.coalesce(F.transform("aliases", lambda a: a.text), F.array().cast("array<string>")))
    x = entities.where("id is not null").select("id", F.explode(every).alias("name"))
    return x.where(is_value(F.col("name"))).select("id", plain(F.col("name")).alias("name")).distinct()


def _tokens(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = [(i, w) for i, n in zip(pdf["id"], pdf["name"]) for w in set(telling_words(n))]
        yield pd.DataFrame(rows, columns=["id", "w"])


def vocabulary(names: DataFrame) -> set[str]:
    """The common words."""
    n_ids = names.select("id").distinct().count()
    words = names.mapInPandas(_tokens, "id string, w string").distinct().groupBy("w").count()
    return {r[0] for r in words.where(F.col("count") >= max(LEAST_COMMON, COMMON * n_ids)).select("w").collect()} | TELLING


def nicknames(entities: DataFrame, mentions: DataFrame, common: set[str], mention: str, canonical: str) -> set[tuple[str, str]]:
    """Pairs of words that stand in each other's place in two spellings given in one row, often enough."""
    x = entities.where(is_value(F.col("canonical_name")) & (F.size("aliases") > 0)).select(F.col("canonical_name").alias("a"), F.transform("aliases", lambda a: a.text).alias("b"))
    x = x.unionByName(mentions.where(F.col(mention).isNotNull() & (F.length(canonical) > 0) & (plain(F.col(mention)) != plain(F.col(canonical)))).select(F.col(mention).alias("a"), F.array(canonical).alias("b")))
    damaged = Comparer._damaged

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count: Counter = Counter()
        n = 0
        for pdf in batches:
            for name, others in zip(pdf["a"], pdf["b"]):
                a = telling_words(name)
                n += 1
                for other in others:
                    b = telling_words(other) if other else []
                    one, two = [w for w in a if w not in b and len(w) > 1], [w for w in b if w not in a and len(w) > 1]
                    if len(one) == 1 and len(two) == 1 and len(a) > 1 and (one[0] in common) + (two[0] in common) and not {one[0], two[0]} & TELLING:
                        count[min(one + two), max(one + two)] += 1
        rows = [(p, q, c) for (p, q), c in count.items() if not (p.startswith(q) or q.startswith(p)) and not damaged(p, q, 2)]
        yield pd.DataFrame([*rows, ("", "", n)], columns=["a", "b", "n"])

    pairs = cut(x.mapInPandas(run, "a string, b string, n long").groupBy("a", "b").agg(F.sum("n").alias("n")))
    rows = (pairs.where("a = ''").first() or [0, 0, 0])[2]
    often = pairs.where((F.col("a") != "") & (F.col("n") >= max(2, OFTEN * rows)))
    return {(r[0], r[1]) for r in often.orderBy(F.desc("n"), "a", "b").limit(MOST_NICKNAMES).collect()}


def linked(mentions: DataFrame, entities: DataFrame, mention: str = "mention", canonical: str = "canonical_candidate") -> DataFrame:
    """(mention, canonical, id, score): each distinct typed name that is no recorded one, and the entity it means."""
    spark = mentions.sparkSession
    names = cut(recorded(entities))
    common = vocabulary(names)
    nicks = nicknames(entities, mentions, common, mention, canonical)
    sent = spark.sparkContext.broadcast((common, nicks))
    # first names and their short forms are no keys
    named = spark.sparkContext.broadcast(common | {w for pair in nicks for w in pair})
    asked = mentions.select(plain(F.col(mention)).alias("mention"), F.coalesce(plain(F.col(canonical)), F.lit("")).alias("canonical")).where("mention != ''").distinct()
    asked = asked.join(names.select(F.col("name").alias("mention")).distinct(), "mention", "left_anti")

    def keys_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        common = named.value
        for pdf in batches:
            rows = []
            for m, c in zip(pdf["mention"], pdf["canonical"]):
                keys = set()
                for n in {m, c}:
                    ws = telling_words(n)
                    keys |= {w for w in ws if w not in common and len(w) > 3}
                    keys |= {a + b for a, b in zip(ws, ws[1:]) if a not in common and b not in common and len(a + b) > 5}
                rows += [(m, c, k) for k in keys]
            yield pd.DataFrame(rows, columns=["mention", "canonical", "w"])

    def name_keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        common = named.value
        near = Nearby(common, Comparer(*sent.value))
        for pdf in batches:
            rows = []
            for i, n in zip(pdf["id"], pdf["name"]):
                ws = telling_words(n)
                keys = {w for w in ws if w not in common and len(w) > 3}
                if len(keys) > 1:
                    keys = {w for w in keys if not near.stands(w)} or keys
                keys |= {a + b for a, b in zip(ws, ws[1:]) if a not in common and b not in common and len(a + b) > 5}
                if any(len(w) > 1 for w in ws) and all(w in common or len(w) <= 3 for w in ws):  # no rare word: all words together, marked by a blank
                    keys |= {" " + x for x in signatures(ws)}
                    if len(ws) > 1:
                        keys.add("".join(ws))
                rows += [(i, " ".join(ws), k) for k in keys]
            yield pd.DataFrame(rows, columns=["id", "name", "w"])

    q = cut(asked.mapInPandas(keys_of, "mention string, canonical string, w string"))
    # names by their words: spellings that fold to the same words are compared once
    k = cut(names.mapInPandas(name_keys, "id string, name string, w string").distinct())
    lone = k.where("w like ' %'").withColumn("w", F.substring("w", 2, 1 << 30))
    # words of names without a rare one: common words, short forms and words of up to three letters, so their number is bounded
    near_words = {r[0] for r in lone.select(F.explode(F.split("name", " "))).distinct().collect()}
    k = k.where("w not like ' %'")
    qw, kw = q.select("w").distinct(), k.select("w").distinct()
    # a word recorded as it is may still be another's misspelling: it has itself and its neighbours; equal ones need no search
    near = trie_join(qw, kw).where("d > 0").select("asked", "known")
    near = near.unionByName(qw.join(kw, "w", "left_semi").select(F.col("w").alias("asked"), F.col("w").alias("known")))
    cand = q.join(near, q["w"] == near["asked"]).select("mention", "canonical", F.col("known").alias("w")).distinct()
    cand = cand.join(k, "w").select("mention", "canonical", "id", "name")
    if near_words:
        few = spark.sparkContext.broadcast(near_words)

        def whole_names(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            near = Nearby(few.value, Comparer(*sent.value))
            for pdf in batches:
                rows = [(m, c, x) for m, c in zip(pdf["mention"], pdf["canonical"]) for n in {m, c} if n for x in near.signatures(telling_words(n)) if x]
                yield pd.DataFrame(rows, columns=["mention", "canonical", "w"])

        whole = asked.mapInPandas(whole_names, "mention string, canonical string, w string")
        cand = cand.unionByName(whole.join(lone, "w").select("mention", "canonical", "id", "name"))
    cand = cand.distinct()

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        compare = Comparer(*sent.value)
        cache: dict[str, list[str]] = {}

        def ws(n: str) -> list[str]:
            if n not in cache:
                if len(cache) > 200_000:
                    cache.clear()
                cache[n] = telling_words(n)
            return cache[n]

        for pdf in batches:
            rows = []
            for m, c, i, n in zip(pdf["mention"], pdf["canonical"], pdf["id"], pdf["name"]):
                b = n.split()
                s = compare.names(ws(m), b)
                t = (s if c == m else compare.names(ws(c), b)) if c else s
                if s >= LEAST or t >= LEAST:
                    rows.append((m, c, i, s + 0.25 * t if s >= LEAST else 0.5 * t))
            yield pd.DataFrame(rows, columns=["mention", "canonical", "id", "score"])

    found = cand.mapInPandas(verify, "mention string, canonical string, id string, score double")
    best = found.groupBy("mention", "canonical", "id").agg(F.max("score").alias("score"))
    w = Window.partitionBy("mention", "canonical")
    best = best.withColumn("top", F.max("score").over(w)).where(F.col("score") >= F.col("top") - 1e-9)
    return best.withColumn("n", F.count("*").over(w)).where("n = 1").select("mention", "canonical", "id", "score")


def variants(mentions: DataFrame, entities: DataFrame, key: str = "seq", mention: str = "mention", canonical: str = "canonical_candidate") -> DataFrame:
    """(key, id, score) of every row whose mention is another spelling of an entity's name."""
    found = linked(mentions, entities, mention, canonical)
    rows = mentions.select(F.col(key).alias(key), plain(F.col(mention)).alias("mention"), F.coalesce(plain(F.col(canonical)), F.lit("")).alias("canonical"))
    return rows.join(found, ["mention", "canonical"]).select(key, "id", "score").distinct()
