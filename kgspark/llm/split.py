"""Problem 2: cutting oversized texts into ordered, overlapping pieces at natural boundaries.

Method: recursive bisection. A stretch longer than the limit minus the overlap is cut at the
strongest boundary near its midpoint, and both halves are cut again while they are too long.
Afterwards every piece but the first is extended to the left by the overlap, so that piece k
starts with the last ``overlap`` characters before its own beginning. The pieces without
their overlaps, joined, are the text again, character by character.

Boundaries from strong to weak: blank line, line break, sentence end, clause mark, blank.
"Near" is the middle half of the stretch. A sentence is never cut while the stretch has a
boundary between sentences anywhere, so only one that is by itself too long with the overlap is;
likewise a run without blanks (in the middle).

``boundary`` is the weakest kind of cut that the bisection makes to come under the limit:
``sentence`` if all lie between sentences, ``word`` if some lie between words of a sentence,
``none`` if one is inside a run. The overlap doesn't count: where a sentence fits the limit but not
together with the overlap, the bisection is asked again without.

Defined results: null and blank texts, and texts within the limit, give no pieces from
``oversized``; a text without blanks is cut by length; lengths are code points; repeated
rows are cut each for itself; an empty table gives no rows. One text is one task's work and
takes memory in proportion to its own length only.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed values of the task: limit and overlap in characters.
LIMIT, OVERLAP = 1500, 150

#: Where a cut may lie: the end of a match, by falling strength; the first three lie between sentences.
LEVELS = tuple(re.compile(p) for p in (r"\n[ \t\r]*\n\s*", r"[\r\n]+\s*", r"(?<=[.!?؟])[ \t\r\n]+", r"(?<=[,;:،؛])[ \t]+", r"[ \t]+"))
KINDS = ("sentence", "word", "none")
SEPARATORS = " \t\r\n"


def _best(at: tuple[list[int], ...], lo: int, hi: int) -> int | None:
    """The strongest boundary near the midpoint, else the one nearest to it, strictly between ``lo`` and ``hi``."""
    mid, near = (lo + hi) // 2, (hi - lo) // 4
    for reach in (near, hi - lo):
        for ends in at:
            k = bisect_left(ends, mid)
            c = [e for e in ends[max(0, k - 1) : k + 1] if lo < e < hi and abs(e - mid) <= reach]
            if c:
                return min(c, key=lambda e: abs(e - mid))
    return None


def cuts(text: str, limit: int, overlap: int) -> tuple[list[int], str]:
    """(sorted positions at which ``text`` is cut, ends included, the weakest kind of these cuts)."""
    n, most = len(text), limit - overlap
    at = tuple([m.end() for m in p.finditer(text) if 0 < m.end() < n] for p in LEVELS) if n > most else ()
    out, todo, weakest = [0, n], [(0, n)], 0
    while todo:
        lo, hi = todo.pop()
        if hi - lo <= most:
            continue
        cut, kind = _best(at[:3], lo, hi), 0
        if cut is None:  # one sentence
            core = text[lo:hi]
            begin, end = hi - len(core.lstrip(SEPARATORS)), lo + len(core.rstrip(SEPARATORS))
            if end - begin <= most:  # too long only with the blanks around it
                cut = begin if lo < begin < hi else end if lo < end < hi else (lo + hi) // 2
            else:
                cut, kind = _best(at[3:], lo, hi), 1
                if cut is None:  # one run without blanks
                    cut, kind = (lo + hi) // 2, 2
        weakest = max(weakest, kind)
        out.append(cut)
        todo += [(lo, cut), (cut, hi)]
    return sorted(out), KINDS[weakest]


def boundary_of(text: str, limit: int) -> str:
    """The weakest kind of cut that is needed to come under ``limit``."""
    return cuts(text, limit, 0)[1]


def pieces_of(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int, int]]:
    """(start with overlap, own start, end) of each piece."""
    return _pieces(cuts(text, limit, overlap)[0], overlap)


def _pieces(c: list[int], overlap: int) -> list[tuple[int, int, int]]:
    return [(max(0, a - overlap) if a else 0, a, b) for a, b in zip(c, c[1:])]


def oversized(df: DataFrame, kind: str, key: str, text: str = "text", limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """(item_kind, item_id, piece_no, n_pieces, own_start, piece, boundary) of texts over ``limit``; no shuffle."""
    if not 0 <= overlap < limit:
        raise ValueError("the overlap must be shorter than the limit")
    long = df.select(F.col(key).cast("string").alias("k"), F.col(text).alias("t")).where(F.length("t") > limit)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for k, t in zip(pdf["k"], pdf["t"]):
                at, weakest = cuts(t, limit, overlap)
                weakest = weakest if weakest == KINDS[0] else boundary_of(t, limit)
                parts = _pieces(at, overlap)
                rows += [(kind, k, i, len(parts), a - s, t[s:e], weakest) for i, (s, a, e) in enumerate(parts)]
            yield pd.DataFrame(rows, columns=["item_kind", "item_id", "piece_no", "n_pieces", "own_start", "piece", "boundary"])

    return long.mapInPandas(run, "item_kind string, item_id string, piece_no int, n_pieces int, own_start int, piece string, boundary string")
