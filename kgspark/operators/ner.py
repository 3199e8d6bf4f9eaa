"""Rule-based recognition of names: runs of capitalised words, labelled by their surroundings."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Word lists of the recogniser.
ORGANISATION_ENDS = frozenset(
    "corp corp. corporation inc inc. incorporated ltd ltd. limited llc l.l.c. gmbh ag plc co co. company group holdings partners associates foundation institute "
    "university college bank labs technologies solutions systems industries enterprises services consulting".split()
)
TITLES = frozenset(
    "mr mr. mrs mrs. ms ms. dr dr. prof prof. professor sir lord lady rev rev. gen gen. sgt sgt. cpl cpl. pvt pvt. capt capt. col col. maj maj. lt lt. ceo cto cfo coo "
    "president chairman director senator governor mayor king queen prince princess".split()
)
PLACE_CUES = frozenset("in at from near of city state port".split())
PLACE_ENDS = frozenset("city county state province region district island islands lake river mountain valley bay harbor harbour strait park forest desert ocean sea creek".split())
LINKS = frozenset("of the and for de von van del la le".split())
STOPS = frozenset(
    "the a an and or but is are was were be been being have has had do does did will would could should may might shall can need must it its he she they them their this that "
    "these those which who whom whose what where when how why if then else than not no nor so too very just also only with from into about for on by to of in at as up out off "
    "over after before between under again further here there all each every both few more most other some such own same however therefore although because since while during "
    "through according based including following see note example i we you me my our your his her".split()
)
OPENING_VERBS = frozenset(
    "said told asked added noted stated announced reported explained described revealed according founded established created developed built made started began received "
    "published released continued remained became signed launched introduced".split()
)
OPENING_WORDS = frozenset(
    "after although another any because before between both certain current different during early even eventually every finally first following former further general given "
    "great here high however important initial known large last late later least little local long main major many modern much national new next now number once original own "
    "part particular past present previous public recent second several significant similar since single small specific still such then there third three today total two under "
    "until upon various well when where while within without yet".split()
)
LABEL_TYPES = {
    "PERSON": "person", "PER": "person", "ORG": "organization", "ORGANIZATION": "organization", "GPE": "location", "LOC": "location", "LOCATION": "location",
    "PRODUCT": "product", "EVENT": "event", "FAC": "facility", "NORP": "organization", "WORK_OF_ART": "concept",
}

_TOKEN = re.compile(r"[^\s,;:()\"]+")
_ENDS = ".,;:!?)'\""


def _capital(w: str) -> bool:
    return w[:1].isalpha() and w[:1].isupper()


def spans(text: str, unique: bool = True) -> list[tuple[str, int, int, str]]:
    """(text, start, end, label) of the names; positions count bytes. Stop words and single letters are left out, and repeats if ``unique``."""
    # a word, and whether a line break or a separating sign stands before it
    toks = [(m.group(), m.start(), m.end()) for m in _TOKEN.finditer(text)]
    out, seen, k = [], set(), 0
    gap = lambda i: text[toks[i - 1][2] : toks[i][1]] if i else "\n"
    while k < len(toks):
        w, begin, _ = toks[k]
        if not _capital(w):
            k += 1
            continue
        titled = w.rstrip(_ENDS).lower() in TITLES or w.lower() in TITLES
        run, last, j = [k], k, k + 1
        while j < len(toks) and not gap(j).strip() and "\n" not in gap(j):
            v, u = toks[j][0], toks[j - 1][0]
            if u[-1:] in ".!?" and u.lower() not in TITLES and len(u.rstrip(_ENDS)) > 1:  # a sentence ends before
                break
            if _capital(v) and not (titled and v.rstrip(_ENDS).lower() in STOPS):
                run.append(j)
                last = j
                j += 1
            elif not titled and v.lower() in LINKS and j + 1 < len(toks) and _capital(toks[j + 1][0]) and not gap(j + 1).strip():
                run.append(j)
                j += 1
            else:
                break
        words = [toks[i][0].rstrip(_ENDS) for i in run if i <= last]
        name = text[begin : toks[last][2]].strip().rstrip(_ENDS)
        low = name.lower()
        opens = k == 0 or text[: begin].rstrip()[-1:] in ".!?" or "\n" in gap(k)
        if titled:
            label = "PERSON" if len(words) > 1 or len(name) > 2 else ""
        elif len(words) == 1 and (low in STOPS or low in OPENING_VERBS or opens and low in OPENING_WORDS):
            label = ""
        else:
            label = classify(words, toks[k - 1][0] if k else "")
        if label and len(name.encode()) >= 2 and low not in STOPS and not (unique and (low, label) in seen):
            seen.add((low, label))
            start = len(text[:begin].encode())
            out.append((name, start, start + len(name.encode()), label))
        k = max(last + 1, k + 1)
    return out


def classify(words: list[str], before: str) -> str:
    """The label of a run of words, given the word before it; the first rule that holds decides."""
    end = words[-1].lower()
    if end in ORGANISATION_ENDS:
        return "ORG"
    if end in PLACE_ENDS:
        return "LOC"
    if len(words) == 1 and 2 <= len(words[0]) <= 5 and words[0].isupper():
        return "ORG"
    if before.lower() in PLACE_CUES:
        return "LOC"
    if 2 <= len(words) <= 3 and not any(w.lower() in ORGANISATION_ENDS | PLACE_ENDS for w in words):
        return "PERSON"
    return "MISC"


def recognise(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, span, start, end, label), one row for each name."""
    x = df.where(F.length(text) > 0).select(F.col(key).alias("k"), F.col(text).alias("t"))
    kind = x.schema["k"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(k, *s) for k, t in zip(pdf["k"], pdf["t"]) for s in spans(t)]
            yield pd.DataFrame(rows, columns=[key, "span", "start", "end", "label"])

    return x.mapInPandas(run, f"{key} {kind}, span string, start int, end int, label string")


def base_type(label: Column) -> Column:
    """The base type that a label stands for, '' for none."""
    out = F.lit("")
    for k, v in LABEL_TYPES.items():
        out = F.when(F.upper(label) == k, v).otherwise(out)
    return out
