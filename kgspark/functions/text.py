"""Text predicates and normalisers as Column expressions: all of them stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words a question's keywords never are.
KEYWORD_STOPS = (
    "what who where when why how which whom is are was were be been being the a an in on at to for of and or with by from as but not no nor does did do has had have "
    "will would could should may might shall can this that these those it its they their he she him her his about after before between during through according described"
).split()
# Words that select no entity.
QUESTION_STOPS = "the and for with any one who what where when which does did has have are was were there anyone called named about from this that into your you tell give show list all name".split()
# Cues of questions that want a count or a ranking.
ANALYTICAL_CUES = (
    "how many", "count of", "number of", "no. of", "most ", "least ", "highest", "lowest", "biggest", "largest", "smallest", "top ", " best ", " worst ",
    "fewest", "greatest", "average", "median", "total ", "which has", "which one has", "rank", "ranking", "ordered by",
)
# Phrases that ask for all of something.
ENUMERATION = r"(?i)\b(every|each|complete list|full list|list all|list of all|enumerate|name all|name every|all the|all of the)\b"
YES_NO = "is are was were did does do has had have can could will would should".split()
#: Hints for the form of an answer.
HINTS = {
    "yes_no": "Answer format: yes or no comes first, the reason after it.",
    "who": "Answer format: give the names of those asked for.",
    "where": "Answer format: give the place.",
    "when": "Answer format: give the date, time or span of time.",
    "number": "Answer format: give the number or amount.",
}
# Cues that a name follows, in the order they are tried.
LOOKUP_CUES = (
    "called ", "named ", "name is ", "name's ", "anyone called ", "anybody called ", "any one called ", "anyone named ", "anybody named ", "any one named ",
    "who is ", "who's ", "is there a person called ", "is there someone called ",
)
MONTHS = "january|february|march|april|may|june|july|august|september|october|november|december"
DAYS = "monday|tuesday|wednesday|thursday|friday|saturday|sunday"
# Patterns of values that are only a time, date or frequency.
RAW_TEMPORAL = "|".join(
    (
        r"^\d{1,2}:\d{2}$", r"^\d{1,2}:\d{2}\s", r"^\d{4}-\d{2}-\d{2}$", r"^q[1-4]\s+\d{4}$", r"^(daily|weekly|monthly|yearly|biweekly)$", rf"^({DAYS})s?\b",
        r"^(twice|once|three times)\s+per\s+(day|week|month|year)$", r"\b\d+\s+(business\s+)?days?\b", r"at least .* days? in advance", r"^\d+\s*(am|pm)$", r"^every\s+",
    )
)

BLANK = r"^[\s ]+|[\s ]+$"


def trim(c: Column) -> Column:
    """Without blanks of any kind at the ends, line breaks included."""
    return F.regexp_replace(c, BLANK, "")


def name_key(c: Column) -> Column:
    """The identity of a name: lower-cased and trimmed; null counts as ''."""
    return F.lower(trim(F.coalesce(c, F.lit(""))))


def keywords(question: Column, most: int = 12) -> Column:
    """Words of a question worth looking up, in order."""
    words = F.split(trim(F.regexp_replace(F.lower(question), r"[?.!,;:'\"\-()\[\]]+", " ")), r"\s+")
    return F.slice(F.filter(words, lambda w: ~w.isin(*KEYWORD_STOPS) & (F.octet_length(w) > 2)), 1, most)


def tokens(text: Column) -> Column:
    """ASCII words of three letters or more that may select an entity."""
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: (F.length(w) >= 3) & ~w.isin(*QUESTION_STOPS))


def question_type(question: Column) -> Column:
    """yes_no, who, where, when, number or ''."""
    q = F.lower(trim(question))
    return (
        F.when(q.rlike(rf"^({'|'.join(YES_NO)}) "), "yes_no").when(q.startswith("who "), "who").when(q.startswith("where "), "where").when(q.startswith("when "), "when").when(q.rlike("^how (many|much)"), "number").otherwise("")
    )


def answer_hint(question: Column) -> Column:
    kind, out = question_type(question), F.lit("")
    for k, hint in HINTS.items():
        out = F.when(kind == k, hint).otherwise(out)
    return out


def wants_all(question: Column) -> Column:
    return question.rlike(ENUMERATION)


def wants_analysis(question: Column) -> Column:
    q = F.concat(F.lit(" "), F.lower(question), F.lit(" "))
    out = F.lit(False)
    for cue in ANALYTICAL_CUES:
        out = out | q.contains(cue)
    return out


def looked_up_name(question: Column) -> Column:
    """Up to three words of the name a question asks for; empty if it asks for none."""
    q, found = F.lower(question), []
    for cue in LOOKUP_CUES:
        t = tokens(F.element_at(F.split(q, cue), -1))
        found.append(F.when(q.contains(cue) & (F.size(t) > 0), F.slice(t, 1, 3)))
    return F.coalesce(*found, F.array().cast("array<string>"))


def is_raw_temporal(name: Column) -> Column:
    return F.lower(trim(name)).rlike(RAW_TEMPORAL)


def clean_control(c: Column) -> Column:
    """Without control characters other than tab and line breaks."""
    return F.regexp_replace(c, r"[\p{Cntrl}&&[^\t\n\r]]", "")


def pascal_label(c: Column) -> Column:
    """'medical courier' -> 'MedicalCourier'."""
    words = F.split(trim(F.regexp_replace(c, r"[^A-Za-z0-9]+", " ")), " ")
    return F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1000))), "")


def relation_label(c: Column) -> Column:
    """'works at' -> 'WORKS_AT'; 'RELATED' for nothing."""
    out = F.regexp_replace(F.regexp_replace(F.upper(trim(c)), r"[^A-Z0-9_]+", "_"), r"^_+|_+$", "")
    return F.when(out == "", "RELATED").otherwise(out)


def jaccard(a: Column, b: Column) -> Column:
    """Similarity of two arrays as sets."""
    return F.size(F.array_intersect(a, b)) / F.greatest(F.size(F.array_union(a, b)), F.lit(1))


def any_phrase(text: Column, phrases: list[str] | tuple[str, ...]) -> Column:
    """Whether the lower-cased text contains one of the phrases."""
    t, out = F.lower(F.coalesce(text, F.lit(""))), F.lit(False)
    for p in phrases:
        out = out | t.contains(p)
    return out
