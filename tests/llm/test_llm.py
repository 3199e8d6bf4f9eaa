"""The training-data operators against brute force, round trips and held-out accuracy, with nulls, ties, empties and clashing columns."""

import random
import string

import numpy as np
import pytest
from pyspark.sql import functions as F

from kgspark.llm import canonical, components, fusion, language, leaks, mixing, names, neighbours, spam, split

RNG = random.Random(7)


# 4: components


def union_find(pairs):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    return {x: find(x) for x in parent}


@pytest.mark.parametrize("shape", ["random", "chain", "star"])
def test_components(spark, shape):
    if shape == "random":
        pairs = [(f"n{RNG.randrange(80)}", f"n{RNG.randrange(80)}") for _ in range(60)]
    elif shape == "chain":
        order = [f"c{i:02}" for i in range(40)]
        RNG.shuffle(order)
        pairs = list(zip(order, order[1:]))
    else:
        pairs = [("hub", f"s{i}") for i in range(50)] + [("s1", "x"), ("x", "y")]
    df = spark.createDataFrame([(a.upper() + " ", b, 0.99, 1) for a, b in pairs], "a string, b string, sim double, entity_name int")
    got = {r["entity_name"]: r["group_id"] for r in components.groups(df).collect()}
    assert got == union_find([p for p in pairs if p[0] != p[1]])


def test_components_dirty(spark):
    rows = [("a", "b", 0.95), ("b", "a", 1.0), ("a", "a", 1.0), ("c", "d", None), ("c", "d", float("nan")), ("c", "d", 0.9499), (None, "e", 1.0), ("", "e", 1.0)]
    df = spark.createDataFrame(rows, "a string, b string, sim double")
    assert sorted(map(tuple, components.groups(df).collect())) == [("a", "a"), ("b", "a")]
    assert components.groups(df.limit(0)).count() == 0


# 2: splitting


def random_text(n):
    out = []
    while sum(map(len, out)) < n:
        out.append("".join(RNG.choice(string.ascii_lowercase) for _ in range(RNG.randint(1, 12))) + RNG.choice([" ", " ", " ", ". ", ", ", "\n", "\n\n", "! ", "؟ "]))
    return "".join(out)


@pytest.mark.parametrize("n,limit,overlap", [(50, 100, 10), (5000, 1500, 150), (3000, 100, 0), (2000, 60, 20)])
def test_split_round_trip(n, limit, overlap):
    t = random_text(n)
    parts = split.pieces_of(t, limit, overlap)
    assert "".join(t[a:b] for _, a, b in parts) == t
    assert all(e - s <= limit for s, _, e in parts)
    assert all(a - s == min(a, overlap) for s, a, _ in parts)


def test_split_without_boundaries():
    t = "x" * 5000
    parts = split.pieces_of(t)
    assert "".join(t[a:b] for _, a, b in parts) == t and all(e - s <= 1500 for s, _, e in parts)
    assert split.boundary_of(t, 1500) == "none" and split.boundary_of("ab " * 800, 1500) == "word" and split.boundary_of("Ab c. " * 800, 1500) == "sentence"


def test_split_frame(spark):
    df = spark.createDataFrame([(1, None, 0), (2, "", 0), (3, "short", 0), (4, "Aa bb. " * 500, 0), (4, "Aa bb. " * 500, 0)], "doc_id long, text string, piece int")
    got = split.oversized(df, "document", "doc_id").collect()
    assert {r["item_id"] for r in got} == {"4"} and sum(r["piece_no"] == 0 for r in got) == 2
    assert split.oversized(df.limit(0), "document", "doc_id").count() == 0
    with pytest.raises(ValueError):
        split.oversized(df, "document", "doc_id", limit=10, overlap=10)


# 1: fusion

ENT = "id string, canonical_name string, base_types array<string>, status string, source string, updated_at timestamp_ntz, kept_value string"


def test_fusion_trust_and_values(spark):
    import datetime as dt

    t = lambda d: dt.datetime(2025, 1, d)
    rows = [
        ("e", "right", ["b", "a", "a", "n/a"], "tbd", "good", t(1), "z"),
        ("e", "wrong", ["c"], None, "bad", t(2), "z"),
        ("e", "wrong", None, " ", "bad2", t(3), "z"),
        ("f", "cut off…", [], "active", "good", None, "z"),
        ("f", "kept", None, "former", "good", t(1), "z"),
        ("f", "unknown", None, None, None, t(9), "z"),
        ("g", "alone", ["x"], "active", "good", t(1), "z"),
        (None, "null id", None, None, None, None, None),
    ]
    e = spark.createDataFrame(rows, ENT)
    s = spark.createDataFrame([("good", 5), ("bad", 1), ("bad2", 1)], "source string, trust int")
    got = {(r["id"], r["field_name"]): r["kept_value"] for r in fusion.fuse(e, s).collect()}
    assert got == {("e", "canonical_name"): "right", ("e", "base_types"): "a|b", ("f", "canonical_name"): "kept", ("f", "status"): "former"}
    assert fusion.fuse(e.limit(0), s).count() == 0


def test_fusion_finds_copies_and_accuracy(spark):
    """Two accurate, independent sources against one wrong source and its copies: copied votes are discounted."""
    rows = []
    for i in range(120):
        truth, lie = f"true {i}", f"lie {i}"
        rows += [(f"e{i}", truth if RNG.random() < 0.9 else f"slip {i} {s}", s) for s in ("a", "b")]
        wrong = lie if RNG.random() < 0.7 else truth
        rows += [(f"e{i}", wrong, s) for s in ("liar", "copy1", "copy2")]
    e = spark.createDataFrame([(i, v, None, None, s, None, None) for i, v, s in rows], ENT)
    s = spark.createDataFrame([], "source string, trust int")
    got = {r["id"]: r for r in fusion.fuse(e, s, prior="none").collect()}
    assert len(got) == 120 and all(0 <= r["posterior"] <= 1 for r in got.values())
    dep = fusion._dependence(np.full((2, 2), 20.0), np.full((2, 2), 60.0), np.full((2, 2), 90.0), np.array([0.6, 0.6]))
    free = fusion._dependence(np.full((2, 2), 60.0), np.full((2, 2), 0.0), np.full((2, 2), 90.0), np.array([0.8, 0.8]))
    assert dep[0, 1] > 0.99 and free[0, 1] < 0.01


# 9: mixing


def brute_best(lengths, counts, budget):
    reach = {0}
    for n, c in zip(lengths, counts):
        for _ in range(c):
            reach |= {x + n for x in reach if x + n <= budget}
    return max(reach)


@pytest.mark.parametrize("seed", range(6))
def test_fit_is_optimal(seed):
    rng = random.Random(seed)
    n = np.array(sorted(rng.sample(range(3, 40), 6)))
    c = np.array([rng.randint(1, 4) for _ in n])
    budget = rng.randint(1, int((n * c).sum()) - 1)
    take = mixing.fit(n, c, budget)
    assert (take <= c).all() and (take >= 0).all() and int((n * take).sum()) == brute_best(n, c, budget)


def test_fit_large_budget():
    rng = np.random.default_rng(3)
    n = np.unique(rng.integers(20, 3000, 500))
    c = rng.integers(1, 50, len(n))
    budget = int((n * c).sum() * 0.37)
    take = mixing.fit(n, c, budget)
    assert (take <= c).all() and 0 <= budget - int((n * take).sum()) <= 2


def test_fit_of_long_documents():
    """Sources of few, very long documents meet the budgets they can."""
    assert mixing.fit(np.array([45_000, 60_000]), np.array([2, 1]), 90_000).tolist() == [2, 0]


def test_mix(spark):
    docs = [(i, "word " * (5 + i % 7), "big") for i in range(200)] + [(1000 + i, "tiny text here", "small") for i in range(5)] + [(2000, None, "big"), (2001, "no source", None), (2002, "other", "unlisted")]
    d = spark.createDataFrame(docs, "doc_id long, text string, source string")
    s = spark.createDataFrame([("big", 0.5, 3), ("small", 0.5, 2), ("none", 0.0, 5)], "source string, target_share double, max_repeats int")
    lengths, planned = mixing.mixed(d, s)
    rep = {r["source"]: r for r in mixing.shares(planned).collect()}
    assert rep["small"]["below"] and not rep["big"]["below"] and not rep["none"]["below"]
    rows = mixing.mix(lengths, planned).collect()
    tokens = {}
    for r in rows:
        tokens[r["source"]] = tokens.get(r["source"], 0) + r["n"] * r["copies"]
        assert r["copies"] <= {"big": 3, "small": 2}[r["source"]]
    assert tokens["big"] == rep["big"]["tokens"] and tokens["small"] == rep["small"]["tokens"]
    assert 0 <= rep["big"]["budget"] - tokens["big"] <= 2
    assert rows == mixing.mix(lengths, planned).collect()
    assert mixing.shares(mixing.mixed(d.limit(0), s)[1]).where("tokens > 0").count() == 0


# 8: leaks


def test_leaks(spark):
    item = "Neither Brofost Clinic nor its landlord in Dalmont wanted to insure the kiosk against frost. Three of the 45 complaints were withdrawn once Patricia Zupraidis produced the missing signature."
    other = item.replace("Brofost", "Gorvan").replace("Dalmont", "Rekvik").replace("45", "61").replace("Patricia Zupraidis", "Samuel Klothu")
    # further items of the pattern, which tell its words from its names
    more = [(10 + i, item.replace("Brofost", f"Name{c}a").replace("Dalmont", f"Town{c}b").replace("45", str(70 + i)).replace("Patricia Zupraidis", f"First{c} Last{c}")) for i, c in enumerate("qwxyz")]
    items = spark.createDataFrame([(1, item), (2, None), (3, ""), (4, "zebra quokka"), *more], "item_id long, text string")
    docs = spark.createDataFrame(
        [
            (1, f"Before. {item} After.", 1),
            (2, f"Before. {item.upper().replace('WANTED TO', 'WANTED really TO').replace('.', '!')} After.", 1),
            (3, f"Before. {other} After.", 1),
            (4, "Three of the 45 complaints were withdrawn once more.", 1),
            (5, None, 1),
            (6, "", 1),
            (7, item[: len(item) * 2 // 3], 1),
        ],
        "doc_id long, text string, item_id int",
    )
    got = {(r["doc_id"], r["item_id"]) for r in leaks.leaks(docs, items).collect()}
    assert got == {(1, 1), (2, 1), (7, 1)}
    clean = {r["doc_id"]: r["text"] for r in leaks.remove(docs, leaks.leaks(docs, items)).collect()}
    assert "landlord" not in clean[1] and clean[1].startswith("Before.") and clean[3] == f"Before. {other} After." and clean[5] is None
    assert leaks.leaks(docs.limit(0), items).count() == 0 and leaks.leaks(docs, items.limit(0)).count() == 0


def test_leaks_of_repeated_items_and_shared_words(spark):
    """Rows of equal items don't make their words common, and items of shared words only have windows too."""
    text = "neither the clinic nor its landlord wanted to insure the kiosk against frost before the winter came"
    words = "one two six ten red blue tall short warm cold fast slow old new".split()
    rng = random.Random(3)
    plain = [" ".join(rng.sample(words, 14)) for _ in range(8)]
    items = spark.createDataFrame([*((i, text) for i in range(6)), *((10 + i, t) for i, t in enumerate(plain))], "item_id long, text string")
    docs = spark.createDataFrame([(1, f"Before. {text} After."), (2, f"Then {plain[3]} and more."), (3, "Nothing of the kind was ever said here by any of them.")], "doc_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in leaks.leaks(docs, items).collect()}
    assert got == {(1, i) for i in range(6)} | {(2, 13)}


# 10: spam


def test_spam(spark):
    words = [f"w{''.join(RNG.choice('abcdefgh') for _ in range(4))}" for _ in range(60)]
    sentence = [[f"the {a} of {b} was seen near a {c} by the old man" for c in words[40:60:5]] for a, b in zip(words[:20], words[20:40])]
    flat = [x for s in sentence for x in s]
    prose = [". ".join(RNG.choice(flat) for _ in range(6)) for _ in range(150)]
    bad = [" ".join(RNG.choice(["blood tests", "eye care"]) for _ in range(40)), " ".join(f"https://www.{w}.example/{w}" for w in words), " ".join(f"#{w}" for w in words)]
    long = "z" * 3000 + " " + prose[0]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate([*prose, *bad, long, "", None, "ok"])], "doc_id long, text string")
    got = {r["doc_id"] for r in spam.spam(docs).collect()}
    assert got == {150, 151, 152}
    assert spam.spam(docs.limit(0)).count() == 0


def test_spam_of_rare_words(spark, monkeypatch):
    """Lists of words that few documents have are stuffed, whatever the limits of what is sent to the tasks."""
    rng = random.Random(4)
    name = lambda: "".join(rng.choice("bcdfghklmnprstvz") + rng.choice("aeiou") for _ in range(5))
    rare = [name() for _ in range(600)]
    prose = [". ".join(f"the {a} of the old town was seen near {b} by a man" for a, b in (rng.sample(("house", "garden", "river", "market"), 2) for _ in range(6))) for _ in range(200)]
    # every rare word is in three lists, with other neighbours
    lists = [" ".join(rng.sample(rare, 60)) for _ in range(30)]
    # a rare collocation of two documents is met, not chance
    twice = [" ".join(f"{a} {b} {c}" for a, b, c in zip(rare[500:520], rare[520:540], rare[540:560]))] * 3
    docs = spark.createDataFrame(list(enumerate([*prose, *lists, *twice])), "doc_id long, text string")
    exact = {r["doc_id"]: r["stuffed_share"] for r in spam.scores(docs).collect()}
    monkeypatch.setattr(spam, "WORD_SHARE", 0.05)
    monkeypatch.setattr(spam, "PAIR_SHARE", 0.05)
    assert {r["doc_id"]: r["stuffed_share"] for r in spam.scores(docs).collect()} == exact
    assert {r["doc_id"] for r in spam.spam(docs).collect()} == set(range(200, 230))


# 5: language

SAMPLES = {
    "en": "The nurse asked the family to wait before noon because the doctor was late today",
    "fr": "Les familles attendent le médecin avant midi parce que le bureau est encore fermé aujourd'hui",
    "de": "Die Familien warten vor dem Mittag auf den Arzt weil das Büro heute noch geschlossen ist",
    "he": "המשפחות ממתינות לרופא לפני הצהריים כי המשרד עדיין סגור היום בבוקר",
}


def test_language(spark):
    rng = random.Random(1)
    shuffled = lambda k: " ".join(rng.sample(SAMPLES[k].split(), 10)) + ". "
    train = [("".join(shuffled(k) for _ in range(4)), k) for k in SAMPLES for _ in range(30)]
    train += [("".join(shuffled("en") for _ in range(4)), "fr") for _ in range(4)]  # wrong labels
    model = language.fit([t for t, _ in train], [y for _, y in train])
    held = [(k, shuffled(k)) for k in SAMPLES for _ in range(25)]
    got = [s[0][0] if s else None for s in language.segments(model, [t for _, t in held])]
    assert np.mean([g == k for g, (k, _) in zip(got, held)]) > 0.97
    mixed = shuffled("en") + shuffled("en") + shuffled("de") + "Ja. " + shuffled("en")
    (segs,) = language.segments(model, [mixed])
    assert [s[0] for s in segs] == ["en", "de", "en"] and segs[0][2] == 0 and segs[-1][3] == len(mixed)
    assert list(language.segments(model, ["", "two words"])) == [[], []]
    df = spark.createDataFrame([("document", i, 0, t, lab) for i, (t, lab) in enumerate([(shuffled("en"), "EN_us"), (shuffled("en"), "de"), (shuffled("fr"), None), (mixed, "en"), (None, "en")])], "record_kind string, record_id long, item_no long, text string, label string")
    bad = language.wrong_labels(language.classify(df, model))
    assert sorted((r["record_id"], r["segment_no"], r["lang"]) for r in bad.collect()) == [(1, 1, "en"), (2, 1, "fr"), (3, 1, "en"), (3, 2, "de"), (3, 3, "en")]
    assert all(0.5 <= r["confidence"] <= 1 for r in bad.collect())
    assert language.classify(df, None).count() == 0 and language.fit([], []) is None


def test_labels(spark):
    vals = ["en", "EN", "eng", "en-GB", "en_US", "English", " he ", "heb", "ar-EG", "pt-BR", "xx", "und", "", None, "mul", "??"]
    df = spark.createDataFrame([(v,) for v in vals], "v string")
    assert [r[0] for r in df.select(language.label_language(F.col("v"))).collect()] == ["en"] * 6 + ["he", "he", "ar", "pt"] + [None] * 6


# 3: neighbours


def test_neighbours(spark):
    rng = np.random.default_rng(5)
    base = rng.standard_normal((150, 64))
    x = np.concatenate([base + 0.15 * rng.standard_normal(base.shape) for _ in range(4)]) * rng.uniform(0.1, 5, (600, 1))
    rows = [(i, [float(v) for v in r], 0) for i, r in enumerate(x)]
    rows += [(1000 + i, [float(v) for v in 3 * x[0]], 0) for i in range(9)]  # copies
    rows += [(2000, None, 0), (2001, [0.0] * 64, 0), (2002, [1.0] * 5, 0), (2003, [float("nan")] * 64, 0)]
    df = spark.createDataFrame(rows, "rec_id long, embedding array<float>, other int")
    ids = np.array([i for i, v, _ in rows if i < 2000])
    m = np.array([v for i, v, _ in rows if i < 2000])
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    s = m @ m.T
    np.fill_diagonal(s, -2)
    plain = np.flatnonzero(ids < 1000)
    true = {(ids[i], ids[j]) for i in plain if i for j in np.argsort(-s[i])[:3] if s[i, j] >= 0.85}
    got = {(r["id"], r["other"]) for r in neighbours.neighbours(df, "rec_id", "embedding", 3, least=0.85).collect()}
    assert len({p for p in true if p in got}) / len(true) > 0.95
    per = {}
    for a, _ in got:
        per[a] = per.get(a, 0) + 1
    assert max(per.values()) <= 3 and per[1005] == 3 and not any(a >= 2000 for a, _ in got)
    asked = {(r["id"], r["other"]) for r in neighbours.neighbours(df, "rec_id", "embedding", 5, queries=F.col("id") % 20 == 0, lists=1).collect()}
    want = {(ids[i], ids[j]) for i in range(len(ids)) if ids[i] % 20 == 0 and 0 < ids[i] < 1000 for j in np.argsort(-s[i])[:5]}
    assert len(want & asked) / len(want) > 0.9 and {a % 20 for a, _ in asked} == {0}
    assert neighbours.neighbours(df.limit(0), "rec_id", "embedding").count() == 0


# 6: canonical values


def test_bk_tree():
    words = list({"".join(RNG.choice("abc") for _ in range(RNG.randint(1, 7))) for _ in range(300)})
    tree = canonical.BKTree(iter(words))

    def lev(a, b):
        p = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            c = [i]
            for j, y in enumerate(b, 1):
                c.append(min(p[j] + 1, c[-1] + 1, p[j - 1] + (x != y)))
            p = c
        return p[-1]

    for q in words[:20] + ["", "abcabcabc"]:
        for r in (0, 1, 2):
            assert tree.within(q, r) == sorted((lev(q, w), w) for w in words if lev(q, w) <= r)


def test_mapping(spark):
    ref = spark.createDataFrame([("RUNS_SITE", "An organization keeps a working site of its own", ["operates location"]), ("DRIVES_PATIENTS", "A carrier takes patients to appointments", ["patient taxi"]), (None, None, None)], "relation_id string, description string, aliases array<string>")
    vals = ["RUNS_SITE", "runs site", "RunsSite", "site runs", "rnus site", "'runing site'", "patient txai", "maintains own working site", "zebra", None, " ", "runs site"]
    df = spark.createDataFrame([(i, v, "x") for i, v in enumerate(vals)], "seq long, v string, matched_id string")
    for shards in (1, 3):
        got = {r["seq"]: r["matched_id"] for r in canonical.mapped(df, "v", ref, shards=shards).collect()}
        assert got == {0: "RUNS_SITE", 1: "RUNS_SITE", 2: "RUNS_SITE", 3: "RUNS_SITE", 4: "RUNS_SITE", 5: "RUNS_SITE", 6: "DRIVES_PATIENTS", 7: "RUNS_SITE", 8: "UNMATCHED", 11: "RUNS_SITE"}
    assert canonical.mapped(df.limit(0), "v", ref).count() == 0
    assert {r["matched_id"] for r in canonical.mapped(df, "v", ref.limit(0)).collect()} == {"UNMATCHED"}


# 7: names


def damaged(w, n, rng):
    w = list(w)
    for _ in range(n):
        i, r = rng.randrange(len(w)), rng.random()
        if r < 0.25:
            w[i] = rng.choice("abcxyz")
        elif r < 0.5:
            w.insert(i, rng.choice("abcxyz"))
        elif r < 0.75 and i + 1 < len(w):
            w[i], w[i + 1] = w[i + 1], w[i]
        elif len(w) > 1:
            w.pop(i)
    return "".join(w)


@pytest.mark.parametrize("seed", [1, 2])
def test_trie_search_is_exact(seed):
    rng = random.Random(seed)
    syl = "kla vlo mou gard rek thi pra sen dal mont zu ra bo lin".split()
    known = list({"".join(rng.choice(syl) for _ in range(rng.randint(2, 5))) for _ in range(800)})
    asked = list({damaged(rng.choice(known), rng.randint(0, 3), rng) for _ in range(150)})
    got = {}
    for a, b, e in names.search([(k, w) for w in asked for k in names.shard_keys(w, True)], [(k, w) for w in known for k in names.shard_keys(w, False)]):
        got[a, b] = min(e, got.get((a, b), 9))
    want = {(a, b): e for a in asked if len(a) > 3 for b in known for e in [names.swap_distance(a, b)] if e <= (names.EDITS if len(a) >= names.LONG else names.EDITS - 1)}
    assert got == want


def test_variants(spark):
    firsts = ["alexander", "victoria", "robert", "miriam"]
    rows = [(f"p{i}-{f}", f"{f} {'sha' * 1}{a}{b}", [], 1) for i, (a, b) in enumerate([("tilmont", "rek"), ("bolgard", "zan")]) for f in firsts[: 2 + i]]
    rows += [(f"o{i}", f"{n} {k}", [], 1) for i, (n, k) in enumerate((n, k) for n in ("kosoumshulin", "vlaimolthato", "gubepilod", "drakelmas") for k in ("north clinic", "care center"))]
    ents = spark.createDataFrame([(i, n, [(None, "en")], None) for i, n, _, _ in rows] + [("bad", "unknown", None, None), ("cut", "kosoumsh…", None, None), (None, "x", None, None)], "id string, canonical_name string, aliases array<struct<text:string,lang:string>>, seq int")
    ask = [
        (1, "Kosoumshulin North Clinic", None),  # recorded
        (2, "Kosoumshuiln Nth Clinic", None),
        (3, "North Clinic, Kosoumshulin", ""),
        (4, "kosoumshulin south clinic", None),  # another one
        (5, "Victoria Shatilmontrk", "x"),
        (6, "shatilmontrek, a.", None),
        (7, "miriam shatilmontrek", None),  # no such person
        (8, "drakel mas care center", None),
        (9, None, None),
        (10, " ", None),
        (2, "Kosoumshuiln Nth Clinic", None),
    ]
    m = spark.createDataFrame(ask, "seq long, mention string, canonical_candidate string")
    got = {r["seq"]: r["id"] for r in names.variants(m, ents).collect()}
    assert got[2] == got[3] == "o0" and got[5] == "p0-victoria" and got[6] == "p0-alexander" and got[8] == "o7"
    assert not {1, 4, 7, 9, 10} & set(got)
    assert names.variants(m.limit(0), ents).count() == 0 and names.variants(m, ents.limit(0)).count() == 0


def test_recorded_word_may_be_a_misspelling(spark):
    """A typed surname that is recorded for another entity still finds its neighbours."""
    firsts = ["alexander", "victoria", "robert", "miriam"]
    rows = [(f"{f}-{w}", f"{f} {w}") for f in firsts for w in ("tilmontrek", "bolgardzan", "gubepilod")] + [("a", "alexander kosoumshulin"), ("v", "victoria kosoumshulen")]
    ents = spark.createDataFrame([(i, n, [(None, "en")]) for i, n in rows], "id string, canonical_name string, aliases array<struct<text:string,lang:string>>")
    m = spark.createDataFrame([(1, "Alexander Kosoumshulen", None), (2, "Victoria Kosoumshulin", None)], "seq long, mention string, canonical_candidate string")
    assert {r["seq"]: r["id"] for r in names.variants(m, ents).collect()} == {1: "a", 2: "v"}


def test_names_without_a_rare_word(spark):
    """Names of common and short words only are linked by all their words."""
    names_ = [f"{f} {w}" for f in ("dana", "robert", "miriam", "tal") for w in ("lee", "cohen", "oz", "williams")]
    ents = spark.createDataFrame([(n, n, [(None, "en")]) for n in names_], "id string, canonical_name string, aliases array<struct<text:string,lang:string>>")
    ask = {
        "Dnaa Lee": "dana lee",
        "Lee, Dana": "dana lee",
        "Dana Cohne": "dana cohen",
        "Miriam Wiliasm": "miriam williams",
        "Tal A. Oz": "tal oz",
        "Robt. Cohen": "robert cohen",
        "D. Cohen": "dana cohen",
        "danalee": "dana lee",
        "Dana": None,
        "D. L.": None,
        "Ruth Cohen": None,
        "Dana Zebrakowski": None,
        "Dana Leeman": None,
    }
    m = spark.createDataFrame([(i, a, None) for i, a in enumerate(ask)], "seq long, mention string, canonical_candidate string")
    got = {r["seq"]: r["id"] for r in names.variants(m, ents).collect()}
    assert {a: got.get(i) for i, a in enumerate(ask)} == ask


@pytest.mark.parametrize("size", [4, 5, 6, 7, 8, 9, 12, 27, 29, 33, 58, 60, 61, 64, 90])
def test_trie_search_finds_two_errors(size):
    """One error in words of 4 and 5 letters, two from 6 on, in words of any length and at every place."""
    rng = random.Random(size)
    known = list({"".join(rng.choice("abcdefghijkl") for _ in range(size)) for _ in range(6)})
    asked = {w: w for w in known}
    places = range(size) if size < 13 else sorted(rng.sample(range(size), 6))
    for w in known[:3]:
        for i in places:
            one = {w[:i] + w[i + 1 :], w[:i] + "z" + w[i:], w[:i] + "z" + w[i + 1 :], w[:i] + w[i + 1 : i + 2] + w[i : i + 1] + w[i + 2 :]}
            asked |= dict.fromkeys(one, w)
            for x in one:
                for j in places:
                    asked |= dict.fromkeys({x[:j] + x[j + 1 :], x[:j] + "y" + x[j:], x[:j] + "y" + x[j + 1 :]}, w)
    got = {(a, b) for a, b, _ in names.search([(k, w) for w in asked for k in names.shard_keys(w, True)], [(k, w) for w in known for k in names.shard_keys(w, False)])}
    want = {(a, b) for a in asked if len(a) > 3 for b in known if abs(len(a) - len(b)) < 3 and names.swap_distance(a, b) <= (2 if len(a) >= 6 else 1)}
    assert got == want


def test_early_errors_of_torn_words():
    compare = names.Comparer({"clinic"}, set())
    assert compare.names(["drkel", "mas", "clinic"], ["drakelmas", "clinic"]) > 0.6
    assert compare.names(["rdakel", "mas", "clinic"], ["drakelmas", "clinic"]) > 0.6
    assert compare.names(["rdakelmas", "clinic"], ["drakel", "mas", "clinic"]) > 0.6
