"""Problem 5: the language of every text, and of every segment of texts that change language.

Method: nearest-centroid classification. Sentences become normalised TF-IDF vectors of
character trigrams and whole words (hashed into ``BUCKETS``), which are compared by cosine with
several clustered centroids per language. A sentence too far from every centroid, or shorter
than ``LEAST_WORDS``, is rejected and goes with its neighbours. Runs of sentences in one
language are segments; the confidence of a segment is how much nearer its language is than
the next one, from 0.5 to 1.

The model is fitted on the labelled documents themselves: at most ``SAMPLE`` documents per
label, chosen by a hash of their id. As labels may be wrong and texts mixed, a first model of one
centroid per language reclassifies the sample's sentences, and only those that agree with
their label make the clustered centroids. The fitted model is BUCKETS x languages x
CLUSTERS floats, whatever the corpus.

Classification reads every text as a whole, in one pass without shuffle.

Defined results: null and blank texts, and texts of fewer than ``LEAST_WORDS`` words, have no
language; labels in any case, of two or three letters with or without region, or English
names, are understood, all else counts as missing; languages without a labelled sample are
never assigned; repeated rows are texts of their own; empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kgspark.llm import textscan as ts

#: The labels of each language.
LABELS = {
    "en": ("en", "eng", "english"),
    "he": ("he", "heb", "iw", "hebrew"),
    "ar": ("ar", "ara", "arabic"),
    "fr": ("fr", "fra", "fre", "french"),
    "es": ("es", "spa", "spanish"),
    "pt": ("pt", "por", "portuguese"),
    "de": ("de", "deu", "ger", "german"),
}
BUCKETS, CLUSTERS, SAMPLE, LEAST_WORDS = 1 << 14, 3, 120, 5
#: Sentences of the sample that fit the model, cosine below which a sentence is rejected, and lead over the next language that it needs.
SENTENCES, REJECT, LEAD = 12_000, 0.05, 0.03
#: A label's own text of at most so many characters is taken into the sample.
SAMPLE_CHARS = 20_000


def label_language(label: Column) -> Column:
    """The language that a label names, or null."""
    t = F.regexp_replace(F.lower(F.btrim(label, F.lit(" \t\r\n"))), r"^([a-z]{2,3})[-_].*$", "$1")
    out = F.lit(None).cast("string")
    for lang, names in LABELS.items():
        out = F.when(t.isin(*names), F.lit(lang)).otherwise(out)
    return out


class Sentences:
    """The sentences of a batch of texts and their sparse vectors."""

    def __init__(self, texts: list[str]):
        low = [x if len(x := t.lower()) == len(t) else t for t in texts]
        cp, at = ts.points(low)
        blank = ts.of(ts.blanks(), cp)
        letter = ts.of(ts.letters(), cp).astype(bool)
        # a sentence ends after . ! ? or the Arabic mark before a blank, and at line breaks
        stop = (cp == 0x2E) | (cp == 0x21) | (cp == 0x3F) | (cp == 0x61F)
        end = (cp == 0x0A) | (cp == 0x0D)
        end[1:] |= stop[:-1] & blank[1:]
        ends = np.flatnonzero(end) + 1
        self.begin = np.concatenate([[0], ends[:-1]]) if len(ends) else np.zeros(0, np.int64)
        self.text = np.searchsorted(at, self.begin, side="right") - 1
        # words by blanks, as the least number of words is defined
        ws = ~blank & np.concatenate([[True], blank[:-1]])
        sid = np.cumsum(end) - end
        self.n = len(ends)
        self.words = np.bincount(sid[ws], minlength=self.n)[: self.n] if self.n else np.zeros(0, np.int64)
        # features: trigrams around each letter, and words
        c = np.where(letter, cp, 32).astype(np.uint64)
        mid = np.flatnonzero(letter[1:-1]) + 1
        h = (c[mid - 1] * np.uint64(0x9E3779B1) ^ c[mid] * np.uint64(0x85EBCA77) ^ c[mid + 1] * np.uint64(0xC2B2AE3D)) * np.uint64(0x9E3779B97F4A7C15)
        s, e = ts.runs(letter)
        w = ts.hashes(cp, s, e)
        where = np.concatenate([sid[mid], sid[s]])
        bucket = (np.concatenate([h, w]) >> np.uint64(40)).astype(np.int64) % BUCKETS
        key = np.sort(where.astype(np.int64) * BUCKETS + bucket)
        new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        tf = np.diff(np.concatenate([new, [len(key)]]))
        self.row, self.bucket, self.tf = key[new] // BUCKETS, key[new] % BUCKETS, 1 + np.log(tf)

    def cosines(self, idf: np.ndarray, centroids: np.ndarray) -> np.ndarray:
        """(sentences x centroids)."""
        out = np.zeros((self.n, centroids.shape[1]), dtype=np.float32)
        if not len(self.row):
            return out
        v = (self.tf * idf[self.bucket]).astype(np.float32)
        first = np.flatnonzero(np.concatenate([[True], self.row[1:] != self.row[:-1]]))
        who = self.row[first]
        norm = np.sqrt(np.add.reduceat(v * v, first))
        for lo in range(0, len(first), 4096):
            a, b = first[lo], first[lo + 4096] if lo + 4096 < len(first) else len(v)
            part = centroids[self.bucket[a:b]] * v[a:b, None]
            out[who[lo : lo + 4096]] = np.add.reduceat(part, first[lo : lo + 4096] - a, axis=0)
        out[who] /= np.maximum(norm, 1e-9)[:, None]
        return out


class Model:
    def __init__(self, langs: list[str], idf: np.ndarray, centroids: np.ndarray, of: np.ndarray):
        self.langs, self.idf, self.centroids, self.of = langs, idf, centroids, of

    def languages(self, s: Sentences) -> np.ndarray:
        """(sentences x languages): cosine with the nearest centroid of each language."""
        c = s.cosines(self.idf, self.centroids)
        return np.stack([c[:, self.of == k].max(axis=1) for k in range(len(self.langs))], axis=1)


def fit(texts: list[str], labels: list[str], seed: int = 0) -> Model | None:
    """The model of labelled texts; None without any."""
    langs = sorted(set(labels))
    if not langs:
        return None
    rows, buckets, tfs, ys, n = [], [], [], [], 0
    for part in ts.slices(texts):
        s = Sentences(texts[part])
        keep = s.words >= LEAST_WORDS
        number = np.cumsum(keep) - 1 + n
        ok = keep[s.row]
        rows.append(number[s.row[ok]])
        buckets.append(s.bucket[ok])
        tfs.append(s.tf[ok])
        ys.append(np.array([langs.index(x) for x in labels[part]])[s.text[keep]])
        n += int(keep.sum())
        if n >= SENTENCES:
            break
    if not n:
        return None
    row, bucket, tf, y = map(np.concatenate, (rows, buckets, tfs, ys))
    df = np.bincount(bucket, minlength=BUCKETS)
    idf = np.log((1 + n) / (1 + df)).astype(np.float32)
    v = tf * idf[bucket]
    norm = np.sqrt(np.bincount(row, weights=v * v, minlength=n))
    v = v / np.maximum(norm[row], 1e-9)

    def centre(member: np.ndarray) -> np.ndarray:
        m = member[row]
        c = np.bincount(bucket[m], weights=v[m], minlength=BUCKETS)
        return c / max(1e-9, np.linalg.norm(c))

    def cosine(cs: np.ndarray, part: slice = slice(None)) -> np.ndarray:
        return np.stack([np.bincount(row[part], weights=v[part] * c[bucket[part]], minlength=n) for c in cs], axis=1)

    clean = np.ones(n, bool)
    for _ in range(3):
        one = np.stack([centre((y == k) & clean) for k in range(len(langs))])
        clean = cosine(one).argmax(axis=1) == y
    cs, of = [], []
    rng = np.random.default_rng(seed)
    for k in range(len(langs)):
        own = np.flatnonzero((y == k) & clean)
        if not len(own):
            continue
        mine = np.isin(row, own)
        group = np.full(n, -1)
        group[own] = rng.integers(0, CLUSTERS, len(own))
        for _ in range(4):
            near = np.stack([centre(group == g) if (group == g).any() else np.zeros(BUCKETS) for g in range(CLUSTERS)])
            group[own] = cosine(near, mine)[own].argmax(axis=1)
        for g in range(CLUSTERS):
            if (group == g).any():
                cs.append(centre(group == g))
                of.append(k)
    kept = sorted(set(of))
    langs, of = [langs[k] for k in kept], [kept.index(k) for k in of]
    return Model(langs, idf, np.array(cs, dtype=np.float32).T.copy(), np.array(of))


def segments(model: Model, texts: list[str]) -> Iterator[list[tuple[str, float, int, int]]]:
    """For each text its segments: (language, confidence, first character, end)."""
    for part in ts.slices(texts):
        own = texts[part]
        s = Sentences(own)
        cos = model.languages(s)
        best = cos.argmax(axis=1)
        top = cos[np.arange(s.n), best]
        two = np.sort(cos, axis=1)[:, -2] if cos.shape[1] > 1 else np.zeros(s.n)
        sure = (s.words >= LEAST_WORDS) & (top >= REJECT) & (top - two >= LEAD)
        size = np.bincount(s.text, weights=s.words, minlength=len(own))
        edge = np.searchsorted(s.text, np.arange(len(own) + 1))
        offset = np.concatenate([[0], np.cumsum([len(t) + 1 for t in own])])
        for i, t in enumerate(own):
            a, b = edge[i], edge[i + 1]
            use = np.arange(a, b)[sure[a:b]]
            if size[i] < LEAST_WORDS:
                yield []
                continue
            if not len(use):  # only short sentences, such as a list: the text as a whole
                w = cos[a:b] * s.words[a:b, None]
                total = w.sum(axis=0)
                k = int(total.argmax())
                if total[k] < REJECT * max(1, s.words[a:b].sum()):
                    yield []
                    continue
                rest = np.sort(total)[-2] if len(total) > 1 else 0.0
                yield [(model.langs[k], float(total[k] / (total[k] + rest)), 0, len(t))]
                continue
            if len(set(best[use].tolist())) == 1:
                k = int(best[use[0]])
                yield [(model.langs[k], float(np.mean(top[use] / (top[use] + two[use]))), 0, len(t))]
                continue
            runs: list[list] = []
            for j in use.tolist():
                k = int(best[j])
                if runs and k != runs[-1][0] and top[j] - cos[j, runs[-1][0]] < LEAD:
                    k = runs[-1][0]
                if not runs or runs[-1][0] != k:
                    runs.append([k, int(s.begin[j] - offset[i]), []])
                runs[-1][2].append(float(cos[j, k] / (cos[j, k] + max(x for y, x in enumerate(cos[j]) if y != k))))
            runs[0][1] = 0
            yield [(model.langs[k], float(np.mean(c)), x, (runs[r + 1][1] if r + 1 < len(runs) else len(t))) for r, (k, x, c) in enumerate(runs)]


def train(docs: DataFrame, key: str = "doc_id", text: str = "text", label: str = "lang", sample: int = SAMPLE) -> Model | None:
    """The model of at most ``sample`` documents per label: bounded, so it is fitted on the driver."""
    lab = label_language(F.col(label))
    x = docs.where(F.length(text).between(40, SAMPLE_CHARS)).select(F.col(key).alias("k"), lab.alias("y")).where("y is not null")
    w = Window.partitionBy("y").orderBy(F.xxhash64("k"), "k")
    chosen = x.withColumn("r", F.row_number().over(w)).where(F.col("r") <= sample).select("k", "y")
    # at most sample x languages rows
    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).join(F.broadcast(chosen), "k").select("t", "y").collect()
    rows.sort(key=lambda r: hash_of(r[0]))
    return fit([r[0] for r in rows], [r[1] for r in rows])


def hash_of(t: str) -> int:
    import zlib

    return zlib.crc32(t.encode("utf-8", "surrogatepass"))


def classify(texts: DataFrame, model: Model | None) -> DataFrame:
    """(record_kind, record_id, item_no, segment_no, lang, confidence, begin, end, given) of texts (record_kind, record_id, item_no, text, label)."""
    spark = texts.sparkSession
    schema = "record_kind string, record_id long, item_no long, segment_no long, lang string, confidence double, begin long, end long, given string, n_segments long"
    if model is None:
        return spark.createDataFrame([], schema)
    sent = spark.sparkContext.broadcast(model)
    x = texts.where(F.length("text") > 0).select("record_kind", "record_id", "item_no", label_language(F.col("label")).alias("given"), "text")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            at, no, lang, conf, begin, end, of = [], [], [], [], [], [], []
            for i, segs in enumerate(segments(sent.value, pdf["text"].tolist())):
                for n, (k, c, a, b) in enumerate(segs):
                    at.append(i)
                    of.append(len(segs))
                    no.append(n + 1)
                    lang.append(k)
                    conf.append(c)
                    begin.append(a)
                    end.append(b)
            out = pdf[["record_kind", "record_id", "item_no"]].iloc[at].reset_index(drop=True)
            yield out.assign(segment_no=no, lang=lang, confidence=conf, begin=begin, end=end, given=pdf["given"].iloc[at].tolist(), n_segments=of)

    return x.mapInPandas(run, schema)


def wrong_labels(found: DataFrame) -> DataFrame:
    """The rows of ``classify`` about texts in several languages, or whose label is missing or names another language."""
    return found.where((F.col("n_segments") > 1) | F.col("given").isNull() | (F.col("given") != F.col("lang")))
