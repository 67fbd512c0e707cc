"""Problem 8: reading level of each document.

Interjections and procedural formulas are left out, syllables are counted by
hyphenation-style patterns of the language, and the median of several classic
grade formulas, each brought to the scale of the ratings, is the document's
grade. These lines and the cut points between bands, one set a language, are
fitted on human ratings.

A procedural formula is a sentence of fewer than FORMULA_WORDS words that stands in at least
FORMULA_SHARE of the different texts, and in FORMULA_LEAST of them by as many speakers, at
every size of the corpus and wherever it stands. Copies of a text count once.
"""

from __future__ import annotations

import hashlib
import re
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import staged
from .syllables import syllables

#: Ratings used to fit the cut points, and the weight, in ratings, that a language's share of all other ratings has beside its own.
MAX_RATINGS, OTHERS = 200_000, 6.0
FORMULA_WORDS, FORMULA_SHARE, FORMULA_LEAST = 16, 0.001, 3
#: Formulas that are sent to every task; more of them are joined by a shuffle.
SENT_FORMULAS = 100_000

ASIDE = re.compile(r"\([^()]*\)|\[[^\[\]]*\]|[–—-] [^–—\n:.]{0,12}\.? ?[^–—\n:]{1,40}: [^–—\n]{1,60}[–—](?=\s|$)")
BREAK = re.compile(r"(?<=[^\W\d_])-\r?\n(?=[^\W\d_])")
SENTENCE = re.compile(r"[.!?]+(?=\s|$)|\n\s*\n")
#: What ends in a full stop within a sentence, besides single letters.
SHORT = frozenset(("Abg", "Hon", "Mrs", "Mr", "Ms", "Dr", "Mme", "St", "No", "Nr"))
WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
#: A speaker's label stands before one of the first sentences.
HEAD = 3
SPEAKER = re.compile(r"^\s*[^\n.!?:]{0,60}(?:\.[^\n.!?:]{1,60})?:\s+")
# Common words that tell the languages apart.
COMMON = {
    "en": frozenset("the and of to in is that these those such some most all our your their we they you with for by from".split()),
    "de": frozenset("der die das und oder unsere ihre eure diese jene manche alle wir sie für gegen durch um ohne nicht".split()),
    "fr": frozenset("le la les des et ou nos vos leurs mes ces dans sur sous sans chez vers par pour nous vous que".split()),
}
#: Share of common words that a text in a language has at least.
LEAST_COMMON = 0.04
COLUMNS = ("words", "syllables", "poly", "letters", "long")
COUNTS = ", ".join(f"{c} bigint" for c in COLUMNS)
FEATURES = f"doc_id bigint, lang string, body bigint, speaker bigint, sentences bigint, {COUNTS}, short array<struct<h:bigint,{COUNTS.replace(' ', ':').replace(',:', ',')}>>"


def language(code: str | None, sentences: list[list[str]]) -> str:
    """Of the code, in whatever form, else of the common words of the whole text; 'other' where they are of none (ties: en)."""
    c = (code or "").strip().lower()[:2]
    c = {"ge": "de", "al": "de", "an": "en"}.get(c, c)
    if c in COMMON:
        return c
    count, words = dict.fromkeys(COMMON, 0), 0
    for s in sentences:
        words += len(s)
        for w in s:
            w = w.lower()
            for k, common in COMMON.items():
                count[k] += w in common
    best = max(COMMON, key=lambda k: (count[k], k == "en"))
    return best if count[best] >= LEAST_COMMON * words else "other"


#: Bits of each packed count.
BITS = 40


class _Counts(dict):
    """Of a word: syllables, three syllables or more, letters, more than six letters; packed, so that sums stay sums (of up to 2**BITS)."""

    def __init__(self, lang: str):
        self.lang = lang

    def __missing__(self, w: str) -> int:
        if len(self) > 400_000:
            self.clear()
        n, k = syllables(w, self.lang), len(w)
        self[w] = c = n | (n > 2) << BITS | k << 2 * BITS | (k > 6) << 3 * BITS
        return c


def _unpacked(words: int, c: int) -> tuple:
    m = (1 << BITS) - 1
    return words, c & m, c >> BITS & m, c >> 2 * BITS & m, c >> 3 * BITS


def _hash(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def measure(text: str, code: str | None, cache: dict) -> tuple:
    """(language, hash of the words, sentences, counts) of a text without interjections and speaker's label, and of its short sentences."""
    body = BREAK.sub("", ASIDE.sub(" ", text))
    parts = SENTENCE.split(body)
    sentences, k = [], 0
    while k < len(parts):
        p = parts[k]
        k += 1
        words = WORD.findall(SPEAKER.sub("", p.strip()) if len(sentences) < HEAD else p)
        while words and k < len(parts) and (len(words[-1]) == 1 and words[-1].isupper() or words[-1] in SHORT) and p.endswith(words[-1]):
            p = parts[k]
            k += 1
            words += WORD.findall(p)
        if words:
            sentences.append(words)
    lang = language(code, sentences)
    own = cache.get(lang) or cache.setdefault(lang, _Counts(lang))
    packed = [sum(map(own.__getitem__, s)) for s in sentences]
    texts = [" ".join(s).lower() for s in sentences]
    short = [{"h": _hash(t), **dict(zip(COLUMNS, _unpacked(len(s), p)))} for t, s, p in zip(texts, sentences, packed) if len(s) < FORMULA_WORDS]
    return lang, _hash("\n".join(texts)), len(sentences), *_unpacked(sum(map(len, sentences)), sum(packed)), short


def features(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", speaker_col: str = "speaker_id") -> DataFrame:
    """Rows of ``FEATURES``; without a speaker (or the column) each text is a speaker of its own."""

    def run(batches):
        cache: dict = {}
        for pdf in batches:
            rows = []
            for i, t, c, s in zip(pdf["i"], pdf["t"], pdf["c"], pdf["s"]):
                lang, body, *rest = measure(t or "", c if isinstance(c, str) else None, cache)
                rows.append((i, lang, body, body if s is None else _hash(s), *rest))
            yield pd.DataFrame(rows, columns=["doc_id", "lang", "body", "speaker", "sentences", *COLUMNS, "short"])

    speaker = F.col(speaker_col).cast("string") if speaker_col in documents.columns else F.lit(None).cast("string")
    d = documents.select(F.col(id_col).cast("bigint").alias("i"), F.col(text_col).alias("t"), F.col(lang_col).alias("c"), speaker.alias("s")).where("i is not null")
    return d.mapInPandas(run, FEATURES)


def formulas(feats: DataFrame) -> DataFrame:
    """(h) of the procedural formulas."""
    said = feats.where("size(short) > 0").select("body", "speaker", F.explode(F.array_distinct(F.transform("short", lambda x: x["h"]))).alias("h"))
    # a speaker and a text count once, before anything is gathered by sentence
    texts = said.select("h", "body").distinct().groupBy("h").agg(F.count(F.lit(1)).alias("texts"))
    least = max(FORMULA_LEAST, FORMULA_SHARE * feats.where("sentences > 0").select("body").distinct().count())
    often = staged(texts.where(F.col("texts") >= least), "often")
    send = F.broadcast if often.count() <= SENT_FORMULAS else lambda d: d
    speakers = said.join(send(often), "h").select("h", "speaker").distinct().groupBy("h").agg(F.count(F.lit(1)).alias("speakers"))
    return speakers.where(F.col("speakers") >= FORMULA_LEAST).select("h")


def without_formulas(feats: DataFrame) -> DataFrame:
    """Take the procedural formulas off the counts."""
    common = staged(formulas(feats), "formulas")
    send = F.broadcast if common.count() <= SENT_FORMULAS else lambda d: d
    short = feats.where("size(short) > 0").select("doc_id", F.explode("short").alias("e")).select("doc_id", "e.*")
    off = short.join(send(common), "h").groupBy("doc_id").agg(F.count(F.lit(1)).alias("sentences"), *(F.sum(c).alias(c) for c in COLUMNS))
    off = off.select("doc_id", *(F.col(c).alias(f"off_{c}") for c in ("sentences", *COLUMNS)))
    j = feats.drop("short", "body", "speaker").join(off, "doc_id", "left")
    left = {c: F.col(c) - F.coalesce(f"off_{c}", F.lit(0)) for c in ("sentences", *COLUMNS)}
    keep = left["words"] > 0
    # the length of a document is that of all its words
    return j.select("doc_id", "lang", F.col("words").alias("all_words"), *(F.when(keep, left[c]).otherwise(F.col(c)).cast("double").alias(c) for c in left))


GRADES = ("flesch_kincaid", "fog", "ari", "lix", "ease", "smog")


def graded(feats: DataFrame) -> DataFrame:
    """Add the classic estimates; null without words."""
    wps, spw, cpw = F.try_divide("words", "sentences"), F.try_divide("syllables", "words"), F.try_divide("letters", "words")
    poly, long = F.try_divide("poly", "words"), F.try_divide("long", "words")
    ease = F.when(F.col("lang") == "de", 180 - wps - 58.5 * spw).when(F.col("lang") == "fr", 207 - 1.015 * wps - 73.6 * spw).otherwise(206.835 - 1.015 * wps - 84.6 * spw)
    return feats.withColumns({
        "flesch_kincaid": 0.39 * wps + 11.8 * spw - 15.59,
        "fog": 0.4 * (wps + 100 * poly),
        "ari": 4.71 * cpw + 0.5 * wps - 21.43,
        "lix": wps + 100 * long,
        "ease": 100 - ease,
        "smog": 1.043 * F.sqrt(30 * F.try_divide("poly", "sentences")) + 3.1291,
    })


def _median(values: list):
    s = F.array_sort(F.array(*values))
    n = len(values)
    return (F.element_at(s, (n + 1) // 2) + F.element_at(s, n // 2 + 1)) / 2


def best_cuts(grade: np.ndarray, band: np.ndarray, bands: int = 5, weight: np.ndarray | None = None) -> list[float]:
    """Cut points of least total absolute error, by dynamic programming over the sorted grades."""
    order = np.argsort(grade, kind="stable")
    g, b = grade[order], band[order]
    w = np.ones(len(g)) if weight is None else weight[order]
    n = len(g)
    cost = np.array([np.r_[0, np.cumsum(w * np.abs(b - k))] for k in range(1, bands + 1)])
    best, back = cost[0].copy(), []
    for k in range(1, bands):
        rel = best - cost[k]
        low = np.minimum.accumulate(rel)
        arg = np.maximum.accumulate(np.where(rel == low, np.arange(n + 1), 0))
        back.append(arg)
        best = low + cost[k]
    cuts, end = [], n
    for arg in reversed(back):
        end = int(arg[end])
        cuts.append(float("-inf") if n == 0 or end == 0 else float("inf") if end == n else float(g[end - 1] + g[end]) / 2)
    return cuts[::-1]


def _lines(x: np.ndarray, band: np.ndarray, weight: np.ndarray) -> list[tuple[float, float]]:
    """(slope, intercept) of each estimate against the bands."""
    out, mean = [], lambda v: float((v * weight).sum() / weight.sum())
    for g in x.T:
        c = g - mean(g)
        v = mean(c * c)
        slope = mean(c * (band - mean(band))) / v if v > 1e-12 else 0.0
        out.append((slope, mean(band) - slope * mean(g)))
    return out


def fit_scale(graded_docs: DataFrame, labels: DataFrame) -> dict[str, tuple[list, list]]:
    """Of each language: the lines of its estimates, and its cut points.

    Of a document's ratings the median counts; null bands do not. Beside a language's own
    ratings those of all others count, with the weight of OTHERS ratings together and moved by the
    difference of the languages' medians over the whole corpus, so that a language
    of few ratings takes theirs and one of many its own, without a switch.
    """
    own = labels.where("band between 1 and 5 and doc_id is not null").groupBy("doc_id").agg(F.percentile("band", 0.5).alias("band"))
    own = own.orderBy(F.xxhash64("doc_id")).limit(MAX_RATINGS)
    pdf = graded_docs.join(own, "doc_id").select("lang", "band", *GRADES).dropna().toPandas()
    mid = {r["lang"]: [r[g] or 0.0 for g in GRADES] for r in graded_docs.groupBy("lang").agg(*(F.percentile_approx(g, 0.5).alias(g) for g in GRADES)).collect()}
    if not len(pdf):  # no ratings: Flesch-Kincaid grades of primary, middle and secondary school, college, beyond
        return {k: ([(1.0, 0.0)], [5.0, 8.0, 11.0, 15.0]) for k in mid}
    band = pdf["band"].to_numpy(float)
    shift = np.array([mid[k] for k in pdf["lang"]], dtype=float)
    rest = pdf[list(GRADES)].to_numpy(float) - shift
    out = {}
    for k, ms in mid.items():
        x, own_rows = rest + np.array(ms), (pdf["lang"] == k).to_numpy()
        weight = np.where(own_rows, 1.0, OTHERS / max(1, (~own_rows).sum()))
        lines = _lines(x, band, weight)
        out[k] = (lines, best_cuts(np.median([a * v + b for (a, b), v in zip(lines, x.T)], axis=0), band, weight=weight))
    return out


def reading_bands(documents: DataFrame, labels: DataFrame, min_words: int = 60) -> DataFrame:
    """(doc_id, grade, band) of every document with ``min_words`` words of speech.

    Null, empty and short texts give no row, nor does a null id; ids are unique.
    Language codes may have any form or be null. Without ratings the bands are
    school stages of the Flesch-Kincaid grade.
    """
    feats = staged(features(documents), "reading")
    docs = staged(graded(without_formulas(feats)), "grades")
    scale = fit_scale(docs, labels)
    grade, band = F.lit(None).cast("double"), F.lit(None).cast("int")
    for k, (lines, cuts) in scale.items():
        g = _median([a * F.col(c) + b for (a, b), c in zip(lines, GRADES)])
        grade = F.when(F.col("lang") == k, g).otherwise(grade)
        band = F.when(F.col("lang") == k, reduce(lambda acc, x: acc + (F.col("grade") >= F.lit(x)).cast("int"), cuts, F.lit(1))).otherwise(band)
    long = docs.where(F.col("all_words") >= min_words).where(F.col(GRADES[0]).isNotNull())
    return long.withColumn("grade", grade).select("doc_id", "grade", band.alias("band"))
