"""Language identification by rank-order n-gram profiles.

A language's profile is the ranked list of its most frequent n-grams of 1 to 3 letters within blank-padded words; a
document's profile is made the same way. The out-of-place distance adds up, over the document's n-grams, how far each
lies from its rank in the language's profile; an n-gram that the profile lacks adds the greatest distance. The nearest
language wins; of equally near ones the first by name.

Letters are lower-cased code points; other characters part words. Letters are numbered: a to z by themselves, all
others by code point modulo 101, so that an n-gram is a number below 128^3 and counts of a language fit one array of
fixed size. Profiles come from the counts of all learnable documents, no sample.

Defined cases: null texts and texts without a letter are ``und`` with score 0; without any learnable document so is
everything; a text that shares no n-gram with any profile gets the first language and score 1/number of languages;
ranks of equally frequent n-grams follow the n-gram's number; repeated rows each count and are each predicted; very long
texts are read whole, one at a time; of equally near languages the first by name wins; an empty table gives no rows;
kept columns named lang_pred, lang_score or lang_away give way to the results.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foldstore.llm.runtime import crc_mod, small_batches, tidy

FOLDS, HELD_OUT = 4, 2
ALPHABET = 128
GRAMS = ALPHABET**3
PROFILE = 400
#: How sharply a difference in relative distance shows in the score.
SHARPNESS = 30.0
UNKNOWN = "und"


@cache
def letters() -> np.ndarray:
    """Number of each code point: 0 for what is no letter."""
    out = np.zeros(sys.maxunicode + 1, np.uint8)
    for c in range(sys.maxunicode + 1):
        if unicodedata.category(chr(c))[0] == "L":
            out[c] = c - 96 if 97 <= c <= 122 else 27 + c % 101
    return out


def numbers(text: str) -> np.ndarray:
    """The text as letter numbers, a 0 before, after and between words."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    out = np.zeros(len(points) + 2, np.int32)
    out[1:-1] = letters()[points]
    return out


def grams(x: np.ndarray) -> np.ndarray:
    """All n-grams of 1 to 3 symbols of which no blank but one at an end is part."""
    a, b, c = x[:-2], x[1:-1], x[2:]
    one = b[b > 0]
    two = (x[:-1] * ALPHABET + x[1:])[(x[:-1] > 0) | (x[1:] > 0)]
    three = ((a * ALPHABET + b) * ALPHABET + c)[(b > 0) & ((a > 0) | (c > 0))]
    # A leading blank tells 0ab from ab: pairs and letters are numbered above the triples.
    return np.concatenate([one + (GRAMS + ALPHABET * ALPHABET), two + GRAMS, three])


ALL_GRAMS = GRAMS + ALPHABET * ALPHABET + ALPHABET


def ranked(x: np.ndarray, most: int = PROFILE) -> np.ndarray:
    """The most frequent n-grams, most frequent first, ties by number."""
    s = np.sort(grams(x))
    if not len(s):
        return s
    first = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
    count = np.diff(np.append(first, len(s)))
    gram = s[first]
    if len(gram) > most:
        floor = np.partition(count, len(count) - most)[len(count) - most]
        keep = count >= floor
        gram, count = gram[keep], count[keep]
    return gram[np.argsort(-count, kind="stable")][:most]


class Profiles:
    """The profiles by n-gram: where each is ranked, and at which rank. Memory follows the profiles, not languages times n-grams."""

    def __init__(self, profiles: dict[str, list[int]]):
        self.langs = sorted(profiles)
        lang = np.concatenate([np.full(len(profiles[x]), k) for k, x in enumerate(self.langs)]) if self.langs else np.zeros(0, np.int64)
        gram = np.concatenate([np.asarray(profiles[x], np.int64) for x in self.langs]) if self.langs else np.zeros(0, np.int64)
        rank = np.concatenate([np.arange(len(profiles[x])) for x in self.langs]) if self.langs else np.zeros(0, np.int64)
        order = np.argsort(gram, kind="stable")
        self.lang, self.rank = lang[order], rank[order]
        self.gram, self.first = np.unique(gram[order], return_index=True)
        self.many = np.diff(np.append(self.first, len(gram)))

    def predict(self, text: str | None) -> tuple[str, float]:
        return self.measure(text)[:2]

    def measure(self, text: str | None) -> tuple[str, float, float]:
        """Language, score, and the distance to it, relative to that of a text that shares no n-gram."""
        top = ranked(numbers(text)) if text else np.zeros(0, np.int32)
        if not len(top) or not self.langs:
            return UNKNOWN, 0.0, 1.0
        at = np.minimum(np.searchsorted(self.gram, top), len(self.gram) - 1)
        place = np.flatnonzero(self.gram[at] == top)
        many = self.many[at[place]]
        # Of every shared n-gram and language: how much nearer it is than one that the profile lacks.
        each = np.repeat(self.first[at[place]] - (np.cumsum(many) - many), many) + np.arange(many.sum())
        nearer = PROFILE - np.abs(self.rank[each] - np.repeat(place, many))
        away = PROFILE * len(top) - np.bincount(self.lang[each], nearer, len(self.langs))
        best = int(away.argmin())
        near = np.exp(-SHARPNESS * (away - away[best]) / (PROFILE * len(top)))
        return self.langs[best], float(1 / near.sum()), float(away[best] / (PROFILE * len(top)))


def fit(docs: DataFrame) -> dict[str, list[int]]:
    """Profiles from text and non-null lang of the documents outside the held-out fold."""
    small_batches(docs.sparkSession)
    learn = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (crc_mod("doc_id", FOLDS) != HELD_OUT)).select(F.col("lang").cast("string"), "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}

        def spill(lang: str) -> pa.RecordBatch:
            n = sums.pop(lang)
            at = np.flatnonzero(n)
            return pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(n[at])], ["lang", "gram", "n"])

        for b in batches:
            langs, texts = b.column(0), b.column(1)
            for lang in pc.unique(langs).to_pylist():
                mine = texts.filter(pc.equal(langs, lang)).to_pylist()
                for k in range(0, len(mine), 200):
                    # Texts are joined by a blank, so that no n-gram crosses from one to the next.
                    g = grams(numbers(" ".join(mine[k : k + 200])))
                    if lang not in sums:
                        if len(sums) == 8:
                            yield spill(next(iter(sums)))
                        sums[lang] = np.zeros(ALL_GRAMS, np.int64)
                    sums[lang] += np.bincount(g, minlength=ALL_GRAMS)
        for lang in list(sums):
            yield spill(lang)

    total = learn.mapInArrow(tidy(count), "lang string, gram int, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    best = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    rows = total.withColumn("place", F.row_number().over(best)).where(F.col("place") <= PROFILE).select("lang", "gram", "place").collect()
    out: dict[str, list[int]] = {}
    for lang, gram, _ in sorted(rows, key=lambda r: (r[0], r[2])):
        out.setdefault(lang, []).append(gram)
    return out


def predict(docs: DataFrame, profiles: dict[str, list[int]], keep: list[str]) -> DataFrame:
    """The columns ``keep`` of every row, its lang_pred and lang_score."""
    return measure(docs, profiles, keep).drop("lang_away")


def measure(docs: DataFrame, profiles: dict[str, list[int]], keep: list[str]) -> DataFrame:
    """As ``predict``, with the relative distance to the language as lang_away."""
    spark = docs.sparkSession
    small_batches(spark)
    keep = [k for k in keep if k not in ("lang_pred", "lang_score", "lang_away")]
    shared = spark.sparkContext.broadcast(profiles)
    whole = docs.select(*keep, F.col("text").alias("lang_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Profiles(shared.value)
        for b in batches:
            got = [model.measure(t) for t in b.column(b.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:-1], pa.array([g[0] for g in got], pa.string()), *[pa.array([g[k] for g in got], pa.float64()) for k in (1, 2)]], [*b.schema.names[:-1], "lang_pred", "lang_score", "lang_away"]
            )

    return whole.mapInArrow(tidy(run), whole.drop("lang_text").schema.add("lang_pred", "string").add("lang_score", "double").add("lang_away", "double"))
