"""Toxicity by class-conditional Kneser-Ney models.

Two models, one of toxic and one of ordinary text, give every word a likelihood. A text's evidence is
log P(toxic) - log P(ordinary) of its words, length-normalised in three ways, since toxic expressions are few in a long
text: the mean of all words, the mean over passages of ``PASSAGE`` words of the highest in each, and the highest mean of
``WORST`` words in a row. A logistic curve over the three makes the score.

Each model interpolates four levels by absolute discounting; a level is a bigram, a word, its first 6 bytes, or its
first 4 bytes, and each smooths the one before:

    P_c(x) = (1 - b) * max(N_c(x) - D, 0) / sum of these + b * P_c(level below) * S(x)

* The counts N_c are Kneser-Ney continuation counts: of a word the number of distinct contexts in which documents of
  class c first use it. For toxic text a context is the two words before and the two after, so that copies of a toxic
  document say nothing new; for ordinary text, of which there is far more, it is the document. Of a bigram likewise (one
  word on either side); of a stem the number of distinct words of class c that continue it.
* Backoff is shared by the classes. The weight b comes from the counts of both, and so does S, how the mass of the
  level below is dealt: by the number of classes that use x. A rare expression, whose counts are within the discount,
  thus has the ratio of its stem, and one that is rare on every level has the ratio 1. Unseen forms of a toxic stem are
  found by the stem; toxic expressions of ordinary words by their bigrams.
* D is ``DISCOUNT`` for words, ``STEM_DISCOUNT`` for stems and ``PAIR_DISCOUNT`` for bigrams, whatever the size of the
  input. Words whose counts are within the discount in both classes have the evidence of their stem and need no entry;
  all others have one. What is broadcast thus grows with the vocabulary: 16 bytes for each stem, for each word that more
  than one toxic context or ordinary document has, and for each bigram with over ``PAIR_DISCOUNT`` toxic contexts.

All labelled documents outside the held-out fold are counted, in DataFrames that grow with the vocabulary, but for
``CALIBRATION_SHARE`` of them, which the curve is fitted on, all of them and where they lie: in documents that were
counted every rare expression speaks for the class that it was counted in.

Within a text a word counts once, with the highest evidence of its places. Defined cases: null and empty texts score as
a document without words; several labels of one document count as toxic if one says so; null labels are no labels;
without labels of both classes, counted and in the curve's sample, every score is 0; repeated rows are scored each, and count once as evidence; very long
texts are read whole, one at a time; an empty table gives no rows; a kept column named tox_score gives way to the score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldstore.llm import hashing
from foldstore.llm.runtime import clearing, crc_mod, cut, passing, small_batches, tidy

FOLDS, HELD_OUT = 5, 0
#: The curve is fitted on this share of the labelled documents, which aren't counted; their number has no limit.
CALIBRATION_SHARE, CALIBRATION_ROWS = 1 / 8, float("inf")
#: Discounts, and what they grow by for each toxic document: by nothing.
DISCOUNT, SHARE = 1.5, 0.0
PAIR_DISCOUNT, PAIR_SHARE = 4.0, 0.0
STEM_DISCOUNT = 0.75
#: Distinct words of a passage, and of the worst place.
PASSAGE, WORST = 32, 3
FEATURES = 3
#: Added to the classes that use a word or stem, so that none has no share of the level below.
SOME = 0.5

#: Entries of the evidence, ordered by key.
EVIDENCE = np.dtype([("key", np.uint64), ("value", np.float64)])
STEM, SUB, WORD, PAIR, HEAD = range(5)


def text_words(texts: pa.Array) -> Iterator[tuple[int, int, list[np.ndarray], np.ndarray]]:
    """For runs of texts: (first text, end, first 4 bytes, first 6 bytes and hash of each word, first word of each text)."""
    data, offsets = hashing.buffers(pc.utf8_lower(texts))
    for i, j in hashing.chunks(offsets):
        (sub, word), first = hashing.words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], hashing.ALNUM, (6, None))
        yield i, j, [sub & np.uint64(0xFFFFFFFF), sub, word], first


def keys(symbols: np.ndarray, level: int) -> np.ndarray:
    """Keys of one level's symbols: a word as short as its stem has other keys on each level."""
    return hashing.mix(symbols + hashing.powers(level + 2)[level + 1])


def around(word: np.ndarray, doc: np.ndarray, steps: tuple[int, ...]) -> np.ndarray:
    """For each word a hash of the words so many steps away in its text, of which the sides count as words."""
    out = np.zeros(len(word), np.uint64)
    for k, step in enumerate(steps):
        near = np.zeros(len(word), np.uint64)
        at = np.arange(max(0, -step), len(word) - max(0, step))
        same = at[doc[at] == doc[at + step]]
        near[same] = hashing.mix(word[same + step] + np.uint64(1))
        out = hashing.mix(out + near + np.uint64(k))
    return (out >> np.uint64(24)).view(np.int64)  # 40 bits tell the contexts of one word apart


def before(word: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Places of the words that another precedes in their text."""
    at = np.arange(1, len(word))
    return at[doc[at] == doc[at - 1]]


COUNTED = "word long, prev long, context long, plain long, sub long"


def counted(texts: pa.Array, toxic: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows (word, sub, plain) with the ordinary documents that hold a word, (word, context) for the words of toxic ones,
    and (word, prev, context) for their bigrams."""
    for i, j, (_, sub, word), first in text_words(texts):
        doc = np.repeat(np.arange(j - i), np.diff(first))
        bad = toxic[i:j]
        kind, at, which = np.unique(word, return_index=True, return_inverse=True)
        if not len(kind):
            continue
        once, places = np.unique(doc * len(kind) + which, return_index=True)
        plain = np.bincount((once % len(kind))[~bad[once // len(kind)]], minlength=len(kind))
        places = places[bad[doc[places]]]
        pairs = before(word, doc)
        pairs = pairs[bad[doc[pairs]]]
        _, some = np.unique(np.stack([doc[pairs], which[pairs - 1], which[pairs]]), axis=1, return_index=True)
        pairs = pairs[some]
        n = len(kind), len(places), len(pairs)
        column = lambda *parts: pa.concat_arrays([pa.array(p.view(np.int64)) if isinstance(p, np.ndarray) else pa.nulls(p, pa.int64()) for p in parts])
        columns = [
            column(kind, word[places], word[pairs]), column(n[0], n[1], word[pairs - 1]),
            column(n[0], around(word, doc, (-2, -1, 1, 2))[places], around(word, doc, (-2, 1))[pairs]),
            column(plain, n[1], n[2]), column(sub[at], n[1], n[2]),
        ]
        yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in COUNTED.split(", ")])


def among(table: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Which of x are in a sorted table."""
    return table[np.minimum(np.searchsorted(table, x), len(table) - 1)] == x if len(table) else np.zeros(len(x), bool)


def pair_keys(prev: np.ndarray, word: np.ndarray) -> np.ndarray:
    return keys(hashing.mix(prev) ^ word, PAIR)


SECOND = "prev long, word long, plain long, toxic long"


def counted_after(texts: pa.Array, toxic: np.ndarray, known: np.ndarray, firsts: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Documents of the ordinary class that hold a known bigram, and bigrams of either class that begin with a known first word."""
    for i, j, (_, _, word), first in text_words(texts):
        doc = np.repeat(np.arange(j - i), np.diff(first))
        at = before(word, doc)
        at = at[among(firsts, word[at - 1])]
        if not len(at):
            continue
        _, once = np.unique(np.stack([doc[at].view(np.uint64), word[at - 1], word[at]]), axis=1, return_index=True)
        at = at[once]
        bad = toxic[i:j][doc[at]]
        heads, which = np.unique(word[at - 1], return_inverse=True)
        t, p = (np.bincount(which[x], minlength=len(heads)) for x in (bad, ~bad))
        yield pa.RecordBatch.from_arrays([pa.array(heads.view(np.int64)), pa.nulls(len(heads), pa.int64()), pa.array(p), pa.array(t)], [x.split()[0] for x in SECOND.split(", ")])
        mine = at[~bad]
        mine = mine[among(known, pair_keys(word[mine - 1], word[mine]))]
        one = np.ones(len(mine), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(word[mine - 1].view(np.int64)), pa.array(word[mine].view(np.int64)), pa.array(one), pa.array(one * 0)], [x.split()[0] for x in SECOND.split(", ")])


@dataclass(frozen=True)
class Level:
    """Discounting of one level: the shared weight of backoff, and what remains of the counts of either class."""

    discount: float
    backoff: float
    toxic: float
    plain: float

    @staticmethod
    def of(counts: DataFrame, discount: float) -> "Level":
        least = lambda c: F.sum(F.least(F.col(c).cast("double"), F.lit(discount)))
        t, p, lt, lp = (float(x or 0) for x in counts.agg(F.sum("toxic"), F.sum("plain"), least("toxic"), least("plain")).first())
        return Level(discount, (lt + lp) / (t + p) if t + p else 1.0, t - lt, p - lp)

    def __call__(self, below: str, share: Column) -> list[Column]:
        """P of the toxic and of the ordinary class, named after the column that has the count."""
        own = lambda c, whole: F.greatest(F.col(c) - F.lit(self.discount), F.lit(0.0)) * ((1 - self.backoff) / whole if whole else 0.0)
        low = lambda c: F.col(f"{below}_{c}") if below else F.lit(1.0)
        return [own(c, whole) + self.backoff * low(c) * share for c, whole in (("toxic", self.toxic), ("plain", self.plain))]


def _ratio(t: Column, p: Column) -> Column:
    return F.log(t) - F.log(p)


def word_levels(words: DataFrame) -> tuple[list[tuple[int, DataFrame]], DataFrame]:
    """Entries (key, value) of stems, 6-byte stems and words, from ``words`` (word, sub, toxic, plain: contexts);
    and P of each word for both classes. A word within the discount in both classes has the ratio of its 6-byte stem and
    is no entry."""
    c = F.col
    uses = lambda t, p: (F.col(t) > 0).cast("int") + (F.col(p) > 0).cast("int") + F.lit(SOME)
    kinds = [F.count_if(c(k) > 0).alias(k) for k in ("toxic", "plain")]
    subs = words.groupBy("sub").agg(*kinds, c("sub").bitwiseAND(0xFFFFFFFF).alias("stem"), F.sum(uses("toxic", "plain")).alias("within"))
    subs = subs.withColumn("uses", uses("toxic", "plain"))
    stems = subs.groupBy("stem").agg(F.sum("toxic").alias("toxic"), F.sum("plain").alias("plain"), F.sum("uses").alias("within"))
    stems = cut(stems.withColumn("uses", uses("toxic", "plain")), "toxicity-stems")
    subs = cut(subs, "toxicity-subs")
    whole = stems.agg(F.sum("uses")).first()[0]
    at_stem, at_sub, at_word = Level.of(stems, STEM_DISCOUNT), Level.of(subs, STEM_DISCOUNT), Level.of(words, DISCOUNT)
    t, p = at_stem("", c("uses") / whole)
    stems = stems.withColumn("s_toxic", t).withColumn("s_plain", p)
    t, p = at_sub("s", c("uses") / c("whole"))
    subs = subs.join(stems.select("stem", "s_toxic", "s_plain", c("within").alias("whole")), "stem").withColumn("b_toxic", t).withColumn("b_plain", p)
    t, p = at_word("b", uses("toxic", "plain") / c("whole"))
    leaves = words.join(subs.select("sub", "b_toxic", "b_plain", c("within").alias("whole")), "sub").withColumn("w_toxic", t).withColumn("w_plain", p)
    entries = [
        (STEM, stems.select("stem", _ratio(c("s_toxic"), c("s_plain")))),
        (SUB, subs.select("sub", _ratio(c("b_toxic"), c("b_plain")))),
        (WORD, leaves.where((c("toxic") > DISCOUNT) | (c("plain") > DISCOUNT)).select("word", _ratio(c("w_toxic"), c("w_plain")))),
    ]
    return entries, leaves.select("word", "w_toxic", "w_plain")


def pair_level(pairs: DataFrame, seen: DataFrame, words: DataFrame, discount: float) -> tuple[DataFrame, DataFrame]:
    """(prev, word, value) of the bigrams ``pairs`` (prev, word, toxic: contexts), and (prev, value) of the weights of
    backoff after prev; seen: ordinary documents of the bigrams, and, without a word, of all bigrams that begin with prev."""
    c = F.col
    plain = seen.where("word is not null").groupBy("prev", "word").agg(F.sum("plain").alias("plain"))
    begun = seen.where("word is null").groupBy("prev").agg(F.sum("toxic").alias("begun_toxic"), F.sum("plain").alias("begun_plain"))
    kept = lambda k: F.greatest(F.coalesce(c(k), F.lit(0)) - F.lit(discount), F.lit(0.0)).alias(f"kept_{k}")
    both = pairs.join(plain, ["prev", "word"], "left").select("prev", "word", kept("toxic"), kept("plain"))
    heads = both.groupBy("prev").agg(F.sum("kept_toxic").alias("all_toxic"), F.sum("kept_plain").alias("all_plain")).join(begun, "prev")
    back = lambda k: (1 - c(f"all_{k}") / F.greatest(c(f"begun_{k}"), F.lit(1))).alias(f"back_{k}")
    heads = heads.select("prev", "begun_toxic", "begun_plain", back("toxic"), back("plain"))
    both = both.join(heads, "prev").join(words, "word")
    prob = lambda k: c(f"kept_{k}") / F.greatest(c(f"begun_{k}"), F.lit(1)) + c(f"back_{k}") * c(f"w_{k}")
    return both.select("prev", "word", _ratio(prob("toxic"), prob("plain")).alias("value")), heads.select("prev", _ratio(c("back_toxic"), c("back_plain")).alias("value"))


def looked_up(table: np.ndarray, key: np.ndarray, otherwise: np.ndarray) -> np.ndarray:
    if not len(table):
        return otherwise
    k = np.minimum(np.searchsorted(table["key"], key), len(table) - 1)
    return np.where(table["key"][k] == key, table["value"][k], otherwise)


def word_values(table: np.ndarray, symbols: list[np.ndarray]) -> np.ndarray:
    """Evidence of words: their own, or that of the longest stem that has an entry, or 0."""
    found = np.zeros(len(symbols[0]))
    for level, hashes in enumerate(symbols):
        found = looked_up(table, keys(hashes, level), found)
    return found


def pair_values(table: np.ndarray, prev: np.ndarray, word: np.ndarray, alone: np.ndarray) -> np.ndarray:
    """Evidence of words after others: that of the bigram, or the word's own and that of backing off."""
    return looked_up(table, pair_keys(prev, word), alone + looked_up(table, keys(prev, HEAD), np.zeros(len(prev))))


def features(texts: pa.Array, table: np.ndarray) -> np.ndarray:
    """For each text the mean evidence of its distinct words, the highest mean of WORST of them in a row, and the mean
    over its passages of their highest evidence."""
    out = np.zeros((len(texts), FEATURES))
    for i, j, symbols, first in text_words(texts):
        word = symbols[WORD]
        kind, at, which = np.unique(word, return_index=True, return_inverse=True)
        if not len(kind):
            continue
        value = word_values(table, [x[at] for x in symbols])[which]
        doc = np.repeat(np.arange(j - i), np.diff(first))
        pairs = before(word, doc)
        value[pairs] = pair_values(table, word[pairs - 1], word[pairs], value[pairs])
        # A word counts once, where it stands first.
        order = np.argsort(doc * len(kind) + which, kind="stable")
        group = (doc * len(kind) + which)[order]
        heads = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        places, best = order[heads], np.maximum.reduceat(value[order], heads)
        by = np.argsort(places)
        places, best = places[by], best[by]
        ends = np.searchsorted(places, first)
        size, start, mine = np.diff(ends), np.arange(len(best)), doc[places]
        some = np.flatnonzero(size)
        sums = np.concatenate([[0.0], np.cumsum(best)])
        out[i:j, 0] = (sums[ends[1:]] - sums[ends[:-1]]) / np.maximum(size, 1)
        # The last passages of a text are shorter and count as if filled up; the first one always stands.
        stop = np.minimum(start + WORST, ends[1:][mine])
        passage = (sums[stop] - sums[start]) / WORST
        passage[(stop - start < WORST) & (start != ends[:-1][mine])] = -np.inf
        out[i + some, 1] = np.maximum.reduceat(passage, ends[:-1][some])
        # A rest of less than half a passage belongs to the one before.
        parts = np.maximum(1, (size + PASSAGE // 2) // PASSAGE)
        part = np.minimum((start - ends[:-1][mine]) // PASSAGE, parts[mine] - 1) + (np.cumsum(parts) - parts)[mine]
        opens = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
        out[i:j, 2] = np.bincount(mine[opens], np.maximum.reduceat(best, opens), j - i) / parts
    return out


@dataclass(frozen=True)
class Curve:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.c_[(x - self.mean) / self.scale, np.ones(len(x))] @ self.weights
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


#: Terms are summed as whole numbers of 2^-FIXED, so that a sum doesn't depend on the order and the parts of its rows.
FIXED, MOST_TERM = 30, 2.0**30
UPPER = np.triu_indices(FEATURES + 1)


def exact_sum(terms: np.ndarray) -> list[int]:
    """Sums of the columns of terms, as whole numbers of 2^-FIXED."""
    n = np.rint(np.clip(terms, -MOST_TERM, MOST_TERM) * 2.0**FIXED).astype(np.int64)
    return [(int(h) << 32) + int(x) for h, x in zip((n >> 32).sum(0), (n & 0xFFFFFFFF).sum(0), strict=True)]


def summed(rows: DataFrame, terms) -> np.ndarray:
    """Sums over ``rows`` (a, b, c, label) of terms(features, label), an array with a row for each; a row of each task comes to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: list[int] = []
        for b in batches:
            x = np.stack([b.column(k).to_numpy() for k in range(FEATURES)], axis=1)
            new = exact_sum(terms(x, b.column(FEATURES).to_numpy().astype(float)))
            total = [x + y for x, y in zip(total, new, strict=True)] if total else new
        yield pa.RecordBatch.from_arrays([pa.array([" ".join(map(str, total))] if total else [], pa.string())], ["sums"])

    got = [[int(x) for x in r.sums.split()] for r in rows.select("a", "b", "c", "label").mapInArrow(tidy(run), "sums string").collect()]
    return np.array([sum(x) / 2**FIXED for x in zip(*got, strict=True)])


def fit_curve(rows: DataFrame) -> Curve | None:
    """Logistic regression on ``rows`` (a, b, c, label) by Newton's method with a slight ridge; None without both classes."""
    sums = summed(rows, lambda x, y: np.c_[np.ones(len(x)), y, x])
    if not len(sums) or not 0 < sums[1] < sums[0]:
        return None
    n, mean = sums[0], sums[2:] / sums[0]
    curve = Curve(mean, np.sqrt(summed(rows, lambda x, y: (x - mean) ** 2) / n) + 1e-9, np.zeros(FEATURES + 1))
    ridge = 1e-2 * np.eye(FEATURES + 1)
    for _ in range(40):

        def terms(x: np.ndarray, y: np.ndarray, curve: Curve = curve) -> np.ndarray:
            """Gradient, and the Hessian's upper triangle."""
            z, q = np.c_[(x - curve.mean) / curve.scale, np.ones(len(x))], curve(x)
            return np.c_[z * (y - q)[:, None], z[:, UPPER[0]] * z[:, UPPER[1]] * (q * (1 - q))[:, None]]

        sums = summed(rows, terms)
        hessian = np.zeros_like(ridge)
        hessian[UPPER] = sums[FEATURES + 1 :]
        hessian = hessian + np.triu(hessian, 1).T + ridge
        step = np.linalg.solve(hessian, sums[: FEATURES + 1] - 1e-2 * curve.weights)
        curve = Curve(curve.mean, curve.scale, curve.weights + step)
        if np.abs(step).max() < 1e-8:
            break
    return curve


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, text, label) of the documents outside the held-out fold that have a label; repeated rows once."""
    train = docs.select("doc_id", "text").where(crc_mod("doc_id", FOLDS) != HELD_OUT)
    one = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("label_id")).agg(F.max(F.col("toxic").cast("int")).alias("label"))
    one = cut(one.where(crc_mod("label_id", FOLDS) != HELD_OUT), "toxicity-labels")
    return passing(train, "doc_id", one.select("label_id")).join(one, F.col("doc_id") == F.col("label_id")).select("doc_id", "text", "label")


@clearing
def fit(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, Curve] | None:
    """(entries of evidence, curve) from labels.toxic of the documents outside the held-out fold; None without both classes."""
    spark = docs.sparkSession
    small_batches(spark)
    known = cut(labelled(docs, labels), "toxicity-labelled")
    size = known.agg(*[F.count_distinct(F.when(F.col("label") == k, F.col("doc_id"))) for k in (1, 0)]).first()
    if not size[0] or not size[1]:
        return None
    # The curve is to see documents as a new one is seen: what it is fitted on must not have been counted.
    aside = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(CALIBRATION_SHARE * (1 << 20))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield from counted(b.column(0), b.column(1).to_numpy() > 0)

    rows = known.where(~aside).select("text", "label").mapInArrow(tidy(count), COUNTED).groupBy("word", "prev", "context").agg(F.sum("plain").alias("plain"), F.max("sub").alias("sub"))
    counts = rows.groupBy("word", "prev").agg(F.count("context").alias("toxic"), F.coalesce(F.sum("plain"), F.lit(0)).alias("plain"), F.max("sub").alias("sub"))
    counts = cut(counts.where(F.col("prev").isNull() | (F.col("toxic") > PAIR_DISCOUNT)), "toxicity-counts")
    entries, words = word_levels(counts.where("prev is null"))

    pairs = counts.where("prev is not null").select("prev", "word", "toxic")
    found = pairs.select("prev", "word").toArrow()
    prev, word = (found[k].to_numpy().view(np.uint64) for k in range(2))
    shared = spark.sparkContext.broadcast((np.sort(pair_keys(prev, word)), np.unique(prev)))

    def count_after(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield from counted_after(b.column(0), b.column(1).to_numpy() > 0, *shared.value)

    seen = cut(known.where(~aside).select("text", "label").mapInArrow(tidy(count_after), SECOND).groupBy("prev", "word").agg(F.sum("plain").alias("plain"), F.sum("toxic").alias("toxic")), "toxicity-pairs")
    parts = []
    for level, part in [*entries, *zip((PAIR, HEAD), pair_level(pairs, seen, words, PAIR_DISCOUNT), strict=True)]:
        got = part.toArrow()
        own = np.zeros(got.num_rows, EVIDENCE)
        symbols = [got[k].to_numpy().view(np.uint64) for k in range(got.num_columns - 1)]
        own["key"] = pair_keys(*symbols) if level == PAIR else keys(symbols[0], level)
        own["value"] = got[got.num_columns - 1].to_numpy()
        parts.append(own)
    table = np.sort(np.concatenate(parts), order="key")
    evidence = spark.sparkContext.broadcast(table)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = features(b.column(1), evidence.value)
            yield pa.RecordBatch.from_arrays([b.column(0), *map(pa.array, x.T.copy()), b.column(2)], ["id", "a", "b", "c", "label"])

    # Repeated rows measure the same.
    some = known.where(aside).select(F.col("doc_id").cast("long").alias("id"), "text", "label").mapInArrow(tidy(measure), "id long, a double, b double, c double, label int")
    curve = fit_curve(cut(some.distinct(), "toxicity-curve"))
    return curve and (table, curve)


def score(docs: DataFrame, model: tuple[np.ndarray, Curve] | None, keep: list[str]) -> DataFrame:
    """The columns ``keep`` of every row, and its score."""
    keep = [k for k in keep if k != "tox_score"]
    if model is None:
        return docs.select(*keep, F.lit(0.0).alias("tox_score"))
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)
    whole = docs.select(*keep, F.col("text").alias("tox_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, curve = shared.value
        for b in batches:
            q = curve(features(b.column(b.num_columns - 1), table))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(q)], [*b.schema.names[:-1], "tox_score"])

    schema = whole.drop("tox_text").schema.add("tox_score", "double")
    return whole.mapInArrow(tidy(run), schema)
