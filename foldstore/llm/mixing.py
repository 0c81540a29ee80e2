"""Temperature mixing of sources, from DataFrame functions alone.

A source's share of all tokens is raised to an exponent a in [0, 1] and normalised: a = 1 keeps the natural mix,
a = 0 makes all sources equal. The exponent is bisected until the weights have a target entropy; a second
bisection finds the least exponent under which no source repeats more often than a limit, and the larger of the two
holds. Weights become a schedule of blocks: a block is one seeded permutation of a source, a source gets as many
whole blocks as its budget pays for and a prefix of one more.

Nothing is ordered in one task. A permutation is the order of an md5; its leading hex digits cut a source into slices
of some thousand rows, slices are summed first, and only rows of one slice meet in a window.

Defined cases: rows of one key, which repeated rows have, and rows without an id of the same number of tokens, are
ordered by id, then tokens, and are otherwise alike; very long texts are counted whole; columns of any name go along
untouched; a null source is a source of its own; null and empty texts have 0 tokens, so they are scheduled in
whole blocks and in a prefix that reaches them; repeated rows are scheduled each; sources without a token get weight 0
and no block; an empty table gives an empty schedule.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foldstore.llm.runtime import clearing, cut

WORD = r"[^\x20\x09-\x0D]+"
#: Points at which one round of the bisection looks: eight halvings of the interval.
POINTS = 255
ROUNDS = 5


def word_tokens(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


@dataclass(frozen=True)
class Mixture:
    """exponent; plan: a row for each source with its tokens, weight, blocks and rest (tokens paid for in the last block)."""

    exponent: float
    plan: DataFrame


def _measure(totals: DataFrame, exponents: list[float], whole: float, budget: float) -> list[tuple[float, float]]:
    """(entropy, most repetitions) of the weights under each exponent, in one aggregation.

    The exponents are an array that the generated code refers to, so that every round runs the code of the first.
    """
    p, a = F.col("mix_tokens") / F.lit(whole), F.col("a")
    power = F.pow("p", a)
    rows = totals.select(p.alias("p"), F.posexplode(F.lit(exponents)).alias("k", "a"))
    sums = rows.groupBy("k").agg(F.sum(power).alias("s"), F.sum(power * F.log("p")).alias("l"), F.max(power / F.col("p")).alias("r"))
    found = {r["k"]: r for r in sums.collect()}  # a row for each exponent
    return [(math.log(r["s"]) - a * r["l"] / r["s"], r["r"] / r["s"] * budget / whole) for a, r in ((a, found[k]) for k, a in enumerate(exponents))]


def _bisect(totals: DataFrame, whole: float, budget: float, meets) -> float:
    """The least exponent in [0, 1] whose measure meets a condition that holds from some exponent on; 1 if none does."""
    if meets(*_measure(totals, [0.0], whole, budget)[0]):
        return 0.0
    low, high = 0.0, 1.0
    for _ in range(ROUNDS):
        at = [low + (high - low) * k / (POINTS + 1) for k in range(1, POINTS + 1)]
        good = [meets(*m) for m in _measure(totals, at, whole, budget)]
        first = good.index(True) if True in good else POINTS
        low, high = (at[first - 1] if first else low), (at[first] if first < POINTS else high)
    return round(high, 9)


def mixture(
    docs: DataFrame, tokens: str, source: str = "source", *, entropy_share: float | None = 0.98, max_repeats: float | None = 4.0,
    epochs: float = 1.0, cover: bool = False,
) -> Mixture:
    """Weights for ``docs``, which has a token count per row.

    entropy_share: target entropy as a share of the entropy of equal weights. max_repeats: no source is read more
    often, if the natural mix allows it. epochs: the budget, in token counts of the table; with ``cover`` it is the
    least budget that reads every source once at least instead.
    """
    totals = cut(
        docs.groupBy(F.col(source).alias("mix_source")).agg(F.sum(tokens).cast("long").alias("mix_tokens"), F.count(F.lit(1)).alias("mix_rows")).where("mix_tokens > 0"),
        "mix-totals",
    )
    head = totals.agg(F.sum("mix_tokens").alias("t"), F.count(F.lit(1)).alias("n"), F.max("mix_tokens").alias("most")).first()
    if not head["n"]:
        return Mixture(1.0, totals.select("mix_source", "mix_tokens", "mix_rows", F.lit(0.0).alias("weight"), F.lit(0).cast("long").alias("blocks"), F.lit(0).cast("long").alias("rest")))
    whole, budget = float(head["t"]), float(head["t"]) * epochs
    most = float(head["most"]) / whole
    found = [0.0]
    if entropy_share is not None:
        target = entropy_share * math.log(head["n"])
        found.append(_bisect(totals, whole, budget, lambda h, _: h <= target + 1e-12))
    if max_repeats is not None:
        if cover:
            found.append(_cover_exponent(totals, whole, most, max_repeats))
        else:
            found.append(_bisect(totals, whole, budget, lambda _, r: r <= max_repeats * (1 + 1e-12)))
    a = max(found)
    p = F.col("mix_tokens") / F.lit(whole)
    norm = totals.agg(F.sum(F.pow(p, F.lit(a))).alias("s")).first()["s"]
    if cover:
        budget = whole * most / (most**a / norm)
    share = F.pow(p, F.lit(a)) / F.lit(norm)
    pays = F.floor(share * F.lit(budget) + F.lit(1e-6)).cast("long")
    plan = totals.select(
        "mix_source", "mix_tokens", "mix_rows", F.round(share, 9).alias("weight"), F.floor(pays / F.col("mix_tokens")).cast("long").alias("blocks"), (pays % F.col("mix_tokens")).alias("rest")
    )
    return Mixture(a, plan)


def _cover_exponent(totals: DataFrame, whole: float, most: float, limit: float) -> float:
    """Least exponent under which the smallest source repeats at most ``limit`` times while the largest is read once."""
    least = totals.agg(F.min("mix_tokens").alias("t")).first()["t"] / whole
    if least == most or (least / most) ** -1.0 <= limit:
        return 0.0
    low, high = 0.0, 1.0
    for _ in range(ROUNDS * 8):
        mid = (low + high) / 2
        low, high = (low, mid) if (least / most) ** (mid - 1) <= limit else (mid, high)
    return round(high, 9)


def _digits(rows: int, per_slice: int) -> int:
    """Leading hex digits of the permutation key that cut ``rows`` rows into slices of about ``per_slice``."""
    return max(1, math.ceil(math.log(max(1.0, rows / per_slice), 16)))


def _key(seed: int, block: Column, doc: Column, tokens: Column) -> Column:
    """Rows without an id go by their tokens, so that they don't all fall into one slice."""
    name = F.coalesce(doc.cast("string"), F.concat(F.lit("null"), tokens.cast("string")))
    return F.md5(F.concat_ws(":", F.lit(str(seed)), block.cast("string"), name))


def _in_order(rows: DataFrame, digits: int) -> DataFrame:
    """Adds mix_pos (from 1) and mix_cum (tokens up to and with the row) in the order of (mix_key, mix_doc, mix_tok) within (mix_source, mix_block)."""
    rows = rows.withColumn("mix_slice", F.substring("mix_key", 1, digits))
    sums = rows.groupBy("mix_source", "mix_block", "mix_slice").agg(F.count(F.lit(1)).alias("c"), F.sum("mix_tok").alias("t"))
    before = Window.partitionBy("mix_source", "mix_block").orderBy("mix_slice").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(
        F.col("mix_source").alias("s_source"), F.col("mix_block").alias("s_block"), F.col("mix_slice").alias("s_slice"),
        F.coalesce(F.sum("c").over(before), F.lit(0)).alias("c0"), F.coalesce(F.sum("t").over(before), F.lit(0)).alias("t0"),
    )
    within = Window.partitionBy("mix_source", "mix_block", "mix_slice").orderBy("mix_key", "mix_doc", "mix_tok")
    ranked = rows.withColumn("r", F.row_number().over(within)).withColumn("u", F.sum("mix_tok").over(within.rowsBetween(Window.unboundedPreceding, 0)))
    met = ranked.join(sums, F.col("mix_source").eqNullSafe(F.col("s_source")) & (F.col("mix_block") == F.col("s_block")) & (F.col("mix_slice") == F.col("s_slice")))
    return met.withColumn("mix_pos", F.col("c0") + F.col("r")).withColumn("mix_cum", F.col("t0") + F.col("u"))


def _slim(docs: DataFrame, tokens: Column, source: str, doc: str) -> DataFrame:
    return cut(docs.select(F.col(source).alias("mix_source"), F.col(doc).alias("mix_doc"), tokens.alias("mix_tok")), "mix-rows")


@clearing
def schedule(docs: DataFrame, *, source: str = "source", doc: str = "doc_id", text: str = "text", seed: int = 0, per_slice: int = 20_000, **limits) -> DataFrame:
    """Every scheduled reading: source, block (from 0), position (from 1 in its block), doc_id, tokens, weight.

    Whole blocks hold all rows of their source; the last block holds the rows whose running token count stays within
    the rest of the budget.
    """
    slim = _slim(docs, word_tokens(text), source, doc)
    plan = mixture(slim, "mix_tok", "mix_source", **limits).plan
    most = plan.agg(F.max("mix_rows").alias("m")).first()["m"] or 0
    plan = plan.select(F.col("mix_source").alias("p_source"), "weight", "blocks", "rest")
    rows = (
        slim.join(plan, F.col("mix_source").eqNullSafe(F.col("p_source")))
        .withColumn("mix_block", F.explode(F.sequence(F.lit(0).cast("long"), F.when(F.col("rest") > 0, F.col("blocks")).otherwise(F.col("blocks") - 1))))
        .where(F.col("mix_block") >= 0)
        .withColumn("mix_key", _key(seed, F.col("mix_block"), F.col("mix_doc"), F.col("mix_tok")))
    )
    found = _in_order(rows, _digits(most, per_slice)).where((F.col("mix_block") < F.col("blocks")) | (F.col("mix_cum") <= F.col("rest")))
    return found.select(F.col("mix_source").alias("source"), F.col("mix_block").cast("int").alias("block"), F.col("mix_pos").alias("position"), F.col("mix_doc").alias("doc_id"), F.col("mix_tok").alias("tokens"), "weight")


@clearing
def apply_mixture(docs: DataFrame, *, source: str = "source", doc: str = "doc_id", text: str = "text", seed: int = 0, per_slice: int = 20_000, **limits) -> DataFrame:
    """The rows of ``docs``, each as often as the schedule reads it; texts are never shuffled.

    The prefix of a source's last block ends at one key, found from narrow rows; whole rows are then compared with
    that key where they lie.
    """
    slim = _slim(docs, word_tokens(text), source, doc)
    plan = mixture(slim, "mix_tok", "mix_source", **limits).plan
    most = plan.agg(F.max("mix_rows").alias("m")).first()["m"] or 0
    p = plan.select(F.col("mix_source").alias("p_source"), "blocks", "rest")
    last = slim.join(p, F.col("mix_source").eqNullSafe(F.col("p_source"))).where("rest > 0").withColumn("mix_block", F.col("blocks")).withColumn("mix_key", _key(seed, F.col("mix_block"), F.col("mix_doc"), F.col("mix_tok")))
    order = F.struct("mix_key", "mix_doc", "mix_tok")
    ends = _in_order(last, _digits(most, per_slice)).where("mix_cum <= rest").groupBy("mix_source").agg(F.max(order).alias("mix_end"))
    ends = cut(p.join(ends, F.col("p_source").eqNullSafe(F.col("mix_source")), "left").select("p_source", "blocks", "mix_end"), "mix-ends")
    # A row travels as one struct, so that its columns may have any names.
    rows = docs.select(F.col(source).alias("mix_source"), F.col(doc).alias("mix_doc"), word_tokens(text).alias("mix_tok"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    here = F.struct(_key(seed, F.col("blocks"), F.col("mix_doc"), F.col("mix_tok")).alias("mix_key"), "mix_doc", "mix_tok")
    times = F.col("blocks") + F.when(F.col("mix_end").isNotNull() & (here <= F.col("mix_end")), 1).otherwise(0)
    read = rows.join(ends, F.col("mix_source").eqNullSafe(F.col("p_source"))).withColumn("mix_times", times).where("mix_times > 0")
    return read.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("mix_times")))).select("row.*")
