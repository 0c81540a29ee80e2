"""The corpus pipeline: toxic documents out, documents without a language out, one of each group of near copies kept,
sources mixed to target weights, and what remains packed into training sequences.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
stage's ``docs``. All but the last return the columns of ``docs``: a row travels as one struct beside the columns that
an operator works on, so that extra columns of any name pass through untouched.

Defined cases: null and empty texts aren't toxic and have no language, so the language stage rejects them; documents
with a null id are kept by the near-copy stage; of repeated rows it keeps one; empty tables stay empty.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foldstore.llm import jaccard_join, langid, mixing, packing, toxicity
from foldstore.llm.runtime import cut, table

TOKENIZER = "word_bpe_49k.json"
#: How often the rarest source may be read while the largest is read once.
MOST_REPEATS = 1.25


def _carried(docs: DataFrame, *columns: str) -> DataFrame:
    return docs.select(*columns, F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents whose toxicity score is 0.5 or more."""
    model = toxicity.fit(docs.select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return toxicity.score(_carried(docs, "text"), model, ["row"]).where("tox_score < 0.5").select("row.*")


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a letter, and those that lie further from every language than labelled documents do.

    The limit lies midway between the distance that all but a thousandth of the labelled documents keep and the distance
    of a text that shares no n-gram with any language.
    """
    profiles = langid.fit(docs.select("doc_id", "text", "lang"))
    found = cut(langid.measure(_carried(docs, "text", "lang"), profiles, ["row", "lang"]), "pipeline-languages").where(F.col("lang_pred") != langid.UNKNOWN)
    usual = found.where("lang is not null").agg(F.percentile_approx("lang_away", 0.999, 100_000)).first()[0]
    limit = 1.0 if usual is None else (1 + usual) / 2
    return found.where(F.col("lang_away") <= limit).select("row.*")


def ngram_join_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group of near copies."""
    found = jaccard_join.join(docs.select("doc_id", "text"))
    kept = found.where("doc_id = component_id").select(F.col("doc_id").alias("kept_id")).distinct()
    rows = _carried(docs, F.col("doc_id").cast("long").alias("doc_id"))
    once = Window.partitionBy("doc_id").orderBy(F.lit(0))
    first = rows.join(kept, F.col("doc_id") == F.col("kept_id"), "left_semi").withColumn("nth", F.row_number().over(once)).where("nth = 1")
    return first.select("row.*").union(rows.where("doc_id is null").select("row.*"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Reads every document of a source that has tokens once at least, and those of small sources again, as the weights
    say; a source without a token has no weight and goes."""
    return mixing.apply_mixture(_carried(docs, "doc_id", "text", "source"), entropy_share=None, max_repeats=MOST_REPEATS, cover=True, seed=7).select("row.*")


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece: its document, its place there, its sequence and its place there."""
    return packing.pack(docs.select("doc_id", "text"), public_tokenizers.path(TOKENIZER))


STAGES = [
    ("toxicity", toxicity_stage),
    ("language_id", language_stage),
    ("ngram_join", ngram_join_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs


#: The models, the components and the packing have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None
