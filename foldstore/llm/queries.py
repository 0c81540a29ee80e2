"""The queries opN_<name>: each operator over its whole table, with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldstore.llm import ann, html_blocks, jaccard_join, langid, media, mixing, packing, toxicity, warc
from foldstore.llm.runtime import crc_mod, cut, scratch, table
from foldstore.llm.token_rollup import DeltaRollup

WS_1, ALNUM_1, ALNUM_2 = r"[^\x20\x09-\x0D]+", r"[A-Za-z]+|[0-9]+", r"[A-Za-z]+|[0-9]|[^A-Za-z0-9\x20\x09-\x0D]"


def op1_webp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.round_trip(table(spark, sf_dir, "documents"), ["doc_id"])


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")), ["doc_id"])
    held = crc_mod("doc_id", toxicity.FOLDS) == toxicity.HELD_OUT
    return scored.select("doc_id", held.alias("held_out"), F.col("tox_score").alias("score"), (F.col("tox_score") >= 0.5).cast("int").alias("predicted"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op4_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals after four deliveries: all documents come in under two tokenizers; one tokenizer is revised for all of
    them; the revision is delivered again and changes nothing; exact copies of a smaller doc_id are deleted."""
    count = lambda p: F.coalesce(F.regexp_count("text", F.lit(p)), F.lit(0)).cast("long")
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", F.col("source").cast("string"), F.col("lang").cast("string"), F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("chars"),
        count(WS_1).alias("ws1"), count(ALNUM_1).alias("alnum1"), count(ALNUM_2).alias("alnum2"), F.md5(F.coalesce("text", F.lit(""))).alias("digest"),
    )
    docs = cut(docs, "op4-docs")
    side = lambda version, n: F.struct("source", "lang", F.lit(version).alias("tokenizer"), F.col(n).alias("tokens"), "chars")
    none = F.lit(None).cast("struct<source:string,lang:string,tokenizer:string,tokens:bigint,chars:bigint>")
    change = lambda kind, old, new: F.struct(F.lit(kind).alias("kind"), old.alias("old"), new.alias("new"))
    each = lambda rows, *changes: rows.select(F.inline(F.array(*changes)))
    # Only texts that occur twice are looked for, and the copies of one text in many tasks.
    first = docs.groupBy("digest").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("n")).where("n > 1")
    first = first.select("digest", "first_id", F.explode(F.sequence(F.lit(0), F.lit(15))).alias("salt"))
    copies = docs.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(16)).cast("int")).join(first, ["digest", "salt"]).where("doc_id > first_id")
    ws, old, new = side("ws-1", "ws1"), side("alnum-1", "alnum1"), side("alnum-2", "alnum2")
    rollup = DeltaRollup(spark, scratch(spark, "op4-rollup"))
    rollup.commit("load", each(docs, change("insert", none, ws), change("insert", none, old)))
    rollup.commit("alnum-2", each(docs, change("revise", old, new)))
    rollup.commit("alnum-2", each(docs, change("revise", old, new)))
    rollup.commit("copies", each(copies, change("delete", ws, none), change("delete", new, none)))
    return rollup.totals()


def op5_lang_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = langid.predict(docs, langid.fit(docs), ["doc_id"])
    held = crc_mod("doc_id", langid.FOLDS) == langid.HELD_OUT
    return found.select("doc_id", held.alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))


def op6_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_blocks.extract(table(spark, sf_dir, "pages"), ["page_id", "url"])


def op7_kmeans_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), lambda vec_id: vec_id % 100 == 0, k=10)


def op8_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join(table(spark, sf_dir, "documents"))


def op10_temperature_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The schedule of one epoch's budget, at 98 % of the entropy of equal sources or at most 4 readings of any."""
    return mixing.schedule(table(spark, sf_dir, "documents"), entropy_share=0.98, max_repeats=4.0, epochs=1.0, seed=7)


QUERIES = {
    "op1_webp": op1_webp,
    "op2_toxicity": op2_toxicity,
    "op3_warc": op3_warc,
    "op4_token_rollup": op4_token_rollup,
    "op5_lang_id": op5_lang_id,
    "op6_html_extract": op6_html_extract,
    "op7_kmeans_tree": op7_kmeans_tree,
    "op8_best_fit": op8_best_fit,
    "op9_ngram_join": op9_ngram_join,
    "op10_temperature_mix": op10_temperature_mix,
}
