"""Compaction and its statistics, offset bounds, commit points, staleness of images, newest versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foldstore.functions.codec import image_parts, version

COMMIT_EVERY = 100
STALE_AFTER_MS = 7 * 24 * 60 * 60 * 1000


def payload_bytes(value: Column) -> Column:
    return F.coalesce(F.octet_length(value.cast("binary")), F.lit(0)).cast("long")


def sizes(cells: DataFrame) -> DataFrame:
    """(cells, documents, bytes) of a table of cells."""
    per_doc = cells.groupBy("log_partition", "pk").agg(F.count(F.lit(1)).alias("n"), F.sum(payload_bytes(F.col("value"))).alias("b"))
    return per_doc.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("cells"), F.count(F.lit(1)).alias("documents"), F.coalesce(F.sum("b"), F.lit(0)).alias("bytes"))


def compaction_stats(written: DataFrame, live: DataFrame) -> DataFrame:
    """One row: sizes of all written cells and of the live ones."""
    before, after = sizes(written), sizes(live)
    return before.select(*[F.col(c).alias(f"{c}_before") for c in before.columns]).crossJoin(after.select(*[F.col(c).alias(f"{c}_after") for c in after.columns]))


def aggregate_stats(stats: DataFrame) -> DataFrame:
    """Sums of the statistics of many parts."""
    return stats.agg(*[F.sum(c).alias(c) for c in stats.columns])


def compacted(live: DataFrame, buckets: int | None = None) -> DataFrame:
    """Live cells laid out for lookups: documents together, sorted by key within files, so that row groups are skipped."""
    by = ["log_partition", "pk"]
    return (live.repartition(buckets, *by) if buckets else live.repartition(*by)).sortWithinPartitions(*by, "field")


def offset_bounds(events: DataFrame) -> DataFrame:
    """(log_partition, low, high): the first offset, and the one after the last."""
    return events.groupBy("log_partition").agg(F.min("log_offset").alias("low"), (F.max("log_offset") + 1).alias("high"))


def start_offsets(bounds: DataFrame, stored: DataFrame) -> DataFrame:
    """(log_partition, start): the stored offset if the log still has it, else the log's first. The stored one is processed again."""
    s = stored.select("log_partition", F.col("off").alias("stored"))
    return bounds.join(s, "log_partition", "left").select("log_partition", F.when(F.col("stored") >= F.col("low"), F.col("stored")).otherwise(F.col("low")).alias("start"))


def commit_points(events: DataFrame, every: int = COMMIT_EVERY) -> DataFrame:
    """(log_partition, off) after each run of ``every`` events of a dense log."""
    return events.where((F.col("log_offset") + 1) % every == 0).select("log_partition", F.col("log_offset").alias("off"))


def latest_image(paths: DataFrame) -> DataFrame:
    """(account, store, partition, epoch, path) of the newest image of each exact partition."""
    p = paths.select("path", image_parts(F.col("path")).alias("p")).select("path", "p.*").where("epoch is not null")
    return p.groupBy("account", "store", "partition").agg(F.max("epoch").alias("epoch"), F.max_by("path", "epoch").alias("path"))


def stale(local_epoch: Column, remote_epoch: Column, now_ms: Column, valid: Column | None = None) -> Column:
    """True if the local image is missing, invalid, or old while a fresh one is there."""
    missing = local_epoch.isNull() | (local_epoch == 0)
    old = (now_ms - local_epoch >= STALE_AFTER_MS) & (now_ms - remote_epoch < STALE_AFTER_MS)
    bad = ~valid if valid is not None else F.lit(False)
    return F.coalesce(missing | bad | old, F.lit(False))


def newest_version(versions: DataFrame, column: str = "version") -> DataFrame:
    return versions.agg(F.max_by(column, version(column)).alias(column))


def renumbered(fields: DataFrame) -> DataFrame:
    """(log_partition, field, field_id, old_id): ids without gaps in the order of the old ones, as a compaction gives them."""
    order = Window.partitionBy("log_partition").orderBy("field_id", "field")
    return fields.select("log_partition", "field", (F.row_number().over(order) - 1).cast("int").alias("field_id"), F.col("field_id").alias("old_id"))


def sizes_by_partition(cells: DataFrame) -> DataFrame:
    """Sizes as in ``sizes``, a row for each log partition."""
    per_doc = cells.groupBy("log_partition", "pk").agg(F.count(F.lit(1)).alias("n"), F.sum(payload_bytes(F.col("value"))).alias("b"))
    return per_doc.groupBy("log_partition").agg(F.sum("n").alias("cells"), F.count(F.lit(1)).alias("documents"), F.sum("b").alias("bytes"))
