"""The fold of a mutation log into live cells, in closed form.

Every mutation raises a horizon: an upsert or field delete that of one cell, a document delete that of a document, a drop
that of a field or of everything in its log partition. A cell is live if its last write was an upsert and lies above all
its horizons. Maxima don't depend on order or repetition, so the fold needs no ordered pass, takes partial aggregates
before its shuffle, is maintained incrementally, and, as long as horizons are kept, is indifferent to redelivery.

Events: log_partition, log_offset, op (upsert, delete_fields, delete_doc, drop, noop), pk, doc map<name,
struct<type, value>>, fields, prefixes, drop_all. ``value`` may have any one type. Cells: log_partition, pk, field,
type, value, off.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foldstore.functions.fields import known

EVENT = (
    "log_partition int, log_offset bigint, op string, pk binary, doc map<string,struct<type:int,value:binary>>, "
    "fields array<string>, prefixes array<string>, drop_all boolean"
)
STATE = "log_partition int, pk binary, field string, type int, value binary, off bigint"
KEY = ["log_partition", "pk"]


def _filled(names: str) -> Column:
    return F.coalesce(F.size(F.col(names)), F.lit(0)) > 0


def writes(events: DataFrame) -> DataFrame:
    """A row for each cell that an event writes or clears; values of unknown type are skipped."""
    upserts = events.where((F.col("op") == "upsert") & F.col("pk").isNotNull()).select(*KEY, F.col("log_offset").alias("off"), F.explode("doc").alias("field", "cell"))
    upserts = upserts.where(known(F.col("cell.type"))).select(*KEY, "field", "cell.type", "cell.value", "off", F.lit(False).alias("deleted"))
    value = next(f.dataType for f in upserts.schema if f.name == "value")
    clears = events.where((F.col("op") == "delete_fields") & F.col("pk").isNotNull()).select(*KEY, F.col("log_offset").alias("off"), F.explode("fields").alias("field"))
    clears = clears.select(*KEY, "field", F.lit(None).cast("int").alias("type"), F.lit(None).cast(value).alias("value"), "off", F.lit(True).alias("deleted"))
    return upserts.unionByName(clears)


def drops(events: DataFrame) -> DataFrame:
    """(log_partition, kind, arg, off) of what drop events name; everything only if they name nothing."""
    d = events.where(F.col("op") == "drop")
    part, off = F.col("log_partition"), F.col("log_offset").alias("off")
    names = d.where(_filled("fields")).select(part, F.lit("name").alias("kind"), F.explode("fields").alias("arg"), off)
    prefixes = d.where(_filled("prefixes")).select(part, F.lit("prefix").alias("kind"), F.explode("prefixes").alias("arg"), off)
    whole = d.where(~_filled("fields") & ~_filled("prefixes") & F.coalesce("drop_all", F.lit(False))).select(part, F.lit("all").alias("kind"), F.lit("").alias("arg"), off)
    return names.union(prefixes).union(whole).groupBy("log_partition", "kind", "arg").agg(F.max("off").alias("off"))


HORIZON = "log_partition int, kind string, pk binary, arg string, off bigint"


def horizons(events: DataFrame, base: DataFrame | None = None) -> DataFrame:
    """(log_partition, kind, pk, arg, off): the last offset at which a cell, a document, a field, a prefix or everything was
    deleted, by ``events`` and in ``base``. With them an image takes any event again, in any order, and doesn't change."""
    pk = F.col("pk")
    none = F.lit(None).cast(next(f.dataType for f in events.schema if f.name == "pk"))
    cells = events.where((F.col("op") == "delete_fields") & pk.isNotNull()).select("log_partition", F.lit("cell").alias("kind"), pk, F.explode("fields").alias("arg"), F.col("log_offset").alias("off"))
    documents = events.where((F.col("op") == "delete_doc") & pk.isNotNull()).select("log_partition", F.lit("doc").alias("kind"), pk, F.lit("").alias("arg"), F.col("log_offset").alias("off"))
    found = cells.union(documents).union(drops(events).select("log_partition", "kind", none.alias("pk"), "arg", "off"))
    if base is not None:
        found = found.unionByName(base)
    return found.groupBy("log_partition", "kind", "pk", "arg").agg(F.max("off").alias("off"))


def _mutations(events: DataFrame) -> DataFrame:
    """A row for each cell that an event writes or clears, and one without a field for each deleted document, in one pass."""
    kinds = {f.name: f.dataType for f in events.schema}
    value = kinds["doc"].valueType["value"].dataType
    row = lambda field, type_, v, deleted: F.struct(field.alias("field"), type_.cast("int").alias("type"), v.cast(value).alias("value"), F.lit(deleted).alias("deleted"))
    null = F.lit(None)
    entries = F.filter(F.map_entries("doc"), lambda e: known(e["value"]["type"]))
    rows = (
        F.when(F.col("op") == "upsert", F.transform(entries, lambda e: row(e["key"], e["value"]["type"], e["value"]["value"], False)))
        .when(F.col("op") == "delete_fields", F.transform("fields", lambda f: row(f, null, null, True)))
        .when(F.col("op") == "delete_doc", F.array(row(null.cast("string"), null, null, True)))
    )
    return events.where(F.col("op").isin("upsert", "delete_fields", "delete_doc") & F.col("pk").isNotNull()).select(*KEY, F.col("log_offset").alias("off"), F.inline(rows))


def fold(events: DataFrame, primary_key: str, base: DataFrame | None = None, deleted: DataFrame | None = None) -> DataFrame:
    """Live cells after ``events``, on top of the live cells ``base`` of what came before.

    deleted: the horizons of what came before. Without them redelivered events must be a run up to the end of the log,
    since those before the base find their deletes forgotten.
    """
    rows = _mutations(events)
    dropped = drops(events)
    if base is not None:
        rows = rows.unionByName(base.select(*KEY, "off", "field", "type", "value", F.lit(False).alias("deleted")))
    if deleted is not None:
        null = F.lit(None)
        value = next(f.dataType for f in rows.schema if f.name == "value")
        mine = deleted.where("kind in ('cell', 'doc')")
        rows = rows.unionByName(mine.select(*KEY, "off", F.when(F.col("kind") == "cell", F.col("arg")).alias("field"), null.cast("int").alias("type"), null.cast(value).alias("value"), F.lit(True).alias("deleted")))
        dropped = dropped.union(deleted.where("kind not in ('cell', 'doc')").select("log_partition", "kind", "arg", "off"))
    # Columns are picked one by one, so that values of fixed width aggregate by hash. A document's horizon is its row without a field.
    by = lambda c: F.max_by(c, "off").alias(c)
    now = rows.groupBy(*KEY, "field").agg(by("type"), by("value"), by("deleted"), F.max("off").alias("off"))
    now = now.withColumn("doc_off", F.max(F.when(F.col("field").isNull(), F.col("off"))).over(Window.partitionBy(*KEY)))
    # A row for each log partition, with as many entries as names and prefixes were ever dropped there.
    lists = dropped.groupBy("log_partition").agg(F.collect_list(F.when(F.col("kind") != "all", F.struct("kind", "arg", "off"))).alias("named"), F.max(F.when(F.col("kind") == "all", F.col("off"))).alias("all_off"))
    live = now.where("field is not null and not deleted").join(lists, "log_partition", "left")
    field = F.col("field")
    hits = F.filter("named", lambda d: ((d["kind"] == "name") & (d["arg"] == field)) | ((d["kind"] == "prefix") & F.startswith(field, d["arg"])))
    live = live.withColumn("field_off", F.when(field != primary_key, F.array_max(F.transform(hits, lambda d: d["off"]))))
    above = lambda c: F.col("off") > F.coalesce(c, F.lit(-1))
    return live.where(above("doc_off") & above("field_off") & above("all_off")).select(*KEY, "field", "type", "value", "off")


def as_of(events: DataFrame, primary_key: str, offset: int) -> DataFrame:
    """Live cells as they were after the given offset."""
    return fold(events.where(F.col("log_offset") <= offset), primary_key)


def registry(events: DataFrame, primary_key: str) -> DataFrame:
    """(log_partition, field, field_id, first_offset) of every field that an upsert has named, whatever its type; the primary key is 0, others follow in the order of their first event and name."""
    names = events.where(F.col("op") == "upsert").select("log_partition", F.col("log_offset").alias("off"), F.explode(F.map_keys("doc")).alias("field"))
    first = names.groupBy("log_partition", "field").agg(F.min("off").alias("first_offset"))
    # One row for each field name: names are few, and the window sees just these.
    order = Window.partitionBy("log_partition").orderBy((F.col("field") != primary_key), "first_offset", "field")
    return first.withColumn("n", F.row_number().over(order)).select("log_partition", "field", F.when(F.col("field") == primary_key, 0).otherwise(F.col("n") - F.max((F.col("field") == primary_key).cast("int")).over(Window.partitionBy("log_partition"))).cast("int").alias("field_id"), "first_offset")
