"""Queries over live cells: point and batch lookups, wide views, enrichment of other tables."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldstore.functions.codec import require_key
from foldstore.functions.fields import FieldType, decode_cell


def get(state: DataFrame, key, field: str) -> DataFrame:
    """One row: exists, type and value of a field of a document; nulls if either is absent. A key that lies in several
    log partitions answers with its last write."""
    key = F.lit(bytearray(require_key(key))) if not isinstance(key, (int, Column)) else (key if isinstance(key, Column) else F.lit(key))
    found = state.where((F.col("pk") == key) & (F.col("field") == field)).select("type", "value", "off")
    return found.agg(F.count(F.lit(1)).alias("n"), F.max_by("type", "off").alias("type"), F.max_by("value", "off").alias("value")).select((F.col("n") > 0).alias("exists"), "type", "value")


def get_as(state: DataFrame, key, field: str, kind: FieldType) -> DataFrame:
    """As ``get``, decoded; null where the cell has another type."""
    return get(state, key, field).select("exists", decode_cell("type", "value", kind).alias("value"))


def order_keys(bytes_keys: Iterable = (), string_keys: Iterable = ()) -> list[bytes]:
    """Keys of a mixed request in their order: bytes first, then strings; empty ones are left out."""
    return [k for k in [*map(require_key, bytes_keys), *map(require_key, string_keys)] if k]


def multiget(state: DataFrame, keys: DataFrame, fields: list[str], *, empty_as_null: bool = False) -> DataFrame:
    """The dense product of keys (kpos, pk) and fields: kpos, fpos, pk, field, value; absent cells are null.

    Duplicates are kept, positions give the order. No keys or no fields give no rows; empty field names are left out,
    as empty keys are. A document that lies in several log partitions answers with its last write.
    """
    fields = [f for f in fields if f]
    asked = keys.where(F.octet_length(F.col("pk").cast("binary")) > 0) if dict(keys.dtypes)["pk"] in ("binary", "string") else keys
    if not fields:
        wanted = asked.select("kpos", F.lit(0).alias("fpos"), "pk", F.lit("").alias("field")).limit(0)
    else:
        wanted = asked.select("kpos", "pk", F.posexplode(F.array(*map(F.lit, fields))).alias("fpos", "field"))
    # Duplicates ask once; a key that is asked for very often doesn't repeat the state's cells.
    distinct = wanted.select("pk", "field").distinct()
    cells = state.join(distinct, ["pk", "field"], "left_semi").groupBy("pk", "field").agg(F.max_by("value", "off").alias("value"))
    out = wanted.join(cells, ["pk", "field"], "left")
    if empty_as_null:
        out = out.withColumn("value", F.when(F.octet_length("value") > 0, F.col("value")))
    return out.select("kpos", "fpos", "pk", "field", "value")


def wide_view(state: DataFrame, columns: Mapping[str, FieldType] | list[str]) -> DataFrame:
    """A row for each live document and a column for each field.

    Given types, payloads are decoded and a cell of another type is null; given names only, values stay as they are.
    """
    names = list(columns)
    value = lambda n: F.max_by(F.when(F.col("field") == n, F.col("value")), F.when(F.col("field") == n, F.col("off")))
    tag = lambda n: F.max_by(F.when(F.col("field") == n, F.col("type")), F.when(F.col("field") == n, F.col("off")))
    if not isinstance(columns, Mapping):
        return state.groupBy("log_partition", "pk").agg(*[value(n).alias(n) for n in names])
    raw = state.groupBy("log_partition", "pk").agg(*[x for n in names for x in (value(n).alias(f"v_{n}"), tag(n).alias(f"t_{n}"))])
    return raw.select("log_partition", "pk", *[decode_cell(f"`t_{n}`", f"`v_{n}`", kind).alias(n) for n, kind in columns.items()])


def mismatches(state: DataFrame, columns: Mapping[str, FieldType]) -> DataFrame:
    """(field, cells) of cells that a typed view reads as null for their type."""
    kinds = F.create_map(*[F.lit(x) for n, k in columns.items() for x in (n, int(k))])
    return state.where(F.col("field").isin(*columns) & (F.col("type") != kinds[F.col("field")])).groupBy("field").agg(F.count(F.lit(1)).alias("cells"))


def enrich(requests: DataFrame, features: DataFrame, on: Column, how: str = "left") -> DataFrame:
    """Requests with the columns of a wide view. Catalyst picks the join: small views go to the requests by their measured size, skewed keys are split at run time."""
    return requests.join(features, on, how)


def document(state: DataFrame) -> DataFrame:
    """Whole documents: log_partition, pk and a map of all live fields."""
    entries = F.sort_array(F.collect_list(F.struct("field", F.struct("type", "value").alias("cell"))))
    return state.groupBy("log_partition", "pk").agg(F.map_from_entries(entries).alias("doc"))
