"""Which events of a raw log are good, and why the others are not."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldstore.functions.fields import known, well_formed

MOST_KEY_BYTES = 65_535
OPS = ("upsert", "delete_fields", "delete_doc", "drop", "noop")


def key_of(doc: str, primary_key: str) -> Column:
    """Payload of the primary key field; its type doesn't matter for identity, but it must have one."""
    cell = F.try_element_at(F.col(doc), F.lit(primary_key))
    return F.when(known(cell["type"]), cell["value"])


def check(events: DataFrame, primary_key: str) -> DataFrame:
    """Adds pk, and problem: null for a good event, else the reason why it can't be applied."""
    keyed = F.col("op").isin("upsert", "delete_fields", "delete_doc")
    pk = F.when(keyed, key_of("doc", primary_key))
    quiet = (
        F.col("op").isNull()
        | (F.col("op") == "noop")
        | (keyed & (F.coalesce(F.size("doc"), F.lit(0)) <= 0))
        | ((F.col("op") == "delete_fields") & (F.coalesce(F.size("fields"), F.lit(0)) <= 0))
    )
    damaged = F.exists(F.map_values("doc"), lambda c: known(c["type"]) & ~well_formed(c["type"], c["value"]))
    problem = (
        F.when(quiet, None)
        .when(~F.col("op").isin(*OPS), "unknown operation")
        .when(keyed & pk.isNull(), "no primary key")
        .when((F.col("op") == "upsert") & (F.octet_length(pk) > MOST_KEY_BYTES), "primary key too long")
        .when((F.col("op") == "upsert") & F.coalesce(damaged, F.lit(False)), "payload of another width than its type")
    )
    # What asks for nothing becomes a no-op; an empty key names no document.
    nothing = quiet | (keyed & (F.octet_length(pk) == 0))
    checked = events.withColumn("pk", pk).withColumn("problem", problem)
    return checked.withColumn("op", F.when(F.col("problem").isNull() & nothing, F.lit("noop")).otherwise(F.col("op")))


def split(events: DataFrame, primary_key: str) -> tuple[DataFrame, DataFrame]:
    """(good events, dead letters): a bad event is set aside and the rest goes on."""
    checked = check(events, primary_key)
    return checked.where("problem is null").drop("problem"), checked.where("problem is not null")
