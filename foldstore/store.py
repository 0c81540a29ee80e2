"""A store: its configuration, its log, its images, and the state that they make together."""

from __future__ import annotations

import time
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foldstore.config import StoreConfig, merge_options
from foldstore.document import Document
from foldstore.functions.fields import FieldType
from foldstore.operators import lookup, maintenance
from foldstore.operators.validation import split
from foldstore.plans.fold import drops, fold, horizons, registry, writes
from foldstore.sources import files
from foldstore.sources.event_log import EventLog
from foldstore.sources.snapshots import Image, Snapshots
from foldstore.streaming.maintainer import Maintainer


class Store:
    def __init__(self, spark: SparkSession, config: StoreConfig):
        self.spark, self.config = spark, config
        root = f"{config.path.rstrip('/')}/{config.account}/{config.store}"
        self.root = root
        self.log = EventLog(spark, f"{root}/log", config)
        self.images = Snapshots(spark, f"{root}/images")
        self.live = Snapshots(spark, f"{root}/live")  # what a maintainer publishes

    # ---- life of a store

    @classmethod
    def create(cls, spark: SparkSession, config: StoreConfig) -> Store:
        """A new store; an error if its name is taken."""
        store = cls(spark, config)
        if not files.write_text(spark, f"{store.root}/config.json", config.to_json()):
            raise ValueError(f"the store {config.account}/{config.store} exists")
        return store

    @classmethod
    def open(cls, spark: SparkSession, path: str, account: str, store: str, options: Mapping | None = None) -> Store:
        """A store with its saved configuration; options of the reader lie over those saved."""
        at = f"{path.rstrip('/')}/{account}/{store}/config.json"
        if not files.exists(spark, at):
            raise ValueError(f"no store {account}/{store}")
        saved = StoreConfig.from_json(files.read_text(spark, at))
        return cls(spark, StoreConfig(**{**saved.__dict__, "path": path, "options": merge_options(saved.options, dict(options or {}))}))

    def delete(self) -> None:
        files.delete(self.spark, self.root)

    # ---- writing

    def upsert(self, rows: DataFrame, fields: Mapping[str, FieldType]) -> int:
        return self.log.upsert(rows, fields)

    def put(self, *documents: Document) -> int:
        """Upserts of documents built one by one."""
        return self.log.upsert_documents(documents)

    def delete_fields(self, rows: DataFrame, fields: Mapping[str, FieldType], names: list[str]) -> int | None:
        return self.log.delete_fields(rows, fields, names)

    def delete_documents(self, rows: DataFrame, fields: Mapping[str, FieldType]) -> int:
        return self.log.delete_documents(rows, fields)

    def drop_fields(self, names: list[str] = (), prefixes: list[str] = ()) -> int | None:
        return self.log.drop_fields(names, prefixes)

    def drop_all(self) -> int | None:
        return self.log.drop_fields(everything=True)

    # ---- reading

    def _base(self) -> tuple[Image | None, Snapshots]:
        """The image that reaches furthest, and its shelf."""
        found = [(image, shelf) for shelf in (self.images, self.live) if (image := shelf.latest())]
        return max(found, key=lambda x: sum(x[0].offsets.values()), default=(None, self.images))

    def state(self) -> DataFrame:
        """Live cells: the image that reaches furthest and the events above it."""
        image, shelf = self._base()
        good, _ = split(self.log.read(image.offsets if image else None), self.config.primary_key)
        return fold(good, self.config.primary_key, shelf.cells(image), shelf.deleted(image)) if image else fold(good, self.config.primary_key)

    def dead_letters(self) -> DataFrame:
        return split(self.log.read(), self.config.primary_key)[1]

    def get(self, key, field: str) -> bytes | None:
        row = lookup.get(self.state(), key, field).first()
        return bytes(row["value"]) if row["exists"] else None

    def get_string(self, key, field: str) -> str | None:
        value = self.get(key, field)
        return None if value is None else value.decode()

    def get_as(self, key, field: str, kind: FieldType):
        """A typed value; None if it is absent or has another type."""
        return lookup.get_as(self.state(), key, field, kind).first()["value"]

    def get_int(self, key, field: str) -> int | None:
        return self.get_as(key, field, FieldType.INT32)

    def get_long(self, key, field: str) -> int | None:
        return self.get_as(key, field, FieldType.INT64)

    def get_float(self, key, field: str) -> float | None:
        return self.get_as(key, field, FieldType.FLOAT32)

    def get_double(self, key, field: str) -> float | None:
        return self.get_as(key, field, FieldType.FLOAT64)

    def get_bool(self, key, field: str) -> bool | None:
        return self.get_as(key, field, FieldType.BOOLEAN)

    def multiget(self, bytes_keys: list = (), string_keys: list = (), fields: list[str] = ()) -> list[bytes | None]:
        """Values in the order of keys (bytes first), then fields."""
        keys = lookup.order_keys(bytes_keys, string_keys)
        if not keys or not fields:
            return []
        asked = self.spark.createDataFrame([(i, bytearray(k)) for i, k in enumerate(keys)], "kpos int, pk binary")
        rows = lookup.multiget(self.state(), asked, list(fields)).orderBy("kpos", "fpos").select("value").toLocalIterator()
        return [None if r[0] is None else bytes(r[0]) for r in rows]

    def wide(self, columns: Mapping[str, FieldType]) -> DataFrame:
        return lookup.wide_view(self.state(), columns)

    def fields(self) -> DataFrame:
        """(log_partition, field, field_id) of the registered fields that no later drop covers.

        Ids are those of the last compaction; fields met since follow in the order of their first event and name. Fields
        are few, a schema's worth for each log partition.
        """
        pk, image = self.config.primary_key, self.images.latest()
        events = split(self.log.read(image.offsets if image else None), pk)[0]
        last = writes(events).where("not deleted").groupBy("log_partition", "field").agg(F.max("off").alias("last"))
        met = registry(events, pk).join(last, ["log_partition", "field"], "left").select("log_partition", "field", F.col("field_id").alias("rank"), F.coalesce("last", "first_offset").alias("last"))
        schema = "log_partition int, field string, field_id int"
        held = self.spark.createDataFrame([(p, n, k) for p, names in (image.fields if image else {}).items() for k, n in enumerate(names)], schema)
        top = held.groupBy("log_partition").agg((F.max("field_id") + 1).alias("top"))
        every = met.join(held, ["log_partition", "field"], "full").join(top, "log_partition", "left")
        place = F.row_number().over(Window.partitionBy("log_partition", F.col("field_id").isNull()).orderBy("rank")) - 1
        every = every.withColumn("field_id", F.coalesce("field_id", F.coalesce("top", F.lit(0)) + place)).withColumn("last", F.coalesce("last", F.lit(-1)))
        hit = (F.col("kind") == "name") & (F.col("field") == F.col("arg")) | (F.col("kind") == "prefix") & F.startswith("field", "arg") | (F.col("kind") == "all")
        d = drops(events).select(F.col("log_partition").alias("p"), "kind", "arg", F.col("off").alias("drop_off"))
        gone = every.join(d, (F.col("log_partition") == F.col("p")) & hit & (F.col("drop_off") > F.col("last")) & (F.col("field") != pk), "left_semi")
        return every.join(gone.select("log_partition", "field"), ["log_partition", "field"], "left_anti").select("log_partition", "field", F.col("field_id").cast("int"))

    def create_views(self, columns: Mapping[str, FieldType] | None = None, prefix: str = "") -> None:
        """Temporary views for SQL: <prefix>events, <prefix>state and, with columns, <prefix>wide."""
        self.log.read().createOrReplaceTempView(f"{prefix}events")
        self.state().createOrReplaceTempView(f"{prefix}state")
        if columns:
            self.wide(columns).createOrReplaceTempView(f"{prefix}wide")

    # ---- maintenance

    def compact(self, epoch: int | None = None) -> tuple[Image | None, dict]:
        """Publish an image of the present state; the image, and sizes before and after.

        Before is what lies in the store now: the cells of the last image and all that was written since, less what a drop
        of everything has cleared.
        """
        last = self.images.latest()
        image, shelf = self._base()
        commits = self.log.commits()
        through = int(commits[-1]) if commits else -1
        pk = self.config.primary_key
        good = split(self.log.read(image.offsets if image else None), pk)[0]
        deleted = horizons(good, shelf.deleted(image))
        live = fold(good, pk, shelf.cells(image), shelf.deleted(image)) if image else fold(good, pk)
        since = split(self.log.read(last.offsets if last else None), pk)[0]
        written = writes(since).where("not deleted").select("log_partition", "pk", "field", "value", "off").unionByName(self.images.cells(last).select("log_partition", "pk", "field", "value", "off"))
        cleared = drops(since).where("kind = 'all'").select("log_partition", F.col("off").alias("all_off"))
        written = written.join(cleared, "log_partition", "left").where("off > coalesce(all_off, -1)").drop("all_off")
        before = maintenance.sizes(written).first()
        fields: dict[int, list[str]] = {}
        for row in maintenance.renumbered(self.fields()).orderBy("log_partition", "field_id").collect():
            fields.setdefault(row["log_partition"], []).append(row["field"])
        published = self.images.publish(live, epoch if epoch is not None else int(time.time() * 1000), self.log.end_of(through), deleted=deleted, through=through, fields=fields)
        after = maintenance.sizes(self.images.cells(self.images.latest())).first()
        return published, {f"{n}_{when}": row[n] for when, row in (("before", before), ("after", after)) for n in ("cells", "documents", "bytes")}

    def maintainer(self, **options) -> Maintainer:
        return Maintainer(self.log, self.live, **options)

    def healthy(self) -> bool:
        return self.spark.sql("SELECT 1").first()[0] == 1
