"""Published images of live cells: Parquet by epoch, each with a manifest that is written last.

An image without a manifest doesn't exist for readers, so that a publishing job may be lost at any time. The manifest
names the offset of each log partition up to which the image has every event, and the files of the log above that it
has too. An image that events may be delivered to again also holds the horizons of what was deleted.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldstore.operators.maintenance import STALE_AFTER_MS, compacted
from foldstore.plans.fold import HORIZON, STATE
from foldstore.sources import files


@dataclass(frozen=True)
class Image:
    path: str
    epoch: int
    offsets: dict[int, int]
    cells: int
    through: int = -1  # commits up to this one are in the image
    files: dict[int, list[str]] = field(default_factory=dict)  # of later commits these files are
    fields: dict[int, list[str]] = field(default_factory=dict)  # fields of each log partition in the order of their ids


class Snapshots:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _manifest(self, epoch: int) -> str:
        return f"{self.path}/epoch={epoch:020d}/manifest.json"

    def publish(self, live: DataFrame, epoch: int, offsets: dict[int, int], buckets: int | None = None, *, deleted: DataFrame | None = None, through: int = -1, files_above: dict[int, list[str]] | None = None, fields: dict[int, list[str]] | None = None) -> Image | None:
        """Write an image; None if that epoch is published already. Leftovers of a lost attempt are replaced."""
        if files.exists(self.spark, self._manifest(epoch)):
            return None
        # Each attempt writes to folders of its own, so that rivals for an epoch never mix their files; the manifest names them.
        path, attempt = f"{self.path}/epoch={epoch:020d}", uuid.uuid4().hex
        compacted(live, buckets).write.partitionBy("log_partition").parquet(f"{path}/cells-{attempt}")
        if deleted is not None:
            deleted.write.partitionBy("log_partition").parquet(f"{path}/horizons-{attempt}")
        n = self.spark.read.schema(STATE).parquet(f"{path}/cells-{attempt}").count()
        manifest = {"epoch": epoch, "offsets": {str(k): v for k, v in offsets.items()}, "cells": n, "attempt": attempt, "horizons": deleted is not None, "through": through, "files": files_above or {}, "fields": fields or {}}
        if files.write_text(self.spark, self._manifest(epoch), json.dumps(manifest)):
            return self.open(epoch)
        for kind in ("cells", "horizons"):
            files.delete(self.spark, f"{path}/{kind}-{attempt}")
        return None

    def epochs(self) -> list[int]:
        """Published epochs, oldest first."""
        found = [int(n.partition("=")[2]) for n in files.names(self.spark, self.path) if n.startswith("epoch=")]
        return sorted(e for e in found if files.exists(self.spark, self._manifest(e)))

    def _read(self, epoch: int) -> dict:
        return json.loads(files.read_text(self.spark, self._manifest(epoch)))

    def open(self, epoch: int) -> Image:
        m = self._read(epoch)
        return Image(f"{self.path}/epoch={epoch:020d}", m["epoch"], {int(k): v for k, v in m["offsets"].items()}, m["cells"], m["through"], {int(k): v for k, v in m["files"].items()}, {int(k): v for k, v in m["fields"].items()})

    def latest(self) -> Image | None:
        epochs = self.epochs()
        return self.open(epochs[-1]) if epochs else None

    def _table(self, image: Image | None, kind: str, schema: str) -> DataFrame:
        names = [x.split()[0] for x in schema.split(", ")]
        m = self._read(image.epoch) if image else {}
        if not image or (kind == "horizons" and not m["horizons"]):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{image.path}/{kind}-{m['attempt']}").select(*names)

    def cells(self, image: Image | None) -> DataFrame:
        return self._table(image, "cells", STATE)

    def deleted(self, image: Image | None) -> DataFrame:
        """The horizons that an image keeps."""
        return self._table(image, "horizons", HORIZON)

    def needs_refresh(self, local_epoch: int | None, now_ms: int) -> bool:
        """Is the local image missing, or old while a fresh one is published?"""
        if not local_epoch:
            return True
        newest = self.latest()
        return newest is not None and now_ms - local_epoch >= STALE_AFTER_MS and now_ms - newest.epoch < STALE_AFTER_MS

    def retire(self, keep: int = 2) -> list[int]:
        """Delete all but the newest images."""
        old = self.epochs()[:-keep] if keep else self.epochs()
        for e in old:
            files.delete(self.spark, self._manifest(e))
            files.delete(self.spark, f"{self.path}/epoch={e:020d}")
        return old


def last_offsets(events: DataFrame) -> dict[int, int]:
    """Last offset of each log partition; a row for each of the store's few log partitions."""
    return {r[0]: r[1] for r in events.groupBy("log_partition").agg(F.max("log_offset")).collect()}
