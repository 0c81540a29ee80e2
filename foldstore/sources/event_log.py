"""The mutation log: an append-only table of Parquet commits.

A commit is a folder that appears by one rename, named by its number. Offsets order the events of a log partition: the
commit's number, then the task and row within it. They are made where the rows lie, without a shuffle, and increase
but aren't dense. Appending is for one writer at a time; a rival's commit of the same number makes the later one take
the next number.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foldstore.config import StoreConfig
from foldstore.document import Document
from foldstore.functions.codec import require_name
from foldstore.functions.fields import CELL, FieldType, cell
from foldstore.plans.fold import EVENT
from foldstore.sources import files

ROW_BITS, TASK_BITS = 24, 16
RAW = EVENT.replace("pk binary, ", "")


def offset_of(commit: int) -> Column:
    row = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    task = F.spark_partition_id().cast("bigint")
    fits = (row < (1 << ROW_BITS)) & (task < (1 << TASK_BITS))
    return F.when(fits, F.lit(commit << (ROW_BITS + TASK_BITS)) + task * (1 << ROW_BITS) + row).otherwise(F.raise_error(F.lit("a commit has too many tasks or rows in a task")).cast("bigint"))


class EventLog:
    def __init__(self, spark: SparkSession, path: str, config: StoreConfig):
        self.spark, self.path, self.config = spark, path.rstrip("/"), config

    # ---- writing

    def _partition_of(self, doc: str) -> Column:
        c = F.try_element_at(F.col(doc), F.lit(self.config.partitioning_key))
        return F.pmod(F.xxhash64(c["type"], c["value"]), F.lit(self.config.partitions)).cast("int")

    def _append(self, events: DataFrame) -> int:
        while True:
            commits = self.commits()
            number = int(commits[-1]) + 1 if commits else 0
            staged = f"{self.path}/_staging-{uuid.uuid4().hex}"
            numbered = events.withColumn("log_offset", offset_of(number))
            schema = [x.split()[0] for x in RAW.split(", ")]
            numbered.select(*schema).write.parquet(staged)
            # Spark writes a file for the first task even if it has no rows; a commit holds files with events only.
            for name in [n for n in files.names(self.spark, staged) if n.startswith("part-00000")]:
                if self.spark.read.schema(RAW).parquet(f"{staged}/{name}").isEmpty():
                    files.delete(self.spark, f"{staged}/{name}")
            if files.publish(self.spark, staged, f"{self.path}/commits/{number:012d}"):
                return number

    def _documents(self, rows: DataFrame, fields: Mapping[str, FieldType]) -> DataFrame:
        """A map of cells of the given columns; null columns are left out."""
        cells = F.create_map(*[x for n, k in fields.items() for x in (F.lit(require_name(n, "field")), cell(F.col(f"`{n}`"), k))])
        return rows.select(F.map_filter(cells, lambda _, c: c.isNotNull()).cast(f"map<string,{CELL}>").alias("doc"))

    def _need_keys(self, docs: DataFrame) -> DataFrame:
        there = lambda n: F.try_element_at(F.col("doc"), F.lit(n)).isNotNull()
        ok = there(self.config.primary_key) & there(self.config.partitioning_key)
        return docs.withColumn("doc", F.when(ok, F.col("doc")).otherwise(F.raise_error(F.lit("a document lacks its primary or partitioning key")).cast(f"map<string,{CELL}>")))

    def _events(self, docs: DataFrame, op: str, names: Iterable[str] = ()) -> DataFrame:
        listed = F.array(*[F.lit(n) for n in names]).cast("array<string>")
        return self._need_keys(docs).select(self._partition_of("doc").alias("log_partition"), F.lit(op).alias("op"), "doc", listed.alias("fields"), F.array().cast("array<string>").alias("prefixes"), F.lit(False).alias("drop_all"))

    def upsert(self, rows: DataFrame, fields: Mapping[str, FieldType]) -> int:
        """One upsert for each row, in their order; the number of the commit."""
        return self._append(self._events(self._documents(rows, fields), "upsert"))

    def upsert_documents(self, documents: Iterable[Document]) -> int:
        """One upsert for each document, in their order."""
        rows = [({n: (k, bytearray(v)) for n, (k, v) in d.cells.items()},) for d in documents]
        docs = self.spark.createDataFrame(rows, f"doc map<string,{CELL}>").coalesce(1)
        return self._append(self._events(docs, "upsert"))

    def _keys(self, rows: DataFrame, fields: Mapping[str, FieldType]) -> DataFrame:
        """Only the key fields go on with a delete."""
        mine = {n: k for n, k in fields.items() if n in (self.config.primary_key, self.config.partitioning_key)}
        return self._documents(rows, mine)

    def delete_fields(self, rows: DataFrame, fields: Mapping[str, FieldType], names: Iterable[str]) -> int | None:
        names = [require_name(n, "field") for n in names]
        if not names:
            return None
        return self._append(self._events(self._keys(rows, fields), "delete_fields", names))

    def delete_documents(self, rows: DataFrame, fields: Mapping[str, FieldType]) -> int:
        return self._append(self._events(self._keys(rows, fields), "delete_doc"))

    def drop_fields(self, names: Iterable[str] = (), prefixes: Iterable[str] = (), *, everything: bool = False) -> int | None:
        """One drop event for each log partition, all in one commit; nothing if nothing is asked for."""
        names, prefixes = list(names), list(prefixes)
        if not (names or prefixes or everything):
            return None
        words = lambda x: F.array(*map(F.lit, x)).cast("array<string>")
        return self._append(
            self.spark.range(self.config.partitions).select(
                F.col("id").cast("int").alias("log_partition"), F.lit("drop").alias("op"), F.lit(None).cast(f"map<string,{CELL}>").alias("doc"), words(names).alias("fields"), words(prefixes).alias("prefixes"), F.lit(everything).alias("drop_all")
            )
        )

    def append_raw(self, events: DataFrame) -> int:
        """Events as they are: log_partition, op, doc, fields, prefixes, drop_all."""
        return self._append(events)

    # ---- reading

    def commits(self) -> list[str]:
        return files.names(self.spark, f"{self.path}/commits")

    def read(self, after: Mapping[int, int] | int | None = None) -> DataFrame:
        """All events, or those above an offset (one for all log partitions or one for each, none for those left out).

        Commits below the least offset aren't opened, and the least offset itself goes down to the scan.
        """
        least = after if isinstance(after, int) else min((after or {}).get(p, -1) for p in range(self.config.partitions))
        least = -1 if least is None else least
        commits = [c for c in self.commits() if (int(c) + 1) << (ROW_BITS + TASK_BITS) > least + 1]
        if not commits:
            return self.spark.createDataFrame([], RAW)
        found = self.spark.read.schema(RAW).parquet(*[f"{self.path}/commits/{c}" for c in commits])
        if least >= 0:
            found = found.where(F.col("log_offset") > least)
        if isinstance(after, Mapping) and any(o > least for o in after.values()):
            known = F.create_map(*[F.lit(x) for p, o in after.items() for x in (int(p), int(o))])
            found = found.where(F.col("log_offset") > F.coalesce(known[F.col("log_partition")], F.lit(-1)))
        return found

    def files_of(self, commit: int) -> list[str]:
        """Names of the data files of a commit."""
        return [n for n in files.names(self.spark, f"{self.path}/commits/{commit:012d}") if n.endswith(".parquet")]

    def end_of(self, commit: int) -> dict[int, int]:
        """The last offset that a commit can have, for each log partition."""
        return {p: ((commit + 1) << (ROW_BITS + TASK_BITS)) - 1 for p in range(self.config.partitions)}

    def stream(self, max_files: int | None = None) -> DataFrame:
        """The log as a stream, with the file of each event; a commit appears whole, and its files in any order."""
        reader = self.spark.readStream.schema(RAW).option("recursiveFileLookup", "true")
        if max_files:
            reader = reader.option("maxFilesPerTrigger", max_files)
        return reader.parquet(f"{self.path}/commits").withColumn("log_file", F.col("_metadata.file_path"))

