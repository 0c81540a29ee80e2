"""What the operators share: where their working tables lie, and how lineage is cut.

Working tables go to the folder that the cluster names in ``spark.checkpoint.dir``, which the driver
and all executors see; a lost executor costs the tasks it held, not the tables it wrote.
"""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The shared folder; only a local session may go without one, and has its temporary folder."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local":
        return f"file://{tempfile.gettempdir()}/foldstore-scratch"
    raise ValueError("the cluster names no shared folder in spark.checkpoint.dir")


def scratch(spark: SparkSession, what: str) -> str:
    """A fresh path for a working table."""
    return f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{what}-{uuid.uuid4().hex[:12]}"


def hadoop_path(spark: SparkSession, path: str):
    """(file system, path) of Hadoop, so that any store that Spark writes can be listed, renamed and cleared."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = hadoop_path(spark, path)
    return fs.exists(p)


def remove(spark: SparkSession, *paths: str) -> None:
    """Clear working tables that nothing reads any more."""
    for path in paths:
        fs, p = hadoop_path(spark, path)
        fs.delete(p, True)


#: Working tables of the operators that are running, innermost last.
_made: list[str] = []


def clearing(operator):
    """An operator whose working tables go when it returns, but for those that its result still reads."""

    @wraps(operator)
    def run(*args, **kw):
        first = len(_made)
        out = operator(*args, **kw)
        read = {part for f in (out.inputFiles() if isinstance(out, DataFrame) else ()) for part in f.split("/")[-2:-1]}
        made, _made[first:] = _made[first:], []
        spark = SparkSession.getActiveSession()
        remove(spark, *(path for path in made if path.rpartition("/")[2] not in read))
        give_back()
        return out

    return run


def cut(df: DataFrame, what: str, path: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: one computation, no lineage behind it."""
    spark = df.sparkSession
    path = path or scratch(spark, what)
    _made.append(path)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_mod(col: Column | str, n: int) -> Column:
    """crc32 of a column as text, modulo n; null ids count as the empty text."""
    c = F.col(col) if isinstance(col, str) else col
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % n


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Bound what a Python worker holds at once: Arrow batches of at most so many rows and 32 MB."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(32 << 20))


def give_back() -> None:
    """Hand memory that a Python worker has freed back to the system; workers live on between tasks."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library
        ctypes.CDLL(None).malloc_trim(0)


def tidy(run):
    """A function over the batches of a partition that gives its memory back at the end."""

    @wraps(run)
    def tidied(batches):
        yield from run(batches)
        give_back()

    return tidied


def passing(rows: DataFrame, column: str, ids: DataFrame) -> DataFrame:
    """The rows whose ``column`` is among ``ids`` (one column), and a few others: for joins that would else move all rows.

    A bit set of at most 2^24 bits, tested where the rows lie, tells them; it is 8 bits an id as long as that fits.
    """
    of = lambda c: F.pmod(F.xxhash64(F.col(c).cast("long")), F.lit(bits))
    bits = 1 << min(24, max(16, (8 * ids.count()).bit_length()))
    words = ids.select(of(ids.columns[0]).alias("bit")).groupBy(F.shiftright("bit", 6).alias("bit_word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("bit_set"))
    marked = rows.select(F.struct(*rows.columns).alias("row"), of(column).alias("bit"))
    return marked.join(F.broadcast(words), F.shiftright("bit", 6) == F.col("bit_word")).where(F.expr("getbit(bit_set, cast(bit & 63 as int)) = 1")).select("row.*")
