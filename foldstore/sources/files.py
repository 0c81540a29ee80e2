"""Small files and atomic renames through Hadoop's file systems, so that any store Spark writes will do."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def resolve(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def scratch(spark: SparkSession, what: str) -> str:
    """A fresh path in the shared folder that the cluster names; a local session without one has its temporary folder."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("the cluster names no shared folder in spark.checkpoint.dir")
        found = f"file://{tempfile.gettempdir()}/foldstore-scratch"
    return f"{found.rstrip('/')}/{spark.sparkContext.applicationId}/{what}-{uuid.uuid4().hex[:12]}"


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = resolve(spark, path)
    return fs.exists(p)


def names(spark: SparkSession, path: str) -> list[str]:
    fs, p = resolve(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def delete(spark: SparkSession, path: str) -> None:
    fs, p = resolve(spark, path)
    fs.delete(p, True)


def publish(spark: SparkSession, staged: str, to: str) -> bool:
    """Rename that never replaces; False, and the staged files go, if the target is there."""
    fs, src = resolve(spark, staged)
    _, dst = resolve(spark, to)
    fs.mkdirs(dst.getParent())
    jvm = spark._jvm
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration())
    try:
        context.rename(fs.makeQualified(src), fs.makeQualified(dst), spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0))
        return True
    except Exception:
        if not fs.exists(dst):
            raise
        fs.delete(src, True)
        return False


def write_text(spark: SparkSession, path: str, text: str) -> bool:
    """A small file, written aside and renamed; False if it is there already."""
    staged = f"{path}.{uuid.uuid4().hex}"
    fs, p = resolve(spark, staged)
    out = fs.create(p, True)
    out.write(bytearray(text.encode()))
    out.close()
    return publish(spark, staged, path)


def read_text(spark: SparkSession, path: str) -> str:
    fs, p = resolve(spark, path)
    stream = fs.open(p)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()
