"""Small files and folders on the cluster's file system, through Hadoop's client on the driver."""

from __future__ import annotations

import time
import uuid

from pyspark.sql import SparkSession


def _open(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def read_text(spark: SparkSession, path: str) -> str | None:
    """The text of a small file; None if there is none."""
    fs, p = _open(spark, path)
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def replace_text(spark: SparkSession, path: str, text: str) -> None:
    """Replace a small file as a whole: written beside it, then renamed over it."""
    fs, p = _open(spark, f"{path}.{uuid.uuid4().hex}")
    out = fs.create(p, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    jvm, gateway = spark._jvm, spark.sparkContext._gateway
    over = gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    over[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration())
    context.rename(p, fs.makeQualified(jvm.org.apache.hadoop.fs.Path(path)), over)


def folders(spark: SparkSession, path: str, older_than: float = 0) -> list[str]:
    """Names of the folders in ``path`` that changed at least ``older_than`` seconds ago."""
    fs, p = _open(spark, path)
    if not fs.exists(p):
        return []
    until = (time.time() - older_than) * 1000
    return sorted(s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory() and (not older_than or s.getModificationTime() <= until))


def remove(spark: SparkSession, path: str) -> None:
    fs, p = _open(spark, path)
    fs.delete(p, True)
