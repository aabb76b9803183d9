"""Helpers the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import os

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.session import ensure_checkpoint_dir

#: Bytes of text handled at once inside a task (bounds the arrays made from them).
CHUNK_BYTES = 3 << 20
BATCH_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def importable(df: DataFrame) -> DataFrame:
    """``df``, once Python workers look for this package where the driver found it, in Arrow batches of
    ``BATCH_ROWS`` rows (unless the session asks for another number): texts are long, and a batch is
    held by the JVM and copied by the worker.

    Enough wherever executors see the driver's installation (one machine, a shared or equal path). On
    other clusters the package is installed on the nodes or sent with ``addPyFile``."""
    env = df.sparkSession.sparkContext.environment
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, env.get("PYTHONPATH", "")) if x)
    conf = df.sparkSession.conf
    if conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":  # Spark's default
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return df


_HELD: dict = {}


def held(key, make):
    """One object that a Python worker keeps over the tasks it runs; asking for another key lets it go."""
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = make()
    return _HELD[key]


def release(kept: bool = True) -> None:
    """Let go what the worker keeps and give freed memory back to the system: workers live on between tasks
    and are used again by operators that need the memory themselves. ``kept=False``: only give back."""
    if kept:
        _HELD.clear()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not every C library has it
        pass


def crc_mod(doc_id: Column | str, mod: int) -> Column:
    """crc32 of the id written as text, modulo ``mod``; a null id counts as empty text."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % mod


def home_of(homes: int) -> Column:
    """Home group of a row by id and text: rows with a null or a repeated id spread too, only equal rows meet."""
    return F.pmod(F.xxhash64("doc_id", "text"), F.lit(homes)).cast("int")


def checkpointed(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder and go on from there."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def text_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of an Arrow string column; null gives empty bytes."""
    return [t if t is not None else b"" for t in column.cast(pa.large_binary()).to_pylist()]


def chunks(rows, limit: int = CHUNK_BYTES):
    """Group (key, bytes) rows into lists of about ``limit`` bytes; one long text may exceed it."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[1])
        if size >= limit:
            yield held
            held, size = [], 0
    if held:
        yield held


def doc_rows(batches, key: str = "doc_id", text: str = "text"):
    """(key, text bytes) of every row of Arrow batches, in order."""
    for b in batches:
        yield from zip(b.column(b.schema.get_field_index(key)).to_pylist(),
                       text_bytes(b.column(b.schema.get_field_index(text))))
