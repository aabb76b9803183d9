"""Whole documents packed into shards: rows of a few MB that later steps go back to.

A shard holds the rows of one task in input order, about ``SHARD_BYTES`` of text (one longer text is a
shard of its own), as a compressed Arrow table. Rows are not dealt by any key, so no id, text or source
can fill a shard; packed shards are checkpointed, so their numbers stay the same if an executor is lost.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame

from touchline.llm.common import checkpointed, importable

SHARD_BYTES = 6 << 20
#: Text bytes split into words at once.
PIECE = 1 << 20
_SPACE = b" \t\n\r\x0b\x0c"


def packed(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as w:
        w.write_table(table)
    return zstandard.compress(sink.getvalue(), 3)


def unpacked(payload: bytes) -> pa.Table:
    return pa.ipc.open_stream(zstandard.decompress(payload)).read_all()


def pack_numbers(*columns) -> bytes:
    """Number arrays, compressed; ascending or small numbers take few bytes (differences, byte planes)."""
    out = [len(columns).to_bytes(1, "little")]
    for c in columns:
        c = np.asarray(c, np.int64)
        step = np.diff(c, prepend=0)
        planes = np.ascontiguousarray(step.view(np.uint8).reshape(-1, 8).T)
        out += [len(c).to_bytes(8, "little"), planes.tobytes()]
    return zstandard.compress(b"".join(out), 1)


def unpack_numbers(payload: bytes) -> list[np.ndarray]:
    raw, at, out = zstandard.decompress(payload), 1, []
    for _ in range(raw[0]):
        n = int.from_bytes(raw[at:at + 8], "little")
        planes = np.frombuffer(raw, np.uint8, 8 * n, at + 8).reshape(8, n)
        out.append(np.cumsum(np.ascontiguousarray(planes.T).view(np.int64).ravel()))
        at += 8 + 8 * n
    return out


def words(text: bytes):
    """Words of a text, lists of them: pieces end between words, so a long text is not split at once."""
    at = 0
    while len(text) - at > PIECE:
        end = at + PIECE
        while end < len(text) and text[end] not in _SPACE:
            end += 1
        yield text[at:end].split()
        at = end
    yield text[at:].split() if at else text.split()


def shard_numbers():
    """Numbers for the shards that one task makes."""
    first = TaskContext.get().partitionId() << 32
    while True:
        yield first
        first += 1


def shards(batches, limit: int, text: str = "text"):
    """(number, table) of the rows of a task, about ``limit`` bytes of text each."""
    held, size = [], 0
    number = shard_numbers()
    for b in batches:
        at = b.schema.get_field_index(text)
        ends = np.cumsum(pc.fill_null(pc.binary_length(b.column(at)), 0).to_numpy(zero_copy_only=False))
        first = 0
        while first < b.num_rows:
            base = ends[first - 1] if first else 0
            to = min(b.num_rows, int(np.searchsorted(ends, base + limit - size, "left")) + 1)
            held.append(b.slice(first, to - first))
            size += int(ends[to - 1] - base)
            first = to
            if size >= limit:
                yield next(number), pa.Table.from_batches(held)
                held, size = [], 0
    if held:
        yield next(number), pa.Table.from_batches(held)


def shard_docs(docs: DataFrame, text: str = "text") -> DataFrame:
    """``shard, rows``: all columns of ``docs``, packed and checkpointed."""
    limit = SHARD_BYTES

    def run(batches):
        for number, table in shards(batches, limit, text):
            yield pa.RecordBatch.from_pydict({"shard": pa.array([number], pa.int64()), "rows": pa.array([packed(table)], pa.binary())})

    return checkpointed(importable(docs).mapInArrow(run, "shard bigint, rows binary"))
