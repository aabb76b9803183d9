"""Running totals within a key, without a task per key."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from touchline.llm.common import checkpointed, importable

_PART = "_tl_part"
_SPAN = np.int64(1) << np.int64(40)


def _one(op: str, values: np.ndarray, starts: np.ndarray, carry: int, open_rows: int) -> np.ndarray:
    """Inclusive running value of each stretch (``starts``: the place where a row's stretch begins in this
    batch); the first ``open_rows`` rows go on from ``carry``."""
    if op == "max":
        stretch = np.cumsum(starts == np.arange(len(starts)))
        out = np.maximum.accumulate(values + stretch * _SPAN) - stretch * _SPAN
        out[:open_rows] = np.maximum(out[:open_rows], carry)
        return out
    add = np.bitwise_xor if op == "xor" else np.add
    total = add.accumulate(values)
    before = np.where(starts > 0, total[starts - 1], 0)
    out = total ^ before if op == "xor" else total - before
    out[:open_rows] = add(out[:open_rows], np.int64(carry))
    return out


def _walk(batches, key: str, values: dict, state):
    """(batch, running values) in order. ``state``: (key, values) that the first rows go on from, or None."""
    for b in batches:
        if not b.num_rows:
            continue
        k = b.column(b.schema.get_field_index(key)).to_numpy()
        new = np.concatenate([[state is None or state[0] != k[0]], k[1:] != k[:-1]])
        starts = np.maximum.accumulate(np.where(new, np.arange(len(k)), 0))
        open_rows = 0 if new[0] else (int(np.argmax(new)) if new.any() else len(k))
        out = {}
        for name, (op, column) in values.items():
            v = b.column(b.schema.get_field_index(column)).to_numpy().astype(np.int64)
            out[name] = _one(op, v, starts, state[1][name] if open_rows else 0, open_rows)
        state = (int(k[-1]), {name: int(v[-1]) for name, v in out.items()})
        yield b, out, state


def running(df: DataFrame, key: str, order: list, values: dict, keep: list[str]) -> DataFrame:
    """``keep`` columns of ``df`` and running values over the rows of each ``key`` in ``order``.

    ``values``: name -> (``sum``, ``xor`` or ``max``, column); bigint columns without nulls (``max``: from 0 to
    2^40), as is ``key``. Rows are range-partitioned by key *and* order, so a key with many rows
    spreads over partitions; the last running value of each partition (one row a partition) is handed on.
    The sorted rows are checkpointed; rows equal in key and order stand in no certain order."""
    columns = list(dict.fromkeys([*keep, key, *(c for _, c in values.values())]))
    rows = importable(df).repartitionByRange(key, *order).sortWithinPartitions(key, *order)
    rows = checkpointed(rows.select(*columns).withColumn(_PART, F.spark_partition_id()))
    names = list(values)

    def ends(batches):
        first = last = part = None
        for b, _, state in _walk(batches, key, values, None):
            if first is None:
                first, part = b.column(b.schema.get_field_index(key))[0].as_py(), b.column(b.schema.get_field_index(_PART))[0].as_py()
            last = state
        if last is not None:
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "first": pa.array([first], pa.int64()), "last": pa.array([last[0]], pa.int64()),
                                              "values": pa.array([[last[1][n] for n in names]], pa.list_(pa.int64()))})

    carry, state = {}, None
    op = {"sum": lambda a, b: a + b, "xor": lambda a, b: a ^ b, "max": max}
    for r in sorted(rows.mapInArrow(ends, "part int, first bigint, last bigint, values array<bigint>").collect()):  # a row a partition
        carry[r.part] = state if state is not None and state[0] == r.first else None
        mine = dict(zip(names, r["values"]))
        if carry[r.part] is not None and r.first == r.last:
            mine = {n: op[values[n][0]](state[1][n], mine[n]) for n in names}
        state = (r.last, mine)

    def run(batches):
        def started():
            it = iter(batches)
            for b in it:
                if b.num_rows:
                    part = b.column(b.schema.get_field_index(_PART))[0].as_py()
                    yield from _walk(_chain(b, it), key, values, carry[part])
        for b, out, _ in started():
            cols = [b.column(b.schema.get_field_index(c)) for c in keep] + [pa.array(out[n], pa.int64()) for n in names]
            yield pa.RecordBatch.from_arrays(cols, names=[*keep, *names])

    schema = T.StructType([*(rows.schema[c] for c in keep), *(T.StructField(n, T.LongType()) for n in names)])
    return rows.mapInArrow(run, schema)


def _chain(first, rest):
    yield first
    yield from rest
