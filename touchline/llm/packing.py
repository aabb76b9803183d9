"""Operator 5, packing: cutting-stock column generation over the length histogram.

1. One pass tokenises the texts and cuts each document into pieces of ``capacity`` ids and a
   remainder; pieces (no ids, no text) go to a checkpoint, numbered inside their task and length class.
2. The histogram over length classes (``GRID`` ids wide, so at most ``capacity / GRID`` rows,
   whatever the corpus size) is the only thing the driver sees. It solves the cutting-stock linear
   programme by column generation: the duals price a new pattern with a knapsack dynamic programme.
   Patterns are rounded down; what is left over is filled largest class first.
3. A piece's rank in its class (a running count over tasks plus its number in the task) picks a
   pattern, a copy of it and a slot by arithmetic; a window over each sequence gives the offset.

A class is as wide as its longest piece, so a sequence never overflows; the loss is under ``GRID``
ids a piece. Defined results: null text is the empty text (one id, the end id); repeated rows are
packed each on their own; an empty table gives no row; only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from touchline.llm.common import checkpointed, chunks, doc_rows, importable, table
from touchline.llm.wordcache import GENERATION, WordCache, cache

CAPACITY = 4096
GRID = 8
END_ID = 2
#: Words a worker remembers where packing has the executors to itself (about 200 bytes each, twice).
ALONE = 700_000
PIECES = ("doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, "
          "task int, class int, number bigint")


def cut_pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID, grid: int = GRID,
               generation: int = GENERATION) -> DataFrame:
    """Pieces of at most ``capacity`` ids, numbered per (task, length class)."""
    tail = np.array([end_id], "<u4").tobytes()
    names = [c.split()[0] for c in PIECES.split(", ")]

    def run(batches):
        words, seen, task = cache(path, "ids", generation), {}, TaskContext.get().partitionId()
        for b in batches:
            out = []
            for part in chunks(doc_rows([b])):
                split = [WordCache.words(t) for _, t in part]
                known = words.learn(split)
                for (doc_id, _), own in zip(part, split):
                    ids = b"".join(map(known.__getitem__, own)) + tail
                    total = len(ids) // 4
                    for at in range(0, total, capacity):
                        n = min(capacity, total - at)
                        k = -(-n // grid)
                        out.append((doc_id, at, n, zlib.crc32(ids[4 * at:4 * (at + n)]), total, task, k, seen.get(k, 0)))
                        seen[k] = seen.get(k, 0) + 1
            cols = list(zip(*out)) or [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if n in ("task", "class") else pa.int64())
                                              for n, c in zip(names, cols)], names=names)
        words.rest()

    return importable(docs).select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, PIECES)


def price(duals: np.ndarray, sizes: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """Most valuable pattern (count of each class) within ``room``: unbounded knapsack by dynamic programming.

    ``sizes`` ascends."""
    best, take = np.zeros(room + 1), np.full(room + 1, -1)
    upto = np.searchsorted(sizes, np.arange(room + 1), "right")
    for c in range(1, room + 1):
        k = upto[c]
        best[c], take[c] = best[c - 1], -1
        if k:
            v = duals[:k] + best[c - sizes[:k]]
            i = int(v.argmax())
            if v[i] > best[c] + 1e-12:
                best[c], take[c] = v[i], i
    pattern, c = np.zeros(len(sizes), np.int64), room
    while c > 0:
        if take[c] < 0:
            c -= 1
        else:
            pattern[take[c]] += 1
            c -= sizes[take[c]]
    return float(best[room]), pattern


def solve_patterns(sizes: np.ndarray, demand: np.ndarray, room: int, tolerance: float = 1e-4) -> list[tuple[np.ndarray, int]]:
    """(pattern, copies) that cover ``demand``: column generation, rounding, then largest-first filling.

    Stops when the bound that the best price gives shows the linear optimum within ``tolerance``."""
    m = len(sizes)
    if m == 0:
        return []
    fill = room // sizes
    inverse, columns = np.diag(1.0 / fill), [np.eye(m, dtype=np.int64)[i] * fill[i] for i in range(m)]
    cost, x = np.ones(m), demand / fill
    for _ in range(40 * m + 200):
        duals = cost @ inverse
        if duals.min() < -1e-9:
            i = int(duals.argmin())
            entering, c = -np.eye(m, dtype=np.int64)[i], 0.0
        else:
            value, entering = price(duals, sizes, room)
            c = 1.0
            if value <= 1 + tolerance:
                break
        w = inverse @ entering
        up = w > 1e-9
        ratio = np.full(m, np.inf)
        ratio[up] = x[up] / w[up]
        r = int(ratio.argmin())
        step = ratio[r]
        x = np.maximum(x - step * w, 0)
        x[r] = step
        row = inverse[r] / w[r]
        inverse -= np.outer(w, row)
        inverse[r] = row
        columns[r], cost[r] = entering, c
    left, out = demand.astype(np.int64).copy(), []
    for pattern, copies in sorted(zip(columns, x), key=lambda p: -p[1]):
        if pattern.min() < 0:
            continue
        k = int(copies + 1e-6)
        used = pattern > 0
        k = min(k, int((left[used] // pattern[used]).min()))
        if k > 0:
            out.append((pattern, k))
            left -= pattern * k
    while left.any():
        pattern, free = np.zeros(m, np.int64), room
        for i in range(m - 1, -1, -1):
            n = min(int(left[i]), free // int(sizes[i]))
            pattern[i], free = n, free - n * int(sizes[i])
        used = pattern > 0
        k = int((left[used] // pattern[used]).min())
        out.append((pattern, k))
        left -= pattern * k
    return out


def slot_table(classes: np.ndarray, patterns: list[tuple[np.ndarray, int]]) -> dict[str, np.ndarray]:
    """Per class and pattern: the first rank it serves, pieces a copy, its first sequence, its first slot."""
    rows, served, sequence = [], np.zeros(len(classes), np.int64), 0
    for pattern, copies in patterns:
        slot = 0
        for i in np.flatnonzero(pattern):
            rows.append((int(classes[i]), int(served[i]), int(pattern[i]), sequence, slot))
            served[i] += int(pattern[i]) * copies
            slot += int(pattern[i])
        sequence += copies
    rows.sort()
    cols = np.array(rows, np.int64).reshape(-1, 5).T
    return dict(zip(("class", "rank", "each", "sequence", "slot"), cols))


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID, grid: int = GRID,
         generation: int = GENERATION) -> DataFrame:
    """``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``, a row per piece."""
    spark = docs.sparkSession
    pieces = checkpointed(cut_pieces(docs, path, capacity, end_id, grid, generation))
    per_task = checkpointed(pieces.groupBy("task", "class").agg(F.count(F.lit(1)).alias("n")))
    histogram = per_task.groupBy("class").agg(F.sum("n").alias("n")).orderBy("class").collect()  # <= capacity / grid rows
    classes = np.array([r["class"] for r in histogram], np.int64)
    patterns = solve_patterns(classes, np.array([r["n"] for r in histogram], np.int64), capacity // grid)
    slots = spark.sparkContext.broadcast(slot_table(classes, patterns))  # a few rows per class at most
    before = Window.partitionBy("class").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_task.select("task", "class", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    ranked = pieces.join(offsets, ["task", "class"]).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "class", (F.col("before") + F.col("number")).alias("rank"))
    schema = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, slot bigint"

    def place(batches):
        t = slots.value
        for b in batches:
            k, rank = (b.column(b.schema.get_field_index(c)).to_numpy().astype(np.int64) for c in ("class", "rank"))
            # the table row of the class with the largest first rank that is not above the piece's
            at = np.searchsorted(t["class"] * (1 << 45) + t["rank"], k * (1 << 45) + rank, "right") - 1
            copy, inside = np.divmod(rank - t["rank"][at], t["each"][at])
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(t["sequence"][at] + copy), pa.array(t["slot"][at] + inside)],
                                             names=[*b.schema.names[:5], "sequence_id", "slot"])

    earlier = Window.partitionBy("sequence_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    return ranked.mapInArrow(place, schema).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id",
        F.coalesce(F.sum("length").over(earlier), F.lit(0)).alias("offset"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), generation=ALONE)
