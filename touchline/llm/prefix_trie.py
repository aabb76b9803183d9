"""Operator 13, conversation prefix trie with a splitter skeleton.

A node is a distinct sequence of the first ``d`` turns of some conversation. Its key is 128 bits: the
exclusive or of a hash of each turn (place, role, text), so a running total gives the keys of all prefixes.

1. Turns are numbered and keyed by running totals over range partitions (``scans``): a conversation that
   holds a third of all turns spreads over partitions. From here on rows hold hashes, not texts.
2. Nodes are an aggregate by key. Nodes below each other with the same members form a *segment*; only the
   top of a segment enters a conversation's path, so a path is as long as its member set changes.
3. Splitters from a bounded sample deal the conversations, sorted by path and id, to shards. The trie of
   the splitters' paths (the skeleton) is broadcast: at most ``MOST_SPLITTERS * MOST_DEPTH`` nodes. Any
   node whose members may lie in several shards is on it.
4. A shard streams over its sorted conversations with a stack and finishes all other nodes. For skeleton
   nodes it gives what their finished children add up to, and the ids that end there, packed.
5. These parts are reduced by node and added up along the skeleton; segments give their nodes' rows back.

Copies of one conversation are only sorted next to each other; the splitters hold ids too, so a large group
of copies spreads over shards. The ids that end at one node are hashed in order by one task as the
result asks, from packed blocks, never held together.

Defined results: null role or text is empty; rows with a null ``conv_id`` belong to no conversation; turns
are in order of turn (null first), role, text, and repeated rows are turns of their own; an empty table
gives no row, not even a root; extra columns are not read.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.llm.common import checkpointed, importable, table
from touchline.llm.scans import running
from touchline.llm.shards import pack_numbers, unpack_numbers

#: Conversations of a shard as planned, splitters at most, steps of a splitter's path at most, samples a splitter.
SHARD_ROWS, MOST_SPLITTERS, MOST_DEPTH, SAMPLES = 2000, 1024, 64, 16
#: Ids of one packed block of a skeleton node's ends.
BLOCK_IDS = 1 << 16
_EMPTY = hashlib.sha256().hexdigest()
_FIRST_ID = -(1 << 63)


def _l(c):
    return c.cast("bigint")


def number_turns(conversations: DataFrame) -> DataFrame:
    """``conv_id, pos, t1, t2, chars``: a conversation's turns from 1, hashed, with their code points."""
    c = conversations.where("conv_id is not null").select(
        _l(F.col("conv_id")).alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    c = c.withColumns({"t1": F.xxhash64(F.lit(1), "role", "text"), "t2": F.xxhash64(F.lit(2), "role", "text"),
                       "chars": _l(F.length("text")), "one": F.lit(1).cast("bigint")})
    return running(c, "conv_id", [F.col("turn").asc_nulls_first(), "role", "text"], {"pos": ("sum", "one")}, ["conv_id", "t1", "t2", "chars"])


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``conv_id, depth, t1, t2, chars`` of the rebuilt conversations, and ``conv_id, n_turns`` of all of them.

    The first ``h = crc32(conv_id) % 6`` turns come from conversation ``conv_id - conv_id % 100``."""
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % 6
    base = F.col("conv_id") - F.col("conv_id") % 100
    convs = checkpointed(turns.groupBy("conv_id").agg(F.max("pos").alias("n"))).withColumns({"h": h, "base": base})
    bases = convs.where("conv_id = base").select("base", F.least("n", F.lit(5)).cast("bigint").alias("n_base"))
    heads = turns.where((F.col("conv_id") == base) & (F.col("pos") <= 5)).select(F.col("conv_id").alias("base"), "pos", "t1", "t2", "chars")
    head = convs.join(heads, "base").where("pos <= h").select("conv_id", F.col("pos").alias("depth"), "t1", "t2", "chars")
    k = F.least("h", F.coalesce("n_base", F.lit(0)))
    own = turns.withColumns({"h": h, "base": base}).where("pos > h").join(bases, "base", "left").select(
        "conv_id", (k + F.col("pos") - F.col("h")).alias("depth"), "t1", "t2", "chars")
    n_turns = convs.join(bases, "base", "left").select("conv_id", (k + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("n_turns"))
    return head.unionByName(own), n_turns


def keyed(turns: DataFrame) -> DataFrame:
    """``conv_id, depth, chars, k1, k2, p1, p2, upto``: each turn's node, its parent's, and the code points so far."""
    rows = turns.withColumns({f"x{i}": F.xxhash64(F.lit(i), "depth", "t1", "t2") for i in (1, 2)})
    rows = running(rows, "conv_id", ["depth"], {"k1": ("xor", "x1"), "k2": ("xor", "x2"), "upto": ("sum", "chars")},
                   ["conv_id", "depth", "chars", "x1", "x2"])
    return rows.withColumns({"p1": F.col("k1").bitwiseXOR(F.col("x1")), "p2": F.col("k2").bitwiseXOR(F.col("x2"))}).drop("x1", "x2")


def node_table(rows: DataFrame, n_convs: int, first: int) -> DataFrame:
    """``k1, k2, lo, depth, n, chars, upto, parent, top``: every node but the root; ``lo``: smallest member."""
    nodes = checkpointed(rows.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("lo"), *(
        F.min(c).alias(c) for c in ("depth", "chars", "upto", "p1", "p2"))))
    up = nodes.select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("lo").alias("parent"), F.col("n").alias("above"))
    deep = nodes.where("depth > 1").join(up, ["p1", "p2"], "left")
    high = nodes.where("depth = 1").withColumns({"parent": F.lit(first).cast("bigint"), "above": F.lit(n_convs).cast("bigint")})
    every = deep.unionByName(high)
    return checkpointed(every.withColumn("top", (F.col("depth") == 1) | (F.col("n") < F.col("above"))).drop("above", "p1", "p2"))


def member_paths(rows: DataFrame, nodes: DataFrame, n_turns: DataFrame) -> DataFrame:
    """``conv_id, n_turns, chars, path, steps`` of every conversation; ``path``: smallest members of its segments
    from the root down (they tell siblings apart), ``steps``: (depth, members, code points above) of each."""
    tops = nodes.where("top").select("k1", "k2", "lo", "n")
    steps = rows.join(tops, ["k1", "k2"]).select("conv_id", F.struct("depth", "lo", "n", (F.col("upto") - F.col("chars")).alias("above")).alias("step"))
    paths = steps.groupBy("conv_id").agg(F.sort_array(F.collect_list("step")).alias("s"))
    total = rows.groupBy("conv_id").agg(F.max("upto").alias("chars"))
    return checkpointed(n_turns.join(total, "conv_id", "left").join(paths, "conv_id", "left").select(
        "conv_id", "n_turns", F.coalesce("chars", F.lit(0)).cast("bigint").alias("chars"),
        F.coalesce(F.col("s.lo"), F.array().cast("array<bigint>")).alias("path"),
        F.coalesce(F.transform("s", lambda x: F.array(x["depth"], x["n"], x["above"])), F.array().cast("array<array<bigint>>")).alias("steps")))


def choose_splitters(members: DataFrame, n_convs: int) -> list[tuple]:
    """Sorted (path, conv_id) boundaries between shards; a path is cut at ``MOST_DEPTH`` steps, then without its id."""
    shards = max(1, min(MOST_SPLITTERS + 1, -(-n_convs // SHARD_ROWS)))
    if shards == 1:
        return []
    ids = members.select("conv_id", F.slice("path", 1, MOST_DEPTH).alias("path"), (F.size("path") > MOST_DEPTH).alias("cut"))
    sample = sorted((tuple(r.path), _FIRST_ID if r.cut else r.conv_id)
                    for r in ids.orderBy(F.xxhash64("conv_id"), "conv_id").limit(shards * SAMPLES).collect())  # bounded as MOST_SPLITTERS is
    return sorted({sample[len(sample) * k // shards] for k in range(1, shards)})


class Skeleton:
    """The trie of the splitters' paths: node 0 is the root; a node's number is larger than its parent's."""

    def __init__(self, splitters: list[tuple]):
        self.children: list[dict[int, int]] = [{}]
        self.parent = [-1]
        for path, _ in splitters:
            at = 0
            for lo in path:
                if lo not in self.children[at]:
                    self.children[at][lo] = len(self.parent)
                    self.parent.append(at)
                    self.children.append({})
                at = self.children[at][lo]


class _Open:
    """A segment on the stack of a shard's pass."""

    def __init__(self, lo, number, depth, bottom, n, above, chars):
        self.lo, self.number, self.depth, self.bottom, self.n, self.above, self.chars = lo, number, depth, bottom, n, above, chars
        self.children = self.leaves = self.saved = self.block = 0
        self.ends: list[int] = []
        self.sha = hashlib.sha256()
        self.started = False

    def hash_ends(self):
        if self.ends:
            self.sha.update((b"," if self.started else b"") + ",".join(map(str, self.ends)).encode())
            self.started, self.ends = True, []


_PARTS = "node int, shard int, block int, lo bigint, depth bigint, bottom bigint, n bigint, above bigint, chars bigint, children bigint, leaves bigint, saved bigint, ends binary"
_NAMES = [c.split()[0] for c in _PARTS.split(", ")]


def shard_pass(rows, skeleton: Skeleton, first: int, n_convs: int):
    """Rows of ``_PARTS`` from (shard, conv_id, n_turns, chars, path, steps) sorted by shard, path, id.

    ``node`` -1: a finished segment; else a skeleton node's part, or (``block`` >= 0) ids that end there."""
    shard, stack = None, []

    def row(v, block=-1, ends=b""):
        return (v.number, shard, block, v.lo, v.depth, v.bottom, v.n, v.above, v.chars, v.children, v.leaves, v.saved, ends)

    def put_block(v):
        out = row(v, v.block, pack_numbers(v.ends))
        v.block, v.ends = v.block + 1, []
        return out

    def close():
        v = stack.pop()
        if v.number >= 0:
            if v.ends:
                yield put_block(v)
            yield row(v)
            return
        v.hash_ends()
        v.leaves = v.leaves or 1
        v.saved += (v.n - 1) * v.chars
        yield row(v, ends=v.sha.hexdigest().encode())
        up = stack[-1]
        up.children, up.leaves, up.saved = up.children + 1, up.leaves + v.leaves, up.saved + v.saved

    for s, conv_id, n_turns, chars, path, steps in rows:
        if s != shard:
            while stack:
                yield from close()
            shard = s
            stack.append(_Open(first, 0, 0, 0, n_convs, 0, 0))
        same = 0
        while same < min(len(path), len(stack) - 1) and stack[same + 1].lo == path[same]:
            same += 1
        while len(stack) - 1 > same:
            yield from close()
        for k in range(same, len(path)):
            depth, n, above = steps[k]
            bottom, end = (steps[k + 1][0] - 1, steps[k + 1][2]) if k + 1 < len(path) else (n_turns, chars)
            number = skeleton.children[stack[-1].number].get(path[k], -1) if stack[-1].number >= 0 else -1
            stack.append(_Open(path[k], number, depth, bottom, n, above, end - above))
        v = stack[-1]
        v.ends.append(conv_id)
        if len(v.ends) >= BLOCK_IDS:
            if v.number >= 0:
                yield put_block(v)
            else:
                v.hash_ends()
    while stack:
        yield from close()


def _batches(rows, schema: pa.Schema, size: int = 5000):
    held = []
    for r in rows:
        held.append(r)
        if len(held) >= size:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def _values(batches, names):
    for b in batches:
        yield from zip(*(b.column(b.schema.get_field_index(c)).to_pylist() for c in names))


def finish_segments(members: DataFrame, n_convs: int, first: int) -> DataFrame:
    """``lo, depth, bottom, above, children, leaves, saved, ends`` of every segment, the root's with depth 0."""
    from pyspark.sql.pandas.types import to_arrow_schema
    spark = importable(members).sparkSession
    splitters = choose_splitters(members, n_convs)
    skeleton = Skeleton(splitters)
    known = spark.sparkContext.broadcast((splitters, skeleton))
    names = ["conv_id", "n_turns", "chars", "path", "steps"]

    def deal(batches):
        bounds = known.value[0]
        for b in batches:
            cols = [b.column(b.schema.get_field_index(c)) for c in names]
            shard = [bisect_right(bounds, (tuple(p), c)) for p, c in zip(cols[3].to_pylist(), cols[0].to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(shard, pa.int32()), *cols], names=["shard", *names])

    dealt = members.mapInArrow(deal, "shard int, conv_id bigint, n_turns bigint, chars bigint, path array<bigint>, steps array<array<bigint>>")
    ordered = dealt.repartition(len(splitters) + 1, "shard").sortWithinPartitions("shard", "path", "conv_id")

    def walk(batches):
        yield from _batches(shard_pass(_values(batches, ["shard", *names]), known.value[1], first, n_convs), walk_schema)

    walk_schema = to_arrow_schema(spark.createDataFrame([], _PARTS).schema)
    parts = checkpointed(ordered.mapInArrow(walk, _PARTS))
    done = parts.where("node < 0").select("lo", "depth", "bottom", "above", "children", "leaves", "saved", F.col("ends").cast("string").alias("ends"))

    same = ("lo", "depth", "bottom", "n", "above", "chars")
    reduced = parts.where("node >= 0 and block < 0").groupBy("node").agg(
        *(F.max(c).alias(c) for c in same), *(F.sum(c).alias(c) for c in ("children", "leaves", "saved")))
    total = {r.node: r.asDict() for r in reduced.collect()}  # as many rows as the skeleton has nodes
    for node in sorted(total, reverse=True):  # children first
        v, up = total[node], total.get(skeleton.parent[node])
        v["leaves"] = v["leaves"] or 1
        v["saved"] += (v["n"] - 1) * v["chars"]
        if up is not None:
            up["children"], up["leaves"], up["saved"] = up["children"] + 1, up["leaves"] + v["leaves"], up["saved"] + v["saved"]

    def hash_blocks(batches):
        def run():
            at, sha = None, None
            for node, packed in _values(batches, ["node", "ends"]):
                if node != at:
                    if at is not None:
                        yield at, sha.hexdigest()
                    at, sha, join = node, hashlib.sha256(), b""
                sha.update(join + ",".join(map(str, unpack_numbers(packed)[0].tolist())).encode())
                join = b","
            if at is not None:
                yield at, sha.hexdigest()
        yield from _batches(run(), pa.schema([("node", pa.int32()), ("sha", pa.string())]))

    blocks = parts.where("node >= 0 and block >= 0").repartition("node").sortWithinPartitions("node", "shard", "block").select("node", "ends")
    shas = blocks.mapInArrow(hash_blocks, "node int, sha string")
    columns = ["node", "lo", "depth", "bottom", "above", "children", "leaves", "saved"]
    top = spark.createDataFrame([[int(v[c]) for c in columns] for v in total.values()], "node int, " + ", ".join(f"{c} bigint" for c in columns[1:]))
    top = top.join(shas, "node", "left").select(*columns[1:], F.coalesce("sha", F.lit(_EMPTY)).alias("ends"))
    return done.unionByName(top)


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """A row per node of the rebuilt conversations' prefix trie (columns of ``op13_prefix_trie``)."""
    turns, n_turns = rebuilt(number_turns(conversations))
    n_turns = checkpointed(n_turns)
    n_convs, first = n_turns.agg(F.count(F.lit(1)), F.min("conv_id")).first()
    first = first or 0
    rows = keyed(turns)
    nodes = node_table(rows, n_convs, first)
    segments = finish_segments(member_paths(rows, nodes, n_turns), n_convs, first)
    place = nodes.withColumn("mark", F.when(F.col("top"), F.col("depth")).otherwise(0).cast("bigint"))
    place = running(place, "lo", ["depth"], {"top_depth": ("max", "mark")}, ["lo", "depth", "n", "chars", "upto", "parent"])
    s = segments.select("lo", F.col("depth").alias("top_depth"), "bottom", "above", "children", "leaves", "saved", "ends")
    bottom = F.col("depth") == F.col("bottom")
    out = place.join(s, ["lo", "top_depth"]).select(
        F.col("lo").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), F.col("n").alias("n_convs"),
        F.when(bottom, F.col("children")).otherwise(1).alias("n_children"), F.col("leaves").alias("n_leaves"),
        (F.col("saved") - (F.col("n") - 1) * (F.col("upto") - F.col("chars") - F.col("above"))).alias("saved_tokens"),
        F.when(bottom, F.col("ends")).otherwise(_EMPTY).alias("ends_sha256"))
    root = segments.where("depth = 0").where(F.lit(n_convs > 0)).select(
        F.col("lo").alias("conv_id"), "depth", F.lit(None).cast("bigint").alias("parent_conv_id"), F.lit(n_convs).cast("bigint").alias("n_convs"),
        F.col("children").alias("n_children"), F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.col("ends").alias("ends_sha256"))
    return out.unionByName(root)


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations"))
