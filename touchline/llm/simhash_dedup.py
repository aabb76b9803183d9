"""Operator 10, SimHash near-dedup: exact links within a Hamming radius by vantage-point trees.

1. Every whole text gets its fingerprint (``fingerprints``); equal ones collapse to a representative.
2. A vantage-point tree is built on the driver from a bounded sample of fingerprints: each inner node
   has a vantage point and the median distance to it. It routes every fingerprint to one home shard.
   A pair within ``radius`` has distances to the vantage point that differ by at most ``radius``
   (triangle bound), so only points near the boundary cross it: a near-side point that the far side
   may hold a partner of goes there as a query, and a query visits each child that the bound allows.
3. Each shard finds all pairs among its homes and between queries and homes with the same recursion,
   down to small exact blocks. It returns a spanning forest of the links, never all pairs of a group.
4. Alternating star contraction joins the forests of all shards; each round is checkpointed.

Cost: in 64 dimensions a ball of radius 4 crosses many boundaries, so a query visits about
``1.65 ** depth`` shards. ``shards`` grows with the root of the number of distinct fingerprints.

Defined results: null text is empty (fingerprint zero, linked like any other); a null ``doc_id`` takes
no part in linking and has a null component; repeated rows give repeated rows; an empty table gives
no row; other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.llm.common import checkpointed, importable, release, table
from touchline.llm.fingerprints import fingerprints

SHINGLE = 4
RADIUS = 4
#: Sampled fingerprints per shard, and at most so many in all, for choosing vantage points.
SAMPLE_PER_SHARD, SAMPLE_MOST = 64, 1 << 17
#: Rows of a shard's group that one task should hold; beyond it its queries are dealt over several groups.
GROUP_ROWS = 400_000
_BLOCK = 512


def distance(points: np.ndarray, vantage) -> np.ndarray:
    return np.bitwise_count(points ^ np.uint64(vantage)).astype(np.int16)


def choose_vantage(points: np.ndarray, tries: int = 5) -> tuple[int, int, np.ndarray]:
    """The candidate with the widest spread of distances, its splitting distance, and the distances.

    Points at most the splitting distance away are near, others far; both sides are non-empty unless
    all distances are equal (then the spread is zero and nothing can be split)."""
    best = None
    for v in points[np.linspace(0, len(points) - 1, min(tries, len(points))).astype(int)]:
        d = distance(points, v)
        spread = float(d.std())
        if best is None or spread > best[0]:
            best = (spread, int(v), d)
    _, v, d = best
    mu = int(np.median(d))
    if mu >= int(d.max()):
        mu = int(d.max()) - 1
    return v, mu, d


def build_tree(points: np.ndarray, leaves: int):
    """Nested ``(vantage, mu, near, far)``; a leaf is its shard number."""
    least, number = max(2, len(points) // max(1, leaves)), iter(range(1 << 30))

    def node(p):
        if leaves < 2 or len(p) < 2 * least:
            return next(number)
        v, mu, d = choose_vantage(p)
        if int(d.min()) == int(d.max()):
            return next(number)
        return v, mu, node(p[d <= mu]), node(p[d > mu])

    return node(points)


def route(tree, points: np.ndarray, radius: int):
    """(shard, index of point, is query) arrays: one home each, and the shards to ask as a query."""
    out = []

    def walk(node, home, query):
        if not len(home) and not len(query):
            return
        if isinstance(node, int):
            out.append((np.full(len(home) + len(query), node, np.int32), np.concatenate([home, query]),
                        np.repeat([False, True], [len(home), len(query)])))
            return
        v, mu, near, far = node
        dh, dq = distance(points[home], v), distance(points[query], v)
        walk(near, home[dh <= mu], query[dq - radius <= mu])
        crossing = home[(dh <= mu) & (dh + radius > mu)]
        walk(far, home[dh > mu], np.concatenate([crossing, query[dq + radius > mu]]))

    walk(tree, np.arange(len(points)), np.zeros(0, np.int64))
    return [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0, t) for t in (np.int32, np.int64, bool)]


class Forest:
    """Components of local nodes; the smallest index of a component is its root."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def find(self, i: np.ndarray) -> np.ndarray:
        r = self.parent[i]
        while True:
            up = self.parent[r]
            if (up == r).all():
                return r
            r = up

    def link(self, i: np.ndarray, j: np.ndarray) -> None:
        while len(i):
            a, b = self.find(i), self.find(j)
            open_ = a != b
            if not open_.any():
                return
            i, j, a, b = i[open_], j[open_], a[open_], b[open_]
            np.minimum.at(self.parent, np.maximum(a, b), np.minimum(a, b))

    def roots(self) -> np.ndarray:
        return self.find(np.arange(len(self.parent)))


def link_within(points: np.ndarray, home: np.ndarray, query: np.ndarray, radius: int, forest: Forest) -> None:
    """Link every home-home and query-home pair within ``radius`` (indices into ``points``)."""
    stack = [(home, home, True), (home, query, False)]
    while stack:
        h, q, own = stack.pop()
        if not len(h) or not len(q):
            continue
        d = None
        if len(h) > _BLOCK and len(q) > 64:
            v, mu, d = choose_vantage(points[h], 3)
            if int(d.max()) - int(d.min()) <= radius:
                d = None
        if d is None:
            for at in range(0, len(q), _BLOCK):
                part = q[at:at + _BLOCK]
                for to in range(0, at + _BLOCK if own else len(h), _BLOCK):
                    block = h[to:to + _BLOCK]
                    i, j = np.nonzero(np.bitwise_count(points[part][:, None] ^ points[block][None, :]) <= radius)
                    if len(i):
                        i, j = part[i], block[j]
                        keep = i != j
                        forest.link(i[keep], j[keep])
            continue
        near, far = h[d <= mu], h[d > mu]
        if own:
            stack += [(near, near, True), (far, far, True), (far, near[d[d <= mu] + radius > mu], False)]
        else:
            dq = distance(points[q], v)
            stack += [(near, q[dq - radius <= mu], False), (far, q[dq + radius > mu], False)]


def star_components(edges: DataFrame) -> DataFrame:
    """``node, root`` (the smallest connected id) of every id that has a link: alternating stars."""
    e = checkpointed(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    state = None
    while True:
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        small = large.groupBy("a").agg(F.min("b").alias("m"))
        moved = large.join(small, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        e = checkpointed(moved.union(small.select("a", F.col("m").alias("b"))).where("a <> b").distinct())
        now = tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == state or not now[0]:
            return e.select(F.col("a").alias("node"), F.col("b").alias("root"))
        state = now


def fingerprint_links(reps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Spanning links ``a, b`` (representative ids) of all fingerprints within ``radius`` bits.

    ``reps``: ``bits, rep``, one row per distinct fingerprint."""
    spark = importable(reps).sparkSession
    n = reps.count()
    shards = max(1, int(math.sqrt(n) / 8))
    sampled = min(SAMPLE_MOST, SAMPLE_PER_SHARD * shards)  # bounded, whatever the corpus
    sample = reps.select("bits").orderBy(F.xxhash64("bits"), "bits").limit(sampled).collect()
    tree = spark.sparkContext.broadcast(build_tree(np.array([r.bits for r in sample], np.int64).view(np.uint64), shards))
    spread = max(1, math.ceil(n * 1.65 ** math.log2(shards) / shards / GROUP_ROWS))

    def deal(batches):
        for b in batches:
            bits = b.column(b.schema.get_field_index("bits")).to_numpy().view(np.uint64)
            rep = b.column(b.schema.get_field_index("rep")).to_numpy()
            shard, at, query = route(tree.value, bits, radius)
            part = np.where(query, (bits[at] >> np.uint64(20)).astype(np.int64) % spread, 0)
            if spread > 1:  # homes go to each of their shard's groups
                homes = np.flatnonzero(~query)
                more = np.tile(homes, spread - 1)
                shard, at, query = (np.concatenate([x, x[more]]) for x in (shard, at, query))
                part = np.concatenate([part, np.repeat(np.arange(1, spread), len(homes))])
            yield pa.RecordBatch.from_arrays([pa.array(shard), pa.array(part.astype(np.int32)), pa.array(bits[at].view(np.int64)),
                                              pa.array(rep[at]), pa.array(query)], names=["shard", "part", "bits", "rep", "query"])

    def resolve(rows: pd.DataFrame) -> pd.DataFrame:
        release()
        rows = rows.sort_values("rep", ignore_index=True)
        points, rep, query = rows["bits"].to_numpy().view(np.uint64), rows["rep"].to_numpy(), rows["query"].to_numpy()
        forest = Forest(len(rows))
        link_within(points, np.flatnonzero(~query), np.flatnonzero(query), radius, forest)
        root = forest.roots()
        moved = root != np.arange(len(rows))
        return pd.DataFrame({"a": rep[moved], "b": rep[root[moved]]})

    dealt = reps.mapInArrow(deal, "shard int, part int, bits bigint, rep bigint, query boolean")
    return dealt.groupBy("shard", "part").applyInPandas(resolve, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """``doc_id, bits, component_id`` of every row; linked fingerprints share the smallest reachable id."""
    prints = checkpointed(fingerprints(docs, shingle))
    reps = checkpointed(prints.where("doc_id is not null").groupBy("bits").agg(F.min("doc_id").alias("rep")))
    roots = star_components(fingerprint_links(reps, radius))
    of_bits = reps.join(roots, F.col("rep") == F.col("node"), "left").select("bits", F.coalesce("root", "rep").alias("root"))
    return prints.join(of_bits, "bits", "left").select(
        "doc_id", "bits", F.when(F.col("doc_id").isNotNull(), F.col("root")).alias("component_id"))


def op10_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("bits"), 16, "0")).alias("fingerprint"), "component_id")
