import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

import touchline.llm.prefix_trie as pt
from touchline.llm.prefix_trie import op13_prefix_trie, prefix_trie
from touchline.llm.scans import running

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def brute(rows):
    """Every node from (conv_id, turn, role, text), by listing all prefixes."""
    turns = defaultdict(list)
    for c, n, r, t in rows:
        if c is not None:
            turns[c].append(((n is not None, n or 0), r or "", t or ""))
    whole = {c: [(r, x) for _, r, x in sorted(t)] for c, t in turns.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c in sorted(whole):
        h = zlib.crc32(str(c).encode()) % 6
        seq = whole.get(c - c % 100 if c >= 0 else c + (-c) % 100, [])[:h] + whole[c][h:]
        for d in range(len(seq) + 1):
            members[tuple(seq[:d])].append(c)
        ends[tuple(seq)].append(c)
    children = defaultdict(int)
    for node in members:
        if node:
            children[node[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for node in sorted(members, key=len, reverse=True):
        leaves[node] += not children[node]
        if node:
            saved[node] += (len(members[node]) - 1) * len(node[-1][1])
            leaves[node[:-1]] += leaves[node]
            saved[node[:-1]] += saved[node]
    return sorted([(m[0], len(n), members[n[:-1]][0] if n else None, len(m), children[n], leaves[n], saved[n],
                    hashlib.sha256(",".join(map(str, ends[n])).encode()).hexdigest()) for n, m in members.items()], key=str)


def engine(df):
    assert df.columns == COLUMNS
    return sorted([tuple(r) for r in df.collect()], key=str)


def small(monkeypatch, rows=3, depth=4, block=2):
    monkeypatch.setattr(pt, "SHARD_ROWS", rows)
    monkeypatch.setattr(pt, "MOST_DEPTH", depth)
    monkeypatch.setattr(pt, "BLOCK_IDS", block)


@pytest.mark.parametrize("table", ["sf0.001", "sf0.01"])
def test_whole_table_equals_brute_force(spark, table):
    d = f"/root/testdata/{table}"
    rows = [tuple(r) for r in spark.read.parquet(f"{d}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert engine(op13_prefix_trie(spark, d)) == brute(rows)


def corpus(seed):
    """Conversations that share first turns, copies, one of many turns and its copy, nulls, ties, repeated rows."""
    rnd = random.Random(seed)
    texts = ["", "é", "aa", "b" * 9, None]
    rows = []
    for c in [*range(0, 40), *range(100, 130), 250, 251, 300, -5, -100, -130]:
        rows += [(c, t, rnd.choice(["user", "bot", None]), rnd.choice(texts)) for t in range(rnd.randint(1, 7))]
    same = [(t, "user", f"same {t}") for t in range(9)]
    rows += [(c, *t) for c in [*range(400, 440), 1200] for t in same]
    long = [(t, "bot", "x" * (t % 5)) for t in range(300)]
    rows += [(c, *t) for c in (500, 501, 502) for t in long] + [(502, 400, "bot", "more")]
    rows += [(600, None, "user", "null turn"), (600, 1, "b", "tie"), (600, 1, "a", "tie"), (600, 1, "a", "tie"), (None, 1, "a", "nobody"), (601, 2, None, None)]
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed,shard,depth", [(1, 3, 4), (2, 7, 1), (3, 1000, 64)])
def test_random_conversations_equal_brute_force(spark, monkeypatch, seed, shard, depth):
    small(monkeypatch, shard, depth)
    rows = corpus(seed)
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5).withColumn("lo", F.lit("clash"))
    assert engine(prefix_trie(docs)) == brute(rows)


def test_empty_and_turnless(spark):
    assert prefix_trie(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(c, 0, "user", "t") for c in range(1, 30)]  # no conversation 0: many have no turn left
    got = engine(prefix_trie(spark.createDataFrame(rows, SCHEMA)))
    assert got == brute(rows) and got[0][1] == 0 and got[0][3] == 29


@pytest.fixture()
def uncoalesced(spark):
    """Small shuffles keep their partitions, so that running values cross them."""
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(name, "false")
    yield
    spark.conf.set(name, "true")


def test_partitions_hand_values_on(spark, monkeypatch, uncoalesced):
    small(monkeypatch)
    rows = corpus(9)
    assert engine(prefix_trie(spark.createDataFrame(rows, SCHEMA))) == brute(rows)


def test_one_conversation_spreads_over_partitions(spark, uncoalesced):
    rows = spark.range(2000).select(F.lit(7).cast("bigint").alias("k"), F.col("id").alias("v"))
    out = running(rows, "k", ["v"], {"total": ("sum", "v"), "x": ("xor", "v"), "top": ("max", "v")}, ["k", "v"])
    got = {r.v: (r.total, r.x, r.top) for r in out.collect()}
    want, total, x = {}, 0, 0
    for v in range(2000):
        total, x = total + v, x ^ v
        want[v] = (total, x, v)
    assert got == want
    assert out.rdd.getNumPartitions() > 1


def test_running_restarts_at_each_key(spark, uncoalesced):
    rnd = random.Random(4)
    data = [(rnd.randint(0, 30), i, rnd.randint(0, 99)) for i in range(500)]
    out = running(spark.createDataFrame(data, "k bigint, i bigint, v bigint"), "k", ["i"], {"total": ("sum", "v"), "top": ("max", "v")}, ["k", "i"])
    got = sorted((r.k, r.i, r.total, r.top) for r in out.collect())
    want = []
    for k in range(31):
        total = top = 0
        for kk, i, v in sorted(data):
            if kk == k:
                total, top = total + v, max(top, v)
                want.append((k, i, total, top))
    assert got == sorted(want)


def test_a_group_of_copies_spreads_over_shards():
    members = sorted([((5,), c) for c in range(100)] + [((5, c), c) for c in range(100, 140)])
    splitters = [members[k] for k in (30, 60, 120)]
    skeleton = pt.Skeleton(splitters)
    assert skeleton.parent == [-1, 0, 1] and len({pt.bisect_right(splitters, m) for m in members}) == 4
