import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from touchline.llm.simhash_dedup import (Forest, build_tree, fingerprint_links, link_within, near_duplicates,
                                         op10_simhash_dedup, route, star_components)


def brute_print(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    grams = [b" ".join(w[i:i + 4]) for i in range(max(1, len(w) - 3))]
    hs = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(prints, radius=4):
    ids = sorted(prints)
    parent = {i: i for i in ids}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for x, i in enumerate(ids):
        for j in ids[:x]:
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_equals_brute_force_on_the_whole_table(spark):
    d = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()}
    prints = {i: brute_print(t) for i, t in texts.items()}
    want = brute_components(prints)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in op10_simhash_dedup(spark, d).collect()}
    assert got == {i: (f"{prints[i]:016x}", want[i]) for i in texts}


@pytest.mark.parametrize("leaves", [1, 4, 32])
def test_vantage_tree_finds_every_pair(leaves):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    flips = (np.uint64(1) << rng.integers(0, 64, (1200, 3), dtype=np.uint64))
    points = np.unique(np.concatenate([base, base[rng.integers(0, 300, 1200)] ^ flips[:, 0] ^ flips[:, 1] ^ flips[:, 2],
                                       np.arange(600, dtype=np.uint64)]))
    shard, at, query = route(build_tree(points[::3], leaves), points, 4)
    assert sorted(at[~query]) == list(range(len(points)))
    forest = Forest(len(points))
    for s in np.unique(shard):
        own = shard == s
        link_within(points, at[own & ~query], at[own & query], 4, forest)
    exact = Forest(len(points))
    i, j = np.nonzero(np.bitwise_count(points[:, None] ^ points[None, :]) <= 4)
    exact.link(i, j)
    assert (forest.roots() == exact.roots()).all()


def test_distributed_links_equal_brute_force(spark):
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 62, 3000, dtype=np.uint64)
    near = base[:1500] ^ (np.uint64(1) << rng.integers(0, 62, 1500, dtype=np.uint64))
    points = np.unique(np.concatenate([base, near, np.arange(2000, dtype=np.uint64)]))
    prints = {int(i): int(p) for i, p in enumerate(points)}
    reps = spark.createDataFrame([(int(np.uint64(p).view(np.int64)), i) for i, p in prints.items()], "bits bigint, rep bigint")
    got = {r.node: r.root for r in star_components(fingerprint_links(reps)).collect()}
    exact = Forest(len(points))
    for a in range(0, len(points), 500):
        i, j = np.nonzero(np.bitwise_count(points[a:a + 500, None] ^ points[None, :]) <= 4)
        exact.link(i + a, j)
    assert {i: got.get(i, i) for i in prints} == dict(enumerate(exact.roots().tolist()))


def test_stars_on_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)], "a bigint, b bigint")
    assert {r.root for r in star_components(edges).collect()} == {0}


def test_edges(make_docs):
    rows = [(5, None), (3, ""), (4, "  \n"), (7, "One two"), (6, "one TWO"), (None, "one two"), (7, "One two")]
    docs = make_docs(rows).withColumn("bits", F.lit("clash"))
    got = sorted([(r.doc_id, r.component_id) for r in near_duplicates(docs).collect()], key=str)
    assert got == sorted([(5, 3), (3, 3), (4, 3), (7, 6), (6, 6), (None, None), (7, 6)], key=str)
    assert near_duplicates(docs.limit(0)).count() == 0
