import re
from itertools import permutations

import pyarrow as pa
from pyspark.sql import functions as F

import touchline.llm.filter_audit as fa
from touchline.llm.filter_audit import audit, csr_shards, dictionary, local_shards, op12_filter_audit

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(docs, labels):
    """The audit's rows from (doc_id, source, text) and (doc_id, quality, toxic), one document at a time."""
    lowest, flags = {}, []
    for d, _, t in docs:
        if d is not None:
            lowest[t or ""] = min(d, lowest.get(t or "", d))
    for d, s, t in docs:
        t = t or ""
        w = WORD.findall(t)
        flags.append((s or "", {
            "A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t),
            "D": bool(re.search(r"[#$%&*|]", t)), "E": d is not None and d > lowest[t]},
            any(x == d and d is not None and q == 1 for x, q, _ in labels), any(x == d and d is not None and o == 1 for x, _, o in labels)))
    out = []
    for part in sorted({s for s, *_ in flags}):
        rows, shapley = [], dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = [f for f in flags if f[0] == part]
            gone = []
            for step, x in enumerate(order, 1):
                lost = [f for f in left if f[1][x]]
                left = [f for f in left if not f[1][x]]
                mine = [f for f in flags if f[0] == part and f[1][x]]
                shapley[x] += len(lost)
                rows.append([part, "".join(order), step, len(left), len(lost), sum(f[1][x] for f in gone),
                             sum(sum(f[1].values()) == 1 for f in mine), sum(f[2] for f in lost), sum(f[3] for f in lost)])
                gone += lost
        out += [tuple([*r, shapley[r[1][r[2] - 1]]]) for r in rows]
    return sorted(out)


COLUMNS = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def rows_of(df):
    assert df.columns == COLUMNS
    return sorted(tuple(r) for r in df.collect())


def test_whole_table_equals_brute_force(spark):
    d = "/root/testdata/sf0.001"
    docs = [tuple(r) for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "source", "text").collect()]
    labels = [tuple(r) for r in spark.read.parquet(f"{d}/labels.parquet").select("doc_id", "quality", "toxic").collect()]
    assert rows_of(op12_filter_audit(spark, d)) == brute(docs, labels)


def test_edges(spark, monkeypatch):
    monkeypatch.setattr(fa, "SHARD_BYTES", 200)
    varied = " ".join(f"w{i}" for i in range(60))
    docs = [(1, "a", varied), (2, "a", varied), (2, None, varied), (None, "a", varied), (None, "b", varied), (3, "b", None), (4, "b", ""),
            (4, "b", ""), (5, "b", "ÀB CD é $"), (6, "c", "x " * 500), (6, "c", "x " * 500), (0, "c", "tab\tand\x0bline\nX"), (7, "", "\x1cw " * 70)]
    labels = [(1, 1, 0), (2, 0, 1), (2, 1, 0), (None, 1, 1), (6, None, 1), (99, 1, 1)]
    frame = spark.createDataFrame(docs, "doc_id bigint, source string, text string").withColumn("mask", F.lit("x")).withColumn("part", F.lit(1))
    got = rows_of(audit(frame, spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")))
    assert got == brute(docs, labels) and len(got) == 600 * 4


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id bigint, source string, text string")
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert audit(docs, labels).count() == 0
    one = spark.createDataFrame([(1, "s", None)], docs.schema)
    assert rows_of(audit(one, labels)) == brute([(1, "s", None)], [])


def test_matrix_gives_the_words_back(spark, monkeypatch):
    """Every CSR row, through the dictionary, is the document's bag of words; shards share one numbering."""
    import numpy as np
    from collections import Counter

    from touchline.llm.shards import unpacked
    monkeypatch.setattr(fa, "SHARD_BYTES", 60)
    monkeypatch.setattr(fa, "BUCKET_BYTES", 20)
    docs = [(i, "s", " ".join(f"w{(i * j) % 13}é" for j in range(i))) for i in range(12)]
    local, buckets = local_shards(spark.createDataFrame(docs, "doc_id bigint, part string, text string"))
    names = {r.term_id: r.word for r in dictionary(local, buckets).collect()}
    blocks = csr_shards(local, buckets).collect()
    assert buckets > 4 and len(blocks) > 2 and len(set(names.values())) == len(names)
    got = {}
    for b in blocks:
        ends, ids, n = (np.frombuffer(b[c], np.int64) for c in ("indptr", "indices", "counts"))
        for k, d in enumerate(unpacked(b.rows).column("doc_id").to_pylist()):
            got[d] = Counter({names[i]: c for i, c in zip(ids[ends[k]:ends[k + 1]].tolist(), n[ends[k]:ends[k + 1]].tolist())})
    assert got == {d: Counter(t.split()) for d, _, t in docs}


def test_shards_cover_all_rows(monkeypatch):
    from touchline.llm import shards
    monkeypatch.setattr(shards, "shard_numbers", lambda: iter(range(100)))
    batch = pa.RecordBatch.from_pydict({"text": pa.array(["a" * 5, None, "b" * 30, "", "c" * 4, "d"])})
    tables = [t.column("text").to_pylist() for _, t in shards.shards([batch, batch], 10)]
    assert sum(tables, []) == batch.column(0).to_pylist() * 2
    assert all(sum(len(x or "") for x in t[:-1]) < 10 for t in tables)


def test_words_of_pieces(monkeypatch):
    from touchline.llm import shards
    text = b" ab cde\tf \n" * 20 + b"x" * 50 + b" y"
    monkeypatch.setattr(shards, "PIECE", 7)
    assert sum(shards.words(text), []) == text.split() and list(shards.words(b"")) == [[]]


def test_query_equals_its_sql(spark):
    import duckdb
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"create view {t} as select * from read_parquet('/root/testdata/sf0.01/{t}.parquet')")
    want = con.execute(fa.ORACLE_SQL)
    assert [c[0] for c in want.description] == COLUMNS
    assert rows_of(op12_filter_audit(spark, "/root/testdata/sf0.01")) == sorted(map(tuple, want.fetchall()))
