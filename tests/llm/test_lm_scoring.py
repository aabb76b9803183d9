import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from touchline.llm.lm_scoring import (END, Trie, adaptive_log10, add_up, op1_lm_scoring, score_documents, strings_of)


def low(t):
    return (t or "").encode().lower()


def held(d):
    return zlib.crc32(str(d).encode() if d is not None else b"") % 10 == 0


def brute_tables(texts, order):
    """Per order: context -> symbol -> count, shorter contexts counting distinct longer ones."""
    seen = [Counter() for _ in range(order + 1)]
    for t in texts:
        buf = END * order + t + END
        for i in range(order, len(buf)):
            for o in range(order + 1):
                seen[o][buf[i - o:i + 1]] += 1
    tables = [None] * (order + 1)
    for o in range(order, -1, -1):
        node = defaultdict(Counter)
        if o == order:
            for s, n in seen[o].items():
                node[s[:-1]][s[-1]] = n
        else:
            for s in seen[o + 1]:
                node[s[1:-1]][s[-1]] += 1
        tables[o] = node
    return tables


def brute_score(tables, text, order):
    buf, total = END * order + text + END, 0.0
    for i in range(order, len(buf)):
        gone = set()
        for o in range(order, -1, -1):
            node = tables[o].get(buf[i - o:i])
            if not node:
                continue
            n = sum(c for s, c in node.items() if s not in gone)
            kinds = sum(s not in gone for s in node)
            if buf[i] in node:
                total += math.log10((node[buf[i]] - 0.5) / n)
                break
            if kinds:
                total += math.log10(0.5 * kinds / n)
            gone |= set(node)
        else:
            total += math.log10(1 / (256 - len(gone)))
    return total


def brute(rows, order):
    training = [low(t) for d, t in rows if not held(d)]
    count = Counter(w for t in training for w in [*t.split(), b""])
    n, v = sum(count.values()), len(count)
    tables = brute_tables(training, order)
    out = []
    for d, t in rows:
        words = [*low(t).split(), b""]
        base = sum(math.log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in words)
        out.append((d, held(d), len(words), sum(count[w] > 0 for w in words), n, base, brute_score(tables, low(t), order)))
    return out


def compare(got, want):
    def key(r):
        return str(r[:4])
    got, want = sorted((tuple(r) for r in got), key=key), sorted(want, key=key)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    for g, w in zip(got, want):
        assert g[5:] == pytest.approx(w[5:], rel=1e-9, abs=1e-9)


def test_part_of_the_table_equals_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("n_chars < 900")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    compare(score_documents(docs, order=4).collect(), brute(rows, 4))


def test_whole_table_beats_the_base(spark):
    got = op1_lm_scoring(spark, "/root/testdata/sf0.01").where("held_out").agg(F.sum("score"), F.sum("base_score"), F.count("*")).first()
    assert got[2] > 50 and got[0] > got[1]


def test_edges(make_docs):
    rows = [(1, None), (2, ""), (3, "A b a"), (3, "A b a"), (None, "é é"), (5, "x" * 3000), (6, " \t\n"), (19, "q z")]
    docs = make_docs(rows).withColumn("score", F.lit("clash"))
    compare(score_documents(docs, order=3).collect(), brute(rows, 3))
    assert score_documents(docs.limit(0)).count() == 0
    only = [(d, t) for d, t in [(i, "a b") for i in range(200)] if held(d)]
    compare(score_documents(make_docs(only), order=2).collect(), brute(only, 2))


def test_symbols_share_all_probability():
    rnd = random.Random(1)
    texts = ["".join(rnd.choice("abcd ") for _ in range(80)).encode() for _ in range(20)]
    g = strings_of(texts, 3)[0]
    tables, k = [None] * 4, add_up(g, np.ones(len(g), np.int64))
    for o in range(3, -1, -1):
        tables[o] = k
        s = k[0] & np.uint64((1 << (8 * o)) - 1)
        k = add_up(s, np.ones(len(s), np.int64))
    trie = Trie(tables)
    for ctx in (b"abc", b"zzz", b"\xff\xff\xff", b"d a", b"q d"):
        every = np.array([int.from_bytes(ctx + bytes([s]), "big") for s in range(256)], np.uint64)
        assert (10 ** trie.log10(every)).sum() == pytest.approx(1.0)


def test_every_string_counts_at_any_size(make_docs, monkeypatch):
    import touchline.llm.lm_scoring as lm
    rnd = random.Random(3)
    rows = [(i, "".join(rnd.choice("abcde é") for _ in range(120))) for i in range(120)]
    monkeypatch.setattr(lm, "HOME_BYTES", 700)  # many buckets: contexts of every order reach over their ends
    monkeypatch.setattr(lm, "SAMPLE_EVERY", 1)
    assert len(lm.sample_splitters(make_docs(rows), 1, 20, 5)) > 15
    compare(score_documents(make_docs(rows), order=5).collect(), brute(rows, 5))


def test_adaptive_code_learns_within_a_text():
    assert adaptive_log10(b"") == pytest.approx(-math.log10(256))
    assert adaptive_log10(b"abcabcabc" * 20) > 3 * adaptive_log10(b"abcabcabc" * 4)
