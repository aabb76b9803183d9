import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import touchline.llm.block_dedup as bd
from touchline.llm import shards
from touchline.llm.block_dedup import op11_block_dedup, remove_repeated_words

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows):
    """(doc, n_words, n_removed, sha) per row, by listing every window of 20 words."""
    split = [(d, WORD.findall(t or "")) for d, t in rows]
    smallest = {}
    for d, w in split:
        if d is not None:
            for i in range(len(w) - 19):
                key = tuple(w[i:i + 20])
                smallest[key] = min(d, smallest.get(key, d))
    out = []
    for d, w in split:
        gone, before = set(), set()
        for i in range(len(w) - 19):
            key = tuple(w[i:i + 20])
            if key in before or (d is not None and smallest[key] < d):
                gone.update(range(i, i + 20))
            before.add(key)
        kept = [x for i, x in enumerate(w) if i not in gone]
        out.append((d, len(w), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def engine(df):
    return sorted([(r["doc_id"], r["_tl_words"], r["_tl_removed"], r["_tl_sha256"]) for r in remove_repeated_words(df).collect()], key=str)


@pytest.mark.parametrize("table", ["sf0.001", "sf0.01"])
def test_whole_table_equals_brute_force(spark, table):
    d = f"/root/testdata/{table}"
    rows = [tuple(r) for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted([tuple(r) for r in op11_block_dedup(spark, d).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()], key=str)
    assert got == brute(rows)


def corpus(seed):
    rnd = random.Random(seed)
    parts = [" ".join(rnd.choice(letters) for _ in range(rnd.randint(5, 60)))
             for letters in (list("ab"), list("abcdefgh"), ["é", "x", "yy"], ["a"], [f"w{i}" for i in range(500)]) for _ in range(6)]

    def text():
        return rnd.choice([" ", "\n", "\t "]).join(rnd.choice(parts)[rnd.randint(0, 9):] for _ in range(rnd.randint(0, 6)))

    rows = [(rnd.randint(-5, 40), text()) for _ in range(60)]
    long = parts[-1] + " " + parts[-2] + " " + parts[-3]
    return rows + [(None, long), (None, long + " " + long), (3, None), (4, ""), (50, long * 3), (50, long * 3), (51, "a " * 3000), (2, "a " * 700),
                   (60, "ab a " * 900), (9, " ".join(f"u{i}" for i in range(20))), (8, " ".join(f"u{i}" for i in range(20))),
                   (7, " ".join(f"u{i}" for i in range(19))), (10, "tail " + long)]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_random_texts_equal_brute_force(make_docs, seed, monkeypatch):
    monkeypatch.setattr(shards, "SHARD_BYTES", 700 * seed)
    monkeypatch.setattr(bd, "BUCKET_BYTES", 900)
    rows = corpus(seed)
    assert engine(make_docs(rows)) == brute(rows)


def test_one_shard_equals_brute_force(make_docs):
    rows = corpus(4)
    assert engine(make_docs(rows).coalesce(1)) == brute(rows)


@pytest.mark.parametrize("offset", range(10))
def test_any_alignment_is_found(make_docs, offset):
    """A repeat of exactly one window, at any place against the fixed blocks, is found."""
    passage = " ".join(f"p{i}" for i in range(20))
    rows = [(1, " ".join(f"a{i}" for i in range(offset)) + " " + passage + " z"), (2, "b c d " + passage + " e f")]
    got = {r[0]: r[2] for r in engine(make_docs(rows))}
    assert got == {1: 0, 2: 20}


def test_texts_columns_and_ranges(make_docs):
    passage = " ".join(f"p{i}" for i in range(25))
    docs = make_docs([(1, f"x  {passage}\ny"), (2, f"k\t{passage}  l"), (3, " as it is \n")]).withColumn("shard", F.lit("clash")).withColumn("payload", F.lit(1))
    rows = {r.doc_id: r for r in remove_repeated_words(docs).collect()}
    assert rows[1].text == f"x  {passage}\ny" and rows[2].text == "k l" and rows[3].text == " as it is \n"
    assert [tuple(x) for x in rows[2]._tl_repeats] == [(1, 26)] and rows[1]._tl_repeats == [] and rows[2].shard == "clash"
    assert remove_repeated_words(docs.limit(0)).count() == 0


def test_hot_passage_spreads_over_buckets():
    """Windows of a line that many texts share between other words: a shard sends each once, to all buckets."""
    import pyarrow as pa
    line = " ".join(f"l{i}" for i in range(30))
    rows = pa.table({"doc_id": list(range(200)), "text": [f"n{i} " * 5 + line + f" m{i}" * 5 for i in range(200)]})
    sent = bd._send(0, rows, pa.table({"bucket": pa.array([], pa.int32()), "hits": pa.array([], pa.binary())}), 8)
    n = {b: len(shards.unpack_numbers(p)[0]) for b, _, kept, p in sent if not kept}
    alone = 200 * 2 * 10  # windows that reach into a text's own words
    assert sum(n.values()) <= alone + 11 and len(n) == 8 and max(n.values()) < 2 * sum(n.values()) / 8


def test_numbers_round_trip():
    rng = np.random.default_rng(0)
    cols = [np.sort(rng.integers(0, 1 << 32, 1000)), rng.integers(-(1 << 63), (1 << 63) - 1, 7, endpoint=True), np.zeros(0, np.int64)]
    assert all((a == b).all() for a, b in zip(cols, shards.unpack_numbers(shards.pack_numbers(*cols))))
