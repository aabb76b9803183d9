import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from touchline.llm.packing import op5_packing, pack, solve_patterns

PATH = public_tokenizers.path("word_bpe_49k.json")


def check(rows, texts):
    """Exact round trip: pieces cover each document's ids once; sequences are gapless and fit."""
    tok = Tokenizer.from_file(PATH)
    want = sorted((d, np.array(tok.encode(t or "", add_special_tokens=False).ids + [2], "<u4")) for d, t in texts)
    got, by_seq = {}, {}
    for r in rows:
        got.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    for d, ids in want:
        at = 0
        for r in sorted(got[d], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert zlib.crc32(ids[at:at + r.length].tobytes()) == r.ids_crc32
            at += r.length
        assert at == len(ids)
    padded = 0
    for s in by_seq.values():
        at = 0
        for r in sorted(s, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0
            at += r.length
        assert at <= 4096
        padded += 0 if at & (at - 1) == 0 else 4096 - at
    return padded, sum(r.length for r in rows)


def test_round_trip_and_padding(spark):
    d = "/root/testdata/sf0.01"
    texts = [tuple(r) for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()]
    padded, total = check(op5_packing(spark, d).collect(), texts)
    assert padded < 0.02 * total


@pytest.mark.parametrize("texts", [[(1, None), (2, ""), (3, "word " * 9000), (4, "tie"), (5, "tie"), (6, "x" * 3000)], [(7, None)]])
def test_edges(make_docs, texts):
    check(pack(make_docs(texts).withColumn("class", F.lit(1)), PATH).collect(), texts)


def test_empty_and_repeated_rows(make_docs):
    assert pack(make_docs([(1, "a")]).limit(0), PATH).count() == 0
    rows = pack(make_docs([(1, "a b c"), (1, "a b c")]), PATH).collect()
    assert len(rows) == 2 and sorted(r.offset for r in rows) == [0, rows[0].length]


def test_patterns_cover_demand_near_the_bound():
    rng = np.random.default_rng(0)
    sizes = np.arange(1, 129)
    demand = rng.integers(0, 400, 128) // (1 + sizes // 16)  # small pieces enough to fill every gap
    keep = demand > 0
    out = solve_patterns(sizes[keep], demand[keep], 128)
    assert (sum(p * k for p, k in out) == demand[keep]).all()
    assert all((p * sizes[keep]).sum() <= 128 for p, _ in out)
    assert sum(k for _, k in out) <= (sizes[keep] * demand[keep]).sum() / 128 * 1.01 + 3
