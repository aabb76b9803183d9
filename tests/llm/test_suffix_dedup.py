import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import touchline.llm.suffix_dedup as sd
from touchline.llm.suffix_dedup import multikey_groups, op4_suffix_dedup, remove_repeats


def brute(rows):
    """doc -> (n_bytes, n_removed, n_spans, sha) per row, by listing every 50-byte string."""
    raw = [(d, (t or "").encode()) for d, t in rows]
    first = {}
    for d, t in raw:
        if d is not None:
            for i in range(len(t) - 49):
                w = t[i:i + 50]
                first[w] = min(d, first.get(w, d))
    out = []
    for d, t in raw:
        gone = np.zeros(len(t) + 1, bool)
        for i in range(len(t) - 49):
            if d is not None and first[t[i:i + 50]] < d:
                gone[i:i + 50] = True
        kept = bytes(np.frombuffer(t, np.uint8)[~gone[:-1]])
        spans = int((gone[:-1] & ~np.concatenate([[False], gone[:-1]])[:len(t)]).sum())
        out.append((d, len(t), len(t) - len(kept), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def engine(df):
    out = remove_repeats(df)
    return sorted([(r["doc_id"], r["_tl_bytes"], r["_tl_removed"], r["_tl_spans"], r["_tl_sha256"]) for r in out.collect()], key=str)


def test_whole_table_equals_brute_force(spark):
    d = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted([tuple(r) for r in op4_suffix_dedup(spark, d).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()], key=str)
    assert got == brute(rows)


def corpus(seed):
    rnd = random.Random(seed)
    parts = ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(30, 200)))
             for alphabet in ("ab", "abcdefgh ", "é x", "a") for _ in range(6)]
    rows = [(rnd.randint(-5, 40), "".join(rnd.choice(parts)[rnd.randint(0, 20):] for _ in range(rnd.randint(0, 6)))) for _ in range(60)]
    return rows + [(None, parts[0]), (3, None), (4, ""), (50, parts[1] * 3), (50, parts[1] * 3), (51, "a" * 3000), (2, "a" * 700), (60, "ab" * 900)]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_random_texts_equal_brute_force(make_docs, seed):
    rows = corpus(seed)
    assert engine(make_docs(rows)) == brute(rows)


def test_segments_give_the_same_anchors(monkeypatch):
    rnd = random.Random(5)
    buf = "".join(rnd.choice("abc ") for _ in range(5000)).encode()
    starts, ends = np.array([0, 1200, 1230]), np.array([1200, 1230, 5000])

    def windows():
        return [(s, a, h) for a, lo, hi, h in zip(*(c.tolist() for c in sd.anchor_runs(buf, starts, ends))) for s in range(lo, hi + 1)]

    whole = windows()
    monkeypatch.setattr(sd, "SEGMENT", 333)
    assert windows() == whole and len(whole) == (1200 - 49) + (3770 - 49)


def test_multikey_groups():
    rng = np.random.default_rng(0)
    k = rng.integers(0, 3, (3, 500)).astype(np.uint64)
    order, group = multikey_groups([lambda i, r=r: r[i] for r in k], 500)
    same = (k[:, order][:, :, None] == k[:, order][:, None, :]).all(axis=0)
    assert ((group[:, None] == group[None, :]) == same).all()


def test_columns_and_empty_table(make_docs):
    text = "x" * 10 + "".join(map(chr, range(97, 123))) * 4
    docs = make_docs([(1, text), (2, text + "é" * 30)]).withColumn("payload", F.lit("clash")).withColumn("home", F.lit(1))
    rows = {r.doc_id: r for r in remove_repeats(docs).collect()}
    assert rows[1].text == text and rows[2].text == "é" * 30 and rows[2].payload == "clash"
    assert remove_repeats(docs.limit(0)).count() == 0


def footers(n):
    """Texts that share a line of 20 bytes, each time between other bytes; a few are whole copies."""
    rnd = random.Random(11)
    line = "=== all rights r ==="

    def noise():
        return "".join(rnd.choice("abcdefghijklmnop") for _ in range(60))

    rows = [(i, noise() + line + noise()) for i in range(n)]
    return rows + [(n + i, "copy " + rows[i][1]) for i in range(5)]


def test_windows_of_a_hot_anchor_spread_over_buckets():
    import pyarrow as pa
    import zstandard
    rows = footers(300)
    table = pa.table({"doc_id": [d for d, _ in rows], "text": [t for _, t in rows], sd._HOME: [0] * len(rows)})
    home = sd.Home(table)
    lead, n = np.unique(sd.Words(home.buf).at(home.anchors()[0], ">"), return_counts=True)
    hot = np.repeat(lead[n == n.max()][:1], 2)
    assert n.max() > 20
    sent = sd._send(table, sd._frame([], sd._ASK), 8, hot)
    count = {}
    for b, decided, payload in zip(*(sent.column(c).to_pylist() for c in ("bucket", "decided", "payload"))):
        if not decided:
            count[b] = count.get(b, 0) + int(np.frombuffer(zstandard.decompress(payload), "<u4", 1)[0])
    assert len(count) == 8  # by range alone: two


def test_hot_anchors_equal_brute_force(make_docs, monkeypatch):
    rows = footers(300)
    buf = "".join(t for _, t in rows).encode()
    p, _, _, _ = sd.anchor_runs(buf, np.array([0]), np.array([len(buf)]))
    lead, n = np.unique(sd.Words(buf).at(p, ">"), return_counts=True)
    monkeypatch.setattr(sd, "sample_splitters", lambda *a: np.repeat(lead[n > 5], 2))
    assert (n > 5).sum() > 1
    assert engine(make_docs(rows)) == brute(rows)


def test_only_frequent_leads_repeat_however_many_buckets(make_docs, monkeypatch):
    rnd = random.Random(11)
    rows = [(i, "".join(rnd.choice("abcdefghij klm") for _ in range(400))) for i in range(150)]
    rows += [(200 + i, rows[i][1][:60 + i] + "z" * 70) for i in range(40)]
    docs = make_docs(rows)
    total = sum(len(t) for _, t in rows)
    monkeypatch.setattr(sd, "SAMPLE_BYTES", 1000)
    few = sd.sample_splitters(docs, total, 3)  # the sample grows with the buckets: all texts are asked here
    many = sd.sample_splitters(docs, total, 5000)
    assert len(few) == 2 < len(many) < 5000
    lead, n = np.unique(many, return_counts=True)
    buf = "".join(t for _, t in rows).encode()
    p, _, _, _ = sd.anchor_runs(buf, np.array([0]), np.array([len(buf)]))
    seen = dict(zip(*(a.tolist() for a in np.unique(sd.Words(buf).at(p, ">"), return_counts=True))))
    assert all(seen[x] >= sd.LEADS_PER_BUCKET for x in lead[n > 1].tolist())
    monkeypatch.setattr(sd, "HOME_BYTES", 2000)
    assert engine(docs) == brute(rows)


def test_answers_of_many_groups_take_the_time_of_few():
    """A hash bucket holds as many anchors however many groups ask; its work must not grow with their number."""
    import time
    rng = np.random.default_rng(3)

    def asked(groups):
        each = [np.unique(rng.integers(0, 300_000, 200_000 // groups)).astype("<u4") for _ in range(groups)]
        return each, sd._frame([(7, h, a.tobytes()) for h, a in enumerate(each)], sd._ASK)

    took = {}
    for groups in (20, 2000):
        each, rows = asked(groups)
        began = time.process_time()
        got = sd._answer(rows)
        took[groups] = time.process_time() - began
        value, n = np.unique(np.concatenate(each), return_counts=True)
        again = set(value[n > 1].tolist())
        assert got.column("home").to_pylist() == list(range(groups)) and set(got.column("bucket").to_pylist()) == {7}
        for a, bits in zip(each, got.column("payload").to_pylist()):
            assert np.unpackbits(np.frombuffer(bits, np.uint8), count=len(a)).tolist() == [x in again for x in a.tolist()]
    assert took[2000] < 5 * took[20] + 0.5


def test_sending_to_many_buckets_works_once_over_a_group():
    """With more buckets a group sends more rows, but must not go over all its suffixes for each of them."""
    import time

    import pyarrow as pa
    import zstandard
    rnd = random.Random(5)
    words = ["".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rnd.randint(2, 9))) for _ in range(3000)]
    rows = [(i, " ".join(rnd.choice(words) for _ in range(4000))) for i in range(120)]
    table = pa.table({"doc_id": [d for d, _ in rows], "text": [t for _, t in rows], sd._HOME: [3] * len(rows)})
    home = sd.Home(table)
    p, lo, hi, _, _ = home.anchors()
    lead = np.unique(sd.Words(home.buf).at(p, ">"))
    took, sent = {}, {}
    for buckets in (20, 20_000):
        asked = sd._ask(table, buckets)
        answers = sd._frame([(r["bucket"], r["home"], np.packbits(np.ones(len(r["payload"]) // 4, bool)).tobytes()) for r in asked.to_pylist()], sd._ASK)
        splitters = lead[np.arange(1, buckets) * len(lead) // buckets]
        began = time.process_time()
        out = sd._send(table, answers, buckets, splitters)
        took[buckets] = time.process_time() - began
        got = []
        for payload in out.column("payload").to_pylist():
            raw = zstandard.decompress(payload)
            n = int(np.frombuffer(raw, "<u4", 1)[0])
            got += zip(*(np.frombuffer(raw, t, n, 4 + n * o).tolist() for t, o in (("<i8", 0), ("<u4", 8), ("<u4", 12), ("u1", 16))))
        sent[buckets] = sorted(got)
    row = np.searchsorted(home.ends, lo, "right")
    assert sent[20] == sent[20_000] == sorted(zip(row.tolist(), row.tolist(), (lo - home.starts[row]).tolist(), (hi - lo + 1).tolist()))
    assert took[20_000] < 3 * took[20] + 2
