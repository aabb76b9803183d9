import math
import re
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F

from touchline.llm.quality_rules import BUCKETS, THRESHOLD, judge, op7_quality_rules

COLS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]


def signed(v):
    return v - (1 << 64) if v >> 63 else v


def chain(hashes):
    """Hash of several longs, each seeded with the hash of those before it."""
    seed = 42
    for h in hashes:
        seed = xxhash.xxh64_intdigest((h % (1 << 64)).to_bytes(8, "little"), seed)
    return seed


def brute(rows):
    seen, raw, target, parts = [], Counter(), Counter(), []
    for d, t in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in w]
        grams = [x % (1 << 64) for x in h] + [chain(h[i:i + 2]) for i in range(len(h) - 1)]
        b = [signed(g) % BUCKETS for g in grams]
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        dup = len(lines) - len(set(lines))
        tri = [tuple(w[i:i + 3]) for i in range(len(w) - 2)]
        many = Counter(tri)
        rep = {i + k for i, x in enumerate(tri) if many[x] > 1 for k in range(3)}
        n_sym = sum(c in "#*$%&|<>" for c in t)
        failed = len(w) < 50 or 100 * len(rep) > 50 * len(w)
        raw.update(b)
        if len(w) >= 50 and not n_sym and "!!" not in t and not dup:
            target.update(b)
        parts.append((d, b, (len(w), sum(map(len, w)), n_sym, dup, len(rep), failed)))
    nr, nt = sum(raw.values()) + BUCKETS, sum(target.values()) + BUCKETS
    for d, b, base in parts:
        score = sum(math.log((target[x] + 1) / nt) - math.log((raw[x] + 1) / nr) for x in b) / len(b) if b else 0.0
        seen.append((d, base, score))
    return seen


def test_whole_table_equals_brute_force(spark):
    d = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()]
    got = {r.doc_id: r for r in op7_quality_rules(spark, d).collect()}
    assert len(got) == len(rows)
    for doc, base, score in brute(rows):
        r = got[doc]
        assert tuple(r[c] for c in COLS[:6]) == base
        assert r.score == pytest.approx(score, abs=1e-9)
        assert r.kept == (not base[5] and r.score >= THRESHOLD)


def test_labelled_documents(spark):
    """Every labelled good document that passes the base rules is kept; no bad one is."""
    d = "/root/testdata/sf0.1"
    j = op7_quality_rules(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").where("not base_failed")
    got = {(r.quality, r.kept): r["count"] for r in j.groupBy("quality", "kept").count().collect()}
    assert got.get((1, True), 0) > 100 and not got.get((1, False)) and not got.get((0, True))


def test_edges(make_docs):
    long = " ".join(f"w{i}" for i in range(60))
    rows = [(1, None), (2, ""), (3, " \t\n\x0b\x0c\r "), (4, "a b c a b c"), (5, "l\nl\n\n \n l"), (6, long), (6, long), (None, "é|# x"), (7, "\x1ca\x85b c")]
    got = sorted([tuple(r[f"_tl_{c}"] for c in COLS) for r in judge(make_docs(rows).withColumn("n_words", F.lit("clash"))).collect()])
    want = sorted([(*base, not base[5] and score >= THRESHOLD) for _, base, score in brute(rows)])
    assert got == want
    assert judge(make_docs(rows).limit(0)).count() == 0


def test_no_python_in_the_plan(spark):
    plan = op7_quality_rules(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan) and "Exchange" not in plan
