import hashlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from test_decontamination import brute as brute_leaks
from test_packing import check as check_packing
from test_quality_rules import brute as brute_rules
from test_simhash_dedup import brute_components, brute_print
from test_suffix_dedup import brute as brute_cut
from touchline.llm.quality_rules import THRESHOLD

import __spark_entry__ as entry


def stages_by_hand(docs, items):
    """(ids after rules, ids after near-dedup, sha of kept bytes by id, ids after decontamination) by brute force."""
    kept = {d for d, base, score in brute_rules(docs) if not base[5] and score >= THRESHOLD}
    docs = [(d, t) for d, t in docs if d in kept]
    roots = brute_components({d: brute_print(t) for d, t in docs})
    docs = [(d, t) for d, t in docs if roots[d] == d]
    return kept, docs, {r[0]: r[4] for r in brute_cut(docs)}


def test_every_stage_equals_brute_force(spark):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{d}/benchmark.parquet").select("item_id", "text").collect()]
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "near_dedup", "suffix_dedup", "decontamination", "packing"]
    kept, unique, cut = stages_by_hand(rows, items)
    out, now = {}, docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = spark.createDataFrame(stage(spark, now, d).collect(), docs.schema)
        assert now.columns == docs.columns
        out[name] = {r.doc_id: r.text for r in now.collect()}
        assert all(r.n_chars == len(r.text) for r in now.collect() if r.text is not None)
    assert set(out["quality_rules"]) == kept
    assert set(out["near_dedup"]) == {i for i, _ in unique}
    whole = {i for i, t in unique if hashlib.sha256(t.encode()).hexdigest() == cut[i]}
    assert set(out["suffix_dedup"]) == set(cut) and all(hashlib.sha256(t.encode()).hexdigest() == cut[i] for i, t in out["suffix_dedup"].items() if i in whole)
    leaks = {i for i, _ in brute_leaks(list(out["suffix_dedup"].items()), items)}
    assert set(out["decontamination"]) == set(out["suffix_dedup"]) - leaks
    check_packing(entry.queries()["pipeline"](spark, d).collect(), list(out["decontamination"].items()))


@pytest.mark.parametrize("empty", [False, True])
def test_edges(make_docs, spark, empty):
    long = " ".join(f"word{i}" for i in range(80))
    rows = [(1, None), (2, ""), (3, long), (3, long), (4, long + " more"), (None, long), (7, "short text")]
    docs = make_docs(rows).withColumn("component_id", F.lit("clash")).withColumn("_tl_home2", F.lit(1))
    if empty:
        docs = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES[1:-1]:
        out = stage(spark, docs, "/root/testdata/sf0.001")
        assert out.columns == docs.columns
        assert out.count() == 0 if empty else out.count() > 3
    assert corpus_pipeline.quality_rules(spark, docs, "").count() == (0 if empty else 4)
    if not empty:
        once = sorted((r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect()), key=str)
        assert once == sorted([1, 3, 7, None], key=str) or once == sorted([1, 3, 4, 7, None], key=str)


def test_different_texts_of_one_id_are_documents_of_their_own(make_docs, spark):
    def text(tag, n=80):
        return " ".join(f"{tag}{i}" for i in range(n))
    rows = [(1, text("a")), (5, text("b")), (5, text("c")), (5, text("c")), (5, text("a")), (8, text("c")), (9, text("d")), (9, text("e"))]
    got = corpus_pipeline.near_dedup(spark, make_docs(rows).repartition(3), "").collect()
    assert sorted((r.doc_id, r.text[0]) for r in got) == [(1, "a"), (5, "b"), (8, "c"), (9, "d"), (9, "e")]
