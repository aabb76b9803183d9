import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from touchline.llm.common import crc_mod
from touchline.llm.quality_classifier import FEATURES, Discriminant, op3_quality_classifier, score_quality, statistics

LABELS = "doc_id bigint, quality int, toxic int"


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.1"
    got = op3_quality_classifier(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").where("held_out").collect()
    assert sum(r.predicted == r.quality for r in got) >= 0.98 * len(got)
    assert {r.predicted for r in got} == {0, 1} and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)


def test_difference_equals_the_formula():
    rng = np.random.default_rng(0)
    m = len(FEATURES)
    x = {0: rng.normal(0, 2, (300, m)), 1: rng.normal(1, 1, (700, m)) @ rng.normal(0, 1, (m, m))}
    model = Discriminant({k: (len(v), v.sum(axis=0), v.T @ v) for k, v in x.items()}, shrink=0.3, ridge=1e-2)
    both = np.concatenate([x[0], x[1]])
    mean, scale = both.mean(axis=0), both.std(axis=0)
    z = {k: (v - mean) / scale for k, v in x.items()}
    cov = {k: np.cov(v.T, bias=True) for k, v in z.items()}
    pooled = np.diag((300 * np.diag(cov[0]) + 700 * np.diag(cov[1])) / 1000)

    def log_density(v, k):
        c = 0.7 * cov[k] + 0.3 * pooled + 1e-2 * np.eye(m)
        r = v - z[k].mean(axis=0)
        return math.log(len(z[k]) / 1000) - 0.5 * r @ np.linalg.solve(c, r) - 0.5 * np.linalg.slogdet(c)[1]

    probe = rng.normal(0, 1.5, (20, m))
    want = [log_density((p - mean) / scale, 1) - log_density((p - mean) / scale, 0) for p in probe]
    assert model.difference(probe) == pytest.approx(want, rel=1e-6)


def test_labels_of_the_held_out_fold_change_nothing(spark):
    d = "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    flipped = labels.withColumn("quality", F.when(crc_mod("doc_id", 4) == 2, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = ({r.doc_id: r.score for r in score_quality(docs, x).collect()} for x in (labels, flipped))
    assert a.keys() == b.keys() and all(a[k] == pytest.approx(b[k], abs=1e-9) for k in a)


def test_edges(make_docs, spark):
    rows = [(1, None), (2, ""), (3, "Some plain words here."), (3, "Some plain words here."), (None, "x"), (5, "word " * 50000)]
    docs = make_docs(rows).withColumn("x", F.lit("clash"))
    for labels in ([], [(3, 1, 0), (None, 1, 0), (2, None, None)], [(i, i % 2, 0) for i in range(1, 6)]):
        got = score_quality(docs, spark.createDataFrame(labels, LABELS)).collect()
        assert len(got) == 6 and all(0 <= r.score <= 1 for r in got)
    assert score_quality(docs.limit(0), spark.createDataFrame([], LABELS)).count() == 0
    assert len(statistics(b"")) == len(FEATURES) == len(statistics(b"a # b"))
