import itertools
import math

import pytest
from pyspark.sql import functions as F

from touchline.llm.common import crc_mod
from touchline.llm.toxicity import (END, GRAMMAR, INSULT, NEGATED, QUOTED, REPORTED, TARGETED, Lexicon, clauses, evidence,
                                    learn, op6_toxicity, score_toxicity, _TOKEN)

LABELS = "doc_id bigint, quality int, toxic int"


def total(text, learned=None):
    return sum(clauses(_TOKEN.findall(text.lower()), Lexicon(learned or {})))


def test_composed_machine_equals_its_parts():
    for path in itertools.product(range(8), repeat=3):
        parts, state = [0, 0, 0, 0], 0
        for c in (*path, INSULT, 3):
            state, factor = GRAMMAR.table[state][c]
            want = 1.0
            for i, t in enumerate((TARGETED, NEGATED, REPORTED, QUOTED)):
                parts[i], f = t.table[parts[i]][c]
                want *= f
            assert factor == pytest.approx(want)


def test_clauses_not_isolated_words():
    plain = total("an idiot here.")
    assert plain > 0
    assert total("you are an idiot.") > plain
    assert total("you are not an idiot.") < total("you are an idiot.")
    assert total("he said someone is an idiot.") < total("he is an idiot.")
    assert total("he wrote. someone is an idiot.") == plain  # the report ends with its clause
    assert total("i will kill you.") < 1 < total("you, i will kill.")
    assert total("nothing to see. all fine here") == 0
    assert total("the “idiot” word.") < plain
    assert total("grobian here.", {"grob*": 4.0}) == 4.0


def test_held_out_labels(spark):
    d = "/root/testdata/sf0.1"
    got = op6_toxicity(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").where("held_out").collect()
    toxic = [r.predicted for r in got if r.toxic == 1]
    assert sum(toxic) >= 0.8 * len(toxic)
    assert sum(r.predicted for r in got if r.toxic == 0) <= 0.005 * len(got)


def test_labels_of_the_held_out_fold_change_nothing(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    flipped = labels.withColumn("toxic", F.when(crc_mod("doc_id", 3) == 1, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = ({r.doc_id: r.score for r in score_toxicity(docs, x).collect()} for x in (labels, flipped))
    assert a.keys() == b.keys() and all(a[k] == pytest.approx(b[k], abs=1e-6) for k in a)


def test_edges(make_docs, spark):
    rows = [(1, None), (2, ""), (3, "you idiot"), (3, "you idiot"), (None, "x"), (5, "word " * 30000 + "scum.")]
    docs = make_docs(rows).withColumn("score", F.lit("clash"))
    for labels in ([], [(3, 1, 1), (None, 1, 0), (2, None, None)], [(i, 1, i % 2) for i in range(1, 6)]):
        got = score_toxicity(docs, spark.createDataFrame(labels, LABELS)).collect()
        assert len(got) == 6 and all(0 <= r.score <= 1 for r in got)
        assert {r.clauses for r in got if r.doc_id in (3, 5)} == {1}
    assert score_toxicity(docs.limit(0), spark.createDataFrame([], LABELS)).count() == 0
    assert evidence("", Lexicon({})) == [0.0] * 4 and END == 1


def test_a_repeated_labelled_id_is_one_row_of_the_sample(spark):
    from touchline.llm.labelled import sample_documents
    docs = spark.range(3000).selectExpr("case when id < 2900 then 7 else id end as doc_id", "concat('text ', id) as text")
    training = spark.createDataFrame([(7, 1), (7, 1), (2950, 0), (2951, 0), (2952, 0)], "doc_id bigint, y int")
    got = sample_documents(docs, training, 2).collect()
    assert sorted((r.y, r.doc_id == 7) for r in got) == [(0, False), (0, False), (1, True)]
    assert [r.text for r in got if r.y == 1] == ["text 0"]


def brute_weights(rows):
    """Log odds less 1.5 deviations of every word and beginning, from lists of all texts."""
    toxic = [features_of(t) for _, y, t in rows if y == 1]
    other = [features_of(t) for _, y, t in rows if y == 0]
    out = {}
    for f in set().union(*toxic):
        a, b = sum(f in t for t in toxic), sum(f in t for t in other)
        weight = math.log((a + 0.25) / (len(toxic) + 0.5) * (len(other) + 0.5) / (b + 0.25)) - 1.5 / math.sqrt(a + 0.25)
        if a >= 3 and weight >= 2.0:
            out[f] = min(6.0, weight)
    return out


def features_of(text):
    return {w[:k] + "*" for w in text.split() for k in range(3, 9) if len(w) > k} | set(text.split())


def test_weights_equal_brute_force_and_rare_insults_count_in_large_samples(spark):
    # 5 of 2000 toxic texts hold the rare insult: 0.25 % of them, and none of the others
    rows = [(i % 2, 1, f"grobian says word{i % 17} here" if i % 4 else f"word{i % 13} alone") for i in range(1995)]
    rows += [(i % 2, 1, "schurke stands there") for i in range(5)] + [(i % 2, 0, f"word{i % 17} says here alone") for i in range(2000)]
    got, _ = learn(spark.createDataFrame(rows, "half int, y int, text string").repartition(5))
    want = {f: w for f, w in brute_weights(rows).items()}
    assert got.keys() == want.keys() and all(got[f] == pytest.approx(want[f], abs=1e-9) for f in want)
    assert "schurke" in got and "grobian" in got and "says" not in got
