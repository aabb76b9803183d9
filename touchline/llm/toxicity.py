"""Operator 6, toxicity: a weighted finite-state grammar scores the clauses it matches.

Five transducers read a clause's words. The lexical one maps a word to a class (insult, threat, target,
negation, reporting, quotation mark) and, for insults and threats, a weight; insult weights are learned:
log odds of a word or word beginning between toxic and other training documents. Three context transducers
keep what was said before (a target, a negation, reported speech) and scale what follows;
``compose`` makes one machine of them. A clause scores the sum of its scaled weights, a document the
clauses' total, best, number and density, put through a logistic curve.

Learning reads a bounded sample (``PER_CLASS`` training documents of each label). The curve is fitted on
halves scored with the other half's lexicon, so that words seen by chance do not flatter it. Every
whole text is scored.

Defined results: null or empty text has no clause and scores the curve's intercept; rows without a usable
label or with a null id are not learned from; without both labels only the built-in words count and the curve is flat;
repeated rows are scored each; an empty table gives no row; only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.llm.common import checkpointed, crc_mod, importable, table
from touchline.llm.labelled import fit_logistic, sample_documents, sigmoid, training_labels

MOD, HELD, CUT = 3, 1, 0.7
#: Training documents of each label, at most.
PER_CLASS = 8000
#: A word or beginning counts from this many toxic training texts on, whatever the size of the sample.
LEAST_DOCS = 3
BEGINNINGS = (3, 4, 5, 6, 7, 8)
#: Log odds above which a feature is an insult (four sightings and none elsewhere reach it, three don't), and the most that one word counts.
LEAST_WEIGHT, MOST_WEIGHT = 2.0, 6.0
CACHE_WORDS = 400_000

NONE, END, INSULT, THREAT, TARGET, NEGATION, REPORT, QUOTE = range(8)
_TOKEN = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?|[.!?;:\n]|[\"“”«»„]")
_CLAUSE_ENDS = frozenset(".!?;:\n")

#: Built-in words of the lexical transducer.
WORDS = {
    THREAT: "kill murder hurt destroy beat stab shoot burn hang crush töten umbringen schlagen tuer frapper matar golpear".split(),
    TARGET: """you your yours yourself u he him she her they them their these those people everyone du dich dir ihr euch sie er tu toi vous te
        votre il elle ils elles tú ti usted ustedes vosotros él ella ellos""".split(),
    NEGATION: "not no never isn't aren't don't won't wasn't cannot can't nicht kein keine nie niemals pas jamais ne nunca jamás ningún".split(),
    REPORT: """said says say called calls wrote quoted claimed reported according tweeted sagte sagt nannte laut dit déclaré appelé selon dijo dice
        llamó según""".split(),
    QUOTE: list("\"“”«»„"),
}
BUILT_IN_INSULT, THREAT_WEIGHT = 2.5, 3.0
INSULTS = "idiot moron stupid scum trash worthless pathetic loser clown disgusting".split()


class Transducer:
    """Deterministic weighted transducer on word classes: ``move(state, cls)`` gives (state, factor)."""

    def __init__(self, states: int, move):
        self.states = states
        self.table = [[move(s, c) for c in range(8)] for s in range(states)]


def compose(a: Transducer, b: Transducer) -> Transducer:
    """Both machines reading the same classes; their factors multiply."""
    def move(s, c):
        (i, f), (j, g) = a.table[s // b.states][c], b.table[s % b.states][c]
        return i * b.states + j, f * g

    return Transducer(a.states * b.states, move)


def _fading(opens: int, width: int, scale: dict[int, float], without: dict[int, float]):
    """State counts down the words for which a word of class ``opens`` still scales others."""
    def move(s, c):
        factor = (scale if s else without).get(c, 1.0)
        return (width if c == opens else 0 if c == END else max(0, s - 1)), factor

    return Transducer(width + 1, move)


#: A target close before raises an insult; a threat without one counts little.
TARGETED = _fading(TARGET, 6, {INSULT: 1.5, THREAT: 1.5}, {THREAT: 0.1})
NEGATED = _fading(NEGATION, 3, {INSULT: 0.4, THREAT: 0.2}, {})
REPORTED = _fading(REPORT, 8, {INSULT: 0.5, THREAT: 0.4}, {})
QUOTED = Transducer(2, lambda s, c: ((0 if c == END else 1 - s if c == QUOTE else s), 0.6 if s and c in (INSULT, THREAT) else 1.0))
GRAMMAR = compose(compose(compose(TARGETED, NEGATED), REPORTED), QUOTED)


class Lexicon(dict):
    """Lexical transducer: word to (class, weight), remembered for at most ``CACHE_WORDS`` words."""

    def __init__(self, learned: dict[str, float]):
        super().__init__()
        self.learned = learned
        self.fixed = {w: (c, THREAT_WEIGHT if c == THREAT else 0.0) for c, ws in WORDS.items() for w in ws}
        self.fixed |= {w: (INSULT, BUILT_IN_INSULT) for w in INSULTS}
        self.fixed |= {w: (END, 0.0) for w in _CLAUSE_ENDS}

    def __missing__(self, word):
        cls, weight = self.fixed.get(word, (NONE, 0.0))
        best = max((self.learned.get(f, 0.0) for f in features(word)), default=0.0)
        if best > weight and cls in (NONE, INSULT, THREAT):
            cls, weight = (cls or INSULT), best
        if len(self) >= CACHE_WORDS:
            self.clear()
        self[word] = out = (cls, weight)
        return out


def features(word: str) -> list[str]:
    """The word itself and its beginnings (marked ``*``)."""
    return [word, *(word[:k] + "*" for k in BEGINNINGS if len(word) > k)]


def clauses(tokens: list[str], lexicon: Lexicon) -> list[float]:
    """Scores of the clauses that hold an insult or threat, by the composed machine."""
    read = list(map(lexicon.__getitem__, tokens))
    hits = [i for i, (c, _) in enumerate(read) if c == INSULT or c == THREAT]
    out, after = [], -1
    for i in hits:
        if i < after:
            continue
        start = i
        while start > 0 and read[start - 1][0] != END:
            start -= 1
        state, total, k = 0, 0.0, start
        while k < len(read) and read[k][0] != END:
            c, w = read[k]
            state, factor = GRAMMAR.table[state][c]
            total += w * factor
            k += 1
        after = k
        out.append(total)
    return out


def evidence(text: str, lexicon: Lexicon) -> list[float]:
    """What the curve sees: total, best clause, number of matched clauses, density."""
    tokens = _TOKEN.findall(text.lower())
    scores = clauses(tokens, lexicon) if tokens else []
    if not scores:
        return [0.0, 0.0, 0.0, 0.0]
    total = sum(scores)
    return [math.log1p(total), max(scores) / MOST_WEIGHT, math.log1p(len(scores)), min(1.0, total / len(tokens))]


def _count(rows: DataFrame) -> DataFrame:
    """Per feature, the documents with it of each label and half: ``f, a0, a1`` (toxic) and ``b0, b1`` (other)."""
    def run(batches):
        for b in batches:
            found: Counter = Counter()
            for half, y, text in zip(*(b.column(i).to_pylist() for i in range(3))):
                found.update((f, half, y) for f in {f for w in set(_TOKEN.findall((text or "").lower())) for f in features(w)})
            cols = list(zip(*((*k, n) for k, n in found.items()))) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int32()),
                                              pa.array(cols[3], pa.int64())], names=["f", "half", "y", "n"])

    each = [F.sum(F.when((F.col("y") == y) & (F.col("half") == half), F.col("n")).otherwise(0)).alias(f"{name}{half}")
            for name, y in (("a", 1), ("b", 0)) for half in (0, 1)]
    return rows.select("half", "y", "text").mapInArrow(run, "f string, half int, y int, n bigint").groupBy("f").agg(*each)


def _clear(halves: tuple[int, ...], sizes: dict):
    """(weight, whether it counts) of a feature over the given halves: log odds less what few sightings leave open."""
    toxic, other = (sum(sizes.get((h, y), 0) for h in halves) for y in (1, 0))
    a, b = (sum((F.col(f"{name}{h}") for h in halves), F.lit(0)) for name in "ab")
    sure = F.log((a + 0.25) / (toxic + 0.5)) - F.log((b + 0.25) / (other + 0.5)) - 1.5 / F.sqrt(a + 0.25)
    return F.least(sure, F.lit(MOST_WEIGHT)), (a >= LEAST_DOCS - (len(halves) < 2)) & (sure >= LEAST_WEIGHT)


def learn_weights(counts: DataFrame, sizes: dict) -> list[dict[str, float]]:
    """Weights of the features that speak clearly for toxicity: by half 0, by half 1, by both."""
    found = [_clear(h, sizes) for h in ((0,), (1,), (0, 1))]
    clear = counts.select("f", *(F.when(ok, w).alias(f"w{i}") for i, (w, ok) in enumerate(found))).where("coalesce(w0, w1, w2) is not null").collect()
    return [{r.f: r[i + 1] for r in clear if r[i + 1] is not None} for i in range(3)]


def learn(sample: DataFrame) -> tuple[dict[str, float], np.ndarray]:
    """(lexicon weights, curve) from a bounded sample ``half, y, text``."""
    spark = sample.sparkSession
    sizes = {(r.half, r.y): r["count"] for r in sample.groupBy("half", "y").count().collect()}
    by_first, by_second, by_both = learn_weights(_count(sample), sizes)
    lexicons = spark.sparkContext.broadcast([by_second, by_first])

    def run(batches):
        made = [Lexicon(w) for w in lexicons.value]
        for b in batches:
            got = [(y, *evidence(t or "", made[h])) for h, y, t in zip(*(b.column(i).to_pylist() for i in range(3)))]
            cols = list(zip(*got)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), *(pa.array(c, pa.float64()) for c in cols[1:])],
                                             names=["y", "a", "b", "c", "d"])

    seen = sample.select("half", "y", "text").mapInArrow(run, "y int, a double, b double, c double, d double").toPandas().to_numpy(float)
    return by_both, fit_logistic(seen[:, 1:], seen[:, 0], ridge=0.05)


def score_toxicity(docs: DataFrame, labels: DataFrame, mod: int = MOD, held: int = HELD, cut: float = CUT, per_class: int = PER_CLASS) -> DataFrame:
    """``doc_id, held_out, score, predicted, clauses`` (matched clauses) of every document."""
    spark = importable(docs).sparkSession
    sample = checkpointed(sample_documents(docs, training_labels(labels, "toxic", mod, held), per_class).select(
        F.pmod(F.xxhash64("doc_id"), F.lit(2)).cast("int").alias("half"), "y", "text"))
    weights, curve = learn(sample)
    model = spark.sparkContext.broadcast((weights, curve))  # features of several toxic texts of the bounded sample

    def run(batches):
        lexicon, b_ = Lexicon(model.value[0]), model.value[1]
        for b in batches:
            x = np.array([evidence(t or "", lexicon) for t in b.column(1).to_pylist()], float).reshape(-1, 4)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sigmoid(x @ b_[:-1] + b_[-1])), pa.array(np.round(np.expm1(x[:, 2])).astype(np.int64))],
                                             names=["doc_id", "score", "clauses"])

    scored = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, "doc_id bigint, score double, clauses bigint")
    return scored.select("doc_id", (crc_mod("doc_id", mod) == held).alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"), "clauses")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
