"""Operator 7, quality rules: hashed n-gram log-likelihood ratio of a trusted target to the raw corpus.

DataFrame functions only. Words and neighbouring pairs hash into ``BUCKETS`` buckets. One pass counts
the buckets over all texts, once for the raw corpus and once for the trusted target: the documents
that break no structural rule (long enough, no mark-up symbols, no doubled lines, no shouting marks).
The counts are ``BUCKETS`` rows whatever the corpus size, and are pre-aggregated before the shuffle.
A second pass, without any shuffle, sums each text's log ratio of the two smoothed multinomials
through a constant array, divides by its number of n-grams and compares with ``THRESHOLD``; base rules on length and
repeated three-word windows come first. Equal texts always get equal verdicts.

Defined results: null text has no words, fails the base rules and scores 0; repeated rows give repeated
rows; an empty table gives no row; the frame's own columns pass through (internal ones start with ``_tl_``).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.llm.common import table
from touchline.operators.derive import with_derived

BUCKETS = 1 << 15
MIN_WORDS, REPEAT_PERCENT = 50, 50
THRESHOLD = -0.08
SPACE, SPACES = " \t\n\x0b\x0c\r", r"[ \t-\r]+"
SYMBOLS = r"[#*$%&|<>]+"


def _grams(h: str, width: int) -> Column:
    """Hash of ``width`` neighbouring words from each place of the array of word hashes ``h``."""
    short = F.slice(h, 1, F.greatest(F.size(h) - (width - 1), F.lit(0)))
    return F.transform(short, lambda x, i: F.xxhash64(x, *[F.get(F.col(h), i + k) for k in range(1, width)]))


def with_words(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` plus ``_tl_words`` and their hashes ``_tl_h``."""
    trimmed = with_derived(docs, _tl_trim=F.btrim(F.coalesce(F.col(text), F.lit("")), F.lit(SPACE)))
    words = F.when(F.col("_tl_trim") == "", F.array().cast("array<string>")).otherwise(F.split("_tl_trim", SPACES))
    out = with_derived(trimmed, _tl_words=words).drop("_tl_trim")
    return with_derived(out, _tl_h=F.transform("_tl_words", lambda w: F.xxhash64(w)))


def duplicate_lines(text: Column) -> Column:
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: x.rlike(r"[^ \t-\r]"))
    return F.transform(F.array(lines), lambda x: F.size(x) - F.size(F.array_distinct(x)))[0]


def repeated_words(windows: str) -> Column:
    """Words inside three-word windows that occur again in the text, from the array of window hashes."""
    w = F.col(windows)
    ranked = F.sort_array(F.transform(w, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

    def covered(s):
        again = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda k: (
            ((k > 0) & (F.get(s, k)["h"] == F.get(s, k - 1)["h"])) |
            ((k < F.size(s) - 1) & (F.get(s, k)["h"] == F.get(s, k + 1)["h"]))))
        spots = F.transform(again, lambda k: F.transform(F.array(F.lit(0), F.lit(1), F.lit(2)), lambda d: F.get(s, k)["i"] + d))
        return F.size(F.array_distinct(F.flatten(spots)))

    heavy = F.transform(F.array(ranked), covered)[0]
    return F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0)).otherwise(heavy)


def buckets_of(h: str) -> Column:
    """Hash buckets of all words and neighbouring pairs."""
    return F.transform(F.concat(F.col(h), _grams(h, 2)), lambda x: F.pmod(x, F.lit(BUCKETS)).cast("int"))


def log_ratios(docs: DataFrame, text: str = "text") -> list[float]:
    """Log ratio (target over raw, add-one smoothed) of each bucket, over all documents."""
    c = F.col(text)
    trusted = (F.size("_tl_words") >= MIN_WORDS) & ~c.rlike(SYMBOLS) & ~c.contains("!!") & (duplicate_lines(c) == 0)
    flagged = with_derived(with_words(docs.select(text), text), _tl_t=F.coalesce(trusted, F.lit(False)).cast("long"),
                           _tl_b=buckets_of("_tl_h")).select("_tl_t", "_tl_b")  # once per text, not per n-gram
    rows = flagged.select(F.col("_tl_t").alias("t"), F.explode("_tl_b").alias("b"))
    counts = rows.groupBy("b").agg(F.count(F.lit(1)).alias("raw"), F.sum("t").alias("target")).collect()  # <= BUCKETS rows
    raw = {r.b: r.raw for r in counts}
    target = {r.b: r.target for r in counts}
    n_raw, n_target = sum(raw.values()) + BUCKETS, sum(target.values()) + BUCKETS
    return [math.log((target.get(b, 0) + 1) / n_target) - math.log((raw.get(b, 0) + 1) / n_raw) for b in range(BUCKETS)]


def judge(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` plus ``_tl_n_words, _tl_word_chars, _tl_n_symbols, _tl_n_dup_lines, _tl_n_repeat_words,
    _tl_base_failed, _tl_score`` (log ratio per n-gram) and ``_tl_kept``."""
    ratios = log_ratios(docs, text)
    weights = F.split(F.lit(",".join(map(repr, ratios))), ",").cast("array<double>")  # folded to one constant
    c = F.coalesce(F.col(text), F.lit(""))
    d = with_derived(with_words(docs, text), _tl_w3=_grams("_tl_h", 3), _tl_b=buckets_of("_tl_h"))
    total = F.aggregate("_tl_b", F.lit(0.0), lambda a, b: a + F.get(weights, b))
    d = with_derived(
        d,
        _tl_n_words=F.size("_tl_words").cast("bigint"),
        _tl_word_chars=F.aggregate("_tl_words", F.lit(0).cast("bigint"), lambda a, w: a + F.length(w)),
        _tl_n_symbols=(F.length(c) - F.length(F.regexp_replace(c, SYMBOLS, ""))).cast("bigint"),
        _tl_n_dup_lines=duplicate_lines(c).cast("bigint"),
        _tl_n_repeat_words=repeated_words("_tl_w3").cast("bigint"),
        _tl_score=F.when(F.size("_tl_b") > 0, total / F.size("_tl_b")).otherwise(F.lit(0.0)),
    ).drop("_tl_words", "_tl_h", "_tl_w3", "_tl_b")
    failed = (F.col("_tl_n_words") < MIN_WORDS) | (100 * F.col("_tl_n_repeat_words") > REPEAT_PERCENT * F.col("_tl_n_words"))
    return d.withColumns({"_tl_base_failed": failed, "_tl_kept": ~failed & (F.col("_tl_score") >= THRESHOLD)})


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = judge(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", *[F.col(f"_tl_{c}").alias(c) for c in (
        "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")])
