"""Entity resolution by substring: alias tables and name directories.

A ``contains`` join is a theta join, which would pair every text with every term.
:func:`substring_join` turns it into an equi-join: every term of length >= 3 is keyed by its
rarest 3-gram, every directory text is exploded into its distinct 3-grams (only those some
term holds are shuffled on), the two meet on the gram, and ``contains`` filters the candidates. It is
exact: a text containing the term contains each of the term's grams. A term of one or two
characters is contained in a text exactly when it equals one of the text's 1- or 2-grams, so
short terms join on those grams directly. No side is broadcast and no pair is enumerated
outside a shared gram.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GRAM = 3


def _grams(c: Column, distinct: bool = True, size: int = GRAM) -> Column:
    n = F.length(c)
    arr = F.transform(F.sequence(F.lit(1), n - size + 1), lambda i: F.substr(c, i, F.lit(size)))
    arr = F.array_distinct(arr) if distinct else arr
    return F.when(n >= size, arr).otherwise(F.array().cast("array<string>"))


def substring_join(terms: DataFrame, term_col: str, directory: DataFrame, text_col: str) -> DataFrame:
    """All (term, directory row) pairs where ``text`` contains ``term`` (both pre-folded).

    ``terms`` is reduced to its distinct non-empty terms first; the result has ``term_col``
    plus every directory column.
    """
    dcols = directory.columns
    t = terms.select(F.col(term_col)).filter(F.length(term_col) > 0).distinct()
    long_t = t.filter(F.length(term_col) >= GRAM)
    t_grams = long_t.select(term_col, F.explode(_grams(F.col(term_col))).alias("_g"))
    # grams that no term holds go no further than the task that made them when the planner can
    # broadcast the term side
    d_grams = (directory.select(*dcols, F.explode(_grams(F.col(text_col))).alias("_g"))
               .join(t_grams.select("_g").distinct(), "_g", "left_semi"))
    freq = d_grams.groupBy("_g").agg(F.count(F.lit(1)).alias("_f"))
    keyed = (t_grams.join(freq, "_g", "left")
             .groupBy(term_col)
             .agg(F.min_by("_g", F.struct(F.coalesce("_f", F.lit(0)), F.col("_g"))).alias("_g")))
    long_pairs = (keyed.join(d_grams, "_g")
                  .filter(F.contains(F.col(text_col), F.col(term_col)))
                  .select(term_col, *dcols))
    short_t = t.filter(F.length(term_col) < GRAM)
    short_grams = F.array_distinct(F.concat(*[_grams(F.col(text_col), False, k) for k in range(1, GRAM)]))
    d_short = directory.select(*dcols, F.explode(short_grams).alias(term_col))
    short_pairs = short_t.join(d_short, term_col).select(term_col, *dcols)
    return long_pairs.unionByName(short_pairs)


def substring_min(terms: DataFrame, term_col: str, directory: DataFrame, id_col: str,
                  text_col: str) -> DataFrame:
    """(term, smallest ``id_col`` among directory rows whose text contains the term).

    Terms of up to three characters are contained exactly when they equal one of the text's
    grams of that length, so the directory is reduced to one row per gram (its smallest id)
    before the join: a common short term meets one row, not every row containing it. Longer
    terms take the rarest-3-gram candidates of :func:`substring_join` and keep the minimum.
    """
    t = terms.select(F.col(term_col)).filter(F.length(term_col) > 0).distinct()
    grams = F.array_distinct(F.concat(*[_grams(F.col(text_col), False, k) for k in range(1, GRAM + 1)]))
    per_gram = (directory.select(F.col(id_col).alias("_id"), F.explode(grams).alias(term_col))
                .groupBy(term_col).agg(F.min("_id").alias(id_col)))
    short = t.filter(F.length(term_col) <= GRAM).join(per_gram, term_col)
    long_t = t.filter(F.length(term_col) > GRAM)
    d = directory.select(F.col(id_col), F.col(text_col))
    long_ = (substring_join(long_t, term_col, d, text_col)
             .groupBy(term_col).agg(F.min(id_col).alias(id_col)))
    return short.unionByName(long_)


def resolve_alias(df: DataFrame, text_col: str, aliases: DataFrame, alias_col: str = "alias",
                  id_col: str = "id", priority_col: str = "priority", out_col: str = "resolved_id",
                  longest_first: bool = True) -> DataFrame:
    """Add the id of the first alias contained in ``lower(text)``; null when none is.

    ``longest_first`` prefers the longest alias (so "wc qualification" beats "world cup"
    inside "uefa world cup qualification"), then the priority; otherwise priority only.
    Distinct texts are resolved once; empty aliases are ignored. Aliases of any number meet the
    texts in the exact gram equi-join of :func:`substring_join`.
    """
    texts = df.select(text_col).distinct().withColumn("_low", F.lower(F.col(text_col)))
    a = (aliases.select(F.lower(F.col(alias_col)).alias("_alias"), F.col(id_col).alias("_id"),
                        F.col(priority_col).alias("_prio"))
         .filter(F.length("_alias") > 0))
    hits = substring_join(a, "_alias", texts, "_low").join(a, "_alias")
    key = ([-F.length("_alias")] if longest_first else []) + [F.col("_prio"), F.col("_alias"), F.col("_id")]
    best = hits.groupBy(text_col).agg(F.min_by("_id", F.struct(*key)).alias(out_col))
    return df.join(best, text_col, "left")


def widening_candidates(text: Column) -> Column:
    """Name attempts in order: full text, text minus its first word, last word.

    The second attempt exists for two or more words, the third for three or more.
    """
    words = F.split(F.trim(text), r"\s+")
    n = F.size(words)
    full = F.struct(F.lit(1).alias("attempt"), F.trim(text).alias("candidate"))
    rest = F.struct(F.lit(2).alias("attempt"), F.array_join(F.slice(words, 2, n), " ").alias("candidate"))
    last = F.struct(F.lit(3).alias("attempt"), F.element_at(words, -1).alias("candidate"))
    return F.filter(F.array(full, F.when(n > 1, rest), F.when(n > 2, last)), lambda x: x.isNotNull())
