"""A kept index of names by gram, for finding the names that hold a term without a pass over all names.

Three tables of a store: the ``names`` themselves (bucketed by id), the ``grams`` (1 to 3 characters) that each
name holds (bucketed by gram), and a row per gram with its number of names and their smallest id. A term of up to
three characters is one row of the counts; a longer one takes the rows of its rarest 3-gram and tests
``contains`` on those only. An update rewrites the buckets of the grams that the changed names had or have.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.operators.resolve import GRAM, _grams
from touchline.sinks.store import Commit, Snapshot

NAMES, GRAMS, COUNTS = "name_index", "name_index_grams", "name_index_counts"


def has_names(tables: Snapshot) -> bool:
    return NAMES in tables.tables


def _held(names: DataFrame) -> DataFrame:
    """(gram, id, text) of every gram that a name holds."""
    sizes = F.array_distinct(F.concat(*[_grams(F.col("text"), False, k) for k in range(1, GRAM + 1)]))
    return names.select(F.explode(sizes).alias("gram"), "id", "text")


def _counted(grams: DataFrame) -> DataFrame:
    return grams.groupBy("gram").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("least"))


def build_names(c: Commit, names: DataFrame, buckets: int = 64) -> None:
    """Index of distinct ``id, text`` rows (an id may have several texts)."""
    c.append(NAMES, names, ["id"], buckets)
    c.append(GRAMS, _held(c.read(NAMES)), ["gram"], buckets)
    c.append(COUNTS, _counted(c.read(GRAMS)), ["gram"], buckets)


def update_names(c: Commit, changed: DataFrame) -> None:
    """``changed``: all rows (``id, text``) that the changed ids have now; a null text removes an id."""
    ids = changed.select("id").distinct()
    old = _held(c.read(NAMES).join(ids, "id", "left_semi"))
    new = _held(changed.filter(F.col("text").isNotNull()))
    gone = old.join(new, ["gram", "id", "text"], "left_anti").select("gram", "id", F.lit(None).cast("string").alias("text"))
    grams = new.unionByName(gone).checkpoint(eager=True)  # read from the old names before these change
    c.replace_keys(NAMES, changed, ["id"], only_delete=F.col("text").isNull())
    c.replace_keys(GRAMS, grams, ["gram", "id"], only_delete=F.col("text").isNull())
    touched = grams.select("gram").distinct()
    counts = touched.join(_counted(c.read(GRAMS).join(touched, "gram", "left_semi")), "gram", "left")
    c.replace_keys(COUNTS, counts, ["gram"], only_delete=F.col("n").isNull())


def probe_names(terms: DataFrame, term_col: str, index: Snapshot) -> DataFrame:
    """Each distinct term that some name holds, and the smallest ``id`` of those names."""
    t = terms.select(F.col(term_col)).filter(F.length(term_col) > 0).distinct()
    short = F.length(term_col) <= GRAM
    keys = t.select(term_col, F.explode(F.when(short, F.array(term_col)).otherwise(_grams(F.col(term_col)))).alias("gram"))
    # a term with a gram that no name holds is in none
    found = keys.join(index.read(COUNTS), "gram", "left").groupBy(term_col).agg(
        F.min_by("gram", F.struct("n", "gram")).alias("gram"), F.min("least").alias("least"), F.count_if(F.col("n").isNull()).alias("missing"))
    found = found.filter("missing = 0").select(term_col, F.when(short, F.col("least")).alias("least"), F.when(~short, F.col("gram")).alias("gram"))
    hit = F.when(F.contains(F.col("text"), F.col(term_col)), F.col("id"))
    hits = found.join(index.read(GRAMS), "gram", "left").groupBy(term_col).agg(F.coalesce(F.min("least"), F.min(hit)).alias("id"))
    return hits.filter(F.col("id").isNotNull())
