"""Columns derived once per row of a frame, with predicates on them kept above that point."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_derived(df: DataFrame, **cols: Column) -> DataFrame:
    """``df`` plus ``cols``, evaluated once per row of ``df``.

    Catalyst moves a filter on a derived column through the projection that defines it and
    below an aggregation whenever it only references grouping keys, down to the scan. For an
    expensive expression over pre-aggregated input (a regex chain per distinct question) that
    evaluates it once per *input* row, and the ``isnotnull`` it infers for a join key does
    the same in every scan of the input. A generator's output is never moved past, so the
    columns come out of a one-element ``inline``: the expression runs where it is written.
    """
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in cols.items()]))))
