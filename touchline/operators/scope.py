"""Scope with fallback, and preferred-scope-first ordering."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_fallback(df: DataFrame, scope_pred: Column, other_pred: Column | None = None,
                  fallback: bool = True) -> DataFrame:
    """Rows matching ``other_pred`` inside the scope; if the scope has none, all of them.

    One lazy plan: the "does the scope hit" probe is an uncorrelated scalar subquery with
    ``limit 1``, so it stops at the first hit, runs once, and is inlined as a constant — no
    join and no global window.
    """
    base = df if other_pred is None else df.filter(other_pred)
    if not fallback:
        return base.filter(scope_pred)
    hit = base.filter(scope_pred).select(F.lit(True).alias("_hit")).limit(1).scalar()
    return base.filter(scope_pred | hit.isNull())


def preferred_first(df: DataFrame, scope_pred: Column, order: Sequence[Column], limit: int) -> DataFrame:
    """Rows of the preferred scope first, then ``order``; top ``limit``."""
    pref = F.when(scope_pred, F.lit(0)).otherwise(F.lit(1))
    return df.orderBy(pref.asc(), *order).limit(limit)
