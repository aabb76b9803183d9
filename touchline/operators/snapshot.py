"""Snapshot selection: latest row per key, best row per (key, metric)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Row with the greatest ``order`` (all descending, nulls last) per key, kept whole.

    ``row_number() = 1`` plans as a partial ``WindowGroupLimit`` before the shuffle and a final
    one after it: each map task keeps one row per key, so a key holding a third of the table
    costs one row per task on the wire, not a third of the table in one reducer. Unlike a
    ``max_by(struct(...))`` aggregate it also lets Catalyst drop payload columns a consumer
    does not read.
    """
    w = Window.partitionBy(*keys).orderBy(*[o.desc_nulls_last() for o in order])
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") == 1).drop("_rn")


def latest_per_key(df: DataFrame, keys: Sequence[str], order_by: Sequence[str | Column]) -> DataFrame:
    """One row per key: the greatest by ``order_by`` (all descending, nulls last).

    Equal to ``row_number() over (partition by keys order by o1 desc, o2 desc, ...) = 1``; the
    order columns should break every tie.
    """
    return _first_per_key(df, keys, _columns(order_by))


def _columns(order_by: Sequence[str | Column]) -> list[Column]:
    return [F.col(o) if isinstance(o, str) else o for o in order_by]


#: Shares that :func:`latest_per_key_stored` deals the keys to, and how many times its mean a share may hold.
SHARES, HEAVY = 1024, 4


def latest_per_key_stored(df: DataFrame, keys: Sequence[str], order_by: Sequence[str | Column]) -> DataFrame:
    """:func:`latest_per_key` for a large table of wide rows that can be read more than once.

    There the reduction before the shuffle sorts all rows of a map task, which spills the table to disk where a
    task's rows don't fit its memory and drops little where a key's rows are far apart. Here the rows go to their
    key's partition unsorted and are sorted there, a partition at a time. Keys that would fill one are kept out:
    a first pass over the key columns counts the rows of each share of the keys' hashes, and the rows of
    heavy shares (a row a share at most is gathered) are reduced before their shuffle.
    """
    share = F.pmod(F.xxhash64(*[F.col(k) for k in keys]), F.lit(SHARES)).cast("int")
    counts = df.groupBy(share.alias("_share")).agg(F.count(F.lit(1)).alias("_n"))
    counted = counts.agg(F.collect_list(F.struct("_share", "_n")).alias("_c"), F.sum("_n").alias("_all"))
    heavy = counted.select(F.transform(F.filter("_c", lambda c: c["_n"] * SHARES > F.col("_all") * HEAVY), lambda c: c["_share"])).scalar()
    hot = F.array_contains(heavy, share)
    spread = _first_per_key(df.filter(~hot).repartition(*[F.col(k) for k in keys]), keys, _columns(order_by))
    return spread.unionByName(_first_per_key(df.filter(hot), keys, _columns(order_by)))


def metric_of_tag(tag_col: str, metric_by_tag: Mapping[str, str]) -> Column:
    """``case tag when 'goals' then cast(goals as double) ... end``."""
    expr = None
    for tag, col in metric_by_tag.items():
        cond = F.col(tag_col) == F.lit(tag)
        val = F.col(col).cast("double")
        expr = F.when(cond, val) if expr is None else expr.when(cond, val)
    return expr


def best_per_key(df: DataFrame, keys: Sequence[str], metric_by_tag: Mapping[str, str],
                 tag_col: str = "stat_type", tie: Sequence[str] = ("ingested_at",)) -> DataFrame:
    """Best snapshot per (keys, tag): highest value of the metric the tag names, nulls last,
    then the ``tie`` columns descending."""
    order = [metric_of_tag(tag_col, metric_by_tag)] + [F.col(t) for t in tie]
    k = list(keys) + ([tag_col] if tag_col not in keys else [])
    return _first_per_key(df, k, order)
