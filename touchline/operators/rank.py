"""Leaderboard ranks.

``row_number() over (order by metric desc)`` would pull a whole metric into one task. Two
forms scale instead:

* ``top_k``: ``row_number() <= k`` per tag plans as a partial ``WindowGroupLimit`` before the
  shuffle, so each map task sends at most k rows per tag.
* full rank (:func:`histogram_rank`): a histogram of the metric per tag gives the ranks taken before
  each bin, and rows are only ordered inside their bin; a bin of one value is dealt on by the
  tie-breaker. It is lazy: an aggregate, joins on the bins and a window per bin, no action.

:func:`global_row_number` numbers rows by any order: range-partition, number rows inside each sorted
partition, materialise that once (checkpoint), then add the row count of the earlier partitions of the
same group, in a join that the planner sizes. Null groups are numbered too.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from touchline.operators.snapshot import metric_of_tag


def global_row_number(df: DataFrame, order: Sequence[Column], group: str | None = None,
                      name: str = "rank", num_partitions: int | None = None) -> DataFrame:
    """1-based row number by ``order`` (within ``group`` if given) without a single-task sort.

    ``order`` must be a total order (end with a unique tie-breaker) so numbering is the same
    on every recomputation after a lost executor. The offset table has at most one row per
    (partition, group); as groups are contiguous in the range order that is no more than
    partitions + groups rows. A hot group spans many tasks, each numbering its share.
    """
    from touchline.session import ensure_checkpoint_dir

    sort_cols = ([F.col(group).asc()] if group else []) + list(order)
    n = num_partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    g = group or "_g"
    # The positions and the per-partition counts must come from one and the same range
    # partitioning. Two plans over the same frame would each sample their own range bounds,
    # so the numbered rows are materialised once (a reliable checkpoint in the shared
    # checkpoint folder, which also survives lost executors) and both sides read that copy.
    ensure_checkpoint_dir(df.sparkSession)
    ranged = (df.repartitionByRange(n, *sort_cols).sortWithinPartitions(*sort_cols)
              .withColumn("_pid", F.spark_partition_id())
              .withColumn("_pos", F.monotonically_increasing_id())
              .checkpoint(eager=True))
    if group is None:
        ranged = ranged.withColumn(g, F.lit(0))
    counts = ranged.groupBy("_pid", g).agg(F.count(F.lit(1)).alias("_n"), F.min("_pos").alias("_first"))
    before = Window.partitionBy(g).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    offsets = offsets.select(F.col("_pid").alias("_opid"), F.col(g).alias("_ogroup"), "_first", "_before")
    same = (F.col("_pid") == F.col("_opid")) & F.col(g).eqNullSafe(F.col("_ogroup"))
    out = (ranged.join(offsets, same)
           .withColumn(name, (F.col("_pos") - F.col("_first") + F.col("_before") + 1).cast("bigint"))
           .drop("_pid", "_pos", "_opid", "_ogroup", "_first", "_before"))
    return out.drop(g) if group is None else out


#: Bins per factor e of a metric, and leading characters of the tie-breaker that divide a bin of one value.
BINS_PER_E, TIE_PREFIX = 4096, 4


def metric_bin(metric: Column) -> Column:
    """Bin of a double, larger metrics in smaller bins (as wide as a 4096th part of a factor e; a result of
    ``ln`` never falls where its argument rises, so neither does the bin); NaN first, as in a descending sort."""
    def size(x):
        return F.floor(F.ln(x) * BINS_PER_E) + F.lit(745 * BINS_PER_E)  # ln of the smallest double is above -745
    most = F.lit(711 * BINS_PER_E + 745 * BINS_PER_E)
    return (F.when(F.isnan(metric), -most - 2).when(metric == float("inf"), -most - 1).when(metric == float("-inf"), most + 1)
            .when(metric > 0, -size(metric) - 1).when(metric < 0, size(-metric) + 1).otherwise(F.lit(0)).cast("bigint"))


def histogram_rank(df: DataFrame, group: str, metric: str, tie: Sequence[str], name: str = "rank") -> DataFrame:
    """1-based rank within ``group`` by ``metric`` (a double, descending), then ``tie`` ascending (a total order).

    The histogram has a row per group and bin (at most twelve million bins a group, whatever the rows; a few
    thousand as metrics go). A bin of one value, as many ties make it, is divided by the first characters of a
    text tie-breaker, which order as it does, so such a group of ties spreads over tasks as well."""
    prefix = F.substring(tie[0], 1, TIE_PREFIX) if dict(df.dtypes)[tie[0]] == "string" else F.lit("")
    rows = df.select("*", metric_bin(F.col(metric)).alias("_bin"), F.coalesce(prefix, F.lit("")).alias("_prefix"))
    cells = rows.groupBy(group, "_bin", "_prefix").agg(F.count(F.lit(1)).alias("_n"), F.min(metric).alias("_lo"), F.max(metric).alias("_hi"))
    bins = cells.groupBy(group, "_bin").agg(F.sum("_n").alias("_all"), (F.min("_lo") == F.max("_hi")).alias("_one"))
    before = (Window.unboundedPreceding, -1)
    above = F.sum("_all").over(Window.partitionBy(group).orderBy("_bin").rowsBetween(*before))
    left = F.sum("_n").over(Window.partitionBy(group, "_bin").orderBy("_prefix").rowsBetween(*before))
    offset = F.coalesce("_above", F.lit(0)) + F.when(F.col("_one"), F.coalesce(left, F.lit(0))).otherwise(0)
    cells = cells.join(bins.select(group, "_bin", "_one", above.alias("_above")), [group, "_bin"]).select(
        group, "_bin", "_prefix", offset.alias("_before"), F.when(F.col("_one"), F.col("_prefix")).otherwise("").alias("_part"))
    cell = Window.partitionBy(group, "_bin", "_part").orderBy(F.col(metric).desc(), *[F.col(t).asc() for t in tie])
    out = rows.join(cells, [group, "_bin", "_prefix"])
    return out.select(*df.columns, (F.col("_before") + F.row_number().over(cell)).cast("bigint").alias(name))


def rank_by_metric(df: DataFrame, tag_col: str, metric_by_tag: Mapping[str, str],
                   tie: Sequence[str] = ("player_id",), top_k: int | None = None,
                   name: str = "rank") -> DataFrame:
    """Rank rows per tag by the metric the tag names (desc), ties by ``tie`` ascending.

    Rows whose metric is null are dropped; metrics not named by a row's tag are nulled.
    """
    metric = metric_of_tag(tag_col, metric_by_tag)
    tags = list(metric_by_tag)
    base = df.filter(F.col(tag_col).isin(*tags) & metric.isNotNull())
    for tag, col in metric_by_tag.items():
        dtype = dict(df.dtypes)[col]
        base = base.withColumn(col, F.when(F.col(tag_col) == tag, F.col(col)).cast(dtype))
    base = base.withColumn("_metric", metric)
    order = [F.col("_metric").desc()] + [F.col(t).asc() for t in tie]
    if top_k is not None:
        w = Window.partitionBy(tag_col).orderBy(*order)
        out = base.withColumn(name, F.row_number().over(w).cast("bigint")).filter(F.col(name) <= top_k)
    else:
        out = histogram_rank(base, tag_col, "_metric", tie, name)
    return out.drop("_metric")


def top_by_rank(ranked: DataFrame, tag_col: str, tag: str, metric_col: str, k: int,
                cols: Sequence[str] = ("player_name", "team_name"), rank_col: str = "rank") -> DataFrame:
    """``where tag = t and metric is not null order by rank limit k`` (TakeOrderedAndProject)."""
    return (ranked.filter((F.col(tag_col) == tag) & F.col(metric_col).isNotNull())
            .orderBy(F.col(rank_col).asc()).limit(k).select(*cols, metric_col, rank_col))


# Metric columns a leaderboard may rank by; anything else falls back to goals.
STATS = ("goals", "assists", "rating")


def positive(n: int) -> int:
    """A page size as asked for; anything below one is an error, nothing is cut silently."""
    if int(n) < 1:
        raise ValueError(f"limit must be at least 1, got {n}")
    return int(n)


def valid_stat(stat: str | None) -> str:
    return stat if stat in STATS else "goals"
