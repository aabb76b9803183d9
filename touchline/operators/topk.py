"""First row per group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from touchline.operators.rank import positive


def first_per_group(df: DataFrame, group: Sequence[str], order: Sequence[Column],
                    limit: int | None = None) -> DataFrame:
    """The first row of every group by ``order``; with ``limit``, the first groups by ``order``.

    ``row_number() = 1`` plans as a partial ``WindowGroupLimit`` before the shuffle: a map task
    sends one row per group, so a busy group neither skews the shuffle nor hides the others.
    """
    w = Window.partitionBy(*group).orderBy(*order)
    firsts = df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") == 1).drop("_rn")
    return firsts if limit is None else firsts.orderBy(*order).limit(positive(limit))
