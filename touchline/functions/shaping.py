"""Result shaping helpers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def label_value(df: DataFrame) -> DataFrame:
    """First column as a string label, second as a double value (uncastable gives 0.0).

    With a single column, that column is both label and value.
    """
    cols = df.columns
    if not cols:
        raise ValueError("label_value needs at least one column")
    lab = F.col(cols[0])
    val = F.col(cols[1] if len(cols) > 1 else cols[0])
    return df.select(
        F.coalesce(lab.cast("string"), F.lit("")).alias("label"),
        F.coalesce((val.cast("string")).try_cast("double"), F.lit(0.0)).alias("value"),
    )
