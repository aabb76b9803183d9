"""Entity discovery over two-sided records (teams from matches)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def discover_entities(df: DataFrame,
                      side_a: Sequence[str] = ("home_team_id", "home_team_name"),
                      side_b: Sequence[str] = ("away_team_id", "away_team_name"),
                      order: Sequence[str] = ("ingested_at",),
                      first: int | None = None) -> DataFrame:
    """Distinct entity ids over both sides; the first-seen name wins, a blank name falls back
    to the id; sides without an id are skipped. All entities are returned;
    ``first`` asks for the N seen earliest (a top-N report).

    First sighting is the smallest ``(order..., side)``; ``min`` of a struct is an aggregate,
    so hot ids are reduced map-side.
    """
    def side(cols, k):
        seq = F.struct(*[F.col(o).alias(f"_o{i}") for i, o in enumerate(order)], F.lit(k).alias("_side"))
        return F.struct(F.col(cols[0]).cast("string").alias("id"), F.col(cols[1]).alias("name"),
                        seq.alias("seen"))
    s = df.select(F.inline(F.array(side(side_a, 0), side(side_b, 1))))
    s = s.filter(F.col("id").isNotNull() & (F.col("id") != ""))
    seen = s.groupBy("id").agg(F.min(F.struct("seen", "name")).alias("_f"))
    out = seen.select(
        "id",
        F.coalesce(F.nullif(F.col("_f.name"), F.lit("")), F.col("id")).alias("name"),
        F.col("_f.seen").alias("first_seen"),
    )
    if first is not None:
        out = out.orderBy(F.col("first_seen").asc(), F.col("id").asc()).limit(first)
    return out
