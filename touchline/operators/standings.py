"""Two-sided aggregation: every match counted once for each side, in one scan."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _sides(df: DataFrame, side_a: Sequence[str], side_b: Sequence[str], group: Sequence[str],
           names: Sequence[str]) -> DataFrame:
    """Unpivot each row into one row per side with identically named struct fields."""
    def st(cols):
        return F.struct(*[F.col(c).alias(n) for c, n in zip(cols, names)])
    return df.select(*group, F.inline(F.array(st(side_a), st(side_b))))


def two_sided_standings(df: DataFrame,
                        side_a: Sequence[str] = ("home_team_id", "home_team_name", "home_score", "away_score"),
                        side_b: Sequence[str] = ("away_team_id", "away_team_name", "away_score", "home_score"),
                        group: Sequence[str] = ("league_id",),
                        points: tuple[int, int] = (3, 1)) -> DataFrame:
    """League table per (team, group): played, W/D/L, goals, difference, points.

    Each side is ``(team id, team name, goals for, goals against)``. A null score still counts
    as played but as neither win, draw nor loss. One ``groupBy`` over the unpivoted sides is the
    same as aggregating home and away separately and re-aggregating their union.
    """
    s = _sides(df, side_a, side_b, group, ("team_id", "team_name", "gf", "ga"))
    win, draw = points
    # numeric buffers only, so this is a hash aggregate with a map-side partial step; the
    # string max(team_name) runs on its output (one row per team, league and name)
    counts = ["matches_played", "wins", "draws", "losses", "goals_for", "goals_against"]
    per_name = s.groupBy("team_id", *group, "team_name").agg(
        F.count(F.lit(1)).alias("matches_played"),
        F.count_if(F.col("gf") > F.col("ga")).alias("wins"),
        F.count_if(F.col("gf") == F.col("ga")).alias("draws"),
        F.count_if(F.col("gf") < F.col("ga")).alias("losses"),
        F.sum("gf").alias("goals_for"),
        F.sum("ga").alias("goals_against"),
    )
    agg = per_name.groupBy("team_id", *group).agg(
        F.max("team_name").alias("team_name"),
        *[F.sum(c).alias(c) for c in counts])
    return agg.select(
        "team_id", "team_name", *group, "matches_played", "wins", "draws", "losses",
        "goals_for", "goals_against",
        (F.col("goals_for") - F.col("goals_against")).alias("goal_difference"),
        (F.col("wins") * win + F.col("draws") * draw).alias("points"),
    )


def side_pairs(df: DataFrame, side_a: Sequence[str] = ("home_team_id",),
               side_b: Sequence[str] = ("away_team_id",), group: Sequence[str] = ("league_id",),
               names: Sequence[str] = ("team_id",)) -> DataFrame:
    """Distinct (side entity, group) pairs over both sides: a one-scan UNION DISTINCT."""
    return _sides(df, side_a, side_b, group, names).select(*names, *group).distinct()
