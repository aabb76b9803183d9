"""Silver and Gold builds (generic over the reference's Bronze schemas)."""

from __future__ import annotations

import logging
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.functions.match import is_completed, parse_match_date, winner
from touchline.functions.positions import position_code
from touchline.operators.rank import rank_by_metric
from touchline.operators.snapshot import best_per_key, latest_per_key, latest_per_key_stored
from touchline.operators.standings import side_pairs, two_sided_standings
from touchline.sinks.store import Store

log = logging.getLogger(__name__)

# Performer tag to the metric column it ranks by.
METRIC_BY_STAT = {"goals": "goals", "assists": "assists", "rating": "rating"}


def silver_fixtures(bronze: DataFrame, order: Sequence[str] = ("ingested_at",),
                    date_col: str = "match_date") -> DataFrame:
    """Latest snapshot per fixture, text date parsed to DATE, completion flag added."""
    latest = latest_per_key_stored(bronze, ["fixture_id"], order)
    drop = [c for c in ("raw_json",) if c in latest.columns]
    return (latest.drop(*drop)
            .withColumn(date_col, parse_match_date(F.col(date_col)))
            .withColumn("is_completed", is_completed("status")))


def silver_players(bronze: DataFrame, order: Sequence[str] = ("ingested_at",)) -> DataFrame:
    """Latest snapshot per (player, team), feed position mapped to a code."""
    latest = latest_per_key(bronze, ["player_id", "team_id"], order)
    drop = [c for c in ("raw_json",) if c in latest.columns]
    return latest.drop(*drop).withColumn("position", position_code("position"))


def team_leagues(fixtures: DataFrame) -> DataFrame:
    """Distinct (team_id, league_id) over home and away sides, one scan."""
    return side_pairs(fixtures, ("home_team_id",), ("away_team_id",), ("league_id",), ("team_id",))


def gold_player_stats(players: DataFrame, fixtures: DataFrame) -> DataFrame:
    """Players with the league(s) their team plays in: one row per league, null when none.

    The (team, league) side is as large as teams x leagues; the join is left to AQE, which
    broadcasts it from runtime size or splits a hot team on the player side.
    """
    cols = ["player_id", "name", "team_id", "team_name", "position", "nationality", "age",
            "jersey_number"]
    return players.select(*cols).join(team_leagues(fixtures), "team_id", "left").select(*cols, "league_id")


def gold_team_summary(fixtures: DataFrame) -> DataFrame:
    """Standings from completed matches."""
    return two_sided_standings(fixtures.filter(F.col("is_completed")))


def gold_match_results(fixtures: DataFrame) -> DataFrame:
    done = fixtures.filter(F.col("is_completed") & F.col("home_score").isNotNull()
                           & F.col("away_score").isNotNull())
    return done.select(
        "fixture_id", "home_team_name", "away_team_name", "home_score", "away_score", "match_date",
        winner("home_score", "away_score", "home_team_name", "away_team_name").alias("winner"),
        F.abs(F.col("home_score") - F.col("away_score")).alias("goal_difference"),
        (F.col("home_score") + F.col("away_score")).alias("total_goals"),
    )


def best_performers(bronze: DataFrame, tie: Sequence[str] = ("ingested_at",)) -> DataFrame:
    """Best snapshot per (player, stat): highest value of its metric, then latest."""
    cols = ["player_id", "player_name", "team_name", "goals", "assists", "rating", "stat_type",
            *[t for t in tie]]
    return best_per_key(bronze.select(*dict.fromkeys(cols)), ["player_id"], METRIC_BY_STAT,
                        "stat_type", tie)


def gold_top_performers(bronze: DataFrame, tie: Sequence[str] = ("ingested_at",),
                        top_k: int | None = None) -> DataFrame:
    """Leaderboard rows: best snapshot per (player, stat), ranked per stat by its metric."""
    best = best_performers(bronze, tie)
    ranked = rank_by_metric(best, "stat_type", METRIC_BY_STAT, tie=("player_id",), top_k=top_k)
    return ranked.select("player_id", "player_name", "team_name", "goals", "assists", "rating",
                         "stat_type", "rank")


def build_silver(bronze: Mapping[str, DataFrame], fixture_order: Sequence[str] = ("ingested_at",)
                 ) -> dict[str, DataFrame]:
    return {
        "silver_fixtures": silver_fixtures(bronze["bronze_fixtures"], fixture_order),
        "silver_players": silver_players(bronze["bronze_players"]),
    }


def build_gold(silver: Mapping[str, DataFrame], bronze: Mapping[str, DataFrame] | None = None
               ) -> dict[str, DataFrame]:
    f, p = silver["silver_fixtures"], silver["silver_players"]
    out = {
        "gold_player_stats": gold_player_stats(p, f),
        "gold_team_summary": gold_team_summary(f),
        "gold_match_results": gold_match_results(f),
    }
    if bronze is not None and "bronze_top_performers" in bronze:
        out["gold_top_performers"] = gold_top_performers(bronze["bronze_top_performers"])
    return out


# Partition column per table, so a rebuild or a keyed replace touches whole partitions.
PARTITION_BY = {"gold_player_stats": ["league_id"], "gold_team_summary": ["league_id"]}


def run_all(bronze: Mapping[str, DataFrame], base_path: str,
            fixture_order: Sequence[str] = ("ingested_at",)) -> dict[str, str]:
    """Rebuild Silver, then Gold, as tables of the store at ``base_path``, each layer in one commit: a reader
    sees a layer before or after its rebuild. Top performers come last and are not fatal: if they fail, the
    stored ones stay. A rebuild replaces whole tables, so a partition whose rows moved away does not stay
    behind. Silver is read back for Gold, which also cuts the lineage.
    Returns a status per table ("ok" or the error text)."""
    spark = next(iter(bronze.values())).sparkSession
    store, status = Store(spark, base_path), {}
    with store.commit() as c:
        for name, df in build_silver(bronze, fixture_order).items():
            c.overwrite(name, df)
            status[name] = "ok"
    silver = store.snapshot()
    with store.commit() as c:
        for name, df in build_gold({n: silver.read(n) for n in status}).items():
            c.overwrite(name, df, PARTITION_BY.get(name, []))
            status[name] = "ok"
        if "bronze_top_performers" in bronze:
            before = c.tables.get("gold_top_performers")
            try:
                c.overwrite("gold_top_performers", gold_top_performers(bronze["bronze_top_performers"]))
                status["gold_top_performers"] = "ok"
            except Exception as exc:  # optional step, as in the reference pipeline
                log.warning("gold_top_performers failed: %s", exc)
                status["gold_top_performers"] = f"error: {exc}"
                c.tables.pop("gold_top_performers", None)
                if before is not None:
                    c.tables["gold_top_performers"] = before
    return status
