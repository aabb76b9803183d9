"""Declared schemas of the ten stored tables (B5): name to DDL column list."""

from __future__ import annotations

from pyspark.sql import types as T

# Column names and types of the stored tables.
TABLE_DDL = {
    "bronze_fixtures": """fixture_id string, home_team_id string, home_team_name string, away_team_id string, away_team_name string,
        match_date string, status string, home_score bigint, away_score bigint, league_id string, season bigint, raw_json string,
        ingested_at timestamp, source string""",
    "bronze_players": """player_id string, team_id string, team_name string, name string, position string, nationality string, age bigint,
        jersey_number bigint, raw_json string, ingested_at timestamp, source string""",
    "bronze_team_squads": """team_id string, team_name string, player_id string, player_name string, position string, raw_json string,
        ingested_at timestamp, source string""",
    "bronze_top_performers": """player_id string, player_name string, team_id string, team_name string, goals bigint, assists bigint,
        rating double, stat_type string, league_id string, ingested_at timestamp, source string""",
    "silver_fixtures": """fixture_id string, home_team_id string, home_team_name string, away_team_id string, away_team_name string,
        match_date date, status string, home_score bigint, away_score bigint, league_id string, season bigint, source string,
        ingested_at timestamp, is_completed boolean""",
    "silver_players": """player_id string, team_id string, team_name string, name string, position string, nationality string, age bigint,
        jersey_number bigint, source string, ingested_at timestamp""",
    "gold_player_stats": """player_id string, name string, team_id string, team_name string, position string, nationality string,
        age bigint, jersey_number bigint, league_id string""",
    "gold_team_summary": """team_id string, team_name string, league_id string, matches_played bigint, wins bigint, draws bigint,
        losses bigint, goals_for bigint, goals_against bigint, goal_difference bigint, points bigint""",
    "gold_match_results": """fixture_id string, home_team_name string, away_team_name string, home_score bigint, away_score bigint,
        match_date date, winner string, goal_difference bigint, total_goals bigint""",
    "gold_top_performers": """player_id string, player_name string, team_name string, goals bigint, assists bigint, rating double,
        stat_type string, rank bigint""",
}


def table_schema(name: str) -> T.StructType:
    return T.StructType.fromDDL(TABLE_DDL[name])


def table_schemas() -> dict[str, T.StructType]:
    """All ten, for :func:`touchline.sinks.tables.create_tables`."""
    return {n: table_schema(n) for n in TABLE_DDL}
