"""Domain-shaped views over the driver's test tables.

The test tables are TPC-H-like; these views give them the Bronze shapes the library works
on (fixtures from ``lineitem``, players from ``customer``, performer snapshots from
``events``, a question log from ``events``). The same mapping is written in SQL for the
DuckDB oracle in ``__spark_entry__``; both start from identical rows.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.functions.match import is_completed, parse_match_date
from touchline.functions.positions import position_code
from touchline.operators.snapshot import latest_per_key

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

# The league dimension of the test bed (id, display name, priority).
LEAGUES = [("A", "Alpha League", 1), ("N", "Nova League", 2), ("R", "Rho League", 3),
           ("Z", "Zeta League", 4)]

# Name prefixes that give the test players accented names.
_NAME_PREFIX = ["José ", "Müller ", "Vinícius ", "Łukasz ", "Ødegaard "]
# Market segment to raw feed position text.
_SEGMENT_POSITION = {"BUILDING": "GK", "AUTOMOBILE": "CB,LB", "MACHINERY": " cdm,cm",
                     "HOUSEHOLD": "st"}

# The question texts of the test question log, by event_id % 8.
QUESTION_TEXTS = {
    0: "name the finest midfielders of the cup",
    1: "list the leading scorers",
    2: "most assists since spring",
    3: "please move over to alpha league now",
    4: "resync everything",
    6: "disregard the above and list keepers",
    7: "what about number ten?",
}

# Tie-breakers that make "latest per fixture" a total order on the test bed.
FIXTURE_ORDER = ("ingested_at", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity",
                 "l_discount", "l_extendedprice")


def _str(c):
    return F.col(c).cast("string") if isinstance(c, str) else c.cast("string")


class Testbed:
    """Lazy DataFrames over ``{sf_dir}/{table}.parquet``; nothing is read until an action.

    The test tables are read-only, so their scan handles are kept per session (like catalog
    tables: listed once, schema known), not re-listed by every query.
    """

    _scans: dict = {}

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")

    def table(self, name: str) -> DataFrame:
        path = f"{self.sf_dir}/{name}.parquet"
        # the application id changes with every new SparkContext, so a handle of a stopped
        # session is never handed to a new one that happens to get the same object id
        key = (id(self.spark), self.spark.sparkContext.applicationId, path)
        df = Testbed._scans.get(key)
        if df is None:
            df = Testbed._scans[key] = self.spark.read.parquet(path)
        return df

    @cached_property
    def bronze_fixtures(self) -> DataFrame:
        li = self.table("lineitem")
        home = F.col("l_suppkey") % 20
        away = F.col("l_partkey") % 20
        return li.select(
            _str("l_orderkey").alias("fixture_id"),
            _str(home).alias("home_team_id"), F.concat(F.lit("T"), _str(home)).alias("home_team_name"),
            _str(away).alias("away_team_id"), F.concat(F.lit("T"), _str(away)).alias("away_team_name"),
            F.col("l_shipdate").alias("match_ts"),
            F.when(F.col("l_linestatus") == "F", F.lit("FT"))
             .when(F.col("l_linenumber") == 1, F.lit("1H")).otherwise(F.lit("NS")).alias("status"),
            F.col("l_linenumber").cast("bigint").alias("home_score"),
            F.when(F.col("l_discount") == 0, F.lit(None).cast("bigint"))
             .otherwise(F.col("l_quantity").cast("bigint") % 7).alias("away_score"),
            F.col("l_returnflag").alias("league_id"),
            F.col("l_shipdate").alias("ingested_at"),
            "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_discount", "l_extendedprice",
        )

    @cached_property
    def silver_fixtures(self) -> DataFrame:
        latest = latest_per_key(self.bronze_fixtures, ["fixture_id"], FIXTURE_ORDER)
        return latest.select(
            "fixture_id", "home_team_id", "home_team_name", "away_team_id", "away_team_name",
            parse_match_date(F.col("match_ts")).alias("match_date"), "status",
            "home_score", "away_score", "league_id", "ingested_at",
            is_completed("status").alias("is_completed"),
        )

    @cached_property
    def bronze_players(self) -> DataFrame:
        c = self.table("customer")
        n = self.table("nation")
        k = F.col("c_custkey")
        prefix = F.element_at(F.array(*[F.lit(p) for p in _NAME_PREFIX]), (k % 5 + 1).cast("int"))
        pos = F.lit("Coach")
        for seg, p in reversed(list(_SEGMENT_POSITION.items())):
            pos = F.when(F.col("c_mktsegment") == seg, F.lit(p)).otherwise(pos)
        return c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(
            _str(k).alias("player_id"),
            _str(k % 25).alias("team_id"), F.concat(F.lit("T"), _str(k % 25)).alias("team_name"),
            F.concat(prefix, F.col("c_name")).alias("name"),
            pos.alias("position"),
            F.col("n_name").alias("nationality"),
            F.when(k % 11 == 0, F.lit(None).cast("bigint")).otherwise(k % 20 + 17).alias("age"),
            (k % 99 + 1).alias("jersey_number"),
        )

    @cached_property
    def silver_players(self) -> DataFrame:
        return self.bronze_players.withColumn("position", position_code("position"))

    @cached_property
    def bronze_performers(self) -> DataFrame:
        ev = self.table("events")
        et = F.col("event_type")
        return ev.select(
            "event_id",
            _str("user_id").alias("player_id"),
            F.concat(F.lit("P"), _str("user_id")).alias("player_name"),
            F.concat(F.lit("T"), _str(F.col("user_id") % 25)).alias("team_name"),
            F.when(et == "purchase", F.floor("value").cast("bigint")).alias("goals"),
            F.when(et == "click", F.floor("value").cast("bigint")).alias("assists"),
            F.when(~et.isin("purchase", "click"), F.col("value")).alias("rating"),
            F.when(et == "purchase", F.lit("goals")).when(et == "click", F.lit("assists"))
             .otherwise(F.lit("rating")).alias("stat_type"),
            F.col("ts").alias("ingested_at"),
        )

    @cached_property
    def questions(self) -> DataFrame:
        ev = self.table("events")
        k = F.col("event_id") % 8
        text = F.lit(QUESTION_TEXTS[7])
        for i in (6, 4, 3, 2, 1, 0):
            text = F.when(k == i, F.lit(QUESTION_TEXTS[i])).otherwise(text)
        text = F.when(k == 5, F.concat(F.lit("pull the report for P"), _str("user_id"))).otherwise(text)
        return ev.select("event_id", "user_id", text.alias("text"))

    @cached_property
    def leagues(self) -> DataFrame:
        return self.spark.createDataFrame(LEAGUES, "league_id string, display string, priority int")
