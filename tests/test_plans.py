"""Physical plan properties: no Python on the hot path, pushdown, top-k, one scan."""

import pytest

import __spark_entry__ as E
from touchline.sources.testbed import Testbed

from testpaths import SF_SMALL

PY_NODES = ("BatchEvalPython", "ArrowEvalPython", "FlatMapGroupsInPandas", "MapInPandas", "PythonUDF")


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("key", sorted(set(E.queries()) - set(E._corpus("QUERIES")) - {"incremental_upsert"}))
def test_no_python_udf(spark, key):
    plan = _plan(E.queries()[key](spark, SF_SMALL))
    assert not any(n in plan for n in PY_NODES), key


def test_leaderboard_read_is_take_ordered(spark):
    plan = _plan(E.queries()["leaderboard_topk"](spark, SF_SMALL))
    assert "TakeOrderedAndProject" in plan


def test_search_prunes_columns(spark):
    df = E.queries()["document_search_folded"](spark, SF_SMALL)
    plan = _plan(df)
    assert "ReadSchema: struct<doc_id:bigint,text:string,lang:string>" in plan


def test_filter_reaches_scan(spark):
    from pyspark.sql import functions as F
    from touchline.sources.testbed import Testbed
    df = Testbed(spark, SF_SMALL).table("lineitem").filter(F.col("l_returnflag") == "A").select("l_orderkey")
    assert "PushedFilters: [IsNotNull(l_returnflag), EqualTo(l_returnflag,A)]" in _plan(df)


def test_standings_reads_lineitem_once(spark):
    assert _plan(E.queries()["standings"](spark, SF_SMALL)).count("FileScan parquet") == 1


def _skewed_fixtures(spark):
    """One fixture holds a third of all snapshots."""
    from pyspark.sql import functions as F
    n = 3000
    df = spark.range(n).select(
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("fixture_id"),
        (F.col("id") % 7).cast("string").alias("home_team_id"), F.lit("H").alias("home_team_name"),
        (F.col("id") % 5).cast("string").alias("away_team_id"), F.lit("A").alias("away_team_name"),
        (F.col("id") % 4).alias("home_score"), (F.col("id") % 3).alias("away_score"),
        F.lit("FT").alias("status"), F.lit("L").alias("league_id"),
        F.col("id").cast("timestamp").alias("ingested_at"))
    return df


def test_latest_per_key_reduces_hot_key_before_shuffle(spark):
    from touchline.operators.snapshot import latest_per_key
    out = latest_per_key(_skewed_fixtures(spark), ["fixture_id"], ["ingested_at"])
    plan = _plan(out)
    below_exchange = plan.split("Exchange hashpartitioning(fixture_id")[1]
    assert "WindowGroupLimit" in below_exchange and "Partial" in below_exchange
    rows = {r.fixture_id: r.ingested_at for r in out.collect()}
    assert len(rows) == 2001 and rows["hot"].timestamp() == 2997


def test_stored_latest_sorts_behind_the_shuffle_and_reduces_hot_keys_before(spark):
    from pyspark.sql import functions as F

    from touchline.operators.snapshot import latest_per_key, latest_per_key_stored
    rows = _skewed_fixtures(spark)
    keys = [F.when(F.col("fixture_id") == "7", F.lit(None)).otherwise(F.col("fixture_id")), F.col("fixture_id")]
    for key in keys:
        df = rows.withColumn("fixture_id", key).withColumn("late", F.col("ingested_at") < F.lit("1970-01-01 00:20:00").cast("timestamp"))
        order = ["late", F.col("ingested_at")]
        got, want = (f(df, ["fixture_id"], order) for f in (latest_per_key_stored, latest_per_key))
        assert got.columns == want.columns and got.count() == 2001
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    plan = _plan(latest_per_key_stored(rows, ["fixture_id"], ["ingested_at"]))
    assert "Partial" in plan  # the heavy shares are cut before their shuffle
    assert "Sort" not in plan.split("REPARTITION_BY_COL")[1].split("Window")[0]  # the others are sorted behind theirs


def test_silver_fixtures_is_not_sorted_before_its_shuffle(spark):
    from pyspark.sql import functions as F

    from touchline.plans.medallion import silver_fixtures
    plan = _plan(silver_fixtures(_skewed_fixtures(spark).withColumn("match_date", F.lit("2024-01-01"))))
    assert "REPARTITION_BY_COL" in plan


def test_standings_partial_hash_aggregate(spark):
    from touchline.operators.standings import two_sided_standings
    plan = _plan(two_sided_standings(_skewed_fixtures(spark)))
    assert any("HashAggregate" in line and "partial_count" in line for line in plan.splitlines())


def test_global_rank_has_no_single_partition_sort(spark):
    plan = _plan(E.queries()["leaderboard_rank"](spark, SF_SMALL))
    assert "ExistingRDD" not in plan  # nothing was run to build the plan
    assert "Exchange SinglePartition" not in plan


def test_resolution_joins_are_equi_joins(spark):
    for key in ("player_demand", "name_candidates"):
        plan = _plan(E.queries()[key](spark, SF_SMALL))
        assert "BroadcastNestedLoopJoin" not in plan and "CartesianProduct" not in plan, key


def test_question_regexes_stay_above_the_text_aggregation(spark):
    """The name extraction and fold run per distinct question: no predicate on them is
    pushed into the scan of the log (where it would run once per log row)."""
    import re
    for key in ("player_demand", "name_candidates"):
        plan = _plan(E.queries()[key](spark, SF_SMALL))
        for filters in re.findall(r"DataFilters: \[(.*?)\], Format", plan):
            assert "regexp" not in filters and "translate" not in filters, (key, filters[:200])


def test_with_derived_keeps_filter_above_aggregate(spark):
    from pyspark.sql import functions as F
    from touchline.operators.derive import with_derived
    agg = spark.range(50).groupBy((F.col("id") % 5).alias("k")).count()
    out = with_derived(agg, e=F.regexp_replace(F.col("k").cast("string"), "1", "xx")).filter(F.length("e") > 1)
    plan = _plan(out)
    assert plan.index("Filter") < plan.index("Generate") < plan.index("HashAggregate")
    assert sorted(r.k for r in out.collect()) == [1]


def test_no_broadcast_or_nested_loop_of_our_own(spark):
    """With automatic (size-statistics) broadcasts off, nothing is broadcast and aliases of any
    number meet the texts without a nested loop; a top-k question needs no checkpointed rank."""
    from pyspark.sql import functions as F
    from touchline.operators.rank import global_row_number
    from touchline.operators.resolve import resolve_alias
    prev = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = spark.range(300).select((F.col("id") % 7).alias("g"), F.col("id"))
        assert "BroadcastExchange" not in _plan(global_row_number(df, [F.col("id").asc()], group="g"))
        log = spark.createDataFrame([("switch to la liga",)], "text string")
        aliases = spark.createDataFrame([("la liga", "140", 1)], "alias string, id string, priority int")
        plan = _plan(resolve_alias(log, "text", aliases))
        assert "NestedLoop" not in plan and "CartesianProduct" not in plan and "Broadcast" not in plan
        for q in ("leaderboard_topk", "top_performers_assists", "chart_top_scorers"):
            assert "WindowGroupLimit" in _plan(E.queries()[q](spark, SF_SMALL))
            assert "ExistingRDD" not in _plan(E.queries()[q](spark, SF_SMALL))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", prev)


def test_league_overview_is_one_aggregate_over_the_players(spark):
    import re
    from pyspark.sql import functions as F
    from touchline.plans.catalogue import league_overview
    players = Testbed(spark, SF_SMALL).table("customer").select(
        F.lit("A").alias("league_id"), F.col("c_mktsegment").alias("position"), F.col("c_name").alias("team_name"),
        F.col("c_nationkey").cast("string").alias("nationality"))
    plan = _plan(league_overview(players, "A"))
    assert plan.count("FileScan parquet") == 1 and len(re.findall("Expand", plan)) == 1 and "Subquery" not in plan


def test_loaded_leagues_read_no_data_file(spark, scratch):
    from pyspark.sql import functions as F
    from touchline.plans.catalogue import loaded_flags, loaded_leagues
    from touchline.sinks.store import Store
    store = Store(spark, scratch)
    with store.commit() as c:
        c.overwrite("gold_player_stats", spark.createDataFrame([("1", "A"), ("2", "B/x"), ("3", "C"), ("4", None)], "player_id string, league_id string"), ["league_id"])
    with store.commit() as c:
        c.delete_where("gold_player_stats", F.col("league_id") == "C")  # its partition stays without rows
    leagues = spark.createDataFrame([("A",), ("B/x",), ("C",)], "league_id string")
    out = loaded_flags(leagues, loaded_leagues(store.snapshot()))
    assert "FileScan" not in _plan(out)
    assert sorted(map(tuple, out.collect())) == [("A", True), ("B/x", True), ("C", False)]
