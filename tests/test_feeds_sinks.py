"""Feed flattening, keyed replace truth table, streaming upsert."""

import datetime as dt
import json

from pyspark.sql import functions as F

from touchline.sinks.tables import (create_tables, delete_where, keyed_replace_frame, read_table,
                                    replace_keys, replace_partitions, replace_where)
from touchline.sources import feeds as FD
from touchline.streaming.upsert import merge_batch, upsert_stream

TS = dt.datetime(2024, 5, 1, 12, 0, 0)


def _json_df(spark, objs, schema):
    rdd_free = spark.createDataFrame([(json.dumps(o),) for o in objs], "j string")
    return rdd_free.select(F.from_json("j", schema).alias("x")).select("x.*")


def test_flatten_matches_explicit_league_and_nulls(spark):
    matches = [
        {"id": 55, "home": {"id": 1, "name": "Spain", "score": 2}, "away": {"id": 2, "name": "Italy", "score": "1"},
         "status": {"utcTime": "2024-06-01T19:00:00Z", "reason": {"short": "FT"}}},
        {"id": 56, "home": None, "away": {"id": 3, "name": "Wales"}, "status": None},
        {},
    ]
    df = _json_df(spark, [{"response": {"matches": matches}}], FD.MATCH_ENVELOPE)
    out = FD.flatten_matches(FD.matches_from_envelope(df), 42, 2024, ts=TS).collect()
    assert len(out) == 3
    a = out[0]
    assert (a.fixture_id, a.home_team_id, a.away_team_name, a.home_score, a.away_score) == ("55", "1", "Italy", 2, 1)
    assert a.league_id == "42" and a.season == 2024 and a.status == "FT"
    assert json.loads(a.raw_json)["id"] == "55"
    b = out[1]
    assert (b.home_team_id, b.home_team_name, b.home_score, b.status) == ("", "", None, "")
    assert {r.ingested_at for r in out} == {TS}


def test_missing_envelope_gives_no_rows(spark):
    df = _json_df(spark, [{"response": {}}, {}], FD.MATCH_ENVELOPE)
    assert FD.matches_from_envelope(df).count() == 0


def test_flatten_squads_drops_excluded_members(spark):
    env = {"team_id": "9", "team_name": "Norway", "response": {"list": {"squad": [
        {"title": "keepers", "members": [{"id": 1, "name": "Nyland", "positionIdsDesc": "GK", "age": 33,
                                          "shirtNumber": 1}]},
        {"title": "coach", "members": [{"id": 2, "name": "Solbakken", "excludeFromRanking": True}]},
        {"title": "attackers", "members": [{"id": 3, "name": "Haaland", "positionIdsDesc": "ST", "age": "23",
                                            "shirtNumber": None, "excludeFromRanking": False}]},
    ]}}}
    compact, players = FD.flatten_squads(_json_df(spark, [env], FD.SQUAD_ENVELOPE), ts=TS)
    p = {r.player_id: r for r in players.collect()}
    assert set(p) == {"1", "3"}
    assert p["3"].nationality == "Norway" and p["3"].age == 23 and p["3"].jersey_number is None
    assert compact.count() == 2


def test_merge_metric_feeds(spark):
    scorers = _json_df(spark, [{"id": 71, "name": "Abel", "teamId": 4, "teamName": "Norway", "goals": 3}], FD.PERFORMER)
    assisters = _json_df(spark, [{"id": 72, "name": "Bruno", "teamId": 5, "teamName": "Chile", "assists": 4}], FD.PERFORMER)
    rated = _json_df(spark, [{"id": 73, "name": "Cato", "teamId": 6, "teamName": "Ghana", "rating": 6.5}], FD.PERFORMER)
    out = FD.merge_metric_feeds({"goals": scorers, "assists": assisters, "rating": rated}, ts=TS).collect()
    assert len(out) == 3 and len({r.ingested_at for r in out}) == 1
    by = {r.stat_type: r for r in out}
    assert (by["goals"].goals, by["goals"].assists, by["goals"].rating) == (3, None, None)
    assert by["assists"].assists == 4 and by["rating"].rating == 6.5
    assert {r.league_id for r in FD.merge_metric_feeds({"goals": scorers}, league_id="47").collect()} == {"47"}
    no_goals = _json_df(spark, [{"id": 1, "name": "X"}], FD.PERFORMER)
    assert FD.merge_metric_feeds({"goals": no_goals}).collect()[0].goals == 0


def test_first_nonempty_array_falls_through(spark):
    env = spark.createDataFrame([([], [("1", "Premier League")])],
                                "leagues array<struct<id:string,name:string>>, popular array<struct<id:string,name:string>>")
    out = FD.league_entries(env, ["leagues", "popular"]).collect()
    assert [(r.id, r.name) for r in out] == [("1", "Premier League")]


def test_normalize_match_alternative_paths(spark):
    df = spark.createDataFrame([("9", "A", "B", "2", None)], "matchId string, home_team string, away_team string, homeScore string, status string")
    r = FD.normalize_match(df, is_live=True).collect()[0]
    assert (r.fixture_id, r.home_team, r.home_score, r.away_score, r.status) == ("9", "A", 2, None, "LIVE")
    other = spark.createDataFrame([("4", "Text A", "Text B", (1, 2), "HT", "2024-02-03")],
                                  "id string, homeTeam string, awayTeam string, score struct<home:int,away:int>, state string, matchDate string")
    r = FD.normalize_match(other, is_live=False).collect()[0]
    assert (r.home_team, r.away_team, r.home_score, r.away_score, r.status, r.match_date) == ("Text A", "Text B", 1, 2, "HT", "2024-02-03")


def test_a_line_is_a_record(spark, scratch):
    import os
    os.makedirs(scratch)
    with open(f"{scratch}/lines.json", "w") as f:
        f.writelines(json.dumps({"response": {"matches": [{"id": i, "odd": i * 1.5}]}}) + "\n" for i in range(5))
    assert FD.read_json(spark, f"{scratch}/lines.json", FD.MATCH_ENVELOPE).count() == 5
    got = FD.read_matches(spark, f"{scratch}/lines.json").collect()
    assert sorted(r.id for r in got) == list("01234") and {json.loads(r.raw_json)["odd"] for r in got} == {0, 1.5, 3, 4.5, 6}
    with open(f"{scratch}/whole.json", "w") as f:
        json.dump([{"response": {"matches": [{"id": i}]}} for i in range(3)], f, indent=1)
    assert FD.read_matches(spark, f"{scratch}/whole.json", whole_document=True).count() == 3


def test_player_detail_by_id(spark, scratch):
    import os
    os.makedirs(scratch)
    with open(f"{scratch}/d.json", "w") as f:
        f.writelines(json.dumps({"player": {"id": i, "foot": "left", "h": 1.8}}) + "\n" for i in (7, 8))
    landed = FD.read_player_details(spark, f"{scratch}/d.json")
    stored = spark.createDataFrame([("7", '{"id":7,"foot":"right"}')], "player_id string, raw_json string")
    assert json.loads(FD.player_detail(stored, landed, 7).first().raw_json)["foot"] == "right"
    assert json.loads(FD.player_detail(stored, landed, 8).first().raw_json) == {"id": 8, "foot": "left", "h": 1.8}
    assert FD.player_detail(None, landed, 9).count() == 0


def test_batch_stamp_keeps_its_instant_in_any_zone(spark, monkeypatch):
    import time
    at = dt.datetime(2024, 5, 1, 12, tzinfo=dt.timezone.utc)
    for zone in ("America/New_York", "Asia/Tokyo", "UTC"):
        monkeypatch.setenv("TZ", zone)
        time.tzset()
        for ts in (at, at.replace(tzinfo=None), at.astimezone(dt.timezone(dt.timedelta(hours=5)))):
            out = FD.stamp(spark.range(1), ts=ts).select(F.unix_timestamp("ingested_at").alias("s")).first()
            assert out.s == at.timestamp()
    monkeypatch.undo()
    time.tzset()


def test_flags_of_any_json_type(spark):
    rows = [(v,) for v in (None, "", "false", "0", "true", "yes", "2", "False", "[]")]
    df = spark.createDataFrame(rows, "f string")
    assert [r.t for r in df.select(FD.truthy(F.col("f")).alias("t")).collect()] == [False] * 4 + [True] * 3 + [False] * 2


def test_standings_team_ids(spark):
    df = spark.createDataFrame([("10",), ("0",), (None,), ("x",)], "teamId string")
    assert [r.team_id for r in FD.standings_team_ids(df).collect()] == [10]


def test_replay_raw(spark):
    df = spark.createDataFrame([('{"matchId": "55"}', "L")], "raw_json string, league_id string")
    assert FD.replay_raw(df, "matchId string", F.col("league_id") == "L").collect()[0].matchId == "55"


# ----------------------------------------------------------------------------- sinks

def _rows(spark, rows):
    return spark.createDataFrame(rows, "team_id string, v long")


def test_keyed_replace_truth_table(spark, scratch):
    path = f"{scratch}/t"
    assert replace_where(spark, path, None, None) == {"deleted": 0, "written": False}  # neither
    replace_where(spark, path, _rows(spark, [("1", 1), ("2", 2)]))                     # rows only
    assert sorted(tuple(r) for r in read_table(spark, path).collect()) == [("1", 1), ("2", 2)]
    res = replace_where(spark, path, _rows(spark, [("1", 10)]), F.col("team_id") == "1")  # rows + predicate
    assert res["deleted"] == 1
    assert sorted(tuple(r) for r in read_table(spark, path).collect()) == [("1", 10), ("2", 2)]
    assert delete_where(spark, path, F.col("team_id") == "2") == 1                        # predicate only
    assert [tuple(r) for r in read_table(spark, path).collect()] == [("1", 10)]
    replace_where(spark, path, _rows(spark, [("3", 3)]), F.col("no_such_column") == 1)    # failing delete
    assert sorted(tuple(r) for r in read_table(spark, path).collect()) == [("1", 10), ("3", 3)]
    replace_where(spark, path, _rows(spark, [("4", 4)]), F.raise_error(F.lit("on the data")).cast("boolean"))  # fails when run
    assert sorted(tuple(r) for r in read_table(spark, path).collect()) == [("1", 10), ("3", 3), ("4", 4)]
    assert delete_where(spark, path, F.lit(True)) == 3 and read_table(spark, path).count() == 0


def test_delete_null_predicate_keeps_rows(spark, scratch):
    path = f"{scratch}/t"
    replace_where(spark, path, spark.createDataFrame([("1", None), ("2", 5)], "team_id string, v long"))
    assert delete_where(spark, path, F.col("v") > 1) == 1
    assert read_table(spark, path).count() == 1


def test_replace_keys_by_team_name(spark, scratch):
    path = f"{scratch}/perf"
    first = spark.createDataFrame([("a", "Spain", "goals"), ("b", "Italy", "goals")], "player_id string, team_name string, stat_type string")
    replace_keys(spark, path, first, ["team_name"])
    second = spark.createDataFrame([("c", "Spain", "assists")], "player_id string, team_name string, stat_type string")
    res = replace_keys(spark, path, second, ["team_name"])
    assert res["deleted"] == 1
    assert sorted(r.player_id for r in read_table(spark, path).collect()) == ["b", "c"]


def test_keyed_replace_frame_keeps_null_keys(spark):
    cur = spark.createDataFrame([("1", 1), (None, 2), ("2", 3)], "team_id string, v long")
    new = spark.createDataFrame([("1", 9)], "team_id string, v long")
    assert sorted((r.team_id or "", r.v) for r in keyed_replace_frame(cur, new, ["team_id"]).collect()) == [("", 2), ("1", 9), ("2", 3)]


def test_replace_partitions_dynamic_and_empty_skip(spark, scratch):
    path = f"{scratch}/fx"
    replace_partitions(spark.createDataFrame([("a", "L1"), ("b", "L2")], "id string, league_id string"), path, ["league_id"])
    replace_partitions(spark.createDataFrame([("c", "L1")], "id string, league_id string"), path, ["league_id"])
    assert sorted(r.id for r in read_table(spark, path).collect()) == ["b", "c"]
    replace_partitions(spark.createDataFrame([], "id string, league_id string"), path, ["league_id"])
    assert read_table(spark, path).count() == 2


def test_create_tables_idempotent(spark):
    from pyspark.sql import types as T
    schema = {"tl_test_bronze": T.StructType([T.StructField("id", T.StringType()), T.StructField("n", T.LongType())])}
    first = create_tables(spark, schema)
    second = create_tables(spark, schema)
    assert first == ["tl_test_bronze"] and second == []
    spark.sql("DROP TABLE IF EXISTS tl_test_bronze")


def test_declared_tables_are_created_once_and_match_what_is_built(spark):
    from touchline.plans import medallion as M
    from touchline.sources.schemas import table_schema, table_schemas
    spark.sql("CREATE DATABASE IF NOT EXISTS tl_declared")
    try:
        assert len(create_tables(spark, table_schemas(), "tl_declared")) == 10
        assert create_tables(spark, table_schemas(), "tl_declared") == []
        bronze = {n: spark.table(f"tl_declared.{n}") for n in ("bronze_fixtures", "bronze_players", "bronze_top_performers")}
        built = M.build_silver(bronze)
        built |= M.build_gold(built, bronze)
        for name, df in built.items():
            want = {f.name: f.dataType for f in table_schema(name).fields}
            assert {f.name: f.dataType for f in df.schema.fields} == want, name
    finally:
        spark.sql("DROP DATABASE tl_declared CASCADE")


# ----------------------------------------------------------------------------- streaming

SCHEMA = "fixture_id string, status string, ingested_at timestamp, league_id string"


def test_merge_batch_latest_wins_and_idempotent(spark, scratch):
    path = f"{scratch}/silver"
    b1 = spark.createDataFrame([("f1", "NS", TS, "L"), ("f2", "NS", TS, "L")], SCHEMA)
    merge_batch(b1, path, ["fixture_id"], ["ingested_at"], buckets=4)
    late = spark.createDataFrame([("f1", "OLD", TS - dt.timedelta(days=1), "L"),
                                  ("f2", "FT", TS + dt.timedelta(hours=2), "M")], SCHEMA)
    merge_batch(late, path, ["fixture_id"], ["ingested_at"], buckets=4)
    merge_batch(late, path, ["fixture_id"], ["ingested_at"], buckets=4)  # re-delivery
    got = {r.fixture_id: (r.status, r.league_id) for r in read_table(spark, path).collect()}
    assert got == {"f1": ("NS", "L"), "f2": ("FT", "M")}


def test_merge_batch_writes_one_file_per_bucket(spark, scratch):
    """Every bucket a batch touches is rewritten by one task: one file per bucket, however
    many tasks the batch's shuffle had, and a key holding most rows is reduced first."""
    import glob
    path = f"{scratch}/bucketed"
    rows = [(f"f{i % 40}" if i % 3 else "hot", "NS", TS + dt.timedelta(seconds=i), "L") for i in range(600)]
    batch = spark.createDataFrame(rows, SCHEMA).repartition(8)
    merge_batch(batch, path, ["fixture_id"], ["ingested_at"], buckets=6)
    merge_batch(batch, path, ["fixture_id"], ["ingested_at"], buckets=6)
    dirs = glob.glob(f"{path}/_version=*/_bucket=*")
    assert len(dirs) == 12 and all(len(glob.glob(f"{d}/*.parquet")) == 1 for d in dirs)
    got = {r.fixture_id: r.ingested_at for r in read_table(spark, path).collect()}
    assert len(got) == 41 and got["hot"] == TS + dt.timedelta(seconds=597)


def test_partitioned_write_is_rebalanced(spark, scratch):
    """A batch spread over many tasks writes about one file per partition value (AQE
    rebalance), not one per task and value."""
    import glob
    from pyspark.sql import functions as F
    from touchline.sinks.tables import replace_partitions
    rows = spark.range(4000).select((F.col("id") % 5).cast("string").alias("team_id"),
                                    F.col("id").alias("v")).repartition(12)
    assert replace_partitions(rows, f"{scratch}/squads", ["team_id"])
    dirs = glob.glob(f"{scratch}/squads/_version=*/team_id=*")
    assert len(dirs) == 5 and all(len(glob.glob(f"{d}/*.parquet")) == 1 for d in dirs)
    assert read_table(spark, f"{scratch}/squads").count() == 4000


def test_one_teams_replace_touches_one_bucket(spark, scratch):
    import glob
    path = f"{scratch}/t"
    replace_keys(spark, path, _rows(spark, [(str(i), i) for i in range(300)]), ["team_id"], buckets=8)
    before = {f: __import__("os").stat(f).st_mtime_ns for f in glob.glob(f"{path}/_version=*/_bucket=*/*.parquet")}
    assert replace_keys(spark, path, _rows(spark, [("7", 70), ("7", 71)]), ["team_id"], buckets=8) == {"deleted": 1, "written": True}
    after = {f: __import__("os").stat(f).st_mtime_ns for f in glob.glob(f"{path}/_version=*/_bucket=*/*.parquet")}
    assert len({f.rsplit("/", 1)[0] for f in set(before.items()) ^ set(after.items()) for f in [f[0]]}) == 1
    assert sorted(r.v for r in read_table(spark, path).collect() if r.team_id == "7") == [70, 71]
    assert read_table(spark, path).count() == 301


def test_blank_keys_stay_and_an_unnamed_batch_clears(spark, scratch):
    path = f"{scratch}/t"
    replace_keys(spark, path, _rows(spark, [("", 1), (None, 2), ("a", 3)]), ["team_id"])
    replace_keys(spark, path, _rows(spark, [("", 4), ("a", 5)]), ["team_id"])
    assert sorted((r.team_id or "-", r.v) for r in read_table(spark, path).collect()) == [("", 1), ("", 4), ("-", 2), ("a", 5)] or \
        sorted(r.v for r in read_table(spark, path).collect()) == [1, 2, 4, 5]
    assert replace_keys(spark, path, _rows(spark, []), ["team_id"])["written"] is False
    replace_keys(spark, path, _rows(spark, [("", 9)]), ["team_id"])
    assert [r.v for r in read_table(spark, path).collect()] == [9]


def test_append_overwrite_and_probes(spark, scratch):
    from touchline.sinks.tables import append_rows, overwrite_table, qualified, table_has_rows
    append_rows(_rows(spark, [("1", 1)]), f"{scratch}/a")
    append_rows(_rows(spark, [("2", 2)]), f"{scratch}/a")
    assert spark.read.parquet(f"{scratch}/a").count() == 2
    overwrite_table(_rows(spark, [("1", 1), ("2", 2)]), "tl_test_overwrite", ["team_id"])
    overwrite_table(_rows(spark, [("3", 3)]), "tl_test_overwrite", ["team_id"])
    assert [r.v for r in spark.table("tl_test_overwrite").collect()] == [3]
    spark.sql("DROP TABLE tl_test_overwrite")
    from touchline.sinks.tables import table_exists
    assert table_exists(spark, f"{scratch}/a") and not table_exists(spark, f"{scratch}/none") and not table_exists(spark, "tl_test_overwrite")
    assert qualified("t", "c", "d") == "c.d.t" and qualified("t") == "t"
    assert table_has_rows(_rows(spark, [("1", 1)])) and not table_has_rows(_rows(spark, [])) and not table_has_rows(None)
    squads = _json_df(spark, [{"team_id": "9", "team_name": "N", "response": {"list": {"squad": [{"members": [{"id": 1, "name": "A"}]}]}}}], FD.SQUAD_ENVELOPE)
    assert FD.all_players(None, squads).count() == 1 and FD.all_players(_rows(spark, [("1", 1)]), squads).columns == ["team_id", "v"]


def test_upsert_stream_available_now_twice(spark, scratch):
    landing, table, ckpt = f"{scratch}/landing", f"{scratch}/table", f"{scratch}/ckpt"
    spark.createDataFrame([("f1", "NS", TS, "L")], SCHEMA).write.mode("append").parquet(landing)
    stream = spark.readStream.schema(SCHEMA).parquet(landing)
    upsert_stream(stream, table, ["fixture_id"], ["ingested_at"], ckpt, buckets=4).awaitTermination()
    spark.createDataFrame([("f1", "FT", TS + dt.timedelta(hours=2), "L"), ("f1", "OLD", TS - dt.timedelta(days=1), "L"),
                           ("f3", "NS", TS, "M")], SCHEMA).write.mode("append").parquet(landing)
    stream = spark.readStream.schema(SCHEMA).parquet(landing)
    upsert_stream(stream, table, ["fixture_id"], ["ingested_at"], ckpt, buckets=4).awaitTermination()
    stream = spark.readStream.schema(SCHEMA).parquet(landing)  # nothing new: no change
    upsert_stream(stream, table, ["fixture_id"], ["ingested_at"], ckpt, buckets=4).awaitTermination()
    rows = read_table(spark, table).collect()
    assert sorted((r.fixture_id, r.status) for r in rows) == [("f1", "FT"), ("f3", "NS")]


def test_or_default_only_when_empty(spark):
    from touchline.sinks.tables import has_key
    defaults = spark.createDataFrame([("77", "World Cup")], "id string, name string")
    got = spark.createDataFrame([("47", "Premier League")], "id string, name string")
    assert [r.id for r in FD.or_default(got, defaults).collect()] == ["47"]
    empty = spark.createDataFrame([], "id string, name string")
    assert [r.id for r in FD.or_default(empty, defaults).collect()] == ["77"]
    assert has_key(got, "id", "47") and not has_key(got, "id", "48") and not has_key(None, "id", "1")
