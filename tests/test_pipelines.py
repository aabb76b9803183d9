"""Composite answers and the batch jobs (rebuild, ingest, league planning)."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from touchline.plans import catalogue as C
from touchline.plans import medallion as M
from touchline.plans.pipelines import ingest, leagues_needing_load, refresh
from touchline.sinks.tables import read_table

T0 = dt.datetime(2024, 1, 1)


def _players(spark):
    rows = [("1", "Ana", "10", "Spain", "GK", "Spain", 20, 1, "L1"),
            ("2", "Bea", "10", "Spain", "DEF", "Spain", 22, 2, "L1"),
            ("3", "Cris", "11", "Côte d'Ivoire", "MID", "Côte d'Ivoire", None, 3, "L1"),
            ("4", "Dora", "12", "Italy", "FWD", "Italy", 30, 9, "L2")]
    return spark.createDataFrame(rows, "player_id string, name string, team_id string, team_name string, "
                                       "position string, nationality string, age long, jersey_number long, league_id string")


def test_league_overview_one_row(spark):
    r = C.league_overview(_players(spark), "L1", "First League").collect()
    assert len(r) == 1
    r = r[0]
    assert (r.total_players, r.total_teams) == (3, 2)
    assert r.teams == ["Côte d'Ivoire", "Spain"]
    assert r.position_breakdown == {"DEF": 1, "GK": 1, "MID": 1}
    assert [(n.nationality, n["count"]) for n in r.top_nationalities] == [("Spain", 2), ("Côte d'Ivoire", 1)]
    assert r.competition == "First League (League L1)"


def test_team_detail_folded_and_formation(spark):
    teams = M.two_sided_standings(spark.createDataFrame(
        [("11", "Côte d'Ivoire", 2, "12", "Italy", 1, "L1")],
        "home_team_id string, home_team_name string, home_score long, away_team_id string, away_team_name string, away_score long, league_id string"))
    squad, summary, formation = C.team_detail(_players(spark), teams, "cote d ivoire".replace(" d ", " d'"))
    assert [r.name for r in squad.collect()] == ["Cris"]
    assert summary.collect()[0].points == 3
    assert formation.collect()[0].formation == "1-0-1-0"


def test_query_players_fallback_only_with_filters(spark):
    p = _players(spark)
    assert C.query_players(p, "L9").count() == 0                   # no filter: no fallback
    assert [r.name for r in C.query_players(p, "L9", team_name="ital").collect()] == ["Dora"]
    assert [r.name for r in C.query_players(p, "L1", min_age=21).collect()] == ["Bea"]


def test_player_detail_needs_a_filter(spark):
    p = _players(spark)
    assert C.get_player_detail(p, "L1").count() == 0
    assert C.get_player_detail(p, "L2", player_name="show me Cris's profile").collect()[0].player_id == "3"


def test_limits_are_honoured(spark):
    ranked = spark.createDataFrame([(f"p{i}", "t", i, "goals", i + 1) for i in range(80)],
                                   "player_name string, team_name string, goals long, stat_type string, rank long")
    assert C.leaderboard(ranked, "goals", 500).count() == 80
    assert C.top_performers(ranked, "nonsense", 25).count() == 25
    with pytest.raises(ValueError):
        C.top_performers(ranked, "goals", 0)


def _bronze(spark):
    fixtures = spark.createDataFrame(
        [("f1", "1", "A", "2", "B", "2024-01-05T18:00:00Z", "FT", 2, 0, "L1", 2024, T0, "s"),
         ("f1", "1", "A", "2", "B", "2024-01-05T18:00:00Z", "NS", None, None, "L1", 2024, T0 - dt.timedelta(days=1), "s"),
         ("f2", "2", "B", "3", "C", "", "NS", None, None, "L1", 2024, T0, "s")],
        "fixture_id string, home_team_id string, home_team_name string, away_team_id string, away_team_name string, "
        "match_date string, status string, home_score long, away_score long, league_id string, season long, "
        "ingested_at timestamp, source string")
    players = spark.createDataFrame(
        [("p1", "1", "A", "Ann", "CB,LB", "A", 20, 4, T0, "s"), ("p1", "1", "A", "Ann", "GK", "A", 20, 4, T0 - dt.timedelta(days=2), "s")],
        "player_id string, team_id string, team_name string, name string, position string, nationality string, "
        "age long, jersey_number long, ingested_at timestamp, source string")
    perf = spark.createDataFrame(
        [("p1", "Ann", "A", 3, None, None, "goals", T0), ("p1", "Ann", "A", 5, None, None, "goals", T0 - dt.timedelta(days=1))],
        "player_id string, player_name string, team_name string, goals long, assists long, rating double, stat_type string, ingested_at timestamp")
    return {"bronze_fixtures": fixtures, "bronze_players": players, "bronze_top_performers": perf}


def test_run_all_rebuilds_silver_and_gold(spark, scratch):
    status = M.run_all(_bronze(spark), scratch)
    assert set(status.values()) == {"ok"}
    sf = {r.fixture_id: r for r in read_table(spark, f"{scratch}/silver_fixtures").collect()}
    assert sf["f1"].status == "FT" and sf["f1"].is_completed and sf["f1"].match_date == dt.date(2024, 1, 5)
    assert sf["f2"].match_date is None
    sp = read_table(spark, f"{scratch}/silver_players").collect()
    assert [(r.player_id, r.position) for r in sp] == [("p1", "DEF")]
    gp = read_table(spark, f"{scratch}/gold_player_stats").collect()
    assert [r.league_id for r in gp] == ["L1"]
    tp = read_table(spark, f"{scratch}/gold_top_performers").collect()
    assert [(r.goals, r["rank"]) for r in tp] == [(5, 1)]
    ts = {r.team_id: r.points for r in read_table(spark, f"{scratch}/gold_team_summary").collect()}
    assert ts == {"1": 3, "2": 0}


def test_refresh_skips_unreadable_source(spark, scratch):
    def readers(src):
        if src == "broken":
            raise IOError("unreachable")
        return _bronze(spark)
    out = refresh(spark, ["broken", "landed"], readers, scratch)
    assert out["status"] == "complete" and out["source"] == "landed"


def _land(path, objs):
    import os
    os.makedirs(path, exist_ok=True)
    with open(f"{path}/part-0.json", "w") as f:
        for o in objs if isinstance(objs, list) else [objs]:
            f.write(json.dumps(o) + "\n")


def test_ingest_landed_feeds(spark, scratch):
    import os
    land = os.path.join(scratch, "landing")
    _land(f"{land}/matches", {"response": {"matches": [
        {"id": 1, "home": {"id": 10, "name": "Spain", "score": 1}, "away": {"id": 20, "name": "Italy", "score": 0},
         "status": {"utcTime": "2024-06-01T19:00:00Z", "reason": {"short": "FT"}}}]}})
    _land(f"{land}/squads", [
        {"team_id": "10", "team_name": "Spain", "response": {"list": {"squad": [{"title": "gk", "members": [{"id": 5, "name": "Simon", "positionIdsDesc": "GK"}]}]}}},
        {"team_id": "99", "team_name": "Elsewhere", "response": {"list": {"squad": [{"title": "gk", "members": [{"id": 6, "name": "X"}]}]}}}])
    _land(f"{land}/scorers", [{"id": 5, "name": "Simon", "teamId": 10, "teamName": "Spain", "goals": 2}])
    bronze = os.path.join(scratch, "bronze")
    status = ingest(spark, {"matches": f"{land}/matches", "squads": f"{land}/squads", "scorers": f"{land}/scorers"},
                    bronze, league_id=42, season=2024)
    assert status == {"fixtures": "ok", "squads": "ok", "performers": "ok"}
    fx = read_table(spark, f"{bronze}/bronze_fixtures").collect()
    assert [(r.fixture_id, r.league_id) for r in fx] == [("1", "42")]
    pl = read_table(spark, f"{bronze}/bronze_players").collect()
    assert [(r.player_id, r.team_id) for r in pl] == [("5", "10")]   # team 99 not discovered
    perf = read_table(spark, f"{bronze}/bronze_top_performers").collect()
    assert [(r.player_id, r.goals) for r in perf] == [("5", 2)]


def test_leagues_needing_load(spark):
    req = spark.createDataFrame([("switch to la liga",), ("premier league please",), ("nothing",)], "name string")
    aliases = spark.createDataFrame([("la liga", "140", 1), ("premier league", "47", 2)], "alias string, id string, priority int")
    loaded = spark.createDataFrame([("47",)], "league_id string")
    assert [r.league_id for r in leagues_needing_load(req, aliases, loaded).collect()] == ["140"]


def test_catalogue_on_written_gold_prunes_partitions(spark, scratch):
    M.run_all(_bronze(spark), scratch)
    players = read_table(spark, f"{scratch}/gold_player_stats")
    q = C.team_roster(players, "L1", "a")
    plan = q._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(league_id" in plan and "(league_id" in plan
    assert [r.player_id for r in q.collect()] == ["p1"]
    fb = C.query_players(players, "L9", team_name="a")      # scope misses: fallback to all leagues
    assert [r.player_id for r in fb.collect()] == ["p1"]


def test_ingest_loads_every_team_and_keeps_whole_records(spark, scratch):
    """60 teams over many lines: all squads are stored, and raw_json holds fields no schema names."""
    land, bronze = f"{scratch}/landing", f"{scratch}/bronze"
    _land(f"{land}/matches", [{"response": {"matches": [
        {"id": i, "pageUrl": f"/m/{i}", "home": {"id": 2 * i, "name": f"H{i}"}, "away": {"id": 2 * i + 1, "name": f"A{i}"}}]}} for i in range(1, 31)])
    _land(f"{land}/squads", [{"team_id": str(t), "team_name": "caller", "response": {"list": {"name": f"Team {t}", "squad": [
        {"title": "x", "members": [{"id": t, "name": f"P{t}", "height": 180.5}, {"id": 1000 + t, "name": "coach", "excludeFromRanking": "yes"}]}]}}}
        for t in range(2, 62)])
    status = ingest(spark, {"matches": f"{land}/matches", "squads": f"{land}/squads"}, bronze, league_id=1, season=2024)
    assert status == {"fixtures": "ok", "squads": "ok"}
    fx = read_table(spark, f"{bronze}/bronze_fixtures").collect()
    assert len(fx) == 30 and all(json.loads(r.raw_json)["pageUrl"] == f"/m/{r.fixture_id}" for r in fx)
    players = read_table(spark, f"{bronze}/bronze_players").collect()
    assert {r.team_id for r in players} == {str(t) for t in range(2, 62)} and len(players) == 60
    assert all(r.team_name == f"Team {r.team_id}" and json.loads(r.raw_json)["height"] == 180.5 for r in players)


def test_rebuild_after_a_league_moves_equals_a_fresh_build(spark, scratch):
    first = _bronze(spark)
    M.run_all(first, f"{scratch}/twice")
    moved = dict(first, bronze_fixtures=first["bronze_fixtures"].withColumn("league_id", F.lit("L2")))
    M.run_all(moved, f"{scratch}/twice")
    M.run_all(moved, f"{scratch}/fresh")
    for t in ("gold_player_stats", "gold_team_summary", "gold_match_results"):
        a, b = (sorted(map(str, read_table(spark, f"{scratch}/{d}/{t}").collect())) for d in ("twice", "fresh"))
        assert a == b and a


def test_switch_league_skips_loaded_and_reports_partial(spark):
    from touchline.plans.pipelines import switch_league
    aliases = spark.createDataFrame([("la liga", "140", 1), ("premier league", "47", 2)], "alias string, id string, priority int")
    loaded = spark.createDataFrame([("47",)], "league_id string")
    found = spark.createDataFrame([("88", "Eredivisie"), ("89", "Eredivisie Women")], "id string, name string")
    calls = []

    def load(lid):
        calls.append(lid)
        return {"fixtures": "ok", "squads": "error: timeout"}
    assert switch_league("premier league", aliases, loaded, load, lambda l: {})["ingested"] is False
    out = switch_league("la liga", aliases, loaded, load, lambda l: {"gold": "ok"})
    assert out["status"] == "partial" and out["failed"] == ["squads"] and calls == ["140"]
    assert switch_league("nowhere", aliases, loaded, load, lambda l: {}, search=found)["status"] == "error"
    assert switch_league("eredivisie", aliases, loaded, load, lambda l: {}, search=found)["league_id"] == "88"


def test_match_buckets_hold_every_match_and_page_on_request(spark):
    rows = [(f"l{i}", "A", "B", 0, 0, "1H", dt.date(2024, 5, 1 + i), "L1", False) for i in range(25)]
    rows += [(f"u{i}", "A", "B", None, None, "NS", dt.date(2024, 6, 1 + i), "L1", False) for i in range(8)]
    rows += [(f"r{i}", "A", "B", 1, 0, "FT", dt.date(2024, 4, 1) + dt.timedelta(days=i), "L1", True) for i in range(50)]
    rows += [("old", "A", "B", 1, 0, "FT", dt.date(2020, 1, 1), "L2", True), ("past", "A", "B", None, None, "NS", dt.date(2020, 1, 1), "L2", False)]
    f = spark.createDataFrame(rows, "fixture_id string, home_team_name string, away_team_name string, home_score long, away_score long, "
                                    "status string, match_date date, league_id string, is_completed boolean")
    leagues = spark.createDataFrame([("L1", "One")], "league_id string, display string")
    got = C.match_buckets(f, leagues, as_of="2024-05-20").collect()
    assert {b: sum(r.bucket == b for r in got) for b in ("live", "upcoming", "recent")} == {"live": 25, "upcoming": 8, "recent": 2}
    assert {r.fixture_id: r.league_name for r in got if r.bucket == "recent"} == {"r49": "One", "old": "League L2"}
    page = C.match_buckets(f, leagues, as_of="2024-05-20", limit=1).collect()
    assert sorted((r.bucket, r.fixture_id) for r in page) == [("live", "l0"), ("recent", "r49"), ("upcoming", "u0")]


def _squad(team, *players, **more):
    return {"team_id": team, "team_name": f"T{team}", "response": {"list": {"squad": [{"title": "x", "members": [{"id": p, "name": f"P{p}"} for p in players]}]}}, **more}


def _lines(path, lines):
    import os
    os.makedirs(path, exist_ok=True)
    with open(f"{path}/part-0.json", "w") as f:
        f.writelines((x if isinstance(x, str) else json.dumps(x)) + "\n" for x in lines)


def _match(i, home, away):
    return {"id": i, "home": {"id": home, "name": f"T{home}"}, "away": {"id": away, "name": f"T{away}"}}


def test_what_cannot_be_read_is_set_aside_and_the_rest_is_written(spark, scratch):
    land, bronze = f"{scratch}/landing", f"{scratch}/bronze"
    _lines(f"{land}/matches", [{"response": {"matches": [_match(1, 10, 20), "odd", None]}}, '{"response": {"matches"', "", {"message": "limit reached"},
                               {"response": {"matches": [_match(2, 10, 30)]}}, {"response": {"matches": []}}])
    _lines(f"{land}/squads", [_squad("10", 1, 2), '{"team_id": "20", broken', _squad("30", 3), {"team_id": "40", "message": "error"}, _squad("", 9),
                              {"team_id": "30", "response": {"list": {"squad": [7, {"title": "no members"}]}}}])
    _lines(f"{land}/scorers", [{"id": 1, "name": "P1", "teamName": "T10", "goals": 3}, "not json", {"response": {"players": [{"id": 2, "name": "P2", "teamName": "T10", "goals": 1}]}}])
    counts = {}
    status = ingest(spark, {"matches": f"{land}/matches", "squads": f"{land}/squads", "scorers": f"{land}/scorers"}, bronze, 7, 2024, counts=counts)
    assert set(status.values()) == {"ok"}
    assert counts == {"matches": {"records": 6, "kept": 2, "set_aside": 4}, "squads": {"records": 7, "kept": 3, "set_aside": 4},
                      "performers": {"records": 3, "kept": 2, "set_aside": 1}}
    assert sorted(r.fixture_id for r in read_table(spark, f"{bronze}/bronze_fixtures").collect()) == ["1", "2"]
    assert sorted((r.team_id, r.player_id) for r in read_table(spark, f"{bronze}/bronze_players").collect()) == [("10", "1"), ("10", "2"), ("30", "3")]
    assert sorted(r.goals for r in read_table(spark, f"{bronze}/bronze_top_performers").collect()) == [1, 3]
    aside = read_table(spark, f"{bronze}/quarantine").collect()
    assert sorted((r.feed, r.reason) for r in aside) == sorted([
        ("matches", "not an object"), ("matches", "not an object"), ("matches", "not JSON"), ("matches", "no list at $.response.matches"),
        ("squads", "not JSON"), ("squads", "no list at $.response.list.squad"), ("squads", "no team id"), ("squads", "not an object"), ("performers", "not JSON")])
    assert all(r.file.endswith("part-0.json") and r.text and r.league_id == "7" for r in aside)
    assert '{"response": {"matches"' in [r.text for r in aside]


def test_a_stored_squad_stands_in_for_a_missing_one(spark, scratch):
    land, bronze = f"{scratch}/landing", f"{scratch}/bronze"
    _lines(f"{land}/matches", [{"response": {"matches": [_match(1, 10, 20), _match(2, 10, 30)]}}])
    _lines(f"{land}/first", [_squad("10", 1), _squad("20", 2, 22), _squad("99", 9)])
    assert set(ingest(spark, {"matches": f"{land}/matches", "squads": f"{land}/first"}, bronze, 7, 2024).values()) == {"ok"}
    _lines(f"{land}/second", [_squad("10", 11), '{"team_id": "20", broken'])
    assert set(ingest(spark, {"matches": f"{land}/matches", "squads": f"{land}/second"}, bronze, 7, 2024).values()) == {"ok"}
    for t in ("bronze_players", "bronze_team_squads"):
        got = read_table(spark, f"{bronze}/{t}").collect()
        assert sorted((r.team_id, r.player_id) for r in got) == [("10", "11"), ("20", "2"), ("20", "22")]
        assert all(json.loads(r.raw_json)["id"] == int(r.player_id) for r in got)


def test_performers_replace_their_own_league_only(spark, scratch):
    land, bronze = f"{scratch}/landing", f"{scratch}/bronze"

    def load(league, *goals):
        _lines(f"{land}/{league}{goals}", [{"id": g, "name": f"P{g}", "teamName": "Rovers", "goals": g} for g in goals])
        _lines(f"{land}/none", [{"response": {"matches": []}}])
        return ingest(spark, {"matches": f"{land}/none", "squads": f"{land}/none", "scorers": f"{land}/{league}{goals}"}, bronze, league, 2024)
    load("A", 1, 2)
    load("B", 3)
    load("A", 4)
    got = read_table(spark, f"{bronze}/bronze_top_performers").collect()
    assert sorted((r.league_id, r.goals) for r in got) == [("A", 4), ("B", 3)]


def test_a_second_run_goes_on_after_the_failed_step(spark, scratch, monkeypatch):
    from touchline.plans import pipelines
    land, bronze = f"{scratch}/landing", f"{scratch}/bronze"
    _lines(f"{land}/matches", [{"response": {"matches": [_match(1, 10, 20)]}}])
    _lines(f"{land}/squads", [_squad("10", 1), _squad("20", 2)])
    feeds = {"matches": f"{land}/matches", "squads": f"{land}/squads"}

    def broken(*a, **k):
        raise OSError("squads down")
    monkeypatch.setattr(pipelines, "member_records", broken)
    first = ingest(spark, feeds, bronze, 7, 2024, run="monday")
    assert first["fixtures"] == "ok" and first["squads"].startswith("error")
    monkeypatch.undo()
    monkeypatch.setattr(pipelines, "match_records", broken)  # the second run must not read the match feed
    assert ingest(spark, feeds, bronze, 7, 2024, run="monday") == {"fixtures": "ok", "squads": "ok"}
    assert sorted(r.player_id for r in read_table(spark, f"{bronze}/bronze_players").collect()) == ["1", "2"]
    assert sorted((r.run, r.step) for r in read_table(spark, f"{bronze}/ingest_steps").collect()) == [("monday", "fixtures"), ("monday", "squads")]
    assert ingest(spark, feeds, bronze, 7, 2024, run="tuesday")["fixtures"].startswith("error")


def test_landed_records_are_taken_apart_once(spark, scratch):
    from touchline.sources import feeds as FD
    lines = ['{"response": {"matches": [{"id": 1, "home": {"id": 2}}, 7, null, {}]}}', '{"response": {"matches": []}}', '{"response": {"matches": 3}}', "[1", "null", "[]"]
    spark.createDataFrame([(x,) for x in lines], "value string").write.text(f"{scratch}/landed")
    rows = FD.match_records(spark, f"{scratch}/landed")
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("$.response.matches, ArrayType") == 1 and "MapType" not in plan
    got = sorted(((r.id, r.raw_json, r.reason) for r in rows.collect()), key=str)
    at = "no list at $.response.matches"
    assert got == sorted([("1", '{"home":{"id":2},"id":1}', None), (None, "{}", None), (None, "7", "not an object"), (None, "null", "not an object"),
                          (None, None, at), (None, None, at), (None, None, "not JSON")], key=str)


def test_only_what_is_set_aside_keeps_its_text_in_the_checkpoint(spark, scratch, monkeypatch):
    from touchline.plans.pipelines import ingest
    from touchline.sinks.tables import read_table
    lines = ['{"response": {"matches": [{"id": 1}, {"id": 2}, 7]}}', "{"]
    spark.createDataFrame([(x,) for x in lines], "value string").write.text(f"{scratch}/landed")
    kept, kind = [], type(spark.range(1))
    real = kind.checkpoint

    def checkpoint(self, *args, **more):
        kept.append(real(self, *args, **more))
        return kept[-1]
    monkeypatch.setattr(kind, "checkpoint", checkpoint)
    assert ingest(spark, {"matches": f"{scratch}/landed"}, f"{scratch}/b", 1, 2024)["fixtures"] == "ok"
    rows = [r for df in kept if "reason" in df.columns for r in df.collect()]
    assert sorted((r.reason is None, r.text is None, r.file is None) for r in rows) == [(False, False, False)] * 2 + [(True, True, True)] * 2
    assert sorted(r.text for r in read_table(spark, f"{scratch}/b/quarantine").collect()) == sorted([lines[0], "{"])
