"""Operators on hand-written rows: nulls, ties, empty input, skew shapes."""

import datetime as dt
import unicodedata

from pyspark.sql import Window
from pyspark.sql import functions as F

from touchline.functions import fold, fold_text, folded_contains, position_code, position_from_word, winner
from touchline.operators import (best_per_key, discover_entities, first_per_group,
                                 global_row_number, latest_per_key, preferred_first, rank_by_metric,
                                 resolve_alias, side_pairs, substring_join, two_sided_standings,
                                 with_fallback)
from touchline.plans.catalogue import team_formation

T0 = dt.datetime(2024, 1, 1)


def test_latest_per_key_picks_newest_and_breaks_ties(spark):
    rows = [("f1", "NS", T0, 1), ("f1", "FT", T0 + dt.timedelta(hours=1), 1),
            ("f2", "NS", T0, 1), ("f2", "1H", T0, 2), ("f3", None, None, 1)]
    df = spark.createDataFrame(rows, "fixture_id string, status string, ingested_at timestamp, seq int")
    out = {r.fixture_id: r.status for r in latest_per_key(df, ["fixture_id"], ["ingested_at", "seq"]).collect()}
    assert out == {"f1": "FT", "f2": "1H", "f3": None}


def test_latest_per_key_null_order_loses(spark):
    df = spark.createDataFrame([("k", "old", T0), ("k", "nul", None)], "k string, v string, ts timestamp")
    assert latest_per_key(df, ["k"], ["ts"]).collect()[0].v == "old"


def test_latest_per_key_empty(spark):
    df = spark.createDataFrame([], "k string, v string, ts timestamp")
    assert latest_per_key(df, ["k"], ["ts"]).count() == 0


def test_best_per_key_metric_nulls_last(spark):
    rows = [("p1", 27, None, None, "goals", T0), ("p1", 16, None, None, "goals", T0 + dt.timedelta(days=1)),
            ("p1", None, None, None, "goals", T0 + dt.timedelta(days=2)),
            ("p2", None, None, 7.5, "rating", T0), ("p2", None, None, 7.5, "rating", T0 + dt.timedelta(days=1))]
    df = spark.createDataFrame(rows, "player_id string, goals long, assists long, rating double, stat_type string, ingested_at timestamp")
    m = {"goals": "goals", "assists": "assists", "rating": "rating"}
    out = {(r.player_id, r.stat_type): (r.goals, r.rating, r.ingested_at)
           for r in best_per_key(df, ["player_id"], m, "stat_type").collect()}
    assert out[("p1", "goals")][0] == 27
    assert out[("p2", "rating")][2] == T0 + dt.timedelta(days=1)


def _fixtures(spark, rows):
    return spark.createDataFrame(rows, "home_team_id string, home_team_name string, home_score long, "
                                       "away_team_id string, away_team_name string, away_score long, league_id string")


def test_two_sided_standings_counts_and_null_scores(spark):
    f = _fixtures(spark, [("1", "A", 2, "2", "B", 1, "L"), ("2", "B", 0, "1", "A", 0, "L"),
                          ("1", "A", None, "2", "B", 3, "L")])
    out = {r.team_id: r for r in two_sided_standings(f).collect()}
    a = out["1"]
    assert (a.matches_played, a.wins, a.draws, a.losses) == (3, 1, 1, 0)
    assert (a.goals_for, a.goals_against, a.goal_difference, a.points) == (2, 4, -2, 4)
    b = out["2"]
    assert (b.wins, b.draws, b.losses, b.points) == (0, 1, 1, 1)


def test_standings_equals_two_branch_union(spark):
    f = _fixtures(spark, [(str(i % 4), f"T{i % 4}", i % 3, str((i + 1) % 4), f"T{(i + 1) % 4}", (i * 7) % 4, "L" + str(i % 2))
                          for i in range(50)])
    one = two_sided_standings(f)
    home = f.groupBy(F.col("home_team_id").alias("team_id"), "league_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum("home_score").alias("gf"))
    away = f.groupBy(F.col("away_team_id").alias("team_id"), "league_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum("away_score").alias("gf"))
    two = home.unionByName(away).groupBy("team_id", "league_id").agg(F.sum("n").alias("n"), F.sum("gf").alias("gf"))
    a = sorted((r.team_id, r.league_id, r.matches_played, r.goals_for) for r in one.collect())
    b = sorted((r.team_id, r.league_id, r.n, r.gf) for r in two.collect())
    assert a == b


def test_standings_single_scan(spark, tmp_path):
    f = _fixtures(spark, [("1", "A", 1, "2", "B", 0, "L")])
    p = str(tmp_path / "f")
    f.write.parquet(p)
    plan = two_sided_standings(spark.read.parquet(p))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1


def test_side_pairs_union_distinct(spark):
    f = _fixtures(spark, [("1", "A", 1, "2", "B", 0, "L"), ("2", "B", 1, "1", "A", 0, "L"), ("1", "A", 1, "1", "A", 1, "M")])
    assert sorted(tuple(r) for r in side_pairs(f).collect()) == [("1", "L"), ("1", "M"), ("2", "L")]


def test_winner_and_draw(spark):
    df = spark.createDataFrame([(2, 1), (1, 2), (1, 1)], "h long, a long")
    got = [r.w for r in df.select(winner("h", "a", F.lit("H"), F.lit("A")).alias("w")).collect()]
    assert got == ["H", "A", "Draw"]


def test_rank_by_metric_full_and_topk(spark):
    rows = [(f"p{i}", "n", "t", i % 5, None, None, "goals") for i in range(40)] + \
           [(f"p{i}", "n", "t", None, None, float(i % 7), "rating") for i in range(30)]
    df = spark.createDataFrame(rows, "player_id string, player_name string, team_name string, goals long, assists long, rating double, stat_type string")
    m = {"goals": "goals", "assists": "assists", "rating": "rating"}
    full = rank_by_metric(df, "stat_type", m)
    w = Window.partitionBy("stat_type").orderBy(
        F.coalesce(F.col("goals").cast("double"), F.col("rating")).desc(), F.col("player_id"))
    expect = df.withColumn("r", F.row_number().over(w))
    got = {(r.player_id, r.stat_type): r.rank for r in full.collect()}
    exp = {(r.player_id, r.stat_type): r.r for r in expect.collect()}
    assert got == exp
    top = rank_by_metric(df, "stat_type", m, top_k=3).collect()
    assert sorted((r.stat_type, r.rank) for r in top) == [("goals", 1), ("goals", 2), ("goals", 3),
                                                          ("rating", 1), ("rating", 2), ("rating", 3)]


def test_global_row_number_matches_window_under_skew(spark):
    # one group holds most rows: numbering must still be exact
    df = spark.range(5000).withColumn("g", F.when(F.col("id") % 10 < 8, F.lit("hot")).otherwise((F.col("id") % 10).cast("string")))
    df = df.withColumn("v", (F.col("id") * 7919) % 1000)
    order = [F.col("v").desc(), F.col("id").asc()]
    got = global_row_number(df, order, group="g", name="rk")
    exp = df.withColumn("rk2", F.row_number().over(Window.partitionBy("g").orderBy(*order)))
    assert got.join(exp, "id").filter(F.col("rk") != F.col("rk2")).count() == 0


def test_with_fallback_hit_and_miss(spark):
    df = spark.createDataFrame([("a", "L1", 1), ("b", "L2", 1), ("c", None, 2)], "n string, league_id string, x int")
    hit = with_fallback(df, F.col("league_id") == "L1", F.col("x") == 1)
    assert [r.n for r in hit.collect()] == ["a"]
    miss = with_fallback(df, F.col("league_id") == "L9", F.col("x") == 1)
    assert sorted(r.n for r in miss.collect()) == ["a", "b"]
    off = with_fallback(df, F.col("league_id") == "L9", fallback=False)
    assert off.count() == 0


def test_with_fallback_plan_has_no_join(spark):
    df = spark.range(10).withColumn("league_id", (F.col("id") % 2).cast("string"))
    plan = with_fallback(df, F.col("league_id") == "1")._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Subquery" in plan


def test_preferred_first_nulls(spark):
    df = spark.createDataFrame([("a", "L2", 20), ("b", "L1", 30), ("c", "L1", None)], "n string, league_id string, age long")
    got = [r.n for r in preferred_first(df, F.col("league_id") == "L1", [F.col("age").asc_nulls_first()], 3).collect()]
    assert got == ["c", "b", "a"]


def test_first_per_group_sees_every_group(spark):
    """One busy league holds the latest hundred rows; the others still show theirs."""
    rows = [(i, "L0", 1000 + i) for i in range(100)] + [(500, "L1", 5), (501, "L2", 6), (502, None, 7)]
    df = spark.createDataFrame(rows, "id long, league_id string, d long")
    order = [F.col("d").desc(), F.col("id")]
    assert sorted(r.id for r in first_per_group(df, ["league_id"], order).collect()) == [99, 500, 501, 502]
    assert [r.id for r in first_per_group(df, ["league_id"], order, limit=2).collect()] == [99, 502]


def test_row_numbers_keep_null_groups(spark):
    from touchline.operators.rank import global_row_number
    df = spark.createDataFrame([(None, 1), ("a", 2), (None, 3), ("a", 4)], "g string, v long")
    got = sorted((r.g or "", r.v, r["rank"]) for r in global_row_number(df, [F.col("v").asc()], group="g").collect())
    assert got == [("", 1, 1), ("", 3, 2), ("a", 2, 1), ("a", 4, 2)]


def test_every_script_finds_itself(spark):
    from touchline.functions.text import folded_contains
    names = ["손흥민", "ガンバ大阪", "Ｍüller", "x²", "Σωκράτης", "Чайка Йод", "Nguyễn", "½", "Łukasz", "ﬁnal", "مُحَمَّد"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    for n in names:
        assert n in {r.n for r in df.filter(folded_contains("n", n)).collect()}, n
    assert [r.n for r in df.filter(folded_contains("n", "muller")).collect()] == ["Ｍüller"]


def test_fold_matches_python_fold(spark):
    words = ["Mbappé", "Rüdiger", "Vinícius", "Łukasz", "Ødegaard", "Côte d'Ivoire", "ĲSSEL", "ﬁnal", "Ǆemal"]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    got = [r.f for r in df.select(fold("w").alias("f")).collect()]
    assert got == [fold_text(w) for w in words]


def test_fold_every_block_letter_and_decomposed_text(spark):
    """Fast path (no rare letter, no mark) and slow path give the Python fold for every
    letter of the folded blocks, alone and inside longer text, and for decomposed input."""
    from touchline.functions.text import _EXPANDING_BLOCKS
    letters = [chr(cp) for lo, hi in _EXPANDING_BLOCKS for cp in range(lo, hi + 1)
               if unicodedata.category(chr(cp)) not in ("Cn", "Cs")]
    words = letters + ["Ab " + ch + " Zé" for ch in letters]
    words += [unicodedata.normalize("NFD", "Mbappé Ødegaard"), "plain ascii TEXT", "", None,
              "ĳ" * 3 + "x" + "ﬃ", "e\u0301\u0301"]
    df = spark.createDataFrame([(i, w) for i, w in enumerate(words)], "i int, w string")
    got = {r.i: r.f for r in df.select("i", fold("w").alias("f")).collect()}
    want = {i: (None if w is None else fold_text(w)) for i, w in enumerate(words)}
    assert got == want


def test_folded_contains_is_literal(spark):
    df = spark.createDataFrame([("100%_x",), ("100ab",)], "w string")
    assert df.filter(folded_contains("w", "0%_")).count() == 1


def test_position_maps(spark):
    df = spark.createDataFrame([("CDM,CM",), (" cb ",), (None,), ("Coach",), ("striker",)], "p string")
    got = [r.c for r in df.select(position_code("p").alias("c")).collect()]
    assert got == ["MID", "DEF", "UNKNOWN", "UNKNOWN", "FWD"]
    words = spark.createDataFrame([("Midfielders",), (" Back ",), ("wing back",)], "p string")
    got = [r.c for r in words.select(position_from_word("p").alias("c")).collect()]
    assert got == ["MID", "DEF", "WING BACK"]


def test_resolve_alias_longest_first(spark):
    log = spark.createDataFrame([("uefa world cup qualification",), ("switch to la liga",), ("nothing",)], "text string")
    aliases = spark.createDataFrame([("world cup", "77", 1), ("wc qualification", "10195", 2), ("qualification", "10195", 3),
                                     ("la liga", "140", 4)], "alias string, id string, priority int")
    got = {r.text: r.resolved_id for r in resolve_alias(log, "text", aliases).collect()}
    assert got == {"uefa world cup qualification": "10195", "switch to la liga": "140", "nothing": None}
    ordered = {r.text: r.resolved_id for r in resolve_alias(log, "text", aliases, longest_first=False).collect()}
    assert ordered["uefa world cup qualification"] == "77"


def test_resolve_alias_short_aliases(spark):
    log = spark.createDataFrame([("uefa world cup qualification",), ("switch to la liga",), ("nothing",),
                                 ("x marks",), ("",), (None,)], "text string")
    aliases = spark.createDataFrame([("world cup", "77", 1), ("wc qualification", "10195", 2),
                                     ("qualification", "10195", 3), ("la liga", "140", 4), ("la", "9", 5),
                                     ("x", "8", 6), ("", "0", 0), ("World Cup", "78", 1)],
                                    "alias string, id string, priority int")
    got = {r.text: r.resolved_id for r in resolve_alias(log, "text", aliases).collect()}
    assert got == {"uefa world cup qualification": "10195", "switch to la liga": "140", "nothing": None, "x marks": "8", "": None, None: None}


def test_substring_join_equals_brute_force(spark):
    names = ["mbappe", "kylian mbappe", "vinicius jr", "rodrygo", "ab", "a", "xyz"]
    terms = ["mbap", "pe", "a", "vinicius", "zz", "jr", "kylian mbappe", "rod"]
    d = spark.createDataFrame([(str(i), n) for i, n in enumerate(names)], "pid string, text string")
    t = spark.createDataFrame([(x,) for x in terms], "term string")
    got = sorted((r.term, r.pid) for r in substring_join(t, "term", d, "text").collect())
    exp = sorted((x, str(i)) for x in terms for i, n in enumerate(names) if x in n)
    assert got == exp


def test_discover_entities_degenerate_sides(spark):
    schema = "home_team_id string, home_team_name string, away_team_id string, away_team_name string, ingested_at long"
    rows = [(None, None, "5", "Five", 1), ("10", "", "10", "Ten", 2), ("7", "Seven", None, None, 3),
            ("5", "Renamed", "7", "S2", 4)]
    out = {r.id: r.name for r in discover_entities(spark.createDataFrame(rows, schema)).collect()}
    assert out == {"5": "Five", "10": "10", "7": "Seven"}
    capped = discover_entities(spark.createDataFrame(rows, schema), first=2).collect()
    assert [r.id for r in capped] == ["5", "10"]


def test_formation(spark):
    players = spark.createDataFrame([("T", "GK"), ("T", "DEF"), ("T", "DEF"), ("T", "MID"), ("T", "FWD"),
                                     ("U", "GK"), ("U", None)], "team_name string, position string")
    out = {r.team_name: (r.formation, r.total_players, r.n_unknown) for r in team_formation(players).collect()}
    assert out["T"] == ("1-2-1-1", 5, 0)
    assert out["U"] == ("—", 2, 1)


def test_substring_min_equals_brute_force(spark):
    from touchline.operators.resolve import substring_min
    names = ["mbappe", "kylian mbappe", "vinicius jr", "rodrygo", "ab", "a", "xyz", "abc"]
    terms = ["mbap", "pe", "a", "vinicius", "zz", "jr", "kylian mbappe", "rod", "abc", "b"]
    d = spark.createDataFrame([(f"{i:02d}", n) for i, n in enumerate(names)], "pid string, text string")
    t = spark.createDataFrame([(x,) for x in terms], "term string")
    got = {r.term: r.pid for r in substring_min(t, "term", d, "pid", "text").collect()}
    exp = {}
    for x in terms:
        hits = [f"{i:02d}" for i, n in enumerate(names) if x in n]
        if hits:
            exp[x] = min(hits)
    assert got == exp


def test_global_row_number_consistent_across_many_partitions(spark):
    # large enough that range bounds come from sampling: positions and partition counts must
    # still describe the same partitioning (regression: two independently sampled exchanges)
    df = spark.range(200000).withColumn("v", (F.col("id") * 2654435761) % 1000003)
    df = df.withColumn("g", (F.col("id") % 3).cast("string"))
    order = [F.col("v").desc(), F.col("id").asc()]
    got = global_row_number(df, order, group="g", name="rk", num_partitions=16)
    exp = df.withColumn("rk2", F.row_number().over(Window.partitionBy("g").orderBy(*order)))
    assert got.join(exp, "id").filter(F.col("rk") != F.col("rk2")).count() == 0
    assert got.agg(F.min("rk")).collect()[0][0] == 1


def test_histogram_rank_matches_a_window(spark):
    """Ties by the thousand, outliers, negative, zero, infinite and NaN metrics, null tie-breakers."""
    import random

    from pyspark.sql import Window
    from touchline.operators.rank import histogram_rank
    rnd = random.Random(3)
    values = [0.0, -0.0, 1.0, 1.0, 2.0, -3.5, 1e300, -1e300, 5e-324, float("inf"), float("-inf"), float("nan")]
    rows = [(rnd.choice("ab"), rnd.choice(values) if i % 3 else rnd.choice([7.0, rnd.uniform(6, 9), rnd.uniform(-1e9, 1e9)]), f"p{i:05d}" if i else None)
            for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, m double, id string").repartition(7)
    want = df.withColumn("rk", F.row_number().over(Window.partitionBy("g").orderBy(F.col("m").desc(), F.col("id").asc())))
    got = histogram_rank(df, "g", "m", ["id"], "rk")
    assert sorted((r.id or "", r.rk) for r in got.collect()) == sorted((r.id or "", r.rk) for r in want.collect())
    by_number = histogram_rank(df.withColumn("k", F.hash("id").cast("bigint")), "g", "m", ["k", "id"], "rk")
    assert sorted(r.rk for r in by_number.where("g = 'a'").collect()) == list(range(1, 1 + sum(r[0] == "a" for r in rows)))


def test_bins_fall_as_the_metric_rises(spark):
    from touchline.operators.rank import metric_bin
    rows = spark.range(4000).select(((F.col("id") - 2000) * F.col("id") / 977.0).alias("m"))
    got = rows.select("m", metric_bin(F.col("m")).alias("b")).orderBy("m").collect()
    assert all(x.b >= y.b for x, y in zip(got, got[1:])) and len({r.b for r in got}) > 1000


def test_distinct_sketches_merge(spark):
    from touchline.operators.distinct import distinct_estimates, distinct_sketches
    df = spark.range(60000).select((F.col("id") % 3).alias("league"), (F.col("id") % 20011).alias("player")).withColumn(
        "player", F.when(F.col("player") > 0, F.col("player")))
    parts = distinct_sketches(df, ["league"], "player")
    per = {r.league: r["distinct"] for r in distinct_estimates(parts, ["league"]).collect()}
    exact = {r.league: r.n for r in df.groupBy("league").agg(F.count_distinct("player").alias("n")).collect()}
    assert all(abs(per[k] - n) < 0.06 * n for k, n in exact.items())
    assert abs(distinct_estimates(parts).first()["distinct"] - 20010) < 0.06 * 20010
