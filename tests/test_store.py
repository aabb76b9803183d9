"""Tables behind a pointer: swap, stored bucket layout, splitting, conflicts."""

import pytest
from pyspark.sql import functions as F

from touchline.sinks import files
from touchline.sinks.store import BUCKET, Conflict, Store
from touchline.sinks.tables import read_table, write_squad_batch


def rows(spark, pairs):
    return spark.createDataFrame(pairs, "team_id string, n long")


def pairs(df):
    return sorted((r.team_id or "", r.n) for r in df.collect())


def members(spark, tag, teams=("1", "2")):
    data = [(t, f"T{t}", f"{tag}{t}", "name", "GK", "20", "1", "{}") for t in teams]
    return spark.createDataFrame(data, "team_id string, team_name string, id string, name string, positionIdsDesc string, age string, shirtNumber string, raw_json string")


def test_a_failure_between_two_tables_shows_the_old_state_of_both(spark, scratch, monkeypatch):
    squads, players = f"{scratch}/squads", f"{scratch}/players"
    write_squad_batch(members(spark, "old"), squads, players, 4)
    before = [sorted(r.player_id for r in read_table(spark, p).collect()) for p in (squads, players)]
    from touchline.sinks.store import Commit
    write, done = Commit._write, []

    def second_fails(self, name, t, df):
        if done:
            raise OSError("disk")
        done.append(name)
        return write(self, name, t, df)
    monkeypatch.setattr(Commit, "_write", second_fails)
    with pytest.raises(OSError):
        write_squad_batch(members(spark, "new"), squads, players, 4)
    assert done == ["squads"]
    assert [sorted(r.player_id for r in read_table(spark, p).collect()) for p in (squads, players)] == before == [["old1", "old2"]] * 2
    monkeypatch.undo()
    write_squad_batch(members(spark, "new", ("2",)), squads, players, 4)
    assert [sorted(r.player_id for r in read_table(spark, p).collect()) for p in (squads, players)] == [["new2", "old1"]] * 2


def test_another_bucket_count_uses_the_stored_one(spark, scratch):
    store = Store(spark, scratch)
    with store.commit() as c:
        c.replace_keys("t", rows(spark, [(str(i), i) for i in range(100)]), ["team_id"], buckets=64)
    with store.commit() as c:
        assert c.replace_keys("t", rows(spark, [(str(i), -i) for i in range(100)]), ["team_id"], buckets=32)["deleted"] == 100
    assert pairs(store.read("t")) == sorted((str(i), -i) for i in range(100))
    assert store.snapshot().tables["t"].buckets == 64


def test_splitting_buckets_changes_no_row(spark, scratch):
    store = Store(spark, scratch)
    with store.commit() as c:
        c.replace_keys("t", rows(spark, [(str(i % 50), i) for i in range(200)]), ["team_id"], buckets=4)
    before = pairs(store.read("t"))
    with store.commit() as c:
        assert c.split_buckets("t") == 8
    t = store.snapshot().tables["t"]
    assert pairs(store.read("t")) == before and len(t.cells) == 8 and t.buckets == 8
    with store.commit() as c:
        assert c.replace_keys("t", rows(spark, [("7", -1)]), ["team_id"])["deleted"] == 4
    assert pairs(store.read("t")) == sorted([p for p in before if p[0] != "7"] + [("7", -1)])
    one = store.snapshot()._stored("t").where("team_id = '7'").select(BUCKET).distinct().collect()
    assert len(one) == 1


def test_a_delete_empties_many_buckets_in_one_write(spark, scratch, monkeypatch):
    from touchline.sinks.store import Commit
    store = Store(spark, scratch)
    with store.commit() as c:
        c.append("t", rows(spark, [(str(i), i) for i in range(40)]), ["team_id"], 16)
    writes, write = [], Commit._write
    monkeypatch.setattr(Commit, "_write", lambda self, *a: writes.append(a[0]) or write(self, *a))
    with store.commit() as c:
        assert c.delete_where("t", F.col("n") >= 1) == 39
    assert writes == ["t"] and pairs(store.read("t")) == [("0", 0)] and len(store.snapshot().tables["t"].cells) == 1
    with store.commit() as c:
        assert c.delete_where("t", F.col("n") == 0) == 1 and c.delete_where("t", F.lit(True)) == 0 and c.delete_where("none", F.lit(True)) == 0
    assert store.read("t").count() == 0 and store.read("t").columns == ["team_id", "n"]


def test_readers_keep_their_snapshot_and_vacuum_spares_it(spark, scratch):
    store = Store(spark, scratch)
    with store.commit() as c:
        c.overwrite("t", rows(spark, [("1", 1)]))
    old = store.snapshot()
    with store.commit() as c:
        c.overwrite("t", rows(spark, [("2", 2)]))
        assert pairs(c.read("t")) == [("2", 2)] and pairs(store.read("t")) == [("1", 1)]
    assert pairs(old.read("t")) == [("1", 1)] and pairs(store.read("t")) == [("2", 2)]
    assert store.vacuum(3600) == 0 and pairs(old.read("t")) == [("1", 1)]
    assert store.vacuum(0) == 1 and pairs(store.read("t")) == [("2", 2)]


def test_writers_of_different_tables_meet_of_one_table_are_refused(spark, scratch):
    store = Store(spark, scratch)
    with store.commit() as a:
        a.overwrite("x", rows(spark, [("1", 1)]))
        with store.commit() as b:
            b.overwrite("y", rows(spark, [("2", 2)]))
    assert pairs(store.read("x")) == [("1", 1)] and pairs(store.read("y")) == [("2", 2)] and store.snapshot().version == 2
    with pytest.raises(Conflict):
        with store.commit() as a:
            a.append("x", rows(spark, [("3", 3)]))
            with store.commit() as b:
                b.append("x", rows(spark, [("4", 4)]))
    assert pairs(store.read("x")) == [("1", 1), ("4", 4)]


def test_keys_other_than_the_layouts(spark, scratch):
    """A table partitioned by league, replaced by (league, team): cells are looked up."""
    store = Store(spark, scratch)

    def perf(data):
        return spark.createDataFrame(data, "league_id string, team_name string, n long")
    with store.commit() as c:
        c.replace_partitions("p", perf([("A", "X", 1), ("A", "Y", 2), ("B", "X", 3), ("C=1/d", "X", 4)]), ["league_id"])
    with store.commit() as c:
        assert c.replace_keys("p", perf([("A", "X", 10), ("D", "Z", 11), ("C=1/d", "X", 12)]), ["league_id", "team_name"]) == {"deleted": 2, "written": True}
    assert sorted(map(tuple, store.read("p").collect())) == [("A", "X", 10), ("A", "Y", 2), ("B", "X", 3), ("C=1/d", "X", 12), ("D", "Z", 11)]
    with store.commit() as c:
        assert c.replace_partitions("p", perf([]), ["league_id"]) and c.replace_partitions("p", perf([("B", "W", 9)]), ["league_id"])
        with pytest.raises(ValueError):
            c.replace_partitions("p", perf([("B", "W", 9)]), ["team_name"])
    assert sorted(r.n for r in store.read("p").collect()) == [2, 9, 10, 11, 12]


def test_new_columns_join_a_table(spark, scratch):
    store = Store(spark, scratch)
    with store.commit() as c:
        c.append("t", rows(spark, [("1", 1), ("2", 2)]), ["team_id"], 4)
    with store.commit() as c:
        c.replace_keys("t", rows(spark, [("2", 5)]).withColumn("extra", F.lit("e")), ["team_id"])
        c.append("t", spark.createDataFrame([("3",)], "team_id string"))
    assert sorted((r.team_id, r.n, r.extra) for r in store.read("t").collect()) == [("1", 1, None), ("2", 5, "e"), ("3", None, None)]


def test_pointer_text_is_replaced_as_a_whole(spark, scratch):
    assert files.read_text(spark, f"{scratch}/p.json") is None
    for text in ("one", "zwei ü"):
        files.replace_text(spark, f"{scratch}/p.json", text)
        assert files.read_text(spark, f"{scratch}/p.json") == text


def test_an_updated_name_index_equals_a_fresh_one(spark, scratch):
    from touchline.operators.nameindex import COUNTS, GRAMS, NAMES, build_names, probe_names, update_names
    from touchline.operators.resolve import substring_min

    def names(data):
        return spark.createDataFrame(data, "id string, text string")
    first = [("1", "ana silva"), ("1", "a. silva"), ("2", "bo"), ("3", "silvia ng"), ("4", "x"), ("5", "")]
    later = [("1", "ana souza"), ("4", None), ("6", "new silva"), ("3", "silvia ng")]
    now = [("1", "ana souza"), ("2", "bo"), ("3", "silvia ng"), ("5", ""), ("6", "new silva")]
    updated, fresh = Store(spark, f"{scratch}/updated"), Store(spark, f"{scratch}/fresh")
    with updated.commit() as c:
        build_names(c, names(first), 8)
    with updated.commit() as c:
        update_names(c, names(later))
    with fresh.commit() as c:
        build_names(c, names(now), 4)
    for t in (NAMES, GRAMS, COUNTS):
        a, b = (sorted(map(tuple, s.read(t).collect())) for s in (updated, fresh))
        assert a == b, t
    terms = spark.createDataFrame([(x,) for x in ("silv", "o", "ng", "ana s", "zz", "zzzz", "silvx", "new silva", "", "a", "nas")], "term string")
    got = sorted(map(tuple, probe_names(terms, "term", updated.snapshot()).collect()))
    want = sorted(map(tuple, substring_min(terms, "term", names(now), "id", "text").collect()))
    assert got == want and ("silv", "3") in got


def test_the_index_probe_scans_each_table_once(spark, scratch):
    from touchline.operators.nameindex import build_names, probe_names
    store = Store(spark, scratch)
    with store.commit() as c:
        build_names(c, spark.createDataFrame([("1", "ana silva")], "id string, text string"), 2)
    plan = probe_names(spark.createDataFrame([("silva",)], "t string"), "t", store.snapshot())._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(" parquet") == 2 and "Cartesian" not in plan  # the counts and the grams; the names are not read
