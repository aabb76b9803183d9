"""Ingest, refresh, league switch and backfill as batch jobs over landed feed files."""

from __future__ import annotations

import logging
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from touchline.operators.discovery import discover_entities
from touchline.operators.resolve import resolve_alias
from touchline.plans.medallion import run_all
from touchline.session import ensure_checkpoint_dir
from touchline.sinks.store import Store
from touchline.sinks.tables import last_batch_wins, replace_keys, replace_squads
from touchline.sources.feeds import (MEMBER, flatten_matches, good, match_records, member_records,
                                     merge_metric_feeds, performer_records, ranked, replay_raw, set_aside, stamp)

log = logging.getLogger(__name__)


LEDGER, QUARANTINE = "ingest_steps", "quarantine"


def ingest(spark: SparkSession, landing: Mapping[str, str], bronze_path: str, league_id, season: int,
           whole_document: bool = False, run: str | None = None, counts: dict | None = None) -> dict[str, str]:
    """L2: fixtures -> discovered teams -> squads of all those teams -> performers, into the store at
    ``bronze_path``.

    ``landing`` maps feed kinds (``matches``, ``squads``, ``scorers``, ``assisters``, ``rated``)
    to landed JSON paths, an envelope a line (``whole_document``: one a file). Each step is its own
    job; a failing step is reported, not fatal. The match feed is parsed once.

    * Records that cannot be read do not fail a step and are not lost: their text, file and reason go to the
      table ``quarantine``, in the same commit as what the step could read.
      ``counts`` is filled with each feed's ``records``, ``kept`` and ``set_aside`` (observed in the same pass).
    * A discovered team without a landed squad takes its stored one (:func:`squads_or_stored`).
    * Performers carry ``league_id`` and replace the rows of their own league and team only.
    * With ``run`` (a name for this ingest), a step that has finished is entered in the table
      ``ingest_steps`` in its own commit; a second call with that name and the same landed path skips it.
    """
    store, status = Store(spark, bronze_path), {}
    ensure_checkpoint_dir(spark)
    done = finished_steps(store, run)

    def step(name: str, source: str, work) -> None:
        if (name, source) in done:
            status[name] = "ok"
            return
        try:
            with store.commit() as c:
                work(c)
                if run is not None:
                    c.append(LEDGER, stamp(spark.createDataFrame([(run, name, source)], "run string, step string, landed string"), "ingest"))
            status[name] = "ok"
        except Exception as exc:  # noqa: BLE001
            status[name] = f"error: {exc}"

    def counted(feed: str, rows: DataFrame) -> DataFrame:
        """The rows, parsed once; how many could be read and how many not go to ``counts``. Only what is set aside
        keeps its text and file: a record's whole envelope would be stored with each of its elements."""
        seen, bad = Observation(), F.col("reason").isNotNull()
        rows = rows.withColumns({c: F.when(bad, F.col(c)) for c in ("text", "file")})
        rows = rows.observe(seen, F.count(F.lit(1)).alias("records"), F.count_if(F.col("reason").isNull()).alias("kept"),
                            F.count_if(F.col("reason").isNotNull()).alias("set_aside")).checkpoint(eager=True)
        if counts is not None:
            for k, n in seen.get.items():
                counts.setdefault(feed, {}).update({k: counts.get(feed, {}).get(k, 0) + n})
        return rows

    def put_aside(c, feed: str, rows: DataFrame) -> None:
        bad = set_aside(rows).withColumns({"feed": F.lit(feed), "league_id": F.lit(str(league_id))})
        if not bad.isEmpty():
            c.append(QUARANTINE, stamp(bad, feed))

    def fixtures(c) -> None:
        rows = counted("matches", match_records(spark, landing["matches"], whole_document))
        c.replace_partitions("bronze_fixtures", flatten_matches(good(rows), league_id, season), ["league_id"])
        put_aside(c, "matches", rows)

    def squads(c) -> None:
        rows = counted("squads", member_records(spark, landing["squads"], whole_document))
        stored = c.read("bronze_fixtures")
        members = ranked(good(rows))
        if stored is not None and status.get("fixtures") == "ok":
            teams = discover_entities(stored.filter(F.col("league_id") == str(league_id))).select(F.col("id").alias("team_id"))
            members = squads_or_stored(teams, members, c.read("bronze_team_squads")).drop("replayed")
        replace_squads(c, members)
        put_aside(c, "squads", rows)

    def performers(c) -> None:
        feeds = {stat: counted("performers", performer_records(spark, landing[k], whole_document))
                 for stat, k in (("goals", "scorers"), ("assists", "assisters"), ("rating", "rated")) if k in landing}
        merged = merge_metric_feeds({stat: good(rows) for stat, rows in feeds.items()}, league_id=str(league_id))
        c.replace_keys("bronze_top_performers", merged, ["league_id", "team_name"])
        put_aside(c, "performers", reduce(DataFrame.unionByName, (r.select("text", "file", "reason") for r in feeds.values())))

    step("fixtures", landing.get("matches", ""), fixtures)
    step("squads", landing.get("squads", ""), squads)
    if any(k in landing for k in ("scorers", "assisters", "rated")):
        step("performers", " ".join(landing.get(k, "") for k in ("scorers", "assisters", "rated")), performers)
    return status


def finished_steps(store: Store, run: str | None) -> set[tuple[str, str]]:
    """(step, landed path) that a run has in the ledger; at most a row a step and path."""
    ledger = store.read(LEDGER) if run is not None else None
    if ledger is None:
        return set()
    return {(r.step, r.landed) for r in ledger.filter(F.col("run") == run).select("step", "landed").distinct().collect()}


def squads_or_stored(teams: DataFrame, landed: DataFrame, stored: DataFrame | None) -> DataFrame:
    """Members of all wanted ``teams`` (``team_id``): the landed rows where a team has any, else its
    stored squad read back from ``raw_json``; ``replayed`` tells them apart. One plan for any number of teams:
    a semi join for the landed teams, an anti join for those that have to be replayed."""
    wanted = teams.select(F.col("team_id").cast("string").alias("team_id")).distinct()
    fresh = landed.join(wanted, "team_id", "left_semi").withColumn("replayed", F.lit(False))
    if stored is None:
        return fresh
    missing = wanted.join(landed.select("team_id").distinct(), "team_id", "left_anti")
    kept = replay_raw(stored.join(missing, "team_id", "left_semi"), MEMBER, keep=("team_id", "team_name", "raw_json"))
    return fresh.unionByName(ranked(kept).withColumn("replayed", F.lit(True)).select(*fresh.columns))


def backfill(batches: DataFrame, path: str, key: str = "team_name", batch_col: str = "batch_day") -> DataFrame:
    """The performer table after all league batches in order, written bucketed by ``key`` in one
    job instead of one replace a batch; returns the written rows."""
    final = last_batch_wins(batches, key, batch_col)
    replace_keys(batches.sparkSession, path, final, [key])
    return final


def refresh(spark: SparkSession, sources: Sequence[str], bronze_readers, gold_path: str) -> dict:
    """L3: rebuild from the first readable source, then Silver/Gold (L1).

    ``bronze_readers(source) -> dict of Bronze DataFrames``; a source that fails to read is
    skipped. Returns ``{"status": "complete" | "error", "step": ..., "source": ...}``.
    """
    for src in sources:
        try:
            bronze = bronze_readers(src)
        except Exception as exc:  # noqa: BLE001
            log.warning("source %s unreadable: %s", src, exc)
            continue
        try:
            tables = run_all(bronze, gold_path)
            return {"status": "complete", "source": src, "tables": tables}
        except Exception as exc:  # noqa: BLE001
            return {"status": "error", "step": "transform", "source": src, "error": str(exc)}
    return {"status": "error", "step": "sync", "error": "no readable source"}


def leagues_needing_load(requested_names: DataFrame, aliases: DataFrame, loaded: DataFrame,
                         text_col: str = "name") -> DataFrame:
    """L4 planning step: resolve requested league names (D5) and keep those not loaded yet
    (D7), as one plan over any number of requests."""
    r = resolve_alias(requested_names, text_col, aliases)
    return (r.filter(F.col("resolved_id").isNotNull())
            .select(F.col("resolved_id").alias("league_id")).distinct()
            .join(loaded.select("league_id").distinct(), "league_id", "left_anti"))


def switch_league(name: str, aliases: DataFrame, loaded: DataFrame, load: "callable", rebuild: "callable",
                  search: DataFrame | None = None) -> dict:
    """L4: resolve a league name, skip the ingest when it is already loaded, else ingest and
    rebuild. Where no alias matches, ``search`` (``id, name`` entries of a landed search response, see
    ``league_entries``) is asked for a league whose name holds the request. ``load`` and ``rebuild``
    take the league id and return a status dict (L2 / L1).

    Returns ``{"status": "switched" | "partial" | "error", "league_id": ..., ...}``.
    """
    requested = aliases.sparkSession.createDataFrame([(name,)], "name string")
    league = resolve_alias(requested, "name", aliases).first()["resolved_id"]
    if league is None and search is not None and name.strip():
        hit = search.filter(F.contains(F.lower("name"), F.lit(name.strip().lower()))).orderBy(F.length("name"), "id").first()
        league = hit["id"] if hit else None
    if league is None:
        return {"status": "error", "error": f"unknown league: {name}"}
    if not loaded.filter(F.col("league_id") == league).isEmpty():
        return {"status": "switched", "league_id": league, "ingested": False}
    steps = dict(load(league))
    steps.update({f"rebuild_{k}": v for k, v in (rebuild(league) or {}).items()})
    failed = [k for k, v in steps.items() if v != "ok"]
    return {"status": "partial" if failed else "switched", "league_id": league,
            "ingested": True, "failed": failed}
