"""Feed readers: nested JSON match, squad and performer feeds to Bronze rows.

Feeds are landed as JSON, one envelope a line (so a large file is split over many tasks), or one
envelope a file on request. Records are taken apart as variants, so ``raw_json`` keeps the whole
record, fields that no schema names and number types included; the columns come from an explicit
schema. Ids arrive as numbers or strings, so
they are read as strings; scores, ages and shirt numbers are cast with ``try_cast`` so bad
values become null instead of failing the batch.
"""

from __future__ import annotations

import datetime as _dt
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SOURCE = "live-football-feed"

_S = T.StringType()
SIDE = T.StructType([T.StructField("id", _S), T.StructField("name", _S), T.StructField("score", _S)])
MATCH = T.StructType([
    T.StructField("id", _S),
    T.StructField("home", SIDE), T.StructField("away", SIDE),
    T.StructField("status", T.StructType([
        T.StructField("utcTime", _S),
        T.StructField("reason", T.StructType([T.StructField("short", _S)])),
    ])),
])
MATCH_ENVELOPE = T.StructType([T.StructField("response", T.StructType([
    T.StructField("matches", T.ArrayType(MATCH))]))])

MEMBER = T.StructType([
    T.StructField("id", _S), T.StructField("name", _S), T.StructField("positionIdsDesc", _S),
    T.StructField("age", _S), T.StructField("shirtNumber", _S),
    T.StructField("excludeFromRanking", _S),
])
SQUAD_ENVELOPE = T.StructType([
    T.StructField("team_id", _S), T.StructField("team_name", _S),
    T.StructField("response", T.StructType([T.StructField("list", T.StructType([
        T.StructField("name", _S),
        T.StructField("squad", T.ArrayType(T.StructType([
            T.StructField("title", _S), T.StructField("members", T.ArrayType(MEMBER))])))]))])),
])

PERFORMER = T.StructType([
    T.StructField("id", _S), T.StructField("name", _S), T.StructField("teamId", _S),
    T.StructField("teamName", _S), T.StructField("goals", _S), T.StructField("assists", _S),
    T.StructField("rating", _S),
])


def _now() -> _dt.datetime:
    return _dt.datetime.now(_dt.timezone.utc)


def stamp(df: DataFrame, source: str = SOURCE, ts: _dt.datetime | None = None) -> DataFrame:
    """One ``ingested_at`` literal for the whole batch (not per row) and a constant source.

    The instant keeps its zone, so it does not depend on the driver's; a naive ``ts`` is UTC."""
    t = ts or _now()
    if t.tzinfo is None:
        t = t.replace(tzinfo=_dt.timezone.utc)
    return df.withColumn("ingested_at", F.lit(t).cast("timestamp")).withColumn("source", F.lit(source))


def read_json(spark: SparkSession, path: str | Sequence[str], schema: T.StructType,
              whole_document: bool = False) -> DataFrame:
    """JSON with an explicit schema (no inference pass): a record a line, or with
    ``whole_document`` a record (or an array of records) a file."""
    return spark.read.schema(schema).option("multiLine", str(whole_document).lower()).json(path)


def landed(spark: SparkSession, path: str | Sequence[str], whole_document: bool = False) -> DataFrame:
    """Landed JSON as one record a row: variant ``v`` (null: not JSON), the ``text`` and ``file`` it came from
    (top-level arrays exploded; blank lines are no records)."""
    text = spark.read.text(path, wholetext=whole_document).select(F.col("value").alias("text"), F.col("_metadata.file_path").alias("file"))
    parsed = text.filter(F.trim("text") != "").select("*", F.try_parse_json("text").alias("v"))
    many = F.try_variant_get("v", "$", "array<variant>")
    return parsed.select("text", "file", F.explode(F.coalesce(many, F.array("v"))).alias("v"))


def read_records(spark: SparkSession, path: str | Sequence[str], whole_document: bool = False) -> DataFrame:
    """Landed JSON as one variant ``v`` a record; records that are not JSON give no row (:func:`landed` has them)."""
    return landed(spark, path, whole_document).select("v").where("v is not null")


def is_object(name: str) -> Column:
    """Is a variant column a JSON object (false for null); its fields are not built for the answer."""
    return F.try_variant_get(name, "$", "struct<>").isNotNull()


def elements(records: DataFrame, path: str, name: str = "m", keep: Sequence[str] = ()) -> DataFrame:
    """Each landed record's list at ``path``, an element a row as variant ``name``, and why a record or an
    element cannot be used as ``reason`` (null: it can). A record without that list gives one row with a
    reason; an empty list gives none."""
    # the list is taken out of the record once, for the reason and for its elements
    listed = records.select(*keep, "text", "file", "v", F.try_variant_get("v", path, "array<variant>").alias("_list"))
    why = F.when(F.col("v").isNull(), F.lit("not JSON")).when(F.col("_list").isNull(), F.lit(f"no list at {path}"))
    rows = listed.select(*keep, "text", "file", why.alias("_why"), "_list").select(
        *keep, "text", "file", "_why", F.explode(F.coalesce("_list", F.array(F.lit(None).cast("variant")))).alias(name))
    return rows.select(*keep, "text", "file", name, F.coalesce("_why", F.when(
        ~is_object(name), F.lit("not an object"))).alias("reason"))


def set_aside(rows: DataFrame) -> DataFrame:
    """The quarantine's rows (``text, file, reason``) of what :func:`elements` or a reader could not use."""
    return rows.filter(F.col("reason").isNotNull()).select("text", "file", "reason")


def typed(records: DataFrame, schema: T.StructType, col: str = "v", keep: Sequence[str] = ()) -> DataFrame:
    """The schema's fields of each variant record, and the whole record as ``raw_json``: both come from the
    variant, and the text is written only where ``raw_json`` is used."""
    found = records.select(*keep, F.try_variant_get(col, "$", schema.simpleString()).alias("_r"), F.to_json(col).alias("raw_json"))
    return found.select(*keep, "_r.*", "raw_json")


def read_matches(spark: SparkSession, path: str | Sequence[str], whole_document: bool = False) -> DataFrame:
    """A1: match records of landed envelopes, with their whole text."""
    return good(match_records(spark, path, whole_document))


def match_records(spark: SparkSession, path: str | Sequence[str], whole_document: bool = False) -> DataFrame:
    """A1 with what cannot be read: typed match records and, with a ``reason``, the others' text and file."""
    return typed(elements(landed(spark, path, whole_document), "$.response.matches"), MATCH, "m", ("text", "file", "reason"))


def good(rows: DataFrame) -> DataFrame:
    """The records that could be read, without the columns of the quarantine."""
    return rows.filter(F.col("reason").isNull()).drop("text", "file", "reason")


def read_members(spark: SparkSession, path: str | Sequence[str], whole_document: bool = False) -> DataFrame:
    """A2: squad members of landed envelopes (flagged ones dropped), with their whole text. The
    team's name in the response comes before the caller's."""
    return ranked(good(member_records(spark, path, whole_document)))


def member_records(spark: SparkSession, path: str | Sequence[str], whole_document: bool = False) -> DataFrame:
    """A2 with what cannot be read: typed members (flagged ones too) and, with a ``reason``, envelopes without
    JSON, a squad list or a team id, and groups or members that are no objects. A group without members is empty."""
    def text(p):
        return F.try_variant_get("v", p, "string")
    team = ("team_id", "team_name")
    named = landed(spark, path, whole_document).select("*", text("$.team_id").alias("team_id"), F.coalesce(
        F.nullif(text("$.response.list.name"), F.lit("")), text("$.team_name")).alias("team_name"))
    groups = elements(named, "$.response.list.squad", "g", team)
    groups = groups.withColumn("reason", F.when(F.col("reason").isNull() & (F.coalesce("team_id", F.lit("")) == ""), F.lit("no team id")).otherwise(F.col("reason")))
    found = F.try_variant_get("g", "$.members", "array<variant>")
    rows = groups.select(*team, "text", "file", F.col("reason").alias("_why"), F.explode(F.when(F.col("reason").isNull(), F.coalesce(
        found, F.array().cast("array<variant>"))).otherwise(F.array(F.lit(None).cast("variant")))).alias("m"))
    rows = rows.select(*team, "text", "file", "m", F.coalesce("_why", F.when(
        ~is_object("m"), F.lit("not an object"))).alias("reason"))
    return typed(rows, MEMBER, "m", (*team, "text", "file", "reason"))


def performer_records(spark: SparkSession, path: str | Sequence[str], whole_document: bool = False) -> DataFrame:
    """Performers of landed lists (a record each, or ``response.players`` of an envelope), with what
    cannot be read as :func:`elements` gives it."""
    listed = F.try_variant_get("v", "$.response.players", "array<variant>")
    rows = landed(spark, path, whole_document).select("text", "file", F.explode(F.coalesce(listed, F.array("v"))).alias("m"), F.col("v").isNull().alias("_bad"))
    why = F.when(F.col("_bad"), F.lit("not JSON")).when(~is_object("m"), F.lit("not an object"))
    return typed(rows.withColumn("reason", why), PERFORMER, "m", ("text", "file", "reason")).drop("raw_json")


def first_nonempty_array(*arrays: Column) -> Column:
    """A10: the first array that is present and non-empty; an empty array falls through."""
    return F.coalesce(*[F.when(F.size(a) > 0, a) for a in arrays])


def matches_from_envelope(env: DataFrame, path: str = "response.matches") -> DataFrame:
    """Explode the match array of each envelope; a missing array yields no rows."""
    return env.select(F.explode(F.col(path)).alias("m")).select("m.*")


def flatten_matches(matches: DataFrame, league_id, season: int, ts: _dt.datetime | None = None,
                    source: str = SOURCE) -> DataFrame:
    """A1: nested match rows to Bronze fixtures; the league id comes from the caller, either
    one value for the batch or a Column (feeds of many leagues in one job).

    Missing ids and names become ``''``; scores are nullable integers; the whole record is kept
    as ``raw_json`` (:func:`read_matches` brings it; a frame without it is encoded, all columns).
    Null nested structs are tolerated.
    """
    raw = F.col("raw_json") if "raw_json" in matches.columns else _raw(matches, matches.columns)
    league = league_id.cast("string") if isinstance(league_id, Column) else F.lit(str(league_id))
    def s(path):
        return F.coalesce(F.col(path).cast("string"), F.lit(""))
    out = matches.select(
        s("id").alias("fixture_id"),
        s("home.id").alias("home_team_id"), s("home.name").alias("home_team_name"),
        s("away.id").alias("away_team_id"), s("away.name").alias("away_team_name"),
        s("status.utcTime").alias("match_date"),
        s("status.reason.short").alias("status"),
        F.col("home.score").try_cast("bigint").alias("home_score"),
        F.col("away.score").try_cast("bigint").alias("away_score"),
        league.alias("league_id"),
        F.lit(int(season)).cast("bigint").alias("season"),
        raw.alias("raw_json"),
    )
    return stamp(out, source, ts)


def truthy(flag: Column) -> Column:
    """Does a JSON value read as text count as set: anything but absent, empty, false or zero."""
    return ~F.lower(F.trim(F.coalesce(flag, F.lit("")))).isin("", "false", "0", "0.0", "null", "[]", "{}")


def ranked(members: DataFrame) -> DataFrame:
    """Members that are not flagged (coaches are)."""
    return members.filter(~truthy(F.col("excludeFromRanking")))


def squad_members(squads: DataFrame) -> DataFrame:
    """A2: squads to members (team id/name carried; the response's own team name first), members
    whose excludeFromRanking is set dropped; a null flag keeps the member."""
    name = F.coalesce(F.nullif(F.col("response.list.name"), F.lit("")), F.col("team_name")) \
        if "name" in squads.select("response.list.*").columns else F.col("team_name")
    g = squads.select("team_id", name.alias("team_name"), F.explode("response.list.squad").alias("g"))
    return ranked(g.select("team_id", "team_name", F.explode("g.members").alias("m"))
                   .select("team_id", "team_name", "m.*"))


def _raw(df: DataFrame, cols: Sequence[str]) -> Column:
    return F.to_json(F.struct(*[F.col(c) for c in cols]))


def flatten_squads(squads: DataFrame, ts: _dt.datetime | None = None, source: str = SOURCE
                   ) -> tuple[DataFrame, DataFrame]:
    """A3 + A4: (bronze_team_squads rows, bronze_players rows) from one exploded batch.

    Players take the team name as nationality (squads are national teams in the feed).
    """
    return members_to_rows(squad_members(squads), ts, source)


def members_to_rows(m: DataFrame, ts: _dt.datetime | None = None, source: str = SOURCE
                    ) -> tuple[DataFrame, DataFrame]:
    """Squad members (from :func:`squad_members`) to compact squad rows and player rows."""
    raw = F.col("raw_json") if "raw_json" in m.columns else \
        _raw(m, [c for c in m.columns if c not in ("team_id", "team_name")])
    t = ts or _now()
    compact = stamp(m.select(
        F.col("team_id").cast("string").alias("team_id"), F.col("team_name"),
        F.coalesce(F.col("id"), F.lit("")).alias("player_id"),
        F.coalesce(F.col("name"), F.lit("")).alias("player_name"),
        F.coalesce(F.col("positionIdsDesc"), F.lit("")).alias("position"),
        raw.alias("raw_json")), source, t)
    players = stamp(m.select(
        F.coalesce(F.col("id"), F.lit("")).alias("player_id"),
        F.col("team_id").cast("string").alias("team_id"), F.col("team_name"),
        F.coalesce(F.col("name"), F.lit("")).alias("name"),
        F.coalesce(F.col("positionIdsDesc"), F.lit("")).alias("position"),
        F.col("team_name").alias("nationality"),
        F.col("age").try_cast("bigint").alias("age"),
        F.col("shirtNumber").try_cast("bigint").alias("jersey_number"),
        raw.alias("raw_json")), source, t)
    return compact, players


def merge_metric_feeds(feeds: Mapping[str, DataFrame], ts: _dt.datetime | None = None,
                       source: str = SOURCE, league_id: str | None = None) -> DataFrame:
    """A5: performer lists keyed by stat (goals / assists / rating) to one table tagged
    ``stat_type``; metrics the list does not carry are typed nulls; missing goals and assists
    count as 0, a missing rating stays null. All rows share one ``ingested_at``; with ``league_id``
    the feeds are one league's (A16) and carry it."""
    parts = []
    for stat, df in feeds.items():
        def metric(name, dtype, default):
            if name != stat:
                return F.lit(None).cast(dtype).alias(name)
            v = F.col(name).try_cast(dtype)
            return (F.coalesce(v, F.lit(default)) if default is not None else v).alias(name)
        parts.append(df.select(
            F.coalesce(F.col("id"), F.lit("")).alias("player_id"),
            F.coalesce(F.col("name"), F.lit("")).alias("player_name"),
            F.coalesce(F.col("teamId"), F.lit("")).alias("team_id"),
            F.coalesce(F.col("teamName"), F.lit("")).alias("team_name"),
            metric("goals", "bigint", 0), metric("assists", "bigint", 0),
            metric("rating", "double", None),
            F.lit(stat).alias("stat_type")))
    if not parts:
        raise ValueError("no feeds given")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    if league_id is not None:
        out = out.withColumn("league_id", F.lit(str(league_id)))
    return stamp(out, source, ts)


def replay_raw(df: DataFrame, payload_schema: T.StructType | str, predicate: Column | None = None,
               raw_col: str = "raw_json", keep: Sequence[str] = ()) -> DataFrame:
    """Rebuild feed records from stored ``raw_json`` (optionally scoped by a predicate),
    carrying the ``keep`` columns alongside."""
    d = df if predicate is None else df.filter(predicate)
    return d.select(*keep, F.from_json(F.col(raw_col), payload_schema).alias("_j")).select(*keep, "_j.*")


def standings_team_ids(rows: DataFrame, col: str = "teamId") -> DataFrame:
    """Team ids of a standings feed, present and non-zero, as integers."""
    v = F.col(col).try_cast("bigint")
    return rows.filter(v.isNotNull() & (v != 0)).select(v.alias("team_id"))


def league_entries(env: DataFrame, array_paths: Sequence[str],
                   id_keys: Sequence[str] = ("id", "leagueId", "league_id"),
                   name_keys: Sequence[str] = ("name", "leagueName")) -> DataFrame:
    """A10: the first non-empty array among ``array_paths`` exploded; id and name from the
    first present alternative key; rows without an id or a name dropped."""
    arr = first_nonempty_array(*[F.col(p) for p in array_paths])
    e = env.select(F.explode(arr).alias("e"))
    fields = {f.name for f in e.schema["e"].dataType.elementType.fields} \
        if isinstance(e.schema["e"].dataType, T.ArrayType) else \
        {f.name for f in e.schema["e"].dataType.fields}
    ids = [F.col(f"e.{k}").cast("string") for k in id_keys if k in fields]
    names = [F.col(f"e.{k}").cast("string") for k in name_keys if k in fields]
    out = e.select(F.coalesce(*ids).alias("id") if ids else F.lit(None).cast("string").alias("id"),
                   F.coalesce(*names).alias("name") if names else F.lit(None).cast("string").alias("name"))
    return out.filter(F.col("id").isNotNull() & (F.col("id") != "")
                      & F.col("name").isNotNull() & (F.col("name") != ""))


def or_default(df: DataFrame, defaults: DataFrame) -> DataFrame:
    """A10: ``df``, or the constant ``defaults`` rows when ``df`` has none (one plan; the
    emptiness probe is a ``limit 1`` scalar subquery)."""
    some = df.select(F.lit(True).alias("_any")).limit(1).scalar()
    return df.unionByName(defaults.filter(some.isNull()), allowMissingColumns=True)


def normalize_match(m: DataFrame, is_live: bool) -> DataFrame:
    """Matches from heterogeneous feeds, several alternative paths per field.

    Scores use the first non-null path; names and status use the first non-blank one; the
    status defaults to LIVE for live feeds and NS otherwise."""
    fields = _flat_fields(m.schema)

    def first(paths, blank_is_missing=True):
        cols = []
        for p in paths:
            if p in fields and not isinstance(fields[p], T.StructType):
                c = F.col(p).cast("string")
                cols.append(F.nullif(c, F.lit("")) if blank_is_missing else c)
        return F.coalesce(*cols) if cols else F.lit(None).cast("string")
    # fixed values: the paths each field may come under, most specific first
    return m.select(
        first(["id", "matchId", "fixture_id"]).alias("fixture_id"),
        F.coalesce(first(["home.name", "homeTeam", "homeTeam.name", "home_team"]), F.lit("")).alias("home_team"),
        F.coalesce(first(["away.name", "awayTeam", "awayTeam.name", "away_team"]), F.lit("")).alias("away_team"),
        first(["home.score", "score.home", "homeScore", "home_score"], False).try_cast("bigint").alias("home_score"),
        first(["away.score", "score.away", "awayScore", "away_score"], False).try_cast("bigint").alias("away_score"),
        F.coalesce(first(["status.reason.short", "status.short", "status", "state"]),
                   F.lit("LIVE" if is_live else "NS")).alias("status"),
        first(["date", "matchDate", "startDate", "status.utcTime", "utcTime"]).alias("match_date"),
        first(["time", "matchTime", "startTime", "status.utcTime", "utcTime"]).alias("match_time"),
    )


def _flat_fields(schema: T.StructType, prefix: str = "") -> dict[str, T.DataType]:
    out: dict[str, T.DataType] = {}
    for f in schema.fields:
        name = prefix + f.name
        out[name] = f.dataType
        if isinstance(f.dataType, T.StructType):
            out.update(_flat_fields(f.dataType, name + "."))
    return out


def read_player_details(spark: SparkSession, path: str | Sequence[str], whole_document: bool = False) -> DataFrame:
    """Landed player detail envelopes to ``player_id`` and the whole detail as ``raw_json``."""
    found = read_records(spark, path, whole_document).select(F.try_variant_get("v", "$.player", "variant").alias("p")).where("p is not null")
    return found.select(F.try_variant_get("p", "$.id", "string").alias("player_id"), F.to_json("p").alias("raw_json"))


def player_detail(stored: DataFrame | None, landed: DataFrame, player_id) -> DataFrame:
    """One player's detail, the stored row before the landed one (none: no row)."""
    one = F.col("player_id") == F.lit(str(player_id))
    rows = landed.filter(one).withColumn("_k", F.lit(1))
    if stored is not None:
        rows = rows.unionByName(stored.select("player_id", "raw_json").filter(one).withColumn("_k", F.lit(0)))
    return rows.orderBy("_k", "raw_json").limit(1).drop("_k")


def all_players(stored: DataFrame | None, squads: DataFrame) -> DataFrame:
    """The stored player table when it has rows, else every squad flattened in one job."""
    if stored is not None and not stored.isEmpty():
        return stored
    return flatten_squads(squads)[1]
