"""Table writers: keyed replace, delete with a count, append, idempotent DDL.

A path names a table of the store in its parent folder (:mod:`touchline.sinks.store`): a write goes to
new folders of the touched cells, then the store's pointer is replaced. Each function here is a commit of
its own; several changes that readers must see together go through one :class:`Commit`.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from touchline.session import ensure_checkpoint_dir
from touchline.sinks.store import BUCKETS, Commit, Store, clustered


def located(spark: SparkSession, path: str) -> tuple[Store, str]:
    """The store that a table's path lies in, and the table's name."""
    base, _, name = path.rstrip("/").rpartition("/")
    return Store(spark, base), name


def _stored(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def read_table(spark: SparkSession, path: str) -> DataFrame | None:
    """The table at ``path`` as its store's pointer has it now, else a plain Parquet folder (None: neither)."""
    store, name = located(spark, path)
    t = store.read(name)
    return _stored(spark, path) if t is None else t


def replace_where(spark: SparkSession, path: str, rows: DataFrame | None, predicate: Column | None = None,
                  keys: Sequence[str] = ("team_id",), buckets: int = BUCKETS) -> dict:
    """B1: :meth:`Commit.replace_where` as a commit of its own."""
    store, name = located(spark, path)
    with store.commit() as c:
        return c.replace_where(name, rows, predicate, keys, buckets)


def delete_where(spark: SparkSession, path: str, predicate: Column) -> int:
    """B2: :meth:`Commit.delete_where` as a commit of its own."""
    return replace_where(spark, path, None, predicate)["deleted"]


def replace_keys(spark: SparkSession, path: str, rows: DataFrame, keys: Sequence[str], buckets: int = BUCKETS) -> dict:
    """:meth:`Commit.replace_keys` as a commit of its own."""
    store, name = located(spark, path)
    with store.commit() as c:
        return c.replace_keys(name, rows, keys, buckets)


def keyed_replace_frame(existing: DataFrame, rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """D8 + B1 as a frame: stored rows whose keys the batch does not carry, plus the batch (a null
    key of the batch meets no stored row)."""
    k = rows.select(*keys).distinct()
    return existing.join(k, list(keys), "left_anti").unionByName(rows, allowMissingColumns=True)


def delete_frame(existing: DataFrame, predicate: Column) -> DataFrame:
    """B2 as a frame: rows where the predicate is not TRUE (a null predicate keeps the row)."""
    return existing.filter(~F.coalesce(predicate, F.lit(False)))


def last_batch_wins(batches: DataFrame, key: str, batch_col: str) -> DataFrame:
    """The accumulated table after replaying batches in ``batch_col`` order, each
    replacing the stored rows of the keys it carries: per key, the rows of its last batch (rows
    without a key form one group of their own). The per-key maximum is an aggregate (reduced
    map-side), joined back null-safely on (key, batch)."""
    last = batches.groupBy(key).agg(F.max(batch_col).alias("_last")).withColumnRenamed(key, "_key")
    same = F.col(key).eqNullSafe(F.col("_key")) & F.col(batch_col).eqNullSafe(F.col("_last"))
    return batches.join(last, same, "left_semi")


def replace_partitions(rows: DataFrame, path: str, partition_cols: Sequence[str]) -> bool:
    """:meth:`Commit.replace_partitions` as a commit of its own."""
    store, name = located(rows.sparkSession, path)
    with store.commit() as c:
        return c.replace_partitions(name, rows, partition_cols)


def replace_squads(c: Commit, members: DataFrame, squads: str = "bronze_team_squads", players: str = "bronze_players",
                   buckets: int = BUCKETS) -> bool:
    """One batch of squad members (:func:`touchline.sources.feeds.read_members`) in both the squad and the
    player table, each replaced per team, in one commit."""
    from touchline.sources.feeds import members_to_rows
    ensure_checkpoint_dir(members.sparkSession)
    members = members.checkpoint(eager=True)  # the feed is parsed once for both
    compact, rows = members_to_rows(members)
    a = c.replace_keys(squads, compact, ["team_id"], buckets)
    b = c.replace_keys(players, rows, ["team_id"], buckets)
    return a["written"] and b["written"]


def write_squad_batch(members: DataFrame, squads_path: str, players_path: str, buckets: int = BUCKETS) -> bool:
    """:func:`replace_squads` as a commit of its own; both tables lie in one store."""
    (store, squads), (other, players) = (located(members.sparkSession, p) for p in (squads_path, players_path))
    if store.base != other.base:
        raise ValueError("both tables must lie in one store")
    with store.commit() as c:
        return replace_squads(c, members, squads, players, buckets)


def append_rows(rows: DataFrame, path: str) -> None:
    """Append (no chunking needed)."""
    rows.write.mode("append").parquet(path)


def overwrite_table(df: DataFrame, name: str, partition_by: Sequence[str] = ()) -> None:
    """``CREATE OR REPLACE TABLE ... AS`` as a catalog table."""
    w = clustered(df, partition_by).write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.saveAsTable(name)


def create_tables(spark: SparkSession, schemas: dict[str, T.StructType], database: str | None = None,
                  partition_by: dict[str, Sequence[str]] | None = None) -> list[str]:
    """Create each table if it does not exist (idempotent); returns the created names."""
    created = []
    for name, schema in schemas.items():
        full = f"{database}.{name}" if database else name
        if spark.catalog.tableExists(full):
            continue
        cols = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
        parts = (partition_by or {}).get(name)
        part = f" PARTITIONED BY ({', '.join(parts)})" if parts else ""
        spark.sql(f"CREATE TABLE IF NOT EXISTS {full} ({cols}) USING parquet{part}")
        created.append(full)
    return created


def qualified(name: str, catalog: str | None = None, database: str | None = None) -> str:
    """Qualified table name."""
    return ".".join(x for x in (catalog, database, name) if x)


def table_exists(spark: SparkSession, name_or_path: str) -> bool:
    """Does a catalog table of this name, or a written table at this path, exist?"""
    if "/" in name_or_path:
        return read_table(spark, name_or_path) is not None
    return spark.catalog.tableExists(name_or_path)


def table_has_rows(df: DataFrame | None) -> bool:
    """Existence probe (limit 1, not a count)."""
    return df is not None and not df.isEmpty()


def has_key(df: DataFrame | None, col: str, value) -> bool:
    """Does the table hold a row for this key (a cached squad, a cached player)?
    The key is compared with the column's own type; ``limit 1`` stops at the first hit."""
    if df is None:
        return False
    return not df.filter(F.col(col) == F.lit(value).cast(dict(df.dtypes)[col])).limit(1).isEmpty()
