"""Tables that change by writing new folders and then replacing one pointer file.

``<base>/pointer.json`` says which folders are current for every table under ``base``, and keeps each
table's layout: its columns, what it is partitioned by, the key columns and bucket count of a hash
layout. Data lies in ``<base>/<table>/_version=<id>/<cell>/``; a *cell* is a partition folder (``_bucket=7``,
``league_id=A``; the table itself where it is not partitioned). A change writes the cells it touches to
a new folder in one job, reading the old ones, so nothing is checkpointed or overwritten in place; a
cell that loses all rows leaves the pointer. A :class:`Commit` gathers changes of any tables under the
base and replaces the pointer once, at its end: readers see all of them or none, and a failed job leaves
unreferenced folders that :meth:`Store.vacuum` removes.

One writer a table: a commit that finds one of its tables changed by another since it began is refused.
The pointer has a line a cell (at most buckets or partition values), never one a row or file.
"""

from __future__ import annotations

import json
import logging
import uuid
from collections.abc import Sequence
from dataclasses import asdict, dataclass, field
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from touchline.session import ensure_checkpoint_dir
from touchline.sinks import files

log = logging.getLogger(__name__)

BUCKET = "_bucket"
BUCKETS = 64
_VERSION = "_version"
_CELL = "_cell"


def clustered(df: DataFrame, partition_cols: Sequence[str]) -> DataFrame:
    """Rows grouped by partition value before a partitioned write (AQE ``rebalance``).

    Written straight from an upstream shuffle, every task writes a file into every partition
    it holds rows for (tasks x partitions small files). Rebalanced, a partition value goes to
    one task; small ones are packed together and a value holding a large share of the rows
    is split over several tasks, so no single writer gets a hot partition.
    """
    return df.hint("rebalance", *partition_cols) if partition_cols else df


def with_bucket(df: DataFrame, keys: Sequence[str], buckets: int = BUCKETS) -> DataFrame:
    """Partition column derived from the key, so all rows of a key share a partition."""
    return df.withColumn(BUCKET, F.pmod(F.xxhash64(*[F.col(k) for k in keys]), F.lit(buckets)).cast("int"))


class Conflict(RuntimeError):
    """Another writer changed a table of this commit since it began."""


@dataclass
class Table:
    """What the pointer holds of a table."""

    schema: str
    by: list[str] = field(default_factory=list)
    keys: list[str] = field(default_factory=list)
    buckets: int = 0
    cells: dict[str, list[str]] = field(default_factory=dict)

    def fields(self) -> T.StructType:
        return T.StructType.fromJson(json.loads(self.schema))


class Snapshot:
    """The tables of a store as one pointer names them; later commits don't change what it reads."""

    def __init__(self, spark: SparkSession, base: str, version: int, tables: dict[str, Table]):
        self.spark, self.base, self.version, self.tables = spark, base, version, tables

    def read(self, name: str, cells: Sequence[str] | None = None) -> DataFrame | None:
        """The table (of some cells only), without its bucket column; None where it was never written."""
        if name not in self.tables:
            return None
        return self._stored(name, cells).drop(BUCKET)

    def partition_values(self, name: str, column: str) -> list[str | None]:
        """Values of a partition column that hold rows, as the pointer names them."""
        names = [part.partition("=") for c in self.tables[name].cells for part in c.split("/")] if name in self.tables else []
        found = {unquote(v) for k, _, v in names if k == column}
        return sorted((None if v == "__HIVE_DEFAULT_PARTITION__" else v for v in found), key=lambda v: (v is None, v))

    def _stored(self, name: str, cells: Sequence[str] | None = None) -> DataFrame:
        t = self.tables[name]
        at = f"{self.base}/{name}"
        some = t.cells if cells is None else {c: t.cells[c] for c in cells if c in t.cells}
        paths = [f"{at}/{_VERSION}={v}/{c}".rstrip("/") for c, versions in sorted(some.items()) for v in versions]
        if not paths:
            return self.spark.createDataFrame([], t.fields())
        return self.spark.read.schema(t.fields()).option("basePath", at).parquet(*paths).select(*[f"`{c}`" for c in t.fields().names])


class Store:
    """A folder of tables behind one pointer."""

    def __init__(self, spark: SparkSession, base: str):
        self.spark, self.base = spark, base.rstrip("/")

    @property
    def pointer(self) -> str:
        return f"{self.base}/pointer.json"

    def snapshot(self) -> Snapshot:
        text = files.read_text(self.spark, self.pointer)
        state = json.loads(text) if text else {"version": 0, "tables": {}}
        return Snapshot(self.spark, self.base, state["version"], {n: Table(**t) for n, t in state["tables"].items()})

    def read(self, name: str) -> DataFrame | None:
        return self.snapshot().read(name)

    def commit(self) -> "Commit":
        return Commit(self)

    def vacuum(self, older_than: float = 7 * 86400) -> int:
        """Remove data folders that no current table names and that are at least ``older_than`` seconds old
        (long enough for readers of earlier pointers); returns how many."""
        gone = 0
        for name, t in self.snapshot().tables.items():
            used = {f"{_VERSION}={v}" for versions in t.cells.values() for v in versions}
            for folder in set(files.folders(self.spark, f"{self.base}/{name}", older_than)) - used:
                files.remove(self.spark, f"{self.base}/{name}/{folder}")
                gone += 1
        return gone


class Commit(Snapshot):
    """Changes to tables of a store, published together when the ``with`` block ends without an error.

    Reads inside the block see the block's own changes."""

    def __init__(self, store: Store):
        began = store.snapshot()
        super().__init__(store.spark, store.base, began.version, {n: Table(**asdict(t)) for n, t in began.tables.items()})
        self.store, self.began, self.changed = store, began.tables, set()

    def __enter__(self) -> "Commit":
        return self

    def __exit__(self, kind, error, trace) -> None:
        if kind is None and self.changed:
            self._publish()

    def _publish(self) -> None:
        now = self.store.snapshot()
        moved = [n for n in self.changed if now.tables.get(n) != self.began.get(n)]
        if moved:
            raise Conflict(f"changed by another writer: {', '.join(sorted(moved))}")
        tables = {**now.tables, **{n: self.tables[n] for n in self.changed}}
        state = {"version": now.version + 1, "tables": {n: asdict(t) for n, t in sorted(tables.items())}}
        files.replace_text(self.spark, self.store.pointer, json.dumps(state))

    # ------------------------------------------------------------------ layout

    def _table(self, name: str, rows: DataFrame, by: Sequence[str], keys: Sequence[str], buckets: int) -> Table:
        """The stored table's layout, which the arguments don't change; else a new one with theirs."""
        if name not in self.tables:
            self.tables[name] = Table(rows.schema.json(), list(by), list(keys), buckets if keys else 0)
        return self.tables[name]

    def _fitted(self, t: Table, rows: DataFrame) -> DataFrame:
        """``rows`` in the table's columns and types (missing ones null); new columns join the table's."""
        fields = t.fields()
        have = {f.name: f for f in rows.schema.fields}
        fields = T.StructType([*fields.fields, *(f for n, f in have.items() if n not in fields.names)])
        t.schema = fields.json()
        return rows.select(*[(F.col(f"`{f.name}`") if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields.fields])

    def _bucketed(self, t: Table, rows: DataFrame) -> DataFrame:
        return with_bucket(rows, t.keys, t.buckets) if t.keys else rows

    def _write(self, name: str, t: Table, rows: DataFrame) -> tuple[str, list[str]]:
        """Write rows to a new folder in one job; (its id, its cells)."""
        version = uuid.uuid4().hex[:16]
        to = f"{self.base}/{name}/{_VERSION}={version}"
        w = clustered(self._fitted(t, rows), t.by).write
        (w.partitionBy(*t.by) if t.by else w).parquet(to)
        cells = [""]
        for _ in t.by:
            cells = [f"{c}/{x}".lstrip("/") for c in cells for x in files.folders(self.spark, f"{to}/{c}".rstrip("/")) if "=" in x]
        self.changed.add(name)
        return version, cells

    def _swap(self, name: str, rows: DataFrame, touched: Sequence[str] | None) -> None:
        """``rows`` take the place of all rows of the ``touched`` cells (None: of those that they fill)."""
        t = self.tables[name]
        version, cells = self._write(name, t, rows)
        for c in cells if touched is None else touched:
            t.cells.pop(c, None)
        t.cells.update({c: [version] for c in cells})

    # ----------------------------------------------------------------- changes

    def append(self, name: str, rows: DataFrame, keys: Sequence[str] = (), buckets: int = BUCKETS, by: Sequence[str] = ()) -> None:
        """Add rows; the cells get one more folder each."""
        t = self._table(name, with_bucket(rows, keys, buckets) if keys else rows, [BUCKET] if keys else by, keys, buckets)
        version, cells = self._write(name, t, self._bucketed(t, rows))
        for c in cells:
            t.cells.setdefault(c, []).append(version)

    def overwrite(self, name: str, rows: DataFrame, by: Sequence[str] = ()) -> None:
        """B1d, B4: the whole table, its columns and its partitioning by values become those given."""
        self.tables[name] = Table(rows.schema.json(), list(by))
        self._swap(name, rows, None)

    def replace_partitions(self, name: str, rows: DataFrame, by: Sequence[str]) -> bool:
        """Replace the partitions present in ``rows``. An empty batch has none and changes nothing (B1e)."""
        t = self._table(name, rows, by, (), 0)
        if list(by) != t.by:
            raise ValueError(f"{name} is partitioned by {t.by}")
        self._swap(name, rows, None)
        return True

    def replace_keys(self, name: str, rows: DataFrame, keys: Sequence[str], buckets: int = BUCKETS,
                     only_delete: Column | None = None) -> dict:
        """Replace every stored row whose key values appear in ``rows``. A blank or null key
        replaces nothing (its rows are added); a batch without any other key replaces the whole table; an
        empty batch is skipped. Only cells with such keys are rewritten: they follow from the batch where the
        keys hold the table's own, else the stored keys are looked up. Rows of the batch for which ``only_delete``
        is true replace stored rows and are not written themselves."""
        written = F.lit(True) if only_delete is None else ~F.coalesce(only_delete, F.lit(False))
        usable = F.lit(True)
        for k in keys:
            usable = usable & F.col(k).isNotNull() & (F.col(k).cast("string") != "")
        ensure_checkpoint_dir(self.spark)
        batch = rows.checkpoint(eager=True)  # read several times below
        some = batch.agg(F.count(F.lit(1)).alias("n"), F.count_if(usable).alias("named")).first()
        if not some["n"]:
            return {"deleted": 0, "written": False}
        old = self.tables.get(name)
        if old is None or not some["named"]:
            deleted = 0 if old is None else self._stored(name).count()
            if old is None:
                self._table(name, with_bucket(batch, keys, buckets), [BUCKET], keys, buckets)
            self._swap(name, self._bucketed(self.tables[name], batch.filter(written)), list(self.tables[name].cells))
            return {"deleted": deleted, "written": True}
        fresh = batch.filter(written)
        named = batch.filter(usable).select(*keys).distinct()
        own = bool(old.keys) and set(old.keys) <= set(keys)  # the batch's buckets hold all rows of its keys
        if own:
            batch = self._bucketed(old, batch)
            fresh = batch.filter(written)
            touched = [f"{BUCKET}={r[0]}" for r in batch.select(BUCKET).distinct().collect()]  # at most the buckets
        elif not old.cells:
            touched = []
        else:
            touched = self._cells_of(self._stored_cells(name).join(named, list(keys), "left_semi"))
        deleted = 0
        if touched:
            obs = Observation(f"replace_{name}")
            kept = (self._stored(name, touched).join(named.withColumn("_hit", F.lit(True)), list(keys), "left")
                    .observe(obs, F.count_if(F.col("_hit").isNotNull()).alias("deleted")).filter(F.col("_hit").isNull()).drop("_hit"))
            self._swap(name, kept.unionByName(fresh, allowMissingColumns=True) if own else kept, touched)
            deleted = int(obs.get.get("deleted", 0))
        if not own:
            self.append(name, fresh)
        return {"deleted": deleted, "written": True}

    def _stored_cells(self, name: str) -> DataFrame:
        """Stored rows with the cell that holds each."""
        return self._stored(name).withColumn(_CELL, F.regexp_extract(F.col("_metadata.file_path"), f"/{_VERSION}=[0-9a-f]+/(?:(.*)/)?[^/]+$", 1))

    def _cells_of(self, rows: DataFrame) -> list[str]:
        return [unquote(r[0]) for r in rows.select(_CELL).distinct().collect()]  # at most the table's cells

    def delete_where(self, name: str, predicate: Column) -> int:
        """B2: delete rows where the predicate is TRUE (null keeps the row); returns the count. The cells with
        hits are rewritten in one job, those that lose all rows included."""
        if name not in self.tables or not self.tables[name].cells:
            return 0
        hit = F.coalesce(predicate, F.lit(False))
        per = self._stored_cells(name).filter(hit).groupBy(_CELL).agg(F.count(F.lit(1)).alias("n")).collect()  # a row a cell at most
        if per:
            touched = [unquote(r[_CELL]) for r in per]
            self._swap(name, self._stored(name, touched).filter(~hit), touched)
        return int(sum(r["n"] for r in per))

    def replace_where(self, name: str, rows: DataFrame | None, predicate: Column | None = None,
                      keys: Sequence[str] = ("team_id",), buckets: int = BUCKETS) -> dict:
        """B1: delete rows where ``predicate`` is TRUE, then append ``rows``.

        Truth table: rows + predicate -> delete then load; rows only -> load; predicate only ->
        delete; neither -> nothing. A delete that fails, while it is planned or on the data, is logged
        and the load still runs, on the table as it was. An empty ``rows`` counts as no rows."""
        deleted, written = 0, False
        if predicate is not None and name in self.tables:
            before = Table(**asdict(self.tables[name]))
            try:
                deleted = self.delete_where(name, predicate)
                written = deleted > 0
            except Exception as exc:  # noqa: BLE001 - a bad predicate must not block the load; nothing it wrote is referenced
                log.warning("delete failed, appending anyway: %s", str(exc).partition("\n")[0])
                self.tables[name], deleted = before, 0
        if rows is not None and not rows.isEmpty():
            self.append(name, rows, keys, buckets)
            written = True
        return {"deleted": deleted, "written": written}

    def merge(self, name: str, batch: DataFrame, keys: Sequence[str], order: Sequence[str], buckets: int = BUCKETS) -> bool:
        """The latest row per key of the stored and the incoming ones, in the buckets the batch touches."""
        from touchline.operators.snapshot import latest_per_key
        t = self.tables.get(name)
        if t is not None and list(keys) != t.keys:
            raise ValueError(f"{name} is bucketed by {t.keys}")
        ensure_checkpoint_dir(self.spark)
        incoming = latest_per_key(with_bucket(batch, keys, t.buckets if t else buckets), keys, order).checkpoint(eager=True)
        touched = [f"{BUCKET}={r[0]}" for r in incoming.select(BUCKET).distinct().collect()]  # at most the buckets
        if not touched:
            return False
        if t is None:
            self._table(name, incoming, [BUCKET], keys, buckets)
            self._swap(name, incoming, touched)
        else:
            stored = self._stored(name, touched)
            self._swap(name, latest_per_key(stored.unionByName(incoming, allowMissingColumns=True), keys, order), touched)
        return True

    def split_buckets(self, name: str, factor: int = 2) -> int:
        """Deal a bucketed table to ``factor`` times as many buckets, in one job; returns the new count."""
        t = self.tables[name]
        rows, old = self._stored(name).drop(BUCKET), list(t.cells)
        t.buckets *= factor
        self._swap(name, self._bucketed(t, rows), old)
        return t.buckets
