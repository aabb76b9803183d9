"""Incremental keyed upsert on Structured Streaming.

Each micro-batch is reduced to its latest row per key, merged with the stored rows of the hash
buckets it touches, reduced again, and published as one commit of the table's store: readers see the
table before or after a batch. "Latest" is by the order columns (``ingested_at`` first), so a late, older
record never replaces a newer one, and replaying a batch id gives the same rows (idempotent). The
stream's checkpoint is the durable cursor. ``buckets`` counts for a new table; a stored table keeps its own
(:meth:`Commit.split_buckets` raises it). A bucket's merge is a shuffle by key and its write is
rebalanced, so no bucket is bound to one task.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from touchline.operators.snapshot import latest_per_key
from touchline.sinks.tables import located


def merge_frame(stored: DataFrame | None, batch: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The table after one batch, as a lazy frame: the latest row per key of both. The batch is
    reduced before the two meet, so a hot key sends one row."""
    incoming = latest_per_key(batch, keys, order)
    return incoming if stored is None else latest_per_key(stored.select(*incoming.columns).unionByName(incoming), keys, order)


def merge_batch(batch: DataFrame, path: str, keys: Sequence[str], order: Sequence[str], buckets: int = 64) -> bool:
    """Upsert one batch into the table at ``path``, bucketed by key; an empty batch commits nothing."""
    store, name = located(batch.sparkSession, path)
    with store.commit() as c:
        return c.merge(name, batch, keys, order, buckets)


def upsert_stream(stream_df: DataFrame, path: str, keys: Sequence[str], order: Sequence[str],
                  checkpoint: str, transform: Callable[[DataFrame], DataFrame] | None = None,
                  available_now: bool = True, buckets: int = 64) -> StreamingQuery:
    """Start the upsert stream; ``transform`` (e.g. a feed flattener) runs per batch first."""
    def run(batch: DataFrame, batch_id: int) -> None:
        b = transform(batch) if transform else batch
        merge_batch(b, path, keys, order, buckets=buckets)

    w = stream_df.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    return w.start()


def read_json_stream(spark: SparkSession, path: str, schema: T.StructType,
                     max_files_per_trigger: int | None = None) -> DataFrame:
    """Landed JSON feed files as a stream (explicit schema, as streaming requires)."""
    r = spark.readStream.schema(schema)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", str(max_files_per_trigger))
    return r.json(path)
