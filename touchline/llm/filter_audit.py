"""Operator 12, filter interaction audit over a sparse document-term matrix.

1. ``local_shards``: each task splits its documents' words and keeps, per shard of a few MB, the rows of
   the matrix with local word numbers (indptr, indices, counts), and its distinct words, packed by a
   hash bucket of the word.
2. ``term_ids``: a bucket numbers its distinct words (word ``rank`` of bucket ``b`` of ``n`` is
   ``rank * n + b``: one number a word in the whole corpus) and answers each shard.
3. ``csr_shards``: a shard replaces its local numbers: CSR blocks over one global dictionary.
4. ``document_rows``: row sums are the words, nonzero counts the distinct words (filters A and B);
   letters, symbols and a SHA-256 of the text (C, D, E) were taken from the whole text in step 1.
5. ``audit``: labels and the first document of each text are attached; rows are added up to the 32
   combinations of filters a part has, and these give all orders and steps.

Buckets grow with the text, so what one holds does not; a shard sends at most one entry per distinct word
of its own, so neither a frequent word nor a large source meets in one task. Copies are never paired:
the smallest id of a digest is an aggregate, joined back on digest *and* id.

Defined results: null text is empty, null source the empty string; a null ``doc_id`` is neither smaller
nor larger than another (its document is never a copy and makes none) and has no label; repeated rows
count each and are no copies of each other; of several labels of one id the highest counts; an empty
table gives no row; other columns are not read. One text's distinct words must fit a task.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections import Counter
from itertools import permutations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.llm.common import checkpointed, importable, release, table, text_bytes
from touchline.llm.shards import pack_numbers, packed, shards, unpack_numbers, unpacked, words

LETTERS = "ABCDE"
MIN_WORDS, MIN_DISTINCT_PERCENT, MAX_UPPER_PERCENT = 50, 65, 5
SYMBOLS = b"#$%&*|"
#: Text bytes of a shard, and text bytes whose words one dictionary bucket holds.
SHARD_BYTES, BUCKET_BYTES = 8 << 20, 32 << 20
_UPPER = bytes(range(ord("A"), ord("Z") + 1))
_CONTINUATION = bytes(range(0x80, 0xC0))
_LOCAL = "bucket int, shard bigint, rows binary, matrix binary"


def _local_shard(number: int, rows: pa.Table, buckets: int) -> pa.RecordBatch:
    release()
    ids: dict[bytes, int] = {}
    ends, terms, counts = [], [], []
    upper, chars, symbol, digest = [], [], [], []
    for t in text_bytes(rows.column("text").combine_chunks()):
        count: Counter = Counter()
        for part in words(t):
            count.update(part)
        terms.append(np.fromiter((ids.setdefault(w, len(ids)) for w in count), np.int64, len(count)))
        counts.append(np.fromiter(count.values(), np.int64, len(count)))
        ends.append(len(count))
        upper.append(len(t) - len(t.translate(None, _UPPER)))
        chars.append(len(t.translate(None, _CONTINUATION)))
        symbol.append(len(t.translate(None, SYMBOLS)) < len(t))
        digest.append(hashlib.sha256(t).digest())
    # local numbers in the order of buckets, so that a bucket's answer is a stretch of them
    vocabulary = list(ids)
    bucket = np.fromiter((zlib.crc32(w) % buckets for w in vocabulary), np.int64, len(vocabulary))
    order = np.argsort(bucket, kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    flat = place[np.concatenate(terms)] if terms else np.zeros(0, np.int64)
    facts = rows.select(["doc_id", "part"])
    for name, column in (("upper", upper), ("chars", chars), ("symbol", symbol), ("digest", digest)):
        facts = facts.append_column(name, pa.array(column))
    out = [(-1, number, packed(facts), pack_numbers(np.cumsum(ends), flat, np.concatenate(counts) if counts else []))]
    cut = np.flatnonzero(np.diff(bucket[order])) + 1
    for own in np.split(order, cut):
        if len(own):
            out.append((int(bucket[own[0]]), number, zstandard.compress(b"\n".join(vocabulary[i] for i in own.tolist()), 1), None))
    cols = list(zip(*out))
    return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.binary()),
                                       pa.array(cols[3], pa.binary())], names=["bucket", "shard", "rows", "matrix"])


def local_shards(docs: DataFrame) -> tuple[DataFrame, int]:
    """Checkpointed shards with local word numbers (``bucket`` -1) and their words by bucket; and the buckets.

    ``docs``: ``doc_id, part, text``."""
    total = importable(docs).agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets, limit = max(4, math.ceil(total / BUCKET_BYTES)), SHARD_BYTES

    def run(batches):
        for number, rows in shards(batches, limit):
            yield _local_shard(number, rows, buckets)

    return checkpointed(docs.select("doc_id", "part", "text").mapInArrow(run, _LOCAL)), buckets


def _numbered(rows: pa.Table):
    """(distinct words of a bucket in order, [(shard, its words)])."""
    asked = [(s, zstandard.decompress(p).split(b"\n")) for s, p in zip(rows.column("shard").to_pylist(), rows.column("rows").to_pylist())]
    return sorted(set().union(*(w for _, w in asked))), asked


def term_ids(local: DataFrame, buckets: int) -> DataFrame:
    """``shard, bucket, ids``: the global numbers of a shard's words of a bucket, in its order."""
    def number(rows: pa.Table) -> pa.Table:
        release()
        bucket = rows.column("bucket")[0].as_py()
        distinct, asked = _numbered(rows)
        rank = {w: i * buckets + bucket for i, w in enumerate(distinct)}
        out = [(s, pack_numbers(np.fromiter(map(rank.__getitem__, w), np.int64, len(w)))) for s, w in asked]
        return pa.table({"shard": pa.array([s for s, _ in out], pa.int64()), "bucket": pa.array([bucket] * len(out), pa.int32()),
                         "ids": pa.array([p for _, p in out], pa.binary())})

    return local.where("bucket >= 0").groupBy("bucket").applyInArrow(number, "shard bigint, bucket int, ids binary")


def dictionary(local: DataFrame, buckets: int) -> DataFrame:
    """``term_id, word`` of every distinct word of the corpus."""
    def read(rows: pa.Table) -> pa.Table:
        bucket = rows.column("bucket")[0].as_py()
        distinct, _ = _numbered(rows)
        return pa.table({"term_id": pa.array(np.arange(len(distinct)) * buckets + bucket, pa.int64()),
                         "word": pa.array([w.decode("utf-8", "replace") for w in distinct], pa.string())})

    return local.where("bucket >= 0").groupBy("bucket").applyInArrow(read, "term_id bigint, word string")


def csr_shards(local: DataFrame, buckets: int) -> DataFrame:
    """``shard, rows, indptr, indices, counts``: CSR blocks (int64 bytes) over the global dictionary;
    ``rows`` has the block's documents in order, packed."""
    def build(shard: pa.Table, answers: pa.Table) -> pa.Table:
        release()
        ends, terms, counts = unpack_numbers(shard.column("matrix")[0].as_py())
        by_bucket = sorted(zip(answers.column("bucket").to_pylist(), answers.column("ids").to_pylist()))
        ids = np.concatenate([unpack_numbers(p)[0] for _, p in by_bucket]) if by_bucket else np.zeros(0, np.int64)
        return pa.table({"shard": shard.column("shard"), "rows": shard.column("rows"),
                         **{k: pa.array([np.ascontiguousarray(v).tobytes()], pa.binary())
                            for k, v in (("indptr", np.concatenate([[0], ends])), ("indices", ids[terms]), ("counts", counts))}})

    held = local.where("bucket < 0").select("shard", "rows", "matrix").groupBy("shard")
    return held.cogroup(term_ids(local, buckets).groupBy("shard")).applyInArrow(
        build, "shard bigint, rows binary, indptr binary, indices binary, counts binary")


def document_rows(matrix: DataFrame) -> DataFrame:
    """``doc_id, part, digest, n_words, n_distinct, mask`` of every document; bits 0 to 3 of ``mask``: A to D."""
    names = ["doc_id", "part", "digest", "n_words", "n_distinct", "mask"]

    def read(batches):
        for b in batches:
            for rows, indptr, counts in zip(*(b.column(b.schema.get_field_index(c)).to_pylist() for c in ("rows", "indptr", "counts"))):
                facts, ends, n = unpacked(rows), np.frombuffer(indptr, np.int64), np.frombuffer(counts, np.int64)
                before = np.concatenate([[0], np.cumsum(n)])
                n_words, n_distinct = before[ends[1:]] - before[ends[:-1]], np.diff(ends)
                upper, chars, symbol = (facts.column(c).to_numpy() for c in ("upper", "chars", "symbol"))
                fails = [n_words < MIN_WORDS, 100 * n_distinct < MIN_DISTINCT_PERCENT * n_words,
                         100 * upper > MAX_UPPER_PERCENT * chars, symbol.astype(bool)]
                mask = sum(f.astype(np.int64) << k for k, f in enumerate(fails))
                cols = [facts.column(c).combine_chunks() for c in names[:3]] + [pa.array(c, pa.int64()) for c in (n_words, n_distinct, mask)]
                yield pa.RecordBatch.from_arrays(cols, names=names)

    return matrix.mapInArrow(read, "doc_id bigint, part string, digest binary, n_words bigint, n_distinct bigint, mask bigint")


def all_orders() -> list[tuple[str, int, int, int]]:
    """(order, step, filters applied before as bits, the step's filter as a bit) of every order of the filters."""
    out = []
    for order in permutations(range(len(LETTERS))):
        before = 0
        for step, k in enumerate(order, 1):
            out.append(("".join(LETTERS[i] for i in order), step, before, 1 << k))
            before |= 1 << k
    return out


def _report(batches):
    """All orders and steps of each part from its counts by combination of failed filters."""
    orders = all_orders()
    before, own = (np.array([o[k] for o in orders])[:, None] for k in (2, 3))
    mask = np.arange(1 << len(LETTERS))[None, :]
    removed = ((mask & own) != 0) & ((mask & before) == 0)
    pick = {"kept": (mask & (own | before)) == 0, "removed": removed, "redundant": ((mask & own) != 0) & ((mask & before) != 0),
            "unique_fails": np.broadcast_to(mask == own, removed.shape)}
    letter = own[:, 0]
    for b in batches:
        for part, cells in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            n, good, toxic = (np.zeros(mask.shape[1], np.int64) for _ in range(3))
            for c in cells:
                n[c["mask"]], good[c["mask"]], toxic[c["mask"]] = c["n"], c["good"], c["toxic"]
            out = {"part": [part] * len(orders), "filter_order": [o[0] for o in orders], "step": [o[1] for o in orders]}
            out |= {k: m.astype(np.int64) @ n for k, m in pick.items()}
            out |= {"good_lost": removed.astype(np.int64) @ good, "toxic_lost": removed.astype(np.int64) @ toxic}
            by_filter = {f: int(out["removed"][letter == f].sum()) for f in np.unique(letter).tolist()}
            out["shapley"] = [by_filter[f] for f in letter.tolist()]
            yield pa.RecordBatch.from_pydict({k: pa.array(v, pa.int32() if k == "step" else None) for k, v in out.items()})


def audit(docs: DataFrame, labels: DataFrame, part: str = "source") -> DataFrame:
    """``part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley``."""
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), "text")
    local, buckets = local_shards(docs)
    rows = document_rows(csr_shards(local, buckets))
    rows = checkpointed(rows.groupBy("doc_id", "part", "digest", "mask").agg(F.count(F.lit(1)).alias("n")))
    known, unknown = rows.where("doc_id is not null"), rows.where("doc_id is null")
    first = known.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    truth = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(
        F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"), F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic"))
    known = known.join(first, ["digest", "doc_id"], "left").join(truth, "doc_id", "left").select(
        "part", F.when(F.col("first"), F.col("mask")).otherwise(F.col("mask") + 16).alias("mask"), "n",
        (F.col("n") * F.coalesce("good", F.lit(0))).alias("good"), (F.col("n") * F.coalesce("toxic", F.lit(0))).alias("toxic"))
    every = known.unionByName(unknown.select("part", "mask", "n", F.lit(0).cast("bigint").alias("good"), F.lit(0).cast("bigint").alias("toxic")))
    cells = every.groupBy("part", "mask").agg(*(F.sum(c).alias(c) for c in ("n", "good", "toxic")))
    parts = cells.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))  # 32 at most
    return parts.mapInArrow(_report, "part string, filter_order string, step int, kept bigint, removed bigint, redundant bigint, "
                                     "unique_fails bigint, good_lost bigint, toxic_lost bigint, shapley bigint")


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


#: The same rows as DuckDB SQL over the raw tables.
ORACLE_SQL = r"""
with words as (
  select doc_id, coalesce(source, '') as part, coalesce(text, '') as t,
         list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w
  from documents),
lowest as (select coalesce(text, '') as t, min(doc_id) as lo from documents group by 1),
flags as (
  select words.doc_id, part,
         case when len(w) < 50 then 1 else 0 end as a,
         case when 100 * len(list_distinct(w)) < 65 * len(w) then 1 else 0 end as b,
         case when 100 * (length(words.t) - length(regexp_replace(words.t, '[A-Z]', '', 'g'))) > 5 * length(words.t) then 1 else 0 end as c,
         case when regexp_matches(words.t, '[#$%&*|]') then 1 else 0 end as d,
         case when words.doc_id > lo then 1 else 0 end as e
  from words join lowest on words.t = lowest.t),
truth as (select doc_id, max(case when quality = 1 then 1 else 0 end) as good, max(case when toxic = 1 then 1 else 0 end) as toxic
          from labels group by doc_id),
cells as (
  select part, a + 2 * b + 4 * c + 8 * d + 16 * e as mask, count(*) as n, sum(coalesce(good, 0)) as good, sum(coalesce(toxic, 0)) as toxic
  from flags left join truth on flags.doc_id = truth.doc_id group by 1, 2),
letters(x, own) as (values ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
orders as (
  select p.x || q.x || r.x || s.x || t.x as filter_order, p.own as o1, q.own as o2, r.own as o3, s.own as o4, t.own as o5
  from letters p, letters q, letters r, letters s, letters t
  where p.own + q.own + r.own + s.own + t.own = 31 and p.own | q.own | r.own | s.own | t.own = 31),
steps as (
  select filter_order, 1 as step, o1 as own, 0 as before from orders union all
  select filter_order, 2, o2, o1 from orders union all
  select filter_order, 3, o3, o1 | o2 from orders union all
  select filter_order, 4, o4, o1 | o2 | o3 from orders union all
  select filter_order, 5, o5, o1 | o2 | o3 | o4 from orders),
counts as (
  select part, filter_order, step, own,
         sum(case when mask & (own | before) = 0 then n else 0 end) as kept,
         sum(case when mask & own <> 0 and mask & before = 0 then n else 0 end) as removed,
         sum(case when mask & own <> 0 and mask & before <> 0 then n else 0 end) as redundant,
         sum(case when mask = own then n else 0 end) as unique_fails,
         sum(case when mask & own <> 0 and mask & before = 0 then good else 0 end) as good_lost,
         sum(case when mask & own <> 0 and mask & before = 0 then toxic else 0 end) as toxic_lost
  from cells, steps group by 1, 2, 3, 4)
select part, filter_order, step, cast(kept as bigint) as kept, cast(removed as bigint) as removed, cast(redundant as bigint) as redundant,
       cast(unique_fails as bigint) as unique_fails, cast(good_lost as bigint) as good_lost, cast(toxic_lost as bigint) as toxic_lost,
       cast(sum(removed) over (partition by part, own) as bigint) as shapley
from counts
"""
