"""Operator 11, substring dedup: remove words covered by a long word string that starts earlier.

A window is ``WINDOW`` consecutive words. Any window holds a whole block of ``BLOCK`` words that begins at
a multiple of ``BLOCK`` (``WINDOW >= 2 * BLOCK - 1``), so a window that occurs twice is found by looking
only at the fixed blocks of the one occurrence and at every rolling block of the other.

1. Documents are packed into shards (``shards``): no row is dealt by a key. A shard asks hash buckets about
   the distinct hashes of all its rolling blocks and says which of them are fixed blocks. A bucket
   answers for each: some shard has it as a fixed block, and another one holds it too.
2. Hits (those, and rolling blocks that meet a fixed block elsewhere in the same shard) are extended: every
   window around a hit block is a candidate. Candidates are compared within the shard, and a shard
   sends each distinct one once, with its smallest document, to a bucket by its fingerprint. A passage
   held by a third of all documents reaches a bucket once a shard, and its windows spread over all buckets.
3. A bucket takes the smallest document of each window and answers a bit a window: it starts earlier elsewhere.
4. Covered windows next to each other join to maximal repeats, which are cut out of the texts.

Hashes of step 1 (32 bits in a bucket) only filter: a false hit costs work. Windows are compared by
fingerprints of 128 bits over their words' 64-bit hashes (two seeds), not word by word.

Defined results: null text has no words; a null ``doc_id`` is neither smaller nor larger than another, so
such a text loses only what starts earlier in itself and removes nothing; repeated rows of one id are
documents of their own that do not remove each other; a text of which words are removed is its other
words joined by one space, any other text stays as it is; an empty table gives no row; extra columns
pass through. A shard's index arrays take about ten times its text: a single text must fit so often.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from touchline.llm.common import importable, release, table, text_bytes
from touchline.llm.shards import pack_numbers, shard_docs, unpack_numbers, unpacked, words

WINDOW, BLOCK = 20, 10
#: Text bytes whose blocks one bucket is asked about.
BUCKET_BYTES = 24 << 20
_MUL = [np.uint64(c) for c in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93)]
_LOW, _HALF, _FOLD = np.uint64(0xFFFFFFFF), np.uint64(32), np.uint64(29)
_NOBODY = np.iinfo(np.int64).max
_ASK = "bucket int, shard bigint, hashes binary, fixed binary"
_ANSWER = "bucket int, shard bigint, hits binary"
_SEND = "bucket int, shard bigint, kept boolean, payload binary"
_BACK = "bucket int, shard bigint, kept boolean, payload binary"


def rolling(word: np.ndarray, size: int) -> np.ndarray:
    """A hash of every ``size`` consecutive numbers."""
    n = len(word) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for k in range(size):
        h ^= word[k:k + n]
        h *= _MUL[0]
        h ^= h >> _FOLD
    h *= _MUL[1]
    return h ^ (h >> _HALF)


class Words:
    """Words of a shard's texts as one array of hashes; a word's place counts over all texts."""

    def __init__(self, rows: pa.Table):
        release()
        self.ids = rows.column("doc_id").to_pylist()
        seen: dict[bytes, int] = {}
        parts, counts = [], []
        for t in text_bytes(rows.column("text").combine_chunks()):
            n = 0
            for part in words(t):
                parts.append(np.fromiter((seen.setdefault(w, len(seen)) for w in part), np.int64, len(part)))
                n += len(part)
            counts.append(n)
        self.vocabulary = seen
        self.word = np.concatenate(parts) if parts else np.zeros(0, np.int64)
        self.counts = np.array(counts, np.int64)
        self.starts = np.cumsum(self.counts) - self.counts
        self.row = np.repeat(np.arange(len(counts)), self.counts)

    def hashes(self, seed: int) -> np.ndarray:
        one = np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in self.vocabulary), np.uint64, len(self.vocabulary))
        return one[self.word] if len(one) else np.zeros(0, np.uint64)

    def inside(self, size: int) -> np.ndarray:
        """Places where ``size`` words of one text start."""
        return np.flatnonzero(self.row[size - 1:] == self.row[:len(self.row) - size + 1]) if len(self.row) >= size else np.zeros(0, np.int64)

    def blocks(self):
        """(place, hash, is fixed block) of every rolling block; texts without an id take part too."""
        at = self.inside(BLOCK)
        return at, rolling(self.hashes(1), BLOCK)[at], (at - self.starts[self.row[at]]) % BLOCK == 0


def _bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    return (((h >> _HALF) * np.uint64(buckets)) >> _HALF).astype(np.int64)


def _split(bucket: np.ndarray):
    """(bucket, slice) of each stretch of an ascending array."""
    cut = [0, *(np.flatnonzero(np.diff(bucket)) + 1).tolist(), len(bucket)]
    return [(int(bucket[a]), slice(a, b)) for a, b in zip(cut, cut[1:]) if b > a]


def _distinct(h: np.ndarray, fixed: np.ndarray):
    """Distinct hashes ascending, whether each is a fixed block, which one each place has, how often it occurs."""
    order = np.argsort(h, kind="stable")
    s = h[order]
    new = np.concatenate([[True], s[1:] != s[:-1]]) if len(s) else np.zeros(0, bool)
    group = np.cumsum(new) - 1
    of = np.empty(len(h), np.int64)
    of[order] = group
    return s[new], np.bincount(group, fixed[order], len(np.flatnonzero(new))) > 0, of, np.bincount(group, minlength=0)


def _ask(number: int, rows: pa.Table, buckets: int) -> list[tuple]:
    shard = Words(rows)
    _, h, fixed = shard.blocks()
    distinct, is_fixed, _, _ = _distinct(h, fixed)
    low = (distinct & _LOW).astype(np.int64)
    return [(b, number, pack_numbers(low[s]), np.packbits(is_fixed[s]).tobytes()) for b, s in _split(_bucket(distinct, buckets))]


def _answer(rows: pa.Table) -> pa.Table:
    """For each shard that asked: a bit per hash, set if it is a fixed block somewhere and two shards hold it."""
    release()
    asked = [unpack_numbers(p)[0].astype(np.uint32) for p in rows.column("hashes").to_pylist()]
    fixed = [np.unpackbits(np.frombuffer(p, np.uint8), count=len(a)).astype(bool) for p, a in zip(rows.column("fixed").to_pylist(), asked)]
    every = np.sort(np.concatenate(asked))
    twice = np.unique(every[1:][every[1:] == every[:-1]])
    blocks = np.unique(np.concatenate([a[f] for a, f in zip(asked, fixed)]))
    hits = np.intersect1d(twice, blocks, assume_unique=True)
    return pa.table({"bucket": rows.column("bucket"), "shard": rows.column("shard"),
                     "hits": pa.array([np.packbits(np.isin(a, hits, kind="sort")).tobytes() for a in asked], pa.binary())})


def _candidates(shard: Words, answers: pa.Table, buckets: int) -> np.ndarray:
    """Places of all windows that hold a hit block."""
    at, h, fixed = shard.blocks()
    distinct, is_fixed, of, times = _distinct(h, fixed)
    hit = is_fixed & (times > 1)
    stretch = dict(_split(_bucket(distinct, buckets)))
    for b, bits in zip(answers.column("bucket").to_pylist(), answers.column("hits").to_pylist()):
        s = stretch[b]
        hit[s] |= np.unpackbits(np.frombuffer(bits, np.uint8), count=s.stop - s.start).astype(bool)
    # a window at p holds the blocks at p .. p + WINDOW - BLOCK
    found = np.zeros(len(shard.word) + 1, np.int64)
    found[at[hit[of]] + 1] = 1
    before = np.cumsum(found)
    p = shard.inside(WINDOW)
    return p[before[p + WINDOW - BLOCK + 1] > before[p]]


def _send(number: int, rows: pa.Table, answers: pa.Table, buckets: int) -> list[tuple]:
    """Distinct candidate windows for the buckets, and what the shard keeps to read their answers."""
    shard = Words(rows)
    p = _candidates(shard, answers, buckets)
    if not len(p):
        return []
    first, second = rolling(shard.hashes(1), WINDOW)[p], rolling(shard.hashes(2), WINDOW)[p]
    doc = np.array([_NOBODY if d is None else d for d in shard.ids], np.int64)[shard.row[p]]
    order = np.lexsort((p, shard.row[p], second, first))
    p, first, second, doc = p[order], first[order], second[order], doc[order]
    new = np.concatenate([[True], (first[1:] != first[:-1]) | (second[1:] != second[:-1])])
    group, lead = np.cumsum(new) - 1, np.flatnonzero(new)
    low = np.minimum.reduceat(doc, lead)
    # a later start in the same text, or a larger document in the same shard: covered whatever others have
    row = shard.row[p]
    again = np.concatenate([[False], (group[1:] == group[:-1]) & (row[1:] == row[:-1])])
    covered = again | ((doc > low[group]) & (doc != _NOBODY))
    send = low < _NOBODY  # windows of documents without an id ask nobody
    number_of = np.cumsum(send) - 1
    h, h2, low = first[lead][send], second[lead][send], low[send]
    out = []
    for b, s in _split(_bucket(h, buckets)):
        out.append((b, number, False, pack_numbers((h[s] & _LOW).astype(np.int64), h2[s].view(np.int64), low[s])))
    at = np.argsort(p)
    asked = np.where(send[group] & (doc == np.minimum.reduceat(doc, lead)[group]) & ~covered, number_of[group], -1)
    out.append((number % buckets, number, True, pack_numbers(p[at], covered[at].astype(np.int64), asked[at])))
    return out


def _resolve(rows: pa.Table) -> pa.Table:
    """A bit per window that a shard sent: a smaller document has it elsewhere. Kept rows pass through."""
    release()
    out, sent = [], []
    for b, s, kept, payload in zip(*(rows.column(c).to_pylist() for c in ("bucket", "shard", "kept", "payload"))):
        if kept:
            out.append((b, s, True, payload))
        else:
            sent.append((b, s, unpack_numbers(payload)))
    if sent:
        low, second, doc = (np.concatenate(c) for c in zip(*(x[2] for x in sent)))
        order = np.lexsort((second, low))
        new = np.concatenate([[True], (low[order][1:] != low[order][:-1]) | (second[order][1:] != second[order][:-1])])
        least = np.minimum.reduceat(doc[order], np.flatnonzero(new))[np.cumsum(new) - 1]
        earlier = np.empty(len(doc), bool)
        earlier[order] = least < doc[order]
        at = 0
        for b, s, (own, _, _) in sent:
            out.append((b, s, False, np.packbits(earlier[at:at + len(own)]).tobytes() + len(own).to_bytes(4, "little")))
            at += len(own)
    return _frame(out)


def _frame(rows: list[tuple]) -> pa.Table:
    b, s, k, p = zip(*rows) if rows else ((), (), (), ())
    return pa.table({"bucket": pa.array(b, pa.int32()), "shard": pa.array(s, pa.int64()), "kept": pa.array(k, pa.bool_()), "payload": pa.array(p, pa.binary())})


def removed_words(shard_words: int, back: pa.Table) -> np.ndarray:
    """Whether each word of a shard is covered, from what the shard kept and the buckets' answers."""
    kept = back.column("kept").to_pylist()
    edge = np.zeros(shard_words + 1, np.int64)
    if any(kept):
        payload = back.column("payload").to_pylist()
        p, covered, asked = unpack_numbers(payload[kept.index(True)])
        bits = [np.unpackbits(np.frombuffer(x[:-4], np.uint8), count=int.from_bytes(x[-4:], "little"))
                for _, x in sorted((b, x) for b, k, x in zip(back.column("bucket").to_pylist(), kept, payload) if not k)]
        earlier = np.concatenate([*bits, [0]]).astype(bool)  # -1: not asked
        p = p[covered.astype(bool) | earlier[asked]]
        np.add.at(edge, p, 1)
        np.add.at(edge, p + WINDOW, -1)
    return np.cumsum(edge)[:-1] > 0


def _cut(rows: pa.Table, back: pa.Table, schema: pa.Schema) -> pa.Table:
    """Rows without their covered words, and what was removed."""
    release()
    texts = text_bytes(rows.column("text").combine_chunks())
    split = [[w for part in words(t) for w in part] for t in texts]
    gone = removed_words(sum(map(len, split)), back)
    kept, n_words, n_removed, spans, sha, at = [], [], [], [], [], 0
    for t, w in zip(texts, split):
        mine = gone[at:at + len(w)]
        at += len(w)
        edges = np.flatnonzero(np.diff(np.concatenate([[False], mine, [False]]).astype(np.int8)))
        left = [x for x, g in zip(w, mine.tolist()) if not g] if len(edges) else w
        joined = b" ".join(left)
        kept.append(joined.decode("utf-8", "replace") if len(edges) else None)
        n_words.append(len(w))
        n_removed.append(len(w) - len(left))
        spans.append([{"start": a, "end": b} for a, b in edges.reshape(-1, 2).tolist()])
        sha.append(hashlib.sha256(joined).hexdigest())
    data = {c: rows.column(c) for c in rows.column_names}
    data["text"] = [o if k is None else k for k, o in zip(kept, rows.column("text").to_pylist())]
    data |= {"_tl_words": n_words, "_tl_removed": n_removed, "_tl_repeats": spans, "_tl_sha256": sha}
    return pa.table([pa.array(data[f.name], f.type) if isinstance(data[f.name], list) else data[f.name].cast(f.type) for f in schema], schema=schema)


def remove_repeated_words(docs: DataFrame) -> DataFrame:
    """All columns of ``docs`` with covered words cut out of ``text``, and ``_tl_words``, ``_tl_removed``,
    ``_tl_repeats`` (the maximal repeats that were cut, as ranges of words) and ``_tl_sha256`` (of the
    kept words joined by one space)."""
    from pyspark.sql.pandas.types import to_arrow_schema
    total = importable(docs).agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(8, math.ceil(total / BUCKET_BYTES))
    docs = docs.withColumn("doc_id", F.col("doc_id").cast("bigint"))
    packed = shard_docs(docs)

    def ask(batches):
        for b in batches:
            for number, rows in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for row in _ask(number, unpacked(rows), buckets):  # a row at a time: none is large
                    yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, (pa.int32(), pa.int64(), pa.binary(), pa.binary()))],
                                                     names=["bucket", "shard", "hashes", "fixed"])

    def send(shard: pa.Table, answers: pa.Table) -> pa.Table:
        return _frame(_send(shard.column("shard")[0].as_py(), unpacked(shard.column("rows")[0].as_py()), answers, buckets))

    schema = T.StructType([*docs.schema.fields, T.StructField("_tl_words", T.LongType()), T.StructField("_tl_removed", T.LongType()),
                           T.StructField("_tl_repeats", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
                           T.StructField("_tl_sha256", T.StringType())])
    arrow = to_arrow_schema(schema)

    def cut(shard: pa.Table, back: pa.Table) -> pa.Table:
        return _cut(unpacked(shard.column("rows")[0].as_py()), back, arrow)

    by_shard = packed.groupBy("shard")
    answers = packed.mapInArrow(ask, _ASK).groupBy("bucket").applyInArrow(_answer, _ANSWER)
    sent = by_shard.cogroup(answers.groupBy("shard")).applyInArrow(send, _SEND)
    back = sent.groupBy("bucket").applyInArrow(_resolve, _BACK)
    return by_shard.cogroup(back.groupBy("shard")).applyInArrow(cut, schema)


def op11_block_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeated_words(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.col("_tl_words").alias("n_words"), F.col("_tl_removed").alias("n_removed"),
                      F.col("_tl_sha256").alias("kept_sha256"))
