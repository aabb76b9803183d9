"""Operator 4, suffix-array dedup: remove bytes covered by a long string of an earlier document.

A window is ``WINDOW`` bytes; every window is judged by the suffixes that start at its *anchor*, the
16 bytes with the smallest hash among the 35 such strings inside it (the last one on a tie). Equal
windows have equal anchors at equal offsets, so windows need comparing only under equal anchors, and
about one position in 17 starts such a suffix.

1. Documents are dealt to ``home`` groups by a hash of id and text; each group lists its anchors' hashes,
   and the hash buckets answer which of them occur in several groups (a filter: a false answer only
   costs work). Anchors of one document alone go no further.
2. Sampled splitters range-partition the remaining suffixes by their leading bytes. A suffix carries
   the bytes of its windows; a group sends equal ones once, for its earliest document, since the
   later ones are already decided. So a passage held by a third of all documents reaches a bucket once a group.
   Splitters lie between leading words: the comparison across a boundary is settled by routing equal
   leading bytes to the right of it. Leading words that fill a bucket of the sample or more (a short line
   that many documents hold between different texts) are not dealt by range: their windows are sent one
   by one, equal ones of a group once, by a hash of the window's bytes, so they spread over all buckets.
3. A bucket sorts by multikey quicksort (a word of bytes at a time, going on only inside ties), groups
   windows that agree in all bytes, and takes the smallest document of each.
4. Covered stretches go back to their home, where they are merged and cut out of the texts.

Defined results: null text is empty; a null ``doc_id`` is neither smaller nor larger than another, so
its text is kept and removes nothing; repeated rows of one id do not remove each other; an empty table
gives no row. A text may be longer than memory for its index arrays: they are made a segment at a time.
"""

from __future__ import annotations

import hashlib
import math
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from touchline.llm.common import home_of, importable, release, table

WINDOW = 50
ANCHOR = 16
#: Text bytes of one home group, and bytes indexed at once inside it.
HOME_BYTES, SEGMENT = 6 << 20, 1 << 20
#: Sampled text bytes for the splitters, and one in so many of their anchors.
SAMPLE_BYTES, SAMPLE_EVERY = 8 << 20, 16
#: The sample grows with the buckets: text bytes for each (some 30 leading words), and the leading words a splitter stands for at least.
SAMPLE_PER_BUCKET, LEADS_PER_BUCKET = 8 << 10, 8
_REACH = WINDOW - ANCHOR + 1
_C = [np.uint64(c) for c in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]
_LOW, _SHIFT = np.uint64(0xFFFFFFFF), np.uint64(32)
_HOME = "_tl_home"


def words_at(buf: bytes, order: str = "<") -> np.ndarray:
    """The eight bytes from each position of ``buf`` as one number (zeros behind its end)."""
    n = len(buf)
    padded = buf + bytes(16 + -n % 8)
    w = np.empty(n, "<u8")
    for o in range(8):
        part = w[o::8]
        part[:] = np.frombuffer(padded, order + "u8", len(part), o)
    return w


class Words:
    """The eight bytes at given places of a buffer as numbers, without an array for every place."""

    def __init__(self, buf: bytes):
        padded = np.frombuffer(buf + bytes(16), np.uint8)
        self.rows = np.lib.stride_tricks.as_strided(padded, (len(buf) + 8, 8), (1, 1))

    def at(self, places: np.ndarray, order: str = "<") -> np.ndarray:
        return np.ascontiguousarray(self.rows[places]).view(order + "u8").ravel().astype(np.uint64)


def anchor_runs(buf: bytes, starts: np.ndarray, ends: np.ndarray):
    """(anchor position, first window, last window, anchor hash) of each run of windows with one anchor."""
    out = []
    for at in range(0, max(0, len(buf) - WINDOW + 1), SEGMENT):
        part = buf[at:at + SEGMENT + WINDOW - 1]
        w = words_at(part)
        grams = len(part) - ANCHOR + 1
        x = w[:grams] * _C[0] + w[8:8 + grams] * _C[1]
        x ^= x >> np.uint64(29)
        x *= _C[2]
        v = (x & ~_LOW) | (_LOW - np.arange(grams, dtype=np.uint64))
        span = 1
        while span < _REACH:
            step = min(span, _REACH - span)
            v = np.minimum(v[:-step], v[step:])
            span += step
        anchor = (_LOW - (v & _LOW)).astype(np.int64)
        edge = np.zeros(len(anchor) + 1, np.int32)
        first, last = np.clip(starts - at, 0, len(anchor)), np.clip(ends - WINDOW + 1 - at, 0, len(anchor))
        some = last > first
        np.add.at(edge, first[some], 1)
        np.add.at(edge, last[some], -1)
        inside = np.cumsum(edge[:-1]) > 0
        lo = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (inside[1:] != inside[:-1])]))
        hi = np.concatenate([lo[1:], [len(anchor)]]) - 1
        keep = inside[lo]
        lo, hi = lo[keep], hi[keep]
        p = anchor[lo]
        y = x[p] * _C[3]
        out.append((p + at, lo + at, hi + at, y ^ (y >> _SHIFT)))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return tuple(np.concatenate(c) for c in zip(*out))


def multikey_groups(keys, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, group number along it) of ``n`` items; items group if all keys agree.

    Multikey quicksort a word at a time: ``keys`` gives a function per word from item numbers to that
    word; items that already differ are not looked at again."""
    order, group = np.arange(n), np.zeros(n, np.int64)
    open_ = np.arange(n)  # places along the order whose group has several items
    for key in keys:
        if not len(open_):
            break
        k = key(order[open_])
        s = np.lexsort((k, group[open_]))
        order[open_] = order[open_][s]
        k, g = k[s], group[open_][s]
        new = np.concatenate([[True], (k[1:] != k[:-1]) | (g[1:] != g[:-1])])
        first = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
        group[open_] = open_[first]
        alone = new & np.concatenate([new[1:], [True]])
        open_ = open_[~alone]
    return order, group


class Home:
    """The texts of one home group in (doc_id, text) order, as one buffer."""

    def __init__(self, rows: pa.Table):
        release()
        ids = rows.column("doc_id").to_pylist()
        texts = [t if t is not None else b"" for t in rows.column("text").cast(pa.large_binary()).to_pylist()]
        self.order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0, texts[i]))
        self.ids = [ids[i] for i in self.order]
        self.texts = [texts[i] for i in self.order]
        known = [t if d is not None else b"" for d, t in zip(self.ids, self.texts)]
        self.buf = b"".join(known)
        self.ends = np.cumsum([len(t) for t in known]) if known else np.zeros(0, np.int64)
        self.starts = self.ends - np.array([len(t) for t in known], np.int64)

    def anchors(self):
        p, lo, hi, y = anchor_runs(self.buf, self.starts, self.ends)
        return p, lo, hi, y, np.searchsorted(self.ends, lo, "right")


def _hash_bucket(y: np.ndarray, buckets: int) -> np.ndarray:
    return ((y >> _SHIFT) * np.uint64(buckets)) >> _SHIFT


def _distinct(y: np.ndarray, buckets: int) -> np.ndarray:
    """Distinct (bucket, low word) of anchor hashes, ascending, as one number each."""
    return np.unique((_hash_bucket(y, buckets) << _SHIFT) | (y & _LOW))


def _frame(rows: list[tuple], fields: list[tuple]) -> pa.Table:
    cols = list(zip(*rows)) or [()] * len(fields)
    return pa.table([pa.array(c, t) for c, (_, t) in zip(cols, fields)], names=[n for n, _ in fields])


_ASK = [("bucket", pa.int32()), ("home", pa.int32()), ("payload", pa.binary())]
_SEND = [*_ASK[:2], ("decided", pa.bool_()), _ASK[2]]
_BACK = _ASK[1:]


def _ask(rows: pa.Table, buckets: int) -> pa.Table:
    """Which anchors a home group has, a row for each hash bucket."""
    y = _distinct(Home(rows).anchors()[3], buckets)
    home = rows.column(_HOME)[0].as_py()
    b = (y >> _SHIFT).astype(np.int64)
    cut = np.flatnonzero(np.diff(b)) + 1
    return _frame([(int(k[0]), home, v.astype("<u4").tobytes()) for k, v in zip(np.split(b, cut), np.split(y & _LOW, cut)) if len(k)], _ASK)


def _answer(rows: pa.Table) -> pa.Table:
    """For each group that asked: a bit per anchor, set if another group has it too."""
    asked = [np.frombuffer(p, "<u4") for p in rows.column("payload").to_pylist()]
    every = np.concatenate(asked)
    s = np.sort(every)
    again = np.unique(s[1:][s[1:] == s[:-1]])
    known = np.isin(every, again, kind="sort")  # of all groups at once: their number grows with the input
    ends = np.cumsum([len(a) for a in asked]).tolist()
    bucket = rows.column("bucket")[0].as_py()
    return _frame([(bucket, h, np.packbits(known[i:j]).tobytes())
                   for h, i, j in zip(rows.column("home").to_pylist(), [0, *ends], ends)], _ASK)


def _pack_spans(row, start, end) -> bytes:
    return zstandard.compress(b"".join(np.asarray(c, "<u4").tobytes() for c in (row, start, end)), 1)


def _unpack_spans(payload: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(payload), "<u4").reshape(3, -1).astype(np.int64)


def _send(rows: pa.Table, answers: pa.Table, buckets: int, splitters: np.ndarray) -> pa.Table:
    """Suffixes of repeated anchors for the range buckets, and the stretches this group decides itself."""
    if not rows.num_rows:
        return _frame([], _SEND)
    home, number = Home(rows), rows.column(_HOME)[0].as_py()
    p, lo, hi, y, row = home.anchors()
    key = (_hash_bucket(y, buckets) << _SHIFT) | (y & _LOW)
    distinct, of = np.unique(key, return_inverse=True)
    ids = np.array([d if d is not None else 0 for d in home.ids], np.int64)
    doc = ids[row] if len(row) else np.zeros(0, np.int64)
    repeated = np.zeros(len(distinct), bool)
    if len(distinct):
        least, most = np.full(len(distinct), np.iinfo(np.int64).max), np.full(len(distinct), np.iinfo(np.int64).min)
        np.minimum.at(least, of, doc)
        np.maximum.at(most, of, doc)
        repeated = least != most
    b = (distinct >> _SHIFT).astype(np.int64)
    for k, bits in zip(answers.column("bucket").to_pylist(), answers.column("payload").to_pylist()):
        at, to = np.searchsorted(b, [k, k + 1])
        repeated[at:to] |= np.unpackbits(np.frombuffer(bits, np.uint8), count=to - at).astype(bool)
    use = np.flatnonzero(repeated[of]) if len(of) else np.zeros(0, np.int64)
    p, lo, hi, row, doc = p[use], lo[use], hi[use], row[use], doc[use]
    buf, first, sent, decided = home.buf, {}, [], []
    lead = Words(buf).at(p, ">")
    hot = np.isin(lead, splitters[1:][splitters[1:] == splitters[:-1]])
    times = np.where(hot, hi - lo + 1, 1)
    inner = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
    p, lo, hi, row, doc, lead, hot = (np.repeat(c, times) for c in (p, lo, hi, row, doc, lead, hot))
    lo = lo + inner
    hi = np.where(hot, lo, hi)
    docs = doc.tolist()
    content = [bytes((a - s,)) + buf[s:e + WINDOW] for a, s, e in zip(p.tolist(), lo.tolist(), hi.tolist())]
    for i, c in enumerate(content):  # rows are in doc_id order: the first is the earliest
        (sent if first.setdefault(c, docs[i]) == docs[i] else decided).append(i)
    out = []
    at = home.starts[row]
    start, wide = lo - at, hi - lo + 1
    if decided:
        d = np.array(decided)
        out.append((int(number) % buckets, number, True, _pack_spans(*merge_spans(row[d], start[d], (hi - at)[d] + WINDOW))))
    if sent:
        s = np.array(sent)
        to = np.searchsorted(splitters, lead[s], "right")
        apart = np.flatnonzero(hot[s])
        to[apart] = [zlib.crc32(content[i]) % buckets for i in s[apart].tolist()]
        order = np.lexsort((s, lead[s], to))
        s, to = s[order], to[order]
        for own in np.split(np.arange(len(s)), np.flatnonzero(np.diff(to)) + 1):  # nothing here may go over the whole group: buckets grow with the input
            k = s[own]
            head = [np.array([len(k)], "<u4"), docs_array(doc[k]), row[k].astype("<u4"), start[k].astype("<u4"), wide[k].astype(np.uint8)]
            raw = b"".join([h.tobytes() for h in head] + [content[i] for i in k.tolist()])
            out.append((int(to[own[0]]), number, False, zstandard.compress(raw, 3)))
    return _frame(out, _SEND)


def docs_array(doc: np.ndarray) -> np.ndarray:
    return doc.astype("<i8")


def merge_spans(row: np.ndarray, start: np.ndarray, end: np.ndarray):
    """Union of [start, end) stretches of each row, in order."""
    if not len(row):
        return row, start, end
    order = np.lexsort((start, row))
    row, start, end = row[order], start[order], end[order]
    shift = row * (1 << 33)
    reach = np.maximum.accumulate(shift + end)
    new = np.concatenate([[True], (shift + start)[1:] > reach[:-1]])
    at = np.flatnonzero(new)
    return row[at], start[at], np.maximum.reduceat(reach, at) - shift[at]


def _resolve(rows: pa.Table) -> pa.Table:
    """Covered stretches of a bucket's suffixes, a payload per home group; decided ones pass through."""
    release()
    out, parts = [], []
    for home, decided, payload in zip(*(rows.column(c).to_pylist() for c in ("home", "decided", "payload"))):
        if decided:
            out.append((home, payload))
            continue
        raw = zstandard.decompress(payload)
        n, at, cols = int(np.frombuffer(raw, "<u4", 1)[0]), 4, []
        for t in ("<i8", "<u4", "<u4", "u1"):
            cols.append(np.frombuffer(raw, t, n, at).astype(np.int64))
            at += n * np.dtype(t).itemsize
        parts.append((np.full(n, home, np.int64), *cols, raw[at:]))
    if parts:
        home, doc, row, start, wide = (np.concatenate(c) for c in zip(*[p[:5] for p in parts]))
        raw = b"".join(p[5] for p in parts)
        h, r, s, e = resolve_suffixes(home, doc, row, start, wide, raw)
        order = np.argsort(h, kind="stable")
        h, r, s, e = h[order], r[order], s[order], e[order]
        for own in np.split(np.arange(len(h)), np.flatnonzero(np.diff(h)) + 1):
            if len(own):
                out.append((int(h[own[0]]), _pack_spans(*merge_spans(r[own], s[own], e[own]))))
    return _frame(out, _BACK)


def resolve_suffixes(home, doc, row, start, wide, raw: bytes):
    """(home, row, start, end) of the stretches of each suffix that an earlier document covers."""
    length = wide + WINDOW  # the offset byte and the windows' bytes
    at = np.cumsum(length) - length
    words = Words(raw)
    suffix = at + 1 + np.frombuffer(raw, np.uint8)[at]
    order, group = multikey_groups([lambda i: words.at(suffix[i], ">"), lambda i: words.at(suffix[i] + 8, ">")], len(at))
    size = np.bincount(group, minlength=len(at))
    use = np.sort(order[size[group] > 1])
    # equal strings: the earliest document stands for all of them
    number: dict[bytes, int] = {}
    of = np.array([number.setdefault(raw[a:b], len(number)) for a, b in zip(at[use].tolist(), (at + length)[use].tolist())], np.int64)
    least = np.full(len(number), np.iinfo(np.int64).max)
    np.minimum.at(least, of, doc[use])
    _, example = np.unique(of, return_index=True)
    whole = doc[use] > least[of]
    # windows of the distinct strings
    count = wide[use][example]
    owner = np.repeat(np.arange(len(count)), count)
    inner = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    place = at[use][example][owner] + 1 + inner
    mix = np.zeros(len(place), np.uint64)
    for o in (0, 8, 16, 24, 32, 40, WINDOW - 8):
        mix = (mix ^ words.at(place + o)) * _C[0]
        mix ^= mix >> np.uint64(31)
    exact = [lambda i, o=o: words.at(place[i] + o) for o in (0, 8, 16, 24, 32, 40, WINDOW - 8)]
    worder, wgroup = multikey_groups([lambda i: mix[i], *exact], len(place))
    low = np.full(len(place), np.iinfo(np.int64).max)
    np.minimum.at(low, wgroup, least[owner[worder]])
    covered = np.empty(len(place), bool)
    covered[worder] = low[wgroup] < least[owner[worder]]
    # runs of covered windows of each distinct string
    edge = np.concatenate([[True], owner[1:] != owner[:-1]]) if len(owner) else np.zeros(0, bool)
    begins = np.flatnonzero(covered & (edge | ~np.concatenate([[False], covered[:-1]]))) if len(owner) else np.zeros(0, np.int64)
    finish = np.concatenate([edge[1:], [True]]) if len(owner) else edge
    stops = np.flatnonzero(covered & (finish | ~np.concatenate([covered[1:], [False]]))) if len(owner) else begins
    runs = np.searchsorted(owner[begins], np.arange(len(count) + 1))
    own = np.flatnonzero(~whole)
    times = (runs[1:] - runs[:-1])[of[own]]
    rep = np.repeat(own, times)
    which = np.repeat(runs[of[own]], times) + np.arange(len(rep)) - np.repeat(np.cumsum(times) - times, times)
    full = np.flatnonzero(whole)
    pick = np.concatenate([use[full], use[rep]])
    s = np.concatenate([np.zeros(len(full), np.int64), inner[begins[which]]])
    e = np.concatenate([wide[use[full]] - 1, inner[stops[which]]])
    return home[pick], row[pick], start[pick] + s, start[pick] + e + WINDOW


def _cut(rows: pa.Table, spans: pa.Table, schema: pa.Schema) -> pa.Table:
    """Rows with their covered bytes removed, and what was removed."""
    if not rows.num_rows:
        return schema.empty_table()
    home = Home(rows)
    got = [_unpack_spans(p) for p in spans.column("payload").to_pylist()]
    row, start, end = merge_spans(*(np.concatenate(c) for c in zip(*got))) if got else (np.zeros(0, np.int64),) * 3
    at = np.searchsorted(row, np.arange(len(home.ids) + 1))
    kept, size, removed, n_spans = [], [], [], []
    for i, text in enumerate(home.texts):
        a, b = at[i], at[i + 1]
        s, e = start[a:b].tolist(), end[a:b].tolist()
        kept.append(b"".join(text[x:y] for x, y in zip([0, *e], [*s, len(text)])) if s else text)
        size.append(len(text))
        removed.append(len(text) - len(kept[-1]))
        n_spans.append(len(s))
    rows = rows.take(pa.array(home.order, pa.int64()))
    data = {c: rows.column(c) for c in rows.column_names if c != _HOME}
    same = [k == t for k, t in zip(kept, home.texts)]
    old = rows.column("text").to_pylist()
    data["text"] = pa.array([o if eq else k.decode("utf-8", "ignore") for o, eq, k in zip(old, same, kept)], pa.string())
    data |= {"_tl_bytes": size, "_tl_removed": removed, "_tl_spans": n_spans, "_tl_sha256": [hashlib.sha256(k).hexdigest() for k in kept]}
    return pa.table([pa.chunked_array([pa.array(data[f.name], f.type)]) if isinstance(data[f.name], list) else data[f.name].cast(f.type)
                     for f in schema], schema=schema)


def sample_splitters(docs: DataFrame, total: int, buckets: int) -> np.ndarray:
    """At most ``buckets - 1`` leading words that deal the anchors of a sample of texts evenly; one that fills a bucket alone comes twice or more.

    A splitter stands for ``LEADS_PER_BUCKET`` sampled leading words at least, so that only a frequent one is repeated."""
    def leads(batches):
        for b in batches:
            home = Home(pa.table({"doc_id": [0] * b.num_rows, "text": b.column(0)}))
            p, _, _, y, _ = home.anchors()
            keep = p[y % np.uint64(SAMPLE_EVERY) == 0]
            yield pa.RecordBatch.from_arrays([pa.array(Words(home.buf).at(keep, ">").view(np.int64), pa.int64())], names=["lead"])

    size = max(SAMPLE_BYTES, buckets * SAMPLE_PER_BUCKET)
    part = docs.select("text").sample(min(1.0, size / max(1, total)), seed=7)
    got = part.mapInArrow(leads, "lead bigint").toPandas()["lead"].to_numpy(np.int64).view(np.uint64)
    got = np.sort(got)
    if not len(got):
        return np.zeros(0, np.uint64)
    ranges = min(buckets, max(1, len(got) // LEADS_PER_BUCKET))
    return got[np.arange(1, ranges) * len(got) // ranges]


def remove_repeats(docs: DataFrame) -> DataFrame:
    """All columns of ``docs`` with covered bytes cut out of ``text`` (a cut inside a character drops the
    rest of it), and ``_tl_bytes, _tl_removed, _tl_spans, _tl_sha256`` (of the kept bytes)."""
    from pyspark.sql.pandas.types import to_arrow_schema
    total = importable(docs).agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(8, math.ceil(total / HOME_BYTES))
    splitters = sample_splitters(docs, total, buckets)
    docs = docs.withColumn("doc_id", F.col("doc_id").cast("bigint"))
    homes = docs.withColumn(_HOME, home_of(buckets))
    by_home = homes.groupBy(_HOME)
    ask, send, back = "bucket int, home int, payload binary", "bucket int, home int, decided boolean, payload binary", "home int, payload binary"
    asked = by_home.applyInArrow(lambda t: _ask(t, buckets), ask)
    answers = asked.groupBy("bucket").applyInArrow(_answer, ask)
    sent = by_home.cogroup(answers.groupBy("home")).applyInArrow(lambda t, a: _send(t, a, buckets, splitters), send)
    spans = sent.groupBy("bucket").applyInArrow(_resolve, back)
    schema = T.StructType([*docs.schema.fields, *(T.StructField(c, T.LongType()) for c in ("_tl_bytes", "_tl_removed", "_tl_spans")),
                           T.StructField("_tl_sha256", T.StringType())])
    arrow = to_arrow_schema(schema)
    return by_home.cogroup(spans.groupBy("home")).applyInArrow(lambda t, s: _cut(t, s, arrow), schema)


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.col("_tl_bytes").alias("n_bytes"), F.col("_tl_removed").alias("n_removed"),
                      F.col("_tl_spans").alias("n_spans"), F.col("_tl_sha256").alias("kept_sha256"))
