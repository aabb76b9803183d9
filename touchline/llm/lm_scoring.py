"""Operator 1, LM scoring: prediction by partial matching over byte contexts.

Pretrained mode. The model is the counts of all (``ORDER`` context bytes, next byte) strings of all training
texts; it grows with them and is never gathered in one place. Each counting task merges its own counts before
it sends them, packed, to string buckets. Documents are dealt to home groups; each asks the buckets for its
distinct strings and gets back the log probability of each. A bucket is a range of contexts read backwards, from the byte before the symbol, between sampled splitters: a
context and all longer ones that end in it are neighbours there, so a bucket knows every context of its
strings but the few that reach over its ends (at most ``ORDER`` a splitter). The tables of those are added
up over the buckets first and broadcast. The trie of a bucket is a sorted table for each order; a shorter
context counts in how many longer ones a symbol was seen (update exclusion). A text's code length adds up,
byte by byte, the symbol's share in the longest context that knows it and the escapes on the way there, with
the symbols of the longer contexts excluded from the shorter ones; an unknown byte costs an equal share of the
unseen ones.

Adaptive mode (``adaptive_log10``) codes one text with a trie that grows as it reads.

The unigram base needs the corpus counts of every word. The vocabulary is not bounded, so it is never
broadcast: the home groups send their distinct words to word buckets and get back their counts.

Defined results: texts are read lower-cased (A-Z) with one end symbol; null text is empty (just the end); a
null ``doc_id`` counts as empty text in the fold; without training texts every byte costs 1/256; repeated rows
are learned and scored each; an empty table gives no row; only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.llm.common import checkpointed, chunks, crc_mod, doc_rows, home_of, importable, release, table, text_bytes
from touchline.llm.suffix_dedup import words_at

ORDER = 6
MOD, HELD = 10, 0
#: Text bytes of one home group.
HOME_BYTES = 12 << 20
#: Sampled text bytes for the splitters (of the order of a home group), and one in so many of their distinct strings.
SAMPLE_BYTES, SAMPLE_EVERY = 8 << 20, 16
#: Distinct strings a counting task holds before it merges them.
_MERGE = 1 << 21
#: Text bytes scored at once inside a task.
_SCORE_BYTES = 3 << 19
_HOME = "_tl_home"
#: Ends a text and fills the context before it; no UTF-8 text holds this byte.
END = b"\xff"
_MASK = [np.uint64((1 << (8 * k)) - 1) for k in range(8)] + [np.uint64(2**64 - 1)]
_TOP = [np.uint64(2**64 - (1 << (8 * (8 - k)))) for k in range(8)]
_BYTE, _SYMBOL = np.uint64(8), np.uint64(0xFF)


def is_held_out(doc_id, mod: int = MOD, held: int = HELD) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % mod == held


def strings_of(texts: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray]:
    """(context and symbol of every position to predict, as one number; positions of each text)."""
    buf = END * order + (END * order).join(texts) + END * order
    sizes = np.array([len(t) + 1 for t in texts], np.int64)
    n = len(buf)
    g = words_at(bytes(7) + buf, ">")[:n] & _MASK[order + 1]
    starts = order + np.concatenate([[0], np.cumsum(sizes + order - 1)[:-1]]) if len(texts) else np.zeros(0, np.int64)
    at = np.repeat(starts - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())
    return g[at], sizes


def add_up(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, with the sums of their counts."""
    if not len(keys):
        return keys, counts
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(counts, first)


def distinct_numbers(a: np.ndarray) -> np.ndarray:
    """Distinct numbers, ascending, by sorting (several times as fast as numpy's hashing for these)."""
    a = np.sort(a)
    return a[np.concatenate([[True], a[1:] != a[:-1]])] if len(a) else a


def _pack(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """Ascending keys (as differences) and counts, compressed."""
    delta = np.diff(keys, prepend=np.uint64(0))
    return zstandard.compress(delta.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes() + counts.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes(), 1)


def _unpack(payload: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(zstandard.decompress(payload), np.uint8).reshape(2, 8, -1)
    delta, counts = (np.ascontiguousarray(raw[i].T).view("<u8").ravel() for i in (0, 1))
    return np.cumsum(delta, dtype=np.uint64), counts.astype(np.int64)


def merged_strings(batches, order: int, mod: int, held: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct strings of a task's training texts, ascending, and their counts."""
    release()
    keys, counts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for part in chunks((d, t.lower()) for d, t in doc_rows(batches) if not is_held_out(d, mod, held)):
        g = np.sort(strings_of([t for _, t in part], order)[0])
        first = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
        keys.append(g[first])
        counts.append(np.diff(np.concatenate([first, [len(g)]])))
        if sum(map(len, keys)) > _MERGE + 2 * len(keys[0]):
            k, n = add_up(np.concatenate(keys), np.concatenate(counts))
            keys, counts = [k], [n]
    return add_up(np.concatenate(keys), np.concatenate(counts))


class Trie:
    """Sorted tables of strings and contexts, an entry per order."""

    def __init__(self, tables: list[tuple[np.ndarray, np.ndarray]]):
        """``tables[o]``: ascending strings of order ``o`` and their counts."""
        self.order = len(tables) - 1
        self.strings = [t[0] for t in tables]
        self.counts = [t[1].astype(np.int32 if len(t[1]) and t[1].max() < 1 << 31 else np.int64) for t in tables]
        self.contexts, self.total, self.kinds, self.excluded = [], [], [], []
        for o, (k, n) in enumerate(tables):
            ctx = self.context(k)
            first = np.flatnonzero(np.concatenate([[True], ctx[1:] != ctx[:-1]])) if len(k) else np.zeros(0, np.int64)
            self.contexts.append(ctx[first])
            self.total.append(np.add.reduceat(n, first) if len(k) else n)
            self.kinds.append(np.diff(np.concatenate([first, [len(k)]])).astype(np.int16))
            if o and len(k):  # what this context's symbols count in the shorter one
                lower = self.counts[o - 1][np.searchsorted(self.strings[o - 1], self.cut(k, o - 1))]
                self.excluded.append(np.add.reduceat(lower, first, dtype=np.int64))
            else:
                self.excluded.append(np.zeros(len(first), np.int64))

    @staticmethod
    def context(k: np.ndarray) -> np.ndarray:
        return k >> _BYTE

    @staticmethod
    def cut(k: np.ndarray, o: int) -> np.ndarray:
        """The strings' ends of order ``o``."""
        return k & _MASK[o + 1]

    def log10(self, g: np.ndarray) -> np.ndarray:
        """log10 probability of each string's symbol after its context."""
        out, left = np.zeros(len(g)), np.arange(len(g))
        gone, kinds_gone = np.zeros(len(g)), np.zeros(len(g))
        for o in range(self.order, -1, -1):
            if not len(left) or not len(self.contexts[o]):
                continue
            s = self.cut(g[left], o)
            c = self.context(s)
            i = np.minimum(np.searchsorted(self.contexts[o], c), len(self.contexts[o]) - 1)
            known = self.contexts[o][i] == c
            j = np.minimum(np.searchsorted(self.strings[o], s), len(self.strings[o]) - 1)
            hit = self.strings[o][j] == s
            total, kinds = self.total[o][i] - gone[left], self.kinds[o][i] - kinds_gone[left]
            out[left[hit]] += np.log10((self.counts[o][j[hit]] - 0.5) / total[hit])
            escape = known & ~hit
            pay = escape & (kinds > 0)
            out[left[pay]] += np.log10(0.5 * kinds[pay] / total[pay])
            gone[left[escape]], kinds_gone[left[escape]] = self.excluded[o][i[escape]], self.kinds[o][i[escape]]
            left = left[~hit]
        out[left] -= np.log10(256 - kinds_gone[left])
        return out

    def score(self, texts: list[bytes]) -> np.ndarray:
        """log10 probability of each text with its end; equal strings are looked up once."""
        if not texts:
            return np.zeros(0)
        g, sizes = strings_of(texts, self.order)
        distinct, of = np.unique(g, return_inverse=True)
        return np.add.reduceat(self.log10(distinct)[of], np.cumsum(sizes) - sizes)


class BackwardTrie(Trie):
    """A trie of strings as ``backward`` writes them: the contexts of ascending strings ascend at every order."""

    @staticmethod
    def context(k: np.ndarray) -> np.ndarray:
        return k & ~_SYMBOL

    @staticmethod
    def cut(k: np.ndarray, o: int) -> np.ndarray:
        return (k & _TOP[o]) | (k & _SYMBOL)


def backward(g: np.ndarray) -> np.ndarray:
    """Strings with their context read backwards in the high bytes, and the symbol in the lowest."""
    return (g >> _BYTE).byteswap() | (g & _SYMBOL)


def adaptive_log10(text: bytes, order: int = ORDER) -> float:
    """log10 probability of a text with its end under a trie that learns each byte after coding it."""
    trie: dict[bytes, Counter] = {}
    buf, total = END * order + text + END, 0.0
    for i in range(order, len(buf)):
        s, excluded = buf[i], frozenset()
        path = []
        for o in range(order, -1, -1):
            ctx = buf[i - o:i]
            node = trie.get(ctx)
            path.append(ctx)
            if not node:
                continue
            n = sum(c for x, c in node.items() if x not in excluded)
            kinds = sum(1 for x in node if x not in excluded)
            if s in node:
                total += math.log10((node[s] - 0.5) / n)
                break
            if kinds:
                total += math.log10(0.5 * kinds / n)
            excluded = frozenset(node)
        else:
            total -= math.log10(256 - len(excluded))
        for ctx in path:  # update exclusion: shorter contexts than the one that knew it stay as they are
            trie.setdefault(ctx, Counter())[s] += 1
    return total


def sample_splitters(docs: DataFrame, total: int, buckets: int, order: int = ORDER) -> np.ndarray:
    """At most ``buckets - 1`` backward contexts that deal the distinct strings of a bounded sample evenly."""
    def strings(batches):
        for part in chunks((None, t.lower()) for t in (t for b in batches for t in text_bytes(b.column(0)))):
            r = distinct_numbers(backward(strings_of([t for _, t in part], order)[0]))
            keep = r[(r * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40) & np.uint64(SAMPLE_EVERY - 1) == 0]
            yield pa.RecordBatch.from_arrays([pa.array(keep.view(np.int64), pa.int64())], names=["string"])

    part = docs.select("text").sample(min(1.0, SAMPLE_BYTES / max(1, total)), seed=7)
    got = np.unique(part.mapInArrow(strings, "string bigint").toPandas()["string"].to_numpy(np.int64).view(np.uint64))
    if not len(got):
        return np.zeros(0, np.uint64)
    return np.unique(got[np.arange(1, buckets) * len(got) // buckets] & ~_SYMBOL)


def _reaching(bucket: int, splitters: np.ndarray, o: int) -> np.ndarray:
    """The contexts of order ``o`` that may reach over the ends of a bucket."""
    return splitters[max(0, bucket - 1):bucket + 1] & _TOP[o]


def learn_strings(docs: DataFrame, order: int, splitters: np.ndarray, mod: int, held: int) -> DataFrame:
    """``bucket, payload``: the training strings of each string bucket with their counts (packed)."""
    def count(batches):
        k, n = merged_strings(batches, order, mod, held)
        k, n = add_up(backward(k), n)
        cut = np.searchsorted(k, splitters)
        rows = [(-1 - b, _pack(own, c)) for b, (own, c) in enumerate(zip(np.split(k, cut), np.split(n, cut))) if len(own)]
        cols = list(zip(*rows)) or [()] * 2
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.binary())], names=["bucket", "payload"])

    def merge(rows: pa.Table) -> pa.Table:
        release()
        k, n = add_up(*(np.concatenate(c) for c in zip(*map(_unpack, rows.column("payload").to_pylist()))))
        return pa.table([rows.column("bucket").slice(0, 1), pa.array([_pack(k, n)], pa.binary())], names=["bucket", "payload"])

    schema = "bucket int, payload binary"
    return docs.mapInArrow(count, schema).groupBy("bucket").applyInArrow(merge, schema)


def _columns(a: np.ndarray) -> bytes:
    """The first bytes of all items, the second ones, and so on."""
    return a.view(np.uint8).reshape(-1, a.itemsize).T.tobytes()


def _pack_keys(keys: np.ndarray) -> bytes:
    return zstandard.compress(_columns(keys.astype("<u8")), 1)


def _unpack_keys(payload: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zstandard.decompress(payload), np.uint8).reshape(8, -1).T).view("<u8").ravel()


def _pack_logs(values: np.ndarray, code: np.ndarray) -> bytes:
    """``values[code]``, as the values in use and the place of each among them."""
    used, at = np.unique(code, return_inverse=True)
    return zstandard.compress(np.array([len(used)], "<u8").tobytes() + values[used].astype("<f8").tobytes() + _columns(at.astype("<u4")), 1)


def _unpack_logs(payload: bytes) -> np.ndarray:
    raw = zstandard.decompress(payload)
    n = int(np.frombuffer(raw, "<u8", 1)[0])
    at = np.ascontiguousarray(np.frombuffer(raw, np.uint8, -1, 8 + 8 * n).reshape(4, -1).T).view("<u4").ravel()
    return np.frombuffer(raw, "<f8", n, 8)[at]


def _reach_rows(bucket: int, payload: bytes, order: int, splitters: np.ndarray) -> list[tuple]:
    """(order, payload): strings of the contexts that reach over a bucket's ends, and in how many longer
    contexts that do not each was seen here."""
    k, out = _unpack(payload)[0], []
    for o in range(order - 1, -1, -1):
        whole = np.ones(len(k), bool) if o + 1 == order else ~np.isin(k & _TOP[o + 1], _reaching(bucket, splitters, o + 1))
        short, n = add_up(BackwardTrie.cut(k, o), whole.astype(np.int64))
        own = np.isin(short & _TOP[o], _reaching(bucket, splitters, o))
        out.append((o, _pack(short[own], n[own])))
        k = short
    return out


def reach_tables(learned: DataFrame, order: int, splitters: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """``add_up_reach`` over all buckets."""
    def run(batches):
        release()
        for b in batches:
            rows = [r for k, p in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for r in _reach_rows(-1 - k, p, order, splitters)]
            cols = list(zip(*rows)) or [()] * 2
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.binary())], names=["ord", "payload"])

    return add_up_reach(learned.mapInArrow(run, "ord int, payload binary").toLocalIterator(), order)


def add_up_reach(rows, order: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Strings and counts, for each order below the highest, of the contexts that reach over buckets."""
    parts: list[list] = [[(np.zeros(0, np.uint64), np.zeros(0, np.int64))] for _ in range(order)]
    for r in rows:
        parts[r.ord].append(_unpack(r.payload))
    longer, tables = np.zeros(0, np.uint64), [None] * order
    for o in range(order - 1, -1, -1):
        # a longer context that reaches over buckets itself counts once, wherever it was seen
        parts[o].append((BackwardTrie.cut(longer, o), np.ones(len(longer), np.int64)))
        tables[o] = add_up(*(np.concatenate(c) for c in zip(*parts[o])))
        longer = tables[o][0]
    return tables


def bucket_trie(bucket: int, k: np.ndarray, n: np.ndarray, order: int, splitters: np.ndarray, reach: list) -> BackwardTrie:
    """Every context of the strings of a bucket, from its training strings and the tables of ``add_up_reach``."""
    tables = [(k, n)]
    for o in range(order - 1, -1, -1):
        k, n = add_up(BackwardTrie.cut(k, o), np.ones(len(k), np.int64))
        ends = _reaching(bucket, splitters, o)
        own, far = ~np.isin(k & _TOP[o], ends), np.isin(reach[o][0] & _TOP[o], ends)
        tables.append(add_up(np.concatenate([k[own], reach[o][0][far]]), np.concatenate([n[own], reach[o][1][far]])))
    return BackwardTrie(tables[::-1])


def _answer_strings(rows: pa.Table, learned: pa.Table, order: int, splitters: np.ndarray, reach) -> pa.Table:
    """log10 probabilities of a bucket's strings, sent back in each asking group's own order."""
    k, n = _unpack(learned.column("payload")[0].as_py()) if learned.num_rows else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    trie = bucket_trie(-1 - rows.column("bucket")[0].as_py(), k, n, order, splitters, reach)
    asked = [_unpack_keys(p) for p in rows.column("words").to_pylist()]
    every = distinct_numbers(np.concatenate(asked))
    values, code = np.unique(trie.log10(every), return_inverse=True)
    return pa.table([rows.column("bucket"), rows.column("home"),
                     pa.array([_pack_logs(values, code[np.searchsorted(every, a)]) for a in asked], pa.binary())], names=["bucket", "home", "counts"])


def _answer(rows: pa.Table, learned: pa.Table, order: int, splitters: np.ndarray, reach) -> pa.Table:
    """What a word or string bucket sends back to the home groups."""
    release()
    if not rows.num_rows:
        return pa.table([pa.array([], t) for t in (pa.int32(), pa.int32(), pa.binary())], names=["bucket", "home", "counts"])
    if rows.column("bucket")[0].as_py() < 0:
        return _answer_strings(rows, learned, order, splitters, reach)
    return _answer_words(rows).select(["bucket", "home", "counts"])


def _word_totals(rows: pa.Table) -> pa.Table:
    """Distinct training words of a word bucket, and how often they occur."""
    return _answer_words(rows).select(["kinds", "total"]) if rows.column("bucket")[0].as_py() >= 0 else pa.table(
        [pa.array([], pa.int64())] * 2, names=["kinds", "total"])


#: Word buckets count from 0 up, string buckets from -1 down.
_ASK = "bucket int, home int, words binary, counts binary"
_BACK = "bucket int, home int, counts binary"
#: The end token's place among the words (no word is empty).
_END_WORD = b""


def _word_tables(rows: pa.Table, buckets: int, mod: int, held: int) -> list[tuple[int, list[bytes], np.ndarray]]:
    """(bucket, its words in order, their training counts) of a home group; held-out words count zero."""
    count: Counter = Counter()
    others: set = set()
    for d, t in zip(rows.column("doc_id").to_pylist(), text_bytes(rows.column("text"))):
        words = t.lower().split()
        if is_held_out(d, mod, held):
            others.update(words)
            others.add(_END_WORD)
        else:
            count.update(words)
            count[_END_WORD] += 1
    return [(b, ws, np.array([count[w] for w in ws], "<i8")) for b, ws in _deal_words(others.union(count), buckets)]


def _deal_words(words: set, buckets: int) -> list[tuple[int, list[bytes]]]:
    """(bucket, its words in order)."""
    dealt: list[list] = [[] for _ in range(buckets)]
    for w in sorted(words):
        dealt[zlib.crc32(w) % buckets].append(w)
    return [(b, ws) for b, ws in enumerate(dealt) if ws]


def _ask(rows: pa.Table, buckets: int, order: int, splitters: np.ndarray, mod: int, held: int) -> pa.Table:
    """Words with their training counts, and distinct strings, of a home group, a row for each bucket."""
    release()
    home = rows.column(_HOME)[0].as_py()
    k = distinct_numbers(np.concatenate([distinct_numbers(backward(strings_of([t.lower() for _, t in part], order)[0]))
                                  for part in chunks(((None, t) for t in text_bytes(rows.column("text"))), _SCORE_BYTES)]))
    strings = [(-1 - b, home, _pack_keys(own), None) for b, own in enumerate(np.split(k, np.searchsorted(k, splitters))) if len(own)]
    got = strings + [(b, home, zstandard.compress(b" ".join(ws), 1), zstandard.compress(n.tobytes(), 1)) for b, ws, n in _word_tables(rows, buckets, mod, held)]
    cols = list(zip(*got)) or [()] * 4
    return pa.table([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int32(), pa.binary(), pa.binary()))], names=["bucket", "home", "words", "counts"])


def _answer_words(rows: pa.Table) -> pa.Table:
    """Corpus counts of a word bucket, sent back in each asking group's own order."""
    number: dict[bytes, int] = {}
    asked, given = [], []
    for words, counts in zip(rows.column("words").to_pylist(), rows.column("counts").to_pylist()):
        ws = zstandard.decompress(words).split(b" ")
        asked.append(np.fromiter((number.setdefault(w, len(number)) for w in ws), np.int64, len(ws)))
        given.append(np.frombuffer(zstandard.decompress(counts), "<i8"))
    total = np.zeros(len(number), np.int64)
    for i, n in zip(asked, given):
        np.add.at(total, i, n)
    some = [int((total > 0).sum()), int(total.sum())]
    n = rows.num_rows
    return pa.table([rows.column("bucket"), rows.column("home"), pa.array([zstandard.compress(total[i].astype("<i8").tobytes(), 1) for i in asked], pa.binary()),
                     pa.array([some[0]] + [0] * (n - 1), pa.int64()), pa.array([some[1]] + [0] * (n - 1), pa.int64())],
                    names=["bucket", "home", "counts", "kinds", "total"])


def _string_scores(texts: list[bytes], order: int, back: dict) -> np.ndarray:
    """log10 probability of each text with its end, from the answers of the string buckets."""
    parts = []
    for part in chunks(((None, t) for t in texts), _SCORE_BYTES):
        r, sizes = strings_of([t for _, t in part], order)
        distinct, of = np.unique(backward(r), return_inverse=True)
        parts.append((distinct, of.astype(np.int32), sizes))
    every = distinct_numbers(np.concatenate([p[0] for p in parts]))
    log = np.concatenate([_unpack_logs(back[b]) for b in sorted((b for b in back if b < 0), reverse=True)])
    return np.concatenate([np.add.reduceat(log[np.searchsorted(every, d)][of], np.cumsum(sizes) - sizes) for d, of, sizes in parts])


_SCORED = "doc_id bigint, n_tokens bigint, n_known bigint, logs double, score double"


def _score_home(rows: pa.Table, answers: pa.Table, buckets: int, mod: int, held: int, order: int) -> pa.Table:
    release()
    names = [c.split()[0] for c in _SCORED.split(", ")]
    types = (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64())
    if not rows.num_rows:
        return pa.table([pa.array([], t) for t in types], names=names)
    counts: dict[bytes, int] = {}
    back = dict(zip(answers.column("bucket").to_pylist(), answers.column("counts").to_pylist()))
    ids, texts = rows.column("doc_id").to_pylist(), [t.lower() for t in text_bytes(rows.column("text"))]
    scores = _string_scores(texts, order, back)
    for b, ws in _deal_words({_END_WORD}.union(*(t.split() for t in texts)), buckets):
        counts.update(zip(ws, np.frombuffer(zstandard.decompress(back[b]), "<i8").tolist()))
    tokens, known, logs = [], [], []
    for t in texts:
        words = t.split()
        words.append(_END_WORD)
        c = np.array([counts[w] for w in words], np.float64)
        tokens.append(len(words))
        known.append(int((c > 0).sum()))
        logs.append(float(np.log10(c + 0.1).sum()))
    return pa.table([pa.array(c, t) for c, t in zip((ids, tokens, known, logs, scores), types)], names=names)


def score_documents(docs: DataFrame, order: int = ORDER, mod: int = MOD, held: int = HELD) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of every text."""
    spark = importable(docs).sparkSession
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    homes = max(8, math.ceil(size / HOME_BYTES))
    splitters = sample_splitters(docs, size, homes, order)
    by_home = docs.withColumn(_HOME, home_of(homes)).groupBy(_HOME)
    learned = checkpointed(learn_strings(docs, order, splitters, mod, held))
    reach = spark.sparkContext.broadcast(reach_tables(learned, order, splitters))  # at most ``order`` contexts a splitter
    asked = by_home.applyInArrow(lambda t: _ask(t, homes, order, splitters, mod, held), _ASK).groupBy("bucket")
    totals = asked.applyInArrow(_word_totals, "kinds bigint, total bigint").agg(
        F.coalesce(F.sum("kinds"), F.lit(0)).alias("kinds"), F.coalesce(F.sum("total"), F.lit(0)).alias("total"))
    answers = asked.cogroup(learned.groupBy("bucket")).applyInArrow(lambda t, m: _answer(t, m, order, splitters, reach.value), _BACK)
    scored = by_home.cogroup(answers.groupBy("home")).applyInArrow(
        lambda t, a: _score_home(t, a, homes, mod, held, order), _SCORED)
    n, v = totals.select("total").scalar(), totals.select("kinds").scalar()
    return scored.select(
        "doc_id", (crc_mod("doc_id", mod) == held).alias("held_out"), "n_tokens", "n_known", n.alias("train_tokens"),
        (F.col("logs") - F.col("n_tokens") * F.log10(n + 0.1 * (v + 1))).alias("base_score"), "score")


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"))
