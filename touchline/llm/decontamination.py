"""Operator 2, benchmark decontamination: template windows and consistent slots.

Texts become templates: numbers, names and units turn into typed placeholders (a run of one type is one
slot), other words are lower-cased and stripped of punctuation. Windows of ``WIDTH`` template tokens are hashed. An
item is found in a document that holds at least ``SIMILAR`` of its windows, and whose slot values map to
the item's consistently (a value that the item repeats stands against one and the same value of the
document, in at least ``CONSISTENT`` of such slots): a re-parameterised copy swaps values, a chance match mixes them.

A capital word may be a name or not, so items and documents are both read in three ways and an item is found if any
finds it: names are capital words inside sentences (``INSIDE``), capital words anywhere (``ANYWHERE``: names that start a
sentence too), or nothing (``NOWHERE``: copies in other case). Characters of scripts written without spaces are words.

An item without evidence in any window (short, or mostly numbers and names) is found by its words as they are, values
included and case left out: in a row anywhere in a document, or, with fewer than ``SHORT`` words, as the whole document.

The benchmark's windows are broadcast in blocks of at most ``BLOCK_WINDOWS``, each block meets every
document in one pass without a shuffle, and all windows of all items are used. Only the rarest windows of
an item name it as a candidate (an item with enough common windows shares at least one of any
``floor((1 - SIMILAR) n) + 1``), so a phrase that all items share gives no pairs; candidates are then
counted exactly.

Defined results: null text is empty and holds nothing; a null or empty item, or one of punctuation only, matches
nothing; windows that hold fewer than two literal words are no
evidence; repeated benchmark rows count once, repeated documents are reported each; an empty table on either side gives no pair.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from touchline.llm.common import chunks, importable, release, table, text_bytes

WIDTH, SIMILAR, CONSISTENT = 5, 0.8, 0.8
#: An item without evidence of fewer words counts only as a whole document: such a phrase stands in many texts by chance.
SHORT = 3
BLOCK_WINDOWS = 1 << 21
CACHE_WORDS = 400_000
#: Words written for numbers, and units that follow one.
NUMBER_WORDS = frozenset("""zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen
eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion half dozen""".split())
UNITS = frozenset("""mm cm m km inch inches foot feet ft yard yards mile miles mg g kg gram grams kilogram kilograms ton tons tonnes pound pounds lb
lbs ounce ounces oz ml l litre litres liter liters gallon gallons second seconds s minute minutes min hour hours h day days week weeks month
months year years cent cents dollar dollars euro euros usd eur percent % degree degrees c f k mph kmh w kw v a hz mb gb tb meter meters
metre metres""".split())
_NUMBER = re.compile(r"[$€£¥]?[+-]?\d+(?:[.,:/]\d+)*(?:st|nd|rd|th)?(%|[a-z]{1,4})?[%€]?\Z", re.I)
_EDGE = " \t\n.,;:!?\"'`()[]{}<>|“”‘’«»„…*_~#&$%@=+-/\\^€£¥、。，．！？：；（）「」"
#: Characters of scripts without spaces: Thai, Lao, Burmese, Khmer, Kana, Chinese; and the first bytes they may have.
_UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3001-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uff01-\uff1f\U00020000-\U0003ffff]")
_MAYBE = re.compile(b"[\xe0\xe1\xe3-\xe9\xef\xf0]")

_STOPS = frozenset(".!?:。！？")

LITERAL, NUMBER, CAPITAL, UNIT, NOTHING = range(5)
#: Ways to read capital words.
NOWHERE, INSIDE, ANYWHERE = range(3)
NAME = CAPITAL  # a capital word inside a sentence
#: A word's number holds its hash, whether it ends a sentence, and its class.
_CLASS, _ENDS, _HASH = np.uint64(7), np.uint64(8), ~np.uint64(15)
_SLOT = {k: np.uint64(xxhash.xxh64_intdigest(f"slot {k}") & ~15) for k in (NUMBER, NAME, UNIT)}
_P = np.uint64(0x9E3779B97F4A7C15)
#: A filter before the search among the windows: marks by their leading bits.
_MARKS, _MARK_SHIFT = 1 << 20, np.uint64(44)


_WORD_KINDS = {**dict.fromkeys(UNITS, UNIT), **dict.fromkeys(NUMBER_WORDS, NUMBER)}


def split_words(text: bytes) -> list[bytes]:
    """White-space separated words, and each character of a script without spaces by itself."""
    if _MAYBE.search(text):
        text = _UNSPACED.sub(r" \g<0> ", text.decode("utf-8", "replace")).encode()
    return text.split()


def read_word(word: bytes) -> int:
    """Hash, sentence end and class of one white-space separated word, in one number."""
    raw = word.decode("utf-8", "replace")
    core = raw.rstrip(".,;:!?")
    if core.isalpha():  # most words: letters, then marks
        low = core.lower()
        kind = _WORD_KINDS.get(low) or (CAPITAL if core[0].isupper() else LITERAL)
        return (xxhash.xxh64_intdigest(low) & ~15) | (8 if raw[-1] in _STOPS else 0) | kind
    ends = 8 if raw.rstrip("\"'”’»)]")[-1:] in _STOPS else 0
    value = raw.rstrip(".,;:!?)]\"'").lstrip("([\"'").lower()
    if _NUMBER.match(value):
        return (xxhash.xxh64_intdigest(value) & ~15) | ends | NUMBER
    core = raw.strip(_EDGE)
    low = core.lower()
    if not core:
        return ends | (UNIT if raw.strip(".,;:!?") in UNITS else NOTHING)
    if low in NUMBER_WORDS:
        return (xxhash.xxh64_intdigest(low) & ~15) | ends | NUMBER
    kind = UNIT if low in UNITS else CAPITAL if core[0].isupper() else LITERAL
    return (xxhash.xxh64_intdigest(low) & ~15) | ends | kind


class Words(dict):
    """``read_word`` of words seen lately; forgets all when ``CACHE_WORDS`` are held."""

    def __missing__(self, word):
        if len(self) >= CACHE_WORDS:
            self.clear()
        self[word] = v = read_word(word)
        return v


class Reading:
    """One text's words that are not punctuation: numbers of the words (``plain``) and their places."""

    def __init__(self, codes: np.ndarray):
        cls = (codes & _CLASS).astype(np.int8)
        self.at, self.length = np.flatnonzero(cls != NOTHING), len(codes)
        kept = codes[self.at]
        self.cls, self.plain, self.ended = cls[self.at], kept & _HASH, np.concatenate([[True], (kept[:-1] & _ENDS) != 0])
        self.capital = self.cls == CAPITAL

    def ways(self) -> list[int]:
        """The ways to read capitals that give different templates."""
        if not self.capital.any():
            return [NOWHERE]
        return [NOWHERE, ANYWHERE, INSIDE] if (self.capital & self.ended[:len(self.cls)]).any() else [NOWHERE, ANYWHERE]


class Template:
    """Template tokens of one text: hashes, slot types (0: literal) and the first word of each."""

    def __init__(self, reading: Reading, way: int = INSIDE):
        cls, at = reading.cls, reading.at
        h = reading.plain.copy()
        if len(at):
            after_number = np.concatenate([[False], cls[:-1] == NUMBER])
            slot = np.where(cls == NUMBER, NUMBER, np.where((cls == UNIT) & after_number, UNIT, 0))
            if way != NOWHERE:
                slot[reading.capital if way == ANYWHERE else reading.capital & ~reading.ended] = NAME
            for k, v in _SLOT.items():
                h[slot == k] = v
            same = np.concatenate([[False], (slot[1:] == slot[:-1]) & (slot[1:] > 0)])
            first = np.flatnonzero(~same)
            self.h, self.slot, self.word = h[first], slot[first], at[first]
            self.stop = np.concatenate([self.word[1:], [reading.length]])
        else:
            self.h, self.slot, self.word, self.stop = h, cls, at, at

    def windows(self) -> np.ndarray:
        """Hash of the window from each token; zero where it holds fewer than two literal words."""
        n = len(self.h) - WIDTH + 1
        if n < 1:
            return np.zeros(0, np.uint64)
        w = self.h[:n].copy()
        literal = (self.slot[:n] == 0).astype(np.int8)
        for k in range(1, WIDTH):
            w = (w ^ (w >> np.uint64(29))) * _P + self.h[k:n + k]
            literal += self.slot[k:n + k] == 0
        w *= _P
        w ^= w >> np.uint64(32)
        return np.where(literal >= 2, w | np.uint64(1), np.uint64(0))


class Side:
    """The items of a block, read one way: their windows, and which items the rare ones name."""

    def __init__(self, readings: list[Reading], way: int):
        self.way = way
        self.templates = [Template(r, way) for r in readings]
        own = [np.unique(w[w != 0]) for w in (t.windows() for t in self.templates)]
        self.hashes, counts = np.unique(np.concatenate(own), return_counts=True) if own else (np.zeros(0, np.uint64), np.zeros(0, int))
        self.marks = np.zeros(_MARKS, bool)
        self.marks[(self.hashes >> _MARK_SHIFT).astype(np.int64)] = True
        self.windows = [np.searchsorted(self.hashes, w) for w in own]
        self.named: dict[int, list[int]] = {}
        for i, w in enumerate(self.windows):
            rare = w[np.argsort(counts[w], kind="stable")][:int((1 - SIMILAR) * len(w) + 1e-9) + 1]
            for k in rare.tolist():
                self.named.setdefault(k, []).append(i)

    def places(self, windows: np.ndarray) -> dict[int, list[int]]:
        """Where the windows of the block (by number) lie in a document."""
        near = np.flatnonzero(self.marks[(windows >> _MARK_SHIFT).astype(np.int64)])
        if not len(near):
            return {}
        at = np.minimum(np.searchsorted(self.hashes, windows[near]), len(self.hashes) - 1)
        same = self.hashes[at] == windows[near]
        place: dict[int, list[int]] = {}
        for q, k in zip(near[same].tolist(), at[same].tolist()):
            place.setdefault(k, []).append(q)
        return place


class ItemBlock:
    """A block of items: their windows by way of reading, and the words of those without evidence."""

    def __init__(self, items: list[tuple]):
        self.ids = [i for i, _ in items]
        words = Words()
        self.words = [split_words((t or "").encode()) for _, t in items]
        readings = [Reading(np.fromiter(map(words.__getitem__, w), np.uint64, len(w))) for w in self.words]
        self.sides = [Side(readings, way) for way in (NOWHERE, INSIDE, ANYWHERE)]
        self.exact: dict[bytes, list[int]] = {}
        self.lengths: dict[int, set[int]] = {}
        for i, r in enumerate(readings):
            if len(r.plain) and not any(len(s.windows[i]) for s in self.sides):
                self.exact.setdefault(r.plain.tobytes(), []).append(i)
                if len(r.plain) >= SHORT:
                    self.lengths.setdefault(self._start(r.plain[:SHORT]), set()).add(len(r.plain))
        self.starts = np.array(sorted(self.lengths), np.uint64)

    @staticmethod
    def _start(plain: np.ndarray):
        """One number for the first ``SHORT`` words; of an array of words, for those from each place."""
        n = len(plain) - SHORT + 1
        h = plain[:n].copy()
        for k in range(1, SHORT):
            h = (h ^ (h >> np.uint64(29))) * _P + plain[k:n + k]
        return int(h[0]) if n == 1 else h

    def search(self, reading: Reading, words: list[bytes]) -> list[tuple]:
        """(item id, windows, matched, slots, consistent, changed, first word, last word) of each item found."""
        found = self._as_they_are(reading)
        own, templates, windows = reading.ways(), {}, {}
        for side in self.sides:
            if not len(side.hashes):
                continue
            # where two ways give one template, the text is read once
            way = side.way if side.way in own else ANYWHERE if ANYWHERE in own else NOWHERE
            if way not in templates:
                templates[way] = Template(reading, way)
                windows[way] = templates[way].windows()
            for i, hit in self._by_windows(side, templates[way], windows[way], words):
                if i not in found or hit[1] * found[i][0] > found[i][1] * hit[0]:  # the larger share of windows
                    found[i] = hit
        return [(self.ids[i], *found[i]) for i in sorted(found)]

    def _as_they_are(self, r: Reading) -> dict[int, tuple]:
        """Items without evidential windows, word for word."""
        out: dict[int, tuple] = {}

        def take(q, n):
            for i in self.exact.get(r.plain[q:q + n].tobytes(), ()):
                out.setdefault(i, (1, 1, 0, 0, 0, int(r.at[q]), int(r.at[q + n - 1])))

        if self.exact and 0 < len(r.plain):
            if len(r.plain) < SHORT:
                take(0, len(r.plain))
            elif len(self.starts):
                h = np.atleast_1d(np.asarray(self._start(r.plain), np.uint64))
                at = np.minimum(np.searchsorted(self.starts, h), len(self.starts) - 1)
                for q in np.flatnonzero(self.starts[at] == h).tolist():
                    for n in self.lengths[int(h[q])]:
                        if q + n <= len(r.plain):
                            take(q, n)
        return out

    def _by_windows(self, side: Side, template: Template, windows: np.ndarray, words: list[bytes]):
        place = side.places(windows)
        for i in sorted({i for k in place for i in side.named.get(k, ())}):
            own = side.windows[i].tolist()
            n = sum(k in place for k in own)
            if n >= SIMILAR * len(own):
                slots, consistent, changed, first, last = self._slots(side, i, place, template, words)
                if consistent >= CONSISTENT * slots:
                    yield i, (len(own), n, slots, consistent, changed, first, last)

    def _slots(self, side, i, place, template, words):
        """Slot values of the item against those of the document along its best alignment."""
        item, own = side.templates[i], side.templates[i].windows()
        at = np.minimum(np.searchsorted(side.hashes, own), len(side.hashes) - 1)
        pairs = [(p, q) for p, k in enumerate(at.tolist()) if own[p] for q in place.get(k, ())]
        shifts: dict[int, int] = {}
        for p, q in pairs:
            shifts[q - p] = shifts.get(q - p, 0) + 1
        best = max(shifts, key=lambda s: (shifts[s], -s))
        chosen: dict[int, int] = {}
        for p, q in sorted(pairs, key=lambda x: abs(x[1] - x[0] - best)):
            for k in range(WIDTH):
                chosen.setdefault(p + k, q + k)

        def value(t, ws, k):
            return b" ".join(ws[t.word[k]:t.stop[k]]).strip(b".,;:!?()[]\"'").lower()

        seen: dict[tuple, dict[bytes, int]] = {}
        changed = 0
        for p, q in chosen.items():
            if item.slot[p]:
                a, b = value(item, self.words[i], p), value(template, words, q)
                changed += a != b
                own_values = seen.setdefault((int(item.slot[p]), a), {})
                own_values[b] = own_values.get(b, 0) + 1
        again = [v for v in seen.values() if sum(v.values()) > 1]  # a value that comes once can't contradict itself
        slots = sum(sum(v.values()) for v in again)
        inside = list(chosen.values())
        return slots, sum(max(v.values()) for v in again), changed, int(template.word[min(inside)]), int(template.stop[max(inside)] - 1)


def item_blocks(benchmark: DataFrame):
    """Blocks of items of at most ``BLOCK_WINDOWS`` windows (a longer item is a block of its own)."""
    held, size = [], 0
    for r in benchmark.select("item_id", "text").distinct().orderBy("item_id", "text").toLocalIterator():
        n = (r.text or "").count(" ") + 1
        if held and size + n > BLOCK_WINDOWS:
            yield ItemBlock(held)
            held, size = [], 0
        held.append((r.item_id, r.text))
        size += n
    if held:
        yield ItemBlock(held)


def _searched(texts: list[bytes], block: ItemBlock, cache: Words):
    """What the block finds in each text."""
    for part in chunks(((i, t) for i, t in enumerate(texts)), 1 << 20):
        split = [split_words(t) for _, t in part]
        codes = [np.fromiter(map(cache.__getitem__, w), np.uint64, len(w)) for w in split]
        for c, w in zip(codes, split):
            yield block.search(Reading(c), w)


PAIRS = ("doc_id bigint, item_id bigint, n_windows bigint, n_matched bigint, n_slots bigint, n_consistent bigint, "
         "n_changed bigint, first_word bigint, last_word bigint")


def find_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """A row for each document and item found in it, with the matched words' range (by ``split_words``, from 0)."""
    spark, out = docs.sparkSession, None
    docs = importable(docs).select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    names = [c.split()[0] for c in PAIRS.split(", ")]
    for block in item_blocks(benchmark.withColumn("item_id", F.col("item_id").cast("bigint"))):
        sent = spark.sparkContext.broadcast(block)  # at most BLOCK_WINDOWS windows

        def run(batches, sent=sent):
            release()
            cache = Words()
            for b in batches:
                rows = [(d, *f) for d, found in zip(b.column(0).to_pylist(), _searched(text_bytes(b.column(1)), sent.value, cache)) for f in found]
                cols = list(zip(*rows)) or [()] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=names)
            cache.clear()
            release()

        part = docs.mapInArrow(run, PAIRS)
        out = part if out is None else out.union(part)
    return spark.createDataFrame([], PAIRS) if out is None else out


def drop_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Rows of ``docs``, all columns, in which no item is found."""
    spark = importable(docs).sparkSession
    at = docs.columns.index("text")
    for block in item_blocks(benchmark.withColumn("item_id", F.col("item_id").cast("bigint"))):
        sent = spark.sparkContext.broadcast(block)

        def run(batches, sent=sent):
            release()
            cache = Words()
            for b in batches:
                yield b.filter(pa.array([not f for f in _searched(text_bytes(b.column(at)), sent.value, cache)], pa.bool_()))
            cache.clear()
            release()

        docs = docs.mapInArrow(run, T.StructType([T.StructField(f.name, f.dataType) for f in docs.schema]))
    return docs


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.withColumn("similarity", F.col("n_matched") / F.col("n_windows"))
