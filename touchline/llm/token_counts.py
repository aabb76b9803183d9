"""Operator 9, token counts: exact token counts at every prefix of a text.

``T[j] = T[j-1] + tokens(word j)`` over white-space separated words gives the exact count at every
word end; a cut inside a word adds the word's own prefix count, from the prefix dynamic programme
:class:`WordPrefixes` (at each prefix the one token that can end its encoding). So the total, the
longest prefix within a budget and the count at any prefix (:meth:`PrefixCounts.count_at`) come from stored
prefixes; a text is never encoded again. Time is linear in the text, also without any white space; memory is one
text's prefix table plus the bounded word cache.

Defined results: null text counts as empty (0 tokens, 0 bytes); repeated rows give repeated rows; an
empty table gives no row; only ``doc_id`` and ``text`` are read, so other columns never clash.
"""

from __future__ import annotations

import functools
import itertools
import json
import re
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.llm.common import chunks, doc_rows, importable, table
from touchline.llm.wordcache import WordCache, cache

SCHEMA = "doc_id bigint, n_bytes bigint, n_tokens bigint, cut_bytes bigint"
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


class WordPrefixes:
    """Token count of every prefix of one pre-token of a byte-pair vocabulary with word ends.

    Encodings are prefix-closed: the encoding of a string is some token ``t`` put behind the
    encoding of the rest, whose last token must stay apart from ``t``. Walking the prefixes in
    order, exactly one token fits at each; its predecessor's count plus one is the prefix's.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        self.vocab, self.end = model["vocab"], model["end_of_word_suffix"]
        self.rank = {tuple(m): i for i, m in enumerate(model["merges"])}
        # the longest token that ends with a byte character, inside a word and at its end
        self.reach, self.reach_end = {}, {}
        for t in self.vocab:
            closes = t.endswith(self.end) and len(t) > len(self.end)
            body, reach = (t[:-len(self.end)], self.reach_end) if closes else (t, self.reach)
            reach[body[-1]] = max(reach.get(body[-1], 1), len(body))
        self.apart = functools.lru_cache(1 << 16)(self._apart)

    def _symbols(self, token: str) -> list[str]:
        if token.endswith(self.end) and len(token) > len(self.end):
            body = token[:-len(self.end)]
            return [*body[:-1], body[-1] + self.end]
        return list(token)

    def _merge(self, symbols: list[str]) -> list[str]:
        while len(symbols) > 1:
            r, i = min((self.rank.get(p, 1 << 30), i) for i, p in enumerate(zip(symbols, symbols[1:])))
            if r == 1 << 30:
                break
            symbols = [*symbols[:i], symbols[i] + symbols[i + 1], *symbols[i + 2:]]
        return symbols

    def _apart(self, left: str, right: str) -> bool:
        return self._merge(self._symbols(left) + self._symbols(right)) == [left, right]

    def push(self, state: tuple[list, list], word: str, k: int) -> int:
        """Append what is known of ``word[:k]`` to ``state`` (last token and count of shorter prefixes, as
        beginnings); returns the tokens of ``word[:k]`` as a whole pre-token."""
        last, n = state
        whole = 0
        for suffix, reach in (("", self.reach), (self.end, self.reach_end)):
            for j in range(max(0, k - reach.get(word[k - 1], 1)), k):
                t = word[j:k] + suffix
                if t in self.vocab and (self._merge(self._symbols(t)) == [t] if j == 0 else self.apart(last[j], t)):
                    if suffix:
                        whole = n[j] + 1
                    else:
                        last.append(t)
                        n.append(n[j] + 1)
                    break
        return whole

    def counts(self, word: str) -> list[int]:
        """``counts[k]``: tokens of the first ``k`` byte characters taken as a whole pre-token."""
        state = [""], [0]
        return [0, *(self.push(state, word, k) for k in range(1, len(word) + 1))]

    def counts_behind(self, state: tuple[list, list], word: str, at: int) -> int:
        """Tokens of ``word`` as a whole pre-token where ``state`` knows the prefixes of ``word[:at]`` (unchanged)."""
        last, n = state
        whole = 0
        for k in range(at + 1, len(word) + 1):
            whole = self.push(state, word, k)
        del last[at + 1:], n[at + 1:]
        return whole


_DP: dict = {}
_SPECIAL = re.compile(r"<\|(?:startoftext|endoftext)\|>")
_CONTRACTIONS = frozenset(["'re", "'ve", "'ll", "'s", "'t", "'m", "'d"])


def _joins(c: str) -> bool:
    """Whether normalisation may change ``c`` together with what stands before it: marks, vowels and finals of Hangul."""
    return unicodedata.category(c)[0] == "M" or unicodedata.combining(c) > 0 or "\u1160" <= c <= "\u11ff"


class Prefixes:
    """Tokens of every character prefix of white-space free words, from the library's pre-tokens.

    Pre-tokens are encoded apart, so a prefix has the tokens of the pre-tokens before the cut and those of the
    cut one, which the prefix programme gives: time is linear in the word, in every script. Only a cut
    contraction (three characters at most) is split again, and where normalisation joins characters, a cut
    between them goes on from the state of the programme before the first of them."""

    def __init__(self, words: WordCache, path: str):
        self.words, self.tok, self.dp = words, words.tok, WordPrefixes(path)
        self.normal = functools.lru_cache(1 << 16)(self.tok.normalizer.normalize_str)

    def of(self, word: str) -> list[int]:
        out, done, at = [0], 0, 0
        for m in _SPECIAL.finditer(word):  # the special token counts once it is complete; cut, it is plain text
            own = self.plain(word[at:m.end() - 1])
            out += [done + c for c in own[1:]]
            done += own[m.start() - at] + 1
            out.append(done)
            at = m.end()
        return out + [done + c for c in self.plain(word[at:])[1:]]

    def plain(self, text: str) -> list[int]:
        """The same of a text without special tokens; the vocabulary never joins over any kind of white space."""
        out, done = [0], 0
        for blank, run in itertools.groupby(text, lambda c: self.normal(c) == " "):
            own = [0] * (sum(1 for _ in run) + 1) if blank else self.run("".join(run))
            out += [done + c for c in own[1:]]
            done = out[-1]
        return out

    def run(self, run: str) -> list[int]:
        normal = self.tok.normalizer.normalize_str(run)
        # where the prefix of ``run`` is normalised to a prefix of ``normal``, its length there
        ends, start = [0] * (len(run) + 1), 0
        stable = "".join(map(self.normal, run)) == normal
        groups = [1] * len(run) if stable else self._groups(run)
        inner = {}
        for size in groups:
            for k in range(1, size):
                inner[start + k] = start
            first, start = start, start + size
            ends[start] = ends[first] + len(self.normal(run[first:start]))
        if ends[-1] != len(normal):  # the library joins what the groups keep apart: ask for each prefix
            return [len(self.words.encode(run[:k])) for k in range(len(run) + 1)]
        whole = [0] * (len(normal) + 1)  # tokens of each prefix of ``normal``
        waiting: dict[int, list[int]] = {}
        for k, first in inner.items():
            waiting.setdefault(ends[first], []).append(k)
        cut = {}
        done = 0
        for piece, (a, b) in self.tok.pre_tokenizer.pre_tokenize_str(normal):
            state, byte = ([""], [0]), 0
            split = normal[a:b] in _CONTRACTIONS
            for p in range(a, b):
                for k in waiting.pop(p, ()):
                    tail = self.tok.normalizer.normalize_str(run[inner[k]:k])
                    cut[k] = done + self._cut(state, piece[:byte], normal[a:p], tail)
                for _ in normal[p].encode():
                    byte += 1
                    n = self.dp.push(state, piece, byte)
                whole[p + 1] = done + (len(self.words.encode(normal[a:p + 1])) if split else n)
            done = whole[b]
        return [cut[k] if k in inner else whole[ends[k]] for k in range(len(run) + 1)]

    @staticmethod
    def _groups(run: str) -> list[int]:
        starts = [i for i, c in enumerate(run) if i == 0 or not _joins(c)] + [len(run)]
        return [b - a for a, b in zip(starts, starts[1:])]

    def _cut(self, state, known: str, before: str, tail: str) -> int:
        """Tokens of the pre-token begun with ``before`` (byte characters ``known``) and of ``tail`` behind it."""
        if "'" in before[-3:] or not before:
            return len(self.words.encode(before + tail))
        pieces = self.tok.pre_tokenizer.pre_tokenize_str(before[-1] + tail)
        joined, (_, b) = pieces[0]
        rest = sum(self.dp.counts(p)[-1] for p, _ in pieces[1:])
        more = joined[len(before[-1].encode()):]
        at = len(known)
        if more:
            return self.dp.counts_behind(state, known + more, at) + rest
        return self.dp.counts(known)[-1] + rest


def prefix_tokens(words: WordCache, path: str, word: str) -> list[int]:
    """Tokens of every character prefix of one white-space free word."""
    if path not in _DP:
        _DP[path] = Prefixes(words, path)
    return _DP[path].of(word)


class PrefixCounts:
    """Token counts of one text: ``total``, ``at`` a word end, and ``cut`` to a token budget."""

    def __init__(self, text: bytes, words: list[bytes], known: dict, cache_: WordCache, path: str):
        self.text, self.words, self.cache, self.path = text, words, cache_, path
        self.table = np.cumsum(np.fromiter(map(known.__getitem__, words), np.int64, len(words)))

    @property
    def total(self) -> int:
        return int(self.table[-1]) if len(self.table) else 0

    def cut(self, budget: int) -> int:
        """Bytes of the longest prefix of at most ``budget`` tokens that ends at a character."""
        if self.total <= budget:
            return len(self.text)
        j = int(np.searchsorted(self.table, budget, "right"))
        done = int(self.table[j - 1]) if j else 0
        start, word = int(self.starts[j]), self._word(j)
        counts = prefix_tokens(self.cache, self.path, word)
        fit = max(k for k, c in enumerate(counts) if done + c <= budget)
        return start + len(word[:fit].encode())

    def count_at(self, n_bytes: int) -> int:
        """Tokens of the first ``n_bytes`` bytes (without a character that they cut)."""
        j = int(np.searchsorted(self.starts, n_bytes, "left")) - 1  # the last word begun
        if j < 0:
            return 0
        done = int(self.table[j - 1]) if j else 0
        word, inside = self._word(j), n_bytes - int(self.starts[j])
        if inside >= len(word.encode()):
            return int(self.table[j])
        return done + prefix_tokens(self.cache, self.path, word)[len(word.encode()[:inside].decode("utf-8", "ignore"))]

    @functools.cached_property
    def starts(self) -> np.ndarray:
        """First byte of each word."""
        space = _SPACE[np.frombuffer(self.text, np.uint8)]
        return np.flatnonzero(~space & np.concatenate([[True], space[:-1]]))

    def _word(self, j: int) -> str:
        end = int(self.starts[j + 1]) if j + 1 < len(self.starts) else len(self.text)
        return self.text[int(self.starts[j]):end].split()[0].decode("utf-8", "replace")


def prefix_tables(rows, path: str):
    """(doc_id, PrefixCounts) of (doc_id, text bytes) rows."""
    words = cache(path, "count")
    for part in chunks(rows):
        split = [WordCache.words(t) for _, t in part]
        known = words.learn(split)
        for (doc_id, text), own in zip(part, split):
            yield doc_id, PrefixCounts(text, own, known, words, path)


def token_counts(docs: DataFrame, path: str, budget: int = 2048) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, cut_bytes``: exact counts and the longest prefix within ``budget``."""
    names = ["doc_id", "n_bytes", "n_tokens", "cut_bytes"]

    def run(batches):
        for b in batches:
            got = [(d, len(p.text), p.total, p.cut(budget)) for d, p in prefix_tables(doc_rows([b]), path)]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*got)] if got else
                                             [pa.array([], pa.int64())] * 4, names=names)
        cache(path, "count").rest()

    return importable(docs).select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, SCHEMA)


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    out = token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), 2048)
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 2048).alias("over_limit"), "cut_bytes")
