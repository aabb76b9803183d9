"""Exact token ids of whole texts from a cache of white-space separated words.

The normaliser and pre-tokeniser of the word vocabulary never join characters across ASCII
white space, so the ids of a text are the ids of its words one after the other. A word is
encoded by the library once and then looked up. The cache holds at most two generations of
``generation`` words: words not seen for a whole generation are forgotten, so memory stays
bounded however many distinct words a corpus has.
"""

from __future__ import annotations

import os

import numpy as np

from touchline.llm.common import held, release

GENERATION = 300_000
#: Marks between words in one library call; a special token is never merged with its neighbours.
_MARK = "<|endoftext|>"
_BLOCK = 2000
_ENDS = frozenset(b".,!")


class WordCache:
    """``value(ids)`` of every word, where ``value`` is 'ids' (little-endian uint32 bytes) or 'count'."""

    def __init__(self, path: str, value: str, generation: int = GENERATION):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tok = Tokenizer.from_file(path)
        self.as_ids, self.generation = value == "ids", generation
        self.mark = self.tok.token_to_id(_MARK)
        self.young: dict = {}
        self.old: dict = {}

    def encode(self, word: str) -> list[int]:
        return self.tok.encode(word, add_special_tokens=False).ids

    def _known(self, word: bytes):
        v = self.young.get(word)
        return self.old.get(word) if v is None else v

    def _fill(self, words: list[bytes]) -> dict:
        """Values of new ``words``. A full stop or comma behind letters is a token run of its own, so
        such a word is put together from its stem and the mark."""
        parts, out, stems = {}, {}, {}
        for w in words:
            if w[-1] in _ENDS and len(w) > 1 and w[:-1].decode("utf-8", "replace").isalpha():
                parts[w] = w[:-1], w[-1:]
                for p in parts[w]:
                    if p not in out:
                        out[p] = self._known(p)
                        if out[p] is None:
                            stems[p] = p.decode("utf-8", "replace")
            else:
                stems[w] = w.decode("utf-8", "replace")
        plain = [w for w, s in stems.items() if "<|" not in s]
        blocks = [plain[i:i + _BLOCK] for i in range(0, len(plain), _BLOCK)]
        texts = [_MARK.join([stems[w] for w in b]) for b in blocks]
        for block, e in zip(blocks, self.tok.encode_batch_fast(texts, add_special_tokens=False)):
            ids = np.array(e.ids, dtype="<u4")
            cuts = np.flatnonzero(ids == self.mark)
            starts = np.concatenate([[0], cuts + 1])
            ends = np.concatenate([cuts, [len(ids)]])
            if self.as_ids:
                raw = ids.tobytes()
                out.update((w, raw[a:b]) for w, a, b in zip(block, (starts * 4).tolist(), (ends * 4).tolist()))
            else:
                out.update(zip(block, (ends - starts).tolist()))
        for w, s in stems.items():
            if "<|" in s:
                ids = self.encode(s)
                out[w] = np.array(ids, dtype="<u4").tobytes() if self.as_ids else len(ids)
        out.update((w, out[stem] + out[mark]) for w, (stem, mark) in parts.items())
        return out

    def learn(self, texts: list[list[bytes]]) -> dict:
        """Make sure every word of ``texts`` is known; returns the dictionary to look them up in."""
        distinct = set()
        for words in texts:
            distinct.update(words)
        young = self.young
        missing = distinct.difference(young)
        if len(young) + len(missing) > self.generation:
            self.old, self.young = young, {}
            young = self.young
            missing = distinct
        known, new = self.old, []
        for w in missing:
            v = known.get(w)
            if v is None:
                new.append(w)
            else:
                young[w] = v
        young.update(self._fill(new))
        return young

    def rest(self) -> None:
        """Forget the older generation: what an idle worker keeps between tasks."""
        self.old = {}
        release(kept=False)

    @staticmethod
    def words(text: bytes) -> list[bytes]:
        """Words of a text; A-Z is lowered first (the vocabulary does so too) unless a special
        token may be spelt out, which only counts in its exact spelling."""
        return text.split() if b"<|" in text else text.lower().split()


def cache(path: str, value: str, generation: int = GENERATION) -> WordCache:
    """One cache per Python worker, kept over the tasks of one operator."""
    return held((path, value, generation), lambda: WordCache(path, value, generation))
