"""Phrase patterns built from word lists, in the syntax that Spark and other engines share.

A word ends where letters and digits of any script end. Inside one sentence anything may stand
between two key words, of any length.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Before a word, behind a word, and between two words of one sentence.
BEFORE = r"(?:^|[^\p{L}\p{N}])"
BEHIND = r"(?:[^\p{L}\p{N}]|$)"
_BETWEEN = r"[^\p{L}\p{N}?\n]"
GAP = rf"{_BETWEEN}(?:[^?\n]*?{_BETWEEN})??"


def any_of(words: Iterable[str], capture: bool = False) -> str:
    """Alternation of words or phrases, the longest first; any white space between a phrase's words."""
    alternatives = "|".join(w.replace(" ", r"\s+") for w in sorted(words, key=lambda w: (-len(w), w)))
    return f"({alternatives})" if capture else f"(?:{alternatives})"


def phrase(*parts: str) -> str:
    """Case-insensitive pattern of parts that stand as whole words in one sentence.

    With several parts each sentence is tried once, from the first whole word of the first part: what follows
    a later one follows that one too. So a sentence that holds the first part many times and never the next
    is not read again for each, and the time is linear in the text.
    """
    first, *rest = parts
    if not rest:
        return "(?i)" + BEFORE + first + BEHIND
    return rf"(?i)(?:^|[?\n])(?>(?:[^?\n]*?{_BETWEEN})??{first}(?={_BETWEEN}))" + GAP + GAP.join(rest) + BEHIND


def may_hold(low: Column, *parts: Iterable[str]) -> Column:
    """Can a :func:`phrase` of these word lists match the text with the lower case ``low``? Some word of each
    list must be in it, in any place; a substring test costs far less than the pattern."""
    def some(words: Iterable[str]) -> Column:
        pieces = {tuple(w.split()) for w in words}
        # a word that holds another one of the list needs no test of its own
        pieces = sorted(p for p in pieces if not any(q != p and len(q) == 1 and any(q[0] in w for w in p) for q in pieces))
        return reduce(or_, [reduce(and_, [F.contains(low, F.lit(w)) for w in p]) for p in pieces])
    return reduce(and_, [some(words) for words in parts])


#: What may hang on the end of a name: a possessive, then white space and punctuation.
NAME_EDGE = r"(?:['’]s)?[\s?.!,;:'’]*$"
