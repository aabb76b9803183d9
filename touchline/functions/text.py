"""Accent-insensitive text matching without a UDF.

``fold`` turns a string Column into lower case with diacritics removed; ``fold_text`` is the same
rule for a parameter string, so a text always contains itself. Spark has no ``normalize()``: every
character whose compatibility decomposition leaves one letter (accented, full-width, superscript,
voiced kana and so on, over all planes) goes through a ``translate`` table built at import from
:mod:`unicodedata`; the few Latin, Greek and Cyrillic ones that leave several letters become a short
``replace`` chain; marks left in text that arrives already decomposed are stripped by regex.
Characters that decompose otherwise (Hangul syllables, squared words) stay as they are on both sides.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# Code point blocks whose letters may expand to several.
_EXPANDING_BLOCKS = [(0x00C0, 0x024F), (0x0370, 0x03FF), (0x0400, 0x04FF), (0x1E00, 0x1FFF),
                     (0xFB00, 0xFB06)]
_BLANK = " \t\n\r"


def fold_text(s: str | None) -> str:
    """The column's fold for a parameter string."""
    if not s:
        return ""
    src, dst, multi, _ = _fold_tables()
    out = s.translate(str.maketrans(src, dst)).lower()
    for ch, rep in multi:
        out = out.replace(ch, rep)
    return "".join(ch for ch in out if not unicodedata.category(ch).startswith("M"))


def _strip_marks(s: str) -> str:
    """NFKD, then drop every mark (general category M*, what ``\\p{M}`` matches on the JVM)."""
    d = unicodedata.normalize("NFKD", s)
    return "".join(ch for ch in d if not unicodedata.category(ch).startswith("M"))


@lru_cache(maxsize=1)
def _fold_tables() -> tuple[str, str, tuple[tuple[str, str], ...], str]:
    """(translate source, translate target, multi-letter expansions of lower-case letters,
    regex class of what needs more than ``translate``: letters that expand, and marks).

    Single-letter folds go through ``translate`` before lower-casing (so e.g. a dotted capital
    I folds to a plain i). Letters that expand to several letters are handled after
    lower-casing, where only their lower-case forms remain.
    """
    # both lower-case sigmas fold alike, so lower-casing never depends on a word's end
    src, dst, multi, expanding = ["Σ", "ς"], ["σ", "σ"], {}, set()
    several = {cp for lo, hi in _EXPANDING_BLOCKS for cp in range(lo, hi + 1)}
    for cp in range(0xA0, 0x30000):
        ch = chr(cp)
        if not unicodedata.decomposition(ch) or ch in "Σς":
            continue
        folded = _strip_marks(ch)
        if folded == ch or folded == "" or folded[0] in _BLANK:
            continue  # unchanged, a bare mark (stripped by the regex), or a space of some width
        if len(folded) == 1:
            src.append(ch)
            dst.append(folded.replace("Σ", "σ").replace("ς", "σ"))
        elif cp in several:
            low = ch.lower()
            key = low if len(low) == 1 else ch
            multi[key] = _strip_marks(low).lower()
            expanding.update((ch, key))
    return "".join(src), "".join(dst), tuple(sorted(multi.items())), "[" + _ranges(expanding) + r"\p{M}]"


def _ranges(chars) -> str:
    """Regex class body of code point ranges (a few ranges scan far faster than many
    single letters)."""
    cps, out, i = sorted(ord(c) for c in chars), [], 0
    while i < len(cps):
        j = i
        while j + 1 < len(cps) and cps[j + 1] == cps[j] + 1:
            j += 1
        out.append(f"\\x{{{cps[i]:04X}}}" + (f"-\\x{{{cps[j]:04X}}}" if j > i else ""))
        i = j + 1
    return "".join(out)


def fold(col: Column | str) -> Column:
    """Column fold: decompose accented letters, lower-case, strip combining marks.

    Pure ASCII text (a character count equal to the byte count) only needs ``lower``.
    Other text takes one ``translate`` pass and ``lower``. Letters that expand to several
    (a ``replace`` per letter) and combining marks (a regex) are rare, so that tail runs
    only for text holding one of them: long text is not rescanned once per rare letter.
    """
    c = F.col(col) if isinstance(col, str) else col
    src, dst, multi, rare = _fold_tables()
    slow = F.lower(F.translate(c, src, dst))
    for ch, rep in multi:
        slow = F.replace(slow, F.lit(ch), F.lit(rep))
    slow = F.regexp_replace(slow, r"\p{M}", "")
    ascii_only = F.length(c) == F.octet_length(c)
    return (F.when(ascii_only, F.lower(c)).when(c.rlike(rare), slow)
            .otherwise(F.lower(F.translate(c, src, dst))))


def folded_contains(col: Column | str, term: str) -> Column:
    """Accent- and case-insensitive literal substring test (no wildcards, no SQL text)."""
    return F.contains(fold(col), F.lit(fold_text(term)))
