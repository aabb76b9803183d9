"""Position codes: feed abbreviations and natural-language words to GK / DEF / MID / FWD."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# Feed position token (first comma-separated token, upper-cased, trimmed)
# to position code. Anything else is UNKNOWN.
FEED_POSITION_CODES: dict[str, str] = {
    "GK": "GK", "GOALKEEPER": "GK",
    "CB": "DEF", "RB": "DEF", "LB": "DEF", "RWB": "DEF", "LWB": "DEF", "DEF": "DEF",
    "DEFENDER": "DEF", "CENTRE-BACK": "DEF", "CENTER-BACK": "DEF",
    "CM": "MID", "CDM": "MID", "CAM": "MID", "LM": "MID", "RM": "MID", "DM": "MID",
    "AM": "MID", "MID": "MID", "MIDFIELDER": "MID",
    "ST": "FWD", "LW": "FWD", "RW": "FWD", "CF": "FWD", "SS": "FWD", "FW": "FWD",
    "FWD": "FWD", "FORWARD": "FWD", "ATTACKER": "FWD", "STRIKER": "FWD",
}

# Natural-language position word (trimmed, lower-cased) to position code.
# Unknown words pass through upper-cased.
POSITION_WORDS: dict[str, str] = {
    "goalkeeper": "GK", "goalkeepers": "GK", "gk": "GK",
    "defender": "DEF", "defenders": "DEF", "def": "DEF", "back": "DEF",
    "midfielder": "MID", "midfielders": "MID", "mid": "MID", "midfield": "MID",
    "forward": "FWD", "forwards": "FWD", "fwd": "FWD",
    "attacker": "FWD", "attackers": "FWD", "striker": "FWD", "strikers": "FWD",
    "winger": "FWD",
}

# Display order of position codes.
POSITION_ORDER: dict[str, int] = {"GK": 1, "DEF": 2, "MID": 3, "FWD": 4, "UNKNOWN": 5}
POSITION_CODES = ("GK", "DEF", "MID", "FWD")


def _map_lit(d: dict) -> Column:
    return F.create_map(*[F.lit(x) for x in chain.from_iterable(d.items())])


def position_token(col: Column | str) -> Column:
    """First comma token of the upper-cased, null-safe position text, trimmed."""
    c = F.col(col) if isinstance(col, str) else col
    return F.trim(F.get(F.split(F.upper(F.coalesce(c, F.lit(""))), ","), 0))


def position_code(col: Column | str) -> Column:
    """Feed position text to GK/DEF/MID/FWD/UNKNOWN."""
    return F.coalesce(F.try_element_at(_map_lit(FEED_POSITION_CODES), position_token(col)),
                      F.lit("UNKNOWN"))


def position_from_word(col: Column | str) -> Column:
    """Natural-language position word to its code; unknown words upper-cased (not trimmed)."""
    c = F.col(col) if isinstance(col, str) else col
    return F.coalesce(F.try_element_at(_map_lit(POSITION_WORDS), F.lower(F.trim(c))), F.upper(c))


def position_from_word_text(word: str) -> str:
    """Driver-side version for a single parameter value."""
    return POSITION_WORDS.get(word.strip().lower(), word.upper())


def position_rank(col: Column | str) -> Column:
    """Sort key of a position code in roster order, unknown codes last."""
    c = F.col(col) if isinstance(col, str) else col
    return F.coalesce(F.try_element_at(_map_lit(POSITION_ORDER), c), F.lit(5))
