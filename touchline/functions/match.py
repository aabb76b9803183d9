"""Match-level scalar expressions: completion, live status, winner, dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Status codes (lower-cased) that mark a finished match.
COMPLETED_STATUSES = ("ft", "aet", "pen", "finished")
# Status codes (upper-cased) of a match in play.
LIVE_STATUSES = ("1H", "2H", "HT", "ET", "BT", "P", "LIVE")


def _c(col):
    return F.col(col) if isinstance(col, str) else col


def is_completed(status: Column | str) -> Column:
    """``lower(status) in (...)``; a null status gives null, as in SQL."""
    return F.lower(_c(status)).isin(*COMPLETED_STATUSES)


def is_live(status: Column | str) -> Column:
    return F.upper(_c(status)).isin(*LIVE_STATUSES)


def winner(home_score, away_score, home_name, away_name) -> Column:
    """Name of the side with more goals, else 'Draw' (shoot-out wins are draws by score)."""
    h, a = _c(home_score), _c(away_score)
    return (F.when(h > a, _c(home_name))
            .when(a > h, _c(away_name))
            .otherwise(F.lit("Draw")))


def default_status(status, completed) -> Column:
    """Blank status becomes FT for completed matches, NS otherwise."""
    return F.coalesce(F.nullif(_c(status), F.lit("")),
                      F.when(_c(completed), F.lit("FT")).otherwise(F.lit("NS")))


def parse_match_date(text: Column | str) -> Column:
    """``DATE(TIMESTAMP(text))`` in the session time zone; unparseable text gives null."""
    return F.to_date(F.try_to_timestamp(_c(text).cast("string")))
