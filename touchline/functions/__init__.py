from touchline.functions.match import (COMPLETED_STATUSES, LIVE_STATUSES, default_status,
                                       is_completed, is_live, parse_match_date, winner)
from touchline.functions.positions import (FEED_POSITION_CODES, POSITION_ORDER, POSITION_WORDS,
                                           position_code, position_from_word,
                                           position_from_word_text, position_rank)
from touchline.functions.shaping import label_value
from touchline.functions.text import fold, fold_text, folded_contains

__all__ = [
    "COMPLETED_STATUSES", "LIVE_STATUSES", "default_status", "is_completed", "is_live",
    "parse_match_date", "winner", "FEED_POSITION_CODES", "POSITION_ORDER", "POSITION_WORDS",
    "position_code", "position_from_word", "position_from_word_text", "position_rank",
    "label_value", "fold", "fold_text", "folded_contains",
]
