from touchline.operators.derive import with_derived
from touchline.operators.discovery import discover_entities
from touchline.operators.rank import (STATS, global_row_number, histogram_rank, positive, rank_by_metric,
                                      top_by_rank, valid_stat)
from touchline.operators.distinct import distinct_estimates, distinct_sketches
from touchline.operators.resolve import resolve_alias, substring_join, widening_candidates
from touchline.operators.scope import preferred_first, with_fallback
from touchline.operators.snapshot import best_per_key, latest_per_key, metric_of_tag
from touchline.operators.standings import side_pairs, two_sided_standings
from touchline.operators.topk import first_per_group

__all__ = [
    "distinct_sketches", "distinct_estimates", "discover_entities", "STATS", "positive", "global_row_number", "histogram_rank", "rank_by_metric", "top_by_rank",
    "valid_stat", "resolve_alias", "substring_join", "widening_candidates", "preferred_first",
    "with_fallback", "best_per_key", "latest_per_key", "metric_of_tag", "side_pairs",
    "two_sided_standings", "first_per_group", "with_derived",
]
