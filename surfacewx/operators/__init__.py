"""DataFrame -> DataFrame operators of the outlier job."""

from surfacewx.operators.joins import checked_broadcast, enrich, salted_join, semi_join
from surfacewx.operators.outliers import find_outliers, threshold, threshold_table
from surfacewx.operators.radius import selected_ids, with_distance, within_radius
from surfacewx.operators.report import format_report, sort_report
from surfacewx.operators.sort import with_position
from surfacewx.operators.stats import merge_partials, partial_stats, pooled_stats, pooled_stats_many
from surfacewx.operators.union import union_observations

__all__ = [
    "checked_broadcast",
    "enrich",
    "salted_join",
    "semi_join",
    "find_outliers",
    "threshold",
    "threshold_table",
    "selected_ids",
    "with_distance",
    "within_radius",
    "format_report",
    "sort_report",
    "with_position",
    "merge_partials",
    "partial_stats",
    "pooled_stats",
    "pooled_stats_many",
    "union_observations",
]
