from clusterlens.operators.aggregates import (
    count_distinct,
    distinct_drift,
    distinct_values,
    join_text,
    text_chunks,
    max_of,
    share_of_total,
    status_counts,
    sum_by,
    value_counts,
)
from clusterlens.operators.filters import (
    drop_names,
    drop_patterns,
    having,
    keep_found,
    like_any,
    metric_ilike,
    metric_in,
    threshold_band,
    value_matches,
    values_differ,
    with_missing,
)
from clusterlens.operators.joins import (
    keep_in,
    keep_not_in,
    paired_settings,
    pick_rule,
    value_drift,
    with_metadata,
)
from clusterlens.operators.picks import (
    first_n_names,
    first_per,
    last_wins,
    lead_text,
    sort_findings,
    top1,
    union_results,
)
from clusterlens.operators.running import running_total
from clusterlens.operators.series import (
    advance_series,
    counter_rates,
    days_to_limit,
    days_to_limit_after,
    line_moments,
)
from clusterlens.operators.sketches import (
    merged_sketches,
    quantile_sketch,
    sketched_quantile,
)
from clusterlens.operators.skew import (
    deviation_skew,
    mean_skew,
    share_monopoly,
    sum_limit,
)

__all__ = [
    "advance_series",
    "count_distinct",
    "counter_rates",
    "days_to_limit",
    "days_to_limit_after",
    "deviation_skew",
    "distinct_drift",
    "distinct_values",
    "drop_names",
    "drop_patterns",
    "first_n_names",
    "first_per",
    "having",
    "join_text",
    "quantile_sketch",
    "running_total",
    "text_chunks",
    "keep_found",
    "keep_in",
    "keep_not_in",
    "last_wins",
    "lead_text",
    "like_any",
    "line_moments",
    "max_of",
    "merged_sketches",
    "mean_skew",
    "metric_ilike",
    "metric_in",
    "paired_settings",
    "pick_rule",
    "share_monopoly",
    "share_of_total",
    "sketched_quantile",
    "sort_findings",
    "status_counts",
    "sum_by",
    "sum_limit",
    "threshold_band",
    "top1",
    "union_results",
    "value_counts",
    "value_drift",
    "value_matches",
    "values_differ",
    "with_metadata",
    "with_missing",
]
