"""Reusable table operators: first event, interval revenue, shifts, rolling scores, ranks."""

from funnelworks.operators.events import daily_users, first_event, hot_keys, null_safe_join, salted_join, user_days
from funnelworks.operators.intervals import BalanceIndex, account_instants, balance_index, fee_revenue_interval, heavy_users
from funnelworks.operators.order_stats import exact_quantiles, modes, with_row_index
from funnelworks.operators.series import lag_correlation, rolling_zscore, shift_fit, top_extremes
from funnelworks.operators.shares import mix_share, organic_paid_ratio, share_of_total
from funnelworks.operators.sketches import daily_state, hll_error, kll_error, merged

__all__ = [
    "BalanceIndex", "account_instants", "balance_index", "daily_state", "daily_users", "exact_quantiles",
    "fee_revenue_interval", "first_event", "heavy_users", "hll_error", "hot_keys", "kll_error", "lag_correlation", "merged",
    "mix_share", "modes", "null_safe_join",
    "organic_paid_ratio", "rolling_zscore", "salted_join", "share_of_total", "shift_fit", "top_extremes", "user_days",
    "with_row_index",
]
