"""Column helpers built from Spark expressions only."""

from funnelworks.functions.ratios import clip, fill, guarded_ratio, is_not, plain_ratio
from funnelworks.functions.stats import r2, safe_corr
from funnelworks.functions.text import as_text, normalised, strip
from funnelworks.functions.time import add_days, day, fractional_days, parse_timestamp, week_start, whole_days

__all__ = [
    "add_days", "as_text", "clip", "day", "fill", "fractional_days", "guarded_ratio", "is_not",
    "normalised", "parse_timestamp", "plain_ratio", "r2", "safe_corr", "strip", "week_start",
    "whole_days",
]
