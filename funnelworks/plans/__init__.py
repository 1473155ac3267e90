"""The analyses: channel performance, attribution gaps, time series, roles, lifetime value."""
