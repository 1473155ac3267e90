"""Small hand-made frames with the columns of the input tables."""

from __future__ import annotations

from datetime import datetime
from decimal import Decimal

EVENTS = "event_id long, user_id long, event_timestamp timestamp_ntz, event_name string, source string, campaign_id string, platform string, country string"
SPEND = "date date, channel string, campaign_id string, campaign_name string, spend decimal(18,4), impressions long, clicks long"
TX = "tx_id long, user_id long, transaction_timestamp timestamp_ntz, transaction_type string, amount_usd decimal(18,4), running_balance_usd decimal(28,4)"
PROFILES = "user_id long, platform string, tracking_enabled boolean, age int, gender string"


def ts(text: str | None) -> datetime | None:
    return None if text is None else datetime.fromisoformat(text)


def events(spark, rows):
    """rows: (user_id, timestamp, event_name, source, campaign_id[, platform[, country]])"""
    full = [
        (i, r[0], ts(r[1]), r[2], r[3], r[4], r[5] if len(r) > 5 else "ios", r[6] if len(r) > 6 else "NL")
        for i, r in enumerate(rows)
    ]
    return spark.createDataFrame(full, EVENTS)


def spend(spark, rows):
    """rows: (date, channel, campaign_id, campaign_name, spend, impressions, clicks)"""
    full = [(ts(r[0]).date(), *r[1:4], None if r[4] is None else Decimal(str(r[4])), *r[5:]) for r in rows]
    return spark.createDataFrame(full, SPEND)


def tx(spark, rows):
    """rows: (tx_id, user_id, timestamp, type, amount, balance)"""
    full = [
        (r[0], r[1], ts(r[2]), r[3], Decimal(str(r[4])), None if r[5] is None else Decimal(str(r[5]))) for r in rows
    ]
    return spark.createDataFrame(full, TX)


def profiles(spark, rows):
    return spark.createDataFrame(rows, PROFILES)


def rows(df, *columns):
    """Collected rows as plain tuples, sorted with missing values first."""
    out = [tuple(r) for r in (df.select(*columns) if columns else df).collect()]
    return sorted(out, key=lambda r: [(v is not None, v) for v in r])
