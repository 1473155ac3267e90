"""Declared schemas of the five input tables."""

from __future__ import annotations

from pyspark.sql import types as T

_MONEY = T.DecimalType(18, 4)
_BALANCE = T.DecimalType(28, 4)
_TS = T.TimestampNTZType()


def _struct(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, dtype, True) for name, dtype in columns.items()])


SCHEMAS: dict[str, T.StructType] = {
    "app_events": _struct(
        user_id=T.LongType(), event_timestamp=_TS, event_name=T.StringType(), source=T.StringType(),
        campaign_id=T.StringType(), platform=T.StringType(), country=T.StringType(),
    ),
    "marketing_spend": _struct(
        date=_TS, channel=T.StringType(), campaign_id=T.StringType(), campaign_name=T.StringType(),
        spend=_MONEY, impressions=T.LongType(), clicks=T.LongType(),
    ),
    "user_profiles": _struct(
        user_id=T.LongType(), platform=T.StringType(), tracking_enabled=T.BooleanType(),
        age=T.IntegerType(), gender=T.StringType(), registration_date=_TS,
    ),
    "user_transactions": _struct(
        user_id=T.LongType(), transaction_timestamp=_TS, transaction_type=T.StringType(),
        amount_usd=_MONEY, running_balance_usd=_BALANCE,
    ),
    "skan_attribution_ios": _struct(
        postback_date=_TS, network=T.StringType(), conversion_value=T.IntegerType(), install_count=T.LongType(),
    ),
}
