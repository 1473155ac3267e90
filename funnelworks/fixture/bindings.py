"""The five input tables expressed over the shared test tables (see FIXTURES.md part 3)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from funnelworks.sources.readers import Tables

# Fixed values of the binding. A channel's number is k % 8 for events, 2 + l_suppkey % 6 for spend.
CHANNELS = {
    0: "Organic", 1: "Organic", 2: "Google Brand Search", 3: "Google Non-Brand Search",
    4: "Google App Campaigns", 5: "Meta", 6: "TikTok", 7: "Referral",
}
EVENT_NAMES = {"view": "impression", "click": "click", "signup": "install", "purchase": "registration", "error": "error"}
COUNTRIES = {0: "NL", 1: "DE", 2: "FR", 3: "BE"}
CAMPAIGN_NAMES = {0: "Brand search NL", 1: "Prospecting video reach", 2: "Retargeting app install"}
NETWORKS = {0: "Google", 1: "Meta", 2: "TikTok"}
SOURCES = sorted(set(CHANNELS.values()))


def _label(value: str, labels: dict) -> str:
    """SQL text that maps a value to its label."""
    return f"CASE {value} " + " ".join(f"WHEN {key!r} THEN '{label}'" for key, label in labels.items()) + " END"


def _campaign(channel_no: str, variant: str) -> str:
    return f"CASE WHEN {channel_no} BETWEEN 2 AND 6 THEN concat('cmp_', {channel_no}, '_', {variant}) END"


def _platform(user_id: str) -> str:
    return f"CASE WHEN {user_id} % 5 < 2 THEN 'ios' ELSE 'android' END"


def _january(key: str, days: int) -> str:
    return f"date_add(DATE '2024-01-01', CAST({key} % {days} AS INT))"


def app_events(events: DataFrame) -> DataFrame:
    # props is {"k": N}: what is left without the other characters is N.
    numbered = events.selectExpr("*", """CAST(translate(props, '{"k: }', '') AS INT) AS k""")
    return numbered.selectExpr(
        "event_id", "user_id", "ts AS event_timestamp",
        f"{_label('event_type', EVENT_NAMES)} AS event_name",
        f"{_label('k % 8', CHANNELS)} AS source",
        f"{_campaign('k % 8', 'k % 3')} AS campaign_id",
        f"{_platform('user_id')} AS platform",
        f"{_label('user_id % 4', COUNTRIES)} AS country",
    )


def marketing_spend(lineitem: DataFrame) -> DataFrame:
    channel_no, variant = "(2 + l_suppkey % 6)", "l_partkey % 3"
    return lineitem.selectExpr(
        f"{_january('l_orderkey', 30)} AS date",
        f"{_label(channel_no, CHANNELS)} AS channel",
        f"{_campaign(channel_no, variant)} AS campaign_id",
        f"{_label(variant, CAMPAIGN_NAMES)} AS campaign_name",
        "CAST(l_extendedprice / 100 AS DECIMAL(18,4)) AS spend",
        "CAST(l_quantity * 100 AS BIGINT) AS impressions",
        "CAST(l_quantity AS BIGINT) AS clicks",
    )


def user_profiles(customer: DataFrame) -> DataFrame:
    # Ten customers make one user; its profile is put together from all of them.
    user = "CAST(floor(c_custkey / 10.0D) AS BIGINT)"
    ten = customer.selectExpr(f"{user} AS user_id", "c_custkey", "c_nationkey", "c_mktsegment").groupBy("user_id").agg(
        F.min("c_custkey").alias("c_custkey"), F.min("c_nationkey").alias("c_nationkey"), F.max_by("c_mktsegment", "c_custkey").alias("c_mktsegment"))
    user = "user_id"
    return ten.selectExpr(
        "user_id",
        "CAST(18 + c_custkey % 50 AS INT) AS age",
        "CASE WHEN c_nationkey % 2 = 0 THEN 'female' ELSE 'male' END AS gender",
        f"{_platform(user)} AS platform",
        "CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN true WHEN c_mktsegment <> 'FURNITURE' THEN false END AS tracking_enabled",
    )


def user_transactions(orders: DataFrame) -> DataFrame:
    """Orders as deposits and withdrawals, with the running balance per user.

    The running sum is taken within a user's day and the day's opening balance is joined on, so no
    task has to sort all rows of one user. As a left join on unique keys it is dropped from plans
    that do not read the balance.
    """
    tx = orders.selectExpr(
        "o_orderkey AS tx_id",
        "CAST(floor(o_custkey / 10.0D) AS BIGINT) AS user_id",
        f"{_january('o_orderkey', 360)} AS _day",
        "CASE WHEN o_orderstatus = 'F' THEN 'withdrawal' ELSE 'deposit' END AS transaction_type",
        "CAST(o_totalprice / 100 AS DECIMAL(18,4)) AS amount_usd",
    ).selectExpr("*", "CASE WHEN transaction_type = 'deposit' THEN amount_usd ELSE -amount_usd END AS _signed")
    earlier = Window.partitionBy("user_id").orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    opening = tx.groupBy("user_id", "_day").agg(F.sum("_signed").alias("_net")).select(
        "user_id", "_day", F.coalesce(F.sum("_net").over(earlier), F.lit(0)).alias("_opening")
    )
    in_day = Window.partitionBy("user_id", "_day").orderBy("tx_id").rowsBetween(Window.unboundedPreceding, 0)
    running = tx.withColumn("_running", F.sum("_signed").over(in_day)).join(opening, ["user_id", "_day"], "left")
    return running.selectExpr(
        "tx_id", "user_id", "CAST(_day AS TIMESTAMP_NTZ) AS transaction_timestamp",
        "transaction_type", "amount_usd", "CAST(_opening + _running AS DECIMAL(28,4)) AS running_balance_usd",
    )


def skan_attribution_ios(lineitem: DataFrame) -> DataFrame:
    # A postback of a line that was not returned carries no conversion value, as below the privacy threshold.
    return lineitem.selectExpr(
        f"{_january('l_orderkey', 30)} AS postback_date",
        f"{_label('l_suppkey % 3', NETWORKS)} AS network",
        "CASE WHEN l_returnflag = 'R' THEN CAST(l_quantity AS INT) END AS conversion_value",
        "CAST(l_linenumber AS BIGINT) AS install_count",
    )


# Columns read from the shared tables; a declared schema saves the job that infers one.
_READ = {
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, props string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
                "l_extendedprice double, l_returnflag string",
    "customer": "c_custkey bigint, c_nationkey int, c_mktsegment string",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double",
}


def bound_tables(spark: SparkSession, sf_dir: str) -> Tables:
    def table(name: str) -> DataFrame:
        return spark.read.schema(_READ[name]).parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")

    lineitem = table("lineitem")
    return Tables(
        app_events=app_events(table("events")),
        marketing_spend=marketing_spend(lineitem),
        user_profiles=user_profiles(table("customer")),
        user_transactions=user_transactions(table("orders")),
        skan_attribution_ios=skan_attribution_ios(lineitem),
    )
