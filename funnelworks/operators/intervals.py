"""Fee revenue on running balances over per-user time windows.

A balance holds from its transaction to the next one, and earns ``balance * days * fee / 365``.
Only transactions inside the window count and the last one holds to the window's end; no balance
is carried in from before the window.

All windows of all users are answered from one index, built in one pass over the transactions:

1. the windows' edges are stacked with the transactions, and the stack is shuffled once by (user, calendar
   bucket): a week, so that a user who owns a large part of all transactions is spread over
   many tasks, and an hour for users the caller names as heavy (``heavy_users`` finds them);
2. in order of time, every edge starts a new segment, so no segment crosses an edge. A segment shrinks
   to one row: its balance-days, the balance it ends with, totals of its transactions;
3. these few rows per user are chained by user. A window is a run of whole segments, so the fee of any
   window between stacked edges adds up its segments, and the last one holds to the window's end.

No transaction is joined with a window. The bucket width never changes a result.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from funnelworks.functions.ratios import fill
from funnelworks.functions.time import fractional_days
from funnelworks.operators.events import tie_columns
from funnelworks.sources.storage import materialise

FEE_RATE = 0.005  # fixed value: yearly fee on the balance
DAYS_PER_YEAR = 365.0
BUCKET_HOURS = 7 * 24
HEAVY_BUCKET_HOURS = 1

HEAVY_ROWS = 5_000_000
HEAVY_USERS = 1_000
ITEMS_TRACKED = 4_096


def heavy_users(tx: DataFrame, min_rows: int = HEAVY_ROWS) -> list:
    """Users with at least ``min_rows`` transactions, at most a thousand of the largest.

    A frequent-items sketch over the user column: one scan, one small sketch per map task. Users
    it misses hold less than about 0.03 % of all rows.
    """
    sketch = F.expr(f"approx_top_k(user_id, {HEAVY_USERS}, {ITEMS_TRACKED})")
    found = tx.agg(sketch.alias("top")).first()["top"] or []
    return [r["item"] for r in found if r["item"] is not None and r["count"] >= min_rows]


def account_instants(tx: DataFrame, tie: str = "tx_id") -> DataFrame:
    """One row per (user, instant): balance after it, and totals of its transactions.

    ``tie`` orders rows of one instant; it must be unique and not null. Unused totals are pruned
    from the plan by the optimizer.
    """
    ties = tie_columns(tx, tie, ["running_balance_usd", "amount_usd", "transaction_type"])
    last = F.col(ties[0]) if ties == [tie] else F.struct(*ties)
    balance, amount, kind = F.col("running_balance_usd"), F.col("amount_usd"), F.col("transaction_type")
    deposit, withdrawal = kind == "deposit", kind == "withdrawal"
    return (
        tx.filter(F.col("user_id").isNotNull() & F.col("transaction_timestamp").isNotNull())
        .groupBy("user_id", F.col("transaction_timestamp").alias("ts"))
        .agg(
            F.max_by(balance, last).alias("balance"),
            F.max_by(balance, F.when(balance.isNotNull(), last)).alias("known_balance"),
            F.count(F.lit(1)).alias("tx_count"),
            F.sum(F.when(deposit, amount)).alias("dep_sum"),
            F.count_if(deposit).alias("dep_cnt"),
            F.sum(F.when(withdrawal, amount)).alias("wdr_sum"),
            F.count_if(withdrawal).alias("wdr_cnt"),
            F.max(balance).alias("bal_max"),
            F.sum(balance).alias("bal_sum"),
            F.count(balance).alias("bal_cnt"),
        )
    )


def _bucket(user: Column, ts: Column, bucket_hours: int, heavy: Sequence) -> Column:
    hours = F.unix_date(F.to_date(ts)) * F.lit(24) + F.hour(ts)
    fine = user.isNull() | user.isin(list(heavy)) if heavy else user.isNull()
    width = F.when(fine, HEAVY_BUCKET_HOURS).otherwise(bucket_hours)
    return F.floor(hours / width)


START, ROW, END = 0, 1, 2  # order of a window's start, transactions and a window's end at one instant

# Totals of a segment's transactions, by how they add up over segments.
SUMS = ("tx_count", "dep_sum", "dep_cnt", "wdr_sum", "wdr_cnt", "bal_sum", "bal_cnt")


def _totals() -> dict[str, Column]:
    balance, amount, kind = F.col("balance"), F.col("amount_usd"), F.col("transaction_type")
    deposit, withdrawal = kind == "deposit", kind == "withdrawal"
    return {
        "tx_count": F.count_if(F.col("side") == ROW),
        "dep_sum": F.sum(F.when(deposit, amount)),
        "dep_cnt": F.count_if(deposit),
        "wdr_sum": F.sum(F.when(withdrawal, amount)),
        "wdr_cnt": F.count_if(withdrawal),
        "bal_sum": F.sum(balance),
        "bal_cnt": F.count(balance),
        "bal_max": F.max(balance),
    }


def _edge_rows(windows: DataFrame, starts: Sequence[str], ends: Sequence[str]) -> DataFrame:
    sides = [(c, START) for c in starts] + [(c, END) for c in ends]
    edges = F.array(*[
        F.struct(F.lit(n).alias("edge"), F.lit(side).alias("side"), F.col(c).alias("ts")) for n, (c, side) in enumerate(sides)
    ])
    known = windows.filter(F.col("user_id").isNotNull())
    return known.select("user_id", F.explode(edges).alias("e")).select("user_id", "e.*").filter(F.col("ts").isNotNull())


@dataclass(frozen=True)
class BalanceIndex:
    """Segments of the accounts between the stacked edges, and the names of the edges by number.

    One row per (user, bucket, segment): ``first_ts``, ``last_ts``, the balance after the last transaction (NULL when
    unknown), balance-days ``held`` between its transactions, the last known balance, totals, and the edge it starts with.
    """

    segments: DataFrame
    edges: tuple[str, ...]

    def written(self) -> BalanceIndex:
        """The same index as a table in the checkpoint folder, for many reports."""
        return replace(self, segments=materialise(self.segments, "balance-index"))

    def last_instant(self) -> DataFrame:
        """The time of the last transaction, as one row."""
        return self.segments.agg(F.max("last_ts").alias("last_instant"))

    def chained(self) -> DataFrame:
        """Segments with the user's edges as columns, and ``next_ts``, the first transaction after the segment."""
        users = self.segments.filter(F.col("user_id").isNotNull())
        following = F.expr("lead(first_ts) IGNORE NULLS OVER (PARTITION BY user_id ORDER BY bucket, segment)")
        every = Window.partitionBy("user_id")
        return users.withColumn("next_ts", following).withColumns({
            name: F.max(F.when(F.col("edge") == n, F.col("edge_ts"))).over(every) for n, name in enumerate(self.edges)
        }).filter(F.col("first_ts").isNotNull())

    def fees(self, windows: Mapping[str, tuple[str, str]], fee_rate: float = FEE_RATE) -> DataFrame:
        """Fee revenue per user of each named (start, end); users with a transaction in one of the windows."""
        inside = reduce(or_, [within(*w) for w in windows.values()])
        return self.chained().filter(inside).groupBy("user_id").agg(
            *[window_fee(*w, fee_rate).alias(name) for name, w in windows.items()]
        )


def within(start: str, end: str) -> Column:
    """Whether a chained segment lies in the window; false where the user has none."""
    return fill((F.col("first_ts") >= F.col(start)) & (F.col("last_ts") <= F.col(end)), False)


def window_fee(start: str, end: str, fee_rate: float = FEE_RATE) -> Column:
    """Fee of a window as an aggregate over a user's chained segments; an unknown balance earns nothing."""
    until = F.least(F.coalesce(F.col("next_ts"), F.col(end)), F.col(end))
    after = F.col("last_balance").cast("double") * fractional_days(F.col("last_ts"), until)
    days = fill("held", 0.0) + fill(after, 0.0)
    return fill(F.sum(F.when(within(start, end), days)), 0.0) * F.lit(fee_rate / DAYS_PER_YEAR)


def balance_index(
    tx: DataFrame,
    windows: DataFrame,
    starts: Sequence[str],
    ends: Sequence[str],
    tie: str = "tx_id",
    bucket_hours: int = BUCKET_HOURS,
    heavy: Sequence | None = None,
) -> BalanceIndex:
    """Index of ``tx`` for windows whose edges are the columns ``starts`` and ``ends`` of ``windows``.

    ``windows`` has one row per user; a NULL edge leaves its windows empty. ``tie`` orders rows of one instant; it must
    be unique and not null. ``heavy`` names users to spread finer. Transactions without a user are no account's
    but count for ``last_instant``; they are spread like heavy users.
    """
    ties = tie_columns(tx, tie, ["running_balance_usd", "amount_usd", "transaction_type"])
    rows = tx.filter(F.col("transaction_timestamp").isNotNull()).select(
        "user_id", F.col("transaction_timestamp").alias("ts"), F.lit(ROW).alias("side"), F.lit(None).cast("int").alias("edge"),
        F.col("running_balance_usd").alias("balance"), "amount_usd", "transaction_type", *[F.col(c).alias(f"_tie_{c}") for c in ties],
    )
    stack = rows.unionByName(_edge_rows(windows, starts, ends), allowMissingColumns=True)
    stack = stack.withColumn("bucket", _bucket(F.col("user_id"), F.col("ts"), bucket_hours, heavy or ()))

    order = Window.partitionBy("user_id", "bucket").orderBy("ts", "side", *[f"_tie_{c}" for c in ties], "edge")
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    is_row, balance = F.col("side") == ROW, F.col("balance")
    followed = F.lead("side").over(order).eqNullSafe(F.lit(ROW))  # by another transaction of the segment
    cut = stack.withColumns({"segment": F.count("edge").over(so_far), "_followed": followed, "_next": F.lead("ts").over(order)})
    known = F.when(balance.isNotNull(), F.struct(F.col("segment"), balance))
    cut = cut.withColumn("_known", F.last(known, ignorenulls=True).over(so_far))
    last = is_row & ~F.col("_followed")
    of_segment = F.col("_known.segment") == F.col("segment")
    segments = cut.groupBy("user_id", "bucket", "segment").agg(
        F.max("edge").alias("edge"),
        F.max(F.when(~is_row, F.col("ts"))).alias("edge_ts"),
        F.min(F.when(is_row, F.col("ts"))).alias("first_ts"),
        F.max(F.when(is_row, F.col("ts"))).alias("last_ts"),
        F.max(F.when(last, balance)).alias("last_balance"),
        F.sum(F.when(is_row & F.col("_followed"), balance.cast("double") * fractional_days(F.col("ts"), F.col("_next")))).alias("held"),
        F.max(F.when(last & of_segment, F.col("_known.balance"))).alias("known_balance"),
        *[c.alias(name) for name, c in _totals().items()],
    )
    return BalanceIndex(segments, (*starts, *ends))


def fee_revenue_interval(
    tx: DataFrame,
    windows: DataFrame,
    start: str,
    ends: Mapping[str, str],
    fee_rate: float = FEE_RATE,
    tie: str = "tx_id",
    bucket_hours: int = BUCKET_HOURS,
    heavy: Sequence | None = None,
) -> DataFrame:
    """Fee revenue per user over [start, end] for each named end, in one pass over ``tx``.

    Returns users with at least one transaction inside their widest window.
    """
    index = balance_index(tx, windows, [start], list(dict.fromkeys(ends.values())), tie, bucket_hours, heavy)
    return index.fees({name: (start, end) for name, end in ends.items()}, fee_rate)
