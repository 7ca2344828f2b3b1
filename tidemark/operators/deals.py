"""Exact-decimal deal ledger: checks, three-way partition, daily rollup, reconciliation."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.contracts import ContractError, naive
from tidemark.functions import scalars as S

REQUIRED = ("ticket", "time", "time_msc", "type", "symbol", "profit", "commission", "swap", "fee")
MONEY = ("profit", "commission", "swap", "fee")
#: Deal type names of the trading terminal (fixed values).
TYPE_NAMES = (
    "BUY", "SELL", "BALANCE", "CREDIT", "CHARGE", "CORRECTION", "BONUS", "COMMISSION", "COMMISSION_DAILY", "COMMISSION_MONTHLY",
    "COMMISSION_AGENT_DAILY", "COMMISSION_AGENT_MONTHLY", "INTEREST", "BUY_CANCELED", "SELL_CANCELED", "DIVIDEND", "DIVIDEND_FRANKED", "TAX",
)


def type_label(kind: Column) -> Column:
    names = F.array(*[F.lit(x) for x in TYPE_NAMES])
    return F.coalesce(F.get(names, kind.cast("int")), F.concat(F.lit("UNKNOWN_TYPE_"), kind.cast("string")))


def violations(deals: DataFrame) -> DataFrame:
    """(ticket, rule_order, code) of every broken rule; the strict reader raises with the least row."""
    absent = [c for c in REQUIRED if c not in deals.columns]
    if absent:
        raise ContractError(f"missing columns: {', '.join(absent)}")
    deals = deals.withColumn("_n", F.count("*").over(Window.partitionBy("ticket")))
    rules = {
        "ticket_not_positive": F.coalesce(F.col("ticket") <= 0, F.lit(True)),
        "duplicate_ticket": F.col("_n") > 1,
        "time_missing": F.col("time").isNull() | F.col("time_msc").isNull() | F.col("type").isNull(),
        "seconds_disagree": F.col("time") != S.floor_seconds(F.col("time_msc")),
        **{f"money_{m}": F.col(m).isNull() for m in MONEY},
    }
    flags = F.array(*[F.when(F.coalesce(x, F.lit(False)), F.struct(F.lit(k).alias("rule_order"), F.lit(n).alias("code"))) for k, (n, x) in enumerate(rules.items())])
    return deals.select("ticket", F.explode(F.array_compact(flags)).alias("x")).select("ticket", "x.rule_order", "x.code")


def checked(deals: DataFrame) -> DataFrame:
    first = violations(deals).orderBy("ticket", "rule_order").first()
    if first:
        raise ContractError(f"deal {first.ticket}: {first.code}")
    return deals


def partitioned(deals: DataFrame, start: datetime, end: datetime) -> DataFrame:
    """Deals with UTC time, type label, interval flag, subtotal and one of three partitions."""
    at = S.from_epoch_ms(F.col("time_msc"))
    low, high = (F.lit(naive(x)).cast("timestamp_ntz") for x in (start, end))
    inside = (F.col("time_utc") >= low) & (F.col("time_utc") < high)
    subtotal = F.col("profit")
    for m in MONEY[1:]:
        subtotal = subtotal + F.col(m)
    part = F.when(~F.col("in_interval"), "outside_interval").when(F.col("type").isin(0, 1), "trade").otherwise("other_operation")
    return (
        deals.withColumn("time_utc", at)
        .withColumn("type_label", type_label(F.col("type")))
        .withColumn("in_interval", inside)
        .withColumn("subtotal", subtotal.cast(S.MONEY))
        .withColumn("partition", part)
    )


def daily(rows: DataFrame) -> DataFrame:
    """Trades in the interval by UTC date: counts and exact sums."""
    return (
        rows.filter("partition = 'trade'")
        .groupBy(F.to_date("time_utc").alias("date"))
        .agg(F.count("*").alias("deals"), *[F.sum(m).alias(m) for m in (*MONEY, "subtotal")])
    )


def reconciliation(rows: DataFrame) -> DataFrame:
    """One row: how many deals each partition holds, and the trades' totals."""
    trade = F.col("partition") == "trade"
    return rows.agg(
        F.count("*").alias("rows"),
        F.count_if(trade).alias("trades"),
        F.count_if(F.col("partition") == "other_operation").alias("other_operations"),
        F.count_if(F.col("partition") == "outside_interval").alias("outside_interval"),
        F.count_if((F.col("partition") == "other_operation") & F.col("type_label").startswith("UNKNOWN_TYPE_")).alias("unknown_types"),
        *[F.coalesce(F.sum(F.when(trade, F.col(m))), F.lit(0).cast(S.MONEY)).alias(m) for m in (*MONEY, "subtotal")],
    ).withColumn("balanced", F.col("rows") == F.col("trades") + F.col("other_operations") + F.col("outside_interval"))


def other_operations(rows: DataFrame) -> DataFrame:
    return rows.filter("partition = 'other_operation'").groupBy("type", "type_label").agg(F.count("*").alias("deals"), F.sum("subtotal").alias("subtotal"))


def in_scope(deals: DataFrame, scope: dict[str, str]) -> DataFrame:
    """Deals whose scope columns contradict the account; only columns that are there are compared."""
    bad = F.lit(False)
    for name, value in scope.items():
        if name in deals.columns:
            bad = bad | (F.col(name).isNotNull() & (F.col(name).cast("string") != value))
    return deals.filter(bad)
