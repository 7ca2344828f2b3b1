"""Canonical tables out of an event stream: bars, ticks, decisions, signals and deals.

Session time zones never matter: the event time is naive UTC and stays so.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import scalars as S


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(
        F.col("event_id").cast("long"), F.col("ts").cast("timestamp_ntz").alias("ts"), "event_type", F.col("value").cast("double")
    )


def bars(rows: DataFrame, symbol: str | None = None) -> DataFrame:
    """Hourly bars of each event type, or of all events under one ``symbol``."""
    hour = F.date_trunc("hour", F.col("ts").cast("timestamp")).cast("timestamp_ntz")
    name = F.lit(symbol) if symbol else F.col("event_type")
    return rows.groupBy(name.alias("symbol"), hour.alias("timestamp")).agg(
        F.min_by("value", "ts").alias("open"),
        F.max("value").alias("high"),
        F.min("value").alias("low"),
        F.max_by("value", "ts").alias("close"),
        F.count("*").alias("tick_volume"),
        F.lit(0).cast("long").alias("spread"),
        F.lit(0).cast("long").alias("real_volume"),
    )


def ticks(rows: DataFrame, spread: str = "0.02") -> DataFrame:
    bid = F.col("value").cast(S.PRICE)
    return rows.select(
        F.lit("ALL").alias("symbol"),
        F.col("event_id").alias("source_seq"),
        F.col("ts").alias("time"),
        bid.alias("bid"),
        (bid + F.lit(spread).cast(S.PRICE)).cast(S.PRICE).alias("ask"),
        F.lit(0).alias("flags"),
    )


def decisions(rows: DataFrame, band: float = 0.05) -> DataFrame:
    """A decision at each all-events bar's close, from the bar's body return."""
    body = F.try_divide(F.col("close"), F.col("open")) - 1
    return bars(rows, "ALL").select(
        "symbol",
        F.concat(F.lit("d"), F.date_format("timestamp", "yyyyMMddHH")).alias("signal_id"),
        (F.col("timestamp") + F.expr("interval 1 hour")).alias("decision_time"),
        F.when(body > band, "long").when(body < -band, "short").otherwise("ABSTAIN").alias("action"),
        body.alias("body_return"),
    )


def signals(rows: DataFrame, lower: str = "0.45", upper: str = "0.55") -> DataFrame:
    """Directional signals with a probability; the abstaining ones are left out."""
    p = F.round(F.lit(0.5) + F.col("body_return") / (F.lit(2.0) * (F.lit(1.0) + F.abs("body_return"))), 6).cast("decimal(8,6)")
    label = F.when(F.hour("decision_time") % 2 == 0, "UP").otherwise("DOWN")
    side = F.when(F.col("p_up") <= F.lit(lower).cast("decimal(8,6)"), "short").when(F.col("p_up") >= F.lit(upper).cast("decimal(8,6)"), "long")
    return (
        decisions(rows)
        .select("symbol", "signal_id", "decision_time", (F.col("decision_time") + F.expr("interval 1 hour")).alias("target_time"), p.alias("p_up"), label.alias("target_label"))
        .withColumn("side", side)
        .filter("side IS NOT NULL")
    )


#: Deal type by event type (fixed values of the adaptation).
DEAL_TYPES = {"view": 0, "click": 1, "purchase": 2, "signup": 7, "error": 99}


def deals(rows: DataFrame) -> DataFrame:
    kind = F.create_map(*[F.lit(x) for pair in DEAL_TYPES.items() for x in pair])
    value = F.col("value").cast("decimal(20,8)")
    ms = S.epoch_ms(F.col("ts"))
    return rows.select(
        (F.col("event_id") + 1).alias("ticket"),
        S.floor_seconds(ms).alias("time"),
        ms.alias("time_msc"),
        F.get(F.array(kind[F.col("event_type")]), F.lit(0)).cast("long").alias("type"),
        F.lit("EURUSD").alias("symbol"),
        (value - 50).cast(S.MONEY).alias("profit"),
        (value * F.lit("-0.01").cast("decimal(4,2)")).cast(S.MONEY).alias("commission"),
        (value * F.lit("0.002").cast("decimal(6,3)")).cast(S.MONEY).alias("swap"),
        F.lit("-0.2").cast(S.MONEY).alias("fee"),
    )
