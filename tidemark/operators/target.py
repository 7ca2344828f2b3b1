"""Next-bar direction labels and their report."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.quantiles import quantiles

LABELS = ("UP", "DOWN", "ZERO", "GAP")


def direction(bars: DataFrame) -> DataFrame:
    """(symbol, decision_timestamp, target_timestamp, future_return_1h, target_h1_direction).

    The label looks at the next bar only, and only if it begins exactly an hour later; otherwise it
    is GAP, and null on a series' last bar. A zero close gives a null return and label.
    """
    w = Window.partitionBy("symbol").orderBy("timestamp")
    out = bars.select(
        "symbol",
        F.col("timestamp").alias("decision_timestamp"),
        F.lead("timestamp").over(w).alias("target_timestamp"),
        F.col("close").cast("double").alias("_close"),
        F.lead(F.col("close").cast("double")).over(w).alias("_next"),
    )
    next_hour = F.col("target_timestamp") == F.col("decision_timestamp") + F.expr("interval 1 hour")
    ratio = F.when(next_hour, F.try_divide("_next", "_close") - 1)
    label = (
        F.when(F.col("target_timestamp").isNotNull() & ~next_hour, "GAP")
        .when(F.col("future_return_1h") > 0, "UP")
        .when(F.col("future_return_1h") < 0, "DOWN")
        .when(F.col("future_return_1h") == 0, "ZERO")
    )
    return out.withColumn("future_return_1h", ratio).withColumn("target_h1_direction", label).drop("_close", "_next")


def report(target: DataFrame) -> DataFrame:
    """One row per symbol: class counts, fractions and the distribution of returns (sample std, exact quartiles)."""
    label, r = F.col("target_h1_direction"), F.col("future_return_1h")
    quartiles = quantiles(target.select("symbol", r.alias("x")), (0.25, 0.5, 0.75)).select("symbol", F.col("quantiles").alias("_q"))
    out = target.groupBy("symbol").agg(
        F.count("*").alias("rows"),
        *[F.count_if(label == x).alias(f"n_{x.lower()}") for x in LABELS],
        F.count_if(label.isNull()).alias("n_unlabeled"),
        F.count(r).alias("n_returns"),
        F.avg(r).alias("mean"),
        F.stddev_samp(r).alias("std"),
        F.min(r).alias("min"),
        F.max(r).alias("max"),
    )
    binary = F.col("n_up") + F.col("n_down")
    return out.join(quartiles, "symbol", "left").select(
        *out.columns, F.try_divide("n_up", binary).alias("up_fraction"), F.col("_q")[0].alias("p25"), F.col("_q")[1].alias("p50"), F.col("_q")[2].alias("p75")
    )
