"""Fifteen backward-looking features, computed within segments, and their diagnostics."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import scalars as S
from tidemark.operators.bars import segments
from tidemark.operators.comoments import comoments

RETURNS = (1, 3, 6, 12, 24)
VOLATILITIES = (6, 12, 24)
CANDIDATES = (
    *[f"return_{k}h" for k in RETURNS],
    *[f"rolling_vol_{k}h" for k in VOLATILITIES],
    "range_pct",
    "body_return",
    "relative_tick_volume_24h",
    "hour_sin",
    "hour_cos",
    "dow_sin",
    "dow_cos",
)
#: Bars that each feature reads, its own bar included.
LOOKBACK_BARS = {
    **{f"return_{k}h": k + 1 for k in RETURNS},
    **{f"rolling_vol_{k}h": k + 1 for k in VOLATILITIES},
    "relative_tick_volume_24h": 24,
}
SELECTED = tuple(c for c in CANDIDATES if c not in ("return_3h", "return_12h", "rolling_vol_12h"))


def build(bars: DataFrame) -> DataFrame:
    """(symbol, timestamp, segment_id, 15 features): one sort by segment serves all windows."""
    rows = segments(bars)
    by_time = Window.partitionBy("symbol", "segment_id").orderBy("timestamp")
    frame = lambda n: by_time.rowsBetween(-(n - 1), 0)
    o, h, lo, c, v = (F.col(x).cast("double") for x in ("open", "high", "low", "close", "tick_volume"))
    rows = rows.select("symbol", "timestamp", "segment_id", *[x.alias(n) for x, n in zip((o, h, lo, c, v), ("o", "h", "l", "c", "v"), strict=True)])
    rows = rows.select(
        "*", *[S.finite(S.divide(F.col("c"), F.lag("c", k).over(by_time)) - 1).alias(f"return_{k}h") for k in RETURNS]
    )
    full = lambda x, n, value: F.when(F.count(x).over(frame(n)) == n, value)
    angle = lambda x, n: F.lit(2 * math.pi) * x / F.lit(float(n))
    hour, day = F.hour("timestamp").cast("double"), S.monday_zero(F.col("timestamp")).cast("double")
    rows = rows.select(
        "*",
        *[full("return_1h", k, F.stddev_pop("return_1h").over(frame(k))).alias(f"rolling_vol_{k}h") for k in VOLATILITIES],
        S.finite(S.divide(F.col("h") - F.col("l"), F.col("c"))).alias("range_pct"),
        S.finite(S.divide(F.col("c"), F.col("o")) - 1).alias("body_return"),
        full("v", 24, S.finite(S.divide(F.col("v"), F.avg("v").over(frame(24))) - 1)).alias("relative_tick_volume_24h"),
        F.sin(angle(hour, 24)).alias("hour_sin"),
        F.cos(angle(hour, 24)).alias("hour_cos"),
        F.sin(angle(day, 7)).alias("dow_sin"),
        F.cos(angle(day, 7)).alias("dow_cos"),
    )
    return rows.select("symbol", "timestamp", "segment_id", *CANDIDATES)


def _stacked(row: DataFrame, names: tuple[str, ...], parts: dict[str, str]) -> DataFrame:
    each = F.array(*[F.struct(F.lit(n).alias("feature"), *[F.col(f"{p}_{k}").alias(a) for p, a in parts.items()]) for k, n in enumerate(names)])
    return row.select(F.explode(each).alias("x")).select("x.*")


def diagnostics(features: DataFrame, names: tuple[str, ...] = CANDIDATES) -> DataFrame:
    """(feature, missing, non_finite, distinct_values, first_valid) from one aggregation."""
    row = features.agg(
        *[F.count_if(F.col(n).isNull()).alias(f"m_{k}") for k, n in enumerate(names)],
        *[F.count_if(F.isnan(n)).alias(f"f_{k}") for k, n in enumerate(names)],
        *[F.min(F.when(F.col(n).isNotNull(), F.col("timestamp"))).alias(f"t_{k}") for k, n in enumerate(names)],
    )
    wide = _stacked(row, names, {"m": "missing", "f": "non_finite", "t": "first_valid"})
    values = features.select(F.explode(F.array(*[F.struct(F.lit(n).alias("feature"), F.col(n).alias("value")) for n in names])).alias("x")).select("x.*")
    distinct = values.groupBy("feature").agg(F.count_distinct("value").alias("distinct_values"))
    return wide.join(distinct, "feature", "left").fillna(0, ["distinct_values"])


def correlations(features: DataFrame, names: tuple[str, ...] = CANDIDATES, top: int = 10) -> DataFrame:
    """The pairs with the highest |r|: (left, right, abs_correlation).

    Pearson's r over the rows that have both (``comoments``); a pair in which one is constant there is left out.
    """
    found = comoments(features, names).filter("xx > 0 AND yy > 0")
    r = found.select("left", "right", F.round(F.abs(F.col("xy") / (F.sqrt("xx") * F.sqrt("yy"))), 8).alias("abs_correlation"))
    return r.orderBy(F.desc("abs_correlation"), F.desc("left"), F.desc("right")).limit(top)
