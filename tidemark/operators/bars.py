"""Time policy, audit rules and segments of hourly bars."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.contracts import BarRequest, ContractError, naive
from tidemark.functions import scalars as S

REQUIRED = ("timestamp", "open", "high", "low", "close", "tick_volume", "spread", "real_volume")
NUMERIC = REQUIRED[1:]
NONNEGATIVE = ("tick_volume", "spread", "real_volume")
_HOUR = "interval 1 hour"


def missing_columns(df: DataFrame, required: tuple[str, ...] = REQUIRED) -> list[str]:
    return [c for c in required if c not in df.columns]


def _bounds(request: BarRequest) -> tuple:
    return tuple(F.lit(naive(x)).cast("timestamp_ntz") for x in (request.start, request.end, request.cutoff))


def time_policy(raw: DataFrame, request: BarRequest) -> DataFrame:
    """Bars that begin in [start, end) and were complete at the cutoff."""
    start, end, cutoff = _bounds(request)
    ts = F.col("timestamp").cast("timestamp_ntz")
    return raw.withColumn("timestamp", ts).filter((F.col("timestamp") >= start) & (F.col("timestamp") < end) & (F.col("timestamp") + F.expr(_HOUR) <= cutoff))


def exclusions(raw: DataFrame, request: BarRequest, by: tuple[str, ...] = ()) -> DataFrame:
    """How many rows each rule leaves out; a row can count under several."""
    start, end, cutoff = _bounds(request)
    ts = F.col("timestamp").cast("timestamp_ntz")
    return raw.groupBy(*by).agg(
        F.count_if(ts.isNull()).alias("invalid_timestamp"),
        F.count_if(ts < start).alias("before_start"),
        F.count_if(ts >= end).alias("at_or_after_end"),
        F.count_if(ts + F.expr(_HOUR) > cutoff).alias("incomplete_at_cutoff"),
    )


def coverage(raw: DataFrame, request: BarRequest, by: tuple[str, ...] = ()) -> DataFrame:
    """The extremes of all valid raw timestamps, and whether they cover the request."""
    start, _, _ = _bounds(request)
    ts = F.col("timestamp").cast("timestamp_ntz")
    last = request.last_required_open
    out = raw.groupBy(*by).agg(F.min(ts).alias("first_timestamp"), F.max(ts).alias("last_timestamp"))
    covers_end = F.lit(True) if last is None else F.coalesce(F.col("last_timestamp") >= F.lit(naive(last)).cast("timestamp_ntz"), F.lit(False))
    return out.withColumn("covers_start", F.coalesce(F.col("first_timestamp") <= start, F.lit(False))).withColumn("covers_end", covers_end)


def gaps(bars: DataFrame) -> DataFrame:
    """One row for each step of more than an hour between neighbouring distinct timestamps."""
    w = Window.partitionBy("symbol").orderBy("timestamp")
    steps = bars.select("symbol", "timestamp").filter("timestamp IS NOT NULL").distinct().withColumn("left", F.lag("timestamp").over(w))
    hours = S.seconds(F.col("timestamp"), F.col("left")) / 3600
    return steps.withColumn("hours", hours).filter("hours > 1").select("symbol", "left", F.col("timestamp").alias("right"), "hours")


def audit(bars: DataFrame, order_col: str | None = None) -> DataFrame:
    """(symbol, code, severity, rows) for every broken rule; gaps count one row each.

    ``order_col`` is the ingest order, without which order itself cannot be checked. An early
    return for missing columns is the only rule that hides others.
    """
    absent = missing_columns(bars)
    spark = bars.sparkSession
    if absent:
        return spark.createDataFrame([(None, "missing_columns", "error", len(absent))], "symbol string, code string, severity string, rows long")
    values = {c: S.finite(F.col(c)) for c in NUMERIC}
    all_finite = F.lit(True)
    for v in values.values():
        all_finite = all_finite & v.isNotNull()
    o, h, lo, c = (values[k] for k in ("open", "high", "low", "close"))
    negative = F.lit(False)
    for k in NONNEGATIVE:
        negative = negative | (values[k] < 0)
    ts = F.col("timestamp").cast("timestamp_ntz")
    flagged = bars.withColumn("_n", F.count("*").over(Window.partitionBy("symbol", ts)))
    order = F.lit(False)
    if order_col:
        earlier = F.max(ts).over(Window.partitionBy("symbol").orderBy(order_col).rowsBetween(Window.unboundedPreceding, -1))
        flagged = flagged.withColumn("_back", F.coalesce(ts < earlier, F.lit(False)))
        order = F.col("_back")
    checks = {
        "invalid_timestamp": ts.isNull(),
        "duplicate_opening_time": ts.isNotNull() & (F.col("_n") > 1),
        "timestamp_not_ordered": order,
        "invalid_numeric_value": ~all_finite,
        "ohlc_contradiction": all_finite & ((h < F.greatest(o, c)) | (lo > F.least(o, c))),
        "negative_nonnegative_field": all_finite & negative,
    }
    counts = flagged.groupBy("symbol").agg(*[F.count_if(F.coalesce(x, F.lit(False))).alias(k) for k, x in checks.items()])
    each = F.array(*[F.struct(F.lit(k).alias("code"), F.lit("error").alias("severity"), F.col(k).alias("rows")) for k in checks])
    found = counts.select("symbol", F.explode(each).alias("x")).select("symbol", "x.code", "x.severity", "x.rows")
    review = gaps(bars.withColumn("timestamp", ts)).groupBy("symbol").agg(F.count("*").alias("rows"))
    review = review.select("symbol", F.lit("unclassified_gap").alias("code"), F.lit("review").alias("severity"), "rows")
    return found.union(review).filter("rows > 0")


def validate_snapshot(bars: DataFrame, order_col: str | None = None) -> DataFrame:
    """The raise-first twin of ``audit``: returns the bars or raises with the first broken rule."""
    found = audit(bars if "symbol" in bars.columns else bars.withColumn("symbol", F.lit("")), order_col).orderBy("code").first()
    if found:
        raise ContractError(f"{found.code}: {found.rows} rows of {found.symbol}")
    return bars


def segments(bars: DataFrame) -> DataFrame:
    """Bars with ``segment_id``: a new one at every step that is not exactly an hour."""
    w = Window.partitionBy("symbol").orderBy("timestamp")
    before = F.lag("timestamp").over(w)
    starts = F.when(before.isNull() | (F.col("timestamp") != before + F.expr(_HOUR)), 1).otherwise(0)
    return bars.withColumn("_starts", starts).withColumn("segment_id", F.sum("_starts").over(w).cast("long")).drop("_starts")
