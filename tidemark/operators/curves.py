"""Balance and equity curves: drawdown, spacing, streaks, trade summaries.

A curve has (symbol, time, seq, sub, value). What is asked of a whole curve is put together from summaries of its days, one
row a day, which merge in order: so a curve of any length is shuffled once, by day, and no task holds more than a day.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark import session
from tidemark.functions import scalars as S
from tidemark.operators.quantiles import quantiles

ORDER = ("time", "seq", "sub")


def _micros(c: Column) -> Column:
    return F.unix_micros(c.cast("timestamp"))


def _days(curve: DataFrame) -> DataFrame:
    """Of each day: its top and low, the deepest fall within it and that fall's recovery, and the stairs of its new heights.

    ``stairs``: the points that are as high as all before them that day, but the repeated ones of a level stretch; the first
    point of a day that reaches some height is among them. ``low_stairs``: the same of the points after the time of the low.
    """
    day = Window.partitionBy("symbol", "_day")
    so_far = day.orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, 0)
    earlier = day.orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, -1)
    value = F.col("value")
    rows = curve.select("symbol", *ORDER, "value", F.to_date("time").alias("_day"), F.struct("value", (-_micros(F.col("time"))).alias("us")).alias("_top"))
    rows = rows.withColumns({"_peak": F.max("_top").over(so_far), "_before": F.max("value").over(earlier), "_prior": F.lag("value").over(day.orderBy(*ORDER))})
    fall = F.col("_peak.value") - value
    inner = F.when(fall > 0, F.struct((-fall).alias("rise"), *ORDER, (-F.col("_peak.us")).alias("peak_us"), F.col("_peak.value").alias("peak")))
    rows = rows.withColumns({"_inner": F.min(inner).over(day), "_low": F.min(F.struct("value", *ORDER)).over(day)})
    below = F.col("time") > F.col("_low.time")
    rows = rows.withColumn("_since", F.max(F.when(below, value)).over(earlier))
    stair = lambda top: top.isNull() | (value > top) | ((value == top) & (F.col("_prior") < top))
    steps = lambda chosen: F.sort_array(F.collect_list(F.when(chosen, F.struct("time", "value"))))
    return rows.groupBy("symbol", "_day").agg(
        F.max("_top").alias("top"), F.min("_low").alias("low"), F.min("_inner").alias("inner"), F.max("time").alias("last"),
        F.min(F.when((F.col("time") > F.col("_inner.time")) & (value >= F.col("_inner.peak")), F.col("time"))).alias("inner_recovery"),
        steps(stair(F.col("_before"))).alias("stairs"), steps(below & stair(F.col("_since"))).alias("low_stairs"),
    )


def drawdown(curve: DataFrame) -> DataFrame:
    """One row per symbol: the deepest fall from a running peak, its times and its recovery.

    The first of equal falls and the first time of equal peaks count; all nulls where nothing falls. A recovery is the first
    time after the trough's at which the peak's value is reached again.
    """
    series = Window.partitionBy("symbol")  # a row a day
    days = _days(curve).withColumn("before", F.max("top").over(series.orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)))
    over_days = F.col("before.value") - F.col("low.value")
    outer = F.when(over_days > 0, F.struct((-over_days).alias("rise"), *[F.col(f"low.{c}").alias(c) for c in ORDER], (-F.col("before.us")).alias("peak_us"), F.col("before.value").alias("peak")))
    days = days.withColumn("outer", outer).withColumn("t", F.min(F.least("inner", "outer")).over(series))
    reached = lambda stairs: F.filter(stairs, lambda x: x["value"] >= F.col("t.peak"))
    first = lambda stairs: F.get(reached(F.col(stairs)), F.lit(0))["time"]
    own_day = F.col("_day") == F.to_date("t.time")
    recovery = (
        F.when(own_day & (F.col("inner") == F.col("t")), F.col("inner_recovery")).when(own_day, first("low_stairs")).when(F.col("_day") > F.to_date("t.time"), first("stairs"))
    )
    found = days.withColumn("_back", recovery).groupBy("symbol").agg(F.min("t").alias("t"), F.min("_back").alias("recovery_time"), F.max("last").alias("_end"))
    peak_time = F.timestamp_micros("t.peak_us").cast("timestamp_ntz")
    known, fall = F.col("t").isNotNull(), -F.col("t.rise")
    return found.select(
        "symbol",
        fall.alias("maximum_drawdown"),
        (fall.cast("double") / F.nullif(F.col("t.peak").cast("double"), F.lit(0.0)) * 100).alias("maximum_drawdown_pct"),
        peak_time.alias("peak_time"),
        F.col("t.time").alias("trough_time"),
        "recovery_time",
        F.when(known, F.col("recovery_time").isNotNull()).alias("recovered"),
        F.floor(S.seconds(F.col("t.time"), peak_time)).cast("long").alias("peak_to_trough_seconds"),
        F.floor(S.seconds(F.col("recovery_time"), peak_time)).cast("long").alias("peak_to_recovery_seconds"),
        F.when(known, F.when(F.col("recovery_time").isNull(), F.floor(S.seconds(F.col("_end"), peak_time))).otherwise(0)).cast("long").alias("unrecovered_seconds_at_end"),
    )


def spacing(curve: DataFrame, limit: int = 60) -> DataFrame:
    """Exact median, maximum and count over ``limit`` of the whole seconds between observations.

    The steps within a day are counted by their length; those between days come from the days' first and last times.
    """
    rows = curve.select("symbol", *ORDER, F.to_date("time").alias("_day"))
    prior = F.lag("time").over(Window.partitionBy("symbol", "_day").orderBy(*ORDER))
    gap = lambda to, since: F.floor(S.seconds(to, since)).cast("long")
    steps = rows.withColumn("gap", gap(F.col("time"), prior)).groupBy("symbol", "_day", "gap").agg(F.count("*").alias("n"), F.min("time").alias("_first"), F.max("time").alias("_last"))
    steps = session.checkpointed(steps)
    days = steps.groupBy("symbol", "_day").agg(F.min("_first").alias("_first"), F.max("_last").alias("_last"))
    before = F.lag("_last").over(Window.partitionBy("symbol").orderBy("_day"))
    across = days.select("symbol", gap(F.col("_first"), before).alias("gap"), F.lit(1).cast("long").alias("n"))
    gaps = session.checkpointed(steps.filter("gap IS NOT NULL").select("symbol", "gap", "n").union(across.filter("gap IS NOT NULL")).groupBy("symbol", "gap").agg(F.sum("n").alias("n")))
    counted = gaps.groupBy("symbol").agg(F.max("gap").alias("_most"), F.sum(F.when(F.col("gap") > limit, F.col("n"))).alias("_over"))
    median = quantiles(gaps.withColumnRenamed("gap", "x"), (0.5,)).select("symbol", F.col("quantiles")[0].alias("median_spacing_seconds"))
    seen = steps.groupBy("symbol").agg(F.sum("n").alias("observation_count"))
    return seen.join(median, "symbol", "left").join(counted, "symbol", "left").select(
        "symbol",
        "observation_count",
        "median_spacing_seconds",
        F.coalesce("_most", F.lit(0)).cast("long").alias("maximum_gap_seconds"),
        F.coalesce("_over", F.lit(0)).cast("long").alias("gaps_over_limit"),
    )


def losing_streaks(trades: DataFrame, by_time: str = "exit_time", net: str = "net_pnl") -> DataFrame:
    """(symbol, max_consecutive_losses): the longest run of negative results; zero or a win ends it.

    A day is summed up by its number of trades, the losses that it begins and ends with and its longest run; runs over several
    days are put together from those.
    """
    lost = F.coalesce(F.col(net) < 0, F.lit(False))
    day = Window.partitionBy("symbol", "_day")
    rows = trades.select("symbol", F.to_date(by_time).alias("_day"), lost.alias("_lost"), F.sum(F.when(lost, 0).otherwise(1)).over(Window.partitionBy("symbol", F.to_date(by_time)).orderBy(by_time)).alias("_run"))
    rows = rows.withColumns({"_last_run": F.max("_run").over(day), "_n": F.count_if("_lost").over(Window.partitionBy("symbol", "_day", "_run"))})
    days = rows.groupBy("symbol", "_day").agg(
        F.count_if(F.col("_lost") & (F.col("_run") == 0)).alias("head"), F.count_if(F.col("_lost") & (F.col("_run") == F.col("_last_run"))).alias("tail"),
        F.max(F.when(F.col("_lost"), F.col("_n")).otherwise(0)).alias("best"), F.bool_and("_lost").alias("whole"),
    )
    series = Window.partitionBy("symbol").orderBy("_day")  # a row a day
    days = days.withColumn("_broken", F.sum(F.when(F.col("whole"), 0).otherwise(1)).over(series))
    # what runs into a day: the tail of the last day that was not lost as a whole, and all days since
    since = Window.partitionBy("symbol", "_broken").orderBy("_day").rowsBetween(Window.unboundedPreceding, 0)
    days = days.withColumn("_open", F.sum("tail").over(since)).withColumn("_into", F.coalesce(F.lag("_open").over(series), F.lit(0)))
    return days.groupBy("symbol").agg(F.max(F.greatest("best", F.col("_into") + F.col("head"))).alias("max_consecutive_losses"))


def trade_summary(trades: DataFrame, net: str = "net_pnl") -> DataFrame:
    """Wins, losses, gross sums, profit factor with its status, rates and averages, per symbol."""
    x = F.col(net)
    zero = F.lit(0).cast("decimal(38,10)")
    sums = trades.groupBy("symbol").agg(
        F.count("*").alias("closed_trades"),
        F.count_if(x > 0).alias("wins"),
        F.count_if(x < 0).alias("losses"),
        F.coalesce(F.sum(F.when(x > 0, x)), zero).cast("double").alias("gross_wins"),
        F.coalesce(F.sum(F.when(x < 0, -x)), zero).cast("double").alias("gross_losses"),
        F.sum(x).cast("double").alias("net"),
    )
    status = F.when(F.col("gross_losses") > 0, "defined").when(F.col("gross_wins") > 0, "no_gross_losses").otherwise("no_closed_trade_pnl")
    return sums.select(
        "*",
        F.when(F.col("gross_losses") > 0, F.col("gross_wins") / F.col("gross_losses")).alias("profit_factor"),
        status.alias("profit_factor_status"),
        F.try_divide("wins", "closed_trades").alias("win_rate"),
        F.try_divide("gross_wins", "wins").alias("average_win"),
        (-F.try_divide("gross_losses", "losses")).alias("average_loss"),
        F.try_divide("net", "closed_trades").alias("expectancy"),
    )


def side_summary(trades: DataFrame, net: str = "net_pnl") -> DataFrame:
    """Both sides of each symbol, an empty side with zeros."""
    x, sides = F.col(net), ("long", "short")
    row = trades.groupBy("symbol").agg(
        *[F.count_if(F.col("side") == s).alias(f"{s}_n") for s in sides],
        *[F.coalesce(F.sum(F.when(F.col("side") == s, x)).cast("double"), F.lit(0.0)).alias(f"{s}_net") for s in sides],
        *[F.count_if((F.col("side") == s) & (x > 0)).alias(f"{s}_wins") for s in sides],
        *[F.count_if((F.col("side") == s) & (x < 0)).alias(f"{s}_losses") for s in sides],
    )
    names = {"n": "closed_trades", "net": "net_pnl", "wins": "wins", "losses": "losses"}
    each = F.array(*[F.struct(F.lit(s).alias("side"), *[F.col(f"{s}_{k}").alias(v) for k, v in names.items()]) for s in sides])
    return row.select("symbol", F.explode(each).alias("x")).select("symbol", "x.*")
