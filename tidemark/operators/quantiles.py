"""Exact quantiles of each series by selection: histograms over value ranges, refined where a rank lies.

A pass cuts every range that holds a wanted rank at values that a sketch of bounded size finds to lie about evenly, whatever the
distribution, and counts the values between and at the cuts (partially in the scan, so a task sends a bounded number of rows a
range). The group with the rank is the next range: a small part of the last, or one value only. A range with few values is sorted.
So no task holds more than a bounded number of values, and one key may hold all of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark import session

#: Parts that a pass cuts a range into, about.
PARTS = 64
#: Values that a task may sort.
FEW = 10_000


def _inside(values: DataFrame, ranges: DataFrame) -> DataFrame:
    return values.join(ranges, "symbol").filter((F.col("x") >= F.col("_low")) & (F.col("x") <= F.col("_high")))


def _hits(values: DataFrame, wanted: DataFrame, ranges: DataFrame, key: Column) -> DataFrame:
    """``wanted`` ranks with the group of values (by ``key``, which grows with the value) that each falls into."""
    groups = _inside(values, ranges).groupBy("symbol", "_low", "_high", "below", key.alias("_key")).agg(
        F.sum("n").alias("count"), F.count("*").alias("rows"), F.min("x").alias("_least"), F.max("x").alias("_most")
    )
    w = Window.partitionBy("symbol", "_low", "_high").orderBy("_key").rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.withColumn("_below", F.col("below") + F.coalesce(F.sum("count").over(w), F.lit(0))).drop("below", "_key")
    found = wanted.select("symbol", "rank", F.col("low").alias("_low"), F.col("high").alias("_high")).join(groups, ["symbol", "_low", "_high"])
    found = found.filter((F.col("rank") >= F.col("_below")) & (F.col("rank") < F.col("_below") + F.col("count")))
    return found.select("symbol", "rank", F.col("_least").alias("low"), F.col("_most").alias("high"), F.col("_below").alias("below"), "rows")


def _ranges(wanted: DataFrame) -> DataFrame:
    return wanted.select("symbol", F.col("low").alias("_low"), F.col("high").alias("_high"), "below").distinct()


def quantiles(values: DataFrame, shares: tuple[float, ...], few: int = FEW, parts: int = PARTS) -> DataFrame:
    """(symbol, n, quantiles): an array with the value at each share of the ranks, linear between two ranks.

    ``values`` has (symbol, x), and n, if a row stands for n equal values. Nulls are left out; a series of nulls has no row. NaN
    is not expected.
    """
    weight = F.col("n").cast("long") if "n" in values.columns else F.lit(1).cast("long")
    values = session.checkpointed(values.select("symbol", F.col("x").cast("double").alias("x"), weight.alias("n")).filter("x IS NOT NULL AND n > 0"))
    totals = values.groupBy("symbol").agg(F.sum("n").alias("n"), F.min("x").alias("low"), F.max("x").alias("high"), F.count("*").alias("rows"))
    totals = session.checkpointed(totals)
    spot = [(F.col("n") - 1).cast("double") * F.lit(float(s)) for s in shares]
    ranks = F.array_distinct(F.array(*[f(p).cast("long") for p in spot for f in (F.floor, F.ceil)]))
    wanted = totals.select("symbol", F.explode(ranks).alias("rank"), "low", "high", F.lit(0).cast("long").alias("below"), "rows")
    done = (F.col("rows") <= few) | (F.col("low") == F.col("high"))
    ready = wanted.filter(done)
    rest = session.checkpointed(wanted.filter(~done))
    cuts = F.percentile_approx("x", F.array(*[F.lit(k / parts) for k in range(1, parts)]), F.lit(16 * parts)).alias("_cuts")
    while not rest.isEmpty():
        ranges = _ranges(rest)
        ranges = _inside(values, ranges).groupBy("symbol", "_low", "_high", "below").agg(cuts)
        at_cut = F.array_contains("_cuts", F.col("x")).cast("int")
        key = 2 * F.size(F.filter("_cuts", lambda c: c < F.col("x"))) + at_cut
        wanted = session.checkpointed(_hits(values, rest, ranges, key))
        ready, rest = ready.union(wanted.filter(done)), session.checkpointed(wanted.filter(~done))
    found = _hits(values, ready, _ranges(ready), F.col("x")).groupBy("symbol").agg(F.map_from_entries(F.collect_list(F.struct("rank", "low"))).alias("_at"))
    at = lambda rank: F.element_at("_at", rank.cast("long"))
    between = [at(F.floor(p)) + (p - F.floor(p)) * (at(F.ceil(p)) - at(F.floor(p))) for p in spot]
    return totals.join(found, "symbol").select("symbol", "n", F.array(*between).alias("quantiles"))
