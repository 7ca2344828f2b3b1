"""Positions of rows in the time order of their series, without a series in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def ranked(rows: DataFrame, order: str, name: str = "rank", of: str = "n") -> DataFrame:
    """``rows`` with ``name``: 0, 1, 2 ... by the timestamp ``order`` within ``symbol``, and ``of``: the rows of the series.

    Rows are dealt by day; the days' counts give each day's first rank, and within a day the rank is local. Equal timestamps get
    ranks in no fixed order. A null timestamp comes first.
    """
    keyed = rows.withColumn("_day", F.to_date(order))
    counts = keyed.groupBy("symbol", "_day").agg(F.count("*").alias("_c"))
    series = Window.partitionBy("symbol")  # a row a day
    before = F.sum("_c").over(series.orderBy("_day").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select("symbol", "_day", F.coalesce(before, F.lit(0)).alias("_first"), F.sum("_c").over(series).alias(of))
    inside = F.row_number().over(Window.partitionBy("symbol", "_day").orderBy(order)) - 1
    same_day = F.col("a.symbol").eqNullSafe(F.col("b.symbol")) & F.col("a._day").eqNullSafe(F.col("b._day"))
    joined = keyed.withColumn("_inside", inside).alias("a").join(counts.alias("b"), same_day)
    return joined.select(*[f"a.{c}" for c in rows.columns], (F.col("_first") + F.col("_inside")).alias(name), f"b.{of}")
