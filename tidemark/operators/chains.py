"""Greedy choice of intervals that do not overlap, in rounds of pointer doubling.

Candidates of a series begin in order; one is taken if the last one taken has ended by then. Where a candidate begins no earlier
than every end before it, it is taken whatever came before: such candidates are roots, and what follows a root up to the next one
depends on nothing else. From each candidate a pointer leads to the first one that begins at or after its end. All that pointers
reach from roots is taken: in round k every pointer spans 2^k steps, and the number of candidates known to be reached doubles. So
rounds grow with the logarithm of the longest run between two roots, each is one join on keys that differ, and no task holds a series.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark import session

#: Span of a bucket of a time axis in microseconds, a day.
BUCKET = 86_400_000_000


def before(rows: DataFrame, at: str, values: dict[str, Column], span: int = BUCKET) -> DataFrame:
    """``rows`` with, by name, the greatest of each value over rows of the series (``symbol``) whose ``at`` (a long) is smaller.

    Null where there is none. In two levels, buckets of ``at`` and rows within one, so a task holds one bucket, or one row for
    each bucket of a series.
    """
    return _running(rows, at, values, span, F.max, F.greatest, lambda c: F.col(c))


def after(rows: DataFrame, at: str, values: dict[str, Column], span: int = BUCKET) -> DataFrame:
    """``rows`` with, by name, the least of each value over rows of the series whose ``at`` is greater."""
    return _running(rows, at, values, span, F.min, F.least, lambda c: F.col(c).desc())


def _running(rows, at, values, span, best, better, order) -> DataFrame:
    names = list(values)
    held = rows.withColumns({f"_v{k}": v for k, v in enumerate(values.values())}).withColumn("_bucket", F.floor(F.col(at) / span).cast("long"))
    tops = held.groupBy("symbol", "_bucket").agg(*[best(f"_v{k}").alias(f"_top{k}") for k in range(len(names))])
    w = Window.partitionBy("symbol").orderBy(order("_bucket")).rowsBetween(Window.unboundedPreceding, -1)
    tops = tops.select("symbol", "_bucket", *[best(f"_top{k}").over(w).alias(f"_far{k}") for k in range(len(names))])
    inside = Window.partitionBy("symbol", "_bucket").orderBy(order(at)).rangeBetween(Window.unboundedPreceding, -1)
    near = held.select("*", *[best(f"_v{k}").over(inside).alias(f"_near{k}") for k in range(len(names))])
    found = near.join(tops, ["symbol", "_bucket"]).withColumns({n: better(f"_near{k}", f"_far{k}") for k, n in enumerate(names)})
    return found.drop("_bucket", *[f"{x}{k}" for x in ("_v", "_near", "_far") for k in range(len(names))])


def next_at(rows: DataFrame, at: str, wanted: str, name: str, among: Column | None = None, span: int = BUCKET) -> DataFrame:
    """``rows`` with ``name``: the smallest ``at`` of the series that is no smaller than ``wanted``; null if there is none.

    Only rows that meet ``among`` are looked for. A row looks into the bucket of ``wanted`` first, then into the next with rows.
    """
    bucket = lambda c: F.floor(F.col(c) / span).cast("long")
    sought = rows if among is None else rows.filter(among)
    marks = sought.select("symbol", bucket(at).alias("_bucket"), F.col(at).alias("_t"), F.lit(1).alias("_mark")).distinct()
    asked = rows.select("symbol", bucket(wanted).alias("_bucket"), F.col(wanted).alias("_t"), F.lit(0).alias("_mark")).filter("_t IS NOT NULL").distinct()
    both = marks.union(asked)
    down = Window.partitionBy("symbol", "_bucket").orderBy(F.desc("_t"), F.desc("_mark")).rowsBetween(Window.unboundedPreceding, -1)
    inside = both.withColumn("_inside", F.last(F.when(F.col("_mark") == 1, F.col("_t")), ignorenulls=True).over(down)).filter("_mark = 0")
    firsts = both.groupBy("symbol", "_bucket").agg(F.min(F.when(F.col("_mark") == 1, F.col("_t"))).alias("_first"))
    later = Window.partitionBy("symbol").orderBy(F.desc("_bucket")).rowsBetween(Window.unboundedPreceding, -1)
    firsts = firsts.select("symbol", "_bucket", F.last("_first", ignorenulls=True).over(later).alias("_later"))
    found = inside.join(firsts, ["symbol", "_bucket"]).select("symbol", F.col("_t").alias(wanted), F.coalesce("_inside", "_later").alias(name))
    return rows.join(found, ["symbol", wanted], "left")


def reached(nodes: DataFrame) -> DataFrame:
    """(symbol, at) of all nodes on the paths that begin at roots, out of (symbol, at, root, to); ``at`` names a node of its series.

    ``to`` leads on to a later node, or is null. Paths that lead into another root may go on there or end.
    """
    rows = nodes.select("symbol", "at", F.col("root").alias("reached"), "to")
    ends = rows.filter("reached").select("symbol", F.col("at").alias("to"), F.lit(True).alias("_root"))  # a path may end where another begins
    rows = rows.join(ends, ["symbol", "to"], "left").select("symbol", "at", "reached", F.when(F.col("_root").isNull(), F.col("to")).alias("to"))
    rows = session.checkpointed(rows)
    while not rows.filter("reached AND to IS NOT NULL").isEmpty():
        steps = rows.filter("to IS NOT NULL").join(rows.select("symbol", F.col("at").alias("to"), F.col("to").alias("_on")), ["symbol", "to"], "left")
        moved = steps.select("symbol", "at", "reached", F.col("_on").alias("to"))
        hit = steps.filter("reached").select("symbol", F.col("to").alias("at"), F.lit(True).alias("reached"), F.lit(None).cast("long").alias("to"))
        still = rows.filter("to IS NULL")
        rows = session.checkpointed(moved.union(still).union(hit).groupBy("symbol", "at").agg(F.max("reached").alias("reached"), F.max("to").alias("to")))
    return rows.filter("reached").select("symbol", "at")


def chosen(candidates: DataFrame) -> DataFrame:
    """(symbol, at) of the candidates that are taken, out of (symbol, at, end) with distinct ``at`` in a series.

    A candidate is taken if no taken one before it ends after ``at``. One whose ``end`` is null never ends, but does not keep
    later ones out here: cut what follows the first of those that are taken.
    """
    rows = session.checkpointed(candidates.select("symbol", "at", "end"))
    rows = before(rows, "at", {"_until": F.col("end")}).withColumn("root", F.coalesce(F.col("_until") <= F.col("at"), F.lit(True)))
    return reached(next_at(rows, "at", "end", "to"))
