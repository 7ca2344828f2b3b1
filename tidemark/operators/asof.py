"""Forward as-of and interval joins between decisions, positions and quotes.

Quotes are bucketed by hour. A decision first looks in its own bucket, with a descending window
over (symbol, bucket); only if nothing follows there it takes the first quote of the next bucket
that has one, from a table of one row per bucket. So no task ever holds a whole series of quotes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

QUOTE = ("time", "source_seq", "bid", "ask")
BUCKET_SECONDS = 3600


def bucket(ts: Column) -> Column:
    return F.floor(F.unix_seconds(ts.cast("timestamp")) / BUCKET_SECONDS).cast("long")


def forward(left: DataFrame, ticks: DataFrame, at: str, name: str, strict: bool) -> DataFrame:
    """``left`` with a struct column ``name``: the first quote after ``at`` (or at it, if not strict).

    Ties go to the lowest ``source_seq``. Null where no quote follows. ``left`` needs ``symbol`` and
    unique ``signal_id``; extra columns are kept.
    """
    quote = F.struct(*QUOTE)
    rows = left.select("*", bucket(F.col(at)).alias("_bucket"))
    keyed = rows.select("symbol", "_bucket", "signal_id", F.col(at).alias("_at"))
    # rows come latest first, so of a tie the side that comes first is seen by the other
    own_rank, quote_rank = (0, 1) if strict else (1, 0)
    none = F.lit(None).cast(ticks.select(quote.alias("q")).schema["q"].dataType)
    both = keyed.select("symbol", "_bucket", "signal_id", F.col("_at").alias("_t"), F.lit(own_rank).alias("_rank"), F.lit(None).cast("long").alias("_seq"), none.alias("_q")).union(
        ticks.select("symbol", bucket(F.col("time")), F.lit(None).cast("string"), F.col("time"), F.lit(quote_rank), F.col("source_seq"), quote)
    )
    down = Window.partitionBy("symbol", "_bucket").orderBy(F.desc("_t"), "_rank", F.desc("_seq")).rowsBetween(Window.unboundedPreceding, -1)
    inside = both.select("signal_id", "symbol", F.last("_q", ignorenulls=True).over(down).alias("_inside")).filter("signal_id IS NOT NULL")
    firsts = ticks.groupBy("symbol", bucket(F.col("time")).alias("_bucket")).agg(F.min(quote).alias("_first"))
    buckets = firsts.unionByName(rows.select("symbol", "_bucket").distinct().withColumn("_first", none)).groupBy("symbol", "_bucket").agg(F.first("_first", ignorenulls=True).alias("_first"))
    later = Window.partitionBy("symbol").orderBy(F.desc("_bucket")).rowsBetween(Window.unboundedPreceding, -1)
    next_ = buckets.select("symbol", "_bucket", F.last("_first", ignorenulls=True).over(later).alias("_next"))
    out = rows.join(inside, ["symbol", "signal_id"], "left").join(next_, ["symbol", "_bucket"], "left")
    return out.withColumn(name, F.coalesce("_inside", "_next")).drop("_bucket", "_inside", "_next")


def entry_and_exit(decisions: DataFrame, ticks: DataFrame) -> DataFrame:
    """Decisions with ``entry`` (strictly after the decision) and ``exit`` (at or after the target)."""
    with_entry = forward(decisions, ticks, "decision_time", "entry", strict=True)
    return forward(with_entry, ticks, "target_time", "exit", strict=False)


def marks(positions: DataFrame, ticks: DataFrame, begin: str, end: str, columns: tuple[str, ...]) -> DataFrame:
    """Quotes joined with the positions that are open at them: begin <= (time, seq) <= end.

    ``begin`` and ``end`` are quote structs. Positions are spread over the hours that they touch, so
    the join is an equi-join on (symbol, hour) with the interval as a residual condition.
    """
    hours = F.explode(F.sequence(bucket(F.col(f"{begin}.time")), bucket(F.col(f"{end}.time"))))
    spread = positions.select("symbol", hours.alias("_bucket"), F.struct(*columns, begin, end).alias("p"))
    quotes = ticks.select("symbol", bucket(F.col("time")).alias("_bucket"), *QUOTE)
    key = lambda x: F.struct(F.col(f"{x}.time").alias("time"), F.col(f"{x}.source_seq").alias("source_seq"))
    own = F.struct("time", "source_seq")
    return quotes.join(spread, ["symbol", "_bucket"]).filter((own >= key(f"p.{begin}")) & (own <= key(f"p.{end}"))).drop("_bucket")
