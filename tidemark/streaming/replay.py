"""Streaming decision replay: one state machine per symbol over a merged stream of quotes and decisions.

Rows carry (symbol, time, kind, seq, bid, ask, signal_id, action); quotes have kind 0 and come before
decisions (kind 1) of the same time. State is one small record per symbol. A row that is earlier
than what its symbol has seen raises an error: late data is never dropped silently. The rows of a micro-batch are put in
order of time, but quotes carry their source's numbers, which must rise with it: so a row that came late within a batch, which
ordering would hide, is an error too, as is a source that numbers its quotes backwards.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from decimal import ROUND_HALF_EVEN, Decimal
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark import session
from tidemark.contracts import ContractError
from tidemark.functions import scalars as S
from tidemark.sinks.batches import BatchTable, drop, move

EVENTS = "symbol string, time_us long, seq long, event string, signal_id string, value decimal(20,2)"
STATE = (
    "last_us long, last_kind int, last_seq long, last_quote long, side string, signal_id string, entry_price string, target_us long, "
    "pending_id string, pending_side string, pending_us long, balance string"
)
#: Rows of a slice, which is a micro-batch, at most; and those of them that are Python objects at a time.
SLICE_ROWS, CHUNK_ROWS = 500_000, 10_000
_HOUR = 3_600_000_000
_UNITS = Decimal(100000)


class Machine:
    """The transition rules, free of Spark, over dict state; also the oracle of the batch fold."""

    def __init__(self, max_delay_us: int, state: dict[str, Any] | None = None, balance: str = "10000") -> None:
        self.max_delay_us = max_delay_us
        empty = dict.fromkeys(("last_us", "last_kind", "last_seq", "last_quote", "side", "signal_id", "entry_price", "target_us", "pending_id", "pending_side", "pending_us"))
        self.s = state or {**empty, "balance": balance}

    def feed(self, us: int, kind: int, seq: int, bid: Decimal | None, ask: Decimal | None, signal_id: str | None, action: str | None) -> Iterator[tuple[int, int, str, str, Decimal]]:
        s, here = self.s, (us, kind, seq)
        if s["last_us"] is not None and here <= (s["last_us"], s["last_kind"], s["last_seq"]):
            raise ContractError(f"row at {us} is late or out of order")
        s["last_us"], s["last_kind"], s["last_seq"] = here
        if kind == 0:
            if s["last_quote"] is not None and seq <= s["last_quote"]:
                raise ContractError(f"quote {seq} at {us} comes after quote {s['last_quote']}: it is late or out of order")
            s["last_quote"] = seq
            yield from self._quote(us, seq, bid, ask)
        else:
            self._decision(us, signal_id, action)

    def _decision(self, us: int, signal_id: str, action: str) -> None:
        s = self.s
        if s["pending_id"] is not None:
            raise ContractError(f"{signal_id} comes before {s['pending_id']} found a quote")
        if action != "ABSTAIN" and action != s["side"]:
            s["pending_id"], s["pending_side"], s["pending_us"] = signal_id, action, us

    def _worth(self, bid: Decimal, ask: Decimal) -> Decimal:
        entry = Decimal(self.s["entry_price"])
        return (bid - entry if self.s["side"] == "long" else entry - ask) * _UNITS

    def _quote(self, us: int, seq: int, bid: Decimal, ask: Decimal) -> Iterator[tuple[int, int, str, str, Decimal]]:
        s, cents = self.s, lambda x: x.quantize(Decimal("0.01"), ROUND_HALF_EVEN)
        if s["side"] and s["pending_id"] is not None:
            yield self._close(us, seq, "reversal", bid, ask)
            yield self._open(us, seq, bid, ask)
        elif s["side"] and us >= s["target_us"]:
            yield self._close(us, seq, "target", bid, ask)
        elif s["pending_id"] is not None:
            if us - s["pending_us"] > self.max_delay_us:
                s["pending_id"] = s["pending_side"] = s["pending_us"] = None
            else:
                yield self._open(us, seq, bid, ask)
        elif s["side"]:
            yield us, seq, "quote_mark", s["signal_id"], cents(Decimal(s["balance"]) + self._worth(bid, ask))

    def _close(self, us: int, seq: int, reason: str, bid: Decimal, ask: Decimal) -> tuple[int, int, str, str, Decimal]:
        s = self.s
        balance = Decimal(s["balance"]) + self._worth(bid, ask).quantize(Decimal("0.01"), ROUND_HALF_EVEN)
        out = (us, seq, reason, s["signal_id"], balance)
        s["balance"], s["side"], s["signal_id"] = str(balance), None, None
        return out

    def _open(self, us: int, seq: int, bid: Decimal, ask: Decimal) -> tuple[int, int, str, str, Decimal]:
        s = self.s
        s["side"], s["signal_id"], s["target_us"] = s["pending_side"], s["pending_id"], s["pending_us"] + _HOUR
        s["entry_price"] = str(ask if s["side"] == "long" else bid)
        s["pending_id"] = s["pending_side"] = s["pending_us"] = None
        value = (Decimal(s["balance"]) + self._worth(bid, ask)).quantize(Decimal("0.01"), ROUND_HALF_EVEN)
        return us, seq, "position_open_mark", s["signal_id"], value


_FIELDS = [x.split()[0] for x in STATE.split(", ")]
_ROW = ["time_us", "kind", "seq", "bid", "ask", "signal_id", "action"]
_PLACES, _NO_PRICE = 8, -(2**63)


def _whole(name: str) -> Column:
    """A price as a whole number of units of its last place."""
    return F.coalesce((F.col(name).cast(S.PRICE) * F.lit(10**_PLACES).cast("decimal(9,0)")).cast("long"), F.lit(_NO_PRICE)).alias(name)


def _price(whole: int) -> Decimal | None:
    return None if whole == _NO_PRICE else Decimal(whole).scaleb(-_PLACES)


def advance(machine: Machine, symbol: str, frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The equity rows that ``frames`` of a symbol's rows, with whole prices, add; in order of time, some at a time.

    The rows are held as numbers, and only CHUNK_ROWS of them and of what they add are Python objects.
    """
    held = pd.concat([f[_ROW] for f in frames], ignore_index=True)
    order = np.lexsort((held["seq"], held["kind"], held["time_us"]))
    for first in range(0, len(order), CHUNK_ROWS):
        out = []
        for us, kind, seq, bid, ask, signal_id, action in held.iloc[order[first : first + CHUNK_ROWS]].itertuples(index=False, name=None):
            out += [(symbol, *x) for x in machine.feed(int(us), int(kind), int(seq), _price(bid), _price(ask), signal_id, action)]
        yield pd.DataFrame(out, columns=["symbol", "time_us", "seq", "event", "signal_id", "value"])


def equity(rows: DataFrame, max_delay_seconds: int = 60) -> DataFrame:
    """A stream of equity rows out of the merged stream ``rows``.

    A task holds the rows that a micro-batch has for a symbol, so the source should bound its micro-batches.
    """
    limit = max_delay_seconds * 1_000_000

    def step(key: tuple[str], frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        machine = Machine(limit, dict(zip(_FIELDS, state.get, strict=True)) if state.exists else None)
        yield from advance(machine, key[0], frames)
        state.update(tuple(machine.s[f] for f in _FIELDS))

    rows = rows.select("symbol", "time_us", "kind", "seq", _whole("bid"), _whole("ask"), "signal_id", "action")
    return rows.groupBy("symbol").applyInPandasWithState(step, EVENTS, STATE, "append", GroupStateTimeout.NoTimeout)


def merged(decisions: DataFrame, ticks: DataFrame) -> DataFrame:
    """Quotes and decisions as the rows of one stream, without an order."""
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp")).alias("time_us")
    none = lambda kind: F.lit(None).cast(kind)
    quotes = ticks.select("symbol", micros("time"), F.lit(0).alias("kind"), F.col("source_seq").alias("seq"), "bid", "ask", none("string").alias("signal_id"), none("string").alias("action"))
    asked = decisions.select("symbol", micros("decision_time"), F.lit(1).alias("kind"), F.lit(0).cast("long").alias("seq"), none(S.PRICE).alias("bid"), none(S.PRICE).alias("ask"), "signal_id", "action")
    return quotes.union(asked)


def run_in_slices(decisions: DataFrame, ticks: DataFrame, max_delay_seconds: int, slices: int = 3) -> DataFrame:
    """The whole replay as a stream that is stopped and started again: equity rows, from a ``BatchTable``.

    The rows arrive in ``slices`` spans of the stream's order, or in more, so that none has above SLICE_ROWS rows. The stream takes
    each as a micro-batch; between them it ends and begins again from its checkpoint, state included. So what a task holds does
    not grow with a series; the number of micro-batches does. The stream's files lie in the shared folder and go at the end, but
    for the result's checkpoint.
    """
    spark = ticks.sparkSession
    home = f"{session.shared_folder(spark)}/replay-{uuid.uuid4().hex}"
    rows = merged(decisions, ticks).filter("time_us IS NOT NULL")
    rows.write.parquet(f"{home}/merged")
    rows = spark.read.schema(rows.schema).parquet(f"{home}/merged")
    n, symbols = rows.agg(F.count("*"), F.count_distinct("symbol")).first()
    table = BatchTable(spark, f"{home}/table", EVENTS)
    for names in _laid_out(rows, f"{home}/ranges", max(1, min(SLICE_ROWS, math.ceil(n / slices))), n) if n else ():
        move(spark, names, f"{home}/ranges", f"{home}/rows")
        with _shuffles(spark, 4 * symbols):
            stream = to_sink(spark.readStream.schema(rows.schema).parquet(f"{home}/rows"), table, f"{home}/checkpoint", max_delay_seconds, availableNow=True)
        stream.awaitTermination()
    result = session.checkpointed(table.read())
    drop(spark, home)
    return result


def _laid_out(rows: DataFrame, path: str, most: int, n: int) -> list[list[str]]:
    """Write ``rows`` as files that follow each other in the stream's order; their names in groups of at most ``most`` rows.

    Ranges are cut by a sample, so they are finer than the groups, which are made from the rows counted in each file.
    """
    order = ("time_us", "kind", "seq")
    rows.repartitionByRange(4 * math.ceil(n / most), *order).sortWithinPartitions(*order).write.parquet(path)
    files = rows.sparkSession.read.schema(rows.schema).parquet(path).groupBy(F.col("_metadata.file_name").alias("name")).count()
    groups, held = [[]], 0
    for name, count in sorted(tuple(r) for r in files.collect()):
        if held and held + count > most:
            groups, held = [*groups, []], 0
        groups[-1].append(name)
        held += count
    return groups


@contextmanager
def _shuffles(spark: SparkSession, most: int) -> Iterator[None]:
    """Fewer shuffle partitions for what starts within: a stream keeps a state store for each, and few symbols need few."""
    name = "spark.sql.shuffle.partitions"
    kept = spark.conf.get(name)
    spark.conf.set(name, str(max(1, min(int(kept), most))))
    try:
        yield
    finally:
        spark.conf.set(name, kept)


def to_sink(rows: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, max_delay_seconds: int = 60, **trigger: bool):
    """Start the replay with a callback that gets each micro-batch of equity rows and its number.

    With a checkpoint folder a restarted stream repeats a batch under the same number, so a sink that
    ignores numbers it has seen counts every row once.
    """
    writer = equity(rows, max_delay_seconds).writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(**trigger) if trigger else writer).start()
