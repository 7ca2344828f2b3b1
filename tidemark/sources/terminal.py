"""The terminal as a protocol: bars, deals and ticks come from any object with these methods.

``None`` from a terminal is an error; an empty answer is valid. The account must be a demo one, and
is checked before any history is asked for. A connection is always shut down.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime
from typing import Any, Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.contracts import AccountScope, ContractError, naive, utc
from tidemark.functions import scalars as S


class Terminal(Protocol):
    def initialize(self) -> bool: ...
    def shutdown(self) -> None: ...
    def account(self) -> dict[str, Any] | None: ...
    def bars(self, symbol: str, start: datetime, end: datetime) -> Sequence[dict[str, Any]] | None: ...
    def deals(self, start: datetime, end: datetime) -> Sequence[dict[str, Any]] | None: ...
    def ticks(self, symbol: str, start: datetime, end: datetime) -> Sequence[dict[str, Any]] | None: ...
    def last_error(self) -> str: ...


BARS = "time long, open double, high double, low double, close double, tick_volume long, spread long, real_volume long"
DEALS = "ticket long, time long, time_msc long, type int, entry int, symbol string, profit decimal(20,8), commission decimal(20,8), swap decimal(20,8), fee decimal(20,8)"
TICKS = "time_msc long, bid decimal(18,8), ask decimal(18,8), flags int"


def required(answer: Sequence[dict[str, Any]] | None, terminal: Terminal) -> list[dict[str, Any]]:
    if answer is None:
        raise ContractError(f"the terminal failed: {terminal.last_error()}")
    return list(answer)


class connected:  # noqa: N801
    """``with connected(terminal):`` initialises, and shuts down whatever happens."""

    def __init__(self, terminal: Terminal) -> None:
        self.terminal = terminal

    def __enter__(self) -> Terminal:
        if not self.terminal.initialize():
            self.terminal.shutdown()
            raise ContractError(f"the terminal cannot be reached: {self.terminal.last_error()}")
        return self.terminal

    def __exit__(self, *_: object) -> None:
        self.terminal.shutdown()


def _frame(spark: SparkSession, rows: list[dict[str, Any]], schema: str) -> DataFrame:
    names = [x.split()[0] for x in schema.replace("decimal(20,8)", "d").replace("decimal(18,8)", "d").split(", ")]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], schema)


def fetch_bars(spark: SparkSession, terminal: Terminal, symbol: str, start: datetime, end: datetime) -> DataFrame:
    with connected(terminal) as t:
        rows = required(t.bars(symbol, utc(start, "start"), utc(end, "end")), t)
    out = _frame(spark, rows, BARS)
    return out.select(F.lit(symbol).alias("symbol"), F.timestamp_seconds("time").cast("timestamp_ntz").alias("timestamp"), *out.columns[1:])


def scope_of(account: dict[str, Any] | None) -> AccountScope:
    if not account:
        raise ContractError("there is no account")
    known = {k: str(account[k]) for k in ("login", "server", "scope_id", "currency", "trade_mode") if k in account}
    return AccountScope(**known)


def fetch_demo_deals(
    spark: SparkSession, terminal: Terminal, start: datetime, end: datetime, login: str | None = None, server: str | None = None
) -> tuple[DataFrame, AccountScope]:
    with connected(terminal) as t:
        scope = scope_of(t.account())
        if (login and scope.login != login) or (server and scope.server != server):
            raise ContractError("the terminal is logged in to another account")
        rows = required(t.deals(utc(start, "start"), utc(end, "end")), t)
    return _frame(spark, rows, DEALS), scope


def fetch_ticks(spark: SparkSession, terminal: Terminal, symbol: str, start: datetime, end: datetime) -> DataFrame:
    """Quotes in [start, end) with their number in the whole answer; repeated ones stay, a step back is an error."""
    with connected(terminal) as t:
        rows = required(t.ticks(symbol, utc(start, "start"), utc(end, "end")), t)
    times = [r["time_msc"] for r in rows]
    if any(b < a for a, b in zip(times, times[1:], strict=False)):
        raise ContractError("the terminal's quotes step back in time")
    out = _frame(spark, [r | {"source_seq": k} for k, r in enumerate(rows)], TICKS + ", source_seq long")
    at = S.from_epoch_ms(F.col("time_msc"))
    low, high = (F.lit(naive(utc(x, "bound"))).cast("timestamp_ntz") for x in (start, end))
    return out.select(F.lit(symbol).alias("symbol"), "source_seq", at.alias("time"), "bid", "ask", "flags").filter((F.col("time") >= low) & (F.col("time") < high))
