"""Requests, scopes and replay settings: small immutable records, checked when they are made."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import datetime, timedelta, timezone
from decimal import Decimal

UTC = timezone.utc
HOUR = timedelta(hours=1)


class ContractError(ValueError):
    """An input breaks its contract."""


def utc(value: datetime, name: str, strict: bool = False) -> datetime:
    """An aware datetime in UTC; ``strict`` accepts a zero offset only."""
    if not isinstance(value, datetime) or value.tzinfo is None:
        raise ContractError(f"{name} needs a time zone")
    if strict and value.utcoffset() != timedelta(0):
        raise ContractError(f"{name} must be in UTC")
    return value.astimezone(UTC)


def naive(value: datetime) -> datetime:
    """The same UTC instant without a zone, as Spark's TIMESTAMP_NTZ literals take it."""
    return value.astimezone(UTC).replace(tzinfo=None)


@dataclass(frozen=True)
class BarRequest:
    """A half-open range [start, end) of hourly bars as known at ``cutoff``."""

    symbol: str
    start: datetime
    end: datetime
    cutoff: datetime
    timeframe: str = "H1"

    def __post_init__(self) -> None:
        if not self.symbol.strip():
            raise ContractError("symbol is empty")
        if self.timeframe != "H1":
            raise ContractError("only H1 is supported")
        for name in ("start", "end", "cutoff"):
            object.__setattr__(self, name, utc(getattr(self, name), name))
        for name in ("start", "end"):
            at = getattr(self, name)
            if at.minute or at.second or at.microsecond:
                raise ContractError(f"{name} must lie on an hour")
        if self.start >= self.end:
            raise ContractError("start must come before end")
        if self.cutoff <= self.start:
            raise ContractError("cutoff must come after start")

    @property
    def last_required_open(self) -> datetime | None:
        """The begin of the last bar that must be there, or None."""
        floor = self.cutoff.replace(minute=0, second=0, microsecond=0)
        last = min(self.end, floor) - HOUR
        return last if last >= self.start else None

    def as_dict(self) -> dict[str, str]:
        return {k: (v.isoformat() if isinstance(v, datetime) else v) for k, v in self.__dict__.items()}


@dataclass(frozen=True)
class AccountScope:
    """The demo account that deals must belong to."""

    login: str
    server: str
    scope_id: str = ""
    currency: str = "USD"
    trade_mode: str = "demo"

    def __post_init__(self) -> None:
        if not self.login or not self.server:
            raise ContractError("an account scope needs a login and a server")
        if self.trade_mode != "demo":
            raise ContractError("only demo accounts are accepted")


@dataclass(frozen=True)
class SignalReplay:
    """Settings of the per-signal replay (entry and exit quotes, explicit costs, swaps)."""

    starting_balance: Decimal = Decimal("10000")
    base_units: Decimal = Decimal("100000")
    pip_size: Decimal = Decimal("0.0001")
    model_sha256: str = "0" * 64
    lower_threshold: Decimal = Decimal("0.45")
    upper_threshold: Decimal = Decimal("0.55")
    max_entry_delay: int = 60
    max_exit_delay: int = 60
    commission_per_100k_side: Decimal = Decimal("3.5")
    fee_per_100k_side: Decimal = Decimal("0.25")
    tax_per_round_turn: Decimal = Decimal("0")
    slippage_pips_side: Decimal = Decimal("0.1")
    swap_per_100k_long: Decimal = Decimal("7.2")
    swap_per_100k_short: Decimal = Decimal("-2.4")
    rollover_time: str = "22:00"
    triple_weekday: int = 2
    period_start: datetime | None = None
    period_end: datetime | None = None

    def __post_init__(self) -> None:
        if min(self.starting_balance, self.base_units, self.pip_size) <= 0:
            raise ContractError("balance, units and pip size must be positive")
        if not 0 < self.lower_threshold < self.upper_threshold < 1:
            raise ContractError("thresholds must satisfy 0 < lower < upper < 1")
        if min(self.commission_per_100k_side, self.fee_per_100k_side, self.tax_per_round_turn, self.slippage_pips_side) < 0:
            raise ContractError("costs must not be negative")
        if min(self.max_entry_delay, self.max_exit_delay) < 0:
            raise ContractError("delays must not be negative")
        if len(self.model_sha256) != 64:
            raise ContractError("the model hash has 64 digits")
        hour, _, minute = self.rollover_time.partition(":")
        if not (hour.isdigit() and minute.isdigit() and int(hour) < 24 and int(minute) < 60):
            raise ContractError("rollover_time is HH:MM")
        if not 0 <= self.triple_weekday <= 6:
            raise ContractError("triple_weekday counts from Monday 0")
        if self.period_start and self.period_end and self.period_start >= self.period_end:
            raise ContractError("the period must not be empty")

    @property
    def rollover_minutes(self) -> int:
        hour, _, minute = self.rollover_time.partition(":")
        return 60 * int(hour) + int(minute)

    @property
    def round_turn_costs(self) -> dict[str, Decimal]:
        scale = self.base_units / 100000
        return {
            "slippage": 2 * self.base_units * self.pip_size * self.slippage_pips_side,
            "commission": 2 * self.commission_per_100k_side * scale,
            "fee": 2 * self.fee_per_100k_side * scale,
            "tax": self.tax_per_round_turn,
        }


@dataclass(frozen=True)
class DecisionReplay:
    """Settings of the single-position decision replay; all but the period and the delay are fixed."""

    period_start: datetime
    period_end: datetime
    max_entry_delay: int = 60
    starting_balance: Decimal = field(default=Decimal("10000"), init=False)
    base_units: Decimal = field(default=Decimal("100000"), init=False)
    leverage: int = field(default=200, init=False)

    def __post_init__(self) -> None:
        if utc(self.period_start, "period_start", strict=True) >= utc(self.period_end, "period_end", strict=True):
            raise ContractError("the period must not be empty")
        if self.max_entry_delay < 0:
            raise ContractError("max_entry_delay must not be negative")
