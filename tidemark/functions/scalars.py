"""Column functions: missing values, decimals, UTC times, rollovers, trading arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PRICE = "decimal(18,8)"
UNITS = "decimal(12,2)"
MONEY = "decimal(20,8)"
CENTS = "decimal(20,2)"


def finite(x: Column) -> Column:
    """The double, or null if it is missing, NaN or infinite."""
    x = x.cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))), x)


def finite_text(x: Column) -> Column:
    """A double read from text that may be malformed; null if it is not finite."""
    return finite(x.try_cast("double"))


def divide(a: Column, b: Column) -> Column:
    return F.try_divide(a, b)


def seconds(later: Column, earlier: Column) -> Column:
    """Exact seconds between two timestamps."""
    return ((F.unix_micros(later.cast("timestamp")) - F.unix_micros(earlier.cast("timestamp"))) / F.lit(1000000)).cast("double")


def epoch_ms(ts: Column) -> Column:
    return F.unix_millis(ts.cast("timestamp"))


def from_epoch_ms(ms: Column) -> Column:
    return F.timestamp_millis(ms).cast("timestamp_ntz")


def floor_seconds(ms: Column) -> Column:
    """Whole seconds of epoch milliseconds, rounded down for negative ones too."""
    return F.floor(ms / F.lit(1000)).cast("long")


def monday_zero(ts: Column) -> Column:
    return F.weekday(ts)


def midnights_crossed(start: Column, end: Column) -> Column:
    return F.greatest(F.lit(0), F.datediff(F.to_date(end), F.to_date(start))).cast("long")


def entry_price(side: Column, bid: Column, ask: Column) -> Column:
    return F.when(side == "long", ask).otherwise(bid)


def exit_price(side: Column, bid: Column, ask: Column) -> Column:
    return F.when(side == "long", bid).otherwise(ask)


def direction(side: Column) -> Column:
    return F.when(side == "long", F.lit(1)).otherwise(F.lit(-1))


def liquidation(side: Column, entry: Column, bid: Column, ask: Column, units: Column) -> Column:
    """What closing the position at this quote gives, before costs."""
    move = F.when(side == "long", bid - entry).otherwise(entry - ask)
    return (move.cast(PRICE) * units.cast(UNITS)).cast("decimal(31,10)")


def cents(x: Column) -> Column:
    """Money in cents, half to even."""
    return F.bround(x, 2).cast(CENTS)


def rollover_weight(start: Column, end: Column, minutes: int, triple_weekday: int) -> Column:
    """Weekday rollovers in (start, end], the triple day's counted three times."""
    days = F.sequence(F.to_date(start), F.to_date(end), F.expr("interval 1 day"))
    at = lambda d: d.cast("timestamp_ntz") + F.expr(f"interval {minutes} minutes")
    hit = F.filter(days, lambda d: (F.weekday(d) < 5) & (at(d) > start) & (at(d) <= end))
    return F.aggregate(hit, F.lit(0), lambda n, d: n + F.when(F.weekday(d) == triple_weekday, 3).otherwise(1))


def rollover_count(start: Column, end: Column, minutes: int) -> Column:
    return rollover_weight(start, end, minutes, -1)
