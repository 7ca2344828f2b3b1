"""CSV sources: read as text, coerced with counted failures, checked, and only then typed.

Some rules look at the order of a file's rows, which ``places`` keeps through any number of splits and files. A quote's
number is its ``source_row_seq`` where there is such a column, else its place, counted from 0.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.contracts import ContractError, naive
from tidemark.functions import scalars as S
from tidemark.operators import bars
from tidemark.sources import places

_UTC_TEXT = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?(Z|[+]00:00)$"


def raw(spark: SparkSession, path: str, required: tuple[str, ...]) -> DataFrame:
    """All columns as text, and ``place``."""
    df = spark.read.option("header", True).option("mode", "FAILFAST").csv(path)
    absent = [c for c in required if c not in df.columns]
    if absent:
        raise ContractError(f"{path}: missing columns {', '.join(absent)}")
    return places.placed(df)


def utc_text(c: Column) -> Column:
    """A naive UTC timestamp out of ISO text that says that it is UTC; null otherwise."""
    c = F.trim(c)
    plain = F.regexp_replace(F.regexp_replace(c, r"(Z|[+]00:00)$", ""), "T", " ")
    return F.when(c.rlike(_UTC_TEXT), plain.try_cast("timestamp_ntz"))


def integer_text(c: Column) -> Column:
    return F.when(F.trim(c).rlike(r"^-?\d{1,18}$"), F.trim(c).try_cast("long"))


def refuse(df: DataFrame, *more: DataFrame, **rules: Column) -> None:
    """Raise with the first row, in the order of ``place``, that breaks a rule or is among ``more`` (place, code)."""
    code = F.lit(None).cast("string")
    for name, bad in reversed(rules.items()):
        code = F.when(F.coalesce(bad, F.lit(False)), name).otherwise(code)
    found = df.select("place", code.alias("code")).filter("code IS NOT NULL")
    for other in more:
        found = found.union(other.select("place", "code"))
    first = found.agg(F.min(F.struct("place", "code")).alias("x")).first().x
    if first:
        raise ContractError(f"row {places.row_number(df, first.place)} of {first.place.file}: {first.code}")


def _micros(c: str) -> Column:
    return F.unix_micros(F.col(c).cast("timestamp"))


def snapshot(spark: SparkSession, path: str, symbol: str) -> DataFrame:
    """Accepted hourly bars: validated, typed, never repaired."""
    rows = places.numbered(raw(spark, path, bars.REQUIRED))
    typed = rows.select(
        F.lit(symbol).alias("symbol"), utc_text(F.col("timestamp")).alias("timestamp"), *[S.finite_text(F.col(c)).alias(c) for c in bars.NUMERIC], "ingest"
    )
    bars.validate_snapshot(typed, "ingest")
    return typed.drop("ingest")


def raw_bars(spark: SparkSession, path: str, symbol: str) -> DataFrame:
    """Bars as they came, coerced, with bad values null; the gate decides what becomes of them."""
    rows = places.numbered(raw(spark, path, bars.REQUIRED))
    return rows.select(F.lit(symbol).alias("symbol"), utc_text(F.col("timestamp")).alias("timestamp"), *[S.finite_text(F.col(c)).alias(c) for c in bars.NUMERIC], "ingest")


def decisions(spark: SparkSession, path: str, start: datetime, end: datetime, symbol: str = "") -> DataFrame:
    """Decisions: unique non-empty ids, strictly increasing times in [start, end), known actions."""
    rows = raw(spark, path, ("signal_id", "decision_time_utc", "action")).withColumn("decision_time", utc_text(F.col("decision_time_utc")))
    low, high = (F.lit(naive(x)).cast("timestamp_ntz") for x in (start, end))
    at = F.col("decision_time")
    repeated = rows.groupBy("signal_id").agg(F.count("*").alias("n"), F.min("place").alias("place")).filter("n > 1").select("place", F.lit("bad_id").alias("code"))
    refuse(
        rows,
        repeated,
        places.order_issues(rows, places.Rule("not_chronological", _micros("decision_time"), strict=True)),
        bad_id=F.col("signal_id").isNull() | (F.trim("signal_id") == ""),
        bad_time=at.isNull(),
        outside_period=(at < low) | (at >= high),
        bad_action=F.col("action").isNull() | ~F.trim("action").isin("long", "short", "ABSTAIN"),
    )
    out = rows.select(F.lit(symbol).alias("symbol"), F.trim("signal_id").alias("signal_id"), "decision_time", F.trim("action").alias("action"))
    if out.first() is None:
        raise ContractError("there are no decisions")
    return out


def _steps_back(typed: DataFrame, given: bool) -> DataFrame:
    rules = [places.Rule("step_back", F.col("ms"))]
    if given:
        rules.append(places.Rule("step_back", F.col("source_seq"), strict=True))
    return places.order_issues(typed, *rules)


def _numbered(typed: DataFrame, given: bool) -> DataFrame:
    return typed if given else places.numbered(typed).withColumn("source_seq", F.col("ingest"))


def ticks(spark: SparkSession, path: str, start: datetime, end: datetime, symbol: str = "") -> DataFrame:
    """Quotes: whole milliseconds in [start, end), no step back, increasing numbers, 0 < bid <= ask."""
    rows = raw(spark, path, ("time_msc", "bid", "ask"))
    given = "source_row_seq" in rows.columns
    seq = integer_text(F.col("source_row_seq")) if given else F.lit(0).cast("long")
    price = lambda c: F.when(S.finite_text(F.col(c)).isNotNull(), F.col(c).try_cast(S.PRICE))
    flags = F.coalesce(integer_text(F.col("flags")), F.lit(0)) if "flags" in rows.columns else F.lit(0)
    typed = rows.select("place", integer_text(F.col("time_msc")).alias("ms"), seq.alias("source_seq"), price("bid").alias("bid"), price("ask").alias("ask"), flags.cast("int").alias("flags"))
    low, high = (int(x.timestamp() * 1000) for x in (start, end))
    refuse(
        typed,
        _steps_back(typed, given),
        bad_number=F.col("ms").isNull() | F.col("source_seq").isNull(),
        outside_period=(F.col("ms") < low) | (F.col("ms") >= high),
        bad_quote=F.col("bid").isNull() | F.col("ask").isNull() | (F.col("bid") <= 0) | (F.col("ask") < F.col("bid")),
    )
    return _numbered(typed, given).select(F.lit(symbol).alias("symbol"), "source_seq", S.from_epoch_ms(F.col("ms")).alias("time"), "bid", "ask", "flags")


def terminal_ticks(spark: SparkSession, path: str, symbol: str = "") -> DataFrame:
    """Quotes of the older export: seconds and milliseconds must agree, unused numbers must be numbers."""
    names = ("time", "time_msc", "bid", "ask", "last", "flags", "volume", "volume_real")
    rows = raw(spark, path, names)
    given = "source_row_seq" in rows.columns
    seq = integer_text(F.col("source_row_seq")) if given else F.lit(0).cast("long")
    typed = rows.select(
        "place", integer_text(F.col("time")).alias("s"), integer_text(F.col("time_msc")).alias("ms"), seq.alias("source_seq"),
        *[F.col(c).try_cast(S.PRICE).alias(c) for c in ("bid", "ask")], integer_text(F.col("flags")).alias("flags"),
        F.greatest(*[S.finite_text(F.col(c)).isNull().cast("int") for c in ("last", "volume", "volume_real")]).alias("_bad"),
    )
    refuse(
        typed,
        _steps_back(typed, given),
        bad_number=F.col("s").isNull() | F.col("ms").isNull() | F.col("source_seq").isNull() | F.col("flags").isNull() | (F.col("_bad") == 1),
        seconds_disagree=F.col("s") != S.floor_seconds(F.col("ms")),
        bad_quote=F.col("bid").isNull() | F.col("ask").isNull() | (F.col("bid") <= 0) | (F.col("ask") < F.col("bid")),
    )
    return _numbered(typed, given).select(F.lit(symbol).alias("symbol"), "source_seq", S.from_epoch_ms(F.col("ms")).alias("time"), "bid", "ask", F.col("flags").cast("int").alias("flags"))


def frozen_predictions(
    spark: SparkSession, path: str, model_sha256: str, partition: str = "final_confirmation", lower: str = "0.45", upper: str = "0.55", symbol: str = ""
) -> tuple[DataFrame, DataFrame]:
    """Signals of one partition, checked against the model hash and thresholds, and an audit row."""
    score = "B2_raw_probability_up_not_calibrated"
    names = ("decision_timestamp", "target_available_timestamp", "partition", "candidate_signal", score, "target_h1_direction", "model_sha256")
    rows = raw(spark, path, names).filter(F.col("partition") == partition)
    p, low, high = F.col(score).try_cast("decimal(20,18)"), F.lit(lower).cast("decimal(20,18)"), F.lit(upper).cast("decimal(20,18)")
    typed = rows.select(
        "place", utc_text(F.col("decision_timestamp")).alias("decision_time"), utc_text(F.col("target_available_timestamp")).alias("target_time"),
        p.alias("p_up"), F.trim("candidate_signal").alias("candidate"), F.trim("target_h1_direction").alias("target_label"), F.trim("model_sha256").alias("model"),
    )
    derived = F.when(F.col("p_up") <= low, "DOWN").when(F.col("p_up") >= high, "UP").otherwise("ABSTAIN")
    refuse(
        typed,
        places.order_issues(typed, places.Rule("not_chronological", _micros("decision_time"), strict=True)),
        wrong_model=F.col("model").isNull() | (F.col("model") != model_sha256),
        bad_value=F.col("decision_time").isNull() | F.col("target_time").isNull() | F.col("p_up").isNull() | (F.col("p_up") < 0) | (F.col("p_up") > 1),
        wrong_signal=derived != F.col("candidate"),
        wrong_target=F.col("target_time") != F.col("decision_time") + F.expr("interval 1 hour"),
    )
    audit = typed.agg(F.count("*").alias("rows"), F.count_if(F.col("candidate") == "ABSTAIN").alias("abstained"), F.min("decision_time").alias("first"), F.max("decision_time").alias("last"))
    side = F.when(F.col("candidate") == "UP", "long").otherwise("short")
    signals = typed.filter("candidate <> 'ABSTAIN'").select(
        F.lit(symbol).alias("symbol"), F.concat(F.lit("s"), F.date_format("decision_time", "yyyyMMddHH")).alias("signal_id"), "decision_time", "target_time", "p_up", "target_label", side.alias("side")
    )
    return signals, audit
