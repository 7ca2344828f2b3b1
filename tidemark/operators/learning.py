"""Learning matrix, chronological split with label purging, baselines and their metrics."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark import session
from tidemark.contracts import ContractError
from tidemark.functions import scalars as S
from tidemark.operators import features as feature_ops
from tidemark.operators import ranks
from tidemark.operators import target as target_ops

BINARY = ("DOWN", "UP")


def matrix(bars: DataFrame, selected: tuple[str, ...] = feature_ops.SELECTED) -> DataFrame:
    """Targets and features of the same bars, with flags for the binary label and complete features."""
    labels = target_ops.direction(bars)
    features = feature_ops.build(bars).withColumnRenamed("timestamp", "decision_timestamp")
    joined = labels.join(features, ["symbol", "decision_timestamp"])
    complete = F.lit(True)
    for c in selected:
        complete = complete & S.finite(F.col(c)).isNotNull()
    return joined.select(
        "symbol",
        "decision_timestamp",
        "target_timestamp",
        "target_h1_direction",
        *selected,
        F.coalesce(F.col("target_h1_direction").isin(*BINARY), F.lit(False)).alias("is_binary"),
        complete.alias("is_complete"),
    )


def samples(matrix_: DataFrame) -> DataFrame:
    return matrix_.filter("is_binary AND is_complete").drop("is_binary", "is_complete")


def accounting(matrix_: DataFrame) -> DataFrame:
    return matrix_.groupBy("symbol").agg(
        F.count("*").alias("market_rows"),
        F.count_if("is_binary").alias("binary_rows"),
        F.count_if(F.col("is_binary") & ~F.col("is_complete")).alias("incomplete_rows"),
        F.count_if(F.col("is_binary") & F.col("is_complete")).alias("sample_rows"),
    )


@dataclass(frozen=True)
class Fractions:
    train: float = 0.6
    validation: float = 0.2

    def __post_init__(self) -> None:
        if not (0 < self.train < 1 and 0 < self.validation < 1 and self.train + self.validation < 1):
            raise ContractError("fractions must leave rows for all three partitions")


def split(rows: DataFrame, fractions: Fractions = Fractions()) -> DataFrame:  # noqa: B008
    """Samples with ``partition``: train, validation, test, or purged (a label reaches over a boundary).

    Boundaries are the rows at int(n * fraction) in time order, computed in double arithmetic.
    """
    rows = session.checkpointed(rows)
    numbered = ranks.ranked(rows.select("symbol", "decision_timestamp"), "decision_timestamp", "_k", "_n")
    at = lambda share: F.floor(F.col("_n").cast("double") * F.lit(share)).cast("long")
    begin = lambda share: F.max(F.when(F.col("_k") == at(share), F.col("decision_timestamp")))
    begins = numbered.groupBy("symbol").agg(begin(fractions.train).alias("validation_start"), begin(fractions.train + fractions.validation).alias("test_start"))
    out = rows.join(begins, "symbol")  # a row a series
    decision, target = F.col("decision_timestamp"), F.col("target_timestamp")
    partition = (
        F.when(decision < F.col("validation_start"), F.when(target < F.col("validation_start"), "train").otherwise("purged_train"))
        .when(decision < F.col("test_start"), F.when(target < F.col("test_start"), "validation").otherwise("purged_validation"))
        .otherwise("test")
    )
    return out.withColumn("partition", partition)


def check_split(parts: DataFrame, least: int = 10) -> DataFrame:
    """The split, or an error if a series is too short or a partition is empty."""
    bad = (
        parts.groupBy("symbol")
        .agg(F.count("*").alias("n"), *[F.count_if(F.col("partition") == p).alias(p) for p in ("train", "validation", "test")])
        .filter((F.col("n") < least) | (F.col("train") == 0) | (F.col("validation") == 0) | (F.col("test") == 0))
        .first()
    )
    if bad:
        raise ContractError(f"{bad.symbol}: {bad.n} samples cannot be split")
    return parts


def majority(parts: DataFrame) -> DataFrame:
    """(symbol, majority_label): the commonest training label, ties to the smaller one."""
    counts = parts.filter("partition = 'train'").groupBy("symbol", "target_h1_direction").agg(F.count("*").alias("n"))
    best = F.min(F.struct((-F.col("n")).alias("order"), "target_h1_direction"))
    return counts.groupBy("symbol").agg(best["target_h1_direction"].alias("majority_label"))


def persistence(last_return: Column, fallback: Column) -> Column:
    return F.when(last_return > 0, "UP").when(last_return < 0, "DOWN").otherwise(fallback)


def predictions(parts: DataFrame) -> DataFrame:
    """Train and validation rows with the majority (B0) and persistence (B1) predictions."""
    rows = parts.filter(F.col("partition").isin("train", "validation"))
    return rows.join(majority(parts), "symbol").select(
        "symbol",
        "decision_timestamp",
        "partition",
        F.col("target_h1_direction").alias("truth"),
        F.col("majority_label").alias("b0_majority"),
        persistence(F.col("return_1h"), F.col("majority_label")).alias("b1_persistence"),
    )


def metrics(rows: DataFrame, truth: str, predicted: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Confusion counts, accuracy, balanced accuracy and Matthews' coefficient from one aggregation."""
    t, p = F.col(truth), F.col(predicted)
    counts = rows.groupBy(*by).agg(
        F.count_if((t == "DOWN") & (p == "DOWN")).alias("tn"),
        F.count_if((t == "DOWN") & (p == "UP")).alias("fp"),
        F.count_if((t == "UP") & (p == "DOWN")).alias("fn"),
        F.count_if((t == "UP") & (p == "UP")).alias("tp"),
    )
    tn, fp, fn, tp = (F.col(c).cast("double") for c in ("tn", "fp", "fn", "tp"))
    down, up = F.try_divide(tn, tn + fp), F.try_divide(tp, tp + fn)
    present = F.when(down.isNotNull(), 1).otherwise(0) + F.when(up.isNotNull(), 1).otherwise(0)
    below = F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))
    return counts.withColumns(
        {
            "accuracy": F.try_divide(tn + tp, tn + fp + fn + tp),
            "balanced_accuracy": F.try_divide(F.coalesce(down, F.lit(0.0)) + F.coalesce(up, F.lit(0.0)), present),
            "mcc": F.coalesce(F.try_divide(tp * tn - fp * fn, below), F.lit(0.0)),
        }
    )


def baseline_metrics(parts: DataFrame) -> DataFrame:
    predicted = predictions(parts)
    each = [metrics(predicted, "truth", c, ("symbol", "partition")).withColumn("model", F.lit(c)) for c in ("b0_majority", "b1_persistence")]
    return each[0].unionByName(each[1])


def logistic(parts: DataFrame, selected: tuple[str, ...] = feature_ops.SELECTED, c: float = 1.0, max_iter: int = 1000):
    """B2: an L2 logistic model of the training rows of one series, on population-standardised inputs.

    Returns a function that adds ``b2_logistic`` to rows. sklearn's C corresponds to a penalty of
    1 / (C n) on the mean loss.
    """
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    train = parts.filter("partition = 'train'")
    stats = train.agg(
        F.count("*").alias("n"), F.count_distinct("target_h1_direction").alias("classes"), *[F.avg(x).alias(f"m_{x}") for x in selected], *[F.stddev_pop(x).alias(f"s_{x}") for x in selected]
    ).first()
    if stats.classes != 2:
        raise ContractError("a logistic model needs both classes")

    def assembled(rows: DataFrame) -> DataFrame:
        scaled = rows.select("*", *[((F.col(x) - stats[f"m_{x}"]) / (stats[f"s_{x}"] or 1.0)).alias(f"z_{x}") for x in selected])
        out = VectorAssembler(inputCols=[f"z_{x}" for x in selected], outputCol="inputs").transform(scaled)
        return out.drop(*[f"z_{x}" for x in selected]).withColumn("label", (F.col("target_h1_direction") == "UP").cast("double"))

    model = LogisticRegression(featuresCol="inputs", labelCol="label", maxIter=max_iter, regParam=1.0 / (c * stats.n), elasticNetParam=0.0, standardization=False, tol=1e-9).fit(assembled(train))

    def predict(rows: DataFrame) -> DataFrame:
        label = F.when(F.col("prediction") == 1.0, "UP").otherwise("DOWN")
        return model.transform(assembled(rows)).withColumn("b2_logistic", label).drop("inputs", "label", "rawPrediction", "probability", "prediction")

    return predict
