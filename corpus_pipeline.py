"""A corpus pipeline over ``documents``: quality rules, line, near and substring dedup, packing.

Each stage takes what its predecessor kept and is written and read again before the next one, so
a stage that loses an executor repeats its own work only. All but the last return the columns of
``documents``; ``n_chars`` follows the text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import session
from tidemark.llm import common, linededup, packing, quality, queries, simhash, substring

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
_CARRY = ("lang", "source")


def _documents(df: DataFrame) -> DataFrame:
    """The edited text (column ``kept``) in the columns of ``documents``."""
    return df.withColumn("text", F.col("kept")).withColumn("n_chars", F.length("kept").cast("long")).select(*COLUMNS)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the standard policy keeps; a null text has no words and goes."""
    ledger = quality.measure(docs, carry=COLUMNS[1:])
    return quality.apply_policy(ledger, quality.STANDARD).filter("kept").select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without lines that three or more documents hold, but for the last of these; a null text becomes empty."""
    return _documents(linededup.line_dedup(docs, carry=_CARRY))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each component of Jaccard similarity 0.8 over five words.

    Rows that share an id go together; a null id is the smallest; texts without words are alike.
    """
    session.ship(spark)
    found = simhash.similar(docs)
    stay = found.filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("_id")).distinct()
    return docs.join(stay, F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi").select(*COLUMNS)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without word windows that also start earlier; one that loses all its words stays, empty."""
    return _documents(substring.substring_dedup(docs, layout="text", carry=_CARRY))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences; ``ids`` is the base64 text of little-endian unsigned 32-bit ids."""
    session.ship(spark)
    pieces = packing.pack(docs, queries.BYTE_BPE, queries.BYTE_RANKS)
    return pieces.withColumn("ids_crc32", F.crc32("ids")).withColumn("ids", F.base64("ids"))


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("packing", pack),
]

#: Tokenizing and packing have no SQL; the tests hold run() against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what is between two stages is written in the shared folder.

    A table goes as soon as the next one is written; the last one stays, as the result reads it. Empty
    ``documents`` give an empty result.
    """
    session.ship(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES[:-1]):
        done, docs = docs, common.stored(stage(spark, docs, sf_dir))
        if number:
            common.forget(done)
    return STAGES[-1][1](spark, docs, sf_dir)
