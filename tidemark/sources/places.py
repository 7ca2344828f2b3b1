"""The place of a row in its files, and checks of the order in which files have their rows.

A scan reads a file in splits: pieces that begin at some byte, each within one task, whose rows come in the file's order. So
(file, block, at) orders rows as the files have them, where ``block`` is the split's first byte and ``at`` grows within a split.
Files follow each other by name.

An order check runs within the scan: it compares each value with the one before in its split and hands on, for each split and
rule, nothing but the first and the last value. These edges are merged by a scan over splits and then over files, so no row is
sorted or shuffled, and no task sees more than its splits. Nulls are passed over: a value is compared with the last one before it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark import session

PLACE = "struct<file: string, block: bigint, at: bigint>"


@dataclass(frozen=True)
class Rule:
    """``value`` (a long) must not be smaller than the one before it, or must be larger if ``strict``."""

    code: str
    value: Column
    strict: bool = False


def placed(scan: DataFrame) -> DataFrame:
    """A file scan with ``place``, which orders its rows as the files have them. Nothing may have moved rows before."""
    place = F.struct(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").cast("long").alias("block"), F.monotonically_increasing_id().alias("at")
    )
    return scan.select("*", place.alias("place"))


def splits(rows: DataFrame) -> DataFrame:
    """(file, block, first, n, offset) of every split: its first ``at``, its rows, and the rows before it."""
    each = rows.groupBy(F.col("place.file").alias("file"), F.col("place.block").alias("block")).agg(F.min("place.at").alias("first"), F.count("*").alias("n"))
    before = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    files = each.groupBy("file").agg(F.sum("n").alias("n"))
    files = files.select("file", before(Window.orderBy("file")).alias("_files"))  # a row a file
    inside = each.withColumn("_blocks", before(Window.partitionBy("file").orderBy("block")))
    return inside.join(files, "file").select("file", "block", "first", "n", (F.col("_files") + F.col("_blocks")).alias("offset"))


def numbered(rows: DataFrame, scan: DataFrame | None = None) -> DataFrame:
    """The rows with ``ingest``: 0, 1, 2 ... in the order of ``place``; counted over ``scan``, if rows are only some of it."""
    offsets = session.checkpointed(splits(scan or rows)).select(F.col("file").alias("_file"), F.col("block").alias("_block"), "first", "offset")
    joined = rows.join(offsets, (F.col("place.file") == F.col("_file")) & (F.col("place.block") == F.col("_block")))
    return joined.withColumn("ingest", F.col("offset") + F.col("place.at") - F.col("first")).drop("_file", "_block", "first", "offset")


def row_number(rows: DataFrame, place) -> int:
    """The ``ingest`` of one place."""
    at = F.struct(F.lit(place.file).alias("file"), F.lit(place.block).alias("block"), F.lit(place.at).alias("at"))
    return rows.filter(F.col("place") < at).count()


_SCANNED = "edge boolean, rule int, file string, block long, at long, value long, other long"


class _Scan:
    """The last value of every rule within a split; edges and broken rules come out as rows of _SCANNED."""

    def __init__(self, strict: list[bool]) -> None:
        self.strict, self.split, self.out = strict, None, []
        self.first: list[tuple[int, int] | None] = [None] * len(strict)
        self.last: list[int] = [0] * len(strict)

    def close(self) -> None:
        for rule, first in enumerate(self.first):
            if first:
                self.out.append((True, rule, *self.split, *first, self.last[rule]))
        self.first = [None] * len(self.strict)

    def rows(self, split: tuple[str, int], at: np.ndarray, values: list[tuple[np.ndarray, np.ndarray]]) -> None:
        if split != self.split:
            self.close()
            self.split = split
        for rule, (known, value) in enumerate(values):
            where, value = at[known], value[known]
            if not len(value):
                continue
            begins = self.first[rule] is None
            before = np.append(value[0] - 1 if begins else self.last[rule], value[:-1])
            for k in np.flatnonzero(value <= before if self.strict[rule] else value < before).tolist():
                if k or not begins:  # a split's first value waits for the split before
                    self.out.append((False, rule, *split, int(where[k]), int(value[k]), int(before[k])))
            if begins:
                self.first[rule] = int(where[0]), int(value[0])
            self.last[rule] = int(value[-1])


def _scanned(strict: list[bool]):
    names, types = zip(*[f.split() for f in _SCANNED.split(", ")], strict=True)
    arrow = {"boolean": pa.bool_(), "int": pa.int32(), "string": pa.string(), "long": pa.int64()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = _Scan(strict)

        def out() -> pa.RecordBatch:
            columns = list(zip(*scan.out, strict=True))
            scan.out.clear()
            return pa.record_batch([pa.array(c, arrow[t]) for c, t in zip(columns, types, strict=True)], list(names))

        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            file, block = batch.column("file").dictionary_encode(), batch.column("block").to_numpy()
            code, at = file.indices.to_numpy(), batch.column("at").to_numpy()
            columns = [batch.column(f"v{k}") for k in range(len(strict))]
            values = [(c.is_valid().to_numpy(zero_copy_only=False), c.fill_null(0).to_numpy()) for c in columns]
            cuts = [0, *(np.flatnonzero((code[1:] != code[:-1]) | (block[1:] != block[:-1])) + 1).tolist(), n]
            for a, b in zip(cuts, cuts[1:], strict=False):
                scan.rows((file.dictionary[int(code[a])].as_py(), int(block[a])), at[a:b], [(known[a:b], value[a:b]) for known, value in values])
            if len(scan.out) > 1 << 13:
                yield out()
        scan.close()
        if scan.out:
            yield out()

    return run


def order_issues(rows: DataFrame, *rules: Rule) -> DataFrame:
    """(place, code, value, prior) of every value that breaks a rule against the last known value before it.

    ``rows`` come from ``placed``, without a shuffle between. Nulls are neither broken nor compared with; an empty file, an
    empty split and one with nulls only change nothing.
    """
    columns = [F.col(f"place.{c}").alias(c) for c in ("file", "block", "at")] + [r.value.cast("long").alias(f"v{k}") for k, r in enumerate(rules)]
    found = session.checkpointed(rows.select(*columns).mapInArrow(_scanned([r.strict for r in rules]), _SCANNED))  # broken rules and edges
    edges = found.filter("edge").select("rule", "file", "block", "at", F.col("value").alias("first"), F.col("other").alias("last"))
    inside = edges.withColumn("prior", F.lag("last").over(Window.partitionBy("rule", "file").orderBy("block")))
    # one row a file and rule: its first split has nothing before it but the last file that has values
    files = edges.groupBy("rule", "file").agg(F.min(F.struct("block", "at", "first")).alias("x"), F.max_by("last", "block").alias("last"))
    files = files.withColumn("prior", F.lag("last").over(Window.partitionBy("rule").orderBy("file")))
    names = ("rule", "file", "block", "at", "value", "prior")
    borders = inside.select("rule", "file", "block", "at", "first", "prior").union(files.select("rule", "file", "x.block", "x.at", "x.first", "prior")).filter("prior IS NOT NULL").toDF(*names)
    strict = F.array(*[F.lit(r.strict) for r in rules])[F.col("rule")]
    borders = borders.filter(F.when(strict, F.col("value") <= F.col("prior")).otherwise(F.col("value") < F.col("prior")))
    every = found.filter("NOT edge").select("rule", "file", "block", "at", "value", "other").toDF(*names).union(borders)
    code = F.array(*[F.lit(r.code) for r in rules])[F.col("rule")]
    return every.select(F.struct("file", "block", "at").alias("place"), code.alias("code"), "value", "prior")
