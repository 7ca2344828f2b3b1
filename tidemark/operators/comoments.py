"""Pearson correlations of all pairs of columns from mergeable co-moments.

A batch of rows becomes matrices: with its values shifted by their means and a mask of what is present, products of those give, for
every pair of columns, the number of rows that have both, their means, and the sums of squares and products about these. Two such
summaries merge exactly, whatever their means (Chan's formula), so large means cost no precision. A task sends one row a pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_STATS = ("n", "x", "y", "xx", "yy", "xy")
_CANCELLED = 1e-6


def _of_batch(columns: list[np.ndarray]) -> np.ndarray:
    """n, means and sums about the means, as matrices over pairs; NaN stands for a missing value."""
    values = np.array(columns, np.float64).reshape(len(columns), -1)
    mask = ~np.isnan(values)
    count = mask.sum(1)
    shift = np.where(count > 0, np.nansum(values, 1) / np.maximum(count, 1), 0.0)
    z = np.where(mask, values - shift[:, None], 0.0)
    m = mask.astype(np.float64)
    n = m @ m.T
    s, q = z @ m.T, (z * z) @ m.T  # of the row's column over the rows that have both
    some = np.maximum(n, 1)
    x, xx, xy = shift[:, None] + s / some, q - s * s / some, z @ z.T - s * s.T / some
    # a pair whose rows lie close together far from its columns' means, or are all equal: anew, about their own mean
    for a, b in np.argwhere((n > 0) & ((xx <= _CANCELLED * q) | (xx.T <= _CANCELLED * q.T))):
        if a > b:
            continue
        both = mask[a] & mask[b]
        u, v = values[a, both], values[b, both]
        x[a, b], x[b, a] = _mean(u), _mean(v)
        u, v = u - x[a, b], v - x[b, a]
        xx[a, b], xx[b, a], xy[a, b] = u @ u, v @ v, u @ v
        xy[b, a] = xy[a, b]
    return np.array([n, x, x.T, xx, xx.T, xy])


def _mean(v: np.ndarray) -> float:
    """Exact if all are equal."""
    return float(v[0] + np.mean(v - v[0]))


def merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    n = a[0] + b[0]
    some = np.maximum(n, 1)
    dx, dy = np.where((a[0] > 0) & (b[0] > 0), b[1] - a[1], 0.0), np.where((a[0] > 0) & (b[0] > 0), b[2] - a[2], 0.0)
    both, part = a[0] * b[0] / some, b[0] / some
    x, y = np.where(a[0] > 0, a[1] + dx * part, b[1]), np.where(a[0] > 0, a[2] + dy * part, b[2])
    return np.array([n, x, y, a[3] + b[3] + dx * dx * both, a[4] + b[4] + dy * dy * both, a[5] + b[5] + dx * dy * both])


def _task(names: tuple[str, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if batch.num_rows:
                new = _of_batch([batch.column(k).to_numpy(zero_copy_only=False) for k in range(len(names))])
                held = new if held is None else merged(held, new)
        if held is None:
            return
        left, right = np.triu_indices(len(names), 1)
        columns = [pa.array(left, pa.int32()), pa.array(right, pa.int32()), *[pa.array(h[left, right]) for h in held]]
        yield pa.record_batch(columns, ["left", "right", *_STATS])

    return run


def comoments(rows: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """(left, right, n, x, y, xx, yy, xy) of every pair of ``names`` in their order: over the rows that have both, their number,
    means, sums of squares about the means and of products. Null and NaN are missing; a pair that no row has comes with n = 0, and
    an empty table gives no pair.
    """
    parts = rows.select(*[F.col(n).cast("double").alias(n) for n in names]).mapInArrow(_task(names), "left int, right int, " + ", ".join(f"{s} double" for s in _STATS))
    # a row a task for each pair, merged in an order that does not depend on the shuffle
    listed = parts.groupBy("left", "right").agg(F.sort_array(F.collect_list(F.struct(*_STATS))).alias("parts"))

    def merge(a, b):
        n = a.n + b.n
        some, use = F.greatest(n, F.lit(1.0)), (a.n > 0) & (b.n > 0)
        dx, dy = F.when(use, b.x - a.x).otherwise(0.0), F.when(use, b.y - a.y).otherwise(0.0)
        both, part = a.n * b.n / some, b.n / some
        return F.struct(
            n.alias("n"), F.when(a.n > 0, a.x + dx * part).otherwise(b.x).alias("x"), F.when(a.n > 0, a.y + dy * part).otherwise(b.y).alias("y"),
            (a.xx + b.xx + dx * dx * both).alias("xx"), (a.yy + b.yy + dy * dy * both).alias("yy"), (a.xy + b.xy + dx * dy * both).alias("xy"),
        )

    none = F.struct(*[F.lit(0.0).alias(s) for s in _STATS])
    one = listed.select("left", "right", F.aggregate("parts", none, merge).alias("m"))
    name = lambda c: F.array(*map(F.lit, names))[F.col(c)].alias(c)
    return one.select(name("left"), name("right"), F.col("m.n").cast("long").alias("n"), *[f"m.{s}" for s in _STATS[1:]])
