"""Operator 11, vector code compression: codebooks per part of a vector, by filtering Lloyd rounds.

Every partition cuts its rows into chunks and builds one kd-tree for each part of the vectors, whose nodes keep their box,
the sum and the count of their points; the trees are stored once. A round sends the codebooks (of fixed size) to the trees:
going down, the entry nearest to a box's middle rules out every entry that is farther from the whole box, and where one
entry is left the node's cached sum and count go to it at once. Only the sums and counts per entry leave a task; Spark adds
them up, and the driver divides a number of sums that does not depend on the input. All arithmetic is in integers.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import common, topk

CHUNK_ROWS = 1 << 13
_LEAF = 16
_HELD = 2**62  # a component beyond is held there
_SMALL = 2**28  # below, squared distances over a part fit longs
_LONG = 2**63 - 1


@dataclass(frozen=True)
class Compressed:
    """``codes``: (id, label, code, error); ``codebooks``: part, entry, component, as integers."""

    codes: DataFrame
    codebooks: list[list[list[int]]]


@dataclass(frozen=True)
class Tree:
    """A balanced kd-tree over ``points`` in leaf order; level k has 2^k nodes with equal numbers of places."""

    points: np.ndarray
    order: np.ndarray  # the row at each place
    weight: np.ndarray  # 1, or 0 for a place that only fills up the tree
    low: list[np.ndarray]
    high: list[np.ndarray]
    sums: list[np.ndarray]
    counts: list[np.ndarray]

    @classmethod
    def build(cls, rows: np.ndarray) -> Tree:
        n, width = rows.shape
        places = max(_LEAF, 1 << (n - 1).bit_length())
        order = np.minimum(np.arange(places), n - 1)
        weight = (np.arange(places) < n).astype(np.int64)
        at = np.arange(places)
        levels = (places // _LEAF).bit_length()
        real = rows.astype(np.float64)  # only to choose where to cut
        for level in range(levels - 1):
            cut = real[order[at]].reshape(1 << level, -1, width)
            wide = (cut.max(1) - cut.min(1)).argmax(1)
            value = np.take_along_axis(cut, wide[:, None, None], 2)[:, :, 0]
            halves = np.argpartition(value, value.shape[1] // 2, axis=1)
            at = np.take_along_axis(at.reshape(1 << level, -1), halves, 1).ravel()
        order, weight = order[at], weight[at]
        exact = rows if not rows.size or np.abs(real).max() < _SMALL else rows.astype(object)
        points = exact[order]
        low, high, sums, counts = [points.reshape(-1, _LEAF, width).min(1)], [points.reshape(-1, _LEAF, width).max(1)], [(points * weight[:, None]).reshape(-1, _LEAF, width).sum(1)], [weight.reshape(-1, _LEAF).sum(1)]
        while len(counts[0]) > 1:
            low.insert(0, np.minimum(low[0][::2], low[0][1::2]))
            high.insert(0, np.maximum(high[0][::2], high[0][1::2]))
            sums.insert(0, sums[0][::2] + sums[0][1::2])
            counts.insert(0, counts[0][::2] + counts[0][1::2])
        return cls(points, order, weight, low, high, sums, counts)

    def assigned(self, book: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(level, nodes, entries) for whole subtrees, and (-1, places, entries) for single points.

        The nearest entry by squared distance wins, the lower index among equals.
        """
        if book.dtype == object or self.points.dtype == object:
            book = book.astype(object)
        index = np.arange(len(book))
        nodes, mask = np.zeros(1, np.int64), np.ones((1, len(book)), bool)
        last = len(self.low) - 1
        for level in range(last + 1):
            low, high = self.low[level][nodes][:, None], self.high[level][nodes][:, None]
            middle = (low.astype(np.float64) + high.astype(np.float64)) / 2
            away = np.where(mask, ((book.astype(np.float64)[None] - middle) ** 2).sum(2), np.inf)
            best = away.argmin(1)
            own = book[best][:, None]
            corner = np.where(book[None] > own, high, low)  # of the box, where the other entry does best against it
            more = ((book[None] - corner) ** 2 - (own - corner) ** 2).sum(2)
            mask = mask & ~((more > 0) | ((more == 0) & (index > best[:, None])))
            mask[np.arange(len(nodes)), best] = True
            alone = mask.sum(1) == 1
            if alone.any():
                yield level, nodes[alone], best[alone]
            nodes, mask = nodes[~alone], mask[~alone]
            if not len(nodes):
                return
            if level < last:
                nodes, mask = (nodes[:, None] * 2 + np.arange(2)).ravel(), mask.repeat(2, 0)
        places = (nodes[:, None] * _LEAF + np.arange(_LEAF)).ravel()
        apart = ((self.points[places][:, None] - book[None]) ** 2).sum(2)
        mask = mask.repeat(_LEAF, 0)
        worst = apart.max(initial=0) + 1
        yield -1, places, np.where(mask, apart, worst).argmin(1)

    def totals(self, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Per entry, the sum and the count of the points that it is nearest to."""
        sums, counts = np.zeros(book.shape, object), np.zeros(len(book), np.int64)
        for level, at, entry in self.assigned(book):
            each = self.points[at] * self.weight[at][:, None] if level < 0 else self.sums[level][at]
            number = self.weight[at] if level < 0 else self.counts[level][at]
            np.add.at(counts, entry, number)
            if each.dtype == object:
                np.add.at(sums, entry, each)
            else:  # sums of a chunk of small components fit longs
                part = np.zeros(book.shape, np.int64)
                np.add.at(part, entry, each)
                sums = sums + part
        return sums, counts

    def codes(self, book: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Each row's entry and squared distance."""
        entry = np.zeros(len(self.order), np.int64)
        for level, at, found in self.assigned(book):
            if level < 0:
                entry[at] = found
            else:
                entry.reshape(1 << level, -1)[at] = found[:, None]
        exact = book.astype(object) if book.dtype == object or self.points.dtype == object else book
        apart = ((self.points - exact[entry]) ** 2).sum(1)
        real = self.weight == 1
        out, far = np.zeros(n, np.int64), np.zeros(n, apart.dtype)
        out[self.order[real]], far[self.order[real]] = entry[real], apart[real]
        return out, far


def scaled(values: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x), held within 2^62 of zero."""
    with np.errstate(over="ignore"):
        return np.clip(np.floor(values * float(scale)), -_HELD, _HELD).astype(np.int64)


def _chunks(batches: Iterable[pa.RecordBatch], parts: int, scale: int) -> Iterator[pa.RecordBatch]:
    held: list[pa.RecordBatch] = []

    def packed() -> pa.RecordBatch:
        table = pa.Table.from_batches(held)
        n = table.num_rows
        rows = scaled(table.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(n, -1), scale)
        trees = [Tree.build(x) for x in np.split(rows, parts, axis=1)]
        lists = [pa.array([table.column(c).to_pylist()], pa.list_(table.schema.field(c).type)) for c in ("id", "label")]
        return pa.record_batch([*lists, pa.array([pickle.dumps(trees, 5)], pa.binary())], ["ids", "labels", "trees"])

    size = 0
    for batch in batches:
        at = 0
        while at < batch.num_rows:
            piece = batch.slice(at, CHUNK_ROWS - size)
            held.append(piece)
            size, at = size + piece.num_rows, at + piece.num_rows
            if size == CHUNK_ROWS:
                yield packed()
                held, size = [], 0
    if size:
        yield packed()
    held.clear()
    common.release()


def _books(codebooks: list[list[list[int]]]) -> list[np.ndarray]:
    small = all(abs(x) < _SMALL for part in codebooks for entry in part for x in entry)
    return [np.array(part, np.int64 if small else object) for part in codebooks]


def _round(trees: DataFrame, codebooks: list[list[list[int]]]) -> list[list[list[int]]]:
    """The codebooks after one round: each entry the rounded-down mean of its points; an unused one stays."""
    books = _books(codebooks)

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = [np.zeros(b.shape, object) for b in books], [np.zeros(len(b), np.int64) for b in books]
        for batch in batches:
            for blob in batch.column("trees"):
                for part, tree in enumerate(pickle.loads(blob.as_buffer())):  # noqa: S301  written by this job
                    more, number = tree.totals(books[part])
                    sums[part], counts[part] = sums[part] + more, counts[part] + number
        keys = [(p, e, k) for p, b in enumerate(books) for e in range(len(b)) for k in range(b.shape[1]) if counts[p][e]]
        columns = list(zip(*keys, strict=True)) or [(), (), ()]
        yield pa.record_batch(
            [
                *[pa.array(c, pa.int32()) for c in columns],
                pa.array([int(counts[p][e]) for p, e, _ in keys], pa.int64()),
                pa.array([int(sums[p][e, k]) for p, e, k in keys], pa.decimal128(38, 0)),
            ],
            ["part", "entry", "at", "n", "s"],
        )
        common.release()

    found = trees.select("trees").mapInArrow(totals, "part int, entry int, at int, n long, s decimal(38,0)")
    new = [[list(entry) for entry in part] for part in codebooks]
    for r in found.groupBy("part", "entry", "at").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).collect():  # one row a component
        new[r.part][r.entry][r.at] = int(r.s) // r.n
    return new


def compress(
    df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096
) -> Compressed:
    """Codebooks for each of ``parts`` equal parts of the vectors, and every vector's code and squared error.

    Components become floor(scale * x). The first codebooks are the parts of the vectors with the ``entries`` smallest ids
    (all, if there are fewer), a null id first, equal ids in the order of their vectors. A vector that is null, or holds a
    null or non-finite component, takes no part, nor does one that is empty, cannot be cut into equal parts, or is not as
    long as the one with the smallest id. Repeated rows count and are returned as often as they occur. ``label`` is the
    label's text, null stays null. Components are held within 2^62, an error at a long's greatest value. An empty table gives
    no codes and no codebooks.
    """
    v = topk.finite(F.col(f"`{vector_col}`"))
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{label_col}`").cast("string").alias("label"), v.alias("v"))
    rows = rows.filter((F.col("v").isNotNull()) & (F.size("v") > 0) & (F.size("v") % parts == 0))
    least = lambda kept, n: kept.select("id", "v").orderBy(F.asc_nulls_first("id"), "v").limit(n).collect()
    first = least(rows, entries)
    if not first:
        return Compressed(rows.select("id", "label", F.lit(b"").alias("code"), F.lit(0).cast("long").alias("error")).withColumnRenamed("id", id_col), [])
    width = len(first[0].v)
    rows = rows.filter(F.size("v") == width)
    if any(len(r.v) != width for r in first):
        first = least(rows, entries)
    begun = scaled(np.array([r.v for r in first], np.float64), scale).reshape(len(first), parts, -1)
    codebooks = [[[int(x) for x in entry] for entry in part] for part in begun.transpose(1, 0, 2)]
    trees = common.checkpointed(rows.mapInArrow(lambda b: _chunks(b, parts, scale), "ids array<long>, labels array<string>, trees binary"))
    for _ in range(rounds):
        codebooks = _round(trees, codebooks)
    books = _books(codebooks)

    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, labels, blob in zip(batch.column("ids"), batch.column("labels"), batch.column("trees"), strict=True):
                n, found = len(ids), []
                for tree, book in zip(pickle.loads(blob.as_buffer()), books, strict=True):  # noqa: S301
                    found.append(tree.codes(book, n))
                error = sum(far.astype(object) for _, far in found)
                code = np.stack([c for c, _ in found], 1).astype(np.uint8)
                yield pa.record_batch([ids.values, labels.values, pa.array([c.tobytes() for c in code], pa.binary()), pa.array([min(int(e), _LONG) for e in error], pa.int64())], ["id", "label", "code", "error"])
        common.release()

    return Compressed(trees.mapInArrow(codes, "id long, label string, code binary, error long").withColumnRenamed("id", id_col), codebooks)


def with_label_error(codes: DataFrame, id_col: str = "vec_id") -> DataFrame:
    """The codes with ``label_error``, the error summed over equal labels (nulls together), held at a long's greatest value.

    Frequent labels are dealt over several tasks, as one may hold any share of the rows.
    """
    keyed = common.checkpointed(codes.withColumn("_key", F.coalesce(F.concat(F.lit("v"), "label"), F.lit(""))))
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(_LONG).cast("decimal(38,0)")).cast("long")
    counted = common.checkpointed(keyed.groupBy("_key").agg(F.count("*").alias("n"), total.alias("label_error")))
    n = counted.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    return common.join_counted(keyed, counted, "_key", id_col, n).drop("_key", "n")
