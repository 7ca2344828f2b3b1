"""Operator 6, packing token sequences.

Best-fit decreasing: documents longer than a window are first cut into full windows; the rests go,
longest first, into the tightest open window, which a segment tree indexed by remaining capacity
finds. Whole documents are kept where they fit. Afterwards the emptiest windows are dissolved and
their pieces cut into the gaps of the others, and what is left of the last window is laid into
windows of power-of-two lengths, which need no padding.

Packing runs within each scan task, over groups of a bounded number of tokens, so there is no
shuffle, memory is bounded, and a lost task is repeated on its own with the same result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import common, tokens

#: Tokens that are packed together: 16 MB of ids.
GROUP_TOKENS = 1 << 22


class _Capacities:
    """A segment tree over remaining capacities 0..size: the stacks of open windows at its leaves."""

    def __init__(self, size: int) -> None:
        self.base = 1 << size.bit_length()
        self.some = bytearray(2 * self.base)
        self.windows: list[list[int]] = [[] for _ in range(size + 1)]

    def add(self, capacity: int, window: int) -> None:
        self.windows[capacity].append(window)
        at = capacity + self.base
        while at and not self.some[at]:
            self.some[at] = 1
            at >>= 1

    def tightest(self, length: int) -> tuple[int, int] | None:
        """Take out the open window with the smallest capacity of at least ``length``."""
        at = length + self.base
        if not self.some[at]:
            while at > 1 and (at & 1 or not self.some[at + 1]):
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.base:
                at = 2 * at if self.some[2 * at] else 2 * at + 1
        capacity = at - self.base
        window = self.windows[capacity].pop()
        if not self.windows[capacity]:
            self.some[at] = 0
            at >>= 1
            while at and not (self.some[2 * at] or self.some[2 * at + 1]):
                self.some[at] = 0
                at >>= 1
        return capacity, window


def place(lengths: list[int], size: int) -> list[list[tuple[int, int, int]]]:
    """Windows of (document, start, length) pieces, each id of each document in exactly one piece."""
    windows: list[list[tuple[int, int, int]]] = []
    rests = []
    for doc, n in enumerate(lengths):
        full = n // size
        windows += [[(doc, k * size, size)] for k in range(full)]
        if n % size:
            rests.append((n % size, doc, full * size))
    rests.sort(key=lambda x: (-x[0], x[1]))
    tree, first = _Capacities(size), len(windows)
    free: list[int] = [0] * first
    for n, doc, start in rests:
        found = tree.tightest(n)
        if found:
            capacity, w = found
        else:
            capacity, w = size, len(windows)
            windows.append([])
            free.append(size)
        windows[w].append((doc, start, n))
        free[w] = capacity - n
        if free[w]:
            tree.add(free[w], w)
    return _top_up(windows, free, size)


def _top_up(windows: list[list[tuple[int, int, int]]], free: list[int], size: int) -> list[list[tuple[int, int, int]]]:
    gaps = sorted((w for w in range(len(windows)) if free[w]), key=lambda w: (free[w], w))
    lowest, out = 0, [windows[w] for w in range(len(windows)) if not free[w]]
    left: list[tuple[int, int, int]] = []
    high = len(gaps)
    while lowest < high or left:
        if not left:
            high -= 1  # the emptiest window that is still open is dissolved
            left = windows[gaps[high]][::-1]
            continue
        if lowest == high:
            out += _ladder(left[::-1], size)
            break
        w = gaps[lowest]
        doc, start, n = left.pop()
        take = min(n, free[w])
        windows[w].append((doc, start, take))
        free[w] -= take
        if take < n:
            left.append((doc, start + take, n - take))
        if not free[w]:
            out.append(windows[w])
            lowest += 1
    return out


def _ladder(pieces: list[tuple[int, int, int]], size: int) -> list[list[tuple[int, int, int]]]:
    """Lay the pieces into windows whose lengths are powers of two (or ``size``)."""
    out, total, pieces = [], sum(p[2] for p in pieces), pieces[::-1]
    while total:
        room = size if total >= size else 1 << (total.bit_length() - 1)
        total -= room
        out.append([])
        while room:
            doc, start, n = pieces.pop()
            take = min(n, room)
            out[-1].append((doc, start, take))
            room -= take
            if take < n:
                pieces.append((doc, start + take, n - take))
    return out


def pack(
    df: DataFrame,
    json_path: str,
    ranks_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    size: int = 2048,
    end_id: int = 1,
    group_tokens: int = GROUP_TOKENS,
) -> DataFrame:
    """Rows (id, start, length, ids, doc_tokens, sequence_id, offset), one for each piece.

    ``ids``: the piece's ids as little-endian unsigned 32-bit integers. Each document is its text's
    ids and then ``end_id``, so a null or empty text is one token. A null id stays null; repeated
    rows are packed as documents of their own; an empty table gives no rows. Sequence ids are
    unique: the scan task's number times 2^32 plus a running number.
    """

    def group(docs: list[tuple[int | None, np.ndarray]], base: int) -> tuple[Iterator[pa.RecordBatch], int]:
        windows = place([len(ids) for _, ids in docs], size)

        def emit() -> Iterator[pa.RecordBatch]:
            for at in range(0, len(windows), 512):
                rows = []
                for k, window in enumerate(windows[at : at + 512], base + at):
                    offset = 0
                    for doc, start, n in window:
                        key, ids = docs[doc]
                        rows.append((key, start, n, ids[start : start + n].tobytes(), len(ids), k, offset))
                        offset += n
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _TYPES, strict=True)], names=_NAMES)

        return emit(), len(windows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokens.encoder(json_path, ranks_path).encode
        base = (TaskContext.get().partitionId()) << 32
        end = np.array([end_id], "<u4")
        docs, held = [], 0
        for batch in common.slices(batches, "text", 4 << 20):
            for key, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                ids = np.concatenate([encode(text.decode("utf-8", "replace")), end])
                docs.append((key, ids))
                held += len(ids)
                if held >= group_tokens:
                    rows, n = group(docs, base)
                    yield from rows
                    docs, held, base = [], 0, base + n
        if docs:
            yield from group(docs, base)[0]

    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), common.text_in(text_col).alias("text"))
    return rows.mapInArrow(run, _SCHEMA).withColumnRenamed("id", id_col)


_SCHEMA = "id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
_NAMES = [x.split()[0] for x in _SCHEMA.split(", ")]
_TYPES = [{"long": pa.int64(), "binary": pa.binary()}[x.split()[1]] for x in _SCHEMA.split(", ")]
