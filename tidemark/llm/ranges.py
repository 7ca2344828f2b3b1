"""Dealing rows of numpy arrays by hash range, as compressed blocks whose number grows with the input.

A task gathers rows into chunks, folds what it can decide alone, and sends one block for each of at
most 2^LEVEL_BITS ranges. Were it to send one for every range of a large input, the number of blocks would grow with
the square of the input; so larger inputs take a second exchange, in which the blocks of a coarse range are
gathered into chunks again, folded again, and dealt into fine ranges.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import common, rolling

#: Input bytes for each hash range.
RANGE_BYTES = 2 << 20
#: Bits of a hash that one exchange deals by; two exchanges reach 2^26 ranges of 2 MB, 134 TB.
LEVEL_BITS = 13
MOST_BITS = 26

SENT = "part long, blob binary, size long"
_TYPES = [("part", pa.int64()), ("blob", pa.binary()), ("size", pa.int64())]
#: A part is (kind << KIND) + range; spans that are decided are a kind of their own.
KIND, SPANS = 40, 7

Rows = dict[str, np.ndarray]


class Codec(Protocol):
    """One kind of rows: its routing key, what a chunk can fold, and the bytes of a block."""

    def key(self, rows: Rows) -> np.ndarray: ...

    def fold(self, rows: Rows) -> tuple[Rows, Rows | None]:
        """The rows to send, and spans that are decided to go."""

    def pack(self, rows: Rows, bits: int) -> bytes: ...

    def unpack(self, raw: bytes, part: int, bits: int) -> Rows: ...


def range_bits(size: int) -> int:
    """Bits that number the hash ranges of an input of ``size`` bytes."""
    return common.power_of_two(size / RANGE_BYTES if size < 1 << 60 else 64, 1, 1 << MOST_BITS).bit_length() - 1


def extra_bytes(size: int, bits: int) -> int:
    """Hash bytes to send besides 64 bits, so that 2^-20 false pairs at most are expected among ``size`` different rows."""
    return max(0, min(5, -(-(2 * max(1, size).bit_length() + 19 - 64 - min(bits, LEVEL_BITS)) // 8)))


def joined(held: list[Rows]) -> Rows:
    return {name: np.concatenate([rows[name] for rows in held]) for name in held[0]}


def taken(rows: Rows, which: np.ndarray) -> Rows:
    return {name: column[which] for name, column in rows.items()}


def edges(*columns: np.ndarray) -> np.ndarray:
    """Where a run of equal rows of the columns begins."""
    n = len(columns[0])
    new = np.ones(n, bool)
    if n:
        new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return np.flatnonzero(new)


def deal(held: list[Rows], codecs: dict[int, Codec], kind: int, bits: int) -> Iterator[pa.RecordBatch]:
    """A chunk of rows (``held`` is emptied): a block for each range, and one for each range of what ``fold`` decides."""
    rows, late = codecs[kind].fold(joined(held))
    held.clear()
    if late is not None and len(late["id"]):
        yield from deal([late], codecs, SPANS, codecs[SPANS].level)
    key = codecs[kind].key(rows)
    part = (key >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(key), np.int64)
    order = np.argsort(part, kind="stable")
    rows, part = taken(rows, order), part[order]
    first = edges(part).tolist()
    sent: list[tuple[int, bytes, int]] = []
    for a, b in zip(first, [*first[1:], len(part)], strict=False):
        raw = codecs[kind].pack({name: column[a:b] for name, column in rows.items()}, bits)
        sent.append(((kind << KIND) + int(part[a]), pa.compress(raw, codec="zstd", asbytes=True), len(raw)))
        if len(sent) == 64 or b == len(part):
            yield _batch(sent)
            sent = []


def _batch(sent: list[tuple[int, bytes, int]]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c, t) for c, (_, t) in zip(zip(*sent, strict=True), _TYPES, strict=True)], [n for n, _ in _TYPES])


def opened(blob: bytes, size: int, part: int, bits: int, codecs: dict[int, Codec]) -> Rows:
    raw = pa.decompress(blob, decompressed_size=size, codec="zstd", asbytes=True)
    return codecs[part >> KIND].unpack(raw, part & ((1 << KIND) - 1), bits)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, bytes, int]]:
    for batch in batches:
        yield from zip(*(batch.column(c).to_pylist() for c in ("part", "blob", "size")), strict=True)


def exchanged(sent: DataFrame, codecs: dict[int, Codec], bits: int, level: int, chunk: int) -> DataFrame:
    """``sent`` (dealt by ``level`` bits) dealt by ``bits`` and in order of its parts: at once, or after a second exchange.

    Spans stay as they are dealt: they have an exchange of their own.
    """

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[Rows] = []
        n, coarse = 0, 0
        for part, blob, size in _blocks(batches):
            if part >> KIND == SPANS and len(codecs) > 1:
                yield _batch([(part, blob, size)])
                continue
            if n and (part != coarse or n >= chunk):
                yield from deal(held, codecs, coarse >> KIND, bits)
                n = 0
            coarse = part
            held.append(opened(blob, size, part, level, codecs))
            n += len(held[-1]["id"])
        if n:
            yield from deal(held, codecs, coarse >> KIND, bits)
        common.release()

    if bits > level:
        tasks = 1 << min(20, max(1, bits - 6))  # of about 128 MB of the input each
        salt = F.pmod(F.xxhash64("blob"), F.lit(max(1, tasks >> level)))  # a coarse range may be too much for a task
        sent = sent.repartition(tasks, "part", salt).sortWithinPartitions("part").mapInArrow(again, SENT)
    return sent.repartition("part").sortWithinPartitions("part")


def resolved(dealt: DataFrame, codecs: dict[int, Codec], decide: Callable[[int, Rows], Rows], bits: int, chunk: int) -> DataFrame:
    """(id, print, spans) by document of what ``decide`` (kind, all rows of one range) finds, and of what was decided before."""
    level = codecs[SPANS].level

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[Rows] = []
        late: list[Rows] = []
        n, now = 0, -1

        def close() -> int:
            late.append(decide(now >> KIND, joined(held)))
            held.clear()
            common.release()
            return len(late[-1]["id"])

        for part, blob, size in _blocks(batches):
            if part >> KIND == SPANS:
                yield _batch([(part, blob, size)])
                continue
            if held and part != now:
                n += close()
                if n >= chunk:
                    yield from deal(late, codecs, SPANS, level)
                    n = 0
            now = part
            held.append(opened(blob, size, part, bits, codecs))
        if held:
            n += close()
        if n:
            yield from deal(late, codecs, SPANS, level)
        common.release()

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[Rows] = []
        now = -1
        for part, blob, size in _blocks(batches):
            if held and part != now:
                yield by_document(joined(held))
                held = []
            now = part
            held.append(opened(blob, size, part, bits, codecs))
        if held:
            yield by_document(joined(held))
        common.release()

    spans = exchanged(dealt.mapInArrow(run, SENT), {SPANS: codecs[SPANS]}, bits, level, chunk)
    return spans.mapInArrow(merged, "id long, print long, spans binary")


def by_document(rows: Rows) -> pa.RecordBatch:
    """(id, print, spans): each document's maximal intervals, as pairs of little-endian 32-bit numbers."""
    rows = merged_spans(rows)
    first = edges(rows["id"], rows["print"])
    pairs = np.stack([rows["pos"], rows["end"]], axis=1).astype("<u4")
    counts = 2 * np.diff(np.append(first, len(pairs)))
    return pa.record_batch([pa.array(rows["id"][first]), pa.array(rows["print"][first]), rolling.binary_rows(pairs, counts)], ["id", "print", "spans"])


def merged_spans(rows: Rows) -> Rows:
    """Intervals (``pos`` to ``end``) in order, those of a document that overlap or touch as one."""
    rows = taken(rows, np.lexsort((rows["pos"], rows["print"], rows["id"])))
    if not len(rows["id"]):
        return rows
    doc = np.zeros(len(rows["id"]), np.int64)
    doc[edges(rows["id"], rows["print"])] = 1
    shift = np.cumsum(doc) * (int(rows["end"].max()) + 1)  # keeps documents apart
    reach = np.maximum.accumulate(rows["end"] + shift) - shift
    new = doc.astype(bool)
    new[1:] |= rows["pos"][1:] > reach[:-1]
    first = np.flatnonzero(new)
    return {**taken({c: rows[c] for c in ("id", "print", "pos")}, first), "end": reach[np.append(first[1:], len(new)) - 1]}


def _pack_ids(ids: np.ndarray, prints: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    edge = edges(ids, prints)
    counts = np.diff(np.append(edge, len(ids))).astype("<u4")
    return edge, [np.diff(ids[edge], prepend=np.int64(0)).astype("<i8").tobytes(), prints[edge].astype("<u4").tobytes(), counts.tobytes()]


def _unpack_ids(raw: bytes, docs: int, at: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ids = np.cumsum(np.frombuffer(raw, "<i8", docs, at))
    prints = np.frombuffer(raw, "<u4", docs, at + 8 * docs).astype(np.int64)
    return ids, prints, np.frombuffer(raw, "<u4", docs, at + 12 * docs).astype(np.int64)


class Spans:
    """Intervals ``pos`` to ``end`` of a document (``id``, ``print``), dealt by ``level`` bits of the id first."""

    def __init__(self, level: int) -> None:
        self.level = level

    def key(self, rows: Rows) -> np.ndarray:
        return rolling.mix(rows["id"].view(np.uint64))

    def fold(self, rows: Rows) -> tuple[Rows, Rows | None]:
        return merged_spans(rows), None

    def pack(self, rows: Rows, bits: int) -> bytes:
        edge, head = _pack_ids(rows["id"], rows["print"])
        step = np.diff(rows["pos"], prepend=0)
        step[edge] = rows["pos"][edge]
        return b"".join([np.array([len(edge), len(step)], "<u4").tobytes(), *head, step.astype("<u4").tobytes(), (rows["end"] - rows["pos"]).astype("<u4").tobytes()])

    def unpack(self, raw: bytes, part: int, bits: int) -> Rows:
        docs, n = np.frombuffer(raw, "<u4", 2).tolist()
        ids, prints, counts = _unpack_ids(raw, docs, 8)
        at = 8 + 16 * docs
        step, size = np.frombuffer(raw, "<u4", n, at).astype(np.int64), np.frombuffer(raw, "<u4", n, at + 4 * n).astype(np.int64)
        sums, edge = np.cumsum(step), np.cumsum(counts) - counts
        pos = sums - np.repeat(sums[edge] - step[edge], counts)
        return {"id": np.repeat(ids, counts), "print": np.repeat(prints, counts), "pos": pos, "end": pos + size}


def spans(rows: Rows, which: np.ndarray, begin: int | np.ndarray, end: int | np.ndarray) -> Rows:
    """Spans from ``begin`` to ``end`` relative to the places of the rows ``which``."""
    ids, prints, pos = (rows[c][which] for c in ("id", "print", "pos"))
    return {"id": ids, "print": prints, "pos": pos + begin, "end": pos + end}


class Places:
    """Rows with a 122-bit hash (``first``, ``last``) and a place (``id``, ``print``, ``pos``).

    With a ``width``, a chunk folds equal hashes into the earliest place, and the others' ``width`` symbols go.
    64 hash bits behind those that number the range are sent, and ``extra`` bytes more.
    """

    def __init__(self, width: int = 0, extra: int = 0) -> None:
        self.width, self.extra = width, extra

    def key(self, rows: Rows) -> np.ndarray:
        return rows["first"]

    def fold(self, rows: Rows) -> tuple[Rows, Rows | None]:
        rows = taken(rows, np.lexsort((rows["pos"], rows["print"], rows["id"])))
        if not self.width:
            return rows, None
        late = repeated(rows)
        return taken(rows, ~late), spans(rows, late, 0, self.width)

    def pack(self, rows: Rows, bits: int) -> bytes:
        """Rows in the order (id, print, pos)."""
        first, last, ids, prints, pos = (rows[c] for c in ("first", "last", "id", "print", "pos"))
        edge, head = _pack_ids(ids, prints)
        step = np.diff(pos, prepend=0)
        step[edge] = pos[edge]
        wide = bool(step.max() > 65535)
        bit = np.uint64(bits)
        return b"".join(
            [
                np.array([len(edge), len(ids), wide], "<u4").tobytes(),
                *head,
                step.astype("<u4" if wide else "<u2").tobytes(),
                (first << bit | last >> np.uint64(64 - bits) if bits else first).astype("<u8").tobytes(),
                np.ascontiguousarray((last << bit).astype(">u8").view(np.uint8).reshape(-1, 8)[:, : self.extra].T).tobytes(),
            ]
        )

    def unpack(self, raw: bytes, part: int, bits: int) -> Rows:
        docs, n, wide = np.frombuffer(raw, "<u4", 3).tolist()
        ids, prints, counts = _unpack_ids(raw, docs, 12)
        at = 12 + 16 * docs
        step = np.frombuffer(raw, "<u4" if wide else "<u2", n, at).astype(np.int64)
        at += n * (4 if wide else 2)
        high, tail = np.frombuffer(raw, "<u8", n, at), np.zeros((n, 8), np.uint8)
        tail[:, : self.extra] = np.frombuffer(raw, np.uint8, n * self.extra, at + 8 * n).reshape(self.extra, n).T
        low = tail.view(">u8").ravel().astype(np.uint64)
        bit, rest = np.uint64(bits), np.uint64(64 - bits)
        sums, edge = np.cumsum(step), np.cumsum(counts) - counts
        return {
            "first": high >> bit | np.uint64(part) << rest if bits else high,
            "last": high << rest | low >> bit if bits else low,
            "id": np.repeat(ids, counts),
            "print": np.repeat(prints, counts),
            "pos": sums - np.repeat(sums[edge] - step[edge], counts),
        }


def repeated(rows: Rows) -> np.ndarray:
    """Which rows (as of Places) have an equal one with a smaller (id, pos)."""
    first, last, ids, pos = (rows[c] for c in ("first", "last", "id", "pos"))
    out = np.zeros(len(first), bool)
    order = np.argsort(first)
    same = first[order[1:]] == first[order[:-1]]
    many = order[np.append(same, False) | np.append(False, same)] if len(order) else order
    if not len(many):
        return out
    many = many[np.lexsort((pos[many], ids[many], last[many], first[many]))]
    group = np.zeros(len(many), np.int64)
    group[edges(first[many], last[many])] = 1
    lead = many[np.maximum.accumulate(np.where(group, np.arange(len(many)), 0))]
    out[many] = (ids[many] != ids[lead]) | (pos[many] != pos[lead])
    return out
