"""Findings on their way back to the few documents that have any.

Only texts of documents with findings are shuffled. A bitmap of their ids, of a fixed greatest
size, is broadcast; rows whose id it does not hold pass straight through, the others meet their
findings in a join. A full bitmap lets more rows into the join and changes no result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.llm import common, rolling

#: Bits of a bitmap: at most 64 MB.
LEAST_BITS, MOST_BITS = 1 << 20, 1 << 29
_SEGMENT = 1 << 14  # bytes


def put(bits: np.ndarray, places: np.ndarray) -> None:
    np.bitwise_or.at(bits, places >> np.uint64(3), np.uint8(1) << (places & np.uint64(7)).astype(np.uint8))


def has(bits: np.ndarray, places: np.ndarray) -> np.ndarray:
    return ((bits[places >> np.uint64(3)] >> (places & np.uint64(7)).astype(np.uint8)) & np.uint8(1)).astype(bool)


def places(keys: np.ndarray, n_bytes: int) -> np.ndarray:
    """One place in a bitmap of ``n_bytes`` for each 64-bit key."""
    return rolling.mix(np.ascontiguousarray(keys).view(np.uint64)) & np.uint64(8 * n_bytes - 1)


def _blob(segment: int, bits: np.ndarray) -> pa.RecordBatch:
    packed = pa.compress(bits.tobytes(), codec="zstd", asbytes=True)
    return pa.record_batch([pa.array([segment], pa.int32()), pa.array([packed], pa.binary())], ["segment", "bits"])


def bitmap(rows: DataFrame, n: int, keys: Callable[[pa.RecordBatch], list[np.ndarray]]) -> np.ndarray:
    """The bitmap over ``keys`` of all batches of ``rows``, sized for ``n`` keys: at most MOST_BITS / 8 bytes on the driver."""
    n_bytes = common.power_of_two(16 * n, LEAST_BITS, MOST_BITS) // 8

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(n_bytes, np.uint8)
        for batch in batches:
            for part in keys(batch):
                put(bits, places(part, n_bytes))
        for at in range(0, n_bytes, _SEGMENT):
            if bits[at : at + _SEGMENT].any():
                yield _blob(at // _SEGMENT, bits[at : at + _SEGMENT])
        bits = None
        common.release()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for segment, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                got = np.frombuffer(pa.decompress(blob, decompressed_size=_SEGMENT, codec="zstd", asbytes=True), np.uint8)
                held[segment] = held[segment] | got if segment in held else got
        for segment, bits in held.items():
            yield _blob(segment, bits)

    schema = "segment int, bits binary"
    out = np.zeros(n_bytes, np.uint8)
    for segment, blob in rows.mapInArrow(build, schema).repartition("segment").mapInArrow(merge, schema).collect():
        out[segment * _SEGMENT : (segment + 1) * _SEGMENT] = np.frombuffer(pa.decompress(bytes(blob), decompressed_size=_SEGMENT, codec="zstd", asbytes=True), np.uint8)
    return out


def applied(docs: DataFrame, late: DataFrame, cut: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str, keys: list[str], column: str = "spans") -> DataFrame:
    """``cut`` over all of ``docs`` (id, ..., text) with ``column`` of ``late`` (one row per ``keys``, the first of them id).

    ``cut`` gets batches with the column, null where a document has no findings.
    """
    late = common.checkpointed(late)
    bits = docs.sparkSession.sparkContext.broadcast(bitmap(late.select("id"), late.count(), lambda batch: [batch.column("id").to_numpy(zero_copy_only=False)]))
    kind = common.arrow_type(late, column)

    def split(batches: Iterator[pa.RecordBatch], wanted: bool) -> Iterator[pa.RecordBatch]:
        known = bits.value
        for batch in batches:
            hit = has(known, places(batch.column("id").to_numpy(zero_copy_only=False), len(known)))
            if (hit == wanted).any():
                yield batch.filter(pa.array(hit == wanted))

    def passed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from cut(b.append_column(column, pa.nulls(b.num_rows, kind)) for b in split(batches, False))

    met = docs.mapInArrow(lambda batches: split(batches, True), docs.schema).join(late.hint("shuffle_hash"), keys, "left")
    return docs.mapInArrow(passed, schema).union(met.select(*docs.columns, column).mapInArrow(cut, schema))
