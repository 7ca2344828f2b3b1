"""Operator 9, line dedup with two Bloom filters.

Each scan task puts the hashes of its documents' line keys into a filter of once-seen hashes, and
a hash that is there already into a filter of twice-seen ones. Tasks send compressed segments;
merging them, a bit that two tasks' once-seen filters share counts as seen twice, so no key of two
documents is ever missed. The merged twice-seen filter has a fixed greatest size whatever the
input, and is broadcast. Only keys that it holds are shuffled, as 128-bit digests, for exact
confirmation, the number of documents and the document whose lines stay; frequent ones are salted.
Of the texts, only those that lose a line are shuffled. A full filter costs shuffle, never a result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import common, found

#: Bits of a filter: from the input's bytes, at most 64 MB.
LEAST_BITS, MOST_BITS = 1 << 20, 1 << 29
_SEGMENT = 1 << 17  # bytes


def line_keys(text: bytes, least: int) -> list[bytes | None]:
    """Each line's key: stripped, ASCII letters lowered; None where it has too few code points."""
    out: list[bytes | None] = []
    for line in text.split(b"\n"):
        key = line.strip()
        long = len(key) >= least and (key.isascii() or len(key.decode("utf-8", "replace")) >= least)
        out.append(key.lower() if long else None)
    return out


def _places(keys: list[bytes], mask: int) -> np.ndarray:
    """Two bit positions for each key."""
    h = np.array([xxhash.xxh3_64_intdigest(k) for k in keys], np.uint64)
    return np.concatenate([h & np.uint64(mask), (h >> np.uint64(33)) & np.uint64(mask)])


def _has(bits: np.ndarray, places: np.ndarray) -> np.ndarray:
    hit = (bits[places >> np.uint64(3)] >> (places & np.uint64(7)).astype(np.uint8)) & np.uint8(1)
    n = len(places) // 2
    return (hit[:n] & hit[n:]).astype(bool)


def _put(bits: np.ndarray, places: np.ndarray) -> None:
    np.bitwise_or.at(bits, places >> np.uint64(3), np.uint8(1) << (places & np.uint64(7)).astype(np.uint8))


def _build(n_bits: int, least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, twice = np.zeros(n_bits // 8, np.uint8), np.zeros(n_bits // 8, np.uint8)
        for batch in common.slices(batches, "text", 1 << 20):
            keys = [k for text in batch.column("text").to_pylist() for k in {k for k in line_keys(text, least) if k is not None}]
            if not keys:
                continue
            places = _places(keys, n_bits - 1)
            n = len(keys)
            pairs = places[:n] << np.uint64(32) | places[n:]
            order = np.argsort(pairs, kind="stable")
            again = np.zeros(n, bool)
            again[order[1:]] = pairs[order[1:]] == pairs[order[:-1]]
            seen = _has(once, places) | again
            _put(twice, places[np.tile(seen, 2)])
            _put(once, places)
        for at in range(0, n_bits // 8, _SEGMENT):
            a, b = once[at : at + _SEGMENT], twice[at : at + _SEGMENT]
            if a.any():
                yield pa.record_batch(
                    [pa.array([at // _SEGMENT], pa.int32())] + [pa.array([pa.compress(x.tobytes(), codec="zstd", asbytes=True)], pa.binary()) for x in (a, b)],
                    ["segment", "once", "twice"],
                )

    return run


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for batch in batches:
        for segment, *blobs in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            a, b = (np.frombuffer(pa.decompress(x, decompressed_size=_SEGMENT, codec="zstd", asbytes=True), np.uint8) for x in blobs)
            if segment in found:
                once, twice = found[segment]
                twice |= b | (once & a)
                once |= a
            else:
                found[segment] = (a.copy(), b.copy())
    for segment, (_, twice) in found.items():
        if twice.any():
            yield pa.record_batch([pa.array([segment], pa.int32()), pa.array([pa.compress(twice.tobytes(), codec="zstd", asbytes=True)], pa.binary())], ["segment", "twice"])


def _suspects(twice, n_bits: int, least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = twice.value
        for batch in common.slices(batches, "text", 1 << 20):
            keys, ids = [], []
            for key_id, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                own = {k for k in line_keys(text, least) if k is not None}
                keys += own
                ids += [key_id] * len(own)
            if not keys:
                continue
            hit = _has(bits, _places(keys, n_bits - 1))
            chosen = np.flatnonzero(hit).tolist()
            yield pa.record_batch(
                [pa.array([xxhash.xxh3_128_digest(keys[k]) for k in chosen], pa.binary()), pa.array([ids[k] for k in chosen], pa.int64())],
                ["key", "id"],
            )

    return run


def _drop(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, "text", 1 << 20):
            total, dropped, texts = [], [], []
            for text, gone in zip(batch.column("text").to_pylist(), batch.column("gone").to_pylist(), strict=True):
                if not gone:
                    total.append(text.count(b"\n") + 1)
                    dropped.append(0)
                    texts.append(text)
                    continue
                lines, gone = text.split(b"\n"), set(gone)
                kept = [x for x, k in zip(lines, line_keys(text, least), strict=True) if k is None or xxhash.xxh3_128_digest(k) not in gone]
                total.append(len(lines))
                dropped.append(len(lines) - len(kept))
                texts.append(b"\n".join(kept))
            yield pa.record_batch(
                [batch.column("id"), batch.column("carried"), pa.array(total, pa.int64()), pa.array(dropped, pa.int64()), pa.array(texts, pa.binary())],
                ["id", "carried", "n_lines", "n_dropped", "kept"],
            )

    return run


def line_dedup(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int = 20, least_docs: int = 3, carry: tuple[str, ...] = ()
) -> DataFrame:
    """(id, carried columns, n_lines, n_dropped, kept) for every row.

    A line's key is the line without ASCII white space at its ends and with A-Z lowered. A key of
    ``least_chars`` code points or more that is in ``least_docs`` (two or more) documents loses all
    its lines but those in the largest id that holds it; other lines stay, joined by newlines.

    A null or empty text is one empty line. A null id counts as smaller than every other id. Rows
    that share an id count as one document and keep or lose a line together. An empty table gives
    an empty result.
    """
    spark = df.sparkSession
    size = common.plan_bytes(df)
    n_bits = common.power_of_two(size / 8 if size < 1 << 60 else 1 << 23, LEAST_BITS, MOST_BITS)
    carried = F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`") for c in carry])
    docs = df.select(common.id_in(id_col).alias("id"), common.text_in(text_col).alias("text"), carried.alias("carried"))
    segments = docs.select("text").mapInArrow(_build(n_bits, least_chars), "segment int, once binary, twice binary")
    merged = segments.repartition("segment").mapInArrow(_merge, "segment int, twice binary").collect()  # at most MOST_BITS / 8 bytes
    bits = np.zeros(n_bits // 8, np.uint8)
    for segment, blob in merged:
        bits[segment * _SEGMENT : (segment + 1) * _SEGMENT] = np.frombuffer(pa.decompress(bytes(blob), decompressed_size=_SEGMENT, codec="zstd", asbytes=True), np.uint8)
    twice = spark.sparkContext.broadcast(bits)

    suspects = common.checkpointed(docs.select("id", "text").mapInArrow(_suspects(twice, n_bits, least_chars), "key binary, id long"))
    counted = suspects.groupBy("key").agg(F.count_distinct("id").alias("n"), F.max("id").alias("stays")).filter(F.col("n") >= least_docs)
    losing = common.join_counted(suspects, counted, "key", "id", suspects.count()).filter(F.col("id") != F.col("stays"))
    gone = losing.groupBy("id").agg(F.collect_set("key").alias("gone"))
    kind = docs.schema["carried"].dataType.simpleString()
    out = found.applied(docs, gone, _drop(least_chars), f"id long, carried {kind}, n_lines long, n_dropped long, kept binary", ["id"], "gone")
    return out.select(
        common.id_out(F.col("id")).alias(id_col),
        *[F.col(f"carried.`{c}`").alias(c) for c in carry if c != id_col],
        "n_lines",
        "n_dropped",
        F.col("kept").cast("string").alias("kept"),
    )
