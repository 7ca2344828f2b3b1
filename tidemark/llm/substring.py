"""Operator 3, substring dedup over word windows.

Rabin-Karp hashes of every window of ``width`` words are counted in Spark. Each scan task combines
its own windows first (of equal windows only the earliest is sent on, so a passage that a third of
the documents share is sent once a task) and sends the rest, dealt by hash range, as compressed
blocks (``ranges``). Each range then finds the windows that also start earlier, and these go back to
their documents, where overlapping windows merge into maximal removal intervals.

A window's hash has 122 bits: two polynomials modulo 2^61 - 1 over 128-bit word symbols. So many of
them are sent, by the size of the input, that less than 1e-6 false pairs are expected.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import common, found, ranges, rolling

#: Windows that a task holds before it sends blocks.
CHUNK_WINDOWS = 5 << 18
_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def word_pieces(text: bytes, most: int = 1 << 20) -> Iterator[list[bytes]]:
    """The words of a text, in lists from about ``most`` bytes each."""
    at = 0
    while len(text) - at > most:
        cut = _SPACE.search(text, at + most)
        if not cut:
            break
        yield text[at : cut.start()].split()
        at = cut.start()
    yield (text[at:] if at else text).split()


def _codecs(width: int, level: int, extra: int) -> dict[int, ranges.Codec]:
    return {0: ranges.Places(width, extra), ranges.SPANS: ranges.Spans(level)}


def _send(width: int, bits: int, chunk: int, codecs: dict[int, ranges.Codec]):

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[ranges.Rows] = []
        known, n = rolling.Symbols(), 0
        for batch in common.slices(batches, "text", 1 << 20):
            ids, prints = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("id", "print"))
            for row, text in enumerate(batch.column("text")):
                pieces = [known.of(words) for words in word_pieces(text.as_buffer().to_pybytes())]
                a, b = (np.concatenate(x) if len(pieces) > 1 else x[0] for x in zip(*pieces, strict=True))
                for at in range(0, max(0, len(a) - width + 1), chunk):  # a very long text fills chunks of its own
                    first, last = rolling.window_pairs((a[at : at + chunk + width - 1], b[at : at + chunk + width - 1]), width)
                    held.append({"first": first, "last": last, "id": np.full(len(first), ids[row]), "print": np.full(len(first), prints[row]), "pos": np.arange(at, at + len(first))})
                    n += len(first)
                    if n >= chunk:
                        yield from ranges.deal(held, codecs, 0, bits)
                        n = 0
        if n:
            yield from ranges.deal(held, codecs, 0, bits)
        common.release()

    return run


def late_spans(docs: DataFrame, width: int, bits: int, level_bits: int = ranges.LEVEL_BITS, chunk: int = CHUNK_WINDOWS, extra: int = 5) -> DataFrame:
    """(id, print, spans) by document: maximal intervals of the late windows of ``docs`` (id, print, text)."""
    level = min(bits, level_bits)
    codecs = _codecs(width, level, extra)
    dealt = ranges.exchanged(docs.mapInArrow(_send(width, level, chunk, codecs), ranges.SENT), codecs, bits, level, chunk)
    return ranges.resolved(dealt, codecs, lambda _, rows: codecs[0].fold(rows)[1], bits, chunk)


def _remove(width: int, layout: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, "text", 1 << 20):
            raw, offsets = rolling.flat(batch.column("text"))
            begins, ends, first = rolling.word_bounds(raw, offsets)
            texts, removed, spans = [], [], []
            bounds = first.tolist()
            for k, (text, blob) in enumerate(zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True)):
                a, b = bounds[k], bounds[k + 1]
                runs = np.frombuffer(blob, "<u4").reshape(-1, 2).tolist() if blob else []
                removed.append(sum(y - x for x, y in runs))
                if layout == "words":
                    words, kept, at = text.split(), [], 0
                    for x, y in runs:
                        kept += words[at:x]
                        at = y
                    texts.append(b" ".join(kept + words[at:] if runs else words))
                else:
                    base, kept, at = int(offsets[k]), [], 0
                    for x, y in runs:
                        kept.append(text[at : int(begins[a + x]) - base])
                        at = int(begins[a + y]) - base if a + y < b else len(text)
                    texts.append(b"".join([*kept, text[at:]]) if runs else text)
                spans.append([{"begin": x, "end": y} for x, y in runs])
            yield pa.record_batch(
                [
                    batch.column("id"),
                    batch.column("carried"),
                    pa.array(np.diff(first), pa.int64()),
                    pa.array(removed, pa.int64()),
                    pa.array(spans, pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())]))),
                    pa.array(texts, pa.binary()),
                ],
                ["id", "carried", "n_words", "n_removed", "spans", "kept"],
            )

    return run


def substring_dedup(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 20, layout: str = "words", carry: tuple[str, ...] = ()
) -> DataFrame:
    """(id, carried columns, n_words, n_removed, spans, kept) for every row.

    A word goes if a window of ``width`` words covers it whose words also start earlier: in a
    smaller id, or earlier in the same id. Windows are judged on the input. ``spans`` are the
    maximal removed runs of words; ``kept`` is the rest, its words joined by one space
    (``layout="words"``) or the text around the removed words unchanged (``layout="text"``).

    A null or empty text has no words; texts of fewer than ``width`` words stay whole. A null id
    comes before every other id. Rows that share an id count as one document: equal windows at the
    same start leave each other alone. An empty table gives an empty result.
    """
    carried = F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`") for c in carry])
    docs = df.select(common.id_in(id_col).alias("id"), common.text_in(text_col).alias("text"), carried.alias("carried"))
    docs = docs.withColumn("print", F.xxhash64("text").bitwiseAND(F.lit(0xFFFFFFFF)))
    size = common.plan_bytes(df)
    bits = ranges.range_bits(size)
    late = late_spans(docs.select("id", "print", "text"), width, bits, extra=ranges.extra_bytes(size, bits))
    kind = docs.schema["carried"].dataType.simpleString()
    schema = f"id long, carried {kind}, n_words long, n_removed long, spans array<struct<begin: int, end: int>>, kept binary"
    out = found.applied(docs, late, _remove(width, layout), schema, ["id", "print"])
    return out.select(
        common.id_out(F.col("id")).alias(id_col),
        *[F.col(f"carried.`{c}`").alias(c) for c in carry if c != id_col],
        "n_words",
        "n_removed",
        "spans",
        F.col("kept").cast("string").alias("kept"),
    )
