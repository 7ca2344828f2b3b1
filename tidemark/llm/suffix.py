"""Operator 5, suffix-array dedup of repeated byte strings.

Every string of ``width`` bytes holds at least one anchor: the k-byte grams with the smallest hash
of each window. Equal strings hold equal anchors at equal places, so only anchors that occur again
need a closer look, and only together with equal ones.

1. Anchors are dealt by hash range; those that occur twice or more go back to their documents.
2. Each such occurrence sends its context: the strings whose smallest gram it is. Of contexts with
   equal bytes, a scan task sends the earliest only; the later ones are repeats throughout.
3. All contexts of an anchor meet. Their bytes left and right of the gram, as big-endian
   8-byte symbols behind separators, get a suffix array by linear grouping (``gsaca``). Neighbours in
   it tell how many bytes two contexts share to either side, and so which strings are equal; all
   but the earliest of these go.
4. Intervals to remove go back to their documents and merge.

Hashes only route: scan tasks and suffix arrays compare bytes. The one exception are anchors that occur
more than HOT times: so many contexts must not meet in one task, so their strings are dealt one by one, by
122-bit hashes, and counted like the windows of ``substring``. A long text is worked on in pieces
of PIECE bytes that overlap by less than a string.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import common, found, ranges, rolling
from tidemark.llm.gsaca import suffix_array

GRAM = 36
PIECE = 1 << 20
#: Anchors, or contexts, that a task holds before it sends blocks.
CHUNK_ANCHORS, CHUNK_CONTEXTS = 3 << 17, 5 << 14
#: Occurrences of an anchor whose contexts may meet in one task: 20 MB of contexts.
HOT = 1 << 17
#: Contexts of a suffix array, unless one anchor has more.
BLOCK_CONTEXTS = 1 << 14
_CONTEXTS, _STRINGS = 0, 1


def _sliding(x: np.ndarray, width: int, best) -> np.ndarray:
    """best(x[i], ..., x[i + width - 1]) for each i."""
    have = 1
    while 2 * have <= width:
        x = best(x[:-have], x[have:])
        have *= 2
    return best(x[: len(x) - (width - have)], x[width - have :]) if have < width else x


def anchors(raw: np.ndarray, offsets: np.ndarray, width: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin, document and gram hash of each anchor; hashes that are chosen are small ones."""
    empty = np.empty(0, np.int64)
    if len(raw) < width:
        return empty, empty, np.empty(0, np.uint64)
    hashes = rolling.window_hashes(rolling.byte_symbols(raw), gram) | np.uint64(1)
    reach = width - gram + 1
    least = _sliding(hashes, reach, np.minimum)  # by begin of the string
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    least[doc[: len(least)] != doc[width - 1 :]] = 0  # strings never cross documents
    padded = np.concatenate([np.zeros(reach - 1, np.uint64), least, np.zeros(reach - 1, np.uint64)])
    chosen = np.flatnonzero(_sliding(padded, reach, np.maximum) == hashes)
    return chosen, doc[chosen], hashes[chosen]


def owned(at: np.ndarray, doc: np.ndarray, hashes: np.ndarray, ends: np.ndarray, begins: np.ndarray, width: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """The first and last begin of the strings in which each anchor may be the (leftmost) smallest gram.

    ``hashes`` are those that anchors are chosen by; ``begins`` and ``ends`` are their documents' bounds.
    """
    reach = width - gram
    low, high = np.maximum(at - reach, begins), np.minimum(at, ends - width)
    n = len(at)
    for step, bound in ((-1, low), (1, high)):
        open_, k = np.arange(n), np.arange(n)
        while len(open_):
            k = k + step
            inside = (k >= 0) & (k < n)
            open_, k = open_[inside], k[inside]
            near = (doc[k] == doc[open_]) & (np.abs(at[k] - at[open_]) <= reach)
            open_, k = open_[near], k[near]
            smaller = hashes[k] <= hashes[open_] if step < 0 else hashes[k] < hashes[open_]
            hit, by = open_[smaller], k[smaller]
            bound[hit] = np.maximum(low[hit], at[by] + 1) if step < 0 else np.minimum(high[hit], at[by] - reach - 1)
            open_, k = open_[~smaller], k[~smaller]
    return low, high


def pieces(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, int]]:
    """(rows, bytes, where each row's begin, place of the first byte in its text) of slices; long texts come in pieces of their own.

    Every string of ``width`` bytes lies in one piece only.
    """
    for batch in common.slices(batches, "text", PIECE):
        raw, offsets = rolling.flat(batch.column("text"))
        if batch.num_rows > 1 or len(raw) <= PIECE:
            yield batch, raw, offsets, 0
            continue
        for at in range(0, len(raw) - width + 1, PIECE):
            part = raw[at : at + PIECE + width - 1]
            yield batch, part, np.array([0, len(part)]), at


def _columns(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    ids, prints = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("id", "print"))
    return ids, prints


def _send_anchors(width: int, gram: int, bits: int, chunk: int):
    codecs = {0: ranges.Places()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[ranges.Rows] = []
        n = 0
        for batch, raw, offsets, base in pieces(batches, width):
            ids, prints = _columns(batch)
            at, doc, hashes = anchors(raw, offsets, width, gram)
            held.append({"first": rolling.mix(hashes), "last": np.zeros(len(at), np.uint64), "id": ids[doc], "print": prints[doc], "pos": at - offsets[doc] + base})
            n += len(at)
            if n >= chunk:
                yield from ranges.deal(held, codecs, 0, bits)
                n = 0
        if n:
            yield from ranges.deal(held, codecs, 0, bits)
        common.release()

    return run


def _again(hot: int):
    def decide(kind: int, rows: ranges.Rows) -> ranges.Rows:
        """Anchors that occur again, as spans that begin at four times their place, plus two where the anchor is hot."""
        rows = ranges.taken(rows, np.argsort(rows["first"], kind="stable"))
        first = ranges.edges(rows["first"])
        counts = np.diff(np.append(first, len(rows["first"])))
        counts = np.repeat(counts, counts)
        rows["pos"] = 4 * rows["pos"] + 2 * (counts > hot)
        return ranges.spans(rows, counts > 1, 0, 1)

    return decide


class Contexts:
    """Contexts of anchors: ``gram`` and ``whole`` hashes, id, print, place, bytes owned left and right of the place, and ``text``."""

    NAMES = ("gram", "whole", "id", "print", "pos", "left", "right")
    TYPES = ("<u8", "<u8", "<i8", "<u4", "<u4", "<u1", "<u1")

    def __init__(self, span: int) -> None:
        self.span = span

    def key(self, rows: ranges.Rows) -> np.ndarray:
        return rows["gram"]

    def fold(self, rows: ranges.Rows) -> tuple[ranges.Rows, ranges.Rows]:
        """The earliest of contexts with equal bytes, and the spans of the later ones."""
        rows = ranges.taken(rows, np.lexsort((rows["pos"], rows["id"], rows["whole"], rows["gram"])))
        n = len(rows["gram"])
        new = np.zeros(n, np.int64)
        new[ranges.edges(rows["gram"], rows["whole"])] = 1
        lead = np.maximum.accumulate(np.where(new, np.arange(n), 0))
        equal = np.empty(n, bool)
        for at in range(0, n, 1 << 14):  # hashes only bring equal bytes together
            equal[at : at + (1 << 14)] = (rows["text"][at : at + (1 << 14)] == rows["text"][lead[at : at + (1 << 14)]]).all(axis=1)
        # rows of one id at one place are one document twice: neither is earlier
        late = equal & ~((rows["id"] == rows["id"][lead]) & (rows["pos"] == rows["pos"][lead]))
        begin, end = -rows["left"][late].astype(np.int64), rows["right"][late].astype(np.int64)
        return ranges.taken(rows, ~late), ranges.spans(rows, late, begin, end)

    def pack(self, rows: ranges.Rows, bits: int) -> bytes:
        return b"".join([np.int64(len(rows["gram"])).tobytes(), *[rows[n].astype(t).tobytes() for n, t in zip(self.NAMES, self.TYPES, strict=True)], rows["text"].tobytes()])

    def unpack(self, raw: bytes, part: int, bits: int) -> ranges.Rows:
        n, at, rows = int(np.frombuffer(raw, "<i8", 1)[0]), 8, {}
        for name, kind in zip(self.NAMES, self.TYPES, strict=True):
            column = np.frombuffer(raw, kind, n, at)
            rows[name] = column.astype(np.int64) if name in ("print", "pos") else column
            at += n * np.dtype(kind).itemsize
        return {**rows, "text": np.frombuffer(raw, np.uint8, n * self.span, at).reshape(n, self.span)}


def _codecs(width: int, gram: int, level: int, extra: int) -> dict[int, ranges.Codec]:
    return {_CONTEXTS: Contexts(2 * width - gram), _STRINGS: ranges.Places(width, extra), ranges.SPANS: ranges.Spans(level)}


def _send_contexts(width: int, gram: int, bits: int, chunk: int, codecs: dict[int, ranges.Codec]):
    before, span = width - gram, 2 * width - gram

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[ranges.Rows] = []
        strings: list[ranges.Rows] = []
        n = n_strings = 0
        for batch, raw, offsets, base in pieces(batches, width):
            ids, prints = _columns(batch)
            marks = [np.frombuffer(x, "<u4").reshape(-1, 2)[:, 0].astype(np.int64) for x in batch.column("spans").to_pylist()]
            marks = [m[(m >> 2 >= base) & (m >> 2 < base + len(raw))] for m in marks]
            again = np.concatenate([(m >> 2) - base + o for m, o in zip(marks, offsets[:-1].tolist(), strict=True)])
            at, doc, hashes = anchors(raw, offsets, width, gram)
            first, last = owned(at, doc, hashes, offsets[doc + 1], offsets[doc], width, gram)
            use = np.isin(at, again) & (first <= last)
            if not use.any():
                continue
            at, doc, hashes, first, last = at[use], doc[use], hashes[use], first[use], last[use]
            is_hot = np.isin(at, again[(np.concatenate(marks) & 2).astype(bool)])
            if is_hot.any():
                counts = (last - first + 1)[is_hot]
                begin = np.repeat(first[is_hot] - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
                owner = np.repeat(doc[is_hot], counts)
                high, low = rolling.window_pairs(rolling.byte_pairs(raw), width)
                strings.append({"first": high[begin], "last": low[begin], "id": ids[owner], "print": prints[owner], "pos": begin - offsets[owner] + base})
                n_strings += len(begin)
                at, doc, hashes, first, last = (x[~is_hot] for x in (at, doc, hashes, first, last))
            sums = np.zeros(len(raw) + 1, np.uint64)
            np.cumsum(rolling.byte_symbols(raw) * rolling.powers(len(raw))[: len(raw)], out=sums[1:])
            whole = (sums[last + width] - sums[first]) * rolling.powers(len(raw), rolling._INVERSE)[first]  # noqa: SLF001
            left, right = at - first, last + width - at
            padded = np.concatenate([np.zeros(before, np.uint8), raw, np.zeros(span, np.uint8)])
            text = np.lib.stride_tricks.sliding_window_view(padded, span)[at]  # a copy of these rows only
            place = np.arange(-before, width)
            text[(place < -left[:, None]) | (place >= right[:, None])] = 0xFF  # no byte of UTF-8
            held.append(
                {
                    "gram": rolling.mix(hashes), "whole": rolling.mix(whole) + left.astype(np.uint64) * np.uint64(256) + right.astype(np.uint64), "id": ids[doc],
                    "print": prints[doc], "pos": at - offsets[doc] + base, "left": left.astype(np.uint8), "right": right.astype(np.uint8), "text": text,
                }
            )
            n += len(at)
            if n >= chunk:
                yield from ranges.deal(held, codecs, _CONTEXTS, bits)
                n = 0
            if n_strings >= 16 * chunk:
                yield from ranges.deal(strings, codecs, _STRINGS, bits)
                n_strings = 0
        if n:
            yield from ranges.deal(held, codecs, _CONTEXTS, bits)
        if n_strings:
            yield from ranges.deal(strings, codecs, _STRINGS, bits)
        held = strings = None
        common.release()

    return run


def _decide(width: int, gram: int, codecs: dict[int, ranges.Codec]):
    def decide(kind: int, rows: ranges.Rows) -> ranges.Rows:
        """The strings of one range that also start earlier."""
        if kind == _STRINGS:
            return codecs[kind].fold(rows)[1]
        late = [ranges.spans(rows, np.empty(0, np.int64), 0, 0)]
        rows = ranges.taken(rows, np.lexsort((rows["pos"], rows["id"], rows["gram"])))
        first = ranges.edges(rows["gram"])
        sizes = np.diff(np.append(first, len(rows["gram"])))
        rows = ranges.taken(rows, np.repeat(sizes > 1, sizes))
        first = ranges.edges(rows["gram"])
        a = 0
        while a < len(rows["gram"]):
            b = int(first[np.searchsorted(first, a + BLOCK_CONTEXTS, "right") - 1]) if a + BLOCK_CONTEXTS < len(rows["gram"]) else len(rows["gram"])
            if b <= a:  # one anchor with more contexts
                after = np.searchsorted(first, a, "right")
                b = int(first[after]) if after < len(first) else len(rows["gram"])
            late.append(late_strings(ranges.taken(rows, np.arange(a, b)), width, gram))
            a = b
        return ranges.merged_spans(ranges.joined(late))

    return decide


def _shared(text: np.ndarray, order: np.ndarray) -> np.ndarray:
    """How many leading bytes each row in the order shares with the one before it."""
    out = np.zeros(len(order), np.int64)
    for at in range(1, len(order), 1 << 14):
        to = min(len(order), at + (1 << 14))
        differs = text[order[at:to]] != text[order[at - 1 : to - 1]]
        out[at:to] = np.where(differs.any(axis=1), differs.argmax(axis=1), text.shape[1])
    return out


def _symbols(text: np.ndarray) -> np.ndarray:
    """Rows of bytes as rows of big-endian 8-byte numbers, in the order of the bytes."""
    padded = np.zeros((len(text), -(-text.shape[1] // 8) * 8), np.uint8)
    padded[:, : text.shape[1]] = text
    return padded.view(">u8").astype(np.uint64)


def late_strings(rows: ranges.Rows, width: int, gram: int) -> ranges.Rows:
    """Spans of the strings that also start earlier, for contexts in the order (gram, id, pos): by one suffix array."""
    n, before = len(rows["gram"]), width - gram
    text = rows["text"]
    right, left = np.ascontiguousarray(text[:, width:]), np.ascontiguousarray(text[:, :before][:, ::-1])
    halves = [_symbols(right), _symbols(left)]
    count = halves[0].shape[1]
    # one sequence: right symbols, separator, left symbols, separator, for each context, and a sentinel
    sequence = np.empty((n, 2, count + 1), np.int64)
    sequence[:, :, :count] = 1 + 2 * n + np.unique(np.stack(halves, axis=1).ravel(), return_inverse=True)[1].reshape(n, 2, count)
    sequence[:, :, count] = 1 + np.arange(2 * n).reshape(n, 2)
    order = suffix_array(np.append(sequence.ravel(), 0))
    starts = order[order % (count + 1) == 0][1:]  # behind the sentinel
    half, row = (starts // (count + 1)) % 2, starts // (2 * (count + 1))
    ordered = [row[half == 0], row[half == 1]]
    shared = [_shared(right, ordered[0]), _shared(left, ordered[1])]
    # contexts of one group have the same gram, by its bytes
    group = np.empty(n, np.int64)
    same = np.append(False, (rows["gram"][1:] == rows["gram"][:-1]) & (text[1:, before:width] == text[:-1, before:width]).all(axis=1))
    group[:] = np.cumsum(~same)
    reach_left, reach_right = rows["left"].astype(np.int64), rows["right"].astype(np.int64) - gram
    late_row, late_left = [], []
    for l in range(before + 1):  # noqa: E741  strings that begin so many bytes before their anchor
        r = before - l
        own = np.flatnonzero((reach_left >= l) & (reach_right >= r))
        if len(own) < 2:
            continue
        key = group[own]
        for side, depth in ((0, r), (1, l)):
            class_ = np.empty(n, np.int64)
            class_[ordered[side]] = np.cumsum(shared[side] < depth) if depth else 0
            key = key * (n + 1) + class_[own]
        by_key = np.argsort(key, kind="stable")  # contexts of a class stay in the order (id, pos)
        own, key = own[by_key], key[by_key]
        new = np.append(True, key[1:] != key[:-1])
        lead = own[np.maximum.accumulate(np.where(new, np.arange(len(own)), 0))]
        late = (rows["id"][own] != rows["id"][lead]) | (rows["pos"][own] != rows["pos"][lead])
        late_row.append(own[late])
        late_left.append(np.full(int(late.sum()), l))
    which = np.concatenate(late_row) if late_row else np.empty(0, np.int64)
    begin = -np.concatenate(late_left) if late_row else which
    return ranges.merged_spans(ranges.spans(rows, which, begin, begin + width))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in common.slices(batches, "text", 4 << 20):
        texts, removed, spans = [], [], []
        for text, blob in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True):
            runs = np.frombuffer(blob, "<u4").reshape(-1, 2).tolist() if blob else []
            kept, at = [], 0
            for x, y in runs:
                kept.append(text[at:x])
                at = y
            texts.append(b"".join([*kept, text[at:]]) if runs else text)
            removed.append(sum(y - x for x, y in runs))
            spans.append([{"begin": x, "end": y} for x, y in runs])
        sizes = [len(x) for x in batch.column("text").to_pylist()]
        yield pa.record_batch(
            [
                batch.column("id"), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()),
                pa.array(spans, pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())]))), pa.array(texts, pa.binary()),
            ],
            ["id", "n_bytes", "n_removed", "spans", "kept"],
        )


def suffix_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 100, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """(id, n_bytes, n_removed, spans, kept) for every row; ``kept`` is binary, the bytes that stay.

    A byte goes if a string of ``width`` bytes (at most 200) covers it that also starts earlier: in a smaller id,
    or earlier in the same id. Strings are judged on the input and never cross documents; ``spans``
    are the maximal removed runs.

    A null or empty text has no bytes; texts shorter than ``width`` stay whole. A null id comes
    before every other id. Rows that share an id count as one document: equal strings at the same
    place leave each other alone. An empty table gives an empty result.
    """
    size = common.plan_bytes(df)
    bits = ranges.range_bits(size)
    level = min(bits, ranges.LEVEL_BITS)
    docs = df.select(common.id_in(id_col).alias("id"), common.text_in(text_col).alias("text"))
    docs = docs.withColumn("print", F.xxhash64("text").bitwiseAND(F.lit(0xFFFFFFFF))).select("id", "print", "text")

    places: dict[int, ranges.Codec] = {0: ranges.Places(), ranges.SPANS: ranges.Spans(level)}
    sent = ranges.exchanged(docs.mapInArrow(_send_anchors(width, gram, level, CHUNK_ANCHORS), ranges.SENT), places, bits, level, CHUNK_ANCHORS)
    marks = ranges.resolved(sent, places, _again(hot), bits, CHUNK_ANCHORS)
    suspect = docs.join(marks.hint("shuffle_hash"), ["id", "print"]).select("id", "print", "text", "spans")

    codecs = _codecs(width, gram, level, ranges.extra_bytes(size, bits))
    contexts = ranges.exchanged(suspect.mapInArrow(_send_contexts(width, gram, level, CHUNK_CONTEXTS, codecs), ranges.SENT), codecs, bits, level, CHUNK_CONTEXTS)
    late = ranges.resolved(contexts, codecs, _decide(width, gram, codecs), bits, CHUNK_CONTEXTS)
    schema = "id long, n_bytes long, n_removed long, spans array<struct<begin: int, end: int>>, kept binary"
    out = found.applied(docs, late, _cut, schema, ["id", "print"])
    return out.select(common.id_out(F.col("id")).alias(id_col), "n_bytes", "n_removed", "spans", "kept")
