"""Operator 12, byte-level BPE by monoid tree reduction.

Encodings of neighbouring strings combine: ``join`` takes the encodings of two strings and gives the encoding of both
together, so a string is encoded by halves, recursively, and the halves are joined up the tree.

*Tokens of one match.* Two adjacent tokens fit if their bytes alone encode to just these two. A sequence is the encoding of
its bytes exactly if all neighbours fit: look at the first merge of the whole that crosses a border; until then both tokens
next to it went through the merges that they go through alone, so that merge would also cross the border of the two alone.
Hence a join re-encodes a window of tokens around the border, twice as many on a side that does not fit its neighbour
outside, and is done when both sides fit: no token outside the window can change any more.

*Matches of a text.* A match of the pattern is decided by its own characters, the one after it and at most two after its
first; where a match begins, the rest follows from the text behind. So a join scans anew from the left half's first match
that the border may change until a match ends where one of the right half ends; all matches beyond stay.

Decoding concatenates the tokens' bytes up a tree.
"""

from __future__ import annotations

import base64
import heapq
import struct
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import common

_LEAF_BYTES = 6
_LEAF_CHARS = 1 << 14
_LEAF_TOKENS = 1 << 12
_SCAN_BYTES = 48
_SLICE_BYTES = 1 << 19
_CACHE_WORDS = 250_000
_CACHE_CHARS = 256
_NEVER = 1 << 60


@dataclass(frozen=True)
class Encoded:
    """Characters [begin, ends[-1]) of a text: where each match ends, how many tokens it has, and all tokens."""

    begin: int
    ends: np.ndarray
    sizes: np.ndarray
    ids: np.ndarray


class TreeBpe:
    """Encoder and decoder for a file of ranked byte strings, each match of ``pattern`` separately."""

    def __init__(self, path: str, pattern: str) -> None:
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.strings = [b""] * (max(self.ranks.values(), default=-1) + 1)
        for token, i in self.ranks.items():
            self.strings[i] = token
        self.longest = max(map(len, self.ranks), default=0)
        self.pattern = regex.compile(pattern)
        self.leaf = lru_cache(1 << 16)(self.merge)
        self.fit: dict[int, bool] = {}
        self.cache: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.kinds: dict[str, str] = {}

    # one match: a sequence of tokens

    def merge(self, raw: bytes) -> list[int]:
        """Merge the leftmost of the lowest-ranked neighbours until none is known."""
        ranks = self.ranks.get
        if len(raw) <= _SCAN_BYTES:
            parts = [raw[k : k + 1] for k in range(len(raw))]
            lowest = [ranks(raw[k : k + 2], _NEVER) for k in range(len(raw) - 1)]
            while lowest and (rank := min(lowest)) != _NEVER:
                k = lowest.index(rank)
                parts[k] += parts.pop(k + 1)
                del lowest[k]
                if k < len(lowest):
                    lowest[k] = ranks(parts[k] + parts[k + 1], _NEVER)
                if k:
                    lowest[k - 1] = ranks(parts[k - 1] + parts[k], _NEVER)
            return [self.ranks[p] for p in parts]
        n = len(raw)
        end, before = list(range(1, n + 1)), list(range(-1, n))  # of the part that begins at k
        heap = [(r, k, k + 1, k + 2) for k in range(n - 1) if (r := ranks(raw[k : k + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, k, mid, to = heapq.heappop(heap)
            if end[k] != mid or mid >= n or end[mid] != to:
                continue  # one of the two parts has changed since
            end[k], end[mid] = to, -1
            if to < n:
                before[to] = k
            for a, b in ((before[k], k), (k, to)):
                if a >= 0 and b < n and (r := ranks(raw[a : end[b]])) is not None:
                    heapq.heappush(heap, (r, a, b, end[b]))
        out, k = [], 0
        while k < n:
            out.append(self.ranks[raw[k : end[k]]])
            k = end[k]
        return out

    def fits(self, a: int, b: int) -> bool:
        key = a << 32 | b
        known = self.fit.get(key)
        if known is None:
            if len(self.fit) > 1 << 20:
                self.fit.clear()
            known = self.fit[key] = self.merge(self.strings[a] + self.strings[b]) == [a, b]
        return known

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The tokens of both strings together."""
        if not left or not right or self.fits(left[-1], right[0]):
            return left + right
        i = j = 1
        while True:
            raw = self.decode([*left[-i:], *right[:j]])
            window = self.leaf(raw) if len(raw) <= _SCAN_BYTES else self.merge(raw)
            stays = i == len(left) or self.fits(left[-i - 1], window[0]), j == len(right) or self.fits(window[-1], right[j])
            if all(stays):
                return left[:-i] + window + right[j:]
            i, j = min(len(left), i if stays[0] else 2 * i), min(len(right), j if stays[1] else 2 * j)

    def tree(self, raw: bytes) -> list[int]:
        if len(raw) <= _LEAF_BYTES:
            return self.leaf(raw)
        mid = len(raw) // 2
        return self.join(self.tree(raw[:mid]), self.tree(raw[mid:]))

    def match(self, text: str) -> bytes:
        """A match's ids as little-endian unsigned 32-bit integers; one that is a token by itself is that token."""
        found = self.cache.get(text)
        if found is None:
            found = self.older.get(text)
            if found is None:
                raw = text.encode()
                whole = self.ranks.get(raw)
                ids = self.tree(raw) if whole is None else [whole]
                found = struct.pack(f"<{len(ids)}I", *ids)
            if len(text) <= _CACHE_CHARS:
                if len(self.cache) >= _CACHE_WORDS:  # words that are met again stay
                    self.older, self.cache = self.cache, {}
                self.cache[text] = found
        return found

    # a text: a sequence of matches

    def _kind(self, c: str) -> str:
        """A common character of the class that the library's own tables give ``c``."""
        if c not in self.kinds:
            import tiktoken

            single = {bytes([b]): b for b in range(256)}
            held = [s for s, p in (("a", r"\p{L}"), ("1", r"\p{N}"), (" ", r"\s")) if tiktoken.Encoding(p, pat_str=p, mergeable_ranks=single, special_tokens={}).encode_ordinary(c)]
            self.kinds[c] = held[0] if held else "!"
        return self.kinds[c]

    def shape(self, text: str) -> str:
        """The text to match on: characters that are not assigned yet, on which tables differ, give way to others of their class."""
        if text.isascii():
            return text
        odd = {c for c in set(text) if unicodedata.category(c) == "Cn"}
        return text.translate({ord(c): self._kind(c) for c in odd}) if odd else text

    def _scan(self, text: str, shape: str, begin: int, end: int) -> Encoded:
        if shape is text and begin == 0 and end == len(text):
            words = self.pattern.findall(text)
        else:
            words = [text[m.start() : m.end()] for m in self.pattern.finditer(shape, begin, end)]
        return self._encoded(begin, words, [self.match(w) for w in words])

    @staticmethod
    def _encoded(begin: int, words: list[str], ids: list[bytes]) -> Encoded:
        ends = begin + np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))
        return Encoded(begin, ends, np.fromiter(map(len, ids), np.int64, len(ids)) // 4, np.frombuffer(b"".join(ids), "<u4"))

    def _halves(self, text: str, shape: str, begin: int, end: int) -> Encoded:
        if end - begin <= _LEAF_CHARS:
            return self._scan(text, shape, begin, end)
        mid = (begin + end) // 2
        return self._joined(text, shape, self._halves(text, shape, begin, mid), self._halves(text, shape, mid, end))

    def _joined(self, text: str, shape: str, left: Encoded, right: Encoded) -> Encoded:
        mid, end = right.begin, int(right.ends[-1])
        starts = np.append(left.begin, left.ends[:-1])
        first = int(np.count_nonzero(np.maximum(left.ends + 1, starts + 3) <= mid))  # before it, no match looks beyond the border
        words, ids, last = [], [], int(starts[-1])
        for m in self.pattern.finditer(shape, int(starts[first]), end):
            word = text[m.start() : m.end()]
            words.append(word)
            ids.append(self._across(word, mid - last, left, right) if m.start() == last and m.end() == right.ends[0] else self.match(word))
            at = int(np.searchsorted(right.ends, m.end()))
            if m.end() == mid or (at < len(right.ends) and right.ends[at] == m.end()):
                break
        at = 0 if m.end() == mid else at + 1
        new = self._encoded(int(starts[first]), words, ids)
        kept, gone = int(left.sizes[:first].sum()), int(right.sizes[:at].sum())
        return Encoded(
            left.begin,
            np.concatenate([left.ends[:first], new.ends, right.ends[at:]]),
            np.concatenate([left.sizes[:first], new.sizes, right.sizes[at:]]),
            np.concatenate([left.ids[:kept], new.ids, right.ids[gone:]]),
        )

    def _across(self, word: str, cut: int, left: Encoded, right: Encoded) -> bytes:
        """A match that is the left half's last one and the right half's first one together."""
        if min(cut, len(word) - cut) <= self.longest:  # a part as short may be a token that only whole matches become
            return self.match(word)
        parts = left.ids[len(left.ids) - int(left.sizes[-1]) :].tolist(), right.ids[: int(right.sizes[0])].tolist()
        return np.array(self.join(*parts), "<u4").tobytes()

    def encode(self, text: str) -> np.ndarray:
        """The text's ids, unsigned 32-bit."""
        shape = self.shape(text)
        if shape is text and len(text) <= _LEAF_CHARS:  # one leaf, nothing to join
            words = self.pattern.findall(text)
            ids = list(map(self.cache.get, words))
            if None in ids:
                ids = [self.match(w) if found is None else found for w, found in zip(words, ids, strict=True)]
            return np.frombuffer(b"".join(ids), "<u4")
        return self._halves(text, shape, 0, len(text)).ids

    def decode(self, ids: list[int]) -> bytes:
        if len(ids) <= _LEAF_TOKENS:
            return b"".join(map(self.strings.__getitem__, ids))
        mid = len(ids) // 2
        return self.decode(ids[:mid]) + self.decode(ids[mid:])


@lru_cache(maxsize=2)
def tree_bpe(path: str, pattern: str) -> TreeBpe:
    return TreeBpe(path, pattern)


def encode_decode(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids, n_tokens, decoded): every whole text's ids, and the bytes that they decode to.

    ``ids``: little-endian unsigned 32-bit integers, without special tokens, whose strings are ordinary text. ``pattern``
    must match every character and look ahead no further than the module says. A null text counts as empty (no ids, no
    bytes); a null id stays null; repeated rows give repeated results; an empty table gives an empty result; other columns
    are not read. A long text is one row of one task, which holds some twenty bytes for each of its tokens. No shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tree_bpe(path, pattern)
        for batch in common.slices(batches, "text", _SLICE_BYTES):
            ids = [bpe.encode(x.decode("utf-8", "replace")) for x in batch.column("text").to_pylist()]
            yield pa.record_batch(
                [
                    batch.column("id"),
                    pa.array([x.tobytes() for x in ids], pa.binary()),
                    pa.array([len(x) for x in ids], pa.int64()),
                    pa.array([bpe.decode(x.tolist()) for x in ids], pa.binary()),
                ],
                ["id", "ids", "n_tokens", "decoded"],
            )

    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), common.text_in(text_col).alias("text"))
    return rows.mapInArrow(run, "id long, ids binary, n_tokens long, decoded binary").withColumnRenamed("id", id_col)
