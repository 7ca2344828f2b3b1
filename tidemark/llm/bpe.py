"""Operator 2, BPE encoding and decoding in batched numpy merge rounds.

The words of a slice that were not met before go through the merges together: the symbols of all
of them lie in one flat array, each round finds every word's lowest-ranked pair by binary search
over the sorted pair keys and merges all its places in that word, and words without a known pair
drop out. Very long words are merged one at a time from a heap, as rounds over them would cost
the square of their length.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from collections.abc import Iterator
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import common

_HEAP_BYTES = 512
_CACHE_WORDS = 120_000
_NONE = np.iinfo(np.int64).max


def byte_characters() -> list[str]:
    """The printable character that byte-level vocabularies write for each byte."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = iter(range(256, 512))
    return [chr(b) if b in kept else chr(next(other)) for b in range(256)]


class WordBpe:
    """Encoder and decoder for a vocabulary file with an end-of-word suffix."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab, suffix = model["vocab"], model["end_of_word_suffix"] or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.words = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]).findall
        marks = byte_characters()
        self.inner = np.array([vocab[c] for c in marks], np.int64)
        self.final = np.array([vocab[c + suffix] for c in marks], np.int64)
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.n = max([*vocab.values(), *self.special.values()]) + 1
        keys = np.array([vocab[a] * self.n + vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.ranked = {int(k): r for r, k in enumerate(keys)}
        self.strings = [b""] * self.n
        for token, i in {**vocab, **self.special}.items():
            self.strings[i] = token.encode()
        self.cache: dict[str, bytes] = {}
        self.path, self.byte_of = path, {c: b for b, c in enumerate(marks)}

    @cached_property
    def library(self):
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def _split_by_library(self, text: str) -> list[str]:
        """Words of a text with characters that Unicode's older versions do not assign, on which tables differ."""
        words = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))
        return [bytes(map(self.byte_of.__getitem__, w)).decode() for w, _ in words]

    def segments(self, text: str) -> Iterator[tuple[list[str], bytes]]:
        """Runs of words, each followed by a special token's id or nothing."""
        for k, part in enumerate(self.cut.split(text) if self.cut else [text]):
            if k % 2:
                yield [], int(self.special[part]).to_bytes(4, "little")
            elif not part.isascii() and any(unicodedata.category(c) == "Cn" for c in set(part)):
                yield self._split_by_library(part), b""
            elif part:
                part = part if unicodedata.is_normalized("NFC", part) else unicodedata.normalize("NFC", part)
                yield self.words(part.replace("Σ", "σ").lower()), b""  # lower() knows a final sigma; the normalizer doesn't

    def encode(self, texts: list[str]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit integers."""
        cut = [list(self.segments(t)) for t in texts]
        cache = self.cache
        new = list({w: None for text in cut for words, _ in text for w in words if w not in cache})
        if len(cache) + len(new) > _CACHE_WORDS:
            new = list({w: None for text in cut for words, _ in text for w in words})
            cache.clear()
        cache.update(zip(new, self.merge([w.encode() for w in new]), strict=True))
        get = cache.__getitem__
        return [b"".join([x for words, special in text for x in (*map(get, words), special)]) for text in cut]

    def decode(self, ids: bytes) -> bytes:
        """The tokens' strings with a space between them: the file names no decoder."""
        return b" ".join(map(self.strings.__getitem__, np.frombuffer(ids, "<u4").tolist()))

    def merge(self, words: list[bytes]) -> list[bytes]:
        out: list[bytes] = [b""] * len(words)
        long = [k for k, w in enumerate(words) if len(w) > _HEAP_BYTES]
        for k in long:
            out[k] = self._heap(words[k])
        short = np.array([k for k, w in enumerate(words) if len(w) <= _HEAP_BYTES], np.int64)
        if not len(short):
            return out
        flat = np.frombuffer(b"".join([words[k] for k in short]), np.uint8)
        sizes = np.array([len(words[k]) for k in short], np.int64)
        symbols = self.inner[flat]
        ends = np.cumsum(sizes)
        symbols[ends - 1] = self.final[flat[ends - 1]]
        word = np.repeat(np.arange(len(short)), sizes)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(symbols):
            inside = word[1:] == word[:-1]
            key = np.where(inside, symbols[:-1] * self.n + symbols[1:], -1)
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            rank = np.append(np.where(self.keys[at] == key, self.ranks[at], _NONE), _NONE)
            first = np.flatnonzero(np.append(True, ~inside))
            lowest = np.minimum.reduceat(rank, first)
            counts = np.diff(np.append(first, len(symbols)))
            per = np.repeat(lowest, counts)
            active = per != _NONE
            if not active.all():
                done.append((word[~active], symbols[~active]))
                symbols, word, rank, per = symbols[active], word[active], rank[active], per[active]
                if not len(symbols):
                    break
            hit = rank == per
            # of overlapping places (a pair of equal symbols in a run), every other one from the left
            run = np.flatnonzero(hit & ~np.append(False, hit[:-1]))
            index = np.flatnonzero(hit)
            start = run[np.searchsorted(run, index, "right") - 1]
            index = index[(index - start) % 2 == 0]
            symbols[index] = self.made[rank[index]]
            keep = np.ones(len(symbols), bool)
            keep[index + 1] = False
            symbols, word = symbols[keep], word[keep]
        where = np.concatenate([w for w, _ in done])
        order = np.argsort(where, kind="stable")
        ids = np.concatenate([s for _, s in done])[order].astype("<u4")
        ends = np.searchsorted(where[order], np.arange(len(short)), "right") * 4
        raw, before = ids.tobytes(), 0
        for k, end in zip(short.tolist(), ends.tolist(), strict=True):
            out[k] = raw[before:end]
            before = end
        return out

    def _heap(self, word: bytes) -> bytes:
        ids = self.inner[np.frombuffer(word, np.uint8)].tolist()
        ids[-1] = int(self.final[word[-1]])
        n = len(ids)
        after, before = [*range(1, n), -1], list(range(-1, n - 1))
        heap = [(r, k) for k in range(n - 1) if (r := self.ranked.get(ids[k] * self.n + ids[k + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            rank, k = heapq.heappop(heap)
            nxt = after[k]
            if ids[k] < 0 or nxt < 0 or self.ranked.get(ids[k] * self.n + ids[nxt]) != rank:
                continue
            ids[k], ids[nxt] = int(self.made[rank]), -1
            after[k] = after[nxt]
            if after[k] >= 0:
                before[after[k]] = k
            for a in (before[k], k):
                if a >= 0 and after[a] >= 0 and (r := self.ranked.get(ids[a] * self.n + ids[after[a]])) is not None:
                    heapq.heappush(heap, (r, a))
        return np.array([x for x in ids if x >= 0], "<u4").tobytes()


@lru_cache(maxsize=2)
def word_bpe(path: str) -> WordBpe:
    return WordBpe(path)


def encode_decode(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids, n_tokens, decoded): every whole text's ids, and the text that they decode to.

    ``ids``: little-endian unsigned 32-bit integers, without added special tokens. A null text
    counts as empty (no ids, empty text); a null id stays null; repeated rows give repeated
    results; an empty table gives an empty result. No shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = word_bpe(path)
        for batch in common.slices(batches, "text", 1 << 19):
            ids = bpe.encode([x.decode("utf-8", "replace") for x in batch.column("text").to_pylist()])
            yield pa.record_batch(
                [
                    batch.column("id"),
                    pa.array(ids, pa.binary()),
                    pa.array([len(x) // 4 for x in ids], pa.int64()),
                    pa.array([bpe.decode(x) for x in ids], pa.binary()),
                ],
                ["id", "ids", "n_tokens", "decoded"],
            )

    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), common.text_in(text_col).alias("text"))
    out = rows.mapInArrow(run, "id long, ids binary, n_tokens long, decoded binary")
    return out.withColumn("decoded", F.col("decoded").cast("string")).withColumnRenamed("id", id_col)
