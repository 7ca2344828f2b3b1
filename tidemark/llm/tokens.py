"""Operator 1, token counts, and the byte-level encoder that packing shares.

Texts reach the encoder in Arrow slices balanced by bytes. A long text is split at safe
boundaries only: in front of white space that follows a character which is not white space. The
pre-tokenizer's pattern never matches across such a place and looks ahead only over white space,
so the pieces' tokens are exactly the whole text's tokens. Special strings hold no white space and
so are never cut.
"""

from __future__ import annotations

import base64
import json
import re
from collections.abc import Iterator
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import common

#: Unicode's White_Space characters (fixed values).
WHITE = "\t\n\x0b\x0c\r \x85\xa0 " + "".join(map(chr, range(0x2000, 0x200B))) + "    　"
_SAFE = re.compile(f"(?<=[^{WHITE}])(?=[\t\n\x0b\x0c\r ])")
_LONG_SPACE = re.compile(f"[{WHITE}]{{2000}}")
_BATCH_BYTES = 4 << 20
_PIECE_CHARS = 1 << 16
_WORD_CHARS = 1 << 13


def safe_pieces(text: str, size: int = _PIECE_CHARS) -> Iterator[str]:
    """Cut ``text`` at safe boundaries into pieces of about ``size`` characters or one word."""
    at = 0
    while len(text) - at > size:
        found = _SAFE.search(text, at + size)
        if not found:
            break
        yield text[at : found.start()]
        at = found.start()
    yield text[at:]


class Encoder:
    """Byte-level BPE ids as the tokenizers library gives them, as little-endian uint32 arrays.

    Ordinary pieces go through the rank table of the same vocabulary, which is several times
    faster; a piece with one very long word or run of white space goes through the tokenizers
    library itself, which handles those in bounded stack and time.
    """

    def __init__(self, json_path: str, ranks_path: str) -> None:
        import tiktoken
        from public_tokenizers import PATTERN

        self.json_path = json_path
        with open(json_path, encoding="utf-8") as f:
            special = {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}
        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.fast = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)

    @cached_property
    def slow(self):
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.json_path)

    def encode(self, text: str) -> np.ndarray:
        found = [self._piece(p) for p in safe_pieces(text)]
        return found[0] if len(found) == 1 else np.concatenate(found)

    def _piece(self, piece: str) -> np.ndarray:
        if not piece:
            return np.empty(0, "<u4")
        if len(piece) > _WORD_CHARS and (_LONG_SPACE.search(piece) or max(map(len, piece.split(" "))) > _WORD_CHARS):
            return np.array(self.slow.encode(piece, add_special_tokens=False).ids, "<u4")
        return self.fast.encode_to_numpy(piece, allowed_special="all").astype("<u4", copy=False)


@lru_cache(maxsize=4)
def encoder(json_path: str, ranks_path: str) -> Encoder:
    return Encoder(json_path, ranks_path)


def token_counts(
    df: DataFrame, json_path: str, ranks_path: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(id, n_bytes, n_tokens) of every row's whole text, without special tokens added.

    A null text counts as empty (0 bytes, 0 tokens); a null id stays null; repeated rows give
    repeated results; an empty table gives an empty result. No shuffle.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(json_path, ranks_path).encode
        for batch in common.slices(batches, "text", _BATCH_BYTES):
            texts = batch.column("text").to_pylist()
            yield pa.record_batch(
                [
                    batch.column("id"),
                    pa.array([len(x) for x in texts], pa.int64()),
                    pa.array([len(encode(x.decode("utf-8", "replace"))) for x in texts], pa.int64()),
                ],
                ["id", "n_bytes", "n_tokens"],
            )

    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), common.text_in(text_col).alias("text"))
    return rows.mapInArrow(count, "id long, n_bytes long, n_tokens long").withColumnRenamed("id", id_col)
