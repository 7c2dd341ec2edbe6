"""Byte-level BPE: texts to ids by a local rank file, and ids back to bytes.

Long texts are cut before matching, only where the pattern can never match across: between a character that is not
white space and a following space or newline, or between a letter (digit) and a character that is neither letter
(digit) nor white space. A stretch of over four chunks without such a place (a run of white space, say) is matched by
a second regular-expression engine whose stack does not grow with the run, and each match is merged by itself.
Null texts count as empty and have no ids.
"""

from __future__ import annotations

import base64
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows

#: Characters of a text that are matched at once.
CHUNK = 1 << 16


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@lru_cache(maxsize=2)
def codec(ranks_path: str) -> Codec:
    return Codec(ranks_path)


class Codec:
    def __init__(self, ranks_path: str, chunk: int = CHUNK):
        import public_tokenizers
        import regex
        import tiktoken

        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.chunk = chunk
        self.tokens = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        space = r"\p{White_Space}"
        self.pieces = regex.compile(public_tokenizers.PATTERN.replace(r"[^\s", f"[^{space}").replace(r"\S", r"\P{White_Space}").replace(r"\s", space))
        self.cut = regex.compile(rf"(?<=[^{space}\x1c-\x1f])(?=[ \n])|(?<=\p{{L}})(?=[^\p{{L}}{space}\x1c-\x1f])|(?<=\p{{N}})(?=[^\p{{N}}{space}\x1c-\x1f])")

    def chunks(self, text: str):
        start = 0
        while len(text) - start > self.chunk:
            found = self.cut.search(text, start + self.chunk)
            if not found:
                break
            yield text[start : found.start()]
            start = found.start()
        yield text[start:]

    def encode(self, text: str | None) -> np.ndarray:
        if not text:
            return np.empty(0, np.int32)
        parts = []
        for chunk in self.chunks(text):
            if len(chunk) <= 4 * self.chunk:
                ids = self.tokens.encode_ordinary(chunk)
            else:
                ids = [i for m in self.pieces.finditer(chunk) for i in self.tokens._encode_single_piece(m[0])]
            parts.append(np.array(ids, np.int32))
        return parts[0] if len(parts) == 1 else np.concatenate(parts)

    def decode(self, ids) -> bytes:
        return self.tokens.decode_bytes(ids)


def encode(df: DataFrame, ranks_path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>, decoded binary) of each row; decoded is made from the ids and equals the text's UTF-8 bytes.
    Other columns of df are left out. An empty table gives an empty table; repeated rows are encoded each."""
    path, kind = ranks_path or default_ranks(), df.schema[id_col].dataType.simpleString()

    def make():
        own = codec(path)

        def row(key, text):
            ids = own.encode(text)
            yield key, ids, own.decode(ids.tolist())

        return row

    return map_rows(df, [id_col, text_col], f"`{id_col}` {kind}, ids array<int>, decoded binary", make)


def digests(encoded: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Token count, and digests of the ids and of the decoded bytes."""
    return encoded.select(
        id_col,
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
