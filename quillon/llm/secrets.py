"""Secrets in texts: three patterns, and strings that a tokenizer's vocabulary can hardly shorten.

Natural words, identifiers and numbers take few tokens for their length; random strings take many. A string of at
least RUN characters is a secret when it has at most RATIO characters a token, unless it is a digest, a UUID, a number,
an identifier of words or a part of a pattern's match. A part of an identifier is a word when in lower case it is one
token or has more than RATIO characters a token; parts of at most WORD letters are judged together: at least half of
them are one token, or all parts of the identifier together have more than RATIO letters a token. A null text is empty. Spans are in code points,
their end exclusive; spans that begin together are ordered by kind. All patterns take time in proportion to a text's
length, however long it is. Repeated rows are found each for itself, an empty table gives an empty one, and only the
two named columns are read (redact keeps the others as they are).
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import codec
from .common import map_rows

KINDS = ("assign", "access", "hex", "random")
#: A random string: least length, most characters a token.
RUN, RATIO = 20, 2.0
#: Letters up to which parts of an identifier are judged together.
WORD = 3

# The three patterns and what a match must have.
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
LEAST = {"assign": 6, "access": 20, "hex": 24}

#: Hexadecimal digits of the usual digests.
DIGEST_LENGTHS = (32, 40, 56, 64, 96, 128)
#: UUIDs; numbers.
PLAIN = re.compile(r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}|[0-9_/=+-]+")
#: Camel or snake case of parts of two letters or more; capitals. Each part but the first begins with a capital or a separator, so a string has one reading only.
IDENTIFIER = re.compile(r"[A-Z]?[a-z]{2,}([A-Z_/=+-][a-z]{2,})*[_-]?[0-9]{0,4}|[A-Z]+([_/=+-][A-Z]+)*[_-]?[0-9]{0,4}")
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
DIGEST = re.compile(r"[0-9a-f]+|[0-9A-F]+")


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


class Scanner:
    def __init__(self, ranks_path: str, run: int = RUN, ratio: float = RATIO):
        self.assign = re.compile(ASSIGN, re.I | re.A)
        # whole runs of the class: a shorter run fails from each of its places
        self.access = re.compile(ACCESS[:-1] + "{%d,}" % (LEAST["access"] - 4))
        self.hex = re.compile(HEX[:-1] + "{%d,}" % LEAST["hex"])
        self.string = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % run)
        self.codec, self.ratio = codec(ranks_path), ratio

    def base(self, text: str) -> list[tuple[int, int, str]]:
        """(start, place of the kind, end, kind)"""
        found = [(m.start(), 0, m.end()) for m in self.assign.finditer(text) if len(m[2]) >= LEAST["assign"]]
        found += [(m.start(), 1, m.end()) for m in self.access.finditer(text)]
        found += [(m.start(), 2, m.end()) for m in self.hex.finditer(text)]
        return sorted(found)

    def are_words(self, parts: list[str]) -> bool:
        sizes = [(len(p), len(self.codec.encode(p.lower()))) for p in parts]
        if not all(n == 1 or size > self.ratio * n for size, n in sizes if size > WORD):
            return False
        short = [n for size, n in sizes if size <= WORD]
        return 2 * short.count(1) >= len(short) or sum(size for size, _ in sizes) > self.ratio * sum(n for _, n in sizes)

    def is_random(self, s: str) -> bool:
        if PLAIN.fullmatch(s) or len(s) in DIGEST_LENGTHS and DIGEST.fullmatch(s):
            return False
        if IDENTIFIER.fullmatch(s) and self.are_words(PART.findall(s)):
            return False
        return len(s) <= self.ratio * len(self.codec.encode(s))

    def scan(self, text: str) -> list[tuple[int, int, int]]:
        found = self.base(text)
        taken, more = iter([*found, (len(text), 0, len(text))]), []
        start, _, end = next(taken)
        for m in self.string.finditer(text):
            while end <= m.start() and start < len(text):
                start, _, end = next(taken)
            if not (start < m.end() and m.start() < end) and self.is_random(m[0]):
                more.append((m.start(), 3, m.end()))
        return sorted(found + more)


def find(df: DataFrame, ranks_path: str | None = None, id_col: str = "doc_id", text_col: str = "text", run: int = RUN, ratio: float = RATIO) -> DataFrame:
    """(id, found array<struct<kind, start, end>>) of each row, by start, then kind. Other columns are left out."""
    path, kind = ranks_path or default_ranks(), df.schema[id_col].dataType.simpleString()

    def make():
        scanner = Scanner(path, run, ratio)

        def row(key, text):
            yield key, [{"kind": KINDS[k], "start": a, "end": b} for a, k, b in scanner.scan(text or "")]

        return row

    return map_rows(df, [id_col, text_col], f"`{id_col}` {kind}, found array<struct<kind:string,start:bigint,end:bigint>>", make)


def redact(df: DataFrame, text_col: str = "text", mark: str = "[SECRET]", ranks_path: str | None = None) -> DataFrame:
    """df with each span found in text_col replaced by mark, overlapping spans by one. Texts without spans, null ones too, stay."""
    path, ddl = ranks_path or default_ranks(), ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    at = df.columns.index(text_col)

    def make():
        scanner = Scanner(path)

        def row(*values):
            text, out, done = values[at] or "", [], 0
            for a, _, b in scanner.scan(text):
                if b > done:
                    out += [text[done:a], mark] if a >= done else []
                    done = b
            yield values if not out else (*values[:at], "".join(out) + text[done:], *values[at + 1 :])

        return row

    return map_rows(df, df.columns, ddl, make)


def digests(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts, the digest of the patterns' spans, and all spans as text."""
    base = F.filter("found", lambda x: x.kind != "random")
    listed = lambda a: F.array_join(F.transform(a, lambda x: F.concat_ws(":", x.kind, x.start.cast("string"), x.end.cast("string"))), ",")
    of = lambda kind: F.size(F.filter("found", lambda x: x.kind == kind)).cast("long").alias(f"n_{kind}")
    counts = [of(kind) for kind in KINDS[:3]]
    return found.select(id_col, *counts, F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"), listed(F.col("found")).alias("spans"))
