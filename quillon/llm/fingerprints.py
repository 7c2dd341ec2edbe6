"""Document fingerprints: the k smallest hashes of a text's shingles (a bottom-k sketch).

A shingle is WIDTH consecutive bytes of the UTF-8 text; a shorter text that is not empty is one shingle. Sketches of
parts merge into the sketch of the whole (but for shingles across the seam), and estimate resemblance, containment
and the number of distinct shingles. With fewer than k shingles the estimates are exact. Null texts are empty; an empty
text has the empty sketch. Ids may be null, repeated and of any orderable type; repeated rows are rows of their own.
Other columns, whatever their names, are left out; an empty table gives an empty one. A very long text takes memory in
proportion to its own length.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import ranges
from .common import map_rows, ordered

WIDTH, K = 12, 128


def hashes(data: bytes, width: int = WIDTH) -> np.ndarray:
    """Distinct 64-bit hashes of the shingles, ascending."""
    if not data:
        return np.empty(0, np.uint64)
    width = min(width, len(data))
    n = len(data) - width + 1
    data += b"\0" * 8
    h = np.full(n, width, np.uint64)
    for at in range(0, width, 8):
        part = np.ndarray((n,), "<u8", data, at, (1,))
        if width - at < 8:
            part = part & np.uint64((1 << 8 * (width - at)) - 1)
        h = mixed(h ^ part)
    return np.unique(h)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def sketch(text: str | None, width: int = WIDTH, k: int = K) -> np.ndarray:
    return hashes((text or "").encode(), width)[:k]


def merge(a: np.ndarray, b: np.ndarray, k: int = K) -> np.ndarray:
    return np.union1d(a, b)[:k]


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimate of the Jaccard similarity; 1 for two empty sketches."""
    union = merge(a, b, k)
    if not len(union):
        return 1.0
    return len(np.intersect1d(np.intersect1d(a, b, True), union, True)) / len(union)


def count(a: np.ndarray, k: int = K) -> float:
    """Estimate of the number of distinct shingles."""
    return float(len(a)) if len(a) < k else (k - 1) * 2.0**64 / float(a[k - 1])


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimate of the share of a's shingles that b has."""
    size = count(a, k)
    return min(1.0, resemblance(a, b, k) * count(merge(a, b, k), k) / size) if size else 1.0


def to_text(a: np.ndarray) -> str:
    return a.astype(">u8").tobytes().hex()


def from_text(s: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(s), ">u8").astype(np.uint64)


def fingerprint(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, k: int = K) -> DataFrame:
    """(id, fingerprint, n_shingles) of each row; null and empty texts have the empty fingerprint."""
    kind = df.schema[id_col].dataType.simpleString()

    def make():
        def row(key, text):
            a = sketch(text, width, k)
            yield key, to_text(a), count(a, k)

        return row

    return map_rows(df, [id_col, text_col], f"`{id_col}` {kind}, fingerprint string, n_shingles double", make)


def merged(sketches: DataFrame, by: list[str], column: str = "fingerprint", k: int = K) -> DataFrame:
    """(by..., fingerprint, n_shingles): the union of the sketches of each group, as if its texts were the parts of one.

    Each task merges what it reads, so a hot group reaches its last task as about one sketch from each task before.
    """
    kinds = ", ".join(f"`{c}` {sketches.schema[c].dataType.simpleString()}" for c in by)

    def partial(rows):
        known: dict[tuple, np.ndarray] = {}
        for *key, text in rows:
            key, own = tuple(key), from_text(text or "")
            known[key] = merge(known[key], own, k) if key in known else own[:k]
            if len(known) > 10_000:
                yield from ((*g, to_text(a)) for g, a in known.items())
                known = {}
        yield from ((*g, to_text(a)) for g, a in known.items())

    def whole(rows):
        at, own = None, None
        for *key, text in rows:
            if at != key:
                if at is not None:
                    yield *at, to_text(own), count(own, k)
                at, own = key, from_text(text)
            else:
                own = merge(own, from_text(text), k)
        if at is not None:
            yield *at, to_text(own), count(own, k)

    parts = ordered(sketches.select(*by, column), f"{kinds}, fingerprint string", partial)
    return ordered(parts.repartition(*by).sortWithinPartitions(*by), f"{kinds}, fingerprint string, n_shingles double", whole)


def with_next(df: DataFrame, id_col: str, text_col: str, run, ddl: str) -> DataFrame:
    """run(iterator of (id, text, next text)) over the rows in ascending id; after the last row comes the first.

    Null ids come first; rows of one id follow each other by a hash of their text, then the text. The order is cut into
    ranges of about equal size; each is one sorted partition, which also borrows the first row of the next range. Only
    the least id and hash of each range pass through the driver, and a range is found by binary search among them.
    """
    keys = ("known", "id", "hash")
    df = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    df = df.select(F.col("id").isNotNull().alias("known"), "id", F.xxhash64("text").alias("hash"), "text")
    found = ranges.bounds(df, *keys)
    n = max(1, len(found))
    inner = ranges.as_array(df, found[1:], *keys)
    dealt = df.withColumn("part", ranges.number(F.struct(*keys), inner, n - 1))
    first = F.get(ranges.as_array(df, found, *keys), F.col("part")) == F.struct(*keys)
    # a range's first row is wanted by the range before it; of rows with one id and hash, the smallest text
    lent = dealt.filter(first).groupBy("part", *keys).agg(F.min(F.struct(F.col("text").isNotNull().alias("has"), "text")).alias("row"))
    lent = lent.select(*keys, F.col("row.text").alias("text"), F.pmod(F.col("part") - 1, F.lit(n)).cast("int").alias("part"), F.lit(True).alias("lent"))
    dealt = dealt.withColumn("lent", F.lit(False)).unionByName(lent).repartitionById(n, F.col("part"))
    dealt = dealt.sortWithinPartitions("lent", *keys, "text")

    def pairs(rows):
        last = None
        for key, text, lent in rows:
            if last:
                yield (*last, text)
            last = None if lent else (key, text)

    return ordered(dealt.select("id", "text", "lent"), ddl, lambda rows: run(pairs(rows)))


def edited(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, k: int = K) -> DataFrame:
    """Each row's fingerprint against that of its edited text, whose last quarter is the start of the next row's text, and against the next row's.

    Null texts are empty. A single row is its own next row. n_shingles and held estimate the text's distinct shingles,
    and the share of them that the edited text has.
    """
    import hashlib

    kind = df.schema[id_col].dataType.simpleString()
    ddl = f"`{id_col}` {kind}, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, n_shingles double, held double"

    def run(rows):
        known = None
        for key, text, after in rows:
            text, after = text or "", after or ""
            own = known if known is not None else sketch(text, width, k)
            known = sketch(after, width, k)
            cut = len(text) // 4
            new = text[: len(text) - cut] + after[:cut]
            other = sketch(new, width, k)
            yield key, len(text), hashlib.sha256(new.encode()).hexdigest(), to_text(own), to_text(other), resemblance(own, other, k), resemblance(own, known, k), count(own, k), containment(own, other, k)

    return with_next(df, id_col, text_col, run, ddl)
