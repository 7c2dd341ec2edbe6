"""Fill-in-the-middle: texts cut at two token boundaries, and written with their middle last.

A unit is a run of ASCII letters or any other code point. The ends of a text's units are a set of offsets, kept as in a
Roaring bitmap: offsets are dealt by their high bits to containers, each of which is an array, a bitmap or a list of
runs, whichever is smallest; cumulative cardinalities tell which container holds the i-th offset, and a select inside
that container finds it. Both cuts are such selects.

What is drawn depends on a row's id and the seed alone, whatever the partitioning; a null id counts as empty. Null texts
are empty, and empty texts, texts that hold a mark and a share of all others stay plain. Repeated rows give equal rows;
there are no other ties. An empty table gives an empty one; columns beside the two named ones are left out. A very long
text takes memory in proportion to its own length.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_rows

#: Marks before the prefix, the suffix and the middle.
MARKS = ("<P>", "<S>", "<M>")
#: Percent of texts that are cut, and percent of those that have their suffix first.
CUT, SUFFIX_FIRST, SEED = 90, 20, 1
#: Offsets of a container; bytes of a bitmap of them.
SPAN_BITS, BITMAP_BYTES = 16, 1 << 13


class ArrayContainer:
    """Ascending offsets, two bytes each."""

    def __init__(self, low: np.ndarray):
        self.low = low.astype(np.uint16)

    def select(self, i: int) -> int:
        return int(self.low[i])


class BitmapContainer:
    """A bit for each offset, and how many are set up to each word of 64."""

    def __init__(self, low: np.ndarray):
        bits = np.zeros(1 << SPAN_BITS, np.uint8)
        bits[low] = 1
        self.words = np.packbits(bits, bitorder="little").view(np.uint64)
        self.upto = np.bitwise_count(self.words).cumsum(dtype=np.int64)

    def select(self, i: int) -> int:
        at = int(np.searchsorted(self.upto, i, "right"))
        before = int(self.upto[at - 1]) if at else 0
        inside = np.flatnonzero(np.unpackbits(self.words[at : at + 1].view(np.uint8), bitorder="little"))
        return 64 * at + int(inside[i - before])


class RunContainer:
    """First offset of each run of consecutive ones, and how many there are up to its end."""

    def __init__(self, low: np.ndarray, first: np.ndarray):
        self.first = low[first].astype(np.uint16)
        self.upto = np.append(first[1:], len(low)).astype(np.int64)

    def select(self, i: int) -> int:
        at = int(np.searchsorted(self.upto, i, "right"))
        return int(self.first[at]) + i - (int(self.upto[at - 1]) if at else 0)


def container(low: np.ndarray):
    """The smallest of the three forms of ascending 16-bit offsets."""
    first = np.flatnonzero(np.diff(low, prepend=-2) != 1)
    size = {"array": 2 * len(low), "bitmap": BITMAP_BYTES, "run": 4 * len(first)}
    best = min(size, key=size.get)
    return RunContainer(low, first) if best == "run" else ArrayContainer(low) if best == "array" else BitmapContainer(low)


class Boundaries:
    """An ascending set of offsets that finds its i-th one."""

    def __init__(self, offsets: np.ndarray):
        high = offsets >> SPAN_BITS
        starts = np.flatnonzero(np.diff(high, prepend=-1))
        self.keys = high[starts]
        self.upto = np.append(starts[1:], len(offsets)).astype(np.int64)
        low = offsets & ((1 << SPAN_BITS) - 1)
        self.containers = [container(low[a:b]) for a, b in zip(starts, self.upto)]

    def __len__(self) -> int:
        return int(self.upto[-1]) if len(self.upto) else 0

    def select(self, i: int) -> int:
        at = int(np.searchsorted(self.upto, i, "right"))
        before = int(self.upto[at - 1]) if at else 0
        return (int(self.keys[at]) << SPAN_BITS) + self.containers[at].select(i - before)


def unit_ends(text: str) -> np.ndarray:
    """Offset in code points after each unit."""
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    letter = ((points | 32) - np.uint32(97)) < 26
    return np.append(np.flatnonzero(~(letter[:-1] & letter[1:])) + 1, len(points)) if len(points) else np.empty(0, np.int64)


def cuts(ends: Boundaries, a: int, b: int) -> tuple[int, int]:
    """Offsets after the a-th and after the b-th unit, 0 for none."""
    return tuple(ends.select(k - 1) if k else 0 for k in (a, b))


def draws(id_col: str, seed: int = SEED) -> list[Column]:
    """Four 32-bit numbers of a row: the first four groups of eight hex digits of a digest of the seed and the id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]


def transform(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", cut: int = CUT, suffix_first: int = SUFFIX_FIRST, seed: int = SEED, marks: tuple[str, str, str] = MARKS) -> DataFrame:
    """(id, n, form, prefix_chars, middle_chars, output): n units; form is plain, psm (prefix, suffix, middle) or spm (suffix, prefix, middle); null sizes where plain."""

    def make():
        p, s, m = marks

        def row(key, text, h1, h2, h3, h4):
            text = text or ""
            ends = Boundaries(unit_ends(text))
            n = len(ends)
            if not n or h3 % 100 >= cut or any(x in text for x in marks):
                yield key, n, "plain", None, None, text
                return
            a, b = cuts(ends, *sorted((h1 % (n + 1), h2 % (n + 1))))
            first, middle, last = text[:a], text[a:b], text[b:]
            spm = h4 % 100 < suffix_first
            yield key, n, "spm" if spm else "psm", a, b - a, "".join((s, last, p, first, m, middle) if spm else (p, first, s, last, m, middle))

        return row

    kind = df.schema[id_col].dataType.simpleString()
    own = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), *[h.alias(f"h{i}") for i, h in enumerate(draws(id_col, seed))])
    ddl = f"`{id_col}` {kind}, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string"
    return map_rows(own, own.columns, ddl, make)


def restored(form: Column, output: Column, marks: tuple[str, str, str] = MARKS) -> Column:
    """The text that was cut. As no text holds a mark, and no mark begins inside another, each mark's first place is its own."""
    p, s, m = marks
    at_p, at_s, at_m = F.instr(output, p), F.instr(output, s), F.instr(output, m)

    def between(start: Column, mark: str, end: Column) -> Column:
        return F.substr(output, start + len(mark), end - start - len(mark))

    middle = F.substr(output, at_m + len(m))
    psm = F.concat(between(at_p, p, at_s), middle, between(at_s, s, at_m))
    spm = F.concat(between(at_p, p, at_m), middle, between(at_s, s, at_p))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def digests(cut: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Digests of the outputs, and of the texts restored from them."""
    back = restored(F.col("form"), F.col("output"))
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return cut.select(id_col, "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"), sha(back).alias("restored_sha256"))


def digests_sql() -> str:
    """digests(transform(documents)) in DuckDB, by lists of units."""
    p, s, m = MARKS
    number = lambda i: f"('0x' || h[{1 + 8 * i}:{8 + 8 * i}])::BIGINT"
    joined = lambda part: f"coalesce(array_to_string({part}, ''), '')"
    return f"""
    WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('{SEED}:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
    u AS (SELECT doc_id, t, h, regexp_extract_all(t, '[A-Za-z]+|[^A-Za-z]') AS k FROM d),
    c AS (SELECT *, len(k) AS n, {number(0)} % (len(k) + 1) AS a, {number(1)} % (len(k) + 1) AS b,
        CASE WHEN t = '' OR contains(t, '{p}') OR contains(t, '{s}') OR contains(t, '{m}') OR {number(2)} % 100 >= {CUT} THEN 'plain' WHEN {number(3)} % 100 < {SUFFIX_FIRST} THEN 'spm' ELSE 'psm' END AS form FROM u),
    w AS (SELECT *, {joined("k[1:least(a, b)]")} AS first, {joined("k[least(a, b) + 1:greatest(a, b)]")} AS middle, {joined("k[greatest(a, b) + 1:]")} AS last FROM c)
    SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(first) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
        sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '{p}' || first || '{s}' || last || '{m}' || middle ELSE '{s}' || last || '{p}' || first || '{m}' || middle END) AS output_sha256,
        sha256(CASE form WHEN 'plain' THEN t ELSE first || middle || last END) AS restored_sha256
    FROM w"""
