"""Names in texts, and names like other names, without comparing each with each.

Lower case is Spark's; a word's letters are A-Z, a-z, 0-9 and _.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import ceil

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StringType, StructField, StructType

from ..sources.tables import written

#: Bytes of names that are sent to all tasks as one automaton.
SENT = 32 << 20
#: Characters of the longest gram that names are dealt by.
GRAM = 3


def _bounded(text: str, start: int, end: int) -> bool:
    """Whether text[start:end] begins and ends at word boundaries."""
    word = lambda i: 0 <= i < len(text) and (text[i] == "_" or (text[i].isascii() and text[i].isalnum()))
    return word(start - 1) != word(start) and word(end - 1) != word(end)


def contained(texts: DataFrame, text: str, names: DataFrame, name: str, whole_words: bool = False, sent: int = SENT) -> DataFrame:
    """texts with each name that its text has inside, in either case, a row for each; null and empty names are in none. texts has no column called `name`.

    Names of up to `sent` bytes in all go to every task as an Aho-Corasick automaton, which reads a text once, whatever
    the number of names. More names are dealt by a gram of theirs, the rarest among the names, and meet only texts that
    have that gram.
    """
    known = names.select(F.col(name).cast("string").alias("name")).filter("name != ''").distinct().withColumn("_nlow", F.lower("name"))
    known = written(known, "names")
    size = known.agg(F.sum(F.octet_length("_nlow"))).first()[0] or 0
    own = texts.withColumn("_low", F.lower(F.col(text)))
    found = _by_automaton(own, known, whole_words) if size <= sent else _by_gram(own, known, whole_words)
    return found.drop("_low")


def _by_automaton(own: DataFrame, known: DataFrame, whole_words: bool) -> DataFrame:
    names: dict[str, list[str]] = {}
    for row in known.orderBy("name").collect():
        names.setdefault(row._nlow, []).append(row["name"])
    kept = own.sparkSession.sparkContext.broadcast(names)
    kind = StructType([*own.schema.fields, StructField("name", StringType())])
    schema = to_arrow_schema(kind)
    at = own.columns.index("_low")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for low in kept.value:
            automaton.add_word(low, low)
        if kept.value:
            automaton.make_automaton()
        for b in batches:
            rows, hits = [], []
            for i, t in enumerate(b.column(at).to_pylist() if kept.value else []):
                inside = {low for end, low in automaton.iter(t) if not whole_words or _bounded(t, end + 1 - len(low), end + 1)} if t else ()
                for low in sorted(inside):
                    rows += [i] * len(kept.value[low])
                    hits += kept.value[low]
            out = b.take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip([*out.columns, pa.array(hits, pa.string())], schema)], schema=schema)

    return own.mapInArrow(run, kind)


def grams(low: str, n: int) -> str:
    """SQL for the distinct substrings of n characters."""
    return f"array_distinct(transform(sequence(1, greatest(length({low}) - {n - 1}, 0)), i -> substring({low}, i, {n})))"


def _by_gram(own: DataFrame, known: DataFrame, whole_words: bool) -> DataFrame:
    per = known.select("name", "_nlow", F.explode(F.expr(f"case when length(_nlow) >= {GRAM} then {grams('_nlow', GRAM)} else array(_nlow) end")).alias("_gram"))
    per = written(per, "grams")
    often = per.groupBy("_gram").agg(F.count("*").alias("n"))
    rarest = per.join(often, "_gram").groupBy("name", "_nlow").agg(F.min_by("_gram", F.struct("n", "_gram")).alias("_gram"))
    every = "flatten(array(" + ", ".join(f"case when length(_low) >= {n} then {grams('_low', n)} else array() end" for n in range(1, GRAM + 1)) + "))"
    met = own.withColumn("_gram", F.explode(F.expr(every))).join(written(rarest, "rarest"), "_gram").filter(F.contains("_low", "_nlow"))
    if whole_words:
        word = "[A-Za-z0-9_]"
        before = F.when(F.col("_nlow").rlike(f"^{word}"), f"(?<!{word})").otherwise(f"(?<={word})")
        after = F.when(F.col("_nlow").rlike(f"{word}$"), f"(?!{word})").otherwise(f"(?={word})")
        plain = F.concat(F.lit(r"\Q"), F.replace("_nlow", F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))
        met = met.filter(F.regexp_like("_low", F.concat(before, plain, after)))
    return met.drop("_gram", "_nlow").select(*own.columns, "name")


# --- names like other names


def least_common(size: int, cutoff: float) -> int:
    """Characters that a name of this size has in common, counted with repeats, with any name that is like it: its partner has at least as many characters as make the cutoff possible."""
    partner = ceil(size * cutoff / (2 - cutoff) - 1e-9)
    return max(1, ceil(cutoff * (size + partner) / 2 - 1e-9))


def keys(name: str, rank: dict[str, int], cutoff: float, together: int = 2) -> Iterator[str]:
    """Keys of which two names whose ratio of matching sequences reaches the cutoff have one in common.

    A name is a set of (character, which one of its kind). Sets with t elements in common have in common their rarest
    ones, so `together` of these stand in the first size - t + together elements of both, rare ones first. Of sets that
    need fewer in common, the single elements are keys.
    """
    seen: dict[str, int] = {}
    tokens = []
    for c in name:
        seen[c] = seen.get(c, 0) + 1
        tokens.append(f"{c}{seen[c]}")
    tokens.sort(key=lambda t: (rank.get(t, -1), t))
    need = least_common(len(tokens), cutoff)
    for k in {together, min(together, need)}:
        if k < together:
            yield from tokens[: len(tokens) - need + k]
        else:
            yield from map(" ".join, combinations(tokens[: len(tokens) - need + k], k))


def alike(wanted: DataFrame, known: DataFrame, n: int, cutoff: float, common: int = 4096) -> DataFrame:
    """(name, alias, similarity): for each name (name, low) the n aliases most like it, by the ratio of matching sequences of low and alias; of equal ones the greater alias.

    Names meet by the keys of a count index over their characters, so only pairs that can reach the cutoff are compared;
    lengths too far apart are left out. The cutoff is above 0. Characters are ordered by their counts, of which the `common` greatest come to
    the driver.
    """
    tokens = known.select(F.explode(F.split("alias", "")).alias("c"), "alias").filter("c != ''").groupBy("alias", "c").agg(F.count("*").alias("n"))
    tokens = tokens.select(F.explode(F.transform(F.sequence(F.lit(1), F.col("n").cast("int")), lambda i: F.concat("c", i.cast("string")))).alias("t"))
    often = tokens.groupBy("t").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "t").limit(common).collect()
    rank = {r.t: r.n for r in often}

    def keyed(df: DataFrame, column: str) -> DataFrame:
        kind = StructType([*df.schema.fields, StructField("key", StringType())])
        schema = to_arrow_schema(kind)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                at, out = [], []
                for i, low in enumerate(b.column(b.schema.get_field_index(column)).to_pylist()):
                    own = set(keys(low, rank, cutoff))
                    at += [i] * len(own)
                    out += own
                rows = b.take(pa.array(at, pa.int64()))
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip([*rows.columns, pa.array(out, pa.string())], schema)], schema=schema)

        return df.mapInArrow(run, kind)

    one = keyed(wanted.select("name", "low").filter("low != ''"), "low")
    two = keyed(known.select("alias").filter("alias != ''").distinct(), "alias")
    size, other = F.length("low"), F.length("alias")
    pairs = one.join(two, "key").filter(2 * F.least(size, other) >= cutoff * (size + other) - 1e-9).select("name", "low", "alias").distinct()

    def ratios(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from difflib import SequenceMatcher

        for b in batches:
            m, last, out = SequenceMatcher(), None, []
            for name, low, alias in zip(*(b.column(i).to_pylist() for i in range(3))):
                if low != last:
                    m.set_seq2(low)
                    last = low
                m.set_seq1(alias)
                if m.quick_ratio() >= cutoff and (r := m.ratio()) >= cutoff:
                    out.append((name, alias, r))
            columns = list(zip(*out)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.float64()))], names=["name", "alias", "similarity"])

    found = pairs.mapInArrow(ratios, "name string, alias string, similarity double")
    order = Window.partitionBy("name").orderBy(F.desc("similarity"), F.desc("alias"))
    return found.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= n).drop("nth")
