"""Collocations: phrases of a language whose words stand together more often than by themselves.

Counts come from a suffix tree over words, cut off at the longest phrase and built as vertical parts (after ERA):

* Words are counted whole. Then positions are turned into suffixes: the words from a position on, up to the longest
  phrase, the end of the piece, or the first two neighbours that are too rare to stand in any candidate. What is rare is
  told by two tables of fixed size (bits of frequent words, counts of neighbours by hash), which let some rare ones
  pass; they spare work and decide nothing. Equal suffixes of a batch are one row with a count.
* Suffixes are parted by word prefixes: prefixes of one word, in classes by hash, are counted; a class of more rows than
  the budget is parted by prefixes of two words, and so on. Classes are put together into groups within the budget.
* Each group's subtree is built by itself, in one task, by sorting its suffixes; a node's count is the total of the
  leaves below it. A node above its class's prefix length has parts in several groups, whose totals are added.

Null texts are empty; null languages are UNKNOWN. Repeated rows are documents of their own. Ties are stated by `best`. An
empty table gives an empty one; columns beside the two named ones, whatever their names, are left out. Very long texts
are taken in stretches that end at a blank, each with the words its last suffixes reach. A word takes memory in
proportion to its own length. Words of a batch are told apart by hashes of 64 bits, in counts by their characters.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_schema, written
from .fingerprints import mixed
from .suffixes import BASE, INVERSE, LETTERS, powers

UNKNOWN = "und"
#: Words of the longest phrase, least count of a candidate, phrases of a language that are reported.
LONGEST, LEAST, TOP = 4, 30, 2000
#: A longer candidate with so many hundredths of a candidate's count replaces it.
COVERED = 80
#: A score is this often a / (l + r), floored.
SCALE = 2_000_000
#: Binary logarithms of the bits for frequent words, of the counters for neighbours, and of the counters in a slice.
WORD_BITS, PAIR_BITS, SLICE_BITS = 25, 25, 16
#: Prefix classes of a level, and rows of a group.
CLASSES, BUDGET = 4096, 1 << 19
#: Bytes of text taken at once, and rows that a task keeps before it sends them on.
STRETCH, KEPT = 1 << 20, 1 << 20
#: Bytes of a word up to which its polynomial is its hash.
POLYNOMIAL = 512

_KIND = np.zeros(256, np.uint8)
_KIND[[0x20, 0x09]] = 1
_KIND[[ord(c) for c in ".,;:!?\n\x0b\x0c\r"]] = 2
_BLANK = re.compile(rb"[ \t]")


# --- words of a stretch of text


class Words:
    """The words of some texts in order: where they stand, their piece, language and hash."""

    def __init__(self, texts: list[bytes], langs: list[int], seeds: np.ndarray, owned: int | None = None):
        data = b"\n".join(texts).lower()
        self.bytes = np.frombuffer(data, np.uint8)
        kind = _KIND[self.bytes]
        edges = np.flatnonzero(np.diff(kind > 0, prepend=True, append=True))
        self.start, self.end = edges[::2], edges[1::2]
        self.piece = np.searchsorted(np.flatnonzero(kind == 2), self.start)
        begins = np.cumsum([0, *(len(t) + 1 for t in texts[:-1])])
        self.lang = np.array(langs, np.int64)[np.searchsorted(begins, self.start, "right") - 1]
        self.own = np.ones(len(self.start), bool) if owned is None else self.start < owned
        self.hash = mixed(self.hashes(data) + seeds[self.lang])

    def __len__(self) -> int:
        return len(self.start)

    def hashes(self, data: bytes) -> np.ndarray:
        import xxhash

        prefix = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(LETTERS[self.bytes] * powers(BASE, len(data))[: len(data)], out=prefix[1:])
        out = mixed((prefix[self.end] - prefix[self.start]) * powers(INVERSE, len(data) + 1)[self.start])
        for i in np.flatnonzero(self.end - self.start > POLYNOMIAL):
            out[i] = xxhash.xxh3_64_intdigest(data[self.start[i] : self.end[i]])
        return out

    def strings(self, at: np.ndarray) -> pa.StringArray:
        """The words at these places."""
        start, size = self.start[at], self.end[at] - self.start[at]
        offsets = np.concatenate([[0], np.cumsum(size)])
        take = np.repeat(start - offsets[:-1], size) + np.arange(offsets[-1])
        return pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(self.bytes[take]))).cast(pa.string())

    def neighbours(self) -> np.ndarray:
        """Whether each word and the next one stand in one piece."""
        return np.append(self.piece[:-1] == self.piece[1:], False) if len(self) else np.empty(0, bool)


def extended(h: np.ndarray, following: np.ndarray) -> np.ndarray:
    """Hash of the phrases with hash h and one more word."""
    return mixed(h * np.uint64(0x9E3779B97F4A7C15) + following)


def stretches(text: bytes, words: int) -> Iterator[tuple[bytes, int]]:
    """The text in stretches cut at blanks, each with as many words more as a suffix can reach, and how many bytes are its own."""
    start, reach = 0, re.compile(rb"(?:[ \t]*[^ \t]+){0,%d}" % words)
    while len(text) - start > 2 * STRETCH and (cut := _BLANK.search(text, start + STRETCH)):
        yield text[start : reach.match(text, cut.start()).end()], cut.start() - start
        start = cut.start()
    yield text[start:], len(text) - start


def word_batches(batches: Iterator[pa.RecordBatch], longest: int) -> Iterator[tuple[Words, list[str]]]:
    """The words of (lang, text) rows, about STRETCH bytes at a time, and the names of their languages."""
    import xxhash

    names: list[str] = []
    codes: dict[str, int] = {}
    seeds = np.empty(0, np.uint64)
    texts, langs, size = [], [], 0
    for b in batches:
        for lang, text in zip(b.column(0), b.column(1)):
            text = (text.as_py() or "").encode()
            if not text:
                continue
            code = codes.setdefault(lang.as_py(), len(codes))
            if code == len(names):
                names.append(lang.as_py())
                seeds = np.append(seeds, np.uint64(xxhash.xxh3_64_intdigest(names[-1])))
            if len(text) > 2 * STRETCH:
                for part, owned in stretches(text, longest - 1):
                    yield Words([part], [code], seeds, owned), names
                continue
            texts.append(text)
            langs.append(code)
            size += len(text)
            if size > STRETCH:
                yield Words(texts, langs, seeds), names
                texts, langs, size = [], [], 0
    if texts:
        yield Words(texts, langs, seeds), names


class Tally:
    """Counts by 64-bit keys, with an Arrow table of what each key stands for."""

    def __init__(self):
        self.parts: list[tuple[np.ndarray, np.ndarray, pa.Table]] = []
        self.rows = self.merged = 0

    def add(self, keys: np.ndarray, counts: np.ndarray, table: pa.Table) -> None:
        self.parts.append((keys, counts, table))
        self.rows += len(keys)

    def full(self) -> bool:
        """Whether to send the rows on: KEPT are left after equal keys are merged, which is tried each time that as many have come."""
        if self.rows - self.merged < KEPT:
            return False
        self.merge()
        return self.rows >= KEPT

    def merge(self) -> None:
        if len(self.parts) > 1:
            keys = np.concatenate([p[0] for p in self.parts])
            own, first, at = np.unique(keys, return_index=True, return_inverse=True)
            counts = np.bincount(at, np.concatenate([p[1] for p in self.parts]), len(own)).astype(np.int64)
            self.parts = [(own, counts, pa.concat_tables([p[2] for p in self.parts]).take(first))]
            self.rows = len(own)
        self.merged = self.rows

    def batches(self, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        """All rows, their counts as the last column; empty afterwards."""
        self.merge()
        for _, counts, table in self.parts:
            whole = table.append_column("n", pa.array(counts))
            yield from pa.table(whole.columns, schema=schema).to_batches(max_chunksize=1 << 16)
        self.__init__()


# --- counts of words


def word_counts(docs: DataFrame, longest: int) -> DataFrame:
    """(lang, word, hash, n) of every word."""
    ddl = "lang string, word string, hash bigint, n bigint"
    schema = arrow_schema(ddl)

    def run(batches):
        tally = Tally()
        for words, names in word_batches(batches, longest):
            own = np.flatnonzero(words.own)
            keys, first, counts = np.unique(words.hash[own], return_index=True, return_counts=True)
            at = own[first]
            langs = pa.DictionaryArray.from_arrays(pa.array(words.lang[at], pa.int32()), pa.array(names, pa.string())).cast(pa.string())
            tally.add(keys, counts, pa.table([langs, words.strings(at), pa.array(keys.view(np.int64))], names=["lang", "word", "hash"]))
            if tally.full():
                yield from tally.batches(schema)
        yield from tally.batches(schema)

    return docs.mapInArrow(run, ddl).groupBy("lang", "word").agg(F.first("hash").alias("hash"), F.sum("n").alias("n"))


def slots(h: np.ndarray, bits: int) -> np.ndarray:
    return (h >> np.uint64(64 - bits)).astype(np.int64)


def word_bits(words: DataFrame, least: int, bits: int = WORD_BITS) -> np.ndarray:
    """Packed bits: 1 where the hash of a word with the least count falls. 4 KB come to the driver for each 32,768 bits."""
    slot = F.shiftrightunsigned("hash", 64 - bits) + 1
    rows = words.filter(F.col("n") >= least).groupBy(F.bitmap_bucket_number(slot).alias("at")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("bits"))
    out = np.zeros((max(1, (1 << bits) >> 15), 1 << 12), np.uint8)
    for row in rows.collect():
        out[row["at"] - 1] = np.frombuffer(row["bits"], np.uint8)
    return out.reshape(-1)


def known(packed: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Which of the packed bits are set."""
    return (packed[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


# --- counts of neighbours, in a table of fixed size


def pair_bits(docs: DataFrame, frequent, least: int, longest: int, word_bits: int = WORD_BITS, bits: int = PAIR_BITS) -> np.ndarray:
    """Packed bits: 1 where two neighbouring frequent words fall whose counter reaches least. Counters stop at 255, or at least if that is more."""
    width, most = 1 << min(bits, SLICE_BITS), max(255, least)
    kind = np.uint8 if most == 255 else np.uint32
    ddl = "slice int, salt int, counts binary"
    schema = arrow_schema(ddl)

    def row(slice_, salt, counts) -> pa.RecordBatch:
        packed = pa.compress(np.minimum(counts, most).astype(kind).tobytes(), "zstd", asbytes=True)
        return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((slice_, salt, packed), schema.types)], schema=schema)

    def count(batches):
        table, salt = np.zeros(1 << bits, kind), 0
        for words, _ in word_batches(batches, longest):
            often = known(frequent.value, slots(words.hash, word_bits))
            at = np.flatnonzero(words.neighbours() & often & np.append(often[1:], False) & words.own) if len(words) else []
            if len(at):
                own, counts = np.unique(slots(extended(words.hash[at], words.hash[at + 1]), bits), return_counts=True)
                table[own] = np.minimum(table[own] + counts, most)
                salt = int(own[0]) % 16
        for i, part in enumerate(table.reshape(-1, width)):
            if part.any():
                yield row(i, salt, part)

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for i, data in zip(b.column(0).to_pylist(), b.column(2)):
                part = np.frombuffer(pa.decompress(data.as_py(), width * np.dtype(kind).itemsize, "zstd"), kind).astype(np.int64)
                sums[i] = np.minimum(sums[i] + part, most).astype(kind) if i in sums else part.astype(kind)
        for i, part in sums.items():
            yield row(i, 0, part)

    def bits_of(batches):
        for b in batches:
            for i, data in zip(b.column(0).to_pylist(), b.column(2)):
                part = np.frombuffer(pa.decompress(data.as_py(), width * np.dtype(kind).itemsize, "zstd"), kind)
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([0], pa.int32()), pa.array([np.packbits(part >= least, bitorder="little").tobytes()], pa.binary())], schema=schema)

    parts = docs.mapInArrow(count, ddl).repartition("slice", "salt").mapInArrow(add, ddl).repartition("slice").mapInArrow(lambda b: bits_of(add(b)), ddl)
    out = np.zeros(((1 << bits) // width, width // 8), np.uint8)
    for found in parts.collect():
        out[found["slice"]] = np.frombuffer(found["counts"], np.uint8)
    return out.reshape(-1)


# --- suffixes, their groups, and subtrees


def suffixes(docs: DataFrame, frequent, near, longest: int, word_bits: int = WORD_BITS, bits: int = PAIR_BITS) -> DataFrame:
    """(lang, phrase, n): the suffixes of two words or more, space-joined; equal ones may have several rows."""
    ddl = "lang string, phrase string, n bigint"
    schema = arrow_schema(ddl)

    def run(batches):
        tally = Tally()
        for words, names in word_batches(batches, longest):
            if not len(words):
                continue
            often = known(frequent.value, slots(words.hash, word_bits))
            at = np.flatnonzero(words.neighbours() & often & np.append(often[1:], False))
            ok = known(near.value, slots(extended(words.hash[at], words.hash[at + 1]), bits))
            on = np.zeros(len(words) + longest, bool)  # whether the suffix goes on to the next word
            on[at[ok]] = True
            at = at[ok & words.own[at]]
            key, depth, going = words.hash[at], np.ones(len(at), np.int64), np.ones(len(at), bool)
            for i in range(longest - 1):
                going = going & on[at + i]
                key = np.where(going, extended(key, words.hash[np.minimum(at + i + 1, len(words) - 1)]), key)
                depth += going
            keys, first, counts = np.unique(key, return_index=True, return_counts=True)
            at, depth = at[first], depth[first]
            each = []
            for i in range(longest):
                have = depth > i
                places = np.where(have, np.cumsum(have) - 1, 0)
                each.append(words.strings(at[have] + i).take(pa.array(places, pa.int64(), mask=~have)))
            phrases = pc.binary_join_element_wise(*each, " ", null_handling="skip")
            langs = pa.DictionaryArray.from_arrays(pa.array(words.lang[at], pa.int32()), pa.array(names, pa.string())).cast(pa.string())
            tally.add(keys, counts, pa.table([langs, phrases], names=["lang", "phrase"]))
            if tally.full():
                yield from tally.batches(schema)
        yield from tally.batches(schema)

    return docs.mapInArrow(run, ddl)


def packed_groups(sizes: dict[int, int], budget: int, first: int) -> dict[int, int]:
    """A group for each class, numbered from first: classes by descending size, each group filled up to the budget."""
    out, group, room = {}, first - 1, 0
    for key, size in sorted(sizes.items(), key=lambda x: (-x[1], x[0])):
        if size > room:
            group, room = group + 1, budget
        out[key], room = group, room - size
    return out


def grouped(found: DataFrame, longest: int, classes: int = CLASSES, budget: int = BUDGET) -> DataFrame:
    """found with the group of each suffix and the length of the word prefix that decides it. What comes to the driver, and is sent back as a constant, is one number a class."""
    group, level_of, groups = F.lit(-1), F.lit(0), 0
    for level in range(1, longest + 1):
        key = F.pmod(F.xxhash64(F.lit(level), "lang", F.substring_index("phrase", " ", level)), F.lit(classes)).cast("int")
        rest = found.filter(group < 0)
        sizes = {r["c"]: r["n"] for r in rest.groupBy(key.alias("c")).agg(F.count("*").alias("n")).collect()}
        large = {c for c, n in sizes.items() if n > budget and level < longest}
        own = packed_groups({c: n for c, n in sizes.items() if c not in large}, budget, groups)
        groups = max([groups, *(g + 1 for g in own.values())])
        here = F.get(F.split(F.lit(",".join(str(own.get(c, -1)) for c in range(classes))), ",").cast("array<int>"), key)
        level_of = F.when((group < 0) & (here >= 0), level).otherwise(level_of)
        group = F.when(group < 0, here).otherwise(group)
        if not large:
            break
    return found.select("lang", "phrase", "n", group.alias("group"), level_of.alias("level"))


def subtrees(rows: DataFrame, least: int, longest: int) -> DataFrame:
    """(lang, phrase, n) of the tree's nodes of two words or more: whole counts of at least least, or parts of counts of nodes above a prefix."""
    ddl = "lang string, phrase string, n bigint"
    schema = arrow_schema(ddl)

    def run(suffixes: pa.Table) -> pa.Table:
        words = pc.split_pattern(suffixes.column("phrase").combine_chunks(), " ")
        coded = pc.dictionary_encode(words.flatten())
        lang = pc.dictionary_encode(suffixes.column("lang").combine_chunks())
        depth = np.diff(words.offsets.to_numpy())
        column = np.arange(len(coded)) - np.repeat(words.offsets.to_numpy()[:-1], depth)
        tree = np.full((len(depth), longest + 1), -1, np.int64)
        tree[:, 0] = lang.indices.to_numpy()
        tree[np.repeat(np.arange(len(depth)), depth), column + 1] = coded.indices.to_numpy()
        order = np.lexsort(tree.T[::-1])
        tree, depth = tree[order], depth[order]
        n, level = suffixes.column("n").to_numpy()[order], suffixes.column("level").to_numpy()[order]
        out, branch = [schema.empty_table()], np.concatenate([[True], tree[1:, 0] != tree[:-1, 0]])
        for d in range(1, longest + 1):
            branch = branch | np.concatenate([[True], tree[1:, d] != tree[:-1, d]])
            if d > 1:
                first = np.flatnonzero(branch)
                total = np.add.reduceat(n, first)
                # leaves that end above this depth sort first, as branches of their own
                keep = (depth[first] >= d) & ((total >= least) | (level[first] > d))
                first, total = first[keep], total[keep]
                parts = [coded.dictionary.take(pa.array(tree[first, i])) for i in range(1, d + 1)]
                phrase = pc.binary_join_element_wise(*parts, " ")
                out.append(pa.table([lang.dictionary.take(pa.array(tree[first, 0])), phrase, pa.array(total)], schema=schema))
        return pa.concat_tables(out)

    return rows.groupBy("group").applyInArrow(run, ddl)


def counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, longest: int = LONGEST, word_bits_: int = WORD_BITS, bits: int = PAIR_BITS, classes: int = CLASSES, budget: int = BUDGET) -> tuple[DataFrame, DataFrame]:
    """(lang, word, hash, n) of all words, and (lang, phrase, n) of all phrases of two words or more with the least count."""
    own = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit(UNKNOWN)).alias("lang"), F.col(text_col).alias("text"))
    words = written(word_counts(own, longest), "words")
    context = docs.sparkSession.sparkContext
    frequent = context.broadcast(word_bits(words, least, word_bits_))
    near = context.broadcast(pair_bits(own, frequent, least, longest, word_bits_, bits))
    found = written(suffixes(own, frequent, near, longest, word_bits_, bits), "suffixes")
    nodes = subtrees(grouped(found, longest, classes, budget), least, longest)
    return words, written(nodes.groupBy("lang", "phrase").agg(F.sum("n").alias("n")).filter(F.col("n") >= least), "phrases")


# --- scores


def score(a: str, l: str, r: str):  # noqa: E741
    """floor(SCALE * a / (l + r)), exact."""
    return F.expr(f"cast((cast({a} as decimal(20, 0)) * {SCALE}) div (cast({l} as decimal(20, 0)) + cast({r} as decimal(20, 0))) as bigint)")


def best(words: DataFrame, phrases: DataFrame, least: int = LEAST, top: int = TOP, covered: int = COVERED) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first phrases that no longer one covers, by descending score, then count, then the phrase's bytes. A phrase's cut is that of the lowest score, then the shortest first part."""
    w = F.split("phrase", " ")
    joined = lambda start, n: F.array_join(F.slice("w", start, n), " ")
    size = F.size("w")
    candidates = phrases.select("lang", "phrase", F.col("n").alias("a"), w.alias("w"))
    cuts = candidates.withColumn("k", F.explode(F.sequence(F.lit(1), size - 1))).select("lang", "phrase", "a", "k", joined(F.lit(1), F.col("k")).alias("first"), joined(F.col("k") + 1, size - F.col("k")).alias("rest"))
    known = written(words.filter(F.col("n") >= least).select("lang", F.col("word").alias("part"), "n").unionByName(phrases.select("lang", F.col("phrase").alias("part"), "n")), "parts")
    one, two = known.toDF("lang", "first", "l"), known.toDF("lang", "rest", "r")
    scored = cuts.join(one, ["lang", "first"]).join(two, ["lang", "rest"]).withColumn("score", score("a", "l", "r"))
    lowest = scored.groupBy("lang", "phrase").agg(F.min_by(F.struct("a", "l", "r", "score"), F.struct("score", "k")).alias("cut")).select("lang", "phrase", "cut.*")
    inner = F.expr("flatten(transform(sequence(2, size(w) - 1), m -> transform(sequence(1, size(w) - m + 1), i -> array_join(slice(w, i, m), ' '))))")
    longer = candidates.filter(size > 2).select("lang", F.explode(inner).alias("phrase"), F.col("a").alias("whole")).groupBy("lang", "phrase").agg(F.max("whole").alias("whole"))
    left = lowest.join(longer, ["lang", "phrase"], "left").filter(F.col("whole").isNull() | (100 * F.col("whole").cast("decimal(20, 0)") < covered * F.col("a").cast("decimal(20, 0)")))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    n = words.groupBy("lang").agg(F.sum("n").alias("n"))
    ranked = left.withColumn("rank", place).filter(F.col("rank") <= top)
    return ranked.join(n, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def mine(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", **options) -> DataFrame:
    """The best phrases of each language, see `best`."""
    return best(*counts(docs, text_col, lang_col, **options), least=options.get("least", LEAST))


def mine_sql() -> str:
    """mine(documents) in DuckDB: all phrases counted one by one."""
    return f"""
    WITH p AS (SELECT coalesce(lang, '{UNKNOWN}') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
    w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[ \\x09]+'), lambda x: x <> '') AS w FROM p),
    places AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM w),
    f AS (SELECT lang, m, array_to_string(w[i:i + m - 1], ' ') AS phrase, count(*) AS f FROM places, (SELECT unnest(range(1, {LONGEST} + 1)) AS m) WHERE i + m - 1 <= len(w) GROUP BY ALL),
    total AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE m = 1 GROUP BY lang),
    c AS (SELECT lang, m, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE m > 1 AND f >= {LEAST}),
    cut AS (SELECT lang, m, phrase, a, w, unnest(range(1, m)) AS k FROM c),
    s AS (SELECT cut.lang, cut.phrase, cut.a, cut.k, x.f AS l, y.f AS r, (({SCALE}::HUGEINT * cut.a) // (x.f + y.f))::BIGINT AS score
        FROM cut JOIN f x ON x.lang = cut.lang AND x.phrase = array_to_string(cut.w[1:cut.k], ' ') JOIN f y ON y.lang = cut.lang AND y.phrase = array_to_string(cut.w[cut.k + 1:], ' ')),
    low AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
    part AS (SELECT lang, a, w, m, unnest(range(2, m)) AS size FROM c WHERE m > 2),
    inside AS (SELECT lang, a, w, size, unnest(range(1, m - size + 2)) AS i FROM part),
    longer AS (SELECT lang, array_to_string(w[i:i + size - 1], ' ') AS phrase, max(a) AS whole FROM inside GROUP BY ALL),
    kept AS (SELECT low.* FROM low LEFT JOIN longer USING (lang, phrase) WHERE whole IS NULL OR 100::HUGEINT * whole < {COVERED}::HUGEINT * a),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
    SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN total USING (lang) WHERE rank <= {TOP}"""
