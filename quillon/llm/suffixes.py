"""Removal of repeated byte strings by a hash-compared suffix sort.

Every string of `length` bytes that starts at more than one place (in one text or several) is removed wherever it
stands; strings are judged on the input, and overlaps count.

* Each such string holds grams of GRAM bytes; the one with the least hash is its anchor. Equal strings have equal
  anchors at equal offsets, so only anchors have to meet: about one place in seventy of a text.
* Anchors' gram hashes are counted; those that stand once are dropped, and the others get their context, the bytes of
  all strings that they can anchor.
* The contexts of a gram are sorted by the suffix that starts at the gram: a mergesort whose comparisons find the
  common extension of two suffixes by binary search over prefix polynomial hashes. Neighbours' common extensions are
  then verified byte by byte. Suffixes whose common extension reaches a string's end form a class; strings with equal
  left parts within a class (by hash, then verified) are repeated.
* A gram with more than `limit` places would be too much for a task. Its strings are hashed instead (128 bits) and
  counted by Spark with partial sums, so that no group of them is brought to one place.

Null texts are empty. Every row is a document, repeated ones too, and all of them lose what they share; there are no
other ties. Texts shorter than a string stay whole. An empty table gives an empty one, and columns beside the two named
ones are left out. A very long text is one row of a task.
"""

from __future__ import annotations


import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows, ordered, written
from .fingerprints import mixed

#: Bytes of a string and of a gram; places of a gram that are sorted in one task; contexts sorted at once.
LENGTH, GRAM, LIMIT, SORTED = 200, 64, 30_000, 4096

# An odd base of the polynomials and its inverse modulo 2**64; a random number for each byte.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
LETTERS = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))

_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**i for i < n at least, modulo 2**64; kept up to four million."""
    known = _powers.get(base)
    if known is None or len(known) < n:
        known = np.full(max(n, 1 << 17), base, np.uint64)
        known[0] = 1
        known = np.multiply.accumulate(known)
        if n <= 4 << 20:
            _powers[base] = known
    return known


def gram_hashes(data: bytes, gram: int) -> np.ndarray:
    """Hash of each gram, by differences of prefix polynomial hashes."""
    letters = LETTERS[np.frombuffer(data, np.uint8)]
    n = len(letters)
    prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum(letters * powers(BASE, n)[:n], dtype=np.uint64)])
    return mixed((prefix[gram:] - prefix[:-gram]) * powers(INVERSE, n)[: n - gram + 1])


def anchors(data: bytes, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Each anchor's place, its gram's hash, and the first and last start of the strings that it anchors."""
    h = gram_hashes(data, gram)
    width = length - gram + 1
    low = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)  # of equal ones the leftmost
    step = 1
    while 2 * step <= width:
        low = np.minimum(low[:-step], low[step:])
        step *= 2
    if step < width:
        low = np.minimum(low[: len(h) - width + 1], low[width - step :])
    place = (low & np.uint64(0xFFFFFFFF)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    last = np.append(first[1:], len(place)) - 1
    return place[first], h[place[first]].view(np.int64), first, last


# --- the suffix sort


def common_extension(p: np.ndarray, size: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Longest common prefix of suffixes i and j, by binary search over their prefix hashes p."""
    low, high = np.zeros(len(i), np.int64), np.minimum(size[i], size[j])
    for _ in range(int(p.shape[1]).bit_length()):
        mid = (low + high + 1) // 2
        same = p[i, mid] == p[j, mid]
        low, high = np.where(same, mid, low), np.where(same, high, np.maximum(mid - 1, low))
    return low


def before(p: np.ndarray, right: np.ndarray, size: np.ndarray, group: np.ndarray, i: np.ndarray, j: np.ndarray, or_equal: bool) -> np.ndarray:
    """Whether suffix i sorts before suffix j: by group, then bytes, a prefix before what extends it."""
    k = common_extension(p, size, i, j)
    end_i, end_j = k >= size[i], k >= size[j]
    at = np.minimum(k, right.shape[1] - 1)
    less = np.where(end_i | end_j, end_i & (~end_j | or_equal), right[i, at] < right[j, at])
    return np.where(group[i] != group[j], group[i] < group[j], less)


def suffix_order(right: np.ndarray, size: np.ndarray, group: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Mergesort of the suffixes, all pairs of runs of a round at once: each suffix finds its place in the other run."""
    n, order, run = len(right), np.arange(len(right)), 1
    while run < n:
        at = np.arange(n)
        start = at // (2 * run) * (2 * run)
        in_left = at - start < run
        other = np.where(in_left, np.minimum(start + run, n), start)
        low, high = other.copy(), np.where(in_left, np.minimum(start + 2 * run, n), np.minimum(start + run, n))
        while (open_ := np.flatnonzero(low < high)).size:
            mid = (low[open_] + high[open_]) // 2
            a, b, left = order[mid], order[open_], in_left[open_]
            # a right-run suffix stands after equal ones of the left run
            ahead = np.where(left, before(p, right, size, group, a, b, False), before(p, right, size, group, a, b, True))
            low[open_] = np.where(ahead, mid + 1, low[open_])
            high[open_] = np.where(ahead, high[open_], mid)
        new = np.empty_like(order)
        new[start + (at - np.where(in_left, start, start + run)) + (low - other)] = order
        order, run = new, 2 * run
    return order


def repeated_offsets(group: np.ndarray, left: np.ndarray, left_size: np.ndarray, right: np.ndarray, size: np.ndarray, first: np.ndarray, last: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest offset before the anchor at which a context's string is repeated (greatest -1: none).

    left: the bytes before the anchor, backwards; first, last: the offsets of the strings that it anchors.
    """
    n = len(group)
    p = np.zeros((n, length + 1), np.uint64)
    np.cumsum(LETTERS[right] * powers(BASE, length)[:length], axis=1, dtype=np.uint64, out=p[:, 1:])
    order = suffix_order(right, size, group, p)
    group, left, left_size, right, size, first, last = (x[order] for x in (group, left, left_size, right, size, first, last))
    extension = np.zeros(n + 1, np.int64)
    if n > 1:
        pairs = np.arange(1, n)
        found = common_extension(p[order], size, pairs, pairs - 1)
        differ = right[1:] != right[:-1]
        exact = np.where(differ.any(1), differ.argmax(1), length)
        exact = np.minimum(exact, np.minimum(size[1:], size[:-1]))
        extension[1:n] = np.where(group[1:] == group[:-1], np.minimum(found, exact), 0)  # verified byte by byte
    most = np.maximum(extension[:-1], extension[1:])
    low, high, h = np.full(n, length), np.full(n, -1), np.zeros(n, np.uint64)
    for o in range(int(last.max(initial=-1)) + 1):
        need = length - o
        if o:
            h = h * np.uint64(BASE) + LETTERS[left[:, o - 1]]
        own = np.flatnonzero((first <= o) & (o <= last) & (left_size >= o) & (most >= need))
        if len(own) < 2:
            continue
        classes = np.cumsum(extension[:-1] < need)[own].astype(np.uint64)
        key = mixed(h[own] + mixed(classes))
        by = np.argsort(key, kind="stable")
        same = key[by][1:] == key[by][:-1]
        x, y = own[by][1:][same], own[by][:-1][same]
        equal = (left[x, :o] == left[y, :o]).all(1) if o else np.ones(len(x), bool)
        for z in (x[equal], y[equal]):
            low[z], high[z] = np.minimum(low[z], o), np.maximum(high[z], o)
    back_low, back_high = np.empty_like(low), np.empty_like(high)
    back_low[order], back_high[order] = low, high
    return back_low, back_high


# --- the jobs


def contexts(docs: DataFrame, places: DataFrame, length: int, gram: int) -> DataFrame:
    """(key, many, row, place, first, last, before, after) of each listed anchor."""
    reach = length - gram

    def make():
        def row(row, text, listed):
            data = text.encode()
            at, keys, first, last = anchors(data, length, gram)
            many = {x["place"]: x["many"] for x in listed}
            for a, key, s, e in zip(at.tolist(), keys.tolist(), first.tolist(), last.tolist()):
                if a in many:
                    yield key, many[a], row, a, a - e, a - s, data[max(0, a - reach) : a][::-1], data[a : a + length]

        return row

    return map_rows(docs.join(places, "row"), ["row", "text", "places"], "key bigint, many boolean, row bigint, place int, first int, last int, before binary, after binary", make)


def sorted_groups(found: DataFrame, length: int, gram: int, at_once: int) -> DataFrame:
    """(row, start, end) of what the strings cover that are repeated, for grams that a task can hold."""

    def resolve(held):
        rows = {}
        for i, (key, _, place, first, last, left, right) in enumerate(held):
            rows.setdefault((key, left, right), []).append(i)
        forms = list(rows)
        n, reach = len(forms), length - gram
        keys = {k: i for i, k in enumerate(dict.fromkeys(f[0] for f in forms))}
        group = np.array([keys[f[0]] for f in forms])
        left = np.frombuffer(b"".join(f[1].ljust(reach, b"\0") for f in forms), np.uint8).reshape(n, reach)
        right = np.frombuffer(b"".join(f[2].ljust(length, b"\0") for f in forms), np.uint8).reshape(n, length)
        sizes = [np.array([len(f[i]) for f in forms]) for i in (1, 2)]
        one = [held[own[0]] for own in rows.values()]
        first, last = np.array([x[3] for x in one]), np.array([x[4] for x in one])
        low, high = repeated_offsets(group, left, sizes[0], right, sizes[1], first, last, length)
        for k, own in enumerate(rows.values()):
            a, b = (first[k], last[k]) if len(own) > 1 else (low[k], high[k])  # equal contexts repeat all their strings
            if b >= 0:
                for i in own:
                    yield held[i][1], int(held[i][2] - b), int(held[i][2] - a + length)

    def run(rows):
        held, key = [], None
        for x in rows:
            if x[0] != key and len(held) >= at_once:
                yield from resolve(held)
                held = []
            key = x[0]
            held.append(x)
        if held:
            yield from resolve(held)

    found = found.select("key", "row", "place", "first", "last", "before", "after")
    return ordered(found.repartition("key").sortWithinPartitions("key"), "row bigint, start int, end int", run, 20_000)


def counted_strings(found: DataFrame, length: int) -> DataFrame:
    """The same for the other grams: their strings' hashes, counted by Spark."""

    def make():
        import xxhash

        def row(key, row, place, first, last, left, right):
            whole, at = left[::-1] + right, len(left)
            for o in range(first, last + 1):
                if o <= at and at - o + length <= len(whole):
                    h = xxhash.xxh3_128_intdigest(whole[at - o : at - o + length])
                    yield (h >> 64) - (1 << 63), (h & (1 << 64) - 1) - (1 << 63), row, place - o

        return row

    strings = map_rows(found, ["key", "row", "place", "first", "last", "before", "after"], "a bigint, b bigint, row bigint, start int", make)
    again = strings.groupBy("a", "b").agg(F.count("*").alias("n")).filter("n > 1")
    return strings.join(again, ["a", "b"]).select("row", "start", (F.col("start") + length).alias("end"))


def remove(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, limit: int = LIMIT, at_once: int = SORTED) -> DataFrame:
    """(id, n_bytes, kept binary, spans array<struct<start, end>>) of each row: the bytes that stay, and the runs removed."""
    docs = docs.select(F.xxhash64(id_col, text_col).alias("row"), F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("text"))

    def make():
        def row(row, text):
            data = text.encode()
            if len(data) >= length:
                at, keys, _, _ = anchors(data, length, gram)
                yield from zip(keys.tolist(), [row] * len(at), at.tolist())

        return row

    found = written(map_rows(docs, ["row", "text"], "key bigint, row bigint, place int", make), "anchors")
    again = found.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    places = found.join(again, "key").select("row", F.struct("place", (F.col("n") > limit).alias("many")).alias("x")).distinct().groupBy("row").agg(F.collect_list("x").alias("places"))
    own = written(contexts(docs, places, length, gram), "contexts")
    covered = sorted_groups(own.filter("not many"), length, gram, at_once).unionByName(counted_strings(own.filter("many"), length))
    covered = covered.groupBy("row").agg(F.collect_set(F.struct("start", "end")).alias("covered"))
    kind = docs.schema["id"].dataType.simpleString()

    def cut():
        def row(key, text, covered):
            data, runs = text.encode(), []
            for c in sorted((c["start"], c["end"]) for c in covered or ()):
                if runs and c[0] <= runs[-1][1]:
                    runs[-1][1] = max(runs[-1][1], c[1])
                else:
                    runs.append(list(c))
            kept, at = [], 0
            for a, b in runs:
                kept.append(data[at:a])
                at = b
            yield key, len(data), b"".join(kept) + data[at:], [{"start": a, "end": b} for a, b in runs]

        return row

    return map_rows(docs.join(covered, "row", "left"), ["id", "text", "covered"], f"`{id_col}` {kind}, n_bytes bigint, kept binary, spans array<struct<start:bigint,end:bigint>>", cut)


def digests(removed: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return removed.select(
        id_col,
        "n_bytes",
        (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )
