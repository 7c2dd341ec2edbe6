"""Similarity join of texts on their word n-grams, with groups of linked texts.

Two texts link when 100 * |A & B| >= percent * |A | B| for their sets A, B of distinct word n-grams.

* Equal sets are one node, however many documents have them.
* N-grams are ordered rare first, by a table of counts of hash buckets whose size is a parameter. In that order two
  linked sets share an n-gram of their prefixes, so nodes meet on prefix n-grams.
* A prefix n-gram of few nodes yields pairs that pass the length filter and the positional filter. A pair that is left
  must have as many common prefix n-grams as its two suffixes cannot make up for. Then the suffix filter parts both
  sets at fixed pivots of the hash: the sizes of their parts bound from below in how many n-grams the sets differ, and
  a pair that differs in more than linked sets can is dropped before any set is sent.
* A prefix n-gram of more nodes yields no pairs but a group: its smallest node and each other one. Groups with the
  same smallest node are one group.
* Nodes of a group meet with their whole sets in blocks of bounded size. There each node is counted against all
  others until those that are not counted yet are known to be connected, so a large group of alike texts costs about
  as many counts as it has nodes outside its largest class. Each block yields a spanning forest of its links.
* Connected classes come from alternating large-star and small-star rounds over written tables.

Words and n-grams are told apart by hashes of 64 bits. Null texts and texts without words have the empty set and no
links. Documents with a null id are returned but link with nothing. Repeated rows are documents with equal sets. An
empty table gives an empty one, and columns beside the two named ones, whatever their names, are left out.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, map_rows, ordered, written
from .fingerprints import mixed
from .suffixes import BASE, INVERSE, LETTERS, powers

#: Words of an n-gram; least similarity in per cent.
N, PERCENT = 4, 85
#: Binary logarithm of the count table's buckets, and of those in one of its slices.
TABLE_BITS, SLICE_BITS = 23, 16
#: Nodes of a prefix n-gram that still meet in pairs; bucket count from which an n-gram is not brought to one place.
PAIRED, HOT = 32, 2000
#: N-grams in a block.
BLOCK = 1 << 20


#: Bytes of a text whose words are hashed at once, and of a word that is hashed by its polynomial.
PIECE, POLYNOMIAL = 1 << 20, 512
#: Parts of a set in the suffix filter.
PARTS = 16
WHITE = re.compile(rb"[\t-\r ]")
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


def word_hashes(data: bytes) -> np.ndarray:
    """64-bit hash of each word, by differences of prefix polynomial hashes; of longer ones, for which unlike words of equal polynomials are known, by another hash."""
    import xxhash

    b = np.frombuffer(data, np.uint8)
    edges = np.flatnonzero(np.diff(_SPACE[b], prepend=True, append=True))
    start, end = edges[::2], edges[1::2]
    prefix = np.zeros(len(b) + 1, np.uint64)
    np.cumsum(LETTERS[b] * powers(BASE, len(b))[: len(b)], out=prefix[1:])
    out = mixed((prefix[end] - prefix[start]) * powers(INVERSE, len(b))[start])
    for i in np.flatnonzero(end - start > POLYNOMIAL):
        out[i] = xxhash.xxh3_64_intdigest(data[start[i] : end[i]])
    return out


def pieces(data: bytes) -> Iterator[bytes]:
    """data cut before white space, each piece about PIECE bytes long."""
    start = 0
    while len(data) - start > PIECE and (cut := WHITE.search(data, start + PIECE)):
        yield data[start : cut.start()]
        start = cut.start()
    yield data[start:]


def ngram_set(text: str | None, n: int = N) -> np.ndarray:
    """Distinct n-gram hashes, ascending. A-Z are lower-cased; words are parted by ASCII white space."""
    data = (text or "").encode().lower()
    h = word_hashes(data) if len(data) <= PIECE else np.concatenate([word_hashes(p) for p in pieces(data)])
    if not len(h):
        return np.empty(0, np.uint64)
    width = min(n, len(h))
    out = np.full(len(h) - width + 1, width, np.uint64)
    for i in range(width):
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + h[i : len(h) - width + 1 + i])
    out.sort()
    return out[np.concatenate([[True], out[1:] != out[:-1]])]


def least(size, percent: int = PERCENT):
    """Common n-grams that a set of this size has at least with any set it links with."""
    return (size * percent + 99) // 100


def least_of(a, b, percent: int = PERCENT):
    """Common n-grams that sets of these sizes have at least when they link."""
    return ((a + b) * percent + 99 + percent) // (100 + percent)


def bucket(h: np.ndarray, bits: int = TABLE_BITS) -> np.ndarray:
    return (h >> np.uint64(64 - bits)).astype(np.int64)


# --- counts of n-grams, in a table of fixed size


def count_table(docs: DataFrame, text_col: str, n: int = N, bits: int = TABLE_BITS) -> np.ndarray:
    """How many sets have an n-gram in each bucket, as uint16 (65535: that many or more)."""
    ddl, width = "slice int, salt int, counts binary", 1 << min(bits, SLICE_BITS)
    schema = arrow_schema(ddl)

    def packed(counts: np.ndarray) -> bytes:
        return pa.compress(counts.tobytes(), "zstd", asbytes=True)

    def batch(rows) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, salt = np.zeros(1 << bits, np.uint32), 0
        for b in batches:
            for text in b.column(0):
                if len(h := ngram_set(text.as_py(), n)):
                    np.add.at(counts, bucket(h, bits), 1)
                    salt = int(h[0]) % 16
        for i, part in enumerate(counts.reshape(-1, width)):
            if part.any():
                yield batch([(i, salt, packed(part))])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for i, data in zip(b.column(0).to_pylist(), b.column(2)):
                part = np.frombuffer(pa.decompress(data.as_py(), width * 4, "zstd"), np.uint32)
                sums[i] = np.minimum(sums[i] + part.astype(np.uint64), 0xFFFFFFFF) if i in sums else part.astype(np.uint64)
        for i, part in sums.items():
            yield batch([(i, 0, packed(part.astype(np.uint32)))])

    parts = docs.select(text_col).mapInArrow(count, ddl).repartition("slice", "salt").mapInArrow(add, ddl).repartition("slice").mapInArrow(add, ddl)
    table = np.zeros(((1 << bits) // width, width), np.uint16)
    for row in parts.collect():
        table[row.slice] = np.minimum(np.frombuffer(pa.decompress(bytes(row.counts), width * 4, "zstd"), np.uint32), 65535)
    return table.reshape(-1)


# --- nodes: distinct sets, each with its prefix


def signature(h: np.ndarray) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(h.tobytes(), len(h)) - (1 << 63)


def signed(h: np.ndarray) -> np.ndarray:
    return h.astype(np.uint64).view(np.int64)


def signatures(docs: DataFrame, id_col: str, text_col: str, table: np.ndarray, n: int, percent: int, hot: int) -> DataFrame:
    """(id, n, sig, tokens, n_cold, parts): tokens is the prefix, rare first, of which n_cold are in buckets below hot; parts are the sizes of the set's parts."""
    sent = docs.sparkSession.sparkContext.broadcast(table)
    bits = int(np.log2(len(table)))

    def make():
        counts = sent.value

        def row(key, text):
            h = ngram_set(text, n)
            of = counts[bucket(h, bits)]
            order = np.lexsort((h, of))[: len(h) - least(len(h), percent) + 1] if len(h) else []
            yield key, len(h), signature(h), signed(h[order]), int((of[order] < hot).sum()), packed_parts(h)

        return row

    kind = docs.schema[id_col].dataType.simpleString()
    return map_rows(docs, [id_col, text_col], f"id {kind}, n int, sig bigint, tokens array<bigint>, n_cold int, parts array<bigint>", make)


# --- candidates: pairs, and groups by their smallest node


def candidate_batches(batches: Iterator[pa.RecordBatch], schema: pa.Schema, percent: int, paired: int) -> Iterator[pa.RecordBatch]:
    """From (token, sig, size, place) sorted by token: (a, b, n_a, n_b, need), need 0 for a group."""
    rest = [np.empty(0, np.int64)] * 4
    for b in batches:
        columns = [np.concatenate([r, c.to_numpy(zero_copy_only=False).astype(np.int64)]) for r, c in zip(rest, b.columns)]
        starts = np.flatnonzero(np.diff(columns[0], prepend=columns[0][0] - 1 if len(columns[0]) else 0))
        end = starts[-1] if len(starts) else 0
        rest = [c[end:] for c in columns]
        yield from candidates([c[:end] for c in columns], schema, percent, paired)
    yield from candidates(rest, schema, percent, paired)


def candidates(columns: list[np.ndarray], schema: pa.Schema, percent: int, paired: int) -> Iterator[pa.RecordBatch]:
    token, sig, size, place = columns
    if not len(token):
        return
    starts = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
    lengths = np.diff(np.append(starts, len(token)))
    for k in np.unique(lengths[lengths > 1]):
        own = starts[lengths == k]
        if k <= paired:
            x, y = np.triu_indices(k, 1)
            x, y = (own[:, None] + x).ravel(), (own[:, None] + y).ravel()
        else:
            rows = own[:, None] + np.arange(k)
            x = np.repeat(rows[np.arange(len(own)), sig[rows].argmin(1)], k)
            y = rows.ravel()
        x, y = np.where(sig[x] < sig[y], x, y), np.where(sig[x] < sig[y], y, x)
        ok = sig[x] != sig[y]
        if k <= paired:
            need = least_of(size[x], size[y], percent)
            ok &= (least(size[x], percent) <= size[y]) & (least(size[y], percent) <= size[x])  # length filter
            # positional filter: what stands before the common n-gram in either set, and from it on
            ok &= np.minimum(place[x], place[y]) + np.minimum(size[x] - place[x], size[y] - place[y]) >= need
            suffix = np.maximum(least(size[x], percent), least(size[y], percent)) - 1
            need = np.maximum(need - suffix, 1)
        else:
            need = np.zeros(len(x), np.int64)
        x, y, need = x[ok], y[ok], need[ok]
        for at in range(0, len(x), 1 << 17):
            i, j = x[at : at + (1 << 17)], y[at : at + (1 << 17)]
            yield pa.RecordBatch.from_arrays([pa.array(c).cast(t) for c, t in zip((sig[i], sig[j], size[i], size[j], need[at : at + (1 << 17)]), schema.types)], schema=schema)


def candidate_groups(nodes: DataFrame, parts: DataFrame, percent: int, paired: int) -> DataFrame:
    """(a, b, n_a, n_b), a < b: each pair that may link has both ends in the group of one a. parts: (sig, parts) of each node."""
    cold = nodes.select(F.posexplode(F.slice("tokens", F.lit(1), F.col("n_cold"))).alias("place", "token"), "sig", "n").select("token", "sig", "n", "place")
    ddl = "a bigint, b bigint, n_a int, n_b int, need int"
    schema = arrow_schema(ddl)
    pairs = cold.repartition("token").sortWithinPartitions("token").mapInArrow(lambda batches: candidate_batches(batches, schema, percent, paired), ddl)
    hot = nodes.filter("n_cold < size(tokens)").select(F.explode(F.expr("slice(tokens, n_cold + 1, size(tokens) - n_cold)")).alias("token"), "sig", "n")
    first = written(hot.groupBy("token").agg(F.min(F.struct("sig", "n")).alias("a")), "hot")
    hot = hot.join(first, "token").filter("sig != a.sig").select(F.col("a.sig").alias("a"), F.col("sig").alias("b"), F.col("a.n").alias("n_a"), F.col("n").alias("n_b"), F.lit(0).alias("need"))
    both = pairs.unionByName(hot).groupBy("a", "b").agg(F.count("*").alias("common"), F.min("need").alias("need"), F.max("n_a").alias("n_a"), F.max("n_b").alias("n_b"))
    both = written(both.filter("common >= need"), "candidates")
    part = lambda who: parts.select(F.col("sig").alias(who), F.col("parts").alias(f"{who}_parts"))
    n = F.col("n_a") + F.col("n_b")
    most = n - 2 * F.floor((n * percent + 99 + percent) / (100 + percent))  # in which linked sets of these sizes differ
    near = both.filter("need > 0").join(part("a"), "a").join(part("b"), "b").filter(parts_differ("a_parts", "b_parts") <= most)  # suffix filter
    columns = ["a", "b", "n_a", "n_b"]
    return near.select(columns).unionByName(both.filter("need = 0").select(columns))


def packed_parts(h: np.ndarray) -> list[int]:
    """Sizes of the set's parts, at most 255 each, eight to a number."""
    sizes = np.minimum(np.bincount((h % np.uint64(PARTS)).astype(np.int64), minlength=PARTS), 255).astype(np.uint8)
    return sizes.view(np.int64).tolist()


def parts_differ(one: str, two: str):
    """Sum of the differences of two columns of packed sizes: no more than the number of n-grams that only one of the sets has."""
    size = lambda c, i, k: F.shiftright(F.get(c, i), 8 * k).bitwiseAND(F.lit(255))
    return sum((F.abs(size(one, i, k) - size(two, i, k)) for i in range(PARTS // 8) for k in range(8)), F.lit(0))


# --- verification in blocks


def forest(sigs: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """(smallest, member) of each connected class of two or more."""
    sizes = np.array([len(s) for s in sets])
    values, at = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(at, kind="stable")
    bounds = np.searchsorted(at[order], np.arange(len(values) + 1))
    owner_of, begin = owner[order], np.concatenate([[0], np.cumsum(sizes)])
    root, left = np.arange(len(sets)), np.ones(len(sets), bool)
    while True:
        open_ = np.flatnonzero(left)
        classes, counts = np.unique(root[open_], return_counts=True)
        if len(classes) < 2:
            break
        # any class but the largest: its open nodes must be counted against the others
        x = open_[root[open_] == classes[counts.argmin()]][0]
        left[x] = False
        own = at[begin[x] : begin[x + 1]]
        common = np.bincount(np.concatenate([owner_of[bounds[v] : bounds[v + 1]] for v in own]), minlength=len(sets))
        linked = common * (100 + percent) >= percent * (sizes + sizes[x])
        root[np.isin(root, root[linked])] = root[linked].min()
    return [(int(sigs[np.flatnonzero(root == r)].min()), int(s)) for s, r in zip(sigs, root)]


def links(docs: DataFrame, nodes: DataFrame, groups: DataFrame, id_col: str, text_col: str, n: int, percent: int, block: int) -> DataFrame:
    """(u, v): links that connect every class of linked nodes."""
    total = groups.groupBy("a").agg((F.sum("n_b") + F.max("n_a")).alias("total"))
    members = groups.select("a", F.col("b").alias("sig")).unionByName(total.select("a", F.col("a").alias("sig")))
    blocks = F.ceil(F.col("total") / block).cast("int").alias("blocks")
    members = members.join(total.select("a", blocks), "a").groupBy("sig").agg(F.collect_list(F.struct("a", "blocks")).alias("groups"))
    need = members.join(nodes.select("sig", "id"), "sig")
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(need, "id").select("text", "sig", "groups")

    def make():
        def row(text, sig, groups):
            h = ngram_set(text, n)
            if signature(h) == sig:  # else another row with the same id
                data = h.tobytes()
                for g in groups:
                    if g["blocks"] == 1:
                        yield g["a"], 0, 0, sig, data
                    else:
                        own = sig % g["blocks"]
                        for other in range(g["blocks"]):
                            if other != own:
                                yield g["a"], min(own, other), max(own, other), sig, data

        return row

    sets = map_rows(texts, texts.columns, "a bigint, i int, j int, sig bigint, data binary", make)

    def resolve(rows):
        key, sigs, found = None, [], []
        for *own, sig, data in rows:
            if own != key:
                yield from ends(sigs, found)
                key, sigs, found = own, [], []
            if not sigs or sigs[-1] != sig:  # a repeated row comes twice
                sigs.append(sig)
                found.append(np.frombuffer(data, np.uint64))
        yield from ends(sigs, found)

    def ends(sigs, found):
        if len(sigs) == 2:
            a, b = found
            common = len(np.intersect1d(a, b, True))
            if common * (100 + percent) >= percent * (len(a) + len(b)):
                yield min(sigs), max(sigs)
        elif sigs:
            yield from (e for e in forest(np.array(sigs), found, percent) if e[0] != e[1])

    return ordered(sets.repartition("a", "i", "j").sortWithinPartitions("a", "i", "j", "sig"), "u bigint, v bigint", resolve).distinct()


# --- connected classes


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of each node of an edge (u, v); root is the smallest node of its class."""

    def around(e: DataFrame) -> DataFrame:
        return e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))

    def star(e: DataFrame) -> DataFrame:
        """Each node's neighbours, and itself, move to its smallest neighbour."""
        low = e.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("low"))
        return e.join(low, "u")

    edges, seen = written(edges, "edges"), None
    while True:
        large = star(around(edges)).filter("v > u").select(F.col("v").alias("u"), F.col("low").alias("v")).filter("u != v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        small = star(down)
        small = small.select(F.col("v").alias("u"), F.col("low").alias("v")).unionByName(small.select("u", F.col("low").alias("v"))).filter("u != v").distinct()
        edges = written(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")), "edges")
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = N, percent: int = PERCENT, bits: int = TABLE_BITS, paired: int = PAIRED, hot: int = HOT, block: int = BLOCK) -> DataFrame:
    """(id, n_shingles, component_id) of each row: the size of its set, and the smallest id reachable by links."""
    rows = written(signatures(docs, id_col, text_col, count_table(docs, text_col, n, bits), n, percent, hot), "signatures")
    known = rows.filter("n > 0 and id is not null")
    smallest = known.groupBy("sig").agg(F.min("id").alias("id"))
    nodes = known.join(smallest, ["sig", "id"]).dropDuplicates(["sig"])
    parts = written(known.select("sig", "parts").dropDuplicates(["sig"]), "parts")  # a short row for each node, without its prefix
    groups = written(candidate_groups(nodes, parts, percent, paired), "groups")
    found = components(links(docs, smallest, groups, id_col, text_col, n, percent, block))
    of = found.join(smallest, found.node == smallest.sig)
    roots = of.groupBy("root").agg(F.min("id").alias("component_id"))
    of = smallest.join(found.join(roots, "root"), smallest.sig == found.node, "left").select("sig", F.coalesce("component_id", "id").alias("component_id"))
    # written, so that both sides of the join are dealt for it, and Spark can split a set that many documents have
    out = rows.select("id", "n", "sig").join(written(of, "classes"), "sig", "left")
    return out.select(F.col("id").alias(id_col), F.col("n").cast("long").alias("n_shingles"), F.when(F.col("n") > 0, F.when(F.col("id").isNotNull(), F.col("component_id"))).otherwise(F.col("id")).alias("component_id"))
