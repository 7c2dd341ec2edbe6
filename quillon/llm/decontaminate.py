"""Benchmark decontamination by a positional inverted index of the training texts.

Words are lower-cased in A-Z and parted by every other ASCII character that is not a letter or a digit. A window is
`span` consecutive words of a benchmark item; an item of fewer words, but not none, is one window. For a block of the
benchmark (whose size is bounded, so that it can be sent to all tasks):

1. The documents with each of the block's words are counted. A window with a word that no document has cannot occur;
   the words of the others are put in order, rarest first.
2. The index is written: for each document the places of the block's words (its posting lists), and the windows whose
   words it all has, found from each window's rarest word on. Documents without such a window need no lists. Lists
   stay with their document, so that a word of a third of all documents is never brought to one place.
3. For each window of a document the lists, each moved back by its word's place in the window, are intersected, rarest
   first. What is left are exact phrases; with `slop` a word may also stand that far from its place (proximity).

A benchmark of more than a block is taken in blocks, each with its own passes over the documents. Null texts have no
words. Items with a null id hit words but are not listed. Repeated items count once, repeated documents each.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, map_rows, written

SPAN = 10
#: Bytes of benchmark texts in a block.
BLOCK = 16 << 20

_KEPT = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_KEPT).split()


class Items:
    """A block of the benchmark: its vocabulary, and its items' windows as word numbers."""

    def __init__(self, texts: list[str | None], span: int = SPAN):
        self.number: dict[bytes, int] = {}
        windows, self.item, self.size = [], [], []
        for i, text in enumerate(texts):
            own = [self.number.setdefault(w, len(self.number)) for w in words(text)]
            for s in range(max(1, len(own) - span + 1) if own else 0):
                window = own[s : s + span]
                windows.append(window + [window[0]] * (span - len(window)))
                self.item.append(i)
                self.size.append(len(window))
        self.windows = np.array(windows, np.int64).reshape(-1, span)

    def choose(self, documents: np.ndarray) -> None:
        """Keep the windows whose words all occur, by their rarest word; documents: those with each word."""
        counts = documents[self.windows]
        alive = np.flatnonzero(counts.all(1))
        order = np.argsort(counts[alive], axis=1, kind="stable")
        rarest = self.windows[alive, order[:, 0]]
        by = np.argsort(rarest, kind="stable")
        self.windows, self.order = self.windows[alive[by]], order[by]
        self.item, self.size = np.array(self.item, np.int64)[alive[by]], np.array(self.size, np.int64)[alive[by]]
        #: windows first[t] to first[t + 1] have t for their rarest word
        self.first = np.searchsorted(rarest[by], np.arange(len(documents) + 1))
        self.rare_first = np.take_along_axis(self.windows, self.order, 1)

    def held(self, terms: np.ndarray) -> np.ndarray:
        """Windows whose words are all among terms (distinct)."""
        begin, n = self.first[terms], self.first[terms + 1] - self.first[terms]
        found = np.repeat(begin - np.cumsum(n) + n, n) + np.arange(n.sum())
        present = np.zeros(len(self.first), bool)
        present[terms] = True
        for k in range(1, self.windows.shape[1]):
            if not len(found):
                break
            found = found[present[self.rare_first[found, k]]]
        return found

    def matches(self, w: int, terms: np.ndarray, places: np.ndarray, slop: int) -> np.ndarray:
        """(match, word): the places that window w's words take, from lists sorted by word, then place."""
        own, starts, found = self.windows[w][: self.size[w]], None, {}
        for k in self.order[w]:
            if k >= len(own):
                continue
            a, b = np.searchsorted(terms, [own[k], own[k] + 1])
            moved = places[a:b] - k
            if starts is None:
                starts, found[k] = moved, places[a:b]
                continue
            after = np.minimum(np.searchsorted(moved, starts), len(moved) - 1)
            ahead = np.maximum(after - 1, 0)
            near = np.where(np.abs(moved[ahead] - starts) <= np.abs(moved[after] - starts), ahead, after)
            ok = np.abs(moved[near] - starts) <= slop
            starts, found = starts[ok], {i: x[ok] for i, x in found.items()} | {k: places[a:b][near[ok]]}
            if not len(starts):
                break
        return np.stack(list(found.values()), 1)


def document_counts(docs: DataFrame, text_col: str, items: Items) -> np.ndarray:
    """Documents with each word of the block; what comes to the driver is a number for each."""
    ddl = "term int, n bigint"
    schema, sent = arrow_schema(ddl), docs.sparkSession.sparkContext.broadcast(items.number)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = sent.value
        known, counts = frozenset(number), np.zeros(len(number), np.int64)
        for b in batches:
            for text in b.column(0):
                for w in known.intersection(words(text.as_py())):
                    counts[number[w]] += 1
        terms = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(terms, pa.int32()), pa.array(counts[terms], pa.int64())], schema=schema)

    out = np.zeros(len(items.number), np.int64)
    for r in docs.select(text_col).mapInArrow(count, ddl).groupBy("term").agg(F.sum("n").alias("n")).collect():
        out[r.term] = r.n
    return out


def index(docs: DataFrame, id_col: str, text_col: str, items: Items) -> DataFrame:
    """(row, id, n_words, windows, terms, places) of every document, row a hash of its id and text. terms and places are the posting lists one after the other, only where a window has all its words."""
    sent = docs.sparkSession.sparkContext.broadcast(items)

    def make():
        items = sent.value
        get, nothing = items.number.get, repeat(-1)

        def row(row, key, text):
            own = words(text)
            terms = np.fromiter(map(get, own, nothing), np.int64, len(own))
            places = np.flatnonzero(terms >= 0)
            terms = terms[places]
            by = np.argsort(terms, kind="stable")
            terms, places = terms[by], places[by]
            windows = items.held(terms[np.flatnonzero(np.diff(terms, prepend=-1))])
            if len(windows):
                yield row, key, len(own), windows, terms, places
            else:
                yield row, key, len(own), [], [], []

        return row

    kind = docs.schema[id_col].dataType.simpleString()
    docs = docs.select(F.xxhash64(id_col, text_col).alias("row"), id_col, text_col)
    return written(map_rows(docs, docs.columns, f"row bigint, id {kind}, n_words bigint, windows array<int>, terms array<int>, places array<int>", make), "postings")


def lists(column: pa.Array) -> list[np.ndarray]:
    """The values of each row of a column of lists."""
    values, at = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    return [values[a:b] for a, b in zip(at[:-1], at[1:])]


def hits_of_block(docs: DataFrame, benchmark: list, id_col: str, text_col: str, span: int, slop: int) -> DataFrame:
    """(row, id, n_words, places, items) of every document. Only those with a window's words go through Python."""
    items = Items([r.text for r in benchmark], span)
    items.choose(document_counts(docs, text_col, items))
    indexed = index(docs, id_col, text_col, items)
    sent = docs.sparkSession.sparkContext.broadcast((items, [r.item_id for r in benchmark]))
    kind = docs.schema[id_col].dataType.simpleString()
    ddl = f"row bigint, id {kind}, n_words bigint, places array<int>, items array<string>"
    schema = arrow_schema(ddl)

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, ids = sent.value
        names = [None if i is None else str(i) for i in ids]
        for b in batches:
            places, found = [], []
            for windows, terms, own in zip(*(lists(b.column(i)) for i in (3, 4, 5))):
                hits = [(w, x) for w in windows if len(x := items.matches(w, terms, own, slop))]
                places.append(np.unique(np.concatenate([x.ravel() for _, x in hits])).astype(np.int32) if hits else [])
                found.append(sorted({names[items.item[w]] for w, _ in hits} - {None}))
            columns = [*b.columns[:3], pa.array(places, schema.types[3]), pa.array(found, schema.types[4])]
            yield pa.RecordBatch.from_arrays([c.cast(t) for c, t in zip(columns, schema.types)], schema=schema)

    held = F.size("windows") > 0
    others = indexed.filter(~held).select("row", "id", "n_words", F.array().cast("array<int>").alias("places"), F.array().cast("array<string>").alias("items"))
    return indexed.filter(held).mapInArrow(match, ddl).unionByName(others)


def find(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", span: int = SPAN, slop: int = 0, block: int = BLOCK) -> DataFrame:
    """(id, n_words, places array<int>, items array<string>) of each document: the places of its hit words, ascending, and the items with a window in it, sorted."""
    items = benchmark.select(F.col(item_col).alias("item_id"), F.col(item_text).alias("text")).distinct()
    blocks = 1 + (items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // block
    parts = []
    for k in range(blocks):
        own = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).collect()
        parts.append(hits_of_block(docs, own, id_col, text_col, span, slop))
    found = reduce(DataFrame.unionByName, parts)
    if blocks > 1:  # a document comes once from each block; repeated rows of it are dealt out again
        union = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c)
        found = found.groupBy("row", "id").agg(F.first("n_words").alias("n_words"), union("places"), union("items"), (F.count("*") / blocks).cast("int").alias("copies"))
        found = found.withColumn("copy", F.explode(F.sequence(F.lit(1), "copies")))
    return found.select(F.col("id").alias(id_col), "n_words", "places", "items")


def digests(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return found.select(
        id_col,
        "n_words",
        F.size("places").cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("places") > 0).alias("contaminated"),
    )
