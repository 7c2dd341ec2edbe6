"""Substring removal by spans of consecutive sentences.

Words are parted by ASCII white space, their letters A-Z lower-cased. A sentence ends after a word with one of .!? at
its end, and at a line end. Where no such end is near, so in text without stops, it also ends after a word that its
own digest chooses (one in four): these ends are the same in every copy of a passage, whatever surrounds it. From each
sentence on, the shortest run of `width` or more sentences with `least` or more words is a span. Of the spans with
equal words anywhere the first (smallest document id, then place) stays; the sentences that any other covers are
removed, and what is left keeps its own white space.

Spans are hashed (128 bits) and counted by 64 bits of their hash; only those that may repeat are joined with the whole
hash, and with the first of each. Texts of fewer sentences or words have no span, however often they come. Null texts
are empty, documents with a null id come first, of equal ids the rows are told apart by a hash of their text; rows with
equal id and text are one document. Other columns, whatever their names, are left out; an empty table gives an empty
one. A very long text is one row of a task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import FLUSH_BYTES, arrow_schema, map_rows, written

#: Least sentences and words of a span.
WIDTH, LEAST = 2, 24
#: Words that a chosen end keeps from the nearest stop or line end; first digits of the digests that choose a word.
NEAR, CHOSEN = 8, "0123"
#: Words whose kind is remembered.
KNOWN = 1 << 20
_WHITE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
STOP, CHOICE = 2, 1


class Kinds(dict):
    """STOP for a word that ends a sentence, CHOICE for one chosen by its digest, else 0."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= KNOWN:
            self.clear()
        kind = STOP if word[-1:] in (b".", b"!", b"?") else CHOICE if hashlib.md5(word).hexdigest()[0] in CHOSEN else 0
        self[word] = kind
        return kind


def words(text: str | None) -> tuple[list[bytes], np.ndarray]:
    """The words, and the places of those that end a line."""
    rows = [line.split() for line in (text or "").encode().lower().split(b"\n")]
    return list(chain.from_iterable(rows)), np.cumsum([len(row) for row in rows if row], dtype=np.int64) - 1


def ends(own: list[bytes], line_ends: np.ndarray, kinds: Kinds) -> np.ndarray:
    """Where sentences end, as a number of words, ascending, from 0 on."""
    kind = np.fromiter(map(kinds.__getitem__, own), np.int8, len(own))
    kind[line_ends] = STOP
    stops = np.concatenate([[-1], np.flatnonzero(kind == STOP)])
    chosen = np.flatnonzero(kind == CHOICE)
    after = np.searchsorted(stops, chosen)
    chosen = chosen[(chosen - stops[after - 1] >= NEAR) & (stops[np.minimum(after, len(stops) - 1)] - chosen >= NEAR)] if len(chosen) else chosen
    return np.sort(np.concatenate([stops, chosen])) + 1


def spans(own: list[bytes], end: np.ndarray, width: int = WIDTH, least: int = LEAST) -> np.ndarray:
    """(span, 2): two 64-bit hashes of each span's words. Span i begins with sentence i."""
    from xxhash import xxh3_128_digest

    until = last_sentences(end, width, least)
    start = np.concatenate([[0], np.cumsum(np.fromiter(map(len, own), np.int64, len(own)) + 1)])
    data = memoryview(b" ".join(own))
    found = [xxh3_128_digest(data[a:b]) for a, b in zip(start[end[: len(until)]].tolist(), (start[end[until]] - 1).tolist())]
    return np.frombuffer(b"".join(found), np.int64).reshape(-1, 2)


def last_sentences(end: np.ndarray, width: int, least: int) -> np.ndarray:
    """For each span the number of sentences up to its last one."""
    until = np.maximum(np.searchsorted(end, end[:-1] + least), np.arange(len(end) - 1) + width)
    return until[until < len(end)]


def span_rows(docs: DataFrame, id_col: str, text_col: str, width: int, least: int, whole: bool) -> DataFrame:
    """(a, b, row, id, place) of every span, or only a; a and b are its hash, place its first sentence."""
    kind = docs.schema[id_col].dataType.simpleString()
    ddl = f"a bigint, b bigint, row bigint, id {kind}, place int" if whole else "a bigint"
    schema = arrow_schema(ddl)

    def batch(ids: pa.Array, own: list[tuple]) -> pa.RecordBatch:
        """own: (place in ids, row, hashes) of some documents."""
        n = [len(h) for _, _, h in own]
        h = np.concatenate([h for _, _, h in own])
        columns = [pa.array(h[:, 0])]
        if whole:
            at = pa.array(np.repeat([i for i, _, _ in own], n))
            columns += [pa.array(h[:, 1]), pa.array(np.repeat([r for _, r, _ in own], n)), ids.take(at), pa.array(np.concatenate([np.arange(k, dtype=np.int32) for k in n]))]
        return pa.RecordBatch.from_arrays([c.cast(t) for c, t in zip(columns, schema.types)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = Kinds()
        for b in batches:
            own, size = [], 0
            for i, (row, text) in enumerate(zip(b.column(0).to_pylist(), b.column(2))):
                text = text.as_py()
                own_words, line_ends = words(text)
                found = spans(own_words, ends(own_words, line_ends, kinds), width, least)
                if len(found):
                    own.append((i, row, found))
                size += len(text or "")
                if own and size >= FLUSH_BYTES:
                    yield batch(b.column(1), own)
                    own, size = [], 0
            if own:
                yield batch(b.column(1), own)

    return docs.select("row", id_col, text_col).mapInArrow(run, ddl)


def repeated(docs: DataFrame, id_col: str, text_col: str, width: int, least: int) -> DataFrame:
    """(row, places array<int>): spans of each document, by their first sentence, that stand somewhere before.

    The sides of both joins are written, so that they are dealt for it alike and Spark can split a hot hash.
    """
    often = span_rows(docs, id_col, text_col, width, least, False).groupBy("a").agg(F.count("*").alias("n")).filter("n > 1")
    rows = span_rows(docs, id_col, text_col, width, least, True)
    rows = written(rows.join(written(often.select("a"), "often"), "a"), "often")
    first = F.min(F.struct(F.col("id").isNotNull().alias("known"), "id", "row", "place"))
    first = rows.groupBy("a", "b").agg(F.count("*").alias("n"), first.alias("first")).filter("n > 1").drop("n")
    again = rows.join(written(first, "repeated"), ["a", "b"]).filter((F.col("row") != F.col("first.row")) | (F.col("place") != F.col("first.place")))
    return again.groupBy("row").agg(F.collect_set("place").alias("places"))


def remove(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, least: int = LEAST) -> DataFrame:
    """(id, text, n_sentences, n_removed) of each document, text without the sentences of repeated spans."""
    docs = docs.select(F.xxhash64(id_col, text_col).alias("row"), id_col, text_col)
    kind = docs.schema[id_col].dataType.simpleString()

    def make():
        kinds = Kinds()

        def row(key, text, places):
            end = ends(*words(text), kinds)
            n = len(end) - 1
            if not places:
                yield key, text or "", n, 0
                return
            until, gone = last_sentences(end, width, least), np.zeros(n, bool)
            for p in places:
                gone[p : until[p]] = True
            data = text.encode()
            white = _WHITE[np.frombuffer(data, np.uint8)]
            starts = np.flatnonzero(white[:-1] & ~white[1:]) + 1  # of words after white space, so of all but one at the start
            starts = starts if white[0] else np.concatenate([[0], starts])
            edges = [0, *starts[end[1:-1]].tolist(), len(data)]
            kept = b"".join(data[a:b] for a, b, g in zip(edges, edges[1:], gone) if not g)
            yield key, kept.decode(), n, int(gone.sum())

        return row

    kept = docs.join(repeated(docs, id_col, text_col, width, least), "row", "left")
    return map_rows(kept, [id_col, text_col, "places"], f"`{id_col}` {kind}, text string, n_sentences bigint, n_removed bigint", make)


def digests(removed: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return removed.select(id_col, "n_sentences", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def remove_sql(width: int = WIDTH, least: int = LEAST, table: str = "documents") -> str:
    """digests(remove(...)) in DuckDB's SQL: a row for each word, with the white space after it."""
    white, capitals = "[ \\t\\n\\r\\f\\v]", "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
    digits = ", ".join(f"'{c}'" for c in CHOSEN)
    return f"""
        WITH docs AS (SELECT *, row_number() OVER (ORDER BY doc_id NULLS FIRST, text) AS d FROM (SELECT DISTINCT doc_id, coalesce(text, '') AS text FROM {table})),
        cut AS (SELECT d, doc_id, text, regexp_extract(text, '^{white}*') AS head, regexp_extract_all(text, '[^ \\t\\n\\r\\f\\v]+{white}*') AS parts FROM docs),
        words AS (SELECT d, unnest(parts) AS part, unnest(range(1, len(parts) + 1)) AS i, len(parts) AS n FROM cut),
        forms AS (SELECT d, i, translate(regexp_extract(part, '^[^ \\t\\n\\r\\f\\v]+'), {capitals}) AS w, contains(part, chr(10)) OR i = n AS line_end FROM words),
        kinds AS (SELECT d, i, w, line_end OR right(w, 1) IN ('.', '!', '?') AS stop, md5(w)[1] IN ({digits}) AS chosen FROM forms),
        near AS (SELECT *, coalesce(max(CASE WHEN stop THEN i END) OVER (PARTITION BY d ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
            min(CASE WHEN stop THEN i END) OVER (PARTITION BY d ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS after FROM kinds),
        ended AS (SELECT d, i FROM near WHERE stop OR chosen AND i - before >= {NEAR} AND after - i >= {NEAR}),
        bounds AS (SELECT d, list_prepend(0, list(i ORDER BY i)) AS e FROM ended GROUP BY d),
        starts AS (SELECT d, e, unnest(range(1, len(e))) AS place FROM bounds),
        until AS (SELECT d, e, place, list_filter(range(place + {width}, len(e) + 1), lambda j: e[j] - e[place] >= {least})[1] AS last FROM starts),
        lists AS (SELECT d, list(w ORDER BY i) AS ws FROM forms GROUP BY d),
        spans AS (SELECT d, place, last, array_to_string(ws[e[place] + 1 : e[last]], ' ') AS form FROM until JOIN lists USING (d) WHERE last IS NOT NULL),
        ranked AS (SELECT d, place, last, row_number() OVER (PARTITION BY form ORDER BY d, place) AS nth FROM spans),
        gone AS (SELECT d, list(DISTINCT spot) AS gone FROM (SELECT d, unnest(range(place, last)) AS spot FROM ranked WHERE nth > 1) GROUP BY d),
        result AS (SELECT cut.doc_id, cut.text, coalesce(len(e) - 1, 0)::BIGINT AS n_sentences, coalesce(len(gone), 0)::BIGINT AS n_removed,
            CASE WHEN gone IS NULL THEN cut.text ELSE CASE WHEN list_contains(gone, 1) THEN '' ELSE head END
                || array_to_string(list_transform(list_filter(range(1, len(e)), lambda k: NOT list_contains(gone, k)), lambda k: array_to_string(parts[e[k] + 1 : e[k + 1]], '')), '') END AS kept
            FROM cut LEFT JOIN bounds USING (d) LEFT JOIN gone USING (d))
        SELECT r.doc_id, n_sentences, n_removed, sha256(kept) AS kept_sha256
        FROM {table} t JOIN result r ON t.doc_id IS NOT DISTINCT FROM r.doc_id AND coalesce(t.text, '') = r.text"""
