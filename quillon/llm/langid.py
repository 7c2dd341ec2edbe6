"""Language identification by unigrams of a fixed vocabulary's pieces, all segmentations summed.

A text is its words, parted by ASCII white space, each with a space before it. A language gives a word the sum, over
all ways to cut it into pieces of the vocabulary, of the products of the pieces' probabilities; a forward pass adds
them up. Every single byte is a piece, so each word has such a cut. Words without a letter are left out. The
probabilities come from expectation-maximisation on the labelled texts: a forward and a backward pass give the
expected count of each piece, and those are mixed with the counts over all languages.

Fitting takes at most about `per_language` labelled texts of each language, chosen by a hash of their id: that bound
is a parameter, and is all that limits it. Words of any length count; one of over PART bytes is counted in parts of at
most so many, cut between characters. A null text, one without a letter, and any text where nothing could be
learned is `und` with score 0. Repeated rows are predicted alike, each for itself, and languages that tie go to the
first by name; an empty table gives an empty one; a very long text is scored in chunks. Columns named like the two new ones, in either case, are replaced.
"""

from __future__ import annotations

import base64
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, written
from .suffixes import BASE, INVERSE, LETTERS, powers

#: Labelled texts of a language to fit on; rounds of fitting; share of the counts over all languages; bytes after which probabilities are scaled.
PER_LANGUAGE, ROUNDS, SHARED, SCALED = 5000, 3, 0.02, 12
#: Bytes of a word up to which many words are scored at once; bytes of text that are scored at once.
SHORT, CHUNK = 64, 1 << 20
#: Bytes of a word up to which it is fitted whole; places of words that are fitted at once, beside those of short words.
PART, PLACES = 4096, 1 << 20
#: Places of one long word whose pieces are looked up at once.
AHEAD = 1 << 16
UNKNOWN = "und"
#: A letter: number signs, Roman ones too, are none.
LETTER = regex.compile(r"\p{L}")


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


class Vocabulary:
    """All pieces, and every single byte, found by polynomial hash."""

    def __init__(self, path: str, bits: int = 18):
        with open(path, "rb") as lines:
            pieces = {base64.b64decode(x.split()[0]) for x in lines}
        self.pieces = sorted(pieces | {bytes([i]) for i in range(256)})
        self.lengths = sorted({len(p) for p in self.pieces})
        self.longest = self.lengths[-1]
        self.none, self.shift = len(self.pieces), np.uint64(64 - bits)
        h = np.array([(LETTERS[np.frombuffer(p, np.uint8)] * powers(BASE, self.longest)[: len(p)]).sum() for p in self.pieces], np.uint64)
        self.key, self.id, self.shared = np.zeros(1 << bits, np.uint64), np.full(1 << bits, self.none, np.int32), np.zeros(1 << bits, bool)
        slot, (_, first) = self.slot(h), np.unique(self.slot(h), return_index=True)
        self.key[slot[first]], self.id[slot[first]] = h[first], first
        # pieces whose slot is taken stand in a sorted list
        rest = np.setdiff1d(np.arange(len(h)), first)
        self.shared[slot[rest]] = True
        rest = rest[np.argsort(h[rest])]
        self.more_keys, self.more_ids = h[rest], rest.astype(np.int32)

    def slot(self, h: np.ndarray) -> np.ndarray:
        return ((h * np.uint64(0x9FB21C651E98DF25)) >> self.shift).astype(np.int64)

    def find(self, h: np.ndarray) -> np.ndarray:
        """The piece of each hash, or none."""
        slot = self.slot(h)
        same = self.key[slot] == h
        out = np.where(same, self.id[slot], self.none)
        if len(open_ := np.flatnonzero(self.shared[slot] & ~same)):
            at = np.minimum(np.searchsorted(self.more_keys, h[open_]), len(self.more_keys) - 1)
            out[open_] = np.where(self.more_keys[at] == h[open_], self.more_ids[at], self.none)
        return out


@lru_cache(maxsize=1)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(LETTERS[data] * powers(BASE, len(data))[: len(data)], out=out[1:])
    return out


def growth(shift: np.ndarray) -> np.ndarray:
    """exp(shift), finite: a shift this large stands only where there is no piece."""
    return np.exp(np.minimum(shift, 700.0))


class Lattice:
    """The pieces of many words, by the place where they end and by their length. Words are ordered from the longest on."""

    def __init__(self, prefix: np.ndarray, start: np.ndarray, size: np.ndarray, known: Vocabulary):
        self.order = np.argsort(-size, kind="stable")
        start, self.size = start[self.order], size[self.order]
        self.longest = int(size.max(initial=0))
        back = powers(INVERSE, len(prefix))
        self.steps = []  # (end, words that are long enough, (piece's length, pieces)...)
        for e in range(1, self.longest + 1):
            own = start[: np.searchsorted(-self.size, -e, "right")] + e
            self.steps.append((e, len(own), [(k, known.find((prefix[own] - prefix[own - k]) * back[own - k])) for k in known.lengths if k <= e]))

    def forward(self, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Probability of the first bytes of each word, (place, word, column of p), and the logarithm by which each place of a word is scaled, (place, word). The last row of p is for no piece."""
        a = np.zeros((self.longest + 1, len(self.size), p.shape[1]))
        scale = np.zeros((self.longest + 1, len(self.size)))
        a[0] = 1
        for e, n, pieces in self.steps:
            scale[e, :n] = scale[e - 1, :n]
            for k, piece in pieces:
                part = a[e - k, :n] * p[piece]
                a[e, :n] += part * growth(scale[e - k, :n] - scale[e, :n])[:, None] if e > SCALED else part
            if e % SCALED == 0:
                top = a[e, :n].max(1)
                a[e, :n] /= top[:, None]
                scale[e, :n] += np.log(top)
        return a, scale

    def log_probabilities(self, p: np.ndarray) -> np.ndarray:
        """(word, column of p), in the order that the words were given."""
        a, scale = self.forward(p)
        every = np.arange(len(self.size))
        out = np.empty((len(self.size), p.shape[1]))
        out[self.order] = np.log(a[self.size, every]) + scale[self.size, every][:, None]
        return out

    def expected(self, p: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Expected count of each piece under p (one column), each word counting weight times."""
        a, scale = self.forward(p[:, None])
        a, every, weight = a[:, :, 0], np.arange(len(self.size)), weight[self.order]
        end = scale[self.size, every]
        b = np.zeros_like(a)
        b[self.size, every] = 1 / a[self.size, every]
        counts = np.zeros(len(p))
        for e, n, pieces in reversed(self.steps):
            for k, piece in pieces:
                # b is scaled against a, so that a * b is the share of segmentations through a place
                part = p[piece] * b[e, :n] * growth(scale[e - k, :n] - scale[e, :n])
                b[e - k, :n] += part
                counts += np.bincount(piece, a[e - k, :n] * part * weight[:n], len(p))
        return counts


def padded(p: np.ndarray) -> np.ndarray:
    """p with a row of zeros for no piece."""
    return np.concatenate([p, np.zeros((1, *p.shape[1:]))])


def parts_of(word: bytes) -> list[bytes]:
    """The word with the space before it; a longer one than PART cut between characters."""
    word, out = b" " + word, []
    while len(word) > PART:
        at = next((i for i in range(PART, PART - 4, -1) if word[i] & 0xC0 != 0x80), PART)
        out.append(word[:at])
        word = word[at:]
    return [*out, word]


def fitted_together(size: np.ndarray) -> Iterator[np.ndarray]:
    """Places in size: all short ones, then longer ones of like size, so that no lattice gets large."""
    yield np.flatnonzero(size <= SHORT)
    order = np.argsort(size, kind="stable")
    order, i = order[size[order] > SHORT][::-1], 0
    while i < len(order):
        n = max(1, PLACES // int(size[order[i]]))
        yield order[i : i + n]
        i += n


def lattice_of(words: list[bytes], known: Vocabulary) -> Lattice:
    return lattice_of_parts([b" " + w for w in words], known)


def lattice_of_parts(parts: list[bytes], known: Vocabulary) -> Lattice:
    data = np.frombuffer(b"".join(parts), np.uint8)
    size = np.array([len(w) for w in parts])
    return Lattice(prefix_hashes(data), np.cumsum(size) - size, size, known)


@dataclass
class Model:
    languages: list[str]
    #: (piece, language)
    p: np.ndarray
    ranks_path: str


_WHITE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_LETTER = np.array([chr(i).isalpha() and i < 128 for i in range(256)])
_TO_SPACE = bytes(32 if _WHITE[i] else i for i in range(256))


class Scorer:
    """Log-probabilities of texts in each language; equal words of a chunk of texts are scored once."""

    def __init__(self, model: Model):
        self.known, self.p = vocabulary(model.ranks_path), padded(model.p)

    def long(self, word: bytes) -> np.ndarray:
        """One word of any length."""
        n, longest = len(word), self.known.longest
        prefix = prefix_hashes(np.frombuffer(word, np.uint8))
        back = powers(INVERSE, n + 1)
        last, scale = np.zeros((longest, self.p.shape[1])), np.zeros(self.p.shape[1])
        last[-1] = 1
        for begin in range(1, n + 1, AHEAD):
            ends = np.arange(begin, min(begin + AHEAD, n + 1))
            piece = np.full((len(ends), longest), self.known.none)
            for k in self.known.lengths:
                own = ends[max(0, k - begin) :]
                piece[len(ends) - len(own) :, longest - k] = self.known.find((prefix[own] - prefix[own - k]) * back[own - k])
            for e, row in zip(ends.tolist(), piece):
                now = (last * self.p[row]).sum(0)
                last[:-1] = last[1:]
                last[-1] = now
                if e % SCALED == 0:
                    scale += np.log(now)  # of each language
                    last /= now
        return np.log(last[-1]) + scale

    def words(self, data: bytes, starts: np.ndarray, ends: np.ndarray, prefix: np.ndarray) -> np.ndarray:
        """(word, language) of words in data, each with the space before it. Words without a letter score 0."""
        out = np.zeros((len(starts), self.p.shape[1]))
        letters = np.concatenate([[0], np.cumsum(_LETTER[np.frombuffer(data, np.uint8)])])
        lettered = letters[ends] > letters[starts]
        for i in np.flatnonzero(~lettered):
            lettered[i] = bool(LETTER.search(data[starts[i] : ends[i]].decode(errors="replace")))
        size = ends - starts + 1
        short = np.flatnonzero(lettered & (size <= SHORT))
        short = short[np.argsort(size[short], kind="stable")]
        for i in range(0, len(short), 20_000):
            own = short[i : i + 20_000]
            out[own] = Lattice(prefix, starts[own] - 1, size[own], self.known).log_probabilities(self.p)
        for i in np.flatnonzero(lettered & (size > SHORT)):
            out[i] = self.long(data[starts[i] - 1 : ends[i]])
        return out

    def texts(self, texts: list[str | None]) -> np.ndarray:
        """(text, language): log-probability."""
        out = np.zeros((len(texts), self.p.shape[1]))
        encoded = [(t or "").encode() for t in texts]
        data = (b" " + b" ".join(encoded)).translate(_TO_SPACE)
        bytes_ = np.frombuffer(data, np.uint8)
        edges = np.flatnonzero(np.diff(bytes_ == 32, prepend=True, append=True))
        starts, ends = edges[::2], edges[1::2]
        if not len(starts):
            return out
        prefix = prefix_hashes(bytes_)
        h = (prefix[ends] - prefix[starts]) * powers(INVERSE, len(data))[starts]
        _, first, inverse = np.unique(h, return_index=True, return_inverse=True)
        scores = self.words(data, starts[first], ends[first], prefix)
        begin = np.cumsum([1, *(len(e) + 1 for e in encoded)])  # of each text in data
        bounds = np.searchsorted(starts, begin)
        own = np.flatnonzero(bounds[1:] > bounds[:-1])
        out[own] = np.add.reduceat(scores[inverse], bounds[own])
        return out


def fit(labelled: DataFrame, ranks_path: str | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE, rounds: int = ROUNDS) -> Model:
    """Piece probabilities of each language. Rows with a null text or language are left out."""
    path = ranks_path or default_ranks()
    labelled = labelled.filter(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    counts = {r.lang: r.n for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(counts)
    if not languages:
        return Model([], np.zeros((0, 0)), path)
    share = F.create_map(*[F.lit(x) for k in languages for x in (k, per_language / counts[k])])
    spread = F.pmod(F.xxhash64("id"), F.lit(1 << 30)) / (1 << 30)
    chosen = labelled.filter(F.coalesce(spread, F.lit(0.0)) < share[F.col("lang")]).select("lang", "text")
    ddl = "lang string, word binary, n bigint"
    schema = arrow_schema(ddl)

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found: Counter = Counter()
            for lang, text in zip(b.column(0).to_pylist(), b.column(1)):
                found.update((lang, w) for w in text.as_py().encode().split())
            rows = [(lang, x, n) for (lang, w), n in found.items() if LETTER.search(w.decode(errors="replace")) for x in parts_of(w)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

    table = written(chosen.mapInArrow(words, ddl).groupBy("lang", "word").agg(F.sum("n").alias("n")), "words")
    size = vocabulary(path).none
    p = np.full((size, len(languages)), 1 / size)
    for _ in range(rounds):
        p = mixed_counts(expected_counts(table, languages, p, path))
    return Model(languages, p, path)


def expected_counts(table: DataFrame, languages: list[str], p: np.ndarray, path: str) -> np.ndarray:
    """One round's expected counts; what comes to the driver is at most a number for each piece and language."""
    ddl = "lang int, piece int, n double"
    schema, sent = arrow_schema(ddl), table.sparkSession.sparkContext.broadcast(p)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, p = vocabulary(path), padded(sent.value)
        sums = np.zeros((known.none, len(languages)))
        for b in batches:
            langs = np.array(b.column(0).to_pylist())
            for k, lang in enumerate(languages):
                own = np.flatnonzero(langs == lang)
                if len(own):
                    part = b.take(pa.array(own))
                    words, weight = part.column(1).to_pylist(), part.column(2).to_numpy().astype(float)
                    for some in fitted_together(np.array([len(w) for w in words])):
                        if len(some):
                            lattice = lattice_of_parts([words[i] for i in some], known)
                            sums[:, k] += lattice.expected(p[:, k], weight[some])[:-1]
        piece, lang = np.nonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip((lang, piece, sums[piece, lang]), schema.types)], schema=schema)

    out = np.zeros_like(p)
    for r in table.mapInArrow(count, ddl).groupBy("lang", "piece").agg(F.sum("n").alias("n")).collect():
        out[r.piece, r.lang] = r.n
    return out


def mixed_counts(counts: np.ndarray) -> np.ndarray:
    shared = counts.sum(1) + 0.1
    own = counts / np.maximum(counts.sum(0), 1e-300)
    return (1 - SHARED) * own + SHARED * (shared / shared.sum())[:, None]


def chunks(column: pa.Array) -> Iterator[list[str | None]]:
    """The column's texts, about CHUNK characters at a time."""
    own, size = [], 0
    for text in column:
        own.append(text.as_py())
        size += len(own[-1] or "")
        if size >= CHUNK:
            yield own
            own, size = [], 0
    if own:
        yield own


def predict(df: DataFrame, model: Model, text_col: str = "text", lang_out: str = "lang_pred", score_out: str = "score") -> DataFrame:
    """df with the predicted language and its posterior probability (all languages alike before) as two more columns; columns of these names are replaced."""
    keep = [c for c in df.columns if c.lower() not in (lang_out.lower(), score_out.lower())]
    df = df.select(*keep)
    at, sent = keep.index(text_col), df.sparkSession.sparkContext.broadcast(model)
    ddl = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema), f"`{lang_out}` string, `{score_out}` double"])
    schema = arrow_schema(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(sent.value)
        languages = sent.value.languages
        for b in batches:
            langs, scores = [], []
            for texts in chunks(b.column(at)):
                for text, x in zip(texts, scorer.texts(texts) if languages else texts):
                    if languages and text and LETTER.search(text):
                        best = int(x.argmax())
                        langs.append(languages[best])
                        scores.append(float(1 / np.exp(x - x[best]).sum()))
                    else:
                        langs.append(UNKNOWN)
                        scores.append(0.0)
            columns = [c.cast(t) for c, t in zip(b.columns, schema.types)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], schema=schema)

    return df.mapInArrow(run, ddl)


def held_out(id_col: str = "doc_id"):
    """Whether a row is kept from fitting: crc32 of its id as text leaves 2 when divided by 4. False for a null id."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", lang_out: str = "lang_pred", score_out: str = "score", **options) -> DataFrame:
    """docs with the predicted language and its score, fitted on its own rows that are labelled, have an id and aren't held out."""
    model = fit(docs.filter(~held_out(id_col) & F.col(id_col).isNotNull()), None, id_col, text_col, lang_col, **options)
    return predict(docs, model, text_col, lang_out, score_out)
