"""Operators that compare texts with each other, against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest

from quillon.llm import decontaminate, jaccard, spans, suffixes

SCHEMA = "doc_id long, text string, sig string, row int, places string"
ODD = [(1, None, "x", 1, ""), (2, "", None, 2, ""), (None, "a b c d e", "x", 3, ""), (3, "same words here now again", "x", 4, ""), (3, "same words here now again", "x", 4, ""), (4, "word " * 40_000, "x", 5, "")]


def table(spark, texts):
    return spark.createDataFrame([t if isinstance(t, tuple) else (i, t, "x", 0, "y") for i, t in enumerate(texts)], SCHEMA)


def prose(r, n, vocabulary=2000):
    return " ".join(f"w{int(r.paretovariate(0.6)) % vocabulary}{r.choice(['', '', '', '.', ','])}" for _ in range(n))


def edited(r, text, n):
    words = text.split()
    for _ in range(n):
        words[r.randrange(len(words))] = f"x{r.randrange(10**6)}"
    return " ".join(words)


@pytest.fixture(scope="module")
def texts():
    r = random.Random(5)
    out = [prose(r, r.choice([3, 8, 30, 100, 300])) for _ in range(120)]
    for i in range(12):
        out += [edited(r, out[20 + i], r.randrange(0, 8)) for _ in range(r.choice([1, 3, 12]))]
    base = prose(r, 200)
    out += [edited(r, base, r.randrange(1, 9)) for _ in range(90)] + [base] * 5
    out += ["One  two", "one two ", "a", "", None, "one two three FOUR", "one\ntwo\tthree four"]
    r.shuffle(out)
    return out


def test_odd_tables(spark):
    for run in (jaccard.join, lambda d: decontaminate.find(d, spark.createDataFrame([(1, "a b c"), (None, "same words"), (2, None), (1, "a b c")], "item_id int, text string")), spans.remove, suffixes.remove):
        assert run(table(spark, ODD)).count() == len(ODD)
        assert run(table(spark, [])).count() == 0


def brute_classes(texts, n=4, percent=85):
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set())
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return [(i, len(s), find(i)) for i, s in enumerate(sets)]


@pytest.mark.parametrize("options", [{}, {"paired": 3, "hot": 20, "block": 2000, "bits": 10}, {"paired": 4, "hot": 1, "block": 3000}])
def test_jaccard(spark, texts, options):
    found = sorted(map(tuple, jaccard.join(table(spark, texts).repartition(7), **options).collect()))
    assert found == brute_classes(texts)


def test_long_texts_and_words():
    """Texts over a piece are hashed in pieces, and words over the polynomial's length by another hash, with equal sets."""
    text = " ".join(f"word{i % 5000} and{i}" for i in range(150_000)) + " tail"
    assert len(text) > 2 * jaccard.PIECE
    whole = jaccard.word_hashes(text.encode())
    assert (np.concatenate([jaccard.word_hashes(x) for x in jaccard.pieces(text.encode())]) == whole).all()
    thue = "".join("ab"[bin(i).count("1") % 2] for i in range(4096))
    other = thue.translate(str.maketrans("ab", "ba"))
    one, two = jaccard.word_hashes(f"x {thue} y {other}".encode())[[1, 3]]
    assert one != two and jaccard.ngram_set(f"{thue} {other}").size == 1


def test_parts_bound_the_difference(spark):
    r = np.random.default_rng(4)
    sets = [np.unique(r.integers(0, 2**63, n).astype(np.uint64)) for n in (1, 5, 40, 700, 9000)]
    sets += [np.unique(np.concatenate([s[: len(s) // 2], r.integers(0, 2**63, 9).astype(np.uint64)])) for s in sets]
    rows = [(i, j, jaccard.packed_parts(a), jaccard.packed_parts(b)) for i, a in enumerate(sets) for j, b in enumerate(sets)]
    found = spark.createDataFrame(rows, "i int, j int, one array<bigint>, two array<bigint>").select("i", "j", jaccard.parts_differ("one", "two").alias("d")).collect()
    exact = lambda s: np.bincount((s % np.uint64(16)).astype(int), minlength=16).clip(max=255)
    for i, j, d in found:
        assert d == np.abs(exact(sets[i]) - exact(sets[j])).sum() <= len(np.setxor1d(sets[i], sets[j]))


def test_components(spark):
    r = random.Random(2)
    edges = [(i, i + 1) for i in range(0, 30)] + [(100, x) for x in range(101, 150)] + [(r.randrange(200, 300), r.randrange(200, 300)) for _ in range(60)]
    edges = [(u, v) for u, v in edges if u != v]
    found = {x.node: x.root for x in jaccard.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    root = {n: n for e in edges for n in e}
    for _ in range(len(root)):
        for u, v in edges:
            root[u] = root[v] = min(root[u], root[v])
    assert found == root


def brute_hits(text, items, span=10):
    def words(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))

    own, hit, ids = words(text), set(), set()
    for key, item in items:
        w = words(item)
        for s in range(max(1, len(w) - span + 1) if w else 0):
            window = w[s : s + span]
            for at in range(len(own) - len(window) + 1):
                if own[at : at + len(window)] == window:
                    hit.update(range(at, at + len(window)))
                    ids.add(str(key))
    return len(own), sorted(hit), sorted(ids)


@pytest.mark.parametrize("block", [decontaminate.BLOCK, 600])
def test_decontamination(spark, block):
    r = random.Random(3)
    items = [(i, prose(r, r.choice([2, 9, 10, 25, 40]), 60)) for i in range(20)] + [(99, "É été déjà"), (7, None), (8, "?!")]
    docs = [prose(r, r.choice([5, 50, 200]), 60) for _ in range(60)]
    docs += [f"{prose(r, 20)} {' '.join(w[r.randrange(3) :])} {prose(r, 9)}".upper() for _, t in items if t for w in [t.split()]]
    docs += ["x été-déjà É été;déjà", items[3][1] * 2]
    found = decontaminate.find(table(spark, docs), spark.createDataFrame(items, "item_id int, text string"), block=block).collect()
    assert sorted((x.doc_id, (x.n_words, list(x.places), list(x["items"]))) for x in found) == [(i, brute_hits(t, items)) for i, t in enumerate(docs)]
    row = decontaminate.digests(decontaminate.find(table(spark, ["a b c d"]), spark.createDataFrame([(5, "b c")], "item_id int, text string"))).first()
    assert tuple(row) == (0, 4, 2, 1, hashlib.sha256(b"5").hexdigest(), True)


def test_proximity(spark):
    items = spark.createDataFrame([(1, "alpha beta gamma delta epsilon zeta eta theta iota kappa")], "item_id int, text string")
    docs = table(spark, ["alpha beta gamma delta so epsilon zeta eta theta iota kappa", "kappa alpha"])
    assert [len(x.places) for x in decontaminate.find(docs, items).orderBy("doc_id").collect()] == [0, 0]
    assert [len(x.places) for x in decontaminate.find(docs, items, slop=1).orderBy("doc_id").collect()] == [10, 0]


def brute_removed(texts, length):
    data = [(t or "").encode() for t in texts]
    counts = {}
    for d in data:
        for i in range(len(d) - length + 1):
            counts[d[i : i + length]] = counts.get(d[i : i + length], 0) + 1
    out = []
    for d in data:
        gone = np.zeros(len(d), bool)
        for i in range(len(d) - length + 1):
            if counts[d[i : i + length]] > 1:
                gone[i : i + length] = True
        kept = bytes(b for b, g in zip(d, gone) if not g)
        out.append((len(d), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("options", [{}, {"limit": 3}, {"length": 40, "gram": 12, "at_once": 5}])
def test_suffixes(spark, options):
    r = random.Random(9)
    shared = [prose(r, 60, 500) for _ in range(6)]
    docs = []
    for _ in range(90):
        parts = [prose(r, r.randrange(1, 60), 500)]
        for _ in range(r.choice([0, 0, 1, 2])):
            s = r.choice(shared)
            a = r.randrange(len(s) // 2)
            parts += [s[a : a + r.randrange(100, 400)], prose(r, 7, 500)]
        docs.append(r.choice(["", "é", " "]).join(parts))
    docs += ["ab" * 400, "x" * 1000, "x" * 199, "x" * 200, docs[3], docs[3], docs[4] + docs[4], None, ""]
    found = suffixes.digests(suffixes.remove(table(spark, docs).repartition(3), **options)).orderBy("doc_id").collect()
    assert [tuple(x)[1:] for x in found] == brute_removed(docs, options.get("length", 200))


def test_suffix_order():
    r = np.random.default_rng(1)
    n, length = 301, 24
    size, group = r.integers(0, length + 1, n), r.integers(0, 5, n)
    right = r.integers(97, 99, (n, length)).astype(np.uint8) * (np.arange(length) < size[:, None])
    p = np.zeros((n, length + 1), np.uint64)
    p[:, 1:] = np.cumsum(suffixes.LETTERS[right] * suffixes.powers(suffixes.BASE, length)[:length], axis=1, dtype=np.uint64)
    order = suffixes.suffix_order(right, size, group, p)
    keys = [(group[i], bytes(right[i, : size[i]])) for i in range(n)]
    assert [keys[i] for i in order] == sorted(keys) and sorted(order) == list(range(n))


def test_spans(spark):
    a, b = "One thing here. Two things there! Three of them? ", "First of all.\nThen more.  And then.\n\nLast"
    docs = ["Start. " + a + "End.", b, a.upper() + "More.", "x. y. z.", None, "", b, "Four. " + b]
    found = {x.doc_id: (x.text, x.n_sentences, x.n_removed) for x in spans.remove(table(spark, docs), least=1).collect()}
    assert found[0] == (docs[0], 5, 0) and found[1] == (b, 4, 0) and found[2] == ("More.", 4, 3) and found[3][2] == 0
    assert found[4] == ("", 0, 0) and found[6] == ("", 4, 4) and found[7] == ("Four. ", 5, 4)
    assert all(x.n_removed == 0 for x in spans.remove(table(spark, docs)).collect())  # too few words


def brute_spans(texts, width=spans.WIDTH, least=spans.LEAST):
    """Word by word: (kept text, sentences, removed sentences) of each text, in the order of their ids."""
    seen, out = set(), []
    for text in texts:
        found = list(re.finditer(r"[^ \t\n\r\f\v]+", text or ""))
        own = [re.sub("[A-Z]", lambda m: m[0].lower(), m[0]) for m in found]
        bounds = [m.start() for m in found[1:]] + [len(text or "")]
        stop = [w[-1] in ".!?" or "\n" in text[m.end() : b] or b == len(text) for w, m, b in zip(own, found, bounds)]
        places = [-1] + [i for i, s in enumerate(stop) if s]
        ends = []
        for i, w in enumerate(own):
            chosen = hashlib.md5(w.encode()).hexdigest()[0] in "0123"
            if stop[i] or chosen and all(abs(i - p) >= 8 for p in places):
                ends.append(i + 1)
        cuts, gone = [0, *ends], set()
        for s in range(len(ends)):
            for e in range(s + width, len(cuts)):
                if cuts[e] - cuts[s] >= least:
                    form = tuple(own[cuts[s] : cuts[e]])
                    if form in seen:
                        gone |= set(range(s, e))
                    seen.add(form)
                    break
        edges = [0, *(bounds[e - 1] for e in ends)]
        kept = "".join(text[edges[k] : edges[k + 1]] for k in range(len(ends)) if k not in gone) if ends else text or ""
        out.append((kept, len(ends), len(gone)))
    return out


def test_spans_by_brute_force(spark, texts):
    r = random.Random(12)
    flat = [" ".join(f"w{r.randrange(3000)}" for _ in range(r.randrange(52, 140))) for _ in range(12)]  # passages without a stop
    docs = texts + [f"{prose(r, r.randrange(40))} {r.choice(flat)} {prose(r, r.randrange(40))}" for _ in range(60)]
    docs += ["  \n lead. in  " + flat[0], "e\u0301t\u00e9 \u00a0nbsp\u2003wide " * 30, "e\u0301t\u00e9 \u00a0nbsp\u2003wide " * 30, "x" * 300_000 + " y " * 500, " \n ", "\u0130 " * 60]
    found = sorted(spans.remove(table(spark, docs).repartition(5)).collect())
    assert [(x.text, x.n_sentences, x.n_removed) for x in found] == brute_spans(docs)


def test_spans_of_planted_passages(spark):
    """Passages of over 50 words are found whether or not they have stops, and wherever they stand in a sentence."""
    r = random.Random(8)
    word = lambda: f"v{r.randrange(10**6)}"
    docs = []
    for k in range(200):
        passage = " ".join(word() + r.choice(["", "", "", "", ".", ","] if k % 2 else [""]) for _ in range(r.randrange(51, 80)))
        docs += [" ".join(word() for _ in range(r.randrange(30))) + f" {passage} " + " ".join(word() for _ in range(r.randrange(30))) for _ in range(2)]
    found = {x.doc_id: x.n_removed for x in spans.remove(table(spark, docs)).collect()}
    assert sum(found[i] > 0 for i in range(1, 400, 2)) >= 190 and not any(found[i] for i in range(0, 400, 2))


def test_spans_leave_other_columns(spark):
    docs = spark.createDataFrame([(1, "a b", "x", 1, "y"), (2, None, "x", 1, "y")], "Doc_ID int, TEXT string, text2 string, row int, places string")
    assert sorted(spans.remove(docs, "Doc_ID", "TEXT").collect()) == [(1, "a b", 1, 0), (2, "", 0, 0)]
