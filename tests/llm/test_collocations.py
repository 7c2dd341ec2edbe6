"""Collocations against a plain count of all phrases."""

import random
import re
from collections import Counter

import pytest

from quillon.llm import collocations

SCHEMA = "lang string, text string, word string, n int"


def brute(rows, least, longest=4, top=2000):
    f, total = Counter(), Counter()
    for lang, text in rows:
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang or "und"] += len(w)
            for i in range(len(w)):
                for m in range(1, min(longest, len(w) - i) + 1):
                    f[lang or "und", tuple(w[i : i + m])] += 1
    found = []
    for (lang, w), a in f.items():
        if len(w) < 2 or a < least:
            continue
        cuts = [(2_000_000 * a // (f[lang, w[:k]] + f[lang, w[k:]]), k) for k in range(1, len(w))]
        score, k = min(cuts)
        found.append((lang, w, a, f[lang, w[:k]], f[lang, w[k:]], score))
    covers = Counter()
    for lang, w, a, *_ in found:
        for m in range(2, len(w)):
            for i in range(len(w) - m + 1):
                covers[lang, w[i : i + m]] = max(covers[lang, w[i : i + m]], a)
    out = set()
    for lang in {x[0] for x in found}:
        own = [(-s, -a, " ".join(w).encode(), l, r) for g, w, a, l, r, s in found if g == lang and 100 * covers[lang, w] < 80 * a]
        out |= {(lang, i + 1, p.decode(), -a, l, r, total[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(own)[:top])}
    return out


@pytest.fixture(scope="module")
def rows():
    r = random.Random(9)
    word = lambda: r.choice(["the", "The", "of", "New", "york", "é", "日本", "a-b", "x'y", f"w{int(r.paretovariate(0.7)) % 300}"])
    stop = lambda: r.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", " ; ", "\x0b", "!?"])
    out = []
    for i in range(300):
        out.append((r.choice(["en", "en", "fr", None]), "".join(word() + stop() for _ in range(r.choice([0, 1, 5, 60])))))
    out += [("en", "new york city hall " * 40), ("en", "new york city hall " * 40), ("de", "na " * 60), (None, None), ("fr", ""), ("fr", " \t.\n"), ("en", "tick tock " * 3000)]
    return out


def table(spark, rows):
    return spark.createDataFrame([(lang, text, "x", 0) for lang, text in rows], SCHEMA)


def as_set(found):
    return {tuple(r) for r in found.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()}


@pytest.mark.parametrize("options", [{}, {"classes": 8, "budget": 40}, {"word_bits_": 15, "bits": 4}])
def test_equals_the_plain_count(spark, rows, options):
    want = brute(rows, 5)
    assert len(want) > 50
    assert as_set(collocations.mine(table(spark, rows), least=5, **options)) == want


def test_small_stretches_and_sends(spark, rows, monkeypatch):
    monkeypatch.setattr(collocations, "STRETCH", 50)
    monkeypatch.setattr(collocations, "KEPT", 64)
    batch = table(spark, rows).select("lang", "text").coalesce(1).na.fill("und", ["lang"]).toArrow().to_batches()
    words = Counter()
    for found, names in collocations.word_batches(iter(batch), 4):
        for i in range(len(found)):
            if found.own[i]:
                words[names[found.lang[i]], found.strings([i])[0].as_py()] += 1
    want = Counter((lang or "und", w.lower()) for lang, text in rows for w in re.findall(r"[^\x20\x09.,;:!?\x0A-\x0D]+", text or ""))
    assert words == want


def test_groups_keep_to_the_budget(spark, rows):
    docs = table(spark, [("en", f"{a} {b} {c} {d}") for a in "ab" for b in "abcd" for c in "abcd" for d in "abcd"])
    found = docs.selectExpr("lang", "text as phrase", "1L as n")
    own = collocations.grouped(found, 4, classes=64, budget=10).collect()
    sizes = Counter(r.group for r in own)
    assert max(sizes.values()) <= 10 and {r.level for r in own} <= {2, 3}
    assert len({(r.phrase, r.group) for r in own}) == len(own) == 128


def test_exact_beyond_64_bits(spark):
    from pyspark.sql import functions as F

    a, l, r = 9_000_000_000_000_000, 9_100_000_000_000_000, 9_000_000_000_000_001  # noqa: E741
    found = spark.createDataFrame([(a, l, r)], "a long, l long, r long").select(collocations.score("a", "l", "r").alias("s"), F.lit(0)).first().s
    assert found == 2_000_000 * a // (l + r)


def test_odd_tables(spark):
    assert collocations.mine(table(spark, [])).count() == 0
    assert collocations.mine(table(spark, [(None, None), ("en", "one two")])).count() == 0
