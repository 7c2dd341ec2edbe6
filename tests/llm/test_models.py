"""Language identification and page templates."""

import math
import functools
import random
from collections import defaultdict

import numpy as np

from quillon.llm import langid, pages

SCHEMA = "doc_id long, text string, lang string, score string"
WORDS = {"en": "the of and to in is that it was for on are with as this be by from or have".split(), "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein".split(), "fr": "de la le et les des en un du une que est pour qui dans par plus pas au sur".split()}


def docs(n=150):
    r = random.Random(1)
    return [(i, " ".join(r.choice(WORDS[lang]) + r.choice(["", "", ".", " 12"]) for _ in range(r.randrange(3, 40))), lang, None) for i in range(n) for lang in [r.choice(list(WORDS))]]


def test_forward_sums_every_segmentation():
    known = langid.vocabulary(langid.default_ranks())
    number = {p: i for i, p in enumerate(known.pieces)}
    r = np.random.default_rng(0)
    p = r.random((known.none, 2)) / 100

    @functools.cache
    def brute(word):
        if not word:
            return np.ones(2)
        return sum((p[number[word[:k]]] * brute(word[k:]) for k in range(1, len(word) + 1) if word[:k] in number), np.zeros(2))

    scorer = langid.Scorer(langid.Model(["a", "b"], p, langid.default_ranks()))
    assert max(map(len, known.pieces)) > 20
    words = [b"the", "élève".encode(), b"abcdefghijkl", b"x", b"internationale", max((x for x in known.pieces if x[:1] == b" " and x[1:].isalpha() and x.isascii()), key=len)[1:]]
    for word in words:
        assert np.allclose(scorer.texts([word.decode()])[0], np.log(brute(b" " + word)))
        assert np.allclose(scorer.long(b" " + word), np.log(brute(b" " + word)))
    text = "the élève\n x  12 the"
    assert np.allclose(scorer.texts(["", text, None, "x"])[1:], [sum(np.log(brute(b" " + w.encode())) for w in text.split() if w != "12"), [0, 0], np.log(brute(b" x"))])
    for n in (40, 62, 63, 64, 5000):  # long words, by either way
        word = ("abcde" * n)[:n].encode()
        assert np.allclose(langid.lattice_of([word, b"a"], known).log_probabilities(scorer.p)[0], scorer.long(b" " + word)) or n > 100
        assert np.isfinite(scorer.texts([word.decode()])).all()
    # expected counts: each piece's share of the segmentations
    for word in (b"the", b"internationale"):
        counts = langid.lattice_of([b"of", word], known).expected(langid.padded(p)[:, 0], np.array([0.0, 3.0]))
        by_piece = defaultdict(float)

        def walk(rest, pieces, product):
            if not rest:
                for x in pieces:
                    by_piece[x] += product
            for k in range(1, len(rest) + 1):
                if rest[:k] in number:
                    walk(rest[k:], [*pieces, number[rest[:k]]], product * p[number[rest[:k]], 0])

        walk(b" " + word, [], 1.0)
        for x, c in by_piece.items():
            assert np.isclose(counts[x], 3 * c / brute(b" " + word)[0])
        assert np.isclose(counts.sum(), 3 * sum(by_piece.values()) / brute(b" " + word)[0])


def test_identify(spark):
    odd = [(1000, None, "en", None), (1001, "12 34 ?!", "en", None), (1002, "", None, None), (1004, "½ ² 42", "en", None), (1005, "①②③ Ⅳ", None, None), (None, "und der die das", None, None), (1003, "the " * 50_000, None, None), (1003, "le la", None, None)]
    rows = docs()
    found = langid.identify(spark.createDataFrame(rows + odd, SCHEMA)).select("doc_id", "lang", "lang_pred", "score", langid.held_out().alias("held_out")).collect()
    assert len(found) == len(rows) + len(odd)
    held = [x for x in found if x.held_out and x.doc_id is not None and x.doc_id < 1000]
    assert len(held) > 20 and sum(x.lang == x.lang_pred for x in held) / len(held) > 0.95
    assert {x.lang_pred for x in found if x.doc_id in (1000, 1001, 1002, 1004, 1005)} == {"und"}
    assert [x.lang_pred for x in found if x.doc_id is None] == ["de"] and all(0 <= x.score <= 1 for x in found)


def test_no_labels_and_no_rows(spark):
    assert {x.lang_pred for x in langid.identify(spark.createDataFrame([(1, "abc", None, None)], SCHEMA)).collect()} == {"und"}
    assert langid.identify(spark.createDataFrame([], SCHEMA)).count() == 0


def test_prediction_does_not_see_labels(spark):
    rows = docs(60)
    a = langid.fit(spark.createDataFrame(rows, SCHEMA))
    one = langid.predict(spark.createDataFrame(rows, SCHEMA), a).collect()
    other = langid.predict(spark.createDataFrame([(i + 5, t, "zz", None) for i, t, _, _ in rows], SCHEMA), a).collect()
    assert [(x.lang_pred, round(x.score, 9)) for x in one] == [(x.lang_pred, round(x.score, 9)) for x in other]
    assert math.isclose(float(a.p.sum(0)[0]), 1)


def test_long_words_are_fitted(spark):
    r, letters = random.Random(4), {"p": "的一是不了人我在有他这中", "q": "のにはをたがでてとしれさ"}
    rows = [(i, "".join(r.choice(letters[k]) for _ in range(r.choice([30, 60, 90]))), k, None) for i in range(60) for k in [r.choice("pq")]]
    rows += [(100 + i, r.choice(["one two", "one three"]), "p", None) for i in range(5)]
    assert all(len(t.encode()) >= langid.SHORT for i, t, _, _ in rows if i < 100)
    model = langid.fit(spark.createDataFrame(rows, SCHEMA))
    scorer = langid.Scorer(model)
    x = scorer.texts(["".join(r.choice(letters[k]) for _ in range(8)) for k in "pq"])
    assert x[0, 0] > x[0, 1] + 5 and x[1, 1] > x[1, 0] + 5


def test_parts_of_long_words():
    known = langid.vocabulary(langid.default_ranks())
    size = np.array([len(x) for x in known.pieces])
    for word in ("的一是不" * 3000, "x" * 4095, "x" * 4096, "y" * 63, "né" * 9000):
        parts = langid.parts_of(word.encode())
        assert b"".join(parts) == b" " + word.encode() and all(len(x) <= langid.PART and x.decode() for x in parts)
    words = [b" " + w for w in (b"abc", "的一是不".encode() * 30, b"z" * 63, b"the" * 900)]
    seen = list(langid.fitted_together(np.array([len(w) for w in words])))
    assert sorted(np.concatenate(seen)) == [0, 1, 2, 3]
    p = np.full(known.none, 1 / known.none)
    for some in seen:  # each byte is in one piece of each segmentation
        counts = langid.lattice_of_parts([words[i] for i in some], known).expected(langid.padded(p[:, None])[:, 0], np.ones(len(some)))[:-1]
        assert np.isclose(counts @ size, sum(len(words[i]) for i in some))


PAGE = """<!DOCTYPE html><html><head><title>T {0}</title><style>p {{}}</style></head><body><header>Site</header><nav><ul><li><a href="/">Home {0}</a></ul></nav>
<!-- ad --><div class="ad">Buy {0}</div><div id="cookie-notice">We use cookies</div>{1}<aside>side</aside><form><input><label>Mail</label></form>
<section class="comments"><p>Reader {0}</p></section><footer>&copy; us</footer><script>if (a < b) "</p>";</script></body></html>"""


def make_pages():
    good = [(i, f"https://u@Host.example:80/{i}", PAGE.format(i, f"<article><h1>Head {i} &amp; more</h1><p>One <b>b</b>old\n  word<p>Two&nbsp;{i}<br>three<script>x</script></article>")) for i in range(6)]
    soup = [(10 + i, "http://soup.example/x", f"<html><body><div>Same menu</div><div>Body {i} text</div><div>Same end</div></body></html>") for i in range(5)]
    odd = [(20, None, None), (21, "nonsense", ""), (22, "http://one.example", "just <i>text</i> &lt;3"), (None, "http://one.example/2", "<p title='a > b'>x</p><p>y"), (23, "http://one.example", "<div " * 2000)]
    return good, soup, odd


def test_extract(spark):
    good, soup, odd = make_pages()
    table = spark.createDataFrame(good + soup + odd, "page_id long, url string, html string")
    for sent in (pages.SENT, 0):
        found = {x.page_id: x.text for x in pages.extract(table, sent=sent).collect()}
        for i in range(6):
            assert found[i] == f"Head {i} & more One bold word Two {i} three"
        for i in range(5):
            assert found[10 + i] == f"Body {i} text"
        assert found[20] == found[21] == "" and found[22] == "just text <3" and found[None] == "x y"
    assert pages.extract(table.limit(0)).count() == 0


def test_equal_vectors_make_classes(spark):
    good, _, _ = make_pages()
    found = pages.classes(spark.createDataFrame(good, "page_id long, url string, html string"), "page_id", "url", "html", 0.5).collect()
    once = [c for c in found if c.n_pages == c.total == c.all_pages]
    assert len(once) == 1 and {"/html/body<article", "/html/body</article"} <= {t.token for t in once[0].tokens}
    assert any(c.total == 2 * c.n_pages and {t.token for t in c.tokens} >= {"/html/body/article<p"} for c in found)


def plain_hosts():
    """Hosts whose pages name nothing: menus, side columns, notices and articles are all plain div elements."""
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randrange(2, 9)))
    words = lambda n: " ".join(word() for _ in range(n))
    rows, truth = [], {}
    for h in range(4):
        menu, notice, foot = [words(2) for _ in range(5)], words(12), words(6)
        for i in range(r.randrange(3, 9)):
            title, body = words(5), [words(r.randrange(20, 60)) for _ in range(r.randrange(1, 6))]
            side = "".join(f"<div>{words(3)}</div>" for _ in range(2))
            html = f"<html><body><div><div>{'</div><div>'.join(menu)}</div></div><table><tr><td>{side}</td></tr></table><section><h1>{title}</h1><div>{notice}</div>{''.join(f'<p>{p}</p>' for p in body)}</section><div>{foot}</div></body></html>"
            rows.append((len(rows), f"http://h{h}.example/{i}", html))
            truth[len(rows) - 1] = " ".join([title, *body])
    return rows, truth


def test_slots_of_plain_hosts(spark):
    """The template alone decides; without it all text would stay."""
    rows, truth = plain_hosts()
    table = spark.createDataFrame([(i, u, h, "x", 1) for i, u, h in rows * 2], "page_id long, URL string, html string, host string, token int")
    found = pages.extract(table.withColumnRenamed("URL", "url").repartition(5)).collect()
    assert len(found) == 2 * len(rows) and all(x.text == truth[x.page_id] for x in found)
    for i, _, html in rows:
        assert pages.main_text(html, pages.Template([], {})) != truth[i]


def brute_template(rows):
    """Page by page with the standard parser: the texts that half of a host's pages have, and the innermost path with most of the other text."""
    from collections import Counter
    from html.parser import HTMLParser

    class Reader(HTMLParser):
        def __init__(self, html):
            super().__init__()
            self.path, self.found = [], []
            self.feed(html)

        def handle_starttag(self, tag, attrs):
            self.path.append(tag)

        def handle_endtag(self, tag):
            self.path.pop()

        def handle_data(self, data):
            self.found.append(("/".join(["", *self.path]), data))

    by_host = {}
    for i, url, html in rows:
        by_host.setdefault(url.split("/")[2], []).append((i, Reader(html).found))
    out = {}
    for own in by_host.values():
        counts = Counter(x for _, found in own for x in set(found))
        common = {x for x, n in counts.items() if n >= max(2, len(own) / 2)}
        volume = Counter()
        for _, found in own:
            for path, text in found:
                if (path, text) not in common:
                    parts = path.split("/")
                    for k in range(1, len(parts)):
                        volume["/".join(parts[:k])] += len(text)
        best = max((p for p, n in volume.items() if n >= 0.8 * volume[""]), key=lambda p: p.count("/"))
        for i, found in own:
            out[i] = " ".join(t for p, t in found if (p + "/").startswith(best + "/") and (p, t) not in common)
    return out


def test_slots_by_brute_force(spark):
    rows, truth = plain_hosts()
    found = {x.page_id: x.text for x in pages.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert found == brute_template(rows) == truth


def test_deep_nesting_takes_linear_memory():
    import time
    import tracemalloc

    used = []
    for n in (2_000, 20_000):
        html = "<div>" * n + "deep" + "</div>" * n
        tracemalloc.start()
        began = time.time()
        assert pages.main_text(html, pages.Template([], {})) == "deep" and len(pages.occurrences(html)) >= 100
        used.append((tracemalloc.get_traced_memory()[1], time.time() - began))
        tracemalloc.stop()
    assert used[1][0] < 30 * used[0][0]
