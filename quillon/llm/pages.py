"""Main text of web pages by templates deduced from equivalence classes of tokens.

* A page is its tokens: tags, each with the open elements around it, and blocks of text. The occurrence vector of a
  token says how often each page of a host has it. Tokens with the same vector are an equivalence class; Spark groups
  them by a sum of hashes of (page, count), so no host's pages have to meet anywhere.
* A class is kept when at least SUPPORT of the host's pages have it, and two pages do; so a host has at most 1 / SUPPORT
  times as many such tokens as a page has on the mean. Its tags are put in the order of their mean places. The class
  that every page has exactly once is the template's frame; a class whose tags all stand inside one gap of another
  class is nested there, and one that doesn't fit anywhere is not valid.
* The template leaves slots, and its host's pages say what they hold: how much text stands under each path of open
  elements, less what is itself a token of a valid class. The main slots are those inside an article or main element of
  the frame. A frame without one has its main slots in the container: the innermost path with CONTAINED of that text inside;
  there, text that is a token of a valid class is template and goes, too.
* Inside main slots, elements that hold menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles or
  reader comments go, by the element's name or the words of its class, id and role.

A page whose host has no second page, or that does not follow its host's template, is cut by its own elements alone.
Null html is empty; pages with a null url share one nameless host. Text is decoded, with white space made one space.
Repeated rows are pages of their own, for the template too; there are no other ties. An empty
table gives an empty one, and columns beside the three named ones are left out. A token's path is at most PATH
characters long, else its beginning and a hash, so that a deeply nested page takes memory in proportion to its length.
"""

from __future__ import annotations

import html as entities
import re
from bisect import bisect_left
from collections import Counter
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows, written

SUPPORT = 0.5
#: Share of a host's text that its container has; characters of a path that are spelled out.
CONTAINED, PATH = 0.8, 160
#: Template tokens of all hosts up to which they are sent to every task; more are joined by host.
SENT = 200_000

TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<(?P<raw>script|style|noscript|template|textarea|iframe|svg|math|head)\b(?:[^>"']|"[^"]*"|'[^']*')*+>(?:.*?</(?P=raw)\s*>|.*\Z)"""
    r"""|<(?P<end>/?)(?P<name>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attributes>(?:[^>"']|"[^"]*"|'[^']*')*+)>|</?[a-zA-Z][^>]*>|<[!?/][^>]*>|(?P<text>[^<]+|<)""",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)

# Element names by what they do.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd mark q s samp small span strong sub sup time tt u var wbr".split())
#: Elements that end an open paragraph (or list item) before them.
ENDS_P = frozenset("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
NOT_MAIN = frozenset("nav header footer aside form button select dialog menu figure figcaption label input object".split()) - {"figure", "figcaption"}
MAIN = frozenset(("article", "main"))
#: Words of a class, id or role that mark an element as not part of the article.
NOT_MAIN_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer header masthead menu modal nav navbar navigation newsletter "
    "notice notices overlay pagination popup promo promoted promotion related respond replies reply share sharing sidebar social sponsor sponsored subscribe toolbar widget complementary contentinfo search alert".split()
)
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


def is_chrome(name: str, attributes: str) -> bool:
    if name in NOT_MAIN:
        return True
    for m in ATTRIBUTE.finditer(attributes):
        if any(w.lower() in NOT_MAIN_WORDS for w in WORD.findall(m[2] or m[3] or m[4] or "")):
            return True
    return False


def deeper(path: str, name: str) -> str:
    """The path of an element inside another's; too long a path keeps its beginning and a hash."""
    import xxhash

    path = f"{path}/{name}"
    return path if len(path) <= PATH else f"{path[: PATH // 2]}~{xxhash.xxh3_64_hexdigest(path.encode())}"


def tokens(html: str | None):
    """('open'|'close', element, path, chrome, in main) and ('text', text, path, chrome, in main) in page order; path: the open block elements."""
    html = html or ""
    stack: list[tuple[str, bool, bool]] = []  # name, whether it or one around it is chrome, is main
    path: list[str] = [""]
    whole = html.rfind(">") + 1
    opened: Counter = Counter()  # open elements by name, so that one that isn't open is not looked for

    def close(name):
        while opened[name]:
            top = stack.pop()[0]
            path.pop()
            opened[top] -= 1
            if top == name:
                return

    for m in TOKEN.finditer(html, 0, whole):
        text, name = m["text"], m["name"]
        chrome, main = (stack[-1][1], stack[-1][2]) if stack else (False, False)
        if text:
            yield "text", text, path[-1], chrome, main
        elif name:
            name = name.lower()
            if name in INLINE:
                continue
            if m["end"]:
                close(name)
                yield "close", name, path[-1], chrome, main
            else:
                if name in ENDS_P:
                    close("p")
                if name == "li" and opened["li"] and stack[-1][0] not in ("ul", "ol"):
                    close("li")
                chrome, main = (stack[-1][1], stack[-1][2]) if stack else (False, False)
                yield "open", name, path[-1], chrome, main
                if name not in VOID and not m["attributes"].endswith("/"):
                    chrome = chrome or is_chrome(name, m["attributes"])
                    stack.append((name, chrome, main or name in MAIN and not chrome))
                    path.append(deeper(path[-1], name))
                    opened[name] += 1
        elif m["raw"]:
            yield "open", m["raw"].lower(), path[-1], chrome, main
    if whole < len(html) and not html[whole:].lstrip().startswith("<"):
        yield "text", html[whole:], path[-1], *((stack[-1][1], stack[-1][2]) if stack else (False, False))


def blocks(html: str | None):
    """(what stands before it, text, path, chrome, in main) of each block of text; what stands before: tags as tokens."""
    before, parts, at = [], [], None
    for kind, value, path, chrome, main in tokens(html):
        if kind == "text":
            at = at or (path, chrome, main)
            parts.append(value)
            continue
        text = " ".join(entities.unescape("".join(parts)).split())
        if text:
            yield before, text, *at
            before = []
        parts, at = [], None
        before.append(f"{path}{'</' if kind == 'close' else '<'}{value}")
    text = " ".join(entities.unescape("".join(parts)).split())
    yield before, text, *(at or ("", False, False))


def text_token(path: str, text: str) -> str:
    import xxhash

    return f"{path}#{len(text)}:{xxhash.xxh3_64_hexdigest(text.encode())}"


def occurrences(html: str | None) -> list[tuple[str, int, int]]:
    """(token, count, first place) of a page; a token @path counts the characters of its texts that no element marks as chrome."""
    counts: Counter = Counter()
    place: dict[str, int] = {}
    volume: Counter = Counter()
    for before, text, path, chrome, _ in blocks(html):
        for t in [*before, text_token(path, text)] if text else before:
            counts[t] += 1
            place.setdefault(t, len(place))
        if text and not chrome:
            volume[f"@{path}"] += len(text)
    return [(t, n, place[t]) for t, n in counts.items()] + [(t, n, 0) for t, n in volume.items()]


def host_of(url_col: str):
    """The host of a url, in lower case; empty for none."""
    return F.lower(F.coalesce(F.regexp_extract(F.col(url_col), r"(?i)^[a-z][a-z0-9+.-]*://(?:[^/?#]*@)?([^/?#:]*)", 1), F.lit("")))


def classes(pages: DataFrame, id_col: str, url_col: str, html_col: str, support: float) -> DataFrame:
    """(host, vector, n_pages, total, all_pages, tokens array<struct<place, token>>) of the equivalence classes with enough pages."""

    def make():
        def row(host, page, html):
            for t, n, place in occurrences(html):
                yield host, t, n, place, page

        return row

    pages = pages.select(host_of(url_col).alias("host"), F.xxhash64(id_col, html_col).alias("page"), F.col(html_col).alias("html"))
    every = pages.groupBy("host").agg(F.count("*").alias("all_pages")).filter("all_pages > 1")
    rows = map_rows(pages, pages.columns, "host string, token string, n int, place int, page bigint", make)
    h, low = F.xxhash64("page", "n"), F.lit(0xFFFFFFFF)
    vector = [F.sum(h.bitwiseAND(low)).alias("v1"), F.sum(F.shiftrightunsigned(h, 32)).alias("v2")]
    tokens = rows.groupBy("host", "token").agg(*vector, F.count("*").alias("n_pages"), F.sum("n").alias("total"), F.avg("place").alias("place")).filter("n_pages > 1")
    tokens = tokens.join(every, "host").filter(F.col("n_pages") >= support * F.col("all_pages"))
    listed = F.array_sort(F.collect_list(F.struct("place", "token")))
    return tokens.groupBy("host", "v1", "v2", "n_pages", "total", "all_pages").agg(listed.alias("tokens"))


@dataclass
class Template:
    """frame: the frame's tags in order; nested: the gap of the frame that each valid nested class's tokens stand in; container: where the main slots of a frame without an article are."""

    frame: list[str]
    nested: dict[str, int]
    container: str = ""

    @property
    def has_main(self) -> bool:
        return any(t.rpartition("<")[2] in MAIN for t in self.frame if "<" in t)


def template(classes: list) -> Template:
    frame: list[tuple[float, str]] = []
    volume = Counter({t["token"][1:]: c["total"] for c in classes for t in c["tokens"] if t["token"].startswith("@")})
    classes = [(c, own) for c in classes if (own := [t for t in c["tokens"] if not t["token"].startswith("@")])]
    for c, own in classes:
        if c["n_pages"] == c["total"] == c["all_pages"]:
            frame += [(t["place"], t["token"]) for t in own]
    frame.sort()
    nested: dict[str, int] = {}
    places = [p for p, _ in frame]
    for c, own in classes:
        if not (c["n_pages"] == c["total"] == c["all_pages"]):
            gaps = {bisect_left(places, t["place"]) for t in own}
            if len(gaps) == 1:
                nested |= dict.fromkeys((t["token"] for t in own), gaps.pop())
        for t in own:  # text of the template is no slot's
            path, mark, text = t["token"].rpartition("#")
            if mark and "<" not in text and (t["token"] in nested or c["n_pages"] == c["total"] == c["all_pages"]):
                volume[path] -= int(text.partition(":")[0]) * c["total"]
    return Template([t for _, t in frame], nested, container(volume))


def container(volume: Counter) -> str:
    """The innermost path that has CONTAINED of the text in elements inside it."""
    under: Counter = Counter()
    for path, n in volume.items():
        if n > 0:
            parts = path.split("/")
            for k in range(1, max(len(parts), 2)):
                under["/".join(parts[:k])] += n
    enough = [p for p, n in under.items() if n >= CONTAINED * under[""] > 0]
    return max(enough, key=lambda p: (p.count("/"), under[p]), default="")


def main_text(html: str | None, host: Template) -> str:
    own = list(blocks(html))
    marks = set(host.frame)
    # the page follows its host's frame if its frame tokens come in the frame's order, each once
    met = [t for before, text, path, _, _ in own for t in ([*before, text_token(path, text)] if text else before) if t in marks]
    follows = bool(host.frame) and met == host.frame
    by_label = any(x[4] for x in own) and (not follows or host.has_main)
    out = []
    for _, text, path, chrome, main in own:
        if not text or chrome or by_label and not main:
            continue
        if follows and not by_label:
            if host.container and not f"{path}/".startswith(f"{host.container}/") or (token := text_token(path, text)) in marks or token in host.nested:
                continue
        out.append(text)
    return " ".join(out)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", support: float = SUPPORT, sent: int = SENT) -> DataFrame:
    """(id, url, text) of each page."""
    found = written(classes(pages, id_col, url_col, html_col, support), "templates")
    of = found.groupBy("host").agg(F.collect_list(F.struct("n_pages", "total", "all_pages", "tokens")).alias("classes"))
    # the templates' size is checked: a few for each host, so they are sent only while they are few
    small = (found.agg(F.sum(F.size("tokens"))).first()[0] or 0) <= sent
    own = pages.select(F.col(id_col), F.col(url_col), F.col(html_col), host_of(url_col).alias("own_host"))
    joined = own.join(F.broadcast(of) if small else of, F.col("own_host") == F.col("host"), "left")
    kind = pages.schema[id_col].dataType.simpleString()

    def make():
        known: dict[str, Template] = {}

        def row(page, url, html, own, classes):
            if own not in known:
                if len(known) > 1000:
                    known.clear()
                known[own] = template(classes or [])
            yield page, url, main_text(html, known[own])

        return row

    return map_rows(joined, [id_col, url_col, html_col, "own_host", "classes"], f"`{id_col}` {kind}, `{url_col}` string, text string", make)


def digests(found: DataFrame) -> DataFrame:
    return found.withColumn("n_chars", F.length("text").cast("long"))
