"""Texts cut for fill-in-the-middle, against a plain version."""

import hashlib
import random
import re

import numpy as np
import pytest

from quillon.llm import infill

SCHEMA = "doc_id long, text string, n string, form int"


def brute(doc_id, text):
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text, re.S)
    n = len(units)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return doc_id, n, "plain", None, None, text
    first, middle, last = ("".join(u) for u in (units[:a], units[a:b], units[b:]))
    if h[3] % 100 < 20:
        return doc_id, n, "spm", len(first), len(middle), f"<S>{last}<P>{first}<M>{middle}"
    return doc_id, n, "psm", len(first), len(middle), f"<P>{first}<S>{last}<M>{middle}"


def test_equals_the_plain_version(spark):
    r = random.Random(3)
    kinds = ["ab", "Z", " ", "\n", "é", "日", "🙂", "<", "S>", "<S", ">", "1", ".", "\r\n"]
    rows = [(i, "".join(r.choice(kinds) for _ in range(r.choice([0, 1, 2, 9, 80]))), None, 0) for i in range(400)]
    rows += [(None, None, "x", 1), (None, "a b", "x", 1), (7, "same", "x", 1), (7, "same", "x", 1), (901, "has <P> in it", "x", 1), (902, "word " * 70_000 + "-" * 70_000 + "x1" * 90_000, "x", 1)]
    made = infill.transform(spark.createDataFrame(rows, SCHEMA)).collect()
    key = lambda x: (x[0] is None, x[0] or 0, x[5])
    want = sorted((brute(i, t) for i, t, *_ in rows), key=key)
    assert sorted(map(tuple, made), key=key) == want
    assert {x[2] for x in want} == {"plain", "psm", "spm"}
    digests = infill.digests(infill.transform(spark.createDataFrame(rows, SCHEMA))).collect()
    sha = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    assert sorted(d.restored_sha256 for d in digests) == sorted(sha(t) for _, t, *_ in rows)
    assert sorted(d.output_sha256 for d in digests) == sorted(sha(w[5]) for w in want)
    assert infill.transform(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("kind", ["ArrayContainer", "BitmapContainer", "RunContainer"])
def test_containers(kind):
    r = np.random.default_rng(4)
    parts = {
        "ArrayContainer": r.choice(1 << 16, 900, replace=False),
        "BitmapContainer": r.choice(1 << 16, 30_000, replace=False),
        "RunContainer": np.concatenate([np.arange(a, a + 700) for a in (5, 2_000, 40_000)]),
    }
    own = np.sort(np.concatenate([parts[kind] + (k << 16) for k in (0, 2, 3)]))
    found = infill.Boundaries(own)
    assert {type(c).__name__ for c in found.containers} == {kind} and len(found.containers) == 3
    assert len(found) == len(own)
    assert [found.select(i) for i in range(0, len(own), 7)] == own[::7].tolist()
    assert found.select(len(own) - 1) == own[-1]
