"""Operators whose result for a row depends on that row, or the next one, alone."""

import hashlib
import random
import re
import textwrap
import time
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.llm import bpe, fingerprints, licenses, secrets
from quillon.llm.license_texts import KNOWN

SCHEMA = "doc_id long, text string, ids string, row int"
ODD = [(1, None, "x", 1), (2, "", None, 2), (None, "a b", "x", 3), (3, "same", "x", 4), (3, "same", "x", 4), (4, "word " * 40_000, "x", 5)]


def table(spark, rows=ODD):
    return spark.createDataFrame(rows, SCHEMA)


def test_odd_tables(spark):
    for run in (lambda d: bpe.digests(bpe.encode(d)), lambda d: secrets.digests(secrets.find(d)), licenses.scan, fingerprints.edited, fingerprints.fingerprint):
        assert run(table(spark)).count() == len(ODD)
        assert run(table(spark, [])).count() == 0


def test_bpe_round_trip(spark):
    texts = ["It's 12 o'clock\n\n  déjà vu 日本語 🙂", None, "", " " * 3000 + "x", "a" * 70_000 + "1" * 70_000]
    rows = {r.doc_id: r for r in bpe.encode(table(spark, [(i, t, None, 0) for i, t in enumerate(texts)])).collect()}
    codec = bpe.codec(bpe.default_ranks())
    for i, t in enumerate(texts):
        assert list(rows[i].ids) == codec.tokens.encode_ordinary(t or "")
        assert bytes(rows[i].decoded) == (t or "").encode()


@pytest.mark.parametrize("text", ["don't stop 'll x's 12ab\n \n" * 40, "  \n\t a,b;;c" * 60, "é" * 300 + "1" * 300, "\x1c x\x85y　z   q" * 50])
def test_cuts_are_safe(text):
    codec = bpe.Codec(bpe.default_ranks(), chunk=7)
    assert codec.encode(text).tolist() == codec.tokens.encode_ordinary(text)


def test_pieces_of_uncuttable_text():
    codec = bpe.Codec(bpe.default_ranks(), chunk=50)
    for text in (" " * 999 + "a", "\n " * 500 + " b", "\t" * 700):
        assert codec.encode(text).tolist() == codec.tokens.encode_ordinary(text)


def brute_secrets(text):
    found = [(m.start(), 0, m.end()) for m in re.finditer(secrets.ASSIGN, text, re.I | re.A) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer(secrets.ACCESS, text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer(secrets.HEX, text) if len(m[0]) >= 24]
    return sorted(found)


def test_secrets(spark):
    random, digest = "x9Kq2LmZ7vRt4WbY8nPc3DfG", "d41d8cd98f00b204e9800998ecf8427e"
    texts = [
        'API_KEY = "abcdef12" and Token:short tOKEN=123456', "token:token:abcdef", f"AKIA{'Z9' * 8} AKIA12", digest, f"see {random}, not",
        "ſecret=abcdefgh", "internationalization_of_words AVeryLongCamelCaseIdentifierName", "123e4567-e89b-12d3-a456-426614174000", f"é{digest.upper()}", "QwXzRtPlKjHgVbNmCxZqWp",
    ]
    rows = {r.doc_id: r.found for r in secrets.find(table(spark, [(i, t, None, 0) for i, t in enumerate(texts)])).collect()}
    for i, t in enumerate(texts):
        assert [(x.start, secrets.KINDS.index(x.kind), x.end) for x in rows[i] if x.kind != "random"] == brute_secrets(t)
    assert [(x.kind, x.start, x.end) for x in rows[4]] == [("random", 4, 4 + len(random))]
    assert not any(rows[i] for i in (5, 6, 7, 8)) and [x.kind for x in rows[9]] == ["random"]
    row = secrets.digests(secrets.find(table(spark, [(0, texts[0], None, 0)]))).first()
    assert row.n_assign == 2 and row.base_sha256 == hashlib.sha256(row.spans.encode()).hexdigest() and row.spans.startswith("assign:0:")


def test_random_letters():
    scanner = secrets.Scanner(secrets.default_ranks())
    letters = "qzxkvjwpmnbtrdlfghscyewq"
    for s in (letters, letters.upper(), letters.capitalize(), f"{letters}_12", "qzxkvj_wpmnbt_rdlfgh_scyewq", "QZXKV-JWPMN-BTRDL-FGHSC", "qzxkvjWpmnbtRdlfghScyewq", "qzx-kvj-wpm-nbt-rdl-fgh", "QZX_KVJ_WPM_NBT_RDL_FGH", "kAbcXyzQwrTbcDfgHjk_12"):
        assert scanner.scan(f"see {s} here") == [(4, 3, 4 + len(s))], s
    for s in ("MAX_HTTP_URL_LEN_IN_DB_V2", "internationalization_of_words", "SOME_LONG_CONSTANT_NAME_HERE", "COUNTERREVOLUTIONARIES", "getValueOfFirstItemInList", "src_idx_ptr_buf_cnt_len_max", "get_id_of_the_user_by_key", "MAX_BUF_LEN_FOR_TCP_IP_ACK", "1234567890123456789012", "_" * 30):
        assert not scanner.scan(f"see {s} here"), s
    for n in (60, 50_000):  # neither ended before
        scanner.scan("a" * n + "12345")


def test_long_runs_take_linear_time(spark):
    """Runs of 100,000 characters of every kind, alone and in the pipeline's redaction."""
    r = random.Random(1)
    n = 100_000
    runs = ["q" * n, "A" * n, "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n)), "1234567890" * (n // 10), "".join(r.choice("abcXYZ0189+/_-=") for _ in range(n)), "fooBar" * (n // 6) + "12345!"]
    runs += ["foo_bar_" * (n // 8) + "12345", "deadbeef" * (n // 8), "AKIA" * (n // 4), "token=" * (n // 6), "_-" * (n // 2), "aA" * (n // 2), "api_key" * (n // 7)]
    began = time.time()
    scanner = secrets.Scanner(secrets.default_ranks())
    for s in runs:
        assert [x for x in scanner.scan(f"see {s} here") if x[1] < 3] == [(a, k, b) for a, k, b in brute_secrets(f"see {s} here")]
    assert time.time() - began < 20
    rows = secrets.redact(table(spark, [(i, f"see {s} here", "x", 1) for i, s in enumerate(runs)])).collect()
    assert len(rows) == len(runs) and "[SECRET]" in next(x.text for x in rows if x.doc_id == 2)


def test_redact(spark):
    rows = {r.doc_id: r.text for r in secrets.redact(table(spark, [(0, 'a token="123456789" b', "x", 1), (1, "clean", "x", 1), (2, None, "x", 1)])).collect()}
    assert rows == {0: 'a [SECRET]" b', 1: "clean", 2: None}


def test_fingerprints_against_brute_force(spark):
    texts = [f"the {i} quick brown foxes jumped over {i * 7 % 5} lazy dogs and more" * (1 + i % 3) for i in range(40)] + [None, "", "é"]
    docs = [(i * 3, t, None, 0) for i, t in enumerate(texts)]
    rows = {r.doc_id: r for r in fingerprints.edited(table(spark, docs[::-1]).repartition(5)).collect()}
    for i, t in enumerate(texts):
        text, after = t or "", texts[(i + 1) % len(texts)] or ""
        cut = len(text) // 4
        new = text[: len(text) - cut] + after[:cut]
        row = rows[i * 3]
        assert row.n_chars == len(text) and row.edited_sha256 == hashlib.sha256(new.encode()).hexdigest()
        assert row.fingerprint == fingerprints.to_text(fingerprints.sketch(text))
        assert row.near_next == fingerprints.resemblance(fingerprints.sketch(text), fingerprints.sketch(after))


@pytest.mark.parametrize("partitions", [1, 4, 700])
@pytest.mark.parametrize("kind", ["long", "string"])
def test_fingerprints_of_any_ids(spark, kind, partitions):
    """Ids of other types, null and repeated ones, in few and in many ranges."""
    rows = [(None if i % 9 == 0 else i // 2 * 10, f"text number {i % 50} of some {i * i % 17} words") for i in range(150)] + [(None, None), (1, ""), (1, "")]
    rows = [(str(i) if kind == "string" and i is not None else i, t) for i, t in rows]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        docs = spark.createDataFrame(rows, f"doc_id {kind}, text string")
        found = fingerprints.edited(docs).collect()
        order = [(r.doc_id, r.text or "") for r in docs.selectExpr("*", "xxhash64(text) as h").orderBy(F.asc_nulls_first("doc_id"), "h", "text").collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    expected = []
    for (key, text), (_, after) in zip(order, order[1:] + order[:1]):
        cut = len(text) // 4
        expected.append((key, len(text), hashlib.sha256((text[: len(text) - cut] + after[:cut]).encode()).hexdigest()))
    by = lambda x: (x[0] is not None, x[0] or "", x[1:])
    assert sorted(map(lambda r: tuple(r)[:3], found), key=lambda x: str(by(x))) == sorted(expected, key=lambda x: str(by(x)))


def test_merged_fingerprints(spark):
    parts = [(k, f"part {i} of {k}, " + " ".join(f"word{j}" for j in range(i * 40, i * 40 + 60))) for k in ("a", "b", None) for i in range(30)] + [("c", None)]
    found = fingerprints.merged(fingerprints.fingerprint(spark.createDataFrame(parts, "source string, text string").repartition(6), "source"), ["source"])
    rows = {r.source: r for r in found.collect()}
    for k in ("a", "b", None):
        whole = np.unique(np.concatenate([fingerprints.hashes(t.encode()) for s, t in parts if s == k]))
        assert rows[k].fingerprint == fingerprints.to_text(whole[: fingerprints.K]) and abs(rows[k].n_shingles / len(whole) - 1) < 0.3
    assert rows["c"].fingerprint == "" and rows["c"].n_shingles == 0


def shingles(text):
    data = text.encode()
    return {data[i : i + 12] for i in range(max(1, len(data) - 11))} if data else set()


def test_sketch_estimates():
    a = " ".join(f"word{i}" for i in range(900))
    b = a[:4500] + " ".join(f"other{i}" for i in range(300))
    x, y, s, t = shingles(a), shingles(b), fingerprints.sketch(a), fingerprints.sketch(b)
    assert abs(fingerprints.resemblance(s, t) - len(x & y) / len(x | y)) < 0.15
    assert abs(fingerprints.containment(s, t) - len(x & y) / len(x)) < 0.15
    assert abs(fingerprints.count(s) / len(x) - 1) < 0.3
    assert (fingerprints.merge(s, t) == fingerprints.merge(t, s)).all()
    assert (fingerprints.from_text(fingerprints.to_text(s)) == s).all()


def test_licenses_as_files_have_them(spark, tmp_path):
    """Title lines, bullets for numbers, long licences by their digests, and a folder of texts."""
    bsd = KNOWN["BSD-3-Clause"].replace("1. ", "* ").replace("2. ", "* ").replace("3. ", "* ")
    texts = {1: "MIT License\n\nCopyright (c) 2021 Some One\n\n" + KNOWN["MIT"], 2: "BSD 3-Clause License\n\nCopyright (c) 1999, X\n\n" + bsd, 3: "The ISC License (ISC)\n" + KNOWN["ISC"], 4: "MIT License", 5: "The MIT License is released under the MIT license."}
    expected = {1: "MIT", 2: "BSD-3-Clause", 3: "ISC", 4: None, 5: None}
    for i, (file, name) in enumerate({"GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "Apache-2.0": "Apache-2.0", "MPL-2.0": "MPL-2.0", "LGPL-3": "LGPL-3.0"}.items(), 6):
        path = Path("/usr/share/common-licenses") / file
        if path.is_file():
            texts[i], expected[i] = "\n" + path.read_text().upper() + "\n", name
    table_ = table(spark, [(k, v, None, 0) for k, v in texts.items()])
    assert {r.doc_id: r.license for r in licenses.scan(table_).collect()} == expected
    (tmp_path / "Own-1.0.txt").write_text("MIT License\n\n" + KNOWN["MIT"])
    found = {r.doc_id: r.license for r in licenses.scan(table_, folder=str(tmp_path)).collect()}
    assert found[1] == "Own-1.0" and found[2] is None


def rewrapped(text):
    """The text at five widths, with one line a paragraph, and as comments of three kinds."""
    paragraphs = [" ".join(p.split()) for p in re.split(r"\n[ \t]*\n", text) if p.strip()]
    out = ["\n\n".join(textwrap.fill(p, width) for p in paragraphs) for width in (50, 60, 72, 80, 100)]
    out.append("\n\n".join(paragraphs))
    for mark in ("# ", "// ", " * "):
        out.append("".join(f"{mark}{line}".rstrip() + "\r\n" for line in out[2].split("\n")))
    out[-1] = f"/*\n{out[-1]}*/"
    return out


def test_licenses_do_not_depend_on_lines(spark):
    texts = {k: v for k, v in KNOWN.items() if "notice" not in k}
    texts |= {f"{k} with holder": "The MIT License (MIT)\n\nCopyright (c) 2019-2024 A. Person <a@example.org>, B & Co.\nPortions Copyright © 2003, Others\nAll rights reserved.\n\n" + v for k, v in KNOWN.items() if k in ("MIT", "BSD-2-Clause", "BSD-3-Clause", "ISC")}
    known_files = {"Apache-2.0": "Apache-2.0", "Artistic": "Artistic-1.0-Perl", "CC0-1.0": "CC0-1.0", "GFDL-1.3": "GFDL-1.3", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0", "MPL-1.1": "MPL-1.1", "MPL-2.0": "MPL-2.0"}
    texts |= {name: path.read_text() for file, name in known_files.items() if (path := Path("/usr/share/common-licenses") / file).is_file()}
    rows = [(i, t, k, 0) for i, (k, t) in enumerate((k, t) for k, v in texts.items() for t in [v, *rewrapped(v)])]
    found = {r.doc_id: (r.license, r.digest) for r in licenses.scan(table(spark, rows)).collect()}
    for k in texts:
        own = {found[i] for i, _, name, _ in rows if name == k}
        assert len(own) == 1 and own.pop()[0] == k.removesuffix(" with holder"), k


def test_licenses(spark):
    texts = {1: "Copyright (c) 2020 Somebody\n\n" + KNOWN["MIT"].upper(), 2: "intro\n** released under the MIT licence! **\nrest", 3: KNOWN["ISC"] + "more", 4: "All rights reserved."}
    rows = {r.doc_id: (r.license, r.n_license_lines, r.line_licenses) for r in licenses.scan(table(spark, [(k, v, None, 0) for k, v in texts.items()])).collect()}
    assert rows == {1: ("MIT", 0, ""), 2: (None, 1, "MIT notice"), 3: (None, 0, ""), 4: (None, 0, "")}
