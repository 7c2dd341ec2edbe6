"""The pipeline against brute force, stage by stage, on a small folder of tables."""

import random
import re

import pytest

import corpus_pipeline
from quillon.llm import bpe, secrets

from .test_models import WORDS
from .test_pairs import brute_classes, brute_hits, edited

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, ids int"


def sentence(r, lang, n):
    return " ".join(r.choice(WORDS[lang]) + r.choice(["", "", f"{r.randrange(400)}x", "."]) for _ in range(n))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    r, at = random.Random(4), str(tmp_path_factory.mktemp("sf"))
    items = [(i, sentence(r, "en", 14)) for i in range(4)] + [(None, "lone item without an id"), (9, None)]
    docs = []
    for i in range(80):
        lang = r.choice(list(WORDS))
        docs.append((i, sentence(r, lang, r.randrange(20, 80)), lang))
    docs += [(100 + i, edited(r, docs[i][1], 1), docs[i][2]) for i in range(10)] + [(120, docs[3][1], docs[3][2])]
    docs += [(130, f"{docs[5][1]} {items[2][1]}", "en"), (131, "the item is a lone item without an id for the", "en"), (140, "the key is password = hunter2secret for the of and in", "en"), (141, "12 ?? 34", "en"), (142, None, "en"), (143, "", None)]
    rows = [(i, t, lang, "s", len(t or ""), "x", 1) for i, t, lang in docs] + [(144, "the and of to in is that it", None, None, None, None, None)] * 2
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return at, items


def test_stages(spark, folder):
    at, items = folder
    docs = spark.read.parquet(f"{at}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        docs = stage(spark, docs, at)
        after = docs.collect()
        ids = sorted(x.doc_id for x in after)
        if name != "tokens":
            assert docs.columns == [c.split()[0] for c in SCHEMA.split(", ")]
        if name == "language":
            assert {x.doc_id for x in before} - set(ids) == {141, 142, 143}
        elif name == "near_duplicates":
            order = sorted({(x.doc_id, x.text) for x in before})
            of = brute_classes([t for _, t in order])
            assert ids == [order[i][0] for i, (_, _, c) in enumerate(of) if i == c]
        elif name == "decontamination":
            hit = {x.doc_id for x in before if brute_hits(x.text, items)[1]}
            assert hit >= {130, 131} and ids == sorted(x.doc_id for x in before if x.doc_id not in hit)
        elif name == "secrets":
            texts = {x.doc_id: x for x in after}
            assert texts[140].text == "the key is [SECRET] for the of and in" and texts[140].n_chars == len(texts[140].text)
            assert not any(re.search(secrets.ASSIGN, x.text, re.I) for x in after) and len(after) == len(before)
        else:
            codec, texts = bpe.codec(bpe.default_ranks()), {x.doc_id: x.text for x in before}
            assert {x.doc_id: list(x.ids) for x in after} == {i: codec.encode(t).tolist() for i, t in texts.items()}
        docs = spark.createDataFrame(after, docs.schema)


def test_run_and_empty_tables(spark, folder, tmp_path):
    at, _ = folder
    assert corpus_pipeline.run(spark, at).count() > 60
    for name in ("documents", "benchmark"):
        spark.read.parquet(f"{at}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
