"""From raw documents to token ids: language, near duplicates, benchmark passages, secrets, tokens.

Each stage takes (spark, docs, sf_dir) and returns documents with the columns of `documents`; the last adds the ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import bpe, decontaminate, jaccard, langid, secrets
from quillon.llm.common import table, written

#: Least posterior probability of a document's language.
SURE = 0.5


def new_name(docs: DataFrame, name: str) -> str:
    """name, longer until docs has no such column."""
    while name in map(str.lower, docs.columns):
        name += "_"
    return name


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known: those without a letter, or between languages, go."""
    lang, score = new_name(docs, "lang_pred"), new_name(docs, "score")
    found = langid.identify(docs, lang_out=lang, score_out=score)
    return found.filter((F.col(lang) != langid.UNKNOWN) & (F.col(score) >= SURE)).select(docs.columns)


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """docs but for the ids in gone; documents with a null id stay."""
    return docs.join(gone.select("doc_id").distinct(), "doc_id", "left_anti").select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked ones, that with the smallest id, and one of repeated rows."""
    found = jaccard.join(docs)
    kept = without(docs, found.filter("component_id != doc_id"))
    return kept.dropDuplicates(["doc_id", "text"])


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    found = decontaminate.find(docs, table(spark, sf_dir, "benchmark"))
    return without(docs, found.filter("size(places) > 0"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in their texts replaced by a mark; n_chars follows."""
    return secrets.redact(docs).withColumn("n_chars", F.length("text").cast("long"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of all documents."""
    return bpe.encode(docs).select("doc_id", "ids", F.size("ids").cast("long").alias("n_tokens"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("secrets", without_secrets), ("tokens", tokens)]

#: Language identification and byte-level BPE have no SQL; the stages are tested against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
