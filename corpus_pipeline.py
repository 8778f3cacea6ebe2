"""From raw documents to packed training sequences: each stage is one operator of ``gleaner.llm``.

The stages' tables are written as Parquet and read again, so a lost executor costs one stage's re-read at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm import langid, minhash, pack, secrets, substring
from gleaner.llm.common import packed, table, unpacked, vocabulary
from gleaner.scratch import materialize
from gleaner.shipping import ship

#: A document goes where no language is found, or where the classifiers' confidence is below this. With two
#: families of two languages each confidence is 0.25 at least, and only texts without a letter go.
LEAST_SCORE = 0.1
SHINGLE_WORDS, PERCENT, PASSAGE_WORDS = 5, 80, 35

ORACLE_SQL = None


def _resized(docs: DataFrame, columns: list[str]) -> DataFrame:
    """n_chars follows a changed text."""
    return docs.withColumn("n_chars", F.length("text").cast("long")).select(*columns)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents in no known language; the others stay as they are."""
    ship(spark)
    model = langid.train(docs)
    found = langid.identify(packed(docs, "text"), model, ["_rest"], "_text", with_text=True)
    return found.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE)).select(*unpacked(docs, "text"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the least id of each near-duplicate group."""
    ship(spark)
    return minhash.one_of_each(docs, SHINGLE_WORDS, PERCENT)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages that start in more than one place."""
    ship(spark)
    return _resized(substring.remove_repeats(docs, PASSAGE_WORDS), docs.columns)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets in the texts."""
    return _resized(secrets.redact(docs), docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents' ids into training sequences."""
    ship(spark)
    return pack.pack(docs, vocabulary("word_bpe_49k.json"))


STAGES = [("language_id", language), ("near_dedup", near_dedup), ("substring_dedup", substring_dedup), ("secret_scan", secret_scan), ("packing", packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    ship(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
