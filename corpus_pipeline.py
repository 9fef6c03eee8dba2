"""Corpus cleaning: five stages over ``documents``, each one operator of ``auctionlens.llm``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is
written as Parquet and read again as the next stage's ``docs``. All but the
last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from auctionlens.llm import crf, langid, setsketch, softmix, winnow
from auctionlens.llm.common import crc_mod, small_batches, stored


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents whose language is recognised (operator 9).

    The model learns from the labelled part of the stage's own input. Null
    texts and texts without a letter go."""
    small_batches(spark)
    return langid.keep(docs, langid.fit(docs, crc_mod("doc_id", 3) != 1))


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that are not predicted toxic (operator 3), learned
    from the labels of the stage's own input."""
    small_batches(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return crf.keep(docs, crf.fit(docs, labels, crc_mod("doc_id", 5) != 0))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each near-duplicate group (operator 5): five-word
    shingles, similarity 0.8 or more."""
    small_batches(spark)
    return setsketch.keep(docs, k=5)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that hold no benchmark window (operator 1)."""
    small_batches(spark)
    return winnow.keep(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


_CLEAN = {d: w for d, w in softmix.TARGETS.items() if d.endswith("t0")}
#: the default targets of the domains without toxic documents, renormalised
CLEAN_TARGETS = {d: w / sum(_CLEAN.values()) for d, w in _CLEAN.items()}


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Domain posteriors and rates that meet the target weights (operator 6).
    The domains are the clean ones: the toxicity stage has taken out the others,
    so there is nothing to fill their targets with.
    Returns the documents taken at least once, with n_tokens, p, domain, rate
    and copies; those columns replace ones of the same name."""
    small_batches(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter("toxic = 0")
    return softmix.take(softmix.mix(docs, labels, CLEAN_TARGETS, whole_rows=True))


STAGES = [
    ("language_id", language_id),
    ("toxicity", toxicity),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("mixing", mixing),
]

#: The stages hold trained models, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
