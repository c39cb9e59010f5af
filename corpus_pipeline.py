"""A training-data pipeline: five stages over ``documents``, each written as Parquet and read again by the next.

1. ``language_id`` drops the documents that the language classifier rejects (no letters, or far from every
   language that it learned).
2. ``line_dedup`` takes out lines that an earlier document or line has, or has but for one character, and
   drops documents that have nothing left.
3. ``jaccard_join`` keeps the document of smallest id of each group of near duplicates.
4. ``mixing`` repeats or leaves out documents so that sources come to their target weights, and orders them.
5. ``bpe`` encodes every text and checks the ids by decoding them.

Stages 1 to 4 return the columns of ``documents``, with ``n_chars`` set to the text they return.
Nulls: a null text is rejected by stage 1; other columns may hold nulls anywhere. An empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, jaccard, langid, linededup, mixing
from tessera.llm.common import materialize

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on a bounded sample of them, does not reject."""
    docs = docs.select(*COLUMNS)
    return langid.filter_known(docs, langid.fit(docs))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that came before; those with nothing left are gone."""
    out = linededup.dedup(docs.select(*COLUMNS))
    out = out.where((F.col("text") != "") & F.col("text").isNotNull())
    return out.withColumn("n_chars", F.char_length("text").cast("long"))


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of near duplicates."""
    return jaccard.representatives(docs.select(*COLUMNS))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, in training order."""
    return mixing.training_order(docs.select(*COLUMNS))


def bpe_encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id``, ``n_tokens``, ``ids`` (little-endian unsigned 32-bit) and ``decodes`` (they give the text's bytes)."""
    import public_tokenizers

    model = bpe.load_model(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    # Workers outlive the stage, and what they remember stays in the memory of those that come after.
    return bpe.encode(docs, model, check=True, memo_pieces=100_000)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("jaccard_join", jaccard_join),
    ("mixing", mix_sources),
    ("bpe", bpe_encode),
]

#: A classifier and a tokenizer aren't expressible in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace("_", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
