"""From raw documents to training tokens: language, quality, near-duplicates, mix, encoding.

Every stage takes (spark, docs, sf_dir); its result is written as Parquet and read again as the next stage's docs. All
stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hearthmark.llm import bpe, language, mixing, quality, simhash
from hearthmark.llm.common import held_out, stored

LEAST_SCORE = 0.4
BLOCK_BYTES = 2_000_000
BATCH, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", "1000"  # whole documents: ten thousand at once are 20 MB and more in each process


def whole(docs: DataFrame) -> DataFrame:
    """The text beside the row as one struct, so that no column of the documents clashes with an operator's."""
    return docs.select("text", F.struct(*(docs[c] for c in docs.columns)).alias("doc"))


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, a null text among them, or whose language is uncertain, go.

    Profiles are summed where they are made, and made again for the verdict: kept beside the documents they would cost
    more disk than the second look at the texts costs time. Repeated rows are judged alike; without a learned language
    all documents go.
    """
    train = language.profiles(docs.filter(~held_out() & F.col("lang").isNotNull()).select("lang", "text"))
    named = language.predict(language.profiles(whole(docs)), language.fit(train))
    return named.filter((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE)).select("doc.*")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of low quality go; a null text counts as empty. Without labels of both kinds all stay.

    Labels join the measures of texts, not the texts.
    """
    marks = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", F.col("quality").alias("label")).filter("label in (0, 1)").distinct()
    train = quality.features(docs.filter(~held_out()).select("doc_id", "text")).select("doc_id", "x").join(marks, "doc_id").select("label", "x")
    return quality.score(quality.features(whole(docs)), quality.fit(train)).filter("predicted = 1").select("doc.*")


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, that of smallest id: five-word shingles, SimHash, Jaccard 0.8.

    Texts without words are alike; a document without an id stays only where its group has none with one.
    """
    return simhash.near_representatives(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, in training order; texts without words go, a null source is a source."""
    return mixing.training_order(docs)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded bytes, a row for every copy; a null text counts as empty.

    Blocks are smaller than the operator's own, as its workers start beside what the stages before have left in memory.
    """
    import public_tokenizers

    return bpe.digests(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, block_bytes=BLOCK_BYTES)


STAGES = [("language_id", language_stage), ("quality", quality_stage), ("simhash_dedup", dedup_stage), ("mixing", mixing_stage), ("byte_bpe", encoding_stage)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each but the last written and read again. Python gets documents in small batches meanwhile."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.conf.get(BATCH)
    spark.conf.set(BATCH, BATCH_ROWS)
    try:
        for i, (name, stage) in enumerate(STAGES):
            docs = stage(spark, docs, sf_dir)
            docs = docs if i == len(STAGES) - 1 else stored(docs, name)
    finally:
        spark.conf.set(BATCH, before)
    return docs
