"""From raw documents to tokens: language, near-duplicates, personal data, mix, ids.

Each stage takes what the one before kept, written to the shared folder and read again. A stage's defined results for
nulls, empty tables, repeated rows and further columns are those of its operator.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weirgate.llm import bpe_codec, language, mixing, pii, simhash_dedup
from weirgate.llm.common import documents, drop_folder, shared_folder


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; the model learns from the stage's own labelled rows."""
    return language.keep_known(docs, language.fit(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return simhash_dedup.one_of_each(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by marks; n_chars, where there is one, is counted again."""
    clean = pii.redact(docs)
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else clean


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target asks."""
    return mixing.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang and source with the token ids of the text, and digests of the ids and of their decoded bytes."""
    return bpe_codec.tokens(docs, bpe_codec.default_path(), keep=[F.col("lang"), F.col("source")])


STAGES = [("language_id", language_id), ("near_duplicates", near_duplicates), ("personal_data", personal_data), ("mix", mix), ("encode", encode)]

#: Trained models, hash draws and merges aren't SQL; the tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. A stage's input is deleted once its output is written."""
    docs, before = documents(spark, sf_dir), None
    for name, stage in STAGES:
        path = shared_folder(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            drop_folder(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs
