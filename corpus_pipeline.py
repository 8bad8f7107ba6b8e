"""From documents to packed sequences: five stages, each one operator of the training-text folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadpulse.llm import langid, linededup, packing, pii, simhash
from roadpulse.llm.common import saved
from roadpulse.llm.queries import vocabulary

LEAST_SCORE = 0.5  # of the predicted language


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language: not those without a letter, nor those that no language claims.

    The model learns from the labels of two thirds of ``docs``; where none is labelled, nothing is rejected.
    """
    model = langid.learn(docs.where(~langid.held_out()))
    if not model.languages:
        return docs
    known = langid.predict(docs, model).where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_SCORE))
    return known.select(*docs.columns)


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in five documents or more stay in one of them only; a document left without lines stays, empty."""
    return _sized(linededup.dedup_lines(docs), docs)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (three-word shingles, at most two differing bits) the row with the smallest doc_id, once.

    Rows that share a doc_id are judged by their own texts. Rows without doc_id all stay.
    """
    row = F.struct("doc_id", F.xxhash64("text").alias("_of_text"))
    named = docs.where("doc_id is not null")
    groups = simhash.near_duplicates(named.select(row.alias("row"), "text"), doc="row")
    first = groups.where("doc_id = component_id").select("doc_id.doc_id", "doc_id._of_text").distinct()
    keys = ["_id", "_of_text"]
    rows = named.select(F.struct(*docs.columns).alias("_row"), F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_of_text"))
    kept = rows.join(first.toDF(*keys), keys, "left_semi").dropDuplicates(keys)
    return kept.select("_row.*").union(docs.where("doc_id is null"))


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each span of personal data gives way to its kind in brackets."""
    return _sized(pii.redact(pii.find(docs)), docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids in pieces of power-of-two lengths, one row per piece."""
    return packing.pack(docs, vocabulary())


def _sized(changed: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs``, n_chars following the text."""
    if "n_chars" in docs.columns:
        changed = changed.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return changed.select(*docs.columns)


STAGES = [
    ("language", known_language),
    ("line dedup", without_repeated_lines),
    ("near duplicates", one_of_each),
    ("personal data", without_personal_data),
    ("packing", packed),
]
# The language model, the fingerprints' components and the token ids have no SQL form; tests hold the
# result against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each but the last is written to the shared folder and reread."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
