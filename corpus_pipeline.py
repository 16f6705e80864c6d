"""A corpus pipeline: language ID, exact and near deduplication, PII masking, packing.

Each stage takes (spark, docs, sf_dir) and works on every row that the stage before it
kept. All but the last return the columns of documents.

Handling, in every stage: other columns of ``docs`` are left out, whatever their names; texts are
read whole, however long; null and empty texts have a stated result; an empty table
gives an empty one. Ids may be null or repeat: rows are told apart by what they hold, and
none is multiplied by a join.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from groundwork.llm import dedup, jaccard, langid, pack, pii
from groundwork.llm.shared import written
from groundwork.sources.tables import spread

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Predict each document's language, which replaces ``lang``; documents without a
    language (no text, no letter) go. Predictions stand beside the rows themselves, so repeated rows stay
    as they are; ties between languages go to the first name."""
    rows = docs.select(*COLUMNS)
    found = langid.with_language(rows, langid.learned(rows)).where(F.col("lang_pred") != langid.UNDETERMINED)
    return found.withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (null counts as empty) the row with the largest id stays; of those with this id, as of rows
    without any id, the one that comes first by its other columns."""
    return dedup.distinct_texts(docs.select(*COLUMNS))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents (five words, similarity 0.75) one stays: the one with the smallest
    id, where ids repeat or are null the smallest row of the group in the order of the rows. Texts without
    words are linked with nothing and stay."""
    rows = docs.select(*COLUMNS)
    unique = rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 or doc_id is null").isEmpty()
    if not unique:  # a key of their own, written so that every job sees the same one
        rows = written(rows.withColumn("_key", F.monotonically_increasing_id()), "keyed")
    key = "doc_id" if unique else "_key"
    kept = jaccard.jaccard_components(rows, id_col=key).where("component_id = doc_id").select(F.col("doc_id").alias("_kept"))
    return rows.join(kept, F.col(key) == F.col("_kept"), "left_semi").select(*COLUMNS)


def mask_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every confirmed span of personal data becomes its kind's mask; ``n_chars`` follows the text. A null text
    stays null. The spans are found in the rows themselves, so no join is needed."""
    spans = pii.with_spans(docs.select(*COLUMNS))
    text = pii.redacted(F.col("text"), F.col("spans"))
    return spans.withColumn("text", text).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 1024 tokens: one row per piece with its place. Every row is a document of its own; a
    null text is the end token alone."""
    return pack.pack_documents(docs, pack.default_ranks())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("mask_pii", mask_pii),
    ("packing", packing),
]

#: Language ID learns, and packing uses a tokenizer: SQL can't express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
