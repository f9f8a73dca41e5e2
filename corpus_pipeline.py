"""A cleaning pipeline over documents, a Parquet table between any two stages.

Each stage works on all rows that its predecessor kept. The models of the first two stages are fitted on
the stage's own input, never on held-out rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from nestql.llm import decontaminate, language_id, minhash_dedup, quality_classifier, sentencepiece
from nestql.llm.common import stored, table
from nestql.llm.queries import PIECE_MODEL


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop texts whose quality score is under 0.3."""
    return quality_classifier.drop_low_quality(docs, quality_classifier.fit(docs, table(spark, sf_dir, "labels")))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop texts without a letter, in no learned language, or of which no language has three tenths of the letters."""
    return language_id.drop_unsure_language(docs, language_id.fit(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the smallest doc_id of each group linked at a similarity of 0.8 or more."""
    return minhash_dedup.deduplicate(docs, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop texts of which a twentieth of the words or more is in test passages."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Add the ids of the text's pieces and whether they decode to it."""
    return sentencepiece.encode(docs, sentencepiece.Pieces.read(PIECE_MODEL), check_col="round_trip")


STAGES = [
    ("quality", quality),
    ("language", language),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("pieces", pieces),
]
#: SQL cannot express the first two stages nor the last.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
