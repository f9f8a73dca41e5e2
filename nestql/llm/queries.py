"""The queries opN_<name>: each operator over its whole table, with production parameters."""

from __future__ import annotations

import os
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_format, decontaminate, html_extract, language_id, license_scan, quality_classifier, sentencepiece, url_filter
from .common import table
from .embedding_dedup import embedding_links
from .minhash_dedup import near_duplicates
from .sql import ORACLES



def _piece_model() -> str | None:
    """Where the driver finds a SentencePiece model: named by the environment, else one of the package of public tokenizers, if that is there."""
    named = os.environ.get("NESTQL_PIECE_MODEL")
    if named:
        return named
    try:
        import public_tokenizers
    except ModuleNotFoundError:
        return None
    return public_tokenizers.path("piece_bpe_32k.model")


#: Executors get its pieces from the driver.
PIECE_MODEL = _piece_model()


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every row of pages, repeated rows and null pages (an empty text) included; other columns are ignored."""
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every conversation, and of conversation -7, read back from its formatted turns. Null texts and roles are empty; repeated turns stay; other columns are ignored."""
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame(
        pa.table({"conv_id": pa.array([-7, -7]), "turn": pa.array([0, 1]), "role": pa.array(["user", "assistant"]), "text": pa.array([said, said])})
    )
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat_format.digests(chat_format.format_turns(rows))


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ids of every document's text and whether they decode to it. Null and empty texts have no ids; repeated rows stay repeats; other columns are ignored."""
    model = sentencepiece.Pieces.read(PIECE_MODEL)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    encoded = sentencepiece.encode(docs, model, check_col="round_trip")
    return encoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", "round_trip")


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License notices in every document's text. Null and empty texts match nothing; repeated rows stay repeats; other columns are ignored."""
    return license_scan.license_matches(table(spark, sf_dir, "documents"))


def op5_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The group of every document. Null and empty texts link with nothing; rows that repeat an id are one node; other columns are ignored."""
    return near_duplicates(table(spark, sf_dir, "documents"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every page's url. A null url is allowed, a null page has no links; repeated rows stay repeats; other columns are ignored."""
    return url_filter.url_verdicts(table(spark, sf_dir, "pages"))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality score of every document, learnt from labels that are not held out. Null texts score as empty ones; repeated rows stay repeats; other columns are ignored."""
    docs = table(spark, sf_dir, "documents")
    return quality_classifier.quality_scores(docs, quality_classifier.fit(docs, table(spark, sf_dir, "labels")))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learnt from rows that are not held out. Null texts are `und`; repeated rows stay repeats and are learnt from as often; other columns are ignored."""
    docs = table(spark, sf_dir, "documents")
    return language_id.languages(docs, language_id.fit(docs))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every document holds of the benchmark. Null and empty texts have no words; repeated rows and items count alike; other columns are ignored."""
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        "contaminated",
    )


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The links and group of every vector. Null, zero and non-finite vectors and null labels link with nothing; rows that repeat an id are one node; other columns are ignored."""
    return embedding_links(table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return ORACLES
