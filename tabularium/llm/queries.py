"""The registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import table
from . import chat, html_extract, line_dedup, media, near_dedup, packing, sp_viterbi, tokens, topk, toxicity

BPE, SENTENCEPIECE = "byte_bpe_50k.json", "piece_bpe_32k.model"


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every non-blank line of the documents, where its component begins and whether it stays."""
    return line_dedup.line_components(table(spark, sf_dir, "documents"))


def op2_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts stored as 8-bit PGM images, read back, with digests."""
    stored = media.stored_media(table(spark, sf_dir, "documents"), "doc_id", "text")
    return media.media_features(stored).withColumnRenamed("key", "doc_id")


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation from each participant's perspective."""
    return chat.perspectives(table(spark, sf_dir, "conversations"))


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of the documents."""
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 2048 tokens."""
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(BPE))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every document."""
    counts = tokens.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path(BPE))
    return counts.withColumn("over_limit", F.col("n_tokens") > 512)


def op8_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 best of all vectors for every fiftieth."""
    return topk.top_k(topk.quantised(table(spark, sf_dir, "embeddings")), "vec_id % 50 = 0", 5)


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SentencePiece ids of every document as digests, and whether they decode to the document again."""
    return sp_viterbi.round_trips(table(spark, sf_dir, "documents"), public_tokenizers.path(SENTENCEPIECE))


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, low_quality, toxic): the categories of the chain, in order."""
    return table(spark, sf_dir, "labels").select("doc_id", (1 - F.col("quality")).alias("low_quality"), "toxic")


CATEGORIES = ["low_quality", "toxic"]


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probabilities of the chain's categories and the decision for every document."""
    docs = table(spark, sf_dir, "documents")
    chain = toxicity.train(docs, labelled(spark, sf_dir), CATEGORIES)
    return toxicity.score(docs, chain, CATEGORIES).withColumn("rejected", F.col("p_toxic") >= 0.5)


_ALL = (
    op1_line_dedup,
    op2_media_columns,
    op3_html_extraction,
    op4_chat_formatting,
    op5_near_dedup,
    op6_packing,
    op7_token_counts,
    op8_top_k,
    op9_sentencepiece,
    op10_toxicity,
)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in _ALL}
ORACLES: dict[str, str] = {"op4_chat_formatting": chat.PERSPECTIVES_SQL, "op5_near_dedup": near_dedup.NEAR_DUPLICATES_SQL, "op8_top_k": topk.TOP_5_SQL}
