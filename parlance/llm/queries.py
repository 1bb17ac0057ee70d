"""The queries of the operators, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import bpe, chat, divergence, fertility, language, media, mixing, ngram_join, pii, piece_bpe, toxicity, url_filters, whitening
from .common import read


def op1_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.digest(read(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.language_id(read(spark, sf_dir, "documents"))


def op5_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.digest(chat.format_conversations(chat.with_tricky(read(spark, sf_dir, "conversations"))))


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_join(read(spark, sf_dir, "documents"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.replaced(read(spark, sf_dir, "documents").select("doc_id", "text"))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fertility.rules(read(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.judge(read(spark, sf_dir, "pages"))


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The leading 32 components of every whole-number embedding, whitened; see whitening.digest()."""
    return whitening.digest(read(spark, sf_dir, "embeddings"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far each source of a language is from the others and from the language, in whole texts; see divergence.audit()."""
    return divergence.audit(read(spark, sf_dir, "documents"))


def op13_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every whole text of documents, and the text decoded from them; see piece_bpe.digest()."""
    return piece_bpe.digest(read(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        f.__name__: f
        for f in (op1_media_columns, op2_toxicity, op3_mixing, op4_language_id, op5_chat_formatting, op6_ngram_join, op7_pii, op8_bpe, op9_quality_rules, op10_url_filters, op11_embedding_whitening, op12_source_divergence, op13_sentencepiece)
    }


def oracle_sql() -> dict[str, str]:
    """Models, tokens, surrogates, components and digests of files are beyond SQL; tests hold those against brute force."""
    return {"op3_mixing": mixing.ORACLE_SQL, "op5_chat_formatting": chat.ORACLE_SQL, "op12_source_divergence": divergence.ORACLE_SQL}
