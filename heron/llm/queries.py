"""The queries of this subpackage for __spark_entry__.py: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import oracles
from .alignment import alignment_digests
from .bpe import encoding_digests
from .common import table
from .divergence import source_divergences
from .licenses import scan_licenses
from .lm import score_documents
from .media import media_digests
from .packing import pack_documents
from .quality import COUNTS, fit, judge
from .sharding import shard_documents
from .simhash import near_duplicates
from .substring import repeat_digests
from .token_counts import maintained_totals
from .token_files import token_file_digests


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoding_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, toxic = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").where("toxic = 1")
    return maintained_totals(docs, toxic, public_tokenizers.path("byte_bpe_50k.json"), "byte_bpe_50k")


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"), shards=8)


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), words=4, radius=4)


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_file_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=0)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rules = fit(docs, table(spark, sf_dir, "labels"))
    return judge(docs, rules).select("doc_id", *COUNTS[:5], "base_failed", "kept", "rule")


def op7_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"))


def op8_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_digests(table(spark, sf_dir, "documents"))


def op9_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeat_digests(table(spark, sf_dir, "documents"), window=13)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=2, whole=False)


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergences(table(spark, sf_dir, "documents"))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op13_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (op1_bpe, op2_token_counts, op3_sharding, op4_simhash, op5_token_files, op6_quality, op7_lm, op8_media, op9_substring, op10_packing, op11_divergence, op12_alignment, op13_licenses)
    return {f.__name__: f for f in every}


def oracle_sql() -> dict[str, str]:
    """Tokens, XXH64 fingerprints, learned models and images are beyond SQL; tests hold those against brute force."""
    return {"op3_sharding": oracles.SHARDS, "op9_substring": oracles.REPEATS, "op11_divergence": oracles.DIVERGENCES}
