"""The numbered queries over the test tables: thin calls of the operators with production parameters."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import oracles
from ._base import load, scratch_path, stored
from .decontam import contamination
from .hard_negatives import hard_negatives
from .lang_id import crc_mod, identify_languages
from .line_dedup import dedup_lines
from .mixing import mix_sources
from .pieces import encode_pieces
from .quality import score_quality
from .simhash import near_duplicates
from .span_dedup import dedup_spans
from .token_counts import length_histogram
from .token_files import token_digests, write_token_files
from .topk import top_k
from .vector_codes import code_text, compress, with_label_error


def tokenizer_file(name: str = "word_bpe_49k.json") -> str:
    """Place of a public tokenizer file; SPANFRAME_TOKENIZERS names another folder of them."""
    if found := os.environ.get("SPANFRAME_TOKENIZERS"):
        return os.path.join(found, name)
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = crc_mod(F.col("doc_id"), 4) == 2  # null for a null id, which teaches nothing and is not held out
    found = identify_languages(load(spark, sf_dir, "documents"), ~held_out)
    return found.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(load(spark, sf_dir, "documents"))


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(load(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op5_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(load(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "tokens")
    write_token_files(load(spark, sf_dir, "documents"), path, tokenizer_file())
    return token_digests(spark, path).withColumnRenamed("id", "doc_id")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return length_histogram(load(spark, sf_dir, "documents"), tokenizer_file(), by="source")


def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(load(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "rate", "copies")


def op10_span_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_spans(load(spark, sf_dir, "documents"), every=True)


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = compress(load(spark, sf_dir, "embeddings"))
    sha = F.lit(books.sha256 if books else None).cast("string").alias("codebooks_sha256")
    return with_label_error(stored(coded, "codes")).select("vec_id", code_text().alias("code"), "error", "label_error", sha)


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(load(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, label=label)


def op13_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = encode_pieces(load(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"), decode=True)
    ids = F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256")
    return found.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), ids, F.sha2("decoded", 256).alias("decoded_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (
        op1_language_id,
        op2_decontaminate,
        op3_line_dedup,
        op4_simhash_near_dedup,
        op5_top_k,
        op6_quality_classifier,
        op7_token_files,
        op8_token_counts,
        op9_mix_sources,
        op10_span_dedup,
        op11_vector_codes,
        op12_hard_negatives,
        op13_pieces,
    )
    return {f.__name__: f for f in every}


def oracle_sql() -> dict[str, str]:
    return {"op2_decontaminate": oracles.OP2, "op3_line_dedup": oracles.OP3, "op5_top_k": oracles.OP5, "op11_vector_codes": oracles.OP11, "op12_hard_negatives": oracles.OP12}
