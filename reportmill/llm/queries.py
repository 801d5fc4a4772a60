"""One query per operator, over its whole table, with production parameters."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import divergence, hardneg, mixing, vafile, warc
from .common import shared_dir, table
from .ctph import fingerprint_documents
from .dartminhash import near_duplicates
from .divergence import source_divergence
from .fuzzy_lines import line_dedup
from .hardneg import hard_negatives
from .langid import held_out, identify
from .mixing import mix_sources
from .packing import pack
from .pfp_dedup import suffix_dedup
from .rlz_dedup import substring_dedup
from .tokencount import token_counts
from .vafile import top_k


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of 13 words that an earlier document has go; words, removed words and the hash of what is left, of every document."""
    return substring_dedup(table(spark, sf_dir, "documents"), texts=False).drop("kept", "spans")


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fuzzy lines over all documents, one occurrence of each group kept: lines and removed lines of every document."""
    return line_dedup(table(spark, sf_dir, "documents"), texts=False).drop("kept")


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strings of 100 bytes that start earlier in the corpus go; bytes, removed bytes and runs of every document."""
    return suffix_dedup(table(spark, sf_dir, "documents"), texts=False).drop("kept")


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of every document the mix of all sources takes."""
    return mix_sources(table(spark, sf_dir, "documents"))


def op10_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best inner products of every fiftieth vector with all others."""
    return top_k(table(spark, sf_dir, "embeddings"))


def op1_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of near duplicates of every document, and its links."""
    return near_duplicates(table(spark, sf_dir, "documents"))


def op2_warc_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written as WARC records with revisits, and read again by their headers."""
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    warc.archive_pages(table(spark, sf_dir, "pages"), path)
    return warc.read_pages(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as pieces of sequences of 2,048 tokens. Ids stay with the pieces' table: the result needs their crc alone."""
    path = public_tokenizers.path
    return pack(table(spark, sf_dir, "documents"), path("byte_bpe_50k.json"), path("byte_bpe_50k.tiktoken"), ids=False).drop("ids")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from those that are not held out."""
    out = identify(table(spark, sf_dir, "documents"))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text, and how alike they are."""
    return fingerprint_documents(table(spark, sf_dir, "documents"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Divergence of every source from the others of its language, and its 200 most telling terms."""
    return source_divergence(table(spark, sf_dir, "documents"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every fiftieth vector's five positives, labels of every seventh moved by one."""
    v = table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(v.withColumn("label", moved))


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document by the 32k model, and which documents are over 4,096."""
    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages of corpus_pipeline over all documents."""
    import corpus_pipeline  # at the repository top; it belongs to this subpackage

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    f.__name__: f
    for f in (
        op1_near_duplicates, op2_warc_pages, op3_substring_dedup, op4_language_id, op5_mix_sources, op6_fingerprints, op7_line_dedup, op8_suffix_dedup, op9_pack_sequences, op10_exact_top_k, op11_source_divergence, op12_hard_negatives, op13_token_counts, pipeline,
    )
}
ORACLES = {"op2_warc_pages": warc.SQL, "op5_mix_sources": mixing.SQL, "op10_exact_top_k": vafile.SQL, "op11_source_divergence": divergence.SQL, "op12_hard_negatives": hardneg.SQL}
