"""The numbered operators as queries over the supplied tables, with SQL where it can say them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from atalaya.llm import bpe, chat, divergence, fingerprints, minhash, packing, phrases, suffixes, toxicity, unigram, urls, vectors

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(build: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[build.__name__] = build
    return build


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query
def op1_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    """Packed sequences: segments and the digests of their id and position rows."""
    packed = packing.pack_matrices(table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return packed.select(
        "sequence_id", "n_tokens", "doc_ids", "starts", "cu_seqlens",
        F.sha2("input_ids", 256).alias("input_ids_sha256"), F.sha2("position_ids", 256).alias("position_ids_sha256"),
    )


@query
def op2_first_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    """Every piece of every document with its sequence and offset."""
    return packing.ffd_pack(table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query
def op3_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    """Counts and digests of the ids of every document and of what they decode to."""
    rule = (public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    decoded = bpe.decode_documents(bpe.encode_documents(table(spark, folder, "documents"), *rule), *rule)
    return decoded.select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


@query
def op6_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts."""
    return fingerprints.fingerprint_pairs(table(spark, folder, "documents"))


@query
def op5_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    """Verdict of every page by rules and path templates."""
    return urls.filter_urls(table(spark, folder, "pages"))


SQL["op5_url_filter"] = urls.oracle()


@query
def op8_embedding_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    """Links and components of all embeddings."""
    return vectors.near_vectors(table(spark, folder, "embeddings"))


@query
def op9_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Tokens of every whole text under a unigram vocabulary."""
    return unigram.token_counts(table(spark, folder, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@query
def op10_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """Category probabilities of every document by a chain fitted on the labelled ones."""
    docs = table(spark, folder, "documents")
    return toxicity.toxicity_scores(docs, toxicity.fit_model(docs, table(spark, folder, "labels")))


@query
def op4_minhash_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    """Class of every document, and whether it is the one that stays."""
    return minhash.near_classes(table(spark, folder, "documents")).select("doc_id", "class_id", "kept")


@query
def op7_repeated_strings(spark: SparkSession, folder: str) -> DataFrame:
    """What every document loses to strings of 200 bytes that occur elsewhere."""
    return suffixes.span_report(table(spark, folder, "documents"))


@query
def op11_source_divergence(spark: SparkSession, folder: str) -> DataFrame:
    """Distances of the sources of each language, and the terms that tell each source."""
    return divergence.source_divergence(table(spark, folder, "documents"))


SQL["op11_source_divergence"] = divergence.oracle()


@query
def op12_chat_formatting(spark: SparkSession, folder: str) -> DataFrame:
    """What reads back from every formatted conversation, and from one that holds control strings."""
    return chat.format_report(chat.text_parts(chat.with_trap(table(spark, folder, "conversations"))))


SQL["op12_chat_formatting"] = chat.oracle()


@query
def op13_phrase_collocations(spark: SparkSession, folder: str) -> DataFrame:
    """The first phrases of each language by the score of their worst cut."""
    return phrases.collocations(table(spark, folder, "documents"))


SQL["op13_phrase_collocations"] = phrases.oracle()
