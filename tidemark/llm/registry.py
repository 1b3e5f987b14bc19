"""The queries of this subpackage, one for each operator, and their SQL oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import language, oracles, toxicity
from tidemark.llm.alignment import composed, tokenizers_of
from tidemark.llm.bpe import codec_of, token_digests
from tidemark.llm.dominance import rows_above
from tidemark.llm.hamming import nearest
from tidemark.llm.html_text import with_main_text
from tidemark.llm.media import media_digests, stored_media
from tidemark.llm.minhash import near_duplicates
from tidemark.llm.mixing import mix
from tidemark.llm.ngram_join import ngram_classes
from tidemark.llm.shared import fold, table
from tidemark.llm.token_counts import count_tokens, pieces_of
from tidemark.llm.warc import archived


def tokenizer_path(name: str) -> str:
    """Where the installed vocabulary files are; every operator takes the path as a parameter."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archived(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_classes(table(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    held_out = (fold("doc_id", toxicity.FOLDS) == toxicity.HELD_OUT).alias("held_out")
    return toxicity.score(docs.select("doc_id", held_out, "text"), model).drop("text")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), pieces_of(tokenizer_path("byte_bpe_50k.tiktoken")))


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language.fit(docs)
    held_out = (fold("doc_id", language.FOLDS) == language.HELD_OUT).alias("held_out")
    return language.identify(docs.select("doc_id", held_out, "text"), model).drop("text")


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digests(table(spark, sf_dir, "documents"), codec_of(tokenizer_path("byte_bpe_50k.json")))


def op7_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_main_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op8_nearest_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op10_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_digests(stored_media(table(spark, sf_dir, "documents")))


def op11_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op12_dominance(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rows_above(table(spark, sf_dir, "sales"), "sale_id", "sold_at", "total")
    return found.selectExpr("id AS sale_id", "slot", "level", "n_above AS n_sales", "rows_above AS n_rows")


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = tokenizers_of(tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))
    return composed(table(spark, sf_dir, "documents"), both)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc": op1_warc,
    "op2_ngram_join": op2_ngram_join,
    "op3_toxicity": op3_toxicity,
    "op4_token_counts": op4_token_counts,
    "op5_language": op5_language,
    "op6_bpe": op6_bpe,
    "op7_main_text": op7_main_text,
    "op8_nearest_codes": op8_nearest_codes,
    "op9_mixing": op9_mixing,
    "op10_media": op10_media,
    "op11_minhash": op11_minhash,
    "op12_dominance": op12_dominance,
    "op13_alignment": op13_alignment,
}

SQL: dict[str, str] = {
    "op1_warc": oracles.WARC,
    "op2_ngram_join": oracles.NGRAM_JOIN,
    "op8_nearest_codes": oracles.NEAREST,
    "op9_mixing": oracles.MIXING,
    "op11_minhash": oracles.NEAR_DUPLICATES,
    "op12_dominance": oracles.DOMINANCE,
}
