"""Registered queries of the corpus operators and the SQL they are checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barweave.llm import chat, decontaminate, hilbert, jaccard, langid, mixing, pieces, quality, spelling, token_ids, toxicity, warc, whitening

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_file(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents that link at a shingle Jaccard similarity of 0.75."""
    return jaccard.jaccard_components(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


ORACLE["op7_ngram_jaccard_join"] = jaccard.SQL


@query
def op9_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place, length and checksum of the token ids of every document, read back from the written shards."""
    return token_ids.token_id_report(table(spark, sf_dir, "documents"), tokenizer_file())


@query
def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, with the window that is most like it."""
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from those that are not held out."""
    return langid.fold_prediction(table(spark, sf_dir, "documents")).select("doc_id", "held_out", "lang_pred", "score")


@query
def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document, learned from the labels that are not held out."""
    return toxicity.fold_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op4_adaptive_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts of every document and whether it is kept by the thresholds of its language and source."""
    return quality.judged(table(spark, sf_dir, "documents"))


ORACLE["op4_adaptive_quality"] = quality.sql()


@query
def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document, and the target of its source."""
    return mixing.mixed(table(spark, sf_dir, "documents"))


ORACLE["op2_mixing"] = mixing.SQL


@query
def op3_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and place of every document along the curve over language, source and size."""
    return hilbert.sharded(table(spark, sf_dir, "documents"))


@query
def op10_chat_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The conversations that no longer one begins with, rendered."""
    return chat.rendered(table(spark, sf_dir, "conversations"))


ORACLE["op10_chat_collapse"] = chat.SQL


@query
def op1_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata and plain-text conversion records of every page."""
    return warc.derivatives(warc.responses(table(spark, sf_dir, "pages")))


@query
def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place of every vector on each of the 32 leading components, whitened."""
    return whitening.components(table(spark, sf_dir, "embeddings"))


@query
def op12_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number and checksum of the SentencePiece ids of every document, and checksum of the text they read as."""
    made = pieces.encoded(table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"))
    named = F.array_join(F.col("ids").cast("array<string>"), ",")
    return made.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(named, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@query
def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that differ from a much more frequent one by one character, with the form that they vary."""
    return spelling.variants(table(spark, sf_dir, "documents"))
