"""The thirteen operators as queries over whole tables, and the SQL they must equal where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .centroids import cluster, with_inertia
from .common import table
from .decontaminate import contamination
from .embedding_dedup import near_duplicates
from .language_id import language_id
from .line_dedup import line_components
from .merkle import verified_manifest
from .mixing import mix_sources
from .ngram_join import jaccard_components
from .oracle import ORACLE
from .sharding import shard
from .skip_chain import personal_data
from .token_output import token_output
from .url_filter import judge, rule_list
from .warc import archive

URL_RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]
SHARDS = 40


def tokenizer_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


def labelled_documents(docs: DataFrame) -> DataFrame:
    """What the language model may learn from: every document but the held-out ones."""
    return docs.where(~held_out(F.col("doc_id"))).select("lang", "text", F.xxhash64("doc_id").alias("pick"))


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose sets of 4-word shingles have a Jaccard similarity of 0.85."""
    return jaccard_components(table(spark, sf_dir, "documents"), width=4, num=85, den=100)


def op2_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as token ids in ORC files, read back."""
    return token_output(table(spark, sf_dir, "documents"), tokenizer_path(), end_id=0)


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each document its lines, those that another line stands for, and the documents of these."""
    docs = table(spark, sf_dir, "documents")
    lines, kept = line_components(docs)
    placed = lines.select("doc_id", "line", "d1", "d2").join(kept.select("d1", "d2", F.col("doc_id").alias("kept_doc"), F.col("line").alias("kept_line")), ["d1", "d2"], "left")
    lost = F.when(F.col("kept_doc").isNotNull() & ((F.col("kept_doc") != F.col("doc_id")) | (F.col("kept_line") != F.col("line"))), F.struct("line", "kept_doc"))
    found = placed.groupBy("doc_id").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(lost)).alias("lost"))
    empty = F.array().cast("array<struct<line:int,kept_doc:bigint>>")
    rows = docs.select("doc_id").join(found, "doc_id", "left").withColumn("lost", F.coalesce("lost", empty))
    return rows.select("doc_id", F.coalesce("n", F.lit(0)).alias("n_lines"), F.size("lost").alias("n_dropped"), F.col("lost.line").alias("dropped_lines"), F.col("lost.kept_doc").alias("kept_doc_ids"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 shards of near equal bytes, equal texts together."""
    placed = shard(table(spark, sf_dir, "documents"), SHARDS)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents replicated so that sources weigh as the square root of their bytes."""
    docs = table(spark, sf_dir, "documents").withColumn("text_md5", F.md5(F.coalesce("text", F.lit("")).cast("binary")))
    return mix_sources(docs).select("doc_id", "source", "copy", "n_copies", F.round("rate", 9).alias("rate"), "shuffle_key", "text_md5")


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every page's URL."""
    return judge(table(spark, sf_dir, "pages"), rule_list(spark, URL_RULES))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages as WARC records in seekable bundles, read back."""
    return archive(spark, table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of embeddings with a cosine of 0.9 or more."""
    return near_duplicates(table(spark, sf_dir, "embeddings"), 0.9)


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of every document that 10-word windows of the test items hit."""
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), 10)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document."""
    docs = table(spark, sf_dir, "documents")
    found = language_id(docs, labelled_documents(docs))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "bits_per_byte")


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cluster of every vector of 64 components, after five rounds from 40 centroids."""
    rows, centroids = cluster(table(spark, sf_dir, "embeddings"), k=40, dims=64, rounds=5, scale=256.0, seed=2)
    return with_inertia(spark, rows, centroids)


def op12_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The personal data in every document: numbers and digest of the base spans, and all spans."""
    return personal_data(table(spark, sf_dir, "documents"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's proof in a manifest by source, against texts of which a half lost their line ends."""
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    return verified_manifest(table(spark, sf_dir, "documents"), F.replace(F.col("text"), F.lit("\n"), F.lit("")), tampered)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {q.__name__: q for q in (
    op1_ngram_join, op2_token_output, op3_line_dedup, op4_sharding, op5_mix_sources, op6_url_filter, op7_warc, op8_embedding_dedup,
    op9_decontaminate, op10_language_id, op11_centroid_clustering, op12_personal_data,
    op13_merkle_manifest)}

__all__ = ["ORACLE", "QUERIES"]
