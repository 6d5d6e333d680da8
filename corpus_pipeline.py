"""From raw documents to token files: five stages over the training-data operators.

Each stage takes all that the one before it kept and, but for the last, returns the columns of
documents. Null ids, null and empty texts, repeated rows, ties and empty tables have the results that
the operators' docstrings state: texts without letters go in the first stage, repeated rows in the
second, test passages are cut in the third, documents are replicated in the fourth, and the fifth
returns a row for each document that it wrote and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postings_engine.llm.common import Scratch, table
from postings_engine.llm.decontaminate import decontaminate
from postings_engine.llm.language_id import keep_recognised
from postings_engine.llm.mixing import mix_sources
from postings_engine.llm.ngram_join import one_of_each_group
from postings_engine.llm.queries import labelled_documents, tokenizer_path
from postings_engine.llm.token_output import token_output

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised."""
    docs = docs.select(*COLUMNS)
    return keep_recognised(docs, labelled_documents(docs))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity 0.8 or more."""
    return one_of_each_group(docs.select(*COLUMNS), width=5, num=4, den=5)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ten-word passages of test items are cut out; documents go of which they are more than half."""
    left = decontaminate(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"), window=10, most_coverage=0.5)
    return left.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.coalesce(F.length("text"), F.lit(0)).cast("long")))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources weigh as the square root of their bytes; copies are shuffled globally."""
    return mix_sources(docs.select(*COLUMNS)).select(*COLUMNS)


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in ORC files, read back: doc_id, start, n_tokens, ids_crc32."""
    return token_output(docs, tokenizer_path(), end_id=0)


STAGES = [("language ID", language), ("n-gram Jaccard join", near_copies), ("benchmark decontamination", benchmark_passages),
          ("mixing sources", mixture), ("token output", token_files)]
#: SQL cannot tokenize or follow components; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch, docs = Scratch(spark, "pipeline"), table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = scratch.save(docs, f"stage{k + 1}")
    return docs
