"""A corpus pipeline of five of the operators in codeatlas.llm: documents in, token files out.

Every stage works on all rows that its predecessor kept. Between stages the documents are written as Parquet to the shared folder
and read again, so a lost executor repeats part of one stage and plans stay short.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from codeatlas.llm import decontam, mixing, ngram_join, quality, tokens
from codeatlas.llm._common import new_path
from codeatlas.session import scratch


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that policy v1 of the rule ledger rejects go: short ones, so null and empty texts too, and those of repeats and symbols. Repeated rows go or stay together."""
    return quality.passing(docs, quality.POLICIES["v1"])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by five-word shingles at a Jaccard similarity of 0.8, one of each component stays, that of the smallest doc_id. Texts without words are linked with none and
    stay; rows without a doc_id are compared and come last; of repeated rows one stays."""
    return ngram_join.one_of_each(docs, percent=80, n=5)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold ten consecutive words of a benchmark item, or a whole shorter item, go. Texts without words hold none and stay."""
    return decontam.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated or left out until sources have their target shares of words; a copy is a row. A null source is one of its own. A text without words counts nothing for its source and is
    taken or left by its source's rate; equal rows are taken alike. Columns stay, whatever they are called."""
    return mixing.repeated(docs)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of all rows, in order of doc_id, rows without one first; returned is what reading them back gives. A text without words is at least its end id."""
    return tokens.tokenize(spark, docs, new_path(spark, "pipeline-tokens"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("benchmark_decontamination", benchmark_decontamination),
    ("mix_sources", mix_sources),
    ("token_output", token_output),
]

#: SQL has no byte-level tokenizer and no entropy balancing; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir. Null, empty, very long and repeated texts and further columns are what each stage says; without documents the result is empty. What a stage wrote
    for itself is removed once its result is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = new_path(spark, name)
        with scratch():
            kept = stage(spark, docs, sf_dir)
            kept.write.parquet(path)
        docs = spark.read.schema(kept.schema).parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
