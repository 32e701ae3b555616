"""The stages that turn raw documents into token ids; each stage works on what the one before it kept.

A stage is (name, function); a function takes (spark, docs, folder) and returns a DataFrame, which is written as Parquet and
read again as the next one's ``docs``. All but the last return the columns of documents:

1. quality: texts that fail the base rules or stray from their language's reference go.
2. near_duplicates: of each group (five-word shingles, similarity 0.8 or more) the document with the smallest doc_id stays.
3. secrets: every secret in a text is replaced by a mark with its kind.
4. mixing: sources are taken up to their target weights, repeated where the plan says so; texts without words go.
5. encoding: token ids, their number and digests of the ids and of the bytes decoded from them.

Nulls, empty texts, repeated rows and empty tables are handled as the operators state. No SQL: neither the quality
reference nor the seeded mix can be written in it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidegauge.llm import bpe, minhash, mixing, quality, secret_scan
from tidegauge.llm.common import table
from tidegauge.llm.registry import importable, query
from tidegauge.session import durable

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_rules(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    importable(spark)
    return quality.keep(docs.select(*COLUMNS))


def near_duplicates(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    importable(spark)
    return minhash.deduplicate(docs.select(*COLUMNS), width=5, percent=80)


def secrets(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    importable(spark)
    return secret_scan.redact(docs.select(*COLUMNS))


def mix_sources(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    importable(spark)
    return mixing.take(docs.select(*COLUMNS))


def encoding(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    importable(spark)
    return bpe.encode_decode(docs, ("ids", "n_tokens", "ids_sha256", "decoded_sha256"))


STAGES = [
    ("quality", quality_rules),
    ("near_duplicates", near_duplicates),
    ("secrets", secrets),
    ("mixing", mix_sources),
    ("encoding", encoding),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


@query("pipeline", ORACLE_SQL)
def pipeline(spark, folder):
    return run(spark, folder)
