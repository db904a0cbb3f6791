"""The training-data pipeline: language ID, near-dedup, decontamination, secret scan, BPE encoding.

Each stage takes (spark, docs, sf_dir) and works on all documents that the stage before kept; what it
decides takes effect on its result. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.llm import bpe, decontamination, language_id, near_dup, secret_scan
from vellum.llm.common import scratch_path
from vellum.llm.queries import tokenizer_path

LEAST_SCORE = 0.5
SHINGLE = 5


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, null texts and those whose best language isn't likelier than all others together go."""
    found = language_id.learn_and_predict(docs)
    return found.filter((F.col("lang_pred") != language_id.NONE) & (F.col("score") >= LEAST_SCORE)).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, similarity 0.8) the document of smallest doc_id, then text hash, stays, once.

    A null doc_id is the smallest. Rows that share a doc_id, or have none, but aren't near copies all stay.
    """
    key, mark = near_dup.row_id()
    kept = near_dup.one_of_each(docs, SHINGLE).withColumnsRenamed({"key": "_key", "mark": "_mark"})
    rows = docs.select(key.alias("_key"), mark.alias("_mark"), F.struct(*docs.columns).alias("_row")).join(kept, ["_key", "_mark"], "left_semi")
    return rows.groupBy("_key", "_mark").agg(F.min("_row").alias("_row")).select("_row.*")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of whose words one in twenty is inside passages of the benchmark go."""
    found = decontamination.find_passages(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.filter(~decontamination.contaminated()).select(*docs.columns)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets inside texts are replaced by a mark; all documents stay."""
    found = secret_scan.redact(secret_scan.find_secrets(docs)).withColumn("n_chars", F.length("text").cast("long"))
    return found.select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The columns of documents with n_tokens and ids (little-endian unsigned 32-bit)."""
    return bpe.encode_documents(docs, tokenizer_path())


STAGES = [
    ("language_id", identify_language),
    ("near_dup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secret_scan", redact_secrets),
    ("bpe", encode),
]

#: No SQL: languages are learnt and ids come from a tokenizer; tests/llm hold the result against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
