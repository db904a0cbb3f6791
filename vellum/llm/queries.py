"""The registered queries of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from vellum.llm import bpe, chat, decontamination, fingerprints, language_id, mixing, near_dup, periodic_runs, secret_scan, suffix_dedup, token_store, url_templates, whitening


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of each document that a smaller document has in 50-byte strings, removed."""
    return suffix_dedup.report(table(spark, sf_dir, "documents"))


def op2_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of near copies on two-word shingles."""
    return near_dup.report(table(spark, sf_dir, "documents"))


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of each document and of its edited text, with their likeness."""
    return fingerprints.report(table(spark, sf_dir, "documents"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of each document, learnt from those that aren't held out."""
    return language_id.report(table(spark, sf_dir, "documents"))


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of each conversation, read back from its windows."""
    return chat.report(table(spark, sf_dir, "conversations"), tokenizer_path())


def op6_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of each document, read back from the token files."""
    return token_store.report(table(spark, sf_dir, "documents"), tokenizer_path())


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of each document's ids and of their decoded text."""
    return bpe.digests(table(spark, sf_dir, "documents"), tokenizer_path())


def op8_url_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on each page's url."""
    return url_templates.report(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of each document inside passages of the benchmark."""
    return decontamination.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in each document."""
    return secret_scan.report(table(spark, sf_dir, "documents"))


def op11_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of each document in a mix of sources by weight."""
    return mixing.report(table(spark, sf_dir, "documents"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whitened coordinates of each embedding."""
    return whitening.report(table(spark, sf_dir, "embeddings"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of words of each document."""
    return periodic_runs.report(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Each query by name."""
    found = (op1_suffix_dedup, op2_near_dup, op3_fingerprints, op4_language_id, op5_chat, op6_token_store, op7_bpe, op8_url_templates, op9_decontamination, op10_secret_scan)
    return {f.__name__: f for f in (*found, op11_mixing, op12_whitening, op13_periodic_runs)}


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL of those that SQL can express on whole tables."""
    from vellum.llm import oracles

    return oracles.SQL
