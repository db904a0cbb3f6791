"""Reading documents, pages and text files; writing results."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.functions.text import strip, words

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"
PAGES = "page_id long, url string, html string"
SUFFIXES = (".txt", ".tex", ".latex")


def load_corpus(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with a declared schema; blank and null texts are left out."""
    return spark.read.schema(DOCUMENTS).parquet(f"{folder}/documents.parquet").filter(F.trim("text") != "")


def load_text_files(spark: SparkSession, pattern: str) -> DataFrame:
    """(path, text) of text and LaTeX files; UTF-8, or Latin-1 where that fails."""
    files = spark.read.format("binaryFile").load(pattern).select("path", "content")
    wanted = F.lit(False)
    for suffix in SUFFIXES:
        wanted = wanted | F.lower("path").endswith(suffix)
    utf8 = F.expr("is_valid_utf8(cast(content as string))")
    return files.filter(wanted).select("path", F.when(utf8, F.decode("content", "UTF-8")).otherwise(F.decode("content", "ISO-8859-1")).alias("text"))


def page_text(html: Column, most: int = 3000) -> Column:
    """Text of a page without tags, cut to its first characters."""
    return F.substring(F.trim(F.regexp_replace(html, "<[^>]+>", " ")), 1, most)


def load_page_sources(spark: SparkSession, folder: str, least: int = 50) -> DataFrame:
    """(page_id, url, text) of pages with enough text to compare with."""
    pages = spark.read.schema(PAGES).parquet(f"{folder}/pages.parquet")
    return pages.select("page_id", "url", page_text(F.col("html")).alias("text")).filter(F.length("text") >= least)


def corpus_metadata(docs: DataFrame, visuals: DataFrame | None = None) -> DataFrame:
    """doc_id, n_words, n_tables, n_images, n_graphs, n_pages: 250 words or two visuals fill a page.

    ``visuals`` has (doc_id, kind) rows with kinds table, image and graph.
    """
    docs = docs.select("doc_id", F.size(words(strip(F.coalesce("text", F.lit(""))))).cast("long").alias("n_words"))
    kinds = ("table", "image", "graph")
    if visuals is None:
        docs = docs.select("*", *[F.lit(0).cast("long").alias(f"n_{k}s") for k in kinds])
    else:
        counts = visuals.groupBy("doc_id").agg(*[F.count_if(F.col("kind") == k).alias(f"n_{k}s") for k in kinds])
        docs = docs.join(counts, "doc_id", "left").na.fill(0, [f"n_{k}s" for k in kinds])
    seen = sum((F.col(f"n_{k}s") for k in kinds), F.lit(0))
    return docs.withColumn("n_pages", (F.ceil(F.col("n_words") / 250) + F.ceil(seen * 0.5)).cast("long"))


def write_results(df: DataFrame, path: str, kind: str = "parquet", by: list[str] | None = None, mode: str = "append") -> None:
    """Append results as Parquet or JSON lines, in folders by the given columns."""
    df.write.mode(mode).partitionBy(*(by or [])).format(kind).save(path)


def shared_folder(spark: SparkSession) -> str:
    """A new folder in the one that all executors share (``spark.checkpoint.dir``). Only local executors may do without."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='spark-')}"
    return f"{base.rstrip('/')}/vellum-{spark.range(1).select(F.expr('uuid()')).first()[0]}"


def written_once(df: DataFrame) -> DataFrame:
    """A table that several steps read: written to the shared folder and read again, so that it is made once."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
