"""Signs of machine-written text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.functions.lexicons import AI_LABELS, FILLERS, TOO_SHORT
from vellum.functions.text import banded, strip, words
from vellum.operators.segment import sentences
from vellum.operators.terms import with_term_count


def _lengths(text: Column) -> Column:
    """Words of each sentence that has at least four."""
    return F.filter(F.transform(sentences(text, "punct"), lambda s: F.size(words(s))), lambda n: n >= 4)


def _deviation(n: Column) -> Column:
    """Standard deviation by Welford's one pass, as SQL has it to the last bit: where it is the mean's equal, that bit decides a band of scores."""
    zero = F.struct(F.lit(0.0).alias("k"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("squares"))

    def step(acc: Column, x: Column) -> Column:
        k = acc["k"] + 1.0
        mean = acc["mean"] + (x - acc["mean"]) / k
        return F.struct(k.alias("k"), mean.alias("mean"), (acc["squares"] + (x - mean) * (x - acc["mean"])).alias("squares"))

    return F.aggregate(n, zero, step, lambda acc: F.sqrt(F.try_divide(acc["squares"], acc["k"])))


def style_features(docs: DataFrame, fillers: DataFrame | list[str] = FILLERS) -> DataFrame:
    """doc_id, n_sentences, mean_len, std_len, burstiness, cv, filler_hits, filler_density, diversity; the four of sentence length are null below four sentences.

    All from one pass over each text, without an exchange. ``fillers`` is a list of phrases, or a table (term) of any size.
    """
    text = F.coalesce("text", F.lit(""))
    base = docs.select("doc_id", text.alias("text"), _lengths(text).alias("n"), F.filter(F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)), lambda w: w.rlike("^[a-z]+$")).alias("w"))
    count = F.size("n")
    enough = F.col("n_sentences") >= 4
    base = base.select("doc_id", "text", "w", count.alias("n_sentences"), F.try_divide(F.aggregate("n", F.lit(0.0), lambda acc, x: acc + x), count).alias("mean"), _deviation(F.col("n")).alias("std"))
    base = with_term_count(base, F.col("text"), fillers, "filler_hits")
    return base.select(
        "doc_id", "text", "n_sentences",
        F.when(enough, F.col("mean")).alias("mean_len"), F.when(enough, F.col("std")).alias("std_len"),
        F.when(enough, (F.col("std") - F.col("mean")) / (F.col("std") + F.col("mean") + 1e-9)).alias("burstiness"), F.when(enough, F.col("std") / (F.col("mean") + 1e-9)).alias("cv"),
        "filler_hits", (F.col("filler_hits") / (F.col("n_sentences") + 1)).alias("filler_density"),
        F.when(F.size("w") > 0, F.size(F.array_distinct("w")) / (F.size("w") + 1e-9)).otherwise(0.0).alias("diversity"),
    )


def ai_scores(docs: DataFrame, fillers: DataFrame | list[str] = FILLERS) -> DataFrame:
    """doc_id, score (0 to 100, one digit), label; texts under 80 characters have no score."""
    f = style_features(docs, fillers)
    b, cv, m, d = (F.col(c) for c in ("burstiness", "cv", "mean_len", "filler_density"))
    points = (
        F.lit(50.0)
        + F.when(b.isNull(), 0).when(b < -0.4, 35).when(b < -0.2, 25).when(b < 0.0, 12).when(b < 0.2, -5).when(b < 0.4, -15).otherwise(-25)
        + F.when(cv.isNull(), 0).when(cv < 0.25, 20).when(cv < 0.40, 10).when(cv < 0.55, 0).when(cv < 0.70, -10).otherwise(-18)
        + F.when(m.isNull(), 0).when((m >= 14) & (m <= 26), 10).when((m >= 10) & (m < 14), 3).when(m < 10, -10).otherwise(-5)
        + F.when(d > 0.4, 15).when(d > 0.2, 8).when(d > 0.1, 3).otherwise(0)
    )
    long = F.length(strip(F.col("text"))) >= 80
    score = F.when(long, F.round(F.greatest(F.lit(0.0), F.least(F.lit(100.0), points)), 1))
    return f.select("doc_id", score.alias("score")).withColumn("label", F.when(F.col("score").isNull(), TOO_SHORT).otherwise(banded(F.col("score"), AI_LABELS)))


def ai_score_rollup(docs: DataFrame, by: str = "source") -> DataFrame:
    """by, n_docs, n_scored, mean_score and a count for each band of scores."""
    scores = ai_scores(docs).join(docs.select("doc_id", by), "doc_id")
    s = F.col("score")
    return scores.groupBy(by).agg(
        F.count(F.lit(1)).alias("n_docs"), F.count("score").alias("n_scored"), (F.floor(F.avg("score") * 100 + 0.5) / 100).alias("mean_score"), F.count_if(s >= 75).alias("n_likely_ai"),
        F.count_if((s >= 55) & (s < 75)).alias("n_possibly_ai"), F.count_if((s >= 40) & (s < 55)).alias("n_uncertain"), F.count_if(s < 40).alias("n_human"),
    )
