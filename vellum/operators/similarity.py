"""Similarity of chunks, sentences, documents and vectors; duplicates."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.functions.shipping import ship
from vellum.functions.text import WORD, overlap_confidence, ranked, strip
from vellum.operators.postings import WORDS_HELD, most_shared, row_squares, shared_squares, weighted_matches
from vellum.operators.segment import sentence_chunks
from vellum.operators.shingles import LEADS, PART_EACH, SETS, SHINGLES_HELD, UNIT_SETS, counted_documents, distinct_shingles, leading_shingles, near_members, pairs_of_units, units_of
from vellum.operators.vectors import class_matches, classed
from vellum.sources.corpus import written_once

THRESHOLD = 0.75
#: Rows of a document id (and its units) that are broadcast at most.
ROWS_BROADCAST = 1 << 20
#: More than rounding to four digits can add to a similarity.
ROUNDING = 1e-4


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def tfidf_vectors(units: DataFrame, keys: list[str]) -> DataFrame:
    """keys, token, weight: term counts times ln((1 + units) / (1 + units with the token)) + 1, of length 1.

    ``units`` has the key columns and text. The vectors are rows; nothing is gathered.
    """
    counts = units.select(*keys, F.explode(tokens(F.col("text"))).alias("token")).groupBy(*keys, "token").agg(F.count(F.lit(1)).alias("tf"))
    n = units.count()
    found = counts.groupBy("token").agg((F.log((1.0 + n) / (1.0 + F.count(F.lit(1)))) + 1).alias("idf"))
    weights = counts.join(found, "token").select(*keys, "token", (F.col("tf") * F.col("idf")).alias("w"))
    norms = weights.groupBy(*keys).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return weights.join(norms, keys).select(*keys, "token", (F.col("w") / F.col("norm")).alias("weight"))


def chunk_matches(chunks: DataFrame, sources: DataFrame, threshold: float | None = THRESHOLD, fitted: DataFrame | None = None) -> DataFrame:
    """doc_id, chunk_idx, source, similarity (4 digits), percent of pairs that reach the threshold.

    Texts are cut to tokens once; tokens aren't exchanged, but for their frequencies, which are counted before the exchange. Chunks
    stream past blocks of sources and are multiplied with them in tasks. A source's tokens are ordered from the rarest on: if a
    chunk reaches the threshold with it, the first token that both have begins, in the source, a rest whose norm reaches it too (the product
    of two rests bounds what they share from there on). Chunks without such a leading token of a source aren't multiplied. Tasks
    hold the frequencies of the most frequent tokens alone; others have at least the weight of the last of these, which bounds
    a chunk's length, and chunks that can reach the threshold get their exact length. A threshold of 0 or None means
    the default. Weights are fitted on chunks and sources, or on the table ``fitted`` (text), so that they don't depend on which
    chunks come together.
    """
    threshold = threshold or THRESHOLD
    none = F.lit(None).cast("long")
    hashed = lambda text: F.coalesce(F.transform(tokens(F.col(text)), lambda w: F.xxhash64(w)), F.array().cast("array<long>"))
    units = chunks.select(F.col("doc_id").cast("long").alias("a"), F.col("chunk_idx").cast("long").alias("b"), none.alias("s"), hashed("chunk").alias("words")).unionByName(
        sources.select(none.alias("a"), none.alias("b"), F.col("source_id").cast("long").alias("s"), hashed("text").alias("words"))
    )
    units = written_once(units)
    n_units = units.count()
    if units.groupBy("a", "b", "s").count().filter("count > 1").head(1):  # rows of one key are one unit
        units = written_once(units.groupBy("a", "b", "s").agg(F.flatten(F.collect_list("words")).alias("words")))
    n, fit = (n_units, units) if fitted is None else (fitted.count(), fitted.select(hashed("text").alias("words")))
    df = written_once(fit.select(F.explode(F.array_distinct("words")).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("df")))
    idf = F.log((1.0 + n) / (1.0 + F.coalesce("df", F.lit(0)))) + 1
    held = df.orderBy(F.desc("df"), "word").limit(WORDS_HELD).select("word", "df", idf.alias("idf")).collect()
    floor = held[-1].idf if len(held) == WORDS_HELD else math.log(1.0 + n) + 1

    counts = units.filter("s is not null").select(F.col("s").alias("source"), F.explode("words").alias("word")).groupBy("source", "word").agg(F.count(F.lit(1)).alias("tf"))
    weights = counts.join(df, "word", "left").withColumn("idf", idf).withColumn("w", F.col("tf") * F.col("idf"))
    unit = Window.partitionBy("source")
    squares = lambda w: F.sum(F.col("w") * F.col("w")).over(w)
    rest = squares(unit.orderBy(F.desc("idf"), "word").rowsBetween(0, Window.unboundedFollowing))
    weights = written_once(weights.select("source", "word", (F.col("w") * F.col("idf") / F.sqrt(squares(unit))).alias("weight"), (F.sqrt(rest / squares(unit)) >= threshold - ROUNDING).alias("leads")))
    found = weighted_matches(units.filter("a is not null and b is not null").select("a", "b", "words"), weights, [(r.word, r.idf) for r in held], floor, threshold, ["a", "b"], n_units)
    found = written_once(found)
    others = found.filter(F.size("rest") > 0).groupBy("a", "b").agg(F.first("rest").alias("rest")).select("a", "b", F.explode("rest").alias("r"))
    others = others.select("a", "b", F.col("r.word").alias("word"), F.col("r.n").alias("tf")).join(df, "word", "left").groupBy("a", "b").agg(F.sum(F.pow(F.col("tf") * idf, F.lit(2.0))).alias("more"))
    exact = F.col("dot") / F.sqrt(F.col("square") + F.coalesce("more", F.lit(0.0)))
    near = found.select("a", "b", "source", "dot", "square").join(others, ["a", "b"], "left").withColumn("similarity", F.round(exact, 4)).filter(F.col("similarity") >= threshold)
    return near.select(F.col("a").alias("doc_id"), F.col("b").alias("chunk_idx"), "source", "similarity", F.round(F.col("similarity") * 100, 2).alias("percent"))


def match_chunks(chunks: DataFrame, sources: DataFrame, threshold: float | None = THRESHOLD, fitted: DataFrame | None = None) -> DataFrame:
    """``chunk_matches`` and a preview of the chunk."""
    shown = F.when(F.length("chunk") > 100, F.concat(F.substring("chunk", 1, 100), F.lit("..."))).otherwise(F.col("chunk"))
    near = written_once(chunk_matches(chunks, sources, threshold, fitted))
    return near.join(chunks.select("doc_id", F.col("chunk_idx").cast("long").alias("chunk_idx"), shown.alias("preview")), ["doc_id", "chunk_idx"])


def match_chunk_vectors(chunks: DataFrame, sources: DataFrame, chunk_vectors: DataFrame, source_vectors: DataFrame, threshold: float | None = THRESHOLD) -> DataFrame:
    """``match_chunks`` with vectors of one's own: pairs of which both have one are compared by it, all others by TF-IDF.

    ``chunk_vectors`` has (doc_id, chunk_idx, embedding), ``source_vectors`` (source_id, embedding), at most one for each; a
    null vector is none. Vectors aren't exchanged with their chunks: equal ones are compared once.
    """
    threshold = threshold or THRESHOLD
    key = ["doc_id", "chunk_idx"]
    known, vectors = classed(chunk_vectors.filter("embedding is not null").select("doc_id", F.col("chunk_idx").cast("long").alias("chunk_idx"), "embedding"))
    mine = written_once(chunks.select("doc_id", F.col("chunk_idx").cast("long").alias("chunk_idx")).join(known, key))
    theirs, source_classes = classed(source_vectors.filter("embedding is not null").select(F.col("source_id").cast("long").alias("source"), "embedding"))
    theirs = written_once(theirs.join(sources.select(F.col("source_id").cast("long").alias("source")), "source", "left_semi"))
    shown = F.when(F.length("chunk") > 100, F.concat(F.substring("chunk", 1, 100), F.lit("..."))).otherwise(F.col("chunk"))
    previews = chunks.select("doc_id", F.col("chunk_idx").cast("long").alias("chunk_idx"), shown.alias("preview"))
    dense = class_matches((mine, vectors), (theirs, source_classes), threshold).withColumn("percent", F.round(F.col("similarity") * 100, 2)).join(previews, key)
    sparse = match_chunks(chunks, sources, threshold).join(mine.select(*key, F.lit(True).alias("_m")), key, "left").join(theirs.select("source", F.lit(True).alias("_t")), "source", "left")
    columns = [*key, "source", "similarity", "percent", "preview"]
    return dense.select(*columns).unionByName(sparse.filter("_m is null or _t is null").select(*columns))


def _mean(x: Column) -> Column:
    """Mean of values of four digits, to four digits; summed as integers, so that it doesn't depend on the order."""
    return F.floor(F.try_divide(F.sum(F.round(x * 10_000).cast("long")), F.count(x)) + 0.5) / 10_000


def plagiarism_level(score: Column, threshold: float = THRESHOLD) -> Column:
    return F.when(score >= 0.9, "Critical").when(score >= 0.8, "High").when(score >= 0.7, "Medium").when(score >= threshold, "Low").otherwise("None")


def plagiarism_report(chunks: DataFrame, matches: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """A row for each document with chunks: score (mean over its matches, 0 without), level, counts, least and largest similarity."""
    totals = chunks.groupBy("doc_id").agg(F.count(F.lit(1)).alias("total_chunks"))
    found = matches.groupBy("doc_id").agg(
        _mean(F.col("similarity")).alias("score"), F.count(F.lit(1)).alias("n_matches"), F.countDistinct("source").alias("n_sources"),
        F.countDistinct("chunk_idx").alias("chunks_with_matches"), F.max("similarity").alias("max_similarity"), F.min("similarity").alias("min_similarity"),
    )
    out = totals.join(found, "doc_id", "left").na.fill(0)
    return out.withColumn("level", plagiarism_level(F.col("score"), threshold))


def batch_check(docs: DataFrame, sources: DataFrame, threshold: float = THRESHOLD, fitted: DataFrame | None = None) -> DataFrame:
    """The whole corpus against a table of sources (source_id, text): two-sentence chunks, matches, report."""
    chunks = sentence_chunks(docs.filter(F.trim("text") != ""), 2)
    return plagiarism_report(chunks, chunk_matches(chunks, sources, threshold, fitted), threshold)


def similar_sentences(a: DataFrame, b: DataFrame, threshold: float = 0.7) -> DataFrame:
    """doc_id, sent_idx, source, similarity, preview of single sentences against source sentences."""
    found = match_chunks(sentence_chunks(a, 1), b, threshold)
    return found.select("doc_id", F.col("chunk_idx").alias("sent_idx"), "source", "similarity", F.substring("preview", 1, 80).alias("preview"))


def pair_tfidf(pairs: DataFrame) -> DataFrame:
    """a_id, b_id, score: cosine of TF-IDF fitted on the two texts of each pair alone, times 100.

    ``pairs`` has (a_id, a_text, b_id, b_text). With two texts the idf is 1 for shared tokens and
    ln(3/2) + 1 for others, so a pair needs sums over its own tokens alone, which are counted in its row: tokens aren't
    exchanged. A pair in which neither text has a token has no row.
    """
    hashed = lambda text: F.coalesce(F.transform(tokens(F.col(text)), lambda w: F.xxhash64(w)), F.array().cast("array<long>"))
    rows = pairs.select("a_id", "b_id", hashed("a_text").alias("a"), hashed("b_text").alias("b"))
    if pairs.groupBy("a_id", "b_id").count().filter("count > 1").head(1):  # rows of one pair are one
        rows = rows.groupBy("a_id", "b_id").agg(*[F.flatten(F.collect_list(c)).alias(c) for c in ("a", "b")])
    sums = row_squares(rows, ["a_id", "b_id"])
    alone = F.pow(F.log(F.lit(1.5)) + 1, F.lit(2.0))
    na, nb = (F.sqrt(F.col(part) + alone * (F.col(whole) - F.col(part))) for whole, part in (("na", "sa"), ("nb", "sb")))
    return sums.filter("na + nb > 0").select("a_id", "b_id", F.when((F.col("na") > 0) & (F.col("nb") > 0), F.round(F.col("dot") / (na * nb) * 100, 2)).otherwise(0.0).alias("score"))


def combined_similarity(lexical: DataFrame, semantic: DataFrame) -> DataFrame:
    """a_id, best: the largest over b of the mean of both scores; a missing or zero semantic score counts as the lexical one."""
    joined = lexical.select("a_id", "b_id", F.col("score").alias("lex")).join(semantic.select("a_id", "b_id", F.col("score").alias("sem")), ["a_id", "b_id"], "left")
    overall = (F.col("lex") + F.coalesce(F.nullif(F.col("sem"), F.lit(0.0)), F.col("lex"))) / 2
    return joined.groupBy("a_id").agg((F.floor(F.max(overall) * 100 + 0.5) / 100).alias("best"))


#: Chunks of a document that candidate pages are sought for.
FIRST_CHUNKS = 8


def candidate_pages(chunks: DataFrame, pages: DataFrame, first_chunks: int = FIRST_CHUNKS, query_tokens: int = 12, k: int = 3) -> DataFrame:
    """doc_id, chunk_idx, page_id, hits, place: the k pages that have most of the first tokens of each of a document's first
    chunks; of equal ones the smaller page_id. Counts are exact, whatever the tokens' frequency."""
    few = chunks.filter(F.col("chunk_idx") < first_chunks).select("doc_id", "chunk_idx", F.slice(tokens(F.col("chunk")), 1, query_tokens).alias("words"))
    return most_shared(few, pages.select("page_id", tokens(F.col("text")).alias("words")), ["doc_id", "chunk_idx"], k)


def page_scores(chunks: DataFrame, pages: DataFrame) -> DataFrame:
    """doc_id, chunk_idx, page_id, text (the chunk), similarity of each chunk and its candidate pages: cosine of TF-IDF fitted on the two texts.

    With two texts the idf of shared tokens is 1 and that of others a constant, so a pair needs sums over its shared tokens and
    over each text alone. They are counted where a chunk's text meets its page: tokens aren't exchanged.
    """
    unit = ["doc_id", "chunk_idx"]
    candidates = written_once(candidate_pages(chunks, pages).select(*unit, "page_id"))
    texts = chunks.filter(F.col("chunk_idx") < FIRST_CHUNKS).select(*unit, F.col("chunk").alias("text"))  # others have no candidates
    sums = shared_squares(texts, candidates, pages.select(F.col("page_id").cast("long").alias("page_id"), "text"), unit, tokens)
    alone = F.pow(F.log(F.lit(1.5)) + 1, F.lit(2.0))
    length = lambda whole, part: F.sqrt(F.col(part) + alone * (F.col(whole) - F.col(part)))
    score = F.round(F.col("dot") / (length("na", "sa") * length("nb", "sb")) * 100, 2) / 100
    return sums.select(*unit, "page_id", "text", score.alias("similarity"))


def web_matches(chunks: DataFrame, pages: DataFrame, threshold: float = 0.72) -> DataFrame:
    """doc_id, chunk_idx, page_id, url, similarity, percent, preview (150 characters of the chunk) of pairs that reach the threshold."""
    shown = F.concat(F.substring("text", 1, 150), F.when(F.length("text") > 150, "...").otherwise(""))
    hits = page_scores(chunks, pages).filter(F.col("similarity") >= threshold).withColumn("preview", shown).drop("text")
    hits = hits.join(pages.select("page_id", "url"), "page_id")
    return hits.select("doc_id", "chunk_idx", "page_id", "url", "similarity", F.round(F.col("similarity") * 100, 2).alias("percent"), "preview")


def web_report(chunks: DataFrame, pages: DataFrame, threshold: float = 0.72) -> DataFrame:
    """doc_id, score, n_matches, pages_checked, chunks_checked, n_sources against each chunk's candidate pages."""
    hit = F.col("similarity") >= threshold
    return page_scores(chunks, pages).groupBy("doc_id").agg(
        F.coalesce(_mean(F.when(hit, F.col("similarity"))), F.lit(0.0)).alias("score"), F.count_if(hit).alias("n_matches"), F.countDistinct("page_id").alias("pages_checked"),
        F.countDistinct("chunk_idx").alias("chunks_checked"), F.countDistinct(F.when(hit, F.col("page_id"))).alias("n_sources"),
    )


def normal_key(text: Column) -> Column:
    return F.lower(strip(F.regexp_replace(text, r"\s+", " ")))


def exact_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, first_id, group_size, kept: documents of one text but for case and white space, of which the first stays.

    Groups are counted before the exchange, so a group with a third of all rows is a few rows.
    """
    rows = docs.select("doc_id", F.sha2(normal_key(F.col("text")), 256).alias("k"))
    groups = rows.groupBy("k").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("group_size"))
    return rows.join(groups, "k").select("doc_id", "first_id", "group_size", (F.col("doc_id") == F.col("first_id")).alias("kept"))


def shingle_candidates(docs: DataFrame, width: int = 5, threshold: float = 0.8) -> DataFrame:
    """a_id, b_id (a_id < b_id), jaccard of texts whose sets of ``width``-word shingles reach the threshold; of texts that are
    equal but for case and white space the first stands for all.

    In any common order of shingles, two such sets share one of the first ``size - least overlap + 1`` of each, so texts meet on
    these alone. The order has shingles last that are frequent in some of the documents. A place in the order tells how much two sets
    can still share, which rules out most of what meets. What is left are units: texts that meet on a shingle, under the smallest
    of them, so near copies of one text are one unit. Parities of shingles, some bits for each set, rule out most of those that meet by
    chance. A set is made again for the texts that are left and exchanged once for each unit (a large one is cut to parts); neither sets of all texts nor pairs that aren't in the result are written or
    exchanged. Pairs of a unit are counted in full, so there is no false pair and none is missed.
    """
    ship(docs.sparkSession)
    rows = docs.filter(strip(F.col("text")) != "").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    hashes = lambda t: F.transform(F.split(t, " "), lambda w: F.xxhash64(w))
    keyed = lambda df: df.select("doc_id", normal_key(F.col("text")).alias("t")).select("doc_id", F.sha2("t", 256).alias("k"), hashes(F.col("t")).alias("w"))
    distinct = distinct_shingles(width)
    some = keyed(rows.filter(F.pmod(F.xxhash64("doc_id"), F.lit(counted_documents(docs.count()))) == 0)).mapInArrow(distinct, SETS).select(F.explode("s").alias("s"))
    common = some.groupBy("s").count().filter("count > 1").orderBy(F.desc("count"), "s").limit(SHINGLES_HELD).toArrow().sort_by("s")
    leading = leading_shingles(common["s"].to_numpy(), common["count"].to_numpy(), threshold)
    leads = written_once(keyed(rows).mapInArrow(lambda batches: leading(distinct(batches)), LEADS))
    first = leads.groupBy("k").agg(F.min("doc_id").alias("first_id")).filter("first_id is not null")
    sets = None
    if leads.groupBy("doc_id").count().filter("count > 1").head(1):  # texts of one doc_id are one set, a copy is none
        sets = keyed(rows).mapInArrow(distinct, SETS).join(first.withColumnRenamed("first_id", "doc_id"), ["k", "doc_id"], "left_semi").groupBy("doc_id").agg(F.min("k").alias("k"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("s")))).alias("s"))
        sets = written_once(sets.select("doc_id", "k", "s"))
        leads = written_once(sets.mapInArrow(leading, LEADS))
    else:
        copies = written_once(leads.select("k", "doc_id").join(first, "k").filter("doc_id > first_id").select("doc_id"))
        leads = leads.filter("doc_id is not null").join(_broadcast_if_few(copies), "doc_id", "left_anti")
    met = leads.select("doc_id", "n", F.posexplode("lead").alias("at", "s")).select("s", "doc_id", "n", "at").repartition("s").sortWithinPartitions("s")
    members = written_once(met.mapInArrow(units_of(threshold), "unit long, doc_id long").distinct())

    def units(members: DataFrame) -> DataFrame:
        sizes = members.groupBy("unit").agg(F.ceil(F.count(F.lit(1)) / PART_EACH).cast("int").alias("parts"))
        return _broadcast_if_few(written_once(members.join(sizes, "unit").groupBy("doc_id").agg(F.collect_list(F.struct("unit", "parts")).alias("k"))))

    def placed(df: DataFrame, *columns: str) -> DataFrame:
        parts = df.select("doc_id", *columns, F.explode("k").alias("k")).select("doc_id", *columns, "k.unit", "k.parts", F.pmod(F.xxhash64("doc_id"), F.col("k.parts")).cast("int").alias("part"))
        parts = parts.select("*", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("to"))
        return parts.select("unit", F.least("part", "to").alias("i"), F.greatest("part", "to").alias("j"), "part", "doc_id", *columns).repartition("unit", "i", "j").sortWithinPartitions("unit", "i", "j")

    marked = placed(leads.select("doc_id", "n", "bits").join(units(members), "doc_id"), "n", "bits")
    found = units(written_once(marked.mapInArrow(near_members(threshold), "unit long, doc_id long").distinct()))
    if sets is None:
        sets = rows.join(found, "doc_id").select("doc_id", "k", hashes(normal_key(F.col("text"))).alias("w")).mapInArrow(distinct, UNIT_SETS)
    else:
        sets = sets.select("doc_id", "s").join(found, "doc_id")
    pairs = placed(sets, "s").mapInArrow(pairs_of_units(threshold), "a_id long, b_id long, jaccard double")
    return pairs.distinct().withColumn("jaccard", F.round("jaccard", 6))


def _broadcast_if_few(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= ROWS_BROADCAST else df


def word_overlap(pairs: DataFrame) -> DataFrame:
    """pair_id, confidence: Jaccard of lower-case words within 0.5 to 1; 0 for equal texts, 0.5 for an empty original."""
    return pairs.select("pair_id", overlap_confidence(F.col("original"), F.col("revised")).alias("confidence"))
