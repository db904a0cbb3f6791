"""Readability, grammar rules, style and tone, keywords, summaries, sentiment, revisions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.functions.lexicons import FLESCH_LEVELS, GRAMMAR_RULES, INFORMAL, NEGATIVE, POSITIVE, STOP_WORDS, VERBOSE
from vellum.functions.text import ascii_rule, banded, occurrences, overlap_confidence, places, ranked, strip, words
from vellum.operators.segment import sentences
from vellum.operators.terms import short_list, with_term_count

# Patterns of the style rules (words of any script) and of the tone rules (ASCII words).
CONTRACTION = r"(?U)\b\w+'\w+\b"
FIRST_PERSON_SHORT = r"(?iU)\b(?:I|we|us|our|me|my)\b"
PASSIVE = r"(?iU)\b(?:was|were)\s+\w+(?:ed|en)\b"
TONE_CONTRACTION = r"\b\w+'\w+\b"
TONE_FIRST_PERSON = r"(?i)\b(?:I|me|my|mine|we|us|our|ours)\b"


def syllables(word: Column, marked: Column) -> Column:
    """Vowel groups of a lower-case word of letters, each a V in ``marked``; one less for a final e, one more for a final
    le, at least one; one up to three letters."""
    groups = F.greatest(F.lit(1), F.length(marked) - F.length(F.replace(marked, F.lit("V"), F.lit(""))))
    count = groups - F.when(word.endswith("e"), 1).otherwise(0) + F.when(word.endswith("le"), 1).otherwise(0)
    return F.when(F.length(word) <= 3, 1).otherwise(F.greatest(F.lit(1), count))


def readability(docs: DataFrame) -> DataFrame:
    """doc_id, n_sentences, n_words, n_syllables, n_complex, flesch, level, fog; null scores without words or sentences.

    Case, other characters and vowels are seen to once for a whole text. A word without ASCII letters has one syllable.
    """
    text = F.coalesce("text", F.lit(""))
    base = docs.select("doc_id", F.size(sentences(text, "any")).alias("n_sentences"), F.size(words(text)).alias("n_words"), F.regexp_replace(F.lower(text), r"[^a-z\s]", "").alias("t"))
    base = base.select("doc_id", "n_sentences", "n_words", F.zip_with(words(F.col("t")), words(F.regexp_replace("t", "[aeiouy]+", "V")), syllables).alias("s"))
    counted = F.aggregate("s", F.col("n_words") - F.size("s"), lambda acc, x: acc + x)
    base = base.select("doc_id", "n_sentences", "n_words", counted.alias("n_syllables"), F.size(F.filter("s", lambda x: x > 2)).alias("n_complex"))
    some = (F.col("n_sentences") > 0) & (F.col("n_words") > 0)
    ease = 206.835 - 1.015 * (F.col("n_words") / F.col("n_sentences")) - 84.6 * (F.col("n_syllables") / F.col("n_words"))
    fog = 0.4 * (F.col("n_words") / F.col("n_sentences") + 100 * F.col("n_complex") / F.col("n_words"))
    return base.select(
        "doc_id", "n_sentences", "n_words", "n_syllables", "n_complex", F.when(some, F.floor(ease + 0.5)).alias("flesch"),
        F.when(some, banded(ease, FLESCH_LEVELS)).alias("level"), F.when(some, F.floor(fog * 10 + 0.5) / 10).alias("fog"),
    )


def grammar_issues(docs: DataFrame) -> DataFrame:
    """doc_id, rule_no, type, offset, length, message: a row for each occurrence of each rule."""

    def rule(i: int) -> Column:
        kind, pattern, message = GRAMMAR_RULES[i]
        issue = lambda p: F.struct(F.lit(i).alias("rule_no"), F.lit(kind).alias("type"), p["start"].alias("offset"), F.length(p["match"]).alias("length"), F.lit(message).alias("message"))
        return F.transform(places(F.col("text"), ascii_rule(pattern)), issue)

    found = F.array(*map(rule, range(len(GRAMMAR_RULES))))
    return docs.select("doc_id", F.explode(F.flatten(found)).alias("i")).select("doc_id", "i.*")


def quality_score(docs: DataFrame) -> DataFrame:
    """doc_id, n_issues, n_grammar, n_punctuation, score: every issue is major; a word is taken as five characters; an empty text scores 100."""
    text = F.coalesce("text", F.lit(""))
    n = reduce(lambda a, b: a + b, [occurrences(text, ascii_rule(p)) for _, p, _ in GRAMMAR_RULES])
    of = lambda kind: reduce(lambda a, b: a + b, [occurrences(text, ascii_rule(p)) for k, p, _ in GRAMMAR_RULES if k == kind])
    base = docs.select("doc_id", F.length(text).alias("chars"), n.alias("n_issues"), of("grammar").alias("n_grammar"), of("punctuation").alias("n_punctuation"))
    rate = F.col("n_issues") / (F.col("chars") / 5) * 100
    score = 100 - F.when(rate > 20, 50).when(rate > 15, 40).when(rate > 10, 30).when(rate > 5, 20).when(rate > 2, 10).otherwise(0) - 2 * F.col("n_issues")
    return base.select("doc_id", "n_issues", "n_grammar", "n_punctuation", F.when(F.col("chars") == 0, 100).otherwise(F.greatest(F.lit(0), F.least(F.lit(100), score))).alias("score"))


def apply_text_rules(docs: DataFrame) -> DataFrame:
    """doc_id, text, and how often each rewrite rule applied: spaces, space before punctuation, your, their; sentences then start upper-case."""
    space, punct = r"  +", r"\s+([.,!?;:])"
    your, their = r"(?i)\byour\s+(going|doing|coming|leaving|getting|being|saying|trying)\b", r"(?i)\btheir\s+(is|are|was|were)\b"
    out = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("t0"))
    out = out.withColumn("n_spaces", occurrences(F.col("t0"), space)).withColumn("t1", F.regexp_replace("t0", space, " "))
    out = out.withColumn("n_punctuation", occurrences(F.col("t1"), punct)).withColumn("t2", F.regexp_replace("t1", punct, "$1"))
    found = F.regexp_extract_all("t2", F.lit(r"[.!?]\s+[a-z]"), F.lit(0))
    raised = F.transform(found, lambda m: F.concat(F.substring(m, 1, 1), F.lit(" "), F.upper(F.substring(m, -1, 1))))
    pieces = F.split("t2", r"[.!?]\s+[a-z]", -1)
    t3 = F.array_join(F.zip_with(pieces, raised, lambda p, r: F.concat(p, F.coalesce(r, F.lit("")))), "")
    out = out.withColumn("t3", t3)
    your, their = ascii_rule(your), ascii_rule(their)
    out = out.withColumn("n_your", occurrences(F.col("t3"), your)).withColumn("t4", F.regexp_replace("t3", your, "you're $1"))
    out = out.withColumn("n_their", occurrences(F.col("t4"), their)).withColumn("text", F.regexp_replace("t4", their, "there $1"))
    return out.select("doc_id", "n_spaces", "n_punctuation", "n_your", "n_their", "text")


# The verbs after "your", and the spellings, of the second rule set.
YOUR_VERBS = "going|doing|coming|leaving|getting|being|saying|trying|running|making|giving|taking|eating|sleeping"
SPELLINGS = [("accomodate", "accommodate"), ("bussiness", "business"), ("wether", "whether"), ("recieve", "receive"), ("neccessary", "necessary")]


def basic_enhancements(docs: DataFrame) -> DataFrame:
    """doc_id, text, changes (comma-joined, in order): spaces, space before punctuation and each spelling count as changes;
    capitals after a sentence's end, your, their and its are mended without being counted."""
    out = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("t"))
    space, punct = "  ", r"\s+([.,!?;:])"
    out = out.withColumn("c0", F.when(F.col("t").contains(space), "whitespace")).withColumn("t", F.regexp_replace("t", " {2,}", " "))
    out = out.withColumn("c1", F.when(F.col("t").rlike(punct), "punctuation")).withColumn("t", F.regexp_replace("t", punct, "$1"))
    raised = F.transform(F.regexp_extract_all("t", F.lit(r"[.!?]\s+[a-z]"), F.lit(0)), lambda m: F.concat(F.substring(m, 1, 1), F.lit(" "), F.upper(F.substring(m, -1, 1))))
    out = out.withColumn("t", F.array_join(F.zip_with(F.split("t", r"[.!?]\s+[a-z]", -1), raised, lambda gap, r: F.concat(gap, F.coalesce(r, F.lit("")))), ""))
    # A text without the word isn't searched by its rule.
    has = lambda word: F.lower("t").contains(word)
    mended = lambda word, pattern, new: F.when(has(word), F.regexp_replace("t", pattern, new)).otherwise(F.col("t"))
    for word, pattern, new in (("your", rf"(?i)\byour\s+({YOUR_VERBS})\b", "you're $1"), ("their", r"(?i)\btheir\s+(is|are|was|were)\b", "there $1"), ("its", r"(?i)\bits\s+(is|are|was|were|has|have|had)\b", "it's $1")):
        out = out.withColumn("t", mended(word, ascii_rule(pattern), new))
    for i, (wrong, right) in enumerate(SPELLINGS, 2):
        pattern = ascii_rule(rf"(?i)\b{wrong}\b")
        out = out.withColumn(f"c{i}", F.when(has(wrong) & F.col("t").rlike(pattern) & (F.regexp_replace("t", pattern, right) != F.col("t")), wrong)).withColumn("t", mended(wrong, pattern, right))
    return out.select("doc_id", F.col("t").alias("text"), F.concat_ws(",", *[f"c{i}" for i in range(2 + len(SPELLINGS))]).alias("changes"))


def style_suggestions(docs: DataFrame, verbose: DataFrame | list[str] | None = None) -> DataFrame:
    """doc_id, type, n: a row for each kind of suggestion that a document gets.

    formality (contractions), style (passive voice), academic_tone (more than three first persons), conciseness (verbose
    phrases), repetition (words of more than four letters used more than three times). ``verbose`` is a list of phrases, or
    a table (term) of any size.
    """
    text, lower = F.col("text"), F.lower("text")
    docs = with_term_count(docs.filter("text is not null"), text, [p for p, _ in VERBOSE] if verbose is None else verbose, "_verbose")
    n = lambda kind, count: F.struct(F.lit(kind).alias("type"), count.cast("long").alias("n"))
    first = occurrences(text, FIRST_PERSON_SHORT)
    flat = docs.select("doc_id", F.explode(F.array(n("formality", occurrences(text, CONTRACTION)), n("style", text.rlike(PASSIVE).cast("int")), n("academic_tone", F.when(first > 3, first).otherwise(0)), n("conciseness", F.col("_verbose")))).alias("s")).select("doc_id", "s.*").filter("n > 0")
    bare = F.transform(words(lower), lambda w: F.regexp_replace(w, r"[^\p{L}\p{N}_]", ""))
    tokens = docs.select("doc_id", F.explode(F.filter(bare, lambda w: F.length(w) > 4)).alias("w")).groupBy("doc_id", "w").agg(F.count(F.lit(1)).alias("c")).filter("c > 3")
    return flat.unionByName(tokens.groupBy("doc_id").agg(F.lit("repetition").alias("type"), F.count(F.lit(1)).alias("n")))


def academic_tone(docs: DataFrame, informal: DataFrame | list[str] | None = None) -> DataFrame:
    """doc_id, n_informal, n_contractions, first_person, score: five points less for each suggestion. ``informal`` is a list of
    words and phrases, or a table (term) of any size."""
    text = F.coalesce("text", F.lit(""))
    base = with_term_count(docs, text, [p for p, _ in INFORMAL] if informal is None else informal, "n_informal", "words")
    base = base.select("doc_id", "n_informal", occurrences(text, ascii_rule(TONE_CONTRACTION)).alias("n_contractions"), occurrences(text, ascii_rule(TONE_FIRST_PERSON)).alias("first_person"))
    total = F.col("n_informal") + F.col("n_contractions") + F.when(F.col("first_person") > 0, 1).otherwise(0)
    return base.withColumn("score", F.greatest(F.lit(0), 100 - 5 * total))


def top_keywords(docs: DataFrame, k: int = 10, stop_words: DataFrame | list[str] = STOP_WORDS) -> DataFrame:
    """doc_id, place, keyword, n: the k most frequent words of four or more letters, ties by first use. ``stop_words`` is a list,
    or a table (term) of any size."""
    rows = docs.select("doc_id", F.posexplode(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))).alias("pos", "keyword"))
    rows = rows.filter(F.col("keyword").rlike("^[a-z]{4,}$"))
    few = short_list(stop_words)
    counts = (rows.filter(~F.col("keyword").isin(few)) if few else rows).groupBy("doc_id", "keyword").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("first"))
    if few is None:
        counts = counts.join(stop_words.select(F.col("term").alias("keyword")), "keyword", "left_anti")
    return ranked(counts, ["doc_id"], [F.desc("n"), "first"], "place").filter(F.col("place") <= k).select("doc_id", "place", "keyword", "n")


def lead_summary(docs: DataFrame, most: int = 150) -> DataFrame:
    """doc_id, summary: the first five sentences, cut at the last space within ``most`` characters; texts under 100 have none."""
    text = strip(F.col("text"))
    lead = F.array_join(F.slice(F.split(text, r"(?<=[.!?])\s+"), 1, 5), " ")
    cut = F.concat(F.regexp_replace(F.substring(lead, 1, most), r" [^ ]*$", ""), F.lit("..."))
    return docs.filter(F.length(text) >= 100).select("doc_id", F.when(F.length(lead) > most, cut).otherwise(lead).alias("summary"))


def lexicon_sentiment(docs: DataFrame, positive: DataFrame | list[str] = POSITIVE, negative: DataFrame | list[str] = NEGATIVE) -> DataFrame:
    """doc_id, n_positive, n_negative, score, label: a word counts once if it is anywhere in the text. The words are lists, or
    tables (term) of any size."""
    base = with_term_count(docs.filter(F.trim("text") != ""), F.col("text"), positive, "n_positive")
    base = with_term_count(base, F.col("text"), negative, "n_negative").select("doc_id", "n_positive", "n_negative")
    p, n = F.col("n_positive"), F.col("n_negative")
    score = F.when(p > n, 0.6 + p / (p + n) * 0.4).when(n > p, 0.4 - n / (p + n) * 0.4).otherwise(0.5)
    return base.select("doc_id", "n_positive", "n_negative", F.round(score, 2).alias("score"), F.when(p > n, "positive").when(n > p, "negative").otherwise("neutral").alias("label"))


def revision_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """doc_id, idx, original, revised, changed: sentences of both versions side by side; what one lacks is empty."""

    def rows(df: DataFrame, name: str) -> DataFrame:
        pieces = F.filter(F.transform(F.split("text", r"[.!?]+\s+"), strip), lambda s: s != "")
        return df.select("doc_id", F.posexplode(pieces).alias("idx", name))

    both = rows(old, "original").join(rows(new, "revised"), ["doc_id", "idx"], "full").na.fill("", ["original", "revised"])
    return both.select("doc_id", "idx", "original", "revised", (F.col("original") != F.col("revised")).alias("changed"))


def revision_stats(changes: DataFrame) -> DataFrame:
    """doc_id, total, changed, unchanged, percent of changed sentences, confidence (mean over all sentences, three digits)."""
    tenthousandths = F.round(overlap_confidence(F.col("original"), F.col("revised")) * 10_000).cast("long")
    out = changes.groupBy("doc_id").agg(F.count(F.lit(1)).alias("total"), F.count_if("changed").alias("changed"), F.sum(tenthousandths).alias("c"))
    mean = F.floor(F.col("c") / F.col("total") / 10 + 0.5) / 1000
    return out.select("doc_id", "total", "changed", (F.col("total") - F.col("changed")).alias("unchanged"), F.floor(F.col("changed") / F.col("total") * 100 + 0.5).alias("percent"), mean.alias("confidence"))
