"""Sections of documents: blocks, chunks, outlines, spans, document types, checks and metrics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.functions.lexicons import ESSENTIAL, JOURNAL, KNOWLEDGE, OPTIONAL_SECTIONS, RECOMMENDED, REQUIRED_SECTIONS, SECTION_HEADERS, SECTION_KEYWORDS, SECTION_SIGNS
from vellum.functions.shipping import ship
from vellum.functions.text import ascii_rule, ranked, strip, words
from vellum.operators.similarity import tokens
from vellum.operators.terms import short_list, with_terms
from vellum.operators.vectors import cosines_with
from vellum.operators.zones import KEYWORDS, MEASURES, REFERENCE_TITLES, TITLE_NUMBER, is_marginal, single_spaced

MARKDOWN = r"^(#{1,6})\s+(.+)$"
NUMBER = r"^\d+(?:\.\d+)*\s+"
MOST_CLASSES = 1000


def _lines(docs: DataFrame) -> DataFrame:
    rows = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return rows.select("doc_id", "line_no", strip(F.col("line")).alias("s"), F.length("line").alias("n"))


def paragraph_blocks(docs: DataFrame) -> DataFrame:
    """doc_id, block_idx, style, section_level, text: ``#`` headings, numbered headings of at most 12 words (level 2), and
    paragraphs of the lines between headings and blank lines."""
    order = Window.partitionBy("doc_id").orderBy("line_no")
    rows = _lines(docs)
    s = F.col("s")
    level = F.when(s.rlike(MARKDOWN), F.length(F.regexp_extract("s", MARKDOWN, 1))).when(s.rlike(NUMBER + "[A-Z]") & (F.size(words(s)) <= 12), 2)
    rows = rows.withColumn("level", level)
    opens = F.col("level").isNotNull() | F.lag("level").over(order).isNotNull() | (F.coalesce(F.lag("s").over(order), F.lit("")) == "")
    rows = rows.withColumn("opens", opens).filter("s <> ''").withColumn("block", F.sum(F.col("opens").cast("int")).over(order))
    shown = F.when(s.rlike(MARKDOWN), strip(F.regexp_extract("s", MARKDOWN, 2))).when(F.col("level").isNotNull(), F.regexp_replace("s", NUMBER, "")).otherwise(s)
    blocks = rows.select("doc_id", "block", "level", F.struct("line_no", shown.alias("t")).alias("l")).groupBy("doc_id", "block").agg(F.max("level").alias("section_level"), F.array_sort(F.collect_list("l")).alias("l"))
    style = F.when(F.col("section_level").isNull(), "Normal").otherwise(F.concat(F.lit("Heading "), F.col("section_level").cast("string")))
    return blocks.select("doc_id", (F.col("block") - 1).cast("int").alias("block_idx"), style.alias("style"), "section_level", F.array_join(F.transform("l", lambda x: x["t"]), " ").alias("text"))


def section_type(heading: Column) -> Column:
    """The first type one of whose words is in the heading, else generic."""
    lower = F.lower(heading)
    found = [F.when(reduce(lambda a, b: a | b, [lower.contains(w) for w in ws]), kind) for kind, ws in SECTION_KEYWORDS]
    return F.coalesce(*found, F.lit("generic"))


def section_types(headings: DataFrame, keywords: DataFrame) -> DataFrame:
    """Add section_type to rows with a heading: the type of the first keyword (by place) that is in it, else generic.

    ``keywords`` (section_type, place, term) is a table of any size; lower-case terms count anywhere in the heading.
    """
    few = short_list(keywords)
    if few is not None:
        order = keywords.filter(F.coalesce("term", F.lit("")) != "").orderBy("place", "section_type", "term").collect()
        kinds = F.filter(F.array(*[F.struct(F.lit(r.term).alias("t"), F.lit(r.section_type).alias("k")) for r in order]), lambda x: F.lower("heading").contains(x["t"])) if order else F.expr("cast(array() as array<struct<t:string,k:string>>)")
        return headings.withColumn("section_type", F.coalesce(F.get(kinds, F.lit(0))["k"], F.lit("generic")))
    # Of each distinct heading the terms that are in it, then the first of them.
    distinct = headings.select("heading").filter("heading is not null").distinct()
    found = with_terms(distinct, F.col("heading"), keywords, "_terms").select("heading", F.explode("_terms").alias("term"))
    first = found.join(keywords, "term").groupBy("heading").agg(F.min(F.struct("place", "section_type", "term")).alias("m")).select("heading", F.col("m.section_type").alias("section_type"))
    return headings.drop("section_type").join(first, "heading", "left").na.fill("generic", ["section_type"])


def block_level(style: Column, section_level: Column) -> Column:
    """Level 1 to 6 of a heading by its section_level, else its style; 0 for other blocks."""
    number = F.regexp_extract(style, r"(?i)Heading\s*(\d+)", 1)
    clamp = lambda x: F.greatest(F.lit(1), F.least(F.lit(6), x))
    return F.when(section_level > 0, clamp(section_level)).when(style == "Title", 1).when(number != "", clamp(F.when(number != "", number).otherwise("0").cast("int"))).otherwise(0)


def section_chunks(blocks: DataFrame, title: str = "Untitled") -> DataFrame:
    """doc_id, chunk_idx, section_type, heading, text, word_count, char_start, char_end, section_level, block_count.

    A heading opens a section; blocks before the first are under ``title``. A section without text has its heading as
    text. Offsets count two characters between sections.
    """
    order = Window.partitionBy("doc_id").orderBy("block_idx")
    rows = blocks.filter(strip(F.col("text")) != "").withColumn("level", block_level(F.col("style"), F.col("section_level"))).withColumn("section", F.sum((F.col("level") > 0).cast("int")).over(order))
    head = F.col("level") > 0
    item = F.struct("block_idx", strip(F.col("text")).alias("t"))
    sections = rows.groupBy("doc_id", "section").agg(F.max(F.when(head, strip(F.col("text")))).alias("heading"), F.max(F.when(head, F.col("level"))).alias("level"), F.array_sort(F.collect_list(F.when(~head, item))).alias("l"))
    body = F.array_join(F.transform("l", lambda x: x["t"]), "\n\n")
    sections = sections.select("doc_id", "section", F.coalesce("heading", F.lit(title)).alias("heading"), F.coalesce("level", F.lit(1)).alias("section_level"), F.when(body != "", body).otherwise(F.coalesce("heading", F.lit(title))).alias("text"), F.size("l").alias("block_count"))
    by = Window.partitionBy("doc_id").orderBy("section")
    start = F.coalesce(F.sum(F.length("text") + 2).over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return sections.select(
        "doc_id", (F.row_number().over(by) - 1).alias("chunk_idx"), section_type(F.col("heading")).alias("section_type"), "heading", "text", F.size(words(F.col("text"))).alias("word_count"),
        start.alias("char_start"), (start + F.length("text")).alias("char_end"), "section_level", "block_count",
    )


def merge_sections(chunks: DataFrame) -> DataFrame:
    """Chunks of one type and heading as one: doc_id, chunk_idx (the first), section_type, heading, text, word_count, char_end (the last)."""
    out = chunks.groupBy("doc_id", "section_type", "heading").agg(F.min("chunk_idx").alias("chunk_idx"), F.array_sort(F.collect_list(F.struct("chunk_idx", "text"))).alias("l"), F.sum("word_count").alias("word_count"), F.max_by("char_end", "chunk_idx").alias("char_end"))
    return out.select("doc_id", "chunk_idx", "section_type", "heading", F.array_join(F.transform("l", lambda x: x["text"]), "\n\n").alias("text"), "word_count", "char_end")


def section_numbering(headings: DataFrame) -> DataFrame:
    """doc_id, idx, level, section_id (``s1.2.3``): counters of levels 1 to 3, each from the last shallower heading on."""
    order = ["idx"]
    count = lambda n, by: F.sum((F.col("level") == n).cast("int")).over(Window.partitionBy("doc_id", *by).orderBy(*order))
    rows = headings.filter("level between 1 and 3").withColumn("n1", count(1, []))
    rows = rows.withColumn("n2", count(2, ["n1"])).withColumn("n3", count(3, ["n1", "n2"]))
    number = F.when(F.col("level") == 1, F.concat_ws(".", "n1")).when(F.col("level") == 2, F.concat_ws(".", "n1", "n2")).otherwise(F.concat_ws(".", "n1", "n2", "n3"))
    return rows.select("doc_id", "idx", "level", F.concat(F.lit("s"), number).alias("section_id"))


def section_parents(headings: DataFrame) -> DataFrame:
    """doc_id, idx, level, parent_idx: the nearest earlier heading of a smaller level; headings below level 2 are no parents."""
    before = Window.partitionBy("doc_id").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    last = lambda n: F.max(F.when(F.col("level") == n, F.col("idx"))).over(before)
    return headings.select("doc_id", "idx", "level", F.when(F.col("level") == 2, last(1)).when(F.col("level") > 2, F.greatest(last(1), last(2))).alias("parent_idx"))


def heading_outline(blocks: DataFrame) -> DataFrame:
    """doc_id, block_idx, level (0 to 3), n_words, n_chars, parent_idx (the last H1 for H2, the last H2 for H3), outline (100 characters)."""
    level = F.when(F.col("style").rlike("^Heading [123]$"), F.substring("style", 9, 1).cast("int")).otherwise(0)
    before = Window.partitionBy("doc_id").orderBy("block_idx").rowsBetween(Window.unboundedPreceding, -1)
    rows = blocks.withColumn("level", level)
    last = lambda n: F.max(F.when(F.col("level") == n, F.col("block_idx"))).over(before)
    return rows.select("doc_id", "block_idx", "level", F.size(words(F.col("text"))).alias("n_words"), F.length("text").alias("n_chars"), F.when(F.col("level") == 2, last(1)).when(F.col("level") == 3, last(2)).alias("parent_idx"), F.substring("text", 1, 100).alias("outline"))


def reassemble_text(blocks: DataFrame) -> DataFrame:
    """doc_id, text: blocks in order, headings with ``#`` marks, blank lines between."""
    level = F.when(F.col("style").rlike("(?i)heading|title"), F.greatest(F.lit(1), F.least(F.lit(6), F.coalesce(F.col("section_level"), F.lit(1)))))
    line = F.when(level.isNotNull(), F.concat(F.repeat(F.lit("#"), level), F.lit(" "), F.trim("text"))).otherwise(F.trim("text"))
    rows = blocks.filter(F.trim("text") != "").select("doc_id", F.struct("block_idx", line.alias("t")).alias("l"))
    return rows.groupBy("doc_id").agg(F.array_sort(F.collect_list("l")).alias("l")).select("doc_id", F.array_join(F.transform("l", lambda x: x["t"]), "\n\n").alias("text"))


def section_spans(docs: DataFrame) -> DataFrame:
    """doc_id, section_idx, type, start, end, text: from each header line to the next one or the text's end."""
    before = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    rows = _lines(docs).withColumn("start", F.coalesce(F.sum(F.col("n") + 1).over(before), F.lit(0)).cast("int"))
    kind = F.coalesce(*[F.when(F.col("s").rlike(rf"(?i)^(?:\d+[.)]\s*)?(?:{p})[ \t]*[:-]?$"), k) for k, p in SECTION_HEADERS])
    heads = rows.withColumn("type", kind).filter("type is not null")
    order = Window.partitionBy("doc_id").orderBy("start")
    heads = heads.select("doc_id", "type", "start", (F.row_number().over(order) - 1).alias("section_idx"), F.lead("start").over(order).alias("next"))
    out = heads.join(docs.select("doc_id", "text"), "doc_id").withColumn("end", F.coalesce("next", F.length("text")))
    return out.select("doc_id", "section_idx", "type", "start", "end", F.expr("substring(text, start + 1, end - start)").alias("text"))


def section_features(sections: DataFrame) -> DataFrame:
    """doc_id, section_idx, n_keywords (of its own type), n_words, n_sentences, upper_share, n_citations."""
    text, w = F.col("text"), words(F.col("text"))
    own = reduce(lambda acc, k: acc.when(F.col("type") == k[0], F.regexp_count(text, F.lit(rf"(?i)\b(?:{'|'.join(k[1])})\b"))), SECTION_KEYWORDS[1:], F.when(F.col("type") == SECTION_KEYWORDS[0][0], F.regexp_count(text, F.lit(rf"(?i)\b(?:{'|'.join(SECTION_KEYWORDS[0][1])})\b"))))
    upper = F.size(F.filter(w, lambda x: x.rlike(r"^\p{Lu}")))
    return sections.select("doc_id", "section_idx", "type", F.coalesce(own, F.lit(0)).alias("n_keywords"), F.size(w).alias("n_words"), F.size(F.split("text", "[.!?]+")).alias("n_sentences"), F.round(upper / F.greatest(F.lit(1), F.size(w)), 6).alias("upper_share"), F.regexp_count(text, F.lit(r"\(\w+,?\s*\d{4}\)")).alias("n_citations"))


def section_classifier(features: DataFrame) -> DataFrame:
    """doc_id, section_idx, type, posterior: Gaussian naive Bayes fitted on the labelled rows (population variance + 1e-9),
    and the probability that it gives to each row's own type. The model is a row for each of at most 1,000 types."""
    names = ("n_keywords", "n_words", "n_sentences", "upper_share", "n_citations")
    stats = features.groupBy("type").agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(f"m_{c}") for c in names], *[(F.var_pop(c) + 1e-9).alias(f"v_{c}") for c in names])
    total = features.count()
    known = stats.withColumnRenamed("type", "class")
    if known.count() > MOST_CLASSES:
        raise ValueError(f"more than {MOST_CLASSES} section types")
    fields = known.columns
    classes = F.array(*[F.struct(*[F.lit(r[c]).alias(c) for c in fields]) for r in known.collect()])  # a struct for each type
    rows = features.select("*", F.explode(classes).alias("k")).select(*features.columns, "k.*")
    log = F.log(F.col("n") / total)
    for c in names:
        log = log - 0.5 * F.log(2 * 3.141592653589793 * F.col(f"v_{c}")) - (F.col(c) - F.col(f"m_{c}")) * (F.col(c) - F.col(f"m_{c}")) / (2 * F.col(f"v_{c}"))
    rows = rows.select("doc_id", "section_idx", "type", "class", log.alias("l"))
    best = rows.groupBy("doc_id", "section_idx", "type").agg(F.max("l").alias("top"), F.max(F.when(F.col("class") == F.col("type"), F.col("l"))).alias("own"))
    sums = rows.join(best, ["doc_id", "section_idx", "type"]).groupBy("doc_id", "section_idx", "type", "own", "top").agg(F.sum(F.exp(F.col("l") - F.col("top"))).alias("z"))
    return sums.select("doc_id", "section_idx", "type", F.round(F.exp(F.col("own") - F.col("top")) / F.col("z"), 3).alias("posterior"))


def document_type(sections: DataFrame) -> DataFrame:
    """doc_id, document_type from a document's distinct section types."""
    kinds = sections.groupBy("doc_id").agg(F.collect_set("type").alias("k"))
    has = lambda names: F.size(F.array_except(F.array(*map(F.lit, names)), "k")) == 0
    kind = F.when(F.size("k") >= 6, "thesis").when(has(JOURNAL), "journal").when(F.size("k") >= 5, "conference").when(has(["introduction", "conclusion"]), "report").otherwise("generic")
    return kinds.select("doc_id", kind.alias("document_type"))


def structure_validation(docs: DataFrame, sections: DataFrame) -> DataFrame:
    """doc_id, missing_essential, missing_recommended (comma-joined, in order), complete, has_references of every document."""
    kinds = docs.select("doc_id").join(sections.groupBy("doc_id").agg(F.collect_set("type").alias("k")), "doc_id", "left").select("doc_id", F.coalesce("k", F.expr("cast(array() as array<string>)")).alias("k"))
    missing = lambda names: F.array_join(F.array_except(F.array(*map(F.lit, sorted(names))), "k"), ",")
    return kinds.select("doc_id", missing(ESSENTIAL).alias("missing_essential"), missing(RECOMMENDED).alias("missing_recommended"), (missing(ESSENTIAL) == "").alias("complete"), F.array_contains("k", "references").alias("has_references"))


def pick_section(sections: DataFrame, kind: str) -> DataFrame:
    """The first section of a type in each document."""
    return ranked(sections.filter(F.col("type") == kind), ["doc_id"], ["start"], "_k").filter("_k = 1").drop("_k")


def structure_metrics(docs: DataFrame, chunks: DataFrame, references: DataFrame) -> DataFrame:
    """doc_id, n_sections, n_paragraphs, n_references, has_abstract, avg_paragraph_words, n_titles, single_share of every document."""
    paragraphs = F.filter(F.split("text", "\n\n"), lambda p: F.trim(p) != "")
    per = chunks.select("doc_id", "section_type", F.lower("heading").alias("title"), F.size(paragraphs).alias("p"), F.aggregate(paragraphs, F.lit(0), lambda acc, p: acc + F.size(words(p))).alias("w"))
    found = per.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_sections"), F.sum("p").alias("n_paragraphs"), F.sum("w").alias("w"), F.countDistinct("title").alias("n_titles"), F.count_if(F.col("p") <= 1).alias("single"), F.max(F.col("section_type") == "abstract").alias("has_abstract"))
    refs = references.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_references"))
    out = docs.select("doc_id").join(found, "doc_id", "left").join(refs, "doc_id", "left").na.fill(0).na.fill(False)
    share = lambda a, b: F.floor(F.col(a) / F.greatest(F.lit(1), F.col(b)) * 100 + 0.5) / 100
    return out.select("doc_id", "n_sections", "n_paragraphs", "n_references", "has_abstract", share("w", "n_paragraphs").alias("avg_paragraph_words"), "n_titles", (F.col("single") / F.greatest(F.lit(1), F.col("n_sections"))).alias("single_share"))


def quality_score() -> Column:
    """Capped weights of a document's metrics, less for many short sections, few paragraphs or none."""
    cap = lambda c, most, weight: F.least(F.col(c), F.lit(most)) * weight
    score = cap("n_sections", 18, 2.0) + cap("n_paragraphs", 120, 0.6) + cap("n_references", 80, 1.4) + F.when(F.col("has_abstract"), 12.0).otherwise(0.0) + cap("n_titles", 18, 1.0) + cap("avg_paragraph_words", 90.0, 0.15)
    score = score - F.when((F.col("n_sections") > 25) & (F.col("single_share") > 0.55), (F.col("n_sections") - 25) * 1.5 + F.col("single_share") * 20).otherwise(0.0)
    score = score - F.when(F.col("n_paragraphs") <= 2, 25.0).otherwise(0.0) - F.when(F.col("n_sections") == 0, 50.0).otherwise(0.0)
    return F.round(score, 4)


def structure_quality_score(metrics: DataFrame) -> DataFrame:
    """doc_id, score of each row of metrics."""
    return metrics.select("doc_id", quality_score().alias("score"))


def compare_segmentations(a: DataFrame, b: DataFrame) -> DataFrame:
    """doc_id, differences of the metrics of b from a, and whether b is chosen: its quality is higher."""
    names = ("n_sections", "n_paragraphs", "n_references", "avg_paragraph_words")
    scored = lambda df, x: df.select("doc_id", *[F.col(c).alias(f"{x}_{c}") for c in names], quality_score().alias(f"{x}_score"))
    both = scored(a, "a").join(scored(b, "b"), "doc_id")
    return both.select("doc_id", *[F.round(F.col(f"b_{c}") - F.col(f"a_{c}"), 2).alias(f"d_{c}") for c in names], (F.col("b_score") > F.col("a_score")).alias("b_chosen"))


def guideline_rules(docs: DataFrame, pattern: str, most: int = 40) -> DataFrame:
    """doc_id, place, line: the first ``most`` distinct lines (but for case and spaces) that have the pattern."""
    rows = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line")).withColumn("line", strip(F.col("line"))).filter(F.col("line").rlike(pattern))
    first = rows.withColumn("k", F.lower(F.regexp_replace("line", r"\s+", " "))).groupBy("doc_id", "k").agg(F.min(F.struct("line_no", "line")).alias("f")).select("doc_id", "f.line_no", "f.line")
    return ranked(first, ["doc_id"], ["line_no"], "place").filter(F.col("place") <= most).select("doc_id", "place", "line")


def statement_scores(chunks: DataFrame, knowledge: list[tuple[str, str]] = KNOWLEDGE) -> DataFrame:
    """doc_id, chunk_idx, kb_idx, section, c: cosine of each chunk with each statement on a section (section, text), by TF-IDF
    fitted on the statements; pairs without a common word are left out. The statements are a fixed short list."""
    spark = chunks.sparkSession
    kb = spark.createDataFrame([(i, k, t) for i, (k, t) in enumerate(knowledge)], "kb_idx int, section string, text string")
    words_of = kb.select("kb_idx", "section", F.explode(tokens(F.col("text"))).alias("token")).groupBy("kb_idx", "section", "token").agg(F.count(F.lit(1)).alias("tf"))
    idf = words_of.groupBy("token").agg((F.log((1.0 + len(knowledge)) / (1.0 + F.count(F.lit(1)))) + 1).alias("idf"))

    def unit(df: DataFrame, keys: list[str], name: str) -> DataFrame:
        w = df.withColumn("w", F.col("tf") * F.col("idf"))
        return w.select(*keys, "token", (F.col("w") / F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(*keys)))).alias(name))

    # Words that no statement has count nowhere, and go before anything is exchanged.
    mine = chunks.select("doc_id", "chunk_idx", F.explode(tokens(F.col("text"))).alias("token")).join(F.broadcast(idf), "token").groupBy("doc_id", "chunk_idx", "token").agg(F.count(F.lit(1)).alias("tf"), F.first("idf").alias("idf"))
    both = unit(mine, ["doc_id", "chunk_idx"], "v").join(F.broadcast(unit(words_of.join(idf, "token"), ["kb_idx", "section"], "w")), "token")
    return both.groupBy("doc_id", "chunk_idx", "kb_idx", "section").agg(F.sum(F.col("v") * F.col("w")).alias("c"))


def vector_statement_scores(chunks: DataFrame, chunk_vectors: DataFrame, statement_vectors: DataFrame, knowledge: list[tuple[str, str]] = KNOWLEDGE) -> DataFrame:
    """``statement_scores`` with vectors of one's own: ``chunk_vectors`` has (doc_id, chunk_idx, embedding), ``statement_vectors``
    (kb_idx, embedding), at most one for each; a null vector is none.

    Pairs of which both have a vector of one length are compared by it (a vector of length 0 has cosine 0), all others by
    TF-IDF. Statements are as many as ``knowledge`` has, so their vectors are sent with the task, and a chunk meets them in its row.
    """
    key = ["doc_id", "chunk_idx"]
    mine = chunks.select(*key).join(chunk_vectors.filter("embedding is not null").select(*key, F.col("embedding").alias("x")), key)
    theirs = statement_vectors.filter("embedding is not null").filter(F.col("kb_idx").between(0, len(knowledge) - 1)).select(F.col("kb_idx").cast("int").alias("kb_idx"), F.col("embedding").alias("y")).collect()
    named = F.array(*[F.struct(F.lit(r.kb_idx).alias("kb_idx"), F.lit(knowledge[r.kb_idx][0]).alias("section"), F.lit(len(r.y)).alias("d")) for r in theirs]) if theirs else F.expr("cast(array() as array<struct<kb_idx:int,section:string,d:int>>)")
    cosines = cosines_with([r.y for r in theirs])
    ship(chunks.sparkSession)
    pairs = mine.select(*key, F.size("x").alias("d"), F.arrays_zip(named.alias("k"), cosines(F.col("x")).alias("c")).alias("p")).select(*key, "d", F.explode("p").alias("p"))
    dense = pairs.filter("p.k.d = d").select(*key, "p.k.kb_idx", "p.k.section", "p.c")
    lengths = F.filter(named, lambda k: (k["kb_idx"] == F.col("kb_idx")) & (k["d"] == F.col("_d")))
    sparse = statement_scores(chunks, knowledge).join(mine.select(*key, F.size("x").alias("_d")), key, "left").filter(F.size(lengths) == 0).drop("_d")
    return dense.unionByName(sparse)


def section_scores(chunks: DataFrame, vectors: tuple[DataFrame, DataFrame] | None = None, knowledge: list[tuple[str, str]] = KNOWLEDGE) -> DataFrame:
    """doc_id, section, score (4 digits): the best cosine of a document's chunks with the statements on each section.

    By TF-IDF, or, for chunks and statements that have one in ``vectors`` (of chunks, of statements), by vector.
    """
    scores = statement_scores(chunks, knowledge) if vectors is None else vector_statement_scores(chunks, *vectors, knowledge)
    return scores.groupBy("doc_id", "section").agg(F.round(F.max("c"), 4).alias("score"))


def gap_report(chunks: DataFrame, present: float = 0.35, thin: float = 0.25, vectors: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """doc_id, present, thin, missing (comma-joined), coverage of documents with chunks (doc_id, chunk_idx, text): a section is
    present or thin by its score; of the others required ones are missing. Optional sections count for the coverage,
    which may so be more than 1. ``vectors`` as in ``section_scores``."""
    asked = F.array(*map(F.lit, [*REQUIRED_SECTIONS, *OPTIONAL_SECTIONS]))
    known = section_scores(chunks, vectors).groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("section", "score"))).alias("m"))
    rows = chunks.select("doc_id").distinct().join(known, "doc_id", "left").withColumn("asked", asked)
    score = lambda s: F.coalesce(F.element_at("m", s), F.lit(0.0))
    lists = rows.select("doc_id", F.filter("asked", lambda s: score(s) >= present).alias("p"), F.filter("asked", lambda s: (score(s) >= thin) & (score(s) < present)).alias("t"), F.filter("asked", lambda s: (score(s) < thin) & s.isin(*REQUIRED_SECTIONS)).alias("m"))
    return lists.select("doc_id", F.array_join("p", ",").alias("present"), F.array_join("t", ",").alias("thin"), F.array_join("m", ",").alias("missing"), F.round(F.size("p") / len(REQUIRED_SECTIONS), 3).alias("coverage"))


def keyword_gaps(chunks: DataFrame) -> DataFrame:
    """doc_id, present, missing (comma-joined required sections), coverage by section types and words of the whole text."""
    low = F.lower(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_idx", "text"))), lambda x: x["text"]), " "))
    rows = chunks.groupBy("doc_id").agg(F.collect_set("section_type").alias("k"), low.alias("t"))
    said = F.filter(F.array(*[F.when(reduce(lambda a, b: a | b, [F.col("t").contains(w) for w in ws]), k) for k, ws in SECTION_SIGNS]), lambda x: x.isNotNull())
    asked = F.array(*map(F.lit, REQUIRED_SECTIONS))
    rows = rows.select("doc_id", F.array_union("k", said).alias("k")).select("doc_id", F.array_intersect(asked, "k").alias("p"), F.array_except(asked, "k").alias("m"))
    return rows.select("doc_id", F.array_join("p", ",").alias("present"), F.array_join("m", ",").alias("missing"), F.round(F.size("p") / len(REQUIRED_SECTIONS), 3).alias("coverage"))


# What makes a paragraph a heading inside a section.
HEADING_MARK = r"^\s*(?:[IVXLCDM]+\.|\d+(?:\.\d+)*\.?|[A-Z]\.)\s+\S+"
NO_HEADINGS = ("abstract", "references", "bibliography", "works cited")
KNOWN_HEADINGS = ("background", "related work", "literature review", "methodology", "methods", "results", "discussion", "limitations", "conclusion", "future work", "experimental setup", "dataset", "data collection", "evaluation")
HEADING_BARS = (r"\b(et al|doi|http|www|@)\b", r"^(?:o|[-*•])\s+", r"[%~]|(?:accuracy|precision|recall|support|samples?|prediction)\s*:")
CITED_YEAR = r"\([A-Za-z][^)]*,\s*\d{4}[a-z]?\)"


def is_embedded_heading(text: Column) -> Column:
    """At most 120 characters and 10 words without marks of prose or measures: numbered, mostly upper-case, title case, or known."""
    v = single_spaced(text)
    low, n = F.lower(v), F.regexp_count(v, F.lit("[A-Za-z0-9]+"))
    upper, letters = F.regexp_count(v, F.lit(r"\p{Lu}")), F.regexp_count(v, F.lit(r"\p{L}"))
    titled = F.size(F.filter(words(v), lambda w: w.rlike(r"^\p{Lu}")))
    barred = reduce(lambda a, b: a | b, [low.rlike(ascii_rule(p)) for p in HEADING_BARS]) | v.rlike(CITED_YEAR) | v.rlike(r":\s*(?:\d|~)") | (F.regexp_count(v, F.lit("[0-9]")) >= 2) | low.isin(*NO_HEADINGS)
    shape = v.rlike(HEADING_MARK) | (~v.rlike("[.,;:]$") & (((letters > 0) & (upper / F.greatest(letters, F.lit(1)) > 0.65)) | ((n <= 8) & (titled >= F.greatest(F.lit(1), F.floor(F.size(words(v)) / 2)))) | low.isin(*KNOWN_HEADINGS)))
    return (F.length(v) <= 120) & n.between(1, 10) & ~barred & shape


def embedded_headings(paragraphs: DataFrame) -> DataFrame:
    """doc_id, section_idx, sub_idx (from 1), title (null for what precedes the first heading), n_paragraphs, text of sections
    (doc_id, section_idx, para_idx, text) split at heading-like paragraphs after the first; headings without a body go."""
    order = Window.partitionBy("doc_id", "section_idx").orderBy("para_idx")
    rows = paragraphs.withColumn("head", (F.row_number().over(order) > 1) & is_embedded_heading(F.col("text"))).withColumn("island", F.sum(F.col("head").cast("int")).over(order))
    out = rows.groupBy("doc_id", "section_idx", "island").agg(F.max(F.when(F.col("head"), single_spaced(F.col("text")))).alias("title"), F.count_if(~F.col("head")).alias("n_paragraphs"), F.array_sort(F.collect_list(F.when(~F.col("head"), F.struct("para_idx", "text")))).alias("l"))
    out = ranked(out.filter("n_paragraphs > 0"), ["doc_id", "section_idx"], ["island"], "sub_idx")
    return out.select("doc_id", "section_idx", "sub_idx", "title", "n_paragraphs", F.array_join(F.transform("l", lambda x: x["text"]), "\n").alias("text"))


FRONT_MATTER = ("table of contents", "contents", "list of tables", "list of figures")


def clean_heading(text: Column) -> Column:
    """A heading without its number and with single spaces, or as it is if nothing is left."""
    v = F.regexp_replace(F.regexp_replace(F.regexp_replace(strip(text), TITLE_NUMBER, ""), r"\s+", " "), r"^[ _\t-]+|[ _\t-]+$", "")
    return F.when(v != "", v).otherwise(strip(text))


def document_title(blocks: DataFrame, most: int = 30) -> DataFrame:
    """doc_id, title: of the first ``most`` blocks up to three titles and headings within half a point of the largest font, if
    that is a title's or 12 points at least; else the first block of at most 30 words. Metadata lines don't count."""
    early = ranked(blocks, ["doc_id"], ["block_idx"], "nth").filter((F.col("nth") <= most) & (strip(F.col("text")) != ""))
    able = F.col("type").isin("title", "heading") & ~is_marginal(F.col("text"))
    size = F.coalesce("font_size", F.lit(0.0))
    by = Window.partitionBy("doc_id")
    early = early.withColumn("largest", F.max(F.when(able, F.struct(size.alias("size"), (-F.col("nth")).alias("at"), (F.col("type") == "title").alias("t")))).over(by))
    fits = able & (F.abs(size - F.col("largest.size")) <= 0.5) & ((F.col("largest.size") >= 12) | F.col("largest.t"))
    early = early.withColumn("k", F.sum(fits.cast("int")).over(by.orderBy("nth")))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(fits & (F.col("k") <= 3), F.struct("nth", clean_heading(F.col("text")).alias("t"))))), lambda x: x["t"]), " ")
    plain = ~is_marginal(F.col("text")) & (F.size(words(F.col("text"))) <= 30)
    out = early.groupBy("doc_id").agg(joined.alias("a"), F.min_by(F.when(plain, clean_heading(F.col("text"))), F.when(plain, F.col("nth"))).alias("b"))
    return out.select("doc_id", F.when(F.col("a") != "", F.col("a")).otherwise(F.col("b")).alias("title"))


def document_parts(blocks: DataFrame) -> DataFrame:
    """doc_id, block_idx, part, section_idx of blocks (doc_id, block_idx, type, text, font_size) that aren't blank.

    Parts: title, heading, body, table, abstract, keywords, references and dropped. A reference heading, or the first
    ``[n]`` paragraph, begins the references, in which later headings stay unless one is the abstract's. What precedes the
    first heading is dropped, and so are headings that are in the title, and sections of front matter or without body.
    """
    order = Window.partitionBy("doc_id").orderBy("block_idx")
    rows = blocks.filter((strip(F.col("text")) != "") | (F.col("type") == "table")).join(document_title(blocks), "doc_id", "left")
    head, low = F.col("type") == "heading", F.lower(F.col("clean"))
    begin = F.lower(F.substring("s", 1, 40))  # more than any word that is asked for
    rows = rows.withColumn("s", strip(F.col("text"))).withColumn("clean", F.when(head, clean_heading(F.col("text")))).withColumn("in_title", head & F.lower(F.coalesce("title", F.lit(""))).contains(low))
    listed = (F.col("type") == "paragraph") & F.col("s").rlike(r"^\[\d+\]\s+\S+")
    event = F.when(head & ~F.col("in_title"), F.when(low.isin(*REFERENCE_TITLES), "r").when(low == "abstract", "a").otherwise("s")).when(listed, "r")
    rows = rows.withColumn("event", event).withColumn("listed", F.coalesce(F.last(F.when(F.col("event") != "s", F.col("event")), ignorenulls=True).over(order), F.lit("")) == "r")
    rows = rows.withColumn("opens", (F.col("event") == "s") & ~F.col("listed"))
    rows = rows.withColumn("state", F.last(F.when(F.col("opens"), "s").when(F.col("event") == "a", "a"), ignorenulls=True).over(order)).withColumn("section_idx", F.sum(F.coalesce(F.col("opens").cast("int"), F.lit(0))).over(order))
    part = (
        F.when(F.col("type") == "title", "title").when(F.col("in_title"), "dropped").when(head & F.col("event").isin("r", "a"), "dropped").when(F.col("listed"), "references").when(head, "heading")
        .when(F.col("type") == "table", F.when(F.col("state") == "s", "table").otherwise("dropped")).when(begin.startswith("abstract:"), "abstract").when(F.col("s").rlike(KEYWORDS), "keywords")
        .when(F.col("state") == "a", "abstract").when((F.col("state") == "s") & ~begin.isin(*FRONT_MATTER), "body").otherwise("dropped")
    )
    rows = rows.withColumn("part", part)
    section = Window.partitionBy("doc_id", "section_idx")
    full = F.max(F.col("part") == "body").over(section) & ~F.coalesce(F.max(F.when(F.col("part") == "heading", low.isin(*FRONT_MATTER))).over(section), F.lit(False))
    return rows.select("doc_id", "block_idx", F.when(F.col("part").isin("heading", "body", "table") & ~full, "dropped").otherwise(F.col("part")).alias("part"), "section_idx")
