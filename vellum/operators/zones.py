"""Lines and blocks by what they look like: contents lists, page zones, block types, front matter, pages, outlines."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.functions.text import ascii_rule, lower_letters, strip, words
from vellum.sources.corpus import written_once

# Headings of contents lists, bare page numbers, and what fills the space before a page number.
CONTENTS = r"(?i)^(?:table\s+of\s+contents|contents)$"
LISTS = r"(?i)^(?:table\s+of\s+contents|contents|list\s+of\s+(?:figures|tables))$"
PAGE_NUMBER = r"(?i)^(?:\d{1,4}|[ivxlc]{1,6})$"
LEADERS = "[._·…]{3,}"
# What tells a line of metadata.
MARGIN_WORDS = ("doi:", "http://", "https://", "www.", "@", "copyright", "creative commons")
MARGIN_STARTS = (r"^(received|revised|accepted|published)\s*:", r"^(how to cite this paper|article|correspondence|\*correspondence)\b")
MARGIN_PLACES = r"\b(department|university|institute|school|college|usa|inc)\b"
MARGIN_ONLY = r"^[,.\d\s*]+$"
# Shapes of list items, reference entries and headings.
BULLET = r"^(?:[•\-*◦▪–]|[a-zA-Z0-9ivxlcdm]{1,3}[).:])"
NUMBERED = r"^\d+[.):\-]\s+"
ENTRY = r"^(?:\[\d+\]|[A-Z][a-z]+,?\s+[A-Z]\.?.*\(\d{4}\))"
NUMBERED_HEADING = r"^\d+(\.\d+)*\s+[A-Z]"
KEYWORDS = r"(?i)^keywords?\s*[:.-]\s*(.+)$"
# Titles of an outline.
REFERENCE_TITLES = ("references", "bibliography", "works cited")
MAJOR_TITLES = (
    "abstract", "introduction", "background", "related work", "literature review", "review of literature", "review of the literature", "method", "methods", "methodology",
    "materials and methods", "research methodology", "results", "findings", "discussion", "conclusion", "conclusions", "references", "bibliography", "works cited",
    "acknowledgment", "acknowledgments", "acknowledgement", "acknowledgements",
)
TITLE_NUMBER = r"(?i)^\s*(?:[ivxlcdm]+\.|[a-z]\.|chapter\s+\d+\s*:|\d+(?:\.\d+)*\.?)\s*"
QUESTION = r"^(?:who|what|when|where|why|how|can|could|should|would|does|do|did|is|are|in what|to what)\b"
MEASURES = r"[%~]|(?:accuracy|precision|recall|support|samples?)\s*:"


def single_spaced(x: Column) -> Column:
    return strip(F.regexp_replace(x, r"\s+", " "))


def is_toc_line(line: Column) -> Column:
    """A contents heading, a page number alone, or at most 15 words beside one that don't end like a sentence."""
    s = strip(line)
    w = words(F.regexp_replace(s, LEADERS, " "))
    n = F.size(w)
    ends = F.coalesce(F.get(w, n - 1).rlike(r"^\d{1,4}$"), F.lit(False))
    starts = F.coalesce(F.get(w, F.lit(0)).rlike(r"^\d{1,4}$"), F.lit(False)) & (n >= 2)
    last = F.when(ends, F.get(w, n - 2)).otherwise(F.get(w, n - 1))
    return s.rlike(LISTS) | s.rlike(PAGE_NUMBER) | ((ends | starts) & (n <= 16) & ~F.coalesce(last.rlike("[.!?]$"), F.lit(False)))


def toc_lines(lines: DataFrame) -> DataFrame:
    """The rows of ``lines`` (doc_id, line_no, line) that aren't blank, with is_toc."""
    return lines.filter(strip(F.col("line")) != "").withColumn("is_toc", is_toc_line(F.col("line")))


def toc_units(lines: DataFrame, keys: tuple[str, ...] = ("doc_id", "page")) -> DataFrame:
    """keys, n_lines, n_toc, has_heading, is_toc of units of at least 5 lines and 10 words: with a contents heading among
    the first 5 lines two in five lines have to be contents lines, else 55 in a hundred."""
    rows = toc_lines(lines).withColumn("nth", F.row_number().over(Window.partitionBy(*keys).orderBy("line_no")))
    out = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_lines"), F.count_if("is_toc").alias("n_toc"), F.max((F.col("nth") <= 5) & strip(F.col("line")).rlike(CONTENTS)).alias("has_heading"), F.sum(F.size(words(F.col("line")))).alias("n_words"),
    )
    enough = (F.col("n_lines") >= 5) & (F.col("n_words") >= 10)
    return out.select(*keys, "n_lines", "n_toc", "has_heading", (enough & (F.col("n_toc") / F.col("n_lines") >= F.when(F.col("has_heading"), 0.40).otherwise(0.55))).alias("is_toc"))


def is_marginal(line: Column, spaced: Column | None = None, lower: Column | None = None) -> Column:
    """The text of a line tells metadata: addresses, dates of receipt, institutions, journals with a year, numbers only.

    ``spaced`` and ``lower`` are columns that hold the line with single spaces and that in lower case, so that they aren't made again
    for each rule. A line without any word of a rule isn't searched by it.
    """
    v = single_spaced(line) if spaced is None else spaced
    low = F.lower(v) if lower is None else lower
    found = reduce(lambda a, b: a | b, [low.contains(w) for w in MARGIN_WORDS]) | v.rlike(MARGIN_ONLY)
    for p in MARGIN_STARTS:
        found = found | low.rlike(ascii_rule(p))
    places = reduce(lambda a, b: a | b, [low.contains(w) for w in MARGIN_PLACES.split("(")[1].split(")")[0].split("|")])
    found = found | (places & low.rlike(ascii_rule(MARGIN_PLACES)) & (F.size(words(v)) <= 14))
    return (v != "") & (found | (low.contains("journal") & low.rlike(ascii_rule(r"\bjournal\b")) & low.rlike(ascii_rule(r"\b20\d{2}\b"))))


def line_zones(lines: DataFrame) -> DataFrame:
    """doc_id, line_no, zone: header, footer, marginalia, sidebar or main_body.

    ``lines`` has (doc_id, line_no, line, repeated) and geometry (page_width, page_height, x0, x1, top, bottom), of which
    nulls decide nothing.
    """
    yes = lambda c: F.coalesce(c, F.lit(False))
    header = yes(F.col("repeated")) | yes(F.col("top") <= F.col("page_height") * 0.07)
    footer = yes(F.col("bottom") >= F.col("page_height") * 0.93) | strip(F.col("line")).rlike(r"(?i)^(?:page\s*)?\d{1,4}$")
    middle = (F.col("x0") + F.col("x1")) / 2 / F.col("page_width")
    sidebar = yes(((F.col("x1") - F.col("x0")) / F.col("page_width") <= 0.26) & ((middle <= 0.18) | (middle >= 0.82)))
    lines = lines.withColumn("_spaced", single_spaced(F.col("line"))).withColumn("_low", F.lower("_spaced"))
    marginal = is_marginal(F.col("line"), F.col("_spaced"), F.col("_low"))
    return lines.select("doc_id", "line_no", F.when(header, "header").when(footer, "footer").when(marginal, "marginalia").when(sidebar, "sidebar").otherwise("main_body").alias("zone"))


ZONES = ("header", "footer", "marginalia", "sidebar", "main_body")


def zone_counts(zones: DataFrame) -> DataFrame:
    """doc_id and the number of lines in each zone."""
    return zones.groupBy("doc_id").pivot("zone", list(ZONES)).count().na.fill(0)


def _block_kind(modal: Column) -> Column:
    """The type of a block with the columns _s (its text, stripped) and _n (number of words)."""
    text, size = F.col("_s"), F.col("font_size")
    n, chars = F.col("_n"), F.length(text)
    heading = (size > modal + 1.5) | ((n <= 10) & (chars <= 80) & text.rlike(NUMBERED_HEADING)) | (F.col("is_bold") & n.between(2, 8))
    return (
        F.when(chars < 3, "unknown").when((chars < 80) & (n < 15) & text.rlike(r"\d+\s*$"), "running_header").when((F.col("page") == 1) & (size > 16), "title_page").when(heading, "heading")
        .when(text.rlike(BULLET), "bullet_list").when(text.rlike(NUMBERED), "numbered_list").when(text.rlike(ENTRY), "reference_entry").when(text.startswith('"'), "block_quote").otherwise("paragraph")
    )


def typed_blocks(blocks: DataFrame, usual: float = 12.0) -> DataFrame:
    """doc_id, block_idx, type, level (of headings) of blocks (doc_id, block_idx, text, font_size, is_bold, page).

    Blocks are first told apart with the usual font size, then with the document's own: the most frequent rounded size of
    its paragraphs (of equals the one that comes first), or the mean of all sizes outside title pages.
    """
    # Rules ask for up to 15 words, so a text isn't cut to more than 20 pieces. Three steps read the blocks.
    blocks = blocks.withColumn("_s", strip(F.col("text"))).withColumn("_n", F.size(F.filter(F.split("_s", r"\s+", 20), lambda w: w != "")))
    first = blocks = written_once(blocks.withColumn("kind", _block_kind(F.lit(usual))))
    sized = first.filter("font_size > 0")
    counts = sized.filter("kind = 'paragraph'").groupBy("doc_id", F.bround("font_size").alias("size")).agg(F.count(F.lit(1)).alias("n"), F.min("block_idx").alias("at"))
    modal = counts.groupBy("doc_id").agg(F.max(F.struct("n", (-F.col("at")).alias("at"), "size")).alias("m")).select("doc_id", F.col("m.size").alias("modal"))
    mean = sized.filter("kind <> 'title_page'").groupBy("doc_id").agg(F.avg("font_size").alias("mean"))
    rows = blocks.drop("kind").join(modal, "doc_id", "left").join(mean, "doc_id", "left").withColumn("modal", F.coalesce("modal", "mean", F.lit(usual)))
    text, size = F.col("_s"), F.col("font_size")
    number = F.when(text.rlike(r"^\d+\.\d"), 2).when(text.rlike(r"^\d"), 1)
    level = F.coalesce(number, F.when(size >= F.col("modal") + 3, 1).when(size >= F.col("modal") + 1, 2).otherwise(3))
    rows = rows.withColumn("type", _block_kind(F.col("modal")))
    return rows.select("doc_id", "block_idx", "type", F.when(F.col("type") == "heading", level).alias("level"))


def merge_paragraphs(blocks: DataFrame) -> DataFrame:
    """doc_id, block_idx, type, n_merged, text: a paragraph that goes on with the one before joins it; only pairs join, so
    that of a chain of such paragraphs the third begins anew."""
    order = Window.partitionBy("doc_id").orderBy("block_idx")
    goes_on = (F.col("type") == "paragraph") & F.coalesce("continues_from_prev", F.lit(False)) & (F.coalesce(F.lag("type").over(order), F.lit("")) == "paragraph")
    rows = blocks.withColumn("chain", F.sum((~goes_on).cast("int")).over(order))
    rows = rows.withColumn("pair", F.floor((F.row_number().over(Window.partitionBy("doc_id", "chain").orderBy("block_idx")) - 1) / 2))
    out = rows.groupBy("doc_id", "chain", "pair").agg(F.min("block_idx").alias("block_idx"), F.first("type").alias("type"), F.count(F.lit(1)).alias("n_merged"), F.array_sort(F.collect_list(F.struct("block_idx", "text"))).alias("l"))
    return out.select("doc_id", "block_idx", "type", "n_merged", F.array_join(F.transform("l", lambda x: x["text"]), " ").alias("text"))


def list_texts(groups: DataFrame) -> DataFrame:
    """doc_id, first_block, type, n_blocks, text of grouped list items (see ``layout.group_runs``): bullets before the items
    of a bullet list, new numbers before those of a numbered one."""
    items = F.split("text", "\n")
    bullets = F.array_join(F.transform(items, lambda x: F.concat(F.lit("• "), x)), "\n")
    numbers = F.array_join(F.transform(items, lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x)), "\n")
    return groups.withColumn("text", F.when(F.col("type") == "bullet_list", bullets).when(F.col("type") == "numbered_list", numbers).otherwise(F.col("text")))


def front_matter(lines: DataFrame, most: int = 80) -> DataFrame:
    """doc_id, authors, affiliation, abstract, keywords, footnotes of every document with lines (doc_id, line_no from 1, line).

    Within the first ``most`` lines: the abstract goes from its ``#`` heading to a blank line or the next heading, after
    which nothing counts; of other lines the last ``keywords:`` line counts, the first of at most 12 words with a comma
    names the authors, and the next of at most 20 words without @ the affiliation. Footnotes are counted in all lines.
    """
    order = Window.partitionBy("doc_id").orderBy("line_no")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    s = F.col("s")
    rows = lines.select("doc_id", "line_no", strip(F.col("line")).alias("s"))
    notes = rows.groupBy("doc_id").agg(F.count_if(s.rlike(r"^\[\^.+\]:")).alias("footnotes"))
    rows = rows.filter(F.col("line_no") <= most).withColumn("head", s.startswith("#")).withColumn("opens", F.col("head") & (F.lower(strip(F.regexp_replace("s", "^#+", ""))) == "abstract"))
    rows = rows.withColumn("inside", F.max("opens").over(so_far)).withColumn("keys", s.rlike(KEYWORDS))
    own = F.col("inside") & ~F.col("head") & ~F.col("keys") & (s != "")
    rows = rows.withColumn("filled", F.max(own).over(so_far))
    stops = F.col("inside") & (((s == "") & F.col("filled")) | (F.col("head") & ~F.col("opens")))
    rows = rows.withColumn("stopped", F.max(stops).over(so_far)).filter(~F.col("stopped") & (s != "") & ~F.col("opens"))
    rows = rows.withColumn("abstract", F.col("inside") & ~F.col("keys"))
    named = ~F.col("keys") & ~F.col("inside") & (F.size(words(s)) <= 12) & s.contains(",") & s.rlike("[^,\\s]")
    rows = rows.withColumn("author_line", F.min(F.when(named, F.col("line_no"))).over(Window.partitionBy("doc_id")))
    place = ~F.col("keys") & ~F.col("inside") & (F.col("line_no") > F.col("author_line")) & (F.size(words(s)) <= 20) & ~s.contains("@")
    parts = lambda x, by: F.array_join(F.filter(F.transform(F.split(x, by), strip), lambda p: p != ""), "; ")
    out = rows.groupBy("doc_id").agg(
        F.max(F.when(F.col("line_no") == F.col("author_line"), s)).alias("a"), F.min_by(F.when(place, s), F.when(place, F.col("line_no"))).alias("affiliation"),
        F.array_sort(F.collect_list(F.when(F.col("abstract"), F.struct("line_no", "s")))).alias("l"), F.max_by(F.when(F.col("keys"), F.regexp_extract("s", KEYWORDS, 1)), F.when(F.col("keys"), F.col("line_no"))).alias("k"),
    )
    out = notes.join(out, "doc_id", "left")
    text = F.array_join(F.transform("l", lambda x: x["s"]), " ")
    return out.select("doc_id", parts(F.col("a"), ",").alias("authors"), "affiliation", F.when(text != "", text).alias("abstract"), parts(F.col("k"), "[;,]").alias("keywords"), "footnotes")


def page_key(text: Column, most: int = 1200) -> Column:
    """Letters, digits and single spaces of a text's start, in lower case."""
    spaced = F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))
    return F.substring(F.regexp_replace(spaced, r"[^\p{Alnum} ]+", ""), 1, most)  # ASCII; ten times as fast as ranges of letters


def page_ranges(sections: DataFrame, blocks: DataFrame, start: int = 180) -> DataFrame:
    """doc_id, section_idx, page_start, page_end: pages of the blocks that are inside a section's text, or that hold its start."""
    # Written, so that a key is made once, and not again for each filter and pair.
    a = written_once(sections.select("doc_id", "section_idx", page_key(F.col("text")).alias("whole"))).filter("whole <> ''").withColumn("head", F.substring("whole", 1, start))
    b = written_once(blocks.filter("page_start > 0").select("doc_id", page_key(F.col("text")).alias("part"), "page_start", "page_end")).filter("part <> ''")
    inside = F.when(F.length("part") <= F.length("whole"), F.col("whole").contains(F.col("part"))).otherwise(False) | F.col("part").contains(F.col("head"))
    return a.join(b, "doc_id").filter(inside).groupBy("doc_id", "section_idx").agg(F.min("page_start").alias("page_start"), F.max(F.greatest("page_start", "page_end")).alias("page_end"))


def generic_sections(lines: DataFrame, matched: DataFrame) -> DataFrame:
    """doc_id, start, end, heading: headings that ``matched`` (doc_id, start) doesn't have, from lines (doc_id, line_no, line, at).

    Upper-case lines of under 12 words, and capitalised ones of under 12 before a longer line of at least 5. They go to the
    next matched, numbered or upper-case line of under 12 words, or the text's end.
    """
    order = Window.partitionBy("doc_id").orderBy("line_no")
    s, n = F.col("s"), F.col("n")
    rows = lines.withColumn("total", F.sum(F.length("line") + 1).over(Window.partitionBy("doc_id")) - 1).select("doc_id", "line_no", "total", strip(F.col("line")).alias("s"), (F.col("at") + F.length(F.regexp_extract("line", r"^(\s*)", 1))).alias("start"), F.col("at"))
    rows = rows.filter("s <> ''").withColumn("n", F.size(words(s))).join(matched.select("doc_id", F.col("start").alias("at"), F.lit(True).alias("known")), ["doc_id", "at"], "left")
    capitals = s.rlike(r"\p{Lu}") & ~s.rlike(r"\p{Ll}")
    rows = rows.withColumn("following", F.lead("n").over(order))
    head = (capitals & (n < 12)) | ((n < 12) & s.rlike(r"^\p{Lu}") & (F.col("following") > n) & (F.col("following") >= 5))
    bound = (n < 12) & (F.col("known") | s.rlike(r"^\d+(\.\d+)*\s+") | capitals)
    rows = rows.withColumn("end", F.min(F.when(F.coalesce(bound, F.lit(False)), F.col("start"))).over(order.rowsBetween(1, Window.unboundedFollowing)))
    return rows.filter(F.col("known").isNull() & F.coalesce(head, F.lit(False))).select("doc_id", "start", F.coalesce("end", "total").alias("end"), s.alias("heading"))


def toc_alignment(toc: DataFrame, chunks: DataFrame) -> DataFrame:
    """doc_id, toc_entries, matched, missing (texts in order, joined by |), coverage: entries of a contents list (doc_id,
    toc_idx, text) whose text is a chunk's heading but for case and spaces; of equal headings the last counts."""
    key = lambda c: lower_letters(single_spaced(F.col(c)))
    heads = chunks.filter("heading <> ''").groupBy("doc_id", key("heading").alias("k")).agg(F.max_by("section_type", "chunk_idx").alias("section_type"))
    rows = toc.filter(strip(F.col("text")) != "").select("doc_id", "toc_idx", strip(F.col("text")).alias("text"), key("text").alias("k")).join(heads, ["doc_id", "k"], "left")
    listed = lambda own, value: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(own, F.struct("toc_idx", F.col(value).alias("t"))))), lambda x: x["t"]), "|")
    hit = F.col("section_type").isNotNull()
    out = rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("toc_entries"), listed(hit, "section_type").alias("matched"), listed(~hit, "text").alias("missing"), (F.floor(F.count_if(hit) / F.count(F.lit(1)) * 1000 + 0.5) / 1000).alias("coverage"))
    return chunks.select("doc_id").distinct().join(out, "doc_id", "left").na.fill({"toc_entries": 0, "matched": "", "missing": "", "coverage": 0.0})


def normal_title(title: Column) -> Column:
    """A title without its number, in lower case, with single spaces."""
    return F.lower(F.regexp_replace(F.regexp_replace(F.regexp_replace(title, TITLE_NUMBER, ""), r"\s+", " "), r"^[ .:-]+|[ .:-]+$", ""))


def is_false_heading(title: Column) -> Column:
    """Quotations, questions, measures, and titles of more than 11 words that aren't a major section's."""
    v = single_spaced(title)
    low = F.lower(v)
    quoted = v.rlike("^[\"'].*[\"']$") | v.isin('"', "'")
    return (v == "") | quoted | v.endswith("?") | low.rlike(r"^prediction\s*:") | low.rlike(MEASURES) | low.rlike(ascii_rule(QUESTION)) | ((F.size(words(v)) > 11) & ~normal_title(v).isin(*MAJOR_TITLES))


def outline_roles(sections: DataFrame) -> DataFrame:
    """doc_id, section_idx, role of sections (doc_id, section_idx, title) whose titles aren't empty: reference_heading,
    paragraph_false_positive, heading_1 (a document's first other section, and major ones) or heading_2."""
    rows = sections.withColumn("k", normal_title(F.col("title"))).filter("k <> ''")
    kind = F.when(F.col("k").isin(*REFERENCE_TITLES), "reference_heading").when(is_false_heading(F.col("title")), "paragraph_false_positive")
    rows = rows.withColumn("kind", kind)
    first = F.min(F.when(F.col("kind").isNull(), F.col("section_idx"))).over(Window.partitionBy("doc_id"))
    role = F.coalesce("kind", F.when((F.col("section_idx") == first) | F.col("k").isin(*MAJOR_TITLES), "heading_1").otherwise("heading_2"))
    return rows.select("doc_id", "section_idx", role.alias("role"))
