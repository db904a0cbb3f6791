"""Reference entries: splitting, styles, parsing, keys, rendering, conversion of lists and of citations in texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.functions.text import ascii_rule, cosine, ranked, strip
from vellum.operators.similarity import tokens

STYLES = ("APA", "IEEE", "MLA", "Chicago", "Harvard")
# What a reference list of each style has, in the order in which styles are tried.
LIST_STYLES = [("IEEE", r"(?m)^\s*\[\d+\]"), ("APA", r"\(\d{4}\)\."), ("Harvard", r"\w+\s*\(\d{4}\)\s+[A-Z'\"]"), ("MLA", r'"\w[^"]{10,}[.!?]"'), ("Chicago", r"\.\s+[A-Z][a-z]+:\s+\w+,\s+\d{4}")]
# The parts of entries by style.
APA = r"^(.+?)\s*\((\d{4}[a-z]?)\)\.\s*(.+)"
APA_TITLE = r"^([^.]+(?:\.[^.A-Z\s]{1,3}[^\w.]*)*)\.\s*(.*)"
APA_SOURCE = r"([A-Za-z &]+),?\s*(\d+)(?:\((\d+)\))?,?\s*([\d–\-]+)\."
DOI = r"https?://(?:doi\.org/)?(10\.\S+)"
IEEE = r"^\[?\d+\]?\s*(.+)"
IEEE_BODY = r'^((?:[A-Z]\.\s*[A-Z][a-z\'-]+(?:,\s*)?)+(?:and\s*[A-Z]\.\s*[A-Z][a-z\'-]+)?),\s*"(.+?)"[,\.](.+)'
IEEE_PARTS = {"journal": r"^\s*([A-Za-z &.]+?),", "volume": r"(?i)vol\.?\s*(\d+)", "issue": r"(?i)no\.?\s*(\d+)", "pages": r"(?i)pp\.?\s*([\d–\-]+)", "year": r",\s*(\d{4})"}
MLA = r'^([A-Z][a-z\'-]+,\s*[A-Za-z .-]+)\.\s*"([^"]+)"\.\s*([^,]+),?\s*vol\.\s*(\d+)(?:,?\s*no\.\s*(\d+))?\s*\((\d{4})\):\s*([\d–\-]+)\.?'
CHICAGO = r"^([A-Z][a-z'-]+,\s*[A-Za-z .-]+)\.\s*([^.]+)\.\s*([A-Za-z ]+):\s*([^,]+),\s*(\d{4})"
QUOTED_TITLE, NO_TITLE = r'"([^"]{10,})"', r"^[\s()\[\]\d]+$"
# What starts an entry, and what ends one.
ENTRY_START = r"^(?:\[\d+\]|[A-Z][a-z'-]+,\s*|[A-Z]\.\s+[A-Z][a-z'-]+|\d{1,3}\.\s+[A-Z])"
NAME_START = r"^[A-Z][a-z'-]+,\s*"
ENTRY_END = r"[.);\]\"']$|https?://\S+$|\b(?:19|20)\d{2}\b\.?$"
# Headings of reference lists.
HEADINGS = {"APA": "References", "MLA": "Works Cited", "IEEE": "References", "Chicago": "Bibliography", "Harvard": "Reference List"}
# Citations in texts.
COMMA_YEAR = r"\(([A-Za-z][a-z'-]+(?:\s+et\s+al\.)?),\s*(\d{4}[a-z]?)\)"
SPACE_YEAR = r"\(([A-Za-z][a-z'-]+(?:\s+et\s+al\.)?)\s+(\d{4}[a-z]?)\)"
NUMBER_MARK = r"\[(\d+)\]"
# What tells an entry outside a reference list.
SIGNALS = r"\b(?:doi|https?://|arxiv|journal|conference|proceedings|transactions|vol\.|pp\.|pages?)\b|\(\d{4}[a-z]?\)|\b\d{4}\b"
STARTS = r"^(?:\[\d+\]\s+\S|\d+\.\s+\S|[A-Z][A-Za-z'`-]+,\s+[A-Z](?:\.\s*)?)"
YEAR = r"\b(?:19|20)\d{2}\b"
TABLE_SIGNALS = r"(?i)\b(?:doi|https?://|journal|conference|proceedings|transactions|vol\.|pp\.)\b"
TABLE_AUTHORS = r"^[A-Z][A-Za-z'`-]+,\s+[A-Z]|^[A-Z][A-Za-z'`-]+(?:\s+[A-Z][A-Za-z'`-]+){1,3},"
ET_AL = r"(?i)\bet al\.?\b"

FIELDS = ("year", "title", "journal", "volume", "issue", "pages", "publisher", "location", "doi", "type")


def split_reference_block(blocks: DataFrame) -> DataFrame:
    """doc_id, ref_idx, entry of reference lists (doc_id, text).

    Blank lines part entries; else ``[n]`` at a line's start; else each line is an entry if 55 in a hundred look like
    starts; else a line that begins with a name after one that ends an entry begins the next.
    """
    text = strip(F.col("text"))
    flat = lambda xs: F.filter(F.transform(xs, lambda x: strip(F.replace(x, F.lit("\n"), F.lit(" ")))), lambda x: x != "")
    by_blank = F.split(text, r"\n\s*\n")
    by_mark = F.split(F.regexp_replace(text, r"(^|\n)(\s*\[\d+\])", "$1\u0001$2"), "\u0001")
    rows = blocks.select("doc_id", text.alias("t"), by_blank.alias("by_blank"), by_mark.alias("by_mark"), F.filter(F.transform(F.split(text, "\n"), strip), lambda x: x != "").alias("ls"))
    dense = F.size(F.filter("ls", lambda x: x.rlike(ENTRY_START))) / F.size("ls") >= 0.55
    opens = lambda x, i: (i > 0) & x.rlike(NAME_START) & F.get("ls", i - 1).rlike(ascii_rule(ENTRY_END))
    joined = F.split(F.array_join(F.transform("ls", lambda x, i: F.when(opens(x, i), F.concat(F.lit("\u0001"), x)).otherwise(x)), " "), " \u0001")
    entries = F.when(F.size("by_blank") > 1, flat(F.col("by_blank"))).when(F.col("t").rlike(LIST_STYLES[0][1]), flat(F.col("by_mark"))).when(dense, F.col("ls")).otherwise(joined)
    return rows.filter("t <> ''").select("doc_id", F.posexplode(entries).alias("ref_idx", "entry"))


def reference_list_style(blocks: DataFrame, most: int = 2000) -> DataFrame:
    """doc_id, style of reference lists (doc_id, text): the first style whose pattern is in the list's start, or unknown."""
    start = F.substring("text", 1, most)
    return blocks.select("doc_id", F.coalesce(*[F.when(start.rlike(p), s) for s, p in LIST_STYLES], F.lit("unknown")).alias("style"))


def _authors(raw: Column) -> Column:
    """Names of an author list with & or ``and`` before the last; a comma parts names if a surname and a comma follow."""
    one = F.regexp_replace(strip(F.regexp_replace(strip(raw), ",+$", "")), r",?\s*&\s*", "|||")
    one = F.regexp_replace(F.regexp_replace(one, r",?\s+and\s+(?=[A-Z])", "|||"), r",\s+(?=[A-Z][a-z'-]+\s*,)", "|||")
    return F.filter(F.transform(F.split(one, r"\|\|\|"), lambda x: strip(F.regexp_replace(strip(x), ",+$", ""))), lambda x: x != "")


def parse_references(references: DataFrame, styles: DataFrame | None = None) -> DataFrame:
    """doc_id, ref_idx, ref_number, raw, authors (array) and FIELDS, empty where an entry has no such part.

    The parser of the document's style (doc_id, style) comes first, then APA, IEEE, MLA and Chicago until one finds a
    title; the last one takes a quoted title, or the first longer piece between full stops.
    """
    raw = F.when(F.col("ref_number").isNotNull(), F.concat(F.lit("["), F.col("ref_number").cast("string"), F.lit("] "), "text")).otherwise(F.col("text"))
    rows = references.select("doc_id", "ref_idx", "ref_number", raw.alias("raw"))
    rows = rows.join(styles, "doc_id", "left") if styles is not None else rows.withColumn("style", F.lit("unknown"))
    get = lambda c, p, n=1: F.coalesce(F.regexp_extract(c, p, n), F.lit(""))
    part = lambda c, p, n=1: strip(get(c, p, n))

    def record(authors: Column, ok: Column, **known: Column) -> Column:
        own = F.struct(authors.alias("authors"), *[known.get(f, F.lit("")).alias(f) for f in FIELDS])
        return F.when(ok & (known["title"] != ""), own)

    rows = rows.withColumns({"a": part("raw", APA), "ar": get("raw", APA, 3), "i": get("raw", IEEE)})
    titled = F.col("ar").rlike(APA_TITLE) & (part("ar", APA_TITLE) != "")
    rows = rows.withColumns({"at": F.when(titled, part("ar", APA_TITLE)).otherwise(strip(F.col("ar"))), "ar": F.when(titled, get("ar", APA_TITLE, 2)).otherwise("")})
    rows = rows.withColumns({"aj": F.col("ar").rlike(APA_SOURCE), "ib": F.col("i").rlike(IEEE_BODY), "names": _authors(F.col("a"))})
    rows = rows.withColumn("ir", F.when(F.col("ib"), get("i", IEEE_BODY, 3)).otherwise(F.col("i")))
    article = lambda yes: F.when(yes, "article").otherwise("book")
    journal = lambda n: F.when(F.col("aj"), part("ar", APA_SOURCE, n)).otherwise("")
    apa = record(
        F.col("names"), F.col("raw").rlike(APA) & (F.length("a") <= 250) & (F.size("names") > 0), year=get("raw", APA, 2), title=F.col("at"), journal=journal(1), volume=journal(2), issue=journal(3), pages=journal(4),
        publisher=F.when(F.col("aj"), "").otherwise(F.regexp_replace(strip(F.col("ar")), r"\.+$", "")), doi=get("ar", DOI), type=article(F.col("aj")),
    )
    people = F.when(F.col("ib"), F.transform(F.split(get("i", IEEE_BODY), r",\s*(?:and\s*)?"), strip)).otherwise(F.expr("cast(array() as array<string>)"))
    ieee = record(people, F.col("raw").rlike(IEEE), title=F.when(F.col("ib"), part("i", IEEE_BODY, 2)).otherwise(F.substring("i", 1, 80)), type=F.lit("article"), **{k: part("ir", p) for k, p in IEEE_PARTS.items()})
    mla = record(F.array(part("raw", MLA)), F.col("raw").rlike(MLA), type=F.lit("article"), **{k: part("raw", MLA, n) for n, k in enumerate(("title", "journal", "volume", "issue", "year", "pages"), 2)})
    chicago = record(F.array(part("raw", CHICAGO)), F.col("raw").rlike(CHICAGO), type=F.lit("book"), **{k: part("raw", CHICAGO, n) for n, k in enumerate(("title", "location", "publisher", "year"), 2)})
    pieces = F.split("raw", r"\.", -1)
    longer = F.filter(F.transform(F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0))), strip), lambda x: (F.length(x) > 8) & ~x.rlike(NO_TITLE))
    loose = F.when(F.col("raw").contains("."), F.coalesce(F.get(longer, F.lit(0)), strip(F.element_at(pieces, -1)))).otherwise("")
    quoted = get("raw", QUOTED_TITLE)
    known = {"year": get("raw", ascii_rule(YEAR), 0), "title": F.when(quoted != "", quoted).otherwise(loose)}
    last = F.struct(F.array(strip(F.split(F.get(pieces, F.lit(0)), ",")[0])).alias("authors"), *[known.get(f, F.lit("")).alias(f) for f in FIELDS])
    rows = rows.select("doc_id", "ref_idx", "ref_number", "raw", "style", apa.alias("apa"), ieee.alias("ieee"), mla.alias("mla"), chicago.alias("chicago"), last.alias("last"))
    own = F.when(F.col("style").isin("APA", "Harvard"), F.col("apa")).when(F.col("style") == "IEEE", F.col("ieee")).when(F.col("style") == "MLA", F.col("mla")).when(F.col("style") == "Chicago", F.col("chicago"))
    own = F.coalesce(own, F.when(F.col("style") == "unknown", F.when(F.col("last.title") != "", F.col("last"))))
    return rows.select("doc_id", "ref_idx", "ref_number", "raw", F.coalesce(own, "apa", "ieee", "mla", "chicago", "last").alias("r")).select("doc_id", "ref_idx", "ref_number", "raw", "r.*")


def bib_keys(parsed: DataFrame) -> DataFrame:
    """doc_id, ref_idx, bib_key: ``ref`` and number for numbered entries, else surname and year in lower case, or ``unknown`` and position."""
    surname = F.regexp_replace(F.lower(F.split(F.coalesce(F.get("authors", F.lit(0)), F.lit("")), ",")[0]), "[^a-z0-9]", "")
    key = F.when(F.col("ref_number").isNotNull(), F.concat(F.lit("ref"), F.col("ref_number").cast("string"))).when(surname == "", F.concat(F.lit("unknown"), (F.col("ref_idx") + 1).cast("string"))).otherwise(F.concat(surname, "year"))
    return parsed.select("doc_id", "ref_idx", key.alias("bib_key"))


def author_list(authors: Column, style: str) -> Column:
    """Names of an entry as a style joins them, with its own cut-offs."""
    n, first, last = F.size(authors), F.get(authors, F.lit(0)), F.element_at(authors, -1)
    joined = lambda count, by=", ": F.array_join(F.slice(authors, F.lit(1), count), by)
    if style == "MLA":
        out = F.when(n == 1, first).when(n == 2, F.concat(first, F.lit(", and "), F.get(authors, F.lit(1)))).otherwise(F.concat(first, F.lit(", et al.")))
    elif style == "IEEE":
        name = r"^([A-Za-z'-]+),\s*([A-Z])[a-z]*(?:\s*([A-Z])\.?)?"
        second = lambda a: F.when(F.regexp_extract(a, name, 3) != "", F.concat(F.lit(" "), F.regexp_extract(a, name, 3), F.lit("."))).otherwise("")
        turned = F.transform(F.slice(authors, 1, 6), lambda a: F.when(a.rlike(name), F.concat(F.regexp_extract(a, name, 2), F.lit("."), second(a), F.lit(" "), F.regexp_extract(a, name, 1))).otherwise(a))
        return F.array_join(F.when(n > 6, F.concat(turned, F.array(F.lit("et al.")))).otherwise(turned), ", ")
    elif style == "Chicago":
        rest = F.array_join(F.transform(F.slice(authors, F.lit(2), F.greatest(n - 1, F.lit(0))), lambda a: strip(F.split(a, ",")[0])), " ")
        out = F.when(n == 1, first).otherwise(F.concat(first, F.lit(", and "), rest))
    elif style == "Harvard":
        name = r"^([A-Za-z'-]+),\s*([A-Z])"
        short = F.transform(authors, lambda a: F.when(a.rlike(name), F.concat(F.regexp_extract(a, name, 1), F.lit(", "), F.regexp_extract(a, name, 2), F.lit("."))).otherwise(a))
        out = F.when(n <= 2, F.array_join(short, " and ")).otherwise(F.concat(F.array_join(F.slice(short, F.lit(1), F.greatest(n - 1, F.lit(0))), ", "), F.lit(" and "), F.element_at(short, -1)))
    else:
        out = F.when(n == 1, first).when(n <= 6, F.concat(joined(F.greatest(n - 1, F.lit(0))), F.lit(", & "), last)).otherwise(F.concat(joined(F.lit(6)), F.lit(", … "), last))
    return F.when(n > 0, out).otherwise("")


def render(style: str) -> Column:
    """A parsed entry's text in a style."""
    some = lambda c, before="", after="": F.when(F.col(c) != "", F.concat(F.lit(before), F.col(c), F.lit(after))).otherwise("")
    filled = lambda c, other: F.when(F.col(c) != "", F.col(c)).otherwise(other)
    names = author_list(F.col("authors"), style)
    names = F.when(names != "", names).otherwise("Unknown Author" if style == "APA" else "Unknown")
    year, title = filled("year", "n.d."), F.col("title")
    text = lambda *xs: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in xs])
    inside = lambda c, *xs: F.when(F.col(c) != "", text(*xs)).otherwise("")
    if style == "MLA":
        book = text(names, ". *", title, "*. ", F.col("publisher"), ", ", year, ".")
        article = text(names, '. "', title, '". *', F.col("journal"), "*", inside("volume", ", vol. ", F.col("volume"), some("issue", ", no. ")), " (", year, ")", some("pages", ": "), ".")
        return F.when(F.col("type") == "book", book).otherwise(article)
    if style == "IEEE":
        return text(names, ', "', title, ',"', some("journal", " *", "*,"), inside("volume", " vol. ", F.col("volume"), some("issue", ", no. "), ","), some("pages", " pp. ", ","), " ", year, ".", some("doi", " doi: ", "."))
    if style == "Chicago":
        book = text(names, ". *", title, "*.", some("location", " ", ":"), some("publisher", " ", ","), " ", year, ".")
        article = text(names, '. "', title, '." *', F.col("journal"), "*", inside("volume", " ", F.col("volume"), some("issue", ", no. ")), " (", year, ")", some("pages", ": "), ".")
        return text(F.when(F.col("type") == "book", book).otherwise(article), some("doi", " https://doi.org/", "."))
    if style == "Harvard":
        book = text(names, " (", year, ") *", title, "*.", some("publisher", " ", "."))
        article = text(names, " (", year, ") '", title, "', *", F.col("journal"), "*", inside("volume", ", vol. ", F.col("volume"), some("issue", ", no. ")), some("pages", ", pp. "), ".")
        return text(F.when(F.col("type") == "book", book).otherwise(article), some("doi", " doi:", "."))
    place = text(some("location", "", ": "), F.col("publisher"))
    untitled = filled("title", "Untitled")
    book = text(names, " (", year, "). *", untitled, "*.", F.when(place != "", text(" ", place, ".")).otherwise(""))
    article = text(names, " (", year, "). ", untitled, ". *", F.col("journal"), "*", inside("volume", ", *", F.col("volume"), "*", some("issue", "(", ")")), some("pages", ", "), ".")
    return text(F.when(F.col("type") == "book", book).otherwise(article), some("doi", " https://doi.org/"))


def convert_bibliography(parsed: DataFrame, style: str) -> DataFrame:
    """doc_id, place, entry: a document's list in a style; place 0 is its heading.

    Entries that are equal but for case and spaces count once, the first. What has neither authors, title nor year stays as
    it is. IEEE entries are numbered in order; others are in alphabetical order, without regard to a leading number.
    """
    key = F.lower(strip(F.regexp_replace("raw", r"\s+", " ")))
    once = ranked(parsed.withColumn("k", key), ["doc_id", "k"], ["ref_idx"], "nth").filter("nth = 1")
    names = F.lower(author_list(F.col("authors"), "APA"))
    failed = names.isin("", "unknown author") & F.lower("title").isin("", "untitled") & F.lower("year").isin("", "n.d.")
    shown = strip(render(style))
    once = once.select("doc_id", "ref_idx", F.when(~failed & (F.length(shown) >= 10), shown).otherwise(strip(F.col("raw"))).alias("entry"))
    if style == "IEEE":
        once = ranked(once, ["doc_id"], ["ref_idx"], "place")
        once = once.withColumn("entry", F.when(F.col("entry").rlike(r"^\[\d+\]"), F.col("entry")).otherwise(F.concat(F.lit("["), F.col("place").cast("string"), F.lit("] "), "entry")))
    else:
        once = ranked(once, ["doc_id"], [F.lower(F.regexp_replace("entry", r"^[\[(]?\d+[\])]?\s*", "")), "ref_idx"], "place")
    line = lambda place, entry: F.struct(place.cast("int").alias("place"), entry.alias("entry"))
    own = line(F.col("place"), F.col("entry"))
    lines = F.when(F.col("place") == 1, F.array(line(F.lit(0), F.lit(HEADINGS[style])), own)).otherwise(F.array(own))
    return once.select("doc_id", F.explode(lines).alias("l")).select("doc_id", "l.*")


def _surname(authors: Column) -> Column:
    """The part before a comma of the first author, or the last word without one."""
    first = F.get(authors, F.lit(0))
    return strip(F.when(first.contains(","), F.split(first, ",")[0]).otherwise(F.element_at(F.split(strip(first), r"\s+"), -1)))


def convert_in_text(docs: DataFrame, parsed: DataFrame, target: str) -> DataFrame:
    """doc_id, text with its citations in the target style; marks without an entry stay as they are.

    For IEEE an author and a year become the entry's place in the list (of equals the last); for others numbers become
    author and year, and the comma between the two goes or comes.
    """
    cited = parsed.filter((F.size("authors") > 0) & (F.get("authors", F.lit(0)) != "") & (F.col("year") != ""))
    n = F.col("ref_idx") + 1
    if target == "IEEE":
        keys = cited.groupBy("doc_id", F.concat_ws(",", strip(F.split(F.col("authors")[0], ",")[0]), "year").alias("k")).agg(F.max(n).cast("string").alias("v"))
    else:
        comma = ", " if target in ("APA", "Chicago") else " "
        keys = cited.select("doc_id", n.cast("string").alias("k"), F.concat(F.lit("("), _surname(F.col("authors")), F.lit(comma), "year", F.lit(")")).alias("v"))
    maps = keys.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("m"))
    rows = docs.select("doc_id", "text").join(maps, "doc_id", "left")

    def replaced(text: Column, pattern: str, value) -> Column:
        marks = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), value)
        return F.array_join(F.zip_with(F.split(text, pattern, -1), marks, lambda gap, m: F.concat(gap, F.coalesce(m, F.lit("")))), "")

    group = lambda x, p, k: strip(F.regexp_extract(x, p, k))
    if target == "IEEE":
        mark = lambda x: F.get(F.array(F.element_at("m", F.concat_ws(",", group(x, COMMA_YEAR, 1), group(x, COMMA_YEAR, 2)))), F.lit(0))
        return rows.select("doc_id", replaced(F.col("text"), COMMA_YEAR, lambda x: F.coalesce(F.concat(F.lit("["), mark(x), F.lit("]")), x)).alias("text"))
    rows = rows.withColumn("text", replaced(F.col("text"), NUMBER_MARK, lambda x: F.coalesce(F.element_at("m", F.regexp_extract(x, NUMBER_MARK, 1)), x)))
    if target in ("APA", "Chicago"):
        return rows.select("doc_id", F.regexp_replace("text", SPACE_YEAR, "($1, $2)").alias("text"))
    return rows.select("doc_id", F.regexp_replace("text", COMMA_YEAR, "($1 $2)").alias("text"))


def citation_scores(unmatched: DataFrame, references: DataFrame) -> DataFrame:
    """doc_id, cit_idx, ref_idx, score of pairs of a document that share a word of an entry."""
    query = strip(F.concat_ws(" ", F.nullif(F.col("author"), F.lit("")), F.nullif(F.col("year_or_page"), F.lit("")), F.nullif(strip(F.replace("context", F.col("text"), F.lit(""))), F.lit(""))))
    counted = lambda df, keys, text: df.select(*keys, F.explode(tokens(text)).alias("token")).groupBy(*keys, "token").agg(F.count(F.lit(1)).alias("tf"))
    entries = counted(references, ["doc_id", "ref_idx"], F.col("text"))
    n = references.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    idf = entries.groupBy("doc_id", "token").agg(F.count(F.lit(1)).alias("df")).join(n, "doc_id").select("doc_id", "token", (F.log((1.0 + F.col("n")) / (1.0 + F.col("df"))) + 1).alias("idf"))

    def unit(df: DataFrame, key: str, name: str) -> DataFrame:
        w = df.join(idf, ["doc_id", "token"]).withColumn("w", F.col("tf") * F.col("idf"))
        return w.select("doc_id", key, "token", (F.col("w") / F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("doc_id", key)))).alias(name))

    both = unit(counted(unmatched, ["doc_id", "cit_idx"], query), "cit_idx", "v").join(unit(entries, "ref_idx", "w"), ["doc_id", "token"])
    return both.groupBy("doc_id", "cit_idx", "ref_idx").agg(F.round(F.sum(F.col("v") * F.col("w")), 4).alias("score"))


def best_references(scores: DataFrame, least: float) -> DataFrame:
    """Of each citation the entry of largest score, the first of equal ones, if it reaches ``least``."""
    best = scores.groupBy("doc_id", "cit_idx").agg(F.max(F.struct("score", (-F.col("ref_idx")).alias("at"))).alias("m"))
    return best.select("doc_id", "cit_idx", (-F.col("m.at")).alias("ref_idx"), F.col("m.score").alias("score")).filter(F.col("score") >= least)


def semantic_citation_match(unmatched: DataFrame, references: DataFrame, least: float = 0.30) -> DataFrame:
    """doc_id, cit_idx, ref_idx, score (4 digits): for citations without a match the most similar entry of their document, if it
    reaches ``least``.

    A citation stands for its author, year and context without its mark. Cosine of TF-IDF fitted on the document's entries;
    other words of a citation don't count. Of equal scores the first entry counts.
    """
    return best_references(citation_scores(unmatched, references), least)


def vector_citation_match(unmatched: DataFrame, references: DataFrame, citation_vectors: DataFrame, reference_vectors: DataFrame, least: float = 0.30) -> DataFrame:
    """``semantic_citation_match`` with vectors of one's own: doc_id, cit_idx, ref_idx, score.

    ``citation_vectors`` has (doc_id, cit_idx, embedding), ``reference_vectors`` (doc_id, ref_idx, embedding). Pairs of which
    both have a vector (of one length, not null) are compared by it, all others by TF-IDF; the best of all pairs counts, the
    first entry of equal ones.
    """
    cits = unmatched.select("doc_id", "cit_idx").join(citation_vectors.filter("embedding is not null").select("doc_id", "cit_idx", F.col("embedding").alias("x")), ["doc_id", "cit_idx"])
    refs = references.select("doc_id", "ref_idx").join(reference_vectors.filter("embedding is not null").select("doc_id", "ref_idx", F.col("embedding").alias("y")), ["doc_id", "ref_idx"])
    score = F.round(cosine(F.col("x"), F.col("y")), 4)
    dense = cits.join(refs, "doc_id").filter("size(x) = size(y)").select("doc_id", "cit_idx", "ref_idx", score.alias("score"))
    sparse = citation_scores(unmatched, references).join(dense.select("doc_id", "cit_idx", "ref_idx"), ["doc_id", "cit_idx", "ref_idx"], "left_anti")
    return best_references(dense.unionByName(sparse.select(*dense.columns)), least)


def reference_like_rows(rows: DataFrame) -> DataFrame:
    """The rows of ``rows`` (with text) and is_reference: at least 35 characters that begin like an entry and have a bibliographic sign."""
    v = strip(F.regexp_replace("text", r"\s+", " "))
    return rows.withColumn("is_reference", (F.length(v) >= 35) & v.rlike(STARTS) & (F.lower(v).rlike(ascii_rule(SIGNALS))))


def reference_tables(rows: DataFrame) -> DataFrame:
    """table_id, n_rows, is_reference_table of rows (table_id, row_idx, text): the first four rows together or the first row
    read like entries, or two of the first eight do. Blank rows don't count."""
    v = strip(F.regexp_replace("text", r"\s+", " "))
    rows = ranked(rows.select("table_id", "row_idx", v.alias("v")).filter("v <> ''"), ["table_id"], ["row_idx"], "nth")
    commas = lambda x: F.length(x) - F.length(F.replace(x, F.lit(","), F.lit("")))
    v, dated, signal = F.col("v"), F.col("v").rlike(ascii_rule(YEAR)), F.col("v").rlike(ascii_rule(TABLE_SIGNALS))
    like = (F.length(v) > 70) & dated & (v.rlike(TABLE_AUTHORS) | (commas(v) >= 3) | signal)
    first = (F.length(v) > 90) & dated & ((commas(v) >= 3) | v.rlike(ascii_rule(ET_AL)) | signal)
    out = rows.groupBy("table_id").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if((F.col("nth") <= 8) & like).alias("n"), F.max((F.col("nth") == 1) & first).alias("f"), F.array_sort(F.collect_list(F.when(F.col("nth") <= 4, F.struct("nth", "v")))).alias("l"),
    )
    out = out.withColumn("v", F.array_join(F.transform("l", lambda x: x["v"]), " "))
    head = (F.length(v) > 120) & dated & ((commas(v) >= 4) | v.rlike(ascii_rule(ET_AL)) | signal)
    return out.select("table_id", "n_rows", (head | (F.col("n") >= 2) | F.col("f")).alias("is_reference_table"))


def export_bibliography(parsed: DataFrame) -> DataFrame:
    """doc_id, bibtex: one text for each document; empty fields are left out and braces are escaped."""
    fields = ("names", "title", "journal", "year", "volume", "issue", "pages", "publisher", "location", "doi")
    names = ("author", "title", "journal", "year", "volume", "number", "pages", "publisher", "address", "doi")
    safe = lambda c: F.regexp_replace(c, r"([{}])", r"\\\\$1")
    lines = F.filter(F.array(*[F.when(F.col(c) != "", F.concat(F.lit(f"  {n} = {{"), safe(c), F.lit("}"))) for c, n in zip(fields, names, strict=True)]), lambda x: x.isNotNull())
    rows = parsed.filter("title <> ''").withColumn("names", F.array_join("authors", " and ")).join(bib_keys(parsed), ["doc_id", "ref_idx"])
    kind = F.when(F.col("type") == "book", "@book{").otherwise("@article{")
    entry = F.concat(kind, "bib_key", F.lit(",\n"), F.array_join(lines, ",\n"), F.lit("\n}"))
    texts = rows.select("doc_id", F.struct("ref_idx", entry.alias("e")).alias("e")).groupBy("doc_id").agg(F.array_sort(F.collect_list("e")).alias("l"))
    return texts.select("doc_id", F.array_join(F.transform("l", lambda x: x["e"]), "\n\n").alias("bibtex"))


def missing_cite_keys(texts: DataFrame, bib: DataFrame) -> DataFrame:
    """doc_id, cite_key, first_pos: keys of ``\\cite`` commands that the bibliography (doc_id, cite_key) lacks, once each."""
    marks = F.regexp_extract_all("text", F.lit(r"\\cite[a-z]*\*?\{([^}]*)\}"), F.lit(1))
    keys = F.transform(F.flatten(F.transform(marks, lambda m: F.split(m, ","))), lambda k: F.trim(k))
    rows = texts.select("doc_id", F.posexplode(keys).alias("pos", "cite_key")).filter("cite_key <> ''")
    return rows.join(bib, ["doc_id", "cite_key"], "left_anti").groupBy("doc_id", "cite_key").agg(F.min("pos").alias("first_pos"))


def markup_counts(texts: DataFrame) -> DataFrame:
    """doc_id, brace_balance, odd_dollars, empty_cites of LaTeX texts."""
    n = lambda c: F.length("text") - F.length(F.replace("text", F.lit(c), F.lit("")))
    return texts.select("doc_id", (n("{") - n("}")).alias("brace_balance"), (n("$") % 2 == 1).alias("odd_dollars"), F.regexp_count("text", F.lit(r"\\cite[a-z]*\*?\{\s*\}")).alias("empty_cites"))
