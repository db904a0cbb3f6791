"""Segmentation: documents to sentences, chunks, lines and blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.functions.text import strip, words


def sentences(text: Column, mode: str) -> Column:
    """Array of a text's sentences.

    ``punct`` cuts at white space after ``.``, ``!`` or ``?``; ``period`` cuts at every ``.`` and puts it
    back; ``any`` cuts at runs of the three and drops them. The three give different pieces on purpose.
    """
    if mode == "punct":
        return F.filter(F.split(strip(text), r"(?<=[.!?])\s+"), lambda s: s != "")
    pieces = F.filter(F.transform(F.split(text, r"\." if mode == "period" else "[.!?]+"), strip), lambda s: s != "")
    return F.transform(pieces, lambda s: F.concat(s, F.lit("."))) if mode == "period" else pieces


def explode_sentences(docs: DataFrame, mode: str = "punct") -> DataFrame:
    """doc_id, sent_idx, sentence."""
    return docs.select("doc_id", F.posexplode(sentences(F.col("text"), mode)).alias("sent_idx", "sentence"))


def sentence_chunks(docs: DataFrame, k: int = 3) -> DataFrame:
    """doc_id, chunk_idx, chunk: each k sentences (mode ``period``) joined by a space, without an exchange."""
    docs = docs.select("doc_id", sentences(F.col("text"), "period").alias("s"))
    # A filter on the size would be pushed below and cut each text to sentences again.
    chunks = F.when(F.size("s") > 0, F.transform(F.sequence(F.lit(1), F.greatest(F.size("s"), F.lit(1)), F.lit(k)), lambda i: F.array_join(F.slice("s", i, k), " ")))
    return docs.select("doc_id", F.posexplode(chunks).alias("chunk_idx", "chunk"))


def explode_lines(docs: DataFrame) -> DataFrame:
    """doc_id, line_no (from 1), line; blank lines stay."""
    return docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line")).withColumn("line_no", F.col("line_no") + 1)


def lines_to_blocks(docs: DataFrame) -> DataFrame:
    """doc_id, block_idx, style, text of the non-blank lines.

    "Chapter n" of at most 12 words and upper-case lines of at most 8 are Heading 1; numbered lines of at most 10
    words Heading 2, without the number; lines of at most 6 words before a blank line Heading 3; all others Normal.
    """
    order = Window.partitionBy("doc_id").orderBy("line_no")
    lines = explode_lines(docs).withColumn("line", strip(F.col("line"))).withColumn("next", F.lead("line").over(order)).filter("line <> ''")
    n, line = F.size(words(F.col("line"))), F.col("line")
    number = r"^[0-9]+(?:\.[0-9]+)?\s+"
    numbered = line.rlike(number + "[A-Z]") & (n <= 10)
    chapter = line.rlike(r"(?i)^chapter\s+[0-9]+") & (n <= 12)
    capitals = (n <= 8) & (line == F.upper(line)) & line.rlike("[A-Z]")
    style = F.when(chapter | capitals, "Heading 1").when(numbered, "Heading 2").when((n <= 6) & (F.col("next") == ""), "Heading 3").otherwise("Normal")
    return lines.select("doc_id", (F.row_number().over(order) - 1).alias("block_idx"), style.alias("style"), F.when(~chapter & ~capitals & numbered, F.regexp_replace(line, number, "")).otherwise(line).alias("text"))


def line_fingerprint(line: Column, letters: bool = False) -> Column:
    """Lower case, digits as ``#``, single spaces; with ``letters`` all else but a-z becomes a space, too."""
    out = F.lower(F.regexp_replace(line, "[0-9]+", "#"))
    out = F.regexp_replace(out, "[^a-z# ]+", " ") if letters else out
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def boilerplate_lines(docs: DataFrame, group: str = "source", share: float = 0.40, least: int = 2, letters: bool = False, least_docs: int = 0) -> DataFrame:
    """group, fingerprint, n_docs of lines that recur in at least ``share`` of a group's documents (and in ``least``).

    Groups of fewer than ``least_docs`` documents have none. A line counts once a document. Counting is partial before
    the exchange, so a frequent line is a few rows.
    """
    lines = docs.select(group, "doc_id", F.explode(F.array_distinct(F.transform(F.split("text", "\n"), lambda x: line_fingerprint(x, letters)))).alias("fingerprint")).filter("fingerprint <> ''")
    counts = lines.groupBy(group, "fingerprint").agg(F.count(F.lit(1)).alias("n_docs"))
    sizes = docs.groupBy(group).agg(F.greatest(F.lit(least), F.floor(F.count(F.lit(1)) * share)).alias("least"), F.count(F.lit(1)).alias("size")).filter(F.col("size") >= least_docs)
    return counts.join(sizes, group).filter("n_docs >= least").select(group, "fingerprint", "n_docs")


def title_documents(docs: DataFrame, group: str = "source") -> DataFrame:
    """group, doc_id, fingerprint: each group's first document and its first line, if the second document begins otherwise:
    a repeated line at the head of a title page is the title, and stays."""
    tops = docs.select(group, "doc_id", line_fingerprint(F.split("text", "\n")[0]).alias("top"))
    first = tops.groupBy(group).agg(F.min(F.struct("doc_id", "top")).alias("f"))
    second = tops.join(first, group).filter(F.col("doc_id") > F.col("f.doc_id")).groupBy(group, "f").agg(F.min(F.struct("doc_id", "top")).alias("s"))
    return second.filter(F.col("f.top") != F.col("s.top")).select(group, F.col("f.doc_id").alias("doc_id"), F.col("f.top").alias("fingerprint"))


def drop_lines(docs: DataFrame, lines: DataFrame, group: str = "source", titles: DataFrame | None = None) -> DataFrame:
    """doc_id and text without the lines whose fingerprints are listed for the document's group; first lines that
    ``titles`` (see ``title_documents``) has stay."""
    rows = docs.select("doc_id", group, F.posexplode(F.split("text", "\n")).alias("line_no", "line")).withColumn("fingerprint", line_fingerprint(F.col("line")))
    left = rows.join(lines.select(group, "fingerprint"), [group, "fingerprint"], "left_anti")
    if titles is not None:
        kept = rows.filter("line_no = 0").join(titles, [group, "doc_id", "fingerprint"], "left_semi")
        left = left.union(kept.join(lines, [group, "fingerprint"], "left_semi").select(*left.columns))
    kept = left.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("l"))
    texts = kept.select("doc_id", F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("text"))
    return docs.select("doc_id").join(texts, "doc_id", "left").na.fill({"text": ""})


# Rewrites of LaTeX texts in order, with $n for groups.
LATEX = [
    (r"%.*?\n", "\n"), (None, None),
    *[(rf"\\{c}\{{([^}}]*)\}}", "$1") for c in ("textbf", "textit", "emph", "underline")],
    (r"\\section\{([^}]*)\}", "\n\n$1\n"), (r"\\subsection\{([^}]*)\}", "\n$1\n"), (r"\\subsubsection\{([^}]*)\}", "\n$1\n"), (r"\\chapter\{([^}]*)\}", "\n\n$1\n\n"),
    (r"\\cite\{([^}]*)\}", "[Citation: $1]"), (r"\\citep\{([^}]*)\}", "[$1]"), (r"\\citet\{([^}]*)\}", "$1"), (r"\\label\{[^}]*\}", ""), (r"\\ref\{([^}]*)\}", "[ref]"),
    (r"\\begin\{([^}]*)\}", ""), (r"\\end\{([^}]*)\}", ""), (r"\\[a-zA-Z]+(\[[^\]]*\])?\{([^}]*)\}", "$2"), (r"\\[a-zA-Z]+", ""), (r"\n\s*\n\s*\n", "\n\n"), (r" +", " "),
]
DOCUMENT_BEGINS, DOCUMENT_ENDS = "\\begin{document}", "\\end{document}"
# Fixed value: a word that goes on in the next line.
HYPHEN = r"([\p{L}\p{N}_])-\s+([\p{L}\p{N}_])"


def clean_latex(text: Column) -> Column:
    """The text between the marks of a LaTeX document, without comments and commands."""
    for pattern, new in LATEX:
        if pattern:
            text = F.regexp_replace(text, pattern, new)
        else:
            text = F.when(F.instr(text, DOCUMENT_BEGINS) > 0, F.substring(text, F.instr(text, DOCUMENT_BEGINS), F.length(text))).otherwise(text)
            text = F.when(F.instr(text, DOCUMENT_ENDS) > 0, F.substring(text, F.lit(1), F.instr(text, DOCUMENT_ENDS) - 1)).otherwise(text)
    return strip(text)


def clean_text(docs: DataFrame, profile: str = "print") -> DataFrame:
    """doc_id and text. ``print``: single spaces, punctuation set as in print and contractions repaired; ``latex``: without
    comments and commands; ``hyphens``: words that are parted at a line's end joined."""
    if profile == "latex":
        return docs.select("doc_id", clean_latex(F.col("text")).alias("text"))
    if profile == "hyphens":
        return docs.select("doc_id", F.regexp_replace("text", HYPHEN, "$1$2").alias("text"))
    t = F.regexp_replace("text", r"\s+", " ")
    t = F.regexp_replace(t, r"\s+([.,;:!?])", "$1")
    t = F.regexp_replace(t, r"([.,;:!?])([\p{L}\p{N}_])", "$1 $2")
    t = F.regexp_replace(F.regexp_replace(t, r'\s+"', '"'), r'"\s+', '"')
    t = F.regexp_replace(t, r"(?i)\b(do|ca|wo|should|would|could|is|are|was|were|has|have|had)nt\b", "$1n't")
    return docs.select("doc_id", F.trim(t).alias("text"))
