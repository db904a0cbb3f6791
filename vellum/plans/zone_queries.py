"""Registered queries on contents lists, zones, typed blocks, front matter, pages and outlines, and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.functions.text import upper_letters
from vellum.operators import citations, layout, structure, zones
from vellum.plans.paper_queries import START, STRIP
from vellum.plans.structure_queries import BLOCKS, CHUNKS, SPANS, blocks, chunks, spans
from vellum.plans.text_queries import WORDS
from vellum.sources import corpus, papers

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


SPACED = STRIP.format(r"regexp_replace({0}, '\s+', ' ', 'g')")

# Contents lists: page 0 lists a paper's headings, the other pages have 30 of its lines each.
TITLE = "CASE WHEN doc_id % 3 > 0 THEN 'Contents' ELSE 'What is where' END"
TOC_LINES = rf"""{CHUNKS}, tl AS (SELECT doc_id, 0 AS page, 0 AS line_no, {TITLE} AS line FROM papers UNION ALL SELECT doc_id, 0, chunk_idx + 1, concat(heading, ' ....... ', 2 * chunk_idx + 1) FROM chunks UNION ALL SELECT doc_id, CAST(1 + floor((line_no - 1) / 30) AS INT), line_no, line FROM lines),
tw AS (SELECT *, {STRIP.format("line")} AS t, {WORDS.format("regexp_replace(line, '[._·…]{3,}', ' ', 'g')")} AS w FROM tl WHERE {STRIP.format("line")} <> ''),
te AS (SELECT *, coalesce(regexp_matches(w[len(w)], '^\d{{1,4}}$'), false) AS ends, coalesce(regexp_matches(w[1], '^\d{{1,4}}$'), false) AND len(w) >= 2 AS starts FROM tw),
toc AS (SELECT doc_id, page, line_no, line, t, regexp_matches(t, '(?i)^(?:table\s+of\s+contents|contents|list\s+of\s+(?:figures|tables))$') OR regexp_matches(t, '(?i)^(?:\d{{1,4}}|[ivxlc]{{1,6}})$')
OR ((ends OR starts) AND len(w) <= 16 AND NOT coalesce(regexp_matches(CASE WHEN ends THEN CASE WHEN len(w) > 1 THEN w[len(w) - 1] END ELSE w[len(w)] END, '[.!?]$'), false)) AS is_toc FROM te)"""


def listed(s, d):
    p = papers.load_papers(s, d)
    title = p.select("doc_id", F.lit(0).alias("page"), F.lit(0).alias("line_no"), F.expr(TITLE).alias("line"))
    heads = chunks(s, d).select("doc_id", F.lit(0), (F.col("chunk_idx") + 1), F.concat("heading", F.lit(" ....... "), (2 * F.col("chunk_idx") + 1).cast("string")))
    return title.union(heads).union(citations.lines(p).select("doc_id", (1 + F.floor((F.col("line_no") - 1) / 30)).cast("int"), "line_no", "line"))


query("seg14_toc_lines", f"WITH {TOC_LINES} SELECT doc_id, page, line_no, is_toc FROM toc")(lambda s, d: zones.toc_lines(listed(s, d)).drop("line"))
query(
    "seg14_toc_units",
    rf"""WITH {TOC_LINES}, n AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY line_no) AS nth FROM toc),
u AS (SELECT doc_id, page, count(*) AS n_lines, count(*) FILTER (is_toc) AS n_toc, bool_or(nth <= 5 AND regexp_matches(t, '(?i)^(?:table\s+of\s+contents|contents)$')) AS has_heading, sum(len({WORDS.format("line")})) AS w FROM n GROUP BY doc_id, page)
SELECT doc_id, page, n_lines, n_toc, has_heading, n_lines >= 5 AND w >= 10 AND n_toc / n_lines >= CASE WHEN has_heading THEN 0.40 ELSE 0.55 END AS is_toc FROM u""",
)(lambda s, d: zones.toc_units(listed(s, d)))

# Geometry by rule: 50 lines a page, some set at the page's edge, every seventh without a place.
LINE = "concat(line, CASE line_no % 23 WHEN 0 THEN ' doi:10.1' WHEN 1 THEN ' University' WHEN 2 THEN ' Journal 2021' ELSE '' END)"
X0 = "CASE WHEN line_no % 13 = 0 THEN 20.0 WHEN line_no % 17 = 0 THEN 540.0 ELSE 72.0 END"
GEOMETRY = f"""doc_id, line_no, {LINE} AS line, line = 'CONCLUSION' AS repeated, 612.0 AS page_width, 792.0 AS page_height, {X0} AS x0, {X0} + least(length(line) * 5.0, 468.0) AS x1,
CASE WHEN line_no % 7 > 0 THEN (line_no % 50) * 15.8 END AS top, CASE WHEN line_no % 7 > 0 THEN (line_no % 50) * 15.8 + 12.0 END AS bottom"""
MARGINAL = rf"""(v <> '' AND ({" OR ".join(f"contains(lower(v), '{w}')" for w in zones.MARGIN_WORDS)} OR {" OR ".join(f"regexp_matches(lower(v), '{p}')" for p in zones.MARGIN_STARTS)} OR (regexp_matches(lower(v), '{zones.MARGIN_PLACES}') AND len({WORDS.format("v")}) <= 14)
OR (regexp_matches(lower(v), '\bjournal\b') AND regexp_matches(lower(v), '\b20\d{{2}}\b')) OR regexp_matches(v, '{zones.MARGIN_ONLY}')))"""
ZONED = rf"""{START}, geo AS (SELECT {GEOMETRY} FROM lines), gv AS (SELECT *, {SPACED.format("line")} AS v, (x0 + x1) / 2 / page_width AS middle FROM geo),
zoned AS (SELECT doc_id, line_no, CASE WHEN repeated OR coalesce(top <= page_height * 0.07, false) THEN 'header' WHEN coalesce(bottom >= page_height * 0.93, false) OR regexp_matches({STRIP.format("line")}, '(?i)^(?:page\s*)?\d{{1,4}}$') THEN 'footer' WHEN {MARGINAL} THEN 'marginalia'
WHEN (x1 - x0) / page_width <= 0.26 AND (middle <= 0.18 OR middle >= 0.82) THEN 'sidebar' ELSE 'main_body' END AS zone FROM gv)"""


def zoned(s, d):
    return zones.line_zones(citations.lines(papers.load_papers(s, d)).selectExpr(*[x.strip() for x in _fields(GEOMETRY)]))


def _fields(select: str) -> list[str]:
    """The expressions of a SELECT list: commas inside parentheses or CASE don't part them."""
    out, depth = [""], 0
    for c in select:
        depth += {"(": 1, ")": -1}.get(c, 0)
        if c == "," and not depth:
            out.append("")
        else:
            out[-1] += c
    return out


query("seg15_line_zones", f"WITH {ZONED} SELECT * FROM zoned")(zoned)
query("seg15_zone_counts", f"WITH {ZONED} SELECT doc_id, {', '.join(f"count(*) FILTER (zone = '{z}') AS {z}" for z in zones.ZONES)} FROM zoned GROUP BY doc_id")(lambda s, d: zones.zone_counts(zoned(s, d)))

MARKED = "CASE block_idx % 9 WHEN 2 THEN concat('- ', text) WHEN 4 THEN concat('31) ', text) WHEN 5 THEN concat('\"', text) WHEN 7 THEN concat('[2] ', text) ELSE text END"
SIZED = f"doc_id, block_idx, {MARKED} AS text, CASE WHEN section_level = 1 THEN 18.0 WHEN section_level = 2 THEN 14.0 WHEN block_idx % 5 = 0 THEN 10.4 + doc_id % 2 ELSE 10.0 + doc_id % 2 END AS font_size, block_idx % 6 = 1 AS is_bold, CAST(1 + floor(block_idx / 8) AS INT) AS page"
KIND = rf"""CASE WHEN length(t) < 3 THEN 'unknown' WHEN length(t) < 80 AND n < 15 AND regexp_matches(t, '\d+\s*$') THEN 'running_header' WHEN page = 1 AND font_size > 16 THEN 'title_page'
WHEN font_size > {{0}} + 1.5 OR (n <= 10 AND length(t) <= 80 AND regexp_matches(t, '{zones.NUMBERED_HEADING}')) OR (is_bold AND n BETWEEN 2 AND 8) THEN 'heading' WHEN regexp_matches(t, '{zones.BULLET.replace("{", "{{").replace("}", "}}")}') THEN 'bullet_list'
WHEN regexp_matches(t, '{zones.NUMBERED}') THEN 'numbered_list' WHEN regexp_matches(t, '{zones.ENTRY.replace("{", "{{").replace("}", "}}")}') THEN 'reference_entry' WHEN starts_with(t, '"') THEN 'block_quote' ELSE 'paragraph' END"""
TYPED = rf"""{BLOCKS}, sb AS (SELECT {SIZED} FROM blocks), st AS (SELECT *, {STRIP.format("text")} AS t, len({WORDS.format("text")}) AS n FROM sb), s1 AS (SELECT *, {KIND.format("12.0")} AS kind FROM st),
sc AS (SELECT doc_id, round_even(font_size, 0) AS size, count(*) AS c, min(block_idx) AS first_at FROM s1 WHERE font_size > 0 AND kind = 'paragraph' GROUP BY ALL), sm AS (SELECT doc_id, size AS modal FROM sc QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY c DESC, first_at) = 1),
sa AS (SELECT doc_id, avg(font_size) AS mean FROM s1 WHERE font_size > 0 AND kind <> 'title_page' GROUP BY doc_id), s2 AS (SELECT st.*, coalesce(modal, mean, 12.0) AS modal FROM st LEFT JOIN sm ON st.doc_id = sm.doc_id LEFT JOIN sa ON st.doc_id = sa.doc_id),
typed AS (SELECT doc_id, block_idx, text, {KIND.format("modal")} AS type, CASE WHEN regexp_matches(t, '^\d+\.\d') THEN 2 WHEN regexp_matches(t, '^\d') THEN 1 WHEN font_size >= modal + 3 THEN 1 WHEN font_size >= modal + 1 THEN 2 ELSE 3 END AS l FROM s2)"""


def sized(s, d):
    b = blocks(s, d)
    return b.select("doc_id", "block_idx", F.expr(MARKED).alias("text"), F.expr("CASE WHEN section_level = 1 THEN 18.0D WHEN section_level = 2 THEN 14.0D WHEN block_idx % 5 = 0 THEN 10.4D + doc_id % 2 ELSE 10.0D + doc_id % 2 END").alias("font_size"), (F.col("block_idx") % 6 == 1).alias("is_bold"), (1 + F.floor(F.col("block_idx") / 8)).cast("int").alias("page"))


query("seg16_typed_blocks", f"WITH {TYPED} SELECT doc_id, block_idx, type, CASE WHEN type = 'heading' THEN l END AS level FROM typed")(lambda s, d: zones.typed_blocks(sized(s, d)))
query(
    "seg17_list_texts",
    f"""WITH {TYPED}, o AS (SELECT *, CASE WHEN type <> coalesce(lag(type) OVER (PARTITION BY doc_id ORDER BY block_idx), '') OR type NOT IN ('bullet_list', 'numbered_list') THEN 1 ELSE 0 END AS opens FROM typed), g AS (SELECT *, sum(opens) OVER (PARTITION BY doc_id ORDER BY block_idx) AS run FROM o),
k AS (SELECT *, row_number() OVER (PARTITION BY doc_id, run ORDER BY block_idx) AS nth FROM g)
SELECT doc_id, min(block_idx) AS first_block, type, count(*) AS n_blocks, md5(string_agg(CASE type WHEN 'bullet_list' THEN '• ' || text WHEN 'numbered_list' THEN nth || '. ' || text ELSE text END, chr(10) ORDER BY block_idx)) AS digest FROM k GROUP BY doc_id, run, type""",
)(lambda s, d: zones.list_texts(layout.group_runs(zones.typed_blocks(sized(s, d)).join(sized(s, d).select("doc_id", "block_idx", "text"), ["doc_id", "block_idx"]), ["bullet_list", "numbered_list"])).withColumn("digest", F.md5("text")).drop("text"))
query(
    "seg17_merge_paragraphs",
    f"""WITH {BLOCKS}, t AS (SELECT doc_id, block_idx, text, CASE WHEN section_level IS NULL THEN 'paragraph' ELSE 'heading' END AS type, block_idx % 3 > 0 AS cont FROM blocks),
o AS (SELECT *, CASE WHEN type = 'paragraph' AND cont AND coalesce(lag(type) OVER (PARTITION BY doc_id ORDER BY block_idx), '') = 'paragraph' THEN 0 ELSE 1 END AS opens FROM t), c AS (SELECT *, sum(opens) OVER (PARTITION BY doc_id ORDER BY block_idx) AS chain FROM o),
p AS (SELECT *, floor((row_number() OVER (PARTITION BY doc_id, chain ORDER BY block_idx) - 1) / 2) AS pair FROM c)
SELECT doc_id, min(block_idx) AS block_idx, min(type) AS type, count(*) AS n_merged, md5(string_agg(text, ' ' ORDER BY block_idx)) AS digest FROM p GROUP BY doc_id, chain, pair""",
)(lambda s, d: zones.merge_paragraphs(blocks(s, d).select("doc_id", "block_idx", "text", F.when(F.col("section_level").isNull(), "paragraph").otherwise("heading").alias("type"), (F.col("block_idx") % 3 > 0).alias("continues_from_prev"))).withColumn("digest", F.md5("text")).drop("text"))

FRONT = """concat_ws(chr(10), concat('# Study ', CAST(doc_id AS STRING)), CASE WHEN doc_id % 4 > 0 THEN 'Ann Lee, Bo Chan,' END, CASE WHEN doc_id % 4 = 2 THEN 'ann@lee.org' END, CASE WHEN doc_id % 3 > 0 THEN concat('Place of ', lang) END,
CASE WHEN doc_id % 5 > 0 THEN concat('Keywords: one; two, ', lang) END, CASE WHEN doc_id % 6 > 0 THEN '# Abstract' END, text, CASE WHEN doc_id % 7 > 0 THEN '[^1]: a note' END, CASE WHEN doc_id % 2 > 0 THEN '# Next' END, 'The rest, in short')"""
LISTED = "array_to_string(list_filter(list_transform({0}, lambda x: " + STRIP.format("x") + "), lambda x: x <> ''), '; ')"
query(
    "seg20_front_matter",
    rf"""WITH f AS (SELECT doc_id, string_split({FRONT}, chr(10)) AS l FROM documents WHERE trim(text) <> ''), r AS (SELECT doc_id, unnest(l) AS raw, generate_subscripts(l, 1) AS line_no FROM f), s AS (SELECT doc_id, line_no, {STRIP.format("raw")} AS s FROM r),
notes AS (SELECT doc_id, count(*) FILTER (regexp_matches(s, '^\[\^.+\]:')) AS footnotes FROM s GROUP BY doc_id),
h AS (SELECT *, starts_with(s, '#') AS head, starts_with(s, '#') AND lower({STRIP.format("regexp_replace(s, '^#+', '')")}) = 'abstract' AS opens, regexp_matches(s, '{zones.KEYWORDS}') AS keys FROM s WHERE line_no <= 80),
i AS (SELECT *, bool_or(opens) OVER w AS inside FROM h WINDOW w AS (PARTITION BY doc_id ORDER BY line_no)), j AS (SELECT *, bool_or(inside AND NOT head AND NOT keys AND s <> '') OVER (PARTITION BY doc_id ORDER BY line_no) AS filled FROM i),
k AS (SELECT *, bool_or(inside AND ((s = '' AND filled) OR (head AND NOT opens))) OVER (PARTITION BY doc_id ORDER BY line_no) AS stopped FROM j), m AS (SELECT * FROM k WHERE NOT stopped AND s <> '' AND NOT opens),
n AS (SELECT *, min(line_no) FILTER (NOT keys AND NOT inside AND len({WORDS.format("s")}) <= 12 AND contains(s, ',') AND regexp_matches(s, '[^,\s]')) OVER (PARTITION BY doc_id) AS author_line FROM m),
g AS (SELECT doc_id, max(s) FILTER (line_no = author_line) AS a, arg_min(s, line_no) FILTER (NOT keys AND NOT inside AND line_no > author_line AND len({WORDS.format("s")}) <= 20 AND NOT contains(s, '@')) AS affiliation, string_agg(s, ' ' ORDER BY line_no) FILTER (inside AND NOT keys) AS abstract, arg_max(regexp_extract(s, '{zones.KEYWORDS}', 1), line_no) FILTER (keys) AS k FROM n GROUP BY doc_id)
SELECT notes.doc_id, {LISTED.format("string_split(a, ',')")} AS authors, affiliation, abstract, {LISTED.format("string_split_regex(k, '[;,]')")} AS keywords, footnotes FROM notes LEFT JOIN g ON notes.doc_id = g.doc_id""",
)(lambda s, d: zones.front_matter(citations.lines(corpus.load_corpus(s, d).selectExpr("doc_id", f"{FRONT} AS text"))))


def paged(b):
    pages = b.select("doc_id", "text", (1 + F.floor(F.col("block_idx") / 3)).cast("int").alias("page_start"), ((1 + F.floor(F.col("block_idx") / 3)).cast("int") + F.col("block_idx") % 2).alias("page_end"))
    return zones.page_ranges(structure.section_chunks(b).withColumnRenamed("chunk_idx", "section_idx"), pages)


KEY = r"substring(regexp_replace(" + STRIP.format(r"regexp_replace(lower(text), '\s+', ' ', 'g')") + ", '[^a-z0-9 ]+', '', 'g'), 1, 1200)"
query(
    "seg22_page_ranges",
    f"""WITH {CHUNKS}, a AS (SELECT doc_id, chunk_idx AS section_idx, {KEY} AS whole FROM chunks), b AS (SELECT doc_id, {KEY} AS part, CAST(1 + floor(block_idx / 3) AS INT) AS page_start, CAST(1 + floor(block_idx / 3) AS INT) + block_idx % 2 AS page_end FROM blocks)
SELECT a.doc_id, section_idx, min(page_start) AS page_start, max(page_end) AS page_end FROM a JOIN b ON a.doc_id = b.doc_id WHERE whole <> '' AND part <> '' AND (contains(whole, part) OR contains(part, whole[1:180])) GROUP BY ALL""",
)(lambda s, d: paged(corpus.written_once(blocks(s, d))))
query(
    "seg12_generic_sections",
    rf"""WITH {SPANS}, g AS (SELECT l.doc_id, l.line_no, l.s, length(p.text) AS total, l.line_at + length(regexp_extract(l.line, '^(\s*)', 1)) AS start, len({WORDS.format("l.s")}) AS n, k.start IS NOT NULL AS known, regexp_matches(l.s, '\p{{Lu}}') AND NOT regexp_matches(l.s, '\p{{Ll}}') AS capitals
FROM lines l JOIN papers p ON p.doc_id = l.doc_id LEFT JOIN spans k ON k.doc_id = l.doc_id AND k.start = l.line_at WHERE l.s <> ''),
h AS (SELECT *, lead(n) OVER w AS following, min(CASE WHEN n < 12 AND (known OR regexp_matches(s, '^\d+(\.\d+)*\s+') OR capitals) THEN start END) OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS nxt FROM g WINDOW w AS (PARTITION BY doc_id ORDER BY line_no))
SELECT doc_id, CAST(start AS BIGINT) AS start, CAST(coalesce(nxt, total) AS BIGINT) AS "end", s AS heading FROM h WHERE NOT known AND ((capitals AND n < 12) OR (n < 12 AND regexp_matches(s, '^\p{{Lu}}') AND coalesce(following > n AND following >= 5, false)))""",
)(lambda s, d: zones.generic_sections(citations.lines(papers.load_papers(s, d)), spans(s, d)))
ENTRY = "CASE chunk_idx % 4 WHEN 1 THEN upper(heading) WHEN 3 THEN concat(heading, ' x') ELSE heading END"
query(
    "str6_toc_alignment",
    f"""WITH {CHUNKS}, t AS (SELECT doc_id, chunk_idx AS toc_idx, {ENTRY} AS text FROM chunks WHERE doc_id % 8 > 0), h AS (SELECT doc_id, lower({SPACED.format("heading")}) AS k, arg_max(section_type, chunk_idx) AS section_type FROM chunks WHERE heading <> '' GROUP BY ALL),
j AS (SELECT t.*, section_type FROM t LEFT JOIN h ON t.doc_id = h.doc_id AND lower({SPACED.format("t.text")}) = h.k WHERE {STRIP.format("t.text")} <> ''),
o AS (SELECT doc_id, count(*) AS toc_entries, string_agg(section_type, '|' ORDER BY toc_idx) AS matched, string_agg({STRIP.format("text")}, '|' ORDER BY toc_idx) FILTER (section_type IS NULL) AS missing, round(count(section_type) / count(*), 3) AS coverage FROM j GROUP BY doc_id)
SELECT c.doc_id, coalesce(toc_entries, 0) AS toc_entries, coalesce(matched, '') AS matched, coalesce(missing, '') AS missing, coalesce(coverage, 0) AS coverage FROM (SELECT DISTINCT doc_id FROM chunks) c LEFT JOIN o ON c.doc_id = o.doc_id""",
)(lambda s, d: zones.toc_alignment(chunks(s, d).filter("doc_id % 8 > 0").select("doc_id", F.col("chunk_idx").alias("toc_idx"), F.when(F.col("chunk_idx") % 4 == 1, upper_letters(F.col("heading"))).otherwise(F.expr(ENTRY)).alias("text")), chunks(s, d)))
NAMED = "CASE (chunk_idx + doc_id) % 7 WHEN 2 THEN concat(heading, '?') WHEN 3 THEN 'Accuracy: 3' WHEN 5 THEN concat('2.1 ', heading, ' of it') WHEN 6 THEN 'What is it' ELSE heading END"
NORMAL = r"lower(regexp_replace(regexp_replace(regexp_replace({0}, '" + zones.TITLE_NUMBER + r"', ''), '\s+', ' ', 'g'), '^[ .:-]+|[ .:-]+$', '', 'g'))"
IN = lambda names: "(" + ", ".join(map(quoted, names)) + ")"
query(
    "str7_outline_roles",
    rf"""WITH {CHUNKS}, t AS (SELECT doc_id, chunk_idx AS section_idx, {NAMED} AS title FROM chunks), v AS (SELECT *, {NORMAL.format("title")} AS k, {SPACED.format("title")} AS v FROM t),
f AS (SELECT *, CASE WHEN k IN {IN(zones.REFERENCE_TITLES)} THEN 'reference_heading' WHEN v = '' OR regexp_matches(v, '^["''].*["'']$') OR ends_with(v, '?') OR regexp_matches(lower(v), '^prediction\s*:') OR regexp_matches(lower(v), '{zones.MEASURES}') OR regexp_matches(lower(v), '{zones.QUESTION}')
OR (len({WORDS.format("v")}) > 11 AND {NORMAL.format("v")} NOT IN {IN(zones.MAJOR_TITLES)}) THEN 'paragraph_false_positive' END AS kind FROM v WHERE k <> ''),
m AS (SELECT *, min(section_idx) FILTER (kind IS NULL) OVER (PARTITION BY doc_id) AS first_idx FROM f)
SELECT doc_id, section_idx, coalesce(kind, CASE WHEN section_idx = first_idx OR k IN {IN(zones.MAJOR_TITLES)} THEN 'heading_1' ELSE 'heading_2' END) AS role FROM m""",
)(lambda s, d: zones.outline_roles(chunks(s, d).select("doc_id", F.col("chunk_idx").alias("section_idx"), F.expr(NAMED).alias("title"))))
