"""Registered queries on sections and structure and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.functions.lexicons import SECTION_HEADERS, SECTION_KEYWORDS
from vellum.operators import citations, structure
from vellum.plans.paper_queries import REFERENCES, START, STRIP
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


TYPE = "CASE " + " ".join("WHEN " + " OR ".join(f"contains(lower({{0}}), '{w}')" for w in ws) + f" THEN '{k}'" for k, ws in SECTION_KEYWORDS) + " ELSE 'generic' END"
BLOCKS = rf"""{START}, bl AS (SELECT doc_id, line_no, s, CASE WHEN regexp_matches(s, '^(#{{1,6}})\s+(.+)$') THEN length(regexp_extract(s, '^(#{{1,6}})\s+(.+)$', 1)) WHEN regexp_matches(s, '^\d+(?:\.\d+)*\s+[A-Z]') AND len({WORDS.format("s")}) <= 12 THEN 2 END AS lev FROM lines),
bo AS (SELECT *, CASE WHEN lev IS NOT NULL OR lag(lev) OVER w IS NOT NULL OR coalesce(lag(s) OVER w, '') = '' THEN 1 ELSE 0 END AS opens FROM bl WINDOW w AS (PARTITION BY doc_id ORDER BY line_no)),
bb AS (SELECT *, sum(opens) OVER (PARTITION BY doc_id ORDER BY line_no) AS block FROM bo WHERE s <> ''),
blocks AS (SELECT doc_id, CAST(block - 1 AS INT) AS block_idx, CASE WHEN max(lev) IS NULL THEN 'Normal' ELSE 'Heading ' || max(lev) END AS style, max(lev) AS section_level,
string_agg(CASE WHEN regexp_matches(s, '^(#{{1,6}})\s+(.+)$') THEN {STRIP.format(r"regexp_extract(s, '^(#{1,6})\s+(.+)$', 2)")} WHEN lev IS NOT NULL THEN regexp_replace(s, '^\d+(?:\.\d+)*\s+', '') ELSE s END, ' ' ORDER BY line_no) AS text FROM bb GROUP BY doc_id, block)"""
CHUNKS = f"""{BLOCKS}, cs AS (SELECT *, sum(CASE WHEN section_level > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY block_idx) AS section FROM blocks WHERE {STRIP.format("text")} <> ''),
cg AS (SELECT doc_id, section, coalesce(max(text) FILTER (section_level > 0), 'Untitled') AS heading, coalesce(max(section_level), 1) AS section_level, coalesce(string_agg({STRIP.format("text")}, chr(10) || chr(10) ORDER BY block_idx) FILTER (section_level IS NULL), '') AS body, count(*) FILTER (section_level IS NULL) AS block_count FROM cs GROUP BY doc_id, section),
ct AS (SELECT doc_id, section, heading, section_level, CASE WHEN body <> '' THEN body ELSE heading END AS text, block_count FROM cg),
chunks AS (SELECT doc_id, CAST(row_number() OVER w - 1 AS INT) AS chunk_idx, {TYPE.format("heading")} AS section_type, heading, text, len({WORDS.format("text")}) AS word_count, CAST(coalesce(sum(length(text) + 2) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS char_start,
CAST(coalesce(sum(length(text) + 2) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(text) AS BIGINT) AS char_end, section_level, block_count FROM ct WINDOW w AS (PARTITION BY doc_id ORDER BY section))"""
KIND = "CASE " + " ".join(rf"WHEN regexp_matches(s, '(?i)^(?:\d+[.)]\s*)?(?:{p})[ \t]*[:-]?$') THEN '{k}'" for k, p in SECTION_HEADERS) + " END"
SPANS = f"""{START}, sh AS (SELECT doc_id, line_no, line_at, {KIND} AS type FROM lines), sn AS (SELECT doc_id, type, CAST(line_at AS INT) AS start, CAST(row_number() OVER w - 1 AS INT) AS section_idx, lead(CAST(line_at AS INT)) OVER w AS nxt FROM sh WHERE type IS NOT NULL WINDOW w AS (PARTITION BY doc_id ORDER BY line_no)),
spans AS (SELECT sn.doc_id, section_idx, type, start, CAST(coalesce(nxt, length(text)) AS INT) AS "end", text[start + 1 : coalesce(nxt, length(text))] AS text FROM sn JOIN papers ON sn.doc_id = papers.doc_id)"""


def blocks(s, d):
    return structure.paragraph_blocks(papers.load_papers(s, d))


def chunks(s, d):
    return structure.section_chunks(blocks(s, d))


def spans(s, d):
    return structure.section_spans(papers.load_papers(s, d))


def headings(s, d):
    return blocks(s, d).filter("section_level is not null").select("doc_id", F.col("block_idx").alias("idx"), F.when(F.col("block_idx") % 5 == 4, 3).otherwise(F.col("section_level")).alias("level"))


HEADINGS = f"{BLOCKS}, h AS (SELECT doc_id, block_idx AS idx, CASE WHEN block_idx % 5 = 4 THEN 3 ELSE section_level END AS level FROM blocks WHERE section_level IS NOT NULL)"
query("seg4_paragraph_blocks", f"WITH {BLOCKS} SELECT * FROM blocks")(blocks)
query("seg5_section_chunks", f"WITH {CHUNKS} SELECT * FROM chunks")(chunks)
query(
    "seg7_merge_sections",
    f"WITH {CHUNKS} SELECT doc_id, min(chunk_idx) AS chunk_idx, section_type, heading, string_agg(text, chr(10) || chr(10) ORDER BY chunk_idx) AS text, CAST(sum(word_count) AS BIGINT) AS word_count, arg_max(char_end, chunk_idx) AS char_end FROM (SELECT * REPLACE (CASE WHEN chunk_idx % 2 = 1 THEN 'Same' ELSE heading END AS heading, 'generic' AS section_type) FROM chunks) GROUP BY doc_id, section_type, heading",
)(lambda s, d: structure.merge_sections(chunks(s, d).withColumn("heading", F.when(F.col("chunk_idx") % 2 == 1, "Same").otherwise(F.col("heading"))).withColumn("section_type", F.lit("generic"))))
query(
    "seg9_section_numbering",
    f"""WITH {HEADINGS}, a AS (SELECT *, sum(CASE WHEN level = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY idx) AS n1 FROM h), b AS (SELECT *, sum(CASE WHEN level = 2 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, n1 ORDER BY idx) AS n2 FROM a), c AS (SELECT *, sum(CASE WHEN level = 3 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, n1, n2 ORDER BY idx) AS n3 FROM b)
SELECT doc_id, idx, level, 's' || CASE level WHEN 1 THEN concat(n1) WHEN 2 THEN concat(n1, '.', n2) ELSE concat(n1, '.', n2, '.', n3) END AS section_id FROM c""",
)(lambda s, d: structure.section_numbering(headings(s, d)))
query(
    "seg10_section_parents",
    f"WITH {HEADINGS} SELECT doc_id, idx, level, (SELECT max(p.idx) FROM h p WHERE p.doc_id = h.doc_id AND p.idx < h.idx AND p.level < least(h.level, 3)) AS parent_idx FROM h",
)(lambda s, d: structure.section_parents(headings(s, d)))
query("seg11_section_spans", f"WITH {SPANS} SELECT * FROM spans")(spans)
query(
    "seg23_reassemble_text",
    f"WITH {BLOCKS} SELECT doc_id, md5(string_agg(CASE WHEN section_level IS NOT NULL THEN repeat('#', section_level) || ' ' || trim(text) ELSE trim(text) END, chr(10) || chr(10) ORDER BY block_idx)) AS digest FROM blocks WHERE trim(text) <> '' GROUP BY doc_id",
)(lambda s, d: structure.reassemble_text(blocks(s, d)).select("doc_id", F.md5("text").alias("digest")))
query(
    "seg24_heading_outline",
    f"""WITH {BLOCKS}, l AS (SELECT *, CASE WHEN regexp_matches(style, '^Heading [123]$') THEN CAST(style[9] AS INT) ELSE 0 END AS level FROM blocks)
SELECT doc_id, block_idx, level, len({WORDS.format("text")}) AS n_words, length(text) AS n_chars, CASE WHEN level IN (2, 3) THEN (SELECT max(p.block_idx) FROM l p WHERE p.doc_id = l.doc_id AND p.block_idx < l.block_idx AND p.level = l.level - 1) END AS parent_idx, text[1:100] AS outline FROM l""",
)(lambda s, d: structure.heading_outline(blocks(s, d)))

FEATURES = rf"""{SPANS}, feats AS (SELECT doc_id, section_idx, type, CASE type {" ".join(f"WHEN '{k}' THEN len(regexp_extract_all(text, '(?i)\\b(?:{'|'.join(ws)})\\b'))" for k, ws in SECTION_KEYWORDS)} ELSE 0 END AS n_keywords, len({WORDS.format("text")}) AS n_words, len(string_split_regex(text, '[.!?]+')) AS n_sentences,
round(len(list_filter({WORDS.format("text")}, lambda x: regexp_matches(x, '^\p{{Lu}}'))) / greatest(1, len({WORDS.format("text")})), 6) AS upper_share, len(regexp_extract_all(text, '\(\w+,?\s*\d{{4}}\)')) AS n_citations FROM spans)"""
query("str1_section_features", f"WITH {FEATURES} SELECT * FROM feats")(lambda s, d: structure.section_features(spans(s, d)))
NAMES = ("n_keywords", "n_words", "n_sentences", "upper_share", "n_citations")
query(
    "str2_section_classifier",
    f"""WITH {FEATURES}, k AS (SELECT type AS class, count(*) AS n, {", ".join(f"avg({c}) AS m_{c}, var_pop({c}) + 1e-9 AS v_{c}" for c in NAMES)} FROM feats GROUP BY type),
p AS (SELECT doc_id, section_idx, type, class, ln(n / (SELECT count(*) FROM feats)) {" ".join(f"- 0.5 * ln(2 * 3.141592653589793 * v_{c}) - ({c} - m_{c}) * ({c} - m_{c}) / (2 * v_{c})" for c in NAMES)} AS l FROM feats, k),
t AS (SELECT *, max(l) OVER (PARTITION BY doc_id, section_idx) AS top FROM p)
SELECT doc_id, section_idx, type, round(sum(CASE WHEN class = type THEN exp(l - top) ELSE 0 END) / sum(exp(l - top)), 3) AS posterior FROM t GROUP BY doc_id, section_idx, type""",
)(lambda s, d: structure.section_classifier(corpus.written_once(structure.section_features(spans(s, d)))))
SETS = f"{SPANS}, sets AS (SELECT doc_id, list(DISTINCT type) AS k FROM spans GROUP BY doc_id)"
query(
    "str3_document_type",
    f"WITH {SETS} SELECT doc_id, CASE WHEN len(k) >= 6 THEN 'thesis' WHEN list_has_all(k, ['introduction', 'methodology', 'results', 'discussion', 'references']) THEN 'journal' WHEN len(k) >= 5 THEN 'conference' WHEN list_has_all(k, ['introduction', 'conclusion']) THEN 'report' ELSE 'generic' END AS document_type FROM sets",
)(lambda s, d: structure.document_type(spans(s, d)))
query(
    "str4_structure_validation",
    f"""WITH {SETS}, a AS (SELECT p.doc_id, coalesce(k, []) AS k FROM papers p LEFT JOIN sets s ON p.doc_id = s.doc_id), m AS (SELECT doc_id, array_to_string(list_filter(['abstract', 'conclusion', 'introduction'], lambda x: NOT list_contains(k, x)), ',') AS missing_essential, array_to_string(list_filter(['discussion', 'methodology', 'results'], lambda x: NOT list_contains(k, x)), ',') AS missing_recommended, list_contains(k, 'references') AS has_references FROM a)
SELECT *, missing_essential = '' AS complete FROM m""",
)(lambda s, d: structure.structure_validation(papers.load_papers(s, d), spans(s, d)))
query("str15_pick_section", f"WITH {SPANS} SELECT doc_id, section_idx, type, start, \"end\", text FROM spans WHERE type = 'results' QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY start) = 1")(lambda s, d: structure.pick_section(spans(s, d), "results"))
METRICS = f"""{CHUNKS}, {REFERENCES}, mp AS (SELECT doc_id, section_type, lower(heading) AS title, list_filter(string_split(text, chr(10) || chr(10)), lambda p: trim(p) <> '') AS ps FROM chunks),
mf AS (SELECT doc_id, count(*) AS n_sections, sum(len(ps)) AS n_paragraphs, sum(list_sum(list_transform(ps, lambda p: len({WORDS.format("p")})))) AS w, count(DISTINCT title) AS n_titles, count(*) FILTER (len(ps) <= 1) AS single, bool_or(section_type = 'abstract') AS has_abstract FROM mp GROUP BY doc_id),
mr AS (SELECT doc_id, count(*) AS n_references FROM refs GROUP BY doc_id),
metrics AS (SELECT p.doc_id, coalesce(n_sections, 0) AS n_sections, CAST(coalesce(n_paragraphs, 0) AS BIGINT) AS n_paragraphs, coalesce(n_references, 0) AS n_references, coalesce(has_abstract, false) AS has_abstract, floor(coalesce(w, 0) / greatest(1, coalesce(n_paragraphs, 0)) * 100 + 0.5) / 100 AS avg_paragraph_words, coalesce(n_titles, 0) AS n_titles, coalesce(single, 0) / greatest(1, coalesce(n_sections, 0)) AS single_share
FROM papers p LEFT JOIN mf USING (doc_id) LEFT JOIN mr USING (doc_id))"""


def metrics(s, d):
    p = papers.load_papers(s, d)
    return structure.structure_metrics(p, chunks(s, d), citations.extract_references(p))


query("str9_structure_metrics", f"WITH {METRICS} SELECT * FROM metrics")(metrics)
query(
    "str10_structure_quality_score",
    f"""WITH {METRICS} SELECT doc_id, round(least(n_sections, 18) * 2.0 + least(n_paragraphs, 120) * 0.6 + least(n_references, 80) * 1.4 + CASE WHEN has_abstract THEN 12 ELSE 0 END + least(n_titles, 18) + least(avg_paragraph_words, 90) * 0.15
- CASE WHEN n_sections > 25 AND single_share > 0.55 THEN (n_sections - 25) * 1.5 + single_share * 20 ELSE 0 END - CASE WHEN n_paragraphs <= 2 THEN 25 ELSE 0 END - CASE WHEN n_sections = 0 THEN 50 ELSE 0 END, 4) AS score FROM metrics""",
)(lambda s, d: structure.structure_quality_score(metrics(s, d)))
query(
    "str14_guideline_rules",
    rf"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM documents WHERE trim(text) <> ''), s AS (SELECT doc_id, line_no, {STRIP.format("raw")} AS line FROM l),
f AS (SELECT doc_id, lower(regexp_replace(line, '\s+', ' ', 'g')) AS k, min(line_no) AS line_no, arg_min(line, line_no) AS line FROM s WHERE regexp_matches(line, '(?i)(^|[^\p{{L}}\p{{N}}_])(the|la|der|des)($|[^\p{{L}}\p{{N}}_])') GROUP BY ALL)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS INT) AS place, line FROM f QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY line_no) <= 40""",
)(lambda s, d: structure.guideline_rules(corpus.load_corpus(s, d), r"(?iU)(^|[^\p{L}\p{N}_])(the|la|der|des)($|[^\p{L}\p{N}_])"))
