"""Registered queries on papers (citations, references, sections) and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.operators import citations as cit
from vellum.sources import papers

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


STRIP = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"
HEADS = r"(?:references?|bibliography|works\s+cited|reference\s+list|sources)"
LINES = f"""papers AS (SELECT doc_id, lang, source, text FROM {papers.SQL}),
raw_lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM papers),
lines AS (SELECT doc_id, line, line_no, {STRIP.format("line")} AS s, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS line_at FROM raw_lines)"""
START = rf"""{LINES}, heads AS (SELECT *, regexp_matches(s, '(?i)^\s*(?:[IVXLC]+\.\s+)?{HEADS}\s*$') AS head, regexp_matches(s, '(?i)(?:[IVXLC]+\.\s+)?\b{HEADS}\s*(?:\[1\]|$)') AS inl,
length(regexp_extract(s, '(?i)^(.*?)(?:[IVXLC]+\.\s+)?\b{HEADS}\s*(?:\[1\]|$)', 1)) AS pos FROM lines),
starts AS (SELECT doc_id, arg_min(CAST(line_at + CASE WHEN head THEN 0 ELSE pos END AS BIGINT), line_no) AS ref_at, CAST(min(line_no) AS INT) AS ref_line FROM heads WHERE head OR (inl AND (contains(s, '[1]') OR pos <= 5)) GROUP BY doc_id)"""
IEEE = r"\[\s*(\d+(?:[\s,\-]+\d+)*)\s*\](?:\s*\[\s*\d+(?:[\s,\-]+\d+)*\s*\])*"
PATTERNS = [("APA", r"\(([^()0-9]+?),\s*(\d{4}[a-z]?)\)"), ("Harvard", r"\(([^()0-9]+?)\s+(\d{4}[a-z]?)\)"), ("MLA", r"\(([A-Z][A-Za-z''.-]+)\s+(\d{1,3})\)"), ("IEEE", IEEE), ("Chicago", r"\^(\d+)")]


def _candidates(i: int) -> str:
    style, p = PATTERNS[i]
    year = f"{STRIP.format(f"regexp_extract(m[k], '{p}', 2)")}" if i < 3 else "''"
    return f"""SELECT doc_id, line_no, line_at, line, {i} AS prio, k, m[k] AS text, CAST(list_sum(list_transform(g[1:k], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1 : k - 1], lambda x: length(x))), 0) AS INT) AS col,
{STRIP.format(f"regexp_extract(m[k], '{p}', 1)")} AS author, {year} AS year_or_page, '{style}' AS style_type
FROM (SELECT *, string_split_regex(line, '{p}') AS g, unnest(range(1, len(m) + 1)) AS k FROM (SELECT *, regexp_extract_all(line, '{p}') AS m FROM lines))"""


CITATIONS = f"""{START}, cand AS ({" UNION ALL ".join(map(_candidates, range(5)))}),
okay AS (SELECT c.* FROM cand c LEFT JOIN starts s ON c.doc_id = s.doc_id WHERE ref_at IS NULL OR (line_at < ref_at AND line_at + col + length(c.text) <= ref_at)),
cits AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY line_no, prio, k) - 1 AS INT) AS cit_idx, text, line_no AS line, CAST(line_at + col AS BIGINT) AS position, col, author, year_or_page, style_type, {STRIP.format("line")} AS context
FROM okay c WHERE NOT EXISTS (SELECT 1 FROM okay o WHERE o.doc_id = c.doc_id AND o.line_no = c.line_no AND o.prio < c.prio AND c.col < o.col + length(o.text) AND c.col + length(c.text) > o.col))"""
REFERENCES = rf"""rl AS (SELECT l.doc_id, l.line_no, l.line, l.s FROM lines l JOIN starts t ON l.doc_id = t.doc_id WHERE l.line_no > t.ref_line AND l.s <> ''),
rp AS (SELECT doc_id, line_no, line, unnest(p) AS p, generate_subscripts(p, 1) AS k FROM (SELECT *, CASE WHEN len(regexp_extract_all(s, '\[')) >= 2 AND regexp_matches(s, '\[\d+\]') THEN list_filter(list_transform(string_split(regexp_replace(s, '(\[\d+\])', chr(1) || '\1', 'g'), chr(1)), lambda x: {STRIP.format("x")}), lambda x: regexp_matches(x, '^\[\d+\]')) ELSE [s] END AS p FROM rl)),
rk AS (SELECT *, CASE WHEN regexp_matches(p, '^\[\d+\]') THEN 'n' WHEN regexp_matches(line, '^(   |\t)') THEN 'c' WHEN regexp_matches(p, '^[A-Z][a-z]+') THEN 'a' END AS kind FROM rp),
re AS (SELECT *, sum(CASE WHEN kind <> 'c' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no, k) AS entry FROM rk WHERE kind IS NOT NULL),
rb AS (SELECT doc_id, CAST(entry - 1 AS INT) AS ref_idx, line_no, k, CASE WHEN kind = 'n' THEN regexp_replace(p, '^\[\d+\]\s*', '') ELSE p END AS body, CASE WHEN kind = 'n' THEN CAST(regexp_extract(p, '^\[(\d+)\]', 1) AS INT) END AS number FROM re WHERE entry > 0),
refs AS (SELECT doc_id, ref_idx, arg_min(number, line_no * 1000 + k) FILTER (number IS NOT NULL) AS ref_number, min(line_no) AS line, regexp_extract(arg_min(body, line_no * 1000 + k), '^([A-Z][a-z]+(?:,\s+[A-Z]\.?)?)', 1) AS author, string_agg(body, ' ' ORDER BY line_no, k) AS text FROM rb GROUP BY doc_id, ref_idx)"""
EDGES = rf"""share AS (SELECT doc_id, 2 * count(*) FILTER (style_type = 'IEEE') > count(*) AS numeric_style FROM cits GROUP BY doc_id),
nums AS (SELECT doc_id, cit_idx, CAST(unnest(n) AS INT) AS n, generate_subscripts(n, 1) AS k FROM (SELECT c.doc_id, cit_idx, regexp_extract_all(author, '\d+') AS n FROM cits c JOIN share USING (doc_id) WHERE numeric_style AND style_type = 'IEEE')),
listed AS (SELECT doc_id, coalesce(ref_number, ref_idx + 1) AS n, max(ref_idx) AS ref_idx FROM refs GROUP BY ALL),
e1 AS (SELECT nums.doc_id, cit_idx, ref_idx, row_number() OVER (PARTITION BY nums.doc_id, cit_idx ORDER BY k) = 1 AS is_primary FROM nums JOIN listed ON nums.doc_id = listed.doc_id AND nums.n = listed.n),
names AS (SELECT c.doc_id, cit_idx, year_or_page, lower(replace(list_last(string_split_regex({STRIP.format("replace(author, '&', 'and')")}, '\s+')), ',', '')) AS last_name FROM cits c JOIN share USING (doc_id) WHERE NOT numeric_style AND author <> ''),
e2 AS (SELECT n.doc_id, cit_idx, min(ref_idx) AS ref_idx, true AS is_primary FROM names n JOIN refs r ON n.doc_id = r.doc_id WHERE author <> '' AND (contains(lower(string_split(author, ',')[1]), last_name) OR contains(last_name, lower(string_split(author, ',')[1]))) AND (year_or_page = '' OR contains(r.text, year_or_page)) GROUP BY n.doc_id, cit_idx),
edges AS (SELECT * FROM e1 UNION ALL SELECT * FROM e2)"""
ALL = f"{CITATIONS}, {REFERENCES}, {EDGES}"


def both(spark, folder):
    p = papers.load_papers(spark, folder)
    return cit.extract_citations(p), cit.extract_references(p)


def edges(spark, folder):
    c, r = cit.citations_and_references(papers.load_papers(spark, folder))
    return c, r, cit.match_citations(c, r)


query("cit1_reference_start", f"WITH {START} SELECT doc_id, ref_at, ref_line FROM starts")(lambda s, d: cit.reference_start(papers.load_papers(s, d)))
query("cit2_extract_citations", f"WITH {CITATIONS} SELECT * FROM cits")(lambda s, d: both(s, d)[0])
query(
    "cit3_citation_style",
    rf"""WITH {START}, b AS (SELECT p.doc_id, CASE WHEN ref_at IS NULL THEN text ELSE text[1:ref_at] END AS t FROM papers p LEFT JOIN starts s ON p.doc_id = s.doc_id),
c AS (SELECT doc_id, len(regexp_extract_all(t, '\([^\d()]+?,\s*\d{{4}}[a-z]?\)')) AS apa, len(regexp_extract_all(t, '\([^\d()]+?\s+\d{{4}}[a-z]?\)')) AS harvard, len(regexp_extract_all(t, '\([A-Z][A-Za-z''.-]+\s+\d{{1,3}}\)')) AS mla, len(regexp_extract_all(t, '\^\d+')) AS chicago, len(regexp_extract_all(t, '{IEEE}')) AS ieee0 FROM b),
d AS (SELECT *, ieee0 * CASE WHEN chicago = 0 AND apa = 0 AND harvard = 0 THEN 1.5 ELSE 1 END AS ieee FROM c), m AS (SELECT *, greatest(apa, harvard, mla, chicago, ieee) AS most FROM d)
SELECT doc_id, CASE most WHEN 0 THEN 'Unknown' WHEN apa THEN 'APA' WHEN harvard THEN 'Harvard' WHEN mla THEN 'MLA' WHEN chicago THEN 'Chicago' ELSE 'IEEE' END AS style FROM m""",
)(lambda s, d: cit.citation_style(papers.load_papers(s, d)))
query("cit4_extract_references", f"WITH {START}, {REFERENCES} SELECT * FROM refs")(lambda s, d: both(s, d)[1])
query("cit5_match_numeric", f"WITH {ALL} SELECT * FROM e1")(lambda s, d: cit.match_numeric(*edges(s, d)[:2]))
query("cit6_match_author_year", f"WITH {ALL} SELECT * FROM e2")(lambda s, d: cit.match_author_year(*edges(s, d)[:2]))
query(
    "cit7_citation_match_report",
    f"""WITH {ALL}, c AS (SELECT doc_id, count(*) AS n_citations FROM cits GROUP BY doc_id), r AS (SELECT doc_id, count(*) AS n_references FROM refs GROUP BY doc_id), e AS (SELECT doc_id, count(*) AS matched, count(DISTINCT ref_idx) AS used FROM edges WHERE is_primary GROUP BY doc_id)
SELECT p.doc_id, coalesce(n_citations, 0) AS n_citations, coalesce(n_references, 0) AS n_references, coalesce(matched, 0) AS matched, coalesce(n_citations, 0) - coalesce(matched, 0) AS unmatched, coalesce(n_references, 0) - coalesce(used, 0) AS uncited,
CASE WHEN n_citations > 0 THEN CAST(floor(coalesce(matched, 0) / n_citations * 100 + 0.5) AS BIGINT) ELSE 0 END AS quality FROM papers p LEFT JOIN c USING (doc_id) LEFT JOIN r USING (doc_id) LEFT JOIN e USING (doc_id)""",
)(lambda s, d: cit.citation_match_report(papers.load_papers(s, d)))
query("cit8_unmatched_citations", f"WITH {ALL} SELECT c.doc_id, c.cit_idx, c.text FROM cits c WHERE NOT EXISTS (SELECT 1 FROM edges e WHERE e.doc_id = c.doc_id AND e.cit_idx = c.cit_idx)")(lambda s, d: (lambda c, r, e: cit.unmatched_citations(c, e).select("doc_id", "cit_idx", "text"))(*edges(s, d)))
query("cit8_uncited_references", f"WITH {ALL} SELECT r.doc_id, r.ref_idx, r.text FROM refs r WHERE NOT EXISTS (SELECT 1 FROM edges e WHERE is_primary AND e.doc_id = r.doc_id AND e.ref_idx = r.ref_idx)")(lambda s, d: (lambda c, r, e: cit.uncited_references(r, e).select("doc_id", "ref_idx", "text"))(*edges(s, d)))
query("cit8_reference_use_counts", f"WITH {ALL} SELECT r.doc_id, r.ref_idx, count(e.cit_idx) AS n_uses FROM refs r LEFT JOIN edges e ON e.doc_id = r.doc_id AND e.ref_idx = r.ref_idx GROUP BY r.doc_id, r.ref_idx")(lambda s, d: (lambda c, r, e: cit.reference_use_counts(r, e))(*edges(s, d)))
for _style, _sql in (("APA", r"^\([A-Z][a-z]+.*?,?\s+\d{4}[a-z]?\)"), ("MLA", r"^\([A-Z][a-z]+(?:\s+\d+)?\)"), ("IEEE", r"^\[\d+(?:[,\s]+\d+)*\]")):
    query(f"cit10_validate_{_style.lower()}", f"WITH {CITATIONS} SELECT doc_id, cit_idx, text FROM cits WHERE NOT regexp_matches(text, '{_sql}')")(lambda s, d, k=_style: cit.validate_citations(both(s, d)[0], k))
