"""Registered queries on reference lists and their entries, and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.operators import citations
from vellum.operators import references as ref
from vellum.plans.paper_queries import ALL, REFERENCES, START, STRIP, edges
from vellum.plans.text_queries import TOKENS
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


def quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def hit(text: str, pattern: str) -> str:
    return f"regexp_matches({text}, {quoted(pattern)})"


def get(text: str, pattern: str, n: int = 1) -> str:
    return f"regexp_extract({text}, {quoted(pattern)}, {n})"


def strip(text: str) -> str:
    return STRIP.format(text)


def part(text: str, pattern: str, n: int = 1) -> str:
    return strip(get(text, pattern, n))


# The list of each paper: what follows its header line.
BLOCK = rf"{START}, blk AS (SELECT p.doc_id, regexp_replace(text[ref_at + 1 :], '^[^\n]*\n?', '') AS text FROM papers p JOIN starts s ON p.doc_id = s.doc_id)"


def lists(s, d):
    p = papers.load_papers(s, d)
    return p.join(citations.reference_start(p), "doc_id").select("doc_id", F.expr(r"regexp_replace(substring(text, cast(ref_at as int) + 1), '^[^\\n]*\\n?', '')").alias("text"))


LAID_OUT = "CASE doc_id % 4 WHEN 0 THEN replace(text, chr(10), concat(chr(10), chr(10))) WHEN 1 THEN replace(text, '. ', concat('.', chr(10), 'and ')) WHEN 2 THEN replace(text, ', ', concat(',', chr(10), 'x ')) ELSE text END"
FLAT = f"list_filter(list_transform({{0}}, lambda x: {strip("replace(x, chr(10), ' ')")}), lambda x: x <> '')"
query(
    "cit17_split_reference_block",
    rf"""WITH {BLOCK}, v AS (SELECT doc_id, {strip(LAID_OUT)} AS t FROM blk), x AS (SELECT doc_id, t, string_split_regex(t, '\n\s*\n') AS bb, string_split(regexp_replace(t, '(^|\n)(\s*\[\d+\])', '\1' || chr(1) || '\2', 'g'), chr(1)) AS bm, list_filter(list_transform(string_split(t, chr(10)), lambda x: {strip("x")}), lambda x: x <> '') AS ls FROM v WHERE t <> ''),
e AS (SELECT doc_id, CASE WHEN len(bb) > 1 THEN {FLAT.format("bb")} WHEN {hit("t", ref.LIST_STYLES[0][1])} THEN {FLAT.format("bm")} WHEN len(list_filter(ls, lambda x: {hit("x", ref.ENTRY_START)})) / len(ls) >= 0.55 THEN ls
ELSE string_split(array_to_string(list_transform(ls, lambda x, i: CASE WHEN i > 1 AND {hit("x", ref.NAME_START)} AND {hit("ls[i - 1]", ref.ENTRY_END)} THEN chr(1) || x ELSE x END), ' '), ' ' || chr(1)) END AS l FROM x)
SELECT doc_id, CAST(generate_subscripts(l, 1) - 1 AS INT) AS ref_idx, unnest(l) AS entry FROM e""",
)(lambda s, d: ref.split_reference_block(lists(s, d).withColumn("text", F.expr(LAID_OUT))))
STYLED = f"{BLOCK}, sty AS (SELECT doc_id, CASE {' '.join(f"WHEN {hit('text[1:2000]', p)} THEN '{k}'" for k, p in ref.LIST_STYLES)} ELSE 'unknown' END AS style FROM blk)"
query("cit12_reference_list_style", f"WITH {STYLED} SELECT * FROM sty")(lambda s, d: ref.reference_list_style(lists(s, d)))

NAMES = rf"list_filter(list_transform(string_split(regexp_replace(regexp_replace(regexp_replace(regexp_replace({strip("regexp_replace(a, ',+$', '')")}, ',?\s*&\s*', '|||', 'g'), ',?\s+and\s+([A-Z])', '|||\1', 'g'), ',\s+([A-Z][a-z''-]+\s*,)', '|||\1', 'g'), ',\s+([A-Z][a-z''-]+\s*,)', '|||\1', 'g'), '|||'), lambda x: {strip(f"regexp_replace({strip('x')}, ',+$', '')")}), lambda x: x <> '')"


def record(authors: str, ok: str, **known: str) -> str:
    return f"CASE WHEN {ok} AND ({known['title']}) <> '' THEN {struct(authors, **known)} END"


def struct(authors: str, **known: str) -> str:
    return "{'authors': " + authors + ", " + ", ".join(f"'{f}': {known.get(f, quoted(''))}" for f in ref.FIELDS) + "}"


SOURCE = lambda n: f"CASE WHEN aj THEN {part('ar', ref.APA_SOURCE, n)} ELSE '' END"
RECORDS = {
    "apa": record("names", f"{hit('raw', ref.APA)} AND length(a) <= 250 AND len(names) > 0", year=get("raw", ref.APA, 2), title="at_", journal=SOURCE(1), volume=SOURCE(2), issue=SOURCE(3), pages=SOURCE(4), publisher=rf"CASE WHEN aj THEN '' ELSE regexp_replace({strip('ar')}, '\.+$', '') END", doi=get("ar", ref.DOI), type="CASE WHEN aj THEN 'article' ELSE 'book' END"),
    "ieee": record(rf"CASE WHEN ib THEN list_transform(string_split_regex({get('i0', ref.IEEE_BODY)}, ',\s*(?:and\s*)?'), lambda x: {strip('x')}) ELSE CAST([] AS VARCHAR[]) END", hit("raw", ref.IEEE), title=f"CASE WHEN ib THEN {part('i0', ref.IEEE_BODY, 2)} ELSE i0[1:80] END", type="'article'", **{k: part("ir", p) for k, p in ref.IEEE_PARTS.items()}),
    "mla": record(f"[{part('raw', ref.MLA)}]", hit("raw", ref.MLA), type="'article'", **{k: part("raw", ref.MLA, n) for n, k in enumerate(("title", "journal", "volume", "issue", "year", "pages"), 2)}),
    "chicago": record(f"[{part('raw', ref.CHICAGO)}]", hit("raw", ref.CHICAGO), type="'book'", **{k: part("raw", ref.CHICAGO, n) for n, k in enumerate(("title", "location", "publisher", "year"), 2)}),
    "last": struct("[" + strip("string_split(pieces[1], ',')[1]") + "]", year=get("raw", ref.YEAR, 0), title=f"CASE WHEN {get('raw', ref.QUOTED_TITLE)} <> '' THEN {get('raw', ref.QUOTED_TITLE)} WHEN contains(raw, '.') THEN coalesce(list_filter(list_transform(pieces[2:], lambda x: {strip('x')}), lambda x: length(x) > 8 AND NOT {hit('x', ref.NO_TITLE)})[1], {strip('pieces[len(pieces)]')}) ELSE '' END"),
}
PARSED = f"""{STYLED}, {REFERENCES}, raws AS (SELECT r.doc_id, ref_idx, ref_number, CASE WHEN ref_number IS NOT NULL THEN concat('[', ref_number, '] ', r.text) ELSE r.text END AS raw, style FROM refs r LEFT JOIN sty ON r.doc_id = sty.doc_id),
p1 AS (SELECT *, {part("raw", ref.APA)} AS a, {get("raw", ref.APA, 3)} AS ar0, {get("raw", ref.IEEE)} AS i0, string_split(raw, '.') AS pieces FROM raws), p2 AS (SELECT *, {hit("ar0", ref.APA_TITLE)} AND {part("ar0", ref.APA_TITLE)} <> '' AS titled FROM p1),
p3 AS (SELECT *, CASE WHEN titled THEN {part("ar0", ref.APA_TITLE)} ELSE {strip("ar0")} END AS at_, CASE WHEN titled THEN {get("ar0", ref.APA_TITLE, 2)} ELSE '' END AS ar FROM p2), p4 AS (SELECT *, {hit("ar", ref.APA_SOURCE)} AS aj, {hit("i0", ref.IEEE_BODY)} AS ib, {NAMES} AS names FROM p3),
p5 AS (SELECT *, CASE WHEN ib THEN {get("i0", ref.IEEE_BODY, 3)} ELSE i0 END AS ir FROM p4), p6 AS (SELECT *, {", ".join(f"{x} AS {k}_" for k, x in RECORDS.items())} FROM p5),
p7 AS (SELECT doc_id, ref_idx, ref_number, raw, coalesce(CASE WHEN style IN ('APA', 'Harvard') THEN apa_ WHEN style = 'IEEE' THEN ieee_ WHEN style = 'MLA' THEN mla_ WHEN style = 'Chicago' THEN chicago_ WHEN style = 'unknown' AND last_.title <> '' THEN last_ END, apa_, ieee_, mla_, chicago_, last_) AS r FROM p6),
parsed AS (SELECT doc_id, ref_idx, ref_number, raw, r.authors AS authors, {", ".join(f"r.{f} AS {f}" for f in ref.FIELDS)} FROM p7)"""


def parsed(s, d):
    found, listed = citations.references_and_lists(papers.load_papers(s, d))
    return ref.parse_references(found, ref.reference_list_style(listed))


query("cit11_parse_references", f"WITH {PARSED} SELECT * REPLACE (array_to_string(authors, '|') AS authors) FROM parsed")(lambda s, d: parsed(s, d).withColumn("authors", F.array_join("authors", "|")))
SURNAME = r"regexp_replace(lower(string_split(coalesce(authors[1], ''), ',')[1]), '[^a-z0-9]', '', 'g')"
KEYS = f"keys AS (SELECT doc_id, ref_idx, CASE WHEN ref_number IS NOT NULL THEN concat('ref', ref_number) WHEN {SURNAME} = '' THEN concat('unknown', ref_idx + 1) ELSE concat({SURNAME}, year) END AS bib_key FROM parsed)"
query("cit15_bib_keys", f"WITH {PARSED}, {KEYS} SELECT * FROM keys")(lambda s, d: ref.bib_keys(parsed(s, d)))

N = "len(authors)"
SPACED = r"regexp_replace(raw, '\s+', ' ', 'g')"
IEEE_NAME, HARVARD_NAME = r"^([A-Za-z'-]+),\s*([A-Z])[a-z]*(?:\s*([A-Z])\.?)?", r"^([A-Za-z'-]+),\s*([A-Z])"
TURNED = f"list_transform(authors[1:6], lambda x: CASE WHEN {hit('x', IEEE_NAME)} THEN concat({get('x', IEEE_NAME, 2)}, '.', CASE WHEN {get('x', IEEE_NAME, 3)} <> '' THEN concat(' ', {get('x', IEEE_NAME, 3)}, '.') ELSE '' END, ' ', {get('x', IEEE_NAME, 1)}) ELSE x END)"
SHORT = f"list_transform(authors, lambda x: CASE WHEN {hit('x', HARVARD_NAME)} THEN concat({get('x', HARVARD_NAME, 1)}, ', ', {get('x', HARVARD_NAME, 2)}, '.') ELSE x END)"
AUTHORS = {
    "APA": f"CASE WHEN {N} = 0 THEN '' WHEN {N} = 1 THEN authors[1] WHEN {N} <= 6 THEN concat(array_to_string(authors[1 : {N} - 1], ', '), ', & ', authors[{N}]) ELSE concat(array_to_string(authors[1:6], ', '), ', … ', authors[{N}]) END",
    "MLA": f"CASE WHEN {N} = 0 THEN '' WHEN {N} = 1 THEN authors[1] WHEN {N} = 2 THEN concat(authors[1], ', and ', authors[2]) ELSE concat(authors[1], ', et al.') END",
    "IEEE": f"array_to_string(CASE WHEN {N} > 6 THEN list_append({TURNED}, 'et al.') ELSE {TURNED} END, ', ')",
    "Chicago": f"CASE WHEN {N} = 0 THEN '' WHEN {N} = 1 THEN authors[1] ELSE concat(authors[1], ', and ', array_to_string(list_transform(authors[2:], lambda x: {strip("string_split(x, ',')[1]")}), ' ')) END",
    "Harvard": f"CASE WHEN {N} = 0 THEN '' WHEN {N} <= 2 THEN array_to_string({SHORT}, ' and ') ELSE concat(array_to_string(({SHORT})[1 : {N} - 1], ', '), ' and ', ({SHORT})[{N}]) END",
}


def some(c: str, before: str = "", after: str = "", more: str = "''") -> str:
    return f"CASE WHEN {c} <> '' THEN concat({quoted(before)}, {c}, {more}, {quoted(after)}) ELSE '' END"


def rendered(style: str) -> str:
    names = f"CASE WHEN ({AUTHORS[style]}) <> '' THEN {AUTHORS[style]} ELSE {quoted('Unknown Author' if style == 'APA' else 'Unknown')} END"
    year, untitled = "CASE WHEN year <> '' THEN year ELSE 'n.d.' END", "CASE WHEN title <> '' THEN title ELSE 'Untitled' END"
    volume = some("volume", ", vol. ", "", some("issue", ", no. "))
    either = lambda book, article: f"CASE WHEN type = 'book' THEN concat({book}) ELSE concat({article}) END"
    place = f"concat({some('location', '', ': ')}, publisher)"
    return {
        "MLA": lambda: either(f"{names}, '. *', title, '*. ', publisher, ', ', {year}, '.'", f"""{names}, '. "', title, '". *', journal, '*', {volume}, ' (', {year}, ')', {some("pages", ": ")}, '.'"""),
        "IEEE": lambda: f"""concat({names}, ', "', title, ',"', {some("journal", " *", "*,")}, {some("volume", " vol. ", ",", some("issue", ", no. "))}, {some("pages", " pp. ", ",")}, ' ', {year}, '.', {some("doi", " doi: ", ".")})""",
        "Chicago": lambda: f"""concat({either(f"{names}, '. *', title, '*.', {some('location', ' ', ':')}, {some('publisher', ' ', ',')}, ' ', {year}, '.'", f"{names}, '. {chr(34)}', title, '.{chr(34)} *', journal, '*', {some('volume', ' ', '', some('issue', ', no. '))}, ' (', {year}, ')', {some('pages', ': ')}, '.'")}, {some("doi", " https://doi.org/", ".")})""",
        "Harvard": lambda: f"""concat({either(f"{names}, ' (', {year}, ') *', title, '*.', {some('publisher', ' ', '.')}", f"{names}, ' (', {year}, ') ''', title, ''', *', journal, '*', {volume}, {some('pages', ', pp. ')}, '.'")}, {some("doi", " doi:", ".")})""",
        "APA": lambda: f"""concat({either(f"{names}, ' (', {year}, '). *', {untitled}, '*.', CASE WHEN {place} <> '' THEN concat(' ', {place}, '.') ELSE '' END", f"{names}, ' (', {year}, '). ', {untitled}, '. *', journal, '*', {some('volume', ', *', '', "concat('*', " + some('issue', '(', ')') + ')')}, {some('pages', ', ')}, '.'")}, {some("doi", " https://doi.org/")})""",
    }[style]()


for _style in ref.STYLES:
    _numbered = _style == "IEEE"
    _order = "ref_idx" if _numbered else rf"lower(regexp_replace(entry, '^[\[(]?\d+[\])]?\s*', '')), ref_idx"
    query(
        f"cit13_convert_{_style.lower()}",
        rf"""WITH {PARSED}, o AS (SELECT * FROM parsed QUALIFY row_number() OVER (PARTITION BY doc_id, lower({strip(SPACED)}) ORDER BY ref_idx) = 1), n AS (SELECT *, lower({AUTHORS["APA"]}) AS who, {strip(rendered(_style))} AS shown FROM o),
e AS (SELECT doc_id, ref_idx, CASE WHEN NOT (who IN ('', 'unknown author') AND lower(title) IN ('', 'untitled') AND lower(year) IN ('', 'n.d.')) AND length(shown) >= 10 THEN shown ELSE {strip("raw")} END AS entry FROM n), p AS (SELECT *, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY {_order}) AS INT) AS place FROM e)
SELECT doc_id, place, {rf"CASE WHEN regexp_matches(entry, '^\[\d+\]') THEN entry ELSE concat('[', place, '] ', entry) END" if _numbered else "entry"} AS entry FROM p UNION ALL SELECT DISTINCT doc_id, 0, '{ref.HEADINGS[_style]}' FROM p""",
    )(lambda s, d, k=_style: ref.convert_bibliography(parsed(s, d), k))

CITED = f"{PARSED}, okay AS (SELECT doc_id, ref_idx + 1 AS n, authors, year FROM parsed WHERE len(authors) > 0 AND authors[1] <> '' AND year <> '')"


def replaced(text: str, pattern: str, value: str) -> str:
    """SQL that puts ``value`` (of x, a match) in the place of each match."""
    marks = f"list_transform(regexp_extract_all({text}, {quoted(pattern)}), lambda x: {value})"
    return f"array_to_string(list_transform(list_zip(string_split_regex({text}, {quoted(pattern)}), {marks}), lambda z: concat(z[1], coalesce(z[2], ''))), '')"


for _style in ref.STYLES:
    if _style == "IEEE":
        _maps = f"SELECT doc_id, concat({strip("string_split(authors[1], ',')[1]")}, ',', year) AS k, CAST(max(n) AS VARCHAR) AS v FROM okay GROUP BY ALL"
        _text = replaced("text", ref.COMMA_YEAR, f"coalesce('[' || m[concat({part('x', ref.COMMA_YEAR, 1)}, ',', {part('x', ref.COMMA_YEAR, 2)})] || ']', x)")
    else:
        _comma = ", " if _style in ("APA", "Chicago") else " "
        _maps = rf"SELECT doc_id, CAST(n AS VARCHAR) AS k, concat('(', {strip(rf"CASE WHEN contains(authors[1], ',') THEN string_split(authors[1], ',')[1] ELSE list_last(string_split_regex({strip('authors[1]')}, '\s+')) END")}, '{_comma}', year, ')') AS v FROM okay"
        _text = replaced("text", ref.NUMBER_MARK, f"coalesce(m[{get('x', ref.NUMBER_MARK, 1)}], x)")
        _text = f"regexp_replace({_text}, {quoted(ref.SPACE_YEAR if _comma == ', ' else ref.COMMA_YEAR)}, '(\\1{_comma}\\2)', 'g')"
    query(
        f"cit14_in_text_{_style.lower()}",
        f"WITH {CITED}, kv AS ({_maps}), maps AS (SELECT doc_id, map_from_entries(list({{'k': k, 'v': v}})) AS m FROM kv GROUP BY doc_id) SELECT p.doc_id, md5({_text}) AS digest FROM papers p LEFT JOIN maps ON p.doc_id = maps.doc_id",
    )(lambda s, d, k=_style: ref.convert_in_text(papers.load_papers(s, d), parsed(s, d), k).select("doc_id", F.md5("text").alias("digest")))

SCORED = f"""WITH {ALL}, u AS (SELECT c.doc_id, c.cit_idx, concat_ws(' ', nullif(author, ''), nullif(year_or_page, ''), nullif({strip("replace(context, text, '')")}, '')) AS q FROM cits c WHERE NOT EXISTS (SELECT 1 FROM edges e WHERE e.doc_id = c.doc_id AND e.cit_idx = c.cit_idx)),
ut AS (SELECT doc_id, cit_idx, token, count(*) AS tf FROM (SELECT doc_id, cit_idx, unnest({TOKENS.format("q")}) AS token FROM u) GROUP BY ALL), rt AS (SELECT doc_id, ref_idx, token, count(*) AS tf FROM (SELECT doc_id, ref_idx, unnest({TOKENS.format("text")}) AS token FROM refs) GROUP BY ALL),
n AS (SELECT doc_id, count(*) AS n FROM refs GROUP BY doc_id), idf AS (SELECT rt.doc_id, token, ln((1.0 + any_value(n)) / (1.0 + count(*))) + 1 AS idf FROM rt JOIN n ON rt.doc_id = n.doc_id GROUP BY rt.doc_id, token),
uw AS (SELECT ut.doc_id, cit_idx, ut.token, tf * idf AS w, sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY ut.doc_id, cit_idx)) AS norm FROM ut JOIN idf ON ut.doc_id = idf.doc_id AND ut.token = idf.token),
rw AS (SELECT rt.doc_id, ref_idx, rt.token, tf * idf AS w, sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY rt.doc_id, ref_idx)) AS norm FROM rt JOIN idf ON rt.doc_id = idf.doc_id AND rt.token = idf.token),
s AS (SELECT uw.doc_id, cit_idx, ref_idx, round(sum(uw.w / uw.norm * rw.w / rw.norm), 4) AS score FROM uw JOIN rw ON uw.doc_id = rw.doc_id AND uw.token = rw.token GROUP BY ALL)
"""
query(
    "cit9_semantic_citation_match",
    f"""{SCORED}SELECT * FROM (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY doc_id, cit_idx ORDER BY score DESC, ref_idx) = 1) WHERE score >= 0.3""",
)(lambda s, d: (lambda c, r, e: ref.semantic_citation_match(citations.unmatched_citations(c, e), r))(*edges(s, d)))
CIT_VECTOR, REF_VECTOR = "(doc_id * 31 + cit_idx) % 500", "(doc_id * 17 + ref_idx) % 500"


@query(
    "cit9_vector_citation_match",
    f"""{SCORED}, e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), uv AS (SELECT u.doc_id, cit_idx, v AS x FROM u JOIN e ON vec_id = {CIT_VECTOR} WHERE cit_idx % 3 <> 0), rv AS (SELECT doc_id, ref_idx, v AS y FROM refs JOIN e ON vec_id = {REF_VECTOR} WHERE ref_idx % 4 <> 3),
d AS (SELECT uv.doc_id, cit_idx, ref_idx, round(list_dot_product(x, y) / (sqrt(list_dot_product(x, x)) * sqrt(list_dot_product(y, y))), 4) AS score FROM uv JOIN rv ON uv.doc_id = rv.doc_id),
a AS (SELECT * FROM d UNION ALL SELECT * FROM s WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.doc_id = s.doc_id AND d.cit_idx = s.cit_idx AND d.ref_idx = s.ref_idx))
SELECT * FROM (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY doc_id, cit_idx ORDER BY score DESC, ref_idx) = 1) WHERE score >= 0.3""",
)
def vector_citations(spark, folder):
    """Two citations in three and three entries in four have a vector of the embeddings table."""
    cits, refs, found = edges(spark, folder)
    v = spark.read.parquet(f"{folder}/embeddings.parquet").select("vec_id", "embedding")
    left = citations.unmatched_citations(cits, found)
    of = lambda df, key, vec, some: df.select("doc_id", key).filter(some).withColumn("vec_id", F.expr(vec)).join(v, "vec_id").drop("vec_id")
    return ref.vector_citation_match(left, refs, of(left, "cit_idx", CIT_VECTOR, "cit_idx % 3 <> 0"), of(refs, "ref_idx", REF_VECTOR, "ref_idx % 4 <> 3"))


V = strip(r"regexp_replace(line, '\s+', ' ', 'g')")
query("cit18_reference_like_rows", f"WITH {START} SELECT doc_id, line_no, length({V}) >= 35 AND {hit(V, ref.STARTS)} AND {hit(f'lower({V})', ref.SIGNALS)} AS is_reference FROM lines")(
    lambda s, d: ref.reference_like_rows(citations.lines(papers.load_papers(s, d)).withColumnRenamed("line", "text")).select("doc_id", "line_no", "is_reference")
)
COMMAS = "length({0}) - length(replace({0}, ',', ''))"
query(
    "cit18_reference_tables",
    f"""WITH {START}, v AS (SELECT doc_id * 1000 + CAST(floor(line_no / 6) AS INT) AS table_id, line_no, {V} AS v FROM lines), n AS (SELECT *, row_number() OVER (PARTITION BY table_id ORDER BY line_no) AS nth, {hit("v", ref.YEAR)} AS dated, {hit("v", ref.TABLE_SIGNALS)} AS sign FROM v WHERE v <> ''),
t AS (SELECT table_id, count(*) AS n_rows, count(*) FILTER (nth <= 8 AND length(v) > 70 AND dated AND ({hit("v", ref.TABLE_AUTHORS)} OR {COMMAS.format("v")} >= 3 OR sign)) AS n, bool_or(nth = 1 AND length(v) > 90 AND dated AND ({COMMAS.format("v")} >= 3 OR {hit("v", ref.ET_AL)} OR sign)) AS f, string_agg(v, ' ' ORDER BY nth) FILTER (nth <= 4) AS h FROM n GROUP BY table_id)
SELECT table_id, n_rows, (length(h) > 120 AND {hit("h", ref.YEAR)} AND ({COMMAS.format("h")} >= 4 OR {hit("h", ref.ET_AL)} OR {hit("h", ref.TABLE_SIGNALS)})) OR n >= 2 OR f AS is_reference_table FROM t""",
)(lambda s, d: ref.reference_tables(citations.lines(papers.load_papers(s, d)).select((F.col("doc_id") * 1000 + F.floor(F.col("line_no") / 6)).alias("table_id"), F.col("line_no").alias("row_idx"), F.col("line").alias("text"))))

PARTS = (("array_to_string(authors, ' and ')", "author"), ("title", "title"), ("journal", "journal"), ("year", "year"), ("volume", "volume"), ("issue", "number"), ("pages", "pages"), ("publisher", "publisher"), ("location", "address"), ("doi", "doi"))
ORDERED = ", ".join(f"CASE WHEN {c} <> '' THEN '  {n} = {{' || regexp_replace({c}, '([{{}}])', '\\\\\\1', 'g') || '}}' END" for c, n in PARTS)
query(
    "snk2_export_bibliography",
    f"""WITH {PARSED}, {KEYS} SELECT p.doc_id, string_agg(CASE WHEN type = 'book' THEN '@book{{' ELSE '@article{{' END || bib_key || ',' || chr(10) || concat_ws(',' || chr(10), {ORDERED}) || chr(10) || '}}', chr(10) || chr(10) ORDER BY p.ref_idx) AS bibtex
FROM parsed p JOIN keys k ON p.doc_id = k.doc_id AND p.ref_idx = k.ref_idx WHERE title <> '' GROUP BY p.doc_id""",
)(lambda s, d: ref.export_bibliography(parsed(s, d)))
