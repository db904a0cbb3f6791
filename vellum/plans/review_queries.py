"""Registered queries on gaps, embedded headings, document parts, shingles, cleaning profiles, sources and sinks, and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.functions import lexicons
from vellum.operators import language, segment, similarity, structure, zones
from vellum.plans.paper_queries import STRIP
from vellum.plans.structure_queries import BLOCKS, CHUNKS, blocks, chunks
from vellum.plans.text_queries import FILLED, FINGERPRINT, TOKENS, WORDS, docs
from vellum.plans.zone_queries import IN, MARGINAL, SPACED
from vellum.sources import corpus, results

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


def digest(df: DataFrame) -> DataFrame:
    return df.withColumn("digest", F.md5("text")).drop("text")


# Gaps. Every third chunk says what its section should say.
KB = ", ".join(f"({i}, '{k}', {quoted(t)})" for i, (k, t) in enumerate(lexicons.KNOWLEDGE))
SAID = "CASE " + " ".join(f"WHEN (doc_id + chunk_idx) % 6 = {r} THEN concat(text, ' ', {quoted(lexicons.KNOWLEDGE[i][1])})" for r, i in ((0, 2), (2, 8), (3, 14))) + " ELSE text END"
GAPS = f"""{CHUNKS}, said AS (SELECT doc_id, chunk_idx, section_type, {SAID} AS text FROM chunks), kb AS (SELECT * FROM (VALUES {KB}) v(kb_idx, section, text)), kt AS (SELECT kb_idx, section, token, count(*) AS tf FROM (SELECT kb_idx, section, unnest({TOKENS.format("text")}) AS token FROM kb) GROUP BY ALL),
ki AS (SELECT token, ln((1.0 + (SELECT count(*) FROM kb)) / (1.0 + count(*))) + 1 AS idf FROM kt GROUP BY token), kw AS (SELECT kb_idx, section, kt.token, tf * idf AS w, sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY kb_idx)) AS norm FROM kt JOIN ki ON kt.token = ki.token),
cq AS (SELECT doc_id, chunk_idx, token, count(*) AS tf FROM (SELECT doc_id, chunk_idx, unnest({TOKENS.format("text")}) AS token FROM said) GROUP BY ALL), cw AS (SELECT doc_id, chunk_idx, cq.token, tf * idf AS w, sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY doc_id, chunk_idx)) AS norm FROM cq JOIN ki ON cq.token = ki.token),
sc AS (SELECT doc_id, section, round(max(c), 4) AS score FROM (SELECT doc_id, chunk_idx, kb_idx, section, sum(cw.w / cw.norm * kw.w / kw.norm) AS c FROM cw JOIN kw ON cw.token = kw.token GROUP BY ALL) GROUP BY ALL)"""


def said(s, d):
    return chunks(s, d).select("doc_id", "chunk_idx", "section_type", F.expr(SAID).alias("text"))


ASKED = "(VALUES " + ", ".join(f"({i}, '{k}', {str(k in lexicons.REQUIRED_SECTIONS).lower()})" for i, k in enumerate([*lexicons.REQUIRED_SECTIONS, *lexicons.OPTIONAL_SECTIONS])) + ") a(i, section, required)"
query("str5_section_scores", f"WITH {GAPS} SELECT * FROM sc")(lambda s, d: structure.section_scores(said(s, d)))
query(
    "str5_gap_report",
    f"""WITH {GAPS}, x AS (SELECT c.doc_id, i, a.section, required, coalesce(score, 0) AS score FROM (SELECT DISTINCT doc_id FROM chunks) c CROSS JOIN {ASKED} LEFT JOIN sc ON sc.doc_id = c.doc_id AND sc.section = a.section)
SELECT doc_id, coalesce(string_agg(section, ',' ORDER BY i) FILTER (score >= 0.35), '') AS present, coalesce(string_agg(section, ',' ORDER BY i) FILTER (score >= 0.25 AND score < 0.35), '') AS thin, coalesce(string_agg(section, ',' ORDER BY i) FILTER (score < 0.25 AND required), '') AS missing, round(count(*) FILTER (score >= 0.35) / 7, 3) AS coverage FROM x GROUP BY doc_id""",
)(lambda s, d: structure.gap_report(said(s, d)))
# Two chunks in three and three statements in four have a vector of the embeddings table.
CHUNK_VECTOR, KB_VECTOR = "(doc_id * 5 + chunk_idx) % 500", "kb_idx * 31 % 500"


def gap_vectors(spark, folder, chunks):
    """Vectors of chunks and of statements."""
    v = spark.read.parquet(f"{folder}/embeddings.parquet").select("vec_id", "embedding")
    mine = chunks.filter("chunk_idx % 3 <> 1").select("doc_id", "chunk_idx", F.expr(CHUNK_VECTOR).alias("vec_id")).join(v, "vec_id").drop("vec_id")
    kb = spark.range(len(lexicons.KNOWLEDGE)).select(F.col("id").cast("int").alias("kb_idx")).filter("kb_idx % 4 <> 3")
    return mine, kb.withColumn("vec_id", F.expr(KB_VECTOR)).join(v, "vec_id").drop("vec_id")


query(
    "str5_vector_gaps",
    f"""WITH {GAPS}, e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), cv AS (SELECT doc_id, chunk_idx, v AS x FROM chunks JOIN e ON vec_id = {CHUNK_VECTOR} WHERE chunk_idx % 3 <> 1), kv AS (SELECT kb_idx, section, v AS y FROM kb JOIN e ON vec_id = {KB_VECTOR} WHERE kb_idx % 4 <> 3),
dense AS (SELECT doc_id, chunk_idx, kb_idx, section, list_dot_product(x, y) / (sqrt(list_dot_product(x, x)) * sqrt(list_dot_product(y, y))) AS c FROM cv, kv),
sparse AS (SELECT doc_id, chunk_idx, kb_idx, section, sum(cw.w / cw.norm * kw.w / kw.norm) AS c FROM cw JOIN kw ON cw.token = kw.token GROUP BY ALL),
va AS (SELECT * FROM dense UNION ALL SELECT * FROM sparse s WHERE NOT EXISTS (SELECT 1 FROM dense d WHERE d.doc_id = s.doc_id AND d.chunk_idx = s.chunk_idx AND d.kb_idx = s.kb_idx)),
vs AS (SELECT doc_id, section, round(max(c), 4) AS score FROM va GROUP BY ALL),
x AS (SELECT c.doc_id, i, a.section, required, coalesce(score, 0) AS score FROM (SELECT DISTINCT doc_id FROM chunks) c CROSS JOIN {ASKED} LEFT JOIN vs ON vs.doc_id = c.doc_id AND vs.section = a.section)
SELECT doc_id, coalesce(string_agg(section, ',' ORDER BY i) FILTER (score >= 0.35), '') AS present, coalesce(string_agg(section, ',' ORDER BY i) FILTER (score >= 0.25 AND score < 0.35), '') AS thin, coalesce(string_agg(section, ',' ORDER BY i) FILTER (score < 0.25 AND required), '') AS missing, round(count(*) FILTER (score >= 0.35) / 7, 3) AS coverage FROM x GROUP BY doc_id""",
)(lambda s, d: (lambda c: structure.gap_report(c, vectors=gap_vectors(s, d, c)))(corpus.written_once(said(s, d))))
SIGNS = ", ".join(f"CASE WHEN {' OR '.join(f"contains(t, '{w}')" for w in ws)} THEN '{k}' END" for k, ws in lexicons.SECTION_SIGNS)
query(
    "str5_keyword_gaps",
    f"""WITH {CHUNKS}, g AS (SELECT doc_id, list(DISTINCT section_type) AS k, lower(string_agg(text, ' ' ORDER BY chunk_idx)) AS t FROM chunks GROUP BY doc_id), f AS (SELECT doc_id, list_concat(k, list_filter([{SIGNS}], lambda x: x IS NOT NULL)) AS k FROM g),
l AS (SELECT doc_id, list_filter([{", ".join(map(quoted, lexicons.REQUIRED_SECTIONS))}], lambda x: list_contains(k, x)) AS p, list_filter([{", ".join(map(quoted, lexicons.REQUIRED_SECTIONS))}], lambda x: NOT list_contains(k, x)) AS m FROM f)
SELECT doc_id, array_to_string(p, ',') AS present, array_to_string(m, ',') AS missing, round(len(p) / 7, 3) AS coverage FROM l""",
)(lambda s, d: structure.keyword_gaps(chunks(s, d)))

# Embedded headings: the paragraphs of a section are its blocks, some of them shaped like headings.
SHAPED = "CASE (block_idx + doc_id) % 11 WHEN 1 THEN 'Data Sources' WHEN 3 THEN 'IV. Of what was seen' WHEN 4 THEN 'limitations' WHEN 6 THEN 'LONG AND LOUD:' WHEN 8 THEN 'Accuracy: 95%' WHEN 9 THEN 'THE THIRD PART' ELSE text END"
LETTERS = r"len(regexp_extract_all({0}, '\p{{L}}'))"
HEADING = rf"""length(v) <= 120 AND n BETWEEN 1 AND 10 AND NOT ({" OR ".join(f"regexp_matches(lower(v), {quoted(p)})" for p in structure.HEADING_BARS)} OR regexp_matches(v, '{structure.CITED_YEAR}') OR regexp_matches(v, ':\s*(?:\d|~)') OR len(regexp_extract_all(v, '[0-9]')) >= 2 OR lower(v) IN {IN(structure.NO_HEADINGS)})
AND (regexp_matches(v, '{structure.HEADING_MARK}') OR (NOT regexp_matches(v, '[.,;:]$') AND ((l > 0 AND u / greatest(l, 1) > 0.65) OR (n <= 8 AND titled >= greatest(1, floor(len({WORDS.format("v")}) / 2))) OR lower(v) IN {IN(structure.KNOWN_HEADINGS)})))"""
query(
    "str8_embedded_headings",
    rf"""WITH {BLOCKS}, p AS (SELECT doc_id, CAST(floor(block_idx / 6) AS INT) AS section_idx, block_idx AS para_idx, {SHAPED} AS text FROM blocks), v AS (SELECT *, {SPACED.format("text")} AS v, row_number() OVER (PARTITION BY doc_id, section_idx ORDER BY para_idx) AS nth FROM p),
c AS (SELECT *, len(regexp_extract_all(v, '[A-Za-z0-9]+')) AS n, len(regexp_extract_all(v, '\p{{Lu}}')) AS u, len(regexp_extract_all(v, '\p{{L}}')) AS l, len(list_filter({WORDS.format("v")}, lambda w: regexp_matches(w, '^\p{{Lu}}'))) AS titled FROM v), h AS (SELECT *, nth > 1 AND {HEADING} AS head FROM c),
i AS (SELECT *, sum(CASE WHEN head THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, section_idx ORDER BY para_idx) AS island FROM h),
g AS (SELECT doc_id, section_idx, island, max(v) FILTER (head) AS title, count(*) FILTER (NOT head) AS n_paragraphs, md5(string_agg(text, chr(10) ORDER BY para_idx) FILTER (NOT head)) AS digest FROM i GROUP BY ALL)
SELECT doc_id, section_idx, CAST(row_number() OVER (PARTITION BY doc_id, section_idx ORDER BY island) AS INT) AS sub_idx, title, n_paragraphs, digest FROM g WHERE n_paragraphs > 0""",
)(lambda s, d: digest(structure.embedded_headings(blocks(s, d).select("doc_id", F.floor(F.col("block_idx") / 6).cast("int").alias("section_idx"), F.col("block_idx").alias("para_idx"), F.expr(SHAPED).alias("text")))))

# Document parts: blocks with an abstract, keywords, tables and a list of references among them.
PART_TYPE = "CASE WHEN block_idx = 0 AND doc_id % 4 = 0 THEN 'title' WHEN (block_idx = 1 AND doc_id % 3 > 0) OR (block_idx = 9 AND doc_id % 2 = 0) THEN 'heading' WHEN section_level IS NOT NULL THEN 'heading' WHEN block_idx % 10 = 7 THEN 'table' ELSE 'paragraph' END"
PART_TEXT = "CASE WHEN block_idx = 1 AND doc_id % 3 > 0 THEN 'I. Abstract' WHEN block_idx = 9 AND doc_id % 2 = 0 THEN 'References' WHEN block_idx = 3 AND doc_id % 5 = 1 THEN concat('Keywords: a; ', text) WHEN block_idx = 8 AND doc_id % 7 = 2 THEN concat('[1] ', text) WHEN block_idx = 4 AND doc_id % 5 = 3 THEN 'Contents' ELSE text END"
FONT = "CASE WHEN block_idx = 0 THEN 18.0 WHEN section_level IS NOT NULL THEN 13.0 + doc_id % 3 * 2.5 ELSE 10.0 END"
CLEAN = r"CASE WHEN {0} <> '' THEN {0} ELSE " + STRIP.format("text") + " END"
CLEAN = CLEAN.format(r"regexp_replace(regexp_replace(regexp_replace(" + STRIP.format("text") + ", '" + zones.TITLE_NUMBER + r"', ''), '\s+', ' ', 'g'), '^[ _\t-]+|[ _\t-]+$', '', 'g')")
DPARTS = rf"""{BLOCKS}, b AS (SELECT doc_id, block_idx, {PART_TYPE} AS type, {PART_TEXT} AS text, {FONT} AS font_size FROM blocks), c AS (SELECT *, {STRIP.format("text")} AS s, {CLEAN} AS clean, {SPACED.format("text")} AS v, row_number() OVER (PARTITION BY doc_id ORDER BY block_idx) AS nth FROM b),
e AS (SELECT *, {MARGINAL} AS marginal FROM c WHERE nth <= 30 AND s <> ''), ab AS (SELECT *, type IN ('title', 'heading') AND NOT marginal AS able FROM e), lg AS (SELECT doc_id, font_size AS size, type = 'title' AS t FROM ab WHERE able QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY font_size DESC, nth) = 1),
ft AS (SELECT ab.*, coalesce(able AND abs(font_size - size) <= 0.5 AND (size >= 12 OR t), false) AS fits FROM ab LEFT JOIN lg ON ab.doc_id = lg.doc_id), k AS (SELECT *, sum(CAST(fits AS INT)) OVER (PARTITION BY doc_id ORDER BY nth) AS k FROM ft),
tt AS (SELECT doc_id, coalesce(string_agg(clean, ' ' ORDER BY nth) FILTER (fits AND k <= 3), '') AS a, arg_min(clean, nth) FILTER (NOT marginal AND len({WORDS.format("text")}) <= 30) AS b FROM k GROUP BY doc_id), titles AS (SELECT doc_id, CASE WHEN a <> '' THEN a ELSE b END AS title FROM tt),
r AS (SELECT c.*, title, type = 'heading' AS head, type = 'heading' AND contains(lower(coalesce(title, '')), lower(clean)) AS in_title FROM c LEFT JOIN titles ON c.doc_id = titles.doc_id WHERE s <> '' OR type = 'table'),
ev AS (SELECT *, CASE WHEN head AND NOT in_title THEN CASE WHEN lower(clean) IN {IN(zones.REFERENCE_TITLES)} THEN 'r' WHEN lower(clean) = 'abstract' THEN 'a' ELSE 's' END WHEN type = 'paragraph' AND regexp_matches(s, '^\[\d+\]\s+\S+') THEN 'r' END AS event FROM r),
li AS (SELECT *, coalesce(last_value(CASE WHEN event <> 's' THEN event END IGNORE NULLS) OVER w, '') = 'r' AS listed FROM ev WINDOW w AS (PARTITION BY doc_id ORDER BY block_idx)), op AS (SELECT *, coalesce(event = 's' AND NOT listed, false) AS opens FROM li),
st AS (SELECT *, last_value(CASE WHEN opens THEN 's' WHEN event = 'a' THEN 'a' END IGNORE NULLS) OVER w AS state, sum(CAST(opens AS INT)) OVER w AS section_idx FROM op WINDOW w AS (PARTITION BY doc_id ORDER BY block_idx)),
pt AS (SELECT *, CASE WHEN type = 'title' THEN 'title' WHEN in_title THEN 'dropped' WHEN head AND event IN ('r', 'a') THEN 'dropped' WHEN listed THEN 'references' WHEN head THEN 'heading' WHEN type = 'table' THEN CASE WHEN state = 's' THEN 'table' ELSE 'dropped' END WHEN starts_with(lower(s), 'abstract:') THEN 'abstract'
WHEN regexp_matches(s, '{zones.KEYWORDS}') THEN 'keywords' WHEN state = 'a' THEN 'abstract' WHEN state = 's' AND lower(s) NOT IN {IN(structure.FRONT_MATTER)} THEN 'body' ELSE 'dropped' END AS part FROM st),
fu AS (SELECT *, bool_or(part = 'body') OVER w AND NOT coalesce(bool_or(part = 'heading' AND lower(clean) IN {IN(structure.FRONT_MATTER)}) OVER w, false) AS filled FROM pt WINDOW w AS (PARTITION BY doc_id, section_idx))"""


def parted(s, d):
    return blocks(s, d).select("doc_id", "block_idx", F.expr(PART_TYPE).alias("type"), F.expr(PART_TEXT).alias("text"), F.expr(FONT.replace(".0 ", ".0D ").replace("2.5 ", "2.5D ")).cast("double").alias("font_size"))


query("seg25_document_title", f"WITH {DPARTS} SELECT * FROM titles")(lambda s, d: structure.document_title(parted(s, d)))
query("seg25_document_parts", f"WITH {DPARTS} SELECT doc_id, block_idx, CASE WHEN part IN ('heading', 'body', 'table') AND NOT filled THEN 'dropped' ELSE part END AS part, section_idx FROM fu")(lambda s, d: structure.document_parts(corpus.written_once(parted(s, d))))

# Shingles
query(
    "sim12_shingle_candidates",
    rf"""WITH t AS (SELECT min(doc_id) AS d, lower({STRIP.format(r"regexp_replace(text, '\s+', ' ', 'g')")}) AS t FROM {FILLED} WHERE {STRIP.format("text")} <> '' GROUP BY 2), w AS (SELECT d, string_split(t, ' ') AS w FROM t),
s AS (SELECT DISTINCT d, array_to_string(w[i : i + 4], ' ') AS s FROM (SELECT d, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w)), n AS (SELECT d, count(*) AS n FROM s GROUP BY d),
o AS (SELECT a.d AS a_id, b.d AS b_id, count(*) AS o FROM s a JOIN s b ON a.s = b.s AND a.d < b.d GROUP BY ALL), j AS (SELECT a_id, b_id, o / (x.n + y.n - o) AS jaccard FROM o JOIN n x ON a_id = x.d JOIN n y ON b_id = y.d)
SELECT a_id, b_id, round(jaccard, 6) AS jaccard FROM j WHERE jaccard >= 0.8 - 1e-9""",
)(lambda s, d: similarity.shingle_candidates(docs(s, d)))

# Boilerplate at the default share, by letters, and with title pages kept.
LETTERS_ONLY = r"trim(regexp_replace(regexp_replace(lower(regexp_replace({0}, '[0-9]+', '#', 'g')), '[^a-z# ]+', ' ', 'g'), '\s+', ' ', 'g'))"


def repeated(fingerprint: str, share: float, least_docs: int = 0) -> str:
    return f"""WITH lines AS (SELECT DISTINCT source, doc_id, fingerprint FROM (SELECT source, doc_id, {fingerprint.format("unnest(string_split(text, chr(10)))")} AS fingerprint FROM {FILLED}) WHERE fingerprint <> ''),
sizes AS (SELECT source, greatest(2, floor(count(*) * {share})) AS least FROM {FILLED} GROUP BY source HAVING count(*) >= {least_docs}), found AS (SELECT source, fingerprint, count(*) AS n_docs FROM lines GROUP BY ALL),
kept AS (SELECT f.source, fingerprint, n_docs FROM found f JOIN sizes s ON f.source = s.source WHERE n_docs >= least)"""


query("seg13_boilerplate_default", f"{repeated(FINGERPRINT, 0.40)} SELECT * FROM kept")(lambda s, d: segment.boilerplate_lines(docs(s, d)))
for _name, _share in (("seg13_boilerplate_letters", 0.35), ("seg13_boilerplate_letters_low", 0.03)):
    query(_name, f"{repeated(LETTERS_ONLY, _share, 3)} SELECT * FROM kept")(lambda s, d, x=_share: segment.boilerplate_lines(docs(s, d), share=x, letters=True, least_docs=3))
# Documents of a source begin with one line, but for the second in every other source.
TITLED = "(SELECT doc_id, source, concat(CASE WHEN doc_id % 17 = 3 THEN 'Other head' ELSE concat('Head of ', source) END, chr(10), text) AS text FROM documents WHERE trim(text) <> '')"
query(
    "seg13_drop_lines_titles",
    f"""{repeated(FINGERPRINT, 0.40).replace(FILLED, TITLED)}, tops AS (SELECT source, doc_id, {FINGERPRINT.format("string_split(text, chr(10))[1]")} AS top, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k FROM {TITLED}),
titles AS (SELECT a.source, a.doc_id, a.top AS fingerprint FROM tops a JOIN tops b ON a.source = b.source AND a.k = 1 AND b.k = 2 WHERE a.top <> b.top), rows AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM {TITLED}),
f AS (SELECT *, {FINGERPRINT.format("line")} AS fingerprint FROM rows), l AS (SELECT f.doc_id, string_agg(line, chr(10) ORDER BY i) AS text FROM f LEFT JOIN kept k ON k.source = f.source AND k.fingerprint = f.fingerprint LEFT JOIN titles t ON t.source = f.source AND t.doc_id = f.doc_id AND t.fingerprint = f.fingerprint AND i = 1 WHERE k.source IS NULL OR t.source IS NOT NULL GROUP BY f.doc_id)
SELECT d.doc_id, md5(coalesce(l.text, '')) AS digest FROM {TITLED} d LEFT JOIN l ON d.doc_id = l.doc_id""",
)(lambda s, d: (lambda x: digest(segment.drop_lines(x, segment.boilerplate_lines(x), titles=segment.title_documents(x))))(s.read.parquet(f"{d}/documents.parquet").filter("trim(text) <> ''").selectExpr("doc_id", "source", "concat(CASE WHEN doc_id % 17 = 3 THEN 'Other head' ELSE concat('Head of ', source) END, chr(10), text) AS text")))

# Cleaning profiles
WRAPPED = r"concat('% first', chr(10), '{b}section{{One}} {b}textbf{{bold}} {b}emph{{soft}} {b}cite{{k1}} {b}citep{{k2}} {b}citet{{k3}} {b}label{{x}} {b}ref{{x}} {b}begin{{itemize}} {b}item a  b {b}end{{itemize}} {b}footnote[2]{{note}} ', text, chr(10), chr(10), '  ', chr(10), '{b}alpha rest {b}subsection{{Two}}', CASE WHEN doc_id % 3 = 0 THEN '{b}end{{document}} after' ELSE '' END)"
WRAPPED = "concat(CASE WHEN doc_id % 2 = 0 THEN '{b}usepackage{{x}} {b}begin{{document}}' ELSE '' END, " + WRAPPED + ")"
LATEX_SQL = "w"
for _p, _r in segment.LATEX:
    if _p:
        LATEX_SQL = f"regexp_replace({LATEX_SQL}, {quoted(_p)}, {_r and ' || '.join('chr(10)' if x == chr(10) else quoted(x) for x in _r.replace('$', chr(92)).replace(chr(10), chr(0) + chr(10) + chr(0)).split(chr(0)) if x) or quoted('')}, 'g')"
    else:
        _begin = f"CASE WHEN instr({LATEX_SQL}, '{segment.DOCUMENT_BEGINS}') > 0 THEN substr({LATEX_SQL}, instr({LATEX_SQL}, '{segment.DOCUMENT_BEGINS}')) ELSE {LATEX_SQL} END"
        LATEX_SQL = f"CASE WHEN instr({_begin}, '{segment.DOCUMENT_ENDS}') > 0 THEN substr({_begin}, 1, instr({_begin}, '{segment.DOCUMENT_ENDS}') - 1) ELSE {_begin} END"
query("seg19_clean_latex", f"WITH t AS (SELECT doc_id, {WRAPPED.format(b=chr(92))} AS w FROM {FILLED}) SELECT doc_id, md5({STRIP.format(LATEX_SQL)}) AS digest FROM t")(
    lambda s, d: digest(segment.clean_text(docs(s, d).select("doc_id", F.expr(WRAPPED.format(b=chr(92) * 2)).alias("text")), "latex"))
)
HYPHENATED = "replace(text, ' a', concat('x-', chr(10), 'a'))"
query("seg19_join_hyphens", f"SELECT doc_id, md5(regexp_replace({HYPHENATED}, {quoted(segment.HYPHEN)}, '\\1\\2', 'g')) AS digest FROM {FILLED}")(lambda s, d: digest(segment.clean_text(docs(s, d).select("doc_id", F.expr(HYPHENATED).alias("text")), "hyphens")))

# The second set of text rules
RULED = "concat(text, chr(10), 'So your running  home , now. their is a way! its was Their  are two . x', CASE WHEN doc_id % 2 = 0 THEN ' we Recieve it' ELSE '' END, CASE WHEN doc_id % 3 = 0 THEN ' a bussiness wether' ELSE '' END)"
_steps = [
    ("regexp_replace({0}, ' {{2,}}', ' ', 'g')", "CASE WHEN contains({0}, '  ') THEN 'whitespace' END"), (r"regexp_replace({0}, '\s+([.,!?;:])', '\1', 'g')", r"CASE WHEN regexp_matches({0}, '\s+([.,!?;:])') THEN 'punctuation' END"),
    (r"array_to_string(list_transform(list_zip(string_split_regex({0}, '[.!?]\s+[a-z]'), regexp_extract_all({0}, '[.!?]\s+[a-z]')), lambda z: z[1] || coalesce(z[2][1:1] || ' ' || upper(right(z[2], 1)), '')), '')", None),
    (rf"regexp_replace({{0}}, '(?i)\byour\s+({language.YOUR_VERBS})\b', 'you''re \1', 'g')", None), (r"regexp_replace({0}, '(?i)\btheir\s+(is|are|was|were)\b', 'there \1', 'g')", None), (r"regexp_replace({0}, '(?i)\bits\s+(is|are|was|were|has|have|had)\b', 'it''s \1', 'g')", None),
    *[(rf"regexp_replace({{0}}, '(?i)\b{a}\b', '{b}', 'g')", rf"CASE WHEN regexp_matches({{0}}, '(?i)\b{a}\b') THEN '{a}' END") for a, b in language.SPELLINGS],
]
RULES_SQL = f"WITH t0 AS (SELECT doc_id, {RULED} AS x FROM {FILLED})"
for _i, (_new, _change) in enumerate(_steps):
    RULES_SQL += f", t{_i + 1} AS (SELECT * EXCLUDE (x), {_new.format('x')} AS x, {_change.format('x') if _change else 'NULL'} AS c{_i} FROM t{_i})"
query("lng4_basic_enhancements", f"{RULES_SQL} SELECT doc_id, md5(x) AS digest, concat_ws(',', {', '.join(f'c{i}' for i in range(len(_steps)))}) AS changes FROM t{len(_steps)}")(lambda s, d: digest(language.basic_enhancements(docs(s, d).select("doc_id", F.expr(RULED).alias("text")))))


# Sources and sinks: written to the shared folder and read back.
@query("src2_load_text_files", "SELECT item_id, md5(text || chr(10)) AS digest FROM benchmark WHERE text IS NOT NULL")
def text_files(spark, folder):
    """The benchmark's texts as one file each."""
    path = corpus.shared_folder(spark)
    spark.read.parquet(f"{folder}/benchmark.parquet").filter("text is not null").repartition("item_id").write.partitionBy("item_id").text(path)
    return digest(corpus.load_text_files(spark, f"{path}/*/*.txt").select(F.regexp_extract("path", r"item_id=(\d+)", 1).cast("long").alias("item_id"), "text"))


@query("snk1_write_results", f"SELECT doc_id, lang, source, md5(text) AS digest FROM {FILLED}")
def appended(spark, folder):
    """The corpus appended in two halves as JSON lines, in folders by source."""
    path = corpus.shared_folder(spark)
    rows = docs(spark, folder).select("doc_id", "lang", "source", "text")
    for half in (rows.filter("doc_id % 2 = 0"), rows.filter("doc_id % 2 <> 0 or doc_id is null")):
        corpus.write_results(half, path, "json", ["source"])
    return digest(spark.read.schema("doc_id long, lang string, text string, source string").json(path))


@query("snk1_resumed_results", f"SELECT doc_id, i - 1 AS line_no, md5(l[i]) AS digest FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM {FILLED}))")
def resumed(spark, folder):
    """Lines of the corpus as JSON lines in four steps: a run that ends after one, a run that fails within a step after its rows
    have been computed in part, and a run that does what is missing."""
    path = corpus.shared_folder(spark)
    rows = docs(spark, folder).select("doc_id", "text")
    lines = lambda df: df.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))
    broken = lambda df: lines(df).withColumn("line", F.when(F.pmod(F.xxhash64("doc_id"), F.lit(3)) == 0, F.raise_error(F.lit("a planned stop"))).otherwise(F.col("line")))
    results.resume_results(rows, path, ["doc_id"], lines, "json", steps=4, most_steps=1)
    try:
        results.resume_results(rows, path, ["doc_id"], broken, "json", steps=4)
    except Exception as e:
        if "a planned stop" not in str(e):
            raise
    results.resume_results(rows, path, ["doc_id"], lines, "json", steps=4)
    return results.read_results(spark, path, "doc_id long, line_no int, line string", "json").select("doc_id", "line_no", F.md5("line").alias("digest"))
