"""Registered queries on texts (sources, segmentation, similarity, writing style, language) and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.functions import lexicons
from vellum.operators import detect, language, segment, similarity, terms, vectors
from vellum.sources import corpus

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def docs(spark: SparkSession, folder: str) -> DataFrame:
    return corpus.load_corpus(spark, folder)


def bench(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/benchmark.parquet").select(F.col("item_id").alias("source_id"), "text")


STRIP = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"
WORDS = r"list_filter(string_split_regex({0}, '\s+'), lambda w: w <> '')"
FILLED = "(SELECT * FROM documents WHERE trim(text) <> '')"
PUNCT = r"list_filter(string_split(regexp_replace(" + STRIP.format("text") + r", '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: s <> '')"
PERIOD = "list_transform(list_filter(list_transform(string_split(text, '.'), lambda s: " + STRIP.format("s") + "), lambda s: s <> ''), lambda s: s || '.')"
ANY = "list_filter(list_transform(string_split_regex(text, '[.!?]+'), lambda s: " + STRIP.format("s") + "), lambda s: s <> '')"
TOKENS = r"regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}_]{{2,}}')"


def quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def contained(words: list[str], text: str = "lower(text)") -> str:
    return " + ".join(f"CAST(contains({text}, {quoted(w)}) AS INT)" for w in words)


query("src1_load_corpus", f"SELECT doc_id, lang, source, n_chars, length(text) AS n FROM {FILLED}")(lambda s, d: docs(s, d).select("doc_id", "lang", "source", "n_chars", F.length("text").alias("n")))

PAGE = "substring(trim(regexp_replace(html, '<[^>]+>', ' ', 'g')), 1, 3000)"
query("src3_page_sources", f"SELECT page_id, url, md5({PAGE}) AS digest FROM pages WHERE length({PAGE}) >= 50")(lambda s, d: corpus.load_page_sources(s, d).select("page_id", "url", F.md5("text").alias("digest")))


@query(
    "src4_corpus_metadata",
    f"""WITH w AS (SELECT doc_id, len({WORDS.format("text")}) AS n_words FROM {FILLED})
SELECT doc_id, n_words, CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 0 END AS n_tables, CASE WHEN doc_id % 3 = 0 THEN doc_id % 4 ELSE 0 END AS n_images, 0 AS n_graphs,
CAST(ceil(n_words / 250) + ceil(0.5 * CASE WHEN doc_id % 3 = 0 THEN 1 + doc_id % 4 ELSE 0 END) AS BIGINT) AS n_pages FROM w""",
)
def metadata(spark, folder):
    d = docs(spark, folder)
    some = d.filter("doc_id % 3 = 0")
    images = some.select("doc_id", F.explode(F.array_repeat(F.lit("image"), (F.col("doc_id") % 4).cast("int"))).alias("kind"))
    return corpus.corpus_metadata(d, some.select("doc_id", F.lit("table").alias("kind")).union(images))


for _mode, _list in (("punct", PUNCT), ("period", PERIOD), ("any", ANY)):
    query(f"seg1_sentences_{_mode}", f"SELECT doc_id, unnest(l) AS sentence, CAST(generate_subscripts(l, 1) - 1 AS INT) AS sent_idx FROM (SELECT doc_id, {_list} AS l FROM {FILLED})")(lambda s, d, m=_mode: segment.explode_sentences(docs(s, d), m))


def chunks_sql(k: int, table: str = FILLED) -> str:
    return f"""SELECT doc_id, CAST((i - 1) / {k} AS INT) AS chunk_idx, array_to_string(l[i : i + {k - 1}], ' ') AS chunk
FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1, {k})) AS i FROM (SELECT doc_id, {PERIOD} AS l FROM {table}))"""


query("seg2_sentence_chunks", chunks_sql(3))(lambda s, d: segment.sentence_chunks(docs(s, d)))

query(
    "seg3_lines_to_blocks",
    rf"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM {FILLED}),
s AS (SELECT doc_id, line_no, {STRIP.format("raw")} AS line FROM l),
n AS (SELECT doc_id, line_no, line, lead(line) OVER (PARTITION BY doc_id ORDER BY line_no) AS nxt FROM s),
k AS (SELECT *, len({WORDS.format("line")}) AS n FROM n WHERE line <> ''),
f AS (SELECT *, (regexp_matches(line, '(?i)^chapter\s+[0-9]+') AND n <= 12) OR (n <= 8 AND line = upper(line) AND regexp_matches(line, '[A-Z]')) AS h1, regexp_matches(line, '^[0-9]+(\.[0-9]+)?\s+[A-Z]') AND n <= 10 AS h2 FROM k)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY line_no) - 1 AS INT) AS block_idx,
CASE WHEN h1 THEN 'Heading 1' WHEN h2 THEN 'Heading 2' WHEN n <= 6 AND nxt = '' THEN 'Heading 3' ELSE 'Normal' END AS style,
CASE WHEN NOT h1 AND h2 THEN regexp_replace(line, '^[0-9]+(\.[0-9]+)?\s+', '') ELSE line END AS text FROM f""",
)(lambda s, d: segment.lines_to_blocks(docs(s, d)))

FINGERPRINT = r"lower(trim(regexp_replace(regexp_replace({0}, '[0-9]+', '#', 'g'), '\s+', ' ', 'g')))"
BOILERPLATE = f"""WITH lines AS (SELECT DISTINCT source, doc_id, fingerprint FROM (SELECT source, doc_id, {FINGERPRINT.format("unnest(string_split(text, chr(10)))")} AS fingerprint FROM {FILLED}) WHERE fingerprint <> ''),
sizes AS (SELECT source, greatest(2, floor(count(*) * 0.04)) AS least FROM {FILLED} GROUP BY source),
found AS (SELECT source, fingerprint, count(*) AS n_docs FROM lines GROUP BY ALL),
kept AS (SELECT f.source, fingerprint, n_docs FROM found f JOIN sizes s ON f.source = s.source WHERE n_docs >= least)"""
query("seg13_boilerplate_lines", f"{BOILERPLATE} SELECT * FROM kept")(lambda s, d: segment.boilerplate_lines(docs(s, d), share=0.04))
query(
    "seg13_drop_lines",
    f"""{BOILERPLATE}, rows AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM {FILLED}),
left_over AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY i) AS text FROM rows r WHERE NOT EXISTS (SELECT 1 FROM kept k WHERE k.source = r.source AND k.fingerprint = {FINGERPRINT.format("r.line")}) GROUP BY doc_id)
SELECT d.doc_id, md5(coalesce(l.text, '')) AS digest FROM {FILLED} d LEFT JOIN left_over l ON d.doc_id = l.doc_id""",
)(lambda s, d: segment.drop_lines(docs(s, d), segment.boilerplate_lines(docs(s, d), share=0.04)).select("doc_id", F.md5("text").alias("digest")))

CLEANED = r"regexp_replace(text, '\s+', ' ', 'g')"
for _p, _r in ((r"\s+([.,;:!?])", r"\1"), (r"([.,;:!?])([\p{L}\p{N}_])", r"\1 \2"), (r'\s+"', '"'), (r'"\s+', '"'), (r"(?i)\b(do|ca|wo|should|would|could|is|are|was|were|has|have|had)nt\b", r"\1n''t")):
    CLEANED = f"regexp_replace({CLEANED}, '{_p}', '{_r}', 'g')"
query("seg19_clean_text", f"SELECT doc_id, md5(trim({CLEANED})) AS digest FROM {FILLED}")(lambda s, d: segment.clean_text(docs(s, d)).select("doc_id", F.md5("text").alias("digest")))


# Similarity


def tfidf_sql(units: str, keys: str, weights: str) -> str:
    """Common table expressions: tokens with weights of the units (keys, text)."""
    return f"""{weights}_u AS ({units}),
{weights}_c AS (SELECT {keys}, token, count(*) AS tf FROM (SELECT {keys}, unnest({TOKENS.format("text")}) AS token FROM {weights}_u) GROUP BY ALL),
{weights}_i AS (SELECT token, ln((1.0 + (SELECT count(*) FROM {weights}_u)) / (1.0 + count(*))) + 1 AS idf FROM {weights}_c GROUP BY token),
{weights} AS (SELECT {keys}, c.token, tf * idf AS w FROM {weights}_c c JOIN {weights}_i i ON c.token = i.token)"""


query("sim1_tfidf_vectors", f"WITH {tfidf_sql('SELECT item_id, text FROM benchmark', 'item_id', 'x')} SELECT item_id, token, round(w / sqrt(sum(w * w) OVER (PARTITION BY item_id)), 6) AS weight FROM x")(
    lambda s, d: similarity.tfidf_vectors(bench(s, d).withColumnRenamed("source_id", "item_id"), ["item_id"]).select("item_id", "token", F.round("weight", 6).alias("weight"))
)


def matches_sql(k: int, threshold: float, table: str = FILLED) -> str:
    """Common table expressions chunks and matches."""
    return f"""WITH chunks AS ({chunks_sql(k, table)}),
{tfidf_sql("SELECT doc_id AS a, chunk_idx AS b, NULL::BIGINT AS s, chunk AS text FROM chunks UNION ALL SELECT NULL, NULL, item_id, text FROM benchmark", "a, b, s", "x")},
n1 AS (SELECT a, b, sqrt(sum(w * w)) AS norm FROM x WHERE s IS NULL GROUP BY a, b), n2 AS (SELECT s, sqrt(sum(w * w)) AS norm FROM x WHERE s IS NOT NULL GROUP BY s),
dots AS (SELECT p.a, p.b, q.s, sum(p.w * q.w) AS dot FROM x p JOIN x q ON p.token = q.token WHERE p.s IS NULL AND q.s IS NOT NULL GROUP BY ALL),
matches AS (SELECT dots.a AS doc_id, dots.b AS chunk_idx, dots.s AS source, round(dot / (n1.norm * n2.norm), 4) AS similarity FROM dots JOIN n1 ON dots.a = n1.a AND dots.b = n1.b JOIN n2 ON dots.s = n2.s
WHERE round(dot / (n1.norm * n2.norm), 4) >= {threshold})"""


query(
    "sim2_match_chunks",
    f"""{matches_sql(2, 0.35)} SELECT m.doc_id, m.chunk_idx, source, similarity, round(similarity * 100, 2) AS percent, CASE WHEN length(chunk) > 100 THEN chunk[1:100] || '...' ELSE chunk END AS preview
FROM matches m JOIN chunks c ON m.doc_id = c.doc_id AND m.chunk_idx = c.chunk_idx""",
)(lambda s, d: similarity.match_chunks(segment.sentence_chunks(docs(s, d), 2), bench(s, d), 0.35))

REPORT = """, totals AS (SELECT doc_id, count(*) AS total_chunks FROM chunks GROUP BY doc_id),
found AS (SELECT doc_id, floor(sum(CAST(round(similarity * 10000) AS BIGINT)) / count(*) + 0.5) / 10000 AS score, count(*) AS n_matches, count(DISTINCT source) AS n_sources, count(DISTINCT chunk_idx) AS chunks_with_matches, max(similarity) AS max_similarity, min(similarity) AS min_similarity FROM matches GROUP BY doc_id),
r AS (SELECT t.doc_id, total_chunks, coalesce(score, 0) AS score, coalesce(n_matches, 0) AS n_matches, coalesce(n_sources, 0) AS n_sources, coalesce(chunks_with_matches, 0) AS chunks_with_matches, coalesce(max_similarity, 0) AS max_similarity, coalesce(min_similarity, 0) AS min_similarity FROM totals t LEFT JOIN found f ON t.doc_id = f.doc_id)
SELECT *, CASE WHEN score >= 0.9 THEN 'Critical' WHEN score >= 0.8 THEN 'High' WHEN score >= 0.7 THEN 'Medium' WHEN score >= {0} THEN 'Low' ELSE 'None' END AS level FROM r"""
query("sim3_plagiarism_report", matches_sql(2, 0.5) + REPORT.format(0.5))(lambda s, d: similarity.batch_check(docs(s, d), bench(s, d), 0.5))
query("sim10_batch_check", matches_sql(2, 0.75) + REPORT.format(0.75))(lambda s, d: similarity.batch_check(docs(s, d), bench(s, d)))
query("sim4_similar_sentences", f"{matches_sql(1, 0.7)} SELECT m.doc_id, m.chunk_idx AS sent_idx, source, similarity, chunk[1:80] AS preview FROM matches m JOIN chunks c ON m.doc_id = c.doc_id AND m.chunk_idx = c.chunk_idx")(
    lambda s, d: similarity.similar_sentences(docs(s, d), bench(s, d))
)


@query(
    "sim2_vector_matches",
    matches_sql(2, 0.4) + """, e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), cv AS (SELECT doc_id, chunk_idx, chunk, v AS x FROM chunks JOIN e ON vec_id = (doc_id * 7 + chunk_idx) % 500 WHERE chunk_idx % 2 = 0), sv AS (SELECT item_id AS source, v AS y FROM benchmark JOIN e ON vec_id = item_id % 500 WHERE item_id % 3 <> 0),
d AS (SELECT doc_id, chunk_idx, source, round(list_dot_product(x, y) / (sqrt(list_dot_product(x, x)) * sqrt(list_dot_product(y, y))), 4) AS similarity FROM cv, sv)
SELECT doc_id, chunk_idx, source, similarity FROM d WHERE similarity >= 0.4 UNION ALL SELECT doc_id, chunk_idx, source, similarity FROM matches m WHERE NOT (chunk_idx % 2 = 0 AND source % 3 <> 0)""",
)
def vector_chunks(spark, folder):
    """Every second chunk and two sources in three have a vector of the embeddings table."""
    v = spark.read.parquet(f"{folder}/embeddings.parquet").select("vec_id", "embedding")
    chunks, sources = segment.sentence_chunks(docs(spark, folder), 2), bench(spark, folder)
    mine = chunks.filter("chunk_idx % 2 = 0").select("doc_id", "chunk_idx", ((F.col("doc_id") * 7 + F.col("chunk_idx")) % 500).alias("vec_id")).join(v, "vec_id").drop("vec_id")
    theirs = sources.filter("source_id % 3 <> 0").select("source_id", (F.col("source_id") % 500).alias("vec_id")).join(v, "vec_id").drop("vec_id")
    return similarity.match_chunk_vectors(chunks, sources, mine, theirs, 0.4).select("doc_id", "chunk_idx", "source", "similarity")


PAIRS = "SELECT doc_id AS a_id, d.text AS a_text, b.item_id AS b_id, b.text AS b_text FROM documents d JOIN (SELECT item_id, text, item_id AS k FROM benchmark) b ON d.doc_id % (SELECT count(*) FROM benchmark) = b.k"


def pairs(spark, folder):
    b = bench(spark, folder)
    n = b.count()
    d = spark.read.parquet(f"{folder}/documents.parquet")
    return d.withColumn("b_id", F.col("doc_id") % n).join(b.select(F.col("source_id").alias("b_id"), F.col("text").alias("b_text")), "b_id").select(F.col("doc_id").alias("a_id"), F.col("text").alias("a_text"), "b_id", "b_text")


#: Three partners for each document.
TRIPLES = "SELECT DISTINCT doc_id AS a_id, d.text AS a_text, b.item_id AS b_id, b.text AS b_text FROM documents d JOIN benchmark b ON b.item_id IN (d.doc_id % (SELECT count(*) FROM benchmark), (d.doc_id + 1) % (SELECT count(*) FROM benchmark), (7 * d.doc_id + 3) % (SELECT count(*) FROM benchmark))"


def triples(spark, folder):
    b = bench(spark, folder)
    n = b.count()
    ids = F.array_distinct(F.array(F.col("doc_id") % n, (F.col("doc_id") + 1) % n, (7 * F.col("doc_id") + 3) % n))
    d = spark.read.parquet(f"{folder}/documents.parquet").withColumn("b_id", F.explode(ids))
    return d.join(b.select(F.col("source_id").alias("b_id"), F.col("text").alias("b_text")), "b_id").select(F.col("doc_id").alias("a_id"), F.col("text").alias("a_text"), "b_id", "b_text")


def pair_sql(pairs_sql: str) -> str:
    return f"""p AS ({pairs_sql}), ta AS (SELECT a_id, b_id, token, count(*) AS n FROM (SELECT a_id, b_id, unnest({TOKENS.format("a_text")}) AS token FROM p) GROUP BY ALL),
tb AS (SELECT a_id, b_id, token, count(*) AS n FROM (SELECT a_id, b_id, unnest({TOKENS.format("b_text")}) AS token FROM p) GROUP BY ALL),
both_sides AS (SELECT coalesce(ta.a_id, tb.a_id) AS a_id, coalesce(ta.b_id, tb.b_id) AS b_id, coalesce(ta.n, 0) * CASE WHEN ta.n > 0 AND tb.n > 0 THEN 1 ELSE ln(1.5) + 1 END AS x, coalesce(tb.n, 0) * CASE WHEN ta.n > 0 AND tb.n > 0 THEN 1 ELSE ln(1.5) + 1 END AS y
FROM ta FULL JOIN tb ON ta.a_id = tb.a_id AND ta.b_id = tb.b_id AND ta.token = tb.token),
pair_scores AS (SELECT a_id, b_id, CASE WHEN sum(x * x) > 0 AND sum(y * y) > 0 THEN round(sum(x * y) / (sqrt(sum(x * x)) * sqrt(sum(y * y))) * 100, 2) ELSE 0 END AS score FROM both_sides GROUP BY a_id, b_id)"""


query("sim5_pair_tfidf", f"WITH {pair_sql(PAIRS)} SELECT * FROM pair_scores")(lambda s, d: similarity.pair_tfidf(pairs(s, d)))
query(
    "sim6_combined_similarity",
    f"""WITH {pair_sql(TRIPLES)} SELECT a_id, floor(max((score + coalesce(nullif(CASE WHEN a_id % 3 = 1 THEN NULL WHEN a_id % 3 = 2 THEN 0 ELSE (a_id + b_id) % 100 END, 0), score)) / 2) * 100 + 0.5) / 100 AS best FROM pair_scores GROUP BY a_id""",
)(lambda s, d: (lambda lex: similarity.combined_similarity(lex, lex.filter("a_id % 3 <> 1").select("a_id", "b_id", F.when(F.col("a_id") % 3 == 2, 0.0).otherwise(((F.col("a_id") + F.col("b_id")) % 100).cast("double")).alias("score"))))(corpus.written_once(similarity.pair_tfidf(triples(s, d)))))


def embedded(spark, folder):
    v = spark.read.parquet(f"{folder}/embeddings.parquet")
    return v.filter("vec_id % 50 = 0"), v


COSINE = """WITH s AS (SELECT a.vec_id AS a, b.vec_id AS b, round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / (sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) * sqrt(list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[]))), 4) AS similarity
FROM embeddings a, embeddings b WHERE a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id)"""
query("sim7_vector_matches", f"{COSINE} SELECT * FROM s WHERE similarity >= 0.25")(lambda s, d: vectors.vector_matches(*embedded(s, d), 0.25))
query("sim7_nearest_vector", f"{COSINE}, r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY similarity DESC, b) AS k FROM s) SELECT a, b, similarity, similarity >= 0.3 AS matched FROM r WHERE k = 1")(lambda s, d: vectors.nearest_vector(*embedded(s, d)))
ALL_PAIRS = """WITH c AS (SELECT min(vec_id) AS id, embedding::DOUBLE[] AS e, count(*) AS n FROM embeddings GROUP BY embedding), u AS (SELECT *, sqrt(list_dot_product(e, e)) AS norm FROM c),
s AS (SELECT a.id AS a, b.id AS b, b.n AS n, round(list_dot_product(a.e, b.e) / (a.norm * b.norm), 4) AS similarity FROM u a, u b WHERE a.id <> b.id),
l AS (SELECT a, CAST(sum(n) AS BIGINT) AS n_links, arg_max(b, (similarity, -b)) AS nearest_id, max(similarity) AS similarity FROM s WHERE similarity >= 0.3 GROUP BY a)
SELECT vec_id, id AS class_id, c.n AS n_same, coalesce(n_links, 0) AS n_links, nearest_id, similarity FROM embeddings JOIN c ON embedding::DOUBLE[] = e LEFT JOIN l ON id = a"""
query("sim7_vector_links", ALL_PAIRS)(lambda s, d: vectors.vector_links(embedded(s, d)[1], 0.3))

CANDIDATES = f"""chunks AS ({chunks_sql(2)}), t AS (SELECT DISTINCT doc_id, chunk_idx, token FROM (SELECT doc_id, chunk_idx, unnest({TOKENS.format("chunk")}[1:12]) AS token FROM chunks WHERE chunk_idx < 8)),
pg AS (SELECT page_id, {PAGE} AS text FROM pages WHERE length({PAGE}) >= 50), ix AS (SELECT DISTINCT page_id, token FROM (SELECT page_id, unnest({TOKENS.format("text")}) AS token FROM pg)),
h AS (SELECT doc_id, chunk_idx, page_id, count(*) AS hits FROM t JOIN ix ON t.token = ix.token GROUP BY ALL),
cand AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, chunk_idx ORDER BY hits DESC, page_id) AS place FROM h) WHERE place <= 3)"""
query("sim8_candidate_pages", f"WITH {CANDIDATES} SELECT * FROM cand")(lambda s, d: similarity.candidate_pages(segment.sentence_chunks(docs(s, d), 2), corpus.load_page_sources(s, d)))
query(
    "sim9_web_report",
    f"""WITH {CANDIDATES}, {pair_sql("SELECT {'doc_id': c.doc_id, 'chunk_idx': c.chunk_idx} AS a_id, chunk AS a_text, c.page_id AS b_id, pg.text AS b_text FROM cand c JOIN chunks USING (doc_id, chunk_idx) JOIN pg ON c.page_id = pg.page_id")}
SELECT a_id.doc_id AS doc_id, coalesce(floor(sum(CASE WHEN score / 100 >= 0.2 THEN CAST(round(score * 100) AS BIGINT) END) / count(*) FILTER (score / 100 >= 0.2) + 0.5) / 10000, 0) AS score, count(*) FILTER (score / 100 >= 0.2) AS n_matches, count(DISTINCT b_id) AS pages_checked, count(DISTINCT a_id.chunk_idx) AS chunks_checked,
count(DISTINCT b_id) FILTER (score / 100 >= 0.2) AS n_sources FROM pair_scores GROUP BY 1""",
)(lambda s, d: similarity.web_report(segment.sentence_chunks(docs(s, d), 2), corpus.load_page_sources(s, d), 0.2))

query(
    "sim9_web_matches",
    f"""WITH {CANDIDATES}, {pair_sql("SELECT {'doc_id': c.doc_id, 'chunk_idx': c.chunk_idx} AS a_id, chunk AS a_text, c.page_id AS b_id, pg.text AS b_text FROM cand c JOIN chunks USING (doc_id, chunk_idx) JOIN pg ON c.page_id = pg.page_id")}
SELECT k.doc_id, k.chunk_idx, b_id AS page_id, url, score / 100 AS similarity, round(score, 2) AS percent, concat(chunk[1:150], CASE WHEN length(chunk) > 150 THEN '...' ELSE '' END) AS preview
FROM pair_scores JOIN chunks k ON a_id.doc_id = k.doc_id AND a_id.chunk_idx = k.chunk_idx JOIN pages ON b_id = pages.page_id WHERE score / 100 >= 0.2""",
)(lambda s, d: similarity.web_matches(segment.sentence_chunks(docs(s, d), 2), corpus.load_page_sources(s, d), 0.2))

KEY = r"lower(" + STRIP.format(r"regexp_replace(text, '\s+', ' ', 'g')") + ")"
query("sim11_exact_duplicates", f"SELECT doc_id, min(doc_id) OVER (PARTITION BY {KEY}) AS first_id, count(*) OVER (PARTITION BY {KEY}) AS group_size, doc_id = min(doc_id) OVER (PARTITION BY {KEY}) AS kept FROM {FILLED}")(lambda s, d: similarity.exact_duplicates(docs(s, d)))


# Versions: the corpus and a revised copy of it


def versions(spark, folder):
    """Every sentence that ends before "the" or "de" gets a word changed, by rules that SQL has too."""
    return docs(spark, folder).select(F.col("doc_id").alias("pair_id"), F.col("text").alias("original"), F.when(F.col("doc_id") % 4 == 0, F.col("text")).when(F.col("doc_id") % 4 == 1, F.replace("text", F.lit(" the "), F.lit(" that "))).when(F.col("doc_id") % 4 == 2, F.replace("text", F.lit(". "), F.lit(". Now "))).otherwise(F.substring("text", 1, 400)).alias("revised"))


VERSIONS = f"(SELECT doc_id AS pair_id, text AS original, CASE doc_id % 4 WHEN 0 THEN text WHEN 1 THEN replace(text, ' the ', ' that ') WHEN 2 THEN replace(text, '. ', '. Now ') ELSE text[1:400] END AS revised FROM {FILLED})"
query(
    "sim13_word_overlap",
    f"""SELECT pair_id, CASE WHEN original = revised THEN 0 WHEN len(a) = 0 THEN 0.5 ELSE round(greatest(0.5, least(1.0, len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))))), 4) END AS confidence
FROM (SELECT pair_id, original, revised, list_distinct({WORDS.format("lower(original)")}) AS a, list_distinct({WORDS.format("lower(revised)")}) AS b FROM {VERSIONS})""",
)(lambda s, d: similarity.word_overlap(versions(s, d)))

SIDE = r"SELECT pair_id AS doc_id, unnest(l) AS {1}, generate_subscripts(l, 1) - 1 AS idx FROM (SELECT pair_id, list_filter(list_transform(string_split_regex({0}, '[.!?]+\s+'), lambda s: " + STRIP.format("s") + "), lambda s: s <> '') AS l FROM " + VERSIONS + ")"
CHANGES = f"""c AS (SELECT coalesce(o.doc_id, r.doc_id) AS doc_id, CAST(coalesce(o.idx, r.idx) AS INT) AS idx, coalesce(original, '') AS original, coalesce(revised, '') AS revised, coalesce(original, '') <> coalesce(revised, '') AS changed
FROM ({SIDE.format("original", "original")}) o FULL JOIN ({SIDE.format("revised", "revised")}) r ON o.doc_id = r.doc_id AND o.idx = r.idx)"""


def changes(spark, folder):
    v = versions(spark, folder)
    return language.revision_changes(v.select(F.col("pair_id").alias("doc_id"), F.col("original").alias("text")), v.select(F.col("pair_id").alias("doc_id"), F.col("revised").alias("text")))


CONFIDENCES = f"""o AS (SELECT *, CASE WHEN original = revised THEN 0 WHEN len(a) = 0 THEN 0.5 ELSE round(greatest(0.5, least(1.0, len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))))), 4) END AS confidence
FROM (SELECT *, list_distinct({WORDS.format("lower(original)")}) AS a, list_distinct({WORDS.format("lower(revised)")}) AS b FROM c))"""
query("lng7_revision_changes", f"WITH {CHANGES} SELECT * FROM c")(changes)
query("lng8_revision_stats", f"WITH {CHANGES}, {CONFIDENCES} SELECT doc_id, count(*) AS total, count(*) FILTER (changed) AS changed, count(*) FILTER (NOT changed) AS unchanged, CAST(floor(count(*) FILTER (changed) / count(*) * 100 + 0.5) AS BIGINT) AS percent, floor(CAST(sum(CAST(round(confidence * 10000) AS BIGINT)) AS BIGINT) / count(*) / 10 + 0.5) / 1000 AS confidence FROM o GROUP BY doc_id")(
    lambda s, d: language.revision_stats(changes(s, d))
)


# Machine-writing style

STYLE = f"""l AS (SELECT doc_id, source, text, list_filter(list_transform({PUNCT}, lambda s: len({WORDS.format("s")})), lambda n: n >= 4) AS n, list_filter(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+'), lambda w: regexp_full_match(w, '[a-z]+')) AS w, {contained(lexicons.FILLERS)} AS filler_hits FROM documents),
m AS (SELECT *, len(n) AS n_sentences, CASE WHEN len(n) >= 4 THEN list_avg(n) END AS mean_len, CASE WHEN len(n) >= 4 THEN list_stddev_pop(n) END AS std_len FROM l),
f AS (SELECT *, (std_len - mean_len) / (std_len + mean_len + 1e-9) AS burstiness, std_len / (mean_len + 1e-9) AS cv, filler_hits / (n_sentences + 1) AS filler_density, CASE WHEN len(w) > 0 THEN len(list_distinct(w)) / (len(w) + 1e-9) ELSE 0 END AS diversity FROM m)"""
FEATURES = ("mean_len", "std_len", "burstiness", "cv", "filler_density", "diversity")
query("aid1_style_features", f"WITH {STYLE} SELECT doc_id, n_sentences, filler_hits, {', '.join(f'round({c}, 6) AS {c}' for c in FEATURES)} FROM f")(
    lambda s, d: detect.style_features(s.read.parquet(f"{d}/documents.parquet")).select("doc_id", "n_sentences", "filler_hits", *[F.round(c, 6).alias(c) for c in FEATURES])
)
SCORES = f"""{STYLE}, p AS (SELECT doc_id, source, text, 50.0
+ CASE WHEN burstiness IS NULL THEN 0 WHEN burstiness < -0.4 THEN 35 WHEN burstiness < -0.2 THEN 25 WHEN burstiness < 0.0 THEN 12 WHEN burstiness < 0.2 THEN -5 WHEN burstiness < 0.4 THEN -15 ELSE -25 END
+ CASE WHEN cv IS NULL THEN 0 WHEN cv < 0.25 THEN 20 WHEN cv < 0.40 THEN 10 WHEN cv < 0.55 THEN 0 WHEN cv < 0.70 THEN -10 ELSE -18 END
+ CASE WHEN mean_len IS NULL THEN 0 WHEN mean_len BETWEEN 14 AND 26 THEN 10 WHEN mean_len >= 10 AND mean_len < 14 THEN 3 WHEN mean_len < 10 THEN -10 ELSE -5 END
+ CASE WHEN filler_density > 0.4 THEN 15 WHEN filler_density > 0.2 THEN 8 WHEN filler_density > 0.1 THEN 3 ELSE 0 END AS x FROM f),
a AS (SELECT doc_id, source, CASE WHEN length({STRIP.format("text")}) >= 80 THEN CAST(round(greatest(0, least(100, x)), 1) AS DOUBLE) END AS score FROM p)"""
query("aid4_ai_scores", f"WITH {SCORES} SELECT doc_id, score, CASE WHEN score IS NULL THEN 'Too short to analyze' WHEN score >= 75 THEN 'Likely AI-generated' WHEN score >= 55 THEN 'Possibly AI-generated' WHEN score >= 40 THEN 'Uncertain — mixed signals' WHEN score >= 25 THEN 'Probably human-written' ELSE 'Likely human-written' END AS label FROM a")(
    lambda s, d: detect.ai_scores(s.read.parquet(f"{d}/documents.parquet"))
)
query(
    "aid5_ai_score_rollup",
    f"WITH {SCORES} SELECT source, count(*) AS n_docs, count(score) AS n_scored, round(avg(score), 2) AS mean_score, count(*) FILTER (score >= 75) AS n_likely_ai, count(*) FILTER (score >= 55 AND score < 75) AS n_possibly_ai, count(*) FILTER (score >= 40 AND score < 55) AS n_uncertain, count(*) FILTER (score < 40) AS n_human FROM a GROUP BY source",
)(lambda s, d: detect.ai_score_rollup(s.read.parquet(f"{d}/documents.parquet")))


# Language quality

SYLLABLES = "list_transform(list_transform({0}, lambda w: regexp_replace(lower(w), '[^a-z]', '', 'g')), lambda w: CASE WHEN length(w) <= 3 THEN 1 ELSE greatest(1, greatest(len(regexp_extract_all(w, '[aeiouy]+')), CASE WHEN regexp_matches(w, '[aeiouy]') THEN 0 ELSE 1 END) - CASE WHEN suffix(w, 'e') THEN 1 ELSE 0 END + CASE WHEN suffix(w, 'le') THEN 1 ELSE 0 END) END)"
query(
    "lng1_readability",
    f"""WITH b AS (SELECT doc_id, len({ANY}) AS n_sentences, {SYLLABLES.format(WORDS.format("text"))} AS s FROM {FILLED}),
c AS (SELECT doc_id, n_sentences, len(s) AS n_words, CAST(coalesce(list_sum(s), 0) AS BIGINT) AS n_syllables, len(list_filter(s, lambda x: x > 2)) AS n_complex FROM b),
e AS (SELECT *, 206.835 - 1.015 * (n_words / n_sentences) - 84.6 * (n_syllables / n_words) AS ease, 0.4 * (n_words / n_sentences + 100 * n_complex / n_words) AS f FROM c)
SELECT doc_id, n_sentences, n_words, n_syllables, n_complex, CASE WHEN n_sentences > 0 AND n_words > 0 THEN CAST(floor(ease + 0.5) AS BIGINT) END AS flesch,
CASE WHEN n_sentences > 0 AND n_words > 0 THEN CASE WHEN ease >= 90 THEN 'Very Easy (5th grade)' WHEN ease >= 80 THEN 'Easy (6th grade)' WHEN ease >= 70 THEN 'Fairly Easy (7th grade)' WHEN ease >= 60 THEN 'Standard (8th-9th grade)' WHEN ease >= 50 THEN 'Fairly Difficult (10th-12th grade)' WHEN ease >= 30 THEN 'Difficult (College)' ELSE 'Very Difficult (College Graduate)' END END AS level,
CASE WHEN n_sentences > 0 AND n_words > 0 THEN floor(f * 10 + 0.5) / 10 END AS fog FROM e""",
)(lambda s, d: language.readability(docs(s, d)))


def issues_sql() -> str:
    parts = []
    for i, (kind, pattern, message) in enumerate(lexicons.GRAMMAR_RULES):
        p = quoted(pattern)
        parts.append(
            f"""SELECT doc_id, {i} AS rule_no, {quoted(kind)} AS type, CAST(list_sum(list_transform(g[1:k], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1 : k - 1], lambda x: length(x))), 0) AS INT) AS "offset", CAST(length(m[k]) AS INT) AS length, {quoted(message)} AS message
FROM (SELECT doc_id, m, string_split_regex(text, {p}) AS g, unnest(range(1, len(m) + 1)) AS k FROM (SELECT doc_id, text, regexp_extract_all(text, {p}) AS m FROM {FILLED}))"""
        )
    return " UNION ALL ".join(parts)


query("lng2_grammar_issues", issues_sql())(lambda s, d: language.grammar_issues(docs(s, d)))
COUNTS = [f"len(regexp_extract_all(text, {quoted(p)}))" for _, p, _ in lexicons.GRAMMAR_RULES]
query(
    "lng3_quality_score",
    f"""WITH i AS (SELECT doc_id, length(text) AS chars, {" + ".join(COUNTS)} AS n_issues, {COUNTS[4]} + {COUNTS[5]} AS n_grammar, {COUNTS[3]} AS n_punctuation FROM {FILLED}), r AS (SELECT *, n_issues / (chars / 5) * 100 AS rate FROM i)
SELECT doc_id, n_issues, n_grammar, n_punctuation, greatest(0, least(100, 100 - CASE WHEN rate > 20 THEN 50 WHEN rate > 15 THEN 40 WHEN rate > 10 THEN 30 WHEN rate > 5 THEN 20 WHEN rate > 2 THEN 10 ELSE 0 END - 2 * n_issues)) AS score FROM r""",
)(lambda s, d: language.quality_score(docs(s, d)))

YOUR, THEIR = r"(?i)\byour\s+(going|doing|coming|leaving|getting|being|saying|trying)\b", r"(?i)\btheir\s+(is|are|was|were)\b"


def ruled_text(spark, folder):
    """Documents with a line that the rules apply to."""
    return docs(spark, folder).select("doc_id", F.concat("text", F.lit("\nSo your going  home , now. their is a way! it was their  are two ."), F.lit(" x")).alias("text"))


query(
    "lng4_apply_text_rules",
    rf"""WITH t0 AS (SELECT doc_id, text || chr(10) || 'So your going  home , now. their is a way! it was their  are two . x' AS t0 FROM {FILLED}),
t1 AS (SELECT *, regexp_replace(t0, '  +', ' ', 'g') AS t1 FROM t0), t2 AS (SELECT *, regexp_replace(t1, '\s+([.,!?;:])', '\1', 'g') AS t2 FROM t1),
t3 AS (SELECT *, array_to_string(list_transform(list_zip(string_split_regex(t2, '[.!?]\s+[a-z]'), regexp_extract_all(t2, '[.!?]\s+[a-z]')), lambda z: z[1] || coalesce(z[2][1:1] || ' ' || upper(right(z[2], 1)), '')), '') AS t3 FROM t2),
t4 AS (SELECT *, regexp_replace(t3, '{YOUR}', 'you''re \1', 'g') AS t4 FROM t3)
SELECT doc_id, len(regexp_extract_all(t0, '  +')) AS n_spaces, len(regexp_extract_all(t1, '\s+[.,!?;:]')) AS n_punctuation, len(regexp_extract_all(t3, '{YOUR}')) AS n_your, len(regexp_extract_all(t4, '{THEIR}')) AS n_their, md5(regexp_replace(t4, '{THEIR}', 'there \1', 'g')) AS digest FROM t4""",
)(lambda s, d: language.apply_text_rules(ruled_text(s, d)).withColumn("digest", F.md5("text")).drop("text"))

CONTRACTIONS = r"len(regexp_extract_all(text, '\b\w+''\w+\b'))"
FIRST = r"len(regexp_extract_all(text, '(?i)\b(?:{0})\b'))"
#: Letters beyond ASCII as x, so that ASCII word boundaries fall where those of all scripts do.
LATIN = f"(SELECT doc_id, regexp_replace(text, '[À-ɏ]', 'x', 'g') AS text FROM {FILLED})"
SUGGESTED = f"""SELECT doc_id, 'formality' AS type, {CONTRACTIONS} AS n FROM {LATIN} UNION ALL SELECT doc_id, 'style', CAST(regexp_matches(text, '(?i)\\b(?:was|were)\\s+\\w+(?:ed|en)\\b') AS INT) FROM {LATIN}
UNION ALL SELECT doc_id, 'academic_tone', CASE WHEN {FIRST.format("I|we|us|our|me|my")} > 3 THEN {FIRST.format("I|we|us|our|me|my")} ELSE 0 END FROM {LATIN} UNION ALL SELECT doc_id, 'conciseness', {contained([v for v, _ in lexicons.VERBOSE])} FROM {FILLED}
UNION ALL SELECT doc_id, 'repetition', count(*) FROM (SELECT doc_id, w, count(*) AS c FROM (SELECT doc_id, regexp_replace(unnest({WORDS.format("lower(text)")}), '[^\\p{{L}}\\p{{N}}_]', '', 'g') AS w FROM {FILLED}) WHERE length(w) > 4 GROUP BY ALL) WHERE c > 3 GROUP BY doc_id"""
query("lng5_style_suggestions", f"SELECT * FROM ({SUGGESTED}) WHERE n > 0")(lambda s, d: language.style_suggestions(docs(s, d)))
query(
    "lng6_academic_tone",
    f"""WITH b AS (SELECT doc_id, {" + ".join(f"CAST(regexp_matches(text, {quoted(rf'(?i)\b{w}\b')}) AS INT)" for w, _ in lexicons.INFORMAL)} AS n_informal, {CONTRACTIONS} AS n_contractions, {FIRST.format("I|me|my|mine|we|us|our|ours")} AS first_person FROM {FILLED})
SELECT *, greatest(0, 100 - 5 * (n_informal + n_contractions + CASE WHEN first_person > 0 THEN 1 ELSE 0 END)) AS score FROM b""",
)(lambda s, d: language.academic_tone(docs(s, d)))
query(
    "lng9_top_keywords",
    f"""WITH t AS (SELECT doc_id, unnest(w) AS keyword, generate_subscripts(w, 1) AS pos FROM (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+') AS w FROM {FILLED})),
c AS (SELECT doc_id, keyword, count(*) AS n, min(pos) AS first_pos FROM t WHERE regexp_full_match(keyword, '[a-z]{{4,}}') AND keyword NOT IN ({", ".join(map(quoted, lexicons.STOP_WORDS))}) GROUP BY ALL)
SELECT doc_id, place, keyword, n FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, first_pos) AS place FROM c) WHERE place <= 10""",
)(lambda s, d: language.top_keywords(docs(s, d)))
query(
    "lng10_lead_summary",
    f"""WITH s AS (SELECT doc_id, array_to_string({PUNCT}[1:5], ' ') AS l FROM {FILLED} WHERE length({STRIP.format("text")}) >= 100)
SELECT doc_id, CASE WHEN length(l) > 150 THEN regexp_replace(l[1:150], ' [^ ]*$', '') || '...' ELSE l END AS summary FROM s""",
)(lambda s, d: language.lead_summary(docs(s, d)))
query(
    "lng11_lexicon_sentiment",
    f"""WITH c AS (SELECT doc_id, {contained(lexicons.POSITIVE)} AS n_positive, {contained(lexicons.NEGATIVE)} AS n_negative FROM {FILLED})
SELECT *, round(CASE WHEN n_positive > n_negative THEN 0.6 + n_positive / (n_positive + n_negative) * 0.4 WHEN n_negative > n_positive THEN 0.4 - n_negative / (n_positive + n_negative) * 0.4 ELSE 0.5 END, 2) AS score,
CASE WHEN n_positive > n_negative THEN 'positive' WHEN n_negative > n_positive THEN 'negative' ELSE 'neutral' END AS label FROM c""",
)(lambda s, d: language.lexicon_sentiment(docs(s, d)))


# Dictionaries as tables: the two-word phrases of the benchmark


def phrases(spark, folder):
    w = spark.read.parquet(f"{folder}/benchmark.parquet").select(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0)).alias("w")).filter("size(w) > 1")
    return w.select(F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - 1), lambda i: F.concat_ws(" ", F.element_at("w", i), F.element_at("w", i + 1)))).alias("term")).distinct()


PHRASES = "p AS (SELECT DISTINCT concat(w[i], ' ', w[i + 1]) AS term FROM (SELECT w, unnest(range(1, len(w))) AS i FROM (SELECT regexp_extract_all(lower(text), '[a-z]+') AS w FROM benchmark WHERE text IS NOT NULL)))"
query("aid2_phrases_of_a_table", f"WITH {PHRASES} SELECT doc_id, CAST(count(term) AS INT) AS n_inside FROM documents LEFT JOIN p ON contains(lower(text), term) GROUP BY doc_id")(
    lambda s, d: terms.with_term_count(s.read.parquet(f"{d}/documents.parquet").select("doc_id", "text"), F.col("text"), phrases(s, d), "n_inside").select("doc_id", "n_inside")
)
query(
    "lng6_tone_by_a_table",
    f"""WITH {PHRASES}, d AS (SELECT doc_id, lower(text) AS low FROM {FILLED}), h AS (SELECT doc_id, count(term) AS n FROM d LEFT JOIN p ON CASE WHEN contains(low, term) THEN regexp_matches(low, concat('(?:^|[^a-z0-9_])', term, '(?:$|[^a-z0-9_])')) ELSE false END GROUP BY doc_id)
SELECT doc_id, CAST(n AS INT) AS n_informal FROM h""",
)(lambda s, d: language.academic_tone(docs(s, d), phrases(s, d)).select("doc_id", "n_informal"))
