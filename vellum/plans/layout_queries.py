"""Registered queries on layout and reference entries and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.functions.text import words
from vellum.operators import detect, layout, references, structure
from vellum.plans.paper_queries import STRIP
from vellum.plans.structure_queries import BLOCKS, METRICS, blocks, chunks, metrics
from vellum.plans.text_queries import STYLE, WORDS
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


def documents(s, d):
    return s.read.parquet(f"{d}/documents.parquet")


query("aid2_filler_density", f"WITH {STYLE} SELECT doc_id, filler_hits, round(filler_density, 6) AS filler_density FROM f")(lambda s, d: detect.style_features(documents(s, d)).select("doc_id", "filler_hits", F.round("filler_density", 6).alias("filler_density")))
query("aid3_vocabulary_diversity", f"WITH {STYLE} SELECT doc_id, round(diversity, 6) AS diversity FROM f")(lambda s, d: detect.style_features(documents(s, d)).select("doc_id", F.round("diversity", 6).alias("diversity")))
query(
    "seg8_pack_chunks",
    f"""WITH RECURSIVE {BLOCKS}, o AS (SELECT doc_id, block_idx, style <> 'Normal' AS head, len({WORDS.format("text")}) AS n, row_number() OVER (PARTITION BY doc_id ORDER BY block_idx) AS k FROM blocks),
r AS (SELECT doc_id, k, block_idx, 0 AS chunk_idx, n AS filled, n FROM o WHERE k = 1 UNION ALL
SELECT o.doc_id, o.k, o.block_idx, r.chunk_idx + CASE WHEN o.head OR r.filled + o.n > 60 THEN 1 ELSE 0 END, CASE WHEN o.head OR r.filled + o.n > 60 THEN o.n ELSE r.filled + o.n END, o.n FROM r JOIN o ON o.doc_id = r.doc_id AND o.k = r.k + 1)
SELECT doc_id, CAST(chunk_idx AS INT) AS chunk_idx, min(block_idx) AS first_block, max(block_idx) AS last_block, CAST(sum(n) AS INT) AS n_words FROM r GROUP BY doc_id, chunk_idx""",
)(lambda s, d: layout.pack_chunks(blocks(s, d), 60))


def pages_of(s, d):
    sections = chunks(s, d).select("doc_id", F.col("chunk_idx").alias("section_idx"), (F.col("chunk_idx") + 1).alias("page_start"), (F.col("chunk_idx") + 1 + F.col("doc_id") % 2).alias("page_end"))
    return blocks(s, d).select("doc_id", F.col("block_idx").alias("item_id"), (F.col("block_idx") % 9).alias("page")), sections


query(
    "seg18_attach_by_page",
    f"""WITH {METRICS}, s AS (SELECT doc_id, chunk_idx AS section_idx, chunk_idx + 1 AS page_start, chunk_idx + 1 + doc_id % 2 AS page_end FROM chunks), i AS (SELECT doc_id, block_idx AS item_id, block_idx % 9 AS page FROM blocks),
j AS (SELECT i.doc_id, item_id, section_idx, CASE WHEN page BETWEEN page_start AND page_end THEN 2 WHEN page_start <= page THEN 1 ELSE 0 END AS r, page_start <= page AS started FROM i JOIN s ON i.doc_id = s.doc_id)
SELECT doc_id, item_id, section_idx FROM j QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY r DESC, CASE WHEN started THEN -section_idx ELSE section_idx END) = 1""",
)(lambda s, d: layout.attach_by_page(*pages_of(s, d)))
query(
    "seg21_table_rows",
    rf"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM documents WHERE trim(text) <> ''),
p AS (SELECT doc_id, line_no, {STRIP.format("raw")} AS s FROM l WHERE starts_with({STRIP.format("raw")}, '|')), g AS (SELECT *, line_no - row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS island FROM p),
k AS (SELECT * FROM g WHERE NOT regexp_matches(s, '^[|\s:-]+$')), c AS (SELECT *, list_transform(string_split(regexp_replace(s, '^\||\|$', '', 'g'), '|'), lambda x: {STRIP.format("x")}) AS cells FROM k)
SELECT doc_id, CAST(dense_rank() OVER (PARTITION BY doc_id ORDER BY island) - 1 AS INT) AS table_idx, CAST(row_number() OVER (PARTITION BY doc_id, island ORDER BY line_no) - 1 AS INT) AS row_idx, len(cells) AS n_cells, array_to_string(cells, chr(9)) AS cells FROM c""",
)(lambda s, d: layout.table_rows(corpus.load_corpus(s, d)))
query(
    "seg17_group_lists",
    f"""WITH {BLOCKS}, t AS (SELECT doc_id, block_idx, text, CASE WHEN style = 'Normal' AND block_idx % 4 <> 0 THEN 'item' ELSE style END AS type FROM blocks),
o AS (SELECT *, CASE WHEN type <> coalesce(lag(type) OVER (PARTITION BY doc_id ORDER BY block_idx), '') OR type <> 'item' THEN 1 ELSE 0 END AS opens FROM t), g AS (SELECT *, sum(opens) OVER (PARTITION BY doc_id ORDER BY block_idx) AS run FROM o)
SELECT doc_id, min(block_idx) AS first_block, type, count(*) AS n_blocks, md5(string_agg(text, chr(10) ORDER BY block_idx)) AS digest FROM g GROUP BY doc_id, run, type""",
)(lambda s, d: layout.group_runs(blocks(s, d).select("doc_id", "block_idx", "text", F.when((F.col("style") == "Normal") & (F.col("block_idx") % 4 != 0), "item").otherwise(F.col("style")).alias("type")), ["item"]).withColumn("digest", F.md5("text")).drop("text"))
query(
    "str11_compare_segmentations",
    f"""WITH {METRICS}, b AS (SELECT doc_id, n_sections + 2 AS n_sections, n_paragraphs + doc_id % 5 AS n_paragraphs, n_references, avg_paragraph_words FROM metrics)
SELECT a.doc_id, round(b.n_sections - a.n_sections, 2) AS d_n_sections, round(b.n_paragraphs - a.n_paragraphs, 2) AS d_n_paragraphs, round(b.n_references - a.n_references, 2) AS d_n_references, round(b.avg_paragraph_words - a.avg_paragraph_words, 2) AS d_avg_paragraph_words, true AS b_chosen FROM metrics a JOIN b ON a.doc_id = b.doc_id""",
)(lambda s, d: (lambda m: structure.compare_segmentations(m, m.withColumn("n_sections", F.col("n_sections") + 2).withColumn("n_paragraphs", F.col("n_paragraphs") + F.col("doc_id") % 5)))(corpus.written_once(metrics(s, d))))
# A run for each paper: words of its text and of its sections, sections, references, whether it has an abstract, few paragraphs as warnings.
RUN = "n_sections AS sections, n_references AS citations, has_abstract AS artifact, CASE WHEN n_paragraphs <= 4 THEN 5 ELSE 0 END AS warnings, avg_paragraph_words * n_paragraphs AS out_words"
query(
    "str12_pipeline_score",
    f"""WITH {METRICS}, r AS (SELECT source AS variant, len({WORDS.format("text")}) AS src_words, {RUN} FROM papers p JOIN metrics m ON p.doc_id = m.doc_id),
s AS (SELECT variant, greatest(0, least(1, 0.45 * greatest(0, least(1, out_words / greatest(1, src_words))) + 0.20 * least(1, sections / 8) + 0.20 * least(1, citations / 10) + 0.15 * CAST(artifact AS INT) - 0.10 * least(1, warnings / 10))) AS s FROM r)
SELECT variant, round(avg(s), 4) AS mean_score, count(*) AS n FROM s GROUP BY variant""",
)(lambda s, d: layout.pipeline_score(papers.load_papers(s, d).select("doc_id", F.col("source").alias("variant"), F.size(words(F.col("text"))).alias("src_words")).join(metrics(s, d).selectExpr("doc_id", *[x.strip() for x in RUN.split(", ")]), "doc_id")))
query(
    "str13_retention_check",
    f"WITH {BLOCKS}, b AS (SELECT doc_id, count(*) AS n_before, count(*) FILTER ((block_idx + doc_id) % 3 > 0) AS n_after FROM blocks GROUP BY doc_id) SELECT *, n_after < greatest(1, floor(n_before * 0.65)) AS warn FROM b",
)(lambda s, d: layout.retention_check(blocks(s, d), blocks(s, d).filter("(block_idx + doc_id) % 3 > 0")))

KNOWN_IDS = "CASE WHEN block_idx % 7 = 6 THEN ' ' WHEN block_idx % 5 = 4 THEN concat('b', block_idx - 1) ELSE concat('b', block_idx) END"
query(
    "str13_block_id_errors",
    f"""WITH {BLOCKS}, b AS (SELECT doc_id, nullif(trim({KNOWN_IDS}), '') AS block_id FROM blocks), f AS (SELECT DISTINCT doc_id, concat('b', block_idx) AS block_id FROM blocks WHERE (block_idx + doc_id) % 3 > 0), n AS (SELECT doc_id, block_id, count(*) AS n FROM b WHERE block_id IS NOT NULL GROUP BY ALL)
SELECT doc_id, 'no id' AS problem, block_id FROM b WHERE block_id IS NULL UNION ALL SELECT doc_id, 'duplicate', block_id FROM n WHERE n > 1
UNION ALL SELECT doc_id, 'missing', block_id FROM n WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.doc_id = n.doc_id AND f.block_id = n.block_id)""",
)(lambda s, d: layout.block_id_errors(blocks(s, d).select("doc_id", F.expr(KNOWN_IDS).alias("block_id")), blocks(s, d).filter("(block_idx + doc_id) % 3 > 0").select("doc_id", F.concat(F.lit("b"), "block_idx").alias("block_id"))))

LATEX = r"concat('Text \\cite{a', CAST(doc_id % 5 AS STRING), ', b} {and \\citep{c', CAST(doc_id % 3 AS STRING), '} $x$ ', lang, CASE WHEN doc_id % 4 = 0 THEN ' \\cite{} $' ELSE '' END)"
LATEX_DUCK = LATEX.replace("\\\\", "\\")


def latex(s, d):
    return documents(s, d).selectExpr("doc_id", f"{LATEX} AS text")


query(
    "cit16_missing_cite_keys",
    rf"""WITH t AS (SELECT doc_id, list_transform(flatten(list_transform(regexp_extract_all({LATEX_DUCK}, '\\cite[a-z]*\*?\{{([^}}]*)\}}', 1), lambda m: string_split(m, ','))), lambda k: trim(k)) AS k FROM documents),
r AS (SELECT doc_id, unnest(k) AS cite_key, generate_subscripts(k, 1) - 1 AS pos FROM t)
SELECT doc_id, cite_key, CAST(min(pos) AS INT) AS first_pos FROM r WHERE cite_key <> '' AND NOT (cite_key = 'b' AND doc_id % 2 = 0) AND cite_key <> 'c1' GROUP BY doc_id, cite_key""",
)(lambda s, d: references.missing_cite_keys(latex(s, d), documents(s, d).select("doc_id", F.lit("c1").alias("cite_key")).union(documents(s, d).filter("doc_id % 2 = 0").select("doc_id", F.lit("b")))))
query(
    "cit16_markup_counts",
    rf"WITH t AS (SELECT doc_id, {LATEX_DUCK} AS text FROM documents) SELECT doc_id, length(text) - length(replace(text, '{{', '')) - (length(text) - length(replace(text, '}}', ''))) AS brace_balance, (length(text) - length(replace(text, '$', ''))) % 2 = 1 AS odd_dollars, len(regexp_extract_all(text, '\\cite[a-z]*\*?\{{\s*\}}')) AS empty_cites FROM t",
)(lambda s, d: references.markup_counts(latex(s, d)))
