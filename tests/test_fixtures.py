"""Small hand-made inputs with expected values worked out from the rules."""

import datetime

import pytest
from pyspark.sql import functions as F

from vellum.operators import citations, detect, language, operations, segment, similarity, structure
from vellum.sources import corpus
from vellum.streaming import jobs


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


EDGE = [None, "", "word", "Été là.", "x " * 20_000, "No match here. None at all!"]


def test_chunks(spark):
    assert [r[2] for r in rows(segment.sentence_chunks(docs(spark, "A b. C d. E f."), 2), "doc_id", "chunk_idx", "chunk")] == ["A b. C d.", "E f."]


def test_boilerplate(spark):
    texts = [f"Vol {i} Page 3\nown {'abcdefghij'[i]}" if i < 4 else f"{'other line' if i < 7 else 'z' * i}" for i in range(10)]
    d = docs(spark, *texts).withColumn("source", F.lit("s"))
    assert rows(segment.boilerplate_lines(d), "fingerprint", "n_docs") == [("vol # page #", 4)]


def test_report(spark):
    chunks = spark.createDataFrame([(1, 0), (1, 1), (2, 0)], "doc_id long, chunk_idx int")
    matches = spark.createDataFrame([(1, 0, 7, 0.8), (1, 1, 7, 0.9)], "doc_id long, chunk_idx int, source long, similarity double")
    assert rows(similarity.plagiarism_report(chunks, matches), "doc_id", "score", "level", "n_matches") == [(1, 0.85, "High", 2), (2, 0.0, "None", 0)]


def test_combined_similarity(spark):
    lex = spark.createDataFrame([(1, 1, 40.0), (2, 1, 40.0), (3, 1, 40.0)], "a_id long, b_id long, score double")
    sem = spark.createDataFrame([(1, 1, 0.0), (2, 1, 60.0)], "a_id long, b_id long, score double")
    assert rows(similarity.combined_similarity(lex, sem), "a_id", "best") == [(1, 40.0), (2, 50.0), (3, 40.0)]


def test_duplicates_and_overlap(spark):
    assert rows(similarity.exact_duplicates(docs(spark, "A  b", "a b", "a c")), "doc_id", "first_id", "kept") == [(0, 0, True), (1, 0, False), (2, 2, True)]
    pairs = spark.createDataFrame([(1, "a b c", "a b d"), (2, "a", "a"), (3, "", "x")], "pair_id long, original string, revised string")
    assert rows(similarity.word_overlap(pairs), "pair_id", "confidence") == [(1, 0.5), (2, 0.0), (3, 0.5)]


def test_source_order_does_not_matter(spark):
    chunks = segment.sentence_chunks(docs(spark, "the red fish swims far. the blue bird sings"), 1)
    sources = [(1, "red fish swims far"), (2, "blue bird sings"), (3, "nothing")]
    a = similarity.match_chunks(chunks, spark.createDataFrame(sources, "source_id long, text string"), 0.5)
    b = similarity.match_chunks(chunks, spark.createDataFrame(sources[::-1], "source_id long, text string"), 0.5)
    assert rows(a, "doc_id", "chunk_idx", "source", "similarity") == rows(b, "doc_id", "chunk_idx", "source", "similarity") != []


def test_style_scores(spark):
    text = "One two three four. " + "One two three four five six seven eight. " + "Aa bb cc dd. " + "Ee ff gg hh ii jj kk ll."
    r = detect.style_features(docs(spark, text)).first()
    assert (r.mean_len, r.std_len, round(r.burstiness, 4), round(r.cv, 4)) == (6.0, 2.0, -0.5, 0.3333)
    found = {r.doc_id: (r.score, r.label) for r in detect.ai_scores(docs(spark, text, "x" * 79)).collect()}
    assert found == {0: (85.0, "Likely AI-generated"), 1: (None, "Too short to analyze")}


def test_readability(spark):
    r = language.readability(docs(spark, "The cat sat. It ran fast!")).first()
    assert (r.n_sentences, r.n_words, r.n_syllables, r.flesch, r.fog, r.level) == (2, 6, 6, 119, 1.2, "Very Easy (5th grade)")


def test_language_rules(spark):
    assert rows(language.quality_score(docs(spark, "x" * 98 + " .")), "n_issues", "score") == [(1, 88)]
    old, new = docs(spark, "A. B. C"), docs(spark, "A. X. C. D")
    changes = language.revision_changes(old, new)
    assert rows(changes, "idx", "changed") == [(0, False), (1, True), (2, False), (3, True)]
    assert rows(language.revision_stats(changes), "percent") == [(50,)]
    assert rows(language.top_keywords(docs(spark, "alpha beta alpha with gamma"), 2), "place", "keyword", "n") == [(1, "alpha", 2), (2, "beta", 1)]
    assert rows(language.lexicon_sentiment(docs(spark, "good good bad wonderful")), "n_positive", "n_negative", "score", "label") == [(2, 1, 0.87, "positive")]


def test_citation_styles(spark):
    found = rows(citations.citation_style(docs(spark, "a (Smith, 2019) b (Smith, 2019)", "a (Smith 2019)", "[1] and [2, 3]", "none")), "doc_id", "style")
    assert [s for _, s in found] == ["APA", "Harvard", "IEEE", "Unknown"]


def test_citations_and_references(spark):
    d = docs(spark, "Body (Lee, 2020) text\nReferences\nSee (Lee, 2020)", "As [1, 2] says\nReferences\n[1] Ada, A. X.\n[2] Bell, B. Y.\n[2] Cole, C.")
    cites, refs = citations.extract_citations(d), citations.extract_references(d)
    assert rows(cites, "doc_id", "text", "style_type") == [(0, "(Lee, 2020)", "APA"), (1, "[1, 2]", "IEEE")]
    assert rows(refs.filter("doc_id = 1"), "ref_idx", "ref_number", "author") == [(0, 1, "Ada, A."), (1, 2, "Bell, B."), (2, 2, "Cole, C.")]
    edges = citations.match_citations(cites, refs)
    assert rows(edges, "ref_idx", "is_primary") == [(0, True), (2, False)]
    assert rows(citations.citation_match_report(d).filter("doc_id = 1"), "matched", "uncited") == [(1, 2)]


def test_last_author_word_is_compared(spark):
    d = docs(spark, "x (Smith & Jones, 2020)\nReferences\nSmith, J. (2020). A.\nJones, K. (2020). B.")
    assert rows(citations.match_author_year(citations.extract_citations(d), citations.extract_references(d)), "ref_idx") == [(1,)]


def test_section_numbers(spark):
    h = spark.createDataFrame([(1, i, x) for i, x in enumerate([1, 2, 2, 3, 1, 2])], "doc_id long, idx int, level int")
    assert [r[1] for r in rows(structure.section_numbering(h), "idx", "section_id")] == ["s1", "s1.1", "s1.2", "s1.2.1", "s2", "s2.1"]


def test_document_type(spark):
    s = spark.createDataFrame([(1, "introduction"), (1, "conclusion")], "doc_id long, type string")
    assert rows(structure.document_type(s), "document_type") == [("report",)]


def test_usage(spark):
    plans = spark.createDataFrame([("a", 5), ("b", -1)], "plan string, documents_per_month int")
    users = spark.createDataFrame([(1, "a", 3), (2, "b", 3)], "user_id long, plan string, used long")
    assert rows(operations.usage_vs_limits(users, plans), "user_id", "percent") == [(1, 60), (2, 100)]
    now = datetime.datetime(2024, 3, 1)
    users = spark.createDataFrame([(1, 4, now - datetime.timedelta(days=31)), (2, 4, now - datetime.timedelta(days=30))], "user_id long, used long, last_reset timestamp")
    assert rows(operations.monthly_usage_reset(users, F.lit(now)), "user_id", "used") == [(1, 0), (2, 4)]


def test_routes(spark):
    d = docs(spark, "w " * 12_000, "w " * 11_999, "\n".join(["x"] * 249), "\n".join(["x"] * 250))
    assert rows(operations.route_large_documents(d), "route", "n_docs") == [("large", 2), ("standard", 2)]


def test_progress(spark):
    now = datetime.datetime(2024, 1, 1)
    events = spark.createDataFrame([(1, now, 1, "stage", 2, None, None), (2, now, 1, "start", None, None, None), (3, now, 1, "progress", None, 5, 20), (3, now, 0, "start", None, None, None)], "job_id long, ts timestamp, event_id long, type string, stage int, chunk int, total int")
    assert rows(jobs.job_progress_table(events), "job_id", "percent") == [(1, 24), (2, 16), (3, 36)]


@pytest.mark.parametrize(
    "job",
    [segment.explode_sentences, segment.sentence_chunks, segment.lines_to_blocks, segment.clean_text, similarity.exact_duplicates, detect.style_features, detect.ai_scores, language.readability, language.grammar_issues, language.quality_score, language.apply_text_rules, language.style_suggestions, language.academic_tone, language.top_keywords, language.lead_summary, language.lexicon_sentiment, citations.extract_citations, citations.extract_references, citations.citation_style, citations.citation_match_report, structure.paragraph_blocks, structure.section_spans, corpus.corpus_metadata],
)
def test_edge_rows(job, spark):
    job(docs(spark, *EDGE)).collect()
    job(docs(spark, *EDGE).limit(0)).collect()


def test_text_files(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("été".encode())
    (tmp_path / "b.tex").write_bytes("été".encode("latin-1"))
    (tmp_path / "c.bin").write_bytes(b"no")
    assert rows(corpus.load_text_files(spark, f"{tmp_path}/*"), "text") == [("été",), ("été",)]
    corpus.write_results(docs(spark, "a", "b"), str(tmp_path / "out"), "json", ["doc_id"])
    assert spark.read.json(str(tmp_path / "out")).count() == 2


def test_stream_restart_and_late_rows(spark, tmp_path):
    """A stream that stops goes on after its last trigger; rows behind the watermark are dropped."""
    source, run = tmp_path / "in", tmp_path / "run"
    day = datetime.datetime(2024, 1, 1)
    schema = "created_at timestamp, level string"

    def add(*hours):
        spark.createDataFrame([(day + datetime.timedelta(hours=h), "info") for h in hours], schema).coalesce(1).write.mode("append").parquet(str(source))

    def go():
        stream = spark.readStream.schema(schema).parquet(str(source))
        return jobs.run_to_table(jobs.log_level_counts(stream, "1 hour", "2 hours"), ["start", "level"], checkpoint=f"file://{run}/checkpoint", path=f"file://{run}/out")

    add(0, 0.5, 10)
    assert sorted(r.n for r in go().collect()) == [1, 2]
    add(0.2, 10.5)
    assert sorted(r.n for r in go().collect()) == [2, 2]
