"""Rows on which a query once differed from its SQL, as small tables of their own."""

import duckdb
import pytest

from vellum import catalog

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def same(spark, tmp_path):
    """Run queries on given texts; the rows of each, which have to be those of its SQL."""

    def check(texts, *names, first=1):
        rows = [(i, t, "de", "s", len(t)) for i, t in enumerate(texts, first)]
        spark.createDataFrame(rows, COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
        con = duckdb.connect()
        con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
        out = []
        for name in names:
            df = catalog.queries()[name](spark, str(tmp_path))
            found = sorted(tuple(r) for r in df.collect())
            assert found == sorted(con.execute(f"SELECT {', '.join(df.columns)} FROM ({catalog.oracle_sql()[name]})").fetchall())
            out.append(found)
        return out

    return check


def test_deviation_that_equals_the_mean(same):
    # Lengths 30, 4, 4, 70: mean and deviation are 27, so the last bit says whether the burstiness is under 0 (F7, F8).
    text = " ".join(" ".join(["word"] * n) + "." for n in (30, 4, 4, 70))
    scores, _ = same([text], "aid4_ai_scores", "aid5_ai_score_rollup")
    assert scores == [(1, 39.0, "Probably human-written")]


def test_mean_score_between_two_hundredths(same):
    calm = " ".join(" ".join(["word"] * 20) + "." for _ in range(5))
    same([" ".join(["word"] * 20), calm, calm + " word"] * 3 + ["short"], "aid5_ai_score_rollup")


def test_capitals_of_one_letter_each(same):
    # The upper case of a heading is looked for; ß must not become two letters (F9).
    found = same([f"Vorwort\n\n## Straße {i}\n\nText.\n\n## Maße {i}\n\nMehr.\n\n## Οδος\n\nText.\n" * 2 for i in range(9)], "str6_toc_alignment")[0]
    assert not any("STRASSE" in r[3] or "MASSE" in r[3] for r in found)


def test_words_of_no_statement_are_not_exchanged(spark):
    """Only words that a statement has reach the exchange of a chunk's words (F18), and vectors meet statements in their row (F10)."""
    from vellum.operators import structure

    chunks = spark.createDataFrame([(1, 0, "zebra quagga"), (1, 1, "alpha beta zebra")], "doc_id long, chunk_idx int, text string")
    known = [("a", "alpha gamma"), ("b", "beta"), ("c", "delta")]
    scores = structure.statement_scores(chunks, known)
    plan = scores._jdf.queryExecution().executedPlan().toString()
    below = plan[plan.rindex("Exchange hashpartitioning(doc_id") :]
    assert "BroadcastHashJoin" in below[: below.index("Generate explode")]
    mine = spark.createDataFrame([(1, 0, [1.0, 0.0]), (1, 1, [3.0, 4.0])], "doc_id long, chunk_idx int, embedding array<double>")
    theirs = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0]), (2, [0.0, 0.0])], "kb_idx int, embedding array<double>")
    found = structure.vector_statement_scores(chunks, mine, theirs, known)
    assert "NestedLoop" not in found._jdf.queryExecution().executedPlan().toString()
    want = [(1, 0, 0, "a", 1.0), (1, 0, 2, "c", 0.0), (1, 1, 0, "a", 0.6), (1, 1, 2, "c", 0.0)]
    rows = sorted(tuple(r) for r in found.collect())
    assert [r for r in rows if r[2] != 1] == want and [r[:4] for r in rows if r[2] == 1] == [(1, 1, 1, "b")]
