"""Dictionaries as tables against brute force, short and long, and the time that a plan takes."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from vellum.functions.lexicons import FILLERS, INFORMAL, NEGATIVE, POSITIVE, SECTION_KEYWORDS, STOP_WORDS, VERBOSE
from vellum.operators import detect, language, structure, terms

WORDS = "the a red fish river stone moss over under kind of lots very badge bad goodness c++ it's x_y été".split()


def table(spark, words):
    return spark.createDataFrame([(w,) for w in words], "term string")


def texts(n=60):
    rnd = random.Random(5)
    out = [" ".join(rnd.choices(WORDS, k=rnd.randint(1, 40))).replace(" red", rnd.choice([" RED", ". Red", "\nred"])) for _ in range(n)]
    return [*out, out[0], out[0], "", None, "ÀB kelvin K", "x " * 5000 + "river stone"]


def phrases(n, rnd):
    return {" ".join(rnd.choices(WORDS, k=rnd.randint(1, 3)))[rnd.choice([0, 0, 1]) :] for _ in range(n)} | {f"nowhere {i} to be found" for i in range(n)} | {"", "a", "+", "c++", ".", "e"}


@pytest.mark.parametrize("how", ["inside", "words"])
@pytest.mark.parametrize("n", [20, 600])
def test_terms_equal_brute_force(spark, how, n):
    wanted = phrases(n, random.Random(n)) - {""}
    df = spark.createDataFrame(list(enumerate(texts())), "doc_id long, text string").withColumn("term", F.lit("clash"))
    t = table(spark, [*wanted, "", None, "a", "a"])
    assert (terms.short_list(t) is None) == (n == 600)

    def has(text, term):
        return term in text.lower() if how == "inside" else re.search(rf"(?ia)\b{re.escape(term)}\b", text) is not None

    found = {r.doc_id: r.found for r in terms.with_terms(df, F.col("text"), t, "found", how).collect()}
    for i, text in enumerate(texts()):
        assert found[i] == sorted(w for w in wanted if text is not None and has(text, w)), i
    assert terms.with_terms(df.limit(0), F.col("text"), t, "found", how).count() == 0
    assert {len(r.found) for r in terms.with_terms(df, F.col("text"), table(spark, [None, ""]), "found", how).collect()} == {0}


def same(a, b):
    order = lambda df: sorted((tuple(r[c] for c in sorted(df.columns)) for r in df.collect()), key=repr)
    assert order(a) == order(b)


@pytest.mark.parametrize("padding", [0, 500])
def test_operators_take_tables(spark, sf, padding):
    """The constants as a table, alone and among other terms, give the results of the constants."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(40)
    docs = docs.withColumn("text", F.concat(F.lit("In order to get lots of good things, the bad ones are needless to say overall. "), "text"))
    more = [f"qqq{i} zzz{i} never" for i in range(padding)]
    t = lambda words: table(spark, [*words, *more])
    same(detect.style_features(docs), detect.style_features(docs, t(FILLERS)))
    same(language.style_suggestions(docs), language.style_suggestions(docs, t([p for p, _ in VERBOSE])))
    same(language.academic_tone(docs), language.academic_tone(docs, t([p for p, _ in INFORMAL])))
    same(language.top_keywords(docs), language.top_keywords(docs, stop_words=t(STOP_WORDS)))
    same(language.lexicon_sentiment(docs), language.lexicon_sentiment(docs, t(POSITIVE), t(NEGATIVE)))
    headings = spark.createDataFrame([("1 Introduction and Methods",), ("Works CITED",), ("Final remarks",), ("Nothing",), ("",), (None,), ("Results",), ("Results",)], "heading string")
    kinds = spark.createDataFrame([(k, i, w) for i, (k, ws) in enumerate(SECTION_KEYWORDS) for w in ws] + [("other", 99, w) for w in more], "section_type string, place int, term string")
    same(headings.withColumn("section_type", structure.section_type(F.col("heading"))), structure.section_types(headings, kinds))


def test_ten_thousand_phrases_plan_at_once(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    t = spark.range(10_000).select(F.concat(F.lit("some phrase no "), "id").alias("term")).persist()
    t.count()
    terms.with_term_count(docs, F.col("text"), t, "n")._jdf.queryExecution().executedPlan()
    start = time.perf_counter()
    df = terms.with_term_count(docs, F.col("text"), t, "n")
    df._jdf.queryExecution().executedPlan()
    taken = time.perf_counter() - start
    assert len(df._jdf.queryExecution().optimizedPlan().toString()) < 20_000
    assert taken < 3  # with the check of the table's size; a loaded box
    t.unpersist()


def test_texts_stay_where_they_are(spark, monkeypatch):
    """No exchange of texts or of their pieces (F2, F3), in one automaton or several."""
    wanted = sorted(phrases(600, random.Random(4)) - {""})
    df = spark.createDataFrame(list(enumerate(texts())), "doc_id long, text string")
    for how in terms.HOW:
        one = terms.with_terms(df, F.col("text"), table(spark, wanted), "found", how)
        assert "Exchange" not in one._jdf.queryExecution().executedPlan().toString()
        with monkeypatch.context() as m:
            m.setattr(terms, "MAX_BYTES", 3000)
            same(one, terms.with_terms(df, F.col("text"), table(spark, wanted), "found", how))
