"""Range, vector and result joins against brute-force versions, with hot keys and odd rows."""

import datetime
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from vellum.functions import lexicons
from vellum.functions import text as text_functions
from vellum.functions.text import overlap_confidence
from vellum.operators import language, layout, operations, postings, similarity, vectors, zones


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns or df.columns) for r in df.collect()), key=repr)


# Pages and sections


def section_of(page, sections):
    """(idx, start, end) rows of one document; the rule as the survey words it."""
    inside = [i for i, s, e in sections if page is not None and s is not None and e is not None and s <= page <= e]
    started = [i for i, s, _ in sections if page is not None and s is not None and s <= page]
    return max(inside) if inside else max(started) if started else min(i for i, _, _ in sections)


SECTIONS, ITEMS = "doc_id long, section_idx int, page_start int, page_end int", "doc_id long, item_id int, page int"


def test_pages_of_any_sections(spark):
    """Sections overlap, hold each other, leave gaps, end before they start, or have no pages."""
    rnd = random.Random(1)
    sections, items = [], []
    for doc in range(30):
        for idx in rnd.sample(range(50), rnd.randint(1, 9)):
            start = rnd.choice([None, *[rnd.randint(0, 70)] * 9])
            sections.append((doc, idx, start, None if start is None else start + rnd.choice([-1, 0, 0, 1, 3, 17, 64, 1000])))
        items += [(doc, i, rnd.choice([None, -1, 0, rnd.randint(0, 90), rnd.randint(0, 90), 5000])) for i in range(40)]
    items += [(0, 1, 5), (0, 1, 5), (99, 1, 1), (None, 1, 1)]
    of = {}
    for doc, *s in sections:
        of.setdefault(doc, []).append(tuple(s))
    want = sorted(((d, i, section_of(p, of[d])) for d, i, p in items if d in of), key=repr)
    found = layout.attach_by_page(spark.createDataFrame(items, ITEMS), spark.createDataFrame(sections, SECTIONS))
    assert rows(found) == want
    assert layout.attach_by_page(spark.createDataFrame([], ITEMS), spark.createDataFrame(sections, SECTIONS)).count() == 0


def test_one_document_of_many_items_and_sections(spark):
    """100,000 items and 20,000 sections of one document: all pairs would be two billion rows."""
    n = 20_000
    items = spark.range(100_000).select(F.lit(1).cast("long").alias("doc_id"), F.col("id").cast("int").alias("item_id"), (F.col("id") * 7 % (2 * n)).cast("int").alias("page"))
    sections = spark.range(n).select(F.lit(1).cast("long").alias("doc_id"), F.col("id").cast("int").alias("section_idx"), (2 * F.col("id")).cast("int").alias("page_start"), (2 * F.col("id") + F.when(F.col("id") % 100 == 0, 5000).otherwise(0)).cast("int").alias("page_end"))
    found = layout.attach_by_page(items, sections)
    assert found.count() == 100_000
    for page in (1, 2, 201, 4999, 5001, 39_999):
        inside = [i for i in range(n) if 2 * i <= page <= 2 * i + (5000 if i % 100 == 0 else 0)]
        want = max(inside) if inside else page // 2
        assert {r.section_idx for r in found.join(items.filter(F.col("page") == page).select("item_id"), "item_id").collect()} == {want}


# Vectors


def cosines(rows):
    x = np.array([v for _, v in rows], float)
    norm = np.sqrt((x * x).sum(1, keepdims=True))
    x = x / np.where(norm > 0, norm, 1)
    return np.floor(x @ x.T * 1e4 + 0.5) / 1e4


def grouped_vectors(n, groups, d=8, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, d))
    return [(i, (centres[i % groups] + rng.normal(size=d) * (0.02 if i % 3 else 0.6)).tolist()) for i in range(n)]


VECTORS = "vec_id long, embedding array<double>"


@pytest.fixture(scope="module")
def some_vectors(spark):
    data = grouped_vectors(240, 12)
    data += [(1000 + i, data[0][1]) for i in range(100)]  # a third are copies
    data += [(2000, [0.0] * 8)]
    return data, spark.createDataFrame([*data, (3000, None), (3001, [1.0]), (3002, [1.0, None, *[0.0] * 6]), (3003, [math.nan, *[0.0] * 7])], VECTORS)


@pytest.mark.parametrize("least", [0.99, 0.5, -1.0])
def test_vector_matches_equal_brute_force(spark, some_vectors, least):
    data, df = some_vectors
    c = cosines(data)
    want = sorted((a, b, c[i, j]) for i, (a, _) in enumerate(data) for j, (b, _) in enumerate(data) if a % 20 == 0 and a != b and c[i, j] >= least)
    found = vectors.vector_matches(df.filter("vec_id % 20 = 0"), df, least)
    assert "NestedLoop" not in found._jdf.queryExecution().executedPlan().toString()
    assert sorted(tuple(r) for r in found.collect()) == want


def test_nearest_vectors_equal_brute_force(spark, some_vectors):
    data, df = some_vectors
    c = cosines(data)
    np.fill_diagonal(c, -2)
    ids = [i for i, _ in data]
    want = {a: (min(ids[j] for j in np.flatnonzero(c[i] == c[i].max())), c[i].max()) for i, a in enumerate(ids)}
    found = vectors.nearest_vector(df, df, 0.9).collect()
    assert {r.a: (r.b, r.similarity) for r in found} == want
    assert all(r.matched == (r.similarity >= 0.9) for r in found)
    assert vectors.nearest_vector(df.limit(0), df).count() == 0 and vectors.nearest_vector(df, df.limit(0)).count() == 0


def test_links_of_all_vectors_with_copies(spark, some_vectors):
    data, df = some_vectors
    c = cosines(data)
    ids = [i for i, _ in data]
    first = {tuple(v): min(i for i, w in data if w == v) for _, v in data}
    cls = [first[tuple(v)] for _, v in data]
    found = {r.vec_id: r for r in vectors.vector_links(df, 0.95).collect()}
    assert len(found) == len(data) + 4
    for i, a in enumerate(ids):
        near = [j for j in range(len(ids)) if cls[j] != cls[i] and c[i, j] >= 0.95]
        r = found[a]
        assert (r.class_id, r.n_same, r.n_links) == (cls[i], cls.count(cls[i]), len(near))
        best = max((c[i, j] for j in near), default=None)
        assert r.similarity == best and r.nearest_id == (min(cls[j] for j in near if c[i, j] == best) if near else None)
    assert all(found[i].n_links == 0 and found[i].nearest_id is None for i in (3000, 3001, 3002, 3003))
    assert vectors.vector_links(df.limit(0), 0.9).count() == 0


def test_pivots_prune_and_blocks_are_bounded(spark):
    """Vectors in groups: most pairs of blocks never meet, and a cell with most of the rows is several blocks."""
    data = grouped_vectors(3000, 40, d=16, seed=3)
    df = spark.createDataFrame([(i, v) for i, v in data if i % 3] + [(10_000 + i, (np.array(data[1][1]) + i * 1e-6).tolist()) for i in range(3000)], VECTORS).repartition(4)
    index = vectors.build_index(df)
    sizes = [r.n for r in index.blocks.select(F.size("ids").alias("n")).collect()]
    assert sum(sizes) == 5000 and max(sizes) < 1.3 * vectors.ROWS_EACH
    seen = vectors.block_join(df.withColumnRenamed("vec_id", "id"), index, lambda c, a, b: ([1], [c.size]), "one long, n long", 0.99)
    assert seen.agg(F.sum("n")).first()[0] < 0.6 * 5000**2


# Jobs and their results


def test_only_completed_jobs_are_reused(spark):
    t = lambda h: datetime.datetime(2024, 1, 1, h)
    jobs = [
        (1, "d", "APA", "x", "completed", t(5)), (2, "d", "APA", "x", "completed", t(3)), (3, "d", "APA", "x", "running", t(9)), (4, "d", "APA", "x", "failed", t(9)), (5, "d", "IEEE", "x", "completed", t(9)),
        (6, "e", "APA", "x", "queued", None), (7, "d", "APA", "x", "completed", t(5)), (8, None, "APA", "x", "completed", t(1)), (9, None, "APA", "x", "queued", None), (10, "f", None, "x", "completed", t(1)), (11, "f", "", "x", "queued", None), (12, "g", "APA", "x", "completed", None),
        (13, "g", "APA", "x", "queued", None),
    ]
    df = spark.createDataFrame(jobs, "job_id long, document string, style string, content string, status string, completed_at timestamp")
    assert dict(rows(operations.reusable_results(df))) == {1: 7, 2: 7, 3: 7, 4: 7, 5: None, 6: None, 7: 1, 8: None, 9: 8, 10: None, 11: None, 12: None, 13: None}
    a, b = (operations.cache_key(b=F.lit(1), a=x) for x in (F.lit("x"), F.lit(None).cast("string")))
    found = spark.range(1).select(a.alias("a"), b.alias("b"), F.sha2(F.lit('{"a":"x","b":1}'), 256).alias("want")).first()
    assert found.a == found.want != found.b


def test_timings_waits_and_retries(spark):
    t = lambda s: datetime.datetime(2024, 1, 1, 0, 0, s)
    jobs = [(t(0), t(2), 3, [("parse", 10.0), ("write", 5.0)]), (t(1), t(2), 1, [("parse", 20.0)]), (t(1), None, None, None), (t(1), t(5), 0, [("parse", 90.0)])]
    df = spark.createDataFrame(jobs, "queued_at timestamp, started_at timestamp, attempts int, stage_timings array<struct<name:string,elapsed_ms:double>>")
    assert rows(operations.job_timings(df)) == [("parse", 3, 40.0, 20.0, None), ("queue", 3, 2333.333, 2000.0, 2), ("write", 1, 5.0, 5.0, None)]
    many = spark.range(50_000).select(F.lit(t(0)).alias("queued_at"), F.lit(t(0)).alias("started_at"), F.lit(1).alias("attempts"), F.array(F.struct(F.lit("s").alias("name"), (F.col("id") * 7919 % 50_000).alias("elapsed_ms"))).alias("stage_timings"))
    median = next(r.median_ms for r in operations.job_timings(many, 1000).collect() if r.stage == "s")
    assert abs(median - 25_000) <= 50_000 / 1000


def test_all_limits_and_detached_projects(spark):
    users = spark.createDataFrame([(1, "free", 6, 1, 50 * 1024**2), (2, "team", 9, 9, None), (3, "other", 1, 1, 1)], "user_id long, plan string, documents long, plagiarism_checks long, storage long")
    found = operations.usage_of_all_limits(users, operations.plans(spark))
    assert rows(found, "user_id", "resource", "percent", "within") == [(1, "documents", 100, False), (1, "plagiarism_checks", 100, False), (1, "storage", 50, True), (2, "documents", 100, True), (2, "plagiarism_checks", 100, True), (2, "storage", 0, True)]
    docs = spark.createDataFrame([(1, 7), (2, 8), (3, None), (4, 7)], "doc_id long, project_id long")
    gone = spark.createDataFrame([(7,), (7,), (9,)], "project_id long")
    assert rows(operations.detach_projects(docs, gone, "project_id"), "doc_id", "project_id") == [(1, None), (2, 8), (3, None), (4, None)]


def test_block_ids(spark):
    ids = "doc_id long, block_id string"
    blocks = spark.createDataFrame([(1, "a"), (1, "a"), (1, " b "), (1, ""), (1, None), (2, "a"), (2, "c")], ids)
    found = spark.createDataFrame([(1, "a"), (2, "c"), (2, "c")], ids)
    assert rows(layout.block_id_errors(blocks, found)) == [(1, "duplicate", "a"), (1, "missing", "b"), (1, "no id", None), (1, "no id", None), (2, "missing", "a")]


def test_confidence(spark):
    df = spark.createDataFrame([("a b", "a b"), ("", "x"), ("A b c", "a B d"), ("a", "b")], "o string, r string")
    assert [x[0] for x in df.select(overlap_confidence(F.col("o"), F.col("r"))).collect()] == [0.0, 0.5, 0.5, 0.5]


def test_vector_blocks_are_not_broadcast(spark, tmp_path):
    # By estimate the queries' side was the smaller one, though it holds every query once for each block (F1).
    rng = np.random.default_rng(5)
    x = rng.normal(size=(3000, 16)).astype("float32")
    pd_rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    df = spark.createDataFrame(pd_rows, "vec_id long, embedding array<float>")
    links = vectors.vector_links(df, 0.5)
    u = x.astype("float64") / np.linalg.norm(x.astype("float64"), axis=1, keepdims=True)
    c = np.floor(u @ u.T * 1e4 + 0.5) / 1e4
    np.fill_diagonal(c, -1)
    assert {r.vec_id: r.n_links for r in links.collect()} == dict(enumerate((c >= 0.5).sum(1).tolist()))
    plan = links._jdf.queryExecution().executedPlan().toString()
    at = plan.index("[unit#")
    assert "ShuffledHashJoin" in plan[plan.rindex("\n", 0, at) : at]


def test_equal_vectors_of_chunks_are_compared_once(spark, monkeypatch):
    """Each row's vector went to each of 64 blocks; now 20 distinct ones do (F1)."""
    rng = np.random.default_rng(7)
    x, y = rng.normal(size=(20, 8)), rng.normal(size=(6, 8))
    a = spark.createDataFrame([(i, i % 3, x[i % 20].tolist()) for i in range(2000)] + [(9000, 0, None), (9001, 0, [math.nan] * 8), (9002, 0, [1.0])], "doc_id long, chunk_idx long, embedding array<double>")
    b = spark.createDataFrame([(i, y[i % 6].tolist()) for i in range(60)], "source long, embedding array<double>")
    asked, join = [], vectors.block_join
    monkeypatch.setattr(vectors, "block_join", lambda q, *args, **more: (asked.append(q.count()), join(q, *args, **more))[1])
    c = cosines([(0, v) for v in [*x.tolist(), *y.tolist()]])[:20, 20:]
    want = sorted((i, i % 3, j, c[i % 20, j % 6]) for i in range(2000) for j in range(60) if c[i % 20, j % 6] >= 0.3)
    found = vectors.keyed_matches(a, b, 0.3).select("doc_id", "chunk_idx", "source", "similarity")
    assert sorted(tuple(r) for r in found.collect()) == want and asked == [20]
    assert vectors.keyed_matches(a.limit(0), b, 0.3).count() == vectors.keyed_matches(a, b.limit(0), 0.3).count() == 0


# Pages that share most words with a query


@pytest.mark.parametrize("n_pages", [2, 700])
def test_most_shared_equals_brute_force(spark, monkeypatch, n_pages):
    """Frequent words on nearly all pages: only k rows of each query and block leave a task (F4 to F6)."""
    monkeypatch.setattr(postings, "SLICE", 16)
    rnd = random.Random(8)
    vocabulary = [f"w{i}" for i in range(40)]
    words = lambda most: rnd.choices(vocabulary, weights=[1 / (i + 1) for i in range(40)], k=rnd.randint(0, most))
    pages = [(7 * i % 1009, words(30)) for i in range(n_pages)]
    asked = [(i // 3, i % 3, [*words(12), "nowhere"][rnd.randint(0, 1) :]) for i in range(200)] + [(900, 0, []), (901, 0, ["nowhere"])]
    want = []
    for d, c, q in asked:
        hits = sorted((-len(set(q) & set(w)), p) for p, w in pages)
        want += [(d, c, p, -h, place) for place, (h, p) in enumerate(hits[:3], 1) if h < 0]
    found = postings.most_shared(spark.createDataFrame(asked, "doc_id long, chunk_idx int, words array<string>"), spark.createDataFrame(pages, "page_id long, words array<string>"), ["doc_id", "chunk_idx"], 3)
    assert rows(found) == sorted(want, key=repr)
    none = spark.createDataFrame([], "page_id long, words array<string>")
    assert postings.most_shared(spark.createDataFrame(asked, "doc_id long, chunk_idx int, words array<string>"), none, ["doc_id", "chunk_idx"], 3).count() == 0


def test_queries_are_exchanged_once_and_not_for_each_block(spark, monkeypatch):
    """Many blocks of pages, rare and frequent words, many ties: a query is a row of the exchange, whatever the blocks (F2 to F4)."""
    monkeypatch.setattr(postings, "SLICE", 16)
    monkeypatch.setattr(postings, "PAGES_EACH", 64)
    rnd = random.Random(10)
    words = lambda n: [f"w{int(rnd.paretovariate(0.3)) % 5000}" for _ in range(n)]
    pages = [(13 * i % 2003 - 500, words(rnd.randint(1, 40))) for i in range(700)]
    asked = [(i, 0, words(rnd.randint(1, 12))) for i in range(1500)] + [(2000, 0, pages[3][1]), (2001, 0, ["w1"])]
    exchanged, repartition = [], type(spark.range(1)).repartition
    monkeypatch.setattr(type(spark.range(1)), "repartition", lambda df, *args: (exchanged.append(df.count()), repartition(df, *args))[1])
    found = postings.most_shared(spark.createDataFrame([*asked, (2002, 0, ["w1", "w2"]), (2002, 0, ["w2", "w3"])], "doc_id long, chunk_idx int, words array<string>"), spark.createDataFrame(pages, "page_id long, words array<string>"), ["doc_id", "chunk_idx"], 3)
    assert len(asked) < exchanged[0] < len(asked) + 100
    want = []
    for d, c, q in [*asked, (2002, 0, ["w1", "w2", "w3"])]:
        hits = sorted((-len(set(q) & set(w)), p) for p, w in pages)
        want += [(d, c, p, -h, place) for place, (h, p) in enumerate(hits[:3], 1) if h < 0]
    assert rows(found) == sorted(want, key=repr)


def test_only_texts_with_candidates_are_exchanged_and_once_before_their_pairs(spark, monkeypatch):
    """Pairs are dealt to pages before they get their texts; chunks from the ninth on have no pages (F2, F3)."""
    chunks = spark.createDataFrame([(d, c, f"some words of {d} and {c}") for d in range(5) for c in range(20)], "doc_id long, chunk_idx int, chunk string")
    pages = spark.createDataFrame([(p, f"u{p}", f"some words of page {p}") for p in range(9)], "page_id long, url string, text string")
    given, squares = [], similarity.shared_squares
    monkeypatch.setattr(similarity, "shared_squares", lambda texts, *args: (given.append(texts.filter("text is not null").count()), squares(texts, *args))[1])
    found = similarity.page_scores(chunks, pages)
    assert given == [40] and found.count() == 5 * 8 * 3 and found.filter("text like 'some words of%'").count() == 5 * 8 * 3


def test_page_scores_exchange_texts_and_not_tokens(spark, monkeypatch):
    """Each text meets its page as it is; a page that all chunks have is dealt to several tasks (F4, F6)."""
    monkeypatch.setattr(postings, "PAIRS_EACH", 7)
    rnd = random.Random(9)
    words = lambda low, high: [f"w{min(rnd.randint(0, 40), rnd.randint(0, 40))}" for _ in range(rnd.randint(low, high))]
    pages = {p: words(1, 60) for p in range(40)} | {40: ["w0", *[f"w{i}" for i in range(41)]], 41: []}
    chunks = [(d, c, words(1, 30)) for d in range(30) for c in range(3)]
    chunk_rows = spark.createDataFrame([(d, c, " ".join(w)) for d, c, w in chunks], "doc_id long, chunk_idx int, chunk string")
    page_rows = spark.createDataFrame([(p, f"u{p}", " ".join(w)) for p, w in pages.items()], "page_id long, url string, text string")
    want = {}
    for d, c, w in chunks:
        hits = sorted((-len(set(w[:12]) & set(x)), p) for p, x in pages.items())
        for h, p in hits[:3]:
            a, b = Counter(w), Counter(pages[p])
            idf = lambda t: 1 if a[t] and b[t] else math.log(1.5) + 1  # noqa: E731, B023
            square = lambda x: sum((n * idf(t)) ** 2 for t, n in x.items())  # noqa: E731, B023
            want[d, c, p] = sum(a[t] * b[t] for t in a) / math.sqrt(square(a) * square(b))
    found = similarity.page_scores(chunk_rows, page_rows)
    got = {(r.doc_id, r.chunk_idx, r.page_id): r.similarity for r in found.collect()}
    assert got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 6e-5 for k in want)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert not [line for line in plan.splitlines() if "hashpartitioning" in line and "token" in line]
    urls = {(r.doc_id, r.chunk_idx, r.page_id): (r.url, r.preview) for r in similarity.web_matches(chunk_rows, page_rows, 0.2).collect()}
    texts = {(d, c): " ".join(w) for d, c, w in chunks}
    assert urls == {k: (f"u{k[2]}", texts[k[:2]][:150] + ("..." if len(texts[k[:2]]) > 150 else "")) for k, v in got.items() if v >= 0.2}


# Chunks and sources


similarity_words = re.compile(r"\w\w+")


def brute_matches(chunks, sources, threshold):
    """(doc, chunk, source, similarity) by counting; rows of one key are one unit, but each counts as a unit."""
    words = lambda t: similarity_words.findall((t or "").lower())
    units = {}
    for key, text in [(("c", d, i), t) for d, i, t in chunks] + [(("s", s), t) for s, t in sources]:
        units.setdefault(key, Counter()).update(words(text))
    n, df = len(chunks) + len(sources), Counter(w for u in units.values() for w in u)
    vectors_of = {k: {w: c * (math.log((1 + n) / (1 + df[w])) + 1) for w, c in u.items()} for k, u in units.items()}
    norm = lambda v: math.sqrt(sum(x * x for x in v.values()))
    out = []
    for a, x in vectors_of.items():
        for b, y in vectors_of.items():
            if a[0] == "c" and b[0] == "s" and None not in a and set(x) & set(y):
                cosine = sum(x[w] * y[w] for w in x if w in y) / norm(x) / norm(y)
                if math.floor(cosine * 1e4 + 0.5) / 1e4 >= threshold:
                    out.append((a[1], a[2], b[1], math.floor(cosine * 1e4 + 0.5) / 1e4))
    return sorted(out)


@pytest.mark.parametrize(("held", "threshold"), [(1 << 16, 0.35), (5, 0.35), (5, 0.75)])
def test_chunks_stream_past_sources(spark, monkeypatch, held, threshold):
    """Words that tasks don't hold, keys that come twice, empty and null texts, slices of few sources and words."""
    monkeypatch.setattr(similarity, "WORDS_HELD", held)
    monkeypatch.setattr(postings, "WIDTH", 7)
    monkeypatch.setattr(postings, "COLUMNS", 3)
    monkeypatch.setattr(postings, "SOURCES_EACH", 16)
    rnd = random.Random(3)
    text = lambda n: " ".join(f"w{min(int(rnd.expovariate(0.08)), 90)}" for _ in range(n))
    sources = [(s, text(rnd.randint(1, 12))) for s in range(40)] + [(98, ""), (99, None)]
    chunks = [(d, i, rnd.choice([text(rnd.randint(1, 15)), f"{rnd.choice(sources[:40])[1]} {text(2)}"])) for d in range(60) for i in range(3)]
    chunks += [(7, 1, "w1 w2 w3"), (None, 0, sources[0][1]), (61, 0, ""), (62, 0, "w1 " * 5000 + sources[3][1])]
    found = similarity.chunk_matches(spark.createDataFrame(chunks, "doc_id long, chunk_idx int, chunk string"), spark.createDataFrame(sources, "source_id long, text string"), threshold)
    want = brute_matches(chunks, sources, threshold)
    assert len(want) > 50
    assert rows(found, "doc_id", "chunk_idx", "source", "similarity") == sorted(want, key=repr)


def test_rows_of_queries_hold_no_null_arrays(spark):
    """Arrow's writer passes over all null arrays of a batch again for each of its rows."""
    block = spark.createDataFrame([], postings.WEIGHTED)
    assert all(v == [] for v in spark.range(1).select(*postings._empty(block)).first())


def test_pairs_are_scored_in_their_rows(spark):
    """No token is exchanged; rows of one pair are one pair, and texts without tokens have no row or 0."""
    pairs = [(1, "the cat sat on the mat", 1, "the dog sat"), (2, "", 1, "the dog"), (3, None, 2, "!"), (4, "aa bb aa", 1, "aa bb aa"), (5, "xx yy", 1, "zz"), (6, "one two", 3, "two three"), (6, "one six", 3, "two")]
    table = spark.createDataFrame(pairs, "a_id long, a_text string, b_id long, b_text string")
    want = {}
    merged = {}
    for a, x, b, y in pairs:
        for side, text in enumerate((x, y)):
            merged.setdefault((a, b), (Counter(), Counter()))[side].update(similarity_words.findall((text or "").lower()))
    for key, (x, y) in merged.items():
        idf = lambda w: 1.0 if w in x and w in y else math.log(1.5) + 1  # noqa: B023, E731
        norm = lambda c: math.sqrt(sum((n * idf(w)) ** 2 for w, n in c.items()))  # noqa: B023, E731
        if x or y:
            want[key] = round(sum(x[w] * y[w] for w in x) / norm(x) / norm(y) * 100, 2) if x and y else 0.0
    assert {(r.a_id, r.b_id): r.score for r in similarity.pair_tfidf(table).collect()} == want
    once = similarity.pair_tfidf(table.filter("a_id < 6"))
    assert "Exchange" not in once._jdf.queryExecution().executedPlan().toString()


def test_ascii_boundaries_look_to_one_side():
    """Beside plain words a boundary is one look to the other side, with the same matches."""
    patterns = [p for _, p, _ in lexicons.GRAMMAR_RULES] + [
        zones.MARGIN_PLACES, zones.QUESTION, *zones.MARGIN_STARTS, language.TONE_CONTRACTION, language.TONE_FIRST_PERSON, r"(?i)\bwe\b", r"\b20\d{2}\b", r"\bi?we\b|\b", r"\b(?:i |we)\b", r"\s\b", r"\bw*e", r"\bet al\.?\b", r"\b(?:19|20)\d{2}\b",
    ]
    rnd = random.Random(5)
    pieces = ["i", "we", "We", "us", "my", "é", "_", "'", " ", " ", ".", "20", "2019", "et al", "usa", "inc", "who", "article", "your going", "their are", "-", "\n"]
    for pattern in patterns:
        plain, fast = re.compile(pattern.replace(r"\b", text_functions.ASCII_EDGE), re.ASCII), re.compile(text_functions.ascii_rule(pattern), re.ASCII)
        for _ in range(300):
            text = "".join(rnd.choice(pieces) for _ in range(12))
            assert [m.span() for m in plain.finditer(text)] == [m.span() for m in fast.finditer(text)], (pattern, text)
    assert text_functions.ASCII_EDGE not in text_functions.ascii_rule(zones.MARGIN_PLACES) + text_functions.ascii_rule(language.TONE_FIRST_PERSON)


def test_typed_blocks_are_stripped_once(spark):
    """What three steps read is written once; long texts have more words than rules ask for."""
    blocks = spark.createDataFrame([(1, 0, " A word " * 9, 10.0, True, 2), (1, 1, "one two three four five six seven eight", 10.0, True, 2), (1, 2, "w " * 15 + "1", 10.0, False, 2), (1, 3, "w " * 13 + "1", 10.0, False, 2)], "doc_id long, block_idx int, text string, font_size double, is_bold boolean, page int")
    found = zones.typed_blocks(blocks)
    assert "regexp_replace" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert rows(found, "block_idx", "type") == [(0, "paragraph"), (1, "heading"), (2, "paragraph"), (3, "running_header")]


# Shingles


def test_shingle_candidates_equal_all_pairs(spark):
    """Near copies, a passage that most texts have, copies but for case, short texts, and several texts of one doc_id, whose shingles are one set."""
    rnd = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    passage = " ".join(rnd.choices(words, k=60))
    docs = [(9000, None), (None, "a b c d e f"), (9001, " "), (9002, "a b"), (9003, "a b c"), (9004, "A  b"), (9005, "a b")]
    for i in range(40):
        own = rnd.choices(words, k=rnd.randint(5, 90))
        docs.append((i, " ".join(own) + (" " + passage if i % 3 else "")))
        for j in range(rnd.randint(0, 3)):
            near = list(own)
            near[rnd.randrange(len(near))] = "x"
            docs.append((100 + 10 * i + j, " ".join(near) + (" " + passage if i % 3 else "")))
    base = " ".join(rnd.choices(words, k=50))
    docs += [(8000, base), (8000, base + " and more of it"), (8000, base), (8001, base + " and"), (8002, base.upper())]
    least = {}
    for d, t in docs:
        t = " ".join((t or "").lower().split())
        if t and d is not None:
            least[t] = min(d, least.get(t, d))
    sets = {}
    for t, d in least.items():
        w = t.split(" ")
        sets.setdefault(d, set()).update(" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4)))
    want = []
    for a in sets:
        for b in sets:
            share = len(sets[a] & sets[b]) / len(sets[a] | sets[b])
            if a < b and share >= 0.8 - 1e-9:
                want.append((a, b, round(share, 6)))
    assert len(want) > 20 and any(8000 in w for w in want)
    found = similarity.shingle_candidates(spark.createDataFrame(docs, "doc_id long, text string"))
    assert rows(found, "a_id", "b_id", "jaccard") == sorted(want, key=repr)


def test_only_sets_that_can_be_near_are_exchanged(spark, monkeypatch):
    """A large unit in parts, texts that share a shingle by chance, and others: sets of all texts, and pairs with their sets, were exchanged (F5)."""
    monkeypatch.setattr(similarity, "PART_EACH", 8)
    rnd = random.Random(12)
    text = lambda n: [f"w{rnd.randint(0, 10**6)}" for _ in range(n)]
    base, line = text(200), text(5)
    near = [[*base[:-k], *text(k)] if k else base for k in range(40)]
    chance = [[*text(60), *line, *text(60)] for _ in range(80)]
    docs = [(i, " ".join(w)) for i, w in enumerate([*near, *chance, *[text(100) for _ in range(80)]])]
    sets = {d: {" ".join(w[i : i + 5]) for i in range(len(w) - 4)} for d, w in ((d, t.split(" ")) for d, t in docs)}
    share = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    want = [(a, b, round(share(a, b), 6)) for a in sets for b in sets if a < b and share(a, b) >= 0.8 - 1e-9]
    dealt, repartition = [], type(spark.range(1)).repartition
    monkeypatch.setattr(type(spark.range(1)), "repartition", lambda df, *args: (dealt.append(df), repartition(df, *args))[1])
    found = similarity.shingle_candidates(spark.createDataFrame(docs, "doc_id long, text string"))
    assert rows(found, "a_id", "b_id", "jaccard") == sorted(want, key=repr) and len(want) > 100
    sent = dealt[-1].select("doc_id", "i", "j", F.size("s").alias("n")).collect()
    assert {r.doc_id for r in sent} <= set(range(40)) and len({(r.i, r.j) for r in sent}) > 3


# Steps that are made once


def generators(name, spark, sf):
    """Expansions of documents into lines that a query's last plan still holds."""
    from vellum import catalog

    return catalog.queries()[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString().count("Generate")


def test_metrics_are_made_once(spark, sf):
    """str11 compares metrics with themselves and scores both: they are four uses of one table."""
    assert generators("str11_compare_segmentations", spark, sf) == 0


def test_page_keys_are_made_once(spark, sf):
    """seg22 makes blocks once for sections and pages, and a key once for all that it meets."""
    assert generators("seg22_page_ranges", spark, sf) == 0


def test_bibliographies_are_made_once(spark, sf):
    """cit13 splits lines and adds a heading; it neither finds the lists twice nor parses again for the headings."""
    assert generators("cit13_convert_mla", spark, sf) == 2


def test_section_features_are_made_once(spark, sf):
    """str2 meets each section with all types, for the best and for the sum; sections aren't found again for either."""
    assert generators("str2_section_classifier", spark, sf) <= 2


def test_parted_blocks_are_made_once(spark, sf):
    """seg25 takes titles and parts from one table of blocks."""
    assert generators("seg25_document_parts", spark, sf) == 0
