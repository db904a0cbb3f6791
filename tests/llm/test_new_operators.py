"""Mixing, whitening and periodic runs against brute-force versions."""

import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import rows_of
from vellum.llm import mixing, periodic_runs, whitening


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def words(text):
    return (text or "").encode().split()


# Mixing


def targets(sizes, weights, share=1.5, passes=2):
    """Water filling by the contract's words: what is over is shared again until none is above."""
    out, free = dict.fromkeys(sizes, 0.0), share * sum(sizes.values())
    open_ = {s for s in sizes if sizes[s]}
    while free > 1e-9 and open_:
        each = free / sum(weights[s] for s in open_)
        free = 0.0
        for s in list(open_):
            out[s] += weights[s] * each
            if out[s] >= passes * sizes[s]:
                free += out[s] - passes * sizes[s]
                out[s] = passes * sizes[s]
                open_.discard(s)
    return out


def check_mix(rows, found):
    sizes = {}
    for _, text, source in rows:
        sizes[source] = sizes.get(source, 0) + len(words(text))
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    want = targets(sizes, {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)})
    assert len(found) == len(rows)
    taken = dict.fromkeys(sizes, 0)
    source_of = {(i, len(words(t)), sizes[s]): s for i, t, s in rows}
    for r in found:
        source = source_of[r.doc_id, r.size, r.source_size]
        assert math.isclose(r.target, want[source], rel_tol=1e-9, abs_tol=1e-6)
        assert 0 <= r.taken <= 2 * r.size
        taken[source] += r.taken
    assert all(abs(taken[s] - want[s]) <= 0.5 + 1e-6 for s in sizes)


def test_mix_of_documents(documents):
    found = mixing.report(documents).collect()
    check_mix([(r.doc_id, r.text, r.source) for r in documents.select("doc_id", "text", "source").collect()], found)
    assert sorted(found) == sorted(mixing.report(documents.repartition(7)).collect())  # reruns agree


def test_mix_of_odd_rows(spark, odd):
    rows = [(i, t, s) for (i, t), s in zip(odd.select("doc_id", "text").collect(), ["a", None, None, "", "é", "z", "a", None, "Z", "z", "é", "", "q", "q", None, "b"], strict=True)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({c: F.lit("clash") for c in ("mix", "size", "bucket", "words", "epoch", "position", "target", "taken", "kept")})
    check_mix(rows, mixing.report(df).collect())
    assert mixing.report(df.limit(0)).collect() == []
    assert [(r.size, r.target, r.taken) for r in mixing.report(df.filter("doc_id = 3")).collect()] == [(0, 0.0, 0)]


def test_hot_source_is_dealt_out_and_positions_follow_the_schedule(spark):
    n = 6000
    df = spark.range(n).select(F.col("id").alias("doc_id"), F.repeat(F.lit("w "), (F.col("id") % 7 + 1).cast("int")).alias("text"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 5)).alias("source"))
    assigned = mixing.assign(df)
    assert assigned.groupBy("mix.source_key", "mix.bucket").count().agg(F.max("count")).first()[0] < n / 6
    mixed = mixing.in_training_order(assigned).collect()
    position = [r.position for r in mixed]
    assert position == sorted(position) and 0 <= position[0] and position[-1] <= 1
    # The demand of a source up to a time is the integral of its schedule up to then.
    for key in {r.mix.source_key for r in mixed}:
        mine = [r for r in mixed if r.mix.source_key == key]
        knots = [(k.at, k.weight) for k in mine[0].mix.knots]
        done = 0
        for r in mine[:: max(1, len(mine) // 20)]:
            done = sum(x.words for x in mine if x.position < r.position) + r.words / 2
            (a, u), (b, v) = knots
            area = lambda t, a=a, u=u, b=b, v=v: u * (t - a) + (v - u) / (b - a) * (t - a) ** 2 / 2
            assert abs(area(r.position) / area(1.0) * mine[0].mix.target - done) <= 1


def test_own_schedules_and_idle_times(spark):
    df = spark.createDataFrame([(i, "w " * 10, "ab"[i % 2]) for i in range(40)], "doc_id long, text string, source string")
    own = spark.createDataFrame([("a", [(0.0, 0.0), (0.5, 0.0), (1.0, 8.0)])], "source string, knots array<struct<at:double,weight:double>>")
    mixed = mixing.in_training_order(mixing.assign(df, own=own, share=0.5)).collect()
    a = [r for r in mixed if r.mix.source_key == "0a"]
    assert a and min(r.position for r in a) > 0.5
    assert a[0].mix.target == pytest.approx(0.5 * 400 * 2 / (2 + 2))  # both integrals are 2


# Whitening


def brute_whitening(rows):
    kept = [(i, [math.floor(64 * float(c)) + 1_000_000 for c in v]) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    distinct = sorted({tuple(x) for _, x in kept})
    n = len(distinct)
    s = [sum(c) for c in zip(*distinct, strict=True)]
    centred = np.array([[n * a - b for a, b in zip(x, s, strict=True)] for x in distinct], object).astype(float) / n
    e, v = np.linalg.eigh(centred.T @ centred / n)
    e, v = e[::-1], v[:, ::-1]
    out = {}
    for i, x in kept:
        d = [n * a - b for a, b in zip(x, s, strict=True)]
        out.setdefault(i, []).append((sum(a * a for a in d), np.array(d, float) / n @ v[:, :16] / np.sqrt(np.maximum(e[:16], 1e-300))))
    return n, e, out


def test_whitening_of_embeddings(spark, sf):
    df = spark.read.parquet(f"{sf}/embeddings.parquet")
    n, e, want = brute_whitening([(r.vec_id, r.embedding) for r in df.collect()])
    found = whitening.report(df).collect()
    assert len(found) == 16 * df.count() and {r.n for r in found} == {n}
    assert {r.identity_error for r in found} == {found[0].identity_error} and found[0].identity_error < 1e-8
    by = {(r.vec_id, r.component): r for r in found}
    signs = np.sign([by[next(iter(want)), c + 1].whitened * want[next(iter(want))][0][1][c] for c in range(16)])
    for i, [(deviation, z)] in want.items():
        for c in range(16):
            r = by[i, c + 1]
            assert r.deviation == deviation
            assert abs(r.whitened - signs[c] * z[c]) < 1e-6
            assert abs(r.explained / (e[c] / e.sum()) - 1) < 1e-9


def test_whitening_of_odd_rows(spark):
    rnd = random.Random(3)
    rows = [(i, [rnd.gauss(0, 1) * 10**k for k in range(4)]) for i in range(30)]
    rows += [(0, rows[0][1]), (None, rows[1][1]), (50, None), (51, []), (52, [1.0, None, 1.0, 1.0]), (53, [1.0, math.nan, 1.0, 1.0]), (54, [math.inf, 1.0, 1.0, 1.0]), (55, [1.0, 2.0]), (56, [1e30, 1.0, 1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({c: F.lit("clash") for c in ("x", "n", "deviation", "whitened", "component")})
    found = whitening.report(df).collect()
    n, e, want = brute_whitening(rows[:32])
    assert n == 30 and len(found) == 32 * 4 and {r.vec_id for r in found} == {*range(30), None}
    assert sorted(r.deviation for r in found if r.component == 1) == sorted(d for x in want.values() for d, _ in x)
    assert whitening.report(df.filter("vec_id >= 50")).count() == 1 * 2  # vectors of length 1e30 and the short one: one of two entries is left
    assert whitening.report(df.limit(0)).count() == 0


def test_whitening_without_variance(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<float>")
    assert {(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in whitening.report(df).collect()} == {(1, 0, None, None, None)}
    df = spark.createDataFrame([(1, [1.0, 2.0, 0.0]), (2, [3.0, 2.0, 0.0])], "vec_id long, embedding array<float>")
    found = {(r.vec_id, r.component): r for r in whitening.report(df).collect()}
    assert abs(found[1, 1].whitened) == 1.0 and found[1, 1].explained == 1.0 and found[1, 2].whitened is None and found[1, 2].explained == 0.0


@pytest.mark.parametrize("d", [1, 2, 5, 9])
def test_polynomial_roots_and_components_are_exact(spark, d):
    """Also with equal eigenvalues and large entries."""
    rng = np.random.default_rng(d)
    b = rng.integers(-(10**7), 10**7, (d + 3, d)).astype(object)
    if d == 9:
        b = np.eye(9, dtype=object) * 12345  # one eigenvalue, nine times
    a = (b.T @ b).tolist()
    poly = whitening.characteristic_polynomial(spark, a)
    trace = sum(a[i][i] for i in range(d))
    assert poly[d] == 1 and poly[d - 1] == -trace
    assert all(whitening.exact_gram(np.array(b, np.int64)).tolist()[i] == a[i] for i in range(d))
    shift = 256 - trace.bit_length()
    roots = whitening.largest_roots([c << shift * (d - i) for i, c in enumerate(poly)], trace << shift, d)
    assert sum(m for _, m in roots) == d
    eigen = np.linalg.eigvalsh(np.array(a, float))[::-1]
    assert np.allclose([r / (1 << shift) for r, m in roots for _ in range(m)], eigen, rtol=1e-9)
    scaled = [[v << shift for v in row] for row in a]
    v = np.array([x for r, m in roots for x in whitening.null_vectors(scaled, r, m)])
    assert np.abs(v @ v.T - np.eye(d)).max() < 1e-14
    assert np.abs(np.array(a, float) @ v.T - v.T * eigen).max() < 1e-12 * eigen[0]


def test_close_eigenvalues_are_told_apart(spark):
    a = [[10**14, 1, 0], [1, 10**14, 0], [0, 0, 5]]
    poly = whitening.characteristic_polynomial(spark, a)
    shift = 200
    roots = whitening.largest_roots([c << shift * (3 - i) for i, c in enumerate(poly)], (2 * 10**14 + 5) << shift, 2)
    assert [r >> shift for r, _ in roots] == [10**14 + 1, 10**14 - 1]
    scaled = [[v << shift for v in row] for row in a]
    assert np.allclose(whitening.null_vectors(scaled, roots[0][0], 1), [[0.5**0.5, 0.5**0.5, 0]], atol=1e-15)


# Periodic runs


def runs_by_brute_force(w):
    n, out = len(w), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i < n - q:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j < n - q and w[j] == w[j + q]:
                j += 1
            if j + q - i >= max(12, 2 * q):
                out.setdefault((i, j + q), q)
            i = j
    return sorted((s, e - s, q) for (s, e), q in out.items())


def expected_runs(doc_id, text):
    w = words(text)
    n = len(w)
    if doc_id is not None and n and zlib.crc32(str(doc_id).encode()) % 10 == 0:
        g = zlib.crc32(str(doc_id).encode()) // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = runs_by_brute_force(w)
    top = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
    kept = [x.decode() for i, x in enumerate(w) if not any(s + q <= i < s + m for s, m, q in runs)]
    return (doc_id, len(runs), *top, 1000 * top[1] // top[2] if runs else None, sha("".join(f"{s},{m},{q}\n" for s, m, q in runs)), sha(" ".join(kept)))


RUN_COLUMNS = ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")


def test_runs_equal_brute_force():
    rnd = random.Random(1)
    docs = []
    for _ in range(1500):
        n = rnd.choice([0, 1, 11, 12, 13, 30, 80, 150])
        w = [rnd.randrange(rnd.choice([1, 2, 3, 5, 20])) for _ in range(n)]
        for _ in range(rnd.randrange(3) if n else 0):
            a, p = rnd.randrange(n), rnd.randrange(1, max(2, n // 3))
            for i in range(a, rnd.randrange(a, n + 1)):
                w[i] = w[a + (i - a) % p]
        docs.append(w)
    docs += [[1] * 500, [1, 2] * 300 + [1], ([1] * 13 + [2]) * 30, [1, 2, 3, 1, 2] * 40, docs[3], docs[3]]
    found = periodic_runs.runs_of(docs)
    assert [[tuple(r) for r in f.tolist()] for f in found] == [runs_by_brute_force(w) for w in docs]
    assert sum(map(len, found)) > 200
    one_by_one = [periodic_runs.runs_of([w])[0].tolist() for w in docs]
    assert one_by_one == [f.tolist() for f in found]


def test_runs_of_documents(documents):
    short = documents.select("doc_id", "text").filter("length(text) < 6000")
    assert rows_of(periodic_runs.report(short), *RUN_COLUMNS) == sorted((expected_runs(*r) for r in short.collect()), key=repr)


def test_runs_of_odd_rows(spark, odd):
    more = spark.createDataFrame([(100, "a b " * 20), (101, "x" + " y\x1cz " * 30), (102, "a\x0bb\tc\r\n" * 9), (103, "\x00 " * 40), (None, "a b c d e f " * 3)], "doc_id long, text string")
    df = odd.select("doc_id", "text").union(more).withColumns({c: F.lit("clash") for c in ("runs", "collapsed", "start", "_w", "_a")})
    short = [r for r in df.collect() if len(r.text or "") < 10**6]
    assert rows_of(periodic_runs.report(df), *RUN_COLUMNS) == sorted((expected_runs(r.doc_id, r.text) for r in short), key=repr)
    assert periodic_runs.report(df.limit(0)).collect() == []
    found = periodic_runs.find_runs(df.filter("doc_id = 100")).first()
    assert [tuple(r) for r in found.runs] == [(0, 40, 2)] and found.collapsed == "a b" and found.start == "clash"


def test_likeness_lanes_are_added_in_short_lanes_and_lengths_computed_once(spark):
    """More sentences than a short lane holds, exactly as many, and none give the plain sums (op3)."""
    from pyspark.sql import functions as F

    from vellum.llm import fingerprints as fp

    texts = [None, "", "one", *[" ".join(f"s{i % 50}." for i in range(n)) for n in (30, 31, 32, 62, 63, 400)]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    hashes = F.transform(fp.sentences(F.col("text")), lambda u: F.array(*[F.xxhash64(F.lit("likeness"), F.lit(j), u) for j in range(fp.HASHES)]))
    for r in df.select("doc_id", hashes.alias("h"), fp.fingerprint(F.col("text")).alias("f")).collect():
        one = sum(1 << fp.LANE_BITS * i for i in range(fp.LANES_EACH))
        plain = [sum((h[j] % (1 << 64) >> i) & one for h in r.h) & fp.M60 for j in range(fp.HASHES) for i in range(fp.LANE_BITS)]
        assert r.f[fp.AT - 1 :] == [len(r.h), *plain]
    assert "edited_norm#" in fp.report(df)._jdf.queryExecution().optimizedPlan().toString()
