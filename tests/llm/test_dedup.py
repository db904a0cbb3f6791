import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F
from vellum.llm import near_dup, suffix_dedup

from tests.llm.conftest import rows_of

LEAST = -(1 << 63)


def removed_by_brute_force(rows):
    first = {}
    data = [(LEAST if d is None else d, (t or "").encode()) for d, t in rows]
    for d, b in data:
        for i in range(len(b) - 49):
            w = b[i : i + 50]
            first[w] = min(first.get(w, d), d)
    out = []
    for (doc_id, _), (d, b) in zip(rows, data, strict=True):
        cover = np.zeros(len(b) + 1, bool)
        for i in range(len(b) - 49):
            if first[b[i : i + 50]] < d:
                cover[i : i + 50] = True
        spans = int(np.sum(cover[1:] & ~cover[:-1]) + (cover[0] if len(b) else 0))
        kept = bytes(np.frombuffer(b, np.uint8)[~cover[: len(b)]])
        out.append((doc_id, len(b), int(cover.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def pairs(df):
    """(doc_id, text) of all rows."""
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


COLUMNS = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


@pytest.mark.parametrize("which", ["documents", "odd"])
def test_suffix_dedup_equals_brute_force(which, request):
    df = request.getfixturevalue(which)
    assert rows_of(suffix_dedup.report(df), *COLUMNS) == removed_by_brute_force(pairs(df))


def test_suffix_dedup_of_shifted_and_crossing_passages(spark):
    rnd = np.random.RandomState(3)
    base = "".join(chr(97 + c) for c in rnd.randint(0, 3, 4000))
    rows = [(i, base[a : a + n] + x) for i, (a, n, x) in enumerate((int(rnd.randint(0, 3800)), int(rnd.randint(1, 200)), "".join(chr(100 + c) for c in rnd.randint(0, 3, rnd.randint(0, 60)))) for _ in range(300))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert rows_of(suffix_dedup.report(df), *COLUMNS) == removed_by_brute_force(rows)


def test_suffix_dedup_of_an_empty_table(spark):
    assert suffix_dedup.report(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_levels_grow_geometrically():
    levels = suffix_dedup.Levels()
    for i in range(37):
        keys = np.array([f"{i:02d}{j:03d}" for j in range(100)], "S50")
        assert (levels.scan(keys) == np.iinfo(np.int64).max).all()
        levels.add(keys, np.full(100, i))
    assert len(levels.levels) <= 6
    assert levels.scan(np.array(["07005"], "S50"))[0] == 7


def components_by_brute_force(rows, width=2):
    """(doc_id, set size, component, kept) of each row, sorted."""
    sets = []
    for _, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets.append({tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set())
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and 5 * min(len(a), len(b)) >= 4 * max(len(a), len(b)):
                both = len(a & b)
                if 100 * both >= 80 * (len(a) + len(b) - both):
                    parent[find(i)] = find(j)
    key = [LEAST if d is None else d for d, _ in rows]
    least = {}
    for i in range(len(rows)):
        least[find(i)] = min(least.get(find(i), key[i]), key[i])
    out = [(rows[i][0], len(sets[i]), None if least[find(i)] == LEAST else least[find(i)], key[i] == least[find(i)]) for i in range(len(rows))]
    return sorted(out, key=repr)


NEAR = ("doc_id", "n_shingles", "component_id", "kept")


@pytest.mark.parametrize("which", ["documents", "odd"])
def test_near_duplicates_equal_brute_force(which, request):
    df = request.getfixturevalue(which)
    assert rows_of(near_dup.report(df), *NEAR) == components_by_brute_force(pairs(df))


def test_near_duplicates_in_chains_and_large_groups(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "SMALL", 0)
    rnd = np.random.RandomState(5)
    rows, words = [], [f"w{i}" for i in range(120)]
    for i in range(60):  # copies with a few changed words
        w = list(words)
        for k in rnd.randint(0, 120, rnd.randint(0, 12)):
            w[k] = f"x{rnd.randint(1000)}"
        rows.append((1000 - i, " ".join(w)))
    chain = [f"c{i}" for i in range(200)]
    for i in range(30):  # each is near to the one before only
        rows.append((2000 + i, " ".join(chain)))
        for k in rnd.randint(0, 200, 8):
            chain[k] = f"y{i}-{k}"
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert rows_of(near_dup.report(df), *NEAR) == components_by_brute_force(rows)


def test_near_duplicates_of_an_empty_table(spark):
    assert near_dup.report(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_sketches_tell_unlike_texts_apart(spark):
    """Long texts without a common shingle share one nibble in sixteen."""
    rows = [(i, " ".join(f"w{i}-{k}" for k in range(400)), 0) for i in range(12)]
    df = spark.createDataFrame(rows, "key long, text string, mark long")
    classes = near_dup.map_arrow(df, near_dup._features(2, 3), near_dup.FEATURES).cache()
    pairs = classes.alias("a").join(classes.alias("b"), F.col("a.key") < F.col("b.key"))
    shared = [r.s for r in pairs.select(near_dup.shared_nibbles(F.col("a.sketch"), F.col("b.sketch")).alias("s")).collect()]
    assert max(shared) < 40 < near_dup.LEAST_SHARED


def test_differences_lose_no_pair(spark):
    """Every pair of different labels at the threshold of which one isn't linked with the hub is found by differences."""
    rnd = np.random.RandomState(11)
    base, rows = [f"w{i}" for i in range(150)], []
    for i in range(150):
        w = list(base)
        for k in range(i % 10, 150, 14) if i % 10 < 5 else ():  # versions that the hub isn't near to
            w[k] = f"v{k}"
        for k in rnd.randint(0, 150, rnd.randint(1, 12)):
            w[k] = f"x{k}-{rnd.randint(3)}"
        if i % 3 == 0:
            w = w[rnd.randint(0, 9) :]
        rows.append((i, " ".join(w), 0))
    rows.append((999, " ".join(base), 0))
    texts = spark.createDataFrame(rows, "key long, text string, mark long")
    classes = near_dup.map_arrow(texts, near_dup._features(2, 3), near_dup.FEATURES).cache()
    sets = {near_dup._class_id(s): set(s.tolist()) for s in (near_dup.shingle_set(t) for _, t, _ in rows)}
    hub = near_dup._class_id(near_dup.shingle_set(rows[-1][1]))
    linked = lambda x, y: 100 * len(x & y) >= 80 * len(x | y)
    label = {c: hub if linked(s, sets[hub]) else c for c, s in sets.items()}
    members = spark.createDataFrame([(hub, c, x) for c, x in label.items()], "hub long, cid long, label long")
    found = {(r.a, r.b) for r in near_dup._by_difference(members, classes, texts, 2).collect()}
    expected = {(a, b) for a in sets for b in sets if a < b and hub not in (a, b) and label[a] != label[b] and linked(sets[a], sets[b])}
    assert len(expected) > 20 and expected <= found
    assert len(found) < 2 * len(expected) + 20
