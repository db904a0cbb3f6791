"""MinHash near-dedup: a chosen-path set similarity join on two-word shingles, then components.

Documents with one set of shingles are a class and go on as one. Each class has 128 minwise tokens.
In each of ``TREES`` independent trees a class follows paths: at every node the node's own hash
chooses one or, in one node of four, two of the token places, and the tokens there name the children.
On average 1.25 paths go on, so a pair of similarity 0.8 is expected to share a path at every depth.
The first levels, in which nodes hold too much to be compared, are walked at once; their number
follows the logarithm of the number of classes.

Comparing costs no more than it must: a node first links its members to a hub (the member that
shares most nodes with others), which is linear in the node. What is still apart is then compared:
members outside a node's largest component with all members of other components. Nodes of at most
``SMALL`` members are compared exhaustively, so the work is linear in the number of nodes. In
larger ones members are described by how they differ from the hub. A stray isn't linked with the hub,
so whatever it is linked with shares more than about half of its own differences with the stray; an
index of as many differences as must hold a shared one, those that the hub lacks first, gives all
such pairs, however large the node. Pairs are screened by set size (exact) and by a sketch of the
minwise tokens, with a margin of 4.5 standard deviations, and links are confirmed on full sets.

A pair at the threshold shares no node of a tree with probability 0.48 at depth 5 and 0.56 at depth 7,
and of all trees with 8e-8 to 3e-6. The sketch drops it with 9e-6.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellum.llm.common import map_arrow, materialise

SHINGLE = 2
THRESHOLD = (80, 100)
TOKENS = 128
TREES = 22
SMALL = 48
NIBBLES = TOKENS // 16
#: Nibbles that a pair at the threshold shares, less 4.5 standard deviations.
LEAST_SHARED = 84
#: Stands for a null doc_id.
NO_ID = -(1 << 63)
_WORDS = bytes(b + 32 if 0x41 <= b <= 0x5A else 0x20 if b == 0x20 or 0x09 <= b <= 0x0D else b for b in range(256))
_random = np.random.RandomState(7)
_FACTORS = _random.randint(1, 1 << 31, TOKENS, dtype=np.int64).astype(np.uint32) * np.uint32(2) + np.uint32(1)
_SHIFTS = _random.randint(0, 1 << 31, TOKENS, dtype=np.int64).astype(np.uint32)
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _GOLD
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def shingle_set(text: str | None, width: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles: runs of ``width`` words, or all words if there are fewer."""
    words = (text or "").encode().translate(_WORDS).split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = max(1, len(h) - width + 1)
    out = np.zeros(n, np.uint64)
    for j in range(min(width, len(h))):
        out = _mix(out ^ h[j : j + n]) + np.uint64(j + 1)
    return np.unique(out)


def minwise(shingles: np.ndarray) -> np.ndarray:
    """The minwise tokens of a set of hashes."""
    low = (shingles >> np.uint64(32)).astype(np.uint32)
    out = np.full(TOKENS, 0xFFFFFFFF, np.uint32)
    for a in range(0, len(low), 4096):
        x = _FACTORS[:, None] * low[None, a : a + 4096]
        x ^= x >> np.uint32(15)
        x *= np.uint32(0x85EBCA6B)
        x ^= _SHIFTS[:, None]
        out = np.minimum(out, x.min(axis=1))
    return out


def walk(tokens: np.ndarray, depth: int, trees: int = TREES) -> tuple[np.ndarray, np.ndarray]:
    """(row, node) of all paths of the given depth, for a matrix of minwise tokens."""
    rows = np.repeat(np.arange(len(tokens)), trees)
    nodes = np.tile(_mix(np.arange(1, trees + 1, dtype=np.uint64)), len(tokens))
    for level in range(depth):
        a, b = _mix(nodes + np.uint64(2 * level + 1)), _mix(nodes + np.uint64(2 * level + 2))
        two = np.flatnonzero(b % np.uint64(4) == 0)
        first, second = (a % np.uint64(TOKENS)).astype(np.int64), ((a >> np.uint64(20)) % np.uint64(TOKENS)).astype(np.int64)
        rows2, at = np.concatenate([rows, rows[two]]), np.concatenate([first, second[two]])
        parents = np.concatenate([nodes, nodes[two]])
        nodes = _mix(_mix(parents ^ (at.astype(np.uint64) + np.uint64(1)) * _GOLD) ^ tokens[rows2, at].astype(np.uint64))
        rows = rows2
    return rows, nodes


FEATURES = T.StructType([T.StructField("key", T.LongType()), T.StructField("mark", T.LongType()), T.StructField("n", T.IntegerType()), T.StructField("cid", T.LongType()), T.StructField("sketch", T.ArrayType(T.LongType())), T.StructField("nodes", T.ArrayType(T.LongType()))])
_FEATURES = pa.schema([("key", pa.int64()), ("mark", pa.int64()), ("n", pa.int32()), ("cid", pa.int64()), ("sketch", pa.list_(pa.int64())), ("nodes", pa.list_(pa.int64()))])


def _class_id(s: np.ndarray) -> int:
    """A 64-bit name of a set."""
    return xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63)


def _features(width: int, depth: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                batch = whole.slice(at, 2000)
                sets = [shingle_set(t, width) for t in batch.column(1).to_pylist()]
                full = [i for i, s in enumerate(sets) if len(s)]
                tokens = np.stack([minwise(sets[i]) for i in full]) if full else np.empty((0, TOKENS), np.uint32)
                nibbles = (_mix(tokens.astype(np.uint64)) & np.uint64(15)).reshape(-1, NIBBLES, 16)
                packed = (nibbles << (np.arange(16, dtype=np.uint64) * np.uint64(4))).sum(axis=2, dtype=np.uint64).view(np.int64)
                rows, nodes = walk(tokens, depth)
                order = np.argsort(rows, kind="stable")
                parts = np.split(nodes[order].view(np.int64), np.searchsorted(rows[order], np.arange(1, len(full)))) if full else []
                place = {i: j for j, i in enumerate(full)}
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0), batch.column(2), pa.array([len(s) for s in sets], pa.int32()), pa.array([_class_id(s) if len(s) else None for s in sets], pa.int64()),
                        pa.array([packed[place[i]] if i in place else None for i in range(len(sets))], pa.list_(pa.int64())), pa.array([np.unique(parts[place[i]]) if i in place else None for i in range(len(sets))], pa.list_(pa.int64())),
                    ],
                    schema=_FEATURES,
                )

    return run


def shared_nibbles(a: Column, b: Column) -> Column:
    """Minwise tokens on which two sketches agree."""
    total = F.lit(TOKENS)
    for i in range(NIBBLES):
        x = a[i].bitwiseXOR(b[i])
        x = x.bitwiseOR(F.shiftrightunsigned(x, 1))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 2)).bitwiseAND(F.lit(0x1111111111111111))
        total = total - F.bit_count(x)
    return total


def _sizes_fit(a: Column, b: Column) -> Column:
    """Sets of such sizes can reach the threshold."""
    return THRESHOLD[1] * F.least(a, b) >= THRESHOLD[0] * F.greatest(a, b)


def _full_sets(cids: DataFrame, classes: DataFrame, texts: DataFrame, width: int, name: str) -> DataFrame:
    """(cid, members): the whole sets of some classes, written."""
    needed = cids.distinct().join(classes.select("cid", "key"), "cid")
    chosen = texts.join(needed.select("key").distinct(), "key", "left_semi")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingle_set(t, width) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([_class_id(s) if len(s) else None for s in found], pa.int64()), pa.array([s.tobytes() for s in found], pa.binary())], names=["cid", "members"])

    return materialise(map_arrow(chosen, sets, "cid long, members binary").dropDuplicates(["cid"]), f"{name}-sets")


def _confirm(pairs: DataFrame, classes: DataFrame, texts: DataFrame, width: int, name: str) -> DataFrame:
    """The pairs (a, b) that are links: screened by sketch, then confirmed on full sets."""
    side = lambda c: classes.select(F.col("cid").alias(c), F.col("sketch").alias(f"sketch_{c}"))
    near = pairs.join(side("a"), "a").join(side("b"), "b").filter(shared_nibbles(F.col("sketch_a"), F.col("sketch_b")) >= LEAST_SHARED).select("a", "b")
    near = materialise(near, f"{name}-near")
    full = _full_sets(near.select(F.col("a").alias("cid")).union(near.select(F.col("b").alias("cid"))), classes, texts, width, name)
    both = near.join(full.select(F.col("cid").alias("a"), F.col("members").alias("set_a")), "a").join(full.select(F.col("cid").alias("b"), F.col("members").alias("set_b")), "b").select("a", "b", "set_a", "set_b")

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(THRESHOLD[1] * both >= THRESHOLD[0] * (len(x) + len(y) - both))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], names=["a", "b"])

    return materialise(map_arrow(both, link, "a long, b long"), f"{name}-links")


def components(links: DataFrame) -> DataFrame:
    """(cid, label): the smallest vertex that each vertex of a link reaches.

    Labels pass along links and are then followed, so that the number of rounds grows with the
    logarithm of the longest path. Each round's table is written.
    """
    both = links.select(F.explode(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v")))).alias("e")).select("e.u", "e.v").distinct()
    both = materialise(both, "edges")
    labels = materialise(both.groupBy(F.col("u").alias("cid")).agg(F.least(F.first("u"), F.min("v")).alias("label")), "labels")
    for _ in count():
        heard = both.join(labels.select(F.col("cid").alias("v"), F.col("label").alias("l")), "v").groupBy(F.col("u").alias("cid")).agg(F.min("l").alias("heard"))
        less = labels.join(heard, "cid", "left").select("cid", F.col("label").alias("was"), F.least("label", F.coalesce("heard", "label")).alias("label"))
        onward = labels.select(F.col("cid").alias("label"), F.col("label").alias("next"))
        new = materialise(less.join(onward, "label", "left").select("cid", "was", F.least("label", F.coalesce("next", "label")).alias("label")), "labels")
        labels = new.select("cid", "label")
        if not new.filter("was <> label").head(1):
            return labels


def row_id() -> list[Column]:
    """key (doc_id, or NO_ID) and mark (the text's hash), which tell the documents of a table apart."""
    return [F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("key"), F.xxhash64(F.col("text").cast("string")).alias("mark")]


def _groups(docs: DataFrame, width: int, trees: int) -> tuple[DataFrame, DataFrame]:
    """The features of every row, and (cid, row, label) of every class: row is its smallest (key, mark), and classes of
    one label are near copies."""
    key, mark = row_id()
    texts = docs.select(key, F.col("text").cast("string").alias("text"), mark)
    rows = texts.count()
    depth = min(12, max(3, math.ceil(math.log(max(rows, 2)) / 2.5)))
    features = materialise(map_arrow(texts, _features(width, depth), FEATURES), "features")
    classes = features.filter("n > 0").groupBy("cid").agg(F.min("key").alias("key"), F.min(F.struct("key", "mark")).alias("row"), F.first("n").alias("n"), F.first("sketch").alias("sketch"), F.first("nodes").alias("nodes"))
    classes = materialise(classes, "classes")

    placed = classes.select("cid", F.explode("nodes").alias("node"))
    shared = placed.groupBy("node").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    leaves = materialise(placed.join(shared, "node"), "leaves")
    # A hub for each node, and the pairs of its other members with it.
    weight = leaves.groupBy("cid").agg(F.sum("size").alias("weight")).join(classes.select("cid", "n"), "cid")
    weighed = leaves.join(weight, "cid")
    hubs = materialise(weighed.groupBy("node").agg(F.max(F.struct("weight", "cid", "n")).alias("hub")), "hubs")
    stars = weighed.join(hubs, "node").filter(F.col("cid") != F.col("hub.cid")).filter(_sizes_fit(F.col("n"), F.col("hub.n")))
    stars = materialise(stars.select(F.least("cid", "hub.cid").alias("a"), F.greatest("cid", "hub.cid").alias("b")).distinct(), "stars")
    links = _confirm(stars, classes, texts, width, "stars")
    labels = components(links)

    # What is still apart: nodes with members of several components.
    named = classes.select("cid", "n").join(labels, "cid", "left").select("cid", "n", F.coalesce("label", "cid").alias("label"))
    named = materialise(named, "named")
    rest = _mixed_nodes(leaves.select("node", "cid"), named)
    small = F.col("size") <= SMALL
    found = _across(rest.filter(small), classes)
    large = rest.filter(~small).join(hubs.select("node", F.col("hub.cid").alias("hub")), "node").select("hub", "cid", "label").distinct()
    large = materialise(large, "large")
    if large.head(1):
        found = found.union(_by_difference(large, classes, texts, width))
    apart = materialise(found.distinct().join(stars, ["a", "b"], "left_anti"), "apart")
    more = _confirm(apart, classes, texts, width, "apart")
    if more.head(1):
        labels = components(links.union(more))
    return features, classes.select("cid", "row").join(labels, "cid", "left").select("cid", "row", F.coalesce("label", "cid").alias("label"))


def near_duplicates(docs: DataFrame, width: int = SHINGLE, trees: int = TREES) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable), kept, for every row of ``docs``.

    A null or empty text has no shingles and is linked with nothing. A null doc_id is the smallest.
    Rows of one doc_id with different texts are documents of their own, whose components carry that id.
    """
    features, named = _groups(docs, width, trees)
    least = named.groupBy("label").agg(F.min("row.key").alias("component"))
    of_class = named.join(least, "label").select("cid", "component")
    null_if_no_id = lambda c: F.when(c != NO_ID, c)
    found = features.select("key", "n", "cid").join(of_class, "cid", "left")
    component = F.coalesce("component", "key")
    return found.select(null_if_no_id(F.col("key")).alias("doc_id"), F.col("n").cast("long").alias("n_shingles"), null_if_no_id(component).alias("component_id"), (F.col("key") == component).alias("kept"))


def one_of_each(docs: DataFrame, width: int = SHINGLE, trees: int = TREES) -> DataFrame:
    """The row ids (key, mark) that stay: the smallest of each group of near copies, and all without shingles."""
    features, named = _groups(docs, width, trees)
    smallest = named.groupBy("label").agg(F.min("row").alias("row")).select("row.key", "row.mark")
    return smallest.union(features.filter("n = 0").select("key", "mark").distinct())


def _mixed_nodes(rows: DataFrame, named: DataFrame) -> DataFrame:
    """(node, cid, n, label, main, size) of the nodes whose members are in several components: main is the label of
    the largest, size the number of all members."""
    rows = rows.join(named, "cid")
    parts = rows.groupBy("node", "label").agg(F.count(F.lit(1)).alias("c"))
    mixed = parts.groupBy("node").agg(F.max(F.struct("c", "label")).alias("m"), F.sum("c").alias("size")).filter("size > m.c")
    return materialise(rows.join(mixed.select("node", F.col("m.label").alias("main"), "size"), "node"), "mixed")


def _across(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs of a node's members in different components that sizes and sketches don't rule out: those outside the largest with all others."""
    rows = rows.join(classes.select("cid", "sketch"), "cid")
    side = lambda df, c: df.select("node", F.col("cid").alias(c), F.col("n").alias(f"n_{c}"), F.col("label").alias(f"label_{c}"), F.col("sketch").alias(f"sketch_{c}"), "main")
    a, b = side(rows.filter("label <> main"), "a").drop("main"), side(rows, "b")
    once = (F.col("label_b") == F.col("main")) | (F.col("a") < F.col("b"))
    near = shared_nibbles(F.col("sketch_a"), F.col("sketch_b")) >= LEAST_SHARED
    rule = (a["node"] == b["node"]) & (F.col("label_a") != F.col("label_b")) & once & _sizes_fit(F.col("n_a"), F.col("n_b")) & near
    return a.join(b, rule).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


DIFFERENCES = "hub long, cid long, label long, n int, stray boolean, parts array<long>, n_parts int, bits array<long>, slack int"
BITS = 512


def _by_difference(rows: DataFrame, classes: DataFrame, texts: DataFrame, width: int) -> DataFrame:
    """Pairs of different components among the members (hub, cid, label) of each hub that can be links.

    With D(x) the symmetric difference of x and the hub, the sets x and m are linked if |D(x)| + |D(m)| - 2 |D(x) & D(m)|
    is at most (|x| + |m|) / 9. For a stray |D(x)| > (|x| + |hub|) / 9, hence 2 |D(x) & D(m)| > |D(m)| + (|hub| - |m|) / 9.
    In any common order of differences, the first |D| - least overlap + 1 of both then have one in common. Pairs that do
    are screened, without loss, by what their differences can have in common at most: the shared bits of two bitmaps, and
    as many differences as have no bit of their own.
    """
    gap, total = THRESHOLD[1] - THRESHOLD[0], THRESHOLD[1] + THRESHOLD[0]
    full = _full_sets(rows.select("cid").union(rows.select(F.col("hub").alias("cid"))), classes, texts, width, "large")
    both = rows.join(full, "cid").join(full.select(F.col("cid").alias("hub"), F.col("members").alias("of_hub")), "hub").filter("cid <> hub")

    def differ(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, strays, parts, counts, bits = [], [], [], [], []
            for x, h in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True):
                x, h = np.frombuffer(x, np.uint64), np.frombuffer(h, np.uint64)
                d = np.concatenate([np.setdiff1d(x, h, assume_unique=True), np.setdiff1d(h, x, assume_unique=True)])
                stray = total * len(d) > gap * (len(x) + len(h))
                overlap = (total * len(d) + gap * (len(h) - len(x))) // (2 * total) + 1
                if stray:  # its partners are of limited size, and their differences hold the overlap
                    overlap = max(overlap, len(d) - gap * (len(x) + len(x) * THRESHOLD[1] // THRESHOLD[0]) // total)
                sizes.append(len(x))
                strays.append(stray)
                parts.append(d[: max(0, len(d) - overlap + 1)].view(np.int64))
                mask = np.zeros(BITS, bool)
                mask[(d % np.uint64(BITS)).astype(np.int64)] = True
                counts.append((len(d), len(d) - int(mask.sum())))
                bits.append(np.packbits(mask).view(np.int64))
            columns = [pa.array(sizes, pa.int32()), pa.array(strays, pa.bool_()), pa.array(parts, pa.list_(pa.int64())), pa.array([c for c, _ in counts], pa.int32()), pa.array(bits, pa.list_(pa.int64())), pa.array([c for _, c in counts], pa.int32())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *columns], names=["hub", "cid", "label", "n", "stray", "parts", "n_parts", "bits", "slack"])

    told = materialise(map_arrow(both.select("hub", "cid", "label", "members", "of_hub"), differ, DIFFERENCES), "differences")
    listed = told.select("hub", "cid", "label", "n", "stray", "n_parts", "bits", "slack", F.explode("parts").alias("part"))
    shared = listed.groupBy("hub", "part").agg(F.min("label").alias("least"), F.max("label").alias("most"), F.max("stray").alias("any")).filter("least < most and any").select("hub", "part")
    listed = materialise(listed.join(shared, ["hub", "part"]), "shared")
    side = lambda df, c: df.select("hub", "part", F.col("cid").alias(c), *[F.col(x).alias(f"{x}_{c}") for x in ("n", "label", "stray", "n_parts", "bits", "slack")])
    a, b = side(listed.filter("stray"), "a"), side(listed, "b")
    shared = F.least("slack_a", "slack_b")
    for i in range(BITS // 64):
        shared = shared + F.bit_count(F.col("bits_a")[i].bitwiseAND(F.col("bits_b")[i]))
    near = total * (F.col("n_parts_a") + F.col("n_parts_b") - 2 * shared) <= gap * (F.col("n_a") + F.col("n_b"))
    rule = (a["hub"] == b["hub"]) & (a["part"] == b["part"]) & (F.col("label_a") != F.col("label_b")) & (~F.col("stray_b") | (F.col("a") < F.col("b"))) & _sizes_fit(F.col("n_a"), F.col("n_b")) & near
    return a.join(b, rule).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row of ``docs``, as ``near_duplicates`` gives them."""
    return near_duplicates(docs.select("doc_id", "text"))
