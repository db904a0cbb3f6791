"""Joins of dense vectors by cosine: exact, pruned by pivots, in blocks of matrices.

The indexed vectors, at length 1, are dealt to cells by their nearest pivot, and cells that lie near each other to blocks
of bounded size. A query vector can only meet a cell whose pivot is, in angle, no further away than the cell's radius and the angle of
the least similarity together (the triangle inequality of angles), so nothing is lost and most cells are never
opened where vectors lie in groups. Queries go in blocks of neighbours, once to each block of the index that they can
meet; a pair of blocks is multiplied in one task, and what leaves the task is what the caller asks for: pairs, or each
query's partial sums and best. Neither side is broadcast.

Pivots and radii are the only things that the driver holds; their number grows with the square root of the rows, up
to a bound in bytes.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from vellum.functions.shipping import ship
from vellum.sources.corpus import written_once

ROWS_EACH = 1024
PIVOT_BYTES = 16 << 20
#: A block of the index has at most so many bytes and rows. Queries travel once to each block, so blocks are large; a small index is still so many tasks.
BLOCK_BYTES, BLOCK_ROWS, LEAST_BLOCKS = 4 << 20, 8192, 64
#: Similarities are rounded to four digits; angles are compared with this much room.
ROUNDING, ROOM = 1e-4, 1e-6
BLOCK = "unit int, block int, ids array<long>, n array<long>, x binary"


def cosines_with(few: list[list]) -> Callable:
    """A function of a column of vectors: array<double> of the cosines with each of a few vectors; 0 for a vector of length 0, of another
    length or with a null."""

    @F.arrow_udf("array<double>")
    def cosines(vectors: pa.Array) -> pa.Array:
        out = np.zeros((len(vectors), len(few)))
        lengths = vectors.value_lengths().to_numpy(zero_copy_only=False)
        flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        ends = np.cumsum(lengths)
        whole = np.add.reduceat(np.append(vectors.flatten().is_null().to_numpy(zero_copy_only=False), False).astype(np.int64), ends - lengths) * (lengths > 0) == 0
        for j, y in enumerate(few):
            y = np.array(y, np.float64)
            at = np.flatnonzero((lengths == len(y)) & whole)
            if len(at) and len(y):
                x = flat[(ends - lengths)[at][:, None] + np.arange(len(y))]
                norm = np.sqrt((x * x).sum(1)) * np.sqrt((y * y).sum())
                out[at, j] = np.where(norm == 0, 0.0, (x @ y) / np.where(norm == 0, 1, norm))
        return pa.array(out.tolist(), pa.list_(pa.float64()))

    return cosines


@dataclass(frozen=True)
class Index:
    """Pivots (a row each) and largest angle of each cell, cells in order of their units and where each unit begins there, number
    of blocks of each unit, and the table of blocks."""

    pivots: np.ndarray
    radius: np.ndarray
    order: np.ndarray
    starts: np.ndarray
    n_blocks: np.ndarray
    blocks: DataFrame


def _units(batch: pa.RecordBatch, column: str) -> np.ndarray:
    """The vectors of a batch at length 1; a vector of length 0 stays."""
    values = batch.column(batch.schema.get_field_index(column))
    x = values.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(values), -1)
    norm = np.sqrt((x * x).sum(1, keepdims=True))
    return x / np.where(norm > 0, norm, 1)


def _angle(cosine: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(cosine, -1, 1))


def _whole(vectors: DataFrame, d: int) -> DataFrame:
    n = F.col("_n") if "_n" in vectors.columns else F.lit(1)
    return vectors.filter((F.size("embedding") == d) & ~F.exists("embedding", lambda v: v.isNull() | F.isnan(v.cast("double")))).select(F.col("vec_id").cast("long").alias("id"), "embedding", n.cast("long").alias("n"))


def _grouped_cells(pivots: np.ndarray, rows: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Cells in an order that keeps neighbours together, and the unit of each cell: up to ``most`` rows of cells in a row, or one larger cell."""
    order = np.argsort((pivots @ pivots[: math.isqrt(len(pivots))].T).argmax(1), kind="stable")
    unit, at, held = np.zeros(len(pivots), np.int64), 0, 0
    for c in order:
        if held and held + rows[c] > most:
            at, held = at + 1, 0
        unit[c] = at
        held += rows[c]
    return order, unit


def _blocks(vectors: DataFrame, pivots: np.ndarray, least_blocks: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, DataFrame]:
    """What ``Index`` has beside the pivots. A block is a hash share of its unit, so that no cell is one task."""

    def cells(batches):
        for batch in batches:
            cosine = _units(batch, "embedding") @ pivots.T
            near = cosine.argmax(1) if len(cosine) else np.zeros(0, np.int64)
            angle = _angle(cosine[np.arange(len(near)), near])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near.astype(np.int32)), pa.array(angle)], names=["id", "embedding", "n", "cell", "angle"])

    ship(vectors.sparkSession)
    kind = vectors.schema["embedding"].dataType.simpleString()
    placed = written_once(vectors.mapInArrow(cells, f"id long, embedding {kind}, n long, cell int, angle double"))
    radius, held = np.full(len(pivots), -np.inf), np.zeros(len(pivots), np.int64)
    for r in placed.groupBy("cell").agg(F.max("angle").alias("angle"), F.count(F.lit(1)).alias("n")).collect():  # a row for each pivot
        radius[r.cell], held[r.cell] = r.angle, r.n
    most = max(1, min(BLOCK_ROWS, BLOCK_BYTES // (8 * pivots.shape[1]), math.ceil(held.sum() / least_blocks)))
    order, unit = _grouped_cells(pivots, held, most)
    n_blocks = np.ceil(np.bincount(unit, held) / most).astype(np.int64)
    starts = np.searchsorted(unit[order], np.arange(len(n_blocks)))
    of = lambda values, at: F.element_at(F.from_json(F.lit(str(values.tolist())), "array<long>"), at + 1)
    rows = placed.withColumn("unit", of(unit, F.col("cell")).cast("int"))
    rows = rows.groupBy("unit", F.pmod(F.xxhash64("id", "embedding"), of(n_blocks, F.col("unit"))).cast("int").alias("block")).agg(F.collect_list(F.struct("id", "n", "embedding")).alias("rows"))

    def packed(batches):
        for batch in batches:
            for i, rows in enumerate(batch.column(2)):  # a block at a time: each is up to BLOCK_BYTES
                inner = pa.RecordBatch.from_struct_array(rows.values)
                lists = [pa.array([inner.column(c).to_pylist()], pa.list_(pa.int64())) for c in (0, 1)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), batch.column(1).slice(i, 1), *lists, pa.array([_units(inner, "embedding").tobytes()], pa.binary())], names=["unit", "block", "ids", "n", "x"])

    return radius, order, starts, n_blocks, written_once(rows.mapInArrow(packed, BLOCK))


def build_index(vectors: DataFrame, least_blocks: int = LEAST_BLOCKS) -> Index | None:
    """Index all rows of vectors (vec_id, embedding) of the longest length; others, and those with null or NaN entries, meet
    nothing. None if there is none. Pivots are vectors of smallest hash; which they are changes the work, never the result.
    Each query goes to each block that it can meet, so many queries need fewer of them than ``LEAST_BLOCKS``."""
    head = vectors.agg(F.max(F.size("embedding")).alias("d"), F.count(F.lit(1)).alias("n")).first()
    if not head.n or (head.d or 0) < 1:
        return None
    rows = _whole(vectors, head.d)
    k = max(1, min(math.isqrt(head.n), PIVOT_BYTES // (8 * head.d)))
    found = rows.select("embedding").dropDuplicates().orderBy(F.xxhash64("embedding"), "embedding").limit(k).collect()
    if not found:
        return None
    pivots = np.array([r.embedding for r in found], np.float64)
    norm = np.sqrt((pivots * pivots).sum(1, keepdims=True))
    pivots = pivots / np.where(norm > 0, norm, 1)
    return Index(pivots, *_blocks(rows, pivots, min(least_blocks, LEAST_BLOCKS)))


def block_join(queries: DataFrame, index: Index, score: Callable, schema: str, least: float | None = None, bound: str | None = None, counted: bool = False) -> DataFrame:
    """``score(similarities, query ids, indexed ids)``, columns of ``schema``, for each pair of a query block and a block that it can meet.

    Similarities are a matrix rounded to four digits. A query meets what can reach ``least``, or its own value in the column
    ``bound``; a query block meets a block if one of its members does. With ``counted`` the score gets the counts (``_n``) of
    the indexed vectors, too. ``queries`` has (id, embedding) of the index's length.
    """
    pivots, radius, order, starts = index.pivots, index.radius, index.order, index.starts
    d = pivots.shape[1]
    rows = queries.select("id", "embedding", (F.lit(float(least)) if bound is None else F.col(bound).cast("double")).alias("least"))

    def cells(batches):
        for batch in batches:
            cosine = _units(batch, "embedding") @ pivots.T
            near = cosine.argmax(1) if len(cosine) else np.zeros(0, np.int64)
            room = _angle(batch.column(2).to_numpy(zero_copy_only=False) - ROUNDING)[:, None] + radius[None, :] + ROOM
            meets = np.logical_or.reduceat((_angle(cosine) <= room)[:, order], starts, axis=1)  # an empty cell's radius is less than any angle
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(near.astype(np.int32)), pa.array([np.flatnonzero(m).astype(np.int32) for m in meets], pa.list_(pa.int32()))], names=["id", "embedding", "home", "units"])

    ship(queries.sparkSession)
    kind = queries.schema["embedding"].dataType.simpleString()
    placed = written_once(rows.mapInArrow(cells, f"id long, embedding {kind}, home int, units array<int>"))
    # Neighbours travel together: queries of one cell, split by hash into shares of about the size of a block.
    shares = np.ones(len(pivots), np.int64)
    for r in placed.groupBy("home").agg(F.count(F.lit(1)).alias("n")).collect():  # a row for each pivot
        shares[r.home] = math.ceil(r.n / ROWS_EACH)
    group = F.pmod(F.xxhash64("id", "embedding"), F.element_at(F.from_json(F.lit(str(shares.tolist())), "array<long>"), F.col("home") + 1)).cast("int")
    grouped = placed.groupBy("home", group.alias("share")).agg(F.collect_list(F.struct("id", "embedding")).alias("rows"), F.array_distinct(F.flatten(F.collect_set("units"))).alias("units"))
    blocks_of = F.from_json(F.lit(str(index.n_blocks.tolist())), "array<long>")
    wide = grouped.select("rows", F.explode("units").alias("unit")).select("rows", "unit", F.explode(F.sequence(F.lit(0), F.element_at(blocks_of, F.col("unit") + 1).cast("int") - 1)).alias("block"))
    # By estimate this side may be the smaller one and would be broadcast; it is all queries times the blocks they meet.
    met = wide.join(index.blocks.hint("shuffle_hash"), ["unit", "block"]).select("rows", "ids", "n", "x")

    def products(batches):
        for batch in batches:
            for rows, ids, n, x in zip(*batch.columns, strict=True):
                inner = pa.RecordBatch.from_struct_array(rows.values)
                right = np.frombuffer(x.as_py()).reshape(-1, d)
                left_ids, ids, n = (c.to_numpy(zero_copy_only=False) for c in (inner.column(0), ids.values, n.values))
                for at in range(0, len(left_ids), ROWS_EACH):
                    left = _units(inner.slice(at, ROWS_EACH), "embedding")
                    for to in range(0, len(ids), ROWS_EACH):
                        cosine = np.floor((left @ right[to : to + ROWS_EACH].T) * 1e4 + 0.5) / 1e4
                        out = score(cosine, left_ids[at : at + ROWS_EACH], ids[to : to + ROWS_EACH], *([n[to : to + ROWS_EACH]] if counted else []))
                        if len(out[0]):
                            yield pa.RecordBatch.from_arrays([pa.array(c) for c in out], names=names)

    names = StructType.fromDDL(schema).names
    return met.mapInArrow(products, schema)


def _matches(least: float, same_ids: bool = True) -> Callable:
    """Pairs from ``least`` on; with ``same_ids`` both sides have the ids of one table, and none meets itself."""

    def score(cosine, left, right):
        i, j = np.nonzero((cosine >= least) & ((left[:, None] != right[None, :]) | (not same_ids)))
        return left[i], right[j], cosine[i, j]

    return score


def _best(cosine, left, right):
    """Of each query the largest similarity to another id, and the smallest id that has it."""
    order = np.argsort(right, kind="stable")
    cosine, right = cosine[:, order].copy(), right[order]
    cosine[left[:, None] == right[None, :]] = -np.inf
    at = cosine.argmax(1)
    value = cosine[np.arange(len(left)), at]
    ok = np.isfinite(value)
    return left[ok], right[at][ok], value[ok]


def _linked(least: float) -> Callable:
    """Of each query the number of vectors (by their counts) from ``least`` on with another id, the smallest id of the most similar, and its similarity."""

    def score(cosine, left, right, n):
        hit = (cosine >= least) & (left[:, None] != right[None, :])
        some = hit.any(1)
        found, b, similarity = _best(np.where(hit, cosine, -np.inf)[some], left[some], right)
        return found, hit[some] @ n, b, similarity

    return score


def vector_matches(queries: DataFrame, vectors: DataFrame, least: float) -> DataFrame:
    """a, b, similarity (4 digits) of query vectors (vec_id, embedding) against all vectors, from ``least`` on; a vector isn't
    compared with its own id. A vector of length 0 has similarity 0 to all."""
    index = build_index(vectors)
    if index is None:
        return vectors.sparkSession.createDataFrame([], "a long, b long, similarity double")
    return block_join(_whole(queries, index.pivots.shape[1]), index, _matches(least), "a long, b long, similarity double", least)


def classed(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of keyed vectors (any columns, and embedding) with a digest (``class``) in place of their vector, and each distinct vector
    once: class, vec_id, embedding. Equal vectors meet before they are exchanged."""
    keyed = df.withColumn("class", F.unhex(F.sha2(F.to_json("embedding"), 256)))
    distinct = keyed.groupBy("class").agg(F.first("embedding").alias("embedding")).withColumn("vec_id", F.monotonically_increasing_id())
    return keyed.drop("embedding"), written_once(distinct)


def class_matches(a: tuple[DataFrame, DataFrame], b: tuple[DataFrame, DataFrame], least: float) -> DataFrame:
    """The columns of both tables and similarity of pairs of rows of two tables of classed vectors from ``least`` on. Classes are
    compared, rows are joined to what their classes meet. Their other columns have different names."""
    (left, mine), (right, theirs) = a, b
    index = build_index(theirs, max(1, LEAST_BLOCKS * ROWS_EACH // max(1, mine.count())))
    if index is None:
        pairs = left.sparkSession.createDataFrame([], "a long, b long, similarity double")
    else:
        pairs = written_once(block_join(_whole(mine, index.pivots.shape[1]), index, _matches(least, False), "a long, b long, similarity double", least))
    name = lambda df, x: df.select(F.col("vec_id").alias(x), F.col("class").alias(f"_{x}"))
    pairs = pairs.join(name(mine, "a"), "a").join(name(theirs, "b"), "b").select("_a", "_b", "similarity")
    return left.withColumnRenamed("class", "_a").join(pairs, "_a").join(right.withColumnRenamed("class", "_b"), "_b").drop("_a", "_b")


def keyed_matches(a: DataFrame, b: DataFrame, least: float) -> DataFrame:
    """The columns of both tables but their embeddings, and similarity, of pairs of rows of two tables of keyed vectors (any
    columns, and embedding) from ``least`` on. Their other columns have different names."""
    return class_matches(classed(a), classed(b), least)


def nearest_vector(queries: DataFrame, vectors: DataFrame, least: float = 0.30) -> DataFrame:
    """a, b, similarity, matched: the first vector of largest similarity for each query, and whether it reaches ``least``.

    First a query meets the cells around it alone; what it finds there bounds the cells that it can gain from.
    """
    schema = "a long, b long, similarity double"
    index = build_index(vectors)
    if index is None:
        return vectors.sparkSession.createDataFrame([], f"{schema}, matched boolean")
    rows = _whole(queries, index.pivots.shape[1])

    def fold(df: DataFrame) -> DataFrame:
        best = df.groupBy("a").agg(F.max(F.struct("similarity", (-F.col("b")).alias("b"))).alias("m"))
        return best.select("a", (-F.col("m.b")).alias("b"), F.col("m.similarity").alias("similarity"))

    first = written_once(fold(block_join(rows, index, _best, schema, 0.95)))
    bounded = rows.join(first.select(F.col("a").alias("id"), "similarity"), "id", "left").withColumn("bound", F.coalesce("similarity", F.lit(-1.0)))
    best = fold(first.unionByName(block_join(bounded, index, _best, schema, bound="bound")))
    return best.withColumn("matched", F.col("similarity") >= least)


def vector_links(vectors: DataFrame, least: float) -> DataFrame:
    """vec_id, class_id, n_same, n_links, nearest_id, similarity of every vector against all others.

    Equal vectors are one class (class_id: their smallest id, n_same: how many), and classes are compared once, so a
    group with a third of all rows is one vector. A task sums what a vector links to, so links aren't written out. n_links counts the vectors of other classes from ``least`` on,
    nearest_id is the class of the most similar (of equals the smallest), null without a link. Vectors that can't be
    compared (null, of another length) are classes without links.
    """
    classes = written_once(vectors.groupBy("embedding").agg(F.min("vec_id").alias("vec_id"), F.count(F.lit(1)).alias("n")))
    index = build_index(classes.select("vec_id", "embedding", F.col("n").alias("_n")))
    schema = "a long, n long, b long, similarity double"
    if index is None:
        links = vectors.sparkSession.createDataFrame([], schema)
    else:
        links = block_join(_whole(classes, index.pivots.shape[1]), index, _linked(least), schema, least, counted=True)
    best = links.groupBy("a").agg(F.sum("n").alias("n_links"), F.max(F.struct("similarity", (-F.col("b")).alias("b"))).alias("m"))
    best = best.select(F.col("a").alias("class_id"), "n_links", (-F.col("m.b")).alias("nearest_id"), F.col("m.similarity").alias("similarity"))
    return _members(vectors, classes).join(best, "class_id", "left").na.fill(0, ["n_links"])


def _members(vectors: DataFrame, classes: DataFrame) -> DataFrame:
    """vec_id, class_id, n_same: rows meet their class by the hash of the vector, then by the vector itself; a large class is joined by a broadcast or a split partition."""
    keyed = lambda df: df.withColumn("_h", F.xxhash64("embedding"))
    same = keyed(classes).select(F.col("vec_id").alias("class_id"), F.col("embedding").alias("_e"), "_h", F.col("n").alias("n_same"))
    return keyed(vectors.select("vec_id", "embedding")).join(same, "_h").filter(F.col("embedding").eqNullSafe(F.col("_e"))).select("vec_id", "class_id", "n_same")
