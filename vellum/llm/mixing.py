"""Mixing sources to target weights: a curriculum whose weights change over training.

A source's schedule gives its weight at knots of training time (0 to 1), straight lines between them; its
integral is the source's weight. Weights share out the words of the mix, no source beyond a number of passes
over itself. A source's documents lie in an order by hash, pass after pass, so each word of its share has a
place in its demand; the demand, which grows with the integral of the schedule, is inverted to the time at
which a document is due, and the documents are sorted by that time in ranges.

Everything here is built-in column expressions. Places are sums over buckets of the order by hash and then
within a bucket, so a source of any share of the rows is spread over many tasks.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.llm.common import materialise

WORD = r"[^\x20\x09-\x0D]+"
Knots = Sequence[tuple[float, float]]
#: (time, weight) of the sources by code point, repeating: integrals 5, 2 and 1. The first fades out, the second grows.
CURRICULUM: tuple[Knots, ...] = (((0.0, 7.5), (1.0, 2.5)), ((0.0, 1.0), (1.0, 3.0)), ((0.0, 1.0), (1.0, 1.0)))
SHARE = 1.5
MOST_PASSES = 2
ROWS_EACH = 1000
KNOTS = "array<struct<at:double,weight:double>>"


def numbered(df: DataFrame, order: str, name: str) -> DataFrame:
    """Add ``name``, the place from 0 of each row by the distinct values of ``order``: rows of earlier ranges, then the place in its own."""
    ranged = materialise(df.repartitionByRange(order), "ranged").withColumn("_range", F.regexp_extract("_metadata.file_name", r"part-(\d+)", 1).cast("int"))
    before = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))  # a row for each range
    before = before.select("_range", F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    place = F.row_number().over(Window.partitionBy("_range").orderBy(order)) - 1
    return ranged.join(before, "_range").withColumn(name, F.col("_before") + place).drop("_range", "_before")


def integrated(knots: Column) -> Column:
    """array<struct<at, weight, area>>: knots with the integral up to each."""
    point = lambda at, weight, area: F.struct(at.alias("at"), weight.alias("weight"), area.alias("area"))

    def step(acc: Column, k: Column) -> Column:
        last = F.element_at(acc, -1)
        return F.concat(acc, F.array(point(k["at"], k["weight"], last["area"] + (k["at"] - last["at"]) * (k["weight"] + last["weight"]) / 2)))

    first = F.element_at(knots, 1)
    return F.aggregate(F.slice(knots, F.lit(2), F.size(knots)), F.array(point(first["at"], first["weight"], F.lit(0.0))), step)


def due(knots: Column, area: Column) -> Column:
    """The time at which the integral of integrated ``knots`` reaches ``area``."""
    passed = F.greatest(F.size(F.filter(knots, lambda k: k["area"] <= area)), F.lit(1))
    a, b = F.element_at(knots, passed), F.element_at(knots, F.least(passed + 1, F.size(knots)))
    rest = F.greatest(area - a["area"], F.lit(0.0))
    slope = F.coalesce(F.try_divide(b["weight"] - a["weight"], b["at"] - a["at"]), F.lit(0.0))
    speed = a["weight"] + F.sqrt(F.greatest(a["weight"] * a["weight"] + 2 * slope * rest, F.lit(0.0)))
    return a["at"] + F.coalesce(F.try_divide(2 * rest, speed), F.lit(0.0))


def settled(sources: DataFrame, share: float, passes: int) -> DataFrame:
    """Add target: ``share`` of all words by weight; a target stops at ``passes`` times its source, the others take the excess.

    The words for each unit of weight rise until no further source is full; each round is one sum over sources.
    """
    cap = (F.col("source_size") * passes).cast("double")
    level, full_before = 0.0, -1
    while True:
        full = cap <= F.col("weight") * level
        r = sources.agg(
            F.coalesce(F.sum("source_size"), F.lit(0)).alias("total"), F.coalesce(F.sum(F.when(full, cap)), F.lit(0.0)).alias("taken"),
            F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0.0)).alias("weight"), F.count_if(full).alias("full"),
        ).first()
        if r.weight <= 0:
            level = math.inf
            break
        if r.full == full_before:
            break
        level, full_before = (share * r.total - r.taken) / r.weight, r.full
    asked = F.when(F.col("weight") > 0, cap if level == math.inf else F.least(cap, F.col("weight") * level))
    return sources.withColumn("target", F.coalesce(asked, F.lit(0.0)))


def assign(docs: DataFrame, schedules: Sequence[Knots] = CURRICULUM, own: DataFrame | None = None, share: float = SHARE, passes: int = MOST_PASSES, kept: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Each row's part in the mix: the columns ``kept``, and ``mix``, a struct of source_key, bucket, place (together the row's
    key), size, source_size, target, before (words of its source before it) and knots.

    ``docs`` has doc_id, text and source. ``own`` (source, knots) gives sources schedules of their own. A null text has no words,
    a null source is one source, after all others. Rows of one source are ordered by the hash of doc_id and text; rows equal in
    both are interchangeable. Every row stays, repeated ones too; an empty table gives an empty one.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    source_key = F.when(F.col("source").isNull(), "1").otherwise(F.concat(F.lit("0"), F.col("source").cast("string")))  # nulls last, strings by code point
    order = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), text))
    rows = docs.select(F.struct(*[F.col(c) for c in kept]).alias("kept"), source_key.alias("source_key"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"), order.alias("order"))
    rows = materialise(rows, "sized")
    buckets = max(1, math.ceil(rows.count() / ROWS_EACH))
    rows = rows.withColumn("bucket", F.floor(F.conv(F.substring("order", 1, 8), 16, 10).cast("long") * F.lit(buckets) / F.lit(2.0**32)))
    sums = materialise(rows.groupBy("source_key", "bucket").agg(F.sum("size").alias("size")), "buckets")
    sources = numbered(sums.groupBy("source_key").agg(F.sum("size").alias("source_size")), "source_key", "n")
    cycle = F.array(*[F.array(*[F.struct(F.lit(float(t)).alias("at"), F.lit(float(w)).alias("weight")) for t, w in knots]) for knots in schedules])
    knots = F.element_at(cycle, (F.col("n") % len(schedules)).cast("int") + 1)
    if own is not None:
        named = own.select(F.when(F.col("source").isNull(), "1").otherwise(F.concat(F.lit("0"), F.col("source"))).alias("source_key"), F.col("knots").cast(KNOTS).alias("own_knots"))
        sources, knots = sources.join(named.dropDuplicates(["source_key"]), "source_key", "left"), F.coalesce("own_knots", knots)
    sources = sources.select("source_key", "source_size", integrated(knots).alias("knots")).withColumn("weight", F.element_at("knots", -1)["area"])
    sources = settled(materialise(sources, "sources"), share, passes)
    earlier = F.sum("size").over(Window.partitionBy("source_key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    sums = sums.select("source_key", "bucket", F.coalesce(earlier, F.lit(0)).alias("bucket_before")).join(sources.drop("weight"), "source_key")
    within = Window.partitionBy("source_key", "bucket").orderBy("order")
    mix = {
        "source_key": "source_key", "bucket": "bucket", "place": F.row_number().over(within), "size": "size", "source_size": "source_size", "target": "target",
        "before": F.col("bucket_before") + F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"), "knots": "knots",
    }
    return rows.join(sums, ["source_key", "bucket"]).select("kept.*", F.struct(*[(F.col(c) if isinstance(c, str) else c).alias(k) for k, c in mix.items()]).alias("mix"))


def in_training_order(assigned: DataFrame) -> DataFrame:
    """The mix, sorted by position in ranges: the columns of ``assigned`` with epoch (pass over its source, from 0), words (so
    many of the row's first words count) and position (time in training, 0 to 1). Of the last row of a share only a part counts.
    """
    m = F.col("mix")
    whole = F.floor(m["target"] + 0.5).cast("long")
    last = F.greatest(F.ceil(F.coalesce(F.try_divide(whole, m["source_size"]), F.lit(0.0))).cast("int") - 1, F.lit(0))
    rows = assigned.select("*", F.explode(F.sequence(F.lit(0), last)).alias("epoch"))
    start = F.col("epoch") * m["source_size"] + m["before"]
    rows = rows.withColumn("words", F.greatest(F.least(m["size"], whole - start), F.lit(0).cast("long"))).filter("words > 0")
    area = (start + F.col("words") / 2) / whole * F.element_at(m["knots"], -1)["area"]
    rows = rows.withColumn("position", due(m["knots"], area))
    order = ["position", "mix.source_key", "epoch", "mix.bucket", "mix.place"]
    return rows.repartitionByRange(*order).sortWithinPartitions(*order)


def report(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken of every row; taken is what the written mix has of it. Columns but doc_id, text
    and source are left out."""
    assigned = materialise(assign(docs), "assigned")
    mixed = materialise(in_training_order(assigned), "mix")
    key = ["source_key", "bucket", "place"]
    taken = mixed.groupBy(*[F.col(f"mix.{k}").alias(k) for k in key]).agg(F.sum("words").alias("taken"))
    rows = assigned.select("doc_id", *[f"mix.{k}" for k in (*key, "size", "source_size", "target")]).join(taken, key, "left")
    return rows.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"))
