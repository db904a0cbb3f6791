"""Document fingerprints: homomorphic multiset hashes of paragraphs.

A fingerprint is a vector of sums of hashes. The identity lanes add wide hashes of the
paragraphs (lines) modulo 2^60; the likeness lanes add, modulo 2^15, single hash bits of the
paragraphs' sentences, four lanes packed into one integer. Sums don't depend on order, so
equal multisets of paragraphs have equal fingerprints, and adding or removing a paragraph
adds or subtracts its own vector. The difference of two fingerprints' likeness lanes, taken
as sums of signs, has a mean square equal to the size of the multisets' difference (the sum of
squared multiplicities). With 720 lanes its standard error is 0.053 of that.

Everything here is built-in column expressions.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.llm.common import as_documents

IDENTITY_LANES = 4
HASHES = 12
LANE_BITS = 15
LANES_EACH = 4
PACKED = HASHES * LANE_BITS
M60 = (1 << 60) - 1
LANE_MASK = (1 << LANE_BITS) - 1
#: Short lanes, of which a full one is a whole number, and the sentences that they hold.
SHORT_BITS = 5
SHORT_EACH = (1 << SHORT_BITS) - 1
SENTENCE_END = r"\n+|(?<=[.!?])\s+"
ROWS_EACH = 1500
MOST_BUCKETS = 2048


def paragraphs(text: Column) -> Column:
    """The non-blank lines of a text, without white space at their ends; none for a null text."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.trim(x)), lambda x: x != "")


def sentences(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), SENTENCE_END), lambda x: F.trim(x) != "")


def _sum(units: Column, vector, width: int) -> Column:
    """Lane by lane sums modulo 2^60 of each unit's vector, with the number of units in front."""
    zero = F.array_repeat(F.lit(0).cast("long"), width + 1)
    return F.aggregate(units, zero, lambda acc, u: F.zip_with(acc, F.array(F.lit(1).cast("long"), *vector(u)), lambda a, b: (a + b).bitwiseAND(F.lit(M60))))


def _bound(x: Column, make) -> Column:
    """``make`` of a value that is computed once, however often it is used."""
    return F.element_at(F.transform(F.array(x), make), 1)


def _packed(hashes: Column) -> Column:
    """Packed sums modulo 2^60 of each sentence's hash bits: first of up to ``SHORT_EACH`` sentences in short lanes of
    ``SHORT_BITS``, three times as many to an integer, whose sums are then added as lanes of full width."""
    short = sum(1 << i for i in range(0, LANES_EACH * LANE_BITS, SHORT_BITS))
    wide = sum(SHORT_EACH << LANE_BITS * i for i in range(LANES_EACH))
    zero = lambda n: F.array_repeat(F.lit(0).cast("long"), n)
    bits = lambda h: F.array(*[F.shiftrightunsigned(h[j], i).bitwiseAND(F.lit(short)) for j in range(HASHES) for i in range(SHORT_BITS)])
    some = lambda b: F.aggregate(F.slice(hashes, b * SHORT_EACH + 1, SHORT_EACH), zero(HASHES * SHORT_BITS), lambda acc, h: F.zip_with(acc, bits(h), lambda x, y: x + y))
    full = lambda s: F.array(*[F.shiftrightunsigned(s[j * SHORT_BITS + i % SHORT_BITS], i - i % SHORT_BITS).bitwiseAND(F.lit(wide)) for j in range(HASHES) for i in range(LANE_BITS)])
    blocks = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.size(hashes) / SHORT_EACH).cast("int") - 1)), some)
    return F.aggregate(blocks, zero(PACKED), lambda acc, s: F.zip_with(acc, full(s), lambda x, y: (x + y).bitwiseAND(F.lit(M60))))


def fingerprint(text: Column) -> Column:
    """array<bigint>: paragraphs, identity lanes, sentences, packed likeness lanes."""
    identity = _sum(paragraphs(text), lambda u: [F.xxhash64(F.lit(seed), u).bitwiseAND(F.lit(M60)) for seed in range(IDENTITY_LANES)], IDENTITY_LANES)
    bits = F.transform(sentences(text), lambda u: F.array(*[F.xxhash64(F.lit("likeness"), F.lit(j), u) for j in range(HASHES)]))
    return F.concat(identity, _bound(bits, lambda hashes: F.concat(F.array(F.size(hashes).cast("long")), _packed(hashes))))


def combine(a: Column, b: Column, sign: int = 1) -> Column:
    """Fingerprint of the union of two multisets of paragraphs, or with sign -1 of what is left without the second."""
    return F.zip_with(a, b, lambda x, y: F.pmod(x + sign * y, F.lit(M60 + 1)))


def as_text(fp: Column) -> Column:
    """Lower-case hexadecimal, 15 digits for each integer."""
    return F.array_join(F.transform(fp, lambda x: F.lpad(F.lower(F.hex(x)), 15, "0")), "")


AT = IDENTITY_LANES + 2


def _square(packed: Column, n: Column) -> Column:
    """Sum of the squares of packed lanes as sums of signs: twice the sum of bits less the number of sentences, modulo 2^15."""
    half = 1 << LANE_BITS - 1

    def added(gap: Column) -> Column:
        signs = lambda x: F.array(*[(F.shiftrightunsigned(x, LANE_BITS * i) * 2 + gap).bitwiseAND(F.lit(LANE_MASK)) - half for i in range(LANES_EACH)])
        return F.aggregate(packed, F.lit(0).cast("long"), lambda acc, x: F.aggregate(signs(x), acc, lambda total, d: total + d * d))

    return _bound(half - n, added).cast("double")


def norm(fp: Column) -> Column:
    """Squared length of a fingerprint's likeness lanes as sums of signs."""
    return _square(F.slice(fp, AT + 1, PACKED), F.element_at(fp, AT))


def _gap(a: Column, b: Column) -> Column:
    """Squared distance of two fingerprints' likeness lanes, subtracted one by one, so that no lane borrows from another."""
    half = 1 << LANE_BITS - 1
    lane = lambda x, y, i, gap: ((F.shiftrightunsigned(x, LANE_BITS * i) - F.shiftrightunsigned(y, LANE_BITS * i)) * 2 + gap).bitwiseAND(F.lit(LANE_MASK)) - half
    squares = lambda gap: F.zip_with(F.slice(a, AT + 1, PACKED), F.slice(b, AT + 1, PACKED), lambda x, y: F.aggregate(F.array(*[lane(x, y, i, gap) for i in range(LANES_EACH)]), F.lit(0).cast("long"), lambda total, d: total + d * d))
    return _bound(half - (F.element_at(a, AT) - F.element_at(b, AT)), lambda gap: F.aggregate(squares(gap), F.lit(0).cast("long"), lambda total, d: total + d)).cast("double")


def likeness(a: Column, b: Column, norm_a: Column | None = None, norm_b: Column | None = None) -> Column:
    """1 - |a - b|^2 / (|a|^2 + |b|^2) of the likeness lanes as sums of signs, from 0 to 1; 1 for equal fingerprints.

    For multisets without repeated sentences that is 1 - (size of the difference) / (size of both); squares of both kinds
    grow alike where sentences repeat. Norms that are columns already aren't computed again.
    """
    both = (norm(a) if norm_a is None else norm_a) + (norm(b) if norm_b is None else norm_b)
    return F.when(a == b, 1.0).when(both == 0, 0.0).otherwise(F.greatest(F.lit(0.0), 1 - F.try_divide(_gap(a, b), both)))


def with_next(docs: DataFrame, columns: list[str], made: dict[str, Column] | None = None) -> DataFrame:
    """Add next_<column>: the value in the next document, ascending doc_id (after the last: the first). Columns that are
    ``made`` from others are added after the exchange, in order, so they don't go through it.

    Documents are dealt to ranges of doc_id of about equal size; the first row of each range is also put at
    the end of the range before, so one exchange and a window within ranges are enough. A null doc_id is the
    smallest; rows of one doc_id are ordered by text.
    """
    key = F.coalesce(F.col("doc_id"), F.lit(-(1 << 63)).cast("long"))
    probs = [i / MOST_BUCKETS for i in range(1, MOST_BUCKETS)]
    found = docs.agg(F.count(F.lit(1)).alias("n"), F.percentile_approx(key, probs, 20_000).alias("q")).first()
    buckets = max(1, min(MOST_BUCKETS, math.ceil(found.n / ROWS_EACH)))
    bounds = sorted({found.q[MOST_BUCKETS * i // buckets - 1] for i in range(1, buckets)}) if found.n else []
    bucket = F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b < key)) if bounds else F.lit(0)
    firsts = sorted(docs.select(bucket.alias("b"), key.alias("k")).groupBy("b").agg(F.min("k").alias("k")).collect())  # a row for each range
    before = {b.b: a.b for a, b in zip([firsts[-1], *firsts[:-1]], firsts, strict=True)} if firsts else {0: 0}
    is_first = key.isin([r.k for r in firsts]) if firsts else F.lit(False)
    earlier = F.element_at(F.array(*[F.lit(before.get(b, 0)) for b in range(len(bounds) + 1)]), bucket + 1)
    place = lambda b, late: F.struct(b.cast("int").alias("_bucket"), F.lit(late).alias("_late"))
    rows = docs.select("*", F.explode(F.when(is_first, F.array(place(bucket, False), place(earlier, True))).otherwise(F.array(place(bucket, False)))).alias("_place")).select("*", "_place.*").drop("_place")
    rows = rows.repartition("_bucket")
    for name, column in (made or {}).items():
        rows = rows.withColumn(name, column)
    order = Window.partitionBy("_bucket").orderBy("_late", key, "text")
    return rows.select("*", *[F.lead(c).over(order).alias(f"next_{c}") for c in columns]).filter(~F.col("_late")).drop("_bucket", "_late")


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every row.

    A null text is empty. The edited text has its last half replaced by as much of the next document's start.
    """
    docs = as_documents(docs).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    docs = with_next(docs, ["text", "fp", "norm"], {"fp": fingerprint(F.col("text")), "norm": norm(F.col("fp"))})
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    docs = docs.select("doc_id", n.cast("long").alias("n_chars"), "fp", "next_fp", "norm", "next_norm", F.concat(F.expr("substring(text, 1, length(text) - cast(floor(length(text) / 2) as int))"), F.substring("next_text", F.lit(1), half)).alias("edited"))
    docs = docs.withColumn("edited_fp", fingerprint(F.col("edited"))).withColumn("edited_norm", norm(F.col("edited_fp")))
    return docs.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), as_text(F.col("fp")).alias("fingerprint"), as_text(F.col("edited_fp")).alias("edited_fingerprint"),
        likeness(*map(F.col, ("fp", "edited_fp", "norm", "edited_norm"))).alias("near_edited"), likeness(*map(F.col, ("fp", "next_fp", "norm", "next_norm"))).alias("near_next"),
    )
