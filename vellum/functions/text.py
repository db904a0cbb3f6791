"""Column expressions on texts that several operators share."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}_]{2,}"


#: A word boundary that knows ASCII word characters only, as some rule sets have it.
ASCII_EDGE = r"(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"


NO_WORD_BEFORE, NO_WORD_AFTER = "(?<![A-Za-z0-9_])", "(?![A-Za-z0-9_])"
#: What matches word characters only, at its begin or its end: a letter, a class of them, or a group of plain words.
_PLAIN_WORDS = r"\((?:\?:)?[A-Za-z0-9_]+(?: +[A-Za-z0-9_]+)*(?:\|[A-Za-z0-9_]+(?: +[A-Za-z0-9_]+)*)*\)"
_WORD_FOLLOWS = re.compile(rf"\\b(?=(?:[A-Za-z0-9_]|\\[wd]|{_PLAIN_WORDS})(?![?*{{]))")
_WORD_PRECEDES = re.compile(rf"((?<!\\)[A-Za-z0-9_]|\\[wd]\+?|{_PLAIN_WORDS})\\b")


def ascii_rule(pattern: str) -> str:
    """A pattern whose word boundaries are ASCII, whatever the regular-expression engine's default. Beside what matches word
    characters only, a boundary is one look to the other side."""
    if not re.match(r"\(\?[a-z]*[uU]", pattern):  # otherwise letters match letters of other scripts
        pattern = _WORD_PRECEDES.sub(lambda m: m[1] + NO_WORD_AFTER, _WORD_FOLLOWS.sub(lambda m: NO_WORD_BEFORE, pattern))
    return pattern.replace(r"\b", ASCII_EDGE)


def strip(x: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(x, r"^\s+|\s+$", "")


def upper_letters(x: Column) -> Column:
    """Upper case letter by letter, so that no letter becomes several: ß becomes ẞ, others without a capital of one letter stay."""
    capital = lambda c: F.when(c == "ß", "ẞ").when(F.length(F.upper(c)) == 1, F.upper(c)).otherwise(c)
    return F.array_join(F.transform(F.split(x, ""), capital), "")


def lower_letters(x: Column) -> Column:
    """Lower case letter by letter, whatever the letters beside it (a sigma at a word's end is no other letter)."""
    return F.array_join(F.transform(F.split(x, ""), lambda c: F.substring(F.lower(c), 1, 1)), "")


def words(x: Column) -> Column:
    """Pieces between white space, without empty ones."""
    return F.filter(F.split(x, r"\s+"), lambda w: w != "")


def occurrences(x: Column, pattern: str) -> Column:
    """Number of matches of a pattern; null texts have none."""
    return F.coalesce(F.regexp_count(x, F.lit(pattern)), F.lit(0))


def places(x: Column, pattern: str) -> Column:
    """array<struct<start, match>> of the non-overlapping matches, in code points from 0.

    Matches and what lies between them alternate, so their lengths add up to the places.
    """
    found = F.regexp_extract_all(x, F.lit(pattern), F.lit(0))
    between = F.slice(F.split(x, pattern, -1), F.lit(1), F.size(found))
    steps = F.zip_with(between, found, lambda gap, m: F.struct(F.length(gap).alias("gap"), m.alias("m")))
    zero = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<start:int,match:string>>)").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        start = acc["at"] + s["gap"]
        return F.struct((start + F.length(s["m"])).alias("at"), F.concat(acc["out"], F.array(F.struct(start.alias("start"), s["m"].alias("match")))).alias("out"))

    return F.aggregate(steps, zero, step, lambda acc: acc["out"])


def ranked(df: DataFrame, by: list, order: list, name: str = "rank") -> DataFrame:
    """Add a row number within ``by``, in the given order."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


def banded(x: Column, bands: list[tuple[float | None, str]]) -> Column:
    """Label of the first band whose least value ``x`` reaches; the last band has none."""
    out = F.lit(bands[-1][1])
    for least, label in reversed(bands[:-1]):
        out = F.when(x >= least, label).otherwise(out)
    return out


def overlap_confidence(original: Column, revised: Column) -> Column:
    """Jaccard of lower-case words within 0.5 to 1; 0 for equal texts, 0.5 for an empty original; four digits."""
    a, b = F.array_distinct(words(F.lower(original))), F.array_distinct(words(F.lower(revised)))
    jaccard = F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))
    return F.round(F.when(original == revised, 0.0).when(F.size(a) == 0, 0.5).otherwise(F.greatest(F.lit(0.5), F.least(F.lit(1.0), jaccard))), 4)


def cosine(x: Column, y: Column) -> Column:
    """Cosine of two arrays of numbers of one length; 0 where one has length 0."""
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda i, j: i.cast("double") * j), F.lit(0.0), lambda acc, v: acc + v)
    norm = F.sqrt(dot(x, x)) * F.sqrt(dot(y, y))
    return F.when(norm > 0, dot(x, y) / norm).otherwise(0.0)
