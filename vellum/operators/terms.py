"""Dictionaries as tables: which terms of a table of any size are in a text.

A short list becomes one array constant that each text is tried against. A longer one becomes an Aho-Corasick automaton that
the tasks share, and each text is scanned once, where it is: nothing but the terms is sent. Terms of more than ``MAX_BYTES``
are dealt by hash to several automata that are scanned one after the other.
"""

from __future__ import annotations

import math
import re
import uuid
from functools import reduce

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.functions.shipping import ship
from vellum.functions.text import ascii_rule
from vellum.sources.corpus import written_once

#: Terms, and characters of all of them, up to which a list is tried term by term.
FEW, FEW_CHARS = 256, 16_384
#: UTF-8 bytes of the terms of one automaton, which each worker builds once.
MAX_BYTES = 4_000_000
HOW = ("inside", "words")
_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}
_WORD = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_")
_scanners: dict[str, ahocorasick.Automaton] = {}


def as_terms(spark: SparkSession, terms: list[str]) -> DataFrame:
    return spark.createDataFrame([(t,) for t in terms], "term string")


def short_list(terms: DataFrame | list[str], column: str = "term") -> list[str] | None:
    """The distinct terms if they are few (a list is few), else None; only a checked number comes to the driver."""
    if not isinstance(terms, DataFrame):
        return list(dict.fromkeys(terms))
    named = terms.select(F.col(column).alias("term")).filter("term is not null and term <> ''")
    head = named.select("term").limit(FEW + 1).agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("term")).alias("chars")).first()
    if head.n > FEW or (head.chars or 0) > FEW_CHARS:
        return None
    return [r.term for r in named.distinct().orderBy("term").collect()]


def _quoted(term: Column) -> Column:
    return F.regexp_replace(term, r"([^\p{L}\p{N}\s])", r"\\$1")


def _is_in(text: Column, term: Column, how: str) -> Column:
    """inside: the term is anywhere in the lower-case text (column ``_low``); words: in any case, between edges of ASCII words."""
    if how == "inside":
        return F.col("_low").contains(term)
    edge = ascii_rule(r"\b")
    return F.when(F.col("_low").contains(F.lower(term)), F.rlike(text, F.concat(F.lit(f"(?i){edge}"), _quoted(term), F.lit(edge)))).otherwise(False)


def _automaton(key: str, terms: list[str], how: str) -> ahocorasick.Automaton:
    """The worker's automaton of the terms; a worker that goes on with other terms lets all but the last few go."""
    if key not in _scanners:
        while len(_scanners) > 3:
            _scanners.pop(next(iter(_scanners)))
        filed: dict[str, list[str]] = {}
        for term in terms:
            filed.setdefault(term.translate(_LOWER) if how == "words" else term, []).append(term)
        _scanners[key] = made = ahocorasick.Automaton()
        for k, named in filed.items():
            made.add_word(k, (len(k), named))
        made.make_automaton()
    return _scanners[key]


def _found(text: str, automaton: ahocorasick.Automaton, how: str) -> list[str]:
    """The automaton's terms that are in a text (for ``words`` with A-Z in lower case), sorted."""
    out: set[str] = set()
    for end, (n, named) in automaton.iter(text):
        if how == "words":  # an edge is where a word character and another one meet
            first, after = end - n + 1, end + 1
            if (first > 0 and text[first - 1] in _WORD) == (text[first] in _WORD) or (after < len(text) and text[after] in _WORD) == (text[end] in _WORD):
                continue
        out.update(named)
    return sorted(out)


def _scan(text: Column, terms: DataFrame, how: str) -> Column:
    """array<string>: those of the terms (at most about ``MAX_BYTES``) that are in ``text``."""
    context, key = terms.sparkSession.sparkContext, uuid.uuid4().hex
    sent = context.broadcast([r.term for r in terms.collect()])

    @F.arrow_udf("array<string>")
    def scan(texts: pa.Array) -> pa.Array:
        automaton = _automaton(key, sent.value, how)
        plain = (x if x is None or how == "inside" else x.translate(_LOWER) for x in texts.to_pylist())
        return pa.array([_found(x, automaton, how) if x and len(automaton) else [] for x in plain], pa.list_(pa.string()))

    return scan(text)


def with_terms(docs: DataFrame, text: Column, terms: DataFrame | list[str], name: str, how: str = "inside", column: str = "term") -> DataFrame:
    """Add ``name``, array<string>: the distinct terms that are in ``text``, sorted; none for a null text.

    ``how`` is ``inside`` (anywhere in the lower-case text, so terms must be lower-case) or ``words`` (whole words in any
    case). Null and empty terms don't count. Rows and columns stay as they are.
    """
    if how not in HOW:
        raise ValueError(f"how must be one of {HOW}")
    docs = docs.withColumn("_low", F.lower(text))  # a column, so that it isn't made again for each term
    lower, none = F.col("_low"), F.array().cast("array<string>")
    few = short_list(terms, column)
    if few is not None:
        found = F.filter(F.array(*map(F.lit, sorted(few))).cast("array<string>"), lambda t: _is_in(text, t, how)) if few else none
        return docs.withColumn(name, F.coalesce(F.when(text.isNotNull(), found), none)).drop("_low")
    distinct = terms.select(F.col(column).alias("term")).filter("term is not null and term <> ''").distinct()
    blocks = math.ceil((distinct.agg(F.sum(F.octet_length("term"))).first()[0] or 0) / MAX_BYTES)
    ship(docs.sparkSession)
    distinct = written_once(distinct) if blocks > 1 else distinct
    scanned = [_scan(lower if how == "inside" else text, distinct.filter(F.pmod(F.xxhash64("term"), F.lit(blocks)) == i) if blocks > 1 else distinct, how) for i in range(blocks)]
    return docs.withColumn(name, F.coalesce(F.array_sort(F.concat(*scanned)), none)).drop("_low")


def with_term_count(docs: DataFrame, text: Column, terms: DataFrame | list[str], name: str, how: str = "inside", column: str = "term") -> DataFrame:
    """Add ``name``: how many distinct terms are in ``text`` (see ``with_terms``). A list given in code is tried by fixed patterns."""
    if not isinstance(terms, DataFrame):
        docs = docs.withColumn("_low", F.lower(text))  # a column, so that it isn't made again for each term
        lower = F.col("_low")
        whole = lambda t: text.rlike(ascii_rule(rf"(?i)\b{t}\b"))
        # A text without a plain term isn't searched by its pattern.
        hit = (lambda t: lower.contains(t)) if how == "inside" else (lambda t: lower.contains(t.lower()) & whole(t) if re.fullmatch(r"[A-Za-z0-9_' ]+", t) else whole(t))
        return docs.withColumn(name, reduce(lambda acc, t: acc + F.coalesce(hit(t), F.lit(False)).cast("int"), terms, F.lit(0))).drop("_low")
    return with_terms(docs, text, terms, name, how, column).withColumn(name, F.size(name))
