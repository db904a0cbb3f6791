"""Benchmark decontamination: one Aho-Corasick automaton over the normalised windows of the test items.

A-Z are lower-cased and words are runs of ASCII digits, a-z and characters beyond
ASCII. An item's windows are its runs of ``width`` words; a shorter item, if it has
words, is one window. Texts are normalised byte for byte, so that a hit's place in
the normalised text maps back to the original, and each is scanned once.

The automaton is sent to all executors, so its size is checked: windows of more than
``max_bytes`` are dealt by hash into several automata that are scanned one after the
other. Every text meets every window either way.
"""

from __future__ import annotations

import math
import re
import uuid

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellum.llm.common import map_columns, materialise, resident

WIDTH = 13
MAX_BYTES = 16_000_000
_NORMAL = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))
_WORD = re.compile(rb"[^ ]+")
#: Words as Spark's regular expressions have them, after A-Z are lower-cased.
WORDS_SQL = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def normal_bytes(text: str) -> bytes:
    """The text's UTF-8 bytes, lower-cased, with a space for each byte that isn't in a word."""
    return text.encode("utf-8").translate(_NORMAL)


def windows(benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """(window, items): each distinct window and the sorted ids, as strings, of the items that have it.

    Null texts have no windows. An item without an id counts for hits but is in no list of items.
    """
    words = F.regexp_extract_all(F.translate("text", _UPPER, _LOWER), F.lit(WORDS_SQL), F.lit(0))
    starts = F.sequence(F.lit(1), F.greatest(F.size("words") - (width - 1), F.lit(1)))
    return (
        benchmark.select(F.col("item_id").cast("string").alias("item"), words.alias("words"))
        .filter(F.size("words") > 0)
        .select("item", F.explode(F.transform(starts, lambda i: F.array_join(F.slice("words", i, width), " "))).alias("window"))
        .groupBy("window")
        .agg(F.sort_array(F.collect_set("item")).alias("items"))
    )


class Scanner:
    """Finds windows in texts; ``patterns`` are (window, items)."""

    def __init__(self, patterns: list[tuple[str, list[str]]]):
        self.automaton = ahocorasick.Automaton()
        for window, items in patterns:
            key = f" {window} ".encode().decode("latin-1")
            self.automaton.add_word(key, (len(key), items))
        if patterns:
            self.automaton.make_automaton()
        self.empty = not patterns

    def scan(self, text: str) -> tuple[int, list[tuple[int, int, list[str]]]]:
        """The number of words, and (first word, last word, items) of each hit."""
        words = normal_bytes(text).split()
        if self.empty or not words:
            return len(words), []
        joined = b" " + b" ".join(words) + b" "
        found = list(self.automaton.iter(joined.decode("latin-1")))
        if not found:
            return len(words), []
        spaces = np.flatnonzero(np.frombuffer(joined, np.uint8) == 0x20)
        end = np.array([e for e, _ in found])
        start = end - np.array([n for _, (n, _) in found]) + 1
        return len(words), list(zip(np.searchsorted(spaces, start).tolist(), (np.searchsorted(spaces, end) - 1).tolist(), [items for _, (_, items) in found], strict=True))


def runs(hits: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping or touching (first, last) as maximal runs."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(hits):
        if out and a <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


SPAN = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
FOUND = [
    T.StructField("n_words", T.LongType()),
    T.StructField("n_hit", T.LongType()),
    T.StructField("items", T.ArrayType(T.StringType())),
    T.StructField("hit_spans", T.ArrayType(SPAN)),
]


def find_passages(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, max_bytes: int = MAX_BYTES) -> DataFrame:
    """Add to every row of ``docs``: n_words, n_hit (words inside an occurring window), items (sorted ids
    of the items with occurring windows) and hit_spans (code points of the original text, end exclusive).

    A null or empty text has no words. Rows repeat as they do in ``docs``; an empty benchmark gives no hits;
    columns of the same names are replaced.
    """
    spark = docs.sparkSession
    table = materialise(windows(benchmark, width), "windows")
    total = table.agg(F.sum(F.octet_length("window") + F.octet_length(F.array_join("items", ",")))).first()[0] or 0
    blocks = max(1, math.ceil(total / max_bytes))
    for block in range(blocks):
        part = table.filter(F.pmod(F.xxhash64("window"), F.lit(blocks)) == block).collect()  # at most about max_bytes
        sent = spark.sparkContext.broadcast([(r.window, list(r["items"])) for r in part])
        docs = _scan(docs, sent, uuid.uuid4().hex, block == 0)
    return docs


def _scan(docs: DataFrame, sent, key: str, first: bool) -> DataFrame:
    """Scan with one automaton; what earlier ones found is in the columns of FOUND and is added to."""

    def make():
        scanner = resident(key, lambda: Scanner(sent.value))

        def work(batch: pa.RecordBatch) -> list:
            column = lambda name: batch.column(batch.schema.get_field_index(name)).to_pylist()
            texts = column("text")
            before = [([], [])] * len(texts) if first else list(zip(column("items"), column("hit_spans"), strict=True))
            out: list[list] = [[], [], [], []]
            for text, (items, spans) in zip(texts, before, strict=True):
                n, hits = scanner.scan(text or "")
                n_hit = 0
                if hits or spans:
                    data = normal_bytes(text)
                    places = [(m.start(), m.end()) for m in _WORD.finditer(data)]
                    # code points before each byte
                    count = np.concatenate([[0], np.cumsum((np.frombuffer(text.encode("utf-8"), np.uint8) & 0xC0) != 0x80)])
                    begin = {int(count[a]): i for i, (a, _) in enumerate(places)} if spans else {}
                    stop = {int(count[b]): i for i, (_, b) in enumerate(places)} if spans else {}
                    merged = runs([(a, b) for a, b, _ in hits] + [(begin[s["start"]], stop[s["end"]]) for s in spans])
                    n_hit = sum(b - a + 1 for a, b in merged)
                    spans = [{"start": int(count[places[a][0]]), "end": int(count[places[b][1]])} for a, b in merged]
                    items = sorted({*items, *(x for _, _, found in hits for x in found)})
                for column_out, value in zip(out, (n, n_hit, items, spans), strict=True):
                    column_out.append(value)
            return out

        return work

    return map_columns(docs, FOUND, make)


def contaminated() -> F.Column:
    """At least one word in twenty is hit."""
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of every row of ``docs``."""
    found = find_passages(docs.select("doc_id", "text"), benchmark)
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), contaminated().alias("contaminated")
    )

