"""Language identification by word-first backoff.

Known words are scored by their log frequency in each language. An unseen word falls back to
its longest known character n-grams: the mean score of those of length 4, else 3, 2, 1, with
marks at the word's ends. A text's language is the one with the highest sum over its words.

The model is fitted on a bounded sample of labelled rows: about ``docs_each`` documents of each
language, chosen by a hash of the row. It has all words and n-grams of the sample; their number,
and so the size that is sent to executors, doesn't grow with the corpus.
"""

from __future__ import annotations

import math
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellum.llm.common import map_arrow, map_columns, materialise, resident

DOCS_EACH = 500
LONGEST = 4
NONE = "und"
_LETTERS = regex.compile(r"\p{L}+")
_KEPT_WORDS = 200_000
_LONGEST_KEPT = 64


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from learning: crc32 of its id as text is a multiple of 5; a null id is too."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(True))


def _counts(labelled: DataFrame, docs_each: int) -> DataFrame:
    """(lang, word, n) over about ``docs_each`` labelled rows of each language."""
    sizes = {r.lang: r.n for r in labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each language
    if not sizes:
        return labelled.select("lang", F.lit("").alias("word"), F.lit(1).cast("long").alias("n")).limit(0)
    share = F.element_at(F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, min(1.0, docs_each / n))]), F.col("lang"))
    drawn = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 20)) / float(1 << 20)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: Counter = Counter()
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                seen.update((lang, w) for w in words_of(text))
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in seen], pa.string()), pa.array([w for _, w in seen], pa.string()), pa.array(list(seen.values()), pa.int64())], names=["lang", "word", "n"])

    return map_arrow(labelled.filter(drawn < share).select("lang", "text"), count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def words_of(text: str | None) -> list[str]:
    """Runs of letters, in lower case."""
    return _LETTERS.findall(text.lower()) if text else []


def _all(counts: DataFrame, key: str) -> dict[str, dict[str, int]]:
    """Counts by key and language; the sample bounds them."""
    out: dict[str, dict[str, int]] = {}
    for r in counts.toLocalIterator():
        out.setdefault(r[key], {})[r["lang"]] = r["n"]
    return out


class Model:
    """Log frequencies by language of words and n-grams."""

    def __init__(self, languages: list[str], words: dict[str, dict[str, int]], grams: dict[str, dict[str, int]]):
        self.languages = languages
        self.words = self._logs(words, 0.5)
        self.grams = {}
        for n in range(1, LONGEST + 1):
            self.grams |= self._logs({g: c for g, c in grams.items() if len(g) == n}, 0.5)
        self.floor = np.full(len(languages), -12.0)
        self._start()

    def _logs(self, counts: dict[str, dict[str, int]], add: float) -> dict[str, np.ndarray]:
        totals = {lang: add * len(counts) + sum(c.get(lang, 0) for c in counts.values()) for lang in self.languages}
        return {k: np.array([math.log((c.get(lang, 0) + add) / max(totals[lang], 1.0)) for lang in self.languages]) for k, c in counts.items()}

    def _start(self) -> None:
        """Table of word scores, in which unseen words are kept too, up to a bound."""
        self.index = {w: i for i, w in enumerate(self.words)}
        self.table = np.zeros((len(self.words) + _KEPT_WORDS, len(self.languages)))
        for i, v in enumerate(self.words.values()):
            self.table[i] = v

    def back_off(self, word: str) -> np.ndarray:
        marked = f"^{word}$"
        for n in range(LONGEST, 0, -1):
            known = [self.grams[g] for g in (marked[i : i + n] for i in range(len(marked) - n + 1)) if g in self.grams]
            if known:
                return np.mean(known, axis=0)
        return self.floor

    def predict(self, text: str | None) -> tuple[str, float]:
        """The best language and its posterior probability; ``und`` and 0 without letters or languages."""
        words = words_of(text)
        if not words or not self.languages:
            return NONE, 0.0
        index, table = self.index, self.table
        at = list(map(index.get, words))
        if None in at:
            new = [w for w in dict.fromkeys(words) if w not in index]
            if len(index) + len(new) > len(table):
                self._start()
                index, table = self.index, self.table
                new = [w for w in dict.fromkeys(words) if w not in index]
            if len(index) + len(new) > len(table) or max(map(len, new)) > _LONGEST_KEPT:  # a table for this text alone
                known = [w for w in dict.fromkeys(words) if w in index]
                table = np.array([*(table[index[w]] for w in known), *map(self.back_off, new)])
                index = {w: i for i, w in enumerate([*known, *new])}
            else:
                for w in new:
                    table[len(index)] = self.back_off(w)
                    index[w] = len(index)
            at = list(map(index.get, words))
        total = table[at].sum(axis=0)  # in the order of the text, whatever was kept before
        odds = np.exp(total - total.max())
        best = int(odds.argmax())
        return self.languages[best], float(odds[best] / odds.sum())


def train(labelled: DataFrame, docs_each: int = DOCS_EACH) -> tuple[list[str], dict, dict]:
    """(languages, word counts, n-gram counts) learnt from rows of (doc_id, text, lang); null texts and langs are left out."""
    counts = _counts(labelled.filter(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", "lang"), docs_each)
    counts = materialise(counts, "counts")
    words = _all(counts, "word")
    grams: dict[str, dict[str, int]] = {}
    marked = counts.select("lang", "n", F.concat(F.lit("^"), "word", F.lit("$")).alias("word"))
    for n in range(1, LONGEST + 1):
        size = F.lit(n)  # no second parameter of the function below: that would be an element's place
        pieces = F.transform(F.sequence(F.lit(1), F.length("word") - (n - 1)), lambda i: F.substring(F.col("word"), i, size))  # noqa: B023
        rows = marked.filter(F.length("word") >= n).select("lang", "n", F.explode(pieces).alias("gram")).groupBy("lang", "gram").agg(F.sum("n").alias("n"))
        grams |= _all(rows, "gram")
    return sorted({k for c in words.values() for k in c}), words, grams


PREDICTED = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]


def predict(docs: DataFrame, model: tuple[list[str], dict, dict]) -> DataFrame:
    """Add lang_pred and score (0 to 1) to every row, from the text alone.

    A text that is null or has no letter is ``und`` with score 0. Rows repeat as they do in ``docs``;
    columns of the same names are replaced.
    """
    sent, key = docs.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex

    def make():
        m = resident(key, lambda: Model(*sent.value))

        def work(batch: pa.RecordBatch) -> list:
            found = [m.predict(t) for t in batch.column(batch.schema.get_field_index("text")).to_pylist()]
            return [[x for x, _ in found], [x for _, x in found]]

        return work

    return map_columns(docs, PREDICTED, make)


def learn_and_predict(docs: DataFrame) -> DataFrame:
    """Learn from the rows that aren't held out and predict all rows."""
    return predict(docs, train(docs.filter(~held_out(F.col("doc_id")))))


def report(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row; rows repeat, an empty table gives an empty one, other columns are left out."""
    docs = docs.select("doc_id", "text", "lang")
    found = predict(docs.select("doc_id", "text"), train(docs.filter(~held_out(F.col("doc_id")))))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
