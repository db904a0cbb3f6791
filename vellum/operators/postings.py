"""Which pages share most words with each of many short queries: exact counts, in blocks.

Pages are dealt to blocks with an inverted index each, by ascending page_id; the first blocks are small. Queries are exchanged
once, to shares of up to ``QUERIES_A_SHARE``, and a share is passed by all blocks, each of them packed. It keeps each query's ``k`` best
pages, so nothing of a pair of a query and a page is exchanged. A page of a later block has to have more words of a query than
its ``k``-th best page, ``h``, so it has one of the ``m - h`` rarest of the query's ``m`` words: only these words' lists are
opened, and what they list is dropped where too many of the other words are missing.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from vellum.functions.shipping import ship
from vellum.sources.corpus import written_once

#: Pairs of a page that one task scores.
PAIRS_EACH = 20_000
#: Pages of a block and of the first one, queries of a share, most shares that are made for the sake of cores alone.
PAGES_EACH, SLICE, QUERIES_A_SHARE, SHARES = 32_768, 1024, 1 << 20, 64
#: Queries that are counted at a time in the first block, and in others, and listed pages that are looked at together.
QUERIES_EACH, ROWS_EACH, LISTED = 2048, 8192, 1 << 18
#: Words whose frequencies a task holds, queries of a task, sources of a block and of a slice, words of a product.
WORDS_HELD, QUERIES_A_TASK, SOURCES_EACH, WIDTH, COLUMNS = 1 << 16, 50_000, 4096, 512, 4096
#: Pairs of a row that are counted at a time.
ROWS_COUNTED = 512
WEIGHTED = "block int, sources array<long>, words array<binary>, starts array<binary>, places array<binary>, weights array<binary>, leads array<binary>"
BLOCK = "block int, body array<binary>"
#: What a block has, in order: page ids, distinct words, how many pages list each, and their places, lists one after the other.
PARTS = (np.int64, np.int64, np.uint32, np.uint32)


def _hashed(words: Column) -> Column:
    """Distinct words as 64-bit hashes."""
    return F.array_distinct(F.transform(words, lambda w: F.xxhash64(w)))


def _empty(blocks: DataFrame) -> list[Column]:
    """Empty arrays for the fields of a block in the rows of queries. A null array would be costly: Arrow's writer passes over all
    null rows of a batch again for each of its rows."""
    return [F.array().cast(f.dataType).alias(f.name) for f in blocks.schema[1:]]


def _squeezed(x: np.ndarray) -> bytes:
    """Numbers as compressed differences, byte by byte; ascending ones get small."""
    x = np.diff(x, prepend=x.dtype.type(0))
    raw = np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes()
    return len(x).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _unsqueezed(data: bytes, kind: type) -> np.ndarray:
    n, width = int.from_bytes(data[:8], "little"), np.dtype(kind).itemsize
    raw = pa.decompress(data[8:], decompressed_size=n * width, codec="zstd", asbytes=True)
    return np.cumsum(np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(width, n).T).view(kind).reshape(n), dtype=kind)


def _bounds(pages: DataFrame, n_pages: int) -> np.ndarray:
    """The page ids that the blocks but the first begin with, about: blocks double from SLICE up to PAGES_EACH pages."""
    ends, size = [], SLICE
    while (ends[-1] if ends else 0) + size < n_pages:
        ends.append((ends[-1] if ends else 0) + size)
        size = min(PAGES_EACH, ends[-1])
    return np.unique(pages.approxQuantile("page_id", [e / n_pages for e in ends], max(1e-5, min(0.01, SLICE / 4 / n_pages)))) if ends else np.zeros(0)


def _blocks(pages: DataFrame, bounds: np.ndarray) -> DataFrame:
    """A row for each block of pages (page_id, words)."""

    def dealt(batches):
        for batch in batches:
            block = np.searchsorted(bounds, batch.column(0).to_numpy(), "right").astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(block), *batch.columns], names=["block", "page_id", "words"])

    rows = pages.mapInArrow(dealt, "block int, page_id long, words array<long>").groupBy("block").agg(F.array_sort(F.collect_list(F.struct("page_id", "words"))).alias("rows"))

    def packed(batches):
        for batch in batches:
            for i, rows in enumerate(batch.column(1)):
                inner = pa.RecordBatch.from_struct_array(rows.values)
                lengths, flat = inner.column(1).value_lengths().to_numpy(zero_copy_only=False), inner.column(1).flatten().to_numpy(zero_copy_only=False)
                order = np.argsort(flat, kind="stable")
                words, counts = np.unique(flat[order], return_counts=True)
                places = np.repeat(np.arange(len(lengths)), lengths)[order]
                body = [_squeezed(x.astype(t)) for x, t in zip((inner.column(0).to_numpy(), words, counts, places), PARTS, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), pa.array([body], pa.list_(pa.binary()))], names=["block", "body"])

    return written_once(rows.mapInArrow(packed, BLOCK))


class _Asked:
    """Queries of a share and each one's ``k`` best pages of the blocks that it has met, by hits and then by page id; hits of 0 are none."""

    def __init__(self, words: pa.ListArray, k: int):
        self.lengths = words.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        self.n, self.k = len(self.lengths), k
        self.ends = np.cumsum(self.lengths)
        self.distinct, which = np.unique(words.flatten().to_numpy(zero_copy_only=False), return_inverse=True)
        self.which = which.astype(np.int32)
        self.listed, self.sorted_at = np.zeros(len(self.distinct), np.int64), 0
        self.hits, self.pages = np.zeros((self.n, k), np.int64), np.full((self.n, k), np.iinfo(np.int64).max)

    def meet(self, body: list[bytes]) -> None:
        """A block whose page ids are larger than those of all before it."""
        ids, words, counts, places = (_unsqueezed(x, t) for x, t in zip(body, PARTS, strict=True))
        at = np.minimum(np.searchsorted(words, self.distinct), len(words) - 1)
        known = words[at] == self.distinct
        counts, places, at = counts.astype(np.int64), places.astype(np.int64), np.where(known, at, -1)
        if self.sorted_at:
            self._sort(known, counts[at])
            self._prune(ids, counts, places, at)
        else:
            self._count(ids, counts, places, at)
            self._sort(known, counts[at])

    def _sort(self, known: np.ndarray, counts: np.ndarray) -> None:
        """Each query's words from the rarest on, by what has been listed so far. Any order gives the same result."""
        self.listed += np.where(known, counts, 0)
        total = int(self.listed.sum())
        if total >= 2 * self.sorted_at or not self.sorted_at:
            row = np.repeat(np.arange(self.n), self.lengths)
            self.which = self.which[np.argsort(row * (int(self.listed.max(initial=0)) + 1) + self.listed[self.which], kind="stable")]
            self.sorted_at = max(1, total)

    def _count(self, ids: np.ndarray, counts: np.ndarray, places: np.ndarray, at: np.ndarray) -> None:
        """All pages of a small block: shared words are sums of rows of a matrix."""
        met = at[at >= 0]
        row_of = np.zeros(len(at), np.int32)  # row 0 has no page
        row_of[at >= 0] = np.arange(1, len(met) + 1)
        sizes = counts[met]
        most = int(self.lengths.max(initial=1))
        has = np.zeros((len(met) + 1, len(ids)), np.uint8 if most < 256 else np.uint32)
        starts = np.cumsum(counts) - counts
        has[np.repeat(np.arange(1, len(met) + 1), sizes), places[np.arange(sizes.sum()) + np.repeat(starts[met] - (np.cumsum(sizes) - sizes), sizes)]] = 1
        for low in range(0, self.n, QUERIES_EACH):
            lengths = self.lengths[low : low + QUERIES_EACH]
            n, begin = len(lengths), self.ends[low] - self.lengths[low]
            table = np.zeros((n, int(lengths.max(initial=1))), np.int32)
            table[np.arange(table.shape[1]) < lengths[:, None]] = row_of[self.which[begin : self.ends[low + n - 1]]]
            count = has[table[:, 0]]
            for j in range(1, table.shape[1]):
                count += has[table[:, j]]
            for j in range(min(self.k, len(ids))):
                best = count.argmax(1)
                hits = count[np.arange(n), best]
                self.hits[low : low + n, j] = hits
                self.pages[low : low + n, j] = np.where(hits > 0, ids[best], self.pages[low : low + n, j])
                count[np.arange(n), best] = 0

    def _prune(self, ids: np.ndarray, counts: np.ndarray, places: np.ndarray, at: np.ndarray) -> None:
        starts, width = np.cumsum(counts) - counts, len(ids)
        filed = np.repeat(np.arange(len(counts)), counts) * width + places  # ascending
        bits = max(10, math.ceil(math.log2(8 * len(filed))))
        slot = lambda key: (key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)
        table = np.zeros(1 << bits, bool)  # false where a page hasn't a word; seldom true where it hasn't
        table[slot(filed)] = True
        for low in range(0, self.n, ROWS_EACH):
            lengths = self.lengths[low : low + ROWS_EACH]
            n = len(lengths)
            word = at[self.which[self.ends[low] - lengths[0] : self.ends[low + n - 1]]]
            row = np.repeat(np.arange(n), lengths)[word >= 0]
            word = word[word >= 0]
            m = np.bincount(row, minlength=n)
            first = np.cumsum(m) - m
            rank = np.arange(len(word)) - first[row]
            # If a page's first word is this one, it lacks those before it and may lack so many of those after it.
            room = (m - self.hits[low : low + n, -1])[row] - 1 - rank
            last = rank == m[row] - 1
            entries = np.flatnonzero(room >= 0)
            ends = np.cumsum(counts[word[entries]])
            begin, found = 0, []
            while begin < len(entries):
                end = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + LISTED, "right")))
                part = entries[begin:end]
                begin = end
                sizes = counts[word[part]]
                page = places[np.arange(sizes.sum()) + np.repeat(starts[word[part]] - (np.cumsum(sizes) - sizes), sizes)]
                entry = np.repeat(part, sizes)
                left = room[entry]
                while len(page):
                    over = last[entry]
                    if over.any():
                        found.append(row[entry[over]] * width + page[over])
                        page, entry, left = page[~over], entry[~over], left[~over]
                    entry = entry + 1
                    left = left - ~table[slot(word[entry] * width + page)]
                    able = left >= 0
                    page, entry, left = page[able], entry[able], left[able]
            if not found:
                continue
            pair = np.unique(np.concatenate(found))
            of, page = np.divmod(pair, width)
            sizes = m[of]
            key = word[np.arange(sizes.sum()) + np.repeat(first[of] - (np.cumsum(sizes) - sizes), sizes)] * width + np.repeat(page, sizes)
            here = filed[np.minimum(np.searchsorted(filed, key), len(filed) - 1)] == key
            hits = np.bincount(np.repeat(np.arange(len(pair)), sizes), here, len(pair)).astype(np.int64)
            good = hits > self.hits[low + of, -1]
            self._merge(low + of[good], hits[good], ids[page[good]])

    def _merge(self, rows: np.ndarray, hits: np.ndarray, pages: np.ndarray) -> None:
        some, k = np.unique(rows), self.k
        of, hits, pages = np.concatenate([np.repeat(some, k), rows]), np.concatenate([self.hits[some].ravel(), hits]), np.concatenate([self.pages[some].ravel(), pages])
        order = np.lexsort((pages, -hits, of))
        of, hits, pages = of[order], hits[order], pages[order]
        place = np.arange(len(of)) - np.searchsorted(of, of)
        kept = place < k
        self.hits[of[kept], place[kept]], self.pages[of[kept], place[kept]] = hits[kept], pages[kept]


def _apart(spark: SparkSession, n: int) -> list[int]:
    """Integers, each of which has a partition of its own among ``n`` that rows are dealt to by hash."""
    some = spark.range(64 * n).select(F.col("id").cast("int").alias("x"))
    found = some.groupBy(F.pmod(F.hash("x"), F.lit(n))).agg(F.min("x").alias("x")).collect()
    return [r.x for r in found] + list(range(64 * n, 65 * n - len(found)))


def most_shared(queries: DataFrame, pages: DataFrame, keys: list[str], k: int) -> DataFrame:
    """keys, page_id, hits, place: the k pages (page_id, words) that have most of a query's distinct words (keys, words); of equal ones the smaller page_id."""
    ship(queries.sparkSession)
    asked = written_once(queries.select(*keys, _hashed(F.col("words")).alias("words")).filter(F.size("words") > 0))
    if asked.groupBy(*keys).count().filter("count > 1").head(1):  # queries of one key are one
        asked = written_once(asked.groupBy(*keys).agg(F.array_distinct(F.flatten(F.collect_list("words"))).alias("words")))
    filed = written_once(pages.select(F.col("page_id").cast("long").alias("page_id"), _hashed(F.col("words")).alias("words")).filter(F.size("words") > 0))
    n_queries, n_pages = asked.count(), filed.count()
    n_shares = max(1, min(SHARES, queries.sparkSession.sparkContext.defaultParallelism), math.ceil(n_queries / QUERIES_A_SHARE))
    blocks = _blocks(filed, _bounds(filed, n_pages))
    fields = [asked.schema[c] for c in keys]
    types = [to_arrow_type(f.dataType) for f in fields]
    shares = F.array(*map(F.lit, _apart(queries.sparkSession, n_shares)))
    mine = asked.select(F.element_at(shares, F.pmod(F.xxhash64(*keys), F.lit(n_shares)).cast("int") + 1).alias("share"), F.lit(-1).alias("block"), F.array().cast("array<binary>").alias("body"), *keys, "words")
    theirs = blocks.select(F.explode(shares).alias("share"), "block", "body", *[F.lit(None).cast(f.dataType).alias(f.name) for f in fields], F.lit(None).cast("array<long>").alias("words"))
    met = mine.unionByName(theirs).repartition(n_shares, "share").sortWithinPartitions("share", "block")
    names = [*keys, "page_id", "hits", "place"]

    def best(columns: list[pa.Array], asked: _Asked):
        for low in range(0, asked.n, ROWS_EACH):
            i, j = np.nonzero(asked.hits[low : low + ROWS_EACH])
            i += low
            yield pa.RecordBatch.from_arrays([*[c.take(pa.array(i)).cast(t) for c, t in zip(columns, types, strict=True)], pa.array(asked.pages[i, j]), pa.array(asked.hits[i, j]), pa.array((j + 1).astype(np.int32))], names=names)

    def counted(batches):
        share, parts, asked, columns = None, [], None, []
        for batch in batches:
            of, block = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            ends = np.append(np.flatnonzero((np.diff(of) != 0) | (block[1:] >= 0)) + 1, len(of))
            for low, high in zip(np.append(0, ends[:-1]), ends, strict=True):
                if of[low] != share:
                    if asked:
                        yield from best(columns, asked)
                    share, parts, asked = of[low], [], None
                if block[low] < 0:
                    parts.append(pa.RecordBatch.from_arrays(batch.slice(low, high - low).columns[3:], names=[*keys, "words"]))
                    continue
                if parts and not asked:
                    whole = pa.Table.from_batches(parts).combine_chunks()
                    columns = [whole.column(c).combine_chunks() for c in range(len(keys))]
                    asked, parts = _Asked(whole.column("words").combine_chunks(), k), []
                if asked:  # otherwise no query is in the share
                    asked.meet(batch.column(2)[low].as_py())
        if asked:
            yield from best(columns, asked)

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in fields) + ", page_id long, hits long, place int"
    return met.mapInArrow(counted, schema)


def _counted(words: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Distinct words, ascending, their counts, and the sum of the counts' squares."""
    distinct, counts = np.unique(words, return_counts=True)
    return distinct, counts, int((counts * counts).sum())


def shared_squares(texts: DataFrame, pairs: DataFrame, pages: DataFrame, keys: list[str], words: Callable[[Column], Column]) -> DataFrame:
    """keys, page_id, text, dot, sa, sb, na, nb of pairs (keys, page_id) of one of the texts (keys, text) and one of the pages (page_id, text).

    With counts a of the text's and b of the page's words, dot is the sum of a * b, sa and sb are those of a * a and b * b over
    shared words, na and nb those over all. Texts and pages are exchanged as they are and meet in order: a page comes before its
    pairs, and its words are counted once. A page of many pairs is sent to several tasks. Pairs are dealt to tasks before they get
    their texts, so that a text is exchanged to its pairs and once for each of them.
    """
    ship(pairs.sparkSession)
    paired = pairs.groupBy("page_id").agg(F.ceil(F.count(F.lit(1)) / PAIRS_EACH).cast("int").alias("n"))
    share = F.pmod(F.xxhash64(*keys), F.col("n")).cast("int").alias("share")
    dealt = pairs.join(paired, "page_id").groupBy(*keys).agg(F.collect_list(F.struct("page_id", share)).alias("to"))
    pairs = texts.join(dealt, keys).select(*keys, "text", F.explode("to").alias("to")).select(*keys, "to.page_id", "to.share", "text")
    fields = [pairs.schema[c] for c in keys]
    theirs = pages.join(paired, "page_id").select("page_id", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("share"), F.lit(0).alias("kind"), *[F.lit(None).cast(f.dataType).alias(f.name) for f in fields], "text")
    mine = pairs.select("page_id", "share", F.lit(1).alias("kind"), *keys, "text")
    met = theirs.unionByName(mine).repartition("page_id", "share").sortWithinPartitions("page_id", "share", "kind")
    met = met.select("kind", *keys, "page_id", "text", F.transform(words(F.col("text")), lambda w: F.xxhash64(w)).alias("words"))
    sums = ["dot", "sa", "sb", "na", "nb"]

    def squares(batches):
        page = of = None
        for batch in batches:
            kinds, ids, lists = batch.column(0).to_numpy(), batch.column(1 + len(keys)).to_numpy(), batch.column(batch.num_columns - 1)
            flat, ends = lists.flatten().to_numpy(zero_copy_only=False), np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))
            out, kept = [], []
            for i, (kind, end) in enumerate(zip(kinds, ends, strict=True)):
                here = _counted(flat[ends[i - 1] if i else 0 : end])
                if kind == 0:
                    page, of = here, ids[i]
                    continue
                if ids[i] != of:  # no such page
                    continue
                at = np.minimum(np.searchsorted(page[0], here[0]), max(0, len(page[0]) - 1))
                shared = page[0][at] == here[0] if len(page[0]) else np.zeros(len(here[0]), bool)
                a, b = here[1][shared], page[1][at[shared]] if len(page[0]) else here[1][:0]
                out.append((int((a * b).sum()), int((a * a).sum()), int((b * b).sum()), here[2], page[2]))
                kept.append(i)
            rows = batch.take(pa.array(kept, pa.int64()))
            columns = [pa.array(x, pa.int64()) for x in zip(*out, strict=True)] or [pa.array([], pa.int64())] * len(sums)
            yield pa.RecordBatch.from_arrays([*rows.columns[1:-1], *columns], names=[*keys, "page_id", "text", *sums])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in [*fields, pairs.schema["page_id"]]) + ", text string, " + ", ".join(f"{x} long" for x in sums)
    return met.mapInArrow(squares, schema)


def row_squares(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """keys, dot, sa, sb, na, nb, as ``shared_squares`` has them, of the words a and b (array<long>) of each row, without an exchange."""
    ship(pairs.sparkSession)
    fields = [pairs.schema[c] for c in keys]
    sums = ["dot", "sa", "sb", "na", "nb"]

    def squares(batches):
        for whole in batches:
            for low in range(0, whole.num_rows, ROWS_COUNTED):
                batch = whole.slice(low, ROWS_COUNTED)
                n = batch.num_rows
                lists = [batch.column(len(keys) + c) for c in (0, 1)]
                owner = [np.repeat(np.arange(n), x.value_lengths().to_numpy(zero_copy_only=False)) for x in lists]
                flat = [x.flatten().to_numpy(zero_copy_only=False) for x in lists]
                distinct, which = np.unique(np.concatenate(flat), return_inverse=True)
                key = np.concatenate(owner) * max(1, len(distinct)) + which
                met, at = np.unique(key, return_inverse=True)
                row, split = met // max(1, len(distinct)), len(flat[0])
                a, b = np.bincount(at[:split], minlength=len(met)).astype(np.float64), np.bincount(at[split:], minlength=len(met)).astype(np.float64)
                both = (a > 0) & (b > 0)
                # Sums of whole numbers: exact in doubles up to 2^53.
                out = [np.bincount(row, x, n).astype(np.int64) for x in (a * b, a * a * both, b * b * both, a * a, b * b)]
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(keys)], *map(pa.array, out)], names=[*keys, *sums])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in fields) + ", " + ", ".join(f"{x} long" for x in sums)
    return pairs.mapInArrow(squares, schema)


def _weighted_blocks(weights: DataFrame, n_blocks: int) -> DataFrame:
    """A row for each block of sources (source, word, weight, leads): source ids, and for each slice of them distinct words, where
    each word's list begins, places of sources in the slice, their weights, and whether a word leads a source."""
    rows = weights.groupBy("source").agg(F.collect_list(F.struct("word", "weight", "leads")).alias("list"))
    rows = rows.groupBy(F.pmod(F.xxhash64("source"), F.lit(n_blocks)).cast("int").alias("block")).agg(F.collect_list(F.struct("source", "list")).alias("rows"))
    width = WIDTH

    def packed(batches):
        for batch in batches:
            for i, rows in enumerate(batch.column(1)):
                inner = pa.RecordBatch.from_struct_array(rows.values)
                slices = []
                for low in range(0, inner.num_rows, width):
                    lists = inner.column(1).slice(low, width)
                    lengths, flat = lists.value_lengths().to_numpy(zero_copy_only=False), pa.RecordBatch.from_struct_array(lists.flatten())
                    word, weight, leads = (flat.column(c).to_numpy(zero_copy_only=False) for c in range(3))
                    order = np.argsort(word, kind="stable")
                    words, starts = np.unique(word[order], return_index=True)
                    places = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)[order]
                    slices.append((words.tobytes(), np.append(starts, len(word)).astype(np.int64).tobytes(), places.tobytes(), weight[order].tobytes(), np.logical_or.reduceat(leads[order], starts).tobytes()))
                arrays = [pa.array([inner.column(0).to_pylist()], pa.list_(pa.int64())), *[pa.array([list(x)], pa.list_(pa.binary())) for x in zip(*slices, strict=True)]]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), *arrays], names=["block", "sources", "words", "starts", "places", "weights", "leads"])

    return written_once(rows.mapInArrow(packed, WEIGHTED))


def _products(queries: pa.ListArray, slices: list[tuple], held: np.ndarray, idf: np.ndarray, floor: float, least: float) -> tuple:
    """Rows and places of what can reach ``least``, products, the rows' squares over held words; and for all rows, row and count
    of each word that isn't held, with the word."""
    lengths = queries.value_lengths().to_numpy(zero_copy_only=False)
    n = len(lengths)
    distinct, which = np.unique(queries.flatten().to_numpy(zero_copy_only=False), return_inverse=True)
    pairs, tf = np.unique(np.repeat(np.arange(n), lengths) * len(distinct) + which, return_counts=True)
    row, word = np.divmod(pairs, max(1, len(distinct)))
    at = np.minimum(np.searchsorted(held, distinct), max(0, len(held) - 1))
    known = held[at] == distinct if len(held) else np.zeros(len(distinct), bool)
    squares = (tf * np.where(known, idf[at], floor)[word] if len(held) else tf * floor) ** 2.0
    exact = np.bincount(row, squares * known[word], n)
    bound = (least - 1e-4) * np.sqrt(np.bincount(row, squares, n))
    rows, places, products, first = [], [], [], 0
    for words, starts, listed, weights, leads in slices:
        at = np.minimum(np.searchsorted(words, distinct), len(words) - 1)
        here = words[at] == distinct
        width = int(listed.max()) + 1
        keyed = np.repeat(np.arange(len(words)), np.diff(starts)) * width + listed
        led = np.zeros(n, bool)
        led[row[(here & leads[at])[word]]] = True
        use = np.flatnonzero(here[word] & led[row])
        if len(use):
            met, begin, counts = np.unique(row[use], return_index=True, return_counts=True)
            of = np.repeat(np.arange(len(met)), counts)
            column = (np.cumsum(here) - 1)[word[use]]
            dots = np.zeros((len(met), width), np.float32)
            for low in range(0, here.sum(), COLUMNS):
                part = at[here][low : low + COLUMNS]
                sizes = starts[part + 1] - starts[part]
                flat = np.arange(sizes.sum()) + np.repeat(starts[part] - (np.cumsum(sizes) - sizes), sizes)
                table = np.zeros((len(part), width), np.float32)
                table[np.repeat(np.arange(len(part)), sizes), listed[flat]] = weights[flat]
                mine = (column >= low) & (column < low + len(part))
                times = np.zeros((len(met), len(part)), np.float32)
                times[of[mine], column[mine] - low] = tf[use][mine]
                dots += times @ table
            # Sums of few digits screen, with room for what each of their steps rounds; what is left is summed in full.
            room = 1 - 1e-5 - 1e-7 * counts
            i, j = np.nonzero((dots > 0) & (dots >= (bound[met] * room)[:, None]))
            sizes = counts[i]
            entry = use[np.arange(sizes.sum()) + np.repeat(begin[i] - (np.cumsum(sizes) - sizes), sizes)]
            key = at[word[entry]] * width + np.repeat(j, sizes)
            spot = np.minimum(np.searchsorted(keyed, key), len(keyed) - 1)
            full = np.bincount(np.repeat(np.arange(len(i)), sizes), np.where(keyed[spot] == key, weights[spot], 0.0) * tf[entry], len(i))
            good = full >= bound[met[i]]
            rows.append(met[i][good])
            places.append(first + j[good])
            products.append(full[good])
        first += width
    none = np.zeros(0, np.int64)
    other = ~known[word]
    hit = np.concatenate([none, *rows])
    return hit, np.concatenate([none, *places]), np.concatenate([none.astype(np.float64), *products]), exact[hit], row[other], distinct[word[other]], tf[other]


def weighted_matches(queries: DataFrame, weights: DataFrame, frequent: list[tuple[int, float]], floor: float, least: float, keys: list[str], n_queries: int) -> DataFrame:
    """keys, source, dot, square, rest (word, n) of all pairs of a query and a source whose cosine can reach ``least``.

    ``queries`` has (keys, words array<long>, repeated ones too), ``weights`` (source, word, weight, leads): a word's weight in the
    source, whose vector has length 1, times its idf. ``frequent`` are words with their idf; all others have one of ``floor`` or
    more. ``square`` is the query's sum of squares over frequent words, ``rest`` its other words with counts; without them the
    cosine is dot / sqrt(square). A query that has no word that leads a source isn't multiplied. Queries are exchanged once for each
    block of sources.
    """
    ship(queries.sparkSession)
    n_blocks = max(1, math.ceil(weights.select("source").distinct().count() / SOURCES_EACH))
    n_shares = max(64, math.ceil(n_queries / QUERIES_A_TASK))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    fields = [queries.schema[c] for c in keys]
    none = lambda kept: [F.lit(None).cast(f.dataType).alias(f.name) for f in kept]
    blocks = _weighted_blocks(weights, n_blocks)
    wide = queries.select(each(n_blocks).alias("block"), F.pmod(F.xxhash64(*keys), F.lit(n_shares)).cast("int").alias("share"), F.lit(1).alias("kind"), *keys, F.col("words").alias("asked"), *_empty(blocks))
    first = blocks.withColumn("asked", F.lit(None).cast("array<long>")).select("block", each(n_shares).alias("share"), F.lit(0).alias("kind"), *none(fields), "asked", *blocks.columns[1:])
    met = wide.unionByName(first).repartition("block", "share").sortWithinPartitions("block", "share", "kind").drop("share")
    held, idf = (np.array([r[c] for r in sorted(frequent)], t) for c, t in ((0, np.int64), (1, np.float64)))

    def multiplied(batches):
        block = ids = slices = None
        for batch in batches:
            of, kinds = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            ends = np.append(np.flatnonzero(np.diff(of) | (kinds[1:] == 0)) + 1, len(of))
            low = 0
            while low < len(of):
                if kinds[low] == 0:
                    block, (source_ids, *packed) = of[low], [c[low] for c in batch.columns[-6:]]
                    ids = source_ids.values.to_numpy(zero_copy_only=False)
                    slices = [tuple(np.frombuffer(x, t) for x, t in zip(one, (np.int64, np.int64, np.int32, np.float64, bool), strict=True)) for one in zip(*[x.as_py() for x in packed], strict=True)]
                    low += 1
                    continue
                high = min(low + QUERIES_EACH, ends[np.searchsorted(ends, low, "right")])
                if of[low] == block:  # otherwise no source is in the block
                    part = batch.slice(low, high - low)
                    i, at, dot, square, row, word, n = _products(part.column(2 + len(keys)), slices, held, idf, floor, least)
                    begin, end = np.searchsorted(row, i), np.searchsorted(row, i, "right")
                    rest = pa.array([[{"word": w, "n": c} for w, c in zip(word[b:e].tolist(), n[b:e].tolist(), strict=True)] for b, e in zip(begin, end, strict=True)], pa.list_(pa.struct([("word", pa.int64()), ("n", pa.int64())])))
                    yield pa.RecordBatch.from_arrays([*[part.column(2 + c).take(pa.array(i)) for c in range(len(keys))], pa.array(ids[at], pa.int64()), pa.array(dot), pa.array(square), rest], names=[*keys, "source", "dot", "square", "rest"])
                low = high

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in fields) + ", source long, dot double, square double, rest array<struct<word:long,n:long>>"
    return met.mapInArrow(multiplied, schema)
