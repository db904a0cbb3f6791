"""Periodic runs of words: maximal stretches in which words some distance apart are equal.

An enhanced suffix array (order, inverse, common prefixes) over the words of some documents. In each interval of
common prefixes of depth d, the suffixes of the smaller side of each split ask the inverse whether the suffix d
before or after lies in the other side; if so, a square of period d starts there that can't be moved to the right.
Squares are moved to the left as far as they go, and those of one stretch are merged into a run of its smallest
period. No tree is built: intervals are pairs of bounds in the array.

A run of 12 words has such a square of depth 4 or more (of a multiple of its period), so the array holds only
suffixes whose first four words come again in their document; all others are alone in their intervals.

Documents are independent of each other. A task works on some documents at a time, or on one long one.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellum.llm.common import map_columns

LEAST_LENGTH = 12
#: Every run has a branching square of at least this depth.
LEAST_DEPTH = 4
WORDS_EACH = 150_000
PIECE = 1_000_000
WORD = r"[^\x20\x09-\x0D]+"
RUNS = T.ArrayType(T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")]))


class Ranks:
    """Ranks of the prefixes of 1, 2, 4, ... words, as long as some come more than once."""

    def __init__(self, first: np.ndarray) -> None:
        n = len(first)
        order = np.argsort(first, kind="stable")
        starts = np.flatnonzero(np.diff(first[order], prepend=-1))
        rank = np.empty(n, np.int32)
        rank[order] = np.repeat(starts, np.diff(starts, append=n))
        again = np.repeat(np.diff(starts, append=n) > 1, np.diff(starts, append=n))
        self.levels: dict[int, np.ndarray] = {}
        active, k = np.sort(order[again]), 1
        self.repeated = active[:0]
        while len(active):
            self.levels[k] = rank
            if k == LEAST_DEPTH:
                self.repeated = active
            key = rank[active].astype(np.int64) * n + rank[np.minimum(active + k, n - 1)]
            by = np.argsort(key, kind="stable")
            key, at, place = key[by], active[by], np.arange(len(by))
            old = np.maximum.accumulate(np.where(np.diff(rank[at], prepend=-1) != 0, place, 0))
            new = np.flatnonzero(np.diff(key, prepend=-1))
            size = np.diff(new, append=len(key))
            rank = rank.copy()
            rank[at] += np.repeat(new, size).astype(np.int32) - old.astype(np.int32)
            active, k = np.sort(at[np.repeat(size > 1, size)]), 2 * k
        self.final = rank

    def common(self, a: np.ndarray, b: np.ndarray, back: bool = False) -> np.ndarray:
        """Words that are equal from a and b on, or before them."""
        n, out = len(self.final), np.zeros(len(a), np.int64)
        for k in sorted(self.levels, reverse=True):
            step = -k if back else 0
            x, y = (a - out + step, b - out + step) if back else (a + out, b + out)
            ok = np.flatnonzero((x >= 0) & (y >= 0) & (x < n) & (y < n))
            rank = self.levels[k]
            out[ok[rank[x[ok]] == rank[y[ok]]]] += k
        return out


def _bounds(depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each split with a depth: where its left side begins and its right side ends. Of equal depths the leftmost is above."""
    left, right, stack = np.zeros(len(depth), np.int64), np.full(len(depth), len(depth), np.int64), [0]
    depths = depth.tolist()
    for i in range(1, len(depths)):
        d = depths[i]
        while depths[stack[-1]] > d:
            right[stack.pop()] = i
        left[i] = stack[-1]
        stack.append(i)
    return left, right


def squares(ranks: Ranks) -> tuple[np.ndarray, np.ndarray]:
    """(place, period) of the branching squares of at least the least depth."""
    n = len(ranks.final)
    array = ranks.repeated[np.argsort(ranks.final[ranks.repeated])]
    if len(array) < 2:
        return array.astype(np.int64), array.astype(np.int64)
    array = array.astype(np.int64)
    inverse = np.full(n, -1, np.int64)
    inverse[array] = np.arange(len(array))
    depth = np.zeros(len(array), np.int64)
    depth[1:] = ranks.common(array[:-1], array[1:])
    depth[depth < LEAST_DEPTH] = 0
    left, right = _bounds(depth)
    splits = np.flatnonzero(depth)
    left, right, depth = left[splits], right[splits], depth[splits]
    small_left = splits - left <= right - splits
    begin, end = np.where(small_left, left, splits), np.where(small_left, splits, right)
    other, other_end = np.where(small_left, splits, left), np.where(small_left, right, splits)
    total = np.cumsum(end - begin)
    places, periods = [], []
    for piece in np.split(np.arange(len(splits)), np.searchsorted(total, np.arange(PIECE, total[-1] if len(total) else 0, PIECE))):
        size = (end - begin)[piece]
        of = np.repeat(piece, size)
        suffix = array[np.arange(len(of)) - np.repeat(np.cumsum(size) - size, size) + begin[of]]
        d = depth[of]
        for sign in (1, -1):
            there = suffix + sign * d
            ok = np.flatnonzero((there >= 0) & (there < n))
            at = inverse[there[ok]]
            ok = ok[(at >= other[of[ok]]) & (at < other_end[of[ok]])]
            places.append(np.minimum(suffix, there)[ok])
            periods.append(d[ok])
    return np.concatenate(places), np.concatenate(periods)


def runs_of(documents: list[list]) -> list[np.ndarray]:
    """For each document, given as its words: an array of (start, length, period), by start, then period."""
    sizes = np.array([len(d) + 1 for d in documents], np.int64)
    offsets = np.cumsum(sizes) - sizes
    ids: dict = {}
    first = np.empty(int(sizes.sum()), np.int64)
    for number, (words, at) in enumerate(zip(documents, offsets.tolist(), strict=True)):
        first[at : at + len(words)] = np.fromiter((ids.setdefault(w, len(ids) + 1) for w in words), np.int64, len(words)) + (number << 32)
        first[at + len(words)] = number << 32  # ends the document, equal to nothing
    ranks = Ranks(first)
    place, period = squares(ranks)
    start = place - ranks.common(place, place + period, back=True)
    end = place + 2 * period
    long = end - start >= LEAST_LENGTH
    start, end, period = start[long], end[long], period[long]
    for q in (3, 2, 1):  # smaller periods than the least depth
        broken = np.concatenate(([0], np.cumsum(first[:-q] != first[q:])))
        holds = np.flatnonzero(period % q == 0)
        holds = holds[broken[end[holds] - q] == broken[start[holds]]]
        period[holds] = np.minimum(period[holds], q)
    order = np.lexsort((period, end, start))
    start, end, period = start[order], end[order], period[order]
    new = np.ones(len(start), bool)
    new[1:] = (np.diff(start) != 0) | (np.diff(end) != 0)  # of one stretch the smallest period
    start, end, period = start[new], end[new], period[new]
    owner = np.searchsorted(offsets, start, "right") - 1
    order = np.lexsort((period, start))
    found = np.stack([start - offsets[owner], end - start, period], 1)[order]
    return np.split(found, np.searchsorted(owner[order], np.arange(1, len(documents))))


def collapsed_words(words: list, runs: np.ndarray) -> list:
    """The words, of each run only the first period."""
    if not len(runs):
        return words
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 0] + runs[:, 1], -1)
    return [w for w, drop in zip(words, (np.cumsum(change) > 0).tolist()) if not drop]


def find_runs(docs: DataFrame) -> DataFrame:
    """Add runs, array<struct<start, length, period>> by start, then period, and collapsed, the text with each run's first
    period only, words joined by one space.

    A null or empty text has no runs and an empty collapsed text. Rows repeat as they do in ``docs``, every other
    column stays (one named ``runs`` or ``collapsed`` is replaced), an empty table gives an empty one.
    """

    def make():
        def work(batch):
            texts = batch.column(batch.schema.get_field_index("text"))
            runs, collapsed, group, words = [], [], [], 0

            def flush():
                for one, found in zip(group, runs_of(group), strict=True):
                    runs.append([{"start": s, "length": n, "period": p} for s, n, p in found.tolist()])
                    collapsed.append(b" ".join(collapsed_words(one, found)).decode())
                group.clear()

            for text in texts:
                one = (text.as_py() or "").encode().split()  # at the white space of ASCII
                if words + len(one) > WORDS_EACH and group:
                    flush()
                    words = 0
                group.append(one)
                words += len(one)
            if group:
                flush()
            return [runs, collapsed]

        return work

    docs = docs.withColumn("text", F.col("text").cast("string"))
    return map_columns(docs, [T.StructField("runs", RUNS), T.StructField("collapsed", T.StringType())], make)


def with_planted_repeats(docs: DataFrame) -> DataFrame:
    """Texts in which the contract's rule has words repeat: with h = crc32(doc_id), documents of h % 10 = 0 repeat p words from
    word a on. A null doc_id has no repeats."""
    h = F.crc32(F.col("doc_id").cast("string"))
    words = F.regexp_extract_all("text", F.lit(WORD), F.lit(0))
    rows = docs.withColumn("_w", F.when(h % 10 == 0, words)).withColumn("_g", F.floor(h / 10))
    n = F.size("_w")
    rows = rows.withColumn("_a", F.when(n > 0, (F.col("_g") % n).cast("int")))
    rows = rows.withColumn("_p", F.when(n > 0, (1 + F.floor((n - F.col("_a")) / (3 + F.col("_g") % 8))).cast("int")))
    repeated = F.transform(F.sequence(F.col("_a"), n - 1), lambda i: F.element_at("_w", F.col("_a") + F.pmod(i - F.col("_a"), F.col("_p")) + 1))
    text = F.when(n > 0, F.array_join(F.concat(F.slice("_w", F.lit(1), F.col("_a")), repeated), " ")).otherwise(F.col("text"))
    return rows.withColumn("text", text).drop("_w", "_g", "_a", "_p")


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256 of every row; the four are those of
    the longest run (ties: smallest start, then period), null without one. Other columns are left out."""
    found = find_runs(with_planted_repeats(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))))
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string"))), "\n")
    lines = F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("")
    rows = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), longest.alias("l"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    start, length, period = -F.col("l.start"), F.col("l.length"), -F.col("l.period")
    return rows.select("doc_id", "n_runs", start.alias("start"), length.alias("length"), period.alias("period"), F.floor(1000 * length / period).alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
