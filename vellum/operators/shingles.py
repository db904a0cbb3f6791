"""Sets of word shingles in tasks: hashes, an order that has common shingles last, the leading shingles of that order, units of
texts that meet on one of them, and pairs of a unit."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

#: Documents whose shingles tell what is common, and common shingles that a task holds. They give the order of shingles, never the result.
DOCS_COUNTED, SHINGLES_HELD = 1 << 14, 1 << 20
SETS = "doc_id long, k string, s array<long>"
UNIT_SETS = "doc_id long, k array<struct<unit:long,parts:int>>, s array<long>"
#: Texts that are cut to shingles together.
ROWS_EACH = 512
#: Pairs that are looked at together, and about as many texts of a part of a unit.
PAIRS_EACH, PART_EACH = 1 << 20, 4096
LEADS = "doc_id long, k string, n int, lead array<long>, bits binary"
#: Less than one shingle can change a share of any set by.
SLACK = 1e-9


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _parts(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """All values of lists, and where each list begins and the last ends."""
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
    return lists.flatten().to_numpy(zero_copy_only=False), np.append(0, np.cumsum(sizes))


def _lists(values: np.ndarray, sizes: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32)), pa.array(values.view(np.int64)))


def distinct_shingles(width: int) -> Callable:
    """Of rows (doc_id, k, hashes of words) the sorted distinct hashes of runs of ``width`` words, or of all words if there are fewer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(low, ROWS_EACH) for b in batches for low in range(0, b.num_rows, ROWS_EACH)):
            words, starts = _parts(batch.column(2))
            words = words.view(np.uint64)
            found = []
            for a, b in zip(starts[:-1], starts[1:], strict=True):
                out = np.zeros(max(1, b - a - width + 1), np.uint64)
                for j in range(min(width, b - a)):
                    out = _mixed(out ^ words[a + j : a + j + len(out)]) + np.uint64(j + 1)
                found.append(np.unique(out))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), _lists(np.concatenate(found), np.array([len(x) for x in found]))], names=["doc_id", "k", "s"])

    return run


def _parities(values: np.ndarray, sizes: np.ndarray, row: np.ndarray) -> pa.Array:
    """Sets differ by at least as many shingles as their parities by bits. Of twice as many bits both halves together are the smaller form."""
    widths = 1 << np.maximum(6, np.ceil(np.log2(np.maximum(sizes, 1)))).astype(np.int64)
    ends = np.cumsum(widths)
    at = (ends - widths)[row] + (values.view(np.int64) & (widths[row] - 1))
    packed = np.packbits((np.bincount(at, minlength=int(ends[-1]) if len(ends) else 0) & 1).astype(np.uint8), bitorder="little").tobytes()
    return pa.array([packed[(e - w) // 8 : e // 8] for e, w in zip(ends.tolist(), widths.tolist(), strict=True)], pa.binary())


def leading_shingles(common: np.ndarray, counts: np.ndarray, threshold: float) -> Callable:
    """Of sets (doc_id, k, s) their size and, in the order of ``counts`` of common shingles (ascending; 0 for others) and hashes,
    as many leading shingles as must hold a shared one with any set that isn't larger; and parities of the shingles by their last
    bits, a bit or two for each shingle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, starts = _parts(batch.column(2))
            sizes = np.diff(starts)
            row = np.repeat(np.arange(len(sizes)), sizes)
            rank = np.zeros(len(values), np.int64)
            if len(common):
                at = np.minimum(np.searchsorted(common, values), len(common) - 1)
                rank = np.where(common[at] == values, counts[at], 0)
            order = np.argsort(row * (int(counts.max(initial=0)) + 1) + rank, kind="stable")
            most = sizes - np.ceil(sizes * threshold - SLACK).astype(np.int64) + 1
            lead = values[order][np.arange(len(values)) - starts[row] < most[row]]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes.astype(np.int32)), _lists(lead, np.minimum(most, sizes)), _parities(values, sizes, row)], names=["doc_id", "k", "n", "lead", "bits"])

    return run


def _runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.RecordBatch]:
    """Rows in order, so that rows which are equal in the first columns come in one batch."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [c.to_numpy() for c in batch.columns[:keys]]
        new = np.flatnonzero(np.logical_or.reduce([np.diff(c) != 0 for c in columns])) + 1
        if held and any(held[-1].column(c)[-1].as_py() != batch.column(c)[0].as_py() for c in range(keys)):
            new = np.append(0, new)
        if len(new):
            held.append(batch.slice(0, new[-1]))
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held = []
        held.append(batch.slice(new[-1] if len(new) else 0))
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def units_of(threshold: float) -> Callable:
    """Of rows (s, doc_id, n, at), sorted by s: texts that share a leading shingle with one that they can reach the threshold with,
    and as their unit the smallest doc_id of these."""
    share = required(threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _runs(batches, 1):
            s, doc, n, at = (c.to_numpy() for c in batch.columns)
            begin = np.append(0, np.flatnonzero(np.diff(s)) + 1)
            sizes = np.diff(np.append(begin, len(s)))
            kept = np.repeat(sizes > 1, sizes)
            doc, n, at, sizes = doc[kept], n[kept].astype(np.int64), at[kept].astype(np.int64), sizes[sizes > 1]
            if not len(doc):
                continue
            shorter = at <= n - np.ceil(2 * share * n - SLACK)  # a smaller set shares more of its own
            group = np.repeat(np.arange(len(sizes)), sizes)
            after = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(doc)) - 1
            able, ends, low = np.zeros(len(doc), bool), np.cumsum(after), 0
            while low < len(doc):
                high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + PAIRS_EACH, "right")))
                a = np.repeat(np.arange(low, high), after[low:high])
                b = a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(after[low:high]) - after[low:high], after[low:high])
                larger = (n[a] > n[b]) | ((n[a] == n[b]) & (doc[a] < doc[b]))
                a, b = np.where(larger, a, b), np.where(larger, b, a)
                still = np.minimum(n[a] - at[a], n[b] - at[b])
                good = shorter[b] & (n[b] >= threshold * n[a] - SLACK) & (still >= share * (n[a] + n[b]) - 1e-6) & (doc[a] != doc[b])
                able[a[good]] = able[b[good]] = True
                low = high
            if able.any():
                least = np.full(len(sizes), np.iinfo(np.int64).max)
                np.minimum.at(least, group[able], doc[able])
                found = np.unique(np.stack([least[group[able]], doc[able]], 1), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], names=["unit", "doc_id"])

    return run


def near_members(threshold: float) -> Callable:
    """Of rows (unit, i, j, part, doc_id, n, bits), sorted by the first three, texts whose parities don't rule out each other of the unit (of other parts, if i and j differ)."""
    apart = 1 - 2 * required(threshold)

    def near(x: np.ndarray, y: np.ndarray, nx: np.ndarray, ny: np.ndarray, allowed: Callable) -> tuple[np.ndarray, np.ndarray]:
        left, right = np.zeros(len(x), bool), np.zeros(len(y), bool)
        step = max(1, PAIRS_EACH // max(1, y.size))
        for low in range(0, len(x), step):
            differ = np.bitwise_count(x[low : low + step, None] ^ y[None]).sum(2, dtype=np.int64)
            a, b = nx[low : low + step, None], ny[None]
            good = (differ <= apart * (a + b) + 1e-6) & (np.minimum(a, b) >= threshold * np.maximum(a, b) - SLACK) & allowed(low, low + step)
            left[low : low + step] |= good.any(1)
            right |= good.any(0)
        return left, right

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _runs(batches, 3):
            keys = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in range(3)])
            begin = np.append(0, np.flatnonzero((np.diff(keys, axis=1) != 0).any(0)) + 1)
            kept = np.zeros(batch.num_rows, bool)
            part, doc, n, bits = (batch.column(c).to_numpy(zero_copy_only=False) for c in range(3, 7))
            for low, high in zip(begin, np.append(begin[1:], batch.num_rows), strict=True):
                across = keys[1, low] != keys[2, low]
                sizes = np.array([len(x) for x in bits[low:high]])
                for size in np.unique(sizes):
                    same, double = low + np.flatnonzero(sizes == size), low + np.flatnonzero(sizes == 2 * size)
                    x = np.frombuffer(b"".join(bits[same]), np.uint64).reshape(len(same), -1)
                    y = np.frombuffer(b"".join(bits[double]), np.uint64).reshape(len(double), 2, x.shape[1])
                    for other, z in ((same, x), (double, y[:, 0] ^ y[:, 1])):
                        if len(other):
                            ok = lambda a, b, r=same, c=other, q=across: (doc[r[a:b], None] != doc[None, c]) & ((part[r[a:b], None] != part[None, c]) | (not q))
                            left, right = near(x, z, n[same].astype(np.int64), n[other].astype(np.int64), ok)
                            kept[same] |= left
                            kept[other] |= right
            if kept.any():
                yield pa.RecordBatch.from_arrays([pa.array(keys[0][kept]), pa.array(doc[kept])], names=["unit", "doc_id"])

    return run


def pairs_of_units(threshold: float) -> Callable:
    """Of rows (unit, i, j, part, doc_id, s), sorted by the first three, pairs of a unit (of different parts, if i and j differ) whose sets reach the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _runs(batches, 3):
            keys = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in range(3)])
            begin = np.append(0, np.flatnonzero((np.diff(keys, axis=1) != 0).any(0)) + 1)
            for low, high in zip(begin, np.append(begin[1:], batch.num_rows), strict=True):
                yield from _pairs(batch.slice(low, high - low), threshold)

    return run


def _pairs(unit: pa.RecordBatch, threshold: float) -> Iterator[pa.RecordBatch]:
    part, doc = unit.column(3).to_numpy(), unit.column(4).to_numpy()
    across = unit.column(1)[0].as_py() != unit.column(2)[0].as_py()
    values, starts = _parts(unit.column(5))
    n, size = np.diff(starts).astype(np.int64), len(doc)
    row = np.repeat(np.arange(size), n)
    distinct, which, counts = np.unique(values, return_inverse=True, return_counts=True)
    row, which = row[counts[which] > 1], which[counts[which] > 1]
    order = np.argsort(which, kind="stable")
    listed, begin = row[order], np.cumsum(np.where(counts > 1, counts, 0)) - np.where(counts > 1, counts, 0)
    work = np.bincount(row, counts[which], size).astype(np.int64) + size
    ends, first, low = np.cumsum(work), np.searchsorted(row, np.arange(size + 1)), 0
    while low < size:
        high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + PAIRS_EACH, "right")))
        mine = slice(first[low], first[high])
        lengths = counts[which[mine]]
        met = listed[np.arange(lengths.sum()) + np.repeat(begin[which[mine]] - (np.cumsum(lengths) - lengths), lengths)]
        both = np.bincount(np.repeat(row[mine] - low, lengths) * size + met, minlength=(high - low) * size).reshape(high - low, size)
        a, b = np.nonzero(both)
        shared, a = both[a, b], a + low
        jaccard = shared / (n[a] + n[b] - shared)
        good = (a < b) & (jaccard >= threshold - 1e-9) & ((part[a] != part[b]) | (not across))
        a, b = doc[a[good]], doc[b[good]]
        if len(a):
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(jaccard[good])], names=["a_id", "b_id", "jaccard"])
        low = high


def required(threshold: float) -> float:
    """Share of two sets' sizes together that a pair at the threshold has in common."""
    return threshold / (1 + threshold)


def counted_documents(rows: int) -> int:
    """One document of so many is counted."""
    return max(1, math.ceil(rows / DOCS_COUNTED))
