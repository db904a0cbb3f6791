"""Suffix-array dedup: bytes covered by a 50-byte string that also starts in a document with a smaller id.

Whole suffix arrays of a corpus are many times its size, so the arrays here are sparse. Each 50-byte
window is filed under its anchor, the 24-byte gram of lowest hash in it (the first of equals). Equal
windows have equal anchors, so all places of a window meet in the task that has the anchor's shard.

1. Anchors that occur in one document only can't be part of a match. Each task sends each anchor to its
   shard once, with its document or, if several have it, as shared; shards answer for the others.
2. For shared anchors, tasks send fragments: the bytes under the run of windows that have the anchor.
3. In a shard, fragments are taken in ascending doc_id order. Each batch gets a suffix array (its windows
   in sorted order), is merge-scanned against the existing levels for windows of smaller documents, and
   becomes a level; levels of equal size merge, so their sizes grow geometrically.
4. Covered ranges return to their documents. Answers and ranges travel in bundles of many documents.

The exchange of texts by document is the same in steps 2 and 4 and is made once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.common import map_arrow, shuffle_partitions

WINDOW = 50
GRAM = 24
BLOCK_ANCHORS = 1_000_000
BLOCK_DOCS = 60_000
BLOCK_FRAGMENTS = 400_000
BATCH_WINDOWS = 1 << 16
SEGMENT = (1 << 20) - 4096
_LEAST = -(1 << 63)
_SHARED = 0xFFFF


def _mixed(v: np.ndarray) -> np.ndarray:
    v = v * np.uint64(0x9E3779B97F4A7C15)
    return v ^ (v >> np.uint64(29))


def anchors(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of the anchor, first window, last window) of each run of windows with one anchor."""
    out: list[tuple] = []
    for at in range(0, max(0, len(data) - WINDOW + 1), SEGMENT):
        part = np.frombuffer(data[at : at + SEGMENT + WINDOW - 1] + bytes(8), np.uint8)
        n = len(part) - 8
        words = np.lib.stride_tricks.sliding_window_view(part, 8)[:n].copy().view("<u8").ravel()
        grams = n - GRAM + 1
        h = np.zeros(grams, np.uint64)
        for j in range(0, GRAM, 8):
            h = _mixed(h ^ words[j : j + grams])
        low = np.uint64((1 << 20) - 1)
        key = (h & ~low) | np.arange(grams, dtype=np.uint64)  # of equal grams the first
        span, width = WINDOW - GRAM + 1, 1
        while width * 2 <= span:
            key = np.minimum(key[:-width], key[width:])
            width *= 2
        if width < span:
            key = np.minimum(key[: len(key) - (span - width)], key[span - width :])
        place = (key & low).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        last = np.concatenate([first[1:], [len(place)]]) - 1
        out.append((h[place[first]], first + at, last + at))
    if not out:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _shard(h: np.ndarray, shards: int) -> np.ndarray:
    return (h >> np.uint64(40)) % np.uint64(shards)


def _column(batch: pa.RecordBatch, name: str) -> list:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()


PACKED = "key long, kind int, payload binary"
_PACKED = pa.schema([("key", pa.int64()), ("kind", pa.int32()), ("payload", pa.binary())])
BUNDLE = "key long, payload binary"
_BUNDLE = pa.schema([("key", pa.int64()), ("payload", pa.binary())])
VALUES = "key long, values binary"
_VALUES = pa.schema([("key", pa.int64()), ("values", pa.binary())])


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """Smaller batches, so that few texts are Python objects at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def _rows(schema: pa.Schema, columns: list[list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _ask(shards: int, buckets: int):
    """Anchors of each block of documents: one entry for each anchor to its shard (kind 0), and what is shared within the block (kind 1)."""

    def flush(keys: list[int], found: list[np.ndarray]) -> pa.RecordBatch:
        h = np.concatenate(found)
        doc = np.repeat(np.arange(len(found)), [len(x) for x in found])
        order = np.argsort(h, kind="stable")
        h, doc = h[order], doc[order]
        start = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        size = np.diff(np.concatenate([start, [len(h)]]))
        shared = size > 1
        entry = np.where(shared, _SHARED, doc[start]).astype(np.uint16)
        anchor = h[start]
        shard = _shard(anchor, shards)
        order = np.argsort(shard, kind="stable")
        anchor, entry, shard = anchor[order], entry[order], shard[order]
        cuts = np.concatenate([np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1]])), [len(shard)]])
        out: list[list] = [[], [], []]
        all_keys = np.array(keys, "<i8")
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            docs, at = np.unique(entry[a:b][entry[a:b] != _SHARED], return_inverse=True)
            number = np.full(b - a, _SHARED, np.uint16)
            number[entry[a:b] != _SHARED] = at
            low = anchor[a:b] & np.uint64((1 << 40) - 1)
            head = np.array([len(docs), b - a], "<u4").tobytes()
            body = head + all_keys[docs].tobytes() + number.astype("<u2").tobytes() + (low & np.uint64(0xFFFFFFFF)).astype("<u4").tobytes() + (low >> np.uint64(32)).astype("u1").tobytes()
            for column, value in zip(out, (int(shard[a]), 0, body), strict=True):
                column.append(value)
        inside = np.repeat(shared, size)
        doc, h = doc[inside], h[inside]
        if len(doc):
            for b, body in zip(*_bundles(all_keys[doc], (h & np.uint64(0xFFFFFFFF)).astype("<u4"), buckets), strict=True):
                for column, value in zip(out, (b, 1, body), strict=True):
                    column.append(value)
        return _rows(_PACKED, out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, found, n = [], [], 0
        for batch in _slices(batches):
            for key, text in zip(_column(batch, "key"), _column(batch, "text"), strict=True):
                h = np.unique(anchors((text or "").encode())[0])
                if len(h):
                    keys.append(key)
                    found.append(h)
                    n += len(h)
                if n >= BLOCK_ANCHORS or len(keys) >= BLOCK_DOCS:
                    yield flush(keys, found)
                    keys, found, n = [], [], 0
        if keys:
            yield flush(keys, found)

    return run


def _bundles(keys: np.ndarray, values: np.ndarray, buckets: int) -> tuple[list[int], list[bytes]]:
    """Values (a row of unsigned 32-bit integers for each key) of many documents as one payload for each bucket of documents."""
    bucket = ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)) % np.uint64(buckets)
    order = np.lexsort((keys, bucket))
    keys, values, bucket = keys[order], values[order].reshape(len(keys), -1), bucket[order]
    out: tuple[list[int], list[bytes]] = ([], [])
    for b, at in _groups(bucket, np.arange(len(keys))):
        part, rows = keys[at], values[at]
        start = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
        size = np.diff(np.concatenate([start, [len(part)]])) * rows.shape[1]
        out[0].append(b)
        out[1].append(np.array([len(start)], "<u4").tobytes() + part[start].astype("<i8").tobytes() + size.astype("<u4").tobytes() + rows.astype("<u4").tobytes())
    return out


def _unbundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each document with all its values, from the payloads of whole buckets."""
    found: dict[int, list[bytes]] = {}
    for batch in batches:
        for body in _column(batch, "payload"):
            n = int(np.frombuffer(body, "<u4", 1)[0])
            size = np.frombuffer(body, "<u4", n, 4 + 8 * n)
            at = 4 + 12 * n
            for key, m in zip(np.frombuffer(body, "<i8", n, 4).tolist(), (size * 4).tolist(), strict=True):
                found.setdefault(key, []).append(body[at : at + m])
                at += m
    if found:
        yield _rows(_VALUES, [list(found), [b"".join(x) for x in found.values()]])


def _groups(by: np.ndarray, values: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Runs of equal ``by``, which is sorted."""
    if len(by):
        start = np.flatnonzero(np.concatenate([[True], by[1:] != by[:-1]]))
        for a, b in zip(start, [*start[1:], len(by)], strict=True):
            yield int(by[a]), values[a:b]


def _answer(buckets: int):
    """Low bits of each document's shared anchors, from the entries of whole shards."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h, entry_key, alone = [], [], []
        for batch in batches:
            direct: list[list] = [[], []]
            for key, kind, body in zip(_column(batch, "key"), _column(batch, "kind"), _column(batch, "payload"), strict=True):
                if kind == 1:
                    direct[0].append(key)
                    direct[1].append(body)
                    continue
                n_docs, n = np.frombuffer(body, "<u4", 2)
                at = 8
                docs = np.frombuffer(body, "<i8", n_docs, at)
                at += 8 * int(n_docs)
                number = np.frombuffer(body, "<u2", n, at)
                at += 2 * int(n)
                low = np.frombuffer(body, "<u4", n, at).astype(np.uint64)
                high = np.frombuffer(body, "u1", n, at + 4 * int(n)).astype(np.uint64)
                h.append(np.uint64(key) << np.uint64(40) ^ high << np.uint64(32) ^ low)
                single = number != _SHARED
                alone.append(single)
                keys = np.zeros(int(n), np.int64)
                keys[single] = docs[number[single]]
                entry_key.append(keys)
            if direct[0]:
                yield _rows(_BUNDLE, direct)
        if not h:
            return
        h, keys, alone = np.concatenate(h), np.concatenate(entry_key), np.concatenate(alone)
        order = np.argsort(h, kind="stable")
        h, keys, alone = h[order], keys[order], alone[order]
        start = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        size = np.diff(np.concatenate([start, [len(h)]]))
        told = np.repeat(size > 1, size) & alone
        keys, low = keys[told], (h[told] & np.uint64(0xFFFFFFFF)).astype("<u4")
        if len(keys):
            yield _rows(_BUNDLE, list(_bundles(keys, low, buckets)))

    return run


def _cut(shards: int):
    """Fragments of shared anchors, by shard; equal fragments of a batch are sent once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: dict[int, tuple[dict[bytes, int], list[int], list[int], list[int]]] = {}
        n = 0
        for batch in _slices(batches):
            for key, text, told in zip(_column(batch, "key"), _column(batch, "text"), _column(batch, "told"), strict=True):
                if not told or not text:
                    continue
                data = text.encode()
                h, first, last = anchors(data)
                wanted = np.isin((h & np.uint64(0xFFFFFFFF)).astype(np.uint32), np.frombuffer(told, "<u4"))
                for s, a, b in zip(_shard(h[wanted], shards).tolist(), first[wanted].tolist(), last[wanted].tolist(), strict=True):
                    texts, number, keys, at = sent.setdefault(s, ({}, [], [], []))
                    number.append(texts.setdefault(data[a : b + WINDOW], len(texts)))
                    keys.append(key)
                    at.append(a)
                n += int(wanted.sum())
            if n >= BLOCK_FRAGMENTS:
                yield pack(sent)
                sent, n = {}, 0
        if sent:
            yield pack(sent)

    def pack(sent: dict) -> pa.RecordBatch:
        out: list[list] = [[], [], []]
        squeeze = zstandard.ZstdCompressor(level=1).compress
        for s, (texts, number, keys, at) in sent.items():
            head = np.array([len(texts), len(number)], "<u4").tobytes()
            body = b"".join([head, np.array(keys, "<i8").tobytes(), np.array(at, "<u4").tobytes(), np.array(number, "<u4").tobytes(), np.array([len(x) for x in texts], "<u4").tobytes(), *texts])
            for column, value in zip(out, (s, 0, squeeze(body)), strict=True):
                column.append(value)
        return _rows(_PACKED, out)

    return run


class Levels:
    """A logarithmic family of suffix arrays: sorted distinct windows with the smallest document that has each."""

    def __init__(self) -> None:
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []

    def scan(self, keys: np.ndarray) -> np.ndarray:
        """The smallest document in any level for each of the sorted keys, or the largest integer."""
        least = np.full(len(keys), np.iinfo(np.int64).max)
        for known, docs in self.levels:
            at = np.searchsorted(known, keys)
            at[at == len(known)] = 0
            hit = known[at] == keys
            least[hit] = np.minimum(least[hit], docs[at[hit]])
        return least

    def add(self, keys: np.ndarray, docs: np.ndarray) -> None:
        """A new level; levels of equal size (by powers of two) merge."""
        self.levels.append((keys, docs))
        while len(self.levels) > 1 and len(self.levels[-2][0]).bit_length() <= len(self.levels[-1][0]).bit_length():
            (a, da), (b, db) = self.levels.pop(), self.levels.pop()
            self.levels.append(least_by_key(np.concatenate([a, b]), np.concatenate([da, db]))[:2])


def least_by_key(keys: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct keys, the smallest document of each, and each row's place among them."""
    order = np.argsort(keys, kind="stable")
    keys, sorted_docs = keys[order], docs[order]
    new = np.concatenate([[True], keys[1:] != keys[:-1]])
    start = np.flatnonzero(new)
    place = np.empty(len(keys), np.int64)
    place[order] = np.cumsum(new) - 1
    return keys[start], np.minimum.reduceat(sorted_docs, start), place


def _match(buckets: int):
    """Ranges of each document that are covered by windows of smaller documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts: dict[bytes, int] = {}
        number, keys, at = [], [], []
        for batch in batches:
            for body in map(zstandard.ZstdDecompressor().decompress, _column(batch, "payload")):
                n_texts, n = (int(x) for x in np.frombuffer(body, "<u4", 2))
                place = 8
                keys.append(np.frombuffer(body, "<i8", n, place))
                place += 8 * n
                at.append(np.frombuffer(body, "<u4", n, place).astype(np.int64))
                place += 4 * n
                local = np.frombuffer(body, "<u4", n, place)
                place += 4 * n
                size = np.frombuffer(body, "<u4", n_texts, place)
                place += 4 * n_texts
                known = np.empty(n_texts, np.int64)
                for i, m in enumerate(size.tolist()):
                    known[i] = texts.setdefault(body[place : place + m], len(texts))
                    place += m
                number.append(known[local])
        if not texts:
            return
        number, keys, at = np.concatenate(number), np.concatenate(keys), np.concatenate(at)
        fragments = list(texts)
        del texts
        size = np.array([len(x) for x in fragments])
        least = np.full(len(fragments), np.iinfo(np.int64).max)
        np.minimum.at(least, number, keys)
        later = keys > least[number]  # the same fragment is in a smaller document
        doc, start, end = [keys[later]], [at[later]], [at[later] + size[number[later]]]
        own = np.flatnonzero(~later)
        own = own[np.argsort(number[own], kind="stable")]
        bounds = np.searchsorted(number[own], np.arange(len(fragments) + 1))
        levels, order, i = Levels(), np.argsort(least, kind="stable"), 0
        windows = np.cumsum(size[order] - WINDOW + 1)
        while i < len(order):
            j = max(i + 1, int(np.searchsorted(windows, (windows[i - 1] if i else 0) + BATCH_WINDOWS, "right")))
            batch = order[i:j]
            data = np.frombuffer(b"".join([fragments[f] for f in batch]), np.uint8)
            n = size[batch] - WINDOW + 1
            base = np.concatenate([[0], np.cumsum(size[batch])[:-1]])
            offset = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            window = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(data, WINDOW)[np.repeat(base, n) + offset]).view(f"S{WINDOW}").ravel()
            owner = np.repeat(batch, n)
            distinct, docs, place = least_by_key(window, least[owner])
            earlier = np.minimum(levels.scan(distinct), docs)
            hit = np.flatnonzero(earlier[place] < least[owner])
            levels.add(distinct, docs)
            if len(hit):
                f, o = owner[hit], offset[hit]
                new = np.concatenate([[True], (f[1:] != f[:-1]) | (o[1:] != o[:-1] + 1)])
                a = np.flatnonzero(new)
                b = np.concatenate([a[1:], [len(hit)]]) - 1
                times = bounds[f[a] + 1] - bounds[f[a]]
                which = own[np.repeat(bounds[f[a]], times) + np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times)]
                doc.append(keys[which])
                start.append(at[which] + np.repeat(o[a], times))
                end.append(at[which] + np.repeat(o[b], times) + WINDOW)
            i = j
        doc, ranges = np.concatenate(doc), np.stack([np.concatenate(start), np.concatenate(end)], axis=1).astype("<u4")
        if len(doc):
            yield _rows(_BUNDLE, list(_bundles(doc, ranges, buckets)))

    return run


def merge_ranges(packed: bytes | None) -> list[tuple[int, int]]:
    """Maximal runs of covered bytes."""
    if not packed:
        return []
    r = np.frombuffer(packed, "<u4").reshape(-1, 2).astype(np.int64)
    r = r[np.argsort(r[:, 0], kind="stable")]
    end = np.maximum.accumulate(r[:, 1])
    new = np.concatenate([[True], r[1:, 0] > end[:-1]])
    start = np.flatnonzero(new)
    return list(zip(r[start, 0].tolist(), end[np.concatenate([start[1:], [len(r)]]) - 1].tolist(), strict=True))


def covered_ranges(docs: DataFrame) -> DataFrame:
    """key (doc_id, a null one is the smallest), text and covers: packed (start, end) byte ranges, possibly overlapping.

    Null and short texts have none. Rows of one doc_id don't cover each other.
    """
    spark = docs.sparkSession
    parts = shuffle_partitions(spark)
    shards = 4 * parts
    texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_LEAST)).alias("key"), F.col("text").cast("string").alias("text"))
    asked = map_arrow(texts, _ask(shards, parts), PACKED)
    answers = map_arrow(asked.repartition(parts, "key"), _answer(parts), BUNDLE)
    told = map_arrow(answers.repartition(parts, "key"), _unbundle, VALUES).withColumnRenamed("values", "told")
    cut = map_arrow(texts.join(told, "key", "left"), _cut(shards), PACKED)
    found = map_arrow(cut.repartition(shards, "key"), _match(parts), BUNDLE)  # a task holds its shards' windows
    covers = map_arrow(found.repartition(parts, "key"), _unbundle, VALUES).withColumnRenamed("values", "covers")
    return texts.join(covers, "key", "left")


REMOVED = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row; a null text is empty."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            out: list[list] = [[], [], [], [], []]
            for key, text, covers in zip(_column(batch, "key"), _column(batch, "text"), _column(batch, "covers"), strict=True):
                data, runs = (text or "").encode(), merge_ranges(covers)
                row = (None if key == _LEAST else key, len(data), sum(b - a for a, b in runs), len(runs), hashlib.sha256(remove(data, runs)).hexdigest())
                for column, value in zip(out, row, strict=True):
                    column.append(value)
            yield _rows(schema, out)

    return map_arrow(covered_ranges(docs), run, REMOVED)


def remove(data: bytes, runs: list[tuple[int, int]]) -> bytes:
    """The bytes outside the runs."""
    return b"".join(data[a:b] for a, b in zip([0, *(b for _, b in runs)], [*(a for a, _ in runs), len(data)], strict=True))
