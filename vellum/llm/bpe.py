"""Byte-level BPE encoding by backtracking over longest token matches, and decoding by an offset table.

Encoding a piece takes one Aho-Corasick pass that finds the longest token that
starts at each byte. The encoder then takes longest matches from left to right;
a token is accepted only if the pair (previous token, token) is compatible, that
is, if merging would leave the two apart. Otherwise it tries the token's longest
proper prefix token, and when none is left it takes the previous token back. A
bit for each byte position keeps dead ends from being entered twice, so that the
work is linear in the piece. The accepted sequence is the one that merging by
rank gives.

Texts are cut at single spaces between visible characters, where the pattern of
the vocabulary always cuts. Each distinct chunk of a batch of texts is looked up
once in a table of bounded size that a worker keeps, or else encoded.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from itertools import pairwise

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from vellum.llm.common import as_documents, map_columns, resident

SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Fixed value: the split pattern of the byte-level vocabulary, with white space spelled out.
PIECES = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
_CUT = re.compile(r"(?<=\S) (?=\S)")
_BLANK = r"\t-\r\x1c-\x1f \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
#: Texts with a single space that isn't between visible characters.
_ODD = rf"^[{_BLANK}]|[{_BLANK}]\z| [{_BLANK}]|[{_BLANK}] "
CACHE_ENTRIES = 300_000
CACHE_IDS = 3_000_000


def byte_symbols() -> list[str]:
    """The printable character that a byte-level vocabulary file uses for each byte."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    table = {b: chr(b) for b in shown}
    for n, b in enumerate(b for b in range(256) if b not in table):
        table[b] = chr(256 + n)
    return [table[b] for b in range(256)]


class Vocabulary:
    """A byte-level BPE vocabulary: tokens by merge rank, compatibility of pairs, offset table for decoding."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.special = {x["content"]: x["id"] for x in spec.get("added_tokens") or []}
        back = {c: b for b, c in enumerate(byte_symbols())}
        raw = lambda token: bytes(back[c] for c in token)
        ids = {raw(t): i for t, i in model["vocab"].items() if t not in self.special}
        # Ranks: single bytes first, then tokens in the order in which merges make them.
        ranked = [bytes([b]) for b in range(256)]
        rank = {t: r for r, t in enumerate(ranked)}
        self.left, self.right = list(range(256)), list(range(256))
        self.merged: dict[tuple[int, int], int] = {}
        for merge in model["merges"]:
            a, b = (raw(x) for x in (merge.split(" ") if isinstance(merge, str) else merge))
            if a + b not in rank:
                rank[a + b] = len(ranked)
                ranked.append(a + b)
                self.left.append(rank[a])
                self.right.append(rank[b])
            self.merged.setdefault((rank[a], rank[b]), rank[a + b])
        self.size = [len(t) for t in ranked]
        self.ids = [ids[t].to_bytes(4, "little") for t in ranked]
        self.automaton = ahocorasick.Automaton()
        for r, t in enumerate(ranked):
            self.automaton.add_word(t.decode("latin-1"), (len(t), r))
        self.automaton.make_automaton()
        self.shorter = [next((rank[t[:n]] for n in range(len(t) - 1, 0, -1) if t[:n] in rank), -1) for t in ranked]
        self._pairs: dict[int, bool] = {}
        self._cut_special = re.compile("(" + "|".join(re.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        by_id = {i: t for t, i in ids.items()} | {i: s.encode() for s, i in self.special.items()}
        lengths = np.array([len(by_id.get(i, b"")) for i in range(max(by_id) + 1)], np.int64)
        self.offsets = np.concatenate([[0], np.cumsum(lengths)])
        self.blob = np.frombuffer(b"".join(by_id.get(i, b"") for i in range(len(lengths))), np.uint8)
        self._chunks = ChunkEncoder(lambda chunks: flat([self._encode_chunk(c) for c in chunks]), self.encode, list(self.special))

    def compatible(self, a: int, b: int) -> bool:
        """Whether merging by rank leaves token ``a`` next to token ``b``: no merge across their border comes first."""
        key = a << 32 | b
        known = self._pairs.get(key)
        if known is None:
            if len(self._pairs) > 2_000_000:
                self._pairs.clear()
            known = self._pairs[key] = self._apart(a, b)
        return known

    def _apart(self, a: int, b: int) -> bool:
        # Undo the merges of both sides, latest first. A border pair merges if its rank is lower than that of
        # the merge that was undone last; among equal ranks the left one comes first.
        limit = 1 << 62
        while True:
            if self.merged.get((a, b), limit) < limit:
                return False
            undo_left = a > b
            for _ in range(2):
                if undo_left:
                    if self.size[a] > 1:
                        limit, a = a, self.right[a]
                        break
                elif self.size[b] > 1:
                    limit, b = b + 1, self.left[b]
                    break
                undo_left = not undo_left
            else:
                return True

    def encode_piece(self, piece: str) -> list[int]:
        """Ranks of one piece, given as its bytes in Latin-1."""
        n = len(piece)
        longest, length = [0] * n, [0] * n
        for end, (size, r) in self.automaton.iter(piece):
            start = end - size + 1
            if size > length[start]:
                length[start], longest[start] = size, r
        alive = bytearray(b"\1") * (n + 1)
        out: list[int] = []
        at, token = 0, longest[0]
        size, shorter, compatible = self.size, self.shorter, self.compatible
        while at < n:
            last = out[-1] if out else -1
            while token >= 0:
                end = at + size[token]
                if alive[end] and (last < 0 or compatible(last, token)):
                    out.append(token)
                    at = end
                    token = longest[at] if at < n else 0
                    break
                token = shorter[token]
            else:  # nothing fits here: take the last token back and go on with its prefixes
                alive[at] = 0
                token = out.pop()
                at -= size[token]
                token = shorter[token]
        return out

    def _encode_chunk(self, chunk: str) -> bytes:
        ids, out = self.ids, []
        for piece in PIECES.findall(chunk):
            out += [ids[r] for r in self.encode_piece(piece.encode("utf-8").decode("latin-1"))]
        return b"".join(out)

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers."""
        if self._cut_special is None or not any(s in text for s in self.special):
            return self._chunks.ids(text)
        return b"".join(self.special[x].to_bytes(4, "little") if x in self.special else self._chunks.ids(x) for x in self._cut_special.split(text))

    def encode_batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, and where those of each begin and end."""
        return self._chunks.batch(texts)

    def decode(self, ids: bytes) -> str:
        """Text of ids by the offset table; broken UTF-8 becomes U+FFFD."""
        i = np.frombuffer(ids, "<u4").astype(np.int64)
        start, end = self.offsets[i], self.offsets[i + 1]
        n = end - start
        stop = np.cumsum(n)
        at = np.arange(int(stop[-1]) if len(stop) else 0) + np.repeat(start - (stop - n), n)
        return self.blob[at].tobytes().decode("utf-8", "replace")


def flat(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Ids one after the other, and how many each part has."""
    return np.frombuffer(b"".join(parts), "<u4"), np.fromiter(map(len, parts), np.int64, len(parts)) // 4


class Table:
    """Chunks with their ids, as flat arrays."""

    def __init__(self, words: pa.Array | None = None, ids: np.ndarray | None = None, bounds: np.ndarray | None = None):
        self.words = pa.array([], pa.large_string()) if words is None else words
        self.ids = np.empty(0, "<u4") if ids is None else ids
        self.bounds = np.zeros(1, np.int64) if bounds is None else bounds

    def find(self, words: pa.Array) -> np.ndarray:
        """The place of each word, or -1."""
        return pc.fill_null(pc.index_in(words, value_set=self.words), -1).to_numpy(zero_copy_only=False).astype(np.int64)

    def part(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids and sizes of some entries."""
        size = self.bounds[at + 1] - self.bounds[at]
        end = np.cumsum(size)
        return self.ids[np.arange(int(size.sum())) + np.repeat(self.bounds[at] - (end - size), size)], size

    def add(self, words: pa.Array, ids: np.ndarray, size: np.ndarray) -> None:
        self.words = pa.concat_arrays([self.words, words])
        self.ids = np.concatenate([self.ids, ids])
        self.bounds = np.concatenate([self.bounds, self.bounds[-1] + np.cumsum(size)])


class Kept:
    """Tables of kept ids in two generations: a full young one becomes the old one, and what is used again moves back."""

    def __init__(self, encode):
        self.encode = encode
        self.young, self.old = Table(), Table()

    def find(self, words: pa.Array, before: str) -> np.ndarray:
        """The places of distinct words in the young table; unknown ones are encoded with ``before`` in front and added."""
        if len(self.young.words) > CACHE_ENTRIES or len(self.young.ids) > CACHE_IDS:
            self.old, self.young = self.young, Table()
        at = self.young.find(words)
        for known in (True, False):
            missing = np.flatnonzero(at < 0)
            if not len(missing):
                break
            rest = words.take(pa.array(missing))
            if known:
                place = self.old.find(rest)
                found = np.flatnonzero(place >= 0)
                missing, rest = missing[found], rest.take(pa.array(found))
                ids, size = self.old.part(place[found])
            else:
                ids, size = self.encode([before + x if x else "" for x in rest.to_pylist()])
            at[missing] = len(self.young.words) + np.arange(len(missing))
            self.young.add(rest, ids, size)
        return at


class ChunkEncoder:
    """Ids of texts from the ids of their chunks, of which each distinct one of a batch is looked up, or encoded and kept.

    Chunks begin at single spaces between visible characters. ``encode`` gives the ids of a list of chunks (see
    ``flat``), ``whole`` those of a text that isn't cut at single spaces alone; ``marks`` are strings that make a text
    such a one.
    """

    def __init__(self, encode, whole=None, marks: list[str] = ()):
        self.whole, self.marks = whole or self.ids, marks
        self.first, self.following, self.loose = Kept(encode), Kept(encode), Kept(encode)  # at a text's start, after a space (without it), of other texts

    def ids(self, text: str) -> bytes:
        """Ids of one text."""
        if not text:
            return b""
        parts = _CUT.split(text)
        parts[1:] = [f" {p}" for p in parts[1:]]
        found = pa.array(parts, pa.large_string()).dictionary_encode()
        at = self.loose.find(found.dictionary, "")
        return self.loose.young.part(at[found.indices.to_numpy()])[0].tobytes()

    def batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other, and where those of each begin and end (one more than there are texts)."""
        texts = pc.fill_null(texts, "")
        odd = pc.match_substring_regex(texts, _ODD)
        for mark in self.marks:
            odd = pc.or_(odd, pc.match_substring(texts, mark))
        odd = np.flatnonzero(odd.to_numpy(zero_copy_only=False))
        alone, size = flat([self.whole(texts[int(i)].as_py()) for i in odd])
        if len(odd):
            mask = np.zeros(len(texts), bool)
            mask[odd] = True
            texts = pc.if_else(pa.array(mask), "", texts)
        parts = pc.split_pattern(texts, " ")
        starts = parts.offsets.to_numpy().astype(np.int64)
        pieces, begin = parts.values, starts[:-1]
        later = np.ones(len(pieces), bool)
        later[begin] = False
        # Of each piece, where its ids begin in the ids of all tables together, and how many it has.
        each, from_ = np.empty(len(pieces), np.int64), np.empty(len(pieces), np.int64)
        every, offset = [alone], len(alone)
        for where, table, before in ((begin, self.first, ""), (np.flatnonzero(later), self.following, " ")):
            found = pieces.take(pa.array(where)).dictionary_encode()
            at = table.find(found.dictionary, before)[found.indices.to_numpy()]
            bounds = table.young.bounds
            each[where], from_[where] = bounds[at + 1] - bounds[at], bounds[at] + offset
            every.append(table.young.ids)
            offset += len(table.young.ids)
        each[begin[odd]], from_[begin[odd]] = size, np.cumsum(size) - size
        end = np.cumsum(each)
        ids = np.concatenate(every)[np.arange(int(end[-1]) if len(end) else 0) + np.repeat(from_ - (end - each), each)]
        return ids, np.concatenate([[0], end])[starts]


def slices(batch: pa.RecordBatch, column: str, most: int = 4 << 20) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """Parts of a batch with at most ``most`` bytes of texts (or one row), each with its column of texts."""
    texts = batch.column(batch.schema.get_field_index(column)).cast(pa.large_string())
    total = np.concatenate([[0], np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))])
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(total, total[at] + most, "right")) - 1)
        yield batch.slice(at, end - at), texts.slice(at, end - at)
        at = end
    pa.default_memory_pool().release_unused()


def vocabulary(path: str) -> Vocabulary:
    """The vocabulary of a file, kept by the process until it needs another large object."""
    return resident(("vocabulary", path), lambda: Vocabulary(path))


ENCODED = [T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType())]


def encode_documents(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """Add n_tokens and ids (little-endian unsigned 32-bit) of the whole text to every row.

    A null text is taken as empty: no ids. Rows repeat as they do in ``docs``; an empty table gives
    an empty one; columns of the same names are replaced.
    """

    def make():
        v = vocabulary(path)

        def work(batch: pa.RecordBatch) -> list:
            out: list[list] = [[], []]
            for _, texts in slices(batch, text):
                ids, bounds = v.encode_batch(texts)
                out[0] += np.diff(bounds).tolist()
                out[1] += [ids[a:b].tobytes() for a, b in pairwise(bounds.tolist())]
            return out

        return work

    return map_columns(docs, ENCODED, make)


def decode_documents(encoded: DataFrame, path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """Add the text of each row's ids; null ids give an empty text."""

    def make():
        v = vocabulary(path)

        def work(batch: pa.RecordBatch) -> list:
            return [[v.decode(x or b"") for x in batch.column(batch.schema.get_field_index(ids)).to_pylist()]]

        return work

    return map_columns(encoded, [T.StructField(text, T.StringType())], make)


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row, encoded and decoded in one pass."""

    def make():
        v = vocabulary(path)

        def work(batch: pa.RecordBatch) -> list:
            n, a, b = [], [], []
            for _, texts in slices(batch, "text"):
                ids, bounds = v.encode_batch(texts)
                n += np.diff(bounds).tolist()
                for start, end in pairwise(bounds.tolist()):
                    own = ids[start:end].tobytes()
                    a.append(hashlib.sha256(own).hexdigest())
                    b.append(hashlib.sha256(v.decode(own).encode("utf-8")).hexdigest())
            return [n, a, b]

        return work

    fields = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    return map_columns(as_documents(docs), fields, make, drop=("text",))
