"""Token-id files: each document's ids compressed alone with a shared zstandard dictionary.

A file has a header (magic, sha256 of the dictionary, bytes per id), one frame for
each document, and a footer with doc ids, token counts and the offset of each frame,
so that one short document is read without the rest. The dictionary is trained on the
serialised ids of a bounded sample of documents and lies beside the files; files name
it by hash. Files hold ascending doc_id ranges, in ascending order of file number.

Files are written by tasks under a name of their own attempt; only names that reach the
manifest count, so a lost executor or a second attempt leaves nothing wrong behind.
"""

from __future__ import annotations

import hashlib
import io
import json
import os
import struct
import uuid
import zlib
from collections.abc import Iterator
from itertools import accumulate, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.llm.bpe import ChunkEncoder, flat, slices
from vellum.llm.common import as_documents, map_arrow, materialise, resident, scratch_path

MAGIC = b"VTOK\x01"
SAMPLE_DOCS = 400
SAMPLE_CHARS = 16_000
DICTIONARY_BYTES = 64 * 1024
FILE_BYTES = 128 << 20
_HEAD = struct.Struct("<5s32sB")
_TAIL = struct.Struct("<QQ")


class LibraryEncoder:
    """Ids by the tokenizers library. Chunks between single spaces are encoded once, if the vocabulary is of
    the byte-level kind whose pattern always cuts there; texts of other kinds are encoded whole."""

    def __init__(self, path: str):
        # Each task has a core of its own; the library's thread pool would only contend with other tasks.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        special = [x["content"] for x in spec.get("added_tokens") or []]
        self.by_chunks = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not spec.get("normalizer") and not any(c.isspace() for s in special for c in s) and not any(x.get("lstrip") or x.get("rstrip") for x in spec.get("added_tokens") or [])
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        line = self._one_by_one(["\n"])[0]
        self.line_end = int.from_bytes(line, "little") if self.by_chunks and len(line) == 4 else None
        self.chunks = ChunkEncoder(self._encode)

    def _one_by_one(self, texts: list[str]) -> list[bytes]:
        return [struct.pack(f"<{len(i)}I", *i) for i in (x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False))]

    def _encode(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the chunks one after the other, and how many each has. If all are a space and a word, they go to the library
        in long texts, a word a line: the pattern cuts before a space, the line end between is one token, and no such
        chunk holds a line end."""
        plain = [self.line_end is not None and c[:1] == " " and c.split() == [c[1:]] for c in chunks]
        if not all(plain):
            return flat(self._mixed(chunks, plain))
        ids, size = [], []
        for at in range(0, len(chunks), 2000):
            some = np.array(self.tokenizer.encode_batch_fast(["\n".join(chunks[at : at + 2000])], add_special_tokens=False)[0].ids, "<u4")
            cut = some == self.line_end
            ids.append(some[~cut])
            size.append(np.diff(np.concatenate([[-1], np.flatnonzero(cut), [len(some)]])) - 1)
        return np.concatenate(ids), np.concatenate(size)

    def _mixed(self, chunks: list[str], plain: list[bool]) -> list[bytes]:
        lined, others = [c for c, p in zip(chunks, plain, strict=True) if p], [c for c, p in zip(chunks, plain, strict=True) if not p]
        ids, size = self._encode(lined) if lined else (None, np.empty(0, np.int64))
        bounds = np.concatenate([[0], np.cumsum(size)]).tolist()
        one, other = iter(ids[a:b].tobytes() for a, b in pairwise(bounds)), iter(self._one_by_one(others))
        return [next(one) if p else next(other) for p in plain]

    def encode(self, text: str) -> bytes:
        """Ids of one text as little-endian unsigned 32-bit integers."""
        return self.chunks.ids(text) if self.by_chunks else self._one_by_one([text])[0]

    def encode_batch(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """Ids of each text."""
        if not self.by_chunks:
            yield from (np.frombuffer(self.encode(t or ""), "<u4") for t in texts.to_pylist())
            return
        ids, bounds = self.chunks.batch(texts)
        yield from (ids[a:b] for a, b in pairwise(bounds.tolist()))


def encoder(path: str) -> LibraryEncoder:
    return resident(("encoder", path), lambda: LibraryEncoder(path))


def file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    """Arrow's file system for a folder as Spark names it (file:, hdfs:, s3a:, gs:)."""
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    if "://" not in uri:
        return pafs.LocalFileSystem(), uri
    return pafs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1))


def train_dictionary(docs: DataFrame, tokenizer_path: str, sample_docs: int = SAMPLE_DOCS, sample_chars: int = SAMPLE_CHARS) -> bytes:
    """A dictionary from about ``sample_docs`` documents (at most twice as many), drawn by hash, ``sample_chars`` of each;
    empty if there is too little to train on. It changes the size of files, never their content."""
    drawn = F.pmod(F.xxhash64("doc_id", "text"), F.lit(max(1, docs.count()))) < sample_docs
    sample = docs.filter(drawn).select(F.substring("text", 1, sample_chars).alias("text")).limit(2 * sample_docs).collect()
    e = encoder(tokenizer_path)
    ids = [np.frombuffer(e.encode(r.text), "<u4").astype(f"<u{e.width}").tobytes() for r in sample]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, ids).as_bytes()
    except zstandard.ZstdError:
        return b""


def _compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    return zstandard.ZstdCompressor(level=3, **({"dict_data": zstandard.ZstdCompressionDict(dictionary)} if dictionary else {}))


def _decompressor(dictionary: bytes) -> zstandard.ZstdDecompressor:
    return zstandard.ZstdDecompressor(**({"dict_data": zstandard.ZstdCompressionDict(dictionary)} if dictionary else {}))


class FileWriter:
    """One file of frames; documents are added in order."""

    def __init__(self, sink: io.RawIOBase, dictionary: bytes, width: int):
        self.sink, self.width, self.pack = sink, width, _compressor(dictionary)
        self.sink.write(_HEAD.pack(MAGIC, hashlib.sha256(dictionary).digest(), width))
        self.at, self.doc_ids, self.counts, self.offsets = _HEAD.size, [], [], [_HEAD.size]

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        frame = self.pack.compress(ids.astype(f"<u{self.width}").tobytes())
        self.sink.write(frame)
        self.at += len(frame)
        self.doc_ids.append(doc_id)
        self.counts.append(len(ids))
        self.offsets.append(self.at)

    def close(self) -> None:
        """Footer: doc ids, whether each is there, token counts, offsets."""
        footer = b"".join(np.array(x, kind).tobytes() for x, kind in (([d or 0 for d in self.doc_ids], "<i8"), ([d is not None for d in self.doc_ids], "u1"), (self.counts, "<u4"), (self.offsets, "<u8")))
        self.sink.write(footer + _TAIL.pack(self.at, len(self.doc_ids)))


class FileReader:
    """Random access to the documents of a file."""

    def __init__(self, source, dictionary: bytes):
        self.source = source
        self.source.seek(0)
        magic, digest, self.width = _HEAD.unpack(self.source.read(_HEAD.size))
        if magic != MAGIC or digest != hashlib.sha256(dictionary).digest():
            raise ValueError("not a token file, or written with another dictionary")
        size = self.source.seek(0, 2)
        self.source.seek(size - _TAIL.size)
        at, n = _TAIL.unpack(self.source.read(_TAIL.size))
        self.source.seek(at)
        footer, place, parts = self.source.read(size - _TAIL.size - at), 0, []
        for kind, count in (("<i8", n), ("u1", n), ("<u4", n), ("<u8", n + 1)):
            parts.append(np.frombuffer(footer, kind, count, place))
            place += np.dtype(kind).itemsize * count
        ids, there, self.counts, self.offsets = parts
        self.doc_ids = [int(d) if t else None for d, t in zip(ids, there, strict=True)]
        self.unpack = _decompressor(dictionary)

    def __len__(self) -> int:
        return len(self.doc_ids)

    def ids(self, i: int) -> bytes:
        """Ids of the i-th document as little-endian unsigned 32-bit integers."""
        start, end = int(self.offsets[i]), int(self.offsets[i + 1])
        self.source.seek(start)
        raw = self.unpack.decompress(self.source.read(end - start), max_output_size=max(1, int(self.counts[i]) * self.width))
        return np.frombuffer(raw, f"<u{self.width}").astype("<u4").tobytes()


class TokenStore:
    """A folder of token files: ``dictionary`` and the manifest's (path, base, n_docs, n_tokens) in order."""

    def __init__(self, spark: SparkSession, folder: str, dictionary: bytes, files: list[tuple[str, int, int, int]]):
        self.spark, self.folder, self.dictionary, self.files = spark, folder, dictionary, files

    def read(self) -> DataFrame:
        """doc_id, start (ids before the document in the whole store), n_tokens, ids; a task takes whole files."""
        if not self.files:
            return self.spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids binary")
        sent = self.spark.sparkContext.broadcast(self.dictionary)
        todo = self.spark.createDataFrame([(p, b) for p, b, _, _ in self.files], "path string, base long").repartition(len(self.files), "path")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in batch.to_pylist():
                    fs, path = file_system(row["path"])
                    with fs.open_input_file(path) as f:
                        reader = FileReader(f, sent.value)
                        start = row["base"] + np.concatenate([[0], np.cumsum(reader.counts.astype(np.int64))])
                        for a in range(0, len(reader), 1000):
                            span = range(a, min(a + 1000, len(reader)))
                            ids = [reader.ids(i) for i in span]
                            yield pa.RecordBatch.from_arrays(
                                [pa.array([reader.doc_ids[i] for i in span], pa.int64()), pa.array(start[span.start : span.stop], pa.int64()), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())],
                                names=["doc_id", "start", "n_tokens", "ids"],
                            )

        return map_arrow(todo, run, "doc_id long, start long, n_tokens long, ids binary")


def write_store(docs: DataFrame, tokenizer_path: str, folder: str | None = None, end_id: int | None = 0, file_bytes: int = FILE_BYTES) -> TokenStore:
    """Encode every whole text and write token files in ascending doc_id order.

    A null text is empty; ``end_id`` (if not None) ends each document; a null doc_id comes first; rows of one
    doc_id are ordered by text. A task rolls to a new file beyond ``file_bytes``.
    """
    spark = docs.sparkSession
    docs = as_documents(docs)
    folder = folder or scratch_path(spark, "tokens")
    dictionary = train_dictionary(docs, tokenizer_path)
    fs, path = file_system(folder)
    fs.create_dir(path, recursive=True)
    with fs.open_output_stream(f"{path}/{hashlib.sha256(dictionary).hexdigest()}.dictionary") as f:
        f.write(dictionary)
    sent = spark.sparkContext.broadcast(dictionary)
    end = np.array([] if end_id is None else [end_id], "<u4")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e, part = encoder(tokenizer_path), TaskContext.get().partitionId()
        fs, path = file_system(folder)
        number, writer, out, name = 0, None, None, ""

        def done():
            writer.close()
            out.close()
            return pa.RecordBatch.from_pylist([{"part": part, "number": number, "path": f"{folder}/{name}", "n_docs": len(writer.doc_ids), "n_tokens": sum(writer.counts)}], schema=MANIFEST)

        for batch in batches:
            for part_of, texts in slices(batch, "text"):
                for doc_id, ids in zip(part_of.column(0).to_pylist(), e.encode_batch(texts), strict=True):
                    if writer is None:
                        name = f"{part:06d}-{number:04d}-{uuid.uuid4().hex}.tok"
                        out = fs.open_output_stream(f"{path}/{name}")
                        writer = FileWriter(out, sent.value, e.width)
                    writer.add(doc_id, np.concatenate([ids, end]))
                    if writer.at >= file_bytes:
                        yield done()
                        number, writer = number + 1, None
        if writer is not None:
            yield done()

    # Ranges by doc_id alone, so that no text is sampled for them; rows of one doc_id are in one range.
    ordered = docs.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    manifest = materialise(map_arrow(ordered, run, "part int, number int, path string, n_docs long, n_tokens long"), "manifest")
    rows = manifest.orderBy("part", "number").collect()  # one row for each file
    bases = [0, *accumulate(r.n_tokens for r in rows)]
    return TokenStore(spark, folder, dictionary, [(r.path, b, r.n_docs, r.n_tokens) for r, b in zip(rows, bases, strict=False)])


MANIFEST = pa.schema([("part", pa.int32()), ("number", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())])


def report(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, read back from the files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            crc = pa.array([zlib.crc32(x) for x in b.column(3).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns[:3], crc], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return map_arrow(write_store(docs, tokenizer_path).read(), run, "doc_id long, start long, n_tokens long, ids_crc32 long")
