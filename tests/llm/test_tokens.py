import hashlib
import io
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from vellum.llm import bpe, token_store
from vellum.llm.queries import tokenizer_path

from tests.llm.conftest import rows_of

PATH = tokenizer_path()


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


PARTS = ["a", "e", "the", "  ", " ", "\n", "\t", "'s", "'ll", "é", "ß", "中", "🙂", "1", "23", "\x1c", "\x85", "　", "<|endoftext|>", "!!", "ab", "aaaa", "́", "Ⅷ", "²", "​", "\r\n", "A", "\x00"]


def test_encoding_and_decoding_equal_the_library(library):
    v, rnd = bpe.vocabulary(PATH), random.Random(1)
    texts = ["".join(rnd.choice(PARTS) for _ in range(rnd.randint(0, 14))) for _ in range(4000)]
    texts += ["a" * 3000, "ab" * 2000, "é" * 1000, " " * 700, "x\n" * 300, " lead", "trail ", "a b  c \n d"]
    for t in texts:
        expected = library.encode(t, add_special_tokens=False).ids
        ids = v.encode(t)
        assert np.frombuffer(ids, "<u4").tolist() == expected, t
        assert v.decode(ids) == library.decode(expected, skip_special_tokens=False), t
    assert token_store.encoder(PATH).encode(texts[0]) == v.encode(texts[0])
    for t in texts:
        assert token_store.encoder(PATH).encode(t) == v.encode(t)


def test_a_full_table_of_kept_chunks_starts_again(library, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_ENTRIES", 3)
    v = bpe.Vocabulary(PATH)
    for t in ("one two three four five", "six seven one two", "one two three four five"):
        assert np.frombuffer(v.encode(t), "<u4").tolist() == library.encode(t, add_special_tokens=False).ids


@pytest.mark.parametrize("entries", [300_000, 2])
def test_batches_equal_the_library(library, monkeypatch, entries):
    """Texts of both kinds in one batch, nulls among them, with tables that hold all chunks or start anew for each slice."""
    monkeypatch.setattr(bpe, "CACHE_ENTRIES", entries)
    rnd = random.Random(2)
    texts = [None, "", " ", "one", "one two one two", "one two\nthree four", "x" * 200 + " y", "a <|endoftext|> b", "tail\u2003 of\x85 it"]
    texts += ["".join(rnd.choice(PARTS) for _ in range(rnd.randint(0, 30))) for _ in range(300)] + [" ".join(rnd.choice(["red", "blue", "it's", "é🙂", "x\ny", "42"]) for _ in range(40)) for _ in range(50)]
    expected = [library.encode(t or "", add_special_tokens=False).ids for t in texts]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])
    for encoder in (token_store.LibraryEncoder(PATH), bpe.Vocabulary(PATH)):
        found = []
        for part, own in bpe.slices(batch, "text", 500):
            if isinstance(encoder, bpe.Vocabulary):
                ids, bounds = encoder.encode_batch(own)
                found += [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            else:
                found += [x.tolist() for x in encoder.encode_batch(own)]
            assert part.num_rows == len(own)
        assert found == expected


@pytest.mark.parametrize("which", ["documents", "odd"])
def test_digests(which, request, library):
    df = request.getfixturevalue(which)
    expected = []
    for r in df.select("doc_id", "text").collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        expected.append((r.doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
    assert rows_of(bpe.digests(df, PATH), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == sorted(expected, key=repr)


def test_documents_keep_their_columns_and_decode_back(odd):
    out = bpe.decode_documents(bpe.encode_documents(odd, PATH), PATH)
    assert {"doc_id", "text", "lang", "n_tokens", "ids", "decoded", "secrets"} <= set(out.columns)
    assert out.filter(F.coalesce("text", F.lit("")) != F.col("decoded")).count() == 0
    assert dict(out.dtypes)["ids"] == "binary"


@pytest.mark.parametrize("which", ["documents", "odd"])
def test_token_files(which, request, library):
    df = request.getfixturevalue(which)
    rows = sorted(((r.doc_id is not None, r.doc_id or 0, r.text is not None, r.text or "") for r in df.select("doc_id", "text").collect()), key=lambda r: (r[0], r[1], r[2], r[3].encode()))
    expected, start = [], 0
    for there, doc_id, _, text in rows:
        ids = np.array([*library.encode(text, add_special_tokens=False).ids, 0], "<u4").tobytes()
        expected.append((doc_id if there else None, start, len(ids) // 4, zlib.crc32(ids)))
        start += len(ids) // 4
    assert rows_of(token_store.report(df, PATH), "doc_id", "start", "n_tokens", "ids_crc32") == sorted(expected, key=repr)


def test_small_files_roll_over(documents):
    store = token_store.write_store(documents, PATH, file_bytes=20_000)
    assert len(store.files) > 5 and store.dictionary
    back = store.read().orderBy("start").collect()
    assert [r.start for r in back] == [0, *np.cumsum([r.n_tokens for r in back])[:-1]]
    assert [r.doc_id for r in back] == sorted(r.doc_id for r in back)


def test_one_document_is_read_alone():
    sink = io.BytesIO()
    w = token_store.FileWriter(sink, b"", 2)
    for i in range(5):
        w.add(i, np.arange(i, dtype="<u4"))
    w.close()
    r = token_store.FileReader(sink, b"")
    assert len(r) == 5 and np.frombuffer(r.ids(3), "<u4").tolist() == [0, 1, 2]
    with pytest.raises(ValueError):
        token_store.FileReader(sink, b"other")


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert token_store.report(empty, PATH).collect() == []
    assert bpe.digests(empty, PATH).collect() == []
