import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from vellum.llm import bpe, secret_scan
from vellum.llm.queries import tokenizer_path

from tests.llm.test_dedup import components_by_brute_force
from tests.llm.test_texts import hits_by_brute_force, secrets_by_brute_force


def test_pipeline(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, sf)
        assert after.columns == docs.columns, name
        after = spark.createDataFrame(after.collect(), after.schema)
        assert after.join(before, "doc_id", "left_anti").count() == 0
        before = after
    out = corpus_pipeline.run(spark, sf)
    assert out.columns == [*docs.columns, "n_tokens", "ids"]
    assert 0 < out.count() < docs.count()
    back = bpe.decode_documents(out, tokenizer_path())
    assert back.filter("text <> decoded").count() == 0
    assert secret_scan.find_secrets(out.select("doc_id", "text")).filter(F.exists("secrets", lambda s: s["kind"] < 3)).count() == 0
    assert {tuple(sorted(r)) for r in [out.columns]} and out.filter("n_chars <> length(text)").count() == 0


def test_stages_on_odd_rows(spark, sf, odd):
    rows = odd.drop("n_tokens", "ids")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        rows = stage(spark, rows, sf)
        assert "secrets" in rows.columns, name
    ids = [r.doc_id for r in corpus_pipeline.encode(spark, rows, sf).collect()]
    assert len(ids) == len(set(ids)) and {6, 7} <= set(ids) and not {3, 4, 5} & set(ids)


LONG = [" ".join(f"{w}{i}" for i in range(40)) for w in ("river", "stone", "cloud", "grass", "amber")]
NO_IDS = [(None, LONG[0]), (None, LONG[1]), (None, LONG[1] + " more"), (1, LONG[2]), (2, LONG[2] + " more"), (2, LONG[3]), (2, LONG[3]), (3, LONG[0] + " more"), (4, LONG[4]), (4, LONG[4] + "\n")]


def test_near_dedup_decides_by_row(spark, sf):
    """Null and shared doc_ids: one row of each group of near copies stays, whatever else has its id."""
    df = spark.createDataFrame(NO_IDS, "doc_id long, text string")
    stays = [(r.doc_id, r.text) for r in corpus_pipeline.drop_near_duplicates(spark, df, sf).collect()]
    assert sorted((d or 0, t.split()[0]) for d, t in stays) == [(0, "river0"), (0, "stone0"), (1, "cloud0"), (2, "grass0"), (4, "amber0")]
    assert (None, LONG[0]) in stays and (1, LONG[2]) in stays and (2, LONG[3]) in stays
    again = corpus_pipeline.drop_near_duplicates(spark, df.orderBy("text").repartition(3), sf)
    assert sorted(map(repr, stays)) == sorted(repr((r.doc_id, r.text)) for r in again.collect())


def redacted_by_brute_force(text):
    out, at = [], 0
    for _, a, b in secrets_by_brute_force(text):
        if a >= at:
            out += [text[at:a], "[REDACTED]"]
        at = max(at, b)
    return "".join(out) + text[at:]


def test_run_equals_brute_force(spark, sf):
    """Given the documents that the language stage keeps, every later decision and the ids."""
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = [(r.doc_id, r.text) for r in corpus_pipeline.identify_language(spark, docs, sf).collect()]
    assert len(kept) > 0.8 * docs.count()
    assert not {d for d, t in kept} & {r.doc_id for r in docs.filter("text is null or not rlike(text, '\\\\p{L}')").collect()}
    least = {d for d, _, _, own in components_by_brute_force(kept, 5) if own}
    apart = [(d, t) for d, t in kept if d in least]
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    clean = {r[0] for r in hits_by_brute_force(apart, bench) if not r[-1]}
    library = Tokenizer.from_file(tokenizer_path())
    expected = []
    for d, t in apart:
        if d in clean:
            text = redacted_by_brute_force(t)
            expected.append((d, text, len(text), library.encode(text, add_special_tokens=False).ids))
    found = [(r.doc_id, r.text, r.n_chars, np.frombuffer(r.ids, "<u4").tolist()) for r in corpus_pipeline.run(spark, sf).collect()]
    assert sorted(found) == sorted(expected)
    assert len(expected) < len(apart) < len(kept)


def test_an_empty_table(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        rows = stage(spark, rows, sf)
    assert rows.collect() == []
