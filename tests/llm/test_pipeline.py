"""The stages, each against what its input demands."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_learned import brute_components

P = pytest.importorskip("public_tokenizers")


def test_stages(spark, small, tmp_path):
    import tiktoken

    from foliant.llm import byte_bpe, mixing

    docs, kept = spark.read.parquet(f"{small}/documents.parquet"), []
    junk = docs.limit(1).withColumns({"doc_id": F.lit(-5).cast("long"), "text": F.lit("123 456 !!")})
    docs = docs.unionByName(junk)
    for i, (name, work) in enumerate(corpus_pipeline.STAGES):
        out = work(spark, docs, small)
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept.append(docs)
        if i < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == corpus_pipeline.COLUMNS
    ids = [sorted(r.doc_id for r in d.select("doc_id").collect()) for d in kept]
    language, exact, near, mixed = kept[:4]
    assert -5 not in ids[0] and len(ids[0]) >= 190
    last: dict = {}
    for r in language.collect():
        last[r.text] = max(last.get(r.text, -1), r.doc_id)
    assert ids[1] == sorted(last.values())
    groups = brute_components([(r.doc_id, r.text) for r in exact.collect()])
    assert ids[2] == sorted(i for i, (n, c) in groups.items() if i == c or not n)
    copies = {r.doc_id: r.copies for r in mixing.mix(near).collect()}
    assert ids[3] == sorted(i for i, n in copies.items() for _ in range(n))
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.read_ranks(P.path("byte_bpe_50k.tiktoken")), special_tokens={})
    want = sorted((r.doc_id, hashlib.sha256(np.array(enc.encode_ordinary(r.text), "<u4").tobytes()).hexdigest(), hashlib.sha256(r.text.encode()).hexdigest()) for r in mixed.collect())
    assert sorted((r.doc_id, r.ids_sha256, r.decoded_sha256) for r in kept[4].collect()) == want


def test_stages_take_anything(spark, small, tmp_path):
    """Nulls in any column, empty and very long texts, ties, repeated rows: each stage keeps the columns, and what it must."""
    prose = spark.read.parquet(f"{small}/documents.parquet").select("text").first().text
    rows = [(1, prose, "en", "a", 1), (1, prose, "en", "a", 1), (None, prose + " more", None, None, None), (None, prose, None, "a", None), (2, None, None, None, 0), (3, "", "en", "b", 0), (4, (prose + " ") * 400, "en", "b", 9), (5, "zz", None, "b", 2), (5, "zz", None, "b", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name, work in corpus_pipeline.STAGES:
        assert work(spark, docs.limit(0), small).count() == 0, name
        alone = work(spark, docs, small)
        alone.write.parquet(str(tmp_path / f"alone-{name}"))
    read = lambda name: spark.read.parquet(str(tmp_path / f"alone-{name}")).collect()
    assert {r.doc_id for r in read("language_id")} >= {1, None, 4} and not {2, 3} & {r.doc_id for r in read("language_id")}
    kept = read("exact_dedup")
    assert len(kept) == len({t or "" for _, t, *_ in rows}) and sorted(r.text or "" for r in kept) == sorted({t or "" for _, t, *_ in rows})
    assert {r.doc_id for r in read("jaccard_join")} == {1, 2, 3, 5}  # a text repeated has nearly the same set
    assert {r.doc_id for r in read("mix_sources")} <= {None, 1, 2, 3, 4, 5} and all((r.text or "") in {t or "" for _, t, *_ in rows} for r in read("mix_sources"))
    assert sorted(r.n_tokens for r in read("byte_bpe"))[:2] == [0, 0] and len(read("byte_bpe")) == len(rows)
