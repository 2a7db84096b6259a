"""A corpus pipeline of five stages over documents.

Each stage takes (spark, docs, sf_dir); all but the last return the columns of
documents. Stage results are written as Parquet and read again for the next.
Language models are learnt from the documents of sf_dir whose crc32 of doc_id
leaves another remainder than 2 modulo 4, as in the query of that operator.

Defined cases: null and empty texts have no language, so the first stage rejects
them; given to a later stage alone, they are equal texts (exact dedup), stay (near
duplicates: they are linked with nothing), are dealt like others though they add
no words (mix), and have no tokens. Null doc_ids are the smallest in exact dedup, and go in
near duplicates where a document with an id is in the group. Rows that are equal
in id and text are one for exact dedup, and stay or go together as near duplicates.
Ties are broken as in the operators. Texts of any length are read whole, an empty
table gives an empty result, and columns besides those of documents are dropped
by the first stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from foliant.llm import byte_bpe, exact_dedup, jaccard_join, langid, mixing
from foliant.llm.common import held_out, stage

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A document of which no language wrote this share of its words is rejected, like one without letters.
LEAST_SHARE = 0.3


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language that can be told; lang becomes the predicted one."""
    known = spark.read.parquet(f"{sf_dir}/documents.parquet").where(~held_out())
    found = langid.identify(docs.select(*COLUMNS), langid.train(known)).where((f"lang_pred <> '{langid.UNDETERMINED}' and score >= {LEAST_SHARE}"))
    return found.select("doc_id", "text", found["lang_pred"].alias("lang"), "source", "n_chars")


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest doc_id."""
    return exact_dedup.keep_first(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a similarity of 0.75 of their five-word shingles the one with the smallest doc_id."""
    return jaccard_join.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix takes it."""
    return mixing.apply_mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded bytes of each row."""
    import public_tokenizers

    return byte_bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact),
    ("jaccard_join", near_duplicates),
    ("mix_sources", mix_sources),
    ("byte_bpe", encode),
]

#: Learnt languages, sampling and token ids are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, work in STAGES[:-1]:
        docs = stage(work(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
