"""Exact deduplication against a persistent digest index (built-in expressions only).

The index is a table bucketed by digest and sorted by it within each bucket. New
data goes in by parts, the largest doc_ids first: each part is reduced to one
row per digest, sort-merge anti-joined with the index and appended, so that only
the part is shuffled, never the index, and the row that brought a text in is the
one that stays. Rows in the index carry the name of their batch: a batch that is
given again under its name, as after a failure, gets the same answer.

Defined cases: a null text counts as empty; empty texts are equal; a null doc_id
is smaller than any other; of fully equal rows exactly one stays; texts of any
length are read whole; an empty table gives an empty result; other columns are
not read.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from foliant.llm.common import join_groups, shared_dir, stage


def digests(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(digest, doc_id, uid) of each row; uid tells equal rows apart."""
    return docs.select(
        F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256)).alias("digest"),
        F.col(doc_id).alias("doc_id"),
        F.monotonically_increasing_id().alias("uid"),
    )


class DigestIndex:
    """(digest, keep_id, batch) of every text seen so far. The number of buckets is that with which the table was made."""

    def __init__(self, spark: SparkSession, table: str, buckets: int = 16):
        self.spark, self.table, self.buckets = spark, table, buckets

    def exists(self) -> bool:
        return self.spark.catalog.tableExists(self.table)

    def read(self) -> DataFrame:
        return self.spark.table(self.table)

    def _write(self, rows: DataFrame, table: str) -> None:
        rows.repartition(self.buckets, "digest").write.format("parquet").bucketBy(self.buckets, "digest").sortBy("digest").mode("append").saveAsTable(table)

    def open(self, kind: str) -> None:
        """Make the table, empty, unless it is there; kind: the type of doc_id."""
        if self.exists():
            described = self.spark.sql(f"DESCRIBE TABLE EXTENDED {self.table}").where("col_name = 'Num Buckets'").first()
            self.buckets = int(described["data_type"]) if described else self.buckets
        else:
            self._write(self.spark.createDataFrame([], f"digest binary, keep_id {kind}, batch string"), self.table)

    def missing(self, part: DataFrame) -> DataFrame:
        """(digest, keep_id) of the part's digests that the index lacks, the largest doc_id of each; part as from digests()."""
        one = part.groupBy("digest").agg(F.max("doc_id").alias("keep_id"))
        return one.join(self.read().select("digest").hint("merge"), "digest", "left_anti")

    def append(self, part: DataFrame, batch: str) -> None:
        """Add what missing() gives. Repeated, it adds nothing more."""
        self.open(dict(part.dtypes)["doc_id"])
        self._write(self.missing(part).withColumn("batch", F.lit(batch)), self.table)

    def compact(self) -> None:
        """One sorted file a bucket again, after many appends have left several."""
        new = f"{self.table}_compact"
        self.spark.sql(f"DROP TABLE IF EXISTS {new}")
        self._write(self.read(), new)
        self.drop()
        self.spark.sql(f"ALTER TABLE {new} RENAME TO {self.table}")

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")


def index_buckets(rows: int, rows_per_bucket: int = 4_000_000) -> int:
    """Buckets for an index over so many rows: 16 at least, else so many that one holds about rows_per_bucket digests."""
    return max(16, -(-rows // rows_per_bucket))


def descending_parts(batch: DataFrame, parts: int) -> list:
    """Conditions that cut a batch into about equal ranges of doc_id, the largest first, nulls in the last; one for all where ids are no numbers."""
    if not isinstance(batch.schema["doc_id"].dataType, NumericType):
        return [F.lit(True)]
    at = batch.agg(F.percentile_approx("doc_id", [(parts - i) / parts for i in range(1, parts)], 1000)).first()[0] if parts > 1 else None
    cuts = sorted(set(at or []), reverse=True)
    return [(F.col("doc_id") >= low if low is not None else F.lit(True)) & (F.coalesce(F.col("doc_id") < high, F.lit(True)) if high is not None else F.lit(True)) for high, low in zip([None, *cuts], [*cuts, None])]


def dedup(docs: DataFrame, index: DigestIndex | None = None, batch: str | None = None, parts: int = 2) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    docs goes into the index in parts. With an index of earlier batches, a text
    that it holds keeps its earlier row, so that all rows of docs with that text
    have kept = false. group_size counts all rows of docs with that text. batch
    names docs in the index; given again under that name it gets the same
    answer. Without an index, one is made for this call, and dropped after it.
    """
    spark = docs.sparkSession
    shared_dir(spark)
    rows = stage(digests(docs), "digests")
    total = rows.count()
    own, name = index is None, batch or uuid.uuid4().hex
    index = index or DigestIndex(spark, f"digest_index_{uuid.uuid4().hex}", index_buckets(total))
    for part in descending_parts(rows, parts):
        index.append(rows.where(part), name)
    groups = rows.groupBy("digest").agg(F.max(F.struct("doc_id", "uid")).alias("largest"), F.count("*").alias("group_size"))
    groups = groups.join(index.read().hint("merge"), "digest").select("digest", "keep_id", "group_size", F.when(F.col("batch") == name, F.col("largest.uid")).alias("keep_uid"))
    out = join_groups(rows, stage(groups, "digest-groups"), "digest", "group_size", total)
    kept = F.coalesce(F.col("uid") == F.col("keep_uid"), F.lit(False))
    out = out.select("doc_id", "keep_id", "group_size", kept.alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))
    if own:  # its groups are written: the result needs it no more
        index.drop()
    return out


def keep_first(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """docs without the rows that dedup() drops, all columns kept."""
    decided = dedup(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")))
    kept = decided.where("kept").select(F.col("doc_id").alias("__id"), F.col("text_sha256").alias("__digest"))
    digest = F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256)
    out = docs.withColumn("__digest", digest).alias("d").join(kept.alias("k"), (F.col(f"d.{doc_id}").eqNullSafe(F.col("k.__id"))) & (F.col("d.__digest") == F.col("k.__digest")), "left_semi")
    repeated = decided.groupBy("doc_id", "text_sha256").count().where("count > 1").limit(1).count()
    if repeated:  # rows that are equal in id and text: a join can't tell them apart
        out = out.dropDuplicates([doc_id, "__digest"])
    return out.drop("__digest")
