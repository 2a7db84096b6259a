"""Questions about stored documents and their results. Ties are always broken by id, which gives one answer where there could be several."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def usage(logs: DataFrame) -> DataFrame:
    """One row, also without any log: calls, pages, cost."""
    return logs.agg(F.count("*").alias("total_calls"), F.coalesce(F.sum("total_pages"), F.lit(0)).cast("long").alias("total_pages"), F.round(F.coalesce(F.sum("llm_cost"), F.lit(0.0)), 4).alias("total_llm_cost"), F.lit("all_time").alias("period"))


def lookup(table: DataFrame, key: str, value) -> DataFrame:
    return table.where(F.col(key) == value).limit(1)


def latest(children: DataFrame, parent: str, created: str, key: str) -> DataFrame:
    """Each parent's newest child: one aggregation, no sort of all children."""
    row = F.struct(*[F.col(c) for c in children.columns])
    return children.groupBy(F.col(parent).alias("__p")).agg(F.max_by(row, F.struct(created, key)).alias("r")).select("r.*")


def listing(table: DataFrame, created: str, key: str, skip: int = 0, limit: int = 20) -> DataFrame:
    """Newest first; equal times by key."""
    return table.orderBy(F.desc(created), key).offset(skip).limit(limit)


def page_count(total: Column, limit: int) -> Column:
    return F.ceil(total / limit).cast("long")


def with_context(documents: DataFrame, texts: DataFrame, results: DataFrame) -> DataFrame:
    """Documents with their recognised text (required), and kind and data of their results (unknown and {} if there are none)."""
    out = documents.join(texts, "document_id").join(results, "document_id", "left")
    return out.withColumns({"doc_type": F.coalesce("doc_type", F.lit("unknown")), "extracted_data": F.coalesce("extracted_data", F.lit("{}"))})


def newest_children(children: DataFrame, parent: str, created: str, key: str, most: int = 10) -> DataFrame:
    """Each parent's newest children, numbered; Spark limits the groups before it shuffles them."""
    w = Window.partitionBy(parent).orderBy(F.desc(created), key)
    return children.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= most)


def having(documents: DataFrame, results: DataFrame, doc_type: str) -> DataFrame:
    return documents.join(results.where(F.col("doc_type") == doc_type), "document_id", "left_semi")


def json_above(results: DataFrame, path: str, least: int) -> DataFrame:
    """Rows whose JSON number at the path is greater; what is no number is no match."""
    return results.where(F.get_json_object("extracted_data", path).try_cast("int") > least)


def expire(documents: DataFrame, now: Column, days: int = 90) -> DataFrame:
    """Documents without those that failed longer ago; rows whose state or time is null stay."""
    old = (F.col("status") == "failed") & (F.col("created_at") < now - F.make_dt_interval(F.lit(days)))
    return documents.where(~F.coalesce(old, F.lit(False)))


def without_orphans(children: DataFrame, documents: DataFrame) -> DataFrame:
    """Children whose document exists; those without a document_id stay, as they are no orphan of any."""
    return children.where("document_id is null").unionByName(children.join(documents, "document_id", "left_semi").select(*children.columns))


def cascade(table: DataFrame, deleted: DataFrame) -> DataFrame:
    """Rows that don't belong to deleted documents; use it on documents and on each table below them."""
    return table.join(deleted, "document_id", "left_anti")


def overlay(data: Column, confirmed: Column) -> Column:
    """Maps: data overlaid by what was confirmed and by status active."""
    status = F.create_map(F.lit("status"), F.lit("active"))
    kept = F.map_filter(data, lambda k, _: ~F.array_contains(F.map_keys(confirmed), k) & (k != "status"))
    return F.map_concat(kept, F.map_filter(confirmed, lambda k, _: k != "status"), status)


def record_type(doc_type: Column) -> Column:
    return F.when(doc_type == "lease_contract", "lease").when(doc_type == "repair_quote", "repair").when(doc_type == "id_card", "tenant")


def risk(kind: str, field: str, severity: str, message: str) -> Column:
    return F.struct(F.lit(kind).alias("type"), F.lit(field).alias("field"), F.lit(severity).alias("severity"), F.lit(message).alias("message"))


def lease_risks(today: Column) -> Column:
    """Risks of a lease, from columns landlord_name, tenant_name, rent, deposit, lease_start, lease_end."""
    checks = [(F.coalesce(F.col(f).cast("string"), F.lit("")) == "", risk("missing_field", f, "warning", f"{f} is missing")) for f in ("landlord_name", "tenant_name", "rent", "deposit", "lease_start", "lease_end")]
    checks += [(F.col(f) == 0, risk("abnormal_value", f, "error", f"{f} is zero")) for f in ("rent", "deposit")]
    checks += [
        (F.col("lease_start") > F.col("lease_end"), risk("invalid_range", "lease_start", "error", "the lease ends before it starts")),
        (F.col("lease_end") < today, risk("expired", "lease_end", "warning", "the lease has ended")),
        ((F.col("deposit") > 0) & (F.col("deposit") < 2 * F.col("rent")), risk("abnormal_value", "deposit", "warning", "the deposit is below two months' rent")),
    ]
    return F.array_compact(F.array(*[F.when(c, r) for c, r in checks]))


def quote_risks(today: Column, years: int = 2) -> Column:
    """Risks of a quote, from columns vendor_name, total_amount, quote_date."""
    checks = [(F.coalesce(F.col(f).cast("string"), F.lit("")) == "", risk("missing_field", f, "warning", f"{f} is missing")) for f in ("vendor_name", "total_amount", "quote_date")]
    checks += [(F.col("total_amount") == 0, risk("abnormal_value", "total_amount", "error", "total_amount is zero"))]
    checks += [(F.col("quote_date") > today, risk("abnormal_value", "quote_date", "warning", "quote_date is in the future")), (F.add_months("quote_date", 12 * years) < today, risk("abnormal_value", "quote_date", "info", "quote_date is long ago"))]
    return F.array_compact(F.array(*[F.when(c, r) for c, r in checks]))


def identity_risks(today: Column) -> Column:
    """Risks of an identity card, from columns name, national_id, birth_date."""
    checks = [(F.coalesce(F.col(f).cast("string"), F.lit("")) == "", risk("missing_field", f, "error", f"{f} is missing")) for f in ("name", "national_id", "birth_date")]
    checks += [(~F.col("national_id").rlike(r"^[A-Z][0-9]{9}$"), risk("invalid_format", "national_id", "error", "national_id has no valid form")), (F.add_months("birth_date", 12 * 120) < today, risk("abnormal_value", "birth_date", "warning", "older than 120 years"))]
    return F.array_compact(F.array(*[F.when(c, r) for c, r in checks]))


def with_source(records: DataFrame, documents: DataFrame) -> DataFrame:
    """Records with id and file name of the document that they came from."""
    source = documents.select(F.col("document_id").alias("source_document_id"), F.struct(F.col("document_id").alias("id"), "file_name").alias("source_document"))
    return records.join(source, "source_document_id")


def filtered_listing(table: DataFrame, status: str | None = None, doc_type: str | None = None, page: int = 1, limit: int = 20, created: str = "created_at", key: str = "document_id") -> DataFrame:
    """A page of the listing of what has that status and kind; None asks for all."""
    for name, value in (("status", status), ("document_type", doc_type)):
        table = table if value is None else table.where(F.col(name) == value)
    return listing(table, created, key, (page - 1) * limit, limit)


def nested(documents: DataFrame, children: dict[str, DataFrame], created: str = "created_at", key: str = "id", most: int = 10) -> DataFrame:
    """Documents with an array of their newest children of each kind, newest first; an empty one if there are none."""
    for name, rows in children.items():
        columns = [c for c in rows.columns if c != "document_id"]
        one = newest_children(rows, "document_id", created, key, most).groupBy("document_id")
        got = one.agg(F.transform(F.sort_array(F.collect_list(F.struct("rn", *columns))), lambda x: F.struct(*[x[c].alias(c) for c in columns])).alias(name))
        documents = documents.join(got, "document_id", "left").withColumn(name, F.coalesce(name, F.array().cast(got.schema[name].dataType)))
    return documents


def record_error(document_id: Column, status: Column, doc_type: Column) -> Column:
    """Why no record can be made: 404 without a document, 425 before it is completed, 400 for a kind that has no record."""
    return F.when(document_id.isNull(), 404).when(F.coalesce(status, F.lit("")) != "completed", 425).when(record_type(doc_type).isNull(), 400)
