"""The stored tables: their columns, reading, appending and rewriting them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCHEMAS = {
    "documents": "document_id string, file_name string, file_url string, mime_type string, file_size int, status string, error_message string, created_at timestamp, updated_at timestamp",
    "document_ocr_results": "id string, document_id string, raw_text string, page_count int, ocr_confidence decimal(5,2), ocr_service string, processing_time int, created_at timestamp",
    "document_ai_results": "id string, document_id string, doc_type string, confidence decimal(5,2), summary string, risks array<struct<type:string,field:string,severity:string,message:string>>, extracted_data string, ai_model string, processing_time int, created_at timestamp",
    "document_chat_logs": "id string, document_id string, question string, answer string, ai_model string, response_time int, created_at timestamp",
    "created_records": "id string, source_document_id string, record_type string, payload string, created_at timestamp",
    "api_usage_logs": "id string, endpoint string, document_type string, total_pages int, llm_used boolean, llm_cost double, processing_time_ms int, created_at timestamp",
}
STATUS = ("uploaded", "processing", "completed", "failed")


def read(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{root}/{name}")


def append(df: DataFrame, root: str, name: str) -> None:
    """Columns are put in order; those that are missing are null."""
    fields = T.StructType.fromDDL(SCHEMAS[name])
    df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields]).write.mode("append").parquet(f"{root}/{name}")


def read_jdbc(spark: SparkSession, url: str, table: str, **options: str) -> DataFrame:
    return spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()


def spread(scan: DataFrame, most: int = 256 << 20) -> DataFrame:
    """A scan of most bytes at most with fewer partitions than there are cores, such as one small file, dealt to all of them. Larger ones are left as they are: their files are split by size, and a shuffle would cost more."""
    small = int(str(scan._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) <= most
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if small and scan.rdd.getNumPartitions() < cores else scan
