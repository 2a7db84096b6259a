"""Documents rendered from the test tables. The SQL is common to Spark and the oracle's engine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from foliant.sources.tables import spread

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

_NL = " || chr(10) || "
_Y, _M, _D = "year(o_orderdate)", "month(o_orderdate)", "day(o_orderdate)"


def _s(x: str) -> str:
    return f"CAST({x} AS STRING)"


_DAY = f"{_s(_Y)} || '年' || {_s(_M)} || '月' || {_s(_D)} || '日'"
_AMOUNT = "CAST(floor(o_totalprice) AS BIGINT)"
_COMMAS = f"CASE WHEN {_AMOUNT} >= 1000 THEN {_s(f'CAST(floor({_AMOUNT} / 1000) AS BIGINT)')} || ',' || lpad({_s(f'{_AMOUNT} % 1000')}, 3, '0') ELSE {_s(_AMOUNT)} END"

CONTRACTS = f"""
SELECT o_orderkey AS doc_id, o_orderstatus AS state, o_orderpriority AS priority, o_orderdate AS signed, o_totalprice AS amount,
  CASE o_orderkey % 3 WHEN 0 THEN '合約編號：ORD-' WHEN 1 THEN 'Contract No.: ORD-' ELSE '編號: ORD-' END || {_s("o_orderkey")}
  {_NL} CASE o_orderkey % 4 WHEN 0 THEN '簽訂日期：' || {_DAY}
     WHEN 1 THEN '中華民國 ' || {_s(f"{_Y} - 1911")} || ' 年 ' || {_s(_M)} || ' 月 ' || {_s(_D)} || ' 日'
     WHEN 2 THEN '中華民國' || {_s(f"{_Y} - 1911")} || '年' || lpad({_s(_M)}, 2, '0') || '月' || lpad({_s(_D)}, 2, '0') || '日'
     ELSE 'Date: ' || {_s(_Y)} || '-' || {_s(_M)} || '-' || {_s(_D)} END
  {_NL} CASE WHEN o_orderkey % 5 = 0 THEN '立合約書人 ' ELSE '甲方：  ' END || c_name || ' （出租人）'
  {_NL} '乙方: Supplier ' || {_s("o_custkey % 100")}
  {_NL} CASE WHEN o_orderstatus = 'F' THEN '合約金額：新台幣 ' || {_COMMAS} || ' 元' ELSE '金額待定' END
  {_NL} CASE WHEN o_orderstatus = 'O' THEN
       '租期：' || {_DAY} || ' 至 ' || {_s(f"{_Y} + 1")} || '年1月31日止' {_NL} '每月租金：NTD ' || {_COMMAS} || ' 元'
       {_NL} CASE WHEN o_orderkey % 2 = 0 THEN '押金：相當於 2 個月租金' ELSE '保證金：' || {_COMMAS} || '元' END
       {_NL} '租賃標的：台北市信義路' || {_s("o_custkey % 300")} || '號 ' {_NL} '承租人：' || c_name {_NL} '身分證字號：A' || lpad({_s("o_custkey")}, 9, '0')
       {_NL} '聯絡電話：02-' || lpad({_s("o_custkey")}, 8, '2') {_NL} '於每月 5 日前繳納' {_NL} '管理費：1,200 元'
     ELSE '付款方式： 匯款 ' {_NL} '付款期限：簽約後 30 天' {_NL} '地址：台北市中正區' || {_s("o_custkey % 77")} || '號' END AS text
FROM orders JOIN customer ON o_custkey = c_custkey
"""

TRANSCRIPTS = f"""
SELECT p_partkey AS doc_id, p_size AS size,
  CASE p_partkey % 4 WHEN 0 THEN '上地登記膽本' WHEN 1 THEN '土㆞標示部 登記謄本' WHEN 2 THEN '建物所有傑部' ELSE 'ot plain text' END
  {_NL} '地號：' || lpad({_s("p_partkey % 10000")}, 4, '0') || CASE WHEN p_partkey % 2 = 0 THEN ' - ' ELSE '-' END || lpad({_s("p_partkey % 77")}, 4, '0')
  {_NL} '統一編號  A' || lpad({_s("p_partkey")}, 9, '0')
  {_NL} '民國 ' || {_s("100 + p_partkey % 12")} || ' 年 ' || {_s("1 + p_partkey % 12")} || ' 月 ' || {_s("1 + p_partkey % 28")} || ' 日   '
  {_NL} '面積: ' || {_s("p_size")} || '.5 平方公' || CASE WHEN p_partkey % 3 = 0 THEN '米' ELSE '尺' END
  {_NL} '所有權人：' || p_name || '  ' {_NL} CASE WHEN p_partkey % 5 = 0 THEN '權利範園 全部' ELSE '權利範圍 全部' END
  {_NL} chr(10) || chr(10) || '已列印 已列印' || CASE WHEN p_partkey % 6 = 0 THEN '****' ELSE '**' END || 'OOOO' || CASE WHEN p_partkey % 7 = 0 THEN '建成地政' ELSE '' END AS text
FROM part
"""

#: Results of three engines for each document, with ties in confidence.
ENGINES = """
SELECT doc_id AS page_id, 0 AS engine_ord, 'paddleocr' AS engine, text, CAST(doc_id % 5 AS DOUBLE) / 5 AS confidence FROM documents
UNION ALL SELECT doc_id, 1, 'tesseract', replace(text, 'e', 'E'), CAST(doc_id % 3 AS DOUBLE) / 5 FROM documents
UNION ALL SELECT doc_id, 2, 'textract', replace(text, 'a', 'A') || ' 土地 地號', CAST(doc_id % 4 AS DOUBLE) / 5 FROM documents
"""

#: Pages of a document: turns of a conversation, with what rules and models would have made of them.
PAGES = """
SELECT conv_id AS doc_id, turn AS page_number, text AS raw_text, CASE WHEN turn % 4 = 3 THEN '' ELSE lower(text) END AS rule_text,
  replace(text, 'e', 'E') AS model_text, role = 'assistant' AS llm_used, CASE WHEN role = 'assistant' THEN CAST(length(text) AS DOUBLE) / 131072 END AS llm_cost,
  CAST(length(text) % 7 AS BIGINT) AS typo_fixes, CAST(length(text) % 3 AS BIGINT) AS format_corrections, turn % 5 = 0 AS llm_extracted,
  CASE WHEN turn % 3 = 1 THEN 'parties ' || CAST(turn AS STRING) END AS parties, CASE WHEN turn % 2 = 0 THEN 'terms ' || CAST(turn AS STRING) END AS terms,
  CASE WHEN length(text) % 11 = 0 THEN 'unreadable' END AS error
FROM conversations
"""

DOCUMENTS = """
SELECT CAST(o_orderkey AS STRING) AS document_id, 'order-' || CAST(o_orderkey AS STRING) || CASE o_orderkey % 5 WHEN 0 THEN '.PDF' WHEN 1 THEN '.jpg' WHEN 2 THEN '.docx' WHEN 3 THEN '' ELSE '.tar.png' END AS file_name,
  CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'processing' ELSE 'failed' END AS status,
  CASE o_orderkey % 3 WHEN 0 THEN 'transcript' WHEN 1 THEN 'contract' ELSE 'invoice' END AS document_type,
  CAST(o_totalprice * 100 AS BIGINT) AS file_size, o_orderdate AS created_at, o_custkey AS customer FROM orders
"""

RESULTS = """
SELECT CAST(l_orderkey AS STRING) || '-' || CAST(l_linenumber AS STRING) || '-' || CAST(l_partkey AS STRING) || '-' || CAST(l_suppkey AS STRING) AS id, CAST(l_orderkey AS STRING) AS document_id,
  CASE l_partkey % 4 WHEN 0 THEN 'lease_contract' WHEN 1 THEN 'repair_quote' WHEN 2 THEN 'id_card' ELSE 'unknown' END AS doc_type,
  CASE WHEN l_linenumber = 7 THEN '{"rent":"n/a"}' ELSE '{"rent":' || CAST(CAST(floor(l_extendedprice) AS BIGINT) AS STRING) || '}' END AS extracted_data, l_shipdate AS created_at FROM lineitem
"""

USAGE = """
SELECT event_id AS id, ts AS created_at, user_id, event_type, CAST({json}(props, '$.k') AS BIGINT) AS total_pages, event_type = 'purchase' AS llm_used, value / 1000 AS llm_cost FROM events
"""
USAGE_SPARK, USAGE_ORACLE = USAGE.format(json="get_json_object"), USAGE.format(json="json_extract_string")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def render(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """The relation of one of the texts above; only tables that it names are read."""
    import re

    used = [t for t in TABLES if re.search(rf"\b(FROM|JOIN) {t}\b", sql)]
    for t in used:
        sql = re.sub(rf"\b(FROM|JOIN) {t}\b", rf"\1 {{{t}}}", sql)
    braces = re.sub(r"\{(?!(" + "|".join(used) + r")\})", "{{", sql)
    braces = re.sub(r"(?<!" + ")(?<!".join("{" + t for t in used) + r")\}", "}}", braces)
    return spark.sql(braces, **{t: table(spark, sf_dir, t) for t in used})
