"""A query for each operator over the test tables, and SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.functions import classify, extract, rules
from foliant.functions import patterns as P
from foliant.operators import fusion, imaging, metrics, models, pages, relational, validate
from foliant.plans import rendered as R
from foliant.plans import processors
from foliant.sources import files
from foliant.streaming import lifecycle

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
NOW = "TIMESTAMP '1998-06-01 00:00:00'"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def _first(col: str, pattern: str, groups: int = 1) -> str:
    p = _q("(?m)" + pattern)
    if groups > 1:
        got = " || ' ' || ".join(f"regexp_extract({col}, {p}, {i + 1})" for i in range(groups))
    else:
        got = f"regexp_extract({col}, {p}, {groups})"
        got = _strip(got) if groups else got
    return f"CASE WHEN regexp_matches({col}, {p}) THEN {got} END"


def _field(name: str, col: str = "text") -> str:
    return "coalesce(" + ", ".join(_first(col, p, P.group_count(p)) for p in P.PATTERNS[name]) + f") AS {name}"


def _replaced(col: str, pairs) -> str:
    for a, b in pairs:
        col = f"replace({col}, {_q(a)}, {_q(b)})"
    return col


def _regexp(col: str, pattern: str, by: str) -> str:
    return f"regexp_replace({col}, {_q('(?m)' + pattern)}, {_q(by.replace('$', chr(92)))}, 'g')"


def _hits(col: str, words) -> str:
    return "(" + " + ".join(f"CAST(contains({col}, {_q(w)}) AS BIGINT)" for w in words) + ")"


def _typos(source: str, key: str = "doc_id") -> str:
    """Chained selects: each rule on the result of those before, with its count."""
    sql = f"SELECT {key}, text AS t, 0::BIGINT AS n FROM ({source})"
    for a, b in rules.TYPOS.words:
        sql = f"SELECT {key}, replace(t, {_q(a)}, {_q(b)}) AS t, n + (length(t) - length(replace(t, {_q(a)}, ''))) // {len(a)} AS n FROM ({sql})"
    k, v = _q(rules.TYPOS.single_from), _q(rules.TYPOS.single_to)
    return f"SELECT {key}, translate(t, {k}, {v}) AS fixed, CAST(n + length(t) - length(translate(t, {k}, '')) AS BIGINT) AS typo_fixes FROM ({sql})"


def contracts(spark, sf_dir) -> DataFrame:
    return R.render(spark, sf_dir, R.CONTRACTS)


def transcripts(spark, sf_dir) -> DataFrame:
    return R.render(spark, sf_dir, R.TRANSCRIPTS)


def results(spark, sf_dir) -> DataFrame:
    return R.render(spark, sf_dir, R.RESULTS)


def stored(spark, sf_dir) -> DataFrame:
    return R.render(spark, sf_dir, R.DOCUMENTS)


def conversation_pages(spark, sf_dir) -> DataFrame:
    return R.render(spark, sf_dir, R.PAGES)


# --- clean-up of text ---------------------------------------------------------------------------


@query(f"""
    WITH f AS ({_typos(R.CONTRACTS, "doc_id, priority")}),
         x AS (SELECT priority, {", ".join(_field(n, "fixed") for n in ("contract_number", "signing_date", "party_a", "contract_amount"))} FROM f)
    SELECT priority, count(*) AS contracts, count(contract_number) AS contract_numbers, count(signing_date) AS signing_dates, count(party_a) AS parties, count(contract_amount) AS amounts
    FROM x GROUP BY priority
""")
def flagship_contract_fields(spark, sf_dir):
    """Rendered contracts are cleaned, four fields extracted, and counted by priority."""
    found = extract.fields(rules.fix_typos(contracts(spark, sf_dir), "text"), "fixed", ("contract_number", "signing_date", "party_a", "contract_amount"))
    return found.groupBy("priority").agg(F.count("*").alias("contracts"), F.count("contract_number").alias("contract_numbers"), F.count("signing_date").alias("signing_dates"), F.count("party_a").alias("parties"), F.count("contract_amount").alias("amounts"))


@query(f"SELECT doc_id, md5(fixed) AS fixed_md5, typo_fixes FROM ({_typos('SELECT doc_id, text FROM documents')})")
def typo_fix_stats(spark, sf_dir):
    return rules.fix_typos(R.table(spark, sf_dir, "documents").select("doc_id", "text"), "text").select("doc_id", F.md5("fixed").alias("fixed_md5"), "typo_fixes")


@query(f"SELECT doc_id, fixed, typo_fixes FROM ({_typos(R.TRANSCRIPTS)})")
def typo_fix_transcripts(spark, sf_dir):
    return rules.fix_typos(transcripts(spark, sf_dir), "text").select("doc_id", "fixed", "typo_fixes")


def _format(name, expression, sql):
    @query(f"SELECT doc_id, {sql} AS text FROM ({R.TRANSCRIPTS})")
    def run(spark, sf_dir):
        return transcripts(spark, sf_dir).select("doc_id", expression(F.col("text")).alias("text"))

    QUERIES[name], ORACLE_SQL[name] = QUERIES.pop("run"), ORACLE_SQL.pop("run")


_LAND = _regexp("text", *rules.LAND_NUMBER)
_ROC = _regexp(_regexp("text", *rules.ROC_DATE_STEPS[0]), *rules.ROC_DATE_STEPS[1])
_CLEAN = r"regexp_replace(regexp_replace(text, '[ \t\r\f\v]+(\n|$)', '\1', 'g'), '\n{3,}', chr(10) || chr(10), 'g')"
_SECTIONS = _replaced("text", rules.SECTION_TITLES.items())
for _t in rules.SECTIONS:
    _SECTIONS = f"replace({_SECTIONS}, {_q(_t)}, chr(10) || repeat('=', 40) || chr(10) || {_q(_t)} || chr(10) || repeat('=', 40) || chr(10))"
_format("format_land_number", rules.land_number, _LAND)
_format("format_unified_id", rules.unified_id, _regexp("text", *rules.UNIFIED_ID))
_format("format_roc_date", rules.roc_date, _ROC)
_format("format_area", rules.area, _regexp("text", *rules.AREA))
_format("format_field_names", rules.field_names, _replaced("text", rules.FIELD_NAMES.items()))
_format("watermark_dedup", rules.drop_watermarks, _regexp(_regexp(_regexp("text", rules.WATERMARKS[0], ""), rules.WATERMARKS[1], ""), rules.WATERMARKS[2], ""))
_format("section_restore", rules.restore_sections, _SECTIONS)
_format("whitespace_clean", rules.clean_whitespace, _CLEAN)

_FORMATTED = _replaced(_regexp(_ROC.replace("text", _regexp(_LAND, *rules.UNIFIED_ID), 1), *rules.AREA), rules.FIELD_NAMES.items())


@query(f"SELECT doc_id, CAST(len(regexp_extract_all(text, {_q(rules.LAND_NUMBER[0])})) + len(regexp_extract_all(text, {_q(rules.ROC_DATE)})) + {_hits('text', rules.FIELD_NAMES)} AS BIGINT) AS format_corrections, {_FORMATTED} AS formatted FROM ({R.TRANSCRIPTS})")
def format_corrections(spark, sf_dir):
    return rules.fix_formats(transcripts(spark, sf_dir), "text").select("doc_id", "format_corrections", "formatted")


@query(f"""SELECT doc_id, {_hits("text", rules.KEYWORDS)} AS keyword_count, {_hits("text", rules.KEYWORDS)} >= 7.8 AS has_keywords, round({_hits("text", rules.KEYWORDS)} / 13.0::DOUBLE, 4) AS confidence,
    concat_ws(',', {", ".join(f"CASE WHEN NOT contains(text, {_q(k)}) THEN {_q(k)} END" for k in rules.KEYWORDS)}) AS missing FROM ({R.TRANSCRIPTS})""")
def keyword_completeness(spark, sf_dir):
    c = rules.completeness(F.col("text"))
    return transcripts(spark, sf_dir).withColumn("c", c).select("doc_id", "c.keyword_count", "c.has_keywords", F.round("c.confidence", 4).alias("confidence"), F.array_join("c.missing_keywords", ",").alias("missing"))


@query(f"SELECT doc_id, CASE WHEN instr(text, '土') > 0 THEN substring(text, 1, instr(text, '土') - 1) || '<土>' || substring(text, instr(text, '土') + 1) ELSE text END AS text FROM ({R.TRANSCRIPTS})")
def apply_first_correction(spark, sf_dir):
    return transcripts(spark, sf_dir).select("doc_id", rules.replace_first(F.col("text"), F.lit("土"), F.lit("<土>")).alias("text"))


@query("SELECT o_orderkey AS doc_id, try_cast(concat_ws('-', year(o_orderdate), month(o_orderdate) + o_orderkey % 2, day(o_orderdate) + o_orderkey % 3) AS DATE) AS day FROM orders")
def gregorian_date(spark, sf_dir):
    """Dates counted from 1912, some of months and days that don't exist."""
    d, k = F.col("o_orderdate"), F.col("o_orderkey")
    return R.table(spark, sf_dir, "orders").select(k.alias("doc_id"), rules.gregorian(F.year(d) - 1911, (F.month(d) + k % 2).cast("int"), (F.dayofmonth(d) + k % 3).cast("int")).alias("day"))


# --- extraction ----------------------------------------------------------------------------------


@query(f"SELECT doc_id, {', '.join(map(_field, P.GENERAL))} FROM ({R.CONTRACTS})")
def contract_extract_general(spark, sf_dir):
    return extract.fields(contracts(spark, sf_dir), names=P.GENERAL).select("doc_id", *P.GENERAL)


@query(f"SELECT doc_id, {', '.join(map(_field, P.RENTAL))} FROM ({R.CONTRACTS})")
def contract_extract_lease(spark, sf_dir):
    return extract.fields(contracts(spark, sf_dir), names=P.RENTAL).select("doc_id", *P.RENTAL)


def _present(names) -> str:
    return "(" + " + ".join(f"CAST({n} IS NOT NULL AS INT)" for n in names) + ")"


_EXTRACTED = f"SELECT doc_id, state, {', '.join(map(_field, P.PATTERNS))} FROM ({R.CONTRACTS})"
_CONFIDENCE = f"round(0.7 * {_present(P.CRITICAL)} / 10.0::DOUBLE + 0.3 * {_present(P.MINOR)} / 15.0::DOUBLE, 4)"


@query(f"SELECT doc_id, {_CONFIDENCE} AS confidence FROM ({_EXTRACTED})")
def contract_confidence(spark, sf_dir):
    return extract.fields(contracts(spark, sf_dir)).select("doc_id", extract.confidence().alias("confidence"))


@query(f"SELECT doc_id, contract_number, party_a, currency, {_CONFIDENCE} AS extraction_confidence, false AS llm_used_for_extraction, coalesce({', '.join(P.RENTAL)}) IS NOT NULL AS has_rental_terms, monthly_rent FROM ({_EXTRACTED})")
def contract_result_struct(spark, sf_dir):
    r = extract.fields(contracts(spark, sf_dir)).select("doc_id", extract.result().alias("r"))
    return r.select("doc_id", "r.contract_metadata.contract_number", "r.parties.party_a", "r.financial_terms.currency", "r.extraction_confidence", "r.llm_used_for_extraction", F.col("r.rental_terms").isNotNull().alias("has_rental_terms"), "r.rental_terms.monthly_rent")


_OTHER = "CASE doc_id % 3 WHEN 0 THEN 'MODEL-' || CAST(doc_id AS STRING) WHEN 1 THEN '' END"


@query(f"SELECT doc_id, coalesce(nullif({_OTHER}, ''), contract_number) AS contract_number FROM (SELECT doc_id, {_field('contract_number')} FROM ({R.CONTRACTS}))")
def field_merge(spark, sf_dir):
    return extract.fields(contracts(spark, sf_dir), names=("contract_number",)).select("doc_id", extract.merge(F.col("contract_number"), F.expr(_OTHER)).alias("contract_number"))


@query(f"SELECT doc_id, {_CONFIDENCE} < 0.7 AND doc_id % 2 = 0 AND doc_id % 3 <> 0 AS ask_model FROM ({_EXTRACTED})")
def llm_gate(spark, sf_dir):
    return extract.fields(contracts(spark, sf_dir)).select("doc_id", extract.needs_model(F.col("doc_id") % 2 == 0, F.col("doc_id") % 3 != 0).alias("ask_model"))


_FOUR = ("contract_number", "party_a", "party_b", "contract_amount")


@query(f"SELECT state, round(avg({_present(_FOUR)} / 4.0::DOUBLE), 4) AS mean_rate, round(avg(CAST({_present(_FOUR)} >= 3 AS DOUBLE)), 4) AS good_share FROM ({_EXTRACTED}) GROUP BY state")
def critical_field_rate(spark, sf_dir):
    rate = extract.present(_FOUR) / 4
    return extract.fields(contracts(spark, sf_dir), names=_FOUR).groupBy("state").agg(F.round(F.avg(rate), 4).alias("mean_rate"), F.round(F.avg((rate >= 0.75).cast("double")), 4).alias("good_share"))


_IDENTITY = "CASE c_custkey % 5 WHEN 0 THEN 'A' || lpad(CAST(c_custkey AS STRING), 9, '1') WHEN 1 THEN lpad(CAST(c_custkey AS STRING), 8, '2') WHEN 2 THEN '0912-345-' || lpad(CAST(c_custkey % 1000 AS STRING), 3, '0') WHEN 3 THEN '(02)' || lpad(CAST(c_custkey AS STRING), 6, '3') ELSE c_name END"


@query(f"SELECT c_custkey, v AS value, CASE {' '.join(f'WHEN regexp_matches(v, {_q(f"^(?:{p})$")}) THEN {_q(n)}' for n, p in (('national_id', P.NATIONAL_ID), ('company_id', P.COMPANY_ID), ('mobile', P.MOBILE), ('phone', P.PHONE)))} END AS kind FROM (SELECT c_custkey, {_IDENTITY} AS v FROM customer)")
def identity_formats(spark, sf_dir):
    return R.table(spark, sf_dir, "customer").select("c_custkey", F.expr(_IDENTITY).alias("value")).withColumn("kind", extract.identity_kind(F.col("value")))


@query(f"SELECT doc_id, {', '.join(f'coalesce({", ".join(_first("text", p, g) for p, g in v)}) AS {k}' for k, v in P.CANDIDATES.items())} FROM ({R.TRANSCRIPTS})")
def field_candidates(spark, sf_dir):
    return transcripts(spark, sf_dir).select("doc_id", *[extract.candidate(F.col("text"), k).alias(k) for k in P.CANDIDATES])


_PROPOSED = "lpad(CAST(p_partkey AS STRING), CASE WHEN p_partkey % 3 = 0 THEN 3 ELSE 4 END, '0') || ' - 0001'"


@query(f"SELECT p_partkey AS doc_id, CASE WHEN regexp_matches(replace({_PROPOSED}, ' ', ''), {_q(P.LAND_NUMBER_FORM)}) THEN replace({_PROPOSED}, ' ', '') ELSE 'original' END AS land_number FROM part")
def land_number_validate(spark, sf_dir):
    return R.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), extract.valid_land_number(F.expr(_PROPOSED), F.lit("original")).alias("land_number"))


@query(f"SELECT doc_id, {_first('text', P.TRANSCRIPT_LAND_NUMBER)} AS land_number, {_first('text', P.TRANSCRIPT_AREA)} AS area FROM ({R.TRANSCRIPTS})")
def transcript_fields(spark, sf_dir):
    return extract.transcript_fields(transcripts(spark, sf_dir)).select("doc_id", "land_number", "area")


@query(f"SELECT * FROM (VALUES {', '.join(f'({_q(k)}, {_q(v)}, {len(P.PATTERNS[k])})' for k, v in P.DESCRIPTIONS.items())}, ('other', '未知欄位', 0)) AS t(field, description, patterns)")
def field_metadata(spark, sf_dir):
    rows = spark.createDataFrame([(k, len(v)) for k, v in P.PATTERNS.items()] + [("other", 0)], "field string, patterns int")
    return rows.select("field", extract.describe(F.col("field")).alias("description"), "patterns")


# --- fusion of engines, classification -------------------------------------------------------------


def engines(spark, sf_dir):
    return R.render(spark, sf_dir, R.ENGINES)


def _fused(order: str, confidence: str = "confidence") -> str:
    return f"SELECT page_id, md5(text) AS text_md5, round({confidence}, 6) AS confidence FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY {order}) AS rn, avg(confidence) OVER (PARTITION BY page_id) AS mean, sum(confidence) OVER (PARTITION BY page_id) AS s FROM ({{source}})) WHERE rn = 1"


_SMART = f"(CASE WHEN longest > 0 THEN length(text) / longest::DOUBLE ELSE 0 END) * 0.40 + {_hits('text', fusion.KEYWORDS)} / 8.0::DOUBLE * 0.35 + confidence * 0.25"
_SCORED = f"SELECT *, {_SMART} AS score FROM (SELECT *, max(length(text)) OVER (PARTITION BY page_id) AS longest FROM ({R.ENGINES}))"
_FUSED = {
    "best": _fused("confidence DESC, engine_ord").format(source=R.ENGINES),
    "smart": _fused("score DESC, engine_ord").format(source=_SCORED),
    "vote": _fused("length(text) DESC, engine_ord", "mean").format(source=R.ENGINES),
    "weighted": _fused("CASE WHEN s = 0 THEN engine_ord ELSE -confidence END, engine_ord", "CASE WHEN s = 0 THEN 0 ELSE mean END").format(source=f"SELECT *, sum(confidence) OVER (PARTITION BY page_id) AS s FROM ({R.ENGINES})").replace(", sum(confidence) OVER (PARTITION BY page_id) AS s FROM (SELECT *", " FROM (SELECT *", 1),
}


def _fuse(method):
    @query(_FUSED[method])
    def run(spark, sf_dir):
        return fusion.fuse(engines(spark, sf_dir), method).select("page_id", F.md5("text").alias("text_md5"), F.round("confidence", 6).alias("confidence"))

    QUERIES[f"fuse_{method}"], ORACLE_SQL[f"fuse_{method}"] = QUERIES.pop("run"), ORACLE_SQL.pop("run")


for _m in fusion.METHODS:
    _fuse(_m)

_RAW = "CASE event_id % 5 WHEN 0 THEN CAST(value AS STRING) WHEN 1 THEN '0.5' WHEN 2 THEN 'high' WHEN 3 THEN '-1' END"
_ENGINE = "CASE WHEN event_id % 2 = 0 THEN 'textract' ELSE 'tesseract' END"


@query(f"SELECT event_id, round(greatest(0.0, least(1.0, CASE WHEN {_ENGINE} = 'textract' AND x > 1 THEN x / 100 ELSE x END)), 6) AS confidence FROM (SELECT event_id, coalesce(try_cast({_RAW} AS DOUBLE), 0) AS x FROM events)")
def standardize_confidence(spark, sf_dir):
    return R.table(spark, sf_dir, "events").select("event_id", F.round(fusion.standard_confidence(F.expr(_RAW), F.expr(_ENGINE)), 6).alias("confidence"))


@query("SELECT user_id, round(coalesce(avg(CASE WHEN event_id % 3 <> 0 THEN value END) / 100, 0), 6) AS confidence FROM events GROUP BY user_id")
def tesseract_confidence(spark, sf_dir):
    e = R.table(spark, sf_dir, "events").withColumn("value", F.when(F.col("event_id") % 3 == 0, -1.0).otherwise(F.col("value")))
    return fusion.word_confidence(e, "user_id", "value").select("user_id", F.round("confidence", 6).alias("confidence"))


_COMPARED = " UNION ALL ".join(f"SELECT {_q(m)} AS method, {i} AS ord, CAST(sum(length(text)) AS BIGINT) AS chars, CAST(sum({_hits('text', fusion.KEYWORDS)}) AS BIGINT) AS keywords, round(avg(confidence), 4) AS confidence FROM ({_FUSED[m].replace('md5(text) AS text_md5', 'text').replace('round(', '(').replace(', 6)', ')')})" for i, m in enumerate(fusion.METHODS))


@query(f"SELECT method, chars, keywords, confidence, row_number() OVER (ORDER BY keywords DESC, chars DESC, ord) = 1 AS is_best FROM ({_COMPARED})")
def strategy_compare(spark, sf_dir):
    return fusion.compare_methods(engines(spark, sf_dir))


_KIND = f"SELECT doc_id, text, {', '.join(f'{_hits("text", w)} AS {k}' for k, w in classify.KINDS.items())} FROM ({{source}})"
_TEXTS = f"SELECT doc_id, text FROM ({R.CONTRACTS}) UNION ALL SELECT -1 - doc_id, text FROM ({R.TRANSCRIPTS})"


def texts(spark, sf_dir):
    return contracts(spark, sf_dir).select("doc_id", "text").unionByName(transcripts(spark, sf_dir).select((-1 - F.col("doc_id")).alias("doc_id"), "text"))


@query(f"SELECT doc_id, CASE WHEN greatest(transcript, lease, id_card) = 0 THEN 'unknown' WHEN transcript >= lease AND transcript >= id_card THEN 'transcript' WHEN lease >= id_card THEN 'lease' ELSE 'id_card' END AS kind FROM ({_KIND.format(source=_TEXTS)})")
def classify_keywords(spark, sf_dir):
    return texts(spark, sf_dir).select("doc_id", classify.kind(F.col("text")).alias("kind"))


@query(f"SELECT doc_id, {_hits('text', classify.KINDS['transcript'])} > 0 AS is_transcript FROM ({_TEXTS})")
def is_transcript(spark, sf_dir):
    return texts(spark, sf_dir).select("doc_id", classify.is_transcript(F.col("text")).alias("is_transcript"))


@query(f"SELECT doc_id, {' + '.join(f'CAST(regexp_matches(text, {_q(p)}) AS BIGINT)' for p in classify.ID_CARD_FEATURES)} >= 2 AS id_card FROM ({_TEXTS})")
def idcard_features(spark, sf_dir):
    return texts(spark, sf_dir).select("doc_id", (classify.id_card_features(F.col("text")) >= 2).alias("id_card"))


# --- validation, gates of models -------------------------------------------------------------------

_EXT = r"lower(regexp_extract(file_name, '(\.[^.]*)$', 1))"
_ERROR = f"CASE WHEN {_EXT} NOT IN ('.pdf', '.jpg', '.jpeg', '.png') THEN 'UNSUPPORTED_FILE_TYPE' WHEN document_type NOT IN ('transcript', 'contract') THEN 'UNSUPPORTED_DOCUMENT_TYPE' WHEN file_size > 20971520 THEN 'FILE_TOO_LARGE' END"


@query(f"SELECT document_id, {_EXT} AS extension, {_EXT} IN ('.pdf', '.jpg', '.jpeg', '.png') AS type_ok, document_type IN ('transcript', 'contract') AS kind_ok, file_size <= 20971520 AS size_ok, file_size <= 10485760 AS document_size_ok FROM ({R.DOCUMENTS})")
def validate_upload(spark, sf_dir):
    e = validate.extension(F.col("file_name"))
    return stored(spark, sf_dir).select("document_id", e.alias("extension"), e.isin(*validate.EXTENSIONS).alias("type_ok"), F.col("document_type").isin(*validate.KINDS).alias("kind_ok"), (F.col("file_size") <= validate.ANALYZE_BYTES).alias("size_ok"), (F.col("file_size") <= validate.DOCUMENT_BYTES).alias("document_size_ok"))


@query(f"SELECT document_id, {_ERROR} AS error_code, CASE WHEN {_ERROR} = 'FILE_TOO_LARGE' THEN 413 WHEN {_ERROR} IS NOT NULL THEN 400 ELSE 200 END AS status_code FROM ({R.DOCUMENTS})")
def validate_first_error(spark, sf_dir):
    e = validate.upload_error(F.col("file_name"), F.col("document_type"), F.col("file_size"))
    return stored(spark, sf_dir).select("document_id", e.alias("error_code")).withColumn("status_code", validate.status_code(F.col("error_code")))


@query(f"SELECT document_id, CASE document_type WHEN 'transcript' THEN 'uploads/ocr_transcripts' WHEN 'contract' THEN 'uploads/ocr_contracts' ELSE 'uploads/ocr_others' END AS folder FROM ({R.DOCUMENTS})")
def prefix_routing(spark, sf_dir):
    return stored(spark, sf_dir).select("document_id", validate.folder(F.col("document_type")).alias("folder"))


@query(f"SELECT c_custkey, CASE WHEN d.document_id IS NULL THEN 'NOT_FOUND' WHEN d.status <> 'completed' THEN 'NOT_READY' WHEN t.document_id IS NULL THEN 'NO_TEXT' END AS error_code FROM (SELECT c_custkey, CAST(c_custkey * 20 AS STRING) AS id FROM customer) c LEFT JOIN ({R.DOCUMENTS}) d ON d.document_id = c.id LEFT JOIN (SELECT DISTINCT CAST(l_orderkey AS STRING) AS document_id FROM lineitem WHERE l_orderkey % 3 <> 0) t ON t.document_id = c.id")
def ready_check(spark, sf_dir):
    asked = R.table(spark, sf_dir, "customer").select("c_custkey", (F.col("c_custkey") * 20).cast("string").alias("id"))
    d = stored(spark, sf_dir).select(F.col("document_id").alias("id"), "document_id", "status")
    t = R.table(spark, sf_dir, "lineitem").where("l_orderkey % 3 <> 0").select(F.col("l_orderkey").cast("string").alias("id")).distinct().withColumn("text_id", F.col("id"))
    return asked.join(d, "id", "left").join(t, "id", "left").select("c_custkey", validate.chat_error(F.col("document_id"), F.col("status"), F.col("text_id")).alias("error_code"))


@query(f"SELECT document_id, CASE WHEN file_size >= 30000000 THEN 'green' WHEN file_size >= 20000000 THEN 'yellow' ELSE 'red' END AS band FROM ({R.DOCUMENTS})")
def confidence_bands(spark, sf_dir):
    size = F.col("file_size")
    return stored(spark, sf_dir).select("document_id", validate.band(F.when(size >= 30000000, 0.7).when(size >= 20000000, 0.5).otherwise(0.1)).alias("band"))


_CHOSEN = "CASE event_id % 4 WHEN 0 THEN 'none' WHEN 1 THEN 'full' WHEN 2 THEN 'fields' ELSE 'auto' END"


@query(f"SELECT event_id, CASE WHEN event_type = 'error' THEN 'none' WHEN {_CHOSEN} <> 'auto' THEN {_CHOSEN} WHEN value / 100 < 0.85 THEN 'full' ELSE 'none' END AS strategy FROM events")
def llm_strategy(spark, sf_dir):
    return R.table(spark, sf_dir, "events").select("event_id", models.strategy(F.col("event_type") != "error", F.expr(_CHOSEN), F.col("value") / 100).alias("strategy"))


_MODEL = "CASE event_id % 3 WHEN 0 THEN 'gpt-4o-mini' WHEN 1 THEN 'gpt-4o' ELSE 'other' END"


@query(f"SELECT event_id, round((value * 100 * CASE WHEN user_id % 7 = 0 THEN 0.25 WHEN {_MODEL} = 'gpt-4o' THEN 2.5 ELSE 0.15 END + value * 10 * CASE WHEN user_id % 7 = 0 THEN 1.25 WHEN {_MODEL} = 'gpt-4o' THEN 10 ELSE 0.6 END) / 1000000, 9) AS cost FROM events")
def llm_cost(spark, sf_dir):
    c = models.cost(F.when(F.col("user_id") % 7 == 0, "anthropic").otherwise("openai"), F.expr(_MODEL), F.col("value") * 100, F.col("value") * 10)
    return R.table(spark, sf_dir, "events").select("event_id", F.round(c, 9).alias("cost"))


_ANSWER = "CASE event_id % 4 WHEN 0 THEN 'I''m sorry, no.' WHEN 1 THEN '我無法處理' WHEN 2 THEN repeat('I cannot help. ', 9) ELSE event_type END"


@query(f"SELECT event_id, length(a) < 100 AND ({' OR '.join(f'contains(lower(a), {_q(p)})' for p in validate.REFUSALS)}) AS refusal FROM (SELECT event_id, {_ANSWER} AS a FROM events)")
def refusal_filter(spark, sf_dir):
    answer = F.when(F.col("event_id") % 4 == 0, "I'm sorry, no.").when(F.col("event_id") % 4 == 1, "我無法處理").when(F.col("event_id") % 4 == 2, F.repeat(F.lit("I cannot help. "), F.lit(9))).otherwise(F.col("event_type"))
    return R.table(spark, sf_dir, "events").select("event_id", validate.is_refusal(answer).alias("refusal"))


_REPLY = "CASE event_id % 4 WHEN 0 THEN 'Here: ```json ' || props || ' ``` done' WHEN 1 THEN 'It is ' || props || '.' WHEN 2 THEN props ELSE 'nothing' END"


@query(f"SELECT event_id, CASE WHEN event_id % 4 < 3 THEN json_extract_string(props, '$.k') END AS k FROM events")
def llm_json_parse(spark, sf_dir):
    return R.table(spark, sf_dir, "events").select("event_id", F.try_element_at(models.parse_fields(F.expr(_REPLY)), F.lit("k")).alias("k"))


@query("SELECT doc_id, CAST(length(substring(text, 1, 500)) AS BIGINT) AS given_chars, md5('Fill in this JSON from the document, null where it says nothing.' || chr(10) || '{\"party_a\": null, \"party_b\": null}' || chr(10) || '---' || chr(10) || substring(text, 1, 500)) AS prompt_md5 FROM documents")
def llm_prompt_payload(spark, sf_dir):
    return R.table(spark, sf_dir, "documents").select("doc_id", F.length(F.substring("text", 1, 500)).cast("long").alias("given_chars"), F.md5(models.field_prompt(F.col("text"), ("party_a", "party_b"))).alias("prompt_md5"))


# --- pages to documents ----------------------------------------------------------------------------

_BEST = "CASE WHEN llm_used THEN model_text ELSE coalesce(nullif(rule_text, ''), raw_text) END"


@query(f"SELECT doc_id, md5(string_agg({_BEST}, chr(10) ORDER BY page_number)) AS text_md5, count(*) AS n FROM ({R.PAGES}) GROUP BY doc_id")
def best_text_concat(spark, sf_dir):
    best = pages.best_text(F.col("llm_used"), F.col("model_text"), F.col("rule_text"), F.col("raw_text"))
    return conversation_pages(spark, sf_dir).groupBy("doc_id").agg(F.md5(pages.joined(best, F.col("page_number"))).alias("text_md5"), F.count("*").alias("n"))


@query(f"SELECT doc_id, md5(string_agg('--- Page ' || CAST(page_number AS STRING) || '/' || CAST(n AS STRING) || ' ---' || chr(10) || raw_text, chr(10) || chr(10) ORDER BY page_number)) AS text_md5 FROM (SELECT *, count(*) OVER (PARTITION BY doc_id) AS n FROM ({R.PAGES})) GROUP BY doc_id")
def page_split_concat(spark, sf_dir):
    return pages.with_headers(conversation_pages(spark, sf_dir), "doc_id", "page_number", "raw_text").select("doc_id", F.md5("text").alias("text_md5"))


@query(f"SELECT doc_id, arg_max(parties, page_number) FILTER (parties IS NOT NULL) AS parties, arg_max(terms, page_number) FILTER (terms IS NOT NULL) AS terms FROM ({R.PAGES}) GROUP BY doc_id")
def structured_merge(spark, sf_dir):
    return pages.merged_groups(conversation_pages(spark, sf_dir), "doc_id", "page_number", ["parties", "terms"])


@query(f"SELECT doc_id, count(*) AS total_pages, count(*) FILTER (llm_used) AS llm_pages_used, round(sum(coalesce(llm_cost, 0)), 4) AS estimated_cost FROM ({R.PAGES}) GROUP BY doc_id")
def page_stats_rollup(spark, sf_dir):
    return pages.totals(conversation_pages(spark, sf_dir), "doc_id").select("doc_id", "total_pages", "llm_pages_used", "estimated_cost")


@query(f"SELECT doc_id, CAST(sum(typo_fixes) AS BIGINT) AS typo_fixes, CAST(sum(format_corrections) AS BIGINT) AS format_corrections, round(sum(coalesce(llm_cost, 0)), 4) AS cost, count(*) FILTER (llm_used OR llm_extracted) AS llm_pages FROM ({R.PAGES}) GROUP BY doc_id")
def ui_totals(spark, sf_dir):
    return pages.display_totals(conversation_pages(spark, sf_dir), "doc_id")


@query(f"SELECT doc_id, page_number, md5(CASE WHEN error IS NOT NULL THEN '' ELSE raw_text END) AS text_md5, CASE WHEN error IS NOT NULL THEN 0.0 ELSE 0.9 END AS confidence, error FROM ({R.PAGES})")
def page_failure_placeholder(spark, sf_dir):
    p = conversation_pages(spark, sf_dir)
    return p.select("doc_id", "page_number", *pages.placeholder(F.col("error"), F.col("raw_text"), F.lit(0.9))).withColumn("text_md5", F.md5("text")).drop("text")


@query("SELECT conv_id AS doc_id, string_agg(CASE WHEN role = 'user' THEN text END, chr(10) ORDER BY turn) AS text, greatest(count(*) FILTER (role <> 'user'), 1) AS pages FROM conversations GROUP BY conv_id")
def textract_blocks(spark, sf_dir):
    b = R.table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("ord"), F.when(F.col("role") == "user", "LINE").otherwise("PAGE").alias("block_type"), "text")
    return fusion.page_text(b).select("doc_id", F.nullif("text", F.lit("")).alias("text"), "pages")


# --- stored documents --------------------------------------------------------------------------------


@query(f"SELECT count(*) AS total_calls, CAST(coalesce(sum(total_pages), 0) AS BIGINT) AS total_pages, round(coalesce(sum(llm_cost), 0), 4) AS total_llm_cost, 'all_time' AS period FROM ({R.USAGE_ORACLE})")
def usage_rollup(spark, sf_dir):
    return relational.usage(R.render(spark, sf_dir, R.USAGE_SPARK))


@query("SELECT 0::BIGINT AS total_calls, 0::BIGINT AS total_pages, 0.0::DOUBLE AS total_llm_cost, 'all_time' AS period")
def usage_rollup_empty(spark, sf_dir):
    return relational.usage(R.render(spark, sf_dir, R.USAGE_SPARK).where(F.lit(False)))


@query(f"SELECT document_id, file_name, status FROM ({R.DOCUMENTS}) WHERE document_id = '100'")
def doc_point_lookup(spark, sf_dir):
    return relational.lookup(stored(spark, sf_dir).select("document_id", "file_name", "status"), "document_id", "100")


@query(f"SELECT document_id, doc_type, created_at FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY created_at DESC, id DESC) AS rn FROM ({R.RESULTS})) WHERE rn = 1")
def latest_child(spark, sf_dir):
    return relational.latest(results(spark, sf_dir), "document_id", "created_at", "id").select("document_id", "doc_type", "created_at")


@query(f"SELECT document_id, status, created_at FROM ({R.DOCUMENTS}) ORDER BY created_at DESC, document_id LIMIT 20 OFFSET 40")
def doc_list_page(spark, sf_dir):
    return relational.listing(stored(spark, sf_dir).select("document_id", "status", "created_at"), "created_at", "document_id", 40, 20)


@query(f"SELECT status, document_type, count(*) AS total, CAST(ceil(count(*) / 20.0) AS BIGINT) AS total_pages FROM ({R.DOCUMENTS}) GROUP BY status, document_type")
def pagination_meta(spark, sf_dir):
    return stored(spark, sf_dir).groupBy("status", "document_type").agg(F.count("*").alias("total")).withColumn("total_pages", relational.page_count(F.col("total"), 20))


_LATEST = f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY created_at DESC, id DESC) AS rn FROM ({R.RESULTS})) WHERE rn = 1"


@query(f"SELECT d.document_id, c.text, coalesce(a.doc_type, 'unknown') AS doc_type, coalesce(a.extracted_data, '{{}}') AS extracted_data FROM ({R.DOCUMENTS}) d JOIN (SELECT CAST(doc_id AS STRING) AS document_id, text FROM ({R.CONTRACTS}) WHERE state <> 'P') c ON c.document_id = d.document_id LEFT JOIN ({_LATEST}) a ON a.document_id = d.document_id")
def context_join(spark, sf_dir):
    """What is asked with a question; a document whose order is pending has no text yet."""
    t = contracts(spark, sf_dir).where("state <> 'P'").select(F.col("doc_id").cast("string").alias("document_id"), "text")
    a = relational.latest(results(spark, sf_dir), "document_id", "created_at", "id").select("document_id", "doc_type", "extracted_data")
    return relational.with_context(stored(spark, sf_dir).select("document_id"), t, a)


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS rn FROM events) WHERE rn <= 10")
def nested_include_top10(spark, sf_dir):
    return relational.newest_children(R.table(spark, sf_dir, "events"), "user_id", "ts", "event_id").select("user_id", "event_id", "event_type")


@query(f"SELECT document_id, status FROM ({R.DOCUMENTS}) WHERE document_id IN (SELECT document_id FROM ({R.RESULTS}) WHERE doc_type = 'lease_contract')")
def semi_by_type(spark, sf_dir):
    return relational.having(stored(spark, sf_dir), results(spark, sf_dir), "lease_contract").select("document_id", "status")


@query(f"SELECT d.document_id, r.id, CAST(json_extract_string(extracted_data, '$.rent') AS BIGINT) AS rent FROM ({R.DOCUMENTS}) d JOIN ({R.RESULTS}) r ON r.document_id = d.document_id WHERE r.doc_type = 'lease_contract' AND try_cast(json_extract_string(extracted_data, '$.rent') AS INT) > 20000")
def json_filter_join(spark, sf_dir):
    r = relational.json_above(results(spark, sf_dir).where("doc_type = 'lease_contract'"), "$.rent", 20000)
    return stored(spark, sf_dir).select("document_id").join(r, "document_id").select("document_id", "id", F.get_json_object("extracted_data", "$.rent").cast("long").alias("rent"))


@query(f"SELECT document_id, file_name, status, created_at FROM ({R.DOCUMENTS}) WHERE status = 'failed'")
def failed_docs(spark, sf_dir):
    return stored(spark, sf_dir).where("status = 'failed'").select("document_id", "file_name", "status", "created_at")


@query(f"SELECT document_id FROM ({R.DOCUMENTS}) WHERE NOT (status = 'failed' AND created_at < {NOW} - INTERVAL 90 DAY)")
def retention_delete(spark, sf_dir):
    return relational.expire(stored(spark, sf_dir), F.expr("TIMESTAMP_NTZ '1998-06-01 00:00:00'")).select("document_id")


_KEPT = f"SELECT document_id FROM ({R.DOCUMENTS}) WHERE customer % 10 <> 0"


@query(f"SELECT id FROM ({R.RESULTS}) WHERE document_id IN ({_KEPT})")
def orphan_delete(spark, sf_dir):
    kept = stored(spark, sf_dir).where("customer % 10 <> 0").select("document_id")
    return relational.without_orphans(results(spark, sf_dir), kept).select("id")


@query(f"SELECT 'documents' AS kind, document_id AS key FROM ({R.DOCUMENTS}) WHERE customer % 10 <> 0 UNION ALL SELECT 'results', id FROM ({R.RESULTS}) WHERE document_id NOT IN (SELECT document_id FROM ({R.DOCUMENTS}) WHERE customer % 10 = 0)")
def cascade_delete(spark, sf_dir):
    gone = stored(spark, sf_dir).where("customer % 10 = 0").select("document_id")
    d = relational.cascade(stored(spark, sf_dir), gone).select(F.lit("documents").alias("kind"), F.col("document_id").alias("key"))
    return d.unionByName(relational.cascade(results(spark, sf_dir), gone).select(F.lit("results").alias("kind"), F.col("id").alias("key")))


@query(f"SELECT id, CASE doc_type WHEN 'lease_contract' THEN 'lease' WHEN 'repair_quote' THEN 'repair' WHEN 'id_card' THEN 'tenant' END AS record_type, json_extract_string(extracted_data, '$.rent') AS rent, CASE WHEN length(id) % 2 = 0 THEN 'yes' ELSE 'no' END AS checked, 'active' AS status FROM ({R.RESULTS})")
def record_overlay(spark, sf_dir):
    data = F.create_map(F.lit("rent"), F.get_json_object("extracted_data", "$.rent"), F.lit("checked"), F.lit("no"))
    confirmed = F.when(F.length("id") % 2 == 0, F.create_map(F.lit("checked"), F.lit("yes"))).otherwise(F.create_map().cast("map<string,string>"))
    r = results(spark, sf_dir).withColumn("m", relational.overlay(data, confirmed))
    return r.select("id", relational.record_type(F.col("doc_type")).alias("record_type"), *[F.col("m")[k].alias(k) for k in ("rent", "checked", "status")])


@query(f"SELECT r.id, r.document_id AS source_document_id, d.file_name FROM ({R.RESULTS}) r JOIN ({R.DOCUMENTS}) d ON d.document_id = r.document_id")
def record_lookup(spark, sf_dir):
    r = results(spark, sf_dir).select("id", F.col("document_id").alias("source_document_id"))
    return relational.with_source(r, stored(spark, sf_dir)).select("id", "source_document_id", "source_document.file_name")


_LEASE = "SELECT o_orderkey AS doc_id, CASE WHEN o_orderkey % 7 <> 0 THEN 'L' || CAST(o_custkey AS STRING) END AS landlord_name, CASE WHEN o_orderkey % 11 = 0 THEN '' ELSE 'T' END AS tenant_name, CASE WHEN o_orderkey % 13 = 0 THEN 0 ELSE CAST(o_totalprice AS BIGINT) END AS rent, CAST(o_custkey * 500 AS BIGINT) AS deposit, CAST(o_orderdate AS DATE) AS lease_start, CASE WHEN o_orderkey % 3 = 0 THEN DATE '1996-01-01' ELSE DATE '1999-01-01' END AS lease_end FROM orders"
_RISKS = " UNION ALL ".join(
    [f"SELECT doc_id, 'missing_field' AS type, '{f}' AS field, 'warning' AS severity FROM l WHERE coalesce(CAST({f} AS STRING), '') = ''" for f in ("landlord_name", "tenant_name", "rent", "deposit", "lease_start", "lease_end")]
    + [f"SELECT doc_id, 'abnormal_value', '{f}', 'error' FROM l WHERE {f} = 0" for f in ("rent", "deposit")]
    + ["SELECT doc_id, 'invalid_range', 'lease_start', 'error' FROM l WHERE lease_start > lease_end", "SELECT doc_id, 'expired', 'lease_end', 'warning' FROM l WHERE lease_end < DATE '1998-06-01'", "SELECT doc_id, 'abnormal_value', 'deposit', 'warning' FROM l WHERE deposit > 0 AND deposit < 2 * rent"]
)


@query(f"WITH l AS ({_LEASE}) {_RISKS}")
def risk_flags(spark, sf_dir):
    r = R.render(spark, sf_dir, _LEASE).select("doc_id", F.explode(relational.lease_risks(F.lit("1998-06-01").cast("date"))).alias("r"))
    return r.select("doc_id", "r.type", "r.field", "r.severity")


@query(f"SELECT doc_id, n.type, n.field FROM (SELECT c_custkey AS doc_id, c_name, CASE WHEN c_custkey % 5 = 0 THEN 0 ELSE c_acctbal END AS amount, DATE '1998-06-01' + CAST(c_custkey % 2000 - 1500 AS INT) AS day FROM customer) q, (VALUES ('abnormal_value', 'total_amount'), ('abnormal_value', 'quote_date')) n(type, field) WHERE (n.field = 'total_amount' AND amount = 0) OR (n.field = 'quote_date' AND (day > DATE '1998-06-01' OR day + INTERVAL 24 MONTH < DATE '1998-06-01'))")
def quote_risk_flags(spark, sf_dir):
    today = F.lit("1998-06-01").cast("date")
    q = R.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), F.col("c_name").alias("vendor_name"), F.when(F.col("c_custkey") % 5 == 0, 0.0).otherwise(F.col("c_acctbal")).alias("total_amount"), F.date_add(today, (F.col("c_custkey") % 2000 - 1500).cast("int")).alias("quote_date"))
    return q.select("doc_id", F.explode(relational.quote_risks(today)).alias("r")).select("doc_id", "r.type", "r.field")


# --- accuracy ------------------------------------------------------------------------------------------


def pairs(spark, sf_dir) -> DataFrame:
    """Benchmark passages as truth, and the same with every r read as n."""
    return R.table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("truth"), F.translate("text", "r", "n").alias("text"))


_PAIRS = "SELECT item_id, text AS truth, translate(text, 'r', 'n') AS text FROM benchmark"


@query()
def accuracy_ratio(spark, sf_dir):
    return pairs(spark, sf_dir).select("item_id", metrics.page_accuracy(F.col("text"), F.col("truth")).alias("accuracy"))


@query()
def accuracy_detail(spark, sf_dir):
    return pairs(spark, sf_dir).select("item_id", metrics.accuracy_detail(F.col("text"), F.col("truth")).alias("d")).select("item_id", "d.*")


@query()
def baseline_ratio(spark, sf_dir):
    return pairs(spark, sf_dir).select("item_id", metrics.ratio(F.col("text"), F.col("truth")).alias("ratio"))


_WORDS = ("the", "er", "th", "ing")


@query(" UNION ALL ".join(f"SELECT item_id, '{w}' AS keyword, contains(truth, '{w}') AS in_gt, contains(text, '{w}') AS in_ocr, contains(truth, '{w}') AND contains(text, '{w}') AS correct FROM ({_PAIRS})" for w in _WORDS))
def keyword_matrix(spark, sf_dir):
    return pairs(spark, sf_dir).select("item_id", F.explode(metrics.keyword_matrix(F.col("text"), F.col("truth"), _WORDS)).alias("k")).select("item_id", "k.*")


@query("SELECT event_id, CASE WHEN value >= 95 THEN 'excellent' WHEN value >= 85 THEN 'good' WHEN value >= 70 THEN 'fair' ELSE 'poor' END AS band FROM events")
def accuracy_bands(spark, sf_dir):
    return R.table(spark, sf_dir, "events").select("event_id", metrics.accuracy_band(F.col("value")).alias("band"))


@query(f"SELECT page_id, engine_ord, round(0.6 * {_hits('text', fusion.KEYWORDS)} / 8 + 0.4 * confidence, 6) AS estimated FROM ({R.ENGINES})")
def estimated_accuracy(spark, sf_dir):
    return engines(spark, sf_dir).select("page_id", "engine_ord", F.round(metrics.estimated(classify.hits(F.col("text"), fusion.KEYWORDS), F.col("confidence")), 6).alias("estimated"))


@query("SELECT doc_id, CAST(length(replace(text, ' ', '')) - length(text) AS BIGINT) AS diff, round(CASE WHEN length(text) = 0 THEN 0 ELSE (length(replace(text, ' ', '')) - length(text)) * 100 / length(text)::DOUBLE END, 4) AS percent FROM documents")
def char_delta(spark, sf_dir):
    c = metrics.change(F.length(F.replace("text", F.lit(" "), F.lit(""))).cast("long"), F.length("text").cast("long"))
    return R.table(spark, sf_dir, "documents").select("doc_id", c.alias("c")).select("doc_id", "c.diff", F.round("c.percent", 4).alias("percent"))


@query("SELECT user_id, round(CASE WHEN max(value) = 0 THEN 0 ELSE sum(value) / max(value) END, 6) AS speed_up FROM events GROUP BY user_id")
def engine_speed_up(spark, sf_dir):
    return R.table(spark, sf_dir, "events").groupBy("user_id").agg(F.round(metrics.speed_up(F.sum("value"), F.max("value")), 6).alias("speed_up"))


@query("SELECT event_type, count(*) AS tests, count(*) FILTER (value >= 50) AS passed, round(coalesce(avg(value) FILTER (value >= 50), 0), 4) AS mean_accuracy, round(sum(value), 4) AS total_time, round(min(value), 4) AS least, round(max(value), 4) AS most FROM events GROUP BY event_type")
def benchmark_summary(spark, sf_dir):
    v = F.col("value")
    return R.table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("tests"), F.count_if(v >= 50).alias("passed"), F.round(F.coalesce(F.avg(F.when(v >= 50, v)), F.lit(0.0)), 4).alias("mean_accuracy"), F.round(F.sum(v), 4).alias("total_time"), F.round(F.min(v), 4).alias("least"), F.round(F.max(v), 4).alias("most"))


# --- files and images ----------------------------------------------------------------------------------


@query("SELECT page_id, 'uploads/ocr_others/' || CAST(page_id AS STRING) || '.' || split_part(url, '.', -1) AS path, 'https://cdn.example/' || CAST(page_id AS STRING) AS cdn_url, 'https://b.s3.amazonaws.com/' || CAST(page_id AS STRING) AS plain_url, CAST(page_id AS STRING) AS key FROM pages")
def storage_names(spark, sf_dir):
    key = F.col("page_id").cast("string")
    name = files.stored_name(F.col("url"), key)
    return R.table(spark, sf_dir, "pages").select("page_id", files.stored_path(F.lit("uploads/ocr_others"), name).alias("path"), files.object_url("b", key, cdn="https://cdn.example").alias("cdn_url"), files.object_url("b", key).alias("plain_url"), files.object_key(files.object_url("b", key)).alias("key"))


def images(spark, sf_dir, width: int = 20, channels: int = 1) -> DataFrame:
    """Images of a fixed width made of all bytes of each document, the last row filled with zeros; an empty or missing text is one row of zeros."""
    pixels = F.encode(F.coalesce("text", F.lit("")), "utf-8")
    height = F.greatest(F.lit(1), F.ceil(F.octet_length(pixels) / (width * channels))).cast("int")
    docs = R.table(spark, sf_dir, "documents").select("doc_id", pixels.alias("pixels"), height.alias("height"), F.lit(width).alias("width"), F.lit(channels).alias("channels"))
    return docs.withColumn("pixels", F.expr("rpad(pixels, height * width * channels, X'00')"))


def _image(name, kernel):
    def run(spark, sf_dir):
        out = imaging.over_pixels(kernel)(F.col("pixels"), F.col("height"), F.col("width"), F.col("channels"))
        return images(spark, sf_dir).select("doc_id", F.sha2(out, 256).alias("pixels_sha256"))

    QUERIES[name] = run


_image("image_sauvola", imaging.sauvola)
_image("image_mean_threshold", imaging.mean_threshold)
_image("image_gaussian_threshold", imaging.gaussian_threshold)
_image("image_denoise", imaging.denoise)


@query()
def image_watermark(spark, sf_dir):
    colour = images(spark, sf_dir, width=10, channels=3)
    return colour.select("doc_id", F.sha2(imaging.over_pixels(imaging.remove_red)(*map(F.col, ("pixels", "height", "width", "channels"))), 256).alias("pixels_sha256"))


@query("SELECT p_partkey, CAST(dpi AS BIGINT) AS dpi, round(s, 6) AS scale, CAST(floor(h * s) AS BIGINT) AS new_height, CAST(floor(w * s) AS BIGINT) AS new_width FROM (SELECT *, greatest(1.0::DOUBLE, 1500.0::DOUBLE / dpi) AS s FROM (SELECT *, CASE WHEN greatest(h, w) < 500 THEN 300 WHEN greatest(h, w) < 700 THEN 600 WHEN greatest(h, w) < 900 THEN 900 ELSE 1500 END AS dpi FROM (SELECT p_partkey, p_size * 30 AS h, CAST(floor(p_retailprice) AS INT) % 800 AS w FROM part)))")
def resolution_plan(spark, sf_dir):
    p = imaging.resolution_plan(F.col("p_size") * 30, F.floor("p_retailprice").cast("int") % 800)
    return R.table(spark, sf_dir, "part").select("p_partkey", p.alias("p")).select("p_partkey", "p.dpi", F.round("p.scale", 6).alias("scale"), "p.new_height", "p.new_width")


# --- whole chain, streams, extensions --------------------------------------------------------------------


_COUNTED = f"CAST(len(regexp_extract_all(text, {_q(rules.LAND_NUMBER[0])})) + len(regexp_extract_all(text, {_q(rules.ROC_DATE)})) + {_hits('text', rules.FIELD_NAMES)} AS BIGINT)"


@query(f"""
    WITH f AS (SELECT doc_id, fixed AS text, typo_fixes FROM ({_typos(R.CONTRACTS)})),
         g AS (SELECT doc_id, typo_fixes, {_COUNTED} AS format_corrections, {_FORMATTED} AS text FROM f),
         c AS (SELECT doc_id, typo_fixes, format_corrections, {_CLEAN} AS text FROM g)
    SELECT doc_id, text, 1::BIGINT AS total_pages, 0::BIGINT AS llm_pages_used, typo_fixes, format_corrections FROM c
""")
def analyze_contracts(spark, sf_dir):
    """The contract chain: clean-up, model step (offline), extraction, one row a document."""
    p = contracts(spark, sf_dir).select("doc_id", F.lit(1).alias("page_number"), F.col("text").alias("raw_text"), F.lit(0.9).alias("confidence"), F.lit(None).cast("string").alias("error"))
    return processors.document_context(processors.analyze(p, "contract"))


@query("SELECT user_id, CAST(time_bucket(INTERVAL 1 HOUR, ts) AS TIMESTAMP) AS window_start, count(*) AS requests FROM events GROUP BY ALL HAVING count(*) > 1")
def rate_limit_window(spark, sf_dir):
    out = lifecycle.over_limit(R.table(spark, sf_dir, "events"), most=1, width="1 hour")
    return out.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


def _shared(spark, name: str) -> str:
    """A new folder that all executors see."""
    import uuid

    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


@query("SELECT CAST(doc_id AS STRING) AS document_id, concat_ws('/', source, doc_id) AS file_name, CASE WHEN length(text) < 50 THEN 'failed' ELSE 'completed' END AS status, CASE WHEN length(text) < 50 THEN 'unreadable' END AS error_message FROM documents")
def stream_lifecycle(spark, sf_dir):
    """Documents as a stream of one trigger through their states; failed where the text is shorter than 50 characters."""
    root = _shared(spark, "lifecycle")
    source = spark.readStream.schema(R.table(spark, sf_dir, "documents").schema).parquet(f"{sf_dir}/documents.parque[t]")
    stream = source.select(F.col("doc_id").cast("string").alias("document_id"), F.concat_ws("/", "source", "doc_id").alias("file_name"), F.col("text").alias("content"))

    def work(batch: DataFrame) -> DataFrame:
        return batch.withColumns({"text": F.col("content"), "confidence": F.lit(1.0), "error": F.when(F.length("content") < 50, "unreadable")})

    lifecycle.run_stream(stream, work, f"{root}/out", f"{root}/state").awaitTermination()
    return lifecycle.latest_states(spark, f"{root}/out")


@query("SELECT event_type, CAST(user_id % 3 AS BIGINT) AS tier, count(*) AS calls, round(sum(value), 4) AS total FROM events GROUP BY ROLLUP (event_type, CAST(user_id % 3 AS BIGINT))")
def usage_by_type_rollup(spark, sf_dir):
    """Extension."""
    return R.table(spark, sf_dir, "events").withColumn("tier", (F.col("user_id") % 3).cast("long")).rollup("event_type", "tier").agg(F.count("*").alias("calls"), F.round(F.sum("value"), 4).alias("total"))


@query("WITH e AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 12 HOUR THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM e) SELECT user_id, min(ts) AS session_start, count(*) AS events FROM s GROUP BY user_id, n")
def user_sessions(spark, sf_dir):
    """Extension: sessions end after 12 hours without an event."""
    out = R.table(spark, sf_dir, "events").groupBy("user_id", F.session_window("ts", "12 hours")).agg(F.min("ts").alias("session_start"), F.count("*").alias("events"))
    return out.select("user_id", "session_start", "events")


@query(f"SELECT document_id, status, created_at FROM ({R.DOCUMENTS}) WHERE status = 'completed' AND document_type = 'contract' ORDER BY created_at DESC, document_id LIMIT 10 OFFSET 20")
def doc_list_filtered(spark, sf_dir):
    return relational.filtered_listing(stored(spark, sf_dir), "completed", "contract", 3, 10).select("document_id", "status", "created_at")


@query(f"SELECT document_id, CASE WHEN status <> 'completed' THEN 425 WHEN document_type = 'invoice' THEN 400 END AS error FROM ({R.DOCUMENTS})")
def record_errors(spark, sf_dir):
    kind = F.when(F.col("document_type") == "invoice", "unknown").otherwise("id_card")
    return stored(spark, sf_dir).select("document_id", relational.record_error(F.col("document_id"), F.col("status"), kind).alias("error"))


@query("SELECT conv_id AS page_id, md5(string_agg(text, chr(10) ORDER BY turn)) AS text_md5, round(avg(CAST(turn % 5 AS DOUBLE) / 4), 6) AS confidence FROM conversations GROUP BY conv_id")
def line_results(spark, sf_dir):
    lines = R.table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("page_id"), F.col("turn").alias("ord"), "text", ((F.col("turn") % 5).cast("double") / 4).alias("confidence"))
    return fusion.line_results(lines).select("page_id", F.md5("text").alias("text_md5"), F.round("confidence", 6).alias("confidence"))


@query("SELECT user_id, list(event_id ORDER BY ts DESC, event_id) [:10] AS events FROM events GROUP BY user_id")
def nested_children(spark, sf_dir):
    e = R.table(spark, sf_dir, "events").select(F.col("user_id").alias("document_id"), F.col("event_id").alias("id"), F.col("ts").alias("created_at"))
    return relational.nested(e.select("document_id").distinct(), {"events": e}).select(F.col("document_id").alias("user_id"), F.transform("events", lambda x: x["id"]).alias("events"))


@query("SELECT count(*) AS total, count(*) FILTER (value > 50 AND event_type <> 'error') AS compressed, count(*) FILTER (value <= 50 AND event_type <> 'error') AS skipped, count(*) FILTER (event_type = 'error') AS failed, round(sum(value - value / 2) FILTER (value > 50 AND event_type <> 'error'), 4) AS space_saved FROM events")
def compression_totals(spark, sf_dir):
    e = R.table(spark, sf_dir, "events").select(F.col("value").alias("length"), (F.col("value") / 2).alias("new_length"), F.when(F.col("event_type") == "error", "broken").alias("error"))
    return imaging.compression_totals(e, 50).withColumn("space_saved", F.round("space_saved", 4))


# --- model steps with stand-ins for the model, engines, files ------------------------------------------


def _text_of(prompt: str) -> str:
    return prompt.partition("\n---\n")[2]


def _model(answer):
    """A provider that answers from the text a prompt is about; a token is four characters."""

    def provide(prompts):
        told = [(p, answer(_text_of(p))) for p in prompts]
        return [(a, len(p) // 4, len(a) // 4, None) for p, a in told]

    return provide


_GATED = f"SELECT *, doc_id % 10 < 8 AS used, contains(text, 'ot plain') AS refused FROM ({R.TRANSCRIPTS})"


@query(f"SELECT doc_id, used, CASE WHEN used AND NOT refused THEN replace(text, 'O', '0') ELSE text END AS corrected FROM ({_GATED})")
def llm_correct_text(spark, sf_dir):
    """Whole texts below the confidence of 0.85 are corrected; the stand-in refuses some."""
    provider = _model(lambda t: "I'm sorry, I can't help." if "ot plain" in t else t.replace("O", "0"))
    gate = models.strategy(F.lit(True), F.lit("auto"), F.col("confidence")) == "full"
    df = transcripts(spark, sf_dir).withColumn("confidence", (F.col("doc_id") % 10 + 0.7) / 10)
    return models.correct(df, provider, gate).select("doc_id", "used", "corrected")


def _fields_corrected() -> str:
    told = {k: f"replace({k}, ' ', '')" for k in P.CANDIDATES}
    told["land_number"] = f"CASE WHEN regexp_matches({told['land_number']}, {_q(P.LAND_NUMBER_FORM)}) THEN {told['land_number']} ELSE land_number END"
    sql = f"SELECT doc_id, text, {', '.join(f'coalesce({", ".join(_first("text", p, g) for p, g in v)}) AS {k}' for k, v in P.CANDIDATES.items())} FROM ({R.TRANSCRIPTS})"
    for k, x in told.items():
        put = f"CASE WHEN {x} <> {k} AND instr(text, {k}) > 0 THEN substring(text, 1, instr(text, {k}) - 1) || {x} || substring(text, instr(text, {k}) + length({k})) ELSE text END"
        sql = f"SELECT * REPLACE ({put} AS text) FROM ({sql})"
    return f"SELECT doc_id, text AS corrected FROM ({sql})"


@query(_fields_corrected())
def llm_correct_fields(spark, sf_dir):
    """Field candidates asked about one by one; the stand-in takes out blanks."""
    return models.correct_fields(transcripts(spark, sf_dir), _model(lambda t: t.replace(" ", ""))).select("doc_id", "corrected")


@query(f"SELECT doc_id, CASE WHEN contains(text, '租金') THEN 'lease_contract' ELSE 'unknown' END AS doc_type, CASE WHEN contains(text, '租金') THEN 100.0 ELSE 12.5 END::DOUBLE AS confidence FROM ({R.CONTRACTS})")
def llm_classify(spark, sf_dir):
    provider = _model(lambda t: '```json {"doc_type": "lease_contract", "confidence": 140} ```' if "租金" in t else 'Well: {"doc_type": "letter", "confidence": "12.5"}')
    asked = models.ask(contracts(spark, sf_dir), models.classification_prompt(F.col("text")), provider)
    return asked.select("doc_id", models.parse_classification(F.col("answer.text")).alias("c")).select("doc_id", "c.doc_type", "c.confidence")


@query(f"SELECT doc_id, CASE WHEN state = 'O' THEN 'rent of ' || CAST(doc_id AS STRING) END AS rent, CASE WHEN state = 'O' THEN CAST(NULL AS STRING) END AS deposit FROM ({R.CONTRACTS})")
def llm_extract(spark, sf_dir):
    """Fields of leases; the stand-in leaves the deposit open, and has an empty object for other kinds."""
    df = contracts(spark, sf_dir).withColumn("kind", F.when(F.col("state") == "O", "lease_contract").otherwise("letter"))
    numbered = F.concat(F.col("doc_id").cast("string"), F.lit("\n"), F.col("text"))

    def provider(prompts):
        answers = [f'{{"rent": "rent of {_text_of(p).partition(chr(10))[0]}", "deposit": "null"}}' if '"deposit"' in p else "{}" for p in prompts]
        return [(a, 1, 1, None) for a in answers]

    asked = models.ask(df, models.extraction_prompt(F.col("kind"), numbered), provider).withColumn("got", models.parse_fields(F.col("answer.text")))
    return asked.select("doc_id", F.try_element_at("got", F.lit("rent")).alias("rent"), F.try_element_at("got", F.lit("deposit")).alias("deposit"))


@query("SELECT conv_id, turn, substring(text, 1, 20) AS summary FROM conversations")
def llm_summary(spark, sf_dir):
    asked = models.ask(R.table(spark, sf_dir, "conversations"), models.summary_prompt(F.col("text")), _model(lambda t: t[:20]))
    return asked.select("conv_id", "turn", F.col("answer.text").alias("summary"))


_TIDY = len(models.TIDY_TASK) + len(models.DASHES)


@query(f"SELECT count(*) AS llm_calls, CAST(sum(({_TIDY} + length(text)) // 4 + length(text) // 4) AS BIGINT) AS tokens_used, round(sum(({_TIDY} + length(text)) // 4) * 2.5 / 1e6 + sum(length(text) // 4) * 10 / 1e6, 6) AS estimated_cost FROM conversations WHERE role = 'user'")
def llm_stats(spark, sf_dir):
    """Turns of users are tidied; only these count."""
    asked = models.ask(R.table(spark, sf_dir, "conversations"), models.tidy_prompt(F.col("text")), _model(str), gate=F.col("role") == "user")
    return models.stats(asked, "openai", "gpt-4o").withColumn("estimated_cost", F.round("estimated_cost", 6))


@query("SELECT conv_id, turn, md5(json_object('ocr_text', text, 'doc_type', 'unknown', 'extracted_data', '{}', 'question', 'Who pays?')) AS asked_md5 FROM conversations")
def llm_questions(spark, sf_dir):
    asked = processors.answer_questions(R.table(spark, sf_dir, "conversations"), F.lit("Who pays?"), models.offline)
    return asked.select("conv_id", "turn", F.md5("answer.text").alias("asked_md5"))


@query("SELECT * FROM (VALUES " + ", ".join(f"({_q(k)}, {_q(v)})" for k, v in models.DEFAULT_MODELS.items()) + ") AS t(provider, model)")
def provider_defaults(spark, sf_dir):
    return spark.createDataFrame([(k, models.provider_options(k, "key")["model"]) for k in models.DEFAULT_MODELS], "provider string, model string")


@query("SELECT doc_id AS page_id, engine, CASE WHEN text IS NULL THEN md5('') WHEN engine = 'tesseract' THEN md5(replace(text, 'e', 'E')) ELSE md5(text) END AS text_md5, CASE WHEN text IS NULL THEN 0 WHEN engine = 'tesseract' THEN 0.5 ELSE 0.75 END::DOUBLE AS confidence, CASE WHEN text IS NULL THEN 'no image' END AS error FROM documents, (VALUES ('paddleocr'), ('tesseract')) AS e(engine)")
def engine_results(spark, sf_dir):
    """Two stand-ins for engines over every page, which is the text's bytes."""
    known = {"tesseract": lambda images: [(x.decode().replace("e", "E"), 0.5) for x in images], "paddleocr": lambda images: [(x.decode(), 0.75) for x in images]}
    pages_ = R.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("page_id"), F.encode("text", "utf-8").alias("image"))
    return fusion.recognise(pages_, ["paddleocr", "tesseract"], known).select("page_id", "engine", F.md5("text").alias("text_md5"), "confidence", "error")


@query(ORACLE_SQL["fuse_smart"])
def fuse_other(spark, sf_dir):
    """An unknown method is taken as smart."""
    return fusion.fuse(engines(spark, sf_dir), "other").select("page_id", F.md5("text").alias("text_md5"), F.round("confidence", 6).alias("confidence"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 5 > 3 OR p_partkey % 5 < 1 THEN 'UNSUPPORTED_FILE_TYPE' WHEN p_size * 400000 > 10485760 THEN 'FILE_TOO_LARGE' END AS error FROM part")
def validate_document(spark, sf_dir):
    mime = F.element_at(F.array(*map(F.lit, ("text/plain", *validate.MIME_TYPES[:3], "application/zip"))), (F.col("p_partkey") % 5 + 1).cast("int"))
    return R.table(spark, sf_dir, "part").select("p_partkey", validate.document_error(mime, F.col("p_size") * 400_000).alias("error"))


@query("SELECT conv_id, text FROM (SELECT *, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations) WHERE turn = 2 AND n >= 2")
def one_page(spark, sf_dir):
    turns = R.table(spark, sf_dir, "conversations")
    counted = turns.join(turns.groupBy("conv_id").agg(F.count("*").alias("total_pages")), "conv_id").withColumn("page_number", F.col("turn"))
    return files.one_page(counted, 2).select("conv_id", "text")


@query("SELECT page_id, md5('data:image/png;base64,' || base64(encode(html))) AS url_md5, round(octet_length(encode(html)) / 1048576.0::DOUBLE, 8) AS size_mb FROM pages")
def data_urls(spark, sf_dir):
    body = F.encode("html", "utf-8")
    return R.table(spark, sf_dir, "pages").select("page_id", F.md5(files.data_url(body)).alias("url_md5"), F.round(files.size_mb(F.octet_length(body)), 8).alias("size_mb"))


@query("SELECT conv_id AS doc_id, turn AS page_number, text AS raw_text FROM conversations")
def page_response(spark, sf_dir):
    picture = F.encode("raw_text", "utf-8")
    return pages.response(conversation_pages(spark, sf_dir).select("doc_id", "page_number", "raw_text", picture.alias("original_image")))


@query("SELECT user_id, round(CASE WHEN max(value) = 0 THEN 0 ELSE (sum(value) - max(value)) * 100 / max(value) END, 4) AS gain FROM events GROUP BY user_id")
def engine_gain(spark, sf_dir):
    return R.table(spark, sf_dir, "events").groupBy("user_id").agg(F.round(metrics.gain(F.sum("value"), F.max("value")), 4).alias("gain"))


@query("SELECT 'items/' || CAST(item_id AS STRING) || '.txt' AS path, octet_length(encode(text)) AS length, sha256(text) AS content_sha256 FROM benchmark")
def stored_files(spark, sf_dir):
    """Texts written as files to the shared folder, and read back."""
    root = _shared(spark, "stored-files")
    rows = R.table(spark, sf_dir, "benchmark").select(F.concat(F.lit("items/"), F.col("item_id").cast("string"), F.lit(".txt")).alias("path"), F.encode("text", "utf-8").alias("content"))
    written = files.store(rows, root).where("error is null").select("path")
    return files.fetch(written, root).select("path", F.octet_length("content").cast("long").alias("length"), F.sha2("content", 256).alias("content_sha256"))


_image("image_contrast", imaging.more_contrast)
_image("image_at_least", lambda image: imaging.at_least(image, 64))


@query()
def image_preprocess(spark, sf_dir):
    """Watermark, binarisation and noise, in colour images."""
    colour = images(spark, sf_dir, width=10, channels=3)
    kernel = lambda image: imaging.preprocess(image, method="gaussian", blur=3, target=None)
    return colour.select("doc_id", F.sha2(imaging.over_pixels(kernel)(*map(F.col, ("pixels", "height", "width", "channels"))), 256).alias("pixels_sha256"))


@query()
def image_diagnosis(spark, sf_dir):
    """Measures of colour images and their bands."""
    got = images(spark, sf_dir, width=10, channels=3).select("doc_id", imaging.measures()(*map(F.col, ("pixels", "height", "width", "channels"))).alias("m"))
    m = F.col("m")
    return got.select("doc_id", F.round(m["dpi"], 4).alias("dpi"), F.round(m["sharpness"], 4).alias("sharpness"), m["contrast"].alias("contrast"), F.round(m["red_percent"], 4).alias("red_percent"), m["text_height"].alias("text_height"), F.to_json(imaging.quality_bands(m["dpi"], m["sharpness"], m["contrast"], m["red_percent"], m["text_height"])).alias("bands"))


@query()
def image_configs(spark, sf_dir):
    """Every image with and without binarisation, read by a stand-in that counts light rows."""
    configs = {"plain": {"watermark": False, "target": None}, "mean": {"watermark": False, "method": "mean", "target": None}}
    return imaging.compare_configs(images(spark, sf_dir), configs, lambda image: "x" * int((image.mean(axis=1) > 128).sum()), ("x",), "doc_id")
