"""One result for each page out of those of several recognition engines."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions.classify import hits

# Keywords that speak for a result, and the weights of length, keywords and confidence.
KEYWORDS = ("地號", "面積", "統一編號", "謄本", "建物", "土地", "所有權", "登記")
WEIGHTS = (0.40, 0.35, 0.25)
METHODS = ("best", "smart", "vote", "weighted")


def standard_confidence(value: Column, engine: Column) -> Column:
    """A number from 0 to 1: 0 for what is no number; percentages of one engine are divided by 100."""
    x = F.coalesce(F.expr("try_cast(0 as double)") if value is None else value.try_cast("double"), F.lit(0.0))
    x = F.when((engine == "textract") & (x > 1), x / 100).otherwise(x)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.when(F.isnan(x), 0.0).otherwise(x)))


def word_confidence(df: DataFrame, page: str, value: str) -> DataFrame:
    """The mean of a page's word confidences as a share of 1; -1 marks words without one, and a page of such only has 0."""
    return df.groupBy(page).agg(F.coalesce(F.avg(F.when(F.col(value) != -1, F.col(value))) / 100, F.lit(0.0)).alias("confidence"))


def smart_score(text: Column, longest: Column, confidence: Column) -> Column:
    length = F.when(longest > 0, F.length(text) / longest).otherwise(0.0)
    return length * WEIGHTS[0] + hits(text, KEYWORDS) / len(KEYWORDS) * WEIGHTS[1] + confidence * WEIGHTS[2]


def fuse(results: DataFrame, method: str = "smart", page: str = "page_id") -> DataFrame:
    """(page, text, confidence). results: page, engine_ord, text, confidence; ties go to the smallest engine_ord.

    One aggregation, combined before its shuffle. An unknown method means smart.
    """
    c, n, order = F.col("confidence"), F.length("text"), -F.col("engine_ord")
    by = results.groupBy(page)
    if method == "best":
        return by.agg(F.max_by("text", F.struct(c, order)).alias("text"), F.max("confidence").alias("confidence"))
    if method == "vote":
        return by.agg(F.max_by("text", F.struct(n, order)).alias("text"), F.avg("confidence").alias("confidence"))
    if method == "weighted":
        out = by.agg(F.max_by("text", F.struct(c, order)).alias("best"), F.max_by("text", order).alias("first"), F.sum("confidence").alias("s"), F.avg("confidence").alias("mean"))
        return out.select(page, F.when(F.col("s") == 0, F.col("first")).otherwise(F.col("best")).alias("text"), F.when(F.col("s") == 0, 0.0).otherwise(F.col("mean")).alias("confidence"))
    longest = by.agg(F.max(n).alias("longest"))
    scored = results.join(longest, page).withColumn("score", smart_score(F.col("text"), F.col("longest"), c))
    best = F.max_by(F.struct("text", "confidence"), F.struct("score", order))
    return scored.groupBy(page).agg(best.alias("r")).select(page, "r.text", "r.confidence")


def fuse_all(results: DataFrame, page: str = "page_id") -> DataFrame:
    """(page, best, smart, vote, weighted), each a struct of text and confidence as fuse() gives them, in one aggregation over the page's few engines."""
    one = F.struct("engine_ord", "text", "confidence")
    by = results.groupBy(page).agg(F.array_sort(F.collect_list(one)).alias("r"))
    by = by.withColumn("longest", F.array_max(F.transform("r", lambda x: F.length(x["text"])))).withColumn("mean", F.aggregate("r", F.lit(0.0), lambda a, x: a + x["confidence"], lambda a: a / F.size("r")))

    def top(rank):  # the first of those with the greatest rank
        return F.array_max(F.transform("r", lambda x: F.struct(rank(x).alias("rank"), (-x["engine_ord"]).alias("o"), x["text"].alias("text"), x["confidence"].alias("confidence"))))

    def pick(x, confidence=None):
        return F.struct(x["text"].alias("text"), (x["confidence"] if confidence is None else confidence).alias("confidence"))

    best, mean = top(lambda x: x["confidence"]), F.col("mean")
    weighted = F.when(mean == 0, F.struct(F.get("r", F.lit(0))["text"].alias("text"), F.lit(0.0).alias("confidence"))).otherwise(pick(best, mean))
    smart = top(lambda x: smart_score(x["text"], F.col("longest"), x["confidence"]))
    return by.select(page, pick(best).alias("best"), pick(smart).alias("smart"), pick(top(lambda x: F.length(x["text"])), mean).alias("vote"), weighted.alias("weighted"))


def compare_methods(results: DataFrame, page: str = "page_id") -> DataFrame:
    """For each method its characters, keywords and mean confidence over all pages, and whether it is the best by keywords, then characters."""
    told = fuse_all(results, page).select(*[F.struct(F.length(F.col(m)["text"]).cast("long").alias("n"), hits(F.col(m)["text"], KEYWORDS).alias("k"), F.col(m)["confidence"].alias("c")).alias(m) for m in METHODS])
    sums = told.agg(*[F.struct(F.lit(m).alias("method"), F.sum(F.col(m)["n"]).alias("chars"), F.sum(F.col(m)["k"]).alias("keywords"), F.round(F.avg(F.col(m)["c"]), 4).alias("confidence"), F.lit(-i).alias("o")).alias(m) for i, m in enumerate(METHODS)])
    rows = F.array(*METHODS)
    best = F.array_max(F.transform(rows, lambda x: F.struct(x["keywords"], x["chars"], x["o"], x["method"].alias("method"))))
    out = sums.where(F.col(METHODS[0])["chars"].isNotNull()).select(F.inline(F.transform(rows, lambda x: F.struct(x["method"].alias("method"), x["chars"].alias("chars"), x["keywords"].alias("keywords"), x["confidence"].alias("confidence"), (x["method"] == best["method"]).alias("is_best")))))
    return out


def page_text(blocks: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Line blocks joined in order, and the number of page blocks, 1 at least. blocks: doc, ord, block_type, text."""
    lines = F.sort_array(F.collect_list(F.when(F.col("block_type") == "LINE", F.struct("ord", "text"))))
    return blocks.groupBy(doc).agg(F.array_join(F.transform(lines, lambda x: x["text"]), "\n").alias("text"), F.greatest(F.count_if(F.col("block_type") == "PAGE"), F.lit(1)).alias("pages"))


def line_results(lines: DataFrame, page: str = "page_id") -> DataFrame:
    """A page's lines joined in order, and their mean confidence; lines: page, ord, text, confidence."""
    texts = F.transform(F.sort_array(F.collect_list(F.struct("ord", "text"))), lambda x: x["text"])
    return lines.groupBy(page).agg(F.array_join(texts, "\n").alias("text"), F.coalesce(F.avg("confidence"), F.lit(0.0)).alias("confidence"))


def fuse_valid(pages: DataFrame, results: DataFrame, method: str = "smart", page: str = "page_id") -> DataFrame:
    """Every page: its fused result out of those without an error, or an empty text with confidence 0 if there is none."""
    fused = fuse(results.where("error is null"), method, page)
    return pages.select(page).join(fused, page, "left").select(page, F.coalesce("text", F.lit("")).alias("text"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"))


#: An engine reads a list of images: a text and a confidence for each.
Engine = Callable[[list[bytes]], list[tuple[str, float]]]


def recognise(pages: DataFrame, names: list[str], engines: dict[str, Engine], page: str = "page_id", image: str = "image") -> DataFrame:
    """(page, engine_ord, engine, text, confidence, error): one row a page and engine, in the order of names.

    An unknown name raises ValueError. An engine that fails leaves an empty text
    with confidence 0 and the error, and the others' rows as they are; a null
    image is such a failure. A page is sent to a worker once.
    """
    if unknown := [n for n in names if n not in engines]:
        raise ValueError(f"unknown engine {unknown[0]}; there are {', '.join(engines)}")
    kind, chosen = dict(pages.dtypes)[page], [(i, n, engines[n]) for i, n in enumerate(names)]

    def work(batches):
        import pyarrow as pa

        for batch in batches:
            ids, images = batch.column(page).to_pylist(), batch.column(image).to_pylist()
            fine, rows = [k for k, x in enumerate(images) if x is not None], []
            for i, name, engine in chosen:
                got = {k: ("", 0.0, "no image") for k in range(len(ids))}
                try:
                    told = engine([images[k] for k in fine]) if fine else []
                    got |= {k: (t, c, None) for k, (t, c) in zip(fine, told, strict=True)}
                except Exception as failed:  # the engine's own errors
                    got |= {k: ("", 0.0, str(failed)[:500]) for k in fine}
                rows += [(ids[k], i, name, *got[k]) for k in range(len(ids))]
            types = (batch.schema.field(page).type, pa.int32(), pa.string(), pa.string(), pa.float64(), pa.string())
            columns = list(zip(*rows)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, types)], names=[page, "engine_ord", "engine", "text", "confidence", "error"])

    return pages.select(page, image).mapInArrow(work, f"`{page}` {kind}, engine_ord int, engine string, text string, confidence double, error string")
