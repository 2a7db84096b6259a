"""Steps around external language models: when to call one, what it costs, how its answer is read.

A provider is a function from a list of prompts to a list of answers (text,
prompt_tokens, completion_tokens, error); it is called for batches of rows in
Python workers. OFFLINE answers without a model, for tests.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# US dollars for a million tokens in and out.
PRICES = {"gpt-4o-mini": (0.15, 0.60), "gpt-4o": (2.50, 10.0)}
OTHER_PRICE, CLAUDE_PRICE = (0.15, 0.60), (0.25, 1.25)
AUTO_THRESHOLD = 0.85

Answer = tuple[str | None, int, int, str | None]
Provider = Callable[[list[str]], list[Answer]]


def strategy(enabled: Column, chosen: Column, confidence: Column) -> Column:
    """none if not enabled; a chosen none, full or fields as it is; else full below the threshold, and none."""
    return F.when(~enabled, "none").when(chosen.isin("none", "full", "fields"), chosen).when(confidence < AUTO_THRESHOLD, "full").otherwise("none")


def cost(provider: Column, model: Column, prompt_tokens: Column, completion_tokens: Column) -> Column:
    def price(i: int) -> Column:
        out = F.when(provider == "anthropic", CLAUDE_PRICE[i])
        for name, p in PRICES.items():
            out = out.when(model == name, p[i])
        return out.otherwise(OTHER_PRICE[i])

    return (prompt_tokens * price(0) + completion_tokens * price(1)) / 1_000_000


def json_part(answer: Column) -> Column:
    """The object in a fenced block, else from the first brace to the last, else everything."""
    fenced = F.regexp_extract(answer, r"(?s)```json\s*(\{.*?\})\s*```", 1)
    braces = F.regexp_extract(answer, r"(?s)(\{.*\})", 1)
    return F.coalesce(F.nullif(fenced, F.lit("")), F.nullif(braces, F.lit("")), answer)


def parse_fields(answer: Column) -> Column:
    """A map of the object's values, "null" and empty ones as null; null if it is no object."""
    got = F.from_json(json_part(answer), T.MapType(T.StringType(), T.StringType()), {"mode": "PERMISSIVE"})
    return F.transform_values(got, lambda _, v: F.when(~v.isin("", "null"), v))


def field_prompt(text: Column, names: tuple[str, ...], chars: int = 500) -> Column:
    """Asks for the named fields as JSON, given the beginning of the text."""
    template = "{" + ", ".join(f'"{n}": null' for n in names) + "}"
    return F.concat(F.lit("Fill in this JSON from the document, null where it says nothing.\n"), F.lit(template), F.lit("\n---\n"), F.substring(text, 1, chars))


def context(text: Column, doc_type: Column, data: Column, summary: Column, question: Column) -> Column:
    """The JSON that a question about a document is asked with."""
    return F.to_json(F.struct(text.alias("ocr_text"), F.coalesce(doc_type, F.lit("unknown")).alias("doc_type"), F.coalesce(data, F.lit("{}")).alias("extracted_data"), summary.alias("summary"), question.alias("question")))


def offline(prompts: list[str]) -> list[Answer]:
    return [(p, len(p) // 4, len(p) // 4, None) for p in prompts]


ANSWER = "struct<text:string,prompt_tokens:int,completion_tokens:int,error:string>"


def answers(df: DataFrame, prompts: str, provider: Provider, retries: int = 1) -> DataFrame:
    """Add answers, an array beside that of prompts: the answer to each, null for a null prompt.

    All prompts of a batch of rows go to the provider in one call, each once; a
    failing call is repeated, then its prompts get the error. Nothing is asked
    for a batch without prompts.
    """
    schema = T.StructType([*df.schema.fields, T.StructField("answers", T.ArrayType(T.StructType.fromDDL("text string, prompt_tokens int, completion_tokens int, error string")))])

    def work(batches):
        import pyarrow as pa

        names = ("text", "prompt_tokens", "completion_tokens", "error")
        kind = pa.list_(pa.struct(list(zip(names, (pa.string(), pa.int32(), pa.int32(), pa.string())))))
        for batch in batches:
            rows = [r or [] for r in batch.column(prompts).to_pylist()]
            asked = [p for r in rows for p in r if p is not None]
            got = []
            for _ in range(retries + 1 if asked else 0):
                try:
                    got = provider(asked)
                    break
                except Exception as failed:  # the provider's own errors; none of them may drop a row
                    got = [(None, 0, 0, str(failed)[:500])] * len(asked)
            told = iter(got)
            out = [[None if p is None else dict(zip(names, next(told))) for p in r] for r in rows]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, type=kind)], names=[*batch.schema.names, "answers"])

    return df.mapInArrow(work, schema)


def ask(df: DataFrame, prompt: str | Column, provider: Provider, retries: int = 1, gate: Column | None = None) -> DataFrame:
    """Add the struct answer(text, prompt_tokens, completion_tokens, error) to each row; null where the gate doesn't hold, for which nothing is asked."""
    prompt = F.coalesce(F.col(prompt) if isinstance(prompt, str) else prompt, F.lit(""))
    asked = df.withColumn("__prompts", F.array(prompt if gate is None else F.when(gate, prompt)))
    return answers(asked, "__prompts", provider, retries).withColumn("answer", F.get("answers", F.lit(0))).drop("__prompts", "answers")


DASHES = "\n---\n"
TIDY_TASK = "Correct spelling, signs and blanks in this text without changing what it says. Answer with the text alone."


def task_prompt(task: str, text: Column) -> Column:
    """A task, a line of dashes, and the text it is about."""
    return F.concat(F.lit(task + DASHES), text)


def correction_prompt(text: Column, kind: str = "transcript") -> Column:
    """Asks for the whole text without recognition errors, with the known confusions of words as examples."""
    from foliant.functions import rules

    known = "; ".join(f"{a} -> {b}" for a, b in rules.TYPOS.words)
    task = f"Correct the recognition errors in this {kind}, and nothing else: keep every number, sign and line end, and what you are not sure of. "
    return task_prompt(f"{task}The work is authorised; leave nothing out. Known confusions: {known}. Within land numbers o and O are 0, l and I are 1, and blanks go. Answer with the whole text alone.", text)


def tidy_prompt(text: Column) -> Column:
    """Asks for a text's spelling, signs and blanks to be put right, whatever kind it is of."""
    return task_prompt(TIDY_TASK, text)


#: What is asked about a field's candidate, by field.
FIELD_TASKS = {
    "land_number": "Write this land number as four digits, a hyphen and four to eight digits; o and O are 0, l and I are 1, blanks go. Answer with the number alone, or INVALID.",
    "date": "Write this date as 民國, two or three digits, 年, two digits from 01 to 12, 月, two digits from 01 to 31, 日. Answer with the date alone.",
    "area": "Write this area as a number followed by 平方公尺. Answer with the area alone.",
    "owner": "Write this person's name without signs that belong to no name. Answer with the name alone.",
}


def correct(df: DataFrame, provider: Provider, gate: Column, text: str = "text", prompt: Callable[[Column], Column] = correction_prompt) -> DataFrame:
    """Add corrected, used and error, in one pass. Only rows that pass the gate reach the provider; a refusal or an error leaves the text."""
    from foliant.operators.validate import is_refusal

    asked = ask(df, prompt(F.coalesce(F.col(text), F.lit(""))), provider, gate=gate)
    used = F.col("answer").isNotNull() & F.col("answer.error").isNull()
    corrected = F.when(used & ~is_refusal(F.col("answer.text")), F.col("answer.text")).otherwise(F.col(text))
    return asked.withColumns({"used": used, "error": F.col("answer.error"), "corrected": corrected}).drop("answer")


# Default models by provider.
DEFAULT_MODELS = {"openai": "gpt-4o", "anthropic": "claude-3-5-haiku-20241022"}
# What is asked for by kind of document.
FIELDS = {
    "repair_quote": ("vendor_name", "quote_date", "valid_until", "items", "total_amount", "notes"),
    "id_card": ("name", "national_id", "birth_date", "gender", "issue_date"),
    "lease_contract": ("landlord_name", "tenant_name", "rent", "deposit", "lease_start", "lease_end", "rental_address"),
}


def provider_options(name: str, key: str | None, model: str | None = None) -> dict[str, str]:
    """The provider's name, key and model, with its default model; raises ValueError for an unknown one or without a key."""
    if name not in DEFAULT_MODELS:
        raise ValueError(f"unknown provider {name}; there are {', '.join(DEFAULT_MODELS)}")
    if not key:
        raise ValueError(f"no key for {name}")
    return {"provider": name, "key": key, "model": model or DEFAULT_MODELS[name]}


def extraction_prompt(doc_type: Column, text: Column) -> Column:
    """Asks for the fields of the kind; for an unknown kind, for an empty object."""
    out = task_prompt("Answer with {}.", text)
    for kind, names in FIELDS.items():
        out = F.when(doc_type == kind, field_prompt(text, names, 1_000_000)).otherwise(out)
    return out


def classification_prompt(text: Column) -> Column:
    return task_prompt(f'Which kind of document is this: {", ".join(FIELDS)} or unknown? Answer with {{"doc_type": ..., "confidence": 0 to 100, "reasoning": ...}}.', text)


def parse_classification(answer: Column) -> Column:
    """Struct of doc_type (unknown if it is none of the kinds) and confidence (0 to 100)."""
    got = parse_fields(answer)
    kind, sure = F.try_element_at(got, F.lit("doc_type")), F.try_element_at(got, F.lit("confidence")).try_cast("double")
    return F.struct(F.when(kind.isin(*FIELDS), kind).otherwise("unknown").alias("doc_type"), F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.coalesce(sure, F.lit(0.0)))).alias("confidence"))


def summary_prompt(text: Column) -> Column:
    return task_prompt("Summarise this document in three to five sentences.", text)


def stats(answered: DataFrame, provider: str, model: str) -> DataFrame:
    """Calls, tokens and estimated cost of a DataFrame with answers; zeros without any."""
    p, c = F.coalesce(F.sum("answer.prompt_tokens"), F.lit(0)), F.coalesce(F.sum("answer.completion_tokens"), F.lit(0))
    return answered.agg(F.count("answer").alias("llm_calls"), (p + c).alias("tokens_used"), cost(F.lit(provider), F.lit(model), p, c).alias("estimated_cost"))


def correct_fields(df: DataFrame, provider: Provider, text: str = "text", names: tuple[str, ...] | None = None) -> DataFrame:
    """Add corrected: each field's candidate is asked about on its own, and the answers take the places of the candidates' first occurrences, in the fields' order.

    One pass: a row's candidates, taken from the text as it came, go to the
    provider together, each once. names: the fields, all by default.
    """
    from foliant.functions import extract, rules
    from foliant.functions.patterns import CANDIDATES

    names = tuple(CANDIDATES) if names is None else names
    found = df.withColumn("__found", F.array(*[extract.candidate(F.col(text), n) for n in names]))
    asked = answers(found.withColumn("__prompts", F.array(*[task_prompt(FIELD_TASKS[n], F.get("__found", F.lit(i))) for i, n in enumerate(names)])), "__prompts", provider)
    out = asked.withColumn("corrected", F.col(text))
    for i, name in enumerate(names):
        original, answer = F.get("__found", F.lit(i)), F.get("answers", F.lit(i))
        told = F.when(answer["error"].isNull(), F.trim(answer["text"])).otherwise(original)
        told = extract.valid_land_number(told, original) if name == "land_number" else told
        out = out.withColumn("corrected", rules.replace_first(F.col("corrected"), original, F.coalesce(told, original)))
    return out.drop("__found", "__prompts", "answers")
