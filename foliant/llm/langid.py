"""Languages of documents as mixtures.

A language is a model of letters given the two letters before them, within
words. For each document, expectation-maximisation estimates which share of its
words each language wrote; languages are then taken out one by one, smallest
share first, as long as the likelihood, penalised by the number of languages
(half the logarithm of the words for each), does not fall.

Defined cases: a text that is null or has no letter gets `und`, score 0 and no
shares; with no labelled text to learn from, every text does. Ties go to the
language that is first in code point order. Rows are independent, whatever
batch they come in, so repeated rows give repeated results; texts of any length
are taken whole (cut between words where they are long); an empty table gives an
empty result; columns that are neither text nor asked for are not read, and one
named like a result is replaced by it.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import arrow_map, bounded_batches, hashed_share, shared_dir

BUCKETS = 17  # as a power of two
UNDETERMINED = "und"
_SLICE = 500_000


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """The lower-case letter of each code point, 0 for what is no letter."""
    return np.array([ord(c.lower()[0]) if c.isalpha() else 0 for c in map(chr, range(0x110000))], dtype=np.uint32)


def _bucket(*codes: np.ndarray) -> np.ndarray:
    h = np.uint32(0x51ED270B)
    for c, m in zip(codes, (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D)):
        h = (h ^ c) * np.uint32(m)
    h ^= h >> np.uint32(15)
    return ((h * np.uint32(0x27D4EB2F)) >> np.uint32(32 - BUCKETS)).astype(np.int64)


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bucket of each letter with its context, bucket of the context, first position of each word, text of each word)."""
    codes = np.frombuffer("".join(t + "\n" for t in texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    x = _letters()[codes]
    before = np.concatenate((np.zeros(1, np.uint32), x[:-1])) if len(x) else x
    at = np.flatnonzero((x > 0) | (before > 0))
    if not len(at):
        return at, at, at, at
    c2 = before[at]
    c1 = np.where(c2 > 0, before[np.maximum(at - 1, 0)], np.uint32(0))
    word = np.flatnonzero(c2 == 0)
    ends = np.cumsum([len(t) + 1 for t in texts])
    return _bucket(c1, c2, x[at]), _bucket(c1, c2), word, np.searchsorted(ends, at[word], side="right")


@dataclass
class Model:
    languages: list[str]
    follow: np.ndarray  # [bucket, language]: log of a letter's count after its context
    context: np.ndarray  # the same of the context


def _cut(text: str, at: int, end: int) -> int:
    """Where a slice from at on ends: end or, within a word, the word's beginning, or its end if nothing stands before it."""
    if end >= len(text):
        return len(text)
    i = end
    while i > at and text[i].isalpha() and text[i - 1].isalpha():
        i -= 1
    if i > at:
        return i
    while end < len(text) and text[end].isalpha():
        end += 1
    return end


def _slices(texts: list[str]):
    """(numbers of texts, texts) of bounded length together; a longer text comes in several slices of whole words."""
    held, size = [], 0
    for n, t in enumerate(texts):
        i = 0
        while i < len(t):
            j = _cut(t, i, i + _SLICE)
            if held and size + j - i > _SLICE:
                yield held
                held, size = [], 0
            held.append((n, t[i:j]))
            size += j - i
            i = j
    if held:
        yield held


def train(docs: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", per_language: int = 1500) -> Model:
    """Learn from about per_language labelled documents of each language at most, chosen by their id's hash."""
    spark = docs.sparkSession
    shared_dir(spark)
    bounded_batches(spark)
    known = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(text).alias("text"), F.col(lang).alias("lang"), F.col(doc_id).alias("doc_id"))
    counts = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}  # a row a language
    if not counts:
        return Model([], np.zeros((1 << BUCKETS, 0), np.float32), np.zeros((1 << BUCKETS, 0), np.float32))
    share = F.create_map(*[F.lit(v) for k, n in counts.items() for v in (k, min(1.0, per_language / n))])
    sample = known.where(hashed_share("doc_id", 1) < share[F.col("lang")]).select("text", "lang")

    def count(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            by: dict[str, list[str]] = {}
            for t, name in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist()):
                by.setdefault(name, []).append(t)
            for name, texts in by.items():
                s = sums.setdefault(name, np.zeros((2, 1 << BUCKETS), np.int64))
                for part in _slices(texts):
                    full, context, _, _ = grams([t for _, t in part])
                    s[0] += np.bincount(full, minlength=1 << BUCKETS)
                    s[1] += np.bincount(context, minlength=1 << BUCKETS)
        for name, s in sums.items():
            at = np.flatnonzero(s)
            yield {"lang": [name], "at": [at.astype(np.int32)], "n": [s.ravel()[at]]}

    def add(group):
        total = np.zeros(2 << BUCKETS, np.int64)
        for at, n in zip(group["at"], group["n"]):
            total[at] += n
        at = np.flatnonzero(total)
        return group.head(1).assign(at=[at.astype(np.int32)], n=[total[at]])

    schema = "lang string, at array<int>, n array<long>"
    rows = arrow_map(sample, count, schema).groupBy("lang").applyInPandas(add, schema).collect()
    names = sorted(r["lang"] for r in rows)
    follow, context = np.zeros((1 << BUCKETS, len(names))), np.zeros((1 << BUCKETS, len(names)))
    for r in rows:
        total = np.zeros(2 << BUCKETS)
        total[r["at"]] = r["n"]
        i = names.index(r["lang"])
        follow[:, i], context[:, i] = total[: 1 << BUCKETS], total[1 << BUCKETS :]
    small = 0.05
    return Model(names, np.log(follow + small).astype(np.float32), np.log(context + small * 40).astype(np.float32))


def _maximise(p: np.ndarray, first: np.ndarray, doc: np.ndarray, share: np.ndarray, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """(shares, log-likelihood up to the words' own constants) after expectation-maximisation; languages of share 0 stay out. A text is done when its own shares have settled, whatever texts stand beside it."""
    n, going = np.diff(np.append(first, len(p)))[:, None], np.ones(len(first), dtype=bool)
    for _ in range(steps):
        r = p * share[doc]
        r /= r.sum(axis=1, keepdims=True)
        new = np.add.reduceat(r, first) / n
        moved = np.abs(new - share).max(axis=1) >= 1e-3
        share = np.where(going[:, None], new, share)
        going &= moved
        if not going.any():
            break
    return share, np.add.reduceat(np.log((p * share[doc]).sum(axis=1) + 1e-300), first)


def infer(model: Model, texts: list[str], steps: int = 12, penalty: float = 1.0) -> np.ndarray:
    """Shares [text, language], of rows without letters all 0."""
    out = np.zeros((len(texts), len(model.languages)))
    if not model.languages:
        return out
    scores, owners = [], []
    for part in _slices(texts):
        full, context, word, owner = grams([t for _, t in part])
        if len(word):
            scores.append(np.add.reduceat(model.follow[full] - model.context[context], word))
            owners.append(np.array([n for n, _ in part])[owner])
    if not scores:
        return out
    ll, owner = np.concatenate(scores).astype(np.float64), np.concatenate(owners)
    p = np.exp(np.maximum(ll - ll.max(axis=1, keepdims=True), -60.0))
    first = np.concatenate(([0], np.flatnonzero(owner[1:] != owner[:-1]) + 1))
    texts_at, size = owner[first], np.diff(np.append(first, len(owner)))
    doc = np.repeat(np.arange(len(first)), size)
    cost = penalty * 0.5 * np.log(np.maximum(size, 2))
    share, like = _maximise(p, first, doc, np.full((len(first), p.shape[1]), 1 / p.shape[1]), steps)
    share = np.where(share < 1e-4, 0, share)
    share /= share.sum(axis=1, keepdims=True)
    active = np.arange(len(first))
    while len(active := active[(share[active] > 0).sum(axis=1) > 1]):
        smaller = share[active]
        smaller[np.arange(len(active)), np.where(smaller > 0, smaller, 2).argmin(axis=1)] = 0
        smaller /= smaller.sum(axis=1, keepdims=True)
        words = np.isin(doc, active) if len(active) < len(first) else np.ones(len(doc), bool)
        n = size[active]
        tried, tried_like = _maximise(p[words], np.concatenate(([0], np.cumsum(n)[:-1])), np.repeat(np.arange(len(active)), n), smaller, steps)
        better = tried_like + cost[active] >= like[active]
        active, tried, tried_like = active[better], tried[better], tried_like[better]
        share[active], like[active] = tried, tried_like
    out[texts_at] = share
    return out


def identify(docs: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None, steps: int = 12, penalty: float = 1.0) -> DataFrame:
    """The columns keep of docs (all by default; those named like a result are replaced), then lang_pred, score (the share of that language) and lang_shares (a map)."""
    spark = docs.sparkSession
    bounded_batches(spark)
    keep = [c for c in (docs.columns if keep is None else keep) if c.lower() not in ("lang_pred", "score", "lang_shares")]
    held = spark.sparkContext.broadcast(model)
    kinds = dict(docs.dtypes)

    def work(batches):
        names = held.value.languages
        for batch in batches:
            shares = infer(held.value, [t or "" for t in batch.column("__text").to_pylist()], steps, penalty)
            best = shares.argmax(axis=1) if names else np.zeros(len(shares), int)
            found = shares.any(axis=1)
            yield {k: batch.column(k) for k in keep} | {
                "lang_pred": [names[b] if f else UNDETERMINED for b, f in zip(best.tolist(), found.tolist())],
                "score": np.clip(shares.max(axis=1), 0, 1) if names else np.zeros(len(shares)),
                "lang_shares": [[(names[j], float(s[j])) for j in np.flatnonzero(s)] for s in shares],
            }

    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keep) + ", lang_pred string, score double, lang_shares map<string,double>"
    return arrow_map(docs.select(*keep, F.col(text).alias("__text")), work, schema)
