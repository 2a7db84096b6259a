"""Quality by nearest labelled neighbours in a latent-semantic space.

Terms are a text's words, hashed, and short runs of character shapes (letter
case, digits, blanks, each other sign for itself), of characters of different
shape in a row, and of repeated words and lines. Their weighted frequencies in
labelled documents are reduced by a singular value decomposition. The labelled vectors, a bounded
number, are broadcast; each document's cosines with all of them are computed in
blocks, and its nearest vote by similarity, weighted so that classes have the
weight that they have among all labels.

Defined cases: a null or empty text gets score 0; without labelled documents
every text that isn't empty gets 0.5; labels other than 0 and 1 are left out,
repeated ones of a document are averaged; of equally near neighbours the one
with the smaller doc_id comes first; rows are independent, whatever batch they
come in, so repeated rows give repeated results; texts of any length are counted
whole; an empty table gives an empty result; other columns are not read, and one
named like a result is replaced by it.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import arrow_map, bounded_batches, hashed_share, shared_dir

SHAPES = 4096
TERMS = 2 * SHAPES  # the second half: words
WORDS_COUNT = 0.5  # the words' part in a vector, against 1 for the shapes'
_SLICE = 500_000
_STEPS = 1 << 20  # factors of products are whole numbers of such steps to 1, unit vectors' of 16 times as many


@lru_cache(maxsize=1)
def _shapes() -> np.ndarray:
    """1 lower-case or caseless letter, 2 upper case, 3 digit, 4 blank, 5 line end; other signs 6 to 63."""
    out = np.empty(0x110000, dtype=np.uint32)
    for i, c in enumerate(map(chr, range(0x110000))):
        out[i] = 5 if c == "\n" else 4 if c.isspace() else 2 if c.isupper() else 1 if c.isalpha() else 3 if c.isdigit() else 6 + i % 58
    return out


def _term(value: np.ndarray, kind: int) -> np.ndarray:
    h = (value.astype(np.uint32) ^ np.uint32(kind * 0x3C6EF372)) * np.uint32(0x9E3779B1)
    h ^= h >> np.uint32(13)
    return ((h * np.uint32(0x85EBCA77)) >> np.uint32(20)).astype(np.int64)


def term_counts(texts: list[str]) -> np.ndarray:
    """[text, term] counts, each text's for itself; short texts are counted together."""
    out = np.zeros((len(texts), TERMS), dtype=np.float32)
    held, size = [], 0
    for n, t in enumerate(texts):
        if held and size + len(t) > _SLICE:
            _count(held, out)
            held, size = [], 0
        held.append((n, t))
        size += len(t)
    if held:
        _count(held, out)
    return out


def _count(parts: list[tuple[int, str]], out: np.ndarray) -> None:
    codes = np.frombuffer("".join(t + "\n" for _, t in parts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    owner = np.repeat(np.array([n for n, _ in parts], dtype=np.int32), [len(t) + 1 for _, t in parts])
    low, n = int(owner[0]), int(owner[-1] - owner[0] + 1)
    s = _shapes()[codes]
    total = np.zeros(n * TERMS, dtype=np.int64)

    def add(who, term, weights=None):
        at = (who - low).astype(np.int64) * TERMS + term
        np.add(total, np.bincount(at, weights, minlength=n * TERMS), out=total, casting="unsafe")

    for i in range(0, len(s), _SLICE):  # a window belongs to a text as a whole, or to none
        x, o = s[i : i + _SLICE + 2], owner[i : i + _SLICE + 2]
        own = o[2:] == o[:-2]
        add(o[2:][own], _term(x[:-2] << np.uint32(12) | x[1:-1] << np.uint32(6) | x[2:], 1)[own])
    turn = np.flatnonzero(np.append(True, (s[1:] != s[:-1]) | (owner[1:] != owner[:-1])))
    r, ro = s[turn], owner[turn]
    own = ro[3:] == ro[:-3]
    add(ro[3:][own], _term(r[:-3] << np.uint32(18) | r[1:-2] << np.uint32(12) | r[2:-1] << np.uint32(6) | r[3:], 2)[own])
    blank = (s == 4) | (s == 5)
    begin = np.flatnonzero(~blank & np.append(True, blank[:-1]))
    mixed = codes * np.uint32(0x9E3779B1)

    def hashes(starts):
        place = np.arange(len(codes), dtype=np.uint32) - np.repeat(np.append(0, starts).astype(np.uint32), np.diff(np.concatenate(([0], starts, [len(codes)]))))
        return np.add.reduceat(np.where(blank, np.uint32(0), mixed * (2 * place + np.uint32(1))), starts, dtype=np.uint32)

    if len(begin):
        words, wo = hashes(begin), owner[begin]
        add(wo, SHAPES + _term(words, 3))
        for lag in (1, 2, 3):
            same = (words[lag:] == words[:-lag]) & (wo[lag:] == wo[:-lag])
            add(wo[lag:][same], np.full(int(same.sum()), lag))
        line = np.flatnonzero(np.append(True, (s == 5)[:-1]))
        lines, lo = hashes(line), owner[line]
        _, once = np.unique(lo.astype(np.uint64) << np.uint64(32) | lines.astype(np.uint64), return_index=True)
        again = np.ones(len(line), bool)
        again[once] = False
        again &= lines != 0
        add(lo[again], np.full(int(again.sum()), 4), np.diff(np.append(line, len(codes)))[again])
    out[low : low + n] += total.reshape(n, TERMS)


@dataclass
class Model:
    weight: np.ndarray  # by term
    axes: np.ndarray  # [term, dimension]
    vectors: np.ndarray  # labelled documents, of length 1
    labels: np.ndarray
    votes: np.ndarray  # of each labelled document, by its class


def _frequencies(counts: np.ndarray) -> np.ndarray:
    parts = [np.sqrt(c / np.maximum(c.sum(axis=1, keepdims=True), 1)) for c in (counts[:, :SHAPES], counts[:, SHAPES:])]
    return np.concatenate((parts[0], np.float32(WORDS_COUNT) * parts[1]), axis=1)


def _steps(x: np.ndarray, steps: int = _STEPS) -> np.ndarray:
    return np.rint(x.astype(np.float64) * steps) / steps


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1, in steps. Squares of steps add up without rounding, in any order."""
    x = _steps(x)
    return _steps(x / np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-12), 16 * _STEPS)


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", text: str = "text", doc_id: str = "doc_id", per_class: int = 1500, dimensions: int = 48) -> Model | None:
    """Learn from about per_class labelled documents of each class, chosen by their id's hash; that many are broadcast, too."""
    spark = docs.sparkSession
    shared_dir(spark)
    bounded_batches(spark)
    known = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg((F.avg(label) >= 0.5).cast("int").alias("label"))
    sizes = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    if not sizes:
        return None
    share = F.create_map(*[F.lit(v) for k, n in sizes.items() for v in (k, min(1.0, per_class / n))])
    chosen = known.where(hashed_share("doc_id", 2) < share[F.col("label")]).select(F.col("doc_id").alias("__id"), "label").limit(4 * per_class)
    sample = docs.select(F.col(doc_id).alias("__id"), F.col(text).alias("text")).where("text <> ''").join(F.broadcast(chosen), "__id").select("__id", "label", "text")

    def count(batches):
        for batch in batches:
            counts = term_counts(batch.column("text").to_pylist())
            yield {"id": batch.column("__id"), "label": batch.column("label"), "at": [np.flatnonzero(c).astype(np.int32) for c in counts], "n": [c[np.flatnonzero(c)] for c in counts]}

    rows = arrow_map(sample, count, "id long, label int, at array<int>, n array<float>").limit(8 * per_class).collect()
    if not rows:
        return None
    rows.sort(key=lambda r: (r["id"], len(r["at"])))
    counts = np.zeros((len(rows), TERMS), dtype=np.float32)
    for i, r in enumerate(rows):
        counts[i, r["at"]] = r["n"]
    y = np.array([r["label"] for r in rows])
    weight = np.log((1 + len(rows)) / (1 + (counts > 0).sum(axis=0))).astype(np.float32) + 1
    x = _frequencies(counts) * weight
    k = min(dimensions, *x.shape)
    probe = np.random.default_rng(0).standard_normal((TERMS, k + 8)).astype(np.float32)
    for _ in range(4):  # subspace iteration towards the leading right singular vectors
        probe, _ = np.linalg.qr(x.T @ (x @ probe))
    _, _, right = np.linalg.svd(x @ probe, full_matrices=False)
    axes = _steps(probe @ right[:k].T)
    votes = np.array([sizes[c] / (y == c).sum() for c in y.tolist()], dtype=np.float32)
    vectors = np.concatenate([_unit(_steps(x[i : i + 256]) @ axes) for i in range(0, len(x), 256)])  # wider numbers for few rows at once
    return Model(weight, axes, vectors, y, votes)


def vote(model: Model, texts: list[str], neighbours: int = 15, block: int = 64) -> np.ndarray:
    """The similarity-weighted share of label 1 among each text's nearest labelled documents.

    Factors are whole numbers of steps small enough for their products' sums to be
    exact in double precision, so that a text's cosines don't depend on its place
    in a block, however the library or machine orders the sums.
    """
    out = []
    for i in range(0, len(texts), block):
        some = texts[i : i + block]
        v = _unit(_steps(_frequencies(term_counts(some)) * model.weight) @ model.axes)
        near = np.round(v @ model.vectors.T, 6)
        k = min(neighbours, near.shape[1])
        least = -np.partition(-near, k - 1, axis=1)[:, k - 1 : k]
        above, level = near > least, near == least
        chosen = above | (level & (np.cumsum(level, axis=1) <= k - above.sum(axis=1, keepdims=True)))
        squared = np.square(np.square(np.maximum(near, 0.01)))
        sim = np.where(chosen, squared * squared * model.votes, 0)
        out.append((sim * model.labels).sum(axis=1) / sim.sum(axis=1))
    return np.concatenate(out) if out else np.zeros(0)


def score(docs: DataFrame, model: Model | None, text: str = "text", keep: list[str] | None = None, threshold: float = 0.7) -> DataFrame:
    """The columns keep of docs (all by default; those named like a result are replaced), score and predicted (1 from threshold on)."""
    spark = docs.sparkSession
    bounded_batches(spark)
    keep = [c for c in (docs.columns if keep is None else keep) if c.lower() not in ("score", "predicted")]
    held, kinds = spark.sparkContext.broadcast(model), dict(docs.dtypes)

    def work(batches):
        for batch in batches:
            texts = [t or "" for t in batch.column("__text").to_pylist()]
            got = np.full(len(texts), 0.5) if held.value is None else np.clip(vote(held.value, texts).astype(float), 0, 1)
            got = np.where([bool(t) for t in texts], got, 0.0)
            yield {k: batch.column(k) for k in keep} | {"score": got, "predicted": (got >= threshold).astype(np.int32)}

    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keep) + ", score double, predicted int"
    return arrow_map(docs.select(*keep, F.col(text).alias("__text")), work, schema)
