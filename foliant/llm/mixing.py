"""Mixing sources to target weights by the cube method.

Each source has a ratio of target to size. Its whole part is taken of every
document; its fraction is each document's probability of one copy more. The
flight phase moves these probabilities along the null space of two constraints,
the source's words and its number of documents, until all but two documents of
a block are decided, and both totals are as they were. The undecided ones of
all blocks form new blocks, level after level. Of a source's last block a few documents and at most two undecided ones
are left for the landing, which picks the rounding nearest to the words owed.

Blocks hold about BLOCK documents whatever a source's share, and are made by a
hash of doc_id and sorted by it, so results depend neither on the order nor on
the partitions of the rows.

Defined cases: a null text has size 0; a null source is a source of its own,
last in order; a source without words has target 0 and takes 0; repeated rows
are units of their own; an empty table gives an empty result; other columns are
not read.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliant.llm.common import WORD, bounded_batches, shared_dir, stage

BLOCK = 2000
#: Documents of a source that its last flight leaves out, for the landing to choose from.
RESERVE = 12
MAX_REPEAT = 3


def word_count(text: str):
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def targets(sizes: dict[str | None, int], weights: tuple[int, ...] = (1, 2, 3), repeat: int = MAX_REPEAT) -> dict[str | None, Fraction]:
    """Words to take of each source: shares of all words by weight, at most repeat times the source's; the excess is shared anew by weight."""
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    out, free, left = {}, set(order), Fraction(sum(sizes.values()))
    while free:
        unit = left / sum(weight[s] for s in free)
        over = {s for s in free if weight[s] * unit > repeat * sizes[s]}
        for s in over or free:
            out[s] = Fraction(repeat * sizes[s]) if over else weight[s] * unit
        left -= sum(out[s] for s in over)
        free -= over or free
    return out


def flight(size: np.ndarray, prob: np.ndarray, seed: int) -> np.ndarray:
    """Probabilities of which at most two are neither 0 nor 1, with the same sum, and the same sum of size times probability."""
    rng, p, sizes = np.random.default_rng(seed), prob.tolist(), size.tolist()
    draws, pool = iter(rng.random(2 * len(p) + 8).tolist()), []
    for new in range(len(p)):
        if not 0 < p[new] < 1:
            continue
        pool.append(new)
        while len(pool) == 3:
            a, b, c = pool
            u = [sizes[b] - sizes[c], sizes[c] - sizes[a], sizes[a] - sizes[b]]
            if not any(u):
                u = [1, -1, 0]
            up = min((((1 - p[k]) / x if x > 0 else p[k] / -x), k) for k, x in zip(pool, u) if x)
            down = min(((p[k] / x if x > 0 else (1 - p[k]) / -x), k) for k, x in zip(pool, u) if x)
            forth = next(draws) * (up[0] + down[0]) < down[0]
            step, first = (up[0], up[1]) if forth else (-down[0], down[1])
            for k, x in zip(pool, u):
                p[k] = min(1.0, max(0.0, p[k] + step * x))
            x = u[pool.index(first)]
            p[first] = 1.0 if (x > 0) == forth else 0.0
            for k in pool:
                if p[k] < 1e-12 or p[k] > 1 - 1e-12:
                    p[k] = float(round(p[k]))
            pool = [k for k in pool if 0 < p[k] < 1]
    return np.array(p)


def landing(size: np.ndarray, prob: np.ndarray) -> np.ndarray:
    """Round the few undecided ones so that their words come nearest to what is owed; a document too many or few counts as one word."""
    p = prob.copy()
    open_ = np.flatnonzero((p > 0) & (p < 1))
    choices = np.arange(1 << len(open_))[:, None] >> np.arange(len(open_)) & 1
    words = np.abs(choices @ size[open_] - (size[open_] * p[open_]).sum())
    p[open_] = choices[np.argmin(words + np.abs(choices.sum(axis=1) - p[open_].sum()))]
    return p


def _level(rows: DataFrame, level: int) -> DataFrame:
    """One flight in every block; where a source has one block only, the landing too. rows: doc_id, source_no, n, size, p, order."""
    blocks = F.greatest(F.lit(1).cast("long"), F.ceil(F.col("n") / BLOCK))
    kind = dict(rows.dtypes)["doc_id"]

    def work(group):
        group = group.sort_values(["order", "doc_id", "size", "p"], kind="stable")
        size, seed = group["size"].to_numpy(), int(group["source_no"].iloc[0]) * 1009 + int(group["block"].iloc[0]) * 31 + level
        p = group["p"].to_numpy(dtype=float).copy()
        last = group["blocks"].iloc[0] == 1
        flying = max(0, len(p) - RESERVE * last)
        p[:flying] = flight(size[:flying], p[:flying], seed)
        if last:
            p = landing(size, p)
        return group.assign(p=p).drop(columns=["block", "blocks"])

    dealt = rows.withColumn("blocks", blocks).withColumn("block", F.pmod(F.shiftright("order", level * 7), F.col("blocks")))
    return dealt.groupBy("source_no", "block").applyInPandas(work, f"doc_id {kind}, source_no long, n long, size long, p double, order long")


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), repeat: int = MAX_REPEAT, text: str = "text", doc_id: str = "doc_id", source: str = "source", max_sources: int = 1_000_000) -> DataFrame:
    """One row a document: doc_id, source, size, source_size, target, copies, taken.

    max_sources bounds what the driver holds and broadcasts, one row a source;
    more raise an error.
    """
    spark = docs.sparkSession
    shared_dir(spark)
    bounded_batches(spark)
    units = stage(docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), word_count(text).alias("size")), "mix-sizes")
    per = units.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("n")).limit(max_sources + 1).collect()
    if len(per) > max_sources:
        raise ValueError(f"more than {max_sources} sources")
    goal = targets({r["source"]: r["size"] for r in per}, weights, repeat)
    plan = []
    for no, r in enumerate(sorted(per, key=lambda r: (r["source"] is None, r["source"] or ""))):
        ratio = goal[r["source"]] / r["size"] if r["size"] else Fraction(0)
        whole, part = int(ratio), float(ratio - int(ratio))
        if part > 1 - 1e-12:
            whole, part = whole + 1, 0.0
        plan.append((no, r["source"], r["size"], float(goal[r["source"]]), whole, part if part >= 1e-12 else 0.0, r["n"]))
    table = spark.createDataFrame(plan, "source_no long, src string, source_size long, target double, whole int, part double, n long")
    placed = units.join(F.broadcast(table), F.col("source").eqNullSafe(F.col("src")))
    sure = placed.where("part = 0").select("doc_id", "source_no", "size", F.lit(0.0).alias("p"))
    rows = placed.where("part > 0").select("doc_id", "source_no", "n", "size", F.col("part").alias("p"), F.xxhash64(F.col("doc_id"), F.lit(7)).alias("order"))
    decided, level, most = [sure], 0, max([0, *(x[6] for x in plan if x[5] > 0)])
    while most:
        done = stage(_level(rows, level), f"mix-level-{level}")
        decided.append(done.where("p = 0 or p = 1").select("doc_id", "source_no", "size", "p"))
        blocks = -(-most // BLOCK)
        most = 2 * blocks if blocks > 1 else 0
        rows = done.where("p > 0 and p < 1").withColumn("n", (2 * F.ceil(F.col("n") / BLOCK)).cast("long"))
        level += 1
    all_rows = decided[0]
    for d in decided[1:]:
        all_rows = all_rows.unionByName(d)
    copies = (F.col("whole") + F.col("p").cast("int")).alias("copies")
    out = all_rows.join(F.broadcast(table), "source_no").select("doc_id", F.col("src").alias("source"), "size", "source_size", "target", copies)
    return out.withColumn("taken", F.col("size") * F.col("copies"))


def apply_mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), text: str = "text", doc_id: str = "doc_id", source: str = "source") -> DataFrame:
    """The rows of the mix, all columns kept: each row as many times as it is taken.

    Rows are found by id and source. Where several share these, they are told
    by their size, and those of one size get the copies of that size one by one.
    """
    keys, names = ["__id", "__source"], [F.col(doc_id), F.col(source)]
    mixed = stage(mix(docs, weights, text=text, doc_id=doc_id, source=source).select(F.col("doc_id").alias("__id"), F.col("source").alias("__source"), F.col("size").alias("__size"), F.col("copies").alias("__copies")), "mix-copies")
    groups = mixed.groupBy(*keys).agg(F.count("*").alias("__n"), F.max("__copies").alias("__copies"))
    same = names[0].eqNullSafe(F.col("__id")) & names[1].eqNullSafe(F.col("__source"))
    copy = F.explode(F.sequence(F.lit(1), F.col("__copies"))).alias("__copy")
    single = groups.where("__n = 1 and __copies > 0").hint("merge")  # it grows with docs, so it is never broadcast
    out = docs.join(single, same).select(*docs.columns, copy)
    several = groups.where("__n > 1").select(*keys)
    if several.limit(1).count():
        at = Window.partitionBy(*keys, "__size")
        dealt = mixed.join(several.withColumnsRenamed({"__id": "__i", "__source": "__s"}), F.col("__id").eqNullSafe(F.col("__i")) & F.col("__source").eqNullSafe(F.col("__s"))).select(*keys, "__size", "__copies", F.row_number().over(at.orderBy(F.desc("__copies"))).alias("__place"))
        rows = docs.join(several, same).withColumn("__size", word_count(text)).withColumn("__place", F.row_number().over(at.orderBy(F.xxhash64(text), text)))
        rows = rows.withColumnsRenamed({"__size": "__words", "__place": "__row"}).drop(*keys)
        more = rows.join(dealt.where("__copies > 0"), same & (F.col("__words") == F.col("__size")) & (F.col("__row") == F.col("__place")))
        out = out.unionByName(more.select(*docs.columns, copy))
    return out.drop("__copy")
