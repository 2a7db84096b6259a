"""Approximate nearest neighbours by a hierarchical k-means tree.

The tree is fitted on a bounded sample and broadcast; every row is put into one
leaf. A search goes best bin first: a priority queue holds the nodes seen so
far by the distance of their centre, and leaves are visited in the order in
which they come out. How many are visited is widened until the recall, which is
measured against brute force over all rows for a bounded number of queries,
reaches its goal. Queries meet the rows of a leaf in a shuffle; leaves with
many rows or many queries are cut on that side, by a small table of the leaves.
Of equal vectors only the k + 1 smallest ids can be in a result, so only
those are searched.

Defined cases: vectors that are null, zero, not of the most frequent length (the
smaller one on ties), or that hold a null or non-finite component take no part;
ties go to the smaller id; a query with fewer than k others gets all of them;
rows that repeat an id with its vector count once; an id with several vectors has
a row for each, and a query never finds its own id, so that several vectors of
it may leave it fewer than k; an empty table gives no rows; other columns are
not read.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliant.llm.common import arrow_map, bounded_batches, hashed_share, shared_dir, stage

LEAF_ROWS = 256
MAX_LEAVES = 65_536
SAMPLE_PER_LEAF = 64
MAX_SAMPLE = 100_000  # twice that many rows at most come to the driver
FIRST_LEAVES = 8


@dataclass
class Tree:
    """children[i]: numbers of a node's children, or -1 - leaf; centres by node."""

    centres: np.ndarray
    children: list[list[int]] = field(default_factory=list)
    leaf_of: list[int] = field(default_factory=list)
    leaves: int = 0

    @classmethod
    def fit(cls, x: np.ndarray, leaf_rows: int, branching: int = 12, steps: int = 8) -> Tree:
        rng, centres, tree = np.random.default_rng(0), [], cls(np.zeros((0, x.shape[1])))

        def add(rows: np.ndarray) -> int:
            me = len(centres)
            centres.append(x[rows].mean(axis=0) if len(rows) else np.zeros(x.shape[1]))
            tree.children.append([])
            tree.leaf_of.append(-1)
            parts = cls._split(x, rows, branching, steps, rng) if len(rows) > leaf_rows else []
            if len(parts) < 2:
                tree.leaf_of[me], tree.leaves = tree.leaves, tree.leaves + 1
            else:
                tree.children[me] = [add(p) for p in parts]
            return me

        add(np.arange(len(x)))
        tree.centres = np.array(centres)
        return tree

    @staticmethod
    def _split(x: np.ndarray, rows: np.ndarray, branching: int, steps: int, rng) -> list[np.ndarray]:
        own = x[rows]
        c = own[rng.choice(len(own), min(branching, len(own)), replace=False)]
        for _ in range(steps):
            near = (((c**2).sum(axis=1) - 2 * own @ c.T)).argmin(axis=1)
            c = np.array([own[near == k].mean(axis=0) for k in np.unique(near)])
        near = (((c**2).sum(axis=1) - 2 * own @ c.T)).argmin(axis=1)
        return [rows[near == k] for k in np.unique(near)]

    def assign(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row, going down to the nearest child."""
        node = np.zeros(len(x), dtype=np.int64)
        while True:
            open_ = [n for n in np.unique(node).tolist() if self.children[n]]
            if not open_:
                return np.array([self.leaf_of[n] for n in node.tolist()], dtype=np.int64)
            for n in open_:
                mine, kids = np.flatnonzero(node == n), np.array(self.children[n])
                c = self.centres[kids]
                node[mine] = kids[((c**2).sum(axis=1) - 2 * x[mine] @ c.T).argmin(axis=1)]

    def best_first(self, q: np.ndarray, most: int) -> list[int]:
        """The first leaves in best-bin-first order."""
        queue, out = [(0.0, 0)], []
        while queue and len(out) < most:
            _, n = heapq.heappop(queue)
            if self.children[n]:
                d = ((self.centres[self.children[n]] - q) ** 2).sum(axis=1)
                for item in zip(d.tolist(), self.children[n]):
                    heapq.heappush(queue, item)
            else:
                out.append(self.leaf_of[n])
        return out


def _matrix(column) -> np.ndarray:
    """Rows of vectors, which are held as the bytes of their numbers."""
    held = column.to_pylist() if hasattr(column, "to_pylist") else list(column)
    return np.frombuffer(b"".join(held), dtype=np.float64).reshape(len(held), -1) if held else np.zeros((0, 1))


def _as_bytes(rows: DataFrame) -> DataFrame:
    """(vec_id, v, key) with v as bytes."""

    def work(batches):
        for batch in batches:
            v = batch.column("v")
            x = v.flatten().to_numpy().reshape(len(v), -1) if len(v) else []
            yield {"vec_id": batch.column("vec_id"), "v": [row.tobytes() for row in x], "key": batch.column("key")}

    return arrow_map(rows.select("vec_id", "v", "key"), work, "vec_id long, v binary, key string")


def _nearest(queries: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int, within: np.ndarray | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each query the k nearest (rows, distances), ties by id, none farther than within.

    Products of matrices tell which rows can be among them, with a margin far
    above their rounding; the distances of these are taken from exact differences.
    """
    out, step, length = [], max(1, 4_000_000 // max(1, len(x))), (x**2).sum(axis=1)
    margin = 1e-9 * (length.max(initial=0) + (queries**2).sum(axis=1).max(initial=0))
    for i in range(0, len(queries), step):
        some = queries[i : i + step]
        square = (some**2).sum(axis=1)[:, None] + length - 2 * (some @ x.T)
        for n, row in enumerate(square, i):
            most = np.inf if within is None else within[n]
            least = min(most**2, np.partition(row, k - 1)[k - 1]) if len(row) > k else most**2
            near = np.flatnonzero(row <= least + 2 * margin)
            d = np.sqrt(((x[near] - queries[n]) ** 2).sum(axis=1))
            near, d = near[d <= most], d[d <= most]
            first = np.lexsort((ids[near], d))[:k]
            out.append((near[first], d[first]))
    return out


def usable(vectors: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """(vec_id, v, key) of the rows that take part."""
    v = F.col("v")
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v")).where(v.isNotNull() & (F.size(v) > 0))
    fine = F.forall(v, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf")))) & F.exists(v, lambda e: e != 0)
    rows = rows.where(F.coalesce(fine, F.lit(False)) & F.col("vec_id").isNotNull())
    common = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    rows = rows.where(F.size("v") == (common[0]["n"] if common else 0))
    return rows.withColumn("key", F.sha2(v.cast("string"), 256))


def search(vectors: DataFrame, is_query, k: int = 10, vec_id: str = "vec_id", vector: str = "embedding", goal: float = 0.94, calibration: int = 64, leaf_cut: int = 4000, ask_cut: int = 4000) -> DataFrame:
    """query_id, rank, vec_id, score for the rows for which is_query (a column over vec_id) holds."""
    spark = vectors.sparkSession
    shared_dir(spark)
    bounded_batches(spark)
    all_rows = stage(_as_bytes(usable(vectors, vec_id, vector)), "vectors")
    first = Window.partitionBy("key").orderBy("vec_id")
    rows = all_rows.dropDuplicates(["key", "vec_id"]).withColumn("__n", F.row_number().over(first)).where(F.col("__n") <= k + 1).drop("__n")
    rows = stage(rows, "distinct-vectors")
    n = rows.count()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if not n:
        return empty
    leaves = min(MAX_LEAVES, max(1, n // LEAF_ROWS))
    wanted = min(MAX_SAMPLE, leaves * SAMPLE_PER_LEAF)
    sample = rows.where(hashed_share("vec_id", 3) < min(1.0, wanted / n)).select("vec_id", "v").limit(2 * wanted).toArrow().sort_by("vec_id")
    tree = Tree.fit(_matrix(sample.column("v")), max(1, len(sample) // leaves)) if len(sample) else Tree(np.zeros((1, 1)), [[]], [0], 1)
    held = spark.sparkContext.broadcast(tree)

    def put(batches):
        for batch in batches:
            if batch.num_rows:
                yield {"vec_id": batch.column("vec_id"), "v": batch.column("v"), "leaf": held.value.assign(_matrix(batch.column("v")))}

    placed = stage(arrow_map(rows.select("vec_id", "v"), put, "vec_id long, v binary, leaf long"), "leaves")
    queries = all_rows.where(is_query(F.col("vec_id")))
    distinct = queries.groupBy("key").agg(F.first("v").alias("v"))
    visits = _calibrate(placed, distinct, tree, k, goal, calibration)
    sizes = stage(placed.groupBy("leaf").agg(F.ceil(F.count("*") / leaf_cut).alias("cuts")), "leaf-cuts")  # a row a leaf: MAX_LEAVES at most, and a few more

    def visit(asking: DataFrame, lo: int, hi: int) -> DataFrame:
        """The nearest rows in the leaves that come lo to hi in each query's order. asking: key, v, within."""

        def order(batches):
            for batch in batches:
                out = {"leaf": [], "key": [], "v": [], "within": []}
                for key, v, within in zip(*(batch.column(c).to_pylist() for c in ("key", "v", "within"))):
                    for leaf in held.value.best_first(np.frombuffer(v), hi)[lo:]:
                        for name, value in zip(out, (leaf, key, v, within)):
                            out[name].append(value)
                yield out

        def each(n):
            return F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))

        asked = stage(arrow_map(asking, order, "leaf long, key string, v binary, within double"), "asked")
        both = F.broadcast(asked.groupBy("leaf").agg(F.ceil(F.count("*") / ask_cut).alias("ask_cuts")).join(F.broadcast(sizes), "leaf"))
        asks = asked.join(both, "leaf").select("leaf", F.pmod(F.xxhash64("key"), "ask_cuts").alias("ask_cut"), each("cuts").alias("cut"), "key", F.lit(None).cast("long").alias("vec_id"), "v", "within")
        there = placed.join(both, "leaf").select("leaf", each("ask_cuts").alias("ask_cut"), F.pmod(F.xxhash64("vec_id"), "cuts").alias("cut"), F.lit(None).cast("string").alias("key"), "vec_id", "v", F.lit(None).cast("double").alias("within"))
        return asks.unionByName(there).groupBy("leaf", "ask_cut", "cut").applyInPandas(compare, "key string, vec_id long, score double")

    def compare(group):
        import pandas as pd

        asks, has = group[group["key"].notna()], group[group["key"].isna()]
        if not len(asks) or not len(has):
            return pd.DataFrame({"key": pd.Series(dtype=str), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype=float)})
        ids = has["vec_id"].to_numpy(dtype=np.int64)
        found = _nearest(_matrix(asks["v"]), ids, _matrix(has["v"]), k + 1, asks["within"].to_numpy(dtype=float))
        return pd.DataFrame({"key": np.repeat(asks["key"].to_numpy(), [len(f[0]) for f in found]), "vec_id": ids[np.concatenate([f[0] for f in found])], "score": np.concatenate([f[1] for f in found])})

    def top(found: DataFrame) -> DataFrame:
        return found.withColumn("__n", F.row_number().over(Window.partitionBy("key").orderBy("score", "vec_id"))).where(F.col("__n") <= k + 1).drop("__n")

    best = visit(distinct.withColumn("within", F.lit(float("inf"))), 0, min(visits, FIRST_LEAVES))
    if visits > FIRST_LEAVES:  # what the first leaves gave bounds what is worth sending from the others
        near = stage(top(best), "first-leaves")
        bound = near.groupBy("key").agg(F.when(F.count("*") > k, F.max("score")).otherwise(float("inf")).alias("within"))
        best = near.unionByName(visit(distinct.join(bound, "key"), FIRST_LEAVES, visits))
    best = top(best)
    pairs = queries.select(F.col("vec_id").alias("query_id"), "key").distinct().join(best, "key").where("vec_id <> query_id")
    ranked = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _calibrate(placed: DataFrame, queries: DataFrame, tree: Tree, k: int, goal: float, calibration: int) -> int:
    """The fewest leaf visits with which `calibration` queries at most find the goal's share of their exact neighbours among all rows."""
    some = [bytes(r["v"]) for r in queries.orderBy(F.xxhash64("key"), "key").limit(calibration).collect()]
    if not some:
        return 1
    asked = _matrix(some)

    def exact(batches):
        held = [[] for _ in asked]
        for batch in batches:
            if batch.num_rows:
                ids, leaf = batch.column("vec_id").to_numpy(), batch.column("leaf").to_numpy()
                for q, (near, d) in zip(held, _nearest(asked, ids, _matrix(batch.column("v")), k + 1)):
                    q += zip(d.tolist(), ids[near].tolist(), leaf[near].tolist())
        for i, q in enumerate(held):
            if q := sorted(q)[: k + 1]:
                yield {"q": [i] * len(q), "score": [x[0] for x in q], "vec_id": [x[1] for x in q], "leaf": [x[2] for x in q]}

    rows = arrow_map(placed, exact, "q int, score double, vec_id long, leaf long")
    top = rows.withColumn("__n", F.row_number().over(Window.partitionBy("q").orderBy("score", "vec_id"))).where(F.col("__n").between(2, k + 1)).select("q", "leaf").collect()  # the first is the query itself
    places = [{leaf: i + 1 for i, leaf in enumerate(tree.best_first(q, tree.leaves))} for q in asked]
    if not top:
        return 1
    needed = sorted(places[r["q"]][r["leaf"]] for r in top)
    return needed[min(len(needed) - 1, int(np.ceil(goal * len(needed))) - 1)]
