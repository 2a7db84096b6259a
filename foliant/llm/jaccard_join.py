"""Documents linked by the Jaccard similarity of their shingle sets, by count-vector R-trees.

Shingles are hashed into groups; how many of a set fall into each group is a
point, and the summed minima of two points' coordinates bound their overlap. An
R-tree over such points is searched for what may reach the similarity, and the
pairs that survive are verified on the sets themselves.

Which documents meet in a tree is decided without loss: two sets of the wanted
similarity share one of the first shingles of each in any order that is the
same for all; here rare shingles come first, by counts in a table of fixed
size. A shingle's documents are compared with a few of them, the leaders, first.
Only where that leaves several components in a shingle's list are the pairs
between these components compared, too. So thousands of near copies cost as
many comparisons as there are copies, and no link between components is lost:
members outside a list's most common component ask all its others, both sides
in cuts, and a pair is given out in the first list that both are known to share.

Where the links themselves are wanted, all pairs within each component are
searched by trees and verified: a link cannot leave its component, so none is
lost. This costs the square of a component's size.

Equal sets are one class; sets and classes are known by 64-bit fingerprints.

Defined cases: a null text or one without words has an empty set and is alone
in its component; repeated rows share one; a component without any non-null
doc_id has a null component_id; an empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

import hashlib
import zlib
from fractions import Fraction

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import arrow_map, bounded_batches, group_bounds, join_groups, shared_dir, stage
from foliant.llm.components import components
from foliant.llm.shingles import mixed, shingle_set

LEADERS = 8  # of a list, with whom all others in it are compared at once
GROUPS = 256  # of shingles: the coordinates of a small set's point
DEEPEST = 7  # doublings of the groups for large sets
KNOWN = 16  # lists of a class, by which a pair that several lists hold is told
PART = 1000  # classes of a list in a row
SLOTS = 24  # of the table of counts, as a power of two
CHUNK = 20  # of a part of the table, as a power of two
BLOOM = 27  # bits of the filter of wanted documents, as a power of two


class CountVectorRTree:
    """Points of group counts, packed bottom up in order of their largest coordinate and their sum."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray, fan: int = 16):
        self.order = np.lexsort((sizes, points.argmax(axis=1))) if len(points) else np.zeros(0, int)
        self.points, self.sizes, self.fan = points[self.order], sizes[self.order], fan
        self.levels = [(self.points, self.sizes, self.sizes)]  # upper corner, least and greatest set size
        while len(self.levels[-1][0]) > 1:
            corner, low, high = self.levels[-1]
            cut = np.arange(0, len(corner), fan)
            self.levels.append((np.maximum.reduceat(corner, cut), np.minimum.reduceat(low, cut), np.maximum.reduceat(high, cut)))

    def search(self, point: np.ndarray, size: int, share: Fraction) -> np.ndarray:
        """Rows whose bound on the overlap allows a Jaccard similarity of share: overlap * (1 + share) >= share * (both sizes)."""
        p, q = share.numerator, share.denominator
        if not len(self.points):
            return np.zeros(0, dtype=np.int64)
        rows = np.arange(len(self.levels[-1][0]))
        for depth in range(len(self.levels) - 1, -1, -1):
            corner, low, high = self.levels[depth]
            rows = rows[(high[rows] * q >= p * size) & (low[rows] * p <= q * size)]
            bound = np.minimum(corner[rows], point).sum(axis=1, dtype=np.int64)
            rows = rows[bound * (p + q) >= p * (low[rows] + size)]
            if depth:
                below = len(self.levels[depth - 1][0])
                rows = (rows[:, None] * self.fan + np.arange(self.fan)).ravel()
                rows = rows[rows < below]
        return self.order[rows]


def groups_of(n: int) -> int:
    """Groups for a set of n shingles: about two shingles a group at most, so that unrelated large sets are told apart, too."""
    k = 0
    while k < DEEPEST and n > 2 * GROUPS << k:
        k += 1
    return GROUPS << k


def point_of(shingles: np.ndarray) -> tuple[bytes, int]:
    """Group counts in one byte each, and the unit in which they are given; counts are rounded up, so that bounds stay bounds."""
    groups = groups_of(len(shingles))
    counts = np.bincount((shingles & np.uint64(groups - 1)).astype(np.int64), minlength=groups)
    unit = max(1, -(-int(counts.max()) // 255))
    return (-(-counts // unit)).astype(np.uint8).tobytes(), unit


def folded(points: np.ndarray, groups: int) -> np.ndarray:
    """The same sets' points with fewer groups: a group of them unites those that agree in their lower bits."""
    return points.reshape(*points.shape[:-1], -1, groups).sum(axis=-2, dtype=points.dtype)


class CountVectorForest:
    """An R-tree for each number of groups among the points; a search compares by the smaller number of the two sides."""

    def __init__(self, bodies: list[bytes], units: list[int], sizes: np.ndarray):
        self.points = [np.frombuffer(b, np.uint8).astype(np.int32) * u for b, u in zip(bodies, units)]
        self.sizes, by = sizes, {}
        for i, p in enumerate(self.points):
            by.setdefault(len(p), []).append(i)
        self.rows = {g: np.array(rows) for g, rows in sorted(by.items())}
        self.trees: dict[tuple[int, int], CountVectorRTree] = {}

    def _tree(self, groups: int, as_groups: int) -> CountVectorRTree:
        if (groups, as_groups) not in self.trees:
            rows = self.rows[groups]
            at = np.stack([self.points[i] for i in rows.tolist()])
            self.trees[groups, as_groups] = CountVectorRTree(folded(at, as_groups), self.sizes[rows])
        return self.trees[groups, as_groups]

    def search(self, point: np.ndarray, size: int, share: Fraction) -> np.ndarray:
        out = [np.zeros(0, dtype=np.int64)]
        for groups, rows in self.rows.items():
            low, high = int(self.sizes[rows].min()), int(self.sizes[rows].max())
            if high * share.denominator >= share.numerator * size and low * share.numerator <= share.denominator * size:
                least = min(groups, len(point))
                out.append(rows[self._tree(groups, least).search(folded(point, least), size, share)])
        return np.concatenate(out)


class Overlaps:
    """How many shingles a set has in common with each of the sets, by lists of the sets that hold a shingle."""

    def __init__(self, sets: list[np.ndarray]):
        flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        order = np.argsort(flat, kind="stable")
        flat, self.owner = flat[order], owner[order]
        self.bounds, self.n = group_bounds(flat), len(sets)
        self.values = flat[self.bounds[:-1]]

    def of(self, a: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.values, a), len(self.values) - 1)
        at = at[self.values[at] == a]
        size = self.bounds[at + 1] - self.bounds[at]
        rows = np.arange(size.sum()) + np.repeat(self.bounds[at] - (np.cumsum(size) - size), size)
        return np.bincount(self.owner[rows], minlength=self.n)


def linked(a: np.ndarray, b: np.ndarray, share: Fraction) -> bool:
    """Whether the Jaccard similarity of two sorted sets is at least share."""
    if not len(a) or not len(b):
        return False
    both = int(np.count_nonzero(a[np.minimum(np.searchsorted(a, b), len(a) - 1)] == b))
    return both * share.denominator >= share.numerator * (len(a) + len(b) - both)


def _sets(docs: DataFrame, width: int):
    """A function from a batch to the sets of its texts."""
    return lambda batch: [shingle_set(t or "", width) for t in batch.column("text").to_pylist()]


class Table:
    """A table of bytes in compressed parts, which is what the driver holds and sends; a worker unpacks it once a task."""

    def __init__(self, size: int, rows: list):
        self.size, self.parts = size, {r[0]: bytes(r[1]) for r in rows}  # by the first byte's place

    def whole(self) -> np.ndarray:
        out = np.zeros(self.size, dtype=np.uint8)
        for at, part in self.parts.items():
            body = np.frombuffer(zlib.decompress(part), np.uint8)
            out[at : at + len(body)] = body
        return out


def _frequency_levels(docs: DataFrame, width: int) -> Table:
    """The logarithm of the number of documents by a shingle's slot, as one byte each. Shingles share slots: any values give a correct order, and better ones fewer comparisons."""
    sets = _sets(docs, width)

    def count(batches):
        total = np.zeros(1 << SLOTS, dtype=np.uint32)
        for batch in batches:
            for s in sets(batch):
                total[(s >> np.uint64(64 - SLOTS)).astype(np.int64)] += 1
        for c in range(0, 1 << SLOTS, 1 << CHUNK):
            part = total[c : c + (1 << CHUNK)]
            if part.any():
                yield {"chunk": [c], "n": [zlib.compress(np.minimum(part, 65_535).astype("<u2").tobytes(), 1)]}

    def add(group):
        total = np.zeros(1 << CHUNK, dtype=np.int64)
        for n in group["n"]:
            total += np.frombuffer(zlib.decompress(n), "<u2")
        level = np.minimum(np.rint(8 * np.log2(1 + total)), 255).astype(np.uint8)
        return group.head(1)[["chunk"]].assign(level=[zlib.compress(level.tobytes(), 1)])

    return Table(1 << SLOTS, arrow_map(docs.select("text"), count, "chunk int, n binary").groupBy("chunk").applyInPandas(add, "chunk int, level binary").collect())


def _long(h: np.ndarray) -> np.ndarray:
    return h.astype(np.uint64).view(np.int64)


def _classes(docs: DataFrame, levels, width: int, share: Fraction) -> DataFrame:
    """doc_id, n, class (a set's fingerprint, null if empty), keys: the shingles of which one must be shared, rarest first, 6 bytes each; point, unit."""
    sets = _sets(docs, width)

    def work(batches):
        level = levels.value.whole()
        for batch in batches:
            out = {"doc_id": batch.column("doc_id"), "n": [], "class": [], "keys": [], "point": [], "unit": []}
            for s in sets(batch):
                out["n"].append(len(s))
                if not len(s):
                    for k in ("class", "keys", "point", "unit"):
                        out[k].append(None)
                    continue
                point, unit = point_of(s)
                out["point"].append(point)
                out["unit"].append(unit)
                out["class"].append(int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True))
                first = len(s) - -(-len(s) * share.numerator // share.denominator) + 1
                rarity = level[(s >> np.uint64(64 - SLOTS)).astype(np.int64)]
                keys = mixed(s[np.argsort(rarity, kind="stable")[:first]])
                out["keys"].append((keys >> np.uint64(48)).astype("<u2").tobytes() + keys.astype("<u4").tobytes())
            yield out

    return arrow_map(docs, work, f"doc_id {dict(docs.dtypes)['doc_id']}, n long, class long, keys binary, point binary, unit int")


def _postings(classes: DataFrame, buckets: int) -> DataFrame:
    """(bucket, body): for each batch and bucket the classes, how many keys each has there, and the keys."""

    def work(batches):
        for batch in batches:
            ids, bodies = batch.column("class").to_numpy(), batch.column("keys").to_pylist()
            count = np.array([len(b) // 6 for b in bodies], dtype=np.int64)
            high = np.concatenate([np.frombuffer(b, "<u2", len(b) // 6) for b in bodies]) if bodies else np.zeros(0, "<u2")
            low = np.concatenate([np.frombuffer(b, "<u4", offset=len(b) // 3) for b in bodies]) if bodies else np.zeros(0, "<u4")
            bucket = high.astype(np.int64) * buckets >> 16
            owner = np.repeat(np.arange(len(ids)), count)
            order = np.argsort(bucket, kind="stable")
            bucket, owner, low = bucket[order], owner[order], low[order]
            cuts = group_bounds(bucket).tolist()
            rows = [(i, j) for i, j in zip(cuts[:-1], cuts[1:])]
            out = {"bucket": [int(bucket[i]) for i, _ in rows], "body": []}
            for i, j in rows:
                mine = owner[i:j]
                at = group_bounds(mine)
                out["body"].append(np.array([len(at) - 1], "<i4").tobytes() + ids[mine[at[:-1]]].astype("<i8").tobytes() + np.diff(at).astype("<i4").tobytes() + low[i:j].astype("<u4").tobytes())
            yield out

    return arrow_map(classes.select("class", "keys"), work, "bucket int, body binary")


def _lists(bodies: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(classes, bounds) of the lists of two classes or more that share a key."""
    who, keys = [], []
    for b in bodies:
        n = int(np.frombuffer(b, "<i4", 1)[0])
        ids, count = np.frombuffer(b, "<i8", n, 4), np.frombuffer(b, "<i4", n, 4 + 8 * n)
        who.append(np.repeat(ids, count))
        keys.append(np.frombuffer(b, "<u4", offset=4 + 12 * n))
    who, keys = np.concatenate(who), np.concatenate(keys)
    order = np.lexsort((who, keys))
    who, keys = who[order], keys[order]
    once = np.append(True, (keys[1:] != keys[:-1]) | (who[1:] != who[:-1]))
    who, keys = who[once], keys[once]
    bounds = group_bounds(keys)
    size = np.diff(bounds)
    many = size > 1
    return who[np.repeat(many, size)], np.concatenate(([0], np.cumsum(size[many])))


def _meetings(postings: DataFrame, buckets: int) -> DataFrame:
    """Rows of two kinds: (a, b, null, null, null), a leader and a class that shares a key with it; (null, null, list, part, body), the classes of a key that more share than have been leaders."""

    def merged(bodies):
        who, bounds = _lists(bodies)
        size = np.diff(bounds)
        place = np.arange(len(who)) - np.repeat(bounds[:-1], size)
        pairs = [np.zeros((0, 2), np.int64)]
        for k in range(LEADERS):
            leader = np.repeat(who[np.minimum(bounds[:-1] + k, bounds[1:] - 1)], size)
            pairs.append(np.stack([leader, who], axis=1)[place > k])
        pairs = np.unique(np.concatenate(pairs), axis=0)
        for i in range(0, len(pairs), 20_000):
            p = pairs[i : i + 20_000]
            yield {"a": p[:, 0], "b": p[:, 1]} | {c: [None] * len(p) for c in ("list", "part", "body")}
        if len(who):
            mark = np.add.reduceat(mixed(who.view(np.uint64)), bounds[:-1])
            _, once = np.unique(mark, return_index=True)
            once = once[size[once] > LEADERS + 1]
            parts = [(x, i, min(i + PART, int(bounds[x + 1]))) for x in once.tolist() for i in range(int(bounds[x]), int(bounds[x + 1]), PART)]
            for i in range(0, len(parts), 200):
                some = parts[i : i + 200]
                at = np.array([x for x, _, _ in some])
                yield {"a": [None] * len(some), "b": [None] * len(some), "list": _long(mark[at]), "part": [(j - int(bounds[x])) // PART for x, j, _ in some], "body": [who[j:k] for _, j, k in some]}

    def work(batches):
        held, now = [], None
        for batch in batches:
            for k, body in zip(batch.column("bucket").to_pylist(), batch.column("body").to_pylist()):
                if k != now and held:
                    yield from merged(held)
                    held = []
                now = k
                held.append(body)
        if held:
            yield from merged(held)

    return arrow_map(postings.repartition(buckets, "bucket").sortWithinPartitions("bucket"), work, "a long, b long, list long, part int, body array<long>")


def _by_leader(pairs: DataFrame, payload: DataFrame, columns: list[str], keep, per_task: int = 500) -> DataFrame:
    """The pairs (a, b) that keep(leader, others) lets through.

    A leader's candidates are cut into parts of about per_task, each with the
    leader's own payload in front; a task reads them as a stream.
    """
    cuts = pairs.groupBy("a").agg(F.ceil(F.count("*") / per_task).alias("cuts"))
    placed = pairs.join(cuts, "a").withColumn("cut", F.pmod(F.xxhash64("b"), "cuts")).select("a", "cut", F.col("b").alias("class"))
    leaders = cuts.select("a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("cuts") - 1)).alias("cut"), F.col("a").alias("class"))
    rows = placed.unionByName(leaders).join(payload, "class").withColumn("leads", F.col("class") == F.col("a"))
    parts = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(parts, "a", "cut").sortWithinPartitions("a", "cut", F.desc("leads")).select("a", "cut", "class", "leads", *columns)

    def work(batches):
        leader, now = None, None
        for batch in batches:
            keys = zip(batch.column("a").to_pylist(), batch.column("cut").to_pylist())
            held, out = [], {"a": [], "b": []}

            def done():
                got = keep(leader, held)
                out["a"] += [now[0]] * len(got)
                out["b"] += got
                held.clear()

            for k, c, first, *own in zip(keys, *(batch.column(c).to_pylist() for c in ("class", "leads", *columns))):
                if k != now and held:
                    done()
                now = k
                if first:
                    leader = own
                else:
                    held.append((c, own))
            if held:
                done()
            yield out

    return arrow_map(rows, work, "a long, b long")


def _reachable(pairs: DataFrame, classes: DataFrame, share: Fraction) -> DataFrame:
    """The pairs that the trees' bounds let through: for each leader a tree over its candidates' points."""

    def keep(leader, held):
        n, body, unit = zip(*(own for _, own in held))
        forest = CountVectorForest(body, unit, np.array(n, dtype=np.int64))
        return [held[i][0] for i in forest.search(np.frombuffer(leader[1], np.uint8).astype(np.int32) * leader[2], leader[0], share).tolist()]

    return stage(_by_leader(pairs, classes.select("class", "n", "point", "unit"), ["n", "point", "unit"], keep), "reachable")


def _whole_sets(wanted: DataFrame, docs: DataFrame, members: DataFrame, width: int) -> DataFrame:
    """(class, set) of the wanted classes at least. Sets are made again from the texts that are wanted, by members: (class, doc_id); a filter of fixed size tells which."""
    spark = docs.sparkSession
    wanted = stage(wanted.join(members, "class").select("doc_id"), "wanted")

    def mark(batches):
        bits = np.zeros(1 << BLOOM - 3, dtype=np.uint8)
        for batch in batches:
            h = mixed(batch.column("h").to_numpy().view(np.uint64))
            for k in (0, 1, 2):
                at = (h >> np.uint64(k * 18) & np.uint64((1 << BLOOM) - 1)).astype(np.int64)
                np.bitwise_or.at(bits, at >> 3, (1 << (at & 7)).astype(np.uint8))
        full = np.flatnonzero(bits)
        for c in range(0, 1 << BLOOM - 3, 1 << 18):
            i, j = np.searchsorted(full, (c, c + (1 << 18)))
            if i < j:
                yield {"chunk": [c], "at": [(full[i:j] - c).astype("<i4").tobytes()], "n": [bits[full[i:j]].tobytes()]}

    def add(group):
        total = np.zeros(1 << 18, dtype=np.uint8)
        for at, n in zip(group["at"], group["n"]):
            total[np.frombuffer(at, "<i4")] |= np.frombuffer(n, np.uint8)
        return group.head(1)[["chunk"]].assign(bits=[zlib.compress(total.tobytes(), 1)])

    hashed = F.xxhash64(F.col("doc_id").cast("string")).alias("h")
    rows = arrow_map(wanted.select(hashed), mark, "chunk int, at binary, n binary").groupBy("chunk").applyInPandas(add, "chunk int, bits binary").collect()
    held = spark.sparkContext.broadcast(Table(1 << BLOOM - 3, rows))  # 16 MB at most

    def again(batches):
        bits = held.value.whole()
        for batch in batches:
            h = mixed(batch.column("h").to_numpy().view(np.uint64))
            there = np.ones(len(h), bool)
            for k in (0, 1, 2):
                at = (h >> np.uint64(k * 18) & np.uint64((1 << BLOOM) - 1)).astype(np.int64)
                there &= (bits[at >> 3] >> (at & 7) & 1).astype(bool)
            texts = batch.column("text")
            found = [shingle_set(texts[i].as_py() or "", width) for i in np.flatnonzero(there).tolist()]
            found = [s for s in found if len(s)]
            yield {"class": [int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True) for s in found], "set": [s.astype("<u8").tobytes() for s in found]}

    return arrow_map(docs.select("text", hashed), again, "class long, set binary").groupBy("class").agg(F.first("set").alias("set"))


def _verified(pairs: DataFrame, docs: DataFrame, members: DataFrame, width: int, share: Fraction) -> DataFrame:
    """The pairs (a, b) that are linked, by their whole sets."""
    sets = _whole_sets(pairs.select(F.col("a").alias("class")).union(pairs.select("b")).distinct(), docs, members, width)

    def keep(leader, held):
        a = np.frombuffer(leader[0], "<u8")
        return [c for c, own in held if linked(a, np.frombuffer(own[0], "<u8"), share)]

    return stage(_by_leader(pairs, sets, ["set"], keep), "links")


def _across(lists: DataFrame, labels: DataFrame, classes: DataFrame, tried: DataFrame, share: Fraction, block: int = 250) -> DataFrame:
    """Pairs of different components that share a list and that a tree's bounds let through, without those compared already.

    Members outside a list's most common component ask; all its members are
    told. A list's asking and told members are cut into blocks, and each block
    of askers meets each of told ones in a tree of these. A pair of askers is
    given by the larger of them, and a pair that several lists hold by the
    first of them, as far as the first KNOWN lists of both tell.
    """
    member = lists.select("list", F.explode("body").alias("node")).join(labels, "node", "left")
    member = stage(member.select("list", "node", F.coalesce("component", "node").alias("component")), "list-members")
    by = member.groupBy("list", "component").agg(F.count("*").alias("k")).groupBy("list")
    open_ = by.agg(F.max_by("component", F.struct("k", "component")).alias("common"), F.sum("k").alias("size"), F.max("k").alias("most")).where("most < size")
    member = join_groups(member, stage(open_, "open-lists"), "list", "size", member.count())
    member = stage(member.select("list", "node", "component", "common", F.ceil(F.col("size") / block).alias("cuts"), F.ceil((F.col("size") - F.col("most")) / block).alias("askers")), "open-members")
    known = member.groupBy("node").agg(F.slice(F.array_sort(F.collect_list("list")), 1, KNOWN).alias("known"))

    def each(n):
        return F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))

    told = member.select("list", "node", "component", "common", F.pmod(F.xxhash64("node"), "cuts").alias("i"), each("askers").alias("j"), F.lit(False).alias("asks"))
    asking = member.where("component <> common").select("list", "node", "component", "common", each("cuts").alias("i"), F.pmod(F.xxhash64(F.lit(1), "node"), "askers").alias("j"), F.lit(True).alias("asks"))
    rows = told.unionByName(asking).join(known.join(classes.select(F.col("class").alias("node"), "n", "point", "unit"), "node"), "node")
    parts = int(lists.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(parts, "list", "i", "j").sortWithinPartitions("list", "i", "j", "asks", "node")
    columns = ("node", "component", "common", "asks", "n", "point", "unit", "known")

    def found(key, held):
        told, asking = [r for r in held if not r[3]], [r for r in held if r[3]]
        out = {"a": [], "b": []}
        if not told or not asking:
            return out
        node, component, common, _, n, body, unit, lists_of = zip(*told)
        forest, lists_of = CountVectorForest(body, unit, np.array(n, dtype=np.int64)), [frozenset(x) for x in lists_of]
        for q, own, _, _, size, point, times, mine in asking:
            mine = [x for x in mine if x < key[0]]
            for i in forest.search(np.frombuffer(point, np.uint8).astype(np.int32) * times, size, share).tolist():
                if component[i] != own and (component[i] == common[i] or node[i] < q) and not any(x in lists_of[i] for x in mine):
                    out["a"].append(q)  # it leads: it may have many candidates, and each of these few such leaders
                    out["b"].append(node[i])
        return out

    def work(batches):
        held, now = [], None
        for batch in batches:
            for key, *row in zip(zip(*(batch.column(c).to_pylist() for c in ("list", "i", "j"))), *(batch.column(c).to_pylist() for c in columns)):
                if key != now and held:
                    yield found(now, held)
                    held = []
                now = key
                held.append(row)
        if held:
            yield found(now, held)

    pairs, done = arrow_map(rows.select("list", "i", "j", *columns), work, "a long, b long").distinct().alias("p"), tried.alias("t")  # leaders of lists are their smallest classes
    return pairs.join(done, (F.least("p.a", "p.b") == F.col("t.a")) & (F.greatest("p.a", "p.b") == F.col("t.b")), "left_anti")


def _link_counts(named: DataFrame, docs: DataFrame, members: DataFrame, width: int, share: Fraction, block: int = 500, shingles: int = 1 << 20) -> DataFrame:
    """(class, linked): how many rows of other classes a class is linked with; classes without any may be missing.

    named: class, component, n_class, n. A component of more than block classes
    or of more shingles is cut, and each two of its cuts are searched and
    verified by one task.
    """
    cuts = named.groupBy("component").agg(F.count("*").alias("size"), F.ceil(F.greatest(F.count("*") / block, F.sum("n") / shingles)).alias("cuts")).where("size > 1")
    member = join_groups(named.select("class", "component", "n_class"), cuts, "component", "size", named.count())
    member = stage(member.withColumn("cut", F.pmod(F.xxhash64("class"), "cuts")).drop("size"), "members")
    sets = _whole_sets(member.select("class"), docs, members, width)
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("cuts") - 1))
    paired = member.join(sets, "class").select("component", "class", "n_class", "set", "cut", other.alias("with")).withColumns({"i": F.least("cut", "with"), "j": F.greatest("cut", "with")})
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    paired = paired.repartition(parts, "component", "i", "j").sortWithinPartitions("component", "i", "j").select("component", "i", "j", "class", "n_class", "cut", "set")

    def found(key, held):
        names, weight, cut, sets = (list(x) for x in zip(*held))
        sets, weight, cut = [np.frombuffer(s, "<u8") for s in sets], np.array(weight, dtype=np.int64), np.array(cut, dtype=np.int64)
        asks, told = np.flatnonzero(cut == key[1]), np.flatnonzero(cut == key[2])
        out = np.zeros(len(sets), dtype=np.int64)
        if len(asks) and len(told):
            made, n = [point_of(s) for s in sets], np.array([len(s) for s in sets], dtype=np.int64)
            forest, overlaps = CountVectorForest([made[i][0] for i in told], [made[i][1] for i in told], n[told]), Overlaps([sets[i] for i in told.tolist()])
            for q in asks.tolist():
                near = forest.search(np.frombuffer(made[q][0], np.uint8).astype(np.int32) * made[q][1], int(n[q]), share)
                near = near[told[near] != q]
                if len(near):
                    both = overlaps.of(sets[q])[near]
                    near = told[near[both * share.denominator >= share.numerator * (n[q] + n[told[near]] - both)]]
                    out[q] += weight[near].sum()
                    if key[1] != key[2]:
                        out[near] += weight[q]
        return {"class": names, "linked": out}

    def work(batches):
        held, now = [], None
        for batch in batches:
            for key, *row in zip(zip(*(batch.column(c).to_pylist() for c in ("component", "i", "j"))), *(batch.column(c).to_pylist() for c in ("class", "n_class", "cut", "set"))):
                if key != now and held:
                    yield found(now, held)
                    held = []
                now = key
                held.append(row)
        if held:
            yield found(now, held)

    return stage(arrow_map(paired, work, "class long, linked long").groupBy("class").agg(F.sum("linked").alias("linked")), "link-counts")


def near_duplicates(docs: DataFrame, width: int = 5, share: Fraction = Fraction(3, 4), text: str = "text", doc_id: str = "doc_id", links: bool = False, block: int = 250) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id that links reach), n_class (rows with an equal set); with links also n_links (other rows of that similarity at least, those with an equal set among them). block: classes that a task holds at once of each side of a search."""
    spark = docs.sparkSession
    shared_dir(spark)
    bounded_batches(spark)
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    levels = spark.sparkContext.broadcast(_frequency_levels(docs, width))
    rows = stage(_classes(docs, levels, width, share), "classes")
    full = rows.where("n > 0")
    classes = full.groupBy("class").agg(F.first(F.struct("keys", "n", "point", "unit")).alias("x"), F.min_by("doc_id", F.struct(F.col("doc_id").isNull(), "doc_id")).alias("doc_id"))
    classes = stage(classes.select("class", "x.*", "doc_id"), "distinct-sets")
    members = classes.select("class", "doc_id")
    total = full.agg(F.coalesce(F.sum(F.length("keys")), F.lit(0))).first()[0]
    buckets = int(min(65_536, max(64, total >> 24)))
    met = stage(_meetings(_postings(classes, buckets), buckets), "meetings")
    stars = stage(met.where("a is not null").select("a", "b").distinct(), "stars")
    found = _verified(_reachable(stars, classes, share), docs, members, width, share)
    labels = components(found)
    lists = met.where("list is not null").groupBy("list", "part").agg(F.first("body").alias("body"))
    across = stage(_across(lists, labels, classes, stars, share, block), "across")
    if across.limit(1).count():
        more = _verified(across, docs, members, width, share)
        found = found.unionByName(more)
        labels = components(found)
    groups = full.groupBy("class").agg(F.min("doc_id").alias("least"), F.count("*").alias("n_class"), F.max("n").alias("size"))
    named = groups.join(labels.withColumnRenamed("node", "class"), "class", "left").withColumn("component", F.coalesce("component", "class"))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"), F.count("*").alias("n"))
    known = join_groups(named, least, "component", "n", named.count()).select("class", "component_id", "n_class")
    if links:
        counts = _link_counts(stage(named.select("class", "component", "n_class", F.col("size").alias("n")), "named"), docs, members, width, share, 2 * block)
        known = known.join(counts, "class", "left").withColumn("n_links", F.col("n_class") - 1 + F.coalesce("linked", F.lit(0))).drop("linked")
    known = stage(known, "components")
    out = join_groups(full.select("doc_id", "n", "class"), known, "class", "n_class", rows.count())
    alone = rows.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").cast("long").alias("component_id"), F.lit(1).cast("long").alias("n_class"), F.lit(0).cast("long").alias("n_links"))
    more = ["n_links"] if links else []
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.col("component_id").cast("long").alias("component_id"), "n_class", *more).unionByName(alone.select("doc_id", "n_shingles", "component_id", "n_class", *more))


def keep_one(docs: DataFrame, width: int = 5, share: Fraction = Fraction(3, 4)) -> DataFrame:
    """docs with one document of each group, the one with the smallest doc_id, all columns kept; documents without words stay. Rows that share their doc_id are one document, and stay or go together."""
    got = near_duplicates(docs, width, share)
    first = got.where(F.col("doc_id").eqNullSafe(F.col("component_id")) | (F.col("n_shingles") == 0)).select(F.col("doc_id").alias("__id")).distinct()
    return docs.join(first, F.col("doc_id").eqNullSafe(F.col("__id")), "left_semi")
