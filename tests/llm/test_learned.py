"""Operators that learn, sample or search, against brute force, exact totals and held-out labels."""

import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliant.llm import jaccard_join, kmeans_tree, langid, mixing, quality, shingles
from foliant.llm.common import held_out

SF = "/root/testdata/sf0.01"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def shingle_tuples(text):
    w = WORDS.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute_components(rows):
    sets, parent = [shingle_tuples(t) for _, t in rows], list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (i, a), (j, b) in itertools.combinations(enumerate(sets), 2):
        both = len(a & b)
        if both and 100 * both >= 75 * (len(a) + len(b) - both):
            parent[find(i)] = find(j)
    out: dict = {}
    for i, (doc, _) in enumerate(rows):
        out.setdefault(find(i), []).append(doc)
    return {doc: (len(sets[i]), min(out[find(i)])) for i, (doc, _) in enumerate(rows)}


def near_copies(n_groups, rnd, most=14):
    words, rows = [f"w{i}" for i in range(60)], [(0, None), (1, ""), (2, " \n"), (3, "a b"), (4, "A  b"), (5, "é x y z w v"), (6, "É x y z w v")]
    for _ in range(n_groups):
        base = [rnd.choice(words) for _ in range(rnd.randint(8, 60))]
        for _ in range(rnd.randint(1, most)):
            t = list(base)
            for _ in range(rnd.randint(0, 3)):
                t[rnd.randrange(len(t))] = rnd.choice(words)
            base = t if rnd.random() < 0.3 else base
            rows.append((len(rows), " ".join(t)))
    return rows


def test_jaccard_join(spark):
    rows = near_copies(40, random.Random(3))
    base = "many copies of one text with some word changed here and there so that most of them are linked by what they share".split()
    for i in range(60):  # more than there are leaders
        t = list(base)
        t[i % len(t)] = f"x{i}"
        t[(i * 7 + 3) % len(t)] = f"y{i}" if i % 3 else t[(i * 7 + 3) % len(t)]
        rows.append((1000 + i, " ".join(t)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).selectExpr("*", "1 as n", "2 as component_id")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.near_duplicates(df).collect()}
    assert got == brute_components(rows)


def test_jaccard_join_edges(spark):
    rows = [(None, "a b c d e f"), (2, "a b c d e f"), (2, "a b c d e f"), (3, None), (4, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.n_shingles, r.component_id) for r in jaccard_join.near_duplicates(df).collect())
    assert got == [(0, 2, 2), (2, 2, 2), (2, 2, 2), (3, 0, 3), (4, 1, 4)]
    assert jaccard_join.near_duplicates(df.limit(0)).count() == 0


def test_jaccard_join_links(spark):
    rnd = random.Random(5)
    rows = near_copies(20, rnd)
    base = [f"b{i}" for i in range(100)]
    for i in range(40):  # each text is near most others
        t = list(base)
        t[rnd.randrange(5, 95)] = f"x{i}"
        rows.append((1000 + i, " ".join(t)))
    rows += [(2000 + i, " ".join(f"c{k}" for k in range(4 * i, 4 * i + 60))) for i in range(30)]  # a chain: each is near its neighbours only
    rows += [(rows[-1][0], rows[-1][1]), (None, rows[-2][1])]
    sets = [shingle_tuples(t) for _, t in rows]
    n = [0] * len(rows)
    for (i, a), (j, b) in itertools.combinations(enumerate(sets), 2):
        both = len(a & b)
        if both and 100 * both >= 75 * (len(a) + len(b) - both):
            n[i], n[j] = n[i] + 1, n[j] + 1
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = jaccard_join.near_duplicates(df, links=True)
    assert sorted((r.doc_id or 0, r.n_shingles, r.n_links) for r in got.collect()) == sorted((d or 0, len(s), k) for (d, _), s, k in zip(rows, sets, n))
    assert max(n) > 30 and jaccard_join.near_duplicates(df.limit(0), links=True).count() == 0


@pytest.mark.parametrize("block", [2, 7])
def test_link_counts_across_cuts(spark, block):
    from fractions import Fraction

    rows = [(i, " ".join(f"b{k}" if k != 7 * i else f"x{i}" for k in range(100))) for i in range(15)]
    sets = [shingle_tuples(t) for _, t in rows]
    want = [sum(4 * len(a & b) >= 3 * len(a | b) for b in sets) - 1 for a in sets]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    plain = spark.sparkContext.broadcast(jaccard_join.Table(1 << jaccard_join.SLOTS, []))
    full = jaccard_join._classes(docs, plain, 5, Fraction(3, 4))
    named = full.select("class", F.lit(1).cast("long").alias("component"), F.lit(1).cast("long").alias("n_class"), "n")
    counts = jaccard_join._link_counts(named, docs, full.select("class", "doc_id"), 5, Fraction(3, 4), block=block).join(full, "class")
    assert [r.linked for r in counts.orderBy("doc_id").collect()] == want


def test_forest_loses_nothing():
    rng = np.random.default_rng(0)
    from fractions import Fraction

    sets = [np.unique(rng.integers(0, 2**63, n, dtype=np.uint64)) for n in [*rng.integers(1, 200, 60), *rng.integers(400, 20_000, 30), 70_000, 100]]
    sets += [np.sort(np.concatenate((s[: max(1, int(len(s) * 0.9))], rng.integers(0, 2**63, 2, dtype=np.uint64)))) for s in sets]
    sets.append(np.unique(np.arange(600, dtype=np.uint64) << np.uint64(40)))  # all in one group
    made, sizes = [jaccard_join.point_of(s) for s in sets], np.array([len(s) for s in sets])
    forest, through = jaccard_join.CountVectorForest(*zip(*made), sizes), 0
    for i, s in enumerate(sets):
        near = set(forest.search(forest.points[i], len(s), Fraction(3, 4)).tolist())
        assert {j for j, x in enumerate(sets) if jaccard_join.linked(s, x, Fraction(3, 4))} <= near
        through += len(near) if len(s) > 400 else 0
    assert through < 4 * 70  # unrelated large sets are told apart


def test_jaccard_join_across_blocks(spark):
    rnd = random.Random(8)
    passage, rows = [f"p{i}" for i in range(40)], []
    for i in range(50):  # all share a passage, so that they are in the same lists; some are linked by what else they share
        own = [f"o{i // 3}_{k}" if rnd.random() < 0.8 else f"q{i}_{k}" for k in range(rnd.randint(3, 14))]
        rows.append((i, " ".join(passage + own)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = brute_components(rows)
    assert 1 < len({c for _, c in want.values()}) < 50
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.near_duplicates(df, block=4).collect()} == want


def test_jaccard_join_long_texts(spark):
    rnd = random.Random(9)
    words, rows = [f"w{i}" for i in range(3000)], []
    for i in range(14):
        base = [rnd.choice(words) for _ in range(10_000)]
        rows.append((2 * i, " ".join(base)))
        if i < 4:
            for k in range(0, 10_000, 60 + 100 * i):
                base[k] = f"x{k}"
            rows.append((2 * i + 1, " ".join(base)))
    thue = "a"
    for _ in range(10):
        thue += thue.translate({97: 98, 98: 97})
    rows += [(100, f"x {thue} y"), (101, f"x {thue.translate({97: 98, 98: 97})} y"), (102, f"X {thue.upper()} y")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.near_duplicates(df).collect()} == brute_components(rows)


def test_long_words():
    t = "a" * (3 << 20)
    assert len(shingles.word_hashes(f"x {t} y {t}")) == 4 and len(set(shingles.word_hashes(f"{t} {t} {t}b").tolist())) == 2


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_languages(spark, documents):
    model = langid.train(documents.where(~held_out()))
    got = langid.identify(documents, model, keep=["doc_id", "lang"]).where(held_out())
    right, n = got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double")), F.count("*")).first()
    assert n > 150 and right > 0.97
    two = spark.createDataFrame([(1, "the thing of the other and that there " * 20 + "der und die schung über ein mit " * 20)], "doc_id long, text string")
    assert set(langid.identify(two, model).first().lang_shares) == {"de", "en"}


def test_language_edges(spark, documents):
    model = langid.train(documents.limit(50))
    rows = [(1, None), (2, ""), (3, "123 !!"), (4, "a"), (5, "x" * 1_200_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'z' as lang_pred_", "0 as other")
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(df, model).collect()}
    assert [got[i] for i in (1, 2, 3)] == [("und", 0.0)] * 3 and got[4][0] != "und" and 0 <= got[5][1] <= 1
    nothing = langid.train(documents.limit(0))
    assert {r.lang_pred for r in langid.identify(df, nothing).collect()} == {"und"}
    assert langid.identify(df.limit(0), model).count() == 0


def test_quality(spark, documents):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = quality.train(documents, labels.where(~held_out()))
    got = quality.score(documents, model, keep=["doc_id"]).where(held_out()).join(labels, "doc_id")
    assert got.agg(F.avg((F.col("predicted") == F.col("quality")).cast("double"))).first()[0] > 0.95
    rows = [(1, None), (2, ""), (3, " "), (4, "a"), (5, "x" * 1_200_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "0 as label")
    scores = {r.doc_id: r.score for r in quality.score(df, model).collect()}
    assert scores[1] == scores[2] == 0 and all(0 <= s <= 1 for s in scores.values())
    assert quality.train(documents.limit(0), labels) is None
    assert [r.score for r in quality.score(df, None).orderBy("doc_id").collect()] == [0, 0, 0.5, 0.5, 0.5]


def plain_mixture(model, text, steps=12):
    """Expectation-maximisation over words, one text, in plain loops."""
    words = re.findall(r"[^\W\d_]+", text)
    rows = []
    for w in words:
        full, context, _, _ = langid.grams([w])
        rows.append([sum(float(model.follow[f, k]) - float(model.context[c, k]) for f, c in zip(full, context)) for k in range(len(model.languages))])
    if not rows:
        return [0.0] * len(model.languages)
    p = [[np.exp(max(x - max(r), -60)) for x in r] for r in rows]

    def maximise(share):
        for _ in range(steps):
            total = [0.0] * len(share)
            for r in p:
                z = sum(a * b for a, b in zip(r, share))
                total = [t + a * b / z for t, a, b in zip(total, r, share)]
            new = [t / len(p) for t in total]
            settled = max(abs(a - b) for a, b in zip(new, share)) < 1e-3
            share = new
            if settled:
                break
        return share, sum(np.log(sum(a * b for a, b in zip(r, share)) + 1e-300) for r in p)

    share, like = maximise([1 / len(model.languages)] * len(model.languages))
    share = [x if x >= 1e-4 else 0.0 for x in share]
    share = [x / sum(share) for x in share]
    while sum(x > 0 for x in share) > 1:
        least = min((x, i) for i, x in enumerate(share) if x > 0)[1]
        fewer = [0.0 if i == least else x for i, x in enumerate(share)]
        tried, tried_like = maximise([x / sum(fewer) for x in fewer])
        if tried_like + 0.5 * np.log(max(len(p), 2)) < like:
            break
        share, like = tried, tried_like
    return share


def test_language_shares_are_the_plain_ones(spark, documents):
    model = langid.train(documents.where(~held_out()))
    texts = [r.text or "" for r in documents.orderBy("doc_id").limit(60).collect()] + ["", "123", "the der und of " * 30]
    got = langid.infer(model, texts)
    for t, g in zip(texts, got):
        assert g == pytest.approx(plain_mixture(model, t), abs=2e-5)


def test_languages_do_not_depend_on_batches(spark, documents, monkeypatch):
    model = langid.train(documents.where(~held_out()))
    texts = [r.text or "" for r in documents.orderBy("doc_id").limit(300).collect()]
    texts[7] = "Wörter und the other " * 300
    together = langid.infer(model, texts)
    assert (together == np.concatenate([langid.infer(model, [t]) for t in texts])).all()
    monkeypatch.setattr(langid, "_SLICE", 1000)  # long texts are cut between words
    assert np.abs(together - langid.infer(model, texts)).max() == 0
    ties = spark.createDataFrame([(1, "a"), (1, "a"), (2, "a")], "doc_id long, text string").withColumns({"score": F.lit("x"), "lang_pred": F.lit(1)})
    out = langid.identify(ties, model)
    assert len(set(out.columns)) == len(out.columns) and len({(r.lang_pred, r.score) for r in out.select("lang_pred", "score").collect()}) == 1


def plain_vote(model, text, neighbours=15):
    counts = quality.term_counts([text])[0].astype(float)
    parts = [np.sqrt(c / max(c.sum(), 1)) for c in (counts[: quality.SHAPES], counts[quality.SHAPES :])]
    v = (np.concatenate((parts[0], quality.WORDS_COUNT * parts[1])) * model.weight) @ model.axes.astype(float)
    v /= max(np.linalg.norm(v), 1e-12)
    near = sorted(((round(float(v @ x), 6), -i) for i, x in enumerate(model.vectors.astype(float))), reverse=True)[:neighbours]
    weigh = [(max(c, 0.01) ** 8 * float(model.votes[-i]), int(model.labels[-i])) for c, i in near]
    return sum(w for w, y in weigh if y) / sum(w for w, _ in weigh)


def test_quality_is_the_plain_vote(spark, documents):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = quality.train(documents, labels.where(~held_out()))
    texts = [r.text or "" for r in documents.orderBy("doc_id").limit(400).collect()]
    texts += ["", "Hello there", "zz 9!", "line\nline\n\nline", "x" * 1_200_000, "the same words here\n" * 60_000]
    got = quality.vote(model, texts)
    assert got == pytest.approx([plain_vote(model, t) for t in texts], abs=2e-3)
    assert (got == np.concatenate([quality.vote(model, [t]) for t in texts])).all()
    assert (got == quality.vote(model, texts[::-1], block=64)[::-1]).all()
    assert (quality.term_counts(["Hello there", "zz 9!", "\n\n", "zz 9!"])[[1, 3]] == quality.term_counts(["zz 9!"])).all()


def test_quality_edges(spark, documents):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = quality.train(documents, labels)
    df = documents.select("doc_id", "text").withColumns({"predicted": F.lit("p"), "score": F.lit("s")})
    again = quality.score(df.unionByName(df).repartition(7), model)
    assert len(set(again.columns)) == len(again.columns)
    one = {r.doc_id: r.score for r in quality.score(df, model).collect()}
    assert all(one[r.doc_id] == r.score for r in again.collect())  # repeated rows, other batches
    assert quality.score(df.limit(0), model).count() == 0
    twins = quality.Model(model.weight, model.axes, np.repeat(model.vectors[:1], 40, axis=0), np.array([1] * 20 + [0] * 20), np.ones(40, dtype=np.float32))
    assert quality.vote(twins, ["some words"]) == [1.0]  # of equally near ones the first


def test_targets():
    t = mixing.targets({"a": 100, "b": 1, "c": 100, None: 0})
    assert t[None] == 0 and t["b"] == 3 and sum(t.values()) == 201 and t["c"] == 3 * t["a"]
    assert mixing.targets({}) == {}


def test_flight_keeps_totals():
    rng = np.random.default_rng(5)
    size, p = rng.integers(0, 3000, 500), np.full(500, 0.37)
    q = mixing.flight(size, p, 1)
    assert ((q > 0) & (q < 1)).sum() <= 2
    assert q.sum() == pytest.approx(p.sum()) and (size * q).sum() == pytest.approx((size * p).sum())


def test_mix(spark, documents):
    got = mixing.mix(documents).collect()
    assert len(got) == documents.count()
    by: dict = {}
    for r in got:
        assert 0 <= r.taken <= 3 * r["size"]
        x = by.setdefault(r.source, [0, r.target])
        x[0] += r.taken
    assert all(abs(taken - target) <= 0.05 * target + 50 for taken, target in by.values())
    again = {(r.doc_id, r.taken) for r in mixing.mix(documents.repartition(7)).collect()}
    assert again == {(r.doc_id, r.taken) for r in got}


def test_mix_edges(spark):
    rows = [(1, "a b", None), (1, "a b", None), (2, None, "s"), (3, "", "s"), (None, "x y z", "t"), (4, "w " * 50_000, "t")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 as target", "2 as size")
    got = mixing.mix(df).collect()
    assert len(got) == 6 and all(r.taken == 0 for r in got if r.source == "s")
    assert mixing.mix(df.limit(0)).count() == 0
    assert mixing.apply_mix(df).columns == df.columns


def test_mix_takes_rows(spark):
    rnd = random.Random(7)
    rows = [(rnd.choice([None, 1, 2, *range(20, 60)]), "w " * rnd.choice([0, 1, 3, 3, 50]), rnd.choice([None, "a", "b", "c"])) for _ in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("size", F.lit(1))
    want, got = {}, {}
    for r in mixing.mix(df).collect():
        want[r.doc_id, r.source, r["size"]] = want.get((r.doc_id, r.source, r["size"]), 0) + r.copies
    for r in mixing.apply_mix(df).collect():
        k = r.doc_id, r.source, len((r.text or "").split())
        got[k] = got.get(k, 0) + 1
    assert got == {k: n for k, n in want.items() if n}


def test_mix_ties(spark):
    rows = [(i, "one two", s) for i in range(300) for s in ("a", "b")]  # all of one size
    got: dict = {}
    for r in mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect():
        got.setdefault(r.source, [r.target, 0])[1] += r.taken
    assert all(abs(taken - target) <= 2 for target, taken in got.values())


def test_landing_is_the_best_of_all_roundings():
    rng = np.random.default_rng(11)
    for _ in range(20):
        size, p = rng.integers(1, 200, 10), rng.random(10)
        gap = lambda q: abs((size * q).sum() - (size * p).sum()) + abs(q.sum() - p.sum())
        q = mixing.landing(size, p)
        assert set(q.tolist()) <= {0.0, 1.0} and gap(q) <= min(gap(np.array(x)) for x in itertools.product((0, 1), repeat=10)) + 1e-9


def test_nearest(spark):
    rng = np.random.default_rng(1)
    centres = rng.standard_normal((20, 16)) * 3
    x = (centres[rng.integers(0, 20, 3000)] + rng.standard_normal((3000, 16))).astype(np.float32)
    x[100:140] = x[100]  # more equal vectors than are asked for
    df = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "vec_id long, embedding array<float>")
    got: dict = {}
    for r in kmeans_tree.search(df, lambda i: i % 100 == 0).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    found, x64 = 0, x.astype(float)
    for q in range(0, 3000, 100):
        d = np.sqrt(((x64 - x64[q]) ** 2).sum(axis=1))
        best = [i for i in np.lexsort((np.arange(3000), d)) if i != q][:10]
        mine = sorted(got[q])
        assert [r for r, _, _ in mine] == list(range(1, 11)) and [(s, i) for _, i, s in mine] == sorted((d[i], i) for _, i, _ in mine)
        found += len(set(best) & {i for _, i, _ in mine})
    assert found >= 0.9 * 300


@pytest.mark.parametrize("cut", [1, 7])
def test_nearest_in_cuts(spark, cut):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((600, 8))
    df = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(x)], "vec_id long, embedding array<double>")
    got = kmeans_tree.search(df, lambda i: i % 10 == 0, goal=1.0, leaf_cut=50 * cut, ask_cut=cut).collect()
    assert len(got) == 600
    for r in got:
        assert r.score == np.sqrt(((x[r.vec_id] - x[r.query_id]) ** 2).sum())
    exact = {(q, int(i)) for q in range(0, 600, 10) for i in np.argsort(((x - x[q]) ** 2).sum(axis=1))[1:11]}
    assert len(exact & {(r.query_id, r.vec_id) for r in got}) >= 0.95 * len(exact)


def test_nearest_repeated_query(spark):
    rows = [(100, [1.0, 0.5])] * 13 + [(i, [1.0 + i, 0.0]) for i in range(12)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted((r["rank"], r.vec_id) for r in kmeans_tree.search(df, lambda i: i == 100).collect())
    assert got == [(i + 1, i) for i in range(10)]


def test_nearest_edges(spark):
    rows = [(0, [1.0, 2.0]), (1, None), (2, [0.0, 0.0]), (3, [1.0, float("nan")]), (4, [1.0, None]), (5, [1.0, 2.0]), (6, [1.0, 2.0, 3.0]), (100, [3.0, 1.0]), (7, []), (8, [float("inf"), 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 as rank", "'q' as key")
    got = {(r.query_id, r["rank"], r.vec_id) for r in kmeans_tree.search(df, lambda i: i % 100 == 0).collect()}
    assert got == {(0, 1, 5), (0, 2, 100), (100, 1, 0), (100, 2, 5)}
    assert kmeans_tree.search(df.limit(0), lambda i: i % 100 == 0).count() == 0
