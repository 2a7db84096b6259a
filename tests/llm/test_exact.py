"""Exact dedup, WARC and token operators against SQL, brute force and the libraries."""

import random
import zlib

import numpy as np
import pytest

from foliant.llm import byte_bpe, exact_dedup, pieces, token_files, warc
from foliant.llm.queries import ORACLE_SQL, QUERIES
from tests.oracle import compare, connect

P = pytest.importorskip("public_tokenizers")
RANKS, JSON = P.path("byte_bpe_50k.tiktoken"), P.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
ODD = ["", " ", "  a", "a  b \n c", " a'll 'tis don't  ", "　x y \x1c z\x1cq", "日本語テキスト です", "a" * 5000, "*" * 3000, " " * 3000, "x\n\n y", "\t\tz ", "é è ê", "<|endoftext|> a", "12 345 6789,1", "🙂🙂 🙂", "a\xa0b c", "foo.\nBar \nbaz", "\n", "a\n"]


def odd_texts(n=800):
    rnd = random.Random(1)
    return ODD + ["".join(rnd.choice(" \n\tab'sé日1!?\x1c ") for _ in range(rnd.randint(0, 60))) for _ in range(n)]


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_oracle(spark, small, name):
    compare(QUERIES[name](spark, small), connect(small), ORACLE_SQL[name])


def test_dedup_edges(spark):
    rows = [(1, None), (2, ""), (3, "a"), (5, "a"), (5, "a"), (None, "a"), (None, "b"), (7, "A")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' as digest", "1 as uid", "'k' as kept")
    got = exact_dedup.dedup(df).collect()
    assert len(got) == 8 and sum(r.kept for r in got) == 4
    assert {(r.doc_id, r.keep_id, r.group_size) for r in got} == {(1, 2, 2), (2, 2, 2), (3, 5, 4), (5, 5, 4), (None, 5, 4), (None, None, 1), (7, 7, 1)}
    assert exact_dedup.dedup(df.limit(0)).count() == 0
    kept = exact_dedup.keep_first(df)
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [0, 2, 5, 7] and kept.columns == df.columns


def test_dedup_against_earlier_batches(spark):
    index = exact_dedup.DigestIndex(spark, "digests_of_a_test", 4)
    index.drop()
    first = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string")
    second = spark.createDataFrame([(3, "a"), (4, "c"), (5, "c"), (5, "c"), (None, "c")], "doc_id long, text string")
    assert all(r.kept for r in exact_dedup.dedup(first, index, "first").collect())
    want = [(0, 5, 4, False), (3, 1, 1, False), (4, 5, 4, False), (5, 5, 4, False), (5, 5, 4, True)]
    for _ in range(2):  # given again, as after a failure, a batch gets the same answer
        got = sorted((r.doc_id or 0, r.keep_id, r.group_size, r.kept) for r in exact_dedup.dedup(second, index, "second").collect())
        assert got == want and index.read().count() == 3
    index.compact()
    assert exact_dedup.DigestIndex(spark, "digests_of_a_test", 99).read().count() == 3
    assert sorted((r.doc_id or 0, r.keep_id, r.group_size, r.kept) for r in exact_dedup.dedup(second, index, "second").collect()) == want
    plan = index.missing(exact_dedup.digests(second))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "LeftAnti" in plan and "SelectedBucketsCount: 4 out of 4" in plan
    assert plan[plan.index("LeftAnti") :].count("Exchange hashpartitioning") == 1  # of the batch; the index isn't shuffled
    index.drop()


def test_dedup_by_parts(spark):
    rnd = random.Random(6)
    rows = [(rnd.choice([None, *range(40)]), rnd.choice(["", None, *"abcdefgh", "long " * 40_000, "long " * 40_000 + "x"])) for _ in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    by: dict = {}
    for i, t in rows:
        by.setdefault(t or "", []).append(i)
    want = sorted((i or -1, max((x for x in by[t or ""] if x is not None), default=None), len(by[t or ""])) for i, t in rows)
    for parts in (1, 2, 5):
        got = exact_dedup.dedup(df, parts=parts).collect()
        assert sorted((r.doc_id or -1, r.keep_id, r.group_size) for r in got) == want
        assert sorted(r.text_sha256 for r in got if r.kept) == sorted({r.text_sha256 for r in got})
        assert all(r.doc_id == r.keep_id for r in got if r.kept)


def test_bpe_is_the_librarys():
    import tiktoken

    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.read_ranks(RANKS), special_tokens={})
    own = byte_bpe.text_encoder(RANKS, P.PATTERN)
    for t in odd_texts():
        ids = np.frombuffer(own.encode(t), "<u4")
        assert ids.tolist() == enc.encode_ordinary(t) and own.decode(ids).decode() == t


def test_encode_documents(spark):
    import hashlib

    import tiktoken

    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.read_ranks(RANKS), special_tokens={})
    rows = [(1, None), (2, ""), (2, ""), (None, "null id"), (3, "x\n\n y's 12 日本"), (4, "word " * 200_000), (3, "x\n\n y's 12 日本")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as n_tokens", "'q' as decoded_sha256")
    got = byte_bpe.encode_documents(df, RANKS, P.PATTERN).collect()
    want = []
    for i, t in rows:
        ids = enc.encode_ordinary(t or "")
        want.append((i or 0, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted((r.doc_id or 0, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got) == sorted(want)
    assert byte_bpe.encode_documents(df.limit(0), RANKS, P.PATTERN).count() == 0


def test_other_patterns():
    import tiktoken

    for other in (r"\s+|\S+", r"\p{L}+ ?|[^\p{L}]"):
        enc = tiktoken.Encoding("own", pat_str=other, mergeable_ranks=byte_bpe.read_ranks(RANKS), special_tokens={})
        own = byte_bpe.text_encoder(RANKS, other)
        for t in ("one two\n three", "a  b", "é 日本 x", ""):
            assert np.frombuffer(own.encode(t), "<u4").tolist() == enc.encode_ordinary(t)


def test_whole_files_are_left(tmp_path):
    from foliant.llm.common import write_whole

    write_whole(str(tmp_path), "a", [b"one"])
    write_whole(str(tmp_path), "a", [b"one"])
    assert [p.name for p in tmp_path.iterdir()] == ["a"] and (tmp_path / "a").read_bytes() == b"one"


def test_pairs_and_edits():
    own, rnd = byte_bpe.text_encoder(RANKS, P.PATTERN).pieces, random.Random(2)
    for _ in range(3000):
        a, b = rnd.randrange(rnd.choice([300, 3000, 50256])), rnd.randrange(rnd.choice([300, 3000, 50256]))
        assert own._pair(a, b) == (own.merged(own.tokens[a] + own.tokens[b]) == [a, b])
    piece = byte_bpe.EditablePiece(own, b" incom")
    piece.append(b"prehensible")
    assert piece.ids() == own.encode(b" incomprehensible")
    piece.replace(3, 6, b"xyz")
    assert piece.ids() == own.encode(b" inxyzprehensible")


def test_words_of_one_key():
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(JSON)
    plain.encode_special_tokens = True
    own, texts = pieces.LibraryEncoder(JSON), []
    for n in (10, 11, 12):  # words whose sums of powers agree
        thue = "a"
        for _ in range(n):
            thue += thue.translate({97: 98, 98: 97})
        other = thue.translate({97: 98, 98: 97})
        texts += [f"x {thue}zzz y {other}zzz w", f"{other}zzz", f"x {other}zzz", f"x {thue}zzz\n{other}zzz, {thue}zzz."]
    for _ in range(2):
        ids, ends = own.encode(texts)
        for t, a, b in zip(texts, [0, *ends.tolist()], ends.tolist()):
            assert ids[a:b].tolist() == plain.encode(t, add_special_tokens=False).ids


def test_library_ids():
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(JSON)
    plain.encode_special_tokens = True
    own = pieces.LibraryEncoder(JSON, most=500)
    texts = odd_texts()
    for _ in range(2):
        for i in range(0, len(texts), 100):
            ids, ends = own.encode(texts[i : i + 100])
            for t, a, b in zip(texts[i : i + 100], [0, *ends.tolist()], ends.tolist()):
                assert ids[a:b].tolist() == plain.encode(t, add_special_tokens=False).ids, t


def test_simple8b():
    rnd = random.Random(3)
    for _ in range(200):
        x = np.array([rnd.choice([0, 1, 5, 200, 70000, 2**33, 2**60 - 1, 2**60, 2**64 - 1]) for _ in range(rnd.randint(0, 300))], dtype=np.uint64)
        words, first = token_files.pack(x, block=16)
        assert (token_files.unpack(words) == x).all()
        bounds = [*first.tolist(), len(words)]
        for b, (i, j) in enumerate(zip(bounds, bounds[1:])):
            assert (token_files.unpack(words[i:j]) == x[16 * b : 16 * b + 16]).all()


def test_token_files(spark):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(JSON)
    rows = [(9, "one two"), (3, None), (5, ""), (None, "null id"), (5, ""), (1, "x " * 9000), (7, "日本 \n語")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).selectExpr("*", "1 as start", "2 as n_tokens")
    got = token_files.token_file_documents(df, JSON).orderBy("start").collect()
    at, want = 0, []
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = np.array([*plain.encode(t or "", add_special_tokens=False).ids, 2], dtype="<u4")
        want.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert [tuple(r) for r in got] == want
    assert token_files.token_file_documents(df.limit(0), JSON).count() == 0


def test_token_files_of_one_id(spark):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(JSON)
    rows = [(None if i % 2 else 5, f"text {i} " * (i % 4)) for i in range(200)]
    got = token_files.token_file_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), JSON).orderBy("start").collect()
    assert [r.doc_id for r in got] == [None] * 100 + [5] * 100
    sizes = [r.n_tokens for r in got]
    assert [r.start for r in got] == [0, *np.cumsum(sizes)[:-1].tolist()] and sum(sizes) == sum(len(plain.encode(t, add_special_tokens=False).ids) + 1 for _, t in rows)


def test_long_payloads(spark):
    rows = [(1, "http://a.b/x", "y" * 5_000_000), (2, "http://a.b/x", "y" * 5_000_000), (3, "http://a.b/z", "é" * 2_000_000)]
    got = warc.capture_history(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert sorted((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in got) == [(1, 5_000_000, "response", None), (2, 5_000_000, "revisit", 1), (3, 4_000_000, "response", None)]


def test_loser_tree():
    rnd = random.Random(4)
    for _ in range(200):
        runs = [sorted(rnd.randint(0, 30) for _ in range(rnd.randint(0, 20))) for _ in range(rnd.randint(0, 9))]
        assert list(warc.LoserTree([iter(x) for x in runs], lambda v: v)) == sorted(sum(runs, []))


def test_warc_edges(spark):
    z = "z" * 200
    rows = [(1, "http://a.b/x", z), (2, "http://a.b/y", z), (2, "http://a.b/y", z), (3, None, None), (None, "http://a.b:8080/é?q=%20", z), (4, "http://[bad", "é" * 60), (5, "x\r\ny", "é" * 60), (6, "", ""), (7, "http://c.d", "short"), (8, "http://c.d", "short")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'q' as digest", "true as shared")
    got = warc.capture_history(pages).collect()
    assert sorted((r.page_id or 0, r.record_type, r.refers_to or 0) for r in got) == [(0, "revisit", 1), (1, "response", 0), (2, "revisit", 1), (2, "revisit", 1), (3, "response", 0), (4, "response", 0), (5, "revisit", 4), (6, "response", 0), (7, "response", 0), (8, "response", 0)]
    assert {r.page_id: r.url for r in got if r.page_id} == {i: u for i, u, _ in rows if i}
    keys = [(r.url_key, r.stamp) for r in got]
    assert keys == sorted(keys)
    assert warc.capture_history(pages.limit(0)).count() == 0
