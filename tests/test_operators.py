import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliant.operators import fusion, imaging, metrics, models, pages, relational, validate
from foliant.plans import processors
from foliant.sources import files, tables
from foliant.streaming import lifecycle

ENGINES = "page_id int, engine_ord int, text string, confidence double"


@pytest.mark.parametrize(
    "method, rows, want",
    [
        ("best", [(0, "a", 0.5), (1, "bb", 0.5)], ("a", 0.5)),
        ("vote", [(0, "a", 0.9), (1, "bb", 0.1)], ("bb", 0.5)),
        ("weighted", [(0, "a", 0.0), (1, "bb", 0.0)], ("a", 0.0)),
        ("weighted", [(0, "a", 0.2), (1, "bb", 0.4)], ("bb", 0.3)),
        ("smart", [(0, "土地", 0.1), (1, "xx", 0.2)], ("土地", 0.1)),
        ("other", [(0, "", 0.0), (1, "", 0.0)], ("", 0.0)),
    ],
)
def test_fusion(spark, method, rows, want):
    r = fusion.fuse(spark.createDataFrame([(1, *x) for x in rows], ENGINES), method).first()
    assert (r.text, pytest.approx(r.confidence)) == want


@pytest.mark.parametrize("value, engine, want", [("0.5", "x", 0.5), ("high", "x", 0.0), ("95", "textract", 0.95), ("95", "x", 1.0), ("-1", "x", 0.0), (None, "x", 0.0), ("NaN", "x", 0.0)])
def test_standard_confidence(spark, value, engine, want):
    df = spark.createDataFrame([(value, engine)], "v string, e string")
    assert df.select(fusion.standard_confidence(F.col("v"), F.col("e"))).first()[0] == want


@pytest.mark.parametrize(
    "name, kind, size, error",
    [("a.pdf", "contract", 20 << 20, None), ("a.JPG", "transcript", 1, None), ("a.docx", "invoice", 1 << 30, "UNSUPPORTED_FILE_TYPE"), ("a", "contract", 1, "UNSUPPORTED_FILE_TYPE"), (None, None, None, "UNSUPPORTED_FILE_TYPE"), ("a.png", "invoice", 1 << 30, "UNSUPPORTED_DOCUMENT_TYPE"), ("a.png", "contract", (20 << 20) + 1, "FILE_TOO_LARGE")],
)
def test_upload(spark, name, kind, size, error):
    df = spark.createDataFrame([(name, kind, size)], "n string, k string, s long")
    assert df.select(validate.upload_error(F.col("n"), F.col("k"), F.col("s"))).first()[0] == error


def test_options():
    validate.PageOptions()
    for wrong in ({"quality": 101}, {"engines": ()}, {"fusion": "smart"}, {"dpi": 99}, {"hue": (0, 181)}):
        with pytest.raises(ValueError):
            validate.PageOptions(**wrong)


@pytest.mark.parametrize("answer, want", [('x ```json {"a": "1", "b": "null", "c": ""} ``` y', {"a": "1", "b": None, "c": None}), ('so {"a": 2}.', {"a": "2"}), ("none", None)])
def test_answers(spark, answer, want):
    got = spark.createDataFrame([(answer,)], "t string").select(models.parse_fields(F.col("t"))).first()[0]
    assert got == want or (want is None and not got)


def test_model_gate_and_failure(spark):
    seen = spark.createDataFrame([("a", 0.5), ("b", 0.9), ("c", None)], "text string, confidence double")
    gate = F.col("confidence") < 0.85
    got = {r.text: (r.corrected, r.used) for r in models.correct(seen, lambda p: [(x.rpartition("\n")[2] + "!", 1, 1, None) for x in p], gate).collect()}
    assert got == {"a": ("a!", True), "b": ("b", False), "c": ("c", False)}

    def broken(prompts):
        raise RuntimeError("no network")

    got = {r.text: (r.corrected, r.used, r.error) for r in models.correct(seen, broken, gate).collect()}
    assert got["a"] == ("a", False, "no network") and len(got) == 3
    refused = models.correct(seen, lambda p: [("I'm sorry", 1, 1, None) for _ in p], gate).where("text = 'a'").first()
    assert (refused.corrected, refused.used) == ("a", True)


def test_pages(spark):
    df = spark.createDataFrame([(1, 2, "b", None, "y"), (1, 1, "a", "x", None), (1, 3, "c", None, None)], "doc int, page int, t string, g string, h string")
    assert pages.with_headers(df, "doc", "page", "t").first().text == "--- Page 1/3 ---\na\n\n--- Page 2/3 ---\nb\n\n--- Page 3/3 ---\nc"
    assert tuple(pages.merged_groups(df, "doc", "page", ["g", "h"]).first()) == (1, "x", "y")


def test_retention_and_orphans(spark):
    now = datetime.datetime(2024, 6, 1)
    d = spark.createDataFrame([("a", "failed", now - datetime.timedelta(days=91)), ("b", "failed", now - datetime.timedelta(days=90)), ("c", None, None), ("d", "completed", now - datetime.timedelta(days=900))], "document_id string, status string, created_at timestamp_ntz")
    assert {r.document_id for r in relational.expire(d, F.lit(now).cast("timestamp_ntz")).collect()} == {"b", "c", "d"}
    c = spark.createDataFrame([("1", "a"), ("2", "zz"), ("3", None)], "id string, document_id string")
    assert {r.id for r in relational.without_orphans(c, d).collect()} == {"1", "3"}
    assert {r.id for r in relational.cascade(c, d.where("document_id = 'a'").select("document_id")).collect()} == {"2", "3"}


def test_usage_of_nothing(spark):
    e = spark.createDataFrame([], "total_pages int, llm_cost double")
    assert tuple(relational.usage(e).first()) == (0, 0, 0.0, "all_time")


def test_overlay(spark):
    df = spark.createDataFrame([({"a": "1", "status": "x"}, {"a": "2", "b": "3"})], "d map<string,string>, c map<string,string>")
    assert df.select(relational.overlay(F.col("d"), F.col("c"))).first()[0] == {"a": "2", "b": "3", "status": "active"}


def test_identity_risks(spark):
    df = spark.createDataFrame([("n", "A12", datetime.date(1890, 1, 1))], "name string, national_id string, birth_date date")
    r = df.select(relational.identity_risks(F.lit("2024-01-01").cast("date"))).first()[0]
    assert [(x.field, x.severity) for x in r] == [("national_id", "error"), ("birth_date", "warning")]


def test_ratio_is_the_library_one(spark):
    from difflib import SequenceMatcher

    rng = np.random.default_rng(1)
    a = "".join(rng.choice(list("abcdef"), 400))
    b = "".join(c if rng.random() > 1 / 7 else rng.choice(list("abcdef")) for c in a)
    df = spark.createDataFrame([(a, b), ("", ""), (None, "x")], "a string, b string")
    got = [r[0] for r in df.select(metrics.ratio(F.col("a"), F.col("b"))).collect()]
    assert got == [SequenceMatcher(None, a, b).ratio(), 1.0, None]


def test_images():
    rng = np.random.default_rng(0)
    noise = rng.integers(0, 256, (40, 30, 3), dtype=np.uint8)
    for method in imaging.BINARIZE:
        out = imaging.binarize(noise, method)
        assert out.shape == (40, 30) and set(np.unique(out)) <= {0, 255}
    with pytest.raises(ValueError):
        imaging.binarize(noise, "none")
    flat = np.full((100, 100, 3), 128, np.uint8)
    assert (imaging.sauvola(flat) == 255).all() and (imaging.denoise(flat, 4) == 128).all()
    red = flat.copy()
    red[20:40, 20:40] = (0, 0, 255)
    assert (imaging.remove_red(red)[22:38, 22:38] == 255).all() and (imaging.remove_red(flat) == flat).all()
    assert imaging.denoise(noise).std() < noise.std()
    assert imaging.adjust_resolution(flat[:, :50], 600).shape == (200, 100, 3) and imaging.scale_factor(1000, 1000) == 1
    g = imaging.grey(noise).astype(float)
    window = np.pad(g, 7, mode="reflect")
    m = np.array([[window[i : i + 15, j : j + 15].mean() for j in range(30)] for i in range(40)])
    s = np.array([[window[i : i + 15, j : j + 15].std() for j in range(30)] for i in range(40)])
    assert (imaging.sauvola(noise) == np.where(g > m * (1 + 0.5 * (s / 128 - 1)), 255, 0)).mean() > 0.999


def test_processors(spark):
    df = spark.createDataFrame([(1, 2, "甲方：乙公司", 0.9, None), (1, 1, "合約編號：A-1  ", 0.9, None), (1, 3, None, None, "unreadable")], "doc_id int, page_number int, raw_text string, confidence double, error string")
    out = processors.analyze(df, "contract")
    assert out.count() == 3
    doc = processors.document_context(out).first()
    assert doc.total_pages == 3 and doc.text.startswith("合約編號:A-1\n甲方:乙公司")
    with pytest.raises(ValueError):
        processors.get("invoice")


def test_files(spark, tmp_path):
    (tmp_path / "a.png").write_bytes(b"1234")
    (tmp_path / "b.pdf").write_bytes(b"p1|p2")
    (tmp_path / "c.pdf").write_bytes(b"bad")

    def render(content):
        if content == b"bad":
            raise ValueError("broken")
        return content.split(b"|")

    got = {(r.path.rsplit("/")[-1], r.page_number): (r.total_pages, r.error) for r in files.pages(files.read_files(spark, str(tmp_path)), render).collect()}
    assert got == {("a.png", 1): (1, None), ("b.pdf", 1): (2, None), ("b.pdf", 2): (2, None), ("c.pdf", 1): (0, "broken")}


def test_tables_round_trip(spark, tmp_path):
    row = spark.createDataFrame([("1", "upload", True)], "id string, endpoint string, llm_used boolean")
    tables.append(row, str(tmp_path), "api_usage_logs")
    tables.append(row, str(tmp_path), "api_usage_logs")
    assert tables.read(spark, str(tmp_path), "api_usage_logs").count() == 2


def test_stream_of_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_bytes(b"ok")
    (tmp_path / "in/b.txt").write_bytes(b"x")
    stream = files.stream_files(spark, str(tmp_path / "in")).select(F.element_at(F.split("path", "/"), -1).alias("document_id"), F.col("path").alias("file_name"), F.col("content").cast("string").alias("content"))
    work = lambda b: b.withColumns({"text": F.col("content"), "confidence": F.lit(1.0), "error": F.when(F.length("content") < 2, "too short")})
    for _ in range(2):  # a second trigger has nothing new
        lifecycle.run_stream(stream, work, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    got = {r.document_id: (r.status, r.error_message) for r in lifecycle.latest_states(spark, str(tmp_path / "out")).collect()}
    assert got == {"a.txt": ("completed", None), "b.txt": ("failed", "too short")}


def test_lines_and_valid_results(spark):
    lines = spark.createDataFrame([(1, 2, "b", 0.4), (1, 1, "a", 0.8)], "page_id int, ord int, text string, confidence double")
    assert tuple(fusion.line_results(lines).first()) == (1, "a\nb", pytest.approx(0.6))
    results = spark.createDataFrame([(1, 0, "x", 0.9, None), (1, 1, "yy", 0.95, "failed"), (2, 0, "z", 1.0, "failed")], ENGINES + ", error string")
    pages_ = spark.createDataFrame([(1,), (2,)], "page_id int")
    assert sorted(map(tuple, fusion.fuse_valid(pages_, results, "best").collect())) == [(1, "x", 0.9), (2, "", 0.0)]


def test_nested_and_records(spark):
    d = spark.createDataFrame([("a", "completed"), ("b", "failed")], "document_id string, status string")
    c = spark.createDataFrame([(str(i), "a", i) for i in range(12)], "id string, document_id string, created_at int")
    got = {r.document_id: [x.id for x in r.chats] for r in relational.nested(d, {"chats": c}).collect()}
    assert got == {"a": [str(i) for i in range(11, 1, -1)], "b": []}
    s = spark.createDataFrame([(None, None, None), ("a", "failed", "id_card"), ("a", "completed", "unknown"), ("a", "completed", "id_card")], "d string, s string, t string")
    assert [r[0] for r in s.select(relational.record_error(*map(F.col, "dst"))).collect()] == [404, 425, 400, None]


def test_model_steps(spark):
    with pytest.raises(ValueError):
        models.provider_options("other", "k")
    with pytest.raises(ValueError):
        models.provider_options("openai", None)
    assert models.provider_options("openai", "k")["model"] == "gpt-4o"
    a = spark.createDataFrame([('{"doc_type": "id_card", "confidence": "140"}',), ("?",)], "t string").select(models.parse_classification(F.col("t")).alias("c")).collect()
    assert [(r.c.doc_type, r.c.confidence) for r in a] == [("id_card", 100.0), ("unknown", 0.0)]
    df = spark.createDataFrame([("地號：O221-0000 \n所有權人：甲乙",), ("none",)], "text string")
    fixed = {r.corrected for r in models.correct_fields(df, lambda p: [("0221-0000" if "221" in x else x.rpartition("\n")[2], 1, 2, None) for x in p]).collect()}
    assert fixed == {"地號：0221-0000 \n所有權人：甲乙", "none"}
    n = models.stats(models.ask(df, "text", models.offline), "openai", "gpt-4o").first()
    assert n.llm_calls == 2 and n.tokens_used > 0 and n.estimated_cost > 0


def test_image_files():
    image = np.arange(300, dtype=np.uint8).reshape(10, 10, 3)
    assert imaging.png(image)[:4] == b"\x89PNG"
    tried = []
    encode = lambda x, q: (tried.append((x.shape[0], q)), bytes(x.size * q // 10))[1]
    assert len(imaging.compress_to_limit(image, 1200, encode)) <= 1200 and tried[0] == (10, 95) and tried[5][0] == 9
    assert imaging.smart_save(image, encode)[1] == "png" and imaging.smart_save(image, encode, 10)[1] == "jpg"
    assert imaging.at_least(image, 20).shape == (20, 20, 3) and imaging.enhance(image, 20).shape == (20, 20)


def test_each_prompt_is_asked_once(spark, tmp_path):
    seen = str(tmp_path / "asked")

    def provider(prompts):
        with open(seen, "a") as out:  # tasks run in other processes
            out.writelines(p.replace("\n", "|") + "\n" for p in prompts)
        return [(p.rpartition("\n")[2], 1, 1, None) for p in prompts]

    df = spark.createDataFrame([(1, "地號：O221-0000\n民國 99 年 1 月 2 日\n面積：12.5 平方公尺\n所有權人：甲乙"), (2, "面積：3 平方公尺"), (3, "none"), (4, None)], "id int, text string")
    models.correct_fields(df, provider).collect()
    asked = open(seen).read().splitlines()
    assert len(asked) == len(set(asked)) == 5
    open(seen, "w").close()
    got = {r.id: (r.corrected, r.used) for r in models.correct(df, provider, F.col("id").isin(1, 3)).collect()}
    assert len(open(seen).read().splitlines()) == 2 and got[3] == ("none", True) and got[4] == (None, False) and not got[2][1]


def test_failing_calls_are_repeated(spark, tmp_path):
    seen = str(tmp_path / "calls")

    def provider(prompts):
        with open(seen, "a") as out:
            out.write("x")
        raise RuntimeError("busy")

    df = spark.createDataFrame([("a",)], "text string").coalesce(1)
    assert models.ask(df, "text", provider, retries=2).first().answer.error == "busy" and open(seen).read() == "xxx"


def test_all_methods_at_once(spark):
    rows = [(1, 0, "a", 0.5), (1, 1, "bb", 0.5), (2, 0, "土地", 0.1), (2, 1, "xxx", 0.2), (3, 0, "p", 0.0), (3, 1, "qq", 0.0), (4, 0, "", 0.0), (5, 2, None, 0.3), (5, 3, "z", 0.3)]
    df = spark.createDataFrame(rows, ENGINES)
    every = {r.page_id: r for r in fusion.fuse_all(df).collect()}
    for method in fusion.METHODS:
        for r in fusion.fuse(df, method).collect():
            assert (every[r.page_id][method].text, pytest.approx(every[r.page_id][method].confidence)) == (r.text, r.confidence), (method, r)
    assert fusion.compare_methods(df.limit(0)).count() == 0 and sum(r.is_best for r in fusion.compare_methods(df).collect()) == 1


def test_engines(spark):
    pages_ = spark.createDataFrame([(1, b"ab"), (2, None)], "page_id int, image binary")

    def broken(images):
        raise RuntimeError("no licence")

    known = {"up": lambda images: [(x.decode().upper(), 0.9) for x in images], "broken": broken}
    got = sorted(tuple(r) for r in fusion.recognise(pages_, ["broken", "up"], known).collect())
    assert got == [(1, 0, "broken", "", 0.0, "no licence"), (1, 1, "up", "AB", 0.9, None), (2, 0, "broken", "", 0.0, "no image"), (2, 1, "up", "", 0.0, "no image")]
    with pytest.raises(ValueError):
        fusion.recognise(pages_, ["other"], known)


def test_red_and_sizes():
    one = lambda *bgr: np.full((9, 9, 3), bgr, np.uint8)
    for colour, red in (((0, 0, 255), True), ((60, 0, 255), True), ((0, 120, 255), True), ((0, 140, 255), False), ((220, 220, 255), True), ((230, 230, 255), False), ((0, 0, 29), False), ((255, 0, 0), False)):
        assert imaging.red_pixels(one(*colour)).all() == red, colour
    assert imaging.at_least(np.zeros((300, 3000), np.uint8)).shape == (1000, 10000)
    assert imaging.at_least(np.zeros((1000, 1000), np.uint8)).shape == (1000, 1000)
    flat = np.full((13, 7), 77, np.uint8)
    assert (imaging.resize(flat, 40, 31, imaging._lanczos, 3) == 77).all() and (imaging.shrink(flat, 5, 3) == 77).all()
    steps = np.arange(64, dtype=np.uint8).reshape(8, 8)
    assert (imaging.shrink(steps, 4, 4) == np.rint(steps.reshape(4, 2, 4, 2).mean(axis=(1, 3)))).all()
    tried = []
    imaging.compress_to_limit(np.zeros((10, 10), np.uint8), 0, lambda x, q: (tried.append((x.shape, q)), b"x")[1])
    assert tried[:6] == [((10, 10), q) for q in (95, 85, 75, 65, 55)] + [((9, 9), 50)] and tried[-1] == ((3, 3), 30) and len(tried) == 13


def test_diagnosis():
    page = np.full((200, 300), 255, np.uint8)
    for row in range(20, 180, 40):
        for x in range(10, 280, 30):
            page[row : row + 18, x : x + 12] = 0
            page[row + 6 : row + 12, x + 3 : x + 9] = 255  # a hole: its own edge lies inside
    got = imaging.diagnose(page)
    assert got["dpi"] == pytest.approx((300 / 210 + 200 / 297) * 25.4 / 2) and got["contrast"] == 255 and 18 <= got["text_height"] <= 20
    p = np.pad(page.astype(float), 1, mode="reflect")
    lap = [p[y - 1, x] + p[y + 1, x] + p[y, x - 1] + p[y, x + 1] - 4 * p[y, x] for y in range(1, 201) for x in range(1, 301)]
    assert got["sharpness"] == pytest.approx(np.var(lap))
    assert imaging.diagnose(np.full((1000, 1000), 9, np.uint8))["dpi"] == pytest.approx(103.2, abs=0.1) and imaging.text_height(np.zeros((5, 5), np.uint8)) is None


def test_labels():
    rng = np.random.default_rng(4)
    mask = rng.random((23, 31)) < 0.4
    got, seen = imaging._labels(mask), {}
    for y, x in zip(*np.nonzero(mask)):
        todo, part = [(y, x)], set()
        while todo:
            a = todo.pop()
            if a not in part:
                part.add(a)
                todo += [(a[0] + i, a[1] + j) for i in (-1, 0, 1) for j in (-1, 0, 1) if 0 <= a[0] + i < 23 and 0 <= a[1] + j < 31 and mask[a[0] + i, a[1] + j]]
        assert got[y, x] == min(a * 31 + b for a, b in part)
    assert (got[~mask] == -1).all() and not seen


def test_mean_and_gaussian_threshold_by_loops():
    rng = np.random.default_rng(5)
    image = rng.integers(0, 256, (30, 28), dtype=np.uint8)
    p = np.pad(image.astype(float), 12, mode="reflect")
    mean = np.array([[p[y : y + 25, x : x + 25].mean() for x in range(28)] for y in range(30)])
    assert (imaging.mean_threshold(image) == np.where(image > mean - 5, 255, 0)).all()
    k = np.exp(-((np.arange(25) - 12) ** 2) / (2 * (0.3 * 11 + 0.8) ** 2))
    k = np.outer(k, k) / k.sum() ** 2
    blurred = np.array([[(p[y : y + 25, x : x + 25] * k).sum() for x in range(28)] for y in range(30)])
    assert (imaging.gaussian_threshold(image) == np.where(image > blurred - 5, 255, 0)).all()


def test_equalised():
    rng = np.random.default_rng(6)
    x = rng.integers(100, 140, (64, 80), dtype=np.uint8)
    out = imaging.equalised(x)
    assert out.std() > 1.5 * x.std()
    counts = np.bincount(x[:8, :10].ravel(), minlength=256)  # the corner's own table holds up to the middle of its tile
    most = max(1, int(3 * 80 / 256))
    over = int(np.maximum(counts - most, 0).sum())
    counts = np.minimum(counts, most) + over // 256
    counts[np.arange(0, 256, max(1, 256 // (over % 256)))[: over % 256]] += 1
    table = np.rint(np.cumsum(counts) * 255 / 80)
    assert (out[:4, :5] == table[x[:4, :5]]).all()
    grey = np.repeat(rng.integers(0, 256, (32, 32, 1), dtype=np.uint8), 3, axis=2)
    assert np.ptp(imaging.more_contrast(grey).astype(int), axis=2).max() <= 1
    assert imaging.more_contrast(np.zeros((3, 5), np.uint8)).shape == (3, 5)


def test_configs(spark):
    pixels = bytes(range(60))
    df = spark.createDataFrame([(1, pixels, 6, 10, 1), (2, b"x", 6, 10, 1)], "page_id int, pixels binary, height int, width int, channels int")
    configs = {"plain": {"watermark": False, "target": None}, "mean": {"watermark": False, "method": "mean", "target": None}}
    got = {(r.page_id, r.config): (r.chars, r.keywords, r.error is None) for r in imaging.compare_configs(df, configs, lambda x: "地號" if x.max() == 255 else "abc", ("地號", "面積")).collect()}
    assert got == {(1, "plain"): (3, 0, True), (1, "mean"): (2, 1, True), (2, "plain"): (0, 0, False), (2, "mean"): (0, 0, False)}


def test_stored_and_fetched(spark, tmp_path):
    df = spark.createDataFrame([("a/1.bin", b"one"), ("a/2.bin", b""), (None, b"x"), ("b", None)], "path string, content binary")
    got = {r.path: (r.length, r.error is None) for r in files.store(df, str(tmp_path)).collect()}
    assert got["a/1.bin"] == (3, True) and got["a/2.bin"] == (0, True) and not got["b"][1]
    assert (tmp_path / "a/1.bin").read_bytes() == b"one"
    back = {r.path: (r.content and bytes(r.content), r.error is None) for r in files.fetch(df.select("path").where("path is not null"), f"file://{tmp_path}").collect()}
    assert back["a/1.bin"] == (b"one", True) and not back["b"][1]


def test_reports(spark, tmp_path):
    (tmp_path / "truth.json").write_text('{"file": "a",\n "full_text": "x"}')
    assert files.read_truth(spark, str(tmp_path / "truth.json")).first().full_text == "x"
    files.write_report(spark.createDataFrame([(1, "p")], "n int, s string"), str(tmp_path / "report"))
    assert spark.read.json(str(tmp_path / "report")).first().s == "p"
    files.write_comparison(spark.createDataFrame([("ab", "abc")], "original string, enhanced string"), str(tmp_path / "both"))
    assert [r.value for r in spark.read.text(str(tmp_path / "both")).collect()] == ["original (2):", "ab", "enhanced (3):", "abc"]
