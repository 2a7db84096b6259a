"""Every query runs; those with SQL give its rows."""

import pytest

from foliant.catalog import FLAGSHIP, ORACLE_SQL, QUERIES
from tests.oracle import compare, connect


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, small, name):
    df = QUERIES[name](spark, small)
    if name in ORACLE_SQL:
        compare(df, connect(small), ORACLE_SQL[name])
    else:
        assert df.count() > 0


def test_entry_imports():
    import __spark_entry__ as entry

    assert FLAGSHIP in entry.queries() and set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", ["image_sauvola", "image_mean_threshold", "image_gaussian_threshold", "image_denoise", "image_watermark"])
def test_images_are_whole_documents(spark, tmp_path, name):
    from foliant.plans.queries import images

    texts = {1: None, 2: "", 3: "abc", 4: "é" * 10, 5: "x" * 421}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    for width, channels in ((20, 1), (10, 3)):
        row = width * channels
        for r in images(spark, str(tmp_path), width, channels).collect():
            raw = (texts[r.doc_id] or "").encode()
            assert r.height == max(1, -(-len(raw) // row)) and bytes(r.pixels) == raw.ljust(r.height * row, b"\0")
    assert sorted(r.doc_id for r in QUERIES[name](spark, str(tmp_path)).where("pixels_sha256 is not null").collect()) == [1, 2, 3, 4, 5]
