"""Files as rows: reading, naming and placing them, and their pages."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BINARY_FILE = "path string, modificationTime timestamp, length long, content binary"


def read_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)


def stream_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    return spark.readStream.format("binaryFile").schema(BINARY_FILE).option("pathGlobFilter", pattern).load(path)


def stored_name(name: Column, key: Column) -> Column:
    """A unique name that keeps the last extension."""
    return F.concat_ws(".", key, F.element_at(F.split(name, r"\."), -1))


def stored_path(prefix: Column, name: Column) -> Column:
    return F.concat(F.lit("uploads/"), F.regexp_replace(prefix, "^uploads/", ""), F.lit("/"), name)


def object_url(bucket: str, key: Column, cdn: str | None = None, endpoint: str | None = None) -> Column:
    """By the content network if there is one, else by the endpoint, else by the bucket's own host."""
    if cdn:
        return F.concat(F.lit(cdn.rstrip("/") + "/"), key)
    if endpoint:
        return F.concat(F.lit(f"{endpoint.rstrip('/')}/{bucket}/"), key)
    return F.concat(F.lit(f"https://{bucket}.s3.amazonaws.com/"), key)


def object_key(url: Column, cdn: str | None = None) -> Column:
    """The key in an object's URL: what follows the content network's address, else the third slash."""
    plain = F.regexp_extract(url, r"^[^/]*//[^/]*/(.*)$", 1)
    if not cdn:
        return plain
    head = cdn.rstrip("/") + "/"
    return F.when(F.startswith(url, F.lit(head)), F.substring(url, F.lit(len(head) + 1), F.length(url))).otherwise(plain)


def size_mb(length: Column) -> Column:
    return F.coalesce(length / 1048576, F.lit(0.0))


def data_url(image: Column, mime: str = "image/png") -> Column:
    return F.concat(F.lit(f"data:{mime};base64,"), F.translate(F.base64(image), "\r\n", ""))  # on one line


def pages(files: DataFrame, render: Callable[[bytes], list[bytes]] | None = None) -> DataFrame:
    """(path, page_number, total_pages, image, error): images are one page; others are rendered by a function given by the caller.

    A file that can't be rendered keeps one row, with page 1, no image and the error.
    """
    image = F.lower("path").rlike(r"\.(png|jpe?g)$")
    single = files.where(image).select("path", F.lit(1).alias("page_number"), F.lit(1).alias("total_pages"), F.col("content").alias("image"), F.lit(None).cast("string").alias("error"))
    if render is None:
        return single

    def work(batches):
        import pyarrow as pa

        schema = pa.schema([("path", pa.string()), ("page_number", pa.int32()), ("total_pages", pa.int32()), ("image", pa.binary()), ("error", pa.string())])
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                try:
                    got = render(content)
                    rows = [(path, i, len(got), p, None) for i, p in enumerate(got, 1)]
                except Exception as failed:  # the caller's renderer
                    rows = [(path, 1, 0, None, str(failed)[:500])]
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows), schema)], schema=schema) if rows else pa.RecordBatch.from_pylist([], schema=schema)

    return single.unionByName(files.where(~image).select("path", "content").mapInArrow(work, single.schema))


def one_page(pages_: DataFrame, number: int) -> DataFrame:
    """That page of each file that has it."""
    return pages_.where((F.col("page_number") == number) & (F.lit(number).between(1, F.col("total_pages"))))


def read_truth(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("multiLine", True).json(path)


def write_report(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_comparison(df: DataFrame, path: str, original: str = "original", enhanced: str = "enhanced") -> None:
    """Lines with both texts, one above the other, and their lengths."""
    line = F.concat(F.lit("original ("), F.length(original).cast("string"), F.lit("):\n"), F.col(original), F.lit("\nenhanced ("), F.length(enhanced).cast("string"), F.lit("):\n"), F.col(enhanced))
    df.select(line.alias("value")).write.mode("overwrite").text(path)


def _place(uri: str):
    """(file system, path in it) of a folder: a local path, or the address of a store that pyarrow knows."""
    from pyarrow import fs

    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[5:]
    return fs.FileSystem.from_uri(uri if ":/" in uri else "file://" + uri)


def store(df: DataFrame, root: str, path: str = "path", content: str = "content") -> DataFrame:
    """Write each row's bytes to its path below root; the scheme of root tells the store. Gives path, length and error.

    Files come to stand under their names whole. The writing happens when the
    result is read, on the executors, and again if a task is repeated, with the
    same outcome.
    """

    def work(batches):
        import uuid

        import pyarrow as pa

        system, base = _place(root)
        for batch in batches:
            lengths, errors = [], []
            for name, body in zip(batch.column(path).to_pylist(), batch.column(content).to_pylist()):
                try:
                    at = f"{base.rstrip('/')}/{name}"
                    folder, _, last = at.rpartition("/")
                    system.create_dir(folder, recursive=True)
                    began = f"{folder}/.{last}.{uuid.uuid4().hex}"
                    with system.open_output_stream(began, compression=None) as out:
                        out.write(body)
                    system.move(began, at)
                    lengths.append(len(body))
                    errors.append(None)
                except (OSError, TypeError) as failed:  # the store's errors, and a null path or content
                    lengths.append(None)
                    errors.append(str(failed)[:500])
            yield pa.RecordBatch.from_arrays([batch.column(path), pa.array(lengths, pa.int64()), pa.array(errors, pa.string())], names=["path", "length", "error"])

    return df.select(F.col(path).alias(path), content).mapInArrow(work, "path string, length long, error string")


def fetch(df: DataFrame, root: str, path: str = "path") -> DataFrame:
    """Read the bytes of each row's path below root: path, content and error."""

    def work(batches):
        import pyarrow as pa

        system, base = _place(root)
        for batch in batches:
            for name in batch.column(path).to_pylist():  # a file at a time is held
                body, error = None, None
                try:
                    with system.open_input_stream(f"{base.rstrip('/')}/{name}", compression=None) as stream:
                        body = stream.read()
                except OSError as failed:
                    error = str(failed)[:500]
                yield pa.RecordBatch.from_arrays([pa.array([name], pa.string()), pa.array([body], pa.binary()), pa.array([error], pa.string())], names=["path", "content", "error"])

    return df.select(path).mapInArrow(work, "path string, content binary, error string")
