"""What the operators of this subpackage share: folders, staging, hold-out, hot keys."""

from __future__ import annotations

import atexit
import os
import uuid
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Blank bytes between words: space and the six ASCII controls of `[^\x20\x09-\x0D]+`.
WORD = r"[^\x20\x09-\x0D]+"

_written: list[tuple[SparkSession, str]] = []


def bounded_batches(spark: SparkSession) -> None:
    """Bound what one Arrow batch brings into a Python worker, whatever the texts' lengths.

    The settings are read when a plan runs, so they stay set for the session;
    they are the same for all operators, and what the session sets lower stays.
    """
    for key, most in (("maxRecordsPerBatch", 512), ("maxBytesPerBatch", 16 << 20)):
        now = spark.conf.get(f"spark.sql.execution.arrow.{key}", None)
        if now is None or not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(f"spark.sql.execution.arrow.{key}", str(most))
    root = str(Path(__file__).resolve().parents[2])
    if root not in os.environ.get("PYTHONPATH", "").split(os.pathsep):  # workers find the package where it isn't installed
        spark.sparkContext.environment.setdefault("PYTHONPATH", root)


def shared_dir(spark: SparkSession) -> str:
    """A folder that all executors see: spark.checkpoint.dir of the session; only where unset (tests), one in the warehouse."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(at or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/foliant-shared")
    return (at or spark.sparkContext.getCheckpointDir()).rstrip("/")


def partitions_for(df: DataFrame, each: int = 128 << 20) -> int:
    """Partitions for a shuffle of df: spark.sql.shuffle.partitions at least, else so many that one has about `each` bytes of what is read."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return least if size >= 1 << 60 else max(least, -(-size // each))  # an unknown size is given as a huge one


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; removed when the application ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def _clean() -> None:
    for spark, path in _written:
        try:
            remove(spark, path)
        except Exception:  # the JVM has ended: nothing can be removed through it
            return


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: a lost executor costs no recomputation, and lineage ends here."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def held_out(doc_id: str = "doc_id"):
    """True where crc32 of the id's text leaves 2 modulo 4; false for a null id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def hashed_share(column: str, salt: int = 0):
    """A value in [0, 1) that depends on the column's value only; nulls get 0."""
    return F.pmod(F.xxhash64(F.lit(salt), F.col(column)), F.lit(1 << 30)) / F.lit(float(1 << 30))


def join_groups(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int, hot_share: float = 0.001) -> DataFrame:
    """rows ⋈ groups on key, where one key may hold a third of all rows.

    Groups with at least hot_share of all rows number 1 / hot_share at most, so
    they are broadcast; all others meet in an ordinary shuffled join, in which
    no key holds more than that share. key must not be null.
    """
    least = max(2, int(total * hot_share))
    hot = F.broadcast(groups.where(F.col(size) >= least))
    usual = rows.join(hot.select(key), key, "left_anti").join(groups.where(F.col(size) < least), key)
    return usual.unionByName(rows.join(hot, key))


_caches: dict[str, Callable[[], None]] = {}


def keep_in_worker(name: str, clear: Callable[[], None]) -> None:
    """Register what an operator keeps in a Python worker between tasks; workers are shared by operators."""
    _caches[name] = clear


def release(but: str | None = None) -> None:
    """Give back what other operators have left in this worker."""
    import ctypes
    import gc

    for name in [n for n in _caches if n != but]:
        _caches.pop(name)()
        gc.collect()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (OSError, AttributeError):  # no such C library
            pass


def arrow_map(df: DataFrame, work: Callable[[Iterator], Iterable], schema: str, keeps: str | None = None) -> DataFrame:
    """mapInArrow over tables made of plain Python columns: work gets and yields dicts of lists or arrays. keeps: the cache that work uses."""
    from pyspark.sql.types import StructType
    from pyspark.sql.pandas.types import to_arrow_schema

    kind = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        import pyarrow as pa

        release(keeps)
        for out in work(batches):
            yield pa.RecordBatch.from_arrays([pa.array(out[f.name], type=f.type, from_pandas=False) for f in kind], schema=kind)

    return df.mapInArrow(run, schema)


def group_bounds(sorted_values: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal values, and the length at the end."""
    if not len(sorted_values):
        return np.zeros(1, dtype=np.int64)
    return np.concatenate(([0], np.flatnonzero(sorted_values[1:] != sorted_values[:-1]) + 1, [len(sorted_values)]))


def open_fs(uri: str):
    """(file system, path in it) of a shared folder, for tasks that write files in a format of their own."""
    from pyarrow import fs

    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[5:]
    return fs.FileSystem.from_uri(uri if ":/" in uri else "file://" + uri)


def write_whole(uri: str, name: str, parts: Iterable[bytes]) -> None:
    """Write a file under another name, then rename it: a task that is lost or runs twice leaves whole files only.

    The same name always has the same bytes, so a file that stands there already is left.
    """
    from pyarrow import fs

    system, folder = open_fs(uri)
    system.create_dir(folder, recursive=True)
    there = lambda: system.get_file_info(f"{folder}/{name}").type == fs.FileType.File
    if there():
        return
    began = f"{folder}/.{name}.{uuid.uuid4().hex}"
    with system.open_output_stream(began, compression=None) as out:
        for part in parts:
            out.write(part)
    try:
        system.move(began, f"{folder}/{name}")
    except OSError:  # some stores don't rename onto a file that another attempt has made meanwhile
        if not there():
            raise
        system.delete_file(began)
