"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import ctypes
import shutil
import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Upper bound of the text bytes that a Python kernel turns into arrays at once.
CHUNK_BYTES = 1 << 19


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder; any path that Spark can open."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@lru_cache(maxsize=1)
def _own_folder() -> str:
    folder = tempfile.mkdtemp(prefix="tallyfield-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    Only where the setting is absent and all run in one process, as in tests, it is a temporary folder
    that goes with the process.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the cluster shares")
        folder = _own_folder()
    return folder.rstrip("/")


def written(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there, and a
    lost executor costs only the tasks that it ran."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def named(columns: list[str], within: str | None = None) -> list:
    """Columns of any name, dots and backticks too; of a struct column if ``within`` names one."""
    quoted = lambda c: "`" + c.replace("`", "``") + "`"
    return [F.col(f"{within}.{quoted(c)}" if within else quoted(c)).alias(c) for c in columns]


def text_key(doc_id: str = "doc_id", text: str = "text") -> list:
    """Two 64-bit hashes of a row's id and text, independent of how rows are partitioned.

    Rows that repeat both share a key; they also share every verdict on their bytes.
    """
    return [
        F.xxhash64(F.col(doc_id), F.col(text)).alias("k1"),
        F.xxhash64(F.col(text), F.col(doc_id), F.lit(1)).alias("k2"),
    ]


def text_chunks(texts, limit: int = CHUNK_BYTES):
    """Cut a list of byte strings into ranges (lo, hi) of at most ``limit`` bytes, or one text."""
    lo = size = 0
    for i, t in enumerate(texts):
        if i > lo and size + len(t) > limit:
            yield lo, i
            lo, size = i, 0
        size += len(t)
    if lo < len(texts):
        yield lo, len(texts)


@lru_cache(maxsize=1)
def _trimmer():
    try:
        return ctypes.CDLL("libc.so.6").malloc_trim
    except (OSError, AttributeError):  # another C library keeps its own counsel
        return None


def release_memory() -> None:
    """Hand memory that earlier work in this Python worker has freed back to the system."""
    if trim := _trimmer():
        trim(0)


def sliced(batches, rows: int = 256):
    """A kernel's Arrow batches in slices of few rows, so that few texts are Python objects at once."""
    release_memory()
    for batch in batches:
        for lo in range(0, batch.num_rows, rows):
            yield batch.slice(lo, rows)
    release_memory()
