"""What several corpus operators share: the shared folder, tables in it, words."""

from __future__ import annotations

import os
import sys
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, and a word: the longest run of anything else.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as a URI without a trailing slash.

    It is ``spark.checkpoint.dir`` of the session; only where that is unset (a
    session made by hand, in tests) a folder under the warehouse takes its place.
    """
    conf = spark.sparkContext.getConf()
    path = conf.get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    path = (path or f"{spark.conf.get('spark.sql.warehouse.dir')}/_shared").rstrip("/")
    if "://" not in path:
        path = "file://" + path.removeprefix("file:")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(path)
    return path


def new_folder(spark: SparkSession, label: str) -> str:
    """A fresh name in the shared folder; nothing is created yet."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written as Parquet into the shared folder and read back.

    Cuts the lineage: a lost executor costs no more than the tasks that read the table.
    The shuffle files of the job that wrote it go at its end, not when the driver happens to
    collect its garbage.
    """
    spark, path = df.sparkSession, new_folder(df.sparkSession, label)
    before = spark.conf.get(SHUFFLE_CLEANUP, "false")
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def gone(*tables: DataFrame) -> None:
    """Deletes tables made by :func:`stored` that nothing reads any more."""
    for table in tables:
        if files := table.inputFiles():
            dropped(table.sparkSession, os.path.dirname(files[0]))


def dropped(spark: SparkSession, path: str) -> None:
    """Deletes a table or folder of the shared folder that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def words_of(text: Column) -> Column:
    """The words of a text as an array; null counts as no words."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE + "+"), "")


def text_crc(text: Column) -> Column:
    """Unsigned CRC-32 of the UTF-8 bytes; null counts as empty."""
    return F.crc32(F.encode(F.coalesce(text, F.lit("")), "UTF-8")).cast("long")


def process_cache(name: str, make=dict):
    """A value that lives as long as the Python worker, made at its first use."""
    kept = sys.__dict__.setdefault("_loomgraph_cache", {})
    if name not in kept:
        kept[name] = make()
    return kept[name]


def let_go(name: str) -> None:
    """Drops a value of :func:`process_cache` when the worker turns to another operator."""
    sys.__dict__.get("_loomgraph_cache", {}).pop(name, None)


def trimmed() -> None:
    """Gives memory that this worker no longer uses back to the system, where that is possible."""
    import ctypes

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def put_file(folder: str, name: str, data: bytes) -> str:
    """Writes a file into a folder given as a URI, in one step as others see it.

    A task that runs twice writes the same name with the same content.
    """
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(folder)
    store.create_dir(path, recursive=True)
    part = f"{path}/.{name}.{uuid.uuid4().hex}"
    with store.open_output_stream(part) as out:
        out.write(data)
    store.move(part, f"{path}/{name}")
    return f"{folder}/{name}"


def get_file(uri: str) -> bytes:
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    with store.open_input_file(path) as source:
        return source.read()
