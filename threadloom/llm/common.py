"""Shared helpers of the training-data operators: table access and the shared folder."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession

#: Maximal runs of anything but the six ASCII white-space characters.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """URI of the folder that driver and executors share.

    It is the session's ``spark.checkpoint.dir``; where that is unset, a temporary folder
    serves a local master (tests), and a cluster gets an error: its executors would each
    write to a disk of their own.
    """
    sc = spark.sparkContext
    uri = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not uri:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        uri = "file://" + tempfile.mkdtemp(prefix="threadloom-")
        spark.conf.set("spark.checkpoint.dir", uri)
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(uri)
    return uri if "://" in uri else "file://" + uri


def fresh_dir(spark: SparkSession, tag: str) -> str:
    """A new, unused path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/threadloom/{tag}-{uuid.uuid4().hex}"


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a URI, usable in the driver and in Python workers."""
    return pafs.FileSystem.from_uri(uri)


def materialize(spark: SparkSession, df: DataFrame, tag: str, compression: str = "snappy") -> DataFrame:
    """Write a frame to the shared folder and reread it: a cut of lineage that outlives executors. ``discard`` removes it."""
    path = fresh_dir(spark, tag)
    df.write.option("compression", compression).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def discard(*written: DataFrame) -> None:
    """Remove what ``materialize`` wrote: for steps whose frames nothing reads any more."""
    for df in written:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.written_to)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def free_name(name: str, taken: list[str]) -> str:
    """The name, with underscores before it until no column has it (columns' case doesn't count)."""
    have = {c.lower() for c in taken}
    while name.lower() in have:
        name = f"_{name}"
    return name


def text_rows(batches: Iterator[pa.RecordBatch], columns: tuple[str, ...], rows: int = 512) -> Iterator[list[list]]:
    """Lists of the named columns, at most ``rows`` rows at a time, so that Python objects stay few."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            part = batch.slice(at, rows)
            yield [part.column(part.schema.get_field_index(c)).to_pylist() for c in columns]


def release(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of finished steps: it does so when their plans are collected as garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def tidy() -> None:
    """Give memory that a worker has freed back to the system; workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):
        ctypes.CDLL(None).malloc_trim(0)
