"""Shared pieces of the training-data operators: staged tables, bounded driver facts, table loading."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_root(spark: SparkSession) -> str:
    """Folder that every executor can reach: ``spark.checkpoint.dir`` of the session.

    Where it is unset the session must be a local one (tests); a private folder is made and configured then.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if root is None:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="tarnlake-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def new_dir(spark: SparkSession, name: str) -> str:
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


_open: ContextVar[list[list[str]]] = ContextVar("open_stages", default=[])


def stage(df: DataFrame, name: str, compression: str = "zstd", keep: bool = False) -> DataFrame:
    """Write ``df`` into the shared folder and read it back: lineage ends there, so a lost executor costs no recomputation.

    Within :func:`dropping` the folder goes at the block's end; ``keep``: at the end of the block around it, if there is one.
    """
    path = new_dir(df.sparkSession, name)
    df.write.option("compression", compression).parquet(path)
    blocks = _open.get()[: -1 if keep else None]
    if blocks:
        blocks[-1].append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def dropping(spark: SparkSession) -> Iterator[None]:
    """Tables staged in this block are deleted at its end, but for those to keep."""
    mine: list[str] = []
    before = _open.set([*_open.get(), mine])
    try:
        yield
    finally:
        _open.reset(before)
        for path in mine:
            drop_dir(spark, path)
        release(spark)


def drop_dir(spark: SparkSession, path: str) -> None:
    """Delete a staged folder that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def drop_stage(df: DataFrame) -> None:
    """Delete the files of a table made by :func:`stage`."""
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        drop_dir(df.sparkSession, path)


def release(spark: SparkSession) -> None:
    """Ask the driver to collect garbage, so that shuffle files of finished steps leave the executors' disks."""
    spark.sparkContext._jvm.System.gc()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_key(text: str | Column = "text") -> Column:
    """Content key that, with doc_id, names a row: rows alike in both are one document given twice."""
    return F.xxhash64(text)


def slots(spark: SparkSession) -> int:
    return max(1, spark.sparkContext.defaultParallelism)


def barrier(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns through a one-row generator, which the optimiser doesn't inline: each is evaluated once a row."""
    made = F.struct(*[c.alias(n) for n, c in columns.items()])
    return df.select("*", F.inline(F.array(made)))
