"""Views that many queries share, written once a session to the shared folder and read from there."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_PATHS: dict[tuple, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir.

    Where it is unset, a local session takes a temporary folder; on a cluster, whose machines share no such folder, that
    is an error.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        where = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where


def _filesystem(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def _stamp(spark: SparkSession, path: str) -> tuple:
    """Names, sizes and times of the files of a table, so that a changed table is not taken for the one that was read."""
    at, fs = _filesystem(spark, path)
    return tuple((str(s.getPath()), s.getLen(), s.getModificationTime()) for s in fs.listStatus(at))


def size(spark: SparkSession, path: str) -> int:
    """The bytes of a table's files."""
    return sum(n for _, n, _ in _stamp(spark, path))


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def cleaned(spark: SparkSession) -> Iterator[None]:
    """Jobs whose shuffle files go once they have ended: what a step has written is read from there, and its shuffles would stay on
    disk beside it until the driver's garbage collection comes by."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


def view(spark: SparkSession, sf_dir: str, name: str, tables: list[str], build: Callable[..., DataFrame], first: Callable[[], DataFrame] | None = None) -> DataFrame:
    """build()'s rows, from a table that this session has written or else writes now. Where first is given, its rows are written before, are
    what build takes, and are removed once the view is written, so that the shuffles of both do not lie on disk together.

    A view over several joins is then planned, shuffled and computed once, however often queries take it, and later reads prune
    columns and push filters into it. It is written whole before it is read, so a lost executor costs its tasks only.
    """
    key = (spark.sparkContext.applicationId, sf_dir, name, tuple(_stamp(spark, f"{sf_dir}/{t}.parquet") for t in tables))
    if key not in _PATHS:
        path = f"{shared_dir(spark)}/views-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
        with cleaned(spark):
            if first:
                first().write.option("compression", "zstd").parquet(f"{path}-first")
            (build(spark.read.parquet(f"{path}-first")) if first else build()).write.option("compression", "zstd").parquet(path)
        if first:
            at, fs = _filesystem(spark, f"{path}-first")
            fs.delete(at, True)
        _PATHS[key] = path
    return spark.read.parquet(_PATHS[key])


def kept(df: DataFrame, name: str) -> DataFrame:
    """The rows of one query's step, written once, as later steps read them several times; release removes them with the views."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/views-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    with cleaned(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Removes the session's views; to be called once results that read them are written or collected."""
    at, fs = _filesystem(spark, f"{shared_dir(spark)}/views-{spark.sparkContext.applicationId}")
    fs.delete(at, True)
    for key in [k for k in _PATHS if k[0] == spark.sparkContext.applicationId]:
        del _PATHS[key]
