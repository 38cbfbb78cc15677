"""Shared pieces of the training-data operators: stored tables, range cuts and connected components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


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


def new_path(spark: SparkSession, name: str) -> str:
    """A new place in the session's own part of the shared folder."""
    return f"{shared_dir(spark)}/stored-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, bucket_by: str | None = None) -> DataFrame:
    """Write df once to the shared folder and return the table read back: cuts lineage and survives lost executors.

    With bucket_by the table is bucketed, so that grouping or joining by that column does not shuffle it again; df comes
    partitioned by it, or in few rows, as each task writes a file for each of its buckets.
    """
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    if bucket_by:
        table = f"stored_{uuid.uuid4().hex}"
        df.write.option("path", path).option("compression", "zstd").bucketBy(partitions(spark), bucket_by).saveAsTable(table)
        return spark.table(table)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(folder))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def drop(*tables: DataFrame) -> None:
    """Removes stored tables of which all that was made is stored itself."""
    for table in tables:
        for folder in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
            _delete(table.sparkSession, folder)


def release(spark: SparkSession) -> None:
    """Removes all that this session's operators have stored; to be called once their results have been read or written."""
    for table in spark.catalog.listTables():
        if table.name.startswith("stored_"):
            spark.sql(f"DROP TABLE IF EXISTS {table.name}")
    _delete(spark, f"{shared_dir(spark)}/stored-{spark.sparkContext.applicationId}".replace(" ", "%20"))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def common_width(rows: DataFrame, column: str) -> int:
    """The most common length of an array column, of equally common ones the smallest; 0 without rows."""
    first = rows.groupBy(F.size(column).alias("w")).count().orderBy(F.desc("count"), "w").first()
    return first["w"] if first else 0


def matrix(lists: pa.Array, width: int) -> np.ndarray:
    """Arrow lists of one width, without nulls, as the rows of a matrix."""
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def groups(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple[int, ...], pa.Table]]:
    """Runs of equal whole-number keys with their rows, across batches."""
    here, parts = None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        values = np.column_stack([batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in keys])
        starts = [0, *(np.flatnonzero((values[1:] != values[:-1]).any(axis=1)) + 1).tolist()]
        for a, b in zip(starts, [*starts[1:], batch.num_rows], strict=True):
            now = tuple(values[a].tolist())
            if now != here:
                if parts:
                    yield here, pa.Table.from_batches(parts)
                here, parts = now, []
            parts.append(batch.slice(a, b - a))
    if parts:
        yield here, pa.Table.from_batches(parts)


def held_out(doc_id: str = "doc_id") -> Column:
    """True for the fifth of rows that no model may learn from; a null id is never held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def range_bucket(df: DataFrame, column: str, n: int) -> Column:
    """A bucket 0..n-1 by ranges of a column (nulls in bucket 0); at most n approximate quantiles reach the driver."""
    cuts = df.agg(F.percentile_approx(column, [i / n for i in range(1, n)], 10_000)).first()[0] if n > 1 else None
    if not cuts:
        return F.lit(0)
    cuts = F.array(*map(F.lit, sorted(set(cuts))))
    return F.coalesce(F.size(F.filter(cuts, lambda c: c < F.col(column))), F.lit(0))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of the edges, root the smallest node reachable.

    Alternating large-star and small-star rounds; each round is written to the shared folder, and the count of
    changed edges is all that reaches the driver. An empty edge table gives an empty result.
    """
    both = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).filter("a <> b").distinct()
    now = stored(both.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    mark = None
    while True:
        # large star: each node links its larger neighbours to its smallest neighbour (itself included)
        pairs = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = pairs.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        big = pairs.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # small star: each node and its smaller neighbours link to the smallest of them
        small = big.groupBy("a").agg(F.min("b").alias("m"))
        kept = big.join(small, "a")
        new = kept.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        last, now = now, stored(new.unionByName(small.select("a", F.col("m").alias("b"))).filter("a <> b").distinct(), "links")
        drop(last)
        seen = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b") % 1_000_000_007).alias("h")).first()
        if mark == seen:
            break
        mark = seen
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
