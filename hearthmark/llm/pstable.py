"""Embedding near-duplicates by Euclidean p-stable hashing: quantised random projections, several tables, exact cosines.

For unit vectors a cosine is a distance, and a Gaussian (2-stable) projection moves two vectors apart in proportion to it. A table
has a number of such projections, each shifted at random and cut into intervals; vectors that share all intervals of one table
share its bucket and are compared exactly. The number of projections follows the number of vectors, so that a bucket holds
about MATES vectors that are there by chance; the number of tables follows from it, so that a pair at the least cosine
shares no bucket with probability MISS only, closer pairs far less often, at every size.

A pair that shares several buckets counts in the first of them alone, which each task tells from the vectors themselves:
no pair is ever written. Buckets of more than BLOCK vectors are dealt out in pairs of blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, erf, exp, log, pi, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearthmark.llm.common import components, groups, matrix, partitions, stored
from hearthmark.llm.neighbours import usable
from hearthmark.llm.simhash import mixed, unite

LEAST, MISS, MATES = 0.9, 1e-4, 256
STEP = 2.0  # length of an interval: the exponent of the cost is least near it
BLOCK = 2048
FINE = 1e-9  # cosines so near LEAST are computed once more, term by term


def same_interval(distance: float, step: float = STEP) -> float:
    """The chance that one projection puts two vectors at this distance into the same interval (Datar and others)."""
    r = step / distance
    return erf(r / sqrt(2)) - 2 / (sqrt(2 * pi) * r) * (1 - exp(-r * r / 2))


def sizes(n: int, least: float = LEAST, mates: int = MATES, miss: float = MISS) -> tuple[int, int]:
    """(tables, projections of a table) for n vectors; unrelated vectors are at a right angle."""
    k = max(1, ceil(log(max(1, n / mates)) / -log(same_interval(sqrt(2)))))
    return ceil(log(miss) / log(1 - same_interval(sqrt(2 - 2 * least)) ** k)), k


def units(x: np.ndarray) -> np.ndarray:
    x = x / np.exp2(np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])  # by a power of two, exact: squares stay in range
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


class Hashes:
    """Bucket keys of unit vectors in all tables.

    Vectors and projections are rounded to whole multiples of a power of two, so that products and their sums are exact whatever
    the order of summation: the same vector has the same keys in every task and on every machine.
    """

    def __init__(self, width: int, tables: int, k: int):
        rng = np.random.default_rng([3, width])
        self.tables, self.k = tables, k
        self.planes = np.rint(rng.standard_normal((width, tables * k)) * 2**12)
        self.shift = np.rint(rng.random(tables * k) * STEP * 2**32).astype(np.int64)

    def keys(self, unit: np.ndarray, tables: int | None = None) -> np.ndarray:
        """A row of keys for each vector, for the first so many tables."""
        tables = self.tables if tables is None else tables
        m = tables * self.k
        at = (np.rint(unit * 2**20) @ self.planes[:, :m]).astype(np.int64) + self.shift[:m]
        cell = (at // int(STEP * 2**32)).view(np.uint64).reshape(len(unit), tables, self.k)
        key = np.broadcast_to(np.arange(tables, dtype=np.uint64), (len(unit), tables))
        for i in range(self.k):
            key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + cell[:, :, i])
        return key.view(np.int64)


def close_pairs(x: np.ndarray, unit: np.ndarray, left: np.ndarray, right: np.ndarray, least: float, chunk: int = 512) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (one of left, one of right; each pair once where both are the same rows) of a cosine of at least least."""
    same = left is right
    for start in range(0, len(left), chunk):
        own = left[start : start + chunk]
        cosine = unit[own] @ unit[right].T
        if same:
            cosine[np.arange(len(right)) <= np.arange(start, start + len(own))[:, None]] = -2
        i, j = np.nonzero(cosine >= least - FINE)
        value, a, b = cosine[i, j], own[i], right[j]
        edge = np.flatnonzero(value < least + FINE)
        if len(edge):
            p, q = x[a[edge]], x[b[edge]]
            value[edge] = (p * q).sum(axis=1) / (np.sqrt((p * p).sum(axis=1)) * np.sqrt((q * q).sum(axis=1)))
        yield a[value >= least], b[value >= least]


def _links(tables: int, k: int, least: float):
    """Sorted cells of buckets to (a, null, n), n vectors linked with a here first, and (a, b, 0), a spanning forest of the links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes: dict[int, Hashes] = {}
        for (width, table, _, low, high), rows in groups(batches, ["width", "tab", "key", "low", "high"]):
            if rows.num_rows < 2:
                continue
            node, many, own = (rows.column(c).to_numpy() for c in ("node", "many", "own"))
            x = matrix(rows.column("v").combine_chunks(), width).astype(float)
            x = x / np.exp2(np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])
            unit = units(x)
            left = np.flatnonzero(own == low)
            right = left if low == high else np.flatnonzero(own == high)
            label, n, keys = np.arange(len(node)), np.zeros(len(node), np.int64), None
            for a, b in close_pairs(x, unit, left, right, least):
                if not len(a):
                    continue
                unite(label, a, b)
                if keys is None and table:
                    if width not in hashes:
                        hashes[width] = Hashes(width, tables, k)
                    keys = hashes[width].keys(unit, table)
                for s in range(0, len(a), 65_536):
                    p, q = a[s : s + 65_536], b[s : s + 65_536]
                    if table:
                        first = ~(keys[p] == keys[q]).any(axis=1)
                        p, q = p[first], q[first]
                    np.add.at(n, p, many[q])
                    np.add.at(n, q, many[p])
            counted, tied = np.flatnonzero(n), np.flatnonzero(label != np.arange(len(label)))
            if len(counted) or len(tied):
                roots = pa.concat_arrays([pa.nulls(len(counted), pa.int64()), pa.array(node[label[tied]])])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([node[counted], node[tied]])), roots, pa.array(np.concatenate([n[counted], np.zeros(len(tied), np.int64)]))], ["a", "b", "n"])

    return run


def near_duplicates(vectors: DataFrame, *, id_col: str = "vec_id", vec_col: str = "embedding", least: float = LEAST, miss: float = MISS) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row: links are cosines of at least least.

    Vectors that are null, zero, or hold null or non-finite components link with nothing, nor do vectors of different width. Equal
    vectors are hashed once and link with each other, repeated rows too. Rows without an id belong to their component and never
    name it; one of such rows alone has a null component_id, and its rows are kept. No rows give no rows.
    """
    spark = vectors.sparkSession
    kind = "array<float>" if dict(vectors.dtypes)[vec_col] == "array<float>" else "array<double>"
    v = F.col(vec_col).cast(kind)
    zero = F.lit(0.0).cast(kind[6:-1])
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.when(usable(v), F.transform(v, lambda c: c + zero)).alias("v"))
    once = rows.filter(F.col("v").isNotNull()).groupBy("v").agg(F.min("vec_id").alias("least"), F.count("*").alias("many"))
    plain = stored(once.withColumn("node", F.monotonically_increasing_id()).withColumn("width", F.size("v")), "distinct")
    tables, k = sizes(plain.count(), least, miss=miss)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[int, Hashes] = {}
        for (width,), part in groups(batches, ["width"]):
            for piece in part.to_batches(max_chunksize=4096):
                if width not in made:
                    made[width] = Hashes(width, tables, k)
                keys = made[width].keys(units(matrix(piece.column("v"), width).astype(float)))
                lists = pa.FixedSizeListArray.from_arrays(pa.array(keys.ravel()), tables).cast(pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([piece.column("node"), piece.column("many"), piece.column("v"), piece.column("width"), lists], ["node", "many", "v", "width", "keys"])

    nodes = stored(plain.select("node", "many", "v", "width").mapInArrow(hashed, f"node long, many long, v {kind}, width int, keys array<long>"), "hashed")
    bucket = ["width", "tab", "key"]
    full = nodes.select("width", F.posexplode("keys").alias("tab", "key")).groupBy(*bucket).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")).filter("blocks > 1")
    split = nodes.select("node", "width", F.posexplode("keys").alias("tab", "key")).join(full, bucket).groupBy("node").agg(F.map_from_entries(F.collect_list(F.struct("tab", "blocks"))).alias("split"))
    dealt = nodes.join(split, "node", "left").select("node", "many", "v", "width", "split", F.posexplode("keys").alias("tab", "key"))
    dealt = dealt.withColumn("blocks", F.coalesce(F.try_element_at("split", "tab"), F.lit(1))).withColumn("own", F.pmod(F.xxhash64("node", "tab"), "blocks").cast("int"))
    dealt = dealt.select("node", "many", "v", *bucket, "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    cell = [*bucket, "low", "high"]
    dealt = dealt.select("node", "many", "v", *bucket, "own", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"))
    dealt = dealt.repartition(4 * partitions(spark), *cell).sortWithinPartitions(*cell)
    found = stored(dealt.mapInArrow(_links(tables, k, least), "a long, b long, n long"), "found")
    links = found.filter("b IS NULL").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n"))
    tied = components(found.filter("b IS NOT NULL").select("a", "b"))
    named = plain.select("node", "v", "least", "many").join(tied, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least_id = named.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = named.join(least_id, "root").join(links, "node", "left").select("v", "component_id", (F.col("many") - 1 + F.coalesce("n", F.lit(0))).alias("links"), F.lit(True).alias("known"))
    out = rows.join(classes, "v", "left")
    component = F.when(F.col("known"), F.col("component_id")).otherwise(F.col("vec_id"))
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))


def op12_embedding_dups(spark, sf_dir: str) -> DataFrame:
    """Every vector's number of links at a cosine of 0.9 or more, and the smallest id that links reach."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
