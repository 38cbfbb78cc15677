"""Approximate nearest neighbours by inner product: stable projections, a kd-tree and a chi-square stopping test.

Vectors get one more component so that the largest inner product is the smallest distance. A Gaussian (2-stable)
projection to DIMS dimensions has, for a pair at distance d, a squared projected distance of d^2 times a chi-square with
DIMS degrees of freedom. A kd-tree over projections, its cuts fitted on a bounded sample, deals every row to a leaf, and
a leaf has a kd-tree of its own down to small cells. A query visits leaves in rounds of growing number by projected
distance, and within a leaf takes cell after cell: rows are verified on the original vectors until the next cell's projected
distance is one that a closer neighbour would exceed with the probability of the normal quantile SURE_Z only (1 in 20).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hearthmark.llm.common import partitions, stored

DIMS, SURE_Z, LEAF, SAMPLE, K = 24, 1.645, 4096, 16_384, 20
LEAVES = SAMPLE // 16  # at most: beyond LEAVES * LEAF rows a leaf is dealt out in chunks by hash
CELL, PACK, FIRST, MORE = 64, 8192, 2, 8  # rows of a cell, queries that share one copy of a leaf, leaves of a round and their growth


def chi_square(dims: int, z: float = SURE_Z) -> float:
    """The quantile of the chi-square distribution at normal quantile z (Wilson and Hilferty)."""
    return dims * (1 - 2 / (9 * dims) + z * (2 / (9 * dims)) ** 0.5) ** 3


def usable(vector: Column, width: int | None = None) -> Column:
    """Not null, no null or non-finite component, not zero, and of the given width."""
    value = vector.cast("array<double>")
    fine = F.forall(value, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(value, lambda x: x != 0)
    return F.coalesce(vector.isNotNull() & fine & ((F.size(vector) == width) if width else F.lit(True)), F.lit(False))


class Tree:
    """Cuts of a kd-tree over projected points: inner nodes in level order, leaves numbered from 0, a box for each leaf."""

    def __init__(self, points: np.ndarray, leaves: int):
        self.depth = max(0, int(np.ceil(np.log2(max(1, leaves)))))
        d = points.shape[1]
        self.axis, self.cut = np.zeros(2**self.depth - 1, int), np.zeros(2**self.depth - 1)
        self.low, self.high = np.full((2**self.depth, d), -np.inf), np.full((2**self.depth, d), np.inf)
        self._grow(points, 0, np.full(d, -np.inf), np.full(d, np.inf))

    def _grow(self, points, node, low, high):
        if node >= len(self.axis):
            self.low[node - len(self.axis)], self.high[node - len(self.axis)] = low, high
            return
        axis = int(points.var(axis=0).argmax()) if len(points) > 1 else node % len(low)
        cut = float(np.median(points[:, axis])) if len(points) else 0.0
        self.axis[node], self.cut[node] = axis, cut
        right = points[:, axis] > cut
        upper, lower = high.copy(), low.copy()
        upper[axis] = lower[axis] = cut
        self._grow(points[~right], 2 * node + 1, low, upper)
        self._grow(points[right], 2 * node + 2, lower, high)

    def leaf(self, points: np.ndarray) -> np.ndarray:
        node, rows = np.zeros(len(points), int), np.arange(len(points))
        for _ in range(self.depth):
            node = 2 * node + 1 + (points[rows, self.axis[node]] > self.cut[node])
        return node - len(self.axis)

    def distance2(self, point: np.ndarray) -> np.ndarray:
        """Squared projected distance of a point to every leaf's box."""
        gap = np.maximum(0, np.maximum(self.low - point, point - self.high))
        return (gap * gap).sum(axis=1)


class Leaf:
    """The rows of a leaf in the cells of a kd-tree over their projections."""

    def __init__(self, ids: list[np.ndarray], data: np.ndarray, projected: np.ndarray):
        tree = Tree(projected, -(-len(data) // CELL))
        cell = tree.leaf(projected)
        by = np.argsort(cell, kind="stable")
        self.ids, self.data, self.projected = [ids[i] for i in by.tolist()], data[by], projected[by]
        self.sizes = np.fromiter(map(len, self.ids), int, len(self.ids))
        self.starts = np.flatnonzero(np.diff(cell[by], prepend=-1))
        self.stops = np.append(self.starts[1:], len(by))
        self.low, self.high = (f.reduceat(self.projected, self.starts) for f in (np.minimum, np.maximum))

    def search(self, query: np.ndarray, target: np.ndarray, bound: float, top2: float, k: int, limit: float) -> tuple[np.ndarray, np.ndarray]:
        """The best k of the leaf's rows that score no less than bound (what other leaves have given): scores and ids.

        Cells are taken nearest first, a few and then twice as many, until the next one's squared projected distance
        exceeds limit times the k-th best squared distance so far.
        """
        gap = np.maximum(0, np.maximum(self.low - target, target - self.high))
        gap = (gap * gap).sum(axis=1)
        cells, done, step = np.argsort(gap, kind="stable"), 0, max(2, 2 * k // CELL)
        own, worst = float(query @ query) + top2, bound
        best_s, best_i = np.zeros(0), np.zeros(0, np.int64)
        while done < len(cells):
            reach = limit * max(0.0, own - 2 * worst)
            now = cells[done : done + step]
            now = now[gap[now] <= reach]
            if not len(now):
                break
            # first by fast products, cell by cell in place; what is near the best so far then in full precision
            starts, lengths = self.starts[now], self.stops[now] - self.starts[now]
            rough = np.concatenate([self.data[a:b] @ query for a, b in zip(starts.tolist(), self.stops[now].tolist(), strict=True)])
            least = max(worst, np.partition(rough, -k)[-k]) if len(rough) > k else worst
            near = np.flatnonzero(rough >= least - 1e-9 * own)
            ends = np.cumsum(lengths)
            at = np.searchsorted(ends, near, "right")
            rows = starts[at] + near - (ends - lengths)[at]
            scores = (self.data[rows] * query).sum(axis=1)
            rows, scores = rows[scores >= worst], scores[scores >= worst]
            if len(rows):
                best_s = np.concatenate([best_s, np.repeat(scores, self.sizes[rows])])
                best_i = np.concatenate([best_i, *(self.ids[r] for r in rows.tolist())])
                keep = np.lexsort((best_i, -best_s))[:k]
                best_s, best_i = best_s[keep], best_i[keep]
                if len(best_s) >= k:
                    worst = max(worst, best_s[-1])
            done, step = done + step, 2 * step
        return best_s, best_i


def nearest(vectors: DataFrame, queries: Column, *, id_col: str = "vec_id", vec_col: str = "embedding", k: int = K, leaf: int = LEAF, dims: int = DIMS, z: float = SURE_Z) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query row the k nearest other rows by inner product.

    Ties go to the smaller id; with fewer candidates all are returned. Vectors that are null, zero, or hold null or
    non-finite components take no part, nor do rows without an id and vectors of another width than the most common one
    (of equally common ones the smallest). Of rows with one id the vectors all take part, and none is its own neighbour.
    Equal vectors are one row of the index with its k + 1 smallest ids, which no result can exceed.
    """
    spark = vectors.sparkSession
    limit, n = chi_square(dims, z), partitions(spark)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"), F.coalesce(queries, F.lit(False)).alias("q")).filter(F.col("id").isNotNull() & usable(F.col("v")))
    widths = rows.groupBy(F.size("v").alias("w")).agg(F.count("*").alias("n"), F.max(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)).alias("top2")).orderBy(F.desc("n"), "w").limit(1).collect()
    out = "query_id long, rank int, vec_id long, score double"
    if not widths:
        return spark.createDataFrame([], out)
    width, count, top2 = widths[0]["w"], widths[0]["n"], widths[0]["top2"]
    rows = rows.filter(F.size("v") == width)
    share = max(1e-9, min(1.0, 2 * SAMPLE / count))
    sample = rows.select("v").sample(share, seed=11).limit(SAMPLE).collect() if share < 1 else rows.select("v").limit(SAMPLE).collect()  # a bounded sample, for the cuts alone
    planes = np.random.default_rng(5).standard_normal((width + 1, dims))

    def project(x: np.ndarray, data: bool) -> np.ndarray:
        more = np.sqrt(np.maximum(0, top2 - (x * x).sum(axis=1))) if data else np.zeros(len(x))
        return np.column_stack([x, more]) @ planes

    tree = Tree(project(np.array([r["v"] for r in sample], float).reshape(-1, width), True), min(LEAVES, -(-count // leaf)))
    leaves = 2**tree.depth
    chunks = max(1, -(-count // (4 * leaf * leaves)))

    def kept(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Equal vectors of a frame become one row with their k + 1 smallest ids."""
        for frame in frames:
            if not len(frame):
                continue
            x = np.stack(frame["v"]) + 0.0
            key = [r.tobytes() for r in x]
            ids: dict[bytes, set] = {}
            for b, own in zip(key, frame["ids"], strict=True):
                ids[b] = set(sorted(ids.get(b, set()).union(own.tolist()))[: k + 1])
            distinct = np.frombuffer(b"".join(ids), float).reshape(-1, width)
            yield pd.DataFrame({"leaf": tree.leaf(project(distinct, True)), "v": list(distinct), "ids": [np.array(sorted(i)) for i in ids.values()]})

    few = F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, k + 1)
    local = rows.select("v", F.array("id").alias("ids")).mapInPandas(kept, "leaf int, v array<double>, ids array<long>")
    halves = local.groupBy("leaf", "v", (F.spark_partition_id() % 64).alias("part")).agg(few.alias("ids"))
    part = F.col("leaf").cast("long") * chunks + F.pmod(F.xxhash64("v"), F.lit(chunks))
    index = stored(halves.groupBy("leaf", "v").agg(few.alias("ids")).select(part.alias("part"), "v", "ids"), "leaves")

    # equal query vectors are searched once
    asked = stored(rows.filter("q").select("id", (F.transform("v", lambda x: x + F.lit(0.0))).alias("v")), "queries")
    distinct = asked.groupBy("v").agg(F.min("id").alias("qid"))

    def next_leaves(first: int, stop: int):
        """The leaves of places first to stop - 1 by projected distance that are still within reach."""

        @F.pandas_udf("array<long>")
        def run(v: pd.Series, bound: pd.Series) -> pd.Series:
            out = []
            for x, least in zip(v, bound, strict=True):
                gap = tree.distance2(project(x[None], False)[0])
                near = np.argsort(gap, kind="stable")[first:stop]
                out.append(near[gap[near] <= limit * max(0.0, x @ x + top2 - 2 * least)])
            return pd.Series(out, index=v.index, dtype=object)

        return run

    def found(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows come by part of a leaf and pack, the part's vectors before the queries: the best k + 1 of each query there."""
        here, held, tree_of = None, [], None
        for frame in frames:
            turns = np.flatnonzero((frame[["part", "pack", "qid"]].ffill().diff().fillna(1) != 0)[["part", "pack"]].any(axis=1)) if len(frame) else []
            for a, b in zip(turns, [*turns[1:], len(frame)], strict=True):
                own = frame.iloc[a:b]
                if here != (own["part"].iloc[0], own["pack"].iloc[0]):
                    here, held, tree_of = (own["part"].iloc[0], own["pack"].iloc[0]), [], None
                data, queries_ = own[own["qid"].isna()], own[own["qid"].notna()]
                if len(data):
                    held.append(data[["v", "ids"]])
                if not len(queries_) or not held:
                    continue
                if tree_of is None:
                    all_rows = pd.concat(held)
                    x = np.stack(all_rows["v"])
                    tree_of = Leaf(list(all_rows["ids"]), x, project(x, True))
                q = np.stack(queries_["v"])
                got = [tree_of.search(*one, top2, k + 1, limit) for one in zip(q, project(q, False), queries_["bound"].tolist(), strict=True)]
                lengths = [len(s) for s, _ in got]
                yield pd.DataFrame({"qid": np.repeat(queries_["qid"].to_numpy().astype(np.int64), lengths), "vec_id": np.concatenate([i for _, i in got]), "score": np.concatenate([s for s, _ in got])})

    best = Window.partitionBy("qid").orderBy(F.desc("score"), "vec_id")
    top, done, stop = None, 0, min(FIRST, leaves)
    while done < leaves:
        open_ = distinct.withColumn("bound", F.lit(float("-inf")))
        if top is not None:
            bounds = top.groupBy("qid").agg(F.when(F.count("*") > k, F.min("score")).otherwise(float("-inf")).alias("bound"))
            open_ = distinct.join(bounds, "qid", "left").na.fill(float("-inf"), ["bound"])
        asks = open_.select("qid", "v", "bound", F.explode(next_leaves(done, stop)("v", "bound")).alias("leaf"))
        asks = stored(asks.select("qid", "v", "bound", F.explode(F.sequence(F.col("leaf") * chunks, F.col("leaf") * chunks + chunks - 1)).alias("part")), "asks")
        packs = asks.groupBy("part").agg(F.ceil(F.count("*") / PACK).cast("int").alias("packs"))  # copies of a part follow its queries
        data = index.join(packs, "part").select("part", F.explode(F.sequence(F.lit(0), F.col("packs") - 1)).alias("pack"), F.lit(None).cast("long").alias("qid"), "v", "ids", F.lit(0.0).alias("bound"))
        wanted = asks.join(packs, "part").select("part", F.pmod(F.xxhash64("qid"), F.col("packs")).cast("int").alias("pack"), "qid", "v", F.lit(None).cast("array<long>").alias("ids"), "bound")
        dealt = data.unionByName(wanted).repartition(n, "part", "pack").sortWithinPartitions("part", "pack", F.col("qid").asc_nulls_first())
        new = dealt.mapInPandas(found, "qid long, vec_id long, score double")
        both = new if top is None else top.select("qid", "vec_id", "score").unionByName(new)
        top = stored(both.withColumn("n", F.row_number().over(best)).filter(F.col("n") <= k + 1), "top")
        done, stop = stop, min(leaves, stop * MORE)
    lists = top.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("n", "vec_id", "score"))).alias("found"))
    named = asked.join(distinct, "v").select("id", "qid").join(lists, "qid")
    others = F.slice(F.filter("found", lambda x: x["vec_id"] != F.col("id")), 1, k)
    return named.select(F.col("id").alias("query_id"), F.posexplode(others).alias("at", "x")).select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), F.col("x.score").alias("score"))


def op10_neighbours(spark, sf_dir: str) -> DataFrame:
    """The 20 nearest by inner product of every twentieth vector among all others; unusable vectors take no part."""
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0)
