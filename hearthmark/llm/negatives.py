"""Hard negatives by a secondary-sort shuffle: pair scores in (anchor, falling score, id) order, read by a streaming iterator.

Anchors meet all rows in blocks. A first pass finds each anchor's positives; a second scores the blocks again and keeps, of each block,
what can be among the first negatives of a positive's window. Both kinds of pairs are then dealt out by anchor and sorted within
partitions by falling score; the iterator opens a window at each positive, gives the negatives that fall into it their
rank, and holds no more of an anchor than its open windows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearthmark.llm.common import common_width, groups, matrix, partitions, stored
from hearthmark.llm.whitening import whole

POSITIVES, NEGATIVES = 5, 10
LOW, HIGH, UNIT = 30, 90, 100  # a negative's score is from LOW to HIGH hundredths of the positive's
ANCHORS, ROWS = 512, 8192  # in a block
PAIR = "anchor_id long, score long, kind int, id long"  # kind 0: a positive, 1: a negative


def first(scores: np.ndarray, ids: np.ndarray, allowed: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each row of scores the columns of its first k allowed ones, by falling score and then by id."""
    n, least = scores.shape[1], np.iinfo(np.int64).min
    held = np.where(allowed, scores, least)
    kth = np.partition(held, n - k, axis=1)[:, n - k] if n > k else np.full(len(held), least)
    for row in np.flatnonzero(allowed.any(axis=1)):
        at = np.flatnonzero(allowed[row] & (held[row] >= kth[row]))
        yield row, at[np.lexsort((ids[at], -held[row, at]))[:k]]


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of whole numbers: by floating point where no sum exceeds its whole range."""
    most = int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0)) * max(1, a.shape[1])
    return (a.astype(float) @ b.astype(float).T).astype(np.int64) if most < 2**53 else a @ b.T


def _scored(width: int, pick):
    """Sorted blocks (anchors first, then rows) to pairs, pick(anchors' table, x of both, batch) giving those of a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, held, anchors = None, [], None
        for batch in batches:
            for cell, part in groups([batch], ["q", "r", "is_row"]):
                if cell[:2] != here:
                    here, held, anchors = cell[:2], [], None
                if not cell[2]:
                    held.append(part)
                    continue
                if not held:
                    continue
                if anchors is None:
                    anchors = pa.concat_tables(held).combine_chunks()
                    mine = matrix(anchors.column("x").combine_chunks(), width)
                part = part.combine_chunks()
                scores = products(mine, matrix(part.column("x").combine_chunks(), width))
                found = list(pick(anchors, part, scores))
                if found:
                    a, score, kind, ids = (np.concatenate(c) for c in zip(*found, strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(score), pa.array(kind.astype(np.int32)), pa.array(ids)], ["anchor_id", "score", "kind", "id"])

    return run


def _pairs(anchors: pa.Table, part: pa.Table, same: bool):
    ids, own = part.column("id").to_numpy(), anchors.column("id").to_numpy()
    alike = anchors.column("label").to_numpy()[:, None] == part.column("label").to_numpy()
    return ids, own, (alike & (own[:, None] != ids)) if same else ~alike


def best_positives(anchors: pa.Table, part: pa.Table, scores: np.ndarray):
    ids, own, allowed = _pairs(anchors, part, True)
    for row, at in first(scores, ids, allowed, POSITIVES):
        yield np.full(len(at), own[row]), scores[row, at], np.zeros(len(at), int), ids[at]


def window_negatives(anchors: pa.Table, part: pa.Table, scores: np.ndarray):
    """Of a block's rows the first NEGATIVES in each of an anchor's windows, each row once."""
    ids, own, other = _pairs(anchors, part, False)
    windows = anchors.column("windows").to_pylist()
    keep = [[] for _ in own]
    for place in range(POSITIVES):
        goal = np.array([w[place] if len(w) > place else 0 for w in windows])[:, None]
        there = np.array([len(w) > place for w in windows])[:, None]
        allowed = other & there & (LOW * goal <= UNIT * scores) & (UNIT * scores <= HIGH * goal)
        for row, at in first(scores, ids, allowed, NEGATIVES):
            keep[row].append(at)
    for row, found in enumerate(keep):
        if found:
            at = np.unique(np.concatenate(found))
            yield np.full(len(at), own[row]), scores[row, at], np.ones(len(at), int), ids[at]


def by_anchor(pairs: DataFrame) -> DataFrame:
    """Dealt out by anchor and sorted within partitions by falling score; of equal scores positives come first, then smaller ids."""
    return pairs.repartition(partitions(pairs.sparkSession), "anchor_id").sortWithinPartitions("anchor_id", F.desc("score"), "kind", "id")


def first_positives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first POSITIVES of each anchor of a sorted stream."""
    here, done = None, 0
    for batch in batches:
        keep = []
        for anchor in batch.column("anchor_id").to_pylist():
            here, done = (anchor, done + 1) if anchor == here else (anchor, 1)
            keep.append(done <= POSITIVES)
        yield batch.filter(pa.array(keep, pa.bool_()))


def negatives_in_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Opens a window at each positive of a sorted stream and emits the negatives that fall into it, NEGATIVES at most."""
    here, open_ = None, []
    for batch in batches:
        out = []
        for anchor, score, kind, row in zip(*(batch.column(c).to_pylist() for c in ("anchor_id", "score", "kind", "id")), strict=True):
            if anchor != here:
                here, open_ = anchor, []
            if kind == 0:
                open_.append([row, score, 0])
                continue
            open_ = [w for w in open_ if w[2] < NEGATIVES and LOW * w[1] <= UNIT * score]
            for window in open_:
                if UNIT * score <= HIGH * window[1]:
                    window[2] += 1
                    out.append((anchor, window[0], window[2], row, window[1], score))
        columns = list(zip(*out, strict=True)) if out else [[]] * 6
        types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"])


def mine(vectors: DataFrame, anchors: Column, *, id_col: str = "vec_id", vec_col: str = "embedding", label: Column | None = None) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): each positive's hard negatives.

    Entries are floor(256*c) and scores whole. No part take rows without id or label, with a null or empty vector or one that holds null or
    non-finite components, and vectors of another width than the most common one. Of rows with one id the one of least label
    and vector counts. An anchor without a row of its label, and a positive of negative score, give nothing.
    """
    spark = vectors.sparkSession
    label = F.col("label") if label is None else label
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"), whole(F.col(vec_col)).alias("x"), F.coalesce(anchors, F.lit(False)).alias("asks"))
    rows = rows.filter(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("x").isNotNull() & (F.size("x") > 0))
    out = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    width = common_width(rows, "x")
    if not width:
        return spark.createDataFrame([], out)
    rows = rows.filter(F.size("x") == width).groupBy("id").agg(F.min(F.struct("label", "x", "asks")).alias("r")).select("id", "r.*")
    rows = stored(rows, "rows")
    asked = rows.filter("asks").select("id", "label", "x")
    counts = rows.agg(F.count("*").alias("n"), F.count_if("asks").alias("asks")).first()
    q, r = max(1, -(-counts["asks"] // ANCHORS)), max(1, -(-counts["n"] // ROWS))

    def met(asking: DataFrame, pick) -> DataFrame:
        """Every block of anchors with every block of rows, scored and picked from."""
        block = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
        left = asking.withColumn("q", block(q)).withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(r - 1)))).withColumn("is_row", F.lit(0))
        right = rows.select("id", "label", "x", F.lit(None).cast("array<long>").alias("windows")).withColumn("r", block(r)).withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(q - 1)))).withColumn("is_row", F.lit(1))
        dealt = left.unionByName(right).repartition(max(partitions(spark), min(q * r, 8 * partitions(spark))), "q", "r").sortWithinPartitions("q", "r", "is_row")
        return dealt.mapInArrow(_scored(width, pick), PAIR)

    near = by_anchor(met(asked.withColumn("windows", F.lit(None).cast("array<long>")), best_positives))
    positives = stored(near.mapInArrow(first_positives, PAIR), "positives")
    windows = positives.groupBy(F.col("anchor_id").alias("id")).agg(F.collect_list("score").alias("windows"))  # POSITIVES an anchor at most
    pairs = met(asked.join(windows, "id"), window_negatives).unionByName(positives)
    return by_anchor(pairs).mapInArrow(negatives_in_windows, out)


def op13_hard_negatives(spark, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth vector; every seventh vector's label is moved on by one first."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 100 == 0, label=label)
