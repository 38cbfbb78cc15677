"""Mixing sources to target weights along a time-varying curriculum, in DataFrame operations alone.

Every source has a weight schedule over training time 0 to 1; its cumulative demand for tokens is the schedule's integral
scaled to the source's target. A document's place in its source's stream is a cumulative token count, and the inverse of
the demand gives the training position, by which documents are range-sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hearthmark.llm.common import stored

WEIGHTS, BUDGET, REPEATS = (5.0, 2.0, 1.0), 1.5, 2.0
BUCKETS = 256
WORD = r"[^\x20\x09-\x0D]+"


def place_key(id_col: str = "doc_id") -> Column:
    """A fixed pseudo-random order of documents."""
    return F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary"))


def targets(sizes: DataFrame, *, weights: tuple[float, ...] = WEIGHTS, budget: float = BUDGET, repeats: float = REPEATS) -> DataFrame:
    """Adds to one row a source (source, source_size) its rank, weight and target.

    Weights repeat over the sources by code point, null last. Targets share budget times all sizes by weight and stop at
    repeats times the source's size; the rest is shared by weight again. The final level is found in one pass: sources
    ordered by the level at which they stop, with running sums of caps and of the weights still open.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    rows = sizes.withColumn("rank", F.row_number().over(order) - 1).withColumn("weight", weight)
    rows = rows.withColumn("cap", repeats * F.col("source_size")).withColumn("stop", F.col("cap") / F.col("weight"))
    by_stop = Window.orderBy("stop", "rank")
    before = by_stop.rowsBetween(Window.unboundedPreceding, -1)
    after = by_stop.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    every = Window.partitionBy(F.lit(0))
    rows = rows.withColumn("level", (budget * F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after))
    level = F.min(F.when(F.col("level") <= F.col("stop"), F.struct("stop", "rank", "level"))).over(every)["level"]
    return rows.withColumn("target", F.least(F.col("cap"), F.coalesce(level, F.lit(float("inf"))) * F.col("weight"))).select("source", "source_size", "rank", "weight", "target")


def slope(rank: Column) -> Column:
    """The default schedule: a source's share falls, stays or rises over training, by its rank; its integral is its weight."""
    return F.element_at(F.array(F.lit(-0.5), F.lit(0.0), F.lit(0.5)), (rank % 3 + 1).cast("int"))


def invert(share: Column, tilt: Column) -> Column:
    """The time at which a schedule 1 + tilt (2t - 1) has spent a share of its integral t + tilt (t^2 - t)."""
    root = F.sqrt(F.greatest(F.lit(0.0), (1 - tilt) * (1 - tilt) + 4 * tilt * share))
    return F.when(tilt == 0, share).otherwise((root - (1 - tilt)) / (2 * tilt))


def assign(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", keep: tuple[str, ...] = (), **mix) -> DataFrame:
    """Every document with size, source_size, target, taken, copies and its training positions.

    A source's stream is its documents in a fixed pseudo-random order, again and again; the mix takes words from its
    start until the target is met, so one document of a source at most is taken in part. copies is taken over size
    rounded to whole documents. Ties of the order fall to the id; repeated rows are documents of their own. A null text
    has size 0 and takes nothing; a null source is a source of its own. No rows give no rows.

    Running sums are taken in two steps, over buckets of a source and within a bucket, so that a source of a third of all
    rows is spread over BUCKETS groups.
    """
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source_key"), F.coalesce(F.concat(F.lit("="), source_col), F.lit("")).alias("part"), size.alias("size"), place_key(id_col).alias("place"), *(F.col(c).alias(f"kept_{c}") for c in keep))
    rows = rows.withColumn("bucket", F.conv(F.substring("place", 1, 2), 16, 10).cast("int"))
    rows = rows if keep else stored(rows, "sizes")
    buckets = rows.groupBy("part", "bucket").agg(F.first("source_key").alias("source_key"), F.sum("size").alias("bucket_size"))
    base = Window.partitionBy("part").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = buckets.groupBy("source_key").agg(F.sum("bucket_size").alias("source_size")).withColumnRenamed("source_key", "source")
    plan = targets(sizes, **mix).withColumnRenamed("source", "plan_source")
    starts = buckets.withColumn("base", F.coalesce(F.sum("bucket_size").over(base), F.lit(0))).join(plan, F.col("source_key").eqNullSafe(F.col("plan_source")))
    starts = starts.select("part", "bucket", "base", "source_size", "rank", "target")
    within = Window.partitionBy("part", "bucket").orderBy("place", F.col("doc_id").asc_nulls_first(), "size")
    rows = rows.withColumn("upto", F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    rows = rows.join(starts, ["part", "bucket"])  # keys without nulls, so that the window's partitioning serves the join
    before = F.col("base") + F.col("upto") - F.col("size")
    total = F.floor("target")
    rounds = F.when(F.col("source_size") > 0, F.floor(total / F.col("source_size"))).otherwise(0)
    part = F.least(F.col("size"), F.greatest(F.lit(0), total - rounds * F.col("source_size") - before))
    rows = rows.withColumn("taken", (rounds * F.col("size") + part).cast("long"))
    rows = rows.withColumn("copies", F.when(F.col("size") > 0, F.round(F.col("taken") / F.col("size"))).otherwise(0).cast("int"))
    spent = lambda i: F.least(F.lit(1.0), (before + i * F.col("source_size")) / F.greatest(F.col("target"), F.lit(1.0)))
    times = F.when(F.col("taken") > 0, F.sequence(F.lit(0), F.ceil(F.col("taken") / F.col("size")).cast("int") - 1)).otherwise(F.array().cast("array<int>"))
    rows = rows.withColumn("positions", F.transform(times, lambda i: invert(spent(i), slope(F.col("rank")))))
    return rows.select("doc_id", F.col("source_key").alias("source"), "size", "source_size", "target", "taken", "copies", "positions", *(F.col(f"kept_{c}").alias(c) for c in keep if c not in ("doc_id", "source")))


def curriculum(assigned: DataFrame) -> DataFrame:
    """One row for each taken copy with its position, range-sorted by position."""
    rows = assigned.select("*", F.posexplode("positions").alias("copy", "position")).drop("positions")
    return rows.repartitionByRange("position", "doc_id", "copy").sortWithinPartitions("position", "doc_id", "copy")


def training_order(docs: DataFrame, **mix) -> DataFrame:
    """The mix itself, with the columns of documents: every document as often as its copies say, range-sorted by position.

    Documents are never cut: the one that a source takes in part is in if at least half of it is taken.
    """
    whole = docs.select("doc_id", "text", "source", F.struct(*(docs[c] for c in docs.columns)).alias("doc"))  # no name can clash inside
    rows = assign(whole, keep=("doc",), **mix).filter("copies > 0").withColumn("positions", F.slice("positions", 1, F.col("copies")))
    return curriculum(rows).select("doc.*")


def mix_report(docs: DataFrame) -> DataFrame:
    """The assignment of every document, in the order of first training position; what is not taken comes last."""
    rows = assign(docs).select("doc_id", "size", "source_size", "target", "taken", F.get("positions", F.lit(0)).alias("position"))
    return rows.repartitionByRange(F.col("position").asc_nulls_last(), "doc_id").sortWithinPartitions(F.col("position").asc_nulls_last(), "doc_id")


def op7_mixing(spark, sf_dir: str) -> DataFrame:
    """What the mix takes of every document and its first training position; null texts have size 0."""
    return mix_report(spark.read.parquet(f"{sf_dir}/documents.parquet"))
