"""Entity resolution: collapse, fingerprints, fuzzy sessions, merges and upserts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def exact_collapse(rows: DataFrame, keys: list[str], keep: str) -> DataFrame:
    """The first of equal rows, by an order column: an aggregation with map-side combine."""
    return rows.groupBy(*keys).agg(F.min(keep).alias(keep), F.count("*").alias("copies"))


def stale_fingerprint(rows: DataFrame, keys: list[str], holder: str, least: int = 3) -> DataFrame:
    """Facts that appear under several holders: kept once with the holder unknown."""
    return rows.groupBy(*keys).agg(F.countDistinct(holder).alias("holders"), F.min(holder).alias("first")).select(*keys, "holders", F.when(F.col("holders") < least, F.col("first")).alias(holder))


def fuzzy_sessions(rows: DataFrame, keys: list[str], day: str, days: int = 31) -> DataFrame:
    """Events of equal keys at most some days after the one before are one event; a chain of near events stays one."""
    order = Window.partitionBy(*keys).orderBy(day, "id")
    new = F.when(F.datediff(day, F.lag(day).over(order)) <= days, 0).otherwise(1)
    sessions = rows.withColumn("new", new).withColumn("session", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return sessions.groupBy(*keys, "session").agg(F.min(day).alias("first_day"), F.max(day).alias("last_day"), F.count("*").alias("n"))


def merge_latest(pulls: DataFrame, key: str, columns: list[str], order: str) -> DataFrame:
    """The newest non-null value of every column."""
    return pulls.groupBy(key).agg(*(F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in columns))


def upsert(old: DataFrame, new: DataFrame, key: str, take: list[str], keep: list[str]) -> DataFrame:
    """New values win in take, old ones in keep; with a status of each row."""
    a, b = old.alias("a"), new.alias("b")
    both = a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "full")
    status = F.when(F.col(f"a.{key}").isNull(), "new").when(F.col(f"b.{key}").isNull(), "missing").otherwise("updated")
    return both.select(F.coalesce(f"a.{key}", f"b.{key}").alias(key), *(F.coalesce(f"b.{c}", f"a.{c}").alias(c) for c in take), *(F.coalesce(f"a.{c}", f"b.{c}").alias(c) for c in keep), status.alias("status"))


def alias_resolve(names: DataFrame, known: DataFrame, aliases: DataFrame) -> DataFrame:
    """A name as it is, else by its alias if that is known, else refused. The alias table is small by nature; Spark decides on its measured size."""
    rows = names.join(known.select(F.col("name").alias("direct")), F.col("name") == F.col("direct"), "left").join(aliases, "name", "left").join(known.select(F.col("name").alias("through")), F.col("alias") == F.col("through"), "left")
    return rows.select("name", F.coalesce("direct", "through").alias("resolved"), F.when(F.col("direct").isNotNull(), "direct").when(F.col("through").isNotNull(), "alias").otherwise("refused").alias("status"))


def arith_gate(rows: DataFrame, tol: float = 0.02) -> DataFrame:
    return rows.withColumn("ok", F.abs(F.col("psf") * F.col("area_sqft") / F.col("price") - 1) <= tol)
