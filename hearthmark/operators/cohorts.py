"""Street and cohort analytics, and dataset audits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hearthmark.functions.columns import col


def size_cohorts(rows: DataFrame, by: str, cuts: list[float]) -> DataFrame:
    band = F.lit(f">={cuts[-1]:g}")
    for low, high in reversed([*zip([0.0, *cuts[:-1]], cuts, strict=True)]):
        band = F.when(F.col("area_sqft") < high, f"{low:g}-{high:g}").otherwise(band)
    return rows.groupBy(by, band.alias("band")).agg(F.count("*").alias("n"), F.min("psf").alias("low"), F.percentile("psf", F.lit(0.5)).alias("mid"), F.max("psf").alias("high"))


def trend(rows: DataFrame, by: str) -> DataFrame:
    """Yearly medians with the change on the last year that has sales."""
    years = rows.groupBy(by, F.year("contract_month").alias("year")).agg(F.count("*").alias("n"), F.percentile("psf", F.lit(0.5)).alias("median_psf"))
    before = F.last("median_psf", ignorenulls=True).over(Window.partitionBy(by).orderBy("year").rowsBetween(Window.unboundedPreceding, -1))
    return years.withColumn("yoy", F.col("median_psf") / before - 1)


def tenure_mix(rows: DataFrame, by: str) -> DataFrame:
    lease = F.avg((F.col("tenure_type") == "leasehold").cast("double"))
    return rows.groupBy(by).agg(F.count("*").alias("n"), lease.alias("lease_share"), (F.countDistinct("tenure_type") == 1).alias("unanimous"), ((F.count("*") >= 4) & (F.least(lease, 1 - lease) >= 0.10)).alias("mixed"))


def recent_windows(rows: DataFrame, by: str, month: int) -> DataFrame:
    """Medians of the last 12 and 6 months and the 6 before, and of the three newest sales."""
    order = Window.partitionBy(by).orderBy(F.desc("month_idx"), F.desc("id"))
    age = F.lit(month) - F.col("month_idx")
    mid = lambda cond: F.percentile(F.when(cond, F.col("psf")), F.lit(0.5))
    ranked = rows.withColumn("age", age).filter("age >= 0").withColumn("rn", F.row_number().over(order))
    a = F.col("age")
    out = ranked.groupBy(by).agg(F.count(F.when(a < 12, 1)).alias("n12"), mid(a < 12).alias("m12"), mid(a < 6).alias("m6"), mid(a.between(6, 11)).alias("m6_before"), mid(F.col("rn") <= 3).alias("cluster"))
    return out.withColumn("drift", F.col("m6") / F.col("m6_before") - 1)


def subject_cohort(rows: DataFrame, key: str, area: float, tol: float = 0.06, k: int = 6) -> DataFrame:
    """Sales within a share of an area: how many, their median, and the median of the newest k."""
    near = rows.filter(F.abs(F.col("area_sqft") / area - 1) <= tol)
    order = Window.partitionBy(key).orderBy(F.desc("month_idx"), F.desc("id"))
    return near.withColumn("rn", F.row_number().over(order)).groupBy(key).agg(F.count("*").alias("n"), F.percentile("psf", F.lit(0.5)).alias("mid"), F.percentile(F.when(F.col("rn") <= k, F.col("psf")), F.lit(0.5)).alias("newest"))


def audit(rows: DataFrame, *dims: str) -> DataFrame:
    """Counts and spans over several dimensions in one pass of grouping sets."""
    sets = rows.groupingSets([[d] for d in dims] + [[]], *dims).agg(F.count("*").alias("n"), F.min("month_idx").alias("first_month"), F.max("month_idx").alias("last_month"), F.sum((~F.col("psf").between(500, 6500)).cast("long")).alias("outliers"), F.grouping_id().alias("g"))
    return sets.select(F.coalesce(*(F.when(F.col(d).isNotNull(), F.lit(d)) for d in dims), F.lit("all")).alias("dim"), F.coalesce(*(F.col(d).cast("string") for d in dims), F.lit("")).alias("value"), "n", "first_month", "last_month", "outliers")


def copies(rows: DataFrame, *keys: str) -> DataFrame:
    """Surplus rows that repeat all the given columns."""
    groups = rows.groupBy(*keys).count()
    return groups.agg(F.count("*").alias("distinct_rows"), F.sum(col("count") - 1).alias("surplus"), F.max("count").alias("largest"))
