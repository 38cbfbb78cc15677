"""The transaction table and its derived views over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hearthmark.functions.columns import month_idx, quarter_idx
from hearthmark.store import view

CAVEATS_SQL = """
caveats AS (
  SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(CAST(l_shipdate AS DATE) AS VARCHAR)) AS id, l_partkey AS project, l_suppkey AS street, p_type AS property_type, c_mktsegment AS market_segment,
    n_name AS district, CAST(date_trunc('month', l_shipdate) AS DATE) AS contract_month,
    CAST(year(l_shipdate) * 12 + month(l_shipdate) - 1 AS INTEGER) AS month_idx, CAST(year(l_shipdate) * 4 + quarter(l_shipdate) - 1 AS INTEGER) AS q,
    l_linestatus AS type_of_sale, l_quantity AS area_sqft, l_extendedprice AS price, l_extendedprice / l_quantity AS psf,
    CASE WHEN l_returnflag = 'R' THEN 'leasehold' ELSE 'freehold' END AS tenure_type,
    CASE WHEN l_returnflag = 'R' THEN CAST(year(o_orderdate) - p_size AS INTEGER) END AS lease_start,
    CAST(l_linenumber AS INTEGER) AS floor_lo, CAST(l_linenumber + 4 AS INTEGER) AS floor_hi, CASE WHEN l_tax >= 0.08 THEN 2 ELSE 1 END AS no_of_units,
    CAST((l_suppkey * 7919) % 10007 AS DOUBLE) AS x, CAST((l_suppkey * 104729) % 10007 AS DOUBLE) AS y
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN part ON l_partkey = p_partkey
    JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
)"""
INDEX_SQL = """
quarters AS (SELECT q, avg(psf) AS m FROM caveats GROUP BY q),
index_q AS (SELECT q, 100 * m / first_value(m) OVER (ORDER BY q) AS value FROM quarters)"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def caveats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a transaction, from a view that the session writes once."""
    return view(spark, sf_dir, "caveats", ["lineitem", "orders", "customer", "part", "supplier", "nation"], lambda lines: _caveats(spark, sf_dir, lines), lambda: _lines(spark, sf_dir))


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with what their orders tell. Customers meet orders first, so that lines move once."""
    t = lambda n: table(spark, sf_dir, n)
    orders = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_mktsegment", F.year(F.col("o_orderdate").cast("date")).alias("ordered"))
    lines = t("lineitem").withColumn("day", F.col("l_shipdate").cast("date")).withColumn("lease", F.col("l_returnflag") == "R").withColumn("units", F.when(F.col("l_tax") >= 0.08, 2).otherwise(1))
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_linestatus", "day", "lease", "units", "c_mktsegment", "ordered")


def _caveats(spark: SparkSession, sf_dir: str, lines: DataFrame) -> DataFrame:
    """Six tables joined. Spark broadcasts the small ones by their measured size."""
    t = lambda n: table(spark, sf_dir, n)
    rows = lines.join(t("part"), F.col("l_partkey") == F.col("p_partkey"))
    rows = rows.join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    day, lease = F.col("day"), F.col("lease")
    return rows.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", day.cast("string")).alias("id"), F.col("l_partkey").alias("project"), F.col("l_suppkey").alias("street"), F.col("p_type").alias("property_type"), F.col("c_mktsegment").alias("market_segment"),
        F.col("n_name").alias("district"), F.trunc(day, "month").alias("contract_month"), month_idx(day).alias("month_idx"), quarter_idx(day).alias("q"), F.col("l_linestatus").alias("type_of_sale"),
        F.col("l_quantity").alias("area_sqft"), F.col("l_extendedprice").alias("price"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("psf"), F.when(lease, "leasehold").otherwise("freehold").alias("tenure_type"),
        F.when(lease, F.col("ordered") - F.col("p_size")).cast("int").alias("lease_start"), F.col("l_linenumber").cast("int").alias("floor_lo"), (F.col("l_linenumber") + 4).cast("int").alias("floor_hi"),
        F.col("units").alias("no_of_units"), ((F.col("l_suppkey") * 7919) % 10007).cast("double").alias("x"), ((F.col("l_suppkey") * 104729) % 10007).cast("double").alias("y"),
    )


def index_q(rows: DataFrame) -> DataFrame:
    """(q, value): the mean price per quarter, the first quarter at 100; one row a quarter, so safe to broadcast."""
    means = rows.groupBy("q").agg(F.avg("psf").alias("m"))
    first = means.agg(F.min_by("m", "q").alias("m0"))
    return means.crossJoin(F.broadcast(first)).select("q", (100 * F.col("m") / F.col("m0")).alias("value"))
