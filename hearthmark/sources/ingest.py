"""Nested official records to typed rows, tenure and floor parsing, attribute maps, and guarded writes."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RAW = "street string, project string, marketSegment string, x string, y string, transaction array<struct<area: string, floorRange: string, noOfUnits: string, contractDate: string, typeOfSale: string, price: string, propertyType: string, district: string, typeOfArea: string, tenure: string>>"
SQFT = 10.7639


def number(c: Column | str) -> Column:
    """A number with thousands marks, null on failure."""
    return F.regexp_replace(c, ",", "").try_cast("double")


def month(c: Column | str) -> Column:
    """MMYY to the first of the month; anything else is null."""
    return F.when(F.col(c).rlike(r"^(0[1-9]|1[0-2])\d\d$"), F.make_date(F.substring(c, 3, 2).cast("int") + 2000, F.substring(c, 1, 2).cast("int"), F.lit(1)))


def floors(c: Column | str) -> tuple[Column, Column]:
    a, b = (F.regexp_extract(c, r"^\s*(\d+)\s*-\s*(\d+)\s*$", i).try_cast("int") for i in (1, 2))
    return F.least(a, b), F.greatest(a, b)


def tenure(c: Column | str) -> tuple[Column, Column]:
    """Type and start year; leases of 900 years or more are as good as freehold."""
    text = F.lower(F.coalesce(c if isinstance(c, Column) else F.col(c), F.lit("")))
    years, start = F.regexp_extract(text, r"(\d+)\s*y(?:ea)?rs?", 1).try_cast("int"), F.regexp_extract(text, r"(?:from|commencing)\D*(\d{4})", 1).try_cast("int")
    return F.when(text.contains("freehold"), "freehold").when(years >= 900, "freehold_equiv").when(years.isNotNull(), "leasehold").otherwise("unknown"), F.when(~text.contains("freehold"), start)


def read_raw(spark: SparkSession, *paths: str) -> DataFrame:
    """Nested snapshots, plain or gzipped, by a fixed schema."""
    return spark.read.schema(RAW).json(list(paths))


def existing(spark: SparkSession, *patterns: str) -> list[str]:
    """The files or folders that patterns name, each pattern's in order of their names; a pattern that matches nothing adds none."""
    found = []
    for pattern in patterns:
        at = spark._jvm.org.apache.hadoop.fs.Path(pattern)
        hits = at.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(at)
        found += sorted(h.getPath().toString() for h in hits or [])
    return found


def read_batches(spark: SparkSession, *patterns: str) -> DataFrame:
    """The union of the raw batches that are there; without any an empty table."""
    paths = existing(spark, *patterns)
    return read_raw(spark, *paths) if paths else spark.createDataFrame([], RAW)


def read_store(spark: SparkSession, path: str, snapshots: str) -> DataFrame:
    """The pull at path if there is one, else the newest by name of the snapshots, plain or gzipped; an error without either."""
    found = existing(spark, path) or existing(spark, snapshots)
    if not found:
        raise FileNotFoundError(f"no store at {path} and no snapshot like {snapshots}")
    return read_raw(spark, found[-1])


def normalize(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Flat transactions, and the rejects whose price, area or date cannot be read."""
    rows = raw.select("street", "project", F.col("marketSegment").alias("market_segment"), number("x").alias("x"), number("y").alias("y"), F.posexplode("transaction").alias("pos", "t")).select("*", "t.*").drop("t", "transaction")
    low, high = floors("floorRange")
    kind, start = tenure("tenure")
    flat = rows.select("street", "project", "market_segment", "x", "y", "pos", month("contractDate").alias("contract_month"), number("area").alias("area_sqm"), number("price").alias("price"), low.alias("floor_lo"), high.alias("floor_hi"), F.element_at(F.array(F.lit("New Sale"), F.lit("Sub Sale"), F.lit("Resale")), F.greatest(F.lit(1), F.least(F.lit(3), F.coalesce(F.col("typeOfSale").try_cast("int"), F.lit(3))))).alias("type_of_sale"), F.col("propertyType").alias("property_type"), "district", F.col("typeOfArea").alias("type_of_area"), F.col("tenure").alias("tenure_raw"), kind.alias("tenure_type"), start.alias("lease_start"), F.coalesce(F.col("noOfUnits").try_cast("int"), F.lit(1)).alias("no_of_units"))
    flat = flat.withColumn("area_sqft", F.col("area_sqm") * SQFT).withColumn("psf", F.col("price") / F.col("area_sqft"))
    good = F.coalesce((F.col("price") > 0) & (F.col("area_sqm") > 0) & F.col("contract_month").isNotNull(), F.lit(False))
    return flat.filter(good), flat.filter(~good)


ATTRIBUTE = r'[ \t\n\r]([a-zA-Z_:][a-zA-Z0-9_:.-]*)="([^"]*)"'


def attribute_counts(pages: DataFrame, column: str = "html") -> DataFrame:
    """How often each quoted attribute value occurs, by name and value, over whole texts."""
    names, values = (F.regexp_extract_all(column, F.lit(ATTRIBUTE), F.lit(i)) for i in (1, 2))
    return pages.select(F.explode(F.arrays_zip(names.alias("name"), values.alias("value"))).alias("a")).groupBy("a.name", "a.value").agg(F.count("*").alias("n"))


def table_map(description: Column) -> Column:
    """The th and td pairs of an attribute table as a map, cells without markup; null where there is no pair. Of a repeated name the last counts."""
    pair = lambda i: F.regexp_extract_all(description, F.lit(r"(?is)<th>(.*?)</th>\s*<td>(.*?)</td>"), F.lit(i))
    bare = lambda v: F.trim(F.regexp_replace(v, "<[^>]+>", ""))
    names, values = F.transform(pair(1), lambda k: F.trim(k)), F.transform(pair(2), bare)
    last = F.filter(F.arrays_zip(names.alias("k"), values.alias("v")), lambda e, i: ~F.array_contains(F.slice(names, i + 2, F.size(names)), e["k"]))
    return F.when(F.size(names) > 0, F.map_from_entries(last))


def decoded(raw: str) -> Column:
    """(text, coding) of bytes: UTF-8, else cp1252, else UTF-8 with what cannot be read replaced, so that one byte sinks no batch."""

    @F.pandas_udf("text string, coding string")
    def run(values: pd.Series) -> pd.DataFrame:
        out = []
        for v in values:
            for coding in ("utf-8", "cp1252") if v is not None else ():
                try:
                    out.append((bytes(v).decode(coding), coding))
                    break
                except UnicodeDecodeError:
                    continue
            else:
                out.append((None, None) if v is None else (bytes(v).decode("utf-8", "replace"), "replaced"))
        return pd.DataFrame(out, columns=["text", "coding"])

    return run(F.col(raw))


def read_bytes(spark: SparkSession, *paths: str) -> DataFrame:
    """(path, text, coding) of whole files that are not empty."""
    return spark.read.format("binaryFile").load(list(paths)).select("path", decoded("content").alias("d")).select("path", "d.*")


SERIES = "Data struct<title: string, row: array<struct<rowText: string, columns: array<struct<key: string, value: string>>>>>"


def series_points(tables: DataFrame, column: str = "json") -> tuple[DataFrame, DataFrame]:
    """(title, series, quarter, value) of nested statistical tables, and the rejects whose quarter or value cannot be read.

    Points without a value ('', na, -) are none and no rejects; a series without a name is called ?.
    """
    data = tables.select(F.from_json(column, SERIES)["Data"].alias("d")).select(F.coalesce("d.title", F.lit("")).alias("title"), F.explode("d.row").alias("r"))
    points = data.select("title", F.coalesce(F.nullif(F.trim("r.rowText"), F.lit("")), F.lit("?")).alias("series"), F.explode("r.columns").alias("c")).filter("c.value IS NOT NULL AND trim(c.value) NOT IN ('', 'na', '-')")
    part = lambda i: F.regexp_extract(F.trim("c.key"), r"^([0-9]{4})\s+([1-4])Q$", i)
    rows = points.select("title", "series", F.when(part(1) != "", F.concat(part(1), F.lit("Q"), part(2))).alias("quarter"), F.col("c.value").try_cast("double").alias("value"), F.col("c.key").alias("key"), F.col("c.value").alias("raw"))
    good = F.col("quarter").isNotNull() & F.col("value").isNotNull()
    return rows.filter(good).drop("key", "raw"), rows.filter(~good).select("title", "series", "key", "raw")


def year_values(lines: DataFrame, column: str, name: str) -> DataFrame:
    """(year, name) of comma-separated lines whose first two fields are a year and a number, further ones are let be; the header and blank lines have none and go."""
    fields = F.split(F.trim(column), ",")
    return lines.select(F.trim(F.get(fields, F.lit(0))).try_cast("int").alias("year"), F.trim(F.get(fields, F.lit(1))).try_cast("double").alias(name)).filter(F.col("year").isNotNull() & F.col(name).isNotNull())


def index_kinds(points: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """Points with the kind of their series; a series that has none goes."""
    known = F.create_map(*(F.lit(x) for pair in kinds.items() for x in pair))
    return points.withColumn("kind", F.try_element_at(known, F.lower("series"))).filter("kind IS NOT NULL")


def newest(files: DataFrame, stamp: str) -> DataFrame:
    """Rows of the newest snapshot."""
    return files.join(F.broadcast(files.agg(F.max(stamp).alias(stamp))), stamp)


def save(rows: DataFrame, path: str, fmt: str = "parquet", by: list[str] | None = None) -> None:
    """Writes rows, in folders by the columns given, but never replaces a table with an empty one."""
    if rows.isEmpty():
        raise ValueError("refusing to overwrite with an empty result")
    rows.write.mode("overwrite").format(fmt).partitionBy(*by or []).save(path)


KEPT = ["s_id", "method", "s_market_segment", "s_property_type", "s_contract_month", "n_comps", "s_price", "pred", "low", "high"]


def save_run(rows: DataFrame, summary: DataFrame, path: str, keep: list[str] = KEPT) -> None:
    """A backtest's results: summary as one JSON file, and chosen columns of every subject and method as Parquet by method, declined ones included.

    The rows are written first: a summary stands for a whole run. Neither replaces a former run by an empty one.
    """
    save(rows.select(*keep), f"{path}/rows", by=["method"])
    save(summary.coalesce(1), f"{path}/summary", "json")
