"""Postal codes to districts and segments, schools and stations from source rows, the nearest of each layer, and splits of yields and prints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hearthmark.operators import geo

# fixed values: postal sectors by district, districts by segment, and the names of stations and of levels
SECTORS = {
    1: (1, 2, 3, 4, 5, 6), 2: (7, 8), 3: (14, 15, 16), 4: (9, 10), 5: (11, 12, 13), 6: (17,), 7: (18, 19), 8: (20, 21), 9: (22, 23), 10: (24, 25, 26, 27), 11: (28, 29, 30), 12: (31, 32, 33), 13: (34, 35, 36, 37), 14: (38, 39, 40, 41),
    15: (42, 43, 44, 45), 16: (46, 47, 48), 17: (49, 50, 81), 18: (51, 52), 19: (53, 54, 55, 82), 20: (56, 57), 21: (58, 59), 22: (60, 61, 62, 63, 64), 23: (65, 66, 67, 68), 24: (69, 70, 71), 25: (72, 73), 26: (77, 78), 27: (75, 76), 28: (79, 80),
}
CORE, REST = (1, 2, 6, 9, 10, 11), (3, 4, 5, 7, 8, 12, 13, 14, 15, 20)
STATION, LEVELS = r"(?i)^(.+?)\s+(?:MRT|LRT)\s+STATION(?:\s*\(.*\))?$", ("PRIMARY", "MIXED LEVEL (P1")


def district_of(postal: Column) -> Column:
    """The district of a six-digit code by its first two digits; null for others and for sectors without one."""
    code = F.trim(postal)
    sector = F.when((F.length(code) == 6) & code.rlike("^[0-9]{2}"), F.substring(code, 1, 2).try_cast("int"))
    out = F.lit(None).cast("int")
    for district, sectors in SECTORS.items():
        out = F.when(sector.isin(*sectors), district).otherwise(out)
    return out


def segment_of(district: Column) -> Column:
    """CCR, RCR or OCR of a district written as a number or as D9; null without a number."""
    n = F.nullif(F.regexp_extract(district.cast("string"), "D?([0-9]+)", 1), F.lit("")).try_cast("int")
    return F.when(n.isin(*CORE), "CCR").when(n.isin(*REST), "RCR").when(n.isNotNull(), "OCR")


def postal_map(rows: DataFrame) -> DataFrame:
    """Adds district_no, segment and note to rows (district, region, postal). A given district beats the postal one, and a given region
    beats the segment of the district, as districts straddle regions; note then names the segment that it overruled."""
    given = F.coalesce(F.nullif(F.col("district"), F.lit("")), district_of(F.col("postal")).cast("string"))
    rows = rows.withColumn("district_no", given).withColumn("guess", segment_of(F.col("district_no")))
    return rows.withColumn("segment", F.coalesce(F.nullif("region", F.lit("")), "guess")).withColumn("note", F.when(F.nullif("region", F.lit("")) != F.col("guess"), F.concat(F.lit("by district "), "guess"))).drop("guess")


def schools(rows: DataFrame, places: DataFrame) -> DataFrame:
    """Rows (name, level, postal) that teach the first primary year, with their place; status matched, no_postal or no_place. Of
    several places of a postal code the least counts."""
    level = F.upper(F.coalesce("level", F.lit("")))
    at = places.groupBy(F.trim("postal").alias("postal")).agg(F.min(F.struct("x", "y")).alias("at"))
    kept = rows.filter((level == LEVELS[0]) | level.startswith(LEVELS[1])).select(F.trim("name").alias("name"), F.trim(F.coalesce("postal", F.lit(""))).alias("postal"))
    status = F.when(F.col("postal") == "", "no_postal").when(F.col("at").isNull(), "no_place").otherwise("matched")
    return kept.join(at, "postal", "left").select("name", "postal", status.alias("status"), F.col("at.x").alias("x"), F.col("at.y").alias("y"))


def stations(entries: DataFrame) -> DataFrame:
    """One row a station of entries (seq, name, x, y): entries named as stations and with a place, the first by seq of each name without
    its kind and exits. layer tells light rail from heavy, as the nearest of one says nothing of the other."""
    found = entries.withColumn("station", F.upper(F.regexp_extract(F.trim("name"), STATION, 1))).filter("station <> '' AND x IS NOT NULL")
    first = found.groupBy("station").agg(F.min_by(F.struct(F.trim("name").alias("name"), "x", "y"), F.struct("seq", "name", "x", "y")).alias("f"))
    return first.select("station", "f.name", F.when(F.upper("f.name").contains("LRT"), "light").otherwise("heavy").alias("layer"), "f.x", "f.y")


def nearest_few(points: DataFrame, sites: DataFrame, cap: float, k: int) -> DataFrame:
    """(id, layer, rank, site, d): the k nearest sites of each layer within the cap, equal distances by name. Points and sites meet in cells of the cap."""
    near = geo.within(points, sites, cap)
    order = Window.partitionBy("id", "layer").orderBy("d", "site")
    return near.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("id", "layer", "rank", "site", "d")


def segment_yield(rows: DataFrame) -> DataFrame:
    """Median, least and greatest yield a segment with their count; null and zero yields are none."""
    return rows.filter("yield_pct <> 0").groupBy("market_segment").agg(F.count("*").alias("n"), F.percentile("yield_pct", F.lit(0.5)).alias("median"), F.min("yield_pct").alias("low"), F.max("yield_pct").alias("high"))


def era_bands(rows: DataFrame, early: int, recent: int) -> DataFrame:
    """Per street, the range of prices up to a year and from a year on, with counts; a street without either has nulls there."""
    cut = {"early": F.col("year") <= early, "recent": F.col("year") >= recent}
    return rows.groupBy("street").agg(*(f(F.when(c, F.col("psf"))).alias(f"{name}_{kind}") for name, c in cut.items() for kind, f in (("n", F.count), ("low", F.min), ("high", F.max))))
