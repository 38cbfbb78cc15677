"""The as-of pair join, universe filters, time adjustment and weighted quantiles that the estimators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hearthmark.functions.columns import INDEX_LAG_DAYS, LAG_DAYS, asof_date, clamp, month_idx, quarter_idx, visible

SUBJECT = ["id", "project", "street", "property_type", "market_segment", "district", "contract_month", "area_sqft", "price", "tenure_type", "lease_start", "floor_lo", "floor_hi", "x", "y"]


def hygiene(rows: DataFrame, low: float = 500.0, high: float = 6500.0) -> DataFrame:
    """Single-unit sales within the sanity band."""
    return rows.filter((F.col("no_of_units") <= 1) & F.col("psf").between(low, high))


# fixed values: the strata types of the condo universe, and the land types by exact and by partial name
CONDO_TYPES, LANDED_TYPES, LANDED_WORDS = ("Condominium", "Apartment"), ("Terrace", "Semi-detached", "Detached"), ("terrace", "semi-detached", "detached", "bungalow")


def universe(rows: DataFrame, name: str, condo: tuple[str, ...] = CONDO_TYPES, landed: tuple[str, ...] = LANDED_TYPES, words: tuple[str, ...] = LANDED_WORDS) -> DataFrame:
    """The rows of a universe: condo (its types, never on land), landed (on land, or a type that holds a landed word),
    pure_landed (on land and a landed type by exact name), strata_landed (landed but not on land). A null type or kind of
    area belongs to none that asks for it."""
    land, kind = F.coalesce(F.col("type_of_area") == "Land", F.lit(False)), F.coalesce(F.col("property_type"), F.lit(""))
    held = F.lower(kind).rlike("|".join(words))
    rule = {"condo": kind.isin(*condo) & ~land, "landed": land | held, "pure_landed": land & kind.isin(*landed), "strata_landed": held & ~land}
    return rows.filter(rule[name])


def hash_sample(rows: DataFrame, n: int, seed: int = 7, id_col: str = "id") -> DataFrame:
    """At most n rows in a fixed pseudo-random order of their ids: the same for every run and partitioning."""
    place = F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")).cast("binary"))
    return rows.orderBy(place, id_col).limit(n)


def subjects(rows: DataFrame, sale_type: str = "F", from_month: str = "1997-01-01") -> DataFrame:
    """The sales to be valued, with their valuation date; columns carry the prefix s_."""
    chosen = rows.filter((F.col("type_of_sale") == sale_type) & (F.col("contract_month") >= F.lit(from_month).cast("date")))
    out = chosen.select(*(F.col(c).alias(f"s_{c}") for c in SUBJECT)).withColumn("as_of", asof_date("s_contract_month"))
    return out.withColumn("asof_idx", month_idx("as_of"))


def pairs(subjects_: DataFrame, comps: DataFrame, on: list[str], window: int | None = None, extra: Column | None = None, lag: int = LAG_DAYS) -> DataFrame:
    """Every subject with its visible comparables of equal keys: an equi join with the visibility range as residual.

    One job for all months; a subject never sees its own month or later, so it never sees itself. Skewed keys are left to
    adaptive skew joins, which can split this join.
    """
    cond = visible("contract_month", "as_of", lag)
    for c in on:
        cond = cond & (F.col(f"s_{c}") == F.col(c))
    age = F.col("asof_idx") - F.col("month_idx")
    cond = cond & (age >= 0) & ((age < window) if window else F.lit(True))
    return subjects_.join(comps, cond & extra if extra is not None else cond).withColumn("age", age)


def asof_quarters(rows: DataFrame, index: DataFrame, lag: int = INDEX_LAG_DAYS) -> DataFrame:
    """(as_of, asof_q): for each valuation date the latest quarter whose end plus the lag has passed."""
    dates = rows.select("as_of").distinct()
    end = F.last_day(F.make_date(F.floor(F.col("q") / 4).cast("int"), (F.col("q") % 4 * 3 + 3).cast("int"), F.lit(1)))
    return dates.join(F.broadcast(index.select("q")), F.date_add(end, lag) <= F.col("as_of")).groupBy("as_of").agg(F.max("q").alias("asof_q"))


def index_levels(index: DataFrame, beyond: int = 0) -> DataFrame:
    """(q, level) for every quarter of the span and some beyond: a missing one takes the latest earlier value. A few hundred rows."""
    span = index.agg(F.explode(F.sequence(F.min("q"), F.max("q") + beyond)).alias("q"))
    back = Window.partitionBy(F.lit(0)).orderBy("q").rowsBetween(Window.unboundedPreceding, 0)
    return span.join(index, "q", "left").select("q", F.last("value", ignorenulls=True).over(back).alias("level"))


def time_factor(rows: DataFrame, index: DataFrame, lag: int = INDEX_LAG_DAYS, beyond: int = 400) -> DataFrame:
    """Adds tf, the index ratio from a comparable's quarter to the as-of quarter; 1 where either is missing.

    The as-of quarter is the last that ended lag days before the date, by calendar alone: rows are read once, and quarters
    after the index's last one, up to a century, take its level.
    """
    levels = index_levels(index, beyond)
    to = levels.select(F.col("q").alias("_q"), F.col("level").alias("to_level"))
    ended = quarter_idx(F.date_add(F.col("as_of"), 1 - lag)) - 1
    out = rows.withColumn("_q", ended).join(F.broadcast(to), "_q", "left").drop("_q")
    out = out.join(F.broadcast(index_levels(index).withColumnRenamed("level", "from_level")), "q", "left")
    return out.withColumn("tf", F.coalesce(F.when(F.col("from_level") != 0, F.col("to_level") / F.col("from_level")), F.lit(1.0))).drop("to_level", "from_level")


def weighted_quantiles(rows: DataFrame, keys: list[str], value: str, weight: str, tie: str, **qs: float) -> DataFrame:
    """First value, by (value, weight, tie), at which the running weight reaches q of the total."""
    order = Window.partitionBy(*keys).orderBy(value, weight, tie).rowsBetween(Window.unboundedPreceding, 0)
    run = rows.withColumn("_cum", F.sum(weight).over(order)).withColumn("_total", F.sum(weight).over(Window.partitionBy(*keys)))
    return run.groupBy(*keys).agg(*(F.min(F.when(F.col("_cum") >= q * F.col("_total"), F.col(value))).alias(n) for n, q in qs.items()), F.count("*").alias("n_comps"))


def estimate(rows: DataFrame, method: str, value: str = "psf") -> DataFrame:
    """Median estimate a subject, with quartiles as a band from four comparables on."""
    q = F.percentile(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    out = rows.groupBy("s_id", "s_area_sqft").agg(q.alias("_q"), F.count("*").alias("n_comps"))
    band = lambda i: F.when(F.col("n_comps") >= 4, F.col("_q")[i] * F.col("s_area_sqft"))
    return out.select("s_id", F.lit(method).alias("method"), F.col("_q")[1].alias("psf"), band(0).alias("low"), band(2).alias("high"), "n_comps")


def capped(tf: Column | str = "tf") -> Column:
    return clamp(F.col(tf) if isinstance(tf, str) else tf, 0.80, 1.25)
