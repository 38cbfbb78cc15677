"""Rules of single valuations and records over whole tables: the mean grid, thresholds, pair trends, listings and launches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hearthmark.functions import columns as C
from hearthmark.operators import asof as A

# fixed values: the order of value flags in a ranking, and listing words that mean a scorecard code
VALUE_ORDER = {"VALUE": 0, "FAIR": 1, "RICH": 2, "BUILD-PRICED": 3, "?": 4}
LISTING_WORDS = {"rebuild_status": {"rebuilt_new": "rebuilt_recent", "renovated": "rebuilt_old", "original": "original_good"}, "estate_tier": {"mid": "good"}, "tenure": {"999_yr": "999", "999-year": "999", "99_yr": "99", "99-year": "99"}, "flood_risk": {"unverified": "none", "unknown": "none"}}
LISTING_DEFAULTS = {"rebuild_status": "original_good", "estate_tier": "prime", "tenure": "freehold", "flood_risk": "none"}


def exclusive_quartile(values: Column, i: int) -> Column:
    """The i-th quartile of a sorted array at position i(n + 1)/4, drawn into the array at its ends; needs two values."""
    n = F.size(values)
    j = F.greatest(F.lit(1), F.least(F.floor(i * (n + 1) / 4).cast("int"), n - 1))
    rest = i * (n + 1) - j * 4
    return (F.get(values, j - 1) * (4 - rest) + F.get(values, j) * rest) / 4


def legacy_grid(pairs: DataFrame, trends: list[float], floor_premium: float = 0.003, elasticity: float = -0.07, anchor: float = 2.0) -> DataFrame:
    """Weighted mean of adjusted comparables for each yearly trend; the newest one counts once more with the anchor's weight.
    The band are exclusive quartiles from four values on, else the ends, and holds the mean within 1.5 percent.
    Pairs carry rn, 1 for the newest; scenarios are part of the key, so one job serves all of them."""
    middle = lambda p: (F.col(f"{p}floor_lo") + F.col(f"{p}floor_hi")) / 2
    up, years, ratio = middle("s_") - middle(""), F.col("age") / 12, F.col("s_area_sqft") / F.col("area_sqft")
    rows = pairs.withColumn("trend", F.explode(F.array(*map(F.lit, trends))))
    value = F.col("psf") * F.pow(1 + F.col("trend"), years) * F.pow(F.lit(1 + floor_premium), up) * F.pow(ratio, F.lit(elasticity))
    weight = 1 / (1 + F.abs(F.log(ratio)) * 3 + F.abs(up) / 25 + years / 2)
    rows = rows.withColumn("v", value).withColumn("w", F.explode(F.when(F.col("rn") == 1, F.array(weight, F.lit(anchor))).otherwise(F.array(weight))))
    out = rows.groupBy("s_id", "s_area_sqft", "trend").agg((F.sum(F.col("v") * F.col("w")) / F.sum("w")).alias("psf"), F.array_sort(F.collect_list("v")).alias("vs"), F.count("*").alias("n"))
    end = lambda i, f: F.when(F.col("n") >= 4, exclusive_quartile(F.col("vs"), i)).otherwise(f("vs"))
    low, high = F.least(end(1, F.array_min), F.col("psf") * 0.985), F.greatest(end(3, F.array_max), F.col("psf") * 1.015)
    return out.select("s_id", "trend", "psf", low.alias("low_psf"), high.alias("high_psf"), "n")


def visible_counts(subjects: DataFrame, comps: DataFrame) -> DataFrame:
    """How many comparables of the project are known at the valuation date, and how many a live valuation would read. Months
    are counted before subjects meet them."""
    months = comps.groupBy("project", "contract_month", "month_idx").agg(F.count("*").alias("k"))
    near = subjects.join(months, (F.col("s_project") == F.col("project")) & (F.col("month_idx") <= F.col("asof_idx")), "left")
    return near.groupBy("s_id").agg(F.coalesce(F.sum(F.when(C.visible("contract_month", "as_of"), F.col("k"))), F.lit(0)).alias("n_recon"), F.coalesce(F.sum("k"), F.lit(0)).alias("n_live"))


def fresh_reference(pairs: DataFrame, tol: float = 0.10, elasticity: float = -0.07) -> DataFrame:
    """The newest comparable of about the subject's size, moved in time and size."""
    near = pairs.filter(F.abs(F.log(F.col("area_sqft") / F.col("s_area_sqft"))) <= tol)
    value = F.col("psf") * A.capped() * F.pow(F.col("s_area_sqft") / F.col("area_sqft"), F.lit(elasticity))
    return near.groupBy("s_id").agg(F.max_by(F.struct(F.col("id").alias("c_id"), value.alias("psf"), "age"), F.struct("month_idx", "id")).alias("b")).select("s_id", "b.*")


def method_spread(rows: DataFrame, point: str, hard: float = 0.15) -> DataFrame:
    """(greatest - least) / point over the methods that answer; hard marks cases beyond the limit."""
    spread = (F.max("psf") - F.min("psf")) / F.max(F.when(F.col("method") == point, F.col("psf")))
    return rows.groupBy("s_id").agg(F.count("psf").alias("methods"), spread.alias("spread")).withColumn("hard", F.col("spread") > hard)


def distribution(pairs: DataFrame, value: str, windows: list[int]) -> DataFrame:
    """Count and quartiles of adjusted comparables in each window of months, in one pass."""
    rows = pairs.withColumn("window", F.explode(F.array(*map(F.lit, windows)))).filter(F.col("age") < F.col("window"))
    out = rows.groupBy("s_id", "window").agg(F.count("*").alias("n"), F.percentile(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"))
    return out.select("s_id", "window", "n", *(F.col("q")[i].alias(c) for i, c in enumerate(("p25", "p50", "p75"))))


def suppress_reason(alias: Column, big: Column, fallback: Column, hard: Column, confidence: Column, n: Column) -> Column:
    """Why thresholds are withheld, the first that holds; null if none."""
    return F.when(alias, "alias").when(big, "size").when(fallback, "fallback").when(hard, "hard_case").when(confidence < 55, "confidence").when(n < 4, "thin")


def pair_density(rows: DataFrame, *plot: str) -> DataFrame:
    """Repeat sales a month: the total, the months that have any, and the upper median."""
    before = F.lag("month_idx").over(Window.partitionBy(*plot).orderBy("month_idx"))
    months = rows.withColumn("before", before).filter("before <> month_idx").groupBy("month_idx").agg(F.count("*").alias("k"))
    return months.agg(F.sum("k").alias("pairs"), F.count("*").alias("months"), F.get(F.array_sort(F.collect_list("k")), F.floor(F.count("*") / 2).cast("int")).alias("median"))  # a row a month


def pair_trend(rows: DataFrame, by: str, floor_premium: float = 0.003, default: float = 0.018, least: int = 5) -> DataFrame:
    """Yearly growth of pairs of one project and area at least a year apart, floors evened; the median from least pairs on,
    else the default, and always within 0 and 5 percent."""
    side = lambda p: rows.select("project", "area_sqft", F.col(by).alias(f"{p}_by"), F.col("month_idx").alias(f"{p}_m"), F.col("psf").alias(f"{p}_psf"), F.col("floor_lo").alias(f"{p}_f"))
    years = (F.col("b_m") - F.col("a_m")) / 12
    rate = F.log(F.col("b_psf") * F.pow(F.lit(1 + floor_premium), F.col("a_f") - F.col("b_f")) / F.col("a_psf")) / years
    pairs = side("a").join(side("b"), ["project", "area_sqft"]).filter(years >= 1)
    fit = pairs.groupBy(F.col("a_by").alias(by)).agg(F.percentile(rate, F.lit(0.5)).alias("raw"), F.count("*").alias("n"))
    return fit.select(by, "n", F.least(F.greatest(F.when(F.col("n") >= least, F.col("raw")).otherwise(default), F.lit(0.0)), F.lit(0.05)).alias("rate"))


def street_cagr(rows: DataFrame, years: int = 5, least: int = 3) -> DataFrame:
    """Yearly log growth over pairs of different projects of one street and type, years apart; the median from least on."""
    side = lambda p: rows.select("street", "property_type", *(F.col(c).alias(f"{p}_{c}") for c in ("project", "month_idx", "psf")))
    gap = (F.col("b_month_idx") - F.col("a_month_idx")) / 12
    pairs = side("a").join(side("b"), ["street", "property_type"]).filter((gap >= years) & (F.col("a_project") != F.col("b_project"))).withColumn("rate", F.log(F.col("b_psf") / F.col("a_psf")) / gap)
    return pairs.groupBy("street").agg(F.count("*").alias("n"), F.when(F.count("*") >= least, F.percentile("rate", F.lit(0.5))).alias("cagr"), F.min("rate").alias("low"), F.max("rate").alias("high"))


def fresh_cluster(rows: DataFrame, by: str) -> DataFrame:
    """The newest sale against the median of the three before it."""
    order = Window.partitionBy(by).orderBy(F.desc("month_idx"), F.desc("id"))
    ranked = rows.withColumn("rn", F.row_number().over(order)).filter("rn <= 4")
    out = ranked.groupBy(by).agg(F.max(F.when(F.col("rn") == 1, F.col("psf"))).alias("fresh"), F.percentile(F.when(F.col("rn") > 1, F.col("psf")), F.lit(0.5)).alias("cluster"))
    return out.withColumn("move", F.col("fresh") / F.col("cluster") - 1)


def listing_code(name: str, raw: Column) -> Column:
    """A listing's word as the scorecard's code; a missing one takes the conservative default."""
    out = F.coalesce(raw, F.lit(LISTING_DEFAULTS[name]))
    for word, code in LISTING_WORDS[name].items():
        out = F.when(raw == word, code).otherwise(out)
    return out


def rank_listings(rows: DataFrame, by: str, quality: Column, flag: Column, key: str) -> DataFrame:
    """Within an area, quality first, then the better land value, then the key."""
    order = F.lit(4)
    for name, i in VALUE_ORDER.items():
        order = F.when(flag == name, i).otherwise(order)
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy(quality.desc(), order, key)))


def screen_verdict(total: Column, flag: Column, tenure: Column, flood: Column) -> Column:
    """Data first, then price, then quality."""
    unknown = lambda c: F.coalesce(F.lower(c), F.lit("unknown")).isin("", "unknown", "unverified")
    return F.when((flag == "?") | unknown(tenure) | F.lower(flood).isin("unknown", "unverified"), "VERIFY DATA").when(flag == "BUILD-PRICED", "BUILD-PLAY").when(flag == "RICH", "NEGOTIATE").when(total >= 80, "PURSUE").when(total >= 65, "CONSIDER").when(total >= 50, "MARGINAL").otherwise("PASS")


def launch_scenarios(rows: DataFrame, growth: list[float], key: str, price: Column, absd: Column, rent_year: Column, holding: int = 5, build: int = 3, ltv: float = 0.75, rate: float = 0.03, occupancy: float = 0.95, sell: float = 0.02) -> DataFrame:
    """Profit and return on cash of a launch at each yearly growth: duty, ramped interest while building, rent after it, and
    costs and duty at the exit."""
    rented = max(0, holding - build)
    duty, exit_rate = C.bsd(price) + price * absd, 1 - sell - C.ssd_rate(F.lit(holding))
    carry = price * ltv * rate * (build * 0.45 + rented) - rent_year * rented * occupancy
    cash, grown = price * (1 - ltv) + duty, F.explode(F.array(*map(F.lit, growth)))
    out = rows.select(key, price.alias("price"), duty.alias("duty"), carry.alias("carry"), cash.alias("cash"), grown.alias("growth"))
    profit = F.col("price") * F.pow(1 + F.col("growth"), F.lit(holding)) * exit_rate - F.col("price") - F.col("duty") - F.col("carry")
    out = out.withColumn("profit", profit).withColumn("roi", F.when(F.col("cash") != 0, F.col("profit") / F.col("cash")).otherwise(0.0))
    breakeven = (F.col("price") + F.col("duty") + F.col("carry")) / exit_rate / F.col("price") - 1
    return out.select(key, "growth", "profit", "roi", F.when(F.col("roi") > -1, F.pow(1 + F.col("roi"), F.lit(1 / holding)) - 1).otherwise(-1.0).alias("annualised"), breakeven.alias("breakeven"))
