"""Effect fitting and statistics: pairs, repeat sales, fixed effects, returns, drawdowns and ranks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def near_pairs(rows: DataFrame, key: str, months: int) -> DataFrame:
    """Pairs of one key at most some months apart. Sales meet in month buckets as wide as the gap, so that a key's sales
    join only with those near them in time."""
    side = lambda p: rows.select(F.col(key).alias(f"{p}_key"), *(F.col(c).alias(f"{p}_{c}") for c in ("id", "market_segment", "month_idx", "area_sqft", "psf")), ((F.col("floor_lo") + F.col("floor_hi")) / 2).alias(f"{p}_floor"), F.floor(F.col("month_idx") / (months + 1)).alias(f"{p}_b"))
    left = side("a").withColumn("bucket", F.explode(F.array(F.col("a_b") - 1, F.col("a_b"), F.col("a_b") + 1)))
    return left.join(side("b"), (F.col("a_key") == F.col("b_key")) & (F.col("bucket") == F.col("b_b")) & (F.col("a_id") < F.col("b_id")) & (F.abs(F.col("a_month_idx") - F.col("b_month_idx")) <= months))


def pair_elasticity(rows: DataFrame) -> DataFrame:
    """Size elasticity of pairs whose areas differ by 0.20 in log at least."""
    dx = F.log(F.col("b_area_sqft") / F.col("a_area_sqft"))
    found = near_pairs(rows, "project", 3).filter(F.abs(dx) >= 0.20).withColumn("elasticity", F.log(F.col("b_psf") / F.col("a_psf")) / dx).filter((F.col("elasticity") > -1) & (F.col("elasticity") < 0.5))
    return found.groupBy(F.col("a_market_segment").alias("market_segment")).agg(F.percentile("elasticity", F.lit(0.5)).alias("median_elasticity"), F.count("*").alias("n"))


def pair_floor(rows: DataFrame, least_floors: float = 5.0) -> DataFrame:
    """Premium a floor of pairs of like size, floors apart; premiums of 0.05 or more count as errors in the data."""
    up = F.col("b_floor") - F.col("a_floor")
    found = near_pairs(rows, "project", 3).filter((F.abs(F.log(F.col("b_area_sqft") / F.col("a_area_sqft"))) <= 0.10) & (F.abs(up) >= least_floors)).withColumn("premium", F.log(F.col("b_psf") / F.col("a_psf")) / up).filter(F.abs("premium") < 0.05)
    return found.groupBy(F.col("a_market_segment").alias("market_segment")).agg(F.percentile("premium", F.lit(0.5)).alias("median_premium"), F.count("*").alias("n"))


def adjusted(rows: DataFrame, index: DataFrame) -> DataFrame:
    """Prices relative to the index of their quarter; rows of a quarter without a level go. One row a quarter is broadcast."""
    return rows.join(F.broadcast(index.select("q", "value")), "q").withColumn("psf", F.col("psf") / F.col("value")).drop("value")


def fe_slope(rows: DataFrame, group: str, by: str) -> DataFrame:
    """Within-group slope of log price on log area, from sums alone: no pair and no window over rows."""
    x, y = F.log("area_sqft"), F.log("psf")
    sums = rows.groupBy(by, group).agg(F.count("*").alias("n"), F.sum(x).alias("x"), F.sum(y).alias("y"), F.sum(x * y).alias("xy"), F.sum(x * x).alias("xx"))
    within = sums.groupBy(by).agg(F.sum(F.col("xy") - F.col("x") * F.col("y") / F.col("n")).alias("sxy"), F.sum(F.col("xx") - F.col("x") * F.col("x") / F.col("n")).alias("sxx"), F.sum("n").alias("n"))
    return within.select(by, (F.col("sxy") / F.col("sxx")).alias("slope"), "n")


def repeat_groups(rows: DataFrame, key: str, new_sale: str = "O") -> DataFrame:
    """Sales of keys with 2 to 4 distinct trades, no two prices in a month and fewer than two new sales."""
    unique = rows.groupBy(key, "month_idx", "price").agg(F.min("type_of_sale").alias("sale"))
    counts = unique.groupBy(key).agg(F.count("*").alias("n"), F.countDistinct("month_idx").alias("m"), F.count(F.when(F.col("sale") == new_sale, 1)).alias("new"))
    good = counts.filter((F.col("n") == F.col("m")) & F.col("n").between(2, 4) & (F.col("new") < 2))
    return unique.join(good.select(key), key)


def repeat_pairs(sales: DataFrame, key: str) -> DataFrame:
    order = Window.partitionBy(key).orderBy("month_idx")
    rows = sales.withColumn("m0", F.lag("month_idx").over(order)).withColumn("p0", F.lag("price").over(order)).withColumn("gap", F.col("month_idx") - F.col("m0"))
    ratio = F.col("price") / F.col("p0")
    return rows.filter("gap >= 3").select(key, "month_idx", "gap", ratio.alias("ratio"), (F.pow(ratio, 12 / F.col("gap")) - 1).alias("annualised"))


def noise_floor(pairs: DataFrame, index: DataFrame, most: float = 0.60, short: int = 18) -> DataFrame:
    """Median error of repeat pairs after the index's own move, over the root of two, by gap; pairs that move faster than
    most a year count as errors in the data."""
    at = lambda p: F.broadcast(index.select(F.col("q").alias(f"{p}_q"), F.col("value").alias(f"{p}_level")))
    rows = pairs.filter(F.abs("annualised") <= most).withColumn("to_q", F.floor(F.col("month_idx") / 3)).withColumn("from_q", F.floor((F.col("month_idx") - F.col("gap")) / 3))
    error = F.abs(F.log("ratio") - F.log(F.col("to_level") / F.col("from_level")))
    bucket = F.when(F.col("gap") <= short, "short").otherwise("long").alias("bucket")
    return rows.join(at("to"), "to_q").join(at("from"), "from_q").groupBy(bucket).agg(F.count("*").alias("n"), (F.percentile(error, F.lit(0.5)) / F.sqrt(F.lit(2.0))).alias("floor"))


def returns_vol(index: DataFrame) -> DataFrame:
    """Quarterly log returns a kind and their annualised volatility."""
    r = F.log(F.col("value") / F.lag("value").over(Window.partitionBy("kind").orderBy("q")))
    return index.withColumn("r", r).groupBy("kind").agg(F.count("r").alias("n"), F.avg("r").alias("mean_return"), (F.stddev_samp("r") * 2).alias("ann_vol"))


def drawdown(index: DataFrame) -> DataFrame:
    """The deepest fall from a running peak, with the quarters of peak and trough."""
    order = Window.partitionBy("kind").orderBy("q").rowsBetween(Window.unboundedPreceding, 0)
    rows = index.withColumn("peak", F.max("value").over(order)).withColumn("peak_q", F.max_by("q", F.struct("value", -F.col("q"))).over(order)).withColumn("dd", F.col("value") / F.col("peak") - 1)
    return rows.groupBy("kind").agg(F.min(F.struct("dd", "q", "peak_q")).alias("w")).select("kind", F.col("w.dd").alias("drawdown"), F.col("w.q").alias("trough_q"), F.col("w.peak_q").alias("peak_q"))


def cagr(index: DataFrame, years: list[int]) -> DataFrame:
    last = index.groupBy("kind").agg(F.max("q").alias("q1"), F.max_by("value", "q").alias("v1")).withColumn("years", F.explode(F.array(*map(F.lit, years))))
    then = index.select(F.col("kind").alias("k"), F.col("q").alias("q0"), F.col("value").alias("v0"))
    return last.join(then, (F.col("kind") == F.col("k")) & (F.col("q0") == F.col("q1") - 4 * F.col("years"))).select("kind", "years", (F.pow(F.col("v1") / F.col("v0"), 1 / F.col("years")) - 1).alias("cagr"))


def beta(index: DataFrame, market: DataFrame) -> DataFrame:
    """Beta, correlation, alpha and up and down capture of quarterly returns against a market series."""
    def log_return(df: DataFrame, *by: str) -> DataFrame:
        return df.withColumn("r", F.log(F.col("value") / F.lag("value").over(Window.partitionBy(*by, F.lit(0)).orderBy("q")))).filter("r is not null")

    both = log_return(index, "kind").join(F.broadcast(log_return(market).select("q", F.col("r").alias("m"))), "q")
    capture = lambda cond: F.avg(F.when(cond, F.col("r"))) / F.avg(F.when(cond, F.col("m")))
    b = F.covar_samp("r", "m") / F.var_samp("m")
    return both.groupBy("kind").agg(F.count("*").alias("n"), b.alias("beta"), F.corr("r", "m").alias("corr"), ((F.avg("r") - b * F.avg("m")) * 4).alias("alpha"), capture(F.col("m") > 0).alias("up"), capture(F.col("m") < 0).alias("down")).filter("n >= 12")


def spearman(rows: DataFrame, by: str, a: str, b: str) -> DataFrame:
    """Rank correlation with average ranks of ties: ranks come from counts a distinct value, so ties cost nothing."""
    def ranks(c: str) -> DataFrame:
        counts = rows.groupBy(by, c).agg(F.count("*").alias("k"))
        order = Window.partitionBy(by).orderBy(c).rowsBetween(Window.unboundedPreceding, 0)
        return counts.select(by, c, (F.sum("k").over(order) - (F.col("k") - 1) / 2).alias(f"rank_{c}"))

    return rows.select(by, a, b).join(ranks(a), [by, a]).join(ranks(b), [by, b]).groupBy(by).agg(F.corr(f"rank_{a}", f"rank_{b}").alias("rho"), F.count("*").alias("n")).filter("n >= 5")
