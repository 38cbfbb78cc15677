"""Fitted models: hedonic regression, neighbours in feature space, the local trend, blends of several reads and the engines."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hearthmark.functions.columns import BIG_PLOT, liquidity, month_idx, visible
from hearthmark.operators import asof as A
from hearthmark.operators import estimators as E
from hearthmark.store import kept

# fixed values of the blends: the grid's weight by the number of its comparables
GRID_WEIGHTS = {"1-2": 0.85, "3-5": 0.90, "6-15": 0.95, "16+": 0.95}
REAL = ["one", "ln_area", "floor", "t", "lease"]  # the regression's columns beside its dummies
DUMMIES = ["district", "market_segment", "tenure_type"]


def lease_age(prefix: str = "") -> Column:
    start = F.col(f"{prefix}lease_start")
    known = (F.col(f"{prefix}tenure_type") == "leasehold") & (start != 0)
    return F.when(known, F.greatest(F.lit(0.0), F.year(f"{prefix}contract_month") - start)).otherwise(0.0)


def mid_floor(prefix: str = "") -> Column:
    return F.coalesce((F.col(f"{prefix}floor_lo") + F.col(f"{prefix}floor_hi")) / 2, F.lit(8.0))


def regressors(rows: DataFrame, month: str, origin: int, prefix: str = "") -> DataFrame:
    return rows.withColumns({"one": F.lit(1.0), "ln_area": F.log(f"{prefix}area_sqft"), "floor": mid_floor(prefix) / 10, "t": (F.col(month) - origin) / 12, "lease": lease_age(prefix) / 10})


def solve_hedonic(cells: pd.DataFrame, ridge: float, least: int) -> pd.DataFrame:
    """Ridge regression of one valuation date from the sums of its cells, a few hundred rows at most."""
    n, names = cells["one_one"].sum(), list(REAL)
    for d in DUMMIES:  # the last level of each is the baseline
        names += [f"{d}:{v}" for v in sorted(cells[d].dropna().unique())[:-1]]
    if n < least:
        return pd.DataFrame({"as_of": [], "beta": [], "sd": []}).astype({"as_of": object, "beta": object})
    at = {name: i for i, name in enumerate(names)}
    gram, xy = np.zeros((len(names), len(names))), np.zeros(len(names))
    for row in cells.to_dict("records"):
        own = [at[k] for k in (f"{d}:{row[d]}" for d in DUMMIES) if k in at]
        for i, a in enumerate(REAL):
            for j, b in enumerate(REAL):
                gram[i, j] += row[f"{a}_{b}" if i <= j else f"{b}_{a}"]
            xy[i] += row[f"{a}_y"]
            for o in own:
                gram[i, o] += row[f"one_{a}"]
                gram[o, i] += row[f"one_{a}"]
        for o in own:
            gram[o, own] += row["one_one"]
            xy[o] += row["one_y"]
    beta = np.linalg.solve(gram + ridge * n * np.eye(len(names)), xy)
    mean = (xy[0] - beta @ gram[0]) / n
    square = (cells["y_y"].sum() - 2 * beta @ xy + beta @ gram @ beta) / n
    return pd.DataFrame({"as_of": [cells["as_of"].iloc[0]], "beta": [dict(zip(names, beta, strict=True))], "sd": [max(square - mean * mean, 0.0) ** 0.5]})


def hedonic_fit(subjects: DataFrame, comps: DataFrame, origin: int, ridge: float = 1e-6, least: int = 200) -> DataFrame:
    """(as_of, beta, sd): log price on log area, floor, time, lease age and dummies, one fit a valuation date.

    Dummies are constant within a cell of district, segment and tenure, so a month's cells hold all the sums; a date adds up
    the cells of its visible months and solves a system as small as the number of columns."""
    cols = [*REAL, "y"]
    terms = [(f"{a}_{b}", F.col(a) * F.col(b)) for i, a in enumerate(cols) for b in cols[i:]]
    rows = regressors(comps, "month_idx", origin).withColumn("y", F.log("psf"))
    months = rows.groupBy("contract_month", *DUMMIES).agg(*(F.sum(c).alias(n) for n, c in terms))
    dates = F.broadcast(subjects.select("as_of").distinct())  # one row a month of the history
    seen = months.join(dates, visible("contract_month", "as_of")).groupBy("as_of", *DUMMIES).agg(*(F.sum(n).alias(n) for n, _ in terms))
    return seen.groupBy("as_of").applyInPandas(lambda pdf: solve_hedonic(pdf, ridge, least), "as_of date, beta map<string,double>, sd double")


def a1_hedonic(subjects: DataFrame, comps: DataFrame, origin: int, low: float = 300.0, high: float = 7000.0) -> DataFrame:
    """The regression's price of a subject at its valuation date, with one residual deviation on either side; a subject
    without a fit, or outside the plausible range, is declined."""
    rows = regressors(subjects, "asof_idx", origin, "s_").join(F.broadcast(hedonic_fit(subjects, comps, origin)), "as_of")
    log_psf = sum((F.col("beta")[c] * F.col(c) for c in REAL), F.lit(0.0))
    for d in DUMMIES:
        log_psf = log_psf + F.coalesce(F.col("beta")[F.concat(F.lit(f"{d}:"), f"s_{d}")], F.lit(0.0))
    rows = rows.withColumn("psf", F.exp(log_psf)).filter(F.col("psf").between(low, high))
    band = lambda sign: F.col("psf") * F.exp(sign * F.col("sd")) * F.col("s_area_sqft")
    return rows.select("s_id", F.lit("A1").alias("method"), "psf", band(-1).alias("low"), band(1).alias("high"), F.lit(0).cast("long").alias("n_comps"))


def feature_scales(dates: DataFrame, comps: DataFrame, least: int) -> DataFrame:
    """(as_of, v_area, v_floor, v_lease, v_time, v_segment, v_tenure): population variances of what is visible at a date;
    those of a category's indicators stand in a map. Sums a month and category come first."""
    nums = {"area": F.log("area_sqft"), "floor": mid_floor(), "lease": lease_age(), "time": F.col("month_idx").cast("double")}
    months = comps.groupBy("contract_month", "market_segment", "tenure_type").agg(F.count("*").alias("n"), *(F.sum(c).alias(f"s_{k}") for k, c in nums.items()), *(F.sum(c * c).alias(f"ss_{k}") for k, c in nums.items()))
    seen = months.join(F.broadcast(dates), visible("contract_month", "as_of"))
    total = seen.groupBy("as_of").agg(F.sum("n").alias("n"), *(F.sum(f"{p}_{k}").alias(f"{p}_{k}") for k in nums for p in ("s", "ss"))).filter(F.col("n") >= least)
    var = lambda k: F.greatest(F.col(f"ss_{k}") / F.col("n") - F.pow(F.col(f"s_{k}") / F.col("n"), 2), F.lit(1e-18)).alias(f"v_{k}")
    out = total.select("as_of", "n", *(var(k) for k in nums))
    for k, name in (("market_segment", "v_segment"), ("tenure_type", "v_tenure")):
        level = seen.groupBy("as_of", k).agg(F.sum("n").alias("k")).join(total.select("as_of", "n"), "as_of")
        share = F.col("k") / F.col("n")
        out = out.join(level.groupBy("as_of").agg(F.map_from_entries(F.collect_list(F.struct(F.col(k), F.greatest(share * (1 - share), F.lit(1e-18))))).alias(name)), "as_of")
    return out.drop("n")


def a3_knn(subjects: DataFrame, comps: DataFrame, index: DataFrame, k: int = 40, near: float = 2000.0, wide: float = 5000.0, pool: int = 80, least: int = 5, population: int = 200, penalty: float = 1.0) -> DataFrame:
    """Median of the k comparables nearest in scaled features, of those within near metres, or wide if near holds fewer than
    pool. Other districts pay a penalty; equal distances, to nine decimals, go to the newest. Pools are counted by place and date before any
    subject meets a comparable, and the top k are cut within each task before they shuffle."""
    dates = subjects.select("as_of").distinct()
    sites = comps.groupBy("x", "y", "contract_month").agg(F.count("*").alias("n")).join(F.broadcast(dates), visible("contract_month", "as_of")).groupBy("x", "y", "as_of").agg(F.sum("n").alias("n"))
    around = F.array(F.lit(-1), F.lit(0), F.lit(1))
    cell = lambda c, r: F.floor(F.col(c) / r)
    d = F.hypot(F.col("x") - F.col("s_x"), F.col("y") - F.col("s_y"))

    def spread(rows: DataFrame, r: float) -> DataFrame:
        return rows.withColumn("dx", F.explode(around)).withColumn("dy", F.explode(around)).withColumn("s_cx", cell("s_x", r) + F.col("dx")).withColumn("s_cy", cell("s_y", r) + F.col("dy")).drop("dx", "dy")

    places = spread(subjects.select("s_x", "s_y", "as_of").distinct(), near)
    held = sites.withColumn("s_cx", cell("x", near)).withColumn("s_cy", cell("y", near))
    thick = places.join(held, ["as_of", "s_cx", "s_cy"]).filter(d <= near).groupBy("s_x", "s_y", "as_of").agg(F.sum("n").alias("held")).filter(F.col("held") >= pool).select("s_x", "s_y", "as_of")
    scaled = subjects.join(F.broadcast(feature_scales(dates, comps, population)), "as_of")

    def meet(rows: DataFrame, r: float) -> DataFrame:
        return A.pairs(spread(rows, r), comps.withColumn("cx", cell("x", r)).withColumn("cy", cell("y", r)), ["cx", "cy"], None, d <= r)

    keys = ["s_x", "s_y", "as_of"]
    pairs = meet(scaled.join(thick, keys, "left_semi"), near).unionByName(meet(scaled.join(thick, keys, "left_anti"), wide))
    square = lambda a, b, v: F.pow(a - b, 2) / F.col(v)
    gap = square(F.log("s_area_sqft"), F.log("area_sqft"), "v_area") + square(mid_floor("s_"), mid_floor(), "v_floor") + square(lease_age("s_"), lease_age(), "v_lease") + square(F.col("asof_idx"), F.col("month_idx"), "v_time")
    for c, v in (("market_segment", "v_segment"), ("tenure_type", "v_tenure")):
        rare = lambda x, v=v: 1 / F.coalesce(F.col(v)[F.col(x)], F.lit(1e-18))
        gap = gap + F.when(F.col(f"s_{c}") == F.col(c), 0.0).otherwise(rare(f"s_{c}") + rare(c))
    far = F.round(F.sqrt(gap) + F.when(F.col("s_district").eqNullSafe(F.col("district")), 0.0).otherwise(penalty), 9)
    order = Window.partitionBy("s_id").orderBy("far", F.desc("contract_month"), F.desc("id"))
    best = pairs.select("s_id", "s_area_sqft", "as_of", "q", "psf", "contract_month", "id", far.alias("far")).withColumn("rn", F.row_number().over(order)).filter(F.col("rn") <= k)
    return A.estimate(A.time_factor(best, index).withColumn("value", F.col("psf") * F.col("tf")), "A3", "value").filter(F.col("n_comps") >= least)


def grid_weight(n: str = "a_n_comps") -> Column:
    out = F.lit(0.75)
    for bucket, w in GRID_WEIGHTS.items():
        out = F.when(liquidity(n) == bucket, w).otherwise(out)
    return out


def side_by_side(estimates: dict[str, DataFrame]) -> DataFrame:
    """One row a subject with a struct a method, null where it declined: one shuffle for all methods."""
    rows = None
    for name, e in estimates.items():
        part = e.select("s_id", F.lit(name).alias("m"), F.struct(F.col("psf").cast("double").alias("psf"), F.col("low").cast("double").alias("low"), F.col("high").cast("double").alias("high"), F.col("n_comps").cast("long").alias("n")).alias("e"))
        rows = part if rows is None else rows.unionByName(part)
    return rows.groupBy("s_id").agg(*(F.first(F.when(F.col("m") == n, F.col("e")), ignorenulls=True).alias(n) for n in estimates))


def middle(values: Column) -> Column:
    """The median of the non-null entries of an array."""
    s = F.array_sort(F.array_compact(values))
    n = F.size(s)
    return F.when(n > 0, (F.get(s, F.floor((n - 1) / 2).cast("int")) + F.get(s, F.floor(n / 2).cast("int"))) / 2)


def e3_blend(grid: DataFrame, anchors: dict[str, DataFrame]) -> DataFrame:
    """The grid with the median of the anchors. Without the grid the band joins those of the first and last anchor that
    answer; one anchor alone gives none."""
    rows, names = side_by_side({"c1": grid, **anchors}), list(anchors)
    reads = F.array_compact(F.array(*names))
    consensus, w = middle(F.array(*(F.col(n)["psf"] for n in names))), grid_weight("c1.n")
    first, last = F.get(reads, F.lit(0)), F.get(reads, F.size(reads) - 1)
    alone = lambda f, c: F.when(F.size(reads) > 1, f(first[c], last[c]))
    band = lambda f, c: F.when(F.col("c1").isNull(), alone(f, c)).otherwise(f(*(F.col(n)[c] for n in ("c1", *names))))
    psf = F.when(F.col("c1").isNull(), consensus).when(consensus.isNull(), F.col("c1.psf")).otherwise(w * F.col("c1.psf") + (1 - w) * consensus)
    return rows.select("s_id", F.lit("E3").alias("method"), psf.alias("psf"), band(F.least, "low").alias("low"), band(F.greatest, "high").alias("high"), F.coalesce("c1.n", F.lit(0)).alias("n_comps"))


def v2_engine(subjects: DataFrame, grid: DataFrame, leasehold: dict[str, DataFrame], other: list[str], cell: str = "s_market_segment") -> DataFrame:
    """The grid, else the first anchor that answers: in the order given for leasehold, in the order of other for the rest.
    Bands come from the grid's own calibration; a fallback takes the wider of that and its anchor's band."""
    rows = E.walk_forward(subjects, [grid], ["C1"])
    reads = side_by_side({"c1": grid, **leasehold})
    pick = lambda names: F.coalesce(*(F.when(F.col(n).isNotNull(), F.struct(F.lit(n).alias("source"), F.col(f"{n}.psf").alias("psf"), F.col(f"{n}.low").alias("alow"), F.col(f"{n}.high").alias("ahigh"))) for n in names))
    chosen = reads.join(subjects.select("s_id", "s_area_sqft", "s_tenure_type", cell), "s_id").withColumn("b", F.when(F.col("c1").isNotNull(), pick(["c1"])).when(F.col("s_tenure_type") == "leasehold", pick(list(leasehold))).otherwise(pick(other)))
    out = chosen.filter("b is not null").select("s_id", cell, "b.*", F.coalesce("c1.n", F.lit(0)).alias("n_comps"), (F.col("b.psf") * F.col("s_area_sqft")).alias("pred"))
    banded = E.conformal_apply(out, E.conformal_fit(rows, cell), cell)
    wider = lambda f, own, anchor: F.when(F.col("source") == "c1", F.col(own)).otherwise(f(own, anchor))
    return banded.select("s_id", F.lit("V2").alias("method"), "psf", wider(F.least, "lo", "alow").alias("low"), wider(F.greatest, "hi", "ahigh").alias("high"), "n_comps", "source")


def lv1_engine(subjects: DataFrame, points: DataFrame, widen: float = 1.6, big: float = BIG_PLOT, least: int = 40) -> DataFrame:
    """Curve-else-ladder points with the calibrated band of liquidity and type; large plots have it widened about 1. A
    fallback counts as no comparable."""
    points = kept(points.withColumn("n_comps", F.when(F.col("fallback"), 0).otherwise(F.col("n_comps"))), "points")  # the fit reads them, then the bands
    rows = E.walk_forward(subjects, [points.drop("fallback")], ["LV1"])
    out = E.conformal_apply(rows.filter("pred is not null"), E.conformal_fit(rows, "s_property_type", 0.10, 0.90), "s_property_type", least)
    wider = lambda c: F.col("pred") * (1 + (F.col(c) / F.col("pred") - 1) * F.when(F.col("s_area_sqft") >= big, widen).otherwise(1.0))
    return out.select("s_id", "method", "psf", wider("lo").alias("low"), wider("hi").alias("high"), "n_comps")


def solve_months(entries: pd.DataFrame) -> pd.DataFrame:
    """Month effects with mean zero, then a centred median of three, from one date's reduced normal equations."""
    months = np.sort(entries["a"].unique())
    at = {m: i for i, m in enumerate(months)}
    s, r = np.zeros((len(months), len(months))), np.zeros(len(months))
    for a, b, v in entries[["a", "b", "v"]].itertuples(index=False):
        if b < 0:
            r[at[a]] += v
        else:
            s[at[a], at[b]] += v
    effect = np.linalg.lstsq(s, r, rcond=1e-10)[0]
    effect = pd.Series(effect - effect.mean())
    return pd.DataFrame({"as_of": entries["as_of"].iloc[0], "month_idx": months.astype("int32"), "effect": effect, "level": effect.rolling(3, center=True, min_periods=1).median()})


def local_trend(rows: DataFrame, dates: DataFrame, keys: list[str], window: int = 72, least_terminal: int = 5) -> DataFrame:
    """(as_of, month_idx, effect, level): two-way fixed effects of log price by group and month, of what is visible at each date.

    Groups of one sale and a thin last month drop out. Group effects are eliminated by sums in Spark; what is left to solve
    has as many unknowns as the window has months. Sales move once, by group; a group is then one row with a cell a month, of which
    each date takes what it sees."""
    sales = rows.select(*keys, "contract_month", "month_idx", F.log("psf").alias("y")).repartition(*keys)
    cells = sales.groupBy(*keys, "contract_month", "month_idx").agg(F.count("*").alias("n"), F.sum("y").alias("y"))
    known = F.date_add(F.last_day("contract_month"), A.LAG_DAYS).alias("known")
    packed = cells.groupBy(*keys).agg(F.collect_list(F.struct(known, "month_idx", "n", "y")).alias("ms"))  # a cell a month of the history
    dates = dates.select("as_of", month_idx("as_of").alias("asof_idx")).distinct()
    age = lambda m: F.col("asof_idx") - m["month_idx"]
    total = lambda c, kind: F.aggregate("ms", F.lit(0).cast(kind), lambda t, m: t + m[c])
    seen = packed.crossJoin(F.broadcast(dates)).withColumn("ms", F.filter("ms", lambda m: (m["known"] <= F.col("as_of")) & (age(m) >= 0) & (age(m) < window)))
    seen = seen.select("as_of", "ms").filter(total("n", "long") >= 2)
    ends = seen.select("as_of", F.explode("ms").alias("m")).groupBy("as_of", "m.month_idx").agg(F.sum("m.n").alias("k")).groupBy("as_of").agg(F.max(F.struct("month_idx", "k")).alias("end"), F.count("*").alias("months"))
    thin = ends.filter((F.col("end.k") < least_terminal) & (F.col("months") > 1)).select("as_of", F.col("end.month_idx").alias("thin"))
    seen = seen.join(F.broadcast(thin), "as_of", "left").withColumn("ms", F.filter("ms", lambda m: F.col("thin").isNull() | (m["month_idx"] != F.col("thin"))))
    one = seen.select("as_of", "ms", total("n", "long").alias("gn"), total("y", "double").alias("gy")).withColumn("a", F.explode("ms"))
    pairs = one.withColumn("b", F.explode("ms")).select("as_of", F.col("a.month_idx").alias("a"), F.col("b.month_idx").alias("b"), (F.when(F.col("a.month_idx") == F.col("b.month_idx"), F.col("a.n")).otherwise(0) - F.col("a.n") * F.col("b.n") / F.col("gn")).alias("v"))
    sides = one.select("as_of", F.col("a.month_idx").alias("a"), F.lit(-1).alias("b"), (F.col("a.y") - F.col("a.n") * F.col("gy") / F.col("gn")).alias("v"))
    entries = pairs.unionByName(sides).groupBy("as_of", "a", "b").agg(F.sum("v").alias("v"))
    return entries.groupBy("as_of").applyInPandas(solve_months, "as_of date, month_idx int, effect double, level double")


def bridge(rows: DataFrame, trend: DataFrame, index: DataFrame, low: float = 0.80, high: float = 1.25) -> DataFrame:
    """Adds value: the price moved by the capped index to the last published quarter, and from there, or from the comparable's
    own month if later, to the valuation date by the observed trend. Months outside the trend take its nearest end."""
    back = Window.partitionBy("as_of").orderBy("month_idx").rowsBetween(Window.unboundedPreceding, 0)
    ends = trend.groupBy("as_of").agg(F.min("month_idx").alias("m0"), F.max("month_idx").alias("m1"))
    spine = ends.select("as_of", F.explode(F.sequence("m0", "m1")).alias("month_idx")).join(trend.select("as_of", "month_idx", "level"), ["as_of", "month_idx"], "left").withColumn("level", F.last("level", ignorenulls=True).over(back))
    dated = A.time_factor(rows, index).join(F.broadcast(A.asof_quarters(trend, index)), "as_of", "left").join(F.broadcast(ends), "as_of", "left")
    middle_month = F.floor(F.col("asof_q") / 4) * 12 + (F.col("asof_q") % 4) * 3 + 1
    inside = lambda m: F.least(F.greatest(m, F.col("m0")), F.col("m1"))
    dated = dated.withColumn("from_m", inside(F.greatest(F.col("month_idx"), F.coalesce(middle_month, F.col("month_idx"))))).withColumn("to_m", inside(month_idx("as_of")))
    for end in ("from", "to"):
        dated = dated.join(F.broadcast(spine.select("as_of", F.col("month_idx").alias(f"{end}_m"), F.col("level").alias(f"{end}_level"))), ["as_of", f"{end}_m"], "left")
    moved = F.coalesce(F.exp(F.col("to_level") - F.col("from_level")), F.lit(1.0))
    return dated.withColumn("moved", moved).withColumn("value", F.col("psf") * F.least(F.greatest(F.col("tf"), F.lit(low)), F.lit(high)) * moved)


def nominal_sweep(rows: DataFrame, cell: str, nominals: list[tuple[float, float]], cut: str = "2000-01-01") -> DataFrame:
    """Held-out coverage and width of each pair of quantiles, calibrated by cell before the cut."""
    flat = F.array(*(F.lit(q) for pair in nominals for q in pair))
    early = F.col("s_contract_month") < F.lit(cut).cast("date")
    ok = rows.filter("pred is not null")
    fit = ok.filter(early).groupBy(cell).agg(F.percentile(F.col("s_price") / F.col("pred"), flat).alias("r"))
    test = ok.filter(~early).join(F.broadcast(fit), cell).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(len(nominals) - 1))))  # the fit has a row a cell
    lo, hi = F.col("pred") * F.get("r", F.col("k") * 2), F.col("pred") * F.get("r", F.col("k") * 2 + 1)
    inside = F.avg(F.col("s_price").between(lo, hi).cast("double"))
    return test.groupBy(F.get(flat, F.col("k") * 2).alias("lo_q"), F.get(flat, F.col("k") * 2 + 1).alias("hi_q")).agg(inside.alias("coverage"), F.avg((hi - lo) / F.col("s_price")).alias("width"), F.count("*").alias("n"))


def weight_search(grid: DataFrame, anchor: DataFrame, subjects: DataFrame, steps: int = 20) -> DataFrame:
    """The grid's weight of least median error a liquidity bucket; ties go to the smaller weight."""
    both = grid.filter("psf is not null").select("s_id", "n_comps", F.col("psf").alias("a")).join(anchor.filter("psf is not null").select("s_id", F.col("psf").alias("b")), "s_id").join(subjects.select("s_id", (F.col("s_price") / F.col("s_area_sqft")).alias("actual")), "s_id")
    w = F.col("k") / steps
    errors = both.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(steps)))).groupBy(liquidity("n_comps").alias("liq"), "k").agg(F.percentile(F.abs(w * F.col("a") + (1 - w) * F.col("b") - F.col("actual")) / F.col("actual"), F.lit(0.5)).alias("err"), F.count("*").alias("n"))
    return errors.groupBy("liq").agg(F.min(F.struct(F.round("err", 12).alias("err"), "k", "n")).alias("b")).select("liq", (F.col("b.k") / steps).alias("weight"), F.col("b.err").alias("median_ape"), F.col("b.n").alias("n"))


def cap_exposure(pairs: DataFrame, low: float = 0.80, high: float = 1.25) -> DataFrame:
    """By half-year of the subjects: the share of weight whose index factor meets the cap, and the log gap it cuts away."""
    w, out = F.pow(F.lit(0.5), F.col("age") / 18), ~F.col("tf").between(low, high)
    gap = F.when(out, F.log(F.col("tf") / A.capped())).otherwise(0.0)
    each = pairs.groupBy("s_id", "s_contract_month").agg((F.sum(F.when(out, w).otherwise(0.0)) / F.sum(w)).alias("share"), (F.sum(w * gap) / F.sum(w)).alias("gap"))
    half = F.concat(F.year("s_contract_month").cast("string"), F.when(F.month("s_contract_month") <= 6, "H1").otherwise("H2"))
    return each.groupBy(half.alias("half")).agg(F.count("*").alias("n"), F.avg("share").alias("share"), F.avg("gap").alias("gap"), F.percentile("gap", F.lit(0.9)).alias("p90_gap"))


def variant_sweep(pairs: DataFrame, caps: list[float], low: float = 0.80) -> DataFrame:
    """Errors of the size-curve estimate under several upper caps of the time factor: the cap is part of the key, so that one
    job serves all variants; pairs stay where they met."""
    moved = pairs.withColumn("cap", F.explode(F.array(*map(F.lit, caps)))).withColumn("value", F.col("value") / A.capped() * F.least(F.greatest(F.col("tf"), F.lit(low)), F.col("cap"))).withColumn("w", F.pow(F.lit(0.5), F.col("age") / 18))
    est = A.weighted_quantiles(moved, [*E.STREET, "cap", "s_id", "s_area_sqft", "s_price"], "value", "w", "w", psf=0.5)  # equal values of equal weight give the same sums in any order
    signed = F.col("psf") * F.col("s_area_sqft") / F.col("s_price") - 1
    return est.groupBy("cap").agg(F.count("*").alias("n"), F.percentile(F.abs(signed), F.lit(0.5)).alias("median_ape"), F.percentile(signed, F.lit(0.5)).alias("median_signed"))


def pool_split(pairs: DataFrame, own: Column) -> DataFrame:
    """Quartiles of each subject's comparables, all of them and its own kind alone, and how far the latter move."""
    q = lambda c: F.percentile(c, F.array(F.lit(0.25), F.lit(0.75)))
    each = pairs.groupBy("s_id").agg(F.count("*").alias("n"), F.count(F.when(own, 1)).alias("n_own"), q("value").alias("a"), q(F.when(own, F.col("value"))).alias("b"))
    return each.filter("n_own >= 4").select("s_id", "n", "n_own", (F.col("b")[0] / F.col("a")[0] - 1).alias("low_moves"), (F.col("b")[1] / F.col("a")[1] - 1).alias("high_moves"))
