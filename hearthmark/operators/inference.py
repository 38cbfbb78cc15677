"""Small regressions with inference from sums alone: fits, bootstrap intervals and leave-one-cluster-out signs.

A regression of a few columns needs the sums of their products only. So a fit is one aggregation, a bootstrap draw is the same
sums under weights of its own, and leaving a cluster out is a subtraction. Sums are taken about the group's means, as sums
of squares of large numbers would cancel. Rows with a null in any column take no part; a group whose columns are
constant or dependent has null coefficients.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import md5
from math import exp, factorial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DRAWS, SEED = 2000, 42
PRIME = 2**31 - 1
SINGULAR = 1e-10  # least pivot among correlations
#: A uniform number below PRIME gives a weight: how many of these bounds it reaches, which is Poisson with mean 1.
BOUNDS = [int(PRIME * sum(exp(-1) / factorial(i) for i in range(j + 1))) for j in range(9)]


def complete(rows: DataFrame, by: str, xs: list[str], y: str) -> DataFrame:
    """Rows without nulls with z, the regressors and y less the group's means, and these means as centre."""
    cols = [F.col(c).cast("double") for c in (*xs, y)]
    rows = rows.dropna(subset=[by, *xs, y])
    means = rows.groupBy(by).agg(F.array(*map(F.avg, cols)).alias("centre"))
    return rows.join(means, by).withColumn("z", F.array(*(c - F.col("centre")[i] for i, c in enumerate(cols))))


def sums(width: int, weight: Column | None = None) -> list[Column]:
    """Aggregates m: the weight, the weighted sums of z and, row by row of the upper triangle, those of its products."""
    z = [F.col("z")[i] for i in range(width)]
    w = F.lit(1.0) if weight is None else weight
    return [F.array(F.sum(w), *(F.sum(w * a) for a in z), *(F.sum(w * z[i] * z[j]) for i in range(width) for j in range(i, width))).alias("m")]


FIT = "coef array<double>, std_coef array<double>, intercept double, r2 double"


def solve_all(m: np.ndarray, centre: np.ndarray) -> tuple[np.ndarray, ...]:
    """coef, std_coef, intercept and r2 of every row of sums m; NaN where there is none.

    The correlations of all rows are swept together by Gauss and Jordan; the last column is then the solution.
    """
    width = centre.shape[1]
    k, (i, j) = width - 1, np.triu_indices(width)
    with np.errstate(all="ignore"):
        mean = m[:, 1 : width + 1] / m[:, :1]
        cov = np.empty((len(m), width, width))
        cov[:, i, j] = cov[:, j, i] = m[:, width + 1 :] / m[:, :1] - mean[:, i] * mean[:, j]
        sd = np.sqrt(np.maximum(np.einsum("rii->ri", cov), 0))
        scale = sd[:, :, None] * sd[:, None, :]
        corr = np.where(scale > 0, cov / scale, 0.0)
        a = corr.copy()
        for p in range(k):
            pivot = np.where(a[:, p, p] > SINGULAR, a[:, p, p], np.nan)
            row = a[:, p, :] / pivot[:, None]
            a = a - a[:, :, p : p + 1] * row[:, None, :]
            a[:, p, :] = row
        std = a[:, :k, k] * sd[:, k:]
        coef = std / np.where(sd[:, :k] > 0, sd[:, :k], np.nan)
        intercept = centre[:, k] + mean[:, k] - (coef * (centre[:, :k] + mean[:, :k])).sum(axis=1)
        r2 = np.where(sd[:, k] > 0, (a[:, :k, k] * corr[:, :k, k]).sum(axis=1), np.nan)
    return coef, std, intercept, r2


def solved(rows: DataFrame) -> DataFrame:
    """Adds coef, std_coef (of regressors scaled to deviation 1), intercept and r2 to rows with sums m and a centre."""

    @F.pandas_udf(FIT)
    def run(m: pd.Series, centre: pd.Series) -> pd.DataFrame:
        coef, std, intercept, r2 = solve_all(np.stack(m), np.stack(centre)) if len(m) else ([], [], [], [])
        lists = lambda x: [None if np.isnan(r).any() else r.tolist() for r in x]
        numbers = lambda x: [None if np.isnan(v) else float(v) for v in x]
        return pd.DataFrame({"coef": pd.Series(lists(coef), dtype=object), "std_coef": pd.Series(lists(std), dtype=object), "intercept": pd.Series(numbers(intercept), dtype=object), "r2": pd.Series(numbers(r2), dtype=object)})

    return rows.filter(F.col("m")[0] > 0).withColumn("fit", run("m", "centre")).select("*", "fit.*").drop("m", "fit")


def ols_fit(rows: DataFrame, by: str, xs: list[str], y: str) -> DataFrame:
    """(by, term, coef, std_coef, n, r2, adj_r2) of each group's least-squares fit with intercept."""
    fit = solved(complete(rows, by, xs, y).groupBy(by).agg(*sums(len(xs) + 1), F.count("*").alias("n"), F.first("centre").alias("centre")))
    free = F.col("n") - len(xs) - 1
    fit = fit.withColumn("adj_r2", F.when(free > 0, 1 - (1 - F.col("r2")) * (F.col("n") - 1) / free))
    terms = F.array(F.struct(F.lit("intercept").alias("term"), F.col("intercept").alias("coef"), F.lit(None).cast("double").alias("std_coef")), *(F.struct(F.lit(x).alias("term"), F.col("coef")[i].alias("coef"), F.col("std_coef")[i].alias("std_coef")) for i, x in enumerate(xs)))
    return fit.select(by, F.explode(terms).alias("t"), "n", "r2", "adj_r2").select(by, "t.term", "t.coef", "t.std_coef", "n", "r2", "adj_r2")


def row_key(name: str) -> Column:
    """A number below PRIME from a row's id."""
    return (F.conv(F.substring(F.md5(F.col(name).cast("string")), 1, 12), 16, 10).cast("long") % PRIME).alias("key")


def factors(draws: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """The two numbers of each draw by which a row's key becomes its uniform number."""
    number = lambda d, part: int(md5(f"{seed}:{d}:{part}".encode()).hexdigest()[:7], 16) + 1
    return tuple(np.array([number(d, p) for d in range(draws)], np.int64) for p in "ab")


def draw_weights(keys: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Weights, a row for each draw: any two rows' are independent, and a row has the same wherever it is computed."""
    u = (keys[None, :] * a[:, None] + b[:, None]) % PRIME
    out = np.zeros(u.shape, np.int8)
    for bound in BOUNDS:
        out += u >= bound
    return out


def bootstrap_draws(rows: DataFrame, by: str, xs: list[str], y: str, *, id_col: str = "id", draws: int = DRAWS, seed: int = SEED) -> DataFrame:
    """(by, draw, coef, std_coef): the fit of every draw, from one pass over the rows.

    Each task multiplies its rows' products by a block of weights, so that what it sends on is a row of sums for each group and
    draw, whatever the number of rows.
    """
    width = len(xs) + 1
    top = np.triu_indices(width)
    a, b = factors(draws, seed)
    names = [f"m{i}" for i in range(1 + width + len(top[0]))]

    def flush(held: dict) -> Iterator[pd.DataFrame]:
        for group, total in held.items():
            frame = pd.DataFrame(total, columns=names)
            frame.insert(0, "draw", np.arange(draws, dtype=np.int32))
            frame.insert(0, by, group)
            yield frame

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict = {}
        for frame in frames:
            for group, part in frame.groupby(by, sort=False):
                z = np.stack(part["z"])
                products = np.column_stack([np.ones(len(z)), z, z[:, top[0]] * z[:, top[1]]])
                keys = part["key"].to_numpy()
                total = held.setdefault(group, np.zeros((draws, len(names))))
                for s in range(0, len(z), 1024):
                    total += draw_weights(keys[s : s + 1024], a, b).astype(float) @ products[s : s + 1024]
            if len(held) > 32:
                yield from flush(held)
                held.clear()
        yield from flush(held)

    given = complete(rows, by, xs, y)
    kind = dict(given.dtypes)[by]
    made = given.select(by, row_key(id_col), "z").mapInPandas(run, f"{by} {kind}, draw int, {', '.join(f'{n} double' for n in names)}")
    total = made.groupBy(by, "draw").agg(F.array(*map(F.sum, names)).alias("m"))
    centres = given.groupBy(by).agg(F.first("centre").alias("centre"))
    return solved(total.join(centres, by)).select(by, "draw", "coef", "std_coef")


def bootstrap_ci(rows: DataFrame, by: str, xs: list[str], y: str, **how) -> DataFrame:
    """(by, term, low, high, significant, draws): percentile intervals of 95 % from the sorted draws that have a fit.

    An interval ends at places int(0.025 n) and int(0.975 n) of the n sorted draws, counted from 0; one that leaves out zero is significant.
    """
    fits = bootstrap_draws(rows, by, xs, y, **how).filter("coef IS NOT NULL")
    terms = F.array(*(F.struct(F.lit(x).alias("term"), F.col("coef")[i].alias("c")) for i, x in enumerate(xs)))
    lists = fits.select(by, F.explode(terms).alias("t")).groupBy(by, "t.term").agg(F.sort_array(F.collect_list("t.c")).alias("d"))  # as many as draws
    place = lambda share: F.col("d")[F.floor(F.lit(share) * F.size("d")).cast("int")]
    out = lists.select(by, "term", place(0.025).alias("low"), place(0.975).alias("high"), F.size("d").alias("draws"))
    return out.select(by, "term", "low", "high", ((F.col("low") > 0) | (F.col("high") < 0)).alias("significant"), "draws")


def leave_one_out(rows: DataFrame, by: str, cluster: str, xs: list[str], y: str, spare: int = 3) -> DataFrame:
    """(by, term, n_fits, sign_stable, coef_min, coef_max) of fits that leave out one cluster each.

    A cluster's sums are taken off the group's. Fits with fewer rows than regressors and spare are left out; coefficients are
    of regressors scaled within the fit. A null cluster is one of its own.
    """
    width = len(xs) + 1
    own = complete(rows, by, xs, y).groupBy(by, cluster).agg(*sums(width), F.first("centre").alias("centre"))
    total = own.groupBy(by).agg(F.array(*(F.sum(F.col("m")[i]) for i in range(1 + width + width * (width + 1) // 2))).alias("all"))
    rest = own.join(total, by).select(by, "centre", F.zip_with("all", "m", lambda a, b: a - b).alias("m")).filter(F.col("m")[0] >= len(xs) + spare)
    fits = solved(rest).filter("std_coef IS NOT NULL")
    terms = F.array(*(F.struct(F.lit(x).alias("term"), F.col("std_coef")[i].alias("c")) for i, x in enumerate(xs)))
    low, high = F.min("t.c"), F.max("t.c")
    return fits.select(by, F.explode(terms).alias("t")).groupBy(by, "t.term").agg(F.count("*").alias("n_fits"), ((low > 0) | (high < 0)).alias("sign_stable"), low.alias("coef_min"), high.alias("coef_max"))


def strength(rho: Column) -> Column:
    """A rank correlation in words."""
    # fixed values: the bounds of the words
    return F.when(rho.isNull(), "insufficient").when(F.abs(rho) >= 0.5, "strong").when(F.abs(rho) >= 0.3, "moderate").otherwise("weak")
