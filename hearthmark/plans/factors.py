"""Queries of price factors: fits, bootstrap intervals, leave-one-out signs and labels, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from hearthmark.operators import asof as A
from hearthmark.operators import effects as X
from hearthmark.operators import inference as I
from hearthmark.plans.caveats import CAVEATS_SQL, caveats

QUERIES, ORACLES = {}, {}
XS, Y, BY, CLUSTER = ["ln_area", "floor", "year", "leasehold"], "ln_psf", "market_segment", "district"


def factor_rows(spark, sf_dir):
    """Log price a square foot and its regressors, one row a sale."""
    rows = A.hygiene(caveats(spark, sf_dir))
    return rows.select("id", BY, CLUSTER, F.log("psf").alias("ln_psf"), F.log("area_sqft").alias("ln_area"), ((F.col("floor_lo") + F.col("floor_hi")) / 2).alias("floor"), (F.col("month_idx") / 12).alias("year"), F.when(F.col("tenure_type") == "leasehold", 1.0).otherwise(0.0).alias("leasehold"))


Z = [*XS, Y]
K = len(XS)
ROWS = f"""{CAVEATS_SQL}, f AS (SELECT id, {BY}, {CLUSTER}, ln(psf) AS ln_psf, ln(area_sqft) AS ln_area, (floor_lo + floor_hi) / 2 AS floor, month_idx / 12 AS year,
  CASE WHEN tenure_type = 'leasehold' THEN 1.0 ELSE 0.0 END AS leasehold FROM caveats WHERE no_of_units <= 1 AND psf BETWEEN 500 AND 6500),
centre AS (SELECT {BY}, {', '.join(f'avg({c}) AS c{i}' for i, c in enumerate(Z))} FROM f GROUP BY 1),
g AS (SELECT id, f.{BY}, {CLUSTER}, {', '.join(f'{c} - c{i} AS z{i}' for i, c in enumerate(Z))} FROM f JOIN centre USING ({BY}))"""


def sums_sql(weight: str) -> str:
    """The weight w, sums s0.. and products p00.. of the columns z0.."""
    return f"sum({weight}) AS w, " + ", ".join(f"sum({weight} * z{i}) AS s{i}" for i in range(K + 1)) + ", " + ", ".join(f"sum({weight} * z{i} * z{j}) AS p{i}{j}" for i in range(K + 1) for j in range(i, K + 1))


def solve_sql(source: str, keys: str) -> str:
    """CTEs from sums to fit(keys, sd0.., mean0.., std array, corr): a recursive elimination over the correlation matrix."""
    pos = lambda i, j: f"p{min(i, j)}{max(i, j)}"
    r = range(K + 1)
    return f"""
means AS (SELECT {keys}, {', '.join(f's{i} / w AS mean{i}' for i in r)}, {', '.join(f'{pos(i, j)} / w - s{i} / w * s{j} / w AS v{i}{j}' for i in r for j in r)} FROM {source} WHERE w > 0),
sds AS (SELECT *, {', '.join(f'sqrt(greatest(v{i}{i}, 0)) AS sd{i}' for i in r)} FROM means),
corrs AS (SELECT {keys}, {', '.join(f'mean{i}, sd{i}' for i in r)}, [{', '.join('[' + ', '.join(f'CASE WHEN sd{i} * sd{j} > 0 THEN v{i}{j} / (sd{i} * sd{j}) ELSE 0 END' for j in r) + ']' for i in r)}] AS corr FROM sds),
gauss AS (
  SELECT *, corr AS m, 1 AS p FROM corrs
  UNION ALL
  SELECT * EXCLUDE (m, p), CASE WHEN m[p][p] > {I.SINGULAR} THEN list_transform(m, lambda row, i: list_transform(row, lambda v, j: CASE WHEN i = p THEN v / m[p][p] ELSE v - row[p] * m[p][j] / m[p][p] END)) END, p + 1 FROM gauss WHERE p <= {K}
), fit AS (SELECT * EXCLUDE (m, p), m AS swept FROM gauss WHERE p = {K + 1})"""


def query(name: str, sql: str):
    def add(f):
        QUERIES[name] = f
        ORACLES[name] = sql
        return f

    return add


std = lambda i: f"swept[{i + 1}][{K + 1}] * sd{K}"
coef = lambda i: f"{std(i)} / sd{i}"
R2 = " + ".join(f"swept[{i + 1}][{K + 1}] * corr[{i + 1}][{K + 1}]" for i in range(K))

query("ols_fit", f"""WITH RECURSIVE {ROWS}, sums AS (SELECT {BY}, {sums_sql('1.0')} FROM g GROUP BY 1), {solve_sql('sums', BY)},
full_fit AS (SELECT fit.{BY} AS seg, n, {R2} AS r2, {', '.join(f'{std(i)} AS b{i}, {coef(i)} AS c{i}' for i in range(K))}, centre.c{K} + mean{K} - ({' + '.join(f'{coef(i)} * (centre.c{i} + mean{i})' for i in range(K))}) AS c_int
  FROM fit JOIN centre USING ({BY}) JOIN (SELECT {BY}, count(*) AS n FROM f GROUP BY 1) USING ({BY})),
terms AS (SELECT seg, 'intercept' AS term, c_int AS coef, CAST(NULL AS DOUBLE) AS std_coef, n, r2 FROM full_fit {' '.join(f"UNION ALL SELECT seg, '{x}', c{i}, b{i}, n, r2 FROM full_fit" for i, x in enumerate(XS))})
SELECT seg AS {BY}, term, coef, std_coef, n, r2, 1 - (1 - r2) * (n - 1) / (n - {K + 1}) AS adj_r2 FROM terms""")(lambda s, d: I.ols_fit(factor_rows(s, d), BY, XS, Y))

hexed = lambda text, n: f"CAST('0x' || substr(md5({text}), 1, {n}) AS BIGINT)"
WEIGHT = "(" + " + ".join(f"CAST(u >= {b} AS INTEGER)" for b in I.BOUNDS) + ")"
query("bootstrap_ci", f"""WITH RECURSIVE {ROWS},
keyed AS (SELECT *, {hexed('id', 12)} % {I.PRIME} AS key FROM g),
draws AS (SELECT d, {hexed(f"'{I.SEED}:' || d || ':a'", 7)} + 1 AS a, {hexed(f"'{I.SEED}:' || d || ':b'", 7)} + 1 AS b FROM range({I.DRAWS}) t(d)),
drawn AS (SELECT * EXCLUDE (u), CAST({WEIGHT} AS DOUBLE) AS k FROM (SELECT d, keyed.*, (key * a + b) % {I.PRIME} AS u FROM keyed CROSS JOIN draws)),
sums AS (SELECT {BY}, d, {sums_sql('k')} FROM drawn GROUP BY 1, 2), {solve_sql('sums', f'{BY}, d')},
terms AS ({' UNION ALL '.join(f"SELECT {BY}, '{x}' AS term, {coef(i)} AS c FROM fit WHERE swept IS NOT NULL" for i, x in enumerate(XS))}),
lists AS (SELECT {BY}, term, list_sort(list(c)) AS l FROM terms GROUP BY 1, 2),
ends AS (SELECT {BY}, term, l[CAST(floor(0.025 * len(l)) AS INTEGER) + 1] AS low, l[CAST(floor(0.975 * len(l)) AS INTEGER) + 1] AS high, CAST(len(l) AS INTEGER) AS draws FROM lists)
SELECT {BY}, term, low, high, low > 0 OR high < 0 AS significant, draws FROM ends""")(lambda s, d: I.bootstrap_ci(factor_rows(s, d), BY, XS, Y))

LOO = f"""{ROWS}, own AS (SELECT {BY}, {CLUSTER}, {sums_sql('1.0')} FROM g GROUP BY 1, 2),
total AS (SELECT {BY}, {', '.join(f'sum({c}) AS t_{c}' for c in ['w', *(f's{i}' for i in range(K + 1)), *(f'p{i}{j}' for i in range(K + 1) for j in range(i, K + 1))])} FROM own GROUP BY 1),
sums AS (SELECT {BY}, {CLUSTER}, {', '.join(f't_{c} - {c} AS {c}' for c in ['w', *(f's{i}' for i in range(K + 1)), *(f'p{i}{j}' for i in range(K + 1) for j in range(i, K + 1))])} FROM own JOIN total USING ({BY}) WHERE t_w - w >= {K + 3}), {solve_sql('sums', f'{BY}, {CLUSTER}')},
terms AS ({' UNION ALL '.join(f"SELECT {BY}, '{x}' AS term, {std(i)} AS c FROM fit WHERE swept IS NOT NULL" for i, x in enumerate(XS))}),
loo AS (SELECT {BY}, term, count(*) AS n_fits, min(c) > 0 OR max(c) < 0 AS sign_stable, min(c) AS coef_min, max(c) AS coef_max FROM terms GROUP BY 1, 2)"""
query("leave_one_out", f"WITH RECURSIVE {LOO} SELECT * FROM loo")(lambda s, d: I.leave_one_out(factor_rows(s, d), BY, CLUSTER, XS, Y))


@query("factor_labels", f"""WITH RECURSIVE {LOO}, ranks AS ({' UNION ALL '.join(f"SELECT {BY}, '{x}' AS term, corr(ra, rb) AS rho, count(*) AS n FROM (SELECT {BY}, rank() OVER (PARTITION BY {BY} ORDER BY {x}) + (count(*) OVER (PARTITION BY {BY}, {x}) - 1) / 2 AS ra, rank() OVER (PARTITION BY {BY} ORDER BY {Y}) + (count(*) OVER (PARTITION BY {BY}, {Y}) - 1) / 2 AS rb FROM f) GROUP BY 1" for x in XS)})
SELECT {BY}, term, rho, CASE WHEN rho IS NULL THEN 'insufficient' WHEN abs(rho) >= 0.5 THEN 'strong' WHEN abs(rho) >= 0.3 THEN 'moderate' ELSE 'weak' END AS strength,
  CASE WHEN sign_stable THEN 'stable' ELSE 'indicative' END AS sign FROM ranks LEFT JOIN loo USING ({BY}, term) WHERE n >= 5""")
def factor_labels(spark, sf_dir):
    """Each factor's rank correlation in words, and whether its sign survives every leave-one-out fit."""
    rows = factor_rows(spark, sf_dir)
    ranks = None
    for x in XS:
        own = X.spearman(rows, BY, x, Y).select(BY, F.lit(x).alias("term"), "rho")
        ranks = own if ranks is None else ranks.unionByName(own)
    signs = I.leave_one_out(rows, BY, CLUSTER, XS, Y).select(BY, "term", "sign_stable")
    return ranks.join(signs, [BY, "term"], "left").select(BY, "term", "rho", I.strength(F.col("rho")).alias("strength"), F.when(F.col("sign_stable"), "stable").otherwise("indicative").alias("sign"))
