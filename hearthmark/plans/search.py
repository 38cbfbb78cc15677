"""Queries of learned blends, full leaderboard, drift of calibrations and start dates of betas, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from hearthmark.operators import estimators as E
from hearthmark.operators import search as L
from hearthmark.operators.quantiles import exact_quantiles
from hearthmark.plans import analytics as N
from hearthmark.plans import engines as G
from hearthmark.plans import valuation as V

QUERIES, ORACLES = {}, {}
CUT, EARLY = "2000-01-01", "1999-07-01"
RULES = "ratio of actual to predicted; quantiles 0.075 and 0.925; by liquidity and segment, by segment, of all"


def query(name: str, run, sql: str) -> None:
    QUERIES[name], ORACLES[name] = run, sql


def reads(spark, d):
    s, c, i = V.inputs(spark, d)
    return L.paired_reads(E.c1_grid(s, c, i), E.a2_pooled(s, c, i), s, c)


READS = f"""{V.BASE}, ages AS (SELECT s.id AS s_id, any_value(asof_idx) - max(c.month_idx) AS months FROM subj s JOIN (SELECT DISTINCT project, contract_month, month_idx FROM comps) c ON s.project = c.project AND last_day(c.contract_month) + 56 <= s.as_of GROUP BY 1),
reads AS (SELECT c1.s_id, s.contract_month, {V.LIQ.replace('n_comps', 'c1.n_comps')} AS bucket, NOT coalesce(months <= {L.RECENT_MONTHS}, false) AS stale, c1.psf AS a, a2.psf AS b, c1.n_comps, s.price / s.area_sqft AS actual
  FROM ({V.ORACLES['c1_grid']}) c1 JOIN ({V.A2}) a2 ON c1.s_id = a2.s_id JOIN subj s ON s.id = c1.s_id LEFT JOIN ages ON ages.s_id = c1.s_id WHERE c1.psf IS NOT NULL AND a2.psf IS NOT NULL),
train AS (SELECT * FROM reads WHERE contract_month < DATE '{CUT}'),
we AS (SELECT bucket, k / 20 AS w, round(quantile_cont(abs(k / 20 * a + (1 - k / 20) * b - actual) / actual, 0.5), 12) AS e FROM train CROSS JOIN range(21) t(k) GROUP BY 1, 2),
w0 AS (SELECT bucket, w FROM we QUALIFY row_number() OVER (PARTITION BY bucket ORDER BY e, w) = 1),
de AS (SELECT k / 20 AS delta, round(quantile_cont(abs(greatest({L.LEAST_WEIGHT}, w - k / 20) * a + (1 - greatest({L.LEAST_WEIGHT}, w - k / 20)) * b - actual) / actual, 0.5), 12) AS e FROM train JOIN w0 USING (bucket) CROSS JOIN range(9) t(k) WHERE stale GROUP BY 1),
d0 AS (SELECT coalesce((SELECT delta FROM de ORDER BY e, delta LIMIT 1), 0) AS delta),
weights AS (SELECT bucket, stale, CASE WHEN stale THEN round(greatest({L.LEAST_WEIGHT}, w - delta), 2) ELSE w END AS weight, CAST(delta AS DOUBLE) AS delta FROM w0 CROSS JOIN d0 CROSS JOIN (VALUES (false), (true)) t(stale)),
bl AS (SELECT r.*, coalesce(weight, {L.UNKNOWN_WEIGHT}) AS weight, coalesce(weight, {L.UNKNOWN_WEIGHT}) * a + (1 - coalesce(weight, {L.UNKNOWN_WEIGHT})) * b AS psf, CASE WHEN contract_month < DATE '{CUT}' THEN 'train' ELSE 'test' END AS span FROM reads r LEFT JOIN weights USING (bucket, stale))"""
query("stale_weights", lambda s, d: L.fitted_weights(reads(s, d), CUT), f"{READS} SELECT * FROM weights")
query("weight_holdout", lambda s, d: L.judged(reads(s, d), CUT), f"""{READS} SELECT bucket, stale, span, count(*) AS n, any_value(weight) AS weight, quantile_cont(abs(psf - actual) / actual, 0.5) AS median_ape,
  quantile_cont(abs((0.5 + 0.5 * least(n_comps, 10) / 10) * a + (1 - (0.5 + 0.5 * least(n_comps, 10) / 10)) * b - actual) / actual, 0.5) AS plain_ape FROM bl GROUP BY 1, 2, 3""")
query("e1_learned", lambda s, d: (lambda r: L.blended(r, L.fitted_weights(r, CUT)).select("s_id", F.lit("E1L").alias("method"), "bucket", "stale", "weight", "psf"))(reads(s, d)), f"{READS} SELECT s_id, 'E1L' AS method, bucket, stale, weight, psf FROM bl")

METHODS = {"B1": "b1_latest", "B2": "b2_last3", "B3": "b3_filtered", "B4": "b4_nearest", "B5": "b5_segment", "C1": "c1_grid", "A2": "a2_pooled", "E2": "e2_blend", "LB1": "lb1_street", "LB2": "lb2_pool", "LB3": "lb3_pool", "LB4": "lb4_knn", "LC1": "lc1_craft", "LC2": "lc2_curve"}
METRICS = ["method", "n", "coverage_rate", "median_ape", "p90_ape"]


def leaderboard_all(spark, d):
    """Every point method on every subject, by median error."""
    known = V.QUERIES | G.QUERIES
    subjects = V.inputs(spark, d)[0]
    rows = None
    for method, q in METHODS.items():  # one after the other, and of each only its errors are stored
        of = E.errors(subjects, known[q](spark, d), method)
        rows = of if rows is None else rows.unionByName(of)
    found = exact_quantiles(rows, ["method"], "ape", median_ape=0.5, p90_ape=0.9).drop("n")
    counts = rows.groupBy("method").agg(F.count("ape").alias("n"), (F.count("ape") / F.count("*")).alias("coverage_rate"))
    return counts.join(found, "method", "left").select(*METRICS).withColumn("place", F.row_number().over(V.A.Window.orderBy(F.asc_nulls_last("median_ape"), "method")))  # a row a method; one that values nothing comes last


_COLUMNS = "s_id, method, psf, low, high, n_comps"
_EST = " UNION ALL ".join(f"SELECT {_COLUMNS} FROM ({(V.ORACLES | G.ORACLES)[q]})" for q in METHODS.values())
query("leaderboard_all", leaderboard_all, f"""{V.BASE}, est AS ({_EST}), rows_ AS (SELECT s.price AS s_price, m.method, e.psf * s.area_sqft AS pred FROM subj s CROSS JOIN (SELECT unnest({list(METHODS)}) AS method) m LEFT JOIN est e ON e.s_id = s.id AND e.method = m.method)
SELECT method, count(pred) AS n, count(pred) / count(*) AS coverage_rate, quantile_cont(abs(pred - s_price) / s_price, 0.5) AS median_ape, quantile_cont(abs(pred - s_price) / s_price, 0.9) AS p90_ape,
  row_number() OVER (ORDER BY quantile_cont(abs(pred - s_price) / s_price, 0.5) NULLS LAST, method) AS place FROM rows_ GROUP BY 1""")

KEYS, VALUES = ["level", "liq", "cell"], ["lo_ratio", "hi_ratio", "n"]


def calibrations(spark, d):
    rows = V.b3_rows(spark, d)
    return tuple(E.conformal_fit(rows, "s_market_segment", cut=cut) for cut in (EARLY, CUT))


def fit_sql(cut: str) -> str:
    return "(" + V.FIT.replace(CUT, cut) + " SELECT * FROM fit)"


_MARK = "CAST('0x' || substr(md5(concat_ws('|', {})), 1, 12) AS BIGINT)".format(", ".join([*KEYS, *(f"coalesce(CAST(CAST(round(CAST({v} AS DOUBLE) * 1000000) AS BIGINT) AS VARCHAR), '~')" for v in VALUES)]))
query("drift_check", lambda s, d: L.drift(*calibrations(s, d), KEYS, VALUES),
      f"""WITH a AS (SELECT level, liq, cell, {_MARK} AS m FROM {fit_sql(EARLY)}), b AS (SELECT level, liq, cell, {_MARK} AS m FROM {fit_sql(CUT)})
SELECT level, liq, cell, CASE WHEN a.m IS NULL THEN 'added' WHEN b.m IS NULL THEN 'removed' WHEN a.m = b.m THEN 'same' ELSE 'changed' END AS status FROM a FULL JOIN b USING (level, liq, cell)""")
query("calibration_stamp", lambda s, d: L.stamp(calibrations(s, d)[1], [*KEYS, *VALUES], RULES, ["level"]), f"SELECT level, count(*) AS n, CAST(sum({_MARK}) AS VARCHAR) AS digest, '{L.rules_digest(RULES)}' AS rules FROM {fit_sql(CUT)} GROUP BY 1")
query("beta_starts", lambda s, d: L.beta_starts(N.index(s, d), N.market(s, d)),
      f"""{N.INDEX}, y AS (SELECT kind, q, ln(value / lag(value) OVER (PARTITION BY kind ORDER BY q)) AS y FROM idx), x AS (SELECT q, ln(value / lag(value) OVER (ORDER BY q)) AS x FROM mkt), r AS (SELECT * FROM y JOIN x USING (q) WHERE y IS NOT NULL AND x IS NOT NULL),
g AS (SELECT a.kind, a.q AS since, count(*) AS n, regr_slope(b.y, b.x) AS beta, corr(b.y, b.x) AS corr, regr_intercept(b.y, b.x) AS a, regr_sxx(b.y, b.x) AS sxx, regr_syy(b.y, b.x) AS syy, regr_sxy(b.y, b.x) AS sxy, avg(b.x) AS mx,
  sum(b.y) FILTER (b.x > 0) / sum(b.x) FILTER (b.x > 0) AS up, sum(b.y) FILTER (b.x < 0) / sum(b.x) FILTER (b.x < 0) AS down FROM r a JOIN r b ON a.kind = b.kind AND b.q >= a.q GROUP BY 1, 2)
SELECT kind, since, n, beta, corr, a * 4 AS alpha, a / sqrt((syy - beta * sxy) / (n - 2) * (1 / n + mx * mx / sxx)) AS alpha_t, up, down FROM g WHERE n >= 12""")
