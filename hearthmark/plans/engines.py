"""Queries of the fitted models, blends, engines and sweeps. Regressions have no SQL; tests hold them against plain solvers."""

from __future__ import annotations

from pyspark.sql import functions as F

from hearthmark.operators import asof as A
from hearthmark.operators import estimators as E
from hearthmark.operators import models as M
from hearthmark.plans import valuation as V
from hearthmark.store import kept, size

QUERIES, ORACLES = {}, {}
ORIGIN = 1995 * 12  # the first month of these tables
SHARE = 2_000_000
NEAR = 2000.0  # metres, as the operator and the reference have it
query = lambda name, f, sql=None: (QUERIES.update({name: f}), ORACLES.update({name: sql} if sql else {}))
inputs = V.inputs


def reads(spark, d):
    s, c, i = inputs(spark, d)
    return s, E.c1_grid(s, c, i), {"a1": M.a1_hedonic(s, c, ORIGIN), "a2": E.a2_pooled(s, c, i), "a3": M.a3_knn(s, c, i, near=NEAR)}


query("a1_hedonic", lambda spark, d: M.a1_hedonic(*inputs(spark, d)[:2], ORIGIN))
query("e0_blend", lambda spark, d: (lambda s, c, i: E.blend(E.c1_grid(s, c, i), M.a1_hedonic(s, c, ORIGIN), "E0"))(*inputs(spark, d)))
query("e1_blend", lambda spark, d: (lambda s, c, i: E.blend(E.c1_grid(s, c, i), M.a1_hedonic(s, c, ORIGIN), "E1", M.grid_weight()))(*inputs(spark, d)))
query("e3_blend", lambda spark, d: (lambda s, g, a: M.e3_blend(g, a))(*reads(spark, d)))
query("v2_engine", lambda spark, d: (lambda s, g, a: M.v2_engine(s, g, a, ["a2", "a3", "a1"]))(*reads(spark, d)))

BUCKET = "CASE WHEN n_comps = 0 THEN 0.75 WHEN n_comps <= 2 THEN 0.85 WHEN n_comps <= 5 THEN 0.90 ELSE 0.95 END"
query("e2_blend", lambda spark, d: (lambda s, c, i: E.blend(E.c1_grid(s, c, i), E.a2_pooled(s, c, i), "E2", M.grid_weight()))(*inputs(spark, d)), f"""SELECT s_id, 'E2' AS method, CASE WHEN a.psf IS NULL THEN b.psf WHEN b.psf IS NULL THEN a.psf ELSE w * a.psf + (1 - w) * b.psf END AS psf,
least(a.low, b.low) AS low, greatest(a.high, b.high) AS high, coalesce(a.n_comps, 0) AS n_comps FROM (SELECT *, {BUCKET} AS w FROM ({V.ORACLES["c1_grid"]})) a FULL JOIN ({V.A2}) b USING (s_id)""")

MID, LEASED = lambda p: f"({p}floor_lo + {p}floor_hi) / 2", lambda p: f"(CASE WHEN {p}tenure_type = 'leasehold' AND {p}lease_start <> 0 THEN greatest(0.0, year({p}contract_month) - {p}lease_start) ELSE 0.0 END)"
A3 = f"""{V.BASE}, seen AS (SELECT d.as_of, c.* FROM dates d JOIN comps c ON last_day(c.contract_month) + 56 <= d.as_of),
sc AS (SELECT as_of, count(*) AS n, greatest(var_pop(ln(area_sqft)), 1e-18) AS va, greatest(var_pop({MID('')}), 1e-18) AS vf, greatest(var_pop({LEASED('')}), 1e-18) AS vl, greatest(var_pop(month_idx), 1e-18) AS vt FROM seen GROUP BY 1 HAVING count(*) >= 200),
lv AS (SELECT as_of, k, count(*) AS c FROM (SELECT as_of, unnest([market_segment, tenure_type]) AS k FROM seen) GROUP BY 1, 2), iv AS (SELECT lv.as_of, k, 1 / greatest(c / n * (1 - c / n), 1e-18) AS r FROM lv JOIN sc USING (as_of)),
sites AS (SELECT as_of, x, y, count(*) AS n FROM seen GROUP BY 1, 2, 3), places AS (SELECT DISTINCT as_of, x AS px, y AS py FROM subj),
rad AS (SELECT p.as_of, px, py, CASE WHEN coalesce(sum(n) FILTER (sqrt((x - px) * (x - px) + (y - py) * (y - py)) <= {NEAR}), 0) >= 80 THEN {NEAR} ELSE 5000 END AS r FROM places p LEFT JOIN sites USING (as_of) GROUP BY 1, 2, 3),
nb AS (SELECT rad.as_of, px, py, x, y FROM rad JOIN sites USING (as_of) WHERE sqrt((x - px) * (x - px) + (y - py) * (y - py)) <= r),
p AS (SELECT s.id AS s_id, s.area_sqft AS s_area, s.as_of, c.id AS c_id, c.contract_month, c.psf * coalesce(tf.tf, 1.0) AS v,
  round(sqrt(pow(ln(s.area_sqft) - ln(c.area_sqft), 2) / va + pow({MID('s.')} - {MID('c.')}, 2) / vf + pow({LEASED('s.')} - {LEASED('c.')}, 2) / vl + pow(s.asof_idx - c.month_idx, 2) / vt
   + CASE WHEN s.market_segment = c.market_segment THEN 0 ELSE coalesce(i1.r, 1e18) + coalesce(i2.r, 1e18) END + CASE WHEN s.tenure_type = c.tenure_type THEN 0 ELSE coalesce(i3.r, 1e18) + coalesce(i4.r, 1e18) END) + CASE WHEN s.district = c.district THEN 0.0 ELSE 1.0 END, 9) AS far
  FROM subj s JOIN sc USING (as_of) JOIN nb ON nb.as_of = s.as_of AND px = s.x AND py = s.y JOIN comps c ON c.x = nb.x AND c.y = nb.y AND last_day(c.contract_month) + 56 <= s.as_of AND s.asof_idx >= c.month_idx LEFT JOIN tf ON tf.as_of = s.as_of AND tf.q = c.q
  LEFT JOIN iv i1 ON i1.as_of = s.as_of AND i1.k = s.market_segment LEFT JOIN iv i2 ON i2.as_of = s.as_of AND i2.k = c.market_segment LEFT JOIN iv i3 ON i3.as_of = s.as_of AND i3.k = s.tenure_type LEFT JOIN iv i4 ON i4.as_of = s.as_of AND i4.k = c.tenure_type),
b AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY s_id ORDER BY far, contract_month DESC, c_id DESC) <= 40),
g AS (SELECT s_id, s_area, quantile_cont(v, 0.25) AS lo, quantile_cont(v, 0.5) AS m, quantile_cont(v, 0.75) AS hi, count(*) AS n FROM b GROUP BY 1, 2)
SELECT s_id, 'A3' AS method, m AS psf, lo * s_area AS low, hi * s_area AS high, n AS n_comps FROM g WHERE n >= 5"""
query("a3_knn", lambda spark, d: M.a3_knn(*inputs(spark, d), near=NEAR))  # its SQL takes minutes on larger tables; a test runs it on the smallest


def lv1(spark, d):
    s, c, i = inputs(spark, d)
    return M.lv1_engine(s, E.otherwise(kept(E.lc2_curve(s, c, i), "lc2"), E.la1_ladder(s, c, i), "LV1"), big=45.0)  # areas here end at 50


query("lv1_engine", lv1)
SMALL = V.SMALL | {"a3_knn": A3, "lv1_engine": f"""{V.BASE}, pt AS (SELECT s_id, psf, CASE WHEN fallback THEN 0 ELSE n_comps END AS n_comps FROM ({V.SMALL["lv1_point"]})),
r AS (SELECT p.*, {V.LIQ} AS liq, p.psf * area_sqft AS pred, price, area_sqft, property_type AS cell, contract_month FROM pt p JOIN subj s ON s.id = p.s_id),
fit AS (SELECT CASE grouping(liq, cell) WHEN 0 THEN 'liq_cell' WHEN 2 THEN 'cell' ELSE 'all' END AS level, liq, cell, quantile_cont(price / pred, 0.1) AS lo, quantile_cont(price / pred, 0.9) AS hi, count(*) AS n FROM r WHERE contract_month < DATE '2000-01-01' GROUP BY GROUPING SETS ((liq, cell), (cell), ())),
b AS (SELECT r.*, coalesce(f.lo, m.lo, w.lo) AS lo, coalesce(f.hi, m.hi, w.hi) AS hi, CASE WHEN area_sqft >= 45 THEN 1.6 ELSE 1.0 END AS k FROM r LEFT JOIN fit f ON f.level = 'liq_cell' AND f.n >= 40 AND f.liq = r.liq AND f.cell = r.cell LEFT JOIN fit m ON m.level = 'cell' AND m.cell = r.cell LEFT JOIN fit w ON w.level = 'all')
SELECT s_id, 'LV1' AS method, psf, pred * (1 + (lo - 1) * k) AS low, pred * (1 + (hi - 1) * k) AS high, n_comps FROM b"""}


def trend(spark, d):
    s, c, _ = inputs(spark, d)
    dates = s.select("as_of").distinct()
    return dates, M.local_trend(c, dates, ["street", "property_type"]), c


def bridged(spark, d):
    dates, fitted, comps = trend(spark, d)
    # sales move once, before each meets its dates: a part for every SHARE bytes of sales, so that a task's moved sales are sorted in memory
    dealt = comps.select("street", "property_type", "contract_month", "month_idx", "q", "psf").repartition(8 + size(spark, f"{d}/lineitem.parquet") // SHARE, "street", "property_type")
    pairs = dealt.crossJoin(F.broadcast(dates)).filter(A.visible("contract_month", "as_of"))
    out = M.bridge(pairs, kept(fitted, "trend"), V.index_q(V.caveats(spark, d)))
    return out.groupBy("as_of", "street", "property_type").agg(F.count("*").alias("n"), F.avg("moved").alias("moved"), F.percentile("value", F.lit(0.5)).alias("mid"))


query("two_way_fe", lambda spark, d: trend(spark, d)[1])
query("bridge_adjust", bridged)

NOMINALS = [(0.05, 0.95), (0.075, 0.925), (0.10, 0.90), (0.15, 0.85)]
query("nominal_sweep", lambda spark, d: M.nominal_sweep(V.b3_rows(spark, d), "s_market_segment", NOMINALS), f"""{V.WALK}, ok AS (SELECT *, s_price / pred AS ratio FROM rows_ WHERE method = 'B3' AND pred IS NOT NULL), nom AS (SELECT * FROM (VALUES {", ".join(map(str, NOMINALS))}) v(lo_q, hi_q)),
fit AS (SELECT s_market_segment, list(ratio) AS r FROM ok WHERE s_contract_month < DATE '2000-01-01' GROUP BY 1), cut AS (""" + " UNION ALL ".join(f"SELECT s_market_segment, {a}::DOUBLE AS lo_q, {b}::DOUBLE AS hi_q, quantile_cont(ratio, {a}) AS lo, quantile_cont(ratio, {b}) AS hi FROM ok WHERE s_contract_month < DATE '2000-01-01' GROUP BY 1" for a, b in NOMINALS) + """)
SELECT lo_q, hi_q, avg(CAST(s_price BETWEEN pred * lo AND pred * hi AS INT)) AS coverage, avg(pred * (hi - lo) / s_price) AS width, count(*) AS n FROM ok JOIN cut USING (s_market_segment) WHERE s_contract_month >= DATE '2000-01-01' GROUP BY 1, 2""")
query("weight_search", lambda spark, d: (lambda s, c, i: M.weight_search(E.c1_grid(s, c, i), E.a2_pooled(s, c, i), s))(*inputs(spark, d)), f"""{V.BASE}, c1 AS ({V.ORACLES["c1_grid"]}), a2 AS ({V.A2}),
e AS (SELECT {V.LIQ.replace("n_comps", "c1.n_comps")} AS liq, k / 20 AS weight, round(quantile_cont(abs(k / 20 * c1.psf + (1 - k / 20) * a2.psf - s.psf) / s.psf, 0.5), 12) AS median_ape, count(*) AS n FROM c1 JOIN a2 USING (s_id) JOIN subj s ON s.id = s_id CROSS JOIN range(21) t(k) GROUP BY 1, 2)
SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY liq ORDER BY median_ape, weight) = 1""")
curve = lambda spark, d: E.curve_pairs(*inputs(spark, d))
RAW = V.pair_sql(["street", "property_type"], 60, V.COMPAT)
query("cap_exposure", lambda spark, d: M.cap_exposure(curve(spark, d)), f"""{V.BASE}, p AS (SELECT *, pow(0.5, age / 18) AS w, CASE WHEN tf BETWEEN 0.8 AND 1.25 THEN 0 ELSE 1 END AS o FROM ({RAW})),
e AS (SELECT s_id, contract_month, sum(w * o) / sum(w) AS share, sum(w * o * ln(tf / least(greatest(tf, 0.8), 1.25))) / sum(w) AS gap FROM p GROUP BY 1, 2)
SELECT year(contract_month) || CASE WHEN month(contract_month) <= 6 THEN 'H1' ELSE 'H2' END AS half, count(*) AS n, avg(share) AS share, avg(gap) AS gap, quantile_cont(gap, 0.9) AS p90_gap FROM e GROUP BY 1""")
query("variant_sweep", lambda spark, d: M.variant_sweep(curve(spark, d), [1.05, 1.25, 1.50]), f"""{V.BASE}, p AS (SELECT cap, s_id, s_area, price, c_id, c_psf * least(greatest(tf, 0.8), cap) * exp({V.LEVEL('s_area')} - {V.LEVEL('c_area')}) AS v, pow(0.5, age / 18) AS w FROM ({RAW}) CROSS JOIN (VALUES (1.05::DOUBLE), (1.25), (1.5)) t(cap)),
r AS (SELECT *, sum(w) OVER (PARTITION BY cap, s_id ORDER BY v, w, c_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum, sum(w) OVER (PARTITION BY cap, s_id) AS total FROM p), g AS (SELECT cap, s_id, min(v) FILTER (cum >= 0.5 * total) * s_area / price - 1 AS sg FROM r GROUP BY cap, s_id, s_area, price)
SELECT cap, count(*) AS n, quantile_cont(abs(sg), 0.5) AS median_ape, quantile_cont(sg, 0.5) AS median_signed FROM g GROUP BY 1""")
query("pool_split_ab", lambda spark, d: M.pool_split(curve(spark, d), F.col("s_market_segment") == F.col("market_segment")), f"""{V.BASE}, p AS (SELECT q.s_id, {V.CAP} * exp({V.LEVEL('s_area')} - {V.LEVEL('c_area')}) AS v, c.market_segment = q.market_segment AS own FROM ({RAW}) q JOIN comps c ON c.id = q.c_id),
g AS (SELECT s_id, count(*) AS n, count(*) FILTER (own) AS n_own, quantile_cont(v, 0.25) AS a, quantile_cont(v, 0.75) AS b, quantile_cont(v, 0.25) FILTER (own) AS c, quantile_cont(v, 0.75) FILTER (own) AS d FROM p GROUP BY 1)
SELECT s_id, n, n_own, c / a - 1 AS low_moves, d / b - 1 AS high_moves FROM g WHERE n_own >= 4""")
