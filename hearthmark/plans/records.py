"""Queries of single-valuation rules, pair trends, listings, launches and ingest, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from hearthmark.functions import columns as C
from hearthmark.operators import asof as A
from hearthmark.operators import estimators as E
from hearthmark.operators import records as R
from hearthmark.operators import scoring as K
from hearthmark.plans import analytics as N
from hearthmark.plans import valuation as V
from hearthmark.plans.caveats import CAVEATS_SQL, caveats, table
from hearthmark.sources import ingest as S

QUERIES, ORACLES = {}, {}
query = lambda name, f, sql=None: (QUERIES.update({name: f}), ORACLES.update({name: sql} if sql else {}))
inputs, comps = V.inputs, N.comps
TRENDS = [0.0, 0.018, 0.038]


def ranked(spark, d):
    s, c, _ = inputs(spark, d)
    return A.pairs(s, c, ["project"], 60).withColumn("rn", F.row_number().over(Window.partitionBy("s_id").orderBy(F.desc("month_idx"), F.desc("id"))))


_QUART = lambda i: f"(vs[greatest(1, least({i} * (n + 1) // 4, n - 1))] * (4 - ({i} * (n + 1) - 4 * greatest(1, least({i} * (n + 1) // 4, n - 1)))) + vs[greatest(1, least({i} * (n + 1) // 4, n - 1)) + 1] * ({i} * (n + 1) - 4 * greatest(1, least({i} * (n + 1) // 4, n - 1)))) / 4"
_UP = "((floor_lo + floor_hi) / 2 - (c_lo + c_hi) / 2)"
GRID = f"""{V.BASE}, p0 AS (SELECT *, row_number() OVER (PARTITION BY s_id ORDER BY c_month DESC, c_id DESC) AS rn FROM ({V.pair_sql(["project"], 60)})),
p AS (SELECT s_id, trend, rn, c_psf * pow(1 + trend, age / 12) * pow(1.003, {_UP}) * pow(s_area / c_area, -0.07) AS v, 1 / (1 + abs(ln(s_area / c_area)) * 3 + abs({_UP}) / 25 + age / 24) AS w FROM p0 CROSS JOIN (VALUES {", ".join(f"({t}::DOUBLE)" for t in TRENDS)}) t(trend)),
a AS (SELECT s_id, trend, v, w FROM p UNION ALL SELECT s_id, trend, v, 2.0 FROM p WHERE rn = 1),
g AS (SELECT s_id, trend, sum(v * w) / sum(w) AS psf, list_sort(list(v)) AS vs, count(*) AS n FROM a GROUP BY 1, 2),
lg AS (SELECT s_id, trend, psf, least(CASE WHEN n >= 4 THEN {_QUART(1)} ELSE vs[1] END, psf * 0.985) AS low_psf, greatest(CASE WHEN n >= 4 THEN {_QUART(3)} ELSE vs[-1] END, psf * 1.015) AS high_psf, n FROM g)"""
query("legacy_grid", lambda s, d: R.legacy_grid(ranked(s, d), TRENDS), f"{GRID} SELECT * FROM lg")
query("sensitivity_grid", lambda s, d: R.legacy_grid(ranked(s, d), TRENDS).groupBy("trend").agg(F.count("*").alias("n"), F.percentile("psf", F.lit(0.5)).alias("mid"), F.avg((F.col("high_psf") - F.col("low_psf")) / F.col("psf")).alias("width")), f"{GRID} SELECT trend, count(*) AS n, quantile_cont(psf, 0.5) AS mid, avg((high_psf - low_psf) / psf) AS width FROM lg GROUP BY 1")
query("live_vs_recon", lambda s, d: R.visible_counts(*inputs(s, d)[:2]), f"{V.BASE} SELECT s.id AS s_id, count(*) FILTER (last_day(c.contract_month) + 56 <= s.as_of) AS n_recon, count(c.id) AS n_live FROM subj s LEFT JOIN comps c ON s.project = c.project AND c.month_idx <= s.asof_idx GROUP BY 1")
query("fresh_ref", lambda s, d: (lambda a, c, i: R.fresh_reference(A.time_factor(A.pairs(a, c, ["project"]), i)))(*inputs(s, d)), f"""{V.BASE}, p AS (SELECT * FROM ({V.pair_sql(["project"])}) WHERE abs(ln(c_area / s_area)) <= 0.10)
SELECT s_id, c_id, {V.CAP} * pow(s_area / c_area, -0.07) AS psf, age FROM p QUALIFY row_number() OVER (PARTITION BY s_id ORDER BY c_month DESC, c_id DESC) = 1""")
query("method_spread", lambda s, d: R.method_spread(V.walked(s, d), "B2"), f"{V.WALK}, g AS (SELECT s_id, count(psf) AS methods, (max(psf) - min(psf)) / max(psf) FILTER (method = 'B2') AS spread FROM rows_ GROUP BY 1) SELECT *, spread > 0.15 AS hard FROM g")
_CURVE = f"p AS (SELECT s_id, s_area, age, {V.CAP} * exp({V.LEVEL('s_area')} - {V.LEVEL('c_area')}) AS v FROM ({V.pair_sql(['street', 'property_type'], 60, V.COMPAT)}))"
curve = lambda s, d: E.curve_pairs(*inputs(s, d))
query("adj_distribution", lambda s, d: R.distribution(curve(s, d), "value", [12, 60]), f'{V.BASE}, {_CURVE} SELECT s_id, win AS "window", count(*) AS n, quantile_cont(v, 0.25) AS p25, quantile_cont(v, 0.5) AS p50, quantile_cont(v, 0.75) AS p75 FROM p JOIN (VALUES (12), (60)) t(win) ON age < win GROUP BY 1, 2')


def reasons(s, d):
    rows = R.distribution(curve(s, d), "value", [60]).join(inputs(s, d)[0].select("s_id", "s_area_sqft"), "s_id")
    spread, big = (F.col("p75") - F.col("p25")) / F.col("p50") / 10, F.col("s_area_sqft") >= 45
    rows = rows.withColumn("confidence", C.confidence_landed(F.col("n"), F.lit(False), spread, big))
    return rows.select("s_id", "confidence", R.suppress_reason(F.lit(False), big, F.lit(False), spread > 0.18, F.col("confidence"), F.col("n")).alias("reason"))


query("suppress_reason", reasons, f"""{V.BASE}, {_CURVE}, g AS (SELECT s_id, s_area, count(*) AS n, (quantile_cont(v, 0.75) - quantile_cont(v, 0.25)) / quantile_cont(v, 0.5) / 10 AS sp FROM p GROUP BY 1, 2),
k AS (SELECT *, 78 - 30 * exp(-n / 5) - least(greatest((sp - 0.06) * 140, 0.0), 30.0) AS b FROM g), c AS (SELECT *, greatest(20.0, CASE WHEN s_area >= 45 THEN least(b, 45.0) ELSE b END) AS confidence FROM k)
SELECT s_id, confidence, CASE WHEN s_area >= 45 THEN 'size' WHEN sp > 0.18 THEN 'hard_case' WHEN confidence < 55 THEN 'confidence' WHEN n < 4 THEN 'thin' END AS reason FROM c""")
query("pair_density", lambda s, d: R.pair_density(comps(s, d), "street", "area_sqft", "property_type"), f"""{N.BASE}, l AS (SELECT month_idx, lag(month_idx) OVER (PARTITION BY street, area_sqft, property_type ORDER BY month_idx) AS b FROM comps), m AS (SELECT month_idx, count(*) AS k FROM l WHERE b <> month_idx GROUP BY 1)
SELECT CAST(sum(k) AS BIGINT) AS pairs, count(*) AS months, list_sort(list(k))[count(*) // 2 + 1] AS median FROM m""")
query("pair_trend", lambda s, d: R.pair_trend(comps(s, d), "property_type"), f"""{N.BASE}, p AS (SELECT a.property_type, ln(b.psf * pow(1.003, a.floor_lo - b.floor_lo) / a.psf) / ((b.month_idx - a.month_idx) / 12) AS r FROM comps a JOIN comps b ON a.project = b.project AND a.area_sqft = b.area_sqft AND b.month_idx - a.month_idx >= 12)
SELECT property_type, count(*) AS n, least(greatest(CASE WHEN count(*) >= 5 THEN quantile_cont(r, 0.5) ELSE 0.018 END, 0.0), 0.05) AS rate FROM p GROUP BY 1""")
query("street_cagr", lambda s, d: R.street_cagr(comps(s, d)), f"""{N.BASE}, p AS (SELECT a.street, ln(b.psf / a.psf) / ((b.month_idx - a.month_idx) / 12) AS r FROM comps a JOIN comps b ON a.street = b.street AND a.property_type = b.property_type AND a.project <> b.project AND b.month_idx - a.month_idx >= 60)
SELECT street, count(*) AS n, CASE WHEN count(*) >= 3 THEN quantile_cont(r, 0.5) END AS cagr, min(r) AS low, max(r) AS high FROM p GROUP BY 1""")
query("fresh_cluster", lambda s, d: R.fresh_cluster(comps(s, d), "street"), f"""{N.BASE}, r AS (SELECT *, row_number() OVER (PARTITION BY street ORDER BY month_idx DESC, id DESC) AS rn FROM comps), g AS (SELECT street, max(psf) FILTER (rn = 1) AS fresh, quantile_cont(psf, 0.5) FILTER (rn BETWEEN 2 AND 4) AS cluster FROM r GROUP BY 1)
SELECT *, fresh / cluster - 1 AS move FROM g""")
query("street_summary", lambda s, d: comps(s, d).groupBy("street").agg(F.count("*").alias("n"), F.countDistinct("property_type").alias("types"), F.count(F.when(F.col("tenure_type") == "leasehold", 1)).alias("leases"), F.percentile("psf", F.lit(0.5)).alias("mid"), F.min("month_idx").alias("first_month"), F.max("month_idx").alias("last_month")),
      f"{N.BASE} SELECT street, count(*) AS n, count(DISTINCT property_type) AS types, count(*) FILTER (tenure_type = 'leasehold') AS leases, quantile_cont(psf, 0.5) AS mid, min(month_idx) AS first_month, max(month_idx) AS last_month FROM comps GROUP BY 1")
query("year_trend", lambda s, d: comps(s, d).groupBy("street", F.year("contract_month").alias("year")).agg(F.percentile("psf", F.lit(0.5)).alias("mid"), F.percentile(F.when(F.abs(F.col("area_sqft") / 20 - 1) <= 0.2, F.col("psf")), F.lit(0.5)).alias("cohort")).withColumn("yoy", F.col("cohort") / F.last("cohort", ignorenulls=True).over(Window.partitionBy("street").orderBy("year").rowsBetween(Window.unboundedPreceding, -1)) - 1),
      f"""{N.BASE}, y AS (SELECT street, CAST(year(contract_month) AS INTEGER) AS year, quantile_cont(psf, 0.5) AS mid, quantile_cont(psf, 0.5) FILTER (abs(area_sqft / 20 - 1) <= 0.2) AS cohort FROM comps GROUP BY 1, 2)
SELECT *, cohort / last_value(cohort IGNORE NULLS) OVER (PARTITION BY street ORDER BY year ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - 1 AS yoy FROM y""")
query("reconcile_report", lambda s, d: N.QUERIES["reconcile"](s, d).groupBy("status").agg(F.count("*").alias("n")), f"SELECT status, count(*) AS n FROM ({N.ORACLES['reconcile']}) GROUP BY 1")

# listings and launches; codes come from the part's key
code, number = N.code, N.number
FLAG = "CASE WHEN p_retailprice < lo THEN 'VALUE' WHEN p_retailprice <= hi THEN 'FAIR' WHEN p_retailprice <= hi * 1.25 THEN 'RICH' ELSE 'BUILD-PRICED' END"


def listings(s, d):
    p = N.QUERIES["score_landed"](s, d).join(N.QUERIES["value_flag"](s, d), "p_partkey").join(table(s, d, "part").select("p_partkey", "p_brand"), "p_partkey")
    out = R.rank_listings(p, "p_brand", F.col("total"), F.col("flag"), "p_partkey")
    return out.select("p_partkey", "p_brand", "total", "flag", "place", R.screen_verdict(F.col("total"), F.col("flag"), code(["freehold", "unknown"], 1), code(["none", "unverified"], 2)).alias("call"))


query("rank_listings", listings, f"""WITH s AS ({N.ORACLES["score_landed"]}), f AS ({N.ORACLES["value_flag"]}), r AS (SELECT p_partkey, p_brand, total, flag FROM s JOIN f USING (p_partkey) JOIN part USING (p_partkey))
SELECT *, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY total DESC, CASE flag WHEN 'VALUE' THEN 0 WHEN 'FAIR' THEN 1 WHEN 'RICH' THEN 2 WHEN 'BUILD-PRICED' THEN 3 ELSE 4 END, p_partkey) AS INTEGER) AS place,
 CASE WHEN flag = '?' OR p_partkey % 3 <> 0 OR floor(p_partkey / 2) % 3 = 1 THEN 'VERIFY DATA' WHEN flag = 'BUILD-PRICED' THEN 'BUILD-PLAY' WHEN flag = 'RICH' THEN 'NEGOTIATE' WHEN total >= 80 THEN 'PURSUE' WHEN total >= 65 THEN 'CONSIDER' WHEN total >= 50 THEN 'MARGINAL' ELSE 'PASS' END AS call FROM r""")
_WORDS = {"rebuild_status": ["rebuilt_new", "renovated", "original", "original_poor"], "estate_tier": ["mid", "gcb"], "tenure": ["999_yr", "99-year", "freehold"], "flood_risk": ["unverified", "low", "high"]}
_SAID = lambda i, k: f"CASE floor(p_partkey / {i + 1}) % {len(_WORDS[k]) + 1} " + " ".join(f"WHEN {j} THEN '{R.LISTING_WORDS[k].get(w, w)}'" for j, w in enumerate(_WORDS[k])) + f" ELSE '{R.LISTING_DEFAULTS[k]}' END AS {k}"
query("listing_norm", lambda s, d: table(s, d, "part").select("p_partkey", *(R.listing_code(k, code(w, i + 1)).alias(k) for i, (k, w) in enumerate(_WORDS.items()))), "SELECT p_partkey, " + ", ".join(_SAID(i, k) for i, k in enumerate(_WORDS)) + " FROM part")
_GROWTH = "(VALUES (0.0::DOUBLE), (0.02), (0.04)) t(growth)"
query("launch_scenarios", lambda s, d: R.launch_scenarios(table(s, d, "orders"), [0.0, 0.02, 0.04], "o_orderkey", F.col("o_totalprice") * 10, F.lit(0.2), F.col("o_totalprice") * 0.3), f"""WITH o AS (SELECT o_orderkey, o_totalprice * 10 AS price, {N.BSD("(o_totalprice * 10)")} + o_totalprice * 10 * 0.2 AS duty, o_totalprice * 10 * 0.75 * 0.03 * (3 * 0.45 + 2) - o_totalprice * 0.3 * 2 * 0.95 AS carry FROM orders),
r AS (SELECT *, price * pow(1 + growth, 5) * 0.98 - price - duty - carry AS profit, price * 0.25 + duty AS cash FROM o CROSS JOIN {_GROWTH})
SELECT o_orderkey, growth, profit, profit / cash AS roi, CASE WHEN profit / cash > -1 THEN pow(1 + profit / cash, 0.2) - 1 ELSE -1.0 END AS annualised, (price + duty + carry) / 0.98 / price - 1 AS breakeven FROM r""")
_LCODES = {k: list(v[0]) for k, v in K.LAUNCH.items()}


def launches(s, d):
    c = {k: code(v, i + 1) for i, (k, v) in enumerate(_LCODES.items())} | {"mrt_walk_min": number(1, 25), "lease_remaining": 70 + number(2, 35), "catalysts": number(3, 5), "expressway": number(1, 2) == 1, "nature": number(2, 3) == 0, "freehold": number(5, 4) == 0}
    rows = table(s, d, "part").select("p_partkey", K.score_launch(c).alias("total"), c["price_vs_comps"].alias("price_code"))
    return rows.withColumn("stance", K.stance(F.col("total"), F.col("price_code")))


_LP = " + ".join(N.case_points(f"floor(p_partkey / {i + 1}) % {len(v) + 1}", K.LAUNCH[k][0], K.LAUNCH[k][1]) for i, (k, v) in enumerate(_LCODES.items()))
query("score_launch", launches, f"""WITH p AS (SELECT p_partkey, p_partkey % 25 AS walk, 70 + floor(p_partkey / 2) % 35 AS lease, floor(p_partkey / 3) % 5 AS cat, {_LP} AS base FROM part),
t AS (SELECT p_partkey, CAST(base + CASE WHEN walk <= 5 THEN 10 WHEN walk <= 10 THEN 8 WHEN walk <= 15 THEN 5 ELSE 2 END + CASE WHEN p_partkey % 2 = 1 THEN 2 ELSE 0 END + CASE WHEN floor(p_partkey / 2) % 3 = 0 THEN 3 ELSE 0 END + CASE WHEN floor(p_partkey / 5) % 4 = 0 THEN 10 WHEN lease >= 99 THEN 8 WHEN lease >= 90 THEN 7 WHEN lease >= 80 THEN 5 ELSE 3 END + CASE cat WHEN 0 THEN 2 WHEN 1 THEN 4 WHEN 2 THEN 6 ELSE 8 END AS INTEGER) AS total,
 CASE floor(p_partkey / 3) % 5 WHEN 0 THEN 'discount' WHEN 1 THEN 'par' WHEN 2 THEN 'premium' WHEN 3 THEN 'steep_premium' END AS price_code FROM p)
SELECT *, CASE WHEN total >= 80 AND price_code = 'steep_premium' THEN 'SELECTIVE' WHEN total >= 80 THEN 'BUY' WHEN total >= 68 THEN 'SELECTIVE' WHEN total >= 55 THEN 'WAIT' ELSE 'AVOID' END AS stance FROM t""")

# geometry
query("enrich_points", lambda s, d: N.beside(s, d).groupBy("origin").pivot("layer", list(range(5))).agg(F.min("d").alias("nearest"), F.sum("n").alias("n")), f"{N.PTS} SELECT origin, " + ", ".join(f'min(d) FILTER (layer = {i}) AS "{i}_nearest", nullif(count(*) FILTER (layer = {i}), 0) AS "{i}_n"' for i in range(5)) + " FROM wi GROUP BY 1")

# ingest: printed values read back, and nested records built from the transactions
query("row_normalize", lambda s, d: table(s, d, "orders").select("o_orderkey", F.date_format("o_orderdate", "dd MMM yyyy").alias("day"), F.concat(F.lit("$"), F.format_number(F.col("o_totalprice"), 0)).alias("money")).select("o_orderkey", F.to_date("day", "dd MMM yyyy").alias("day"), S.number(F.regexp_replace("money", r"\$", "")).alias("price"))
      , "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day, CAST(round_even(o_totalprice, 0) AS DOUBLE) AS price FROM orders")


def nested(s, d):
    c = caveats(s, d)
    text = lambda e: e.cast("string")
    t = F.struct(text(F.col("area_sqft")).alias("area"), F.format_string("%02d-%02d", "floor_hi", "floor_lo").alias("floorRange"), text(F.col("no_of_units")).alias("noOfUnits"), F.when(F.col("month_idx") % 7 > 0, F.date_format("contract_month", "MMyy")).otherwise("1399").alias("contractDate"), F.lit("3").alias("typeOfSale"), F.format_number(F.floor("price"), 0).alias("price"), F.col("property_type").alias("propertyType"), F.col("district"), F.lit("Strata").alias("typeOfArea"), F.lit("Freehold").alias("tenure"))
    return c.select(text(F.col("street")).alias("street"), text(F.col("project")).alias("project"), F.col("market_segment").alias("marketSegment"), text(F.col("x")).alias("x"), text(F.col("y")).alias("y"), F.array(t).alias("transaction"))


query("ingest_normalize", lambda s, d: S.normalize(nested(s, d))[0].groupBy("market_segment", "floor_lo", "floor_hi").agg(F.count("*").alias("n"), F.sum("price").alias("price"), F.sum("area_sqm").alias("area")), f"WITH {CAVEATS_SQL} SELECT market_segment, floor_lo, floor_hi, count(*) AS n, sum(floor(price)) AS price, sum(area_sqft) AS area FROM caveats WHERE month_idx % 7 > 0 GROUP BY 1, 2, 3")
