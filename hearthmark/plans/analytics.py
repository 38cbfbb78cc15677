"""Queries of effects, cohorts, resolution, token streams, geometry, scoring and duties, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from hearthmark.functions import columns as C
from hearthmark.operators import asof as A
from hearthmark.operators import cohorts as H
from hearthmark.operators import effects as X
from hearthmark.operators import geo as G
from hearthmark.operators import resolve as R
from hearthmark.operators import scoring as K
from hearthmark.operators import surfaces as U
from hearthmark.operators import tokens as T
from hearthmark.plans.caveats import CAVEATS_SQL, caveats, table
from hearthmark.sources import ingest as S

QUERIES, ORACLES = {}, {}
BASE = f"WITH {CAVEATS_SQL}, comps AS (SELECT * FROM caveats WHERE no_of_units <= 1 AND psf BETWEEN 500 AND 6500)"
INDEX = f"{BASE}, idx AS (SELECT market_segment AS kind, q, avg(psf) AS value FROM caveats GROUP BY 1, 2), mkt AS (SELECT q, avg(psf) AS value FROM caveats GROUP BY 1)"


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


comps = lambda s, d: A.hygiene(caveats(s, d))
index = lambda s, d: caveats(s, d).groupBy(F.col("market_segment").alias("kind"), "q").agg(F.avg("psf").alias("value"))
market = lambda s, d: caveats(s, d).groupBy("q").agg(F.avg("psf").alias("value"))

# effects
query("pair_elasticity", f"""{BASE}, p AS (SELECT a.market_segment, ln(b.psf / a.psf) / ln(b.area_sqft / a.area_sqft) AS e FROM comps a JOIN comps b ON a.project = b.project AND a.id < b.id AND abs(a.month_idx - b.month_idx) <= 3 AND abs(ln(b.area_sqft / a.area_sqft)) >= 0.20)
SELECT market_segment, quantile_cont(e, 0.5) AS median_elasticity, count(*) AS n FROM p WHERE e > -1 AND e < 0.5 GROUP BY 1""")(lambda s, d: X.pair_elasticity(comps(s, d)))
query("pair_floor", f"""{BASE}, p AS (SELECT a.market_segment, ln(b.psf / a.psf) / ((b.floor_lo + b.floor_hi - a.floor_lo - a.floor_hi) / 2) AS premium FROM comps a JOIN comps b ON a.project = b.project AND a.id < b.id AND abs(a.month_idx - b.month_idx) <= 3 AND abs(ln(b.area_sqft / a.area_sqft)) <= 0.10 AND abs(b.floor_lo + b.floor_hi - a.floor_lo - a.floor_hi) >= 4)
SELECT market_segment, quantile_cont(premium, 0.5) AS median_premium, count(*) AS n FROM p WHERE abs(premium) < 0.05 GROUP BY 1""")(lambda s, d: X.pair_floor(comps(s, d), 2.0))  # these tables have seven floors
query("fe_slope", f"""{INDEX}, a AS (SELECT property_type, street, area_sqft, psf / value AS psf FROM comps JOIN mkt USING (q)), g AS (SELECT property_type, street, count(*) AS n, sum(ln(area_sqft)) AS x, sum(ln(psf)) AS y, sum(ln(area_sqft) * ln(psf)) AS xy, sum(ln(area_sqft) * ln(area_sqft)) AS xx FROM a GROUP BY 1, 2)
SELECT property_type, sum(xy - x * y / n) / sum(xx - x * x / n) AS slope, CAST(sum(n) AS BIGINT) AS n FROM g GROUP BY 1""")(lambda s, d: X.fe_slope(X.adjusted(comps(s, d), market(s, d)), "street", "property_type"))
plots = lambda s, d: caveats(s, d).withColumn("plot", F.concat_ws("/", "project", "street"))
GROUPS_SQL = f"""{BASE}, u AS (SELECT concat_ws('/', project, street) AS plot, month_idx, price, min(type_of_sale) AS sale FROM caveats GROUP BY 1, 2, 3),
g AS (SELECT plot FROM u GROUP BY 1 HAVING count(*) = count(DISTINCT month_idx) AND count(*) BETWEEN 2 AND 4 AND count(*) FILTER (sale = 'O') < 2), r AS (SELECT u.* FROM u JOIN g USING (plot))"""
PAIRS_SQL = f"{GROUPS_SQL}, l AS (SELECT *, month_idx - lag(month_idx) OVER w AS gap, price / lag(price) OVER w AS ratio FROM r WINDOW w AS (PARTITION BY plot ORDER BY month_idx)), rp AS (SELECT plot, month_idx, gap, ratio, pow(ratio, 12 / gap) - 1 AS annualised FROM l WHERE gap >= 3)"
query("repeat_groups", f"{GROUPS_SQL} SELECT plot, month_idx, price FROM r")(lambda s, d: X.repeat_groups(plots(s, d), "plot").select("plot", "month_idx", "price"))
query("repeat_pairs", f"{PAIRS_SQL} SELECT * FROM rp")(lambda s, d: X.repeat_pairs(X.repeat_groups(plots(s, d), "plot"), "plot"))
query("noise_floor", f"""{PAIRS_SQL}, mkt AS (SELECT q, avg(psf) AS value FROM caveats GROUP BY 1)
SELECT CASE WHEN gap <= 18 THEN 'short' ELSE 'long' END AS bucket, count(*) AS n, quantile_cont(abs(ln(ratio) - ln(t.value / f.value)), 0.5) / sqrt(2) AS floor FROM rp JOIN mkt t ON t.q = month_idx // 3 JOIN mkt f ON f.q = (month_idx - gap) // 3 WHERE abs(annualised) <= 0.60 GROUP BY 1""")(
    lambda s, d: X.noise_floor(X.repeat_pairs(X.repeat_groups(plots(s, d), "plot"), "plot"), market(s, d))
)
query("returns_vol", f"{INDEX}, r AS (SELECT kind, ln(value / lag(value) OVER (PARTITION BY kind ORDER BY q)) AS r FROM idx) SELECT kind, count(r) AS n, avg(r) AS mean_return, stddev_samp(r) * 2 AS ann_vol FROM r GROUP BY 1")(lambda s, d: X.returns_vol(index(s, d)))
query("drawdown", f"""{INDEX}, p AS (SELECT *, max(value) OVER (PARTITION BY kind ORDER BY q ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS peak FROM idx),
o AS (SELECT a.kind, a.q, a.value / a.peak - 1 AS dd, (SELECT min(b.q) FROM idx b WHERE b.kind = a.kind AND b.q <= a.q AND b.value = a.peak) AS peak_q FROM p a)
SELECT kind, dd AS drawdown, q AS trough_q, peak_q FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY dd, q) AS rn FROM o) WHERE rn = 1""")(lambda s, d: X.drawdown(index(s, d)))
query("cagr", f"{INDEX}, l AS (SELECT kind, max(q) AS q1, arg_max(value, q) AS v1 FROM idx GROUP BY 1) SELECT l.kind, CAST(y AS INTEGER) AS years, pow(v1 / value, 1 / y) - 1 AS cagr FROM l CROSS JOIN (VALUES (1), (3), (5)) t(y) JOIN idx ON idx.kind = l.kind AND idx.q = l.q1 - 4 * y")(lambda s, d: X.cagr(index(s, d), [1, 3, 5]))
query("beta_alpha", f"""{INDEX}, r AS (SELECT kind, q, ln(value / lag(value) OVER (PARTITION BY kind ORDER BY q)) AS r FROM idx), m AS (SELECT q, ln(value / lag(value) OVER (ORDER BY q)) AS m FROM mkt)
SELECT kind, count(*) AS n, covar_samp(r, m) / var_samp(m) AS beta, corr(r, m) AS corr, (avg(r) - covar_samp(r, m) / var_samp(m) * avg(m)) * 4 AS alpha, avg(r) FILTER (m > 0) / avg(m) FILTER (m > 0) AS up, avg(r) FILTER (m < 0) / avg(m) FILTER (m < 0) AS down
FROM r JOIN m USING (q) WHERE r IS NOT NULL AND m IS NOT NULL GROUP BY 1 HAVING count(*) >= 12""")(lambda s, d: X.beta(index(s, d), market(s, d)))
query("spearman", f"""{BASE}, k AS (SELECT market_segment, rank() OVER (PARTITION BY market_segment ORDER BY area_sqft) + (count(*) OVER (PARTITION BY market_segment, area_sqft) - 1) / 2 AS ra, rank() OVER (PARTITION BY market_segment ORDER BY psf) + (count(*) OVER (PARTITION BY market_segment, psf) - 1) / 2 AS rb FROM comps)
SELECT market_segment, corr(ra, rb) AS rho, count(*) AS n FROM k GROUP BY 1""")(lambda s, d: X.spearman(comps(s, d), "market_segment", "area_sqft", "psf"))
query("cycles", f"{INDEX} SELECT kind, arg_min(q, value) AS low_q, min(value) AS low, arg_max(q, value) AS high_q, max(value) AS high FROM idx GROUP BY 1")(lambda s, d: index(s, d).groupBy("kind").agg(F.min_by("q", "value").alias("low_q"), F.min("value").alias("low"), F.max_by("q", "value").alias("high_q"), F.max("value").alias("high")))
query("median_premium", f"{BASE}, p AS (SELECT market_segment, project, quantile_cont(psf, 0.5) AS mid FROM comps GROUP BY 1, 2), m AS (SELECT market_segment, quantile_cont(mid, 0.5) AS seg FROM p GROUP BY 1) SELECT p.market_segment, p.project, mid / seg - 1 AS premium FROM p JOIN m USING (market_segment)")(
    lambda s, d: (lambda p: p.join(F.broadcast(p.groupBy("market_segment").agg(F.percentile("mid", F.lit(0.5)).alias("seg"))), "market_segment").select("market_segment", "project", (F.col("mid") / F.col("seg") - 1).alias("premium")))(comps(s, d).groupBy("market_segment", "project").agg(F.percentile("psf", F.lit(0.5)).alias("mid")))
)

# cohorts and audits
query("size_cohorts", f"{BASE} SELECT street, CASE WHEN area_sqft < 10 THEN '0-10' WHEN area_sqft < 25 THEN '10-25' WHEN area_sqft < 40 THEN '25-40' ELSE '>=40' END AS band, count(*) AS n, min(psf) AS low, quantile_cont(psf, 0.5) AS mid, max(psf) AS high FROM comps GROUP BY 1, 2")(lambda s, d: H.size_cohorts(comps(s, d), "street", [10.0, 25.0, 40.0]))
query("trend", f"{BASE}, y AS (SELECT street, CAST(year(contract_month) AS INTEGER) AS year, count(*) AS n, quantile_cont(psf, 0.5) AS median_psf FROM comps GROUP BY 1, 2) SELECT *, median_psf / lag(median_psf) OVER (PARTITION BY street ORDER BY year) - 1 AS yoy FROM y")(lambda s, d: H.trend(comps(s, d), "street"))
query("tenure_mix", f"{BASE}, t AS (SELECT street, count(*) AS n, avg(CAST(tenure_type = 'leasehold' AS INT)) AS lease_share, count(DISTINCT tenure_type) = 1 AS unanimous FROM comps GROUP BY 1) SELECT *, n >= 4 AND least(lease_share, 1 - lease_share) >= 0.10 AS mixed FROM t")(lambda s, d: H.tenure_mix(comps(s, d), "street"))
query("recent_windows", f"""{BASE}, r AS (SELECT *, 24011 - month_idx AS age, row_number() OVER (PARTITION BY street ORDER BY month_idx DESC, id DESC) AS rn FROM comps WHERE month_idx <= 24011),
g AS (SELECT street, count(*) FILTER (age < 12) AS n12, quantile_cont(psf, 0.5) FILTER (age < 12) AS m12, quantile_cont(psf, 0.5) FILTER (age < 6) AS m6, quantile_cont(psf, 0.5) FILTER (age BETWEEN 6 AND 11) AS m6_before, quantile_cont(psf, 0.5) FILTER (rn <= 3) AS cluster FROM r GROUP BY 1) SELECT *, m6 / m6_before - 1 AS drift FROM g""")(lambda s, d: H.recent_windows(comps(s, d), "street", 24011))
query("subject_cohort", f"""{BASE}, r AS (SELECT *, row_number() OVER (PARTITION BY street ORDER BY month_idx DESC, id DESC) AS rn FROM comps WHERE abs(area_sqft / 20.0 - 1) <= 0.06)
SELECT street, count(*) AS n, quantile_cont(psf, 0.5) AS mid, quantile_cont(psf, 0.5) FILTER (rn <= 6) AS newest FROM r GROUP BY 1""")(lambda s, d: H.subject_cohort(comps(s, d), "street", 20.0))
query("audit", f"""{BASE} SELECT CASE WHEN grouping(market_segment) = 0 THEN 'market_segment' WHEN grouping(property_type) = 0 THEN 'property_type' WHEN grouping(district) = 0 THEN 'district' ELSE 'all' END AS dim, coalesce(market_segment, property_type, district, '') AS value,
count(*) AS n, min(month_idx) AS first_month, max(month_idx) AS last_month, CAST(count(*) FILTER (NOT psf BETWEEN 500 AND 6500) AS BIGINT) AS outliers FROM caveats GROUP BY GROUPING SETS ((market_segment), (property_type), (district), ())""")(lambda s, d: H.audit(caveats(s, d), "market_segment", "property_type", "district"))
query("audit_copies", f"{BASE}, g AS (SELECT count(*) AS c FROM caveats GROUP BY project, contract_month) SELECT count(*) AS distinct_rows, CAST(sum(c - 1) AS BIGINT) AS surplus, max(c) AS largest FROM g")(lambda s, d: H.copies(caveats(s, d), "project", "contract_month"))
query("infer_statics", f"{BASE} SELECT project, count(*) AS n, avg(x) AS x, avg(y) AS y, quantile_cont(lease_start, 0.5) AS lease_start FROM comps GROUP BY 1")(lambda s, d: comps(s, d).groupBy("project").agg(F.count("*").alias("n"), F.avg("x").alias("x"), F.avg("y").alias("y"), F.percentile("lease_start", F.lit(0.5)).alias("lease_start")))

# resolution
query("exact_collapse", "SELECT l_partkey, l_suppkey, l_quantity, min(l_orderkey) AS l_orderkey, count(*) AS copies FROM lineitem GROUP BY 1, 2, 3")(lambda s, d: R.exact_collapse(table(s, d, "lineitem"), ["l_partkey", "l_suppkey", "l_quantity"], "l_orderkey"))
query("stale_fingerprint", "SELECT l_partkey, l_quantity, count(DISTINCT l_suppkey) AS holders, CASE WHEN count(DISTINCT l_suppkey) < 3 THEN min(l_suppkey) END AS l_suppkey FROM lineitem GROUP BY 1, 2")(lambda s, d: R.stale_fingerprint(table(s, d, "lineitem"), ["l_partkey", "l_quantity"], "l_suppkey"))
query("fuzzy_dedup", f"""{BASE}, l AS (SELECT id, project, contract_month AS day, CASE WHEN datediff('day', lag(contract_month) OVER w, contract_month) <= 31 THEN 0 ELSE 1 END AS fresh FROM caveats WINDOW w AS (PARTITION BY project ORDER BY contract_month, id)),
k AS (SELECT *, sum(fresh) OVER (PARTITION BY project ORDER BY day, id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS session FROM l) SELECT project, CAST(session AS BIGINT) AS session, min(day) AS first_day, max(day) AS last_day, count(*) AS n FROM k GROUP BY 1, 2""")(lambda s, d: R.fuzzy_sessions(caveats(s, d), ["project"], "contract_month"))
query("merge_latest", "SELECT user_id, arg_max(value, event_id) AS value, arg_max(event_type, event_id) AS event_type FROM events GROUP BY 1")(lambda s, d: R.merge_latest(table(s, d, "events"), "user_id", ["value", "event_type"], "event_id"))
query("upsert", """WITH a AS (SELECT p_partkey, p_retailprice, p_brand FROM part WHERE p_size <= 35), b AS (SELECT p_partkey, p_retailprice * 2 AS p_retailprice, lower(p_brand) AS p_brand FROM part WHERE p_size >= 15)
SELECT p_partkey, coalesce(b.p_retailprice, a.p_retailprice) AS p_retailprice, coalesce(a.p_brand, b.p_brand) AS p_brand, CASE WHEN a.p_brand IS NULL THEN 'new' WHEN b.p_brand IS NULL THEN 'missing' ELSE 'updated' END AS status FROM a FULL JOIN b USING (p_partkey)""")(
    lambda s, d: R.upsert(table(s, d, "part").filter("p_size <= 35").select("p_partkey", "p_retailprice", "p_brand"), table(s, d, "part").filter("p_size >= 15").select("p_partkey", (F.col("p_retailprice") * 2).alias("p_retailprice"), F.lower("p_brand").alias("p_brand")), "p_partkey", ["p_retailprice"], ["p_brand"])
)
# a sale of one source meets one of the other in its project and month; the measure that pairs them is the area
RECONCILE = f"""{BASE}, l AS (SELECT *, row_number() OVER (PARTITION BY project, month_idx ORDER BY id) AS n FROM caveats WHERE floor_lo <= 5),
pools AS (SELECT project, month_idx, list(struct_pack(a := area_sqft, id := id) ORDER BY id) AS pool FROM caveats WHERE floor_lo >= 3 GROUP BY 1, 2),
steps AS (
  SELECT l.project, l.month_idx, CAST(0 AS BIGINT) AS n, coalesce(any_value(pool), CAST([] AS STRUCT(a DOUBLE, id VARCHAR)[])) AS pool, CAST(NULL AS VARCHAR) AS left_id, CAST(NULL AS STRUCT(a DOUBLE, id VARCHAR)) AS got, CAST(NULL AS DOUBLE) AS area FROM l LEFT JOIN pools USING (project, month_idx) GROUP BY 1, 2
  UNION ALL
  SELECT project, month_idx, n, list_filter(pool, lambda k: got IS NULL OR k.id <> got.id), id, got, area_sqft FROM (
    SELECT s.project, s.month_idx, l.n, s.pool, l.id, l.area_sqft, list_filter(s.pool, lambda k: abs(k.a - l.area_sqft) = list_min(list_transform(s.pool, lambda j: abs(j.a - l.area_sqft))))[1] AS got FROM steps s JOIN l ON l.project = s.project AND l.month_idx = s.month_idx AND l.n = s.n + 1)
), rest AS (SELECT unnest(pool) AS k FROM (SELECT pool, n, max(n) OVER (PARTITION BY project, month_idx) AS last FROM steps) WHERE n = last
  UNION ALL SELECT unnest(pool) FROM pools ANTI JOIN l USING (project, month_idx))
SELECT left_id, got.id AS right_id, CASE WHEN got IS NULL THEN 'left_only' WHEN abs(got.a - area) > 1.5 THEN 'differs' ELSE 'matched' END AS status FROM steps WHERE n > 0
UNION ALL SELECT NULL, k.id, 'right_only' FROM rest""".replace("WITH ", "WITH RECURSIVE ", 1)
query("reconcile", RECONCILE)(lambda s, d: U.nearest_matches(caveats(s, d).filter("floor_lo <= 5"), caveats(s, d).filter("floor_lo >= 3"), ["project", "month_idx"], "area_sqft", 1.5))
query("alias_resolve", "SELECT s_name AS name, CASE WHEN s_acctbal > 0 THEN s_name WHEN s_suppkey % 3 > 0 THEN (SELECT min(s_name) FROM supplier WHERE s_acctbal > 0) END AS resolved, CASE WHEN s_acctbal > 0 THEN 'direct' WHEN s_suppkey % 3 > 0 THEN 'alias' ELSE 'refused' END AS status FROM supplier")(
    lambda s, d: (lambda t: R.alias_resolve(t.select(F.col("s_name").alias("name")), t.filter("s_acctbal > 0").select(F.col("s_name").alias("name")), t.filter("s_suppkey % 3 > 0").select(F.col("s_name").alias("name")).crossJoin(F.broadcast(t.filter("s_acctbal > 0").agg(F.min("s_name").alias("alias"))))))(table(s, d, "supplier"))
)
query("arith_gate", "SELECT p_brand, count(*) AS n, count(*) FILTER (abs((p_retailprice / 10) * p_size / p_retailprice - 1) <= 0.02) AS good FROM part GROUP BY 1")(
    lambda s, d: R.arith_gate(table(s, d, "part").select("p_brand", (F.col("p_retailprice") / 10).alias("psf"), F.col("p_size").alias("area_sqft"), F.col("p_retailprice").alias("price"))).groupBy("p_brand").agg(F.count("*").alias("n"), F.count(F.when(F.col("ok"), 1)).alias("good"))
)

# token streams, over whole conversations
TOK = "WITH l AS (SELECT conv_id * 100 + turn AS doc, list_filter(regexp_split_to_array(text, '[ \\t\\n\\r\\f\\v]+'), lambda x: x <> '') AS w FROM conversations), t0 AS (SELECT doc, unnest(w) AS token, generate_subscripts(w, 1) - 1 AS pos FROM l), t AS (SELECT *, CASE WHEN regexp_matches(token, '^[0-9]+$') THEN 'int' WHEN regexp_matches(token, '^[A-Z][a-z]+$') THEN 'capital' WHEN regexp_matches(token, '[.!?]$') THEN 'end' WHEN regexp_matches(token, '^[a-z]+$') THEN 'word' ELSE 'other' END AS kind FROM t0)"
tok = lambda s, d: T.tokens(table(s, d, "conversations").withColumn("doc", F.col("conv_id") * 100 + F.col("turn")), "doc", "text")
query("classify_cells", f"{TOK} SELECT doc, kind, count(*) AS n FROM t GROUP BY 1, 2")(lambda s, d: T.classify(tok(s, d)))
query("doc_guard", f"{TOK} SELECT doc, count(*) AS n, bool_or(kind = 'end') AS has_end FROM t GROUP BY 1")(lambda s, d: T.doc_guard(tok(s, d)))
query("token_segments", f"{TOK}, g AS (SELECT *, count(*) FILTER (kind = 'capital') OVER (PARTITION BY doc ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS segment FROM t) SELECT doc, segment, count(*) AS n, arg_min(token, pos) AS head, CAST(min(pos) FILTER (kind = 'end') AS INTEGER) AS end_pos FROM g WHERE segment > 0 GROUP BY 1, 2")(lambda s, d: T.segments(tok(s, d)))
query("token_records", f"{TOK}, h AS (SELECT *, lead(kind, 1) OVER w AS k1, lead(kind, 2) OVER w AS k2, lead(token, 1) OVER w AS t1, lead(token, 2) OVER w AS t2 FROM t WINDOW w AS (PARTITION BY doc ORDER BY pos)) SELECT doc, CAST(pos AS INTEGER) AS pos, token || ' ' || t1 || ' ' || t2 AS record FROM h WHERE kind = 'capital' AND k1 = 'word' AND k2 = 'word'")(lambda s, d: T.records(tok(s, d), ["capital", "word", "word"]))
query("token_triples", f"{TOK}, g AS (SELECT *, pos - row_number() OVER (PARTITION BY doc ORDER BY pos) AS run FROM t WHERE kind = 'word'), n AS (SELECT *, row_number() OVER (PARTITION BY doc, run ORDER BY pos) - 1 AS spot, lead(token, 1) OVER (PARTITION BY doc, run ORDER BY pos) AS t1, lead(token, 2) OVER (PARTITION BY doc, run ORDER BY pos) AS t2 FROM g) SELECT doc, CAST(pos AS INTEGER) AS pos, token || ' ' || t1 || ' ' || t2 AS record FROM n WHERE spot % 3 = 0 AND t2 IS NOT NULL")(lambda s, d: T.records(tok(s, d), ["word", "word", "word"]))
query("kv_pairs", f"{TOK}, n AS (SELECT *, lead(token) OVER (PARTITION BY doc ORDER BY pos) AS nx FROM t) SELECT doc, (arg_min_null(nx, pos) FILTER (token = 'the')) AS v_the, (arg_min_null(nx, pos) FILTER (token = 'de')) AS v_de FROM n WHERE token IN ('the', 'de') GROUP BY 1")(lambda s, d: T.kv_pairs(tok(s, d), ["the", "de"]))

# geometry
points = lambda s, d: table(s, d, "supplier").select(F.col("s_suppkey").alias("site"), F.col("s_nationkey").alias("layer"), ((F.col("s_suppkey") * 7919) % 10007).cast("double").alias("x"), ((F.col("s_suppkey") * 104729) % 10007).cast("double").alias("y"))
PTS = "WITH pt AS (SELECT s_suppkey AS site, s_nationkey AS layer, CAST((s_suppkey * 7919) % 10007 AS DOUBLE) AS x, CAST((s_suppkey * 104729) % 10007 AS DOUBLE) AS y FROM supplier), wi AS (SELECT a.site AS origin, b.site, b.layer, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS d FROM pt a JOIN pt b ON a.site <> b.site WHERE d <= 2000)"
near = lambda s, d: G.within(points(s, d).select(F.col("site").alias("origin"), "x", "y"), points(s, d), 2000.0, fine=4).filter("origin <> site")
beside = lambda s, d: G.neighbours(points(s, d), 2000.0)
query("grid_radius_join", f"{PTS} SELECT origin, site, d FROM wi")(lambda s, d: near(s, d).select("origin", "site", "d"))
query("within_km", f"{PTS} SELECT origin, layer, count(*) AS n FROM wi GROUP BY 1, 2")(lambda s, d: beside(s, d).select("origin", "layer", "n"))
query("nearest_poi", f"{PTS} SELECT origin, layer, d, site FROM (SELECT *, row_number() OVER (PARTITION BY origin, layer ORDER BY d, site) AS rn FROM wi) WHERE rn = 1")(lambda s, d: beside(s, d).select("origin", "layer", "d", "site"))
query("ring_check", f"{PTS} SELECT origin, site, CASE WHEN d <= 850 THEN 'yes' WHEN d <= 1150 THEN 'margin' ELSE 'no' END AS ring FROM wi")(lambda s, d: near(s, d).select("origin", "site", G.ring_check(F.col("d"), 1000.0).alias("ring")))


def in_polygon(s, d):
    p = lambda x, y: F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y"))
    ring = F.array(p(1000, 1000), p(9000, 2000), p(7000, 8000), p(4000, 4000), p(2000, 9000), p(1000, 1000))
    return points(s, d).select("site", G.inside(F.col("x"), F.col("y"), ring).alias("inside"))


_EDGES = [(1000, 1000, 9000, 2000), (9000, 2000, 7000, 8000), (7000, 8000, 4000, 4000), (4000, 4000, 2000, 9000), (2000, 9000, 1000, 1000)]
query("point_in_polygon", f"{PTS} SELECT site, (" + " + ".join(f"CASE WHEN ({b} > y) <> ({e} > y) AND x < ({c} - {a}) * (y - {b}) / ({e} - {b}) + {a} THEN 1 ELSE 0 END" for a, b, c, e in [tuple(map(float, t)) for t in _EDGES]) + ") % 2 = 1 AS inside FROM pt")(in_polygon)
# scoring and duties
CODES = {"catchment": ["1km", "2km", "outside"], "estate_tier": ["gcb", "prime", "good", "average"], "plot_shape": ["rectangular", "slightly_irregular", "irregular", "triangular"], "topography": ["above", "level", "below"], "zoning_risk": ["none", "high_plot_ratio_neighbour", "adjacent_nonlanded", "reserve_or_institution"], "flood_risk": ["none", "low", "high"], "future_risk": ["none", "some", "material"], "rebuild_status": ["rebuilt_recent", "rebuilt_old", "original_good", "original_poor"]}
code = lambda options, div: F.get(F.array(*map(F.lit, options)), (F.floor(F.col("p_partkey") / div) % (len(options) + 1)).cast("int"))
number = lambda div, mod: (F.floor(F.col("p_partkey") / div) % mod).cast("double")


def landed_scores(s, d):
    c = {k: code(v, i + 1) for i, (k, v) in enumerate(CODES.items())} | {"frontage_m": number(3, 13), "lw_ratio": number(2, 40) / 10, "hazards": number(5, 5), "corner": number(1, 2) == 1, "near_water": number(7, 3) == 0}
    rows = table(s, d, "part").select("p_partkey", K.score_landed(c).alias("total"))
    return rows.withColumn("verdict", K.verdict(F.col("total")))


def case_points(expr: str, options: dict, missing: int) -> str:
    return f"CASE {expr} " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(options.values())) + f" ELSE {missing} END"


_L = " + ".join(case_points(f"floor(p_partkey / {i + 1}) % {len(v) + 1}", {k2: K.LANDED[k][0][k2] for k2 in v}, K.LANDED[k][1]) for i, (k, v) in enumerate(CODES.items()))
query("score_landed", f"""WITH p AS (SELECT p_partkey, floor(p_partkey / 3) % 13 AS fr, (floor(p_partkey / 2) % 40) / 10 AS lw, floor(p_partkey / 5) % 5 AS hz, p_partkey % 2 = 1 AS corner, floor(p_partkey / 7) % 3 = 0 AS water, {_L} AS base FROM part),
t AS (SELECT p_partkey, CAST(base + CASE WHEN fr >= 10 THEN 6 WHEN fr >= 8 THEN 5 WHEN fr >= 6 THEN 3 ELSE 1 END + CASE WHEN lw BETWEEN 1.5 AND 2.5 THEN 5 WHEN (lw >= 1.2 AND lw < 1.5) OR (lw > 2.5 AND lw <= 3.5) THEN 3 ELSE 1 END + CASE hz WHEN 0 THEN 8 WHEN 1 THEN 5 WHEN 2 THEN 2 ELSE 0 END + CASE WHEN corner THEN 2 ELSE 0 END + CASE WHEN water THEN 0 ELSE 2 END AS INTEGER) AS total FROM p)
SELECT *, CASE WHEN total >= 80 THEN 'STRONG' WHEN total >= 65 THEN 'CONSIDER' WHEN total >= 50 THEN 'MARGINAL' ELSE 'PASS' END AS verdict FROM t""")(landed_scores)
query("value_flag", "WITH b AS (SELECT p_brand, quantile_cont(p_retailprice, 0.25) AS lo, quantile_cont(p_retailprice, 0.75) AS hi FROM part GROUP BY 1) SELECT p_partkey, CASE WHEN p_retailprice < lo THEN 'VALUE' WHEN p_retailprice <= hi THEN 'FAIR' WHEN p_retailprice <= hi * 1.25 THEN 'RICH' ELSE 'BUILD-PRICED' END AS flag FROM part JOIN b USING (p_brand)")(
    lambda s, d: (lambda p: p.join(p.groupBy("p_brand").agg(F.percentile("p_retailprice", F.array(F.lit(0.25), F.lit(0.75))).alias("q")), "p_brand").select("p_partkey", K.value_flag(F.col("p_retailprice"), F.col("q")[0], F.col("q")[1]).alias("flag")))(table(s, d, "part"))
)
BSD = lambda p: " + ".join(f"greatest(0.0, {f'least({p}, {hi})' if hi else p} - {lo}) * {r}" for lo, hi, r in C.BSD_TIERS)
query("bsd", f"SELECT o_orderkey, {BSD('(o_totalprice * 10)')} AS duty FROM orders")(lambda s, d: table(s, d, "orders").select("o_orderkey", C.bsd(F.col("o_totalprice") * 10).alias("duty")))
PROFILE = "CASE c_custkey % 6 WHEN 0 THEN 'SC' WHEN 1 THEN 'PR' WHEN 2 THEN 'FOREIGNER' WHEN 3 THEN 'ENTITY' WHEN 4 THEN 'TRUSTEE' ELSE 'OTHER' END"
query("absd", f"SELECT c_custkey, {PROFILE} AS profile, CASE {PROFILE} " + " ".join(f"WHEN '{k}' THEN CASE least(greatest(c_nationkey % 5, 1), 3) WHEN 1 THEN CAST({a} AS DOUBLE) WHEN 2 THEN CAST({b} AS DOUBLE) ELSE CAST({c} AS DOUBLE) END" for k, (a, b, c) in C.ABSD_RATES.items()) + " END AS rate FROM customer")(
    lambda s, d: table(s, d, "customer").withColumn("profile", F.get(F.array(*map(F.lit, ["SC", "PR", "FOREIGNER", "ENTITY", "TRUSTEE", "OTHER"])), (F.col("c_custkey") % 6).cast("int"))).select("c_custkey", "profile", C.absd_rate("profile", F.col("c_nationkey") % 5).alias("rate"))
)
query("ssd", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice * CASE WHEN l_quantity / 10 <= 1 THEN 0.16 WHEN l_quantity / 10 <= 2 THEN 0.12 WHEN l_quantity / 10 <= 3 THEN 0.08 WHEN l_quantity / 10 <= 4 THEN 0.04 ELSE 0 END AS duty FROM lineitem")(lambda s, d: table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", (F.col("l_extendedprice") * C.ssd_rate(F.col("l_quantity") / 10)).alias("duty")))
query("entry_costs", f"SELECT o_orderkey, {BSD('o_totalprice')} + o_totalprice * 0.2 + 3500 AS total, (o_totalprice + {BSD('o_totalprice')} + o_totalprice * 0.2 + 3500) / (1 - 0.04 - 0.02) / o_totalprice - 1 AS breakeven FROM orders")(
    lambda s, d: table(s, d, "orders").withColumn("total", C.bsd("o_totalprice") + F.col("o_totalprice") * C.absd_rate(F.lit("SC"), F.lit(2)) + 3500).select("o_orderkey", "total", C.breakeven_gain(F.col("o_totalprice"), F.col("total"), F.lit(4.0)).alias("breakeven"))
)
query("confidence", f"""{BASE}, g AS (SELECT project, count(*) AS n, (max(psf) - min(psf)) / avg(psf) / 20 AS spread FROM comps GROUP BY 1) SELECT project, greatest(20.0, 90 - 45 * exp(-n / 6) - least(greatest((spread - 0.05) * 160, 0), 35)) AS score FROM g""")(
    lambda s, d: comps(s, d).groupBy("project").agg(F.count("*").alias("n"), ((F.max("psf") - F.min("psf")) / F.avg("psf") / 20).alias("spread")).select("project", C.confidence(F.col("n"), F.lit(False), F.lit(0.0), F.col("spread")).alias("score"))
)
_ATTR = S.ATTRIBUTE.replace("'", "''")
query("html_attr_map", f"WITH a AS (SELECT unnest(regexp_extract_all(html, '{_ATTR}', 1)) AS name, unnest(regexp_extract_all(html, '{_ATTR}', 2)) AS value FROM pages) SELECT name, value, count(*) AS n FROM a GROUP BY 1, 2")(lambda s, d: S.attribute_counts(table(s, d, "pages")))
# a part's attributes as a table of marks, and counts of lines as nested series
PARTS_SQL = "concat('<table> <tr><th>LU_DESC </th>', CASE WHEN p_partkey % 2 = 0 THEN ' ' ELSE '' END, '<td><b>', p_type, '</b></td></tr><TR><TH>GPR</TH><TD> ', p_size, '</TD></TR><tr><th>LU_DESC</th> <td>', p_brand, '<br/></td></tr></table>')"
query("attr_table", "SELECT p_partkey, p_brand AS lu_desc, CAST(p_size AS VARCHAR) AS gpr, 2 AS n FROM part WHERE p_partkey % 5 > 0 UNION ALL SELECT p_partkey, NULL, NULL, NULL FROM part WHERE p_partkey % 5 = 0")(
    lambda s, d: table(s, d, "part").select("p_partkey", S.table_map(F.when(F.col("p_partkey") % 5 > 0, F.expr(PARTS_SQL)).otherwise("plain text")).alias("m")).select("p_partkey", F.try_element_at("m", F.lit("LU_DESC")).alias("lu_desc"), F.try_element_at("m", F.lit("GPR")).alias("gpr"), F.when(F.col("m").isNotNull(), F.size("m")).alias("n"))
)
COUNTS = "SELECT l_returnflag AS flag, l_linenumber AS line, year(l_shipdate) AS y, quarter(l_shipdate) AS q, count(*) AS n FROM lineitem GROUP BY 1, 2, 3, 4"


def series_json(s, d):
    """A statistical table a line number, with holes and keys that cannot be read."""
    counts = table(s, d, "lineitem").groupBy(F.col("l_returnflag").alias("flag"), F.col("l_linenumber").alias("line"), F.year("l_shipdate").alias("y"), F.quarter("l_shipdate").alias("q")).agg(F.count("*").alias("n"))
    key = F.when(F.col("y") == 1996, F.concat_ws("-", "y", "q")).otherwise(F.concat(F.lit(" "), F.col("y"), F.lit(" "), F.col("q"), F.lit("Q")))
    value = F.when(F.col("n") % 7 == 0, "na").when(F.col("n") % 7 == 1, "-").when(F.col("n") % 7 == 2, "n/a").otherwise(F.concat(F.col("n"), F.lit(".5")))
    rows = counts.groupBy("line", "flag").agg(F.collect_list(F.struct(key.alias("key"), value.alias("value"))).alias("columns"))
    tables = rows.groupBy("line").agg(F.collect_list(F.struct(F.when(F.col("flag") != "N", F.concat(F.lit(" "), "flag")).alias("rowText"), "columns")).alias("row"))
    return tables.select(F.to_json(F.struct(F.struct(F.concat(F.lit("Line "), "line").alias("title"), "row").alias("Data"))).alias("json"))


query("series_flatten", f"WITH c AS ({COUNTS}) SELECT 'Line ' || line AS title, CASE WHEN flag = 'N' THEN '?' ELSE flag END AS series, y || 'Q' || q AS quarter, CAST(n || '.5' AS DOUBLE) AS value FROM c WHERE y <> 1996 AND n % 7 > 2")(lambda s, d: S.series_points(series_json(s, d))[0])
query("series_rejects", f"WITH c AS ({COUNTS}) SELECT 'Line ' || line AS title, CASE WHEN flag = 'N' THEN '?' ELSE flag END AS series, count(*) AS n FROM c WHERE n % 7 > 1 AND (y = 1996 OR n % 7 = 2) GROUP BY 1, 2")(lambda s, d: S.series_points(series_json(s, d))[1].groupBy("title", "series").agg(F.count("*").alias("n")))
query("index_load", f"WITH c AS ({COUNTS}) SELECT 'Line ' || line AS title, flag AS series, y || 'Q' || q AS quarter, CAST(n || '.5' AS DOUBLE) AS value, CASE flag WHEN 'A' THEN 'all' ELSE 'landed' END AS kind FROM c WHERE y <> 1996 AND n % 7 > 2 AND flag IN ('A', 'R')")(lambda s, d: S.index_kinds(S.series_points(series_json(s, d))[0], {"a": "all", "r": "landed"}))
query("tenure_parse", """WITH t AS (SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN 'Freehold' WHEN p_size % 4 = 1 THEN '999 yrs lease commencing from 1885' WHEN p_size % 4 = 2 THEN '99 yrs lease commencing from ' || (1970 + p_size) ELSE 'N/A' END AS raw, p_size FROM part)
SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'freehold' WHEN 1 THEN 'freehold_equiv' WHEN 2 THEN 'leasehold' ELSE 'unknown' END AS tenure_type, CAST(CASE p_size % 4 WHEN 1 THEN 1885 WHEN 2 THEN 1970 + p_size END AS INTEGER) AS lease_start FROM t""")(
    lambda s, d: (lambda raw: table(s, d, "part").withColumn("raw", raw).select("p_partkey", S.tenure("raw")[0].alias("tenure_type"), S.tenure("raw")[1].alias("lease_start")))(F.when(F.col("p_size") % 4 == 0, "Freehold").when(F.col("p_size") % 4 == 1, "999 yrs lease commencing from 1885").when(F.col("p_size") % 4 == 2, F.concat(F.lit("99 yrs lease commencing from "), (1970 + F.col("p_size")).cast("string"))).otherwise("N/A"))
)
query("newest_snapshot", "SELECT event_id, user_id, value FROM events WHERE CAST(ts AS DATE) = (SELECT max(CAST(ts AS DATE)) FROM events)")(lambda s, d: S.newest(table(s, d, "events").withColumn("day", F.col("ts").cast("date")), "day").select("event_id", "user_id", "value"))
