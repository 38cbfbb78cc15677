"""Queries that hold one source against another, with their SQL. Captured rows are every third sale, under a road of their own; some are told twice."""

from __future__ import annotations

from pyspark.sql import functions as F

from hearthmark.operators import crosscheck as K
from hearthmark.operators import effects as X
from hearthmark.operators import estimators as E
from hearthmark.operators import models as M
from hearthmark.plans import analytics as N
from hearthmark.plans import surfaces as U
from hearthmark.plans import valuation as V
from hearthmark.plans.caveats import caveats, table
from hearthmark.sources import ingest as S

QUERIES, ORACLES = {}, {}
EARLY = "1996-01-01"
SIZES = {10: "0-10", 20: "10-20", 35: "20-35"}  # areas here end at 50


def query(name: str, run, sql: str | None = None) -> None:
    QUERIES[name] = run
    if sql:
        ORACLES[name] = sql


def band():
    out = None
    for edge, name in SIZES.items():
        out = (F if out is None else out).when(F.col("area_sqft") < edge, name)
    return out.otherwise("35+")


_BAND = "CASE " + " ".join(f"WHEN area_sqft < {edge} THEN '{name}'" for edge, name in SIZES.items()) + " ELSE '35+' END"


def slopes(s, d):
    slices = {"type": F.col("property_type"), "tenure": F.col("tenure_type"), "segment": F.col("market_segment"), "size": band(), "size_segment": F.concat_ws("/", band(), "market_segment")}
    return K.fe_slopes(X.adjusted(N.comps(s, d), N.market(s, d)), ["street", "property_type"], slices, F.col("contract_month") < F.lit(EARLY).cast("date"))


query("fe_slopes", slopes, f"""{N.INDEX}, a AS (SELECT street, property_type, contract_month, ln(area_sqft) AS x, ln(psf / value) AS y, unnest([struct_pack(s := 'all', l := 'all'), struct_pack(s := 'type', l := property_type), struct_pack(s := 'tenure', l := tenure_type), struct_pack(s := 'segment', l := market_segment), struct_pack(s := 'size', l := {_BAND}), struct_pack(s := 'size_segment', l := concat({_BAND}, '/', market_segment))]) AS e FROM comps JOIN mkt USING (q)),
b AS (SELECT 'full' AS period, * FROM a UNION ALL SELECT 'early', * FROM a WHERE contract_month < DATE '{EARLY}'),
g AS (SELECT period, e.s AS slice, e.l AS level, count(*) AS n, covar_pop(x, y) * count(*) AS sxy, var_pop(x) * count(*) AS sxx FROM b GROUP BY 1, 2, 3, street, property_type HAVING count(*) >= 2 AND max(x) - min(x) >= 1e-9)
SELECT period, slice, level, CASE WHEN sum(sxx) > 1e-12 THEN sum(sxy) / sum(sxx) END AS slope, CAST(sum(n) AS BIGINT) AS n, count(*) AS groups FROM g GROUP BY 1, 2, 3""")

plots = lambda s, d: caveats(s, d).withColumn("plot", F.concat_ws("/", "project", "street", "market_segment"))
pairs = lambda s, d: X.repeat_pairs(X.repeat_groups(plots(s, d), "plot"), "plot")
PAIRS = N.PAIRS_SQL.replace("concat_ws('/', project, street)", "concat_ws('/', project, street, market_segment)")
query("noise_floors", lambda s, d: K.noise_floors(pairs(s, d), N.market(s, d), F.substring_index("plot", "/", -1)), f"""{PAIRS}, mkt AS (SELECT q, avg(psf) AS value FROM caveats GROUP BY 1),
e AS (SELECT abs(ln(ratio) - ln(t.value / f.value)) AS error, unnest([struct_pack(s := 'all', l := 'all'), struct_pack(s := 'trimmed', l := CASE WHEN abs(annualised) <= 0.60 THEN 'yes' END), struct_pack(s := 'kind', l := split_part(plot, '/', 3)), struct_pack(s := 'gap', l := CASE WHEN gap <= 6 THEN '1-6' WHEN gap <= 12 THEN '7-12' ELSE '13-18' END)]) AS e FROM rp JOIN mkt t ON t.q = month_idx // 3 JOIN mkt f ON f.q = (month_idx - gap) // 3 WHERE gap BETWEEN 1 AND 18)
SELECT e.s AS slice, e.l AS level, count(*) AS n, quantile_cont(error, 0.5) AS median, quantile_cont(error, 0.75) AS p75, quantile_cont(error, 0.9) AS p90, quantile_cont(error, 0.5) / sqrt(2) AS floor FROM e WHERE e.l IS NOT NULL GROUP BY 1, 2""")
query("spot_check", lambda s, d: K.spot_check(pairs(s, d), F.col("plot")), f"{PAIRS} SELECT * FROM rp ORDER BY md5(concat_ws(':', '7', plot, month_idx)), plot LIMIT 25")

# captured rows: of one sale in three, a twelfth of them read again under another road
_SEEN = """SELECT street, contract_month + CAST(floor_lo AS INTEGER) AS day, price, concat('Road ', street, CASE WHEN project % 2 = 0 THEN ' East' ELSE ' West' END) AS road, 1 AS capture, id AS pos FROM caveats WHERE project % 3 = 0
UNION ALL SELECT street, contract_month + CAST(floor_lo AS INTEGER), price, concat('Road ', street, ' Close'), 2, id FROM caveats WHERE project % 36 = 0"""


def seen(s, d):
    c = caveats(s, d).withColumn("day", F.date_add("contract_month", F.col("floor_lo")))
    side = F.when(F.col("project") % 2 == 0, " East").otherwise(" West")
    first = c.filter("project % 3 = 0").select("street", "day", "price", F.concat(F.lit("Road "), F.col("street").cast("string"), side).alias("road"), F.lit(1).alias("capture"), F.col("id").alias("pos"))
    again = c.filter("project % 36 = 0").select("street", "day", "price", F.concat(F.lit("Road "), F.col("street").cast("string"), F.lit(" Close")).alias("road"), F.lit(2).alias("capture"), F.col("id").alias("pos"))
    return first.unionByName(again)


ROADS = f"""{N.BASE}, seen AS ({_SEEN}), told AS (SELECT street, CAST(date_trunc('month', day) AS DATE) AS contract_month, CAST(round_even(price, 0) AS BIGINT) AS whole, max_by(road, (capture, pos)) AS road, count(DISTINCT road) AS n_roads FROM seen GROUP BY 1, 2, 3),
roads AS (SELECT c.*, road, coalesce(n_roads, 0) AS n_roads FROM comps c LEFT JOIN told t ON t.street = c.street AND t.contract_month = c.contract_month AND t.whole = CAST(round_even(c.price, 0) AS BIGINT))"""
found = lambda s, d: K.true_roads(N.comps(s, d), seen(s, d))
query("true_roads", lambda s, d: found(s, d).select("id", "street", "road", "n_roads"), f"{ROADS} SELECT id, street, road, n_roads FROM roads")
query("road_shares", lambda s, d: K.road_shares(found(s, d)), f"""{ROADS}, w AS (SELECT street, quantile_cont(psf, 0.5) AS street_mid FROM roads GROUP BY 1)
SELECT r.street, road, count(*) AS n, count(*) FILTER (n_roads > 1) AS told_twice, quantile_cont(psf, 0.5) AS mid, quantile_cont(psf, 0.5) / any_value(street_mid) - 1 AS apart FROM roads r JOIN w USING (street) GROUP BY 1, 2""")


def compared(s, d):
    subjects, comps, index = V.inputs(s, d)
    return K.beside_estimates(subjects, comps, E.lc2_curve(subjects, comps, index))


query("street_compare", compared, f"""{V.BASE}, lc2 AS ({V.ORACLES["lc2_curve"]}), ty AS (SELECT street, property_type, min(contract_month) AS first_ FROM comps GROUP BY 1, 2),
o AS (SELECT s.id AS s_id, coalesce(last_day(first_) + 56 <= s.as_of, false) AS own FROM subj s LEFT JOIN ty USING (street, property_type)),
g AS (SELECT p.s_id, count(*) AS n, quantile_cont(c_psf, 0.25) AS p25, quantile_cont(c_psf, 0.5) AS mid, quantile_cont(c_psf, 0.75) AS p75, count(*) FILTER (age < 12) AS n12, quantile_cont(c_psf, 0.5) FILTER (age < 12) AS mid12 FROM ({V.pair_sql(["street"])}) p JOIN o ON o.s_id = p.s_id JOIN comps k ON k.id = p.c_id WHERE abs(c_area / s_area - 1) <= 0.06 AND (NOT own OR k.property_type = p.property_type) GROUP BY 1)
SELECT o.s_id, CASE WHEN own THEN 'own' ELSE 'all' END AS kind, coalesce(n, 0) AS n, p25, mid, p75, coalesce(n12, 0) AS n12, mid12, lc2.psf, mid12 / lc2.psf - 1 AS gap, CASE WHEN n IS NULL THEN 'no_prints' WHEN lc2.psf IS NULL THEN 'no_estimate' WHEN mid12 IS NULL THEN 'none_this_year' WHEN abs(mid12 / lc2.psf - 1) <= 0.10 THEN 'corroborates' ELSE 'check' END AS reading FROM o LEFT JOIN g USING (s_id) LEFT JOIN lc2 USING (s_id)""")


def trended(s, d):
    """The trend of all sales, fitted once, beside the index: from each December to the next, and to the last month."""
    c = N.comps(s, d)
    last = c.agg(F.max(F.last_day("contract_month")).alias("m")).select(F.date_add("m", V.A.LAG_DAYS).alias("as_of"))
    first, end = c.agg(F.min("month_idx"), F.max("month_idx")).first()
    stops = [m for m in range(first, end + 1) if m % 12 == 11] + [end] if first is not None else []
    spans = [(a, b) for a, b in zip(stops, stops[1:]) if a < b]
    return K.trend_beside_index(M.local_trend(c, last, ["street", "property_type"]), V.index_q(caveats(s, d)), spans)


query("trend_beside_index", trended)
query("grid_ready", lambda s, d: K.grid_ready(U.imputed(s, d), ["beds", "block"]).select("id", "project", "floor", "stack", "day", "area", "price", "status", "reason"), f"WITH {U.IMPUTE_SQL} SELECT id, project, floor, stack, day, area, price, CASE WHEN coalesce(beds, 0) <> 0 AND coalesce(block, '') NOT IN ('', '0', '0.0') THEN 'comp' ELSE 'skipped' END AS status, nullif(concat_ws(',', CASE WHEN coalesce(beds, 0) = 0 THEN 'beds' END, CASE WHEN coalesce(block, '') IN ('', '0', '0.0') THEN 'block' END), '') AS reason FROM imputed")


def asks(s, d):
    n = F.col("p_partkey")
    unit = F.format_string("#%02d-%02d", (n % 40).cast("int"), (n % 7).cast("int"))
    return table(s, d, "part").select(n.alias("id"), F.when(n % 3 == 0, F.concat(F.col("p_name"), F.lit(" "), unit)).otherwise(F.col("p_name")).alias("name"), F.when(n % 4 == 1, unit).when(n % 4 == 2, "").alias("unit"), F.when(n % 5 > 0, F.col("p_size") * 10.0).alias("size_sqft"), (n % 40).cast("int").alias("floor"), F.when(n % 11 > 0, n % 4).alias("bedrooms"))


query("subject_ready", lambda s, d: K.subject_ready(asks(s, d), ["size_sqft", "floor", "bedrooms"]).select("id", "unit", "reason", "status"), """WITH a AS (SELECT p_partkey AS id, concat('#', lpad(CAST(p_partkey % 40 AS VARCHAR), 2, '0'), '-', lpad(CAST(p_partkey % 7 AS VARCHAR), 2, '0')) AS u, p_partkey AS n FROM part),
r AS (SELECT id, CASE WHEN n % 4 = 1 OR n % 3 = 0 THEN u END AS unit, nullif(concat_ws(',', CASE WHEN n % 5 = 0 THEN 'size_sqft' END, CASE WHEN n % 40 = 0 THEN 'floor' END, CASE WHEN n % 11 = 0 OR n % 4 = 0 THEN 'bedrooms' END), '') AS reason FROM a)
SELECT *, CASE WHEN reason IS NOT NULL THEN 'incomplete' WHEN unit IS NULL THEN 'no_unit' ELSE 'ready' END AS status FROM r""")

_LINE = "concat(CASE WHEN y % 4 = 0 THEN ' ' ELSE '' END, y, ',', n, '.25', CASE WHEN y % 2 = 0 THEN ',note' ELSE '' END)"
query("year_values", lambda s, d: S.year_values(table(s, d, "orders").groupBy(F.year("o_orderdate").alias("y")).agg(F.count("*").alias("n")).select(F.expr(_LINE).alias("line")).unionByName(s.createDataFrame([("Year,Hectares",), ("",)], "line string")), "line", "hectares"), "SELECT CAST(year(o_orderdate) AS INTEGER) AS year, CAST(concat(count(*), '.25') AS DOUBLE) AS hectares FROM orders GROUP BY 1")

_GATE_SQL = {"subjects": "resales >= 10000", "months": "months >= 48", "pairs": "pairs >= 500", "short_pairs": "short >= 300", "band": "band_cut = 0"}
_TOLD = {"hygiene": "bulk_dropped band_cut", "copies": "surplus share", "subjects": "resales months", "streets": "n mid p90", "matcher": "plots pairs short wild wild_share"}
query("slice_audit", lambda s, d: K.slice_audit(caveats(s, d), pairs(s, d), "plot", 500.0, 6500.0, "F"), f"""{PAIRS}, h AS (SELECT count(*) FILTER (no_of_units > 1) AS bulk_dropped, count(*) FILTER (no_of_units <= 1 AND NOT psf BETWEEN 500 AND 6500) AS band_cut FROM caveats),
c AS (SELECT CAST(sum(k - 1) AS DOUBLE) AS surplus, sum(k - 1) / sum(k) AS share FROM (SELECT count(*) AS k FROM comps GROUP BY street, area_sqft, property_type, month_idx, price)),
s AS (SELECT count(*) FILTER (type_of_sale = 'F') AS resales, count(DISTINCT month_idx) AS months FROM comps), st AS (SELECT list_sort(list(k)) AS ks FROM (SELECT count(*) AS k FROM comps WHERE type_of_sale = 'F' GROUP BY street)),
t AS (SELECT len(ks) AS n, ks[len(ks) // 2 + 1] AS mid, ks[CAST(floor(0.9 * (len(ks) - 1)) AS INTEGER) + 1] AS p90 FROM st), m AS (SELECT count(DISTINCT plot) AS plots, count(*) AS pairs, count(*) FILTER (gap <= 18) AS short, count(*) FILTER (annualised < -0.30 OR annualised > 0.60) AS wild, count(*) FILTER (annualised < -0.30 OR annualised > 0.60) / count(*) AS wild_share FROM rp),
o AS (SELECT * FROM h, c, s, t, m) """ + " UNION ALL ".join([f"SELECT '{section}' AS section, '{name}' AS measure, CAST({name} AS DOUBLE) AS value FROM o" for section, names in _TOLD.items() for name in names.split()] + [f"SELECT 'gates', '{gate}', CAST(CAST({rule} AS INT) AS DOUBLE) FROM o" for gate, rule in (_GATE_SQL | {"pass": " AND ".join(_GATE_SQL.values())}).items()]))
