"""Queries of postal codes, schools, stations, yields, cohorts and gates, with their SQL. Customers are addresses, orders are finished records."""

from __future__ import annotations

from pyspark.sql import functions as F

from hearthmark.operators import amenities as L
from hearthmark.operators import appraise as P
from hearthmark.operators import asof as A
from hearthmark.operators import estimators as E
from hearthmark.operators import gates as K
from hearthmark.plans import appraisals
from hearthmark.plans import valuation as V
from hearthmark.plans.caveats import CAVEATS_SQL, table
from hearthmark.plans.screens import LINES_SQL

QUERIES, ORACLES = {}, {}
CAP = 900.0


def view(spark, d, name: str, sql: str):
    sql = f"WITH {sql} SELECT * FROM {name}".replace("//", "DIV")
    names = [t for t in ("customer", "lineitem") if f"FROM {t}" in sql]
    for t in names:
        sql = sql.replace(f"FROM {t}", f"FROM {{{t}}}")
    return spark.sql(sql, **{t: table(spark, d, t) for t in names})


_CODE = "lpad(CAST((c_custkey * 104729) % 1000000 AS VARCHAR(9)), 6, '0')"
PLACES_SQL = f"""
sites AS (SELECT c_custkey AS id, CAST((c_custkey * 7919) % 10007 AS DOUBLE) AS x, CAST((c_custkey * 3571 + 11) % 10007 AS DOUBLE) AS y FROM customer),
posts AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 9 = 0 THEN concat('D', 1 + c_custkey % 28) WHEN c_custkey % 9 = 1 THEN '' END AS district, CASE c_custkey % 6 WHEN 0 THEN 'CCR' WHEN 1 THEN 'OCR' WHEN 2 THEN '' END AS region, CASE c_custkey % 7 WHEN 0 THEN substr({_CODE}, 1, 5) WHEN 1 THEN concat(' ', {_CODE}) WHEN 2 THEN NULL WHEN 3 THEN concat('S', substr({_CODE}, 2, 5)) ELSE {_CODE} END AS postal FROM customer),
taught AS (SELECT concat(' School ', c_custkey) AS name, CASE c_custkey % 5 WHEN 0 THEN 'PRIMARY' WHEN 1 THEN 'Mixed Level (P1-S4)' WHEN 2 THEN 'SECONDARY' WHEN 3 THEN 'primary' END AS level, CASE WHEN c_custkey % 11 = 0 THEN NULL WHEN c_custkey % 11 = 1 THEN ' ' ELSE {_CODE} END AS postal FROM customer),
coded AS (SELECT {_CODE} AS postal, CAST((c_custkey * 7919) % 10007 AS DOUBLE) AS x, CAST((c_custkey * 3571 + 11) % 10007 AS DOUBLE) AS y FROM customer WHERE c_custkey % 3 > 0),
entries AS (SELECT c_custkey AS seq, concat(' Stop ', c_custkey % 97, CASE c_custkey % 4 WHEN 0 THEN ' MRT STATION' WHEN 1 THEN ' LRT Station (EXIT A)' WHEN 2 THEN ' mrt station (NS1)' ELSE ' BUS STOP' END) AS name, CASE WHEN c_custkey % 19 > 0 THEN CAST((c_custkey * 6007) % 10007 AS DOUBLE) END AS x, CAST((c_custkey * 131) % 10007 AS DOUBLE) AS y FROM customer)"""
_DISTRICT = "CASE " + " ".join(f"WHEN sector IN ({', '.join(map(str, s))}) THEN {d}" for d, s in L.SECTORS.items()) + " END"
QUERIES["postal_map"] = lambda spark, d: L.postal_map(view(spark, d, "posts", PLACES_SQL))
ORACLES["postal_map"] = f"""WITH {PLACES_SQL}, s AS (SELECT *, CASE WHEN length(trim(postal)) = 6 THEN TRY_CAST(substr(trim(postal), 1, 2) AS INTEGER) END AS sector FROM posts),
n AS (SELECT *, coalesce(nullif(district, ''), CAST({_DISTRICT} AS VARCHAR)) AS district_no FROM s), g AS (SELECT *, TRY_CAST(regexp_extract(district_no, '([0-9]+)', 1) AS INTEGER) AS k FROM n),
h AS (SELECT *, CASE WHEN k IN {L.CORE} THEN 'CCR' WHEN k IN {L.REST} THEN 'RCR' WHEN k IS NOT NULL THEN 'OCR' END AS guess FROM g)
SELECT id, district, region, postal, district_no, coalesce(nullif(region, ''), guess) AS segment, CASE WHEN nullif(region, '') <> guess THEN 'by district ' || guess END AS note FROM h"""
QUERIES["poi_filter_join"] = lambda spark, d: L.schools(view(spark, d, "taught", PLACES_SQL), view(spark, d, "coded", PLACES_SQL))
ORACLES["poi_filter_join"] = f"""WITH {PLACES_SQL}, placed AS (SELECT postal, min((x, y)) AS spot FROM coded GROUP BY 1)
SELECT trim(name) AS name, trim(coalesce(t.postal, '')) AS postal, CASE WHEN trim(coalesce(t.postal, '')) = '' THEN 'no_postal' WHEN spot IS NULL THEN 'no_place' ELSE 'matched' END AS status, spot[1] AS x, spot[2] AS y FROM taught t LEFT JOIN placed ON placed.postal = trim(t.postal) WHERE upper(level) = 'PRIMARY' OR upper(level) LIKE 'MIXED LEVEL (P1%'"""
_STATIONS = f"""{PLACES_SQL}, st AS (SELECT upper(regexp_extract(trim(name), '{L.STATION}', 1)) AS station, * FROM entries WHERE x IS NOT NULL), first_ AS (SELECT * FROM st WHERE station <> '' QUALIFY row_number() OVER (PARTITION BY station ORDER BY seq) = 1),
stops AS (SELECT station, trim(name) AS name, CASE WHEN upper(name) LIKE '%LRT%' THEN 'light' ELSE 'heavy' END AS layer, x, y FROM first_)"""
QUERIES["poi_dedup"] = lambda spark, d: L.stations(view(spark, d, "entries", PLACES_SQL))
ORACLES["poi_dedup"] = f"WITH {_STATIONS} SELECT * FROM stops"
QUERIES["nearest_stations"] = lambda spark, d: L.nearest_few(view(spark, d, "sites", PLACES_SQL), L.stations(view(spark, d, "entries", PLACES_SQL)).withColumnRenamed("station", "site"), CAP, 2)
ORACLES["nearest_stations"] = f"""WITH {_STATIONS}, p AS (SELECT id, layer, station AS site, sqrt((s.x - t.x) * (s.x - t.x) + (s.y - t.y) * (s.y - t.y)) AS d FROM sites s JOIN stops t ON abs(s.x - t.x) <= {CAP} AND abs(s.y - t.y) <= {CAP})
SELECT id, layer, CAST(row_number() OVER (PARTITION BY id, layer ORDER BY d, site) AS INTEGER) AS rank, site, d FROM p WHERE d <= {CAP} QUALIFY rank <= 2"""

# a rent of 2.5 a square foot and month stands for the rents that these tables lack
QUERIES["segment_yield"] = lambda spark, d: L.segment_yield(V.inputs(spark, d)[1].withColumn("yield_pct", 3000 / F.col("psf")))
ORACLES["segment_yield"] = f"{V.BASE} SELECT market_segment, count(*) AS n, quantile_cont(3000 / psf, 0.5) AS median, min(3000 / psf) AS low, max(3000 / psf) AS high FROM comps GROUP BY 1"
QUERIES["era_bands"] = lambda spark, d: L.era_bands(V.inputs(spark, d)[1].select("street", "psf", F.year("contract_month").alias("year")), 1996, 1999)
ORACLES["era_bands"] = f"""{V.BASE}, y AS (SELECT street, psf, year(contract_month) AS y FROM comps)
SELECT street, {', '.join(f"{f}(psf) FILTER (y {c}) AS {n}_{k}" for n, c in (("early", "<= 1996"), ("recent", ">= 1999")) for k, f in (("n", "count"), ("low", "min"), ("high", "max")))} FROM y GROUP BY 1"""


def cohort(s, c):
    """Sales of the project within two percent of the subject's size: their count and median."""
    near = A.pairs(s, c, ["project"], extra=F.abs(F.col("area_sqft") - F.col("s_area_sqft")) / F.col("s_area_sqft") <= 0.02)
    return near.groupBy("s_id").agg(F.count("*").alias("n"), F.percentile("psf", F.lit(0.5)).alias("median"), F.max("floor_hi").alias("top_floor"))


def ladder(spark, d):
    """A row a subject: estimate, cohort and freshest sale, their band, how far the cohort is off the fresh sale, and the yield of the estimate."""
    s, c, i = V.inputs(spark, d)
    rows = E.c1_grid(s, c, i).select("s_id", F.col("psf").alias("est")).join(cohort(s, c).select("s_id", F.col("median").alias("cohort")), "s_id", "left").join(P.fresh_project(s, c, i), "s_id", "left")
    legs = ("est", "cohort", "ref_psf")
    return rows.select("s_id", *legs, "ref_month", F.least(*legs).alias("band_low"), F.greatest(*legs).alias("band_high"), ((F.col("cohort") / F.col("ref_psf") - 1) * 100).alias("bias_pct"), (3000 / F.col("est")).alias("yield_pct"))


_COHORT = f"SELECT s_id, count(*) AS n, quantile_cont(c_psf, 0.5) AS median, max(c_hi) AS top_floor FROM ({V.pair_sql(['project'])}) WHERE abs(c_area - s_area) / s_area <= 0.02 GROUP BY 1"
QUERIES["avm_cohort"] = lambda spark, d: cohort(*V.inputs(spark, d)[:2])
ORACLES["avm_cohort"] = f"{V.BASE} {_COHORT}"
QUERIES["yield_ladder"] = ladder
ORACLES["yield_ladder"] = f"""{V.BASE}, c1 AS ({V.ORACLES["c1_grid"]}), co AS ({_COHORT}),
ref AS (SELECT s_id, max_by(make_date(c_month // 12, c_month % 12 + 1, 1), (c_month, c_id)) AS ref_month, max_by({V.CAP} * pow(s_area / c_area, -0.07), (c_month, c_id)) AS ref_psf FROM ({V.pair_sql(["project"])}) WHERE abs(ln(c_area / s_area)) <= 0.22 GROUP BY 1)
SELECT s_id, psf AS est, median AS cohort, ref_psf, ref_month, least(psf, median, ref_psf) AS band_low, greatest(psf, median, ref_psf) AS band_high, (median / ref_psf - 1) * 100 AS bias_pct, 3000 / psf AS yield_pct FROM c1 LEFT JOIN co USING (s_id) LEFT JOIN ref USING (s_id)"""

_DUTY, _PAID = "CAST(round({bsd}) AS BIGINT)", "CAST(round(price * 0.75 * 0.0025 / (1 - power(1.0025, -360))) AS BIGINT)"
RECORDS_SQL = f"""{LINES_SQL}, duty AS (SELECT *, {_DUTY.format(bsd=appraisals._BSD)} AS due, {_PAID} AS paid, count(*) OVER (PARTITION BY o) AS many, CAST(price AS DOUBLE) / area AS est FROM lines),
records AS (SELECT o AS id, concat('Unit ', p) AS name, CAST(area AS DOUBLE) AS size_sqft, est AS estimate_psf, CASE WHEN p % 23 = 0 THEN CAST(price AS DOUBLE) + 2001 WHEN p % 31 > 0 THEN CAST(price AS DOUBLE) END AS estimate_price, est * CASE WHEN u % 10 = 0 THEN 1.1 ELSE 0.9 END AS low_psf, CASE WHEN u % 7 > 0 THEN est * 1.2 END AS high_psf,
  concat('grid of ', many + CASE WHEN o % 6 = 0 THEN 1 ELSE 0 END, ' 笔') AS params_note, CASE WHEN p % 13 > 0 THEN '2024-01' END AS asof, concat('点估 S$', price + CASE WHEN o % 8 = 0 THEN 1 ELSE 0 END, CASE WHEN p % 5 = 0 THEN concat(', 点估 ~S$', CAST(floor(est) AS BIGINT) + o % 2, ' psf') ELSE '' END, CASE o % 9 WHEN 1 THEN ' **bold**' WHEN 2 THEN ' TODO' WHEN 3 THEN ' â€œ' ELSE '' END) AS summary,
  CASE WHEN u % 4 > 0 THEN concat('BSD（点估 S$', price, '）≈ S$', due + CASE WHEN u % 3 = 0 THEN 5 ELSE 0 END, '; 75% LTV @3.0% 固定 ≈ S$', paid + CASE WHEN u % 5 = 0 THEN 9 ELSE 0 END, '/mo') END AS cost_stack, CASE WHEN o % 4 = 0 THEN floor(est) + 1 END AS extra FROM duty WHERE rn = 1),
rows_ AS (SELECT o AS id, CAST(price AS DOUBLE) AS price, CAST(price AS DOUBLE) / area * CASE WHEN p % 15 = 0 THEN 1.03 ELSE 1.0 END AS psf, CAST(area AS DOUBLE) AS size_sqft, CASE WHEN p % 12 = 0 THEN NULL WHEN u % 2 = 0 THEN 'URA print' ELSE 'a caveat' END AS note FROM lines)"""
QUERIES["quality_gates"] = lambda spark, d: K.quality_gates(view(spark, d, "records", RECORDS_SQL).withColumn("allowed_psf", F.when(F.col("extra").isNotNull(), F.array(F.col("extra").cast("double")))).drop("extra"), view(spark, d, "rows_", RECORDS_SQL))
_CITED = lambda pattern, group=1: f"CAST(nullif(replace(regexp_extract(summary, '{pattern}', {group}), ',', ''), '') AS BIGINT)"
_FIG = lambda pattern, i: f"CAST(nullif(replace(regexp_extract(coalesce(cost_stack, ''), '{pattern}', {i}), ',', ''), '') AS DOUBLE)"
_GATES = {
    "fields": "estimate_price IS NOT NULL AND high_psf IS NOT NULL AND \"asof\" IS NOT NULL",
    "price_is_psf_by_size": "CASE WHEN estimate_price IS NOT NULL THEN abs(estimate_price - estimate_psf * size_sqft) <= 2000 END",
    "point_in_range": "CASE WHEN estimate_price IS NOT NULL THEN estimate_psf BETWEEN low_psf AND coalesce(high_psf, 1e9) END",
    "one_estimate": "CASE WHEN estimate_price IS NOT NULL THEN NOT (coalesce((said >= 100000 AND said <> floor(estimate_price)), false) OR coalesce(base >= 1000000 AND base <> floor(estimate_price), false) OR coalesce(said_psf BETWEEN 500 AND 20000 AND said_psf <> floor(estimate_psf) AND said_psf <> floor(low_psf) AND said_psf <> floor(coalesce(high_psf, 0)) AND said_psf <> coalesce(extra, 0), false)) END",
    "duty": f"CASE WHEN estimate_price IS NOT NULL AND base IS NOT NULL THEN base = floor(estimate_price) AND abs(due - round({appraisals._BSD.replace('price', 'base')})) <= 1 END",
    "instalment": "CASE WHEN estimate_price IS NOT NULL AND paid IS NOT NULL THEN abs(paid - estimate_price * 0.75 * 0.0025 / (1 - pow(1.0025, -360))) <= 2 END",
    "count_in_note": "contains(params_note, n || ' 笔')", "encoding": "NOT contains(summary, 'â€')", "asterisks": "NOT contains(summary, '**')", "placeholders": "NOT contains(summary, 'TODO')", "rows_arithmetic": "n_off = 0", "provenance": "n_unmarked = 0",
}
ORACLES["quality_gates"] = f"""WITH {RECORDS_SQL}, k AS (SELECT id, count(*) AS n, count(*) FILTER (abs(price - psf * size_sqft) / price > 0.02) AS n_off, count(*) FILTER (note IS NULL) AS n_unmarked FROM rows_ GROUP BY 1),
r AS (SELECT *, {_CITED(K.PRICE_CITED)} AS said, {_CITED(K.PSF_CITED)} AS said_psf, {_FIG(K.DUTY, 1)} AS base, {_FIG(K.DUTY, 2)} AS due, {_FIG(K.LOAN, 2)} AS paid FROM records JOIN k USING (id)),
g AS ({' UNION ALL '.join(f"SELECT id, '{name}' AS gate, {ok} AS ok FROM r" for name, ok in _GATES.items())}) SELECT * FROM g WHERE ok IS NOT NULL"""
