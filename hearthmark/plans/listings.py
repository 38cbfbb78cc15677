"""Queries of cards, listings, panels and merged items, with their SQL. The sources are views: an order's lines are cards, panel rows and items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hearthmark.operators import listings as L
from hearthmark.plans.caveats import table
from hearthmark.plans.screens import LINES_SQL, grouped

QUERIES, ORACLES = {}, {}


def drawn(spark: SparkSession, sf_dir: str, name: str, sql: str) -> DataFrame:
    return spark.sql(f"WITH {sql} SELECT * FROM {name}".replace("//", "DIV").replace("FROM lineitem", "FROM {lineitem}"), lineitem=table(spark, sf_dir, "lineitem"))


CARDS_SQL = f"""{LINES_SQL},
cards AS (SELECT concat(o, '-', rn) AS listing_id, CASE p % 17 WHEN 0 THEN 'ad' WHEN 1 THEN NULL ELSE 'listing' END AS card_kind,
  CASE WHEN u % 13 = 0 THEN concat('S$ ', {grouped('psf')}, ' /mo') WHEN p % 29 = 0 THEN 'Price on ask' ELSE concat('S$ ', {grouped('price')}) END AS price,
  CASE p % 6 WHEN 0 THEN concat({grouped('area')}, ' sqft (land)') WHEN 1 THEN concat({grouped('area')}, ' sqft (Built-up)') WHEN 2 THEN concat({grouped('area')}, ' SQFT (built up)') WHEN 3 THEN concat({grouped('area')}, 'sqft (floor)') WHEN 4 THEN concat({grouped('area')}, ' sqft') ELSE 'N/A' END AS area,
  CASE WHEN u % 11 = 0 THEN '' WHEN u % 5 = 0 THEN concat('Rise ', ln) ELSE concat(u + 1, CASE WHEN u % 3 = 0 THEN 'A' ELSE '' END, ' Rise ', ln) END AS address, concat('House ', p) AS title,
  CASE p % 5 WHEN 0 THEN 'Terraced House' WHEN 1 THEN ' Corner Terrace ' WHEN 2 THEN 'Good Class Bungalow' WHEN 3 THEN 'Loft' ELSE NULL END AS property_type,
  CASE o % 5 WHEN 0 THEN 'Freehold' WHEN 1 THEN '999-year lease' WHEN 2 THEN '99 years' WHEN 3 THEN '' ELSE NULL END AS tenure,
  CASE WHEN qty % 3 = 0 THEN 'Studio' ELSE CAST(qty % 6 AS VARCHAR(9)) END AS bedrooms, CASE WHEN p % 4 > 0 THEN concat('Built: ', 1970 + p % 50) END AS completion_year, concat('S$ ', {grouped('psf')}, ' psf') AS price_psf FROM lines),
old AS (SELECT concat(o, '-', rn) AS id, concat('Kept ', u) AS street, CAST(price AS DOUBLE) AS price, CASE WHEN p % 4 > 0 THEN 'A' END AS estate_tier, CASE WHEN p % 3 > 0 THEN CAST(area + 7 AS DOUBLE) END AS land_sqft, CAST(NULL AS DOUBLE) AS builtup_sqft FROM lines WHERE o % 3 = 0
  UNION ALL SELECT concat('old-', o), concat('Kept ', u), CAST(price AS DOUBLE), 'B', CAST(area AS DOUBLE), NULL FROM lines WHERE rn = 1 AND o % 5 = 0)"""
_SIZE = f"nullif(regexp_extract(area, '{L.AREA}', 1), '')"
_MARK = f"nullif(regexp_replace(lower(regexp_extract(area, '{L.AREA}', 2)), '[ -]', '', 'g'), '')"
_NUM = lambda c: f"TRY_CAST(nullif(regexp_replace({c}, '[^0-9.]', '', 'g'), '') AS DOUBLE)"
_KIND = "CASE lower(trim(property_type)) " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in L.KINDS.items()) + " ELSE nullif(lower(trim(property_type)), '') END"
_TENURE = "CASE WHEN tenure ILIKE '%freehold%' THEN 'freehold' WHEN tenure LIKE '%999%' THEN '999' WHEN tenure LIKE '%99%' THEN '99' ELSE 'unknown' END"
LISTED_SQL = f"""{CARDS_SQL},
c1 AS (SELECT * REPLACE ({_TENURE} AS tenure), CASE WHEN card_kind <> 'listing' THEN 'not_listing' WHEN price LIKE '%/mo%' THEN 'rent' END AS reject, {_NUM(_SIZE)} AS size, {_MARK} AS mark, {_NUM('price')} AS asked FROM cards),
c2 AS (SELECT listing_id AS id, reject, coalesce(nullif(regexp_replace(trim(address), '{L.HOUSE}', ''), ''), title) AS street, {_KIND} AS type, asked AS price, tenure, CASE WHEN regexp_matches(bedrooms, '^[0-9]+$') THEN CAST(bedrooms AS INTEGER) END AS beds, TRY_CAST(regexp_extract(completion_year, '{L.YEAR}', 1) AS INTEGER) AS built_year,
  CASE WHEN mark = 'land' THEN size END AS land_sqft, CASE WHEN mark = 'land' THEN round(asked / size) END AS land_psf, CASE WHEN coalesce(mark, '') <> 'land' THEN size END AS builtup_sqft, CASE WHEN coalesce(mark, '') <> 'land' AND size IS NOT NULL THEN nullif({_NUM('price_psf')}, 0) END AS floor_psf,
  concat_ws(',', CASE WHEN coalesce(mark, '') = 'land' THEN NULL WHEN size IS NULL THEN 'no_area' ELSE 'area_unconfirmed' END, CASE WHEN tenure = 'unknown' THEN 'tenure_unknown' END) AS warns FROM c1 WHERE reject IS NULL),
merged AS (SELECT coalesce(k.id, p.id) AS id, CASE WHEN k.id IS NULL THEN 'new' WHEN p.id IS NULL THEN 'missing' ELSE 'updated' END AS status, CASE WHEN p.id IS NULL THEN k.street ELSE p.street END AS street, CASE WHEN p.id IS NULL THEN k.price ELSE p.price END AS price, k.estate_tier, coalesce(p.land_sqft, k.land_sqft) AS land_sqft, coalesce(p.builtup_sqft, k.builtup_sqft) AS builtup_sqft, p.tenure FROM old k FULL JOIN c2 p ON k.id = p.id)"""


def cards(spark, d):
    return L.card_normalize(drawn(spark, d, "cards", CARDS_SQL))


def imported(spark, d):
    kept = drawn(spark, d, "old", CARDS_SQL)
    return L.import_listings(kept, cards(spark, d).filter("reject IS NULL").select("id", "street", "price", "tenure", "land_sqft", "builtup_sqft"), ["estate_tier"], ["land_sqft", "builtup_sqft"])


QUERIES["card_normalize"] = cards
ORACLES["card_normalize"] = f"WITH {LISTED_SQL} SELECT * FROM c2 UNION ALL SELECT listing_id, reject, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM c1 WHERE reject IS NOT NULL"
QUERIES["listing_import"] = imported
ORACLES["listing_import"] = f"WITH {LISTED_SQL} SELECT * FROM merged"
QUERIES["listing_counts"] = lambda spark, d: L.import_counts(cards(spark, d), imported(spark, d))
ORACLES["listing_counts"] = f"""WITH {LISTED_SQL} SELECT what, count(*) AS n FROM (SELECT 'reject:' || reject AS what FROM c1 WHERE reject IS NOT NULL UNION ALL SELECT 'warn:' || w FROM (SELECT unnest(string_split(warns, ',')) AS w FROM c2) WHERE w <> '' UNION ALL SELECT 'status:' || status FROM merged) GROUP BY 1"""

PANEL_SQL = f"""{LINES_SQL},
band AS (SELECT concat('RISE ', p) AS project, o * 10 + rn AS seq, psf AS psf_low, psf + 300 AS psf_high, 'band' AS psf_source FROM lines WHERE o % 7 = 0),
near AS (SELECT concat(' Rise ', p, ' ') AS project, o * 10 + rn AS seq, CASE WHEN u % 3 > 0 THEN psf END AS psf_low, CASE WHEN u % 3 > 0 THEN psf + 200 END AS psf_high, CASE WHEN u % 3 > 0 THEN 'nearby' END AS psf_source, CASE WHEN qty % 2 = 0 THEN qty END AS units, u AS anchor FROM lines WHERE ln <= 3),
info AS (SELECT concat('rise ', p) AS project, o * 10 + rn AS seq, CASE WHEN u % 4 = 0 THEN qty * 10 END AS units, concat('Dev ', u) AS developer FROM lines WHERE rn = 1)"""
QUERIES["panel_merge"] = lambda spark, d: L.panel_merge([drawn(spark, d, n, PANEL_SQL) for n in ("band", "near", "info")])
_LAST = lambda c: f"max_by({c}, (r, seq, {c})) FILTER ({c} IS NOT NULL) AS {c}"
ORACLES["panel_merge"] = f"""WITH {PANEL_SQL}, u AS (SELECT 0 AS r, * FROM band UNION ALL BY NAME SELECT 1 AS r, * FROM near UNION ALL BY NAME SELECT 2 AS r, * FROM info)
SELECT min_by(trim(project), (r, seq, project)) AS project, {', '.join(map(_LAST, ('psf_low', 'psf_high', 'psf_source', 'units', 'anchor', 'developer')))}, count(DISTINCT r) AS sources FROM u GROUP BY lower(trim(project))"""

STREET_SQL = f"""{LINES_SQL},
panel AS (SELECT concat(CASE WHEN u % 10 = 0 THEN 'Nearby Loop ' ELSE 'Loop ' END, u % 40, CASE u % 4 WHEN 0 THEN ' Road' WHEN 1 THEN '' WHEN 2 THEN ' (north)' ELSE ' Avenue' END) AS street, CASE WHEN ln % 2 = 0 THEN 'pp' ELSE 'txn' END AS kind, concat(p % 20, ' Loop') AS address, CAST(year(d) AS VARCHAR(9)) AS date, qty AS price, CASE WHEN p % 9 > 0 THEN psf END AS psf, o * 10 + rn AS seq FROM lines)"""
QUERIES["street_panel"] = lambda spark, d: L.street_panel(drawn(spark, d, "panel", STREET_SQL), ["north"])
ORACLES["street_panel"] = f"""WITH {STREET_SQL}, b AS (SELECT *, lower(regexp_replace(street, '\\s*\\(north\\)$', '')) AS low FROM panel), k AS (SELECT *, CASE WHEN low LIKE '%nearby%' THEN lower(street) WHEN low LIKE '%road' OR low LIKE '%avenue' THEN low ELSE low || ' road' END AS base FROM b),
one AS (SELECT base, kind, arg_min(psf, (seq, psf)) AS psf FROM (SELECT * REPLACE (coalesce(psf, -1) AS psf) FROM k) GROUP BY base, kind, address, date, price)
SELECT base, min_by(street, (seq, street)) AS street, any_value(n_pp) AS n_pp, any_value(n_txn) AS n_txn, any_value(lo) AS psf_low, any_value(hi) AS psf_high FROM k JOIN (SELECT base, count(*) FILTER (kind = 'pp' AND psf > 0) AS n_pp, count(*) FILTER (kind = 'txn') AS n_txn, min(psf) FILTER (kind = 'pp' AND psf > 0) AS lo, max(psf) FILTER (kind = 'pp' AND psf > 0) AS hi FROM one GROUP BY 1) USING (base) GROUP BY 1"""

RULES, OLD = [("flood", "ponding"), ("survey", "boundary"), ("school", "catchment")], {"Fair value": "superseded by the record"}
ITEMS_SQL = f"""{LINES_SQL},
items AS (SELECT o AS subject, 'tool' AS origin, rn AS pos, concat(CASE p % 4 WHEN 0 THEN 'Check Ponding at ' WHEN 1 THEN 'Boundary of ' WHEN 2 THEN 'Catchment of ' ELSE 'Visit ' END, p) AS item FROM lines
  UNION ALL SELECT o, 'authored', rn, concat(CASE u % 5 WHEN 0 THEN 'Ask about FLOOD at ' WHEN 1 THEN 'Survey ' WHEN 2 THEN 'School for ' WHEN 3 THEN 'Fair value of ' ELSE 'Note ' END, u) FROM lines WHERE ln <= 3)"""
QUERIES["merge_items"] = lambda spark, d: L.merge_items(drawn(spark, d, "items", ITEMS_SQL), RULES, OLD)
# each of these items holds one topic at most, so that the first unused one is the one of the same place within subject and topic
ORACLES["merge_items"] = f"""WITH {ITEMS_SQL}, t AS (SELECT *, CASE WHEN item LIKE 'Fair value%' THEN NULL WHEN regexp_matches(lower(item), 'ponding|flood') THEN 0 WHEN regexp_matches(lower(item), 'boundary|survey') THEN 1 WHEN regexp_matches(lower(item), 'catchment|school') THEN 2 END AS topic FROM items),
r AS (SELECT *, row_number() OVER (PARTITION BY subject, origin, topic ORDER BY pos, item) AS k FROM t),
m AS (SELECT a.subject, 0 AS part, a.pos, a.item AS tie, coalesce(b.item, a.item) AS item, CASE WHEN b.item IS NULL THEN 'tool' ELSE 'authored' END AS source, NULL AS note FROM r a LEFT JOIN r b ON b.origin = 'authored' AND a.subject = b.subject AND a.topic = b.topic AND a.k = b.k WHERE a.origin = 'tool'
  UNION ALL SELECT b.subject, 1, b.pos, b.item, b.item, CASE WHEN b.item LIKE 'Fair value%' THEN 'superseded' ELSE 'authored' END, CASE WHEN b.item LIKE 'Fair value%' THEN 'superseded by the record' END FROM r b LEFT JOIN r a ON a.origin = 'tool' AND a.subject = b.subject AND a.topic = b.topic AND a.k = b.k WHERE b.origin = 'authored' AND a.item IS NULL)
SELECT subject, CAST(row_number() OVER (PARTITION BY subject ORDER BY part, pos, tie) AS INTEGER) AS n, item, source, note FROM m"""

DIGEST_SQL = f"{LINES_SQL}, gains AS (SELECT concat(o, '-', rn) AS id, u AS street, d AS date, (price - 2500000) // 10 AS amount FROM lines)"
QUERIES["digest_rows"] = lambda spark, d: L.digest_rows(drawn(spark, d, "gains", DIGEST_SQL), "street")
ORACLES["digest_rows"] = f"""WITH {DIGEST_SQL.replace("(price - 2500000) // 10", "CAST(trunc((price - 2500000) / 10) AS BIGINT)")} SELECT street, CAST(row_number() OVER (PARTITION BY street ORDER BY date DESC, amount DESC, id) AS INTEGER) AS rank, date, CASE WHEN amount < 0 THEN '-' ELSE '' END || 'S$' || format('{{:,}}', abs(amount)) AS shown FROM gains QUALIFY rank <= 12"""
