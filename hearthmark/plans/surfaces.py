"""Queries that rebuild one set of sales from three renderings of it, with their SQL.

The renderings are views over lineitem in SQL that Spark and DuckDB both read: the sale table leaves a quarter of the sales out and
often has no block, the profit table is up to 50 days late, and the tower view holds each unit's last sale, some under a
wrong price, a wrong price a square foot, or under several blocks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hearthmark.operators import surfaces as U
from hearthmark.plans.caveats import table
from hearthmark.store import size, view

QUERIES, ORACLES = {}, {}
ASOF, YEARS, SUBJECT = "2000-06-30", 5, (3, "01", "2")
RAW_SQL = """
base AS (
  SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(CAST(l_shipdate AS DATE) AS VARCHAR(10))) AS key, l_orderkey AS o, l_partkey AS project, CAST(l_suppkey % 4 + 1 AS INTEGER) AS blk,
    CAST(l_linenumber AS INTEGER) AS floor, CASE WHEN l_orderkey % 2 = 0 THEN '01' ELSE '02' END AS stack, CAST(l_shipdate AS DATE) AS day, CAST(l_quantity AS INTEGER) AS qty,
    CAST(round(l_extendedprice * 40) AS BIGINT) AS price, l_extendedprice / l_quantity AS unit_price, l_quantity * 40 AS area, l_discount AS discount, l_tax AS tax FROM lineitem
), last_of AS (
  SELECT *, row_number() OVER (PARTITION BY project, blk, floor, stack ORDER BY day DESC, key DESC) AS rn FROM base
), raw_tower AS (
  SELECT key, project, blk, floor, stack, day + qty AS day, qty, area, CASE WHEN tax = 0.03 THEN CAST(round(price * 0.9) AS BIGINT) ELSE price END AS price,
    round(unit_price * CASE WHEN tax = 0.03 THEN 0.9 WHEN tax = 0.05 THEN 1.05 ELSE 1.0 END) AS psf, CASE WHEN tax NOT IN (0.01, 0.02) THEN concat(CAST(1 + floor(area / 500) AS INTEGER), 'BR') END AS kind
  FROM last_of WHERE rn = 1
), raw AS (
  SELECT concat('sale:', key) AS id, 'sale' AS surface, project, CASE o % 5 WHEN 0 THEN '(single)' WHEN 1 THEN '?' WHEN 2 THEN ' ' ELSE CAST(blk AS VARCHAR(9)) END AS block, floor, stack, day, price, round(unit_price) AS psf, area,
    CASE WHEN tax = 0.08 THEN '5BR' WHEN discount >= 0.05 THEN concat(CAST(1 + floor(area / 500) AS INTEGER), 'Br') ELSE '-' END AS kind FROM base WHERE (o + floor) % 4 <> 0
  UNION ALL SELECT concat('profit:', key), 'profitability', project, CAST(blk AS VARCHAR(9)), floor, stack, day + qty, price, round(unit_price), area, NULL FROM base WHERE o % 3 <> 0
  UNION ALL SELECT concat('tower:', key), 'towerview', project, CAST(blk AS VARCHAR(9)), floor, stack, day, price, psf, area, kind FROM raw_tower
  UNION ALL SELECT concat('tower2:', key), 'towerview', project, CAST(blk % 4 + 1 AS VARCHAR(9)), floor, stack, day, price, psf, area, kind FROM raw_tower WHERE qty = 50
  UNION ALL SELECT concat('tower3:', key), 'towerview', project, CAST((blk + 1) % 4 + 1 AS VARCHAR(9)), floor, stack, day, price, psf, area, kind FROM raw_tower WHERE qty = 50
)"""


DEAL_BYTES = 8_000_000  # of lineitem's files a task, from which come some 60 times as much in rows


def raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The renderings by the rules of RAW_SQL: lineitem moves once, by project, and a sale's renderings are made where it lies."""
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), size(spark, f"{sf_dir}/lineitem.parquet") // DEAL_BYTES)
    lines = table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey AS o", "l_linenumber", "l_partkey AS project", "l_suppkey", "CAST(l_shipdate AS DATE) AS day", "l_quantity", "l_extendedprice", "l_discount AS discount", "l_tax AS tax"
    ).repartition(tasks, "project")
    base = lines.selectExpr(
        "concat_ws('-', o, l_linenumber, project, l_suppkey, CAST(day AS STRING)) AS key", "o", "project", "CAST(l_suppkey % 4 + 1 AS INTEGER) AS blk", "CAST(l_linenumber AS INTEGER) AS floor", "CASE WHEN o % 2 = 0 THEN '01' ELSE '02' END AS stack",
        "day", "CAST(l_quantity AS INTEGER) AS qty", "CAST(round(l_extendedprice * 40) AS BIGINT) AS price", "l_extendedprice / l_quantity AS unit_price", "l_quantity * 40 AS area", "discount", "tax",
    )
    base = base.withColumn("rn", F.row_number().over(Window.partitionBy("project", "blk", "floor", "stack").orderBy(F.desc("day"), F.desc("key"))))
    beds = "CAST(1 + floor(area / 500) AS INTEGER)"

    def told(mark: str, surface: str, block: str, day: str, price: str, psf: str, kind: str, when: str):
        return F.expr(f"CASE WHEN {when} THEN struct(concat('{mark}:', key) AS id, '{surface}' AS surface, {block} AS block, {day} AS day, {price} AS price, {psf} AS psf, {kind} AS kind) END")

    late, low = "day + qty", "CASE WHEN tax = 0.03 THEN CAST(round(price * 0.9) AS BIGINT) ELSE price END"
    off, typed = "round(unit_price * CASE WHEN tax = 0.03 THEN 0.9 WHEN tax = 0.05 THEN 1.05 ELSE 1.0 END)", f"CASE WHEN tax NOT IN (0.01, 0.02) THEN concat({beds}, 'BR') END"
    some = "CASE o % 5 WHEN 0 THEN '(single)' WHEN 1 THEN '?' WHEN 2 THEN ' ' ELSE CAST(blk AS STRING) END"
    all_ = F.array(
        told("sale", "sale", some, "day", "price", "round(unit_price)", f"CASE WHEN tax = 0.08 THEN '5BR' WHEN discount >= 0.05 THEN concat({beds}, 'Br') ELSE '-' END", "(o + floor) % 4 <> 0"),
        told("profit", "profitability", "CAST(blk AS STRING)", late, "price", "round(unit_price)", "CAST(NULL AS STRING)", "o % 3 <> 0"),
        told("tower", "towerview", "CAST(blk AS STRING)", late, low, off, typed, "rn = 1"),
        told("tower2", "towerview", "CAST(blk % 4 + 1 AS STRING)", late, low, off, typed, "rn = 1 AND qty = 50"),
        told("tower3", "towerview", "CAST((blk + 1) % 4 + 1 AS STRING)", late, low, off, typed, "rn = 1 AND qty = 50"),
    )
    return base.select("project", "floor", "stack", "area", F.explode(F.array_compact(all_)).alias("r")).select("r.id", "r.surface", "project", "r.block", "floor", "stack", "r.day", "r.price", "r.psf", "area", "r.kind")


def union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All surfaces in one schema, without what a stale screen repeats."""
    rows = raw(spark, sf_dir).withColumn("block", U.block_norm(F.col("block"))).withColumn("beds", U.bed_count(F.col("kind"))).drop("kind")
    return U.strip_stale(rows, of=F.col("surface") == "towerview")


def imputed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "imputed", ["lineitem"], lambda: _imputed(spark, sf_dir))


def _imputed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return U.imputed(union(spark, sf_dir).withColumn("typed", F.col("surface") == "towerview"), "typed")


def reconstructed(spark: SparkSession, sf_dir: str) -> DataFrame:
    floor, stack, block = SUBJECT
    return U.reconstruct(imputed(spark, sf_dir), ASOF, YEARS, (F.col("floor") == floor) & (F.col("stack") == stack) & U.blocks_match(F.col("block"), F.lit(block)))


UNION_SQL = f"""{RAW_SQL}, r AS (SELECT * EXCLUDE (block, kind), CASE WHEN trim(block) NOT IN ('', '(single)', '?') THEN trim(block) END AS block, CAST(nullif(regexp_extract(upper(kind), '^([0-9])BR$', 1), '') AS INTEGER) AS beds FROM raw),
fp AS (SELECT *, count(*) OVER w AS copies, len(list_distinct(list(coalesce(block, '')) OVER w)) AS blocks, min(id) OVER w AS first FROM r WHERE surface = 'towerview' WINDOW w AS (PARTITION BY project, floor, stack, area, day, price)),
tower AS (SELECT id, surface, project, CASE WHEN copies < 3 OR blocks < 3 THEN block END AS block, floor, stack, day, price, psf, area, beds FROM fp WHERE copies < 3 OR blocks < 3 OR id = first),
rows_ AS (SELECT id, surface, project, block, floor, stack, day, price, psf, area, beds FROM r WHERE surface <> 'towerview' UNION ALL SELECT * FROM tower)"""
IMPUTE_SQL = f"""{UNION_SQL}, typed AS (SELECT * FROM tower WHERE beds IS NOT NULL),
sizes AS (SELECT project, area, min(beds) AS sb FROM (SELECT project, area, beds FROM typed UNION ALL SELECT project, area, beds FROM rows_ WHERE beds IS NOT NULL) GROUP BY 1, 2 HAVING min(beds) = max(beds)),
v AS (SELECT *, CASE WHEN area >= {U.LEAST_SQFT_A_BED} * beds THEN beds END AS given FROM rows_),
unit AS (SELECT v.id, min(t.beds) AS ub FROM v JOIN typed t ON v.project = t.project AND v.floor = t.floor AND v.stack = t.stack AND (v.block IS NULL OR t.block IS NULL OR v.block = t.block) WHERE v.given IS NULL GROUP BY 1 HAVING min(t.beds) = max(t.beds)),
near AS (SELECT id, nb FROM (SELECT v.id, s.sb AS nb, greatest(s.area / v.area, v.area / s.area) AS ratio, row_number() OVER (PARTITION BY v.id ORDER BY greatest(s.area / v.area, v.area / s.area), s.area) AS rn FROM v JOIN sizes s USING (project) WHERE v.given IS NULL) WHERE rn = 1 AND ratio <= {U.NEAR_SIZE}),
imputed AS (SELECT v.id, v.surface, v.project, v.block, v.floor, v.stack, v.day, v.price, v.psf, v.area, coalesce(given, ub, sb, nb) AS beds,
  CASE WHEN given IS NOT NULL THEN 'given' WHEN ub IS NOT NULL THEN 'unit' WHEN sb IS NOT NULL THEN 'size' WHEN nb IS NOT NULL THEN 'near' ELSE 'unresolved' END AS beds_from
  FROM v LEFT JOIN unit USING (id) LEFT JOIN sizes s ON v.project = s.project AND v.area = s.area LEFT JOIN near USING (id))"""
_MATCH = "(k.block IS NULL OR e.block IS NULL OR k.block = e.block)"
_CLASH = f"list_filter(f.kept, lambda k: k.day = e.day AND k.price <> e.price AND {_MATCH})[1]"
_SAME = f"list_filter(f.kept, lambda k: k.price = e.price AND abs(datediff('day', k.day, e.day)) <= {U.SAME_SALE_DAYS} AND {_MATCH})[1]"
RECONSTRUCT_SQL = f"""{IMPUTE_SQL}, judged AS (SELECT *, CASE WHEN abs(price - psf * area) / price > {U.PRICE_TOLERANCE} THEN 'quarantined' WHEN floor = {SUBJECT[0]} AND stack = '{SUBJECT[1]}' AND (block IS NULL OR block = '{SUBJECT[2]}') THEN 'subject'
  WHEN day NOT BETWEEN DATE '{ASOF}' - {round(YEARS * 365.25)} AND DATE '{ASOF}' THEN 'outside' END AS status FROM imputed),
el AS (SELECT *, row_number() OVER (PARTITION BY project, floor, stack ORDER BY CASE surface WHEN 'sale' THEN 1 WHEN 'profitability' THEN 2 ELSE 3 END, day, id) AS n FROM judged WHERE status IS NULL),
fold AS (
  SELECT DISTINCT project, floor, stack, CAST(0 AS BIGINT) AS n, CAST([] AS STRUCT(id VARCHAR, block VARCHAR, day DATE, price BIGINT, beds INTEGER, seen INTEGER, clashes INTEGER)[]) AS kept, CAST(NULL AS VARCHAR) AS id, CAST(NULL AS VARCHAR) AS into_clash, CAST(NULL AS VARCHAR) AS into_same FROM el
  UNION ALL
  SELECT project, floor, stack, n, CASE WHEN c IS NOT NULL THEN list_transform(kept, lambda k: CASE WHEN k.id = c.id THEN struct_pack(id := k.id, block := k.block, day := k.day, price := k.price, beds := k.beds, seen := k.seen, clashes := k.clashes + 1) ELSE k END)
      WHEN s IS NOT NULL THEN list_transform(kept, lambda k: CASE WHEN k.id = s.id THEN struct_pack(id := k.id, block := coalesce(k.block, block), day := k.day, price := k.price, beds := coalesce(k.beds, beds), seen := k.seen + 1, clashes := k.clashes) ELSE k END)
      ELSE list_append(kept, struct_pack(id := id, block := block, day := day, price := price, beds := beds, seen := CAST(1 AS INTEGER), clashes := CAST(0 AS INTEGER))) END, id, c.id, CASE WHEN c IS NULL THEN s.id END
  FROM (SELECT e.project, e.floor, e.stack, e.n, f.kept, e.id, e.block, e.day, e.price, e.beds, {_CLASH} AS c, {_SAME} AS s FROM fold f JOIN el e ON f.project = e.project AND f.floor = e.floor AND f.stack = e.stack AND e.n = f.n + 1)
), ends AS (SELECT unnest(kept) AS k FROM (SELECT kept, n, max(n) OVER (PARTITION BY project, floor, stack) AS last FROM fold) WHERE n = last),
recon AS (
  SELECT k.id AS id, k.block AS block, k.beds AS beds, 'kept' AS status, CAST(NULL AS VARCHAR) AS "into", k.seen AS seen, k.clashes AS clashes FROM ends
  UNION ALL SELECT el.id, el.block, el.beds, CASE WHEN into_clash IS NOT NULL THEN 'conflict' ELSE 'merged' END, coalesce(into_clash, into_same), NULL, NULL FROM fold JOIN el USING (id) WHERE into_clash IS NOT NULL OR into_same IS NOT NULL
  UNION ALL SELECT id, block, beds, status, NULL, NULL, NULL FROM judged WHERE status IS NOT NULL
)"""


def query(name: str, run, sql: str) -> None:
    QUERIES[name], ORACLES[name] = run, sql


query("surface_union", union, f"WITH {UNION_SQL} SELECT * FROM rows_")
query("impute_ladder", imputed, f"WITH {IMPUTE_SQL} SELECT * FROM imputed")
query("reconstruct", reconstructed, f"WITH RECURSIVE {RECONSTRUCT_SQL} SELECT * FROM recon")
query("reconstruct_report", lambda s, d: reconstructed(s, d).groupBy(F.substring_index("id", ":", 1).alias("surface"), "status").agg(F.count("*").alias("n"), F.sum("seen").alias("rows"), F.count(F.when(F.col("beds").isNull(), 1)).alias("without_beds")),
      f"WITH RECURSIVE {RECONSTRUCT_SQL} SELECT split_part(id, ':', 1) AS surface, status, count(*) AS n, CAST(sum(seen) AS BIGINT) AS rows, count(*) FILTER (beds IS NULL) AS without_beds FROM recon GROUP BY 1, 2")
