"""Queries against their SQL on the smallest tables, and units of the rules that must hold exactly."""

import math
import os
import time

import duckdb
import pytest
from pyspark.sql import functions as F

from hearthmark.functions import columns as C
from hearthmark.operators import asof as A
from hearthmark.operators import estimators as E
from hearthmark.operators import resolve as R
from hearthmark.plans import appraisals, catalog, engines
from hearthmark.plans.caveats import caveats
from hearthmark import store
from hearthmark.sources import ingest as S

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def same(a, b):
    if isinstance(a, float) or isinstance(b, float):
        return a is not None and b is not None and math.isclose(float(a), float(b), rel_tol=1e-8, abs_tol=1e-9)
    return str(a)[:10] == str(b)[:10] if hasattr(a, "year") or hasattr(b, "year") else a == b


SQL = catalog.ORACLES | {k: v for k, v in engines.SMALL.items() if k != "a3_knn"} | appraisals.SMALL  # a3_knn: test_models


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    cur = duck.execute(SQL[name])
    names = [c[0] for c in cur.description]
    assert sorted(df.columns) == sorted(names)
    order = sorted(names)
    rows = [[r[c] for c in order] for r in df.collect()]
    want = [[r[names.index(c)] for c in order] for r in cur.fetchall()]
    key = lambda r: [("", "") if v is None else ("f", f"{float(v):.6g}") if isinstance(v, float) else ("s", str(v)[:19]) for v in r]
    exact = lambda r: ([k for k, v in zip(key(r), r, strict=True) if not isinstance(v, float)], key(r))
    rows, want = sorted(rows, key=exact), sorted(want, key=exact)
    assert len(rows) == len(want)
    bad = [(a, b) for a, b in zip(rows, want, strict=True) if not all((x is None and y is None) or same(x, y) for x, y in zip(a, b, strict=True))]
    assert not bad, bad[:2]


def sale(i, project, month, psf, area=1000.0):
    y, m = map(int, month.split("-"))
    return (str(i), project, "S", "T", "RCR", "D", f"{month}-01", y * 12 + m - 1, y * 4 + (m - 1) // 3, "F", area, psf * area, psf, "freehold", None, 6, 10, 1, 0.0, 0.0)


def sales(spark, rows):
    names = "id string, project string, street string, property_type string, market_segment string, district string, m string, month_idx int, q int, type_of_sale string, area_sqft double, price double, psf double, tenure_type string, lease_start int, floor_lo int, floor_hi int, no_of_units int, x double, y double"
    return spark.createDataFrame(rows, names).withColumn("contract_month", F.to_date("m"))


def test_firewall_and_lag(spark):
    rows = sales(spark, [sale(1, "A", "2024-06", 2000.0), sale(2, "A", "2024-08", 2000.0), sale(3, "A", "2024-10", 2000.0)])
    seen = lambda t: [r["id"] for r in rows.filter(C.visible("contract_month", F.lit(t).cast("date"))).orderBy("id").collect()]
    assert seen("2024-09-30") == ["1"]
    assert seen("2024-10-01") == ["1"]
    assert seen("2024-11-01") == ["1", "2"]


def test_rising_project_takes_the_newest_visible_month(spark):
    rows = sales(spark, [sale(i, "A", f"2024-{i:02d}", 2000.0 + 20 * (i - 1)) for i in range(1, 7)] + [sale(9, "A", "2024-10", 3000.0)])
    subject = A.subjects(rows.filter("id = '9'"))
    assert E.b1_latest(subject, rows).first()["psf"] == 2100.0


def test_future_rows_never_change_an_estimate(spark):
    past = [sale(i, "A", f"2023-{i:02d}", 1000.0 + i) for i in range(1, 13)]
    subject = A.subjects(sales(spark, [sale(99, "A", "2024-03", 1500.0)]))
    get = lambda more: E.b2_last3(subject, sales(spark, past + more)).collect()
    assert get([]) == get([sale(50, "A", "2024-03", 9.0), sale(51, "A", "2025-01", 9.0)])


def test_weighted_quantile_rule(spark):
    rows = spark.createDataFrame([("k", 1.0, 1.0, "a"), ("k", 2.0, 1.0, "b"), ("k", 3.0, 2.0, "c")], "k string, v double, w double, id string")
    out = A.weighted_quantiles(rows, ["k"], "v", "w", "id", lo=0.25, mid=0.5, hi=0.75).first()
    assert (out["lo"], out["mid"], out["hi"], out["n_comps"]) == (1.0, 2.0, 3.0, 3)


def test_size_curve_is_continuous_and_inverts(spark):
    rows = spark.createDataFrame([(2999.999, 3000.001), (7999.99, 8000.01), (1500.0, 9000.0)], "a double, b double").select(C.size_factor("a", "b").alias("f"), (C.size_factor("a", "b") * C.size_factor("b", "a")).alias("one")).collect()
    assert abs(rows[0]["f"] - 1) < 1e-5 and abs(rows[1]["f"] - 1) < 1e-5
    assert all(abs(r["one"] - 1) < 1e-12 for r in rows)


def test_duties(spark):
    r = spark.range(1).select(C.bsd(F.lit(1_000_000.0)).alias("b"), C.absd_rate(F.lit("pr"), F.lit(9)).alias("a"), C.absd_rate(F.lit("X"), F.lit(1)).alias("x"), C.ssd_rate(F.lit(2.5)).alias("s"), C.ssd_rate(F.lit(4.5)).alias("z")).first()
    assert (round(r["b"], 6), r["a"], r["x"], r["s"], r["z"]) == (24_600.0, 0.35, None, 0.08, 0.0)


def test_lease_reads_the_text_from_its_start(spark):
    rows = spark.createDataFrame([("leasehold", "99 yrs lease commencing from 1999", 1999), ("leasehold", "999 yrs lease", 1885), ("freehold", "", None)], "t string, raw string, s int")
    assert [r[0] for r in rows.select(C.remaining_lease("t", "raw", "s", F.lit(2024))).collect()] == [74.0, 800.0, 800.0]


def test_normalize_rejects_what_cannot_be_read(spark):
    t = {"area": "92.9", "floorRange": "10-06", "noOfUnits": "1", "contractDate": "0624", "typeOfSale": "3", "price": "2,000,000", "propertyType": "Condominium", "district": "14", "typeOfArea": "Strata", "tenure": "99 yrs lease commencing from 2015"}
    raw = spark.createDataFrame([("ST", "A", "RCR", "1.5", None, [t, t | {"price": "n/a"}, t | {"contractDate": "1324"}])], S.RAW)
    good, bad = S.normalize(raw)
    row = good.first()
    assert (good.count(), bad.count(), row["floor_lo"], row["floor_hi"], str(row["contract_month"]), row["tenure_type"], row["lease_start"], row["type_of_sale"]) == (1, 2, 6, 10, "2024-06-01", "leasehold", 2015, "Resale")


def test_empty_results_never_replace_a_table(spark, tmp_path):
    with pytest.raises(ValueError):
        S.save(spark.range(0), str(tmp_path / "t"))


def test_upsert_statuses(spark):
    old = spark.createDataFrame([(1, 1.0, "a"), (2, 2.0, "b")], "k int, v double, j string")
    new = spark.createDataFrame([(2, 5.0, "z"), (3, 6.0, "c")], "k int, v double, j string")
    assert sorted(map(tuple, R.upsert(old, new, "k", ["v"], ["j"]).collect())) == [(1, 1.0, "a", "missing"), (2, 5.0, "b", "updated"), (3, 6.0, "c", "new")]


def test_transactions_are_unique(spark):
    rows = caveats(spark, SF)
    assert rows.select("id").distinct().count() == rows.count()


def test_universes_and_seeded_sample(spark):
    rows = spark.createDataFrame([("pure", "Terrace", "Land"), ("strata", "Strata Terrace", "Strata"), ("stray", "Apartment", "Land"), ("condo", "Condominium", "Strata"), ("ec", "Executive Condominium", "Strata"), ("none", None, None)], "id string, property_type string, type_of_area string")
    got = {n: {r["id"] for r in A.universe(rows, n).collect()} for n in ("condo", "landed", "pure_landed", "strata_landed")}
    assert got == {"condo": {"condo"}, "landed": {"pure", "strata", "stray"}, "pure_landed": {"pure"}, "strata_landed": {"strata"}}
    some = A.hash_sample(rows, 3).collect()
    assert len(some) == 3 and some == A.hash_sample(rows.repartition(4), 3).collect() and A.hash_sample(rows.limit(0), 3).count() == 0


def test_pools_meet_counted_values(spark):
    """A pool's months read one row a value, however many sales have it."""
    for name in ("b5_segment", "lb3_pool", "lb2_pool"):
        plan = catalog.QUERIES[name](spark, SF)._jdf.queryExecution().analyzed().toString()
        assert "0.75), n#" in plan.replace("cast(0.75 as double)", "0.75"), name


def test_ladder_widens_only_where_it_is_thin(spark, monkeypatch):
    """A scope reads sales counted by value, and only the pools that the narrower one left open."""
    rows = [sale(i, "P", "1999-01", 1000.0) for i in range(5)] + [sale(9, "P", "1999-06", 900.0), (*sale(10, "P", "1999-06", 950.0)[:5], "E", *sale(10, "P", "1999-06", 950.0)[6:])]
    comps, met, pairs = sales(spark, rows), [], A.pairs
    monkeypatch.setattr(A, "pairs", lambda s, c, *rest: (met.append((s.count(), c.count())), pairs(s, c, *rest))[1])
    index = spark.createDataFrame([(1999 * 4, 100.0)], "q int, value double")
    got = {r["s_id"]: r for r in E.la1_ladder(A.subjects(comps.filter("month_idx % 12 = 5")), comps, index).collect()}
    assert {i: (r["psf"], r["n_comps"]) for i, r in got.items()} == {"9": (1000.0, 5), "10": (1000.0, 5)}
    assert met == [(2, 3), (1, 3), (0, 3)]


def test_shuffles_of_written_steps_do_not_stay(spark):
    files = lambda: spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().size()
    spark._jvm.System.gc()
    time.sleep(2)  # until what earlier tests left is gone
    was, before = spark.conf.get(store.CLEANUP), files()
    rows = store.kept(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "step")
    made = store.view(spark, SF, "cleaned", ["nation"], lambda first: first.groupBy("k").count(), lambda: spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count())
    for _ in range(20):  # files are removed beside the job
        if files() > before:
            time.sleep(0.25)
    assert files() <= before and spark.conf.get(store.CLEANUP) == was
    assert rows.count() == 7 and made.count() == 7
    folder = os.path.join(store.shared_dir(spark), f"views-{spark.sparkContext.applicationId}")
    assert not [f for f in os.listdir(folder) if f.endswith("-first")]


def test_errors_hold_every_subject_with_null_where_a_method_declines(spark):
    subjects = spark.createDataFrame([("a", 100.0, 10.0), ("b", 200.0, 10.0), ("c", 0.0, 10.0)], "s_id string, s_price double, s_area_sqft double")
    for c in ("s_market_segment", "s_property_type", "s_contract_month"):
        subjects = subjects.withColumn(c, F.lit("x"))
    estimates = spark.createDataFrame([("a", "M", 11.0, None, None, 3), ("c", "M", 5.0, None, None, 3)], "s_id string, method string, psf double, low double, high double, n_comps long")
    got = E.errors(subjects, estimates, "M")
    assert sorted((r["method"], r["ape"] is None, round(r["ape"] or 0, 9)) for r in got.collect()) == [("M", False, 0.1), ("M", True, 0), ("M", True, 0)]
