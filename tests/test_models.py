"""Fitted models against plain solvers, and the blends' rules case by case."""

import inspect
import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from hearthmark.operators import asof as A
from hearthmark.operators import estimators as E
from hearthmark.operators import models as M
from hearthmark.plans import engines
from hearthmark.plans.caveats import caveats

SF = "/root/testdata/sf0.001"
ORIGIN = 1995 * 12


@pytest.fixture(scope="module")
def market(spark):
    comps = A.hygiene(caveats(spark, SF)).cache()
    return A.subjects(comps).filter("as_of = '1999-12-31'"), comps


def test_hedonic_equals_a_dense_ridge_regression(market):
    subjects, comps = market
    got = {r["s_id"]: r["psf"] for r in M.a1_hedonic(subjects, comps, ORIGIN, 0.0, 1e12).collect()}
    seen = comps.filter(A.visible("contract_month", F.lit("1999-12-31").cast("date"))).toPandas()
    levels = {c: sorted(seen[c].unique())[:-1] for c in M.DUMMIES}

    def row(r, month):
        lease = max(0, r["contract_month"].year - r["lease_start"]) if r["tenure_type"] == "leasehold" and r["lease_start"] == r["lease_start"] else 0
        return [1, math.log(r["area_sqft"]), (r["floor_lo"] + r["floor_hi"]) / 20, (month - ORIGIN) / 12, lease / 10] + [float(r[c] == v) for c in M.DUMMIES for v in levels[c]]

    x = np.array([row(r, r["month_idx"]) for r in seen.to_dict("records")])
    y = np.log(seen["psf"].to_numpy())
    beta = np.linalg.solve(x.T @ x + 1e-6 * len(x) * np.eye(x.shape[1]), x.T @ y)
    own = {r["id"]: r for r in comps.toPandas().to_dict("records")}
    assert len(got) > 10
    for s, psf in got.items():
        assert math.isclose(psf, math.exp(np.array(row(own[s], 1999 * 12 + 11)) @ beta), rel_tol=1e-7)


def test_hedonic_declines_thin_history(spark, market):
    subjects, comps = market
    assert M.a1_hedonic(subjects, comps.limit(50), ORIGIN).count() == 0


def test_trend_equals_dummy_regression(spark, market):
    _, comps = market
    dates = spark.createDataFrame([("1999-12-31",)], "d string").select(F.to_date("d").alias("as_of"))
    got = {r["month_idx"]: r["effect"] for r in M.local_trend(comps, dates, ["street", "property_type"]).collect()}
    at = 1999 * 12 + 11
    seen = comps.filter(A.visible("contract_month", F.lit("1999-12-31").cast("date")) & (at - F.col("month_idx") < 72)).toPandas()
    seen["g"] = seen["street"].astype(str) + seen["property_type"]
    seen = seen[seen.groupby("g")["g"].transform("size") >= 2]
    months, groups = sorted(seen["month_idx"].unique()), sorted(seen["g"].unique())
    if (seen["month_idx"] == months[-1]).sum() < 5:
        seen, months = seen[seen["month_idx"] < months[-1]], months[:-1]
    x = np.zeros((len(seen), len(months) + len(groups)))
    for i, (m, g) in enumerate(zip(seen["month_idx"], seen["g"], strict=True)):
        x[i, months.index(m)] = x[i, len(months) + groups.index(g)] = 1
    b = np.linalg.lstsq(x, np.log(seen["psf"].to_numpy()), rcond=None)[0][: len(months)]
    assert sorted(got) == months
    assert np.allclose([got[m] for m in months], b - b.mean(), atol=1e-8)


def test_trend_and_bridge_serve_every_valuation_month(spark, market):
    comps = market[1]
    want = {r["as_of"] for r in A.subjects(comps).select("as_of").distinct().collect()}
    assert len({d.month for d in want}) == 12
    assert {r["as_of"] for r in engines.QUERIES["two_way_fe"](spark, SF).select("as_of").distinct().collect()} == want
    got = engines.QUERIES["bridge_adjust"](spark, SF).groupBy("as_of").agg(F.sum("n").alias("n")).collect()
    seen = [r["contract_month"] for r in comps.select(F.last_day("contract_month").alias("contract_month")).collect()]
    assert {r["as_of"]: r["n"] for r in got} == {d: sum((d - m).days >= 56 for m in seen) for d in want}


def test_trend_sees_through_a_mix_shift(spark):
    rows = [(g, m, math.exp(math.log(p) + 0.01 * m)) for m in range(24) for g, p, n in (("dear", 3000.0, 24 - m), ("cheap", 1000.0, m + 1)) for _ in range(n)]
    df = spark.createDataFrame(rows, "street string, k int, psf double").withColumn("contract_month", F.add_months(F.lit("2020-01-01").cast("date"), F.col("k"))).withColumn("month_idx", 2020 * 12 + F.col("k"))
    dates = spark.createDataFrame([("2022-06-30",)], "d string").select(F.to_date("d").alias("as_of"))
    level = {r["month_idx"]: r["level"] for r in M.local_trend(df, dates, ["street"]).collect()}
    assert abs(level[2020 * 12 + 20] - level[2020 * 12 + 2] - 0.18) < 0.01


def test_neighbours_run_with_the_full_radius(spark):
    assert engines.NEAR == inspect.signature(M.a3_knn).parameters["near"].default == 2000.0
    s, c, i = engines.inputs(spark, SF)
    want = {r["s_id"]: tuple(r) for r in M.a3_knn(s, c, i).collect()}
    assert {r["s_id"]: tuple(r) for r in engines.QUERIES["a3_knn"](spark, SF).collect()} == want


def test_neighbours_equal_brute_force(spark):
    con = duckdb.connect()
    for t in "nation customer supplier part orders lineitem".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    want = {r[0]: r[2:] for r in con.execute(engines.A3).fetchall()}
    got = {r["s_id"]: tuple(r)[2:] for r in engines.QUERIES["a3_knn"](spark, SF).collect()}
    assert got.keys() == want.keys() and len(got) > 1000
    assert all(np.allclose(got[k], want[k], rtol=1e-9) for k in got)


ESTIMATE = "s_id string, method string, psf double, low double, high double, n_comps long"


def test_blends(spark):
    frame = lambda rows: spark.createDataFrame(rows, ESTIMATE)
    grid = frame([("a", "C1", 100.0, None, None, 1), ("b", "C1", 100.0, 90.0, 110.0, 4)])
    anchors = {"a1": frame([("a", "A1", 200.0, 150.0, 250.0, 0), ("c", "A1", 10.0, 5.0, 15.0, 0)]), "a2": frame([("a", "A2", 300.0, 1.0, 2.0, 0), ("d", "A2", 20.0, 18.0, 22.0, 0)]), "a3": frame([("c", "A3", 30.0, 25.0, 40.0, 6)])}
    got = {r["s_id"]: r for r in M.e3_blend(grid, anchors).collect()}
    assert math.isclose(got["a"]["psf"], 0.85 * 100 + 0.15 * 250) and (got["a"]["low"], got["a"]["high"]) == (1.0, 250.0)
    assert (got["b"]["psf"], got["b"]["low"], got["b"]["high"]) == (100.0, 90.0, 110.0)
    assert (got["c"]["psf"], got["c"]["low"], got["c"]["high"], got["c"]["n_comps"]) == (20.0, 5.0, 40.0, 0)
    assert (got["d"]["psf"], got["d"]["low"], got["d"]["high"]) == (20.0, None, None)


def test_engine_orders_its_anchors_by_tenure(spark):
    frame = lambda rows: spark.createDataFrame(rows, ESTIMATE)
    subjects = spark.createDataFrame([(i, 1000.0, 10.0, "RCR", "T", "1999-01-01", t) for i, t in (("a", "leasehold"), ("b", "freehold"), ("c", "freehold"))], "s_id string, s_price double, s_area_sqft double, s_market_segment string, s_property_type string, m string, s_tenure_type string").withColumn("s_contract_month", F.to_date("m"))
    grid = frame([("c", "C1", 100.0, None, None, 5)])
    anchors = {"a1": frame([(i, "A1", 200.0, 100.0, 300.0, 0) for i in "abc"]), "a2": frame([(i, "A2", 300.0, 2000.0, 4000.0, 9) for i in "abc"]), "a3": frame([])}
    got = {r["s_id"]: r for r in M.v2_engine(subjects, grid, anchors, ["a2", "a3", "a1"]).collect()}
    assert [(got[i]["source"], got[i]["psf"], got[i]["n_comps"]) for i in "abc"] == [("a1", 200.0, 0), ("a2", 300.0, 0), ("c1", 100.0, 5)]
    assert (got["a"]["low"], got["b"]["low"], got["b"]["high"], got["c"]["low"]) == (100.0, 2000.0, 4000.0, 1000.0)


def test_bridge_moves_by_the_capped_index_and_then_by_the_trend(spark):
    rows = spark.createDataFrame([("old", 2019 * 12 + 1, 8076, 100.0), ("mid", 2020 * 12 + 2, 8080, 100.0), ("new", 2020 * 12 + 4, 8081, 100.0)], "id string, month_idx int, q int, psf double").withColumn("as_of", F.to_date(F.lit("2020-06-30")))
    index = spark.createDataFrame([(8076, 100.0), (8080, 130.0)], "q int, value double")
    trend = spark.createDataFrame([(2020 * 12, 0.0), (2020 * 12 + 1, 0.1), (2020 * 12 + 3, 0.3)], "month_idx int, level double").withColumn("as_of", F.to_date(F.lit("2020-06-30")))
    got = {r["id"]: (r["moved"], r["value"]) for r in M.bridge(rows, trend, index).collect()}
    ahead = math.exp(0.2)  # from the published quarter's middle month, or the sale's own, to the trend's end; a month in a gap takes the one before
    assert np.allclose(got["old"], (ahead, 125.0 * ahead)) and np.allclose(got["mid"], (ahead, 100.0 * ahead)) and np.allclose(got["new"], (1.0, 100.0))


def test_e0_weighs_the_grid_by_its_comparables(spark):
    grid = spark.createDataFrame([("a", "C1", 100.0, 90.0, 110.0, 0), ("b", "C1", 100.0, 90.0, 110.0, 4), ("c", "C1", 100.0, None, None, 30), ("d", "C1", None, None, None, 2)], ESTIMATE)
    other = spark.createDataFrame([(i, "A1", 200.0, 150.0, 250.0, 0) for i in "abcde"], ESTIMATE)
    got = {r["s_id"]: (r["psf"], r["low"], r["high"], r["n_comps"]) for r in E.blend(grid, other, "E0").collect()}
    assert got == {"a": (150.0, 90.0, 250.0, 0), "b": (130.0, 90.0, 250.0, 4), "c": (100.0, 150.0, 250.0, 30), "d": (200.0, 150.0, 250.0, 2), "e": (200.0, 150.0, 250.0, 0)}


def _sales(spark, rows):
    """Subjects and comparables of (id, street, x, y, month, psf) in one project type."""
    cols = "id string, street long, x double, y double, contract_month string, psf double"
    df = spark.createDataFrame(rows, cols).withColumn("contract_month", F.to_date("contract_month"))
    df = df.withColumn("area_sqft", F.lit(10.0)).withColumn("price", F.col("psf") * 10).withColumn("month_idx", (F.year("contract_month") * 12 + F.month("contract_month") - 1).cast("int")).withColumn("q", (F.year("contract_month") * 4 + F.quarter("contract_month") - 1).cast("int"))
    for c in ("project", "property_type", "market_segment", "district", "tenure_type"):
        df = df.withColumn(c, F.lit("t"))
    for c in ("lease_start", "floor_lo", "floor_hi"):
        df = df.withColumn(c, F.lit(1))
    df = df.withColumn("type_of_sale", F.when(F.col("id").startswith("s"), "F").otherwise("O"))
    return A.subjects(df), df.filter("type_of_sale = 'O'"), df.select("q").distinct().withColumn("value", F.lit(100.0))


def test_nearest_in_widening_reach(spark, monkeypatch):
    """As all pairs within the radius would have it, for places, ties and reaches that differ; dense places look no further than they need."""
    import random

    rnd = random.Random(4)
    spots = [(rnd.randrange(0, 3000, 25), rnd.randrange(0, 3000, 25)) for _ in range(60)] + [(9000, 9000), (9000, 9000), (9000, 9990), (20000, 5)]
    rows = [(f"c{i}-{j}", i, float(x), float(y), f"1998-0{1 + (i + j) % 6}-01", 1000.0 + i * 7 + j) for i, (x, y) in enumerate(spots) for j in range(3)]
    rows += [(f"s{i}", i, float(x), float(y), "1998-12-01", 1.0) for i, (x, y) in enumerate(spots)]
    subjects, comps, index = _sales(spark, rows)
    at, gap = dict(enumerate(map(lambda p: (float(p[0]), float(p[1])), spots))), lambda a, b: math.hypot(a[0] - b[0], a[1] - b[1])
    sales = [r for r in rows if r[0][0] == "c"]
    want4, want_lb4 = {}, {}
    for i in at:
        others = [(gap(at[i], at[j]), j) for j in at if j != i and gap(at[i], at[j]) <= 1000]
        if others:
            want4[f"s{i}"] = sorted(r[5] for r in sales if r[1] == min(others)[1])[1]
        near = sorted(((gap(at[i], at[r[1]]), [-int(r[4][5:7])], [-ord(c) for c in r[0].ljust(9)], r[5]) for r in sales if gap(at[i], at[r[1]]) <= 1000))[:8]
        if len(near) >= 3:
            v = sorted(n[3] for n in near)
            want_lb4[f"s{i}"] = v[len(v) // 2] if len(v) % 2 else (v[len(v) // 2 - 1] + v[len(v) // 2]) / 2
    assert {r["s_id"]: r["psf"] for r in E.b4_nearest(subjects, comps).collect()} == pytest.approx(want4)
    met, pairs = [], A.pairs
    monkeypatch.setattr(A, "pairs", lambda *a: met.append(str(a[4])) or pairs(*a))
    got = {r["s_id"]: r["psf"] for r in E.lb4_knn(subjects, comps, index).collect()}
    assert got == pytest.approx(want_lb4)
    assert [any(f"{r}" in m for m in met) for r in (62.5, 250.0, 1000.0)] == [True] * 3  # all met within the full radius before


@pytest.mark.parametrize("name", ["variant_sweep", "lc2_curve", "lc1_craft", "c1_grid"])
def test_pairs_stay_where_they_met(spark, name):
    """No shuffle moves the pairs to their subjects by id: they lie together by the keys of the join."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as on tables that are too large to broadcast
    try:
        plan = (engines.QUERIES | engines.V.QUERIES)[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    dealt = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert any("s_street" in line or "s_project" in line for line in dealt)
    assert not any("s_id" in line for line in dealt)


@pytest.mark.parametrize("name", ["two_way_fe", "bridge_adjust"])
def test_sales_move_before_they_meet_dates(spark, name):
    """Neither a group's cells nor its moved sales are shuffled by date: they lie together by street and type."""
    plan = engines.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    dealt = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert any("hashpartitioning(street" in line for line in dealt)
    assert not any("as_of" in line and "street" in line for line in dealt)
