"""Rules of the rebuilt set of sales, screens, captures, parcels and names that must hold exactly."""

import datetime

import pytest
from pyspark.sql import functions as F

from hearthmark.operators import captures as E
from hearthmark.operators import names as M
from hearthmark.operators import parcels as Z
from hearthmark.operators import screens as P
from hearthmark.operators import surfaces as U
from hearthmark.operators import tokens as T

ROW = "id string, surface string, project long, block string, floor int, stack string, day date, price long, psf double, area double, beds int"
DAY = datetime.date(2020, 1, 1)


def row(i, surface="sale", block="1", day=0, price=1_000_000, area=1000.0, beds=None, floor=5, stack="01", psf=None, project=1):
    return (i, surface, project, block, floor, stack, DAY + datetime.timedelta(days=day), price, psf if psf is not None else price / area, area, beds)


def rebuilt(spark, rows, subject=None):
    return {r["id"]: r for r in U.reconstruct(spark.createDataFrame(rows, ROW), "2021-01-01", 5, F.lit(False) if subject is None else subject).collect()}


def test_near_days_merge_but_chains_do_not_run_on(spark):
    got = rebuilt(spark, [row("a"), row("b", "profitability", day=20), row("c", "towerview", day=40), row("d", "towerview", day=41, block=None)])
    assert [got[i]["status"] for i in "abcd"] == ["kept", "merged", "kept", "merged"]  # c is 40 days from what is kept
    assert got["b"]["into"] == "a" and got["d"]["into"] == "c" and got["a"]["seen"] == 2


def test_unknown_blocks_match_any_and_are_filled(spark):
    got = rebuilt(spark, [row("a", block=None), row("b", "profitability", block="2", day=3, beds=3), row("c", "towerview", block="7", day=5)])
    assert (got["a"]["block"], got["a"]["beds"], got["b"]["into"]) == ("2", 3, "a")
    assert got["c"]["status"] == "kept"  # the kept sale is of block 2 by now


def test_trusted_surface_wins_a_day(spark):
    got = rebuilt(spark, [row("t", "towerview", price=900_000), row("s", price=1_000_000), row("q", psf=1500.0), row("o", day=-4000), row("x", floor=9)], (F.col("floor") == 9) & U.blocks_match(F.col("block"), F.lit("1")))
    assert (got["s"]["status"], got["s"]["clashes"], got["t"]["status"], got["t"]["into"]) == ("kept", 1, "conflict", "s")
    assert (got["q"]["status"], got["o"]["status"], got["x"]["status"]) == ("quarantined", "outside", "subject")


def test_stale_copies_keep_one_without_a_block(spark):
    rows = [row(f"t{b}", "towerview", block=str(b)) for b in (1, 2, 3)] + [row(f"u{b}", "towerview", block=str(b), floor=6) for b in (1, 2)]
    got = sorted((r["id"], r["block"]) for r in U.strip_stale(spark.createDataFrame(rows, ROW)).collect())
    assert got == [("t1", None), ("u1", "1"), ("u2", "2")]


def test_bedroom_ladder(spark):
    typed = [row("t1", "towerview", area=1000.0, beds=3, floor=7), row("t2", "towerview", area=500.0, beds=2, floor=8), row("t3", "towerview", area=700.0, beds=2, floor=9), row("t4", "towerview", area=700.0, beds=3, floor=10)]
    rows = [row("given", area=1000.0, beds=3), row("void", area=431.0, beds=3, floor=8), row("unit", area=999.0, floor=7, block=None), row("size", area=500.0), row("near", area=560.0), row("torn", area=700.0), row("far", area=5000.0)]
    got = {r["id"]: (r["beds"], r["beds_from"]) for r in U.impute_beds(spark.createDataFrame(rows, ROW), spark.createDataFrame(typed, ROW)).collect()}
    assert got == {"given": (3, "given"), "void": (2, "unit"), "unit": (3, "unit"), "size": (2, "size"), "near": (2, "near"), "torn": (None, "unresolved"), "far": (None, "unresolved")}


def test_nearest_matches_are_one_to_one(spark):
    made = lambda rows: spark.createDataFrame(rows, "id string, k string, area double")
    left = made([("a", "x", 100.0), ("b", "x", 200.0), ("c", "y", 5.0), ("n", "x", None), ("e", "z", 150.0), ("f", "z", 200.0)])
    right = made([("p", "x", 50.0), ("q", "x", 100.0), ("r", "x", 200.0), ("s", "y", 9.0), ("g", "z", 190.0), ("h", None, 1.0)])
    got = {(r["left_id"], r["right_id"], r["status"]) for r in U.nearest_matches(left, right, ["k"], "area", 1.5).collect()}
    # e comes first and takes the only row of z, though f is nearer
    assert got == {("a", "q", "matched"), ("b", "r", "matched"), (None, "p", "right_only"), ("c", "s", "differs"), ("n", None, "left_only"), ("e", "g", "differs"), ("f", None, "left_only"), (None, "h", "right_only")}
    assert U.nearest_matches(left.limit(0), right.limit(0), ["k"], "area", 1.5).count() == 0


@pytest.mark.parametrize("text,want", [("150 Loyang Rise", "address"), ("Semi-Detached House", "type"), ("99 yrs from 01/05/1993", "tenure"), ("Freehold", "tenure"), ("1996", "completion"), ("1,615", "area_sqft"), ("$1,301", "psf"), ("$2,100,000", "price"), ("New Sale", "sale_type"), ("", None), ("View All (104)", None)])
def test_formats_name_columns(spark, text, want):
    assert spark.range(1).select(P.by_format(F.lit(text)).alias("c")).first()["c"] == want


def test_rows_do_not_depend_on_the_sideways_offset(spark):
    cells = lambda off: [("19 Jun 2026", 113, 516), ("99 yrs from 01/05/1993", 93, 516), ("2,153", 463 - off, 516), ("$1,231", 658 - off, 540), ("$2,650,000", 876 - off, 490), ("Resale", 1064 - off, 547)]
    for off in (0, 167):
        nodes = spark.createDataFrame([(1, i, x, y, t) for i, (t, x, y) in enumerate(cells(off))], "screen long, ord int, x int, y int, text string")
        got = P.rebuilt(nodes, ["screen"], P.by_format(F.col("text")), ["tenure", "area_sqft", "psf", "price", "sale_type"]).first()
        assert (got["y"], got["tenure"], got["area_sqft"], got["psf"], got["price"], got["sale_type"]) == (516, None, "2,153", "$1,231", "$2,650,000", None)


def test_xml_nodes_have_centres(spark):
    xml = '<hierarchy><node text="A &amp; &quot;B&quot;" bounds="[0,10][101,20]" /><node text="no box"/><node bounds="[4,4][6,8]" text=""/></hierarchy>'
    got = P.xml_nodes(spark.createDataFrame([(1, xml), (2, ""), (3, None)], "screen int, xml string")).orderBy("ord").collect()
    assert [(r["ord"], r["x"], r["y"], r["text"]) for r in got] == [(0, 50, 15, 'A & "B"'), (1, None, None, "no box"), (2, 5, 6, "")]


def stream(spark, texts):
    return spark.createDataFrame([(1, i, t) for i, t in enumerate(texts)], "doc long, pos int, token string")


ONE = ["16", "17", "01", "581", "Apr 2021", "$2,130", "$1,238,000", "15 Oct 2024", "$2,581", "$1,500,000", "▲$451", "▲$262,000", "3y 5m 18d", "5.69%"]


def test_profit_records(spark):
    loss = ["16", "08", "05", "743", "Jan 2013", "$2,258", "$1,678,000", "10 Mar 2023", "$2,100", "$1,560,000", "▼$158", "▼$118,000", "10y 2m 0d", "-0.72%"]
    rows = E.profit_records(stream(spark, ["...", "5Y", "Profitable", *ONE, "26 May 2023", *loss, "View All (26)", "Unit Type", "2BR", "3Br"])).orderBy("n").collect()
    assert [(r["profit"], r["section"], r["frozen"], r["window"], r["view_all"]) for r in rows] == [(262_000, "profitable", "2BR", "5Y", 26), (-118_000, "unprofitable", "3Br", "5Y", 26)]
    rows = E.profit_records(stream(spark, [*ONE, *ONE, "2BR"])).collect()
    assert [(r["pairing"], r["frozen"]) for r in rows] == [("skipped", None)] * 2
    assert E.profit_records(stream(spark, ONE[:13])).count() == 0 and E.profit_records(stream(spark, ["7", *ONE])).count() == 1


def test_rent_records_end_at_the_agency_panel(spark):
    one = ["Loop 5", "2BR", "500 - 600", "$7.82", "$4,300"]
    rows = E.rent_records(stream(spark, ["$3,000", "$4,000", "$5,000", "$3 PSF", "$4 PSF", "$5 PSF", "LOWEST", "AVERAGE", *one, "Lane", "-", "560", "$6", "$3,900", "Jun 2024", "12 Jul 2024", "Realtime Agency Data", *one])).orderBy("n").collect()
    assert [(r["street"], r["beds"], r["panel"], r["monthly_rent"], r["frozen"], r["band"]) for r in rows] == [("Loop 5", "2BR", "past", 4300, "Jun 2024", "$3,000 $4,000 $5,000"), ("Lane", None, "live", 3900, "12 Jul 2024", "$3,000 $4,000 $5,000")]


def test_overlapping_matches_go_from_left_to_right(spark):
    got = T.records(T.tokens(spark.createDataFrame([(1, "1 2 3 4 5 6 7 x 8 9")], "doc long, text string"), "doc", "text"), ["int"] * 3).orderBy("pos").collect()
    assert [r["record"] for r in got] == ["1 2 3", "4 5 6"]


def test_parcels(spark):
    ring = lambda *p: [(float(x), float(y)) for x, y in p]
    square, inner = ring((0, 0), (1000, 0), (1000, 1000), (0, 1000), (0, 0)), ring((400, 400), (600, 400), (600, 600), (400, 600), (400, 400))
    parcels = spark.createDataFrame([(1, "RESIDENTIAL", "LND", square), (2, "PARK", "", inner)], "parcel int, zone string, gpr string, ring array<struct<x:double,y:double>>")
    points = spark.createDataFrame([(1, 100.0, 100.0), (2, 500.0, 500.0), (3, -50.0, 500.0), (4, 5000.0, 5000.0)], "site int, x double, y double")
    zones = {r["site"]: (r["parcel"], r["area"]) for r in Z.zone_at(points, parcels, ["site"]).collect()}
    assert zones == {1: (1, 1e6), 2: (1, 1e6), 3: (None, None), 4: (None, None)}
    near = {(r["site"], r["zone"]): (round(r["metres"]), round(r["bearing"])) for r in Z.nearest_edges(points, parcels, ["site"], 300.0).collect()}
    assert near == {(1, "RESIDENTIAL"): (100, 180), (2, "PARK"): (100, 180), (3, "RESIDENTIAL"): (50, 90)}
    line = [r["zone"] for r in Z.transect(points.filter("site = 3"), parcels, ["site"], 90.0, 100, 50).orderBy("m").collect()]
    assert line[0] is None and line[2] == "RESIDENTIAL"
    assert {r["is_plot"] for r in Z.plot_area(Z.zone_at(points, parcels, ["site"])).collect()} == {True}


def test_roads_are_asserted_by_equality(spark):
    gaz = spark.createDataFrame([("OLD YIO CHU KANG ROAD", "1", 1.0, 2.0), ("King's Road", "5a", 3.0, 4.0)], "road string, blk string, x double, y double")
    asks = spark.createDataFrame([(1, None, "yio chu kang road", "yio chu kang road"), (2, None, "old yio chu kang road", "Old Yio ChuKang Road"), (3, "5A", "KINGS  ROAD", None), (4, "1", "nowhere", None), (5, "1", None, None)], "id int, blk string, ask string, expect string")
    got = {r["id"]: (r["status"], r["blk"], r["x"]) for r in M.gazetteer_join(asks, gaz).collect()}
    assert got == {1: ("substituted", None, None), 2: ("road", None, 1.0), 3: ("house", "5A", 3.0), 4: ("no_match", None, None), 5: ("no_match", None, None)}


def test_listed_names_are_whole_words(spark):
    texts = spark.createDataFrame([(1, "Floods at Loyang Rise, again."), (2, "sunrise is not it"), (3, None), (4, "loyang  RISE")], "doc int, text string")
    listed = spark.createDataFrame([(1, "Loyang Rise"), (2, "rise is"), (3, ""), (4, None), (5, "a b c d e f g")], "listed_id int, name string")
    got = {r["listed_id"]: (r["docs"], r["first_doc"], r["evidence"]) for r in M.name_match(texts, listed).collect()}
    assert got == {1: (2, 1, "material"), 2: (0, None, "near_zero"), 3: (0, None, "refused"), 4: (0, None, "refused"), 5: (0, None, "refused")}
    assert {r["evidence"] for r in M.name_match(texts.limit(0), listed).collect()} == {"near_zero", "refused"}


def test_screens_and_captures_move_the_raw_lines_once(spark):
    """Cells, tokens and records are made where an order's lines lie; the plans of one query held up to fifty shuffles of them."""
    from hearthmark.plans import catalog

    most = {"ui_nodes": 1, "geo_table": 1, "panel_guard": 1, "half_tables": 4, "cell_formats": 3, "profit_records": 1, "rent_records": 1, "nearby_records": 1, "plot_records": 1, "deal_records": 1}
    for name, n in most.items():
        plan = catalog.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange ") <= n, name
        assert "views-" not in plan, name


def test_renderings_move_the_raw_lines_once(spark):
    """Renderings, stale copies and bedrooms are made where a project's lines lie."""
    from hearthmark.plans import surfaces

    plan = surfaces._imputed(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1 and "views-" not in plan


def test_stale_copies_are_looked_for_among_the_named_rows(spark):
    rows = [row(f"{s}{b}", s, block=str(b)) for s in ("sale", "towerview") for b in (1, 2, 3)]
    got = sorted((r["id"], r["block"]) for r in U.strip_stale(spark.createDataFrame(rows, ROW), of=F.col("surface") == "towerview").collect())
    assert got == [("sale1", "1"), ("sale2", "2"), ("sale3", "3"), ("towerview1", None)]
