"""Rules of valuation records, listings, merged items and gates on small fixtures whose results are worked out by hand."""

import datetime as dt

import pytest

from hearthmark.operators import amenities as M
from hearthmark.operators import appraise as P
from hearthmark.operators import captures as T
from hearthmark.operators import gates as K
from hearthmark.operators import listings as L

SALE = "id string, project long, street long, property_type string, market_segment string, contract_month date, month_idx int, q int, area_sqft double, price double, psf double, tenure_type string, lease_start int"
ASK = "s_id string, s_project long, s_street long, s_property_type string, s_market_segment string, s_area_sqft double, s_tenure_type string, s_lease_start int, as_of date, asof_idx int"


def sale(i, psf, street=1, kind="Terrace", tenure="freehold", start=None, year=2019, month=6, area=2000.0, project=1):
    return (i, project, street, kind, "OCR", dt.date(year, month, 1), year * 12 + month - 1, year * 4 + (month - 1) // 3, area, psf * area, psf, tenure, start)


def ask(i, street=1, kind="Terrace", tenure=None, start=None, area=2000.0, project=1):
    return (i, project, street, kind, "OCR", area, tenure, start, dt.date(2020, 1, 31), 2020 * 12)


@pytest.fixture(scope="module")
def flat(spark):
    return spark.createDataFrame([(q, 100.0) for q in range(2015 * 4, 2020 * 4)], "q int, value double").cache()


def test_mixed_streets_and_unknown_leases_are_refused(spark, flat):
    comps = spark.createDataFrame(
        [sale(f"a{i}", 1000.0) for i in range(3)] + [sale("b", 700.0, tenure="leasehold", start=1990)]  # street 1: a quarter is leasehold
        + [sale(f"c{i}", 900.0, street=2, tenure="leasehold") for i in range(4)]  # leasehold, no start known
        + [sale(f"d{i}", 1000.0 + i, street=3) for i in range(19)] + [sale("e", 500.0, street=3, tenure="leasehold", start=1980)]  # a stray one in twenty
        + [sale("f", 800.0, street=4, tenure=None)], SALE)
    asks = P.street_asks(spark.createDataFrame([ask("mixed"), ask("told", tenure="freehold"), ask("nolease", 2), ask("given", 2, start=1990), ask("stray", 3), ask("unknown", 9), ask("bare", 4), ask("other", 3, "Detached")], ASK), comps)
    engine = spark.createDataFrame([("told", "LV1", 1000.0, 1.0, 3.0, 3), ("given", "LV1", 900.0, 1.0, 3.0, 4), ("stray", "LV1", 1200.0, 1.0, 3.0, 19), ("mixed", "LV1", 1.0, 1.0, 1.0, 1)], "s_id string, method string, psf double, low double, high double, n_comps int")
    got = {r.s_id: r for r in P.landed_records(asks, comps, flat, engine, {"lc2": engine}).collect()}
    assert {k: r.status for k, r in got.items()} == {"mixed": "tenure_required", "told": "valued", "nolease": "lease_start_required", "given": "valued", "stray": "valued", "unknown": "street_not_found", "bare": "no_estimate", "other": "no_estimate"}
    assert got["mixed"].psf is None and got["mixed"].confidence is None
    assert got["told"].withheld == "thin" and got["told"].attractive_below is None  # three prints
    stray = got["stray"]
    assert stray.withheld is None and stray.direction == "above" and stray.n_recent == 19 and stray.tenure_type == "freehold"
    assert stray.attractive_below == pytest.approx(1004.5 * 2000) and stray.walk_away_above == pytest.approx(1013.5 * 2000)
    assert got["given"].years_left == pytest.approx(1990 + 99 - 2020)


def test_hard_case_moves_half_way_to_the_fresh_sale(spark, flat):
    comps = spark.createDataFrame([sale("old", 1500.0, year=2018), sale("new", 1000.0), sale("big", 5000.0, area=4000.0), sale("late", 9000.0, year=2020, month=1)], SALE)
    read = lambda rows: spark.createDataFrame(rows, "s_id string, method string, psf double, low double, high double, n_comps int, source string")
    engine = read([("x", "V2", 1200.0, 1100.0 * 2000, 1300.0 * 2000, 2, "c1"), ("y", "V2", 1200.0, 1100.0 * 2000, 1300.0 * 2000, 2, "c1")])
    other = read([("x", "A2", 1500.0, 1.0, 2.0, 2, "a2"), ("y", "A2", 1210.0, 1.0, 2.0, 2, "a2")])
    got = {r.s_id: r for r in P.condo_records(spark.createDataFrame([ask("x"), ask("y"), ask("z"), ask("w", project=5)], ASK), comps, flat, engine, {"c1": engine, "a2": other}).collect()}
    x, y = got["x"], got["y"]
    assert x.pulled and x.hard and x.psf == pytest.approx(1100.0) and x.ref_psf == pytest.approx(1000.0) and x.gap == pytest.approx(0.2)
    assert x.low == pytest.approx(1000.0 * 2000) and x.high == pytest.approx(1300.0 * 2000 * 1100 / 1200)  # the band reaches down to the fresh sale
    assert not y.pulled and y.gap == pytest.approx(0.2) and y.psf == 1200.0 and y.checks == "thin,stale_comps"
    assert got["z"].status == "no_estimate" and got["w"].status == "project_not_found"


def test_cards(spark):
    names = "listing_id card_kind price area address title property_type tenure bedrooms completion_year price_psf".split()
    rows = [
        ("1", None, "S$ 3,200,000", "2,000 sqft (land)", "12A Loop Road", "t", "Corner Terrace", "999 years", "4", "Built: 1988", None),
        ("2", "listing", "S$ 3,200,000", "2,000 sqft", None, "t", "Loft", None, "4+1", None, "S$ 1,600 psf"), ("3", "listing", "$3,000 /mo", None, None, None, None, None, None, None, None),
        ("4", "ad", None, None, None, None, None, None, None, None, None), ("5", None, None, None, None, None, None, None, None, None, None),
    ]
    got = {r.id: r for r in L.card_normalize(spark.createDataFrame(rows, ", ".join(f"{n} string" for n in names))).collect()}
    assert (got["1"].street, got["1"].type, got["1"].tenure, got["1"].land_psf, got["1"].built_year, got["1"].warns) == ("Loop Road", "terrace", "999", 1600.0, 1988, "")
    assert (got["2"].street, got["2"].type, got["2"].land_sqft, got["2"].builtup_sqft, got["2"].floor_psf, got["2"].beds, got["2"].warns) == ("t", "loft", None, 2000.0, 1600.0, None, "area_unconfirmed,tenure_unknown")
    assert got["3"].reject == "rent" and got["4"].reject == "not_listing" and got["5"].reject is None and got["5"].warns == "no_area,tenure_unknown"


def test_import_keeps_what_people_set(spark):
    kept = spark.createDataFrame([("1", 10.0, "A", 500.0), ("2", 20.0, None, None), ("9", 90.0, "B", 1.0)], "id string, price double, tier string, land double")
    pulled = spark.createDataFrame([("1", 11.0, None), ("2", None, 7.0), ("3", 30.0, 8.0)], "id string, price double, land double")
    got = {r.id: tuple(r)[1:] for r in L.import_listings(kept, pulled, ["tier"], ["land"]).collect()}
    assert got == {"1": ("updated", 11.0, "A", 500.0), "2": ("updated", None, None, 7.0), "3": ("new", 30.0, None, 8.0), "9": ("missing", 90.0, "B", 1.0)}


def test_items_are_taken_over_once_and_in_order(spark):
    rows = [(1, "tool", 1, "Ponding a"), (1, "tool", 2, "Ponding b"), (1, "tool", 3, None), (1, "authored", 1, "Fair value of flood"), (1, "authored", 2, "flood SURVEY"), (1, "tool", 4, "Boundary"), (2, "authored", 1, "alone")]
    got = L.merge_items(spark.createDataFrame(rows, "subject long, origin string, pos int, item string"), [("flood", "ponding"), ("survey", "boundary")], {"Fair value": "old"})
    one = [(r.item, r.source) for r in got.filter("subject = 1").orderBy("n").collect()]
    assert one == [("flood SURVEY", "authored"), ("Ponding b", "tool"), ("", "tool"), ("Boundary", "tool"), ("Fair value of flood", "superseded")]
    assert got.filter("subject = 2").count() == 1


def test_panel_takes_the_last_known_value_and_skips_names_without_letters(spark):
    a = spark.createDataFrame([(" Rise ", 1, 5, "x"), ("rise", 2, None, "y"), (None, 3, 1, "z"), (" ", 4, 1, "z")], "project string, seq int, psf int, tag string")
    b = spark.createDataFrame([("RISE", 1, 7)], "project string, seq int, units int")
    assert [tuple(r) for r in L.panel_merge([a, b]).collect()] == [("Rise", 5, "y", 7, 2)]


def test_postal_codes(spark):
    rows = [("D9", None, None), (None, "RCR", "588177"), (None, None, "58817"), (None, "", "050001"), (None, None, "990001"), (None, None, "AB0001")]
    got = [(r.district_no, r.segment, r.note) for r in M.postal_map(spark.createDataFrame(rows, "district string, region string, postal string").coalesce(1)).collect()]
    assert got == [("D9", "CCR", None), ("21", "RCR", "by district OCR"), (None, None, None), ("1", "CCR", None), (None, None, None), (None, None, None)]


def test_plots_and_nearby_rows(spark):
    texts = ["skip", "23 FRANKEL AVENUE", "Terrace House", "01 Jan 2020", "02 Feb 2021", "PP: $1,200 ($3 psf)", "24A LOOP", "Freehold", "9 LOOP ROAD", "PP: $5 ($1 psf)", None]
    got = T.plot_records(spark.createDataFrame([(1, i, t) for i, t in enumerate(texts)], "doc long, pos int, token string")).orderBy("n").collect()
    assert [(r.n, r.address, r.type, r.date, r.price, r.psf) for r in got] == [(1, "23 FRANKEL AVENUE", "Terrace House", "01 Jan 2020", 1200, 3), (2, "9 LOOP ROAD", None, None, 5, 1)]
    row = ["Park", "99 yrs from 01/05/1993", "-", "1,000", "", "", "$1.2M - $3.4M /PSF: $1,000 - $2,000", "-", "-", "2% - 3% AVG: 2.5%", "7"]
    near = T.nearby_records(spark.createDataFrame([(1, i, t) for i, t in enumerate(["Radius: 500 Meters • 2 Projects", *row, "Nest", "Freehold", *row[2:], "📍", "1.5 km"])], "doc long, pos int, token string")).orderBy("n").collect()
    assert [(r.project, r.tenure_type, r.lease_start, r.psf_high, r.rent_low, r.yield_avg, r.dist_m, r.radius, r.advertised) for r in near] == [("Park", "99y", 1993, 2000, None, 2.5, 0.0, "500 Meters", 2), ("Nest", "FH", None, 2000, None, 2.5, 1500.0, "500 Meters", 2)]


def test_gates_find_a_stale_base(spark):
    names = "id long, name string, size_sqft double, estimate_psf double, estimate_price double, low_psf double, high_psf double, params_note string, asof string, summary string, cost_stack string, allowed_psf array<double>"
    rows = [(1, "n", 1000.0, 2000.0, 2e6, 1900.0, 2100.0, "1 笔", "x", "点估 S$2,000,000, 点估 ~S$2,050 psf", None, [2050.0]), (2, "n", 1000.0, 2000.0, 2e6, 1900.0, 2100.0, "0 笔", "x", "点估 S$2,100,000", "BSD（点估 S$2,000,000）≈ S$69,600", None), (3, None, None, None, None, None, None, None, None, None, None, None)]
    comps = spark.createDataFrame([(1, 100.0, 10.0, 10.0, "URA"), (4, 1.0, 1.0, 1.0, None)], "id long, price double, psf double, size_sqft double, note string")
    got = {(r.id, r.gate): r.ok for r in K.quality_gates(spark.createDataFrame(rows, names), comps).collect()}
    assert got[1, "one_estimate"] and not got[2, "one_estimate"] and got[2, "duty"] and (1, "duty") not in got
    assert got[1, "count_in_note"] and got[2, "count_in_note"] and not got[3, "count_in_note"] and not got[3, "fields"] and (3, "one_estimate") not in got
    assert all(got[1, g] for g in ("fields", "price_is_psf_by_size", "point_in_range", "encoding", "asterisks", "placeholders", "rows_arithmetic", "provenance"))
