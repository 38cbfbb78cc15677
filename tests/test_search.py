"""Searched weights, stamps and raw files."""

import datetime

import pytest
from pyspark.sql import functions as F

from hearthmark import store
from hearthmark.operators import search as L
from hearthmark.sources import ingest as S


def reads(spark):
    day = lambda y: datetime.date(y, 1, 1)
    # bucket x: a is right; y: b is right; stale rows of x: b is right
    rows = [(i, day(1999 if i % 2 else 2001), "x", False, 100.0, 200.0, 3, 101.0) for i in range(10)]
    rows += [(20 + i, day(1999 if i % 2 else 2001), "y", False, 100.0, 200.0, 12, 199.0) for i in range(10)]
    rows += [(40 + i, day(1999), "x", True, 100.0, 200.0, 3, 130.0) for i in range(4)]
    rows += [(60, day(2001), "new", False, 100.0, 200.0, 20, 150.0)]
    return spark.createDataFrame(rows, "s_id int, s_contract_month date, bucket string, stale boolean, a double, b double, n_comps int, actual double")


def test_weights_are_learned_before_the_cut_and_less_for_stale_evidence(spark):
    got = {(r["bucket"], r["stale"]): (r["weight"], r["delta"]) for r in L.fitted_weights(reads(spark), "2000-01-01").collect()}
    assert got == {("x", False): (1.0, 0.3), ("x", True): (0.7, 0.3), ("y", False): (0.0, 0.3), ("y", True): (0.5, 0.3)}
    out = {(r["bucket"], r["stale"], r["span"]): r for r in L.judged(reads(spark), "2000-01-01").collect()}
    assert out["x", False, "test"]["median_ape"] == pytest.approx(1 / 101) and out["new", False, "test"]["weight"] == L.UNKNOWN_WEIGHT
    assert out["y", False, "test"]["plain_ape"] == pytest.approx(99 / 199)
    assert L.fitted_weights(reads(spark).limit(0), "2000-01-01").count() == 0


def test_a_stale_table_is_not_applied(spark):
    fit = spark.createDataFrame([("a", 0.9, 10), ("b", 1.1, 20)], "cell string, hi double, n int")
    cols = ["cell", "hi", "n"]
    made = tuple(L.stamp(fit, cols, "rule\none").first())
    assert L.assert_current(fit.orderBy(F.desc("cell")), cols, "rule\r\none", made).count() == 2  # order and line ends do not matter
    for changed, rule in ((fit.withColumn("hi", F.col("hi") + 0.01), "rule\none"), (fit.limit(1), "rule\none"), (fit.unionByName(fit.limit(1)), "rule\none"), (fit, "rule two")):
        with pytest.raises(ValueError, match="changed since"):
            L.assert_current(changed, cols, rule, made)
    assert {(r["cell"], r["status"]) for r in L.drift(fit, fit.filter("cell = 'a'").unionByName(spark.createDataFrame([("c", 1.0, 1)], fit.schema)), ["cell"], ["hi", "n"]).collect()} == {("a", "same"), ("b", "removed"), ("c", "added")}


def test_bytes_are_decoded_down_a_ladder(spark, tmp_path):
    for name, raw in (("a", "Château".encode()), ("b", "Château".encode("cp1252")), ("c", b"Ch\x81\xe2teau"), ("d", b"")):  # Spark's reader has no row for an empty file
        (tmp_path / name).write_bytes(raw)
    got = {r["path"][-1]: (r["text"], r["coding"]) for r in S.read_bytes(spark, str(tmp_path)).collect()}
    assert got == {"a": ("Château", "utf-8"), "b": ("Château", "cp1252"), "c": ("Ch��teau", "replaced")}


def test_series_and_attribute_tables(spark):
    raw = '{"Data": {"title": "T", "row": [{"rowText": " Landed ", "columns": [{"key": "1975 1Q", "value": "8.9"}, {"key": "1975 2Q", "value": "na"}, {"key": "1975-3", "value": "9"}, {"key": "1976 1Q", "value": "x"}]}, {"columns": [{"key": "1980 4Q ", "value": "1"}]}]}}'
    good, bad = S.series_points(spark.createDataFrame([(raw,), ("{}",), ("not json",), (None,)], "json string"))
    assert sorted(map(tuple, good.collect())) == [("T", "?", "1980Q4", 1.0), ("T", "Landed", "1975Q1", 8.9)]
    assert sorted(r["key"] for r in bad.collect()) == ["1975-3", "1976 1Q"]
    assert [r["kind"] for r in S.index_kinds(good, {"landed": "L"}).collect()] == ["L"]
    table = spark.createDataFrame([("<th>A</th>\n<td> <b>1</b> </td><TH>B</TH><TD>2<br></TD><th>A</th><td>3</td>",), ("plain",), (None,)], "d string").select(S.table_map(F.col("d")).alias("m"))
    assert [r["m"] for r in table.collect()] == [{"B": "2", "A": "3"}, None, None]


def test_a_view_is_written_once_and_again_when_its_table_changes(spark, tmp_path):
    calls = []

    def build():
        calls.append(1)
        return spark.read.parquet(f"{tmp_path}/t.parquet").selectExpr("id * 2 AS x")

    spark.range(3).write.parquet(f"{tmp_path}/t.parquet")
    for _ in range(2):
        assert store.view(spark, str(tmp_path), "v", ["t"], build).count() == 3
    assert len(calls) == 1
    spark.range(5).write.mode("append").parquet(f"{tmp_path}/t.parquet")
    assert store.view(spark, str(tmp_path), "v", ["t"], build).count() == 8 and len(calls) == 2
