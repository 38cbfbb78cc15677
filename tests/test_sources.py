"""Files that come in batches and snapshots, and results that go out."""

import gzip
import json

import pytest
from pyspark.sql import functions as F

from hearthmark.operators import estimators as E
from hearthmark.plans import valuation as V
from hearthmark.sources import ingest as S


def put(path, *streets):
    text = "\n".join(json.dumps({"street": s, "project": "P", "transaction": []}) for s in streets)
    path.write_bytes(gzip.compress(text.encode()) if path.suffix == ".gz" else text.encode())


def test_batches_that_are_there(spark, tmp_path):
    put(tmp_path / "batch_1.json", "A", "B")
    put(tmp_path / "batch_3.json", "C")
    paths = [str(tmp_path / f"batch_{i}.json") for i in range(1, 5)]
    assert sorted(r["street"] for r in S.read_batches(spark, *paths).collect()) == ["A", "B", "C"]
    assert S.read_batches(spark, paths[3]).count() == 0


def test_the_pull_comes_before_the_newest_snapshot(spark, tmp_path):
    pull, snapshots = str(tmp_path / "pull.json"), str(tmp_path / "snap_*.json.gz")
    with pytest.raises(FileNotFoundError):
        S.read_store(spark, pull, snapshots)
    put(tmp_path / "snap_2024-12.json.gz", "old")
    put(tmp_path / "snap_2025-02.json.gz", "new")
    assert [r["street"] for r in S.read_store(spark, pull, snapshots).collect()] == ["new"]
    put(tmp_path / "pull.json", "pull")
    assert [r["street"] for r in S.read_store(spark, pull, snapshots).collect()] == ["pull"]


def test_a_run_is_kept_whole(spark, tmp_path):
    rows = V.walked(spark, "/root/testdata/sf0.001")
    S.save_run(rows, E.summary(rows), str(tmp_path / "run"))
    back = spark.read.parquet(str(tmp_path / "run" / "rows"))
    assert sorted(back.columns) == sorted(S.KEPT) and back.count() == rows.count() and back.filter("pred IS NULL").count() > 0
    assert sorted(p.name for p in (tmp_path / "run" / "rows").glob("method=*")) == ["method=B1", "method=B2", "method=B3"]
    want = {r["method"]: r["n"] for r in E.summary(rows).collect()}
    assert {r["method"]: r["n"] for r in spark.read.json(str(tmp_path / "run" / "summary")).collect()} == want
    with pytest.raises(ValueError, match="empty"):
        S.save_run(rows.filter(F.lit(False)), E.summary(rows), str(tmp_path / "run"))
    assert spark.read.parquet(str(tmp_path / "run" / "rows")).count() == back.count()
