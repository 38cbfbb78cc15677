"""Whitening, embedding near-duplicates and hard negatives against brute force, with odd rows, ties and empty tables."""

import math
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from hearthmark.llm import negatives, pstable, queries, whitening

SF = "/root/testdata/sf0.001"
ROWS = "vec_id long, embedding array<float>, label int, id long, x double, v string, n int, node int"


@pytest.fixture(scope="session")
def given(spark):
    return [(r["vec_id"], r["embedding"], r["label"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]


def table(spark, rows):
    return spark.createDataFrame([(i, v, g, 7, 0.5, "clash", 1, 2) for i, v, g in rows], ROWS)


def odd_rows(given):
    """Null and broken vectors, copies, opposite and scaled vectors, another width, a null id, a repeated row."""
    v = given[0][1]
    nan, inf = float("nan"), float("inf")
    more = [(None, None, 1), (9001, None, 1), (9002, [nan, *v[1:]], 1), (9003, [inf, *v[1:]], 1), (9004, [None, *v[1:]], 1), (9005, [0.0] * 64, 1), (9006, v, None), (9007, v, 3), (9007, v, 3)]
    more += [(9008, [-a for a in v], 2), (9009, [2 * a for a in v], 2), (9010, v[:10], 2), (9011, [], 2), (None, v, 2), (9100, [a + 0.01 for a in v], 4)]
    return given[:60] + more


def fine(v):
    return v is not None and all(a is not None and math.isfinite(a) for a in v)


def brute_whitening(rows, k=4):
    rows = [(i, [math.floor(256 * a) for a in v]) for i, v, _ in rows if fine(v) and len(v) == 64]
    once = sorted({tuple(x) for _, x in rows})
    n, sums = len(once), [sum(c) for c in zip(*once)]
    y = np.array(once, float) - np.array(sums) / n
    e, u = np.linalg.eigh(y.T @ y / n)
    e, u = e[::-1], u[:, ::-1]
    out = []
    for i, x in rows:
        w = (np.array(x) - np.array(sums) / n) @ u[:, :k] / np.sqrt(e[:k])
        out += [(i, c + 1, n, sum((n * a - s) ** 2 for a, s in zip(x, sums)), w[c], e[c] / e.sum()) for c in range(k)]
    return out


def same_whitening(got, want):
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[3])
    got = sorted(((r["vec_id"], r["component"], r["n"], r["deviation"], r["whitened"], r["explained"]) for r in got), key=key)
    want = sorted(want, key=key)
    assert [r[:4] for r in got] == [r[:4] for r in want]
    signs = {}
    for a, b in zip(got, want):
        if abs(b[4]) > 1e-3:
            signs.setdefault(a[1], math.copysign(1, a[4] * b[4]))
        assert a[4] == pytest.approx(signs.get(a[1], 1) * b[4], abs=1e-8) and a[5] == pytest.approx(b[5], rel=1e-9)


def test_whitening_equals_a_dense_solution(spark, given):
    got = queries.QUERIES["op11_whitening"](spark, SF).collect()
    assert max(r["identity_error"] for r in got) < 1e-9 and len(got) == 4 * len(given)
    same_whitening(got, brute_whitening(given))


def test_whitening_odd_rows(spark, given):
    rows = odd_rows(given)
    same_whitening(whitening.whiten(table(spark, rows)).collect(), brute_whitening(rows))
    assert whitening.whiten(table(spark, [])).count() == 0
    assert whitening.whiten(table(spark, given[:1] * 3)).count() == 0  # no variance
    flat = [(i, [float(i), 0.0], 0) for i in range(5)]
    assert {r["component"] for r in whitening.whiten(table(spark, flat)).collect()} == {1}
    far = whitening.whiten(table(spark, [(i, [1e14 * i, 1.0 * i * i], 0) for i in range(4)])).collect()
    assert {r["deviation"] for r in far} == {None}


def test_inertia_and_certified_eigenpairs():
    rng = np.random.default_rng(0)
    for d in (1, 2, 5, 30):
        q, _ = np.linalg.qr(rng.standard_normal((d, d)))
        for e in (rng.standard_normal(d), np.repeat(2.0, d), np.r_[np.repeat(3.0, d // 2), np.arange(d - d // 2)], np.r_[1.0, 1.0 - 1e-13, np.zeros(d)][:d]):
            v = q @ np.diag(e) @ q.T
            v = (v + v.T) / 2
            for shift in (-1.234, 0.4321, 2.345):
                assert whitening.inertia(v - shift * np.eye(d)) == (int((e > shift).sum()), int((e < shift).sum()), 0)
            s = whitening.Spectrum(v)
            for k in range(1, min(4, d) + 1):
                value, y = s.find(k)
                assert value == pytest.approx(np.sort(e)[-k], abs=1e-12) and np.linalg.norm(v @ y - value * y) < 1e-11
            assert np.abs(s.vectors @ s.vectors.T - np.eye(len(s.vectors))).max() < 1e-12
    assert whitening.inertia(np.zeros((3, 3))) == (0, 0, 3)
    assert whitening.inertia(np.array([[0.0, 1.0], [1.0, 0.0]])) == (1, 1, 0)


def brute_links(rows, least=0.9):
    n, label = len(rows), list(range(len(rows)))
    links = [0] * n
    ok = [fine(v) and any(v) for _, v, _ in rows]
    x = [np.array(v, float) / np.linalg.norm(np.array(v, float)) if o else None for o, (_, v, _) in zip(ok, rows)]
    for i in range(n):
        for j in range(i):
            if ok[i] and ok[j] and len(x[i]) == len(x[j]) and x[i] @ x[j] >= least:
                links[i] += 1
                links[j] += 1
                a, b = label[i], label[j]
                label = [min(a, b) if c in (a, b) else c for c in label]
    out = []
    for i in range(n):
        ids = [rows[j][0] for j in range(n) if label[j] == label[i] and rows[j][0] is not None]
        comp = min(ids) if ids else None
        out.append((rows[i][0], links[i], comp, rows[i][0] == comp))
    return sorted(out, key=str)


def planted(seed=1, groups=(2, 3, 40), dims=64, spread=0.03):
    """Groups of near copies, each row of a group within about spread * sqrt(dims) of its first."""
    rng, rows = np.random.default_rng(seed), []
    for size in groups:
        base = rng.standard_normal(dims) / dims**0.5
        rows += [(len(rows) + j + 10_000, (base + spread * rng.standard_normal(dims) * (j > 0)).astype(np.float32).tolist(), 0) for j in range(size)]
    return rows


def test_near_duplicates_equal_brute_force(spark, given, monkeypatch):
    got = queries.QUERIES["op12_embedding_dups"](spark, SF).collect()
    assert len(got) == len(given) and sorted(map(tuple, got), key=str) == brute_links(given)
    rows = odd_rows(given) + planted()  # pairs of the planted groups lie on both sides of 0.9
    want = brute_links(rows)
    for mates, block in ((256, 2048), (4, 8)):  # few large buckets, then many small ones with split blocks
        sizes = pstable.sizes
        monkeypatch.setattr(pstable, "BLOCK", block)
        monkeypatch.setattr(pstable, "sizes", lambda n, least, miss, f=sizes, m=mates: f(n, least, m, miss))
        got = pstable.near_duplicates(table(spark, rows)).collect()
        assert sorted(map(tuple, got), key=str) == want
        monkeypatch.undo()
    assert pstable.near_duplicates(table(spark, [])).count() == 0
    assert [tuple(r) for r in pstable.near_duplicates(table(spark, [(5, None, 1)])).collect()] == [(5, 0, 5, True)]


def test_miss_chance_of_the_tables():
    rng = np.random.default_rng(4)
    for n in (1_000, 51_282):
        tables, k = pstable.sizes(n)
        x = pstable.units(rng.standard_normal((20_000, 64)))
        side = rng.standard_normal(x.shape)
        side = pstable.units(side - (side * x).sum(axis=1, keepdims=True) * x)
        y = 0.9 * x + math.sqrt(1 - 0.81) * side
        h = pstable.Hashes(64, tables, k)
        shared = (h.keys(x) == h.keys(y)).any(axis=1)
        assert (~shared).sum() <= 12  # two expected
        assert (h.keys(x[:50]) == h.keys(x)[:50]).all()  # whatever the batch


def brute_negatives(rows, relabel=True):
    use, seen = [], {}
    for i, v, g in rows:
        if i is not None and g is not None and fine(v) and len(v) == 64:
            x = [math.floor(256 * a) for a in v]
            own = ((g + 1) % 10 if relabel and i % 7 == 0 else g, x)
            seen[i] = min(seen.get(i, own), own)
    use = [(i, g, np.array(x)) for i, (g, x) in seen.items()]
    out = []
    for a, ga, xa in use:
        if a % 100:
            continue
        scored = sorted((-int(xa @ x), i, g) for i, g, x in use if i != a)
        for ps, p, _ in [s for s in scored if s[2] == ga][:5]:
            found = [(-s, i) for s, i, g in scored if g != ga and 30 * -ps <= 100 * -s <= 90 * -ps][:10]
            out += [(a, p, r + 1, i, -ps, s) for r, (s, i) in enumerate(found)]
    return sorted(out)


def test_hard_negatives_equal_brute_force(spark, given, monkeypatch):
    got = queries.QUERIES["op13_hard_negatives"](spark, SF).collect()
    want = brute_negatives(given)
    assert sorted(map(tuple, got)) == want and want
    rows = odd_rows(given) + [(i + 20_000, v, g) for i, v, g in given[:40]] + [(30_000 + i, given[3][1], i % 2) for i in range(30)]  # ties, many in a window
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    for a, r in ((512, 8192), (1, 7)):
        monkeypatch.setattr(negatives, "ANCHORS", a)
        monkeypatch.setattr(negatives, "ROWS", r)
        got = negatives.mine(table(spark, rows), F.col("vec_id") % 100 == 0, label=label).collect()
        assert sorted(map(tuple, got)) == brute_negatives(rows)
    assert negatives.mine(table(spark, []), F.col("vec_id") % 100 == 0).count() == 0
    assert negatives.mine(table(spark, given[:1]), F.col("vec_id") % 100 == 0).count() == 0


def test_products_beyond_floating_point_are_exact():
    a = np.array([[2**27 + 1, 3]])
    assert negatives.products(a, a).tolist() == [[(2**27 + 1) ** 2 + 9]]


def test_groups_across_batches():
    import pyarrow as pa

    from hearthmark.llm.common import groups

    parts = [pa.RecordBatch.from_pydict({"k": [1, 1, 2], "v": [1, 2, 3]}), pa.RecordBatch.from_pydict({"k": pa.array([], pa.int64()), "v": pa.array([], pa.int64())}), pa.RecordBatch.from_pydict({"k": [2, 2, 3], "v": [4, 5, 6]})]
    got = defaultdict(list)
    for (k,), t in groups(parts, ["k"]):
        assert k not in got
        got[k] = t.column("v").to_pylist()
    assert got == {1: [1, 2], 2: [3, 4, 5], 3: [6]}
