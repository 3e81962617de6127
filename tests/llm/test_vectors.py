"""Nearest neighbours and whitening against brute force, with vectors that take no part, ties, copies and clashing names."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from marlstone.llm import queries, stable_projections, whitening
from marlstone.llm.common import stored

SCHEMA = "vec_id long, embedding array<float>"
ODD = [(900, None), (901, [1.0, None, 0.0, 1.0]), (902, [1.0, float("nan"), 0.0, 0.0]), (903, [float("inf"), 0.0, 0.0, 0.0]), (904, []), (905, [1.0, 2.0])]


def made(spark, rows, partitions=3):
    return spark.createDataFrame(rows, SCHEMA).repartition(partitions).selectExpr("*", "1 AS uid", "2 AS cell", "3 AS n", "4 AS component", "5 AS rank", "6 AS x")


def clustered(n, d=4, seed=0, lengths=False):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(5, d))[rng.integers(0, 5, n)] + 0.4 * rng.normal(size=(n, d))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    return (x * rng.lognormal(0, 1.5, (n, 1)) if lengths else x).astype(np.float32).tolist()


def brute(rows, k=20, every=20):
    """{(query_id, rank): (vec_id, score)} over distinct (id, vector)."""
    each = sorted({(i, tuple(v)) for i, v in rows if i is not None and v and len(v) == 4 and all(c is not None and math.isfinite(c) for c in v) and any(v)})
    x = np.array([v for _, v in each], np.float64).reshape(-1, 4)
    out = {}
    for at, (i, _) in enumerate(each):
        if i % every == 0:
            scores = (x * x[at]).sum(axis=1)
            order = [j for j in sorted(range(len(each)), key=lambda j: (-scores[j], each[j][0])) if j != at][:k]
            for rank, j in enumerate(order, 1):
                out.setdefault((i, rank), []).append((each[j][0], scores[j]))
    return out


def found(df):
    out = {}
    for r in df.collect():
        out.setdefault((r["query_id"], r["rank"]), []).append((r["vec_id"], r["score"]))
    return out


def agrees(got, want, share=1.0):
    """Scores are those of the pairs; `share` of the true neighbours at least are found."""
    assert got.keys() == want.keys()
    ids = lambda m: {(q, v) for (q, _), found in m.items() for v, _ in found}
    assert len(ids(got) & ids(want)) >= share * len(ids(want))
    if share == 1.0:
        assert all([v for v, _ in got[k]] == [v for v, _ in want[k]] and np.allclose([s for _, s in got[k]], [s for _, s in want[k]], rtol=1e-12) for k in want)


def nearest(spark, rows, k=20, every=20):
    return stable_projections.nearest(made(spark, rows), stored, F.col("vec_id") % every == 0, k)


def test_few_rows_are_all_found(spark):
    """No more vectors than a leaf holds: all are verified."""
    rows = [(i, v) for i, v in enumerate(clustered(40))]
    rows += [(100, rows[7][1]), (101, rows[7][1]), (101, rows[7][1]), (140, rows[20][1]), (20, rows[9][1]), (None, rows[3][1]), (-20, rows[4][1]), (120, [0.0] * 4), (160, [-0.0, 0.0, 0.0, 1.0]), (180, [0.0, 0.0, -0.0, 1.0]), *ODD]
    got = nearest(spark, rows)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    want = brute(rows)
    mine = found(got)
    assert {k for k, v in want.items() if len(v) > 1}  # two rows of one id ask
    assert mine.keys() == want.keys()
    assert all(sorted(v for v, _ in mine[k]) == sorted(v for v, _ in want[k]) for k in want)
    assert np.allclose(sorted(s for v in mine.values() for _, s in v), sorted(s for v in want.values() for _, s in v), rtol=1e-12)


def test_many_copies_of_one_vector(spark):
    """A third of all rows hold one vector: each answer shows the least ids."""
    rows = [(i, v) for i, v in enumerate(clustered(400))] + [(i, [0.5, 0.5, 0.5, 0.5]) for i in range(400, 600)]
    agrees(found(nearest(spark, rows, 5)), brute(rows, 5), 0.9)
    hot = {(q, r): v for (q, r), v in found(nearest(spark, rows, 5)).items() if q >= 400}
    assert all(v[0][0] == [i for i in range(400, 600) if i != q][r - 1] for (q, r), v in hot.items())


@pytest.mark.parametrize("lengths", [False, True])
def test_recall_over_cells_parts_and_copies(spark, monkeypatch, lengths):
    monkeypatch.setattr(stable_projections, "CELL", 100)
    monkeypatch.setattr(stable_projections, "CELLS", 5)
    monkeypatch.setattr(stable_projections, "LEAF", 8)
    monkeypatch.setattr(stable_projections, "ASKING", 30)
    monkeypatch.setattr(stable_projections, "SAMPLE", 500)
    monkeypatch.setattr(stable_projections, "AT_ONCE", 16)
    rows = [(i, v) for i, v in enumerate(clustered(3000, lengths=lengths))]
    agrees(found(nearest(spark, rows)), brute(rows), 0.95)


def test_all_is_found_where_the_test_never_holds(spark, monkeypatch):
    monkeypatch.setattr(stable_projections, "CELL", 64)
    monkeypatch.setattr(stable_projections, "LEAF", 8)
    monkeypatch.setattr(stable_projections, "SEEN", 1.0)
    rows = [(i, v) for i, v in enumerate(clustered(700, lengths=True))]
    agrees(found(nearest(spark, rows)), brute(rows))


def test_leaves_are_left_out(spark):
    """Near neighbours stop a query before most leaves are read."""
    d, n = 16, 4000
    rng = np.random.default_rng(1)
    x = np.repeat(rng.normal(size=(100, d)), n // 100, axis=0) + 0.01 * rng.normal(size=(n, d))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    squares = (x * x).sum(axis=1)
    normal = np.random.default_rng(0).normal(size=(d + 1, stable_projections.PROJECTIONS))
    index = stable_projections.Index(d, normal, stable_projections.chi_square_quantile(0.95, stable_projections.PROJECTIONS), {}, {}, {}, 0)
    tree = stable_projections.Tree(index, float(squares.max()), x, squares, [[k] for k in range(n)], [b""] * n)
    looked = []

    class Counted(np.ndarray):
        def __getitem__(self, at):
            out = np.asarray(self)[at]
            if isinstance(at, slice):
                looked.append(len(out))
            return out

    tree.x = tree.x.view(Counted)
    query, row, score = tree.nearest(x[:1], np.array([-np.inf]), 10)
    assert len(row) == 10 and sum(looked) < n / 2
    assert np.allclose(np.sort(score), np.sort(x @ x[0])[-10:])


def test_chi_square_quantile():
    assert stable_projections.chi_square_quantile(0.95, 2) == pytest.approx(-2 * math.log(0.05))
    assert stable_projections.chi_square_quantile(0.95, 8) == pytest.approx(15.507, abs=1e-3)
    share = ((np.random.default_rng(0).normal(size=(100_000, 8)) ** 2).sum(axis=1) <= stable_projections.chi_square_quantile(0.9, 8)).mean()
    assert abs(share - 0.9) < 0.01


def test_nearest_of_nothing(spark):
    for rows in ([], ODD[:1], ODD, [(0, [0.0] * 4)], [(20, [1.0, 0.0, 0.0, 0.0])]):
        assert nearest(spark, rows).collect() == []


def test_nearest_query_recall(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows], np.float64)
    got = {}
    for r in queries.op11_stable_projections(spark, sf).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    asked = ids[ids % 20 == 0].tolist()
    assert sorted(got) == sorted(asked)
    hits = 0
    for q in asked:
        own = sorted(got[q])
        assert [r for r, _, _ in own] == list(range(1, 21)) and q not in [v for _, v, _ in own]
        scores = x @ x[ids == q][0]
        assert np.allclose([s for _, _, s in own], [scores[ids == v][0] for _, v, _ in own], rtol=1e-12)
        assert [(-s, v) for _, v, s in own] == sorted((-s, v) for _, v, s in own)
        hits += len({v for _, v, _ in own} & {i for _, i in sorted((-s, i) for s, i in zip(scores, ids.tolist(), strict=True) if i != q)[:20]})
    assert hits >= 0.9 * 20 * len(asked)


def whitened_by_hand(rows, d=4, top=16):
    """vec_id, x, deviation of the rows that remain; n, eigenvalues and components of the fit list's covariance."""
    kept = [(i, v) for i, v in rows if v is not None and len(v) == d and all(c is not None and math.isfinite(c) for c in v)]
    x = [(i, [math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v]) for i, v in kept]
    fit = sorted({tuple(v) for _, v in x})
    n, total = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    centred = np.array([[n * a - s for a, s in zip(v, total, strict=True)] for v in fit], np.float64) / n
    e, v = np.linalg.eigh(centred.T @ centred / n)
    deviation = [sum((n * a - s) ** 2 for a, s in zip(v, total, strict=True)) for _, v in x]
    return [i for i, _ in x], np.array([[n * a - s for a, s in zip(r, total, strict=True)] for _, r in x], np.float64) / n, deviation, n, e[::-1], v[:, ::-1]


@pytest.mark.parametrize("folds", [64, 2])
def test_whitening(spark, monkeypatch, folds):
    monkeypatch.setattr(whitening, "FAN", folds)
    vectors = (np.array(clustered(300)) * [1, 0.5, 0.3, 0.2]).tolist()
    rows = [*enumerate(vectors), (7, vectors[7]), (None, vectors[8]), *((500 + k, vectors[0]) for k in range(150)), *ODD]
    df = made(spark, rows, 9)
    got = whitening.whitened(df, whitening.fitted(df, stored)).collect()
    ids, centred, deviation, n, e, v = whitened_by_hand(rows)
    assert len(got) == 4 * len(ids) and {r["n"] for r in got} == {n}
    assert {r["identity_error"] for r in got}.__len__() == 1 and got[0]["identity_error"] < 1e-9
    assert sorted({(r["component"], round(r["explained"], 9)) for r in got}) == [(k + 1, round(e[k] / e.sum(), 9)) for k in range(4)]
    assert sorted((str(r["vec_id"]), r["deviation"]) for r in got if r["component"] == 1) == sorted((str(i), x) for i, x in zip(ids, deviation, strict=True))
    want = centred @ v / np.sqrt(e)
    signs = {}
    for c in range(4):
        mine = {r["vec_id"]: r["whitened"] for r in got if r["component"] == c + 1 and r["vec_id"] is not None}
        theirs = {i: w for i, w in zip(ids, want[:, c], strict=True) if i is not None}
        signs[c] = math.copysign(1, mine[3] * theirs[3])
        assert all(mine[i] == pytest.approx(signs[c] * theirs[i], abs=1e-9) for i in theirs)


def test_jacobi_keeps_small_deviations():
    """Columns of very different lengths: each singular value is right to nearly all its digits."""
    rng = np.random.default_rng(0)
    q, _ = np.linalg.qr(rng.normal(size=(6, 6)))
    scales = 10.0 ** -np.arange(0, 24, 4)
    sigma, v = whitening.jacobi(np.triu(rng.normal(size=(6, 6)) * 0.01 + np.eye(6)) * scales)
    assert np.allclose(v.T @ v, np.eye(6), atol=1e-14)
    assert (sigma / scales > 0.5).all() and (sigma / scales < 2).all()
    a = rng.normal(size=(9, 7))
    r = whitening.triangle(a)
    sigma, v = whitening.jacobi(r)
    assert np.allclose(sigma, np.linalg.svd(a)[1], rtol=1e-13)
    assert np.allclose(v @ np.diag(sigma**2) @ v.T, a.T @ a, atol=1e-12)
    for d in (1, 2, 5, 8):
        pairs = [(min(a, b), max(a, b)) for p, q in whitening.rounds(d) for a, b in zip(p.tolist(), q.tolist(), strict=True)]
        assert sorted(pairs) == [(a, b) for a in range(d) for b in range(a + 1, d)]


def test_whitening_leaves_out_what_does_not_vary(spark):
    rows = [(k, [0.1 * k, 0.2 * k, 1.0, 0.1 * (k % 3)]) for k in range(30)]
    df = made(spark, rows)
    got = whitening.whitened(df, whitening.fitted(df, stored)).collect()
    *_, e, _ = whitened_by_hand(rows)
    assert max(r["component"] for r in got) == int((e > 1e-9 * e[0]).sum()) == 3


@pytest.mark.parametrize("rows", [[], ODD[:1], [(1, [0.5] * 4)], [(1, [0.5] * 4), (2, [0.5] * 4)], [(1, [])]])
def test_whitening_of_nothing_that_varies(spark, rows):
    df = made(spark, rows)
    out = whitening.whitened(df, whitening.fitted(df, stored))
    assert out.collect() == [] and out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_whitening_of_large_entries(spark):
    """Sums beyond 64 bits stay exact; a deviation that is no long is null."""
    rows = [(1, [1e17, 0.0, 0.0, 0.0]), (2, [-1e17, 1.0, 0.0, 0.0]), (3, [3e38, 0.0, 2.0, 0.0])]
    df = made(spark, rows)
    model = whitening.fitted(df, stored)
    x = [whitening.integers(np.array([v], np.float32).astype(np.float64))[0].tolist() for _, v in rows]
    assert model.total == [sum(c) for c in zip(*x, strict=True)] and max(model.total) > 1 << 62
    assert all(r["deviation"] is None and math.isfinite(r["whitened"]) for r in whitening.whitened(df, model).collect())
    assert whitening.deviations(np.array([[3, 4]])) == [25] and whitening.deviations(np.array([[1 << 31, 1 << 31]], object)) == [None]


def test_whitening_query(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    got = queries.op12_jacobi_whitening(spark, sf).toPandas()
    ids, centred, deviation, n, e, v = whitened_by_hand(rows, 64)
    assert len(got) == 16 * len(ids) and set(got["n"]) == {n} and got["identity_error"].max() < 1e-4
    wide = got.pivot(index="vec_id", columns="component", values="whitened").loc[ids].to_numpy()
    want = (centred @ v / np.sqrt(e))[:, :16]
    assert np.allclose(wide, want * np.sign((wide * want).sum(axis=0)), atol=1e-8)
    assert np.allclose(got.groupby("component")["explained"].first(), e[:16] / e.sum(), rtol=1e-9)
    assert got.drop_duplicates("vec_id").set_index("vec_id")["deviation"].loc[ids].tolist() == deviation
