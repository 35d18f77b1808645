import math
import os

import numpy as np
import pyarrow.parquet as pq
import pytest

from recordloom.llm import ann as A


def brute(rows, k=5):
    ok = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = {}
    for q, x in ok:
        if q % 50:
            continue
        near = sorted(((-float(x @ y / np.sqrt((x * x).sum()) / np.sqrt((y * y).sum())), i) for i, y in ok if i != q and len(x) == len(y)))
        out[q] = [(i, -s) for s, i in near[:k]]
    return out


def found(spark, rows):
    df = spark.createDataFrame([(i, v, 0.0, 1) for i, v in rows], "vec_id long, embedding array<float>, score double, vb int")
    got = {}
    for r in sorted(A.nearest(df, df.where("vec_id % 50 = 0")).collect(), key=lambda r: (r.query_id, r["rank"])):
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r["rank"] == len(got[r.query_id])
    return got


def test_recall_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(A, "VECTORS", 700)
    monkeypatch.setattr(A, "QUERIES", 7)
    r = np.random.default_rng(3)
    centers = r.standard_normal((10, 64))
    rows = [(i, (centers[i % 10] + r.standard_normal(64) * (0.4 + i % 7 / 5)).astype(np.float32).tolist()) for i in range(2500)]
    got, want = found(spark, rows), brute(rows)
    assert set(got) == set(want)
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits / sum(map(len, want.values())) >= 0.97
    for q in got:
        scores = dict(want[q])
        assert all(abs(s - scores[i]) < 1e-12 for i, s in got[q] if i in scores)


def test_ties_and_left_out_rows(spark):
    same = [1.0, 2.0, 3.0]
    rows = [(50 * i, same) for i in range(3)] + [(7, same), (3, [2.0, 4.0, 6.0]), (9, same), (11, same), (8, None), (12, []), (13, [0.0] * 3), (14, [1.0, None, 2.0]), (15, [float("nan"), 1.0, 1.0]), (16, [float("inf"), 1.0, 1.0]), (None, same), (200, [0.0] * 3), (250, [1.0, 1.0]), (17, [1.0, 0.5])]
    got = found(spark, rows)
    assert [i for i, _ in got[0]] == [3, 7, 9, 11, 50] and [i for i, _ in got[100]] == [0, 3, 7, 9, 11]
    assert [i for i, _ in got[250]] == [17] and 200 not in got


def test_empty(spark):
    assert found(spark, []) == {}


@pytest.mark.parametrize("at", ["sf0.01", "sf0.1", "check_h"])
def test_recall_and_share_of_verified_vectors(at):
    path = f"/root/testdata/{at}/embeddings.parquet"
    if not os.path.exists(path):
        pytest.skip("no such table here")
    table = pq.read_table(path, columns=["vec_id", "embedding"]).to_pydict()
    rows = [(i, v) for i, v in zip(table["vec_id"], table["embedding"]) if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows], np.float64)
    asked = np.flatnonzero(ids % 50 == 0)[:100]
    block = A.Block(ids, x)
    got = {}
    for q, v, _ in block.search(ids[asked], x[asked], 5):
        got.setdefault(q, set()).add(v)
    unit = x / np.sqrt((x * x).sum(1))[:, None]
    near = unit[asked] @ unit.T
    near[np.arange(len(asked)), asked] = -9
    hits = sum(len(got[ids[a]] & set(ids[np.argsort(-s, kind="stable")[:5]].tolist())) for a, s in zip(asked, near))
    assert hits / (5 * len(asked)) >= 0.9
    assert block.verified / len(asked) < 0.1 * len(ids)


def test_very_large_and_very_small_components(spark):
    rows = [(0, [1e200, 1e200]), (1, [1e200, 2e200]), (2, [1e-200, 1e-200]), (3, [1e200, -1e200]), (4, [5e-324, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [(r.vec_id, round(r.score, 12)) for r in sorted(A.nearest(df, df.where("vec_id = 0")).collect(), key=lambda r: r["rank"])]
    assert got == [(2, 1.0), (1, round(3 / math.sqrt(10), 12)), (4, round(math.sqrt(0.5), 12)), (3, 0.0)]
