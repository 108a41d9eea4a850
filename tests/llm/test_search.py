import numpy as np
import pytest
from pyspark.sql import functions as F

from labelmill.llm import cross_polytope as cp

SCHEMA = "vec_id long, embedding array<float>, score string"


def exact(rows, asked, nearest=5):
    """(query, rank, id, score) by brute force over distinct (id, vector) rows."""
    kept = {}
    for i, v in rows:
        if i is not None and v and all(c is not None and np.isfinite(c) for c in v) and any(v):
            kept[i, tuple(v)] = np.array(v, dtype=float)
    out = {}
    for (i, _), v in kept.items():
        if asked(i):
            scores = [(-float(v @ w / np.sqrt(v @ v) / np.sqrt(w @ w)), j) for (j, _), w in kept.items() if j != i]
            out[i] = sorted((round(s, 9), j) for s, j in scores)[:nearest]
    return out


def found(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((round(-r["score"], 9), r["vec_id"]))
    return out


def test_hadamard_is_orthogonal():
    h = cp.hadamard(np.eye(16))
    assert np.allclose(h @ h.T, 16 * np.eye(16)) and set(np.unique(h)) == {-1, 1}


def test_few_vectors_are_searched_exactly(spark):
    rng = np.random.default_rng(0)
    rows = [(i, rng.normal(size=8).astype(np.float32).tolist()) for i in range(60)]
    rows += [(100 + i, rows[0][1]) for i in range(30)]  # copies: ties go to smaller ids
    rows += [(200, None), (201, [0.0] * 8), (202, [float("nan")] * 8), (203, [None] * 8), (204, [float("inf")] * 8), (None, rows[1][1]), (205, [])]
    rows += [rows[3], (300, (np.array(rows[5][1]) * 2).tolist())]
    df = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)
    assert found(cp.search(df, F.col("vec_id") % 50 == 0)) == exact(rows, lambda i: i % 50 == 0)
    few = df.filter("vec_id in (0, 1, 50)")
    assert {q: len(v) for q, v in found(cp.search(few, F.col("vec_id") % 50 == 0)).items()} == {0: 2, 50: 2}
    assert cp.search(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_large_buckets_are_dealt_out_and_stay_whole(spark, monkeypatch):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=6).astype(np.float32).tolist()) for i in range(150)]
    monkeypatch.setattr(cp, "SPLIT", 7)
    df = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)
    assert found(cp.search(df, F.col("vec_id") % 3 == 0)) == exact(rows, lambda i: i % 3 == 0)


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_recall(spark, sf):
    df = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet")
    expected = exact([(r["vec_id"], r["embedding"]) for r in df.collect()], lambda i: i % 50 == 0)
    got = found(cp.search(df, F.col("vec_id") % 50 == 0))
    hits = sum(len({j for _, j in got[q]} & {j for _, j in expected[q]}) for q in expected)
    assert hits >= 0.95 * sum(map(len, expected.values()))


def test_recall_where_buckets_are_many(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(20_000, 32)).astype(np.float32)
    tables = cp.Tables(32, len(x))
    unit = cp._unit(x.astype(float))
    own, looked = tables.keys(unit.astype(np.float32), 1)[:, :, 0], tables.keys(unit[:50].astype(np.float32), cp.PROBES)
    hits = 0
    for q in range(50):
        seen = np.zeros(len(x), dtype=bool)
        for t in range(cp.TABLES):
            seen |= np.isin(own[:, t], looked[q, t])
        best = np.argsort(-(unit @ unit[q]))[1:6]
        hits += seen[best].sum()
    assert hits >= 0.9 * 250


def test_probes_grow_until_neighbours_are_found(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=32).astype(np.float32).tolist(), "x") for i in range(6000)]
    monkeypatch.setattr(cp, "MEAN_BUCKET", 4)
    df = spark.createDataFrame(rows, SCHEMA)
    asked = F.col("vec_id") % 100 == 0
    expected = exact([r[:2] for r in rows], lambda i: i % 100 == 0)
    recall = lambda got: sum(len({j for _, j in got[q]} & {j for _, j in expected[q]}) for q in expected) / 300
    fixed = recall(found(cp.search(df, asked, tables=3, probes=cp.PROBES)))
    grown = recall(found(cp.search(df, asked, tables=3)))
    assert fixed < 0.9 <= grown
