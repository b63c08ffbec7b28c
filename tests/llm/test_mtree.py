import math
from fractions import Fraction
from math import floor, isfinite

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from attesta.llm import mtree


def brute(rows, k=5):
    v = {i: [math.floor(256 * c) for c in x] for i, x in rows if i is not None and x is not None and all(c is not None and math.isfinite(c) for c in x)}
    out = []
    for q in sorted(v):
        if q % 50:
            continue
        scores = sorted((-(sum(a * b for a, b in zip(v[q], v[c], strict=False))), c) for c in v if c != q)
        out += [(q, n + 1, c, -s) for n, (s, c) in enumerate(scores[:k])]
    return out


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_query_matches_sql(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{sf_dir}/embeddings.parquet'")
    assert rows(mtree.op7_mtree_topk(spark, sf_dir)) == sorted(con.sql(mtree.OP7_SQL).fetchall())


@pytest.mark.parametrize("shard_rows", [40, 5000])
def test_many_shards_and_ties(spark, shard_rows):
    rng = np.random.default_rng(3)
    data = [(i, rng.normal(0, 0.2, 8).round(2).tolist()) for i in range(300)]
    data += [(i, [0.5] * 8) for i in range(300, 500)] + [(i, [0.0] * 8) for i in range(500, 520)]
    frame = spark.createDataFrame(data, "vec_id long, embedding array<float>")
    exact = [(r.vec_id, r.embedding) for r in frame.collect()]
    assert rows(mtree.top_inner_products(frame, lambda i: i % 50 == 0, shard_rows=shard_rows)) == brute(exact)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    data = [(0, [1.0, -1.0]), (50, [0.001]), (1, None), (2, [None, 1.0]), (3, [nan]), (4, [inf, 0.0]), (None, [9.0, 9.0]), (5, []), (6, [-0.001, 2.0, 3.0]), (100, None)]
    frame = spark.createDataFrame([(i, v, 1, "x") for i, v in data], "vec_id long, embedding array<double>, id int, v string")
    ask = lambda i: i % 50 == 0
    assert rows(mtree.top_inner_products(frame, ask)) == brute(data)
    assert mtree.top_inner_products(frame.limit(0), ask).count() == 0
    alone = frame.filter("vec_id = 0")
    assert mtree.top_inner_products(alone, ask).count() == 0


def test_bounds_save_work():
    rng = np.random.default_rng(1)
    points = np.concatenate([rng.normal(c, 1.0, (200, 16)) for c in rng.normal(0, 60, (20, 16))]).round()
    n2 = (points**2).sum(axis=1)
    tree = mtree.Tree.load(mtree.Tree(np.arange(len(points)), points.astype(np.int64), np.sqrt(n2.max() - n2)).dump())
    total = 0
    for q in points[::400]:
        found, work = tree.search(q.astype(np.int64), -1, int((q**2).sum() + n2.max()), 5)
        scores = points @ q
        want = sorted(((int(s), i) for i, s in enumerate(scores)), key=lambda x: (-x[0], x[1]))[:5]
        assert found == want
        total += work
    assert total < 0.5 * len(points) * len(points[::400])


def test_products_past_the_floats(spark):
    rng = np.random.default_rng(9)
    for size in (2.0**18, 2.0**21):  # squared norms of about 2^53 and 2^59
        data = [(i, (rng.normal(0, 1, 6) * size / 6**0.5).tolist()) for i in range(200)]
        data += [(200 + i, [x + 1 / 256 for x in data[0][1]]) for i in range(60)]
        frame = spark.createDataFrame(data, "vec_id long, embedding array<double>")
        exact = [(r.vec_id, r.embedding) for r in frame.collect()]
        assert rows(mtree.top_inner_products(frame, lambda i: i % 50 == 0, shard_rows=60)) == brute(exact)


def test_large_vectors_take_part(spark, monkeypatch):
    """Finite vectors of any size ask and are found; a score that a long can't hold is null, its rank is right."""
    frame = spark.createDataFrame([(0, [1.0, 2.0]), (1, [3.0, 1.0]), (50, [1e7, 1e7])], "vec_id long, embedding array<double>")
    assert rows(mtree.top_inner_products(frame, lambda i: i % 50 == 0)) == [(0, 1, 50, 256 * 256 * 30_000_000), (0, 2, 1, 5 * 65536), (50, 1, 1, 256 * 256 * 40_000_000), (50, 2, 0, 256 * 256 * 30_000_000)]
    monkeypatch.setattr(mtree, "LARGE_ROWS", 7)
    rng = np.random.default_rng(5)
    data = [(i, (rng.normal(0, 1, 3) * 10.0 ** rng.integers(-3, 9 if i % 3 else 300)).tolist()) for i in range(160)]
    data += [(i, data[i][1]) for i in (0, 3, 50, 51)] + [(200, [1e300, -1e300, 5.0]), (201, [1e300, -1e300, 4.0]), (250, [-5e-324, 0.0]), (300, []), (301, [float("inf"), 1.0]), (302, None), (None, [1e300])]
    frame = spark.createDataFrame(data, "vec_id long, embedding array<double>").repartition(3)
    want = brute_exact(data)
    assert any(s is None for *_, s in want) and any(s is not None for *_, s in want)
    assert rows(mtree.top_inner_products(frame, lambda i: i % 50 == 0)) == want
    only = [d for d in data if d[0] is not None and d[0] >= 200]
    assert rows(mtree.top_inner_products(frame.filter("vec_id >= 200"), lambda i: i % 50 == 0)) == brute_exact(only)


def brute_exact(data, k=5, scale=256):
    def small(v):
        w = [min(max(x, -(1 << 63)), (1 << 63) - 1) for x in v]
        return sum(float(x) * float(x) for x in w) < 2.0**62

    kept = [(i, [floor(Fraction(x) * scale) for x in v], v) for i, v in data if i is not None and v is not None and all(x is not None and isfinite(x) for x in v)]
    asks = {}
    for i, v, x in kept:
        if i % 50 == 0:
            asks[i] = min(asks.get(i, (2, [], [])), (0, v, x) if small(v) else (1, x, v))
    out = []
    for i, (kind, a, b) in sorted(asks.items()):
        q = b if kind else a
        best = sorted((-sum(x * y for x, y in zip(q, v, strict=False)), j) for j, v, _ in kept if j != i)[:k]
        out += [(i, r, j, -s if abs(s) < 1 << 63 else None) for r, (s, j) in enumerate(best, 1)]
    return out


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.integers(-(2**70), 2**70).map(lambda x: x >> 5 * (abs(x) % 15)), max_size=3), min_size=1, max_size=12), st.integers(1, 4))
def test_exact_best(points, k):
    ids = [i // 2 for i in range(len(points))]
    want = []
    for own, q in zip(ids, points, strict=True):
        best = sorted((-sum(x * y for x, y in zip(q, v, strict=False)), j) for j, v in zip(ids, points, strict=True) if j != own)[:k]
        want += [(own, j, -s) for s, j in best]
    assert mtree.exact_best(points, ids, points, ids, k) == want


def test_clusters_prune_shards(spark):
    """Vectors of one length in clusters meet few shards: the query rows that are searched grow as the vectors do."""
    rng = np.random.default_rng(4)
    pairs = []
    for n in (30, 120):
        centers = rng.normal(0, 1, (n, 16))
        points = centers[rng.integers(0, n, 50 * n)] + rng.normal(0, 0.01, (50 * n, 16))
        points *= 40 / np.linalg.norm(points, axis=1, keepdims=True)
        frame = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(points)], "vec_id long, embedding array<double>")
        seen, real = [], mtree.written
        mtree.written = lambda df, label, *a: seen.append((label, real(df, label, *a))) or seen[-1][1]
        try:
            got = rows(mtree.top_inner_products(frame, lambda i: i % 50 == 0, shard_rows=25))
        finally:
            mtree.written = real
        assert got == brute([(r.vec_id, r.embedding) for r in frame.collect()])
        pairs.append(sum(d.count() for label, d in seen if label == "queries"))
    power = np.log(pairs[1] / pairs[0]) / np.log(4)
    print(f"query rows searched over 1,500 and 6,000 vectors: {pairs}, power {power:.2f}")
    assert power < 1.1
