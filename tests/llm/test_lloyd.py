import hashlib
import random
from fractions import Fraction
from math import floor, isfinite

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from attesta.llm import lloyd
from tests.compare import assert_same, connection


def brute(rows, k, rounds, dims, scale=64):
    kept = [(i, [floor(Fraction(x) * scale) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    centers = [v for _, v in order[:k]]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(centers))

    for _ in range(rounds):
        to = [near(v)[1] for _, v in kept]
        for j in range(len(centers)):
            own = [v for (_, v), t in zip(kept, to, strict=True) if t == j]
            if own:
                centers[j] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    found = [(i, *near(v)) for i, v in kept]
    fit = lambda x: x if x is not None and x < 1 << 63 else None

    def total(own):
        return None if any(fit(d) is None for d in own) else fit(sum(own))

    out = []
    for i, d, j in found:
        out.append((i, j, fit(d), total([e for _, e, q in found if q == j]), total([e for _, e, _ in found]), hashlib.sha256(",".join(map(str, centers[j])).encode()).hexdigest()))
    return sorted(out, key=str)


def result(df):
    return sorted((tuple(r[c] for c in ("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")) for r in df.collect()), key=str)


def test_query_matches_sql_and_brute_force(spark, sf_dir):
    assert assert_same(spark, connection(sf_dir), "op12", lloyd.op12_lloyd_clusters, lloyd.OP12_SQL, sf_dir) > 0
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    assert result(lloyd.op12_lloyd_clusters(spark, sf_dir)) == brute(rows, 16, 3, 64)


@pytest.mark.parametrize("width, kind", [(2, "double"), (3, "float"), (7, "double")])
def test_odd_rows(spark, width, kind, monkeypatch):
    monkeypatch.setattr(lloyd, "LANE_CHUNKS", 1)
    draw = random.Random(width)
    rows = [(i, [float(np.float32(draw.uniform(-2, 2))) for _ in range(5)]) for i in range(60)]
    rows += [rows[3], (4, rows[5][1]), (None, rows[6][1]), (None, [0.0] * 5), (100, None), (101, []), (102, [1.0] * 4), (103, [1.0, None, 1.0, 1.0, 1.0]), (104, [float("nan")] * 5), (105, [float("inf")] * 5), (106, [0.5] * 6), (107, [0.0, -0.0, 1.0, 2.0, -3.0])]
    rows += [(i, [1.5] * 5) for i in range(200, 240)]  # ties
    frame = spark.createDataFrame([(*r, 1, b"x", 7) for r in rows], f"vec_id long, embedding array<{kind}>, chunk int, data binary, cluster int").repartition(5)
    assert result(lloyd.clustered(frame, 6, 3, 5, width=width)) == brute(rows, 6, 3, 5)
    few = frame.filter("vec_id < 3")
    assert result(lloyd.clustered(few, 16, 2, 5, width=width)) == brute([r for r in rows if r[0] is not None and r[0] < 3], 16, 2, 5)
    for nothing in (frame.limit(0), frame.filter("vec_id = 104")):
        assert lloyd.clustered(nothing, 4, 1, 5).collect() == []


def test_large_components_stay_exact(spark):
    """Beyond 53, 63 and all bits of a double's whole numbers; sums that a long can't hold are null, clusters are right."""
    rows = [(i, [x * s, float(y)]) for i, (x, y, s) in enumerate([(1, 2, 1.0), (3, 1, 1.0), (2, 2, 1e9), (-3, 5, 1e9), (1, 1, 1e17), (-7, 0, 1e17), (1, 1, 1e300), (1.5, 1, 1e308), (-1.7, -1, 1e308), (1, 3, 1e-310)])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for k in (2, 4):
        assert result(lloyd.clustered(frame, k, 3, 2, width=1)) == brute(rows, k, 3, 2)
    small = rows[:4]
    assert result(lloyd.clustered(frame.filter("vec_id < 4"), 2, 2, 2)) == brute(small, 2, 2, 2)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.integers(-(2**70), 2**70), min_size=3, max_size=3), min_size=1, max_size=8), st.integers(0, 69))
def test_exact_arithmetic(rows, shift):
    numbers = [[v >> shift for v in r] for r in rows]
    x = np.array(numbers, object)
    if max(abs(v) for r in numbers for v in r) < 1 << 63:
        x = x.astype(np.int64)
    back = lloyd.unpack(lloyd.pack(x), 3)
    assert back.tolist() == numbers
    want = [[sum((a - b) ** 2 for a, b in zip(p, q, strict=True)) for q in numbers] for p in numbers]
    assert lloyd.squared(back, back).tolist() == want
    assert lloyd.added([lloyd.squared(back, back)] * 3).tolist() == [[3 * v for v in r] for r in want]
    cluster = np.arange(len(numbers)) % 2
    assert lloyd.by_cluster(back, cluster, 2).tolist() == [[sum(r[j] for r, c in zip(numbers, cluster, strict=True) if c == k) for j in range(3)] for k in range(2)]
