import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from catalog_fusion.llm import metric_topk
from catalog_fusion.llm.metric_topk import Page, distances, lifted, products, top_products

SCHEMA = "vec_id long, embedding array<float>, label int, score string, row int, rank int"


def brute_force(rows, k, every):
    whole = [(i, [math.floor(1024 * float(np.float32(x))) for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, (i, a) in enumerate(whole):
        if i is None or i % every:
            continue
        scores = [(-sum(x * y for x, y in zip(a, b)), (j is not None, j or 0), n, j) for n, (j, b) in enumerate(whole) if n != q]  # noqa: B905
        out += [(i, r + 1, j, -s) for r, (s, _, _, j) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=str)


def run(spark, rows, k=10, every=10):
    df = spark.createDataFrame([(i, v, 0, "s", 1, 2) for i, v in rows], SCHEMA).coalesce(2)
    return sorted(map(tuple, top_products(df, F.col("vec_id") % every == 0, k).collect()), key=str)


def clustered(seed, n, width=6):
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 1, (7, width))
    return (centres[rng.integers(0, 7, n)] + rng.normal(0, 0.1, (n, width)) * rng.choice([0, 1], (n, 1))).astype(np.float32).tolist()


@pytest.mark.parametrize(("per_pivot", "page", "queries", "fan", "levels"), [(2048, 4096, 2048, 16, 12), (40, 16, 7, 3, 12), (1000, 8, 9, 2, 12), (1000, 8, 9, 2, 1)])
def test_equal_to_brute_force(spark, monkeypatch, per_pivot, page, queries, fan, levels):
    for name, value in (("PER_PIVOT", per_pivot), ("PAGE", page), ("QUERIES", queries), ("NODE", 4), ("FAN", fan), ("LEVELS", levels)):
        monkeypatch.setattr(metric_topk, name, value)
    rows = list(enumerate(clustered(1, 300)))
    rows += [(500, None), (510, []), (520, [1.0, None]), (530, [float("nan")] * 6), (540, [float("inf")] * 6), (550, [0.5, 0.25])]
    rows += [(600 + i, [0.3, 0.1, -0.2, 0.0, 0.0, 0.7]) for i in range(60)]
    rows += [(10, [9.0] * 6), (10, [9.0] * 6), (None, [0.3, 0.1, -0.2, 0.0, 0.0, 0.7])]
    assert run(spark, rows) == brute_force(rows, 10, 10)


def test_few_rows_and_none(spark):
    assert run(spark, []) == []
    assert run(spark, [(1, [1.0])]) == []
    assert run(spark, [(0, [1.0])]) == []
    assert run(spark, [(0, [1.0]), (20, [2.0]), (3, [-1.0])]) == brute_force([(0, [1.0]), (20, [2.0]), (3, [-1.0])], 10, 10)


def test_scores_beyond_floating_point():
    a = np.array([[float(1 << 40), 1.0]])
    b = np.array([[float(1 << 20), 3.0], [float(1 << 23), 1.0], [float(1 << 30), 0.0]])
    assert products(a, b).tolist() == [[(1 << 60) + 3, (1 << 63) - 1, (1 << 63) - 1]]


def test_stored_distances_spare_computations():
    rng = np.random.default_rng(0)
    vectors = np.floor(1024 * np.array(clustered(2, 2000, 8)))
    square = float((vectors**2).sum(1).max())
    page = Page(np.arange(2000), np.arange(2000), vectors, vectors[0], square)
    again = Page.unpack(page.pack(), 8)
    computed = 0
    for q in rng.integers(0, 2000, 40):
        lift = np.append(vectors[q], 0.0)[None, :]
        away = distances(lift, lifted(vectors[:1], square))[0, 0]
        best, n = again.search(vectors[q], int(q), away, square, 10, None)
        computed += n
        want = sorted(((-int(s), i) for i, s in enumerate(vectors @ vectors[q]) if i != q))[:10]
        assert [(-s, i) for s, i, _ in best] == want
    assert computed < 40 * 2000 / 2


def test_every_point_is_covered():
    vectors = np.floor(1024 * np.array(clustered(3, 700, 5)))
    square = float((vectors**2).sum(1).max())
    page = Page(np.arange(700), np.arange(700), vectors, vectors[5], square)
    points, routers = lifted(page.vectors, square), lifted(page.routers, square)
    assert sorted(page.ids) == list(range(700))
    for i in range(len(routers)):
        low, high = page.starts[i], page.starts[i + 1]
        away = distances(points[low:high], routers[i : i + 1])[:, 0]
        assert np.allclose(away, page.entry_away[low:high], atol=1e-3) and (away <= page.radius[i] + 1e-3).all()


def test_computed_distances_grow_slower_than_vectors(spark, tmp_path, monkeypatch):
    """Clustered vectors, a page of 256 of them, and few pivots: the tree has to be deep."""
    for name, value in (("PIVOTS", 4), ("PAGE", 256)):
        monkeypatch.setattr(metric_topk, name, value)
    rng, counts = np.random.default_rng(8), []
    centres = rng.normal(0, 1, (400, 8))
    for n in (20_000, 40_000, 80_000):
        v = centres[rng.integers(0, 400, n)] + rng.normal(0, 0.05, (n, 8))
        pd.DataFrame({"vec_id": np.arange(n), "embedding": list(v.astype(np.float32))}).to_parquet(tmp_path / f"{n}.parquet")
        rows, computed = spark.read.parquet(str(tmp_path / f"{n}.parquet")), spark.sparkContext.accumulator(0)
        assert top_products(rows, F.col("vec_id") % (n // 40) == 0, computed=computed).count() == 400
        counts.append(computed.value / 40)
    assert counts[1] < 1.8 * counts[0] and counts[2] < 1.8 * counts[1] and counts[2] < 0.2 * 80_000
