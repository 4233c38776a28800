import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from catalog_fusion.llm import angle_negatives
from catalog_fusion.llm.angle_negatives import ANGLE_SLACK, angle_bounds, angles_to, hard_negatives, integer_scores, norms_of, score_bounds

SCHEMA = "vec_id long, embedding array<float>, label int, row string, v int, score double, slice int"


def brute_force(rows, anchors, positives=5, negatives=10, window=(30, 90)):
    held = []
    for vec_id, v, label in rows:
        if vec_id is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        held.append((vec_id, [math.floor(256 * float(np.float32(x))) for x in v], label))
    score = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    out = []
    for i, (aid, a, al) in enumerate(held):
        if not anchors(aid):
            continue
        others = sorted((-score(a, v), vid, label, j) for j, (vid, v, label) in enumerate(held) if j != i)
        for s, pid, _, _ in [o for o in others if o[2] == al][:positives]:
            fit = [(n, nid) for n, nid, label, _ in others if label != al and window[0] * -s <= 100 * -n <= window[1] * -s][:negatives]
            out += [(aid, pid, k, nid, -s, -n) for k, (n, nid) in enumerate(fit, 1)]
    return sorted(out)


def mined(spark, rows, anchors, folder, parts=3, **more):
    frame = spark.createDataFrame([(*r, "x", 1, 0.5, 2) for r in rows], SCHEMA)
    frame.repartition(parts).write.parquet(folder)
    out = hard_negatives(spark.read.parquet(folder), anchors, **more)
    assert out.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(map(tuple, out.collect()))


def clustered(rng, count, dim=12, labels=4):
    centres = rng.normal(size=(6, dim))
    v = centres[rng.integers(0, 6, count)] + 0.3 * rng.normal(size=(count, dim))
    v /= np.linalg.norm(v, axis=1)[:, None]
    return [(i, [float(np.float32(x)) for x in v[i]], int(rng.integers(labels))) for i in range(count)]


@pytest.mark.parametrize("sizes", [{}, {"CHUNK": 40, "ANCHORS": 10, "REFERENCES": 4}, {"CHUNK": 7, "BANDS": 8, "REFERENCES": 1}])
def test_rows_equal_brute_force(spark, tmp_path, monkeypatch, sizes):
    for name, value in sizes.items():
        monkeypatch.setattr(angle_negatives, name, value)
    rows = clustered(np.random.default_rng(3), 400)
    rows += [(1000 + i, rows[5][1], i % 3) for i in range(120)]  # copies: ties in every score
    got = mined(spark, rows, F.col("vec_id") % 20 == 0, str(tmp_path / "e.parquet"))
    assert got == brute_force(rows, lambda i: i % 20 == 0) and got


def test_odd_rows(spark, tmp_path):
    rows = clustered(np.random.default_rng(4), 60, dim=4, labels=2)
    rows += [
        (100, None, 1), (101, [0.1, None, 0.2, 0.3], 1), (102, [float("nan"), 0.0, 0.0, 1.0], 0), (103, [float("inf"), 0.0, 0.0, 1.0], 0), (104, rows[0][1], None),
        (None, rows[1][1], 1), (105, [0.0] * 4, 0), (106, [], 1), (107, rows[2][1][:2], 1), (0, rows[0][1], rows[0][2]), (0, rows[0][1], rows[0][2]), (108, [300.0, -200.0, 5.0, 1e6], 1),
        (109, [-x for x in rows[0][1]], rows[0][2]),
    ]
    got = mined(spark, rows, F.col("vec_id") % 3 == 0, str(tmp_path / "e.parquet"))
    assert got == brute_force(rows, lambda i: i % 3 == 0)


def test_few_rows(spark, tmp_path):
    rows = clustered(np.random.default_rng(5), 30, labels=2)
    everything = F.lit(True)
    for i, some in enumerate([[], rows[:1], rows[:3], [r for r in rows if r[2] == 0], [(i, None, 1) for i in range(3)]]):
        assert mined(spark, some, everything, str(tmp_path / f"{i}.parquet")) == brute_force(some, lambda _: True)
    other = mined(spark, rows, everything, str(tmp_path / "w.parquet"), positives=2, negatives=1, window=(10, 100))
    assert other == brute_force(rows, lambda _: True, 2, 1, (10, 100))


def test_bounds_enclose_every_score():
    rng = np.random.default_rng(6)
    v = np.floor(256 * rng.normal(size=(300, 8)) * rng.uniform(0, 2, (300, 1)))
    v[7] = 0
    v[8], v[9] = v[10], -v[10]
    norms = norms_of(v)
    angles = angles_to(v, norms, v[:5] / norms[:5, None]).astype(np.float32).astype(float)
    for i in range(0, 300, 7):
        low, high = score_bounds(norms[i], norms, norms, *angle_bounds(angles[i], angles, angles))
        scores = integer_scores(v[i], v)
        assert np.all(low <= scores) and np.all(scores <= high)
        band = score_bounds(norms[i], norms.min(), norms.max(), *angle_bounds(angles[i], angles.min(0)[None], angles.max(0)[None]))
        assert band[0][0] <= scores.min() and scores.max() <= band[1][0]
    assert ANGLE_SLACK > 4 * np.finfo(np.float32).eps


def test_bounds_rule_out_far_clusters(spark, tmp_path, monkeypatch):
    """Only vectors whose bounds meet a window are scored."""
    rng = np.random.default_rng(7)
    v = np.repeat(np.eye(16), 60, 0) + 0.02 * rng.normal(size=(960, 16))
    vectors, norms = np.floor(256 * v), norms_of(np.floor(256 * v))
    angles = angles_to(vectors, norms, np.eye(16))
    low, high = score_bounds(norms[0], norms, norms, *angle_bounds(angles[0], angles, angles))
    assert ((high >= 0.5 * norms[0] ** 2) & (low <= norms[0] ** 2)).sum() < 100


def test_large_products_are_exact():
    a, b = np.array([2.0**40, 3.0]), np.array([[2.0**20, 1.0], [-(2.0**20), 1.0], [2.0**50, 0.0]])
    assert integer_scores(a, b).tolist() == [2**60 + 3, -(2**60) + 3, (1 << 63) - 1]
