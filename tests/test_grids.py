"""Densities by partial grids against sums over all points and cells."""

from __future__ import annotations

import numpy as np
import pytest

from pitchlake.operators import grids, spatial


def brute(points, cols, rows, reach, bandwidth=6.0):
    """(subject, col, row) -> (value, count) for points (a, b, x, y, weight)."""
    w, h, out = 105 / cols, 68 / rows, {}
    round2 = (lambda v: np.floor(v * 100 + 0.5) / 100) if reach else (lambda v: v)
    for a, b, x, y, weight in points:
        for c in range(cols):
            for r in range(rows):
                d = (round2(w * (c + 0.5)) - x) ** 2 + (round2(h * (r + 0.5)) - y) ** 2
                value = weight * np.exp(-d / (2 * bandwidth**2)) if not reach or d <= reach**2 else 0.0
                here = min(cols - 1, int(x / w)) == c and min(rows - 1, int(y / h)) == r
                old = out.get((a, b, c, r), (0.0, 0))
                out[a, b, c, r] = (old[0] + value, old[1] + here)
    return out


@pytest.mark.parametrize("full", [True, False])
def test_against_all_points(spark, monkeypatch, full):
    monkeypatch.setattr(grids, "HELD", 3)
    r = np.random.default_rng(4)
    points = [(k % 5 if k % 7 else None, "ab"[k % 2], float(r.uniform(0, 105)), float(r.uniform(0, 68)), float(r.uniform(0.1, 2))) for k in range(400)] + [(1, "a", 105.0, 68.0, 1.0), (1, "a", 0.0, 0.0, 1.0)]
    df = spark.createDataFrame(points, "a int, b string, x double, y double, weight double").repartition(5)
    density = (spatial.heatmap_kde_full if full else spatial.heatmap_kde)(df.where("a is not null"), ["a", "b"], 12, 8, normalize=False)
    want = brute([p for p in points if p[0] is not None], 12, 8, None if full else 18.0)
    got = {(x.a, x.b, x.col, x.row): (x.value, x["count"]) for x in density.collect()}
    assert got.keys() == want.keys() and all(abs(got[k][0] - want[k][0]) < 1e-4 and got[k][1] == want[k][1] for k in want)


def test_what_is_shuffled(spark):
    """A row for each subject and task: as many as there are, however many points and cells."""
    df = spark.range(20_000).selectExpr("id % 4 AS a", "id % 105 * 1.0D AS x", "id % 68 * 1.0D AS y", "1.0D AS weight").repartition(6)
    out = grids.density(df, ["a"], [10.0, 60.0], [20.0, 50.0], 105.0, 68.0, 6.0)
    assert out.count() == 4 * 4 and out.agg({"count": "sum"}).first()[0] == 20_000
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    below = plan[plan.index("RepartitionByExpression") :]
    assert "MapInArrow" in below.split("\n", 2)[1] and grids.density(df.limit(0), ["a"], [1.0], [1.0], 105.0, 68.0, 6.0).count() == 0


def test_no_cell_is_joined(spark):
    """A density has all its cells: they aren't joined to a grid, where they would be broadcast, but come with their subject's peak."""
    df = spark.range(2000).selectExpr("id % 300 AS a", "id % 105 * 1.0D AS x", "id % 68 * 1.0D AS y", "1.0D AS weight").unionByName(spark.sql("SELECT CAST(NULL AS bigint) AS a, 50.0D AS x, 30.0D AS y, 2.0D AS weight"))
    for heat in (spatial.heatmap_kde(df, ["a"], 6, 4), spatial.heatmap_kde_full(df, ["a"], 6, 4)):
        assert "Join" not in heat._jdf.queryExecution().optimizedPlan().toString()
        rows = heat.collect()
        assert len(rows) == 301 * 24 and sum(r["count"] for r in rows) == 2001
        assert {r.a for r in rows if r.value == 1} == {*range(300), None}
        assert {(r.sample_size, r.total_weight) for r in rows if r.a is None} == {(1, 2.0)}
