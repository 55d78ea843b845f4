"""Moments of populations against numpy, and that no window holds rows of players."""

from __future__ import annotations

import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from pitchlake.operators import windows


def half_up(x: float, n: int) -> float:
    return math.floor(x * 10**n + 0.5) / 10**n


ROWS = [(s, p, "passes", 900, k, v) for s in (1, 2, None) for p, values in (("MF", [1.0, 1.0, 2.5, 7.0, None, 7.0, 3.25]), ("DF", [4.0] * 5), ("GK", [3.0]), ("FW", [None, None])) for k, v in enumerate(values)]
KEYS = ["season_id", "position_group", "metric_key"]


@pytest.fixture(scope="module")
def long(spark):
    return spark.createDataFrame(ROWS, "season_id int, position_group string, metric_key string, minutes int, player_id int, value double")


def populations():
    out = {}
    for s, p, m, _, k, v in ROWS:
        out.setdefault((s, p, m), []).append((k, v))
    return out


def test_zscore(long):
    got = {(r.season_id, r.position_group, r.metric_key, r.player_id): (r.mean, r.stddev, r.z) for r in windows.zscore(long, KEYS).collect()}
    assert len(got) == len(ROWS)
    for key, members in populations().items():
        known = [v for _, v in members if v is not None]
        mean = half_up(round(float(np.mean(known)), 9), 3) if known else None
        sd = half_up(round(math.sqrt(np.mean([(v - mean) ** 2 for v in known])), 9), 3) if len(known) > 1 else 0.0
        for k, v in members:
            z = 0.0 if sd == 0 else None if v is None else half_up(round((v - mean) / sd, 9), 3)
            assert got[(*key, k)] == (mean, sd, z)


def test_running(long):
    got = {(r.season_id, r.position_group, r.metric_key, r.player_id): (r.percentile, r.z_score, r.population_size) for r in windows.player_percentiles(long, frame="running").collect()}
    assert len(got) == len(ROWS)
    for key, members in populations().items():
        for k, v in members:
            upto = [w for _, w in members if v is None or w is not None and w <= v]
            known = [w for w in upto if w is not None]
            below = sum(w is not None and (v is None or w < v) for _, w in members)
            sd = float(np.std(known)) if known else 0.0
            z = 0.0 if sd < 1e-12 else None if v is None else half_up((v - float(np.mean(known))) / sd, 3)
            assert got[(*key, k)] == (half_up(below / (len(members) - 1) * 100, 1) if len(members) > 1 else 0.0, z, len(upto))


def test_equal_large_values_have_no_deviation(spark):
    rows = [(1, "MF", "x", 900, k, 1e9 + 0.1) for k in range(1000)] + [(1, "MF", "x", 900, 1001, 1e9 + 1.1)]
    out = windows.player_percentiles(spark.createDataFrame(rows, "season_id int, position_group string, metric_key string, minutes int, player_id int, value double"), frame="running")
    assert {r.z_score for r in out.where(F.col("player_id") < 1000).collect()} == {0.0} and out.where("player_id = 1001").first().z_score > 30


def test_windows_hold_distinct_values(long):
    """Every window of the plans stands over counts of values."""
    for out in (windows.zscore(long, KEYS), windows.player_percentiles(long, frame="running"), windows.player_percentiles(long)):
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        below = [plan[m.start() :] for m in re.finditer(r"\bWindow \[", plan)]
        assert all("Aggregate" in x for x in below)
    assert "Window" not in windows.zscore(long, KEYS)._jdf.queryExecution().optimizedPlan().toString()


def test_values_are_not_broadcast(long):
    """Distinct values may be as many as players, whatever Spark takes them for."""
    for made in (windows.player_percentiles(long, 60), windows.percentile_at_or_below(long, KEYS)):
        plan = made._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
