"""K-means against what makes it right, and independence of how rows are dealt."""

from __future__ import annotations

import numpy as np
import pytest

from pitchlake.operators import clusters


def frame(spark, rows):
    return spark.createDataFrame([(1, k, dict(zip("abc", map(float, v)))) for k, v in enumerate(rows)], "season_id int, player_id int, vector map<string,double>")


def test_separate_groups_are_found(spark):
    r = np.random.default_rng(1)
    centres = np.array([[10, 10, 10], [10, 90, 10], [90, 10, 50], [90, 90, 90], [50, 50, 50]])
    rows = np.concatenate([c + r.normal(0, 2, (40, 3)) for c in centres])
    found, told, inertia = clusters.cluster_players(frame(spark, rows).repartition(7), list("abc"), k=5)
    label = {x.player_id: x.cluster for x in found.collect()}
    groups = [{label[40 * g + i] for i in range(40)} for g in range(5)]
    assert all(len(g) == 1 for g in groups) and len(set.union(*groups)) == 5
    assert np.abs(np.array(told)[[g.pop() for g in groups]] - np.array([rows[40 * g : 40 * g + 40].mean(axis=0) for g in range(5)])).max() < 0.001
    assert abs(inertia - sum(((rows[40 * g : 40 * g + 40] - rows[40 * g : 40 * g + 40].mean(axis=0)) ** 2).sum() for g in range(5))) < 0.01


def test_more_starts_are_no_worse_and_dealing_does_not_matter(spark):
    rows = np.random.default_rng(2).uniform(0, 100, (300, 3))
    one = clusters.cluster_players(frame(spark, rows), list("abc"), starts=1)[2]
    ten = clusters.cluster_players(frame(spark, rows), list("abc"))
    dealt = clusters.cluster_players(frame(spark, rows).repartition(5, "player_id"), list("abc"))
    assert ten[2] <= one and ten[1:] == dealt[1:]
    assert sorted((x.player_id, x.cluster) for x in ten[0].collect()) == sorted((x.player_id, x.cluster) for x in dealt[0].collect())


def test_few_distinct_rows_and_too_few(spark):
    rows = [[1, 2, 3]] * 6 + [[4, 5, 6]]
    found, _, inertia = clusters.cluster_players(frame(spark, rows), list("abc"), k=4)
    assert inertia == 0 and len({x.cluster for x in found.collect()}) == 2
    missing = spark.createDataFrame([(1, k, {"a": float(k)}) for k in range(4)], "season_id int, player_id int, vector map<string,double>")
    assert clusters.cluster_players(missing, list("abc"), k=4)[2] == 0
    with pytest.raises(ValueError):
        clusters.cluster_players(frame(spark, rows[:3]), list("abc"), k=4)
