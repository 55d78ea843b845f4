import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from pitchlake.operators import models, search, spatial, tracking
from pitchlake.plans import config


def test_weights_are_complete(spark):
    assert len(config.ROLES) == 19 and len(config.PROFILE) == 11 and len(config.METRICS) == 38
    assert all(0.95 <= sum(w.values()) <= 1.05 for _, _, _, w in config.ROLES)


def pct(spark, rows):
    return spark.createDataFrame(rows, "season_id int, player_id int, team_id int, position_group string, minutes bigint, matches bigint, metric_key string, value double, percentile double")


def test_roles_and_profiles(spark):
    key, _, group, weights = config.ROLES[0]
    full = pct(spark, [(1, 1, 1, group, 900, 12, m, 1.0, 100.0) for m in weights] + [(1, 2, 1, group, 90, 1, "tackles_p90", 1.0, 80.0)])
    ranked = models.rank_roles(models.role_scores(full, config.roles(spark), config.role_requirements(spark)))
    r = {(x.player_id, x.role_key): x for x in ranked.collect()}
    best = r[1, key]
    assert (best.score, best.coverage, len(best.breakdown), best.is_primary) == (100.0, 1.0, 6, True)
    assert r[2, key].coverage == 0.2 and not r[2, key].is_primary and r[2, key].margin_confidence is None or r[2, key].margin_confidence < 0.7
    dna = {(x.player_id, x.category): (x.score, x.coverage) for x in models.player_dna(full, config.profile_weights(spark), config.profile_relevance(spark)).collect()}
    assert dna[2, "Defending"] == (80.0, 0.25) and (2, "Finishing") not in dna


def test_cosine(spark):
    arr = lambda *v: F.array(*(F.lit(x).cast("double") for x in v))
    r = spark.range(1).select(models.weighted_cosine(arr(90, 10), arr(90, 10)).alias("a"), models.weighted_cosine(arr(90, 10), arr(85, 15)).alias("b"), models.weighted_cosine(arr(90, 10), arr(10, 90)).alias("c"), models.weighted_cosine(arr(90, None), arr(None, 10)).alias("d"), models.weighted_cosine(arr(50), arr(50)).alias("e")).first()
    assert r.a == 1.0 and r.b > 0.9 and r.c < 0.1 and r.d == 0.0 and r.e == 1.0


def brute_similar(rows, weights, limit):
    """rows: (season, player, group, vector with None); the contract of similar_players by all pairs."""
    import math

    out = []
    for s, p, g, v in rows:
        best = []
        for t, q, h, o in rows:
            if s == t and g == h and p != q and g is not None:
                both = [(math.sqrt(w) * (x - 50), math.sqrt(w) * (y - 50)) for x, y, w in zip(v, o, weights) if x is not None and y is not None]
                norm = math.sqrt(sum(x * x for x, _ in both)) * math.sqrt(sum(y * y for _, y in both))
                cosine = 1.0 if norm == 0 else sum(x * y for x, y in both) / norm
                best.append((-math.floor(max(0, min(1, (cosine + 1) / 2)) * 10_000 + 0.5) if both else 0, q))
        out += [(s, g, p, q, k + 1, -n / 10_000) for k, (n, q) in enumerate(sorted(best)[:limit])]
    return sorted(out)


def test_similar_players_in_blocks(spark):
    """One block or many: same rows. Missing metrics, ties, equal players, no shared metric, a group of one, no group."""
    r = np.random.default_rng(1)
    rows = [(1 + k % 2, k, "MF" if k % 3 else "DF", [None if r.random() < 0.1 else float(np.round(100 * r.random(), 1)) for _ in range(5)]) for k in range(200)]
    rows += [(1, 300 + k, "MF", [80.0, 20.0, 50.0, 60.0, 10.0]) for k in range(15)] + [(1, 400, "FW", [1.0] * 5), (1, 401, None, [1.0] * 5), (2, 402, "MF", [None] * 5), (2, 403, "MF", [50.0] * 5)]
    keys, weights = list("abcde"), {"a": 2.0, "c": 0.5}
    frame = spark.createDataFrame([(s, p, g, dict(zip(keys, v))) for s, p, g, v in rows], "season_id int, player_id bigint, position_group string, vector map<string,double>")
    for w in (None, weights):
        want = brute_similar(rows, [(w or {}).get(k, 1.0) for k in keys], 10)
        for block in (7, 50, 2000):
            found = models.similar_players(frame, keys, weights=w, block=block)
            got = sorted((x.season_id, x.position_group, x.player_id, x.comparison_player_id, x["rank"], x.similarity) for x in found.collect())
            assert got == want
    assert models.similar_players(frame.limit(0), keys).count() == 0


def test_a_large_group_in_bounded_memory():
    """Two blocks of many rows meet in matrices of a bounded size."""
    from pitchlake.operators import similarity

    r = np.random.default_rng(2)
    x = r.random((5000, 38)) - 0.5
    m, own = np.ones_like(x), np.arange(5000)
    p, q, s = similarity._best(x, m, own, x, m, own, 10)
    assert len(p) == 50_000 and not (p == q).any() and s.min() >= 0 and s.max() <= 10_000


def test_fit_and_style(spark):
    style = spark.createDataFrame([(1, 9, "high_press", 8, 95.0, True), (1, 9, "possession", 0, 50.0, True), (1, 8, "possession", 0, 10.0, True)], "season_id int, team_id int, dimension string, dimension_order int, score double, measured boolean")
    dna = spark.createDataFrame([(1, 1, "MF", "Pressing", 10.0), (1, 1, "MF", "Passing", 90.0)], "season_id int, player_id int, position_group string, category string, score double")
    fit = {r.team_id: r for r in models.club_fit(dna, style, config.demand_model(spark)).collect()}
    assert fit[8].fit_score == 0.0 and fit[9].fit_score < 20 and fit[9].gaps[0].dimension == "high_press"
    clubs = spark.createDataFrame([(1, i, 20, 1.0 + i) for i in range(5)], "season_id int, team_id int, matches bigint, xg_against_p90 double")
    got = {(r.team_id, r.dimension): (r.score, r.measured) for r in models.team_style(clubs, config.style_weights(spark)).collect()}
    assert got[0, "defensive_compactness"] == (80.0, True) and got[0, "crossing"] == (0.0, False)


def test_heatmaps(spark):
    pts = spark.createDataFrame([(1, 50.0, 30.0, 1.0), (1, 50.0, 30.0, 1.0), (1, 104.9, 67.9, 1.0), (1, 120.0, 5.0, 1.0), (1, float("nan"), 5.0, 1.0)], "s int, x double, y double, weight double")
    grid = spatial.heatmap_grid(pts, ["s"], 12, 8).collect()
    assert len(grid) == 96 and max(r.value for r in grid) == 1.0 and sum(r["count"] for r in grid) == 3
    kde = spatial.heatmap_kde(pts, ["s"]).collect()
    assert sum(r.value > 0 for r in kde) > 10 and sum(r["count"] for r in kde) == 3
    rows = {(r.row, r.col): r.x for r in spatial.heatmap_hexbin(pts, ["s"]).collect()}
    assert rows[0, 0] != rows[1, 0] and spatial.heatmap_grid(pts.limit(0), ["s"]).count() == 0
    full = spatial.heatmap_kde_full(pts, ["s"], method="covariance").collect()
    assert len(full) == 384 and max(r.value for r in full) == 1.0


def test_filters(spark):
    rows = [(1, 10, "PASS", "a", True), (2, 60, "SHOT", "b", False), (2, 80, "PASS", "a", None)]
    e = spark.createDataFrame(rows, "period int, minute int, type string, team_id string, in_possession boolean")
    n = lambda **k: spatial.filter_events(e, **k).count()
    assert (n(half=1), n(minutes=(50, None)), n(team_id="b"), n(types=["SHOT"]), n(possession="OUT"), n(possession="IN")) == (1, 2, 1, 1, 1, 2)


def test_network(spark):
    row = lambda p, x, y, ex, to, done=True: (1, 1, "PASS", p, 5, x, y, ex, ex, (to, done))
    e = spark.createDataFrame([row("a", 20.0, 30.0, None, "b"), row("a", 40.0, 40.0, None, "b"), row("b", 60.0, 34.0, None, "a"), row("b", 60.0, 34.0, None, "a", False), row("b", 60.0, 34.0, None, None)], "match_id int, team_id int, type string, player_id string, minute int, x double, y double, end_x double, end_y double, pass struct<recipient_id:string,completed:boolean>")
    nodes, edges, totals = spatial.passing_network(e)
    a = {r.player_id: r for r in nodes.collect()}["a"]
    assert (a.x, a.y, a.passes, a.received) == (30.0, 35.0, 2, 1)
    assert [(r.from_id, r.to_id, r.passes) for r in edges.collect()] == [("a", "b", 2)]
    t = totals.first()
    assert (t.total_passes, t.completed_passes, t.linked_passes) == (5, 4, 3)


def test_tracking(spark):
    schema = "session_id int, frame_index int, player_id int, team_id int, x double, y double, speed_ms double, ball_in_play boolean, possession_team_id int"
    line = [(1, f, p, 1, 20.0 + 10 * p + f, 20.0 + 14 * p, None, f != 3, None) for f in range(4) for p in range(3)]
    s = tracking.team_shape(spark.createDataFrame(line, schema)).collect()
    assert [(r.phase, r.frames, r.team_width_m, r.team_depth_m, r.line_distance_m) for r in s] == [("ALL", 3, 28.0, 20.0, 20.0)]
    run = [(1, f, 7, 1, 10 + 0.8 * f, 30.0, 8.0, True, 1) for f in range(11)] + [(1, 0, 8, 1, 0.0, 0.0, 9.0, True, 1), (1, 1, 8, 1, 90.0, 0.0, 9.0, True, 1)]
    p = {r.player_id: r for r in tracking.player_physical(spark.createDataFrame(run, schema)).collect()}
    assert (p[7].distance_m, p[7].sprint_count, p[7].max_speed_ms, p[8].distance_m) == (8.0, 1, 8.0, 0.0)


def test_a_sprint_survives_a_dropped_step(spark):
    schema = "session_id int, frame_index int, player_id int, team_id int, x double, y double, speed_ms double"
    rows = [(1, f, 1, 1, float(x), 0.0, s) for f, (x, s) in enumerate([(0, 8.0), (0.8, 8.0), (60, 8.0), (60.8, 8.0), (61, 2.0), (61.8, 8.0)])]
    assert tracking.player_physical(spark.createDataFrame(rows, schema)).first().sprint_count == 2


def test_hulls():
    square = np.array([(0, 0), (10, 0), (10, 10), (0, 10), (5, 5), (5, 0), (5, 0)], float)
    assert tracking.hull_area(square[:, 0], square[:, 1]) == 100.0 and tracking.hull_area(np.ones(1), np.ones(1)) == 0.0 and tracking.hull_area(np.arange(5.0), np.arange(5.0)) == 0.0
    rng = np.random.default_rng(2)
    assert 80 < tracking.hull_area(rng.uniform(0, 10, 200), rng.uniform(0, 10, 200)) < 100


def test_comparing_takes_two_to_five(spark):
    import pytest

    for ids in ([1], [1, 1], list(range(6))):
        with pytest.raises(ValueError):
            search.compare_players(ids, None, None, None)


def test_vectors_are_made_once_for_similar_players(spark):
    """What reads the vectors in several places reads one shuffle, and few pairs of a block are scored in full."""
    from pitchlake.operators import similarity

    made, n = spark.sparkContext.accumulator(0), 60
    seen = F.udf(lambda a: (made.add(1), a)[1], "map<string,double>")
    rng = np.random.default_rng(1)
    rows = [(1, k, "MF", {m: float(v) for m, v in zip("abc", rng.integers(0, 1000, 3) / 10)}) for k in range(n)]
    vectors = spark.createDataFrame(rows, "season_id int, player_id int, position_group string, vector map<string,double>").withColumn("vector", seen("vector"))
    assert models.similar_players(vectors, list("abc"), limit=2).count() == 2 * n and made.value == n

    x, y = (np.round(rng.uniform(0, 100, (k, 38)), 1) - 50 for k in (700, 900))
    scored, plain = [], similarity._likeness
    similarity._likeness = lambda x, mx, y, my: (scored.append(len(x) * len(y)), plain(x, mx, y, my))[1]
    try:
        own, other, one = np.arange(700), np.arange(700, 1600), np.ones_like
        few = similarity._best(x, one(x), own, y, one(y), other, 10)
        assert not scored
    finally:
        similarity._likeness = plain
    every = similarity._all(x, one(x), own, y, one(y), other, 10)
    assert set(zip(*map(list, few))) == set(zip(*map(list, every)))


def test_physical_output_over_stretches(spark, monkeypatch):
    """Whatever stretches a player is cut into, the output is that of one; no window holds more than a stretch, or a player's stretches."""
    schema = "session_id int, frame_index int, player_id int, team_id int, x double, y double, speed_ms double"
    rng = np.random.default_rng(5)
    rows = []
    for p in range(4):
        x = np.cumsum(rng.choice([0.1, 0.65, 0.75, 5.0], 60, p=[0.3, 0.3, 0.3, 0.1])).round(2)
        rows += [(1, int(f), p, 1, float(x[f]), None if (f + p) % 17 == 0 else 1.0, None if f % 3 else float(rng.choice([1.0, 6.0, 8.0]))) for f in rng.permutation(60) if f % 11 != 7]
    positions = spark.createDataFrame(rows, schema)

    def found(stretch):
        monkeypatch.setattr(tracking, "STRETCH", stretch)
        out = tracking.player_physical(positions)
        return sorted(map(tuple, out.collect()))

    whole = found(1000)
    assert sum(r[8] for r in whole) > 8 and found(1) == found(2) == found(7) == whole
    order = Window.partitionBy("player_id").orderBy("frame_index")
    step = F.sqrt(F.pow(F.col("x") - F.lag("x").over(order), 2) + F.pow(F.col("y") - F.lag("y").over(order), 2))
    s = positions.withColumn("step", step).withColumn("speed", F.when(F.col("step") <= 1.2, F.coalesce("speed_ms", F.col("step") * 10)))
    s = s.withColumn("before", F.last(F.col("speed") >= 7, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1)))
    plain = s.groupBy("player_id").agg(F.count_if((F.col("speed") >= 7) & ~F.coalesce("before", F.lit(False))).alias("n"), F.max("speed").alias("m")).orderBy("player_id").collect()
    assert [(r[1], r[8], r[9]) for r in whole] == [(r.player_id, r.n, round(r.m, 2)) for r in plain]
