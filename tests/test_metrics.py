from pyspark.sql import functions as F

from pitchlake.operators import metrics as M, windows

SCHEMA = """match_id int, player_id int, type string, x double, y double, end_x double, end_y double, outcome string, pass struct<completed:boolean,is_key_pass:boolean>, shot struct<xg:double,is_penalty:boolean,is_goal:boolean,on_target:boolean>,
  duel struct<duel_type:string,won:boolean>, recovery struct<failed:boolean>"""


def metrics(spark, events, appearances=None):
    rows = [(1, 1, e["type"], *(e.get(k) for k in ("x", "y", "end_x", "end_y", "outcome", "pass", "shot", "duel", "recovery"))) for e in events]
    return M.player_match_metrics(spark.createDataFrame(rows, SCHEMA), appearances)


def test_passes(spark):
    p = lambda done: {"type": "PASS", "pass": (done, None)}
    r = metrics(spark, [p(True), p(True), p(False)]).first()
    assert (r.passes, r.passes_completed, r.pass_accuracy, r.available.passing, r.available.shooting) == (3, 2, 0.667, True, False)
    r = metrics(spark, [{"type": "PASS", "x": 20.0, "y": 34.0, "end_x": 70.0, "end_y": 34.0}]).first()
    assert (r.progressive_passes, r.progressive_actions, r.passes_final_third) == (1, 1, 1)
    assert metrics(spark, [{"type": "PASS", "outcome": "INCOMPLETE"}]).first().passes_completed == 0


def test_shots_duels_and_recoveries(spark):
    r = metrics(spark, [{"type": "SHOT", "shot": (0.4, False, True, True)}, {"type": "SHOT", "shot": (0.76, True, True, True)}, {"type": "DUEL", "duel": ("AERIAL", True)}, {"type": "DUEL", "duel": ("GROUND", False)}, {"type": "RECOVERY"}, {"type": "RECOVERY", "recovery": (True,)}]).first()
    assert (r.xg, r.npxg, r.goals, r.aerial_duels, r.aerial_duels_won, r.defensive_duels, r.defensive_duels_won, r.recoveries) == (1.16, 0.4, 2, 1, 1, 1, 0, 1)


def test_season_of_two_matches(spark):
    apps = spark.createDataFrame([(m, 1, 5, 7, "FW", 90, m == 1) for m in (1, 2)] + [(1, 2, 5, 7, "GK", 0, False)], "match_id int, player_id int, season_id int, team_id int, position_group string, minutes int, is_starter boolean")
    rows = [(m, 1, "SHOT", 90.0, 34.0, None, None, None, None, (0.2, False, False, True), None, None) for m in (1, 2)]
    match = M.player_match_metrics(spark.createDataFrame(rows, SCHEMA), apps)
    assert match.count() == 3 and match.where("player_id = 2").first().shots == 0
    season = M.player_season_metrics(M.player_season_totals(match)).collect()
    assert len(season) == 1
    s = season[0]
    assert (s.matches, s.starts, s.minutes, s.shots_p90, s.xg_p90, s.distance_p90) == (2, 1, 180, 1.0, 0.2, None)


def test_season_adds_up_in_order_of_matches(spark):
    """0.282 + 0.7 + 0.108 is 1.09, a quarter of which rounds to 0.273; backwards it is 1.0899999999999999, and 0.272."""
    xg = {1: 0.282, 2: 0.7, 3: 0.108, 4: 0.0}
    apps = spark.createDataFrame([(m, 1, 5, 7, "FW", 90, True) for m in xg], "match_id int, player_id int, season_id int, team_id int, position_group string, minutes int, is_starter boolean")
    rows = [(m, 1, "SHOT", 90.0, 34.0, None, None, None, None, (v, False, False, True), None, None) for m, v in xg.items()]
    match = M.player_match_metrics(spark.createDataFrame(rows, SCHEMA), apps)
    kept = sorted(match.collect(), key=lambda r: r.match_id)
    for order in (kept, kept[::-1]):
        s = M.player_season_totals(spark.createDataFrame(order, match.schema).coalesce(1)).first()
        assert (s.xg, s.npxg, s.xa, s.xg_per_shot) == (1.09, 1.09, 0.0, 0.273)
    unknown = M.player_season_totals(match.withColumns({"xg": F.when(F.col("match_id") != 2, F.col("xg")), "xa": F.lit(None).cast("double")})).first()
    assert (unknown.xg, unknown.xa) == (0.282 + 0.108, None)


def test_ppda_needs_an_opponent(spark):
    cols = ["match_id", "season_id", "team_id", *M.TEAM_SUMS]
    row = lambda m, t, **k: (m, 1, t, *(k.get(c, 0.0 if c == "xg" else 0) for c in M.TEAM_SUMS))
    df = spark.createDataFrame([row(1, 1, passes=30, tackles=2, pressures=3), row(1, 2, passes=70), row(1, None, passes=100), row(2, 1, passes=5, tackles=1)], ", ".join(f"{c} {'double' if c == 'xg' else 'bigint'}" for c in cols))
    got = {(r.match_id, r.team_id): (r.possession, r.ppda) for r in M.team_match_metrics(df).collect()}
    assert got == {(1, 1): (15.0, 14.0), (1, 2): (35.0, None), (2, 1): (100.0, None)}


def test_populations(spark):
    long = spark.createDataFrame([(1, "FW", "m", float(v), 900, i) for i, v in enumerate([2, 4, 4, 4, 5, 5, 7, 9])], "season_id int, position_group string, metric_key string, value double, minutes int, player_id int")
    z = {r.value: (r.mean, r.stddev, r.z) for r in windows.zscore(long, ["metric_key"]).collect()}
    assert z[9.0] == (5.0, 2.0, 2.0) and z[5.0][2] == 0.0
    p = {r.value: r.percentile for r in windows.percentile_at_or_below(long, ["metric_key"]).collect()}
    assert p[9.0] == 100.0 and p[2.0] == 12.5
    whole = {r.player_id: (r.percentile, r.z_score, r.population_size) for r in windows.player_percentiles(long).collect()}
    running = {r.player_id: (r.z_score, r.population_size) for r in windows.player_percentiles(long, frame="running").collect()}
    assert whole[7] == (100.0, 2.0, 8) and running[0] == (0.0, 1) and running[3][1] == 4
    clubs = spark.createDataFrame([(1, i, float(v)) for i, v in enumerate([40, 45, 55, 60, 65])], "season_id int, team_id int, possession double")
    assert {r.value: r.percentile for r in windows.club_percentiles(clubs, ["possession"]).collect()} == {40.0: 0.0, 45.0: 25.0, 55.0: 50.0, 60.0: 75.0, 65.0: 100.0}
    assert windows.club_percentiles(clubs.where(F.col("team_id") == 0), ["possession"]).count() == 0


def test_hulls_against_a_chain():
    import numpy as np

    from pitchlake.operators import tracking

    def chain(points):
        points = sorted(set(map(tuple, points)))
        if len(points) < 3:
            return 0.0

        def half(ps):
            out = []
            for p in ps:
                while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                    out.pop()
                out.append(p)
            return out[:-1]

        hull = half(points) + half(points[::-1])
        return abs(sum(a[0] * b[1] - a[1] * b[0] for a, b in zip(hull, hull[1:] + hull[:1]))) / 2

    rng = np.random.default_rng(1)
    for n, values in ((3, 400), (7, 4), (11, 3), (11, 400)):  # few values: many points in one line, many equal
        x, y = rng.integers(0, values, (40, n)) / 4, rng.integers(0, values, (40, n)) / 4
        assert np.allclose(tracking.hull_areas(x, y), [chain(zip(a, b)) for a, b in zip(x.tolist(), y.tolist())])
