"""DuckDB SQL of the shared intermediate tables, for checking the registered queries against a second engine."""

from __future__ import annotations

from .operators.metrics import COUNTS, RATES, SHARES, SUMS, TEAM_SUMS
from .plans.bridge import PRELUDE
from .plans.config import DEMAND, INVERTED, METRICS, PROFILE, RELEVANCE, ROLE_MINUTES, ROLES, STYLE


def rnd(x: str, n: int = 0) -> str:
    """Rounds half towards plus infinity."""
    return f"(floor(CAST({x} AS DOUBLE) * {10**n} + 0.5) / CAST({10**n} AS DOUBLE))"


def dist(x1: str, y1: str, x2: str, y2: str) -> str:
    return rnd(f"sqrt(({x2} - {x1}) * ({x2} - {x1}) + ({y2} - {y1}) * ({y2} - {y1}))", 2)


def goal(x: str, y: str) -> str:
    return dist(x, y, "105", "34")


def prog(x1: str, y1: str, x2: str, y2: str) -> str:
    a, b = goal(x1, y1), goal(x2, y2)
    return f"({a} - {b} > 0 AND ({a} - {b} >= {a} * 0.25 OR ({x2} > 52.5 AND {a} - {b} >= 10)))"


def box(x: str, y: str) -> str:
    return f"({x} >= 88.5 AND {y} >= 13.84 AND {y} <= 54.16)"


def values(rows: list[tuple]) -> str:
    one = lambda v: "NULL" if v is None else str(v).upper() if isinstance(v, bool) else repr(v) if isinstance(v, str) else f"CAST({v} AS DOUBLE)" if isinstance(v, float) else str(v)
    return ", ".join("(" + ", ".join(one(v).replace('"', "'") for v in r) + ")" for r in rows)


_P, _C, _S, _D = "type = 'PASS'", "type = 'CARRY'", "type = 'SHOT'", "type = 'DUEL'"
_TOUCH = "type IN ('PASS', 'SHOT', 'CARRY', 'DRIBBLE', 'TOUCH', 'CLEARANCE')"
_COUNT = {
    "passes": _P, "passes_completed": f"{_P} AND pass_completed", "progressive_passes": f"{_P} AND pass_completed AND progressive", "passes_final_third": f"{_P} AND pass_completed AND end_x >= 70",
    "passes_into_box": f"{_P} AND pass_completed AND {box('end_x', 'end_y')}", "key_passes": f"{_P} AND is_key_pass", "through_balls": f"{_P} AND is_through_ball", "switches": f"{_P} AND is_switch",
    "crosses": f"{_P} AND is_cross", "long_passes": "false", "carries": _C, "progressive_carries": f"{_C} AND progressive", "carries_final_third": f"{_C} AND end_x >= 70", "carries_into_box": f"{_C} AND {box('end_x', 'end_y')}",
    "dribbles": "type = 'DRIBBLE'", "dribbles_completed": "type = 'DRIBBLE' AND dribble_completed", "progressive_actions": f"progressive AND ({_C} OR ({_P} AND pass_completed))", "chances_created": f"{_P} AND is_key_pass",
    "touches": _TOUCH, "touches_final_third": f"{_TOUCH} AND x >= 70", "touches_box": f"{_TOUCH} AND {box('x', 'y')}", "shots": _S, "shots_on_target": f"{_S} AND on_target", "goals": f"{_S} AND is_goal",
    "assists": f"{_P} AND is_assist", "tackles": "type = 'TACKLE'", "tackles_won": "type = 'TACKLE' AND tackle_won", "interceptions": "type = 'INTERCEPTION'", "pressures": "type = 'PRESSURE'",
    "counterpressures": "type = 'PRESSURE' AND counterpress", "recoveries": "type = 'RECOVERY' AND NOT recovery_failed", "blocks": "type = 'BLOCK'", "clearances": "type = 'CLEARANCE'",
    "defensive_duels": f"{_D} AND duel_type <> 'AERIAL'", "defensive_duels_won": f"{_D} AND duel_type <> 'AERIAL' AND duel_won", "aerial_duels": f"{_D} AND duel_type = 'AERIAL'",
    "aerial_duels_won": f"{_D} AND duel_type = 'AERIAL' AND duel_won", "fouls_committed": "type = 'FOUL'",
}
_ratio = lambda a, b: f"CASE WHEN {b} > 0 THEN {rnd(f'CAST({a} AS DOUBLE) / {b}', 3)} ELSE 0 END"
_families = "(bool_or(passes > 0)::INT + bool_or(shots > 0)::INT + bool_or(carries + dribbles > 0)::INT + bool_or(tackles + interceptions + recovered + blocks + clearances > 0)::INT + bool_or(pressures > 0)::INT + bool_or(defensive_duels + aerial_duels > 0)::INT)"
_band = lambda minutes, matches, cover="1.0": f"CASE WHEN {minutes} >= 1800 AND {matches} >= 20 AND {cover} >= 0.8 THEN 'HIGH' WHEN {minutes} >= 900 AND {matches} >= 10 AND {cover} >= 0.5 THEN 'MEDIUM' WHEN {minutes} >= 180 AND {matches} >= 2 THEN 'LOW' ELSE 'INSUFFICIENT' END"

PLAYER_MATCH = f"""{PRELUDE},
evp AS (SELECT *, {prog('x', 'y', 'end_x', 'end_y')} AS progressive FROM ev),
pm0 AS (SELECT match_id, player_id, {', '.join(f'count(*) FILTER (WHERE {_COUNT[c]}) AS {c}' for c in COUNTS)}, count(*) FILTER (WHERE type = 'RECOVERY') AS recovered,
  coalesce(sum(CASE WHEN {_P} THEN xa END), 0) AS raw_xa, coalesce(sum(CASE WHEN {_S} THEN xg END), 0) AS raw_xg, coalesce(sum(CASE WHEN {_S} AND NOT is_penalty THEN xg END), 0) AS raw_npxg FROM evp GROUP BY match_id, player_id),
pmm AS (SELECT a.match_id, a.season_id, a.player_id, a.team_id, a.position_group, a.minutes, a.is_starter, {', '.join(f'coalesce({c}, 0) AS {c}' for c in [*COUNTS, 'recovered'])},
  {', '.join(f"coalesce({rnd('raw_' + c, 3)}, 0) AS {c}" for c in SUMS)}, coalesce({_ratio('passes_completed', 'passes')}, 0) AS pass_accuracy, coalesce({_ratio('raw_xg', 'shots')}, 0) AS xg_per_shot
  FROM app a LEFT JOIN pm0 USING (match_id, player_id))"""

SEASON = f"""{PLAYER_MATCH},
tot AS (SELECT season_id, player_id, arg_min(team_id, match_id) AS team_id, arg_min(position_group, match_id) AS position_group, sum(minutes) AS minutes, count(*) AS matches, count(*) FILTER (WHERE is_starter) AS starts,
  {', '.join(f'sum({c}) AS {c}' for c in [*COUNTS, *SUMS])}, {_families} AS families FROM pmm WHERE minutes > 0 GROUP BY season_id, player_id),
season AS (SELECT season_id, player_id, team_id, position_group, CAST(minutes AS BIGINT) AS minutes, matches, starts, {', '.join(f"{rnd(f'CAST({c} AS DOUBLE) / minutes * 90', 3)} AS {c}_p90" for c in RATES)},
  {', '.join(f'{_ratio(*v)} AS {k}' for k, v in SHARES.items())}, {_ratio('passes_completed', 'passes')} AS pass_accuracy, {_ratio('xg', 'shots')} AS xg_per_shot, {_band('minutes', 'matches', 'families / 7.0')} AS confidence FROM tot)"""

LONG = f"""{SEASON},
long AS (SELECT season_id, player_id, team_id, position_group, minutes, matches, metric_key, value FROM (UNPIVOT season ON {', '.join(METRICS)} INTO NAME metric_key VALUE value)),
pct AS (SELECT *, {rnd('cume_dist() OVER (PARTITION BY season_id, position_group, metric_key ORDER BY value) * 100', 1)} AS percentile FROM long)"""

PERCENTILES = f"""{LONG},
vp0 AS (SELECT *, {rnd('percent_rank() OVER (PARTITION BY season_id, position_group, metric_key ORDER BY value) * 100', 1)} AS percentile, avg(value) OVER w AS m, stddev_pop(value) OVER w AS sd, count(*) OVER w AS population_size
  FROM long WHERE minutes >= {{minutes}} WINDOW w AS (PARTITION BY season_id, position_group, metric_key {{order}})),
vp AS (SELECT season_id, player_id, team_id, position_group, minutes, metric_key, value, percentile, CASE WHEN sd IS NULL OR sd < 1e-12 THEN 0 ELSE {rnd('(value - m) / sd', 3)} END AS z_score, population_size FROM vp0)"""

PROFILES = f"""{LONG},
pw AS (SELECT * FROM (VALUES {values([(c, m, float(w)) for c, ms in PROFILE.items() for m, w in ms.items()])}) t(category, metric_key, weight)),
pd AS (SELECT category, sum(weight) AS defined FROM pw GROUP BY category),
rel AS (SELECT * FROM (VALUES {values([(g, c) for g, cs in RELEVANCE.items() for c in cs])}) t(position_group, category)),
dna AS (SELECT season_id, player_id, position_group, category, {rnd('sum(CAST(floor(percentile * 10 + 0.5) AS BIGINT) * CAST(weight * 100 AS BIGINT)) / 1000.0 / (sum(CAST(weight * 100 AS BIGINT)) / 100.0)', 1)} AS score, {rnd('sum(weight) / any_value(defined)', 2)} AS coverage
  FROM pct JOIN pw USING (metric_key) JOIN pd USING (category) JOIN rel USING (position_group, category) GROUP BY season_id, player_id, position_group, category)"""

ROLE_SCORES = f"""{LONG},
rr AS (SELECT * FROM (VALUES {values([(k, n, g, m, float(w), i) for i, (k, n, g, ms) in enumerate(ROLES) for m, w in ms.items()])}) t(role_key, role_name, position_group, metric_key, weight, role_order)),
rd AS (SELECT role_key, sum(weight) AS defined FROM rr GROUP BY role_key),
rs AS (SELECT season_id, player_id, position_group, any_value(minutes) AS minutes, any_value(matches) AS matches, role_key, any_value(role_order) AS role_order,
  {rnd('sum(CAST(floor(percentile * 10 + 0.5) AS BIGINT) * CAST(weight * 100 AS BIGINT)) / 1000.0 / (sum(CAST(weight * 100 AS BIGINT)) / 100.0)', 1)} AS score, {rnd('sum(weight) / any_value(defined)', 2)} AS coverage
  FROM pct JOIN rr USING (position_group, metric_key) JOIN rd USING (role_key) GROUP BY season_id, player_id, position_group, role_key),
ranked AS (SELECT *, row_number() OVER w AS rank, lead(score) OVER w AS next_score FROM rs WINDOW w AS (PARTITION BY season_id, player_id ORDER BY score DESC, role_order)),
roles AS (SELECT season_id, player_id, position_group, role_key, score, coverage, CAST(rank AS INT) AS rank, rank = 1 AND minutes >= {ROLE_MINUTES} AS is_primary, {_band('minutes', 'matches', 'coverage')} AS confidence,
  CASE WHEN rank = 1 THEN {rnd('least(1.0, (CASE WHEN next_score IS NULL THEN score ELSE greatest(0, score - next_score) END) / 20 * 0.6 + coverage * 0.4)', 2)} END AS margin_confidence FROM ranked)"""

_share = lambda a, b, most, n: f"CASE WHEN {b} > 0 THEN {rnd(f'CAST({a} AS DOUBLE) / {b} * {most * 10**n}')} / {10**n} ELSE 0 END"
TEAM_MATCH = f"""{PLAYER_MATCH},
tm0 AS (SELECT match_id, season_id, team_id, {', '.join(f'CAST(sum({c}) AS {"DOUBLE" if c == "xg" else "BIGINT"}) AS {c}' for c in TEAM_SUMS)} FROM pmm GROUP BY match_id, season_id, team_id),
tm AS (SELECT a.match_id, a.season_id, a.team_id, {_share('a.passes', 'w.passes', 100, 1)} AS possession, a.passes, {_share('a.passes_completed', 'a.passes', 1, 3)} AS pass_accuracy, a.progressive_passes, a.passes_final_third AS final_third_entries,
  a.passes_into_box AS box_entries, a.shots, a.shots_on_target, {rnd('a.xg', 3)} AS xg, a.goals, a.pressures, a.counterpressures, a.recoveries, a.tackles, a.interceptions, a.crosses, {_share('a.touches_final_third', 'w.touches', 100, 1)} AS field_tilt,
  CASE WHEN o.passes IS NOT NULL AND a.tackles + a.interceptions + a.pressures > 0 THEN {rnd('CAST(o.passes AS DOUBLE) / (a.tackles + a.interceptions + a.pressures)', 2)} END AS ppda, {_share('a.passes_final_third', 'a.passes', 100, 1)} AS directness, o.team_id AS opponent_id
  FROM tm0 a JOIN (SELECT match_id, sum(passes) AS passes, sum(touches_final_third) AS touches FROM tm0 GROUP BY match_id) w USING (match_id) LEFT JOIN tm0 o ON o.match_id = a.match_id AND o.team_id <> a.team_id)"""

_mean = {"possession": "possession", "passes": "passes_p90", "pass_accuracy": "pass_accuracy", "progressive_passes": "progression_p90", "xg": "xg_p90", "shots": "shots_p90", "pressures": "pressures_p90", "recoveries": "recoveries_p90", "final_third_entries": "final_third_entries_p90", "box_entries": "box_entries_p90", "field_tilt": "field_tilt", "ppda": "ppda", "directness": "directness"}
TEAM_SEASON = f"""{TEAM_MATCH},
tsm AS (SELECT a.season_id, a.team_id, count(*) AS matches, {', '.join(f"{rnd(f'avg(a.{c})', 6)} AS {n}" for c, n in _mean.items())}, coalesce({rnd('avg(o.xg)', 6)}, 0) AS xg_against_p90, {_band('count(*) * 90', 'count(*)')} AS confidence
  FROM tm a LEFT JOIN tm o ON o.match_id = a.match_id AND o.team_id = a.opponent_id GROUP BY a.season_id, a.team_id)"""

TEAM_METRICS = [*_mean.values(), "xg_against_p90"]
STYLES = f"""{TEAM_SEASON},
tl AS (SELECT season_id, team_id, metric_key, value FROM (UNPIVOT (SELECT season_id, team_id, {', '.join(TEAM_METRICS)} FROM tsm) ON {', '.join(TEAM_METRICS)} INTO NAME metric_key VALUE value)),
tp AS (SELECT *, {rnd('cume_dist() OVER (PARTITION BY season_id, metric_key ORDER BY value) * 100', 1)} AS raw FROM tl),
sw AS (SELECT * FROM (VALUES {values([(d, m, float(w), (d, m) in INVERTED, i) for i, (d, ms) in enumerate(STYLE.items()) for m, w in ms.items()])}) t(dimension, metric_key, weight, inverted, dimension_order)),
dims AS (SELECT DISTINCT dimension, dimension_order FROM sw),
sp AS (SELECT season_id, team_id, dimension, CASE WHEN inverted THEN {rnd('100 - raw', 1)} ELSE raw END AS p, weight FROM tp JOIN sw USING (metric_key)),
style0 AS (SELECT season_id, team_id, dimension, {rnd('sum(CAST(floor(p * 10 + 0.5) AS BIGINT) * CAST(weight * 100 AS BIGINT)) / 1000.0 / (sum(CAST(weight * 100 AS BIGINT)) / 100.0)', 1)} AS score FROM sp GROUP BY season_id, team_id, dimension),
style AS (SELECT t.season_id, t.team_id, d.dimension, coalesce(s.score, 0) AS score, s.score IS NOT NULL AS measured FROM tsm t CROSS JOIN dims d LEFT JOIN style0 s ON s.season_id = t.season_id AND s.team_id = t.team_id AND s.dimension = d.dimension)"""

FIT = f"""{STYLES.replace(PLAYER_MATCH, PROFILES)},
dm AS (SELECT * FROM (VALUES {values([(d, c, float(w), i) for i, (d, _, cs) in enumerate(DEMAND) for c, w in cs.items()])}) t(dimension, category, weight, dimension_order)),
asked AS (SELECT season_id, team_id, dimension, score AS demand, (score - 50) / 50 AS want FROM style WHERE score > 50),
supply AS (SELECT p.season_id, p.player_id, dm.dimension, any_value(dm.dimension_order) AS dimension_order, sum(CAST(floor(p.score * 10 + 0.5) AS BIGINT) * CAST(dm.weight * 100 AS BIGINT)) / 1000.0 / (sum(CAST(dm.weight * 100 AS BIGINT)) / 100.0) AS supply
  FROM dna p JOIN dm USING (category) GROUP BY p.season_id, p.player_id, dm.dimension),
parts AS (SELECT s.season_id, s.player_id, a.team_id, s.dimension, s.dimension_order, a.demand, {rnd('s.supply', 1)} AS supply, {rnd('a.want * 25', 1)} AS max_points, {rnd(f"s.supply / 100 * {rnd('a.want * 25', 1)}", 1)} AS points FROM supply s JOIN asked a ON a.season_id = s.season_id AND a.dimension = s.dimension),
fit AS (SELECT season_id, player_id, team_id, CASE WHEN sum(max_points) > 0 THEN {rnd('sum(CAST(floor(points * 10 + 0.5) AS BIGINT)) / CAST(sum(CAST(floor(max_points * 10 + 0.5) AS BIGINT)) AS DOUBLE) * 100', 1)} ELSE 0 END AS fit_score FROM parts GROUP BY season_id, player_id, team_id)"""


def normal(x: str) -> str:
    """The normal form of a name."""
    return f"trim(regexp_replace(regexp_replace(lower(strip_accents({x})), '[^a-z0-9\\s]', '', 'g'), '\\s+', ' ', 'g'))"


def likeness(pairs: str) -> str:
    """Common table expressions over pairs (id, a, b) of normal names: alike (id, a, b, s)."""
    hit = "coalesce(list_position(list_transform(free, lambda o: o = ta[k] OR (length(ta[k]) = 1 AND starts_with(o, ta[k])) OR (length(o) = 1 AND starts_with(ta[k], o))), true), 0)"
    return f"""pairs AS ({pairs}),
greedy AS (
  SELECT id, a, b, string_split(a, ' ') AS ta, string_split(b, ' ') AS free, 1 AS k, 0 AS n FROM pairs
  UNION ALL
  SELECT id, a, b, ta, CASE WHEN p > 0 THEN list_concat(free[1:p - 1], free[p + 1:]) ELSE free END, k + 1, n + (p > 0)::INT FROM (SELECT *, {hit} AS p FROM greedy WHERE k <= len(ta))),
alike AS (
  SELECT id, a, b, CASE WHEN a = b THEN 1.0 WHEN length(a) = 0 OR length(b) = 0 THEN 0.0
    ELSE {rnd("(1 - CAST(levenshtein(a, b) AS DOUBLE) / greatest(length(a), length(b))) * 0.35 + CAST(n AS DOUBLE) / greatest(len(ta), len(string_split(b, ' '))) * 0.65", 3)} END AS s
  FROM greedy WHERE k = len(ta) + 1)"""
