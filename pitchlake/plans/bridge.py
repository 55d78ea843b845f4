"""Football tables derived from the generic star-schema tables, by fixed integer formulas; and the same as DuckDB SQL.

`events` rows become match events with typed details, `part`, `nation` and `region` name the players, teams and
competitions, `events` times 22 players become tracking frames.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Upper bounds of the roll of each event type.
ROLLS = ((52, "PASS"), (62, "CARRY"), (66, "DRIBBLE"), (70, "SHOT"), (76, "DUEL"), (81, "TACKLE"), (85, "INTERCEPTION"), (91, "PRESSURE"), (95, "RECOVERY"), (97, "CLEARANCE"), (99, "BLOCK"), (101, "FOUL"))

_BASE = """
  event_id AS e, user_id AS u, {days} AS d, (event_id * 31 + user_id * 17) % 100 AS roll
"""
#: Columns over e, u, d and roll that both engines understand; {div} is integer division.
_EVENT = """
  e AS event_id, d * 10 + (u % 10) {div} 2 AS match_id, CASE WHEN d < 15 THEN 1 ELSE 2 END AS season_id, u AS player_id, u % 10 AS team_id,
  CASE (u + u {div} 10) % 4 WHEN 0 THEN 'GK' WHEN 1 THEN 'DF' WHEN 2 THEN 'MF' ELSE 'FW' END AS position_group,
  CAST((e * 7919 + u * 104729) % 10501 AS DOUBLE) / 100 AS x, CAST((e * 6151 + u * 30011) % 6801 AS DOUBLE) / 100 AS y,
  CAST((e * 3571 + u * 15013) % 10501 AS DOUBLE) / 100 AS end_x, CAST((e * 2749 + u * 4409) % 6801 AS DOUBLE) / 100 AS end_y,
  {type} AS type, CAST(e % 95 AS INT) AS minute, CAST(e % 60 AS INT) AS second, CASE WHEN e % 95 < 45 THEN 1 ELSE 2 END AS period, e AS sequence,
  u % 10 + 1 - 2 * (u % 2) AS opponent_id, CASE WHEN e % 5 = 0 THEN u % 10 + 1 - 2 * (u % 2) ELSE u % 10 END AS possession_team_id,
  (e * 13 + u) % 100 < 78 AS pass_completed, CASE WHEN (e * 13 + u) % 100 < 78 THEN u + 10 * (1 + e % 3) END AS recipient_id,
  e % 11 = 0 AS is_cross, e % 17 = 0 AS is_switch, e % 29 = 0 AS is_through_ball,
  (e * 13 + u) % 100 < 78 AND e % 13 = 0 AS is_key_pass, (e * 13 + u) % 100 < 78 AND e % 39 = 0 AS is_assist,
  CASE WHEN (e * 13 + u) % 100 < 78 AND e % 13 = 0 THEN CAST((e * 7) % 300 AS DOUBLE) / 1000 END AS xa,
  CAST(10 + (e * 37) % 700 AS DOUBLE) / 1000 AS xg, e % 3 = 0 AS on_target, e % 9 = 0 AS is_goal, e % 23 = 0 AS is_penalty,
  CASE WHEN e % 5 < 2 THEN 'AERIAL' ELSE 'GROUND' END AS duel_type, e % 2 = 0 AS duel_won, e % 2 = 0 AS tackle_won, e % 3 = 0 AS counterpress, e % 7 = 0 AS recovery_failed,
  e % 2 = 0 AS dribble_completed,
  CASE e % 11 WHEN 0 THEN 'From Corner' WHEN 1 THEN 'From Throw In' WHEN 2 THEN 'From Free Kick' WHEN 3 THEN NULL ELSE 'Regular Play' END AS play_pattern,
  CAST(e % 40 AS DOUBLE) / 10 AS duration_sec, 'p1' AS provider_id, CAST(e AS {string}) AS provider_event_id
"""
_TYPE = "CASE " + " ".join(f"WHEN roll < {n} THEN '{t}'" for n, t in ROLLS) + " END"
_DUCK = {"div": "//", "string": "VARCHAR", "type": _TYPE}
_SPARK = {"div": "div", "string": "STRING", "type": _TYPE}

#: DuckDB common table expressions: ev, app(earances), matches, players, teams, seasons.
PRELUDE = f"""
WITH base AS (SELECT {_BASE.format(days="date_diff('day', DATE '2024-01-01', CAST(ts AS DATE))")} FROM events),
ev AS (SELECT {_EVENT.format(**_DUCK)} FROM base),
app AS (SELECT DISTINCT match_id, season_id, player_id, team_id, position_group, CAST(30 + (match_id * 7 + player_id * 13) % 61 AS INT) AS minutes, (match_id * 7 + player_id * 13) % 61 >= 30 AS is_starter FROM ev),
matches AS (
  SELECT DISTINCT match_id, season_id, 2 * (match_id % 10) AS home_team_id, 2 * (match_id % 10) + 1 AS away_team_id, CAST(DATE '2024-01-01' + CAST(match_id // 10 AS INT) AS TIMESTAMP) AS kickoff_at,
    CAST(match_id % 4 AS INT) AS home_score, CAST(match_id % 3 AS INT) AS away_score FROM ev),
users AS (SELECT DISTINCT user_id AS u FROM events),
players AS (
  SELECT u AS player_id, p_name || ' ' || p_type AS full_name, CAST(DATE '1985-01-01' + CAST((u * 137) % 7000 AS INT) AS DATE) AS birth_date, CAST(165 + (u * 7) % 30 AS INT) AS height_cm,
    CASE u % 3 WHEN 0 THEN 'LEFT' WHEN 1 THEN 'RIGHT' ELSE 'BOTH' END AS foot, n_name AS country, CASE (u + u // 10) % 4 WHEN 0 THEN 'GK' WHEN 1 THEN 'DF' WHEN 2 THEN 'MF' ELSE 'FW' END AS position_group
  FROM users LEFT JOIN part ON p_partkey = u LEFT JOIN nation ON n_nationkey = u % 25),
teams AS (SELECT CAST(n_nationkey AS BIGINT) AS team_id, n_name AS team_name, r_name AS country FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey < 10),
seasons AS (SELECT CAST(r_regionkey AS INT) AS season_id, r_name AS competition_name, CASE r_regionkey WHEN 1 THEN '2023/24' ELSE '2024/25' END AS season_name, CASE r_regionkey WHEN 1 THEN DATE '2024-01-15' ELSE DATE '2024-01-31' END AS end_date FROM region WHERE r_regionkey IN (1, 2))
"""


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with flat details; details() packs them."""
    base = read(spark, sf_dir, "events").selectExpr(*_split(_BASE.format(days="datediff(CAST(ts AS DATE), DATE'2024-01-01')")))
    return base.selectExpr(*_split(_EVENT.format(**_SPARK)))


def details(flat: DataFrame) -> DataFrame:
    """Packs the flat details into a nullable struct for each type."""
    of = lambda kind, **fields: F.when(F.col("type") == kind, F.struct(*(F.col(c).alias(n) for n, c in fields.items()))).alias(kind.lower())
    base = [c for c in flat.columns if c not in _DETAILS]
    return flat.select(
        *base,
        of("PASS", completed="pass_completed", recipient_id="recipient_id", is_cross="is_cross", is_switch="is_switch", is_through_ball="is_through_ball", is_key_pass="is_key_pass", is_assist="is_assist", xa="xa"),
        of("SHOT", xg="xg", on_target="on_target", is_goal="is_goal", is_penalty="is_penalty"), of("DRIBBLE", completed="dribble_completed"), of("DUEL", duel_type="duel_type", won="duel_won"),
        of("TACKLE", won="tackle_won"), of("PRESSURE", counterpress="counterpress"), of("RECOVERY", failed="recovery_failed"),
    )


_DETAILS = "pass_completed recipient_id is_cross is_switch is_through_ball is_key_pass is_assist xa xg on_target is_goal is_penalty dribble_completed duel_type duel_won tackle_won counterpress recovery_failed".split()


def _split(text: str) -> list[str]:
    """Expressions of a select list; commas in parentheses don't part them."""
    out, depth, now = [], 0, ""
    for c in text:
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            out.append(now.strip())
            now = ""
        else:
            now += c
    return [*out, now.strip()]


def appearances(ev: DataFrame) -> DataFrame:
    rest = (F.col("match_id") * 7 + F.col("player_id") * 13) % 61
    return ev.select("match_id", "season_id", "player_id", "team_id", "position_group").distinct().select("*", (rest + 30).cast("int").alias("minutes"), (rest >= 30).alias("is_starter"))


def matches(ev: DataFrame) -> DataFrame:
    return ev.select("match_id", "season_id").distinct().selectExpr(
        "match_id", "season_id", "2 * (match_id % 10) AS home_team_id", "2 * (match_id % 10) + 1 AS away_team_id", "CAST(date_add(DATE'2024-01-01', CAST(match_id div 10 AS INT)) AS TIMESTAMP_NTZ) AS kickoff_at", "CAST(match_id % 4 AS INT) AS home_score", "CAST(match_id % 3 AS INT) AS away_score"
    )


def players(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = read(spark, sf_dir, "events").select(F.col("user_id").alias("u")).distinct()
    parts, nations = read(spark, sf_dir, "part"), read(spark, sf_dir, "nation")
    return users.join(parts, parts.p_partkey == users.u, "left").join(nations, nations.n_nationkey == users.u % 25, "left").selectExpr(
        "u AS player_id", "p_name || ' ' || p_type AS full_name", "date_add(DATE'1985-01-01', CAST((u * 137) % 7000 AS INT)) AS birth_date", "CAST(165 + (u * 7) % 30 AS INT) AS height_cm",
        "CASE u % 3 WHEN 0 THEN 'LEFT' WHEN 1 THEN 'RIGHT' ELSE 'BOTH' END AS foot", "n_name AS country", "CASE (u + u div 10) % 4 WHEN 0 THEN 'GK' WHEN 1 THEN 'DF' WHEN 2 THEN 'MF' ELSE 'FW' END AS position_group",
    )


def teams(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, r = read(spark, sf_dir, "nation"), read(spark, sf_dir, "region")
    return n.join(r, n.n_regionkey == r.r_regionkey).where("n_nationkey < 10").selectExpr("CAST(n_nationkey AS BIGINT) AS team_id", "n_name AS team_name", "r_name AS country")


def seasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "region").where("r_regionkey IN (1, 2)").selectExpr(
        "CAST(r_regionkey AS INT) AS season_id", "r_name AS competition_name", "CASE r_regionkey WHEN 1 THEN '2023/24' ELSE '2024/25' END AS season_name", "CASE r_regionkey WHEN 1 THEN DATE'2024-01-15' ELSE DATE'2024-01-31' END AS end_date"
    )


def tracking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions at 10 Hz: a frame for each event, 22 players."""
    frames = read(spark, sf_dir, "events").select(F.col("event_id").alias("f"), F.explode(F.sequence(F.lit(0), F.lit(21))).alias("p"))
    return frames.selectExpr(*_split(_TRACK.format(div="div")))


def frame_lists(spark: SparkSession, sf_dir: str, *by: Column) -> DataFrame:
    """(by, frames): the rows of tracking() by frame, in arrays of the frames that agree in `by`, columns over frame_index.

    A frame has its columns, and players (player_id, team_id, x, y) as an array. All follows from a frame's number: only
    numbers are moved, and frames are made where their array is.
    """
    of = {e.rsplit(" AS ", 1)[1]: e.rsplit(" AS ", 1)[0] for e in _split(_TRACK.format(div="div"))}
    own = ["player_id", "team_id", "x", "y"]
    players = f"transform(sequence(0, 21), p -> struct({', '.join(f'{of[c]} AS {c}' for c in own)})) AS players"
    frame = f"struct({', '.join(f'{of[c]} AS {c}' for c in of if c not in [*own, 'speed_ms'])}, {players})"
    numbers = read(spark, sf_dir, "events").select(F.col("event_id").alias("frame_index")).select("frame_index", *by)
    keys = numbers.columns[1:]
    spread = numbers.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), *keys)  # by number: little is moved, much is made of it
    return spread.groupBy(*keys).agg(F.collect_list("frame_index").alias("frames")).select(*keys, F.expr(f"transform(frames, f -> {frame}) AS frames"))


_TRACK = """
  1 AS session_id, f AS frame_index, p AS player_id, p {div} 11 AS team_id, CASE WHEN f % 997 = 996 THEN 0.0 ELSE CAST(abs((f * 60 + p * 917) % 21000 - 10500) AS DOUBLE) / 100 END AS x,
  CAST((p * 311 + (f {div} 7) * 3) % 6801 AS DOUBLE) / 100 AS y, CAST(((f {div} 50) * (p + 3) * 7) % 100 AS DOUBLE) / 10 AS speed_ms, f % 13 <> 0 AS ball_in_play,
  CASE (f {div} 100) % 3 WHEN 0 THEN 0 WHEN 1 THEN 1 END AS possession_team_id
"""
#: DuckDB common table expression: track.
TRACK = f"track AS (SELECT {_TRACK.format(div='//')} FROM (SELECT event_id AS f, unnest(range(0, 22)) AS p FROM events))"
