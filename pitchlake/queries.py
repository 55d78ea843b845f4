"""The registered queries: each applies one operation to whole tables; most have DuckDB SQL beside them."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import oracles as O
from .functions import scalars as S
from .operators import metrics as M
from .operators import models, windows
from .plans import bridge, config

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with the SQL that a second engine runs."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _scratch(spark, name):
    """A new folder beside the session's checkpoints, or a temporary one in local mode."""
    import tempfile
    import uuid

    root = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a shared folder")
    return f"{root or tempfile.mkdtemp(prefix='spark-')}/{name}-{uuid.uuid4().hex}"


class Tables:
    """The derived tables of a scale, each planned once per query."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir
        self.flat = bridge.events(spark, sf_dir)
        self.events = bridge.details(self.flat)
        self.appearances = bridge.appearances(self.flat)

    def player_match(self) -> DataFrame:
        kept = self.__dict__.get("kept_match")
        return kept if kept is not None else M.player_match_metrics(self.events, self.appearances)

    @cached_property
    def kept_match(self) -> DataFrame:
        """player_match(), written once: for what reads it both by player and by team."""
        return self._kept(self.player_match(), "match")

    def totals(self) -> DataFrame:
        return M.player_season_totals(self.player_match())

    def season(self) -> DataFrame:
        return M.player_season_metrics(self.totals())

    @cached_property
    def kept_season(self) -> DataFrame:
        """season(), written once: for what reads it several times."""
        return self._kept(self.season(), "season")

    def _kept(self, rows: DataFrame, name: str) -> DataFrame:
        path = _scratch(self.spark, name)
        rows.write.parquet(path)
        return self.spark.read.schema(rows.schema).parquet(path)

    def long(self) -> DataFrame:
        return windows.unpivot(self.kept_season, config.METRICS, ["season_id", "player_id", "team_id", "position_group", "minutes", "matches"])

    def pct(self) -> DataFrame:
        return models.percentiles(self.kept_season, config.METRICS)

    def dna(self) -> DataFrame:
        return models.player_dna(self.pct(), config.profile_weights(self.spark), config.profile_relevance(self.spark))

    def roles(self) -> DataFrame:
        return models.rank_roles(models.role_scores(self.pct(), config.roles(self.spark), config.role_requirements(self.spark)))

    def team_match(self) -> DataFrame:
        return M.team_match_metrics(self.player_match())

    def team_season(self) -> DataFrame:
        out = M.team_season_metrics(self.team_match())
        return out.withColumns({c: S.jsround(F.col(c), 6) for c in O.TEAM_METRICS})

    def style(self) -> DataFrame:
        return models.team_style(self.team_season(), config.style_weights(self.spark))

    def fit(self) -> DataFrame:
        self.kept_match  # noqa: B018  players and teams are both made of it
        return models.club_fit(self.dna(), self.style(), config.demand_model(self.spark))

    def vectors(self) -> DataFrame:
        return models.style_vectors(self.pct())


def doubles(df: DataFrame, **alias: str) -> DataFrame:
    """Counts as bigint, so that both engines return the same types."""
    return df.select(*(F.col(c).cast("bigint").alias(c) if t in ("int", "smallint") else F.col(c) for c, t in df.dtypes))


# --- match and season metrics

_PM = ["match_id", "player_id", "team_id", "minutes", *M.COUNTS, *M.SUMS, "pass_accuracy", "xg_per_shot"]


@query(f"{O.PLAYER_MATCH} SELECT {', '.join(_PM)} FROM pmm")
def player_match_metrics(spark, sf_dir):
    return Tables(spark, sf_dir).player_match().select(*_PM)


@query(f"{O.SEASON} SELECT season_id, player_id, team_id, position_group, CAST(minutes AS BIGINT) AS minutes, matches, starts, {', '.join(f'CAST({c} AS BIGINT) AS {c}' for c in M.COUNTS)}, {', '.join(O.rnd(c, 3) + f' AS {c}' for c in M.SUMS)} FROM tot")
def player_season_totals(spark, sf_dir):
    t = Tables(spark, sf_dir).totals()
    return t.select("season_id", "player_id", "team_id", "position_group", "minutes", "matches", "starts", *M.COUNTS, *(S.jsround(F.col(c), 3).alias(c) for c in M.SUMS))


@query(f"{O.SEASON} SELECT season_id, player_id, team_id, position_group, minutes, matches, starts, {', '.join(config.METRICS)}, confidence FROM season")
def player_season_metrics(spark, sf_dir):
    return Tables(spark, sf_dir).season().select("season_id", "player_id", "team_id", "position_group", "minutes", "matches", "starts", *config.METRICS, "confidence")


@query(f"{O.SEASON} SELECT 'PLAYER_SEASON' AS subject_type, player_id || ':' || season_id AS subject_id, minutes, matches, matches AS sample_size, confidence FROM season")
def quality_records(spark, sf_dir):
    return M.quality_records(Tables(spark, sf_dir).season())


_TM = "match_id season_id team_id possession passes pass_accuracy progressive_passes final_third_entries box_entries shots shots_on_target xg goals pressures counterpressures recoveries tackles interceptions crosses field_tilt ppda directness".split()


@query(f"{O.TEAM_MATCH} SELECT {', '.join(_TM)} FROM tm")
def team_match_metrics(spark, sf_dir):
    return Tables(spark, sf_dir).team_match().select(*_TM)


@query(f"{O.TEAM_SEASON} SELECT season_id, team_id, matches, {', '.join(O.TEAM_METRICS)}, confidence FROM tsm")
def team_season_metrics(spark, sf_dir):
    return Tables(spark, sf_dir).team_season().select("season_id", "team_id", "matches", *O.TEAM_METRICS, "confidence")


@query(f"{O.TEAM_MATCH} SELECT a.match_id, a.team_id, o.passes AS opponent_passes FROM tm a LEFT JOIN tm o ON o.match_id = a.match_id AND o.team_id = a.opponent_id")
def opponent_join(spark, sf_dir):
    return M.with_opponent(Tables(spark, sf_dir).team_match(), {"passes": "opponent_passes"}).select("match_id", "team_id", "opponent_passes")


# --- populations

_LONG = ["season_id", "player_id", "position_group", "minutes", "metric_key", "value"]


@query(f"{O.LONG} SELECT {', '.join(_LONG)} FROM long")
def player_per90_long(spark, sf_dir):
    return Tables(spark, sf_dir).long().select(*_LONG)


_VP = ["season_id", "player_id", "position_group", "metric_key", "value", "percentile", "z_score", "population_size"]


@query(f"{O.PERCENTILES.format(minutes=60, order='')} SELECT {', '.join(_VP)} FROM vp")
def player_percentiles(spark, sf_dir):
    return windows.player_percentiles(Tables(spark, sf_dir).long(), min_minutes=60).select(*_VP)


@query(f"{O.PERCENTILES.format(minutes=450, order='')} SELECT {', '.join(_VP)} FROM vp")
def player_percentiles_450(spark, sf_dir):
    return windows.player_percentiles(Tables(spark, sf_dir).long()).select(*_VP)


@query(f"{O.PERCENTILES.format(minutes=60, order='ORDER BY value')} SELECT {', '.join(_VP)} FROM vp")
def player_percentiles_running(spark, sf_dir):
    return windows.player_percentiles(Tables(spark, sf_dir).long(), min_minutes=60, frame="running").select(*_VP)


@query(f"{O.LONG} SELECT season_id, player_id, metric_key, percentile, {O.rnd('100 - percentile', 1)} AS inverted FROM pct")
def percentile_at_or_below(spark, sf_dir):
    return Tables(spark, sf_dir).pct().select("season_id", "player_id", "metric_key", "percentile", S.jsround(100 - F.col("percentile"), 1).alias("inverted"))


@query(f"""{O.LONG}, z1 AS (SELECT season_id, player_id, metric_key, value, position_group, {O.rnd('round(avg(value) OVER w, 9)', 3)} AS mean, count(*) OVER w AS n FROM long WINDOW w AS (PARTITION BY season_id, position_group, metric_key)),
z2 AS (SELECT *, CASE WHEN n < 2 THEN 0 ELSE {O.rnd('round(sqrt(avg((value - mean) * (value - mean)) OVER (PARTITION BY season_id, position_group, metric_key)), 9)', 3)} END AS stddev FROM z1)
SELECT season_id, player_id, metric_key, mean, stddev, CASE WHEN stddev = 0 THEN 0 ELSE {O.rnd('round((value - mean) / stddev, 9)', 3)} END AS z FROM z2""")
def metric_zscores(spark, sf_dir):
    return windows.zscore(Tables(spark, sf_dir).long(), ["season_id", "position_group", "metric_key"]).select("season_id", "player_id", "metric_key", "mean", "stddev", "z")


@query(f"""{O.TEAM_SEASON}, l AS (SELECT * FROM (UNPIVOT (SELECT season_id, team_id, {', '.join(config.CLUB_METRICS)} FROM tsm) ON {', '.join(config.CLUB_METRICS)} INTO NAME metric_key VALUE value))
SELECT season_id, team_id, metric_key, value, {O.rnd('percent_rank() OVER (PARTITION BY season_id, metric_key ORDER BY value) * 100', 1)} AS percentile FROM l QUALIFY count(*) OVER (PARTITION BY season_id, metric_key) >= 2""")
def club_percentiles(spark, sf_dir):
    return windows.club_percentiles(Tables(spark, sf_dir).team_season(), config.CLUB_METRICS)


@query(f"{O.SEASON} SELECT player_id, season_id, minutes FROM season QUALIFY row_number() OVER (PARTITION BY player_id ORDER BY minutes DESC, season_id) = 1")
def best_season_by_player(spark, sf_dir):
    return windows.latest_by(Tables(spark, sf_dir).season(), ["player_id"], [F.desc("minutes"), "season_id"]).select("player_id", "season_id", "minutes")


@query(f"""{O.TEAM_MATCH} SELECT tm.team_id, tm.match_id, row_number() OVER (PARTITION BY tm.team_id ORDER BY kickoff_at, tm.match_id) AS n, CASE WHEN tm.team_id = home_team_id THEN 'vs ' || a.team_name ELSE 'at ' || h.team_name END AS label, xg, possession, crosses, directness
FROM tm JOIN matches USING (match_id) LEFT JOIN teams h ON h.team_id = home_team_id LEFT JOIN teams a ON a.team_id = away_team_id""")
def team_trend(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return doubles(windows.team_trend(t.team_match(), bridge.matches(t.flat), bridge.teams(spark, sf_dir)))


@query(f"{O.PERCENTILES.format(minutes=60, order='')} SELECT player_id, season_id, position_group, value, percentile FROM vp WHERE metric_key = 'progressive_passes_p90' QUALIFY row_number() OVER (PARTITION BY season_id, position_group ORDER BY percentile DESC, player_id) <= 10")
def progressive_passers(spark, sf_dir):
    """The ten best progressive passers of each season and position."""
    long = Tables(spark, sf_dir).long().where("metric_key = 'progressive_passes_p90'")
    ranked = windows.player_percentiles(long, min_minutes=60)
    n = F.row_number().over(windows.Window.partitionBy("season_id", "position_group").orderBy(F.desc("percentile"), "player_id"))
    return ranked.withColumn("n", n).where("n <= 10").select("player_id", "season_id", "position_group", "value", "percentile")


# --- models


@query(f"{O.LONG} SELECT season_id, player_id, metric_key, percentile FROM pct")
def style_vectors(spark, sf_dir):
    return Tables(spark, sf_dir).vectors().select("season_id", "player_id", F.explode("vector").alias("metric_key", "percentile"))


@query(f"{O.PROFILES} SELECT season_id, player_id, category, score, coverage FROM dna")
def player_dna(spark, sf_dir):
    return Tables(spark, sf_dir).dna().select("season_id", "player_id", "category", "score", "coverage")


@query(f"{O.ROLE_SCORES} SELECT season_id, player_id, role_key, score, coverage FROM roles")
def role_scores(spark, sf_dir):
    return Tables(spark, sf_dir).roles().select("season_id", "player_id", "role_key", "score", "coverage")


@query(f"{O.ROLE_SCORES} SELECT season_id, player_id, role_key, CAST(rank AS BIGINT) AS rank, is_primary, confidence, margin_confidence FROM roles")
def rank_roles(spark, sf_dir):
    return doubles(Tables(spark, sf_dir).roles().select("season_id", "player_id", "role_key", "rank", "is_primary", "confidence", "margin_confidence"))


_DRAFT = [("progressive_passes_p90", 0.4), ("pass_accuracy", 0.3), ("xa_p90", 0.3)]


@query(f"""{O.SEASON}, pool AS (SELECT player_id, metric_key, {O.rnd('cume_dist() OVER (PARTITION BY metric_key ORDER BY value) * 100', 1)} AS p FROM (UNPIVOT (SELECT player_id, {', '.join(m for m, _ in _DRAFT)} FROM season WHERE season_id = 1 AND position_group = 'MF' AND minutes >= 60) ON {', '.join(m for m, _ in _DRAFT)} INTO NAME metric_key VALUE value)),
w AS (SELECT * FROM (VALUES {O.values(_DRAFT)}) t(metric_key, weight)), s AS (SELECT player_id, {O.rnd('sum(CAST(floor(p * 10 + 0.5) AS BIGINT) * CAST(weight * 100 AS BIGINT)) / 1000.0 / (sum(CAST(weight * 100 AS BIGINT)) / 100.0)', 1)} AS score FROM pool JOIN w USING (metric_key) GROUP BY player_id)
SELECT s.player_id, score FROM s JOIN players p USING (player_id) WHERE height_cm >= 175 ORDER BY score DESC, s.player_id LIMIT 20""")
def match_role(spark, sf_dir):
    t = Tables(spark, sf_dir)
    draft = spark.createDataFrame([(m, w, "HIGHER_BETTER", None) for m, w in _DRAFT], "metric_key string, weight double, direction string, min_percentile double")
    return models.match_role(t.season(), bridge.players(spark, sf_dir), draft, 1, "MF", 60, 20, F.col("height_cm") >= 175).select("player_id", "score")


_COS = """dot AS (SELECT a.{k} AS s, b.{k} AS c, {g} sum((a.{v} - 50) * (b.{v} - 50)) AS d, sum((a.{v} - 50) * (a.{v} - 50)) AS x, sum((b.{v} - 50) * (b.{v} - 50)) AS y FROM {t} a JOIN {t} b ON a.{k} <> b.{k} AND {on} GROUP BY ALL),
sim AS (SELECT *, """ + O.rnd("greatest(0, least(1, (CASE WHEN sqrt(x) * sqrt(y) = 0 THEN 1 ELSE d / (sqrt(x) * sqrt(y)) END + 1) / 2))", 4) + """ AS similarity FROM dot)"""


@query(f"""{O.LONG}, {_COS.format(k='player_id', v='percentile', t='pct', g='a.season_id,', on='a.season_id = b.season_id AND a.position_group = b.position_group AND a.metric_key = b.metric_key')}
SELECT season_id, s AS player_id, c AS comparison_player_id, similarity FROM sim QUALIFY row_number() OVER (PARTITION BY season_id, s ORDER BY similarity DESC, c) <= 10""")
def similar_players(spark, sf_dir):
    found = models.similar_players(Tables(spark, sf_dir).vectors(), config.METRICS)
    return found.select("season_id", "player_id", "comparison_player_id", "similarity")


@query("""WITH v AS (SELECT vec_id, CAST(label AS VARCHAR) AS label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
s AS (SELECT a.label AS position_group, a.vec_id AS player_id, b.vec_id AS comparison_player_id, """ + O.rnd("greatest(0, least(1, (list_cosine_similarity(a.e, b.e) + 1) / 2))", 4) + """ AS similarity FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id)
SELECT position_group, player_id, comparison_player_id, row_number() OVER (PARTITION BY position_group, player_id ORDER BY similarity DESC, comparison_player_id) AS rank, similarity FROM s QUALIFY rank <= 10""")
def similar_vectors(spark, sf_dir):
    """The ten most similar of each vector of the embeddings table within its label."""
    e = bridge.read(spark, sf_dir, "embeddings")
    keys = [f"k{i:02d}" for i in range(64)]
    vector = F.map_from_arrays(F.array(*map(F.lit, keys)), F.transform("embedding", lambda x: 50 + 50 * x.cast("double")))
    frame = e.select(F.lit(1).alias("season_id"), F.col("label").cast("string").alias("position_group"), F.col("vec_id").alias("player_id"), vector.alias("vector"))
    return doubles(models.similar_players(frame, keys).select("position_group", "player_id", "comparison_player_id", "rank", "similarity"))


@query(f"{O.STYLES} SELECT season_id, team_id, dimension, score, measured FROM style")
def team_style(spark, sf_dir):
    return Tables(spark, sf_dir).style().select("season_id", "team_id", "dimension", "score", "measured")


@query(f"{O.FIT} SELECT p.season_id, p.player_id, t.team_id, coalesce(fit_score, 0) AS fit_score FROM (SELECT DISTINCT season_id, player_id FROM dna) p JOIN (SELECT DISTINCT season_id, team_id FROM style) t ON t.season_id = p.season_id LEFT JOIN fit f ON f.season_id = p.season_id AND f.player_id = p.player_id AND f.team_id = t.team_id")
def club_fit(spark, sf_dir):
    return Tables(spark, sf_dir).fit().select("season_id", "player_id", "team_id", "fit_score")


# --- scalar functions over all events

from .operators import clusters, spatial, tracking, views  # noqa: E402

_XY = "x", "y", "end_x", "end_y"


def _events(spark, sf_dir):
    return bridge.events(spark, sf_dir)


@query(f"""{bridge.PRELUDE}, s AS (SELECT event_id, x / 105 * 120 AS sx, 80 - y / 68 * 80 AS sy FROM ev)
SELECT event_id, {O.rnd('least(greatest(sx / 120 * 105, 0), 105)', 2)} AS cx, {O.rnd('least(greatest(68 - sy / 80 * 68, 0), 68)', 2)} AS cy, {O.rnd('least(greatest(105 - sx / 120 * 105, 0), 105)', 2)} AS fx, {O.rnd('least(greatest(68 - (68 - sy / 80 * 68), 0), 68)', 2)} AS fy FROM s""")
def to_canonical(spark, sf_dir):
    e = _events(spark, sf_dir).select("event_id", (F.col("x") / 105 * 120).alias("sx"), (80 - F.col("y") / 68 * 80).alias("sy"))
    (cx, cy), (fx, fy) = S.to_canonical(F.col("sx"), F.col("sy"), "STATSBOMB_120_80"), S.to_canonical(F.col("sx"), F.col("sy"), "STATSBOMB_120_80", flip=True)
    return e.select("event_id", cx.alias("cx"), cy.alias("cy"), fx.alias("fx"), fy.alias("fy"))


@query(f"{bridge.PRELUDE} SELECT event_id, {O.rnd('x / 105 * 1', 4)} AS px, {O.rnd('1 - y / 68 * 1', 4)} AS py FROM ev")
def from_canonical(spark, sf_dir):
    px, py = S.from_canonical(F.col("x"), F.col("y"), "METRICA_0_1")
    return _events(spark, sf_dir).select("event_id", px.alias("px"), py.alias("py"))


@query(f"""{bridge.PRELUDE}, g AS (SELECT *, {O.dist('x', 'y', '105', '30.34')} AS a, {O.dist('x', 'y', '105', '37.66')} AS b FROM ev)
SELECT event_id, {O.dist('x', 'y', 'end_x', 'end_y')} AS distance, {O.rnd('atan2(end_y - y, end_x - x)', 4)} AS angle, {O.goal('x', 'y')} AS to_goal,
CASE WHEN a = 0 OR b = 0 THEN 0 ELSE {O.rnd('acos(least(greatest((a * a + b * b - 7.32 * 7.32) / (2 * a * b), -1), 1)) * 180 / pi()', 2)} END AS goal_angle FROM g""")
def distances_and_angles(spark, sf_dir):
    c = [F.col(x) for x in _XY]
    return _events(spark, sf_dir).select("event_id", S.distance(*c).alias("distance"), S.angle(*c).alias("angle"), S.distance_to_goal(*c[:2]).alias("to_goal"), S.goal_angle_deg(*c[:2]).alias("goal_angle"))


@query(f"{bridge.PRELUDE} SELECT event_id, x >= 70 AS final_third, {O.box('x', 'y')} AS box, x <= 16.5 AND y >= 13.84 AND y <= 54.16 AS own_box FROM ev")
def zone_predicates(spark, sf_dir):
    x, y = F.col("x"), F.col("y")
    return _events(spark, sf_dir).select("event_id", S.in_final_third(x).alias("final_third"), S.in_box(x, y).alias("box"), S.in_own_box(x, y).alias("own_box"))


@query(f"{bridge.PRELUDE} SELECT event_id, {O.prog('x', 'y', 'end_x', 'end_y')} AS progressive, {O.rnd(f'greatest(0, {O.goal('x', 'y')} - {O.goal('end_x', 'end_y')})', 2)} AS gain FROM ev")
def progressive_actions(spark, sf_dir):
    c = [F.col(x) for x in _XY]
    return _events(spark, sf_dir).select("event_id", S.is_progressive(*c).alias("progressive"), S.progressive_distance(*c).alias("gain"))


@query(f"{bridge.PRELUDE} SELECT event_id, {O.rnd('xa', 2)} AS two, {O.rnd('-xg', 1)} AS one, {O.rnd('x * y')} AS none FROM ev")
def round_half_up(spark, sf_dir):
    return _events(spark, sf_dir).select("event_id", S.jsround(F.col("xa"), 2).alias("two"), S.jsround(-F.col("xg"), 1).alias("one"), S.jsround(F.col("x") * F.col("y")).alias("none"))


_EST = O.rnd(f"least(0.95, greatest(0.01, exp(-0.11 * {O.goal('x', 'y')}) * CASE WHEN event_id % 4 = 0 THEN 0.55 ELSE 1 END))", 3)


@query(f"{bridge.PRELUDE} SELECT event_id, CASE WHEN is_penalty THEN 0.76 ELSE {_EST} END AS estimate, CASE WHEN event_id % 2 = 0 THEN xg WHEN is_penalty THEN 0.76 ELSE {_EST} END AS resolved FROM ev")
def expected_goals(spark, sf_dir):
    x, y, header, penalty = F.col("x"), F.col("y"), F.col("event_id") % 4 == 0, F.col("is_penalty")
    return _events(spark, sf_dir).select("event_id", S.estimate_xg(x, y, header, penalty).alias("estimate"), S.resolve_xg(F.when(F.col("event_id") % 2 == 0, F.col("xg")), x, y, header, penalty).alias("resolved"))


_VOCAB = list(S.EVENT_TYPES["120x80"].items())


@query(f"{bridge.PRELUDE}, v AS (SELECT *, row_number() OVER () - 1 AS i FROM (VALUES {O.values(_VOCAB)}) t(raw, canon)) SELECT event_id, coalesce(canon, 'OTHER') AS type, CASE WHEN foot IN ('LEFT', 'RIGHT') THEN foot ELSE 'UNKNOWN' END AS foot FROM ev JOIN players USING (player_id) LEFT JOIN v ON i = event_id % {len(_VOCAB) + 1}")
def event_vocabulary(spark, sf_dir):
    raw = F.get(F.array(*(F.lit(k) for k, _ in _VOCAB), F.lit("Unknown type")), (F.col("event_id") % (len(_VOCAB) + 1)).cast("int"))
    rows = _events(spark, sf_dir).join(bridge.players(spark, sf_dir).select("player_id", "foot"), "player_id")
    return rows.select("event_id", S.map_event_type(raw, "120x80").alias("type"), S.coerce_enum(F.lower("foot"), ["LEFT", "RIGHT"], "UNKNOWN").alias("foot"))


_TEXTS = [("Goal keeper", "GK"), ("Left Back", "DF"), ("RCM", "MF"), ("Centre forward", "FW"), ("LWX", "FW"), ("CBX", "DF"), ("Sweeper", "MF"), ("GK1", "GK"), ("second striker", "FW"), ("AM/LW", "MF")]


@query(f"{bridge.PRELUDE} SELECT player_id, CASE player_id % {len(_TEXTS)} {' '.join(f'WHEN {i} THEN {g!r}' for i, (_, g) in enumerate(_TEXTS))} END AS position_group FROM players")
def position_groups(spark, sf_dir):
    text = F.get(F.array(*(F.lit(t) for t, _ in _TEXTS)), (F.col("player_id") % len(_TEXTS)).cast("int"))
    return bridge.players(spark, sf_dir).select("player_id", S.position_group(text).alias("position_group"))


@query("SELECT event_id, CAST((event_id % 3) * 3600000 + (event_id % 60) * 60000 + (event_id % 59) * 1000 + event_id % 1000 AS BIGINT) AS ms, CAST((event_id % 3) * 3600000 + (event_id % 60) * 60000 + (event_id % 59) * 1000 AS BIGINT) AS rounded, CAST(ts AS DATE) AS day FROM events")
def clocks_and_dates(spark, sf_dir):
    e = bridge.read(spark, sf_dir, "events")
    part = lambda m, n: F.lpad((F.col("event_id") % m).cast("string"), n, "0")
    hms = F.concat_ws(":", part(3, 2), part(60, 2), part(59, 2))
    return e.select("event_id", S.clock_ms(F.concat(hms, F.lit("."), part(1000, 3))).alias("ms"), S.clock_ms(hms, "seconds").alias("rounded"), S.parse_date(F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).alias("day"))


@query(f"{bridge.PRELUDE} SELECT match_id, player_id, CAST(greatest(0, CASE WHEN is_starter THEN 90 ELSE minutes END - player_id % 40) AS BIGINT) AS minutes FROM app")
def minutes_from_spells(spark, sf_dir):
    a = Tables(spark, sf_dir).appearances
    clock = lambda m: F.concat(F.lpad(F.floor(m / 60).cast("string"), 2, "0"), F.lit(":"), F.lpad((m % 60).cast("string"), 2, "0"))
    spells = F.array(F.struct(clock(F.col("player_id") % 40).alias("from"), F.lit("00:45").alias("to")), F.struct(F.lit("00:45").alias("from"), F.when(~F.col("is_starter"), clock(F.col("minutes"))).alias("to")))
    return a.select("match_id", "player_id", S.minutes_from_spells(spells).cast("bigint").alias("minutes"))


_COL3, _ROW5, _COL5, _ROW4 = (f"CAST(least({n - 1}, floor({c} / {size} * {n})) AS BIGINT)" for c, size, n in (("x", 105, 3), ("y", 68, 5), ("x", 105, 5), ("y", 68, 4)))
_KEY3 = f"(['Defensive', 'Middle', 'Attacking'])[{_COL3} + 1] || '/' || (['Left', 'Left half-space', 'Centre', 'Right half-space', 'Right'])[{_ROW5} + 1]"


@query(f"{bridge.PRELUDE} SELECT event_id, {_KEY3} AS third, {_ROW5} AS lane, 'C' || ({_COL5} + 1) || 'R' || ({_ROW4} + 1) AS cell FROM ev")
def zone_of_point(spark, sf_dir):
    a, b = S.zone_of(F.col("x"), F.col("y")), S.zone_of(F.col("x"), F.col("y"), "GRID_5X4")
    return _events(spark, sf_dir).select("event_id", a["key"].alias("third"), a["row"].cast("bigint").alias("lane"), b["key"].alias("cell"))


_KIND = "CASE WHEN type = 'PASS' THEN 'passes' WHEN type IN ('CARRY', 'DRIBBLE') THEN 'carries' WHEN type = 'SHOT' THEN 'shots' WHEN type = 'PRESSURE' THEN 'pressures' WHEN type IN ('TACKLE', 'INTERCEPTION', 'BLOCK', 'CLEARANCE', 'RECOVERY') THEN 'defensive_actions' ELSE 'touches' END"
_types = lambda kind: ", ".join(repr(t) for t in config.HEATMAPS[kind][0])


@query(bridge.PRELUDE + " UNION ALL ".join(f" SELECT '{k}' AS heatmap, event_id, {'end_x' if end else 'x'} AS x, {'end_y' if end else 'y'} AS y, CAST({'greatest(0.05, xg)' if k == 'SHOT' else '1'} AS DOUBLE) AS weight FROM ev WHERE type IN ({_types(k)})" for k, (_, end) in config.HEATMAPS.items()))
def heatmap_points(spark, sf_dir):
    events = Tables(spark, sf_dir).events
    parts = [spatial.heatmap_points(events, k, ["event_id"]).select(F.lit(k).alias("heatmap"), "event_id", "x", "y", "weight") for k in config.HEATMAPS]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query(f"{bridge.PRELUDE} SELECT event_id, minute FROM ev WHERE period = 2 AND minute BETWEEN 50 AND 80 AND team_id = 3 AND type IN ('PASS', 'SHOT') AND possession_team_id <> team_id")
def filter_events(spark, sf_dir):
    found = spatial.filter_events(_events(spark, sf_dir), half=2, minutes=(50, 80), team_id=3, types=["PASS", "SHOT"], possession="OUT")
    return doubles(found.select("event_id", "minute"))


@query(f"{O.SEASON} SELECT player_id, season_id, {O._band('minutes', 'matches', '0')} AS without_flags, confidence, CASE WHEN confidence = 'INSUFFICIENT' THEN 'Insufficient data' ELSE 'Confidence: ' || confidence[1] || lower(confidence[2:]) END || ' - ' || minutes || ' minutes across ' || matches || CASE WHEN matches = 1 THEN ' match' ELSE ' matches' END AS summary FROM season")
def confidence_bands(spark, sf_dir):
    t = Tables(spark, sf_dir).totals()
    cover = sum((F.col(f"available.{k}").cast("int") for k in M.FAMILIES), F.lit(0)) / len(M.FAMILIES)
    own, none = S.assess_quality(F.col("minutes"), F.col("matches"), cover), S.assess_quality(F.col("minutes"), F.col("matches"), 0.0)
    return t.select("player_id", "season_id", none["confidence"].alias("without_flags"), own["confidence"].alias("confidence"), own["summary"].alias("summary"))


@query(f"{bridge.PRELUDE} SELECT player_id, CAST(date_diff('year', birth_date, DATE '2024-01-31') - CASE WHEN strftime(DATE '2024-01-31', '%m%d') < strftime(birth_date, '%m%d') THEN 1 ELSE 0 END AS BIGINT) AS age, CAST(floor(date_diff('day', birth_date, DATE '2024-01-31') / 365.25) AS BIGINT) AS approximate FROM players")
def ages(spark, sf_dir):
    at, birth = F.lit("2024-01-31").cast("date"), F.col("birth_date")
    return doubles(bridge.players(spark, sf_dir).select("player_id", S.age_years(birth, at).alias("age"), S.age_approx(birth, at).alias("approximate")))


_LABEL = "regexp_replace(metric_key, '_?p90$', ' per 90')"
_LABEL = f"array_to_string(list_transform(string_split(lower(replace({_LABEL}, '_', ' ')), ' '), lambda w: upper(w[1]) || w[2:]), ' ')"


@query(f"{O.LONG} SELECT DISTINCT metric_key, {_LABEL} AS label FROM long")
def metric_names(spark, sf_dir):
    return Tables(spark, sf_dir).long().select("metric_key", S.humanise(F.col("metric_key")).alias("label")).distinct()


@query(f"{O.SEASON} SELECT player_id, season_id, {O.rnd('CAST(tackles AS DOUBLE) / minutes * 90', 3)} AS tackles_p90, CASE WHEN touches > 0 THEN {O.rnd('CAST(passes AS DOUBLE) / touches * 100', 3)} ELSE 0 END AS passes_per_100 FROM tot")
def rates(spark, sf_dir):
    return Tables(spark, sf_dir).totals().select("player_id", "season_id", S.per90(F.col("tackles"), F.col("minutes")).alias("tackles_p90"), S.per_possession(F.col("passes"), F.col("touches")).alias("passes_per_100"))


# --- zones, heatmaps, networks

_ZCOUNT = ", ".join(f"count(*) FILTER (WHERE kind = '{k}') AS {k}" for k in spatial.KINDS)
_ZONES = f"""{bridge.PRELUDE}, z AS (SELECT player_id, match_id, {_KEY3} AS zone_key, {_ROW5} AS zone_row, {_COL3} AS zone_col, {_KIND} AS kind, duration_sec FROM ev),
za AS (SELECT player_id, match_id, zone_key, zone_row, zone_col, {_ZCOUNT}, {O.rnd('sum(duration_sec)', 1)} AS possession_time_sec FROM z GROUP BY ALL)"""


@query(f"{_ZONES} SELECT player_id, match_id, zone_key, {', '.join(spatial.KINDS)}, possession_time_sec FROM za")
def zone_activity(spark, sf_dir):
    z = spatial.zone_activity(_events(spark, sf_dir), ["player_id", "match_id"])
    return z.select("player_id", "match_id", "zone_key", *spatial.KINDS, S.jsround(F.col("possession_time_sec"), 1).alias("possession_time_sec"))


@query(f"{_ZONES} SELECT player_id, zone_key, count(DISTINCT match_id) AS matches, {', '.join(f'CAST(sum({k}) AS BIGINT) AS {k}' for k in spatial.KINDS)} FROM za GROUP BY player_id, zone_key")
def zone_rollup(spark, sf_dir):
    z = spatial.zone_rollup(spatial.zone_activity(_events(spark, sf_dir), ["player_id", "match_id"]), ["player_id"])
    return z.select("player_id", "zone_key", "matches", *spatial.KINDS)


def _heat(subject: str, source: str, cols: int, rows: int, cells: str, x: str) -> str:
    """SQL of a complete grid from cells(subject, col, row, value, count)."""
    return f"""{source}, cells AS ({cells}), peak AS (SELECT {subject}, max(value) AS peak, CAST(sum(n) AS BIGINT) AS sample_size FROM cells GROUP BY {subject}),
grid AS (SELECT {subject}, peak, sample_size, c.i AS col, r.i AS row FROM peak, (SELECT CAST(unnest(range(0, {cols})) AS BIGINT) AS i) c, (SELECT CAST(unnest(range(0, {rows})) AS BIGINT) AS i) r)
SELECT g.{subject}, g.col, g.row, {x} AS x, {O.rnd(f'CAST(68 AS DOUBLE) / {rows} * (g.row + 0.5)', 2)} AS y, CASE WHEN peak > 0 THEN {O.rnd('coalesce(value, 0) / peak', 4)} ELSE 0 END AS value, coalesce(n, 0) AS count, sample_size
FROM grid g LEFT JOIN cells k ON k.{subject} = g.{subject} AND k.col = g.col AND k.row = g.row"""


def _shown(df: DataFrame, subject: str) -> DataFrame:
    return doubles(df.select(subject, "col", "row", "x", "y", "value", "count", "sample_size"))


_C24, _R16 = "CAST(least(23, floor(x / 105 * 24)) AS BIGINT)", "CAST(least(15, floor(y / 68 * 16)) AS BIGINT)"
_PTS = f"{bridge.PRELUDE}, pts AS (SELECT team_id, x, y, CAST(1 AS DOUBLE) AS weight FROM ev WHERE type IN ({_types('TOUCH')}))"
_SX = O.rnd("CAST(105 AS DOUBLE) / 24 * (g.col + 0.5)", 2)


def _touches(spark, sf_dir):
    return spatial.heatmap_points(Tables(spark, sf_dir).events, "TOUCH", ["team_id"])


@query(_heat("team_id", _PTS, 24, 16, f"SELECT team_id, {_C24} AS col, {_R16} AS row, sum(weight) AS value, count(*) AS n FROM pts GROUP BY ALL", _SX))
def heatmap_grid(spark, sf_dir):
    return _shown(spatial.heatmap_grid(_touches(spark, sf_dir), ["team_id"]), "team_id")


_HEX = "CAST(greatest(0, least(23, floor((x - CASE WHEN row % 2 = 1 THEN CAST(105 AS DOUBLE) / 24 / 2 ELSE 0 END) / (CAST(105 AS DOUBLE) / 24) + 0.5))) AS BIGINT)"


@query(_heat("team_id", _PTS, 24, 16, f"SELECT team_id, {_HEX} AS col, row, sum(weight) AS value, count(*) AS n FROM (SELECT *, {_R16} AS row FROM pts) GROUP BY ALL", O.rnd("least(105, CAST(105 AS DOUBLE) / 24 * g.col + CASE WHEN g.row % 2 = 1 THEN CAST(105 AS DOUBLE) / 24 / 2 ELSE 0 END + CAST(105 AS DOUBLE) / 24 / 2)", 2)))
def heatmap_hexbin(spark, sf_dir):
    return _shown(spatial.heatmap_hexbin(_touches(spark, sf_dir), ["team_id"]), "team_id")


_KX, _KY = O.rnd("CAST(105 AS DOUBLE) / 24 * (c + 0.5)", 2), O.rnd("CAST(68 AS DOUBLE) / 16 * (r + 0.5)", 2)
_AROUND = "pts, (SELECT unnest(range(0, 24)) AS c) cs, (SELECT unnest(range(0, 16)) AS r) rs"


@query(_heat("team_id", _PTS, 24, 16, f"SELECT team_id, c AS col, r AS row, sum(CASE WHEN abs(c - {_C24}) <= 5 AND abs(r - {_R16}) <= 5 AND pow({_KX} - x, 2) + pow({_KY} - y, 2) <= 324 THEN weight * exp(-(pow({_KX} - x, 2) + pow({_KY} - y, 2)) / 72) ELSE 0 END) AS value, count(*) FILTER (WHERE c = {_C24} AND r = {_R16}) AS n FROM {_AROUND} GROUP BY ALL", _SX))
def heatmap_kde(spark, sf_dir):
    return _shown(spatial.heatmap_kde(_touches(spark, sf_dir), ["team_id"]), "team_id")


_UX, _UY = "(CAST(105 AS DOUBLE) / 24 * (c + 0.5))", "(CAST(68 AS DOUBLE) / 16 * (r + 0.5))"
_SHOTS = f"{bridge.PRELUDE}, pts AS (SELECT team_id, x, y, {{weight}} AS weight FROM ev WHERE type = 'SHOT')"
_HERE = f"count(*) FILTER (WHERE c = {_C24} AND r = {_R16}) AS n"


@query(_heat("team_id", _SHOTS.format(weight="CAST(1 AS DOUBLE)"), 24, 16, f"SELECT team_id, c AS col, r AS row, sum(weight * exp(-(pow({_UX} - x, 2) + pow({_UY} - y, 2)) / 72)) AS value, {_HERE} FROM {_AROUND} GROUP BY ALL", _SX))
def heatmap_kde_full(spark, sf_dir):
    shots = spatial.heatmap_points(Tables(spark, sf_dir).events, "SHOT", ["team_id"]).withColumn("weight", F.lit(1.0))
    return _shown(spatial.heatmap_kde_full(shots, ["team_id"]), "team_id")


# every shot of an even event twice, so that points repeat
_TWICE = _SHOTS.format(weight="greatest(0.05, xg)").replace("WHERE type = 'SHOT')", "WHERE type = 'SHOT' UNION ALL SELECT team_id, x, y, greatest(0.05, xg) FROM ev WHERE type = 'SHOT' AND event_id % 2 = 0)")
_SHAPE = """, m AS (SELECT team_id AS t, sum(weight * x) / sum(weight) AS mx, sum(weight * y) / sum(weight) AS my, sum(weight) - sum(weight * weight) / sum(weight) AS norm, stddev_pop(x) AS sd, count(DISTINCT (round(x, 3), round(y, 3))) AS d FROM pts GROUP BY team_id),
cv AS (SELECT t, sum(weight * (x - mx) * (x - mx)) / any_value(norm) AS cxx, sum(weight * (x - mx) * (y - my)) / any_value(norm) AS cxy, sum(weight * (y - my) * (y - my)) / any_value(norm) AS cyy, any_value(sd) AS sd, any_value(d) AS d FROM pts JOIN m ON t = team_id GROUP BY t),
dt AS (SELECT *, (cxx * cyy - cxy * cxy) * pow(CAST(6 AS DOUBLE) / greatest(CASE WHEN sd = 0 THEN 1 ELSE sd END, 1e-6) / 10, 2) AS det FROM cv),
kn AS (SELECT t, CASE WHEN d >= 3 AND det > 1e-12 THEN cyy / det ELSE 1.0 / 36 END AS kxx, CASE WHEN d >= 3 AND det > 1e-12 THEN -cxy / det ELSE 0 END AS kxy, CASE WHEN d >= 3 AND det > 1e-12 THEN cxx / det ELSE 1.0 / 36 END AS kyy FROM dt)"""
_Q = f"(kxx * pow({_UX} - x, 2) + 2 * kxy * ({_UX} - x) * ({_UY} - y) + kyy * pow({_UY} - y, 2))"


@query(_heat("team_id", _TWICE + _SHAPE, 24, 16, f"SELECT team_id, c AS col, r AS row, sum(weight * exp(-{_Q} / 2)) AS value, {_HERE} FROM {_AROUND.replace('pts,', 'pts JOIN kn ON t = team_id,')} GROUP BY ALL", _SX))
def heatmap_kde_covariance(spark, sf_dir):
    e = Tables(spark, sf_dir).events
    shots = spatial.heatmap_points(e.unionByName(e.where("event_id % 2 = 0")), "SHOT", ["team_id"])
    return _shown(spatial.heatmap_kde_full(shots, ["team_id"], method="covariance"), "team_id")


@query(f"""{_heat('l_suppkey', "WITH pts AS (SELECT l_suppkey, CAST((l_partkey * 7919 + l_orderkey * 31) % 10501 AS DOUBLE) / 100 AS x, CAST((l_partkey * 6151 + l_orderkey * 17) % 6801 AS DOUBLE) / 100 AS y, l_discount AS weight FROM lineitem)", 24, 16, f"SELECT l_suppkey, {_C24} AS col, {_R16} AS row, CAST(sum(CAST(floor(weight * 100 + 0.5) AS BIGINT)) AS DOUBLE) AS value, count(*) AS n FROM pts GROUP BY ALL", _SX)}""")
def heatmap_grid_large(spark, sf_dir):
    """A grid for each supplier over all line items: the large spatial load."""
    li = bridge.read(spark, sf_dir, "lineitem").selectExpr("l_suppkey", "CAST((l_partkey * 7919 + l_orderkey * 31) % 10501 AS DOUBLE) / 100 AS x", "CAST((l_partkey * 6151 + l_orderkey * 17) % 6801 AS DOUBLE) / 100 AS y", "CAST(floor(l_discount * 100 + 0.5) AS BIGINT) AS weight")
    return _shown(spatial.heatmap_grid(li, ["l_suppkey"]), "l_suppkey")


def _net(where: str) -> str:
    return f"""{bridge.PRELUDE}, p AS (SELECT *, CASE WHEN pass_completed AND recipient_id <> player_id THEN recipient_id END AS to_id FROM ev WHERE type = 'PASS' {where}),
ends AS (SELECT match_id, team_id, player_id, x, y, minute, 1 AS given FROM p UNION ALL SELECT match_id, team_id, to_id, end_x, end_y, minute, 0 FROM p WHERE to_id IS NOT NULL)"""


@query(f"{_net('')} SELECT match_id, team_id, player_id, {O.rnd('avg(x)', 6)} AS x, {O.rnd('avg(y)', 6)} AS y, CAST(sum(given) AS BIGINT) AS passes, CAST(sum(1 - given) AS BIGINT) AS received, CAST(min(minute) AS BIGINT) AS first_minute, CAST(max(minute) AS BIGINT) AS last_minute FROM ends GROUP BY match_id, team_id, player_id")
def passing_network_nodes(spark, sf_dir):
    nodes, _, _ = spatial.passing_network(Tables(spark, sf_dir).events)
    return doubles(nodes.withColumns({c: S.jsround(F.col(c), 6) for c in "xy"}))


_OPEN = "AND possession_team_id = team_id AND (play_pattern IS NULL OR play_pattern NOT IN ('From Corner', 'From Throw In', 'From Free Kick'))"


@query(f"{_net(_OPEN)} SELECT match_id, team_id, player_id AS from_id, to_id, count(*) AS passes FROM p WHERE to_id IS NOT NULL GROUP BY ALL HAVING count(*) >= 1")
def passing_network_edges(spark, sf_dir):
    return spatial.passing_network(Tables(spark, sf_dir).events, possession_only=True, min_passes=1)[1]


@query(f"{_net('AND period = 2')} SELECT match_id, team_id, count(*) AS total_passes, count(*) FILTER (WHERE pass_completed) AS completed_passes, count(to_id) AS linked_passes FROM p GROUP BY match_id, team_id")
def passing_network_totals(spark, sf_dir):
    return spatial.passing_network(Tables(spark, sf_dir).events, period="second")[2]


# --- tracking

_T = f"WITH {bridge.TRACK}"


@query(f"""{_T}, s AS (SELECT *, sqrt((x - lag(x) OVER w) * (x - lag(x) OVER w) + (y - lag(y) OVER w) * (y - lag(y) OVER w)) AS step FROM track WINDOW w AS (PARTITION BY player_id ORDER BY frame_index)),
v AS (SELECT *, CASE WHEN step <= 1.2 THEN speed_ms END AS speed, CASE WHEN step <= 1.2 THEN step END AS moved FROM s),
f AS (SELECT *, last_value(CASE WHEN speed IS NOT NULL THEN speed >= 7.0 END IGNORE NULLS) OVER (PARTITION BY player_id ORDER BY frame_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM v)
SELECT player_id, count(*) AS frames, {O.rnd('avg(x)', 2)} AS avg_x, {O.rnd(O.rnd('coalesce(sum(moved), 0)', 2), 1)} AS distance_m, {O.rnd(O.rnd('coalesce(sum(moved) FILTER (WHERE speed >= 5.5), 0)', 2), 1)} AS high_speed_distance_m, count(*) FILTER (WHERE speed >= 7.0 AND NOT coalesce(before, false)) AS sprint_count, {O.rnd('coalesce(max(speed), 0)', 2)} AS max_speed_ms FROM f GROUP BY player_id""")
def player_physical(spark, sf_dir):
    out = tracking.player_physical(bridge.tracking(spark, sf_dir))
    return doubles(out.select("player_id", "frames", "avg_x", S.jsround(F.col("distance_m"), 1).alias("distance_m"), S.jsround(F.col("high_speed_distance_m"), 1).alias("high_speed_distance_m"), "sprint_count", "max_speed_ms"))


@query(f"""{_T}, fr AS (SELECT frame_index, team_id, any_value(possession_team_id) AS owner, avg(x) AS cx, max(y) - min(y) AS width, max(x) - min(x) AS depth, min(x) AS lo, max(x) AS hi FROM track WHERE ball_in_play GROUP BY frame_index, team_id HAVING count(*) >= 3),
ph AS (SELECT *, 'ALL' AS phase FROM fr UNION ALL SELECT *, CASE WHEN owner = team_id THEN 'IN_POSSESSION' ELSE 'OUT_OF_POSSESSION' END FROM fr WHERE owner IS NOT NULL)
SELECT CAST(team_id AS BIGINT) AS team_id, phase, count(*) AS frames, {O.rnd('avg(cx)', 2)} AS centroid_x, {O.rnd('avg(width)', 2)} AS team_width_m, {O.rnd('avg(depth)', 2)} AS team_depth_m, {O.rnd('avg(lo)', 2)} AS defensive_line_m, {O.rnd(O.rnd('avg(hi)', 2) + ' - ' + O.rnd('avg(lo)', 2), 2)} AS line_distance_m FROM ph GROUP BY team_id, phase""")
def team_shape(spark, sf_dir):
    out = tracking.team_shape(bridge.tracking(spark, sf_dir))
    return doubles(out.select("team_id", "phase", "frames", "centroid_x", "team_width_m", "team_depth_m", "defensive_line_m", "line_distance_m"))


@query(f"""{_T}, live AS (SELECT frame_index, team_id, any_value(possession_team_id) AS owner FROM track WHERE ball_in_play GROUP BY frame_index, team_id HAVING count(*) >= 3),
p AS (SELECT DISTINCT frame_index, team_id, x, y FROM track JOIN live USING (frame_index, team_id)),
e AS (SELECT frame_index, team_id, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS be FROM p a JOIN p b USING (frame_index, team_id) WHERE a.x <> b.x OR a.y <> b.y),
edges AS (SELECT e.* FROM e JOIN p k USING (frame_index, team_id) GROUP BY ALL HAVING min((bx - ax) * (k.y - ay) - (be - ay) * (k.x - ax)) >= -1e-9),
sides AS (SELECT *, (bx - ax) * (bx - ax) + (be - ay) * (be - ay) AS size FROM edges),
outgoing AS (SELECT * FROM sides QUALIFY row_number() OVER (PARTITION BY frame_index, team_id, ax, ay ORDER BY size DESC) = 1),
longest AS (SELECT * FROM outgoing QUALIFY row_number() OVER (PARTITION BY frame_index, team_id, bx, be ORDER BY size DESC) = 1),
hull AS (SELECT frame_index, team_id, {O.rnd('abs(sum(ax * be - ay * bx)) / 2', 2)} AS area FROM longest GROUP BY frame_index, team_id),
ph AS (SELECT *, 'ALL' AS phase FROM live UNION ALL SELECT *, CASE WHEN owner = team_id THEN 'IN_POSSESSION' ELSE 'OUT_OF_POSSESSION' END FROM live WHERE owner IS NOT NULL)
SELECT CAST(team_id AS BIGINT) AS team_id, phase, {O.rnd('avg(coalesce(area, 0))', 2)} AS convex_hull_area_m2, {O.rnd('greatest(0, 100 - avg(coalesce(area, 0)) / (105 * 68) * 100)', 1)} AS compactness FROM ph LEFT JOIN hull USING (frame_index, team_id) GROUP BY team_id, phase""")
def team_hulls(spark, sf_dir):
    """Hull area and compactness of each team and phase."""
    return doubles(tracking.team_shape(bridge.tracking(spark, sf_dir)).select("team_id", "phase", "convex_hull_area_m2", "compactness"))


@query(f"{O.LONG} SELECT DISTINCT season_id, player_id, TRUE AS is_nearest, TRUE AS is_mean, TRUE AS adds_up FROM pct")
def cluster_players(spark, sf_dir):
    """Clusters of all players' seasons, held against what makes them right: each player has the nearest of the centres, each centre
    is the mean of its players, and the inertia is the sum of the squared distances."""
    vectors, path = Tables(spark, sf_dir).vectors(), _scratch(spark, "clusters")
    found, centres, inertia = clusters.cluster_players(vectors, config.METRICS)
    found.select("season_id", "player_id", "cluster", "distance", F.array(*(F.coalesce(F.col("vector")[m], F.lit(50.0)) for m in config.METRICS)).alias("v")).write.parquet(path)
    found = spark.read.parquet(path)
    listed = F.array(*(F.array(*map(F.lit, c)) for c in centres))
    squared = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)
    own = found.withColumn("all", F.transform(listed, lambda c: squared("v", c)))
    is_nearest = F.abs(F.array_min("all") - F.get("all", F.col("cluster"))) < 1
    means = found.select("cluster", F.posexplode("v").alias("k", "x")).groupBy("cluster", "k").agg(F.avg("x").alias("m"))
    off = means.agg(F.max(F.abs(F.col("m") - F.get(F.get(listed, F.col("cluster")), F.col("k")))).alias("off"))
    total = found.agg(F.sum("distance").alias("total"))
    one = lambda df: df.withColumn("one", F.lit(1))
    return one(own).join(one(off), "one").join(one(total), "one").select("season_id", "player_id", is_nearest.alias("is_nearest"), (F.col("off") < 0.001).alias("is_mean"), (F.abs(F.col("total") - inertia) < 0.01).alias("adds_up"))


# --- views

from .functions.names import name_similarity as _likeness  # noqa: E402
from .functions.names import normalise_name as _normal  # noqa: E402
from .operators import entity, ngrams, payloads, search  # noqa: E402
from .plans import recompute as R  # noqa: E402
from .sources import sinks  # noqa: E402
from .streaming import incremental  # noqa: E402


def _dims(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return t, bridge.players(spark, sf_dir), bridge.teams(spark, sf_dir), bridge.seasons(spark, sf_dir), bridge.matches(t.flat)


@query(f"""{bridge.PRELUDE}, m AS (SELECT 'PLAYER' AS entity_type, 'x' || player_id AS external_id, player_id AS internal_id FROM players UNION ALL SELECT 'TEAM', 't' || team_id, team_id FROM teams)
SELECT event_id, p.internal_id AS player_id, t.internal_id AS team_id, r.internal_id AS recipient_id FROM ev LEFT JOIN m p ON p.entity_type = 'PLAYER' AND p.external_id = 'x' || ev.player_id LEFT JOIN m t ON t.entity_type = 'TEAM' AND t.external_id = 't' || ev.team_id LEFT JOIN m r ON r.entity_type = 'PLAYER' AND r.external_id = 'x' || ev.recipient_id""")
def resolve_ids(spark, sf_dir):
    t, players, teams, _, _ = _dims(spark, sf_dir)
    ids = lambda kind, c, p, rows: rows.select(F.lit(kind).alias("entity_type"), F.concat(F.lit(p), F.col(c).cast("string")).alias("external_id"), F.col(c).alias("internal_id"))
    outside = t.flat.select("event_id", *(F.concat(F.lit(p), F.col(f"{c}_id").cast("string")).alias(f"{c}_external_id") for c, p in (("player", "x"), ("team", "t"), ("recipient", "x"))))
    found = views.resolve_ids(outside, ids("PLAYER", "player_id", "x", players).unionByName(ids("TEAM", "team_id", "t", teams)), {"player_external_id": "PLAYER", "team_external_id": "TEAM", "recipient_external_id": "PLAYER"})
    return found.select("event_id", "player_id", "team_id", "recipient_id")


@query(f"{bridge.PRELUDE} SELECT event_id FROM ev WHERE event_id % 3 <> 0")
def new_events(spark, sf_dir):
    e = _events(spark, sf_dir)
    return views.new_events(e.unionByName(e.where("event_id % 5 = 0")), e.where("event_id % 3 = 0")).select("event_id")


@query(f"{bridge.PRELUDE} SELECT event_id, CASE WHEN type = 'SHOT' THEN xg END AS xg, CASE WHEN type = 'PASS' THEN pass_completed END AS completed FROM ev")
def wide_events(spark, sf_dir):
    e = _events(spark, sf_dir)
    shots, passes = e.where("type = 'SHOT'").select("event_id", "xg", "is_goal"), e.where("type = 'PASS'").select("event_id", F.col("pass_completed").alias("completed"), "is_cross")
    return views.wide_events(e.select("event_id", "type"), shot=shots, **{"pass": passes}).select("event_id", "shot.xg", "pass.completed")


@query(f"{O.PLAYER_MATCH} SELECT player_id, full_name, team_name, match_id, kickoff_at, competition_name, minutes, passes, xg FROM pmm JOIN players USING (player_id) JOIN teams USING (team_id) JOIN matches USING (match_id) JOIN seasons ON seasons.season_id = pmm.season_id")
def view_player_match(spark, sf_dir):
    t, players, teams, seasons, matches = _dims(spark, sf_dir)
    v = views.v_player_match(t.appearances, t.player_match(), players, teams, matches, seasons)
    return v.select("player_id", "full_name", "team_name", "match_id", "kickoff_at", "competition_name", "minutes", "passes", "xg")


_AGE = "CAST(date_diff('year', birth_date, end_date) - CASE WHEN strftime(end_date, '%m%d') < strftime(birth_date, '%m%d') THEN 1 ELSE 0 END AS BIGINT)"


@query(f"{O.SEASON} SELECT season.season_id, season.player_id, full_name, players.country AS nationality, {_AGE} AS age, team_name, season_name, minutes, xg_p90 FROM season JOIN players USING (player_id) LEFT JOIN teams USING (team_id) JOIN seasons ON seasons.season_id = season.season_id")
def view_player_season(spark, sf_dir):
    t, players, teams, seasons, _ = _dims(spark, sf_dir)
    v = views.v_player_season(t.season(), players, teams, seasons)
    return doubles(v.select("season_id", "player_id", "full_name", "nationality", "age", "team_name", "season_name", "minutes", "xg_p90")).withColumn("season_id", F.col("season_id").cast("int"))


@query(f"{O.LONG} SELECT long.player_id, full_name, season_name, metric_key, value FROM long JOIN players USING (player_id) JOIN seasons ON seasons.season_id = long.season_id")
def view_player_per90(spark, sf_dir):
    t, players, teams, seasons, _ = _dims(spark, sf_dir)
    return views.v_player_per90(views.v_player_season(t.season(), players, teams, seasons)).select("player_id", "full_name", "season_name", "metric_key", "value")


@query(f"{O.TEAM_MATCH} SELECT tm.team_id, team_name, match_id, kickoff_at, season_name, tm.team_id = home_team_id AS is_home, possession, ppda FROM tm JOIN teams USING (team_id) JOIN matches USING (match_id) JOIN seasons ON seasons.season_id = tm.season_id")
def view_team_match(spark, sf_dir):
    t, _, teams, seasons, matches = _dims(spark, sf_dir)
    return views.v_team_match(t.team_match(), teams, matches, seasons).select("team_id", "team_name", "match_id", "kickoff_at", "season_name", "is_home", "possession", "ppda")


@query(f"{O.TEAM_SEASON} SELECT tsm.team_id, team_name, country, competition_name, season_name, matches, possession, ppda FROM tsm JOIN teams USING (team_id) JOIN seasons ON seasons.season_id = tsm.season_id")
def view_team_season(spark, sf_dir):
    t, _, teams, seasons, _ = _dims(spark, sf_dir)
    return views.v_team_season(t.team_season(), teams, seasons).select("team_id", "team_name", "country", "competition_name", "season_name", "matches", "possession", "ppda")


@query(f"""{O.TEAM_MATCH} SELECT m.match_id, h.team_name AS home_team, a.team_name AS away_team, hm.xg AS home_xg, am.xg AS away_xg, hm.possession AS home_possession, am.ppda AS away_ppda, coalesce(n, 0) AS event_count
FROM matches m JOIN seasons USING (season_id) JOIN teams h ON h.team_id = home_team_id JOIN teams a ON a.team_id = away_team_id LEFT JOIN tm hm ON hm.match_id = m.match_id AND hm.team_id = home_team_id LEFT JOIN tm am ON am.match_id = m.match_id AND am.team_id = away_team_id LEFT JOIN (SELECT match_id, count(*) AS n FROM ev GROUP BY match_id) c ON c.match_id = m.match_id""")
def view_match_summary(spark, sf_dir):
    t, _, teams, seasons, matches = _dims(spark, sf_dir)
    return views.v_match_summary(matches, t.team_match(), teams, seasons, t.flat).select("match_id", "home_team", "away_team", "home_xg", "away_xg", "home_possession", "away_ppda", "event_count")


@query(f"{O.ROLE_SCORES} SELECT roles.player_id, full_name, season_name, role_key, score, CAST(rank AS BIGINT) AS rank FROM roles JOIN players USING (player_id) LEFT JOIN seasons ON seasons.season_id = roles.season_id")
def view_roles(spark, sf_dir):
    t, players, _, seasons, _ = _dims(spark, sf_dir)
    return doubles(views.v_roles(t.roles(), players, seasons).select("player_id", "full_name", "season_name", "role_key", "score", "rank"))


@query(f"""{O.LONG}, {_COS.format(k='player_id', v='percentile', t='pct', g='a.season_id,', on='a.season_id = b.season_id AND a.position_group = b.position_group AND a.metric_key = b.metric_key')},
best AS (SELECT season_id, s, c, similarity FROM sim QUALIFY row_number() OVER (PARTITION BY season_id, s ORDER BY similarity DESC, c) <= 10)
SELECT season_id, s AS player_id, p.full_name AS player_name, c AS comparison_player_id, q.full_name AS comparison_player_name, similarity FROM best JOIN players p ON p.player_id = s JOIN players q ON q.player_id = c""")
def view_similarity(spark, sf_dir):
    t, players, _, _, _ = _dims(spark, sf_dir)
    return views.v_similarity(models.similar_players(t.vectors(), config.METRICS), players).select("season_id", "player_id", "player_name", "comparison_player_id", "comparison_player_name", "similarity")


@query(f"{O.FIT} SELECT f.player_id, full_name, team_name, season_name, fit_score FROM fit f JOIN players USING (player_id) JOIN teams USING (team_id) LEFT JOIN seasons ON seasons.season_id = f.season_id WHERE fit_score > 0")
def view_club_fit(spark, sf_dir):
    t, players, teams, seasons, _ = _dims(spark, sf_dir)
    return views.v_fit(t.fit(), players, teams, seasons).where("fit_score > 0").select("player_id", "full_name", "team_name", "season_name", "fit_score")


@query(f"{_ZONES} SELECT za.player_id, full_name, zone_key, CAST(sum(passes) AS BIGINT) AS passes FROM za LEFT JOIN players USING (player_id) GROUP BY ALL")
def view_zones(spark, sf_dir):
    t, players, teams, _, _ = _dims(spark, sf_dir)
    z = views.v_zones(spatial.zone_activity(t.flat, ["match_id", "team_id", "player_id"]), players, teams)
    return z.groupBy("player_id", "full_name", "zone_key").agg(F.sum("passes").alias("passes"))


@query(f"""{O.STYLES} SELECT s.season_id, s.team_id, team_name, {', '.join(f"max(score) FILTER (WHERE dimension = '{d}') AS {d}" for d in config.STYLE)} FROM style s JOIN teams USING (team_id) GROUP BY s.season_id, s.team_id, team_name""")
def view_team_style(spark, sf_dir):
    t, _, teams, seasons, _ = _dims(spark, sf_dir)
    return views.v_team_style(models.style_profiles(t.style()), teams, seasons).select("season_id", "team_id", "team_name", *config.STYLE)


@query(f"{bridge.PRELUDE} SELECT season_id, season_name FROM seasons WHERE season_id IN (SELECT season_id FROM matches)")
def known_seasons(spark, sf_dir):
    _, _, _, seasons, matches = _dims(spark, sf_dir)
    return views.known_seasons(seasons, matches).select("season_id", "season_name")


@query("SELECT event_id, 'p1' AS provider_id, r_name AS provider_name, CAST(event_id % 3 AS INT) AS import_id, n_name AS source_dataset FROM events JOIN nation ON n_nationkey = event_id % 3 JOIN region ON r_regionkey = 1")
def event_lineage(spark, sf_dir):
    e = _events(spark, sf_dir).select("event_id", "provider_id", (F.col("event_id") % 3).cast("int").alias("import_id"))
    providers = bridge.read(spark, sf_dir, "region").where("r_regionkey = 1").select(F.lit("p1").alias("provider_id"), F.col("r_name").alias("provider_name"))
    imports = bridge.read(spark, sf_dir, "nation").where("n_nationkey < 3").select(F.col("n_nationkey").alias("import_id"), F.lit("v1").alias("version_id"), F.col("n_name").alias("source_dataset"))
    versions = imports.select("version_id").distinct()
    return views.event_lineage(e, providers, versions, imports).drop("version_id")


_LOG = "CASE WHEN {t}.team_id = home_team_id THEN away_team_id ELSE home_team_id END AS opponent_id, {t}.team_id = home_team_id AS is_home, CAST(CASE WHEN {t}.team_id = home_team_id THEN home_score ELSE away_score END AS BIGINT) AS goals_for, CAST(CASE WHEN {t}.team_id = home_team_id THEN away_score ELSE home_score END AS BIGINT) AS goals_against"


@query(f"{O.PLAYER_MATCH} SELECT player_id, match_id, {_LOG.format(t='pmm')}, xg FROM pmm JOIN matches USING (match_id)")
def player_match_log(spark, sf_dir):
    t, _, teams, _, matches = _dims(spark, sf_dir)
    return doubles(views.player_match_log(t.player_match(), matches, teams).select("player_id", "match_id", "opponent_id", "is_home", "goals_for", "goals_against", "xg"))


@query(f"{O.TEAM_MATCH} SELECT tm.team_id, match_id, {_LOG.format(t='tm').replace(' AS opponent_id', ' AS rival_id')}, xg FROM tm JOIN matches USING (match_id)")
def team_match_log(spark, sf_dir):
    t, _, teams, _, matches = _dims(spark, sf_dir)
    return doubles(views.team_match_log(t.team_match(), matches, teams).select("team_id", "match_id", F.col("opponent_id").alias("rival_id"), "is_home", "goals_for", "goals_against", "xg"))


# --- names and entities


@query("SELECT p_partkey AS part, trim(regexp_replace(regexp_replace(lower(strip_accents(p_name || ' É.' || p_type)), '[^a-z0-9\\s]', '', 'g'), '\\s+', ' ', 'g')) AS name FROM part")
def normalised_names(spark, sf_dir):
    return bridge.read(spark, sf_dir, "part").select(F.col("p_partkey").alias("part"), _normal(F.concat("p_name", F.lit(" É."), "p_type")).alias("name"))


_REC = bridge.PRELUDE.replace("WITH base", "WITH RECURSIVE base", 1)
_NEXT = f"SELECT p.player_id AS id, {O.normal('p.full_name')} AS a, {O.normal('q.full_name')} AS b FROM players p JOIN players q ON q.player_id = p.player_id + 1"


@query(f"{_REC}, {O.likeness(_NEXT + ' WHERE p.full_name IS NOT NULL AND q.full_name IS NOT NULL')} SELECT id AS player_id, s AS similarity FROM alike")
def name_similarity(spark, sf_dir):
    """Likeness of each player's name to the one with the next id."""
    p = bridge.players(spark, sf_dir).where("full_name is not null").select("player_id", "full_name")
    return p.join(p.select((F.col("player_id") - 1).alias("player_id"), F.col("full_name").alias("other")), "player_id").select("player_id", _likeness(F.col("full_name"), F.col("other")).alias("similarity"))


_INCOMING = "SELECT player_id AS iid, CASE WHEN player_id % 3 = 0 THEN full_name[1] || '. ' || regexp_extract(full_name, '^\\S+\\s+(.*)$', 1) ELSE full_name END AS iname, CASE WHEN player_id % 5 <> 0 THEN birth_date END AS idate FROM players WHERE full_name IS NOT NULL"
_CANDIDATES = f"""SELECT [iid, p.player_id] AS id, {O.normal('iname')} AS a, {O.normal('p.full_name')} AS b FROM open JOIN players p ON p.full_name IS NOT NULL
  AND CASE WHEN idate IS NOT NULL THEN p.birth_date = idate ELSE contains(lower(p.full_name), lower(string_split(iname, ' ')[-1])) END"""


@query(f"""{_REC}, incoming AS ({_INCOMING}), exact AS (SELECT iid, min(player_id) AS player_id FROM incoming JOIN players ON birth_date = idate AND lower(full_name) = lower(iname) GROUP BY iid),
open AS (SELECT * FROM incoming WHERE iid NOT IN (SELECT iid FROM exact)), {O.likeness(_CANDIDATES)},
best AS (SELECT id[1] AS iid, id[2] AS player_id, s FROM alike WHERE s >= 0.86 QUALIFY row_number() OVER (PARTITION BY id[1] ORDER BY s DESC, id[2]) = 1)
SELECT iid AS incoming_id, player_id, CAST(1 AS DOUBLE) AS confidence, 'EXACT' AS method FROM exact UNION ALL SELECT iid, player_id, s, 'FUZZY' FROM best""")
def match_players(spark, sf_dir):
    p = bridge.players(spark, sf_dir)
    short = F.concat(F.substring("full_name", 1, 1), F.lit(". "), F.regexp_extract("full_name", r"^\S+\s+(.*)$", 1))
    new = p.select(F.col("player_id").alias("incoming_id"), F.when(F.col("player_id") % 3 == 0, short).otherwise(F.col("full_name")).alias("full_name"), F.when(F.col("player_id") % 5 != 0, F.col("birth_date")).alias("birth_date")).where("full_name is not null")
    return entity.match_players(new, p)


@query("""SELECT CAST(n_nationkey AS INT) AS incoming_id, CASE WHEN n_nationkey % 4 <> 3 THEN n_nationkey END AS team_id, CASE n_nationkey % 4 WHEN 0 THEN 'EXACT' WHEN 1 THEN 'ALIAS' ELSE 'FUZZY' END AS method FROM nation WHERE n_nationkey % 4 <> 3""")
def match_teams(spark, sf_dir):
    """Nations by their exact name, an alias, and a name with marks and points; a fourth is unknown."""
    n = bridge.read(spark, sf_dir, "nation")
    teams = n.select(F.col("n_nationkey").alias("team_id"), F.col("n_name").alias("team_name"), F.col("n_regionkey").cast("string").alias("country"))
    kind, name = F.col("n_nationkey") % 4, F.col("n_name")
    odd = F.concat(F.translate(name, "AEIOU", "ÁÉÍÓÚ"), F.lit("."))
    given = F.when(kind == 0, F.lower(name)).when(kind == 1, F.concat(F.lit("alias of "), name)).when(kind == 2, odd).otherwise("zzzz")
    new = n.select(F.col("n_nationkey").alias("incoming_id"), given.alias("team_name"), F.lit(None).cast("string").alias("country"))
    return entity.match_teams(new, teams, teams.select("team_id", F.concat(F.lit("Alias of "), "team_name").alias("alias")))


# --- search, comparison, counts


@query(f"{bridge.PRELUDE} SELECT event_id, minute FROM ev WHERE team_id = 4 AND type = 'PASS' AND minute >= 30 ORDER BY minute, second, sequence LIMIT 50 OFFSET 10")
def browse_events(spark, sf_dir):
    return doubles(search.browse_events(_events(spark, sf_dir), team_id=4, types=["PASS"], minutes=(30, None), limit=50, offset=10)[0].select("event_id", "minute"))


@query(f"{bridge.PRELUDE} SELECT count(*) AS total FROM ev WHERE team_id = 4 AND type = 'PASS' AND minute >= 30")
def browse_events_total(spark, sf_dir):
    return search.browse_events(_events(spark, sf_dir), team_id=4, types=["PASS"], minutes=(30, None))[1]


@query(f"{O.PERCENTILES.format(minutes=60, order='')} SELECT season_id, player_id, value, percentile FROM vp WHERE metric_key = 'xg_p90' ORDER BY percentile DESC, value DESC, season_id, player_id LIMIT 20")
def leaderboard(spark, sf_dir):
    p = windows.player_percentiles(Tables(spark, sf_dir).long().where("metric_key = 'xg_p90'"), min_minutes=60)
    return search.leaderboard(p, "xg_p90").select("season_id", "player_id", "value", "percentile")


@query(f"""{O.PERCENTILES.format(minutes=60, order='')} SELECT s.season_id, s.player_id, s.minutes FROM season s JOIN players p USING (player_id) JOIN vp v ON v.season_id = s.season_id AND v.player_id = s.player_id AND v.metric_key = 'passes_p90' AND v.percentile >= 40
WHERE s.tackles_p90 BETWEEN 0 AND 3 AND height_cm >= 170 ORDER BY s.minutes DESC, s.season_id, s.player_id LIMIT 25""")
def search_players(spark, sf_dir):
    t = Tables(spark, sf_dir)
    what = search.Search(metrics={"tackles_p90": ("between", (0, 3)), "passes_p90": ("percentile", 40)}, height=(170, None))
    return search.search_players(t.season(), bridge.players(spark, sf_dir), what, windows.player_percentiles(t.long(), min_minutes=60))[0].select("season_id", "player_id", "minutes")


@query(f"""{O.SEASON} SELECT s.season_id, s.player_id, s.minutes FROM season s JOIN players p USING (player_id) WHERE contains(lower(full_name), 'gear') ORDER BY s.minutes DESC, s.season_id, s.player_id LIMIT 25""")
def search_players_by_name(spark, sf_dir):
    """A name that players' names or aliases contain, through postings of both."""
    players = bridge.players(spark, sf_dir)
    aliases = players.select("player_id", F.upper("full_name").alias("alias"))
    index = ngrams.postings(players.select(F.lower("full_name").alias("label")).unionByName(aliases.select(F.lower("alias").alias("label"))))
    found, _ = search.search_players(Tables(spark, sf_dir).season(), players, search.Search(name="GEAR"), aliases=aliases, index=index)
    return found.select("season_id", "player_id", "minutes")


@query("SELECT * FROM (SELECT 'part' AS kind, CAST(p_partkey AS VARCHAR) AS id, p_name AS label FROM part WHERE contains(lower(p_name), 'a') ORDER BY label, id LIMIT 5) UNION ALL SELECT * FROM (SELECT 'nation', CAST(n_nationkey AS VARCHAR), n_name FROM nation WHERE contains(lower(n_name), 'a') ORDER BY 3, 2 LIMIT 5)")
def global_search(spark, sf_dir):
    return search.global_search("A", {"part": (bridge.read(spark, sf_dir, "part"), "p_partkey", "p_name"), "nation": (bridge.read(spark, sf_dir, "nation"), "n_nationkey", "n_name")})


@query("SELECT * FROM (SELECT 'part' AS kind, CAST(p_partkey AS VARCHAR) AS id, p_name AS label FROM part WHERE contains(lower(p_name), 'ar') ORDER BY label, id LIMIT 50) UNION ALL SELECT * FROM (SELECT 'nation', CAST(n_nationkey AS VARCHAR), n_name FROM nation WHERE contains(lower(n_name), 'ar') ORDER BY 3, 2 LIMIT 50)")
def global_search_indexed(spark, sf_dir):
    """A search through stored postings of the parts' names, and through the nations' names themselves."""
    parts, path = bridge.read(spark, sf_dir, "part"), _scratch(spark, "postings")
    ngrams.postings(parts.select(F.lower("p_name").alias("label"))).write.parquet(path)
    sources = {"part": (parts, "p_partkey", "p_name"), "nation": (bridge.read(spark, sf_dir, "nation"), "n_nationkey", "n_name")}
    return search.global_search("AR", sources, 50, {"part": spark.read.parquet(path)})


@query("""WITH words AS (SELECT DISTINCT unnest(string_split(lower(p_name || ' ' || p_type), ' ')) AS w FROM part), names AS (SELECT DISTINCT lower(p_name) AS label FROM part),
terms AS (SELECT substr(w, 2, 4) AS term FROM words UNION SELECT substr(w, 1, 2) FROM words UNION SELECT right(w, 1) FROM words)
SELECT term, label FROM terms JOIN names ON contains(label, term) WHERE term <> ''""")
def names_containing(spark, sf_dir):
    """Which names of parts contain the ends and middles of all words of their names and types."""
    part = bridge.read(spark, sf_dir, "part")
    w = F.explode(F.split(F.lower(F.concat_ws(" ", "p_name", "p_type")), " ")).alias("w")
    terms = part.select(w).select(F.explode(F.array(F.substring("w", 2, 4), F.substring("w", 1, 2), F.expr("right(w, 1)"))).alias("term"))
    return ngrams.containing(ngrams.postings(part.select(F.lower("p_name").alias("label"))), terms)


@query(f"""SELECT * FROM ({O.PERCENTILES.format(minutes=60, order='')}, own AS (SELECT player_id, season_id, position_group, minutes FROM season WHERE player_id IN (1, 3, 5) QUALIFY row_number() OVER (PARTITION BY player_id ORDER BY minutes DESC, season_id) = 1),
pc AS (SELECT vp.* FROM vp JOIN own USING (player_id, season_id))
SELECT player_id, season_id, 'strength' AS part, metric_key AS key, percentile AS value FROM pc WHERE percentile >= 70 QUALIFY row_number() OVER (PARTITION BY player_id ORDER BY percentile DESC, metric_key) <= 5
UNION ALL SELECT player_id, season_id, 'weakness', metric_key, percentile FROM pc WHERE percentile <= 30 QUALIFY row_number() OVER (PARTITION BY player_id ORDER BY percentile, metric_key DESC) <= 5
UNION ALL SELECT player_id, season_id, 'shared', 'population', CAST((SELECT count(DISTINCT (season_id, position_group)) FROM own) = 1 AS INT) FROM own
UNION ALL SELECT player_id, season_id, 'metric', k, 1 FROM own, (SELECT DISTINCT metric_key AS k FROM long JOIN own o USING (player_id, season_id) WHERE value <> 0))
UNION ALL SELECT * FROM ({O.ROLE_SCORES} SELECT player_id, season_id, 'role', role_key, score FROM roles WHERE player_id IN (1, 3, 5) QUALIFY row_number() OVER (PARTITION BY player_id ORDER BY score DESC, season_id, role_key) <= 5)
UNION ALL SELECT * FROM ({O.FIT}, own AS (SELECT player_id, season_id FROM season WHERE player_id IN (1, 3, 5) QUALIFY row_number() OVER (PARTITION BY player_id ORDER BY minutes DESC, season_id) = 1),
every AS (SELECT p.season_id, p.player_id, t.team_id, coalesce(fit_score, 0) AS fit_score FROM (SELECT DISTINCT season_id, player_id FROM dna) p JOIN (SELECT DISTINCT season_id, team_id FROM style) t ON t.season_id = p.season_id LEFT JOIN fit f ON f.season_id = p.season_id AND f.player_id = p.player_id AND f.team_id = t.team_id)
SELECT player_id, season_id, 'fit', CAST(team_id AS VARCHAR), fit_score FROM every WHERE player_id IN (1, 3, 5) QUALIFY row_number() OVER (PARTITION BY player_id ORDER BY fit_score DESC, season_id, team_id) <= 5
UNION ALL SELECT player_id, season_id, 'profile', category, score FROM dna JOIN own USING (player_id, season_id))""")
def compare_players(spark, sf_dir):
    """Three players side by side, a row for each strength, weakness, role, fit, profile category and metric."""
    t = Tables(spark, sf_dir)
    rows = search.compare_players([1, 3, 5, 3], t.season(), windows.player_percentiles(t.long(), 60), bridge.players(spark, sf_dir), t.roles(), t.fit(), t.dna())
    entry = lambda season, part, key, value: F.struct(season.alias("season_id"), F.lit(part).alias("part"), key.cast("string").alias("key"), value.cast("double").alias("value"))
    own = F.col("season_id")
    listed = {
        "strengths": lambda e: entry(own, "strength", e["metric_key"], e["percentile"]), "weaknesses": lambda e: entry(own, "weakness", e["metric_key"], e["percentile"]),
        "roles": lambda e: entry(e["season_id"], "role", e["role_key"], e["score"]), "fits": lambda e: entry(e["season_id"], "fit", e["team_id"], e["fit_score"]),
        "profile": lambda e: entry(own, "profile", e["category"], e["score"]), "metric_keys": lambda e: entry(own, "metric", e, F.lit(1)),
    }
    parts = [F.array(entry(own, "shared", F.lit("population"), F.col("shared_population").cast("int"))), *(F.transform(c, f) for c, f in listed.items())]
    return rows.select("player_id", F.explode(F.flatten(F.array(*(F.coalesce(p, F.array().cast("array<struct<season_id:int,part:string,key:string,value:double>>")) for p in parts)))).alias("e")).select("player_id", "e.*")


@query(f"""{O.TEAM_SEASON}, best AS (SELECT team_id, season_id, matches FROM tsm WHERE team_id IN (1, 2, 4) QUALIFY row_number() OVER (PARTITION BY team_id ORDER BY matches DESC, season_id) = 1)
SELECT b.team_id, season_id, matches, {O.rnd('avg(tackles + interceptions + recoveries)', 2)} AS defensive_actions_per_match, {O.rnd('avg(crosses)', 2)} AS crosses_per_match FROM best b JOIN (SELECT team_id AS t, tackles, interceptions, recoveries, crosses FROM tm) ON t = b.team_id GROUP BY ALL""")
def compare_teams(spark, sf_dir):
    t, _, teams, _, _ = _dims(spark, sf_dir)
    season = t.team_season()
    return search.compare_teams([1, 2, 4], season, windows.club_percentiles(season, config.CLUB_METRICS), t.team_match(), teams).select("team_id", "season_id", "matches", "defensive_actions_per_match", "crosses_per_match")


@query(f"""{O.PERCENTILES.format(minutes=60, order='')} SELECT season_id, player_id, kind, metric_key FROM (
SELECT season_id, player_id, 'strength' AS kind, metric_key FROM vp WHERE percentile >= 75 QUALIFY row_number() OVER (PARTITION BY season_id, player_id ORDER BY percentile DESC, metric_key) <= 5
UNION ALL SELECT season_id, player_id, 'risk', metric_key FROM vp WHERE percentile <= 30 QUALIFY row_number() OVER (PARTITION BY season_id, player_id ORDER BY percentile, metric_key) <= 5)""")
def strengths_risks(spark, sf_dir):
    s = search.strengths_risks(windows.player_percentiles(Tables(spark, sf_dir).long(), 60))
    part = lambda c, k: s.select("season_id", "player_id", F.lit(k).alias("kind"), F.explode(c).alias("e")).select("season_id", "player_id", "kind", "e.metric_key")
    return part("strengths", "strength").unionByName(part("risks", "risk"))


@query(f"{O.LONG}, w AS (SELECT * FROM (VALUES {O.values(_DRAFT)}) t(metric_key, weight)) SELECT season_id, player_id, {O.rnd('sum(CAST(weight * 100 AS BIGINT) * CAST(floor(percentile * 10 + 0.5) AS BIGINT)) / 1000.0', 1)} AS score FROM pct JOIN w USING (metric_key) GROUP BY season_id, player_id")
def custom_score(spark, sf_dir):
    return search.custom_score(Tables(spark, sf_dir).pct(), spark.createDataFrame(_DRAFT, "metric_key string, weight double"))


@query(f"{bridge.PRELUDE} SELECT type, count(*) AS n FROM ev GROUP BY type")
def event_distribution(spark, sf_dir):
    return search.event_distribution(_events(spark, sf_dir))


@query(f"{bridge.PRELUDE} SELECT 'players' AS entity, count(*) AS n FROM players UNION ALL SELECT 'matches', count(*) FROM matches UNION ALL SELECT 'events', count(*) FROM ev")
def entity_counts(spark, sf_dir):
    t, players, _, _, matches = _dims(spark, sf_dir)
    return search.entity_counts({"players": players, "matches": matches, "events": t.flat})


@query(f"{O.TEAM_SEASON} SELECT t.team_id, team_name, coalesce(n, 0) AS squad_size, s.season_id AS main_season_id FROM teams t LEFT JOIN (SELECT team_id, count(DISTINCT player_id) AS n FROM season GROUP BY team_id) USING (team_id) LEFT JOIN (SELECT team_id, season_id FROM tsm QUALIFY row_number() OVER (PARTITION BY team_id ORDER BY matches DESC, season_id) = 1) s USING (team_id)".replace(O.PLAYER_MATCH, O.SEASON))
def team_list(spark, sf_dir):
    t, _, teams, _, _ = _dims(spark, sf_dir)
    return search.team_list(teams, t.season(), t.team_season()).select("team_id", "team_name", "squad_size", "main_season_id")


_FIELDS = {"technique": 3, "physical": 7, "tactical": 11, "mental": 13, "potential": 17, "overall": 19}


@query(f"SELECT o_custkey AS player_id, count(*) AS n_ratings, {', '.join(O.rnd(f'avg(1 + (o_orderkey * {k}) % 100)') + f' AS {c}' for c, k in _FIELDS.items())} FROM orders GROUP BY o_custkey HAVING count(*) > 1")
def rating_consensus(spark, sf_dir):
    o = bridge.read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("player_id"), *((1 + F.col("o_orderkey") * k % 100).alias(c) for c, k in _FIELDS.items()))
    return search.rating_consensus(o, list(_FIELDS))


@query("SELECT CAST(event_id % 7 AS BIGINT) AS import_id, count(*) AS records, count(*) FILTER (WHERE event_id % 4 <> 0) AS events, count(DISTINCT CASE WHEN event_id % 4 = 0 THEN 'match' ELSE 'event' END) AS entities, count(*) FILTER (WHERE event_id % 50 = 0) AS errors, count(*) FILTER (WHERE event_id % 50 = 25) AS warnings, CASE WHEN count(*) FILTER (WHERE event_id % 50 = 0) > 0 THEN 'PARTIAL' ELSE 'COMPLETED' END AS status FROM events GROUP BY 1")
def import_summary(spark, sf_dir):
    e = bridge.read(spark, sf_dir, "events").select(F.col("event_id"), (F.col("event_id") % 7).alias("import_id"))
    bad = e.where("event_id % 50 IN (0, 25)").select("import_id", F.when(F.col("event_id") % 50 == 0, "ERROR").otherwise("WARNING").alias("severity"))
    return search.import_summary(e.select("import_id", F.when(F.col("event_id") % 4 == 0, "match").otherwise("event").alias("entity")), bad)


# --- payloads, loading, files, recompute


def _player_payloads(spark, sf_dir):
    t, players, teams, seasons, _ = _dims(spark, sf_dir)
    pct = windows.player_percentiles(t.long(), 60)
    shots = t.events.where("type = 'SHOT'").select("season_id", "player_id", "match_id", "event_id", "minute", "x", "y", "shot.xg", "shot.is_goal")
    heat = spatial.heatmap_kde(spatial.heatmap_points(t.events, "TOUCH", ["season_id", "player_id"]), ["season_id", "player_id"])
    identity = views.v_player_season(t.season(), players, teams, seasons).select("season_id", "player_id", "full_name", "team_name", "age", "minutes", "matches", "totals")
    orders = bridge.read(spark, sf_dir, "orders")
    notes = orders.select(F.col("o_custkey").alias("player_id"), F.col("o_orderkey").alias("note_id"), F.col("o_orderpriority").alias("note"))
    similar = models.similar_players(t.vectors(), config.METRICS)
    ratings = rating_consensus(spark, sf_dir)
    return payloads.player_report_payloads(identity, pct, t.dna(), t.roles(), similar, t.fit(), shots, heat, notes, ratings)


def _sections(payloads_: DataFrame, keys: list[str], parts: dict[str, Callable]) -> DataFrame:
    """(keys, section, key, value): what the sections of payloads hold."""
    entry = lambda name, key, value: F.struct(F.lit(name).alias("section"), key.cast("string").alias("key"), value.cast("double").alias("value"))
    none = F.array().cast("array<struct<section:string,key:string,value:double>>")
    each = lambda name, f: F.coalesce(F.transform(name, lambda e: entry(name, *f(e))), none)
    listed = [each(name, f) for name, f in parts.items()]
    return payloads_.select(*keys, F.explode(F.flatten(F.array(*listed))).alias("e")).select(*keys, "e.*")


_SIMILAR = _COS.format(
    k="player_id", v="percentile", t="pct", g="a.season_id,", on="a.season_id = b.season_id AND a.position_group = b.position_group AND a.metric_key = b.metric_key"
)
_NEAR_CELL = f"abs(c - {_C24}) <= 5 AND abs(r - {_R16}) <= 5 AND pow({_KX} - x, 2) + pow({_KY} - y, 2) <= 324"
_DENSE = f"sum(CASE WHEN {_NEAR_CELL} THEN exp(-(pow({_KX} - x, 2) + pow({_KY} - y, 2)) / 72) ELSE 0 END)"
_PLAYER_HEAT = f"""pts AS (SELECT season_id, player_id, x, y FROM ev WHERE type IN ({_types('TOUCH')})),
cells AS (SELECT season_id, player_id, c, r, {_DENSE} AS v FROM {_AROUND} GROUP BY ALL),
heat AS (SELECT *, {O.rnd('v / max(v) OVER (PARTITION BY season_id, player_id)', 4)} AS density FROM cells)"""


@query(f"""SELECT * FROM ({O.PERCENTILES.format(minutes=60, order='')}, {_PLAYER_HEAT}
SELECT season_id, player_id, 'percentiles' AS section, metric_key AS key, percentile AS value FROM vp JOIN season USING (season_id, player_id)
UNION ALL SELECT season_id, player_id, 'shots', match_id || '/' || minute, xg FROM ev JOIN season USING (season_id, player_id) WHERE type = 'SHOT'
UNION ALL SELECT season_id, player_id, 'heatmap', c || '/' || r, density FROM heat JOIN season USING (season_id, player_id) WHERE density > 0
UNION ALL SELECT season_id, player_id, 'notes', o_orderpriority, o_orderkey FROM season JOIN orders ON o_custkey = player_id
UNION ALL SELECT season_id, player_id, 'ratings', CAST(n AS VARCHAR), overall FROM season JOIN (
  SELECT o_custkey AS player_id, count(*) AS n, {O.rnd(f"avg(1 + (o_orderkey * {_FIELDS['overall']}) % 100)")} AS overall FROM orders GROUP BY o_custkey HAVING count(*) > 1
) USING (player_id))
UNION ALL SELECT * FROM ({O.PROFILES} SELECT season_id, player_id, 'profile', category, score FROM dna)
UNION ALL SELECT * FROM ({O.ROLE_SCORES} SELECT season_id, player_id, 'roles', role_key, score FROM roles WHERE rank <= 6)
UNION ALL SELECT * FROM ({O.LONG}, {_SIMILAR} SELECT season_id, s, 'similar', CAST(c AS VARCHAR), similarity FROM sim
  QUALIFY row_number() OVER (PARTITION BY season_id, s ORDER BY similarity DESC, c) <= 8)
UNION ALL SELECT * FROM ({O.FIT}, every AS (
  SELECT p.season_id, p.player_id, t.team_id, coalesce(fit_score, 0) AS fit_score FROM (SELECT DISTINCT season_id, player_id FROM dna) p
  JOIN (SELECT DISTINCT season_id, team_id FROM style) t ON t.season_id = p.season_id
  LEFT JOIN fit f ON f.season_id = p.season_id AND f.player_id = p.player_id AND f.team_id = t.team_id)
  SELECT season_id, player_id, 'fits', CAST(team_id AS VARCHAR), fit_score FROM every
  QUALIFY row_number() OVER (PARTITION BY season_id, player_id ORDER BY fit_score DESC, team_id) <= 8)""")
def player_report_payloads(spark, sf_dir):
    """What all sections of each payload hold."""
    text, joined = lambda c: c.cast("string"), lambda a, b: F.concat_ws("/", a.cast("string"), b.cast("string"))
    parts = {
        "percentiles": lambda e: (e["metric_key"], e["percentile"]),
        "shots": lambda e: (joined(e["match_id"], e["minute"]), e["xg"]),
        "heatmap": lambda e: (joined(e["col"], e["row"]), e["value"]),
        "notes": lambda e: (e["note"], e["note_id"]),
        "ratings": lambda e: (text(e["n_ratings"]), e["overall"]),
        "profile": lambda e: (e["category"], e["score"]),
        "roles": lambda e: (e["role_key"], e["score"]),
        "similar": lambda e: (text(e["comparison_player_id"]), e["similarity"]),
        "fits": lambda e: (text(e["team_id"]), e["fit_score"]),
    }
    return _sections(_player_payloads(spark, sf_dir), ["season_id", "player_id"], parts)


_MICRO = lambda c: f"CASE WHEN {c} IS NULL THEN 'null' ELSE CAST(CAST(floor(CAST({c} AS DOUBLE) * 1000000 + 0.5) AS BIGINT) AS VARCHAR) END"
_QUOTED = lambda c: f"CASE WHEN {c} IS NULL THEN 'null' ELSE '\"' || replace(replace({c}, '\\', '\\\\'), '\"', '\\\"') || '\"' END"


@query(f"""{O.PERCENTILES.format(minutes=60, order='')},
parts AS (SELECT season_id, player_id, string_agg('{{"metric_key":' || {_QUOTED('metric_key')} || ',"percentile":' || {_MICRO('percentile')} || ',"population_size":' || {_MICRO('population_size')} || ',"value":' || {_MICRO('value')} || '}}', ',' ORDER BY metric_key) AS p FROM vp GROUP BY ALL),
text AS (SELECT season_id, player_id, '{{"birth_date":' || {_QUOTED('CAST(birth_date AS VARCHAR)')} || ',"full_name":' || {_QUOTED('full_name')} || ',"height_cm":' || {_MICRO('height_cm')} || ',"minutes":' || {_MICRO('minutes')}
  || ',"percentiles":' || CASE WHEN p IS NULL THEN 'null' ELSE '[' || p || ']' END || ',"player_id":' || {_MICRO('player_id')} || ',"season_id":' || {_MICRO('season_id')} || '}}' AS t
  FROM season JOIN players USING (player_id) LEFT JOIN parts USING (season_id, player_id))
SELECT season_id, player_id, substr(sha256(t), 1, 32) AS snapshot_id FROM text""")
def snapshot_ids(spark, sf_dir):
    """Content-addressed ids of payloads of a player's season: texts, dates, numbers, nulls and an array of structs."""
    t = Tables(spark, sf_dir)
    base = t.kept_season.select("season_id", "player_id", "minutes").join(bridge.players(spark, sf_dir).select("player_id", "full_name", "birth_date", "height_cm"), "player_id")
    part = payloads.section(windows.player_percentiles(t.long(), 60), ["season_id", "player_id"], "percentiles", ["metric_key", "value", "percentile", "population_size"], F.col("metric_key"))
    return payloads.assembled(base, ["season_id", "player_id"], [part]).select("season_id", "player_id", "snapshot_id")


@query()
def player_report_snapshots(spark, sf_dir):
    return _player_payloads(spark, sf_dir).select("season_id", "player_id", "snapshot_id")


_CLUB_PCT = f"""{O.TEAM_SEASON},
l AS (SELECT * FROM (UNPIVOT (SELECT season_id, team_id, {', '.join(config.CLUB_METRICS)} FROM tsm) ON {', '.join(config.CLUB_METRICS)} INTO NAME metric_key VALUE value)),
clubs AS (SELECT season_id, team_id, metric_key, {O.rnd('percent_rank() OVER (PARTITION BY season_id, metric_key ORDER BY value) * 100', 1)} AS percentile FROM l
  QUALIFY count(*) OVER (PARTITION BY season_id, metric_key) >= 2)"""


@query(f"""SELECT * FROM ({O.STYLES} SELECT season_id, team_id, 'style' AS section, dimension AS key, score AS value FROM style)
UNION ALL SELECT * FROM ({_CLUB_PCT} SELECT season_id, team_id, 'percentiles', metric_key, percentile FROM clubs)
UNION ALL SELECT * FROM ({O.TEAM_SEASON} SELECT season_id, team_id, 'log', CAST(match_id AS VARCHAR), xg FROM tm) UNION ALL SELECT * FROM ({O.SEASON} SELECT season_id, team_id, 'squad', CAST(player_id AS VARCHAR), minutes FROM season)""")
def club_report_payloads(spark, sf_dir):
    """What all sections of each payload hold."""
    t, _, teams, seasons, matches = _dims(spark, sf_dir)
    season = t.team_season()
    identity = views.v_team_season(season, teams, seasons)
    p = payloads.club_report_payloads(identity, windows.club_percentiles(season, config.CLUB_METRICS), t.style(), views.team_match_log(t.team_match(), matches, teams), t.season())
    return _sections(p, ["season_id", "team_id"], {"percentiles": lambda e: (e["metric_key"], e["percentile"]), "style": lambda e: (e["dimension"], e["score"]), "log": lambda e: (e["match_id"], e["xg"]), "squad": lambda e: (e["player_id"], e["minutes"])})


@query(f"""SELECT * FROM ({O.PLAYER_MATCH} SELECT match_id, 'players' AS section, CAST(player_id AS VARCHAR) AS key, passes AS value FROM pmm UNION ALL SELECT match_id, 'shots', CAST(minute AS VARCHAR), xg FROM ev WHERE type = 'SHOT')
UNION ALL SELECT * FROM ({_net('')} SELECT match_id, 'network_edges', player_id || '>' || to_id, count(*) FROM p WHERE to_id IS NOT NULL GROUP BY match_id, team_id, player_id, to_id HAVING count(*) >= 2
UNION ALL SELECT match_id, 'network_nodes', CAST(player_id AS VARCHAR), sum(given) FROM ends GROUP BY match_id, team_id, player_id)""")
def match_report_payloads(spark, sf_dir):
    """What all sections of each payload hold."""
    t, _, teams, seasons, matches = _dims(spark, sf_dir)
    nodes, edges, _ = spatial.passing_network(t.events)
    shots = t.events.where("type = 'SHOT'").select("match_id", "event_id", "team_id", "player_id", "minute", "x", "y", "shot.xg", "shot.is_goal")
    summary = matches.select("match_id", "season_id", "kickoff_at", "home_team_id", "away_team_id")
    p = payloads.match_report_payloads(summary, t.player_match(), shots, nodes, edges)
    pair = lambda e: F.concat(e["from_id"].cast("string"), F.lit(">"), e["to_id"].cast("string"))
    return _sections(p, ["match_id"], {"players": lambda e: (e["player_id"], e["passes"]), "shots": lambda e: (e["minute"], e["xg"]), "network_nodes": lambda e: (e["player_id"], e["passes"]), "network_edges": lambda e: (pair(e), e["passes"])})


def _schedules(spark):
    rows = [(1, 1, 24, "2024-01-10 12:00:00", True, None), (2, 2, 48, None, True, None)]
    return spark.createDataFrame(rows, "schedule_id int, season_id int, overlap_hours int, watermark string, enabled boolean, last_status string").withColumn("watermark", F.col("watermark").cast("timestamp_ntz"))


@query(f"{bridge.PRELUDE} SELECT match_id, CASE season_id WHEN 1 THEN 1 ELSE 2 END AS schedule_id FROM matches WHERE season_id = 2 OR kickoff_at >= TIMESTAMP '2024-01-09 12:00:00'")
def since_filter(spark, sf_dir):
    return incremental.since_filter(_dims(spark, sf_dir)[4], _schedules(spark)).select("match_id", "schedule_id")


@query(f"{bridge.PRELUDE} SELECT 1 AS schedule_id, max(kickoff_at) AS watermark FROM matches WHERE season_id = 1 UNION ALL SELECT 2, NULL")
def advance_watermark(spark, sf_dir):
    runs = spark.createDataFrame([(1, "COMPLETED"), (2, "PARTIAL")], "schedule_id int, status string")
    return incremental.advance_watermark(_schedules(spark), _dims(spark, sf_dir)[4], runs).select("schedule_id", "watermark")


@query(f"{O.SEASON} SELECT season_id, player_id, CAST(CASE WHEN season_id = 2 THEN minutes + 1 ELSE minutes END AS BIGINT) AS minutes FROM season")
def upsert(spark, sf_dir):
    s = Tables(spark, sf_dir).season().select("season_id", "player_id", "minutes")
    return incremental.upsert(s, s.where("season_id = 2").withColumn("minutes", F.col("minutes") + 1), ["season_id", "player_id"])


@query(f"{O.SEASON} SELECT season_id, player_id, CAST(CASE WHEN player_id % 20 = 0 THEN minutes + 1 ELSE minutes END AS BIGINT) AS minutes FROM season")
def upsert_keyed(spark, sf_dir):
    """A table by buckets of players, after rows of every twentieth player are replaced; one row is new."""
    s, path = Tables(spark, sf_dir).kept_season.select("season_id", "player_id", "minutes"), _scratch(spark, "keyed")
    incremental.write_keyed(s.where("player_id <> 40"), path, ["player_id", "season_id"], 32)
    incremental.upsert_keyed(path, s.where("player_id % 20 = 0").withColumn("minutes", F.col("minutes") + 1), ["player_id", "season_id"], buckets=32)
    return spark.read.parquet(path).select("season_id", "player_id", "minutes")


@query("SELECT event_id, ts, user_id FROM events")
def stream_events(spark, sf_dir):
    """All events as a stream of files, loaded twice into one table: once each."""
    source = bridge.read(spark, sf_dir, "events").schema
    target = _scratch(spark, "stream")
    for run in ("a", "b"):
        stream = incremental.stream_events(spark, f"{sf_dir}/events*.parquet", source, overlap="40 days", keys=("event_id",), format="parquet")
        rows = stream.select("event_id", "ts", "user_id", F.to_date("ts").alias("day"))
        incremental.load_stream(rows, f"{target}/table", f"{target}/{run}", keys=("event_id",), partition="day").awaitTermination()
    return spark.read.parquet(f"{target}/table").select("event_id", F.col("ts").cast("timestamp_ntz").alias("ts"), "user_id")


_BLANKED = "CASE WHEN o_orderkey % 2 = 0 THEN ' ' END"


@query(f"""WITH o AS (SELECT *, {_BLANKED} AS remark, NULL AS mark FROM orders), ids AS (SELECT o_custkey AS id, count(*) AS n FROM o GROUP BY o_custkey HAVING count(*) > 1)
SELECT 'rows' AS item, CAST(NULL AS BIGINT) AS id, count(*) AS n FROM o UNION ALL SELECT 'columns', NULL, 8
UNION ALL SELECT 'blank: remark', NULL, 1 FROM o HAVING count(nullif(trim(remark), '')) = 0 UNION ALL SELECT 'blank: mark', NULL, 1 FROM o HAVING count(mark) = 0
UNION ALL SELECT 'repeated id', id, n FROM ids""")
def profile_file(spark, sf_dir):
    """A file's rows, columns, blank columns (white space and nulls alone) and each repeated id with its count."""
    orders = bridge.read(spark, sf_dir, "orders").selectExpr("*", f"{_BLANKED} AS remark", "CAST(NULL AS STRING) AS mark")
    one, repeated = sinks.profile_file(orders, "o_custkey")
    item = lambda name, n: F.struct(F.lit(name).alias("item"), F.lit(None).cast("bigint").alias("id"), n.cast("bigint").alias("n"))
    blank = F.transform("blank_columns", lambda c: F.struct(F.concat(F.lit("blank: "), c).alias("item"), F.lit(None).cast("bigint").alias("id"), F.lit(1).cast("bigint").alias("n")))
    counted = one.select(F.explode(F.concat(F.array(item("rows", F.col("rows")), item("columns", F.col("columns"))), blank)).alias("e")).select("e.*")
    return counted.unionByName(repeated.select(F.lit("repeated id").alias("item"), F.col("id").cast("bigint").alias("id"), "n"))


def _sums(prelude: str, *tables: tuple[str, str, str]) -> str:
    """SQL of (name, season_id, n, total) for tables (name, common table expression, a sum of integers)."""
    one = " UNION ALL ".join(f"SELECT '{n}' AS name, CAST(season_id AS INT) AS season_id, count(*) AS n, CAST(sum({c}) AS BIGINT) AS total FROM {t} GROUP BY season_id" for n, t, c in tables)
    return f"SELECT * FROM ({prelude} {one})"


_TENTHS = "CAST(floor({} * 10 + 0.5) AS BIGINT)"
_DERIVED = [
    (O.PERCENTILES.format(minutes=60, order=""), ("player_match_metrics", "pmm", "passes"), ("player_season_metrics", "season", "minutes"), ("data_quality", "season", "matches"), ("player_percentiles", "vp", _TENTHS.format("percentile")), ("model_percentiles", "pct", _TENTHS.format("percentile"))),
    (O.ROLE_SCORES, ("role_scores", "roles", _TENTHS.format("score"))),
    (O.FIT + ", every AS (SELECT p.season_id, p.player_id, t.team_id, coalesce(fit_score, 0) AS fit_score FROM (SELECT DISTINCT season_id, player_id FROM dna) p JOIN (SELECT DISTINCT season_id, team_id FROM style) t ON t.season_id = p.season_id LEFT JOIN fit f ON f.season_id = p.season_id AND f.player_id = p.player_id AND f.team_id = t.team_id)",
     ("team_match_metrics", "tm", "passes"), ("team_season_metrics", "tsm", "matches"), ("player_profiles", "dna", _TENTHS.format("score")), ("team_style", "style", _TENTHS.format("score")), ("club_fit", "every", _TENTHS.format("fit_score"))),
    (_ZONES.replace("z AS (SELECT player_id,", "z AS (SELECT season_id, team_id, player_id,").replace("za AS (SELECT player_id,", "za AS (SELECT season_id, team_id, player_id,"), ("zone_statistics", "za", "passes")),
    (f"{O.LONG}, {_COS.format(k='player_id', v='percentile', t='pct', g='a.season_id,', on='a.season_id = b.season_id AND a.position_group = b.position_group AND a.metric_key = b.metric_key')}, best AS (SELECT season_id, similarity FROM sim QUALIFY row_number() OVER (PARTITION BY season_id, s ORDER BY similarity DESC, c) <= 10)", ("similarity", "best", "CAST(floor(similarity * 10000 + 0.5) AS BIGINT)")),
]
_MEASURED = {
    "player_match_metrics": ("passes", 1), "player_season_metrics": ("minutes", 1), "data_quality": ("matches", 1), "player_percentiles": ("percentile", 10), "model_percentiles": ("percentile", 10), "role_scores": ("score", 10),
    "team_match_metrics": ("passes", 1), "team_season_metrics": ("matches", 1), "player_profiles": ("score", 10), "team_style": ("score", 10), "club_fit": ("fit_score", 10), "zone_statistics": ("passes", 1), "similarity": ("similarity", 10000),
}


def _derived(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return t, R.recompute({"events": t.events, "appearances": t.appearances}, _scratch(spark, "recompute"), min_minutes=60)


def _measured(out: dict[str, DataFrame]) -> DataFrame:
    """(name, season_id, n, total): rows and a sum of each derived table by season."""
    part = lambda n, c, k: out[n].groupBy("season_id").agg(F.count("*").alias("n"), F.sum(F.floor(F.col(c) * k + 0.5)).cast("bigint").alias("total")).select(F.lit(n).alias("name"), F.col("season_id").cast("int").alias("season_id"), "n", "total")
    parts = [part(n, c, k) for n, (c, k) in _MEASURED.items()]
    assert out.keys() == _MEASURED.keys()
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return every


@query(" UNION ALL ".join(_sums(*x) for x in _DERIVED))
def recompute(spark, sf_dir):
    """All derived tables written by season and read back: rows and a sum of each by season."""
    return _measured(_derived(spark, sf_dir)[1])


@query(" UNION ALL ".join(_sums(*x) for x in _DERIVED))
def refresh_matches(spark, sf_dir):
    """The tables of a season whose last match lacked events and two of whose appearances were other, after a refresh of that match."""
    t, path = Tables(spark, sf_dir), _scratch(spark, "refresh")
    last = t.flat.where("season_id = 2").agg(F.max("match_id").alias("match_id"))
    mine = F.col("match_id").eqNullSafe(last.first()["match_id"])
    before = t.events.where(~mine | (F.col("event_id") % 3 != 0))
    played = t.appearances.withColumn("minutes", (F.col("minutes") + F.when(mine, F.col("player_id") % 2).otherwise(0)).cast("int"))
    R.recompute({"events": before, "appearances": played}, path, min_minutes=60)
    return _measured(R.refresh({"events": t.events, "appearances": t.appearances}, path, last, min_minutes=60))


@query(f"{O.SEASON} SELECT position_group, count(*) AS players, max(minutes) AS most FROM season GROUP BY position_group")
def analyst_select(spark, sf_dir):
    """An analyst's SELECT over a registered view."""
    R.register_views({"vw_player_season_stats": Tables(spark, sf_dir).season()})
    return R.run_select(spark, "SELECT position_group, count(*) AS players, max(minutes) AS most FROM vw_player_season_stats GROUP BY position_group")[0]


# --- exports and archives, written and read back


@query("SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, o_orderstatus, o_orderpriority FROM orders")
def export_csv(spark, sf_dir):
    target = _scratch(spark, "csv")
    sinks.export_csv(bridge.read(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority"), target)
    return spark.read.csv(target, header=True, escape='"')


@query("SELECT p_partkey, p_name, p_size FROM part")
def export_json(spark, sf_dir):
    target = _scratch(spark, "json")
    parts = bridge.read(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size")
    sinks.export_json(parts, target)
    return spark.read.schema(parts.schema).json(target)


@query("""SELECT 'INSERT INTO "customer" ("c_custkey", "c_name") VALUES (' || c_custkey || ', ''' || replace(c_name, '''', '''''') || ''');' AS value FROM customer""")
def export_sql(spark, sf_dir):
    target = _scratch(spark, "sql")
    sinks.export_sql(bridge.read(spark, sf_dir, "customer").select("c_custkey", "c_name"), target, "customer")
    return spark.read.text(target)


@query(f"{bridge.PRELUDE}, raw AS (SELECT event_id AS e, props FROM events) SELECT match_id, count(*) AS n, min(props) AS least FROM ev JOIN raw ON e = event_id GROUP BY match_id")
def archive_raw(spark, sf_dir):
    target = _scratch(spark, "raw")
    raw = bridge.read(spark, sf_dir, "events").select("event_id", F.col("props").alias("payload"))
    sinks.write_raw(_events(spark, sf_dir).select("event_id", F.col("match_id").alias("match_external_id")).join(raw, "event_id").drop("event_id"), target, "p1", "i1")
    back = spark.read.schema("payload string, provider string, import_id string, match_external_id bigint").json(target)
    return back.groupBy(F.col("match_external_id").alias("match_id")).agg(F.count("*").alias("n"), F.min("payload").alias("least"))


_COUNTED = {
    "players": (O.SEASON, "season JOIN players USING (player_id) JOIN seasons USING (season_id)"), "player_match_stats": (O.PLAYER_MATCH, "pmm JOIN players USING (player_id) JOIN teams USING (team_id) JOIN matches USING (match_id)"),
    "player_percentiles": (O.PERCENTILES.format(minutes=60, order=""), "vp JOIN players USING (player_id)"), "teams": (O.TEAM_SEASON, "tsm JOIN teams USING (team_id)"), "team_match_stats": (O.TEAM_MATCH, "tm JOIN teams USING (team_id)"),
    "matches": (bridge.PRELUDE, "matches JOIN teams h ON h.team_id = home_team_id JOIN teams a ON a.team_id = away_team_id"), "events": (bridge.PRELUDE, "ev"), "metrics": (O.LONG, "long JOIN players USING (player_id)"),
    "heatmap_zones": (_DERIVED[3][0], "za"), "roles": (O.ROLE_SCORES, "roles JOIN players USING (player_id)"), "similarity": (_DERIVED[4][0], "best"),
    "club_fit": (_DERIVED[2][0], "every JOIN players USING (player_id) JOIN teams USING (team_id)"), "tracking_aggregates": (f"WITH {bridge.TRACK}", "(SELECT DISTINCT player_id FROM track)"), "shortlists": ("", "orders WHERE o_orderstatus = 'O'"),
}


@query(" UNION ALL ".join(f"SELECT * FROM ({prelude} SELECT '{name}' AS dataset, count(*) AS n FROM {source})" for name, (prelude, source) in _COUNTED.items()))
def named_dataset(spark, sf_dir):
    """The rows of every export by name, over the analyst views of the recomputed tables."""
    t, players, teams, seasons, matches = _dims(spark, sf_dir)
    _, out = _derived(spark, sf_dir)
    shown = R.analyst_views(out, {"players": players, "teams": teams, "matches": matches, "seasons": seasons, "appearances": t.appearances, "events": t.flat})
    shortlists = bridge.read(spark, sf_dir, "orders").where("o_orderstatus = 'O'").select(F.col("o_custkey").alias("player_id"), F.col("o_orderkey").alias("shortlist_id"))
    R.register_views(shown | {"events": t.flat, "tracking_aggregates": tracking.player_physical(bridge.tracking(spark, sf_dir)), "shortlists": shortlists})
    parts = [R.dataset(spark, name).agg(F.count("*").alias("n")).select(F.lit(name).alias("dataset"), "n") for name in R.DATASETS]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return every


@query(f"{bridge.PRELUDE}, z AS (SELECT {_KEY3} AS zone_key FROM ev) SELECT k AS zone_key, count(z.zone_key) AS n FROM (SELECT DISTINCT t || '/' || l AS k FROM (VALUES {O.values([(x,) for x in S.THIRDS])}) a(t), (VALUES {O.values([(x,) for x in S.LANES])}) b(l)) LEFT JOIN z ON z.zone_key = k GROUP BY k")
def all_zones(spark, sf_dir):
    """Events in each zone of the pitch, empty zones included."""
    own = _events(spark, sf_dir).select(S.zone_of(F.col("x"), F.col("y"))["key"].alias("key")).groupBy("key").agg(F.count("*").alias("n"))
    return S.all_zones(spark).select("key").join(own, "key", "left").select(F.col("key").alias("zone_key"), F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))
