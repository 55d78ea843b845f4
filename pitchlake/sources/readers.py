"""Readers of provider files. Schemas are declared, files are read by Spark's own sources, ids of matches come from paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import clock_ms, map_event_type, minutes_from_spells
from . import ranges

_NAMED = "struct<id:bigint,name:string>"
_WORD = "struct<name:string>"
#: Events in a 120 x 80 space, as far as they are used.
EVENTS_120X80 = f"""id string, index bigint, period int, timestamp string, minute int, second int, type {_NAMED}, possession bigint, possession_team {_NAMED}, play_pattern {_WORD}, team {_NAMED}, player {_NAMED},
  location array<double>, duration double, under_pressure boolean, counterpress boolean,
  pass struct<recipient:{_NAMED},length:double,angle:double,height:{_WORD},end_location:array<double>,body_part:{_WORD},type:{_WORD},outcome:{_WORD},cross:boolean,switch:boolean,cut_back:boolean,shot_assist:boolean,goal_assist:boolean,technique:{_WORD}>,
  shot struct<statsbomb_xg:double,end_location:array<double>,outcome:{_WORD},body_part:{_WORD},technique:{_WORD},type:{_WORD},first_time:boolean>, carry struct<end_location:array<double>>,
  dribble struct<outcome:{_WORD},nutmeg:boolean,overrun:boolean>, duel struct<type:{_WORD},outcome:{_WORD}>, foul_committed struct<advantage:boolean,penalty:boolean,card:{_WORD}>,
  clearance struct<body_part:{_WORD}>, ball_recovery struct<recovery_failure:boolean>, substitution struct<replacement:{_NAMED}>"""


#: Words for parts of the body; others become UNKNOWN.
BODY_PARTS = {"Right Foot": "RIGHT_FOOT", "Left Foot": "LEFT_FOOT", "Head": "HEAD", "Other": "OTHER", "Drop Kick": "OTHER", "Keeper Arm": "OTHER"}


def folder_id(folder: str, path: Column | None = None) -> Column:
    """What stands after a folder's name in a row's path: a file without its ending, or a folder of part files, also `key=value`."""
    path = path if path is not None else F.col("_metadata.file_path")
    return F.regexp_extract(path, rf".*/{folder}/(?:[^/=]+=)?([^/.]+)", 1)


def _body_part(c: str) -> Column:
    out = F.lit("UNKNOWN")
    for word, name in BODY_PARTS.items():
        out = F.when(F.col(c) == word, name).otherwise(out)
    return out.alias("body_part")


def _text(c: str) -> Column:
    return F.col(c).cast("string")


def _truth(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(False))


def derive_details(raw: DataFrame) -> DataFrame:
    """Provider events with a nullable struct for each kind of detail: a pass without an outcome is completed, a key pass
    assists a shot, and a duel's type and result are told by the words in its names."""
    has = lambda c, s: F.when(F.col(c).isNotNull(), s)
    word = lambda c: F.coalesce(F.col(c), F.lit(""))
    height = F.regexp_replace(F.upper(word("pass.height.name")), " PASS", "")
    pass_ = F.struct(
        _text("pass.recipient.id").alias("recipient_external_id"), F.coalesce("pass.length", F.lit(0.0)).alias("length_m"), F.coalesce("pass.angle", F.lit(0.0)).alias("angle_rad"), F.when(height == "", "UNKNOWN").otherwise(height).alias("height"),
        F.col("pass.technique.name").alias("technique"), _body_part("pass.body_part.name"), (word("pass.outcome.name") == "").alias("completed"), _truth("pass.cross").alias("is_cross"), _truth("pass.switch").alias("is_switch"),
        (word("pass.technique.name") == "Through Ball").alias("is_through_ball"), _truth("pass.cut_back").alias("is_cutback"), (_truth("pass.shot_assist") | _truth("pass.goal_assist")).alias("is_key_pass"), _truth("pass.goal_assist").alias("is_assist"),
    )
    outcome, kind = word("shot.outcome.name"), word("shot.type.name")
    shot = F.struct(
        F.coalesce("shot.statsbomb_xg", F.lit(0.0)).alias("xg"), F.col("shot.statsbomb_xg").alias("provider_xg"), (kind == "Penalty").alias("is_penalty"), kind.isin("Free Kick", "Corner", "Penalty").alias("is_set_piece"), (outcome == "Goal").alias("is_goal"),
        outcome.isin("Goal", "Saved", "Saved to Post").alias("on_target"), (outcome == "Blocked").alias("blocked"), _truth("shot.first_time").alias("first_time"), (word("shot.body_part.name") == "Head").alias("is_header"), _body_part("shot.body_part.name"), F.col("shot.technique.name").alias("technique"),
        *(F.get("shot.end_location", F.lit(i)).alias(n) for i, n in enumerate(("end_x", "end_y", "end_z"))),
    )
    duel, won = word("duel.type.name"), word("duel.outcome.name")
    return raw.select(
        _text("id").alias("provider_event_id"), "match_external_id", _text("team.id").alias("team_external_id"), _text("player.id").alias("player_external_id"), _text("possession_team.id").alias("possession_team_external_id"),
        map_event_type(F.col("type.name"), "120x80").alias("type"), F.col("type.name").alias("sub_type"), "minute", "second", "period", F.col("index").alias("sequence"), clock_ms(F.col("timestamp")).alias("timestamp_ms"),
        F.get("location", F.lit(0)).alias("x"), F.get("location", F.lit(1)).alias("y"), F.get(F.coalesce("pass.end_location", "carry.end_location"), F.lit(0)).alias("end_x"), F.get(F.coalesce("pass.end_location", "carry.end_location"), F.lit(1)).alias("end_y"),
        F.coalesce("pass.outcome.name", "shot.outcome.name", "dribble.outcome.name", "duel.outcome.name").alias("outcome"), _truth("under_pressure").alias("under_pressure"), F.col("duration").alias("duration_sec"), F.col("play_pattern.name").alias("play_pattern"), F.col("possession").alias("possession_id"),
        has("pass", pass_).alias("pass"), has("shot", shot).alias("shot"), has("dribble", F.struct((word("dribble.outcome.name") == "Complete").alias("completed"), _truth("dribble.nutmeg").alias("nutmeg"), _truth("dribble.overrun").alias("overrun"))).alias("dribble"),
        has("duel", F.struct(F.when(duel.contains("Aerial"), "AERIAL").when(duel.contains("Tackle"), "TACKLE").otherwise("GROUND").alias("duel_type"), (won.contains("Won") | won.contains("Success")).alias("won"))).alias("duel"),
        has("foul_committed", F.struct(F.lit(True).alias("committed"), _truth("foul_committed.advantage").alias("advantage"), _truth("foul_committed.penalty").alias("penalty"))).alias("foul"),
        has("foul_committed.card", F.struct(F.when(F.col("foul_committed.card.name") == "Yellow Card", "YELLOW").otherwise("RED").alias("card_type"))).alias("card"),
        has("ball_recovery", F.struct(_truth("ball_recovery.recovery_failure").alias("failed"))).alias("recovery"),
        F.when(F.col("type.name") == "Pressure", F.struct(F.coalesce("duration", F.lit(0.0)).alias("duration_sec"), _truth("counterpress").alias("counterpress"))).alias("pressure"),
        has("substitution", F.struct(_text("substitution.replacement.id").alias("replacement_external_id"))).alias("substitution"),
    )


def read_events_120x80(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """Events of files <path>/events/<match>.json, or of folders of part files named so; stream: as a stream of arriving files."""
    source = spark.readStream if stream else spark.read
    raw = source.schema(EVENTS_120X80).option("recursiveFileLookup", True).option("multiLine", True).json(f"{path}/events")
    return derive_details(raw.select("*", folder_id("events").alias("match_external_id")))


def read_match_index(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """competitions, seasons, matches, teams, players and lineups of a tree of index files."""
    comp = spark.read.schema("competition_id bigint, season_id bigint, country_name string, competition_name string, competition_gender string, competition_international boolean, season_name string").json(f"{path}/competitions.json", multiLine=True)
    first = Window.partitionBy("competition_id").orderBy("season_id")
    competitions = comp.withColumn("_n", F.row_number().over(first)).where("_n = 1").select(
        _text("competition_id").alias("external_id"), F.col("competition_name").alias("name"), F.col("country_name").alias("country"), F.when(F.col("competition_international"), "INTERNATIONAL").otherwise("LEAGUE").alias("type"), F.when(F.col("competition_gender") == "female", "FEMALE").otherwise("MALE").alias("gender")
    )
    seasons = comp.select(_text("season_id").alias("external_id"), _text("competition_id").alias("competition_external_id"), F.col("season_name").alias("name"))
    side = lambda s: f"{s}_team struct<{s}_team_id:bigint,{s}_team_name:string,country:{_WORD}>"
    raw = spark.read.schema(f"match_id bigint, match_date string, kick_off string, competition struct<competition_id:bigint,country_name:string>, season struct<season_id:bigint,season_name:string>, {side('home')}, {side('away')}, home_score int, away_score int, match_week int, competition_stage {_WORD}, stadium {_WORD}, referee {_WORD}").option("recursiveFileLookup", True).json(f"{path}/matches", multiLine=True)
    raw = raw.withColumn("_path", F.col("_metadata.file_path"))
    matches = raw.select(
        _text("match_id").alias("external_id"), folder_id("matches", F.col("_path")).alias("competition_external_id"), folder_id("matches/[^/]+", F.col("_path")).alias("season_external_id"), _text("home_team.home_team_id").alias("home_team_external_id"), _text("away_team.away_team_id").alias("away_team_external_id"),
        F.concat("match_date", F.lit("T"), F.coalesce("kick_off", F.lit("00:00:00.000"))).alias("kickoff_at"), "home_score", "away_score", F.col("match_week").alias("matchweek"), F.col("competition_stage.name").alias("stage"), F.col("stadium.name").alias("venue"), F.col("referee.name").alias("referee"),
    )
    team = lambda s: raw.select(_text(f"{s}_team.{s}_team_id").alias("external_id"), F.col(f"{s}_team.{s}_team_name").alias("name"), F.coalesce(f"{s}_team.country.name", "competition.country_name").alias("country"), F.struct("match_date", "match_id").alias("_at"))
    last = F.struct("name", "country")
    teams = merge_sources(team("home"), team("away")).groupBy("external_id").agg(F.max_by(last, "_at").alias("t")).select("external_id", "t.*")
    spells = "array<struct<position:string,from:string,to:string,start_reason:string>>"
    lineup = spark.read.schema(f"team_id bigint, team_name string, formation int, lineup array<struct<player_id:bigint,player_name:string,player_nickname:string,jersey_number:int,country:{_WORD},positions:{spells}>>").option("recursiveFileLookup", True).json(f"{path}/lineups", multiLine=True)
    each = lineup.select(folder_id("lineups").alias("match_external_id"), _text("team_id").alias("team_external_id"), _text("formation").alias("formation"), F.explode("lineup").alias("p"))
    lineups = each.select(
        "match_external_id", "team_external_id", "formation", _text("p.player_id").alias("player_external_id"), F.get("p.positions", F.lit(0))["position"].alias("position"), F.col("p.jersey_number").alias("shirt_number"),
        F.coalesce(F.get("p.positions", F.lit(0))["start_reason"] == "Starting XI", F.lit(False)).alias("is_starter"), minutes_from_spells(F.col("p.positions")).alias("minutes_played"),
    )
    words = F.split("p.player_name", " ")
    person = F.struct(words[0].alias("first_name"), F.coalesce(F.when(F.size(words) > 1, F.array_join(F.slice(words, 2, 100), " ")), words[0]).alias("last_name"), F.col("p.player_name").alias("full_name"), F.col("p.player_nickname").alias("known_as"), F.col("p.country.name").alias("nationality"), F.get("p.positions", F.lit(0))["position"].alias("position"), "team_external_id")
    players = each.groupBy(_text("p.player_id").alias("external_id")).agg(F.min_by(person, "match_external_id").alias("x")).select("external_id", "x.*")
    return {"competitions": competitions, "seasons": seasons, "matches": matches, "teams": teams, "players": players, "lineups": lineups}


def merge_sources(*frames: DataFrame) -> DataFrame:
    """All rows of several sources; columns that one lacks are null."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def _game(path: Column) -> Column:
    return F.regexp_extract(path, r"(?i)game[_=]+(\d+)", 1)


def _either(v: Column, *fields: str) -> Column:
    """A text that is either the value itself or one of an object's fields."""
    inner = [F.try_variant_get(v, f"$.{f}", "string") for f in fields]
    kind = F.schema_of_variant(v)
    return F.when(kind == "STRING", v.cast("string")).when(kind.startswith("OBJECT"), F.coalesce(*inner))


def read_events_normalized(spark: SparkSession, path: str, files: str = "*_events.json") -> DataFrame:
    """Events in a 0..1 space of files whose path names the game (Game_<n>): an array, or an object with the array under data; types and persons
    are texts or objects."""
    files = spark.read.option("pathGlobFilter", files).option("recursiveFileLookup", True).text(path, wholetext=True).select(F.col("_metadata.file_path").alias("_path"), F.try_parse_json("value").alias("v"))
    rows = F.coalesce(F.try_variant_get("v", "$.data", "array<variant>"), F.try_variant_get("v", "$", "array<variant>"))
    e = files.select(_game(F.col("_path")).alias("game"), F.posexplode(rows).alias("n", "e"))
    get = lambda p, kind: F.try_variant_get("e", f"$.{p}", kind)
    raw = F.regexp_replace(F.upper(F.coalesce(_either(get("type", "variant"), "name"), F.lit(""))), r"\s+", "_")
    person = lambda p: _either(get(p, "variant"), "id", "name")
    ident = lambda c: F.when(c != "", F.concat_ws("-", F.lit("normalized"), "game", F.when(F.lower(c).startswith("away"), "away").otherwise("home"), c))
    seconds, kind = F.coalesce(get("start.time", "double"), F.lit(0.0)), map_event_type(raw, "normalized")
    match = F.concat(F.lit("normalized-"), "game")
    return e.select(
        F.concat_ws("-", match, F.coalesce(get("index", "bigint"), F.col("n").cast("bigint")).cast("string")).alias("provider_event_id"), match.alias("match_external_id"), F.when(get("team", "string") != "", F.concat_ws("-", F.lit("normalized"), "game", F.lower(get("team", "string")))).alias("team_external_id"),
        ident(person("from")).alias("player_external_id"), kind.alias("type"), _either(get("subtype", "variant"), "name").alias("sub_type"), F.floor(seconds / 60).cast("int").alias("minute"), F.floor(seconds % 60).cast("int").alias("second"), F.coalesce(get("period", "int"), F.lit(1)).alias("period"),
        F.floor(seconds * 1000 + 0.5).cast("bigint").alias("timestamp_ms"), get("start.x", "double").alias("x"), get("start.y", "double").alias("y"), get("end.x", "double").alias("end_x"), get("end.y", "double").alias("end_y"),
        F.when(kind == "PASS", F.struct(ident(person("to")).alias("recipient_external_id"), F.coalesce(person("to") != "", F.lit(False)).alias("completed"))).alias("pass"),
    )


_PLAYERS = "array<struct<playerId:string,xyz:array<double>>>"
#: Frames of tracking in a 0..1 space, and the keys that only frames have.
FRAMES_NORMALIZED = f"frameIdx bigint, period int, time double, ball struct<xyz:array<double>>, homePlayers {_PLAYERS}, awayPlayers {_PLAYERS}"
KEYS_NORMALIZED = ("frameIdx", "period", "time", "gameClock", "wallClock", "ball", "homePlayers", "awayPlayers")


def read_tracking_normalized(spark: SparkSession, path: str, files: str = "*_tracking.json") -> DataFrame:
    """Positions in a 0..1 space of files whose path names the game, a row for each frame and player."""
    raw = spark.read.schema(FRAMES_NORMALIZED).option("pathGlobFilter", files).option("recursiveFileLookup", True).json(path, multiLine=True)
    return _positions_normalized(raw.select("*", F.col("_metadata.file_path").alias("path")))


def read_large_tracking_normalized(spark: SparkSession, path: str, files: str = "*_tracking.json", size: int = ranges.RANGE) -> tuple[DataFrame, DataFrame]:
    """read_tracking_normalized() for files of any size: each is read in byte ranges, and parsed by all of their tasks. Also the
    frames that can't be parsed (path, start, record)."""
    frames, rejected = ranges.read_records(spark, path, files, KEYS_NORMALIZED, FRAMES_NORMALIZED, size)
    return _positions_normalized(frames), rejected


def _positions_normalized(raw: DataFrame) -> DataFrame:
    """A row for each frame and player of frames with their path."""
    player = _PLAYERS
    game = _game(F.col("path"))
    side = lambda c, s: F.transform(F.coalesce(c, F.array().cast(player)), lambda p: F.struct(F.lit(s).alias("side"), p["playerId"].alias("id"), F.get(p["xyz"], F.lit(0)).alias("x"), F.get(p["xyz"], F.lit(1)).alias("y")))
    rows = raw.select(game.alias("game"), "frameIdx", "period", "time", "ball", F.explode(F.concat(side("homePlayers", "home"), side("awayPlayers", "away"))).alias("p"))
    team = F.concat_ws("-", F.lit("normalized"), "game", "p.side")
    return rows.select(
        F.concat(F.lit("normalized-"), "game").alias("match_external_id"), F.col("frameIdx").alias("frame_index"), F.floor(F.coalesce("time", F.lit(0.0)) * 1000 + 0.5).cast("bigint").alias("timestamp_ms"), F.coalesce("period", F.lit(1)).alias("period"), F.col("ball.xyz").isNotNull().alias("ball_in_play"),
        F.get("ball.xyz", F.lit(0)).alias("ball_x"), F.get("ball.xyz", F.lit(1)).alias("ball_y"), F.concat_ws("-", team, "p.id").alias("player_external_id"), team.alias("team_external_id"), "p.x", "p.y",
    )


#: Frames of centre-origin tracking, and the keys that only frames have.
_OBJECTS = "array<struct<trackable_object:bigint,group_name:string,x:double,y:double,z:double>>"
FRAMES_CENTERED = f"frame bigint, timestamp string, period int, possession struct<group:string>, data {_OBJECTS}"
KEYS_CENTERED = ("frame", "timestamp", "period", "possession", "data", "image_corners_projection", "ball_data", "player_data")
#: Fixed value: the object number of the ball in centre-origin tracking.
BALL = 55


def read_tracking_centered(spark: SparkSession, path: str) -> DataFrame:
    """Positions of <path>/matches/<id>/structured_data.json with the origin at the centre, moved to the corner; players
    and teams come from match_data.json beside it."""
    raw = spark.read.schema(FRAMES_CENTERED).json(f"{path}/matches/*/structured_data.json", multiLine=True)
    return _positions_centered(spark, path, raw.select("*", F.col("_metadata.file_path").alias("path")))


def read_large_tracking_centered(spark: SparkSession, path: str, size: int = ranges.RANGE) -> tuple[DataFrame, DataFrame]:
    """read_tracking_centered() for files of any size, in byte ranges. Also the frames that can't be parsed (path, start, record)."""
    frames, rejected = ranges.read_records(spark, f"{path}/matches", "structured_data.json", KEYS_CENTERED, FRAMES_CENTERED, size)
    return _positions_centered(spark, path, frames), rejected


def _positions_centered(spark: SparkSession, path: str, raw: DataFrame) -> DataFrame:
    """A row for each frame and player of frames with their path."""
    of_match, frames = folder_id("matches"), raw.select("*", folder_id("matches", F.col("path")).alias("match_external_id"))
    about = spark.read.schema("home_team struct<id:bigint>, away_team struct<id:bigint>, players array<struct<id:bigint,trackable_object:bigint,team_id:bigint>>").json(f"{path}/matches/*/match_data.json", multiLine=True).select("*", of_match.alias("match_external_id"))
    sides = about.select("match_external_id", _text("home_team.id").alias("_home"), _text("away_team.id").alias("_away"))
    who = about.select("match_external_id", F.explode("players").alias("p")).select("match_external_id", F.coalesce("p.trackable_object", "p.id").alias("object"), F.coalesce("p.id", "p.trackable_object").cast("string").alias("player_external_id"), _text("p.team_id").alias("team_external_id")).dropDuplicates(["match_external_id", "object"])
    ball = F.get(F.filter("data", lambda d: (d["group_name"] == "ball") | (d["trackable_object"] == BALL)), F.lit(0))
    rows = frames.select("match_external_id", "frame", "timestamp", "period", "possession", ball.alias("ball"), F.explode(F.filter("data", lambda d: (d["trackable_object"] != 0) & (d["trackable_object"] != BALL))).alias("d"))
    joined = rows.withColumn("object", F.col("d.trackable_object")).join(sides, "match_external_id", "left").join(who, ["match_external_id", "object"], "left")
    owner = F.when(F.col("possession.group") == "home team", F.col("_home")).when(F.col("possession.group") == "away team", F.col("_away"))
    return joined.select(
        "match_external_id", F.col("frame").alias("frame_index"), clock_ms(F.col("timestamp"), "seconds").alias("timestamp_ms"), F.coalesce("period", F.lit(1)).alias("period"), (F.coalesce("timestamp", F.lit("")) != "").alias("ball_in_play"), owner.alias("possession_team_external_id"),
        (F.col("ball.x") + 52.5).alias("ball_x"), (F.col("ball.y") + 34).alias("ball_y"), "player_external_id", "team_external_id", (F.col("d.x") + 52.5).alias("x"), (F.col("d.y") + 34).alias("y"),
    )


#: Shapes of the saved responses of two vendors, by what they list.
DUMPS = {
    "data": {
        "leagues": "id bigint, name string, type string", "seasons": "id bigint, league_id bigint, name string, starting_at string, ending_at string", "teams": "id bigint, name string, short_code string, founded int",
        "players": "id bigint, firstname string, lastname string, display_name string, date_of_birth string, height int, weight int, position struct<name:string>",
        "fixtures": "id bigint, league_id bigint, season_id bigint, starting_at string, participants array<struct<id:bigint,name:string,meta:struct<location:string>>>, scores array<struct<description:string,score:struct<goals:int,participant:string>>>",
    },
    "response": {
        "leagues": "league struct<id:bigint,name:string,type:string>, country struct<name:string>, seasons array<struct<year:int,start:string,end:string>>", "teams": "team struct<id:bigint,name:string,code:string,country:string,founded:int>",
        "players": "player struct<id:bigint,name:string,firstname:string,lastname:string,birth:struct<date:string>,nationality:string,height:string>, statistics array<struct<games:struct<position:string>>>",
        "fixtures": "fixture struct<id:bigint,date:string,venue:struct<name:string>>, league struct<id:bigint,season:bigint,round:string>, teams struct<home:struct<id:bigint>,away:struct<id:bigint>>, goals struct<home:int,away:int>",
    },
}


def read_api_dump(spark: SparkSession, path: str, vendor: str) -> dict[str, DataFrame]:
    """competitions, seasons, teams, players and matches of saved responses <path>/<what>*.json. vendor: the envelope, "data" or "response"."""
    read = lambda what: spark.read.schema(f"{vendor} array<struct<{_fields(DUMPS[vendor][what])}>>").option("pathGlobFilter", f"{what}*.json").json(path, multiLine=True).select(F.explode(vendor).alias("r")).select("r.*")
    cup = lambda c: F.when(F.lower(c) == "cup", "CUP").otherwise("LEAGUE").alias("type")
    if vendor == "data":
        seasons, players, fixtures = read("seasons"), read("players"), read("fixtures")
        name = F.coalesce("display_name", F.trim(F.concat_ws(" ", "firstname", "lastname")))
        at = lambda side: F.get(F.filter("participants", lambda t: t["meta"]["location"] == side), F.lit(0))["id"].cast("string")
        goals = lambda side: F.get(F.filter("scores", lambda s: (s["description"] == "CURRENT") & (s["score"]["participant"] == side)), F.lit(0))["score"]["goals"]
        return {
            "competitions": read("leagues").select(_text("id").alias("external_id"), "name", F.when(F.col("type") == "cup", "CUP").otherwise("LEAGUE").alias("type")),
            "seasons": seasons.select(_text("id").alias("external_id"), _text("league_id").alias("competition_external_id"), "name", F.col("starting_at").alias("start_date"), F.col("ending_at").alias("end_date")),
            "teams": read("teams").select(_text("id").alias("external_id"), "name", F.col("short_code").alias("short_name"), "founded"),
            "players": players.select(_text("id").alias("external_id"), F.coalesce("firstname", name).alias("first_name"), F.coalesce("lastname", F.lit("")).alias("last_name"), name.alias("full_name"), F.col("date_of_birth"), F.col("height").alias("height_cm"), F.col("weight").alias("weight_kg"), F.col("position.name").alias("position")),
            "matches": fixtures.select(_text("id").alias("external_id"), _text("league_id").alias("competition_external_id"), _text("season_id").alias("season_external_id"), F.coalesce(at("home"), F.lit("")).alias("home_team_external_id"), F.coalesce(at("away"), F.lit("")).alias("away_team_external_id"), F.col("starting_at").alias("kickoff_at"), goals("home").alias("home_score"), goals("away").alias("away_score")),
        }
    leagues = read("leagues")
    return {
        "competitions": leagues.select(_text("league.id").alias("external_id"), F.col("league.name").alias("name"), F.col("country.name").alias("country"), cup(F.col("league.type"))),
        "seasons": leagues.select(_text("league.id").alias("competition_external_id"), F.explode("seasons").alias("s")).select(_text("s.year").alias("external_id"), "competition_external_id", F.concat_ws("/", _text("s.year"), (F.col("s.year") + 1).cast("string")).alias("name"), F.col("s.start").alias("start_date"), F.col("s.end").alias("end_date")),
        "teams": read("teams").select(_text("team.id").alias("external_id"), F.col("team.name").alias("name"), F.col("team.code").alias("short_name"), F.col("team.country").alias("country"), F.col("team.founded").alias("founded")),
        "players": read("players").select(_text("player.id").alias("external_id"), F.coalesce("player.firstname", "player.name").alias("first_name"), F.coalesce("player.lastname", F.lit("")).alias("last_name"), F.col("player.name").alias("full_name"), F.col("player.birth.date").alias("date_of_birth"), F.col("player.nationality").alias("nationality"), F.regexp_replace("player.height", r"[^\d]", "").try_cast("int").alias("height_cm"), F.get("statistics", F.lit(0))["games"]["position"].alias("position")),
        "matches": read("fixtures").select(_text("fixture.id").alias("external_id"), _text("league.id").alias("competition_external_id"), _text("league.season").alias("season_external_id"), _text("teams.home.id").alias("home_team_external_id"), _text("teams.away.id").alias("away_team_external_id"), F.col("fixture.date").alias("kickoff_at"), F.col("goals.home").alias("home_score"), F.col("goals.away").alias("away_score"), F.col("fixture.venue.name").alias("venue"), F.col("league.round").alias("stage")),
    }


def _fields(ddl: str) -> str:
    """Fields of a table as fields of a struct."""
    out, depth, name = [], 0, True
    for c in ddl:
        depth += (c == "<") - (c == ">")
        if c == " " and not depth and name and out and out[-1] not in ",":
            out.append(":")
            name = False
        elif c == "," and not depth:
            out.append(",")
            name = True
        elif c != " ":
            out.append(c)
    return "".join(out)


CSV_COLUMNS = {
    "teams": {"external_id": ["external_id", "id", "name"], "name": ["name"], "short_name": ["short_name"], "country": ["country"]},
    "players": {"external_id": ["external_id", "id", "full_name", "name"], "full_name": ["full_name", "name"], "date_of_birth": ["date_of_birth"], "nationality": ["nationality"], "height_cm": ["height_cm"], "position": ["position"], "team_external_id": ["team_external_id", "team_id"]},
    "events": {"external_id": ["external_id"], "match_external_id": ["match_external_id", "match_id"], "team_external_id": ["team_external_id", "team_id"], "player_external_id": ["player_external_id", "player_id"], "type": ["type"], "minute": ["minute"], "second": ["second"], "period": ["period"], "x": ["x"], "y": ["y"], "end_x": ["end_x"], "end_y": ["end_y"], "outcome": ["outcome"]},
}


def read_csv_inbox(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """teams, players and events of CSV files whose names start with what they hold; cells are trimmed, blank rows dropped."""
    out = {}
    for kind, columns in CSV_COLUMNS.items():
        raw = spark.read.option("pathGlobFilter", f"{kind}*.csv").csv(path, header=True, multiLine=True, quote='"', escape='"', mode="PERMISSIVE")
        cells = [F.trim(F.col(f"`{c}`")) for c in raw.columns]
        full = F.coalesce(*(F.nullif(c, F.lit("")) for c in cells), F.lit("")) != "" if cells else F.lit(False)
        have = {c.strip().lower(): c for c in raw.columns}
        cell = lambda names: F.coalesce(*(F.nullif(F.trim(F.col(f"`{have[n]}`")), F.lit("")) for n in names if n in have), F.lit(None).cast("string"))
        of = [F.col("_metadata.file_path").alias("_file"), (F.xxhash64(*cells) if cells else F.lit(0)).alias("_hash")] if kind == "events" else []
        rows = raw.where(full).select(*(cell(names).alias(c) for c, names in columns.items()), *of)
        if kind == "players":
            words = F.split("full_name", " ")
            rows = rows.withColumns({"first_name": words[0], "last_name": F.array_join(F.slice(words, 2, 100), " "), "height_cm": F.col("height_cm").try_cast("double")})
        if kind == "events":
            # without an id: the file's name, a hash of the row, and a number among equal rows; the same in each run
            equal = F.row_number().over(Window.partitionBy("_file", "_hash").orderBy(F.lit(0)))
            n = F.concat_ws("-", F.lit("csv"), F.regexp_extract("_file", r"([^/]*?)(?:\.csv)?$", 1), F.hex("_hash"), equal.cast("string"))
            rows = rows.withColumns({"external_id": F.coalesce("external_id", n), "type": F.upper(F.coalesce("type", F.lit("OTHER"))), **{c: F.coalesce(F.col(c).try_cast("int"), F.lit(d)) for c, d in (("minute", 0), ("second", 0), ("period", 1))}, **{c: F.col(c).try_cast("double") for c in ("x", "y", "end_x", "end_y")}}).drop("_file", "_hash")
        out[kind] = rows
    return out


BUNDLE = {
    "teams": "external_id string, name string, short_name string, country string", "players": "external_id string, full_name string, date_of_birth string, nationality string, height_cm double, position string, team_external_id string",
    "matches": "external_id string, competition_external_id string, season_external_id string, home_team_external_id string, away_team_external_id string, kickoff_at string, home_score int, away_score int",
    "events": "external_id string, match_external_id string, team_external_id string, player_external_id string, type string, minute int, second int, period int, x double, y double, end_x double, end_y double, outcome string",
}


def read_json_bundle(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """teams, players, matches and events of all bundles of a folder; keys are camel case."""
    from ..functions.scalars import to_camel

    camel = {k: ", ".join(f"{to_camel(f.split(' ')[0])} {f.split(' ')[1]}" for f in v.split(", ")) for k, v in BUNDLE.items()}
    raw = spark.read.schema(", ".join(f"{k} array<struct<{_fields(v)}>>" for k, v in camel.items())).option("pathGlobFilter", "*.json").json(path, multiLine=True)
    return {k: raw.select(F.explode(k).alias("r")).select(*(F.col(f"r.{to_camel(f.split(' ')[0])}").alias(f.split(" ")[0]) for f in v.split(", "))) for k, v in BUNDLE.items()}
