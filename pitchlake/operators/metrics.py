"""Player and team metrics, for all matches and seasons at once.

One grouped pass over the events gives the match metrics; its partial sums make a player with very many events harmless.
Everything after it works on rows of players and matches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import assess_quality, in_box, in_final_third, is_progressive, jsround, per90

LONG_PASS = 30.0
COUNTS = (
    "passes passes_completed progressive_passes passes_final_third passes_into_box key_passes through_balls switches crosses long_passes carries progressive_carries carries_final_third "
    "carries_into_box dribbles dribbles_completed progressive_actions chances_created touches touches_final_third touches_box shots shots_on_target goals assists tackles tackles_won interceptions "
    "pressures counterpressures recoveries blocks clearances defensive_duels defensive_duels_won aerial_duels aerial_duels_won fouls_committed"
).split()
SUMS = ["xa", "xg", "npxg"]
FAMILIES = ["passing", "shooting", "carrying", "defending", "pressing", "duels", "physical"]
TOTALS = "passes passes_completed shots goals xg assists tackles interceptions pressures touches".split()


def _flag(df: DataFrame, path: str, otherwise: Column | None = None) -> Column:
    """A detail's flag where the events have it, else the alternative or null."""
    outer, _, inner = path.partition(".")
    if outer in df.columns and inner in getattr(df.schema[outer].dataType, "names", ()):
        return F.coalesce(F.col(path), otherwise) if otherwise is not None else F.col(path)
    return otherwise if otherwise is not None else F.lit(None).cast("boolean")


def player_match_metrics(events: DataFrame, appearances: DataFrame | None = None, keys: tuple[str, ...] = ("match_id", "player_id")) -> DataFrame:
    """A row for each match and player: 38 counts, three sums, two ratios and the families that the source supports.

    events: type, x, y, end_x, end_y, and for each type a struct of details that may be null or absent. A detail's flag
    wins over geometry. With appearances (keys, team_id, minutes ...), players without events get zeros.
    """
    outcome = F.col("outcome") if "outcome" in events.columns else F.lit(None).cast("string")
    is_type = lambda *t: F.col("type").isin(*t)
    progressive = F.coalesce(is_progressive(F.col("x"), F.col("y"), F.col("end_x"), F.col("end_y")), F.lit(False))
    third, box = F.coalesce(in_final_third(F.col("end_x")), F.lit(False)), F.coalesce(in_box(F.col("end_x"), F.col("end_y")), F.lit(False))
    f = lambda path, other=None: _flag(events, path, other)
    done = is_type("PASS") & f("pass.completed", ~outcome.eqNullSafe("INCOMPLETE"))
    forward, carried = is_type("PASS") & done & f("pass.is_progressive", progressive), is_type("CARRY") & f("carry.is_progressive", progressive)
    touch = is_type("PASS", "SHOT", "CARRY", "DRIBBLE", "TOUCH", "CLEARANCE")
    aerial = is_type("DUEL") & F.coalesce(_value(events, "duel.duel_type", "string") == "AERIAL", F.lit(False))
    ground = is_type("DUEL") & ~aerial
    xg = F.when(is_type("SHOT"), _value(events, "shot.xg", "double"))
    won = lambda c: F.coalesce(f(c), F.lit(False))
    count = {
        "passes": is_type("PASS"), "passes_completed": done, "progressive_passes": forward, "passes_final_third": done & f("pass.into_final_third", third), "passes_into_box": done & f("pass.into_box", box),
        "key_passes": is_type("PASS") & f("pass.is_key_pass"), "through_balls": is_type("PASS") & f("pass.is_through_ball"), "switches": is_type("PASS") & f("pass.is_switch"), "crosses": is_type("PASS") & f("pass.is_cross"),
        "long_passes": is_type("PASS") & (_value(events, "pass.length_m", "double") >= LONG_PASS), "carries": is_type("CARRY"), "progressive_carries": carried,
        "carries_final_third": is_type("CARRY") & f("carry.into_final_third", third), "carries_into_box": is_type("CARRY") & f("carry.into_box", box), "dribbles": is_type("DRIBBLE"),
        "dribbles_completed": is_type("DRIBBLE") & f("dribble.completed", outcome.eqNullSafe("COMPLETE")), "progressive_actions": forward | carried, "chances_created": is_type("PASS") & f("pass.is_key_pass"),
        "touches": touch, "touches_final_third": touch & in_final_third(F.col("x")), "touches_box": touch & in_box(F.col("x"), F.col("y")), "shots": is_type("SHOT"),
        "shots_on_target": is_type("SHOT") & f("shot.on_target"), "goals": is_type("SHOT") & f("shot.is_goal"), "assists": is_type("PASS") & f("pass.is_assist"), "tackles": is_type("TACKLE"), "tackles_won": is_type("TACKLE") & f("tackle.won"),
        "interceptions": is_type("INTERCEPTION"), "pressures": is_type("PRESSURE"), "counterpressures": is_type("PRESSURE") & f("pressure.counterpress"), "recoveries": is_type("RECOVERY") & ~won("recovery.failed"),
        "blocks": is_type("BLOCK"), "clearances": is_type("CLEARANCE"), "defensive_duels": ground, "defensive_duels_won": ground & f("duel.won"), "aerial_duels": aerial, "aerial_duels_won": aerial & f("duel.won"),
        "fouls_committed": is_type("FOUL"),
    }
    total = lambda c: jsround(F.coalesce(F.sum(c), F.lit(0.0)), 3)
    family = {"passing": ["PASS"], "shooting": ["SHOT"], "carrying": ["CARRY", "DRIBBLE"], "defending": ["TACKLE", "INTERCEPTION", "RECOVERY", "BLOCK", "CLEARANCE"], "pressing": ["PRESSURE"], "duels": ["DUEL"]}
    grouped = events.where(F.col("player_id").isNotNull()).groupBy(*keys).agg(
        *(F.count_if(count[c]).alias(c) for c in COUNTS),
        total(F.when(is_type("PASS"), _value(events, "pass.xa", "double"))).alias("xa"), total(xg).alias("xg"), total(F.when(~won("shot.is_penalty"), xg)).alias("npxg"), F.coalesce(F.sum(xg), F.lit(0.0)).alias("_raw_xg"),
        F.struct(*(F.bool_or(is_type(*types)).alias(k) for k, types in family.items()), F.lit(False).alias("physical")).alias("available"),
    )
    if appearances is not None:
        none = F.struct(*(F.lit(False).alias(k) for k in FAMILIES))
        grouped = appearances.join(grouped, list(keys), "left").fillna(0, COUNTS).fillna(0.0, [*SUMS, "_raw_xg"]).withColumn("available", F.coalesce("available", none))
    ratio = lambda a, b: F.when(F.col(b) > 0, jsround(F.col(a) / F.col(b), 3)).otherwise(0.0)
    return grouped.withColumns({"pass_accuracy": ratio("passes_completed", "passes"), "xg_per_shot": ratio("_raw_xg", "shots")}).drop("_raw_xg")


def _value(df: DataFrame, path: str, kind: str) -> Column:
    outer, _, inner = path.partition(".")
    return F.col(path) if outer in df.columns and inner in getattr(df.schema[outer].dataType, "names", ()) else F.lit(None).cast(kind)


def player_season_totals(match_metrics: DataFrame, order: str = "match_id") -> DataFrame:
    """Sums of a player's season, with matches, starts, and team and position of the first appearance by `order`.

    match_metrics: with season_id, team_id, position_group, minutes and is_starter; rows without minutes don't count.
    Doubles are added up one match after the other by `order`: a sum whose order is open moves rates that end in a half.
    """
    first = lambda c: F.min_by(c, F.struct(order, "match_id")).alias(c)
    parts = F.struct(F.col(order).alias("o"), F.col("match_id").alias("m"), *(F.col(c).cast("double").alias(c) for c in SUMS))
    out = match_metrics.where("minutes > 0").groupBy("season_id", "player_id").agg(
        first("team_id"), first("position_group"), F.sum("minutes").alias("minutes"), F.count("*").alias("matches"), F.count_if("is_starter").alias("starts"), *(F.sum(c).alias(c) for c in COUNTS),
        F.sort_array(F.collect_list(parts)).alias("_parts"), F.struct(*(F.bool_or(f"available.{k}").alias(k) for k in FAMILIES)).alias("available"),
    )
    added = lambda c: F.aggregate("_parts", F.lit(None).cast("double"), lambda s, p: F.coalesce(s + p[c], s, p[c])).alias(c)
    out = out.select(*(c for c in out.columns if c not in ("_parts", "available")), *map(added, SUMS), "available")
    ratio = lambda a, b: F.when(F.col(b) > 0, jsround(F.col(a) / F.col(b), 3)).otherwise(0.0)
    return out.withColumns({"pass_accuracy": ratio("passes_completed", "passes"), "xg_per_shot": ratio("xg", "shots")})


RATES = "passes progressive_passes passes_final_third passes_into_box key_passes crosses long_passes progressive_carries carries_final_third carries_into_box dribbles progressive_actions xa chances_created touches touches_final_third touches_box shots shots_on_target goals xg npxg assists tackles interceptions pressures counterpressures recoveries blocks clearances defensive_duels aerial_duels".split()
SHARES = {"dribble_success_rate": ("dribbles_completed", "dribbles"), "tackle_success_rate": ("tackles_won", "tackles"), "defensive_duel_win_rate": ("defensive_duels_won", "defensive_duels"), "aerial_duel_win_rate": ("aerial_duels_won", "aerial_duels")}


def player_season_metrics(totals: DataFrame, physical: DataFrame | None = None, coverage: Column | None = None) -> DataFrame:
    """The 38 rates of each season and player, the totals that reports show, and the confidence.

    coverage: share of the metric families that the source supports, by default counted from the flags; lit(0) gives what
    a store without flags gives. physical: optional output of player_physical() by season and player.
    """
    from ..plans.config import METRICS, PHYSICAL

    share = lambda a, b: F.when(F.col(b) > 0, jsround(F.col(a) / F.col(b), 3)).otherwise(0.0)
    made = {f"{c}_p90": per90(F.col(c), F.col("minutes")) for c in RATES} | {k: share(*v) for k, v in SHARES.items()} | {c: F.col(c) for c in ("pass_accuracy", "xg_per_shot")}
    if coverage is None:
        coverage = sum((F.col(f"available.{k}").cast("int") for k in FAMILIES), F.lit(0)) / len(FAMILIES)
    out = totals.select(
        "season_id", "player_id", "team_id", "position_group", "minutes", "matches", "starts", *(made[m].alias(m) for m in METRICS), F.struct(*TOTALS).alias("totals"), assess_quality(F.col("minutes"), F.col("matches"), coverage)["confidence"].alias("confidence"),
    )
    if physical is not None:
        rate = {"distance_p90": "distance_m", "high_speed_distance_p90": "high_speed_distance_m", "sprint_count_p90": "sprint_count"}
        out = out.join(physical.withColumnsRenamed({v: f"_{v}" for v in [*rate.values(), "max_speed_ms"]}).select("season_id", "player_id", *(f"_{v}" for v in [*rate.values(), "max_speed_ms"])), ["season_id", "player_id"], "left")
        made = {k: F.when(F.col(f"_{v}").isNotNull(), per90(F.col(f"_{v}"), F.col("minutes"))) for k, v in rate.items()} | {"max_speed_ms": F.col("_max_speed_ms")}
        return out.withColumns(made).drop(*(f"_{v}" for v in [*rate.values(), "max_speed_ms"]))
    return out.withColumns({c: F.lit(None).cast("double") for c in PHYSICAL})


def quality_records(season: DataFrame) -> DataFrame:
    """A data-quality record for each season and player."""
    subject = F.concat_ws(":", F.col("player_id").cast("string"), F.col("season_id").cast("string"))
    return season.select(F.lit("PLAYER_SEASON").alias("subject_type"), subject.alias("subject_id"), "minutes", "matches", F.col("matches").alias("sample_size"), "confidence")


TEAM_SUMS = "passes passes_completed progressive_passes passes_final_third passes_into_box shots shots_on_target xg goals pressures counterpressures recoveries tackles interceptions crosses touches_final_third".split()


def with_opponent(team_match: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Each team's row with columns of the other team of the match, null without one. columns: name -> new name.

    The few teams of a match meet in a window over it, so the rows are made and moved once.
    """
    teams = F.collect_list(F.struct("team_id", *columns)).over(Window.partitionBy("match_id"))
    rows = team_match.withColumn("_teams", teams)
    other = F.array_min(F.filter("_teams", lambda t: t["team_id"] != F.col("team_id")))
    return rows.withColumn("_other", other).select(*team_match.columns, *(F.col("_other")[c].alias(n) for c, n in columns.items()))


def team_match_metrics(match_metrics: DataFrame) -> DataFrame:
    """A row for each match and team. Players without a team count for the match, and give no row."""
    match = Window.partitionBy("match_id")
    by = match_metrics.groupBy("match_id", "season_id", "team_id").agg(*(F.sum(c).alias(c) for c in TEAM_SUMS))
    whole = by.withColumns({"_passes": F.sum("passes").over(match), "_touches": F.sum("touches_final_third").over(match)})
    rows = with_opponent(whole.where("team_id is not null"), {"passes": "_opponent_passes"})
    share = lambda a, b, most, n: F.when(F.col(b) > 0, jsround(F.col(a) / F.col(b) * (most * 10**n)) / 10**n).otherwise(0.0)
    actions = F.col("tackles") + F.col("interceptions") + F.col("pressures")
    return rows.select(
        "match_id", "season_id", "team_id", share("passes", "_passes", 100, 1).alias("possession"), "passes", share("passes_completed", "passes", 1, 3).alias("pass_accuracy"), "progressive_passes",
        F.col("passes_final_third").alias("final_third_entries"), F.col("passes_into_box").alias("box_entries"), "shots", "shots_on_target", jsround(F.col("xg"), 3).alias("xg"), "goals", "pressures", "counterpressures",
        "recoveries", "tackles", "interceptions", "crosses", share("touches_final_third", "_touches", 100, 1).alias("field_tilt"),
        F.when(F.col("_opponent_passes").isNotNull() & (actions > 0), jsround(F.col("_opponent_passes") / actions, 2)).alias("ppda"), share("passes_final_third", "passes", 100, 1).alias("directness"),
    )


def team_season_metrics(team_match: DataFrame) -> DataFrame:
    """Averages of a team's matches, expected goals against, and the confidence."""
    mean = {"possession": "possession", "passes": "passes_p90", "pass_accuracy": "pass_accuracy", "progressive_passes": "progression_p90", "xg": "xg_p90", "shots": "shots_p90", "pressures": "pressures_p90", "recoveries": "recoveries_p90", "final_third_entries": "final_third_entries_p90", "box_entries": "box_entries_p90", "field_tilt": "field_tilt", "ppda": "ppda", "directness": "directness"}
    rows = with_opponent(team_match, {"xg": "_xg_against"})
    out = rows.groupBy("season_id", "team_id").agg(F.count("*").alias("matches"), *(F.avg(c).alias(n) for c, n in mean.items()), F.coalesce(F.avg("_xg_against"), F.lit(0.0)).alias("xg_against_p90"))
    return out.withColumn("confidence", assess_quality(F.col("matches") * 90, F.col("matches"))["confidence"])
