"""Analyst views: facts with the names of players, teams, seasons and competitions. Dimensions are small and broadcast
by Spark where their size allows; facts are joined on their own keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import age_years
from ..plans.config import METRICS, STYLE


def resolve_ids(events: DataFrame, mapping: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Adds internal ids. mapping: entity_type, external_id, internal_id; columns: external column -> entity type."""
    for column, kind in columns.items():
        ids = mapping.where(F.col("entity_type") == kind).select(F.col("external_id").alias(column), F.col("internal_id").alias(column.replace("_external_id", "_id")))
        events = events.join(ids, column, "left")
    return events


def new_events(incoming: DataFrame, stored: DataFrame, keys: tuple[str, ...] = ("provider_id", "provider_event_id"), prune: str | None = "match_id") -> DataFrame:
    """Events that aren't stored yet, once each. The stored side is cut to the matches of the batch before the join."""
    if prune and prune in stored.columns and prune in incoming.columns:
        stored = stored.join(incoming.select(prune).distinct(), prune, "left_semi")
    return incoming.dropDuplicates(list(keys)).join(stored.select(*keys), list(keys), "left_anti")


def wide_events(base: DataFrame, **details: DataFrame) -> DataFrame:
    """Events with each detail table packed into a struct, null where it has no row."""
    for name, rows in details.items():
        fields = [c for c in rows.columns if c != "event_id"]
        base = base.join(rows.select("event_id", F.struct(*fields).alias(name)), "event_id", "left")
    return base


def v_player_match(appearances: DataFrame, metrics: DataFrame, players: DataFrame, teams: DataFrame, matches: DataFrame, seasons: DataFrame) -> DataFrame:
    """Each appearance with names and, where there are any, metrics."""
    facts = metrics.drop(*(c for c in metrics.columns if c in appearances.columns and c not in ("match_id", "player_id")))
    return (
        appearances.join(players.select("player_id", "full_name"), "player_id").join(teams.select("team_id", "team_name"), "team_id").join(matches.select("match_id", "kickoff_at", "home_team_id", "away_team_id"), "match_id")
        .join(seasons.select("season_id", "season_name", "competition_name"), "season_id").join(facts, ["match_id", "player_id"], "left")
    )


def v_player_season(season: DataFrame, players: DataFrame, teams: DataFrame, seasons: DataFrame) -> DataFrame:
    """Season metrics with identity, and the age at the season's end."""
    named = season.join(players.select("player_id", "full_name", "birth_date", "foot", "height_cm", F.col("country").alias("nationality")), "player_id").join(teams.select("team_id", "team_name"), "team_id", "left")
    return named.join(seasons, "season_id").withColumn("age", age_years(F.col("birth_date"), F.coalesce("end_date", F.current_date())))


def v_player_per90(player_season: DataFrame) -> DataFrame:
    """The season view with a row for each metric."""
    ids = ["player_id", "full_name", "season_id", "season_name", "competition_name", "position_group", "team_id", "minutes", "matches"]
    return player_season.unpivot(ids, METRICS, "metric_key", "value")


def v_team_match(team_match: DataFrame, teams: DataFrame, matches: DataFrame, seasons: DataFrame) -> DataFrame:
    m = matches.select("match_id", "kickoff_at", "home_team_id")
    return team_match.join(teams.select("team_id", "team_name"), "team_id").join(m, "match_id").join(seasons.select("season_id", "season_name", "competition_name"), "season_id").withColumn("is_home", F.col("team_id") == F.col("home_team_id")).drop("home_team_id")


def v_team_season(team_season: DataFrame, teams: DataFrame, seasons: DataFrame) -> DataFrame:
    return team_season.join(teams, "team_id").join(seasons.select("season_id", "season_name", "competition_name"), "season_id")


def v_match_summary(matches: DataFrame, team_match: DataFrame, teams: DataFrame, seasons: DataFrame, events: DataFrame) -> DataFrame:
    """Matches with names, both teams' metrics, and the number of events (0 kept)."""
    count = events.groupBy("match_id").agg(F.count("*").alias("event_count"))
    out = matches.join(seasons.select("season_id", "season_name", "competition_name"), "season_id")
    for side in ("home", "away"):
        out = out.join(teams.select(F.col("team_id").alias(f"{side}_team_id"), F.col("team_name").alias(f"{side}_team")), f"{side}_team_id")
        facts = team_match.select("match_id", F.col("team_id").alias(f"{side}_team_id"), *(F.col(c).alias(f"{side}_{c}") for c in ("xg", "possession", "shots", "ppda")))
        out = out.join(facts, ["match_id", f"{side}_team_id"], "left")
    return out.join(count, "match_id", "left").fillna(0, ["event_count"])


def v_roles(ranked: DataFrame, players: DataFrame, seasons: DataFrame) -> DataFrame:
    return ranked.join(players.select("player_id", "full_name"), "player_id").join(seasons.select("season_id", "season_name"), "season_id", "left")


def v_similarity(similar: DataFrame, players: DataFrame) -> DataFrame:
    one, other = (players.select(F.col("player_id").alias(i), F.col("full_name").alias(n)) for i, n in (("player_id", "player_name"), ("comparison_player_id", "comparison_player_name")))
    return similar.join(one, "player_id").join(other, "comparison_player_id")


def v_fit(fit: DataFrame, players: DataFrame, teams: DataFrame, seasons: DataFrame) -> DataFrame:
    return fit.join(players.select("player_id", "full_name"), "player_id").join(teams.select("team_id", "team_name"), "team_id").join(seasons.select("season_id", "season_name"), "season_id", "left").withColumn("interpretation_note", F.lit("A model's output, not a fact"))


def v_zones(zones: DataFrame, players: DataFrame, teams: DataFrame) -> DataFrame:
    return zones.join(players.select("player_id", "full_name"), "player_id", "left").join(teams.select("team_id", "team_name"), "team_id", "left")


def v_team_style(profiles: DataFrame, teams: DataFrame, seasons: DataFrame) -> DataFrame:
    """Style profiles with a column for each dimension."""
    named = profiles.join(teams.select("team_id", "team_name"), "team_id").join(seasons.select("season_id", "season_name", "competition_name"), "season_id")
    return named.select("season_id", "season_name", "competition_name", "team_id", "team_name", *(F.col("style")[d].alias(d) for d in STYLE), F.col("matches").alias("sample_matches"), "confidence")


def known_seasons(seasons: DataFrame, matches: DataFrame) -> DataFrame:
    """Seasons that hold matches, newest first."""
    return seasons.join(matches.select("season_id"), "season_id", "left_semi").orderBy(F.desc("season_name"), "season_id")


def event_lineage(events: DataFrame, providers: DataFrame, versions: DataFrame, imports: DataFrame) -> DataFrame:
    """Where each event came from: provider, version, import and, where known, source dataset."""
    return events.join(providers, "provider_id").join(imports, "import_id").join(versions, "version_id").select("event_id", "provider_id", "provider_name", "version_id", "import_id", "source_dataset")


def player_match_log(player_match: DataFrame, matches: DataFrame, teams: DataFrame) -> DataFrame:
    """A player's matches with opponent, venue and score from the own team's side."""
    return _log(player_match, matches, teams)


def team_match_log(team_match: DataFrame, matches: DataFrame, teams: DataFrame) -> DataFrame:
    """A team's matches with opponent, venue and score from its side."""
    return _log(team_match, matches, teams)


def _log(facts: DataFrame, matches: DataFrame, teams: DataFrame) -> DataFrame:
    home = F.col("team_id") == F.col("home_team_id")
    rows = facts.join(matches.select("match_id", "kickoff_at", "home_team_id", "away_team_id", "home_score", "away_score"), "match_id")
    sided = rows.withColumns({"is_home": home, "opponent_id": F.when(home, F.col("away_team_id")).otherwise(F.col("home_team_id")), "goals_for": F.when(home, F.col("home_score")).otherwise(F.col("away_score")), "goals_against": F.when(home, F.col("away_score")).otherwise(F.col("home_score"))})
    return sided.join(teams.select(F.col("team_id").alias("opponent_id"), F.col("team_name").alias("opponent")), "opponent_id", "left").drop("home_team_id", "away_team_id", "home_score", "away_score")
