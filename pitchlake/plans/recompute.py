"""The derived tables in order of dependence, all of them or what a change touches, the analyst's views over them, and SQL."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .. import ANALYTICS_VERSION
from ..functions.scalars import jsround
from ..operators import metrics, models, spatial, views, windows
from . import config

#: Tables with rows of single matches, made of the events and appearances of these matches alone.
BY_MATCH = ("player_match_metrics", "zone_statistics")
#: Weights that a caller may give, and the default of each.
WEIGHTS: dict[str, Callable[[SparkSession], DataFrame]] = {
    "profile_weights": config.profile_weights, "profile_relevance": config.profile_relevance, "roles": config.roles, "role_requirements": config.role_requirements, "style_weights": config.style_weights, "demand_model": config.demand_model,
}
#: Seasons that a refresh names at most before it looks at all of them.
NAMED = 1000

Step = tuple[tuple[str, ...], Callable[..., DataFrame]]


def steps(min_minutes: int = 450) -> dict[str, Step]:
    """The derived tables in order of dependence: what each is made of, and how. Below the match metrics each is made season by season."""

    def subjects(season: DataFrame) -> DataFrame:
        return metrics.quality_records(season).withColumn("season_id", F.element_at(F.split("subject_id", ":"), -1).cast("int"))

    def team_season(team_match: DataFrame) -> DataFrame:
        means = metrics.team_season_metrics(team_match)
        # 6 decimals, so that the order of summing can't part equal clubs
        return means.withColumns({c: jsround(F.col(c), 6) for c, kind in means.dtypes if kind == "double"})

    def percentiles(season: DataFrame) -> DataFrame:
        long = windows.unpivot(season, config.METRICS, ["season_id", "player_id", "team_id", "position_group", "minutes", "matches"])
        return windows.player_percentiles(long, min_minutes)

    return {
        "player_match_metrics": (("events", "appearances"), metrics.player_match_metrics),
        "player_season_metrics": (("player_match_metrics",), lambda match: metrics.player_season_metrics(metrics.player_season_totals(match))),
        "data_quality": (("player_season_metrics",), subjects),
        "team_match_metrics": (("player_match_metrics",), metrics.team_match_metrics),
        "team_season_metrics": (("team_match_metrics",), team_season),
        "player_percentiles": (("player_season_metrics",), percentiles),
        "model_percentiles": (("player_season_metrics",), lambda season: models.percentiles(season, config.METRICS)),
        "player_profiles": (("model_percentiles", "profile_weights", "profile_relevance"), models.player_dna),
        "role_scores": (("model_percentiles", "roles", "role_requirements"), lambda pct, roles, asked: models.rank_roles(models.role_scores(pct, roles, asked))),
        "similarity": (("model_percentiles",), lambda pct: models.similar_players(models.style_vectors(pct), config.METRICS)),
        "team_style": (("team_season_metrics", "style_weights"), models.team_style),
        "club_fit": (("player_profiles", "team_style", "demand_model"), models.club_fit),
        "zone_statistics": (("events",), lambda events: spatial.zone_activity(events, ["season_id", "match_id", "team_id", "player_id"])),
    }


class Store:
    """Derived tables as Parquet by season and version under a path; a table is read back for the next one."""

    def __init__(self, spark: SparkSession, path: str, version: str) -> None:
        self.spark, self.path, self.version = spark, path, version

    def read(self, name: str, seasons: list | None = None) -> DataFrame:
        rows = self.spark.read.parquet(f"{self.path}/{name}").where(F.col("analytics_version") == self.version)
        return rows if seasons is None else rows.where(F.col("season_id").isin(seasons))

    def write(self, name: str, rows: DataFrame) -> None:
        """Replaces the seasons that rows has, and no other."""
        out = rows.withColumn("analytics_version", F.lit(self.version)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        out.partitionBy("season_id", "analytics_version").parquet(f"{self.path}/{name}")

    def replace(self, name: str, rows: DataFrame, seasons: list) -> None:
        """Replaces the named seasons, of which rows are; those that rows has none of are dropped."""
        seen = Observation()
        count = lambda k: F.count_if(F.col("season_id") == seasons[k]).alias(f"n{k}")
        self.write(name, rows.observe(seen, *map(count, range(len(seasons)))))
        for k, season in enumerate(seasons):
            if not seen.get[f"n{k}"]:
                folder = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}/season_id={season}/analytics_version={self.version}")
                folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(folder, True)


def _inputs(tables: dict[str, DataFrame], spark: SparkSession) -> dict[str, DataFrame]:
    return tables | {name: default(spark) for name, default in WEIGHTS.items() if name not in tables}


def recompute(tables: dict[str, DataFrame], path: str, version: str = ANALYTICS_VERSION, min_minutes: int = 450) -> dict[str, DataFrame]:
    """All derived tables, for all seasons in one run, each written once as Parquet by season and read back for the next.

    tables: events (with detail structs), appearances (match_id, season_id, player_id, team_id, position_group, minutes,
    is_starter), and optionally roles, role_requirements, profile_weights, profile_relevance, style_weights, demand_model.
    """
    spark = tables["events"].sparkSession
    store, have, out = Store(spark, path, version), _inputs(tables, spark), {}
    for name, (inputs, make) in steps(min_minutes).items():
        store.write(name, make(*(have[i] for i in inputs)))
        out[name] = store.read(name)
        have[name] = out[name].drop("analytics_version")
    return out


def refresh(
    tables: dict[str, DataFrame], path: str, matches: DataFrame | None = None, changed: Iterable[str] = (), version: str = ANALYTICS_VERSION, min_minutes: int = 450
) -> dict[str, DataFrame]:
    """recompute() for what has changed since: its result, with only the tables and seasons rewritten that a change can reach.

    matches: match_id of the matches whose events or appearances are new, other or gone. changed: names of weights that are other.
    Tables of single matches are made anew for these matches alone, and put in place of their old rows. What is made of
    them is made anew for the seasons that these matches are in, or were. Weights reach the tables that are made with them
    and what those reach, in all seasons. All other tables and seasons are read as they are.
    """
    if matches is None:
        return _refresh(tables, path, None, changed, version, min_minutes)
    matches = matches.select("match_id").distinct().persist()  # asked for each table, and perhaps dear to find
    try:
        return _refresh(tables, path, matches, changed, version, min_minutes)
    finally:
        matches.unpersist()


def _refresh(tables: dict[str, DataFrame], path: str, matches: DataFrame | None, changed: Iterable[str], version: str, min_minutes: int) -> dict[str, DataFrame]:
    spark = tables["events"].sparkSession
    store, have, plan = Store(spark, path, version), _inputs(tables, spark), steps(min_minutes)
    if unknown := set(changed) - WEIGHTS.keys():
        raise ValueError(f"no weights {', '.join(sorted(unknown))}; there are {', '.join(WEIGHTS)}")
    whole, seasons = set(changed), []  # tables that are other in all seasons; the seasons in which matches are
    reached = {"events", "appearances"} if matches is not None else set()
    if matches is not None:
        own = lambda rows: rows.join(matches, "match_id", "left_semi")
        sources = [own(have["events"]), own(have["appearances"]), *(own(store.read(name)) for name in BY_MATCH)]
        found = sources[0].select("season_id")
        for rows in sources[1:]:
            found = found.unionByName(rows.select("season_id"))
        seasons = [r[0] for r in found.where("season_id is not null").distinct().limit(NAMED + 1).collect()]
        if len(seasons) > NAMED:
            raise ValueError(f"matches of more than {NAMED} seasons have changed: recompute() them")
    out: dict[str, DataFrame] = {}
    for name, (inputs, make) in plan.items():
        if whole & set(inputs):
            whole.add(name)
            store.write(name, make(*(have[i] for i in inputs)))
        elif reached & set(inputs) and seasons:
            reached.add(name)
            if name in BY_MATCH:
                new = make(*(own(have[i]) for i in inputs))
                old = store.read(name, seasons).drop("analytics_version").join(matches, "match_id", "left_anti")
                rows = old.unionByName(new.select(old.columns))
            else:
                rows = make(*(have[i] if i in WEIGHTS else have[i].where(F.col("season_id").isin(seasons)) for i in inputs))
            store.replace(name, rows, seasons)
        out[name] = store.read(name)
        have[name] = out[name].drop("analytics_version")
    return out


def analyst_views(tables: dict[str, DataFrame], dims: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The views over recompute()'s tables. dims: players, teams, matches, seasons, appearances, events."""
    d, t = dims, {k: v.drop("analytics_version") for k, v in tables.items()}
    player_season = views.v_player_season(t["player_season_metrics"], d["players"], d["teams"], d["seasons"])
    names = d["players"].select("player_id", "full_name")
    return {
        "vw_player_match_stats": views.v_player_match(d["appearances"], t["player_match_metrics"], d["players"], d["teams"], d["matches"], d["seasons"]), "vw_player_season_stats": player_season, "vw_player_per90": views.v_player_per90(player_season),
        "vw_player_percentiles": t["player_percentiles"].join(names, "player_id"), "vw_team_match_stats": views.v_team_match(t["team_match_metrics"], d["teams"], d["matches"], d["seasons"]),
        "vw_team_season_stats": views.v_team_season(t["team_season_metrics"], d["teams"], d["seasons"]), "vw_match_summary": views.v_match_summary(d["matches"], t["team_match_metrics"], d["teams"], d["seasons"], d["events"]),
        "vw_player_roles": views.v_roles(t["role_scores"], d["players"], d["seasons"]), "vw_player_similarity": views.v_similarity(t["similarity"], d["players"]),
        "vw_team_style_profiles": views.v_team_style(models.style_profiles(t["team_style"]), d["teams"], d["seasons"]), "vw_player_club_fit": views.v_fit(t["club_fit"], d["players"], d["teams"], d["seasons"]), "vw_heatmap_zone_activity": views.v_zones(t["zone_statistics"], d["players"], d["teams"]),
    }


#: What an export by name holds.
DATASETS = {
    "players": "vw_player_season_stats", "player_match_stats": "vw_player_match_stats", "player_percentiles": "vw_player_percentiles", "teams": "vw_team_season_stats", "team_match_stats": "vw_team_match_stats", "matches": "vw_match_summary",
    "events": "events", "metrics": "vw_player_per90", "heatmap_zones": "vw_heatmap_zone_activity", "roles": "vw_player_roles", "similarity": "vw_player_similarity", "club_fit": "vw_player_club_fit", "tracking_aggregates": "tracking_aggregates", "shortlists": "shortlists",
}


def register_views(tables: dict[str, DataFrame]) -> None:
    for name, rows in tables.items():
        rows.createOrReplaceTempView(name)


def dataset(spark: SparkSession, name: str) -> DataFrame:
    """A named export, of registered views."""
    if name not in DATASETS:
        raise ValueError(f"no dataset {name}; there are {', '.join(DATASETS)}")
    return spark.table(DATASETS[name])


def run_select(spark: SparkSession, sql: str, max_rows: int = 1000) -> tuple[DataFrame, bool]:
    """The first max_rows rows of a SELECT, and whether there are more."""
    rows = spark.sql(sql)
    return rows.limit(max_rows), rows.limit(max_rows + 1).count() > max_rows
