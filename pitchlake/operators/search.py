"""Browsing, searching, comparing and counting."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import age_approx, jsround
from . import ngrams


def browse_events(events: DataFrame, match_id=None, player_id=None, team_id=None, types: list[str] | None = None, minutes: tuple[int | None, int | None] = (None, None), limit: int = 100, offset: int = 0) -> tuple[DataFrame, DataFrame]:
    """A page of events in order of minute, second and sequence; and the number of all that fit."""
    for column, value in (("match_id", match_id), ("player_id", player_id), ("team_id", team_id)):
        if value is not None:
            events = events.where(F.col(column) == value)
    if types:
        events = events.where(F.col("type").isin(*types))
    if minutes[0] is not None:
        events = events.where(F.col("minute") >= minutes[0])
    if minutes[1] is not None:
        events = events.where(F.col("minute") <= minutes[1])
    page = events.orderBy("minute", "second", "sequence", "event_id").offset(offset).limit(limit)
    return page, events.agg(F.count("*").alias("total"))


def leaderboard(percentiles: DataFrame, metric: str, season_id=None, position: str | None = None, min_minutes: int = 0, limit: int = 20) -> DataFrame:
    """The best of a metric by percentile."""
    rows = percentiles.where((F.col("metric_key") == metric) & (F.col("minutes") >= min_minutes))
    if season_id is not None:
        rows = rows.where(F.col("season_id") == season_id)
    if position:
        rows = rows.where(F.col("position_group") == position)
    return rows.orderBy(F.desc("percentile"), F.desc("value"), "season_id", "player_id").limit(limit)


@dataclass
class Search:
    """What to look for. metrics: metric -> (operator, value or pair of values); a repeated metric counts once, the last."""

    metrics: dict[str, tuple] = field(default_factory=dict)
    name: str | None = None
    position: str | None = None
    season_id: int | None = None
    age: tuple[int | None, int | None] = (None, None)
    height: tuple[int | None, int | None] = (None, None)
    foot: str | None = None
    nationality: str | None = None
    min_minutes: int = 0
    sort: str = "minutes"
    descending: bool = True
    limit: int = 25
    offset: int = 0


def _within(c: Column, bounds: tuple) -> Column:
    out = F.lit(True)
    out = out & (c >= bounds[0]) if bounds[0] is not None else out
    return out & (c <= bounds[1]) if bounds[1] is not None else out


def search_players(
    season: DataFrame, players: DataFrame, what: Search, percentiles: DataFrame | None = None, at: Column | None = None, aliases: DataFrame | None = None,
    index: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """A page of players' seasons that fit, and their number. Percentile tests join the percentiles of the same season; a
    name is looked for in full names and in aliases (player_id, alias). index: the stored ngrams.postings() of both in lower
    case; only players whose name it names are looked at then."""
    if index is not None and what.name:
        asked = season.sparkSession.createDataFrame([(what.name.lower(),)], "term string")
        named = ngrams.containing(index, asked).select("label")
        of = lambda rows, c: rows.join(named, F.lower(rows[c]) == F.col("label"), "left_semi").select("player_id")
        ids = of(players, "full_name") if aliases is None else of(players, "full_name").unionByName(of(aliases, "alias"))
        players = players.join(ids, "player_id", "left_semi")
    rows = season.join(players.drop("position_group"), "player_id")
    test = {"gt": lambda c, v: c > v, "gte": lambda c, v: c >= v, "lt": lambda c, v: c < v, "lte": lambda c, v: c <= v, "eq": lambda c, v: c == v, "between": lambda c, v: c.between(*v)}
    for metric, (op, value) in what.metrics.items():
        if op == "percentile":
            found = percentiles.where((F.col("metric_key") == metric) & (F.col("percentile") >= value)).select("season_id", "player_id")
            rows = rows.join(found, ["season_id", "player_id"], "left_semi")
        else:
            rows = rows.where(test[op](F.col(metric), value))
    rows = rows.where(F.col("minutes") >= what.min_minutes).withColumn("age", age_approx(F.col("birth_date"), at if at is not None else F.current_date()))
    rows = rows.where(_within(F.col("age"), what.age) & _within(F.col("height_cm"), what.height))
    for column, value in (("position_group", what.position), ("season_id", what.season_id), ("foot", what.foot), ("country", what.nationality)):
        if value is not None:
            rows = rows.where(F.col(column) == value)
    if what.name:
        holds = lambda c: F.lower(c).contains(what.name.lower())
        if aliases is None:
            rows = rows.where(holds("full_name"))
        else:
            other = aliases.where(holds("alias")).select("player_id", F.lit(True).alias("_alias")).distinct()
            rows = rows.join(other, "player_id", "left").where(holds("full_name") | F.col("_alias")).drop("_alias")
    order = F.desc_nulls_last(what.sort) if what.descending else F.asc_nulls_last(what.sort)
    return rows.orderBy(order, "season_id", "player_id").offset(what.offset).limit(what.limit), rows.agg(F.count("*").alias("total"))


def global_search(term: str, sources: dict[str, tuple[DataFrame, str, str]], limit: int = 5, indexes: dict[str, DataFrame] | None = None) -> DataFrame:
    """(kind, id, label): the first of each source whose label holds the term. sources: kind -> (rows, id, label).

    indexes: for some kinds the stored ngrams.postings() of their labels in lower case; only rows whose label the index names are
    looked at then.
    """
    out = None
    for kind, (rows, key, label) in sources.items():
        if indexes and kind in indexes and term:
            asked = rows.sparkSession.createDataFrame([(term.lower(),)], "term string")
            rows = rows.join(ngrams.containing(indexes[kind], asked).select("label"), F.lower(rows[label]) == F.col("label"), "left_semi")
        part = rows.where(F.lower(label).contains(term.lower())).select(F.lit(kind).alias("kind"), F.col(key).cast("string").alias("id"), F.col(label).alias("label")).orderBy("label", "id").limit(limit)
        out = part if out is None else out.unionByName(part)
    return out


def compare_players(ids: list, season: DataFrame, percentiles: DataFrame, players: DataFrame, roles: DataFrame | None = None, fits: DataFrame | None = None, dna: DataFrame | None = None) -> DataFrame:
    """Two to five players side by side: their season with most minutes, percentiles, strengths from 70 and weaknesses to 30.

    Where given: the five best roles and club fits over all seasons, the profile of that season; metric_keys are those
    metrics that are not zero for all of them.
    """
    unique = _between(ids)
    chosen = lambda df: df.where(F.col("player_id").isin(*unique))
    best = Window.partitionBy("player_id").orderBy(F.desc("minutes"), "season_id")
    own = chosen(season).withColumn("_n", F.row_number().over(best)).where("_n = 1").drop("_n")
    rows = own.join(players.select("player_id", "full_name", "foot", "height_cm", F.col("country").alias("nationality")), "player_id")

    def listed(df: DataFrame, keys: list[str], name: str, order: Column, fields: list[str], most: int | None = None) -> DataFrame:
        every = F.array_sort(F.collect_list(F.struct(order.alias("o"), *fields)))  # of one player
        every = F.slice(every, 1, most) if most else every
        return chosen(df).groupBy(*keys).agg(F.transform(every, lambda e: e.dropFields("o")).alias(name))

    both = ["season_id", "player_id"]
    rows = rows.join(listed(percentiles, both, "percentiles", -F.col("percentile"), ["metric_key", "percentile"]), both, "left")
    if roles is not None:
        rows = rows.join(listed(roles, ["player_id"], "roles", -F.col("score"), ["season_id", "role_key", "score"], 5), "player_id", "left")
    if fits is not None:
        rows = rows.join(listed(fits, ["player_id"], "fits", -F.col("fit_score"), ["season_id", "team_id", "fit_score"], 5), "player_id", "left")
    if dna is not None:
        rows = rows.join(listed(dna, both, "profile", F.col("category"), ["category", "score"]), both, "left")
    all_of = Window.partitionBy(F.lit(1))  # of at most five rows
    shared = F.size(F.collect_set(F.struct("season_id", "position_group")).over(all_of)) == 1
    metrics = [c for c, t in season.dtypes if t == "double"]
    seen = F.array(*(F.when(F.max(F.abs(F.coalesce(F.col(c), F.lit(0.0)))).over(all_of) > 0, c) for c in metrics))
    weak = F.filter("percentiles", lambda e: e["percentile"] <= 30)
    strong = F.filter("percentiles", lambda e: e["percentile"] >= 70)
    return rows.select(
        "*", F.slice(strong, 1, 5).alias("strengths"), F.slice(F.reverse(weak), 1, 5).alias("weaknesses"), shared.alias("shared_population"), F.array_compact(seen).alias("metric_keys")
    )


def compare_teams(ids: list, team_season: DataFrame, club_percentiles: DataFrame, team_match: DataFrame, teams: DataFrame, style: DataFrame | None = None) -> DataFrame:
    """Two to five clubs side by side: the season with most matches, percentiles, defensive actions and crosses a match, and style scores where given."""
    unique = _between(ids)
    chosen = lambda df: df.where(F.col("team_id").isin(*unique))
    best = Window.partitionBy("team_id").orderBy(F.desc("matches"), "season_id")
    own = chosen(team_season).withColumn("_n", F.row_number().over(best)).where("_n = 1").drop("_n")
    ranked = chosen(club_percentiles).groupBy("season_id", "team_id").agg(F.array_sort(F.collect_list(F.struct("metric_key", "percentile"))).alias("percentiles"))
    defence = F.avg(F.col("tackles") + F.col("interceptions") + F.col("recoveries"))
    actions = chosen(team_match).groupBy("team_id").agg(jsround(defence, 2).alias("defensive_actions_per_match"), jsround(F.avg("crosses"), 2).alias("crosses_per_match"))
    size = team_season.groupBy("season_id").agg(F.count("*").alias("population_size"))
    rows = own.join(ranked, ["season_id", "team_id"], "left").join(actions, "team_id", "left").join(size, "season_id").join(teams.select("team_id", "team_name"), "team_id")
    if style is None:
        return rows
    scores = chosen(style).groupBy("season_id", "team_id").agg(F.array_sort(F.collect_list(F.struct("dimension", "score"))).alias("style"))
    return rows.join(scores, ["season_id", "team_id"], "left")


def _between(ids: list) -> list:
    unique = list(dict.fromkeys(ids))
    if not 2 <= len(unique) <= 5:
        raise ValueError("two to five can be compared")
    return unique


def strengths_risks(percentiles: DataFrame, strong: float = 75, weak: float = 30, most: int = 5) -> DataFrame:
    """The best metrics from `strong` and the worst to `weak` of each player's season, `most` of each."""
    part = lambda order: F.struct(order.alias("o"), "metric_key", "percentile")
    top = lambda test, order: F.transform(F.slice(F.array_sort(F.collect_list(F.when(test, part(order)))), 1, most), lambda e: e.dropFields("o"))
    return percentiles.groupBy("season_id", "player_id").agg(top(F.col("percentile") >= strong, -F.col("percentile")).alias("strengths"), top(F.col("percentile") <= weak, F.col("percentile")).alias("risks"))


def custom_score(percentiles: DataFrame, weights: DataFrame) -> DataFrame:
    """A weighted sum of percentiles by (metric_key, weight), 1 decimal."""
    return percentiles.join(weights, "metric_key").groupBy("season_id", "player_id").agg(jsround(F.sum(F.round(F.col("weight") * 100).cast("bigint") * F.floor(F.col("percentile") * 10 + 0.5)) / 1000.0, 1).alias("score"))


def event_distribution(events: DataFrame) -> DataFrame:
    return events.groupBy("type").agg(F.count("*").alias("n"))


def entity_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(entity, n) for each table."""
    out = None
    for name, rows in tables.items():
        one = rows.agg(F.count("*").alias("n")).select(F.lit(name).alias("entity"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def team_list(teams: DataFrame, season: DataFrame, team_season: DataFrame) -> DataFrame:
    """Teams with the size of their squad and the season with most matches."""
    squad = season.groupBy("team_id").agg(F.countDistinct("player_id").alias("squad_size"))
    best = team_season.groupBy("team_id").agg(F.max_by("season_id", F.struct("matches", -F.col("season_id"))).alias("main_season_id"))
    return teams.join(squad, "team_id", "left").join(best, "team_id", "left").fillna(0, ["squad_size"])


def rating_consensus(ratings: DataFrame, fields: list[str]) -> DataFrame:
    """The mean of each field, rounded, of players with more than one rating."""
    return ratings.groupBy("player_id").agg(F.count("*").alias("n_ratings"), *(jsround(F.avg(c)).alias(c) for c in fields)).where("n_ratings > 1")


def import_summary(records: DataFrame, errors: DataFrame) -> DataFrame:
    """Records by entity, errors and warnings, and the status of each import. records: import_id, entity; errors: import_id, severity."""
    done = records.groupBy("import_id").agg(F.count("*").alias("records"), F.count_if(F.col("entity") == "event").alias("events"), F.countDistinct("entity").alias("entities"))
    bad = errors.groupBy("import_id").agg(F.count_if(F.col("severity") == "ERROR").alias("errors"), F.count_if(F.col("severity") == "WARNING").alias("warnings"))
    rows = done.join(bad, "import_id", "full").fillna(0)
    return rows.withColumn("status", F.when((F.col("errors") > 0) & (F.col("records") == 0), "FAILED").when(F.col("errors") > 0, "PARTIAL").otherwise("COMPLETED"))
