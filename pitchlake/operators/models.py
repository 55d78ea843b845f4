"""Models over percentiles: profiles, roles, similarity, team style and club fit. Weights are rows of DataFrames.

Weighted means are summed in integers (tenths of percentiles, hundredths of weights), so that the order of summing
can't change a rounded score.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import assess_quality, jsround
from . import similarity
from .windows import percentile_at_or_below, unpivot


def _mean(value: str, weight: str) -> Column:
    w = F.round(F.col(weight) * 100).cast("bigint")
    tenths = F.floor(F.col(value) * 10 + 0.5).cast("bigint")
    return (F.sum(tenths * w).cast("double") / 1000.0) / (F.sum(w).cast("double") / 100.0)


def percentiles(season: DataFrame, metrics: list[str]) -> DataFrame:
    """Long inclusive percentiles of each season and position group, of players with any minutes; nulls are left out."""
    ids = ["season_id", "player_id", "team_id", "position_group", "minutes", "matches"]
    long = unpivot(season.select(*ids, *(F.col(m).cast("double").alias(m) for m in metrics)), metrics, ids)
    return percentile_at_or_below(long, ["season_id", "position_group", "metric_key"])


def style_vectors(pct: DataFrame) -> DataFrame:
    """vector: map from metric to percentile of a player's season."""
    return pct.groupBy("season_id", "player_id", "position_group").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("metric_key", "percentile")))).alias("vector"))


def player_dna(pct: DataFrame, weights: DataFrame, relevance: DataFrame) -> DataFrame:
    """score and coverage of each category that matters to the position and was measured."""
    defined = weights.groupBy("category").agg(F.sum("weight").alias("defined"))
    rows = pct.join(weights, "metric_key").join(defined, "category").join(relevance, ["position_group", "category"])
    part = F.struct("metric_key", "value", "percentile", "weight", jsround(F.col("percentile") * F.col("weight"), 2).alias("contribution"))
    return rows.groupBy("season_id", "player_id", "position_group", "category").agg(
        jsround(_mean("percentile", "weight"), 1).alias("score"), jsround(F.sum("weight") / F.first("defined"), 2).alias("coverage"), F.sort_array(F.collect_list(part)).alias("inputs")
    )


def role_scores(pct: DataFrame, roles: DataFrame, requirements: DataFrame) -> DataFrame:
    """score, coverage and breakdown of each role of a player's position group."""
    defined = requirements.groupBy("role_key").agg(F.sum("weight").alias("defined"))
    asked = roles.join(requirements, "role_key").join(defined, "role_key")
    rows = pct.join(asked, ["position_group", "metric_key"])
    rows = rows.withColumn("percentile", F.when(F.col("direction") == "LOWER_BETTER", jsround(100 - F.col("percentile"), 1)).otherwise(F.col("percentile")))
    contribution = jsround(F.col("percentile") * F.col("weight"), 2)
    part = F.struct((-contribution).alias("o"), "metric_key", "value", "percentile", "weight", contribution.alias("contribution"), F.coalesce(F.col("percentile") >= F.col("min_percentile"), F.lit(True)).alias("meets_minimum"))
    out = rows.groupBy("season_id", "player_id", "position_group", "minutes", "matches", "role_key", "role_name", "role_order", "min_minutes").agg(
        jsround(_mean("percentile", "weight"), 1).alias("score"), jsround(F.sum("weight") / F.first("defined"), 2).alias("coverage"), F.transform(F.sort_array(F.collect_list(part)), lambda p: p.dropFields("o")).alias("breakdown")
    )
    return out.withColumn("meets_minutes", F.col("minutes") >= F.col("min_minutes"))


def rank_roles(scores: DataFrame) -> DataFrame:
    """rank, is_primary, confidence of the sample, and margin_confidence of the first role over the second."""
    w = Window.partitionBy("season_id", "player_id").orderBy(F.desc("score"), "role_order")
    ranked = scores.select("*", F.row_number().over(w).alias("rank"), F.lead("score").over(w).alias("_next"))
    margin = F.when(F.col("_next").isNull(), F.col("score")).otherwise(F.greatest(F.lit(0.0), F.col("score") - F.col("_next")))
    return ranked.withColumns({
        "is_primary": (F.col("rank") == 1) & F.col("meets_minutes"), "confidence": assess_quality(F.col("minutes"), F.col("matches"), F.col("coverage"))["confidence"],
        "margin_confidence": F.when(F.col("rank") == 1, jsround(F.least(F.lit(1.0), margin / 20 * 0.6 + F.col("coverage") * 0.4), 2)),
    }).drop("_next")


def match_role(season: DataFrame, players: DataFrame, requirements: DataFrame, season_id: int, position: str, min_minutes: int = 450, limit: int = 50, filters: Column | None = None) -> DataFrame:
    """The best players for a draft role. The population is season, position and minutes; filters on players only narrow the list."""
    metrics = [c for c in season.columns if c.endswith("_p90") or c.endswith("_rate") or c in ("pass_accuracy", "xg_per_shot", "max_speed_ms")]
    pool = percentiles(season.where((F.col("season_id") == season_id) & (F.col("position_group") == position) & (F.col("minutes") >= min_minutes)), metrics)
    role = requirements.select(F.lit("draft").alias("role_key"), F.lit("Draft").alias("role_name"), F.lit(position).alias("position_group"), F.lit(min_minutes).alias("min_minutes"), F.lit(0).alias("role_order")).limit(1)
    scored = role_scores(pool, role, requirements.withColumn("role_key", F.lit("draft"))).join(players.select("player_id", *(c for c in players.columns if c not in season.columns and c != "player_id")), "player_id")
    return (scored.where(filters) if filters is not None else scored).orderBy(F.desc("score"), "player_id").limit(limit)


def weighted_cosine(a: Column, b: Column, weights: Column | None = None) -> Column:
    """Likeness of two aligned arrays of percentiles (null: not measured), 0 to 1, 4 decimals; 0 without a shared key, 1 for two averages."""
    pairs = F.zip_with(a, b, lambda x, y: F.when(x.isNotNull() & y.isNotNull(), F.struct((x - 50).alias("x"), (y - 50).alias("y"))))
    if weights is not None:
        pairs = F.zip_with(pairs, weights, lambda p, w: F.when(p.isNotNull(), F.struct((p["x"] * F.sqrt(w)).alias("x"), (p["y"] * F.sqrt(w)).alias("y"))))
    start = F.struct(F.lit(0.0).alias("d"), F.lit(0.0).alias("a"), F.lit(0.0).alias("b"), F.lit(0).alias("n"))
    step = lambda s, p: F.when(p.isNull(), s).otherwise(F.struct((s["d"] + p["x"] * p["y"]).alias("d"), (s["a"] + p["x"] * p["x"]).alias("a"), (s["b"] + p["y"] * p["y"]).alias("b"), (s["n"] + 1).alias("n")))

    def finish(s: Column) -> Column:
        norm = F.sqrt(s["a"]) * F.sqrt(s["b"])
        cosine = F.when(norm == 0, 1.0).otherwise(s["d"] / norm)
        return F.when(s["n"] == 0, 0.0).otherwise(jsround(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (cosine + 1) / 2)), 4))

    return F.aggregate(pairs, start, step, finish)


def similar_players(vectors: DataFrame, keys: list[str], limit: int = 10, weights: dict[str, float] | None = None, block: int = similarity.BLOCK) -> DataFrame:
    """The `limit` most similar players of the same season and position group, with what they agree and differ in most.

    vectors: season_id, player_id, position_group, vector (map). Groups are cut into blocks that meet as matrices; the best
    of each pair of blocks are kept before they meet, and details are made only for the final rows.
    """
    by = ["season_id", "position_group"]
    known = vectors.where(" AND ".join(f"{c} IS NOT NULL" for c in [*by, "player_id"]))
    # dealt here, so that what reads the vectors below reads one shuffle, and they are made once
    dense = known.select(*by, "player_id", F.array(*(F.col("vector")[k] for k in keys)).alias("v")).repartition(*by, "player_id")
    found = similarity.best_matches(dense, by, "player_id", [float((weights or {}).get(k, 1.0)) for k in keys], limit, block)
    order = Window.partitionBy(*by, "player_id").orderBy(F.desc("similarity"), "other")  # of a player's best, a few for each block
    top = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit).withColumnRenamed("other", "comparison_player_id")
    top = top.join(dense, [*by, "player_id"]).join(dense.select(*by, F.col("player_id").alias("comparison_player_id"), F.col("v").alias("o")), [*by, "comparison_player_id"])
    names = F.array(*map(F.lit, keys))
    difference = lambda k, p: F.struct(jsround(F.abs(p["x"] - p["y"]), 1).alias("difference"), k.alias("metric_key"), p["x"].alias("subject"), p["y"].alias("comparison"))
    compared = F.zip_with(names, F.zip_with("v", "o", lambda x, y: F.struct(x.alias("x"), y.alias("y"))), difference)
    # a column of its own, or it is made anew for each that is taken from it
    top, ordered = top.withColumn("_ordered", F.sort_array(F.filter(compared, lambda s: s["difference"].isNotNull()))), F.col("_ordered")
    last = F.reverse(F.slice(ordered, F.greatest(F.size(ordered) - 4, F.lit(1)), F.lit(5)))
    return top.select(
        *by, "player_id", "comparison_player_id", "rank", "similarity", F.size(ordered).alias("dimensions"), F.slice(ordered, 1, 5).alias("agreements"), last.alias("differences")
    )


def team_style(team_season: DataFrame, definition: DataFrame) -> DataFrame:
    """score of each dimension of each team and season; 0 and not measured where no input was."""
    names = [r["metric_key"] for r in definition.select("metric_key").distinct().collect()]  # of a small table of weights
    metrics = sorted(c for c in names if c in team_season.columns)
    long = unpivot(team_season.select("season_id", "team_id", *(F.col(m).cast("double").alias(m) for m in metrics)), metrics, ["season_id", "team_id"])
    rows = percentile_at_or_below(long, ["season_id", "metric_key"], small=True).join(definition, "metric_key")
    rows = rows.withColumn("percentile", F.when(F.col("inverted"), jsround(100 - F.col("percentile"), 1)).otherwise(F.col("percentile")))
    scores = rows.groupBy("season_id", "team_id", "dimension").agg(jsround(_mean("percentile", "weight"), 1).alias("_score"), F.sort_array(F.collect_list(F.struct("metric_key", "value", "percentile", "weight"))).alias("inputs"))
    dimensions = definition.groupBy().agg(F.sort_array(F.collect_set(F.struct("dimension_order", "dimension"))).alias("d")).first()["d"] or []  # of a small table of weights
    listed = F.array(*(F.struct(F.lit(r["dimension"]).alias("dimension"), F.lit(r["dimension_order"]).alias("dimension_order")) for r in dimensions))
    every = team_season.select("season_id", "team_id", "matches", F.explode(listed).alias("d")).select("season_id", "team_id", "matches", "d.*")
    return every.join(scores, ["season_id", "team_id", "dimension"], "left").select("season_id", "team_id", "matches", "dimension", "dimension_order", F.coalesce("_score", F.lit(0.0)).alias("score"), F.col("_score").isNotNull().alias("measured"), "inputs")


def style_profiles(style: DataFrame) -> DataFrame:
    """A row for each team and season: the map of scores, coverage and confidence."""
    out = style.groupBy("season_id", "team_id", "matches").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("dimension", "score")))).alias("style"), jsround(F.avg(F.col("measured").cast("int")), 2).alias("coverage"))
    return out.withColumn("confidence", assess_quality(F.col("matches") * 90, F.col("matches"), F.col("coverage"))["confidence"])


def club_fit(dna: DataFrame, style: DataFrame, demand: DataFrame) -> DataFrame:
    """fit_score of each player and team of a season, with the three largest gaps and strengths; 0 where nothing is asked.

    What a player supplies is one array by dimension, and so is what a team asks above the middle. The product of players
    and teams, which is the result, is made last and never moved: a player meets the teams of the season in one row.
    """
    supply = dna.join(demand, "category", "left").groupBy("season_id", "player_id", "dimension", "dimension_order", "label").agg(_mean("score", "weight").alias("supply"))
    part = F.struct("dimension_order", "dimension", "label", "supply")
    players = supply.groupBy("season_id", "player_id").agg(F.sort_array(F.collect_list(F.when(F.col("dimension").isNotNull(), part))).alias("supplies"))
    asked = F.when(F.col("score") > 50, F.struct(F.col("score").alias("demand"), jsround((F.col("score") - 50) / 50 * 25, 1).alias("max_points")))
    teams = style.groupBy("season_id", "team_id").agg(F.map_from_entries(F.collect_list(F.struct("dimension", asked.alias("a")))).alias("asked"))
    leagues = teams.groupBy("season_id").agg(F.collect_list(F.struct("team_id", "asked")).alias("teams"))  # of one season
    pairs = players.join(leagues, "season_id").select("season_id", "player_id", "supplies", F.explode("teams").alias("t")).select("season_id", "player_id", "t.team_id", "supplies", "t.asked")

    def component(s: Column) -> Column:
        a = F.col("asked")[s["dimension"]]
        points = jsround(s["supply"] / 100 * a["max_points"], 1)
        fields = {"n": s["dimension_order"], "dimension": s["dimension"], "label": s["label"], "demand": a["demand"], "supply": jsround(s["supply"], 1), "points": points, "max_points": a["max_points"]}
        return F.struct(*(v.alias(k) for k, v in fields.items()))

    wanted = F.filter("supplies", lambda s: F.col("asked")[s["dimension"]].isNotNull())
    scored = pairs.withColumn("parts", F.transform(wanted, component))
    tenths = lambda c: F.floor(c * 10 + 0.5).cast("bigint")
    total = lambda name: F.aggregate("parts", F.lit(0).cast("bigint"), lambda a, p: a + tenths(p[name]))

    def top(order) -> Column:
        keyed = F.transform("parts", lambda p: F.struct(order(p).alias("o"), p["n"].alias("n"), p.dropFields("n").alias("p")))
        return F.transform(F.slice(F.sort_array(keyed), 1, 3), lambda e: e["p"])

    fit = F.when(total("max_points") > 0, jsround(total("points") / total("max_points").cast("double") * 100, 1)).otherwise(0.0)
    none = F.size("parts") == 0
    gaps, strengths = top(lambda p: tenths(p["points"]) - tenths(p["max_points"])), top(lambda p: -tenths(p["points"]))
    return scored.select("season_id", "player_id", "team_id", fit.alias("fit_score"), F.when(~none, gaps).alias("gaps"), F.when(~none, strengths).alias("strengths"))
