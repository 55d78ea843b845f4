"""Ranks within explicit populations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import jsround


def unpivot(season: DataFrame, metrics: list[str], ids: list[str]) -> DataFrame:
    """A row for each metric: ids, metric_key, value."""
    return season.unpivot(ids, metrics, "metric_key", "value")


def by_value(df: DataFrame, partition: list[str], value: str = "value") -> DataFrame:
    """(partition, value, n, upto, below, total): the distinct values of each population, how many have them, and how many
    lie up to and below them; null comes last. Counts are summed before the shuffle, so a window holds distinct values, not players.

    There may be as many values as players, and Spark takes them for few: rows meet them by a merge, not by a broadcast."""
    counted = df.groupBy(*partition, value).agg(F.count("*").alias("n"))
    every = Window.partitionBy(*partition)
    upto = F.sum("n").over(_running(partition, value))
    return counted.select(*partition, value, "n", upto.alias("upto"), (upto - F.col("n")).alias("below"), F.sum("n").over(every).alias("total"))


def _running(partition: list[str], value: str):
    ordered = Window.partitionBy(*partition).orderBy(F.col(value).asc_nulls_last())
    return ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)


def with_moments(values: DataFrame, partition: list[str], value: str = "value") -> DataFrame:
    """by_value() with _mean and _sd (of the population) of all values up to each, from prefix sums of n, differences and
    their squares. Differences are from the least value of the population, so that equal values have a deviation of just zero."""
    running = _running(partition, value)
    off = F.col(value) - F.min(value).over(Window.partitionBy(*partition))
    known = F.when(F.col(value).isNotNull(), F.col("n"))
    rows = values.withColumns({"_off": off, "_k": known})
    n, first, second = (F.sum(c).over(running) for c in (F.col("_k"), F.col("_k") * F.col("_off"), F.col("_k") * F.col("_off") * F.col("_off")))
    rows = rows.withColumns({"_n": n, "_s1": first, "_s2": second})
    mean = F.col("_s1") / F.col("_n")
    spread = F.sqrt(F.greatest(F.lit(0.0), F.col("_s2") / F.col("_n") - mean * mean))
    least = F.min(value).over(Window.partitionBy(*partition))
    return rows.withColumns({"_mean": least + mean, "_sd": spread}).drop("_off", "_k", "_n", "_s1", "_s2")


def _on(partition: list[str], left: str, right: str):
    """Equal keys, nulls with nulls."""
    on = F.lit(True)
    for c in partition:
        on = on & F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}"))
    return on


def _plain(side: str, columns: list[str]) -> list:
    """Columns of one side of a join by their own names, without the side's."""
    return [F.col(f"{side}.`{c}`").alias(c) for c in columns]


def percentile_at_or_below(df: DataFrame, partition: list[str], value: str = "value", inverted: bool = False, small: bool = False) -> DataFrame:
    """percentile: the share of the population at or below a value, 0 to 100, 1 decimal. Nulls are left out.

    small: populations fit one task each, as the teams of a season do; they are ranked in place.
    """
    known, shown = df.where(F.col(value).isNotNull()), lambda p: jsround(100 - p, 1) if inverted else p
    if small:
        return known.withColumn("percentile", shown(jsround(F.cume_dist().over(Window.partitionBy(*partition).orderBy(value)) * 100, 1)))
    ranks = by_value(known, partition, value).select(*partition, value, shown(jsround(F.col("upto") / F.col("total") * 100, 1)).alias("percentile"))
    return known.join(ranks.hint("merge"), [*partition, value]).select(*df.columns, "percentile")


def zscore(df: DataFrame, partition: list[str], value: str = "value") -> DataFrame:
    """mean, stddev (of the population) and z, each rounded to 3 decimals before it is used; 0 for a value that is unknown or alone.

    The moments are grouped sums: of the values, then of their distances from the rounded mean. Both go over distinct values
    and are summed before the shuffle; a row meets the one row of its population. Sums are cut to 9 decimals first, so that
    the order of summing can't move a value across a half.
    """
    cut = lambda c: jsround(F.round(c, 9), 3)
    v, n = F.col(value), F.col("_n")
    counted = df.groupBy(*partition, value).agg(F.count("*").alias("_n")).where(v.isNotNull())
    means = counted.groupBy(*partition).agg(cut(F.sum(v * n) / F.sum("_n")).alias("mean"))
    off = v - F.col("m.mean")
    spread = F.when(F.sum("_n") < 2, 0.0).otherwise(cut(F.sqrt(F.sum(off * off * n) / F.sum("_n"))))
    both = counted.alias("c").join(means.alias("m"), _on(partition, "c", "m"))
    told = both.groupBy(*(F.col(f"c.{c}").alias(c) for c in partition)).agg(F.first("m.mean").alias("mean"), spread.alias("stddev"))
    joined = df.alias("d").join(told.alias("t"), _on(partition, "d", "t"), "left")
    rows = joined.select(*_plain("d", df.columns), *_plain("t", ["mean"]), F.coalesce("t.stddev", F.lit(0.0)).alias("stddev"))
    return rows.withColumn("z", F.when(F.col("stddev") == 0, 0.0).otherwise(cut((F.col(value) - F.col("mean")) / F.col("stddev"))))


def player_percentiles(long: DataFrame, min_minutes: int = 450, frame: str = "population", partition: tuple[str, ...] = ("season_id", "position_group", "metric_key")) -> DataFrame:
    """percentile (exclusive, 1 decimal), z_score (3 decimals) and population_size among players with enough minutes.

    frame: "population" measures against all, "running" against those up to and with equal values, by prefix moments over distinct
    values. Without a value there is no rank: such rows are left out of the population; in a running frame they come last.
    """
    enough, keys = long.where(F.col("minutes") >= min_minutes), [*partition, "value"]
    rank = F.when(F.col("total") > 1, F.col("below") / (F.col("total") - 1)).otherwise(0.0)
    if frame == "running":
        values = with_moments(by_value(enough, list(partition)), list(partition)).withColumn("population_size", F.col("upto"))
    else:
        enough = enough.where("value is not null")
        every, v = Window.partitionBy(*partition), F.col("value")
        values = by_value(enough, list(partition)).withColumn("_mean", F.sum(v * F.col("n")).over(every) / F.col("total"))
        off = v - F.col("_mean")
        values = values.withColumns({"_sd": F.sqrt(F.sum(off * off * F.col("n")).over(every) / F.col("total")), "population_size": F.col("total")})
    made = ["percentile", "_mean", "_sd", "population_size"]
    values = values.withColumn("percentile", jsround(rank * 100, 1)).select(*keys, *made)
    ranked = enough.alias("e").join(values.hint("merge").alias("v"), _on(keys, "e", "v")).select(*_plain("e", enough.columns), *_plain("v", made))
    z = F.when(F.col("_sd").isNull() | (F.col("_sd") < 1e-12), 0.0).otherwise(jsround((F.col("value") - F.col("_mean")) / F.col("_sd"), 3))
    population = F.lit("+".join(c for c in partition if c != "metric_key"))
    return ranked.select("*", z.alias("z_score"), F.lit(min_minutes).alias("population_min_minutes"), population.alias("population_definition")).drop("_mean", "_sd")


def club_percentiles(team_season: DataFrame, metrics: list[str]) -> DataFrame:
    """(season_id, team_id, metric_key, value, percentile): the share strictly below, among at least two clubs."""
    long = unpivot(team_season.select("season_id", "team_id", *(F.col(m).cast("double").alias(m) for m in metrics)), metrics, ["season_id", "team_id"]).where("value is not null")
    w = Window.partitionBy("season_id", "metric_key")
    return long.select("*", F.count("*").over(w).alias("n"), jsround(F.percent_rank().over(w.orderBy("value")) * 100, 1).alias("percentile")).where("n >= 2").drop("n")


def latest_by(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key by an order."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def team_trend(team_match: DataFrame, matches: DataFrame, teams: DataFrame) -> DataFrame:
    """Each team's matches in order of kickoff with four series and a label of the opponent."""
    names = lambda side: teams.select(F.col("team_id").alias(f"{side}_team_id"), F.col("team_name").alias(f"_{side}"))
    rows = team_match.join(matches.select("match_id", "kickoff_at", "home_team_id", "away_team_id"), "match_id").join(names("home"), "home_team_id", "left").join(names("away"), "away_team_id", "left")
    label = F.when(F.col("team_id") == F.col("home_team_id"), F.concat(F.lit("vs "), "_away")).otherwise(F.concat(F.lit("at "), "_home"))
    n = F.row_number().over(Window.partitionBy("team_id").orderBy("kickoff_at", "match_id"))
    return rows.select("team_id", "match_id", n.alias("n"), label.alias("label"), "xg", "possession", "crosses", "directness")
