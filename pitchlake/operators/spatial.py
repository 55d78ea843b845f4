"""Zones, heatmaps and passing networks for every subject at once."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import LENGTH, WIDTH, jsround, zone_of
from ..plans.config import DEAD_BALL, HEATMAPS
from . import grids

KINDS = ["touches", "passes", "carries", "shots", "defensive_actions", "pressures"]


def zone_kind(kind: Column) -> Column:
    """The zone counter that an event type feeds."""
    return F.when(kind == "PASS", "passes").when(kind.isin("CARRY", "DRIBBLE"), "carries").when(kind == "SHOT", "shots").when(kind == "PRESSURE", "pressures").when(kind.isin(*HEATMAPS["DEFENSIVE_ACTION"][0]), "defensive_actions").otherwise("touches")


def heatmap_points(events: DataFrame, kind: str, keep: list[str]) -> DataFrame:
    """(keep, x, y, weight): where the events of a heatmap take place; shots weigh their expected goals."""
    types, at_end = HEATMAPS[kind]
    xg = F.col("shot.xg") if "shot" in events.columns else F.lit(None).cast("double")
    weight = F.when(F.col("type") == "SHOT", F.greatest(F.lit(0.05), F.coalesce(xg, F.lit(0.0)))).otherwise(1.0) if kind == "SHOT" else F.lit(1.0)
    x, y = ("end_x", "end_y") if at_end else ("x", "y")
    return events.where(F.col("type").isin(*types)).select(*keep, F.col(x).alias("x"), F.col(y).alias("y"), weight.alias("weight")).where("x is not null and y is not null")


def filter_events(events: DataFrame, half: int | None = None, minutes: tuple[int | None, int | None] = (None, None), team_id=None, player_id=None, types: list[str] | None = None, possession: str | None = None) -> DataFrame:
    """Events of a half, minutes, team, player, types, in or out of possession; unknown possession counts as in."""
    tests = []
    if half:
        tests.append(F.col("period") == half)
    if minutes[0] is not None:
        tests.append(F.col("minute") >= minutes[0])
    if minutes[1] is not None:
        tests.append(F.col("minute") <= minutes[1])
    if team_id is not None:
        tests.append(F.col("team_id") == team_id)
    if player_id is not None:
        tests.append(F.col("player_id") == player_id)
    if types:
        tests.append(F.col("type").isin(*types))
    if possession:
        inside = F.col("in_possession") if "in_possession" in events.columns else F.col("possession_team_id") == F.col("team_id")
        tests.append(F.coalesce(inside, F.lit(True)) if possession == "IN" else F.coalesce(~inside, F.lit(False)))
    for t in tests:
        events = events.where(t)
    return events


def zone_activity(events: DataFrame, subject: list[str], scheme: str = "THIRDS_LANES") -> DataFrame:
    """Counters and possession time of each subject and zone; events without a place are left out."""
    rows = events.where("x is not null and y is not null").select(*subject, zone_of(F.col("x"), F.col("y"), scheme).alias("z"), zone_kind(F.col("type")).alias("kind"), F.coalesce("duration_sec", F.lit(0.0)).alias("s"))
    out = rows.groupBy(*subject, F.col("z.key").alias("zone_key"), F.col("z.row").alias("zone_row"), F.col("z.col").alias("zone_col")).agg(*(F.count_if(F.col("kind") == k).alias(k) for k in KINDS), F.sum("s").alias("possession_time_sec"))
    return out.withColumn("zone_scheme", F.lit(scheme))


def zone_rollup(zones: DataFrame, subject: list[str]) -> DataFrame:
    """Zone counters over the matches of a subject, with the number of matches."""
    return zones.groupBy(*subject, "zone_scheme", "zone_key", "zone_row", "zone_col").agg(F.countDistinct("match_id").alias("matches"), *(F.sum(k).alias(k) for k in [*KINDS, "possession_time_sec"]))


def _in_bounds(points: DataFrame) -> DataFrame:
    return points.where(F.col("x").between(0, LENGTH) & F.col("y").between(0, WIDTH) & ~F.isnan("x") & ~F.isnan("y"))


def _cell(c: str, size: float, count: int) -> Column:
    return F.least(F.lit(count - 1), F.floor(F.col(c) / size * count)).cast("int")


def _complete(cells: DataFrame, subject: list[str], cols: int, rows: int, hexagons: bool, normalize: bool) -> DataFrame:
    """Adds the empty cells of the grid, the cells' centres, and divides by the subject's peak."""
    grid = F.explode(F.flatten(F.transform(F.sequence(F.lit(0), F.lit(cols - 1)), lambda c: F.transform(F.sequence(F.lit(0), F.lit(rows - 1)), lambda r: F.struct(c.alias("col"), r.alias("row"))))))
    of = cells.groupBy(*subject).agg(F.max("value").alias("peak"), F.sum("count").alias("sample_size"), F.sum("weight").alias("total_weight"))
    every = of.select(*subject, "peak", "sample_size", "total_weight", grid.alias("g")).select(*subject, "peak", "sample_size", "total_weight", "g.col", "g.row")
    out = every.join(cells.select(*subject, "col", "row", "value", "count"), [*subject, "col", "row"], "left").fillna(0.0, ["value"]).fillna(0, ["count"])
    return _placed(out, subject, cols, rows, hexagons, normalize)


def _placed(out: DataFrame, subject: list[str], cols: int, rows: int, hexagons: bool, normalize: bool) -> DataFrame:
    """Adds the centres of a whole grid's cells, and divides by the subject's peak."""
    w, h = LENGTH / cols, WIDTH / rows
    x = F.least(F.lit(LENGTH), w * F.col("col") + F.when(F.col("row") % 2 == 1, w / 2).otherwise(0.0) + w / 2) if hexagons else w * (F.col("col") + 0.5)
    value = F.when(F.col("peak") > 0, jsround(F.col("value") / F.col("peak"), 4)).otherwise(0.0) if normalize else jsround(F.col("value"), 4)
    return out.select(*subject, "col", "row", jsround(x, 2).alias("x"), jsround(h * (F.col("row") + 0.5), 2).alias("y"), value.alias("value"), "count", "peak", "sample_size", "total_weight")


def heatmap_grid(points: DataFrame, subject: list[str], cols: int = 24, rows: int = 16, normalize: bool = True) -> DataFrame:
    """Weights by rectangular cell, empty cells included."""
    cells = _in_bounds(points).groupBy(*subject, _cell("x", LENGTH, cols).alias("col"), _cell("y", WIDTH, rows).alias("row")).agg(F.sum("weight").alias("value"), F.count("*").alias("count"), F.sum("weight").alias("weight"))
    return _complete(cells, subject, cols, rows, False, normalize)


def heatmap_hexbin(points: DataFrame, subject: list[str], cols: int = 24, rows: int = 16, normalize: bool = True) -> DataFrame:
    """Weights by cell, where odd rows are moved half a cell."""
    w = LENGTH / cols
    placed = _in_bounds(points).withColumn("row", _cell("y", WIDTH, rows))
    col = F.greatest(F.lit(0), F.least(F.lit(cols - 1), F.floor((F.col("x") - F.when(F.col("row") % 2 == 1, w / 2).otherwise(0.0)) / w + 0.5))).cast("int")
    cells = placed.groupBy(*subject, col.alias("col"), "row").agg(F.sum("weight").alias("value"), F.count("*").alias("count"), F.sum("weight").alias("weight"))
    return _complete(cells, subject, cols, rows, True, normalize)


def heatmap_kde(points: DataFrame, subject: list[str], cols: int = 24, rows: int = 16, bandwidth: float = 6.0, normalize: bool = True) -> DataFrame:
    """Gaussian density, cut at three bandwidths; count is that of the cell that a point lies in."""
    w, h = LENGTH / cols, WIDTH / rows
    centre = lambda size, n: [math.floor(size * (k + 0.5) * 100 + 0.5) / 100 for k in range(n)]  # noqa: E731  rounded as the cells' places are
    cells = grids.density(_in_bounds(points), subject, centre(w, cols), centre(h, rows), LENGTH, WIDTH, bandwidth, 3 * bandwidth)
    return _placed(cells, subject, cols, rows, False, normalize)


def heatmap_kde_full(points: DataFrame, subject: list[str], cols: int = 24, rows: int = 16, bandwidth: float = 6.0, method: str = "exact", normalize: bool = True) -> DataFrame:
    """Gaussian density at the centres of all cells: round kernels ("exact"), or kernels in the shape of the points' own covariance.

    The latter need three distinct points (3 decimals) and a regular covariance, else they are round. For the covariance equal
    points are summed first, with what it needs of each of them: their number, weights and squared weights.
    """
    w, h = LENGTH / cols, WIDTH / rows
    shaped = inside = _in_bounds(points)
    if method == "covariance":
        squares = F.sum(F.col("weight") * F.col("weight"))
        own = inside.groupBy(*subject, "x", "y").agg(F.sum("weight").alias("weight"), squares.alias("w2"), F.count("*").alias("n"))
        round_kernel = F.struct(F.lit(1 / bandwidth**2).alias("xx"), F.lit(0.0).alias("xy"), F.lit(1 / bandwidth**2).alias("yy"))
        kernel = F.coalesce(_covariance_kernel(bandwidth), round_kernel)
        shaped = inside.join(_moments(own, subject).select(*subject, kernel.alias("k")), subject)
    centre = lambda size, n: [size * (k + 0.5) for k in range(n)]
    cells = grids.density(shaped, subject, centre(w, cols), centre(h, rows), LENGTH, WIDTH, bandwidth, kernel=method == "covariance")
    return _placed(cells, subject, cols, rows, False, normalize)


def _moments(own: DataFrame, subject: list[str]) -> DataFrame:
    """Weighted covariance, deviation of x over all points, and the number of distinct points of each subject."""
    total = F.sum("weight")
    mean = own.groupBy(*subject).agg(
        (F.sum(F.col("weight") * F.col("x")) / total).alias("mx"), (F.sum(F.col("weight") * F.col("y")) / total).alias("my"), total.alias("w1"), F.sum("w2").alias("w2"),
        F.sum("n").alias("points"), (F.sum(F.col("n") * F.col("x")) / F.sum("n")).alias("ux"), F.countDistinct(F.round("x", 3), F.round("y", 3)).alias("distinct"),
    )
    off = lambda c: F.col(c) - F.col(f"m{c}")
    norm = F.first("w1") - F.first("w2") / F.first("w1")
    moment = lambda a, b, name: (F.sum(F.col("weight") * off(a) * off(b)) / norm).alias(name)
    spread = F.sqrt(F.sum(F.col("n") * (F.col("x") - F.col("ux")) * (F.col("x") - F.col("ux"))) / F.first("points"))
    joined = own.select(*subject, "x", "y", "weight", "n").join(mean, subject)
    return joined.groupBy(*subject).agg(moment("x", "x", "cxx"), moment("x", "y", "cxy"), moment("y", "y", "cyy"), spread.alias("sd"), F.first("distinct").alias("distinct"))


def _covariance_kernel(bandwidth: float) -> Column:
    """The inverse of the scaled covariance; null where there are too few points or they lie on a line."""
    scale = bandwidth / F.greatest(F.when(F.col("sd") == 0, 1.0).otherwise(F.col("sd")), F.lit(1e-6)) / 10
    det = (F.col("cxx") * F.col("cyy") - F.col("cxy") * F.col("cxy")) * scale * scale
    inverse = F.struct((F.col("cyy") / det).alias("xx"), (-F.col("cxy") / det).alias("xy"), (F.col("cxx") / det).alias("yy"))
    return F.when((F.col("distinct") >= 3) & (det > 1e-12), inverse)


def passing_network(events: DataFrame, period: str = "full", possession_only: bool = False, min_passes: int = 2) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes, edges and totals of every match and team.

    A node lies at the mean of where a player's passes start and the completed passes to them end; players without any
    place are left out, with their edges.
    """
    passes = events.where("type = 'PASS'")
    if period != "full":
        passes = passes.where(F.col("period") == {"first": 1, "second": 2}[period])
    if possession_only:
        passes = passes.where((F.col("possession_team_id") == F.col("team_id")) & F.coalesce(~F.col("play_pattern").isin(*DEAD_BALL), F.lit(True)))
    key, done = ["match_id", "team_id"], F.coalesce("pass.completed", F.lit(False))
    to = F.when(F.col("player_id").isNotNull() & done & (F.col("pass.recipient_id") != F.col("player_id")), F.col("pass.recipient_id"))
    slim = passes.select(*key, "player_id", to.alias("to_id"), "minute", "x", "y", "end_x", "end_y", done.alias("done"))
    end = lambda who, x, y, given: F.struct(F.col(who).alias("player_id"), F.col(x).alias("x"), F.col(y).alias("y"), F.lit(given).alias("given"))
    both = slim.select(*key, "minute", F.explode(F.array(end("player_id", "x", "y", 1), end("to_id", "end_x", "end_y", 0))).alias("e")).select(*key, "minute", "e.*").where("player_id is not null")
    placed = F.col("x").isNotNull() & F.col("y").isNotNull()
    nodes = both.groupBy(*key, "player_id").agg(
        (F.sum(F.when(placed, F.col("x"))) / F.count_if(placed)).alias("x"), (F.sum(F.when(placed, F.col("y"))) / F.count_if(placed)).alias("y"), F.sum("given").cast("bigint").alias("passes"), F.sum(1 - F.col("given")).cast("bigint").alias("received"),
        F.min("minute").alias("first_minute"), F.max("minute").alias("last_minute"),
    ).where("x is not null")
    edges = slim.where("to_id is not null").groupBy(*key, F.col("player_id").alias("from_id"), "to_id").agg(F.count("*").alias("passes")).where(F.col("passes") >= min_passes)
    for side in ("from_id", "to_id"):
        edges = edges.join(nodes.select(*key, F.col("player_id").alias(side)), [*key, side], "left_semi")
    totals = slim.groupBy(*key).agg(F.count("*").alias("total_passes"), F.count_if(F.col("done") & F.col("player_id").isNotNull()).alias("completed_passes"), F.count_if(F.col("to_id").isNotNull()).alias("linked_passes"))
    return nodes, edges, totals
